import hashlib
import re
import zlib

from verdigris.llm.exact_dedup import deduplicate, exact_groups
from verdigris.llm.sharding import domain, permute, place, round_keys, shard

SCHEMA = "doc_id long, text string, shard string, slot int"
ROWS = [(5, "a b"), (3, "a  b"), (9, "a\tb"), (None, "a b"), (7, None), (8, ""), (7, None), (2, "é" * 5000), (4, "a b"), (2, "other")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def test_permutation_is_a_bijection():
    for n in (1, 2, 3, 10, 97, 1000):
        assert sorted(place(i, n, 7) for i in range(n)) == list(range(n))
        a, b = domain(n)
        assert sorted(permute(x, a, b, round_keys(1)) for x in range(a * b)) == list(range(a * b))


def test_shards_match_the_plain_form(spark):
    rows = [(i, f"text {i}" * (i % 5)) for i in range(500)]
    got = sorted(shard(frame(spark, rows), 40).collect())
    assert [r.doc_id for r in got] == list(range(500))
    for r in got:
        p = place(r.doc_id, 500, 20240229)
        data = rows[r.doc_id][1].encode()
        assert (r.shard, r.slot, r["size"], r.text_crc32) == (p % 40, p // 40, len(data) + 16, zlib.crc32(data))
    assert got == sorted(shard(frame(spark, rows).repartition(7), 40).collect())


def test_shards_of_odd_rows(spark):
    got = shard(frame(spark, ROWS), 3).collect()
    assert sorted(r.shard for r in got) == sorted(i % 3 for i in range(len(ROWS)))
    assert sorted((r.shard, r.slot) for r in got) == sorted((i % 3, i // 3) for i in range(len(ROWS)))
    assert all(r["size"] == 16 and r.text_crc32 == 0 for r in got if r.doc_id == 7)
    assert shard(frame(spark, []), 3).count() == 0


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0d]+", " ", t or ""), []).append(i)
    ids = lambda g: min((x for x in g if x is not None), default=None)
    return sorted(((i, ids(g), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g), key=str)


def test_exact_groups(spark):
    many = ROWS + [(100 + i, "hot\ncopy") for i in range(60)]
    got = exact_groups(frame(spark, many).repartition(9)).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute(many)
    assert sum(r.kept for r in got) == len({r.text_sha256 for r in got})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert exact_groups(frame(spark, [])).count() == 0


def test_deduplicate_keeps_one_row_of_each_text(spark):
    out = deduplicate(frame(spark, ROWS))
    assert out.columns == ["doc_id", "text", "shard", "slot"]
    assert sorted((r.doc_id, r.text) for r in out.collect() if r.text) == sorted([(3, "a  b"), (2, "é" * 5000), (4, "a b"), (2, "other")])
    assert [r.doc_id for r in out.collect() if not r.text] == [7]


def test_deduplicate_keeps_columns_of_any_name(spark):
    rows = [(5, "a  b", 77, "s1", 1), (3, "a b", 78, "s2", 2), (3, "a\tb", 79, "s3", 3), (None, "a b", 80, "s4", 4), (None, "only", 81, "s5", 5), (9, None, 82, "s6", 6), (8, "", 83, "s7", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _len int, _sha string, _rid int").coalesce(1)
    got = sorted(map(tuple, deduplicate(docs).collect()), key=str)
    assert got == sorted([rows[1], rows[4], rows[6]], key=str)
    names = spark.createDataFrame([("none", "x"), (None, "x"), ("b", "y")], "doc_id string, text string")
    assert sorted(map(tuple, deduplicate(names).collect())) == [("b", "y"), ("none", "x")]

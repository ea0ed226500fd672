import re
from collections import Counter, defaultdict
from itertools import permutations

from verdigris.llm.filter_audit import audit, document_flags

DOCS = "doc_id long, text string, source string, sha string, part string, pattern int"
LABELS = "doc_id long, quality int, toxic int"


def plain(docs, labels):
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    key = lambda i: (i is None, i or 0)
    least = {}
    for i, text, _ in docs:
        least[text or ""] = min(least.get(text or "", (True, 0)), key(i))
    seen = defaultdict(list)
    for i, text, source in docs:
        text = text or ""
        words = re.findall("[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": key(i) > least[text]}
        seen[source or ""].append(({f for f in fails if fails[f]}, i in good, i in toxic))
    out, shapley = {}, Counter()
    for part, rows in seen.items():
        for order in map("".join, permutations("ABCDE")):
            for step, own in enumerate(order, 1):
                before = set(order[: step - 1])
                gone = [r for r in rows if own in r[0] and not r[0] & before]
                shapley[part, own] += len(gone)
                out[part, order, step] = [
                    sum(not r[0] & (before | {own}) for r in rows), len(gone), sum(own in r[0] and bool(r[0] & before) for r in rows),
                    sum(r[0] == {own} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone),
                ]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def made(spark, docs, labels):
    frame = spark.createDataFrame([(*d, "x", "y", 9) for d in docs], DOCS)
    return frame, spark.createDataFrame(labels, LABELS)


def test_equals_the_plain_form(spark):
    many = [" ".join(f"w{(i * k) % 80}" for i in range(n)) for k, n in ((1, 60), (2, 90), (3, 200), (7, 49), (1, 50))]
    docs = [(i, many[i % 5] + ("#" if i % 4 == 0 else "") + (" ABCDEFGHIJKLMNOP" * (i % 3)), ("hot", "hot", "b", None, "")[i % 5]) for i in range(60)]
    docs += [(None, "", None), (None, "", None), (3, None, "b"), (3, None, "b"), (70, " \t\n", "b"), (71, "é" * 30000 + " \x0b$ É", "hot"), (71, "other", "hot"), (72, "only null ids", None), (None, "just one null", "b")]
    labels = [(i, i % 2, int(i % 7 == 0)) for i in range(0, 60, 2)] + [(None, 1, 1), (3, None, 1), (3, 1, None), (4, 0, 0), (4, 1, 0)]
    got = audit(*made(spark, docs, labels))
    rows = got.collect()
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert len(rows) == 600 * 3
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in rows} == plain(docs, labels)


def test_words_of_each_document(spark):
    rows = document_flags(*made(spark, [(1, "a b a", "s"), (2, "  a  b a", "s"), (3, "", "s"), (1, "a b a", "s")], [])).collect()
    assert sorted((r.doc_id, r.words, r.distinct_words) for r in rows) == [(1, 3, 2), (1, 3, 2), (2, 3, 2), (3, 0, 0)]
    assert all(r.pattern == 1 for r in rows)


def test_empty_tables(spark):
    assert audit(*made(spark, [], [])).count() == 0
    assert audit(*made(spark, [(1, "a", "s")], [])).count() == 600

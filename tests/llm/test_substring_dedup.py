import hashlib
import random
from collections import Counter

from verdigris.llm import substring_dedup
from verdigris.llm.substring_dedup import LENGTH, Parsed, factors, strip_repeats

SCHEMA = "doc_id long, text string, key string, a int, spans string, _id int"


def plain(rows):
    split = [(i, (text or "").encode().split()) for i, text in rows]
    windows = Counter(tuple(w[k : k + LENGTH]) for _, w in split for k in range(len(w) - LENGTH + 1))
    out = []
    for i, w in split:
        gone = {p for k in range(len(w) - LENGTH + 1) if windows[tuple(w[k : k + LENGTH])] > 1 for p in range(k, k + LENGTH)}
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((str(i), len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return sorted(out)


def result(spark, rows):
    got = strip_repeats(spark.createDataFrame([(*r, "k", 1, "s", 2) for r in rows], SCHEMA), keep_text=True)
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in got.collect())


def corpus(seed):
    pick = random.Random(seed)
    words = lambda n, of=500: [f"w{pick.randrange(of)}" for _ in range(n)]
    passages = [words(n) for n in (34, 35, 36, 50, 120)] + [words(60, 3), words(14)]
    rows = [(i, " ".join(words(pick.randrange(60)) + (pick.choice(passages) + words(pick.randrange(3))) * pick.randrange(3) + words(pick.randrange(60)))) for i in range(60)]
    rows += [(100 + i, "\t ".join(passages[4][i : i + 60] + words(4))) for i in range(5)]
    near = words(300)
    rows += [(200 + i, "\n".join([*near[: 40 * i], "changed", *near[40 * i + 1 :]])) for i in range(6)]
    rows += [(300, rows[0][1]), (0, rows[0][1]), (None, " ".join(near)), (301, None), (302, ""), (303, " \x0b "), (304, "é\xa0b c " * 40), (305, "same " * 200), (306, "x y " * 17), (307, "no repeat here")]
    return rows


def test_equals_the_plain_form(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        assert result(spark, rows) == plain(rows)


def test_crowded_blocks_equal_the_plain_form(spark, monkeypatch):
    rows = corpus(3)
    monkeypatch.setattr(substring_dedup, "BLOCK", 1)
    assert result(spark, rows) == plain(rows)


def test_a_short_common_phrase_in_very_many_surroundings(spark):
    pick = random.Random(7)
    words = lambda n: [str(pick.random()) for _ in range(n)]
    phrase, tails = words(20), [words(20) for _ in range(300)]
    rows = [(i, " ".join(words(30) + phrase + (tails[i // 2] if i % 3 else words(20)))) for i in range(600)]
    got = result(spark, rows)
    assert got == plain(rows) and 0 < sum(r[2] > 0 for r in got) < 600


def test_a_very_long_text(spark):
    pick = random.Random(9)
    text = " ".join(str(pick.randrange(10**6)) for _ in range(300_000))
    rows = [(1, text), (2, text[5_000:9_000]), (3, "w " * 20_000)]
    assert result(spark, rows) == plain(rows)


def test_segments_hold_every_window_once():
    pick = random.Random(4)
    words = [b"%d" % pick.randrange(900) for _ in range(1000)]
    one, two = Parsed(words), Parsed(words[100:400])
    assert len(one.seeds) == 1000 - LENGTH + 1 and one.starts[0] == 0 and (two.seeds == one.seeds[100 : 100 + len(two.seeds)]).all()
    of = {int(s): int(a) for p in (one,) for a, b, c in zip(p.anchors, p.starts, [*p.starts[1:], len(p.seeds)], strict=True) for s in p.seeds[b:c]}
    assert all(of[int(s)] == int(a) for a, b, c in zip(two.anchors, two.starts, [*two.starts[1:], len(two.seeds)], strict=True) for s in two.seeds[b:c])


def test_factors_end_where_no_reference_goes_on():
    assert factors([([1, 2, 3, 4], 1), ([1, 2], 1), ([3, 4, 5], 1)]) == [[(0, 1), (2, 3)], [(0, 1)], [(0, 1)]]
    assert factors([([1, 2, 3], 2)]) == [[(0, 2)]] and factors([([1, 2, 3], 1)]) == [[]]


def test_empty_table(spark):
    assert result(spark, []) == []

import hashlib
import random
import re

from verdigris.llm import decontamination
from verdigris.llm.decontamination import WuManber, contamination, drop_contaminated

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            iw = words(t)
            for s in range(max(1, len(iw) - 9)) if iw else ():
                window = iw[s : s + 10]
                for at in range(len(w) - len(window) + 1):
                    if w[at : at + len(window)] == window:
                        hit.update(range(at, at + len(window)))
                        if item is not None:
                            found.add(str(item))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def cases():
    random.seed(4)
    vocabulary = ["alpha", "Beta", "été", "7", "g", "the"]
    say = lambda n: " ".join(random.choice(vocabulary) for _ in range(n))
    items = [(i, say(n)) for i, n in enumerate([12, 10, 25, 9, 3, 2, 40])] + [(9, None), (10, "..."), (None, say(11)), (2, say(10)), (20, "été")]
    docs = [(i, say(random.choice([0, 5, 30, 200])) + "; " + (random.choice(items)[1] or "").upper() + "!" + say(4)) for i in range(40)]
    return docs + [(None, None), (1, ""), (1, "ÉTÉ"), (77, say(5000))], items


def test_wu_manber_finds_every_occurrence():
    random.seed(2)
    for m in (1, 2, 3, 7):
        text = [random.choice("abc") for _ in range(400)]
        patterns = sorted({tuple(random.choice("abc") for _ in range(m)) for _ in range(5)})
        expected = [(i, tuple(text[i : i + m])) for i in range(len(text) - m + 1) if tuple(text[i : i + m]) in patterns]
        assert sorted(WuManber(patterns).search(text)) == sorted(expected)


def test_contamination(spark):
    docs, items = cases()
    d = spark.createDataFrame([(*r, "c") for r in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame(items, "item_id long, text string")
    for block in (200_000, 25):
        assert sorted(map(tuple, contamination(d, b, pattern_block=block).collect()), key=str) == brute(docs, items)
        kept = drop_contaminated(d, b, pattern_block=block)
        assert kept.columns == d.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in brute(docs, items) if not r[5])
    assert contamination(d.limit(0), b).count() == 0
    assert {r.contaminated for r in contamination(d, b.limit(0)).collect()} == {False}


def test_a_text_under_very_many_identifiers_is_dealt_in_bounded_blocks(spark, monkeypatch):
    text = "one two three four five six seven eight nine ten eleven"
    many = spark.range(100_000).selectExpr("id AS item_id", f"'{text}' AS text")
    few = spark.createDataFrame([(-1, "another item of eleven words that is in the corpus, too"), (None, text)], "item_id long, text string")
    items = many.unionByName(few)
    docs = spark.createDataFrame([(1, f"so: {text.upper()} and"), (2, "another item of eleven words that is in the corpus, too"), (3, "neither of them")], "doc_id long, text string")
    monkeypatch.setattr(decontamination, "PATTERN_BYTES", 400_000)
    patterns = decontamination.windows(items, "item_id", "text")
    assert patterns.selectExpr("max(size(items))").first()[0] < 1400
    blocks, block = decontamination.pattern_blocks(items, "item_id", 200_000, 400_000)
    sizes = [sum(len(w) + sum(len(i) + 8 for i in ids) for w, ids in block(k).value) for k in range(blocks)]
    assert blocks > 4 and max(sizes) < 2 * 400_000
    names = ",".join(sorted(map(str, range(100_000))))
    monkeypatch.setattr(decontamination, "pattern_blocks", lambda b, i, n: (blocks, block))
    got = {r.doc_id: r for r in contamination(docs, items).collect()}
    assert (got[1].n_hit, got[1].n_items, got[1].items_sha256) == (11, 100_000, hashlib.sha256(names.encode()).hexdigest())
    assert (got[2].n_items, got[3].contaminated) == (1, False)
    assert [r.doc_id for r in drop_contaminated(docs, items).collect()] == [3]

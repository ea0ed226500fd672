import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from verdigris.llm import lm_score as lm

SPLIT = re.compile("[^\x20\x09-\x0d]+")


def tokens(text):
    return SPLIT.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def brute(rows):
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    c = Counter(t for (_, x), h in zip(rows, held, strict=True) if not h for t in tokens(x))
    n, v = sum(c.values()), len(c)
    return [(i, h, len(tokens(x)), sum(t in c for t in tokens(x)), n, sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens(x))) for (i, x), h in zip(rows, held, strict=True)]


def corpus(n=400):
    random.seed(9)
    left, right = [f"l{i}" for i in range(30)], [f"r{i}" for i in range(30)]
    out = []
    for i in range(n):
        k = random.randint(0, 40)
        out.append((i, " ".join(w for _ in range(k) for w in (random.choice(left), random.choice(right))) + f" Rare{random.randint(0, 600)}\t{i}é"))
    return [*out, (None, None), (7, ""), (3, "x\x0by z X"), (3, "x\x0by z X"), (9000, "word " * 30000)]


@pytest.mark.parametrize("hot", [100_000, 20])
def test_scores(spark, hot):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int").repartition(3)
    got = sorted(lm.score_documents(df, hot_words=hot, vocabulary=100).collect(), key=lambda r: str(tuple(r)[:4]))
    want = sorted(brute(rows), key=lambda r: str(r[:4]))
    assert [tuple(r)[:5] for r in got] == [r[:5] for r in want]
    for r, w in zip(got, want, strict=True):
        assert r.base_score == pytest.approx(w[5], rel=1e-9, abs=1e-6) and r.score < 0
    if hot > 1000:
        held = [r for r in got if r.held_out and r.n_tokens > 10]
        assert held and sum(r.score for r in held) > sum(r.base_score for r in held) + 0.1 * sum(r.n_tokens for r in held)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score_documents(df).count() == 0
    only_held = spark.createDataFrame([(i, "a b") for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0], "doc_id long, text string")
    assert all(r.train_tokens == 0 and r.n_known == 0 for r in lm.score_documents(only_held).collect())


def test_probabilities_are_normalised_and_learn_the_context():
    rng = np.random.default_rng(1)
    ids = np.empty(40000, np.int64)
    for i in range(len(ids)):  # classes alternate between two halves
        ids[i] = 2 + rng.integers(0, 5) + 5 * (i % 2)
    unigram = np.full(12, 0.1)
    unigram[:2] = 1e-3
    unigram /= unigram.sum()
    numbers = lm.Numbers(12, np.zeros(0, np.int64))
    model = lm.fit([ids], unigram, numbers)
    for one, two in [(3, 8), (8, 3), (12, 12), (0, 1)]:
        z = (model.c1 * model.r[one] + model.c2 * model.r[two]) @ model.q.T + model.b
        p = np.exp(z - model.log_norms(np.array([one]), np.array([two]))[0])
        assert p.sum() == pytest.approx(1, abs=1e-5)
    none = lm.Tail(np.zeros((0, lm.DIM)), np.zeros(0))
    got = lm.score_tokens(model, numbers, none, lm.no_norms(12), ids, np.array([0]))
    assert got.mean() > math.log10(1 / 10) + 0.2


class Plain:
    """Probabilities of words after contexts, written out from the definition over all words."""

    def __init__(self, trained):
        m, self.t = trained.model, trained
        self.r, self.q, self.b, self.c1, self.c2 = (p.astype(np.float32).astype(np.float64) for p in m.parameters())
        self.number = {w: k for w, _, k in trained.hot.value}
        self.counts = {bytes(r.word): r.c for r in trained.counts.collect()}

    def number_of(self, word):
        return self.number.get(word, lm.ending(word))

    def context_of(self, word):
        k = self.number_of(word)
        return k if k < self.t.own else lm.ending(word)

    def distribution(self, one, two):
        """Word -> probability, for all counted words and (unseen, k) for one unseen word of each ending."""
        vector = self.c1 * self.r[one] + self.c2 * self.r[two]
        z = vector @ self.q.T + self.b
        classes = np.exp(z - z.max())
        classes /= classes.sum()
        out = {("unseen", k): classes[k] * 0.1 / self.t.mass[k] for k in range(1, lm.ENDINGS + 1)}
        size = len(self.t.tail_counts)
        for a in range(0, size, lm.GROUP):
            inner = np.exp(self.t.tail.q[a : a + lm.GROUP] @ vector + self.t.tail.b[a : a + lm.GROUP])
            for j, x in enumerate(inner / inner.sum()):
                out["tail", a + j] = classes[self.t.own + a // lm.GROUP] * x
        for w, c in self.counts.items():
            k = lm.END if w == lm.END_WORD else self.number_of(w)
            if k >= self.t.own:
                out[w] = out.pop(("tail", k - self.t.own))
            else:
                out[w] = classes[k] * ((c + 0.1) / self.t.mass[k] if 0 < k <= lm.ENDINGS else 1)
        return out

    def score(self, text):
        total, before, start = 0.0, [], self.t.own
        for w in [*lm.words_of(text), lm.END_WORD]:
            given = [start, start, *before][-2:]
            p = self.distribution(given[1], given[0])
            total += math.log10(p[w] if w in p else p["unseen", lm.ending(w)])
            before.append(self.context_of(w))
        return total


@pytest.mark.parametrize(("hot", "vocabulary"), [(100_000, 40), (70, 20)])
def test_scores_equal_a_plain_evaluation(spark, hot, vocabulary):
    """Every word's probability by its definition; after any context all of them sum to one."""
    rows = [(i, t) for i, t in corpus(250)[:256] if i is None or i < 9000]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    frame = df.selectExpr("doc_id", "coalesce(crc32(cast(cast(doc_id as string) as binary)) % 10 = 0, false) AS held_out", "text")
    trained = lm.Trained(frame, hot, vocabulary)
    trained.learn(lm.durable(lm.tokenised(frame.selectExpr("monotonically_increasing_id() AS rid", "*"), trained.hot, trained.n, trained.v), "plain"))
    plain = Plain(trained)
    for one, two in [(trained.own, trained.own), (0, 5), (trained.own - 1, 3), (70, 130)]:
        assert sum(plain.distribution(one, two).values()) == pytest.approx(1, abs=1e-6)
    got = {r.doc_id: r.score for r in lm.score_documents(df, hot_words=hot, vocabulary=vocabulary).collect()}
    for i, text in rows[:40] + rows[-4:]:
        if i not in (3, 7):  # these have two texts
            assert got[i] == pytest.approx(plain.score(text), abs=1e-2, rel=1e-4)


def test_partitions_do_not_matter(spark):
    rows = [*corpus(), (77_777, "w" * 5000 + " A" + "b" * 90), (77_778, "w" * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one, two = (sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.score, 3)) for r in lm.score_documents(d, vocabulary=50).collect()) for d in (df.coalesce(1), df.repartition(7)))
    assert [x[:3] for x in one] == [x[:3] for x in two]
    assert [x[3] for x in one] == pytest.approx([x[3] for x in two], abs=2e-2)


def test_tail_words_have_vectors_of_their_own(spark):
    random.seed(4)
    rows = []
    for i in range(600):  # past the vocabulary, the word before tells which half of the tail follows
        pick = [random.randint(0, 1) for _ in range(30)]
        rows.append((i, " ".join(f"h{k} t{k * 300 + random.randint(0, 299)}" for k in pick)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    held = lm.score_documents(df, vocabulary=2).filter("held_out").collect()
    gained = sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held)
    assert gained > 0.34  # 0.30 with one class for the tail


def test_words_of_a_group_sum_to_one():
    rng = np.random.default_rng(2)
    n = lm.GROUP + 9
    seen = rng.integers(0, 90, n).astype(float)
    tail = lm.Tail.of(seen + 20, seen, rng.normal(size=(n, lm.DIM)) * seen[:, None], np.eye(lm.DIM) * 2 * seen.sum())
    vector = rng.normal(size=lm.DIM)
    got = np.exp(tail.scores(np.arange(n), np.tile(vector, (n, 1))))
    assert got[: lm.GROUP].sum() == pytest.approx(1, abs=1e-5) and got[lm.GROUP :].sum() == pytest.approx(1, abs=1e-5)


@pytest.mark.parametrize("shard", [4_000_000, 20_000])
def test_the_net_learns_from_every_training_row(spark, monkeypatch, shard):
    """Each c-word stands in one row of 24,000: its context vector moves from the start, whatever the number of rows."""
    monkeypatch.setattr(lm, "SHARD_TOKENS", shard, raising=False)
    rows = [(i, False, f"c{i} c{i} c{i} a b" if i % 80 == 0 else "a b") for i in range(24_000)]
    frame = spark.createDataFrame(rows, "doc_id long, held_out boolean, text string").repartition(4)
    trained = lm.Trained(frame)
    trained.learn(lm.durable(lm.tokenised(frame.selectExpr("monotonically_increasing_id() AS rid", "*"), trained.hot, trained.n, trained.v), "every"))
    start = lm.Model.start(trained.unigram, trained.own)
    at = [k for w, _, k in trained.hot.value if w.startswith(b"c")]
    moved = np.abs(trained.model.r[at] - start.r[at]).max(axis=1)
    assert len(at) == 300 and moved.min() > 1e-4


def test_shards_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_TOKENS", 8000)
    rows = [*corpus(), *corpus()[:50]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one, two = (sorted((str(r.doc_id), r.n_tokens, round(r.score, 3)) for r in lm.score_documents(d, vocabulary=50).collect()) for d in (df.coalesce(1), df.repartition(7)))
    assert [x[:2] for x in one] == [x[:2] for x in two] and [x[2] for x in one] == pytest.approx([x[2] for x in two], abs=2e-2)


def test_pieces_and_cut_texts_lose_no_triple(monkeypatch):
    """Texts longer than a piece are cut, and every token is trained on once with the words before it."""
    numbers, unigram, rng = lm.Numbers(8, np.zeros(0, np.int64)), np.full(8, 1 / 8), np.random.default_rng(4)
    texts = [rng.integers(0, 8, n).astype(np.uint32) for n in (5, 1, 23, 10, 7, 64)]
    met = Counter()
    monkeypatch.setattr(lm, "train", lambda model, u, one, two, target, weight, passes, seed: met.update({(*map(int, x[:3]),): x[3] for x in zip(one, two, target, weight, strict=True)}))
    lm.fit(texts, unigram, numbers, piece=10)
    want = Counter((int(t[i - 1]) if i else 8, int(t[i - 2]) if i > 1 else 8, int(t[i])) for t in texts for i in range(len(t)))
    assert met == want

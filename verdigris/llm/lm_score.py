"""Language-model scores: a smoothed unigram base, and a log-bilinear neural model trained by noise contrast.

Tokens are a text's words in lower case (A-Z only) and one end. Training rows are all that are not held out.

Base: exact counts of every training token, gathered by partial counts in each task and a shuffled sum.
At most HOT_WORDS words, those above a count that a histogram gives, are broadcast; other words of a text meet their
counts in a shuffled join, where none of them holds more than 1/HOT_WORDS of the tokens. Words longer than LONGEST bytes
go by a digest, so every row is bounded.

Model: every word has a class, and P(word) = P(class) * P(word in its class), both after the two words before it.
Classes are the end, the VOCABULARY most frequent words (one each), groups of at most GROUP words of all other broadcast
words that occur LEAST times (the tail, in the order of their endings), and ENDINGS classes that split what remains by a hash of
the last two bytes, so rare and unseen words have a class that says something, too. The two words before a token give a vector
r = c1 * R[w1] + c2 * R[w2] (words beyond the vocabulary have the R of their ending); a class w scores r . Q[w] + b[w].

R, Q, b, c1, c2 are trained by noise-contrastive estimation (noise: the unigram distribution) on every token of every training
row. A hash of identifier and text deals rows to shards of about SHARD_TOKENS tokens, however many that gives; a task goes over
its shards in the order of hashes, TRAINED tokens at a time. The first shard starts the model, all others go on from there side
by side, and their parameters are averaged in fixed point: the result does not depend on how rows are partitioned. Counts,
noise, the classes' masses and the tail's vectors come from every training row, too. Scores are normalised: the sum of exponentials over all classes is computed by batched matrix
products for each distinct pair of context words, once a task.

Inside its group, a tail word has a vector and a bias of its own, normalised over the group: from sums over
all training rows (in fixed point, so their order is of no matter) by the discriminant of Gaussian vectors r around each
word's mean. Means are drawn to their group's, and the covariance is that around the groups' means, which bounds what a
context can gain. A word of an ENDINGS class has its share of the base mass of that class, in which one unseen word is
counted. So the probabilities of all words, one unseen word of each ending, and the end sum to one after any context.

Cases: null text counts as empty (one token, the end); a null identifier is not held out; without training rows all
classes are equally likely; repeated rows count each time (rows equal in identifier and text meet in one shard, and pass
through it in pieces); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable
from itertools import groupby
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import durable, id_crc_mod, map_batches

HOT_WORDS = 200_000
LONGEST = 64
VOCABULARY = 1000
ENDINGS = 128
GROUP, LEAST = 256, 10
#: Tokens of a shard, and tokens whose triples are trained on at once.
SHARD_TOKENS, TRAINED = 4_000_000, 700_000
#: Training rows that a tail word's mean vector is drawn to its group's by.
DRAWN = 20
DIM, NOISE, BATCH, EPOCHS, RATE = 16, 64, 2048, 3, 0.1
#: Passes over each piece of the shard that starts the model.
FIRST = 2
#: If that is a single piece, it is gone over EPOCHS times, or more often until it made these steps.
LEAST_STEPS = 200
END = 0  # classes: the end, ENDINGS classes of rare words, words of the vocabulary, groups of the tail
END_WORD = b""
FLUSH = 200_000
#: Tokens whose vectors are held at once.
PIECE = 100_000
FIXED = 1 << 24
#: Exponents between this and its negative need no shift.
SAFE = 60.0
#: Pairs whose classes are scored at once, few enough for a core's cache.
ROWS = 256


def words_of(text: str | None) -> list[bytes]:
    """The words; long ones by a digest after a space, which no word holds."""
    if not text:
        return []
    words = text.encode().lower().split()
    if len(text) > LONGEST and max(map(len, words), default=0) > LONGEST:
        words = [w if len(w) <= LONGEST else b" " + hashlib.sha256(w).digest()[:20] for w in words]
    return words


def ending(word: bytes) -> int:
    """The class of a word beyond the vocabulary and the tail."""
    return 1 + crc32(word[-2:]) % ENDINGS


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c) over the rows that train; the end is the empty word."""

    def run(batches):
        def rows(counts):
            return pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"])

        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                counts.update(words_of(text.as_py()))
                counts[END_WORD] += 1
                if len(counts) > FLUSH:
                    yield rows(counts)
                    counts = Counter()
        if counts:
            yield rows(counts)

    return map_batches(docs.filter("NOT held_out").select("text"), run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def frequent(counts: DataFrame, most: int) -> tuple[list[tuple[bytes, int]], int]:
    """Words above the least count that at most `most` words reach, by falling count, and that count.

    They are bounded in bytes, too: no word has more than LONGEST. The cut comes from a histogram of logarithmic bins, so no top-k is merged in one task.
    """
    bin_of = F.floor(F.log2("c") * 32)
    bins = sorted(counts.groupBy(bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("least")).collect(), reverse=True)
    total, cut = 0, 1 << 62
    for row in bins:
        total += row.n
        if total > most:
            break
        cut = row.least
    found = [(bytes(r.word), r.c) for r in counts.filter(F.col("c") >= F.lit(cut)).collect()]
    return sorted(found, key=lambda x: (-x[1], x[0])), cut


def log_sums(z: np.ndarray) -> np.ndarray:
    """Natural log of the sums of exp over the rows of z, which is used up."""
    if not z.size or (z.max() < SAFE and z.min() > -SAFE):
        return np.log(np.exp(z, out=z).sum(axis=1))
    top = z.max(axis=1)
    z -= top[:, None]
    return top + np.log(np.exp(z, out=z).sum(axis=1))


class Model:
    """Parameters R (own + 1 contexts, the last the start of a text), Q, b (classes), c1, c2, and normalised scores.

    While it learns it holds the sums of squared gradients of each, too.
    """

    def __init__(self, r, q, b, c1, c2, squares=None):
        self.r, self.q, self.b, self.c1, self.c2, self.squares = r, q, b, c1, c2, squares

    @classmethod
    def start(cls, unigram: np.ndarray, own: int, seed: int = 5) -> Model:
        rng, n = np.random.default_rng(seed), len(unigram)
        every = rng.normal(size=(own + 1, DIM)) * 0.1, rng.normal(size=(n, DIM)) * 0.1, np.log(unigram), np.ones(DIM), np.ones(DIM) * 0.5
        return cls(*(p.astype(np.float32) for p in every), [np.full(p.shape, 1e-2, np.float32) for p in every])

    def parameters(self) -> list[np.ndarray]:
        return [self.r, self.q, self.b, self.c1, self.c2]

    def flat(self) -> np.ndarray:
        """Parameters and squares in rows of DIM numbers, in fixed point: sums of them do not depend on their order."""
        every = np.concatenate([p.ravel().astype(np.float64) for p in [*self.parameters(), *self.squares]])
        return np.round(np.pad(every, (0, -len(every) % DIM)) * FIXED).astype(np.int64).reshape(-1, DIM)

    @classmethod
    def mean(cls, like: Model, sums: np.ndarray, models: int) -> Model:
        """The model whose parameters are those of `models` models on average; sums: of their flat() rows."""
        shapes = [p.shape for p in like.parameters()] * 2
        values = np.split((sums.ravel() / (FIXED * models)).astype(np.float32), np.cumsum([int(np.prod(x)) for x in shapes]))
        parts = [v.reshape(x) for v, x in zip(values, shapes, strict=False)]
        return cls(*parts[:5], parts[5:])

    def vectors(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return self.c1 * self.r[one] + self.c2 * self.r[two]

    def log_norms(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Natural log of the sum over all classes, for each pair of context words, by batched matrix products."""
        out = np.empty(len(one))
        q, b = self.q.T.astype(np.float32), self.b.astype(np.float32)
        for a in range(0, len(one), ROWS):
            z = self.vectors(one[a : a + ROWS], two[a : a + ROWS]).astype(np.float32) @ q
            z += b
            out[a : a + ROWS] = log_sums(z)
        return out


class Numbers:
    """How the numbers of words map to classes and contexts: those below `own` are both, the others are the tail."""

    def __init__(self, own: int, tail_endings: np.ndarray):
        self.own, self.endings = own, tail_endings

    def classes(self, ids: np.ndarray) -> np.ndarray:
        return np.where(ids < self.own, ids, self.own + (ids - self.own) // GROUP)

    def contexts(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The word before each token and the one before that; `own` where the text has none."""
        if len(self.endings):
            ids = np.where(ids < self.own, ids, self.endings[np.maximum(ids - self.own, 0)])
        one, two = np.full(len(ids), self.own, ids.dtype), np.full(len(ids), self.own, ids.dtype)
        one[1:], two[2:] = ids[:-1], ids[:-2]
        one[starts] = self.own
        two[starts] = self.own
        second = starts + 1
        two[second[second < len(ids)]] = self.own
        return one, two

    def triples(self, ids: np.ndarray, starts: np.ndarray, dropped: list[int] | None = None) -> tuple[np.ndarray, ...]:
        """Distinct (context, target class) triples with how often each occurs; places in `dropped` are contexts alone."""
        one, two = self.contexts(ids, starts)
        base, target = self.own + 1, self.classes(ids)
        if dropped:
            one, two, target = (np.delete(x, dropped) for x in (one, two, target))
        most = int(target.max(initial=0)) + 1
        packed, weight = np.unique((two.astype(np.int64) * base + one) * most + target, return_counts=True)
        return (packed // most) % base, packed // (base * most), packed % most, weight.astype(np.float64)


def gather(index: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of values by index."""
    wide = values.shape[1]
    return np.bincount((index[:, None] * wide + np.arange(wide)).ravel(), weights=values.ravel(), minlength=n * wide).reshape(n, wide)


def train(model: Model, unigram: np.ndarray, one: np.ndarray, two: np.ndarray, target: np.ndarray, weight: np.ndarray, passes: int, seed: tuple[int, ...]) -> None:
    """Noise-contrastive estimation by Adagrad over weighted (context, target) triples; each batch shares its noise."""
    rng, n = np.random.default_rng(seed), len(unigram)
    log_noise = np.log(NOISE * unigram).astype(np.float32)
    cumulative = np.cumsum(unigram)
    for _ in range(passes):
        order = rng.permutation(len(target))
        for a in range(0, len(order), BATCH):
            at = order[a : a + BATCH]
            i, j, w = one[at], two[at], target[at]
            share = (weight[at] / weight[at].sum()).astype(np.float32)
            noise = np.minimum(np.searchsorted(cumulative, rng.random(NOISE) * cumulative[-1]), n - 1)
            ri, rj, qw, qn = model.r[i], model.r[j], model.q[w], model.q[noise]
            vector = model.c1 * ri + model.c2 * rj
            true = (vector * qw).sum(axis=1) + model.b[w] - log_noise[w]
            false = vector @ qn.T + (model.b[noise] - log_noise[noise])
            with np.errstate(over="ignore"):  # beyond the range of exp the gradient is 0
                up = share / (1 + np.exp(true))  # gradient of log sigmoid(true)
                down = np.exp(np.negative(false, out=false), out=false)
            down += 1
            np.divide(-share[:, None], down, out=down)
            g_vector = up[:, None] * qw + down @ qn
            g_q = gather(np.concatenate([w, noise]), np.concatenate([up[:, None] * vector, down.T @ vector]), n)
            g_b = np.bincount(w, weights=up, minlength=n) + np.bincount(noise, weights=down.sum(axis=0), minlength=n)
            g_r = gather(np.concatenate([i, j]), np.concatenate([g_vector * model.c1, g_vector * model.c2]), len(model.r))
            grads = [g_r, g_q, g_b, (g_vector * ri).sum(axis=0), (g_vector * rj).sum(axis=0)]
            for p, g, s in zip(model.parameters(), grads, model.squares, strict=True):
                g = (g * 20).astype(np.float32)
                s += g * g
                p += RATE * g / np.sqrt(s)


def fit(texts: Iterable[np.ndarray], unigram: np.ndarray, numbers: Numbers, model: Model | None = None, shard: int = 0, piece: int = TRAINED) -> Model:
    """Train on the numbers of the words of all texts, `piece` tokens at a time; longer texts are cut, with the two words before.

    Without a model to go on from, pieces are gone over FIRST times, a single one more often; else each is met once.
    """
    alone, model = model is None, model or Model.start(unigram, numbers.own)
    held, dropped, size, done = [], [], 0, 0

    def learn(last: bool) -> None:
        lengths = np.array([len(x) for x in held])
        triples = numbers.triples(np.concatenate(held).astype(np.int64), np.cumsum(lengths) - lengths, dropped)
        several = FIRST if done or not last else max(EPOCHS, -(-LEAST_STEPS // -(-len(triples[0]) // BATCH)))
        train(model, unigram, *triples, several if alone else 1, (3, shard, done))

    for ids in texts:
        for a in range(0, len(ids), piece):
            if size >= piece:
                learn(False)
                held, dropped, size, done = [], [], 0, done + 1
            first = max(0, a - 2)
            dropped += range(size, size + a - first)
            held.append(ids[first : a + piece])
            size += len(held[-1])
    if held:
        learn(True)
    return model


TOKENS = "rid long, doc_id long, held_out boolean, n_tokens long, known long, base double, inside double, classes binary, words array<binary>, times array<int>"


def tokenised(docs: DataFrame, hot, n: int, v: int) -> DataFrame:
    """Each text as numbers of words, what its broadcast words give to the base score, and its other words with counts.

    `hot` holds (word, count, number) of the broadcast words; number is that of the word's ending where it has none of its own.
    """

    def run(batches):
        ids = {w: i for i, (w, _, _) in enumerate(hot.value)}
        logs = np.log10((np.array([c for _, c, _ in hot.value] + [0.0]) + 0.1) / (n + 0.1 * (v + 1)))
        numbers = np.array([k for _, _, k in hot.value] + [0], np.uint32)
        get = ids.get
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for text in batch.column(3):
                tokens = words_of(text.as_py())
                tokens.append(END_WORD)
                found = np.array([get(w, -1) for w in tokens], dtype=np.int32)
                classes = numbers[found]
                unknown = np.flatnonzero(found < 0).tolist()
                strange = [tokens[i] for i in unknown]
                classes[unknown] = [ending(w) for w in strange]
                classes[-1] = END
                rare = Counter(strange)
                here = logs[found]
                known = found >= 0
                out[0].append(len(tokens))
                out[1].append(int(known.sum()))
                out[2].append(float(here[known].sum()))
                out[3].append(float(here[((classes == END) | (classes > ENDINGS)) & known].sum()))
                out[4].append(classes.tobytes())
                out[5].append(list(rare.keys()))
                out[6].append(list(rare.values()))
            kinds = pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))], names=[x.split()[0] for x in TOKENS.split(", ")])

    return map_batches(docs.select("rid", "doc_id", "held_out", "text"), run, TOKENS)


def fit_shards(rows: DataFrame, shards: int, unigram: np.ndarray, numbers: Numbers, model: Model | None) -> Model:
    """The mean of the models that `shards` shards at most give, each from `model` on; rows: shard, h, k, classes.

    A task adds up its shards' models, so what reaches the driver is one row for each DIM parameters.
    """
    names = ["at", "n", *(f"s{j}" for j in range(DIM))]
    start = Model.start(unigram, numbers.own)
    going = None if model is None else (model.parameters(), model.squares)
    shipped = rows.sparkSession.sparkContext.broadcast((unigram, numbers.own, numbers.endings, going))

    def run(batches):
        unigram, own, endings, going = shipped.value
        numbers = Numbers(own, endings)
        each = (pair for batch in batches for pair in zip(batch.column(0).to_pylist(), batch.column(1), strict=True))
        total, n = None, 0
        for shard, texts in groupby(each, key=lambda x: x[0]):
            own_start = None if going is None else Model(*(p.copy() for p in going[0]), [s.copy() for s in going[1]])
            found = fit((np.frombuffer(b.as_py(), np.uint32) for _, b in texts), unigram, numbers, own_start, shard).flat()
            total, n = found if total is None else total + found, n + 1
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.arange(len(total)), np.full(len(total), n), *total.T)], names=names)

    dealt = rows.repartition(shards, "shard").sortWithinPartitions("shard", "h", "k").select("shard", "classes")
    got = map_batches(dealt, run, ", ".join(f"{x} long" for x in names)).groupBy("at").agg(*(F.sum(x).alias(x) for x in names[1:])).orderBy("at").toArrow()
    if not got.num_rows:
        return model or start
    return Model.mean(start, np.stack([got.column(x).to_numpy() for x in names[2:]], axis=1), got.column("n")[0].as_py())


class Tail:
    """Vectors and biases of the tail's words, each normalised over its group."""

    def __init__(self, q: np.ndarray, b: np.ndarray):
        self.q, self.b = q.astype(np.float32), b.astype(np.float32)

    @classmethod
    def of(cls, counts: np.ndarray, seen: np.ndarray, sums: np.ndarray, squares: np.ndarray) -> Tail:
        """counts: the base's; seen, sums: rows and summed vectors of each word; squares: the sum of all vectors' outer products."""
        groups = np.arange(0, len(counts), GROUP)
        rows = np.maximum(np.add.reduceat(seen, groups), 1)
        middle = np.repeat(np.add.reduceat(sums, groups) / rows[:, None], GROUP, axis=0)[: len(counts)]
        around = (squares - (middle * seen[:, None]).T @ middle) / max(seen.sum(), 1)
        around += np.eye(DIM) * (1e-2 * np.trace(around) / DIM + 1e-6)
        away = (sums - seen[:, None] * middle) / (seen + DRAWN)[:, None]
        q = np.linalg.solve(around, away.T).T
        return cls(q, np.log(counts + 0.1) - (q * (middle + 0.5 * away)).sum(axis=1))

    def scores(self, words: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        """Natural log of each word's probability in its group after a context's vector."""
        out = np.empty(len(words))
        order = np.argsort(words // GROUP, kind="stable")
        groups = words[order] // GROUP
        cuts = np.flatnonzero(np.diff(groups)) + 1
        vectors = vectors.astype(np.float32)
        for part in np.split(order, cuts) if len(order) else []:
            first = words[part[0]] // GROUP * GROUP
            for a in range(0, len(part), 4096):
                at = part[a : a + 4096]
                z = vectors[at] @ self.q[first : first + GROUP].T + self.b[first : first + GROUP]
                own = z[np.arange(len(at)), words[at] - first]
                out[at] = own - log_sums(z)
        return out


def fit_tail(tokens: DataFrame, shipped, counts: np.ndarray) -> Tail:
    """The tail's words from sums over all training rows, in fixed point; at most hot_words rows reach the driver."""
    names = ["word", "n", *(f"s{j}" for j in range(DIM))]

    def run(batches):
        model, numbers = Model(*shipped.value[0]), Numbers(*shipped.value[1])
        seen, sums, squares = np.zeros(len(counts), np.int64), np.zeros((len(counts), DIM)), np.zeros((DIM, DIM))
        held: list[bytes] = []

        def add():
            ids = [np.frombuffer(b, np.uint32) for b in held]
            lengths = np.array([len(x) for x in ids])
            flat = np.concatenate(ids).astype(np.int64)
            one, two = numbers.contexts(flat, np.cumsum(lengths) - lengths)
            every = np.flatnonzero(flat >= numbers.own)
            for a in range(0, len(every), PIECE):
                at = every[a : a + PIECE]
                vectors, words = model.vectors(one[at], two[at]), flat[at] - numbers.own
                seen[:] += np.bincount(words, minlength=len(counts))
                for j in range(DIM):
                    sums[:, j] += np.bincount(words, weights=vectors[:, j], minlength=len(counts))
                squares[:] += vectors.T @ vectors

        waiting = 0
        for batch in batches:
            for b in batch.column(0):
                held.append(b.as_py())
                waiting += len(held[-1]) // 4
            if waiting > 400_000:
                add()
                waiting, held = 0, []
        if held:
            add()
        met = np.flatnonzero(seen)
        if len(met):
            values = np.round(np.concatenate([sums[met], squares]) * FIXED).astype(np.int64)
            first = np.concatenate([met, -1 - np.arange(DIM)]), np.concatenate([seen[met], np.zeros(DIM, np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*first, *values.T)], names=names)

    seen, sums, squares = np.zeros(len(counts)), np.zeros((len(counts), DIM)), np.zeros((DIM, DIM))
    if len(counts):
        rows = map_batches(tokens.filter("NOT held_out").select("classes"), run, ", ".join(f"{x} long" for x in names))
        got = rows.groupBy("word").agg(*(F.sum(x).alias(x) for x in names[1:])).toArrow()
        word, values = got.column("word").to_numpy(), np.stack([got.column(x).to_numpy() for x in names[2:]], axis=1) / FIXED
        at = word >= 0
        seen[word[at]], sums[word[at]], squares[-1 - word[~at]] = got.column("n").to_numpy()[at], values[at], values[~at]
    return Tail.of(counts, seen, sums, squares) if len(counts) else Tail(np.zeros((0, DIM)), np.zeros(0))


def score_tokens(model: Model, numbers: Numbers, tail: Tail, norms: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Log10 probability of each token's class, or word in the tail, after its context; `norms` keeps those of context pairs.

    PIECE tokens at a time, so memory does not grow with a text's length.
    """
    every = numbers.contexts(ids, starts)
    out = np.empty(len(ids))
    for a in range(0, len(ids), PIECE):
        one, two = (x[a : a + PIECE] for x in every)
        words = ids[a : a + PIECE]
        pair = one * (numbers.own + 1) + two
        here = norms[pair]
        missing = np.isnan(here)
        if missing.any():
            new = np.unique(pair[missing])
            norms[new] = model.log_norms(new // (numbers.own + 1), new % (numbers.own + 1))
            here = norms[pair]
        vector = model.vectors(one, two)
        classes = numbers.classes(words)
        gained = np.einsum("ij,ij->i", vector, model.q[classes]) + model.b[classes] - here
        at = np.flatnonzero(words >= numbers.own)
        if len(at):
            gained[at] += tail.scores(words[at] - numbers.own, vector[at])
        out[a : a + PIECE] = gained / np.log(10)
    return out


def no_norms(own: int) -> np.ndarray:
    return np.full((own + 1) ** 2, np.nan, dtype=np.float32)


class Trained:
    """All that scoring needs: (word, count, number) of the broadcast words, totals, masses, and the model."""

    def __init__(self, rows: DataFrame, hot_words: int = HOT_WORDS, vocabulary: int = VOCABULARY):
        """rows: doc_id, held_out, text."""
        sc = rows.sparkSession.sparkContext
        self.counts = durable(count_words(rows), "counts")
        self.n, self.v = (int(x or 0) for x in self.counts.agg(F.sum("c"), F.count(F.lit(1))).first())
        found, self.cut = frequent(self.counts, hot_words)
        self.per = self.n + 0.1 * (self.v + 1)
        words = [(w, c) for w, c in found if w != END_WORD]
        inside = words[:vocabulary]
        rest = sorted(((w, c) for w, c in words[vocabulary:] if c >= LEAST), key=lambda x: (ending(x[0]), -x[1], x[0]))
        self.own = 1 + ENDINGS + len(inside)
        number = {END_WORD: END} | {w: 1 + ENDINGS + i for i, (w, _) in enumerate([*inside, *rest])}
        self.hot = sc.broadcast([(w, c, number.get(w, ending(w))) for w, c in found])  # at most hot_words rows
        self.tail_counts = np.array([c for _, c in rest], dtype=np.float64)
        self.numbers = Numbers(self.own, np.array([ending(w) for w, _ in rest], dtype=np.int64))
        # base masses in counts: of each ending over all words, less those with a number of their own; one unseen word each
        mass = np.full(ENDINGS + 1, 0.1)
        of = F.crc32(F.expr("substring(word, -2, 2)")) % F.lit(ENDINGS)
        for r in self.counts.filter("word != X''").groupBy(of.alias("e")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect():
            mass[1 + r.e] += r.c + 0.1 * r.n
        for w, c in [*inside, *rest]:
            mass[ending(w)] -= c + 0.1
        self.mass = np.maximum(mass, 0.1)
        self.mass[END] = dict(found).get(END_WORD, 0) + 0.1
        grouped = [float((self.tail_counts[a : a + GROUP] + 0.1).sum()) for a in range(0, len(rest), GROUP)]
        self.unigram = np.concatenate([self.mass, [c + 0.1 for _, c in inside], grouped])
        self.unigram /= self.unigram.sum()
        #: log10 of the base mass that a class of rare words stands for
        self.log_mass = np.log10(self.mass / self.per)

    def learn(self, tokens: DataFrame) -> None:
        """Fit the model; tokens: the tokenised training rows, durable."""
        shards = max(1, -(-self.n // SHARD_TOKENS))
        h = F.xxhash64("doc_id", "classes")
        rows = tokens.filter("NOT held_out").select(F.pmod(h, F.lit(shards)).cast("int").alias("shard"), h.alias("h"), F.xxhash64("classes").alias("k"), "classes")
        self.model = fit_shards(rows.filter("shard = 0"), 1, self.unigram, self.numbers, None)
        if shards > 1:
            self.model = fit_shards(rows.filter("shard > 0"), shards - 1, self.unigram, self.numbers, self.model)
        shipped = tokens.sparkSession.sparkContext.broadcast(self.parts())
        self.tail = fit_tail(tokens, shipped, self.tail_counts)

    def parts(self) -> tuple:
        return tuple(p.astype(np.float32) for p in self.model.parameters()), (self.own, self.numbers.endings)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_words: int = HOT_WORDS, vocabulary: int = VOCABULARY) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; one row per document."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(id_crc_mod(id_col, 10) == 0, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    trained = Trained(rows, hot_words, vocabulary)
    tokens = durable(tokenised(rows.withColumn("rid", F.monotonically_increasing_id()), trained.hot, trained.n, trained.v), "tokens")
    trained.learn(tokens)
    # bounded by hot_words and VOCABULARY
    shipped = docs.sparkSession.sparkContext.broadcast((*trained.parts(), (trained.tail.q, trained.tail.b), trained.log_mass))

    def run(batches):
        model, numbers, tail, log_mass = Model(*shipped.value[0]), Numbers(*shipped.value[1]), Tail(*shipped.value[2]), shipped.value[3]
        norms = no_norms(numbers.own)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = [np.frombuffer(b.as_py(), np.uint32) for b in batch.column(4)]
            lengths = np.array([len(x) for x in ids])
            starts = np.cumsum(lengths) - lengths
            flat = np.concatenate(ids).astype(np.int64)
            rare = (flat != END) & (flat <= ENDINGS)
            gained = score_tokens(model, numbers, tail, norms, flat, starts) - np.where(rare, log_mass[np.where(rare, flat, 0)], 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(np.add.reduceat(gained, starts))], names=["rid", "n_tokens", "known", "inside", "model"])

    modelled = map_batches(tokens.select("rid", "n_tokens", "known", "inside", "classes"), run, "rid long, n_tokens long, known long, inside double, model double")
    pieces = tokens.select("rid", F.explode(F.arrays_zip("words", "times")).alias("x")).select("rid", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    rarer = trained.counts.filter(F.col("c") < F.lit(trained.cut))
    met = pieces.join(rarer, "word", "left").groupBy("rid").agg(
        F.sum(F.col("times") * F.log10((F.coalesce("c", F.lit(0)) + F.lit(0.1)) / F.lit(trained.per))).alias("rare"),
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(F.lit(0))).alias("rare_known"),
    )
    full = tokens.select("rid", "doc_id", "held_out", "base").join(modelled, "rid").join(met, "rid", "left")
    base = F.col("base") + F.coalesce("rare", F.lit(0.0))
    known = F.col("known") + F.coalesce("rare_known", F.lit(0))
    return full.select("doc_id", "held_out", "n_tokens", known.alias("n_known"), F.lit(trained.n).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("model") + base - F.col("inside")).alias("score"))

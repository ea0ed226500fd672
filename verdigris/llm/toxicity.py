"""Toxicity classifier with counterfactual regularisation.

Logistic regression over the words of a text and over word prefixes (inflected forms share them), each as present or
absent. Training minimises log loss plus two penalties: the mean squared change of the logit when identity terms of a
labelled sentence are swapped for those of another group, so that a mention of a group does not move the score by
itself; and an L1 norm (proximal gradient steps), which keeps the few features that carry the label, so that long
clean texts do not drift. Counterfactual pairs come from the labelled texts that mention identity terms and from
neutral labelled sentences built around each term.

It is fitted on at most `max_rows` labelled rows (those with the smallest identifier hashes outside the held-out
quarter) with at most `max_words` distinct words in all; every text is scored whole, by a map. Labels, language, source and identifier are no inputs of a score.

Cases: null text counts as empty and gets the bias alone; null labels are not learned from; several labels of one
document count as toxic if one is; without labelled rows of both kinds every score is the (smoothed) toxic share,
0 where there is none; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import bounded_sample, durable, id_crc_mod, map_batches

MAX_ROWS = 8000
#: Distinct words of all learned texts together: what the driver holds is bounded, however long texts are.
MAX_WORDS = 6_000_000
THRESHOLD = 0.3
PREFIXES = 4, 5
WORD = re.compile(r"[^\W\d_]+")
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"

#: Identity terms by language and group kind; a swap replaces a term by the next one of its list.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"), ("woman", "man", "girl", "boy"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european"), ("gay", "straight", "lesbian", "bisexual", "transgender"), ("immigrant", "native", "refugee", "foreigner"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("ausländer", "einheimische"), ("schwarze", "weiße"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("étrangers", "immigrés"), ("noirs", "blancs"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"), ("extranjeros", "inmigrantes"), ("negros", "blancos"),
)
SWAP = {a: b for group in IDENTITY_TERMS for a, b in pairwise((*group, group[0]))}
NEUTRAL = ("{} live here", "we met some {} today", "many {} read the paper")


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


def features_of(words: set[str]) -> set[str]:
    """The words, and their prefixes marked by a trailing hyphen."""
    return words.union(*({w[:n] + "-" for w in words if len(w) > n} for n in PREFIXES))


def swapped(words: set[str]) -> set[str]:
    return {SWAP.get(w, w) for w in words}


class Rows:
    """A growing sparse binary matrix."""

    def __init__(self):
        self.ids: dict[str, int] = {}
        self.rows: list[np.ndarray] = []

    def add(self, features: set[str], known_only: bool = False) -> None:
        ids = self.ids
        found = [ids[f] for f in features if f in ids] if known_only else [ids.setdefault(f, len(ids)) for f in features]
        self.rows.append(np.array(sorted(found), dtype=np.int32))


def packed(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Column numbers of all rows in a line, and the row of each."""
    lengths = np.array([len(r) for r in rows], dtype=np.int64)
    return (np.concatenate(rows) if rows else np.zeros(0, np.int32)), np.repeat(np.arange(len(rows), dtype=np.int32), lengths)


def fit(matrix: Rows, labels: list[int], pairs: list[tuple[set[str], set[str]]], counterfactual: float = 1.0, steps: int = 120) -> tuple[dict[str, float], float]:
    """Weights of the features kept, and the bias.

    A first fit with an L1 norm that falls with the square root of the rows selects features; a second, with a weak
    L2 norm, sets their weights. Both carry the counterfactual penalty.
    """
    y = np.array(labels, dtype=np.float64)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return {}, float(np.log((share + 1e-9) / (1 - share + 1e-9)))
    pairs = [(a, b) for a, b in pairs if a ^ b]
    least_df = 3 if len(y) < 2000 else 5
    chosen = {f for a, b in pairs for f in a ^ b}
    df = np.bincount(packed(matrix.rows)[0], minlength=len(matrix.ids))
    kept = {f for f, i in matrix.ids.items() if df[i] >= least_df}
    weights, _ = _descend(matrix, y, pairs, kept | (chosen & matrix.ids.keys()), counterfactual, 0.3 / np.sqrt(len(y)), 0.0, steps)
    return _descend(matrix, y, pairs, {f for f, w in weights.items() if w}, counterfactual, 0.0, 3e-4, 2 * steps)


def _descend(matrix: Rows, y: np.ndarray, pairs, names: set[str], counterfactual: float, l1: float, l2: float, steps: int) -> tuple[dict[str, float], float]:
    """Accelerated proximal gradient steps over the named features."""
    ids = {f: i for i, f in enumerate(f for f in matrix.ids if f in names)}
    new = np.full(len(matrix.ids), -1, dtype=np.int32)
    for f, i in ids.items():
        new[matrix.ids[f]] = i
    columns, at = packed([(r := new[row])[r >= 0] for row in matrix.rows])
    moves = [([ids[f] for f in a - b if f in ids], [ids[f] for f in b - a if f in ids]) for a, b in pairs]
    moves = [m for m in moves if m[0] or m[1]]
    pair_columns, pair_at = packed([np.array(gone + come, dtype=np.int32) for gone, come in moves])
    signs = np.concatenate([np.r_[-np.ones(len(gone)), np.ones(len(come))] for gone, come in moves]) if moves else np.zeros(0)
    n, m, k = len(y), len(ids), max(1, len(moves))
    each = np.where(y == 1, 0.25 / y.sum(), 0.25 / (n - y.sum())) + 0.5 / n  # half balanced, half as they occur
    used = np.bincount(columns, weights=each[at], minlength=m)
    rate = 4.0 / max(1.0, float(used.max(initial=0)) * float(np.bincount(at, minlength=n).mean()))
    w, v, bias, v_bias, momentum, last = np.zeros(m), np.zeros(m), 0.0, 0.0, 1.0, np.inf
    for _ in range(steps):
        z = np.bincount(at, weights=v[columns], minlength=n) + v_bias
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        error = each * (p - y)
        grad = np.bincount(columns, weights=error[at], minlength=m) + 2 * l2 * v
        loss = -(each * np.where(y == 1, np.log(p + 1e-12), np.log(1 - p + 1e-12))).sum() + l1 * np.abs(v).sum() + l2 * (v**2).sum()
        if moves:
            moved = np.bincount(pair_at, weights=v[pair_columns] * signs, minlength=len(moves))
            grad += 2 * counterfactual / k * np.bincount(pair_columns, weights=moved[pair_at] * signs, minlength=m)
            loss += counterfactual / k * (moved**2).sum()
        if loss > last * 1.5:  # the step was too long
            rate, v, v_bias, momentum, last = rate / 2, w.copy(), bias, 1.0, np.inf
            continue
        last = loss
        step = v - rate * grad
        new_w = np.sign(step) * np.maximum(np.abs(step) - rate * l1, 0)
        new_bias = v_bias - rate * error.sum()
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        v, v_bias = new_w + (momentum - 1) / following * (new_w - w), new_bias + (momentum - 1) / following * (new_bias - bias)
        w, bias, momentum = new_w, new_bias, following
    return {f: float(w[i]) for f, i in ids.items()}, float(bias)


class Model:
    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self.words = {f for f in weights if not f.endswith("-")}
        self.prefixes = {n: {f[:-1]: w for f, w in weights.items() if f.endswith("-") and len(f) == n + 1} for n in PREFIXES}

    def score(self, text: str | None) -> float:
        words = words_of(text)
        z = self.bias + sum(self.weights[w] for w in sorted(words & self.words))
        for n, known in self.prefixes.items():
            z += sum(known[p] for p in sorted({w[:n] for w in words if len(w) > n} & known.keys()))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held_out: int = 2, max_rows: int = MAX_ROWS, max_words: int = MAX_WORDS) -> Model:
    """Fit on labelled rows outside the held-out quarter; only their distinct words come to the driver, max_words at most.

    Of rows that share an identifier the one with the smallest text hash is learned from.
    """
    known = labels.filter(F.col(label_col).isNotNull() & (id_crc_mod(id_col, 4) != held_out)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
    drawn = bounded_sample(known, "_id", max_rows)
    # max_rows identifiers at most: small whatever the tables hold
    drawn = known.join(F.broadcast(drawn), "_id", "left_semi").groupBy("_id").agg(F.max("_label").alias("_label"))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def distinct_words(batches):
        for batch in batches:
            found = [sorted(words_of(t.as_py())) for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([len(w) for w in found], pa.int32()), pa.array([" ".join(w) for w in found], pa.string())], names=["id", "label", "hash", "n", "words"])

    made = texts.join(F.broadcast(drawn), "_id").select(F.xxhash64("_id").alias("id"), F.col("_label").alias("label"), F.xxhash64("_text").alias("hash"), "_text")
    # one row for each identifier; its texts meet in partial aggregates, so a repeated identifier costs a row a task
    sample = map_batches(made, distinct_words, "id long, label int, hash long, n int, words string").groupBy("id").agg(F.min_by(F.struct("label", "n", "words"), "hash").alias("r"))
    sample = durable(sample.select("id", "r.*"), "labelled")
    left, last = max_words, None
    for r in sample.select("id", "n").orderBy("id").limit(max_rows).collect():
        left -= r.n
        if left < 0:
            break
        last = r.id
    rows = sample.filter(F.col("id") <= F.lit(last)).collect() if last is not None else []
    matrix, ys, pairs = Rows(), [], []
    for row in sorted(rows, key=lambda r: r.id):
        words = set(row.words.split(" ")) - {""}
        matrix.add(features_of(words))
        ys.append(row.label)
        if words & SWAP.keys():
            mentioned = words & SWAP.keys()
            pairs.append((features_of(mentioned), features_of(swapped(mentioned))))
    if ys and 0 < sum(ys) < len(ys):
        for group in IDENTITY_TERMS:
            for a, b in pairwise((*group, group[0])):
                for sentence in NEUTRAL:
                    one, other = (words_of(sentence.format(x)) for x in (a, b))
                    pairs.append((features_of(one), features_of(other)))
    return Model(*fit(matrix, ys, pairs))


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", held_out: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted; one row per document."""
    shipped = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(batches):
        own = Model(*shipped.value)
        for batch in batches:
            scores = [own.score(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(id_crc_mod(id_col, 4) == held_out, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return map_batches(narrow, run, SCHEMA)


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents whose score is below the threshold, with all their columns, by one map over the batches."""
    shipped = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    at = docs.columns.index(text_col)

    def run(batches):
        own = Model(*shipped.value)
        for batch in batches:
            yield batch.filter(pa.array([own.score(t.as_py()) < THRESHOLD for t in batch.column(at)], pa.bool_()))

    return map_batches(docs, run, docs.schema)

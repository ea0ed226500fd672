"""Compression of vectors to codes: product quantisation in whole numbers, learned on distinct parts.

1. Components become integers floor(SCALE * x); vectors with null or non-finite components go. Each vector is cut into
   PARTS equal consecutive parts.
2. Equal parts of a position become one row with a weight (their number), so a part that a third of all vectors share
   costs one row in every round.
3. Lloyd's rounds run over these rows: tasks find the nearest entry of the codebook by matrix products and send a
   weighted sum and count per entry; their totals, PARTS x ENTRIES rows, make the next codebook. All is exact: products
   are made in floating point only where every sum stays below 2^53, else in unbounded integers.
4. Codes and errors of the distinct parts are joined back to the vectors (crowded parts by broadcast).

The codebook is the only thing that the driver holds or sends out: PARTS x ENTRIES parts, whatever the number of vectors.

Cases: null vectors and those with null or non-finite components have no row in the result; the first codebook is made
of the smallest identifiers, null ones last, and of equal identifiers the vector that is smaller in order; with fewer
vectors than ENTRIES there are fewer entries; repeated rows each have their row; vectors must have the same length,
a multiple of PARTS (else ValueError); components beyond what a long holds after scaling count as the largest long; an
error beyond that is reported as the largest long; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import durable, join_groups, map_batches

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
EXACT = 1 << 53
LONG = (1 << 63) - 1
CHUNK = 4096

Codebooks = list[np.ndarray]


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int = SCALE) -> DataFrame:
    """_row, vec_id, label, ints; vectors that are null or hold null or non-finite components are left out."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    doubles = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    return doubles.filter(F.col("v").isNotNull() & finite).select(F.monotonically_increasing_id().alias("_row"), "vec_id", "label", F.transform("v", lambda x: F.floor(x * scale)).alias("ints"))


def exploded(ints: DataFrame, width: int, parts: int) -> DataFrame:
    """The vectors' parts, a row each: _row, pos, part."""
    cut = F.array(*[F.struct(F.lit(p).alias("pos"), F.slice("ints", p * width + 1, width).alias("part")) for p in range(parts)])
    return ints.select("_row", F.explode(cut).alias("_p")).select("_row", "_p.pos", "_p.part")


def nearest(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the index of the nearest entry (ties to the lower) and the squared distance, exactly."""
    most = max((max(abs(int(x.min())), abs(int(x.max()))) for x in (rows, entries) if x.size), default=0)
    if 4 * most * most * max(1, rows.shape[1]) < EXACT:
        r, e = rows.astype(np.float64), entries.astype(np.float64)
        square = (r * r).sum(axis=1)[:, None] - 2 * (r @ e.T) + (e * e).sum(axis=1)[None, :]
        best = square.argmin(axis=1)
        return best, square[np.arange(len(r)), best].astype(np.int64)
    best, least = np.zeros(len(rows), np.int64), np.zeros(len(rows), object)
    exact = entries.astype(object)
    for i, row in enumerate(rows.astype(object)):
        square = ((exact - row) ** 2).sum(axis=1)
        best[i] = min(range(len(square)), key=square.__getitem__)
        least[i] = square[best[i]]
    return best, least


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray]]:
    """Of every batch and position: the batch, the position, the indexes of its rows and the rows as a matrix; CHUNK rows at most."""
    for batch in batches:
        pos = np.asarray(batch.column("pos"))
        matrix = np.asarray(batch.column("part").flatten(), dtype=np.int64).reshape(len(pos), width)
        for p in np.unique(pos):
            at = np.flatnonzero(pos == p)
            for k in range(0, len(at), CHUNK):
                yield batch, int(p), at[k : k + CHUNK], matrix[at[k : k + CHUNK]]


def _sums(distinct: DataFrame, books: Codebooks) -> DataFrame:
    """pos, entry, n, s0, s1, ...: the weights and weighted sums of the parts nearest to each entry."""
    width = books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], list[int]] = {}
        for batch, p, at, rows in _blocks(batches, width):
            weight = np.asarray(batch.column("weight"))[at]
            best, _ = nearest(rows, books[p])
            safe = rows.size == 0 or max(abs(int(rows.min())), abs(int(rows.max()))) * int(weight.sum()) < EXACT
            scaled = np.column_stack([weight, rows * weight[:, None]]) if safe else np.column_stack([weight.astype(object), rows.astype(object) * weight.astype(object)[:, None]])
            order = np.argsort(best, kind="stable")
            first = np.flatnonzero(np.diff(best[order], prepend=-1))
            for entry, sums in zip(best[order][first], np.add.reduceat(scaled[order], first, axis=0), strict=True):
                had = total.get((p, int(entry)))
                now = [int(x) for x in sums]
                total[p, int(entry)] = now if had is None else [a + b for a, b in zip(had, now, strict=True)]
        keys = list(total)
        columns = [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32())]
        columns += [pa.array([Decimal(total[k][i]) for k in keys], pa.decimal128(38, 0)) for i in range(width + 1)]
        yield pa.RecordBatch.from_arrays(columns, names)

    names = ["pos", "entry", "n", *[f"s{i}" for i in range(width)]]
    sent = map_batches(distinct, run, "pos int, entry int, " + ", ".join(f"{c} decimal(38,0)" for c in names[2:]))
    return sent.groupBy("pos", "entry").agg(*[F.sum(c).alias(c) for c in names[2:]])


def lloyd(distinct: DataFrame, books: Codebooks, rounds: int = ROUNDS) -> Codebooks:
    """The codebooks after some rounds over weighted distinct parts; entries that no part is nearest to stay."""
    for _ in range(rounds):
        books = [b.copy() for b in books]
        for row in _sums(distinct, books).collect():  # one row per entry at most
            books[row["pos"]][row["entry"]] = [int(x) // int(row["n"]) for x in row[3:]]
    return books


def assigned(distinct: DataFrame, books: Codebooks) -> DataFrame:
    """pos, part, entry, error of distinct parts."""
    width = books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, p, at, rows in _blocks(batches, width):
            best, square = nearest(rows, books[p])
            part = pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * width, rows.ravel())
            error = pa.array([min(int(x), LONG) for x in square], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), p), pa.int32()), part, pa.array(best, pa.int32()), error], ["pos", "part", "entry", "error"])

    return map_batches(distinct.select("pos", "part"), run, "pos int, part array<bigint>, entry int, error bigint")


def digest(books: Codebooks) -> str:
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()


def _capped(total: Column) -> Column:
    return F.least(total, F.lit(Decimal(LONG))).cast("long")


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256; one row per vector that is kept."""
    if not 1 <= entries <= 256:
        raise ValueError("a code of two hexadecimal digits names 1 to 256 entries")
    ints = durable(whole_vectors(vectors, id_col, vector_col, label_col, scale), "vector-ints")
    sizes = ints.agg(F.count("*").alias("n"), F.min(F.size("ints")).alias("least"), F.max(F.size("ints")).alias("most")).first()
    if sizes["least"] != sizes["most"] or (sizes["most"] or 0) % parts:
        raise ValueError(f"vectors have {sizes['least']} to {sizes['most']} components; they must have the same number, a multiple of {parts}")
    width = (sizes["most"] or 0) // parts
    smallest = ints.orderBy(F.col("vec_id").asc_nulls_last(), "ints").select("ints").limit(entries).collect()
    first = np.array([r[0] for r in smallest], dtype=np.int64).reshape(len(smallest), parts, width)
    books = [first[:, p, :] for p in range(parts)]
    rows = exploded(ints, width, parts)
    distinct = durable(rows.groupBy("pos", "part").agg(F.count("*").alias("weight")), "vector-parts")
    if sizes["n"]:
        books = lloyd(distinct, books, rounds)
    # crowded parts are broadcast, the others merged; codes are made where they are needed, so parts are not written twice
    least = parts * sizes["n"] / 1000
    crowded, others = distinct.filter(F.col("weight") > least), distinct.filter(F.col("weight") <= least)
    hot = F.broadcast(assigned(crowded, books))
    coded = rows.join(hot, ["pos", "part"], "left")
    done = coded.filter(F.col("entry").isNotNull()).select("_row", "pos", "entry", "error")
    rest = coded.filter(F.col("entry").isNull()).select("_row", "pos", "part").join(assigned(others, books).hint("merge"), ["pos", "part"]).select("_row", "pos", "entry", "error")
    hexed = [F.lpad(F.lower(F.hex(F.max(F.when(F.col("pos") == p, F.col("entry"))))), 2, "0") for p in range(parts)]
    codes = done.unionByName(rest).groupBy("_row").agg(F.concat(*hexed).alias("code"), F.sum(F.col("error").cast("decimal(38,0)")).alias("_error"))
    scored = durable(ints.select("_row", "vec_id", F.struct("label").alias("_label")).join(codes.hint("merge"), "_row").drop("_row"), "vector-codes")
    labels = durable(scored.groupBy("_label").agg(F.sum("_error").alias("_total"), F.count("*").alias("_size")), "vector-labels")
    met = join_groups(scored, labels, ["_label"], "_size")
    return met.select("vec_id", "code", _capped(F.col("_error")).alias("error"), _capped(F.col("_total")).alias("label_error"), F.lit(digest(books)).alias("codebooks_sha256"))

"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0..N-1 in the order of the given keys (ties: rows equal in every key are interchangeable).
A generalised Feistel network permutes Z_a x Z_b with a*b >= N, a = ceil(sqrt(N)), b = ceil(N/a); images at or
beyond N are walked on along their cycle until they fall below N. The image p of a row gives shard p mod n and
slot p div n, so shard counts differ by one at most and slots have no gaps; from (seed, N) alone anyone can
compute where row i went. Only DataFrame functions run: no Python on the executors.

Cases: a null text has size 16 and the CRC of the empty text; null keys sort first; rows repeated in full each
get a place of their own; an empty table gives an empty result; other columns are not read, so their names
cannot clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.llm.common import durable, partitions

MASK = (1 << 31) - 1
ROUNDS = 6
#: Odd multipliers below 2**31 of the round function.
MULTIPLY = 1640531527, 1103515245
OVERHEAD_BYTES = 16


def round_keys(seed: int) -> list[int]:
    """One key below 2**31 for each round, by a linear congruential step from the seed."""
    keys, state = [], seed & MASK
    for _ in range(ROUNDS):
        state = (state * MULTIPLY[1] + 12345) & MASK
        keys.append(state)
    return keys


def domain(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def mix(value: int, key: int) -> int:
    t = ((value & MASK) * MULTIPLY[0] + key) & MASK
    t ^= t >> 15
    t = (t * MULTIPLY[1]) & MASK
    return t ^ (t >> 13)


def permute(x: int, a: int, b: int, keys: list[int]) -> int:
    """One pass of the network over Z_a x Z_b, in plain integers."""
    left, right = divmod(x, b)
    for i, key in enumerate(keys):
        if i % 2:
            right = (right + mix(left, key)) % b
        else:
            left = (left + mix(right, key)) % a
    return left * b + right


def place(row: int, n: int, seed: int) -> int:
    """Where row goes among n rows: what the DataFrame form computes, for one row."""
    a, b = domain(n)
    keys = round_keys(seed)
    x = permute(row, a, b, keys)
    while x >= n:
        x = permute(x, a, b, keys)
    return x


def longest_walk(n: int, seed: int) -> int:
    """The most steps that any row can need beyond the first: the longest run of the a*b - n < sqrt(n) + 1 images
    outside 0..n-1 that follow each other. It is a bound for all rows, from integers alone."""
    a, b = domain(n)
    keys = round_keys(seed)
    onward = {x: permute(x, a, b, keys) for x in range(n, a * b)}
    heads = set(onward) - set(onward.values())
    longest = 0
    for x in heads:
        steps = 0
        while x in onward:
            x, steps = onward[x], steps + 1
        longest = max(longest, steps)
    return longest


def _mix(value: Column, key: int) -> list[Column]:
    """The round function in stages, each to become a column of its own."""
    return [
        lambda _: (value.bitwiseAND(F.lit(MASK)) * F.lit(MULTIPLY[0]) + F.lit(key)).bitwiseAND(F.lit(MASK)),
        lambda t: t.bitwiseXOR(F.shiftright(t, 15)),
        lambda t: (t * F.lit(MULTIPLY[1])).bitwiseAND(F.lit(MASK)),
        lambda t: t.bitwiseXOR(F.shiftright(t, 13)),
    ]


def _permuted(df: DataFrame, source: str, target: str, a: int, b: int, keys: list[int]) -> DataFrame:
    """target = permute(source), as a chain of integer projections inside one code-generated stage."""
    df = df.withColumns({"_l": F.expr(f"{source} div {b}L"), "_r": F.col(source) % F.lit(b)})
    for i, key in enumerate(keys):
        own, other, size = ("_r", "_l", b) if i % 2 else ("_l", "_r", a)
        for step in _mix(F.col(other), key):
            df = df.withColumn("_t", step(F.col("_t") if "_t" in df.columns else None))
        df = df.withColumn(own, (F.col(own) + F.col("_t")) % F.lit(size)).drop("_t")
    return df.withColumn(target, F.col("_l") * F.lit(b) + F.col("_r")).drop("_l", "_r")


def number_rows(df: DataFrame, keys: list[str], name: str = "row") -> tuple[DataFrame, int]:
    """Global row numbers in the order of keys, with the row count, without a single-partition window.

    One range shuffle of the given (narrow) columns, written durably once: range bounds come from a sample, so a
    second evaluation could differ. Offsets are a sum over one row per partition.
    """
    spark = df.sparkSession
    ranged = (
        df.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(partitions(spark), *keys, "_tie")
        .sortWithinPartitions(*keys, "_tie")
        .drop("_tie")
        .withColumn("_at", F.monotonically_increasing_id())
    )
    saved = durable(ranged, "rows").withColumns({"_part": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    counts = saved.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # one row per range partition: bounded by spark.sql.shuffle.partitions, whatever the input
    numbered = saved.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_before", "_at")
    return numbered, saved.count()


def feistel_places(df: DataFrame, keys: list[str], seed: int, row: str = "_row", place_col: str = "place") -> DataFrame:
    """df with the place of each row in the seeded shuffle of all rows."""
    numbered, n = number_rows(df, keys, row)
    a, b = domain(n)
    secret = round_keys(seed)
    out = _permuted(numbered, row, place_col, a, b, secret)
    for _ in range(longest_walk(n, seed)):
        out = _permuted(out, place_col, "_walk", a, b, secret)
        out = out.withColumn(place_col, F.when(F.col(place_col) >= n, F.col("_walk")).otherwise(F.col(place_col))).drop("_walk")
    return out.drop(row)


def shard(docs: DataFrame, shards: int, seed: int = 20240229, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null: the law is not 'key'), place."""
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    narrow = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(data) + F.lit(OVERHEAD_BYTES)).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), F.xxhash64(data).alias("_hash"))
    placed = feistel_places(narrow, ["doc_id", "text_crc32", "size", "_hash"], seed)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        (F.col("place") % shards).cast("int").alias("shard"), F.expr(f"place div {shards}L").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "place",
    )

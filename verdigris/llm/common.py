"""What the corpus operators share: durable intermediate tables, Arrow batching, word splitting."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.sources.shared import shared_dir

#: Rows and bytes in an Arrow batch handed to Python; texts of a corpus can be 100 KB each, or 10 MB.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20


#: Narrow rows in a file of an intermediate table.
FILE_ROWS = 50_000


def durable(df: DataFrame, name: str = "stage", rows: int | None = None, deal: bool = False) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    This cuts lineage like checkpoint(), survives lost executors, and keeps column pruning and compression. Files follow the
    tasks that write them. Where a bound of the narrow rows is known, they are written in a file for each FILE_ROWS of
    them, whatever the number of shuffle partitions: every small file costs renames and permissions. With `deal` these
    rows are dealt out anew (a shuffle), where the stage that makes them needs all its tasks for work, not for rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/verdigris/{name}-{uuid.uuid4().hex}"
    if rows is not None:
        files = max(1, -(-rows // FILE_ROWS))
        df = df.repartition(files) if deal else df.coalesce(files)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with small batches, so that long texts do not pile up in a Python worker.

    Spark reads the bounds of batches from the session when the plan runs, so they are lowered there, and never raised.
    """
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(f"spark.sql.execution.arrow.{name}")
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(f"spark.sql.execution.arrow.{name}", str(most))
    return df.mapInArrow(fn, schema)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def id_crc_mod(col: str, mod: int):
    """crc32 of the identifier as decimal text, modulo mod: the split of learning and held-out rows."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % F.lit(mod)


def bounded_sample(df: DataFrame, id_col: str, rows: int) -> DataFrame:
    """At most `rows` identifiers of df, those with the smallest hashes: a documented bound for fitting models.

    Only the identifiers are sorted (a top-k, so each task sends at most `rows` of them). Null identifiers are not drawn.
    """
    return df.select(id_col).filter(F.col(id_col).isNotNull()).distinct().orderBy(F.xxhash64(id_col), id_col).limit(rows)


def join_groups(rows: DataFrame, groups: DataFrame, key: list[str], size: str, share: int = 1000) -> DataFrame:
    """rows with the columns of their group, if they have one; `size` counts the rows of a group.

    Groups with more than 1/share of all rows are fewer than `share`, so they are broadcast; the others go through a
    shuffled join in which no key holds more than that share. rows and groups are to be durable: they are read twice.
    What grows with the corpus is merged, not broadcast, at every size, so plans do not change as tables grow.
    """
    least = rows.count() / share
    hot = groups.filter(F.col(size) > F.lit(least))
    done = rows.join(F.broadcast(hot), key)
    cold = rows.join(F.broadcast(hot.select(*key)), key, "left_anti").join(groups.filter(F.col(size) <= F.lit(least)).hint("merge"), key)
    return done.unionByName(cold)


def flagged(rows: DataFrame, wanted: DataFrame, key: str, most_bits: int = 1 << 24) -> DataFrame:
    """rows with `_maybe`: whether their key may be among the wanted ones, by a bitmap of hashes.

    The bitmap is broadcast as words of 64 bits: most_bits / 64 of them at most (262,144), whatever the input. With more
    wanted keys than it can tell apart it flags more rows; a join after it decides. wanted is to be durable.
    """
    bits = min(most_bits, 1 << max(10, (16 * wanted.count()).bit_length()))
    word, place = f"pmod(xxhash64(`{key}`), {bits}L) div 64", f"CAST(pmod(xxhash64(`{key}`), {bits}L) % 64 AS INT)"
    words = wanted.select(F.expr(word).alias("_word"), F.expr(f"shiftleft(1L, {place})").alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    marked = rows.withColumns({"_word": F.expr(word), "_at": F.expr(place)}).join(F.broadcast(words), "_word", "left")
    return marked.withColumn("_maybe", F.expr("coalesce((_bits >> _at) & 1L = 1L, false)")).drop("_word", "_bits", "_at")


def likely(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows whose key may be among the wanted ones: most others never reach the shuffle of a join."""
    return flagged(rows, wanted, key).filter("_maybe").drop("_maybe")


def without(rows: DataFrame, dropped: DataFrame, key: str) -> DataFrame:
    """The rows whose key is not among the dropped ones; only rows that may be are shuffled. Both are to be durable."""
    marked = flagged(rows, dropped, key)
    clear = marked.filter("NOT _maybe").drop("_maybe")
    return clear.unionByName(marked.filter("_maybe").drop("_maybe").join(dropped.select(key).hint("merge"), key, "left_anti"))

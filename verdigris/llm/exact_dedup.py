"""Exact deduplication by a tree merge of sorted digest runs.

Every input partition makes a run of (digest, smallest identifier, count). In round k the runs of up to FAN_IN
neighbouring groups of partitions meet: rows are exchanged by (digest, group), sorted by digest, and merged, each
merge keeping the smallest identifier and the summed count; after ceil(log_FAN_IN(partitions)) rounds one run
spread over the cluster is left. A digest thus meets at most FAN_IN rows in any round, however many copies it has.
A row counts as a copy only if SHA-256, byte length and a second, independent 64-bit hash of the normalised text
all agree (the verification at every level: they are the merge key).

The result goes back to the rows in two ways: groups with more than 1/HOT_SHARE of all rows (there can be fewer
than HOT_SHARE of them) by broadcast, all other groups by a shuffled join on the digest, where no key holds more
than that share. Only DataFrame functions run.

Cases: null text counts as empty and so equals ''; null identifiers sort after all others; among rows with equal
identifier and text the first read stays; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import durable, join_groups, without

FAN_IN = 8
HOT_SHARE = 1000
KEY = ["_sha", "_len", "_xx"]
SPACE_RUN = r"[\x20\x09-\x0D]+"


def normalised(text_col: str):
    return F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE_RUN, " ")


def digests(docs: DataFrame, id_col: str, text_col: str, *others: str) -> DataFrame:
    """One narrow row per document: doc_id, verified key, partition and row identity; and the other columns asked for."""
    text = docs.select(F.col(id_col).alias("doc_id"), normalised(text_col).alias("_text"), *others)
    return text.select("doc_id", *others, F.unhex(F.sha2("_text", 256)).alias("_sha"), F.octet_length("_text").alias("_len"), F.xxhash64("_text").alias("_xx"), F.monotonically_increasing_id().alias("_rid"))


def merge_runs(rows: DataFrame) -> DataFrame:
    """KEY, _keep (struct: whether the identifier is null, identifier, row), group_size, by rounds of merging."""
    part = F.shiftright("_rid", 33)
    runs = rows.select(*KEY, part.alias("_group"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("_rid").alias("rid")).alias("_keep"), F.lit(1).cast("long").alias("group_size"))
    last = rows.agg(F.max(part)).first()[0] or 0
    rounds = max(1, math.ceil(math.log(last + 1, FAN_IN))) if last else 1
    for _ in range(rounds):
        runs = runs.withColumn("_group", F.expr(f"_group div {FAN_IN}L"))
        # min over a struct makes Spark exchange, sort by the key and merge (SortAggregate), with map-side merging first
        runs = runs.groupBy(*KEY, "_group").agg(F.min("_keep").alias("_keep"), F.sum("group_size").alias("group_size"))
    return runs.drop("_group")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256; one row per input row."""
    rows = durable(digests(docs, id_col, text_col), "digests")
    total = rows.count()
    groups = durable(merge_runs(rows), "runs", total)
    least = total / HOT_SHARE
    hot = F.broadcast(groups.filter(F.col("group_size") > F.lit(least)).withColumn("_hot", F.lit(True)))
    joined = rows.join(hot, KEY, "left")
    done = joined.filter("_hot").drop("_hot")
    cold = joined.filter(F.col("_hot").isNull()).select(*rows.columns).join(groups.filter(F.col("group_size") <= F.lit(least)), KEY)
    return done.unionByName(cold).select(
        "doc_id", F.col("_keep.doc_id").alias("keep_id"), "group_size", (F.col("_keep.rid") == F.col("_rid")).alias("kept"), F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with the columns of docs, whatever their names: they ride along as one struct.

    Rows are hashed once and numbered; of those that agree in the key the one with the smallest identifier stays, of
    equal identifiers the first read. Only rows that may be dropped are shuffled.
    """
    own = digests(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")), "doc_id", "text", "_doc")
    rows = durable(own, "digests")
    total = rows.count()
    repeated = durable(merge_runs(rows).filter("group_size > 1"), "repeated", total)
    met = join_groups(rows.select(*KEY, "_rid"), repeated, KEY, "group_size")
    dropped = durable(met.filter(F.col("_rid") != F.col("_keep.rid")).select("_rid"), "dropped", total)
    return without(rows.select("_rid", "_doc"), dropped, "_rid").select(*[F.col("_doc").getField(c).alias(c) for c in docs.columns])

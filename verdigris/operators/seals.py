"""Seals of tables: Merkle digests that tell whether and where a table has changed, and what a resolution's preview must keep.

A row's digest is the SHA-256 of its columns. Digests are dealt to leaves by their first LEAF hexadecimal digits, a leaf's
digest is that of its sorted row digests, and 256 leaves at a time make a node, up to the root. The root does not depend on
partitions or order, equal rows are counted, no task holds more than a leaf, and two tables with different roots are
compared only in the leaves that differ.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdigris.schemas import KEY

if TYPE_CHECKING:
    from verdigris.operators.decisions import Policy

LEAF, FAN = 4, 2


def row_digest(columns: list[str]) -> Column:
    """The SHA-256 of some columns' values, null ones too; names do not count, the order of columns does."""
    return F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(columns)]), {"ignoreNullFields": "false"}), 256)


def _joined(digests: Column) -> Column:
    return F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(digests)), lambda d: d["digest"]), ""), 256)


def merkle_leaves(rows: DataFrame, by: list[str], digest: str) -> DataFrame:
    """by, leaf, leaf_digest, rows: equal digests are counted before they meet."""
    counted = rows.groupBy(*by, F.col(digest).alias("_d")).agg(F.count(F.lit(1)).alias("_n"))
    entry = F.struct(F.col("_d").alias("at"), F.when(F.col("_n") == 1, F.col("_d")).otherwise(F.concat("_d", F.lit("x"), F.col("_n").cast("string"))).alias("digest"))
    return counted.groupBy(*by, F.left("_d", F.lit(LEAF)).alias("leaf")).agg(_joined(entry).alias("leaf_digest"), F.sum("_n").alias("rows"))


def merkle_roots(leaves: DataFrame, by: list[str]) -> DataFrame:
    """by, root, rows from leaves."""
    level = leaves.select(*by, F.col("leaf").alias("_at"), F.col("leaf_digest").alias("_digest"), "rows")
    for digits in range(LEAF - FAN, -1, -FAN):
        level = level.groupBy(*by, F.left("_at", F.lit(digits)).alias("_up")).agg(_joined(F.struct(F.col("_at").alias("at"), F.col("_digest").alias("digest"))).alias("_digest"), F.sum("rows").alias("rows")).withColumnRenamed("_up", "_at")
    return level.select(*by, F.col("_digest").alias("root"), "rows")


def seal(df: DataFrame, key: list[str], path: str) -> str:
    """Write a table's seal under a folder: leaves, and each row's key and digest in folders by leaf. Returns the root ('' if empty)."""
    rows = df.select(*key, row_digest(df.columns).alias("digest"))
    placed = rows.withColumns({"leaf": F.left("digest", F.lit(LEAF)), "folder": F.left("digest", F.lit(1))})
    placed.hint("rebalance", "folder").write.mode("overwrite").partitionBy("folder").parquet(f"{path}/rows")
    kept = _sealed_rows(df, key, path)
    merkle_leaves(kept, [], "digest").write.mode("overwrite").parquet(f"{path}/leaves")
    root = merkle_roots(df.sparkSession.read.parquet(f"{path}/leaves"), []).first()
    return root["root"] if root else ""


def _sealed_rows(df: DataFrame, key: list[str], path: str) -> DataFrame:
    schema = df.select(*key, F.lit("").alias("digest"), F.lit("").alias("leaf"), F.lit("").alias("folder")).schema
    return df.sparkSession.read.schema(schema).parquet(f"{path}/rows")


def tampering(df: DataFrame, key: list[str], path: str) -> DataFrame:
    """key, fault: rows that are changed, lost or added since a table was sealed; empty if it is as it was.

    Only rows in leaves that differ are looked at again; of these a key that is on both sides with other rows is changed.
    """
    spark: SparkSession = df.sparkSession
    rows = df.select(*key, row_digest(df.columns).alias("digest"))
    now = merkle_leaves(rows, [], "digest")
    was = spark.read.parquet(f"{path}/leaves").withColumnsRenamed({"leaf_digest": "old_digest", "rows": "old_rows"})
    odd = now.join(was, "leaf", "full_outer").filter(~F.col("leaf_digest").eqNullSafe(F.col("old_digest"))).select("leaf").persist()
    before = _sealed_rows(df, key, path).join(odd, "leaf", "left_semi").select(*key, "digest", F.lit(-1).alias("_s"))
    after = rows.withColumn("leaf", F.left("digest", F.lit(LEAF))).join(odd, "leaf", "left_semi").select(*key, "digest", F.lit(1).alias("_s"))
    sides = before.unionByName(after).groupBy(*key, "digest").agg(F.sum("_s").alias("_s")).filter("_s <> 0")
    told = sides.groupBy(*key).agg(F.bool_or(F.expr("_s < 0")).alias("gone"), F.bool_or(F.expr("_s > 0")).alias("come"))
    return told.select(*key, F.when(F.col("gone") & F.col("come"), "changed").when(F.col("gone"), "lost").otherwise("added").alias("fault"))


SIGNATURE = ["value", "source_file", "source_page", "evidence_text", "confidence"]


def preview_faults(candidates: DataFrame, decisions: DataFrame, confirmed: DataFrame, unresolved: DataFrame, policy: Policy) -> DataFrame:
    """company_code, report_year, indicator_code, fault: the first thing by which a resolution's preview does not close over its candidates.

    decisions name a decision, a policy version, a candidate count and a selected value; confirmed has a status and marked
    evidence; unresolved rows must be the candidates of undecided groups, row for row. A preview without rows here may be frozen.
    """
    tags = {"n": candidates, "d": decisions, "c": confirmed, "u": unresolved}
    counts = None
    for tag, df in tags.items():
        part = df.groupBy(*KEY).agg(F.count(F.lit(1)).alias(tag))
        counts = part if counts is None else counts.join(part, KEY, "full_outer")
    decision = decisions.groupBy(*KEY).agg(F.max("decision").alias("decision"), F.max("policy_version").alias("policy_version"), F.max("candidate_count").alias("candidate_count"), F.max("selected_value").alias("selected_value"))
    one = confirmed.groupBy(*KEY).agg(F.max("status").alias("status"), F.max("evidence_text").alias("evidence_text"), F.max("value").alias("confirmed_value"))
    offered = candidates.join(confirmed.select(*KEY, F.col("value").alias("_v")).distinct(), KEY).filter("value = _v").select(*KEY).distinct().withColumn("offered", F.lit(True))
    # rows of a group are the same on both sides if each signature occurs equally often
    sides = candidates.select(*KEY, *SIGNATURE, F.lit(1).alias("_s")).unionByName(unresolved.select(*KEY, *SIGNATURE, F.lit(-1).alias("_s")))
    drift = sides.groupBy(*KEY, row_digest(SIGNATURE).alias("_d")).agg(F.sum("_s").alias("_s")).filter("_s <> 0").select(*KEY).distinct().withColumn("drifted", F.lit(True))
    rows = counts.join(decision, KEY, "left").join(one, KEY, "left").join(offered, KEY, "left").join(drift, KEY, "left")
    c, u = F.coalesce("c", F.lit(0)), F.coalesce("u", F.lit(0))
    auto = F.col("decision") == "auto_confirmed"
    marker = F.lit(f"[auto-confirm:{policy.version}]")
    fault = (
        F.when(F.col("n").isNull() & F.col("d").isNotNull(), "unknown_decision").when(F.col("n").isNull(), "unknown_group").when(F.col("d").isNull(), "missing_decision").when(F.col("d") > 1, "repeated_decision")
        .when((c > 0) & (u > 0), "confirmed_and_unresolved").when(F.col("policy_version") != policy.version, "other_policy").when(F.col("candidate_count") != F.col("n"), "count_differs")
        .when(auto & (c != 1), "not_closed").when(auto & (F.col("status") != "confirmed"), "status_not_confirmed").when(auto & ~F.coalesce(F.contains("evidence_text", marker), F.lit(False)), "marker_missing")
        .when(auto & ~F.coalesce(F.abs(F.col("confirmed_value") - F.col("selected_value")) < 1e-9, F.lit(False)), "value_differs").when(auto & F.col("offered").isNull(), "value_not_among_candidates")
        .when(~auto & (c > 0), "confirmed_without_decision").when(~auto & F.coalesce("drifted", F.lit(False)), "candidates_drifted")
    )
    return rows.select(*KEY, fault.alias("fault")).filter("fault IS NOT NULL")


def manual_candidates(candidates: DataFrame, tiers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The candidates that the tiers send to people, and the faults of the tiers: keys repeated, on one side only, or with another count."""
    known = tiers.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_t"), F.max("candidate_count").alias("_m"), F.max("tier").alias("tier"))
    groups = candidates.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n"))
    fault = F.when(F.col("_t") > 1, "repeated_tier").when(F.col("_n").isNull(), "unknown_key").when(F.col("_t").isNull(), "missing_tier").when(F.col("_n") != F.col("_m"), "count_differs")
    faults = groups.join(known, KEY, "full_outer").select(*KEY, fault.alias("fault")).filter("fault IS NOT NULL")
    manual = known.filter("tier <> 'auto_policy_eligible'").select(*KEY)
    return candidates.join(manual, KEY, "left_semi").join(faults.select(*KEY), KEY, "left_anti"), faults


# Packets: work handed out, decided and taken back.


def prepare(items: DataFrame, key: str, size: int, salt: str = "") -> DataFrame:
    """items with packet (a number), place in it and digest of the row; packets of about `size` items, by a hash of the key.

    The same items give the same packets whatever their order; a new item joins one packet and moves no other.
    """
    n = items.count()
    packets = max(1, -(-n // size))
    packet = F.pmod(F.xxhash64(F.concat(F.col(f"`{key}`").cast("string"), F.lit(salt))), F.lit(packets)).cast("long")
    digest = row_digest(items.columns)
    numbered = items.withColumns({"packet": packet, "item_digest": digest})
    return numbered.withColumn("place", F.row_number().over(Window.partitionBy("packet").orderBy(F.col(f"`{key}`"))))


def packet_heads(packets: DataFrame) -> DataFrame:
    """packet, items, seal: what a packet was when it was handed out."""
    roots = merkle_roots(merkle_leaves(packets, ["packet"], "item_digest"), ["packet"])
    return roots.select("packet", F.col("rows").alias("items"), F.col("root").alias("seal"))


ACTIONS = ("accept", "reject", "defer")


def evaluate(packets: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """Each decision with its outcome, in the order of its number: applied, repeated, or a fault.

    decisions: decision_id, number, packet, key, action, item_digest (of the item that was seen) and reviewer. A decision that
    comes again is repeated; a second one on an item that is settled is too_late; one on an item that has changed since it
    was handed out is stale. A deferred item may be decided later.
    """
    once = decisions.groupBy("decision_id").agg(F.min_by(F.struct("number", "packet", key, "action", "item_digest", "reviewer"), "number").alias("d"), F.count(F.lit(1)).alias("came")).select("decision_id", "came", "d.*")
    held = packets.select(F.col(key), F.col("packet").alias("_packet"), F.col("item_digest").alias("_digest"))
    both = once.join(held, key, "left")
    fault = (
        F.when(F.col("_packet").isNull(), "unknown_item").when(F.col("packet") != F.col("_packet"), "other_packet").when(~F.col("action").isin(*ACTIONS), "unknown_action")
        .when(F.trim(F.coalesce("reviewer", F.lit(""))) == "", "reviewer_missing").when(~F.col("item_digest").eqNullSafe(F.col("_digest")), "stale")
    )
    own = Window.partitionBy("packet", key).orderBy("number", "decision_id").rowsBetween(Window.unboundedPreceding, -1)
    sound = both.withColumn("fault", fault)
    settled = F.coalesce(F.max(F.col("fault").isNull() & F.col("action").isin("accept", "reject")).over(own), F.lit(False))
    outcome = F.coalesce("fault", F.when(settled, "too_late").otherwise("applied"))
    return sound.withColumn("outcome", outcome).select("decision_id", "number", "packet", key, "action", "reviewer", "outcome", (F.col("came") - 1).alias("repeats"))


def apply_decisions(packets: DataFrame, outcomes: DataFrame, key: str) -> DataFrame:
    """packets with state: open, deferred, accepted or rejected, by the last applied decision of each item."""
    last = outcomes.filter("outcome = 'applied'").groupBy("packet", key).agg(F.max_by("action", "number").alias("action"))
    state = F.when(F.col("action") == "accept", "accepted").when(F.col("action") == "reject", "rejected").when(F.col("action") == "defer", "deferred").otherwise("open")
    return packets.join(last, ["packet", key], "left").withColumn("state", state).drop("action")


def packet_states(packets: DataFrame, outcomes: DataFrame, key: str) -> DataFrame:
    """packet, items, settled, state (prepared, in_review, closed) and chain: a hash chain over its applied decisions.

    Each link is the SHA-256 of the link before and the decision, from the packet's seal on: a decision that is altered, lost
    or put elsewhere breaks every later link. A packet has few items, so its decisions are folded in one row.
    """
    applied = outcomes.filter("outcome = 'applied'").select("packet", F.struct("number", "decision_id", F.col(key).cast("string").alias("k"), "action", "reviewer").alias("e"))
    events = applied.groupBy("packet").agg(F.sort_array(F.collect_list("e")).alias("events"))
    done = apply_decisions(packets, outcomes, key).groupBy("packet").agg(F.count_if(F.col("state").isin("accepted", "rejected")).alias("settled"))
    heads = packet_heads(packets).join(done, "packet").join(events, "packet", "left")
    link = F.aggregate(F.coalesce("events", F.expr("CAST(array() AS array<struct<number:bigint,decision_id:string,k:string,action:string,reviewer:string>>)")), F.col("seal"), lambda acc, e: F.sha2(F.concat_ws("|", acc, e["decision_id"], e["k"], e["action"], e["reviewer"]), 256))
    state = F.when(F.col("settled") == F.col("items"), "closed").when(F.col("events").isNull(), "prepared").otherwise("in_review")
    return heads.select("packet", "items", "settled", state.alias("state"), link.alias("chain"))

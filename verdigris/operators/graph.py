"""The evidence graph as tables: nodes, edges and constraints, and what a change touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def node_id(kind: str, *key: Column) -> Column:
    """kind:digest of kind and key, as short as 24 hex digits."""
    text = F.concat_ws("|", *[k.cast("string") for k in key])
    return F.concat(F.lit(f"{kind}:"), F.substring(F.sha2(F.concat(F.lit(kind), F.lit("\x00"), text), 256), 1, 24))


def _keys() -> dict[str, tuple]:
    c = F.col
    return {
        "company": (c("company_code"),), "report_year": (c("report_year"),), "indicator": (c("indicator_code"),), "document": (c("source_file"),), "page": (c("source_file"), c("source_page")),
        "candidate_group": (c("company_code"), c("report_year"), c("indicator_code")), "candidate": (c("company_code"), c("report_year"), c("indicator_code"), c("source_file"), c("source_page"), c("value")),
    }


RELATIONS = (("candidate", "observed_for", "company"), ("candidate", "measures", "indicator"), ("candidate", "for_period", "report_year"), ("candidate", "sourced_from", "page"), ("page", "part_of", "document"), ("candidate", "member_of", "candidate_group"))


def nodes(cands: DataFrame) -> DataFrame:
    """(id, kind, natural_key): all kinds from one pass, distinct after one shuffle."""
    every = F.array(*[F.struct(node_id(kind, *key).alias("id"), F.lit(kind).alias("kind"), F.concat_ws("|", *[k.cast("string") for k in key]).alias("natural_key")) for kind, key in _keys().items()])
    return cands.select(F.inline(every)).distinct()


def edges(cands: DataFrame) -> DataFrame:
    keys = _keys()
    every = F.array(*[F.struct(node_id(a, *keys[a]).alias("source"), F.lit(r).alias("relation"), node_id(b, *keys[b]).alias("target")) for a, r, b in RELATIONS])
    return cands.select(F.inline(every)).distinct()


def constraints(cands: DataFrame, indicators: DataFrame) -> DataFrame:
    """(scope, target_id, constraint, passed) of candidates and of their groups."""
    keys = _keys()
    known = cands.join(F.broadcast(indicators.select(F.col("code").alias("indicator_code"), F.lit(True).alias("_known"))), "indicator_code", "left")
    own = F.array(*[F.struct(F.lit("candidate").alias("scope"), node_id("candidate", *keys["candidate"]).alias("target_id"), F.lit(n).alias("constraint"), c.alias("passed")) for n, c in {
        "known_indicator": F.coalesce("_known", F.lit(False)), "has_source": F.coalesce("source_file", F.lit("")) != "", "page_positive": F.coalesce(F.col("source_page") > 0, F.lit(False)), "confidence_in_range": F.coalesce(F.col("confidence").between(0, 1), F.lit(False)),
    }.items()])
    groups = cands.groupBy("company_code", "report_year", "indicator_code").agg(F.count_distinct("value").alias("n"))
    one = groups.select(F.lit("candidate_group").alias("scope"), node_id("candidate_group", *keys["candidate_group"]).alias("target_id"), F.lit("single_value").alias("constraint"), (F.col("n") == 1).alias("passed"))
    return known.select(F.inline(own)).distinct().unionByName(one)


def summary(node_table: DataFrame, edge_table: DataFrame, constraint_table: DataFrame) -> DataFrame:
    count = lambda df, what, name: df.groupBy(F.lit(what).alias("part"), F.col(name).cast("string").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return count(node_table, "node", "kind").unionByName(count(edge_table, "edge", "relation")).unionByName(count(constraint_table.filter("NOT passed"), "failed", "constraint"))


def recompute_plan(cands: DataFrame, changed: DataFrame) -> DataFrame:
    """What changed documents touch: candidates to read again, their companies and indicators, companies to rescore.

    A company is rescored if it has a candidate of an affected indicator and year: that population has moved.
    """
    # a chain of semi-joins on keys; the affected (indicator, year) pairs are a small set of the methodology
    again = cands.join(changed.select("source_file").distinct(), "source_file", "left_semi")
    moved = again.select("indicator_code", "report_year").distinct()
    touched = cands.join(F.broadcast(moved), ["indicator_code", "report_year"], "left_semi").select("company_code", "report_year").distinct()
    one = lambda df, n: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("part"), "n")
    return one(again, "candidates_to_read").unionByName(one(again.select("company_code").distinct(), "companies_changed")).unionByName(one(moved, "indicators_moved")).unionByName(one(touched, "companies_to_rescore")).unionByName(one(cands, "candidates"))

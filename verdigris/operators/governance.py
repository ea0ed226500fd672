"""Methodology checks, benchmark intake, document indexes, continuity of issuers, disclosure scans and stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.functions.numeric import ratio, rounded
from verdigris.schemas import KEY

DIMENSION_TOTALS = {"E": 45.0, "S": 20.0, "G": 35.0}


def alignment(indicators: DataFrame, totals: dict[str, float] | None = None, tolerance: float = 0.01) -> DataFrame:
    """Weights by kind and dimension against the standard's totals."""
    wanted = F.lit(None).cast("double")
    for d, t in (totals or DIMENSION_TOTALS).items():
        wanted = F.when(F.col("dimension") == d, t).otherwise(wanted)
    sums = indicators.groupBy("kind", "dimension").agg(rounded(F.sum("weight"), 4).alias("weight"), F.count(F.lit(1)).alias("indicators"))
    return sums.withColumns({"wanted": wanted, "aligned": F.abs(F.col("weight") - wanted) <= tolerance})


def inject_benchmarks(indicators: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """Indicators with the benchmarks of an intake table; others keep their own."""
    b = F.broadcast(benchmarks.select(F.col("indicator_code").alias("code"), F.col("benchmark").alias("_b")))  # a table of indicators
    return indicators.join(b, "code", "left").withColumn("benchmark", F.coalesce("_b", "benchmark")).drop("_b")


def benchmark_faults(indicators: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """(indicator_code, fault) of an intake: unknown, repeated, without a value, or with another direction or weight."""
    own = indicators.select(F.col("code").alias("indicator_code"), F.col("direction").alias("_d"), F.col("weight").alias("_w"))
    n = benchmarks.groupBy("indicator_code").agg(F.count(F.lit(1)).alias("_n"))
    both = benchmarks.join(F.broadcast(n), "indicator_code").join(F.broadcast(own), "indicator_code", "left")
    fault = F.when(F.col("_d").isNull(), "unknown_indicator").when(F.col("_n") > 1, "repeated").when(F.col("benchmark").isNull(), "no_value").when(F.col("direction") != F.col("_d"), "direction_differs").when(F.abs(F.col("weight") - F.col("_w")) > 1e-6, "weight_differs")
    return both.select("indicator_code", fault.alias("fault")).filter("fault IS NOT NULL").distinct()


def thin_review(population: DataFrame, diagnoses: DataFrame, least: int) -> DataFrame:
    """Indicators below the minimum population with the counts of their gap diagnoses as a map."""
    counts = diagnoses.groupBy("indicator_code", "category").agg(F.count(F.lit(1)).alias("n"))
    maps = counts.groupBy("indicator_code").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "n"))))).alias("diagnostic_category_counts"), F.sum("n").alias("diagnosed_task_count"))
    thin = population.filter(F.col("population_count") < least)
    return thin.join(maps, "indicator_code", "left").select("indicator_code", F.col("population_count").alias("current_population"), F.lit(least).alias("minimum_population_threshold"), (F.lit(least) - F.col("population_count")).alias("population_deficit"), F.coalesce("diagnosed_task_count", F.lit(0)).cast("long").alias("diagnosed_task_count"), F.coalesce("diagnostic_category_counts", F.lit("{}")).alias("diagnostic_category_counts"))


def merge_indexes(indexes: DataFrame, order: str) -> DataFrame:
    """Document indexes merged by source: the first entry stays; later ones of other contents are conflicts."""
    merged = indexes.groupBy("source_url").agg(F.min_by(F.struct("sha256", "size"), order).alias("first"), F.count_distinct("sha256").alias("versions"), F.count(F.lit(1)).alias("entries"))
    return merged.select("source_url", "first.sha256", "first.size", "entries", (F.col("versions") > 1).alias("conflict"))


def supersede(documents: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents that stay, ledger of those superseded): a request must name a document by key and digest."""
    key = ["company_code", "report_year", "document_type"]
    hit = documents.join(requests.select(*key, F.col("sha256").alias("_s"), "reason"), key, "left")
    gone = F.coalesce(F.col("sha256") == F.col("_s"), F.lit(False))
    return hit.filter(~gone).drop("_s", "reason"), hit.filter(gone).drop("_s")


def preferred_documents(documents: DataFrame, kind: str, preference: Column, date: str) -> DataFrame:
    """The document of a kind for each company: smallest preference, then the latest date, then the title."""
    rows = documents.filter(F.col("document_type") == kind)
    rest = [c for c in rows.columns if c != "company_code"]
    order = F.struct(preference.alias("p"), (-F.unix_timestamp(date)).alias("d"), F.col("title").alias("t"))
    return rows.groupBy("company_code").agg(F.min_by(F.struct(*rest), order).alias("r")).select("company_code", "r.*")


def continuity(listed: DataFrame, history: DataFrame) -> DataFrame:
    """Per historical issuer: same code, same name under another code, listed twice, or gone."""
    by_name = listed.groupBy("name_key").agg(F.min("stock_code").alias("code_by_name"), F.count(F.lit(1)).alias("same_name"))
    both = history.join(listed.select("stock_code", F.lit(True).alias("held")), "stock_code", "left").join(by_name, "name_key", "left")
    state = F.when(F.col("held"), "same_issuer").when(F.col("same_name") == 1, "code_changed").when(F.col("same_name") > 1, "listed_twice").otherwise("gone")
    return both.select("stock_code", state.alias("outcome"), F.when(state == "code_changed", F.col("code_by_name")).alias("current_code"))


def embedded_coverage(coverage: DataFrame, scans: DataFrame, least: int) -> DataFrame:
    """Companies whose annual report embeds enough disclosure sections count as covered."""
    found = scans.groupBy("company_code").agg(F.count_if(F.col("hits") > 0).alias("sections"))
    both = coverage.join(found, "company_code", "left")
    up = (F.col("esg_status") == "missing") & (F.coalesce("sections", F.lit(0)) >= least)
    return both.withColumns({"esg_status": F.when(up, "embedded_in_annual").otherwise(F.col("esg_status")), "upgraded": up}).drop("sections")


def keyword_score(text: Column, pattern: str) -> Column:
    """50 plus up to 30 for hits and up to 20 for length, at most 100."""
    return F.least(F.lit(100.0), 50 + F.least(5.0 * F.regexp_count(text, F.lit(pattern)), F.lit(30.0)) + F.least(F.length(text) / 100.0, F.lit(20.0)))


def evidence_method(evidence: Column) -> Column:
    return F.when(evidence.contains("cross-document"), "cross_document").when(evidence.contains("derived"), "formula").when(evidence.contains("table"), "table").otherwise("direct")


def enhanced_quality(obs: DataFrame) -> DataFrame:
    """Per indicator: rows by status, confidence bands and a flag for weak or strong ones."""
    c = F.col("confidence")
    out = obs.groupBy("indicator_code").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("status") == s).alias(s) for s in ("confirmed", "derived", "predicted", "imputed")], F.count_if(c >= 0.8).alias("high_confidence"), F.count_if((c >= 0.6) & (c < 0.8)).alias("medium_confidence"), F.count_if(c < 0.6).alias("low_confidence"), rounded(F.avg("confidence"), 6).alias("mean_confidence"),
    )
    share = F.col("confirmed") / F.col("n")
    return out.withColumn("strength", F.when(share >= 0.7, "strong").when(share < 0.5, "weak").otherwise("medium"))


def candidate_ids(cands: DataFrame, order: list[str]) -> DataFrame:
    """Ids company-Pnnn-k: the k-th candidate of a company's page."""
    w = Window.partitionBy("company_code", "source_page").orderBy(*order)
    return cands.withColumn("candidate_id", F.format_string("%s-P%03d-%d", F.col("company_code"), F.col("source_page"), F.row_number().over(w)))


def rank_bands(df: DataFrame, own: str, other: str) -> DataFrame:
    """Differences of two rankings in bands."""
    d = F.col(own) - F.col(other)
    return df.withColumns({"difference": d, "band": F.when(d.isNull(), "unmatched").when(F.abs(d) <= 5, "same").when(F.abs(d) <= 20, "near").when(d > 0, "lower").otherwise("higher")})


def next_stage(facts: DataFrame, stages: list[tuple[str, Column]]) -> DataFrame:
    """The first stage whose condition does not hold, and how many hold before it."""
    stage, done, open_ = F.lit("finished"), F.lit(0), F.lit(True)
    for name, holds in reversed(stages):
        stage = F.when(~holds, name).otherwise(stage)
    for _, holds in stages:
        open_ = open_ & holds
        done = done + open_.cast("int")
    return facts.withColumns({"stage": stage, "stages_done": done})


def conflicts_by_company(decisions: DataFrame) -> DataFrame:
    """Open and settled decisions of each company, with the share settled."""
    settled = F.count_if(F.col("decision") == "auto_confirmed")
    return decisions.groupBy("company_code").agg(settled.alias("settled"), F.count_if(F.col("decision") != "auto_confirmed").alias("open"), rounded(F.coalesce(ratio(settled, F.count(F.lit(1))), F.lit(0.0)), 6).alias("settled_share"))


def evaluate_sample(sample: DataFrame, answers: DataFrame, ident: str, tolerance: float) -> DataFrame:
    """Per method class: answered rows, right ones and accuracy within a relative tolerance."""
    both = sample.join(answers.select(ident, "actual"), ident)
    right = F.abs(F.col("value") - F.col("actual")) <= F.greatest(F.abs("value"), F.abs("actual"), F.lit(1.0)) * tolerance
    return both.groupBy("method").agg(F.count(F.lit(1)).alias("answered"), F.count_if(right).alias("right"), rounded(F.count_if(right) / F.count(F.lit(1)), 6).alias("accuracy"))


def research_rows(features: DataFrame, tag: str = "[research-only:]", most: float = 0.79) -> DataFrame:
    """Suggested qualitative scores as observations that release checks can tell apart: tagged, below 0.8 in confidence."""
    return features.select(*KEY, F.col("suggested_score").cast("double").alias("value"), F.lit("confirmed").alias("status"), F.concat(F.lit(f"{tag} "), F.col("evidence_text")).alias("evidence_text"), F.least(F.col("confidence"), F.lit(most)).alias("confidence"))


def release_predicates(obs: DataFrame, tag: str = "[research-only:") -> DataFrame:
    """Counts that must be zero in a release: pending rows and rows of research evidence."""
    return obs.agg(F.count_if(F.col("status") == "pending").alias("pending_rows"), F.count_if(F.col("evidence_text").contains(tag)).alias("research_rows"))

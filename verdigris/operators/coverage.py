"""Coverage matrices, audits, gap priorities, batches, completion gates and release validity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.functions.numeric import ratio, rounded
from verdigris.schemas import KEY, STATUSES
from verdigris.sources.shared import staged

BEST_ORDER = ("confirmed", "derived", "predicted", "imputed", "pending", "not_applicable", "missing")
ACTIONS = {"confirmed": "done", "pending": "review", "derived": "verify", "predicted": "collect", "imputed": "collect", "not_applicable": "none", "missing": "collect"}


def _map(values: dict, of: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in values.items():
        out = F.when(of == k, v).otherwise(out)
    return out


def status_rank(of: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, BEST_ORDER)), of)


def indicator_tasks(companies: DataFrame, indicators: DataFrame, obs: DataFrame) -> DataFrame:
    """Every company and indicator with its best observation (status order, then confidence) and the next action."""
    best = obs.groupBy("company_code", "indicator_code").agg(F.min_by(F.struct("status", "value", "confidence"), F.struct(status_rank(F.col("status")), -F.col("confidence"), F.col("value"))).alias("b"))
    # the methodology's indicators: a small fixed table
    grid = companies.crossJoin(F.broadcast(indicators.select(F.col("code").alias("indicator_code"), "dimension", "key_indicator")))
    status = F.coalesce("b.status", F.lit("missing"))
    return grid.join(best, ["company_code", "indicator_code"], "left").select("company_code", "indicator_code", "dimension", "key_indicator", status.alias("status"), F.col("b.confidence").alias("confidence"), _map(ACTIONS, status).alias("next_action"))


def candidate_coverage(tasks: DataFrame, cands: DataFrame) -> DataFrame:
    """Tasks with their candidates' count, pages and confidence: candidate_available or missing_candidate, with a priority."""
    found = cands.groupBy("company_code", "indicator_code").agg(F.count(F.lit(1)).alias("candidate_count"), F.count_distinct("source_page").alias("pages"), F.max("confidence").alias("max_confidence"))
    both = tasks.join(found, ["company_code", "indicator_code"], "left")
    n = F.coalesce("candidate_count", F.lit(0)).cast("long")
    priority = F.when((n == 0) & F.col("key_indicator"), "high").when(n == 0, "medium").otherwise("low")
    return both.select("company_code", "indicator_code", "dimension", "key_indicator", n.alias("candidate_count"), F.coalesce("pages", F.lit(0)).cast("long").alias("pages"), "max_confidence", F.when(n > 0, "candidate_available").otherwise("missing_candidate").alias("status"), priority.alias("priority"))


def coverage_rollup(tasks: DataFrame) -> DataFrame:
    """Done and total by dimension and indicator, with subtotals."""
    return tasks.rollup("dimension", "indicator_code").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "confirmed").alias("done"), F.grouping_id().cast("int").alias("level"))


def company_completion(tasks: DataFrame) -> DataFrame:
    done = F.count_if(F.col("status") == "confirmed")
    return tasks.groupBy("company_code").agg(done.alias("done"), F.count(F.lit(1)).alias("n"), F.when(done == 0, "empty").when(done == F.count(F.lit(1)), "complete").otherwise("partial").alias("state"))


def quality_issues(obs: DataFrame, universe: DataFrame, indicators: DataFrame) -> DataFrame:
    """(issue, severity, n) of the issues that occur: one pass over the rows and one over the keys."""
    rows = obs.join(F.broadcast(indicators.select(F.col("code").alias("indicator_code"), F.lit(True).alias("_known"))), "indicator_code", "left").join(universe.select("company_code", F.lit(True).alias("_in")), "company_code", "left")
    checks = {
        "unknown_indicator": ("error", F.col("_known").isNull()), "company_outside_universe": ("error", F.col("_in").isNull()), "confirmed_without_value": ("error", (F.col("status") == "confirmed") & F.col("value").isNull()),
        "unknown_status": ("error", ~F.col("status").isin(*STATUSES)), "confirmed_without_source": ("warning", (F.col("status") == "confirmed") & (F.coalesce("source_url", F.lit("")) == "")), "low_confidence": ("warning", F.col("confidence") < 0.6),
    }
    counts = rows.agg(*[F.count_if(c).alias(n) for n, (_, c) in checks.items()])
    repeated = obs.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated_key"))
    both = counts.crossJoin(repeated)  # two single rows
    severity = {n: s for n, (s, _) in checks.items()} | {"repeated_key": "error"}
    cells = F.array(*[F.struct(F.lit(n).alias("issue"), F.lit(s).alias("severity"), F.col(n).alias("n")) for n, s in severity.items()])
    return both.select(F.inline(cells)).filter("n > 0")


def document_coverage(companies: DataFrame, documents: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """Per company: documents by type, the years covered, and what to collect next."""
    counts = documents.groupBy("company_code").agg(F.count(F.lit(1)).alias("documents"), *[F.count_if(F.col("document_type") == t).alias(t) for t in types], F.array_join(F.sort_array(F.collect_set(F.col("report_year").cast("string"))), "|").alias("years"))
    both = companies.join(counts, "company_code", "left").fillna(0).fillna("")
    action = F.lit("complete")
    for t in reversed(types):
        action = F.when(F.col(t) == 0, F.concat(F.lit("discover_"), F.lit(t))).otherwise(action)
    return both.withColumn("next_action", action)


def collection_plan(companies: DataFrame, documents: DataFrame, year: int, types: tuple[str, ...]) -> DataFrame:
    """The (company, type) pairs of the year that no document covers."""
    wanted = companies.select("company_code").withColumn("document_type", F.explode(F.array(*map(F.lit, types))))
    have = documents.filter(F.col("report_year") == year).select("company_code", "document_type").distinct()
    return wanted.join(have, ["company_code", "document_type"], "left_anti").withColumn("report_year", F.lit(year))


def boundary_risk(best: Column, worst: Column, top: int) -> Column:
    """1 if the ranks cross the boundary, else falling with the distance to it."""
    away = F.least(F.abs(best - top), F.abs(worst - top))
    return F.when((best <= top) & (worst >= top), F.lit(1.0)).otherwise(1 / (1 + away / 50.0))


def instability_risk(span: Column) -> Column:
    return F.least(span / 100.0, F.lit(1.0))


TIER_RISK = {"manual_signature_required": 1.0, "consistent_multi_review": 0.55, "single_candidate_review": 0.4}


def review_impact(tiers: DataFrame, sensitivity: DataFrame, weights: DataFrame, top: int) -> DataFrame:
    """Impact of each open review on the ranking: conflict, boundary, instability, weight and confidence, weighed."""
    risk = F.lit(0.5)
    for name, value in TIER_RISK.items():
        risk = F.when(F.col("tier") == name, F.lit(value)).otherwise(risk)
    most = weights.agg(F.max("weight").alias("_most"))
    both = tiers.filter("tier <> 'auto_policy_eligible'").join(sensitivity, "company_code").join(F.broadcast(weights.crossJoin(most)), "indicator_code")
    impact = 100 * (0.35 * risk + 0.25 * boundary_risk(F.col("best_rank"), F.col("worst_rank"), top) + 0.20 * instability_risk(F.col("rank_span")) + 0.15 * F.col("weight") / F.col("_most") + 0.05 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("max_confidence"))))
    return both.select(*KEY, "tier", rounded(impact, 6).alias("impact_score"))


def impact_faults(rows: DataFrame, sensitivity: DataFrame, weights: DataFrame) -> DataFrame:
    """Rows that an impact cannot be given: their company has no sensitivity, or their indicator no weight.

    The impact operators leave such rows out; a caller that must not lose any checks that this is empty.
    """
    companies, indicators = sensitivity.select("company_code", F.lit(True).alias("_c")).distinct(), weights.select("indicator_code", F.lit(True).alias("_w")).distinct()
    both = rows.join(companies, "company_code", "left").join(F.broadcast(indicators), "indicator_code", "left")  # indicators of one methodology
    fault = F.when(F.col("_c").isNull(), "no_sensitivity").when(F.col("_w").isNull(), "no_weight")
    return both.withColumn("fault", fault).filter("fault IS NOT NULL").select("company_code", "indicator_code", "fault")


def quantitative_gap_impact(tasks: DataFrame, sensitivity: DataFrame, weights: DataFrame, top: int) -> DataFrame:
    """Impact of each missing candidate: boundary, instability, weight, key indicator and scarcity."""
    population = tasks.filter("status = 'candidate_available'").groupBy("indicator_code").agg(F.count(F.lit(1)).alias("population"))
    facts = weights.join(population, "indicator_code", "left").fillna(0, ["population"])
    most = facts.agg(F.max("weight").alias("_w"), F.max("population").alias("_p"))
    both = tasks.filter("status = 'missing_candidate'").join(sensitivity, "company_code").join(F.broadcast(facts.crossJoin(most)), "indicator_code")
    scarcity = 1 - F.coalesce(ratio(F.col("population"), F.col("_p")), F.lit(0.0))
    impact = 100 * (0.25 * boundary_risk(F.col("best_rank"), F.col("worst_rank"), top) + 0.25 * instability_risk(F.col("rank_span")) + 0.25 * F.col("weight") / F.col("_w") + 0.15 * F.col("key_indicator").cast("double") + 0.10 * scarcity)
    return both.select("company_code", "indicator_code", rounded(impact, 6).alias("impact_score"), "population")


def qualitative_gap_impact(gaps: DataFrame, sensitivity: DataFrame, coverage: DataFrame, top: int) -> DataFrame:
    most = gaps.agg(F.max("indicator_weight").alias("_w"))
    both = gaps.join(sensitivity, "company_code").join(coverage, "company_code").crossJoin(F.broadcast(most))
    missing = ~F.col("esg_status").isin("collected", "embedded_in_annual")
    impact = 100 * (0.35 * boundary_risk(F.col("best_rank"), F.col("worst_rank"), top) + 0.30 * instability_risk(F.col("rank_span")) + 0.25 * F.col("indicator_weight") / F.col("_w") + 0.10 * missing.cast("double"))
    return both.select("company_code", "indicator_code", rounded(impact, 6).alias("impact_score"), missing.alias("missing_esg_document"))


def impact_ranks(impacts: DataFrame, by: tuple[str, ...] = ("company_code", "indicator_code"), score: str = "impact_score") -> DataFrame:
    """impacts with impact_rank: 1, 2, ... over all rows by falling score, then by the keys.

    Rows are dealt out by ranges of that order and numbered where they lie; a row for each range tells how many come before.
    So no task sorts them all.
    """
    order = [F.desc(score), *by]
    number = F.monotonically_increasing_id()  # the range in the upper bits, the place in it in the lower 33
    placed = staged(impacts.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", number), "ranked")
    span = F.shiftright("_at", 33).alias("_span")
    sizes = placed.groupBy(span).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1))).drop("_n")  # one row for each range
    place = F.coalesce("_before", F.lit(0)) + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.withColumn("_span", span).join(F.broadcast(before), "_span").withColumn("impact_rank", place).drop("_span", "_at", "_before")


def company_batch(impacts: DataFrame, companies: int = 25, tasks: int = 10) -> tuple[DataFrame, DataFrame]:
    """(companies of the largest impact, their largest tasks): impact is the maximum plus a tenth of the five largest."""
    w = Window.partitionBy("company_code").orderBy(F.desc("impact_score"), "indicator_code")
    ranked = impacts.withColumn("_i", F.row_number().over(w))
    scores = ranked.groupBy("company_code").agg(
        rounded(F.max("impact_score") + F.sum(F.when(F.col("_i") <= 5, F.col("impact_score")).otherwise(0.0)) / 10, 6).alias("company_impact_score"), F.count(F.lit(1)).alias("gap_count"), F.count_if(F.col("impact_score") >= 75).alias("high_impact_gap_count"),
        F.array_join(F.transform(F.sort_array(F.filter(F.collect_list(F.when(F.col("_i") <= 5, F.struct("_i", "indicator_code"))), lambda x: x.isNotNull())), lambda x: x["indicator_code"]), "|").alias("top_indicator_codes"),
    )
    chosen = scores.orderBy(F.desc("company_impact_score"), "company_code").limit(companies)
    picked = ranked.filter(F.col("_i") <= tasks).join(F.broadcast(chosen.select("company_code")), "company_code")  # `companies` rows
    return chosen, picked.withColumnRenamed("_i", "task_rank")


def thin_batch(tasks: DataFrame, least: int, per_indicator: int = 25) -> DataFrame:
    """For indicators whose population is below `least`: their first missing companies, largest deficits first."""
    population = tasks.groupBy("indicator_code").agg(F.count_if(F.col("status") == "candidate_available").alias("population")).filter(F.col("population") < least)
    missing = tasks.filter("status = 'missing_candidate'").join(F.broadcast(population), "indicator_code")
    w = Window.partitionBy("indicator_code").orderBy("company_code")
    return missing.withColumn("task_rank", F.row_number().over(w)).filter(F.col("task_rank") <= per_indicator).select("indicator_code", "company_code", "task_rank", "population", (F.lit(least) - F.col("population")).alias("population_deficit"))


def confusion(df: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    """Counts, precision, recall and F1 (0 where undefined) in one row."""
    tp, fp, fn = F.count_if(truth & predicted), F.count_if(~truth & predicted), F.count_if(truth & ~predicted)
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    out = df.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), F.count_if(~truth & ~predicted).alias("tn"))
    p, r = zero(ratio(F.col("tp"), F.col("tp") + F.col("fp"))), zero(ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumns({"precision": rounded(p, 6), "recall": rounded(r, 6), "f1": rounded(zero(ratio(2 * p * r, p + r)), 6)})


def accuracy(df: DataFrame, predicted: str, actual: str, tolerance: float) -> DataFrame:
    """Share of values within a relative tolerance."""
    fits = F.abs(F.col(predicted) - F.col(actual)) <= F.greatest(F.abs(predicted), F.abs(actual), F.lit(1.0)) * tolerance
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(fits).alias("correct"), rounded(F.coalesce(ratio(F.count_if(fits), F.count(F.lit(1))), F.lit(0.0)), 6).alias("accuracy"))


def stratified_sample(df: DataFrame, stratum: str, ident: list[str], k: int) -> DataFrame:
    """The k rows of each stratum whose identities have the smallest digests."""
    digest = F.sha2(F.concat_ws("\x1f", *[F.col(c).cast("string") for c in ident]), 256)
    w = Window.partitionBy(stratum).orderBy("sample_id")
    return df.withColumn("sample_id", digest).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def completion_gates(facts: DataFrame) -> DataFrame:
    """Six gates of one row of facts: how many hold, whether all do, and the first that does not."""
    gates = {
        "universe": F.col("universe_publishable"), "documents": F.col("missing_documents") == 0,
        "quantitative": F.col("quantitative_exhaustive") | ((F.col("zero_coverage") == 0) & (F.col("minimum_population") >= 20) & (F.col("sampling_accuracy") >= 0.95)),
        "qualitative": F.col("qualitative_exhaustive") | (F.col("risk_flags") >= 4), "review": (F.col("manual_groups") == 0) & (F.col("qualitative_exhaustive") | (F.col("risk_flags") >= 4)), "release": F.col("freeze_ready") & F.col("release_applicable"),
    }
    done = sum((F.coalesce(g, F.lit(False)).cast("int") for g in gates.values()), F.lit(0))
    following = F.lit(None).cast("string")
    for name in reversed(gates):
        following = F.when(~F.coalesce(gates[name], F.lit(False)), name).otherwise(following)
    return facts.withColumns({**{f"gate_{n}": F.coalesce(g, F.lit(False)) for n, g in gates.items()}, "completed": done, "publishable": done == len(gates), "next_gate": following})


def validity(df: DataFrame, start: str, now: Column, days: int = 365) -> DataFrame:
    """Whether a release of a year is not yet valid, effective or expired."""
    until = F.col(start) + F.make_dt_interval(F.lit(days))
    return df.withColumns({"valid_until": until, "validity": F.when(now < F.col(start), "not_yet").when(now > until, "expired").otherwise("effective")})


def release_faults(approvals: DataFrame, hashes: DataFrame, roles: tuple[str, ...]) -> DataFrame:
    """Releases whose approvals lack a role or repeat a reviewer, or whose recorded hashes differ from the files'."""
    people = approvals.groupBy("release_id").agg(F.collect_set("role").alias("roles"), F.count(F.lit(1)).alias("n"), F.count_distinct(F.lower("reviewer")).alias("people"))
    lacking = people.select("release_id", F.when(~F.forall(F.array(*map(F.lit, roles)), lambda r: F.array_contains("roles", r)), "role_missing").when(F.col("people") < F.col("n"), "reviewer_repeated").alias("fault"))
    changed = hashes.filter(F.col("recorded") != F.col("actual")).select("release_id", F.lit("hash_differs").alias("fault")).distinct()
    return lacking.unionByName(changed).filter("fault IS NOT NULL")

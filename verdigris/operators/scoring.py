"""Scoring: population statistics, indicator scores, company roll-up, grades and ranks.

No grid of companies and indicators is built for scores: a company's missing cells contribute by what the weights of
its present cells leave of the totals, so work follows the observations. Rankings never sort all companies in
one task: scores have two decimals, so at most 10,001 distinct values are ranked and broadcast back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.functions.numeric import normal_cdf_text, rounded, rounded_text
from verdigris.functions.quantiles import quantiles
from verdigris.schemas import DIMENSIONS, KEY, KINDS, STRATEGIES
from verdigris.sources.shared import staged

WINSOR_LEAST, MINIMUM_POPULATION = 20, 20
RATIOS = {"quantitative": 0.8, "qualitative": 0.2}


def confirmed() -> Column:
    return (F.col("status") == "confirmed") & F.col("value").isNotNull()


def latest_rows(obs: DataFrame, order: str = "_ord") -> DataFrame:
    """One row per (company, year, indicator): the last by the explicit input order."""
    last = obs.groupBy(*KEY).agg(F.max_by(F.struct(*[c for c in obs.columns if c not in KEY]), order).alias("r"))
    return last.select(*KEY, "r.*").select(*obs.columns)


def population_stats(obs: DataFrame, minimum: int = MINIMUM_POPULATION) -> DataFrame:
    """indicator_code, population_count, mean, stddev (population), thin; clamped to the 1% and 99% quantiles from 20 up.

    The limits are exact, by histograms of bits: no task gathers an indicator's values. They are one row per indicator,
    broadcast back. obs is read once a pass, so it is to be staged.
    """
    known = obs.filter(confirmed()).select("indicator_code", "value")
    limits = quantiles(known, ["indicator_code"], "value", [0.01, 0.99])
    clamped = F.when(F.col("n") >= WINSOR_LEAST, F.least(F.greatest("value", F.col("q")[0]), F.col("q")[1])).otherwise(F.col("value"))
    # one row for each indicator of the methodology: a fixed, small table
    return known.join(F.broadcast(limits), "indicator_code").groupBy("indicator_code").agg(
        F.count(F.lit(1)).alias("population_count"), F.avg(clamped).alias("mean"),
        F.when(F.count(F.lit(1)) > 1, F.stddev_pop(clamped)).otherwise(F.lit(0.0)).alias("stddev"), (F.count(F.lit(1)) < minimum).alias("thin_population"),
    )


NEAR = "100D * exp(-0.5D * ((value - {c}) / stddev) * ((value - {c}) / stddev))"
#: A confirmed value on 0..100 against its population and benchmark, over the columns of scored_cells.
SCORE = f"""CASE WHEN status <> 'confirmed' OR value IS NULL THEN NULL WHEN kind = 'qualitative' THEN least(greatest(value, 0D), 100D) WHEN stddev IS NULL OR stddev <= 1e-12D THEN 50D
  WHEN benchmark IS NOT NULL THEN CASE WHEN (direction = 'positive' AND value >= benchmark) OR (direction = 'negative' AND value <= benchmark) THEN 100D ELSE {NEAR.format(c="benchmark")} END
  WHEN direction = 'bidirectional' THEN {NEAR.format(c="mean")}
  ELSE 100D * {normal_cdf_text("((value - mean) / stddev * CASE WHEN direction = 'negative' THEN -1D ELSE 1D END)")} END"""


def default_score(strategy: str, status: Column) -> Column:
    """The score of a cell that is not confirmed."""
    return F.when(status == "not_applicable", F.lit(0.0)).otherwise(F.lit(50.0 if strategy == "indicator_neutral_v1" else 0.0))


def scored_cells(obs: DataFrame, indicators: DataFrame, stats: DataFrame) -> DataFrame:
    """Present cells with the indicator's columns, statistics and the score of confirmed ones (else null)."""
    meta = F.broadcast(indicators.withColumnRenamed("code", "indicator_code").join(F.broadcast(stats), "indicator_code", "left"))
    return obs.join(meta, "indicator_code").withColumn("score", F.expr(SCORE))


def score_details(obs: DataFrame, indicators: DataFrame, strategy: str, stats: DataFrame | None = None) -> DataFrame:
    """Every company and indicator, absent cells too: company_code, indicator_code, raw, normalized, weighted, status, ..."""
    obs = staged(obs.select(*KEY, "company_name", "value", "status", "_ord"), "observations")
    stats = population_stats(obs) if stats is None else stats
    cells = scored_cells(latest_rows(obs), indicators, stats).select("company_code", "indicator_code", "value", "status", "score")
    # the methodology's indicators (80 at most) for each company: an explode of a small array
    codes = F.broadcast(indicators.withColumnRenamed("code", "indicator_code").join(F.broadcast(stats), "indicator_code", "left"))
    grid = obs.select("company_code").distinct().crossJoin(codes)
    status = F.coalesce("status", F.lit("missing"))
    normal = F.coalesce("score", default_score(strategy, status))
    return grid.join(cells, ["company_code", "indicator_code"], "left").select(
        "company_code", "indicator_code", F.col("value").alias("raw"), rounded(normal, 4).alias("normalized"), rounded(normal * F.col("weight") / 100, 4).alias("weighted"),
        status.alias("status"), F.coalesce("population_count", F.lit(0)).cast("long").alias("population_count"), rounded(F.col("mean"), 6).alias("mean"), rounded(F.col("stddev"), 6).alias("stddev"),
        F.coalesce("thin_population", F.lit(True)).alias("thin_population"),
    )


#: Sums of scores and weights are whole multiples of 1 / UNIT: exact, whatever the order of rows, so that changes can be added.
UNIT = "1e12D"
PAIRS = [(k, d) for k in KINDS for d in DIMENSIONS]
SUMS = [f"{x}_{k}_{d}" for k, d in PAIRS for x in "swn"]


def exact(x: str) -> str:
    return f"CAST(round({x} * {UNIT}) AS BIGINT)"


def company_sums(cells: DataFrame, *others: str) -> DataFrame:
    """By company: confirmed cells, and by kind and dimension the sums of weighted scores (s), known weights (w) and weights of what does not apply (n)."""
    sums = ["count(score) AS confirmed", *others]
    for k, d in PAIRS:
        own = f"kind = '{k}' AND dimension = '{d}'"
        sums += [
            f"coalesce(sum({exact('score * weight / 100')}) FILTER (WHERE {own}), 0L) AS s_{k}_{d}", f"coalesce(sum({exact('weight')}) FILTER (WHERE {own} AND score IS NOT NULL), 0L) AS w_{k}_{d}",
            f"coalesce(sum({exact('weight')}) FILTER (WHERE {own} AND status = 'not_applicable'), 0L) AS n_{k}_{d}",
        ]
    return cells.groupBy("company_code").agg(*map(F.expr, sums))


def scores(sums: DataFrame, indicators: DataFrame, strategies: tuple[str, ...] = STRATEGIES) -> DataFrame:
    """strategy, company_code, company_name, quantitative, qualitative, e, s, g and total scores, disclosure_rate from companies' sums."""
    totals = ["count(*) AS indicators", *[f"coalesce(sum({exact('weight')}) FILTER (WHERE kind = '{k}' AND dimension = '{d}'), 0L) AS t_{k}_{d}" for k, d in PAIRS]]
    wide = sums.crossJoin(F.broadcast(indicators.agg(*map(F.expr, totals))))  # one row of weight totals
    out = None
    for strategy in strategies:
        part = {(k, d): f"((s_{k}_{d} + 0.5D * (t_{k}_{d} - w_{k}_{d} - n_{k}_{d})) / {UNIT})" if strategy == "indicator_neutral_v1" else f"(s_{k}_{d} / {UNIT})" for k, d in PAIRS}
        kind = {k: "(" + " + ".join(part[k, d] for d in DIMENSIONS) + ")" for k in KINDS}
        if strategy == "disclosed_weight_v1":
            every = lambda x, k: "(" + " + ".join(f"{x}_{k}_{d}" for d in DIMENSIONS) + ")"
            kind = {k: f"(CASE WHEN {every('w', k)} > 0 THEN {kind[k]} * {every('t', k)} / {every('w', k)} ELSE 0D END)" for k in KINDS}
            part = {(k, d): f"(CASE WHEN w_{k}_{d} > 0 THEN {p} * t_{k}_{d} / w_{k}_{d} ELSE 0D END)" for (k, d), p in part.items()}
        mix = lambda x: " + ".join(f"{RATIOS[k]}D * {x(k)}" for k in KINDS)
        one = wide.selectExpr(
            f"'{strategy}' AS strategy", "company_code", "company_name", *[f"{rounded_text(kind[k], 4)} AS {k}_score" for k in KINDS],
            *[f"{rounded_text(mix(lambda k, d=d: part[k, d]), 2)} AS {d.lower()}_score" for d in DIMENSIONS], f"{rounded_text(mix(kind.get), 2)} AS total_score", f"{rounded_text('confirmed * 100.0D / indicators', 2)} AS disclosure_rate",
        )
        out = one if out is None else out.unionByName(one)
    return out


def roll_up(cells: DataFrame, indicators: DataFrame, strategies: tuple[str, ...] = STRATEGIES) -> DataFrame:
    """Scores of companies under each strategy, all from one aggregation of the present cells: what a company lacks counts by the totals of weights."""
    return scores(company_sums(cells, "min_by(company_name, _ord) AS company_name"), indicators, strategies)


GRADES = (("AAA", 90), ("AA", 75), ("A", 60), ("BBB", 50), ("BB", 40), ("B", 30), ("C", 20))
FLAGS = ("major_safety_incident", "major_environment_incident", "major_hazard_unrectified", "accident_misreport")


def grades(df: DataFrame) -> DataFrame:
    """grade and grade_reason: incident flags first, then disclosure below half, then bands of the total."""
    reason = F.lit(None).cast("string")
    for flag in reversed([f for f in FLAGS if f in df.columns]):
        reason = F.when(F.col(flag), F.lit(flag)).otherwise(reason)
    reason = F.coalesce(reason, F.when(F.col("disclosure_rate") < 50, F.lit("disclosure_below_half")))
    band = F.lit("NA")
    for name, least in reversed(GRADES):
        band = F.when(F.col("total_score") >= least, F.lit(name)).otherwise(band)
    return df.withColumns({"grade_reason": reason}).withColumn("grade", F.when(F.col("grade_reason").isNotNull(), F.lit("NA")).otherwise(band))


def dense_ranks(df: DataFrame, by: str = "total_score", within: tuple[str, ...] = ()) -> DataFrame:
    """df with `rank`, dense over falling `by`, through its distinct values."""
    distinct = df.select(*within, by).distinct()
    ranks = distinct.withColumn("rank", F.dense_rank().over(Window.partitionBy(*(within or (F.lit(1),))).orderBy(F.desc(by))).cast("long"))
    # scores have two decimals on 0..100: at most 10,001 values for each strategy
    return df.join(F.broadcast(ranks), [*within, by])


def ranking(obs: DataFrame, indicators: DataFrame, strategies: tuple[str, ...] = STRATEGIES, universe: DataFrame | None = None, minimum: int = MINIMUM_POPULATION) -> DataFrame:
    """Companies of one year's observations, scored, graded and ranked under each strategy.

    Observations are read by three branches (quantiles, statistics, scores) and scores by two (distinct values, rows), so
    both are staged: each source is scanned once.
    """
    if universe is not None:
        obs = obs.join(universe.select("company_code").distinct(), "company_code", "left_semi")
    obs = staged(obs.select(*KEY, "company_name", "value", "status", "_ord"), "observations")
    stats = population_stats(obs, minimum)
    rolled = staged(roll_up(scored_cells(latest_rows(obs), indicators, stats), indicators, strategies), "scores")
    return dense_ranks(grades(rolled), within=("strategy",))


def population_baseline(obs: DataFrame, indicators: DataFrame, minimum: int = MINIMUM_POPULATION) -> DataFrame:
    """Every indicator with its population, statistics and whether it is empty, thin or sufficient."""
    stats = population_stats(staged(obs.select("indicator_code", "value", "status"), "observations"), minimum)
    n = F.coalesce("population_count", F.lit(0)).cast("long")
    return indicators.withColumnRenamed("code", "indicator_code").join(F.broadcast(stats), "indicator_code", "left").select(
        "indicator_code", "dimension", "kind", n.alias("population_count"), rounded(F.col("mean"), 6).alias("mean"), rounded(F.col("stddev"), 6).alias("stddev"),
        F.when(n == 0, "empty").when(n < minimum, "thin").otherwise("sufficient").alias("population_state"), F.greatest(F.lit(minimum) - n, F.lit(0)).cast("long").alias("population_deficit"),
    )

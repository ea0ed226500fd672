"""Rank stability, tiers, year-over-year change and anomalies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.functions.numeric import ratio, rounded
from verdigris.operators.scoring import confirmed, ranking
from verdigris.schemas import STRATEGIES
from verdigris.sources.shared import staged

TIERS = {
    "BASIC": {"statuses": ("confirmed",), "strategy": "legacy_zero_v1"},
    "PREMIUM": {"statuses": ("confirmed", "predicted", "imputed", "derived"), "strategy": "indicator_neutral_v1"},
    "PROFESSIONAL": {"statuses": ("confirmed", "predicted", "imputed", "derived"), "strategy": "indicator_neutral_v1"},
}


def credibility(disclosure: Column, span: Column) -> Column:
    return F.when((disclosure >= 80) & (span <= 10), "A").when((disclosure >= 60) & (span <= 25), "B").when((disclosure >= 40) & (span <= 50), "C").otherwise("D")


def sensitivity(rankings: DataFrame) -> DataFrame:
    """Per company over all strategies: best and worst rank, spans, credibility, whether unstable; one aggregation."""
    span = F.max("rank") - F.min("rank")
    return rankings.groupBy("company_code").agg(
        F.first("disclosure_rate").alias("disclosure_rate"), F.min("rank").alias("best_rank"), F.max("rank").alias("worst_rank"), span.alias("rank_span"),
        rounded(F.max("total_score") - F.min("total_score"), 4).alias("score_span"),
    ).withColumns({"credibility_grade": credibility(F.col("disclosure_rate"), F.col("rank_span")), "unstable": F.col("rank_span") > 10})


def strategy_pairs(rankings: DataFrame, top: int, order: tuple[str, ...] = STRATEGIES) -> DataFrame:
    """Per pair of strategies: correlation of ranks, companies shared, and overlap of the first `top` ranks.

    The strategies' ranks are pivoted to columns once; no self-join of companies.
    """
    wide = staged(rankings.groupBy("company_code").pivot("strategy", list(order)).agg(F.first("rank")), "ranks")
    out = None
    for i, left in enumerate(order):
        for right in order[i + 1 :]:
            a, b = F.col(left), F.col(right)
            in_a, in_b = F.count_if(a <= top), F.count_if(b <= top)
            one = wide.agg(
                F.lit(left).alias("left_strategy"), F.lit(right).alias("right_strategy"), F.count_if(a.isNotNull() & b.isNotNull()).alias("shared"),
                rounded(F.coalesce(F.nanvl(F.corr(a.cast("double"), b.cast("double")), F.lit(0.0)), F.lit(0.0)), 6).alias("rank_correlation"),
                rounded(F.count_if((a <= top) & (b <= top)) / F.greatest(in_a, in_b, F.lit(1)), 6).alias("top_overlap"),
            )
            out = one if out is None else out.unionByName(one)
    return out


def tier_rows(obs: DataFrame, tier: str) -> DataFrame:
    return obs.filter(F.col("status").isin(*TIERS[tier]["statuses"]))


def tier_summary(obs: DataFrame) -> DataFrame:
    """Rows by status, share of enriched rows and mean confidence for each tier."""
    out = None
    for tier in TIERS:
        rows = tier_rows(obs, tier)
        extra = F.count_if(F.col("status") != "confirmed")
        one = rows.agg(F.lit(tier).alias("tier"), F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.col("status") == s).alias(s) for s in ("confirmed", "derived", "predicted", "imputed")], rounded(F.coalesce(ratio(extra, F.count(F.lit(1))), F.lit(0.0)), 6).alias("enhanced_ratio"), F.count_distinct("company_code").alias("companies"))
        out = one if out is None else out.unionByName(one)
    return out


def tier_compare(obs: DataFrame, indicators: DataFrame, low: str = "BASIC", high: str = "PREMIUM") -> DataFrame:
    """Rank and score changes of companies that both tiers rank."""
    side = {t: ranking(tier_rows(obs, t), indicators, (TIERS[t]["strategy"],)).select("company_code", F.col("rank").alias(f"rank_{i}"), F.col("total_score").alias(f"score_{i}")) for i, t in enumerate((low, high))}
    both = side[low].join(side[high], "company_code")
    change = F.col("rank_0") - F.col("rank_1")
    return both.select("company_code", "rank_0", "rank_1", change.alias("rank_change"), rounded(F.col("score_1") - F.col("score_0"), 2).alias("score_change"), F.when(change > 0, "up").when(change < 0, "down").otherwise("same").alias("movement"))


def yoy_changes(obs: DataFrame, year: int, least: float = 0.001) -> DataFrame:
    """Per company and indicator with confirmed values in year - 1 and year: the change in percent.

    Both years come from one aggregation on the key, not from a self-join.
    """
    now = F.max(F.when(F.col("report_year") == year, F.col("value")))
    before = F.max(F.when(F.col("report_year") == year - 1, F.col("value")))
    both = obs.filter(confirmed() & F.col("report_year").isin(year - 1, year)).groupBy("company_code", "indicator_code").agg(before.alias("previous"), now.alias("current"))
    both = both.filter(F.col("previous").isNotNull() & F.col("current").isNotNull() & (F.abs("previous") >= least))
    return both.withColumn("change_pct", (F.col("current") - F.col("previous")) / F.abs("previous") * 100)


def yoy_stability(changes: DataFrame, least: int = 30) -> DataFrame:
    """Per indicator: mean, mean absolute and spread of changes, shares within 10% and beyond 30%, and a class."""
    size = F.abs("change_pct")
    out = changes.groupBy("indicator_code").agg(
        F.count(F.lit(1)).alias("n"), rounded(F.avg("change_pct"), 4).alias("mean_change"), rounded(F.avg(size), 4).alias("mean_abs_change"), rounded(F.stddev_pop("change_pct"), 4).alias("sd_change"),
        rounded(F.count_if(size < 10) / F.count(F.lit(1)), 6).alias("stable_share"), rounded(F.count_if((size >= 10) & (size < 30)) / F.count(F.lit(1)), 6).alias("moderate_share"), rounded(F.count_if(size >= 30) / F.count(F.lit(1)), 6).alias("volatile_share"),
    )
    return out.withColumn("stability", F.when((F.col("n") >= least) & (F.col("stable_share") > 0.7), "stable").when((F.col("n") >= least) & (F.col("volatile_share") > 0.4), "volatile").otherwise("moderate"))


#: Types of anomalies with what to do about them.
ANOMALIES = {
    "small_base_effect": "accept", "unit_conversion_error": "review", "disclosure_improvement": "accept", "known_extraction_issue": "reextract",
    "energy_intensity_outlier": "review", "significant_change": "sample_check", "extreme_outlier": "urgent_review",
}


def anomaly_types(changes: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Changes of 100% and more with their type, the first that holds, and action.

    Types: a tiny base; a ratio that is a power of ten up to 1,000 (within a relative tolerance); nothing before; R&D
    rates beyond 500%; energy intensities beyond 40 times; below 500%; everything else.
    """
    times = F.coalesce(F.abs(ratio(F.col("current"), F.col("previous"))), F.lit(0.0))
    size = F.abs("change_pct")
    tens = F.lit(False)
    for power in (10.0, 100.0, 1000.0):
        tens = tens | (F.abs(times / power - 1) <= tolerance) | (F.abs(times * power - 1) <= tolerance)
    kind = (
        F.when((F.abs("previous") < 0.1) & (size > 1000), "small_base_effect")
        .when(tens, "unit_conversion_error")
        .when((F.col("previous") == 0) & (F.col("current") > 0), "disclosure_improvement")
        .when((F.col("indicator_code") == "Q_S_RD_RATE") & (size > 500), "known_extraction_issue")
        .when((F.col("indicator_code") == "Q_E_ENERGY_INTENSITY") & (times > 40), "energy_intensity_outlier")
        .when((size > 100) & (size < 500), "significant_change")
        .otherwise("extreme_outlier")
    )
    action = F.lit(None).cast("string")
    for name, what in ANOMALIES.items():
        action = F.when(F.col("anomaly_type") == name, what).otherwise(action)
    found = changes.filter(size >= 100).withColumn("anomaly_type", kind)
    return found.select("company_code", "indicator_code", rounded(F.col("change_pct"), 4).alias("change_pct"), "anomaly_type", action.alias("action"))


def within_rank(df: DataFrame, group: str, by: str, tie: str) -> DataFrame:
    """Ordinal rank in each group, by falling `by`; ties go to the smaller `tie`."""
    return df.withColumn("group_rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(by), tie)))


def client_scores(obs: DataFrame, indicators: DataFrame) -> DataFrame:
    """Variant: z clipped to +-3 against sample deviation of all values, mapped to the weight; no spread gives it in full."""
    known = obs.filter(confirmed())
    stats = known.groupBy("indicator_code").agg(F.avg("value").alias("m"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd"))
    joined = known.join(F.broadcast(indicators.withColumnRenamed("code", "indicator_code").join(F.broadcast(stats), "indicator_code")), "indicator_code")
    z = F.least(F.greatest((F.col("value") - F.col("m")) / F.nullif("sd", F.lit(0.0)), F.lit(-3.0)), F.lit(3.0))
    share = F.when(F.col("sd") == 0, F.lit(1.0)).when(F.col("direction") == "bidirectional", F.exp(-z * z / 2)).when(F.col("direction") == "negative", (3 - z) / 6).otherwise((z + 3) / 6)
    return joined.groupBy("company_code").agg(rounded(F.sum(share * F.col("weight")), 4).alias("client_score"), F.count(F.lit(1)).alias("indicators"))


def linear_scores(obs: DataFrame) -> DataFrame:
    """Variant: 50 + 20 z clipped to 0..100, averaged by confidence; indicators of fewer than three values are left out."""
    known = obs.filter(confirmed())
    stats = known.groupBy("indicator_code").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("sd"), F.count(F.lit(1)).alias("n")).filter("n >= 3")
    joined = known.join(F.broadcast(stats), "indicator_code")
    score = F.when(F.col("sd") == 0, F.lit(50.0)).otherwise(F.least(F.greatest(50 + 20 * (F.col("value") - F.col("m")) / F.nullif("sd", F.lit(0.0)), F.lit(0.0)), F.lit(100.0)))
    return joined.groupBy("company_code").agg(rounded(F.sum(score * F.col("confidence")) / F.sum("confidence"), 4).alias("linear_score"))


def minmax_scores(df: DataFrame, by: str, scale: float) -> DataFrame:
    """`by` mapped to 0..scale between its smallest and largest value."""
    ends = df.agg(F.min(by).alias("_low"), F.max(by).alias("_high"))
    return df.crossJoin(F.broadcast(ends)).withColumn("minmax_score", rounded(F.coalesce((F.col(by) - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0)) * scale, F.lit(0.0)), 4)).drop("_low", "_high")


def movers(df: DataFrame, change: str, tie: str, k: int = 10) -> DataFrame:
    """The k largest gains and the k largest losses, each in order."""
    side = lambda name, order, keep: df.filter(keep).orderBy(order, tie).limit(k).withColumn("side", F.lit(name))
    return side("up", F.desc(change), F.col(change) > 0).unionByName(side("down", F.asc(change), F.col(change) < 0))


def reprioritised(df: DataFrame, first: Column, *order: Column) -> DataFrame:
    """df with `place`, counted from 1 in the order of (first, order).

    Rows are sorted by ranges and numbered in each; a range starts where the counts of those before it end. Only these
    counts, one for each range, meet in one task.
    """
    own = df.columns
    rows = staged(df.orderBy(first, *order).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    rows = rows.withColumns({"_part": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.join(F.broadcast(starts), "_part").select(*own, (F.col("_start") + F.col("_at") + 1).cast("int").alias("place"))


def access(df: DataFrame, tier: str, allowed: dict[str, tuple[str, ...]]) -> DataFrame:
    """The columns of an export that a tier may see; an unknown tier sees none."""
    return df.select(*[c for c in df.columns if c in allowed.get(tier, ())])

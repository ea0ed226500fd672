"""Queries of scoring and analysis over the star schema, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.functions.numeric import erf_text, normal_cdf_text, plain_number, rounded
from verdigris.operators import analysis, scoring
from verdigris.operators.cache import CHANGE_COLUMNS, ScoreCache
from verdigris.plans.binding import IND, OBS, YEAR, indicators, observations, sql_erf, sql_round, sql_with, table
from verdigris.schemas import STRATEGIES, methodology_faults
from verdigris.sources.shared import staged
from verdigris.streaming.rescoring import rescored

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


ONE_YEAR = f"base AS (SELECT o.*, i.dimension, i.kind, i.weight, i.direction, i.benchmark FROM obs o JOIN ind i USING (indicator_code) WHERE report_year = {YEAR})"
STATS = """lim AS (SELECT indicator_code, count(*) AS n, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM base
  WHERE status = 'confirmed' AND value IS NOT NULL GROUP BY 1),
stats AS (SELECT indicator_code, count(*) AS population_count, avg(v) AS mean, CASE WHEN count(*) > 1 THEN stddev_pop(v)
  ELSE 0.0 END AS stddev, count(*) < 20 AS thin_population
  FROM (SELECT indicator_code, CASE WHEN n >= 20 THEN least(greatest(value, lo), hi) ELSE value END AS v FROM base JOIN lim USING (indicator_code)
  WHERE status = 'confirmed' AND value IS NOT NULL) GROUP BY 1)"""
CDF = f"(0.5 * (1 + {sql_erf('(z / sqrt(2.0))')}))"
CELLS = f"""cells AS (
  SELECT *, CASE WHEN status <> 'confirmed' OR value IS NULL THEN NULL WHEN kind = 'qualitative' THEN least(greatest(value, 0.0), 100.0) WHEN stddev IS NULL OR stddev <= 1e-12 THEN 50.0
    WHEN benchmark IS NOT NULL THEN CASE WHEN (direction = 'positive' AND value >= benchmark) OR (direction = 'negative' AND value <= benchmark) THEN 100.0 ELSE 100 * exp(-0.5 * ((value - benchmark) / stddev) * ((value - benchmark) / stddev)) END
    WHEN direction = 'negative' THEN 100 * (1 - {CDF}) WHEN direction = 'bidirectional' THEN 100 * exp(-0.5 * z * z) ELSE 100 * {CDF} END AS score
  FROM (SELECT *, CASE WHEN stddev > 0 THEN (value - mean) / stddev ELSE 0.0 END AS z FROM base LEFT JOIN stats USING (indicator_code))
)"""
GRID = """grid AS (
  SELECT st.strategy, c.company_code, c.company_name, i.indicator_code, i.kind, i.dimension, i.weight, x.status, x.score,
    coalesce(x.score, CASE WHEN x.status = 'not_applicable' THEN 0.0 WHEN st.strategy = 'indicator_neutral_v1' THEN 50.0 ELSE 0.0 END) * i.weight / 100 AS w
  FROM (SELECT company_code, arg_min(company_name, _ord) AS company_name FROM base GROUP BY 1) c CROSS JOIN ind i
  CROSS JOIN (SELECT unnest(['legacy_zero_v1', 'indicator_neutral_v1', 'disclosed_weight_v1']) AS strategy) st
  LEFT JOIN cells x ON x.company_code = c.company_code AND x.indicator_code = i.indicator_code
)"""
ROLLED = f"""kinds AS (
  SELECT strategy, company_code, kind, dimension, sum(w) AS s, coalesce(sum(CASE WHEN score IS NOT NULL THEN weight END), 0) AS known, sum(weight) AS total FROM grid GROUP BY ALL
), byk AS (
  SELECT strategy, company_code, kind, CASE WHEN strategy = 'disclosed_weight_v1' THEN CASE WHEN sum(known) > 0 THEN sum(s) * sum(total) / sum(known) ELSE 0.0 END ELSE sum(s) END AS s FROM kinds GROUP BY strategy, company_code, kind
), byd AS (
  SELECT strategy, company_code, dimension, sum(CASE kind WHEN 'quantitative' THEN 0.8 ELSE 0.2 END * CASE WHEN strategy = 'disclosed_weight_v1' THEN CASE WHEN known > 0 THEN s * total / known ELSE 0.0 END ELSE s END) AS s FROM kinds GROUP BY strategy, company_code, dimension
), disclosed AS (
  SELECT company_code, any_value(company_name) AS company_name, {sql_round("count(score) * 100.0 / 25", 2)} AS disclosure_rate FROM grid WHERE strategy = 'legacy_zero_v1' GROUP BY 1
), rolled AS (
  SELECT k.strategy, k.company_code, d.company_name, {sql_round("max(CASE k.kind WHEN 'quantitative' THEN k.s END)", 4)} AS quantitative_score, {sql_round("max(CASE k.kind WHEN 'qualitative' THEN k.s END)", 4)} AS qualitative_score,
    {sql_round("0.8 * max(CASE k.kind WHEN 'quantitative' THEN k.s END) + 0.2 * max(CASE k.kind WHEN 'qualitative' THEN k.s END)", 2)} AS total_score, any_value(d.disclosure_rate) AS disclosure_rate
  FROM byk k JOIN disclosed d USING (company_code) GROUP BY k.strategy, k.company_code, d.company_name
), dims AS (
  SELECT strategy, company_code, {sql_round("max(CASE dimension WHEN 'E' THEN s END)", 2)} AS e_score, {sql_round("max(CASE dimension WHEN 'S' THEN s END)", 2)} AS s_score, {sql_round("max(CASE dimension WHEN 'G' THEN s END)", 2)} AS g_score FROM byd GROUP BY strategy, company_code
), ranked AS (
  SELECT r.*, e_score, s_score, g_score, CASE WHEN disclosure_rate < 50 THEN 'disclosure_below_half' END AS grade_reason,
    CASE WHEN disclosure_rate < 50 THEN 'NA' WHEN total_score >= 90 THEN 'AAA' WHEN total_score >= 75 THEN 'AA' WHEN total_score >= 60 THEN 'A' WHEN total_score >= 50 THEN 'BBB' WHEN total_score >= 40 THEN 'BB' WHEN total_score >= 30 THEN 'B' WHEN total_score >= 20 THEN 'C' ELSE 'NA' END AS grade,
    dense_rank() OVER (PARTITION BY strategy ORDER BY total_score DESC) AS rank
  FROM rolled r JOIN dims USING (strategy, company_code)
)"""
CHAIN = (OBS, IND, ONE_YEAR, STATS, CELLS, GRID, ROLLED)
RANKED = "SELECT strategy, company_code, company_name, quantitative_score, qualitative_score, e_score, s_score, g_score, total_score, disclosure_rate, grade, grade_reason, rank FROM ranked"


def year(spark, d) -> DataFrame:
    return observations(spark, d, YEAR)


@query("obs_binding", sql_with(OBS, "SELECT * FROM obs"))
def obs_binding(spark, d):
    return observations(spark, d)


BRANDS = "brands AS (SELECT p_brand AS indicator_code, count(*) AS parts FROM part GROUP BY 1)"


@query("indicator_table", sql_with(IND, BRANDS, f"SELECT indicator_code AS code, dimension, kind, {sql_round('weight', 6)} AS weight, direction, benchmark, key_indicator, parts FROM ind JOIN brands USING (indicator_code)"))
def indicator_table(spark, d):
    """The indicators that parts have, with how many."""
    brands = table(spark, d, "part").groupBy(F.col("p_brand").alias("code")).agg(F.count(F.lit(1)).alias("parts"))
    return indicators(spark).join(brands, "code").select("code", "dimension", "kind", rounded(F.col("weight"), 6).alias("weight"), "direction", "benchmark", "key_indicator", "parts")


@query("methodology_faults", """WITH m AS (
  SELECT b, o, n, CASE WHEN b > 40 THEN 'B' || b ELSE 'B' || b || '-' || o END AS code, CASE WHEN b % 11 = 0 THEN 'X' ELSE 'E' END AS dimension, CASE WHEN o = 0 THEN 'quantitative' WHEN b = 13 THEN 'third' ELSE 'qualitative' END AS kind,
    CASE WHEN b % 7 = 0 THEN 'sideways' ELSE 'positive' END AS direction FROM (SELECT CAST(substr(p_brand, 7) AS INTEGER) AS b, p_size % 2 AS o, count(*) AS n FROM part GROUP BY 1, 2)
), w AS (SELECT *, CASE WHEN kind = 'quantitative' THEN 100.0 * n / sum(n) OVER (PARTITION BY kind) ELSE n END AS weight FROM m)
SELECT 'repeated_code' AS fault, code AS detail FROM w GROUP BY code HAVING count(*) > 1
UNION ALL SELECT 'weights_not_100', kind FROM w GROUP BY kind HAVING abs(sum(weight) - 100) > 0.01
UNION ALL SELECT 'unknown_dimension', code FROM w WHERE dimension = 'X' UNION ALL SELECT 'unknown_kind', code FROM w WHERE kind = 'third' UNION ALL SELECT 'unknown_direction', code FROM w WHERE direction = 'sideways'""")
def faults(spark, d):
    """A methodology made from parts, by brand and parity of size: some codes come twice, some words are unknown, one kind's weights are counts."""
    b, o = F.substr("p_brand", F.lit(7)).cast("int").alias("b"), (F.col("p_size") % 2).alias("o")
    made = table(spark, d, "part").groupBy(b, o).agg(F.count(F.lit(1)).alias("n"))
    named = made.selectExpr("n", "CASE WHEN b > 40 THEN concat('B', b) ELSE concat('B', b, '-', o) END AS code", "CASE WHEN b % 11 = 0 THEN 'X' ELSE 'E' END AS dimension",
        "CASE WHEN o = 0 THEN 'quantitative' WHEN b = 13 THEN 'third' ELSE 'qualitative' END AS kind", "CASE WHEN b % 7 = 0 THEN 'sideways' ELSE 'positive' END AS direction")
    total = named.groupBy("kind").agg(F.sum("n").alias("total"))
    return methodology_faults(named.join(total, "kind").withColumn("weight", F.expr("CASE WHEN kind = 'quantitative' THEN 100.0D * n / total ELSE CAST(n AS DOUBLE) END")))


@query("erf_table", f"SELECT i, {sql_round(sql_erf('((i - 400) / 100.0)'), 9)} AS erf, {sql_round('0.5 * (1 + ' + sql_erf('((i - 400) / 100.0 / sqrt(2.0))') + ')', 9)} AS cdf FROM (SELECT DISTINCT c_custkey % 801 AS i FROM customer)")
def erf_table(spark, d):
    """The error function and the normal distribution at places that customers' keys give."""
    x = "((i - 400) / 100.0D)"
    places = table(spark, d, "customer").select((F.col("c_custkey") % 801).alias("i")).distinct()
    return places.select("i", rounded(F.expr(erf_text(x)), 9).alias("erf"), rounded(F.expr(normal_cdf_text(x)), 9).alias("cdf"))


@query("population_stats", sql_with(OBS, IND, ONE_YEAR, STATS, f"SELECT indicator_code, population_count, {sql_round('mean', 6)} AS mean, {sql_round('stddev', 6)} AS stddev, thin_population FROM stats"))
def population_stats(spark, d):
    return scoring.population_stats(staged(year(spark, d).select("indicator_code", "value", "status"), "observations")).withColumns({"mean": rounded(F.col("mean"), 6), "stddev": rounded(F.col("stddev"), 6)})


for _s in STRATEGIES:
    query(f"ranking_{_s}", sql_with(*CHAIN, f"{RANKED} WHERE strategy = '{_s}'"))(lambda spark, d, s=_s: scoring.ranking(year(spark, d), indicators(spark), (s,)))

query("score_companies", sql_with(*CHAIN, RANKED))(lambda spark, d: scoring.ranking(year(spark, d), indicators(spark)))


@query("score_details", sql_with(*CHAIN, f"""SELECT g.company_code, g.indicator_code, x.value AS raw, {sql_round('g.w / g.weight * 100', 4)} AS normalized, {sql_round('g.w', 4)} AS weighted, coalesce(g.status, 'missing') AS status,
  coalesce(s.population_count, 0) AS population_count, {sql_round('s.mean', 6)} AS mean, {sql_round('s.stddev', 6)} AS stddev, coalesce(s.thin_population, true) AS thin_population
  FROM grid g LEFT JOIN cells x ON x.company_code = g.company_code AND x.indicator_code = g.indicator_code LEFT JOIN stats s ON s.indicator_code = g.indicator_code WHERE strategy = 'indicator_neutral_v1'"""))
def score_details(spark, d):
    return scoring.score_details(year(spark, d), indicators(spark), "indicator_neutral_v1")


SCOPED = f"base AS (SELECT o.*, i.dimension, i.kind, i.weight, i.direction, i.benchmark FROM obs o JOIN ind i USING (indicator_code) WHERE report_year = {YEAR} AND company_code IN (SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') FROM supplier WHERE s_nationkey < 12))"


@query("ranking_universe_scoped", sql_with(OBS, IND, SCOPED, STATS, CELLS, GRID, ROLLED, f"{RANKED} WHERE strategy = 'indicator_neutral_v1'"))
def ranking_universe_scoped(spark, d):
    from verdigris.plans.binding import code, table

    universe = table(spark, d, "supplier").filter("s_nationkey < 12").select(code("s_suppkey").alias("company_code"))
    return scoring.ranking(year(spark, d), indicators(spark), ("indicator_neutral_v1",), universe)


@query("population_baseline", sql_with(OBS, IND, ONE_YEAR, STATS, f"""SELECT indicator_code, dimension, kind, coalesce(population_count, 0) AS population_count, {sql_round('mean', 6)} AS mean, {sql_round('stddev', 6)} AS stddev,
  CASE WHEN coalesce(population_count, 0) = 0 THEN 'empty' WHEN population_count < 80 THEN 'thin' ELSE 'sufficient' END AS population_state, greatest(80 - coalesce(population_count, 0), 0) AS population_deficit FROM ind LEFT JOIN stats USING (indicator_code)"""))
def population_baseline(spark, d):
    return scoring.population_baseline(year(spark, d), indicators(spark), 80)


@query("grade_bands", f"""WITH s AS (SELECT s_suppkey, s_acctbal, s_nationkey, CASE WHEN s_acctbal > 0 THEN {sql_round('s_acctbal / 100', 2)} ELSE 0.0 END AS total_score, CAST(30.0 + s_nationkey * 3 AS DOUBLE) AS disclosure_rate FROM supplier)
SELECT s_suppkey, total_score, disclosure_rate, CASE WHEN s_nationkey = 24 THEN 'major_safety_incident' WHEN s_nationkey = 23 THEN 'accident_misreport' WHEN disclosure_rate < 50 THEN 'disclosure_below_half' END AS grade_reason,
  CASE WHEN s_nationkey >= 23 OR disclosure_rate < 50 THEN 'NA' WHEN total_score >= 90 THEN 'AAA' WHEN total_score >= 75 THEN 'AA' WHEN total_score >= 60 THEN 'A' WHEN total_score >= 50 THEN 'BBB' WHEN total_score >= 40 THEN 'BB' WHEN total_score >= 30 THEN 'B' WHEN total_score >= 20 THEN 'C' ELSE 'NA' END AS grade FROM s""")
def grade_bands(spark, d):
    from verdigris.plans.binding import table

    s = table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_acctbal") > 0, rounded(F.col("s_acctbal") / 100, 2)).otherwise(0.0).alias("total_score"), (30.0 + F.col("s_nationkey") * 3).alias("disclosure_rate"), (F.col("s_nationkey") == 24).alias("major_safety_incident"), (F.col("s_nationkey") == 23).alias("accident_misreport"))
    return scoring.grades(s).drop("major_safety_incident", "accident_misreport")


SENS = f"""sens AS (SELECT company_code, any_value(disclosure_rate) AS disclosure_rate, min(rank) AS best_rank, max(rank) AS worst_rank, max(rank) - min(rank) AS rank_span, {sql_round('max(total_score) - min(total_score)', 4)} AS score_span FROM ranked GROUP BY 1)"""
CRED = "CASE WHEN disclosure_rate >= 80 AND rank_span <= 10 THEN 'A' WHEN disclosure_rate >= 60 AND rank_span <= 25 THEN 'B' WHEN disclosure_rate >= 40 AND rank_span <= 50 THEN 'C' ELSE 'D' END"


def all_rankings(spark, d):
    return scoring.ranking(year(spark, d), indicators(spark))


@query("sensitivity_companies", sql_with(*CHAIN, SENS, f"SELECT *, {CRED} AS credibility_grade, rank_span > 10 AS unstable FROM sens"))
def sensitivity_companies(spark, d):
    return analysis.sensitivity(all_rankings(spark, d))


@query("sensitivity_pairs", sql_with(*CHAIN, f"""pairs AS (SELECT a.strategy AS l, b.strategy AS r, a.rank AS x, b.rank AS y FROM ranked a JOIN ranked b USING (company_code)
  WHERE (a.strategy, b.strategy) IN (('legacy_zero_v1', 'indicator_neutral_v1'), ('legacy_zero_v1', 'disclosed_weight_v1'), ('indicator_neutral_v1', 'disclosed_weight_v1')))""",
  f"SELECT l AS left_strategy, r AS right_strategy, count(*) AS shared, {sql_round('coalesce(corr(x, y), 0)', 6)} AS rank_correlation, {sql_round('count(*) FILTER (x <= 20 AND y <= 20) / greatest(count(*) FILTER (x <= 20), count(*) FILTER (y <= 20), 1)', 6)} AS top_overlap FROM pairs GROUP BY ALL"))
def sensitivity_pairs(spark, d):
    return analysis.strategy_pairs(all_rankings(spark, d), 20)


@query("ranking_export_two_rows", sql_with(*CHAIN, f"""top AS (SELECT company_code, rank, total_score FROM ranked WHERE strategy = 'indicator_neutral_v1' ORDER BY total_score DESC, company_code LIMIT 20),
piv AS (SELECT company_code, indicator_code, max(value) AS v FROM cells WHERE status = 'confirmed' AND indicator_code IN ('Brand#1', 'Brand#2', 'Brand#3') GROUP BY ALL),
sco AS (SELECT company_code, indicator_code, max(w) AS w FROM grid WHERE strategy = 'indicator_neutral_v1' AND indicator_code IN ('Brand#1', 'Brand#2', 'Brand#3') GROUP BY ALL)""",
  f"""SELECT t.company_code, t.rank, 'value' AS line, {sql_round("(SELECT v FROM piv p WHERE p.company_code = t.company_code AND indicator_code = 'Brand#1')", 4)} AS k1, {sql_round("(SELECT v FROM piv p WHERE p.company_code = t.company_code AND indicator_code = 'Brand#2')", 4)} AS k2, {sql_round("(SELECT v FROM piv p WHERE p.company_code = t.company_code AND indicator_code = 'Brand#3')", 4)} AS k3 FROM top t
  UNION ALL SELECT t.company_code, t.rank, 'score', {sql_round("(SELECT w FROM sco p WHERE p.company_code = t.company_code AND indicator_code = 'Brand#1')", 4)}, {sql_round("(SELECT w FROM sco p WHERE p.company_code = t.company_code AND indicator_code = 'Brand#2')", 4)}, {sql_round("(SELECT w FROM sco p WHERE p.company_code = t.company_code AND indicator_code = 'Brand#3')", 4)} FROM top t"""))
def ranking_export_two_rows(spark, d):
    from verdigris.sources.sinks import two_row_export

    obs = year(spark, d)
    ranked = scoring.ranking(obs, indicators(spark), ("indicator_neutral_v1",))
    details = scoring.score_details(obs, indicators(spark), "indicator_neutral_v1")
    return two_row_export(ranked, details, ["Brand#1", "Brand#2", "Brand#3"], 20)


@query("ranking_json", sql_with(*CHAIN, "SELECT company_code, count(*) AS details, count(score) AS scored FROM grid WHERE strategy = 'indicator_neutral_v1' GROUP BY 1"))
def ranking_json(spark, d):
    from verdigris.sources.sinks import nested_json

    details = scoring.score_details(year(spark, d), indicators(spark), "indicator_neutral_v1")
    parsed = nested_json(details).select("company_code", F.from_json("details", "array<struct<indicator_code:string,status:string>>").alias("x"))
    return parsed.select("company_code", F.size("x").cast("long").alias("details"), F.size(F.filter("x", lambda i: i["status"] == "confirmed")).cast("long").alias("scored"))


@query("tier_filter", sql_with(OBS, f"SELECT company_code, report_year, indicator_code, status FROM obs WHERE report_year = {YEAR} AND status IN ('confirmed', 'predicted', 'imputed', 'derived')"))
def tier_filter(spark, d):
    return analysis.tier_rows(year(spark, d), "PREMIUM").select("company_code", "report_year", "indicator_code", "status")


_T = lambda t, c: f"SELECT '{t}' AS tier, count(*) AS n_rows, count(*) FILTER (status = 'confirmed') AS confirmed, count(*) FILTER (status = 'derived') AS derived, count(*) FILTER (status = 'predicted') AS predicted, count(*) FILTER (status = 'imputed') AS imputed, {sql_round(chr(99) + 'ount(*) FILTER (status <> ' + chr(39) + 'confirmed' + chr(39) + ') / count(*)', 6)} AS enhanced_ratio, count(DISTINCT company_code) AS companies FROM obs WHERE report_year = {YEAR} AND status IN {c}"


@query("tier_summary", sql_with(OBS, " UNION ALL ".join([_T("BASIC", "('confirmed')"), _T("PREMIUM", "('confirmed', 'predicted', 'imputed', 'derived')"), _T("PROFESSIONAL", "('confirmed', 'predicted', 'imputed', 'derived')")])))
def tier_summary(spark, d):
    return analysis.tier_summary(year(spark, d))


def _tier_sql(n: int, statuses: str) -> str:
    """The chain for one tier, its tables numbered so that two chains fit into one statement."""
    import re

    chain = ",\n".join([ONE_YEAR, STATS, CELLS, GRID, ROLLED]).replace(f"WHERE report_year = {YEAR})", f"WHERE report_year = {YEAR} AND status IN {statuses})", 1)
    return re.sub(r"\b(base|lim|stats|cells|grid|kinds|byk|byd|disclosed|rolled|dims|ranked)\b", rf"\g<1>{n}", chain)


@query("tier_compare", sql_with(OBS, IND, _tier_sql(1, "('confirmed')"), _tier_sql(2, "('confirmed', 'predicted', 'imputed', 'derived')"), f"""SELECT company_code, rank_0, rank_1, rank_0 - rank_1 AS rank_change, {sql_round('s1 - s0', 2)} AS score_change, CASE WHEN rank_0 > rank_1 THEN 'up' WHEN rank_0 < rank_1 THEN 'down' ELSE 'same' END AS movement
  FROM (SELECT company_code, rank AS rank_0, total_score AS s0 FROM ranked1 WHERE strategy = 'legacy_zero_v1') a JOIN (SELECT company_code, rank AS rank_1, total_score AS s1 FROM ranked2 WHERE strategy = 'indicator_neutral_v1') b USING (company_code)"""))
def tier_compare(spark, d):
    return analysis.tier_compare(year(spark, d), indicators(spark))


YOY = f"""yoy AS (SELECT company_code, indicator_code, a.value AS previous, b.value AS current, (b.value - a.value) / abs(a.value) * 100 AS change_pct
  FROM obs a JOIN obs b USING (company_code, indicator_code) WHERE a.report_year = {YEAR - 1} AND b.report_year = {YEAR} AND a.status = 'confirmed' AND b.status = 'confirmed' AND abs(a.value) >= 0.001)"""


def changes(spark, d):
    return analysis.yoy_changes(observations(spark, d), YEAR)


@query("yoy_changes", sql_with(OBS, YOY, f"SELECT company_code, indicator_code, previous, current, {sql_round('change_pct', 4)} AS change_pct FROM yoy"))
def yoy_changes(spark, d):
    return changes(spark, d).withColumn("change_pct", rounded(F.col("change_pct"), 4))


@query("yoy_indicator_stability", sql_with(OBS, YOY, f"""st AS (SELECT indicator_code, count(*) AS n, {sql_round('avg(change_pct)', 4)} AS mean_change, {sql_round('avg(abs(change_pct))', 4)} AS mean_abs_change, {sql_round('stddev_pop(change_pct)', 4)} AS sd_change,
  {sql_round('count(*) FILTER (abs(change_pct) < 10) / count(*)', 6)} AS stable_share, {sql_round('count(*) FILTER (abs(change_pct) >= 10 AND abs(change_pct) < 30) / count(*)', 6)} AS moderate_share, {sql_round('count(*) FILTER (abs(change_pct) >= 30) / count(*)', 6)} AS volatile_share FROM yoy GROUP BY 1)""",
  "SELECT *, CASE WHEN n >= 30 AND stable_share > 0.7 THEN 'stable' WHEN n >= 30 AND volatile_share > 0.4 THEN 'volatile' ELSE 'moderate' END AS stability FROM st"))
def yoy_indicator_stability(spark, d):
    return analysis.yoy_stability(changes(spark, d))


#: Two of the binding's indicators stand for the ones with rules of their own.
NAMED = {"Brand#11": "Q_S_RD_RATE", "Brand#12": "Q_E_ENERGY_INTENSITY"}
TENS = " OR ".join(f"abs(abs(current / previous) / {p} - 1) <= 1e-9 OR abs(abs(current / previous) * {p} - 1) <= 1e-9" for p in (10.0, 100.0, 1000.0))
ANOMALY = f"""an AS (SELECT *, CASE WHEN abs(previous) < 0.1 AND abs(change_pct) > 1000 THEN 'small_base_effect' WHEN {TENS} THEN 'unit_conversion_error'
  WHEN indicator_code = 'Q_S_RD_RATE' AND abs(change_pct) > 500 THEN 'known_extraction_issue' WHEN indicator_code = 'Q_E_ENERGY_INTENSITY' AND abs(current / previous) > 40 THEN 'energy_intensity_outlier'
  WHEN abs(change_pct) > 100 AND abs(change_pct) < 500 THEN 'significant_change' ELSE 'extreme_outlier' END AS anomaly_type
  FROM (SELECT * REPLACE (CASE indicator_code {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in NAMED.items())} ELSE indicator_code END AS indicator_code) FROM yoy) WHERE abs(change_pct) >= 100)"""


def anomalies(spark, d):
    code = F.col("indicator_code")
    for own, name in NAMED.items():
        code = F.when(F.col("indicator_code") == own, name).otherwise(code)
    return analysis.anomaly_types(changes(spark, d).withColumn("indicator_code", code))


@query("anomaly_types", sql_with(OBS, YOY, ANOMALY, f"""SELECT company_code, indicator_code, {sql_round('change_pct', 4)} AS change_pct, anomaly_type,
  CASE WHEN anomaly_type = 'small_base_effect' THEN 'accept' WHEN anomaly_type = 'known_extraction_issue' THEN 'reextract' WHEN anomaly_type = 'significant_change' THEN 'sample_check' WHEN anomaly_type = 'extreme_outlier' THEN 'urgent_review' ELSE 'review' END AS action FROM an"""))
def anomaly_types(spark, d):
    return anomalies(spark, d)


@query("anomaly_plan", sql_with(OBS, YOY, ANOMALY, "SELECT anomaly_type, count(*) AS n FROM an GROUP BY 1"))
def anomaly_plan(spark, d):
    return anomalies(spark, d).groupBy("anomaly_type").agg(F.count(F.lit(1)).alias("n"))


@query("industry_rank", sql_with(*CHAIN, "SELECT company_code, n_name AS industry, total_score, row_number() OVER (PARTITION BY n_name ORDER BY total_score DESC, company_code) AS group_rank "
    "FROM ranked JOIN supplier ON lpad(CAST(s_suppkey AS VARCHAR), 6, '0') = company_code JOIN nation ON s_nationkey = n_nationkey "
    "WHERE strategy = 'indicator_neutral_v1'"))
def industry_rank(spark, d):
    from verdigris.plans.binding import code, table

    ranked = scoring.ranking(year(spark, d), indicators(spark), ("indicator_neutral_v1",))
    home = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(code("s_suppkey").alias("company_code"), F.col("n_name").alias("industry"))
    return analysis.within_rank(ranked.join(home, "company_code"), "industry", "total_score", "company_code").select("company_code", "industry", "total_score", "group_rank")


@query("client_engine", sql_with(OBS, IND, ONE_YEAR, "k AS (SELECT * FROM base WHERE status = 'confirmed'), st AS (SELECT indicator_code, avg(value) AS m, coalesce(stddev_samp(value), 0) AS sd FROM k "
    "GROUP BY 1), zs AS (SELECT *, CASE WHEN sd > 0 THEN least(greatest((value - m) / sd, -3), 3) END AS z FROM k JOIN st USING (indicator_code))",
  f"SELECT company_code, {sql_round('''sum(weight * CASE WHEN sd = 0 THEN 1.0 WHEN direction = 'bidirectional' THEN exp(-z * z / 2) WHEN direction = 'negative' THEN (3 - z) / 6 ELSE (z + 3) / 6 END)''', 4)} AS client_score, count(*) AS indicators FROM zs GROUP BY 1"))
def client_engine(spark, d):
    return analysis.client_scores(year(spark, d), indicators(spark))


@query("linear_engine", sql_with(OBS, IND, ONE_YEAR, "k AS (SELECT * FROM base WHERE status = 'confirmed'), st AS (SELECT indicator_code, avg(value) AS m, stddev_pop(value) AS sd FROM k GROUP BY 1 HAVING count(*) >= 3)",
  f"SELECT company_code, {sql_round('sum(CASE WHEN sd = 0 THEN 50.0 ELSE least(greatest(50 + 20 * (value - m) / sd, 0), 100) END * confidence) / sum(confidence)', 4)} AS linear_score FROM k JOIN st USING (indicator_code) GROUP BY 1"))
def linear_engine(spark, d):
    return analysis.linear_scores(year(spark, d))


@query("minmax_engine", sql_with(*CHAIN, f"SELECT company_code, total_score, {sql_round('coalesce((total_score - min(total_score) OVER ()) / nullif(max(total_score) OVER () - min(total_score) OVER (), 0) * 10, 0)', 4)} AS minmax_score FROM ranked WHERE strategy = 'indicator_neutral_v1'"))
def minmax_engine(spark, d):
    ranked = scoring.ranking(year(spark, d), indicators(spark), ("indicator_neutral_v1",)).select("company_code", "total_score")
    return analysis.minmax_scores(ranked, "total_score", 10.0)


CHANGED = OBS.replace("obs AS", "obs0 AS")


@query("cache_change", sql_with(CHANGED, "obs AS (SELECT company_code, company_name, report_year, indicator_code, CASE WHEN indicator_code = 'Brand#3' AND source_page >= 3 THEN value + 5 "
    "ELSE value END AS value, status, source_url, source_file, source_page, evidence_text, confidence, _ord FROM obs0)", *CHAIN[1:], f"{RANKED} WHERE strategy = 'indicator_neutral_v1'"))
def cache_change(spark, d):
    return change_cache(*score_cache(spark, d))


def score_cache(spark, d):
    """The cache of a year, and a change of it as a table of its own."""
    obs = year(spark, d)
    new = obs.filter("indicator_code = 'Brand#3' AND source_page >= 3").withColumn("value", F.col("value") + 5)
    return ScoreCache.build(obs, indicators(spark), "indicator_neutral_v1"), staged(new, "changes")


def change_cache(cache, new):
    return cache.apply(new).ranking()


@query("stream_rescoring", sql_with(CHANGED, "obs AS (SELECT company_code, company_name, report_year, indicator_code, CASE WHEN indicator_code IN ('Brand#3', 'Brand#12') AND source_page >= 3 THEN value + 5 "
    "WHEN indicator_code = 'Brand#22' AND value > 30 THEN NULL ELSE value END AS value, CASE WHEN indicator_code = 'Brand#22' AND value > 30 THEN 'not_applicable' ELSE status END AS status, source_url, source_file, source_page, evidence_text, confidence, _ord FROM obs0)",
    *CHAIN[1:], f"{RANKED} WHERE strategy = 'indicator_neutral_v1'"))
def stream_rescoring(spark, d):
    """The ranking after a stream of changes, in three files that arrive one after the other; the first and the last change the same cells."""
    obs = year(spark, d)
    cache = ScoreCache.build(obs, indicators(spark), "indicator_neutral_v1")
    higher = obs.filter("indicator_code IN ('Brand#3', 'Brand#12') AND source_page >= 3")
    feed = [higher.withColumn("value", F.col("value") * 2), obs.filter("indicator_code = 'Brand#22' AND value > 30").withColumns({"value": F.lit(None).cast("double"), "status": F.lit("not_applicable")}), higher.withColumn("value", F.col("value") + 5)]
    for part in feed:
        part.select(*CHANGE_COLUMNS).coalesce(1).write.mode("append").parquet(f"{cache.root}/feed")
    return rescored(spark, f"{cache.root}/feed", cache, f"{cache.root}/stream").ranking()


@query("number_format", "SELECT s_suppkey, CASE WHEN x LIKE '%.%' THEN regexp_replace(regexp_replace(x, '0+$', ''), '\\.$', '') ELSE x END AS shown "
    "FROM (SELECT s_suppkey, printf('%.4f', s_acctbal) AS x FROM supplier)")
def number_format(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", plain_number(F.col("s_acctbal")).alias("shown"))

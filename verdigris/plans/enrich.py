"""Queries of enrichment over the star schema, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdigris.functions.numeric import rounded
from verdigris.operators import enrich as ops
from verdigris.plans.binding import OBS, YEAR, code, observations, sql_round, sql_with, table

QUERIES, ORACLE_SQL = {}, {}


def query(name, sql=None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


# Facts of a customer's year: sums of order prices by status and priority, in cents so that sums are exact.
FACTS = {
    "revenue": "true", "operating_profit": "o_orderstatus = 'O'", "net_profit": "o_orderstatus = 'F'", "cost_expense_total": "o_orderstatus = 'P'", "rd_investment": "o_orderpriority = '1-URGENT'",
    "environmental_investment": "o_orderpriority = '2-HIGH'", "public_welfare_investment": "o_orderpriority = '3-MEDIUM'", "cash_received_operating": "o_orderpriority = '5-LOW'", "liabilities_end": "o_orderkey % 3 = 0", "assets_end": "o_orderkey % 3 <> 1",
    "assets_begin": "o_orderkey % 2 = 0", "equity_begin": "o_orderkey % 5 = 0", "equity_end": "o_orderkey % 5 <> 1", "ebit": "o_orderkey % 7 <> 0", "interest_expense": "o_orderkey % 7 = 1", "current_assets_end": "o_orderkey % 4 <> 0", "inventory_end": "o_orderkey % 4 = 1", "accounts_receivable_end": "o_orderkey % 4 = 2",
}
CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"
FACT_SQL = "fact AS (SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS y, " + ", ".join(f"sum({CENTS}) FILTER ({c})::DOUBLE AS {n}" for n, c in FACTS.items()) + " FROM orders GROUP BY 1, 2)"
RULES_SQL = {
    "Q_S_ENV_INVEST_RATE": "environmental_investment / revenue * 100", "Q_S_RD_RATE": "rd_investment / revenue * 100", "Q_S_DONATION_RATE": "public_welfare_investment / revenue * 100", "Q_G_ROE": "net_profit / nullif((equity_begin + equity_end) / 2, 0) * 100",
    "Q_G_ROA": "ebit / ((assets_begin + assets_end) / 2) * 100", "Q_G_OPERATING_MARGIN": "operating_profit / revenue * 100", "Q_G_CASH_REALIZATION": "cash_received_operating / revenue * 100", "Q_G_COST_REVENUE_RATE": "cost_expense_total / revenue * 100",
    "Q_G_ASSET_TURNOVER": "revenue / ((assets_begin + assets_end) / 2)", "Q_G_TWO_FUNDS_RATE": "(accounts_receivable_end + inventory_end) / current_assets_end * 100", "Q_G_DEBT_ASSET_RATE": "liabilities_end / assets_end * 100", "Q_G_EBITDA_INTEREST": "ebit / interest_expense", "Q_G_CAPITAL_ACCUMULATION": "(equity_end - equity_begin) / equity_begin * 100",
    "Q_G_REVENUE_GROWTH": "(revenue - revenue_previous) / revenue_previous * 100", "Q_G_OPERATING_PROFIT_GROWTH": "(operating_profit - operating_profit_previous) / operating_profit_previous * 100",
}


def facts(spark, d):
    o = table(spark, d, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    wide = o.groupBy(F.col("o_custkey").alias("company_code"), F.year("o_orderdate").alias("report_year")).agg(*[F.sum(F.when(F.expr(c), cents)).cast("decimal(28,8)").alias(n) for n, c in FACTS.items()])
    long = wide.unpivot(["company_code", "report_year"], list(FACTS), "fact_code", "value").filter("value IS NOT NULL")
    before = long.filter("fact_code IN ('revenue', 'operating_profit')").select("company_code", (F.col("report_year") + 1).alias("report_year"), F.concat("fact_code", F.lit("_previous")).alias("fact_code"), "value")
    return long.unionByName(before)


@query("derive_financial", sql_with(FACT_SQL, "g AS (SELECT f.*, p.revenue AS revenue_previous, p.operating_profit AS operating_profit_previous FROM fact f LEFT "
    "JOIN fact p ON p.o_custkey = f.o_custkey AND p.y = f.y - 1)", " UNION ALL ".join(f"SELECT o_custkey AS company_code, y AS report_year, '{k}' AS indicator_code, {sql_round(v, 4)} AS value FROM g WHERE ({v}) IS NOT NULL" for k, v in RULES_SQL.items())))
def derive_financial(spark, d):
    known = facts(spark, d)
    years = known.filter("fact_code = 'revenue'").select("company_code", "report_year")  # not those that only have a year before
    return ops.derive_financial(known.join(years, ["company_code", "report_year"], "left_semi")).withColumn("value", rounded(F.col("value"), 4))


@query("repeated_facts", "SELECT o_custkey AS company_code, CAST(year(o_orderdate) AS INTEGER) AS report_year, o_orderpriority AS fact_code, count(*) AS n FROM orders "
    "GROUP BY 1, 2, 3 HAVING count(*) > 1")
def repeated_facts(spark, d):
    return ops.repeated_facts(table(spark, d, "orders").select(F.col("o_custkey").alias("company_code"), F.year("o_orderdate").alias("report_year"), F.col("o_orderpriority").alias("fact_code")))


RULES = [("Brand#20", "Brand#1", "Brand#2", 0.0, 1.5), ("Brand#21", "Brand#3", "Brand#4", 0.5, 3.0), ("Brand#22", "Brand#5", "Brand#6", 0.0, 100.0), ("Brand#23", "Brand#7", "Brand#8", 0.9, 1.1)]
CONF = f"k AS (SELECT company_code, report_year, indicator_code, value, confidence FROM obs WHERE status = 'confirmed' AND value IS NOT NULL), cy AS (SELECT DISTINCT company_code, report_year FROM k)"


def _rule_sql(r):
    t, a, b, lo, hi = r
    return f"""SELECT cy.company_code, cy.report_year, '{t}' AS indicator_code, x.value AS num, y.value AS den, least(x.confidence, y.confidence) AS sure, {lo} AS lo, {hi} AS hi, z.value AS own
  FROM cy LEFT JOIN k x ON x.company_code = cy.company_code AND x.report_year = cy.report_year AND x.indicator_code = '{a}' LEFT JOIN k y ON y.company_code = cy.company_code AND y.report_year = cy.report_year AND y.indicator_code = '{b}' LEFT JOIN k z ON z.company_code = cy.company_code AND z.report_year = cy.report_year AND z.indicator_code = '{t}'"""


FORMULA = "WITH " + ",\n".join([OBS, CONF, "r AS (" + " UNION ALL ".join(map(_rule_sql, RULES)) + "), rr AS (SELECT *, CASE WHEN num IS NULL OR den IS NULL THEN 'missing_sources' WHEN sure < 0.5 THEN 'low_confidence' "
    "WHEN den <= 0 THEN 'non_positive_denominator' WHEN num / den < lo OR num / den > hi THEN 'out_of_range' ELSE 'derived' END AS reason FROM r "
    "WHERE own IS NULL)"])


@query("derive_formula", FORMULA + f"\nSELECT company_code, report_year, indicator_code, reason, CASE WHEN reason = 'derived' THEN {sql_round('num / den', 6)} END AS value, CASE WHEN reason = 'derived' THEN {sql_round('sure * 0.9', 6)} END AS confidence FROM rr")
def derive_formula(spark, d):
    return ops.derive_formulas(observations(spark, d), RULES)


@query("derive_failures", FORMULA + "\nSELECT indicator_code, reason, count(*) AS n FROM rr WHERE reason <> 'derived' GROUP BY 1, 2")
def derive_failures(spark, d):
    return ops.derive_formulas(observations(spark, d), RULES).filter("reason <> 'derived'").groupBy("indicator_code", "reason").agg(F.count(F.lit(1)).alias("n"))


#: Brands as the indicators of the shipped rules: the totals and amounts first, then what they are divided by, then some targets.
SOURCES = list(dict.fromkeys([r[1] for r in ops.FORMULA_RULES] + [r[2] for r in ops.FORMULA_RULES] + ["Q_E_GHG_INTENSITY", "Q_G_ROA"]))
NAMED = ", ".join(f"('Brand#{i}', '{c}')" for i, c in enumerate(SOURCES, 1))
SHIPPED = "WITH " + ",\n".join([
    OBS.replace("obs AS", "obs0 AS"), f"obs AS (SELECT o.* REPLACE (c AS indicator_code) FROM obs0 o JOIN (VALUES {NAMED}) AS n(b, c) ON o.indicator_code = n.b)", CONF, "r AS (" + " UNION ALL ".join(map(_rule_sql, ops.FORMULA_RULES)) + ")",
    "rr AS (SELECT *, CASE WHEN num IS NULL OR den IS NULL THEN 'missing_sources' WHEN sure < 0.5 THEN 'low_confidence' WHEN den <= 0 THEN 'non_positive_denominator' WHEN num / den < lo OR num / den > hi THEN 'out_of_range' ELSE 'derived' END AS reason FROM r WHERE own IS NULL)"])


@query("derive_shipped_rules", SHIPPED + f"\nSELECT company_code, report_year, indicator_code, reason, CASE WHEN reason = 'derived' THEN {sql_round('num / den', 6)} END AS value FROM rr")
def derive_shipped_rules(spark, d):
    """The fourteen shipped rules over observations whose brands stand for their indicators."""
    names = F.create_map(*[F.lit(x) for i, c in enumerate(SOURCES, 1) for x in (f"Brand#{i}", c)])
    obs = observations(spark, d).withColumn("indicator_code", F.try_element_at(names, F.col("indicator_code"))).filter("indicator_code IS NOT NULL")
    return ops.derive_formulas(obs).drop("confidence")


UNITS = "VALUES ('view', 'u1', 1000.0, 0.0, 50000.0), ('click', 'u2', 0.001, 0.0, 1.0), ('error', 'u1', 10.0, 0.0, 1e9), ('purchase', 'u0', 1.0, 5.0, 20.0)"


@query("unit_convert", f"WITH r(indicator_code, unit, factor, low, high) AS ({UNITS}) SELECT event_id, CASE WHEN factor IS NULL THEN 'unknown_unit' WHEN value * factor < low OR value * factor > high THEN 'out_of_range' ELSE 'converted' END AS state, {sql_round('value * factor', 4)} AS converted FROM (SELECT *, 'u' || CAST(event_id % 3 AS VARCHAR) AS unit FROM events) e LEFT JOIN r ON r.indicator_code = e.event_type AND r.unit = e.unit")
def unit_convert(spark, d):
    rules = spark.sql(f"SELECT * FROM {UNITS} AS t(indicator_code, unit, factor, low, high)").withColumns({c: F.col(c).cast("double") for c in ("factor", "low", "high")})
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("indicator_code"), F.concat(F.lit("u"), (F.col("event_id") % 3).cast("string")).alias("unit"), "value")
    return ops.convert_units(e, rules).select("event_id", "state", rounded(F.col("converted"), 4).alias("converted"))


@query("intensity_from_absolute", f"SELECT l_suppkey, {sql_round('q * CASE WHEN l_suppkey % 2 = 0 THEN 1000.0 ELSE 1.0 END * 10000 / p', 6)} AS intensity, CASE WHEN (q0 - q) / q0 * 100 BETWEEN -1000 AND 100 THEN {sql_round('(q0 - q) / q0 * 100', 6)} END AS reduction FROM (SELECT l_suppkey, sum(l_quantity) FILTER (year(l_shipdate) = {YEAR}) AS q, sum(l_quantity) FILTER (year(l_shipdate) = {YEAR - 1}) AS q0, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) FILTER (year(l_shipdate) = {YEAR}) AS DOUBLE) AS p FROM lineitem GROUP BY 1)")
def intensity_from_absolute(spark, d):
    now, before = F.year("l_shipdate") == YEAR, F.year("l_shipdate") == YEAR - 1
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    s = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum(F.when(now, F.col("l_quantity"))).alias("q"), F.sum(F.when(before, F.col("l_quantity"))).alias("q0"), F.sum(F.when(now, cents)).cast("double").alias("p"))
    return s.select("l_suppkey", rounded(ops.intensity(F.col("q"), F.col("p"), F.col("l_suppkey") % 2 == 0), 6).alias("intensity"), rounded(ops.reduction(F.col("q0"), F.col("q")), 6).alias("reduction"))


PRED = f"""k AS (SELECT company_code, indicator_code, report_year, CAST(report_year AS DOUBLE) AS x, value AS y FROM obs WHERE status = 'confirmed' AND report_year < 2001),
w AS (SELECT *, lag(y) OVER p AS py, row_number() OVER p AS i, count(*) OVER (PARTITION BY company_code, indicator_code) AS n, avg(y) OVER (PARTITION BY company_code, indicator_code) AS my, avg(x) OVER (PARTITION BY company_code, indicator_code) AS mx FROM k WINDOW p AS (PARTITION BY company_code, indicator_code ORDER BY x)),
a AS (SELECT company_code, indicator_code, any_value(n) AS n, any_value(my) AS my, any_value(mx) AS mx, max(x) AS lx, arg_max(y, x) AS ly, sum((x - mx) * (y - my)) AS sxy, sum((x - mx) * (x - mx)) AS sxx, sum((y - my) * (y - my)) AS syy,
  bool_and(py IS NULL OR y >= py) AS up, bool_and(py IS NULL OR y <= py) AS down, sum(y * power(2.0, i - 1)) / (power(2.0, any_value(n)) - 1) AS ma, avg((y - py) / abs(py)) FILTER (py <> 0) AS g, stddev_samp((y - py) / abs(py)) FILTER (py <> 0) AS gsd FROM w GROUP BY 1, 2),
b AS (SELECT *, 2001 - lx AS gap, CASE WHEN n > 1 THEN sqrt(syy / (n - 1)) ELSE 0 END / abs(my) AS cv FROM a),
m AS (SELECT *, CASE WHEN up OR down THEN 'linear_trend' WHEN cv < 0.2 THEN 'moving_average' WHEN cv < 0.5 THEN 'yoy_growth' ELSE 'last_value' END AS method, CASE WHEN n < 2 THEN 'too_few_points' WHEN cv > 0.5 THEN 'too_variable' ELSE 'predicted' END AS state FROM b),
pv AS (SELECT *, CASE method WHEN 'linear_trend' THEN my + sxy / nullif(sxx, 0) * (2001 - mx) WHEN 'moving_average' THEN ma WHEN 'yoy_growth' THEN ly * power(1 + g, gap) ELSE ly END AS v,
  CASE method WHEN 'linear_trend' THEN least(greatest(CASE WHEN syy > 0 THEN 1 - (syy - sxy * sxy / sxx) / syy ELSE 0 END * (1 - 0.1 * gap), 0.3), 0.9) WHEN 'moving_average' THEN least(greatest(1 - cv, 0.4), 0.9) WHEN 'yoy_growth' THEN CASE WHEN g <> 0 AND gsd IS NOT NULL THEN least(greatest(1 - gsd / abs(g) / 2, 0.3), 0.8) ELSE 0.3 END ELSE 0.4 END AS sure FROM m)"""


@query("predict_values", sql_with(OBS, PRED, f"SELECT company_code, indicator_code, 2001 AS report_year, CAST(n AS INTEGER) AS points, state, CASE WHEN state = 'predicted' THEN method END AS method, CASE WHEN state = 'predicted' THEN {sql_round('v', 6)} END AS value, CASE WHEN state = 'predicted' THEN {sql_round('sure', 6)} END AS confidence FROM pv"))
def predict_values(spark, d):
    return ops.predict(observations(spark, d), 2001)


@query("predict_methods", sql_with(OBS, PRED, "SELECT state, CASE WHEN state = 'predicted' THEN method END AS method, count(*) AS n FROM pv GROUP BY 1, 2"))
def predict_methods(spark, d):
    return ops.predict(observations(spark, d), 2001).groupBy("state", "method").agg(F.count(F.lit(1)).alias("n"))


def industries(spark, d):
    return table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).select(code("s_suppkey").alias("company_code"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("industry"))


INDUSTRY = "home AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS company_code, 'R' || CAST(n_regionkey AS VARCHAR) AS industry FROM supplier JOIN nation ON s_nationkey = n_nationkey), mark AS (SELECT industry, indicator_code, count(*) AS n, avg(value) AS mean, quantile_cont(value, 0.5) AS median, coalesce(stddev_samp(value), 0) AS sd, min(value) AS low, max(value) AS high FROM obs JOIN home USING (company_code) WHERE status = 'confirmed' GROUP BY 1, 2 HAVING count(*) >= 10), bench AS (SELECT *, least(1.0, n / 30) * CASE WHEN mean <> 0 THEN least(greatest(1 - abs(sd / mean) / 2, 0.3), 1.0) ELSE 0.3 END * 0.7 AS confidence FROM mark)"


@query("industry_benchmarks", sql_with(OBS, INDUSTRY, f"SELECT industry, indicator_code, n, {sql_round('mean', 6)} AS mean, median, {sql_round('sd', 6)} AS sd, low, high, {sql_round('confidence', 6)} AS confidence FROM bench"))
def industry_benchmarks(spark, d):
    return ops.industry_benchmarks(observations(spark, d), industries(spark, d)).withColumns({c: rounded(F.col(c), 6) for c in ("mean", "sd", "confidence")})


@query("impute_missing", sql_with(OBS, INDUSTRY, f"cells AS (SELECT company_code, indicator_code FROM (SELECT DISTINCT company_code FROM obs WHERE report_year = {YEAR}) c CROSS JOIN (SELECT 'Brand#' || CAST(i AS VARCHAR) AS indicator_code FROM range(1, 11) t(i)) g WHERE indicator_code <> 'Brand#7')", f"SELECT c.company_code, {YEAR} AS report_year, c.indicator_code, h.industry, b.median AS value, {sql_round('b.confidence', 6)} AS confidence, b.n AS sample_count FROM cells c JOIN home h USING (company_code) JOIN bench b ON b.industry = h.industry AND b.indicator_code = c.indicator_code WHERE (c.company_code, c.indicator_code) NOT IN (SELECT (company_code, indicator_code) FROM obs WHERE report_year = {YEAR} AND status = 'confirmed')"))
def impute_missing(spark, d):
    return ops.impute(observations(spark, d), industries(spark, d), YEAR, [f"Brand#{i}" for i in range(1, 11)], ["Brand#7"])


@query("impute_upper_median", sql_with(OBS, "SELECT indicator_code, report_year, count(*) AS n, list_sort(list(value))[len(list(value)) // 2 + 1] AS upper_median FROM obs "
    "WHERE status = 'confirmed' GROUP BY 1, 2 HAVING count(*) >= 3"))
def impute_upper_median(spark, d):
    return ops.upper_median(observations(spark, d), ["indicator_code", "report_year"])

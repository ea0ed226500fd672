"""Star-schema tables read as the observation model: companies are suppliers, indicators are brands, years are ship years.

Each view has its SQL twin below, for checks by another engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

YEAR = 1998


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def code(col: str):
    return F.lpad(F.col(col).cast("string"), 6, "0")


def observations(spark: SparkSession, sf_dir: str, year: int | None = None) -> DataFrame:
    """One row per supplier, ship year and brand: the mean quantity, with a status and confidence made from the keys."""
    lines = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey", "l_partkey", "l_quantity", "year(l_shipdate) AS report_year")
    if year is not None:
        lines = lines.filter(f"report_year = {year}")
    cells = (
        lines.join(table(spark, sf_dir, "part").selectExpr("p_partkey AS l_partkey", "p_brand"), "l_partkey")
        .groupBy("l_suppkey", "report_year", "p_brand").agg(F.expr("avg(l_quantity) AS value"), F.expr("count(*) AS n"))
    )
    suppliers = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS l_suppkey", "s_name")
    numbered = cells.join(suppliers, "l_suppkey").selectExpr("*", "CAST(substring(p_brand, 7, 9) AS INT) AS b", "lpad(CAST(l_suppkey AS STRING), 6, '0') AS company_code")
    return numbered.selectExpr(
        "company_code", "s_name AS company_name", "report_year", "p_brand AS indicator_code", "value",
        "CASE (l_suppkey * 7 + b * 3 + report_year) % 13 WHEN 0 THEN 'pending' WHEN 1 THEN 'derived' WHEN 2 THEN 'predicted' WHEN 3 THEN 'imputed' "
    "WHEN 4 THEN 'not_applicable' ELSE 'confirmed' END AS status",
        "concat('https://example.org/', company_code) AS source_url", "concat('report-', CAST(report_year AS STRING)) AS source_file", "CAST(n AS INT) AS source_page", "concat('brand ', CAST(b AS STRING)) AS evidence_text", "0.5D + (n % 6) / 10.0D AS confidence", "CAST(b AS LONG) AS _ord",
    )


def indicators(spark: SparkSession) -> DataFrame:
    """25 indicators made from the brand numbers; the weights of each kind sum to 100."""
    i = F.col("i")
    weight = F.when(i <= 17, (1 + i % 4) * 100.0 / 42).otherwise((1 + i % 4) * 5.0)
    return spark.range(1, 26).withColumnRenamed("id", "i").select(
        F.concat(F.lit("Brand#"), i.cast("string")).alias("code"), F.element_at(F.array(*map(F.lit, "ESG")), (i % 3 + 1).cast("int")).alias("dimension"), F.lit("").alias("level2"), F.concat(F.lit("brand "), i.cast("string")).alias("name"),
        F.when(i <= 17, "quantitative").otherwise("qualitative").alias("kind"), weight.alias("weight"), F.when(i % 4 == 0, "bidirectional").when(i % 4 == 2, "negative").otherwise("positive").alias("direction"),
        F.lit("u").alias("unit"), F.lit("").alias("formula"), F.when(i % 5 == 0, F.lit(26.0)).alias("benchmark"), (i <= 10).alias("key_indicator"),
    )


def candidates(spark: SparkSession, sf_dir: str, year: int = YEAR) -> DataFrame:
    """Pending candidates: one per line item of the year, several to a cell, whose values may disagree."""
    lines = table(spark, sf_dir, "lineitem").filter(F.year("l_shipdate") == year)
    joined = lines.join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    n = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    return joined.select(
        code("l_suppkey").alias("company_code"), F.lit(year).alias("report_year"), F.col("p_brand").alias("indicator_code"), F.floor(F.col("l_quantity") / 25).cast("double").alias("value"),
        F.concat(F.when(n % 3 == 0, "esg-").otherwise("annual-"), F.col("l_orderkey").cast("string")).alias("source_file"), F.col("l_linenumber").alias("source_page"),
        (0.75 + (n % 6) / 20.0).alias("confidence"), F.concat(F.lit("order "), F.col("l_orderkey").cast("string"), F.lit(" line "), F.col("l_linenumber").cast("string"), F.lit(" part "), F.col("l_partkey").cast("string"), F.lit(" q "), F.col("l_quantity").cast("int").cast("string"), F.lit(" p "), F.floor("l_extendedprice").cast("string")).alias("evidence_text"),
    )


# SQL twins, as common table expressions.
OBS = """obs AS (
  SELECT lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS company_code, s_name AS company_name, report_year, indicator_code, value,
    CASE m WHEN 0 THEN 'pending' WHEN 1 THEN 'derived' WHEN 2 THEN 'predicted' WHEN 3 THEN 'imputed' WHEN 4 THEN 'not_applicable' ELSE 'confirmed' END AS status,
    'https://example.org/' || lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS source_url, 'report-' || CAST(report_year AS VARCHAR) AS source_file, CAST(n AS INTEGER) AS source_page,
    'brand ' || CAST(b AS VARCHAR) AS evidence_text, 0.5 + (n % 6) / 10.0 AS confidence, CAST(b AS BIGINT) AS _ord

  FROM (SELECT l_suppkey, CAST(year(l_shipdate) AS INTEGER) AS report_year, p_brand AS indicator_code, CAST(substr(p_brand, 7) AS INTEGER) AS b, avg(l_quantity) AS value, count(*) AS n,
      (l_suppkey * 7 + CAST(substr(p_brand, 7) AS INTEGER) * 3 + year(l_shipdate)) % 13 AS m
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL) c JOIN supplier ON l_suppkey = s_suppkey
)"""
IND = """ind AS (
  SELECT 'Brand#' || CAST(i AS VARCHAR) AS indicator_code, ['E', 'S', 'G'][i % 3 + 1] AS dimension, CASE WHEN i <= 17 THEN 'quantitative' ELSE 'qualitative' END AS kind,
    CASE WHEN i <= 17 THEN (1 + i % 4) * 100.0 / 42 ELSE (1 + i % 4) * 5.0 END::DOUBLE AS weight, CASE i % 4 WHEN 0 THEN 'bidirectional'
  WHEN 2 THEN 'negative' ELSE 'positive' END AS direction,
    CASE WHEN i % 5 = 0 THEN 26.0 END::DOUBLE AS benchmark, i <= 10 AS key_indicator
  FROM range(1, 26) t(i)
)"""
CANDIDATES = f"""cand AS (
  SELECT lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS company_code, {YEAR} AS report_year, p_brand AS indicator_code, floor(l_quantity / 25) AS value,
    CASE WHEN (l_orderkey * 7 + l_linenumber) % 3 = 0 THEN 'esg-' ELSE 'annual-' END || CAST(l_orderkey AS VARCHAR) AS source_file, l_linenumber AS source_page,
    0.75 + ((l_orderkey * 7 + l_linenumber) % 6) / 20.0 AS confidence,
    'order ' || l_orderkey || ' line ' || l_linenumber || ' part ' || l_partkey || ' q ' || CAST(l_quantity AS INTEGER) || ' p ' || CAST(floor(l_extendedprice) AS BIGINT) AS evidence_text
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE year(l_shipdate) = {YEAR}
)"""


def sql_round(x: str, digits: int) -> str:
    scale = f"1{'0' * digits}.0"
    return f"(floor(({x}) * CAST({scale} AS DOUBLE) + 0.5) / CAST({scale} AS DOUBLE))"


def sql_erf(x: str) -> str:
    """The error function by its series of positive terms."""
    return (
        f"(CASE WHEN {x} = 0 THEN 0.0 WHEN abs({x}) > 6 THEN sign({x}) ELSE sign({x}) * 2 / sqrt(pi()) * exp(-({x}) * ({x})) * "
        f"list_sum(list_transform(range(0, 150), lambda n: exp((2 * n + 1) * ln(abs({x})) + 2 * n * ln(2.0) + lgamma(n + 1.0) - lgamma(2 * n + 2.0)))) END)"
    )


def sql_with(*parts: str) -> str:
    """WITH of all parts but the last, which is the query."""
    return "WITH " + ",\n".join(parts[:-1]) + "\n" + parts[-1]

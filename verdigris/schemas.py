"""Table schemas, enumerations and the indicator table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATUSES = ("confirmed", "pending", "missing", "not_applicable", "derived", "predicted", "imputed")
DIRECTIONS = ("positive", "negative", "bidirectional")
STRATEGIES = ("legacy_zero_v1", "indicator_neutral_v1", "disclosed_weight_v1")
DIMENSIONS = ("E", "S", "G")
KINDS = ("quantitative", "qualitative")

_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "decimal(28,8)": T.DecimalType(28, 8)}


def _schema(text: str) -> T.StructType:
    """A flat schema from 'name type' pairs, without a running session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (field.split() for field in text.split(", "))])


OBSERVATION = _schema(
    "company_code string, company_name string, report_year int, indicator_code string, value double, status string, "
    "source_url string, source_file string, source_page int, evidence_text string, confidence double"
)
INDICATOR = _schema(
    "code string, dimension string, level2 string, name string, kind string, weight double, direction string, unit string, formula string, benchmark double, key_indicator boolean"
)
FINANCIAL_FACT = _schema("company_code string, company_name string, report_year int, fact_code string, value decimal(28,8), source_url string, source_file string, source_page int")
UNIVERSE = _schema("stock_code string, company_name string, exchange string, sub_industry string, included boolean, exclusion_reason string, entity_id string, source_url string, as_of_date string")
DOCUMENT = _schema("company_code string, company_name string, report_year int, document_type string, source_url string, retrieval_url string, local_path string, sha256 string, size long")
KEY = ["company_code", "report_year", "indicator_code"]


def methodology(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """The indicator table and the parameters (ratios, policy, version) of a methodology file in JSON."""
    raw = spark.read.json(path, multiLine=True)
    indicators = raw.select(F.explode("indicators").alias("i")).select("i.*")
    for field in INDICATOR:
        if field.name not in indicators.columns:
            indicators = indicators.withColumn(field.name, F.lit(None).cast(field.dataType))
    indicators = indicators.select(*[F.col(f.name).cast(f.dataType) for f in INDICATOR])
    head = raw.drop("indicators").first().asDict()
    return indicators, {"quantitative_ratio": 0.8, "qualitative_ratio": 0.2, **{k: v for k, v in head.items() if v is not None}}


def methodology_faults(indicators: DataFrame) -> DataFrame:
    """(fault, detail): repeated codes, unknown kinds, dimensions or directions, and kinds whose weights do not sum to 100."""
    repeated = indicators.groupBy("code").count().filter("count > 1").select(F.lit("repeated_code").alias("fault"), F.col("code").alias("detail"))
    weights = indicators.groupBy("kind").agg(F.sum("weight").alias("w")).filter(F.abs(F.col("w") - 100) > 0.01).select(F.lit("weights_not_100").alias("fault"), F.col("kind").alias("detail"))
    checks = [("kind", KINDS), ("dimension", DIMENSIONS), ("direction", DIRECTIONS)]
    for column, allowed in checks:
        bad = indicators.filter(~F.col(column).isin(*allowed)).select(F.lit(f"unknown_{column}").alias("fault"), F.col("code").alias("detail"))
        repeated = repeated.unionByName(bad)
    return repeated.unionByName(weights)

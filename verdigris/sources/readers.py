"""Readers: CSV with byte-order marks and checked headers, page texts, listings, code lists, and their faults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from verdigris.schemas import FINANCIAL_FACT, OBSERVATION, STATUSES, UNIVERSE

BOM = "﻿"


def read_csv(spark: SparkSession, path: str, required: list[str], aliases: dict[str, str] | None = None, sep: str = ",") -> DataFrame:
    """All columns as trimmed text, empty as null; header names normalised and renamed; missing ones are an error."""
    df = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("sep", sep).csv(path)
    clean = [c.replace(BOM, "").strip() for c in df.columns]
    named = [(aliases or {}).get(c, c) for c in clean]
    df = df.toDF(*named)
    missing = [c for c in required if c not in named]
    if missing:
        raise ValueError(f"{path} lacks the columns {', '.join(missing)}")
    strip = lambda c: F.nullif(F.trim(F.replace(F.col(f"`{c}`"), F.lit("\x00"), F.lit(""))), F.lit(""))
    return df.select(*[strip(c).alias(c) for c in named])


def typed(df: DataFrame, schema: StructType) -> DataFrame:
    """Columns of a schema; numbers may carry thousands commas, values that do not parse become null."""
    out = []
    for field in schema:
        if field.name not in df.columns:
            out.append(F.lit(None).cast(field.dataType).alias(field.name))
        elif field.dataType.typeName() in ("integer", "long", "double", "decimal"):
            out.append(F.regexp_replace(field.name, ",", "").try_cast(field.dataType).alias(field.name))
        elif field.dataType.typeName() == "boolean":
            out.append(F.lower(field.name).isin("1", "true", "yes", "y", "是").alias(field.name))
        else:
            out.append(F.col(field.name))
    return df.select(*out)


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    raw = read_csv(spark, path, ["company_code", "report_year", "indicator_code", "value", "status"])
    return typed(raw, OBSERVATION).withColumns({"company_code": F.upper("company_code"), "_ord": F.monotonically_increasing_id()})


def observation_faults(obs: DataFrame, indicators: DataFrame) -> DataFrame:
    """Rows that a batch must not hold: unknown indicators or statuses, confirmed rows without a value."""
    known = F.broadcast(indicators.select(F.col("code").alias("indicator_code"), F.lit(True).alias("_known")))
    fault = F.when(F.col("_known").isNull(), "unknown_indicator").when(~F.col("status").isin(*STATUSES), "unknown_status").when((F.col("status") == "confirmed") & F.col("value").isNull(), "confirmed_without_value")
    return obs.join(known, "indicator_code", "left").withColumn("fault", fault).filter("fault IS NOT NULL").drop("_known")


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    return typed(read_csv(spark, path, ["company_code", "report_year", "fact_code", "value"]), FINANCIAL_FACT)


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    from verdigris.operators.universe import exchange_of

    df = typed(read_csv(spark, path, ["stock_code", "company_name"]), UNIVERSE)
    df = df.withColumn("stock_code", F.upper("stock_code"))
    return df.withColumns({"exchange": F.coalesce("exchange", exchange_of(F.col("stock_code"))), "entity_id": F.coalesce("entity_id", "stock_code")})


HEADER_ALIASES = {"证券代码": "stock_code", "股票代码": "stock_code", "代码": "stock_code", "证券简称": "company_name", "公司名称": "company_name", "公司简称": "company_name", "所属行业": "industry", "行业": "industry", "交易所": "exchange"}


def read_snapshot(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    return read_csv(spark, path, ["stock_code", "company_name"], HEADER_ALIASES, sep)


def read_page_texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, page, page_text) of text exports whose pages follow marks."""
    from verdigris.operators.text import split_pages

    files = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    return split_pages(files, "value", ["file"])


def read_or_empty(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A Parquet table, or an empty one where the path holds none yet."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def parse_listings(df: DataFrame, payload: str, rows: str = "data", code: str = "code", name: str = "name") -> DataFrame:
    """Listing rows of JSON pages: page, total, code, name."""
    schema = f"struct<page:int,total:int,{rows}:array<struct<{code}:string,{name}:string>>>"
    p = F.from_json(payload, schema)
    return df.select(p["page"].alias("page"), p["total"].alias("total"), F.explode(p[rows]).alias("r")).select("page", "total", F.col("r")[code].alias("stock_code"), F.col("r")[name].alias("company_name"))


def listing_faults(rows: DataFrame) -> DataFrame:
    """Paging faults: totals that differ, rows that do not add up, repeated codes."""
    one = rows.agg(F.count_distinct("total").alias("totals"), F.max("total").alias("total"), F.count(F.lit(1)).alias("n"), F.count_distinct("stock_code").alias("codes"))
    checks = F.array_compact(F.array(F.when(F.col("totals") > 1, F.lit("totals_differ")), F.when(F.col("n") != F.col("total"), F.lit("row_count_differs")), F.when(F.col("codes") < F.col("n"), F.lit("repeated_codes"))))
    return one.select(F.explode(checks).alias("fault"))


def listed_codes(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Security codes in a text in the order of their first mention."""
    found = F.regexp_extract_all(text, F.lit(r"(?<!\d)(\d{5,6}\.(?:SH|SZ|HK|BJ))"), F.lit(1))
    return df.select(*keep, F.posexplode(found).alias("at", "stock_code")).groupBy(*keep, "stock_code").agg(F.min("at").alias("at"))


def first_existing(df: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """The path of the smallest priority that exists for each key."""
    best = candidates.filter("exists").groupBy(key).agg(F.min_by("path", "priority").alias("path"))
    return df.join(best, key, "left")


def equity_list(df: DataFrame) -> DataFrame:
    """Rows of an exchange's full list that are shares of its main or growth board, with padded codes."""
    board = F.col("category").isin("Equity") & F.col("sub_category").isin("Equity Securities (Main Board)", "Equity Securities (GEM)")
    return df.filter(board).select(F.concat(F.lpad(F.regexp_extract("stock_code", r"(\d+)", 1), 5, "0"), F.lit(".HK")).alias("stock_code"), F.trim("company_name").alias("company_name"))


def table_cells(df: DataFrame, html: str, keep: list[str]) -> DataFrame:
    """Rows of HTML tables as arrays of cell texts."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    one = df.select(*keep, F.posexplode(rows).alias("row", "r"))
    cells = F.transform(F.regexp_extract_all("r", F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda c: F.trim(F.regexp_replace(c, "<[^>]+>", "")))
    return one.select(*keep, "row", cells.alias("cells"))


def embedded_payload(df: DataFrame, page: str, name: str, schema: str, keep: list[str]) -> DataFrame:
    """The JSON object that a page's script assigns to a name."""
    text = F.regexp_extract(page, rf"(?s){name}\s*=\s*(\{{.*?\}})\s*;", 1)
    return df.select(*keep, F.from_json(F.nullif(text, F.lit("")), schema).alias("p")).select(*keep, "p.*")


def unclassified(industry: Column) -> Column:
    """Blank, to be classified, or to be checked."""
    t = F.trim(F.coalesce(industry, F.lit("")))
    return (t == "") | t.contains("待分类") | (t.contains("待") & t.contains("复核"))

"""Exchange listings as JSON pages of any of their layouts, and whether the pages make one whole list."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Where rows, paging and fields stand, by exchange layouts.
ROWS = ("$.data", "$.rows", "$.list", "$.result", "$.records")
NESTED_ROWS = ("$.data.rows", "$.data.list", "$.data.result", "$.data.records", "$.data.data")
HELP_ROWS = ("$.result", "$.pageHelp.data")
TOTAL_KEYS, COUNT_KEYS, PAGE_KEYS = ("total", "totalCount", "recordcount", "total_count"), ("pageCount", "pagecount", "totalPages", "page_count"), ("pageNo", "pageno", "page", "page_no")
CODE_KEYS = ("stock_code", "code", "zqdm", "agdm", "a_stock_code", "company_code", "证券代码", "股票代码", "股份代号")
NAME_KEYS = ("company_name", "name", "zqjc", "gsjc", "agjc", "company_abbr", "sec_name_cn", "证券简称", "股票简称", "股份简称")
INDUSTRY_KEYS = ("industry", "hymc", "sshy", "sshymc", "csrc_code_desc", "行业", "所属行业", "行业名称")
ENTITY_KEYS = ("entity_id", "credit_code", "unified_social_credit_code", "统一社会信用代码")
STATUS_KEYS = ("listing_status", "sszt", "status", "上市状态")
ENDINGS = {"SSE": ("SH", 6), "SZSE": ("SZ", 6), "BSE": ("BJ", 6), "HKEX": ("HK", 5)}
# End of fixed values.


@F.pandas_udf(StringType())
def unescaped(text: pd.Series) -> pd.Series:
    """Character references as characters; only texts that have any are sent here."""
    return text.map(lambda x: None if x is None else html.unescape(x))


def listing_code(raw: Column, exchange: Column) -> Column:
    """A code of an exchange, padded to its width and with its ending; null if it is no number or the exchange is unknown."""
    plain = F.regexp_replace(F.upper(F.trim(raw)), r"\.(SH|SS|SZ|BJ|HK)$", "")
    out = F.lit(None).cast("string")
    for name, (ending, width) in ENDINGS.items():
        padded = F.when(F.length(plain) < width, F.lpad(plain, width, "0")).otherwise(plain)
        out = F.when(F.upper(exchange) == name, F.concat(padded, F.lit(f".{ending}"))).otherwise(out)
    return F.when(plain.rlike(r"^\d+$"), out)


def listing_pages(df: DataFrame, payload: str, page: str, keep: list[str]) -> DataFrame:
    """keep, requested, page_no, page_count, total, rows (a variant array) and fault of each page.

    A page is a list, an object with rows under one of five names, or one level below `data` or `pageHelp`; paging stands
    beside the rows, in the outer object or in `metadata`. not_json, no_rows and page_mismatch are faults of a page.
    """
    whole = F.try_parse_json(F.regexp_replace(F.col(payload), "^﻿", ""))
    # of a list the first object is the page
    root = F.coalesce(F.try_variant_get(whole, "$[0]", "variant"), whole)
    v = df.select(*keep, F.col(page).alias("requested"), whole.isNotNull().alias("_json"), root.alias("_v"))
    at = lambda paths: F.coalesce(*[F.try_variant_get("_v", p, "array<variant>") for p in paths])
    helped = F.when(F.try_variant_get("_v", "$.pageHelp", "map<string,variant>").isNotNull(), at(HELP_ROWS))
    rows = F.coalesce(at(ROWS[:1]), F.when(helped.isNull(), at(ROWS)), F.when(F.try_variant_get("_v", "$.data", "map<string,variant>").isNotNull(), at(NESTED_ROWS)), helped)
    # what stands deeper counts first
    places = ("$.metadata.", "$.pageHelp.", "$.data.", "$.")
    paging = lambda keys: F.coalesce(*[F.try_variant_get("_v", f"{place}{k}", "string").try_cast("int") for place in places for k in keys])
    read = v.select(*keep, "requested", "_json", rows.alias("rows"), paging(TOTAL_KEYS).alias("total"), paging(COUNT_KEYS).alias("page_count"), paging(PAGE_KEYS).alias("page_no"))
    filled = read.withColumns({"total": F.coalesce("total", F.size("rows")), "page_count": F.coalesce("page_count", F.lit(1)), "page_no": F.coalesce("page_no", "requested")})
    fault = F.when(~F.col("_json"), "not_json").when(F.col("rows").isNull() | F.exists("rows", lambda r: F.try_variant_get(r, "$", "map<string,variant>").isNull()), "no_rows").when(F.col("page_no") != F.col("requested"), "page_mismatch")
    return filled.withColumn("fault", fault).drop("_json")


def listing_rows(pages: DataFrame, exchange: str, keep: list[str]) -> DataFrame:
    """keep, page_no, stock_code, company_name, industry, entity_id, listing_status and fault (no_code, no_name) of each row of sound pages.

    Keys are matched whatever their case; the first filled one of a field's names counts.
    """
    items = pages.filter("fault IS NULL").select(*keep, "page_no", F.explode("rows").alias("r")).select(*keep, "page_no", F.try_variant_get("r", "$", "map<string,string>").alias("m"))
    low = items.withColumn("m", F.map_from_entries(F.transform(F.array_distinct(F.transform(F.map_keys("m"), lambda k: F.lower(F.trim(k)))), lambda k: F.struct(k, F.element_at(F.filter(F.transform(F.map_entries("m"), lambda e: F.when(F.lower(F.trim(e["key"])) == k, e["value"])), lambda x: x.isNotNull()), -1)))))
    field = lambda keys: F.coalesce(*[F.nullif(F.trim(F.try_element_at("m", F.lit(k.lower()))), F.lit("")) for k in keys])
    name = F.trim(F.regexp_replace(field(NAME_KEYS), "<[^>]+>", ""))
    found = low.select(*keep, "page_no", F.upper(F.lit(exchange)).alias("exchange"), field(CODE_KEYS).alias("_code"), F.when(name.contains("&"), unescaped(name)).otherwise(name).alias("company_name"), *[field(k).alias(n) for n, k in (("industry", INDUSTRY_KEYS), ("entity_id", ENTITY_KEYS), ("listing_status", STATUS_KEYS))])
    coded = found.withColumn("stock_code", listing_code(F.col("_code"), F.col("exchange")))
    return coded.select(
        *keep, "page_no", "stock_code", "company_name", F.coalesce("industry", F.lit("待分类")).alias("industry"), F.upper(F.coalesce("entity_id", "stock_code")).alias("entity_id"), F.coalesce("listing_status", F.lit("上市")).alias("listing_status"),
        F.when(F.col("stock_code").isNull(), "no_code").when(F.coalesce("company_name", F.lit("")) == "", "no_name").alias("fault"),
    )


def snapshot_faults(pages: DataFrame, rows: DataFrame, keep: list[str]) -> DataFrame:
    """keep, fault: whatever keeps a snapshot's pages from being one whole list.

    Faults of pages and rows; pages that state other totals than the rest; pages that lack or come twice; rows that do not
    add up to the total; codes that occur twice.
    """
    by_page = pages.groupBy(*keep).agg(
        F.collect_set("fault").alias("faults"), F.min("total").alias("low"), F.max("total").alias("high"), F.min("page_count").alias("few"), F.max("page_count").alias("many"), F.count(F.lit(1)).alias("pages"), F.count_distinct("page_no").alias("numbers"))
    by_row = rows.groupBy(*keep).agg(F.count(F.lit(1)).alias("n"), F.collect_set("fault").alias("row_faults"))
    twice = rows.filter("stock_code IS NOT NULL").groupBy(*keep, "stock_code").count().filter("count > 1").select(*keep).distinct().withColumn("twice", F.lit(True))
    both = by_page.join(by_row, keep, "left").join(twice, keep, "left")
    changed = (F.col("low") != F.col("high")) | (F.col("few") != F.col("many"))
    own = F.array_compact(F.array(
        F.when(changed, F.lit("totals_changed")), F.when((F.col("numbers") != F.col("many")) | (F.col("pages") != F.col("many")), F.lit("pages_incomplete")),
        F.when(F.coalesce("n", F.lit(0)) != F.col("high"), F.lit("row_count_differs")), F.when(F.col("twice"), F.lit("repeated_codes"))))
    return both.select(*keep, F.explode(F.array_distinct(F.concat("faults", F.coalesce("row_faults", F.array().cast("array<string>")), own))).alias("fault"))

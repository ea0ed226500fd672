"""Announcement lists of exchanges: JSON answers (one an HTML table), one in a row, as rows of announcements with their report kind.

Each exchange writes its answers in its own shapes; all give stock_code, company_name, published_date, title, source_url and
source. Answers that are no JSON give no rows; `announcement_faults` names them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.operators.text import title_kind, title_preference

# Where the exchanges keep their documents, and the codes' endings.
ORIGINS = {"SSE": "https://www.sse.com.cn", "SZSE": "https://disc.static.szse.cn/", "BSE": "https://www.bse.cn", "CNINFO": "https://static.cninfo.com.cn/", "HKEX": "https://www1.hkexnews.hk"}
ENDINGS = {"SSE": ".SH", "SZSE": ".SZ", "BSE": ".BJ"}
ITEM = {
    "SSE": "SECURITY_CODE string, SECURITY_NAME string, SSEDATE string, TITLE string, URL string",
    "SZSE": "secCode string, stockCode string, code string, secName string, stockName string, attachPath string, attachUrl string, url string, publishTime string, publishDate string, title string, announcementTitle string",
    "BSE": "companyCd string, companyName string, publishDate string, disclosureTitle string, disclosurePostTitle string, destFilePath string",
    "CNINFO": "secCode string, secName string, announcementTitle string, adjunctUrl string, announcementTime string",
}
#: Where a list of items may stand in an answer, in the order of preference.
PLACES = {
    "SSE": ("$.result", "$.pageHelp.data"), "SZSE": ("$.data", "$.result", "$.announcements", "$.data.data", "$.data.list"), "BSE": ("$[0].listInfo.content", "$.data.content"),
    "CNINFO": ("$.announcements",),
}


def filled(*columns: Column) -> Column:
    """The first that is neither null nor empty; empty where none is."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns], F.lit(""))


def first_of(x: Column) -> Column:
    """A text, or the first of a JSON list of texts."""
    return F.when(x.startswith("["), F.get(F.from_json(x, "array<string>"), F.lit(0))).otherwise(x)


def joined(origin: str, path: Column) -> Column:
    return F.when(path.rlike("^https?://"), path).otherwise(F.concat(F.lit(origin.rstrip("/") + "/"), F.regexp_replace(path, "^/+", "")))


def unwrapped(payload: Column) -> Column:
    """JSON, out of the call that JSONP wraps it in, without a byte order mark."""
    text = F.trim(F.regexp_replace(payload, "^﻿", ""))
    return F.coalesce(F.nullif(F.regexp_extract(text, r"(?s)^(?:[\w$.]+)?\((.*)\)\s*;?$", 1), F.lit("")), text)


def items(df: DataFrame, payload: str, source: str, keep: list[str]) -> DataFrame:
    text = unwrapped(F.col(payload))
    lists = []
    for place in PLACES[source]:
        found = F.get_json_object(text, place)
        lists.append(F.when(found.startswith("["), F.from_json(found, f"array<struct<{ITEM[source].replace(' string', ':string').replace(', ', ',')}>>")))
    if source == "BSE":  # containers, each with its announcements, or the announcements themselves
        found = F.coalesce(*[F.get_json_object(text, p) for p in PLACES["BSE"]])
        inner = F.from_json(found, f"array<struct<disclosures:array<struct<{ITEM['BSE'].replace(' string', ':string').replace(', ', ',')}>>>>")
        lists.insert(0, F.nullif(F.flatten(F.filter(F.transform(inner, lambda c: c["disclosures"]), lambda x: x.isNotNull())), F.array().cast(f"array<struct<{ITEM['BSE'].replace(' string', ':string').replace(', ', ',')}>>")))
    return df.select(*keep, F.explode(F.coalesce(*lists)).alias("r"))


def padded(code: Column, width: int) -> Column:
    """A code with leading zeros up to its width; a longer one stays as it is, where lpad() would cut it."""
    return F.when(F.length(code) < width, F.lpad(code, width, "0")).otherwise(code)


def parse_announcements(df: DataFrame, payload: str, source: str, keep: list[str]) -> DataFrame:
    """keep, stock_code, company_name, published_date, title, source_url, source; items without a code or document are left out."""
    rows = items(df, payload, source, keep)
    r = lambda name: F.col(f"r.{name}")
    if source == "SSE":
        code, name, day, title, path = r("SECURITY_CODE"), r("SECURITY_NAME"), r("SSEDATE"), r("TITLE"), r("URL")
    elif source == "SZSE":
        code, name = first_of(filled(r("secCode"), r("stockCode"), r("code"))), first_of(filled(r("secName"), r("stockName")))
        day, title, path = filled(r("publishTime"), r("publishDate")), filled(r("title"), r("announcementTitle")), filled(r("attachPath"), r("attachUrl"), r("url"))
    elif source == "BSE":
        code, name, day, path = r("companyCd"), r("companyName"), r("publishDate"), r("destFilePath")
        title = F.concat(F.coalesce(r("disclosureTitle"), F.lit("")), F.coalesce(r("disclosurePostTitle"), F.lit("")))
    else:
        code, name, title, path = r("secCode"), r("secName"), F.regexp_replace(r("announcementTitle"), "</?em>", ""), r("adjunctUrl")
        day = F.date_format(F.timestamp_millis(r("announcementTime").try_cast("long")), "yyyy-MM-dd")
    code, path = filled(code), filled(path)
    ending = F.lit(ENDINGS[source]) if source in ENDINGS else F.when(code.rlike("^6"), ".SH").when(code.rlike("^[48]|^92"), ".BJ").otherwise(".SZ")
    whole = F.concat(padded(code, 6), ending)
    return rows.filter((code != "") & (path != "")).select(
        *keep, whole.alias("stock_code"), filled(name).alias("company_name"), F.left(filled(day), F.lit(10)).alias("published_date"), filled(title).alias("title"), joined(ORIGINS[source], path).alias("source_url"), F.lit(source).alias("source"),
    )


def parse_title_search(df: DataFrame, page: str, keep: list[str]) -> DataFrame:
    """The same of a title search, which answers with an HTML table: a row for each announcement."""
    found = F.regexp_extract_all(page, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    rows = df.select(*keep, F.explode(found).alias("r")).filter(F.col("r").rlike(r"Release Time"))
    plain = F.trim(F.regexp_replace(F.regexp_replace("r", "(?s)<[^>]+>", " "), r"\s+", " "))
    link = r'(?is)<a\b[^>]*?href\s*=\s*["\']([^"\']+)["\'][^>]*>(.*?)</a>'
    day = F.regexp_replace(F.regexp_extract(plain, r"(\d{2}/\d{2}/\d{4})", 1), r"^(\d{2})/(\d{2})/(\d{4})$", "$3-$2-$1")
    out = rows.select(
        *keep, F.concat(padded(F.regexp_extract(plain, r"Stock Code:\s*(\d+)", 1), 5), F.lit(".HK")).alias("stock_code"),
        F.trim(F.regexp_extract("r", r"(?is)Stock Short Name:\s*(?:<[^>]+>)*\s*([^<]+)", 1)).alias("company_name"), day.alias("published_date"),
        F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract("r", link, 2), "(?s)<[^>]+>", " "), r"\s+", " ")).alias("title"),
        joined(ORIGINS["HKEX"], F.replace(F.regexp_extract("r", link, 1), F.lit("&amp;"), F.lit("&"))).alias("source_url"), F.lit("HKEX").alias("source"),
    )
    return out.filter(F.length("source_url") > len(ORIGINS["HKEX"]) + 1)


def title_search_faults(df: DataFrame, page: str, keep: list[str]) -> DataFrame:
    """Pages that are no title search, name no total, or hold other than their total of rows."""
    total = F.replace(F.regexp_extract(page, r"Total records found:\s*([0-9,]+)", 1), F.lit(","), F.lit("")).try_cast("int")
    n = F.size(F.regexp_extract_all(page, F.lit(r"(?is)<tr\b[^>]*>(?:(?!</tr>).)*Release Time"), F.lit(0)))
    text = F.coalesce(F.col(page), F.lit(""))
    fault = F.when(~text.contains("Listed Company Information Title Search"), "no_title_search").when(total.isNull(), "no_total").when(total != n, "row_count_differs")
    return df.withColumn("fault", fault).filter("fault IS NOT NULL").select(*keep, "fault")


def announcement_faults(df: DataFrame, payload: str, keep: list[str]) -> DataFrame:
    """Answers that are no JSON: pages of a firewall, cut texts, nothing at all."""
    text = unwrapped(F.coalesce(F.col(payload), F.lit("")))
    return df.filter(~F.coalesce(F.try_parse_json(text).isNotNull(), F.lit(False))).select(*keep, F.when(text == "", "empty").when(F.lower(text).contains("<html"), "html").otherwise("no_json").alias("fault"))


def reports(announcements: DataFrame, year: int) -> DataFrame:
    """The announcements that are full reports of the year, one for each company and kind: the preferred version, then the latest."""
    kind = title_kind(F.col("title"), year)
    rows = announcements.withColumn("document_type", kind).filter("document_type IS NOT NULL").withColumn("_p", title_preference(F.col("title"), F.col("document_type")))
    others = [c for c in announcements.columns if c not in ("stock_code", "document_type")]
    best = F.max_by(F.struct(*others), F.struct(-F.col("_p"), "published_date", "source_url"))
    return rows.groupBy("stock_code", "document_type").agg(best.alias("b")).select("stock_code", "document_type", "b.*")

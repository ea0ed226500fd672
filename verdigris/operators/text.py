"""Text operators: pages, rule-based candidates, evidence windows, table readers, links and hygiene."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.functions.numeric import rounded
from verdigris.functions.text import SIGNED as NUMBER
from verdigris.functions.text import SPACES, normal_text, number
from verdigris.operators.rules import rule_candidates

PAGE_MARK = r"\n=== PAGE (\d+) ===\n"


def split_pages(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """One row per page of texts whose pages follow marks: the mark's number and the page's text."""
    lead = F.concat(F.lit("\n"), F.col(text))
    numbers = F.regexp_extract_all(lead, F.lit(PAGE_MARK), F.lit(1))
    bodies = F.split(lead, PAGE_MARK)
    pairs = F.arrays_zip(numbers.alias("page"), F.slice(bodies, 2, F.size(bodies)).alias("text"))
    return df.select(*keep, F.explode(pairs).alias("p")).select(*keep, F.col("p.page").cast("int").alias("page"), F.col("p.text").alias("page_text"))


def keyword_evidence(pages: DataFrame, terms: dict[str, tuple[str, ...]], keep: list[str], before: int = 180, after: int = 360, most: int = 3) -> DataFrame:
    """Per indicator, the first term found on a page with the text around it; the first `most` pages of a document.

    Only the text around a term goes on to the choice of pages, and Spark limits each task's rows there before it shuffles.
    """
    rows = pages.select(*keep, "page", normal_text(F.col("page_text")).alias("_t")).withColumn("_l", F.lower("_t"))
    every = []
    for indicator, words in terms.items():
        at, word, sure = F.lit(0), F.lit(None).cast("string"), F.lit(0.65)
        for i, w in reversed(list(enumerate(words))):
            here = F.locate(w.lower(), F.col("_l"))
            at, word, sure = F.when(here > 0, here).otherwise(at), F.when(here > 0, F.lit(w)).otherwise(word), F.when(here > 0, F.lit(0.65 if i else 0.75)).otherwise(sure)
        every.append(F.struct(F.lit(indicator).alias("indicator_code"), word.alias("matched_term"), at.alias("at"), sure.alias("confidence")))
    hits = rows.select(*keep, "page", "_t", F.inline(F.array(*every))).filter("at > 0")
    start = F.greatest(F.lit(1), F.col("at") - before)
    evidence = F.substring(F.col("_t"), start, F.col("at") - start + F.length("matched_term") + after)
    narrow = hits.select(*keep, "page", "indicator_code", "matched_term", evidence.alias("evidence_text"), "confidence")
    w = Window.partitionBy(*keep, "indicator_code").orderBy("page")
    return narrow.withColumn("_i", F.row_number().over(w)).filter(F.col("_i") <= most).drop("_i")


def thin_class(chars: Column, size: Column, pages: Column, missing: Column, critical: int = 500, thin: int = 2000, low: int = 5000, large: int = 5_000_000) -> Column:
    return (
        F.when(missing, "missing_text").when((pages <= 2) & (size >= 1_000_000) & (chars < thin), "truncated_export").when(chars < critical, "critical_thin").when(chars < thin, "thin")
        .when((chars < low) & (size > large), "large_pdf_low_text")
    )


def visible_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, SPACES, ""))


# Patterns of download errors (in lower case) with class, whether a retry can help, and what to do next.
FAILURES = (
    (r"(?s)(curl退出码28|operation timed out).*(已保留0*[1-9]\d*字节分片|out of)|(已保留0*[1-9]\d*字节分片|out of).*(curl退出码28|operation timed out)", "timeout_partial_resume", True, "resume_with_longer_budget"),
    (r"curl退出码28|operation timed out", "timeout_empty", True, "retry_later"),
    (r"非法报告年份", "invalid_report_year", False, "exclude_until_rediscovery"),
    (r"eof occurred in violation of protocol|_ssl\.c", "ssl_eof", True, "retry_later"),
    (r"connection reset by peer|errno 54", "connection_reset", True, "retry_later"),
    (r"remote end closed connection", "connection_closed", True, "retry_later"),
    (r"(?s)arg1=|不是有效pdf.*<html|<html.*不是有效pdf", "exchange_antibot_html", True, "retry_with_browser_headers"),
    (r"公开文档不是有效pdf", "non_pdf_payload", False, "needs_url_rediscovery"),
    (r"尺寸异常", "pdf_too_small", False, "needs_url_rediscovery"),
)


def failure_class(error: Column) -> Column:
    """struct(class, retryable, action) of a download error: the first pattern that matches."""
    low = F.lower(F.coalesce(error, F.lit("")))
    out = F.struct(F.lit("other_download_error").alias("class"), F.lit(True).alias("retryable"), F.lit("retry_later").alias("action"))
    for pattern, name, retry, action in reversed(FAILURES):
        out = F.when(low.rlike(pattern), F.struct(F.lit(name).alias("class"), F.lit(retry).alias("retryable"), F.lit(action).alias("action"))).otherwise(out)
    return out


# Hosts and links.

# Platforms that are no issuer's own site, marks in shared hosts, and public suffixes.
PLATFORMS = (
    "sse.com.cn", "szse.cn", "hkex.com.hk", "hkexnews.hk", "bse.cn", "cninfo.com.cn", "cninfo.com", "cninfo.cn", "cninfo.co", "sseinfo.com", "p5w.net", "todayir.com", "eastmoney.com",
    "sina.com.cn", "sina.cn", "sohu.com", "qq.com", "weixin.qq.com", "jrj.com.cn", "hexun.com", "10jqka.com.cn", "cls.cn", "chinaclear.cn", "csrc.gov.cn", "gov.cn", "edu.cn",
    "lnsthj.cn", "gdeei.cn", "xjpmic.cn", "cnstock.com", "mbalib.com", "people.com.cn", "xinhuanet.com", "cctv.com", "book118.com", "ir-online.com.cn", "iwencai.com", "baidu.com",
    "wjx.cn", "sojump.com", "stcn.com", "cs.com.cn",
)
HOST_MARKS = ("qyxxpl", "gdeepub", "xxpl.", "hkexnews", "cninfo", "sseinfo")
SUFFIXES = ("com.cn", "com.hk", "net.cn", "org.cn", "gov.cn", "com", "net", "org", "cc", "co", "hk", "cn", "mn", "info", "biz")


def host_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    return F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r"\.+$", "")


def registrable(host: Column) -> Column:
    """The label before the public suffix with the suffix: the registered domain; null without a known suffix.

    Second levels of two or three letters below .cn are provinces and cities, so they belong to the suffix.
    """
    # the leftmost match takes the longest suffix
    suffixes = "|".join(re.escape(x) for x in SUFFIXES)
    province = r"(?!(?:com|net|org|gov|edu|ac|mil)\.)[a-z]{2,3}\.cn"
    return F.nullif(F.regexp_extract(host, rf"([^.]+\.(?:{province}|{suffixes}))$", 1), F.lit(""))


def plausible_issuer(host: Column) -> Column:
    """False for platforms, unknown suffixes, empty or overlong labels, and names so short that they are fragments."""
    platform = host.rlike(rf"(^|\.)({'|'.join(re.escape(p) for p in PLATFORMS)})$") | host.rlike("|".join(re.escape(m) for m in HOST_MARKS))
    domain = registrable(host)
    name = F.regexp_extract(domain, r"^([^.]+)", 1)
    least = F.when(host.endswith(".hk"), 2).otherwise(3)
    whole = ~host.rlike(r"(^|\.)(\.|$)|[^.]{64}") & ~host.rlike(r"(^|\.)[^.]\.(com|net|org|cn|hk)$")
    return F.coalesce(domain.isNotNull() & ~platform & whole & (F.length(name) >= least), F.lit(False))


def links(pages: DataFrame, html: str, keep: list[str]) -> DataFrame:
    """(href, anchor) of each link of a page, in order, absolute where the page's url gives the base."""
    pattern = r"""(?is)<a\b[^>]*?href\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a>"""
    pairs = F.arrays_zip(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)).alias("href"), F.regexp_extract_all(html, F.lit(pattern), F.lit(2)).alias("anchor"))
    rows = pages.select(*keep, "url", F.posexplode(pairs).alias("at", "a")).select(*keep, "url", "at", F.trim("a.href").alias("href"), F.trim(F.regexp_replace(F.regexp_replace("a.anchor", "<[^>]+>", " "), r"\s+", " ")).alias("anchor"))
    origin = F.regexp_extract("url", r"^([a-z]+://[^/?#]+)", 1)
    folder = F.regexp_extract("url", r"^([a-z]+://[^/?#]+(?:/[^?#]*/|/)?)", 1)
    full = F.when(F.col("href").rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.col("href")).when(F.col("href").startswith("//"), F.concat(F.regexp_extract("url", r"^([a-z]+:)", 1), "href")).when(F.col("href").startswith("/"), F.concat(origin, "href")).otherwise(F.concat(folder, "href"))
    return rows.withColumn("target", full)


def link_kind(target: Column, anchor: Column, year: int) -> Column:
    text = F.lower(F.concat_ws(" ", target, anchor))
    return (
        F.when(text.rlike("interim|半年度|半年报|中期"), F.lit(None)).when(~text.rlike(f"{year}|{year - 1}") & ~F.lower(target).endswith(".pdf"), F.lit(None))
        .when(text.rlike("esg|sustainab|social responsibility|可持续|社会责任"), "esg_report").when(text.rlike("annual|年报|年度报告"), "annual_report")
    )


def fiscal_year(title: Column) -> Column:
    """The last year of a title's period: 2024/25 gives 2025."""
    pair = F.regexp_extract(title, r"(20\d{2})\s*[/-]\s*(?:20)?(\d{2})(?!\d)", 2)
    one = F.regexp_extract(title, r"(20\d{2})", 1)
    return F.when(pair != "", F.concat(F.lit("20"), pair).cast("int")).when(one != "", one.cast("int"))


# Readers with the state of a page: they run per document in Python, over Arrow batches.

TABLE = "page int, indicator_code string, year int, value double, mode string"
YEAR_HEADER = re.compile(r"(20\d{2})\s*年?(?:度)?")
CELL = re.compile(r"[+-]?\d[\d,]*(?:\.\d+)?")


def column_mode(line: str) -> tuple[str, list[int]]:
    """current-first, current-last or single-year by an explicit header of years; 'none' where it is not clear."""
    years = [int(y) for y in YEAR_HEADER.findall(line)]
    if len(years) == 1:
        return "single-year", years
    if len(years) >= 2 and years == sorted(years, reverse=True) and len(set(years)) == len(years):
        return "current-first", years
    if len(years) >= 2 and years == sorted(years) and len(set(years)) == len(years):
        return "current-last", years
    return "none", []


def read_year_table(page: int, text: str, labels: dict[str, str]) -> Iterator[tuple]:
    """Rows of a page whose values stand under an explicit header of years; a row needs as many values as years."""
    mode, years = "none", []
    for line in (text or "").splitlines():
        if not any(re.search(p, line, re.I) for p in labels.values()):
            found, header = column_mode(line)
            if found != "none" and not re.search(r"[.,]\d", line):
                mode, years = found, header
            continue
        if mode == "none":
            continue
        for code, pattern in labels.items():
            m = re.search(pattern, line, re.I)
            if m:
                values = [float(x.replace(",", "")) for x in CELL.findall(line[m.end() :])]
                if len(values) == len(years):
                    yield from ((page, code, y, v, mode) for y, v in zip(years, values, strict=True))
                break


def year_tables(pages: DataFrame, labels: dict[str, str], keep: list[str]) -> DataFrame:
    """Values by year of labelled rows under year headers, page by page."""
    kinds = ", ".join(f"{c} {t}" for c, t in pages.select(*keep).dtypes)

    def run(frames):
        for frame in frames:
            rows = [(*key, *r) for *key, page, text in frame.itertuples(index=False) for r in read_year_table(page, text, labels)]
            yield pd.DataFrame(rows, columns=[*keep, "page", "indicator_code", "year", "value", "mode"])

    return pages.select(*keep, "page", "page_text").mapInPandas(run, f"{kinds}, {TABLE}")


STATEMENT = {"assets": r"total assets|资产总计", "liabilities": r"total liabilities(?! and)|负债合计", "equity": r"total equity|所有者权益合计|股东权益合计"}


def statement_facts(pages: DataFrame, keep: list[str], span: int = 180) -> DataFrame:
    """Current and previous amounts after each statement label, per page: the first two amounts within `span` characters."""
    text = normal_text(F.col("page_text"))
    every = []
    for name, label in STATEMENT.items():
        near = F.regexp_extract(text, rf"(?i)(?:{label})([^:]{{0,{span}}})", 1)
        amounts = F.regexp_extract_all(near, F.lit(NUMBER), F.lit(0))
        every.append(F.struct(F.lit(name).alias("fact"), number(F.get(amounts, F.lit(0))).alias("current"), number(F.get(amounts, F.lit(1))).alias("previous")))
    return pages.select(*keep, "page", F.inline(F.array(*every))).filter("current IS NOT NULL")


def statement_identity(facts: DataFrame, keep: list[str], tolerance: float = 0.05) -> DataFrame:
    """Whether assets equal liabilities and equity within the tolerance, and liabilities are at most twice the assets."""
    wide = facts.groupBy(*keep).pivot("fact", list(STATEMENT)).agg(F.min_by("current", "page"))
    a, l, e = (F.col(c) for c in STATEMENT)  # noqa: E741
    return wide.withColumns({"balanced": F.abs(a - l - e) <= tolerance * F.abs(a), "accepted": (F.abs(a - l - e) <= tolerance * F.abs(a)) & (l <= 2 * a), "debt_asset_rate": rounded(l / F.nullif(a, F.lit(0.0)) * 100, 4)})


def per_capita(facts: DataFrame) -> DataFrame:
    """Value per head where the head count rolls forward: end = begin + inc - dec."""
    closes = F.col("end") == F.col("begin") + F.col("inc") - F.col("dec")
    return facts.withColumns({"closes": closes, "per_head": F.when(closes, F.col("total") / F.nullif("end", F.lit(0)))})


def scope_total(total: Column, one: Column, two: Column, three: Column) -> Column:
    """A greenhouse-gas total that is scopes 1 and 2: no scope 3 given, and within 1% of their sum."""
    return F.when((F.coalesce(three, F.lit(0.0)) <= 0) & (F.abs(total - one - two) <= 0.01 * F.abs(total)), total)


def reconcile_values(df: DataFrame, key: list[str], value: str, spread: float = 1e-4) -> DataFrame:
    """One value per key where all agree within a relative spread; keys that disagree are dropped."""
    out = df.groupBy(*key).agg(F.min(value).alias("_low"), F.max(value).alias("_high"), F.count(F.lit(1)).alias("n"))
    return out.filter((F.col("_high") - F.col("_low")) <= spread * F.greatest(F.abs("_high"), F.abs("_low"))).withColumnRenamed("_low", value).drop("_high")


def page_context(pages: DataFrame, keep: list[str], before: int = 1) -> DataFrame:
    """Pages with the text of the pages before them, for rows whose header stands on an earlier page."""
    w = Window.partitionBy(*keep).orderBy("page").rowsBetween(-before, -1)
    return pages.withColumn("context", F.array_join(F.collect_list("page_text").over(w), "\n"))


def aligned_rows(pages: DataFrame, labels: dict[str, str], keep: list[str]) -> DataFrame:
    """Rows of text tables aligned by tabs or three and more spaces: the label's first number. No row fails the page."""
    lines = pages.select(*keep, "page", F.explode(F.split("page_text", "\n")).alias("line"))
    cells = F.transform(F.split(F.trim("line"), r"\t+| {3,}"), lambda c: F.trim(c))
    code = F.lit(None).cast("string")
    for name, pattern in reversed(list(labels.items())):
        code = F.when(F.col("cells")[0].rlike(f"(?i)^(?:{pattern})"), name).otherwise(code)
    numbers = F.filter(F.transform(F.slice("cells", 2, F.size("cells")), lambda c: F.regexp_replace(c, ",", "").try_cast("double")), lambda v: v.isNotNull())
    rows = lines.withColumn("cells", cells).filter(F.size("cells") >= 2).withColumns({"indicator_code": code, "numbers": numbers})
    return rows.filter(F.col("indicator_code").isNotNull() & (F.size("numbers") > 0)).select(*keep, "page", "indicator_code", F.col("numbers")[0].alias("value"), F.col("line").alias("evidence_text"), F.lit(0.7).alias("confidence"))


def extract_candidates(pages: DataFrame, labels: dict[str, str], keep: list[str]) -> DataFrame:
    """All rules over a document's pages: one row per (indicator, page, value), the surest evidence of each."""
    rows = rule_candidates(pages, keep).drop("rule").unionByName(aligned_rows(pages, labels, keep))
    best = F.max_by(F.struct("evidence_text", "confidence"), F.struct("confidence", "evidence_text"))
    return rows.groupBy(*keep, "page", "indicator_code", "value").agg(best.alias("b")).select(*keep, "page", "indicator_code", "value", "b.evidence_text", "b.confidence")


def extraction_coverage(found: DataFrame, keep: list[str]) -> DataFrame:
    return found.groupBy("indicator_code").agg(F.count(F.lit(1)).alias("candidates"), F.count_distinct(*keep).alias("documents"), F.max("confidence").alias("max_confidence"))


def money_rates(totals: DataFrame, revenue: DataFrame, key: list[str], bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Totals as a percentage of revenue, inside each indicator's bounds; companies whose revenues disagree get none."""
    agreed = reconcile_values(revenue, key, "revenue").select(*key, "revenue")
    rate = F.col("total") * 100 / F.nullif("revenue", F.lit(0.0))
    inside = F.lit(False)
    for code, (low, high) in bounds.items():
        inside = inside | ((F.col("indicator_code") == code) & rate.between(low, high))
    return totals.join(agreed, key).withColumn("value", rate).filter(inside)


def usable_denominator(evidence: Column) -> Column:
    """False where the evidence divides by output instead of revenue, or states a zero that is no measurement."""
    return ~evidence.rlike("(?i)产值|产量|发电量|单位产品|per mwh|per unit") & ~evidence.rlike(r"(?<![\d.])0(?:\.0+)?(?![\d.])")


# Words of titles that only refer to a report, brackets that mark a revised full text, and words of ESG reports.
NON_REPORTS = ("摘要", "提示性公告", "关于披露", "取消", "问询函", "问询", "回复", "业绩说明会", "业绩说明", "说明会", "网上说明", "简版", "半年度", "季度报告")
REVISED = ("(修订版)", "(修订稿)", "(更新后)", "(更新版)", "(更正后)")
ESG_WORDS = ("社会责任报告", "可持续发展报告", "环境、社会", "esg")


def compact_title(title: Column) -> Column:
    return F.translate(F.regexp_replace(title, f"{SPACES}+", ""), "（）", "()")


def title_kind(title: Column, year: int, esg: tuple[str, ...] = ESG_WORDS) -> Column:
    """annual_report or esg_report for full reports of the year; summaries, notices, corrections and other years are neither."""
    t = compact_title(title)
    words = lambda of: t.rlike("(?i)" + "|".join(re.escape(w) for w in of))
    other = ~t.contains(str(year)) | words(NON_REPORTS) | (t.rlike("更正|修订") & ~words(REVISED))
    return F.when(other, F.lit(None)).when(t.rlike(f"{year}年年度报告|{year}年度报告|{year}年年报"), "annual_report").when(words(esg), "esg_report")


def title_preference(title: Column, kind: Column) -> Column:
    """Smaller is better: full local text, then parallel listings, then translations."""
    t = compact_title(title)
    return F.when(t.rlike("(?i)英文|英语|english"), 3).when((kind == "annual_report") & t.rlike("H股|同步披露"), 2).otherwise(0)


def https_ready(url: Column) -> Column:
    return F.coalesce(url.rlike(r"^https://[^/]+"), F.lit(False)) & plausible_issuer(host_of(url))

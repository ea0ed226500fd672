"""Queries of text, links, readers and streams over the generated tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdigris.operators import text as ops
from verdigris.operators.rules import rule_candidates
from verdigris.plans.binding import sql_with, table
from verdigris.sources import listings, readers
from verdigris.sources.shared import staged
from verdigris.streaming import events as stream

QUERIES, ORACLE_SQL = {}, {}


def query(name, sql=None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


def pages(spark, d):
    """Documents as exports of pages: each line is a page."""
    doc = table(spark, d, "documents")
    marked = F.concat_ws("", F.transform(F.split("text", "\n"), lambda line, i: F.concat(F.lit("\n=== PAGE "), (i + 1).cast("string"), F.lit(" ===\n"), line)))
    return ops.split_pages(doc.select("doc_id", marked.alias("text")), "text", ["doc_id"])


LINES = "pg AS (SELECT doc_id, CAST(i AS INTEGER) AS page, string_split(text, chr(10))[i] AS t FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))"


@query("page_split", sql_with(LINES, "SELECT doc_id, page, length(t) AS chars FROM pg"))
def page_split(spark, d):
    return pages(spark, d).select("doc_id", "page", F.length("page_text").cast("long").alias("chars"))


TERMS = {"X_E_POLICY": ("anthly", "herely"), "X_S_SAFETY": ("worthless", "idiot", "oner"), "X_G_BOARD": ("ción de", "eau")}
NORM = "regexp_replace(t, '\\s+', ' ', 'g')"


def _first(words):
    return "CASE " + " ".join(f"WHEN strpos(lower(n), '{w}') > 0 THEN '{w}'" for w in words) + " END"


@query("keyword_evidence", sql_with(LINES, f"pn AS (SELECT doc_id, page, {NORM} AS n FROM pg)", "hit AS (" + " UNION ALL ".join(f"SELECT doc_id, page, n, '{k}' AS indicator_code, {_first(v)} AS w, '{v[0]}' AS f FROM pn" for k, v in TERMS.items()) + "), rk AS (SELECT *, strpos(lower(n), w) AS a, row_number() OVER (PARTITION BY doc_id, indicator_code ORDER BY page) AS i FROM hit WHERE w IS NOT NULL)",
  "SELECT doc_id, page, indicator_code, w AS matched_term, substr(n, greatest(1, a - 180), a - greatest(1, a - 180) + length(w) + 360) AS evidence_text, CASE "
    "WHEN w = f THEN 0.75 ELSE 0.65 END::DOUBLE AS confidence FROM rk WHERE i <= 3"))
def keyword_evidence(spark, d):
    return ops.keyword_evidence(pages(spark, d), TERMS, ["doc_id"])


@query("thin_text", """
SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 'missing_text' WHEN doc_id % 3 = 0 AND c < 2000 THEN 'truncated_export' WHEN c < 500 THEN 'critical_thin'
  WHEN c < 2000 THEN 'thin' WHEN c < 5000 AND doc_id % 2 = 0 THEN 'large_pdf_low_text' END AS class
FROM (SELECT doc_id, length(regexp_replace(text, '\\s', '', 'g')) AS c FROM documents)""")
def thin_text(spark, d):
    k = F.col("doc_id")
    return table(spark, d, "documents").select("doc_id", ops.visible_chars(F.col("text")).alias("c")).select("doc_id", ops.thin_class(F.col("c"), F.when(k % 2 == 0, 6_000_000).otherwise(2_000_000), F.when(k % 3 == 0, 1).otherwise(9), k % 50 == 0).alias("class"))


#: Errors with the class, whether to retry, and what to do, written out for the SQL.
ERRORS = (
    ("curl退出码28: 已保留2048字节分片", "timeout_partial_resume", True, "resume_with_longer_budget"), ("curl退出码28 已保留0字节分片", "timeout_empty", True, "retry_later"),
    ("Operation timed out after 30 s, 5 out of 9 bytes", "timeout_partial_resume", True, "resume_with_longer_budget"), ("operation TIMED OUT", "timeout_empty", True, "retry_later"),
    ("非法报告年份: 1999", "invalid_report_year", False, "exclude_until_rediscovery"), ("EOF occurred in violation of protocol (_ssl.c:997)", "ssl_eof", True, "retry_later"),
    ("[Errno 54] Connection reset by peer", "connection_reset", True, "retry_later"), ("Remote end closed connection without response", "connection_closed", True, "retry_later"),
    ("var arg1='A1'", "exchange_antibot_html", True, "retry_with_browser_headers"), ("公开文档不是有效PDF: <HTML>", "exchange_antibot_html", True, "retry_with_browser_headers"),
    ("公开文档不是有效PDF: 504b", "non_pdf_payload", False, "needs_url_rediscovery"), ("PDF尺寸异常: 12", "pdf_too_small", False, "needs_url_rediscovery"),
    ("HTTP Error 503", "other_download_error", True, "retry_later"), (None, "other_download_error", True, "retry_later"),
)


@query("failure_classes", f"""SELECT event_id, x.class, x.retryable, x.action
  FROM (SELECT event_id, [{", ".join(f"{{'class': '{c}', 'retryable': {r}, 'action': '{a}'}}" for _, c, r, a in ERRORS)}][event_id % {len(ERRORS)} + 1] AS x FROM events)""")
def failure_classes(spark, d):
    errors = F.array(*[F.lit(e).cast("string") for e, *_ in ERRORS])
    e = table(spark, d, "events").select("event_id", ops.failure_class(F.element_at(errors, (F.col("event_id") % len(ERRORS) + 1).cast("int"))).alias("f"))
    return e.select("event_id", "f.class", "f.retryable", "f.action")


#: Hosts with their registered domain and whether they can be an issuer's, written out for the SQL.
HOSTS = (
    ("www.firm.com.cn", "firm.com.cn", True), ("ir.firm.com", "firm.com", True), ("www.sse.com.cn", "sse.com.cn", False), ("static.sse.com.cn", "sse.com.cn", False), ("notsse.com.cn", "notsse.com.cn", True),
    ("hr.tj.cn", "hr.tj.cn", False), ("steel.tj.cn", "steel.tj.cn", True), ("ir.p.com", "p.com", False), ("ab.com.hk", "ab.com.hk", True), ("ab.com", "ab.com", False), ("a..com", None, False),
    ("firm.xyz", None, False), ("qyxxpl.firm.com", "firm.com", False), ("x.gov.cn", "x.gov.cn", False), ("coal.mn", "coal.mn", True), ("localhost", None, False),
)


@query("host_hygiene", f"""SELECT o_orderkey, x.domain, x.plausible
  FROM (SELECT o_orderkey, [{", ".join(f"{{'domain': {'NULL' if n is None else repr(n)}, 'plausible': {p}}}" for _, n, p in HOSTS)}][o_orderkey % {len(HOSTS)} + 1] AS x FROM orders)""")
def host_hygiene(spark, d):
    urls = F.array(*[F.lit(f"https://{h}/a/b.pdf?x=1") for h, *_ in HOSTS])
    host = ops.host_of(F.element_at(urls, (F.col("o_orderkey") % len(HOSTS) + 1).cast("int")))
    return table(spark, d, "orders").select("o_orderkey", ops.registrable(host).alias("domain"), ops.plausible_issuer(host).alias("plausible"))


HOST = "regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), '^www[.]', '')"


@query("domain_hygiene", f"SELECT page_id, host, regexp_extract(host, '([^.]+[.](com|net|org))$', 1) AS domain, length(regexp_extract(host, '([^.]+)[.](com|net|org)$', 1)) >= 3 AS plausible FROM (SELECT page_id, {HOST} AS host FROM pages)")
def domain_hygiene(spark, d):
    host = ops.host_of(F.col("url"))
    return table(spark, d, "pages").select("page_id", host.alias("host"), ops.registrable(host).alias("domain"), ops.plausible_issuer(host).alias("plausible"))


@query("page_links", "SELECT page_id, count(*) AS n, count(DISTINCT target) AS targets, min(target) AS first_target "
    "FROM (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS target "
    "FROM pages) GROUP BY 1")
def page_links(spark, d):
    return ops.links(table(spark, d, "pages"), "html", ["page_id"]).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("target").alias("targets"), F.min("target").alias("first_target"))


@query("same_domain_links", "SELECT regexp_extract(host, '([^.]+[.][^.]+)$', 1) AS domain, CAST(sum(n) AS BIGINT) AS n_links "
    "FROM (SELECT regexp_extract(url, '://([^/?#]+)', 1) AS host, len(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS n FROM pages) GROUP BY 1 "
    "HAVING sum(n) > 0")
def same_domain_links(spark, d):
    rows = ops.links(table(spark, d, "pages"), "html", ["page_id"])
    own = ops.registrable(ops.host_of(F.col("url")))
    return rows.filter(own == ops.registrable(ops.host_of(F.col("target")))).groupBy(own.alias("domain")).agg(F.count(F.lit(1)).alias("n_links"))


@query("domain_best", "SELECT domain, page_id, n FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY n DESC, page_id) AS i "
    "FROM (SELECT page_id, regexp_replace(regexp_extract(url, '://([^/?#]+)', 1), '^www[.]', '') AS domain, length(html) AS n FROM pages)) WHERE i = 1 "
    "ORDER BY n DESC, domain LIMIT 50")
def domain_best(spark, d):
    rows = table(spark, d, "pages").select("page_id", ops.host_of(F.col("url")).alias("domain"), F.length("html").cast("long").alias("n"))
    best = rows.groupBy("domain").agg(F.max_by(F.struct("page_id", "n"), F.struct("n", -F.col("page_id"))).alias("b"))
    return best.select("domain", "b.page_id", "b.n").orderBy(F.desc("n"), "domain").limit(50)


@query("link_kinds", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'esg_report' WHEN 1 THEN 'annual_report' WHEN 2 THEN NULL WHEN 3 THEN NULL "
    "ELSE 'annual_report' END AS kind, CASE event_id % 5 WHEN 0 THEN 2025 WHEN 1 THEN 2025 WHEN 2 THEN 2025 WHEN 4 THEN 2019 END AS fiscal_year FROM events")
def link_kinds(spark, d):
    words = F.array(*map(F.lit, ("Sustainability report 2025", "Annual report 2024/25", "Interim report 2025", "News", "annual report 2019.pdf")))
    w = F.element_at(words, (F.col("event_id") % 5 + 1).cast("int"))
    target = F.when(F.col("event_id") % 5 == 4, "https://a.com/annual.pdf").otherwise("https://a.com/x")
    return table(spark, d, "events").select("event_id", ops.link_kind(target, w, 2025).alias("kind"), ops.fiscal_year(w).alias("fiscal_year"))


@query("json_props", "SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY 1")
def json_props(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"))


def kpi_pages(spark, d):
    """Pages made from suppliers: an intensity with a unit, a rate, a table of years and a balance sheet."""
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey").cast("string")
    number = F.concat(F.lit("1,"), F.lpad((F.col("s_suppkey") % 1000).cast("string"), 3, "0"), F.lit(".5"))
    unit = F.when(F.col("s_suppkey") % 2 == 0, " 吨/万元").otherwise(" kg/百万元")
    lines = F.concat_ws("\n", F.concat(F.lit("温室气体排放强度为 "), number, unit), F.concat(F.lit("氮氧化物排放强度："), k, F.lit("  克/万元")), F.concat(F.lit("资产负债率 "), (F.col("s_suppkey") % 150).cast("string"), F.lit("%")), F.lit("指标 2024年 2023年"), F.concat(F.lit("energy use  "), k, F.lit("  "), number),
                        F.concat(F.lit("Total assets 1,000 900 Total liabilities "), (F.col("s_suppkey") % 600).cast("string"), F.lit(" 1 Total equity "), (1000 - F.col("s_suppkey") % 600 + F.col("s_suppkey") % 7 * 20).cast("string"), F.lit(" 5")))
    return s.select("s_suppkey", F.lit(1).alias("page"), lines.alias("page_text"))


@query("unit_rules", "SELECT s_suppkey, 'Q_E_GHG_INTENSITY' AS indicator_code, (1000 + s_suppkey % 1000 + 0.5) * CASE WHEN s_suppkey % 2 = 0 THEN 1000.0 "
    "ELSE 0.01 END AS value FROM supplier UNION ALL SELECT s_suppkey, 'Q_E_NOX_INTENSITY', CAST(s_suppkey AS DOUBLE) FROM supplier")
def unit_rules(spark, d):
    return rule_candidates(kpi_pages(spark, d), ["s_suppkey"], ("unit",)).filter("indicator_code LIKE '%_INTENSITY'").select("s_suppkey", "indicator_code", F.round("value", 6).alias("value"))


@query("rate_rules", "SELECT s_suppkey, CAST(s_suppkey % 150 AS DOUBLE) AS value FROM supplier WHERE s_suppkey % 150 <= 100")
def rate_rules(spark, d):
    return rule_candidates(kpi_pages(spark, d), ["s_suppkey"], ("unit",)).filter("indicator_code = 'Q_G_DEBT_ASSET_RATE'").select("s_suppkey", "value")


@query("year_tables", "SELECT s_suppkey, 2024 AS year, CAST(s_suppkey AS DOUBLE) AS value, 'current-first' AS mode FROM supplier "
    "UNION ALL SELECT s_suppkey, 2023, 1000 + s_suppkey % 1000 + 0.5, 'current-first' FROM supplier")
def year_tables(spark, d):
    return ops.year_tables(kpi_pages(spark, d), {"Q_E_ENERGY_INTENSITY": "energy use"}, ["s_suppkey"]).select("s_suppkey", "year", "value", "mode")


@query("statement_identity", "SELECT s_suppkey, 1000.0::DOUBLE AS assets, CAST(s_suppkey % 600 AS DOUBLE) AS liabilities, CAST(1000 - s_suppkey % 600 + s_suppkey % 7 * 20 AS DOUBLE) AS equity, s_suppkey % 7 * 20 <= 50 AS balanced, s_suppkey % 7 * 20 <= 50 AS accepted, floor((s_suppkey % 600) / 10.0 * 10000 + 0.5) / 10000 AS debt_asset_rate "
    "FROM supplier")
def statement_identity(spark, d):
    return ops.statement_identity(ops.statement_facts(kpi_pages(spark, d), ["s_suppkey"]), ["s_suppkey"])


@query("reconcile_values", "SELECT l_orderkey, min(l_quantity) AS l_quantity, count(*) AS n FROM lineitem GROUP BY 1 HAVING max(l_quantity) = min(l_quantity)")
def reconcile_values(spark, d):
    return ops.reconcile_values(table(spark, d, "lineitem"), ["l_orderkey"], "l_quantity")


@query("scope_totals", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 5 < 2 THEN 1000.0 END::DOUBLE AS total FROM orders")
def scope_totals(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", ops.scope_total(F.lit(1000.0), F.lit(600.0), 400.0 - (k % 5) * 9.0, F.when(k % 3 == 0, 5.0)).alias("total"))


@query("listed_codes", "SELECT c_nationkey, count(*) AS n FROM (SELECT DISTINCT c_nationkey, c_custkey FROM customer) GROUP BY 1")
def listed_codes(spark, d):
    c = table(spark, d, "customer")
    text = c.groupBy("c_nationkey").agg(F.array_join(F.collect_list(F.concat(F.lit("x "), F.lpad(F.col("c_custkey").cast("string"), 6, "0"), F.lit(".SH, again "), F.lpad(F.col("c_custkey").cast("string"), 6, "0"), F.lit(".SH"))), "; ").alias("t"))
    return readers.listed_codes(text, "t", ["c_nationkey"]).groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))


@query("listing_pages", "SELECT CAST(n_regionkey AS INTEGER) AS page, CAST(25 AS INTEGER) AS total, 'N' || n_nationkey AS stock_code, n_name AS company_name FROM nation")
def listing_pages(spark, d):
    n = table(spark, d, "nation")
    rows = F.collect_list(F.struct(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("code"), F.col("n_name").alias("name")))
    pages = n.groupBy("n_regionkey").agg(F.to_json(F.struct(F.first("n_regionkey").alias("page"), F.lit(25).alias("total"), rows.alias("data"))).alias("p"))
    return readers.parse_listings(pages, "p")


def listing_snapshots(spark, d):
    """A snapshot for each nation: its customers on pages of JSON, in one of four layouts; every fifth states one row too many, every seventh repeats a page's number."""
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("snapshot"), (F.col("c_custkey") % 3 + 1).cast("int").alias("page"), F.struct(F.col("c_custkey").cast("string").alias("ZQDM"), F.concat(F.lit("<u>"), F.col("c_name"), F.lit("</u> &amp; Co")).alias("name"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("sshymc")).alias("r"))
    total = c.groupBy("snapshot").agg((F.count(F.lit(1)) + F.when(F.first("snapshot") % 5 == 0, 1).otherwise(0)).alias("total"), F.count_distinct("page").alias("pageCount"))
    rows = c.groupBy("snapshot", "page").agg(F.collect_list("r").alias("rows")).join(total, "snapshot")
    k, at = F.col("snapshot"), F.when((F.col("snapshot") % 7 == 3) & (F.col("page") == 2), 9).otherwise(F.col("page")).alias("pageNo")
    json = (
        F.when(k % 4 == 0, F.to_json(F.struct("rows", "total", "pageCount", at))).when(k % 4 == 1, F.to_json(F.struct(F.struct(F.col("rows").alias("list"), "total", "pageCount", at).alias("data"))))
        .when(k % 4 == 2, F.to_json(F.struct(F.struct(F.col("rows").alias("data"), F.lit("x").alias("x")).alias("pageHelp"), "total", "pageCount", at))).otherwise(F.to_json(F.array(F.struct(F.col("rows").alias("result"), F.struct(F.col("total").alias("recordcount"), F.col("pageCount").alias("pagecount"), at).alias("metadata")))))
    )
    return listings.listing_pages(rows.select("snapshot", "page", json.alias("p")), "p", "page", ["snapshot"])


@query("listing_snapshot_rows", "SELECT c_nationkey AS snapshot, CAST(c_custkey % 3 + 1 AS INTEGER) AS page_no, lpad(CAST(c_custkey AS VARCHAR), 6, '0') || '.SZ' AS stock_code, c_name || ' & Co' AS company_name, "
    "CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '待分类' END AS industry FROM customer WHERE NOT (c_nationkey % 7 = 3 AND c_custkey % 3 = 1)")
def listing_snapshot_rows(spark, d):
    return listings.listing_rows(listing_snapshots(spark, d), "SZSE", ["snapshot"]).select("snapshot", "page_no", "stock_code", "company_name", "industry")


@query("listing_snapshot_faults", "WITH n AS (SELECT c_nationkey AS snapshot, c_nationkey % 7 = 3 AND bool_or(c_custkey % 3 = 1) AS odd FROM customer GROUP BY 1) "
    "SELECT snapshot, 'row_count_differs' AS fault FROM n WHERE snapshot % 5 = 0 OR odd UNION ALL SELECT snapshot, 'page_mismatch' FROM n WHERE odd")
def listing_snapshot_faults(spark, d):
    pages = staged(listing_snapshots(spark, d), "listing-pages")
    return listings.snapshot_faults(pages, listings.listing_rows(pages, "SZSE", ["snapshot"]), ["snapshot"])


W = "CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT)"


@query("events_tumbling", f"SELECT date_trunc('day', ts) AS start, date_trunc('day', ts) + INTERVAL 1 DAY AS \"end\", event_type, count(*) AS n, {W} AS cents FROM events GROUP BY 1, 2, 3")
def events_tumbling(spark, d):
    return stream.windowed(table(spark, d, "events"), "1 day")


@query("events_sliding", f"SELECT s AS start, s + INTERVAL 2 DAY AS \"end\", event_type, count(*) AS n, {W} AS cents FROM (SELECT *, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS s FROM events) GROUP BY 1, 2, 3")
def events_sliding(spark, d):
    return stream.windowed(table(spark, d, "events"), "2 days", "1 day")


@query("events_session", "SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS \"end\", count(*) AS n FROM (SELECT *, sum(CASE "
    "WHEN p IS NULL OR ts >= p + INTERVAL 2 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s "
    "FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)) GROUP BY user_id, s")
def events_session(spark, d):
    return stream.sessions(table(spark, d, "events"), "2 hours")


@query("stream_latest_revision", "SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY 1, 2")
def stream_latest_revision(spark, d):
    import uuid

    from verdigris.sources.shared import shared_dir

    return stream.stream_latest(spark, d, f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}")


def _stream_path(spark):
    import uuid

    from verdigris.sources.shared import shared_dir

    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


@query("stream_progress", "SELECT user_id, count(*) AS group_count, count(*) FILTER (event_type <> 'error') AS decided_count, CASE "
    "WHEN count(*) = count(*) FILTER (event_type <> 'error') THEN 'closed' ELSE 'open' END AS status FROM events GROUP BY 1")
def stream_progress(spark, d):
    return stream.stream_progress(spark, d, _stream_path(spark), "user_id", "event_type <> 'error'")


@query("stream_deduplicated", "SELECT count(*) AS n, count(DISTINCT event_id) AS events FROM events")
def stream_deduplicated(spark, d):
    rows = stream.stream_deduplicated(spark, d, _stream_path(spark), ["event_id"], "1 hour")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("events"))

"""Queries of announcement lists made from customers: one answer of each exchange's shape."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdigris.plans.binding import table
from verdigris.sources import announcements as ops

QUERIES, ORACLE_SQL = {}, {}
SHAPES = 7
TITLES = "['2024年年度报告', '2024年年度报告摘要', '2024年度ESG报告', '2023年年度报告', '2024年年度报告（英文版）']"


def answers(spark, d):
    """c_custkey, source, payload: two shapes each of three exchanges, one of CNINFO."""
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    code = F.lpad((k % 1000).cast("string"), 6, "0")
    title = F.expr(f"element_at(array({TITLES[1:-1]}), CAST(c_custkey % 5 + 1 AS INT))")
    day = F.concat(F.lit("2025-04-"), F.lpad((k % 28 + 1).cast("string"), 2, "0"))
    path = F.concat(F.lit("/a/"), k.cast("string"), F.lit(".pdf"))
    one = lambda **x: F.struct(*[v.alias(n) for n, v in x.items()])
    sse = F.array(one(SECURITY_CODE=code, SECURITY_NAME=F.col("c_name"), SSEDATE=day, TITLE=title, URL=path), one(SECURITY_CODE=code, SECURITY_NAME=F.col("c_name"), SSEDATE=day, TITLE=title, URL=F.lit("")))
    szse = F.array(one(secCode=F.array(code), secName=F.array(F.col("c_name")), publishTime=F.concat(day, F.lit(" 00:00:00")), title=title, attachPath=path))
    plain = F.array(one(code=code, stockName=F.col("c_name"), publishDate=day, announcementTitle=title, url=F.concat(F.lit("https://x.cn"), path)))
    bse = one(companyCd=code, companyName=F.col("c_name"), publishDate=day, disclosureTitle=F.left(title, F.lit(4)), disclosurePostTitle=F.substring(title, 5, 99), destFilePath=path)
    cninfo = F.array(one(secCode=F.concat(F.lit("6"), F.right(code, F.lit(5))), secName=F.col("c_name"), announcementTitle=F.concat(F.lit("<em>"), F.left(title, F.lit(4)), F.lit("</em>"), F.substring(title, 5, 99)), adjunctUrl=F.substring(path, 2, 99), announcementTime=F.unix_millis(F.to_timestamp(day))))
    shapes = [
        ("SSE", F.to_json(one(result=sse))), ("SSE", F.to_json(one(result=F.lit(None).cast("string"), pageHelp=one(data=sse)))), ("SZSE", F.to_json(one(data=szse))), ("SZSE", F.to_json(one(data=one(list=plain)))),
        ("BSE", F.concat(F.lit("null("), F.to_json(F.array(one(listInfo=one(content=F.array(one(disclosures=F.array(bse))))))), F.lit(")"))), ("BSE", F.to_json(one(data=one(content=F.array(bse))))), ("CNINFO", F.to_json(one(announcements=cninfo))),
    ]
    every = F.array(*[F.struct(F.lit(s).alias("source"), p.alias("payload")) for s, p in shapes])
    return c.select("c_custkey", F.element_at(every, (k % SHAPES + 1).cast("int")).alias("a")).select("c_custkey", "a.*")


def announcements(spark, d):
    out = None
    for source in ("SSE", "SZSE", "BSE", "CNINFO"):
        rows = ops.parse_announcements(answers(spark, d).filter(F.col("source") == source).select("c_custkey", "payload"), "payload", source, ["c_custkey"])
        out = rows if out is None else out.unionByName(rows)
    return out


QUERIES["announcements"] = announcements
MADE = f"""m AS (SELECT c_custkey, c_name, c_custkey % {SHAPES} AS s, lpad(CAST(c_custkey % 1000 AS VARCHAR), 6, '0') AS code, {TITLES}[c_custkey % 5 + 1] AS title, '2025-04-' || lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0') AS day FROM customer),
a AS (SELECT c_custkey, CASE WHEN s < 2 THEN code || '.SH' WHEN s < 4 THEN code || '.SZ' WHEN s < 6 THEN code || '.BJ' ELSE '6' || substr(code, 2) || '.SH' END AS stock_code, c_name AS company_name, day AS published_date, title,
  CASE WHEN s < 2 THEN 'https://www.sse.com.cn' WHEN s = 2 THEN 'https://disc.static.szse.cn' WHEN s = 3 THEN 'https://x.cn' WHEN s < 6 THEN 'https://www.bse.cn' ELSE 'https://static.cninfo.com.cn' END || '/a/' || c_custkey || '.pdf' AS source_url,
  CASE WHEN s < 2 THEN 'SSE' WHEN s < 4 THEN 'SZSE' WHEN s < 6 THEN 'BSE' ELSE 'CNINFO' END AS source FROM m)"""
ORACLE_SQL["announcements"] = f"WITH {MADE} SELECT * FROM a"


def announced_reports(spark, d):
    return ops.reports(announcements(spark, d).drop("c_custkey"), 2024)


QUERIES["announced_reports"] = announced_reports
ORACLE_SQL["announced_reports"] = f"""WITH {MADE} SELECT stock_code, document_type, company_name, published_date, title, source_url, source FROM (
  SELECT *, CASE WHEN title LIKE '%ESG%' THEN 'esg_report' ELSE 'annual_report' END AS document_type, row_number() OVER (PARTITION BY stock_code, title LIKE '%ESG%' ORDER BY title LIKE '%英文%', published_date DESC, source_url DESC) AS i
  FROM a WHERE title NOT LIKE '%摘要%' AND title NOT LIKE '2023%') WHERE i = 1"""


def title_searches(spark, d):
    """Title searches: each customer's page has one row; every seventh names another total."""
    k = F.col("c_custkey")
    page = F.concat(
        F.lit("<h1>Listed Company Information Title Search</h1>Total records found: "), F.when(k % 7 == 0, "2").otherwise("1"), F.lit("<table><tr><th>x</th></tr><tr><td>Release Time: 09/04/2025 16:30</td><td>Stock Code: "),
        (k % 900).cast("string"), F.lit("</td><td>Stock Short Name: <b>"), F.col("c_name"), F.lit('</b></td><td><a href="/l/'), k.cast("string"), F.lit('.pdf?a=1&amp;b=2">ANNUAL <i>REPORT</i> 2024</a></td></tr></table>'),
    )
    pages = table(spark, d, "customer").select("c_custkey", page.alias("page"))
    rows = ops.parse_title_search(pages, "page", ["c_custkey"])
    return rows.join(ops.title_search_faults(pages, "page", ["c_custkey"]), "c_custkey", "left")


QUERIES["title_searches"] = title_searches
ORACLE_SQL["title_searches"] = """SELECT c_custkey, lpad(CAST(c_custkey % 900 AS VARCHAR), 5, '0') || '.HK' AS stock_code, c_name AS company_name, '2025-04-09' AS published_date, 'ANNUAL REPORT 2024' AS title,
  'https://www1.hkexnews.hk/l/' || c_custkey || '.pdf?a=1&b=2' AS source_url, 'HKEX' AS source, CASE
  WHEN c_custkey % 7 = 0 THEN 'row_count_differs' END AS fault FROM customer"""

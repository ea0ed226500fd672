"""Queries of the remaining parsers, filters and text rules over the star schema, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdigris.operators import analysis, universe
from verdigris.operators import text as ops
from verdigris.plans import text as tplan
from verdigris.plans.binding import OBS, YEAR, observations, sql_round, sql_with, table
from verdigris.sources import readers

QUERIES, ORACLE_SQL = {}, {}


def query(name, sql=None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


def pick(words, col, n):
    return F.element_at(F.array(*map(F.lit, words)), (F.col(col) % n + 1).cast("int"))


@query("equity_list", "SELECT lpad(CAST(c_custkey AS VARCHAR), 5, '0') || '.HK' AS stock_code, c_name AS company_name FROM customer WHERE c_custkey % 4 < 2")
def equity_list(spark, d):
    c = table(spark, d, "customer")
    kinds = ("Equity Securities (Main Board)", "Equity Securities (GEM)", "Investment Companies", "Equity Securities (Main Board)")
    return readers.equity_list(c.select(F.col("c_custkey").cast("string").alias("stock_code"), F.concat(F.lit(" "), "c_name").alias("company_name"), F.when(F.col("c_custkey") % 4 == 3, "Debt").otherwise("Equity").alias("category"), pick(kinds, "c_custkey", 4).alias("sub_category")))


@query("html_table_codes", "SELECT s_suppkey, CAST(1 AS INTEGER) AS row, lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS code, s_name AS name FROM supplier")
def html_table_codes(spark, d):
    page = F.concat(F.lit("<table><tr><th>code</th><th>name</th></tr>\n<TR class='x'><td> <b>"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0"), F.lit("</b></td><td>"), "s_name", F.lit("</td></TR></table>"))
    rows = readers.table_cells(table(spark, d, "supplier").select("s_suppkey", page.alias("html")), "html", ["s_suppkey"])
    return rows.filter("row = 1").select("s_suppkey", "row", F.col("cells")[0].alias("code"), F.col("cells")[1].alias("name"))


@query("profile_payload", "SELECT s_suppkey, CASE WHEN s_suppkey % 5 > 0 THEN s_name END AS name, CASE WHEN s_suppkey % 5 > 0 THEN s_nationkey END AS nation FROM supplier")
def profile_payload(spark, d):
    body = F.to_json(F.struct(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")))
    page = F.when(F.col("s_suppkey") % 5 > 0, F.concat(F.lit("<script>var issuer = "), body, F.lit(";</script>"))).otherwise("<html>")
    return readers.embedded_payload(table(spark, d, "supplier").select("s_suppkey", page.alias("h")), "h", "issuer", "name string, nation int", ["s_suppkey"])


@query("unclassified_rows", "SELECT count(*) FILTER (o_orderkey % 4 < 3) AS unclassified, count(*) AS n FROM orders")
def unclassified_rows(spark, d):
    words = (" ", "待分类", "待人工复核", "coal")
    return table(spark, d, "orders").agg(F.count_if(readers.unclassified(pick(words, "o_orderkey", 4))).alias("unclassified"), F.count(F.lit(1)).alias("n"))


@query("usable_denominators", "SELECT o_orderkey, o_orderkey % 5 IN (0, 4) AS usable FROM orders")
def usable_denominators(spark, d):
    words = ("12.5 吨/万元营收", "12 吨/万元产值", "3 kg per MWh", "emission 0.00 kg", "emission 10.05 kg")
    return table(spark, d, "orders").select("o_orderkey", ops.usable_denominator(pick(words, "o_orderkey", 5)).alias("usable"))


#: Titles with kind and preference, written out for the SQL.
TITLES = (
    ("某公司2024年年度报告", "annual_report", 0), ("某公司 2024 年度报告（修订版）", "annual_report", 0), ("2024年年度报告摘要", None, 0), ("关于2024年年度报告的更正公告", None, 0),
    ("2024年年报（H股同步披露）", "annual_report", 2), ("2024年年度报告（英文版）", "annual_report", 3), ("2023年年度报告", None, 0), ("2024年半年度报告", None, 0),
    ("2024 ESG report", "esg_report", 0), ("ESG report", None, 0), ("2024年度社会责任报告 English", "esg_report", 3), ("2023年可持续发展报告", None, 0),
    ("关于2024年年度报告的问询函回复", None, 0), ("2024年环境、社会及管治报告", "esg_report", 0), ("2024年业绩说明会", None, 0), ("news 2024", None, 0),
)


@query("title_kinds", f"""SELECT o_orderkey, x.kind, CAST(x.preference AS INTEGER) AS preference
  FROM (SELECT o_orderkey, [{", ".join(f"{{'kind': {'NULL' if k is None else repr(k)}, 'preference': {p}}}" for _, k, p in TITLES)}][o_orderkey % {len(TITLES)} + 1] AS x FROM orders)""")
def title_kinds(spark, d):
    t = pick(tuple(x for x, *_ in TITLES), "o_orderkey", len(TITLES))
    kind = ops.title_kind(t, 2024)
    return table(spark, d, "orders").select("o_orderkey", kind.alias("kind"), ops.title_preference(t, kind).alias("preference"))


@query("https_ready", "SELECT page_id, url LIKE 'https://%' AS ready FROM pages")
def https_ready(spark, d):
    return table(spark, d, "pages").select("page_id", ops.https_ready(F.col("url")).alias("ready"))


@query("page_context", sql_with(tplan.LINES, "SELECT doc_id, page, length(coalesce(lag(t) OVER (PARTITION BY doc_id ORDER BY page), '')) AS before FROM pg"))
def page_context(spark, d):
    return ops.page_context(tplan.pages(spark, d), ["doc_id"]).select("doc_id", "page", F.length("context").cast("long").alias("before"))


@query("movers", sql_with(OBS, f"yy AS (SELECT company_code, {sql_round('avg(value) FILTER (report_year = ' + str(YEAR) + ') - avg(value) FILTER (report_year = ' + str(YEAR - 1) + ')', 6)} AS change FROM obs WHERE status = 'confirmed' GROUP BY 1)", "SELECT company_code, change, 'up' AS side FROM (SELECT * FROM yy WHERE change > 0 ORDER BY change DESC, company_code LIMIT 10) "
    "UNION ALL SELECT company_code, change, 'down' FROM (SELECT * FROM yy WHERE change < 0 ORDER BY change, company_code LIMIT 10)"))
def movers(spark, d):
    known = observations(spark, d).filter("status = 'confirmed'")
    change = F.expr(f"floor((avg(value) FILTER (WHERE report_year = {YEAR}) - avg(value) FILTER (WHERE report_year = {YEAR - 1})) * 1e6D + 0.5D) / 1e6D")
    return analysis.movers(known.groupBy("company_code").agg(change.alias("change")), "change", "company_code")


@query("reprioritised_gaps", "SELECT s_suppkey, CAST(row_number() OVER (ORDER BY s_nationkey % 3, s_acctbal DESC, s_suppkey) AS INTEGER) AS place FROM supplier")
def reprioritised_gaps(spark, d):
    return analysis.reprioritised(table(spark, d, "supplier"), F.col("s_nationkey") % 3, F.desc("s_acctbal"), F.col("s_suppkey")).select("s_suppkey", "place")


@query("access_columns", "SELECT s_suppkey, s_name FROM supplier")
def access_columns(spark, d):
    return analysis.access(table(spark, d, "supplier"), "BASIC", {"BASIC": ("s_suppkey", "s_name"), "PREMIUM": ("s_suppkey", "s_name", "s_acctbal")})


ALIGNED = {"Q_E_ENERGY_INTENSITY": "energy use", "Q_E_WATER_INTENSITY": "water"}


def aligned_pages(spark, d):
    k = F.col("s_suppkey").cast("string")
    lines = F.concat_ws("\n", F.concat(F.lit("Energy use\t1,"), F.lpad(k, 3, "0"), F.lit("\tMWh")), F.concat(F.lit("  water used   n/a   "), k), F.lit("energy use one two"), F.lit("资产负债率 50%"))
    return table(spark, d, "supplier").select("s_suppkey", F.lit(4).alias("page"), lines.alias("page_text"))


@query("aligned_tables", "SELECT s_suppkey, 'Q_E_ENERGY_INTENSITY' AS indicator_code, CAST('1' || lpad(CAST(s_suppkey AS VARCHAR), 3, '0') AS DOUBLE) AS value FROM supplier "
    "UNION ALL SELECT s_suppkey, 'Q_E_WATER_INTENSITY', CAST(s_suppkey AS DOUBLE) FROM supplier")
def aligned_tables(spark, d):
    return ops.aligned_rows(aligned_pages(spark, d), ALIGNED, ["s_suppkey"]).select("s_suppkey", "indicator_code", "value")


@query("extraction_coverage", "SELECT 'Q_E_ENERGY_INTENSITY' AS indicator_code, count(*) AS candidates, count(*) AS documents, 0.7::DOUBLE AS max_confidence FROM supplier "
    "UNION ALL SELECT 'Q_E_WATER_INTENSITY', count(*), count(*), 0.7::DOUBLE FROM supplier "
    "UNION ALL SELECT 'Q_G_DEBT_ASSET_RATE', count(*), count(*), 0.9::DOUBLE FROM supplier")
def extraction_coverage(spark, d):
    return ops.extraction_coverage(ops.extract_candidates(aligned_pages(spark, d), ALIGNED, ["s_suppkey"]), ["s_suppkey"])


@query("per_capita", "SELECT s_suppkey, s_suppkey % 3 = 0 AS closes, CASE WHEN s_suppkey % 3 = 0 THEN 1000.0 / (100 + s_suppkey) END AS per_head FROM supplier")
def per_capita(spark, d):
    k = F.col("s_suppkey")
    facts = table(spark, d, "supplier").select("s_suppkey", F.lit(100).alias("begin"), (k + 5).alias("inc"), (5 + k % 3).alias("dec"), (100 + k).alias("end"), F.lit(1000.0).alias("total"))
    return ops.per_capita(facts).select("s_suppkey", "closes", "per_head")


@query("social_rates", f"SELECT o_custkey, {sql_round('t * 100 / r', 6)} AS value FROM (SELECT o_custkey, count(*) * 10.0 AS t, max(o_custkey % 50 + 100.0) AS r FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) = 1 OR o_custkey % 2 = 0) WHERE t * 100 / r BETWEEN 1 AND 60")
def social_rates(spark, d):
    o = table(spark, d, "orders")
    totals = o.groupBy("o_custkey").agg((F.count(F.lit(1)) * 10.0).alias("total")).withColumn("indicator_code", F.lit("Q_S_DONATION_RATE"))
    # odd customers state as many different revenues as their orders have states
    own = o.select("o_custkey", F.when(F.col("o_custkey") % 2 == 1, F.ascii("o_orderstatus")).otherwise(0).alias("s"))
    least = own.groupBy("o_custkey").agg(F.min("s").alias("low"))
    revenue = own.join(least, "o_custkey").select("o_custkey", (F.col("o_custkey") % 50 + 100.0 + F.col("s") - F.col("low")).alias("revenue"))
    made = ops.money_rates(totals, revenue, ["o_custkey"], {"Q_S_DONATION_RATE": (1.0, 60.0)})
    return made.select("o_custkey", F.expr("floor(value * 1e6D + 0.5D) / 1e6D").alias("value"))


HALVES = "h AS (SELECT c_custkey AS code, 'a' AS snapshot FROM customer WHERE c_custkey % 3 < 2 UNION ALL SELECT c_custkey, 'b' FROM customer WHERE c_custkey % 3 > 0)"


@query("snapshot_merge", f"WITH {HALVES} SELECT code, count(*) AS n, count(*) > 1 AS fault FROM h GROUP BY 1")
def snapshot_merge(spark, d):
    """Two snapshots that cover all customers, a third of them twice: rows of each code, and whether the merge names it."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("code"))
    rows, faults = universe.merge_snapshots([c.filter("code % 3 < 2").withColumn("snapshot", F.lit("a")), c.filter("code % 3 > 0").withColumn("snapshot", F.lit("b"))], "code")
    found = rows.groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    return found.join(faults.select("code", F.lit(True).alias("f")), "code", "left").select("code", "n", F.coalesce("f", F.lit(False)).alias("fault"))


@query("key_set_differences", """SELECT k, CASE WHEN a AND b THEN 'shared' WHEN a THEN 'missing' ELSE 'unknown' END AS side FROM (
  SELECT k, bool_or(s = 1) AS a, bool_or(s = 2) AS b FROM (SELECT o_custkey AS k, 1 AS s FROM orders UNION ALL SELECT CASE WHEN c_custkey % 5 = 0 THEN -c_custkey ELSE c_custkey END, 2 FROM customer) GROUP BY 1)""")
def key_set_differences(spark, d):
    """Customers of orders against the customers, every fifth of them under another key."""
    k = F.col("c_custkey")
    known = table(spark, d, "customer").select(F.when(k % 5 == 0, -k).otherwise(k).alias("k"))
    return universe.key_differences(table(spark, d, "orders").select(F.col("o_custkey").alias("k")), known, ["k"])

"""Queries of tables in page texts over documents made from suppliers: a table of years, cards, a summary and statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdigris.operators import tables as ops
from verdigris.operators import statements, totals
from verdigris.plans.binding import sql_with, table

QUERIES, ORACLE_SQL = {}, {}


def query(name, sql=None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


#: Rows of a table of years as label, what stands before and after the values, the indicator and factor that they give.
ROWS = (
    ("温室气体排放强度", "吨二氧化碳当量/百万元营收", "", "Q_E_GHG_INTENSITY", 10.0), ("综合能耗强度（吨标准煤／万元）", "", "", "Q_E_ENERGY_INTENSITY", 1000.0), ("用水强度", "", "吨/万元", "Q_E_WATER_INTENSITY", 1000.0),
    ("氮氧化物排放强度", "克/万元", "", "Q_E_NOX_INTENSITY", 1.0), ("每百万营收产生的有害废弃物总量", "吨", "", "Q_E_HAZ_WASTE_INTENSITY", 10.0), ("女性员工占比", "%", "", "Q_S_FEMALE_EMPLOYEE_RATE", 1.0),
    ("人均薪酬", "万元/人", "", "Q_S_PAY_PER_EMPLOYEE", 10000.0), ("温室气体排放总量", "万吨", "", "Q_E_GHG_EMISSION", 10000.0), ("用水总量", "\n", "吨", "Q_E_WATER_CONSUMPTION", 1.0),
    ("二氧化硫排放量", "千克", "", "Q_E_SO2_EMISSION", 0.001), ("危险废物产生总量", "吨", "", "Q_E_HAZ_WASTE_GENERATION", 1.0), ("综合能源消耗量", "吨标准煤", "", "Q_E_ENERGY_CONSUMPTION", 1.0),
    ("温室气体排放强度", "磅/万元", "", None, 0.0), ("董事会会议次数", "次", "", "Q_G_BOARD_MEETING_FREQ", 1.0), ("天气", "度", "", None, 0.0),
)
YEAR = 2024


def money(x):
    """An amount as statements write it."""
    return F.format_number(x.cast("double"), 2)


def report_pages(spark, d):
    """Six pages of each supplier's report; numbers follow from the key k."""
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    now, before = F.concat((k % 40 + 1).cast("string"), F.lit(".5")), F.concat((k % 30 + 2).cast("string"), F.lit(".25"))
    pick = lambda i: F.element_at(F.array(*[F.lit(r[i]) for r in ROWS]), (k % len(ROWS) + 1).cast("int"))
    order = k % 4  # current first, current last, one year, no clear header
    header = F.when(order == 0, "指标 单位 2024年 2023年").when(order == 1, "指标 单位 2023年 2024年").when(order == 2, "指标名称 2024 年").otherwise("指标 2023-2024年 2024年 2023年")
    values = F.when(order == 1, F.concat_ws(" ", before, now)).when(order == 2, now).otherwise(F.concat_ws(" ", now, before))
    years = F.concat(F.lit("环境绩效\n"), header, F.lit("\n"), pick(0), F.lit(" "), pick(1), F.lit(" "), values, F.lit(" "), pick(2), F.lit("\n说明"))
    card = F.concat(F.lit("亮点\n"), now, F.when(k % 3 == 0, " 吨标煤/百万元\n单位营收综合能源消耗量").when(k % 3 == 1, "\n吨/百万元\n营业收入\n危险废弃物产生强度").otherwise(" %\n环保投入占营业收入比例"))
    assets, liabilities = k * 1000 + 5000, k * 400 + 2000
    equity = assets - liabilities + F.when(k % 7 == 0, assets / 5).otherwise(0)
    summary = F.concat(F.lit("近三年主要会计数据\n单位：万元\n营业收入 "), money(k * 10 + 100), F.lit(" "), money(k * 9 + 100), F.lit("\n"))
    two = lambda label, a, b: F.concat(F.lit(label + " "), money(a), F.lit(" "), money(b), F.lit("\n"))
    balance = F.concat(F.lit("1、合并资产负债表\n"), two("流动资产合计", assets / 2, assets / 4), two("存货", assets / 10, assets / 20), two("资产总计", assets, assets * 0.5), two("流动负债合计", liabilities / 2, liabilities / 4), two("非流动负债合计", liabilities / 2, liabilities / 4), two("负债合计", liabilities, liabilities / 2), two("归属于母公司所有者权益合计", equity - 1, equity), two("所有者权益合计", equity, equity * 0.5))
    income = F.concat(F.lit("合并利润表\n营业利润："), money(k), F.lit("\n"), two("营业利润", k * 100 + 50, k * 50 + 25), two("利润总额", k * 90, k), two("利息费用", k * 0 + 10, k), F.lit("五、净利润（净亏损以“－”号填列） "), money(k * 80), F.lit(" "), money(k), F.lit("\n"))
    parent = F.concat(F.lit("母公司利润表\n"), two("研发费用", k, k), two("营业总成本", k, k))
    return s.select("s_suppkey", F.inline(F.array(*[F.struct(F.lit(i).alias("page"), t.alias("page_text")) for i, t in enumerate((years, card, summary, balance, income, parent), 1)])))


NUMBERS = "n AS (SELECT s_suppkey, s_suppkey AS k, s_suppkey % 40 + 1.5 AS now FROM supplier)"
WANTED = ", ".join(f"({i}, '{c}', {f!r}::DOUBLE)" for i, (*_, c, f) in enumerate(ROWS) if c)


@query("year_rows", sql_with(NUMBERS, f"SELECT s_suppkey, code AS indicator_code, CAST(round(CAST(now AS DOUBLE) * factor, 6) AS DOUBLE) AS value, CASE k % 4 WHEN 0 THEN 'current-first' WHEN 1 THEN 'current-last' ELSE 'single-year' END AS mode FROM n JOIN (VALUES {WANTED}) AS w(i, code, factor) ON k % {len(ROWS)} = i WHERE k % 4 < 3"))
def year_rows(spark, d):
    return ops.year_rows(report_pages(spark, d), ["s_suppkey"], YEAR).select("s_suppkey", "indicator_code", F.round("value", 6).alias("value"), "mode")


@query("card_values", sql_with(NUMBERS, "SELECT s_suppkey, ['Q_E_ENERGY_INTENSITY', 'Q_E_HAZ_WASTE_INTENSITY', 'Q_S_ENV_INVEST_RATE'][k % 3 + 1] AS indicator_code, CAST(now * CASE "
    "WHEN k % 3 = 2 THEN 1 ELSE 10 END AS DOUBLE) AS value FROM n"))
def card_values(spark, d):
    return ops.card_values(report_pages(spark, d), ["s_suppkey"]).select("s_suppkey", "indicator_code", "value")


@query("summary_revenue", "SELECT s_suppkey, CAST((s_suppkey * 10 + 100) * 10000.0 AS DOUBLE) AS revenue, round((s_suppkey + 0.0) / (s_suppkey * 9 + 100) * 100, 6)::DOUBLE AS growth FROM supplier")
def summary_revenue(spark, d):
    found = ops.summary_revenue(report_pages(spark, d), ["s_suppkey"])
    growth = ops.revenue_growth(found, ["s_suppkey"]).select("s_suppkey", F.round("value", 6).alias("growth"))
    return found.select("s_suppkey", "revenue").join(growth, "s_suppkey")


BOOKS = """b AS (SELECT s_suppkey, k, k * 1000.0::DOUBLE + 5000 AS assets, k * 400.0::DOUBLE + 2000 AS liabilities, CAST((k * 10 + 100) * 10000 AS DOUBLE) AS revenue FROM n),
s AS (SELECT *, assets - liabilities + CASE WHEN k % 7 = 0 THEN assets / 5 ELSE 0 END AS equity FROM b)"""


@query("statement_facts", sql_with(NUMBERS, BOOKS, """SELECT s_suppkey, fact, round(current, 2)::DOUBLE AS current, CAST(page AS INTEGER) AS page FROM (
  SELECT s_suppkey, unnest(['assets', 'liabilities', 'current_assets', 'current_liabilities', 'inventory', 'equity', 'operating_profit', 'profit_total', 'interest', 'net_profit']) AS fact,
    unnest([assets, liabilities, assets / 2, liabilities / 2, assets / 10, equity, k * 100.0 + 50, k * 90.0, 10.0, k * 80.0]) AS current, unnest([4, 4, 4, 4, 4, 4, 5, 5, 5, 5]) AS page
  FROM s)"""))
def statement_facts(spark, d):
    return ops.statement_facts(report_pages(spark, d), ["s_suppkey"]).select("s_suppkey", "fact", F.round("current", 2).alias("current"), "page")


@query("statement_rates", sql_with(NUMBERS, BOOKS, """SELECT s_suppkey, code AS indicator_code, round(x, 4)::DOUBLE AS value FROM (
  SELECT s_suppkey, k % 7 <> 0 AS ok, unnest(['Q_G_DEBT_ASSET_RATE', 'Q_G_CURRENT_RATIO', 'Q_G_QUICK_RATIO', 'Q_G_OPERATING_MARGIN', 'Q_G_OPERATING_PROFIT_GROWTH', 'Q_G_EBITDA_INTEREST', 'Q_G_ROA', 'Q_G_ROE']) AS code, unnest([0, 0, 0, 1, 1, 1, 0, 0]) AS always,
    unnest([liabilities / assets * 100, assets / liabilities * 100, (assets / 2 - assets / 10) / (liabilities / 2) * 100, (k * 100.0 + 50) / revenue * 100, 100.0, (k * 90.0 + 10) / 10, (k * 90.0 + 10) / (assets * 0.75) * 100, k * 80.0 / (equity * 0.75) * 100]) AS x
  FROM s) WHERE ok OR always = 1"""))
def statement_rates(spark, d):
    pages = report_pages(spark, d)
    rates = ops.statement_rates(ops.statement_facts(pages, ["s_suppkey"]), ops.summary_revenue(pages, ["s_suppkey"]), ["s_suppkey"])
    return rates.select("s_suppkey", "indicator_code", F.round("value", 4).alias("value"))


#: Of each kind of total one page: label, unit, kilograms of the unit, indicator, and the indicator's bounds.
KINDS = (
    ("温室气体排放总量", "万吨二氧化碳当量", 1e7, "Q_E_GHG_INTENSITY", 0.001, 2e5), ("用水总量", "立方米", 1e3, "Q_E_WATER_INTENSITY", 0.001, 5e6), ("二氧化硫排放总量", "千克", 1.0, "Q_E_SO2_INTENSITY", 0.001, 1e5),
    ("危险废物产生量", "吨", 1e3, "Q_E_HAZ_WASTE_INTENSITY", 0.0001, 1e5), ("综合能源消耗总量", "吨标准煤", 1e3, "Q_E_ENERGY_INTENSITY", 0.0001, 1e5),
)


def emission_pages(spark, d):
    """Two documents of each customer, each with a page with a total and one with scopes.

    Every seventh customer's documents differ in the total. The second page states scopes 1 and 2 alone, or a total with
    scopes that close or not, or with scope 3, by location and market, or a zero in a section of gases.
    """
    c, i = F.col("c_custkey"), F.col("document")
    pick = lambda n: F.element_at(F.array(*[F.lit(r[n]) for r in KINDS]), (c % len(KINDS) + 1).cast("int"))
    amount = (c * 10 + F.when(c % 7 == 0, i).otherwise(0)).cast("string")
    header = F.lit(f"指标 单位 {YEAR - 1}年 {YEAR}年\n")
    table_page = F.concat(header, pick(0), F.lit(" "), pick(1), F.lit(" 77 "), amount, F.lit("\n"))
    one, two = (c * 3).cast("string"), (c * 5).cast("string")
    rows = F.concat(F.lit("范围1温室气体排放总量 吨二氧化碳当量 7 "), one, F.lit("\n范围2温室气体排放总量 吨二氧化碳当量 7 "), two, F.lit("\n"))
    stated = lambda x: F.concat(header, F.lit("温室气体排放总量 吨二氧化碳当量 9 "), x.cast("string"), F.lit("\n"))
    scopes = (
        F.when(c % 6 == 0, F.concat(F.lit("范围一排放 "), one, F.lit(" 吨\n范围二排放 "), two, F.lit(" 吨\n"))).when(c % 6 == 1, F.concat(stated(c * 8), rows)).when(c % 6 == 2, F.concat(stated(c * 9), rows))
        .when(c % 6 == 3, F.concat(stated(c * 8), F.lit("范围三温室气体排放量 吨二氧化碳当量 4 "), two, F.lit("\n")))
        .when(c % 6 == 4, F.concat(F.lit("范围一排放 "), one, F.lit(" 吨\n范围二排放基于市场 1 吨\n范围二排放基于位置 "), two, F.lit(" 吨\n")))
        .otherwise(F.concat(header, F.lit("气体污染物排放\n氮氧化物 千克 5 0\n二氧化硫 千克 4 0\n")))
    )
    # a small file is one task; the texts made of it are dealt out to all cores
    documents = table(spark, d, "customer").select("c_custkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("document")).repartition(spark.sparkContext.defaultParallelism, "c_custkey")
    return documents.select(c.alias("company"), "document", F.inline(F.array(F.struct(F.lit(1).alias("page"), table_page.alias("page_text")), F.struct(F.lit(2).alias("page"), scopes.alias("page_text")))))


TOTALS_SQL = f"""kinds AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{c}', {kilos!r}::DOUBLE)" for i, (_, _, kilos, c, _, _) in enumerate(KINDS))}) AS t(slot, code, kilos)),
limits AS (SELECT * FROM (VALUES {", ".join(f"('{c}', {low!r}::DOUBLE, {high!r}::DOUBLE)" for _, _, _, c, low, high in KINDS)}, ('Q_E_NOX_INTENSITY', 0.001, 1e5)) AS t(code, low, high)),
totals AS (
  SELECT c_custkey AS company, code, (c_custkey * 10 + CASE WHEN c_custkey % 7 = 0 THEN i ELSE 0 END) * kilos AS kg, false AS named FROM customer CROSS JOIN range(2) AS r(i) JOIN kinds ON c_custkey % {len(KINDS)} = kinds.slot WHERE c_custkey > 0 OR i > 0
  UNION ALL SELECT c_custkey, 'Q_E_GHG_INTENSITY', c_custkey * 8000.0, c_custkey % 6 <> 1 FROM customer WHERE c_custkey % 6 IN (0, 1, 4) AND c_custkey > 0
  UNION ALL SELECT c_custkey, 'Q_E_NOX_INTENSITY', 0.0, false FROM customer WHERE c_custkey % 6 = 5
), told AS (
  SELECT company, code, CASE WHEN max(kg) - min(kg) <= 1e-4 * greatest(max(kg), 1) THEN min(kg)
    WHEN max(kg) FILTER (named) - min(kg) FILTER (named) <= 1e-4 * greatest(max(kg) FILTER (named), 1) THEN min(kg) FILTER (named) END AS kg
  FROM totals GROUP BY 1, 2
)"""


@query("total_intensities", sql_with(TOTALS_SQL, """SELECT company, code AS indicator_code, round(kg * CASE WHEN code IN ('Q_E_SO2_INTENSITY', 'Q_E_NOX_INTENSITY') THEN 1000 ELSE 1 END * 10000 / ((company % 1000 + 1) * 1e7), 6)::DOUBLE AS value
FROM told JOIN limits USING (code) WHERE kg IS NOT NULL AND (kg * CASE WHEN code IN ('Q_E_SO2_INTENSITY', 'Q_E_NOX_INTENSITY') THEN 1000 ELSE 1 END * 10000 / ((company % 1000 + 1) * 1e7) BETWEEN low AND high OR kg = 0 AND code = 'Q_E_NOX_INTENSITY')"""))
def total_intensities(spark, d):
    pages = emission_pages(spark, d)
    found = totals.page_totals(pages, ["company", "document"], YEAR)
    revenue = pages.select("company").distinct().withColumn("revenue", (F.col("company") % 1000 + 1) * 1e7)
    return totals.derived_intensities(found, revenue, totals.stated_intensities(pages, ["company"]), ["company"]).select("company", "indicator_code", F.round("value", 6).alias("value"))


def staff_pages(spark, d):
    """Two pages of each supplier: spending by year, and accounts of pay that close but for every fifth supplier."""
    k = F.col("s_suppkey")
    spending = F.concat(F.lit("单位 2024年 2023年\n环保总投入 万元 "), k.cast("string"), F.lit(" 5\n安全生产投入 元 "), (k * 100).cast("string"), F.lit(" 7\n"), F.when(k % 3 == 0, "累计对外捐赠 万元 9 8").otherwise("对外捐赠 万元 2 1"), F.lit("\n温室气体排放总量 吨 "), (k % 50 + 60).cast("string"), F.lit(" 100"), F.when(k % 4 == 0, " （口径变化）").otherwise(""))
    wrong = F.when(k % 5 == 0, 7).otherwise(0)
    pay = F.concat(F.lit("报告期末在职员工的数量合计 1,"), F.lpad((k % 900).cast("string"), 3, "0"), F.lit(" 人\n工资、奖金、津贴和补贴 "), money(k + wrong), F.lit(" "), money(k * 1000), F.lit(" "), money(k * 900), F.lit(" "), money(k * 101), F.lit("\n职工福利费 "), money(k * 10), F.lit(" "), money(k * 10 + wrong), F.lit(" 0.00\n"))
    return table(spark, d, "supplier").select("s_suppkey", F.inline(F.array(F.struct(F.lit(1).alias("page"), spending.alias("page_text")), F.struct(F.lit(2).alias("page"), pay.alias("page_text")))))


@query("investment_rates", "SELECT s_suppkey, unnest(['Q_S_ENV_INVEST_RATE', 'Q_S_SAFETY_INVEST_RATE']) AS indicator_code, unnest([round(s_suppkey / ((s_suppkey * 10.0 + 100)) * 100, 6), round(s_suppkey * 100 / ((s_suppkey * 10.0 + 100) * 10000) * 100, 6)])::DOUBLE AS value "
    "FROM supplier WHERE s_suppkey > 0 UNION ALL SELECT s_suppkey, 'Q_S_DONATION_RATE', round(2 / (s_suppkey * 10.0 + 100) * 100, 6)::DOUBLE FROM supplier "
    "WHERE s_suppkey % 3 <> 0")
def investment_rates(spark, d):
    revenue = ops.summary_revenue(report_pages(spark, d), ["s_suppkey"])
    return ops.investment_rates(staff_pages(spark, d), revenue, ["s_suppkey"], YEAR).select("s_suppkey", "indicator_code", F.round("value", 6).alias("value"))


@query("ghg_reduction", "SELECT s_suppkey, 100.0::DOUBLE - (s_suppkey % 50 + 60) AS value FROM supplier WHERE s_suppkey % 4 <> 0 AND s_suppkey % 50 + 60 <= 100")
def ghg_reduction(spark, d):
    return ops.ghg_reduction(ops.year_rows(staff_pages(spark, d), ["s_suppkey"], YEAR), ["s_suppkey"]).select("s_suppkey", F.round("value", 6).alias("value"))


@query("payments_per_head", "SELECT s_suppkey, unnest(['Q_S_PAY_PER_EMPLOYEE', 'Q_S_BENEFIT_PER_EMPLOYEE']) AS indicator_code, unnest([round(s_suppkey * 1000 / (1000.0 + s_suppkey % 900), 6), round(s_suppkey * 10 / (1000.0 + s_suppkey % 900), 6)])::DOUBLE AS value "
    "FROM supplier WHERE s_suppkey % 5 <> 0")
def payments_per_head(spark, d):
    return ops.payments_per_head(staff_pages(spark, d), ["s_suppkey"]).select("s_suppkey", "indicator_code", F.round("value", 6).alias("value"))


ENGLISH = (
    ("GHG emissions intensity (Scope 1 and 2)", "tCO2e/RMB million", "Q_E_GHG_INTENSITY", 10.0), ("Comprehensive energy consumption intensity", "tonnes of standard coal equivalent per RMB10,000", "Q_E_ENERGY_INTENSITY", 1000.0),
    ("Water consumption density", "cubic metres/RMB million of revenue", "Q_E_WATER_INTENSITY", 10.0), ("NOx emission intensity", "kg/RMB million", "Q_E_NOX_INTENSITY", 10.0), ("Non-hazardous waste generation intensity", "kg per CNY 100 million", "Q_E_SOLID_WASTE_INTENSITY", 0.0001),
    ("Hazardous waste intensity", "tonnes/RMB thousand", "Q_E_HAZ_WASTE_INTENSITY", 10000.0), ("Total greenhouse gas emissions (Scope 1 & 2)", "tonnes of CO2 equivalent", "Q_E_GHG_EMISSION", 1.0), ("Total energy consumption", "tce", "Q_E_ENERGY_CONSUMPTION", 1.0),
    ("Total hazardous waste generated", "kg", "Q_E_HAZ_WASTE_GENERATION", 0.001), ("Percentage of female employees", "%", "Q_S_FEMALE_EMPLOYEE_RATE", 1.0), ("Hazardous waste intensity", "pounds/RMB thousand", None, 0.0), ("Total sunshine", "hours", None, 0.0),
)
EN_WANTED = ", ".join(f"({i}, '{c}', {f!r}::DOUBLE)" for i, (*_, c, f) in enumerate(ENGLISH) if c)


@query("english_year_rows", sql_with(NUMBERS, f"SELECT s_suppkey, code AS indicator_code, CAST(round(CAST(now AS DOUBLE) * factor, 9) AS DOUBLE) AS value, CASE k % 3 WHEN 0 THEN 'current-first' WHEN 1 THEN 'current-last' ELSE 'single-year' END AS mode FROM n JOIN (VALUES {EN_WANTED}) AS w(i, code, factor) ON k % {len(ENGLISH)} = i"))
def english_year_rows(spark, d):
    k = F.col("s_suppkey")
    now, before = F.concat((k % 40 + 1).cast("string"), F.lit(".5")), F.lit("1,234.5")
    pick = lambda i: F.element_at(F.array(*[F.lit(r[i]) for r in ENGLISH]), (k % len(ENGLISH) + 1).cast("int"))
    header = F.when(k % 3 == 0, "Indicator Unit 2024 2023").when(k % 3 == 1, "Indicator Unit 2023 2024").otherwise("Indicator Unit 2024")
    values = F.when(k % 3 == 0, F.concat_ws(" ", now, before)).when(k % 3 == 1, F.concat_ws(" ", before, now)).otherwise(now)
    pages = table(spark, d, "supplier").select("s_suppkey", F.lit(1).alias("page"), F.concat(header, F.lit("\n"), F.concat_ws(" ", pick(0), pick(1), values)).alias("page_text"))
    return ops.year_rows(pages, ["s_suppkey"], YEAR, ops.ENGLISH_ROWS).select("s_suppkey", "indicator_code", F.round("value", 9).alias("value"), "mode")


def return_pages(spark, d):
    """Two pages of each supplier: a summary row or a transposed table of returns on equity, and a balance sheet without the names of its totals."""
    k = F.col("s_suppkey")
    now = F.concat((k % 50 - 20).cast("string"), F.lit(".5"))
    rows = (
        F.when(k % 6 == 0, F.concat(F.lit("主要会计数据\n加权平均净资产\n收益率\n"), now, F.lit("% 0.93% 0.12%\n"))).when(k % 6 == 1, F.concat(F.lit("加权平均净资产收益率（%） "), now, F.lit(" 3.10 2.00\n扣除非经常性损益后的加权平均净资产收益率（%） 9.99 1.00\n")))
        .when(k % 6 == 2, F.concat(F.lit("加权平均净资产收益率 "), now, F.lit(" 3.10\n"))).when(k % 6 == 3, F.lit("加权平均净资产收益率 不适用 3.10%\n"))
        .when(k % 6 == 4, F.concat(F.lit("报告期利润 加权平均净资产收益率 每股收益\n归属于公司普通股股东的净利润 "), now, F.lit("% 0.5 0.5\n扣除非经常性损益后归属于公司普通股股东的净利润 7.77% 0.1 0.1\n"))).otherwise(F.concat(F.lit("归属于公司普通股股东的净利润 "), now, F.lit("% 0.5 0.5\n")))
    )
    whole = lambda x: F.format_number(x.cast("double"), 0)
    debt, other = k * 3 + 200, k * 5 + 100
    equity = k * 7 + 1000 + F.when(k % 5 == 0, 50 + k).otherwise(0)
    net = k * 12 + 1100
    line = lambda x, y: F.concat(x, F.lit(" "), y, F.lit("\n"))
    minus = lambda x: F.concat(F.lit("("), whole(x), F.lit(")"))
    sheet = F.concat(
        F.lit("Consolidated Statement of Financial Position\n2024 2023\nCurrent assets\n"), line(whole(k * 2 + 50), whole(k + 50)), F.lit("Current liabilities\n"), line(minus(debt), minus(debt)), F.lit("Net current liabilities (5) (6)\n"),
        F.lit("Total assets less current liabilities "), line(whole(net), whole(net)), F.lit("Equity\n"), line(whole(equity), whole(k * 7 + 1000)), F.lit("Non-current liabilities\n"), line(whole(other), whole(other)), F.lit("Equity and non-current liabilities 1 1\n"),
    )
    return table(spark, d, "supplier").select("s_suppkey", F.inline(F.array(F.struct(F.lit(1).alias("page"), rows.alias("page_text")), F.struct(F.lit(2).alias("page"), sheet.alias("page_text")))))


@query("roe_values", "SELECT s_suppkey, CAST(CASE WHEN s_suppkey % 50 < 20 THEN s_suppkey % 50 - 20 - 0.5 ELSE s_suppkey % 50 - 20 + 0.5 END AS DOUBLE) AS value, CASE WHEN s_suppkey % 6 = 4 THEN 'transposed' ELSE 'summary' END AS form FROM supplier WHERE s_suppkey % 6 IN (0, 1, 4)")
def roe_values(spark, d):
    return statements.roe_values(return_pages(spark, d), ["s_suppkey"]).select("s_suppkey", "value", "form")


@query("implicit_balances", """SELECT s_suppkey, fact, CAST(value AS DOUBLE) AS value FROM (
  SELECT s_suppkey, unnest(['assets', 'liabilities', 'current_assets', 'current_liabilities', 'equity']) AS fact,
    unnest([s_suppkey * 15 + 1300, s_suppkey * 8 + 300, s_suppkey * 2 + 50, s_suppkey * 3 + 200, s_suppkey * 7 + 1000]) AS value FROM supplier WHERE s_suppkey % 5 <> 0)""")
def implicit_balances(spark, d):
    return statements.implicit_balances(return_pages(spark, d), ["s_suppkey"]).select("s_suppkey", "fact", F.col("current").alias("value"))

"""Tables in page texts: rows under a header of years, highlight cards, financial statements, and what follows from them.

A page's column mode comes from its own header; a row needs as many values as the header has years. Statements run from
their title to the next one; a fact is a label with the first two amounts after it. Everything works on lines and short
matches as columns; a document's pages meet in one window of narrow rows.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.functions.text import FROM, TO, joined_labels, number
from verdigris.operators.rules import MASS, MONEY, N, generated, lookup, plausible

# Labels with the kind of their unit, for rows of Chinese indicator tables.

#: Kinds: what one unit is in the indicator's own. Money units are 10,000 yuan; "million" rows divide by a million by label.
TABLE_KINDS = {
    "percent": {"%": 1.0},
    "pay": {"万元/人": 10000.0, "万元": 10000.0, "千元/人": 1000.0, "元/人": 1.0},
    "hours": {"小时": 1.0, "课时": 1.0, "学时": 1.0},
    "people": {"人": 1.0},
    "times": {"次": 1.0},
    "tonnes": {"万吨": 10000.0, "千吨": 1000.0, "吨": 1.0, "千克": 0.001, "万立方米": 10000.0, "立方米": 1.0},
    "coal": {"万吨标准煤": 10000.0, "千吨标准煤": 1000.0, "吨标准煤": 1.0},
    "money": {"亿元": 1e8, "百万元": 1e6, "万元": 1e4, "千元": 1e3, "元": 1.0},
    "per million": {"吨二氧化碳当量": 10.0, "tco2e": 10.0, "吨标准煤": 10.0, "吨标煤": 10.0, "千克标准煤": 0.01, "吨": 10.0},
}


class Row(NamedTuple):
    code: str
    label: str
    kind: str  # of TABLE_KINDS, or kg/money, or g/money


TABLE_ROWS = (
    Row("Q_E_GHG_INTENSITY", r"(?:单位营收)?温室气体排放(?:强度|密度)", "kg/money"),
    Row("Q_E_GHG_INTENSITY", r"碳排放强度", "kg/money"),
    Row("Q_E_GHG_INTENSITY", r"营收碳强度", "kg/money"),
    Row("Q_E_GHG_INTENSITY", r"每百万营收温室气体排放总量", "per million"),
    Row("Q_E_GHG_INTENSITY", r"单位营收温室气体排放(?:量|总量)", "kg/money"),
    Row("Q_E_ENERGY_INTENSITY", r"每百万营收综合能耗(?:强度|总量)|每百万营收能源消耗(?:强度|总量)", "per million"),
    Row("Q_E_ENERGY_INTENSITY", r"(?:单位营收)?(?:综合)?能源(?:消耗|消费|使用)(?:强度|密度)|综合能耗强度|能源使用强度|单位营收综合能源消耗量", "kg/money"),
    Row("Q_E_WATER_INTENSITY", r"水资源(?:使用|消耗)强度|(?:单位营收)?(?:用水|耗水|取水)(?:强度|密度)", "kg/money"),
    Row("Q_E_SO2_INTENSITY", r"二氧化硫(?:\s*\(\s*SO[₂2]\s*\))?排放强度", "g/money"),
    Row("Q_E_NOX_INTENSITY", r"氮氧化物(?:\s*\(\s*NO[xXₓ]\s*\))?排放强度", "g/money"),
    Row("Q_E_PM_INTENSITY", r"颗粒物排放强度", "g/money"),
    Row("Q_E_WASTEWATER_INTENSITY", r"废水排放强度", "kg/money"),
    Row("Q_E_SOLID_WASTE_INTENSITY", r"每百万营收产生的无害废弃物总量|每百万营收无害废弃物(?:产生)?总量", "per million"),
    Row("Q_E_SOLID_WASTE_INTENSITY", r"一般固体废物(?:排放|产生)?(?:强度|密度)|一般固废(?:排放|产生)?(?:强度|密度)|一般废弃物产生强度|单位营收(?:一般|无害)废弃物(?:产生|处置)?量|无害废弃物总量", "kg/money"),
    Row("Q_E_HAZ_WASTE_INTENSITY", r"每百万营收产生的有害废弃物总量", "per million"),
    Row("Q_E_HAZ_WASTE_INTENSITY", r"危险废物排放强度|危险废物产生强度|危废排放强度|(?:单位营收)?危险废物密度|危险废弃物(?:排放|产生)?(?:强度|密度)", "kg/money"),
    Row("Q_S_ENV_INVEST_RATE", r"环保(?:总)?投入占营业收入(?:的)?比例|环境保护总投入占营业收入(?:的)?比例|环保费用占营业收入比例", "percent"),
    Row("Q_S_SAFETY_INVEST_RATE", r"安全生产投入占营业收入(?:的)?比例|安全投入占营业收入比例|安全费用占营业收入比例", "percent"),
    Row("Q_S_RD_RATE", r"研发(?:投入|费用)(?:总额)?占营业收入(?:的)?(?:比例|比率)|R&D投入比例", "percent"),
    Row("Q_S_DONATION_RATE", r"(?:对外)?捐赠(?:总额)?占营业收入(?:的)?比例|公益捐赠占营业收入比例", "percent"),
    Row("Q_S_PAY_PER_EMPLOYEE", r"(?:员工|职工)(?:平均)?薪酬|人均薪酬", "pay"),
    Row("Q_S_FEMALE_EMPLOYEE_RATE", r"女性员工占比|女性职工比例", "percent"),
    Row("Q_S_EMPLOYEE_TRAINING_HOUR", r"(?:员工|职工)(?:人均)?培训时长|人均培训时间", "hours"),
    Row("Q_G_DEBT_ASSET_RATE", r"资产负债率", "percent"),
    Row("Q_E_GHG_EMISSION", r"温室气体(?:排放)?(?:总)?量|碳排放(?:总)?量", "tonnes"),
    Row("Q_E_SO2_EMISSION", r"二氧化硫(?:\s*\(\s*SO[₂2]\s*\))?\s*(?:排放)?(?:总)?量|SO2(?:排放)?(?:总)?量", "tonnes"),
    Row("Q_E_NOX_EMISSION", r"氮氧化物(?:\s*\(\s*NO[xXₓ]\s*\))?\s*(?:排放)?(?:总)?量|NOx(?:排放)?(?:总)?量", "tonnes"),
    Row("Q_E_PM_EMISSION", r"颗粒物(?:排放)?(?:总)?量|粉尘(?:排放)?(?:总)?量", "tonnes"),
    Row("Q_E_WASTEWATER_DISCHARGE", r"(?:废|污)水(?:排放)?(?:总)?量", "tonnes"),
    Row("Q_E_SOLID_WASTE_GENERATION", r"一般固(?:体)?废物(?:产生)?(?:总)?量|一般固废(?:产生)?(?:总)?量", "tonnes"),
    Row("Q_E_HAZ_WASTE_GENERATION", r"危险废物(?:产生)?(?:总)?量|危废(?:产生)?(?:总)?量", "tonnes"),
    Row("Q_E_ENERGY_CONSUMPTION", r"(?:综合|总)?能源消耗(?:总)?量|能源使用(?:总)?量", "coal"),
    Row("Q_E_WATER_CONSUMPTION", r"水资源消耗(?:总)?量|用水(?:总)?量|取水(?:总)?量", "tonnes"),
    Row("Q_S_LABOR_CONTRACT_RATE", r"劳动合同签订率|劳动合同覆盖率", "percent"),
    Row("Q_S_EMPLOYEE_TURNOVER_RATE", r"员工流失率|职工离职率", "percent"),
    Row("Q_G_BOARD_SIZE", r"董事会成员|董事会人数|董事人数", "people"),
    Row("Q_G_BOARD_MEETING_FREQ", r"董事会会议次数|董事会召开次数", "times"),
    Row("Q_G_SUPERVISOR_MEETING_FREQ", r"监事会会议次数|监事会召开次数", "times"),
    Row("Q_G_SHAREHOLDER_MEETING_FREQ", r"股东大会次数|股东会议次数", "times"),
    Row("Q_G_AUDIT_COMMITTEE_MEETING_FREQ", r"审计委员会会议次数|审计委员会召开次数", "times"),
)
#: Amounts that give a rate of revenue, with the bounds of the rate in percent.
INVESTMENTS = (
    Row("Q_S_ENV_INVEST_RATE", r"(?<!累计)(?<!历年)环保(?:总)?投入(?:金额)?(?!\s*强度)(?!密度)(?!占)", "money"),
    Row("Q_S_SAFETY_INVEST_RATE", r"(?<!累计)(?<!历年)(?:职业健康(?:与)?)?安全生产(?:总)?投入(?:金额)?(?!\s*强度)(?!密度)(?!占)", "money"),
    Row("Q_S_DONATION_RATE", r"(?:(?<!接受)(?<!累计)(?<!历年)对外捐赠|公益捐赠(?:总额|支出)?(?!支出超出)|慈善捐赠(?:总额)?)(?!占)", "money"),
)
INVESTMENT_BOUNDS = {"Q_S_ENV_INVEST_RATE": (0.001, 50.0), "Q_S_SAFETY_INVEST_RATE": (0.0001, 30.0), "Q_S_DONATION_RATE": (0.00001, 10.0)}
#: Rows of pay, whose amounts are those at the beginning, added, taken away, and at the end.
PAYMENTS = (("Q_S_PAY_PER_EMPLOYEE", "工资、奖金、津贴和补贴"), ("Q_S_BENEFIT_PER_EMPLOYEE", "职工福利费"), ("Q_S_EDU_PER_EMPLOYEE", "工会经费和职工教育经费"))
STAFF = r"(?:在职员工的数量合计|报告期末在职员工的数量合计|员工总数|在岗员工总数)"
CHANGED_SCOPE = "边界变化|口径变化|口径调整|范围调整|重述|(?i:restated)"
#: Rows of English tables; "en/money" units divide by an amount of yuan, "en total" ones are tonnes or tonnes of coal.
ENGLISH_ROWS = (
    Row("Q_E_GHG_INTENSITY", r"(?:total )?(?:GHG|greenhouse gas) emissions? (?:intensity|density)(?: \(scopes? 1 (?:and|&|\+) (?:scopes? )?2\))?", "en/money"),
    Row("Q_E_ENERGY_INTENSITY", r"(?:comprehensive|total)? ?energy consumption (?:intensity|density)", "en/money"),
    Row("Q_E_WATER_INTENSITY", r"(?:total )?water consumption (?:intensity|density)", "en/money"),
    Row("Q_E_NOX_INTENSITY", r"(?:NOx|nitrogen oxides?) emissions? intensity", "en/money g"),
    Row("Q_E_SO2_INTENSITY", r"(?:SO2|sul(?:ph|f)ur dioxide) emissions? intensity", "en/money g"),
    Row("Q_E_SOLID_WASTE_INTENSITY", r"non-hazardous waste (?:generation |production |disposal )?intensity", "en/money"),
    Row("Q_E_HAZ_WASTE_INTENSITY", r"(?<!non-)hazardous waste (?:generation |production |disposal )?intensity", "en/money"),
    Row("Q_E_WASTEWATER_INTENSITY", r"(?:wastewater|sewage) (?:discharge )?intensity", "en/money"),
    Row("Q_E_GHG_EMISSION", r"total (?:GHG|greenhouse gas) emissions?(?: \(scopes? 1 (?:and|&|\+) (?:scopes? )?2\))?", "en total"),
    Row("Q_E_ENERGY_CONSUMPTION", r"(?:comprehensive|total) energy consumption", "en total"),
    Row("Q_E_WATER_CONSUMPTION", r"total water consumption", "en total"),
    Row("Q_E_SOLID_WASTE_GENERATION", r"total non-hazardous waste(?: generated| produced)?", "en total"),
    Row("Q_E_HAZ_WASTE_GENERATION", r"total hazardous waste(?: generated| produced)?", "en total"),
    Row("Q_S_FEMALE_EMPLOYEE_RATE", r"(?:percentage|proportion) of female employees", "percent"),
)
ENGLISH_MASS = r"(?:kg|kilograms?|tonnes?|tons?|tCO2-?e|tce|m3|m³|cubic metres?)(?: ?of)?(?: ?CO2(?:-?e| ?equivalents?)?)?(?: ?(?:standard )?coal(?: equivalents?)?)?"
ENGLISH_MONEY = r" ?(?:/|per) ?(?:RMB|CNY) ?(?:100 million|million|thousand|billion|10,?000|10k)(?: of revenue| revenue)?"
ENGLISH_AMOUNTS = {"thousand": 1e3, "10,000": 1e4, "10000": 1e4, "10k": 1e4, "million": 1e6, "100million": 1e8, "billion": 1e9}
MASS_WORDS = r"万?(?:吨|千克|克|立方米|吉焦|kg|tCO2e|tCO₂e)(?:二氧化碳当量|二氧化碳|标准煤|标煤)?"
MONEY_WORDS = r"(?:营收)?(?:百万元|百万|亿元|万元)(?:人民币)?(?:\(年营业收入\)|营业收入|营收|收入)?"
ENERGY_OF_GJ = 34.1208

#: Cards: the value stands before its unit and the label after it, each on a line of its own.
CARDS = (
    ("Q_E_ENERGY_INTENSITY", rf"({N})\s*(?:吨标准煤|吨标煤)\s*/\s*百万元(?:营收|营业收入)?\s*\n\s*单位营收(?:综合)?能源(?:消耗|消费)?(?:量|强度)?", 10.0),
    ("Q_E_GHG_INTENSITY", rf"({N})\s*(?:吨二氧化碳当量|吨CO2e|tCO2e)\s*/\s*百万元(?:营收|营业收入)?\s*\n\s*单位营收(?:温室气体|碳排放)(?:排放)?(?:量|强度)?", 10.0),
    ("Q_E_WATER_INTENSITY", rf"({N})\s*(?:立方米|吨|m³)\s*/\s*百万元(?:营收|营业收入)?\s*\n\s*单位营收(?:耗水|用水|取水)(?:量|强度)?", 10.0),
    ("Q_E_SOLID_WASTE_INTENSITY", rf"({N})\s*\n\s*吨\s*/\s*百万元\s*\n\s*营业收入\s*\n\s*(?:无害|一般)废弃物产生强度", 10.0),
    ("Q_E_HAZ_WASTE_INTENSITY", rf"({N})\s*\n\s*吨\s*/\s*百万元\s*\n\s*营业收入\s*\n\s*危险废弃物产生强度", 10.0),
    ("Q_E_WATER_INTENSITY", rf"({N})\s*\n\s*水资源使用强度\s*\n\s*吨\s*/\s*百万元", 10.0),
    ("Q_S_ENV_INVEST_RATE", rf"({N})\s*[%％]\s*\n\s*(?:环境保护总投入|环保(?:总)?投入)占营业收入(?:的)?比例", 1.0),
)

#: Statements by title, with the pages that one may take; a parent company's statement ends the group's.
NUMBERED = r"(?:\d{1,2}、|[（(][一二三四五六七八九十]+[)）])?\s*"
STATEMENTS = (
    ("balance", rf"(?m)^\s*{NUMBERED}合并资产负债\s*表|^\s*Consolidated (?:Balance Sheet|Statement of Financial Position)", 8),
    ("income", rf"(?m)^\s*{NUMBERED}合并利润\s*表|^\s*Consolidated (?:Income Statement|Statement of Profit or Loss)", 6),
    ("cash", rf"(?m)^\s*{NUMBERED}合并现金流量\s*表|^\s*Consolidated (?:Cash Flow Statement|Statement of Cash Flows)", 8),
    ("other", r"(?m)^\s*(?:\d{1,2}、)?母公司(?:资产负债|利润|现金流量)\s*表", 0),
)
FACTS = (
    ("balance", "assets", r"资产总计|(?i:total assets)(?! less)"),
    ("balance", "liabilities", r"(?<!流动)负债合计|(?i:total liabilities)(?! and)"),
    ("balance", "current_assets", r"(?<!非)流动资产合计|(?i:total current assets)"),
    ("balance", "current_liabilities", r"(?<!非)流动负债合计|(?i:total current liabilities)"),
    ("balance", "receivables", r"(?<!其他)应收账款|(?i:trade receivables)"),
    ("balance", "inventory", r"存货|(?i:inventories)"),
    ("balance", "equity", r"(?<!母公司)(?<!归属于母公司)(?:股东权益|所有者权益(?:[（(]或股东权益[）)])?)\s*合\s*计|(?i:total equity)"),
    ("income", "operating_cost", r"营业总成本"),
    ("income", "operating_profit", r"营业利润|(?i:operating profit)"),
    ("income", "profit_total", r"利润总额|(?i:profit before (?:income )?tax)"),
    ("income", "interest", r"利息费用|(?i:finance costs)"),
    ("income", "net_profit", r"净利润[（(]净亏损以|(?i:profit for the year)"),
    ("income", "income_tax", r"所得税费用|(?i:income tax expense)"),
    ("income", "rd_expense", r"研发费用(?!率)|(?i:research and development (?:costs|expenses))"),
    ("cash", "cash_inflow", r"经营活动现金流入小计"),
    ("cash", "cash_net", r"经营活动产生的\s*现金流\s*量净额|(?i:net cash (?:generated )?from operating activities)"),
    ("cash", "depreciation", r"固定资产折旧|(?i:depreciation and amorti[sz]ation)"),
)
AMOUNT = r"[+-]?(?:\d{1,3}(?:,\d{3})+|\d+)\.\d{2}"
SUMMARY = "近三年主要会计数据|主要会计数据和财务指标|主要会计数据及财务指标|会计数据和财务指标摘要|按中国企业会计准则编制的主要财务数据"
SCALES = {"百万元": 1e6, "万元": 1e4, "千元": 1e3, "元": 1.0, "RMB million": 1e6, "RMB’000": 1e3, "RMB'000": 1e3}

# End of fixed values.


def line_text(x: Column) -> Column:
    """Normal form of a page that keeps its lines: blanks to one space, radicals and full-width signs to plain ones, words joined over line breaks."""
    plain = F.translate(F.regexp_replace(F.regexp_replace(F.replace(x, F.lit("\x00"), F.lit("")), r"[ \t 　\r]+", " "), r" ?\n ?", "\n"), FROM, TO)
    tight = F.regexp_replace(plain, r" ?[／/╱] ?", "/")
    return F.regexp_replace(tight, r"(\d,)\n(?=\d{3}(?!\d))", "$1")


def scientific(x: Column) -> Column:
    """Numbers such as 5.294×10-3 in the form that number() reads."""
    return F.regexp_replace(x, r"(\d+(?:\.\d+)?) ?[×xX] ?10 ?[−\-﹣] ?(\d+)", "$1E-$2")


CELL = r"[+-]?\d[\d,]*(?:\.\d+)?(?:E-\d+)?"
#: Words of a header line, in plain and traditional characters.
HEADER_WORDS = "年|指标|单位|项目|指標|單位|項目|(?i)unit|indicator"
#: Lines of a block that a page has set one under another: numbers and units, no words of a label.
BARE, BLOCK_LINES = r"^[\d,.\sE%％/\-—–()吨千克公斤百万亿元营业收入立方米标准煤二氧化碳当量小时人次kgtCO₂em³³]{1,24}$", 6


def column_years(lines: Column) -> Column:
    """struct(at, years) of the page's header: the first line that names years in order, or only one; null where none is clear.

    A header has no values: no decimals, and no other numbers than years. Years that repeat or jump about are not clear.
    """
    def one(line, i):
        years = F.transform(F.regexp_extract_all(line, F.lit(r"(?<![\d.])(20\d{2})(?![\d.])"), F.lit(1)), lambda y: y.cast("int"))
        ordered = (years == F.array_sort(years)) | (years == F.reverse(F.array_sort(years)))
        clear = (F.size(years) > 0) & (F.size(F.array_distinct(years)) == F.size(years)) & ordered & ~F.regexp_replace(line, r"20\d{2}", "").rlike(r"\d") & ~line.rlike(r"20\d{2} ?[-—–至] ?20\d{2}")
        return F.when(clear & line.rlike(HEADER_WORDS), F.struct(i.alias("at"), years.alias("years")))

    return F.get(F.array_compact(F.transform(lines, one)), F.lit(0))


def table_factor(unit: Column, kind: str) -> Column:
    x = F.lower(F.regexp_replace(unit, r"\s+", ""))
    if kind in TABLE_KINDS:
        return lookup(x, {k.lower(): v for k, v in TABLE_KINDS[kind].items()})
    if kind.startswith("en"):
        kilos = F.when(x.rlike("^(kg|kilogram)"), 1.0).when(x != "", 1000.0)
        if kind == "en total":
            return kilos / 1000
        amount = lookup(F.regexp_extract(x, "(100million|million|thousand|billion|10,?000|10k)", 1), ENGLISH_AMOUNTS)
        return kilos * 10_000 / amount * F.lit(1000.0 if kind == "en/money g" else 1.0)
    mass = F.regexp_replace(F.regexp_replace(F.split(x, "/")[0], "二氧化碳当量|二氧化碳|标准煤|标煤", ""), "^tco[2₂]e$", "吨")
    ten = F.when(mass.startswith("万"), 10000.0).otherwise(1.0)
    money = F.regexp_replace(F.regexp_replace(F.split(x, "/")[1], r"^营收|人民币|\(年营业收入\)|营业收入|营收|收入", ""), "^百万$", "百万元")
    masses = {**MASS, "吉焦": ENERGY_OF_GJ}
    return ten * lookup(F.regexp_replace(mass, "^万", ""), masses) * lookup(money, {**MONEY, "亿元": 0.0001}) * F.lit(1000.0 if kind == "g/money" else 1.0)


def unit_pattern(kind: str) -> str:
    if kind in TABLE_KINDS:
        return "|".join(sorted(TABLE_KINDS[kind], key=len, reverse=True)).replace("%", "[%％]")
    if kind.startswith("en"):
        return ENGLISH_MASS if kind == "en total" else ENGLISH_MASS + ENGLISH_MONEY
    return rf"{MASS_WORDS}/{MONEY_WORDS}"


def year_rows(pages: DataFrame, keep: list[str], report_year: int, table: tuple[Row, ...] = TABLE_ROWS) -> DataFrame:
    """keep, page, indicator_code, value, previous, mode, evidence_text of rows under a header of years: the report year's value
    and that of the year before, if the header has it.

    A row's unit stands before or after its values or in brackets at its label; a row that a line break splits goes on in
    the next two lines, and one that is set vertically, a cell a line, in as many lines as hold nothing but cells. Rows need
    a value for each year; percent rows need no unit where the label's line has the sign.
    """
    text = scientific(line_text(F.col("page_text")))
    lined = pages.select(*keep, "page", F.split(text, "\n").alias("lines")).withColumn("header", column_years(F.col("lines")))
    below = lined.filter("header IS NOT NULL").filter(F.array_contains("header.years", report_year))

    def following(i):
        """The next two lines, and those after them as long as all of them hold nothing but cells."""
        after = F.slice("lines", i + 2, BLOCK_LINES)
        other = F.array_position(F.transform(after, lambda line: ~line.rlike(BARE)), F.lit(True)).cast("int")
        return F.array_join(F.slice(after, 1, F.greatest(F.lit(2), F.when(other == 0, BLOCK_LINES).otherwise(other - 1))), "\n")

    every = F.transform(F.col("lines"), lambda line, i: F.struct(i.alias("i"), line.alias("line"), following(i).alias("rest")))
    rows = below.select(*keep, "page", "header", F.explode(every).alias("r")).filter(F.col("r.i") > F.col("header.at"))
    any_label = "|".join(r.label for r in table)
    rows = rows.select(*keep, "page", "header", "r.line", "r.rest").filter(F.col("line").rlike(f"(?i){any_label}"))

    def read(m):
        out = F
        for r in table:
            start = rf"(?i)^.*?(?:{r.label})"
            unit = rf"(?i)\(?({unit_pattern(r.kind)})\)?(?!产)"

            def fields(r=r, start=start, unit=unit):
                own = F.regexp_replace(m["line"], start, "")
                whole = F.when(F.size(F.regexp_extract_all(F.regexp_replace(own, unit, " "), F.lit(CELL), F.lit(0))) < F.size(m["years"]), F.concat(own, F.lit(" "), F.replace(m["rest"], F.lit("\n"), F.lit(" ")))).otherwise(own)
                return F.struct(
                    F.lit(r.code).alias("indicator_code"), table_factor(F.translate(F.regexp_extract(whole, unit, 1), "％", "%"), r.kind).alias("factor"),
                    F.regexp_extract_all(F.regexp_replace(F.regexp_replace(whole, unit, " "), r"\([^)\d]*\d?[^)\d]*\)", " "), F.lit(CELL), F.lit(0)).alias("values"),
                )

            out = out.when(m["line"].rlike(rf"(?i)(?:{r.label})"), fields())
        return out

    read_rows = rows.withColumn("years", F.col("header.years")).select(*keep, "page", "years", "line", generated(["line", "rest", "years"], read))
    at, last = (F.nullif(F.array_position("years", F.lit(y)).cast("int"), F.lit(0)) for y in (report_year, report_year - 1))
    # more numbers than years are not clear, unless they come from the lines after the row's own
    enough = F.size("values") >= F.size("years")
    mode = F.when(F.size("years") == 1, "single-year").when(F.col("years")[0] > F.col("years")[1], "current-first").otherwise("current-last")
    out = read_rows.filter(enough).select(*keep, "page", "indicator_code", (number(F.get("values", at - 1)) * F.col("factor")).alias("value"), (number(F.get("values", last - 1)) * F.col("factor")).alias("previous"), mode.alias("mode"), F.col("line").alias("evidence_text"))
    # amounts of money are no values of their indicators yet
    sound = plausible(F.col("indicator_code"), F.col("value")) if table is not INVESTMENTS else F.col("value") >= 0
    return out.filter(sound).dropDuplicates([*keep, "page", "indicator_code", "value"])


def card_values(pages: DataFrame, keep: list[str]) -> DataFrame:
    """keep, page, indicator_code, value, evidence_text of highlight cards, whose value stands before its unit and label."""
    text = line_text(F.col("page_text"))

    def card(code: str, pattern: str, factor: float):
        return lambda m: F.struct(F.lit(code).alias("indicator_code"), (number(F.regexp_extract(m, pattern, 1)) * factor).alias("value"), m.alias("evidence_text"))

    every = [F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), card(code, pattern, factor)) for code, pattern, factor in CARDS]
    rows = pages.select(*keep, "page", F.inline(F.flatten(F.array(*every))))
    return rows.filter(plausible(F.col("indicator_code"), F.col("value"))).dropDuplicates([*keep, "page", "indicator_code", "value"])


def statement_pages(pages: DataFrame, keep: list[str]) -> DataFrame:
    """Pages with the statement they belong to: from its title to the next title, at most as many pages as it may take."""
    title = F
    for name, pattern, _ in STATEMENTS:
        title = title.when(F.col("page_text").rlike(pattern), F.struct(F.lit(name).alias("name"), F.col("page").alias("first")))
    last = F.last("_t", ignorenulls=True).over(Window.partitionBy(*keep).orderBy("page").rowsBetween(Window.unboundedPreceding, 0))
    marked = pages.withColumn("_t", title).withColumn("_t", last)
    most = lookup(F.col("_t.name"), {name: float(n) for name, _, n in STATEMENTS})
    return marked.filter(F.col("page") - F.col("_t.first") < most).withColumn("statement", F.col("_t.name")).drop("_t")


def statement_facts(pages: DataFrame, keep: list[str], span: int = 180) -> DataFrame:
    """keep, fact, page, current, previous, evidence: each label's first two amounts within `span` characters, no colon between.

    The first page that has a fact gives it. Amounts are written with two decimals, as statements write them.
    """
    located = statement_pages(pages.select(*keep, "page", F.col("page_text")), keep)
    text = F.regexp_replace(joined_labels(line_text(F.col("page_text"))), r"\n", " ")
    every = []
    for statement, fact, label in FACTS:
        found = F.regexp_extract_all(F.col("_x"), F.lit(rf"(?:{label})[^:：]{{0,{span}}}"), F.lit(0))
        with_amounts = F.filter(found, lambda m: m.rlike(AMOUNT))
        own = F.when(F.col("statement") == statement, F.get(with_amounts, F.lit(0)))
        every.append(F.struct(F.lit(fact).alias("fact"), own.alias("evidence")))
    rows = located.select(*keep, "page", "statement", text.alias("_x")).select(*keep, "page", F.inline(F.array(*every))).filter("evidence IS NOT NULL")
    amounts = F.regexp_extract_all(F.col("evidence"), F.lit(AMOUNT), F.lit(0))
    rows = rows.select(*keep, "page", "fact", number(F.get(amounts, F.lit(0))).alias("current"), number(F.get(amounts, F.lit(1))).alias("previous"), "evidence")
    best = F.min_by(F.struct("page", "current", "previous", "evidence"), "page")
    return rows.groupBy(*keep, "fact").agg(best.alias("b")).select(*keep, "fact", "b.*")


def summary_revenue(pages: DataFrame, keep: list[str]) -> DataFrame:
    """keep, revenue, previous, page: from the first page with the summary of accounting data, in yuan by the unit that the page names."""
    text = F.regexp_replace(line_text(F.col("page_text")), r"\n", " ")
    row = F.regexp_extract(F.col("_x"), rf"营业收入\s*(?:\(\s*(?:元|万元|千元|百万元)\s*\))?\s*({N})\s+({N})", 0)
    named = F.coalesce(F.nullif(F.regexp_extract(row, r"\(\s*(百万元|万元|千元|元)\s*\)", 1), F.lit("")), F.nullif(F.regexp_extract("_x", r"单位\s*[:：]\s*(?:人民币)?\s*(百万元|万元|千元|元)", 1), F.lit("")), F.lit("元"))
    numbers = F.regexp_extract_all(row, F.lit(N), F.lit(0))
    rows = pages.select(*keep, "page", text.alias("_x")).filter(F.col("_x").rlike(SUMMARY)).select(*keep, "page", (number(F.get(numbers, F.lit(0))) * lookup(named, SCALES)).alias("revenue"), (number(F.get(numbers, F.lit(1))) * lookup(named, SCALES)).alias("previous"))
    best = F.min_by(F.struct("revenue", "previous", "page"), "page")
    return rows.filter("revenue > 0").groupBy(*keep).agg(best.alias("b")).select(*keep, "b.*")


def revenue_growth(revenue: DataFrame, keep: list[str]) -> DataFrame:
    """Growth of revenue in percent, between -100 and 1,000."""
    growth = (F.col("revenue") - F.col("previous")) / F.nullif("previous", F.lit(0.0)) * 100
    return revenue.select(*keep, "page", F.lit("Q_G_REVENUE_GROWTH").alias("indicator_code"), growth.alias("value")).filter(F.col("value").between(-100, 1000))


def statement_rates(facts: DataFrame, revenue: DataFrame, keep: list[str]) -> DataFrame:
    """keep, indicator_code, value: what follows from a document's statements and revenue.

    A balance sheet counts only if assets equal liabilities and equity within 5% and liabilities are at most twice the
    assets; liabilities smaller than their current part by more than 2% are not used. Averages need both years; values
    beyond an indicator's bounds are dropped.
    """
    names = [f for _, f, _ in FACTS]
    wide = facts.groupBy(*keep).pivot("fact", names).agg(F.first(F.struct("current", "previous")))
    v, p = (lambda n: F.col(f"`{n}`.current")), (lambda n: F.col(f"`{n}`.previous"))
    joined = wide.join(revenue.select(*keep, "revenue"), keep, "left")
    over = lambda a, b: a / F.nullif(b, F.lit(0.0))
    identity = F.coalesce(F.abs(v("assets") - v("liabilities") - v("equity")) <= 0.05 * v("assets"), F.lit(True)) & F.coalesce(v("liabilities") <= 2 * v("assets"), F.lit(True))
    contained = F.coalesce(v("liabilities") >= 0.98 * v("current_liabilities"), F.lit(True))
    sound = lambda x: F.when(identity, x)
    due = lambda x: F.when(identity & contained, x)
    ebit = v("profit_total") + v("interest")
    change = over(v("operating_profit"), p("operating_profit"))
    rates = {
        "Q_G_DEBT_ASSET_RATE": (due(over(v("liabilities"), v("assets")) * 100), 0, 200),
        "Q_G_CURRENT_RATIO": (due(over(v("current_assets"), v("current_liabilities")) * 100), 0, 1e6),
        "Q_G_QUICK_RATIO": (due(over(v("current_assets") - v("inventory"), v("current_liabilities")) * 100), -1e6, 1e6),
        "Q_G_OPERATING_MARGIN": (over(v("operating_profit"), F.col("revenue")) * 100, -1e9, 1e9),
        "Q_G_OPERATING_PROFIT_GROWTH": (F.when(F.abs(change).between(0.1, 10), over(v("operating_profit") - p("operating_profit"), p("operating_profit")) * 100), -1e9, 1e9),
        "Q_G_COST_REVENUE_RATE": (over(v("operating_cost"), F.col("revenue")) * 100, -1e9, 1e9),
        "Q_G_CASH_REALIZATION": (over(v("cash_inflow"), F.col("revenue")) * 100, 10, 500),
        "Q_G_CASH_CURRENT_LIABILITY": (due(over(v("cash_net"), v("current_liabilities")) * 100), -1e9, 1e9),
        "Q_G_EBITDA_INTEREST": (over(ebit, v("interest")), -1e9, 1e9),
        "Q_G_ROA": (sound(over(ebit, (v("assets") + p("assets")) / 2) * 100), -100, 100),
        "Q_G_EBITDA_MARGIN": (over(v("net_profit") + v("income_tax") + v("interest") + v("depreciation"), F.col("revenue")) * 100, -1000, 1000),
        "Q_G_ROE": (sound(over(v("net_profit"), (v("equity") + p("equity")) / 2) * 100), -300, 300),
        "Q_S_RD_RATE": (over(v("rd_expense"), F.col("revenue")) * 100, 0, 100),
    }
    every = [F.struct(F.lit(c).alias("indicator_code"), F.when(x.between(low, high), x).alias("value")) for c, (x, low, high) in rates.items()]
    return joined.select(*keep, F.inline(F.array(*every))).filter("value IS NOT NULL")


def ghg_reduction(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Reduction of the greenhouse-gas total from a row with both years, in percent; rows that say that their scope changed give none."""
    cut = (F.col("previous") - F.col("value")) / F.nullif("previous", F.lit(0.0)) * 100
    known = rows.filter((F.col("indicator_code") == "Q_E_GHG_EMISSION") & ~F.col("evidence_text").rlike(CHANGED_SCOPE))
    return known.select(*keep, "page", F.lit("Q_E_GHG_REDUCTION_RATE").alias("indicator_code"), cut.alias("value")).filter(F.col("value").between(0, 100))


def investment_rates(pages: DataFrame, revenue: DataFrame, keep: list[str], report_year: int) -> DataFrame:
    """keep, indicator_code, value: environmental, safety and charity spending of tables of years as percentages of revenue.

    Amounts of one kind that differ give none, and so do rates beyond their bounds or stated in the text themselves.
    """
    rows = year_rows(pages, keep, report_year, INVESTMENTS)
    agreed = rows.groupBy(*keep, "indicator_code").agg(F.min("value").alias("total"), F.max("value").alias("_most")).filter("_most - total <= 1e-4 * _most")
    stated = pages.filter(F.col("page_text").rlike("(?:环保(?:总)?投入|安全生产(?:总)?投入|捐赠)[^。；\n]{0,24}占[^。；\n]{0,12}(?:营业收入|营收)")).select(*keep).distinct()
    rate = F.col("total") / F.nullif("revenue", F.lit(0.0)) * 100
    inside = F
    for code, (low, high) in INVESTMENT_BOUNDS.items():
        inside = inside.when(F.col("indicator_code") == code, rate.between(low, high))
    out = agreed.join(stated, keep, "left_anti").join(revenue.select(*keep, "revenue"), keep)
    return out.filter(inside).select(*keep, "indicator_code", rate.alias("value"))


def payments_per_head(pages: DataFrame, keep: list[str]) -> DataFrame:
    """keep, indicator_code, value: what was added to the accounts of pay, welfare and training, per employee.

    A row of four amounts counts if begin + added - taken = end within one yuan; of three, one of the ends being left out,
    if the others close. The number of employees comes from the document's first page that names it.
    """
    text = F.regexp_replace(line_text(F.col("page_text")), r"\n", " ")
    staff = number(F.nullif(F.regexp_extract("_x", rf"{STAFF}[^\d。]{{0,12}}(\d[\d,]*)", 1), F.lit("")))
    heads = pages.select(*keep, "page", text.alias("_x")).select(*keep, "page", staff.alias("n")).filter("n > 0").groupBy(*keep).agg(F.min_by("n", "page").alias("heads"))
    every = [F.struct(F.lit(code).alias("indicator_code"), F.regexp_extract("_x", rf"{label}((?:\s+{AMOUNT}){{3,4}})", 1).alias("row")) for code, label in PAYMENTS]
    rows = pages.select(*keep, "page", text.alias("_x")).select(*keep, "page", F.inline(F.array(*every))).filter("row <> ''")
    x = F.transform(F.regexp_extract_all("row", F.lit(AMOUNT), F.lit(0)), lambda a: F.replace(a, F.lit(","), F.lit("")).try_cast("double"))
    a, b, c, d = (F.get("x", F.lit(i)) for i in range(4))
    added = F.when(F.size("x") == 4, F.when(F.abs(a + b - c - d) <= 1, b)).when(F.abs(a - b - c) <= 1, a).when(F.abs(a + b - c) <= 1, b)
    found = rows.withColumn("x", x).withColumn("added", added).filter("added > 0").groupBy(*keep, "indicator_code").agg(F.min_by("added", "page").alias("added"))
    return found.join(heads, keep).select(*keep, "indicator_code", (F.col("added") / F.col("heads")).alias("value"))

"""Queries of the text rules over pages made from customers: examples of every rule, and of what rules must leave alone."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdigris.operators import rules as ops
from verdigris.plans.binding import table

QUERIES, ORACLE_SQL = {}, {}

#: A page's text with {v} for a number such as 07.5, and what is read from it: indicator and factor, more of them after
#: further bars; no indicator where nothing is to be read.
EXAMPLES = """
温室气体排放强度为 {v} 吨二氧化碳当量/万元营业收入。|Q_E_GHG_INTENSITY|1000
综合能源消耗强度 {v}千克标准煤/百万元|Q_E_ENERGY_INTENSITY|0.01
氮氧化物(NOx)排放强度：{v} 千克／万元|Q_E_NOX_INTENSITY|1000
二氧化硫排放强度 {v}克/百万元营收|Q_E_SO2_INTENSITY|0.01
水资源消耗强度 {v}立方米/万元|Q_E_WATER_INTENSITY|1000
一般固体废物排放强度 {v} 吨/百万元|Q_E_SOLID_WASTE_INTENSITY|10
安全生产投入占比为 {v}％。|Q_S_SAFETY_INVEST_RATE|1
研究开发费用占比 {v}%。|Q_S_RD_RATE|1
公司资产负债率为 {v}%，下同|Q_G_DEBT_ASSET_RATE|1
员工平均薪酬 {v}万元/人|Q_S_PAY_PER_EMPLOYEE|10000
环境保护投入占比 {v}% 左右|Q_S_ENV_INVEST_RATE|1
颗粒物排放强度 {v}克/万元|Q_E_PM_INTENSITY|0.001
危险废物产生强度 {v}吨/万元|Q_E_HAZ_WASTE_INTENSITY|1000
废水排放强度 {v}立方/万元|Q_E_WASTEWATER_INTENSITY|1000
女性员工占比 {v}% 。|Q_S_FEMALE_EMPLOYEE_RATE|1
员工福利支出 {v}千元|Q_S_BENEFIT_PER_EMPLOYEE|1000
教育培训经费 {v}万元|Q_S_EDU_PER_EMPLOYEE|10000
碳减排幅度 {v}% 。|Q_E_GHG_REDUCTION_RATE|1
可再生能源利用比例 {v}% 。|Q_E_CLEAN_ENERGY_INTENSITY|1
营业利润增长率 {v}% 。|Q_G_OPERATING_PROFIT_GROWTH|1
女性管理人员占比 {v}% 。|Q_S_FEMALE_MANAGER_RATE|1
职工培训学时 {v}小时|Q_S_EMPLOYEE_TRAINING_HOUR|1
社会保险覆盖率 {v}% 。|Q_S_SOCIAL_INSURANCE_RATE|1
事故发生率 {v}起/百万工时|Q_S_ACCIDENT_RATE|1
水资源取水总量 {v}万吨|Q_E_WATER_CONSUMPTION|10000
现金流量净额与流动负债 {v} 之比|Q_G_CASH_CURRENT_LIABILITY|1
中水回用占比 {v}% 。||
再生水利用率 {v}% 。|Q_E_ALTERNATIVE_WATER_RATE|1
综合能源消费量 {v}万吨标准煤|Q_E_ENERGY_CONSUMPTION|10000
公益捐赠支出占比 {v}% 。|Q_S_DONATION_RATE|1
独立董事人数 {v}人。|Q_G_INDEPENDENT_DIRECTOR_RATE|1
董事会会议召开次数 {v} 次。|Q_G_BOARD_MEETING_FREQ|1
审计费用 {v}万元|Q_G_AUDIT_FEE|10000
温室气体排放总量 {v}万吨|Q_E_GHG_EMISSION|10000
二氧化硫排放量 {v}千克|Q_E_SO2_EMISSION|0.001
氮氧化物排放总量 {v}千吨|Q_E_NOX_EMISSION|1000
烟尘排放量 {v}吨|Q_E_PM_EMISSION|1
污水排放总量 {v}立方米|Q_E_WASTEWATER_DISCHARGE|1
一般固废产生量 {v}万吨|Q_E_SOLID_WASTE_GENERATION|10000
危险废物产生量 {v}吨|Q_E_HAZ_WASTE_GENERATION|1
劳动合同签订率 {v}% 。|Q_S_LABOR_CONTRACT_RATE|1
员工流失率 {v}% 。|Q_S_EMPLOYEE_TURNOVER_RATE|1
董事会成员 {v}人。|Q_G_BOARD_SIZE|1
监事会召开次数 {v}次。|Q_G_SUPERVISOR_MEETING_FREQ|1
股东大会召开次数 {v}次。|Q_G_SHAREHOLDER_MEETING_FREQ|1
审计委员会会议次数 {v}次。|Q_G_AUDIT_COMMITTEE_MEETING_FREQ|1
温室气体排放强度 指标 11 {v}|Q_E_GHG_INTENSITY|1
单位能源耗用强度 吨 3.1 {v}|Q_E_ENERGY_INTENSITY|1
耗水强度 吨 3.1 {v}|Q_E_WATER_INTENSITY|1
SO2排放强度 克 3.1 {v}|Q_E_SO2_INTENSITY|1
NOx强度 克 3.1 {v}|Q_E_NOX_INTENSITY|1
粉尘排放强度 克 3.1 {v}|Q_E_PM_INTENSITY|1
工业固废产生强度 吨 3.1 {v}|Q_E_SOLID_WASTE_INTENSITY|1
每百万元营收温室气体排放量 {v}|Q_E_GHG_INTENSITY|1|Q_E_GHG_EMISSION|1
碳排放密度 {v}|Q_E_GHG_INTENSITY|1
单位营业收入能源消耗 {v}|Q_E_ENERGY_INTENSITY|1
万元产值综合能耗 {v}|Q_E_ENERGY_INTENSITY|1
单位收入的用水量 {v}|Q_E_WATER_INTENSITY|1
百万元产值固体废物 {v}|Q_E_SOLID_WASTE_INTENSITY|1|Q_E_SOLID_WASTE_GENERATION|1
危险固体废物强度 吨 {v}|Q_E_HAZ_WASTE_INTENSITY|1|Q_E_SOLID_WASTE_INTENSITY|1
污水强度 吨 {v}|Q_E_WASTEWATER_INTENSITY|1
员工总数 人 2 {v}|Q_S_EMPLOYEE_COUNT|1
女性员工人数 人 2 {v}|Q_S_FEMALE_EMPLOYEE_COUNT|1
男性职工数量 人 2 {v}|Q_S_MALE_EMPLOYEE_COUNT|1
净利润(元) 2 {v}|Q_G_NET_PROFIT|1
归属于股东的净资产（元） 2 {v}|Q_G_NET_ASSETS|1
营业利润（元） 2 {v}|Q_G_OPERATING_PROFIT|1
资产总额(元) 2 {v}|Q_G_TOTAL_ASSETS|1
董事会频次 次 2 {v}|Q_G_BOARD_MEETING_FREQ|1
监事会频次 次 2 {v}|Q_G_SUPERVISOR_MEETING_FREQ|1
股东大会频次 次 2 {v}|Q_G_SHAREHOLDER_MEETING_FREQ|1
研发投入占比 2 {v}％|Q_S_RD_RATE|1
资产负债率 2 {v}|Q_G_DEBT_ASSET_RATE|1
The ratio of total liabilities to total assets of the Group was approximately {v}% then|Q_G_DEBT_ASSET_RATE|1
Proportion of the donation total in revenue: {v} % then|Q_S_DONATION_RATE|1
Percentage of recycled water consumption is {v}% then|Q_E_ALTERNATIVE_WATER_RATE|1
Proportion of work safety investment to operating revenue % {v} then|Q_S_SAFETY_INVEST_RATE|1
Work safety investment as % of % {v} 1.2 revenue|Q_S_SAFETY_INVEST_RATE|1
Proportion of safety production investment % / {v} then|Q_S_SAFETY_INVEST_RATE|1
安全生产投入占营业收入的比例：{v}% 。|Q_S_SAFETY_INVEST_RATE|1
安全生产投入占营业收入比例 % — {v} 。|Q_S_SAFETY_INVEST_RATE|1
Dividend per share (RMB cents) {v} then|Q_S_DIVIDEND_PER_SHARE|0.01
Dividend per share (RMB) {v} then|Q_S_DIVIDEND_PER_SHARE|1
The total dividend per share for the whole year amounts to RMB {v} then|Q_S_DIVIDEND_PER_SHARE|1
Cash Dividend per Share (tax incl.) RMB/share {v} then|Q_S_DIVIDEND_PER_SHARE|1
R&D investment intensity reached {v}% then|Q_S_RD_RATE|1
研发投入总额占营业收入比例(%) {v} 。|Q_S_RD_RATE|1
研发投入占营业收入的比例 {v} % 。|Q_S_RD_RATE|1
加权平均净资产收益率(%) {v} 。|Q_G_ROE|1
每10股派息数(元)(含税) {v} 。|Q_S_DIVIDEND_PER_SHARE|0.1
comprehensive energy intensity per unit of revenue was {v} tonnes of standard coal per RMB 10,000 of revenue|Q_E_ENERGY_INTENSITY|1000
GHG emissions intensity (Scope 1 and 2) tCO2e/RMB million {v} then|Q_E_GHG_INTENSITY|10
Intensity of NOx emissions kg per RMB million of revenue {v} then|Q_E_NOX_INTENSITY|10
NOx emission intensity tonnes/million RMB {v} then|Q_E_NOX_INTENSITY|10000
Sulphur dioxide emissions intensity kg/RMB 10,000 {v} then|Q_E_SO2_INTENSITY|1000
SO2 emission intensity kg per million Yuan of revenue {v} then|Q_E_SO2_INTENSITY|10
PM emissions intensity kg/RMB million {v} then|Q_E_PM_INTENSITY|10
Particulate matter emission intensity kg/million Yuan {v} then|Q_E_PM_INTENSITY|10
Wastewater discharge intensity tonnes/million RMB {v} then|Q_E_WASTEWATER_INTENSITY|10
Hazardous waste generation intensity kg/RMB thousand {v} then|Q_E_HAZ_WASTE_INTENSITY|10
Hazardous waste intensity tonnes/billion Yuan {v} then|Q_E_HAZ_WASTE_INTENSITY|0.01
Non-hazardous waste disposal intensity kg/CNY 10k {v} then|Q_E_SOLID_WASTE_INTENSITY|1
Total non-hazardous waste intensity tonnes/100 million Yuan {v} then|Q_E_SOLID_WASTE_INTENSITY|0.1
Greenhouse gas emissions density kg CO2e/million CNY {v} then|Q_E_GHG_INTENSITY|0.01
GHG emission intensity tonnes of CO2 equivalent per revenue of RMB in million {v} then|Q_E_GHG_INTENSITY|10
Total energy consumption intensity tonnes of coal equivalent/RMB million {v} then|Q_E_ENERGY_INTENSITY|10
Renewable energy use intensity kg of standard coal equivalent/RMB 10,000 {v} then|Q_E_CLEAN_ENERGY_INTENSITY|1
Water consumption intensity cubic metres/RMB million {v} then|Q_E_WATER_INTENSITY|10
Comprehensive energy consumption intensity: {v} kg of coal equivalent per RMB thousand|Q_E_ENERGY_INTENSITY|10
Water consumption intensity: {v} tonnes per RMB million|Q_E_WATER_INTENSITY|10
Water consumption intensity 耗水密度 tonnes/RMB10,000 噸╱萬元營收 {v} then|Q_E_WATER_INTENSITY|1000
Non-hazardous waste emission 無害廢棄物排放密度 tonnes/RMB10,000 噸╱萬元營收 {v} then|Q_E_SOLID_WASTE_INTENSITY|1000
Total GHG emissions intensity: {v} tonnes CO2e per RMB million|Q_E_GHG_INTENSITY|10
温室气体排放强度 {v} 磅/万元||
万元产值温室气体排放强度 {v} 吨/万元 ，||
排放强度3 温室气体排放强度 {v} 吨/万元 0.02 。||
被担保对象资产负债率 {v}% 。||
资产负债率不超过 {v}% 。||
产业研发投入占比 {v}% 。||
研发投入占比约 {v}% 。||
安全生产投入完成率与投入占比 覆盖率 {v}% 。||
加权平均净资产收益率增加 {v} 。||
扣除非经常性损益后的加权平均净资产收益率(%) {v} 。||
协助减少二氧化硫排放强度 克 {v}||
NOx排放量 千克/万元强度 {v}||
Final dividend per share (RMB) {v} then||
GHG emissions intensity target tCO2e/RMB million {v} then||
The weather was fine on {v} days.||
Water consumption intensity kg/HKD 10.000 {v} then||
"""


def examples() -> list[tuple[str, list[tuple[str, float]]]]:
    out = []
    for line in EXAMPLES.strip().splitlines():
        text, *rest = line.split("|")
        out.append((text, [(c, float(f)) for c, f in zip(rest[::2], rest[1::2], strict=True) if c]))
    return out


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def example_pages(spark, d):
    """One page for each customer: an example with the customer's number in it."""
    k, made = F.col("c_custkey"), examples()
    text = F.element_at(F.array(*[F.lit(t) for t, _ in made]), (k % len(made) + 1).cast("int"))
    v = F.concat(F.lpad((k % 25 + 1).cast("string"), 2, "0"), F.lit(".5"))
    return table(spark, d, "customer").select("c_custkey", F.lit(1).alias("page"), F.replace(text, F.lit("{v}"), v).alias("page_text"))


WANTED = ", ".join(f"({i}, {quoted(c)}, {f!r})" for i, (_, found) in enumerate(examples()) for c, f in found)


def rule_values(spark, d):
    found = ops.rule_candidates(example_pages(spark, d), ["c_custkey"])
    return found.select("c_custkey", "indicator_code", F.round("value", 6).alias("value"))


QUERIES["rule_values"] = rule_values
ORACLE_SQL["rule_values"] = f"""SELECT c_custkey, code AS indicator_code, CAST(round((c_custkey % 25 + 1.5) * CAST(factor AS DOUBLE), 6) AS DOUBLE) AS value
FROM customer JOIN (VALUES {WANTED}) AS w(i, code, factor) ON c_custkey % {len(examples())} = i"""


#: Texts with the class of a missing indicator, written out for the SQL.
GAPS = (
    ("Q_E_GHG_INTENSITY", "GHG intensity was 3 tonnes per HK$ million", "disclosed_foreign_currency_denominator"), ("Q_E_GHG_INTENSITY", "碳排放强度 3 吨/万元营业收入", "likely_methodology_compatible_rule_gap"),
    ("Q_E_GHG_INTENSITY", "GHG intensity 3 kg per MWh", "disclosed_non_revenue_denominator"), ("Q_E_WATER_INTENSITY", "用水强度 3", "ambiguous_intensity_disclosure"), ("Q_E_NOX_INTENSITY", "nothing of it", "no_matching_disclosure_in_text"),
    ("Q_E_GHG_INTENSITY", "温室气体排放总量 500 吨。营业收入 3 万元", "possible_total_plus_rmb_revenue_derivation"), ("Q_E_GHG_INTENSITY", "统计范围为三个基地。温室气体排放总量 500 吨。营业收入 3 万元", "disclosed_scope_mismatch_requires_review"),
    ("Q_E_GHG_INTENSITY", "累计减少温室气体排放总量 500 吨。营业收入 3 万元", "related_disclosure_without_compatible_intensity"), ("Q_E_SO2_INTENSITY", "二氧化硫 5 吨", "related_disclosure_without_compatible_intensity"),
    ("Q_E_ALTERNATIVE_WATER_RATE", "再生水占比为 12%", "possible_direct_alternative_water_rate"), ("Q_E_ALTERNATIVE_WATER_RATE", "再生水使用 5 吨；总用水量 50 吨", "possible_alternative_water_formula_closure"), ("Q_E_ALTERNATIVE_WATER_RATE", "再生水", "related_fields_incomplete"),
    ("Q_S_DIVIDEND_PER_SHARE", "no such thing", "no_dividend_per_share_disclosure"), ("Q_S_DIVIDEND_PER_SHARE", "Dividend per share HK$ 0.2", "dividend_disclosed_foreign_currency"), ("Q_S_DIVIDEND_PER_SHARE", "每股现金分红 0.2 元", "possible_rmb_dividend_rule_gap"), ("Q_S_DIVIDEND_PER_SHARE", "Dividend per share 0.2", "ambiguous_dividend_per_share"),
    ("Q_G_DEBT_ASSET_RATE", "资产总计 5 负债合计 3", "possible_balance_sheet_formula_closure"), ("Q_S_RD_RATE", "研发费用 500 万元；营业收入 9,000", "possible_rd_revenue_formula_closure"), ("Q_S_SAFETY_INVEST_RATE", "安全生产投入 5 万元", "related_fields_incomplete"),
    ("Q_E_GHG_REDUCTION_RATE", "2025 2024 温室气体排放总量 吨 5 6", "possible_two_year_ghg_formula_closure"), ("Q_E_HAZ_WASTE_INTENSITY", "危废 5 吨，营业收入", "possible_hazardous_waste_revenue_closure"), ("Q_E_CLEAN_ENERGY_INTENSITY", "绿电采购量 5 MWh，营业收入", "possible_clean_energy_revenue_closure"),
    ("Q_E_PM_INTENSITY", "颗粒物", "requires_specialized_environmental_diagnostic"), ("Q_G_ROE", "any", "no_closed_formula_detected"), ("Q_E_ENERGY_INTENSITY", None, "missing_text"),
)
#: Two documents of one company, which decide together: halves of a formula, the first intensity, and a total and a revenue.
PAIRS = (
    ("Q_G_DEBT_ASSET_RATE", "资产总计 5", "负债合计 3", "possible_balance_sheet_formula_closure"), ("Q_E_GHG_INTENSITY", "碳排放强度 3 吨/万元营业收入", "GHG intensity 3 kg per MWh", "likely_methodology_compatible_rule_gap"),
    ("Q_E_GHG_INTENSITY", "温室气体排放总量 500 吨", "营业收入 3 万元", "possible_total_plus_rmb_revenue_derivation"), ("Q_E_ALTERNATIVE_WATER_RATE", "再生水使用 5 吨", "总用水量 50 吨", "possible_alternative_water_formula_closure"),
    ("Q_S_DIVIDEND_PER_SHARE", "nothing", "每股现金分红 0.2 元", "possible_rmb_dividend_rule_gap"), ("Q_S_RD_RATE", "研发费用 500 万元", None, "related_fields_incomplete"),
)


ALL_GAPS = [(c, t, None, k) for c, t, k in GAPS] + list(PAIRS)


def gap_classes(spark, d):
    from verdigris.operators import gaps

    made = F.array(*[F.struct(F.lit(c).alias("indicator_code"), F.array(F.lit(a).cast("string"), F.lit(b).cast("string")).alias("texts")) for c, a, b, _ in ALL_GAPS])
    rows = table(spark, d, "customer").select("c_custkey", F.element_at(made, (F.col("c_custkey") % len(ALL_GAPS) + 1).cast("int")).alias("g")).select("c_custkey", "g.indicator_code", F.posexplode("g.texts").alias("document", "text"))
    return gaps.gap_diagnosis(rows.select("c_custkey", "indicator_code"), rows.select("c_custkey", "text", "document"), ["c_custkey"], "document")


QUERIES["gap_classes"] = gap_classes
ORACLE_SQL["gap_classes"] = f"""SELECT c_custkey, g.code AS indicator_code, g.class AS class, g.n AS documents
FROM (SELECT c_custkey, [{", ".join(f"{{'code': '{c}', 'class': '{k}', 'n': {int(a is not None) + int(b is not None)}}}" for c, a, b, k in ALL_GAPS)}][c_custkey % {len(ALL_GAPS)} + 1] AS g FROM customer)"""

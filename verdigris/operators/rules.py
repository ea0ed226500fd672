"""Rules that read indicator values out of page texts: tables of patterns, and the one engine that applies them.

Four tables: rules with a unit, rules that read the number at the end of a page's text, phrases with a number, and English
intensities per revenue. The engine works on normalised text (white space as one space), per page:

1. one pass of an automaton over a page names the rules whose literals it holds (matcher.py), and only they are tried;
2. each match gives its number and unit, and the text around it, which tells false positives and gives the evidence;
3. values that are implausible for their indicator go, and of equal values on a page the surest evidence stays.

Rows are (keep columns, page, indicator_code, value, evidence_text, confidence, rule).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions.text import normal_text
from verdigris.operators.matcher import Matcher

N = r"[+-]?[\d,]+(?:\.\d+)?"
EVIDENCE = 45

# Fixed values from here on: indicator codes, label and unit patterns, factors, confidences, and words of false positives.

#: Units of mass in kilograms and of money in 10,000 yuan; an intensity's factor is one by the other.
MASS = {"千克": 1.0, "kg": 1.0, "公斤": 1.0, "吨": 1000.0, "t": 1000.0, "克": 0.001, "g": 0.001, "立方米": 1000.0, "立方": 1000.0, "方": 1000.0, "m³": 1000.0, "升": 0.001, "l": 0.001}
MONEY = {"万元": 1.0, "百万元": 0.01, "10万元": 0.1, "元": 10000.0}
#: Units by kind: what one of them is in the indicator's own unit.
KINDS = {
    "percent": {"%": 1.0, "％": 1.0, "人": 1.0},
    "count": {"次": 1.0, "起": 1.0, "次/": 1.0, "起/": 1.0, "人": 1.0, "小时": 1.0, "课时": 1.0, "学时": 1.0, "时": 1.0, "": 1.0},
    "yuan": {"元": 1.0, "千元": 1000.0, "万元": 10000.0, "元/人": 1.0, "千元/人": 1000.0, "万元/人": 10000.0},
    "tonnes": {"吨": 1.0, "万吨": 10000.0, "千吨": 1000.0, "千克": 0.001, "kg": 0.001, "立方米": 1.0, "万立方米": 10000.0, "m³": 1.0, "立方": 1.0, "万立方": 10000.0, "方": 1.0},
    "coal": {"吨标准煤": 1.0, "万吨标准煤": 10000.0, "千吨标准煤": 1000.0, "千克标准煤": 0.001, "kg标准煤": 0.001},
}
PERCENT = r"[%％]"
#: Amounts of money in units, as each indicator's rule has them.
PER_TEN_OUTPUT = r"[/／](?:万|百万|10万)?元(?:营收|营业收入|收入|产值)?"
PER_OUTPUT = r"[/／](?:万|百万)?元(?:营收|营业收入|收入|产值)?"
PER_INCOME = r"[/／](?:万|百万)?元(?:营收|营业收入|收入)?"
PER_AMOUNT = r"[/／](?:万|百万)?元"


class Unit(NamedTuple):
    code: str
    label: str
    unit: str
    kind: str
    confidence: float
    hint: str


UNIT_RULES = (
    Unit("Q_E_GHG_INTENSITY", r"(?:温室气体|GHG|碳|CO2)(?:排放)?强度", r"(?:千克|kg|吨|t|公斤)(?:二氧化碳当量|CO2e?|CO₂)?" + PER_TEN_OUTPUT, "kg/money", 0.83, "强度"),
    Unit("Q_E_ENERGY_INTENSITY", r"(?:综合|总)?能源(?:消耗|消费|使用)强度", r"(?:千克|kg|吨|t|公斤)(?:标准煤|标煤|tce)?" + PER_OUTPUT, "kg/money", 0.83, "强度"),
    Unit("Q_E_NOX_INTENSITY", r"氮氧化物(?:\s*[（(]\s*NO[xXₓ]\s*[）)])?(?:排放)?强度|(?:NOx|NO[xₓ])(?:排放)?强度", r"(?:克|g|千克|kg|吨|t)" + PER_INCOME, "g/money", 0.83, "强度"),
    Unit("Q_E_SO2_INTENSITY", r"二氧化硫(?:\s*[（(]\s*SO[₂2]\s*[）)])?(?:排放)?强度|(?:SO2|SO₂)(?:排放)?强度", r"(?:克|g|千克|kg|吨|t)" + PER_INCOME, "g/money", 0.83, "强度"),
    Unit("Q_E_WATER_INTENSITY", r"水资源?(?:使用|消耗|消费)强度", r"(?:千克|kg|吨|t|立方米|m³|升|L)" + PER_OUTPUT, "kg/money", 0.83, "强度"),
    Unit("Q_E_SOLID_WASTE_INTENSITY", r"(?:一般)?固体废物(?:排放)?强度", r"(?:千克|kg|吨|t)" + PER_INCOME, "kg/money", 0.83, "强度"),
    Unit("Q_S_SAFETY_INVEST_RATE", r"(?:安全生产|生产安全)(?:投入|费用|支出)(?:占比|比例|占营业收入比例)", PERCENT, "percent", 0.85, "安全"),
    Unit("Q_S_RD_RATE", r"(?:研发|R&D|RD|研究开发|研究与开发)(?:费用|投入|支出|经费)(?:占比|比例|强度|占营业收入)?", PERCENT, "percent", 0.85, ""),
    Unit("Q_G_DEBT_ASSET_RATE", r"资产负债率|负债资产比率", PERCENT, "percent", 0.90, "负债"),
    Unit("Q_S_PAY_PER_EMPLOYEE", r"(?:员工|职工|雇员)(?:平均)?(?:薪酬|工资|报酬|年薪|薪资)", r"(?:万|千)?元(?:[/／]人|人均)?", "yuan", 0.88, ""),
    Unit("Q_S_ENV_INVEST_RATE", r"环(?:境)?(?:保护|保|境保护)(?:投入|支出|投资|费用|成本)(?:占比|比例|占营业收入)?", PERCENT, "percent", 0.90, "环"),
    Unit("Q_E_PM_INTENSITY", r"(?:颗粒物|PM|粉尘|烟尘|烟粉尘|大气颗粒物)(?:排放)?强度", r"(?:千克|kg|吨|t|克|g)" + PER_AMOUNT, "kg/money", 0.85, "强度"),
    Unit("Q_E_HAZ_WASTE_INTENSITY", r"危险(?:固体)?废物(?:排放|产生)?强度", r"(?:千克|kg|吨|t|克|g)" + PER_AMOUNT, "kg/money", 0.85, "强度"),
    Unit("Q_E_WASTEWATER_INTENSITY", r"(?:废|污)水(?:排放|产生)?强度", r"(?:千克|kg|吨|t|立方米|m³|立方|方)" + PER_AMOUNT, "kg/money", 0.85, "强度"),
    Unit("Q_S_FEMALE_EMPLOYEE_RATE", r"女性(?:员工|职工|雇员)(?:占比|比例|比率)", PERCENT, "percent", 0.88, "女性"),
    Unit("Q_S_BENEFIT_PER_EMPLOYEE", r"(?:员工|职工|雇员)(?:福利|社保|公积金|社会保障)(?:费用|支出|成本)", r"(?:万|千)?元(?:[/／]人)?", "yuan", 0.86, ""),
    Unit("Q_S_EDU_PER_EMPLOYEE", r"(?:工会|职工教育|员工教育|教育培训)(?:经费|费用|支出|投入)", r"(?:万|千)?元(?:[/／]人)?", "yuan", 0.86, ""),
    Unit("Q_E_GHG_REDUCTION_RATE", r"(?:温室气体|碳|GHG|CO2|CO₂)(?:减排|减少|降低)(?:率|比例|幅度)", PERCENT, "percent", 0.87, ""),
    Unit("Q_E_CLEAN_ENERGY_INTENSITY", r"(?:清洁|可再生|绿色|新)能源(?:使用|消费|消耗|利用)?(?:占比|比例|强度|比率)", PERCENT, "percent", 0.86, "能源"),
    Unit("Q_G_OPERATING_PROFIT_GROWTH", r"营业利润(?:增长|增幅|增速|增长率)(?:率)?", PERCENT, "percent", 0.88, "营业利润"),
    Unit("Q_S_FEMALE_MANAGER_RATE", r"女性(?:管理|高管|领导|管理人员|中高层)(?:人员|者|干部)?(?:占比|比例|比率)", PERCENT, "percent", 0.87, "女性"),
    Unit("Q_S_EMPLOYEE_TRAINING_HOUR", r"(?:员工|职工|人均)(?:人均)?培训(?:时长|时间|学时|课时)", r"(?:小时|课时|学时|时)", "count", 0.86, "培训"),
    Unit("Q_S_SOCIAL_INSURANCE_RATE", r"社会?保险(?:缴纳|覆盖|参保)?(?:率|比例|比率)", PERCENT, "percent", 0.87, "保险"),
    Unit("Q_S_ACCIDENT_RATE", r"(?:安全)?事故(?:发生)?(?:率|次数)", r"(?:次|起)/", "count", 0.85, "事故"),
    Unit("Q_E_WATER_CONSUMPTION", r"水资源?(?:消耗|用水|取水|消费)(?:总)?量", r"(?:万|千)?(?:吨|立方米|m³|立方|方)", "tonnes", 0.86, "水资"),
    Unit("Q_G_CASH_CURRENT_LIABILITY", r"(?:经营活动)?现金流量?(?:净额)?[^\d]{0,30}流动负债", "", "count", 0.88, "流动负债"),
    Unit("Q_E_ALTERNATIVE_WATER_RATE", r"(?:再生|循环|中水|替代|回用)水(?:源)?(?:使用|利用|回用)?(?:占比|比例|率|比率)", PERCENT, "percent", 0.85, "水"),
    Unit("Q_E_ENERGY_CONSUMPTION", r"(?:综合|总)?能源(?:消耗|消费|耗用)(?:总)?量", r"(?:万|千)?(?:吨|千克|kg)标准煤", "coal", 0.86, "能源"),
    Unit("Q_S_DONATION_RATE", r"(?:公益|社会|对外)?捐赠(?:支出|金额)?(?:占比|比例|占营业收入|比率)", PERCENT, "percent", 0.87, "捐赠"),
    Unit("Q_G_INDEPENDENT_DIRECTOR_RATE", r"独立董事(?:占比|比例|人数|比率)", r"[%％]|人", "percent", 0.88, "独立董事"),
    Unit("Q_G_BOARD_MEETING_FREQ", r"董事会(?:会议)?(?:召开)?次数", r"次", "count", 0.89, "董事会"),
    Unit("Q_G_AUDIT_FEE", r"审计费用", r"(?:万|千)?元", "yuan", 0.87, "审计费用"),
    Unit("Q_E_GHG_EMISSION", r"(?:温室气体|碳|GHG|CO2|CO₂|二氧化碳)(?:排放)?(?:总)?量", r"(?:万|千)?吨", "tonnes", 0.85, "量"),
    Unit("Q_E_SO2_EMISSION", r"(?:二氧化硫|SO2|SO₂)(?:排放)?(?:总)?量", r"(?:万|千)?(?:吨|千克|kg)", "tonnes", 0.85, "量"),
    Unit("Q_E_NOX_EMISSION", r"(?:氮氧化物|NOx|NOₓ)(?:排放)?(?:总)?量", r"(?:万|千)?(?:吨|千克|kg)", "tonnes", 0.85, "量"),
    Unit("Q_E_PM_EMISSION", r"(?:颗粒物|PM|粉尘|烟尘)(?:排放)?(?:总)?量", r"(?:万|千)?(?:吨|千克|kg)", "tonnes", 0.84, "量"),
    Unit("Q_E_WASTEWATER_DISCHARGE", r"(?:废|污)水(?:排放)?(?:总)?量", r"(?:万|千)?(?:吨|立方米|m³)", "tonnes", 0.85, "水"),
    Unit("Q_E_SOLID_WASTE_GENERATION", r"(?:一般)?固(?:体)?废(?:物)?(?:产生|排放)?(?:总)?量", r"(?:万|千)?吨", "tonnes", 0.84, "量"),
    Unit("Q_E_HAZ_WASTE_GENERATION", r"危险废物(?:产生|排放)?(?:总)?量", r"(?:万|千)?吨", "tonnes", 0.84, "危险废物"),
    Unit("Q_S_LABOR_CONTRACT_RATE", r"劳动合同(?:签订)?(?:率|比例)", PERCENT, "percent", 0.86, "劳动合同"),
    Unit("Q_S_EMPLOYEE_TURNOVER_RATE", r"(?:员工|职工)(?:流失|离职)率", PERCENT, "percent", 0.85, "率"),
    Unit("Q_G_BOARD_SIZE", r"董事会(?:成员|人数|规模)", r"人", "count", 0.88, "董事会"),
    Unit("Q_G_SUPERVISOR_MEETING_FREQ", r"监事会(?:会议)?(?:召开)?次数", r"次", "count", 0.88, "监事会"),
    Unit("Q_G_SHAREHOLDER_MEETING_FREQ", r"股东(?:大会)?(?:会议)?(?:召开)?次数", r"次", "count", 0.89, "股东"),
    Unit("Q_G_AUDIT_COMMITTEE_MEETING_FREQ", r"审计委员会(?:会议)?(?:召开)?次数", r"次", "count", 0.87, "审计委员会"),
)


class End(NamedTuple):
    """A label with white space after it; the value is the number that ends the text, `suffix` being what may follow it."""

    code: str
    label: str
    confidence: float
    suffix: str = ""
    space: str = r"\s+"


SOLID = r"(?:一般)?(?:固(?:体)?废(?:物)?|固废|固体废弃物|一般废物|工业固废)"
PER_REVENUE = r"(?:每百万|单位)(?:元)?(?:营收|营业收入|收入)(?:的)?"
PER_OUTPUT = r"(?:万元|百万元)(?:产值|营收|收入)"
ANY = "[%％]?"
END_RULES = (
    End("Q_E_GHG_INTENSITY", r"(?:温室气体|GHG|碳|CO2|CO₂|二氧化碳)(?:排放|减排)?强度", 0.82),
    End("Q_E_ENERGY_INTENSITY", r"(?:综合|总|单位)?能源(?:消耗|消费|使用|耗用)强度", 0.82),
    End("Q_E_WATER_INTENSITY", r"(?:水资源?|用水|耗水|新鲜水)(?:使用|消耗|消费|耗用)?强度", 0.82),
    End("Q_E_SO2_INTENSITY", r"(?:二氧化硫|SO2|SO₂)(?:排放)?强度", 0.82),
    End("Q_E_NOX_INTENSITY", r"(?:氮氧化物|NOx|NOₓ|氮化物|氮氧化合物)(?:排放)?强度", 0.82),
    End("Q_E_PM_INTENSITY", r"(?:颗粒物|PM|粉尘)(?:排放)?强度", 0.82),
    End("Q_E_SOLID_WASTE_INTENSITY", SOLID + r"(?:产生|排放|生产)?强度", 0.82),
    End("Q_E_GHG_INTENSITY", PER_REVENUE + r"(?:温室气体|碳|GHG|CO2|CO₂)(?:排放)?(?:量|强度)?", 0.83, space=""),
    End("Q_E_GHG_INTENSITY", r"(?:碳排放|GHG|温室气体)(?:密度|强度指标)", 0.81, space=""),
    End("Q_E_ENERGY_INTENSITY", PER_REVENUE + r"(?:综合)?能源(?:消耗|消费)(?:量|强度)?", 0.83, space=""),
    End("Q_E_ENERGY_INTENSITY", PER_OUTPUT + r"(?:综合)?能耗", 0.82, space=""),
    End("Q_E_SO2_INTENSITY", PER_REVENUE + r"(?:二氧化硫|SO2|SO₂)(?:排放)?(?:量|强度)?", 0.83, space=""),
    End("Q_E_SO2_INTENSITY", PER_OUTPUT + r"(?:二氧化硫|SO2|SO₂)(?:排放)?", 0.81, space=""),
    End("Q_E_NOX_INTENSITY", PER_REVENUE + r"(?:氮氧化物|NOx|NOₓ)(?:排放)?(?:量|强度)?", 0.83, space=""),
    End("Q_E_NOX_INTENSITY", PER_OUTPUT + r"(?:氮氧化物|NOx|NOₓ)(?:排放)?", 0.81, space=""),
    End("Q_E_WATER_INTENSITY", PER_REVENUE + r"(?:水资源|用水|耗水)(?:消耗)?(?:量|强度)?", 0.83, space=""),
    End("Q_E_WATER_INTENSITY", PER_OUTPUT + r"(?:水资源|用水|耗水)(?:消耗)?", 0.81, space=""),
    End("Q_E_SOLID_WASTE_INTENSITY", PER_REVENUE + r"(?:一般)?(?:固体)?废物(?:产生)?(?:量|强度)?", 0.83, space=""),
    End("Q_E_SOLID_WASTE_INTENSITY", PER_OUTPUT + r"(?:一般)?(?:固体)?废物(?:产生)?", 0.81, space=""),
    End("Q_E_HAZ_WASTE_INTENSITY", r"危险(?:固体)?废物(?:排放)?强度", 0.82),
    End("Q_E_WASTEWATER_INTENSITY", r"(?:废|污)水(?:排放)?强度", 0.82),
    End("Q_S_SAFETY_INVEST_RATE", r"(?:安全生产|生产安全)(?:投入|费用|支出)(?:占比|比例|占营业收入比例)", 0.82, PERCENT),
    End("Q_S_PAY_PER_EMPLOYEE", r"(?:员工|职工|雇员)(?:平均)?(?:薪酬|工资|报酬|年薪|薪资)", 0.82),
    End("Q_S_ENV_INVEST_RATE", r"环(?:境)?(?:保护|保|境保护)(?:投入|支出|费用|投资|成本)(?:占比|比例)?", 0.85, ANY),
    End("Q_G_REVENUE", r"营业收入\s*[（(]?\s*元\s*[)）]?", 0.9),
    End("Q_G_SHAREHOLDER_MEETING_FREQ", r"股东大会(?:召开)?(?:次数|频次)", 0.88),
    End("Q_G_TOTAL_ASSETS", r"(?:资产)?总额?\s*[（(]?\s*元\s*[)）]?", 0.85),
    End("Q_G_NET_ASSETS", r"(?:归属于.*?)?净资产\s*[（(]?\s*元\s*[)）]?", 0.85),
    End("Q_G_NET_PROFIT", r"(?:归属于.*?)?净利润\s*[（(]?\s*元\s*[)）]?", 0.85),
    End("Q_G_OPERATING_PROFIT", r"营业利润\s*[（(]?\s*元\s*[)）]?", 0.85),
    End("Q_S_EMPLOYEE_COUNT", r"(?:员工|职工)总(?:人)?数", 0.88),
    End("Q_S_FEMALE_EMPLOYEE_COUNT", r"女性(?:员工|职工)(?:数量|人数)", 0.88),
    End("Q_S_MALE_EMPLOYEE_COUNT", r"男性(?:员工|职工)(?:数量|人数)", 0.88),
    End("Q_G_BOARD_MEETING_FREQ", r"董事会(?:召开)?(?:次数|频次)", 0.88),
    End("Q_G_SUPERVISOR_MEETING_FREQ", r"监事会(?:召开)?(?:次数|频次)", 0.88),
    End("Q_E_SO2_EMISSION", r"(?:二氧化硫|SO2|SO₂)(?:排放)?(?:量|总量)?", 0.88),
    End("Q_E_NOX_EMISSION", r"(?:氮氧化物|NOx|NOₓ)(?:排放)?(?:量|总量)?", 0.88),
    End("Q_E_SOLID_WASTE_GENERATION", r"(?:一般)?(?:固(?:体)?废(?:物)?|固废|固体废弃物|一般废物)(?:产生|排放)?(?:量|总量)?", 0.88),
    End("Q_S_SAFETY_INVEST_RATE", r"(?:安全生产|生产安全)(?:投入|费用|支出)(?:占比|比例)", 0.85, "%?"),
    End("Q_S_RD_RATE", r"(?:研发|R&D|RD|研究开发)(?:费用|投入|支出|经费)(?:占比|比例)?", 0.85, ANY),
    End("Q_G_DEBT_ASSET_RATE", r"资产负债率", 0.88, ANY),
    End("Q_S_FEMALE_EMPLOYEE_RATE", r"女性(?:员工|职工)(?:占比|比例)", 0.85, ANY),
    End("Q_S_EMPLOYEE_TRAINING_HOUR", r"(?:员工|职工|人均)(?:人均)?培训(?:时长|时间)", 0.83),
    End("Q_S_SOCIAL_INSURANCE_RATE", r"社会?保险(?:缴纳|覆盖|参保)?(?:率|比例)", 0.85, ANY),
    End("Q_S_FEMALE_MANAGER_RATE", r"女性(?:管理|高管|领导|管理人员)(?:人员|者|干部)?(?:占比|比例)", 0.84, ANY),
    End("Q_G_INDEPENDENT_DIRECTOR_RATE", r"独立董事(?:占比|比例|人数)", 0.86, "[%％人]?"),
    End("Q_G_BOARD_MEETING_FREQ", r"董事会(?:会议)?(?:召开)?次数", 0.87, "次?"),
    End("Q_S_DONATION_RATE", r"(?:公益|社会|对外)?捐赠(?:支出|金额)?(?:占比|比例)", 0.85, ANY),
    End("Q_E_ALTERNATIVE_WATER_RATE", r"(?:再生|循环|中水|替代|回用)水(?:源)?(?:使用|利用|回用)?(?:占比|比例|率)", 0.83, ANY),
    End("Q_E_CLEAN_ENERGY_INTENSITY", r"(?:清洁|可再生|绿色|新)能源(?:使用|消费|消耗|利用)?(?:占比|比例|强度)", 0.84, ANY),
    End("Q_E_WATER_CONSUMPTION", r"水资源?(?:消耗|用水|取水)(?:总)?量", 0.84),
    End("Q_E_ENERGY_CONSUMPTION", r"(?:综合|总)?能源(?:消耗|消费)(?:总)?量", 0.84),
    End("Q_E_GHG_REDUCTION_RATE", r"(?:温室气体|碳|GHG|CO2)(?:减排|减少|降低)(?:率|比例|幅度)", 0.85, ANY),
    End("Q_G_OPERATING_PROFIT_GROWTH", r"营业利润(?:增长|增幅|增速)(?:率)?", 0.86, ANY),
    End("Q_S_BENEFIT_PER_EMPLOYEE", r"(?:员工|职工)(?:福利|社保|公积金)(?:费用|支出)", 0.84),
    End("Q_S_EDU_PER_EMPLOYEE", r"(?:工会|职工教育|员工教育)(?:经费|费用|支出)", 0.83),
    End("Q_S_LABOR_CONTRACT_RATE", r"劳动合同(?:签订)?(?:率|比例)", 0.85, ANY),
    End("Q_S_EMPLOYEE_TURNOVER_RATE", r"(?:员工|职工)(?:流失|离职)率", 0.84, ANY),
    End("Q_G_BOARD_SIZE", r"董事会(?:成员|人数|规模)", 0.85, "人?"),
    End("Q_G_SUPERVISOR_MEETING_FREQ", r"监事会(?:会议)?(?:召开)?次数", 0.86, "次?"),
    End("Q_G_SHAREHOLDER_MEETING_FREQ", r"股东(?:大会)?(?:会议)?(?:召开)?次数", 0.87, "次?"),
    End("Q_G_AUDIT_COMMITTEE_MEETING_FREQ", r"审计委员会(?:会议)?(?:召开)?次数", 0.85, "次?"),
    End("Q_E_GHG_EMISSION", r"(?:温室气体|碳|GHG|CO2|二氧化碳)(?:排放)?(?:总)?量", 0.84),
    End("Q_E_SO2_EMISSION", r"(?:二氧化硫|SO2|SO₂)(?:排放)?(?:总)?量", 0.84),
    End("Q_E_NOX_EMISSION", r"(?:氮氧化物|NOx|NOₓ)(?:排放)?(?:总)?量", 0.84),
    End("Q_E_PM_EMISSION", r"(?:颗粒物|PM|粉尘|烟尘)(?:排放)?(?:总)?量", 0.83),
    End("Q_E_WASTEWATER_DISCHARGE", r"(?:废|污)水(?:排放)?(?:总)?量", 0.84),
    End("Q_E_SOLID_WASTE_GENERATION", r"(?:一般)?固(?:体)?废(?:物)?(?:产生|排放)?(?:总)?量", 0.83),
    End("Q_E_HAZ_WASTE_GENERATION", r"危险废物(?:产生|排放)?(?:总)?量", 0.83),
)


class Phrase(NamedTuple):
    code: str
    pattern: str  # its one group is the number
    factor: float
    confidence: float
    hint: str  # in lower case


PHRASE_RULES = (
    Phrase("Q_G_DEBT_ASSET_RATE", rf"(?:the\s+)?ratio\s+of\s+total\s+liabilities\s+to\s+total\s+assets(?:\s+of\s+the\s+(?:Group|Company))?\s+(?:was|is)\s+(?:approximately\s+)?({N})\s*%", 1.0, 0.96, "total liabilities to total assets"),
    Phrase("Q_S_DONATION_RATE", rf"Proportion\s+of\s+(?:the\s+)?donation\s+total\s+in\s+revenue[^\d%]{{0,20}}({N})\s*%", 1.0, 0.94, "donation total in revenue"),
    Phrase("Q_E_ALTERNATIVE_WATER_RATE", rf"(?:Percentage|Proportion)\s+of\s+(?:the\s+)?recycled\s+water(?:\s+consumption)?[^\d%]{{0,40}}({N})\s*%", 1.0, 0.93, "recycled water"),
    Phrase("Q_S_SAFETY_INVEST_RATE", rf"Proportion\s+of\s+(?:work|production)\s+safety\s+investment\s+to\s+(?:operating\s+)?revenue\s*%?\s*({N})", 1.0, 0.94, "safety investment to"),
    Phrase("Q_S_SAFETY_INVEST_RATE", rf"Work\s+safety\s+investment\s+as\s*%\s+of\s*%\s*({N})(?:\s+[\d,.]+){{0,4}}\s+revenue", 1.0, 0.94, "work safety investment as"),
    Phrase("Q_S_SAFETY_INVEST_RATE", rf"Proportion\s+of\s+(?:(?:work|production)\s+safety|safety\s+production)\s+investment\s*\d{{0,2}}\s*%\s*(?:/|–|—|-)?\s*({N})", 1.0, 0.94, "investment"),
    Phrase("Q_S_SAFETY_INVEST_RATE", rf"安全生产投入占营业收入(?:的)?比例\s*[：:]?\s*({N})\s*[%％]", 1.0, 0.94, "安全生产投入占营业收入"),
    Phrase("Q_S_SAFETY_INVEST_RATE", rf"安全生产投入占营业收入(?:的)?比例\s*[%％]\s*(?:(?:—|--|/|-)\s*)*({N})(?!\.?\d)(?!\s*(?:[\d,]+(?:\.\d+)?|—|--|/|-))", 1.0, 0.94, "安全生产投入占营业收入"),
    Phrase("Q_S_DIVIDEND_PER_SHARE", rf"(?<!final )(?<!interim )(?<!proposed )Dividend\s+per\s+share\s*\(\s*RMB\s+cents?\s*\)[^\d]{{0,20}}({N})", 0.01, 0.95, "dividend per share"),
    Phrase("Q_S_DIVIDEND_PER_SHARE", rf"(?<!final )(?<!interim )(?<!proposed )Dividend\s+per\s+share\s*\(\s*RMB\s*\)[^\d]{{0,20}}({N})", 1.0, 0.95, "dividend per share"),
    Phrase("Q_S_DIVIDEND_PER_SHARE", rf"total\s+dividend\s+per\s+share\s+for\s+the\s+whole\s+year\s+(?:amounts?|amounting)\s+to\s+RMB\s*({N})", 1.0, 0.96, "total dividend per share"),
    Phrase("Q_S_DIVIDEND_PER_SHARE", rf"Cash\s+Dividend\s+per\s+Share(?:\s*\([^)]*\))?\s+RMB\s*/\s*share\s*({N})", 1.0, 0.95, "cash dividend per share"),
    Phrase("Q_S_RD_RATE", rf"(?:proportion\s+of\s+)?R&D(?:\s+investment)?\s+intensity\s+(?:was|reached|to)\s*({N})\s*%", 1.0, 0.93, "r&d"),
    Phrase("Q_S_RD_RATE", rf"研发投入总额占营业收入比例\s*\(\s*%\s*\)\s*({N})", 1.0, 0.96, "研发投入总额占营业收入"),
    Phrase("Q_S_RD_RATE", rf"研发投入占营业收入的比例\s*\(\s*%\s*\)\s*({N})", 1.0, 0.96, "研发投入占营业收入"),
    Phrase("Q_S_RD_RATE", rf"研发投入占营业收入(?:的)?比例\s*({N})\s*%", 1.0, 0.96, "研发投入占营业收入"),
    Phrase("Q_G_ROE", rf"加权平均净资产收益\s*率(?:\s*[（(]\s*%[）)])?[^\d（(+-]{{0,20}}(?<![A-Za-z])({N})", 1.0, 0.92, "加权平均净资产收益"),
    Phrase("Q_S_DIVIDEND_PER_SHARE", rf"每\s*10\s*股\s*派息数(?:\s*\(元\))?(?:\s*\(含税\))?[^\d]{{0,15}}({N})", 0.1, 0.94, "派息数"),
)

#: What English denominators call an amount of yuan.
AMOUNTS = {"thousand": 1e3, "1,000": 1e3, "1000": 1e3, "’000": 1e3, "'000": 1e3, "10,000": 1e4, "10000": 1e4, "10k": 1e4, "million": 1e6, "100 million": 1e8, "billion": 1e9}
SCALE = r"thousand|million|billion|100\s+million|10[,.]?000|1[,.]?000|10k|’000|'000"
CURRENCY = r"RMB|CNY|HKD|HK\$"
#: Denominators: currency on either side of the amount; amount first; revenue first.
PER = {
    "either": rf"(?:/|per)\s*(?:(?:{SCALE})\s*(?:{CURRENCY})|(?:{CURRENCY})\s*(?:{SCALE}))(?:\s+(?:(?:of|in)\s+)?revenue)?\s*\)?",
    "amount": r"(?:/|per)\s*(?:million|billion|100\s+million|10[,.]?000|10k)\s*(?:RMB|CNY|Yuan)(?:\s+(?:(?:in|of)\s+)?revenue)?",
    "revenue": r"(?:/|per)\s*revenue\s+of\s+(?:RMB|CNY)\s+(?:in\s+)?(?:thousand|million|billion)",
    "bilingual": r"/RMB\s*10,?000\s+(?:噸\s*[／/╱]\s*萬元營收|吨\s*[／/╱]\s*万元营收)",
    "coal": r"per\s+RMB\s+(?:100\s+million|million|10[,.]?000|10k)\s+of\s+revenue",
}
GHG = r"(?:total\s+)?(?:GHG|greenhouse\s+gas)\s+emissions?\s+(?:intensity|density)(?:\s*\(\s*Scopes?\s*1\s*(?:and|&|\+)\s*(?:Scopes?\s*)?2\s*\))?"
CO2 = r"kg\s*CO2-?e|tCO2-?e|tonnes?(?:\s+of)?\s+CO2(?:\s+equivalents?|-?e)?"
NOX = r"(?:intensity\s+of\s+NOx\s+emissions|NOx\s+emissions?\s+intensity)"
SULPHUR = r"(?:SO2|SOx|sulphur\s+(?:dioxide|oxides?)|sulfur\s+(?:dioxide|oxides?))"
SO2 = rf"(?:{SULPHUR}\s+emissions?\s+intensity|intensity\s+of\s+{SULPHUR}\s+emissions?)"
PM = r"(?:(?:particulate(?:\s+matter)?|PM)\s+emissions?\s+intensity|intensity\s+of\s+(?:particulate(?:\s+matter)?|PM)\s+emissions?)"
SEWAGE = r"(?:wastewater|sewage)(?:\s+(?:discharge|emission))?\s+intensity(?:Note\d+)?"
HAZARDOUS = r"(?<!non-)hazardous\s+waste(?:\s+(?:generation|production|disposal|emission|discharge))?\s+intensity(?:Note\d+)?"
OTHER_WASTE = r"(?:total\s+)?non-hazardous\s+waste(?:\s+(?:generation|production|disposal|emission))?\s+intensity(?:Note\d+)?"
ENERGY = r"(?:comprehensive|total)\s+energy\s+consumption\s+intensity"
CLEAN = r"(?:clean|renewable|green)\s+energy\s+(?:consumption|production|use)\s+intensity"
WATER = r"(?:total\s+)?water\s+consumption\s+intensity"
KILOS, COAL = r"kg|kilograms?|tonnes?|tons?", r"(?:kg|kilograms?|tonnes?)\s+(?:of\s+)?(?:standard\s+)?coal\s+equivalent"
LITRES = r"kg|kilograms?|tonnes?|cubic\s+metres?|m3"


class English(NamedTuple):
    """label, gap, numerator, denominator, value; or label, gap, value, numerator, denominator where `first`."""

    code: str
    label: str
    gap: str
    mass: str
    per: str
    confidence: float
    first: bool = False

    @property
    def pattern(self) -> str:
        value = r"([\d,]+(?:\.\d+)?)"
        unit = rf"(?:{self.mass})\s*{PER[self.per]}"
        return f"(?:{self.label}){self.gap}" + (rf"{value}\s*{unit}" if self.first else rf"{unit}\s*{value}\b")


ENGLISH_RULES = (
    English("Q_E_ENERGY_INTENSITY", r"comprehensive\s+energy\s+intensity\s+per\s+unit\s+of\s+revenue\s+was", r"\s+", r"tonnes?\s+of\s+standard\s+coal(?:\s+equivalent)?", "coal", 0.95, True),
    English("Q_E_GHG_INTENSITY", GHG, r"[^\d]{0,100}?", CO2, "either", 0.92),
    English("Q_E_NOX_INTENSITY", NOX, r"[^\d]{0,80}?", KILOS, "either", 0.91),
    English("Q_E_NOX_INTENSITY", NOX, r"[^\d]{0,80}?", KILOS, "amount", 0.91),
    English("Q_E_SO2_INTENSITY", SO2, r"[^\d]{0,80}?", KILOS, "either", 0.91),
    English("Q_E_SO2_INTENSITY", SO2, r"[^\d]{0,80}?", KILOS, "amount", 0.91),
    English("Q_E_PM_INTENSITY", PM, r"[^\d]{0,80}?", KILOS, "either", 0.91),
    English("Q_E_PM_INTENSITY", PM, r"[^\d]{0,80}?", KILOS, "amount", 0.91),
    English("Q_E_WASTEWATER_INTENSITY", SEWAGE, r"[^\d]{0,80}?", KILOS, "amount", 0.91),
    English("Q_E_HAZ_WASTE_INTENSITY", HAZARDOUS, r"[^\d]{0,80}?", KILOS, "either", 0.91),
    English("Q_E_HAZ_WASTE_INTENSITY", HAZARDOUS, r"[^\d]{0,80}?", KILOS, "amount", 0.91),
    English("Q_E_SOLID_WASTE_INTENSITY", OTHER_WASTE, r"[^\d]{0,80}?", KILOS, "either", 0.91),
    English("Q_E_SOLID_WASTE_INTENSITY", OTHER_WASTE, r"[^\d]{0,80}?", KILOS, "amount", 0.91),
    English("Q_E_GHG_INTENSITY", GHG, r"[^\d]{0,100}?", CO2, "amount", 0.92),
    English("Q_E_GHG_INTENSITY", GHG, r"[^\d]{0,100}?", CO2, "revenue", 0.92),
    English("Q_E_ENERGY_INTENSITY", ENERGY, r"[^\d]{0,100}?", COAL, "either", 0.90),
    English("Q_E_CLEAN_ENERGY_INTENSITY", CLEAN, r"[^\d]{0,100}?", COAL, "either", 0.90),
    English("Q_E_WATER_INTENSITY", WATER, r"[^\d]{0,100}?", LITRES, "either", 0.90),
    English("Q_E_ENERGY_INTENSITY", ENERGY, r"[^\d]{0,30}", COAL, "either", 0.90, True),
    English("Q_E_WATER_INTENSITY", WATER, r"[^\d]{0,30}", LITRES, "either", 0.90, True),
    English("Q_E_WATER_INTENSITY", r"Water\s+consumption\s+intensity|耗水密度|用水密度", r".{0,60}?", r"tonnes?|tons?|kg", "bilingual", 0.93),
    English("Q_E_SOLID_WASTE_INTENSITY", r"Non-hazardous\s+waste\s+emission(?:\s+density)?|無害廢棄物(?:排放)?密度", r".{0,80}?", r"tonnes?|tons?|kg", "bilingual", 0.93),
    English("Q_E_GHG_INTENSITY", GHG, r"[^\d]{0,30}", CO2, "either", 0.92, True),
)
GRAMS = ("Q_E_NOX_INTENSITY", "Q_E_SO2_INTENSITY", "Q_E_PM_INTENSITY")
RATES = ("Q_E_ALTERNATIVE_WATER_RATE", "Q_S_SAFETY_INVEST_RATE", "Q_S_RD_RATE", "Q_S_DONATION_RATE", "Q_S_ENV_INVEST_RATE", "Q_G_DEBT_ASSET_RATE")

#: False positives of rules with a unit: (codes, characters before and after the match that are looked at, what is there).
UNIT_FALSE = (
    (("Q_E_GHG_INTENSITY", "Q_E_ENERGY_INTENSITY", "Q_E_WATER_INTENSITY"), 24, 24, "产值|产量|发电量|单位产品|万元产值"),
    (("Q_G_DEBT_ASSET_RATE",), 18, 18, "被担保对象|计算公式"),
    (("Q_G_DEBT_ASSET_RATE",), 0, 0, "超过|低于|不低于|不超过|＝|="),
    (("Q_S_RD_RATE",), 8, 0, "产业研发|业务研发"),
    (("Q_S_RD_RATE",), 0, 0, "超|约"),
)
SULPHUR_CODES, NITROGEN_CODES = ("Q_E_SO2_INTENSITY", "Q_E_SO2_EMISSION"), ("Q_E_NOX_INTENSITY", "Q_E_NOX_EMISSION")
#: The same for rules without one, in which the match reaches to the end of the text.
DIRECT_FALSE = (
    (("Q_G_ROE",), 0, 0, "同比|增加|减少|提升|下降|上升|增长|变动|较上年|不适用"),
    (("Q_S_SAFETY_INVEST_RATE",), 40, 40, "保障率|完备率|完成率|整改率|覆盖率|合规率|认证"),
    (SULPHUR_CODES + NITROGEN_CODES, 40, 40, "减排|削减|去除|相当于|协助减少"),
    (("Q_E_SO2_EMISSION", "Q_E_NOX_EMISSION"), 40, 40, "(?i)intensity|密度|强度"),
    (("Q_E_SO2_EMISSION",), 0, 0, "一般工业固废|召开|废渣|污染物排放总量|ENVIRONMENTAL|培训次数"),
    (("Q_E_NOX_EMISSION",), 0, 0, "召开|废渣|污染物排放总量|综合利用率|ENVIRONMENTAL|培训次数"),
    (("Q_E_NOX_INTENSITY",), 0, 0, "专利|实用新型|发明|申请数量|授权数量"),
)
SAFETY_SENSE = r"(?i)Proportion\s+of\s+.*safety.*(?:revenue|investment)|Work\s+safety\s+investment\s+as\s*%|safety\s+investment.*(?:revenue|%)|占营业收入|占营收|占比|比例"
LONGEST = {"Q_E_SO2_EMISSION": 90, "Q_E_NOX_EMISSION": 90, "Q_E_NOX_INTENSITY": 100}
PAGE_NOISE = r"(?i)年度(?:环境|社会)|ENVIRONMENTAL,\s*SOCIAL|走进|公司概况|报告\s*$"
TARGETS = r"(?i)not\s+exceeding|target|goal|aim\s+to|strive\s+to"

# End of fixed values.


class Rule(NamedTuple):
    """One rule of any table in the engine's terms: where it is tried, what it matches, and where its number is."""

    family: str
    code: str
    pattern: str
    hint: str
    confidence: float
    row: NamedTuple


def rules_of(families: tuple[str, ...]) -> list[Rule]:
    every = [Rule("unit", r.code, rf"(?i)(?:{r.label})[^\d%]{{0,35}}({N})\s*({r.unit})", r.hint, r.confidence, r) for r in UNIT_RULES]
    every += [Rule("end", r.code, rf"(?i)(?:{r.label}){r.space}", "", r.confidence, r) for r in END_RULES]
    every += [Rule("phrase", r.code, f"(?i){r.pattern}", r.hint, r.confidence, r) for r in PHRASE_RULES]
    for r in ENGLISH_RULES:
        hint = "rmb" if r.per in ("bilingual", "coal") else "intensity" if "density" not in r.label else "emission"
        every.append(Rule("english", r.code, f"(?i){r.pattern}", hint, r.confidence, r))
    return [r for r in every if r.family in families]


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def lookup(x: Column, table: dict[str, float]) -> Column:
    """The table's entry; null for what it does not hold."""
    out = F.lit(None).cast("double")
    for key, value in table.items():
        out = F.when(x == key, F.lit(value)).otherwise(out)
    return out


def generated(row: list[str | Column], fields) -> Column:
    """The fields of `fields(struct of row)` as generated columns.

    A lambda is interpreted, so hundreds of patterns do not have to fit into one compiled method; and what is generated is
    computed once, where the optimizer would copy a projected choice among all rules into every later use of it.
    """
    return F.inline(F.transform(F.array(F.struct(*row)), fields))


def unit_factor(unit: str, kind: str) -> float | None:
    """What one unit is in the indicator's own: kilograms or grams per 10,000 yuan, or by the kind's table."""
    x = re.sub(r"\s+", "", unit).replace("／", "/").lower()
    if kind in ("kg/money", "g/money"):
        mass, _, money = x.partition("/")
        mass = re.sub("二氧化碳当量|co2e?|co₂|标准煤|标煤|tce", "", mass)
        money = re.sub("(营业收入|营收|收入|产值)$", "", money)
        if mass not in MASS or money not in MONEY:
            return None
        return MASS[mass] * MONEY[money] * (1000.0 if kind == "g/money" else 1.0)
    return KINDS[kind].get(x)


def english_factor(r: English, own: str) -> float | None:
    """Kilograms or grams per 10,000 yuan for one of the match's mass unit per its amount of money."""
    per = re.search(PER[r.per], own, re.I)
    scale = re.search(rf"100\s+million|{SCALE}", per.group(0), re.I) if per else None
    amount = AMOUNTS.get(re.sub(r"\s+", " ", scale.group(0).lower())) if scale else None
    if amount is None:
        return None
    mass = re.search(rf"({r.mass})\s*{PER[r.per]}", own, re.I)
    kilos = 1.0 if mass and re.match("kg|kilogram", mass.group(1), re.I) else 1000.0
    return kilos * 10_000 / amount * (1000.0 if r.code in GRAMS else 1.0)


def value_of(r: Rule, own: str, raw: str, unit: str) -> float | None:
    plain = re.sub(r"[,\s]", "", raw)
    try:
        x = float(plain)
    except ValueError:
        return None
    factor = unit_factor(unit, r.row.kind) if r.family == "unit" else english_factor(r.row, own) if r.family == "english" else float(r.row.factor if r.family == "phrase" else 1.0)
    return None if factor is None else x * factor


FOUND = "rule int, own string, before string, after string, family string, indicator_code string, confidence double, value double"


def matches(text: str, rules: list[Rule], matcher: Matcher) -> Iterator[tuple]:
    """FOUND of every match of the rules in a text in normal form."""
    for i in matcher.named(text):
        r, pattern = rules[i], matcher.patterns[i]
        if r.family == "end":  # from the label's first place to the end of the text, where that ends with a number
            at = pattern.search(text)
            last = re.search(rf"({N})\s*{r.row.suffix}\s*$", text[at.end() :]) if at else None
            found = [(at.start(), len(text), last.group(1), "")] if last else []
        else:
            found = [(m.start(), m.end(), m.group(1) if m.re.groups else "", m.group(2) if r.family == "unit" else "") for m in pattern.finditer(text)]
        for start, end, raw, unit in found:
            own = text[start:end]
            value = value_of(r, own, raw or "", unit or "")
            if value is not None:
                yield i, own, text[max(0, start - EVIDENCE) : start], text[end : end + EVIDENCE], r.family, r.code, float(r.confidence), value


def found_in(pages: DataFrame, keep: list[str], text: str, rules: list[Rule]) -> DataFrame:
    """keep, page and FOUND of all matches, by one pass over each text in Python, batch by batch."""
    own = pages.select(*keep, "page", text)
    names = [*keep, "page"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher([r.pattern for r in rules], [r.hint for r in rules])
        for batch in batches:
            at, rows = [], []
            for k, x in enumerate(batch.column(text)):
                for row in matches(x.as_py() or "", rules, matcher):
                    at.append(k)
                    rows.append(row)
            if rows:
                kept = pa.array(at, pa.int64())
                types = [pa.int32(), *[pa.string()] * 5, pa.float64(), pa.float64()]
                columns = [batch.column(c).take(kept) for c in names] + [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, [*names, *[f.split()[0] for f in FOUND.split(", ")]])

    kinds = dict(own.dtypes)
    return own.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", " + FOUND)


def plausible(code: Column, value: Column) -> Column:
    """Returns may be negative, rates are at most 100, dividends too, and revenue is a million yuan at least."""
    return (
        F.when(code == "Q_G_ROE", value.between(-1000, 100)).when(value < 0, F.lit(False)).when(code.isin(*RATES) | (code == "Q_S_DIVIDEND_PER_SHARE"), value <= 100)
        .when(code == "Q_G_REVENUE", value >= 1_000_000).otherwise(value.isNotNull())
    )


def around(m: Column, before: int, after: int) -> Column:
    """The match with that many characters on either side."""
    return F.concat(F.right(m["before"], F.lit(before)), m["own"], F.left(m["after"], F.lit(after)))


def false_positive(m: Column) -> Column:
    """Whether a candidate's match or surroundings say that it is none."""
    code, value, own, family = m["indicator_code"], m["value"], m["own"], m["family"]
    window, around_match = around(m, 40, 40), lambda b, a: around(m, b, a)
    unit = any_of([code.isin(*codes) & around_match(b, a).rlike(words) for codes, b, a, words in UNIT_FALSE])
    # a footnote's number between label and unit: further numbers follow
    unit = unit | (code.isin(*UNIT_FALSE[0][0]) & F.left(m["after"], F.lit(12)).rlike(r"^\s*\d"))
    direct = any_of([code.isin(*codes) & around_match(b, a).rlike(words) for codes, b, a, words in DIRECT_FALSE])
    direct = direct | ((code == "Q_G_ROE") & F.right(m["before"], F.lit(24)).contains("扣除非经常性损益"))
    direct = direct | ((code == "Q_S_SAFETY_INVEST_RATE") & (~own.rlike(SAFETY_SENSE) | (value <= 0) | (value > 30)))
    direct = direct | (code.isin(*SULPHUR_CODES) & window.rlike("硫氧化物|硫化物|SOx") & ~own.rlike("二氧化硫|SO2|SO₂"))
    direct = direct | any_of([(code == c) & (F.length(own) > n) for c, n in LONGEST.items()])
    direct = direct | ((code == "Q_E_NOX_INTENSITY") & own.rlike(r"千克\s*[／/]\s*万元|吨\s*[／/]\s*百万元") & (F.size(F.regexp_extract_all(own, F.lit(r"\d+\.\d+"), F.lit(0))) >= 2) & ~own.contains("Chinese"))
    # a page number or footnote taken for a water intensity
    small = (code == "Q_E_WATER_INTENSITY") & (value == F.floor(value)) & value.between(1, 200)
    noise = window.rlike(r"用水强度\s*吨\s*[／/╱]\s*百万营收") | (F.length(own) > 120) | own.rlike(PAGE_NOISE)
    direct = direct | (small & (noise | own.rlike(r"水资源?(?:使用|消耗)强度\s*\d[\d.]*(?!\s*(?:吨|立方米|千克|kg|m³)\s*[／/]).*(?:吨|立方米)\s*[／/]\s*万?元")))
    english = (value <= 0) | own.rlike(TARGETS)
    return F.coalesce(F.when(family == "unit", unit).when(family == "english", english).otherwise(direct), F.lit(False))


def rule_candidates(pages: DataFrame, keep: list[str], families: tuple[str, ...] = ("unit", "end", "phrase", "english")) -> DataFrame:
    """Candidates of all rules of the families: one row for each value of an indicator on a page, the surest evidence of each.

    A null or empty page has none. Rules are tried only on pages that hold a literal that they need (Matcher); what matches
    is judged by its surroundings in columns.
    """
    rules = rules_of(families)
    text = pages.select(*keep, "page", normal_text(F.col("page_text")).alias("_t")).filter("_t <> ''")
    named = found_in(text, keep, "_t", rules).filter(plausible(F.col("indicator_code"), F.col("value")))
    parts = ["rule", "own", "before", "after", "family", "indicator_code", "confidence", "value"]
    judged = named.select(
        *keep, "page", "indicator_code", "value", "confidence", "rule", "own",
        generated(parts, lambda m: F.struct(false_positive(m).alias("_false"), around(m, EVIDENCE, EVIDENCE).alias("evidence_text"), F.concat(m["family"], (m["rule"] + 1).cast("string")).alias("named"))),
    )
    best = F.max_by(F.struct("evidence_text", "confidence", F.col("named").alias("rule")), F.struct("confidence", -F.col("rule"), "own"))
    return judged.filter("NOT _false").groupBy(*keep, "page", "indicator_code", "value").agg(best.alias("b")).select(*keep, "page", "indicator_code", "value", "b.evidence_text", "b.confidence", "b.rule")

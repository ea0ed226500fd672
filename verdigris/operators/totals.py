"""Totals of emissions, energy, water and waste in page texts, and the intensities that follow from them over revenue.

A page gives totals from rows under its header of years, from rows and cards with one value, and from sentences. Greenhouse
gas is counted in scopes: a total must be that of scopes 1 and 2. It is, if it says so; otherwise the page must not count
scope 3, and where it states scopes 1 and 2 they must add up to it. Scopes 1 and 2 alone add up to a total of their own,
located before market-based. A company's totals meet over all its documents: they must agree, or those that name their
scopes must, or those of tables that end with the current year.
"""

from __future__ import annotations

from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions.text import number
from verdigris.operators.matcher import headed, required
from verdigris.operators.rules import generated, lookup
from verdigris.operators.tables import column_years, line_text, scientific

# Labels of totals, their units in kilograms, the bounds of the intensity per 10,000 yuan, and what is no total.

N = r"[\d,]+(?:\.\d+)?"


class Total(NamedTuple):
    code: str
    label: str
    units: dict[str, float]
    low: float
    high: float


NOT_SCOPE = r"(?<!范围一)(?<!范围二)(?<!范围三)(?<!范围1)(?<!范围2)(?<!范围3)(?<!范畴一)(?<!范畴二)(?<!范畴三)(?<!范畴1)(?<!范畴2)(?<!范畴3)"
BOTH = r"范围\s*[一1]\s*[、和+及]\s*范围\s*[二2]"
GAS_UNITS = {"百万吨二氧化碳当量": 1e9, "万吨二氧化碳当量": 1e7, "吨二氧化碳当量": 1e3, "万吨": 1e7, "吨": 1e3, "tCO2e": 1e3, "tCO₂e": 1e3}
COAL_UNITS = {"万吨标准煤": 1e7, "万吨标煤": 1e7, "吨标准煤": 1e3, "吨标煤": 1e3, "千克标准煤": 1.0, "tce": 1e3, "TCE": 1e3}
MASS_UNITS = {"万吨": 1e7, "吨": 1e3, "千克": 1.0}
WATER_UNITS = {"万立方米": 1e7, "立方米": 1e3, "万吨": 1e7, "吨": 1e3}

TOTALS = (
    Total("Q_E_GHG_INTENSITY", rf"{BOTH}温室气体排放总量\s*[（(]基于位置[）)]|{NOT_SCOPE}(?<!每百万营收)(?<!单位营收)(?<!减少的)(?<!直接)(?<!间接)温室气体排放总量(?:\s*[（(]\s*含?{BOTH}\s*[）)])?|{NOT_SCOPE}温室气体总排放量|(?<!减少的)(?<!直接)(?<!间接)碳排放总量|(?<!减少)(?<!直接)(?<!间接)二氧化碳排放总量(?!\s*[（(]\s*基于市场)(?:\s*[（(]\s*基于地理位置\s*[）)])?", GAS_UNITS, 0.001, 200_000.0),
    Total("Q_E_ENERGY_INTENSITY", r"综合能源(?:消耗|消费)总量|综合能耗总量|(?<!每百万营收)(?<!直接)(?<!间接)(?<!清洁)(?<!可再生)能源(?:消耗|消费)总量|(?<!直接)(?<!间接)综合能耗(?!强度)", COAL_UNITS, 0.0001, 100_000.0),
    Total("Q_E_CLEAN_ENERGY_INTENSITY", r"(?:其中[:：]\s*)?(?:清洁能源和可再生能源|清洁能源及可再生能源|清洁能源|可再生能源)(?:消耗总量|使用总量|消费总量|消耗量|使用量|消费量|用量)", COAL_UNITS, 0.0001, 100_000.0),
    Total("Q_E_WATER_INTENSITY", r"(?<!循环)(?<!回用)(?<!重复利用)用水总量|(?<!循环)总用水量|总取水量|取水总量|总耗水量|耗水总量|耗水量|新鲜水用水总量|新鲜水总量", {"百万吨": 1e9, "万立方米": 1e7, "立方米": 1e3, "m³": 1e3, "m3": 1e3, "万吨": 1e7, "吨": 1e3}, 0.001, 5_000_000.0),
    Total("Q_E_SO2_INTENSITY", r"(?<!去除)(?<!削减)(?<!减少)(?:工业生产)?二氧化硫(?:\s*[（(]\s*SO[₂2]\s*[）)]|\s+SO[₂2])?\s*(?:排放)?总量|二氧化硫(?:\s*[（(]\s*SO[₂2]\s*[）)]|\s+SO[₂2])?\s*排放量|外排废气中二氧化硫量|(?<!去除)(?<!削减)(?<!减少)SO2(?:排放)?总量|SO2排放量", MASS_UNITS, 0.001, 100_000.0),
    Total("Q_E_NOX_INTENSITY", r"(?<!去除)(?<!削减)(?<!减少)(?:工业生产)?氮氧化物(?:\s*[（(]\s*NO[xXₓ]\s*[）)]|\s+NO[xXₓ])?\s*(?:排放)?总量|氮氧化物(?:\s*[（(]\s*NO[xXₓ]\s*[）)]|\s+NO[xXₓ])?\s*(?:排放)?(?:总)?量(?:\s*[（(]\s*NO[xXₓ]\s*[）)])?|废气中氮氧化物(?:\s*[（(]\s*NO[xXₓ]\s*[）)])?(?:排放)?(?:总)?量|外排废气中氮氧化物量", MASS_UNITS, 0.001, 100_000.0),
    Total("Q_E_PM_INTENSITY", r"(?:颗粒物(?:\s*[（(]PM[）)]\s*)?|烟尘)(?:排放)?总量|(?:颗粒物(?:\s*[（(]PM[）)]\s*)?|烟尘)(?:年)?排放量|悬浮粒[子⼦]与颗粒物\s*[（(]PM[）)]\s*排放量", MASS_UNITS, 0.0001, 20_000.0),
    Total("Q_E_WASTEWATER_INTENSITY", r"(?<!循环)(?<!回用)(?<!再生)(?<!脱硫)(?<!减少)(?<!削减)(?:工业)?废水(?:排放)?总量|(?<!循环)(?<!回用)(?<!再生)(?<!脱硫)(?<!减少)(?<!削减)废水排放量", WATER_UNITS, 0.001, 5_000_000.0),
    Total("Q_E_SOLID_WASTE_INTENSITY", r"一般(?:工业)?固体废物(?:产生|排放)?总?量|一般固废(?:产生|排放)?总?量|无害废弃物(?:产生|排放)?总?量|一般废弃物(?:产生|排放)?总?量", MASS_UNITS, 0.001, 5_000_000.0),
    Total("Q_E_HAZ_WASTE_INTENSITY", r"危险废物(?:产生|排放)?总?量|危废(?:产生|排放)?总?量", MASS_UNITS, 0.0001, 100_000.0),
)
#: Rows of one scope: they close a total, and are none themselves.
SCOPES = (
    Total("scope 1", r"范围\s*[一1]\s*温室气体排放(?:总)?量|直接温室气体排放(?:总)?量?\s*[（(]\s*范围\s*[一1]\s*[)）]", GAS_UNITS, 0.0, 1e15),
    Total("scope 2", r"范围\s*[二2]\s*温室气体排放(?:总)?量|间接温室气体排放(?:总)?量?\s*[（(]\s*范围\s*[二2]\s*[)）]", GAS_UNITS, 0.0, 1e15),
)
#: Names without "total": only in a table of pollutants. Zero counts in a table's section of gases.
POLLUTANTS = (
    Total("Q_E_SO2_INTENSITY", r"二氧化硫(?:\s*[（(]\s*SO[₂2]\s*[）)])?|SO2", {"吨": 1e3, "千克": 1.0}, 0.001, 100_000.0),
    Total("Q_E_NOX_INTENSITY", r"氮氧化物(?:\s*[（(]\s*NO[xXₓ]\s*[）)])?|NOx", {"吨": 1e3, "千克": 1.0}, 0.001, 100_000.0),
    Total("Q_E_PM_INTENSITY", r"颗粒物(?:\s*[（(]PM[）)])?|烟尘", {"吨": 1e3, "千克": 1.0}, 0.0001, 20_000.0),
)
TONNES = {"tonnes": 1e3, "tonne": 1e3, "tons": 1e3, "ton": 1e3, "(tonnes)": 1e3, "(tonne)": 1e3, "(tons)": 1e3, "(ton)": 1e3, "kg": 1.0}
COAL_WORDS = {"tonnes of standard coal equivalent": 1e3, "tonnes of standard coal": 1e3, "tce": 1e3, "kgce": 1.0}
ENGLISH = (
    Total("Q_E_GHG_INTENSITY", r"(?:Total\s+)?(?:GHG|greenhouse\s+gas)\s+emissions?\s*(?:\(?\s*Scope\s*1\s*(?:\+|and|&)\s*Scope\s*2\s*\)?)?(?!\s*[:：]?\s*Scope)(?!\s*[:-]?\s*(?:Direct|Indirect))(?!\s+intensity)(?!\s+density)", {"kilotonnes": 1e6, "kt": 1e6, "tCO2e": 1e3, "tCO₂e": 1e3, "tonnes of carbon dioxide equivalent": 1e3, "tonnes CO2e": 1e3, "tonnes CO₂e": 1e3, "tonnes": 1e3}, 0.001, 200_000.0),
    Total("Q_E_ENERGY_INTENSITY", r"Total\s+(?:comprehensive\s+)?energy\s+consumption(?!\s+intensity)(?!\s+density)", COAL_WORDS, 0.0001, 100_000.0),
    Total("Q_E_CLEAN_ENERGY_INTENSITY", r"(?:Total\s+)?(?:renewable|clean|green)\s+energy\s+(?:consumption|use)(?!\s+intensity)(?!\s+density)", COAL_WORDS, 0.0001, 100_000.0),
    Total("Q_E_WATER_INTENSITY", r"Total\s+water\s+consumption(?!\s+intensity)(?!\s+density)", {"kilotonnes": 1e6, "cubic metres": 1e3, "m3": 1e3, "m³": 1e3, "tonnes": 1e3}, 0.001, 5_000_000.0),
    Total("Q_E_SO2_INTENSITY", r"(?:Total\s+)?(?:SO2|sul(?:ph|f)ur\s+dioxide(?:\s*\(\s*SO2\s*\))?)(?:\s+emissions?)?(?!\s+intensity)(?!\s+density)", TONNES, 0.001, 100_000.0),
    Total("Q_E_NOX_INTENSITY", r"(?:Total\s+)?(?:NOx|nitrogen\s+oxides?(?:\s*\(\s*NOx\s*\))?)(?:\s+emissions?)?(?!\s+intensity)(?!\s+density)", TONNES, 0.001, 100_000.0),
    Total("Q_E_PM_INTENSITY", r"(?:Total\s+)?(?:particulate\s+matter(?:\s*\(\s*PM\s*\))?|particulates?(?:\s*\(\s*smoke\s+and\s+dust\s*\))?)(?:\s+emissions?)?(?!\s+intensity)(?!\s+density)", TONNES, 0.0001, 20_000.0),
    Total("Q_E_WASTEWATER_INTENSITY", r"Total\s+wastewater\s+discharge(?!\s+intensity)(?!\s+density)", {"tonnes": 1e3, "cubic metres": 1e3, "m3": 1e3, "m³": 1e3}, 0.001, 5_000_000.0),
    Total("Q_E_SOLID_WASTE_INTENSITY", r"Total\s+non-hazardous\s+waste(?:\s+generation)?(?!\s+intensity)(?!\s+density)", {"tonnes": 1e3, "kg": 1.0}, 0.001, 5_000_000.0),
    Total("Q_E_HAZ_WASTE_INTENSITY", r"Total\s+hazardous\s+waste(?:\s+generation)?(?!\s+intensity)(?!\s+density)", {"tonnes": 1e3, "kg": 1.0}, 0.0001, 100_000.0),
)
ENGLISH_SCOPES = (r"Direct\s+greenhouse\s+gas\s+emissions\s*\(Scope\s*1\)", r"Indirect\s+greenhouse\s+gas\s+emissions\s*\(Scope\s*2\)")
GRAMS = ("Q_E_SO2_INTENSITY", "Q_E_NOX_INTENSITY", "Q_E_PM_INTENSITY")
BAD_BETWEEN = r"约|大约|增加|减少|降至|降低|下降|增长|同比|目标|计划|规划|控制在|以内|超|超过|近"
BAD_PREFIX = r"目标|计划|规划|核定|许可(?:限值|总量|上限)|排污许可量|限值|上限|减少|降低|增加|减排(?!(?:标准|任务|改造|要求|措施|工作|项目|工程|责任))|预计|预测"
PARTIAL = r"\d+\s*家[^。；\n]{0,8}(?:企业|电厂|子公司|公司|项目|基地|工厂)|所属(?!生产经营类企业|火电企业|发电企业|电厂)[^。；\n]{0,10}(?:企业|电厂|子公司|项目|基地|工厂)|子公司|分公司|项目公司|生产基地"
BAD_ENGLISH = r"(?i)equity\s+(?:basis|share)|per\s+(?:employee|unit|tonne|production|kwh|mwh|barrel)|target|baseline|produced|equivalent\s+emission\s+reduction|avoided\s+emissions?|helping.{0,80}reduce"
ANNOTATED = rf"(?i){BOTH}|Scope\s*1\s*(?:\+|and|&)\s*Scope\s*2"
SCOPE_3 = rf"(?:范围三|(?i:Scope\s*3))[\s\S]{{0,60}}?(?:百万吨二氧化碳当量|万吨二氧化碳当量|吨二氧化碳当量|万吨|吨|kilotonnes|tCO2e|tCO₂e|tonnes|kt)\s*(?:[-—/]\s*)*({N})"
SCOPE_PAIR = rf"(范围\s*[一二12]|直接排放|间接排放)\s*(?:温室气体)?(?:排放)?(?:量|总量)?\s*(?:基于位置|基于市场)?\s*(?:注?\s*\d{{1,2}}\s+)?({N})\s*(百万吨二氧化碳当量|万吨二氧化碳当量|吨二氧化碳当量|万吨|吨|tCO2e|tCO₂e)?"
#: Where a company states the intensity over its revenue itself, none is derived.
STATED = {
    "Q_E_GHG_INTENSITY": rf"(?:温室气体排放(?:强度|密度)|碳排放强度|营收碳强度|(?:GHG|greenhouse\s+gas)[^\n]{{0,60}}?intensity)[^\n]{{0,80}}(?:\n[^\n]{{0,80}})?(?:营业收入|(?<!每)百万?营收|revenue|yuan|RMB|人民币|万元(?:人民币)?(?:营业收入|营收|收入)(?!产值))[^\n]{{0,40}}{N}|(?:单位营收|每百万营收)\s*(?:温室气体|碳|GHG)[^。\n]{{0,12}}(?:排放量|总量)[^\n]{{0,20}}{N}",
    "Q_E_ENERGY_INTENSITY": rf"(?:(?:综合)?能源(?:消耗|消费)(?:强度|密度)|综合能耗强度|energy\s+intensity)[^\n]{{0,100}}?(?:营业收入|营收|revenue|yuan|RMB|人民币|万元(?:收入|营收)?)[^\n]{{0,40}}{N}|(?:单位营收|每百万营收)\s*(?:综合)?能源(?:消耗|消费)[^。\n]{{0,12}}(?:量|总量)[^\n]{{0,20}}{N}",
    "Q_E_CLEAN_ENERGY_INTENSITY": rf"(?:清洁能源|可再生能源|renewable\s+energy|clean\s+energy)[^\n]{{0,60}}?(?:消耗|使用|消费|consumption|use)?(?:强度|密度|intensity|density)[^\n]{{0,100}}?(?:营业收入|营收|revenue|yuan|RMB|人民币)[^\n]{{0,40}}{N}",
    "Q_E_WATER_INTENSITY": rf"(?:水资源(?:使用|消耗)强度|(?:用水|耗水|取水)(?:强度|密度)|water\s+intensity)[^\n]{{0,100}}?(?:营业收入|营收|revenue|yuan|RMB|人民币|万元(?:收入|营收)?)[^\n]{{0,40}}{N}|(?:单位营收|每百万营收)\s*用水[^。\n]{{0,8}}量[^\n]{{0,20}}{N}",
    "Q_E_SO2_INTENSITY": r"(?:二氧化硫|SO2|sulphur\s+dioxide|sulfur\s+dioxide)[^\n]{0,60}?(?:强度|密度|intensity|density)[^\n]{0,60}?(?:营业收入|(?<!每)百万营收|(?<!百万)营收|万元(?!产值)|revenue|yuan|RMB|人民币)",
    "Q_E_NOX_INTENSITY": r"(?:氮氧化物|NOx|nitrogen\s+oxides?)[^\n]{0,60}?(?:强度|密度|intensity|density)[^\n]{0,60}?(?:营业收入|(?<!每)百万营收|(?<!百万)营收|万元(?!产值)|revenue|yuan|RMB|人民币)",
    "Q_E_PM_INTENSITY": r"(?:颗粒物|烟尘|particulate\s+matter)[^\n]{0,60}?(?:强度|密度|intensity|density)[^\n]{0,60}?(?:营业收入|(?<!每)百万营收|(?<!百万)营收|万元(?!产值)|revenue|yuan|RMB|人民币)",
    "Q_E_WASTEWATER_INTENSITY": r"(?:废水|wastewater)[\s\S]{0,60}?(?:强度|密度|intensity|density)[\s\S]{0,60}?(?:营业收入|(?<!每)百万营收|(?<!百万)营收|万元(?!产值)|revenue|yuan|RMB|人民币)",
    "Q_E_SOLID_WASTE_INTENSITY": r"(?:一般(?:工业)?固体废物|一般固废|无害废弃物|一般废弃物|non-hazardous\s+waste)[^\n]{0,60}?(?:强度|密度|intensity|density)[^\n]{0,80}?(?:营业收入|(?<!每)百万营收|(?<!百万)营收|万元(?!产值)|revenue|yuan|RMB|人民币)",
    "Q_E_HAZ_WASTE_INTENSITY": r"(?:危险废物|危废|hazardous\s+waste)[\s\S]{0,60}?(?:强度|密度|intensity|density)[\s\S]{0,60}?(?:营业收入|(?<!每)百万营收|(?<!百万)营收|万元(?!产值)|revenue|yuan|RMB|人民币)",
}

# End of fixed values.


CELL = rf"(?:{N}|[/—–-])"


def _units(rule: Total) -> str:
    return "|".join(u.replace("(", r"\(").replace(")", r"\)") for u in sorted(rule.units, key=len, reverse=True))


def _let(values: dict[str, Column], then) -> Column:
    """What follows from named values, each of them computed once; a column that is used again is otherwise computed again."""
    return F.get(F.transform(F.array(F.struct(*[x.alias(name) for name, x in values.items()])), then), F.lit(0))


def _plain(unit: Column) -> Column:
    return F.lower(F.regexp_replace(unit, r"\s+", " "))


def _entry(plain: Column, table: dict[str, float]) -> Column:
    """The table's entry, null for what it does not hold; the table is one SQL text, which is parsed in one call."""
    entries = {k.lower(): v for k, v in table.items()}
    return F.expr("map(" + ", ".join(f"'{k}', {v!r}D" for k, v in entries.items()) + ")")[plain]


def _factor(rule: Total, plain: Column) -> Column:
    return _entry(plain, rule.units)


def _table(rule: Total) -> str:
    """A row: label, unit before or after the values or in brackets, one value for each year or one alone. Groups: unit, values, unit."""
    unit, before = _units(rule), r"(?:\s*注\s*\d+)?\s*(?:为|达到|:)?\s*"
    return rf"(?im)^[ \t]*(?:{rule.label}){before}(?:\(?({unit})\)?\s*)?({CELL}(?:[ \t]+{CELL})*)[ \t]*({unit})?(?:[ \t]+(?:0|[/—–-]))?[ \t]*[。；;,，、]?[ \t]*$"


def _stated(rule: Total) -> str:
    """A total with its value in a sentence. Groups: between, value, unit."""
    return rf"{headed(rule.label)}(\s*(?:为|达到|:)?\s*)({N})\s*({_units(rule)})(?![ \t]*(?:{N}|%))(?=\s*(?:$|[；;，,。、]))"


def _sentence(rule: Total) -> str:
    """What stands before a total in its sentence, up to 120 characters, and the total. Groups: before, between, value, unit."""
    return rf"(?m)([^。；;]{{0,120}}?){_stated(rule)}"


def _holds(low: Column, pattern: str) -> Column:
    """Whether a text in lower case holds a literal that every match of the pattern needs: no pattern is tried on a text without."""
    needs = required(pattern)
    return F.lit(True) if needs is None else reduce(or_, [low.contains(literal) for literal in sorted(needs)])


def _matches(rule: Total, text: Column, low: Column, pattern: str, fields, also: Column | None = None) -> Column:
    """The fields of all matches, where `also` holds."""
    tried = _holds(low, rule.label) if also is None else _holds(low, rule.label) & also
    return F.transform(F.when(tried, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), fields)


def _in_column(cells: Column, years: Column, report_year: int) -> Column:
    """The report year's cell: by the header if there is one for each of its years, else the only one (a dash may follow)."""
    several = F.coalesce(F.size(years), F.lit(0)) >= 2
    at = F.array_position(years, F.lit(report_year)).cast("int")
    alone = (F.size(cells) == 1) | ((F.size(cells) == 2) & ~several & F.get(cells, F.lit(1)).isin("0", "/", "-", "—", "–"))
    return F.when(several & (F.size(cells) == F.size(years)) & (at > 0), F.get(cells, at - 1)).when(alone, F.get(cells, F.lit(0)))


def _row(rule: Total, years: Column, report_year: int, english: bool = False, zero: Column | None = None):
    pattern = _table(rule)

    def fields(m: Column) -> Column:
        unit = F.coalesce(F.nullif(F.regexp_extract(m, pattern, 1), F.lit("")), F.nullif(F.regexp_extract(m, pattern, 3), F.lit("")))
        cells = F.regexp_extract_all(F.regexp_extract(m, pattern, 2), F.lit(CELL), F.lit(0))
        return _let({"unit": _plain(unit), "cells": cells}, lambda p: _let({"factor": _factor(rule, p["unit"]), "cell": _in_column(p["cells"], years, report_year), "cells": p["cells"]}, lambda p: _let({"kilos": number(p["cell"]) * p["factor"], "factor": p["factor"], "cells": p["cells"]}, lambda p: row(m, **{c: p[c] for c in ("kilos", "factor", "cells")}))))

    def row(m: Column, kilos: Column, factor: Column, cells: Column) -> Column:
        kept = kilos > 0 if zero is None else (kilos > 0) | (zero & (kilos == 0))
        bad = (m.rlike(BAD_ENGLISH) | (F.size(cells) != F.coalesce(F.size(years), F.lit(-1)))) if english else F.regexp_replace(m, rf"(?i){headed(rule.label)}", "").rlike(headed(BAD_BETWEEN))
        last = (F.size(cells) > 1) & (F.element_at(years, -1) == report_year)
        form = F.when(last, "current-last").when(F.size(cells) > 1, "current-first").otherwise("single")
        return F.when(kept & ~bad, F.struct(F.lit(rule.code).alias("code"), kilos.alias("kilos"), form.alias("form"), F.size(cells).alias("cells"), F.trim(F.regexp_replace(m, r"\s+", " ")).alias("evidence"), F.transform(cells, lambda c: number(c) * factor).alias("all")))

    return pattern, fields


def _spoken(rule: Total):
    pattern = _sentence(rule)

    def fields(m: Column) -> Column:
        values = {"before": F.regexp_extract(m, pattern, 1), "amount": number(F.regexp_extract(m, pattern, 3)), "unit": _plain(F.regexp_extract(m, pattern, 4))}
        return _let(values, lambda p: _let({"before": p["before"], "kilos": p["amount"] * _factor(rule, p["unit"])}, lambda p: row(m, p["before"], p["kilos"])))

    def row(m: Column, before: Column, kilos: Column) -> Column:
        fine = ~before.rlike(BAD_PREFIX) & ~before.rlike(PARTIAL) & (kilos > 0)
        whole = F.trim(F.regexp_replace(F.substr(m, F.length(before) + 1), r"\s+", " "))
        return F.when(fine, F.struct(F.lit(rule.code).alias("code"), kilos.alias("kilos"), F.lit("sentence").alias("form"), F.lit(1).alias("cells"), whole.alias("evidence"), F.array(kilos).alias("all")))

    return pattern, fields


def page_totals(pages: DataFrame, keep: list[str], report_year: int) -> DataFrame:
    """keep, page, indicator_code, kilos, form, cells, evidence: each page's totals, those of greenhouse gas closed by scopes."""
    def normal(m: Column) -> Column:
        text = scientific(line_text(m["page_text"]))
        text = F.regexp_replace(text, r"/(?=[/\d\s]|$)", " / ")  # a stroke in a value's place, not in a unit
        return F.struct(F.regexp_replace(text, r"(百万|万)\s*\n\s*(吨(?:二氧化碳当量|标准煤|标煤)?)", "$1$2").alias("_x"))

    any_label = "|".join(t.label for t in (*TOTALS, *SCOPES, *POLLUTANTS, *ENGLISH))
    near = pages.select(*keep, "page", generated(["page_text"], normal)).filter(F.col("_x").rlike(f"(?i){headed(f'{any_label}|{SCOPE_PAIR}')}"))
    lined = near.withColumns({"_years": column_years(F.split("_x", "\n"))["years"], "_low": F.lower("_x")})

    def read(m: Column) -> Column:
        x, low, years = m["_x"], m["_low"], m["_years"]
        found = [_matches(t, x, low, *_row(t, years, report_year)) for t in (*TOTALS, *SCOPES)] + [_matches(t, x, low, *_spoken(t), also=x.rlike(f"(?m){_stated(t)}")) for t in TOTALS]
        found += [_matches(t, x, low, *_row(t, years, report_year, english=True)) for t in ENGLISH]
        # names alone count in a table of pollutants or under a header of years
        section = x.rlike("气体污染物排放")
        matrix = x.rlike(rf"废气污染物种类\s*{report_year}\s*年度?\s*单位") | (F.array_position(years, F.lit(report_year)) > 0)
        found += [_matches(t, x, low, *_row(t, years, report_year, zero=section & F.lit(t.code != "Q_E_SO2_INTENSITY")), also=matrix) for t in POLLUTANTS]
        nothing = F.array().cast("array<string>")
        pairs = F.transform(F.when(_holds(low, SCOPE_PAIR) & x.rlike(headed(SCOPE_PAIR)), F.regexp_extract_all(x, F.lit(rf"([\s\S]{{0,40}}?){headed(SCOPE_PAIR)}"), F.lit(0))).otherwise(nothing), _pair(x))
        others = F.when(_holds(low, SCOPE_3), F.regexp_extract_all(x, F.lit(SCOPE_3), F.lit(1))).otherwise(nothing)
        english = [F.when(_holds(low, label), F.regexp_extract_all(F.regexp_extract(x, rf"(?im)^\s*{label}\s*(?:tCO2e|tCO₂e|tonnes)?\s*({N}(?:\s+{N}){{0,3}})\s*$", 1), F.lit(N), F.lit(0))).otherwise(nothing) for label in ENGLISH_SCOPES]
        return F.struct(
            F.array_compact(F.flatten(F.array_compact(F.array(*found)))).alias("rows"), F.filter(pairs, lambda p: p["kilos"].isNotNull()).alias("pairs"), F.exists(others, lambda v: number(v) > 0).alias("s3"),
            F.transform(english[0], lambda v: number(v)).alias("e1"), F.transform(english[1], lambda v: number(v)).alias("e2"),
        )

    # rows and pairs are generated once; what follows from them are columns over them
    facts = lined.select(*keep, "page", generated(["_x", "_low", "_years"], read))
    scope = lambda name: F.get(F.filter("rows", lambda r: r["code"] == name), F.lit(0))["kilos"]
    own = lambda n: F.filter("pairs", lambda p: p["scope"] == n)
    located = F.filter("second", lambda p: p["evidence"].contains("基于位置"))
    several = (F.size(F.array_distinct(F.transform("second", lambda p: p["kilos"]))) > 1) & (F.size(located) > 0)
    facts = facts.withColumns({"s1": scope("scope 1"), "s2": scope("scope 2"), "p1": F.get(own(1), F.lit(0)), "second": own(2)}).withColumn("p2", F.get(F.when(several, located).otherwise(F.col("second")), F.lit(0)))

    def closed(r: Column) -> Column:
        """A total of greenhouse gas that is known to be of scopes 1 and 2; columns of English tables must close at one place only."""
        s1, s2 = F.col("s1"), F.col("s2")
        fits = F.coalesce(F.abs(r["kilos"] - s1 - s2) <= F.greatest(r["kilos"], F.lit(1.0)) * 0.01, F.lit(True))
        return (r["code"] != "Q_E_GHG_INTENSITY") | r["evidence"].rlike(ANNOTATED) | (~F.col("s3") & fits)

    def aligned(r: Column) -> Column:
        same = (F.size("e1") == F.size(r["all"])) & (F.size("e2") == F.size(r["all"])) & (F.size("e1") > 0) & (r["code"] == "Q_E_GHG_INTENSITY")
        closing = F.filter(r["all"], lambda v, i: F.abs(v - (F.get("e1", i) + F.get("e2", i)) * 1000) <= F.greatest(v, F.lit(1.0)) * 0.01)
        return F.when(same & (F.size(closing) > 1), F.lit(None)).when(same & (F.size(closing) == 1), closing[0]).otherwise(r["kilos"])

    rows = F.filter(F.transform(F.filter("rows", lambda r: ~r["code"].startswith("scope") & closed(r)), lambda r: F.struct(r["code"].alias("indicator_code"), aligned(r).alias("kilos"), r["form"].alias("form"), r["cells"].alias("cells"), r["evidence"].alias("evidence"))), lambda r: r["kilos"].isNotNull())
    both = F.col("p1.kilos") + F.col("p2.kilos")
    summed = F.array(F.struct(F.lit("Q_E_GHG_INTENSITY").alias("indicator_code"), both.alias("kilos"), F.lit("scope 1 + scope 2").alias("form"), F.lit(1).alias("cells"), F.concat_ws(" + ", "p1.evidence", "p2.evidence").alias("evidence")))
    gas = lambda rows: F.exists(rows, lambda r: r["indicator_code"] == "Q_E_GHG_INTENSITY")
    return facts.select(*keep, "page", F.inline(_let({"rows": rows}, lambda p: F.when(~gas(p["rows"]) & (both > 0), F.concat(p["rows"], summed)).otherwise(p["rows"]))))


def _pair(x: Column):
    """A scope stated in a line of its own; its unit may stand in the page's header."""
    whole = rf"([\s\S]{{0,40}}?){SCOPE_PAIR}"

    def fields(m: Column) -> Column:
        values = {name: F.regexp_extract(m, whole, i) for i, name in enumerate(("before", "label", "amount", "unit"), 1)}
        return _let({**values, "plain": F.lower(F.regexp_replace(values["unit"], r"\s+", ""))}, lambda p: pair(m, *[p[c] for c in (*values, "plain")]))

    def pair(m: Column, before: Column, label: Column, amount: Column, unit: Column, plain: Column) -> Column:
        factor = F.coalesce(_entry(plain, GAS_UNITS), F.when((unit == "") & x.rlike("(?i)tCO2e|tCO₂e|吨二氧化碳当量"), 1000.0))
        fine = ~before.rlike(BAD_PREFIX) & ~before.rlike("范围三|范畴三")
        scope = F.when(label.rlike(r"[一1]|直接"), 1).otherwise(2)
        return F.struct(scope.alias("scope"), F.when(fine, number(amount) * factor).alias("kilos"), F.trim(F.regexp_replace(F.substr(m, F.length(before) + 1), r"\s+", " ")).alias("evidence"))

    return fields


SPREAD = 1e-4


def _agree(low: Column, high: Column) -> Column:
    return high - low <= F.greatest(F.abs(low), F.abs(high), F.lit(1.0)) * SPREAD


def company_totals(totals: DataFrame, key: list[str]) -> DataFrame:
    """key, indicator_code, kilos, basis: a company's total over all documents and pages, if one can be told.

    All agree; or those that name scopes 1 and 2 (stated or summed); or those of tables that end with the report year; or of
    these the ones with the most columns, three at least. Otherwise the company has none.
    """
    named = F.col("evidence").rlike(ANNOTATED) | (F.col("form") == "scope 1 + scope 2")
    last = F.col("form") == "current-last"
    by = [*key, "indicator_code"]
    kinds = {"all": F.lit(True), "named": named, "last": last}
    ends = [(kind, name, f) for kind in kinds for name, f in (("low", F.min), ("high", F.max))]
    # by columns first, then over them: the totals are read once, where the greatest number of columns joined back reads the pages twice
    sized = totals.groupBy(*by, "cells").agg(*[f(F.when(kinds[kind], F.col("kilos"))).alias(f"{kind}_{name}") for kind, name, f in ends], F.bool_or(last).alias("_last"))
    widest = F.max(F.when(F.col("_last"), F.struct("cells", "last_low", "last_high")))
    wide = sized.groupBy(*by).agg(*[f(f"{kind}_{name}").alias(f"{kind}_{name}") for kind, name, f in ends], widest.alias("_widest"))
    wide = wide.withColumns({f"widest_{name}": F.when(F.col("_widest.cells") >= 3, F.col(f"_widest.last_{name}")) for name in ("low", "high")})
    kilos, basis = F, F
    for kind in (*kinds, "widest"):
        fits = F.coalesce(_agree(F.col(f"{kind}_low"), F.col(f"{kind}_high")), F.lit(False))
        kilos, basis = kilos.when(fits, F.col(f"{kind}_low")), basis.when(fits, F.lit(kind))
    return wide.select(*by, kilos.alias("kilos"), basis.alias("basis")).filter("kilos IS NOT NULL")


def stated_intensities(pages: DataFrame, key: list[str]) -> DataFrame:
    """key, indicator_code of companies that state an intensity over revenue; of greenhouse gas by location and market does not count."""
    def stated(x: Column, low: Column, code: str, pattern: str) -> Column:
        hit = F.when(_holds(low, pattern), F.regexp_extract(x, rf"(?i){headed(pattern)}[\s\S]{{0,120}}", 0)).otherwise("")
        both = hit.rlike("(?i)基于地理位置|基于市场|location-based|market-based") if code == "Q_E_GHG_INTENSITY" else F.lit(False)
        return F.when((hit != "") & ~both, F.lit(code))

    text = pages.select(*key, generated(["page_text"], lambda m: F.struct(line_text(m["page_text"]).alias("_x")))).withColumn("_low", F.lower("_x"))
    rows = text.select(*key, generated(["_x", "_low"], lambda m: F.struct(F.array_compact(F.array(*[stated(m["_x"], m["_low"], c, p) for c, p in STATED.items()])).alias("codes"))))
    return rows.select(*key, F.explode("codes").alias("indicator_code")).distinct()


def derived_intensities(totals: DataFrame, revenue: DataFrame, stated: DataFrame, key: list[str]) -> DataFrame:
    """key, indicator_code, value, basis: totals per 10,000 yuan of revenue, within each indicator's bounds.

    Kilograms, but grams of sulphur dioxide, nitrogen oxides and particles, of which zero counts too. Documents whose
    revenues differ leave the company without.
    """
    income = revenue.filter("revenue > 0").groupBy(*key).agg(F.min("revenue").alias("revenue"), F.max("revenue").alias("_high")).filter(_agree(F.col("revenue"), F.col("_high"))).drop("_high")
    rows = company_totals(totals, key).join(income, key).join(stated.select(*key, "indicator_code").distinct(), [*key, "indicator_code"], "left_anti")
    grams = F.col("indicator_code").isin(*GRAMS)
    value = F.col("kilos") * F.when(grams, 1000.0).otherwise(1.0) * 10_000 / F.col("revenue")
    low, high = (lookup(F.col("indicator_code"), {t.code: getattr(t, x) for t in TOTALS}) for x in ("low", "high"))
    return rows.withColumn("value", value).filter(F.col("value").between(low, high) | (grams & (F.col("value") == 0))).select(*key, "indicator_code", "value", "basis")

"""Why an indicator has no candidate, from a company's texts: classes by what they say around the indicator's subject."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Subjects, words of intensities and denominators, and pairs of fields that would close a formula.
SUBJECTS = {
    "Q_E_GHG_INTENSITY": r"(?:GHG|greenhouse\s+gas|温室气体|碳排放)",
    "Q_E_ENERGY_INTENSITY": r"(?:energy|能源|综合能耗)",
    "Q_E_SOLID_WASTE_INTENSITY": r"(?:non[- ]hazardous\s+waste|solid\s+waste|一般固体废物|固体废物)",
    "Q_E_SO2_INTENSITY": r"(?:SO2|sulphur\s+dioxide|sulfur\s+dioxide|二氧化硫)",
    "Q_E_NOX_INTENSITY": r"(?:NOx|nitrogen\s+oxides?|氮氧化物)",
    "Q_E_WATER_INTENSITY": r"(?:water\s+(?:consumption|withdrawal)|耗水|用水)",
}
INTENSITY = r"(?:intensit(?:y|ies)|强度|密度)"
FOREIGN = r"(?i)(?:HK\s*\$|HKD|US\s*\$|USD|港元|美元)"
YUAN = r"(?i)(?:RMB|人民币|万元|million\s+RMB|RMB\s*['’]?000)"
YUAN_REVENUE = r"(?i)(?:每|单位|/|per\s+)(?:营业收入|营收|revenue)?[^。；;\n]{0,20}(?:万元|百万元|亿元|RMB|人民币|million\s+RMB)|(?:万元|百万元|亿元|million\s+RMB)[^。；;\n]{0,20}(?:营业收入|营收|revenue)"
OTHER_DENOMINATOR = r"(?i)(?:production|output|product|MWh|kWh|GJ|tonne\s+product|产量|发电量|产品)"
QUANTITY = r"[\d,]+(?:\.\d+)?\s*"
MASSES = r"(?:吨|千克|公斤|kg|tonnes?)"
PHYSICAL = {
    "Q_E_GHG_INTENSITY": rf"(?:温室气体(?:排放)?总量|碳排放总量|total\s+(?:GHG|greenhouse\s+gas)\s+emissions?)[^。；;\n]{{0,120}}?{QUANTITY}(?:吨|千克|公斤|kg|tonnes?|tCO2e)",
    "Q_E_ENERGY_INTENSITY": rf"(?:能源|能耗)(?:消耗|消费)?总量[^。；;\n]{{0,120}}?{QUANTITY}(?:吨标准煤|tce|千瓦时|兆瓦时|kWh|MWh|吉焦|GJ)",
    "Q_E_SOLID_WASTE_INTENSITY": rf"(?:一般固体废物|固体废物|non[- ]hazardous\s+waste|solid\s+waste)(?:产生|排放|处置)?(?:总)?量?[^。；;\n]{{0,100}}?{QUANTITY}{MASSES}",
    "Q_E_SO2_INTENSITY": rf"(?:SO2|sulphur\s+dioxide|sulfur\s+dioxide|二氧化硫)(?:排放)?(?:总)?量?[^。；;\n]{{0,100}}?{QUANTITY}{MASSES}",
    "Q_E_NOX_INTENSITY": rf"(?:NOx|nitrogen\s+oxides?|氮氧化物)(?:排放)?(?:总)?量?[^。；;\n]{{0,100}}?{QUANTITY}{MASSES}",
    "Q_E_WATER_INTENSITY": rf"(?:耗水|用水|water\s+(?:consumption|withdrawal))(?:总)?量?[^。；;\n]{{0,100}}?{QUANTITY}(?:立方米|吨|m[³3]|tonnes?)",
}
SCOPE = r"(?i)(?:核算|统计|披露|报告)(?:边界|范围)[^。；;\n]{0,80}(?:基地|子公司|场所|sites?|facilit(?:y|ies))"
NO_TOTAL = r"(?i)(?:累计|减少|减排|避免|交易|配额|目标|计划|预计|reduction|saving|avoided|capacity)"
MONEY = r"(?:元|万元|百万元|RMB|CNY|HKD|HK\$|US\$)"
REVENUE = r"(?:营业收入|revenue)[^。；;\n]{0,160}[\d,]+(?:\.\d+)?"
CLOSURES = {
    "Q_G_DEBT_ASSET_RATE": (r"(?:资产总计|Total\s+assets)", r"(?:负债合计|Total\s+liabilities)", "possible_balance_sheet_formula_closure"),
    "Q_S_RD_RATE": (rf"(?:研发(?:投入|费用)|R&D\s+(?:investment|expenses?))[^。；;\n]{{0,160}}{QUANTITY}{MONEY}", REVENUE, "possible_rd_revenue_formula_closure"),
    "Q_S_SAFETY_INVEST_RATE": (rf"(?:安全生产投入|work\s+safety\s+investment|safety\s+investment)[^。；;\n]{{0,160}}{QUANTITY}{MONEY}", REVENUE, "possible_safety_revenue_formula_closure"),
    "Q_E_GHG_REDUCTION_RATE": (r"(?:温室气体(?:排放)?总量|(?:total\s+)?(?:GHG|greenhouse\s+gas)\s+emissions?)(?=[^。；;\n]{0,140}(?:吨|千克|kg|tonnes?|tCO2e))[^。；;\n]{0,180}[\d,]+(?:\.\d+)?[^。；;\n]{0,80}[\d,]+(?:\.\d+)?", r"(?s)(?:2025.{0,120}2024|2024.{0,120}2025)", "possible_two_year_ghg_formula_closure"),
    "Q_E_HAZ_WASTE_INTENSITY": (rf"(?:危险废物|危废|hazardous\s+waste)[^。；;\n]{{0,100}}{QUANTITY}{MASSES}", r"(?:营业收入|revenue|百万元|万元)", "possible_hazardous_waste_revenue_closure"),
    "Q_E_CLEAN_ENERGY_INTENSITY": (rf"(?:(?:清洁能源|可再生能源|绿色电力|绿电)(?:使用|消耗|消费|采购)(?:总)?量|(?:renewable|clean)\s+energy\s+(?:consumption|used|purchased))[^。；;\n]{{0,100}}{QUANTITY}(?:千瓦时|兆瓦时|吉焦|kWh|MWh|GJ)", r"(?:营业收入|revenue|百万元|万元)", "possible_clean_energy_revenue_closure"),
}
OTHER_WATER = r"(?:再生水|回用水|中水|循环水|替代水源|recycled\s+water|reused\s+water|alternative\s+water)"
WATER_RATE = rf"(?:{OTHER_WATER})[^。；;\n]{{0,100}}?(?:占比|比例|rate|percentage)[^。；;\n]{{0,60}}?{QUANTITY}%|(?:占比|比例|rate|percentage)[^。；;\n]{{0,80}}?(?:{OTHER_WATER})[^。；;\n]{{0,60}}?{QUANTITY}%"
WATER_PART = rf"(?:{OTHER_WATER})(?:使用|用|消耗|取用|量|consumption|used|use)?[^。；;\n]{{0,100}}?{QUANTITY}(?:立方米|吨|m[³3]|tonnes?)"
WATER_TOTAL = rf"(?:总用水量|用水总量|总耗水量|total\s+water\s+(?:consumption|use|withdrawal))[^。；;\n]{{0,100}}?{QUANTITY}(?:立方米|吨|m[³3]|tonnes?)"
DIVIDEND = r"(?is)(?:每股(?:现金)?分红|股息每股|dividend\s+per\s+share).{0,100}"
# End of fixed values.


NO_TEXT = "missing_text"


def _evidence(code: Column, text: Column) -> Column:
    """What one text shows of an indicator: a class that it decides alone, and the halves of what texts decide together."""
    nothing, no = F.lit(None).cast("string"), F.lit(False)

    def of(hit=nothing, left=no, right=no, subject=no, total=nothing) -> Column:
        return F.struct(hit.alias("hit"), left.alias("left"), right.alias("right"), subject.alias("subject"), total.alias("total"))

    dividend = F.regexp_substr(text, F.lit(DIVIDEND))
    found = F.when(code == "Q_E_ALTERNATIVE_WATER_RATE", of(F.when(text.rlike(f"(?i){WATER_RATE}"), "possible_direct_alternative_water_rate"), text.rlike(f"(?i){WATER_PART}"), text.rlike(f"(?i){WATER_TOTAL}")))
    found = found.when(code == "Q_S_DIVIDEND_PER_SHARE", of(
        F.when(dividend.rlike(r"(?i)HKD|HK\$|港元|cents?"), "dividend_disclosed_foreign_currency").when(dividend.rlike("(?i)RMB|人民币|元"), "possible_rmb_dividend_rule_gap").when(dividend.isNotNull(), "ambiguous_dividend_per_share")))
    for name, (left, right, _) in CLOSURES.items():
        found = found.when(code == name, of(left=text.rlike(f"(?i){left}"), right=text.rlike(f"(?i){right}")))
    for name, subject in SUBJECTS.items():
        together = F.regexp_substr(text, F.lit(rf"(?is)(?:{subject}.{{0,160}}{INTENSITY}|{INTENSITY}.{{0,160}}{subject}).{{0,180}}"))
        total = F.regexp_substr(text, F.lit(rf"(?is).{{0,120}}(?:{PHYSICAL[name]}).{{0,180}}"))
        hit = (
            F.when(together.rlike(FOREIGN), "disclosed_foreign_currency_denominator").when(together.rlike(YUAN_REVENUE), "likely_methodology_compatible_rule_gap")
            .when(together.rlike(OTHER_DENOMINATOR), "disclosed_non_revenue_denominator").when(together.isNotNull(), "ambiguous_intensity_disclosure")
        )
        state = F.when(total.rlike(SCOPE), "disclosed_scope_mismatch_requires_review").when(total.rlike(NO_TOTAL), "related_disclosure_without_compatible_intensity").when(total.isNotNull(), "possible_total_plus_rmb_revenue_derivation")
        found = found.when(code == name, of(hit, text.rlike(YUAN), text.rlike("(?i)revenue|营业收入"), text.rlike(f"(?i){subject}"), state))
    return found


def gap_diagnosis(tasks: DataFrame, documents: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """key, indicator_code, class, documents: why a company has no candidate for an indicator, from all its texts together.

    Halves of a formula may stand in different documents (assets in one, liabilities in another). Where one text decides, the
    first in `order` that does counts. Documents without text are as if they were not there, and a company that has no
    text at all is missing_text. Texts keep their rows; only flags are gathered.
    """
    place = F.col(f"`{order}`") if order else F.lit(0)
    texts = documents.filter(F.col("text").isNotNull()).select(*key, "text", place.alias("_place"))
    rows = tasks.select(*key, "indicator_code").distinct().join(texts, key, "left")
    in_yuan = F.col("text").rlike(r"营业收入[^。；;\n]{0,16}(?:人民币)?元")
    seen = rows.withColumn("_e", F.when(F.col("text").isNotNull(), _evidence(F.col("indicator_code"), F.col("text")))).withColumn("_yuan", in_yuan)
    e = lambda name: F.col(f"_e.{name}")
    first = lambda name: F.min_by(e(name), F.when(e(name).isNotNull(), F.struct("_place", e(name).alias("x"))))
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    told = seen.groupBy(*key, "indicator_code").agg(
        F.count("text").alias("documents"), first("hit").alias("hit"), first("total").alias("total"), some(e("left")).alias("left"), some(e("right")).alias("right"), some(e("subject")).alias("subject"), some(F.col("_yuan")).alias("yuan"))
    code, both = F.col("indicator_code"), F.col("left") & F.col("right")
    out = F.when(F.col("documents") == 0, NO_TEXT).when(F.col("hit").isNotNull(), F.col("hit"))
    out = out.when(code == "Q_E_ALTERNATIVE_WATER_RATE", F.when(both, "possible_alternative_water_formula_closure").otherwise("related_fields_incomplete")).when(code == "Q_S_DIVIDEND_PER_SHARE", "no_dividend_per_share_disclosure")
    for name, (_, _, closed) in CLOSURES.items():
        out = out.when(code == name, F.when(both, closed).otherwise("related_fields_incomplete"))
    out = out.when(code.isin(*SUBJECTS), F.when(~F.col("subject"), "no_matching_disclosure_in_text").when(both | F.col("yuan"), F.coalesce("total", F.lit("related_disclosure_without_compatible_intensity"))).otherwise("related_disclosure_without_compatible_intensity"))
    out = out.when(code.startswith("Q_E_"), "requires_specialized_environmental_diagnostic").otherwise("no_closed_formula_detected")
    return told.select(*key, "indicator_code", out.alias("class"), "documents")

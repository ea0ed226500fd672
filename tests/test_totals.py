"""Totals, scopes and what follows from them, on pages as companies write them; every group of documents is one company."""

import pytest
from pyspark.sql import functions as F

from verdigris.operators.matcher import headed
from verdigris.operators.totals import SCOPE_PAIR, STATED, TOTALS, company_totals, derived_intensities, page_totals, stated_intensities

YEAR, REVENUE = 2025, 1.705e10
GHG, ENERGY, CLEAN, WATER = (f"Q_E_{x}_INTENSITY" for x in ("GHG", "ENERGY", "CLEAN_ENERGY", "WATER"))
SO2, NOX, PM = (f"Q_E_{x}_INTENSITY" for x in ("SO2", "NOX", "PM"))


def per_revenue(kilos):
    return kilos * 1e4 / REVENUE


CASES = {
    "table with scopes": (["指标 单位 2023 年 2024 年 2025 年\n温室气体排放总量（含范围一及范围二） 万吨二氧化碳当量 2.50 2.90 2.95\n范围一温室气体排放总量 万吨二氧化碳当量 0.06 0.21 0.15\n"], {GHG: per_revenue(2.95e7)}),
    "two scopes": (["范围一排放 0.19 万吨\n范围二排放 5.50 万吨\n"], {GHG: per_revenue(5.69e7)}),
    "location before market": (["范围一排放 1.00 万吨\n范围二排放基于市场 9.00 万吨\n范围二排放基于位置 5.00 万吨\n"], {GHG: per_revenue(6e7)}),
    "named total wins": (["指标 单位 2024 年 2025 年\n温室气体排放总量（范围 1 和范围 2） 吨二氧化碳当量 18520.94 22740.25\n温室气体排放总量 吨二氧化碳当量 14719.00 16000.00\n"], {GHG: per_revenue(22740.25e3)}),
    "card": (["实际行动。\n温室气体排放总量\n2.95万吨二氧化碳当量\n员工总数\n5,987人\n"], {GHG: per_revenue(2.95e7)}),
    "energy and water": (["指标 单位 2025 2024\n能源消耗总量 吨标准煤 6,216.97 7,585.57\n总用水量 吨 596,001.30 580,000\n"], {ENERGY: per_revenue(6216.97e3), WATER: per_revenue(596001.30e3)}),
    "clean energy differs": (["议题 指标 单位 2024 年 2025 年\n其中：清洁能源使用量 吨标准煤 / 4,989.23\n清洁能源消耗总量 吨标煤 227.39 157.65\n"], {}),
    "clean energy": (["关键指标 单位 2025 年\n可再生能源消耗量 吨标准煤 3,732.21\n"], {CLEAN: per_revenue(3732.21e3)}),
    "saved energy": (["2025 年公司风电发电量可替代标准煤 12.5 万吨。\n清洁能源发电节约标准煤 8 万吨。\n"], {}),
    "matrix of pollutants": (["废气污染物种类 2025年度 单位\n氮氧化物 859.57 吨\n二氧化硫 353.16 吨\n烟尘 72.76 吨\n"], {NOX: per_revenue(859.57e6), SO2: per_revenue(353.16e6), PM: per_revenue(72.76e6)}),
    "names alone": (["氮氧化物 859.57 吨\n二氧化硫 353.16 吨\n烟尘 72.76 吨\n"], {}),
    "zero in a section of gases": (["披露指标 单位 2024 年 2025 年\n气体污染物排放\n颗粒物 千克 2 2\n氮氧化物 千克 5 0\n硫氧化物 千克 4 0\n"], {NOX: 0.0, PM: per_revenue(2000)}),
    "parts and loops": (["指标 单位 2025 2024\n范围一温室气体排放总量 万吨二氧化碳当量 0.15 0.21\n直接能源消耗总量 吨标准煤 2,053,921.82 2,000,000\n循环用水总量 吨 888,000 850,000\n"], {}),
    "the whole market": (["增加温室气体排放总量约 30 亿吨，覆盖全国碳市场。\n"], {}),
    "what was saved": (["减排措施直接减少的温室气体排放总量\n吨二氧化碳当量\n15.67\n"], {}),
    "stated over revenue": (["Indicator Unit 2023 2024 2025\nTotal GHG Emissions (Scope 1 + Scope 2) tCO₂e 1,618,370 1,594,055 1,498,435\nTotal GHG Emission Economic Intensity (Scope 1 + Scope 2) tCO₂e /\n10,000 yuan 0.062 0.059 0.050\n"], {}),
    "english table": (["Indicator Unit 2023 2024 2025\nTotal GHG Emissions (Scope 1 + Scope 2) tCO₂e 1,618,370 1,594,055 1,498,435\n"], {GHG: per_revenue(1498435e3)}),
    "stated over output": (["指标 单位 2023 年 2024 年 2025 年\n温室气体排放总量（含范围一及范围二） 万吨二氧化碳当量 2.50 2.90 2.95\n温室气体排放强度（万元产值温室气体排放强度） 吨二氧化碳当量 / 万元 0.02 0.01 0.016\n"], {GHG: per_revenue(2.95e7)}),
    "units in brackets": (["一级指标 二级指标 2023年 2024年 2025年\n二氧化硫排放总量（万吨） 2.27 2.22 1.99\n氮氧化物排放总量（万吨） 4.82 4.78 4.25\n2025年\n二氧化硫排放总量为\n1.99万吨\n2025年，公司所属生产经营类企业能源消费总量为7,282.08万吨标煤。\n"], {SO2: per_revenue(1.99e10), NOX: per_revenue(4.25e10), ENERGY: per_revenue(7282.08e7)}),
    "million tonnes": (["直接温室气体排放（范围1） 百万吨二氧化碳当量\n0.0264\n间接温室气体排放（范围2） 百万吨二氧化碳当量\n0.0004\n温室气体排放总量（范围1+范围2） 百万吨二氧化碳当量\n0.0268\n"], {GHG: per_revenue(0.0268e9)}),
    "scopes in spaced brackets": (["温室气体排放总量\n（范围 1+ 范围 2）\n2.95万吨二氧化碳当量\n"], {GHG: per_revenue(2.95e7)}),
    "sentences": (["优于国家超低排放标准。氮氧化物排放总量 4,697.8 吨；二氧化硫排放总量 2,724.11 吨；烟尘排放总量 391.06 吨。\n"], {NOX: per_revenue(4697.8e6), SO2: per_revenue(2724.11e6), PM: per_revenue(391.06e6)}),
    "a part of the group": (["脱硫和除尘设施投运率 100%。4 家火电企业二氧化硫排放量为 1,074.22 吨，氮氧化物排放量为 2,632.63 吨，烟尘排放量为 149.26 吨。\n"], {}),
    "scope 3 in a sentence": (["报告期内，公司范围三温室气体排放总量为 26,410,296.89 吨二氧化碳当量。\n"], {}),
    "scope 3 on the page": (["温室气体排放总量 9.00 万吨二氧化碳当量\n范围三温室气体排放量 吨二氧化碳当量 4,000\n"], {}),
    "scopes that close": (["公司总部与金辰自动化温室气体排放数据\n温室气体排放总量\n范围1温室气体排放总量\n3,582.42\n300.60\n吨二氧化碳当量\n指标 单位 2024年 2025年\n温室气体排放总量 吨二氧化碳当量 6,181.36 3,582.42\n范围1温室气体排放总量 吨二氧化碳当量 307.28 300.60\n范围2温室气体排放总量 吨二氧化碳当量 5,874.08 3,281.82\n"], {GHG: per_revenue(3582.42e3)}),
    "scopes that do not close": (["指标 单位 2024年 2025年\n温室气体排放总量 吨二氧化碳当量 6,181.36 9,582.42\n范围1温室气体排放总量 吨二氧化碳当量 307.28 300.60\n范围2温室气体排放总量 吨二氧化碳当量 5,874.08 3,281.82\n"], {}),
    "documents differ": (["温室气体排放总量 9.00 万吨二氧化碳当量\n", "温室气体排放总量 8.00 万吨二氧化碳当量\n"], {}),
    "documents agree": (["温室气体排放总量 9.00 万吨二氧化碳当量\n", "温室气体排放总量 90,000 吨二氧化碳当量\n"], {GHG: per_revenue(9e7)}),
    "by unit of revenue": (["每百万营收能源消耗总量 万吨标准煤 0.0775 0.0792 0.0789\n能源消耗总量 万吨标准煤 1,797.17\n"], {}),
    "beyond bounds": (["温室气体排放总量 99,999,999 万吨二氧化碳当量\n"], {}),
    "columns in the other order": (["Indicator Unit 2024 2025\nGreenhouse gas emissions (Scope 1 and Scope 2) tCO2e 50,302,013 44,420,360\nDirect greenhouse gas emissions (Scope 1) tCO2e 49,876,065 42,996,840\nIndirect greenhouse gas emissions (Scope 2) tCO2e 425,948 1,423,520\n"], {}),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(name, f"doc {i}", 12, text) for name, (texts, _) in CASES.items() for i, text in enumerate(texts)] + [("nothing", "doc", 1, None), ("nothing", "doc", 2, "")]
    pages = spark.createDataFrame(rows, "company string, doc string, page int, page_text string")
    revenue = spark.createDataFrame([(name, REVENUE) for name in CASES], "company string, revenue double")
    totals = page_totals(pages, ["company", "doc"], YEAR)
    got = derived_intensities(totals, revenue, stated_intensities(pages, ["company"]), ["company"]).collect()
    return {(r.company, r.indicator_code): r.value for r in got}


@pytest.mark.parametrize("name", CASES)
def test_case(found, name):
    assert {c: v for (n, c), v in found.items() if n == name} == pytest.approx(CASES[name][1])


def test_differing_revenues_leave_a_company_without(spark):
    pages = spark.createDataFrame([("a", 1, "温室气体排放总量 9.00 万吨二氧化碳当量\n")], "company string, page int, page_text string")
    two = spark.createDataFrame([("a", 1e9), ("a", 2e9)], "company string, revenue double")
    none = spark.createDataFrame([], "company string, indicator_code string")
    totals = page_totals(pages, ["company"], YEAR)
    assert derived_intensities(totals, two, none, ["company"]).count() == 0
    assert derived_intensities(totals, two.filter("revenue < 1.5e9"), none, ["company"]).count() == 1
    assert page_totals(pages.filter(F.lit(False)), ["company"], YEAR).count() == 0


def test_pages_are_read_once(spark, tmp_path):
    spark.createDataFrame([("a", 1, "温室气体排放总量 9.00 万吨二氧化碳当量\n")], "company string, page int, page_text string").write.parquet(str(tmp_path / "pages"))
    totals = page_totals(spark.read.parquet(str(tmp_path / "pages")), ["company"], YEAR)
    assert company_totals(totals, ["company"])._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1


def test_basis_of_company_totals(spark):
    rows = [("all", 5.0, "single", 1), ("all", 5.0001, "current-last", 3), ("last", 5.0, "single", 1), ("last", 6.0, "current-last", 2), ("last", 6.0, "current-last", 3), ("named", 5.0, "single", 1), ("named", 7.0, "scope 1 + scope 2", 1)]
    rows += [("widest", 5.0, "current-last", 2), ("widest", 6.0, "current-last", 3), ("widest", 7.0, "current-first", 4), ("two columns", 5.0, "current-last", 2), ("two columns", 6.0, "single", 1), ("two columns", 7.0, "current-last", 2), ("none", 5.0, "current-last", 3), ("none", 6.0, "current-last", 3)]
    totals = spark.createDataFrame([(n, "x", k, form, cells, "") for n, k, form, cells in rows], "company string, indicator_code string, kilos double, form string, cells int, evidence string")
    got = {r.company: (r.kilos, r.basis) for r in company_totals(totals, ["company"]).collect()}
    assert got == {"all": (5.0, "all"), "last": (6.0, "last"), "named": (7.0, "named"), "widest": (6.0, "widest")}


def test_a_look_at_the_first_character_changes_no_match(spark):
    texts = [text for group, _ in CASES.values() for text in group]
    df = spark.createDataFrame([(t,) for t in texts] + [(t.upper(),) for t in texts], "t string")
    patterns = [t.label for t in TOTALS] + [*STATED.values(), SCOPE_PAIR]
    assert all(headed(p) != f"(?:{p})" for p in patterns) and headed("a?b?") == "(?:a?b?)"
    both = df.select(*[(F.regexp_extract_all("t", F.lit(f"(?i){p}"), F.lit(0)) == F.regexp_extract_all("t", F.lit(f"(?i){headed(p)}"), F.lit(0))).alias(str(i)) for i, p in enumerate(patterns)])
    assert all(all(r) for r in both.collect())

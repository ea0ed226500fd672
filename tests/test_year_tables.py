"""Headers and rows of year tables as reports have them: a positive and a negative example of each form."""

import pytest

from verdigris.operators.tables import year_rows

YEAR, GHG = 2025, "Q_E_GHG_INTENSITY"
ROW = "温室气体排放强度 吨二氧化碳当量/万元营收"
PAGES = {
    "current last": (f"指标名称 指标单位 2024年数值 2025年数值\n{ROW} 0.5 0.4\n", (400.0, 500.0, "current-last")),
    "current first": (f"废气污染物种类 单位 2025年数据 2024年数据\n{ROW} 0.4 0.5\n", (400.0, 500.0, "current-first")),
    "three years": (f"环保绩效 单位 2023 年 2024 年 2025 年\n{ROW} 0.6 0.5 0.4\n", (400.0, 500.0, "current-last")),
    "one year": (f"关键绩效 单位 2025年\n{ROW} 0.4\n", (400.0, None, "single-year")),
    "traditional characters": (f"指標 單位 2024 2025\n{ROW} 0.5 0.4\n", (400.0, 500.0, "current-last")),
    "years after a line break": (f"指标 单位\n2023年 2024年 2025年\n{ROW} 0.6 0.5 0.4\n", (400.0, 500.0, "current-last")),
    "bare years of an appendix": (f"一级指标 二级指标 2024年 2025年\n{ROW} 0.5 0.4\n", (400.0, 500.0, "current-last")),
    "unit after the values": ("指标 2024年 2025年 单位\n温室气体排放强度 0.5 0.4 吨二氧化碳当量/万元营收\n", (400.0, 500.0, "current-last")),
    "unit in brackets": ("指标 单位 2024年 2025年\n温室气体排放强度(吨二氧化碳当量/万元营收) 0.5 0.4\n", (400.0, 500.0, "current-last")),
    "vertical": ("指标 单位 2023年 2024年 2025年\n温室气体排放强度\n吨二氧化碳当量/万元\n0.6\n0.5\n0.4\n用水总量\n吨\n7\n8\n9\n", (400.0, 500.0, "current-last")),
    "split": ("指标 单位 2024年 2025年\n温室气体排放强度 吨二氧化碳当量/万元营收 0.5\n0.4\n", (400.0, 500.0, "current-last")),
    "no header": (f"{ROW} 0.5 0.4\n", None),
    "other years": (f"指标 单位 2021年 2022年\n{ROW} 0.5 0.4\n", None),
    "years that repeat": (f"指标 单位 2025年 2025年\n{ROW} 0.5 0.4\n", None),
    "years in prose": (f"2025年，公司较2024年投入增加12.5%\n{ROW} 0.5 0.4\n", None),
    "a span of years": (f"指标 单位 2024-2025年\n{ROW} 0.5\n", None),
    "too few values": (f"指标 单位 2023年 2024年 2025年\n{ROW} 0.5 0.4\n说明 如下\n", None),
    "vertical with too few": ("指标 单位 2023年 2024年 2025年\n温室气体排放强度\n吨二氧化碳当量/万元\n0.6\n0.5\n说明文字在此\n7\n", None),
    "above its header": (f"{ROW} 0.5 0.4\n指标 单位 2024年 2025年\n", None),
    "foreign unit": ("指标 单位 2024年 2025年\n温室气体排放强度 磅/万元 0.5 0.4\n", None),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(name, 1, text) for name, (text, _) in PAGES.items()] + [("null", 1, None), ("empty", 1, "")]
    got = year_rows(spark.createDataFrame(rows, "doc string, page int, page_text string"), ["doc"], YEAR).collect()
    return {name: [(r.value, r.previous, r.mode) for r in got if r.doc == name and r.indicator_code == GHG] for name in PAGES}


@pytest.mark.parametrize("name", PAGES)
def test_form(found, name):
    want = PAGES[name][1]
    assert len(found[name]) == (want is not None), found[name]
    if want:
        value, previous, mode = found[name][0]
        assert (value, previous) == pytest.approx(want[:2]) and mode == want[2]

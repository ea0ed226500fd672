import pytest

from verdigris.operators.statements import collapsed_growth, implicit_balances, roe_values
from verdigris.operators.tables import statement_rates

ROE = {
    "split label": (["主要会计数据\n加权平均净资产\n收益率\n1.05% 0.93% 0.12% 1.74%\n2025 年末 2024 年末\n总资产（元） 109,629,492,714.94"], [1.05]),
    "six columns": (["主要会计数据\n加权平均净资\n产收益率-73.17% -40.71% -40.71% -32.46% -15.69% -15.69%\n2024 年末 2025 年末"], [-73.17]),
    "bare cells": (["主要会计数据和财务指标\n加权平均净资产收益率（%）-155.89 -97.80 不适用-36.50\n扣除非经常性损益后的加权平均\n净资产收益率（%）-159.21 -98.41 不适用-37.09"], [-155.89]),
    "brackets": (["主要会计数据\n加权平均净资产（亏损）/收益率（%）\n*\n(5.953) 1.270 减少 7.22 个百分点 (5.504)\n扣除非经常性损益后的加权平均净资\n产（亏损）/收益率（%）* (5.910) 1.356 减少 7.27\n个百分点 (5.346)"], [-5.953]),
    "basis in several lines": (["主要财务数据\n加权平均净资产收益率%（依\n据归属于上市公司股东的净利\n润计算）\n7.08% 7.85% - 15.73%\n加权平均净资产收益率%（依\n据归属于上市公司股东的扣除\n非经常性损益后的净利润计\n算）\n5.55% 7.71% - 15.03%"], [7.08]),
    "not applicable": (["主要会计数据\n加权平均净资产收益\n率 不适用 -114.48% 不适用 -193.36%\n2025 年末 2024 年末"], []),
    "years instead of values": (["主要会计数据\n加权平均净资产收益率 2024 年 本年比上年增减 2023 年末\n2023 年\n2025 年末 2024 年末"], []),
    "prose": (["管理层讨论\n公司加权平均净资产收益率为12.5%，同比提升。"], []),
    "after one-off items": (["扣除非经常性损益后的加权平均净资产收益率\n2.5% 3.1% 0.6% 1.9%"], []),
    "transposed over two pages": (["报告期利润 加权平均净资产收益率 每股收益", "基本每股收益（元/股） 稀释每股收益（元/股）\n归属于公司普通股股东的净 利润 6.08% 0.5414 0.5414\n扣除非经常性损益后归属于 公司普通股股东的净利润 5.93% 0.5274 0.5274"], [6.08]),
    "transposed and split": (["2、净资产收益率及每股收益\n报告期利润 加权平均净资产收益率 每股收益\n基本每股收益（元/股） 稀释每股收益（元/股）\n归属于公司普通股股东 -66.40% -0.199 -0.199 的净利润\n扣除非经常性损益后归 属于公司普通股股东的 -69.01% -0.207 -0.207 净利润"], [-66.4]),
    "transposed without the name": (["归属于公司普通股股东的净利润 6.08% 0.5414 0.5414"], []),
}


@pytest.fixture(scope="module")
def returns(spark):
    rows = [(name, i, text) for name, (texts, _) in ROE.items() for i, text in enumerate(texts, 1)] + [("null", 1, None)]
    found = roe_values(spark.createDataFrame(rows, "doc string, page int, page_text string"), ["doc"]).collect()
    return {name: [r.value for r in found if r.doc == name] for name in ROE}


@pytest.mark.parametrize("name", ROE)
def test_return_on_equity(returns, name):
    assert returns[name] == ROE[name][1]


SHEET = """Consolidated Statement of Financial Position
as at 31 December 2025
2025 2024
Current assets
Cash 10 9
22,838 26,839
Current liabilities
Payables (20,000) (21,000)
(38,414) (44,804)
Net current liabilities (15,576) (17,965)
Total assets less current liabilities 200,230 188,909
Equity
117,425 110,118
Non-current liabilities
Borrowings 50,000 49,000
82,805 78,791
Equity and non-current liabilities 200,230 188,909"""


def test_totals_without_names_must_close(spark):
    head, tail = SHEET.split("Equity\n117")
    pages = [("whole", 100, SHEET), ("broken", 100, SHEET.replace("117,425 110,118", "117,000 110,118")), ("before broken", 100, SHEET.replace("117,425 110,118", "117,425 100,118")), ("two pages", 7, head), ("two pages", 8, "Equity\n117" + tail), ("no title", 1, SHEET[45:]), ("too late", 1, "Consolidated Balance Sheet"), ("too late", 9, SHEET[45:]), ("none", 1, None)]
    found = implicit_balances(spark.createDataFrame(pages, "doc string, page int, page_text string"), ["doc"])
    got = {(r.doc, r.fact): (r.current, r.previous) for r in found.collect()}
    assert {d for d, _ in got} == {"whole", "two pages"}
    assert got["whole", "assets"] == (238_644, 233_713) and got["whole", "liabilities"] == (121_219, 123_595) and got["two pages", "equity"] == (117_425, 110_118)
    revenue = spark.createDataFrame([], "doc string, revenue double")
    rates = {(r.doc, r.indicator_code): r.value for r in statement_rates(found, revenue, ["doc"]).collect()}
    assert rates["whole", "Q_G_DEBT_ASSET_RATE"] == pytest.approx((38_414 + 82_805) / 238_644 * 100)


ROW = "Revenue 7 Cost of sales and services provided 11 Gross profit 20,364,482 (15,883,625) 23,147,916 (19,654,507) 4,480,857 3,493,409\n"


def test_a_collapsed_row_needs_its_title(spark):
    pages = [("titled", 73, "Consolidated Statement of Profit or Loss and Other Comprehensive Income\n" + ROW), ("bare", 73, ROW), ("none", 1, None)]
    found = collapsed_growth(spark.createDataFrame(pages, "doc string, page int, page_text string"), ["doc"]).collect()
    assert [(r.doc, r.page) for r in found] == [("titled", 73)] and found[0].value == pytest.approx(-12.0245554719)

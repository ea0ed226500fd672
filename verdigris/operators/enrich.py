"""Enrichment: financial and formula derivation, unit conversion, prediction and imputation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions.numeric import clip, ratio, rounded
from verdigris.functions.quantiles import quantiles, upper_medians
from verdigris.operators.scoring import confirmed
from verdigris.schemas import KEY
from verdigris.sources.shared import staged


def _c(name: str) -> Column:
    return F.col(name).cast("double")


def _mean(name: str) -> Column:
    return (_c(f"{name}_begin") + _c(f"{name}_end")) / 2


def _share(a: Column, b: Column) -> Column:
    return ratio(a, b) * 100


def _growth(name: str) -> Column:
    return _share(_c(name) - _c(f"{name}_previous"), _c(f"{name}_previous"))


# Indicators by formula over financial facts, in percent where named a rate, margin or growth.
FORMULAS = {
    "Q_S_ENV_INVEST_RATE": lambda: _share(_c("environmental_investment"), _c("revenue")),
    "Q_S_RD_RATE": lambda: _share(_c("rd_investment"), _c("revenue")),
    "Q_S_DONATION_RATE": lambda: _share(_c("public_welfare_investment"), _c("revenue")),
    "Q_S_DIVIDEND_PER_SHARE": lambda: ratio(_c("cash_dividend_total"), _c("total_shares")),
    "Q_G_ROE": lambda: _share(_c("net_profit"), _mean("equity")),
    "Q_G_ROA": lambda: _share(_c("ebit"), _mean("assets")),
    "Q_G_OPERATING_MARGIN": lambda: _share(_c("operating_profit"), _c("revenue")),
    "Q_G_EBITDA_MARGIN": lambda: _share(_c("net_profit") + _c("income_tax") + _c("interest_expense") + _c("depreciation") + _c("amortization"), _c("revenue")),
    "Q_G_CASH_REALIZATION": lambda: _share(_c("cash_received_operating"), _c("revenue")),
    "Q_G_COST_REVENUE_RATE": lambda: _share(_c("cost_expense_total"), _c("revenue")),
    "Q_G_ASSET_TURNOVER": lambda: ratio(_c("revenue"), _mean("assets")),
    "Q_G_AR_TURNOVER": lambda: ratio(_c("revenue"), _mean("accounts_receivable_gross")),
    "Q_G_CURRENT_ASSET_TURNOVER": lambda: ratio(_c("revenue"), _mean("current_assets")),
    "Q_G_TWO_FUNDS_RATE": lambda: _share(_c("accounts_receivable_end") + _c("inventory_end"), _c("current_assets_end")),
    "Q_G_DEBT_ASSET_RATE": lambda: _share(_c("liabilities_end"), _c("assets_end")),
    "Q_G_EBITDA_INTEREST": lambda: ratio(_c("ebit"), _c("interest_expense")),
    "Q_G_QUICK_RATIO": lambda: _share(_c("quick_assets_end"), _c("current_liabilities_end")),
    "Q_G_CASH_CURRENT_LIABILITY": lambda: _share(_c("operating_cashflow_net"), _c("current_liabilities_end")),
    "Q_G_REVENUE_GROWTH": lambda: _growth("revenue"),
    "Q_G_OPERATING_PROFIT_GROWTH": lambda: _growth("operating_profit"),
    "Q_G_CAPITAL_ACCUMULATION": lambda: _share(_c("equity_end") - _c("equity_begin"), _c("equity_begin")),
}
FACTS = (
    "environmental_investment rd_investment public_welfare_investment cash_dividend_total total_shares net_profit equity_begin equity_end ebit assets_begin assets_end operating_profit income_tax interest_expense "
    "depreciation amortization cash_received_operating cost_expense_total revenue accounts_receivable_gross_begin accounts_receivable_gross_end current_assets_begin current_assets_end accounts_receivable_end inventory_end "
    "liabilities_end quick_assets_end current_liabilities_end operating_cashflow_net revenue_previous operating_profit_previous"
).split()


def derive_financial(facts: DataFrame) -> DataFrame:
    """Indicators of each company and year from its facts in long form: one pivot, all formulas as columns, one unpivot.

    A formula gives a row only if all of its facts are there and its denominator is not zero.
    """
    wide = facts.groupBy("company_code", "report_year").pivot("fact_code", FACTS).agg(F.first("value"))
    made = F.array(*[F.struct(F.lit(code).alias("indicator_code"), f().alias("value")) for code, f in FORMULAS.items()])
    return wide.select("company_code", "report_year", F.inline(made)).filter(F.col("value").isNotNull())


def repeated_facts(facts: DataFrame) -> DataFrame:
    return facts.groupBy("company_code", "report_year", "fact_code").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


# Indicators as one indicator over another, with the bounds of the result: totals over revenue, amounts over
# employees, profits over revenue and assets.
FORMULA_RULES = [
    ("Q_E_ENERGY_INTENSITY", "Q_E_ENERGY_TOTAL", "Q_G_REVENUE", 0.0, 100.0),
    ("Q_E_WATER_INTENSITY", "Q_E_WATER_TOTAL", "Q_G_REVENUE", 0.0, 50.0),
    ("Q_E_GHG_INTENSITY", "Q_E_GHG_TOTAL", "Q_G_REVENUE", 0.0, 100.0),
    ("Q_E_SO2_INTENSITY", "Q_E_SO2_TOTAL", "Q_G_REVENUE", 0.0, 10.0),
    ("Q_E_NOX_INTENSITY", "Q_E_NOX_TOTAL", "Q_G_REVENUE", 0.0, 10.0),
    ("Q_E_SOLID_WASTE_INTENSITY", "Q_E_SOLID_WASTE_TOTAL", "Q_G_REVENUE", 0.0, 50.0),
    ("Q_E_HAZ_WASTE_INTENSITY", "Q_E_HAZ_WASTE_TOTAL", "Q_G_REVENUE", 0.0, 5.0),
    ("Q_E_WASTEWATER_INTENSITY", "Q_E_WASTEWATER_TOTAL", "Q_G_REVENUE", 0.0, 50.0),
    ("Q_E_PM_INTENSITY", "Q_E_PM_TOTAL", "Q_G_REVENUE", 0.0, 10.0),
    ("Q_S_PAY_PER_EMPLOYEE", "Q_S_PAY_TOTAL", "Q_S_EMPLOYEE_COUNT", 1.0, 500.0),
    ("Q_S_BENEFIT_PER_EMPLOYEE", "Q_S_BENEFIT_TOTAL", "Q_S_EMPLOYEE_COUNT", 0.5, 100.0),
    ("Q_S_EDU_PER_EMPLOYEE", "Q_S_EDU_TOTAL", "Q_S_EMPLOYEE_COUNT", 0.01, 10.0),
    ("Q_G_OPERATING_MARGIN", "Q_G_OPERATING_PROFIT", "Q_G_REVENUE", -1.0, 1.0),
    ("Q_G_ROA", "Q_G_NET_PROFIT", "Q_G_TOTAL_ASSETS", -0.5, 0.5),
]
# End of fixed values.


def derive_formulas(obs: DataFrame, rules: list[tuple[str, str, str, float, float]] = FORMULA_RULES) -> DataFrame:
    """Each rule (target, numerator, denominator, low, high) for each company and year: value, confidence, reason.

    Reasons, the first that applies: missing_sources, low_confidence, non_positive_denominator, out_of_range, derived.
    Companies whose target is confirmed already get no row.
    """
    codes = sorted({c for rule in rules for c in rule[:3]})
    cell = lambda c, x: F.col(f"`{c}`")[x]
    wide = obs.filter(confirmed()).groupBy("company_code", "report_year").pivot("indicator_code", codes).agg(F.max(F.struct("value", "confidence")))
    rows = []
    for target, top, bottom, low, high in rules:
        value = ratio(cell(top, "value"), cell(bottom, "value"))
        sure = F.least(cell(top, "confidence"), cell(bottom, "confidence"))
        reason = (
            F.when(F.col(f"`{target}`").isNotNull(), "already_confirmed").when(F.col(f"`{top}`").isNull() | F.col(f"`{bottom}`").isNull(), "missing_sources").when(sure < 0.5, "low_confidence")
            .when(cell(bottom, "value") <= 0, "non_positive_denominator").when((value < low) | (value > high), "out_of_range").otherwise("derived")
        )
        rows.append(F.struct(F.lit(target).alias("indicator_code"), reason.alias("reason"), value.alias("value"), (sure * 0.9).alias("confidence")))
    out = wide.select("company_code", "report_year", F.inline(F.array(*rows))).filter("reason <> 'already_confirmed'")
    done = F.col("reason") == "derived"
    return out.select("company_code", "report_year", "indicator_code", "reason", rounded(F.when(done, F.col("value")), 6).alias("value"), rounded(F.when(done, F.col("confidence")), 6).alias("confidence"))


def convert_units(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Values in the indicator's own unit: exact match on (indicator_code, unit), then range check."""
    joined = df.join(F.broadcast(rules), ["indicator_code", "unit"], "left")  # a rules table of fixed size
    value = F.col("value") * F.col("factor")
    state = F.when(F.col("factor").isNull(), "unknown_unit").when((value < F.col("low")) | (value > F.col("high")), "out_of_range").otherwise("converted")
    return joined.withColumns({"state": state, "converted": F.when(F.col("factor").isNotNull(), value)}).drop("factor", "low", "high")


def intensity(total_kg: Column, revenue: Column, grams: Column) -> Column:
    """Per 10,000 of revenue, in kg, or in grams where asked for."""
    return ratio(total_kg * F.when(grams, 1000.0).otherwise(1.0) * 10000, revenue)


def reduction(previous: Column, current: Column) -> Column:
    """Fall against the year before in percent, null outside -1000..100."""
    value = ratio(previous - current, previous) * 100
    return F.when(value.between(-1000, 100), value)


METHODS = ("linear_trend", "moving_average", "yoy_growth", "last_value")


def series(obs: DataFrame, target_year: int) -> DataFrame:
    """Per company and indicator: sorted (year, value) of confirmed rows before the target year; later rows win a year."""
    known = obs.filter(confirmed() & (F.col("report_year") < target_year))
    by_year = known.groupBy("company_code", "indicator_code", "report_year").agg(F.max_by("value", "_ord").alias("value"))
    # an array holds one entry for each year of a company's indicator
    return by_year.groupBy("company_code", "indicator_code").agg(F.sort_array(F.collect_list(F.struct(F.col("report_year").cast("double").alias("x"), F.col("value").alias("y")))).alias("s"))


def _sum(array: Column, f) -> Column:
    return F.aggregate(F.transform(array, f), F.lit(0.0), lambda a, v: a + v)


def predict(obs: DataFrame, target_year: int, max_cv: float = 0.5) -> DataFrame:
    """method, value, confidence and state of each series; Columns over small arrays, no Python.

    Method: monotonic series take the linear trend, then by variation moving average, growth, or the last value;
    fewer than two points, or a variation above max_cv, are rejected.
    """
    s = F.col("s")
    n = F.size(s).cast("double")
    df = series(obs, target_year).withColumns({"n": n, "my": _sum(s, lambda p: p["y"]) / n, "mx": _sum(s, lambda p: p["x"]) / n, "last": F.element_at(s, -1)})
    df = df.withColumns({
        "sxy": _sum(s, lambda p: (p["x"] - F.col("mx")) * (p["y"] - F.col("my"))), "sxx": _sum(s, lambda p: (p["x"] - F.col("mx")) * (p["x"] - F.col("mx"))), "syy": _sum(s, lambda p: (p["y"] - F.col("my")) * (p["y"] - F.col("my"))),
        "steps": F.when(F.col("n") > 1, F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s)), lambda a, b: F.struct(a["y"].alias("a"), b["y"].alias("b")))),
    })
    rates = F.transform(F.filter("steps", lambda p: p["a"] != 0), lambda p: (p["b"] - p["a"]) / F.abs(p["a"]))
    df = df.withColumns({
        "sd": F.when(F.col("n") > 1, F.sqrt(F.col("syy") / (F.col("n") - 1))).otherwise(0.0), "up": F.forall("steps", lambda p: p["b"] >= p["a"]), "down": F.forall("steps", lambda p: p["b"] <= p["a"]), "rates": rates,
        "gap": F.lit(float(target_year)) - F.col("last.x"), "weights": F.transform(s, lambda p, i: F.pow(F.lit(2.0), i)),
    })
    m = F.size("rates").cast("double")
    df = df.withColumns({"cv": F.when(F.col("my") != 0, F.abs(F.col("sd") / F.col("my"))), "g": _sum(F.col("rates"), lambda r: r) / F.nullif(m, F.lit(0.0))})
    df = df.withColumn("gsd", F.when(m > 1, F.sqrt(_sum(F.col("rates"), lambda r: (r - F.col("g")) * (r - F.col("g"))) / (m - 1))))
    slope = F.col("sxy") / F.nullif("sxx", F.lit(0.0))
    r2 = F.when(F.col("syy") > 0, 1 - (F.col("syy") - F.col("sxy") * F.col("sxy") / F.nullif("sxx", F.lit(0.0))) / F.nullif("syy", F.lit(0.0))).otherwise(0.0)
    method = F.when(F.col("up") | F.col("down"), METHODS[0]).when(F.col("cv") < 0.2, METHODS[1]).when(F.col("cv") < max_cv, METHODS[2]).otherwise(METHODS[3])
    state = F.when(F.col("n") < 2, "too_few_points").when(F.col("cv").isNull() | (F.col("cv") > max_cv), "too_variable").otherwise("predicted")
    df = df.withColumns({"method": method, "state": state})
    average = F.aggregate(F.zip_with("s", "weights", lambda p, w: p["y"] * w), F.lit(0.0), lambda a, v: a + v) / (F.pow(F.lit(2.0), F.col("n")) - 1)
    value = (
        F.when(F.col("method") == METHODS[0], F.col("my") + slope * (target_year - F.col("mx"))).when(F.col("method") == METHODS[1], average)
        .when((F.col("method") == METHODS[2]) & F.col("g").isNotNull(), F.col("last.y") * F.pow(1 + F.col("g"), F.col("gap"))).otherwise(F.col("last.y"))
    )
    spread = F.when((F.col("g") != 0) & F.col("gsd").isNotNull(), clip(1 - F.col("gsd") / F.abs("g") / 2, 0.3, 0.8)).otherwise(0.3)
    sure = (
        F.when(F.col("method") == METHODS[0], clip(r2 * (1 - 0.1 * F.col("gap")), 0.3, 0.9)).when(F.col("method") == METHODS[1], clip(1 - F.col("cv"), 0.4, 0.9))
        .when(F.col("method") == METHODS[2], spread).otherwise(0.4)
    )
    good = F.col("state") == "predicted"
    return df.select("company_code", "indicator_code", F.lit(target_year).alias("report_year"), F.col("n").cast("int").alias("points"), "state", F.when(good, F.col("method")).alias("method"), rounded(F.when(good, value), 6).alias("value"), rounded(F.when(good, sure), 6).alias("confidence"))


def industry_benchmarks(obs: DataFrame, industries: DataFrame, least: int = 10) -> DataFrame:
    """Per industry and indicator over all years' confirmed rows: count, mean, median, sample deviation, range, confidence."""
    group = ["industry", "indicator_code"]
    known = staged(obs.filter(confirmed()).join(industries, "company_code").select(*group, "value"), "industry-values")
    medians = quantiles(known, group, "value", [0.5]).select(*group, F.col("q")[0].alias("median"))
    out = known.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd"), F.min("value").alias("low"), F.max("value").alias("high"),
    ).filter(F.col("n") >= least).join(medians, group)
    variation = F.when(F.col("mean") != 0, clip(1 - F.abs(F.col("sd") / F.col("mean")) / 2, 0.3, 1.0)).otherwise(0.3)
    return out.withColumn("confidence", F.least(F.lit(1.0), F.col("n") / 30) * variation * 0.7)


def impute(obs: DataFrame, industries: DataFrame, year: int, allowed: list[str], barred: list[str], least: int = 10) -> DataFrame:
    """Median of the industry for each missing (company of the year, allowed indicator)."""
    marks = industry_benchmarks(obs, industries, least)
    current = obs.filter(F.col("report_year") == year)
    codes = [c for c in allowed if c not in barred]
    grid = current.select("company_code").distinct().withColumn("indicator_code", F.explode(F.array(*map(F.lit, codes))))
    have = current.filter(confirmed()).select("company_code", "indicator_code").distinct()
    gaps = grid.join(have, ["company_code", "indicator_code"], "left_anti").join(industries, "company_code")
    # industries x indicators: fixed lists
    return gaps.join(F.broadcast(marks), ["industry", "indicator_code"]).select("company_code", F.lit(year).alias("report_year"), "indicator_code", "industry", F.col("median").alias("value"), rounded(F.col("confidence"), 6).alias("confidence"), F.col("n").alias("sample_count"))


def upper_median(obs: DataFrame, group: list[str], least: int = 3, most: float = 1e10) -> DataFrame:
    """Variant: the upper of the two middle values, over values in 0..most."""
    known = staged(obs.filter(confirmed() & F.col("value").between(0, most)).select(*group, "value"), "median-values")
    return upper_medians(known, group, "value").filter(F.col("n") >= least)


def prefer(extracted: DataFrame, derived: DataFrame) -> DataFrame:
    """Extracted rows, and derived ones for keys that they lack."""
    return extracted.unionByName(derived.join(extracted.select(*KEY), KEY, "left_anti"), allowMissingColumns=True)

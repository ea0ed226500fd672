"""Rarer layouts of statements: returns on equity from summary and transposed tables, balance sheets without the names of
their totals, and revenue rows that a page has run together. What is not certain from the page itself gives nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.functions.text import number
from verdigris.operators.tables import line_text

# Labels, cells and titles.

ROE = "加权平均净资产收益率"
ROE_LABEL = r"加\s*权\s*平\s*均\s*净\s*资\s*产\s*(?:[（(]\s*亏\s*损\s*[）)]\s*[/／]\s*)?收\s*益\s*率\s*(?:[（(]\s*%\s*[）)]|%)?\s*(?:[（(][^（）()]{0,60}?计\s*算\s*[）)]\s*)?"
N = r"[\d,]+(?:\.\d+)?"
ROE_CELL = rf"\([+-]?{N}\)\s*%?|[+-]?{N}\s*%|[+-]?{N}(?![\d.,])(?!\s?年)|不适用|\*|—|--|-"
TRANSPOSED = (
    rf"归\s*属\s*于\s*公\s*司\s*普\s*通\s*股\s*股\s*东\s*的\s*净\s*利\s*润\s*([+-]?{N})\s*%",
    rf"归\s*属\s*于\s*公\s*司\s*普\s*通\s*股\s*股\s*东\s*(?:的\s*净\s*)?([+-]?{N})\s*%\s+[+-]?[\d.]+\s+[+-]?[\d.]+\s+(?:的\s*)?(?:净\s*)?利\s*润",
)
BALANCE_TITLE = r"(?mi)^\s*(?:[^\n]{0,40}?\s+)?(?:consolidated\s+)?statement\s+of\s+financial\s+position(?:\s|$)|^\s*consolidated\s+balance\s+sheet\s*$"
BALANCE_END = r"(?mi)^\s*(?:[^\n]{0,40}?\s+)?(?:consolidated\s+)?statement\s+of\s+(?:profit|income|changes|cash\s+flows?)|^\s*consolidated\s+(?:income|profit)\s+statement\s*$"
#: A section's total stands in the line before the next section's heading.
BEFORE = {"current_assets": "Current liabilities", "current_liabilities": "Net current (?:assets|liabilities)", "equity": "Non-current liabilities", "other_liabilities": "Equity and non-current liabilities"}
NET_LABEL = r"Total assets less current liabilities"
COLLAPSED_TITLE = r"(?is)Consolidated\s+Statement\s+of\s+Profit\s+or\s+Loss\s+and\s+Other\s+Comprehensive\s+Income"
COLLAPSED = rf"(?i)Revenue\s+\d+\s+Cost\s+of\s+sales\s+and\s+services\s+provided\s+\d+\s+Gross\s+profit\s+({N})\s+\({N}\)\s+({N})\s+\({N}\)\s+{N}\s+{N}"

# End of fixed values.

PAGES, IDENTITY = 6, 0.001


def _signed(raw: Column) -> Column:
    """An amount; brackets make it negative."""
    x = number(F.regexp_replace(raw, r"[()%\s]", ""))
    return F.when(raw.startswith("("), -x).otherwise(x)


def _first(values: Column) -> Column:
    return F.get(F.filter(values, lambda v: v["value"].isNotNull()), F.lit(0))


def _summary(text: Column) -> Column:
    """The return on equity of a summary row: its first cell, for the current year. Cells of a label that says % need no sign."""
    pattern = rf"(?s)(.{{0,30}}?)({ROE_LABEL})((?:\s*(?:{ROE_CELL})){{1,6}})"

    def value(m: Column) -> Column:
        before, label = F.regexp_replace(F.regexp_extract(m, pattern, 1), r"\s+", ""), F.regexp_extract(m, pattern, 2)
        cells = F.transform(F.regexp_extract_all(F.regexp_extract(m, pattern, 3), F.lit(ROE_CELL), F.lit(0)), lambda c: F.trim(c))
        cell = F.get(F.filter(cells, lambda c: c != "*"), F.lit(0))
        bare = ~cell.startswith("(") & ~cell.endswith("%")
        found = F.when(cell.startswith("("), -F.abs(_signed(cell))).when(~bare, _signed(cell)).when(label.contains("%") & (F.abs(_signed(cell)) < 1000), _signed(cell))
        sound = ~before.contains("扣除") & (cells[0] != "不适用") & cell.rlike(r"\d") & found.between(-1000, 1000)
        return F.struct(F.when(sound, found).alias("value"), F.lit("summary").alias("form"), F.trim(F.regexp_replace(F.concat(label, F.lit(" "), F.array_join(cells, " ")), r"\s+", " ")).alias("evidence"))

    return _first(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), value))


def _transposed(text: Column) -> Column:
    """The return on equity of a table with rows of profits; rows after one-off items do not count."""
    def rows(row: str) -> Column:
        pattern = rf"(?s)(.{{0,30}}?)({row})"

        def value(m: Column) -> Column:
            before, found = F.regexp_replace(F.regexp_extract(m, pattern, 1), r"\s+", ""), number(F.regexp_extract(m, pattern, 3))
            return F.struct(F.when(~before.contains("扣除非经常") & found.between(-1000, 1000), found).alias("value"), F.lit("transposed").alias("form"), F.trim(F.regexp_replace(F.regexp_extract(m, pattern, 2), r"\s+", " ")).alias("evidence"))

        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), value)

    return _first(F.concat(*[rows(row) for row in TRANSPOSED]))


def roe_values(pages: DataFrame, keep: list[str]) -> DataFrame:
    """keep, page, indicator_code, value, form, evidence: weighted returns on equity of summary and transposed tables.

    A transposed table counts where its page or the one before names the indicator.
    """
    own = Window.partitionBy(*keep).orderBy("page")
    near = pages.select(*keep, "page", line_text(F.col("page_text")).alias("_x")).withColumn("_before", F.lag("_x", 1, "").over(own))
    named = F.concat(F.coalesce("_before", F.lit("")), F.col("_x")).contains(ROE)
    found = near.select(*keep, "page", F.array(F.when(named, _transposed(F.col("_x"))), _summary(F.col("_x"))).alias("_f"))
    rows = found.select(*keep, "page", F.explode(F.array_compact("_f")).alias("f")).select(*keep, "page", F.lit("Q_G_ROE").alias("indicator_code"), "f.value", "f.form", "f.evidence")
    return rows.dropDuplicates([*keep, "page", "value"])


def implicit_balances(pages: DataFrame, keep: list[str]) -> DataFrame:
    """keep, fact, page, current, previous: a balance sheet's totals that have no names, told by what follows them.

    All five must be there, and in both years assets must be equity and liabilities within a thousandth; else there is nothing.
    """
    amount = r"(\(?[\d,]+(?:\.\d+)?\)?)"
    title = F.when(F.col("page_text").rlike(BALANCE_TITLE), F.struct(F.lit(True).alias("on"), F.col("page").alias("first"))).when(F.col("page_text").rlike(BALANCE_END), F.struct(F.lit(False).alias("on"), F.col("page").alias("first")))
    own = Window.partitionBy(*keep).orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    inside = pages.select(*keep, "page", "page_text").withColumn("_t", F.last(title, ignorenulls=True).over(own)).filter(F.col("_t.on") & (F.col("page") - F.col("_t.first") < PAGES))
    text = line_text(F.col("page_text"))

    def pair(pattern: str) -> Column:
        both = F.struct(_signed(F.regexp_extract("_x", pattern, 1)).alias("current"), _signed(F.regexp_extract("_x", pattern, 2)).alias("previous"), F.col("page").alias("page"))
        return F.when(F.col("_x").rlike(pattern), both)

    facts = {name: pair(rf"(?mi)^\s*{amount}\s+{amount}\s*$\n\s*{heading}\b") for name, heading in BEFORE.items()}
    facts["net"] = pair(rf"(?mi)^\s*{NET_LABEL}\s+{amount}\s+{amount}\s*$")
    first = inside.select(*keep, "page", text.alias("_x")).select(*keep, "page", *[p.alias(n) for n, p in facts.items()]).groupBy(*keep).agg(*[F.min_by(n, F.when(F.col(n).isNotNull(), F.col("page"))).alias(n) for n in facts])
    whole = first.filter(" AND ".join(f"{n} IS NOT NULL" for n in facts))
    sides = {}
    for year in ("current", "previous"):
        debt = F.abs(F.col(f"current_liabilities.{year}"))
        assets, liabilities, equity = F.col(f"net.{year}") + debt, debt + F.abs(F.col(f"other_liabilities.{year}")), F.col(f"equity.{year}")
        sides[year] = {"assets": assets, "liabilities": liabilities, "current_assets": F.col(f"current_assets.{year}"), "current_liabilities": debt, "equity": equity}
        whole = whole.filter((assets > 0) & (equity > 0) & (F.abs(assets - equity - liabilities) / assets <= IDENTITY))
    last = F.greatest(*[F.col(f"{n}.page") for n in facts])
    rows = F.array(*[F.struct(F.lit(name).alias("fact"), last.alias("page"), sides["current"][name].alias("current"), sides["previous"][name].alias("previous")) for name in sides["current"]])
    return whole.select(*keep, F.inline(rows))


def collapsed_growth(pages: DataFrame, keep: list[str]) -> DataFrame:
    """keep, page, indicator_code, value: growth of revenue from an income statement whose columns a page has run together."""
    text = F.regexp_replace(line_text(F.col("page_text")), r"\s+", " ")
    rows = pages.filter(F.col("page_text").rlike(COLLAPSED_TITLE)).select(*keep, "page", text.alias("_x")).select(*keep, "page", *[number(F.nullif(F.regexp_extract("_x", COLLAPSED, i), F.lit(""))).alias(n) for i, n in ((1, "now"), (2, "before"))])
    growth = (F.col("now") - F.col("before")) / F.col("before") * 100
    first = rows.filter("now >= 0 AND before > 0").groupBy(*keep).agg(F.min_by(F.struct("page", growth.alias("value")), "page").alias("r"))
    return first.select(*keep, "r.page", F.lit("Q_G_REVENUE_GROWTH").alias("indicator_code"), "r.value").filter(F.col("value").between(-100, 1000))

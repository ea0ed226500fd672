"""Exact quantiles of groups of any size: distributed selection by histograms of order-preserving bits.

A double's 64 bits, with those of negative numbers turned over, sort like the number. Each pass counts, by group, the
values under every next DIGIT bits of the prefix that holds a wanted rank, and keeps the one digit in which the rank
lies; values outside of it are not looked at again. A task's histogram has at most 2^DIGIT rows for a group and rank, and
equal values are counted before any shuffle, so neither many values nor one very common one meet in a task. Passes end
as soon as every wanted digit holds one value only; that takes 64 / DIGIT of them at most, two or three as a rule.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGIT, WIDTH = 16, 64
LARGEST = (1 << 63) - 1


def sorting_bits(value: Column) -> Column:
    """A double as a long that sorts like it; null stays null."""
    bits = F.when(value.isNotNull(), F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value)).cast("long")
    return F.when(bits < 0, bits.bitwiseXOR(F.lit(LARGEST))).otherwise(bits)


def _equal(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Equality of keys, null ones too."""
    found = F.lit(True)
    for k in keys:
        found &= left[k].eqNullSafe(right[k])
    return found


def _histogram(values: DataFrame, keys: list[str], digit: Column) -> DataFrame:
    """keys, _digit, _before and _to (ranks within the keys, from 0), _n (values of the keys), low and high of each digit."""
    counted = values.groupBy(*keys, digit.alias("_digit")).agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("low"), F.max("_v").alias("high"))
    own = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    to = F.sum("_c").over(own.orderBy("_digit").rowsBetween(Window.unboundedPreceding, 0))
    return counted.withColumns({"_to": to, "_n": F.sum("_c").over(own)}).withColumn("_before", F.col("_to") - F.col("_c")).drop("_c")


def order_statistics(values: DataFrame, by: list[str], value: str, wanted: Callable[[Column], Column]) -> DataFrame:
    """by, n, rank, value: the values at some ranks (from 0, in rising order) of each group.

    `wanted` makes an array of ranks out of a group's number of values. values is read once a pass: stage it if it is
    dear to make. Null values are left out; null keys are a group.
    """
    x = values.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v")).withColumn("_bits", sorting_bits(F.col("_v")))
    first = _histogram(x, by, F.shiftright("_bits", WIDTH - DIGIT))
    here = F.filter(wanted(F.col("_n")), lambda r: (r >= F.col("_before")) & (r < F.col("_to")))
    found = first.withColumn("rank", F.explode(here)).select(*by, F.col("_n").alias("n"), "rank", (F.col("rank") - F.col("_before")).alias("_rest"), F.col("_digit").alias("_prefix"), "low", "high")
    for known in range(DIGIT, WIDTH, DIGIT):
        found = found.persist()  # a row for each group and rank, made again from the pass before if an executor is lost
        unsettled = found.filter("low < high")
        if unsettled.isEmpty():
            break
        at = unsettled.select(*by, "_prefix").distinct()
        prefixed = x.withColumn("_prefix", F.shiftright("_bits", WIDTH - known))
        inside = prefixed.join(at, _equal(prefixed, at, [*by, "_prefix"]), "left_semi")
        digits = _histogram(inside, [*by, "_prefix"], F.shiftrightunsigned("_bits", WIDTH - DIGIT - known).bitwiseAND(F.lit((1 << DIGIT) - 1))).drop("_n")
        open_ = unsettled.select(*by, "n", "rank", "_rest", "_prefix")
        met = open_.join(digits, _equal(open_, digits, [*by, "_prefix"]) & (open_["_rest"] >= digits["_before"]) & (open_["_rest"] < digits["_to"]))
        narrowed = met.select(*[open_[c] for c in (*by, "n", "rank")], (F.col("_rest") - F.col("_before")).alias("_rest"), (F.shiftleft(open_["_prefix"], DIGIT) + F.col("_digit")).alias("_prefix"), "low", "high")
        found = found.filter("NOT low < high").unionByName(narrowed)
    return found.select(*by, "n", "rank", F.col("low").alias("value"))


def _values_at(values: DataFrame, by: list[str], value: str, wanted: Callable[[Column], Column]) -> DataFrame:
    """by, n, and _at: a map from each wanted rank to its value."""
    ranks = order_statistics(values, by, value, wanted)
    return ranks.groupBy(*by, "n").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("_at"))  # an entry for each wanted rank


def quantiles(values: DataFrame, by: list[str], value: str, probabilities: list[float]) -> DataFrame:
    """by, n and q: the quantiles of each group, interpolated between neighbouring values."""
    places = lambda n: [(n - 1) * F.lit(float(p)) for p in probabilities]
    wanted = lambda n: F.array_distinct(F.array(*[f(x).cast("long") for x in places(n) for f in (F.floor, F.ceil)]))
    at = _values_at(values, by, value, wanted)

    def between(x: Column) -> Column:
        low, high = (F.element_at("_at", f(x).cast("long")) for f in (F.floor, F.ceil))
        return F.when(F.floor(x) == F.ceil(x), low).otherwise((F.ceil(x) - x) * low + (x - F.floor(x)) * high)

    return at.select(*by, "n", F.array(*[between(x) for x in places(F.col("n"))]).alias("q"))


def upper_medians(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, n and the upper of the two middle values (the middle one of an odd number)."""
    middle = lambda n: F.floor(n / 2).cast("long")
    at = _values_at(values, by, value, lambda n: F.array(middle(n)))
    return at.select(*by, "n", F.element_at("_at", middle(F.col("n"))).alias("upper_median"))

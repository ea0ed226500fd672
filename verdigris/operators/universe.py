"""Company universe: eligibility, dual listings, registries, migrations, audits and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXCHANGE_ORDER = ("SSE", "SZSE", "BSE", "HKEX")
SUFFIXES = {"SSE": ".SH", "SZSE": ".SZ", "BSE": ".BJ", "HKEX": ".HK"}
LEGAL_SUFFIX = r"(股份有限公司|有限责任公司|有限公司|集团|\b(co|corp|inc|ltd|limited|plc|group|holdings?)\b\.?)"


def normal_name(name: Column) -> Column:
    """Lower case without legal suffixes, punctuation and spaces."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), LEGAL_SUFFIX, ""), r"[\s\p{P}#]+", "")


def normal_code(code: Column, exchange: Column) -> Column:
    """Digits padded to six (five for HKEX) with the exchange's suffix."""
    digits = F.regexp_extract(F.upper(code), r"(\d+)", 1)
    out = F.lit(None).cast("string")
    for name, suffix in SUFFIXES.items():
        out = F.when(exchange == name, F.concat(F.lpad(digits, 5 if name == "HKEX" else 6, "0"), F.lit(suffix))).otherwise(out)
    return F.when(digits != "", out)


def exchange_of(code: Column) -> Column:
    out = F.lit("UNKNOWN")
    for name, suffix in SUFFIXES.items():
        out = F.when(F.upper(code).endswith(suffix), name).otherwise(out)
    return out


def truth(x: Column) -> Column:
    """Boolean synonyms."""
    return F.lower(F.trim(x)).isin("1", "true", "yes", "y", "是")


def exclusion_reason(industries: tuple[str, ...]) -> Column:
    """Null for eligible rows, else the first reason: listing status, special treatment, flag, industry."""
    return (
        F.when(F.col("listing_status") != "listed", "not_listed").when((F.col("st_status") == "ST") | F.col("company_name").startswith("ST"), "special_treatment")
        .when(~F.col("energy_eligible"), "flagged_ineligible").when(F.col("energy_eligible"), F.lit(None)).when(~F.col("industry").isin(*industries), "industry_not_covered")
    )


def build_universe(snapshot: DataFrame, industries: tuple[str, ...]) -> DataFrame:
    """Each row included or excluded with a reason; among eligible rows of one entity the first exchange's listing stays."""
    reason = exclusion_reason(industries)
    order = F.array_position(F.array(*map(F.lit, EXCHANGE_ORDER)), F.col("exchange"))
    rows = snapshot.withColumn("_reason", reason)
    # the entity's primary listing by an aggregate joined back: an entity with very many rows is not sorted in one task
    primary = rows.filter("_reason IS NULL").groupBy("entity_id").agg(F.min(F.struct(order.alias("o"), F.col("stock_code").alias("stock_code"))).alias("p")).select("entity_id", F.col("p.stock_code").alias("_primary"))
    joined = rows.join(primary, "entity_id", "left")
    twin = F.col("_reason").isNull() & (F.col("_primary") != F.col("stock_code"))
    full = F.when(twin, F.concat(F.lit("same entity listed again, keeps "), F.col("_primary"))).otherwise(F.col("_reason"))
    return joined.withColumns({"exclusion_reason": full, "included": full.isNull()}).drop("_reason", "_primary")


def universe_audit(universe: DataFrame) -> DataFrame:
    """One row: rows, included, entities, per-exchange counts and issues."""
    blank = lambda c: F.count_if(F.coalesce(F.trim(c), F.lit("")) == "")
    issues = F.count_if(F.col("included") & (F.coalesce(F.trim("sub_industry"), F.lit("")) == ""))
    return universe.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("included").alias("included"), F.count_distinct(F.when(F.col("included"), F.col("entity_id"))).alias("entities"),
        *[F.count_if(F.col("included") & (F.col("exchange") == e)).alias(e.lower()) for e in EXCHANGE_ORDER], issues.alias("unclassified"), blank("company_name").alias("unnamed"),
        (issues == 0).alias("publishable"),
    )


def snapshot_quality(snapshot: DataFrame) -> DataFrame:
    code = F.col("stock_code")
    return snapshot.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.coalesce(code, F.lit("")) == "").alias("missing_codes"), F.count_if(~code.rlike(r"^\d{5,6}\.(SH|SZ|BJ|HK)$")).alias("invalid_codes"),
        (F.count(code) - F.count_distinct(code)).alias("repeated_codes"), F.count_if(F.col("entity_id").isNull()).alias("missing_entities"),
    )


def reconcile(registry: DataFrame, universe: DataFrame) -> DataFrame:
    """Registry rows matched by code, else by normalised name: matched, name_differs, ambiguous or unmatched."""
    u = universe.select(F.col("stock_code").alias("u_code"), normal_name(F.col("company_name")).alias("u_name"))
    by_name = u.groupBy("u_name").agg(F.count(F.lit(1)).alias("same_name"), F.min("u_code").alias("name_code"))
    r = registry.withColumn("r_name", normal_name(F.col("company_name")))
    both = r.join(u, r.stock_code == u.u_code, "left").join(by_name.withColumnRenamed("u_name", "n_name"), F.col("r_name") == F.col("n_name"), "left")
    status = (
        F.when(F.col("u_code").isNotNull() & (F.col("u_name") == F.col("r_name")), "matched_code").when(F.col("u_code").isNotNull(), "name_differs")
        .when(F.col("same_name") == 1, "matched_name").when(F.col("same_name") > 1, "ambiguous").otherwise("unmatched")
    )
    return both.select(F.col("stock_code"), "company_name", status.alias("status"), F.coalesce("u_code", F.when(F.col("same_name") == 1, F.col("name_code"))).alias("matched_code"))


def migrate(history: DataFrame, aliases: DataFrame, universe: DataFrame) -> DataFrame:
    """Historical rows with their current code (through an alias map) and whether the universe still holds it; repeated aliases and codes count once."""
    a = aliases.select(F.col("old_code").alias("stock_code"), "new_code").distinct()
    moved = history.join(a, "stock_code", "left").withColumn("current_code", F.coalesce("new_code", "stock_code"))
    held = universe.select(F.col("stock_code").alias("current_code"), F.lit(True).alias("held")).distinct()
    return moved.join(held, "current_code", "left").select("stock_code", "current_code", F.when(F.col("held") & F.col("new_code").isNotNull(), "moved").when(F.col("held"), "kept").otherwise("gone").alias("state"))


def bind_provenance(universe: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Universe rows, each once, with the snapshot's source where theirs is blank: matched, name_difference, entity_conflict, unmatched.

    Of several snapshot rows of a code those that agree best count, and of these the first source; a missing entity agrees with any.
    The rows meet by equal keys only, so a code that very many rows share makes no pairs.
    """
    s = snapshot.select("stock_code", F.col("entity_id").alias("_e"), normal_name(F.col("company_name")).alias("_n"), F.col("company_name").isNotNull().alias("_named"), F.col("source_url").alias("_url"))
    nobody = F.col("_e").isNull()

    def seen(rows: DataFrame, name: str, *by: str) -> DataFrame:
        url, free_url = F.min("_url").alias("url"), F.min(F.when(nobody, F.col("_url"))).alias("free_url")
        return rows.groupBy("stock_code", *by).agg(F.struct(url, F.bool_or(nobody).alias("free"), free_url).alias(name))

    def found(exact: str, wide: str) -> tuple[Column, Column]:
        anyone = F.col("_e").isNull()
        hit = F.col(exact).isNotNull() | F.col(f"{wide}.free") | (anyone & F.col(wide).isNotNull())
        return hit, F.when(anyone, F.col(f"{wide}.url")).otherwise(F.least(f"{exact}.url", f"{wide}.free_url"))

    named = s.filter("_named")
    both = universe.select("stock_code", F.col("entity_id").alias("_e"), normal_name(F.col("company_name")).alias("_n"), "source_url")
    for name, *by in (("_both", "_e", "_n"), ("_name", "_n"), ("_entity", "_e"), ("_code",)):
        both = both.join(seen(named, name, *by), ["stock_code", *by], "left")
    both = both.join(seen(s.filter("NOT _named"), "_nameless"), "stock_code", "left")
    (matched, url), (same_entity, entity_url) = found("_both", "_name"), found("_entity", "_code")
    status = F.when(F.col("_code").isNull(), "unmatched").when(matched, "matched").when(same_entity, "name_difference").otherwise("entity_conflict")
    s_url = F.when(F.col("_code").isNull(), F.col("_nameless.url")).when(matched, url).when(same_entity, entity_url).otherwise(F.col("_code.url"))
    return both.select("stock_code", status.alias("status"), F.coalesce(F.nullif(F.trim("source_url"), F.lit("")), s_url).alias("source_url"))


def merge_snapshots(snapshots: list[DataFrame], code: str = "stock_code") -> tuple[DataFrame, DataFrame]:
    """(all rows, faults): snapshots put together, and the codes that occur more than once, with how often.

    The merge stands only if there is no fault; which of two rows of a code is right is not for the merge to say.
    """
    rows = snapshots[0]
    for s in snapshots[1:]:
        rows = rows.unionByName(s, allowMissingColumns=True)
    faults = rows.groupBy(code).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return rows, faults


def key_differences(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """key with `side`: missing (only left), unknown (only right) or shared; null keys are keys, too."""
    sides = left.select(*key, F.lit(1).alias("_s")).unionByName(right.select(*key, F.lit(2).alias("_s"))).groupBy(*key).agg(F.bit_or("_s").alias("_s"))
    return sides.select(*key, F.when(F.col("_s") == 1, "missing").when(F.col("_s") == 2, "unknown").otherwise("shared").alias("side"))


def augment(universe: DataFrame, additions: DataFrame) -> DataFrame:
    """The universe with the additions whose codes it lacks; equal rows stay once."""
    return universe.unionByName(additions.join(universe.select("stock_code"), "stock_code", "left_anti"), allowMissingColumns=True).distinct()


def pair_rows(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Value and score lines that follow each other, joined: odd lines carry values, the next line their scores."""
    w = Window.partitionBy(group).orderBy(order)
    numbered = rows.withColumns({"_i": F.row_number().over(w), "score": F.lead(value).over(w)})
    return numbered.filter("_i % 2 = 1").drop("_i")


def industry_from_name(name: Column, rules: list[tuple[str, str]], otherwise: str = "other") -> Column:
    """The first rule (pattern, industry) that the name matches."""
    out = F.lit(otherwise)
    for pattern, industry in reversed(rules):
        out = F.when(name.rlike(pattern), industry).otherwise(out)
    return out

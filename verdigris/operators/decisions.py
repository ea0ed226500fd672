"""Candidate resolution under a versioned policy, reviews, signatures, batches and ledgers."""

from __future__ import annotations

from functools import reduce

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.functions.numeric import plain_number, rounded
from verdigris.operators.seals import merkle_leaves, merkle_roots
from verdigris.schemas import KEY


@dataclass(frozen=True)
class Policy:
    """Which candidates may confirm themselves. Prefixes map an indicator to what its evidence must begin with."""

    version: str = "public-disclosure-v6"
    annual_codes: tuple[str, ...] = ()
    esg_codes: tuple[str, ...] = ()
    strict_prefixes: dict[str, str] = field(default_factory=dict)
    tolerances: dict[str, float] = field(default_factory=dict)
    derived_prefix: str = "合并报表自动派生:"
    annual_confidence: float = 0.9
    esg_confidence: float = 0.82


def _by_code(table: dict, otherwise) -> Column:
    out = F.lit(otherwise)
    for code, value in table.items():
        out = F.when(F.col("indicator_code") == code, F.lit(value)).otherwise(out)
    return out


def eligible(policy: Policy) -> Column:
    esg_file = F.col("source_file").contains("esg")
    prefix = _by_code(policy.strict_prefixes, None)
    strict = prefix.isNotNull() & F.col("evidence_text").startswith(prefix) & (F.col("confidence") >= policy.annual_confidence)
    annual = F.col("indicator_code").isin(*policy.annual_codes) & ~esg_file & (F.col("confidence") >= policy.annual_confidence)
    esg = F.col("indicator_code").isin(*policy.esg_codes) & esg_file & (F.col("confidence") >= policy.esg_confidence)
    return F.coalesce(annual | esg | strict, F.lit(False))


def best_key() -> Column:
    """The order in which the best candidate comes first."""
    return F.struct((-F.col("confidence")).alias("c"), F.coalesce("source_page", F.lit(1_000_000_000)).alias("p"), F.col("source_file").alias("f"), F.col("evidence_text").alias("e"))


def resolve(candidates: DataFrame, policy: Policy) -> DataFrame:
    """One decision per (company, year, indicator): auto_confirmed with the selected candidate, or unresolved, and why.

    One aggregation: counts, distinct values, range of the eligible ones and the best of them; groups may be of any size.
    """
    ok, value = F.col("ok"), F.round("value", 8)
    rows = candidates.withColumn("ok", eligible(policy))
    derived = ok & F.coalesce(F.col("evidence_text").startswith(policy.derived_prefix), F.lit(False))
    pick = lambda cond: F.min_by(F.struct("value", "source_file", "source_page", "evidence_text"), F.when(cond, best_key()))
    groups = rows.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("candidate_count"), F.sort_array(F.collect_set(value)).alias("values"), F.count_if(ok).alias("eligible_count"),
        F.max(F.when(ok, value)).alias("high"), F.min(F.when(ok, value)).alias("low"), F.max("confidence").alias("max_confidence"),
        pick(ok).alias("best"), F.count_if(derived).alias("n_derived"), pick(derived).alias("best_derived"),
    )
    tolerance = _by_code(policy.tolerances, 0.0)
    consistent = (F.col("eligible_count") > 0) & (F.col("high") - F.col("low") <= tolerance + 1e-12)
    chosen = F.when(F.col("n_derived") > 0, F.col("best_derived")).otherwise(F.col("best"))
    strict = F.col("indicator_code").isin(*policy.strict_prefixes) if policy.strict_prefixes else F.lit(False)
    reason = (
        F.when(F.col("eligible_count") == 0, "indicator_not_auto_eligible").when(~consistent, "conflicting_or_ineligible_sources")
        .when(F.col("indicator_code").isin(*policy.esg_codes), "official_esg_direct_consistent").when(strict, "strict_extraction_evidence_consistent")
        .when(F.col("n_derived") > 0, "consolidated_statement_year_end_derived").otherwise("official_annual_direct_consistent")
    )
    return groups.select(
        *KEY, F.when(consistent, "auto_confirmed").otherwise("unresolved").alias("decision"), "candidate_count", F.array_join(F.transform("values", lambda v: plain_number(v, 8)), "|").alias("distinct_values"), F.size("values").alias("n_values"),
        F.when(consistent, chosen["value"]).alias("selected_value"), F.when(consistent, chosen["evidence_text"]).alias("selected_evidence"), F.lit(policy.version).alias("policy_version"), reason.alias("reason"), "max_confidence",
    )


TIER_ORDER = ("manual_signature_required", "consistent_multi_review", "single_candidate_review", "auto_policy_eligible")


def review_tiers(decisions: DataFrame) -> DataFrame:
    tier = F.when(F.col("n_values") > 1, TIER_ORDER[0]).when(F.col("decision") == "auto_confirmed", TIER_ORDER[3]).when(F.col("candidate_count") > 1, TIER_ORDER[1]).otherwise(TIER_ORDER[2])
    order = F.array_position(F.array(*map(F.lit, TIER_ORDER)), tier)
    return decisions.select(*KEY, tier.alias("tier"), order.cast("int").alias("tier_order"), "candidate_count", "distinct_values")


def audit_resolution(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Keys on one side only, and keys whose candidate count differs: empty where the decisions close over the groups."""
    groups = candidates.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    both = groups.join(decisions.select(*KEY, "candidate_count"), KEY, "full_outer")
    fault = F.when(F.col("n").isNull(), "unknown_key").when(F.col("candidate_count").isNull(), "missing_decision").when(F.col("n") != F.col("candidate_count"), "count_differs")
    return both.select(*KEY, fault.alias("fault")).filter(F.col("fault").isNotNull())


def apply_review(candidates: DataFrame, instructions: DataFrame) -> DataFrame:
    """Each instruction with its outcome: confirmed (with the best candidate of the selected value), rejected, or a fault."""
    picked = (
        instructions.join(candidates, KEY, "left").withColumn("fits", F.abs(F.col("value") - F.col("selected_value")) < 1e-8)
        .groupBy(*KEY, "action", "selected_value").agg(F.min_by("evidence_text", F.when(F.col("fits"), best_key())).alias("evidence_text"), F.count_if(F.col("fits")).alias("fitting"), F.count("value").alias("n"))
    )
    outcome = F.when(F.col("n") == 0, "unknown_key").when(F.col("action") == "reject", F.when(F.col("selected_value").isNull(), "rejected").otherwise("reject_with_value")).when(F.col("fitting") > 0, "confirmed").otherwise("value_not_among_candidates")
    return picked.select(*KEY, "action", "selected_value", outcome.alias("outcome"), "evidence_text")


SCORES = (0, 20, 50, 80, 100)


#: Fixed value: words of the evidence that a score of 100 needs.
LEADING = r"(?i)领先|标杆|leading|benchmark"


def signature_faults(df: DataFrame, reviewer: str = "reviewer", at: str = "reviewed_at", note: str = "note", least_note: int = 8) -> DataFrame:
    """df with `faults`: codes of what a signature lacks. Times must carry an offset."""
    zoned = F.col(at).rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$") & F.try_to_timestamp(F.col(at)).isNotNull()
    checks = [
        (F.trim(F.coalesce(reviewer, F.lit(""))).isin("", "reviewer", "todo", "tbd"), "reviewer_missing"), (~F.coalesce(zoned, F.lit(False)), "time_not_zoned"),
        (F.length(F.trim(F.coalesce(note, F.lit("")))) < least_note, "note_too_short"),
    ]
    if "score" in df.columns:
        checks.append((~F.coalesce(F.col("score").isin(*SCORES), F.lit(True)), "score_not_allowed"))
        checks.append((F.coalesce(F.col("score") == 100, F.lit(False)) & ~F.coalesce(F.col(note).rlike(LEADING), F.lit(False)), "leading_evidence_missing"))
    return df.withColumn("faults", F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in checks])), "|"))


def needs_second_review() -> Column:
    confirm, score, hint = F.col("action") == "confirm", F.col("score"), F.col("suggested_score")
    return (confirm & score.isin(80, 100)) | (confirm & (score != hint)) | ((F.col("action") == "reject") & (hint >= 80))


def dual_review(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Per first decision: not_needed, open, agreed, arbitration or same_reviewer, and the final score of settled ones."""
    s = second.select(key, F.col("action").alias("second_action"), F.col("score").alias("second_score"), F.col("reviewer").alias("second_reviewer"))
    both = first.withColumn("needed", needs_second_review()).join(s, key, "left")
    agreed = (F.col("action") == F.col("second_action")) & ((F.col("action") != "confirm") | F.col("score").eqNullSafe(F.col("second_score")))
    state = F.when(~F.col("needed"), "not_needed").when(F.col("second_action").isNull(), "open").when(F.lower("reviewer") == F.lower("second_reviewer"), "same_reviewer").when(agreed, "agreed").otherwise("arbitration")
    return both.withColumn("state", state).withColumn("final_score", F.when(F.col("state").isin("not_needed", "agreed") & (F.col("action") == "confirm"), F.col("score")))


def arbitrate(cases: DataFrame, rulings: DataFrame, key: str) -> DataFrame:
    """Arbitration cases with their ruling; the arbiter must be neither reviewer."""
    r = rulings.select(key, F.col("score").alias("ruled_score"), F.col("reviewer").alias("arbiter"))
    both = cases.filter("state = 'arbitration'").join(r, key, "left")
    state = F.when(F.col("arbiter").isNull(), "open").when(F.lower("arbiter").isin(F.lower("reviewer"), F.lower("second_reviewer")), "arbiter_not_independent").otherwise("settled")
    return both.withColumn("arbitration_state", state).withColumn("final_score", F.when(F.col("arbitration_state") == "settled", F.col("ruled_score")))


def batch_ledger(items: DataFrame, batch: str, key: str, decided: Column) -> DataFrame:
    """Per batch: size, Merkle digest of its keys, decided count, completion rate and status."""
    keys = items.select(batch, F.sha2(F.col(key), 256).alias("_digest"))
    roots = merkle_roots(merkle_leaves(keys, [batch], "_digest"), [batch]).select(batch, F.col("root").alias("keys_sha256"))
    out = items.groupBy(batch).agg(F.count(F.lit(1)).alias("group_count"), F.count_if(decided).alias("decided_count")).join(roots, batch)
    return out.withColumns({"completion_rate": rounded(F.col("decided_count") / F.col("group_count"), 6), "status": F.when(F.col("decided_count") == F.col("group_count"), "closed").otherwise("open")})


def qualitative_features(df: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """Feature flags by pattern, a suggested score (80, 50 or 20) by how many hold, and an evidence class."""
    df = df.withColumns({f"has_{n}": F.col(text).rlike(p) for n, p in patterns.items()})
    n = sum((F.col(f"has_{k}").cast("int") for k in patterns), F.lit(0))
    return df.withColumns({"suggested_score": F.when(n >= 3, 80).when(n >= 1, 50).otherwise(20), "evidence_quality": F.when(n >= 3, "strong").when(n >= 1, "partial").otherwise("weak")})


# Merges.


def merge_conflicts(obs: DataFrame) -> DataFrame:
    """Keys that several files give with different values, and rows that are not confirmed: both are errors of a merge."""
    values = obs.groupBy(*KEY).agg(F.count_distinct("value").alias("n"), F.count_if(F.col("status") != "confirmed").alias("open"))
    return values.filter("n > 1 OR open > 0").select(*KEY, F.when(F.col("open") > 0, "not_confirmed").otherwise("conflicting_values").alias("fault"))


def merge_first(obs: DataFrame, order: str) -> DataFrame:
    """One row per key, the first by order."""
    rest = [c for c in obs.columns if c not in KEY]
    return obs.groupBy(*KEY).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*KEY, "r.*").select(*obs.columns)


def merge_by_priority(sources: list[tuple[DataFrame, float]]) -> DataFrame:
    """Sources by falling priority, each with its confidence: the first that has a key wins. One shuffle on the key."""
    out = None
    for i, (df, confidence) in enumerate(sources):
        part = df.select(*KEY, "value", F.lit(i).alias("priority"), F.lit(confidence).alias("confidence"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(*KEY).agg(F.min_by(F.struct("value", "priority", "confidence"), F.struct("priority", "value")).alias("r")).select(*KEY, "r.*")


# Hosts of exchanges, marks of their files, marks of issuers' own sites, and aggregators.
EXCHANGE_HOSTS = ("sse.com.cn", "szse.cn", "cninfo.com.cn", "hkexnews.hk", "hkex.com.hk", "bse.cn")
EXCHANGE_PATHS = ("ci_collection/", "hkex_reports/", "/sse/", "/szse/", "/bse/")
ISSUER_MARKS = ("issuer_official_website", "issuer_site", "official_website", "company website", "官网", "投资者关系")
AGGREGATORS = ("eastmoney.com", "sina.com", "qq.com", "baidu.com", "choice", "wind")


def holds(x: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(x, F.lit(w)) for w in words])


def source_tier(url: Column, path: Column, evidence: Column | None = None) -> Column:
    """0 exchange, 1 issuer website, 2 other; nulls hold no mark."""
    url, path = F.lower(F.coalesce(url, F.lit(""))), F.lower(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")))
    said = F.lower(F.coalesce(evidence, F.lit(""))) if evidence is not None else F.lit("")
    raw = path.startswith("data/raw/") & path.contains("/20") & ~holds(path, ("issuer", "official_website", "issuer_site"))
    exchange = holds(url, EXCHANGE_HOSTS) | holds(path, EXCHANGE_PATHS) | raw
    issuer = holds(path, ISSUER_MARKS) | holds(said, ISSUER_MARKS) | (url.startswith("https://") & ~holds(url, AGGREGATORS))
    return F.when(exchange, 0).when(issuer, 1).otherwise(2)


def authority(row: Column) -> Column:
    """struct that is smaller the better a source is: tier, English, derived, not from the scheduled collection, confidence."""
    url, path, said = F.lower(F.coalesce(row["source_url"], F.lit(""))), F.lower(F.replace(F.coalesce(row["source_file"], F.lit("")), F.lit("\\"), F.lit("/"))), F.coalesce(row["evidence_text"], F.lit(""))
    english = F.lower(said).contains("english") | said.contains("英文") | url.contains("/en/") | path.contains("english")
    derived = said.contains("派生") | F.lower(said).contains("derived")
    return F.struct(
        source_tier(row["source_url"], row["source_file"], row["evidence_text"]).alias("tier"), english.cast("int").alias("english"), derived.cast("int").alias("derived"),
        (~path.contains("ci_collection")).cast("int").alias("other"), (-F.coalesce(row["confidence"], F.lit(0.0))).alias("confidence"),
    )


def authority_overlay(base: DataFrame, refresh: DataFrame) -> DataFrame:
    """Full outer merge on the key: add, same, replace (the refresh has the better authority) or keep (ties keep the base)."""
    columns = ["value", "source_url", "source_file", "evidence_text", "confidence"]
    pack = lambda df, n: df.select(*KEY, F.struct(*columns).alias(n))
    both = pack(base, "b").join(pack(refresh, "r"), KEY, "full_outer")
    same = F.abs(F.col("b.value") - F.col("r.value")) < 1e-9
    action = F.when(F.col("b").isNull(), "add").when(F.col("r").isNull(), "keep").when(same, "same").when(authority(F.col("r")) < authority(F.col("b")), "replace").otherwise("keep")
    winner = F.when(action.isin("add", "replace"), F.col("r")).otherwise(F.col("b"))
    return both.select(*KEY, action.alias("action"), winner.alias("w")).select(*KEY, "action", "w.value", authority(F.col("w"))["tier"].alias("tier"))


def accept_key_candidates(base: DataFrame, candidates: DataFrame, indicators: DataFrame) -> DataFrame:
    """Candidates of key indicators from exchanges, taken without a confirmation: keep, added, replaced or same, for every key of either.

    Of several candidates of a key the surest counts (of equal ones the first by source). It replaces a stored value unless
    that has the better authority; an equal value keeps its row.
    """
    columns = ["value", "source_url", "source_file", "evidence_text", "confidence"]
    keys = indicators.filter("key_indicator AND kind = 'quantitative'").select(F.col("code").alias("indicator_code"))
    fit = candidates.filter(F.col("value").isNotNull()).join(F.broadcast(keys), "indicator_code", "left_semi").filter(source_tier(F.col("source_url"), F.col("source_file"), F.col("evidence_text")) == 0)
    best = fit.groupBy(*KEY).agg(F.max_by(F.struct(*columns), F.struct(F.coalesce("confidence", F.lit(0.0)), "source_url", "source_file", -F.col("value"))).alias("r"))
    both = base.select(*KEY, F.struct(*columns).alias("b")).join(best, KEY, "full_outer")
    action = F.when(F.col("r").isNull(), "keep").when(F.col("b").isNull(), "added").when(F.col("b.value") == F.col("r.value"), "same").when(authority(F.col("r")) <= authority(F.col("b")), "replaced").otherwise("keep")
    winner = F.when(action.isin("added", "replaced"), F.col("r")).otherwise(F.col("b"))
    return both.select(*KEY, action.alias("action"), winner["value"].alias("value"), F.when(action == "replaced", F.col("b.value")).alias("prior_value"))


def ledger_state(ledger: DataFrame, key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """(active rows, forks) of an append-only ledger whose rows name the decision that they supersede.

    Each row must supersede its key's previous one; active is the last row of a key unless it revokes.
    """
    w = Window.partitionBy(key).orderBy(order)
    chained = ledger.withColumns({"_before": F.lag("decision_id").over(w), "_after": F.lead("decision_id").over(w)})
    forks = chained.filter(~F.col("supersedes").eqNullSafe(F.col("_before"))).select(key, "decision_id", "supersedes", F.col("_before").alias("expected"))
    return chained.filter(F.col("_after").isNull() & (F.col("operation") == "upsert")).drop("_before", "_after"), forks

"""The service surface as plain functions over tables: what a web layer would call, returning DataFrames or rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.operators import analysis, coverage, decisions, governance, scoring
from verdigris.schemas import KEY
from verdigris.sources import sinks


class Service:
    """Observation revisions with their methodology; every method reads the latest revision of each key."""

    def __init__(self, spark: SparkSession, indicators: DataFrame, revisions: DataFrame, candidates: DataFrame | None = None):
        self.spark, self.indicators, self.revisions, self.candidates = spark, indicators, revisions, candidates

    def health(self) -> dict:
        return {"status": "ok", "revisions": self.revisions.count(), "indicators": self.indicators.count()}

    def methodology(self) -> DataFrame:
        return self.indicators

    def alignment(self) -> DataFrame:
        return governance.alignment(self.indicators)

    def add_observations(self, rows: DataFrame) -> DataFrame:
        """Append rows as new revisions; the result is the whole history."""
        self.revisions = sinks.upsert_revisions(self.revisions, rows)
        return self.revisions

    def observations(self, year: int | None = None) -> DataFrame:
        latest = sinks.latest_revisions(self.revisions)
        return latest if year is None else latest.filter(F.col("report_year") == year)

    def rankings(self, year: int, strategy: str = "indicator_neutral_v1", top: int = 0) -> DataFrame:
        ranked = scoring.ranking(self.observations(year), self.indicators, (strategy,)).orderBy(F.desc("total_score"), "company_code")
        return ranked.limit(top) if top > 0 else ranked

    def company_score(self, code: str, year: int, strategy: str = "indicator_neutral_v1") -> DataFrame:
        """The indicator details of one company; statistics come from the whole population."""
        return scoring.score_details(self.observations(year), self.indicators, strategy).filter(F.col("company_code") == code)

    def sensitivity(self, year: int) -> DataFrame:
        return analysis.sensitivity(scoring.ranking(self.observations(year), self.indicators))

    def progress(self, year: int) -> DataFrame:
        obs = self.observations(year)
        return coverage.company_completion(coverage.indicator_tasks(obs.select("company_code").distinct(), self.indicators, obs))

    def review_conflicts(self, policy: decisions.Policy) -> DataFrame:
        return decisions.resolve(self.candidates, policy).filter("decision = 'unresolved'")

    def review_tiers(self, policy: decisions.Policy) -> DataFrame:
        return decisions.review_tiers(decisions.resolve(self.candidates, policy))

    def resolution_audit(self, policy: decisions.Policy) -> DataFrame:
        return decisions.audit_resolution(self.candidates, decisions.resolve(self.candidates, policy))

    def review_template(self, policy: decisions.Policy, limit: int = 100) -> DataFrame:
        """The first unresolved keys with empty fields for a signature."""
        open_ = self.review_conflicts(policy).orderBy(F.desc("candidate_count"), *KEY).limit(limit)
        return open_.select(*KEY, "candidate_count", "distinct_values", "reason", *[F.lit("").alias(c) for c in ("action", "selected_value", "reviewer", "reviewed_at", "note")])

"""Commands over files: python -m verdigris COMMAND --in name=path ... --out path [--set key=value ...].

Inputs are Parquet folders or CSV files with headers; results are written as Parquet, or as CSV where the path ends in .csv.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.operators import analysis, coverage, decisions, enrich, gaps, governance, graph, rules, scoring, seals, statements, tables, text, totals, universe
from verdigris.schemas import INDICATOR, OBSERVATION, methodology
from verdigris.sources import announcements, listings, readers, sinks, workbooks


class Inputs:
    """Named tables and options of a command."""

    def __init__(self, spark: SparkSession, paths: dict[str, str], options: dict[str, str]):
        self.spark, self.paths, self.options = spark, paths, options

    def __getitem__(self, name: str) -> DataFrame:
        path = self.paths[name]
        if name == "methodology":
            return methodology(self.spark, path)[0] if path.endswith(".json") else readers.typed(readers.read_csv(self.spark, path, ["code", "weight"]), INDICATOR)
        if name in ("observations", "candidates") and path.endswith(".csv"):
            return readers.typed(readers.read_csv(self.spark, path, ["company_code", "indicator_code", "value"]), OBSERVATION).withColumn("_ord", F.monotonically_increasing_id())
        if path.endswith(".csv"):
            return readers.read_csv(self.spark, path, [])
        if path.endswith(".xlsx"):
            return workbooks.workbook_table(workbooks.read_workbooks(self.spark, path))
        if path.endswith(".txt"):
            return readers.read_page_texts(self.spark, path)
        return self.spark.read.parquet(path)

    def text(self, key: str, default: str = "") -> str:
        return self.options.get(key, default)

    def number(self, key: str, default: int) -> int:
        return int(self.options.get(key, default))

    def list(self, key: str) -> list[str]:
        return [x for x in self.options.get(key, "").split(",") if x]

    def year(self, name: str = "observations") -> DataFrame:
        return self[name].filter(F.col("report_year") == self.number("year", 2025))

    def policy(self) -> decisions.Policy:
        return decisions.Policy(annual_codes=tuple(self.list("annual")), esg_codes=tuple(self.list("esg")))


COMMANDS: dict[str, Callable[[Inputs], DataFrame]] = {
    "score": lambda i: scoring.ranking(i.year(), i["methodology"], (i.text("strategy", "indicator_neutral_v1"),), i["universe"] if "universe" in i.paths else None, i.number("minimum", 20)),
    "score-details": lambda i: scoring.score_details(i.year(), i["methodology"], i.text("strategy", "indicator_neutral_v1")),
    "population-baseline": lambda i: scoring.population_baseline(i.year(), i["methodology"], i.number("minimum", 20)),
    "sensitivity": lambda i: analysis.sensitivity(scoring.ranking(i.year(), i["methodology"])),
    "sensitivity-pairs": lambda i: analysis.strategy_pairs(scoring.ranking(i.year(), i["methodology"]), i.number("top", 200)),
    "tier-summary": lambda i: analysis.tier_summary(i.year()),
    "compare-tiers": lambda i: analysis.tier_compare(i.year(), i["methodology"]),
    "yoy": lambda i: analysis.yoy_stability(analysis.yoy_changes(i["observations"], i.number("year", 2025))),
    "anomalies": lambda i: analysis.anomaly_types(analysis.yoy_changes(i["observations"], i.number("year", 2025))),
    "resolve-pending": lambda i: decisions.resolve(i["candidates"], i.policy()),
    "plan-review-tiers": lambda i: decisions.review_tiers(decisions.resolve(i["candidates"], i.policy())),
    "audit-resolution-preview": lambda i: decisions.audit_resolution(i["candidates"], i["decisions"]),
    "apply-review": lambda i: decisions.apply_review(i["candidates"], i["instructions"].withColumns({"report_year": F.col("report_year").cast("int"), "selected_value": F.col("selected_value").try_cast("double")})),
    "merge-confirmed-observations": lambda i: decisions.merge_first(i["observations"], "_ord"),
    "merge-conflicts": lambda i: decisions.merge_conflicts(i["observations"]),
    "derive-financial": lambda i: enrich.derive_financial(i["facts"]),
    "derive-formulas": lambda i: enrich.derive_formulas(i["observations"]),
    "predict": lambda i: enrich.predict(i["observations"], i.number("year", 2025)),
    "industry-benchmarks": lambda i: enrich.industry_benchmarks(i["observations"], i["industries"]),
    "impute": lambda i: enrich.impute(i["observations"], i["industries"], i.number("year", 2025), i.list("allowed"), i.list("barred")),
    "build-universe": lambda i: universe.build_universe(i["snapshot"].withColumn("energy_eligible", universe.truth(F.col("energy_eligible"))), tuple(i.list("industries"))),
    "universe-audit": lambda i: universe.universe_audit(i["universe"]),
    "snapshot-quality": lambda i: universe.snapshot_quality(i["snapshot"]),
    "reconcile-registry": lambda i: universe.reconcile(i["registry"], i["universe"]),
    "plan-universe-migration": lambda i: universe.migrate(i["history"], i["aliases"], i["universe"]),
    "bind-universe-provenance": lambda i: universe.bind_provenance(i["universe"], i["snapshot"]),
    "augment-universe": lambda i: universe.augment(i["universe"], i["additions"]),
    "quality": lambda i: coverage.quality_issues(i["observations"], i["universe"].select(F.col("stock_code").alias("company_code")), i["methodology"]),
    "plan-indicators": lambda i: coverage.indicator_tasks(i["companies"], i["methodology"], i.year()),
    "plan-candidate-coverage": lambda i: coverage.candidate_coverage(coverage.indicator_tasks(i["companies"], i["methodology"], i.year()), i["candidates"]),
    "audit-document-coverage": lambda i: coverage.document_coverage(i["companies"], i["documents"], ("annual_report", "esg_report")),
    "plan-collection": lambda i: coverage.collection_plan(i["companies"], i["documents"], i.number("year", 2025), ("annual_report", "esg_report")),
    "merge-document-indexes": lambda i: governance.merge_indexes(i["documents"], "source_url"),
    "supersede-documents": lambda i: governance.supersede(i["documents"], i["requests"])[0],
    "audit-dlt-alignment": lambda i: governance.alignment(i["methodology"]),
    "apply-governance-benchmarks": lambda i: governance.inject_benchmarks(i["methodology"], i["benchmarks"].withColumn("benchmark", F.col("benchmark").try_cast("double"))),
    "build-evidence-graph": lambda i: graph.nodes(i["candidates"]),
    "build-evidence-edges": lambda i: graph.edges(i["candidates"]),
    "evidence-constraints": lambda i: graph.constraints(i["candidates"], i["methodology"]),
    "plan-incremental-recompute": lambda i: graph.recompute_plan(i["candidates"], i["changed"]),
    "prepare-quantitative-validation": lambda i: coverage.stratified_sample(i["candidates"], "indicator_code", ["company_code", "report_year", "indicator_code"], i.number("per_stratum", 20)),
    "extract-text": lambda i: rules.rule_candidates(i["pages"], ["file"]),
    "extract-statements": lambda i: text.statement_identity(text.statement_facts(i["pages"], ["file"]), ["file"]),
    "extract-statement-facts": lambda i: tables.statement_facts(i["pages"], ["file"]),
    "derive-statement-rates": lambda i: tables.statement_rates(tables.statement_facts(i["pages"], ["file"]), tables.summary_revenue(i["pages"], ["file"]), ["file"]),
    "extract-year-tables": lambda i: tables.year_rows(i["pages"], ["file"], i.number("year", 2025)),
    "extract-english-year-tables": lambda i: tables.year_rows(i["pages"], ["file"], i.number("year", 2025), tables.ENGLISH_ROWS),
    "extract-cards": lambda i: tables.card_values(i["pages"], ["file"]),
    "extract-summary-revenue": lambda i: tables.summary_revenue(i["pages"], ["file"]),
    "derive-investment-rates": lambda i: tables.investment_rates(i["pages"], tables.summary_revenue(i["pages"], ["file"]), ["file"], i.number("year", 2025)),
    "derive-payments-per-head": lambda i: tables.payments_per_head(i["pages"], ["file"]),
    "diagnose-gaps": lambda i: gaps.gap_diagnosis(i["tasks"], i["documents"], ["company_code"], "source_file" if "source_file" in i["documents"].columns else None),
    "audit-resolution-closure": lambda i: seals.preview_faults(i["candidates"], i["decisions"], i["confirmed"], i["unresolved"], i.policy()),
    "select-manual-review": lambda i: seals.manual_candidates(i["candidates"], i["tiers"])[0],
    "prepare-review-packets": lambda i: seals.prepare(i["items"], i.text("key", "id"), i.number("size", 50)),
    "evaluate-review-packets": lambda i: seals.evaluate(i["packets"], i["decisions"], i.text("key", "id")),
    "apply-review-packets": lambda i: seals.apply_decisions(i["packets"], seals.evaluate(i["packets"], i["decisions"], i.text("key", "id")), i.text("key", "id")),
    "review-packet-states": lambda i: seals.packet_states(i["packets"], seals.evaluate(i["packets"], i["decisions"], i.text("key", "id")), i.text("key", "id")),
    "extract-totals": lambda i: totals.page_totals(i["pages"], ["file"], i.number("year", 2025)),
    "derive-total-intensities": lambda i: totals.derived_intensities(totals.page_totals(i["pages"], ["company_code", "file"], i.number("year", 2025)), i["revenue"], totals.stated_intensities(i["pages"], ["company_code"]), ["company_code"]),
    "extract-returns": lambda i: statements.roe_values(i["pages"], ["file"]),
    "extract-implicit-balances": lambda i: statements.implicit_balances(i["pages"], ["file"]),
    "extract-collapsed-revenue": lambda i: statements.collapsed_growth(i["pages"], ["file"]),
    "import-historical": lambda i: workbooks.historical_evaluations(workbooks.read_workbooks(i.spark, i.paths["workbook"]))[1],
    "historical-faults": lambda i: workbooks.historical_evaluations(workbooks.read_workbooks(i.spark, i.paths["workbook"]))[2],
    "parse-listings": lambda i: listings.listing_rows(listings.listing_pages(i["pages"], "payload", "page", []), i.text("exchange", "SSE"), []),
    "accept-key-candidates": lambda i: decisions.accept_key_candidates(i["observations"], i["candidates"], i["methodology"]),
    "parse-sse-announcements": lambda i: announcements.parse_announcements(i["answers"], "payload", "SSE", []),
    "parse-szse-announcements": lambda i: announcements.parse_announcements(i["answers"], "payload", "SZSE", []),
    "parse-bse-announcements": lambda i: announcements.parse_announcements(i["answers"], "payload", "BSE", []),
    "parse-cninfo-announcements": lambda i: announcements.parse_announcements(i["answers"], "payload", "CNINFO", []),
    "parse-hkex-announcements": lambda i: announcements.parse_title_search(i["answers"], "payload", []),
    "select-reports": lambda i: announcements.reports(i["announcements"], i.number("year", 2025)),
    "compare-keys": lambda i: universe.key_differences(i["left"], i["right"], ["stock_code"]),
    "extract-reference-codes": lambda i: readers.listed_codes(i["pages"], "page_text", ["file", "page"]),
    "page-links": lambda i: text.links(i["html"], "html", ["page_id"]),
}


def pairs(values: list[str]) -> dict[str, str]:
    return dict(v.split("=", 1) for v in values)


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="verdigris", description=__doc__)
    parser.add_argument("command", choices=sorted(COMMANDS))
    parser.add_argument("--in", dest="inputs", action="append", default=[], metavar="NAME=PATH")
    parser.add_argument("--set", dest="options", action="append", default=[], metavar="KEY=VALUE")
    parser.add_argument("--out", required=True)
    got = parser.parse_args(args)
    spark = SparkSession.builder.appName(f"verdigris {got.command}").getOrCreate()
    result = COMMANDS[got.command](Inputs(spark, pairs(got.inputs), pairs(got.options)))
    if got.out.endswith(".csv"):
        sinks.write_csv(result, got.out)
    else:
        result.write.mode("overwrite").parquet(got.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())

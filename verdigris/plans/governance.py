"""Queries of methodology checks, documents, continuity and disclosure over the star schema, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdigris.functions.numeric import rounded
from verdigris.operators import decisions, scoring
from verdigris.operators import governance as ops
from verdigris.plans import decisions as dplan
from verdigris.plans import scoring as splan
from verdigris.plans.binding import CANDIDATES, IND, OBS, YEAR, candidates, indicators, observations, sql_round, sql_with, table
from verdigris.sources.shared import staged

QUERIES, ORACLE_SQL = {}, {}


def query(name, sql=None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


@query("weight_alignment", sql_with(IND, f"SELECT kind, dimension, {sql_round('sum(weight)', 4)} AS weight, count(*) AS indicators, CASE dimension WHEN 'E' THEN 45.0 WHEN 'S' THEN 20.0 ELSE 35.0 END::DOUBLE AS wanted, abs({sql_round('sum(weight)', 4)} - CASE dimension WHEN 'E' THEN 45.0 WHEN 'S' THEN 20.0 ELSE 35.0 END) <= 0.01 AS aligned FROM ind WHERE indicator_code IN (SELECT p_brand FROM part) GROUP BY 1, 2"))
def weight_alignment(spark, d):
    return ops.alignment(indicators(spark).join(table(spark, d, "part").select(F.col("p_brand").alias("code")).distinct(), "code", "left_semi"))


INTAKE = "SELECT 'Brand#1' AS indicator_code, 30.0D AS benchmark, 'positive' AS direction, 200D / 42 AS weight UNION ALL SELECT 'Brand#2', NULL, 'negative', 300D / 42 UNION ALL SELECT 'Brand#3', 10D, 'negative', 400D / 42 UNION ALL SELECT 'Brand#5', 11D, 'positive', 1D UNION ALL SELECT 'Brand#99', 1D, 'positive', 1D UNION ALL SELECT 'Brand#4', 1D, 'bidirectional', 100D / 42 UNION ALL SELECT 'Brand#4', 2D, 'bidirectional', 100D / 42"


@query("benchmark_faults", "SELECT * "
    "FROM (VALUES ('Brand#2', 'no_value'), ('Brand#3', 'direction_differs'), ('Brand#5', 'weight_differs'), ('Brand#99', 'unknown_indicator'), ('Brand#4', 'repeated')) t(indicator_code, fault)")
def benchmark_faults(spark, d):
    return ops.benchmark_faults(indicators(spark), spark.sql(INTAKE))


@query("benchmark_injection", sql_with(IND, "SELECT indicator_code AS code, CASE indicator_code WHEN 'Brand#1' THEN 30.0 WHEN 'Brand#3' THEN 10.0 ELSE benchmark END AS benchmark FROM ind"))
def benchmark_injection(spark, d):
    return ops.inject_benchmarks(indicators(spark), spark.sql(INTAKE).filter("indicator_code IN ('Brand#1', 'Brand#2', 'Brand#3')")).select("code", "benchmark")


@query("thin_methodology_review", sql_with(OBS, IND, splan.ONE_YEAR, splan.STATS, f"""SELECT s.indicator_code, population_count AS current_population, 75 AS minimum_population_threshold, 75 - population_count AS population_deficit, coalesce(n, 0) AS diagnosed_task_count, coalesce(m, '{{}}') AS diagnostic_category_counts FROM stats s
  LEFT JOIN (SELECT indicator_code, CAST(sum(n) AS BIGINT) AS n, '{{' || string_agg('"' || status || '":' || n, ',' ORDER BY status) || '}}' AS m
  FROM (SELECT indicator_code, status, count(*) AS n
  FROM base
  WHERE status <> 'confirmed'
  GROUP BY 1, 2)
  GROUP BY 1) d USING (indicator_code)
  WHERE population_count < 75"""))
def thin_methodology_review(spark, d):
    obs = observations(spark, d, YEAR)
    gaps = obs.filter("status <> 'confirmed'").select("indicator_code", F.col("status").alias("category"))
    return ops.thin_review(scoring.population_stats(staged(obs.select("indicator_code", "value", "status"), "observations")), gaps, 75)


@query("merge_indexes", "SELECT 'u' || CAST(l_partkey AS VARCHAR) AS source_url, 's' || CAST(arg_min(l_suppkey, l_orderkey * 10000000 + l_suppkey * 100 + l_linenumber) % 3 AS VARCHAR) AS sha256, arg_min(l_quantity, l_orderkey * 10000000 + l_suppkey * 100 + l_linenumber) AS size, count(*) AS entries, count(DISTINCT l_suppkey % 3) > 1 AS conflict "
    "FROM (SELECT DISTINCT l_partkey, l_orderkey, l_suppkey, l_linenumber, l_quantity FROM lineitem) GROUP BY l_partkey "
    "HAVING count(*) = count(DISTINCT l_orderkey * 10000000 + l_suppkey * 100 + l_linenumber)")
def merge_indexes(spark, d):
    rows = table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_suppkey", "l_linenumber", "l_quantity").distinct()
    place = F.expr("l_orderkey * 10000000 + l_suppkey * 100 + l_linenumber")
    index = rows.select(F.concat(F.lit("u"), F.col("l_partkey").cast("string")).alias("source_url"), F.concat(F.lit("s"), (F.col("l_suppkey") % 3).cast("string")).alias("sha256"), F.col("l_quantity").alias("size"), place.alias("o"))
    clear = index.groupBy("source_url").agg(F.count(F.lit(1)).alias("a"), F.count_distinct("o").alias("b")).filter("a = b").select("source_url")
    return ops.merge_indexes(index.join(clear, "source_url", "left_semi"), "o")


DOCS = "docs AS (SELECT CAST(c_custkey AS VARCHAR) AS company_code, 2024 AS report_year, CASE WHEN c_nationkey % 2 = 0 THEN 'annual_report' ELSE 'esg_report' END AS document_type, 'h' || CAST(c_custkey % 50 AS VARCHAR) AS sha256 FROM customer)"


def _documents(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("company_code"), F.lit(2024).alias("report_year"), F.when(F.col("c_nationkey") % 2 == 0, "annual_report").otherwise("esg_report").alias("document_type"), F.concat(F.lit("h"), (F.col("c_custkey") % 50).cast("string")).alias("sha256"))


def _requests(spark, d):
    return _documents(spark, d).filter("CAST(company_code AS INT) % 4 = 0").withColumns({"sha256": F.when(F.col("company_code").cast("int") % 8 == 0, F.col("sha256")).otherwise("other"), "reason": F.lit("replaced")})


@query("supersede_documents", sql_with(DOCS, "SELECT CAST(company_code AS INT) % 8 = 0 AS superseded, count(*) AS n FROM docs GROUP BY 1"))
def supersede_documents(spark, d):
    stay, gone = ops.supersede(_documents(spark, d), _requests(spark, d))
    return stay.agg(F.lit(False).alias("superseded"), F.count(F.lit(1)).alias("n")).unionByName(gone.agg(F.lit(True).alias("superseded"), F.count(F.lit(1)).alias("n")))


@query("preferred_documents", "SELECT CAST(o_custkey AS VARCHAR) AS company_code, o_orderkey AS title FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey "
    "ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 ELSE 0 END, o_orderdate DESC, o_orderkey) AS i FROM orders "
    "WHERE o_orderstatus <> 'P') WHERE i = 1")
def preferred_documents(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("company_code"), F.when(F.col("o_orderstatus") == "P", "esg_report").otherwise("annual_report").alias("document_type"), F.col("o_orderkey").alias("title"), "o_orderdate", "o_orderpriority")
    preference = F.when(F.col("o_orderpriority") == "1-URGENT", 3).when(F.col("o_orderpriority") == "2-HIGH", 2).otherwise(0)
    return ops.preferred_documents(o, "annual_report", preference, "o_orderdate").select("company_code", "title")


@query("issuer_continuity", "SELECT CASE s_suppkey % 4 WHEN 0 THEN CAST(s_suppkey AS VARCHAR) ELSE 'old' || CAST(s_suppkey AS VARCHAR) END AS stock_code, CASE s_suppkey % 4 "
    "WHEN 0 THEN 'same_issuer' WHEN 1 THEN 'code_changed' WHEN 2 THEN 'listed_twice' ELSE 'gone' END AS outcome, CASE "
    "WHEN s_suppkey % 4 = 1 THEN CAST(s_suppkey AS VARCHAR) END AS current_code FROM supplier")
def issuer_continuity(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("c"), F.col("s_suppkey").alias("k"), "s_name")
    listed = s.select(F.col("c").alias("stock_code"), F.col("s_name").alias("name_key")).unionByName(s.filter("k % 4 = 2").select(F.concat(F.lit("B"), "c").alias("stock_code"), F.col("s_name").alias("name_key")))
    history = s.select(F.when(F.col("k") % 4 == 0, F.col("c")).otherwise(F.concat(F.lit("old"), "c")).alias("stock_code"), F.when(F.col("k") % 4 == 3, "none").otherwise(F.col("s_name")).alias("name_key"))
    return ops.continuity(listed, history)


@query("embedded_coverage", "SELECT CAST(s_suppkey AS VARCHAR) AS company_code, CASE WHEN s_suppkey % 3 = 0 AND s_nationkey % 5 >= 2 THEN 'embedded_in_annual' "
    "WHEN s_suppkey % 3 = 0 THEN 'missing' ELSE 'collected' END AS esg_status, s_suppkey % 3 = 0 AND s_nationkey % 5 >= 2 AS upgraded FROM supplier")
def embedded_coverage(spark, d):
    s = table(spark, d, "supplier").withColumn("company_code", F.col("s_suppkey").cast("string"))
    coverage = s.select("company_code", F.when(F.col("s_suppkey") % 3 == 0, "missing").otherwise("collected").alias("esg_status"))
    scans = s.withColumn("section", F.explode(F.sequence(F.lit(1), F.lit(4)))).select("company_code", F.when(F.col("section") <= F.col("s_nationkey") % 5, 2).otherwise(0).alias("hits"))
    return ops.embedded_coverage(coverage, scans, 2)


@query("keyword_score", f"SELECT doc_id, {sql_round('least(100.0, 50 + least(5.0 * len(regexp_extract_all(text, $$tion|heit$$)), 30.0) + least(length(text) / 100.0, 20.0))', 4)} AS score FROM documents".replace("$$", "'"))
def keyword_score(spark, d):
    return table(spark, d, "documents").select("doc_id", rounded(ops.keyword_score(F.col("text"), "tion|heit"), 4).alias("score"))


@query("evidence_methods", "SELECT CASE doc_id % 4 WHEN 0 THEN 'cross_document' WHEN 1 THEN 'formula' WHEN 2 THEN 'table' ELSE 'direct' END AS method, count(*) AS n FROM documents GROUP BY 1")
def evidence_methods(spark, d):
    words = F.element_at(F.array(*map(F.lit, ("x cross-document", "derived y", "a table row", "plain"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, d, "documents").groupBy(ops.evidence_method(words).alias("method")).agg(F.count(F.lit(1)).alias("n"))


@query("enhanced_quality", sql_with(OBS, f"q AS (SELECT indicator_code, count(*) AS n, count(*) FILTER (status = 'confirmed') AS confirmed, count(*) FILTER (status = 'derived') AS derived, count(*) FILTER (status = 'predicted') AS predicted, count(*) FILTER (status = 'imputed') AS imputed, count(*) FILTER (confidence >= 0.8) AS high_confidence, count(*) FILTER (confidence >= 0.6 AND confidence < 0.8) AS medium_confidence, count(*) FILTER (confidence < 0.6) AS low_confidence, {sql_round('avg(confidence)', 6)} AS mean_confidence FROM obs WHERE report_year = {YEAR} GROUP BY 1)", "SELECT *, CASE WHEN confirmed / n >= 0.7 THEN 'strong' WHEN confirmed / n < 0.5 THEN 'weak' ELSE 'medium' END AS strength FROM q"))
def enhanced_quality(spark, d):
    return ops.enhanced_quality(observations(spark, d, YEAR))


@query("candidate_ids", sql_with(CANDIDATES, "SELECT evidence_text, company_code || '-P' || lpad(CAST(source_page AS VARCHAR), 3, '0') || '-' || row_number() OVER (PARTITION BY company_code, source_page "
    "ORDER BY evidence_text) AS candidate_id FROM cand"))
def candidate_ids(spark, d):
    return ops.candidate_ids(candidates(spark, d), ["evidence_text"]).select("evidence_text", "candidate_id")


@query("rank_bands", sql_with(*splan.CHAIN, "pr AS (SELECT company_code, max(CASE strategy WHEN 'indicator_neutral_v1' THEN rank END) AS a, max(CASE strategy "
    "WHEN 'legacy_zero_v1' THEN rank END) AS b FROM ranked GROUP BY 1)", "SELECT company_code, a - b AS difference, CASE WHEN abs(a - b) <= 5 THEN 'same' WHEN abs(a - b) <= 20 THEN 'near' WHEN a > b THEN 'lower' "
    "ELSE 'higher' END AS band FROM pr"))
def rank_bands(spark, d):
    wide = splan.all_rankings(spark, d).groupBy("company_code").pivot("strategy", ["indicator_neutral_v1", "legacy_zero_v1"]).agg(F.first("rank"))
    return ops.rank_bands(wide, "indicator_neutral_v1", "legacy_zero_v1").select("company_code", "difference", "band")


@query("next_stage", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'collect' WHEN s_suppkey % 3 = 0 THEN 'extract' WHEN s_suppkey % 5 = 0 THEN 'review' "
    "ELSE 'finished' END AS stage, CASE WHEN s_suppkey % 2 = 0 THEN 0 WHEN s_suppkey % 3 = 0 THEN 1 WHEN s_suppkey % 5 = 0 THEN 2 ELSE 3 END AS stages_done "
    "FROM supplier")
def next_stage(spark, d):
    k = F.col("s_suppkey")
    return ops.next_stage(table(spark, d, "supplier").select("s_suppkey"), [("collect", k % 2 != 0), ("extract", k % 3 != 0), ("review", k % 5 != 0)])


@query("conflicts_by_company", sql_with(CANDIDATES, dplan.ELIGIBLE, f"SELECT company_code, count(*) FILTER (decision = 'auto_confirmed') AS settled, count(*) FILTER (decision <> 'auto_confirmed') AS open, {sql_round('count(*) FILTER (decision = $$auto_confirmed$$) / count(*)', 6)} AS settled_share FROM decisions GROUP BY 1".replace("$$", "'")))
def conflicts_by_company(spark, d):
    return ops.conflicts_by_company(decisions.resolve(candidates(spark, d), dplan.POLICY))


@query("sample_evaluation", f"SELECT event_type AS method, count(*) AS answered, count(*) FILTER (ok) AS right, {sql_round('count(*) FILTER (ok) / count(*)', 6)} AS accuracy FROM (SELECT event_type, abs(value - (value + event_id % 3 / 10.0)) <= greatest(abs(value), abs(value + event_id % 3 / 10.0), 1) * 0.01 AS ok FROM events) GROUP BY 1")
def sample_evaluation(spark, d):
    e = table(spark, d, "events")
    answers = e.select("event_id", (F.col("value") + F.col("event_id") % 3 / 10.0).alias("actual"))
    return ops.evaluate_sample(e.select("event_id", F.col("event_type").alias("method"), "value"), answers, "event_id", 0.01)


@query("release_predicates", sql_with(CANDIDATES, "SELECT count(*) FILTER (source_page = 1) AS pending_rows, count(*) FILTER (confidence >= 0.9) AS research_rows FROM cand"))
def release_predicates(spark, d):
    rows = candidates(spark, d).withColumn("suggested_score", F.lit(50))
    marked = ops.research_rows(rows.filter("confidence >= 0.9")).unionByName(rows.filter("confidence < 0.9").select(*decisions.KEY, "value", F.lit("confirmed").alias("status"), "evidence_text", "confidence"))
    first = rows.filter("source_page = 1").select(*decisions.KEY, "value", F.lit("pending").alias("status"), F.lit("x").alias("evidence_text"), "confidence")
    return ops.release_predicates(marked.unionByName(first))

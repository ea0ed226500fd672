"""Queries of coverage, priorities, the evidence graph and gates over the star schema, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdigris.operators import analysis, decisions, graph
from verdigris.operators import coverage as ops
from verdigris.plans import decisions as dplan
from verdigris.plans import scoring as splan
from verdigris.plans.binding import CANDIDATES, IND, OBS, YEAR, candidates, code, indicators, observations, sql_round, sql_with, table

QUERIES, ORACLE_SQL = {}, {}


def query(name, sql=None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


def companies(spark, d):
    return table(spark, d, "supplier").select(code("s_suppkey").alias("company_code"))


ORDER = "['confirmed', 'derived', 'predicted', 'imputed', 'pending', 'not_applicable', 'missing']"
TASKS = f"""comp AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS company_code FROM supplier),
task AS (SELECT c.company_code, i.indicator_code, i.dimension, i.key_indicator, coalesce(o.status, 'missing') AS status, o.confidence, CASE coalesce(o.status, 'missing') WHEN 'confirmed' THEN 'done' WHEN 'pending' THEN 'review' WHEN 'derived' THEN 'verify' WHEN 'not_applicable' THEN 'none' ELSE 'collect' END AS next_action
  FROM comp c CROSS JOIN ind i LEFT JOIN (SELECT * FROM obs WHERE report_year = {YEAR}) o ON o.company_code = c.company_code AND o.indicator_code = i.indicator_code)"""


def tasks(spark, d):
    return ops.indicator_tasks(companies(spark, d), indicators(spark), observations(spark, d, YEAR))


@query("indicator_tasks", sql_with(OBS, IND, TASKS, "SELECT * FROM task"))
def indicator_tasks(spark, d):
    return tasks(spark, d)


@query("coverage_rollup", sql_with(OBS, IND, TASKS, "SELECT dimension, indicator_code, count(*) AS n, count(*) FILTER (status = 'confirmed') AS done, CAST(GROUPING(dimension) * 2 + GROUPING(indicator_code) AS INTEGER) AS level "
    "FROM task GROUP BY ROLLUP (dimension, indicator_code)"))
def coverage_rollup(spark, d):
    return ops.coverage_rollup(tasks(spark, d))


@query("company_completion", sql_with(OBS, IND, TASKS, "SELECT company_code, count(*) FILTER (status = 'confirmed') AS done, count(*) AS n, CASE WHEN count(*) FILTER (status = 'confirmed') = 0 THEN 'empty' "
    "WHEN count(*) FILTER (status = 'confirmed') = count(*) THEN 'complete' ELSE 'partial' END AS state FROM task GROUP BY 1"))
def company_completion(spark, d):
    return ops.company_completion(tasks(spark, d))


COVER = """cov AS (SELECT t.company_code, t.indicator_code, t.dimension, t.key_indicator, coalesce(n, 0) AS candidate_count, coalesce(pages, 0) AS pages, mc AS max_confidence, CASE
  WHEN n > 0 THEN 'candidate_available' ELSE 'missing_candidate' END AS status, CASE WHEN coalesce(n, 0) = 0 AND key_indicator THEN 'high'
  WHEN coalesce(n, 0) = 0 THEN 'medium' ELSE 'low' END AS priority
  FROM task t LEFT JOIN (SELECT company_code, indicator_code, count(*) AS n, count(DISTINCT source_page) AS pages, max(confidence) AS mc FROM cand
  GROUP BY 1, 2) c USING (company_code, indicator_code))"""


def coverage(spark, d):
    return ops.candidate_coverage(tasks(spark, d), candidates(spark, d))


@query("candidate_coverage", sql_with(OBS, IND, TASKS, CANDIDATES, COVER, "SELECT * FROM cov"))
def candidate_coverage(spark, d):
    return coverage(spark, d)


DUP = f"dup AS (SELECT company_code, report_year, CASE WHEN _ord = 25 THEN 'Other' ELSE indicator_code END AS indicator_code, CASE WHEN _ord = 24 THEN NULL ELSE value END AS value, CASE WHEN _ord = 23 THEN 'odd' ELSE status END AS status, CASE WHEN _ord = 22 THEN '' ELSE source_url END AS source_url, confidence, _ord FROM obs WHERE report_year = {YEAR}), dd AS (SELECT * FROM dup UNION ALL SELECT * FROM dup WHERE _ord = 21)"


@query("quality_issues", sql_with(OBS, DUP, "SELECT * FROM (" + " UNION ALL ".join([
    "SELECT 'unknown_indicator' AS issue, 'error' AS severity, count(*) AS n FROM dd WHERE _ord = 25", "SELECT 'company_outside_universe', 'error', count(*) FROM dd JOIN supplier ON lpad(CAST(s_suppkey AS VARCHAR), 6, '0') = company_code WHERE s_nationkey = 24",
    "SELECT 'confirmed_without_value', 'error', count(*) FROM dd WHERE status = 'confirmed' AND value IS NULL", "SELECT 'unknown_status', 'error', count(*) FROM dd WHERE status = 'odd'", "SELECT 'confirmed_without_source', 'warning', count(*) FROM dd WHERE status = 'confirmed' AND source_url = ''", "SELECT 'low_confidence', 'warning', count(*) FROM dd WHERE confidence < 0.6",
    "SELECT 'repeated_key', 'error', count(*) FROM (SELECT 1 FROM dd GROUP BY company_code, report_year, indicator_code HAVING count(*) > 1)"]) + ") WHERE n > 0"))
def quality_issues(spark, d):
    o = observations(spark, d, YEAR)
    n = F.col("_ord")
    o = o.withColumns({"indicator_code": F.when(n == 25, "Other").otherwise(F.col("indicator_code")), "value": F.when(n != 24, F.col("value")), "status": F.when(n == 23, "odd").otherwise(F.col("status")), "source_url": F.when(n == 22, "").otherwise(F.col("source_url"))})
    inside = table(spark, d, "supplier").filter("s_nationkey <> 24").select(code("s_suppkey").alias("company_code"))
    return ops.quality_issues(o.unionByName(o.filter("_ord = 21")), inside, indicators(spark))


DOCS = "doc AS (SELECT lpad(CAST(c_nationkey AS VARCHAR), 6, '0') AS company_code, 1995 + c_custkey % 4 AS report_year, CASE WHEN c_mktsegment IN ('MACHINERY', 'BUILDING') THEN 'annual_report' WHEN c_mktsegment = 'FURNITURE' AND c_nationkey % 3 = 0 THEN 'esg_report' ELSE 'other' END AS document_type FROM customer)"


def documents(spark, d):
    kind = F.when(F.col("c_mktsegment").isin("MACHINERY", "BUILDING"), "annual_report").when((F.col("c_mktsegment") == "FURNITURE") & (F.col("c_nationkey") % 3 == 0), "esg_report").otherwise("other")
    return table(spark, d, "customer").select(code("c_nationkey").alias("company_code"), (1995 + F.col("c_custkey") % 4).cast("int").alias("report_year"), kind.alias("document_type"))


@query("document_coverage", sql_with("comp AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS company_code FROM supplier)", DOCS, """SELECT c.company_code, coalesce(n, 0) AS documents, coalesce(a, 0) AS annual_report, coalesce(e, 0) AS esg_report, coalesce(years, '') AS years, CASE
  WHEN coalesce(a, 0) = 0 THEN 'discover_annual_report' WHEN coalesce(e, 0) = 0 THEN 'discover_esg_report' ELSE 'complete' END AS next_action
  FROM comp c LEFT
  JOIN (SELECT company_code, count(*) AS n, count(*) FILTER (document_type = 'annual_report') AS a, count(*) FILTER (document_type = 'esg_report') AS e, string_agg(DISTINCT CAST(report_year AS VARCHAR), '|'
  ORDER BY CAST(report_year AS VARCHAR)) AS years FROM doc GROUP BY 1) USING (company_code)"""))
def document_coverage(spark, d):
    return ops.document_coverage(companies(spark, d), documents(spark, d), ("annual_report", "esg_report"))


@query("collection_plan", sql_with("comp AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS company_code FROM supplier)", DOCS, "SELECT company_code, document_type, 1996 AS report_year FROM comp CROSS JOIN (SELECT unnest(['annual_report', 'esg_report']) AS document_type) "
    "WHERE (company_code, document_type) NOT IN (SELECT (company_code, document_type) FROM doc WHERE report_year = 1996)"))
def collection_plan(spark, d):
    return ops.collection_plan(companies(spark, d), documents(spark, d), 1996, ("annual_report", "esg_report"))


BOUND = "CASE WHEN best_rank <= 20 AND worst_rank >= 20 THEN 1.0 ELSE 1 / (1 + least(abs(best_rank - 20), abs(worst_rank - 20)) / 50.0) END"
SENS = (*splan.CHAIN, splan.SENS)


def sensitivity(spark, d):
    return analysis.sensitivity(splan.all_rankings(spark, d)).select("company_code", "best_rank", "worst_rank", "rank_span")


def weights(spark):
    return indicators(spark).select(F.col("code").alias("indicator_code"), "weight")


@query("review_impact", sql_with(*SENS, CANDIDATES, dplan.ELIGIBLE, f"""SELECT d.company_code, d.report_year, d.indicator_code, d.tier, {sql_round(f"100 * (0.35 * CASE tier WHEN 'manual_signature_required' THEN 1.0 WHEN 'consistent_multi_review' THEN 0.55 ELSE 0.4 END + 0.25 * {BOUND} + 0.20 * least(rank_span / 100.0, 1.0) + 0.15 * weight / (SELECT max(weight) FROM ind) + 0.05 * greatest(0, least(1, 1 - max_confidence)))", 6)} AS impact_score
  FROM (SELECT *, CASE WHEN n_values > 1 THEN 'manual_signature_required' WHEN decision = 'auto_confirmed' THEN 'auto' WHEN candidate_count > 1 THEN 'consistent_multi_review' ELSE 'single_candidate_review' END AS tier FROM decisions) d JOIN sens USING (company_code) JOIN ind i ON i.indicator_code = d.indicator_code WHERE tier <> 'auto'"""))
def review_impact(spark, d):
    made = decisions.resolve(candidates(spark, d), dplan.POLICY)
    tiers = decisions.review_tiers(made).join(made.select(*decisions.KEY, "max_confidence"), decisions.KEY)
    return ops.review_impact(tiers, sensitivity(spark, d), weights(spark), 20)


QUANT = f"""qi AS (SELECT c.company_code, c.indicator_code, {sql_round(f"100 * (0.25 * {BOUND} + 0.25 * least(rank_span / 100.0, 1.0) + 0.25 * weight / (SELECT max(weight) FROM ind) + 0.15 * CAST(c.key_indicator AS INTEGER) + 0.10 * (1 - coalesce(population, 0) / (SELECT max(population) FROM pop)))", 6)} AS impact_score, coalesce(population, 0) AS population
  FROM cov c JOIN sens s USING (company_code) JOIN ind i ON i.indicator_code = c.indicator_code LEFT JOIN pop p ON p.indicator_code = c.indicator_code WHERE c.status = 'missing_candidate')"""
POP = "pop AS (SELECT indicator_code, count(*) AS population FROM cov WHERE status = 'candidate_available' GROUP BY 1)"


def quant(spark, d):
    return ops.quantitative_gap_impact(coverage(spark, d), sensitivity(spark, d), weights(spark), 20)


@query("quant_gap_impact", sql_with(*SENS, TASKS, CANDIDATES, COVER, POP, QUANT, "SELECT * FROM qi"))
def quant_gap_impact(spark, d):
    return quant(spark, d)


@query("impact_ranks", sql_with(*SENS, TASKS, CANDIDATES, COVER, POP, QUANT, "SELECT company_code, indicator_code, impact_score, row_number() OVER (ORDER BY impact_score DESC, company_code, indicator_code) AS impact_rank FROM qi"))
def impact_ranks(spark, d):
    return ops.impact_ranks(quant(spark, d)).select("company_code", "indicator_code", "impact_score", "impact_rank")


BATCH = f"""rk AS (SELECT *, row_number() OVER (PARTITION BY company_code ORDER BY impact_score DESC, indicator_code) AS i FROM qi),
bat AS (SELECT company_code, {sql_round('max(impact_score) + sum(CASE WHEN i <= 5 THEN impact_score ELSE 0 END) / 10', 6)} AS company_impact_score, count(*) AS gap_count, count(*) FILTER (impact_score >= 75) AS high_impact_gap_count, string_agg(indicator_code, '|' ORDER BY i) FILTER (i <= 5) AS top_indicator_codes
  FROM rk
  GROUP BY 1 ORDER BY company_impact_score DESC, company_code LIMIT 25)"""


@query("impact_faults", sql_with(*SENS, TASKS, "SELECT t.company_code, t.indicator_code, CASE WHEN s.company_code IS NULL THEN 'no_sensitivity' ELSE 'no_weight' END AS fault FROM task t LEFT "
    "JOIN (SELECT CASE WHEN rank_span % 2 = 1 THEN 'Z' || company_code ELSE company_code END AS company_code FROM sens) s USING (company_code) "
    "WHERE s.company_code IS NULL OR t.indicator_code = 'Brand#7'"))
def impact_faults(spark, d):
    """With every other company's sensitivity under another code, and no weight for one indicator."""
    company = F.when(F.col("rank_span") % 2 == 1, F.concat(F.lit("Z"), "company_code")).otherwise(F.col("company_code"))
    known = weights(spark).withColumn("indicator_code", F.when(F.col("indicator_code") == "Brand#7", "other").otherwise(F.col("indicator_code")))
    return ops.impact_faults(tasks(spark, d), sensitivity(spark, d).withColumn("company_code", company), known)


@query("company_gap_batch", sql_with(*SENS, TASKS, CANDIDATES, COVER, POP, QUANT, BATCH, "SELECT * FROM bat"))
def company_gap_batch(spark, d):
    return ops.company_batch(quant(spark, d))[0]


@query("gap_batch_tasks", sql_with(*SENS, TASKS, CANDIDATES, COVER, POP, QUANT, BATCH, "SELECT company_code, indicator_code, impact_score, CAST(i AS INTEGER) AS task_rank FROM rk JOIN bat USING (company_code) WHERE i <= 10"))
def gap_batch_tasks(spark, d):
    return ops.company_batch(quant(spark, d))[1].select("company_code", "indicator_code", "impact_score", "task_rank")


@query("qual_gap_impact", sql_with(*SENS, TASKS, f"SELECT t.company_code, t.indicator_code, {sql_round(f'100 * (0.35 * {BOUND} + 0.30 * least(rank_span / 100.0, 1.0) + 0.25 * weight / (SELECT max(i2.weight) FROM task t2 JOIN ind i2 USING (indicator_code) WHERE t2.status = {chr(39)}missing{chr(39)}) + 0.10 * CAST(s_suppkey % 3 = 0 AS INTEGER))', 6)} AS impact_score, s_suppkey % 3 = 0 AS missing_esg_document FROM task t JOIN sens USING (company_code) JOIN ind i ON i.indicator_code = t.indicator_code JOIN supplier ON lpad(CAST(s_suppkey AS VARCHAR), 6, '0') = t.company_code WHERE t.status = 'missing'"))
def qual_gap_impact(spark, d):
    gaps = tasks(spark, d).filter("status = 'missing'").join(F.broadcast(weights(spark)), "indicator_code").select("company_code", "indicator_code", F.col("weight").alias("indicator_weight"))
    state = table(spark, d, "supplier").select(code("s_suppkey").alias("company_code"), F.when(F.col("s_suppkey") % 3 == 0, "missing").when(F.col("s_suppkey") % 3 == 1, "collected").otherwise("embedded_in_annual").alias("esg_status"))
    return ops.qualitative_gap_impact(gaps, sensitivity(spark, d), state, 20)


@query("thin_population_batch", sql_with(OBS, IND, TASKS, CANDIDATES, COVER, "pop AS (SELECT indicator_code, count(*) FILTER (status = 'candidate_available') AS population FROM cov GROUP BY 1 "
    "HAVING count(*) FILTER (status = 'candidate_available') < 75), mm AS (SELECT c.indicator_code, company_code, row_number() OVER (PARTITION BY c.indicator_code "
    "ORDER BY company_code) AS i, population FROM cov c JOIN pop USING (indicator_code) WHERE status = 'missing_candidate')", "SELECT indicator_code, company_code, CAST(i AS INTEGER) AS task_rank, population, 75 - population AS population_deficit FROM mm WHERE i <= 25"))
def thin_population_batch(spark, d):
    return ops.thin_batch(coverage(spark, d), 75)


# The evidence graph.
PARTS = """ng AS (SELECT 'company' AS kind, company_code AS k FROM cand UNION SELECT 'report_year', CAST(report_year AS VARCHAR)
  FROM cand UNION SELECT 'indicator', indicator_code FROM cand UNION SELECT 'document', source_file
  FROM cand UNION SELECT 'page', source_file || '|' || source_page
  FROM cand UNION SELECT 'candidate_group', company_code || '|' || report_year || '|' || indicator_code FROM cand
  UNION SELECT 'candidate', company_code || '|' || report_year || '|' || indicator_code || '|' || source_file || '|' || source_page || '|' || printf('%.1f', value)
  FROM cand)"""


@query("evidence_nodes", sql_with(CANDIDATES, PARTS, "SELECT kind, k AS natural_key, kind || ':' || substr(sha256(kind || chr(0) || k), 1, 24) AS id FROM ng"))
def evidence_nodes(spark, d):
    return graph.nodes(candidates(spark, d)).select("kind", "natural_key", "id")


@query("evidence_edges", sql_with(CANDIDATES, "e AS (SELECT DISTINCT company_code, report_year, indicator_code, source_file, source_page, value FROM cand)", "SELECT unnest(['observed_for', 'measures', 'for_period', 'sourced_from', 'member_of']) AS relation, count(*) AS n FROM e GROUP BY 1 "
    "UNION ALL SELECT 'part_of', count(DISTINCT source_file || '|' || source_page) FROM cand"))
def evidence_edges(spark, d):
    return graph.edges(candidates(spark, d)).groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


@query("evidence_constraints", sql_with(CANDIDATES, "g AS (SELECT count(DISTINCT value) AS n FROM cand "
    "GROUP BY company_code, report_year, indicator_code), e AS (SELECT DISTINCT company_code, report_year, indicator_code, source_file, source_page, value, source_page > 2 AS p "
    "FROM cand)", "SELECT 'single_value' AS constraint, n = 1 AS passed, count(*) AS n FROM g GROUP BY 1, 2 UNION ALL SELECT c, true, count(*) "
    "FROM (SELECT unnest(['known_indicator', 'has_source', 'confidence_in_range']) AS c FROM e) GROUP BY 1 UNION ALL SELECT 'page_positive', p, count(*) "
    "FROM e GROUP BY 1, 2"))
def evidence_constraints(spark, d):
    rows = candidates(spark, d)
    shifted = graph.constraints(rows.withColumn("source_page", F.col("source_page") - 2), indicators(spark))
    return shifted.groupBy("constraint", "passed").agg(F.count(F.lit(1)).alias("n"))


@query("graph_summary", sql_with(CANDIDATES, PARTS, "SELECT 'node' AS part, kind AS name, count(*) AS n FROM ng GROUP BY 1, 2"))
def graph_summary(spark, d):
    rows = candidates(spark, d)
    return graph.summary(graph.nodes(rows), graph.edges(rows), graph.constraints(rows, indicators(spark))).filter("part = 'node'")


@query("incremental_plan", sql_with(CANDIDATES, "a AS (SELECT * FROM cand "
    "WHERE source_file IN ('annual-4', 'annual-7', 'esg-3', 'annual-100', 'esg-101', 'annual-102')), m AS (SELECT DISTINCT indicator_code, report_year "
    "FROM a)", "SELECT 'candidates_to_read' AS part, count(*) AS n FROM a UNION ALL SELECT 'companies_changed', count(DISTINCT company_code) FROM a "
    "UNION ALL SELECT 'indicators_moved', count(*) FROM m UNION ALL SELECT 'companies_to_rescore', count(DISTINCT company_code) FROM cand "
    "WHERE indicator_code IN (SELECT indicator_code FROM m) UNION ALL SELECT 'candidates', count(*) FROM cand"))
def incremental_plan(spark, d):
    files = spark.sql("SELECT explode(array('annual-4', 'annual-7', 'esg-3', 'annual-100', 'esg-101', 'annual-102')) AS source_file")
    return graph.recompute_plan(candidates(spark, d), files)


@query("validation_sample", "SELECT event_type, event_id, CAST(i AS INTEGER) AS place FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type "
    "ORDER BY sha256(CAST(event_id AS VARCHAR) || chr(31) || CAST(user_id AS VARCHAR))) AS i FROM events) WHERE i <= 30")
def validation_sample(spark, d):
    return ops.stratified_sample(table(spark, d, "events"), "event_type", ["event_id", "user_id"], 30).select("event_type", "event_id", "place")


@query("validation_accuracy", f"SELECT count(*) AS n, count(*) FILTER (ok) AS correct, {sql_round('count(*) FILTER (ok) / count(*)', 6)} AS accuracy FROM (SELECT abs(l_quantity * 1.02 - l_quantity - l_linenumber / 10.0) <= greatest(abs(l_quantity * 1.02), abs(l_quantity + l_linenumber / 10.0), 1) * 0.01 AS ok FROM lineitem)")
def validation_accuracy(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_quantity") * 1.02).alias("p"), (F.col("l_quantity") + F.col("l_linenumber") / 10.0).alias("a"))
    return ops.accuracy(rows, "p", "a", 0.01)


@query("precision_recall", f"WITH c AS (SELECT count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn, count(*) FILTER (NOT t AND NOT p) AS tn FROM (SELECT quality = 1 AS t, n_chars > 1000 AS p FROM labels JOIN documents USING (doc_id))), r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS x, coalesce(tp / nullif(tp + fn, 0), 0) AS y FROM c) SELECT tp, fp, fn, tn, {sql_round('x', 6)} AS precision, {sql_round('y', 6)} AS recall, {sql_round('coalesce(2 * x * y / nullif(x + y, 0), 0)', 6)} AS f1 FROM r")
def precision_recall(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return ops.confusion(rows, F.col("quality") == 1, F.col("n_chars") > 1000)


@query("completion_gates", """SELECT s_suppkey, completed, completed = 6 AS publishable, next_gate
  FROM (SELECT s_suppkey, a::INT + b::INT + c::INT + q::INT + r::INT + f::INT AS completed, CASE WHEN NOT a THEN 'universe' WHEN NOT b THEN 'documents'
  WHEN NOT c THEN 'quantitative' WHEN NOT q THEN 'qualitative' WHEN NOT r THEN 'review' WHEN NOT f THEN 'release' END AS next_gate

  FROM (SELECT s_suppkey, s_suppkey % 11 <> 0 AS a, s_suppkey % 7 <> 0 AS b, s_suppkey % 2 = 0 OR s_nationkey > 12 AS c, s_nationkey % 5 <> 0 AS q, s_nationkey % 5 <> 0 AND s_suppkey % 3 <> 0 AS r, s_suppkey % 5 <> 0 AS f
  FROM supplier))""")
def completion_gates(spark, d):
    s, n = F.col("s_suppkey"), F.col("s_nationkey")
    facts = table(spark, d, "supplier").select(
        "s_suppkey", (s % 11 != 0).alias("universe_publishable"), F.when(s % 7 == 0, 3).otherwise(0).alias("missing_documents"), (s % 2 == 0).alias("quantitative_exhaustive"), F.lit(0).alias("zero_coverage"), F.when(n > 12, 25).otherwise(5).alias("minimum_population"), F.lit(0.97).alias("sampling_accuracy"),
        F.lit(False).alias("qualitative_exhaustive"), F.when(n % 5 == 0, 2).otherwise(4).alias("risk_flags"), F.when(s % 3 == 0, 1).otherwise(0).alias("manual_groups"), (s % 5 != 0).alias("freeze_ready"), F.lit(True).alias("release_applicable"),
    )
    return ops.completion_gates(facts).select("s_suppkey", "completed", "publishable", "next_gate")


@query("release_validity", "SELECT o_orderkey, o_orderdate + INTERVAL 365 DAYS AS valid_until, CASE WHEN TIMESTAMP '1998-06-01' < o_orderdate THEN 'not_yet' "
    "WHEN TIMESTAMP '1998-06-01' > o_orderdate + INTERVAL 365 DAYS THEN 'expired' ELSE 'effective' END AS validity FROM orders")
def release_validity(spark, d):
    return ops.validity(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", F.lit("1998-06-01").cast("timestamp")).drop("o_orderdate")


@query("release_faults", """WITH a AS (SELECT c_nationkey AS release_id, c_mktsegment AS role, 'P' || CAST(c_custkey % 40 AS VARCHAR) AS reviewer FROM customer)
SELECT release_id, fault FROM (SELECT release_id, CASE WHEN count(DISTINCT role) FILTER (role IN ('BUILDING', 'MACHINERY')) < 2 THEN 'role_missing'
  WHEN count(DISTINCT reviewer) < count(*) THEN 'reviewer_repeated' END AS fault FROM a GROUP BY 1) WHERE fault IS NOT NULL
UNION ALL SELECT n_nationkey, 'hash_differs' FROM nation WHERE n_nationkey % 4 = 0""")
def release_faults(spark, d):
    a = table(spark, d, "customer").select(F.col("c_nationkey").alias("release_id"), F.col("c_mktsegment").alias("role"), F.concat(F.when(F.col("c_custkey") % 2 == 0, "p").otherwise("P"), (F.col("c_custkey") % 40).cast("string")).alias("reviewer"))
    h = table(spark, d, "nation").select(F.col("n_nationkey").alias("release_id"), F.lit("x").alias("recorded"), F.when(F.col("n_nationkey") % 4 == 0, "y").otherwise("x").alias("actual"))
    return ops.release_faults(a, h, ("BUILDING", "MACHINERY"))

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from verdigris.functions.numeric import erf_text
from verdigris.functions.quantiles import order_statistics, quantiles, upper_medians
from verdigris.operators import analysis, coverage, scoring
from verdigris.operators.cache import CHANGE_COLUMNS, ScoreCache
from verdigris.schemas import KEY, STRATEGIES, methodology, methodology_faults
from verdigris.sources.shared import staged
from verdigris.streaming.rescoring import rescored

IND = [("a", "E", "quantitative", 60.0, "positive", None), ("b", "S", "quantitative", 40.0, "negative", 20.0), ("c", "G", "qualitative", 70.0, "positive", None), ("d", "E", "qualitative", 30.0, "bidirectional", None)]


@pytest.fixture(scope="module")
def data(spark):
    random.seed(3)
    rows, n = [], 0
    for c in range(30):
        for code, *_ in IND:
            status = random.choice(["confirmed"] * 6 + ["pending", "not_applicable", "imputed"])
            if random.random() < 0.85:
                rows.append((f"C{c:02d}", f"name {c}", 2024, code, round(random.uniform(0, 60), 3), status, n))
                n += 1
    rows.append(("C00", "name 0", 2024, "a", 33.0, "confirmed", n))  # a second row of a cell: the later one scores
    obs = spark.createDataFrame(rows, "company_code string, company_name string, report_year int, indicator_code string, value double, status string, _ord long")
    ind = spark.createDataFrame([(*r, False) for r in IND], "code string, dimension string, kind string, weight double, direction string, benchmark double, key_indicator boolean")
    return rows, obs, ind


def plain_scores(rows, strategy):
    """The roll-up over a full grid of companies and indicators, in plain Python."""
    stats, cells, names = {}, {}, {}
    for code, *_ in IND:
        values = sorted(r[4] for r in rows if r[3] == code and r[5] == "confirmed")
        if len(values) >= 20:
            at = lambda q: values[int(q * (len(values) - 1))] + (q * (len(values) - 1) % 1) * (values[min(len(values) - 1, int(q * (len(values) - 1)) + 1)] - values[int(q * (len(values) - 1))])  # noqa: E731,B023
            low, high = at(0.01), at(0.99)
            values = [min(max(v, low), high) for v in values]
        stats[code] = (statistics.fmean(values), statistics.pstdev(values)) if values else (0.0, 0.0)
    for r in rows:
        cells[r[0], r[3]] = r
        names.setdefault(r[0], r[1])
    out = {}
    for company in names:
        kind = {"quantitative": [0.0, 0.0, 0.0], "qualitative": [0.0, 0.0, 0.0]}
        for code, _, k, weight, direction, mark in IND:
            r = cells.get((company, code))
            m, sd = stats[code]
            known = r is not None and r[5] == "confirmed"
            if known and k == "qualitative":
                s = min(max(r[4], 0), 100)
            elif known:
                z = (r[4] - m) / sd
                if mark is not None:
                    s = 100.0 if (r[4] <= mark if direction == "negative" else r[4] >= mark) else 100 * math.exp(-0.5 * ((r[4] - mark) / sd) ** 2)
                else:
                    s = 50 * (1 + math.erf(z / math.sqrt(2))) if direction == "positive" else 50 * (1 - math.erf(z / math.sqrt(2)))
            else:
                s = 0.0 if r is not None and r[5] == "not_applicable" or strategy != "indicator_neutral_v1" else 50.0
            kind[k][0] += s * weight / 100
            kind[k][1] += weight * known
            kind[k][2] += weight
        if strategy == "disclosed_weight_v1":
            kind = {k: [s * t / w if w else 0.0, w, t] for k, (s, w, t) in kind.items()}
        out[company] = 0.8 * kind["quantitative"][0] + 0.2 * kind["qualitative"][0]
    return out


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_scores_equal_a_plain_grid(data, strategy):
    rows, obs, ind = data
    got = {r.company_code: r for r in scoring.ranking(obs, ind, (strategy,)).collect()}
    want = plain_scores(rows, strategy)
    assert set(got) == set(want)
    for c, s in want.items():
        assert got[c].total_score == pytest.approx(s, abs=0.0051)
    ranks = sorted({r.total_score for r in got.values()}, reverse=True)
    assert all(r["rank"] == ranks.index(r.total_score) + 1 for r in got.values())


def test_row_order_does_not_matter(data):
    _, obs, ind = data
    key = lambda df: sorted((r.company_code, r.total_score, r["rank"]) for r in df.collect())
    assert key(scoring.ranking(obs, ind, ("indicator_neutral_v1",))) == key(scoring.ranking(obs.repartition(7, "value"), ind, ("indicator_neutral_v1",)))


COLUMNS = ["company_code", "company_name", "total_score", "e_score", "s_score", "g_score", "disclosure_rate", "grade", "rank"]


def same(a, b):
    return sorted(map(tuple, a.select(COLUMNS).collect()), key=str) == sorted(map(tuple, b.select(COLUMNS).collect()), key=str)


def replaced(obs, change):
    return obs.join(change, KEY, "left_anti").unionByName(change)


def test_incremental_equals_full(data):
    _, obs, ind = data
    strategy = "indicator_neutral_v1"
    cache = ScoreCache.build(obs, ind, strategy)
    change = obs.filter("indicator_code = 'b' AND company_code < 'C10'").withColumn("value", F.col("value") * 2)
    full = scoring.ranking(replaced(obs, change), ind, (strategy,))
    part = cache.apply(change)
    assert same(full, part.ranking()) and same(cache.ranking(), scoring.ranking(obs, ind, (strategy,)))
    new = change.limit(1).withColumns({"company_code": F.lit("new"), "company_name": F.lit("New")})  # a company that had no cell before
    assert same(part.apply(new).ranking(), scoring.ranking(replaced(obs, change).unionByName(new), ind, (strategy,)))
    last = ScoreCache.open(obs.sparkSession, cache.root, ind, strategy)
    assert last.manifest["version"] == 2
    assert same(last.apply(change.limit(0)).ranking(), last.ranking())


def test_names_statuses_and_repeated_rows_of_a_change(data):
    _, obs, ind = data
    strategy = "legacy_zero_v1"
    twice = obs.unionByName(obs.filter("company_code < 'C05'").withColumns({"_ord": F.col("_ord") + 1000, "value": F.col("value") + 1}))  # rows that do not count for scores, but in the population
    cache = ScoreCache.build(twice, ind, strategy)
    assert same(cache.ranking(), scoring.ranking(twice, ind, (strategy,)))
    change = obs.filter("company_code < 'C09'").withColumns({"_ord": -F.col("_ord") - 5, "company_name": F.concat("company_name", F.lit(" renamed")), "status": F.when(F.col("indicator_code") == "a", "not_applicable").otherwise(F.col("status"))})
    older = change.withColumns({"_ord": F.col("_ord") - 9000, "value": F.lit(7.0)})
    unknown = change.limit(1).withColumn("indicator_code", F.lit("no such"))
    assert same(cache.apply(change.unionByName(older).unionByName(unknown)).ranking(), scoring.ranking(replaced(twice, change), ind, (strategy,)))


def test_a_repeated_and_a_failed_batch(data, spark, tmp_path, monkeypatch):
    _, obs, ind = data
    strategy = "indicator_neutral_v1"
    cache = ScoreCache.build(obs, ind, strategy)
    changes = [obs.filter(f"indicator_code = '{c}' AND company_code < 'C1{i}'").withColumn("value", F.col("value") * (i + 2)) for i, c in enumerate("bab")]
    feed = str(tmp_path / "feed")
    want = obs
    for change in changes:
        change.select(*CHANGE_COLUMNS).coalesce(1).write.mode("append").parquet(feed)
        want = replaced(want, scoring.latest_rows(change))
    write, seen = ScoreCache._write, []

    def failing(self, table, df, folder, version):
        out = write(self, table, df, folder, version)
        seen.append((table, version))
        if table == "sums" and version == 2 and seen.count((table, version)) == 1:
            raise OSError("the machine is gone")  # all partitions are written, the manifest is not
        return out

    monkeypatch.setattr(ScoreCache, "_write", failing)
    with pytest.raises(Exception, match="the machine is gone"):
        rescored(spark, feed, cache, str(tmp_path / "checkpoint"))
    assert ScoreCache.open(spark, cache.root, ind, strategy).manifest["version"] == 1
    done = rescored(spark, feed, cache, str(tmp_path / "checkpoint"))
    assert done.manifest["version"] == 3 and seen.count(("sums", 2)) == 2
    assert same(done.ranking(), scoring.ranking(want, ind, (strategy,)))
    assert done.apply(changes[0], "changes", 0) is done  # delivered again
    done.expire()
    assert same(ScoreCache.open(spark, cache.root, ind, strategy).ranking(), scoring.ranking(want, ind, (strategy,)))


def test_quantiles_equal_sorting(spark):
    pick = random.Random(3)
    odd = [0.0, -0.0, 1e300, -1e300, 5e-324, -5e-324, float("inf"), float("-inf"), 1.0, 1.0 + 2**-52]
    groups = {"many": [pick.gauss(0, 1) for _ in range(3000)], "same": [2.5] * 500, "odd": odd, "one": [-7.25], None: [pick.choice((1.5, 2.5, -3.0)) for _ in range(999)], "near": [1 + i * 2**-52 for i in range(401)]}
    rows = [(g, x) for g, v in groups.items() for x in v] + [("one", None), ("nothing", None)]
    frame = staged(spark.createDataFrame(rows, "g string, x double"))
    got = {r.g: r for r in quantiles(frame, ["g"], "x", [0.01, 0.5, 0.99]).collect()}
    assert set(got) == set(groups)
    for g, v in groups.items():
        v = sorted(v)
        assert got[g].n == len(v)
        if g != "odd":
            for p, q in zip((0.01, 0.5, 0.99), got[g].q, strict=True):
                at = (len(v) - 1) * p
                assert q == pytest.approx(v[math.floor(at)] + (v[math.ceil(at)] - v[math.floor(at)]) * (at - math.floor(at)), rel=1e-15)
    upper = {r.g: r.upper_median for r in upper_medians(frame, ["g"], "x").collect()}
    assert upper == {g: sorted(v)[len(v) // 2] for g, v in groups.items()}
    ranks = order_statistics(frame.filter("g = 'odd'"), ["g"], "x", lambda n: F.sequence(F.lit(0).cast("long"), n - 1)).orderBy("rank")
    assert [r.value for r in ranks.collect()] == sorted(odd)
    assert quantiles(frame.filter("false"), ["g"], "x", [0.5]).count() == 0


def test_impact_ranks_go_through_all_ranges(spark):
    rows = [(f"c{i % 97}", f"i{i}", float(i * 7919 % 50)) for i in range(1000)]
    df = spark.createDataFrame(rows, "company_code string, indicator_code string, impact_score double").repartition(5)
    want = {(c, i): k for k, (c, i, _) in enumerate(sorted(rows, key=lambda r: (-r[2], r[0], r[1])), 1)}
    assert {(r.company_code, r.indicator_code): r.impact_rank for r in coverage.impact_ranks(df).collect()} == want
    assert coverage.impact_ranks(df.filter("false")).count() == 0


def test_erf(spark):
    got = spark.range(-700, 701).select((F.col("id") / 100.0).alias("x")).select("x", F.expr(erf_text("x")).alias("e")).collect()
    assert max(abs(r.e - math.erf(r.x)) for r in got) < 2e-15


def test_sensitivity(data):
    _, obs, ind = data
    rankings = scoring.ranking(obs, ind)
    for r in analysis.sensitivity(rankings).collect():
        assert r.rank_span == r.worst_rank - r.best_rank and r.unstable == (r.rank_span > 10)
    pairs = analysis.strategy_pairs(rankings, 10).collect()
    assert len(pairs) == 3 and all(-1 <= p.rank_correlation <= 1 and 0 <= p.top_overlap <= 1 and p.shared == 30 for p in pairs)


def test_empty_tables(data):
    _, obs, ind = data
    assert scoring.ranking(obs.filter("false"), ind).count() == 0
    assert scoring.population_baseline(obs.filter("false"), ind).filter("population_state <> 'empty'").count() == 0


def test_methodology_file(spark, tmp_path):
    path = tmp_path / "m.json"
    path.write_text('{"version": "v1", "quantitative_ratio": 0.7, "indicators": [{"code": "a", "dimension": "E", "kind": "quantitative", "weight": 90, "direction": "positive"}, {"code": "a", "dimension": "Q", "kind": "quantitative", "weight": 5, "direction": "positive"}]}')
    indicators, head = methodology(spark, str(path))
    assert head["quantitative_ratio"] == 0.7 and head["qualitative_ratio"] == 0.2
    assert {tuple(r) for r in methodology_faults(indicators).collect()} == {("repeated_code", "a"), ("unknown_dimension", "a"), ("weights_not_100", "quantitative")}

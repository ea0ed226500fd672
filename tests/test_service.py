from pyspark.sql import functions as F

from verdigris import cli
from verdigris.operators.decisions import Policy
from verdigris.plans.binding import YEAR, candidates, indicators, observations
from verdigris.service import Service

SF = "/root/testdata/sf0.001"


def test_service(spark):
    obs = observations(spark, SF)
    history = obs.withColumn("revision", F.lit(1).cast("long"))
    service = Service(spark, indicators(spark), history, candidates(spark, SF))
    before = {r.company_code: r.total_score for r in service.rankings(YEAR).collect()}
    code = min(before)
    change = obs.filter((F.col("company_code") == code) & (F.col("report_year") == YEAR) & (F.col("indicator_code") == "Brand#20")).withColumn("value", F.col("value") + 7)
    service.add_observations(change)
    assert service.observations().count() == obs.count()
    after = {r.company_code: r.total_score for r in service.rankings(YEAR).collect()}
    assert set(after) == set(before)
    assert service.company_score(code, YEAR).count() == 25
    assert service.rankings(YEAR, top=3).count() == 3 and service.progress(YEAR).count() == len(before) == service.sensitivity(YEAR).count()
    policy = Policy(annual_codes=("Brand#1", "Brand#2"))
    assert service.resolution_audit(policy).count() == 0 and service.review_template(policy, 5).count() == 5
    assert service.review_tiers(policy).count() == candidates(spark, SF).select("company_code", "indicator_code").distinct().count()
    assert service.health()["indicators"] == 25


def test_commands(spark, tmp_path):
    obs, ind = f"{tmp_path}/obs", f"{tmp_path}/ind"
    observations(spark, SF, YEAR).write.parquet(obs)
    indicators(spark).write.parquet(f"{tmp_path}/ind_parquet")
    candidates(spark, SF).write.parquet(f"{tmp_path}/cand")
    indicators(spark).toPandas().to_csv(f"{ind}.csv", index=False)
    run = lambda command, *args: cli.main([command, *args, "--out", f"{tmp_path}/out-{command}"])
    assert run("score", "--in", f"observations={obs}", "--in", f"methodology={ind}.csv", "--set", f"year={YEAR}") == 0
    assert spark.read.parquet(f"{tmp_path}/out-score").count() == 10
    assert run("resolve-pending", "--in", f"candidates={tmp_path}/cand", "--set", "annual=Brand#1,Brand#2") == 0
    assert run("build-evidence-graph", "--in", f"candidates={tmp_path}/cand") == 0
    (tmp_path / "p.txt").write_text("\n=== PAGE 3 ===\n资产负债率 45.5%，见 600001.SH。温室气体排放强度 2.5吨/万元")
    assert run("extract-text", "--in", f"pages={tmp_path}/p.txt") == 0
    got = {r.indicator_code: (r.value, r.page) for r in spark.read.parquet(f"{tmp_path}/out-extract-text").collect()}
    assert got == {"Q_G_DEBT_ASSET_RATE": (45.5, 3), "Q_E_GHG_INTENSITY": (2500.0, 3)}
    pages = spark.createDataFrame([("a", "f", 1, "指标 单位 2024年 2025年\n温室气体排放总量 万吨 2.0 3.0\n加权平均净资产收益率（%） 4.5 3.1\n")], "company_code string, file string, page int, page_text string")
    pages.write.parquet(f"{tmp_path}/pages")
    spark.createDataFrame([("a", 1e9)], "company_code string, revenue double").write.parquet(f"{tmp_path}/revenue")
    assert run("derive-total-intensities", "--in", f"pages={tmp_path}/pages", "--in", f"revenue={tmp_path}/revenue") == 0
    assert [r.value for r in spark.read.parquet(f"{tmp_path}/out-derive-total-intensities").collect()] == [300.0]
    assert run("extract-returns", "--in", f"pages={tmp_path}/pages") == 0
    assert [r.value for r in spark.read.parquet(f"{tmp_path}/out-extract-returns").collect()] == [4.5]
    assert run("prepare-review-packets", "--in", f"items={tmp_path}/cand", "--set", "key=source_file", "--set", "size=10") == 0
    packets = spark.read.parquet(f"{tmp_path}/out-prepare-review-packets")
    assert packets.count() == candidates(spark, SF).count()

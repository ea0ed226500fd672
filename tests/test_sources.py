import pytest

from verdigris.sources import readers, sinks
from verdigris.streaming import events


def test_observations_from_csv(spark, tmp_path):
    path = tmp_path / "obs.csv"
    path.write_text('﻿company_code,company_name,report_year,indicator_code,value,status,evidence_text\n600001.sh, One ,2024,x,"1,234.5",confirmed,"two\nlines ""q"""\n600002.SH,Two,2024,y,,confirmed,\n600003.SH,Three,2024,x,n/a,pending,z\x00\n', encoding="utf-8")
    obs = readers.read_observations(spark, str(path))
    got = {r.company_code: r for r in obs.collect()}
    assert got["600001.SH"].value == 1234.5 and got["600001.SH"].evidence_text == 'two\nlines "q"' and got["600001.SH"].company_name == "One"
    assert got["600003.SH"].value is None and got["600003.SH"].evidence_text == "z"
    ind = spark.createDataFrame([("x",)], "code string")
    assert {(r.company_code, r.fault) for r in readers.observation_faults(obs, ind).collect()} == {("600002.SH", "unknown_indicator")}
    with pytest.raises(ValueError, match="lacks the columns status"):
        bad = tmp_path / "bad.csv"
        bad.write_text("company_code,report_year,indicator_code,value\n")
        readers.read_observations(spark, str(bad))


def test_other_readers(spark, tmp_path):
    (tmp_path / "u.csv").write_text("stock_code,company_name,included\n600001.sh,A,是\n00700.HK,B,no\n", encoding="utf-8")
    got = {r.stock_code: r for r in readers.read_universe(spark, str(tmp_path / "u.csv")).collect()}
    assert got["600001.SH"].exchange == "SSE" and got["600001.SH"].included and not got["00700.HK"].included
    (tmp_path / "s.tsv").write_text("证券代码\t证券简称\n000001\tX\n", encoding="utf-8")
    assert readers.read_snapshot(spark, str(tmp_path / "s.tsv"), "\t").first().stock_code == "000001"
    (tmp_path / "t.txt").write_text("\n=== PAGE 1 ===\nfirst\n=== PAGE 7 ===\nlast\nline")
    assert sorted((r.page, r.page_text) for r in readers.read_page_texts(spark, str(tmp_path / "t.txt")).collect()) == [(1, "first"), (7, "last\nline")]
    (tmp_path / "f.csv").write_text('company_code,report_year,fact_code,value\nc,2024,revenue,"1,000.25"\n')
    assert float(readers.read_facts(spark, str(tmp_path / "f.csv")).first().value) == 1000.25
    assert readers.read_or_empty(spark, f"file://{tmp_path}/none", readers.OBSERVATION).count() == 0
    pages = spark.createDataFrame([('{"page":1,"total":3,"data":[{"code":"a","name":"A"},{"code":"a","name":"B"}]}',)], "p string")
    assert {r.fault for r in readers.listing_faults(readers.parse_listings(pages, "p")).collect()} == {"row_count_differs", "repeated_codes"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5, 'q"x\ny'), ("b", None, "")], "k string, v double, t string")
    sinks.write_csv(df, f"{tmp_path}/out")
    back = {r.k: r for r in readers.read_csv(spark, f"{tmp_path}/out", ["k", "v"]).collect()}
    assert back["a"].v == "1.5" and back["a"].t == 'q"x\ny' and back["b"].v is None
    assert "<td>a</td>" in sinks.ranking_html(df.select("k").collect()) and "&lt;" in sinks.ranking_html([], "<x>")
    obs = spark.createDataFrame([("c", 2023, "i", 1.0), ("c", 2024, "i", 2.0)], "company_code string, report_year int, indicator_code string, value double")
    sinks.write_year_partitions(obs, f"{tmp_path}/years")
    assert spark.read.parquet(f"{tmp_path}/years").filter("report_year = 2024").count() == 1


def test_stream_with_watermark(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    stream = events.windowed(events.read_events(spark, folder), "1 day", late="2 hours")
    events.run_available(stream, f"file://{tmp_path}/w", "update")
    rows = spark.read.parquet(f"file://{tmp_path}/w/rows/*")
    batch = events.windowed(spark.read.parquet(f"{folder}/events.parquet"), "1 day")
    assert rows.agg({"n": "sum"}).first()[0] == batch.agg({"n": "sum"}).first()[0]

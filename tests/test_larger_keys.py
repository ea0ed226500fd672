"""Queries against their SQL on keys as large tables have them: beyond the digits of codes and made texts."""

import duckdb
import pandas as pd
import pytest
from test_queries import PLANS, SQL, rows

from verdigris.operators.universe import bind_provenance

SUPPLIERS = [0, 7, 999, 1000, 1018, 1234, 59_999, 123_456]
CUSTOMERS = [*range(0, 60), *range(10_000, 10_010), *range(99_990, 100_110), *range(123_450, 123_460), 1_000_003, 1_000_004]
LINES = [(1, 1_000_005, 3, 10.0), (1, 4, 3, 10.0), (1, 7, 3, 11.0), (2, 1_199_999, 1, 20.0), (2, 50, 1, 21.0), (3, 5, 250, 9.0), (3, 5, 120, 9.0), (4, 8, 2, None)]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("larger")
    pd.DataFrame({"s_suppkey": SUPPLIERS, "s_name": [f"Supplier#{k:09d}" for k in SUPPLIERS]}).to_parquet(path / "supplier.parquet")
    pd.DataFrame({"c_custkey": CUSTOMERS, "c_name": [f"Customer#{k % 100_000:09d}" for k in CUSTOMERS], "c_nationkey": [3 if k % 3 else k % 4 for k in CUSTOMERS], "c_mktsegment": "MACHINERY"}).to_parquet(path / "customer.parquet")
    pd.DataFrame(LINES, columns=["l_orderkey", "l_partkey", "l_suppkey", "l_quantity"]).to_parquet(path / "lineitem.parquet")
    return path


@pytest.mark.parametrize("name", ["dedupe_documents", "migration_plan", "provenance_bind", "year_tables", "registry_reconcile", "unit_rules", "universe_augment"])
def test_larger_keys(spark, folder, name):
    con = duckdb.connect()
    for file in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    want = con.execute(SQL[name])
    names = [c[0] for c in want.description]
    got = PLANS[name](spark, str(folder))
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


def test_provenance_of_shared_codes(spark):
    names = "stock_code string, company_name string, entity_id string, source_url string"
    snapshot = spark.createDataFrame([("1", "A Ltd", "E1", "u1"), ("1", "B", "E2", "u2"), ("1", "B", "E2", "u3"), ("2", "C", None, "u4"), ("2", "D", "E4", "u5"), ("3", None, "E5", "u6"), (None, "F", "E6", "u7")], names)
    universe = spark.createDataFrame([("1", "a", "E1", " "), ("1", "B", "E2", None), ("1", "B", "E1", ""), ("1", "B", None, ""), ("1", "b", "E9", "own"), ("1", "X", "E9", ""), ("2", "C", "E8", ""), ("2", "D", "E8", ""), ("2", "D", "E4", ""), ("3", "E", "E5", ""), ("4", "F", "E6", ""), (None, "F", "E6", "")] + [("1", "B", "E2", None)], names)
    got = sorted((r.stock_code or "", r.status, r.source_url or "") for r in bind_provenance(universe, snapshot).collect())
    want = [("1", "matched", "u1"), ("1", "matched", "u2"), ("1", "matched", "u2"), ("1", "name_difference", "u1"), ("1", "matched", "u2"), ("1", "entity_conflict", "own"), ("1", "entity_conflict", "u1"), ("2", "matched", "u4"), ("2", "name_difference", "u4"), ("2", "matched", "u5"), ("3", "unmatched", "u6"), ("4", "unmatched", ""), ("", "unmatched", "")]
    assert got == sorted(want)

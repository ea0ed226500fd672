"""Every query against its SQL, on the smallest tables; those of texts on larger ones, too, where rarer branches meet a row."""

import duckdb
import pytest

import __spark_entry__ as entry

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
PLANS = {n: q for plan in entry._plans() for n, q in plan.QUERIES.items()}
SQL = {n: q for plan in entry._plans() for n, q in plan.ORACLE_SQL.items()}


TEXTS = sorted(n for plan in entry._plans() if plan.__name__.endswith((".tables", ".rules")) for n in plan.QUERIES)


def connected(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.fixture(scope="module")
def duck():
    return {sf: connected(sf) for sf in (SF, LARGER)}


def plain(value):
    if value is None or value != value:
        return ""
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)) or hasattr(value, "as_tuple"):
        return f"{float(value):.5f}".replace("-0.00000", "0.00000")
    return str(value)


def rows(columns, values):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(plain(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name, sf", [(n, SF) for n in sorted(PLANS)] + [(n, LARGER) for n in TEXTS])
def test_query(spark, duck, name, sf):
    got = PLANS[name](spark, sf)
    found = rows(got.columns, got.collect())
    if name in SQL:
        want = duck[sf].execute(SQL[name])
        names = [c[0] for c in want.description]
        assert sorted(names) == sorted(got.columns)
        assert found == rows(names, want.fetchall())


def test_entry_and_registration(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

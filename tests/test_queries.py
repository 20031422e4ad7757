"""Every query of the engine against its SQL, on the smallest tables; those without SQL against what they promise."""

import math
import os

import duckdb
import pytest

from cairnset.plans import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    yield c
    c.close()


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    value = lambda v: repr(v + 0.0) if isinstance(v, float) else repr(v)
    return sorted(tuple(value(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    got = QUERIES[name](spark, SF)
    asked = duck.execute(ORACLES[name])
    names = [d[0] for d in asked.description]
    assert sorted(got.columns) == sorted(names)
    assert normal([tuple(r) for r in got.collect()], got.columns) == normal(asked.fetchall(), names)


def test_geodesic_agrees_with_sphere(spark):
    plain = {r.item_id: r.haversine for r in QUERIES["ge7_distances"](spark, SF).collect()}
    rows = QUERIES["ge7_geodesic"](spark, SF).collect()
    assert len(rows) == len(plain)
    for r in rows:
        if r.metres is not None and not math.isnan(r.metres):
            assert abs(r.metres - plain[r.item_id]) <= 0.006 * plain[r.item_id] + 1


def test_every_query_is_checked():
    assert set(QUERIES) - set(ORACLES) == {"ge7_geodesic"}


def test_entry_works_alone(spark):
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

"""Every query with an oracle against DuckDB at the smallest scale."""

import os
from collections import Counter

import duckdb
import pytest

from tilewright import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_oracle(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    told = duck.execute(catalog.ORACLES[name])
    names = [c[0] for c in told.description]
    assert sorted(names) == columns
    wanted = Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in told.fetchall())
    assert got == wanted


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_kernel_query_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_an_oracle_can_fail(spark, duck):
    """Swapping two rows of precedence must show."""
    wrong = catalog.ORACLES["classify_closed_ways"].replace("WHEN tags['natural'] = 'water' THEN 'water'", "WHEN tags['landuse'] = 'basin' THEN 'basin' WHEN tags['natural'] = 'water' THEN 'water'")
    assert wrong != catalog.ORACLES["classify_closed_ways"]
    right = Counter(duck.execute(catalog.ORACLES["classify_closed_ways"]).fetchall())
    assert Counter(duck.execute(wrong).fetchall()) != right


def test_every_label_point_lies_inside(spark):
    rows = catalog.QUERIES["point_on_surface"](spark, DATA).collect()
    assert all(r["inside"] for r in rows)
    # rings without one have no area at all
    closed = {r["way"]: r["area2"] for r in catalog.QUERIES["normalized_rings"](spark, DATA).collect()}
    assert {w for w, area in closed.items() if area} <= {r["way"] for r in rows}

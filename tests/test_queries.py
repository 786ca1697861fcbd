"""Every query with SQL gives DuckDB's rows on sf0.001."""

import glob
import os
from collections import Counter

import duckdb
import pytest

from strandloom.jobs.registry import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def rows(frame):
    plain = lambda v: None if v is None or v != v else round(float(v), 6) if isinstance(v, float) else v.item() if hasattr(v, "item") else v
    return Counter(tuple(map(plain, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(duck.sql(ORACLE_SQL[name]).df())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_greedy_pairs_are_one_to_one_and_greedy(spark):
    from strandloom.jobs.registry import _scored

    pairs = sorted((tuple(r) for r in _scored(spark, DATA).collect()), key=lambda r: (-r[3], r[1], r[2]))
    left, right, want = set(), set(), set()
    for user, a, b, score in pairs:
        if a not in left and b not in right:
            left.add(a), right.add(b), want.add((user, a, b, score))
    assert {tuple(r) for r in QUERIES["Q16_greedy_pairs"](spark, DATA).collect()} == want

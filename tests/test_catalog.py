"""The catalogue at the smallest size against DuckDB."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = ["validate_issue_counts", "processed_contract", "label_distribution", "length_fences", "pattern_signals", "exact_groups", "near_candidates", "group_ids", "interim_table", "split_drift", "median_sample", "length_histogram"]


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "~"
    return f"{x:.9g}" if isinstance(x, float) else str(x)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_oracle(spark, con, name):
    got = entry.queries()[name](spark, DIR)
    cols = sorted(got.columns)
    want = con.sql(entry.oracle_sql()[name])
    assert sorted(want.columns) == cols
    a = sorted(tuple(plain(r[c]) for c in cols) for r in got.collect())
    b = sorted(tuple(map(plain, r)) for r in want.select(*cols).fetchall())
    assert a == b


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

"""Registered queries against their SQL twins on the smallest tables.

Building a query must start no job but those that open its tables.
"""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as driver  # noqa: E402
from compare import rows_of  # noqa: E402
from study_queries.registry import QUERIES  # noqa: E402

DATA = Path("/root/testdata/sf0.001")
NAMES = sorted(driver.oracle_sql())
# These write to the shared folder, which is what they show.
SINKS = ("s1_load", "s3_stored_question", "s4_buckets", "s8_export_rows", "s9_canonical_order")


@pytest.fixture(scope="module")
def con():
    if not DATA.exists():
        pytest.skip("no test data")
    connection = duckdb.connect()
    for file in DATA.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, monkeypatch, name):
    opened = []
    reader = type(spark.read)
    read = reader.parquet
    monkeypatch.setattr(
        reader, "parquet", lambda self, *paths, **more: opened.append(paths) or read(self, *paths, **more))
    spark.sparkContext.setJobGroup(f"plan-{name}", name)
    frame = driver.queries()[name](spark, str(DATA))
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(f"plan-{name}")
    spark.sparkContext.setJobGroup(f"run-{name}", name)
    got = frame.toPandas()
    want = con.execute(driver.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) > 0 and rows_of(got) == rows_of(want)
    if name in QUERIES and name not in SINKS:
        assert len(jobs) <= len(opened)


def test_every_twin_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())

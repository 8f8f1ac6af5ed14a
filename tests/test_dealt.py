"""Shared steps of the study queries lie in as many tasks as their tables need, with the same rows."""

import pytest

from study_queries import canonical, core, multi, roles as r
from tabuloom.operators import structure as st


@pytest.fixture()
def tables(spark, frame, tmp_path):
    def write(name, schema, rows, files=1):
        frame(schema, rows).repartition(files).write.parquet(str(tmp_path / f"{name}.parquet"))

    write("region", "r_regionkey long, r_name string", [(0, "S")])
    write("nation", "n_nationkey long, n_regionkey long", [(0, 0)])
    write("customer", "c_custkey long, c_mktsegment string, c_nationkey long, c_acctbal double", [(1, "A", 0, 1.0)])
    write("orders", "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string, o_totalprice double",
          [(k, 1, "F", "1-URGENT", 1.0) for k in (1, 2, 3, 3)] + [(None, 1, "O", "5-LOW", 1.0)])
    write("lineitem", "l_orderkey long, l_linenumber int, l_discount double, l_quantity double, l_returnflag string, l_linestatus string",
          [(1, 1, 0.1, 1.0, "A", "F"), (1, 2, 0.1, 1.0, "A", "F"), (1, 3, 0.0, 1.0, None, "F"), (2, 1, 0.0, 1.0, "R", None),
           (3, 1, 0.0, 1.0, "N", "O"), (None, 1, 0.0, 1.0, "A", "F")], files=3)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield str(tmp_path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_tasks_grow_with_the_lines(spark, tables):
    reads = r.table(spark, tables, "lineitem").rdd.getNumPartitions()
    session = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert reads > 1
    for step in (r.line_scales, r.entity_grid, canonical.loop_records, multi.grid_cells, core.scale_facts, core.status_dimension):
        assert step(spark, tables).rdd.getNumPartitions() == r.DEALT * reads > session, step.__name__


def test_rows_of_the_grid(spark, tables):
    cells = [(x.respondent_id, x.entity, x.option, x.value) for x in r.entity_grid(spark, tables).collect()]
    # A row per cell of every order, repeated ones too; flags and keys that are null match nothing.
    assert len(cells) == 5 * 6
    assert sorted(c for c in cells if c[3]) == [(1, "A", "F", "0"), (3, "N", "O", "1"), (3, "N", "O", "1")]


def test_ledger_of_dealt_records(spark, tables):
    records = canonical.kind_records(spark, tables)
    assert records.count() == 5 * 10
    numbers = {(x.respondent_id, x.loop_id): (x.value, x.response_state) for x in records.where("structure_id = 'N'").collect()}
    assert numbers[1, "A"] == ("two", "invalid_out_of_domain") and numbers[2, "R"] == ("1", "answered") and numbers[2, "A"] == (None, "ordinary_missing")
    rows = lambda dealt: sorted(map(str, st.denominator_ledger(records, dealt=dealt).collect()))
    assert rows(True) == rows(False)

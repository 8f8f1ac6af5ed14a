"""Positions and running totals against Python's own sort, in one run and in many."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabuloom.functions.pvalues import student_critical, student_quantile_array
from tabuloom.operators.breakdown import CELL_COLUMNS
from tabuloom.operators.ordering import first_rows, position, running_total
from tabuloom.operators.significance import column_legend, mean_letters, welch_pairs
from tabuloom.operators.weights import DISTRIBUTION_POINTS, weight_distribution


def table(frame, n=400):
    draw = random.Random(5)
    rows = [(draw.choice(["a", "a", "a", "b", None]), draw.choice([None, *range(60)]), i, draw.randint(0, 9))
            for i in range(n)]
    return rows, frame("k string, v int, _run int, w int", rows)


@pytest.mark.parametrize("run_rows", [1, 7, 50, 1 << 20])
def test_positions_and_totals(frame, run_rows):
    rows, df = table(frame)
    got = {r["_run"]: r for r in position(df, ["k"], [F.col("v"), F.col("_run")], "pos", run_rows).collect()}
    sums = {r["_run"]: r["total"] for r in running_total(
        df, ["k"], [F.col("v"), F.col("_run")], F.col("w"), "total", run_rows).collect()}
    for k in ("a", "b", None):
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        total = 0
        for place, r in enumerate(mine, 1):
            total += r[3]
            assert got[r[2]].pos == place and sums[r[2]] == total
    assert got[0].asDict().keys() == {"k", "v", "_run", "w", "pos"}


def test_ties_and_no_key(frame):
    df = frame("v int", [(1,), (1,), (1,), (2,), (None,)])
    got = sorted((r.pos, r.v) for r in position(df, [], [F.col("v")], "pos", 1).collect())
    assert got == [(1, None), (2, 1), (3, 1), (4, 1), (5, 2)]
    assert position(df.limit(0), [], [F.col("v")], "pos").count() == 0


def test_no_window_over_a_key(frame):
    _, df = table(frame)
    plan = position(df, ["k"], [F.col("v")], "pos")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_run" in line for line in windows)


def test_percentiles_by_rank(frame):
    """Against Spark's own exact percentile, in many runs, with ties and one value."""
    draw = random.Random(8)
    rows = [("a", i, float(draw.choice([draw.uniform(0, 9), 2.5, 0.0]))) for i in range(301)] + [("b", 1, 4.0), ("c", 1, 1.0), ("c", 2, 2.0)]
    df = frame("study_id string, respondent_id int, w double", rows)
    points = F.percentile("w", F.array(*[F.lit(p) for p in DISTRIBUTION_POINTS]))
    want = {r.study_id: r.p for r in df.groupBy("study_id").agg(points.alias("p")).collect()}
    for run_rows in (1, 20, 1 << 20):
        got = weight_distribution(df, "w", run_rows=run_rows).collect()
        assert {r.study_id: [r.p1, r.p5, r.median, r.p95, r.p99] for r in got} == want


def test_first_rows(frame):
    _, df = table(frame, 3000)
    want = [tuple(r) for r in df.orderBy("k", "v", "_run").limit(40).collect()]
    for run_rows in (40, 1000):
        assert [tuple(r) for r in first_rows(df, ["k", "v", "_run"], 40, run_rows).collect()] == want
    assert first_rows(df, ["k"], 5000).count() == 3000
    assert first_rows(df.limit(0), ["k"], 5).count() == 0


@pytest.mark.parametrize("alpha", [0.01, 0.05, 0.1])
def test_critical_values(frame, alpha):
    df = np.concatenate([[1.0, 2.0, 64.0, 1e5], np.random.default_rng(0).uniform(1, 3000, 60)])
    rows = frame("df double", [(float(d),) for d in df] + [(None,), (0.0,), (0.5,)])
    got = [r.c for r in rows.select(student_critical(F.col("df"), alpha).alias("c")).collect()]
    assert np.abs(np.array(got[:-3]) / student_quantile_array(1 - alpha / 2, df) - 1).max() < 1e-10
    assert got[-3:] == [None] * 3


def test_mean_letters_of_many_columns_without_pairs(frame):
    """As the pairs say, and without a join or Python."""
    draw = random.Random(3)
    rows = []
    for i in range(150):
        n, mean = draw.randint(20, 60), draw.choice([3.0, 3.4, 5.0])
        m2 = 0.0 if i % 37 == 0 else draw.uniform(10, 60)
        rows.append(("s", "q", f"c{i:03}", "g" if i % 2 else "h", n, mean * n, m2))
    cells = frame("study_id string, question_id string, banner string, banner_group string, rows long, s1 double, m2 double", rows)
    cells = cells.withColumns({c: F.lit(None).cast("string") for c in CELL_COLUMNS if c not in cells.columns})
    pairs = welch_pairs(cells).filter("significant AND difference <> 0").collect()
    want = {}
    for p in pairs:
        high, low = (("l", "r") if p.difference > 0 else ("r", "l"))
        want.setdefault(p[f"banner_{high}"], set()).add(p[f"banner_pos_{low}"])
    letter = {r.banner_pos: r.letter for r in column_legend(cells).collect()}
    found = mean_letters(cells)
    assert {r.banner: r.letters for r in found.collect()} == {b: "".join(letter[p] for p in sorted(ps)) for b, ps in want.items()} and want
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()

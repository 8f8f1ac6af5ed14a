import math
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from conftest import values
from tabuloom.operators import metrics as m
from tabuloom.operators import significance as z
from tabuloom.operators import tables as t
from tabuloom.operators.breakdown import (
    banner_order, breakdown, expand_slices, explode_cells, respondent_dimension,
)

PEOPLE = "study_id string, respondent_id string, person_id string, region int, sex int, w double"


@pytest.fixture()
def people(frame):
    return frame(PEOPLE, [("s", "1", "1", 1, 1, 1.0), ("s", "2", "2", 1, 2, 2.0),
                          ("s", "3", "3", 2, 1, None), ("s", "4", "4", None, 2, 4.0)])


@pytest.fixture()
def options(frame):
    return frame("study_id string, variable string, code string, label string, ord int",
                 [("s", "region", "1.0", "North", 1), ("s", "region", "1", "Late", 2),
                  ("s", "region", "2", "2", 3), ("s", "sex", "1", "Man", 1)])


@pytest.fixture()
def answers(frame):
    return frame("study_id string, question_id string, respondent_id string, response string",
                 [("s", "q", "1", "a"), ("s", "q", "2", "b"), ("s", "q", "3", "a"),
                  ("s", "q", "4", None)])


def test_nested_and_separate_rows(people, options, answers):
    facts = answers.withColumn("n", F.lit(1))
    nested = breakdown(facts, respondent_dimension(people, ["region", "sex"], options))
    separate = breakdown(facts, respondent_dimension(people, ["region", "sex"], options, "separado"))
    assert (nested.count(), separate.count()) == (8, 12)
    assert {r["banner"] for r in nested.collect()} == {
        "Total", "region: 1 | North / sex: 1 | Man", "region: 1 | North / sex: 2",
        "region: 2 / sex: 1 | Man", "region: Sin dato / sex: 2"}
    order = banner_order(separate, ["study_id"]).orderBy("banner_pos").collect()
    assert [r["banner"] for r in order] == [
        "Total", "region: 1 | North", "region: 2", "region: Sin dato", "sex: 1 | Man", "sex: 2"]


def test_single_and_no_banner(people, options, answers):
    facts = answers.withColumn("n", F.lit(1))
    one = breakdown(facts, respondent_dimension(people, ["region"], options, "separate"))
    assert {r["banner"] for r in one.collect()} == {"Total", "1 | North", "2", "Sin dato"}
    none = breakdown(facts, respondent_dimension(people, ["unknown"]))
    assert none.count() == 4


def test_order_numbers_before_texts(frame):
    rows = frame(PEOPLE, [("s", str(i), str(i), v, 1, 1.0) for i, v in enumerate([10, 9, 100])])
    rows = rows.withColumn("mixed", F.when(F.col("region") == 100, "b").otherwise(
        F.col("region").cast("string")))
    order = banner_order(explode_cells(respondent_dimension(rows, "mixed")), ["study_id"])
    assert [r["banner"] for r in order.orderBy("banner_pos").collect()] == ["Total", "9", "10", "b"]


def test_frequency_counts_rows_and_keeps_null(people, answers):
    more = answers.unionByName(answers.filter("respondent_id = '1'"))
    table = m.frequency(more, respondent_dimension(people, None, weight="w"))
    rows = {r["response"]: r for r in table.collect()}
    assert (rows["a"]["n"], rows["a"]["base_respondents"], rows["a"]["base"]) == (3, 2, 5)
    assert rows[None]["n"] == 1
    # A missing weight counts as one.
    assert rows["a"]["n_weighted"] == pytest.approx(1 + 1 + 1)
    assert rows["a"]["pct_weighted"] == pytest.approx(3 / 9)


def test_missing_weight_can_be_excluded(people, answers):
    dimension = respondent_dimension(people, None, weight="w", missing_weight="exclude")
    rows = {r["response"]: r for r in m.frequency(answers, dimension).collect()}
    assert rows["a"]["n"] == 2 and rows["a"]["n_weighted"] == pytest.approx(1.0)


def test_multi_response_bases(frame, people):
    keys = "study_id string, question_id string, respondent_id string"
    mentions = frame(keys + ", response string", [
        ("s", "q", "1", "x"), ("s", "q", "1", "y"), ("s", "q", "2", "x"), ("s", "p", "2", "z")])
    base = frame(keys, [("s", "q", "1"), ("s", "q", "2"), ("s", "q", "3"), ("s", "q", "3")])
    dimension = respondent_dimension(people, None, weight="w")
    eligible = {(r["question_id"], r["response"]): r
                for r in m.multi_response(mentions, dimension, base).collect()}
    assert eligible["q", "x"]["base"] == 3 and eligible["q", "x"]["base_weighted"] == pytest.approx(4)
    assert eligible["q", "x"]["pct_respondents"] == pytest.approx(2 / 3)
    assert eligible["q", "y"]["pct_mentions"] == pytest.approx(1 / 3)
    # A question without base rows falls back on its mentions.
    assert eligible["p", "z"]["base"] == 1
    answered = {r["response"]: r for r in m.multi_response(mentions, dimension).collect()
                if r["question_id"] == "q"}
    assert answered["x"]["base"] == 2
    assert m.mean_mentions(m.multi_response(mentions, dimension, base)).filter(
        "question_id = 'q'").collect()[0]["mean_mentions"] == pytest.approx(1.0)


def test_one_respondent_with_very_many_rows(frame, people):
    """A third of all rows belong to one respondent; results stay exact."""
    rows = [("s", "q", "1", "a")] * 3000 + [("s", "q", str(2 + i % 3), "b") for i in range(6000)]
    facts = frame("study_id string, question_id string, respondent_id string, response string", rows)
    table = m.frequency(facts, respondent_dimension(people, "region")).filter("banner = 'Total'")
    assert values(table, "response", "n", "base_respondents", "base") == [
        ("a", 3000, 1, 9000), ("b", 6000, 3, 9000)]


def scale_rows(frame, rows):
    return frame("study_id string, question_id string, respondent_id string, value double, "
                 "top2box int, bottombox int, nps_group string", rows)


def test_scale_and_nps(frame, people):
    facts = scale_rows(frame, [
        ("s", "q", "1", 9.0, 1, 0, "Promotor"), ("s", "q", "1", 3.0, 0, 0, "Detractor"),
        ("s", "q", "2", 8.0, 0, 0, "Pasivo"), ("s", "q", "4", None, None, None, ""),
        ("s", "q", "4", 10.0, 1, 0, "Promotor")])
    dimension = respondent_dimension(people, None, weight="w")
    row = m.scale_summary(m.cell_moments(facts, dimension)).collect()[0]
    assert row["n"] == 3 and row["mean"] == pytest.approx(7.5)
    assert row["sd"] == pytest.approx(math.sqrt(sum((v - 7.5) ** 2 for v in (9, 3, 8, 10)) / 3))
    assert row["mean_weighted"] == pytest.approx((9 + 3 + 16 + 40) / 8)
    assert row["top2box"] == pytest.approx(0.5)
    nps = m.nps_summary(facts, dimension).collect()[0]
    assert nps["n"] == 3 and nps["promoters"] == pytest.approx(5 / 8)
    assert nps["nps"] == pytest.approx(50.0)


@pytest.mark.parametrize("far", [0.0, 1e8, -1e12])
def test_variance_is_accurate_far_from_zero(frame, people, far):
    # Respondents with 1 to 4 rows, so that their row numbers differ.
    rows = [("s", "q", str(1 + i % 4), far + (i * 7) % 5, None, None, "")
            for i in range(40) if i % 4 <= i // 10]
    row = m.scale_summary(
        m.cell_moments(scale_rows(frame, rows), respondent_dimension(people, None))).collect()[0]
    values = [r[3] - far for r in rows]
    mean = sum(values) / len(values)
    want = math.sqrt(sum((v - mean) ** 2 for v in values) / (len(values) - 1))
    assert row["sd"] == pytest.approx(want, rel=1e-9 if abs(far) < 1e10 else 1e-3)


def test_single_row_has_no_sd(frame, people):
    facts = scale_rows(frame, [("s", "q", "1", 3.0, None, None, "")])
    row = m.scale_summary(m.cell_moments(facts, respondent_dimension(people, None))).collect()[0]
    assert row["sd"] is None and row["mean"] == 3.0 and row["top2box"] is None


def cells_of(frame, rows, groups=None):
    groups = groups or {}
    return frame(
        "study_id string, question_id string, banner string, banner_group string, group_pos int, "
        "response string, n int, base int, pct double",
        [("s", "q", b, groups.get(b, ""), 0, resp, n, base, n / base)
         for b, resp, n, base in rows])


def test_letters_mark_the_higher_column(frame):
    cells = cells_of(frame, [("A", "x", 70, 100), ("B", "x", 30, 100), ("C", "x", 50, 100),
                             ("A", "y", 0, 100), ("B", "y", 0, 100), ("C", "y", 0, 100)])
    letters = {(r["response"], r["banner"]): r["letters"]
               for r in z.proportion_letters(cells).collect()}
    assert letters["x", "A"] == "BC" and letters["x", "C"] == "B" and letters["x", "B"] == ""
    assert letters["y", "A"] == ""


def test_letters_stay_inside_a_variable(frame):
    groups = {"sex: 1": "sex", "sex: 2": "sex", "age: 1": "age", "age: 2": "age"}
    cells = cells_of(frame, [("sex: 1", "x", 70, 100), ("sex: 2", "x", 30, 100),
                             ("age: 1", "x", 90, 100), ("age: 2", "x", 88, 100)], groups)
    cells = cells.withColumn("group_pos", F.when(F.col("banner_group") == "sex", 0).otherwise(1))
    letters = {r["banner"]: r["letters"] for r in z.proportion_letters(cells).collect()}
    assert letters == {"sex: 1": "B", "sex: 2": "", "age: 1": "", "age: 2": ""}


def test_letters_need_a_base(frame):
    cells = cells_of(frame, [("A", "x", 28, 29), ("B", "x", 1, 100)])
    assert {r["letters"] for r in z.proportion_letters(cells).collect()} == {""}


def test_letters_after_z(spark):
    df = spark.range(1, 60).select(F.col("id").cast("int").alias("p"))
    rows = {r["p"]: (r["a"], r["b"]) for r in df.select(
        "p", z.column_letter(F.col("p")).alias("a"), z.spreadsheet_letter(F.col("p")).alias("b")
    ).collect()}
    assert rows[26] == ("Z", "Z") and rows[27] == ("A1", "AA") and rows[53] == ("A27", "BA")


def family(frame, pairs):
    rows = [("f", i, x1, n1, x2, n2, False, True, True) for i, (x1, n1, x2, n2) in enumerate(pairs)]
    return frame("family string, pair_index int, x_l int, n_l int, x_r int, n_r int, "
                 "weighted boolean, independent boolean, binary boolean", rows)


def test_holm_family(frame):
    pairs = [(70, 100, 30, 100), (55, 100, 45, 100), (50, 100, 50, 100), (5, 20, 9, 20), (1, 100, 2, 100)]
    rows = z.proportion_family(family(frame, pairs), ["family"]).orderBy("pair_index").collect()

    def p(x1, n1, x2, n2):
        pooled = (x1 + x2) / (n1 + n2)
        zz = (x1 / n1 - x2 / n2) / math.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n2))
        return math.erfc(abs(zz) / math.sqrt(2))

    raw = [p(*pair) for pair in pairs[:3]]
    assert [r["p_value"] for r in rows[:3]] == pytest.approx(raw, rel=1e-12)
    assert rows[0]["p_adjusted"] == pytest.approx(min(1, 3 * raw[0]), rel=1e-12)
    assert rows[1]["p_adjusted"] == pytest.approx(min(1, 2 * raw[1]), rel=1e-12)
    assert rows[2]["p_adjusted"] == pytest.approx(1.0)
    assert [r["status"] for r in rows] == ["SIGNIFICANT", "NOT_SIGNIFICANT", "NOT_SIGNIFICANT",
                                           "INELIGIBLE", "INELIGIBLE"]
    assert [r["reason"] for r in rows[3:]] == ["INELIGIBLE_MINIMUM_BASE", "INELIGIBLE_EXPECTED_COUNT"]
    assert [r["direction"] for r in rows] == ["LEFT_GREATER", "LEFT_GREATER", None, None, None]


def test_only_three_confidences(frame):
    with pytest.raises(ValueError):
        z.proportion_family(family(frame, [(1, 2, 1, 2)]), ["family"], 0.8)


def test_critical_value_equals_p_decision():
    assert NormalDist().inv_cdf(0.975) == pytest.approx(1.959963984540054)


def test_welch_letters(frame, people):
    rows = []
    for i in range(40):
        rows += [("s", "q", "1", 5.0 + i % 2, None, None, ""), ("s", "q", "3", 3.0 + i % 3, None, None, "")]
    moments = m.cell_moments(scale_rows(frame, rows), respondent_dimension(people, "region"))
    letters = {r["banner"]: r["letters"] for r in z.mean_letters(moments).collect()}
    assert letters == {"1": "B"}


def test_flat_means_differ(frame, people):
    rows = [("s", "q", "1", 5.0, None, None, "")] * 30 + [("s", "q", "3", 4.0, None, None, "")] * 30
    moments = m.cell_moments(scale_rows(frame, rows), respondent_dimension(people, "region"))
    pair = z.welch_pairs(moments).collect()
    assert len(pair) == 1 and pair[0]["p_value"] == 0.0 and pair[0]["significant"]


def test_combine_first_table_wins(frame):
    schema = "study_id string, question_id string, response string, banner string, letters string"
    one = frame(schema, [("s", "q", "x", "A", "B")])
    two = frame(schema, [("s", "q", "x", "A", "C"), ("s", "q", "y", "A", "C")])
    assert values(z.combine_letters([one, two]), "response", "letters") == [("x", "B"), ("y", "C")]


def test_suppression(frame, people):
    facts = frame("study_id string, question_id string, respondent_id string",
                  [("s", "q", "1"), ("s", "q", "2")])
    assert not z.repeated_persons(facts, people).collect()[0]["suppressed"]
    same = people.withColumn("person_id", F.lit("p"))
    assert z.repeated_persons(facts, same).collect()[0]["suppressed"]


def test_report_table(frame, people, answers):
    dimension = respondent_dimension(people, "region")
    cells = m.frequency(answers.filter("response is not null"), dimension)
    scale = m.scale_summary(m.cell_moments(scale_rows(frame, [
        ("s", "q", "1", 4.0, 1, 0, ""), ("s", "q", "2", 2.0, 0, 0, "")]), dimension))
    letters = cells.filter("banner <> 'Total'").select(
        "study_id", "question_id", "response", "banner", F.lit("B").alias("letters"))
    table = t.report_table(["Total", "1", "2"], cells, ["n", "pct", "mean", "top2box"], scale,
                           letters=letters)
    assert [c for c in table.columns if " | " in c][:5] == [
        "Total | n", "Total | pct", "Total | Valor", "1 | n", "1 | pct"]
    assert "1 | Sig." in table.columns and "Total | Sig." not in table.columns
    rows = {r["response"]: r for r in table.collect()}
    assert rows["b"]["2 | n"] == 0 and rows["a"]["2 | pct"] == 100
    assert rows["Media"]["1 | Valor"] == 3.0 and rows["Media"]["2 | Valor"] is None
    assert rows["Top2Box"]["Total | Valor"] == 50.0


def test_slices_drop_outsiders(people):
    slices = expand_slices(people, "region", [("two", 2, "Two"), ("one", 1, "One")])
    assert values(slices, "respondent_id", "slice_id", "slice_order") == [
        ("1", "one", 1), ("2", "one", 1), ("3", "two", 0)]


def test_dense_rank(frame):
    grid = frame("study_id string, question_id string, banner string, entity string, option string, "
                 "pct_respondents double",
                 [("s", "q", "Total", "A", "x", 0.5), ("s", "q", "Total", "A", "y", 0.5),
                  ("s", "q", "Total", "A", "z", 0.1), ("s", "q", "1", "A", "x", 0.9)])
    assert values(t.grid_rank(grid), "option", "rank") == [("x", 1), ("y", 1), ("z", 2)]

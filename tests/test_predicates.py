import pytest
from pyspark.sql import functions as F

from tabuloom.functions.predicates import (
    ResponseColumns, UniverseError, filter_condition, universe_summary, with_universe,
)

SCHEMA = "study_id string, id int, seg string, age double, flag boolean"
ROWS = [("s", 1, "A", 18.0, True), ("s", 2, "B", None, False), ("s", 3, None, 70.0, None),
        ("s", 4, " ", float("nan"), True)]


def eligible(frame, expression, **kwargs):
    df = with_universe(frame(SCHEMA, ROWS), expression, **kwargs)
    return {r["id"] for r in df.collect() if r["eligible"]}


@pytest.mark.parametrize("expression, ids", [
    (("true",), {1, 2, 3, 4}), (("false",), set()),
    (("eq", "seg", "A"), {1}), (("neq", "seg", "A"), {2}),
    (("not", ("neq", "seg", "A")), {1, 3, 4}), (("not", ("eq", "seg", "A")), {2, 3, 4}),
    (("in", "seg", ["A", "B"]), {1, 2}), (("not_in", "seg", ["A"]), {2}),
    (("not", ("not_in", "seg", ["A"])), {1, 3, 4}),
    (("gt", "age", 18), {3}), (("gte", "age", 18), {1, 3}), (("lt", "age", 70), {1}),
    (("lte", "age", 70), {1, 3}), (("not", ("gt", "age", 0)), {2, 4}),
    (("is_missing", "seg"), {3, 4}), (("not_missing", "age"), {1, 3}),
    (("eq", "flag", True), {1, 4}), (("and", ("not_missing", "seg"), ("lt", "age", 50)), {1}),
    (("or", ("eq", "seg", "B"), ("gt", "age", 50)), {2, 3}),
])
def test_truth_tables(frame, expression, ids):
    assert eligible(frame, expression) == ids


@pytest.mark.parametrize("expression", [
    ("eq", "seg", 1), ("eq", "flag", 1), ("in", "seg", []), ("eq", "nope", 1), ("eq", "seg", " "),
    ("what", "seg"), ("universe_ref", "missing"), ("and",),
])
def test_bad_expressions_fail(frame, expression):
    with pytest.raises(UniverseError):
        eligible(frame, expression)


def test_references(frame):
    registry = {"a": {"released": True, "expression": ("eq", "seg", "A")},
                "b": {"released": True, "expression": ("not", ("universe_ref", "a"))},
                "draft": {"released": False, "expression": ("true",)},
                "c1": {"released": True, "expression": ("universe_ref", "c2")},
                "c2": {"released": True, "expression": ("universe_ref", "c1")}}
    assert eligible(frame, ("universe_ref", "b"), registry=registry) == {2, 3, 4}
    for ref in ("draft", "c1"):
        with pytest.raises(UniverseError):
            eligible(frame, ("universe_ref", ref), registry=registry)


def test_summary_keeps_zero(frame):
    df = with_universe(frame(SCHEMA, ROWS), ("eq", "seg", "Z"))
    row = universe_summary(df).collect()[0]
    assert (row["input_n"], row["eligible_n"], row["excluded_n"], row["status"]) == (4, 0, 4, "PASS")


def test_response_states(frame):
    schema = "study_id string, id int, applies boolean, ans boolean, yes array<string>, no array<string>"
    df = frame(schema, [("s", 1, True, True, ["x"], ["y"]), ("s", 2, False, None, [], []),
                        ("s", 3, None, True, ["x"], []), ("s", 4, True, None, ["x"], ["x"]),
                        ("s", 5, True, False, [], [])])
    states = {"Q": ResponseColumns("applies", "ans", "yes", "no")}

    def outcome(expression):
        rows = with_universe(df, expression, states=states).orderBy("id").collect()
        return [(r["eligible"], r["universe_status"]) for r in rows]

    assert outcome(("selected", "Q", "x")) == [(True, 0), (False, 0), (False, 1), (False, 2), (False, 1)]
    assert outcome(("not_selected", "Q", "y")) == [(True, 0), (False, 0), (False, 1), (False, 1), (False, 1)]
    assert outcome(("answered", "Q")) == [(True, 0), (False, 0), (False, 1), (False, 1), (False, 0)]
    assert outcome(("not_answered", "Q"))[4] == (True, 0)


def test_filters(frame):
    df = frame(SCHEMA, ROWS)

    def ids(filters):
        return {r["id"] for r in df.filter(filter_condition(df, filters)).collect()}

    assert ids({"age": ["18"]}) == {1}
    assert ids({"age": [18, None]}) == {1, 2, 4}
    assert ids({"seg": [" A ", "B"]}) == {1, 2}
    assert ids({"seg": ["A", ""]}) == {1, 3, 4}
    assert ids({"other": [1], "seg": []}) == {1, 2, 3, 4}
    assert ids({"seg": ["A"], "age": [70]}) == set()

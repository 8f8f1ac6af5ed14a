"""Each precondition of a paired comparison, broken one at a time."""

import pytest

from tabuloom.operators.pairing import pairing_problems

COMPARISONS = ("study_id string, comparison_id string, metric string, left_question string, "
               "right_question string, option_code string, duplicates string")
ROWS = ("study_id string, comparison_id string, side string, respondent_id string, person_id string, "
        "variable string, value double, scale_min double, scale_max double")
QUESTIONS = "study_id string, question_id string, in_dashboard int, question_type string, parent_question string"


def problems(frame, metric="Media", right="q2", code=None, duplicates="reject", original="p", rows=None,
             types=("Escala", "Escala"), parents=("P", "P"), shown=1, labels=("Bad", "bad ")):
    compared = frame(COMPARISONS, [("s", "c", metric, "q1", right, code, duplicates)])
    people = frame("study_id string, person_id string, original_id string",
                   [("s", f"p{i}", f"{original}{i}") for i in range(4)])
    questions = frame(QUESTIONS, [("s", q, shown, t, p) for q, t, p in zip(("q1", "q2"), types, parents)])
    options = frame("study_id string, question_id string, code string, label string",
                    [("s", q, "1.0", x) for q, x in zip(("q1", "q2"), labels)])
    given = rows or [("s", "c", side, f"{side}{i}", f"p{i}", "v" + side, float(i % 2), 0.0, 10.0)
                     for side in "AB" for i in range(4)]
    found = pairing_problems(compared, people, questions, options, frame(ROWS, given)).collect()
    return {r["problem"]: r["n"] for r in found}


def changed(**at):
    rows = []
    for side in "AB":
        for i in range(4):
            row = {"r": f"{side}{i}", "p": f"p{i}", "v": "v" + side, "x": float(i % 2), "low": 0.0, "high": 10.0}
            if side == "B" and i == 3:
                row |= at
            rows.append(("s", "c", side, row["r"], row["p"], row["v"], row["x"], row["low"], row["high"]))
    return rows


@pytest.mark.parametrize("change,want", [
    ({}, {}),
    ({"original": "R"}, {"IDENTITY": 4}),
    ({"shown": 0}, {"QUESTION": 2}),
    ({"right": "q9", "labels": ("Bad", "bad")}, {"QUESTION": 1, "PARENT": 1, "OPTIONS": 1}),
    ({"types": ("Escala", "RM")}, {"METRIC_TYPE": 1}),
    ({"parents": ("P", "R")}, {"PARENT": 1}),
    ({"parents": (None, " ")}, {"PARENT": 1}),
    ({"labels": ("Bad", "Good")}, {"OPTIONS": 2}),
    ({"metric": "Top2Box", "duplicates": "person_mean"}, {"DUPLICATES": 1}),
    ({"metric": "Mediana"}, {"METRIC": 1}),
    ({"rows": changed(p="p0")}, {"REPEATED_PERSON": 1}),
    ({"rows": changed(p="p0"), "duplicates": "person_mean"}, {}),
    ({"rows": changed(x=float("inf"))}, {"NOT_FINITE": 1}),
    ({"rows": changed(x=2.0), "metric": "Top2Box"}, {"NOT_BINARY": 1}),
    ({"rows": changed(v="other")}, {"SEVERAL_ITEMS": 1}),
    ({"rows": changed(high=7.0)}, {"BOUNDS": 2}),
    ({"rows": changed(r="A1"), "right": "q1"}, {"OVERLAP": 1}),
    ({"metric": "Selección RM", "types": ("RM", "RM"), "code": "1"}, {}),
    ({"metric": "Selección RM", "types": ("RM", "RM"), "code": "2"}, {"OPTION_NOT_DECLARED": 2}),
    ({"metric": "Selección RM", "types": ("RM", "RM"), "code": "x"}, {"OPTION_CODE": 1, "OPTION_NOT_DECLARED": 2}),
])
def test_rule(frame, change, want):
    assert problems(frame, **change) == want

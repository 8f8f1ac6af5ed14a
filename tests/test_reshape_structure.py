import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conftest import values
from tabuloom.operators import reshape as s
from tabuloom.operators import structure as st

BOOK = ("study_id string, variable string, question_id string, question_type string, calculation string, "
        "analytic_class string, in_dashboard string, label string, format_rm string, row_axis_type string, "
        "option_code string, option_label string, is_attached_open string, position int")
LABELS = "study_id string, variable string, code string, label string, ord int"


def rm_item(variable, fmt="", code=None, label=None, question="B", position=0):
    return ("s", variable, question, "RM", "RM % Respondentes", "Pregunta analizable", "si",
            f"label {variable}", fmt, "", code, label, "", position)


def no_labels(frame):
    return frame(LABELS, [])


def test_zero_selection_stays_in_the_base(frame):
    wide = frame("study_id string, respondent_id string, a double, b double",
                 [("s", "1", 1.0, 0.0), ("s", "2", 0.0, 2.0), ("s", "3", 0.0, 0.0), ("s", "4", None, None),
                  ("s", "5", 1.0, 2.0)])
    book = frame(BOOK, [rm_item("a", "codigo_por_opcion", "1", "Uno"),
                        rm_item("b", "codigo_por_opcion", "2", "Dos", position=1)])
    cells = s.unpivot_cells(wide, ["study_id", "respondent_id"], ["a", "b"])
    encodings = s.multi_response_encodings(cells, book, no_labels(frame))
    assert s.encoding_problems(encodings).count() == 0
    long = s.build_multi_response(cells, encodings, book, no_labels(frame))
    assert values(long, "respondent_id", "code", "response") == [
        ("1", "1", "Uno"), ("2", "2", "Dos"), ("5", "1", "Uno"), ("5", "2", "Dos")]
    assert values(s.build_rm_bases(cells, book), "respondent_id") == [("1",), ("2",), ("3",), ("5",)]


def test_incompatible_codes_are_reported(frame):
    wide = frame("study_id string, respondent_id string, a double, b string, c double",
                 [("s", "1", 1.0, "x", 4.0), ("s", "2", 3.0, "1", 4.0)])
    book = frame(BOOK, [rm_item("a", "codigo_por_opcion", "1", "Uno"),
                        rm_item("b", "codigo_por_opcion", "1", "Dos"),
                        rm_item("c", "codigo_por_opcion")])
    cells = s.unpivot_cells(wide, ["study_id", "respondent_id"], ["a", "b", "c"])
    problems = s.encoding_problems(s.multi_response_encodings(cells, book, no_labels(frame)))
    assert values(problems, "variable", "problem") == [
        ("a", "INCOMPATIBLE_CODES"), ("b", "NON_NUMERIC_CODE"), ("c", "NO_LABEL")]


def test_other_encodings(frame):
    wide = frame("study_id string, respondent_id string, q_1 int, q_2 string, m1 int, m2 int",
                 [("s", "1", 1, "Sí", 3, 3), ("s", "2", 0, "no", None, 9)])
    book = frame(BOOK, [rm_item("q_1"), rm_item("q_2", position=1), rm_item("m1", "menciones", question="M"),
                        rm_item("m2", "menciones", question="M", position=1)])
    labels = frame(LABELS, [("s", "q_2", "7", "Dos", 1), ("s", "m1", "3", "Tres", 1), ("s", "m2", "3", "3b", 1),
                            ("s", "m2", "9", "Nueve", 2)])
    cells = s.unpivot_cells(wide, ["study_id", "respondent_id"], ["q_1", "q_2", "m1", "m2"])
    encodings = s.multi_response_encodings(cells, book, labels)
    long = s.build_multi_response(cells, encodings, book, labels)
    assert values(long, "respondent_id", "variable", "code", "response", "format_rm") == [
        ("1", "m1", "3", "Tres", "menciones"), ("1", "q_1", "1", "label q_1", "dicotomica_por_opcion"),
        ("1", "q_2", "7", "Dos", "unitaria_por_opcion"), ("2", "m2", "9", "Nueve", "menciones")]


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_first_mention_survives_any_layout(frame, parts):
    schema = ("study_id string, respondent_id string, question_id string, code string, response string, "
              "variable string, position int")
    rows = [("s", str(i % 5), "q", str(i % 2), f"from {p}", f"v{p}", p) for i in range(20) for p in (3, 1, 2)]
    mentions = frame(schema, rows).repartition(parts)
    assert {r["response"] for r in s.deduplicate_mentions(mentions).collect()} == {"from 1"}


def test_exclusive_with_others(frame):
    schema = "study_id string, respondent_id string, question_id string, response string"
    rows = frame(schema, [("s", "1", "q", "NINGUNA"), ("s", "1", "q", "x"), ("s", "2", "q", "Ninguna"),
                          ("s", "3", "q", "No sabe"), ("s", "3", "q", "ninguno")])
    assert values(s.remove_exclusive(rows), "respondent_id", "response") == [
        ("1", "x"), ("2", "Ninguna"), ("3", "No sabe"), ("3", "ninguno")]


def test_grid_structural_base(frame):
    wide = frame("study_id string, respondent_id string, A_1 int, A_2 int, B_1 int, B_2 int",
                 [("s", "1", 1, None, None, None), ("s", "2", 0, 5, None, 1)])
    names = ["A_1", "A_2", "B_1", "B_2"]
    rows = [("s", v, "G", "G", "GRID_RM", "", v, "", v[0], "", "5" if v[2] == "2" else "", f"o{v[2]}", "", "", "")
            for v in names]
    book = frame("study_id string, variable string, question_id string, grid_id string, question_type string, "
                 "grid_structure string, label string, parent_question string, entity string, entity_label string, "
                 "option_code string, option_label string, row_text string, is_grid_rm_loop string, "
                 "is_attached_open string", rows)
    cells = s.unpivot_cells(wide, ["study_id", "respondent_id"], names)
    grid = s.build_grid_long(cells, book, no_labels(frame))
    got = {(r["respondent_id"], r["variable"]): (r["base_valid"], r["structural_missing"], r["selected"])
           for r in grid.collect()}
    assert got["1", "A_1"] == (1, 0, 1) and got["1", "A_2"] == (1, 0, 0)
    assert got["1", "B_1"] == (0, 1, 0)
    assert got["2", "A_1"] == (1, 0, 0) and got["2", "A_2"] == (1, 0, 1) and got["2", "B_2"] == (1, 0, 1)


def scale_book(frame, rows):
    return frame("study_id string, variable string, question_type string, calculation string, scale_min string, "
                 "scale_max string, question_id string, in_dashboard string, label string, question_text string",
                 [("s", v, kind, "Media", low, high, v, "si", "", "") for v, kind, low, high in rows])


def test_scale_bounds(frame):
    book = scale_book(frame, [("d", "Escala", "1", "7"), ("n", "NPS", "", ""), ("l", "Escala", "", ""),
                              ("gap", "Escala", "", ""), ("half", "Escala", "1", ""), ("inv", "Escala", "5", "1"),
                              ("none", "Escala", "", "")])
    labels = frame(LABELS, [("s", "l", str(i), "x", i) for i in (3, 1, 2)] +
                   [("s", "gap", "1", "x", 1), ("s", "gap", "1.5", "x", 2), ("s", "gap", "3", "x", 3)])
    got = {r["variable"]: (r["low"], r["high"], r["bounds_problem"])
           for r in s.scale_bounds(book, labels).collect()}
    assert got == {"d": (1, 7, False), "n": (0, 10, False), "l": (1, 3, False), "gap": (None, None, False),
                   "half": (None, None, True), "inv": (None, None, True), "none": (None, None, False)}


def test_scale_long_and_outside(frame):
    wide = frame("study_id string, respondent_id string, d double, none double",
                 [("s", "1", 7.0, 2.0), ("s", "2", 9.0, None), ("s", "3", float("nan"), 1.0)])
    book = scale_book(frame, [("d", "Escala", "1", "7"), ("none", "Escala", "", "")])
    cells = s.unpivot_cells(wide, ["study_id", "respondent_id"], ["d", "none"])
    long = s.build_scale_long(cells, book, no_labels(frame))
    assert values(s.out_of_scale(long), "variable", "n_outside") == [("d", 1)]
    rows = {(r["respondent_id"], r["variable"]): (r["top2box"], r["nps_group"]) for r in long.collect()}
    assert rows == {("1", "d"): (1, ""), ("2", "d"): (1, ""), ("1", "none"): (None, ""), ("3", "none"): (None, "")}


def test_open_ended(frame):
    texts = frame("study_id string, value string", [("s", "  Muy   bueno "), ("s", "No Aplica"), ("s", "N/A"),
                                                    ("s", None), ("s", "ningúno"), ("s", "...")])
    assert values(s.open_ended_text(texts), "original_text", "clean_text") == [("Muy bueno", "muy bueno")]


def test_respondent_keys(frame):
    schema = "study_id string, row_index int, Folio string, sexo int"
    unique = frame(schema, [("s", 0, " a ", 1), ("s", 1, "b", 2)])
    assert values(s.build_respondents(unique, ["sexo"]), "respondent_id", "person_id") == [("a", "a"), ("b", "b")]
    repeated = frame(schema, [("s", 0, "a", 1), ("s", 1, "a", 2)])
    assert values(s.build_respondents(repeated, []), "respondent_id", "person_id") == [
        ("R000001", "a"), ("R000002", "a")]
    blank = frame(schema, [("s", 0, "a", 1), ("s", 1, None, 2)])
    assert values(s.build_respondents(blank, []), "respondent_id", "person_id") == [
        ("R000001", "R000001"), ("R000002", "R000002")]
    with pytest.raises(PySparkException, match="blank values"):
        s.build_respondents(blank, [], declared_ids=["Folio"]).count()
    with pytest.raises(s.ReshapeError):
        s.build_respondents(unique, [], declared_ids=["Folio", "sexo"])


def records(frame, rows, kind="RM", policy=False):
    cells = s.typed_cells(frame("study_id string, respondent_id string, variable string, value string, "
                                "applicable boolean", rows))
    bindings = frame("study_id string, structure_id string, structure_type string, variable string, "
                     "binding_id string, row_id string, column_id string, option_id string, loop_id string, "
                     "entity_id string, missing_is_unanswered boolean",
                     [("s", "S", kind, v, v, None, None, v, None, None, policy) for v in ("a", "b")])
    rules = frame("study_id string, structure_id string, code string, role string, category_id string, ord int",
                  [("s", "S", "1", "selected", None, 0), ("s", "S", "0", "not_selected", None, 0),
                   ("s", "S", "99", "missing", None, 0), ("s", "S", "1", "category", "c1", 0),
                   ("s", "S", "1", "category", "c2", 1)])
    return st.response_records(cells, bindings, rules)


ROWS = [("s", "1", "a", "1", True), ("s", "1", "b", "0", True), ("s", "2", "a", "0.0", True),
        ("s", "2", "b", " ", True), ("s", "3", "a", "99", True), ("s", "3", "b", "5", True),
        ("s", "4", "a", "1", False), ("s", "4", "b", None, True)]


def test_states_and_ledger(frame):
    rows = records(frame, ROWS)
    assert values(rows, "respondent_id", "variable", "response_state") == [
        ("1", "a", "selected"), ("1", "b", "not_selected"), ("2", "a", "not_selected"),
        ("2", "b", "ordinary_missing"), ("3", "a", "ordinary_missing"), ("3", "b", "invalid_out_of_domain"),
        ("4", "a", "structural_missing"), ("4", "b", "ordinary_missing")]
    ledger = st.denominator_ledger(rows).collect()[0]
    assert (ledger["unit"], ledger["denominator_n"], ledger["selected_n"], ledger["not_selected_n"],
            ledger["ordinary_missing_n"], ledger["structural_missing_n"], ledger["invalid_n"]) == (
        "respondent_option", 3, 1, 2, 3, 1, 1)
    shares = {r["option_id"]: (r["numerator"], r["denominator"]) for r in
              st.option_shares(rows, ["study_id"]).collect()}
    assert shares == {"a": (1, 2), "b": (0, 1)}


def test_single_choice_states(frame):
    rows = records(frame, ROWS, "RU", policy=True)
    states = {(r["respondent_id"], r["variable"]): (r["response_state"], r["category_id"]) for r in rows.collect()}
    assert states["1", "a"] == ("valid_category", "c1")
    assert states["1", "b"] == ("invalid_out_of_domain", None)
    assert states["2", "b"] == ("not_answered", None)
    ledger = st.denominator_ledger(rows).collect()[0]
    # Three respondents with an applicable binding besides respondent 4's second one.
    assert (ledger["unit"], ledger["denominator_n"], ledger["valid_n"]) == ("respondent", 4, 0)


def test_zero_base(frame):
    rows = records(frame, [("s", "1", "a", None, True)])
    ledger = st.denominator_ledger(rows).collect()[0]
    assert (ledger["denominator_n"], ledger["zero_base_status"]) == (0, "VALID_ZERO_BASE")


def test_unknown_scope(frame):
    with pytest.raises(ValueError):
        st.mention_ledger(records(frame, ROWS), "RELEASED_GROUP")


def test_duplicate_policies(frame):
    rows = records(frame, [("s", "1", "a", "1", True), ("s", "1", "a", "1", True), ("s", "1", "b", "1", True)])
    keep = st.scope_totals(st.mention_ledger(rows, duplicates="keep")).collect()[0]["denominator_n"]
    once = st.scope_totals(st.mention_ledger(rows)).collect()[0]["denominator_n"]
    assert (keep, once) == (3, 2)
    assert st.duplicate_mentions(rows).count() == 1
    exclusive = rows.select("study_id", "structure_id", F.lit("b").alias("option_id"))
    assert st.exclusive_conflicts(rows, exclusive).count() == 1

"""Attributes by data, scales of a report, base texts, ledgers of slices and scopes."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conftest import values
from tabuloom.operators import profile as pf
from tabuloom.operators import quality as q
from tabuloom.operators import reshape as s
from tabuloom.operators import structure as st
from tabuloom.plans.tabulate import Request, tabulate


def test_attributes_by_class_role_and_safety(frame):
    wide = frame("study_id string, row_index int, seg string, folio string, w double, `a b` string", [
        ("x", 0, "n", "1", 1.5, "u"), ("x", 1, "s", "2", 1.5, "v"), ("y", 0, "n", "3", 2.5, "u"), ("y", 1, "n", "4", 2.5, "u")])
    book = frame("study_id string, variable string, analytic_class string, is_weight boolean", [
        ("x", "seg", "Banner", False), ("x", "folio", "Filtro", False), ("x", "w", "Pregunta analizable", True),
        ("x", "a b", "Pregunta analizable", False), ("y", "seg", "Banner", None), ("y", "a b", None, None)])
    cells = s.unpivot_cells(wide, ["study_id"], ["seg", "folio", "w", "a b"])
    safety = pf.variable_safety(cells, book)
    assert values(s.role_variables(book, safety), "study_id", "variable") == [("x", "seg"), ("x", "w")]
    people = s.build_respondents(wide, [], id_column="folio")
    got = s.with_attributes(people, wide, ["seg", "folio", "w", "a b"], book, safety)
    assert {(r.study_id, r.respondent_id): r.attributes for r in got.collect()} == {
        ("x", "1"): {"seg": "n", "w": "1.5"}, ("x", "2"): {"seg": "s", "w": "1.5"}, ("y", "3"): {}, ("y", "4"): {}}
    assert got.columns[:6] == people.columns


def report(frame, answers, bounds):
    people = frame("study_id string, respondent_id int, person_id int", [("s", i, i) for i in range(4)])
    responses = frame("study_id string, question_id string, respondent_id int, code string, response string, value double",
                      [("s", q_, i, str(v), str(v), float(v)) for q_, vs in answers.items() for i, v in enumerate(vs)])
    scales = frame("study_id string, question_id string, respondent_id int, value double, top2box int, bottombox int, nps_group string",
                   [("s", "E", i, float(i), 0, 1, "") for i in range(4)])
    limits = frame("study_id string, question_id string, scale_min double, scale_max double, nps boolean", bounds)
    return tabulate({"respondents": people, "responses": responses, "scales": scales, "scale_bounds": limits}, Request())


def test_report_scores_single_choices_of_scales_without_rows(frame):
    bounds = [("s", "P", 1.0, 5.0, False), ("s", "E", 0.0, 9.0, False), ("s", "Z", 0.0, 1.0, True)]
    got = report(frame, {"P": [1, 2, 5, 4], "E": [9, 9, 9, 9], "O": [1, 1, 1, 1]}, bounds).scale
    assert {r.question_id: (r.mean, r.top2box) for r in got.collect()} == {"P": (3.0, 0.5), "E": (1.5, 0.0)}
    with pytest.raises(PySparkException, match="outside the declared scale of question P"):
        report(frame, {"P": [1, 7, 1, 1]}, bounds).scale.collect()


def test_base_text_of_banner_rows(frame):
    cells = s.unpivot_cells(frame("study_id string, v int, many int", [("s", i % 2, i) for i in range(60)]), ["study_id"], ["v", "many"])
    labels = frame("study_id string, variable string, code string, label string, ord int", [("s", "v", "1", "Uno", 1), ("s", "old", "2", "Dos", 1)])
    advice = frame("study_id string, variable string, kind string, label string, justification string, use string, base_distribution string, "
                   "is_banner_recommended boolean, is_filter_recommended boolean", [
        ("s", "v", "banner_filtro", "Ve", "1: 30", None, "1: 9", True, True), ("s", "many", "banner_filtro", "", "porque", None, None, True, False),
        ("s", "old", "banner_filtro", "", None, "uso", "2: 1200; 3: 4", False, True), ("s", "v", "orden_menu", "", "1: 30", None, "1: 9", True, False)])
    safety = pf.variable_safety(cells, advice)
    got = {(r.variable, r.kind): (r.base_distribution, r.justification) for r in pf.with_base_distribution(advice, cells, labels, safety).collect()}
    assert got["v", "banner_filtro"][0] == "Código 0 n=30; Uno n=30" and got["v", "banner_filtro"][1].startswith("Ve se recomienda como banner y filtro")
    assert got["many", "banner_filtro"] == ("", "porque") or got["many", "banner_filtro"] == (None, "porque")
    assert got["old", "banner_filtro"] == ("Dos n=1,200; Código 3 n=4", None)
    assert got["v", "orden_menu"] == ("1: 9", "1: 30")


COLUMNS = ("study_id string, structure_id string, structure_type string, respondent_id int, row_id string, entity_id string, loop_id string, "
           "column_id string, category_id string, option_id string, binding_id string, response_state string, applicable boolean")


def record(kind, person, state, option=None, row=None, entity=None, loop=None, binding="b"):
    return ("s", kind, kind, person, row, entity, loop, None, None, option, binding, state, state != "structural_missing")


def test_ledgers_of_slices_at_once(frame):
    rows = [record("RM", i, "selected" if i % 3 else "not_selected", option=o) for i in range(12) for o in "ab"]
    rows += [record("LOOP_NUMERICO", i, "answered" if i % 2 else "ordinary_missing", loop=x, binding=x) for i in range(12) for x in ("l1", "l2")]
    rows += [record("LOOP_NUMERICO", 3, "answered", binding=x) for x in ("p", "q")]
    records = frame(COLUMNS, rows)
    slices = frame("study_id string, respondent_id int, slice_id string", [("s", i, name) for i in range(12) for name, inside in (("all", True), ("low", i < 4)) if inside])
    together = {(r.structure_id, r.slice_id): r.asDict() for r in st.slice_ledgers(records, slices).collect()}
    for name, few in (("all", records), ("low", records.filter("respondent_id < 4"))):
        for r in st.denominator_ledger(few).collect():
            assert {k: v for k, v in together[r.structure_id, name].items() if k != "slice_id"} == r.asDict()
    assert together["LOOP_NUMERICO", "all"]["denominator_n"] == 26 and together["LOOP_NUMERICO", "all"]["repeated_dependency"]
    assert together["RM", "low"]["selected_n"] == 4
    diff = q.differing_slices(st.slice_ledgers(records, slices), "all", "low", ["study_id", "structure_id"], ["selected_n", "invalid_n"])
    assert values(diff, "structure_id", "measure", "left_count", "right_count") == [("RM", "selected_n", 16.0, 4.0)]


def test_mentions_of_all_scopes(frame):
    rows = [record("GRID_RM", i, "selected", option=o, row=f"r{i % 2}", entity="e", loop=None if i else "l0") for i in range(4) for o in "ab"]
    rows += [record("GRID_RM", 1, "selected", option="a", row="r1", entity="e"), record("RU", 1, "valid_category", row="r1")]
    ledger = st.mention_ledgers(frame(COLUMNS, rows))
    got = {(r.scope, r.scope_ref, r.option_key): (r.mentions, r.mention_rows) for r in ledger.collect()}
    assert got["PARENT_RM", "GRID_RM", "a"] == (4, 5) and got["ROW", "r1", "a"] == (2, 3) and got["ENTITY", "e", "b"] == (4, 4)
    assert got["LOOP_INSTANCE", "l0", "a"] == (1, 1) and len(got) == 2 * 5
    for scope in st.SCOPES:
        for policy, place in (("error", 0), ("keep", 1)):
            one = {(r.scope_ref, r.option_key): r.mentions for r in st.mention_ledger(frame(COLUMNS, rows), scope, duplicates=policy).collect()}
            assert one == {(ref, o): n[place] for (sc, ref, o), n in got.items() if sc == scope}


def test_categories_need_a_shared_column(frame):
    with pytest.raises(ValueError, match="study_id"):
        st.category_shares(frame(COLUMNS, []), ["study_id"], frame("category_id string", [("c",)]))


def test_lookups_never_multiply_cells(frame):
    from tabuloom.operators.tables import with_lookups

    cells = frame("study_id string, question_id string, n int", [("s", "a", 1), ("s", "a", 2), ("s", "b", 3)])
    kinds = frame("study_id string, question_id string, n int, kind string", [("s", "a", 9, "y"), ("s", "a", 9, "x"), ("t", "b", 9, "z")])
    grids = frame("study_id string, question_id string, grid string", [("s", "b", "g")])
    got = with_lookups(cells, kinds, grids)
    assert got.columns == ["study_id", "question_id", "n", "kind", "grid"]
    assert values(got.fillna("-"), "n", "kind", "grid") == [(1, "x", "-"), (2, "x", "-"), (3, "-", "g")]

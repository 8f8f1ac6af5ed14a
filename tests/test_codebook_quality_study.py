import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conftest import values
from tabuloom.operators import bands as b
from tabuloom.operators import codebook as cb
from tabuloom.operators import detect as dt
from tabuloom.operators import quality as q
from tabuloom.plans.tabulate import Request, report_cells, tabulate
from tabuloom.sources import study as src


@pytest.mark.parametrize("name, expected", [
    ("i_MARCA_Q5_3", ("Q5", "MARCA", "3")), ("i_MARCA_Q5", ("Q5", "MARCA", "")),
    ("Q_1_SABOR", ("SABOR", "Q_1", "")), ("Q5_OTRO", ("Q5", "", "OTRO")),
    ("BRAND_A_REASON_1", ("BRAND_A_REASON", "REASON", "1")), ("Q5_2", ("Q5", "", "2")),
    ("SAT_PRECIO", ("SAT", "PRECIO", "PRECIO")), ("Q5b", ("Q5", "b", "b")), ("EDAD", ("EDAD", "", "")),
])
def test_variable_names(spark, name, expected):
    row = spark.range(1).select(dt.parse_name(F.lit(name)).alias("p")).select("p.*").collect()[0]
    assert tuple(row) == expected


def test_explode_keeps_dots(frame):
    sheet = frame("study_id string, names string", [("s", "Q1.a, Q1.a; P_2 y @x")])
    assert [r["variable"] for r in cb.explode_variables(sheet, "names").collect()] == ["Q1.a", "P_2", "y", "@x"]


def test_repeated_questions_need_an_axis(frame):
    schema = ("study_id string, variable string, question_id string, question_type string, row_axis_type string, "
              "row_axis_value string, question_text string")
    book = cb.fill_defaults(frame(schema, [
        ("s", "a", "Q", "RU", "marca", "A", "T"), ("s", "b", "Q", "RU", "marca", "B", "T"),
        ("s", "c", "X", "RU", "marca", "", "T"), ("s", "d", "X", "RU", "marca", "B", "T"),
        ("s", "e", "D", "RU", "m", "B", "T"), ("s", "f", "D", "RU", "m", "B", "T"),
        ("s", "g", "M", "RM", "", "", "T"), ("s", "h", "M", "RM", "", "", "T")]))
    split, problems = cb.separate_repeated(book)
    assert values(problems, "question_id", "problem") == [("D", "DUPLICATE_LABELS"), ("X", "NO_SINGLE_AXIS")]
    rows = {r["variable"]: (r["question_id"], r["question_text"]) for r in split.collect()}
    assert rows["a"] == ("Q::a", "T [marca: A]") and rows["g"] == ("M", "T")


@pytest.mark.parametrize("text, flags, expected", [
    ("GRID RM x", {}, "GRID_RM/LOOP_RM"), ("grid_escala", {}, "GRID_ESCALA"), ("NPS", {}, "NPS"),
    ("", {"in_scale"}, "Escala"), ("Media", {}, "Escala"), ("", {"in_multi"}, "RM"), ("", {"repeats"}, "RM"),
    ("RM codificada", {}, "RM"), ("", {"in_responses"}, "RU"), ("", {"in_open"}, "Abierta"),
    ("", {}, "Requiere validación"), ("loop_numerico", {"in_scale"}, "LOOP_NUMERICO"),
])
def test_infer_type(spark, text, flags, expected):
    given = [F.lit(n in flags) for n in ("in_responses", "in_multi", "in_scale", "in_open", "repeats")]
    assert spark.range(1).select(cb.infer_type(F.lit(text), *given).alias("t")).collect()[0]["t"] == expected


def test_bands(spark):
    bands = [("18-49", 18, 49), ("50-59", 50, 59), ("60-69", 60, 69), ("70+", 70, None)]
    df = spark.createDataFrame([(v,) for v in (18, 49, 50, 69, 70, None, 17)], "v int")
    assert [r["b"] for r in df.select(b.apply_bands(F.col("v"), bands).alias("b")).collect()] == [
        "18-49", "18-49", "50-59", "60-69", "70+", None, None]
    for bad in ([], [("a", None, None)], [("a", 5, 1)], [("a", 1, 2), ("a", 3, 4)], [("a", 1, 2), ("b", 2, 3)]):
        with pytest.raises(ValueError):
            b.check_bands(bad)


def test_fingerprint_ignores_order_not_content(frame):
    rows = [("s", i, f"v{i}") for i in range(50)]
    one = q.result_fingerprint(frame("study_id string, n int, t string", rows)).collect()[0]
    shuffled = frame("study_id string, n int, t string", rows[::-1]).repartition(5)
    assert q.result_fingerprint(shuffled).collect()[0]["fingerprint"] == one["fingerprint"]
    twice = frame("study_id string, n int, t string", rows + rows[:1])
    assert q.result_fingerprint(twice).collect()[0]["fingerprint"] != one["fingerprint"]
    other = frame("study_id string, n int, t string", rows[:-1] + [("s", 49, None)])
    assert q.result_fingerprint(other).collect()[0]["fingerprint"] != one["fingerprint"]


def test_release_states(frame):
    runs = frame("run_id string, computation_status string, release_evidence boolean",
                 [("bad", "FAILED", True), ("block", "COMPLETE", True), ("rev", "COMPLETE", True),
                  ("warn", "COMPLETE", True), ("none", "COMPLETE", False), ("ok", "COMPLETE", True)])
    events = frame("run_id string, state string, blocking boolean",
                   [("block", "FAIL", True), ("rev", "REVIEW_REQUIRED", False), ("warn", "WARNING", False)])
    assert values(q.release_state(events, runs), "run_id", "qa_release_status", "releasable") == [
        ("bad", "FAIL", False), ("block", "FAIL", False), ("none", "REVIEW_REQUIRED", False),
        ("ok", "PASS", True), ("rev", "REVIEW_REQUIRED", False), ("warn", "PASS_WITH_WARNINGS", True)]


def study_tables(frame):
    people = frame("study_id string, respondent_id string, person_id string, sex string, status string",
                   [("s", str(i), str(i), "mf"[i % 2], "on" if i % 3 else "off") for i in range(120)])
    # Men say yes in one case of ten, women in nine; both cells must exist to be tested.
    yes = [(i % 2 == 1) != (i % 20 in (0, 1)) for i in range(120)]
    responses = frame(src.SCHEMAS["responses"], [
        ("s", str(i), "q1", "v1", "RU", str(int(yes[i])), "yes" if yes[i] else "no", None, "", True)
        for i in range(120)])
    questions = frame("study_id string, question_id string, question_text string, question_type string, "
                      "calculation string, analysis_unit string", [("s", "q1", "Q?", "RU", "Frecuencia", "evaluacion")])
    variables = frame("study_id string, variable string, question_id string, analytic_class string",
                      [("s", "v1", "q1", "Pregunta analizable")])
    options = frame("study_id string, variable string, question_id string, code string, label string, ord int",
                    [("s", "v1", "q1", "0", "no", 1), ("s", "v1", "q1", "1", "yes", 2)])
    config = frame("study_id string, role string, variable string", [("s", "banner", "sex")])
    return {"respondents": people, "responses": responses, "questions": questions, "variables": variables,
            "options": options, "configuration": config}


def test_study_round_trip(spark, frame, tmp_path):
    path = str(tmp_path / "study")
    assert src.validate_study(spark, path) == (False, [], "no study")
    tables = study_tables(frame)
    src.write_study({"respondents": tables["respondents"]}, path)
    assert src.validate_study(spark, path)[0] is False
    src.write_study(tables, path)
    assert src.validate_study(spark, path)[0] is True
    rows = src.scan_question(spark, path, "responses", "q1")
    assert rows.count() == 120
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(question_id" in plan
    assert src.read_table(spark, path, "scales").count() == 0
    # A new version replaces the study as a whole.
    src.write_study({**tables, "responses": tables["responses"].filter("code = '1'")}, path)
    assert src.scan_question(spark, path, "responses", "q1").count() == 60


def test_export_guard(spark, frame, tmp_path):
    cells = frame("study_id string, n int", [("s", 1)])
    state = frame("qa_release_status string, releasable boolean", [("REVIEW_REQUIRED", False)])
    with pytest.raises(src.StudyError):
        src.export_result(cells, state, str(tmp_path / "official"))
    src.export_result(cells, state, str(tmp_path / "review"), official=False)
    row = spark.read.csv(str(tmp_path / "review"), header=True).collect()[0]
    assert (row["export_path"], row["release_releasable"], row["n"]) == ("REVIEW", "false", "1")


def test_flat_fact_names(frame):
    tables = study_tables(frame)
    tables["respondents"] = tables["respondents"].withColumn("code", F.col("sex"))
    flat = src.flat_fact(tables, ["code", "sex"], ["status", "sex", "person_id"])
    assert flat.columns[-4:] == ["banner_code", "sex", "filter_1", "filter_2"]
    assert flat.count() == 120 and flat.filter("filter_1 = 'on'").count() == 80


def test_tabulate_letters_and_suppression(frame):
    tables = study_tables(frame)
    report = tabulate(tables, Request(["sex"], significance=True))
    rows = {(r["response"], r["banner"]): r["letters"] for r in report.letters.collect()}
    assert rows["yes", "f"] == "B" and rows["no", "m"] == "A"
    cells = report_cells(report, ["n", "pct"])
    assert cells.count() == 2 * (2 + 2 + 2)
    repeated = dict(tables)
    repeated["respondents"] = tables["respondents"].withColumn("person_id", F.lit("p"))
    assert tabulate(repeated, Request(["sex"], significance=True)).letters.count() == 0


def test_tabulate_person_unit(frame):
    tables = study_tables(frame)
    tables["questions"] = tables["questions"].withColumn("analysis_unit", F.lit("Persona"))
    pair = (F.col("respondent_id").cast("int") % 60).cast("string")
    tables["respondents"] = tables["respondents"].withColumns({"person_id": pair, "sex": F.when(
        pair.cast("int") % 2 == 0, "m").otherwise("f")})
    report = tabulate(tables, Request(["sex"]))
    total = report.frequency.filter("banner = 'Total'").agg(F.sum("n").alias("n")).collect()[0]["n"]
    assert total == 60


def test_derived_variable(frame):
    tables = study_tables(frame)
    tables["questions"] = tables["questions"].withColumn("questionnaire_order", F.lit(3.0))
    value = F.col("respondent_id").cast("double")
    done = b.add_derived(tables, value, "v1", "band", "Tramo", [("low", None, 49), ("high", 50, None)])
    assert done["responses"].filter("question_id = 'band'").count() == 120
    order = done["questions"].filter("question_id = 'band'").collect()[0]["questionnaire_order"]
    assert order == pytest.approx(3.001)
    refused = b.add_derived(tables, value, "v1", "v1", "x", [("low", None, 49)])
    with pytest.raises(PySparkException, match="v1 exists"):
        refused["variables"].collect()
    again = b.add_derived(done, value, "v1", "band", "Tramo", [("all", None, 500)])
    assert again["options"].filter("variable = 'band'").count() == 1
    gone = b.remove_derived(again, ["band"])
    assert "band" not in gone["respondents"].columns and gone["responses"].count() == 120


def test_stored_buckets_need_no_shuffle_below_the_cells(spark, frame, tmp_path):
    """Above the scans the plan exchanges cells and totals only, also with a join that is not broadcast."""
    from tabuloom.operators.breakdown import respondent_dimension
    from tabuloom.operators.metrics import frequency

    people = frame("study_id string, respondent_id string, seg string", [("s", str(i), "ab"[i % 2]) for i in range(40)])
    facts = frame("study_id string, respondent_id string, question_id string, response string",
                  [("s", str(i % 40), f"Q{i % 3}", str(i % 5)) for i in range(400)])
    want = {tuple(r) for r in frequency(facts, respondent_dimension(people, "seg")).select("question_id", "banner", "response", "n", "base").collect()}
    src.write_study({"respondents": people, "responses": facts}, str(tmp_path / "study"), buckets=4)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        stored = {n: src.read_table(spark, str(tmp_path / "study"), n) for n in ("respondents", "responses")}
        cells = frequency(stored["responses"], respondent_dimension(stored["respondents"], "seg"))
        assert {tuple(r) for r in cells.select("question_id", "banner", "response", "n", "base").collect()} == want
        plan = cells._jdf.queryExecution().executedPlan().toString()
        exchanges = [line for line in plan.splitlines() if "Exchange hash" in line]
        assert exchanges and all("banner" in line for line in exchanges)
        assert "Join" in plan and src.scan_question(spark, str(tmp_path / "study"), "responses", "Q1").count() == 133
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        spark.conf.set("spark.sql.adaptive.enabled", "true")

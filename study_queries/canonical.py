"""Universes, response states, ledgers and canonical metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from study_queries import roles as r
from study_queries.core import big, r6
from tabuloom.functions.predicates import (
    ResponseColumns, UniverseContext, applicability, universe_summary, with_universe,
)
from tabuloom.operators import quality as q
from tabuloom.operators import structure as st
from tabuloom.operators.breakdown import expand_slices
from tabuloom.operators.reshape import typed_cells

QUERIES, SQL = {}, {}


def register(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function
    return add


REGISTRY = {
    "late": {"released": True, "expression": ("not", ("in", "wave", [0, 1]))},
    "adult": {"released": True, "expression": (
        "or", ("gte", "balance", 5000.0), ("and", ("universe_ref", "late"),
                                           ("neq", "segment", "BUILDING")))},
}


@register("f5_universe", f"""
WITH {r.CUSTOMERS_SQL},
u AS (SELECT study_id, wave IS NULL AS missing_wave, balance >= 5000 OR
  (NOT coalesce(wave IN (0, 1), false) AND segment <> 'BUILDING') AS e1,
  NOT coalesce(wave <> 2, false) AS e2 FROM customers)
SELECT study_id, missing_wave, e1 AS eligible, e2 AS not_neq, CAST(count(*) AS BIGINT) AS n
FROM u GROUP BY ALL""")
def f5_universe(spark: SparkSession, path: str) -> DataFrame:
    """Missing values make every comparison false, and `not` turns that to true."""
    people = r.customers(spark, path)
    first = with_universe(people, ("universe_ref", "adult"), REGISTRY)
    second = with_universe(
        first.withColumnRenamed("eligible", "e1").drop("universe_status"),
        ("not", ("neq", "wave", 2)))
    return second.groupBy(
        "study_id", F.col("wave").isNull().alias("missing_wave"),
        F.col("e1").alias("eligible"), F.col("eligible").alias("not_neq"),
    ).agg(F.count("*").alias("n"))


@register("f7_universe_summary", f"""
WITH {r.CUSTOMERS_SQL}
SELECT study_id, CAST(count(*) AS BIGINT) AS input_n,
  CAST(count(*) FILTER (WHERE balance >= 5000 OR
    (NOT coalesce(wave IN (0, 1), false) AND segment <> 'BUILDING')) AS BIGINT) AS eligible_n,
  CAST(count(*) FILTER (WHERE NOT (balance >= 5000 OR
    (NOT coalesce(wave IN (0, 1), false) AND segment <> 'BUILDING'))) AS BIGINT) AS excluded_n,
  'PASS' AS status FROM customers GROUP BY ALL""")
def f7_universe_summary(spark: SparkSession, path: str) -> DataFrame:
    people = with_universe(r.customers(spark, path), ("universe_ref", "adult"), REGISTRY)
    return universe_summary(people)


@register("f6_response_states", f"""
WITH {r.EVENT_RESPONDENTS_SQL},
t AS (SELECT study_id, respondent_id, bool_or(code = 'click') AS click, bool_or(code = 'view') AS v
      FROM event_days GROUP BY ALL),
s AS (SELECT e.study_id, CASE WHEN day % 5 = 0 THEN NULL WHEN day % 5 = 1 THEN false ELSE true END AS a,
        click, v FROM event_respondents e JOIN t USING (study_id, respondent_id))
SELECT study_id, CAST(count(*) AS BIGINT) AS input_n,
  CAST(count(*) FILTER (WHERE coalesce(a, false) AND click) AS BIGINT) AS selected_n,
  CAST(count(*) FILTER (WHERE coalesce(a, false) AND NOT v) AS BIGINT) AS not_selected_n,
  CAST(count(*) FILTER (WHERE a IS NULL) AS BIGINT) AS unsupported_n
FROM s GROUP BY ALL""")
def f6_response_states(spark: SparkSession, path: str) -> DataFrame:
    chosen = r.event_days(spark, path).groupBy("study_id", "respondent_id").agg(
        F.collect_set("code").alias("chosen"))
    everything = F.array(*[F.lit(c) for c in ("click", "error", "purchase", "signup", "view")])
    people = r.event_respondents(spark, path).join(chosen, ["study_id", "respondent_id"])
    day = F.col("day") % 5
    states = people.withColumns({
        "applies": F.when(day == 0, None).when(day == 1, False).otherwise(True),
        "answered": F.lit(True), "refused": F.array_except(everything, "chosen"),
    })
    columns = {"ACT": ResponseColumns("applies", "answered", "chosen", "refused")}
    one = with_universe(states, ("selected", "ACT", "click"), {}, columns).withColumnsRenamed(
        {"eligible": "picked", "universe_status": "first_status"})
    two = with_universe(one, ("not_selected", "ACT", "view"), {}, columns)
    return two.groupBy("study_id").agg(
        F.count("*").alias("input_n"), F.count_if("picked").alias("selected_n"),
        F.count_if("eligible").alias("not_selected_n"),
        F.count_if(F.col("first_status") == 1).alias("unsupported_n"))


# A structure per study: respondent = order, row = return flag, option = line status.
# One line means yes (1), two no (0), three or more the undeclared code 7; orders whose
# number is divisible by 11 skip row R, and 9 is a declared missing code.
CODE = "CASE WHEN n_lines = 1 THEN '1' WHEN n_lines = 2 THEN '0' WHEN n_lines > 2 THEN '7' END"
STRUCTURE_SQL = f"""{r.EVALUATIONS_SQL},
grid AS (
  SELECT e.study_id, e.respondent_id, e.factor, e.status, a.entity AS row_id, o.option AS option_id,
    CASE WHEN e.respondent_id % 13 = 0 AND a.entity = 'N' THEN '9' ELSE {CODE} END AS value,
    NOT (e.respondent_id % 11 = 0 AND a.entity = 'R') AS applicable
  FROM evaluations e
  CROSS JOIN (VALUES ('A'), ('N'), ('R')) a(entity)
  CROSS JOIN (VALUES ('F'), ('O')) o(option)
  LEFT JOIN (SELECT l_orderkey, l_returnflag, l_linestatus, count(*) AS n_lines
             FROM lineitem GROUP BY 1, 2, 3) l
    ON l_orderkey = e.respondent_id AND l_returnflag = a.entity AND l_linestatus = o.option),
records AS (
  SELECT *, CASE WHEN NOT applicable THEN 'structural_missing' WHEN value IS NULL THEN 'ordinary_missing'
    WHEN value = '9' THEN 'ordinary_missing' WHEN value = '1' THEN 'selected'
    WHEN value = '0' THEN 'not_selected' ELSE 'invalid_out_of_domain' END AS response_state
  FROM grid)"""


def structure_records(spark: SparkSession, path: str, evaluation: DataFrame | None = None
                      ) -> DataFrame:
    evaluation = r.evaluations(spark, path) if evaluation is None else evaluation
    lines = r.table(spark, path, "lineitem").groupBy(
        F.col("l_orderkey").alias("respondent_id"), F.col("l_returnflag").alias("row_id"),
        F.col("l_linestatus").alias("option_id")).agg(F.count("*").alias("n"))
    frame = evaluation.select("study_id", "respondent_id", F.explode(F.array(*[
        F.struct(F.lit(a).alias("row_id"), F.lit(o).alias("option_id"))
        for a in "ANR" for o in "FO"])).alias("b")).select("study_id", "respondent_id", "b.*")
    n = F.col("n")
    skipped = (F.col("respondent_id") % 13 == 0) & (F.col("row_id") == "N")
    value = F.when(skipped, "9").when(n == 1, "1").when(n == 2, "0").when(n > 2, "7")
    applies = ~((F.col("respondent_id") % 11 == 0) & (F.col("row_id") == "R"))
    cells = typed_cells(frame.join(lines, ["respondent_id", "row_id", "option_id"], "left").select(
        "study_id", "respondent_id", F.concat_ws("_", "row_id", "option_id").alias("variable"),
        value.alias("value"), applies.alias("applicable")))
    studies = r.studies(spark, path)
    none = F.lit(None).cast("string")
    bindings = studies.select(
        "study_id", F.lit("G").alias("structure_id"), F.lit("GRID_RM").alias("structure_type"),
        F.inline(F.array(*[F.struct(
            F.lit(f"{a}_{o}").alias("variable"), F.lit(f"{a}_{o}").alias("binding_id"),
            F.lit(a).alias("row_id"), none.alias("column_id"), F.lit(o).alias("option_id"),
            none.alias("loop_id"), none.alias("entity_id"),
            F.lit(False).alias("missing_is_unanswered")) for a in "ANR" for o in "FO"])))
    rules = studies.select("study_id", F.lit("G").alias("structure_id"), F.inline(F.array(*[F.struct(
        F.lit(code).alias("code"), F.lit(role).alias("role"), none.alias("category_id"),
        F.lit(i).alias("ord")) for i, (code, role) in enumerate((
            ("1", "selected"), ("0", "not_selected"), ("9", "missing")))])))
    return st.response_records(cells, bindings, rules)


@register("a11_states", f"""
WITH {STRUCTURE_SQL}
SELECT study_id, row_id, option_id, response_state, CAST(count(*) AS BIGINT) AS n
FROM records GROUP BY ALL""")
def a11_states(spark: SparkSession, path: str) -> DataFrame:
    return structure_records(spark, path).groupBy(
        "study_id", "row_id", "option_id", "response_state").agg(F.count("*").alias("n"))


@register("a12_ledger", f"""
WITH {STRUCTURE_SQL}
SELECT study_id, 'respondent_option' AS unit,
  CAST(count(*) FILTER (WHERE response_state IN ('selected', 'not_selected')) AS BIGINT) AS denominator_n,
  CAST(count(*) FILTER (WHERE response_state = 'selected') AS BIGINT) AS selected_n,
  CAST(count(*) FILTER (WHERE response_state = 'not_selected') AS BIGINT) AS not_selected_n,
  CAST(count(*) FILTER (WHERE response_state = 'ordinary_missing') AS BIGINT) AS ordinary_missing_n,
  CAST(count(*) FILTER (WHERE response_state = 'structural_missing') AS BIGINT) AS structural_missing_n,
  CAST(count(*) FILTER (WHERE response_state = 'invalid_out_of_domain') AS BIGINT) AS invalid_n,
  'NONZERO_BASE' AS zero_base_status
FROM records GROUP BY ALL""")
def a12_ledger(spark: SparkSession, path: str) -> DataFrame:
    ledger = st.denominator_ledger(structure_records(spark, path))
    return ledger.select("study_id", "unit", *[big(c) for c in (
        "denominator_n", "selected_n", "not_selected_n", "ordinary_missing_n",
        "structural_missing_n", "invalid_n")], "zero_base_status")


@register("a13_mentions", f"""
WITH {STRUCTURE_SQL},
m AS (SELECT study_id, 'ROW' AS scope, row_id AS scope_ref, count(*) AS n FROM records
      WHERE response_state = 'selected' GROUP BY ALL UNION ALL
      SELECT study_id, 'PARENT_RM', 'G', count(*) FROM records
      WHERE response_state = 'selected' GROUP BY ALL)
SELECT study_id, scope, scope_ref, CAST(n AS BIGINT) AS denominator_n FROM m""")
def a13_mentions(spark: SparkSession, path: str) -> DataFrame:
    records = structure_records(spark, path)
    parts = [st.scope_totals(st.mention_ledger(records, s)).withColumn("scope", F.lit(s))
             for s in ("ROW", "PARENT_RM")]
    return parts[0].unionByName(parts[1]).select(
        "study_id", "scope", "scope_ref", big("denominator_n"))


def status_slices(spark: SparkSession, path: str) -> DataFrame:
    slices = expand_slices(r.evaluations(spark, path), "status",
                           [(s, s, s) for s in ("F", "O", "P")])
    return slices.select("study_id", "respondent_id", "slice_id", F.col("factor").alias("weight"))


@register("a14_category_share", f"""
WITH {r.EVALUATIONS_SQL},
c AS (SELECT study_id, status AS slice_id, split_part(o_orderpriority, '-', 1) AS category_id,
        count(*) AS n FROM evaluations WHERE o_orderpriority <> '5-LOW' GROUP BY ALL)
SELECT study_id, slice_id, category_id, CAST(n AS BIGINT) AS numerator,
  CAST(sum(n) OVER (PARTITION BY study_id, slice_id) AS BIGINT) AS denominator,
  round(n / sum(n) OVER (PARTITION BY study_id, slice_id), 6) AS value, 'OK' AS status
FROM c UNION ALL
SELECT DISTINCT study_id, slice_id, '8', 0,
  CAST(sum(n) OVER (PARTITION BY study_id, slice_id) AS BIGINT), 0.0, 'OK' FROM c""")
def a14_category_share(spark: SparkSession, path: str) -> DataFrame:
    """Code 5 is a declared missing value; category 8 exists but nobody chose it."""
    code = F.split("o_orderpriority", "-", 2)[0]
    records = r.evaluations(spark, path).select(
        "study_id", "respondent_id", F.lit("P").alias("structure_id"),
        F.when(code == "5", "ordinary_missing").otherwise("valid_category").alias("response_state"),
        F.when(code != "5", code).alias("category_id"))
    wanted = records.select("study_id").distinct().select(
        "study_id", F.explode(F.array(*[F.lit(c) for c in "12348"])).alias("category_id"))
    joined = st.slice_records(records, status_slices(spark, path))
    shares = st.category_shares(joined, ["study_id", "slice_id"], wanted)
    return shares.select("study_id", "slice_id", "category_id", big("numerator"),
                         big("denominator"), r6("value"), "status")


@register("a14_top_box", f"""
WITH {r.EVALUATIONS_SQL}
SELECT study_id, status AS slice_id,
  CAST(count(*) FILTER (WHERE left(o_orderpriority, 1) IN ('1', '2')) AS BIGINT) AS numerator,
  CAST(count(*) AS BIGINT) AS denominator,
  round(count(*) FILTER (WHERE left(o_orderpriority, 1) IN ('1', '2')) / count(*), 6) AS value
FROM evaluations GROUP BY ALL""")
def a14_top_box(spark: SparkSession, path: str) -> DataFrame:
    records = r.evaluations(spark, path).select(
        "study_id", "respondent_id", F.lit("valid_category").alias("response_state"),
        F.split("o_orderpriority", "-", 2)[0].alias("category_id"))
    joined = st.slice_records(records, status_slices(spark, path))
    return st.box_share(joined, ["study_id", "slice_id"], ["1", "2"]).select(
        "study_id", "slice_id", big("numerator"), big("denominator"), r6("value"))


@register("a15_option_base", f"""
WITH {STRUCTURE_SQL},
d AS (SELECT study_id, status AS slice_id, option_id, respondent_id,
        bool_or(response_state = 'selected') AS sel FROM records
      WHERE response_state IN ('selected', 'not_selected') GROUP BY ALL)
SELECT study_id, slice_id, option_id, CAST(count(*) FILTER (WHERE sel) AS BIGINT) AS numerator,
  CAST(count(*) AS BIGINT) AS denominator,
  round(count(*) FILTER (WHERE sel) / count(*), 6) AS value FROM d GROUP BY ALL""")
def a15_option_base(spark: SparkSession, path: str) -> DataFrame:
    joined = st.slice_records(structure_records(spark, path), status_slices(spark, path))
    return st.option_shares(joined, ["study_id", "slice_id"]).select(
        "study_id", "slice_id", "option_id", big("numerator"), big("denominator"), r6("value"))


@register("a16_mention_share", f"""
WITH {STRUCTURE_SQL},
c AS (SELECT study_id, status AS slice_id, row_id AS scope_ref, option_id, count(*) AS n FROM records
      WHERE response_state = 'selected' GROUP BY ALL)
SELECT study_id, slice_id, scope_ref, option_id, CAST(n AS BIGINT) AS numerator,
  CAST(sum(n) OVER w AS BIGINT) AS denominator, round(n / sum(n) OVER w, 6) AS value
FROM c WINDOW w AS (PARTITION BY study_id, slice_id, scope_ref)""")
def a16_mention_share(spark: SparkSession, path: str) -> DataFrame:
    joined = st.slice_records(structure_records(spark, path), status_slices(spark, path))
    return st.mention_shares(joined, ["study_id", "slice_id"], "ROW").select(
        "study_id", "slice_id", "scope_ref", "option_id", big("numerator"), big("denominator"),
        r6("value"))


# Loops: one iteration per return flag; the category is the lowest line number there, the
# number the quantity of each line.
LOOP_SQL = f"""{r.EVALUATIONS_SQL},
loops AS (SELECT study_id, status AS slice_id, respondent_id, factor, l_returnflag AS loop_id,
            min(l_linenumber) AS category_id, avg(l_quantity) AS q
          FROM evaluations JOIN lineitem ON l_orderkey = respondent_id GROUP BY ALL)"""


def loop_records(spark: SparkSession, path: str) -> DataFrame:
    lines = r.table(spark, path, "lineitem").select(
        F.col("l_orderkey").alias("respondent_id"), F.col("l_returnflag").alias("loop_id"), "l_linenumber", "l_quantity")
    loops = r.dealt(spark, path, lines, "respondent_id").groupBy("respondent_id", "loop_id").agg(
        F.min("l_linenumber").alias("category"), F.avg("l_quantity").alias("number"))
    slices = r.dealt(spark, path, status_slices(spark, path), "respondent_id")
    return loops.join(slices, "respondent_id").select(
        "study_id", "slice_id", "respondent_id", "weight", "loop_id", "number",
        F.lit(True).alias("applicable"), F.lit("L").alias("structure_id"),
        F.col("category").cast("string").alias("category_id"))


@register("a17_loop_single", f"""
WITH {LOOP_SQL},
b AS (SELECT study_id, slice_id, loop_id, count(*) AS n, sum(factor) AS w,
        sum(factor) * sum(factor) / sum(factor * factor) AS eff FROM loops GROUP BY ALL),
c AS (SELECT study_id, slice_id, loop_id, category_id, sum(factor) AS x FROM loops GROUP BY ALL)
SELECT study_id, slice_id, loop_id, CAST(category_id AS VARCHAR) AS category_id,
  round(x, 6) AS numerator, CAST(n AS BIGINT) AS unweighted_n, round(w, 6) AS denominator,
  round(eff, 6) AS effective_n, round(x / w, 6) AS value
FROM c JOIN b USING (study_id, slice_id, loop_id)""")
def a17_loop_single(spark: SparkSession, path: str) -> DataFrame:
    records = loop_records(spark, path).withColumn("response_state", F.lit("valid_category"))
    shares = st.loop_category_shares(records, ["study_id", "slice_id"], weighted=True)
    return shares.select("study_id", "slice_id", "loop_id", "category_id", r6("numerator"),
                         big("unweighted_n"), r6("denominator"), r6("effective_n"), r6("value"))


@register("a18_loop_mean", f"""
WITH {LOOP_SQL}
SELECT study_id, slice_id, loop_id, CAST(count(*) AS BIGINT) AS denominator,
  round(sum(q * factor) / sum(factor), 6) AS value, round(stddev_samp(q), 6) AS sd
FROM loops GROUP BY ALL""")
def a18_loop_mean(spark: SparkSession, path: str) -> DataFrame:
    records = loop_records(spark, path).withColumn("response_state", F.lit("answered"))
    means = st.loop_means(records, ["study_id", "slice_id"], weighted=True)
    return means.select("study_id", "slice_id", "loop_id", big("denominator"), r6("value"),
                        r6("sd"))


@register("a19_nps_ratio", f"""
WITH {r.EVALUATIONS_SQL},
x AS (SELECT study_id, status AS slice_id, l_orderkey, round(max(l_discount) * 100) AS v
      FROM evaluations JOIN lineitem ON l_orderkey = respondent_id GROUP BY ALL)
SELECT study_id, slice_id, CAST(count(*) FILTER (WHERE v >= 9) AS BIGINT) AS promoters,
  CAST(count(*) FILTER (WHERE v <= 6) AS BIGINT) AS detractors,
  CAST(count(*) AS BIGINT) AS denominator,
  round((count(*) FILTER (WHERE v >= 9) - count(*) FILTER (WHERE v <= 6)) / count(*), 6) AS value
FROM x GROUP BY ALL""")
def a19_nps_ratio(spark: SparkSession, path: str) -> DataFrame:
    best = r.table(spark, path, "lineitem").groupBy(F.col("l_orderkey").alias("respondent_id")).agg(
        F.round(F.max("l_discount") * 100).cast("int").cast("string").alias("category_id"))
    records = best.join(status_slices(spark, path), "respondent_id").withColumn(
        "response_state", F.lit("valid_category"))
    groups = spark.createDataFrame(
        [(str(v), "Detractor" if v <= 6 else "Pasivo" if v <= 8 else "Promotor")
         for v in range(11)], "category_id string, nps_group string")
    return st.descriptive_nps(records, ["study_id", "slice_id"], groups).select(
        "study_id", "slice_id", big("promoters"), big("detractors"), big("denominator"),
        r6("value"))


@register("f8_applicability", f"""
WITH {r.CUSTOMERS_SQL}
SELECT study_id, CAST(count(*) FILTER (WHERE a) AS BIGINT) AS row_a,
  CAST(count(*) FILTER (WHERE b) AS BIGINT) AS row_b FROM (
  SELECT study_id, balance > 0 AND wave IN (1, 2) AND segment <> 'BUILDING' AS a,
         balance > 0 AND wave = 0 AS b FROM customers) GROUP BY ALL""")
def f8_applicability(spark: SparkSession, path: str) -> DataFrame:
    """Row A has its own universe and a column one; row B the general one of its scope."""
    people = r.customers(spark, path)
    registry = {
        "q": {"released": True, "expression": ("gt", "balance", 0.0)},
        "ra": {"released": True, "expression": ("in", "wave", [1, 2])},
        "r": {"released": True, "expression": ("eq", "wave", 0)},
        "c": {"released": True, "expression": ("neq", "segment", "BUILDING")},
    }
    context = UniverseContext(people.schema, registry)
    refs = {"question": "q", "row:A": "ra", "row": "r", "column:X": "c"}
    a = applicability({"row_id": "A", "column_id": "X"}, refs, context)
    b = applicability({"row_id": "B", "column_id": "Y"}, refs, context)
    return people.groupBy("study_id").agg(F.count_if(a).alias("row_a"), F.count_if(b).alias("row_b"))


# --- checks on records ------------------------------------------------------

@register("q2_domain", f"""
WITH {STRUCTURE_SQL}
SELECT study_id, row_id || '_' || option_id AS binding_id, CAST(count(*) AS BIGINT) AS n_invalid
FROM records WHERE response_state = 'invalid_out_of_domain' GROUP BY ALL""")
def q2_domain(spark: SparkSession, path: str) -> DataFrame:
    return st.invalid_values(structure_records(spark, path)).select(
        "study_id", "binding_id", "n_invalid")


@register("q3_exclusive", f"""
WITH {STRUCTURE_SQL},
g AS (SELECT study_id, row_id, respondent_id, count(*) AS n FROM records
      WHERE response_state = 'selected' GROUP BY ALL)
SELECT study_id, row_id, CAST(count(*) AS BIGINT) AS n FROM g WHERE n = 2 GROUP BY ALL""")
def q3_exclusive(spark: SparkSession, path: str) -> DataFrame:
    """Option O is exclusive: choosing F as well in the same row is a conflict."""
    records = structure_records(spark, path)
    exclusive = records.select("study_id", "structure_id", F.lit("O").alias("option_id")).distinct()
    conflicts = st.exclusive_conflicts(records, exclusive)
    return conflicts.groupBy("study_id", "row_id").agg(F.count("*").alias("n"))


@register("q4_duplicates", f"""
WITH {r.EVENT_DAYS_SQL}
SELECT study_id, code, CAST(count(*) AS BIGINT) AS n_keys, CAST(sum(n) AS BIGINT) AS n_rows FROM (
  SELECT study_id, respondent_id, code, count(*) AS n FROM event_days GROUP BY ALL HAVING count(*) > 1)
GROUP BY ALL""")
def q4_duplicates(spark: SparkSession, path: str) -> DataFrame:
    none = F.lit(None).cast("string")
    records = r.event_days(spark, path).select(
        "study_id", "respondent_id", F.lit("A").alias("structure_id"),
        F.lit("selected").alias("response_state"), F.col("code").alias("option_id"),
        F.col("code").alias("binding_id"), none.alias("row_id"), none.alias("entity_id"),
        none.alias("loop_id"), none.alias("column_id"), none.alias("category_id"))
    found = st.duplicate_mentions(records)
    return found.groupBy("study_id", F.col("option_key").alias("code")).agg(
        F.count("*").alias("n_keys"), F.sum("n_rows").alias("n_rows"))


@register("q5_repeated", f"""
WITH {LOOP_SQL},
k AS (SELECT study_id, respondent_id, count(DISTINCT loop_id) AS n FROM loops GROUP BY ALL)
SELECT study_id, bool_or(n > 1) AS repeated_dependency,
  CAST(count(*) FILTER (WHERE n > 1) AS BIGINT) AS n_repeating FROM k GROUP BY ALL""")
def q5_repeated(spark: SparkSession, path: str) -> DataFrame:
    return st.repeated_dependency(loop_records(spark, path)).select(
        "study_id", "repeated_dependency", "n_repeating")


@register("j8_universe_diff", f"""
WITH {r.CUSTOMERS_SQL}
SELECT study_id, segment, CAST(count(*) AS BIGINT) AS n FROM customers
WHERE (balance >= 5000) <> (balance >= 4000 AND segment <> 'BUILDING') GROUP BY ALL""")
def j8_universe_diff(spark: SparkSession, path: str) -> DataFrame:
    people = r.customers(spark, path)
    old = with_universe(people, ("gte", "balance", 5000.0))
    new = with_universe(people, ("and", ("gte", "balance", 4000.0), ("neq", "segment", "BUILDING")))
    keys = ["study_id", "segment", "respondent_id"]
    return q.differing_flags(old, new, keys).groupBy("study_id", "segment").agg(
        F.count("*").alias("n"))


@register("j8_ledger_diff", f"""
WITH {STRUCTURE_SQL},
l AS (SELECT study_id, count(*) FILTER (WHERE response_state = 'selected') AS selected_n,
        count(*) FILTER (WHERE response_state = 'not_selected') AS not_selected_n,
        count(*) FILTER (WHERE response_state = 'selected' AND status = 'F') AS s2,
        count(*) FILTER (WHERE response_state = 'not_selected' AND status = 'F') AS n2
      FROM records GROUP BY ALL)
SELECT study_id, 'selected_n' AS measure, CAST(selected_n AS DOUBLE) AS left_count,
  CAST(s2 AS DOUBLE) AS right_count FROM l UNION ALL
SELECT study_id, 'not_selected_n', CAST(not_selected_n AS DOUBLE), CAST(n2 AS DOUBLE) FROM l""")
def j8_ledger_diff(spark: SparkSession, path: str) -> DataFrame:
    evaluation = r.evaluations(spark, path)
    slices = evaluation.select("study_id", "respondent_id", F.explode(F.array_compact(F.array(
        F.lit("all"), F.when(F.col("status") == "F", "filled")))).alias("slice_id"))
    ledgers = st.slice_ledgers(structure_records(spark, path, evaluation), slices)
    return q.differing_slices(ledgers, "all", "filled", ["study_id"], ["selected_n", "not_selected_n"])


# Three more kinds: P, one choice with categories 1 to 3, a missing code 5, an undeclared code 4 and
# blanks that count as not answered; N, a number for each return flag, where two lines are no number;
# L, options in loops that belong to two entities.
KINDS_SQL = f"""{r.EVALUATIONS_SQL},
flags AS (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2),
marks AS (SELECT l_orderkey, l_returnflag, l_linestatus, count(*) AS n_lines FROM lineitem GROUP BY 1, 2, 3),
loops(loop_id, entity_id) AS (VALUES ('A', 'E1'), ('N', 'E1'), ('R', 'E2')),
kinds AS (
  SELECT study_id, respondent_id, 'P' AS structure_id, NULL AS loop_id, NULL AS entity_id, NULL AS option_id, true AS applicable,
    CASE WHEN respondent_id % 7 = 0 THEN 'not_answered' ELSE CASE left(o_orderpriority, 1)
      WHEN '5' THEN 'ordinary_missing' WHEN '4' THEN 'invalid_out_of_domain' ELSE 'valid_category' END END AS response_state,
    CASE WHEN respondent_id % 7 <> 0 AND left(o_orderpriority, 1) < '4' THEN 'c' || left(o_orderpriority, 1) END AS category_id
  FROM evaluations
  UNION ALL
  SELECT study_id, respondent_id, 'N', loop_id, NULL, NULL, NOT (respondent_id % 11 = 0 AND loop_id = 'R'),
    CASE WHEN respondent_id % 11 = 0 AND loop_id = 'R' THEN 'structural_missing' WHEN n IS NULL THEN 'ordinary_missing'
         WHEN n = 2 THEN 'invalid_out_of_domain' ELSE 'answered' END, NULL
  FROM evaluations CROSS JOIN loops LEFT JOIN flags ON l_orderkey = respondent_id AND l_returnflag = loop_id
  UNION ALL
  SELECT study_id, respondent_id, 'L', loop_id, entity_id, option, true,
    CASE WHEN n_lines = 1 THEN 'selected' WHEN n_lines = 2 THEN 'not_selected' WHEN n_lines > 2 THEN 'invalid_out_of_domain'
         ELSE 'ordinary_missing' END, NULL
  FROM evaluations CROSS JOIN loops CROSS JOIN (VALUES ('F'), ('O')) o(option)
  LEFT JOIN marks ON l_orderkey = respondent_id AND l_returnflag = loop_id AND l_linestatus = option)"""

ENTITIES = {"A": "E1", "N": "E1", "R": "E2"}


def kind_records(spark: SparkSession, path: str) -> DataFrame:
    evaluation = r.evaluations(spark, path)
    lines = r.table(spark, path, "lineitem").select(
        F.col("l_orderkey").alias("respondent_id"), "l_returnflag", "l_linestatus")
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    counts = r.dealt(spark, path, lines, "respondent_id").groupBy("respondent_id").agg(
        *[F.count_if(flag == a).alias(f"n_{a}") for a in "ANR"],
        *[F.count_if((flag == a) & (status == o)).alias(f"n_{a}_{o}") for a in "ANR" for o in "FO"])
    # One row per order up to the join, and all its cells after it: they lie dealt by respondent.
    people = evaluation.select("study_id", "respondent_id", "o_orderpriority")
    counted = r.dealt(spark, path, people, "respondent_id").join(counts, "respondent_id", "left")
    number = lambda n: F.when(n == 2, "two").when(n > 0, n.cast("string"))
    mark = lambda n: F.when(n == 1, "1").when(n == 2, "0").when(n > 2, "7")
    applies = lambda a: F.lit(True) if a != "R" else F.col("respondent_id") % 11 != 0
    cell = lambda variable, value, applies: F.struct(
        variable.alias("variable"), value.alias("value"), applies.alias("applicable"))
    priority = F.when(F.col("respondent_id") % 7 == 0, " ").otherwise(F.substring("o_orderpriority", 1, 1))
    cells = counted.select("study_id", "respondent_id", F.inline(F.array(
        cell(F.lit("P"), priority, F.lit(True)),
        *[cell(F.lit(f"N_{a}"), number(F.col(f"n_{a}")), applies(a)) for a in "ANR"],
        *[cell(F.lit(f"L_{a}_{o}"), mark(F.col(f"n_{a}_{o}")), F.lit(True)) for a in "ANR" for o in "FO"])))
    none = F.lit(None).cast("string")

    def binding(structure, kind, variable, option=None, loop=None, entity=None, unanswered=False):
        text = lambda v: none if v is None else F.lit(v)
        return F.struct(
            F.lit(structure).alias("structure_id"), F.lit(kind).alias("structure_type"), F.lit(variable).alias("variable"),
            F.lit(variable).alias("binding_id"), none.alias("row_id"), none.alias("column_id"), text(option).alias("option_id"),
            text(loop).alias("loop_id"), text(entity).alias("entity_id"), F.lit(unanswered).alias("missing_is_unanswered"))

    studies = r.studies(spark, path)
    bindings = studies.select("study_id", F.inline(F.array(
        binding("P", "RU", "P", unanswered=True),
        *[binding("N", "LOOP_NUMERICO", f"N_{a}", loop=a) for a in "ANR"],
        *[binding("L", "LOOP_RM", f"L_{a}_{o}", o, a, ENTITIES[a]) for a in "ANR" for o in "FO"])))
    rules = studies.select("study_id", F.inline(F.array(*[
        F.struct(F.lit(structure).alias("structure_id"), F.lit(code).alias("code"), F.lit(role).alias("role"),
                 F.lit(category).cast("string").alias("category_id"), F.lit(i).alias("ord"))
        for i, (structure, code, role, category) in enumerate((
            ("P", "1", "category", "c1"), ("P", "2", "category", "c2"), ("P", "3", "category", "c3"),
            ("P", "5", "missing", None), ("L", "1", "selected", None), ("L", "0", "not_selected", None)))])))
    return st.response_records(typed_cells(cells), bindings, rules)


@register("a11_kinds", f"""
WITH {KINDS_SQL}
SELECT study_id, structure_id, response_state, category_id, CAST(count(*) AS BIGINT) AS n FROM kinds GROUP BY ALL""")
def a11_kinds(spark: SparkSession, path: str) -> DataFrame:
    """States of categories, numbers and options in loops."""
    return kind_records(spark, path).groupBy(
        "study_id", "structure_id", "response_state", "category_id").agg(F.count("*").alias("n"))


@register("a12_units", f"""
WITH {KINDS_SQL},
c AS (
  SELECT study_id, structure_id, count(DISTINCT respondent_id) FILTER (WHERE applicable) AS respondents,
    count(*) FILTER (WHERE applicable) AS instances, count(*) FILTER (WHERE response_state IN ('selected', 'not_selected')) AS decided,
    count(*) FILTER (WHERE response_state = 'selected') AS s, count(*) FILTER (WHERE response_state = 'not_selected') AS ns,
    count(*) FILTER (WHERE response_state IN ('ordinary_missing', 'not_answered')) AS om,
    count(*) FILTER (WHERE response_state = 'structural_missing') AS sm,
    count(*) FILTER (WHERE response_state = 'invalid_out_of_domain') AS inv FROM kinds GROUP BY ALL),
u AS (SELECT *, CASE structure_id WHEN 'P' THEN 'respondent' WHEN 'N' THEN 'instance' ELSE 'respondent_option' END AS unit,
        CASE structure_id WHEN 'P' THEN respondents WHEN 'N' THEN instances ELSE decided END AS d FROM c)
SELECT study_id, structure_id, unit, CAST(d AS BIGINT) AS denominator_n,
  CAST(CASE WHEN structure_id = 'L' THEN d ELSE greatest(d - om - inv, 0) END AS BIGINT) AS valid_n,
  CAST(s AS BIGINT) AS selected_n, CAST(ns AS BIGINT) AS not_selected_n, CAST(om AS BIGINT) AS ordinary_missing_n,
  CAST(sm AS BIGINT) AS structural_missing_n, CAST(inv AS BIGINT) AS invalid_n, structure_id <> 'P' AS repeated_dependency
FROM u""")
def a12_units(spark: SparkSession, path: str) -> DataFrame:
    """Ledgers that count respondents, instances and options."""
    ledger = st.denominator_ledger(kind_records(spark, path), dealt=True)
    return ledger.select("study_id", "structure_id", "unit", *[big(c) for c in (
        "denominator_n", "valid_n", "selected_n", "not_selected_n", "ordinary_missing_n",
        "structural_missing_n", "invalid_n")], "repeated_dependency")


@register("a13_scopes", f"""
WITH {r.EVENT_DAYS_SQL},
k AS (SELECT study_id, respondent_id, code, 'd' || (day % 2) AS row_id, 'e' || (person_id % 2) AS entity_id,
        'w' || ((day - 1) // 7) AS loop_id, count(*) AS n FROM event_days GROUP BY ALL),
m AS (SELECT study_id, code AS option_key, n, unnest(['PARENT_RM', 'ROW', 'ENTITY', 'LOOP_INSTANCE']) AS scope,
        unnest(['A', row_id, entity_id, loop_id]) AS scope_ref FROM k)
SELECT study_id, scope, scope_ref, option_key, CAST(count(*) AS BIGINT) AS mentions, CAST(sum(n) AS BIGINT) AS mention_rows
FROM m GROUP BY ALL""")
def a13_scopes(spark: SparkSession, path: str) -> DataFrame:
    """All scopes under both duplicate policies: an event repeated on a day counts once or every time."""
    none = F.lit(None).cast("string")
    text = lambda letter, number: F.concat(F.lit(letter), number.cast("string"))
    records = r.event_days(spark, path).select(
        "study_id", "respondent_id", F.lit("A").alias("structure_id"), F.lit("LOOP_RM").alias("structure_type"),
        F.lit("selected").alias("response_state"), F.lit(True).alias("applicable"),
        F.col("code").alias("option_id"), F.col("code").alias("binding_id"), none.alias("column_id"), none.alias("category_id"),
        text("d", F.col("day") % 2).alias("row_id"), text("e", F.col("person_id") % 2).alias("entity_id"),
        text("w", F.floor((F.col("day") - 1) / 7)).alias("loop_id"))
    return st.mention_ledgers(records).select(
        "study_id", "scope", "scope_ref", "option_key", big("mentions"), big("mention_rows"))

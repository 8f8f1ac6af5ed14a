"""Multiple response and grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from study_queries import roles as r
from study_queries.core import big, r6, status_dimension
from study_queries.inference import letters_sql
from tabuloom.operators import metrics as m
from tabuloom.operators import reshape as s
from tabuloom.operators.breakdown import respondent_dimension
from tabuloom.operators.tables import grid_rank
from tabuloom.plans.tabulate import Request, tabulate

QUERIES, SQL = {}, {}


def register(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function
    return add


RM_COLUMNS = """study_id, banner, response, CAST(mentions AS BIGINT) AS mentions,
  CAST(respondents AS BIGINT) AS respondents, CAST(base AS BIGINT) AS base,
  round(base_weighted, 6) AS base_weighted,
  round(respondents / base, 6) AS pct_respondents,
  round(mentions / sum(mentions) OVER w, 6) AS pct_mentions,
  CAST(sum(mentions) OVER w AS BIGINT) AS base_mentions,
  round(mw / base_weighted, 6) AS pct_respondents_weighted,
  round(mw / sum(mw) OVER w, 6) AS pct_mentions_weighted"""


def rm_output(table: DataFrame) -> DataFrame:
    return table.select(
        "study_id", "banner", "response", big("mentions"), big("respondents"), big("base"),
        r6("base_weighted"), r6("pct_respondents"), r6("pct_mentions"), big("base_mentions"),
        r6("pct_respondents_weighted"), r6("pct_mentions_weighted"),
    )


WEEK_CELLS = """mention_cells AS (
  SELECT f.study_id, f.respondent_id, f.response, e.factor, 'Total' AS banner
  FROM facts f JOIN event_respondents e USING (study_id, respondent_id) UNION ALL
  SELECT f.study_id, f.respondent_id, f.response, e.factor, CAST(week AS VARCHAR)
  FROM facts f JOIN event_respondents e USING (study_id, respondent_id)),
base_cells AS (
  SELECT b.study_id, b.respondent_id, e.factor, 'Total' AS banner
  FROM base b JOIN event_respondents e USING (study_id, respondent_id) UNION ALL
  SELECT b.study_id, b.respondent_id, e.factor, CAST(week AS VARCHAR)
  FROM base b JOIN event_respondents e USING (study_id, respondent_id)),
c AS (SELECT study_id, banner, response, count(*) AS mentions,
        count(DISTINCT respondent_id) AS respondents, sum(factor) AS mw
      FROM mention_cells GROUP BY ALL),
b AS (SELECT study_id, banner, count(*) AS base, sum(factor) AS base_weighted
      FROM base_cells GROUP BY ALL)"""


@register("a2_multi", f"""
WITH {r.EVENT_RESPONDENTS_SQL},
facts AS (SELECT study_id, respondent_id, response FROM event_days),
base AS (SELECT DISTINCT study_id, respondent_id FROM event_days),
{WEEK_CELLS}
SELECT {RM_COLUMNS} FROM c JOIN b USING (study_id, banner)
WINDOW w AS (PARTITION BY study_id, banner)""")
def a2_multi(spark: SparkSession, path: str) -> DataFrame:
    dimension = respondent_dimension(r.event_respondents(spark, path), "week", weight="factor")
    return rm_output(m.multi_response(r.event_days(spark, path), dimension))


@register("a2_multi_base", f"""
WITH {r.EVENT_RESPONDENTS_SQL},
facts AS (SELECT DISTINCT study_id, respondent_id, response FROM event_days
          WHERE code IN ('click', 'purchase', 'view')),
base AS (SELECT study_id, respondent_id FROM event_respondents),
{WEEK_CELLS}
SELECT {RM_COLUMNS} FROM c JOIN b USING (study_id, banner)
WINDOW w AS (PARTITION BY study_id, banner)""")
def a2_multi_base(spark: SparkSession, path: str) -> DataFrame:
    """Three of the event types are the options; a day without them stays in the base."""
    people = r.event_respondents(spark, path)
    dimension = respondent_dimension(people, "week", weight="factor")
    chosen = r.event_days(spark, path).filter(
        F.col("code").isin("click", "purchase", "view")
    ).select("study_id", "question_id", "respondent_id", "code", "response").distinct()
    base = people.select("study_id", F.lit("ACTIONS").alias("question_id"), "respondent_id")
    return rm_output(m.multi_response(chosen, dimension, base))


@register("tabulate_mention_letters", f"""
WITH {r.EVENT_RESPONDENTS_SQL},
facts AS (SELECT study_id, respondent_id, response FROM event_days),
base AS (SELECT DISTINCT study_id, respondent_id FROM event_days),
{WEEK_CELLS},
k AS (SELECT study_id, banner, response, mentions AS x, sum(mentions) OVER (PARTITION BY study_id, banner) AS n FROM c),
{letters_sql("k", "x", "n")}
SELECT study_id, banner, response, coalesce(letters, '') AS letters
FROM k LEFT JOIN marks USING (study_id, banner, response) WHERE banner <> 'Total'""")
def tabulate_mention_letters(spark: SparkSession, path: str) -> DataFrame:
    """Letters on shares of mentions; each user day is a person here."""
    people = r.event_respondents(spark, path).withColumn("person_id", F.col("respondent_id"))
    tables = {"respondents": people, "multi_responses": r.event_days(spark, path)}
    report = tabulate(tables, Request(["week"], significance=True, tests=("pct_mentions",)))
    return report.letters.select("study_id", "banner", "response", "letters")


@register("tabulate_order", f"""
WITH {r.EVENT_RESPONDENTS_SQL},
n AS (SELECT study_id, 'ACTIONS' AS question_id, response, count(*) AS total FROM event_days GROUP BY ALL UNION ALL
      SELECT study_id, 'WEEK', 'week ' || week, count(*) FROM event_respondents GROUP BY ALL)
SELECT study_id, question_id, response, CAST(row_number() OVER (PARTITION BY study_id, question_id
  ORDER BY total DESC, lower(response), response) AS BIGINT) AS pos FROM n""")
def tabulate_order(spark: SparkSession, path: str) -> DataFrame:
    """One order for single and multiple responses."""
    people = r.event_respondents(spark, path)
    single = people.select("study_id", "respondent_id", F.lit("WEEK").alias("question_id"),
                           F.concat(F.lit("week "), F.col("week").cast("string")).alias("response"))
    tables = {"respondents": people, "responses": single, "multi_responses": r.event_days(spark, path)}
    report = tabulate(tables, Request(response_order="frequency"))
    return report.order.select("study_id", "question_id", "response",
                               F.col("response_pos").cast("bigint").alias("pos"))


@register("a24_mean_mentions", f"""
WITH {r.EVENT_RESPONDENTS_SQL},
facts AS (SELECT study_id, respondent_id, response FROM event_days),
base AS (SELECT DISTINCT study_id, respondent_id FROM event_days),
{WEEK_CELLS}
SELECT study_id, banner, CAST(sum(mentions) AS BIGINT) AS mentions, CAST(max(base) AS BIGINT) AS base,
  round(sum(mentions) / max(base), 6) AS mean_mentions
FROM c JOIN b USING (study_id, banner) GROUP BY ALL""")
def a24_mean_mentions(spark: SparkSession, path: str) -> DataFrame:
    dimension = respondent_dimension(r.event_respondents(spark, path), "week", weight="factor")
    table = m.mean_mentions(m.multi_response(r.event_days(spark, path), dimension))
    return table.select("study_id", "banner", big("mentions"), big("base"), r6("mean_mentions"))


# A wide multiple-response file: four 0/1 columns, one column coded 5 for yes, and two
# open mention columns, from the events of a user on a day.
EVENT_WIDE_SQL = """wide AS (
  SELECT study_id, respondent_id,
    max(CASE WHEN code = 'click' THEN 1 ELSE 0 END) AS act_click,
    max(CASE WHEN code = 'view' THEN 1 ELSE 0 END) AS act_view,
    max(CASE WHEN code = 'error' THEN 1 ELSE 0 END) AS act_error,
    max(CASE WHEN code = 'signup' THEN 5 ELSE 0 END) AS opt_signup,
    max(CASE WHEN code = 'purchase' THEN 9 END) AS opt_purchase,
    min(code) AS men_1, max(code) AS men_2
  FROM event_days GROUP BY ALL)"""


def event_wide(spark: SparkSession, path: str) -> DataFrame:
    def flag(code: str, value: int, other):
        return F.max(F.when(F.col("code") == code, value).otherwise(F.lit(other)))
    return r.event_days(spark, path).groupBy("study_id", "respondent_id").agg(
        flag("click", 1, 0).alias("act_click"), flag("view", 1, 0).alias("act_view"),
        flag("error", 1, 0).alias("act_error"), flag("signup", 5, 0).alias("opt_signup"),
        flag("purchase", 9, None).alias("opt_purchase"),
        F.min("code").alias("men_1"), F.max("code").alias("men_2"),
    )


RM_VARIABLES = (
    # variable, question, format, option code, option label
    ("act_click", "ACT", "", None, None), ("act_view", "ACT", "", None, None),
    ("act_error", "ACT", "", None, None),
    ("opt_signup", "OPT", "codigo_por_opcion", "5", "Alta"),
    ("opt_purchase", "OPT", "codigo_por_opcion", None, None),
    ("men_1", "MEN", "menciones", None, None), ("men_2", "MEN", "menciones", None, None),
)


def rm_codebook(studies: DataFrame) -> DataFrame:
    names = ("variable", "question_id", "format_rm", "option_code", "option_label")
    rows = F.array(*[F.struct(F.lit(i).alias("position"), *[
        F.lit(x).cast("string").alias(n) for n, x in zip(names, row)
    ]) for i, row in enumerate(RM_VARIABLES)])
    return studies.select("study_id", F.inline(rows)).withColumns({
        "question_type": F.lit("RM"), "calculation": F.lit("RM % Respondentes"),
        "analytic_class": F.lit("Pregunta analizable"), "in_dashboard": F.lit("si"),
        "row_axis_type": F.lit(""), "is_attached_open": F.lit(""),
        "label": F.concat(F.lit("Accion "), F.col("variable")),
    })


def rm_labels(studies: DataFrame) -> DataFrame:
    rows = [("opt_purchase", "9", "Compra", 1), ("opt_purchase", "0", "No", 2),
            ("men_1", "error", "Ninguna", 1), ("men_2", "error", "Ninguna", 1),
            ("men_1", "view", "Ver", 2), ("men_2", "view", "Ver", 2)]
    return studies.select("study_id", F.inline(F.array(*[F.struct(
        F.lit(v).alias("variable"), F.lit(c).alias("code"), F.lit(t).alias("label"),
        F.lit(i).alias("ord")) for v, c, t, i in rows])))


def rm_mentions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    wide = event_wide(spark, path)
    names = [v[0] for v in RM_VARIABLES]
    cells = s.unpivot_cells(wide, ["study_id", "respondent_id"], names)
    studies = wide.select("study_id").distinct()
    return cells, rm_codebook(studies), rm_labels(studies)


RM_LONG_SQL = f"""{r.EVENT_DAYS_SQL}, {EVENT_WIDE_SQL},
raw AS (
  SELECT study_id, respondent_id, 'ACT' AS question_id, 'act_click' AS variable, 0 AS pos,
         'click' AS code, 'Accion act_click' AS response, 'dicotomica_por_opcion' AS format_rm
  FROM wide WHERE act_click = 1 UNION ALL
  SELECT study_id, respondent_id, 'ACT', 'act_view', 1, 'view', 'Accion act_view',
         'dicotomica_por_opcion' FROM wide WHERE act_view = 1 UNION ALL
  SELECT study_id, respondent_id, 'ACT', 'act_error', 2, 'error', 'Accion act_error',
         'dicotomica_por_opcion' FROM wide WHERE act_error = 1 UNION ALL
  SELECT study_id, respondent_id, 'OPT', 'opt_signup', 3, '5', 'Alta', 'codigo_por_opcion'
  FROM wide WHERE opt_signup = 5 UNION ALL
  SELECT study_id, respondent_id, 'OPT', 'opt_purchase', 4, '9', 'Compra', 'codigo_por_opcion'
  FROM wide WHERE opt_purchase = 9 UNION ALL
  SELECT study_id, respondent_id, 'MEN', v, p, code,
         CASE code WHEN 'error' THEN 'Ninguna' WHEN 'view' THEN 'Ver' ELSE code END, 'menciones'
  FROM (SELECT study_id, respondent_id, 'men_1' AS v, 5 AS p, men_1 AS code FROM wide UNION ALL
        SELECT study_id, respondent_id, 'men_2', 6, men_2 FROM wide)),
dedup AS (
  SELECT * FROM raw QUALIFY row_number() OVER (
    PARTITION BY study_id, respondent_id, question_id, code ORDER BY pos) = 1)"""


MARKED_SQL = f"""{RM_LONG_SQL},
marked AS (
  SELECT *, contains(lower(response), 'ninguna') AS ex,
    max(CASE WHEN contains(lower(response), 'ninguna') THEN 0 ELSE 1 END)
      OVER (PARTITION BY study_id, respondent_id, question_id) AS other FROM dedup)"""


def rm_long(spark: SparkSession, path: str) -> DataFrame:
    cells, codebook, labels = rm_mentions(spark, path)
    encodings = s.multi_response_encodings(cells, codebook, labels)
    return s.build_multi_response(cells, encodings, codebook, labels)


@register("d3_multi_long", f"""
WITH {MARKED_SQL}
SELECT study_id, question_id, variable, code, response, format_rm, CAST(count(*) AS BIGINT) AS n
FROM marked WHERE NOT (ex AND other = 1) GROUP BY ALL""")
def d3_multi_long(spark: SparkSession, path: str) -> DataFrame:
    """The 0/1, code-per-option and mention encodings."""
    return rm_long(spark, path).groupBy(
        "study_id", "question_id", "variable", "code", "response", "format_rm"
    ).agg(F.count("*").alias("n"))


@register("d5_exclusive", f"""
WITH {MARKED_SQL}
SELECT study_id, question_id, code, CAST(count(DISTINCT respondent_id) AS BIGINT) AS respondents,
  CAST(count(*) AS BIGINT) AS n FROM marked WHERE NOT (ex AND other = 1) GROUP BY ALL""")
def d5_exclusive(spark: SparkSession, path: str) -> DataFrame:
    """Mentions with duplicates and exclusive conflicts removed (D4, D5): a respondent has a code once."""
    people = rm_long(spark, path).groupBy("study_id", "question_id", "code", "respondent_id").agg(F.count("*").alias("n"))
    return people.groupBy("study_id", "question_id", "code").agg(
        F.count("*").alias("respondents"), F.sum("n").alias("n"))


@register("d4_dedupe", f"""
WITH {r.EVENT_DAYS_SQL}
SELECT study_id, code, CAST(count(*) AS BIGINT) AS n, CAST(sum(event_id) AS BIGINT) AS first_sum
FROM (SELECT * FROM event_days QUALIFY row_number() OVER (
  PARTITION BY study_id, respondent_id, question_id, code ORDER BY event_id) = 1)
GROUP BY ALL""")
def d4_dedupe(spark: SparkSession, path: str) -> DataFrame:
    mentions = r.event_days(spark, path).select(
        "study_id", "respondent_id", "question_id", "code", "response",
        F.col("event_id").alias("position"), "event_id",
    )
    return s.deduplicate_mentions(mentions).groupBy("study_id", "code").agg(
        F.count("*").alias("n"), F.sum("event_id").alias("first_sum")
    )


@register("d6_rm_bases", f"""
WITH {r.EVENT_DAYS_SQL}, {EVENT_WIDE_SQL}
SELECT study_id, 'OPT' AS question_id, CAST(count(*) AS BIGINT) AS base,
       CAST(sum(respondent_id) AS BIGINT) AS id_sum
FROM wide WHERE opt_signup IS NOT NULL OR opt_purchase IS NOT NULL GROUP BY ALL""")
def d6_rm_bases(spark: SparkSession, path: str) -> DataFrame:
    cells, codebook, _ = rm_mentions(spark, path)
    return s.build_rm_bases(cells, codebook).groupBy("study_id", "question_id").agg(
        F.count("*").alias("base"), F.sum("respondent_id").alias("id_sum")
    )


def grid_rows(spark: SparkSession, path: str) -> DataFrame:
    grid = r.entity_grid(spark, path)
    selected = ~s.grid_missing(F.col("value")) & s.grid_selected(
        F.col("value"), F.col("option_code")
    )
    return s.structural_base(grid.withColumn("selected", selected.cast("int")))


def grid_cells(spark: SparkSession, path: str) -> DataFrame:
    """The same cells without their structural base, which A3 does not need."""
    grid = r.entity_grid(spark, path)
    selected = ~s.grid_missing(F.col("value")) & s.grid_selected(
        F.col("value"), F.col("option_code")
    )
    return s.answered_cells(grid.withColumn("selected", selected.cast("int")))


@register("d8_grid_base", f"""
WITH {r.EVALUATIONS_SQL}, {r.GRID_SQL}
SELECT study_id, entity, option, CAST(count(*) AS BIGINT) AS n,
  CAST(sum(CASE WHEN valid THEN 1 ELSE 0 END) AS BIGINT) AS base_valid,
  CAST(sum(CASE WHEN valid THEN 0 ELSE 1 END) AS BIGINT) AS structural_missing,
  CAST(sum(CASE WHEN value = '1' THEN 1 ELSE 0 END) AS BIGINT) AS selected
FROM (SELECT *, bool_or(value IS NOT NULL) OVER (PARTITION BY study_id, respondent_id, entity)
        AS valid FROM grid)
GROUP BY ALL""")
def d8_grid_base(spark: SparkSession, path: str) -> DataFrame:
    return grid_rows(spark, path).groupBy("study_id", "entity", "option").agg(
        F.count("*").alias("n"),
        *[F.sum(c).cast("bigint").alias(c)
          for c in ("base_valid", "structural_missing", "selected")],
    )


GRID_SUMMARY_SQL = f"""{r.EVALUATIONS_SQL}, {r.GRID_SQL},
joined AS (SELECT g.*, e.factor, e.status FROM grid g JOIN evaluations e
           USING (study_id, respondent_id)),
cells AS (SELECT *, 'Total' AS banner FROM joined UNION ALL SELECT *, status FROM joined),
c AS (SELECT study_id, banner, entity, option,
        sum(CASE WHEN value = '1' THEN 1 ELSE 0 END) AS mentions,
        sum(CASE WHEN value = '1' THEN factor ELSE 0 END) AS mw FROM cells GROUP BY ALL),
b AS (SELECT study_id, banner, count(*) AS base, sum(factor) AS base_weighted FROM (
        SELECT DISTINCT study_id, banner, respondent_id, factor FROM cells WHERE value IS NOT NULL)
      GROUP BY ALL)"""


@register("a3_grid_multi", f"""
WITH {GRID_SUMMARY_SQL}
SELECT study_id, banner, entity, option, CAST(mentions AS BIGINT) AS mentions,
  CAST(base AS BIGINT) AS base, round(base_weighted, 6) AS base_weighted,
  round(mentions / base, 6) AS pct_respondents,
  round(mentions / sum(mentions) OVER w, 6) AS pct_mentions,
  round(mw / base_weighted, 6) AS pct_respondents_weighted
FROM c JOIN b USING (study_id, banner) WINDOW w AS (PARTITION BY study_id, banner)""")
def a3_grid_multi(spark: SparkSession, path: str) -> DataFrame:
    dimension = status_dimension(spark, path)
    table = m.grid_multi_response(grid_cells(spark, path), dimension)
    return table.select(
        "study_id", "banner", "entity", "option", big("mentions"), big("base"),
        r6("base_weighted"), r6("pct_respondents"), r6("pct_mentions"),
        r6("pct_respondents_weighted"),
    )


@register("w2_rank", f"""
WITH {GRID_SUMMARY_SQL}
SELECT study_id, entity, option,
  CAST(dense_rank() OVER (PARTITION BY study_id, entity ORDER BY mentions / base DESC) AS BIGINT)
    AS rank_in_entity,
  CAST(dense_rank() OVER (PARTITION BY study_id, option ORDER BY mentions / base DESC) AS BIGINT)
    AS rank_in_option
FROM c JOIN b USING (study_id, banner) WHERE banner = 'Total'""")
def w2_rank(spark: SparkSession, path: str) -> DataFrame:
    dimension = r.dealt(spark, path, respondent_dimension(r.evaluations(spark, path), None), "study_id", "respondent_id")
    table = m.grid_multi_response(grid_cells(spark, path), dimension)
    first = grid_rank(table, "entity").withColumnRenamed("rank", "rank_in_entity")
    both = grid_rank(first, "option").withColumnRenamed("rank", "rank_in_option")
    return both.select("study_id", "entity", "option", big("rank_in_entity"),
                       big("rank_in_option"))


@register("d12_grid_labels", f"""
WITH {r.EVALUATIONS_SQL}, {r.GRID_SQL}
SELECT entity, option, response, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT CASE WHEN entity = 'A' THEN 'GRID' ELSE entity END AS entity,
    CASE WHEN option = 'F' THEN '1' ELSE option END AS option,
    CASE WHEN entity = 'A' THEN 'GRID' ELSE entity END || ' | ' ||
    CASE WHEN option = 'F' THEN '1' ELSE option END AS response FROM grid)
GROUP BY ALL""")
def d12_grid_labels(spark: SparkSession, path: str) -> DataFrame:
    """Blank entities fall back on the question, blank options on the code."""
    grid = r.entity_grid(spark, path)
    entity = F.when(F.col("entity") != "A", F.col("entity")).otherwise(" ")
    option = F.when(F.col("option") != "F", F.col("option"))
    labels = s.grid_labels(entity, option, F.col("question_id"), F.col("option_code"))
    return grid.select(*[c.alias(n) for n, c in labels.items()]).groupBy(
        "entity", "option", "response"
    ).agg(F.count("*").alias("n"))

"""Frequencies, scales, filters and breakdowns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from study_queries import roles as r
from tabuloom.functions.predicates import filter_condition
from tabuloom.functions.scales import bottom2box, nps_group, top2box
from tabuloom.functions.text import code_text, column_type
from tabuloom.operators import metrics as m
from tabuloom.operators.breakdown import banner_order, respondent_dimension
from tabuloom.operators.tables import order_responses

QUERIES, SQL = {}, {}


def register(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function
    return add


def r6(name: str, alias: str | None = None):
    return F.round(F.col(name).cast("double"), 6).alias(alias or name)


def big(name: str):
    return F.col(name).cast("bigint").alias(name)


# Cells of the segment breakdown, for any question already in (response, weight) rows.
SEGMENT_CELLS = """cells AS (
  SELECT *, 'Total' AS banner FROM priority
  UNION ALL SELECT *, segment FROM priority)"""


@register("a1_frequency", f"""
WITH {r.EVALUATIONS_SQL}, {r.PRIORITY_SQL}, {SEGMENT_CELLS},
c AS (SELECT study_id, question_id, banner, response, count(*) AS n, sum(factor) AS nw,
             count(DISTINCT respondent_id) AS br FROM cells GROUP BY ALL)
SELECT study_id, question_id, banner, response, CAST(n AS BIGINT) AS n,
  round(nw, 6) AS n_weighted, CAST(br AS BIGINT) AS base_respondents,
  CAST(sum(n) OVER w AS BIGINT) AS base, round(n / sum(n) OVER w, 6) AS pct,
  round(nw / sum(nw) OVER w, 6) AS pct_weighted
FROM c WINDOW w AS (PARTITION BY study_id, question_id, banner)""")
def a1_frequency(spark: SparkSession, path: str) -> DataFrame:
    evaluation = r.evaluations(spark, path)
    dimension = respondent_dimension(evaluation, "segment", weight="factor")
    table = m.frequency(r.priority_facts(evaluation), dimension)
    return table.select("study_id", "question_id", "banner", "response", big("n"),
                        r6("n_weighted"), big("base_respondents"), big("base"), r6("pct"),
                        r6("pct_weighted"))


WAVE_HEADING = """CASE wave WHEN 0 THEN '0 | Inicial' WHEN 1 THEN '1 | Media'
  WHEN 2 THEN '2' ELSE 'Sin dato' END"""


@register("e1_nested", f"""
WITH {r.EVALUATIONS_SQL}, {r.PRIORITY_SQL},
cells AS (
  SELECT *, 'Total' AS banner FROM priority UNION ALL
  SELECT *, 'wave: ' || {WAVE_HEADING} || ' / status: ' || status FROM priority)
SELECT study_id, banner, response, CAST(count(*) AS BIGINT) AS n,
       CAST(sum(count(*)) OVER (PARTITION BY study_id, banner) AS BIGINT) AS base
FROM cells GROUP BY study_id, banner, response""")
def e1_nested(spark: SparkSession, path: str) -> DataFrame:
    evaluation = r.evaluations(spark, path)
    dimension = respondent_dimension(evaluation, ["wave", "status"], r.wave_labels(spark, path))
    table = m.frequency(r.priority_facts(evaluation), dimension)
    return table.select("study_id", "banner", "response", big("n"), big("base"))


@register("e2_separate", f"""
WITH {r.EVALUATIONS_SQL}, {r.PRIORITY_SQL},
cells AS (
  SELECT *, 'Total' AS banner FROM priority UNION ALL
  SELECT *, 'wave: ' || {WAVE_HEADING} FROM priority UNION ALL
  SELECT *, 'status: ' || status FROM priority)
SELECT study_id, banner, response, CAST(count(*) AS BIGINT) AS n,
       CAST(sum(count(*)) OVER (PARTITION BY study_id, banner) AS BIGINT) AS base
FROM cells GROUP BY study_id, banner, response""")
def e2_separate(spark: SparkSession, path: str) -> DataFrame:
    evaluation = r.evaluations(spark, path)
    dimension = respondent_dimension(
        evaluation, ["wave", "status"], r.wave_labels(spark, path), "separate"
    )
    table = m.frequency(r.priority_facts(evaluation), dimension)
    return table.select("study_id", "banner", "response", big("n"), big("base"))


@register("o2_banner_order", f"""
WITH {r.EVALUATIONS_SQL},
cells AS (
  SELECT DISTINCT study_id, -1 AS g, CAST(NULL AS DOUBLE) AS num, 'total' AS txt,
         'Total' AS banner FROM evaluations UNION ALL
  SELECT DISTINCT study_id, 0, CAST(wave AS DOUBLE), coalesce(CAST(wave AS VARCHAR), 'sin dato'),
         'wave: ' || {WAVE_HEADING} FROM evaluations UNION ALL
  SELECT DISTINCT study_id, 1, NULL, lower(status), 'status: ' || status FROM evaluations)
SELECT study_id, banner, CAST(row_number() OVER (
  PARTITION BY study_id ORDER BY g, num IS NULL, num, txt, banner) - 1 AS BIGINT) AS banner_pos
FROM cells""")
def o2_banner_order(spark: SparkSession, path: str) -> DataFrame:
    from tabuloom.operators.breakdown import explode_cells
    evaluation = r.evaluations(spark, path)
    dimension = respondent_dimension(
        evaluation, ["wave", "status"], r.wave_labels(spark, path), "separate"
    )
    order = banner_order(explode_cells(dimension), ["study_id"])
    return order.select("study_id", "banner", big("banner_pos"))


@register("x_boxes_nps", """
SELECT l_linenumber AS point, l_discount AS discount,
  CAST(count(*) AS BIGINT) AS n,
  CAST(sum(CASE WHEN l_linenumber >= 6 THEN 1 ELSE 0 END) AS BIGINT) AS top2,
  CAST(sum(CASE WHEN l_linenumber <= 2 THEN 1 ELSE 0 END) AS BIGINT) AS bottom2,
  CAST(sum(CASE WHEN (l_linenumber + 1) / 2.0 IN (4, 5) THEN 1 ELSE 0 END) AS BIGINT) AS top2_five,
  CASE WHEN round(l_discount * 100) BETWEEN 0 AND 6 THEN 'Detractor'
       WHEN round(l_discount * 100) IN (7, 8) THEN 'Pasivo'
       WHEN round(l_discount * 100) IN (9, 10) THEN 'Promotor' ELSE '' END AS nps_group
FROM lineitem GROUP BY ALL""")
def x_boxes_nps(spark: SparkSession, path: str) -> DataFrame:
    point = F.col("l_linenumber").cast("double")
    half = (point + 1) / 2
    one, five, seven = F.lit(1.0), F.lit(5.0), F.lit(7.0)
    return r.table(spark, path, "lineitem").select(
        F.col("l_linenumber").alias("point"), F.col("l_discount").alias("discount"),
        top2box(point, one, seven).alias("t"), bottom2box(point, one, seven).alias("b"),
        top2box(half, one, five).alias("t5"),
        nps_group(F.round(F.col("l_discount") * 100)).alias("nps_group"),
    ).groupBy("point", "discount", "nps_group").agg(
        F.count("*").alias("n"), F.sum("t").alias("top2"), F.sum("b").alias("bottom2"),
        F.sum("t5").alias("top2_five"),
    )


def scale_facts(spark: SparkSession, path: str) -> DataFrame:
    value, low, high = F.col("value"), F.col("scale_min"), F.col("scale_max")
    return r.line_scales(spark, path).withColumns({
        "top2box": top2box(value, low, high), "bottombox": bottom2box(value, low, high),
        "nps_group": F.when(F.col("question_id") == "NPS", nps_group(value)).otherwise(""),
    })


def status_dimension(spark: SparkSession, path: str, weight: str | None = "factor") -> DataFrame:
    """Evaluations by status, dealt so that facts of many respondents join in as many tasks."""
    dimension = respondent_dimension(r.evaluations(spark, path), "status", weight=weight)
    return r.dealt(spark, path, dimension, "study_id", "respondent_id")


SCALE_CELLS = """scored AS (
  SELECT s.*, e.factor, e.segment, e.status,
    CASE WHEN value >= hi - 1 THEN 1 ELSE 0 END AS top2,
    CASE WHEN value <= lo + 1 THEN 1 ELSE 0 END AS low2,
    CASE WHEN s.question_id <> 'NPS' THEN '' WHEN value BETWEEN 0 AND 6 THEN 'D'
         WHEN value IN (7, 8) THEN 'Q' ELSE 'P' END AS grp
  FROM scales s JOIN evaluations e USING (study_id, respondent_id)),
cells AS (SELECT *, 'Total' AS banner FROM scored UNION ALL SELECT *, status FROM scored)"""


@register("a4_scale", f"""
WITH {r.EVALUATIONS_SQL}, {r.LINES_SQL}, {SCALE_CELLS}
SELECT study_id, question_id, banner, CAST(count(DISTINCT respondent_id) AS BIGINT) AS n,
  round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd,
  round(sum(value * factor) / sum(factor), 6) AS mean_weighted,
  round(avg(top2), 6) AS top2box, round(avg(low2), 6) AS bottombox
FROM cells GROUP BY ALL""")
def a4_scale(spark: SparkSession, path: str) -> DataFrame:
    dimension = status_dimension(spark, path)
    moments = m.cell_moments(scale_facts(spark, path), dimension)
    return m.scale_summary(moments).select(
        "study_id", "question_id", "banner", big("n"), r6("mean"), r6("sd"),
        r6("mean_weighted"), r6("top2box"), r6("bottombox"),
    )


@register("a4_large_values", f"""
WITH {r.EVALUATIONS_SQL}, {r.LINES_SQL}, {SCALE_CELLS}
SELECT study_id, question_id, banner, round(avg(value + 1e9), 4) AS mean,
  round(stddev_samp(value + 1e9), 4) AS sd
FROM cells GROUP BY ALL""")
def a4_large_values(spark: SparkSession, path: str) -> DataFrame:
    """The same scales a billion higher: the spread stays."""
    dimension = status_dimension(spark, path)
    facts = scale_facts(spark, path).withColumn("value", F.col("value") + 1e9)
    return m.scale_summary(m.cell_moments(facts, dimension)).select(
        "study_id", "question_id", "banner", F.round("mean", 4).alias("mean"),
        F.round("sd", 4).alias("sd"))


@register("a5_nps", f"""
WITH {r.EVALUATIONS_SQL}, {r.LINES_SQL}, {SCALE_CELLS},
s AS (SELECT study_id, question_id, banner, count(DISTINCT respondent_id) AS n,
        sum(factor) AS w, sum(CASE WHEN grp = 'P' THEN factor ELSE 0 END) AS p,
        sum(CASE WHEN grp = 'Q' THEN factor ELSE 0 END) AS q,
        sum(CASE WHEN grp = 'D' THEN factor ELSE 0 END) AS d
      FROM cells WHERE question_id = 'NPS' GROUP BY ALL)
SELECT study_id, question_id, banner, CAST(n AS BIGINT) AS n, round(p / w, 6) AS promoters,
  round(q / w, 6) AS passives, round(d / w, 6) AS detractors,
  round((p - d) / w * 100, 6) AS nps FROM s""")
def a5_nps(spark: SparkSession, path: str) -> DataFrame:
    dimension = status_dimension(spark, path)
    facts = scale_facts(spark, path).filter("question_id = 'NPS'")
    return m.nps_summary(facts, dimension).select(
        "study_id", "question_id", "banner", big("n"), r6("promoters"), r6("passives"),
        r6("detractors"), r6("nps"),
    )


@register("f1_filters", f"""
WITH {r.EVALUATIONS_SQL}
SELECT study_id, status, coalesce(CAST(wave AS VARCHAR), '') AS wave,
  CAST(count(*) AS BIGINT) AS n FROM evaluations
WHERE (wave IN (1, 2) OR wave IS NULL) AND status IN ('F', 'O') GROUP BY ALL""")
def f1_filters(spark: SparkSession, path: str) -> DataFrame:
    evaluation = r.evaluations(spark, path)
    chosen = {"wave": ["1", 2.0, None], "status": [" F", "O "], "nation": [], "unknown": [1]}
    return evaluation.filter(filter_condition(evaluation, chosen)).groupBy(
        "study_id", "status", code_text(F.col("wave"), column_type(evaluation, "wave")).alias("wave")
    ).agg(F.count("*").alias("n"))


@register("x3_code_text", """
SELECT CASE WHEN v IS NULL THEN '' WHEN v = floor(v) THEN CAST(CAST(v AS BIGINT) AS VARCHAR)
  ELSE CAST(v AS VARCHAR) END AS code, CAST(count(*) AS BIGINT) AS n
FROM (SELECT CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity / 2 END AS v FROM lineitem)
GROUP BY ALL""")
def x3_code_text(spark: SparkSession, path: str) -> DataFrame:
    lines = r.table(spark, path, "lineitem").select(
        F.when(F.col("l_linenumber") != 7, F.col("l_quantity") / 2).alias("v")
    )
    return lines.groupBy(code_text(F.col("v"), column_type(lines, "v")).alias("code")).agg(
        F.count("*").alias("n")
    )


@register("j1_weights", f"""
WITH {r.CUSTOMERS_SQL}
SELECT study_id, segment, CAST(count(*) AS BIGINT) AS n,
  round(sum(CASE WHEN balance < 0 THEN 1.0 ELSE factor END), 6) AS weighted
FROM customers GROUP BY ALL""")
def j1_weights(spark: SparkSession, path: str) -> DataFrame:
    people = r.customers(spark, path).withColumn(
        "text_weight", F.when(F.col("balance") < 0, "sin peso").otherwise(
            F.col("factor").cast("string"))
    )
    dimension = respondent_dimension(people, None, weight="text_weight", extra=["segment"])
    return dimension.groupBy("study_id", "segment").agg(
        F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("weighted")
    )


@register("o1_response_order", f"""
WITH {r.EVALUATIONS_SQL}, {r.PRIORITY_SQL},
t AS (SELECT study_id, question_id, response, min(CAST(code AS DOUBLE)) AS code, count(*) AS n
      FROM priority GROUP BY ALL)
SELECT study_id, question_id, response,
  CAST(row_number() OVER (PARTITION BY study_id ORDER BY
    CASE WHEN code <= 3 THEN 0 ELSE 1 END, CASE WHEN code <= 3 THEN -code END,
    lower(response)) AS BIGINT) AS by_label,
  CAST(row_number() OVER (PARTITION BY study_id ORDER BY code, lower(response)) AS BIGINT) AS by_code,
  CAST(row_number() OVER (PARTITION BY study_id ORDER BY n DESC, lower(response)) AS BIGINT)
    AS by_frequency
FROM t""")
def o1_response_order(spark: SparkSession, path: str) -> DataFrame:
    evaluation = r.evaluations(spark, path)
    facts = r.priority_facts(evaluation)
    options = facts.select("study_id", "question_id", "variable", "code",
                           F.col("response").alias("label")).distinct().withColumn(
        # Only three labels carry an order, in reverse of their code.
        "ord", F.when(F.col("code").cast("int") <= 3, -F.col("code").cast("int"))
    )
    cells = m.frequency(facts, respondent_dimension(evaluation, "segment"))
    result = None
    for mode in ("label", "code", "frequency"):
        part = order_responses(cells, options, mode).select(
            "study_id", "question_id", "response",
            F.col("response_pos").cast("bigint").alias(f"by_{mode}"),
        )
        result = part if result is None else result.join(
            part, ["study_id", "question_id", "response"]
        )
    return result

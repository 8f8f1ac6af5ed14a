"""The given tables read as survey studies.

`orders` is a study with repeated evaluations per customer, `customer` one with
independent respondents, `events` a multiple-response study of user days and
`lineitem` carries scales, grids and loops per order.  The study is the region
of the customer, so every query covers several studies in one job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


#: Tasks of a dealt frame for each task that reads `lineitem`, whose files are cut at a size that the session sets.
DEALT = 32


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def dealt(spark: SparkSession, path: str, frame: DataFrame, *keys: str) -> DataFrame:
    """The frame dealt by its keys into tasks whose number grows with `lineitem`, so that their memory does not.

    Joins and reductions by the same keys then use these tasks.  A respondent lies in one of them.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    reads = table(spark, path, "lineitem").select("l_orderkey").rdd.getNumPartitions()
    return frame.repartition(max(parts, DEALT * reads) if reads > 1 else parts, *keys)


def customers(spark: SparkSession, path: str) -> DataFrame:
    """Respondents of the independent design."""
    geography = table(spark, path, "nation").join(
        table(spark, path, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    ).select("n_nationkey", F.col("r_name").alias("study_id"))
    return table(spark, path, "customer").join(
        geography, F.col("c_nationkey") == F.col("n_nationkey")
    ).select(
        "study_id",
        F.col("c_custkey").alias("respondent_id"), F.col("c_custkey").alias("person_id"),
        F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"),
        F.col("c_acctbal").alias("balance"),
        (F.lit(0.5) + (F.col("c_custkey") % 7) * 0.25).alias("factor"),
        F.when(F.col("c_custkey") % 10 != 0, F.col("c_custkey") % 3).alias("wave"),
    )


CUSTOMERS_SQL = """customers AS (
  SELECT r_name AS study_id, c_custkey AS respondent_id, c_custkey AS person_id,
         c_mktsegment AS segment, c_nationkey AS nation, c_acctbal AS balance,
         0.5 + (c_custkey % 7) * 0.25 AS factor,
         CASE WHEN c_custkey % 10 <> 0 THEN c_custkey % 3 END AS wave
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)"""


def evaluations(spark: SparkSession, path: str) -> DataFrame:
    """Respondents of the repeated design: one row per order."""
    people = customers(spark, path).select(
        "study_id", "person_id", "segment", "nation", F.col("wave").alias("person_wave")
    )
    return table(spark, path, "orders").join(
        people, F.col("o_custkey") == F.col("person_id")
    ).select(
        "study_id", F.col("o_orderkey").alias("respondent_id"), "person_id", "segment",
        F.col("o_orderstatus").alias("status"), "o_orderpriority",
        F.col("o_totalprice").alias("amount"), "nation",
        (F.lit(0.5) + (F.col("o_orderkey") % 7) * 0.25).alias("factor"),
        F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderkey") % 3).alias("wave"),
    )


EVALUATIONS_SQL = CUSTOMERS_SQL + """,
evaluations AS (
  SELECT study_id, o_orderkey AS respondent_id, person_id, segment,
         o_orderstatus AS status, o_orderpriority, o_totalprice AS amount, nation,
         0.5 + (o_orderkey % 7) * 0.25 AS factor,
         CASE WHEN o_orderkey % 10 <> 0 THEN o_orderkey % 3 END AS wave
  FROM orders JOIN customers ON o_custkey = person_id)"""


def studies(spark: SparkSession, path: str) -> DataFrame:
    """The studies are the regions."""
    return table(spark, path, "region").select(F.col("r_name").alias("study_id"))


def wave_labels(spark: SparkSession, path: str) -> DataFrame:
    """Value labels of the wave; the second label of code 1 must lose."""
    labels = (("0", "Inicial"), ("1", "Media"), ("1.0", "Otra"), ("2", "2"))
    return studies(spark, path).select("study_id", F.lit("wave").alias("variable"), F.inline(F.array(*[
        F.struct(F.lit(code).alias("code"), F.lit(label).alias("label"), F.lit(i).alias("ord"))
        for i, (code, label) in enumerate(labels, 1)])))


def priority_facts(evaluation: DataFrame) -> DataFrame:
    """Single choice: order priority."""
    parts = F.split("o_orderpriority", "-", 2)
    return evaluation.select(
        "study_id", F.lit("PRIORITY").alias("question_id"), "respondent_id",
        F.lit("o_orderpriority").alias("variable"), parts[0].alias("code"),
        parts[1].alias("response"),
    )


PRIORITY_SQL = """priority AS (
  SELECT study_id, 'PRIORITY' AS question_id, respondent_id,
         split_part(o_orderpriority, '-', 1) AS code,
         substr(o_orderpriority, 3) AS response, factor, wave, segment, status, person_id
  FROM evaluations)"""


def line_scales(spark: SparkSession, path: str) -> DataFrame:
    """Two scale questions per order line: recommendation 0-10 and ease 1-7."""
    studies = evaluations(spark, path).select("study_id", "respondent_id")
    lines = table(spark, path, "lineitem").select(
        F.col("l_orderkey").alias("respondent_id"), "l_discount", "l_linenumber")
    # Joined before they become two rows each.
    return lines.join(dealt(spark, path, studies, "respondent_id"), "respondent_id").select(
        "study_id", "respondent_id",
        F.explode(F.array(
            F.struct(F.lit("NPS").alias("question_id"),
                     F.round(F.col("l_discount") * 100).alias("value"),
                     F.lit(0.0).alias("scale_min"), F.lit(10.0).alias("scale_max")),
            F.struct(F.lit("EASE").alias("question_id"),
                     F.col("l_linenumber").cast("double").alias("value"),
                     F.lit(1.0).alias("scale_min"), F.lit(7.0).alias("scale_max")),
        )).alias("item"),
    ).select("respondent_id", "item.*", "study_id")


LINES_SQL = """scales AS (
  SELECT study_id, l_orderkey AS respondent_id, 'NPS' AS question_id,
         round(l_discount * 100) AS value, 0.0 AS lo, 10.0 AS hi
  FROM lineitem JOIN evaluations ON l_orderkey = respondent_id
  UNION ALL
  SELECT study_id, l_orderkey, 'EASE', CAST(l_linenumber AS DOUBLE), 1.0, 7.0
  FROM lineitem JOIN evaluations ON l_orderkey = respondent_id)"""


def event_days(spark: SparkSession, path: str) -> DataFrame:
    """Multiple response: event types of one user on one day."""
    return table(spark, path, "events").select(
        F.concat(F.lit("arm"), (F.col("user_id") % 3).cast("string")).alias("study_id"),
        F.lit("ACTIONS").alias("question_id"),
        (F.col("user_id") * 100 + F.dayofmonth("ts")).alias("respondent_id"),
        F.col("user_id").alias("person_id"), F.dayofmonth("ts").alias("day"),
        F.col("event_type").alias("code"), F.col("event_type").alias("response"),
        "event_id", "value",
    )


EVENT_DAYS_SQL = """event_days AS (
  SELECT 'arm' || (user_id % 3) AS study_id, 'ACTIONS' AS question_id,
         user_id * 100 + dayofmonth(ts) AS respondent_id, user_id AS person_id,
         dayofmonth(ts) AS day, event_type AS code, event_type AS response,
         event_id, value
  FROM events)"""


def event_respondents(spark: SparkSession, path: str) -> DataFrame:
    """User days with a week and a weight."""
    return event_days(spark, path).groupBy("study_id", "respondent_id", "person_id", "day").agg(
        F.count("*").alias("n_events")
    ).withColumns({
        "week": F.floor((F.col("day") - 1) / 7).cast("int"),
        "factor": F.lit(1.0) + (F.col("respondent_id") % 4) * 0.5,
    })


EVENT_RESPONDENTS_SQL = EVENT_DAYS_SQL + """,
event_respondents AS (
  SELECT study_id, respondent_id, person_id, day, count(*) AS n_events,
         CAST(floor((day - 1) / 7.0) AS INTEGER) AS week,
         1.0 + (respondent_id % 4) * 0.5 AS factor
  FROM event_days GROUP BY 1, 2, 3, 4)"""


def entity_grid(spark: SparkSession, path: str) -> DataFrame:
    """Grid: entity return flag, option line status, every cell of an answered order.

    An order without lines of a flag has no cells there with a value.
    """
    lines = table(spark, path, "lineitem").select(
        F.col("l_orderkey").alias("respondent_id"), "l_returnflag", "l_linestatus")
    names = [(e, o) for e in "ANR" for o in "FO"]
    counts = dealt(spark, path, lines, "respondent_id").groupBy("respondent_id").agg(*[
        F.count_if((F.col("l_returnflag") == e) & (F.col("l_linestatus") == o)).alias(f"n_{e}_{o}") for e, o in names])
    studies = evaluations(spark, path).select("study_id", "respondent_id")
    # One row per order up to the join, and its six cells after it.
    frame = dealt(spark, path, studies, "respondent_id").join(counts, "respondent_id", "left").select(
        "study_id", "respondent_id", F.inline(F.array(*[F.struct(
            F.lit(e).alias("entity"), F.lit(o).alias("option"), F.col(f"n_{e}_{o}").alias("n_lines")) for e, o in names])))
    return frame.select(
        "study_id", F.lit("GRID").alias("question_id"), F.lit("GRID").alias("grid_id"),
        "respondent_id", "entity", "option", F.lit("1").alias("option_code"),
        # Two lines or more is a 'no' (0), one line a 'yes' (1).
        F.when(F.col("n_lines") == 1, "1").when(F.col("n_lines") > 1, "0").alias("value"),
    )


GRID_SQL = """grid AS (
  SELECT e.study_id, 'GRID' AS question_id, e.respondent_id, a.entity, o.option,
         CASE WHEN n_lines = 1 THEN '1' WHEN n_lines > 1 THEN '0' END AS value
  FROM evaluations e
  CROSS JOIN (VALUES ('A'), ('N'), ('R')) a(entity)
  CROSS JOIN (VALUES ('F'), ('O')) o(option)
  LEFT JOIN (SELECT l_orderkey, l_returnflag, l_linestatus, count(*) AS n_lines
             FROM lineitem GROUP BY 1, 2, 3) l
    ON l_orderkey = e.respondent_id AND l_returnflag = a.entity AND l_linestatus = o.option)"""

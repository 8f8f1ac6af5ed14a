"""Significance tests, paired designs, units and weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from study_queries import roles as r
from study_queries.core import SCALE_CELLS, SEGMENT_CELLS, big, r6, scale_facts, status_dimension
from tabuloom.functions import pvalues as pv
from tabuloom.operators import metrics as m
from tabuloom.operators import paired as p
from tabuloom.operators.pairing import pairing_problems
from tabuloom.operators import significance as z
from tabuloom.operators import units as u
from tabuloom.operators import weights as w
from tabuloom.operators.breakdown import expand_slices, respondent_dimension

QUERIES, SQL = {}, {}


def register(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function
    return add


def horner_sql(coefficients, x: str) -> str:
    text = repr(coefficients[0])
    for c in coefficients[1:]:
        text = f"({text}) * ({x}) + CAST({c!r} AS DOUBLE)"
    return f"({text})"


def erfc_sql(x: str) -> str:
    """The same rational approximation for the SQL twins; DuckDB has no erf."""
    sq, inv = f"({x}) * ({x})", f"(1.0 / (({x}) * ({x})))"
    small = f"1 - ({x}) * {horner_sql(pv.ERF_SMALL_P, sq)} / {horner_sql(pv.ERF_SMALL_Q, sq)}"
    middle = (f"exp(-({sq})) * {horner_sql(pv.ERFC_MIDDLE_P, x)}"
              f" / {horner_sql(pv.ERFC_MIDDLE_Q, x)}")
    tail = f"{inv} * {horner_sql(pv.ERFC_LARGE_P, inv)} / {horner_sql(pv.ERFC_LARGE_Q, inv)}"
    large = f"exp(-({sq})) / ({x}) * ({pv.ONE_OVER_SQRT_PI!r} - {tail})"
    return (f"CASE WHEN ({x}) <= 0.46875 THEN {small} WHEN ({x}) <= 4.0 THEN {middle}"
            f" ELSE {large} END")


Z_EXPR = """(x1 / n1 - x2 / n2) / sqrt(((x1 + x2) / (n1 + n2)) * (1 - (x1 + x2) / (n1 + n2))
  * (1 / n1 + 1 / n2))"""


def letters_sql(counts: str, x: str, n: str) -> str:
    """Letters of lower columns, appended in column order."""
    return f"""
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY study_id, response ORDER BY lower(banner)) AS pos
  FROM {counts} WHERE banner <> 'Total'),
pairs AS (
  SELECT a.study_id, a.response, a.banner, b.pos, CAST(a.{x} AS DOUBLE) AS x1,
    CAST(a.{n} AS DOUBLE) AS n1, CAST(b.{x} AS DOUBLE) AS x2, CAST(b.{n} AS DOUBLE) AS n2
  FROM ordered a JOIN ordered b ON a.study_id = b.study_id AND a.response = b.response
    AND a.pos <> b.pos),
marks AS (
  SELECT study_id, response, banner, string_agg(chr(CAST(64 + pos AS INTEGER)), '' ORDER BY pos) AS letters
  FROM pairs WHERE n1 >= 30 AND n2 >= 30 AND x1 / n1 > x2 / n2 AND x1 + x2 < n1 + n2
    AND {Z_EXPR} > 1.959963984540054
  GROUP BY ALL)"""


# A smaller study per nation gives columns that differ.
@register("z1_letters", f"""
WITH {r.EVALUATIONS_SQL}, {r.PRIORITY_SQL}, {SEGMENT_CELLS},
c AS (SELECT study_id, banner, response, count(*) AS n,
        sum(count(*)) OVER (PARTITION BY study_id, banner) AS base FROM cells GROUP BY 1, 2, 3),
{letters_sql("c", "n", "base")}
SELECT study_id, 'PRIORITY' AS question_id, banner, response, CAST(n AS BIGINT) AS n,
  CAST(base AS BIGINT) AS base, round(n / base, 6) AS pct, coalesce(letters, '') AS letters
FROM c LEFT JOIN marks USING (study_id, banner, response)""")
def z1_letters(spark: SparkSession, path: str) -> DataFrame:
    evaluation = r.evaluations(spark, path)
    cells = m.frequency(r.priority_facts(evaluation), respondent_dimension(evaluation, "segment"))
    letters = z.proportion_letters(cells).drop("banner_pos")
    return cells.join(letters, ["study_id", "question_id", "response", "banner"], "left").select(
        "study_id", "question_id", "banner", "response", big("n"), big("base"), r6("pct"),
        F.coalesce("letters", F.lit("")).alias("letters"),
    )


NATION_FACTS_SQL = """facts AS (
  SELECT 'all' AS study_id, o_orderkey AS respondent_id, 'N' || lpad(CAST(nation AS VARCHAR), 2, '0')
           AS banner, o_orderpriority AS response
  FROM (SELECT respondent_id AS o_orderkey, nation, o_orderpriority FROM evaluations)),
c AS (SELECT study_id, banner, response, count(*) AS n,
        sum(count(*)) OVER (PARTITION BY study_id, banner) AS base FROM facts GROUP BY 1, 2, 3)"""


def nation_study(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    evaluation = r.evaluations(spark, path).withColumns({
        "study_id": F.lit("all"),
        "column": F.concat(F.lit("N"), F.lpad(F.col("nation").cast("string"), 2, "0")),
    })
    facts = evaluation.select("study_id", F.lit("PRIORITY").alias("question_id"), "respondent_id",
                              F.col("o_orderpriority").alias("response"))
    return evaluation, facts


@register("z1_letters_many", f"""
WITH {r.EVALUATIONS_SQL}, {NATION_FACTS_SQL}, {letters_sql("c", "n", "base")}
SELECT banner, response, CAST(n AS BIGINT) AS n, coalesce(letters, '') AS letters
FROM c LEFT JOIN marks USING (study_id, banner, response)""")
def z1_letters_many(spark: SparkSession, path: str) -> DataFrame:
    """25 columns of one breakdown variable."""
    evaluation, facts = nation_study(spark, path)
    cells = m.frequency(facts, respondent_dimension(evaluation, "column"))
    letters = z.proportion_letters(cells)
    return cells.filter("banner <> 'Total'").join(
        letters, ["study_id", "question_id", "response", "banner"], "left"
    ).select("banner", "response", big("n"), F.coalesce("letters", F.lit("")).alias("letters"))


WELCH_SQL = f"""{r.EVALUATIONS_SQL}, {r.LINES_SQL}, {SCALE_CELLS},
s AS (SELECT study_id, question_id, banner, count(*) AS n, avg(value) AS mean,
        var_samp(value) AS var FROM cells WHERE banner <> 'Total' GROUP BY ALL),
t AS (SELECT a.study_id, a.question_id, a.banner AS banner_l, b.banner AS banner_r,
        a.mean - b.mean AS difference, a.var / a.n AS va, b.var / b.n AS vb, a.n AS na, b.n AS nb
      FROM s a JOIN s b ON a.study_id = b.study_id AND a.question_id = b.question_id
        AND a.banner < b.banner)"""


def status_moments(spark: SparkSession, path: str) -> DataFrame:
    return m.cell_moments(scale_facts(spark, path), status_dimension(spark, path, weight=None))


@register("z2_welch_stat", f"""
WITH {WELCH_SQL}
SELECT study_id, question_id, banner_l, banner_r, round(difference, 6) AS difference,
  round(difference / sqrt(va + vb), 6) AS t,
  round((va + vb) * (va + vb) / (va * va / (na - 1) + vb * vb / (nb - 1)), 4) AS df
FROM t""")
def z2_welch_stat(spark: SparkSession, path: str) -> DataFrame:
    pairs = z.welch_pairs(status_moments(spark, path), with_p=False)
    return pairs.select("study_id", "question_id", "banner_l", "banner_r", r6("difference"),
                        r6("t"), F.round("df", 4).alias("df"))


def t_tail_sql(t: str, df: str) -> str:
    """Two-sided tail of Student's t by Simpson's rule on its density, which is even in the angle."""
    start, steps = f"atan(abs({t}) / sqrt({df}))", 4000
    # Beyond 14 standard deviations there is nothing left to add.
    step = f"(least(pi() / 2 - {start}, 14 / sqrt({df})) / {steps})"
    return f"""(2 * exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt(pi()) * {step} / 3 * list_sum(
    list_transform(range(0, {steps + 1}), lambda i: (CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4
    ELSE 2 END) * pow(greatest(cos({start} + i * {step}), 0), {df} - 1))))"""


WELCH_P_SQL = f"""{WELCH_SQL},
w AS (SELECT study_id, question_id, banner_l, banner_r, difference, difference / sqrt(va + vb) AS t,
        (va + vb) * (va + vb) / (va * va / (na - 1) + vb * vb / (nb - 1)) AS df FROM t),
p AS (SELECT *, {t_tail_sql("t", "df")} AS p FROM w)"""


@register("z2_welch_letters", f"""
WITH {WELCH_P_SQL}
SELECT study_id, question_id, banner_l, banner_r, round(t, 6) AS t, round(p, 9) AS p_value, p < 0.1 AS significant
FROM p""")
def z2_welch_letters(spark: SparkSession, path: str) -> DataFrame:
    pairs = z.welch_pairs(status_moments(spark, path), confidence=0.9)
    return pairs.select("study_id", "question_id", "banner_l", "banner_r", r6("t"),
                        F.round("p_value", 9).alias("p_value"), "significant")


@register("z2_mean_letters", f"""
WITH {WELCH_P_SQL},
ordered AS (SELECT DISTINCT study_id, question_id, banner FROM s),
pos AS (SELECT *, row_number() OVER (PARTITION BY study_id, question_id ORDER BY lower(banner)) AS pos FROM ordered),
higher AS (SELECT study_id, question_id, CASE WHEN difference > 0 THEN banner_l ELSE banner_r END AS banner,
             CASE WHEN difference > 0 THEN banner_r ELSE banner_l END AS other FROM p WHERE p < 0.5 AND difference <> 0)
SELECT h.study_id, h.question_id, h.banner, string_agg(chr(CAST(64 + pos AS INTEGER)), '' ORDER BY pos) AS letters
FROM higher h JOIN pos ON pos.study_id = h.study_id AND pos.question_id = h.question_id AND pos.banner = h.other
GROUP BY ALL""")
def z2_mean_letters(spark: SparkSession, path: str) -> DataFrame:
    """Letters of the means, at a low confidence so that there are some."""
    letters = z.mean_letters(status_moments(spark, path), confidence=0.5)
    return letters.select("study_id", "question_id", "banner", "letters")


@register("z3_box_letters", f"""
WITH {r.EVALUATIONS_SQL}, {r.LINES_SQL}, {SCALE_CELLS},
k AS (SELECT study_id || question_id AS study_id, 'Top2Box' AS response, banner,
        sum(top2) AS x, count(*) AS n FROM cells GROUP BY ALL UNION ALL
      SELECT study_id || question_id, 'BottomBox', banner, sum(low2), count(*) FROM cells GROUP BY ALL),
{letters_sql("k", "x", "n")}
SELECT study_id, response, banner, coalesce(letters, '') AS letters
FROM k LEFT JOIN marks USING (study_id, response, banner) WHERE banner <> 'Total'""")
def z3_box_letters(spark: SparkSession, path: str) -> DataFrame:
    moments = status_moments(spark, path)
    both = z.combine_letters([z.box_letters(moments, "top2box"), z.box_letters(moments, "bottombox")])
    return both.select(F.concat("study_id", "question_id").alias("study_id"), "response", "banner",
                       "letters")


@register("z4_low_bases", f"""
WITH {r.EVALUATIONS_SQL}, {NATION_FACTS_SQL}
SELECT banner, CAST(max(base) AS BIGINT) AS base FROM c GROUP BY ALL HAVING max(base) < 600""")
def z4_low_bases(spark: SparkSession, path: str) -> DataFrame:
    evaluation, facts = nation_study(spark, path)
    cells = m.frequency(facts, respondent_dimension(evaluation, "column"))
    return z.low_bases(cells, 600).select("banner", big("base"))


@register("w6_legend", f"""
WITH {r.EVALUATIONS_SQL}
SELECT banner, CAST(pos AS BIGINT) AS banner_pos,
  CASE WHEN pos <= 26 THEN chr(CAST(64 + pos AS INTEGER)) ELSE 'A' || (pos - 26) END AS letter
FROM (SELECT CAST(d AS VARCHAR) AS banner, row_number() OVER (ORDER BY d) AS pos
      FROM (SELECT DISTINCT respondent_id % 45 AS d FROM evaluations))""")
def w6_legend(spark: SparkSession, path: str) -> DataFrame:
    """45 columns, so letters go past Z."""
    evaluation = r.evaluations(spark, path).withColumns({
        "study_id": F.lit("all"), "column": F.col("respondent_id") % 45,
    })
    facts = evaluation.select("study_id", F.lit("P").alias("question_id"), "respondent_id",
                              F.col("status").alias("response"))
    cells = m.frequency(facts, respondent_dimension(evaluation, "column"))
    return z.column_legend(cells).select("banner", big("banner_pos"), "letter")


@register("z8_suppression", f"""
WITH {r.EVALUATIONS_SQL}, e AS (
  SELECT study_id, 'PRIORITY' AS question_id, person_id FROM evaluations UNION ALL
  SELECT study_id, 'PROFILE', person_id FROM customers)
SELECT study_id, question_id, CAST(count(*) AS BIGINT) AS evaluations,
  CAST(count(DISTINCT person_id) AS BIGINT) AS persons,
  count(*) > count(DISTINCT person_id) AS suppressed FROM e GROUP BY ALL""")
def z8_suppression(spark: SparkSession, path: str) -> DataFrame:
    evaluation, people = r.evaluations(spark, path), r.customers(spark, path)
    repeated = z.repeated_persons(r.priority_facts(evaluation), evaluation)
    independent = z.repeated_persons(
        people.select("study_id", F.lit("PROFILE").alias("question_id"), "respondent_id"), people
    )
    return repeated.unionByName(independent).select(
        "study_id", "question_id", big("evaluations"), big("persons"), "suppressed"
    )


# Canonical family: share of every priority, all pairs of the 5 segments, per study.
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
SEGMENT_PAIRS = [(a, b) for i, a in enumerate(SEGMENTS) for b in SEGMENTS[i + 1:]]

P_FROM_Z = erfc_sql("abs(z) / sqrt(2.0)")
HOLM_SQL = f"""{r.EVALUATIONS_SQL},
c AS (SELECT segment, o_orderpriority AS response, count(*) AS x,
        sum(count(*)) OVER (PARTITION BY segment) AS n FROM evaluations
      WHERE segment IS NOT NULL GROUP BY 1, 2),
q AS (SELECT a.response, a.segment AS slice_l, b.segment AS slice_r,
        CAST(a.x AS DOUBLE) AS x1, CAST(a.n AS DOUBLE) AS n1, CAST(b.x AS DOUBLE) AS x2,
        CAST(b.n AS DOUBLE) AS n2
      FROM c a JOIN c b ON a.response = b.response AND a.segment < b.segment),
zz AS (SELECT *, {Z_EXPR} AS z FROM q),
pp AS (SELECT *, {P_FROM_Z} AS p FROM zz),
rr AS (SELECT *, row_number() OVER (PARTITION BY response ORDER BY p, slice_l, slice_r) AS rn,
         count(*) OVER (PARTITION BY response) AS m FROM pp),
h AS (SELECT *, max(least(1.0, (m - rn + 1) * p)) OVER (
        PARTITION BY response ORDER BY p, slice_l, slice_r
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pa FROM rr)"""


def segment_family(spark: SparkSession, path: str) -> DataFrame:
    evaluation = r.evaluations(spark, path).withColumn("study_id", F.lit("all"))
    slices = expand_slices(evaluation, "segment", [(s, s, s.title()) for s in SEGMENTS])
    counts = slices.groupBy("study_id", "slice_id", F.col("o_orderpriority").alias("response")).agg(
        F.count("*").alias("x")
    )
    bases = slices.groupBy("study_id", "slice_id").agg(F.count("*").alias("n"))
    cells = counts.join(bases, ["study_id", "slice_id"])
    pairs = spark.createDataFrame(
        [(a, b, i) for i, (a, b) in enumerate(SEGMENT_PAIRS)],
        "slice_l string, slice_r string, pair_index int",
    )
    requested = z.request_comparisons(cells, pairs, "slice_id", "x", "n", ["study_id", "response"])
    return requested.withColumns({
        "weighted": F.lit(False), "independent": F.lit(True), "binary": F.lit(True),
    })


@register("z5_holm", f"""
WITH {HOLM_SQL}
SELECT response, slice_l, slice_r, round(z, 6) AS z, round(p, 9) AS p_value,
  round(pa, 9) AS p_adjusted, CASE WHEN pa < 0.1 THEN 'SIGNIFICANT' ELSE 'NOT_SIGNIFICANT' END AS status,
  CASE WHEN x1 / n1 > x2 / n2 THEN 'LEFT_GREATER' WHEN x1 / n1 < x2 / n2 THEN 'RIGHT_GREATER' END
    AS direction
FROM h""")
def z5_holm(spark: SparkSession, path: str) -> DataFrame:
    family = z.proportion_family(
        segment_family(spark, path), ["study_id", "response"], 0.90, ["slice_l", "slice_r"]
    )
    return family.select("response", "slice_l", "slice_r", r6("z"),
                         F.round("p_value", 9).alias("p_value"),
                         F.round("p_adjusted", 9).alias("p_adjusted"), "status", "direction")


@register("z5_reasons", f"""
WITH {r.EVALUATIONS_SQL},
c AS (SELECT nation AS k, o_orderpriority AS response,
        count(*) FILTER (WHERE respondent_id % 12 = 0) AS x_small,
        count(*) AS n0 FROM evaluations GROUP BY 1, 2),
n AS (SELECT nation AS k, count(*) AS n FROM evaluations GROUP BY 1),
q AS (SELECT a.k, a.response, a.x_small AS xl, CASE WHEN a.k % 4 = 0 THEN 29 ELSE n.n END AS nl,
        a.n0 AS xr, n.n AS nr FROM c a JOIN n USING (k)),
d AS (SELECT *, (xl + xr) / CAST(nl + nr AS DOUBLE) AS po FROM q)
SELECT CAST(k AS BIGINT) AS k, response, CASE
  WHEN k % 5 = 1 THEN 'UNSUPPORTED_WEIGHTED_INFERENCE'
  WHEN k % 5 = 2 THEN 'UNSUPPORTED_SAMPLE_RELATIONSHIP'
  WHEN k % 5 = 3 THEN 'UNSUPPORTED_NONBINARY_OUTCOME'
  WHEN least(nl, nr) < 30 THEN 'INELIGIBLE_MINIMUM_BASE'
  WHEN least(nl * po, nl * (1 - po), nr * po, nr * (1 - po)) < 5 THEN 'INELIGIBLE_EXPECTED_COUNT'
  ELSE 'ELIGIBLE' END AS reason FROM d""")
def z5_reasons(spark: SparkSession, path: str) -> DataFrame:
    """Pairs that must not be tested, and why."""
    evaluation = r.evaluations(spark, path)
    counts = evaluation.groupBy(F.col("nation").alias("k"),
                                F.col("o_orderpriority").alias("response")).agg(
        F.count_if(F.col("respondent_id") % 12 == 0).alias("x_l"), F.count("*").alias("x_r")
    )
    bases = evaluation.groupBy(F.col("nation").alias("k")).agg(F.count("*").alias("n_r"))
    pairs = counts.join(bases, "k").withColumns({
        "n_l": F.when(F.col("k") % 4 == 0, 29).otherwise(F.col("n_r")),
        "weighted": F.col("k") % 5 == 1, "independent": F.col("k") % 5 != 2,
        "binary": F.col("k") % 5 != 3, "pair_index": F.col("k"),
    })
    return z.proportion_family(pairs, ["response"]).select(big("k"), "response", "reason")


@register("z10_both_letters", f"""
WITH {HOLM_SQL},
b AS (SELECT response, slice_l AS slice_id, slice_r AS other FROM h WHERE p < 0.2 UNION ALL
      SELECT response, slice_r, slice_l FROM h WHERE p < 0.2),
l AS (SELECT slice_id, chr(CAST(64 + row_number() OVER (ORDER BY slice_id) AS INTEGER)) AS letter
      FROM (SELECT DISTINCT segment AS slice_id FROM c))
SELECT response, b.slice_id, string_agg(letter, ',' ORDER BY letter) AS letters
FROM b JOIN l ON l.slice_id = b.other GROUP BY ALL""")
def z10_both_letters(spark: SparkSession, path: str) -> DataFrame:
    """Unadjusted relations at 0.2, so that some are marked."""
    family = z.proportion_family(segment_family(spark, path), ["study_id", "response"], 0.90,
                                 ["slice_l", "slice_r"])
    relations = family.withColumn(
        "status", F.when(F.col("p_value") < 0.2, "SIGNIFICANT").otherwise("NOT_SIGNIFICANT")
    )
    slices = r.evaluations(spark, path).select(
        F.lit("all").alias("study_id"), F.lit("segment").alias("dimension"),
        F.col("segment").alias("member"), F.col("segment").alias("slice_id"),
        F.initcap("segment").alias("slice_label"),
    ).distinct()
    letters = z.slice_letters(slices)
    return z.relation_letters(
        relations, letters, ["study_id", "response"]
    ).select("response", "slice_id", "letters")


@register("z11_pair_order", f"""
WITH {HOLM_SQL}
SELECT response, slice_l, slice_r, CAST(x1 AS BIGINT) AS x_l, CAST(x2 AS BIGINT) AS x_r,
  CASE WHEN x1 / n1 > x2 / n2 THEN 'LEFT_GREATER' WHEN x1 / n1 < x2 / n2 THEN 'RIGHT_GREATER' END
    AS direction FROM h""")
def z11_pair_order(spark: SparkSession, path: str) -> DataFrame:
    """Pairs requested the wrong way round come back in canonical order."""
    family = segment_family(spark, path)
    turned = family.select(
        "study_id", "response", "pair_index", "weighted", "independent", "binary",
        *[F.col(f"{c}_l").alias(f"{c}_r") for c in ("slice", "x", "n")],
        *[F.col(f"{c}_r").alias(f"{c}_l") for c in ("slice", "x", "n")],
    )
    relations = z.proportion_family(turned, ["study_id", "response"])
    return z.canonical_pair_order(relations).select(
        "response", "slice_l", "slice_r", big("x_l"), big("x_r"), "direction"
    )


@register("f9_slices", f"""
WITH {r.EVALUATIONS_SQL}
SELECT study_id, segment AS slice_id, CAST(CASE segment WHEN 'MACHINERY' THEN 0 ELSE 1 END AS BIGINT)
  AS slice_order, CAST(count(*) AS BIGINT) AS n
FROM evaluations WHERE segment IN ('MACHINERY', 'BUILDING') AND status IN ('F', 'P') GROUP BY ALL""")
def f9_slices(spark: SparkSession, path: str) -> DataFrame:
    slices = expand_slices(
        r.evaluations(spark, path), "segment",
        [("MACHINERY", "MACHINERY", "Machines"), ("BUILDING", "BUILDING", "Buildings")],
        [("status", ["F", "P"])],
    )
    return slices.groupBy("study_id", "slice_id", big("slice_order")).agg(F.count("*").alias("n"))


# --- persons and pairs ------------------------------------------------------

@register("j3_person_unit", f"""
WITH {r.EVALUATIONS_SQL},
facts AS (SELECT DISTINCT study_id, person_id, segment AS response FROM evaluations)
SELECT study_id, response, CAST(count(*) AS BIGINT) AS n,
  CAST(sum(count(*)) OVER (PARTITION BY study_id) AS BIGINT) AS base
FROM facts GROUP BY study_id, response""")
def j3_person_unit(spark: SparkSession, path: str) -> DataFrame:
    """A person-level answer stored on every evaluation is counted once."""
    evaluation = r.evaluations(spark, path)
    facts = evaluation.select(
        "study_id", F.lit("SEGMENT").alias("question_id"), "respondent_id",
        F.lit("segment").alias("variable"), F.col("segment").alias("code"),
        F.col("segment").alias("response"), F.col("factor").alias("weight"),
    )
    facts, people = u.to_person_unit(facts, evaluation.select(
        "study_id", "respondent_id", "person_id", "segment"), ["code"], ["segment"])
    table = m.frequency(facts, respondent_dimension(people, None))
    return table.select("study_id", "response", big("n"), big("base"))


@register("j3_conflicts", f"""
WITH {r.EVALUATIONS_SQL}
SELECT study_id, CAST(count(*) AS BIGINT) AS persons, CAST(sum(n) AS BIGINT) AS n_rows FROM (
  SELECT study_id, person_id, count(*) AS n FROM evaluations GROUP BY ALL
  HAVING count(DISTINCT o_orderpriority) > 1) GROUP BY ALL""")
def j3_conflicts(spark: SparkSession, path: str) -> DataFrame:
    evaluation = r.evaluations(spark, path)
    problems = u.person_conflicts(r.priority_facts(evaluation), evaluation, ["code"])
    counts = evaluation.groupBy("study_id", "person_id").agg(F.count("*").alias("n"))
    return problems.join(counts, ["study_id", "person_id"]).groupBy("study_id").agg(
        F.count("*").alias("persons"), F.sum("n").alias("n_rows")
    )


@register("a10_bases", f"""
WITH {r.EVALUATIONS_SQL},
ids AS (SELECT DISTINCT study_id, 'LINES' AS question_id, respondent_id
        FROM evaluations JOIN lineitem ON l_orderkey = respondent_id UNION ALL
        SELECT study_id, 'PRIORITY', respondent_id FROM evaluations),
j AS (SELECT ids.*, person_id, status = 'F' AS sel FROM ids JOIN evaluations USING (study_id, respondent_id))
SELECT study_id, question_id, CAST(count(*) FILTER (WHERE sel) AS BIGINT) AS base,
  CAST(count(*) AS BIGINT) AS base_before_filters,
  CAST(count(DISTINCT CASE WHEN sel THEN person_id END) AS BIGINT) AS person_base,
  count(*) FILTER (WHERE sel) > count(DISTINCT CASE WHEN sel THEN person_id END) AS repeated_people,
  true AS repeated_design, 'Evaluaciones' AS base_unit
FROM j GROUP BY ALL""")
def a10_bases(spark: SparkSession, path: str) -> DataFrame:
    evaluation = r.evaluations(spark, path)
    lines = scale_facts(spark, path).withColumn("question_id", F.lit("LINES"))
    bases = u.question_bases(
        [lines, r.priority_facts(evaluation)], evaluation, evaluation.filter("status = 'F'")
    )
    return bases.select("study_id", "question_id", big("base"), big("base_before_filters"),
                        big("person_base"), "repeated_people", "repeated_design", "base_unit")


PAIRED_SQL = """
side AS (SELECT study_id, person_id, day > 15 AS late, avg(value) AS v, count(*) AS n
         FROM event_days GROUP BY ALL),
a AS (SELECT * FROM side WHERE NOT late), b AS (SELECT * FROM side WHERE late),
pairs AS (SELECT coalesce(a.study_id, b.study_id) AS study_id, a.v AS a, b.v AS b, a.n AS na, b.n AS nb
          FROM a FULL JOIN b ON a.study_id = b.study_id AND a.person_id = b.person_id)"""


def event_pairs(spark: SparkSession, path: str) -> DataFrame:
    facts = r.event_days(spark, path).select("study_id", F.col("event_id").alias("respondent_id"),
                                             "person_id", "day", "value")
    people = facts.select("study_id", "respondent_id", "person_id", "day")
    answers = facts.select("study_id", "respondent_id", "value")
    left = p.condition_side(answers, people, "value", F.col("day") <= 15)
    right = p.condition_side(answers, people, "value", F.col("day") > 15)
    return p.person_pairs(left, right)


@register("z6_paired_t_stat", f"""
WITH {r.EVENT_DAYS_SQL}, {PAIRED_SQL}
SELECT study_id, CAST(count(a) AS BIGINT) AS persons_a, CAST(count(b) AS BIGINT) AS persons_b,
  CAST(sum(na) AS BIGINT) AS rows_a, CAST(sum(nb) AS BIGINT) AS rows_b,
  CAST(count(a + b) AS BIGINT) AS pairs,
  round(avg(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN a END), 6) AS mean_a,
  round(avg(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN b END), 6) AS mean_b,
  round(stddev_samp(a - b), 6) AS sd_difference,
  round(avg(a - b) / (stddev_samp(a - b) / sqrt(count(a - b))), 6) AS t
FROM pairs GROUP BY ALL""")
def z6_paired_t_stat(spark: SparkSession, path: str) -> DataFrame:
    stats = p.paired_means(event_pairs(spark, path), duplicates="person_mean", with_p=False)
    return stats.select("study_id", *[big(c) for c in ("persons_a", "persons_b", "rows_a",
                                                        "rows_b", "pairs")],
                        r6("mean_a"), r6("mean_b"), r6("sd_difference"), r6("t"))


@register("z6_paired_t", f"""
WITH RECURSIVE {r.EVENT_DAYS_SQL}, {PAIRED_SQL},
g AS (SELECT study_id, count(a + b) AS n, avg(a - b) AS d, stddev_samp(a - b) / sqrt(count(a - b)) AS se
      FROM pairs GROUP BY ALL),
-- The quantile of t at 0.95 confidence: halve an interval until it is narrow enough.
h AS (SELECT study_id, CAST(n - 1 AS DOUBLE) AS df, 0.0::DOUBLE AS low, 64.0::DOUBLE AS high, 0 AS i FROM g
      UNION ALL
      SELECT study_id, df, CASE WHEN tail > 0.05 THEN mid ELSE low END, CASE WHEN tail > 0.05 THEN high ELSE mid END, i + 1
      FROM (SELECT *, (low + high) / 2 AS mid, {t_tail_sql("((low + high) / 2)", "df")} AS tail FROM h WHERE i < 45)),
k AS (SELECT g.*, (low + high) / 2 AS q FROM g JOIN h USING (study_id) WHERE i = 45),
p AS (SELECT *, {t_tail_sql("(d / se)", "CAST(n - 1 AS DOUBLE)")} AS p FROM k)
SELECT study_id, CAST(n AS BIGINT) AS pairs, round(d, 6) AS difference,
  CASE WHEN n >= 30 THEN round(d - q * se, 6) END AS ci_low, CASE WHEN n >= 30 THEN round(d + q * se, 6) END AS ci_high,
  CASE WHEN n >= 30 THEN round(p, 9) END AS p_value,
  CASE WHEN n < 30 THEN 'Base insuficiente' WHEN p < 1 - 0.95 THEN 'Diferencia significativa'
    ELSE 'Sin diferencia significativa' END AS result FROM p""")
def z6_paired_t(spark: SparkSession, path: str) -> DataFrame:
    stats = p.paired_means(event_pairs(spark, path), duplicates="person_mean")
    return stats.select("study_id", big("pairs"), r6("difference"), r6("ci_low"), r6("ci_high"),
                        F.round("p_value", 9).alias("p_value"), "result")


@register("z7_pairing_problems", f"""
WITH {r.EVENT_DAYS_SQL},
x AS (SELECT study_id, person_id, respondent_id, CASE WHEN day > 15 THEN 'B' ELSE 'A' END AS side, value, code FROM event_days),
d AS (SELECT study_id, side, person_id, count(*) AS n, count(*) FILTER (WHERE value NOT IN (0, 1)) AS other FROM x GROUP BY ALL),
s AS (SELECT study_id, count(*) FILTER (WHERE n > 1) AS repeated, sum(other) AS other FROM d GROUP BY ALL),
v AS (SELECT study_id, sum(k) AS several FROM (SELECT study_id, side, CASE WHEN min(code) <> max(code) THEN 1 ELSE 0 END AS k
      FROM x GROUP BY ALL) GROUP BY ALL),
c AS (SELECT * FROM (VALUES ('means', false, true), ('boxes', true, false), ('averaged', false, false)) AS t(id, boxes, reject))
SELECT study_id, id AS comparison_id, 'REPEATED_PERSON' AS problem, CAST(repeated AS BIGINT) AS n FROM s, c
WHERE id <> 'averaged' AND repeated > 0 UNION ALL
SELECT study_id, id, 'NOT_BINARY', CAST(other AS BIGINT) FROM s, c WHERE boxes AND other > 0 UNION ALL
SELECT study_id, id, 'SEVERAL_ITEMS', CAST(several AS BIGINT) FROM v, c WHERE several > 0 UNION ALL
SELECT study_id, 'boxes', 'PARENT', 1 FROM s""")
def z7_pairing_problems(spark: SparkSession, path: str) -> DataFrame:
    """Early against late days of each arm, as means, as boxes and averaged by person."""
    days = r.event_days(spark, path)
    studies = days.select("study_id").distinct()
    comparisons = studies.select("study_id", F.inline(F.array(*[
        F.struct(F.lit(name).alias("comparison_id"), F.lit(metric).alias("metric"), F.lit("EARLY").alias("left_question"),
                 F.lit(right).alias("right_question"), F.lit(None).cast("string").alias("option_code"), F.lit(policy).alias("duplicates"))
        for name, metric, right, policy in (("means", "Media", "LATE", "reject"), ("boxes", "Top2Box", "OTHER", "reject"),
                                            ("averaged", "Media", "LATE", "person_mean"))])))
    questions = studies.select("study_id", F.inline(F.array(*[
        F.struct(F.lit(q).alias("question_id"), F.lit(1).alias("in_dashboard"), F.lit("Escala").alias("question_type"),
                 F.lit(parent).alias("parent_question")) for q, parent in (("EARLY", "DAY"), ("LATE", "DAY"), ("OTHER", None))])))
    options = studies.select("study_id", F.lit("EARLY").alias("question_id"), F.lit(None).cast("string").alias("code"),
                             F.lit("").alias("label"))
    person = F.col("person_id").cast("string")
    people = days.select("study_id", person.alias("person_id"), person.alias("original_id"))
    rows = days.join(comparisons.select("study_id", "comparison_id"), "study_id").select(
        "study_id", "comparison_id", F.when(F.col("day") > 15, "B").otherwise("A").alias("side"), "respondent_id",
        "person_id", F.col("code").alias("variable"), "value", F.lit(0.0).alias("scale_min"), F.lit(500.0).alias("scale_max"))
    return pairing_problems(comparisons, people, questions, options, rows)


MCNEMAR_SQL = """
d AS (SELECT source AS study_id, doc_id, quality AS a, toxic AS b FROM labels JOIN documents USING (doc_id)
      UNION ALL SELECT 'all', doc_id, quality, toxic FROM labels),
k AS (SELECT study_id, count(*) AS n, avg(a) AS ma, avg(b) AS mb,
        count(*) FILTER (WHERE a = 1 AND b = 0) AS yn, count(*) FILTER (WHERE a = 0 AND b = 1) AS ny
      FROM d GROUP BY ALL)"""


def label_pairs(spark: SparkSession, path: str) -> DataFrame:
    labels = r.table(spark, path, "labels")
    sources = r.table(spark, path, "documents").select("doc_id", F.col("source").alias("study_id"))
    rows = labels.join(sources, "doc_id").unionByName(labels.withColumn("study_id", F.lit("all")))
    people = rows.select("study_id", F.col("doc_id").alias("respondent_id"),
                         F.col("doc_id").alias("person_id"))
    facts = rows.select("study_id", F.col("doc_id").alias("respondent_id"), "quality", "toxic")
    left = p.condition_side(facts, people, "quality", F.lit(True))
    right = p.condition_side(facts, people, "toxic", F.lit(True))
    return p.person_pairs(left, right)


@register("z7_mcnemar_counts", f"""
WITH {MCNEMAR_SQL}
SELECT study_id, CAST(n AS BIGINT) AS pairs, round(ma, 6) AS mean_a, round(mb, 6) AS mean_b,
  CAST(CASE WHEN n >= 15 THEN yn ELSE -1 END AS BIGINT) AS yes_no,
  CAST(CASE WHEN n >= 15 THEN ny ELSE -1 END AS BIGINT) AS no_yes FROM k""")
def z7_mcnemar_counts(spark: SparkSession, path: str) -> DataFrame:
    stats = p.paired_proportions(label_pairs(spark, path), min_pairs=15, with_p=False)
    return stats.select("study_id", big("pairs"), r6("mean_a"), r6("mean_b"),
                        F.coalesce("yes_no", F.lit(-1)).cast("bigint").alias("yes_no"),
                        F.coalesce("no_yes", F.lit(-1)).cast("bigint").alias("no_yes"))


# Exact binomial tail by summing the shared prefix of Pascal's row in logarithms.
@register("z7_mcnemar", f"""
WITH {MCNEMAR_SQL},
tails AS (
  SELECT study_id, n, yn, ny, list_sum(list_transform(range(0, least(yn, ny) + 1), lambda i:
    exp(lgamma(yn + ny + 1) - lgamma(i + 1) - lgamma(yn + ny - i + 1) - (yn + ny) * ln(2.0)))) AS tail
  FROM k)
SELECT study_id, CAST(n AS BIGINT) AS pairs,
  round(CASE WHEN n < 15 THEN -1.0 WHEN yn + ny = 0 THEN 1.0 ELSE least(1.0, 2 * tail) END, 9) AS p_value,
  CASE WHEN n < 15 THEN 'Base insuficiente' WHEN yn + ny > 0 AND least(1.0, 2 * tail) < 0.05
    THEN 'Diferencia significativa' ELSE 'Sin diferencia significativa' END AS result
FROM tails""")
def z7_mcnemar(spark: SparkSession, path: str) -> DataFrame:
    stats = p.paired_proportions(label_pairs(spark, path), min_pairs=15)
    return stats.select("study_id", big("pairs"), F.round(
        F.coalesce("p_value", F.lit(-1.0)), 9).alias("p_value"), "result")


SELECTION_SQL = f"""{r.EVENT_DAYS_SQL},
x AS (SELECT study_id, person_id, day > 15 AS late, max(CAST(code = 'click' AS INTEGER)) AS v FROM event_days GROUP BY ALL),
k AS (SELECT a.study_id, count(*) AS n, avg(a.v) AS ma, avg(b.v) AS mb,
    count(*) FILTER (WHERE a.v = 1 AND b.v = 0) AS yn, count(*) FILTER (WHERE a.v = 0 AND b.v = 1) AS ny
  FROM x a JOIN x b USING (study_id, person_id) WHERE NOT a.late AND b.late GROUP BY ALL)"""


@register("z7_selection", f"""
WITH {SELECTION_SQL}
SELECT study_id, CAST(n AS BIGINT) AS pairs, round(ma, 6) AS mean_a, round(mb, 6) AS mean_b,
  CAST(yn AS BIGINT) AS yes_no, CAST(ny AS BIGINT) AS no_yes FROM k""")
def z7_selection(spark: SparkSession, path: str) -> DataFrame:
    """Did a user choose the option in the first and in the second half of the month?"""
    days = r.event_days(spark, path)
    half = (F.col("day") > 15).cast("long")
    visits = days.select("study_id", "question_id", (F.col("person_id") * 2 + half).alias("respondent_id"), "person_id",
                         half.alias("half"), F.when(F.col("code") == "click", "1").otherwise("2").alias("code"))
    base = visits.select("study_id", "question_id", "respondent_id").distinct()
    people = visits.select("study_id", "respondent_id", "person_id", "half").distinct()
    facts = p.selection_facts(base, visits, 1)
    pairs = p.person_pairs(p.condition_side(facts, people, "value", F.col("half") == 0),
                           p.condition_side(facts, people, "value", F.col("half") == 1))
    stats = p.paired_proportions(pairs, min_pairs=1, with_p=False)
    return stats.select("study_id", big("pairs"), r6("mean_a"), r6("mean_b"), big("yes_no"), big("no_yes"))


# --- weights ----------------------------------------------------------------

@register("a20_kish", f"""
WITH {r.CUSTOMERS_SQL},
x AS (SELECT study_id, 'factor' AS weight, factor AS v FROM customers UNION ALL
      SELECT study_id, 'balance', balance FROM customers UNION ALL
      SELECT study_id, 'wave', CAST(wave AS DOUBLE) FROM customers),
s AS (SELECT study_id, weight, count(*) AS n, count(v) FILTER (WHERE v >= 0) AS valid,
        count(*) FILTER (WHERE v IS NULL) AS missing, count(*) FILTER (WHERE v < 0) AS neg,
        count(*) FILTER (WHERE v = 0) AS zero, sum(v) AS t, sum(v * v) AS q FROM x GROUP BY ALL)
SELECT study_id, weight, CAST(n AS BIGINT) AS unweighted_n, CAST(valid AS BIGINT) AS valid_n,
  CAST(missing AS BIGINT) AS missing_n, CAST(neg AS BIGINT) AS negative_n, CAST(zero AS BIGINT) AS zero_n,
  round(missing / n, 6) AS missing_rate, round(CASE WHEN neg = 0 THEN t END, 4) AS weighted_n,
  round(CASE WHEN neg = 0 THEN t * t / q END, 6) AS effective_n,
  CASE WHEN neg > 0 THEN 'FAIL' WHEN missing > 0 THEN 'PASS_WITH_WARNINGS' ELSE 'PASS' END AS status
FROM s""")
def a20_kish(spark: SparkSession, path: str) -> DataFrame:
    people = r.customers(spark, path)
    result = None
    for name in ("factor", "balance", "wave"):
        part = w.weighted_base(people, name).withColumn("weight", F.lit(name))
        result = part if result is None else result.unionByName(part)
    return result.select(
        "study_id", "weight", *[big(c) for c in ("unweighted_n", "valid_n", "missing_n",
                                                  "negative_n", "zero_n")],
        r6("missing_rate"), F.round("weighted_n", 4).alias("weighted_n"), r6("effective_n"),
        "status",
    )


@register("a21_weight_dist", f"""
WITH {r.CUSTOMERS_SQL}, v AS (SELECT study_id, balance AS w FROM customers WHERE balance >= 0)
SELECT study_id, round(min(w), 6) AS minimum, round(quantile_cont(w, 0.01), 6) AS p1,
  round(quantile_cont(w, 0.05), 6) AS p5, round(quantile_cont(w, 0.5), 6) AS median,
  round(quantile_cont(w, 0.95), 6) AS p95, round(quantile_cont(w, 0.99), 6) AS p99,
  round(avg(w), 6) AS mean, round(max(w), 6) AS maximum, round(stddev_pop(w) / avg(w), 6) AS cv,
  round(max(w) / min(CASE WHEN w > 0 THEN w END), 6) AS max_min_positive_ratio
FROM v GROUP BY ALL""")
def a21_weight_dist(spark: SparkSession, path: str) -> DataFrame:
    stats = w.weight_distribution(r.customers(spark, path), "balance")
    return stats.select("study_id", *[r6(c) for c in stats.columns if c != "study_id"])

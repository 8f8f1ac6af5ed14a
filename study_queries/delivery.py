"""Builders, derived variables, result tables, exports and quality checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from study_queries import roles as r
from study_queries.core import big, r6, scale_facts
from study_queries.inference import letters_sql
from study_queries.multi import grid_rows
from tabuloom.operators import bands as b
from tabuloom.operators import metrics as m
from tabuloom.operators import profile as pf
from tabuloom.operators import quality as q
from tabuloom.operators import reshape as s
from tabuloom.operators import significance as z
from tabuloom.operators import tables as t
from tabuloom.operators.breakdown import respondent_dimension
from tabuloom.plans.tabulate import Request, report_cells, tabulate
from tabuloom.session import shared_folder
from tabuloom.sources import study as src

QUERIES, SQL = {}, {}


def register(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function
    return add


# --- builders on a wide file ------------------------------------------------

WIDE_VARIABLES = (
    # variable, question, type, calculation, class, dashboard, scale min, scale max
    ("segment", "SEG", "RU", "Frecuencia", "Pregunta analizable", "si", "", ""),
    ("wave", "WAVE", "RU", "Frecuencia", "Banner", "si", "", ""),
    ("nation", "NAT", "", "Frecuencia", "Variable técnica", "si", "", ""),
    ("score", "SCORE", "Escala", "Media", "Pregunta analizable", "si", "0", "12"),
    ("recommend", "NPS1", "NPS", "NPS", "Pregunta analizable", "si", "", ""),
    ("labelled", "LAB", "Escala", "Media", "Pregunta analizable", "si", "", ""),
    ("hidden", "HID", "RU", "Frecuencia", "Pregunta analizable", "no", "", ""),
)


def wide_file(spark: SparkSession, path: str) -> DataFrame:
    people = r.customers(spark, path)
    return people.select(
        "study_id", "respondent_id", "segment", "wave", "nation",
        (F.col("respondent_id") % 13).alias("score"), (F.col("respondent_id") % 11).alias("recommend"),
        F.when(F.col("respondent_id") % 4 != 0, F.col("respondent_id") % 5 + 1.0).alias("labelled"),
        F.lit(1).alias("hidden"))


def wide_book(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    studies = r.table(spark, path, "region").select(F.col("r_name").alias("study_id"))
    names = ("variable", "question_id", "question_type", "calculation", "analytic_class",
             "in_dashboard", "scale_min", "scale_max")
    rows = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(names, v)])
                     for v in WIDE_VARIABLES])
    book = studies.select("study_id", F.inline(rows)).withColumns({
        "label": F.col("variable"), "question_text": F.col("question_id")})
    labels = [("wave", "0", "Inicial", 1), ("wave", "1", "Media", 2)]
    labels += [("labelled", str(i), f"Punto {i}", i) for i in range(1, 6)]
    label_rows = F.array(*[F.struct(
        F.lit(v).alias("variable"), F.lit(c).alias("code"), F.lit(x).alias("label"),
        F.lit(i).alias("ord")) for v, c, x, i in labels])
    return book, studies.select("study_id", F.inline(label_rows))


def wide_cells(spark: SparkSession, path: str) -> DataFrame:
    return s.unpivot_cells(wide_file(spark, path), ["study_id", "respondent_id"],
                           [v[0] for v in WIDE_VARIABLES])


@register("d1_respondents", f"""
WITH {r.EVALUATIONS_SQL},
k AS (SELECT study_id, count(*) = count(DISTINCT person_id) AS ok FROM evaluations GROUP BY ALL)
SELECT study_id, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT person_id) AS BIGINT) AS persons,
  'R' || lpad(CAST(min(respondent_id) + 1 AS VARCHAR), 6, '0') AS first_id
FROM evaluations GROUP BY ALL""")
def d1_respondents(spark: SparkSession, path: str) -> DataFrame:
    """The declared person repeats, so rows get ordinal keys."""
    wide = r.evaluations(spark, path).select(
        "study_id", F.col("respondent_id").alias("row_index"), F.col("person_id").alias("folio"),
        "segment")
    people = s.build_respondents(wide, ["segment"], declared_ids=["folio"])
    return people.groupBy("study_id").agg(
        F.count("*").alias("n_rows"), F.count_distinct("person_id").alias("persons"),
        F.min("respondent_id").alias("first_id"))


ATTRIBUTES = (
    # column, class, weight: F4 refuses the folio and the amount, a plain question is no attribute.
    ("segment", "Banner", False), ("status", "Filtro", False), ("folio", "Control de calidad", False),
    ("amount", "Derivada", False), ("nation", "Pregunta analizable", False), ("factor", "Ponderador", True),
    ("half", "Variable técnica", True))


@register("d1_attributes", f"""
WITH {r.EVALUATIONS_SQL},
x AS (SELECT study_id, unnest(['segment', 'status', 'factor', 'half']) AS variable,
        unnest([segment, status, CAST(CAST(factor AS DOUBLE) AS VARCHAR), CAST(respondent_id % 2 AS VARCHAR)]) AS v FROM evaluations)
SELECT study_id, variable, CAST(count(v) AS BIGINT) AS n, CAST(count(DISTINCT v) AS BIGINT) AS n_values, min(v) AS lowest
FROM x GROUP BY ALL""")
def d1_attributes(spark: SparkSession, path: str) -> DataFrame:
    """Attributes by class and by what F4 says of the data."""
    wide = r.evaluations(spark, path).select(
        "study_id", F.col("respondent_id").alias("row_index"), F.col("person_id").alias("folio"), "segment",
        "status", "amount", "nation", F.col("factor").cast("double").alias("factor"), (F.col("respondent_id") % 2).alias("half"))
    names = [a[0] for a in ATTRIBUTES]
    studies = r.table(spark, path, "region").select(F.col("r_name").alias("study_id"))
    book = studies.select("study_id", F.inline(F.array(*[F.struct(
        F.lit(v).alias("variable"), F.lit(c).alias("analytic_class"), F.lit(w).alias("is_weight")) for v, c, w in ATTRIBUTES])))
    cells = s.unpivot_cells(wide, ["study_id"], names)
    safety = pf.variable_safety(cells, book)
    people = s.build_respondents(wide, [], declared_ids=["folio"])
    attributes = s.with_attributes(people, wide, names, book, safety)
    values = attributes.select("study_id", F.explode("attributes").alias("variable", "v"))
    counts = values.groupBy("study_id", "variable", "v").agg(F.count("*").alias("same"))
    return counts.groupBy("study_id", "variable").agg(
        F.sum(F.when(F.col("v").isNotNull(), F.col("same")).otherwise(0)).alias("n"),
        F.count("v").alias("n_values"), F.min("v").alias("lowest"))


@register("d2_single_choice", f"""
WITH {r.CUSTOMERS_SQL}
SELECT study_id, 'SEG' AS question_id, segment AS code, segment AS response, CAST(count(*) AS BIGINT) AS n
FROM customers GROUP BY ALL UNION ALL
SELECT study_id, 'WAVE', CAST(wave AS VARCHAR), CASE wave WHEN 0 THEN 'Inicial' WHEN 1 THEN 'Media'
  ELSE CAST(wave AS VARCHAR) END, CAST(count(*) AS BIGINT) FROM customers WHERE wave IS NOT NULL GROUP BY ALL""")
def d2_single_choice(spark: SparkSession, path: str) -> DataFrame:
    book, labels = wide_book(spark, path)
    long = s.build_single_choice(wide_cells(spark, path), book, labels)
    return long.groupBy("study_id", "question_id", "code", "response").agg(F.count("*").alias("n"))


@register("d9_scale_long", f"""
WITH {r.CUSTOMERS_SQL},
x AS (SELECT study_id, 'SCORE' AS question_id, respondent_id % 13 AS v, 0 AS lo, 12 AS hi FROM customers UNION ALL
      SELECT study_id, 'NPS1', respondent_id % 11, 0, 10 FROM customers UNION ALL
      SELECT study_id, 'LAB', respondent_id % 5 + 1, 1, 5 FROM customers WHERE respondent_id % 4 <> 0)
SELECT study_id, question_id, CAST(lo AS DOUBLE) AS scale_min, CAST(hi AS DOUBLE) AS scale_max,
  CAST(count(*) AS BIGINT) AS n, CAST(sum(v) AS DOUBLE) AS total,
  CAST(sum(CASE WHEN v >= hi - 1 THEN 1 ELSE 0 END) AS BIGINT) AS top2box,
  CAST(sum(CASE WHEN v <= lo + 1 THEN 1 ELSE 0 END) AS BIGINT) AS bottombox,
  CAST(sum(CASE WHEN question_id = 'NPS1' AND v >= 9 THEN 1 ELSE 0 END) AS BIGINT) AS promoters
FROM x GROUP BY ALL""")
def d9_scale_long(spark: SparkSession, path: str) -> DataFrame:
    """Declared bounds, 0-10 for NPS, and bounds from consecutive labels."""
    book, labels = wide_book(spark, path)
    long = s.build_scale_long(wide_cells(spark, path), book, labels)
    return long.groupBy("study_id", "question_id", "scale_min", "scale_max").agg(
        F.count("*").alias("n"), F.sum("value").alias("total"),
        F.sum("top2box").alias("top2box"), F.sum("bottombox").alias("bottombox"),
        F.count_if(F.col("nps_group") == "Promotor").alias("promoters"))


@register("d13_fallback", f"""
WITH {r.EVALUATIONS_SQL}
SELECT study_id, CAST(count(*) AS BIGINT) AS n,
  CAST(sum(CASE WHEN left(o_orderpriority, 1) IN ('4', '5') THEN 1 ELSE 0 END) AS BIGINT) AS top2box,
  CAST(sum(CASE WHEN left(o_orderpriority, 1) IN ('1', '2') THEN 1 ELSE 0 END) AS BIGINT) AS bottombox
FROM evaluations GROUP BY ALL""")
def d13_fallback(spark: SparkSession, path: str) -> DataFrame:
    evaluation = r.evaluations(spark, path)
    facts = r.priority_facts(evaluation).withColumn("value", F.col("code").cast("double"))
    bounds = evaluation.select(
        "study_id", F.lit("PRIORITY").alias("question_id"), F.lit(1.0).alias("scale_min"),
        F.lit(5.0).alias("scale_max"), F.lit(False).alias("nps")).distinct()
    return s.scale_fallback(facts, bounds).groupBy("study_id").agg(
        F.count("*").alias("n"), F.sum("top2box").alias("top2box"),
        F.sum("bottombox").alias("bottombox"))


@register("d11_open_text", """
WITH t AS (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS original_text FROM conversations
           WHERE role = 'user'),
n AS (SELECT *, trim(regexp_replace(strip_accents(lower(original_text)), '[^a-z0-9]+', '_', 'g'), '_') AS norm FROM t)
SELECT conv_id, turn, original_text, replace(norm, '_', ' ') AS clean_text FROM n
WHERE norm NOT IN ('', 'nan', 'none', 'null', 'na', 'n_a', 'no_aplica', 'no_se', 'ninguno', 'ninguna')""")
def d11_open_text(spark: SparkSession, path: str) -> DataFrame:
    texts = r.table(spark, path, "conversations").filter("role = 'user'")
    return s.open_ended_text(texts, "text").select("conv_id", "turn", "original_text", "clean_text")


@register("x1_normalize", """
SELECT doc_id, CAST(length(n) AS BIGINT) AS length, md5(n) AS digest FROM (
  SELECT doc_id, trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', '_', 'g'), '_') AS n
  FROM documents)""")
def x1_normalize(spark: SparkSession, path: str) -> DataFrame:
    from tabuloom.functions.text import normalize_text
    return r.table(spark, path, "documents").select(
        "doc_id", normalize_text(F.col("text")).alias("n")).select(
        "doc_id", F.length("n").cast("bigint").alias("length"), F.md5("n").alias("digest"))


# --- bands ------------------------------------------------------------------

BANDS = [("bajo", None, 50000.0), ("medio", 50000.01, 150000.0), ("alto", 200000.0, None)]
BAND_SQL = """CASE WHEN amount <= 50000 THEN 'bajo' WHEN amount BETWEEN 50000.01 AND 150000 THEN 'medio'
  WHEN amount >= 200000 THEN 'alto' END"""


@register("v1_bands", f"""
WITH {r.EVALUATIONS_SQL}
SELECT study_id, coalesce({BAND_SQL}, '-') AS band, CAST(count(*) AS BIGINT) AS n,
  round(min(amount), 6) AS lowest, round(max(amount), 6) AS highest FROM evaluations GROUP BY ALL""")
def v1_bands(spark: SparkSession, path: str) -> DataFrame:
    evaluation = r.evaluations(spark, path)
    band = F.coalesce(b.apply_bands(F.col("amount"), BANDS), F.lit("-"))
    return evaluation.groupBy("study_id", band.alias("band")).agg(
        F.count("*").alias("n"), F.round(F.min("amount"), 6).alias("lowest"),
        F.round(F.max("amount"), 6).alias("highest"))


@register("v4_preview", f"""
WITH {r.EVALUATIONS_SQL}
SELECT study_id, coalesce({BAND_SQL}, '(Sin dato o fuera de rango)') AS band, CAST(count(*) AS BIGINT) AS n,
  round(count(*) / sum(count(*)) OVER (PARTITION BY study_id) * 100, 6) AS pct
FROM evaluations GROUP BY study_id, 2""")
def v4_preview(spark: SparkSession, path: str) -> DataFrame:
    return b.band_preview(r.evaluations(spark, path), F.col("amount"), BANDS).select(
        "study_id", "band", big("n"), r6("pct"))


def small_study(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    evaluation = r.evaluations(spark, path)
    facts = r.priority_facts(evaluation).withColumns({
        "question_type": F.lit("RU"), "value": F.col("code").cast("double"), "text": F.lit(""),
        "base_valid": F.lit(True)})
    studies = r.table(spark, path, "region").select(F.col("r_name").alias("study_id"))
    questions = studies.select("study_id", F.inline(F.array(*[F.struct(
        F.lit(x).alias("question_id"), F.lit(x.title()).alias("question_text"),
        F.lit(k).alias("question_type"), F.lit("Frecuencia").alias("calculation"),
        F.lit(float(i)).alias("questionnaire_order"), F.lit(True).alias("in_dashboard"))
        for i, (x, k) in enumerate([("PRIORITY", "RU"), ("AMOUNT", "Numérica")], 1)])))
    variables = studies.select("study_id", F.inline(F.array(*[F.struct(
        F.lit(v).alias("variable"), F.lit(x).alias("question_id"), F.lit(v).alias("label"),
        F.lit("Pregunta analizable").alias("analytic_class"), F.lit(True).alias("in_dashboard"))
        for v, x in [("o_orderpriority", "PRIORITY"), ("amount", "AMOUNT")]])))
    options = facts.select("study_id", "variable", "question_id", "code",
                           F.col("response").alias("label")).distinct().withColumn(
        "ord", F.col("code").cast("double"))
    config = studies.select("study_id", F.lit("banner").alias("role"), F.lit("segment").alias("variable"),
                            F.lit("SEG").alias("question_id"), F.lit("Segmento").alias("label"))
    return {"respondents": evaluation.drop("o_orderpriority"), "responses": facts,
            "questions": questions, "variables": variables, "options": options,
            "configuration": config}


def derived_study(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return b.add_derived(small_study(spark, path), F.col("amount"), "amount", "amount_band",
                         "Importe por tramo", BANDS)


@register("v5_derived", f"""
WITH {r.EVALUATIONS_SQL}
SELECT study_id, {BAND_SQL} AS response, CAST(count(*) AS BIGINT) AS n,
  CAST(2.001 AS DOUBLE) AS questionnaire_order, CAST(2 AS BIGINT) AS n_roles
FROM evaluations WHERE {BAND_SQL} IS NOT NULL GROUP BY study_id, 2""")
def v5_derived(spark: SparkSession, path: str) -> DataFrame:
    tables = derived_study(spark, path)
    answers = tables["responses"].filter("question_id = 'amount_band'").groupBy(
        "study_id", "question_id", "response").agg(F.count("*").alias("n"))
    roles = tables["configuration"].filter("variable = 'amount_band'").groupBy("study_id").agg(
        F.count("*").alias("n_roles"))
    questions = tables["questions"].select("study_id", "question_id", "questionnaire_order")
    return answers.join(questions, ["study_id", "question_id"]).join(roles, "study_id").select(
        "study_id", "response", "n", r6("questionnaire_order"), "n_roles")


@register("v6_removed", f"""
WITH {r.EVALUATIONS_SQL}
SELECT study_id, CAST(count(*) AS BIGINT) AS n_answers, CAST(1 AS BIGINT) AS n_roles,
  CAST(2 AS BIGINT) AS n_questions FROM evaluations GROUP BY ALL""")
def v6_removed(spark: SparkSession, path: str) -> DataFrame:
    tables = b.remove_derived(derived_study(spark, path), ["amount_band"])
    parts = [tables[n].groupBy("study_id").agg(F.count("*").alias(c)) for n, c in (
        ("responses", "n_answers"), ("configuration", "n_roles"), ("questions", "n_questions"))]
    return parts[0].join(parts[1], "study_id").join(parts[2], "study_id")


# --- result tables ----------------------------------------------------------

WIDE_SQL = f"""{r.CUSTOMERS_SQL},
facts AS (SELECT study_id, respondent_id, coalesce(CAST(wave AS VARCHAR), 'Sin dato') AS response, segment, factor
          FROM customers),
cells AS (SELECT *, 'Total' AS banner FROM facts UNION ALL SELECT *, segment FROM facts),
c AS (SELECT study_id, banner, response, count(*) AS n,
        sum(count(*)) OVER (PARTITION BY study_id, banner) AS base FROM cells GROUP BY 1, 2, 3),
sc AS (SELECT study_id, 'Total' AS banner, avg(balance) AS m FROM customers GROUP BY 1 UNION ALL
       SELECT study_id, segment, avg(balance) FROM customers GROUP BY 1, 2),
{letters_sql("c", "n", "base")}"""
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def wave_table(spark: SparkSession, path: str, significance: bool) -> DataFrame:
    people = r.customers(spark, path)
    dimension = respondent_dimension(people, "segment")
    facts = people.select("study_id", F.lit("WAVE").alias("question_id"), "respondent_id",
                          F.coalesce(F.col("wave").cast("string"), F.lit("Sin dato")).alias("response"))
    cells = m.frequency(facts, dimension)
    scale = people.select("study_id", F.lit("WAVE").alias("question_id"), "respondent_id",
                          F.col("balance").alias("value"), F.lit(None).cast("int").alias("top2box"),
                          F.lit(None).cast("int").alias("bottombox"), F.lit("").alias("nps_group"))
    summary = m.scale_summary(m.cell_moments(scale, dimension))
    letters = z.proportion_letters(cells) if significance else None
    return t.report_table(["Total", *SEGMENTS], cells, ["n", "pct", "mean"], summary,
                          letters=letters)


T1_COLUMNS = ", ".join(
    f"""CAST(max(CASE WHEN banner = '{s_}' THEN n END) AS DOUBLE) AS "{s_} n",
    round(max(CASE WHEN banner = '{s_}' THEN n / base * 100 END), 6) AS "{s_} pct" """
    for s_ in ("Total", *SEGMENTS))


@register("t1_table", f"""
WITH {WIDE_SQL},
w AS (SELECT study_id, response, {T1_COLUMNS} FROM c GROUP BY ALL)
SELECT study_id, response, """ + ", ".join(
    f'coalesce("{s_} n", 0) AS "{s_} n", coalesce("{s_} pct", 0) AS "{s_} pct", CAST(-1 AS DOUBLE) AS "{s_} Valor"'
    for s_ in ("Total", *SEGMENTS)) + """ FROM w UNION ALL
SELECT study_id, 'Media', """ + ", ".join(
    f"-1, -1, round(max(CASE WHEN banner = '{s_}' THEN m END), 6)" for s_ in ("Total", *SEGMENTS)) +
    " FROM sc GROUP BY study_id")
def t1_table(spark: SparkSession, path: str) -> DataFrame:
    """The wide table with a scalar row below the responses."""
    table = wave_table(spark, path, False)
    columns = [c for c in table.columns if " | " in c]
    return table.select("study_id", "response", *[
        F.coalesce(F.round(F.col(f"`{c}`"), 6), F.lit(-1.0)).alias(c.replace(" | ", " "))
        for c in columns])


@register("t2_letters", f"""
WITH {WIDE_SQL}
SELECT study_id, response, """ + ", ".join(
    f"""coalesce(max(CASE WHEN banner = '{s_}' THEN letters END), '') AS "{s_} Sig" """ for s_ in SEGMENTS) + """
FROM (SELECT study_id, response, banner, letters FROM c LEFT JOIN marks USING (study_id, response, banner))
GROUP BY ALL""")
def t2_letters(spark: SparkSession, path: str) -> DataFrame:
    table = wave_table(spark, path, True).filter("kind = 0")
    return table.select("study_id", "response", *[
        F.col(f"`{s_} | Sig.`").alias(f"{s_} Sig") for s_ in SEGMENTS])


@register("t3_grid_table", f"""
WITH {r.EVALUATIONS_SQL}, {r.GRID_SQL}
SELECT DISTINCT entity || ' | ' || option || ' | x' AS response, entity, option || ' | x' AS option FROM grid""")
def t3_grid_table(spark: SparkSession, path: str) -> DataFrame:
    """Only the first separator splits."""
    labels = grid_rows(spark, path).select(
        F.concat_ws(" | ", "entity", "option", F.lit("x")).alias("response")).distinct()
    return t.split_grid_response(labels)


@register("o3_chart_order", f"""
WITH {r.EVALUATIONS_SQL}, {r.PRIORITY_SQL}
SELECT study_id, response, CAST(row_number() OVER (PARTITION BY study_id ORDER BY count(*) DESC, response)
  AS BIGINT) AS chart_pos FROM priority GROUP BY study_id, response""")
def o3_chart_order(spark: SparkSession, path: str) -> DataFrame:
    evaluation = r.evaluations(spark, path)
    cells = m.frequency(r.priority_facts(evaluation), respondent_dimension(evaluation, "status"))
    return t.chart_order(cells).select("study_id", "response", big("chart_pos"))


@register("t4_projection", f"""
WITH {r.EVALUATIONS_SQL}
SELECT study_id, status AS slice_id, lower(status) AS slice_label, o_orderpriority AS category_id,
  CAST(count(*) AS BIGINT) AS numerator, CAST(sum(count(*)) OVER w AS BIGINT) AS base_n,
  round(sum(sum(factor)) OVER w, 6) AS weighted_n, CASE status WHEN 'F' THEN 'B' ELSE '' END AS letters
FROM evaluations GROUP BY study_id, status, o_orderpriority WINDOW w AS (PARTITION BY study_id, status)""")
def t4_projection(spark: SparkSession, path: str) -> DataFrame:
    evaluation = r.evaluations(spark, path).withColumn(
        "base_id", F.concat_ws(":", "study_id", "status"))
    values = evaluation.groupBy("study_id", F.col("status").alias("slice_id"), "base_id",
                                F.col("o_orderpriority").alias("category_id")).agg(
        F.count("*").alias("numerator"))
    bases = evaluation.groupBy("study_id", "base_id").agg(
        F.count("*").alias("base_n"), F.sum("factor").alias("weighted_n"))
    slices = evaluation.select("study_id", F.col("status").alias("slice_id"),
                               F.lower("status").alias("slice_label")).distinct()
    tokens = slices.filter("slice_id = 'F'").select("study_id", "slice_id", F.lit("B").alias("letters"))
    return t.canonical_projection(values, bases, slices, tokens).select(
        "study_id", "slice_id", "slice_label", "category_id", big("numerator"), big("base_n"),
        r6("weighted_n"), "letters")


@register("e5_separate_letters", f"""
WITH {r.CUSTOMERS_SQL},
facts AS (SELECT *, balance >= 5000 AS rich FROM customers),
cells AS (SELECT study_id, rich, 'segment: ' || segment AS banner, 'segment' AS g FROM facts UNION ALL
  SELECT study_id, rich, 'wave: ' || coalesce(CAST(wave AS VARCHAR), 'Sin dato'), 'wave' FROM facts),
c AS (SELECT study_id, CAST(rich AS VARCHAR) AS response, banner, g, count(*) AS n,
        sum(count(*)) OVER (PARTITION BY study_id, banner) AS base FROM cells GROUP BY 1, 2, 3, 4),
o AS (SELECT *, dense_rank() OVER (PARTITION BY study_id ORDER BY g, banner) AS pos FROM c),
p AS (SELECT a.study_id, a.response, a.banner, b.pos, a.n::DOUBLE AS x1, a.base::DOUBLE AS n1,
        b.n::DOUBLE AS x2, b.base::DOUBLE AS n2
      FROM o a JOIN o b ON a.study_id = b.study_id AND a.response = b.response AND a.g = b.g AND a.pos <> b.pos),
k AS (SELECT study_id, response, banner, string_agg(chr(CAST(64 + pos AS INTEGER)), '' ORDER BY pos) AS letters
  FROM p WHERE n1 >= 10 AND n2 >= 10 AND x1 / n1 > x2 / n2 AND
    (x1 / n1 - x2 / n2) / sqrt(((x1 + x2) / (n1 + n2)) * (1 - (x1 + x2) / (n1 + n2)) * (1 / n1 + 1 / n2))
      > 1.2815515655446004 GROUP BY ALL)
SELECT study_id, response, banner, coalesce(letters, '') AS letters FROM c LEFT JOIN k USING (study_id, response, banner)""")
def e5_separate_letters(spark: SparkSession, path: str) -> DataFrame:
    """Columns are only compared inside their own variable (confidence 0.8, base 10)."""
    people = r.customers(spark, path)
    facts = people.select("study_id", F.lit("RICH").alias("question_id"), "respondent_id",
                          (F.col("balance") >= 5000).cast("string").alias("response"))
    cells = m.frequency(facts, respondent_dimension(people, ["segment", "wave"], mode="separate"))
    letters = z.proportion_letters(cells, confidence=0.8, min_base=10)
    return letters.select("study_id", "response", "banner", "letters")


@register("tabulate_book", f"""
WITH {r.EVALUATIONS_SQL}, {r.PRIORITY_SQL}, {r.LINES_SQL},
f AS (SELECT * FROM priority WHERE status IN ('F', 'O')),
fc AS (SELECT *, 'Total' AS banner FROM f UNION ALL SELECT *, segment FROM f),
c AS (SELECT study_id, question_id, banner, response, count(*) AS n FROM fc GROUP BY ALL),
s AS (SELECT sc.study_id, sc.question_id, sc.value, e.segment, sc.respondent_id FROM scales sc
      JOIN evaluations e USING (study_id, respondent_id) WHERE e.status IN ('F', 'O')),
answers AS (SELECT * FROM s UNION ALL SELECT study_id, question_id, CAST(code AS DOUBLE), segment, respondent_id FROM f),
sb AS (SELECT *, 'Total' AS banner FROM answers UNION ALL SELECT *, segment FROM answers)
SELECT study_id, question_id, response, banner, 'n' AS metric, CAST(n AS DOUBLE) AS value FROM c UNION ALL
SELECT study_id, question_id, response, banner, 'pct', round(n / sum(n) OVER (PARTITION BY study_id, banner) * 100, 6)
FROM c UNION ALL
SELECT study_id, question_id, '', banner, 'mean', round(avg(value), 6) FROM sb GROUP BY ALL UNION ALL
SELECT study_id, question_id, '', banner, 'nps', round((count(*) FILTER (WHERE value >= 9)
  - count(*) FILTER (WHERE value <= 6)) / count(*) * 100, 6) FROM sb WHERE question_id = 'NPS' GROUP BY ALL""")
def tabulate_book(spark: SparkSession, path: str) -> DataFrame:
    """All questions of all studies by segment under a filter, in one plan.

    The priority has bounds but no scale rows, so its mean comes from its single choices.
    """
    study = small_study(spark, path)
    bounds = study["questions"].filter("question_id = 'PRIORITY'").select(
        "study_id", "question_id", F.lit(1.0).alias("scale_min"), F.lit(5.0).alias("scale_max"), F.lit(False).alias("nps"))
    tables = {**study, "scales": scale_facts(spark, path), "scale_bounds": bounds}
    report = tabulate(tables, Request(banners=["segment"], filters={"status": ["F", "O"]}))
    return report_cells(report, ["n", "pct", "mean", "nps"]).select(
        "study_id", "question_id", "response", "banner", "metric", r6("value"))


# --- exports ----------------------------------------------------------------

def export_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    ease = F.col("question_id") == "EASE"
    scales = scale_facts(spark, path).withColumns({
        "variable": F.when(ease, "l_linenumber").otherwise("l_discount"),
        "item_text": F.when(ease, "Facilidad").otherwise("Recomendación"),
        "response": F.col("value").cast("int").cast("string")})
    # Two lines of an order may hold the same value; the flat table keeps both.
    multi = r.priority_facts(r.evaluations(spark, path)).select(
        "study_id", "respondent_id", F.lit("STATUS").alias("question_id"),
        F.lit("o_orderstatus").alias("variable"), F.col("code"), F.col("response"))
    return {**small_study(spark, path), "scales": scales, "multi_responses": multi}


@register("s6_flat", f"""
WITH {r.EVALUATIONS_SQL}, {r.PRIORITY_SQL}, {r.LINES_SQL},
x AS (
  SELECT study_id, respondent_id, 'PRIORITY' AS question_id, 'RU' AS question_type, code, response,
    CAST(code AS DOUBLE) AS value FROM priority UNION ALL
  SELECT study_id, respondent_id, 'STATUS', 'RM', code, response, 1.0 FROM priority UNION ALL
  SELECT study_id, respondent_id, question_id, 'Escala', CAST(CAST(value AS INTEGER) AS VARCHAR), CAST(CAST(value AS INTEGER) AS VARCHAR),
    value FROM scales)
SELECT x.study_id, question_id, question_type, code, x.response, segment, status AS filter_1,
  CAST(count(*) AS BIGINT) AS n, round(sum(value), 6) AS total, round(sum(factor), 6) AS weight
FROM x JOIN evaluations USING (study_id, respondent_id) GROUP BY ALL""")
def s6_flat(spark: SparkSession, path: str) -> DataFrame:
    flat = src.flat_fact(export_tables(spark, path), ["segment"], ["status"], "factor")
    return flat.groupBy("study_id", "question_id", "question_type", "code", "response", "segment",
                        "filter_1").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"),
        F.round(F.sum("weight"), 6).alias("weight"))


@register("s7_counts", f"""
WITH {r.EVALUATIONS_SQL}
SELECT 'respondents' AS "table", CAST(count(*) AS BIGINT) AS n_rows FROM evaluations UNION ALL
SELECT 'responses', CAST(count(*) AS BIGINT) FROM evaluations UNION ALL
SELECT 'scales', CAST(2 * count(*) AS BIGINT) FROM lineitem JOIN evaluations ON l_orderkey = respondent_id UNION ALL
SELECT 'multi_responses', CAST(count(*) AS BIGINT) FROM evaluations""")
def s7_counts(spark: SparkSession, path: str) -> DataFrame:
    tables = export_tables(spark, path)
    return src.table_counts({n: tables[n] for n in ("respondents", "responses", "scales",
                                                     "multi_responses")})


@register("s7_review_rows", f"""
WITH {r.EVALUATIONS_SQL}, {r.PRIORITY_SQL}
SELECT study_id, respondent_id, code, response FROM priority ORDER BY study_id, respondent_id LIMIT 5000""")
def s7_review_rows(spark: SparkSession, path: str) -> DataFrame:
    """The first 5,000 rows of a long table in a stable order."""
    tables = src.review_extract({"responses": small_study(spark, path)["responses"]})
    return tables["responses"].select("study_id", "respondent_id", "code", "response")


@register("s3_stored_question", f"""
WITH {r.EVALUATIONS_SQL}, {r.PRIORITY_SQL}
SELECT study_id, response, CAST(count(*) AS BIGINT) AS n FROM priority GROUP BY ALL""")
def s3_stored_question(spark: SparkSession, path: str) -> DataFrame:
    """Write a study, then read one question back from its partition."""
    target = shared_folder(spark, "study")
    src.write_study(small_study(spark, path), target)
    ok, missing, message = src.validate_study(spark, target)
    if not ok:
        raise src.StudyError(f"{message}: {missing}")
    rows = src.scan_question(spark, target, "responses", "PRIORITY")
    return rows.groupBy("study_id", "response").agg(F.count("*").alias("n"))


@register("s4_buckets", f"""
WITH {r.EVALUATIONS_SQL}, {r.PRIORITY_SQL},
x AS (SELECT study_id, response, factor, 'Total' AS banner FROM priority UNION ALL SELECT study_id, response, factor, segment FROM priority),
c AS (SELECT study_id, banner, response, count(*) AS n, sum(factor) AS nw FROM x GROUP BY ALL)
SELECT study_id, banner, response, CAST(n AS BIGINT) AS n, round(nw, 6) AS n_weighted,
  round(n / sum(n) OVER (PARTITION BY study_id, banner), 6) AS pct FROM c""")
def s4_buckets(spark: SparkSession, path: str) -> DataFrame:
    """A study stored by respondent, and its frequencies without a shuffle below the cells."""
    target = shared_folder(spark, "study")
    src.write_study(small_study(spark, path), target, buckets=8)
    respondents, responses = (src.read_table(spark, target, n) for n in ("respondents", "responses"))
    cells = m.frequency(responses, respondent_dimension(respondents, "segment", weight="factor"))
    return cells.select("study_id", "banner", "response", big("n"), r6("n_weighted"), r6("pct"))


@register("s8_export_rows", f"""
WITH {r.EVALUATIONS_SQL}, {r.PRIORITY_SQL}
SELECT 'REVIEW' AS export_path, false AS release_releasable, 'REVIEW_REQUIRED' AS qa_release_status,
  study_id, response, CAST(count(*) AS BIGINT) AS n FROM priority GROUP BY ALL""")
def s8_export_rows(spark: SparkSession, path: str) -> DataFrame:
    evaluation = r.evaluations(spark, path)
    cells = m.frequency(r.priority_facts(evaluation), respondent_dimension(evaluation, None))
    rows = cells.select("study_id", "response", big("n"))
    state = spark.createDataFrame([("REVIEW_REQUIRED", False)],
                                  "qa_release_status string, releasable boolean")
    target = shared_folder(spark, "export")
    src.export_result(rows, state, target, official=False)
    return spark.read.csv(target, header=True, schema="export_path string, release_releasable boolean, "
                          "qa_release_status string, study_id string, response string, n bigint")


@register("s9_canonical_order", f"""
WITH {r.EVALUATIONS_SQL}, c AS (SELECT study_id, status, nullif(left(o_orderpriority, 1), '5') AS k, count(*) AS n
  FROM evaluations GROUP BY ALL)
SELECT study_id, status, CAST(coalesce(k, '-1') AS BIGINT) AS semantic_order, CAST(n AS BIGINT) AS n,
  CAST(row_number() OVER (ORDER BY CAST(k AS BIGINT) NULLS LAST, '{{"n":' || n || CASE WHEN k IS NULL THEN ''
    ELSE ',"semantic_order":' || k END || ',"status":"' || status || '","study_id":"' || study_id || '"}}') AS BIGINT) AS position
FROM c""")
def s9_canonical_order(spark: SparkSession, path: str) -> DataFrame:
    code = F.split("o_orderpriority", "-", 2)[0]
    values = r.evaluations(spark, path).groupBy(
        "study_id", "status", F.when(code != "5", code.cast("bigint")).alias("semantic_order")).agg(
        F.count("*").alias("n"))
    target = shared_folder(spark, "canonical")
    src.write_canonical({name: values for name in src.CANONICAL_TABLES}, target)
    return spark.read.parquet(f"{target}/values").select(
        "study_id", "status", F.coalesce("semantic_order", F.lit(-1).cast("bigint"))
        .alias("semantic_order"), "n", "position")


# --- quality ----------------------------------------------------------------

@register("q1_readiness", f"""
WITH {r.EVALUATIONS_SQL}, s AS (SELECT study_id, count(*) AS n, count(DISTINCT person_id) AS p FROM evaluations GROUP BY ALL)
SELECT study_id, i.k AS "check", i.s AS state, i.d AS detail FROM (SELECT study_id, unnest([
  {{'k': 'Unidad de análisis', 's': 'Requiere revisión', 'd': '1 preguntas sin unidad reconocida'}},
  {{'k': 'Identificación de personas', 's': 'Comprobado', 'd': n || ' evaluaciones; ' || p || ' personas únicas'}},
  {{'k': 'Límites de escala', 's': 'Comprobado', 'd': '0 ítems con límites inválidos'}},
  {{'k': 'Ponderación', 's': 'Requiere revisión', 'd': 'wave, peso'}},
  {{'k': 'Reglas de aplicación y aprobación metodológica', 's': 'Requiere revisión', 'd': 'revisión manual'}}]) AS i FROM s)""")
def q1_readiness(spark: SparkSession, path: str) -> DataFrame:
    evaluation = r.evaluations(spark, path).withColumn("original_id", F.col("person_id"))
    questions = small_study(spark, path)["questions"].withColumn(
        "analysis_unit", F.when(F.col("question_id") == "PRIORITY", "Evaluación").otherwise("?"))
    scale = scale_facts(spark, path).withColumn("variable", F.col("question_id"))
    return q.readiness(evaluation, questions, scale, ["factor", "wave", "peso"])


@register("q6_key_check", f"""
WITH {r.EVALUATIONS_SQL}
SELECT study_id, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT person_id) AS BIGINT) AS n_distinct,
  CAST(0 AS BIGINT) AS n_blank, count(*) = count(DISTINCT person_id) AS is_key FROM evaluations GROUP BY ALL""")
def q6_key_check(spark: SparkSession, path: str) -> DataFrame:
    return s.id_check(r.evaluations(spark, path), "person_id").select(
        "study_id", big("n_rows"), big("n_distinct"), big("n_blank"), "is_key")


@register("q7_checks", f"""
WITH {r.CUSTOMERS_SQL}, s AS (SELECT study_id, count(*) AS n, count(*) FILTER (WHERE wave IS NULL) AS mw,
  count(*) FILTER (WHERE nation % 25 IN (0, 1, 2)) AS bad, count(DISTINCT CASE WHEN nation IN (0, 1, 2) THEN nation END) AS kinds
  FROM customers GROUP BY ALL)
SELECT study_id, i.c AS code, i.s AS state, i.m AS message, i.b AS blocking FROM (SELECT study_id, unnest([
  {{'c': 'QA-SOURCE-N', 's': 'PASS', 'm': 'source_n=' || n, 'b': false}},
  {{'c': 'QA-RUNTIME-N', 's': 'PASS', 'm': 'runtime_n=' || n, 'b': false}},
  {{'c': 'QA-MISSING', 's': 'PASS', 'm': 'wave missing_count=' || mw, 'b': false}},
  {{'c': 'QA-MISSING', 's': 'PASS', 'm': 'nation missing_count=0', 'b': false}},
  {{'c': 'QA-CATEGORY-DOMAIN', 's': CASE WHEN kinds = 0 THEN 'PASS' ELSE 'FAIL' END, 'm': 'undeclared=' || kinds,
    'b': kinds > 0}},
  {{'c': 'QA-REFERENCE-INTEGRITY', 's': 'PASS', 'm': 'dangling=0', 'b': false}}]) AS i FROM s)""")
def q7_checks(spark: SparkSession, path: str) -> DataFrame:
    """Nations 0 to 2 are not in the declared domain."""
    people = r.customers(spark, path)
    cells = s.unpivot_cells(people, ["study_id", "respondent_id"], ["wave", "nation"])
    allowed = cells.filter("variable = 'wave' OR number > 2").select(
        "study_id", "variable", "code").distinct()
    invalid = q.domain_violations(cells, allowed)
    source = people.groupBy("study_id").agg(F.count("*").alias("n_rows"))
    none = invalid.filter("false").select("study_id")
    return q.materialization_checks(source, cells, invalid, none)


@register("q8_integrity", """
SELECT 'all' AS study_id, 'order of a line' AS kind, CAST(o AS VARCHAR) AS reference FROM (
  SELECT DISTINCT CASE WHEN l_quantity < 3 THEN -l_orderkey ELSE l_orderkey END AS o FROM lineitem) WHERE o NOT IN (
  SELECT CASE WHEN o_orderstatus = 'F' THEN -o_orderkey ELSE o_orderkey END FROM orders) UNION ALL
SELECT 'all', 'customer of an order', CAST(c AS VARCHAR) FROM (SELECT DISTINCT o_custkey AS c FROM orders)
WHERE c NOT IN (SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN -c_custkey ELSE c_custkey END FROM customer)""")
def q8_integrity(spark: SparkSession, path: str) -> DataFrame:
    """Keys of small lines, finished orders and builders have another sign, so some references dangle."""
    def frame(name: str, key: str, turned: str) -> DataFrame:
        return r.table(spark, path, name).select("*", F.lit("all").alias("study_id"), F.when(
            F.expr(turned), -F.col(key)).otherwise(F.col(key)).alias("key"))
    orders = frame("orders", "o_orderkey", "o_orderstatus = 'F'")
    return q.dangling_references([
        ("order of a line", frame("lineitem", "l_orderkey", "l_quantity < 3"), "key", orders, "key"),
        ("customer of an order", orders, "o_custkey",
         frame("customer", "c_custkey", "c_mktsegment = 'BUILDING'"), "key"),
    ])


@register("q9_release", """
WITH e AS (SELECT user_id, bool_or(event_type = 'error' AND value > 200) AS blocked,
  bool_or(event_type = 'signup' AND value > 150) AS review, count(*) FILTER (WHERE value > 100) AS n FROM events GROUP BY ALL)
SELECT user_id AS run_id, CASE WHEN user_id % 10 = 0 THEN 'FAIL' WHEN blocked THEN 'FAIL' WHEN review THEN 'REVIEW_REQUIRED'
    WHEN n > 0 THEN 'PASS_WITH_WARNINGS' WHEN user_id % 2 = 1 THEN 'REVIEW_REQUIRED' ELSE 'PASS' END AS qa_release_status,
  user_id % 10 <> 0 AND NOT blocked AND NOT review AND user_id % 2 = 0 AS releasable FROM e""")
def q9_release(spark: SparkSession, path: str) -> DataFrame:
    """Runs are users and their large events QA rows; small events are of runs that no one registered."""
    events = r.table(spark, path, "events").withColumn("run_id", F.col("user_id"))
    of_run = F.when(F.col("value") > 100, F.col("run_id")).otherwise(-1 - F.col("run_id")).alias("run_id")
    large = (F.col("event_type") == "error") & (F.col("value") > 200)
    review = (F.col("event_type") == "signup") & (F.col("value") > 150)
    rows = events.select(
        of_run, F.when(review, "REVIEW_REQUIRED").otherwise("WARNING").alias("state"),
        large.alias("blocking"))
    runs = events.select("run_id").distinct().select(
        "run_id", F.when(F.col("run_id") % 10 == 0, "FAILED").otherwise("COMPLETE")
        .alias("computation_status"), (F.col("run_id") % 2 == 0).alias("release_evidence"))
    return q.release_state(rows, runs)


@register("q11_fingerprint", f"""
WITH {r.EVALUATIONS_SQL},
h AS (SELECT study_id, sha256('{{"n":' || count(*) || ',"status":"' || status || '","study_id":"' || study_id || '"}}') AS h
      FROM evaluations GROUP BY study_id, status),
p AS (SELECT study_id, count(*) AS n, """ + ", ".join(
    f"CAST(sum(CAST(('0x' || substr(h, {1 + 15 * i}, 15)) AS BIGINT)) AS VARCHAR) AS s{i}" for i in range(4)) + """
  FROM h GROUP BY ALL)
SELECT study_id, CAST(n AS BIGINT) AS n_rows, sha256(n || '|' || s0 || '|' || s1 || '|' || s2 || '|' || s3) AS fingerprint FROM p""")
def q11_fingerprint(spark: SparkSession, path: str) -> DataFrame:
    cells = r.evaluations(spark, path).groupBy("study_id", "status").agg(
        F.count("*").alias("n"), F.max("respondent_id").alias("run_id"))
    return q.result_fingerprint(cells, volatile=["run_id"])


@register("j7_compare", f"""
WITH {r.EVALUATIONS_SQL},
a AS (SELECT study_id, nullif(status, 'P') AS k, o_orderpriority AS response, CAST(count(*) AS DOUBLE) AS v FROM evaluations
      WHERE o_orderpriority <> '5-LOW' GROUP BY ALL),
b AS (SELECT study_id, nullif(status, 'P') AS k, o_orderpriority AS response,
        CAST(count(*) + CASE WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END AS DOUBLE) AS v FROM evaluations
      WHERE o_orderpriority <> '1-URGENT' GROUP BY study_id, 2, o_orderpriority)
SELECT coalesce(a.study_id, b.study_id) AS study_id, coalesce(a.k, b.k, '-') AS status,
  coalesce(a.response, b.response) AS response, coalesce(a.v, -1) AS left_value, coalesce(b.v, -1) AS right_value,
  CASE WHEN a.v = b.v THEN 'PARITY' WHEN coalesce(a.response, b.response) = '5-LOW' THEN 'EXPECTED_POLICY_DELTA'
    ELSE 'POTENTIAL_REGRESSION' END AS classification,
  CASE WHEN a.v = b.v THEN 'values are equivalent before presentation rounding'
    WHEN coalesce(a.response, b.response) = '5-LOW' THEN 'classified delta'
    WHEN coalesce(a.response, b.response) = '2-HIGH' THEN 'PARITY classification rejected for actual delta'
    ELSE 'unexplained delta' END AS reason
FROM a FULL JOIN b ON a.study_id = b.study_id AND a.k IS NOT DISTINCT FROM b.k AND a.response = b.response""")
def j7_compare(spark: SparkSession, path: str) -> DataFrame:
    """Two runs that differ in one response, and lack one response each."""
    def run(dropped: str, extra: int) -> DataFrame:
        rows = r.evaluations(spark, path).filter(F.col("o_orderpriority") != dropped)
        more = F.when(F.col("response") == "2-HIGH", extra).otherwise(0)
        return rows.groupBy("study_id", F.when(F.col("status") != "P", F.col("status")).alias("status"),
                            F.col("o_orderpriority").alias("response")).agg(
            F.count("*").alias("n")).withColumn("value", (F.col("n") + more).cast("double"))
    left, right = run("5-LOW", 0), run("1-URGENT", 1)
    classes = right.filter("response IN ('5-LOW', '2-HIGH')").select(
        "study_id", "status", "response", F.when(F.col("response") == "5-LOW", "EXPECTED_POLICY_DELTA")
        .otherwise("PARITY").alias("classification"))
    compared = q.compare_results(left, right, ["study_id", "status", "response"], classes)
    return compared.select(
        "study_id", F.coalesce("status", F.lit("-")).alias("status"), "response",
        F.coalesce("left_value", F.lit(-1.0)).alias("left_value"),
        F.coalesce("right_value", F.lit(-1.0)).alias("right_value"), "classification", "reason")


# --- remaining sources and scalar functions ---------------------------------

@register("s1_load", """
SELECT CAST(l_linenumber AS BIGINT) AS line, CAST(count(*) AS BIGINT) AS n_rows,
  CAST(count(*) FILTER (WHERE l_quantity <> 7) AS BIGINT) AS n_values, round(avg(CASE WHEN l_quantity <> 7
  THEN l_quantity END), 6) AS mean FROM lineitem GROUP BY ALL""")
def s1_load(spark: SparkSession, path: str) -> DataFrame:
    """NaN in the landed file is missing, so it stays out of counts and means."""
    landed = r.table(spark, path, "lineitem").withColumn("l_quantity", F.when(
        F.col("l_quantity") != 7, F.col("l_quantity")).otherwise(F.lit(float("nan"))))
    target = shared_folder(spark, "landed")
    labels = r.table(spark, path, "part").select("p_partkey", "p_name")
    for name, frame in (("answers", landed), ("variable_labels", labels),
                        ("value_labels", labels), ("missing_rules", labels.limit(0))):
        frame.write.parquet(f"{target}/{name}")
    return src.load_study(spark, target)["answers"].groupBy(F.col("l_linenumber").cast("bigint").alias("line")).agg(
        F.count("*").alias("n_rows"), F.count("l_quantity").alias("n_values"),
        F.round(F.avg("l_quantity"), 6).alias("mean"))


@register("s2_codebook", """
WITH b AS (SELECT CASE WHEN p_partkey % 5 = 4 THEN 'Q' ELSE 'P' END || p_partkey AS variable,
    CASE WHEN p_size % 2 = 0 THEN '' ELSE p_name END AS label FROM part),
l AS (SELECT l_partkey, CASE WHEN l_quantity < 5 THEN l_linenumber END AS n FROM lineitem),
o AS (SELECT 'P' || l_partkey AS variable, CASE WHEN count(DISTINCT n) = 1 THEN CAST(min(n) AS VARCHAR) ELSE '' END AS label
      FROM l GROUP BY l_partkey)
SELECT b.variable, CASE WHEN b.label = '' THEN coalesce(o.label, '') ELSE b.label END AS label
FROM b LEFT JOIN o USING (variable) UNION ALL
SELECT o.variable, o.label FROM o WHERE variable NOT IN (SELECT variable FROM b)""")
def s2_codebook(spark: SparkSession, path: str) -> DataFrame:
    """A main sheet, and one that names variables in a list cell."""
    letter = F.when(F.col("p_partkey") % 5 == 4, "Q").otherwise("P")
    main = r.table(spark, path, "part").select(
        F.lit("s").alias("study_id"), F.concat(letter, F.col("p_partkey").cast("string"))
        .alias("variable"), F.when(F.col("p_size") % 2 == 0, "").otherwise(F.col("p_name")).alias("label"))
    listed = r.table(spark, path, "lineitem").select(
        F.lit("s").alias("study_id"), F.concat(F.lit("1) P"), F.col("l_partkey").cast("string"),
                                               F.lit(";")).alias("names"),
        F.when(F.col("l_quantity") < 5, F.col("l_linenumber").cast("string")).otherwise("").alias("label"))
    merged = src.load_codebook([("main", main), ("list", listed)], {"list": "names"})
    return merged.select("variable", "label")


@register("d7_grid_long", f"""
WITH {r.EVALUATIONS_SQL}, {r.GRID_SQL}
SELECT study_id, 'GRID' AS question_id, entity, 'Estado ' || option AS option, CAST(count(*) AS BIGINT) AS n,
  CAST(count(*) FILTER (WHERE value = '1') AS BIGINT) AS selected,
  CAST(count(*) FILTER (WHERE valid) AS BIGINT) AS base_valid
FROM (SELECT *, bool_or(value IS NOT NULL) OVER (PARTITION BY study_id, respondent_id, entity) AS valid FROM grid)
GROUP BY ALL""")
def d7_grid_long(spark: SparkSession, path: str) -> DataFrame:
    """A wide grid file, one column per entity and option."""
    grid = r.entity_grid(spark, path)
    names = [(a, o) for a in "ANR" for o in "FO"]
    wide = grid.groupBy("study_id", "respondent_id").agg(*[
        F.max(F.when((F.col("entity") == a) & (F.col("option") == o), F.col("value")))
        .alias(f"G_{a}_{o}") for a, o in names])
    studies = r.table(spark, path, "region").select(F.col("r_name").alias("study_id"))
    fixed = {"question_id": "GRID", "grid_id": "GRID", "parent_question": "", "question_type": "GRID_RM",
             "grid_structure": "", "is_grid_rm_loop": "", "is_attached_open": "", "entity_label": "",
             "row_text": "", "label": "", "option_code": "1"}
    book = studies.select("study_id", F.inline(F.array(*[F.struct(
        F.lit(f"G_{a}_{o}").alias("variable"), F.lit(a).alias("entity"),
        F.lit(f"Estado {o}").alias("option_label")) for a, o in names]))).withColumns(
        {c: F.lit(v) for c, v in fixed.items()})
    labels = spark.createDataFrame(
        [], "study_id string, variable string, code string, label string, ord int")
    cells = s.unpivot_cells(wide, ["study_id", "respondent_id"], [f"G_{a}_{o}" for a, o in names])
    return s.build_grid_long(cells, book, labels).groupBy(
        "study_id", "question_id", "entity", "option").agg(
        F.count("*").alias("n"), F.sum("selected").cast("bigint").alias("selected"),
        F.sum("base_valid").cast("bigint").alias("base_valid"))


@register("x2_truthy", """
SELECT event_type AS word, event_type IN ('click', 'view') AS is_true, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL""")
def x2_truthy(spark: SparkSession, path: str) -> DataFrame:
    from tabuloom.functions.text import truthy
    words = {"click": " Sí ", "view": "RECOMENDADA", "error": "no", "signup": "2", "purchase": "1.0"}
    word = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in words.items()])
    return r.table(spark, path, "events").groupBy(
        F.col("event_type").alias("word"), truthy(word).alias("is_true")).agg(F.count("*").alias("n"))


@register("x8_text_parts", """
SELECT page_id, regexp_extract(url, '([0-9]+)', 1) AS first_number,
  list_extract(regexp_split_to_array(replace(url, '-', '_'), '_'), -1) AS suffix,
  CASE WHEN length(trim(t)) <= 40 THEN trim(t) ELSE rtrim(substr(trim(t), 1, 39)) || '…' END AS short
FROM (SELECT page_id, url, regexp_replace(url, '[/?=]', '_', 'g') AS t FROM pages)""")
def x8_text_parts(spark: SparkSession, path: str) -> DataFrame:
    from tabuloom.functions import text as x
    flat = F.regexp_replace("url", "[/?=]", "_")
    number = x.numeric_part(F.col("url")).cast("bigint").cast("string")
    raw = F.regexp_extract("url", "([0-9]+)", 1)
    return r.table(spark, path, "pages").select(
        "page_id", F.when(number.isNull(), "").otherwise(raw).alias("first_number"),
        x.suffix_code(F.col("url")).alias("suffix"), x.short_text(flat, 40).alias("short"))

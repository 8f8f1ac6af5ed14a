"""Codebook tables, structure detection and variable profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from study_queries import roles as r
from study_queries.core import big, r6
from tabuloom.operators import codebook as cb
from tabuloom.operators import detect as dt
from tabuloom.operators import profile as pf
from tabuloom.operators import reshape as s
from tabuloom.operators.tables import identity_rows, with_lookups
from tabuloom.operators.breakdown import with_banner_cells

QUERIES, SQL = {}, {}


def register(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function
    return add


def pick(expression: str, values: list[str | None]):
    """Choose a text by a number; the same helper writes the SQL twin."""
    column = None
    for i, v in enumerate(values):
        hit = F.expr(expression) == i
        value = F.lit(v).cast("string")
        column = F.when(hit, value) if column is None else column.when(hit, value)
    return column


def pick_sql(expression: str, values: list[str | None]) -> str:
    cases = " ".join(
        f"WHEN {i} THEN " + ("NULL" if v is None else "'" + v.replace("'", "''") + "'")
        for i, v in enumerate(values))
    return f"CASE {expression} {cases} END"


SHEET = {
    "question_type": ("p_partkey % 7", ["RM_SIMPLE (0/código)", "", "Escala", "LOOP_RU (marca)",
                                         "RM", None, "nan"]),
    "suggested_table": ("p_size % 5", ["jar", "escala_1_5", "cruce_sexo", "nps", "otra"]),
    "analytic_class": ("p_size % 6", ["", "Banner", "peso", "Abierta codificada", "rara",
                                       "Variable Técnica"]),
    "calculation": ("p_partkey % 4", ["promedio", "", "cosa", "Top 2 Box"]),
    "in_dashboard": ("p_size % 4", ["No usar", "Sí", "", "análisis"]),
    "section": ("p_size % 3", ["", "A", "B"]),
}


def sheet(spark: SparkSession, path: str) -> DataFrame:
    """A codebook sheet per study: one variable per part, questions by brand."""
    return r.table(spark, path, "part").select(
        F.concat(F.lit("st"), (F.col("p_partkey") % 4).cast("string")).alias("study_id"),
        F.concat(F.lit("V"), F.col("p_partkey").cast("string")).alias("variable"),
        F.col("p_partkey").alias("position"), F.col("p_name").alias("label"),
        F.col("p_brand").alias("question_id"), F.col("p_size").alias("questionnaire_order"),
        *[pick(e, v).alias(c) for c, (e, v) in SHEET.items()],
    )


SHEET_SQL = """sheet AS (
  SELECT 'st' || (p_partkey % 4) AS study_id, 'V' || p_partkey AS variable, p_partkey AS position,
    p_name AS label, p_brand AS question_id, p_size AS questionnaire_order, p_size, p_partkey, """ + \
    ", ".join(f"{pick_sql(e, v)} AS {c}" for c, (e, v) in SHEET.items()) + " FROM part)"

# What the rules of P2, P5, P6 and P7 make of the sheet above.
TYPED_SQL = SHEET_SQL + """,
typed AS (
  SELECT *,
    CASE WHEN p_size % 6 = 3 THEN 'RM codificada'
      ELSE CASE p_partkey % 7 WHEN 0 THEN 'RM' WHEN 2 THEN 'Escala' WHEN 4 THEN 'RM'
        WHEN 3 THEN CASE WHEN p_size % 5 = 0 THEN 'Escala JAR' ELSE 'RU' END
        ELSE CASE p_size % 5 WHEN 0 THEN 'Escala JAR' WHEN 1 THEN 'Escala' WHEN 2 THEN 'RU'
               WHEN 3 THEN 'NPS' ELSE 'Sin clasificar' END END END AS t,
    CASE p_size % 6 WHEN 0 THEN 'Pregunta analizable' WHEN 1 THEN 'Banner' WHEN 2 THEN 'Ponderador'
      WHEN 3 THEN 'Pregunta analizable' WHEN 4 THEN 'Requiere validación'
      ELSE 'Variable técnica' END AS cls,
    CASE p_partkey % 4 WHEN 0 THEN 'Media' WHEN 1 THEN 'Frecuencia' WHEN 2 THEN 'No aplica'
      ELSE 'Top2Box' END AS calc0,
    CASE WHEN p_partkey % 7 = 0 THEN 'codigo_por_opcion' ELSE '' END AS fmt0
  FROM sheet),
final AS (
  SELECT *, CASE WHEN calc0 IN ('Frecuencia', 'No aplica') THEN
      CASE WHEN t IN ('RM', 'RM codificada') THEN 'RM % Respondentes' WHEN t LIKE 'Escala%' THEN 'Media'
        WHEN t = 'NPS' THEN 'NPS' ELSE calc0 END ELSE calc0 END AS calc,
    NOT (cls IN ('Ponderador', 'Variable técnica') OR p_size % 4 = 0) AS dash
  FROM typed)"""


@register("p2_defaults", f"""
WITH {SHEET_SQL}
SELECT study_id, question_id, CAST(count(*) AS BIGINT) AS n,
  CAST(count(*) FILTER (WHERE p_partkey % 7 IN (1, 5, 6)) AS BIGINT) AS untyped,
  CAST(count(*) FILTER (WHERE p_partkey % 4 = 1) AS BIGINT) AS default_calculation
FROM sheet GROUP BY ALL""")
def p2_defaults(spark: SparkSession, path: str) -> DataFrame:
    filled = cb.fill_defaults(sheet(spark, path))
    return filled.groupBy("study_id", "question_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("question_type") == "Sin clasificar").alias("untyped"),
        F.count_if(F.col("calculation") == "Frecuencia").alias("default_calculation"))


@register("p3_merge", """
WITH base AS (
  SELECT 'st' || (p_partkey % 4) AS study_id, CASE WHEN p_partkey % 10 = 3 THEN 'W' ELSE 'V' END || p_partkey AS variable,
    CASE WHEN p_size % 3 = 0 THEN ' ' ELSE p_name END AS label, p_partkey FROM part),
lines AS (
  SELECT l_partkey, CASE WHEN l_quantity < 20 THEN l_returnflag END AS f, CASE WHEN l_quantity < 20 THEN l_linestatus END AS s FROM lineitem),
other AS (
  SELECT 'st' || (l_partkey % 4) AS study_id, lower('V' || l_partkey) AS k, min('v' || l_partkey || ' ') AS v,
    CASE WHEN count(DISTINCT f) = 1 THEN min(f) ELSE '' END AS label,
    CASE WHEN count(DISTINCT s) = 1 THEN min(s) ELSE '' END AS unit
  FROM lines GROUP BY 1, 2)
SELECT b.study_id, b.variable, CASE WHEN trim(b.label) = '' AND coalesce(o.label, '') <> '' THEN o.label
    ELSE b.label END AS label, coalesce(o.unit, '') AS unit
FROM base b LEFT JOIN other o ON b.study_id = o.study_id AND lower(b.variable) = o.k
UNION ALL
SELECT o.study_id, o.v, o.label, o.unit FROM other o
WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.study_id = o.study_id AND lower(b.variable) = o.k)""")
def p3_merge(spark: SparkSession, path: str) -> DataFrame:
    """Some parts have names that no line has; large quantities leave blanks."""
    letter = F.when(F.col("p_partkey") % 10 == 3, "W").otherwise("V")
    base = r.table(spark, path, "part").select(
        F.concat(F.lit("st"), (F.col("p_partkey") % 4).cast("string")).alias("study_id"),
        F.concat(letter, F.col("p_partkey").cast("string")).alias("variable"),
        F.when(F.col("p_size") % 3 == 0, " ").otherwise(F.col("p_name")).alias("label"))
    told = lambda c: F.when(F.col("l_quantity") < 20, F.col(c)).otherwise("")
    other = r.table(spark, path, "lineitem").select(
        F.concat(F.lit("st"), (F.col("l_partkey") % 4).cast("string")).alias("study_id"),
        F.concat(F.lit("v"), F.col("l_partkey").cast("string"), F.lit(" ")).alias("variable"),
        told("l_returnflag").alias("label"), told("l_linestatus").alias("unit"))
    return cb.merge_by_variable(base, other).select("study_id", "variable", "label", "unit")


@register("p4_explode", """
SELECT conv_id, turn, CAST(len(list_distinct(regexp_extract_all(text,
  '[A-Za-z@#$][A-Za-z0-9_@#$]*(?:\\.[A-Za-z0-9_@#$]+)*'))) AS BIGINT) AS n_variables
FROM conversations WHERE regexp_matches(text, '[A-Za-z@#$]')""")
def p4_explode(spark: SparkSession, path: str) -> DataFrame:
    rows = cb.explode_variables(r.table(spark, path, "conversations"), "text")
    return rows.groupBy("conv_id", "turn").agg(F.count("*").alias("n_variables"))


@register("p7_roles", f"""
WITH {TYPED_SQL}
SELECT study_id, variable, t AS question_type, cls AS analytic_class, calc AS calculation,
  dash AS in_dashboard, cls = 'Banner' AS is_banner, cls = 'Ponderador' AS is_weight FROM final""")
def p7_roles(spark: SparkSession, path: str) -> DataFrame:
    """Defaults, classes, types and dashboard flags together."""
    return cb.prepare_codebook(sheet(spark, path)).select(
        "study_id", "variable", "question_type", "analytic_class", "calculation", "in_dashboard",
        "is_banner", "is_weight")


@register("p6_format_spread", f"""
WITH {SHEET_SQL}, s AS (
  SELECT study_id, question_id, p_size % 50 AS sub, p_partkey % 7 IN (0, 4) AS rm,
    p_partkey % 7 = 0 AS coded FROM sheet),
g AS (SELECT study_id, question_id, sub, bool_and(rm) AND bool_or(coded) AS spread FROM s GROUP BY ALL)
SELECT study_id, question_id || '/' || sub AS question_id,
  CAST(count(*) FILTER (WHERE coded OR spread) AS BIGINT) AS n_coded, CAST(count(*) AS BIGINT) AS n
FROM s JOIN g USING (study_id, question_id, sub) GROUP BY ALL""")
def p6_format_spread(spark: SparkSession, path: str) -> DataFrame:
    """Small questions, some of them all multiple response."""
    rows = sheet(spark, path).withColumn("question_id", F.concat_ws(
        "/", "question_id", (F.col("questionnaire_order") % 50).cast("string"))).withColumn(
        "suggested_table", F.lit(""))
    typed = cb.annotated_types(cb.normalize_roles(cb.fill_defaults(rows)))
    return typed.groupBy("study_id", "question_id").agg(
        F.count_if(F.col("format_rm") == "codigo_por_opcion").alias("n_coded"),
        F.count("*").alias("n"))


@register("p8_separate", f"""
WITH {SHEET_SQL}, s AS (SELECT *, question_id || '/' || (p_size % 50) AS q,
    CASE WHEN p_partkey % 7 IN (0, 4) THEN 'RM' ELSE 'RU' END AS kind FROM sheet),
g AS (SELECT study_id, q, count(*) > 1 AND bool_and(kind = 'RU') AS split FROM s GROUP BY ALL)
SELECT study_id, variable, CASE WHEN split THEN q || '::' || variable ELSE q END AS question_id,
  CASE WHEN split THEN label || ' [Variable: ' || variable || ']' ELSE label END AS question_text,
  CASE WHEN split THEN q ELSE '' END AS parent_question
FROM s JOIN g USING (study_id, q)""")
def p8_separate(spark: SparkSession, path: str) -> DataFrame:
    rows = sheet(spark, path).withColumns({
        "question_id": F.concat_ws("/", "question_id",
                                   (F.col("questionnaire_order") % 50).cast("string")),
        "question_type": F.when((F.col("position") % 7).isin(0, 4), "RM").otherwise("RU"),
    })
    separated, _ = cb.separate_repeated(cb.fill_defaults(rows))
    return separated.select("study_id", "variable", "question_id", "question_text",
                            "parent_question")


@register("p9_questions", f"""
WITH {TYPED_SQL},
v AS (SELECT study_id, question_id, t, count(*) AS n, min(position) AS p FROM final GROUP BY ALL),
b AS (SELECT study_id, question_id, t FROM v
      QUALIFY row_number() OVER (PARTITION BY study_id, question_id ORDER BY n DESC, p) = 1),
sv AS (SELECT study_id, question_id, section, count(*) AS n, min(position) AS p FROM final
       WHERE section <> '' GROUP BY ALL),
sb AS (SELECT study_id, question_id, section FROM sv
       QUALIFY row_number() OVER (PARTITION BY study_id, question_id ORDER BY n DESC, p) = 1)
SELECT f.study_id, f.question_id, b.t AS question_type, coalesce(sb.section, '') AS section,
  bool_or(dash) AS in_dashboard, CAST(min(p_size) AS DOUBLE) AS questionnaire_order
FROM final f JOIN b USING (study_id, question_id) LEFT JOIN sb USING (study_id, question_id)
GROUP BY ALL""")
def p9_questions(spark: SparkSession, path: str) -> DataFrame:
    book = cb.prepare_codebook(sheet(spark, path))
    return cb.build_questions(book, ["question_text", "question_type", "section"]).select(
        "study_id", "question_id", "question_type", "section", "in_dashboard",
        "questionnaire_order")


# Value labels: the priority labels of the customers' studies, with repeats and declared options.
@register("p10_options", f"""
WITH {r.EVALUATIONS_SQL},
l AS (SELECT study_id, 'priority_' || segment AS variable, split_part(o_orderpriority, '-', 1) AS code,
        CASE WHEN o_orderpriority LIKE '5%' THEN 'Otro / No sabe' ELSE substr(o_orderpriority, 3) END
          AS label, min(respondent_id) AS ord FROM evaluations GROUP BY 1, 2, 3, 4),
d AS (SELECT DISTINCT study_id, 'priority_' || segment AS variable, '9' AS code, 'Ninguna' AS label
      FROM evaluations)
SELECT study_id, variable, 'Q_' || variable AS question_id, code, label,
  contains(lower(label), 'otro') AS is_other,
  contains(lower(label), 'ninguna') OR contains(lower(label), 'no sabe') AS is_exclusive
FROM (SELECT study_id, variable, code, label FROM l UNION ALL SELECT * FROM d)""")
def p10_options(spark: SparkSession, path: str) -> DataFrame:
    evaluation = r.evaluations(spark, path)
    parts = F.split("o_orderpriority", "-", 2)
    variable = F.concat(F.lit("priority_"), "segment")
    labels = evaluation.groupBy(
        "study_id", variable.alias("variable"), parts[0].alias("code"),
        F.when(parts[0] == "5", "Otro / No sabe").otherwise(parts[1]).alias("label"),
    ).agg(F.min("respondent_id").alias("ord"))
    repeated = labels.unionByName(labels.withColumn("ord", F.col("ord") + 1))
    book = evaluation.select("study_id", variable.alias("variable")).distinct().select(
        "study_id", "variable", F.concat(F.lit("Q_"), "variable").alias("question_id"),
        F.lit(1).alias("position"), F.lit("x").alias("label"), F.lit("9").alias("option_code"),
        F.lit("Ninguna").alias("option_label"), F.lit(99).alias("option_order"))
    return cb.build_options(repeated, book).select(
        "study_id", "variable", "question_id", "code", "label", "is_other", "is_exclusive")


GRID_BOOK = {"grid_structure": ("p_size % 5", ["GRID_ESCALA", "LOOP_RU", "", "GRID RM", ""]),
             "parent_question": ("p_size % 5", ["P1", "P2", "P3", "P4", ""])}
GRID_BOOK_SQL = """items AS (
  SELECT 'st' || (p_partkey % 4) AS study_id, 'V' || p_partkey AS variable, p_partkey AS position,
    CASE WHEN length(p_brand) > 7 THEN p_brand ELSE 'Grid ' || p_brand END AS grid_id, p_partkey % 9 = 0 AS rm, p_size % 5 AS k, """ + ", ".join(
    f"{pick_sql(e, v)} AS {c}" for c, (e, v) in GRID_BOOK.items()) + """
  FROM part)"""


def grid_book(spark: SparkSession, path: str) -> DataFrame:
    """Brands with a short name are not called like a question."""
    brand = F.col("p_brand")
    grid = F.when(F.length(brand) > 7, brand).otherwise(F.concat(F.lit("Grid "), brand))
    return r.table(spark, path, "part").select(
        F.concat(F.lit("st"), (F.col("p_partkey") % 4).cast("string")).alias("study_id"),
        F.concat(F.lit("V"), F.col("p_partkey").cast("string")).alias("variable"),
        F.col("p_partkey").alias("position"), grid.alias("grid_id"),
        (F.col("p_partkey") % 9 == 0).alias("is_grid_rm_loop"),
        (F.col("p_size") % 5 == 4).alias("is_grid"), F.lit(False).alias("is_grid_item"),
        F.lit("").alias("scale_columns_type"), F.lit("").alias("grid_metric"),
        F.lit("").alias("tabular_rule"), *[pick(e, v).alias(c) for c, (e, v) in GRID_BOOK.items()])


@register("p11_grids", f"""
WITH {GRID_BOOK_SQL}, i AS (SELECT * FROM items WHERE grid_structure <> '' OR k = 4)
SELECT study_id, grid_id, CAST(count(*) AS BIGINT) AS n_items, bool_or(rm) AS is_grid_rm_loop,
  arg_min(grid_structure, position) AS grid_type,
  CASE WHEN arg_min(parent_question, position) = '' THEN grid_id
    ELSE arg_min(parent_question, position) END AS parent_question
FROM i GROUP BY study_id, grid_id""")
def p11_grids(spark: SparkSession, path: str) -> DataFrame:
    grids = cb.build_grids(cb.grid_items(grid_book(spark, path)))
    return grids.select("study_id", "grid_id", "n_items", "is_grid_rm_loop", "grid_type",
                        "parent_question")


def advice_sheets(spark: SparkSession, path: str) -> list:
    rows = sheet(spark, path).select(
        "study_id", "variable", "question_id", "position", "label",
        (F.col("position") % 5 == 0).alias("is_banner_recommended"),
        (F.col("position") % 6 == 0).alias("is_filter_recommended"),
        (F.col("position") % 7 == 0).alias("requires_factor"),
        F.lit("").alias("factor_type"), F.lit("1: 20; 2: 30").alias("justification"),
        F.lit(None).cast("string").alias("use"))
    # The preferred sheet lists other studies and, beside some variables, unknown ones.
    named = F.when(F.col("position") % 3 == 0, F.col("variable")).otherwise(F.concat(F.lit("Z"), "variable"))
    listed = F.when(F.col("study_id").isin("st0", "st1"), F.col("study_id")).otherwise(
        F.concat(F.lit("only_"), "study_id"))
    preferred = rows.withColumns({"study_id": listed, "variable": named})
    return [("11_Banners", "banner_filtro", 0, preferred), ("08_Clases", "banner_filtro", 1, rows),
            ("10_Datamap", "factor_score", 1, rows.unionByName(rows))]


@register("p13_recommendations", f"""
WITH {SHEET_SQL}
SELECT CASE WHEN study_id IN ('st0', 'st1') THEN study_id ELSE 'only_' || study_id END AS study_id,
  'banner_filtro' AS kind, '11_Banners' AS source_sheet, CAST(count(*) AS BIGINT) AS n FROM sheet GROUP BY ALL UNION ALL
SELECT study_id, 'banner_filtro', '08_Clases', CAST(count(*) AS BIGINT) FROM sheet
WHERE study_id NOT IN ('st0', 'st1') AND (position % 5 = 0 OR position % 6 = 0) GROUP BY ALL UNION ALL
SELECT study_id, 'factor_score', '10_Datamap', CAST(count(*) AS BIGINT) FROM sheet
WHERE position % 7 = 0 GROUP BY ALL""")
def p13_recommendations(spark: SparkSession, path: str) -> DataFrame:
    return cb.build_recommendations(advice_sheets(spark, path)).groupBy(
        "study_id", "kind", "source_sheet").agg(F.count("*").alias("n"))


@register("p12_configuration", f"""
WITH {TYPED_SQL}, roles AS (
  SELECT study_id, variable, label, position, 'banner' AS role FROM final WHERE cls = 'Banner' AND position % 8 <> 1
  UNION ALL SELECT study_id, variable, label, position, 'ponderador' FROM final WHERE cls = 'Ponderador'
  UNION ALL SELECT study_id, variable, label, position, 'pregunta_analizable' FROM final WHERE cls = 'Pregunta analizable'
  UNION ALL SELECT study_id, variable, label, position, 'variable_excluida' FROM final WHERE cls = 'Variable técnica'),
a AS (SELECT *, study_id IN ('st0', 'st1') AS pref FROM roles),
b AS (SELECT *, position % 5 = 0 AND (CASE WHEN pref THEN position % 3 = 0 ELSE true END
        OR position % 7 = 0) AS rb,
    position % 6 = 0 AND (CASE WHEN pref THEN position % 3 = 0 ELSE true END OR position % 7 = 0) AS rf
  FROM a)
SELECT study_id, role, variable, role = 'banner' AND rb AS is_recommended,
  CASE WHEN rb OR rf OR role = 'banner' THEN label || ' se recomienda como ' ||
    CASE WHEN rb AND rf THEN 'banner y filtro' ELSE role END ||
    ' porque permite comparar segmentos relevantes de forma clara y accionable.' ELSE '' END AS justification
FROM b""")
def p12_configuration(spark: SparkSession, path: str) -> DataFrame:
    book = cb.prepare_codebook(sheet(spark, path))
    advice = cb.build_recommendations(advice_sheets(spark, path))
    unsafe = book.filter("position % 8 = 1").select("study_id", "variable")
    return cb.build_configuration(book, advice, unsafe).select(
        "study_id", "role", "variable", "is_recommended", "justification")


def long_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Which questions have rows where: brands by the lines of their parts."""
    lines = r.table(spark, path, "lineitem").join(
        r.table(spark, path, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat(F.lit("st"), (F.col("p_partkey") % 4).cast("string")).alias("study_id"),
        F.col("p_brand").alias("question_id"), F.col("l_orderkey").alias("respondent_id"), "l_linenumber")
    # Each brand's lines are answers of one kind; some of questions that no codebook has.
    number = F.regexp_extract("question_id", r"\d+", 0).cast("int") % 6
    kinds = lines.withColumns({
        "kind": number,
        # Lines of a brand are answers of their own, or an order may answer twice.
        "respondent_id": F.when(number == 0, F.col("respondent_id") * 10 + F.col("l_linenumber")).otherwise(F.col("respondent_id")),
        "question_id": F.when(number == 5, F.concat(F.lit("Other "), "question_id")).otherwise(F.col("question_id"))})
    columns = ["study_id", "question_id", "respondent_id"]
    return {"responses": kinds.filter("kind IN (0, 1, 5)").select(columns), "multi": kinds.filter("kind = 2").select(columns),
            "scale": kinds.filter("kind = 3").select(columns), "open": kinds.filter("kind = 4").select(columns)}


@register("p15_catalogue", f"""
WITH {GRID_BOOK_SQL},
x AS (SELECT 'st' || (p_partkey % 4) AS study_id, p_brand AS question_id, l_orderkey, l_linenumber,
        CAST(substr(p_brand, 7) AS INTEGER) % 6 AS kind FROM lineitem JOIN part ON l_partkey = p_partkey),
mem AS (SELECT study_id, question_id, bool_or(kind IN (0, 1)) AS in_r, bool_or(kind = 2) AS in_m,
    bool_or(kind = 3) AS in_s, bool_or(kind = 4) AS in_o FROM x GROUP BY ALL),
rep AS (SELECT DISTINCT study_id, question_id FROM (
    SELECT study_id, question_id, CASE WHEN kind = 0 THEN l_orderkey * 10 + l_linenumber ELSE l_orderkey END AS respondent
    FROM x WHERE kind IN (0, 1) GROUP BY ALL HAVING count(*) > 1)),
qs AS (SELECT 'st' || (p_partkey % 4) AS study_id, p_brand AS question_id, min(p_partkey) AS p0 FROM part GROUP BY ALL),
g AS (SELECT study_id, grid_id AS question_id, bool_or(rm) AS rm, arg_min(grid_structure, position) AS gs
      FROM items WHERE grid_structure <> '' OR k = 4 GROUP BY ALL),
gg AS (SELECT *, CASE WHEN rm THEN 'GRID_RM/LOOP_RM' WHEN gs = 'GRID RM' THEN 'GRID_RM/LOOP_RM'
    WHEN gs = 'LOOP_RU' THEN 'LOOP_RU' ELSE 'GRID_ESCALA' END AS gt FROM g),
t AS (SELECT qs.study_id, qs.question_id,
    CASE WHEN gt = 'GRID_RM/LOOP_RM' THEN gt
      WHEN gt = 'GRID_ESCALA' THEN gt
      WHEN gt = 'LOOP_RU' THEN gt
      WHEN coalesce(in_s, false) THEN 'Escala' WHEN coalesce(in_m, false) OR rep.study_id IS NOT NULL THEN 'RM'
      WHEN coalesce(in_r, false) THEN 'RU' WHEN coalesce(in_o, false) THEN 'Abierta'
      ELSE 'Requiere validación' END AS inferred_type
  FROM qs LEFT JOIN gg USING (study_id, question_id) LEFT JOIN mem USING (study_id, question_id)
  LEFT JOIN rep ON rep.study_id = qs.study_id AND rep.question_id = qs.question_id
  UNION ALL
  SELECT study_id, question_id, gt FROM gg ANTI JOIN qs USING (study_id, question_id))
SELECT study_id, question_id, inferred_type, CASE WHEN question_id LIKE 'Grid %' THEN 'Sección GRID' ELSE 'Sección BRAND' END AS inferred_section FROM t
WHERE inferred_type <> 'Requiere validación'
  OR study_id NOT IN (SELECT study_id FROM t WHERE inferred_type <> 'Requiere validación')""")
def p15_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Types come from the tables a question has rows in, or from its grid."""
    book = sheet(spark, path).select(
        "study_id", "variable", "question_id", "position", "questionnaire_order",
        F.lit("").alias("question_type"), F.lit("").alias("calculation"),
        F.col("label").alias("question_text"), F.lit(True).alias("in_dashboard"),
        F.lit("Pregunta analizable").alias("analytic_class"))
    questions = cb.build_questions(book, ["question_text", "question_type", "calculation"])
    grids = cb.build_grids(cb.grid_items(grid_book(spark, path)))
    membership = cb.question_membership(long_tables(spark, path))
    return cb.question_catalogue(questions, grids, membership, book).select(
        "study_id", "question_id", "inferred_type", "inferred_section")


# --- detection --------------------------------------------------------------

NAMES_SQL = """names AS (SELECT p_partkey, p_size % 8 AS k, p_size, p_type AS ty, p_name,
  CASE p_size % 8 WHEN 0 THEN 'i_' || p_type || '_Q' || p_size || '_' || (p_partkey % 9)
    WHEN 1 THEN 'i_' || p_type || '_Q' || p_size
    WHEN 2 THEN replace(p_brand, '#', '_') || '_' || p_name
    WHEN 3 THEN 'Q' || p_size || '_otro' WHEN 4 THEN 'P-' || p_type || '-' || p_size
    WHEN 5 THEN 'Q' || p_size || '_' || (p_partkey % 7) WHEN 6 THEN 'SAT_' || p_type
    ELSE 'Q' || p_size || (p_partkey % 10) END AS variable, p_brand FROM part)"""


@register("c2_names", f"""
WITH {NAMES_SQL}
SELECT p_partkey, variable,
  CASE k WHEN 0 THEN 'Q' || p_size WHEN 1 THEN 'Q' || p_size WHEN 2 THEN split_part(p_name, ' ', 2)
    WHEN 3 THEN 'Q' || p_size WHEN 4 THEN 'P_' || ty WHEN 5 THEN 'Q' || p_size WHEN 6 THEN 'SAT'
    ELSE 'Q' || p_size END AS parent,
  CASE k WHEN 0 THEN ty WHEN 1 THEN ty
    WHEN 2 THEN replace(p_brand, '#', '_') || '_' || split_part(p_name, ' ', 1)
    WHEN 3 THEN '' WHEN 4 THEN ty WHEN 5 THEN '' WHEN 6 THEN ty
    ELSE CAST(p_partkey % 10 AS VARCHAR) END AS entity,
  CASE k WHEN 0 THEN CAST(p_partkey % 9 AS VARCHAR) WHEN 1 THEN '' WHEN 2 THEN '' WHEN 3 THEN 'otro'
    WHEN 4 THEN CAST(p_size AS VARCHAR) WHEN 5 THEN CAST(p_partkey % 7 AS VARCHAR) WHEN 6 THEN ty
    ELSE CAST(p_partkey % 10 AS VARCHAR) END AS option
FROM names""")
def c2_names(spark: SparkSession, path: str) -> DataFrame:
    part = r.table(spark, path, "part")
    size, key = F.col("p_size").cast("string"), F.col("p_partkey")
    k = F.col("p_size") % 8
    q = F.concat(F.lit("Q"), size)
    name = (
        F.when(k == 0, F.concat(F.lit("i_"), "p_type", F.lit("_"), q, F.lit("_"),
                                (key % 9).cast("string")))
        .when(k == 1, F.concat(F.lit("i_"), "p_type", F.lit("_"), q))
        .when(k == 2, F.concat(F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit("_"), "p_name"))
        .when(k == 3, F.concat(q, F.lit("_otro")))
        .when(k == 4, F.concat(F.lit("P-"), "p_type", F.lit("-"), size))
        .when(k == 5, F.concat(q, F.lit("_"), (key % 7).cast("string")))
        .when(k == 6, F.concat(F.lit("SAT_"), "p_type"))
        .otherwise(F.concat(q, (key % 10).cast("string")))
    )
    return part.select("p_partkey", name.alias("variable")).select(
        "p_partkey", "variable", dt.parse_name(F.col("variable")).alias("p")).select(
        "p_partkey", "variable", "p.*")


def detection_cells(spark: SparkSession, path: str) -> DataFrame:
    """Variables of several naming styles from the lines of three studies."""
    line, flag = F.col("l_linenumber").cast("string"), F.col("l_returnflag")
    yes = (F.col("l_linestatus") == "F").cast("int").cast("string")

    def cell(name, value):
        return F.struct(name.alias("variable"), value.alias("value"))

    items = F.array(
        cell(F.concat(F.lit("BR_"), flag, F.lit("_"), line), yes),
        cell(F.concat(F.lit("i_"), flag, F.lit("_Q5_"), line), yes),
        cell(F.concat(F.lit("SAT_"), flag), line),
        cell(F.concat(F.lit("QTY_"), line), F.col("l_quantity").cast("string")),
        cell(F.concat(F.lit("P_"), flag, F.lit("_otro")), F.col("l_linestatus")),
        cell(F.concat(F.lit("i_"), flag, F.lit("_GASTO")), F.col("l_extendedprice").cast("string")),
    )
    return s.typed_cells(r.table(spark, path, "lineitem").select(
        F.concat(F.lit("s"), (F.col("l_suppkey") % 3).cast("string")).alias("study_id"),
        F.col("l_orderkey").alias("respondent_id"), F.inline(items)))


def detection_inputs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    cells = detection_cells(spark, path)
    variables = cells.select("study_id", "variable").distinct()
    blank = {c: F.lit("") for c in (
        "question_type", "grid_id", "parent_question", "question_id", "question_number", "entity",
        "option_code", "is_grid", "is_grid_item", "is_grid_rm_loop", "is_attached_open",
        "grid_structure", "calculation", "analytic_class", "option_label", "format_rm",
        "question_text")}
    book = variables.withColumns({**blank, "label": F.col("variable"), "position": F.lit(0),
                                  "in_dashboard": F.lit(True)})
    single = variables.filter("variable LIKE 'BR_%' OR variable LIKE '%Q5%'").select(
        "study_id", "variable", F.lit("1").alias("code"), F.lit("Marcado").alias("label"),
        F.lit(1).alias("ord"))
    scale = variables.filter("variable LIKE 'SAT_%'").select("study_id", "variable", F.inline(
        F.array(*[F.struct(F.lit(str(i)).alias("code"), F.lit(t).alias("label"),
                           F.lit(i).alias("ord"))
                  for i, t in enumerate(["Nada", "Poco", "Algo", "Medio", "Bien", "Mucho", "Muy"],
                                        1)])))
    return cells, single.unionByName(scale), book


@register("c1_evidence", """
WITH v AS (
  SELECT 's' || (l_suppkey % 3) AS study_id, unnest([
    {'v': 'BR_' || l_returnflag || '_' || l_linenumber, 'x': CAST(l_linestatus = 'F' AS INT)::VARCHAR, 'p': '0/1'},
    {'v': 'i_' || l_returnflag || '_Q5_' || l_linenumber, 'x': CAST(l_linestatus = 'F' AS INT)::VARCHAR, 'p': '0/1'},
    {'v': 'SAT_' || l_returnflag, 'x': l_linenumber::VARCHAR, 'p': 'categorico'},
    {'v': 'QTY_' || l_linenumber, 'x': l_quantity::VARCHAR, 'p': 'continuo'},
    {'v': 'P_' || l_returnflag || '_otro', 'x': l_linestatus, 'p': 'texto'},
    {'v': 'i_' || l_returnflag || '_GASTO', 'x': l_extendedprice::VARCHAR, 'p': 'continuo'}]) AS c
  FROM lineitem)
SELECT study_id, c.v AS variable, c.p AS value_pattern, CAST(count(*) AS BIGINT) AS n_valid,
  CAST(CASE WHEN c.p = 'texto' THEN 0 ELSE count(*) END AS BIGINT) AS n_numeric
FROM v GROUP BY study_id, c.v, c.p""")
def c1_evidence(spark: SparkSession, path: str) -> DataFrame:
    evidence = dt.variable_evidence(*detection_inputs(spark, path))
    return evidence.select("study_id", "variable", "value_pattern", big("n_valid"),
                           big("n_numeric"))


STRUCTURES_SQL = """d AS (
  SELECT DISTINCT 's' || (l_suppkey % 3) AS study_id, l_returnflag AS f, l_linenumber AS l FROM lineitem),
g AS (
  SELECT study_id, 'BR_' || f AS parent, 'RM_SIMPLE' AS structure, 'Alta' AS confidence, count(*) AS n FROM d GROUP BY ALL
  UNION ALL SELECT study_id, 'Q5', 'GRID_RM/LOOP_RM', 'Alta', count(*) FROM d GROUP BY ALL
  UNION ALL SELECT study_id, 'SAT', 'GRID_ESCALA', 'Alta', count(DISTINCT f) FROM d GROUP BY ALL
  UNION ALL SELECT study_id, 'GASTO', 'LOOP_NUMERICO', 'Probable', count(DISTINCT f) FROM d GROUP BY ALL
  UNION ALL SELECT DISTINCT study_id, 'P_' || f, 'Abierta', 'Alta', 1 FROM d)"""


@register("c4_structures", f"""
WITH {STRUCTURES_SQL}
SELECT study_id, parent, structure, confidence, CAST(n AS BIGINT) AS n_members FROM g""")
def c4_structures(spark: SparkSession, path: str) -> DataFrame:
    groups = dt.classify_groups(dt.variable_evidence(*detection_inputs(spark, path)))
    return groups.select("study_id", "parent", "structure", "confidence", big("n_members"))


@register("c5_enriched", f"""
WITH {STRUCTURES_SQL},
v AS (SELECT DISTINCT study_id, f, l FROM d),
c AS (
  SELECT study_id, 'BR_' || f AS question_id, 'RM_SIMPLE' AS s FROM v UNION ALL
  SELECT study_id, 'Q5', 'GRID_RM/LOOP_RM' FROM v UNION ALL
  SELECT DISTINCT study_id, 'SAT:' || f, 'GRID_ESCALA' FROM v UNION ALL
  SELECT DISTINCT study_id, 'GASTO:' || f, 'LOOP_NUMERICO' FROM v UNION ALL
  SELECT DISTINCT study_id, 'P_' || f, 'Abierta' FROM v UNION ALL
  SELECT DISTINCT study_id, 'QTY:' || l, '' FROM v),
rows_ AS (SELECT study_id, split_part(question_id, ':', 1) AS question_id, s FROM c
  UNION ALL SELECT study_id, parent, structure FROM g WHERE structure <> 'Abierta')
SELECT study_id, CASE WHEN s = '' THEN '' ELSE question_id END AS question_id, s AS grid_structure,
  CAST(count(*) AS BIGINT) AS n FROM rows_ GROUP BY ALL""")
def c5_enriched(spark: SparkSession, path: str) -> DataFrame:
    cells, labels, book = detection_inputs(spark, path)
    evidence = dt.variable_evidence(cells, labels, book)
    rich = dt.enrich_codebook(book, evidence, dt.classify_groups(evidence))
    return rich.groupBy("study_id", "question_id", "grid_structure").agg(F.count("*").alias("n"))


@register("c6_grid_issues", f"""
WITH {STRUCTURES_SQL}
SELECT DISTINCT study_id, 'A_' || f AS parent, 'Crítico' AS level, true AS blocks FROM d UNION ALL
SELECT DISTINCT study_id, 'O_' || f, 'Advertencia', false FROM d""")
def c6_grid_issues(spark: SparkSession, path: str) -> DataFrame:
    """Grid A_x claims text children, O_x has a selectable child and an open field."""
    cells = detection_cells(spark, path)
    names = cells.select("study_id", "variable").distinct()
    tail = F.regexp_extract("variable", "^P_(.)_otro$", 1)
    flag = F.regexp_extract("variable", "^BR_(.)_1$", 1)
    rows = [
        names.filter(tail != "").select("study_id", "variable", F.concat(F.lit("A_"), tail)
                                        .alias("grid_id"), F.lit(False).alias("is_attached_open")),
        names.filter(flag != "").select("study_id", "variable", F.concat(F.lit("O_"), flag)
                                        .alias("grid_id"), F.lit(False).alias("is_attached_open")),
        names.filter(tail != "").select("study_id", "variable", F.concat(F.lit("O_"), tail)
                                        .alias("grid_id"), F.lit(True).alias("is_attached_open")),
    ]
    book = rows[0].unionByName(rows[1]).unionByName(rows[2]).withColumns({
        "question_type": F.lit("GRID_RM"), "grid_structure": F.lit(""), "is_grid": F.lit(True),
        "is_grid_item": F.lit(True), "is_grid_rm_loop": F.lit(True),
        "parent_question": F.lit(""), "question_id": F.lit("")})
    return dt.grid_issues(book, cells).select("study_id", "parent", "level", "blocks")


# A wide customer file: id, weight, numbered options, rows of a grid, a labelled choice.
def customer_cells(spark: SparkSession, path: str) -> DataFrame:
    wide = r.customers(spark, path).select(
        "study_id", "respondent_id", F.col("person_id").alias("customer id"),
        F.col("factor").alias("peso_final"), F.col("nation").alias("Q1_1"),
        F.col("wave").alias("Q1_2"), F.col("nation").alias("G2_r1"), F.col("wave").alias("G2_r2"),
        F.col("segment").alias("segment"), F.col("balance").alias("saldo"),
        F.when(F.col("wave") == 9, "x").alias("vacia"))
    names = [c for c in wide.columns if c not in ("study_id", "respondent_id")]
    return s.unpivot_cells(wide, ["study_id", "respondent_id"], names)


CUSTOMER_CELLS_SQL = f"""{r.CUSTOMERS_SQL},
cells AS (SELECT study_id, unnest([
    {{'v': 'customer id', 'x': CAST(person_id AS VARCHAR)}}, {{'v': 'peso_final', 'x': CAST(factor AS VARCHAR)}},
    {{'v': 'Q1_1', 'x': CAST(nation AS VARCHAR)}}, {{'v': 'Q1_2', 'x': CAST(wave AS VARCHAR)}},
    {{'v': 'G2_r1', 'x': CAST(nation AS VARCHAR)}}, {{'v': 'G2_r2', 'x': CAST(wave AS VARCHAR)}},
    {{'v': 'segment', 'x': segment}}, {{'v': 'saldo', 'x': CAST(balance AS VARCHAR)}},
    {{'v': 'vacia', 'x': NULL}}]) AS c FROM customers)"""


@register("a8_variables", f"""
WITH {CUSTOMER_CELLS_SQL}
SELECT study_id, c.v AS variable, CAST(count(c.x) AS BIGINT) AS n_valid,
  CAST(count(*) - count(c.x) AS BIGINT) AS n_missing, CAST(count(DISTINCT c.x) AS BIGINT) AS n_distinct,
  coalesce(round(min(TRY_CAST(c.x AS DOUBLE)), 6), -999999) AS min,
  coalesce(round(max(TRY_CAST(c.x AS DOUBLE)), 6), -999999) AS max,
  CASE WHEN count(c.x) > 0 AND count(TRY_CAST(c.x AS DOUBLE)) = count(c.x) THEN 'numeric' ELSE 'text' END AS kind
FROM cells GROUP BY ALL""")
def a8_variables(spark: SparkSession, path: str) -> DataFrame:
    profile = pf.variable_profile(customer_cells(spark, path))
    return profile.select(
        "study_id", "variable", big("n_valid"), big("n_missing"), big("n_distinct"),
        *[F.coalesce(F.round(c, 6), F.lit(-999999.0)).alias(c) for c in ("min", "max")], "kind")


@register("f4_safety", f"""
WITH {CUSTOMER_CELLS_SQL},
k AS (SELECT study_id, c.v AS variable, count(c.x) AS n, count(DISTINCT c.x) AS d FROM cells GROUP BY ALL)
SELECT study_id, variable, CASE WHEN n = 0 THEN 'Sin datos válidos' WHEN d <= 1 THEN 'Sin variación'
  WHEN variable = 'customer id' THEN 'Variable tipo ID/folio' WHEN d > 50 THEN 'Alta cardinalidad'
  ELSE '' END AS reason FROM k UNION ALL
SELECT DISTINCT study_id, 'no_esta', 'Variable inexistente en la base SPSS' FROM k""")
def f4_safety(spark: SparkSession, path: str) -> DataFrame:
    cells = customer_cells(spark, path)
    studies = r.table(spark, path, "region").select(F.col("r_name").alias("study_id"))
    names = ["customer id", "peso_final", "Q1_1", "Q1_2", "G2_r1", "G2_r2", "segment", "saldo",
             "vacia", "no_esta"]
    candidates = studies.select("study_id", F.explode(F.array(*[F.lit(n) for n in names]))
                                .alias("variable"))
    return pf.variable_safety(cells, candidates)


@register("f2_choices", f"""
WITH {r.CUSTOMERS_SQL}, d AS (SELECT DISTINCT study_id, wave FROM customers)
SELECT study_id, CASE wave WHEN 0 THEN '0 | Inicial' WHEN 1 THEN '1 | Media' WHEN 2 THEN '2'
  ELSE 'Sin dato' END AS display, CAST(row_number() OVER (
    PARTITION BY study_id ORDER BY wave IS NULL, wave) AS BIGINT) AS choice_pos FROM d""")
def f2_choices(spark: SparkSession, path: str) -> DataFrame:
    cells = s.unpivot_cells(r.customers(spark, path), ["study_id"], ["wave"])
    return pf.filter_choices(cells, r.wave_labels(spark, path)).select(
        "study_id", "display", big("choice_pos"))


PROFILE_DOMAIN = """c7 AS (
  SELECT study_id, c.v AS variable, count(DISTINCT c.x) AS d, count(*) AS n FROM cells GROUP BY ALL)"""


def customer_profile(spark: SparkSession, path: str) -> DataFrame:
    people = r.customers(spark, path)
    n_rows = people.groupBy("study_id").agg(F.count("*").alias("n_rows"))
    kinds = {"customer id": "INTEGER", "peso_final": "NUMBER", "Q1_1": "INTEGER",
             "Q1_2": "INTEGER", "G2_r1": "INTEGER", "G2_r2": "INTEGER", "segment": "STRING",
             "saldo": "NUMBER", "vacia": "STRING"}
    items = F.array(*[F.struct(F.lit(v).alias("variable"),
                               F.lit("Saldo de la cuenta" if v == "saldo" else "").alias("label"),
                               F.lit(k).alias("data_type")) for v, k in kinds.items()])
    variables = n_rows.select("study_id", F.inline(items))
    labels = variables.filter("variable IN ('segment', 'G2_r1', 'G2_r2')").select(
        "study_id", "variable", F.lit("1").alias("code"), F.lit("Uno").alias("label"),
        F.lit(1).alias("ord"))
    return dt.source_profile(customer_cells(spark, path), labels, variables, n_rows)


@register("c7_profile", f"""
WITH {CUSTOMER_CELLS_SQL}, {PROFILE_DOMAIN}
SELECT study_id, variable, CAST(d AS BIGINT) AS n_distinct, round(d / n, 6) AS uniqueness,
  CASE variable WHEN 'customer id' THEN 'ID_CANDIDATE' WHEN 'peso_final' THEN 'WEIGHT_CANDIDATE'
    WHEN 'Q1_1' THEN 'RM_MEMBER_CANDIDATE' WHEN 'Q1_2' THEN 'RM_MEMBER_CANDIDATE'
    WHEN 'G2_r1' THEN 'GRID_ROW_CANDIDATE' WHEN 'G2_r2' THEN 'GRID_ROW_CANDIDATE'
    WHEN 'segment' THEN 'RU_CANDIDATE' ELSE 'UNCLASSIFIED' END AS candidate_role FROM c7""")
def c7_profile(spark: SparkSession, path: str) -> DataFrame:
    return customer_profile(spark, path).select(
        "study_id", "variable", big("n_distinct"), r6("uniqueness"), "candidate_role")


@register("c8_proposals", f"""
WITH {CUSTOMER_CELLS_SQL}, s AS (SELECT DISTINCT study_id FROM cells)
SELECT study_id, i.id AS item_id, i.t AS proposed_type, i.c AS confidence, 'PENDING' AS review_state FROM (
  SELECT study_id, unnest([{{'id': 'RM::Q1', 't': 'RM', 'c': 'MEDIUM'}},
    {{'id': 'GRID::G2', 't': 'GRID_ESCALA', 'c': 'MEDIUM'}},
    {{'id': 'VAR::customer id', 't': 'RESPONDENT_ID', 'c': 'HIGH'}},
    {{'id': 'VAR::peso_final', 't': 'WEIGHT', 'c': 'MEDIUM'}},
    {{'id': 'VAR::segment', 't': 'RU', 'c': 'MEDIUM'}}, {{'id': 'VAR::saldo', 't': 'NUMERIC', 'c': 'MEDIUM'}},
    {{'id': 'VAR::vacia', 't': 'UNCLASSIFIED', 'c': 'LOW'}}]) AS i FROM s)""")
def c8_proposals(spark: SparkSession, path: str) -> DataFrame:
    return dt.propose_structures(customer_profile(spark, path)).select(
        "study_id", "item_id", "proposed_type", "confidence", "review_state")


@register("c9_domain", f"""
WITH {r.EVALUATIONS_SQL},
d AS (SELECT DISTINCT study_id, split_part(o_orderpriority, '-', 1) AS code, substr(o_orderpriority, 3) AS label
      FROM evaluations)
SELECT study_id, 'PRI_CAT_' || upper(substr(sha256(code), 1, 12)) AS category_id, code, label,
  CAST(row_number() OVER (PARTITION BY study_id ORDER BY code) AS BIGINT) AS ord FROM d""")
def c9_domain(spark: SparkSession, path: str) -> DataFrame:
    """Every segment of a study shares the priority domain."""
    parts = F.split("o_orderpriority", "-", 2)
    labels = r.evaluations(spark, path).select(
        "study_id", F.concat(F.lit("p_"), "segment").alias("variable"), parts[0].alias("code"),
        parts[1].alias("label")).distinct()
    members = labels.select("study_id", F.lit("PRI").alias("question_id"), "variable").distinct()
    categories, _ = dt.category_domain(labels, members)
    return categories.select("study_id", "category_id", "code", "label", big("ord"))


@register("o5_signature", """
WITH v AS (SELECT DISTINCT l_returnflag AS f, CASE WHEN l_quantity = floor(l_quantity)
    THEN CAST(CAST(l_quantity AS INT) AS VARCHAR) ELSE CAST(l_quantity AS VARCHAR) END AS x FROM lineitem),
k AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY x) AS rn FROM v)
SELECT f AS variable, string_agg(x, ', ' ORDER BY x) AS observed_signature FROM k WHERE rn <= 12 GROUP BY ALL""")
def o5_signature(spark: SparkSession, path: str) -> DataFrame:
    cells = s.typed_cells(r.table(spark, path, "lineitem").select(
        F.lit("all").alias("study_id"), F.col("l_returnflag").alias("variable"),
        F.col("l_quantity").cast("string").alias("value")))
    return dt.observed_signature(cells).select("variable", "observed_signature")


# --- value profiles ---------------------------------------------------------

@register("a7_profile", f"""
WITH {r.CUSTOMERS_SQL},
o AS (SELECT study_id, wave, count(*) AS n FROM customers GROUP BY ALL),
codes AS (SELECT DISTINCT c.study_id, l.code, l.label FROM customers c
  CROSS JOIN (VALUES (0, 'Inicial'), (1, 'Media'), (7, 'Séptima')) l(code, label)),
j AS (SELECT coalesce(o.study_id, codes.study_id) AS study_id,
    coalesce(CAST(coalesce(o.wave, codes.code) AS VARCHAR), '(vacío)') AS code,
    o.wave IS NULL AND o.study_id IS NOT NULL AS sys, codes.label, coalesce(n, 0) AS n
  FROM o FULL JOIN codes ON o.study_id = codes.study_id AND o.wave = codes.code),
k AS (SELECT *, code = '1' AS defined FROM j)
SELECT study_id, code, CASE WHEN sys THEN '(Sin respuesta)' WHEN label IS NULL THEN '(Sin etiqueta)'
    ELSE label END AS label, CAST(n AS BIGINT) AS n,
  coalesce(round(CASE WHEN NOT sys AND NOT defined THEN n / sum(CASE WHEN sys OR defined THEN 0 ELSE n END)
    OVER (PARTITION BY study_id) * 100 END, 6), -1) AS valid_pct,
  CASE WHEN sys THEN 'Perdido del sistema' WHEN defined THEN 'Perdido definido'
    WHEN label IS NULL THEN 'Sin Value Label' WHEN n = 0 THEN 'Sin casos' ELSE '' END AS status
FROM k""")
def a7_profile(spark: SparkSession, path: str) -> DataFrame:
    cells = s.unpivot_cells(r.customers(spark, path), ["study_id"], ["wave"])
    return frequency_table(spark, path, cells).select(
        "study_id", "code", "label", big("n"),
        F.coalesce(F.round("valid_pct", 6), F.lit(-1.0)).alias("valid_pct"), "status")


def frequency_table(spark: SparkSession, path: str, cells: DataFrame) -> DataFrame:
    """Labels 0, 1 and 7; code 1 is a declared missing range 0.5 to 1.5; 2 has no label."""
    studies = r.table(spark, path, "region").select(F.col("r_name").alias("study_id"))
    rows = [("wave", "0", "Inicial", 1), ("wave", "1", "Media", 2), ("wave", "7", "Séptima", 3)]
    labels = studies.select("study_id", F.inline(F.array(*[
        F.struct(F.lit(v).alias("variable"), F.lit(c).alias("code"), F.lit(t).alias("label"),
                 F.lit(i).alias("ord")) for v, c, t, i in rows])))
    rules = studies.select("study_id", F.lit("wave").alias("variable"),
                           F.lit(None).cast("string").alias("code"), F.lit(0.5).alias("low"),
                           F.lit(1.5).alias("high"))
    return pf.frequency_profile(cells, labels, rules)


@register("a7_totals", f"""
WITH {r.CUSTOMERS_SQL}
SELECT study_id, CAST(count(*) AS BIGINT) AS total,
  CAST(count(*) FILTER (WHERE wave IN (0, 2)) AS BIGINT) AS valid,
  CAST(count(*) FILTER (WHERE wave IS NULL OR wave = 1) AS BIGINT) AS missing,
  CAST(2 AS BIGINT) AS observed_categories, CAST(1 AS BIGINT) AS unlabeled_codes,
  CAST(count(*) FILTER (WHERE wave = 2) AS BIGINT) AS unlabeled_observations,
  CAST(1 AS BIGINT) AS zero_frequency_labels
FROM customers GROUP BY ALL""")
def a7_totals(spark: SparkSession, path: str) -> DataFrame:
    cells = s.unpivot_cells(r.customers(spark, path), ["study_id"], ["wave"])
    totals = pf.profile_totals(frequency_table(spark, path, cells))
    return totals.select("study_id", *[big(c) for c in totals.columns
                                       if c not in ("study_id", "variable")])


@register("a9_base_text", f"""
WITH {r.EVALUATIONS_SQL},
c AS (SELECT study_id, wave, count(*) AS n FROM evaluations GROUP BY ALL)
SELECT study_id, string_agg(CASE wave WHEN 0 THEN 'Inicial' WHEN 1 THEN 'Media'
    WHEN 2 THEN '2' ELSE 'Sin respuesta' END || ' n=' || format('{{:,}}', n), '; '
    ORDER BY wave NULLS LAST) AS base_distribution FROM c GROUP BY ALL""")
def a9_base_text(spark: SparkSession, path: str) -> DataFrame:
    cells = s.unpivot_cells(r.evaluations(spark, path), ["study_id"], ["wave"])
    return pf.base_distribution(cells, r.wave_labels(spark, path)).select(
        "study_id", "base_distribution")


@register("a9_parse_text", f"""
WITH {r.EVALUATIONS_SQL},
c AS (SELECT study_id, count(*) FILTER (WHERE wave = 1) AS n1, count(*) FILTER (WHERE wave = 5) AS n5
      FROM evaluations GROUP BY ALL)
SELECT study_id, 'Media n=' || format('{{:,}}', n1) || '; Código 5 n=' || format('{{:,}}', n5) AS base_distribution
FROM c""")
def a9_parse_text(spark: SparkSession, path: str) -> DataFrame:
    old = r.evaluations(spark, path).groupBy("study_id").agg(
        F.concat(F.lit("1: "), F.format_number(F.count_if(F.col("wave") == 1), 0), F.lit("; 5: "),
                 F.count_if(F.col("wave") == 5).cast("string")).alias("base_distribution")
    ).withColumn("variable", F.lit("wave"))
    return pf.parse_distribution(old, r.wave_labels(spark, path)).select("study_id", "base_distribution")


@register("j6_identity", f"""
WITH {r.EVALUATIONS_SQL}, {r.PRIORITY_SQL}
SELECT DISTINCT study_id, 'Total' AS banner, response, code, '' AS banner_variable,
  '' AS banner_raw_value FROM priority UNION ALL
SELECT DISTINCT study_id, segment, response, code, 'segment', segment FROM priority""")
def j6_identity(spark: SparkSession, path: str) -> DataFrame:
    evaluation = r.evaluations(spark, path)
    people = with_banner_cells(evaluation, "segment")
    return identity_rows(r.priority_facts(evaluation), people, ["segment"]).select(
        "study_id", "banner", "response", "code", "banner_variable", "banner_raw_value")


@register("p13_base_text", f"""
WITH {r.EVALUATIONS_SQL},
c AS (SELECT study_id, wave, count(*) AS n FROM evaluations GROUP BY ALL),
w AS (SELECT study_id, string_agg(CASE wave WHEN 0 THEN 'Inicial' WHEN 1 THEN 'Media'
    WHEN 2 THEN '2' ELSE 'Sin respuesta' END || ' n=' || format('{{:,}}', n), '; ' ORDER BY wave NULLS LAST) AS d FROM c GROUP BY ALL)
SELECT study_id, 'wave' AS variable, d AS base_distribution,
  'Ola se recomienda como banner porque permite comparar segmentos relevantes de forma clara y accionable.' AS justification FROM w
UNION ALL SELECT study_id, 'amount', 'Código 3 n=1,200', 'Bueno para comparar' FROM w
UNION ALL SELECT study_id, 'gone', 'Código 1 n=20; Código 2 n=30', 'Sin archivo' FROM w
UNION ALL SELECT study_id, 'factor', 'queda igual', '1: 20; 2: 30' FROM w""")
def p13_base_text(spark: SparkSession, path: str) -> DataFrame:
    """Fresh counts for a variable fit for breakdowns, rewritten texts for one that is not or is gone."""
    evaluation = r.evaluations(spark, path)
    cells = s.unpivot_cells(evaluation, ["study_id"], ["wave", "amount"])
    studies = r.studies(spark, path)
    rows = [("wave", "banner_filtro", "Ola", "1: 20; 2: 30", "viejo"), ("amount", "banner_filtro", "", "Bueno para comparar", "3: 1200"),
            ("gone", "banner_filtro", "", "Sin archivo", "1: 20; 2: 30"), ("factor", "factor_score", "", "1: 20; 2: 30", "queda igual")]
    names = ("variable", "kind", "label", "justification", "base_distribution")
    advice = studies.select("study_id", F.inline(F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(names, row)]) for row in rows]))).withColumns({
        "is_banner_recommended": F.lit(True), "is_filter_recommended": F.lit(False), "use": F.lit(None).cast("string")})
    safety = pf.variable_safety(cells, advice.select("study_id", "variable"))
    found = pf.with_base_distribution(advice, cells, r.wave_labels(spark, path), safety)
    return found.select("study_id", "variable", "base_distribution", "justification")


@register("u4_missing_variables", f"""
WITH {SHEET_SQL},
file AS (SELECT 'st' || (p_partkey % 4) AS study_id, 'V' || p_partkey AS variable FROM part UNION
         SELECT 'st' || (s_suppkey % 4), 'S' || s_suppkey FROM supplier UNION ALL
         SELECT 'st' || (s_suppkey % 4), 'S' || s_suppkey FROM supplier)
SELECT DISTINCT study_id, variable, 'Sin clasificar' AS question_type, 'Frecuencia' AS calculation
FROM file WHERE variable NOT IN (SELECT variable FROM sheet)
UNION ALL SELECT study_id, '(listed)', CAST(count(*) AS VARCHAR), '' FROM sheet GROUP BY study_id""")
def u4_missing_variables(spark: SparkSession, path: str) -> DataFrame:
    """A file with the suppliers as further variables, twice, which the sheet of parts does not list."""
    def variables(name: str, key: str, letter: str) -> DataFrame:
        return r.table(spark, path, name).select(
            F.concat(F.lit("st"), (F.col(key) % 4).cast("string")).alias("study_id"),
            F.concat(F.lit(letter), F.col(key).cast("string")).alias("variable"))
    suppliers = variables("supplier", "s_suppkey", "S")
    file = variables("part", "p_partkey", "V").unionByName(suppliers).unionByName(suppliers)
    whole = cb.add_missing_variables(sheet(spark, path), file)
    new = F.col("variable").startswith("S")
    listed = whole.filter(~new).groupBy("study_id").agg(F.count("*").cast("string").alias("question_type")).select(
        "study_id", F.lit("(listed)").alias("variable"), "question_type", F.lit("").alias("calculation"))
    return whole.filter(new).select("study_id", "variable", "question_type", "calculation").unionByName(listed)


@register("p16_types", """
WITH x AS (SELECT event_id, lower(event_type) AS e, user_id % 9 AS k FROM events),
m AS (SELECT *, CASE k WHEN 0 THEN 'Grid RM' WHEN 1 THEN 'grid escala de ' WHEN 2 THEN 'loop ru ' WHEN 3 THEN 'Loop numérico '
    WHEN 4 THEN 'NPS de ' WHEN 5 THEN 'top2box ' WHEN 6 THEN 'Multiple ' ELSE '' END || e AS text FROM x)
SELECT k, CASE k WHEN 0 THEN 'GRID_RM/LOOP_RM' WHEN 1 THEN 'GRID_ESCALA' WHEN 2 THEN 'LOOP_RU' WHEN 3 THEN 'LOOP_NUMERICO'
    WHEN 4 THEN 'NPS' WHEN 5 THEN 'Escala' WHEN 6 THEN CASE e WHEN 'click' THEN 'Escala' ELSE 'RM' END ELSE
      CASE WHEN e = 'click' THEN 'Escala' WHEN e = 'view' THEN 'RM' WHEN e = 'error' THEN 'RM' WHEN e = 'signup' THEN 'RU'
           WHEN k = 7 THEN 'Abierta' ELSE 'Requiere validación' END END AS inferred_type, CAST(count(*) AS BIGINT) AS n
FROM m GROUP BY ALL""")
def p16_types(spark: SparkSession, path: str) -> DataFrame:
    """Types from texts, and for texts that say nothing from the tables with rows."""
    kind, event = F.col("user_id") % 9, F.lower("event_type")
    words = F.element_at(F.array(*[F.lit(x) for x in (
        "Grid RM", "grid escala de ", "loop ru ", "Loop numérico ", "NPS de ", "top2box ", "Multiple ", "", "")]), (kind + 1).cast("int"))
    is_event = lambda name: event == name
    inferred = cb.infer_type(F.concat(words, event), is_event("signup"), is_event("view"), is_event("click"),
                             (kind == 7) & is_event("purchase"), is_event("error"))
    return r.table(spark, path, "events").groupBy(kind.alias("k"), inferred.alias("inferred_type")).agg(F.count("*").alias("n"))


@register("j9_lookups", f"""
WITH {GRID_BOOK_SQL}, i AS (SELECT * FROM items WHERE grid_structure <> '' OR k = 4),
g AS (SELECT study_id, grid_id AS question_id, count(*) AS n_items, arg_min(grid_structure, position) AS grid_type FROM i GROUP BY ALL),
q AS (SELECT 'st' || (p_partkey % 4) AS study_id, p_brand AS question_id, min(p_name) AS first_label FROM part GROUP BY ALL),
x AS (SELECT 'st' || (p_partkey % 4) AS study_id, p_brand AS question_id, l_returnflag AS response, count(*) AS n
      FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
SELECT study_id, question_id, response, CAST(n AS BIGINT) AS n, first_label, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, grid_type
FROM x LEFT JOIN q USING (study_id, question_id) LEFT JOIN g USING (study_id, question_id)""")
def j9_lookups(spark: SparkSession, path: str) -> DataFrame:
    """Answers of brands with what the sheet and the grids say of them; some brands have no grid."""
    study = F.concat(F.lit("st"), (F.col("p_partkey") % 4).cast("string")).alias("study_id")
    parts = r.table(spark, path, "part").select("p_partkey", study, F.col("p_brand").alias("question_id"))
    cells = r.table(spark, path, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy(
        "study_id", "question_id", F.col("l_returnflag").alias("response")).agg(F.count("*").alias("n"))
    # Several rows for a question: the least label counts.
    labels = sheet(spark, path).select("study_id", "question_id", F.col("label").alias("first_label"))
    grids = cb.build_grids(cb.grid_items(grid_book(spark, path))).select(
        "study_id", F.col("grid_id").alias("question_id"), "n_items", "grid_type")
    return with_lookups(cells, labels, grids).fillna(0, ["n_items"])

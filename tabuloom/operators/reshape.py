"""Wide answers to long tables.

The common form is a frame of cells (study_id, respondent_id, variable, value,
code, number), one per respondent and variable.  The codebook is joined to it,
so one plan serves every study and variable.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tabuloom.constants import (
    EXCLUSIVE_OPTION_HINTS, ID_NAMES, NO_RESPONSE_TEXTS, SELECTED_WORDS,
)
from tabuloom.functions.checks import fails
from tabuloom.functions.scales import bottom2box, nps_group, top2box
from tabuloom.functions.text import (
    blank_to_null, clean_open_text, code_text, column_type, first_text, is_numeric_type, normalize_text,
    plain_normalize, suffix_code, to_number, truthy_of,
)

UNPIVOT_CHUNK = 500
# Classes whose variables are not tabulated.
HIDDEN_CLASSES = ("Variable técnica", "Control de calidad", "No usar en dashboard", "Abierta")
# Classes kept as respondent columns.
RESPONDENT_CLASSES = ("Banner", "Filtro", "Ponderador", "Derivada", "Cuota", "Control de calidad")


class ReshapeError(ValueError):
    """Source data that contradicts its codebook."""


def unpivot_cells(wide: DataFrame, ids: Sequence[str], variables: Sequence[str],
                  chunk: int = UNPIVOT_CHUNK) -> DataFrame:
    """One row per (ids, variable), missing cells included.

    Numbers keep their type until they are written out, so only texts are
    matched with patterns.  One projection of several thousand columns exceeds
    the size of generated methods and falls back to interpretation; so a wider
    file is read once for each `chunk` columns, of which the parts are disjoint.
    """
    def part(names: Sequence[str]) -> DataFrame:
        # An inlined array, not unpivot(): code generation of the latter fails
        # when an expression over its output is shared.
        items = []
        for name in names:
            col, dtype = F.col(f"`{name}`"), column_type(wide, name)
            if isinstance(dtype, (T.DoubleType, T.FloatType)):
                col = F.when(~F.isnan(col), col)
            typed = is_numeric_type(dtype)
            items.append(F.struct(
                F.lit(name).alias("variable"), col.cast("string").alias("value"),
                F.lit(typed).alias("typed"),
                (to_number(col, dtype) if typed else F.lit(None).cast("double")).alias("number"),
                (code_text(col, dtype) if typed else F.lit(None).cast("string")).alias("code")))
        return wide.select(*ids, F.inline(F.array(*items)))

    parts = [part(variables[i:i + chunk]) for i in range(0, len(variables), chunk)]
    cells, text = reduce(DataFrame.unionByName, parts), F.col("value")
    return cells.withColumns({
        "number": F.when(F.col("typed"), F.col("number")).otherwise(to_number(text)),
        "code": F.when(F.col("typed"), F.col("code")).otherwise(code_text(text)),
    }).drop("typed")


def typed_cells(cells: DataFrame) -> DataFrame:
    """Add the code text and the number of cells that are texts."""
    return cells.withColumns({
        "number": to_number(F.col("value")), "code": code_text(F.col("value")),
    })


def kind_text(*cols: str) -> Column:
    return normalize_text(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in cols]))


def is_multi(codebook: DataFrame) -> Column:
    hidden = F.coalesce(F.col("analytic_class") == "Abierta", F.lit(False))
    if "is_attached_open" in codebook.columns:
        hidden = hidden | truthy_of(codebook, "is_attached_open")
    return ~hidden & kind_text("question_type", "calculation").rlike("rm|multiple|multirrespuesta")


def is_scale() -> Column:
    return kind_text("question_type", "calculation").rlike(
        "escala|grid|media|top2box|bottom2box|nps"
    )


def is_nps() -> Column:
    return kind_text("question_type", "calculation").contains("nps")


def is_open() -> Column:
    return kind_text("analytic_class", "calculation").rlike("abierta|texto_abierto")


def is_grid_item(codebook: DataFrame) -> Column:
    flagged = truthy_of(codebook, "is_grid_rm_loop")
    named = kind_text("question_type", "grid_structure").rlike("grid_rm|loop_rm")
    return (flagged | named) & ~truthy_of(codebook, "is_attached_open") & (
        F.trim("variable") != ""
    )


def in_dashboard(codebook: DataFrame) -> Column:
    return truthy_of(codebook, "in_dashboard")


def question_of() -> Column:
    return first_text(F.col("question_id"), F.col("variable"))


# --- D1 ---------------------------------------------------------------------

def find_id_column(columns: Sequence[str]) -> str | None:
    """First name equal to a candidate, else the first that contains one."""
    normalized = {plain_normalize(c): c for c in columns}
    for name in ID_NAMES:
        if name in normalized:
            return normalized[name]
    return next(
        (c for norm, c in normalized.items() if any(name in norm for name in ID_NAMES)), None
    )


def invalid_id(col: Column) -> Column:
    """NULL, blank and the texts a missing identifier turns into."""
    return F.coalesce(F.lower(F.trim(col.cast("string"))).isin("", "nan", "none", "null"),
                      F.lit(True))


def id_check(wide: DataFrame, id_column: str) -> DataFrame:
    """Rows, distinct values and blanks of an identifier (Q6).

    The distinct count is a two-step group, so it is not held in one place.
    """
    value = F.trim(F.col(id_column).cast("string"))
    counts = wide.groupBy("study_id", value.alias("id")).agg(F.count("*").alias("n"))
    return counts.groupBy("study_id").agg(
        F.sum("n").alias("n_rows"),
        F.count_if(~invalid_id(F.col("id"))).alias("n_distinct"),
        F.sum(F.when(invalid_id(F.col("id")), F.col("n")).otherwise(0)).alias("n_blank"),
        F.count_if((F.col("n") > 1) & ~invalid_id(F.col("id"))).alias("n_repeated"),
    ).withColumn("is_key", (F.col("n_blank") == 0) & (F.col("n_repeated") == 0))


def build_respondents(wide: DataFrame, role_columns: Sequence[str], id_column: str | None = None,
                      declared_ids: Sequence[str] = ()) -> DataFrame:
    """Row key, evaluation key and person key per row.

    `wide` carries `row_index`, the row's position in its file.  The row key is
    the identifier where it is complete and unique in its study, else
    R000001 and so on by position.
    """
    declared = list(dict.fromkeys(d.strip() for d in declared_ids if d and d.strip()))
    if len(declared) > 1:
        raise ReshapeError("more than one person identifier is declared")
    source = declared[0] if declared else id_column
    if source is None:
        source = find_id_column([c for c in wide.columns if c not in ("study_id", "row_index")])
    ordinal = F.concat(F.lit("R"), F.lpad((F.col("row_index") + 1).cast("string"), 6, "0"))
    ordinal = F.when(F.col("row_index") >= 999_999, F.concat(
        F.lit("R"), (F.col("row_index") + 1).cast("string"))).otherwise(ordinal)
    roles = [c for c in role_columns if c in wide.columns]
    if source is None:
        return wide.select(
            "study_id", ordinal.alias("respondent_id"), "row_index",
            (F.col("row_index") + 1).cast("string").alias("original_id"),
            ordinal.alias("evaluation_id"), ordinal.alias("person_id"), *roles,
        )
    if source not in wide.columns:
        raise ReshapeError(f"the person identifier does not exist: {source}")
    check = id_check(wide, source)
    value = F.trim(F.col(source).cast("string"))
    joined = wide.join(check.select("study_id", "is_key", "n_blank"), "study_id")
    key = F.when(F.col("is_key"), value).otherwise(ordinal)
    if declared:
        joined = joined.filter(F.when(F.col("n_blank") > 0, fails(
            f"the person identifier has blank values: {source}")).otherwise(True))
    return joined.select(
        "study_id", key.alias("respondent_id"), "row_index",
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("original_id"),
        key.alias("evaluation_id"),
        F.when(F.col("n_blank") == 0, value).otherwise(key).alias("person_id"), *roles,
    )


def role_variables(codebook: DataFrame, safety: DataFrame) -> DataFrame:
    """(study_id, variable) of the attributes that respondents carry.

    A variable needs a class of respondents or a role, and unless it is a weight it
    must be fit for breakdowns and filters: `safety` is what F4 says of it.
    """
    role = F.lit(False)
    for flag in ("is_banner", "is_filter", "is_weight"):
        if flag in codebook.columns:
            role = role | F.coalesce(F.col(flag).cast("boolean"), F.lit(False))
    weight = F.coalesce(F.col("is_weight").cast("boolean"), F.lit(False)) if "is_weight" in codebook.columns else F.lit(False)
    named = F.coalesce(F.col("analytic_class").isin(*RESPONDENT_CLASSES), F.lit(False)) | role
    wanted = codebook.filter(named).groupBy("study_id", "variable").agg(F.bool_or(weight).alias("weight"))
    reasons = safety.select("study_id", "variable", "reason")
    return wanted.join(reasons, ["study_id", "variable"], "left").filter(
        F.col("weight") | (F.col("reason") == "")).select("study_id", "variable")


def with_attributes(people: DataFrame, wide: DataFrame, names: Sequence[str], codebook: DataFrame,
                    safety: DataFrame) -> DataFrame:
    """Respondents with a map of the attributes that their own study's codebook and data allow.

    Studies share one plan and columns cannot depend on data, so a study's choice
    is which of the file's columns `names` its map holds; its values are texts.
    """
    allowed = role_variables(codebook, safety).groupBy("study_id").agg(F.collect_set("variable").alias("__allowed"))
    every = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(f"`{n}`").cast("string") for n in names]))
    values = wide.select("study_id", "row_index", every.alias("__every"))
    joined = people.join(values, ["study_id", "row_index"]).join(allowed, "study_id", "left")
    kept = F.map_filter("__every", lambda k, v: F.array_contains(F.coalesce("__allowed", F.array().cast("array<string>")), k))
    return joined.select(*people.columns, kept.alias("attributes"))


# --- D2 ---------------------------------------------------------------------

def _labels(labels: DataFrame) -> DataFrame:
    """First label per (study, variable, code)."""
    code = code_text(F.col("code"), column_type(labels, "code"))
    return labels.groupBy("study_id", "variable", code.alias("code")).agg(
        F.min(F.struct("ord", "label")).getField("label").alias("label_text")
    )


def build_single_choice(cells: DataFrame, codebook: DataFrame, labels: DataFrame) -> DataFrame:
    """Answered cells of single-choice variables with their label."""
    reportable = (F.trim(F.coalesce("question_type", F.lit(""))) != "") | (
        F.col("analytic_class") == "Pregunta analizable"
    )
    shown = ~F.coalesce(F.col("analytic_class"), F.lit("")).isin(*HIDDEN_CLASSES)
    variables = codebook.filter(
        in_dashboard(codebook) & reportable & shown & ~is_multi(codebook) & ~is_scale() & ~is_open()
    ).select("study_id", "variable", question_of().alias("question_id"), "question_type")
    answered = cells.filter(F.col("value").isNotNull()).join(
        variables, ["study_id", "variable"]
    )
    labelled = answered.join(
        _labels(labels), ["study_id", "variable", "code"], "left"
    )
    return labelled.select(
        "study_id", "respondent_id", "question_id", "variable", "question_type", "code",
        F.coalesce(blank_to_null(F.col("label_text")), F.col("value")).alias("response"),
        F.col("number").alias("value"),
        F.when(F.col("number").isNull(), F.col("value")).otherwise("").alias("text"),
        F.lit(True).alias("base_valid"),
    )


# --- D3 to D6 ---------------------------------------------------------------

def _coded_layout() -> Column:
    declared = normalize_text(F.col("format_rm"))
    return F.when(declared != "", declared.isin("codigo_por_opcion", "code_per_option")).otherwise(
        normalize_text(F.col("row_axis_type")) == "opcion_rm"
    )


def multi_response_encodings(cells: DataFrame, codebook: DataFrame, labels: DataFrame) -> DataFrame:
    """How each multiple-response variable encodes a selection (D3).

    In order: code per option (declared), mentions (declared), a single value
    label, 0/1, mentions.  One small aggregate per variable.
    """
    items = codebook.filter(is_multi(codebook) & in_dashboard(codebook))
    keys = ["study_id", "variable"]
    answered = cells.filter(F.trim("value") != "").join(
        items.select(*keys), keys, "left_semi"
    )
    nonzero = F.when(F.col("number") != 0, F.col("number"))
    seen = answered.groupBy(*keys).agg(
        F.count("*").alias("n_answered"), F.count("number").alias("n_numbers"),
        F.coalesce(F.bool_and(F.col("number").isin(0, 1)), F.lit(False)).alias("binary"),
        F.min(nonzero).alias("lowest"), F.max(nonzero).alias("highest"),
    )
    label_stats = _labels(labels).groupBy(*keys).agg(
        F.count("*").alias("n_labels"), F.min("code").alias("only_code"),
        F.min("label_text").alias("only_label"),
    )
    joined = items.join(seen, keys, "left").join(label_stats, keys, "left")
    declared = normalize_text(F.col("format_rm"))
    encoding = (
        F.when(_coded_layout(), "codigo_por_opcion")
        .when(declared.isin("menciones", "mentions"), "menciones")
        .when(F.col("n_labels") == 1, "unitaria_por_opcion")
        .when(F.col("binary"), "dicotomica_por_opcion")
        .otherwise("menciones")
    )
    chosen = F.coalesce(
        to_number(F.col("option_code"), column_type(codebook, "option_code")),
        F.when(F.col("lowest") == F.col("highest"), F.col("lowest")),
    )
    result = joined.select(
        *keys, question_of().alias("question_id"), "position", "format_rm",
        encoding.alias("encoding"), F.coalesce("n_labels", F.lit(0)).alias("n_labels"),
        "n_answered", "n_numbers", "lowest", "highest", "only_code", "only_label",
        chosen.alias("selected_code"), blank_to_null(F.col("option_label")).alias("option_label"),
        first_text(F.col("label"), F.col("variable")).alias("variable_label"),
    )
    code_label = _labels(labels).select(
        *keys, F.col("code").alias("selected_text"), F.col("label_text").alias("code_label")
    )
    return result.withColumn("selected_text", code_text(F.col("selected_code"))).join(
        code_label, [*keys, "selected_text"], "left"
    ).withColumn("option_label", F.coalesce("option_label", "code_label")).drop(
        "selected_text", "code_label"
    )


def encoding_problems(encodings: DataFrame) -> DataFrame:
    """Code-per-option variables whose codes contradict the declaration."""
    code = F.col("selected_code")
    problem = (
        F.when(F.col("n_answered") > F.col("n_numbers"), "NON_NUMERIC_CODE")
        .when(code.isNull(), "NO_SINGLE_CODE")
        .when((code == 0) | (F.col("lowest") != code) | (F.col("highest") != code),
              "INCOMPATIBLE_CODES")
        .when(F.col("option_label").isNull(), "NO_LABEL")
    )
    return encodings.filter("encoding = 'codigo_por_opcion'").select(
        "study_id", "variable", problem.alias("problem")
    ).filter(F.col("problem").isNotNull())


def build_multi_response(cells: DataFrame, encodings: DataFrame, codebook: DataFrame,
                         labels: DataFrame) -> DataFrame:
    """One row per selected option, duplicates and exclusive conflicts removed.

    `encodings` has at most one row per codebook variable.
    """
    keys = ["study_id", "variable"]
    rows = cells.filter(F.trim("value") != "").join(
        encodings, keys
    ).join(
        _labels(labels), [*keys, "code"], "left"
    )
    number, encoding = F.col("number"), F.col("encoding")
    only_number = to_number(F.col("only_code"))
    single = F.when(
        number.isNotNull() & only_number.isNotNull(), (number == only_number) | (number == 1)
    ).otherwise(normalize_text(F.col("value")).isin(*SELECTED_WORDS))
    selected = (
        F.when(encoding == "codigo_por_opcion", number == F.col("selected_code"))
        .when(encoding == "unitaria_por_opcion", single)
        .when(encoding == "dicotomica_por_opcion", number == 1)
        .otherwise(True)
    )
    code = (
        F.when(encoding == "codigo_por_opcion", code_text(F.col("selected_code")))
        .when(encoding == "unitaria_por_opcion", F.col("only_code"))
        .when(encoding == "dicotomica_por_opcion", suffix_code(F.col("variable")))
        .otherwise(F.col("code"))
    )
    label = (
        F.when(encoding == "codigo_por_opcion", F.col("option_label"))
        .when(encoding == "unitaria_por_opcion", F.col("only_label"))
        .when(encoding == "dicotomica_por_opcion", F.col("variable_label"))
        .otherwise(F.coalesce("label_text", "value"))
    )
    format_rm = F.when((encoding == "menciones") & (F.col("n_labels") == 0),
                       "requiere_validacion").otherwise(encoding)
    mentions = rows.filter(F.coalesce(selected, F.lit(False))).select(
        "study_id", "respondent_id", "question_id", F.col("variable"), "position",
        code.alias("code"), label.alias("response"), format_rm.alias("format_rm"),
    )
    return remove_exclusive(deduplicate_mentions(mentions))


def deduplicate_mentions(mentions: DataFrame) -> DataFrame:
    """One row per (respondent, question, code): the first variable's row survives.

    A minimum by position combines on the map side, unlike a window.
    """
    keys = ["study_id", "respondent_id", "question_id", "code"]
    others = [c for c in mentions.columns if c not in (*keys, "position")]
    first = F.min(F.struct("position", *others)).alias("__first")
    return mentions.groupBy(*keys).agg(first).select(*keys, "__first.*")


def is_exclusive(label: Column, hints: Sequence[str] = EXCLUSIVE_OPTION_HINTS) -> Column:
    text = F.lower(F.coalesce(label, F.lit("")))
    return reduce(lambda a, b: a | b, [text.contains(h.lower()) for h in hints])


def remove_exclusive(mentions: DataFrame,
                     hints: Sequence[str] = EXCLUSIVE_OPTION_HINTS) -> DataFrame:
    """Drop exclusive options of respondents who also chose another one.

    Runs on deduplicated mentions, so a group has at most one row per option.
    """
    group = Window.partitionBy("study_id", "respondent_id", "question_id")
    marked = mentions.withColumn("__exclusive", is_exclusive(F.col("response"), hints))
    marked = marked.withColumn("__other", F.max(~F.col("__exclusive")).over(group))
    return marked.filter(~(F.col("__exclusive") & F.col("__other"))).drop("__exclusive", "__other")


def build_rm_bases(cells: DataFrame, codebook: DataFrame) -> DataFrame:
    """Respondents with any answer to a fully option-coded question."""
    items = codebook.filter(is_multi(codebook) & in_dashboard(codebook)).withColumn(
        "coded", _coded_layout()
    )
    whole = items.groupBy("study_id", "question_id").agg(F.bool_and("coded").alias("all_coded"))
    wanted = items.join(whole.filter("all_coded"), ["study_id", "question_id"]).select(
        "study_id", "variable", "question_id"
    )
    return cells.filter(F.trim("value") != "").join(
        wanted, ["study_id", "variable"]
    ).select("study_id", "question_id", "respondent_id").distinct()


# --- D7, D8, D12 ------------------------------------------------------------

def starts_with_digit(value: Column) -> Column:
    return F.substring(value, 1, 1).between("0", "9")


def grid_missing(value: Column) -> Column:
    """Codes, which start with a digit, skip the text clean-up."""
    blank = F.when(starts_with_digit(value), False).otherwise(
        normalize_text(value).isin("", "nan", "none", "null")
    )
    return value.isNull() | blank


def grid_selected(value: Column, code: Column) -> Column:
    """A yes-word, 1, or equal to the option code as number or text."""
    text, trimmed = F.trim(F.coalesce(code, F.lit(""))), F.trim(value)
    same = (trimmed == "1") | ((text != "") & (trimmed == text))
    number = to_number(value)
    as_number = F.coalesce(number == 1, F.lit(False)) | F.coalesce(
        number == to_number(code), F.lit(False))
    as_word = ~starts_with_digit(value) & normalize_text(value).isin(*SELECTED_WORDS)
    # Cheap tests first; the others only run when those say no.
    return F.coalesce(F.when(same, True).when(as_number, True).otherwise(as_word), F.lit(False))


def build_grid_long(cells: DataFrame, codebook: DataFrame, labels: DataFrame) -> DataFrame:
    """Every cell of grid and loop multiple response, missing ones too."""
    keys = ["study_id", "variable"]
    only = _labels(labels).groupBy(*keys).agg(
        F.when(F.count("*") == 1, F.min("code")).alias("only_code"),
        F.when(F.count("*") == 1, F.min("label_text")).alias("only_label"),
    )
    c = F.col
    items = codebook.filter(is_grid_item(codebook)).join(only, keys, "left").select(
        *keys,
        first_text(c("parent_question"), c("grid_id"), c("question_id"), c("variable"))
        .alias("question_id"),
        first_text(c("grid_id"), c("parent_question"), c("question_id")).alias("grid_id"),
        first_text(c("entity_label"), c("entity"), c("row_text")).alias("entity"),
        first_text(c("option_code"), c("only_code")).alias("option_code"),
        first_text(c("option_label"), c("only_label"), c("label"), c("variable")).alias("option"),
    )
    rows = cells.join(items, keys)
    selected = ~grid_missing(c("value")) & grid_selected(c("value"), c("option_code"))
    return structural_base(rows.withColumn("selected", selected.cast("int")).select(
        "study_id", "respondent_id", "question_id", "grid_id", "variable", "entity",
        "option_code", "option", "value", "selected",
    ))


def structural_base(grid: DataFrame) -> DataFrame:
    """A (respondent, entity) counts when any of its items has a value.

    The group holds the items of one entity, as many as the codebook lists.
    """
    group = Window.partitionBy("study_id", "respondent_id", "question_id", "grid_id", "entity")
    valid = F.max((~grid_missing(F.col("value"))).cast("int")).over(group)
    return grid.withColumn("base_valid", valid).withColumns({
        "structural_missing": 1 - F.col("base_valid"),
        "selected": F.when(F.col("base_valid") == 1, F.col("selected")).otherwise(0),
    })


def answered_cells(grid: DataFrame) -> DataFrame:
    """Each cell with whether it has a value, which is all that A3 needs.

    A selected cell has one, and a respondent is in the base when any cell has;
    so the rows of an entity need not meet.
    """
    return grid.withColumn("base_valid", (~grid_missing(F.col("value"))).cast("int"))


def grid_labels(entity: Column, option: Column, question: Column,
                *fallbacks: Column) -> dict[str, Column]:
    """Entity, option and `entity | option` label with their fallbacks."""
    def plain(col: Column) -> Column:
        text = F.trim(F.coalesce(col.cast("string"), F.lit("")))
        return F.when(text != "", text)

    shown_entity = F.coalesce(plain(entity), question.cast("string"))
    shown_option = F.coalesce(plain(option), *[plain(f) for f in fallbacks], F.lit(""))
    label = F.concat(shown_entity, F.lit(" | "), shown_option)
    return {"entity": shown_entity, "option": shown_option,
            "response": F.regexp_replace(label, r"^[ |]+|[ |]+$", "")}


# --- D9, D10, D13 -----------------------------------------------------------

def scale_bounds(codebook: DataFrame, labels: DataFrame) -> DataFrame:
    """Bounds per variable: declared, 0-10 for NPS, else consecutive labels.

    `bounds_problem` marks an incomplete or inverted declaration.  Observed
    extremes are never used.
    """
    keys = ["study_id", "variable"]
    number = to_number(F.col("code"), column_type(labels, "code"))
    from_labels = labels.groupBy(*keys).agg(
        F.min(number).alias("lowest"), F.max(number).alias("highest"),
        F.count("*").alias("n"), F.count(number).alias("n_numbers"),
        F.count_distinct(number).alias("n_codes"),
        # Consecutive codes share one fractional part.
        F.count_distinct(number - F.floor(number)).alias("n_fractions"),
    )
    low_text, high_text = (blank_to_null(F.col(c)) for c in ("scale_min", "scale_max"))
    low = to_number(F.col("scale_min"), column_type(codebook, "scale_min"))
    high = to_number(F.col("scale_max"), column_type(codebook, "scale_max"))
    declared = low_text.isNotNull() | high_text.isNotNull()
    broken = declared & ~F.coalesce(low < high, F.lit(False))
    consecutive = (
        (F.col("n") >= 2) & (F.col("n") == F.col("n_numbers")) & (F.col("n_fractions") == 1)
        & (F.col("highest") - F.col("lowest") + 1 == F.col("n_codes"))
    )
    joined = codebook.join(from_labels, keys, "left")

    def pick(stated: Column, nps: float, labelled: str) -> Column:
        return F.when(declared, F.when(~broken, stated)).when(is_nps(), nps).when(
            consecutive, F.col(labelled)
        )

    return joined.select(
        *keys, pick(low, 0.0, "lowest").alias("low"), pick(high, 10.0, "highest").alias("high"),
        broken.alias("bounds_problem"),
    )


def score_scale(rows: DataFrame, nps: Column) -> DataFrame:
    """Boxes and promoter groups; boxes stay NULL without bounds."""
    value, low, high = F.col("value"), F.col("scale_min"), F.col("scale_max")
    known = low.isNotNull()
    return rows.withColumns({
        "top2box": F.when(known, top2box(value, low, high)),
        "bottombox": F.when(known, bottom2box(value, low, high)),
        "nps_group": F.when(nps, nps_group(value)).otherwise(""),
    })


def build_scale_long(cells: DataFrame, codebook: DataFrame, labels: DataFrame) -> DataFrame:
    """Numeric answers of scale items with boxes and promoter group."""
    keys = ["study_id", "variable"]
    items = codebook.filter(is_scale() & in_dashboard(codebook))
    described = items.select(
        *keys, question_of().alias("question_id"), is_nps().alias("nps"),
        first_text(F.col("label"), F.col("question_text"), F.col("variable")).alias("item_text"),
    ).join(scale_bounds(items, labels), keys)
    rows = cells.filter(F.col("number").isNotNull()).join(
        described, keys
    ).join(_labels(labels), [*keys, "code"], "left")
    shaped = rows.select(
        "study_id", "respondent_id", "question_id", "variable", "item_text",
        F.col("number").alias("value"),
        F.coalesce(blank_to_null(F.col("label_text")), F.col("value")).alias("response"),
        F.col("low").alias("scale_min"), F.col("high").alias("scale_max"), "nps",
    )
    return score_scale(shaped, F.col("nps")).drop("nps")


def out_of_scale(scale: DataFrame) -> DataFrame:
    """Items with values outside their bounds; must be empty."""
    outside = (F.col("value") < F.col("scale_min")) | (F.col("value") > F.col("scale_max"))
    return scale.filter(outside).groupBy("study_id", "question_id", "variable").agg(
        F.count("*").alias("n_outside")
    )


def scale_fallback(single_choice: DataFrame, bounds: DataFrame) -> DataFrame:
    """Scale rows from single-choice rows of a scale question.

    `bounds` holds (study_id, question_id, scale_min, scale_max, nps).
    """
    rows = single_choice.filter(F.col("value").isNotNull()).join(
        bounds, ["study_id", "question_id"]
    )
    outside = ~F.col("value").between(F.col("scale_min"), F.col("scale_max"))
    inside = rows.filter(F.when(outside, fails(F.concat(
        F.lit("values outside the declared scale of question "), "question_id"))).otherwise(True))
    return score_scale(inside, F.col("nps")).drop("nps")


def scales_of(scales: DataFrame | None, single_choice: DataFrame | None, bounds: DataFrame | None) -> DataFrame | None:
    """Scale rows of a report: of questions with bounds but no such rows, their single-choice rows."""
    if bounds is None or single_choice is None:
        return scales
    keys = ["study_id", "question_id"]
    if "value" not in single_choice.columns:
        single_choice = single_choice.withColumn("value", F.col("code").try_cast("double"))
    lacking = bounds if scales is None else bounds.join(scales.select(*keys).distinct(), keys, "left_anti")
    columns = [*keys, "respondent_id", "value", "top2box", "bottombox", "nps_group"]
    found = scale_fallback(single_choice, lacking).select(*columns)
    return found if scales is None else scales.select(*columns).unionByName(found)


# --- D11 --------------------------------------------------------------------

def open_ended_text(texts: DataFrame, column: str = "value") -> DataFrame:
    """Clean open answers and drop the ones that say nothing."""
    original = clean_open_text(F.col(column))
    empty = sorted({plain_normalize(t) for t in NO_RESPONSE_TEXTS})
    return texts.filter(F.col(column).isNotNull()).withColumn("original_text", original).withColumn(
        "__norm", normalize_text(F.col("original_text"))
    ).filter(~F.col("__norm").isin(*empty)).withColumn(
        "clean_text", F.replace("__norm", F.lit("_"), F.lit(" "))
    ).drop("__norm")


def build_open_ended(cells: DataFrame, codebook: DataFrame) -> DataFrame:
    items = codebook.filter(is_open()).select(
        "study_id", "variable", question_of().alias("question_id")
    )
    rows = cells.join(items, ["study_id", "variable"])
    return open_ended_text(rows).select(
        "study_id", "respondent_id", "question_id", "variable", "original_text", "clean_text"
    )

"""Profiles of variables and values."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tabuloom.constants import COUNT_ENTRY, ID_NAMES, INVALID_TEXTS, MAX_FILTER_CATEGORIES, NO_DATA
from tabuloom.functions.text import code_text, column_type, normalize_text, to_number
from tabuloom.operators.breakdown import heading
from tabuloom.operators.codebook import DISTRIBUTION_PATTERN, first_text, justification
from tabuloom.operators.metrics import ratio
from tabuloom.operators.ordering import position
from tabuloom.operators.reshape import _labels

KEYS = ("study_id", "variable")


def value_counts(cells: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows per distinct value; NULL is a value."""
    return cells.groupBy(*keys, "value", "code", "number").agg(F.count("*").alias("n"))


# --- A7 ---------------------------------------------------------------------

def frequency_profile(cells: DataFrame, labels: DataFrame, missing_rules: DataFrame) -> DataFrame:
    """One row per labelled or observed code with count, valid % and status.

    `missing_rules` holds (study_id, variable, code, low, high): a single code or
    a closed range per row.  Labels without cases stay in the table.
    """
    keys = list(KEYS)
    # Values with the same code text are one code; NULL has its own key.
    observed = cells.groupBy(*keys, "code", F.col("value").isNull().alias("system")).agg(
        F.count("*").alias("n"), F.min("number").alias("number")
    )
    named = _labels(labels).withColumn("system", F.lit(False))
    joined = observed.join(named, [*keys, "code", "system"], "full_outer").withColumns({
        "n": F.coalesce("n", F.lit(0)),
        "number": F.coalesce("number", to_number(F.col("code"))),
        "has_label": F.coalesce(F.trim("label_text") != "", F.lit(False)),
    })
    rule_code = code_text(F.col("code"), column_type(missing_rules, "code"))
    single = missing_rules.filter(F.col("code").isNotNull()).select(
        *keys, rule_code.alias("code")).distinct().withColumn("by_code", F.lit(True))
    # Ranges of one variable are few: three at most in a survey file.
    ranges = missing_rules.filter(
        F.col("low").isNotNull() & F.col("high").isNotNull()
    ).groupBy(*keys).agg(F.collect_list(F.struct("low", "high")).alias("ranges"))
    ruled = joined.join(single, [*keys, "code"], "left").join(ranges, keys, "left")
    in_range = F.coalesce(
        F.exists("ranges", lambda r: F.col("number").between(r["low"], r["high"])), F.lit(False)
    )
    defined = ~F.col("system") & (F.coalesce("by_code", F.lit(False)) | in_range)
    lost = F.col("system") | defined
    # Statuses and stand-in labels.
    status = (
        F.when(F.col("system"), "Perdido del sistema").when(defined, "Perdido definido")
        .when(~F.col("has_label") & (F.col("n") > 0), "Sin Value Label")
        .when(F.col("n") == 0, "Sin casos").otherwise("")
    )
    label = F.coalesce("label_text", F.lit(""))
    shown = (
        F.when(F.col("system"), "(Sin respuesta)")
        .when(defined, F.when(label != "", label).otherwise("(Valor perdido)"))
        .when(~F.col("has_label") & (F.col("n") > 0), "(Sin etiqueta)").otherwise(label)
    )
    marked = ruled.withColumns({"status": status, "label": shown, "is_missing": lost})
    # Joined, not a window: a variable with very many codes is not one task.
    sums = marked.groupBy(*keys).agg(
        F.sum(F.when(~F.col("is_missing"), F.col("n")).otherwise(0)).alias("__valid"))
    valid = F.col("__valid")
    return marked.join(sums, list(keys)).select(
        *keys, F.when(F.col("system"), "(vacío)").otherwise(F.col("code")).alias("code"),
        "label", "n",
        F.when(~F.col("is_missing"), F.coalesce(ratio(F.col("n"), valid) * 100, F.lit(0.0)))
        .alias("valid_pct"),
        "status", "is_missing", "has_label",
    )


def profile_totals(profile: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The seven totals of a frequency profile."""
    seen, valid = F.col("n") > 0, ~F.col("is_missing")
    bare = seen & valid & ~F.col("has_label")
    return profile.groupBy(*keys).agg(
        F.sum("n").alias("total"),
        F.sum(F.when(valid, F.col("n")).otherwise(0)).alias("valid"),
        F.sum(F.when(valid, 0).otherwise(F.col("n"))).alias("missing"),
        F.count_if(seen & valid).alias("observed_categories"),
        F.count_if(bare).alias("unlabeled_codes"),
        F.sum(F.when(bare, F.col("n")).otherwise(0)).alias("unlabeled_observations"),
        F.count_if(~seen & F.col("has_label")).alias("zero_frequency_labels"),
    )


# --- A8, C7 -----------------------------------------------------------------

def variable_profile(cells: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Valid, missing, distinct, min, max and kind per variable.

    Distinct values are found by a two-step group, so an identifier column is
    spread over tasks by its values.
    """
    values = value_counts(cells, keys)
    present = F.col("value").isNotNull()
    stats = values.groupBy(*keys).agg(
        F.sum(F.when(present, F.col("n")).otherwise(0)).alias("n_valid"),
        F.sum(F.when(present, 0).otherwise(F.col("n"))).alias("n_missing"),
        F.count_if(present).alias("n_distinct"),
        F.sum(F.when(F.col("number").isNotNull(), F.col("n")).otherwise(0)).alias("n_numeric"),
        F.min("number").alias("min"), F.max("number").alias("max"),
    )
    numeric = (F.col("n_valid") > 0) & (F.col("n_numeric") == F.col("n_valid"))
    return stats.withColumn("kind", F.when(numeric, "numeric").otherwise("text")).withColumn(
        "uniqueness", ratio(F.col("n_distinct"), F.col("n_valid") + F.col("n_missing"))
    )


# --- A9 ---------------------------------------------------------------------

def base_distribution(cells: DataFrame, labels: DataFrame, numeric: Column | None = None,
                      keys: Sequence[str] = KEYS, safety: DataFrame | None = None) -> DataFrame:
    """`Label n=1,234; ...` per variable: numbers, texts, missing.

    Of variables that `safety` (F4) finds fit for breakdowns, which have few
    values; without it `cells` should hold no others.
    """
    if safety is not None:
        fit = safety.filter(F.col("reason") == "").select(*keys)
        cells = cells.join(fit, list(keys), "left_semi")
    is_number = F.col("number").isNotNull() if numeric is None else numeric
    counts = value_counts(cells, keys).join(_labels(labels), [*keys, "code"], "left")
    shown = (
        F.when(F.col("value").isNull(), "Sin respuesta")
        .when(F.trim(F.coalesce("label_text", F.lit(""))) != "", F.trim("label_text"))
        .when(is_number, F.concat(F.lit("Código "), F.col("code")))
        .otherwise(F.col("value"))
    )
    rank = F.when(F.col("value").isNull(), 2).when(F.col("number").isNotNull(), 0).otherwise(1)
    part = F.struct(
        rank.alias("rank"), F.coalesce("number", F.lit(0.0)).alias("number"),
        F.lower(F.coalesce("value", F.lit(""))).alias("text"),
        F.concat(shown, F.lit(" n="), F.format_number("n", 0)).alias("shown"),
    )
    return counts.groupBy(*keys).agg(F.array_join(
        F.transform(F.array_sort(F.collect_list(part)), lambda s: s["shown"]), "; "
    ).alias("base_distribution"))


def parse_distribution(texts: DataFrame, labels: DataFrame, column: str = "base_distribution"
                       ) -> DataFrame:
    """Rewrite old `code: count` texts with labels; other texts stay."""
    keys = list(KEYS)
    codes = F.regexp_extract_all(F.col(column), F.lit(COUNT_ENTRY), F.lit(1))
    counts = F.regexp_extract_all(F.col(column), F.lit(COUNT_ENTRY), F.lit(2))
    pairs = texts.select(*keys, F.posexplode(F.arrays_zip(
        codes.alias("code"), counts.alias("n"))).alias("pos", "pair")).select(
        *keys, "pos", code_text(F.col("pair.code")).alias("code"),
        F.replace("pair.n", F.lit(","), F.lit("")).cast("bigint").alias("n"))
    named = pairs.join(_labels(labels), [*keys, "code"], "left")
    shown = F.concat(F.coalesce(
        F.when(F.trim("label_text") != "", F.trim("label_text")),
        F.concat(F.lit("Código "), F.col("code"))), F.lit(" n="), F.format_number("n", 0))
    joined = named.groupBy(*keys).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", shown.alias("shown")))),
        lambda s: s["shown"]), "; ").alias("__text"))
    return texts.join(joined, keys, "left").withColumn(
        column, F.coalesce("__text", F.trim(F.coalesce(column, F.lit(""))))).drop("__text")


def with_base_distribution(recommendations: DataFrame, cells: DataFrame, labels: DataFrame,
                           safety: DataFrame) -> DataFrame:
    """Recommendations whose banner rows get their variable's distribution and no count as reason.

    It is counted afresh where the file has the variable and F4 finds it fit; an
    old text is rewritten with labels elsewhere.  Other kinds stay as they are.
    """
    keys = list(KEYS)
    banner = F.col("kind") == "banner_filtro"
    fresh = base_distribution(cells, labels, safety=safety).withColumnRenamed("base_distribution", "__fresh")
    if "base_distribution" not in recommendations.columns:
        recommendations = recommendations.withColumn("base_distribution", F.lit(None).cast("string"))
    old = recommendations.filter(banner).groupBy(*keys).agg(F.min("base_distribution").alias("__old"))
    rewritten = parse_distribution(old, labels, "__old")
    role = F.when(F.col("is_banner_recommended") & F.col("is_filter_recommended"), "banner y filtro").when(
        F.col("is_filter_recommended"), "filtro").otherwise("banner")
    counted = F.coalesce(F.col("justification").rlike(DISTRIBUTION_PATTERN), F.lit(False))
    none = F.lit(None).cast("string")
    reason = justification(none, none, first_text(F.col("label"), F.col("variable")), role, F.col("use"))
    return recommendations.join(fresh, keys, "left").join(rewritten, keys, "left").withColumns({
        "base_distribution": F.when(banner, F.coalesce("__fresh", "__old")).otherwise(F.col("base_distribution")),
        "justification": F.when(banner & counted, reason).otherwise(F.col("justification")),
    }).drop("__fresh", "__old")


# --- F2, F4 -----------------------------------------------------------------

def filter_choices(cells: DataFrame, labels: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Distinct values with display text, in menu order (F2)."""
    distinct = cells.select(*keys, "value", "code", "number").distinct().join(
        _labels(labels), [*keys, "code"], "left")
    display = F.when(F.col("code") == "", NO_DATA).otherwise(
        heading(F.col("code"), F.trim(F.coalesce("label_text", F.lit("")))))
    order = [F.col("value").isNull(), F.col("number").isNull(), F.col("number"),
             F.lower("value"), F.col("value"), F.col("display")]
    shown = distinct.select(*keys, "value", "number", display.alias("display"))
    return position(shown, keys, order, "choice_pos").drop("number")


def looks_like_id(variable: Column) -> Column:
    return normalize_text(variable).rlike("|".join(ID_NAMES))


def variable_safety(cells: DataFrame, candidates: DataFrame,
                    limit: int = MAX_FILTER_CATEGORIES) -> DataFrame:
    """Why a variable must not be a breakdown or filter; '' when it may.

    `candidates` holds (study_id, variable).  Names that look like identifiers
    are decided by minimum and maximum alone, so their values are not shuffled.
    """
    keys = list(KEYS)
    text = F.lower(F.trim("value"))
    valid = cells.filter(F.col("value").isNotNull() & ~text.isin(*INVALID_TEXTS)).join(
        candidates.select(*keys).distinct(), keys, "left_semi")
    named = valid.filter(looks_like_id(F.col("variable"))).groupBy(*keys).agg(
        F.count("*").alias("n_valid"),
        F.when(F.min("value") == F.max("value"), 1).otherwise(2).cast("long").alias("n_distinct"))
    others = valid.filter(~looks_like_id(F.col("variable"))).groupBy(*keys, "code").agg(
        F.count("*").alias("n")).groupBy(*keys).agg(
        F.sum("n").alias("n_valid"), F.count("*").alias("n_distinct"))
    present = cells.select(*keys).distinct().withColumn("present", F.lit(True))
    joined = candidates.select(*keys).distinct().join(
        named.unionByName(others), keys, "left").join(present, keys, "left")
    # Reasons shown to the user.
    reason = (
        F.when(F.trim(F.coalesce("variable", F.lit(""))) == "", "Variable vacía")
        .when(F.col("present").isNull(), "Variable inexistente en la base SPSS")
        .when(F.coalesce("n_valid", F.lit(0)) == 0, "Sin datos válidos")
        .when(F.col("n_distinct") <= 1, "Sin variación")
        .when(looks_like_id(F.col("variable")), "Variable tipo ID/folio")
        .when(F.col("n_distinct") > limit, "Alta cardinalidad")
        .otherwise("")
    )
    return joined.select(*keys, reason.alias("reason"))

"""Derived variables from numeric bands (V1, V4-V6)."""

from __future__ import annotations

import re
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tabuloom.functions.checks import guarded
from tabuloom.constants import OUT_OF_BANDS
from tabuloom.operators.metrics import ratio

Band = tuple[str, float | None, float | None]


def check_bands(bands: Sequence[Band]) -> list[Band]:
    """Unique labels, a bound each, low <= high, no overlap; touching ends overlap."""
    if not bands:
        raise ValueError("at least one band is needed")
    for label, low, high in bands:
        if not str(label).strip():
            raise ValueError("every band needs a label")
        if low is None and high is None:
            raise ValueError(f"band {label} needs a bound")
        if low is not None and high is not None and low > high:
            raise ValueError(f"the minimum exceeds the maximum in {label}")
    if len({b[0] for b in bands}) != len(bands):
        raise ValueError("band labels must be unique")
    ordered = sorted(bands, key=lambda b: float("-inf") if b[1] is None else b[1])
    for (label, _, high), (other, low, _) in zip(ordered, ordered[1:]):
        if high is None or low is None or low <= high:
            raise ValueError(f"bands overlap: {label}, {other}")
    return ordered


def apply_bands(value: Column, bands: Sequence[Band]) -> Column:
    """Label of the band that holds the number; ends are closed, NULL outside (V1)."""
    result = F.lit(None).cast("string")
    for label, low, high in reversed(check_bands(bands)):
        inside = value.isNotNull()
        if low is not None:
            inside = inside & (value >= low)
        if high is not None:
            inside = inside & (value <= high)
        result = F.when(inside, F.lit(label)).otherwise(result)
    return result


def band_preview(frame: DataFrame, value: Column, bands: Sequence[Band],
                 keys: Sequence[str] = ("study_id",)) -> DataFrame:
    """Frequency and share of all rows per band, outside included (V4)."""
    label = F.coalesce(apply_bands(value, bands), F.lit(OUT_OF_BANDS))
    counts = frame.groupBy(*keys, label.alias("band")).agg(F.count("*").alias("n"))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    return counts.join(totals, list(keys)).withColumn(
        "pct", ratio(F.col("n"), F.col("total")) * 100).drop("total")


def add_derived(tables: Mapping[str, DataFrame], value: Column, source: str, name: str, label: str,
                bands: Sequence[Band], as_banner: bool = True, as_filter: bool = True
                ) -> dict[str, DataFrame]:
    """Derived variable as column, variable, question, options, answers and roles (V5).

    `value` is computed on the respondents table.  A variable of the same name
    is only replaced when it is itself derived.  All tables come back together,
    to be written as one new version of the study.
    """
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
        raise ValueError("a derived variable needs an identifier as its name")
    variables = tables["variables"]
    taken = (F.col("variable") == name) & (F.coalesce("analytic_class", F.lit("")) != "Derivada")
    ordered = check_bands(bands)
    respondents = tables["respondents"].withColumn(name, apply_bands(value, ordered))
    others = guarded(variables.filter(F.col("variable") != name), variables.filter(taken),
                     f"{name} exists and is not derived")
    counts = respondents.groupBy("study_id").agg(
        F.count(name).alias("n_valid"), (F.count("*") - F.count(name)).alias("n_missing"),
        F.count_distinct(name).alias("n_distinct"))
    role = {"is_banner": as_banner, "is_filter": as_filter, "is_weight": False,
            "in_dashboard": True}
    new_variable = counts.select(
        "study_id", F.lit(name).alias("variable"), F.lit(label).alias("label"),
        F.lit("text").alias("kind"), F.lit(name).alias("question_id"),
        F.lit("Factor derivado").alias("question_type"),
        F.lit("Derivada").alias("analytic_class"), F.lit("Frecuencia").alias("calculation"),
        "n_valid", "n_missing", "n_distinct",
        *[F.lit(v).alias(c) for c, v in role.items()])
    new_variable = new_variable.select(*[c for c in new_variable.columns if c in variables.columns])
    questions = tables["questions"].filter(F.col("question_id") != name)
    source_question = others.filter(F.col("variable") == source).select(
        "study_id", F.coalesce("question_id", F.lit(source)).alias("question_id"))
    inherited = counts.select("study_id").join(
        source_question.join(questions, ["study_id", "question_id"], "left").drop("question_id"),
        "study_id", "left")
    given = {"question_id": name, "question_number": name, "question_text": label,
             "question_type": "RU derivada", "calculation": "Frecuencia", "in_menu": "Sí",
             "in_dashboard": True}
    columns = {c: F.lit(v) for c, v in given.items() if c in questions.columns}
    if "questionnaire_order" in questions.columns:
        columns["questionnaire_order"] = F.col("questionnaire_order") + 0.001
    new_question = inherited.withColumns(columns).select(*questions.columns)
    answered = respondents.filter(F.col(name).isNotNull())
    answers = tables["responses"].filter(F.col("variable") != name)
    new_answers = answered.select(
        "study_id", "respondent_id", F.lit(name).alias("question_id"), F.lit(name).alias("variable"),
        F.lit("RU derivada").alias("question_type"), F.col(name).alias("code"),
        F.col(name).alias("response"), F.lit(None).cast("double").alias("value"),
        F.col(name).alias("text"), F.lit(True).alias("base_valid"))
    new_answers = new_answers.select(*[c for c in new_answers.columns if c in answers.columns])
    items = F.array(*[F.struct(F.lit(b[0]).alias("code"), F.lit(b[0]).alias("label"),
                               F.lit(float(i)).alias("ord")) for i, b in enumerate(ordered, 1)])
    options = tables["options"].filter(F.col("variable") != name)
    new_options = counts.select("study_id", F.lit(name).alias("variable"),
                                F.lit(name).alias("question_id"), F.inline(items))
    new_options = new_options.withColumns({"is_other": F.lit(False), "is_exclusive": F.lit(False)})
    new_options = new_options.select(*[c for c in new_options.columns if c in options.columns])
    roles = [r for r, on in (("banner", as_banner), ("filtro", as_filter)) if on]
    config = tables["configuration"].filter(
        ~((F.col("variable") == name) & F.col("role").isin("banner", "filtro")))
    if roles:
        new_roles = counts.select(
            "study_id", F.explode(F.array(*[F.lit(x) for x in roles])).alias("role"),
            F.lit(name).alias("variable"), F.lit(name).alias("question_id"),
            F.lit(label).alias("label"))
        config = config.unionByName(new_roles, allowMissingColumns=True)
    return {
        **tables, "respondents": respondents,
        "variables": others.unionByName(new_variable, allowMissingColumns=True),
        "questions": questions.unionByName(new_question),
        "responses": answers.unionByName(new_answers, allowMissingColumns=True),
        "options": options.unionByName(new_options, allowMissingColumns=True),
        "configuration": config,
    }


def remove_derived(tables: Mapping[str, DataFrame], names: Sequence[str]) -> dict[str, DataFrame]:
    """Take inactive derived variables out of every table (V6).

    Of the configuration only breakdown and filter roles go.
    """
    wanted = list(names)
    if not wanted:
        return dict(tables)
    result = dict(tables)
    result["respondents"] = tables["respondents"].drop(*wanted)
    gone = F.coalesce(F.col("variable").isin(*wanted), F.lit(False))
    for table in ("variables", "options"):
        if table in tables:
            result[table] = tables[table].filter(~gone)
    by_question = F.coalesce(F.col("question_id").isin(*wanted), F.lit(False))
    if "questions" in tables:
        result["questions"] = tables["questions"].filter(~by_question)
    if "responses" in tables:
        result["responses"] = tables["responses"].filter(~(gone | by_question))
    if "configuration" in tables:
        result["configuration"] = tables["configuration"].filter(
            ~(gone & F.col("role").isin("banner", "filtro")))
    return result

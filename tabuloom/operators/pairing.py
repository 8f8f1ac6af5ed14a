"""Preconditions of paired comparisons, as a table of problems.

A comparison may be tested when it has no row here.  All rules are relational:
one call judges any number of comparisons of any number of studies.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tabuloom.functions.text import code_text, column_type, normalize_text, to_number

COMPARISON = ("study_id", "comparison_id")
# Metrics of a paired comparison, and question types each fits.
MEAN, BOXES, SELECTION = "Media", ("Top2Box", "BottomBox"), "Selección RM"
SCALE_TYPES = "escala|nps|numerica"
MULTI_TYPES = ("rm", "rm_codificada")


def pairing_problems(comparisons: DataFrame, respondents: DataFrame, questions: DataFrame,
                     options: DataFrame, rows: DataFrame) -> DataFrame:
    """(study_id, comparison_id, problem, n) for every rule that a comparison breaks.

    `comparisons`: study_id, comparison_id, metric, left_question, right_question,
    option_code, duplicates ('reject' or 'person_mean').
    `rows`: the selected rows of both conditions: study_id, comparison_id, side
    ('A' or 'B'), respondent_id, person_id, variable, value, scale_min, scale_max.
    """
    known = comparisons.withColumn("is_mean", F.col("metric") == MEAN)
    parts = [_identity(known, respondents), _questions(known, questions), _parents(known, questions),
             _options(known, options), _policy(known), _sides(known, rows), _overlap(known, rows)]
    return reduce(DataFrame.unionByName, parts)


def _found(frame: DataFrame, problem: str, n: Column | None = None) -> DataFrame:
    count = F.lit(1) if n is None else n
    return frame.select(*COMPARISON, F.lit(problem).alias("problem"), count.cast("bigint").alias("n"))


def _identity(comparisons: DataFrame, respondents: DataFrame) -> DataFrame:
    """Persons must be named by the study itself, not by generated row keys."""
    person = F.trim(F.coalesce(F.col("person_id").cast("string"), F.lit("")))
    same = person == F.trim(F.coalesce(F.col("original_id").cast("string"), F.lit("")))
    bad = respondents.filter((person == "") | ~same).groupBy("study_id").agg(F.count("*").alias("n"))
    return _found(comparisons.join(bad, "study_id"), "IDENTITY", F.col("n"))


def _both(comparisons: DataFrame) -> DataFrame:
    sides = F.array(*[F.struct(F.lit(side).alias("side"), F.col(name).alias("question_id"))
                      for side, name in (("A", "left_question"), ("B", "right_question"))])
    return comparisons.select("*", F.inline(sides))


def _questions(comparisons: DataFrame, questions: DataFrame) -> DataFrame:
    """Both questions exist in the dashboard, and the metric fits their type."""
    given = questions.select("study_id", "question_id", "in_dashboard", "question_type")
    joined = _both(comparisons).join(given, ["study_id", "question_id"], "left")
    usable = F.coalesce(F.col("in_dashboard").cast("boolean"), F.lit(False))
    kind = normalize_text(F.coalesce("question_type", F.lit("")))
    fits = F.when(F.col("metric") == SELECTION, kind.isin(*MULTI_TYPES)).otherwise(
        kind.rlike(SCALE_TYPES) & ~kind.isin(*MULTI_TYPES))
    counts = joined.groupBy(*COMPARISON).agg(
        F.count_if(~usable).alias("absent"), F.count_if(usable & ~fits).alias("unfit"))
    return _found(counts.filter("absent > 0"), "QUESTION", F.col("absent")).unionByName(
        _found(counts.filter("unfit > 0"), "METRIC_TYPE", F.col("unfit")))


def _parents(comparisons: DataFrame, questions: DataFrame) -> DataFrame:
    """Different questions need one declared parent."""
    parent = questions.select("study_id", "question_id", F.trim("parent_question").alias("parent"))
    joined = _both(comparisons.filter("left_question != right_question")).join(
        parent, ["study_id", "question_id"], "left")
    shared = joined.groupBy(*COMPARISON).agg(
        F.count(F.when(F.col("parent") != "", True)).alias("n"),
        F.count_distinct("parent").alias("parents"))
    return _found(shared.filter("n < 2 or parents > 1"), "PARENT")


def _options(comparisons: DataFrame, options: DataFrame) -> DataFrame:
    """Different questions need equal codes and labels; a selected option must be declared."""
    code = code_text(F.col("code"), column_type(options, "code"))
    declared = options.filter(F.col("code").isNotNull()).select(
        "study_id", "question_id", code.alias("code"), normalize_text(F.col("label")).alias("label")
    ).distinct()
    several = comparisons.filter("left_question != right_question")
    sides = _both(several).join(declared, ["study_id", "question_id"])
    unequal = sides.groupBy(*COMPARISON, "code", "label").agg(
        F.count_distinct("side").alias("sides")).filter("sides < 2")
    unequal = unequal.groupBy(*COMPARISON).agg(F.count("*").alias("n"))
    chosen = comparisons.filter(F.col("metric") == SELECTION)
    number = to_number(F.col("option_code"), column_type(comparisons, "option_code"))
    wrong = chosen.filter(number.isNull() | (number == 0))
    wanted = _both(chosen).withColumn(
        "code", code_text(F.col("option_code"), column_type(comparisons, "option_code")))
    missing = wanted.join(declared, ["study_id", "question_id", "code"], "left_anti").groupBy(
        *COMPARISON).agg(F.count("*").alias("n"))
    return _found(unequal, "OPTIONS", F.col("n")).unionByName(_found(wrong, "OPTION_CODE")).unionByName(
        _found(missing, "OPTION_NOT_DECLARED", F.col("n")))


def _policy(comparisons: DataFrame) -> DataFrame:
    """Means may average the rows of a person, proportions may not."""
    unknown = ~F.col("duplicates").isin("reject", "person_mean")
    averaged = ~F.col("is_mean") & (F.col("duplicates") == "person_mean")
    metric = ~F.col("metric").isin(MEAN, *BOXES, SELECTION)
    return _found(comparisons.filter(unknown | averaged), "DUPLICATES").unionByName(
        _found(comparisons.filter(metric), "METRIC"))


def _sides(comparisons: DataFrame, rows: DataFrame) -> DataFrame:
    """One item and one scale a side, finite and, for proportions, binary values, single persons."""
    value = F.col("value").cast("double")
    finite = ~F.isnan(value) & (F.abs(value) < float("inf"))
    people = rows.filter(F.col("value").isNotNull()).groupBy(*COMPARISON, "side", "person_id").agg(
        F.count("*").alias("n_rows"), F.count_if(~finite).alias("not_finite"),
        F.count_if(finite & ~value.isin(0.0, 1.0)).alias("not_binary"),
        F.min("variable").alias("first"), F.max("variable").alias("last"))
    sides = people.groupBy(*COMPARISON, "side").agg(
        F.count_if(F.col("n_rows") > 1).alias("repeated"), F.sum("not_finite").alias("not_finite"),
        F.sum("not_binary").alias("not_binary"),
        (F.min("first") != F.max("last")).cast("int").alias("several"))
    totals = sides.groupBy(*COMPARISON).agg(*[
        F.sum(c).alias(c) for c in ("repeated", "not_finite", "not_binary", "several")])
    judged = totals.join(comparisons.select(*COMPARISON, "metric", "is_mean", "duplicates"), list(COMPARISON))
    scale = F.col("metric") != SELECTION
    bounds = rows.filter(F.col("scale_min").isNotNull() & F.col("scale_max").isNotNull()).select(
        *COMPARISON, "side", "scale_min", "scale_max").distinct()
    mixed = bounds.groupBy(*COMPARISON, "scale_min", "scale_max").agg(F.count("*").alias("sides")).groupBy(
        *COMPARISON).agg(F.count("*").alias("kinds"), F.min("sides").alias("sides")).filter(
        "kinds > 1 or sides < 2").join(comparisons.filter(scale).select(*COMPARISON), list(COMPARISON))
    reject = F.col("duplicates") == "reject"
    rules = (("REPEATED_PERSON", reject & (F.col("repeated") > 0), "repeated"),
             ("NOT_FINITE", F.col("not_finite") > 0, "not_finite"),
             ("NOT_BINARY", ~F.col("is_mean") & (F.col("not_binary") > 0), "not_binary"),
             ("SEVERAL_ITEMS", scale & (F.col("several") > 0), "several"))
    parts = [_found(judged.filter(rule), name, F.col(n)) for name, rule, n in rules]
    return reduce(DataFrame.unionByName, [*parts, _found(mixed, "BOUNDS", F.col("kinds"))])


def _overlap(comparisons: DataFrame, rows: DataFrame) -> DataFrame:
    """Conditions of one question must not share an evaluation."""
    same = comparisons.filter("left_question = right_question").select(*COMPARISON)
    both = rows.filter(F.col("value").isNotNull()).join(same, list(COMPARISON), "left_semi").groupBy(
        *COMPARISON, "respondent_id").agg(F.count_distinct("side").alias("sides")).filter("sides = 2")
    return _found(both.groupBy(*COMPARISON).agg(F.count("*").alias("n")), "OVERLAP", F.col("n"))

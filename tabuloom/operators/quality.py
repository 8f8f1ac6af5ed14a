"""Data quality, release state and comparison of results."""

from __future__ import annotations

from functools import reduce
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tabuloom.functions.text import column_type, normalize_text, to_number, truthy_of
from tabuloom.operators.reshape import invalid_id

STUDY = "study_id"
# Accepted units of analysis.
PERSON_UNITS = ("persona", "respondente", "person", "respondent")
EVALUATION_UNITS = ("evaluacion", "evaluaciones", "evaluation", "evaluations")


# --- Q1 ---------------------------------------------------------------------

def _check(frame: DataFrame, name: str, ok: Column, detail: Column) -> DataFrame:
    return frame.select(STUDY, F.lit(name).alias("check"), F.when(ok, "Comprobado").otherwise(
        "Requiere revisión").alias("state"), detail.alias("detail"))


def scale_bounds_check(scale: DataFrame) -> DataFrame:
    """One finite, ordered definition per (question, variable)."""
    low, high = F.col("scale_min"), F.col("scale_max")
    finite = low.isNotNull() & high.isNotNull() & (F.abs(low) < float("inf")) & (
        F.abs(high) < float("inf"))
    good = F.coalesce(finite & (low < high), F.lit(False))
    bounds = F.struct(low, high)
    return scale.groupBy(STUDY, "question_id", "variable").agg(
        F.bool_and(good).alias("ordered"), (F.min(bounds) == F.max(bounds)).alias("consistent"),
        F.count("*").alias("n_rows"))


def readiness(respondents: DataFrame, questions: DataFrame, scale: DataFrame,
              weights: Sequence[str]) -> DataFrame:
    """One row per check and study; the last one always requires review (Q1)."""
    unit = normalize_text(F.col("analysis_unit"))
    active = questions.filter(truthy_of(questions, "in_dashboard"))
    units = active.groupBy(STUDY).agg(
        F.count_if(~unit.isin(*PERSON_UNITS, *EVALUATION_UNITS)).alias("bad"))
    same = F.trim(F.col("person_id").cast("string")) == F.trim(F.col("original_id").cast("string"))
    people = respondents.groupBy(STUDY, "person_id").agg(
        F.count("*").alias("n"),
        F.bool_and(F.coalesce(same, F.lit(False)) & ~invalid_id(F.col("person_id"))).alias("ok"))
    identity = people.groupBy(STUDY).agg(
        F.sum("n").alias("rows"), F.count("*").alias("persons"), F.bool_and("ok").alias("ok"))
    bounds = scale_bounds_check(scale).groupBy(STUDY).agg(
        F.bool_and(F.col("ordered") & F.col("consistent")).alias("ok"),
        F.count_if(~(F.col("ordered") & F.col("consistent"))).alias("bad"))
    present = [w for w in weights if w in respondents.columns]
    absent = [w for w in weights if w not in respondents.columns]
    flags = []
    for name in present:
        value = to_number(F.col(name), column_type(respondents, name))
        good = F.coalesce((value > 0) & (value < float("inf")), F.lit(False))
        flags.append(F.when(~F.bool_and(good), F.lit(name)))
    bad_list = F.array_compact(F.array(*flags, *[F.lit(a) for a in absent])) if weights else \
        F.array().cast("array<string>")
    weighted = respondents.groupBy(STUDY).agg(F.count("*").alias("n"), bad_list.alias("bad"))
    parts = [
        _check(units, "Unidad de análisis", F.col("bad") == 0, F.concat(
            F.col("bad").cast("string"), F.lit(" preguntas sin unidad reconocida"))),
        _check(identity, "Identificación de personas", F.col("ok"), F.concat(
            F.col("rows").cast("string"), F.lit(" evaluaciones; "),
            F.col("persons").cast("string"), F.lit(" personas únicas"))),
        _check(bounds, "Límites de escala", F.col("ok"), F.concat(
            F.col("bad").cast("string"), F.lit(" ítems con límites inválidos"))),
        _check(weighted, "Ponderación", F.size("bad") == 0, F.array_join("bad", ", ")),
        _check(weighted, "Reglas de aplicación y aprobación metodológica", F.lit(False),
               F.lit("revisión manual")),
    ]
    return reduce(DataFrame.unionByName, parts)


# --- Q7 to Q9 ---------------------------------------------------------------

def materialization_checks(source_n: DataFrame, cells: DataFrame, invalid: DataFrame,
                           dangling: DataFrame) -> DataFrame:
    """Check rows of one load (Q7).

    Only the row count, the category domain and reference integrity can block.
    `source_n` holds (study_id, n_rows); `invalid` and `dangling` list problems.
    """
    ids = cells.groupBy(STUDY, "respondent_id").agg(F.lit(1).alias("one"))
    runtime = ids.groupBy(STUDY).agg(F.count("*").alias("runtime_n"))
    counts = source_n.join(runtime, STUDY, "left").fillna(0, ["runtime_n"])
    missing = cells.groupBy(STUDY, "variable").agg(
        F.count_if(F.col("value").isNull()).alias("n"))

    def row(frame: DataFrame, code: str, ok: Column, message: Column, can_block: bool) -> DataFrame:
        return frame.select(
            STUDY, F.lit(code).alias("code"), F.when(ok, "PASS").otherwise("FAIL").alias("state"),
            message.alias("message"), (~ok & F.lit(can_block)).alias("blocking"))

    def problems(frame: DataFrame) -> DataFrame:
        found = frame.groupBy(STUDY).agg(F.count("*").alias("n"))
        return source_n.select(STUDY).join(found, STUDY, "left").fillna(0, ["n"])

    n = F.col("n").cast("string")
    return reduce(DataFrame.unionByName, [
        row(counts, "QA-SOURCE-N", F.lit(True), F.concat(
            F.lit("source_n="), F.col("n_rows").cast("string")), False),
        row(counts, "QA-RUNTIME-N", F.col("n_rows") == F.col("runtime_n"), F.concat(
            F.lit("runtime_n="), F.col("runtime_n").cast("string")), True),
        row(missing, "QA-MISSING", F.lit(True), F.concat(
            F.col("variable"), F.lit(" missing_count="), n), False),
        row(problems(invalid), "QA-CATEGORY-DOMAIN", F.col("n") == 0, F.concat(
            F.lit("undeclared="), n), True),
        row(problems(dangling), "QA-REFERENCE-INTEGRITY", F.col("n") == 0, F.concat(
            F.lit("dangling="), n), True),
    ])


def dangling_references(references: Sequence[tuple[str, DataFrame, str, DataFrame, str]]
                        ) -> DataFrame:
    """References without a target (Q8).

    Each entry is (kind, referring frame, its column, target frame, its column).
    """
    parts = []
    for kind, source, column, target, key in references:
        used = source.filter(F.col(column).isNotNull() & (F.trim(F.col(column).cast("string")) != "")
                             ).select(STUDY, F.col(column).cast("string").alias("reference")).distinct()
        known = target.select(STUDY, F.col(key).cast("string").alias("reference"))
        parts.append(used.join(known, [STUDY, "reference"], "left_anti").withColumn(
            "kind", F.lit(kind)))
    return reduce(DataFrame.unionByName, parts)


def domain_violations(cells: DataFrame, allowed: DataFrame) -> DataFrame:
    """Observed codes outside the declared domain of a variable (Q2)."""
    keys = [STUDY, "variable", "code"]
    seen = cells.filter(F.trim("value") != "").groupBy(*keys).agg(F.count("*").alias("n_rows"))
    return seen.join(allowed.select(*keys).distinct(), keys, "left_anti")


def release_state(events: DataFrame, runs: DataFrame) -> DataFrame:
    """Release state per run from its QA events (Q9).

    `runs` holds run_id, computation_status, release_evidence; `events` run_id,
    state, blocking.
    """
    flags = events.groupBy("run_id").agg(
        F.bool_or("blocking").alias("blocked"),
        F.bool_or(F.col("state") == "REVIEW_REQUIRED").alias("review"),
        F.count("*").alias("n_events"))
    joined = runs.join(flags, "run_id", "left")
    failed = F.col("computation_status") == "FAILED"
    blocked, review = (F.coalesce(c, F.lit(False)) for c in ("blocked", "review"))
    any_event = F.coalesce("n_events", F.lit(0)) > 0
    evidence = F.col("release_evidence")
    status = (
        F.when(failed | blocked, "FAIL").when(review, "REVIEW_REQUIRED")
        .when(any_event, "PASS_WITH_WARNINGS").when(~evidence, "REVIEW_REQUIRED")
        .otherwise("PASS")
    )
    return joined.select(
        "run_id", status.alias("qa_release_status"),
        (~failed & ~blocked & ~review & evidence).alias("releasable"))


# --- Q11 --------------------------------------------------------------------

def row_hash(columns: Sequence[str]) -> Column:
    """SHA-256 of a row as canonical JSON; NULL fields are kept."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def result_fingerprint(result: DataFrame, keys: Sequence[str] = (STUDY,),
                       volatile: Sequence[str] = ()) -> DataFrame:
    """Same content, same fingerprint, in any row order (Q11).

    Row hashes are added up in four parts, so no task holds all rows, and
    repeated rows count.  Volatile ids and labels are left out.
    """
    content = [c for c in result.columns if c not in volatile]
    hashed = result.select(*keys, row_hash(content).alias("h"))
    parts = [F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)"))
             .cast("string").alias(f"s{i}") for i in range(4)]
    sums = hashed.groupBy(*keys).agg(F.count("*").alias("n_rows"), *parts)
    return sums.select(*keys, "n_rows", F.sha2(F.concat_ws(
        "|", F.col("n_rows").cast("string"), "s0", "s1", "s2", "s3"), 256).alias("fingerprint"))


# --- J7, J8 -----------------------------------------------------------------

def compare_results(left: DataFrame, right: DataFrame, key: Sequence[str],
                    classes: DataFrame | None = None) -> DataFrame:
    """Full outer comparison of two results on a semantic key.

    Equal values are PARITY.  A delta needs a declared class to be excused, and
    PARITY cannot be claimed for one.  Key parts may be NULL.
    """
    a = left.select(*key, F.col("value").alias("left_value"), F.lit(True).alias("__in_left"))
    b = right.select(*[F.col(k).alias(f"__{k}") for k in key],
                     F.col("value").alias("right_value"), F.lit(True).alias("__in_right"))
    same_key = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key])
    in_left = F.col("__in_left").isNotNull()
    joined = a.join(b, same_key, "full_outer").select(
        *[F.when(in_left, F.col(k)).otherwise(F.col(f"__{k}")).alias(k) for k in key],
        "left_value", "right_value",
        F.when(in_left & F.col("__in_right").isNotNull(), "BOTH").when(in_left, "LEFT")
        .otherwise("RIGHT").alias("present"))
    claim = F.lit(None).cast("string")
    if classes is not None:
        declared = classes.select(*[F.col(k).alias(f"__{k}") for k in key],
                                  F.col("classification").alias("__claim"))
        joined = joined.join(declared, same_key, "left").drop(*[f"__{k}" for k in key])
        claim = F.col("__claim")
    equal = F.col("left_value").eqNullSafe(F.col("right_value"))
    named = claim.isNotNull() & (claim != "PARITY")
    result = joined.withColumns({
        "classification": F.when(equal, "PARITY").when(named, claim).otherwise(
            "POTENTIAL_REGRESSION"),
        "reason": F.when(equal, "values are equivalent before presentation rounding")
        .when(claim == "PARITY", "PARITY classification rejected for actual delta")
        .when(claim.isNotNull(), "classified delta").otherwise("unexplained delta"),
    }).withColumn("blocking", F.col("classification") == "POTENTIAL_REGRESSION")
    return result.drop("__claim")


def differing_flags(left: DataFrame, right: DataFrame, key: Sequence[str], flag: str = "eligible",
                    ) -> DataFrame:
    """Rows of two universes whose membership differs."""
    a = left.select(*key, F.col(flag).alias("left_flag"))
    b = right.select(*key, F.col(flag).alias("right_flag"))
    return a.join(b, list(key), "full_outer").filter(
        ~F.col("left_flag").eqNullSafe(F.col("right_flag")))


def differing_counts(left: DataFrame, right: DataFrame, key: Sequence[str],
                     counts: Sequence[str]) -> DataFrame:
    """Ledger counts that differ between two runs, one row per count."""
    def long(frame: DataFrame, name: str) -> DataFrame:
        items = F.inline(F.array(*[
            F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias(name))
            for c in counts]))
        return frame.select(*key, items)
    joined = long(left, "left_count").join(
        long(right, "right_count"), [*key, "measure"], "full_outer")
    return joined.filter(~F.col("left_count").eqNullSafe(F.col("right_count")))


def differing_slices(ledgers: DataFrame, left: str, right: str, key: Sequence[str],
                     counts: Sequence[str]) -> DataFrame:
    """Ledger counts that differ between two slices of one ledger table."""
    items = F.inline(F.array(*[
        F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in counts]))
    sides = ledgers.filter(F.col("slice_id").isin(left, right)).select(*key, "slice_id", items)
    return sides.groupBy(*key, "measure").agg(
        F.max(F.when(F.col("slice_id") == left, F.col("value"))).alias("left_count"),
        F.max(F.when(F.col("slice_id") == right, F.col("value"))).alias("right_count"),
    ).filter(~F.col("left_count").eqNullSafe(F.col("right_count")))

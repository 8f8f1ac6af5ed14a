"""Reading, writing, checking and exporting studies.

A stored study is a folder of versions.  Writing adds a version folder and then
one row to the version log; readers follow the newest row, so a study is
replaced whole and a failed write is never seen.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from functools import reduce
from typing import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F, types as T

from tabuloom.functions.text import code_text
from tabuloom.operators.codebook import explode_variables, merge_by_variable
from tabuloom.operators.ordering import first_rows, unused

STUDY = "study_id"
LOG_SCHEMA = "version bigint, tables array<string>, buckets int"
# Tables a study must have, and tables of which it needs one.
REQUIRED_TABLES = ("respondents", "questions", "variables", "options", "configuration")
RESPONSE_TABLES = ("responses", "multi_responses", "scales", "grid_responses")
REVIEW_LIMIT_TABLES = ("responses", "multi_responses", "grid_responses", "scales", "open_ended")
# The layout of the flat table has places for so many filters.
FLAT_FILTERS = 2
REVIEW_ROWS = 5000

SCHEMAS = {
    "responses": "study_id string, respondent_id string, question_id string, variable string, "
                 "question_type string, code string, response string, value double, text string, "
                 "base_valid boolean",
    "multi_responses": "study_id string, respondent_id string, question_id string, "
                       "variable string, code string, response string, format_rm string",
    "multi_bases": "study_id string, respondent_id string, question_id string",
    "scales": "study_id string, respondent_id string, question_id string, variable string, "
              "item_text string, value double, response string, scale_min double, "
              "scale_max double, top2box int, bottombox int, nps_group string",
    "grid_responses": "study_id string, respondent_id string, question_id string, grid_id string, "
                      "variable string, entity string, option_code string, option string, "
                      "value string, selected int, base_valid int, structural_missing int",
    "open_ended": "study_id string, respondent_id string, question_id string, variable string, "
                  "original_text string, clean_text string",
}


class StudyError(ValueError):
    """A study that cannot be read or exported."""


def fold_nan(frame: DataFrame) -> DataFrame:
    """NaN becomes NULL once, at ingest."""
    floats = [f.name for f in frame.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    if not floats:
        return frame
    return frame.withColumns({c: F.when(~F.isnan(F.col(c)), F.col(c)) for c in floats})


def load_study(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Raw answers, value labels and missing rules landed as parquet."""
    names = ("answers", "variable_labels", "value_labels", "missing_rules")
    return {n: fold_nan(spark.read.parquet(f"{path}/{n}")) for n in names}


def load_codebook(sheets: Sequence[tuple[str, DataFrame]], list_columns: Mapping[str, str] = {}
                  ) -> DataFrame:
    """Merge codebook sheets: the first wins, the others fill its blanks.

    A sheet named in `list_columns` lists several variables in that column.
    """
    prepared = []
    for name, sheet in sheets:
        prepared.append(explode_variables(sheet, list_columns[name])
                        if name in list_columns else sheet)
    return reduce(merge_by_variable, prepared)


# --- S4, S3, S5 -------------------------------------------------------------

#: Tables with a row per respondent or answer, and what the stored rows of a bucket are sorted by.
BUCKET_KEYS = (STUDY, "respondent_id")
BUCKET_ORDER = ("question_id", STUDY, "respondent_id")


def write_study(tables: Mapping[str, DataFrame], path: str,
                partition_by: Sequence[str] = ("question_id",), buckets: int | None = None) -> int:
    """Write all tables as one new version of the study.

    Fact tables are range-partitioned down to the respondent, so that a large
    question is spread over several tasks, and sorted, which keeps row-group
    statistics selective.

    With `buckets`, facts and respondents are dealt by study and respondent into
    so many buckets instead, and sorted by question inside.  A tabulation then
    joins and reduces answers where they lie: nothing is shuffled below its cells.
    """
    version = time.time_ns() // 1000
    spark = next(iter(tables.values())).sparkSession
    for name, frame in tables.items():
        target = f"{path}/versions/{version}/{name}"
        if buckets and set(BUCKET_KEYS) <= set(frame.columns):
            _write_buckets(frame, target, buckets)
        elif name in SCHEMAS:
            order = [STUDY, "question_id", "respondent_id"]
            parts = [c for c in partition_by if c in frame.columns]
            arranged = frame.repartitionByRange(*order).sortWithinPartitions(*parts, *order)
            arranged.write.partitionBy(*parts).parquet(target)
        else:
            frame.write.parquet(target)
    log = spark.createDataFrame([(version, sorted(tables), buckets)], LOG_SCHEMA)
    log.coalesce(1).write.mode("append").parquet(f"{path}/log")
    return version


def _bucket_order(columns: Sequence[str]) -> list[str]:
    return [c for c in BUCKET_ORDER if c in columns]


def _write_buckets(frame: DataFrame, target: str, buckets: int) -> None:
    """One file per bucket.  Spark writes buckets of tables only, so one is named for the writing."""
    table = f"study_{uuid.uuid4().hex}"
    dealt = frame.repartition(buckets, *BUCKET_KEYS)
    dealt.write.bucketBy(buckets, *BUCKET_KEYS).sortBy(*_bucket_order(frame.columns)).option("path", target).saveAsTable(table)
    # The files stay: a table with a path is external.
    frame.sparkSession.sql(f"DROP TABLE {table}")


def _read_buckets(spark: SparkSession, target: str, buckets: int) -> DataFrame:
    """The stored rows as a table of this session, so that joins know how they are dealt."""
    table = f"study_{hashlib.sha256(target.encode()).hexdigest()[:32]}"
    if not spark.catalog.tableExists(table):
        files = spark.read.parquet(target)
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)
        keys, order = ", ".join(BUCKET_KEYS), ", ".join(_bucket_order(files.columns))
        spark.sql(f"CREATE TABLE {table} ({fields}) USING parquet CLUSTERED BY ({keys}) "
                  f"SORTED BY ({order}) INTO {buckets} BUCKETS LOCATION '{target}'")
    return spark.table(table)


def current_version(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """Newest version and its tables."""
    row = _newest(spark, path)
    return row["version"], list(row["tables"])


def _newest(spark: SparkSession, path: str) -> Row:
    try:
        log = spark.read.schema(LOG_SCHEMA).parquet(f"{path}/log")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        raise StudyError(f"no study at {path}") from error
    newest = log.orderBy(F.col("version").desc()).limit(1).collect()
    if not newest:
        raise StudyError(f"no study at {path}")
    return newest[0]


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of the current version; an absent fact table is empty (S3)."""
    newest = _newest(spark, path)
    version, names, buckets = newest["version"], list(newest["tables"]), newest["buckets"]
    if name not in names:
        if name not in SCHEMAS:
            raise StudyError(f"unknown table: {name}")
        return spark.createDataFrame([], SCHEMAS[name])
    target = f"{path}/versions/{version}/{name}"
    files = spark.read.parquet(target)
    return _read_buckets(spark, target, buckets) if buckets and set(BUCKET_KEYS) <= set(files.columns) else files


def scan_question(spark: SparkSession, path: str, name: str, question_id: str,
                  study_id: str | None = None) -> DataFrame:
    """Rows of one question: partition pruning on the question (S3)."""
    rows = read_table(spark, path, name).filter(F.col("question_id") == question_id)
    return rows if study_id is None else rows.filter(F.col(STUDY) == study_id)


def validate_study(spark: SparkSession, path: str) -> tuple[bool, list[str], str]:
    """Required tables, and at least one response table."""
    try:
        _, names = current_version(spark, path)
    except StudyError:
        return False, [], "no study"
    absent = [t for t in REQUIRED_TABLES if t not in names]
    if absent:
        return False, absent, "required tables are missing"
    if not any(t in names for t in RESPONSE_TABLES):
        return False, list(RESPONSE_TABLES), "no response table"
    return True, [], "ok"


# --- S6 ---------------------------------------------------------------------

FLAT_COLUMNS = ("study_id", "respondent_id", "question_id", "question_text", "variable",
                "question_type", "calculation", "item", "code", "response", "value", "weight")


def flat_fact(tables: Mapping[str, DataFrame], banners: Sequence[str] = (),
              filters: Sequence[str] = (), weight: str | None = None,
              n_filters: int = FLAT_FILTERS) -> DataFrame:
    """Four long tables as one, with breakdown columns and filters.

    Of respondents listed twice the first counts: by `row_index`, if there is
    one, then by weight and columns.
    """
    questions = tables["questions"].select(
        STUDY, "question_id", "question_text", F.col("question_type").alias("q_type"),
        F.col("calculation").alias("q_calculation"))
    empty, text = F.lit(""), lambda c: F.col(c).cast("string")

    def part(name: str, **given: Column) -> DataFrame | None:
        if name not in tables:
            return None
        return tables[name].join(questions, [STUDY, "question_id"], "left").select(
            STUDY, "respondent_id", "question_id",
            F.coalesce("question_text", empty).alias("question_text"), "variable",
            *[given[c].alias(c) for c in ("question_type", "calculation", "item", "code",
                                          "response", "value")])

    q_type, q_calc = F.col("q_type"), F.col("q_calculation")
    none = F.lit(None).cast("double")
    scale_code = code_text(F.col("value"), T.DoubleType())
    parts = [
        part("responses", question_type=F.coalesce(
            F.when(F.col("question_type") != "", F.col("question_type")), q_type, empty),
            calculation=F.coalesce(q_calc, empty), item=empty, code=text("code"),
            response=F.col("response"), value=F.col("value")),
        part("multi_responses", question_type=F.lit("RM"),
             calculation=F.coalesce(q_calc, F.lit("RM % Respondentes")), item=empty,
             code=text("code"), response=F.col("response"), value=F.lit(1.0)),
        part("scales", question_type=F.coalesce(q_type, F.lit("Escala")),
             calculation=F.coalesce(q_calc, F.lit("Media")), item=F.col("item_text"),
             code=scale_code, response=F.col("response"), value=F.col("value")),
        part("open_ended", question_type=F.lit("Abierta"), calculation=F.lit("Texto abierto"),
             item=empty, code=empty, response=F.col("clean_text"), value=none),
    ]
    flat = reduce(DataFrame.unionByName, [p for p in parts if p is not None])
    people = tables["respondents"]
    reserved = set(FLAT_COLUMNS) | {"filter_1", "filter_2"}
    assigned = []
    for name in dict.fromkeys(banners):
        if name not in people.columns:
            continue
        target = name
        while target in reserved:
            target = f"banner_{target}"
        reserved.add(target)
        assigned.append((target, name))
    assigned += [(f"filter_{i}", name) for i, name in enumerate(list(dict.fromkeys(filters))[:n_filters], 1)
                 if name in people.columns]
    chosen = F.col(weight).cast("double") if weight and weight in people.columns else F.lit(1.0)
    # One row per respondent, so the join cannot multiply facts.
    place = ["row_index"] if "row_index" in people.columns else []
    kept = F.min(F.struct(*place, F.coalesce(chosen, F.lit(1.0)).alias("weight"),
                          *[F.col(n).alias(f"__{t}") for t, n in assigned]))
    lookup = people.groupBy(STUDY, "respondent_id").agg(kept.alias("kept")).select(
        STUDY, "respondent_id", "kept.*").drop(*place)
    joined = flat.join(lookup, [STUDY, "respondent_id"], "left")
    result = joined.select(*FLAT_COLUMNS, *[F.col(f"__{t}").alias(t) for t, _ in assigned])
    for name in ("filter_1", "filter_2"):
        if name not in result.columns:
            result = result.withColumn(name, F.lit(None).cast("string"))
    return result


# --- S7, S8, S9 -------------------------------------------------------------

def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per table."""
    parts = [t.agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("table"), "n_rows")
             for n, t in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def review_extract(tables: Mapping[str, DataFrame], n: int = REVIEW_ROWS) -> dict[str, DataFrame]:
    """Every table, the five long ones cut to their first rows in a stable order."""
    result = {}
    for name, frame in tables.items():
        if name in REVIEW_LIMIT_TABLES:
            order = [c for c in (STUDY, "question_id", "variable", "respondent_id")
                     if c in frame.columns]
            frame = first_rows(frame, order, n)
        result[name] = frame
    return result


def export_result(cells: DataFrame, state: DataFrame, path: str, official: bool = True) -> None:
    """Write cells as CSV, led by the export and release columns.

    `state` has one row with qa_release_status and releasable.  An official
    export refuses when the result is not releasable.
    """
    row = state.select("qa_release_status", "releasable").limit(2).collect()
    if len(row) != 1:
        raise StudyError("exactly one release state is needed")
    if official and not row[0]["releasable"]:
        raise StudyError(f"not releasable: {row[0]['qa_release_status']}")
    released_result(cells, row[0]["releasable"], row[0]["qa_release_status"], official).write.csv(
        path, header=True)


def released_result(cells: DataFrame, releasable: bool, status: str, official: bool) -> DataFrame:
    return cells.select(
        F.lit("OFFICIAL" if official else "REVIEW").alias("export_path"),
        F.lit(releasable).alias("release_releasable"),
        F.lit(status).alias("qa_release_status"), *cells.columns)


def canonical_order(frame: DataFrame) -> DataFrame:
    """Deterministic order: semantic_order, NULL last, then the row as JSON."""
    as_json = F.to_json(F.struct(*sorted(frame.columns)))
    if "semantic_order" in frame.columns:
        return frame.orderBy(F.col("semantic_order").asc_nulls_last(), as_json)
    return frame.orderBy(as_json)


CANONICAL_TABLES = ("slices", "bases", "values", "comparisons", "qa_events")


def write_canonical(tables: Mapping[str, DataFrame], path: str) -> None:
    """Slices, bases, values, comparisons and QA events, each in canonical order."""
    absent = [t for t in CANONICAL_TABLES if t not in tables]
    if absent:
        raise StudyError(f"missing canonical tables: {absent}")
    for name in CANONICAL_TABLES:
        _positioned(canonical_order(tables[name]), f"{path}/sorted/{name}").write.parquet(f"{path}/{name}")


def _positioned(ordered: DataFrame, path: str) -> DataFrame:
    """Rows of an ordered frame with their `position` from 1.

    The frame is sorted once, into `path`, each row with its partition and its
    place in it.  Only the sizes of partitions are collected; no task sees more
    than its own rows, and no position depends on a second sort.
    """
    at = unused(ordered.columns, "_at")
    ordered.select("*", F.monotonically_increasing_id().alias(at)).write.parquet(path)
    numbered = ordered.sparkSession.read.parquet(path)
    part = F.shiftright(at, 33)
    sizes = numbered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()
    before, offset = {}, 0
    for part_id, n in sorted(sizes):
        before[part_id], offset = offset, offset + n
    starts = F.create_map(*[F.lit(x) for item in before.items() for x in item]) if before else None
    place = F.lit(0) if starts is None else starts[part]
    return numbered.withColumn(
        "position", (place + F.col(at).bitwiseAND((1 << 33) - 1) + 1).cast("bigint")).drop(at)

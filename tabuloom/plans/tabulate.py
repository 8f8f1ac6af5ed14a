"""The book of tables: every question by breakdown columns, in one lazy plan.

Tabulating a single question is the same call after a filter on it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from tabuloom.functions.predicates import filter_condition
from tabuloom.functions.text import normalize_text
from tabuloom.operators import metrics as m
from tabuloom.operators import significance as z
from tabuloom.operators import units as u
from tabuloom.operators.breakdown import CELL_COLUMNS, respondent_dimension
from tabuloom.operators.quality import PERSON_UNITS
from tabuloom.operators.reshape import scales_of
from tabuloom.operators.tables import long_cells, order_responses

KEYS = m.KEYS
FACT_VALUES = {"responses": ("code",), "multi_responses": ("code",), "multi_bases": (),
               "grid_responses": ("value",), "scales": ("value",)}

# In order of priority where several tests have the same response.
TESTS = ("pct", "pct_respondents", "pct_mentions", "mean", "top2box", "bottombox")


@dataclass(frozen=True)
class Request:
    """What to tabulate.  Defaults follow the tabulator, not the strict core."""

    banners: Sequence[str] = ()
    mode: str = "nested"
    filters: Mapping[str, Sequence[object]] | None = None
    weight: str | None = None
    missing_weight: str = "one"
    base: str = "eligible"
    significance: bool = False
    tests: Sequence[str] = ("pct", "pct_respondents", "mean", "top2box", "bottombox")
    confidence: float = 0.95
    min_base: int = 30
    response_order: str = "label"
    nps_scale: int = 100

    def __post_init__(self) -> None:
        if self.missing_weight not in ("one", "exclude"):
            raise ValueError("missing_weight must be 'one' or 'exclude'")
        if self.base not in ("answered", "eligible"):
            raise ValueError("base must be 'answered' or 'eligible'")
        unknown = set(self.tests) - set(TESTS)
        if unknown:
            raise ValueError(f"no test of {sorted(unknown)}")


@dataclass(frozen=True)
class Report:
    """Lazy summaries; only the ones that are used are ever computed."""

    frequency: DataFrame | None
    multi: DataFrame | None
    grid: DataFrame | None
    moments: DataFrame | None
    scale: DataFrame | None
    nps: DataFrame | None
    letters: DataFrame | None
    order: DataFrame | None
    bases: DataFrame


def _split_units(tables: Mapping[str, DataFrame]) -> list[tuple[dict[str, DataFrame], bool]]:
    """Facts of evaluation questions and, apart from them, of person questions."""
    questions = tables.get("questions")
    if questions is None or "analysis_unit" not in questions.columns:
        return [(dict(tables), False)]
    person = questions.filter(normalize_text(F.col("analysis_unit")).isin(*PERSON_UNITS)).select(
        *KEYS)
    facts = [n for n in FACT_VALUES if n in tables]
    rows = {n: tables[n].join(person, list(KEYS), "left_anti") for n in facts}
    people = {n: tables[n].join(person, list(KEYS), "left_semi") for n in facts}
    return [({**tables, **rows}, False), ({**tables, **people}, True)]


def _person_tables(tables: dict[str, DataFrame], request: Request) -> dict[str, DataFrame]:
    """Filters first, so no arbitrary evaluation defines a person's breakdown."""
    respondents = tables["respondents"]
    selected = respondents.filter(filter_condition(respondents, request.filters))
    attributes = [c for c in (*request.banners, *([request.weight] if request.weight else []))
                  if c in respondents.columns]
    keep = selected.select("study_id", "respondent_id", "person_id", *dict.fromkeys(attributes))
    result = dict(tables)
    for name, values in FACT_VALUES.items():
        if name not in tables:
            continue
        inside = tables[name].join(
            keep.select("study_id", "respondent_id"), ["study_id", "respondent_id"], "left_semi")
        result[name], result["respondents"] = u.to_person_unit(
            inside, keep, [v for v in values if v in inside.columns], attributes,
            check=bool(values))
    return result


def _union(parts: list[DataFrame | None]) -> DataFrame | None:
    present = [p for p in parts if p is not None]
    return reduce(DataFrame.unionByName, present) if present else None


def tabulate(tables: Mapping[str, DataFrame], request: Request) -> Report:
    """Summaries of every question in `tables`.

    `tables`: respondents and any of responses, multi_responses, multi_bases,
    grid_responses, scales, options, questions, scale_bounds.  A question of
    scale_bounds (scale_min, scale_max, nps) that has no scale rows is scored from
    its single-choice rows.
    """
    options = tables.get("options")
    frequency, multi, grid, moments, nps, bases = [], [], [], [], [], []
    for part, by_person in _split_units(tables):
        if by_person:
            part = _person_tables(part, request)
        filters = None if by_person else request.filters
        respondents = part["respondents"]
        dimension = respondent_dimension(
            respondents, request.banners, options, request.mode, filters, request.weight,
            missing_weight=request.missing_weight)
        if "responses" in part:
            frequency.append(m.frequency(part["responses"], dimension))
        if "multi_responses" in part:
            base = part.get("multi_bases") if request.base == "eligible" else None
            multi.append(m.multi_response(part["multi_responses"], dimension, base))
        if "grid_responses" in part:
            grid.append(m.grid_multi_response(part["grid_responses"], dimension))
        scales = scales_of(part.get("scales"), part.get("responses"), tables.get("scale_bounds"))
        if scales is not None:
            moments.append(m.cell_moments(scales, dimension))
            nps.append(m.nps_of(moments[-1], nps_scale=request.nps_scale))
        selected = respondents.filter(filter_condition(respondents, filters))
        answered = [part[n].select(*KEYS, "respondent_id") for n in
                    ("responses", "multi_responses", "scales", "multi_bases") if n in part]
        if "grid_responses" in part:
            answered.append(part["grid_responses"].filter("base_valid = 1").select(
                *KEYS, "respondent_id"))
        if answered:
            bases.append(u.question_bases(answered, respondents, selected))
    frames = {"frequency": _union(frequency), "multi": _union(multi), "grid": _union(grid),
              "moments": _union(moments), "nps": _union(nps)}
    bases_frame = _union(bases)
    letters = _letters(frames, bases_frame, request) if request.significance else None
    order = _order(frames, options, request.response_order)
    scale = None if frames["moments"] is None else m.scale_summary(frames["moments"])
    return Report(frames["frequency"], frames["multi"], frames["grid"], frames["moments"], scale,
                  frames["nps"], letters, order, bases_frame)


def _grid_responses(grid: DataFrame) -> DataFrame:
    """Cells of a grid with one response text per entity and option."""
    return grid.withColumn("response", F.concat_ws(" | ", "entity", "option"))


def _mentions(frames: Mapping[str, DataFrame | None]) -> DataFrame | None:
    """Multiple-response cells of both kinds."""
    grid = frames["grid"]
    columns = [*KEYS, *CELL_COLUMNS, "response", *m.RM_METRICS, "base", "base_mentions"]
    parts = [frames["multi"], None if grid is None else _grid_responses(grid)]
    return _union([None if p is None else p.select(*columns) for p in parts])


def _order(frames: Mapping[str, DataFrame | None], options: DataFrame | None, mode: str
           ) -> DataFrame | None:
    """Order of the responses of all summaries (O1).

    By frequency, a question with mentions is ordered by them; its other
    responses count as 0.
    """
    if options is None and mode != "frequency":
        return None
    columns = [*KEYS, "banner", "response", F.col("n").alias("n")]
    single, rm = frames["frequency"], _mentions(frames)
    parts = [None if single is None else single.select(*columns).withColumn("by", F.lit(0)),
             None if rm is None else rm.withColumn("n", F.col("mentions")).select(*columns)
             .withColumn("by", F.lit(1))]
    cells = _union(parts)
    if cells is None:
        return None
    if single is not None and rm is not None:
        best = cells.groupBy(*KEYS).agg(F.max("by").alias("best"))
        cells = cells.join(best, list(KEYS)).withColumn(
            "n", F.when(F.col("by") == F.col("best"), F.col("n")).otherwise(0))
    return order_responses(cells, options, mode)


def _letters(frames: Mapping[str, DataFrame | None], bases: DataFrame, request: Request
             ) -> DataFrame | None:
    """Letters of all tests in priority order; none where persons repeat."""
    confidence, min_base = request.confidence, request.min_base
    mentions, moments = _mentions(frames), frames["moments"]
    tests = {
        "pct": (frames["frequency"], lambda cells, *limits: z.proportion_letters(
            cells, "n", "base", "pct", *limits)),
        "pct_respondents": (mentions, lambda cells, *limits: z.proportion_letters(
            cells, "respondents", "base", "pct_respondents", *limits)),
        "pct_mentions": (mentions, lambda cells, *limits: z.proportion_letters(
            cells, "mentions", "base_mentions", "pct_mentions", *limits)),
        "mean": (moments, z.mean_letters),
        "top2box": (moments, lambda cells, *limits: z.box_letters(cells, "top2box", *limits)),
        "bottombox": (moments, lambda cells, *limits: z.box_letters(cells, "bottombox", *limits)),
    }
    parts = []
    for name in TESTS:
        cells, test = tests[name]
        if name in request.tests and cells is not None:
            parts.append(test(cells, confidence, min_base))
    if not parts:
        return None
    independent = bases.filter(~F.col("repeated_people")).select(*KEYS)
    return z.combine_letters(parts).join(independent, list(KEYS), "left_semi")


def report_cells(report: Report, metrics: Sequence[str]) -> DataFrame:
    """Requested metrics of all summaries as (response, banner, metric, value) rows."""
    sources = (
        (report.frequency, ("n", "pct", "n_weighted", "pct_weighted"), "response"),
        (report.multi, m.RM_METRICS, "response"),
        (report.scale, ("mean", "sd", "mean_weighted", "top2box", "bottombox"), None),
        (report.nps, ("nps",), None),
    )
    parts = []
    for frame, names, label in sources:
        wanted = [x for x in metrics if x in names]
        if frame is None or not wanted:
            continue
        rows = frame if label else frame.withColumn("response", F.lit(""))
        parts.append(long_cells(rows, wanted))
    if report.grid is not None and any(x in m.RM_METRICS for x in metrics):
        parts.append(long_cells(_grid_responses(report.grid),
                                [x for x in metrics if x in m.RM_METRICS]))
    if not parts:
        raise ValueError("no metric applies to these tables")
    return reduce(DataFrame.unionByName, parts)

"""Summaries per breakdown cell.

Facts are first reduced to one row per respondent and response, on the map
side, before they are joined and fanned out.  A respondent with very many rows
therefore never reaches one task whole, and distinct respondents in a cell are
a plain row count.
"""

from __future__ import annotations

from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tabuloom.constants import DETRACTOR, PASSIVE, PROMOTER
from tabuloom.operators.breakdown import CELL_COLUMNS, breakdown

KEYS = ("study_id", "question_id")


def ratio(top: Column, bottom: Column) -> Column:
    """Quotient; NULL when the divisor is 0 or NULL."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def respondent_responses(facts: DataFrame, keys: Sequence[str] = KEYS,
                         response: str = "response") -> DataFrame:
    """Rows per respondent and response."""
    return facts.groupBy(*keys, "respondent_id", response).agg(F.count("*").alias("n_rows"))


def frequency(facts: DataFrame, dimension: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows, weighted rows, respondents and shares per cell and response.

    The base is the number of rows of the banner, not of respondents.
    """
    cells = breakdown(respondent_responses(facts, keys), dimension)
    weighted = F.col("n_rows") * F.col("weight")
    counts = cells.groupBy(*keys, *CELL_COLUMNS, "response").agg(
        F.sum("n_rows").alias("n"),
        F.sum(weighted).alias("n_weighted"),
        F.count("*").alias("base_respondents"),
    )
    return _with_totals(counts, [*keys, "banner"], {"n": "base", "n_weighted": "__weighted"}).withColumns({
        "pct": ratio(F.col("n"), F.col("base")),
        "pct_weighted": ratio(F.col("n_weighted"), F.col("__weighted")),
    }).drop("__weighted")


def _with_totals(cells: DataFrame, by: Sequence[str], sums: dict[str, str]) -> DataFrame:
    """Cells with sums over all cells that share `by`.

    An aggregate and a join instead of a window: the Total of a question with
    very many responses is not sorted in one task.  Both sides read the same
    exchange of cells.
    """
    totals = cells.groupBy(*by).agg(*[F.sum(c).alias(name) for c, name in sums.items()])
    return cells.join(totals, list(by))


def cell_bases(respondents_in_base: DataFrame, dimension: DataFrame,
               keys: Sequence[str] = KEYS) -> DataFrame:
    """Base and weighted base per banner from one row per (keys, respondent)."""
    return breakdown(respondents_in_base, dimension).groupBy(*keys, "banner").agg(
        F.count("*").alias("base"), F.sum("weight").alias("base_weighted")
    )


def _rm_shares(counts: DataFrame, bases: DataFrame, keys: Sequence[str]) -> DataFrame:
    banner = [*keys, "banner"]
    joined = _with_totals(counts, banner, {
        "mentions": "base_mentions", "mentions_weighted": "__weighted"})
    joined = joined.join(bases, banner, "left").fillna(0, ["base", "base_weighted"])
    zero = F.lit(0.0)
    mentions, weighted = F.col("base_mentions"), F.col("__weighted")
    return joined.withColumns({
        "pct_respondents": F.coalesce(ratio(F.col("respondents"), F.col("base")), zero),
        "pct_mentions": F.coalesce(ratio(F.col("mentions"), mentions), zero),
        "pct_respondents_weighted": F.coalesce(
            ratio(F.col("mentions_weighted"), F.col("base_weighted")), zero
        ),
        "pct_mentions_weighted": F.coalesce(ratio(F.col("mentions_weighted"), weighted), zero),
    }).drop("__weighted")


def multi_response(facts: DataFrame, dimension: DataFrame, base: DataFrame | None = None,
                   keys: Sequence[str] = KEYS) -> DataFrame:
    """Mentions and respondents per option (A2).

    `base` lists the eligible respondents of each question, so people who chose
    nothing count.  Questions without base rows fall back on their mentions.
    """
    mentions = respondent_responses(facts, keys)
    counts = breakdown(mentions, dimension).groupBy(*keys, *CELL_COLUMNS, "response").agg(
        F.sum("n_rows").alias("mentions"),
        F.count("*").alias("respondents"),
        F.sum(F.col("n_rows") * F.col("weight")).alias("mentions_weighted"),
    )
    members = mentions.select(*keys, "respondent_id").distinct()
    bases = cell_bases(members, dimension, keys)
    if base is not None:
        eligible = base.select(*keys, "respondent_id").distinct()
        bases = _prefer_declared(cell_bases(eligible, dimension, keys), bases, keys)
    return _rm_shares(counts, bases, keys)


def _prefer_declared(declared: DataFrame, answered: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Declared bases where a question has any, else the bases of its mentions.

    Decided on aggregated cells, so a question with very many rows is not a join key.
    """
    known = declared.select(*keys).distinct().withColumn("__declared", F.lit(True))
    stated = declared.withColumnsRenamed({"base": "__base", "base_weighted": "__weighted"})
    joined = answered.join(stated, [*keys, "banner"], "full_outer").join(known, list(keys), "left")
    use = F.col("__declared").isNotNull()
    return joined.select(
        *keys, "banner", F.when(use, F.col("__base")).otherwise(F.col("base")).alias("base"),
        F.when(use, F.col("__weighted")).otherwise(F.col("base_weighted")).alias("base_weighted"),
    )


def grid_multi_response(grid: DataFrame, dimension: DataFrame,
                        keys: Sequence[str] = KEYS) -> DataFrame:
    """Selected cells per entity and option; options without selection stay (A3).

    The base is respondents with any valid entity, not per entity.
    """
    rows = grid.groupBy(*keys, "respondent_id", "entity", "option").agg(
        F.sum(F.coalesce(F.col("selected").cast("int"), F.lit(0))).alias("n_selected"),
        F.max(F.coalesce(F.col("base_valid").cast("int"), F.lit(0))).alias("valid"),
    )
    counts = breakdown(rows, dimension).groupBy(*keys, *CELL_COLUMNS, "entity", "option").agg(
        F.sum("n_selected").alias("mentions"),
        F.count_if(F.col("n_selected") > 0).alias("respondents"),
        F.sum(F.col("n_selected") * F.col("weight")).alias("mentions_weighted"),
    )
    members = rows.filter("valid = 1").select(*keys, "respondent_id").distinct()
    return _rm_shares(counts, cell_bases(members, dimension, keys), keys)


def respondent_moments(scale: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One respondent's scale rows: sums, mean and squared deviations from it."""
    nps = F.col("nps_group")
    return scale.groupBy(*keys, "respondent_id").agg(
        F.count("value").alias("n_rows"),
        F.sum("value").alias("s1"),
        F.avg("value").alias("mean"),
        F.coalesce(F.var_pop("value") * F.count("value"), F.lit(0.0)).alias("m2"),
        F.sum("top2box").alias("top"), F.count("top2box").alias("top_n"),
        F.sum("bottombox").alias("low"), F.count("bottombox").alias("low_n"),
        F.count_if(nps == PROMOTER).alias("promoter_n"),
        F.count_if(nps == PASSIVE).alias("passive_n"),
        F.count_if(nps == DETRACTOR).alias("detractor_n"),
    )


def variance(n: Column, m2: Column) -> Column:
    """Sample variance from squared deviations; NULL below two rows."""
    return F.when(n > 1, m2 / F.when(n > 1, n - 1))


def merged_m2(groups: Column) -> Column:
    """Squared deviations of several groups (n, mean, m2) taken together."""
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def merge(a: Column, b: Column) -> Column:
        n = a["n"] + b["n"]
        step = b["mean"] - a["mean"]
        return F.struct(
            n.alias("n"), (a["mean"] + step * b["n"] / n).alias("mean"),
            (a["m2"] + b["m2"] + step * step * a["n"] * b["n"] / n).alias("m2"),
        )

    return F.aggregate(groups, start, merge, lambda x: x["m2"])


def cell_moments(scale: DataFrame, dimension: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Moments and NPS counts per banner: input of A4, A5, Z2 and Z3.

    Squared deviations are merged from respondents without a fixed anchor.  A
    respondent weighs as many rows as it has, and rows of equal weight have a
    plain variance: so respondents are grouped by the binary digits of their
    row number, and the groups of a cell, 63 at most, are merged exactly.
    """
    cells = breakdown(respondent_moments(scale, keys), dimension)
    w = F.col("weight")
    digit = F.explode_outer(F.when(F.col("n_rows") == 1, F.array(F.lit(0))).otherwise(F.expr(
        "filter(sequence(0, 62), b -> getbit(n_rows, b) = 1)")))
    rows = cells.select("*", digit.alias("digit"))
    once = F.coalesce(F.col("digit") == F.expr("bit_count((n_rows & -n_rows) - 1)"), F.lit(True))

    def total(value: Column) -> Column:
        return F.sum(F.when(once, value))

    grouped = F.col("promoter_n") + F.col("passive_n") + F.col("detractor_n")
    size = F.count("mean") * F.expr("shiftleft(1L, coalesce(digit, 0))")
    parts = rows.groupBy(*keys, *CELL_COLUMNS, "digit").agg(
        F.count_if(once & (F.col("n_rows") > 0)).alias("n"),
        total(F.col("n_rows")).alias("rows"), total(F.col("s1")).alias("s1"),
        total(F.col("m2")).alias("inner_m2"),
        size.cast("double").alias("size"), F.avg("mean").alias("mean"),
        (F.var_pop("mean") * size).alias("m2"),
        total(F.col("s1") * w).alias("sw"), total(F.col("n_rows") * w).alias("w"),
        total(F.col("top")).alias("top"), total(F.col("top_n")).alias("top_n"),
        total(F.col("low")).alias("low"), total(F.col("low_n")).alias("low_n"),
        F.count_if(once & (grouped > 0)).alias("nps_n"),
        total(F.col("promoter_n") * w).alias("p"), total(F.col("passive_n") * w).alias("q"),
        total(F.col("detractor_n") * w).alias("d"),
    )
    sums = ("n", "rows", "s1", "sw", "w", "top", "top_n", "low", "low_n", "nps_n", "p", "q", "d")
    group = F.when(F.col("size") > 0, F.struct("size", "mean", "m2"))
    merged = parts.groupBy(*keys, *CELL_COLUMNS).agg(
        *[F.sum(c).alias(c) for c in sums], F.sum("inner_m2").alias("inner_m2"),
        F.array_sort(F.collect_list(group)).alias("groups"),
    )
    groups = F.transform("groups", lambda g: F.struct(
        g["size"].alias("n"), g["mean"].alias("mean"), g["m2"].alias("m2")))
    return merged.select(
        *keys, *CELL_COLUMNS, *sums, (F.col("inner_m2") + merged_m2(groups)).alias("m2"))


def scale_summary(moments: DataFrame) -> DataFrame:
    """Respondents, mean, sd, weighted mean and boxes per banner (A4).

    Only the weighted mean uses weights; the others are plain row statistics.
    """
    n = F.col("rows")
    kept = [c for c in moments.columns
            if c not in ("rows", "s1", "m2", "sw", "w", "top", "top_n", "low", "low_n",
                         "nps_n", "p", "q", "d")]
    return moments.select(
        *kept,
        ratio(F.col("s1"), n).alias("mean"),
        F.sqrt(variance(n, F.col("m2"))).alias("sd"),
        ratio(F.col("sw"), F.col("w")).alias("mean_weighted"),
        ratio(F.col("top"), F.col("top_n")).alias("top2box"),
        ratio(F.col("low"), F.col("low_n")).alias("bottombox"),
    )


def nps_of(moments: DataFrame, keys: Sequence[str] = KEYS, nps_scale: int = 100) -> DataFrame:
    """A5 of the cells that have a grouped answer, from moments already there."""
    return _nps(moments.filter("nps_n > 0"), [*keys, *CELL_COLUMNS], nps_scale)


def nps_summary(scale: DataFrame, dimension: DataFrame, keys: Sequence[str] = KEYS,
                nps_scale: int = 100) -> DataFrame:
    """A5 from scale rows; `nps_of` serves it from moments already there."""
    cells = breakdown(respondent_moments(scale, keys), dimension)
    w = F.col("weight")
    grouped = F.col("promoter_n") + F.col("passive_n") + F.col("detractor_n")
    sums = cells.groupBy(*keys, *CELL_COLUMNS).agg(
        F.count_if(grouped > 0).alias("nps_n"),
        F.sum(F.col("promoter_n") * w).alias("p"),
        F.sum(F.col("passive_n") * w).alias("q"),
        F.sum(F.col("detractor_n") * w).alias("d"),
    )
    return _nps(sums, [*keys, *CELL_COLUMNS], nps_scale)


def _nps(sums: DataFrame, kept: Sequence[str], nps_scale: int) -> DataFrame:
    total = F.col("p") + F.col("q") + F.col("d")
    share = {name: F.coalesce(ratio(F.col(c), total), F.lit(0.0))
             for name, c in (("promoters", "p"), ("passives", "q"), ("detractors", "d"))}
    return sums.select(
        *kept, F.col("nps_n").alias("n"),
        *[col.alias(name) for name, col in share.items()],
        ((share["promoters"] - share["detractors"]) * nps_scale).alias("nps"),
    )


def mean_mentions(rm: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean number of mentions per respondent in the base (A24; our definition)."""
    return rm.groupBy(*keys, "banner").agg(
        F.sum("mentions").alias("mentions"), F.max("base").alias("base"),
        ratio(F.sum("mentions"), F.max("base")).alias("mean_mentions"),
    )


# Metric name -> Column over a summary frame; users may add their own.
METRICS: dict[str, Callable[[], Column]] = {
    "n": lambda: F.col("n"),
    "pct": lambda: F.col("pct") * 100,
    "n_weighted": lambda: F.col("n_weighted"),
    "pct_weighted": lambda: F.col("pct_weighted") * 100,
    "mentions": lambda: F.col("mentions"),
    "respondents": lambda: F.col("respondents"),
    "pct_respondents": lambda: F.col("pct_respondents") * 100,
    "pct_mentions": lambda: F.col("pct_mentions") * 100,
    "pct_respondents_weighted": lambda: F.col("pct_respondents_weighted") * 100,
    "pct_mentions_weighted": lambda: F.col("pct_mentions_weighted") * 100,
    "mean": lambda: F.col("mean"),
    "sd": lambda: F.col("sd"),
    "mean_weighted": lambda: F.col("mean_weighted"),
    "top2box": lambda: F.col("top2box") * 100,
    "bottombox": lambda: F.col("bottombox") * 100,
    "nps": lambda: F.col("nps"),
}
PERCENT_METRICS = ("pct", "pct_weighted", "pct_respondents", "pct_mentions",
                   "pct_respondents_weighted", "pct_mentions_weighted")
RM_METRICS = ("mentions", "respondents", "pct_respondents", "pct_mentions",
              "pct_respondents_weighted", "pct_mentions_weighted")
SCALAR_METRICS = ("mean", "sd", "mean_weighted", "top2box", "bottombox", "nps")

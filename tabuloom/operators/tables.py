"""Result tables: order, rank and layout."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabuloom.constants import TOTAL
from tabuloom.functions.text import column_type, to_number
from tabuloom.operators.metrics import (
    KEYS, METRICS, PERCENT_METRICS, RM_METRICS, SCALAR_METRICS, ratio,
)
from tabuloom.operators.ordering import position


def _option_order(options: DataFrame, keys: Sequence[str]) -> DataFrame:
    code = to_number(F.col("code"), column_type(options, "code"))
    order = to_number(F.col("ord"), column_type(options, "ord"))
    return options.groupBy(*keys, F.col("label").alias("response")).agg(
        F.min(order).alias("label_order"), F.min(code).alias("code_order"),
    )


def order_responses(cells: DataFrame, options: DataFrame | None, mode: str = "label",
                    keys: Sequence[str] = KEYS, count: str = "n") -> DataFrame:
    """`response_pos` per response: label order, code, or frequency in Total (O1).

    Known orders come first, then options without one, then other responses;
    ties are alphabetical on lower case.
    """
    total = F.sum(F.when(F.col("banner") == TOTAL, F.col(count)))
    responses = cells.groupBy(*keys, "response").agg(F.coalesce(total, F.lit(0)).alias("total"))
    name = F.lower("response")
    if mode == "frequency":
        return position(responses, keys, [-F.col("total"), name, F.col("response")], "response_pos")
    key = "code_order" if mode == "code" else "label_order"
    known = _option_order(options, keys).withColumn("is_option", F.lit(True))
    joined = responses.join(known, [*keys, "response"], "left")
    rank = F.when(F.col(key).isNotNull(), 0).when(F.col("is_option"), 1).otherwise(2)
    # The total decides nothing; with it all uses of the responses read the same columns.
    order = [rank, F.col(key), name, F.col("response"), F.col("total")]
    return position(joined, keys, order, "response_pos").select(
        *keys, "response", "total", "response_pos"
    )


def chart_order(cells: DataFrame, value: str = "pct", keys: Sequence[str] = KEYS) -> DataFrame:
    """Responses by their Total share, else by their largest share, descending (O3)."""
    is_total = F.col("banner") == TOTAL
    shares = cells.groupBy(*keys, "response").agg(
        F.max(F.when(is_total, F.col(value))).alias("__total"), F.max(value).alias("__largest"),
        F.max(is_total).alias("__has_total"))
    question = shares.groupBy(*keys).agg(F.max("__has_total").alias("__use_total"))
    scored = shares.join(question, list(keys)).select(
        *keys, "response", F.when(F.col("__use_total"), F.col("__total")).otherwise(F.col("__largest")).alias("score"))
    return position(scored, keys, [F.col("score").isNull(), -F.col("score"), F.col("response")], "chart_pos")


def grid_rank(grid: DataFrame, by: str = "entity", banner: Column | None = None,
              keys: Sequence[str] = KEYS) -> DataFrame:
    """Dense rank of options within an entity, or of entities within an option.

    Ranks on the respondent share of the Total column.
    """
    chosen = grid.filter((F.col("banner") == TOTAL) if banner is None else banner)
    order = Window.partitionBy(*keys, by).orderBy(F.col("pct_respondents").desc())
    return chosen.withColumn("rank", F.dense_rank().over(order))


def with_lookups(cells: DataFrame, *tables: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """`cells` with what question-level tables say of their question.

    Of a table with several rows for a question the least counts, so cells are
    never multiplied; a question that a table does not have gets nulls.  Columns
    that the cells have already are not replaced.
    """
    for table in tables:
        more = [c for c in table.columns if c not in cells.columns]
        one = table.groupBy(*keys).agg(F.min(F.struct(*more)).alias("__found"))
        cells = cells.join(one, list(keys), "left").select(*cells.columns, "__found.*")
    return cells


def long_cells(cells: DataFrame, metrics: Sequence[str], keys: Sequence[str] = KEYS,
               label: str = "response") -> DataFrame:
    """One row per (response, banner, metric); percentages are multiplied by 100 here."""
    items = F.array(*[
        F.struct(F.lit(m).alias("metric"), METRICS[m]().cast("double").alias("value"))
        for m in metrics
    ])
    return cells.select(*keys, label, "banner", F.inline(items))


def report_table(
    banners: Sequence[str], response_cells: DataFrame | None, metrics: Sequence[str],
    scale: DataFrame | None = None, nps: DataFrame | None = None,
    letters: DataFrame | None = None, keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Rows are responses, columns `banner | metric`; scalar rows use `banner | Valor`.

    `banners` is the explicit column list, which keeps the pivot to one pass.
    Absent response cells are 0, absent scalars NULL.  `letters` adds
    `banner | Sig.` after each banner but Total (T2).
    """
    response_metrics = [m for m in metrics if m not in SCALAR_METRICS]
    scalars = [m for m in metrics if m in SCALAR_METRICS]
    parts, columns = [], []
    if response_cells is not None and response_metrics:
        parts.append(long_cells(response_cells, response_metrics, keys).withColumn("kind", F.lit(0)))
    for frame, names in ((scale, [m for m in scalars if m != "nps"]),
                         (nps, [m for m in scalars if m == "nps"])):
        if frame is not None and names:
            rows = long_cells(frame.withColumn("response", F.lit("")), names, keys)
            # Row titles of scalar metrics.
            titles = {"mean": "Media", "sd": "Desviación estándar", "top2box": "Top2Box",
                      "bottombox": "BottomBox", "nps": "NPS",
                      "mean_weighted": "Media ponderada"}
            title = F.coalesce(*[
                F.when(F.col("metric") == m, F.lit(titles[m])) for m in names
            ])
            parts.append(rows.withColumn("response", title).withColumn(
                "metric", F.lit("Valor")).withColumn("kind", F.lit(1)))
    long = parts[0]
    for part in parts[1:]:
        long = long.unionByName(part)
    cells, has_scalars = [], any(m for m in scalars)
    value = F.col("value")
    for banner in banners:
        for metric in response_metrics:
            name = f"{banner} | {metric}"
            hit = (F.col("banner") == banner) & (F.col("metric") == metric)
            cells.append(F.max(F.when(hit, value)).alias(name))
            columns.append((name, True))
        if has_scalars:
            name = f"{banner} | Valor"
            hit = (F.col("banner") == banner) & (F.col("metric") == "Valor")
            cells.append(F.max(F.when(hit, value)).alias(name))
            columns.append((name, False))
    wide = long.groupBy(*keys, "kind", "response").agg(*cells)
    filled = wide.select(*keys, "kind", "response", *[
        (F.when(F.col("kind") == 0, F.coalesce(F.col(f"`{n}`"), F.lit(0.0)))
         if is_response else F.col(f"`{n}`")).alias(n)
        for n, is_response in columns
    ])
    if letters is None:
        return filled
    marks = letters.groupBy(*keys, "response").agg(*[
        F.max(F.when(F.col("banner") == b, F.col("letters"))).alias(f"{b} | Sig.")
        for b in banners if b != TOTAL
    ])
    joined = filled.join(marks, [*keys, "response"], "left")
    ordered = []
    for banner in banners:
        ordered += [n for n, _ in columns if n.rsplit(" | ", 1)[0] == banner]
        if banner != TOTAL:
            ordered.append(f"{banner} | Sig.")
    return joined.select(*keys, "kind", "response", *[
        (F.coalesce(F.col(f"`{n}`"), F.lit("")) if n.endswith(" | Sig.") else F.col(f"`{n}`"))
        .alias(n) for n in ordered
    ])


def identity_rows(facts: DataFrame, respondents: DataFrame, banners: Sequence[str],
                  keys: Sequence[str] = KEYS) -> DataFrame:
    """Distinct (banner, response, variable, code, raw banner value) of a report.

    `facts` holds response, variable and code; with two or more breakdown
    variables the identity is marked unsupported.
    """
    items = facts.select(*keys, "respondent_id", "response", "variable", "code").distinct()
    if not banners:
        return items.select(*keys, F.lit(TOTAL).alias("banner"), "response", "variable", "code",
                            F.lit("").alias("banner_variable"), F.lit("").alias("banner_raw_value")
                            ).distinct()
    from tabuloom.operators.breakdown import explode_cells

    single = len(banners) == 1
    raw = F.col(banners[0]).cast("string") if single else F.lit("")
    name = F.lit(banners[0] if single else "UNSUPPORTED_MULTIDIMENSION")
    attributes = respondents.select(
        "study_id", "respondent_id", raw.alias("raw"), "banner_cells"
    )
    joined = explode_cells(items.join(attributes, ["study_id", "respondent_id"]))
    member = F.col("banner") != TOTAL
    return joined.select(
        *keys, "banner", "response", "variable", "code",
        F.when(member, name).otherwise("").alias("banner_variable"),
        F.when(member, F.col("raw")).otherwise("").alias("banner_raw_value"),
    ).distinct()


def split_grid_response(table: DataFrame) -> DataFrame:
    """Entity and option of `entity | option`, at the first separator only."""
    parts = F.split("response", r" \| ", 2)
    return table.withColumns({
        "entity": parts[0], "option": F.coalesce(F.try_element_at(parts, F.lit(2)), "response"),
    })


def canonical_projection(values: DataFrame, bases: DataFrame, slices: DataFrame,
                         tokens: DataFrame) -> DataFrame:
    """One row per value with its slice, base and letters (T4).

    `values` carries base_id and slice_id, `tokens` (study_id, value_id or slice_id
    with the response, letters) is joined on the columns it shares with values.
    """
    shared = [c for c in tokens.columns if c != "letters"]
    return (
        values.join(bases.drop("slice_id"), ["study_id", "base_id"], "left")
        .join(slices, ["study_id", "slice_id"], "left")
        .join(tokens, shared, "left")
        .withColumn("letters", F.coalesce("letters", F.lit("")))
    )

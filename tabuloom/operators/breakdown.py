"""Breakdown columns: headings, fan-out and display order.

The cells of a respondent are computed once on the respondent dimension as a
small array.  Facts are joined to that dimension a single time and exploded,
so every breakdown variable shares one scan and one join.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabuloom.constants import NO_DATA, TOTAL
from tabuloom.functions.predicates import filter_condition
from tabuloom.functions.text import code_text, column_type, to_number

STUDY = "study_id"


def value_labels(options: DataFrame) -> DataFrame:
    """First non-blank label per (study, variable, code)."""
    code = code_text(F.col("code"), column_type(options, "code"))
    label = F.trim(F.col("label"))
    return (
        options.select(STUDY, "variable", code.alias("code"), label.alias("label"), "ord")
        .filter((F.col("code") != "") & (F.col("label") != ""))
        .groupBy(STUDY, "variable", "code")
        .agg(F.min(F.struct("ord", "label")).getField("label").alias("label"))
    )


def heading(code: Column, label: Column) -> Column:
    """`code | label`; the label is hidden when blank or equal to the code."""
    shown = (label != "") & (label != code)
    return F.when(code == "", F.lit(NO_DATA)).when(
        shown, F.concat(code, F.lit(" | "), label)
    ).otherwise(code)


def normalize_mode(mode: object) -> str:
    text = str(mode or "").strip().lower().replace("-", " ")
    # Accepted names of the separate mode.
    names = {"separate", "separado", "separados", "no anidado", "no anidados", "non nested"}
    return "separate" if text in names else "nested"


def existing_variables(banners: str | Sequence[str] | None, columns: Sequence[str]) -> list[str]:
    if not banners:
        return []
    names = [banners] if isinstance(banners, str) else list(banners)
    names = [str(n).strip() for n in names if str(n).strip()]
    return [n for n in dict.fromkeys(names) if n in columns]


def _cell(banner: Column, group: str, position: int) -> Column:
    return F.struct(
        banner.alias("banner"), F.lit(group).alias("banner_group"),
        F.lit(position).alias("group_pos"),
    )


def with_banner_cells(
    respondents: DataFrame,
    banners: str | Sequence[str] | None,
    options: DataFrame | None = None,
    mode: str = "nested",
) -> DataFrame:
    """Add `banner_cells`: Total first, then one nested or k separate cells.

    Without a breakdown the only cell is Total.
    """
    names = existing_variables(banners, respondents.columns)
    total = _cell(F.lit(TOTAL), "", -1)
    if not names:
        return respondents.withColumn("banner_cells", F.array(total))
    labels = value_labels(options) if options is not None else None
    result, helpers, headings = respondents, [], []
    for i, name in enumerate(names):
        code = f"__code_{i}"
        result = result.withColumn(code, code_text(F.col(name), column_type(respondents, name)))
        helpers.append(code)
        text = F.lit("")
        if labels is not None:
            label = f"__label_{i}"
            side = labels.filter(F.col("variable") == name).select(
                STUDY, F.col("code").alias(code), F.col("label").alias(label)
            )
            result = result.join(side, [STUDY, code], "left")
            helpers.append(label)
            text = F.coalesce(F.col(label), F.lit(""))
        headings.append(heading(F.col(code), text))
    cells = [total]
    if normalize_mode(mode) == "separate" and len(names) > 1:
        for i, (name, text) in enumerate(zip(names, headings)):
            cells.append(_cell(F.concat(F.lit(f"{name}: "), text), name, i))
    elif len(names) == 1:
        cells.append(_cell(headings[0], "", 0))
    else:
        banner = F.concat_ws(" / ", *[
            F.concat(F.lit(f"{name}: "), text) for name, text in zip(names, headings)
        ])
        cells.append(_cell(banner, "", 0))
    return result.withColumn("banner_cells", F.array(*cells)).drop(*helpers)


CELL_COLUMNS = ("banner", "banner_group", "group_pos")


def explode_cells(df: DataFrame) -> DataFrame:
    """One row per cell of the respondent.

    The array is never empty.  The outer form keeps the optimizer from adding a
    filter that would build every array a second time below the join.
    """
    kept = [c for c in df.columns if c != "banner_cells"]
    exploded = df.select(*kept, F.explode_outer("banner_cells").alias("__cell"))
    return exploded.select(*kept, *[F.col(f"__cell.{c}").alias(c) for c in CELL_COLUMNS])


def respondent_dimension(
    respondents: DataFrame,
    banners: str | Sequence[str] | None = None,
    options: DataFrame | None = None,
    mode: str = "nested",
    filters: Mapping[str, Sequence[object]] | None = None,
    weight: str | None = None,
    extra: Sequence[str] = (),
    missing_weight: str = "one",
) -> DataFrame:
    """Selected respondents with their weight and cells.

    A missing or non-numeric weight is 1.0, or with missing_weight='exclude'
    NULL, which leaves the respondent out of weighted sums.  Without a weight
    every respondent has 1.0.
    """
    selected = respondents.filter(filter_condition(respondents, filters))
    value = F.lit(1.0)
    if weight and weight in respondents.columns:
        value = to_number(F.col(weight), column_type(respondents, weight))
        if missing_weight == "one":
            value = F.coalesce(value, F.lit(1.0))
    cells = with_banner_cells(selected, banners, options, mode)
    return cells.select(
        STUDY, "respondent_id", *extra, value.alias("weight"), "banner_cells"
    )


def breakdown(facts: DataFrame, dimension: DataFrame) -> DataFrame:
    """Keep facts of selected respondents and fan them out over their cells."""
    return explode_cells(facts.join(dimension, [STUDY, "respondent_id"], "inner"))


def banner_order(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Display position of each banner: Total, then blocks, numbers before texts.

    Total has position 0, so the first compared column has position 1.
    """
    distinct = cells.select(*keys, *CELL_COLUMNS).distinct()
    # The heading without its variable, up to the label.
    group = F.col("banner_group")
    shown = F.when(group == "", F.col("banner")).otherwise(
        F.substring("banner", F.length(group) + 3, F.length("banner"))
    )
    code = F.element_at(F.split(shown, r" \| "), 1)
    number = to_number(code)
    order = Window.partitionBy(*keys).orderBy(
        "group_pos", number.isNull(), number, F.lower(code), "banner"
    )
    # Without a Total row the positions still start at 1.
    has_total = F.max(F.when(F.col("group_pos") == -1, 1).otherwise(0)).over(
        Window.partitionBy(*keys)
    )
    return distinct.select(
        *keys, "banner", "banner_group",
        (F.row_number().over(order) - has_total).alias("banner_pos"),
    )


def expand_slices(
    respondents: DataFrame, variable: str | None, members: Sequence[tuple[str, object, str]],
    filters: Sequence[tuple[str, Sequence[object]]] = (),
) -> DataFrame:
    """Canonical slices (F9, E3): raw comparison, declared order, no Total with a banner.

    `members` holds (member_id, raw_value, label).  A respondent outside every
    member is in no slice.
    """
    keep = F.lit(True)
    for name, allowed in filters:
        keep = keep & F.coalesce(F.col(name).isin(*allowed), F.lit(False))
    selected = respondents.filter(keep)
    if variable is None:
        label = "TOTAL" if not filters else "FILTERED"
        return selected.withColumns({
            "slice_id": F.lit(label), "slice_label": F.lit(label), "slice_order": F.lit(0),
        })
    slices = F.array(*[
        F.when(F.col(variable) == raw, F.struct(
            F.lit(member).alias("slice_id"), F.lit(label).alias("slice_label"),
            F.lit(i).alias("slice_order"),
        ))
        for i, (member, raw, label) in enumerate(members)
    ])
    exploded = selected.withColumn(
        "__slice", F.explode(F.filter(slices, lambda s: s.isNotNull()))
    )
    return exploded.select(*respondents.columns, "__slice.*")

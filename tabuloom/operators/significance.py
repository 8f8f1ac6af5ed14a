"""Significance tests on aggregated cells.

Everything here runs on summary rows: one per response and breakdown column of a
question, however many respondents there are.
"""

from __future__ import annotations

from statistics import NormalDist
from typing import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabuloom.constants import MIN_CANONICAL_BASE, MIN_EXPECTED_COUNT, TOTAL
from tabuloom.functions.pvalues import normal_two_sided, student_critical, student_two_sided
from tabuloom.operators.breakdown import banner_order
from tabuloom.operators.metrics import KEYS, ratio, variance


def column_letter(position: Column) -> Column:
    """A to Z, then A1, A2 and so on, from a position that starts at 1."""
    letters = F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), position, F.lit(1))
    return F.when(position <= 26, letters).otherwise(
        F.concat(F.lit("A"), (position - 26).cast("string"))
    )


def spreadsheet_letter(position: Column) -> Column:
    """A to Z, AA to ZZ, AAA to ZZZ from a position that starts at 1."""
    def char(n: Column) -> Column:
        return F.char(F.lit(65) + n)

    def div(n: Column, d: int) -> Column:
        return F.floor(n / d).cast("int")

    n = position - 1
    two, three = n - 26, n - 26 - 26 * 26
    return (
        F.when(n < 26, char(n))
        .when(two < 676, F.concat(char(div(two, 26)), char(two % 26)))
        .otherwise(F.concat(
            char(div(three, 676)), char(div(three, 26) % 26), char(three % 26)
        ))
    )


def pooled_z(x1: Column, n1: Column, x2: Column, n2: Column) -> Column:
    """Two-proportion z; NULL when the pooled share has no variance."""
    pooled = ratio(x1 + x2, n1 + n2)
    spread = pooled * (1 - pooled) * (ratio(F.lit(1), n1) + ratio(F.lit(1), n2))
    return F.when(spread > 0, (ratio(x1, n1) - ratio(x2, n2)) / F.sqrt(spread))


def proportion_letters(
    cells: DataFrame, count: str = "n", base: str = "base", share: str = "pct",
    confidence: float = 0.95, min_base: int = 30, keys: Sequence[str] = KEYS,
    response: Sequence[str] = ("response",),
) -> DataFrame:
    """Letters of the columns a column is significantly higher than.

    The columns of a response and block are one array, compared inside the row,
    so no pair rows are made.  `cells` needs the breakdown columns; Total is
    never tested.
    Returns (keys, response, banner, letters).
    """
    critical = NormalDist().inv_cdf(1 - (1 - confidence) / 2)

    def higher(a: Column, b: Column) -> Column:
        z = pooled_z(a["x"], a["n"], b["x"], b["n"])
        tested = (a["n"] >= min_base) & (b["n"] >= min_base)
        return F.coalesce(tested & (F.abs(z) > critical) & (a["p"] > b["p"]), F.lit(False))

    measures = {"x": F.col(count).cast("double"), "n": F.col(base).cast("double"), "p": F.col(share)}
    return compared_columns(cells, measures, higher, keys, response)


def compared_columns(cells: DataFrame, measures: Mapping[str, Column],
                     higher: Callable[[Column, Column], Column], keys: Sequence[str],
                     response: Sequence[str]) -> DataFrame:
    """Letters of the columns of its block that `higher` puts a column above."""
    order = banner_order(cells, keys)
    columns = cells.join(order, [*keys, "banner", "banner_group"]).filter(
        F.col("banner") != TOTAL
    )
    column = F.struct(F.col("banner_pos").alias("pos"), "banner",
                      *[value.alias(name) for name, value in measures.items()])
    blocks = columns.groupBy(*keys, *response, "banner_group").agg(
        F.array_sort(F.collect_list(column)).alias("columns"))

    def marked(a: Column) -> Column:
        lower = F.filter("columns", lambda b: higher(a, b))
        letters = F.transform(lower, lambda b: column_letter(b["pos"]))
        return F.struct(a["banner"].alias("banner"), a["pos"].alias("banner_pos"),
                        F.array_join(letters, "").alias("letters"))

    rows = blocks.select(*keys, *response, F.explode(F.transform("columns", marked)).alias("m"))
    return rows.select(*keys, *response, "m.banner", "m.banner_pos", "m.letters")


def column_pairs(cells: DataFrame, values: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Pairs of breakdown columns of one group, left before right."""
    order = banner_order(cells, keys)
    columns = cells.join(order, [*keys, "banner", "banner_group"]).filter(
        F.col("banner") != TOTAL
    ).select(*keys, "banner_group", "banner", "banner_pos", *values)
    names = ("banner", "banner_pos", *values)
    left = columns.withColumnsRenamed({c: f"{c}_l" for c in names})
    right = columns.withColumnsRenamed({c: f"{c}_r" for c in names})
    return left.join(right, [*keys, "banner_group"]).filter("banner_pos_l < banner_pos_r")


def welch_pairs(moments: DataFrame, confidence: float = 0.95, min_base: int = 30,
                keys: Sequence[str] = KEYS, with_p: bool = True) -> DataFrame:
    """Welch t of every pair of columns (Z2).  The base counts rows.

    When both variances are 0 the p-value is 0 for different means, else 1.
    """
    stats = moments.withColumns({
        "mean": ratio(F.col("s1"), F.col("rows")),
        "var": variance(F.col("rows"), F.col("m2")),
    })
    pairs = column_pairs(stats, ("rows", "mean", "var"), keys)
    vl, vr = ratio(F.col("var_l"), F.col("rows_l")), ratio(F.col("var_r"), F.col("rows_r"))
    flat = (F.col("var_l") == 0) & (F.col("var_r") == 0)
    tested = (F.col("rows_l") >= min_base) & (F.col("rows_r") >= min_base)
    result = pairs.filter(tested).withColumns({
        "difference": F.col("mean_l") - F.col("mean_r"),
        "flat": flat,
        "t": ratio(F.col("mean_l") - F.col("mean_r"), F.sqrt(vl + vr)),
        "df": ratio(
            (vl + vr) * (vl + vr),
            ratio(vl * vl, F.col("rows_l") - 1) + ratio(vr * vr, F.col("rows_r") - 1),
        ),
    })
    if not with_p:
        return result
    p = F.when(F.col("flat"), F.when(F.col("difference") != 0, 0.0).otherwise(1.0)).otherwise(
        student_two_sided("t", "df")
    )
    return result.withColumn("p_value", p).withColumn(
        "significant", F.coalesce(F.col("p_value") < 1 - confidence, F.lit(False))
    )


def mean_letters(moments: DataFrame, confidence: float = 0.95, min_base: int = 30,
                 keys: Sequence[str] = KEYS) -> DataFrame:
    """Letters of the row 'Media' (Z2), of the columns that have any.

    As in Z1 the columns of a block meet in one array; Welch's t is compared
    with Student's critical value, so neither pair rows nor Python are needed.
    """
    alpha = 1 - confidence

    def higher(a: Column, b: Column) -> Column:
        spread = a["v"] + b["v"]
        t = (a["mean"] - b["mean"]) / F.sqrt(spread)
        df = spread * spread / (a["v"] * a["v"] / (a["n"] - 1) + b["v"] * b["v"] / (b["n"] - 1))
        tested = (a["n"] >= min_base) & (b["n"] >= min_base) & (a["mean"] > b["mean"])
        beyond = F.when(spread > 0, t > student_critical(df, alpha)).otherwise(True)
        return F.coalesce(F.when(tested & spread.isNotNull(), beyond), F.lit(False))

    n = F.col("rows").cast("double")
    measures = {"n": n, "mean": ratio(F.col("s1"), F.col("rows")),
                "v": ratio(variance(F.col("rows"), F.col("m2")), n)}
    named = moments.withColumn("response", F.lit("Media"))
    letters = compared_columns(named, measures, higher, keys, ("response",))
    return letters.filter(F.col("letters") != "").select(*keys, "response", "banner", "letters")


def box_letters(moments: DataFrame, box: str, confidence: float = 0.95, min_base: int = 30,
                keys: Sequence[str] = KEYS) -> DataFrame:
    """Z1 on the sum of one box; the base is its non-null rows (Z3)."""
    top = box == "top2box"
    x, n = ("top", "top_n") if top else ("low", "low_n")
    cells = moments.withColumns({
        "share": ratio(F.col(x), F.col(n)),
        "response": F.lit("Top2Box" if top else "BottomBox"),
    })
    return proportion_letters(cells, x, n, "share", confidence, min_base, keys)


def combine_letters(tables: Sequence[DataFrame], keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per response and column; the first table that has the response wins."""
    columns = [*keys, "response", "banner", "letters"]
    stacked = None
    for i, table in enumerate(tables):
        part = table.select(*columns).withColumn("priority", F.lit(i))
        stacked = part if stacked is None else stacked.unionByName(part)
    best = stacked.groupBy(*keys, "response").agg(F.min("priority").alias("priority"))
    return stacked.join(best, [*keys, "response", "priority"]).select(*columns)


def column_legend(cells: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Letter of every compared column."""
    return banner_order(cells, keys).filter(F.col("banner") != TOTAL).select(
        *keys, "banner", "banner_pos", column_letter(F.col("banner_pos")).alias("letter")
    )


def low_bases(cells: DataFrame, min_base: int = 30, keys: Sequence[str] = KEYS) -> DataFrame:
    """Columns whose largest base is below the minimum."""
    return cells.filter(F.col("banner") != TOTAL).groupBy(*keys, "banner").agg(
        F.max("base").alias("base")
    ).filter(F.col("base") < min_base)


def repeated_persons(facts: DataFrame, respondents: DataFrame,
                     keys: Sequence[str] = KEYS) -> DataFrame:
    """Evaluations, persons and whether independent tests must be left out."""
    answered = facts.select(*keys, "respondent_id").distinct()
    persons = answered.join(
        respondents.select("study_id", "respondent_id", "person_id"),
        ["study_id", "respondent_id"],
    ).groupBy(*keys, "person_id").agg(F.count("*").alias("n"))
    return persons.groupBy(*keys).agg(
        F.sum("n").alias("evaluations"), F.count("*").alias("persons"),
        (F.max("n") > 1).alias("suppressed"),
    )


def holm(pairs: DataFrame, family: Sequence[str], p: str = "p_value",
         order: Sequence[str] = ("pair_index",)) -> DataFrame:
    """Holm step-down: running maximum of (m - rank) * p inside a family."""
    tested = F.col(p).isNotNull()
    whole = Window.partitionBy(*family)
    ranked = whole.orderBy(F.col(p).asc_nulls_last(), *order)
    m = F.count(p).over(whole)
    scaled = F.least(F.lit(1.0), (m - F.row_number().over(ranked) + 1) * F.col(p))
    running = ranked.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return pairs.withColumn("__scaled", F.when(tested, scaled)).withColumn(
        "p_adjusted", F.when(tested, F.max("__scaled").over(running))
    ).drop("__scaled")


def proportion_family(
    comparisons: DataFrame, family: Sequence[str], confidence: float = 0.95,
    order: Sequence[str] = ("pair_index",),
) -> DataFrame:
    """Canonical family of two-proportion tests with Holm adjustment.

    `comparisons` holds one row per requested pair: x_l, n_l, x_r, n_r and the
    flags weighted, independent and binary.
    """
    if confidence not in (0.90, 0.95, 0.99):
        raise ValueError("confidence must be 0.90, 0.95 or 0.99")
    alpha = {0.90: 0.10, 0.95: 0.05, 0.99: 0.01}[confidence]
    xl, nl, xr, nr = (F.col(c).cast("double") for c in ("x_l", "n_l", "x_r", "n_r"))
    pooled = ratio(xl + xr, nl + nr)
    expected = F.least(nl * pooled, nl * (1 - pooled), nr * pooled, nr * (1 - pooled))
    z = pooled_z(xl, nl, xr, nr)
    reason = (
        F.when(F.col("weighted"), "UNSUPPORTED_WEIGHTED_INFERENCE")
        .when(~F.col("independent"), "UNSUPPORTED_SAMPLE_RELATIONSHIP")
        .when(~F.col("binary"), "UNSUPPORTED_NONBINARY_OUTCOME")
        .when(F.least(nl, nr) < MIN_CANONICAL_BASE, "INELIGIBLE_MINIMUM_BASE")
        .when(expected < MIN_EXPECTED_COUNT, "INELIGIBLE_EXPECTED_COUNT")
        .when(z.isNull(), "INELIGIBLE_DEGENERATE_VARIANCE")
    )
    tested = comparisons.withColumn("reason", reason).withColumns({
        "z": F.when(F.col("reason").isNull(), z),
        "p_value": F.when(F.col("reason").isNull(), normal_two_sided(z)),
    })
    adjusted = holm(tested, family, order=order)
    difference = ratio(xl, nl) - ratio(xr, nr)
    return adjusted.withColumns({
        "status": F.when(F.col("reason").startswith("INELIGIBLE_"), "INELIGIBLE")
        .when(F.col("reason").isNotNull(), "UNSUPPORTED")
        .when(F.col("p_adjusted") < alpha, "SIGNIFICANT").otherwise("NOT_SIGNIFICANT"),
        "direction": F.when(F.col("p_value").isNull(), None)
        .when(difference > 0, "LEFT_GREATER").when(difference < 0, "RIGHT_GREATER"),
        "reason": F.coalesce(F.col("reason"), F.lit("ELIGIBLE")),
    })


def request_comparisons(cells: DataFrame, pairs: DataFrame, slice_col: str, count: str, base: str,
                        keys: Sequence[str]) -> DataFrame:
    """Bring the two cells of each requested pair together by two equi-joins."""
    def side(suffix: str) -> DataFrame:
        return cells.select(
            *keys, F.col(slice_col).alias(f"slice_{suffix}"),
            F.col(count).alias(f"x_{suffix}"), F.col(base).alias(f"n_{suffix}"),
        )
    return side("l").join(pairs, ["slice_l"]).join(side("r"), [*keys, "slice_r"])


def canonical_pair_order(relations: DataFrame) -> DataFrame:
    """Swap sides so that the smaller slice id is on the left."""
    swap = F.col("slice_l") > F.col("slice_r")
    sides = [c[:-2] for c in relations.columns if c.endswith("_l")]
    swapped = {}
    for name in sides:
        left, right = F.col(f"{name}_l"), F.col(f"{name}_r")
        swapped[f"{name}_l"] = F.when(swap, right).otherwise(left)
        swapped[f"{name}_r"] = F.when(swap, left).otherwise(right)
    if "direction" in relations.columns:
        flipped = F.when(F.col("direction") == "LEFT_GREATER", "RIGHT_GREATER").when(
            F.col("direction") == "RIGHT_GREATER", "LEFT_GREATER"
        )
        swapped["direction"] = F.when(swap, flipped).otherwise(F.col("direction"))
    if "z" in relations.columns:
        swapped["z"] = F.when(swap, -F.col("z")).otherwise(F.col("z"))
    return relations.withColumns(swapped)


def slice_letters(slices: DataFrame, keys: Sequence[str] = ("study_id",)) -> DataFrame:
    """Letters of canonical slices by dimension, member and label."""
    order = Window.partitionBy(*keys).orderBy("dimension", "member", "slice_label")
    return slices.withColumn("letter", spreadsheet_letter(F.row_number().over(order)))


def relation_letters(relations: DataFrame, letters: DataFrame, by: Sequence[str],
                     keys: Sequence[str] = ("study_id",)) -> DataFrame:
    """Mark both columns of every significant pair."""
    significant = relations.filter(F.col("status") == "SIGNIFICANT")
    both = significant.select(*by, F.explode(F.array(
        F.struct(F.col("slice_l").alias("slice_id"), F.col("slice_r").alias("other")),
        F.struct(F.col("slice_r").alias("slice_id"), F.col("slice_l").alias("other")),
    )).alias("m")).select(*by, "m.*")
    named = both.join(
        letters.select(*keys, F.col("slice_id").alias("other"), "letter"), [*keys, "other"]
    )
    return named.groupBy(*by, "slice_id").agg(
        F.array_join(F.array_sort(F.collect_set("letter")), ",").alias("letters")
    )

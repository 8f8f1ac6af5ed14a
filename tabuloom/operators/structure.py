"""Response states, ledgers and canonical metrics.

A record is one (respondent, binding).  Ledgers reduce records to one row per
option key, then per respondent, then per structure, so the distinct counts of
a whole structure never meet in one task.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tabuloom.operators.metrics import ratio

RM_TYPES = ("RM", "GRID_RM", "LOOP_RM")
CATEGORY_TYPES = ("RU", "GRID_ESCALA", "LOOP_RU")
STRUCTURE = ("study_id", "structure_id")
SCOPES = {"PARENT_RM": "structure_id", "ROW": "row_id", "ENTITY": "entity_id",
          "LOOP_INSTANCE": "loop_id"}
SCOPE_IDS = ("row_id", "entity_id", "loop_id")


def response_records(cells: DataFrame, bindings: DataFrame, value_rules: DataFrame) -> DataFrame:
    """Classify every cell of a structure.

    `bindings`: study_id, structure_id, structure_type, variable, binding_id,
    row_id, column_id, option_id, loop_id, entity_id, missing_is_unanswered.
    `value_rules`: study_id, structure_id, code, role ('missing', 'selected',
    'not_selected' or 'category'), category_id, ord.
    `cells` may carry a Boolean `applicable`; without it every cell applies.
    """
    if "applicable" not in cells.columns:
        cells = cells.withColumn("applicable", F.lit(True))
    role = F.col("role")
    first_category = F.min(F.when(role == "category", F.struct("ord", "category_id")))
    rules = value_rules.groupBy(*STRUCTURE, "code").agg(
        F.max((role == "missing").cast("int")).alias("is_missing"),
        F.max((role == "selected").cast("int")).alias("is_selected"),
        F.max((role == "not_selected").cast("int")).alias("is_not_selected"),
        first_category.getField("category_id").alias("rule_category"),
    )
    rows = cells.join(bindings, ["study_id", "variable"]).join(
        rules, [*STRUCTURE, "code"], "left"
    )
    blank = F.col("value").isNull() | (F.trim("value") == "")
    multi, numeric = F.col("structure_type").isin(*RM_TYPES), F.col("structure_type") == "LOOP_NUMERICO"
    unanswered = F.coalesce(F.col("missing_is_unanswered"), F.lit(False))
    state = (
        F.when(~F.col("applicable"), "structural_missing")
        .when(blank, F.when(unanswered, "not_answered").otherwise("ordinary_missing"))
        .when(F.col("is_missing") == 1, "ordinary_missing")
        .when(multi, F.when(F.col("is_selected") == 1, "selected")
              .when(F.col("is_not_selected") == 1, "not_selected")
              .otherwise("invalid_out_of_domain"))
        .when(numeric, F.when(F.col("number").isNotNull(), "answered")
              .otherwise("invalid_out_of_domain"))
        .when(F.col("rule_category").isNotNull(), "valid_category")
        .otherwise("invalid_out_of_domain")
    )
    return rows.withColumn("response_state", state).withColumn(
        "category_id", F.when(F.col("response_state") == "valid_category", F.col("rule_category"))
    ).drop("is_missing", "is_selected", "is_not_selected", "rule_category",
           "missing_is_unanswered")


def is_state(*states: str) -> Column:
    return F.col("response_state").isin(*states)


def option_key() -> Column:
    return F.coalesce("option_id", "column_id", "category_id", "binding_id")


def _per_option(records: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First reduction: one row per (respondent, row, entity, loop, option).

    Bindings of a numeric loop without iterations are instances of their own.
    """
    multi = F.col("structure_type").isin(*RM_TYPES, *CATEGORY_TYPES)
    return records.groupBy(
        *keys, "structure_type", "respondent_id", *SCOPE_IDS, option_key().alias("option_key"),
        F.when(~multi & F.col("loop_id").isNull(), F.col("binding_id")).alias("instance"),
    ).agg(
        F.count_if(F.col("applicable")).alias("n_applicable"),
        F.count_if(is_state("selected")).alias("n_selected"),
        F.count_if(is_state("not_selected")).alias("n_not_selected"),
        F.count_if(is_state("ordinary_missing", "not_answered")).alias("n_missing"),
        F.count_if(is_state("structural_missing")).alias("n_structural"),
        F.count_if(is_state("invalid_out_of_domain")).alias("n_invalid"),
    )


COUNTS = ("n_selected", "n_not_selected", "n_missing", "n_structural", "n_invalid")


def _people(records: DataFrame, keys: Sequence[str], dealt: bool = False) -> DataFrame:
    """One row per respondent and structure, with whether it repeats a loop."""
    options = _per_option(records, keys)
    if not dealt:
        # From here on a respondent has at most one row per declared option key, so
        # one shuffle by respondent serves the two reductions that follow.
        options = options.repartition(*keys, "respondent_id")
    decided = (F.col("n_selected") + F.col("n_not_selected")) > 0
    person = [*keys, "structure_type", "respondent_id"]
    instances = options.groupBy(*person, "loop_id", "instance").agg(
        F.max((F.col("n_applicable") > 0).cast("int")).alias("applies"),
        F.count_if(decided).alias("n_decided"),
        F.count_if(F.col("n_selected") > 0).alias("selected_keys"),
        F.count_if(F.col("n_not_selected") > 0).alias("not_selected_keys"),
        *[F.sum(c).alias(c) for c in COUNTS],
    )
    return instances.groupBy(*person).agg(
        F.max("applies").alias("applies"), F.sum("applies").alias("n_instances"),
        (F.count_if((F.col("applies") > 0) & F.col("loop_id").isNotNull()) > 1).alias("repeats"),
        *[F.sum(c).alias(c) for c in ("n_decided", "selected_keys", "not_selected_keys", *COUNTS)],
    )


def denominator_ledger(records: DataFrame, duplicates: str = "error",
                       keys: Sequence[str] = STRUCTURE, dealt: bool = False) -> DataFrame:
    """Unit, denominator and state counts per structure.

    Multiple response counts explicit yes/no keys; categories count respondents;
    numeric loops count (respondent, instance).  `dealt` says that records lie
    dealt by respondent, so that all reductions run where they are.
    """
    return _ledger(_people(records, keys, dealt), duplicates, keys)


def slice_ledgers(records: DataFrame, slices: DataFrame, duplicates: str = "error",
                  keys: Sequence[str] = STRUCTURE) -> DataFrame:
    """`denominator_ledger` of every slice at once.

    `slices` holds study_id, respondent_id and slice_id.  Records are read and
    reduced once; a respondent's one row then counts in each of its slices.
    """
    members = _people(records, keys).join(slices, ["study_id", "respondent_id"])
    return _ledger(members, duplicates, [*keys, "slice_id"])


def _ledger(people: DataFrame, duplicates: str, keys: Sequence[str]) -> DataFrame:
    kind = F.col("structure_type")
    multi, category = kind.isin(*RM_TYPES), kind.isin(*CATEGORY_TYPES)
    sums = people.groupBy(*keys, "structure_type").agg(
        F.sum("applies").alias("respondents"), F.sum("n_instances").alias("instances"),
        F.sum("n_decided").alias("decided"), F.bool_or("repeats").alias("repeated_dependency"),
        F.sum("selected_keys").alias("selected_keys"),
        F.sum("not_selected_keys").alias("not_selected_keys"),
        *[F.sum(c).alias(c) for c in COUNTS],
    )
    denominator = F.when(multi, F.col("decided")).when(category, F.col("respondents")).otherwise(
        F.col("instances")
    )
    valid = F.when(multi, F.col("decided")).otherwise(
        F.greatest(denominator - F.col("n_missing") - F.col("n_invalid"), F.lit(0))
    )
    by_rows = F.lit(duplicates == "keep") & ~multi
    return sums.select(
        *keys, "structure_type",
        F.when(multi, "respondent_option").when(category, "respondent").otherwise("instance")
        .alias("unit"),
        denominator.alias("denominator_n"), valid.alias("valid_n"),
        F.when(by_rows, F.col("n_selected")).otherwise(F.col("selected_keys")).alias("selected_n"),
        F.when(multi, F.col("not_selected_keys")).otherwise(F.col("n_not_selected"))
        .alias("not_selected_n"),
        F.col("n_missing").alias("ordinary_missing_n"),
        F.col("n_structural").alias("structural_missing_n"),
        F.col("n_invalid").alias("invalid_n"),
        F.when(denominator == 0, "VALID_ZERO_BASE").otherwise("NONZERO_BASE")
        .alias("zero_base_status"),
        "repeated_dependency",
    )


def mention_ledger(records: DataFrame, scope: str = "PARENT_RM", scope_ref: str | None = None,
                   duplicates: str = "error", keys: Sequence[str] = STRUCTURE) -> DataFrame:
    """Mentions per scope and per option of a multiple response.

    Duplicates count as rows under the policy 'keep', else as distinct keys.
    """
    if scope not in SCOPES:
        raise ValueError(f"unsupported mention scope: {scope}")
    rows = records if scope_ref is None else records.filter(F.col(SCOPES[scope]) == scope_ref)
    mentions = "mention_rows" if duplicates == "keep" else "mentions"
    return mention_ledgers(rows, [scope], keys).select(
        *keys, "scope_ref", "option_key", F.col(mentions).alias("mentions"),
        "structural_missing_n", "invalid_n")


def mention_ledgers(records: DataFrame, scopes: Sequence[str] = tuple(SCOPES),
                    keys: Sequence[str] = STRUCTURE) -> DataFrame:
    """Mentions of all scopes, under both policies, from one reduction.

    `mentions` are distinct keys, `mention_rows` rows.  Only reduced rows are
    repeated, once for every scope that they belong to.
    """
    rows = records.filter(F.col("structure_type").isin(*RM_TYPES))
    belongs = F.filter(F.array(*[
        F.struct(F.lit(s).alias("scope"), F.col(SCOPES[s]).alias("scope_ref")) for s in scopes
    ]), lambda s: s["scope_ref"].isNotNull())
    options = _per_option(rows, keys).select("*", F.inline(belongs))
    return options.groupBy(*keys, "scope", "scope_ref", "option_key").agg(
        F.sum((F.col("n_selected") > 0).cast("long")).alias("mentions"),
        F.sum("n_selected").alias("mention_rows"),
        F.sum("n_structural").alias("structural_missing_n"), F.sum("n_invalid").alias("invalid_n"),
    )


def scope_totals(mentions: DataFrame, keys: Sequence[str] = STRUCTURE) -> DataFrame:
    """Denominator per scope: its mentions over all options."""
    total = F.sum("mentions")
    return mentions.groupBy(*keys, "scope_ref").agg(
        total.alias("denominator_n"),
        F.sum("structural_missing_n").alias("structural_missing_n"),
        F.sum("invalid_n").alias("invalid_n"),
        F.when(total == 0, "VALID_ZERO_BASE").otherwise("NONZERO_BASE").alias("zero_base_status"),
    )


# --- canonical metrics ------------------------------------------------------

def _value(numerator: Column, denominator: Column) -> dict[str, Column]:
    return {
        "value": ratio(numerator, denominator),
        "status": F.when(denominator > 0, "OK").otherwise("NO_VALID_BASE"),
    }


def slice_records(records: DataFrame, slices: DataFrame) -> DataFrame:
    """Records of the respondents of each slice.

    `slices` holds study_id, respondent_id, slice_id and, when weighted, weight.
    """
    return records.join(slices, ["study_id", "respondent_id"])


def category_shares(records: DataFrame, by: Sequence[str], categories: DataFrame | None = None
                    ) -> DataFrame:
    """Records in a category over distinct respondents with a valid one.

    `categories` (by-columns without the slice, category_id) keeps empty categories.
    """
    valid = records.filter(is_state("valid_category")).groupBy(
        *by, "respondent_id", "category_id"
    ).agg(F.count("*").alias("n_rows"))
    counts = valid.groupBy(*by, "category_id").agg(F.sum("n_rows").alias("numerator"))
    bases = valid.groupBy(*by, "respondent_id").agg(F.lit(1).alias("one")).groupBy(*by).agg(
        F.count("*").alias("denominator")
    )
    if categories is not None:
        shared = [c for c in by if c in categories.columns]
        if not shared:
            raise ValueError("categories need a column of `by`, such as study_id")
        groups = records.select(*by).distinct()
        frame = groups.join(categories, shared)
        counts = frame.join(counts, [*by, "category_id"], "left")
    joined = counts.join(bases, list(by), "left").fillna(0, ["numerator", "denominator"])
    return joined.withColumns(_value(F.col("numerator"), F.col("denominator")))


def box_share(records: DataFrame, by: Sequence[str], box_categories: Sequence[str]) -> DataFrame:
    """Top or bottom box over a declared set of categories."""
    shares = category_shares(records, by)
    inside = F.col("category_id").isin(*box_categories)
    sums = shares.groupBy(*by).agg(
        F.sum(F.when(inside, F.col("numerator")).otherwise(0)).alias("numerator"),
        F.max("denominator").alias("denominator"),
    )
    return sums.withColumns(_value(F.col("numerator"), F.col("denominator")))


def option_shares(records: DataFrame, by: Sequence[str]) -> DataFrame:
    """Respondents who chose an option over those with an explicit yes or no."""
    decided = records.filter(is_state("selected", "not_selected")).groupBy(
        *by, "respondent_id", "option_id"
    ).agg(F.max(is_state("selected").cast("int")).alias("chosen"))
    return decided.groupBy(*by, "option_id").agg(
        F.sum("chosen").alias("numerator"), F.count("*").alias("denominator")
    ).withColumns(_value(F.col("numerator"), F.col("denominator")))


def mention_shares(records: DataFrame, by: Sequence[str], scope: str = "PARENT_RM",
                   duplicates: str = "error") -> DataFrame:
    """Mentions of an option over all mentions of its scope.

    Both sides are restricted to the scope.
    """
    column = SCOPES[scope]
    rows = records.filter(is_state("selected"))
    keyed = rows.groupBy(*by, "respondent_id", *SCOPE_IDS, "structure_id", "option_id").agg(
        F.count("*").alias("n_rows")
    )
    counted = F.col("n_rows") if duplicates == "keep" else F.lit(1)
    counts = keyed.groupBy(*by, F.col(column).alias("scope_ref"), "option_id").agg(
        F.sum(counted).alias("numerator")
    )
    totals = counts.groupBy(*by, "scope_ref").agg(F.sum("numerator").alias("denominator"))
    return counts.join(totals, [*by, "scope_ref"]).withColumns(
        _value(F.col("numerator"), F.col("denominator"))
    )


def loop_category_shares(records: DataFrame, by: Sequence[str], weighted: bool = False) -> DataFrame:
    """Category shares per loop instance; weights over that instance only."""
    group = [*by, "loop_id"]
    weight = F.col("weight") if weighted else F.lit(1.0)
    people = records.filter(is_state("valid_category")).groupBy(
        *group, "respondent_id", "category_id"
    ).agg(F.count("*").alias("n_rows"), F.max(weight).alias("w"))
    counts = people.groupBy(*group, "category_id").agg(
        F.sum(F.col("n_rows") * F.col("w")).alias("numerator")
    )
    bases = people.groupBy(*group, "respondent_id").agg(F.max("w").alias("w")).groupBy(*group).agg(
        F.count("*").alias("unweighted_n"), F.sum("w").alias("denominator"),
        ratio(F.sum("w") * F.sum("w"), F.sum(F.col("w") * F.col("w"))).alias("effective_n"),
    )
    return counts.join(bases, group).withColumns(_value(F.col("numerator"), F.col("denominator")))


def loop_means(records: DataFrame, by: Sequence[str], weighted: bool = False) -> DataFrame:
    """Mean and sd of numeric answers per loop instance.

    The sd needs two observations; without any the status is NO_VALID_BASE.
    """
    w = F.col("weight") if weighted else F.lit(1.0)
    answered = is_state("answered")
    value = F.when(answered, F.col("number"))
    sums = records.groupBy(*by, "loop_id").agg(
        F.count(value).alias("denominator"),
        F.sum(value * w).alias("vw"), F.sum(F.when(answered, w)).alias("w"),
        F.stddev_samp(value).alias("sd"),
    )
    n = F.col("denominator")
    return sums.select(
        *by, "loop_id", "denominator", ratio(F.col("vw"), F.col("w")).alias("value"), "sd",
        F.when(n > 0, "OK").otherwise("NO_VALID_BASE").alias("status"),
        F.when(n > 1, "OK").otherwise("NO_VALID_BASE").alias("sd_status"),
    )


def descriptive_nps(records: DataFrame, by: Sequence[str], groups: DataFrame) -> DataFrame:
    """Unweighted (promoters - detractors) / n on categories.

    `groups` maps category_id to nps_group per structure.
    """
    counts = category_shares(records, by)
    joined = counts.join(groups, "category_id", "left")
    sums = joined.groupBy(*by).agg(
        F.sum(F.when(F.col("nps_group") == "Promotor", F.col("numerator")).otherwise(0))
        .alias("promoters"),
        F.sum(F.when(F.col("nps_group") == "Detractor", F.col("numerator")).otherwise(0))
        .alias("detractors"),
        F.max("denominator").alias("denominator"),
    )
    return sums.withColumns(
        _value(F.col("promoters") - F.col("detractors"), F.col("denominator"))
    )


# --- checks -----------------------------------------------------------------

def invalid_values(records: DataFrame, keys: Sequence[str] = STRUCTURE) -> DataFrame:
    """Out-of-domain cells per binding; one is enough to fail a structure (Q2)."""
    return records.filter(is_state("invalid_out_of_domain")).groupBy(*keys, "binding_id").agg(
        F.count("*").alias("n_invalid")
    )


def exclusive_conflicts(records: DataFrame, exclusive: DataFrame,
                        keys: Sequence[str] = STRUCTURE) -> DataFrame:
    """Scopes with an exclusive option and any other one (Q3).

    `exclusive` lists (study_id, structure_id, option_id).
    """
    flags = exclusive.select(*STRUCTURE, "option_id").distinct().withColumn("exclusive", F.lit(1))
    chosen = records.filter(is_state("selected") & F.col("option_id").isNotNull()).join(
        flags, [*STRUCTURE, "option_id"], "left"
    )
    return chosen.groupBy(*keys, "respondent_id", *SCOPE_IDS).agg(
        F.max(F.coalesce("exclusive", F.lit(0))).alias("has_exclusive"),
        F.min(F.coalesce("exclusive", F.lit(0))).alias("all_exclusive"),
    ).filter("has_exclusive = 1 and all_exclusive = 0").drop("has_exclusive", "all_exclusive")


def duplicate_mentions(records: DataFrame, keys: Sequence[str] = STRUCTURE) -> DataFrame:
    """The same key selected twice (Q4)."""
    return records.filter(is_state("selected")).groupBy(
        *keys, "respondent_id", *SCOPE_IDS, option_key().alias("option_key")
    ).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def repeated_dependency(records: DataFrame, keys: Sequence[str] = STRUCTURE) -> DataFrame:
    """Does any respondent answer more than one loop instance? (Q5)"""
    loops = records.filter(F.col("applicable") & F.col("loop_id").isNotNull()).groupBy(
        *keys, "respondent_id"
    ).agg((F.min("loop_id") != F.max("loop_id")).alias("repeats"))
    return loops.groupBy(*keys).agg(
        F.bool_or("repeats").alias("repeated_dependency"),
        F.count_if("repeats").alias("n_repeating"),
    )

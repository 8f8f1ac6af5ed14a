"""Respondent filters (F1) and universe expressions (F5-F8) as Columns.

A universe expression is a nested tuple such as
``("and", ("eq", "SEG", "A"), ("not", ("gt", "AGE", 40)))``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce
from typing import Any, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabuloom.functions.text import NUMBER_PATTERN, column_type, is_numeric_type, to_number

PASS, UNSUPPORTED, FAIL = 0, 1, 2
STATUS_NAMES = ("PASS", "UNSUPPORTED", "FAIL")


class UniverseError(ValueError):
    """A universe expression that cannot be evaluated (status FAIL)."""


def _is_missing_value(value: object) -> bool:
    return value is None or (isinstance(value, float) and math.isnan(value))


def _as_number(value: object) -> float | None:
    import re

    if isinstance(value, (int, float)):
        return float(value)
    text = str(value).strip()
    return float(text) if re.match(NUMBER_PATTERN, text) else None


def filter_condition(df: DataFrame, filters: Mapping[str, Sequence[object]] | None) -> Column:
    """AND across variables, OR inside one; None in a list means 'or missing'.

    All-numeric lists compare numbers after coercion, other lists compare
    trimmed text with NULL as ''.  Unknown variables and empty lists are ignored.
    """
    conditions = [F.lit(True)]
    for name, values in (filters or {}).items():
        if name not in df.columns or not values:
            continue
        present = [v for v in values if not _is_missing_value(v)]
        hit = F.lit(False)
        if present:
            numbers = [_as_number(v) for v in present]
            if all(n is not None for n in numbers):
                value = to_number(F.col(name), column_type(df, name))
                hit = F.coalesce(value.isin(*numbers), F.lit(False))
            else:
                text = F.trim(F.coalesce(F.col(name).cast("string"), F.lit("")))
                hit = text.isin(*[str(v).strip() for v in present])
        if len(present) < len(values):
            missing = F.col(name).isNull()
            if isinstance(column_type(df, name), (T.DoubleType, T.FloatType)):
                missing = missing | F.isnan(F.col(name))
            hit = hit | missing
        conditions.append(hit)
    return reduce(lambda a, b: a & b, conditions)


def missing(col: Column, dtype: T.DataType) -> Column:
    """NULL, NaN or blank text."""
    result = col.isNull()
    if isinstance(dtype, T.StringType):
        result = result | (F.trim(col) == "")
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        result = result | F.isnan(col)
    return F.coalesce(result, F.lit(True))


@dataclass(frozen=True)
class ResponseColumns:
    """Columns that hold the response state of one question."""

    applicable: str
    answered: str
    selected: str
    not_selected: str


@dataclass(frozen=True)
class UniverseContext:
    """What an expression may refer to: columns, other universes, states."""

    schema: T.StructType
    registry: Mapping[str, Mapping[str, Any]] = field(default_factory=dict)
    states: Mapping[str, ResponseColumns] = field(default_factory=dict)


@dataclass(frozen=True)
class Universe:
    """A never-NULL Boolean Column and a status Column (0 PASS, 1, 2 FAIL)."""

    mask: Column
    status: Column


def _kind(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    return "number" if is_numeric_type(dtype) else type(dtype).__name__


def _value_kind(value: object) -> str:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    return "StringType" if isinstance(value, str) else type(value).__name__


_COMPARE = {
    "eq": lambda c, v: c == v, "neq": lambda c, v: c != v,
    "gt": lambda c, v: c > v, "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v, "lte": lambda c, v: c <= v,
}


def _field_leaf(op: str, args: tuple, context: UniverseContext) -> Universe:
    name = args[0]
    if name not in context.schema.fieldNames():
        raise UniverseError(f"unknown variable: {name}")
    dtype = context.schema[name].dataType
    col = F.col(name)
    absent = missing(col, dtype)
    if op == "is_missing":
        return Universe(absent, F.lit(PASS))
    if op == "not_missing":
        return Universe(~absent, F.lit(PASS))
    operands = args[1] if op in ("in", "not_in") else [args[1]]
    if not isinstance(operands, (list, tuple)) or not operands:
        raise UniverseError(f"{op} on {name} needs a non-empty list")
    for operand in operands:
        blank = isinstance(operand, str) and not operand.strip()
        if _is_missing_value(operand) or blank or _value_kind(operand) != _kind(dtype):
            raise UniverseError(f"{op} on {name}: operand type does not match the column")
    if op in ("in", "not_in"):
        hit = col.isin(*operands)
        hit = ~hit if op == "not_in" else hit
    else:
        hit = _COMPARE[op](col, operands[0])
    return Universe(F.coalesce(hit & ~absent, F.lit(False)), F.lit(PASS))


def _state_leaf(op: str, args: tuple, context: UniverseContext) -> Universe:
    if args[0] not in context.states:
        raise UniverseError(f"no response state for question: {args[0]}")
    state = context.states[args[0]]
    applicable = F.col(state.applicable)
    if op in ("answered", "not_answered"):
        answered = F.col(state.answered)
        status = F.when(applicable.isNull(), UNSUPPORTED).when(
            applicable & answered.isNull(), UNSUPPORTED
        ).otherwise(PASS)
        hit = applicable & (answered if op == "answered" else ~answered)
    else:
        if len(args) < 2:
            raise UniverseError(f"{op} needs a category")
        chosen = F.coalesce(F.array_contains(state.selected, args[1]), F.lit(False))
        refused = F.coalesce(F.array_contains(state.not_selected, args[1]), F.lit(False))
        status = (
            F.when(applicable.isNull(), UNSUPPORTED)
            .when(~applicable, PASS)
            .when(chosen & refused, FAIL)
            .when(~chosen & ~refused, UNSUPPORTED)
            .otherwise(PASS)
        )
        hit = applicable & (chosen if op == "selected" else refused)
    return Universe(F.coalesce(hit & (status == PASS), F.lit(False)), status)


def compile_universe(
    expression: tuple, context: UniverseContext, _stack: tuple[str, ...] = ()
) -> Universe:
    """Compile one expression.  Every leaf is false, never NULL, on missing."""
    op, args = expression[0], tuple(expression[1:])
    if op in ("true", "false"):
        return Universe(F.lit(op == "true"), F.lit(PASS))
    if op in ("and", "or", "not"):
        if not args or (op == "not" and len(args) != 1):
            raise UniverseError(f"malformed arguments for {op}")
        parts = [compile_universe(a, context, _stack) for a in args]
        status = F.greatest(*[p.status for p in parts]) if len(parts) > 1 else parts[0].status
        if op == "not":
            return Universe(~parts[0].mask, status)
        join = (lambda a, b: a & b) if op == "and" else (lambda a, b: a | b)
        return Universe(reduce(join, [p.mask for p in parts]), status)
    if op == "universe_ref":
        ref = args[0]
        if ref in _stack:
            raise UniverseError(f"universe cycle: {' -> '.join((*_stack, ref))}")
        spec = context.registry.get(ref)
        if spec is None:
            raise UniverseError(f"unknown universe: {ref}")
        if not spec.get("released", False):
            raise UniverseError(f"universe is not released: {ref}")
        return compile_universe(spec["expression"], context, (*_stack, ref))
    if op in _COMPARE or op in ("in", "not_in", "is_missing", "not_missing"):
        return _field_leaf(op, args, context)
    if op in ("selected", "not_selected", "answered", "not_answered"):
        return _state_leaf(op, args, context)
    raise UniverseError(f"unknown universe operator: {op}")


def with_universe(
    df: DataFrame,
    expression: tuple,
    registry: Mapping[str, Mapping[str, Any]] | None = None,
    states: Mapping[str, ResponseColumns] | None = None,
) -> DataFrame:
    """Add `eligible` (Boolean, never NULL) and `universe_status` (0, 1, 2)."""
    context = UniverseContext(df.schema, registry or {}, states or {})
    universe = compile_universe(expression, context)
    return df.withColumn("eligible", universe.mask).withColumn("universe_status", universe.status)


def universe_summary(df: DataFrame, keys: Sequence[str] = ("study_id",)) -> DataFrame:
    """Input, eligible and excluded counts and the worst status per key."""
    status = F.max("universe_status")
    return df.groupBy(*keys).agg(
        F.count("*").alias("input_n"),
        F.count_if("eligible").alias("eligible_n"),
        F.count_if(~F.col("eligible")).alias("excluded_n"),
        F.element_at(F.array(*[F.lit(s) for s in STATUS_NAMES]), status + 1).alias("status"),
    )


def applicability(
    binding: Mapping[str, str | None], refs: Mapping[str, str], context: UniverseContext
) -> Column:
    """AND of the question, row, column, cell and loop universes of a binding (F8).

    In each scope the reference for the named member wins over the general one.
    """
    if "question" not in refs:
        raise UniverseError("question applicability needs an explicit universe")
    row, loop = binding.get("row_id"), binding.get("loop_instance_id")
    column = binding.get("column_id") or binding.get("option_id")
    wanted = [("question",)]
    if row is not None:
        wanted.append((f"row:{row}", "row"))
    if column is not None:
        wanted.append((f"column:{column}", f"option:{column}", "column"))
    if row is not None and column is not None:
        wanted.append((f"cell:{row}:{column}", "cell"))
    if loop is not None:
        wanted.append((f"loop_instance:{loop}", "loop_instance"))
    masks = []
    for names in wanted:
        ref = next((refs[n] for n in names if n in refs), None)
        if ref is not None:
            masks.append(compile_universe(("universe_ref", ref), context).mask)
    return reduce(lambda a, b: a & b, masks)

"""Text and number clean-up as Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabuloom.constants import YES_WORDS

# A decimal number as a survey file writes it; rejects 'nan', 'inf' and '1d',
# which a plain cast would accept.
NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"

# Starts with a letter, or is a whole number without sign or leading zero.
PLAIN_TEXT_PATTERN = r"^(?:[A-Za-z]|(?:0|[1-9][0-9]{0,14})$)"


def _fold_tables() -> tuple[str, str, dict[str, str]]:
    """Characters that decompose to ASCII: one-to-one pairs and expansions."""
    source, target, expansions = [], [], {}
    blocks = (range(0xA0, 0x250), range(0x1E00, 0x1F00), range(0xFB00, 0xFB07),
              range(0x2070, 0x209D), range(0xFF10, 0xFF5B))
    for block in blocks:
        for point in block:
            char = chr(point).lower()
            if len(char) != 1:
                continue
            plain = "".join(
                c for c in unicodedata.normalize("NFKD", char)
                if not unicodedata.combining(c)
            )
            if plain == char or not any(c.isascii() and c.isalnum() for c in plain):
                continue
            if len(plain) == 1:
                source.append(char)
                target.append(plain)
            else:
                expansions[char] = plain
    return "".join(source), "".join(target), expansions


_FOLD_FROM, _FOLD_TO, _EXPANSIONS = _fold_tables()
_EXPANSION_ARRAY = "array(" + ", ".join(
    f"named_struct('char', '{c}', 'plain', '{p}')" for c, p in _EXPANSIONS.items()
) + ")"
# translate() deletes source characters that have no counterpart.
_COMBINING = "".join(chr(p) for p in range(0x300, 0x370))


def is_numeric_type(dtype: T.DataType | None) -> bool:
    return isinstance(dtype, T.NumericType)


def column_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def to_number(col: Column, dtype: T.DataType | None = None) -> Column:
    """Numeric value or NULL; NaN becomes NULL."""
    if is_numeric_type(dtype):
        value = col.cast("double")
        if isinstance(dtype, (T.DoubleType, T.FloatType)):
            return F.when(~F.isnan(value), value)
        return value
    if isinstance(dtype, T.BooleanType):
        return col.cast("double")
    text = F.trim(col.cast("string"))
    return F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))


def number_of(df: DataFrame, name: str) -> Column:
    return to_number(F.col(name), column_type(df, name))


def code_text(col: Column, dtype: T.DataType | None = None) -> Column:
    """One text for one code: 12.0 -> '12', NULL -> '', text trimmed."""
    if isinstance(dtype, T.IntegralType):
        return F.coalesce(col.cast("string"), F.lit(""))

    def whole(number: Column, text: Column) -> Column:
        plain = number.try_cast("decimal(38,0)").cast("string")
        return F.when(number == F.floor(number), F.coalesce(plain, text)).otherwise(text)

    if is_numeric_type(dtype):
        number = to_number(col, dtype)
        return F.coalesce(whole(number, number.cast("string")), F.lit(""))
    # Texts that are no numbers, and plain whole numbers, stay as they are.
    text = F.trim(col.cast("string"))
    return F.when(text.rlike(PLAIN_TEXT_PATTERN), text).when(
        text.rlike(NUMBER_PATTERN), whole(text.try_cast("double"), text)
    ).otherwise(F.coalesce(text, F.lit("")))


def normalize_text(col: Column) -> Column:
    """Lower case, no accents, every other character run becomes '_' (X1)."""
    text = F.lower(col.cast("string"))
    expanded = F.reduce(F.expr(_EXPANSION_ARRAY), text, lambda done, pair: F.replace(
        done, pair["char"], pair["plain"]))
    text = F.when(text.rlike("[" + "".join(_EXPANSIONS) + "]"), expanded).otherwise(text)
    text = F.translate(text, _FOLD_FROM + _COMBINING, _FOLD_TO)
    text = F.regexp_replace(text, "[^a-z0-9]+", "_")
    return F.coalesce(F.regexp_replace(text, "^_+|_+$", ""), F.lit(""))


def plain_normalize(value: object) -> str:
    """The same rule for a configuration word on the driver."""
    if value is None:
        return ""
    text = unicodedata.normalize("NFKD", str(value).strip().lower())
    text = "".join(
        c if c.isascii() and c.isalnum() else " "
        for c in text if not unicodedata.combining(c)
    )
    return "_".join(text.split())


def truthy(col: Column, dtype: T.DataType | None = None) -> Column:
    """Yes-words for text, exactly 1 for numbers."""
    if isinstance(dtype, T.BooleanType):
        return F.coalesce(col, F.lit(False))
    if is_numeric_type(dtype):
        return F.coalesce(col == 1, F.lit(False))
    return normalize_text(col).isin(*YES_WORDS)


def truthy_of(df: DataFrame, name: str) -> Column:
    return truthy(F.col(name), column_type(df, name))


def clean_open_text(col: Column) -> Column:
    """Trim and collapse white space."""
    return F.coalesce(
        F.trim(F.regexp_replace(col.cast("string"), r"(?U)\s+", " ")), F.lit("")
    )


def suffix_code(col: Column) -> Column:
    """Last '_' or '-' part of a name; the name itself when it has one part."""
    return F.element_at(F.split(col, "[-_]"), -1)


def numeric_part(col: Column) -> Column:
    """First run of digits, or NULL."""
    return F.regexp_extract(col.cast("string"), "([0-9]+)", 1).try_cast("double")


def short_text(col: Column, limit: int = 120) -> Column:
    text = F.trim(F.coalesce(col.cast("string"), F.lit("")))
    return F.when(F.length(text) <= limit, text).otherwise(
        F.concat(F.rtrim(F.substring(text, 1, limit - 1)), F.lit("…"))
    )


def blank_to_null(col: Column) -> Column:
    """NULL for blank and for the texts a missing cell turns into."""
    text = F.trim(col.cast("string"))
    return F.when(~F.lower(text).isin("", "nan", "none", "null"), text)


def first_text(*cols: Column) -> Column:
    """First non-blank text, else ''."""
    return F.coalesce(*[blank_to_null(c) for c in cols], F.lit(""))

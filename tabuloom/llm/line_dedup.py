"""Line dedup: windows of three consecutive lines that occur anywhere before are removed.

Windows overlap, so a repeated passage of many lines is covered by several of them; the covered
positions are merged and cut out of the later occurrence. Only hashes and positions are shuffled. The
least occurrence of a window is a map-side minimum; the occurrences of a window that very many documents
share are then joined to that one row, which adaptive execution splits over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabuloom.operators.ordering import unused

WINDOW = 3
SPACE = r"[\x09-\x0D\x20]+"


def _lines(text: Column) -> Column:
    """(at, line) of the lines that are not blank, with white space collapsed."""
    lines = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(i.alias("at"), F.trim(F.regexp_replace(x, SPACE, " ")).alias("line")))
    return F.filter(lines, lambda x: x["line"] != "")


def windows(docs: DataFrame, key: str, text: str, width: int = WINDOW) -> DataFrame:
    """(k, row, first, last, h, g) per window: first and last line and a hash of 128 bits.

    A text with fewer lines than a window is one window; one without a line that is not blank has none.
    """
    rows = docs.select(F.col(key).alias("k"), _row(docs, key, text).alias("row"), _lines(F.col(text)).alias("lines")).where(F.size("lines") > 0)
    rows = rows.select("k", "row", F.transform("lines", lambda x: F.struct(
        x["at"].alias("at"), F.xxhash64(x["line"]).alias("h"), F.xxhash64(F.lit(1), x["line"]).alias("g"))).alias("lines"))
    ahead = [F.lit(i) for i in range(width)]
    full = F.transform(F.sequence(F.lit(0), F.size("lines") - width), lambda i: F.struct(
        F.get("lines", i)["at"].alias("first"), F.get("lines", i + width - 1)["at"].alias("last"),
        F.xxhash64(*[F.get("lines", i + a)["h"] for a in ahead]).alias("h"), F.xxhash64(*[F.get("lines", i + a)["g"] for a in ahead]).alias("g")))
    short = F.array(F.struct(
        F.element_at("lines", 1)["at"].alias("first"), F.element_at("lines", -1)["at"].alias("last"),
        F.xxhash64(F.transform("lines", lambda x: x["h"])).alias("h"), F.xxhash64(F.transform("lines", lambda x: x["g"])).alias("g")))
    return rows.select("k", "row", F.explode(F.when(F.size("lines") < width, short).otherwise(full)).alias("w")).select("k", "row", "w.*")


def _row(docs: DataFrame, key: str, text: str) -> Column:
    return F.xxhash64(F.col(key), F.col(text))


def covered(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WINDOW) -> DataFrame:
    """(k, row, gone): the sorted positions of lines that stand in a later occurrence of a window.

    Occurrences are ordered by key and position. Where occurrences overlap within one document, the
    lines of the first one stay.
    """
    found = windows(docs, key, text, width)
    first = found.groupBy("h", "g").agg(F.min(F.struct("k", "row", "first", "last")).alias("a"), F.count("*").alias("n")).where("n > 1").select("h", "g", "a")
    later = found.join(first, ["h", "g"]).where(F.struct("k", "row", "first", "last") != F.col("a"))
    same = F.col("k").eqNullSafe(F.col("a.k")) & (F.col("row") == F.col("a.row"))
    start = F.when(same, F.greatest("first", F.col("a.last") + 1)).otherwise(F.col("first"))
    spans = later.select("k", "row", start.alias("start"), "last").where("start <= last")
    return spans.select("k", "row", F.explode(F.sequence("start", "last")).alias("at")).groupBy("k", "row").agg(F.sort_array(F.collect_set("at")).alias("gone"))


def line_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WINDOW) -> DataFrame:
    """`docs` with later occurrences of repeated line windows cut from the text, and n_lines, n_removed.

    Lines end at a newline; they are compared with white space collapsed, blank lines are passed over
    and go only when inside a removed span. A null text stays null with no lines; an empty one has one
    blank line. Rows with a null key come first. Rows with equal key and text count as one document
    and are treated alike. A column called n_lines or n_removed is replaced, any other is kept; a text of any
    length is one row, its lines one array; an empty table gives an empty one.
    """
    k, row, own, cut = (unused(docs.columns, c) for c in ("_k", "_row", "_own", "_gone"))
    gone = covered(docs, key, text, width).select(F.col("k").alias(k), F.col("row").alias(row), F.col("gone").alias(cut))
    joined = docs.withColumn(own, _row(docs, key, text)).join(gone, (F.col(own) == F.col(row)) & F.col(key).eqNullSafe(F.col(k)), "left")
    lines = F.split(F.col(text), "\n", -1)
    count = F.coalesce(F.size(lines), F.lit(0))
    keep = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(cut))
    rest = F.array_join(F.transform(keep, lambda i: F.get(lines, i)), "\n")
    joined = joined.withColumn("n_lines", F.when(F.col(text).isNull(), 0).otherwise(count)).withColumn("n_removed", F.coalesce(F.size(cut), F.lit(0)))
    joined = joined.withColumn("n_removed", F.greatest("n_removed", F.lit(0)))
    return joined.withColumn(text, F.when(F.col(cut).isNull(), F.col(text)).otherwise(rest)).drop(own, k, row, cut)

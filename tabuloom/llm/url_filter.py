"""URL filter: a blocked Bloom filter of listed canonical URLs in front of an exact join.

Every URL is looked up under the canonical keys that could be listed for it: each suffix of its host
at a dot with each prefix of its path. The filter has a bounded size and goes to the tasks as a constant;
what it lets through is joined exactly with the list, which may be of any size. DataFrame functions only.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The filter has at most so many blocks of 512 bits (1 MB in all), however long the list is.
BLOCKS = 1 << 14
WORDS = 8
PROBES = 7


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host up to the first of / ? # after ://, in lower case, and path up to ? or #; both empty without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


def _bits(key: Column) -> list[Column]:
    spread = F.xxhash64(F.lit(1), key)
    return [F.shiftrightunsigned(spread, 9 * i).bitwiseAND(F.lit(511)).cast("int") for i in range(PROBES)]


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def bloom(listed: DataFrame, key: str, blocks: int = BLOCKS) -> DataFrame:
    """(block, words): the blocks of the filter that are not empty, each of eight words of 64 bits."""
    rows = listed.select(_block(F.col(key), blocks).alias("block"), F.explode(F.array(*_bits(F.col(key)))).alias("bit"))
    word, mask = F.shiftright("bit", 6), F.expr("shiftleft(1L, bit & 63)")
    sums = [F.bit_or(F.when(word == i, mask).otherwise(F.lit(0).cast("long"))).alias(f"w{i}") for i in range(WORDS)]
    return rows.groupBy("block").agg(*sums).select("block", F.array(*[f"w{i}" for i in range(WORDS)]).alias("words"))


def _listed_words(filter_rows: list, blocks: int) -> Column:
    """The filter as one constant array, block after block; it has at most BLOCKS * WORDS numbers."""
    words = [0] * (blocks * WORDS)
    for row in filter_rows:
        words[row.block * WORDS:(row.block + 1) * WORDS] = row.words
    return F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")


def candidates(most_labels: int, lengths: list[int]) -> Column:
    """The canonical keys of `host` and `path` under which a rule may fit; no longer than any listed one."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size(labels), F.lit(most_labels))),
        lambda n: F.array_join(F.slice(labels, -n, n), "."))
    fitting = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("path"))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(fitting, lambda n: F.concat(s, F.substring(F.col("path"), F.lit(1), n)))))


def _may_be_listed(key: Column, words: Column, blocks: int) -> Column:
    first = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int") * WORDS
    hit = F.lit(True)
    for bit in _bits(key):
        word = F.get(words, first + F.shiftright(bit, 6))
        hit = hit & (F.call_function("getbit", word, bit.bitwiseAND(F.lit(63))) == 1)
    return hit


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow", blocks: int | None = None) -> DataFrame:
    """(key, host, path, rule, verdict) per row of `pages`.

    `rules` has host, path and action (allow or block). A rule fits its host and all subdomains where
    the path starts with its path; the longest wins, at equal length the longer host, then block. A URL
    that no listed entry fits is not in the filter's list and gets `default`. Null URLs and those without
    `://` have empty host and path. Repeated rules and rows change nothing; without rules every URL gets
    `default`; an empty table gives an empty one; other columns are not read.

    Pages of which no candidate key passes the filter get the default where they are read; only the
    others take part in the exact join. `blocks` is the size of the filter: for 16 keys a block, BLOCKS at most.
    """
    listed = rules.select(lower_ascii(F.col("host")).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), "action").where("r_host is not null")
    listed = listed.withColumn("key", F.concat("r_host", "r_path"))
    most, lengths, n = listed.agg(F.max(F.size(F.split("r_host", r"\."))), F.collect_set(F.length("r_path")), F.count("*")).first()
    host, path = host_and_path(F.col(url))
    rows = pages.select(key, host.alias("host"), path.alias("path"))
    if not n:
        return rows.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    blocks = blocks or min(BLOCKS, n // 16 + 1)
    words = _listed_words(bloom(listed, "key", blocks).collect(), blocks)
    passed = rows.withColumn("keys", F.filter(candidates(most, sorted(lengths)), lambda k: _may_be_listed(k, words, blocks)))
    others = passed.where(F.size("keys") == 0).select(key, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    hits = passed.where(F.size("keys") > 0)
    fits = hits.select("host", "path", F.explode("keys").alias("key")).join(listed.select("key", "r_host", "action"), "key").groupBy("host", "path").agg(
        F.max(F.struct(F.length("key").alias("n"), F.length("r_host").alias("m"), "action", F.col("key").alias("rule"))).alias("best"))
    fits = fits.select(F.col("host").alias("f_host"), F.col("path").alias("f_path"), "best")
    joined = hits.join(fits, (F.col("host") == F.col("f_host")) & (F.col("path") == F.col("f_path")), "left")
    return others.unionAll(joined.select(key, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict")))

"""SimHash near-duplicates linked through deletion-variant signatures.

A fingerprint of 64 bits is cut into so few segments that two fingerprints within the distance must
agree in one of them up to one bit. Each fingerprint is indexed under every such segment with one bit
blanked (a wildcard); two that may be linked meet under an equal key and are verified exactly. Nothing
is linked or lost by approximation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabuloom.llm.common import cut, parts, values, word_blocks
from tabuloom.llm.graph import least_reached

SEED = 42
WIDTH = 4
DISTANCE = 4
#: Members of one key that one task compares with each other; larger keys are dealt out as pairs of blocks.
BLOCK = 4096
#: Runs up to this length are compared by shifting the sorted batch, longer ones row by row.
SHORT_RUN = 48


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """SimHash of the word shingles; fewer words than a shingle are one shingle, no words give zero."""
    count, ones = 0, np.zeros(64, dtype=np.int64)
    carried: list[bytes] = []
    for block in word_blocks(text.lower()):
        words = carried + block
        if len(words) >= width:
            joined = b" ".join(words)
            ends = (np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1).tolist()
            starts = [0] + [e + 1 for e in ends[: len(words) - width]]
            digest = xxhash.xxh64_intdigest
            hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[width - 1:])], dtype="<u8")
            count += len(hashes)
            for at in range(0, len(hashes), 1 << 15):
                bits = np.unpackbits(hashes[at:at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                ones += bits.sum(axis=0, dtype=np.int64)
            carried = words[len(words) - width + 1:]
        else:
            carried = words
    if not count:
        if not carried:
            return 0
        return xxhash.xxh64_intdigest(b" ".join(carried), SEED)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(key, fp) per row of `docs`; a null text is an empty one, fp is the fingerprint as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, width) for t in values(batch.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["k", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("k"), F.col(text).cast("string")).mapInArrow(run, f"k {kind}, fp long").withColumnRenamed("k", key)


def segments(distance: int) -> list[tuple[int, int]]:
    """(first bit, bits) of the fewest segments of which one differs by one bit at most."""
    n = distance // 2 + 1
    edges = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def variants(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(key, fp): every fingerprint under each segment with one bit blanked; key holds the bit and the rest."""
    wide = max(n for _, n in segments(distance))
    low = F.lit(None)
    mask = F.lit(None)
    for first, n in segments(distance):
        inside = (F.col("bit") >= first) & (F.col("bit") < first + n)
        low = F.when(inside, F.lit(first)).otherwise(low)
        mask = F.when(inside, F.lit((1 << n) - 1).cast("long")).otherwise(mask)
    rows = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit"))
    rows = rows.select("fp", "bit", low.cast("int").alias("low"), mask.alias("mask"))
    rest = "(shiftrightunsigned(fp, low) & mask & ~shiftleft(1L, bit - low))"
    return rows.select(F.expr(f"shiftleft(cast(bit as long), {wide}) | {rest}").alias("key"), "fp")


def links(fps: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """(a, b) links whose components are those of all pairs of different `fp` within the distance.

    `fps` holds each fingerprint once. Equal keys are compared in one task; a key with more members
    than `block` is dealt out as pairs of blocks, so no task gets more than two blocks of a key. Of
    each run only links that join two groups are returned, never all pairs.
    """
    indexed = variants(fps, distance)
    large = indexed.groupBy("key").count().where(F.col("count") > block).select("key", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    dealt = indexed.join(large, "key", "left").select("key", "fp", F.coalesce("blocks", F.lit(1)).alias("blocks"))
    own = F.expr("cast(pmod(xxhash64(fp), blocks) as int)")
    pairs = F.when(F.col("blocks") == 1, F.array(F.struct(F.lit(0).alias("p"), F.lit(0).alias("q")))).otherwise(
        F.expr("transform(filter(sequence(0, blocks - 1), x -> x != own), x -> struct(least(own, x) as p, greatest(own, x) as q))"))
    runs = dealt.withColumn("own", own).select("key", "fp", F.explode(pairs).alias("pair")).select("key", "pair.p", "pair.q", "fp")
    runs = runs.repartition(parts(fps.sparkSession), "key", "p", "q").sortWithinPartitions("key", "p", "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = np.column_stack([batch.column(i).to_numpy() for i in range(4)])
            held = rows if held is None else np.concatenate([held, rows])
            same = (held[:, :3] == held[-1, :3]).all(axis=1)
            last = len(held) - int(same[::-1].argmin()) if not same.all() else 0
            if last:
                yield _linked(held[:last], distance)
                held = held[last:]
        if held is not None:
            yield _linked(held, distance)

    return runs.mapInArrow(run, "a long, b long").distinct()


def _linked(rows: np.ndarray, distance: int) -> pa.RecordBatch:
    fresh = np.ones(len(rows), dtype=bool)
    fresh[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
    starts = np.flatnonzero(fresh)
    lengths = np.diff(np.append(starts, len(rows)))
    number = np.repeat(np.arange(len(starts)), lengths)
    fp = rows[:, 3].astype(np.int64).view(np.uint64)
    a, b = [], []
    short = (lengths <= SHORT_RUN)[number] & (lengths > 1)[number]
    s_fp, s_run = fp[short], number[short]
    found: list[np.ndarray] = []
    for shift in range(1, min(int(lengths[lengths <= SHORT_RUN].max(initial=0)), SHORT_RUN)):
        at = np.flatnonzero(s_run[shift:] == s_run[:-shift])
        if not len(at):
            break
        at = at[np.bitwise_count(s_fp[at] ^ s_fp[at + shift]) <= distance]
        if len(at):
            found.append(np.column_stack([s_fp[at], s_fp[at + shift]]))
    if found:
        root: dict[int, int] = {}
        for x, y in np.unique(np.concatenate(found), axis=0).tolist():
            p, q = _root(root, x), _root(root, y)
            if p != q:
                root[p] = q
                a.append(x)
                b.append(y)
    for at in np.flatnonzero(lengths > SHORT_RUN):
        run = fp[starts[at]:starts[at] + lengths[at]]
        group = np.arange(len(run))
        for i in range(1, len(run)):
            near = np.flatnonzero(np.bitwise_count(run[:i] ^ run[i]) <= distance)
            for g in np.unique(group[near]):
                if g != group[i]:
                    a.append(int(run[i]))
                    b.append(int(run[near[group[near] == g][0]]))
                    group[group == g] = group[i]
    return pa.RecordBatch.from_arrays([pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (a, b)], ["a", "b"])


def _root(parent: dict[int, int], x: int) -> int:
    while parent.get(x, x) != x:
        parent[x] = parent.get(parent[x], parent[x])
        x = parent[x]
    return x


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """(key, fingerprint, component_id) per row of `docs`.

    Rows whose fingerprints differ in `distance` bits or fewer are linked; component_id is the least
    key reached, its own included. Null and empty texts share fingerprint zero and are linked like any
    other. A null key is kept and never the least one, unless its component has no other. Repeated
    rows stay repeated; an empty table gives an empty one; other columns are not read.
    """
    own = cut(fingerprints(docs, key, text, width))
    fps = own.groupBy("fp").agg(F.min(key).alias("least"))
    ids = least_reached(fps, links(fps.select("fp"), distance, block), "fp", "least")
    return own.join(ids, "fp").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE, width: int = WIDTH) -> DataFrame:
    """One row of each component, that with the least key; of rows repeating that key any one.

    Rows with a null key cannot be told apart and stay. All columns of `docs` are returned.
    """
    found = near_duplicates(docs, key, text, distance, width)
    kept = found.where(F.col(key) == F.col("component_id")).select(key).distinct()
    return docs.join(kept, key, "left_semi").dropDuplicates([key]).unionByName(docs.where(F.col(key).isNull()))

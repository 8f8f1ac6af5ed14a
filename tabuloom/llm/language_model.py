"""A word bigram model by deleted interpolation.

The probability of a word mixes its maximum-likelihood estimates after the previous word, by itself, and
as one of all known words or the unknown one. The weights depend on a bucket of how often the previous
word was seen; they are learned by expectation-maximisation on held-out counts: each training token is
deleted in turn from the counts that predict it.

All counts are over all training documents. Words are counted by a hash of 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabuloom.llm import chunks, hashing
from tabuloom.llm.bpe import _arrow
from tabuloom.llm.common import BLOCK_BYTES, WORD_SPACE, cut

END, BEGIN = np.uint64(1), np.uint64(2)
IS_WORD = np.array([i not in WORD_SPACE for i in range(256)])
#: Buckets of context frequency: 0, 1, 2-3, 4-7, ...
BUCKETS = 64
#: Ratios of estimates are binned at a quarter of a natural logarithm for the expectation-maximisation.
BINS = 4
FAR = 1 << 9
SMOOTH = 0.1


def tokens(text: bytes) -> np.ndarray:
    """Hashes of the words in lower case (A-Z), then the end."""
    data = np.frombuffer(text.lower(), dtype=np.uint8)
    found, start = [], 0
    while start < len(data):
        stop = min(len(data), start + BLOCK_BYTES)
        while stop < len(data) and IS_WORD[data[stop]]:
            stop += 1
        found.append(hashing.words(data[start:stop], IS_WORD)[0])
        start = stop
    return np.concatenate([*found, np.array([END])])


def _many(texts: list[bytes]) -> list[np.ndarray]:
    """The tokens of many short texts in one go."""
    joined = np.frombuffer(b" ".join(texts).lower(), dtype=np.uint8)
    found, start, _ = hashing.words(joined, IS_WORD)
    ends = np.cumsum([len(t) + 1 for t in texts])
    cuts = np.searchsorted(start, ends)
    return [np.append(found[a:b], END) for a, b in zip([0, *cuts[:-1]], cuts)]


def _chunks(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[tuple]:
    """(name, distinct words sorted, keys, held out, codes of all tokens, tokens a document) for each chunk."""
    task, number = TaskContext.get().partitionId(), 0
    keys, held, texts, size = [], [], [], 0

    def done() -> tuple:
        found = _many(texts) if len(texts) > 1 else [tokens(texts[0])]
        lengths = np.array([len(x) for x in found])
        distinct, codes = np.unique(np.concatenate(found), return_inverse=True)
        return chunks.name(task, number, distinct.tobytes()), distinct, keys, held, codes.astype(np.uint32), lengths

    for batch in batches:
        for key, out, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.large_binary())):
            text = value.as_py() or b""
            if size and size + len(text) > chunk:
                yield done()
                keys, held, texts, size, number = [], [], [], 0, number + 1
            keys.append(key)
            held.append(out)
            texts.append(text)
            size += len(text) + 1
    if keys:
        yield done()


def _bigrams(distinct: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the distinct bigrams sorted, number of its bigram for each token)."""
    previous = np.empty(len(codes), dtype=np.int64)
    previous[1:] = codes[:-1]
    previous[np.cumsum(lengths) - lengths] = len(distinct)
    pair, at = np.unique(previous * (len(distinct) + 1) + codes, return_inverse=True)
    known = np.append(distinct, BEGIN)
    hashed = hashing.pairs(known[pair // (len(distinct) + 1)], known[pair % (len(distinct) + 1)])
    order = np.argsort(hashed)
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    return hashed[order], rank[at]


def _count_part(rows: pa.Table) -> pa.Table:
    """Training counts of the words or bigrams of one part, for each chunk in the order of its keys."""
    keys = [chunks.unpack_sorted(x) for x in rows.column("keys").to_pylist()]
    counts = [chunks.unpack(x, "<u8") for x in rows.column("counts").to_pylist()]
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate(counts)).astype(np.uint64)
    ends = np.cumsum([len(k) for k in keys])
    found = [chunks.pack(total[at[e - len(k):e]], "<u8") for k, e in zip(keys, ends)]
    first = np.zeros(len(keys), dtype=np.int64)
    first[0] = int((total > 0).sum())
    return pa.table({
        "kind": rows.column("kind"), "chunk": rows.column("chunk"), "part": rows.column("part"), "counts": pa.array(found, pa.binary()),
        "n": pa.array([int(c.sum()) for c in counts], pa.int64()), "types": pa.array(first)})


def _join_by_position(found: pa.Table, docs: pa.Table) -> pa.Table:
    """For each document the training counts of its tokens and of its bigrams."""
    def of(kind: int) -> np.ndarray:
        own = found.filter(pa.compute.equal(found.column("kind"), kind)) if found.num_rows else found
        listed = own.column("counts").to_pylist()
        return np.concatenate([np.zeros(0, dtype=np.uint64), *(chunks.unpack(listed[i], "<u8") for i in np.argsort(own.column("part").to_numpy()))])

    unigrams, bigrams = of(0), of(1)
    coded = [chunks.unpack(x) for x in docs.column("codes").to_pylist()]
    lengths = np.array([len(c) for c in coded])
    distinct = chunks.unpack_sorted(next(x for x in docs.column("words").to_pylist() if x is not None))
    codes = np.concatenate(coded)
    hashed, at = _bigrams(distinct, codes, lengths)
    if len(unigrams) != len(distinct) or len(bigrams) != len(hashed):
        raise RuntimeError("the documents came in another order when read again; checkpoint the table first")
    ends = np.cumsum(lengths)
    spans = list(zip(ends - lengths, ends))
    ours = pa.compute.equal(found.column("kind"), 0)
    totals = [pa.compute.sum(found.filter(ours).column(c)).as_py() for c in ("n", "types")]
    once = np.zeros((2, len(coded)), dtype=np.int64)
    once[:, 0] = totals
    single, double = unigrams[codes], bigrams[at]
    return pa.table({
        "k": docs.column("k"), "held_out": docs.column("held_out"),
        "single": pa.array([chunks.pack(single[a:b], "<u8") for a, b in spans], pa.binary()),
        "double": pa.array([chunks.pack(double[a:b], "<u8") for a, b in spans], pa.binary()),
        "n": pa.array(once[0]), "types": pa.array(once[1])})


def counts(docs: DataFrame, key: str, text: str, held_out: Column, chunk: int = chunks.CHUNK_BYTES) -> DataFrame:
    """(k, held_out, single, double, n, types) per document, in the checkpoint folder.

    single and double are the training counts of each token and of each token after the previous one;
    n and types add up over all rows to the training tokens and the distinct ones.
    """
    n_parts = chunks.count_parts(docs, text)
    rows = docs.select(F.col(key).alias("k"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text).cast("string").alias("t"))
    kind = docs.schema[key].dataType

    def dictionary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for called, distinct, _, held, codes, lengths in _chunks(batches, chunk):
            hashed, at = _bigrams(distinct, codes, lengths)
            learn = ~np.repeat(np.array(held, dtype=bool), lengths)
            for number, (keys, place) in enumerate(((distinct, codes), (hashed, at))):
                seen = np.bincount(place[learn], minlength=len(keys))
                part, edges = chunks.by_part(keys, n_parts)
                spans = list(zip(edges[:-1], edges[1:]))
                yield pa.RecordBatch.from_pydict({
                    "kind": pa.array([number] * len(spans), pa.int32()), "chunk": [called] * len(spans), "part": pa.array(part),
                    "keys": pa.array([chunks.pack_sorted(keys[a:b]) for a, b in spans], pa.binary()),
                    "counts": pa.array([chunks.pack(seen[a:b], "<u8") for a, b in spans], pa.binary())})

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for called, distinct, keys, held, codes, lengths in _chunks(batches, chunk):
            ends = np.cumsum(lengths)
            yield pa.RecordBatch.from_pydict({
                "chunk": [called] * len(keys), "k": pa.array(keys, _arrow(kind)), "held_out": pa.array(held, pa.bool_()),
                "codes": pa.array([chunks.pack(codes[b - n:b]) for b, n in zip(ends, lengths)], pa.binary()),
                "words": pa.array([chunks.pack_sorted(distinct)] + [None] * (len(keys) - 1), pa.binary())})

    found = rows.mapInArrow(dictionary, "kind int, chunk string, part int, keys binary, counts binary")
    found = found.repartition(n_parts, "kind", "part").groupBy("kind", "part").applyInArrow(_count_part, "kind int, chunk string, part int, counts binary, n long, types long")
    coded = rows.mapInArrow(positions, f"chunk string, k {kind.simpleString()}, held_out boolean, codes binary, words binary")
    joined = found.groupBy("chunk").cogroup(coded.groupBy("chunk")).applyInArrow(
        _join_by_position, f"k {kind.simpleString()}, held_out boolean, single binary, double binary, n long, types long")
    return cut(joined)


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else one more than the whole logarithm of its frequency."""
    return np.frexp(context)[1]


def _bin(ratio: np.ndarray) -> np.ndarray:
    """0 for no probability, else the binned logarithm."""
    with np.errstate(divide="ignore"):
        logs = np.where(ratio > 0, np.rint(BINS * np.log(np.where(ratio > 0, ratio, 1))) + FAR // 2, 0)
    return np.clip(logs, (ratio > 0).astype(float), FAR - 1).astype(np.int64)


def _context(single: np.ndarray, documents: float) -> np.ndarray:
    return np.concatenate([[documents], single[:-1]])


def deleted(found: DataFrame, n: int, types: int, documents: int) -> DataFrame:
    """(cell, n): training tokens by context bucket and binned estimates, each token deleted from its own counts.

    There are at most BUCKETS * FAR * FAR cells; the number does not grow with the corpus.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = []
            for one, two in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                single, double = chunks.unpack(one, "<u8").astype(float), chunks.unpack(two, "<u8").astype(float)
                context = _context(single, documents) - 1
                second = np.divide(double - 1, context, out=np.zeros(len(double)), where=context > 0)
                first = (single - 1) / max(n - 1, 1)
                cells.append((bucket(context) * FAR + _bin(second * (types + 1))) * FAR + _bin(first * (types + 1)))
            cell, number = np.unique(np.concatenate(cells or [np.zeros(0, dtype=np.int64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(number.astype(np.int64))], ["cell", "n"])

    learned = found.where(~F.col("held_out")).select("single", "double")
    return learned.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def weights(cells: np.ndarray, number: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Mixture weights (after the previous word, by itself, any) of each context bucket by expectation-maximisation.

    Each estimate has one token in advance, so that no weight is zero; a bucket without tokens keeps
    equal weights. Of a context never seen the first weight is zero.
    """
    at = cells // (FAR * FAR)
    binned = np.column_stack([cells // FAR % FAR, cells % FAR])
    ratio = np.column_stack([np.where(binned > 0, np.exp((binned - FAR // 2) / BINS), 0), np.ones(len(cells))])
    mixed = np.full((BUCKETS + 1, 3), 1 / 3)
    for _ in range(rounds):
        share = mixed[at] * ratio
        share *= (number / share.sum(axis=1))[:, None]
        sums = np.column_stack([np.bincount(at, weights=share[:, i], minlength=BUCKETS + 1) for i in range(3)])
        mixed = (sums + 1) / (sums + 1).sum(axis=1, keepdims=True)
    mixed[0, 0] = 0
    return mixed / mixed.sum(axis=1, keepdims=True)


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", held_out: Column | None = None, chunk: int = chunks.CHUNK_BYTES) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) per row of `docs`.

    Rows for which `held_out` holds are scored but not learned from; where it is null a row is learned
    from. base_score is that of smoothed single words, score that of the model, both as sums of log10.
    A null text is an empty one and has the end as its only token; repeated rows count repeatedly; with
    no training row every word is unknown; an empty table gives an empty one. `docs` must give its rows
    in the same order whenever it is read, as a table or a checkpoint does; otherwise the query fails.
    """
    found = counts(docs, key, text, F.lit(False) if held_out is None else held_out, chunk)
    n, types, documents = (int(x or 0) for x in found.agg(F.sum("n"), F.sum("types"), F.sum((~F.col("held_out")).cast("long"))).first())
    cells = deleted(found, n, types, documents).collect()
    mixed = weights(np.array([c[0] for c in cells], dtype=np.int64), np.array([c[1] for c in cells], dtype=float))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for one, two in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                single, double = chunks.unpack(one, "<u8").astype(float), chunks.unpack(two, "<u8").astype(float)
                context = _context(single, documents)
                own = mixed[bucket(context)]
                second = np.divide(double, context, out=np.zeros(len(double)), where=context > 0)
                p = own[:, 0] * second + own[:, 1] * single / max(n, 1) + own[:, 2] / (types + 1)
                base = np.log10((single + SMOOTH) / (n + SMOOTH * (types + 1)))
                rows.append((len(single), int((single > 0).sum()), float(base.sum()), float(np.log10(p).sum())))
            columns = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array([n] * len(rows), pa.int64()),
                 pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.float64())],
                ["k", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    out = found.select("k", "held_out", "single", "double").mapInArrow(
        run, f"k {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("k", key)

"""Quality classifier by Bradley-Terry ranking.

Each document has a latent quality, a linear function of features of its text. A document labelled good
is preferred to one labelled bad; the logistic loss on the differences of their features gives the
weights. The threshold is the quantile of the scores at the share of bad labels. Scoring is one pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabuloom.llm import hashing
from tabuloom.llm.common import BLOCK_BYTES, WORD_SPACE

#: The classifier is fitted on about so many labelled documents at most, by a hash of their key.
FIT_ROWS = 8000
PAIRS = 40_000
RIDGE = 1e-3
ROUNDS = 25

IS_WORD = np.array([i not in WORD_SPACE for i in range(256)])
LETTER = np.array([chr(i).isalpha() or i > 127 for i in range(128)] + [True] * 128)
UPPER = np.array([65 <= i <= 90 for i in range(256)])
LOWER = np.array([97 <= i <= 122 for i in range(256)])
DIGIT = np.array([48 <= i <= 57 for i in range(256)])
#: Bytes counted one by one: ASCII, and all others as one.
COLUMNS = 129
FEATURES = COLUMNS + 10


def features(text: bytes) -> np.ndarray:
    """Shares of bytes, and of words that are short, in capitals, repeated, without letters or end in none; their lengths."""
    counts, sums, start = np.zeros(256), np.zeros(8), 0
    data = np.frombuffer(text, dtype=np.uint8)
    while start < len(data):
        stop = min(len(data), start + BLOCK_BYTES)
        while stop < len(data) and IS_WORD[data[stop]]:
            stop += 1
        block = data[start:stop]
        counts += np.bincount(block, minlength=256)
        h, a, b = hashing.words(block, IS_WORD)
        if len(h):
            letters = np.add.reduceat(LETTER[block], a, dtype=np.int64)
            upper = np.add.reduceat(UPPER[block], a, dtype=np.int64)
            lower = np.add.reduceat(LOWER[block], a, dtype=np.int64)
            sums += [
                len(h), (b - a).sum(), (h[1:] == h[:-1]).sum(), len(np.unique(h)), (letters == 0).sum(),
                ((upper > 1) & (lower == 0)).sum(), ((b - a) <= 2).sum(), (~LETTER[block[b - 1]]).sum()]
        start = stop
    n, m = max(len(data), 1), max(sums[0], 1)
    shares = np.append(counts[:128], counts[128:].sum()) / n
    more = [np.log1p(len(data)), np.log1p(sums[0]), sums[1] / m, sums[2] / m, sums[3] / m, sums[4] / m, sums[5] / m, sums[6] / m, sums[7] / m, counts[UPPER].sum() / max(counts[LETTER].sum(), 1)]
    return np.concatenate([np.sqrt(shares), more])


@dataclass(frozen=True)
class Model:
    """Scores are `shift` + features . weights; 0 is the threshold."""

    weights: np.ndarray
    shift: float

    def scores(self, texts: Iterator[bytes]) -> np.ndarray:
        rows = np.array([features(t) for t in texts]).reshape(-1, FEATURES)
        return 1 / (1 + np.exp(-np.clip(rows @ self.weights + self.shift, -500, 500)))


def learn(rows: np.ndarray, good: np.ndarray, pairs: int = PAIRS, seed: int = 1) -> Model:
    """Weights of the preference of good over bad rows; without either, a score of 0.5 for every text."""
    if not good.any() or good.all():
        return Model(np.zeros(rows.shape[1] if rows.ndim == 2 else FEATURES), 0.0)
    centre, spread = rows.mean(axis=0), rows.std(axis=0)
    spread[spread < 1e-9] = np.inf
    scaled = (rows - centre) / spread
    random = np.random.default_rng(seed)
    better, worse = np.flatnonzero(good), np.flatnonzero(~good)
    x = scaled[random.choice(better, pairs)] - scaled[random.choice(worse, pairs)]
    w = np.zeros(x.shape[1])
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x / pairs + RIDGE * np.eye(len(w)), x.T @ p / pairs - RIDGE * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    scores = np.sort(scaled @ w)
    at = len(worse)
    threshold = (scores[at - 1] + scores[at]) / 2
    return Model(w / spread, float(-(centre / spread) @ w - threshold))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", learned: Column | None = None, rows: int = FIT_ROWS) -> Model:
    """A model of the labelled documents for which `learned` holds; of many, a sample of about `rows` by hash.

    Labels that are null, or differ between rows of the same key, are left out.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull())
    if learned is not None:
        known = known.where(learned)
    known = known.groupBy(key).agg(F.min(label).alias("_good"), F.max(label).alias("_other")).where("_good = _other").select(key, "_good")
    total = known.count()
    share = min(1.0, rows / max(total, 1))
    sample = known.where(F.pmod(F.xxhash64(F.col(key), F.lit(3)), F.lit(1 << 30)) < int(share * (1 << 30)))
    # The sample is bounded by `rows`, so it goes to the documents and no text is shuffled.
    chosen = docs.select(key, F.col(text).cast("string").alias("_text")).join(F.broadcast(sample), key).select("_good", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py() or b"").tolist() for t in batch.column(1).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), pa.array(found, pa.list_(pa.float64()))], ["good", "x"])

    found = chosen.mapInArrow(run, "good int, x array<double>").collect()
    found.sort(key=lambda r: (r[0], r[1]))
    return learn(np.array([r[1] for r in found]), np.array([r[0] == 1 for r in found]))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) per row of `docs`: from 0 to 1, 0.5 at the threshold.

    A null text is an empty one; null and repeated keys are kept; an empty table gives an empty one; other
    columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores(t.as_py() or b"" for t in batch.column(1).cast(pa.large_binary()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["k", "score"])

    return docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, f"k {kind}, score double").withColumnRenamed("k", key)


def keep_good(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of `docs` with a score of at least `least`, with all their columns; nothing is shuffled.

    Null texts are scored as empty ones; null and repeated keys, and any other columns, are kept as they
    are; an empty table gives an empty one.
    """
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores(t.as_py() or b"" for t in batch.column(place).cast(pa.large_binary()))
            yield batch.filter(pa.array(scores >= least))

    return docs.mapInArrow(run, docs.schema)

"""Whitening of embeddings on their leading principal components.

Entries become whole numbers on a grid, and the components are fitted on each distinct grid vector once.
Counts and sums are exact; covariances are of centred values (n x - S) / n, where n x - S is exact too, so
the large offset of the grid costs no digits. Blocks of rows are reduced in tasks and summed by Spark; the
driver holds one matrix of dimension times dimension and takes its leading eigenpairs by spectrum
slicing (spectrum.py). The distinct vectors are written to the shared folder once and read by each pass.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabuloom.llm.common import shared_folder
from tabuloom.llm.spectrum import leading

SCALE = 64
OFFSET = 1_000_000
#: Entries beyond it have no place on the grid of 64-bit numbers and count as not finite.
LARGEST = 2.0 ** 55
WIDTHS = ("<i1", "<i2", "<i4", "<i8")
SAFE = 2 ** 62
ROWS = 4096


@dataclass(frozen=True)
class Whitening:
    """What the fit list says; vectors has a row per component with variance."""

    dimension: int
    n: int
    sums: list[int]
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))
    vectors: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    trace: float = 0.0
    identity_error: float | None = None


def _grid(column: pa.Array, dimension: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and grid vectors (less OFFSET) of the usable rows, by length."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    for size in [dimension] if dimension else np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == size)
        entries = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)
        usable = (np.abs(entries) < LARGEST).all(axis=1)
        yield at[usable], np.floor(SCALE * entries[usable]).astype(np.int64)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Length and bytes of the grid vectors, in the narrowest width that holds all of a vector."""
    for batch in batches:
        for _, x in _grid(batch.column(0)):
            wide = np.abs(x).max(axis=1)
            width = np.searchsorted([2 ** 7, 2 ** 15, 2 ** 31], wide, side="right")
            for w in np.unique(width):
                block = np.ascontiguousarray(x[width == w].astype(WIDTHS[w]))
                rows = np.unique(block.view(f"V{block.strides[0]}").ravel() if len(block) else block)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(rows), x.shape[1], np.int32)), pa.array([r.tobytes() for r in rows], pa.binary())], ["dimension", "packed"])


def _unpacked(batches: Iterator[pa.RecordBatch], dimension: int) -> Iterator[np.ndarray]:
    for batch in batches:
        column = batch.column("packed")
        sizes = pc.binary_length(column).to_numpy(zero_copy_only=False)
        for size in np.unique(sizes):
            rows = column.filter(pa.array(sizes == size)).to_pylist()
            yield np.frombuffer(b"".join(rows), f"<i{size // dimension}").reshape(-1, dimension).astype(np.int64)


def _offset(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: in 64 bits where they are enough, else in Python's whole numbers. Both without OFFSET, which cancels."""
    if n * max(int(np.abs(x).max(initial=0)), 1) < SAFE and max(map(abs, sums), default=0) < SAFE:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _reduced(fit: DataFrame, dimension: int, state: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over the fit list of what `state` makes of a block: a matrix, row by row summed in Spark."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for x in _unpacked(batches, dimension):
            for start in range(0, len(x), ROWS):
                total = total + state(x[start:start + ROWS])
        if isinstance(total, np.ndarray):
            rows = np.arange(len(total), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(list(total.astype(float)))], ["i", "row"])

    cells = fit.mapInArrow(partial, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
    found = cells.groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    matrix = np.zeros((max((r.i for r in found), default=-1) + 1, max((r.j for r in found), default=-1) + 1))
    for r in found:
        matrix[r.i, r.j] = r.v
    return matrix


def _sums(fit: DataFrame, dimension: int) -> tuple[int, list[int]]:
    """Rows of the fit list and their exact sums by dimension, less OFFSET."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dimension, object)
        for x in _unpacked(batches, dimension):
            small = len(x) * int(np.abs(x).max(initial=0)) < SAFE
            n, total = n + len(x), total + (x if small else x.astype(object)).sum(axis=0).astype(object)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.arange(-1, dimension, dtype=np.int32)), pa.array([Decimal(n), *map(Decimal, map(int, total))], pa.decimal128(38, 0))], ["i", "total"])

    rows = fit.mapInArrow(partial, "i int, total decimal(38,0)").groupBy("i").agg(F.sum("total").alias("total")).collect()
    found = {r.i: int(r.total) for r in rows}
    return found.get(-1, 0), [found.get(i, 0) for i in range(dimension)]


def fit(embeddings: DataFrame, vector: str = "embedding", components: int = 16, folder: str | None = None) -> Whitening | None:
    """Components of the distinct grid vectors; None where there are none.

    Brought to the driver: sums, a matrix of dimension times dimension, and one of components times components.
    """
    folder = folder or f"{shared_folder(embeddings.sparkSession)}/whitening-{uuid.uuid4().hex}"
    packed = embeddings.select(F.col(vector).cast("array<double>").alias("x")).mapInArrow(_packed, "dimension int, packed binary")
    packed.distinct().write.parquet(f"{folder}/fit")
    distinct = embeddings.sparkSession.read.schema("dimension int, packed binary").parquet(f"{folder}/fit")
    usual = distinct.groupBy("dimension").count().orderBy(F.desc("count"), "dimension").first()
    if usual is None:
        return None
    d = usual.dimension
    fit_list = distinct.filter(F.col("dimension") == d).select("packed")
    n, sums = _sums(fit_list, d)
    model = Whitening(d, n, sums)

    def products(x: np.ndarray) -> np.ndarray:
        centred = _centred(x, model)
        return centred.T @ centred

    covariance = _reduced(fit_list, d, products) / n
    covariance = (covariance + covariance.T) / 2
    pairs = list(leading(covariance, components))
    model = replace(model, values=np.array([e for e, _ in pairs]), vectors=np.array([v for _, v in pairs]).reshape(-1, d), trace=float(np.trace(covariance)))
    if not pairs:
        return model

    def moments(x: np.ndarray) -> np.ndarray:
        w = np.column_stack([np.ones(len(x)), _whitened(_centred(x, model), model)])
        return w.T @ w

    total = _reduced(fit_list, d, moments) / n
    mean = total[0, 1:]
    error = np.abs(total[1:, 1:] - np.outer(mean, mean) - np.eye(len(pairs))).max()
    return replace(model, identity_error=float(error))


def _centred(x: np.ndarray, model: Whitening) -> np.ndarray:
    return _offset(x, model.n, model.sums).astype(float) / model.n


def _whitened(centred: np.ndarray, model: Whitening) -> np.ndarray:
    return centred @ model.vectors.T / np.sqrt(model.values)


def whiten(embeddings: DataFrame, model: Whitening | None, key: str = "vec_id", vector: str = "embedding", components: int = 16) -> DataFrame:
    """A row per usable vector and component: key, component, n, deviation, whitened, explained, identity_error.

    Usable is a vector of the model's length without null, infinite or NaN entries. Null vectors, empty ones
    and those of another length than most distinct vectors have are left out; repeated rows and null
    keys are kept. Where the fit list has less variance than components, `whitened` of the rest is
    null and `explained` 0 (null if there is no variance at all). `deviation` is decimal(38,0), null
    where that cannot hold it. Columns that are not named are not read.
    """
    kind = embeddings.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if model is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    shown = min(components, model.dimension)
    explained = np.zeros(shown)
    explained[:len(model.values)] = model.values / model.trace if model.trace else 0

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                for at, x in _grid(part.column(1), model.dimension):
                    m = len(at)
                    if not m:
                        continue
                    apart = _offset(x, model.n, model.sums)
                    white = np.full((m, shown), np.nan)
                    white[:, :len(model.values)] = _whitened(apart.astype(float) / model.n, model)
                    if apart.dtype != object and model.dimension * int(np.abs(apart).max(initial=0)) ** 2 >= SAFE:
                        apart = apart.astype(object)
                    deviation = [Decimal(v) if v < 10 ** 38 else None for v in map(int, (apart * apart).sum(axis=1))]
                    each = np.repeat(np.arange(m), shown)
                    yield pa.RecordBatch.from_arrays([
                        part.column(0).take(pa.array(at[each])), pa.array(np.tile(np.arange(1, shown + 1, dtype=np.int32), m)),
                        pa.array(np.full(len(each), model.n)), pa.array(deviation, pa.decimal128(38, 0)).take(pa.array(each)),
                        pa.array(white.ravel(), from_pandas=True),
                        pa.array(np.tile(explained, m)) if model.trace else pa.nulls(len(each), pa.float64()),
                        pa.array([model.identity_error] * len(each), pa.float64())],
                        [key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return embeddings.select(key, F.col(vector).cast("array<double>").alias("x")).mapInArrow(rows, schema)

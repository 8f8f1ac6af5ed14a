"""Exact near-duplicates of vectors by a metric range join.

Pivots partition the unit vectors of a label into cells. A vector belongs to the cell of its nearest
pivot and visits every other cell whose members may lie within the radius; the triangle inequality says
which cannot. Cells then join independently, in blocks, each block in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tabuloom.llm.common import cut
from tabuloom.llm.graph import components

COSINE = 0.93
#: Vectors of a label for each pivot, as long as there are no more pivots than PIVOTS or a quarter of the
#: root of the label's vectors: every block of vectors meets all pivots of its label.
CELL = 2000
PIVOTS = 256
#: Vectors of one side of a block join.
BLOCK = 2048
#: Distances are compared with this slack; links are decided by the cosine itself.
SLACK = 1e-7


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def spaces(vectors: DataFrame, key: str, embedding: str, label: str) -> DataFrame:
    """(k, space, v) per row: the label with the dimension, and the vector; both null if it links with nothing."""
    v = F.col(embedding)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    good = F.col(key).isNotNull() & F.col(label).isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)
    space = F.concat(F.size(v).cast("string"), F.lit("|"), F.col(label).cast("string"))
    # Adding zero makes both zeros equal.
    return vectors.select(F.col(key).alias("k"), F.when(good, space).alias("space"), F.when(good, F.transform(v, lambda x: x.cast("double") + F.lit(0.0))).alias("v"))


def _grouped(frame: DataFrame, size: int) -> DataFrame:
    """`frame` with salt and salts, groups of about `size` rows of each space."""
    sizes = frame.groupBy("space").agg(F.ceil(F.count("*") / size).cast("int").alias("salts"))
    return frame.join(sizes, "space").withColumn("salt", F.expr("cast(pmod(xxhash64(node, 1), salts) as int)"))


def _pivots(nodes: DataFrame, cell: int) -> DataFrame:
    """(space, cell, pivot): one vector of each of so many hash groups of a space."""
    sizes = nodes.groupBy("space").agg(F.least(F.ceil(F.count("*") / cell), F.greatest(F.lit(PIVOTS), F.ceil(F.sqrt(F.count("*")) / 4))).cast("int").alias("cells"))
    own = nodes.join(sizes, "space").withColumn("cell", F.expr("cast(pmod(xxhash64(node, 2), cells) as int)"))
    return own.groupBy("space", "cell").agg(F.min_by("v", "node").alias("pivot"))


def _distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * rows @ pivots.T, 0))


def _home(left: pa.Table, right: pa.Table) -> pa.Table:
    d = _distances(unit(_matrix(left.column("v"))), unit(_matrix(right.column("pivot")))) if left.num_rows else np.zeros((0, 1))
    at = d.argmin(axis=1)
    return pa.table({"space": left.column("space"), "cell": pa.array(right.column("cell").to_numpy()[at] if left.num_rows else [], pa.int32()), "far": pa.array(d.min(axis=1), pa.float64())})


def _visits(radius: float):
    """Rows of a group with the cells that each belongs to or visits."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"space": pa.array([], left.schema.field("space").type), "cell": pa.array([], pa.int32()), "home": pa.array([], pa.bool_()), "node": left.column("node"), "n": left.column("n"), "v": left.column("v")})
        d = _distances(unit(_matrix(left.column("v"))), unit(_matrix(right.column("pivot"))))
        home = d.argmin(axis=1)
        far = np.array(right.column("far").to_pylist(), dtype=float)
        reach = np.minimum(d.min(axis=1, keepdims=True) + 2 * radius, far[None, :] + radius) + SLACK
        near = d <= reach
        near[np.arange(len(home)), home] = True
        row, cell = np.nonzero(near)
        taken = left.take(pa.array(row))
        return pa.table({"space": taken.column("space"), "cell": pa.array(right.column("cell").to_numpy()[cell]), "home": pa.array(home[row] == cell), "node": taken.column("node"), "n": taken.column("n"), "v": taken.column("v")})

    return run


def _join(cosine: float):
    """Links of the members of a block with the visitors of another block of the cell.

    Returns a row (node, links) per member with links, and a row (node, other) for each link that
    joins two groups of the block pair; not all pairs.
    """
    def run(rows: pa.Table) -> pa.Table:
        own = np.array(rows.column("member").to_pylist(), dtype=bool)
        node, number = rows.column("node").to_numpy(), rows.column("n").to_numpy()
        vectors = unit(_matrix(rows.column("v")))
        a, b = np.flatnonzero(own), np.flatnonzero(~own)
        near = vectors[a] @ vectors[b].T >= cosine
        near &= node[a][:, None] != node[b][None, :]
        links = near.astype(np.int64) @ number[b]
        group, joined = np.arange(len(b)), []
        for i in np.flatnonzero(near.any(axis=1)):
            others = np.flatnonzero(near[i])
            found, first = np.unique(group[others], return_index=True)
            joined += [(int(node[a[i]]), int(node[b[others[j]]])) for j in first]
            if len(found) > 1:
                group[np.isin(group, found)] = found[0]
        some = np.flatnonzero(links)
        return pa.table({
            "node": pa.array([*node[a[some]].tolist(), *(x for x, _ in joined)], pa.int64()),
            "links": pa.array([*links[some].tolist(), *([0] * len(joined))], pa.int64()),
            "other": pa.array([*([None] * len(some)), *(y for _, y in joined)], pa.int64())})

    return run


def near_duplicates(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = COSINE, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """(key, n_links, component_id, kept) per row of `vectors`.

    Two rows with equal labels and dimensions are linked if their cosine in double precision is at least
    `cosine`. n_links counts the other rows linked directly, component_id is the least key reached, kept
    marks the row with that key. Rows without a label, and vectors that are null, empty, zero or hold a
    null or a component that is not finite, link with nothing and are kept. Equal vectors are joined once
    for all of them; rows that repeat a key count as one vector of the component. Rows with a null key
    have no links. Keys are whole numbers. Other columns are not read; an empty table gives an empty one.
    """
    if not isinstance(vectors.schema[key].dataType, IntegralType):
        raise TypeError(f"keys of vectors must be whole numbers: {key}")
    rows = spaces(vectors, key, embedding, label)
    nodes = cut(rows.where("space is not null").groupBy("space", "v").agg(F.min(F.col("k").cast("long")).alias("node"), F.count("*").alias("n")))
    radius = float(np.sqrt(2 - 2 * cosine))
    pivots = cut(_pivots(nodes, cell))
    dealt = _grouped(nodes, block)
    spread = pivots.join(nodes.groupBy("space").agg(F.ceil(F.count("*") / block).cast("int").alias("salts")), "space")
    spread = spread.select(F.col("space").alias("space"), "cell", "pivot", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    groups = dealt.groupBy("space", "salt")
    far = groups.cogroup(spread.groupBy("space", "salt")).applyInArrow(_home, "space string, cell int, far double").groupBy("space", "cell").agg(F.max("far").alias("far"))
    sized = spread.join(cut(far), ["space", "cell"])
    visits = groups.cogroup(sized.groupBy("space", "salt")).applyInArrow(_visits(radius), "space string, cell int, home boolean, node long, n long, v array<double>")
    sizes = visits.groupBy("space", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    visits = visits.join(sizes, ["space", "cell"]).withColumn("own", F.expr("cast(pmod(xxhash64(node, 3), blocks) as int)"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    member = visits.where("home").select("space", "cell", F.col("own").alias("p"), F.explode(every).alias("q"), F.lit(True).alias("member"), "node", "n", "v")
    visitor = visits.select("space", "cell", F.explode(every).alias("p"), F.col("own").alias("q"), F.lit(False).alias("member"), "node", "n", "v")
    found = cut(member.unionByName(visitor).groupBy("space", "cell", "p", "q").applyInArrow(_join(cosine), "node long, links long, other long"))
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    placed = components(found.where("other is not null"), "node", "other")
    classes = nodes.select("space", "v", "node", "n").join(linked, "node", "left").join(placed, "node", "left").select(
        "space", "v", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    judged = rows.join(classes, ["space", "v"], "left")
    component = F.coalesce("component_id", F.col("k").cast("long"))
    return judged.select(F.col("k").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("k"), F.lit(True)).alias("kept"))

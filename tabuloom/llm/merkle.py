"""Merkle manifest of a dataset, and the proof of every row against its root.

Rows are leaves. Within a source they ascend by key, and every three consecutive nodes become their
digest until one is left; the digests of the sources, in the order of their names, go on likewise to the
root. Built levels are stored in the shared folder as rows of nodes that name their parent. A recursive
query then climbs from the leaves: each step joins the parent, appends the siblings met on the way and
folds the digest of what the row holds now, so a changed row folds to another root.

H is the lower-case hex SHA-256 of its inputs one after another, digests as hex text; digests are kept
and shuffled as 32 bytes. Nine leaves that have a grandparent in common have the same siblings from
there on, so they climb in one row with a digest each; a row per leaf would carry the same siblings nine
times. Positions within a source come from runs cut at hashed bounds, so no source meets in one task.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabuloom.llm.common import shared_folder
from tabuloom.operators.ordering import position

FANOUT = 3
#: Levels that a pack of leaves has in common above it.
PACKED = 2
#: The digests of the sources have a tree of their own.
TOP = -1
NODES = ("tree long, level int, pos long, node binary, children array<binary>, slot int, "
         "up_tree long, up_level int, up_pos long, subroot boolean")
#: More than any row count of 64 bits needs, below Spark's limit on recursion in both trees together.
POWERS = [FANOUT ** i for i in range(40)]

CLIMB = """
WITH RECURSIVE climb AS (
  SELECT tree AS pack_tree, pos AS pack, node, nows, CAST('' AS BINARY) AS path, CASE WHEN subroot THEN node END AS subroot,
         slot, up_tree, up_level, up_pos
  FROM {packs}
  UNION ALL
  SELECT c.pack_tree, c.pack, n.node,
         transform(c.nows, now -> unhex(sha2(array_join(transform(n.children, (x, i) -> lower(hex(IF(i = c.slot, now, x)))), ''), 256))),
         aggregate(filter(n.children, (x, i) -> i <> c.slot), c.path, (path, x) -> concat(path, x)),
         coalesce(c.subroot, CASE WHEN n.subroot THEN n.node END), n.slot, n.up_tree, n.up_level, n.up_pos
  FROM climb c JOIN {nodes} n ON n.tree = c.up_tree AND n.level = c.up_level AND n.pos = c.up_pos
)
SELECT pack_tree, pack, node AS root, nows, path, subroot FROM climb WHERE up_tree IS NULL
"""


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def hexed(node: Column | str) -> Column:
    return F.lower(F.hex(node))


def parent(children: Column) -> Column:
    """H of the digests of a run."""
    return digest(F.array_join(F.transform(children, hexed), ""))


def folded(children: Column, slot: Column, now: Column) -> Column:
    """H of a run with the digest `now` in place of the one at `slot`."""
    return parent(F.transform(children, lambda x, i: F.when(i == slot, now).otherwise(x)))


def siblings(children: Column, slot: Column) -> Column:
    return F.filter(children, lambda x, i: i != slot)


def field(value: Column) -> Column:
    """`-` for null, else the count of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: Sequence[Column]) -> Column:
    return digest(F.concat(*[field(c) for c in columns]))


def height(n: Column) -> Column:
    """Levels above the leaves of a tree of `n` leaves."""
    return F.size(F.filter(F.array(*[F.lit(p) for p in POWERS]), lambda p: p < n))


def _stored(frame: DataFrame, path: str) -> DataFrame:
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def _runs(level: DataFrame) -> DataFrame:
    """The nodes above a level, with their children in order."""
    return level.groupBy("tree", "height", F.expr(f"pos div {FANOUT}").alias("pos"), (F.col("level") + 1).alias("level")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "node"))), lambda c: c["node"]).alias("children")
    ).withColumn("node", parent(F.col("children")))


def _linked(frame: DataFrame, top: int) -> DataFrame:
    """`frame` (tree, level, pos, node, height) with the place of each node's parent and its slot there.

    The last node of a source hangs in the tree of the sources, whose height is `top`; the root nowhere.
    """
    inside = F.col("level") < F.col("height")
    above = (F.col("tree") != TOP) & F.lit(top > 0)
    at = frame.withColumn("_at", F.when(inside, F.col("pos")).when(above, F.col("tree")))
    return at.withColumns({
        "slot": F.pmod("_at", F.lit(FANOUT)).cast("int"),
        "up_tree": F.when(inside, F.col("tree")).when(above, F.lit(TOP)).cast("long"),
        "up_level": F.when(inside, F.col("level") + 1).when(above, F.lit(1)).cast("int"),
        "up_pos": F.expr(f"_at div {FANOUT}"),
        "subroot": ~inside & (F.col("tree") != TOP)}).drop("_at")


def _leaves(rows: DataFrame, source: str, key: str, columns: Sequence[str], changed: Mapping[str, Column], folder: str) -> tuple[DataFrame, DataFrame]:
    """The sources by number with their size and height, and the leaves by place."""
    now = [changed.get(c, F.col(c)) for c in columns]
    hashed = _stored(rows.select(
        F.col(source).cast("string").alias("source"), F.col(key).alias("key"),
        leaf([F.col(c) for c in columns]).alias("leaf"), leaf(now).alias("now")), f"{folder}/hashed")
    run_rows = max(256, hashed.count() // 4096)
    sizes = hashed.groupBy("source").agg(F.count("*").alias("n"))
    trees = _stored(position(sizes, [], [F.col("source")], "tree", run_rows).select(
        "source", "n", (F.col("tree") - 1).cast("long").alias("tree"), height(F.col("n")).alias("height")), f"{folder}/trees")
    placed = position(hashed, ["source"], [F.col("key"), F.col("leaf"), F.col("now")], "place", run_rows)
    named = trees.select(F.col("source").alias("of"), "tree", "height")
    return trees, placed.join(named, F.col("source").eqNullSafe(F.col("of"))).select(
        "key", "leaf", "now", "tree", "height", (F.col("place") - 1).cast("long").alias("place"))


def _packs(leaves: DataFrame) -> DataFrame:
    """Leaves by their ancestor of level PACKED, or the last node of a lower tree, and what they fold to there."""
    size = FANOUT ** PACKED
    grouped = leaves.groupBy("tree", "height", F.expr(f"place div {size}").alias("pos")).agg(
        F.array_sort(F.collect_list(F.struct("place", "key", "leaf", "now"))).alias("held"))
    packs = grouped.withColumns({
        "level": F.least("height", F.lit(PACKED)), "nodes": F.transform("held", lambda h: h["leaf"]),
        "held": F.transform("held", lambda h: F.struct(h["key"].alias("key"), h["leaf"].alias("leaf"), F.lit(b"").alias("path"), h["now"].alias("now")))})
    for step in range(PACKED):
        runs = F.transform(F.sequence(F.lit(0), F.expr(f"(size(nodes) - 1) div {FANOUT}")), lambda i: F.slice("nodes", i * FANOUT + 1, FANOUT))
        width = FANOUT ** step
        run_of = lambda j: F.get("runs", (j / (width * FANOUT)).cast("int"))
        slot = lambda j: ((j / width).cast("int") % FANOUT)
        climbed = F.transform("held", lambda h, j: F.struct(
            h["key"].alias("key"), h["leaf"].alias("leaf"),
            F.aggregate(siblings(run_of(j), slot(j)), h["path"], lambda path, x: F.concat(path, x)).alias("path"),
            folded(run_of(j), slot(j), h["now"]).alias("now")))
        higher = F.col("height") > step
        packs = packs.withColumn("runs", F.when(higher, runs)).withColumns({
            "held": F.when(higher, climbed).otherwise(F.col("held")),
            "nodes": F.when(higher, F.transform("runs", parent)).otherwise(F.col("nodes"))}).drop("runs")
    return packs.withColumn("node", F.get("nodes", F.lit(0))).drop("nodes")


def _levels(level: DataFrame, low: int, high: int, top: int, path: str) -> list[str]:
    """Store the levels above `low` up to `high`, each built from the one below; the folders."""
    folders = []
    for i in range(low + 1, high + 1):
        runs = _runs(level.filter(F.col("height") >= i).select("tree", "height", "level", "pos", "node"))
        level = _stored(_linked(runs, top).select(*_names(), "height"), f"{path}-{i}")
        folders.append(f"{path}-{i}")
    return folders


def _names() -> list[str]:
    return [c.split()[0] for c in NODES.split(", ")]


def _read(spark: SparkSession, folders: list[str]) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], NODES)
    return spark.read.schema(f"{NODES}, height int").parquet(*folders).drop("height")


def prove(rows: DataFrame, source: str = "source", key: str = "doc_id", columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
          changed: Mapping[str, Column] | None = None, folder: str | None = None) -> DataFrame:
    """Leaf, source digest, root, proof and folded root of every row.

    A leaf is H of `columns`; `changed` gives what some of them hold now, and the row folds from that with
    the siblings of the original tree. Returns key, leaf, subroot, root, proof (the siblings met on the
    way, as hex text), folded_root and verified (folded_root is root). Leaves, nodes and climbed paths are
    written under `folder`, a new one in the shared folder unless given.

    Nulls count as `-` in any column; a null source is a source and comes first, a null key is the
    smallest. Rows of one key ascend by their leaf, so repeated rows are leaves like any others. Of an
    empty table nothing is returned. Texts of any length are hashed in the row that holds them; columns
    that are not named are not read.
    """
    spark = rows.sparkSession
    folder = folder or f"{shared_folder(spark)}/merkle-{uuid.uuid4().hex}"
    trees, leaves = _leaves(rows, source, key, columns, changed or {}, folder)
    highest, sources = trees.agg(F.coalesce(F.max("height"), F.lit(0)), F.count("*")).first()
    top = sum(p < sources for p in POWERS)
    packs = _stored(_linked(_packs(leaves), top), f"{folder}/packs")
    inside = _levels(packs, PACKED, highest, top, f"{folder}/nodes-in")
    ends = packs.filter("subroot").select("tree", "node").unionByName(_read(spark, inside).filter("subroot").select("tree", "node"))
    base = ends.select(F.lit(TOP).cast("long").alias("tree"), F.lit(top).alias("height"), F.lit(0).alias("level"), F.col("tree").alias("pos"), "node")
    nodes = _read(spark, inside + _levels(base, 0, top, top, f"{folder}/nodes-top"))

    # The limit of a million rows guards against recursion without end; this one ends at the root.
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit, None)
    spark.conf.set(limit, -1)
    try:
        climbers = packs.withColumn("nows", F.transform("held", lambda h: h["now"])).drop("held")
        paths = _stored(spark.sql(CLIMB, packs=climbers, nodes=nodes), f"{folder}/paths")
    finally:
        if before is None:
            spark.conf.unset(limit)
        else:
            spark.conf.set(limit, before)

    own = packs.select(F.col("tree").alias("pack_tree"), F.col("pos").alias("pack"), "held")
    each = own.join(paths, ["pack_tree", "pack"]).select("subroot", "root", "path", F.inline(F.arrays_zip("held", "nows")))
    root, fold = hexed("root"), hexed("nows")
    return each.select(
        F.col("held.key").alias(key), hexed(F.col("held.leaf")).alias("leaf"), hexed("subroot").alias("subroot"), root.alias("root"),
        F.concat(hexed(F.col("held.path")), hexed("path")).alias("proof"), fold.alias("folded_root"), (fold == root).alias("verified"))

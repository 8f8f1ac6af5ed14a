"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabuloom.llm.common import cut

MAX_ROUNDS = 60


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of a link to another node; component is the least node reached.

    Alternating star contraction: each round moves every link to the least neighbour, once towards
    larger and once towards smaller nodes, until all links form stars. Only minima are aggregated, so
    a hub is combined on the map side, and its links may be split over tasks in the join. Loops and
    links with a null end are left out; repeated links count once; an empty table gives an empty one.
    """
    stars = cut(_down(links.select(F.col(a).alias("u"), F.col(b).alias("v"))))
    state = _state(stars)
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        stars = cut(_small(_large(stars)))
        last, state = state, _state(stars)
        if state == last:
            break
    else:
        raise RuntimeError(f"no stars after {MAX_ROUNDS} rounds")
    roots = stars.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return stars.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots)


def _down(links: DataFrame) -> DataFrame:
    return links.where("u != v").select(F.greatest("u", "v").alias("hi"), F.least("u", "v").alias("lo")).distinct()


def _large(stars: DataFrame) -> DataFrame:
    both = stars.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(stars.select("lo", "hi"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))


def _small(links: DataFrame) -> DataFrame:
    links = links.distinct()
    least = links.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = links.join(least, "hi").where("lo != m").select(F.col("lo").alias("u"), F.col("m").alias("v"))
    return _down(moved.unionAll(least.select("hi", "m")))


def _state(stars: DataFrame) -> tuple:
    return tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def least_reached(nodes: DataFrame, links: DataFrame, node: str, least: str) -> DataFrame:
    """(node, component_id) for every row of `nodes`: the least of their `least` in its component.

    Nodes are named by that value first (null last, the node itself to tell equal ones apart), so the
    least name of a component is the answer and no component is ever grouped.
    """
    name = F.struct(F.col(least).isNull().alias("none"), F.col(least).alias("least"), F.col(node).alias("node"))
    named = nodes.select(F.col(node).alias("at"), name.alias("name"))
    one, two = named.select(F.col("at").alias("a"), F.col("name").alias("u")), named.select(F.col("at").alias("b"), F.col("name").alias("v"))
    grouped = components(links.select("a", "b").join(one, "a").join(two, "b"), "u", "v")
    met = named.join(grouped, named["name"] == grouped["node"], "left")
    return met.select(F.col("at").alias(node), F.coalesce(F.col("component.least"), F.col("name.least")).alias("component_id"))

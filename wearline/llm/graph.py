"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored


def _ranked(name: str) -> Column:
    """A node with its hash in front: an order in which no chain of links ascends for long."""
    return F.struct(F.xxhash64(name).alias("h"), F.col(name).alias("v"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); the root is the component's least node.

    Each round every node takes the name of its first neighbour in hash order (or keeps its own, if that
    comes before), and the links are renamed with it, made distinct, and dropped where both ends have one
    name. So nodes and links shrink by a factor a round, and a hub's links vanish with its neighbours.
    What a round makes is a written table: a lost executor costs one round, plans do not grow, and sizes
    are known. Links with a null end are ignored.
    """
    ends = stored(links.filter("a IS NOT NULL AND b IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    names = None
    while True:
        both = ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = stored(both.groupBy("a").agg(F.min(_ranked("b")).alias("low")).select(F.col("a").alias("old"), F.least(_ranked("a"), F.col("low"))["v"].alias("new")))
        if names is None:
            names = step.select(F.col("old").alias("node"), F.col("new").alias("root"))
        else:
            names = stored(names.join(step, names["root"] == step["old"], "left").select("node", F.coalesce("new", "root").alias("root")))
        renamed = ends.join(step.select(F.col("old").alias("a"), F.col("new").alias("x")), "a").join(step.select(F.col("old").alias("b"), F.col("new").alias("y")), "b")
        ends = stored(renamed.filter("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        if ends.isEmpty():
            least = names.groupBy("root").agg(F.min("node").alias("least"))
            return stored(names.join(least, "root").select("node", F.col("least").alias("root")))

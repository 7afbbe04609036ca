"""Connected components of a distributed edge list by smallest label, with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp) of every node that an edge names; comp is the smallest node of its component.

    Each round takes the smallest label among a node and its neighbours, then the label of that
    label.  A hub's neighbours are only ever reduced by a partial minimum.  Rounds are written to the
    shared folder.
    """
    both = cut(edges.select(F.col(a).alias("node"), F.col(b).alias("other")).unionByName(edges.select(F.col(b).alias("node"), F.col(a).alias("other"))).distinct())
    labels = cut(both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("comp")))
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "comp"), "other").groupBy("node").agg(F.min("comp").alias("near"))
        step = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
        new = cut(step.join(jump, "comp", "left").select("node", "old", F.least("comp", F.coalesce("far", "comp")).alias("comp")))
        changed = not new.where(F.col("old") != F.col("comp")).isEmpty()
        labels = new.select("node", "comp")
        if not changed:
            return labels


def merge(comp: DataFrame, links: DataFrame) -> DataFrame:
    """(node, comp) after more links (a, b): only labels that they join are worked on. A node that comp lacks is its own component."""
    label = lambda x: comp.select(F.col("node").alias(x), F.col("comp").alias(f"c{x}"))
    edges = links.join(label("a"), "a", "left").join(label("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b").distinct()
    joined = components(edges)
    moved = comp.join(joined.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
    return cut(moved.unionByName(joined.join(comp.select("node"), "node", "left_anti")))


def forest(links: DataFrame) -> DataFrame:
    """(node, comp) of links (a, b) with a < b and one a for each b: b's parent. Labels jump to their own label until they are roots."""
    labels = cut(links.select(F.col("b").alias("node"), F.col("a").alias("comp")))
    while True:
        up = labels.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
        new = cut(labels.join(up, "comp", "left").select("node", F.coalesce("far", "comp").alias("comp"), F.col("far").isNotNull().alias("moved")))
        labels = new.select("node", "comp")
        if new.where("moved").isEmpty():
            return labels.unionByName(labels.select(F.col("comp").alias("node"), "comp").distinct())

"""Connected components of an edge table, without gathering links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component): the least node that each node of edges (a, b) reaches.

    Every round takes the least label among a node and its neighbours, gives it to the node's old
    label too, then jumps to the label's own label, until no neighbour has a lesser one. Minima are combined
    before they are shuffled, so a node with very many links costs a task no more rows than others.
    Tables of a round go when the next round's are there. No edges: no rows. Loops and repeated
    edges change nothing; an edge with a null end is ignored.
    """
    edges = edges.where("a is not null and b is not null and a <> b")
    both = scratch.write(edges.select("a", "b").union(edges.select("b", "a")), "both")
    labels = scratch.write(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")), "labels")
    while True:
        old = labels.select(F.col("node").alias("a"), F.col("label").alias("old"))
        # what a neighbour has, for the node and for the label that the node has
        offers = both.join(old, "a").select(F.col("b").alias("node"), F.col("old").alias("label"))
        near = offers.groupBy("node").agg(F.min("label").alias("near"))
        near = scratch.write(labels.join(near, "node").select("node", "label", F.least("label", "near").alias("near")), "near")
        if not near.where("near < label").limit(1).count():
            return labels.select("node", F.col("label").alias("component"))
        hooked = near.groupBy(F.col("label").alias("node")).agg(F.min("near").alias("hook"))
        moved = near.join(hooked, "node", "left").select("node", "label", F.least("near", F.coalesce("hook", "near")).alias("now"))
        moved = scratch.write(moved, "moved")
        up = moved.select(F.col("node").alias("now"), F.col("now").alias("up"))
        labels = scratch.write(moved.join(up, "now").select("node", F.least("now", "up").alias("label")), "labels")

"""Connected components by hooking, pointer doubling and contraction over stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stored import dropped, stored


def components(edges: DataFrame) -> DataFrame:
    """(u, v) -> (node, label): the smallest node of each connected component, for every node with an edge.

    Each node hooks to its smallest neighbour; pointers are doubled until every tree is a star, so a chain of n nodes
    takes log2(n) steps; then edges are renamed to the stars' centres and deduplicated, until none is left. Two rounds
    at least halve the centres. Every step is joins and partial aggregates; nothing is collected.
    """
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    e = stored(both.where("u <> v").distinct(), "edges")
    labels = None
    while True:
        p = stored(e.groupBy("u").agg(F.least("u", F.min("v")).alias("p")), "parents")
        while True:
            q = p.select(F.col("u").alias("p"), F.col("p").alias("pp")).hint("merge")
            nxt = stored(p.select("u", "p").join(q, "p").select("u", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")), "parents")
            dropped(p)
            p = nxt
            if p.where("moved").isEmpty():
                break
        if labels is None:
            nxt = stored(p.select(F.col("u").alias("node"), F.col("p").alias("label")), "labels")
        else:
            to = p.select(F.col("u").alias("label"), F.col("p").alias("to")).hint("merge")
            nxt = stored(labels.join(to, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
            dropped(labels)
        labels = nxt
        a = p.select("u", F.col("p").alias("lu")).hint("merge")
        b = p.select(F.col("u").alias("v"), F.col("p").alias("lv")).hint("merge")
        left = stored(e.join(a, "u").join(b, "v").where("lu <> lv").select(F.col("lu").alias("u"), F.col("lv").alias("v")).distinct(), "edges")
        dropped(e)
        dropped(p)
        e = left
        if e.isEmpty():
            dropped(e)
            return labels

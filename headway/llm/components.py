"""Connected components of a table of links, by contraction.

In each round every node takes its smallest neighbour as parent if that is
smaller, parents are followed to their roots, and links are rewritten to roots;
links inside one root vanish. Everything stays in tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.llm.tables import stage


def _tidy(a: str, b: str):
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b); the component is its smallest node."""
    edges = stage(links.select(*_tidy("a", "b")).filter("a <> b").distinct(), "links")
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        parents = stage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("other")).select("node", F.least("node", "other").alias("parent")), "parents")
        while True:
            up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("root"))
            moved = (F.col("root") != F.col("parent")).alias("moved")
            jumped = stage(parents.join(up, "parent").select("node", F.col("root").alias("parent"), moved), "parents")
            parents = jumped.select("node", "parent")
            if jumped.filter("moved").isEmpty():
                break
        if labels is None:
            labels = parents.select("node", F.col("parent").alias("component"))
        else:
            up = parents.select(F.col("node").alias("component"), F.col("parent").alias("root"))
            labels = stage(labels.join(up, "component", "left").select("node", F.coalesce("root", "component").alias("component")), "labels")
        pa = parents.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        pb = parents.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        edges = stage(edges.join(pa, "a").join(pb, "b").filter("pa <> pb").select(*_tidy("pa", "pb")).distinct(), "links")
    if labels is None:
        labels = edges.select(F.col("a").alias("node"), F.col("a").alias("component"))
    return labels

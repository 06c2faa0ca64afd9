"""Connected components of a table of links, by smallest labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penlake.llm.common import hot_keys, join_unique, materialise


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of edges (a, b: long), root being the smallest node of its component.

    In each round a node takes the smallest label among its own, its neighbours' and its label's: one join of arcs (to
    neighbours and to labels) with labels, and one sum over nodes with partial aggregation. Nodes with very many
    neighbours, or that are labels of very many, are joined by broadcast. Rounds go on until nothing changes (labels only
    fall); each is written to the shared folder, so a lost executor costs one round.
    """
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")).toDF("node", "other").where("node <> other").distinct(), "edges")
    hubs = hot_keys(both, "other")
    labels = materialise(both.groupBy("node").agg(F.min("other").alias("root")).select("node", F.least("node", "root").alias("root")), "labels")
    n = labels.count()
    while True:
        arcs = both.union(labels.select("node", "root"))
        hot = sorted({*hubs, *hot_keys(labels, "root", n)})
        heard = join_unique(arcs, labels.select(F.col("node").alias("other"), "root"), "other", hot=hot).select("node", "root", F.lit(None).cast("long").alias("before"))
        own = labels.select("node", "root", F.col("root").alias("before"))
        after = materialise(heard.union(own).groupBy("node").agg(F.min("root").alias("root"), F.max("before").alias("before")), "labels")
        labels = after.select("node", "root")
        if after.where("root <> before").isEmpty():
            return labels

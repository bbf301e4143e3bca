"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .work import written


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b); component is the smallest node that can be reached.

    Each root hooks to its smallest neighbour, the hooks are followed to their ends by doubling, links are
    moved to the ends, and what still joins two roots goes round again. A round at least halves the roots
    that have links. Minima combine before the shuffle and every join has one row a node on
    one side, so a node with very many links is no group. Steps are written to the shared folder.
    """
    spark = links.sparkSession
    open_ = written(links.where("a <> b").select("a", "b").distinct(), "links")
    labels = written(open_.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node")), "labels")
    while not open_.isEmpty():
        both = open_.union(open_.select("b", "a"))
        hooks = both.groupBy(F.col("a").alias("root")).agg(F.least(F.min("b"), F.col("root")).alias("to"))
        hooks = written(hooks, "hooks")
        while True:
            further = hooks.alias("h").join(hooks.alias("g"), F.col("h.to") == F.col("g.root"), "left").select(
                "h.root", F.coalesce("g.to", "h.to").alias("to"), (F.coalesce("g.to", "h.to") != F.col("h.to")).alias("moved")
            )
            further = written(further, "hooks")
            hooks = further.select("root", "to")
            if further.where("moved").isEmpty():
                break
        labels = written(
            labels.join(hooks, labels["component"] == hooks["root"], "left").select("node", F.coalesce("to", "component").alias("component")), "labels"
        )
        ends = hooks.withColumnsRenamed({"root": "_r", "to": "_t"})
        moved = open_.join(ends, open_["a"] == ends["_r"]).select(F.col("_t").alias("a"), "b")
        moved = moved.join(ends, moved["b"] == ends["_r"]).select("a", F.col("_t").alias("b"))
        open_ = written(moved.where("a <> b").distinct(), "links")
    return labels

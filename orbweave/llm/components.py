"""Connected components by contraction, for graphs that fit no single machine.

In each round every node picks the least node among itself and its neighbours, and all edges move to what their ends
picked. Even rounds order nodes by id (a star around its least node falls together at once), odd rounds by a hash that
changes from round to round (long paths shrink by a constant factor, whatever their ids). All grouping is by a minimum,
which Spark forms partially before it shuffles, so hubs do no harm; joins have one row for each node on one side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import saved


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v (long). A row for each node with an edge: node, root (the same for all nodes of a component)."""
    edges, labels, turn = saved(_tidy(edges), "edges"), None, 0
    first = edges
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        if turn % 2 == 0:
            picked = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("to")).select("node", F.least("node", "to").alias("to"))
        else:
            rank = lambda c: F.struct(F.xxhash64(F.lit(turn), c), F.col(c).alias("to"))  # noqa: E731, B023
            picked = both.groupBy(F.col("u").alias("node")).agg(F.min(rank("v")).alias("m")).select("node", F.least(F.col("m"), rank("node")).getField("to").alias("to"))
        picked = saved(picked, "picked")
        end = lambda c: picked.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to"))  # noqa: E731, B023
        edges = saved(_tidy(edges.join(end("u"), "u").join(end("v"), "v").select(F.col("u_to").alias("u"), F.col("v_to").alias("v"))), "edges")
        if labels is None:
            labels = picked.select("node", F.col("to").alias("root"))
        else:
            labels = saved(labels.join(picked.select(F.col("node").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root")), "labels")
        turn += 1
    return labels if labels is not None else first.select(F.col("u").alias("node"), F.col("v").alias("root"))

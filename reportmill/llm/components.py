"""Connected components of an edge table, by Spark joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import join_hot
from .store import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root (the smallest node of its component) of every node of edges (ids of any type that has an order).

    Each round every node takes the smallest root among its own and its neighbours', and then the root of that root;
    tables are written between the rounds, so a lost executor costs a round at most. Nodes with very many neighbours and
    roots of very many nodes are looked up in a broadcast of bounded size. Null ids, self-loops and repeated edges are left
    out. No edges: an empty result.
    """
    both = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null and a != b")
    both = written(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    roots = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"), "roots")
    while True:
        near = join_hot(both, roots.select(F.col("node").alias("b"), F.col("root").alias("r")), "b").groupBy(F.col("a").alias("node")).agg(F.min("r").alias("r"))
        hooked = written(roots.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "r").alias("root")), "hooked")
        if not hooked.filter("root != old").limit(1).count():
            return roots
        up = roots.select(F.col("node").alias("root"), F.col("root").alias("up"))
        roots = written(join_hot(hooked.select("node", "root"), up, "root", "left").select("node", F.least("root", F.coalesce("up", "root")).alias("root")), "roots")

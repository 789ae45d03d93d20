"""Connected components, blocks of an order and written intermediates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.session import written

__all__ = ["components", "written"]


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of links (a, b: long): the smallest node it is connected with.

    Alternates two steps until nothing changes: every node tells its larger neighbours its smallest neighbour (large star),
    then its smaller ones (small star). A node's neighbours are never gathered: minima combine before the shuffle, and the
    join that follows has one row per node on one side, so that a node with very many links can be split. The number of
    rounds grows with the logarithm of the longest chain. Each round is written, which also cuts the lineage. Self links and
    repeated links do no harm; a null end drops its link.
    """
    edges = written(links.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct(), "links")
    nodes = edges.select(F.explode(F.array("lo", "hi")).alias("node")).distinct()

    def measure(df):
        return df.agg(F.count("*"), F.sum(F.col("lo").cast("decimal(38,0)")), F.sum(F.col("hi").cast("decimal(38,0)"))).head()

    state = measure(edges)
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        both = edges.unionByName(edges.select(F.col("hi").alias("lo"), F.col("lo").alias("hi")))
        least = both.groupBy(F.col("lo").alias("hub")).agg(F.min("hi").alias("low")).select("hub", F.least("hub", "low").alias("low"))
        large = both.where("hi > lo").join(least, F.col("lo") == F.col("hub")).select(F.col("low").alias("lo"), "hi").where("lo <> hi").distinct()
        # Small star: each node has its smaller neighbours and itself; all point to the least of them.
        least = large.groupBy(F.col("hi").alias("hub")).agg(F.min("lo").alias("low"))
        small = large.join(least, F.col("hi") == F.col("hub"))
        small = small.select(F.col("low").alias("lo"), F.col("lo").alias("hi")).unionByName(small.select(F.col("low").alias("lo"), "hi")).where("lo <> hi").distinct()
        edges = written(small, "links")
        now = measure(edges)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("root"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))

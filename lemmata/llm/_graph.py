"""Connected components by DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize


def components(edges: DataFrame) -> DataFrame:
    """edges: columns a, b of one ordered type. Returns node, component: the smallest node reachable.

    Only nodes with an edge to another node appear. Stars are formed by turns
    (each node's neighbours are linked with its smallest neighbour), so rounds grow with the logarithm of
    the longest path. No node's neighbours are ever gathered: minima are
    aggregated before the shuffle, and hubs meet their edges in a join whose large partitions are
    split. Edges with a null end and loops are left out.
    """
    now = materialize(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .distinct()
    )
    state = None
    while True:
        new = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
        if new == state or not new[0]:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
                now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
            )
        state = new
        # larger neighbours of each node go to its smallest neighbour
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            now.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = materialize(large)
        # smaller neighbours of each node, and the node, go to the smallest
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(least, "hi")
            .where("lo <> m")
            .select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .unionByName(least.select("hi", F.col("m").alias("lo")))
            .distinct()
        )
        now = materialize(small)

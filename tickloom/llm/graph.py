"""Connected components of a link table by rounds of joins, written after each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import forget, parked


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """`node`, `root` for every node that has a link; root is the component's smallest node.

    Alternates two star operations (Kiveris and others, "Connected Components in MapReduce and Beyond"): every node hangs
    its larger neighbours on its smallest neighbour, then its smaller neighbours and itself. Links never grow in number,
    and the rounds in the logarithm of the longest path. Links are counted and summed on executors; the driver sees one
    row a round.
    """
    edges = parked(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct(), "links"
    )
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = parked(moved.unionByName(low.select("u", F.col("m").alias("v"))).filter("u > v").distinct(), "links")
        forget(edges)
        edges = after
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )

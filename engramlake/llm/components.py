"""Connected components of a graph of links, by iterative joins (large-star / small-star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, scratch_paths, stored


def connected_components(links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """``links(a, b)`` of longs to ``(node, component)``, component being its smallest node.

    Each round joins links with the smallest neighbour of each node, which is aggregated before the
    shuffle; a node with very many links is then a skewed join key that Spark can split.  Rounds are
    written to the shared folder; their number grows with the logarithm of the longest path."""
    spark = links.sparkSession
    with scratch_paths() as last:
        links = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    seen = None
    for _ in range(max_rounds):
        # large star: every larger neighbour of a node is linked to the node's smallest neighbour
        both = links.union(links.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours are linked to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        with scratch_paths() as made:
            links = stored(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        discard(spark, last)
        last = made
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    out = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return out.union(links.select("v", "v").distinct())

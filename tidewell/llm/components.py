"""Connected components of a link table by alternating stars.

Each round points every node's larger neighbours, then its smaller ones, at the
smallest node it knows; rounds end when the edges no longer change.  A node
with very many links only meets a minimum (combined before the shuffle) and a
join that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import discard, store


def _stamp(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"),
                  F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in ``links`` (u, v); root is the smallest
    node of its component.  Self links and repeated links do no harm."""
    edges = store(links.where("u <> v").select(F.greatest("u", "v").alias("u"),
                                               F.least("u", "v").alias("v")).distinct(), "edges")
    stamp = _stamp(edges)
    while stamp[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")) \
            .select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("w")) \
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = store(large, "large_star")          # every edge points to a smaller node
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        old, edges = edges, store(small, "small_star")
        discard(old)
        discard(large)
        now = _stamp(edges)
        if now == stamp:
            break
        stamp = now
    roots = edges.groupBy("u").agg(F.min("v").alias("v"))
    return roots.select(F.col("u").alias("node"), F.col("v").alias("root")) \
        .unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowdex.llm.joins import lookup
from sparrowdex.storage import drop_path, stored


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], int(row["s"] or 0)


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """edges (u, v) of comparable ids -> (u, v): each linked node u but the smallest of its component, with that smallest node v.

    Every round is two min-aggregations (with partial sums on the map side) and joins on the node, in which a node with very many
    edges stays where its edges are; the edge count never grows, no neighbour list is collected, and each round ends in a shared
    table, which replaces the one before. Self-loops, repeated edges and null ends are ignored; no edges give no rows.
    """
    spark = edges.sparkSession
    e = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, path = stored(e, "edges")
    before = _state(e)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        upward = e.select(F.col("v").alias("u"), F.col("u").alias("v"))
        large, large_path = stored(lookup(upward, least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = lookup(large, root, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e, new = stored(small.unionByName(root.select("u", F.col("m").alias("v"))).distinct(), "edges")
        drop_path(spark, path)
        drop_path(spark, large_path)
        path, after = new, _state(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components: no fixed point within max_rounds")
    return e

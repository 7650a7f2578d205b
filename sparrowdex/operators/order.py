"""Numbering rows in a total order without bringing a group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparrowdex.storage import materialise, partitions


def numbered(rows: DataFrame, order: list[Column], name: str, within: tuple[str, ...] = ()) -> DataFrame:
    """rows with their 1-based place in order within the groups, as a long column of that name.

    Rows are cut into ranges of (group, order), stored, numbered within each range and shifted by the counts of the ranges
    before it, so a group of any size is spread over as many tasks as it needs. The order should be total, as rows
    equal in it share a range. Nulls in the group columns form a group; an empty table gives an empty one.
    """
    keys = [F.col(c) for c in within]
    cut = rows.repartitionByRange(partitions(rows.sparkSession), *keys, *order).withColumn("_range", F.spark_partition_id())
    held = materialise(cut, "ranges")
    group = [F.col(c) for c in (*within, "_range")]
    count = held.groupBy(*group).agg(F.count("*").alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_range")) - F.col("_n")
    before = count.select(F.struct(*group).alias("_of"), earlier.alias("_before"))
    here = held.withColumn("_at", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    joined = here.join(before, F.struct(*group).eqNullSafe(F.col("_of")))
    return joined.withColumn(name, F.col("_before") + F.col("_at")).drop("_range", "_at", "_of", "_before")

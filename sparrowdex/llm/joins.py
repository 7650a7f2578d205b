"""Joins whose keys may be hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup(rows: DataFrame, table: DataFrame, key: str, share: int = 1000, few: int = 10_000, sizes: DataFrame | None = None) -> DataFrame:
    """rows with the columns of table (one row per key, its column named key too), nulls where it has none; null keys find nothing.

    Keys with over 1/share of all rows are fewer than share, so their rows of the table are broadcast and their rows stay where
    they are; the others are joined by a shuffle. rows is read up to four times, so give a stored or cheap table; sizes (key, n), where
    it is known how many rows frequent keys have, saves one. At most `few` rows, which any task holds, are joined plainly.
    """
    order = [*rows.columns, *(c for c in table.columns if c != key)]
    total = rows.count()
    if total > few:
        known = sizes if sizes is not None else rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
        hot = [r[0] for r in known.where(F.col("n") * share > total).select(key).collect()]
        if hot or rows.schema[key].nullable:
            of_hot = F.col(key).isin(*hot) if hot else F.lit(False)
            here = F.col(key).isNull() | of_hot
            return rows.where(here).join(F.broadcast(table.where(of_hot)), key, "left").select(*order).unionByName(rows.where(~here).join(table, key, "left").select(*order))
    return rows.join(table, key, "left").select(*order)

"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparrowdex.storage import materialise, partitions


def _same(by: list[str], prefix: str) -> Column:
    """Whether columns equal their namesakes with the prefix, nulls too."""
    return reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(prefix + c)) for c in by))


def _ranks(rows: DataFrame, key: list[str], order: list[Column], place: Column, blocks: Column, run: int, name: str) -> DataFrame:
    """rows with their 0-based rank in order within key, named name.

    place, a number from 0 to below 1 that the order follows first, deals rows into blocks; blocks are ranked on
    their own and shifted by the counts of the blocks before them, so no task holds a whole key. The counts are summed within
    runs of run blocks and over the runs before, so with the root of the number of blocks for run no task sums more than that.
    """
    dealt = rows.withColumn("_b", F.floor(place * blocks).cast("long"))
    by = [*key, "_b"]
    count = dealt.groupBy(*by).agg(F.count("*").alias("_k")).withColumn("_run", F.floor(F.col("_b") / run))
    totals = count.groupBy(*key, "_run").agg(F.sum("_k").alias("_n_run"))
    runs = totals.select(*(F.col(c).alias("_in_" + c) for c in [*key, "_run"]), (F.sum("_n_run").over(Window.partitionBy(*key or [F.lit(0)]).orderBy("_run")) - F.col("_n_run")).alias("_runs_before"))
    within = count.withColumn("_inside", F.sum("_k").over(Window.partitionBy(*key, "_run").orderBy("_b")) - F.col("_k"))
    before = within.join(runs, _same([*key, "_run"], "_in_")).select(*(F.col(c).alias("_of_" + c) for c in by), (F.col("_runs_before") + F.col("_inside")).alias("_before"))
    ranked = dealt.withColumn("_at", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.join(before, _same(by, "_of_")).withColumn(name, F.col("_before") + F.col("_at") - 1).drop("_b", "_at", "_before", *("_of_" + c for c in by))


def shuffled_place(key: Column, seed: int) -> Column:
    """A number of 60 bits from a digest of the seed and the key; null keys count as empty."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def interleave(docs: DataFrame, shards: int = 8, stratum_col: str = "source", id_col: str = "doc_id", seed: int = 42, block: int = 20_000) -> DataFrame:
    """docs with shard (from 0) and slot (its place there, gapless from 0); columns of docs with these names give way.

    Rows of a stratum are shuffled by a seeded hash and ranked; rank r of n has the fractional rank (r + 1/2) / n, by
    which all rows are sorted, and the order is cut into shards whose row counts differ by at most one. So each run of
    rows holds the strata in their overall proportions. A null stratum is a stratum; null ids hash like any other
    value; repeated rows are told apart by place only, so they are interchangeable. Empty tables give empty ones. All columns are
    carried along, and the rows are read twice: give only what is needed. Rows are ranked in blocks of about block rows, however many that makes.
    """
    spark = docs.sparkSession
    columns = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    s = F.col(f"_in.`{stratum_col}`") if stratum_col in columns else F.lit(None)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("_in"))
    rows = rows.select("_in", s.cast("string").alias("_s"), shuffled_place(F.col(f"_in.`{id_col}`"), seed).alias("_h"), F.xxhash64(F.col("_in")).alias("_tie"))
    sizes = materialise(rows.groupBy("_s").agg(F.count("*").alias("_n")), "strata")
    total = sizes.agg(F.sum("_n").alias("n")).first()["n"] or 0
    blocks = max(1, -(-total // block), 4 * partitions(spark))
    run = math.isqrt(blocks)
    sized = sizes.select(F.col("_s").alias("_sn"), "_n", F.greatest(F.lit(1), F.ceil(F.col("_n") * F.lit(blocks) / F.lit(max(1, total)))).alias("_blocks"))
    known = rows.join(sized, F.col("_s").eqNullSafe(F.col("_sn"))).drop("_sn")
    unit = F.col("_h").cast("double") * F.lit(2.0**-60)
    order = [F.col("_h"), F.col(f"_in.`{id_col}`"), F.col("_tie")]
    shuffled = _ranks(known, ["_s"], [unit, *order], unit, F.col("_blocks"), run, "_r")
    fraction = (F.col("_r") + 0.5) / F.col("_n")
    placed = _ranks(shuffled.withColumn("_f", fraction), [], [F.col("_f"), F.col("_s"), *order], F.col("_f"), F.lit(blocks), run, "_p")
    small, extra = divmod(total, shards)
    head = extra * (small + 1)
    p = F.col("_p")
    shard = F.when(p < head, F.floor(p / (small + 1))).otherwise(extra + F.floor((p - head) / max(1, small))).cast("int")
    first = F.lit(small) * shard + F.least(shard, F.lit(extra))
    return placed.select("_in.*", shard.alias("shard"), (p - first).cast("long").alias("slot"))


def op4(spark, docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    out = interleave(rows, 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


OP4_SQL = """
WITH table_ AS (SELECT list(c ORDER BY n) AS crc FROM (SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(n))),
bytes AS (SELECT doc_id, source, list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda x: ('0x' || x)::BIGINT) AS b, ('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
sized AS (SELECT doc_id, source, h, len(b) + 1 AS size, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32 FROM bytes, table_),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) - 1 AS r, count(*) OVER (PARTITION BY source) AS n, count(*) OVER () AS total FROM sized),
placed AS (SELECT *, row_number() OVER (ORDER BY (r + 0.5::DOUBLE) / n, source NULLS FIRST, h, doc_id) - 1 AS p, total // 8 AS small, total % 8 AS extra FROM ranked),
cut AS (SELECT *, CASE WHEN p < extra * (small + 1) THEN p // (small + 1) ELSE extra + (p - extra * (small + 1)) // greatest(1, small) END AS shard FROM placed)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, shard::INT AS shard, (p - small * shard - least(shard, extra))::BIGINT AS slot, NULL::INT AS grown_shard, source FROM cut
"""

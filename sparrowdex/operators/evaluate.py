"""Recall at k by overlap of spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowdex.functions import scoring as S


def overlaps(found: DataFrame, gold: DataFrame) -> DataFrame:
    """found (question_id, path, first, last, rank) and gold (question_id, path, g_first, g_last) of one file, with iou."""
    return found.join(gold, ["question_id", "path"]).withColumn("iou", S.iou(F.col("first"), F.col("last"), F.col("g_first"), F.col("g_last")))


def recall(found: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """(k, recall, num_questions) for 1..k: the mean over questions with gold spans of the share that is found among the first k.

    Each gold span needs only the rank of its first match, so the k values cost nothing; a question without results counts 0.
    """
    first = overlaps(found, gold).where(F.col("iou") > S.MIN_IOU).groupBy("question_id", "path", "g_first", "g_last").agg(F.min("rank").alias("at"))
    spans = gold.groupBy("question_id", "path", "g_first", "g_last").agg(F.count("*").alias("n")).join(first, ["question_id", "path", "g_first", "g_last"], "left")
    each = spans.select("question_id", "n", "at", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("k"))
    per = each.groupBy("question_id", "k").agg((F.sum(F.when(F.col("at") <= F.col("k"), F.col("n")).otherwise(0)) / F.sum("n")).alias("r"))
    return per.groupBy("k").agg(F.round(F.avg("r"), 6).alias("recall"), F.count("*").alias("num_questions"))

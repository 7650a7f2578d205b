"""Column functions on numbers: overlap of spans, vectors, BM25 weights and rank fusion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B, EPSILON, RRF = 2.0, 0.3, 0.25, 60
BOOST, MIN_RATIO, MIN_TOKENS, MIN_IOU = 1.2, 0.3, 10, 0.05


def iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Intersection over union of half-open spans; 0 where the union is empty."""
    inter = F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))
    union = (e1 - s1) + (e2 - s2) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit(v: Column) -> Column:
    norm = F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12))
    return F.transform(v, lambda x: x.cast("double") / norm)


def idf(df: Column, total: Column) -> Column:
    """Before the floor: negative for terms of more than half of the chunks."""
    return F.log(total - df + 0.5) - F.log(df + 0.5)


def bm25(tf: Column, dl: Column, avgdl: Column, weight: Column) -> Column:
    return weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def fused(*ranks: Column) -> Column:
    total = F.lit(0.0)
    for r in ranks:
        total = total + F.lit(1.0) / (RRF + r)
    return total

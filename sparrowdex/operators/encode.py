"""Embeddings of texts by windows of tokens: mean over tokens, unit length, mean over windows, unit length."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowdex.functions import scoring as S
from sparrowdex.operators.models import Windows
from sparrowdex.storage import ship


def windows(tokens: DataFrame, length: int = 256, stride: int = 32) -> DataFrame:
    """tokens (id, vectors array<array<double>>) -> (id, window, vectors): windows that overlap by stride tokens."""
    step = length - stride
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.size("vectors") - length) / F.lit(step)).cast("int")))
    return tokens.where(F.size("vectors") > 0).select("id", F.posexplode(F.transform(starts, lambda i: F.slice(F.col("vectors"), i * step + 1, length))).alias("window", "vectors"))


def mean(vectors: DataFrame, keys: list[str], vector_col: str) -> DataFrame:
    """The mean of each group's vectors, by sums per dimension with partial sums on the map side."""
    long = vectors.select(*keys, F.posexplode(vector_col).alias("dim", "x"))
    each = long.groupBy(*keys, "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda v: v["m"]).alias(vector_col))


def pooled(tokens: DataFrame, length: int = 256, stride: int = 32) -> DataFrame:
    """(id, embedding) of tokens (id, vectors)."""
    w = windows(tokens, length, stride).select("id", "window", F.explode("vectors").alias("v"))
    per_window = mean(w, ["id", "window"], "v").select("id", S.unit(F.col("v")).alias("v"))
    return mean(per_window, ["id"], "v").select("id", S.unit(F.col("v")).alias("embedding"))


#: Texts that a model sees at once.
BATCH = 64
WORDS = re.compile(r"\w+")


class HashedWords:
    """A stand-in for a model: a token's vector is drawn by its hash, so texts that share words are near; equal everywhere."""

    name, dimension = "hashed-words", 384

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array([self.vector(w) for w in WORDS.findall(t.lower())]).reshape(-1, self.dimension) for t in texts]

    def vector(self, word: str) -> np.ndarray:
        seed = int.from_bytes(hashlib.sha256(word.encode("utf-8", "surrogatepass")).digest()[:8], "little")
        return np.random.default_rng(seed).standard_normal(self.dimension)


def window_mean(vectors: np.ndarray | Windows, length: int, stride: int) -> np.ndarray:
    """One text's embedding of its tokens' vectors, or of those of each window that its model saw; zero for a text without tokens."""
    unit = lambda v: v / max(float(np.sqrt(v @ v)), 1e-12)
    if isinstance(vectors, Windows):
        return unit(np.mean([unit(w.mean(axis=0)) if len(w) else np.zeros(w.shape[1]) for w in vectors], axis=0))
    step, n = length - stride, len(vectors)
    starts = range(0, max(1, -(-(n - length) // step) * step + 1), step)
    return unit(np.mean([unit(vectors[s : s + length].mean(axis=0)) for s in starts], axis=0)) if n else np.zeros(vectors.shape[1])


def embed(texts: DataFrame, model: Callable[[], Callable[[list[str]], list[np.ndarray]]] = HashedWords, id_col: str = "id", text_col: str = "text", length: int = 256, stride: int = 32) -> DataFrame:
    """(id, embedding array<float>) of texts. model makes an encoder, once per task: texts -> for each a vector per token. Null text counts as empty."""
    ship(texts.sparkSession)
    kind = dict(texts.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = model()
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                b = whole.slice(at, BATCH)
                out = [window_mean(v, length, stride).astype(np.float32) for v in encoder([t or "" for t in b.column(1).to_pylist()])]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.float32()))], names=[id_col, "embedding"])

    return texts.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, embedding array<float>")

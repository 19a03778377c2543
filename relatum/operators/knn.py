"""Nearest neighbours by cosine: exact, in blocks of both sides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relatum.functions.axes import mean_vector, raw_cosine

#: Vectors of the searched side in one block; blocks go to executors one by one, never the whole side.
BLOCK = 20_000
#: Base side up to which one broadcast block does.
BROADCAST_ROWS = 20_000


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n < 1e-12, 1, n)


def _matrix(vectors: pd.Series) -> np.ndarray:
    return _unit(np.stack([np.asarray(v, np.float64) for v in vectors])) if len(vectors) else np.zeros((0, 0))


def _nearest(ids: np.ndarray, q: np.ndarray, base_ids: np.ndarray, base: np.ndarray, k: int, least: float, skip_self: bool) -> pd.DataFrame:
    """The k best of one block (in order of its ids) for each query, ties by id."""
    out_a, out_b, out_s = [], [], []
    for lo in range(0, len(q), 1024):
        sim = q[lo : lo + 1024] @ base.T
        if skip_self:
            sim[ids[lo : lo + 1024, None] == base_ids[None, :]] = -1
        m = min(k, sim.shape[1])
        # All that tie with the k-th, so that the choice among ties does not depend on blocks.
        floor = np.maximum(np.partition(sim, -m, axis=1)[:, -m] - 1e-9, least)
        r, c = np.nonzero((sim > least) & (sim >= floor[:, None]))
        s = sim[r, c]
        order = np.lexsort((c, -np.round(s, 9), r))
        r, c, s = r[order], c[order], s[order]
        best = np.arange(len(r)) - np.searchsorted(r, r) < k
        out_a.append(ids[lo + r[best]])
        out_b.append(base_ids[c[best]])
        out_s.append(s[best])
    return pd.DataFrame({"path_a": np.concatenate(out_a), "path_b": np.concatenate(out_b), "similarity": np.concatenate(out_s)})


def nearest(queries: DataFrame, base: DataFrame, k: int, least: float, skip_self: bool = True) -> DataFrame:
    """path_a, path_b, similarity: for each query (path, vector) the k nearest of base (path, vector) above `least`.

    A base of up to BROADCAST_ROWS rows is broadcast after its size is checked. A larger one is dealt into blocks by
    hash; each block meets the queries in stretches, and the k best of each block are merged by one ranking.
    """
    spark = queries.sparkSession
    schema = "path_a string, path_b string, similarity double"
    sample = base.select("path", "vector").limit(BROADCAST_ROWS + 1)
    n = sample.count()
    if n == 0:
        return spark.createDataFrame([], schema)
    if n <= BROADCAST_ROWS:
        rows = sample.orderBy("path").toPandas()
        shared = spark.sparkContext.broadcast((rows["path"].to_numpy(object), _matrix(rows["vector"])))

        def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, matrix = shared.value
            for p in parts:
                if len(p):
                    yield _nearest(p["path"].to_numpy(object), _matrix(p["vector"]), ids, matrix, k, least, skip_self)

        found = queries.select("path", "vector").mapInPandas(scan, schema)
    else:
        total = base.count()
        blocks = -(-total // BLOCK)
        stretches = max(1, -(-queries.count() // BLOCK))
        b = base.select(F.col("path").alias("base_path"), F.col("vector").alias("base_vector"), F.pmod(F.xxhash64("path"), F.lit(blocks)).cast("int").alias("block"))
        q = queries.select("path", "vector", F.pmod(F.xxhash64(F.lit(1), "path"), F.lit(stretches)).cast("int").alias("stretch"))
        every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
        every_stretch = F.explode(F.sequence(F.lit(0), F.lit(stretches - 1)))
        left = q.withColumn("block", every_block).groupBy("block", "stretch")
        right = b.withColumn("stretch", every_stretch).groupBy("block", "stretch")

        def meet(qs: pd.DataFrame, bs: pd.DataFrame) -> pd.DataFrame:
            if not len(qs) or not len(bs):
                return pd.DataFrame({"path_a": [], "path_b": [], "similarity": []}).astype({"path_a": object, "path_b": object, "similarity": float})
            bs = bs.sort_values("base_path")
            return _nearest(qs["path"].to_numpy(object), _matrix(qs["vector"]), bs["base_path"].to_numpy(object), _matrix(bs["base_vector"]), k, least, skip_self)

        found = left.cogroup(right).applyInPandas(meet, schema)
    w = Window.partitionBy("path_a").orderBy(F.desc(F.round("similarity", 9)), "path_b")
    return found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")


def neighbor_graph(embeddings: DataFrame, models: tuple[str, ...] = ("clip:ViT-B-32", "clap:HTSAT-tiny"), k: int = 20, least: float = 0.1) -> DataFrame:
    """path_a, path_b, model, similarity: each model's graph."""
    parts = []
    for model in models:
        rows = embeddings.where(F.col("model") == model)
        parts.append(nearest(rows, rows, k, least).withColumn("model", F.lit(model)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("path_a", "path_b", "model", "similarity")


def cross_modal(text_segments: DataFrame, images: DataFrame, k: int = 20, least: float = 0.15) -> DataFrame:
    """Edges both ways between text files (path, vector of each chunk) and images (path, vector)."""
    texts = text_segments.groupBy("path").agg(F.collect_list("vector").alias("vs")).select("path", mean_vector(F.col("vs")).alias("vector"))
    one = nearest(texts, images, k, least, skip_self=False).withColumn("model", F.lit("cross:text→image"))
    back = one.select(F.col("path_b").alias("path_a"), F.col("path_a").alias("path_b"), "similarity", "model")
    return one.unionByName(back).select("path_a", "path_b", "model", "similarity")


def stem_scores(audio: DataFrame, prompts: DataFrame) -> DataFrame:
    """path, stem, score: prompts (stem, vector) are a few rows that go to every task."""
    p = F.broadcast(prompts.select(F.col("stem"), F.col("vector").alias("pv")))
    pairs = audio.select("path", "vector").crossJoin(p)
    s = (raw_cosine(F.col("vector"), F.col("pv")) - 0.15) / 0.30
    return pairs.select("path", "stem", F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0)).alias("score"))

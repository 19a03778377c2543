"""Segments of texts, images, videos and stems, and ranking of segments against a concept vector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relatum.functions.axes import raw_cosine
from relatum.functions.text import chunks, quotable, segment_id, word_count


def text_to_segment(files: DataFrame, properties: DataFrame, segments: DataFrame, least_words: int = 50) -> DataFrame:
    """Files with more than least_words words and no chunk segment yet."""
    long = properties.where("domain = 'text' and key = 'word_count'").where(F.col("value_num") > least_words).select("path")
    return files.join(long, "path", "left_semi").join(segments.where("segment_type = 'chunk'").select("path"), "path", "left_anti")


def chunk_segments(texts: DataFrame, size: int = 200, stride: int = 170, most: int = 20, least: int = 20) -> DataFrame:
    """Segment rows of texts (path, text); a text below `least` words gives one marker row `empty`."""
    rows = texts.withColumn("n", word_count(F.col("text")))
    full = rows.where(F.col("n") >= least).select("path", "n", F.explode(chunks(F.col("text"), size, stride, most)).alias("c"))
    key = F.concat(F.lit("chunk_"), F.col("c.i").cast("string"))
    label = F.substring(F.regexp_replace("c.text", "\n", " "), 1, 100)
    out = full.select(segment_id(F.col("path"), F.lit("chunk"), key).alias("id"), "path", F.lit("chunk").alias("segment_type"), key.alias("segment_key"), label.alias("label"), (F.col("c.n") / F.col("n")).alias("area_frac"), F.col("c.text").alias("text"))
    none = F.lit("empty")
    marker = rows.where(F.coalesce("n", F.lit(0)) < least).select(segment_id(F.col("path"), F.lit("chunk"), none).alias("id"), "path", F.lit("chunk").alias("segment_type"), none.alias("segment_key"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("double").alias("area_frac"), F.lit(None).cast("string").alias("text"))
    return out.unionByName(marker)


def scene_intervals(cuts: DataFrame, shortest: float = 0.5, most: int = 50) -> DataFrame:
    """path, i, time_start, time_end, midpoint, confidence from cut times (path, t): stretches between neighbours."""
    w = Window.partitionBy("path").orderBy("t")
    rows = cuts.select("path", F.col("t").alias("time_start"), F.lead("t").over(w).alias("time_end")).where(F.col("time_end") - F.col("time_start") >= shortest)
    rows = rows.withColumn("i", (F.row_number().over(Window.partitionBy("path").orderBy("time_start")) - 1).cast("bigint")).where(F.col("i") < most)
    n = F.count("*").over(Window.partitionBy("path"))
    return rows.select("path", "i", "time_start", "time_end", ((F.col("time_start") + F.col("time_end")) / 2).alias("midpoint"), (1.0 / n).alias("confidence"))


def size_shares(stems: DataFrame) -> DataFrame:
    """path, segment_key, area_frac: each stem file's share of the sizes of its track (path, segment_key, size)."""
    total = F.sum("size").over(Window.partitionBy("path"))
    return stems.select("path", "segment_key", F.try_divide(F.col("size"), total).cast("double").alias("area_frac"))


def region_masks(masks: DataFrame, least: float = 0.01, largest: float = 0.95, most: int = 10) -> DataFrame:
    """Masks (path, x, y, w, h, area, iou, width, height) worth keeping: by area share, the best by predicted overlap, with a normalised box."""
    frac = F.col("area") / (F.col("width") * F.col("height"))
    rows = masks.withColumn("area_frac", frac).where(F.col("area_frac").between(least, largest))
    w = Window.partitionBy("path").orderBy(F.desc("iou"), F.desc("area_frac"), "x", "y")
    rows = rows.withColumn("i", (F.row_number().over(w) - 1).cast("bigint")).where(F.col("i") < most)
    return rows.select("path", "i", (F.col("x") / F.col("width")).alias("bbox_x"), (F.col("y") / F.col("height")).alias("bbox_y"), (F.col("w") / F.col("width")).alias("bbox_w"), (F.col("h") / F.col("height")).alias("bbox_h"), "area_frac", F.col("iou").alias("confidence"))


def stale(items: DataFrame, vectors: DataFrame, key: str, model: str) -> DataFrame:
    """Items without a vector in this model: what a new or better model still has to embed."""
    return items.join(vectors.where(F.col("model") == model).select(key), key, "left_anti")


def rank_segments(segments: DataFrame, vector: Column, graph: DataFrame, most: int, least_area: float = 0.03) -> DataFrame:
    """Region segments (path, id, vector, bbox_x, area_frac) closest to a concept vector; files that the graph scores gain."""
    rows = segments.where((F.col("segment_type") == "region") & F.col("bbox_x").isNotNull() & (F.col("area_frac") > least_area))
    s = raw_cosine(F.col("vector"), vector)
    rows = rows.join(graph.select("path", F.col("score").alias("graph")), "path", "left")
    rows = rows.withColumn("score", F.when(F.col("graph").isNotNull(), s * 1.5 + F.col("graph") * 0.2).otherwise(s))
    return rows.select("id", "path", "score").orderBy(F.desc("score"), "id").limit(most)


def rank_texts(chunked: DataFrame, vector: Column, most: int = 12, sample: int | None = 8000, seed: int = 7) -> DataFrame:
    """Quotable chunks (id, path, label, vector) closest to a concept vector, among `sample` at random (None: all)."""
    rows = chunked.orderBy(F.rand(seed)).limit(sample) if sample else chunked
    rows = rows.where(quotable(F.col("label")))
    return rows.select("id", "path", "label", raw_cosine(F.col("vector"), vector).alias("score")).orderBy(F.desc("score"), "id").limit(most)


def dominant_colors(pixels: DataFrame) -> DataFrame:
    """path, red, green, blue, palette_complexity from pixels (path, r, g, b): whole mean of the fullest 4-bit bucket, count of 3-bit ones."""
    from relatum.functions.media import quantised

    four = [quantised(F.col(c), 4).alias(f"q{c}") for c in "rgb"]
    sums = pixels.groupBy("path", *four).agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in "rgb"])
    best = sums.groupBy("path").agg(F.max_by(F.struct("n", "r", "g", "b"), F.struct("n", -F.col("qr"), -F.col("qg"), -F.col("qb"))).alias("m"))
    three = pixels.select("path", *[quantised(F.col(c), 3).alias(c) for c in "rgb"]).distinct().groupBy("path").agg(F.count("*").alias("palette_complexity"))
    mean = [F.floor(F.col(f"m.{c}") / F.col("m.n")).cast("bigint").alias(name) for c, name in (("r", "red"), ("g", "green"), ("b", "blue"))]
    return best.select("path", *mean).join(three, "path")

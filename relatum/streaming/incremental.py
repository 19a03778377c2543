"""Resumable enrichment: batches of new files become properties, each file once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql import functions as F

from relatum.functions.text import language, word_count
from relatum.operators.access import pending


def text_properties(texts: DataFrame) -> DataFrame:
    """Property rows of texts (path, text): word_count (0 marks an empty one), char_count, language where known."""
    rows = texts.select("path", F.coalesce("text", F.lit("")).alias("text"))
    found = F.array(
        F.struct(F.lit("word_count").alias("key"), word_count(F.col("text")).cast("double").alias("value_num"), F.lit(None).cast("string").alias("value_txt")),
        F.struct(F.lit("char_count").alias("key"), F.char_length("text").cast("double").alias("value_num"), F.lit(None).cast("string").alias("value_txt")),
        F.struct(F.lit("language").alias("key"), F.lit(None).cast("double").alias("value_num"), language(F.col("text")).alias("value_txt")),
    )
    out = rows.select("path", F.explode(found).alias("p")).where("p.key <> 'language' or p.value_txt is not null")
    return out.select("path", F.lit("text").alias("domain"), "p.key", "p.value_num", "p.value_txt")


def enrich_pending(files: DataFrame, properties: DataFrame, domain: str, key: str, extensions: list[str], analyse: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """New property rows of the files that lack the domain's marker."""
    return analyse(pending(files, properties, domain, key, extensions))


def enrich_stream(texts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends properties of a stream of texts to a table partitioned by batch; a batch that runs again replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        text_properties(batch.dropDuplicates(["path"])).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return texts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions(events: DataFrame, gap: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """An extension: session windows of each user with counts, on a batch or a stream (ts, user_id, value)."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def metadata_properties(extracted: DataFrame, existing: DataFrame) -> DataFrame:
    """Properties page_count, title and author of texts (extracted: path and these): what was extracted, else what is known."""
    rows = extracted.select("path", "page_count", "title", "author").alias("e").join(existing.select("path", "page_count", "title", "author").alias("k"), "path", "left")
    pick = lambda c: F.coalesce(f"e.{c}", f"k.{c}")
    entries = F.array(*[F.struct(F.lit(c).alias("key"), (pick(c).cast("double") if c == "page_count" else F.lit(None).cast("double")).alias("value_num"), (F.lit(None).cast("string") if c == "page_count" else pick(c)).alias("value_txt")) for c in ("page_count", "title", "author")])
    return rows.select("path", F.explode(entries).alias("x")).where("x.value_num is not null or x.value_txt is not null").select("path", F.lit("text").alias("domain"), "x.key", "x.value_num", "x.value_txt")

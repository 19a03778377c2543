"""Folder profiles and their classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relatum.functions.media import KINDS

#: Words in a folder's name that hint at its use.
SIGNALS = {
    "work": ("work", "project", "job", "client", "freelance"),
    "personal": ("personal", "photo", "camera", "vacation", "trip"),
    "system": ("library", "cache", "derivatives", "resources", ".app", "journal"),
    "sample": ("sample", "loop", "preset", "patch", "drum", "synth"),
    "reference": ("reference", "ref", "inspiration", "moodboard"),
    "download": ("download", "inbox", "desktop"),
    "archive": ("archive", "backup", "old", "legacy"),
    "export": ("export", "render", "output", "bounced", "bounce", "final"),
}
BURST_SECONDS = 3600


def _burst(times: Column) -> Column:
    """Whether four fifths of sorted times (seconds) lie within an hour; the last possible window is not looked at."""
    n = F.size(times)
    w = F.floor(n * 0.8).cast("int")
    gaps = F.transform(F.sequence(F.lit(0), F.greatest(n - w - 1, F.lit(0))), lambda i: F.get(times, i + w - 1) - F.get(times, i))
    span = F.get(times, n - 1) - F.get(times, F.lit(0))
    return F.when(n < 2, False).when(n < 5, span < BURST_SECONDS).otherwise(F.array_min(gaps) < BURST_SECONDS)


def _prefix_share(names: Column) -> Column:
    """Characters that the first names have in common, over the length of the first; at most 20 of each are looked at.

    A name that is shorter than a position does not speak against it.
    """
    first = F.get(names, F.lit(0))
    places = F.sequence(F.lit(1), F.least(F.greatest(F.char_length(first), F.lit(1)), F.lit(20)))
    agree = F.transform(places, lambda i: F.forall(names, lambda x: (F.char_length(x) < i) | (F.substring(x, i, F.lit(1)) == F.substring(first, i, F.lit(1)))))
    off = F.array_position(agree, F.lit(False)).cast("int")
    shared = F.when(off > 0, off - 1).otherwise(F.least(F.char_length(first), F.lit(20)))
    return shared / F.greatest(F.char_length(first), F.lit(1))


def folder_profiles(files: DataFrame, min_files: int = 3) -> DataFrame:
    """One row for each folder of at least min_files files.

    Only the sorted times and twenty names of a folder are gathered; all else is counted on the map side.
    """
    t = F.unix_timestamp(F.try_to_timestamp(F.substring("modified_date", 1, 19), F.lit("yyyy-MM-dd HH:mm:ss")))
    size = F.when(F.col("size_bytes") > 0, F.col("size_bytes").cast("double"))
    share = lambda known: F.avg(F.col("extension").isin(*known).cast("double"))
    base = files.groupBy("parent_folder").agg(
        F.count("*").alias("file_count"),
        F.sort_array(F.collect_list(t)).alias("times"),
        F.avg(F.col("filename").rlike(r"[0-9]{3,}").cast("double")).alias("sequential_ratio"),
        F.avg(F.col("filename").rlike(r"(?i)[0-9a-f]{8}-[0-9a-f]{4}").cast("double")).alias("uuid_ratio"),
        F.avg(size).alias("mean_size"),
        F.stddev_pop(size).alias("deviation"),
        F.count(size).alias("sized"),
        *[F.coalesce(share(v), F.lit(0.0)).alias(f"mix_{k}") for k, v in KINDS.items()],
    )
    base = base.where(F.col("file_count") >= min_files)
    names = files.select("parent_folder", "filename", F.row_number().over(Window.partitionBy("parent_folder").orderBy("id", "path")).alias("r")).where("r <= 20")
    names = names.groupBy("parent_folder").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "filename"))), lambda s: s["filename"]).alias("names"))
    exts = files.groupBy("parent_folder", F.coalesce("extension", F.lit("")).alias("e")).agg(F.count("*").alias("c"))
    exts = exts.groupBy("parent_folder").agg(F.count("*").alias("ext_diversity"), F.max("c").alias("most"), F.slice(F.sort_array(F.collect_list(F.struct((-F.col("c")).alias("o"), "e"))), 1, 3).alias("top"))
    out = base.join(names, "parent_folder").join(exts, "parent_folder")
    low = F.lower("parent_folder")
    n = F.size("times")
    out = out.select(
        "parent_folder", "file_count", "ext_diversity",
        F.array_join(F.transform("top", lambda s: F.concat(s["e"], F.lit(":"), (-s["o"]).cast("string"))), ", ").alias("top_extensions"),
        (F.col("most") / F.col("file_count")).alias("dominant_ext_ratio"),
        (F.col("most") / F.col("file_count") > 0.9).alias("is_mono_type"),
        F.when(n >= 2, (F.get("times", n - 1) - F.get("times", F.lit(0))) / 86400.0).otherwise(0.0).alias("temporal_span_days"),
        _burst(F.col("times")).alias("is_burst"), "sequential_ratio", "uuid_ratio",
        F.when(F.col("file_count") >= 3, _prefix_share(F.col("names"))).otherwise(0.0).alias("common_prefix_ratio"),
        F.coalesce("mean_size", F.lit(0.0)).alias("avg_size"),
        (1 - F.least(F.when(F.col("sized") > 1, F.col("deviation")).otherwise(0.0) / (F.coalesce("mean_size", F.lit(0.0)) + 1), F.lit(1.0))).alias("size_uniformity"),
        F.size(F.filter(F.split("parent_folder", "/"), lambda x: x != "")).cast("bigint").alias("depth"),
        *[f"mix_{k}" for k in KINDS],
        *[_has(low, words).alias(f"has_{k}_signal") for k, words in SIGNALS.items()],
    )
    seq, prefix = F.col("sequential_ratio"), F.col("common_prefix_ratio")
    naming = F.when(F.col("uuid_ratio") > 0.5, "system-generated").when((seq > 0.7) & (prefix > 0.3), "sequential-batch").when(seq > 0.5, "sequential").when(prefix > 0.5, "common-prefix").otherwise("mixed")
    top = F.greatest(*[F.col(f"mix_{k}") for k in KINDS])
    media = None
    for k in KINDS:
        media = F.when(F.col(f"mix_{k}") == top, k) if media is None else media.when(F.col(f"mix_{k}") == top, k)
    return out.withColumn("naming_pattern", naming).withColumn("dominant_media", media)


def _has(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def classify(profiles: DataFrame) -> DataFrame:
    """profiles with `topology`: the first rule that holds."""
    c = F.col
    named = c("naming_pattern")
    rules: list[tuple[Column, str]] = [
        (c("has_system_signal") | (c("uuid_ratio") > 0.7), "system-artifact"),
        (c("is_burst") & c("is_mono_type") & (c("file_count") > 10), "batch-export"),
        (c("has_sample_signal") & (c("mix_audio") > 0.8), "sample-library"),
        (c("is_mono_type") & (c("mix_audio") > 0.9) & (c("sequential_ratio") > 0.5) & (c("file_count") > 20), "sample-library"),
        ((c("mix_image") > 0.8) & (c("sequential_ratio") > 0.5) & named.isin("sequential", "sequential-batch"), "camera-dump"),
        (c("has_reference_signal"), "reference-collection"),
        ((c("mix_image") > 0.7) & (named == "mixed") & (c("sequential_ratio") <= 0.5), "curated-images"),
        (c("mix_working") > 0.05, "production-session"),
        (c("has_work_signal") & (c("ext_diversity") >= 3), "work-project"),
        (c("has_export_signal"), "export-output"),
        (c("has_archive_signal"), "archive"),
        (c("has_download_signal"), "download-accumulation"),
        ((c("mix_document") > 0.5) & (c("file_count") > 3), "document-collection"),
        ((c("mix_audio") > 0.7) & (named == "mixed"), "music-collection"),
        ((c("mix_audio") > 0.7) & (c("sequential_ratio") > 0.3), "album-rip"),
        (c("has_personal_signal") & (c("mix_image") > 0.5), "personal-photos"),
        ((c("mix_video") > 0.3) & (c("ext_diversity") >= 2), "video-project"),
        (c("mix_code") > 0.3, "code-project"),
        (c("mix_design") > 0.1, "design-project"),
        (c("ext_diversity") >= 4, "mixed-project"),
        (c("is_mono_type"), "single-type-collection"),
    ]
    out = None
    for rule, label in rules:
        out = F.when(rule, label) if out is None else out.when(rule, label)
    return profiles.withColumn("topology", out.otherwise("uncategorized"))


def distribution(classified: DataFrame, examples: int = 3) -> DataFrame:
    """topology, folders, percent, examples: the largest folders of each."""
    w = Window.partitionBy("topology").orderBy(F.desc("file_count"), "parent_folder")
    top = classified.withColumn("r", F.row_number().over(w)).where(F.col("r") <= examples)
    shown = top.groupBy("topology").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "parent_folder"))), lambda s: s["parent_folder"]), ", ").alias("examples"))
    counts = classified.groupBy("topology").agg(F.count("*").alias("folders"))
    total = classified.agg(F.count("*").alias("total"))
    return counts.crossJoin(total).join(shown, "topology").select("topology", "folders", F.round(100.0 * F.col("folders") / F.col("total"), 4).alias("percent"), "examples")


def topology_properties(classified: DataFrame, files: DataFrame) -> DataFrame:
    """Property rows on the first file of each folder: its type, and its profile as JSON."""
    first = files.groupBy("parent_folder").agg(F.min_by("path", F.struct("id", "path")).alias("path"))
    rows = classified.join(first, "parent_folder")
    profile = F.to_json(F.struct(F.col("parent_folder").alias("folder"), "file_count", "topology", "ext_diversity", "temporal_span_days", "naming_pattern", "depth"))
    pairs = F.array(F.struct(F.lit("type").alias("key"), F.col("topology").alias("value_txt")), F.struct(F.lit("profile").alias("key"), profile.alias("value_txt")))
    out = rows.select("path", F.explode(pairs).alias("p"))
    return out.select("path", F.lit("topology").alias("domain"), "p.key", F.lit(None).cast("double").alias("value_num"), "p.value_txt")

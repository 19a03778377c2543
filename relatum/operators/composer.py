"""Composition plans from ranked matches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relatum.functions.axes import RESPELLED, WHEEL_MAJOR, WHEEL_MINOR
from relatum.functions.axes import key_compatibility as key_fit
from relatum.functions.media import AUDIO, IMAGE

MAX_ITEMS = 30


def _kind(extension: Column) -> Column:
    e = F.lower(extension)
    return F.when(e.isin(*AUDIO), "audio").when(e.isin(*IMAGE), "image").otherwise("other")


def split_media(matches: DataFrame, files: DataFrame, most: int = MAX_ITEMS) -> DataFrame:
    """matches (path, concept_score) with kind and rank: the first `most` of each kind."""
    rows = matches.join(files.select("path", "extension", "parent_folder"), "path").withColumn("kind", _kind(F.col("extension")))
    w = Window.partitionBy("kind").orderBy(F.desc("concept_score"), "path")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def dominant_stems(properties: DataFrame) -> DataFrame:
    """path, dominant_stem: the key of the highest score, the last of equals."""
    return properties.where("domain = 'stems'").groupBy("path").agg(F.max_by("key", F.struct(F.coalesce("value_num", F.lit(0.0)), "key")).alias("dominant_stem"))


def audio_context(items: DataFrame, properties: DataFrame) -> DataFrame:
    """Items with musical_key, bpm (above 0) and dominant_stem."""
    own = properties.join(items.select("path"), "path", "left_semi")
    is_ = lambda d, k: (F.col("domain") == d) & (F.col("key") == k)
    wide = own.groupBy("path").agg(F.max(F.when(is_("audio", "musical_key"), F.col("value_txt"))).alias("musical_key"), F.max(F.when(is_("audio", "bpm") & (F.col("value_num") > 0), F.col("value_num"))).alias("bpm"))
    return items.join(wide, "path", "left").join(dominant_stems(own), "path", "left")


def _fit(a: str, b: str) -> float:
    """Key compatibility of two names, as the Column expression gives it."""
    def place(k: str) -> tuple[int | None, bool, str]:
        s = k.strip()
        for word, short in ((" minor", "m"), (" major", ""), (" min", "m"), (" maj", "")):
            s = s.replace(word, short)
        s = RESPELLED.get(s.strip(), s.strip())
        return {**WHEEL_MINOR, **WHEEL_MAJOR}.get(s), s in WHEEL_MINOR, s

    (na, ma, sa), (nb, mb, sb) = place(a), place(b)
    if sa == sb:
        return 1.0
    if na is None or nb is None:
        return 0.1
    d = abs(na - nb)
    d = min(d, 12 - d)
    table = {(0, False): 0.95, (1, True): 0.85, (3, False): 0.8, (1, False): 0.7, (5, True): 0.6, (2, True): 0.5, (2, False): 0.5, (3, True): 0.4, (4, True): 0.3, (4, False): 0.3, (5, False): 0.2, (6, True): 0.1, (6, False): 0.1}
    return table.get((d, ma == mb), 0.15)


def chain(scores: list[float], keys: list[str | None]) -> list[int]:
    """Greedy order by key: from the best score (the last of equals) always to the best fit (the first of equals)."""
    left = list(range(len(scores)))
    if not left:
        return []
    at = max(left, key=lambda i: (scores[i], i))
    out = [at]
    left.remove(at)
    while left:
        here = keys[at]
        at = max(left, key=lambda j: (0.5 + 0.1 * scores[j] if here is None or keys[j] is None else _fit(here, keys[j]), -j))
        out.append(at)
        left.remove(at)
    return out


def contrast(order: list[int], stems: list[str | None]) -> list[int]:
    """Swaps an item whose stem repeats the one before with the next that differs; from three items on."""
    out = list(order)
    for i in range(1, len(out) if len(out) >= 3 else 0):
        before = stems[out[i - 1]]
        if before is not None and stems[out[i]] == before:
            j = next((j for j in range(i + 1, len(out)) if stems[out[j]] != before), None)
            if j is not None:
                out[i], out[j] = out[j], out[i]
    return out


def order_audio(items: DataFrame, key_chain: bool = True, stem_contrast: bool = True) -> DataFrame:
    """Audio items (path, concept_score, musical_key, bpm, dominant_stem, rank) with position; one group of MAX_ITEMS rows."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank").reset_index(drop=True)
        none = lambda col: [None if pd.isna(x) else x for x in group[col]]
        order = chain(group["concept_score"].tolist(), none("musical_key")) if key_chain else list(range(len(group)))
        order = contrast(order, none("dominant_stem")) if stem_contrast else order
        out = group.loc[order, ["path", "concept_score", "musical_key", "bpm", "dominant_stem"]].reset_index(drop=True)
        return out.assign(position=range(len(out)))

    schema = "path string, concept_score double, musical_key string, bpm double, dominant_stem string, position bigint"
    rows = items.where((F.col("kind") == "audio") & (F.col("rank") <= MAX_ITEMS))
    return rows.groupBy("kind").applyInPandas(run, schema)


def audio_roles(ordered: DataFrame) -> DataFrame:
    """Ordered audio items with role and notes."""
    before = F.lag("musical_key").over(Window.partitionBy(F.lit(0)).orderBy("position"))
    rows = ordered.withColumn("before", before)
    bridge = F.col("before").isNotNull() & F.col("musical_key").isNotNull() & (key_fit(F.col("before"), F.col("musical_key")) >= 0.85)
    lead = (F.col("position") == 0) | ((F.col("position") < 3) & (F.col("concept_score") > 0.5))
    role = F.when(lead, "anchor").when(bridge, "bridge").otherwise("companion")
    notes = F.array_compact(F.array(F.concat(F.lit("key: "), "musical_key"), F.concat(F.lit("bpm: "), F.format_string("%.0f", "bpm")), F.concat(F.lit("dominant: "), "dominant_stem"), F.when(role == "bridge", F.concat(F.lit("bridge from "), "before"))))
    notes = F.when(F.col("bpm").isNull(), F.filter(notes, lambda n: ~n.startswith("bpm: "))).otherwise(notes)
    return rows.select("path", "concept_score", "position", role.alias("role"), notes.alias("notes"))


def order_images(items: DataFrame, properties: DataFrame) -> DataFrame:
    """Image items in order: folders by their best score, within them by hue (0 where unknown, the least of several)."""
    hue = properties.where("domain = 'image' and key = 'dominant_hue'").groupBy("path").agg(F.min("value_num").alias("hue"))
    rows = items.where("kind = 'image'").join(hue, "path", "left").withColumn("hue", F.coalesce("hue", F.lit(0.0)))
    rows = rows.withColumn("best", F.max("concept_score").over(Window.partitionBy("parent_folder")))
    order = Window.partitionBy("kind").orderBy(F.desc("best"), "parent_folder", "hue", "rank")
    rows = rows.withColumn("position", (F.row_number().over(order) - 1).cast("bigint"))
    role = F.when((F.col("position") < 3) & (F.col("concept_score") > 0.5), "anchor").otherwise("companion")
    return rows.select("path", "concept_score", "position", role.alias("role"), F.array().cast("array<string>").alias("notes"))


def order_others(items: DataFrame) -> DataFrame:
    rows = items.where("kind = 'other'")
    return rows.select("path", "concept_score", (F.col("rank") - 1).cast("bigint").alias("position"), F.lit("companion").alias("role"), F.array().cast("array<string>").alias("notes"))


def compose(matches: DataFrame, files: DataFrame, properties: DataFrame, most: int = MAX_ITEMS) -> DataFrame:
    """kind, position, path, concept_score, role, notes: the plan."""
    items = split_media(matches, files, most)
    audio = audio_roles(order_audio(audio_context(items.where("kind = 'audio'"), properties)))
    parts = [audio.withColumn("kind", F.lit("audio")), order_images(items, properties).withColumn("kind", F.lit("image")), order_others(items).withColumn("kind", F.lit("other"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("kind", "position", "path", "concept_score", "role", "notes")


def summary(plan: DataFrame, concept: str) -> DataFrame:
    """One row: how much of each kind the plan has."""
    n = plan.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("audio", "image", "other")])
    return n.select(F.format_string(f'Concept "{concept}": %d audio (key-chained), %d images (provenance-clustered), %d other', "audio", "image", "other").alias("summary"))


def manifest(plan: DataFrame, concept: str) -> DataFrame:
    """One JSON document: the plan's items in order."""
    items = F.sort_array(F.collect_list(F.struct("kind", "position", "path", "concept_score", "role", "notes")))
    return plan.agg(F.to_json(F.struct(F.lit(concept).alias("concept"), items.alias("items"))).alias("manifest"))


def result_graph(plan: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of the plan and the catalog's edges between them."""
    nodes = plan.select("path", "kind", "role", "concept_score")
    ids = nodes.select("path")
    inside = edges.join(ids.withColumnRenamed("path", "src"), "src", "left_semi").join(ids.withColumnRenamed("path", "dst"), "dst", "left_semi")
    return nodes, inside.select("src", "dst", "category").distinct()


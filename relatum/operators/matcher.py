"""Seed matching: candidates, axis scores, weighted top-k with explanations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relatum.functions import axes
from relatum.operators.access import segments_with_vectors, wide_properties
from relatum.sources.catalog import Catalog


class UnknownAxis(ValueError):
    """A name that no axis is registered under."""


class SeedNotFound(LookupError):
    """A seed path that the catalog has no file for."""


@dataclass(frozen=True)
class Axis:
    """A score of two context structs. Vector and segment axes name what they need loaded."""

    name: str
    score: Callable[[Column, Column], Column]
    value: Callable[[Column], Column]
    embedding: str | None = None
    segments: tuple[str, str] | None = None
    #: Context fields that the score reads; None: any.
    fields: tuple[str, ...] | None = None


#: Numeric and text properties that axes read.
NUMBERS = ["audio.bpm", "audio.spectral_centroid", "audio.duration", "image.brightness", "image.color_temperature", "image.palette_complexity", "image.dominant_hue", "image.aspect_ratio", "video.aspect_ratio", "video.duration"]
TEXTS = ["audio.musical_key"]
VISUAL, SONIC = "clip:ViT-B-32", "clap:HTSAT-tiny"


def _on(name: str, score: Callable[[Column, Column], Column], *fields: str) -> Axis:
    def value(x: Column) -> Column:
        return F.coalesce(*[x[f] for f in fields])

    return Axis(name, lambda s, c: score(value(s), value(c)), lambda x: value(x).cast("string"), fields=fields)


def _vector(name: str, model: str) -> Axis:
    field = f"v_{name}"
    return Axis(name, lambda s, c: axes.cosine(s[field], c[field]), lambda x: F.size(x[field]).cast("string"), embedding=model, fields=())


def _segment(name: str, kind: str, model: str) -> Axis:
    field = f"s_{name}"
    return Axis(name, lambda s, c: axes.best_match(s[field], c[field], several=True), lambda x: F.size(x[field]).cast("string"), segments=(kind, model), fields=())


class AxisRegistry:
    """Axes by name; more can be registered."""

    def __init__(self) -> None:
        self._axes: dict[str, Axis] = {}

    def register(self, axis: Axis) -> None:
        self._axes[axis.name] = axis

    def get(self, name: str) -> Axis:
        if name not in self._axes:
            raise UnknownAxis(name)
        return self._axes[name]

    def names(self) -> list[str]:
        return list(self._axes)

    def known(self, weights: dict[str, float]) -> dict[str, float]:
        """The weights of registered axes; other names are passed over, as callers from outside may send any."""
        return {n: w for n, w in weights.items() if n in self._axes}


#: Weights that a caller starts from.
DEFAULT_WEIGHTS = {"bpm": 0.8, "key": 0.9, "spectral": 0.3, "visual": 0.9, "sonic": 0.9, "objects": 0.8, "vocals": 0.7, "scenes": 0.6, "concepts": 0.7, "brightness": 0.5, "hue": 0.4, "color_temp": 0.3, "palette": 0.2, "aspect": 0.3, "duration": 0.3, "temporal": 0.3, "provenance": 0.2}

REGISTRY = AxisRegistry()
for _a in (
    _on("bpm", axes.bpm, "audio_bpm"),
    _on("key", axes.key_compatibility, "audio_musical_key"),
    _on("spectral", axes.spectral, "audio_spectral_centroid"),
    _on("temporal", axes.temporal, "modified_date"),
    _on("provenance", axes.provenance, "parent_folder"),
    _on("brightness", axes.brightness, "image_brightness"),
    _on("color_temp", axes.color_temp, "image_color_temperature"),
    _on("palette", axes.palette, "image_palette_complexity"),
    _on("hue", axes.hue, "image_dominant_hue"),
    _on("aspect", axes.aspect, "image_aspect_ratio", "video_aspect_ratio"),
    _on("duration", axes.duration, "audio_duration", "video_duration"),
    _vector("visual", VISUAL),
    _vector("sonic", SONIC),
    _segment("objects", "region", VISUAL),
    _segment("vocals", "stem", SONIC),
    _segment("scenes", "scene", VISUAL),
    _segment("concepts", "chunk", VISUAL),
):
    REGISTRY.register(_a)


def contexts(catalog: Catalog, files: DataFrame, chosen: list[Axis]) -> DataFrame:
    """files with what the chosen axes read, and no more: properties are cut to their keys and to the files first."""
    read = None if any(a.fields is None for a in chosen) else {f for a in chosen for f in a.fields}
    numbers, texts = ([n for n in names if read is None or n.replace(".", "_") in read] for names in (NUMBERS, TEXTS))
    out = files.select("path", "modified_date", "parent_folder")
    if numbers or texts:
        domain, key = F.col("domain"), F.col("key")
        named = reduce(lambda x, y: x | y, [(domain == n.split(".")[0]) & (key == n.split(".")[1]) for n in (*numbers, *texts)])
        own = catalog.properties.where(named).join(files.select("path"), "path", "left_semi")
        out = out.join(wide_properties(own, numbers, texts), "path", "left")
    for a in chosen:
        if a.embedding:
            v = catalog.embeddings.where((F.col("model") == a.embedding) & (F.size("vector") > 0)).select("path", F.col("vector").alias(f"v_{a.name}"))
            out = out.join(v, "path", "left")
        if a.segments:
            s = segments_with_vectors(catalog.segments.join(files.select("path"), "path", "left_semi"), catalog.segment_embeddings, *a.segments)
            # One entry a segment, as one may have several vectors or rows.
            s = s.groupBy("path", "id").agg(F.collect_set("vector").alias("vectors"), F.min("area_frac").alias("area_frac"), F.min("label").alias("label"))
            s = s.groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "vectors", "area_frac", "label"))), lambda x: x.dropFields("id")).alias(f"s_{a.name}"))
            out = out.join(s, "path", "left")
    return out


def candidate_paths(catalog: Catalog, seed: str, chosen: list[Axis]) -> DataFrame:
    """path of every file that some chosen axis lets in, without the seed.

    Tempo and brightness let in files near the seed's value, vector and segment axes all files with such vectors if the
    seed has them. If none is let in, all files that share a property domain with the seed are.
    """
    props = catalog.properties
    mine = props.where(F.col("path") == seed)
    values = {(r.domain, r.key): r.value_num for r in mine.where("(domain = 'audio' and key = 'bpm') or (domain = 'image' and key = 'brightness')").collect()}
    names = {a.name for a in chosen}
    parts = []

    def near(domain: str, key: str, lo: float, hi: float) -> DataFrame:
        return props.where((F.col("domain") == domain) & (F.col("key") == key) & F.col("value_num").between(lo, hi)).select("path")

    tempo, light = values.get(("audio", "bpm")), values.get(("image", "brightness"))
    if "bpm" in names and tempo is not None and tempo > 0:
        parts.append(near("audio", "bpm", tempo - 40, tempo + 40))
    if "brightness" in names and light is not None and light >= 0:
        parts.append(near("image", "brightness", max(0.0, light - 0.5), min(1.0, light + 0.5)))
    for a in chosen:
        if a.embedding:
            e = catalog.embeddings.where(F.col("model") == a.embedding)
            if not e.where(F.col("path") == seed).limit(1).isEmpty():
                parts.append(e.select("path"))
        if a.segments:
            s = segments_with_vectors(catalog.segments, catalog.segment_embeddings, *a.segments)
            if not s.where(F.col("path") == seed).limit(1).isEmpty():
                parts.append(s.select("path"))
    known = catalog.files.select("path").where(F.col("path") != seed)
    if parts:
        found = reduce(DataFrame.unionByName, parts).distinct().join(known, "path", "left_semi")
        if not found.limit(1).isEmpty():
            return found
    return props.join(mine.select("domain").distinct(), "domain", "left_semi").select("path").distinct().join(known, "path", "left_semi")


def explained(axis: Axis, seed: Column, cand: Column) -> Column:
    """What an axis compared."""
    unset = F.lit("n/a")
    return F.concat(F.coalesce(axis.value(seed), unset), F.lit(" / "), F.coalesce(axis.value(cand), unset))


def find_matches(catalog: Catalog, seed: str, weights: dict[str, float], limit: int = 20) -> DataFrame:
    """path, score, one score_<axis> column each, explanation (array of name, score, weight, detail): the best matches of a file.

    The seed is one row and travels as a broadcast join; scores are one projection; ordering is a top-k. Scores that are equal
    to nine decimals are ties, by path: their last bits come from the order of a sum.
    """
    chosen = [REGISTRY.get(n) for n in weights]
    total = sum(weights.values())
    if not total:
        raise ValueError("the weights add up to 0")
    row = catalog.files.where(F.col("path") == seed)
    if row.limit(1).isEmpty():
        raise SeedNotFound(seed)
    # The seed's own rows, by a filter that reaches the files.
    own = catalog
    for name in ("properties", "embeddings", "segments"):
        own = own.with_table(name, getattr(catalog, name).where(F.col("path") == seed))
    mine = contexts(own, row, chosen).limit(1)
    files = catalog.files.join(candidate_paths(catalog, seed, chosen), "path", "left_semi")
    cands = contexts(catalog, files, chosen)
    both = cands.select(F.struct(*cands.columns).alias("c")).crossJoin(F.broadcast(mine.select(F.struct(*mine.columns).alias("s"))))
    scored = both.select(F.col("c.path").alias("path"), "s", "c", *[a.score(F.col("s"), F.col("c")).alias(f"score_{a.name}") for a in chosen])
    score = reduce(lambda x, y: x + y, [F.col(f"score_{a.name}") * float(weights[a.name]) for a in chosen]) / float(total)
    top = scored.withColumn("score", score).orderBy(F.desc(F.round("score", 9)), "path").limit(limit)
    why = F.array(*[F.struct(F.lit(a.name).alias("axis"), F.col(f"score_{a.name}").alias("score"), F.lit(float(weights[a.name])).alias("weight"), explained(a, F.col("s"), F.col("c")).alias("detail")) for a in chosen])
    return top.select("path", "score", *[f"score_{a.name}" for a in chosen], why.alias("explanation"))


def match_manifest(matches: DataFrame, files: DataFrame, seed: str, weights: dict[str, float], generated_at: str) -> DataFrame:
    """One JSON document: the seed and its file, and the ranked matches (of find_matches) with name, score and axes."""
    named = F.broadcast(matches).join(files.select("path", "filename"), "path")
    axes_ = F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"score_{n}").alias("score")) for n in weights])
    row = F.struct((-F.col("score")).alias("order"), "path", "filename", "score", axes_.alias("axes"))
    entries = F.transform(F.sort_array(F.collect_list(row)), lambda x, i: F.struct((i + 1).alias("rank"), x["path"].alias("path"), x["filename"].alias("filename"), x["score"].alias("score"), x["axes"].alias("axes")))
    info = files.where(F.col("path") == seed).select(F.struct("path", "filename", "extension", "size_bytes").alias("seed_info")).limit(1)
    one = named.agg(entries.alias("matches")).join(F.broadcast(info), how="left")
    return one.select(F.to_json(F.struct(F.lit(seed).alias("seed"), "seed_info", "matches", F.lit(generated_at).alias("generated_at"))).alias("manifest"))


def explanation_text(explanation: Column) -> Column:
    """Lines of a tree, one for each axis."""
    last = F.size(explanation) - 1
    line = lambda x, i: F.concat(F.when(i == last, "└─ ").otherwise("├─ "), F.format_string("%s: %.2f (%s)", x["axis"], x["score"], x["detail"]))
    return F.array_join(F.transform(explanation, line), "\n")


def best_segment_pair(seed: Column, cand: Column) -> Column:
    """struct<score, seed_label, cand_label> of the two segments that are most alike, the first of equals."""
    pairs = F.flatten(F.transform(seed, lambda s, i: F.transform(cand, lambda c, j: F.struct(axes.cosine(s["vector"], c["vector"]).alias("score"), (-i).alias("i"), (-j).alias("j"), s["label"].alias("seed_label"), c["label"].alias("cand_label")))))
    return F.array_max(pairs)

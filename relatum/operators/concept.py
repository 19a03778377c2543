"""Concept queries: anchors and spreading activation, in bulk-synchronous steps."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relatum.functions.axes import best_match
from relatum.operators.access import best_segment_model, folder_siblings, group_members, segments_with_vectors, session_siblings, top_neighbors
from relatum.operators.fulltext import search
from relatum.sources.catalog import Catalog, cut

#: Weight of a hit by where it was found, and of any other place.
SOURCE_WEIGHT = {"filename": 1.0, "caption": 0.95, "title": 0.9, "album": 0.9, "artist": 0.8, "folder": 0.7, "genre": 0.6, "author": 0.6, "chunk": 0.5}
OTHER_SOURCE = 0.4
#: What is left of a score along an edge of each kind.
DECAY = {"co-folder": 0.6, "co-session": 0.65, "co-project": 0.5, "co-album": 0.7, "co-artist": 0.5, "neighbor": 0.35}
#: Words that name a stem, in order.
STEM_WORDS = {
    "vocals": ["vocals", "singing", "voice", "vocal", "singer", "rap", "rapper", "choir"],
    "drums": ["drums", "percussion", "drum", "beat", "rhythm", "drummer", "snare", "kick"],
    "bass": ["bass", "bassline", "sub", "low-end", "bassist"],
    "guitar": ["guitar", "guitarist", "riff", "strum", "acoustic guitar", "electric guitar"],
    "synth": ["synth", "synthesizer", "electronic", "pad", "arpeggio"],
    "piano": ["piano", "keyboard", "keys", "pianist", "grand piano"],
    "strings": ["strings", "violin", "cello", "viola", "orchestra", "orchestral"],
    "ambient": ["ambient", "atmospheric", "texture", "drone", "soundscape", "atmosphere"],
}
#: How deliberate a folder of each type is; others count 1.
TOPOLOGY_WEIGHT = {"production-session": 1.4, "curated-images": 1.3, "reference-collection": 1.3, "work-project": 1.2, "design-project": 1.2, "personal-photos": 1.1, "document-collection": 1.1, "video-project": 1.1, "music-collection": 1.0, "album-rip": 1.0, "camera-dump": 0.9, "export-output": 0.8, "sample-library": 0.8, "archive": 0.7, "download-accumulation": 0.6, "batch-export": 0.5, "system-artifact": 0.3}
SESSION_SECONDS = 3600
MAX_HITS, MAX_NEGATIVE_HITS, MAX_STEM_FILES = 500, 200, 200


@dataclass(frozen=True)
class ConceptOptions:
    max_results: int = 50
    max_depth: int = 2
    score_floor: float = 0.1
    fan_out: int = 50
    stem_anchoring: bool = True
    negative_query: str | None = None
    stem_filter: dict[str, float] = field(default_factory=dict)


def stem_of(query: str) -> tuple[str, float] | None:
    """The first stem that a query names: 1.0 as a word, 0.7 as a part of the text."""
    text = query.lower()
    for stem, names in STEM_WORDS.items():
        for name in names:
            if name in text.split():
                return stem, 1.0
            if name in text:
                return stem, 0.7
    return None


def _by(column: str, table: dict[str, float], other: float) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, F.col(column)), F.lit(other))


def text_anchors(fts: DataFrame, query: str, limit: int = MAX_HITS, stem: bool = True) -> DataFrame:
    """Edges (path, category, edge, via, weight) of full-text hits. A better rank lowers the weight, as it always did."""
    hits = search(fts, query, limit, stem)
    damp = 0.5 + 0.5 / (1 + F.least(F.abs("rank"), F.lit(10.0)) / 10)
    return hits.select("path", F.lit("anchor").alias("category"), F.concat(F.lit("anchor:"), "source_type").alias("edge"), F.lit(None).cast("string").alias("via"), (_by("source_type", SOURCE_WEIGHT, OTHER_SOURCE) * damp).alias("weight"))


def stem_anchors(properties: DataFrame, query: str) -> DataFrame | None:
    found = stem_of(query)
    if not found:
        return None
    stem, quality = found
    top = properties.where((F.col("domain") == "stems") & (F.col("key") == stem) & (F.col("value_num") >= 0.5)).orderBy(F.desc("value_num"), "path").limit(MAX_STEM_FILES)
    return top.select("path", F.lit("anchor").alias("category"), F.lit(f"anchor:stem:{stem}").alias("edge"), F.lit(None).cast("string").alias("via"), (F.col("value_num") * quality * 0.85).alias("weight"))


def visual_anchors(pairs: DataFrame) -> DataFrame:
    """From (path, similarity) that a model outside gave."""
    return pairs.select("path", F.lit("anchor").alias("category"), F.lit("anchor:visual").alias("edge"), F.lit(None).cast("string").alias("via"), (F.col("similarity") * 0.6).alias("weight"))


def static_edges(catalog: Catalog, fan_out: int = 50, senders: DataFrame | None = None) -> DataFrame:
    """src, dst, category, edge, decay: all but neighbour edges; decay over the root of the edges a file has of the kind.

    With `senders` (path), those of these files alone: only their folders, projects, albums and artists are looked at.
    Files count after the cut, and themselves too where their kind lists them.
    """
    files = catalog.files.select("path", "parent_folder", "modified_date")
    meta = catalog.audio_meta.select("path", "album", "artist")
    projects = catalog.file_projects.select("path", "project_id")

    def of_senders(table: DataFrame, group: str) -> DataFrame:
        if senders is None:
            return table
        return table.join(table.join(senders, "path", "left_semi").select(group).distinct(), group, "left_semi")

    folders = of_senders(files, "parent_folder")
    kinds = {
        "co-folder": folder_siblings(folders, 10),
        "co-session": session_siblings(folders, SESSION_SECONDS, 15).select("path", "sibling"),
        "co-project": group_members(files, of_senders(projects, "project_id"), "project_id", fan_out),
        "co-album": group_members(files, of_senders(meta.select("path", "album"), "album"), "album", 5),
        "co-artist": group_members(files, of_senders(meta.select("path", "artist"), "artist"), "artist", 5),
    }
    parts = []
    for kind, pairs in kinds.items():
        pairs = pairs if senders is None else pairs.join(senders, "path", "left_semi")
        n = F.count("*").over(Window.partitionBy("path"))
        rows = pairs.withColumn("decay", F.lit(DECAY[kind]) / F.sqrt(F.greatest(n, F.lit(1)))).where(F.col("path") != F.col("sibling"))
        parts.append(rows.select(F.col("path").alias("src"), F.col("sibling").alias("dst"), F.lit(kind).alias("category"), F.lit(kind).alias("edge"), "decay"))
    return reduce(DataFrame.unionByName, parts)


def neighbor_edges(catalog: Catalog, limit: int = 20, senders: DataFrame | None = None) -> DataFrame:
    """src, dst, category, edge, decay of the nearest neighbours in every model's graph (of `senders` alone if given)."""
    graph = catalog.neighbors
    if senders is not None:
        graph = graph.join(senders.withColumnRenamed("path", "path_a"), "path_a", "left_semi")
    top = top_neighbors(graph, limit).join(catalog.files.select(F.col("path").alias("path_b")), "path_b", "left_semi")
    return top.select(F.col("path_a").alias("src"), F.col("path_b").alias("dst"), F.lit("neighbor").alias("category"), F.concat(F.lit("neighbor:"), "model").alias("edge"), (F.lit(DECAY["neighbor"]) * F.col("similarity")).alias("decay"))


def region_vectors(catalog: Catalog) -> DataFrame | None:
    """path, segs: the region segments of each file in the best model, None if there are none."""
    best = best_segment_model(catalog.segments, catalog.segment_embeddings, "region").collect()
    if not best:
        return None
    s = segments_with_vectors(catalog.segments, catalog.segment_embeddings, "region", best[0]["model"])
    return s.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("id", "vector", "area_frac"))).alias("segs"))


def boosted(edges: DataFrame, regions: DataFrame) -> DataFrame:
    """Visual neighbour edges gain by how alike the regions of both files are; only edges that were emitted are looked at."""
    visual = F.col("edge").startswith("neighbor:clip:") | F.col("edge").startswith("neighbor:siglip:")
    rows = edges.join(regions.toDF("via", "sa"), "via", "left").join(regions.toDF("path", "sb"), "path", "left")
    # Here a segment without an area weighs its share of the segments, unlike in seed matching.
    boost = F.when(visual & (F.col("category") == "neighbor"), best_match(F.col("sa"), F.col("sb"), 1.0 / F.size("sa"))).otherwise(0.0)
    rows = rows.withColumn("boost", F.coalesce(boost, F.lit(0.0)))
    label = F.when(F.col("boost") > 0.1, F.concat("edge", F.format_string("+seg(%.2f)", "boost"))).otherwise(F.col("edge"))
    return rows.select("path", "category", label.alias("edge"), "via", (F.col("weight") * (1 + F.col("boost") * 0.5)).alias("weight"))


STATE = "path string, score double, counts map<string,bigint>"


def accumulate(state: DataFrame | None, edges: DataFrame) -> DataFrame:
    """State (path, score, counts by category) after edges: the n-th of a category adds a share 1/n of its weight to what is left.

    Order within a category is by weight, source and edge; across categories the product does not depend on it.
    """
    if state is None:
        state = edges.sparkSession.createDataFrame([], STATE)
    before = state.select("path", F.explode("counts").alias("category", "had"))
    order = Window.partitionBy("path", "category").orderBy(F.desc("weight"), "via", "edge")
    rows = edges.withColumn("k", F.row_number().over(order)).join(before, ["path", "category"], "left")
    rows = rows.withColumn("left_over", 1 - F.col("weight") / (F.coalesce("had", F.lit(0)) + F.col("k")))
    per = rows.groupBy("path", "category").agg(F.product("left_over").alias("left_over"), F.count("*").alias("n"))
    gained = per.groupBy("path").agg(F.product("left_over").alias("left_over"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "n")))).alias("new"))
    both = state.join(gained, "path", "full")
    none = F.create_map().cast("map<string,bigint>")
    old, new = F.coalesce("counts", none), F.coalesce("new", none)
    total = F.map_zip_with(old, new, lambda k, a, b: F.coalesce(a, F.lit(0).cast("bigint")) + F.coalesce(b, F.lit(0).cast("bigint")))
    score = 1 - (1 - F.coalesce("score", F.lit(0.0))) * F.coalesce("left_over", F.lit(1.0))
    return both.select("path", score.alias("score"), total.alias("counts"))


def propagated(state: DataFrame, edges: DataFrame, floor: float) -> DataFrame:
    """Edges that files at or above the floor send, where what arrives is at or above it too."""
    frontier = state.where(F.col("score") >= floor).select(F.col("path").alias("src"), "score")
    rows = edges.join(frontier, "src").withColumn("weight", F.col("score") * F.col("decay"))
    return rows.where(F.col("weight") >= floor).select(F.col("dst").alias("path"), "category", "edge", F.col("src").alias("via"), "weight")


def topology_weights(catalog: Catalog) -> DataFrame:
    """parent_folder, topo_weight from the type on any file of the folder."""
    types = catalog.properties.where("domain = 'topology' and key = 'type'").select("path", "value_txt")
    return types.join(catalog.files.select("path", "parent_folder"), "path").groupBy("parent_folder").agg(F.min("value_txt").alias("type")).select("parent_folder", _by("type", TOPOLOGY_WEIGHT, 1.0).alias("topo_weight"))


def concept_query(catalog: Catalog, query: str, options: ConceptOptions = ConceptOptions(), visual: DataFrame | None = None) -> DataFrame:
    """path, concept_score, counts: the files closest to a concept.

    A depth is one step of joins: all files at or above the floor send at once, and send again at the next depth. The
    number of steps is a small constant; each ends in a checkpoint.
    """
    parts = [text_anchors(catalog.search_texts, query)]
    stems = stem_anchors(catalog.properties, query) if options.stem_anchoring else None
    parts += [x for x in (stems, visual_anchors(visual) if visual is not None else None) if x is not None]
    known = catalog.files.select("path")
    anchors = reduce(DataFrame.unionByName, parts).join(known, "path", "left_semi")
    state = cut(accumulate(None, anchors))
    regions = region_vectors(catalog)
    for _ in range(options.max_depth):
        # Edges of the files that send at this depth, not of all files.
        senders = state.where(F.col("score") >= options.score_floor).select("path")
        edges = static_edges(catalog, options.fan_out, senders).unionByName(neighbor_edges(catalog, senders=senders))
        sent = propagated(state, edges, options.score_floor)
        if regions is not None:
            sent = boosted(sent, regions)
        state = cut(accumulate(state, sent))
    if options.negative_query:
        hits = search(catalog.search_texts, options.negative_query, MAX_NEGATIVE_HITS).groupBy("path").agg(F.count("*").alias("hits"))
        state = state.join(hits, "path", "left").withColumn("score", F.col("score") * F.pow(F.lit(0.3), F.coalesce("hits", F.lit(0)))).drop("hits")
    rows = state.join(catalog.files.select("path", "parent_folder"), "path").join(topology_weights(catalog), "parent_folder", "left")
    rows = rows.withColumn("concept_score", F.least(F.least("score", F.lit(1.0)) * F.coalesce("topo_weight", F.lit(1.0)), F.lit(1.0)))
    for stem, least in options.stem_filter.items():
        s = catalog.properties.where((F.col("domain") == "stems") & (F.col("key") == stem)).select("path", F.col("value_num").alias("stem"))
        rows = rows.join(s, "path", "left").where(F.coalesce("stem", F.lit(0.0)) >= least).drop("stem")
    return rows.select("path", "concept_score", "counts").orderBy(F.desc("concept_score"), "path").limit(options.max_results)


#: Weight of a hit in the simple search by where it was found, and of any other place.
SIMPLE_WEIGHT = {"filename": 1.0, "title": 0.9, "artist": 0.8, "album": 0.8, "folder": 0.6, "chunk": 0.5, "genre": 0.5}


def simple_search(catalog: Catalog, concepts: str | list[str], limit: int = 100) -> DataFrame:
    """path, score: the best of a file's hits, weighed by source, and of half the score of its folder siblings.

    Each concept is searched as it is and with an s, the first `limit` hits each. The first 50 files send to up to 20
    siblings; they are those of the best score here, ties by path, so that the result does not depend on any order.
    """
    concepts = [concepts] if isinstance(concepts, str) else concepts
    hits = [search(catalog.search_texts, w, limit).select("path", _by("source_type", SIMPLE_WEIGHT, OTHER_SOURCE).alias("score")) for c in concepts for w in (c, f"{c}s")]
    hits = reduce(DataFrame.unionByName, hits).groupBy("path").agg(F.max("score").alias("score"))
    first = cut(hits.orderBy(F.desc("score"), "path").limit(50))
    folders = catalog.files.join(F.broadcast(first.select("path")), "path", "left_semi").select("parent_folder").distinct()
    near = folder_siblings(catalog.files.join(F.broadcast(folders), "parent_folder", "left_semi"), 20).join(F.broadcast(first), "path")
    near = near.select(F.col("sibling").alias("path"), (F.col("score") * 0.5).alias("score"))
    return hits.unionByName(near).groupBy("path").agg(F.max("score").alias("score"))

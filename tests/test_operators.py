import numpy as np
import pytest
from pyspark.sql import functions as F

from relatum.functions import media, text
from relatum.operators import access, composer, concept, fulltext, knn, matcher, topology
from relatum.sources.catalog import Catalog, open_catalog, save_catalog
from relatum.sources.vectors import decode_vector, encode_mask, mask_area
from relatum.streaming import incremental


def files(spark, rows):
    full = [(i, f"{d}/{n}", n, "." + n.rsplit(".", 1)[1], 10, t, d) for i, (d, n, t) in enumerate(rows)]
    return spark.createDataFrame(full, "id bigint, path string, filename string, extension string, size_bytes bigint, modified_date string, parent_folder string")


@pytest.fixture(scope="module")
def graph(spark):
    """Two folders of four files: one close pair in time, a project, an album, neighbours, three hits on one path, a typed folder."""
    f = files(spark, [("/a", "a1.wav", "2024-01-01 10:00:00"), ("/a", "a2.wav", "2024-01-01 10:30:00"), ("/a", "a3.wav", "2024-01-02 10:00:00"), ("/a", "a4.wav", None), ("/b", "b1.jpg", "2024-01-01 10:00:00"), ("/b", "b2.jpg", "2024-02-01 10:00:00"), ("/b", "b3.jpg", "2024-03-01 10:00:00"), ("/b", "b4.jpg", "bad")])
    t = {
        "files": f,
        "search_texts": spark.createDataFrame([("/a/a1.wav", "filename", "1", "rain drum"), ("/a/a1.wav", "title", "2", "rain"), ("/a/a1.wav", "chunk", "3", "the rain falls"), ("/b/b1.jpg", "caption", "4", "sun over sea"), ("/b/b2.jpg", "caption", "5", "moon")], "path string, source_type string, source_key string, content string"),
        "file_projects": spark.createDataFrame([("/a/a1.wav", "p"), ("/b/b1.jpg", "p"), ("/b/b2.jpg", "p")], "path string, project_id string"),
        "audio_meta": spark.createDataFrame([("/a/a1.wav", "X", "L"), ("/a/a3.wav", "Y", "L")], "path string, artist string, album string"),
        "neighbors": spark.createDataFrame([("/a/a1.wav", "/b/b1.jpg", "clip:ViT-B-32", 0.9), ("/a/a1.wav", "/b/b3.jpg", "clip:ViT-B-32", 0.01), ("/a/a1.wav", "/b/b2.jpg", "clap:HTSAT-tiny", 0.8)], "path_a string, path_b string, model string, similarity double"),
        "properties": spark.createDataFrame([("/a/a1.wav", "stems", "vocals", 0.6, None), ("/a/a2.wav", "stems", "drums", 0.9, None), ("/b/b1.jpg", "topology", "type", None, "curated-images"), ("/a/a1.wav", "audio", "bpm", 120.0, None), ("/a/a2.wav", "audio", "bpm", -1.0, "undetected"), ("/a/a3.wav", "audio", "bpm", 125.0, None)], "path string, domain string, key string, value_num double, value_txt string"),
        "segments": spark.createDataFrame([("s1", "/a/a1.wav", "region", 0.5), ("s2", "/b/b1.jpg", "region", None)], "id string, path string, segment_type string, area_frac double"),
        "segment_embeddings": spark.createDataFrame([("s1", "clip:ViT-B-32", [1.0, 0.0]), ("s2", "clip:ViT-B-32", [1.0, 0.0])], "segment_id string, model string, vector array<float>"),
    }
    return Catalog(spark, t)


def fold(edges):
    """Sequential accumulation, as the closed form must give it."""
    score, seen = 0.0, {}
    for category, weight in edges:
        seen[category] = seen.get(category, 0) + 1
        score += weight / seen[category] * (1 - score)
    return score


def test_anchors_are_damped(graph):
    rows = concept.text_anchors(graph.search_texts, "rain").collect()
    assert len(rows) == 3
    state = concept.accumulate(None, concept.text_anchors(graph.search_texts, "rain")).first()
    assert state.score == pytest.approx(fold([("anchor", w) for w in sorted((r.weight for r in rows), reverse=True)]))
    assert state.counts == {"anchor": 3}


def test_activation_of_one_depth(graph):
    found = {r.path: r for r in concept.concept_query(graph, "rain", concept.ConceptOptions(max_depth=1, stem_anchoring=False)).collect()}
    start = concept.accumulate(None, concept.text_anchors(graph.search_texts, "rain")).first().score
    # /a/a2: folder of three others, and one session sibling.
    assert found["/a/a2.wav"].concept_score == pytest.approx(fold([("co-session", start * 0.65), ("co-folder", start * 0.6 / 3**0.5)]))
    # /b/b1: project of three with itself; neighbour with equal regions; folder type 1.3.
    expect = fold([("co-project", start * 0.5 / 3**0.5), ("neighbor", start * 0.35 * 0.9 * 1.5)])
    assert found["/b/b1.jpg"].concept_score == pytest.approx(min(1, expect * 1.3))
    # A neighbour below the floor is not reached by that edge.
    assert "/b/b3.jpg" not in found
    assert found["/a/a1.wav"].concept_score == pytest.approx(start)


def test_second_depth_sends_again(graph):
    one = {r.path: r.concept_score for r in concept.concept_query(graph, "rain", concept.ConceptOptions(max_depth=1)).collect()}
    two = {r.path: r.concept_score for r in concept.concept_query(graph, "rain", concept.ConceptOptions(max_depth=2)).collect()}
    assert all(two[p] >= s - 1e-12 for p, s in one.items()) and two["/a/a1.wav"] > one["/a/a1.wav"]


def test_negative_query_counts_hits(graph):
    plain = {r.path: r.concept_score for r in concept.concept_query(graph, "rain", concept.ConceptOptions(max_depth=0)).collect()}
    less = {r.path: r.concept_score for r in concept.concept_query(graph, "rain", concept.ConceptOptions(max_depth=0, negative_query="rain")).collect()}
    assert less["/a/a1.wav"] == pytest.approx(plain["/a/a1.wav"] * 0.3**3)


def test_stem_words_and_filter(graph):
    assert concept.stem_of("Singing in the rain") == ("vocals", 1.0)
    assert concept.stem_of("photograph") == ("vocals", 0.7)
    assert concept.stem_of("xyz") is None
    found = concept.concept_query(graph, "drums OR rain", concept.ConceptOptions(stem_filter={"vocals": 0.5})).collect()
    assert [r.path for r in found] == ["/a/a1.wav"]


def test_query_syntax():
    assert fulltext.parse('"of the" OR rain').alternatives == ((("of", "the"),), (("rain",),))
    for bad in ("", "OR x", "a NOT b", "pre*"):
        with pytest.raises(fulltext.QuerySyntaxError):
            fulltext.parse(bad)


@pytest.mark.parametrize("word, stem", [("caresses", "caress"), ("ponies", "poni"), ("ties", "ti"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("vietnamization", "vietnam"), ("triplicate", "triplic"), ("hopeful", "hope"), ("revival", "reviv"), ("adoption", "adopt"), ("probate", "probat"), ("controll", "control"), ("roll", "roll"), ("by", "by")])
def test_porter(word, stem):
    assert fulltext.porter(word) == stem


def test_matcher_errors_and_fallback(graph):
    with pytest.raises(matcher.UnknownAxis):
        matcher.find_matches(graph, "/a/a1.wav", {"nope": 1.0})
    with pytest.raises(matcher.SeedNotFound):
        matcher.find_matches(graph, "/none", {"bpm": 1.0})
    with pytest.raises(ValueError):
        matcher.find_matches(graph, "/a/a1.wav", {"bpm": 0.0})
    top = matcher.find_matches(graph, "/a/a1.wav", {"bpm": 2.0, "provenance": 1.0}, 5).collect()
    assert [(r.path, round(r.score, 4)) for r in top] == [("/a/a3.wav", round((2 * 0.75 + 1) / 3, 4))]
    # No axis lets any file in: all that share a domain.
    assert {r.path for r in matcher.candidate_paths(graph, "/a/a2.wav", [matcher.REGISTRY.get("bpm")]).collect()} == {"/a/a1.wav", "/a/a3.wav"}


def test_registry_takes_more_axes(graph):
    matcher.REGISTRY.register(matcher.Axis("same_folder", lambda s, c: F.when(s["parent_folder"] == c["parent_folder"], 1.0).otherwise(0.0), lambda x: x["parent_folder"]))
    assert matcher.find_matches(graph, "/a/a1.wav", {"same_folder": 1.0, "bpm": 1.0}).first().score_same_folder == 1.0


def test_folder_siblings_against_brute_force(spark):
    f = files(spark, [(f"/d{i % 3}", f"n{i:02d}.wav", None) for i in range(20)])
    rows = [(r.path, r.parent_folder) for r in f.collect()]
    for k in (1, 3, 50):
        want = {(p, s) for p, d in rows for s in sorted(x for x, e in rows if e == d and x != p)[:k]}
        assert {(r.path, r.sibling) for r in access.folder_siblings(f, k).collect()} == want


def test_upsert_takes_the_latest(spark):
    now = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    change = spark.createDataFrame([("a", 5, 1), ("a", 7, 2), ("c", 9, 1)], "k string, v int, t int")
    assert sorted(map(tuple, access.upsert(now, change, ["k"], "t").collect())) == [("a", 7), ("b", 2), ("c", 9)]


def test_neighbours_in_blocks_are_those_of_one_block(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(f"p{i:03d}", rng.normal(size=8).astype(float).tolist()) for i in range(150)]
    df = spark.createDataFrame(rows, "path string, vector array<float>")
    one = {(r.path_a, r.path_b, round(r.similarity, 9)) for r in knn.nearest(df, df, 5, 0.1).collect()}
    monkeypatch.setattr(knn, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(knn, "BLOCK", 40)
    assert {(r.path_a, r.path_b, round(r.similarity, 9)) for r in knn.nearest(df, df, 5, 0.1).collect()} == one
    assert knn.nearest(df, df.limit(0), 5, 0.1).count() == 0


def test_topology_rules(spark):
    rows = [("/x/Samples/kick", f"kick {i:04d}.wav", "2024-01-01 10:00:00") for i in range(5)] + [("/home/cache", f"{i}.bin", None) for i in range(3)] + [("/shoot", f"IMG_{i:04d}.jpg", f"2024-01-{i + 1:02d} 10:00:00") for i in range(6)] + [("/few", "a.txt", None)]
    got = {r.parent_folder: r for r in topology.classify(topology.folder_profiles(files(spark, rows))).collect()}
    assert {k: v.topology for k, v in got.items()} == {"/x/Samples/kick": "sample-library", "/home/cache": "system-artifact", "/shoot": "camera-dump"}
    assert got["/shoot"].naming_pattern == "sequential-batch" and not got["/shoot"].is_burst and got["/x/Samples/kick"].is_burst


def test_chain_and_contrast():
    assert composer.chain([], []) == []
    assert composer.chain([0.5, 0.9, 0.9], ["Am", "C", "F#"]) == [2, 0, 1] or composer.chain([0.5, 0.9, 0.9], ["Am", "C", "F#"])[0] == 2
    assert composer.chain([0.9, 0.1, 0.2], ["Am", "Bbm", "C"]) == [0, 2, 1]
    assert composer.contrast([0, 1, 2], ["a", "a", "b"]) == [0, 2, 1]
    assert composer.contrast([0, 1], ["a", "a"]) == [0, 1]
    assert composer.contrast([0, 1, 2], [None, None, "b"]) == [0, 1, 2]


def test_text_functions(spark):
    df = spark.createDataFrame([("the cat and the dog in the house is a good one",), ("short",), (None,), ("",), ("w " * 450,)], "t string")
    rows = df.select(text.language(F.col("t")).alias("l"), text.word_count(F.col("t")).alias("n"), F.size(text.chunks(F.col("t"))).alias("c")).collect()
    assert [r.l for r in rows[:2]] == ["en", None] and rows[4].n == 450 and rows[4].c == 3
    cut = spark.createDataFrame([("aé" * 10,)], "t string").select(text.byte_prefix(F.col("t"), 5).alias("p")).first()
    assert cut.p == "aéa"


def test_media_functions(spark):
    one = spark.range(1)
    assert one.select(media.tempo_factors(F.lit(5.0)).alias("x")).first().x == [2.0, 2.0, 1.25]
    assert one.select(media.tempo_factors(F.lit(0.2)).alias("x")).first().x == pytest.approx([0.5, 0.5, 0.8])
    assert one.select(media.circle_position(F.lit("A minor")).alias("x")).first().x == 1.0
    assert one.select(media.hsl(F.lit(255.0), F.lit(0.0), F.lit(0.0)).alias("x")).first().x == (0.0, 1.0, 0.5)
    assert one.select(media.human_size(F.lit(1536)).alias("x")).first().x == "1.5 KB"


def test_vectors_and_masks(spark):
    blob = np.array([1, 2], "<f4").tobytes()
    df = spark.createDataFrame([(blob, 2), (blob, 3), (blob + b"x", 2)], "b binary, d int")
    assert [r.v for r in df.select(decode_vector(F.col("b"), F.col("d")).alias("v")).collect()] == [[1.0, 2.0], [], [1.0, 2.0]]
    mask = bytes([0] * 3 + [1] * 300)
    rle = spark.createDataFrame([(mask,)], "m binary").select(encode_mask(F.col("m")).alias("r"))
    assert bytes(rle.first().r) == bytes([0, 3, 1, 255, 1, 45])
    assert rle.select(mask_area(F.col("r")).alias("a")).first().a == 300


def test_catalog_round_trip(spark, graph, tmp_path):
    save_catalog(graph, str(tmp_path / "c"))
    again = open_catalog(spark, str(tmp_path / "c"))
    assert again.files.count() == 8 and again.font_meta.count() == 0
    with pytest.raises(AttributeError):
        again.nothing
    with pytest.raises(KeyError):
        again.with_table("nothing", again.files)


def test_stream_enriches_each_file_once(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("a", "one two"), ("b", "")], "path string, text string").coalesce(1).write.parquet(str(src))
    for _ in range(2):
        stream = spark.readStream.schema("path string, text string").parquet(str(src))
        incremental.enrich_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).where("key = 'word_count'").select("path", "value_num").collect()
    assert sorted(map(tuple, got)) == [("a", 2.0), ("b", 0.0)]


def test_results_do_not_depend_on_partitions(spark, graph):
    def run(n):
        c = Catalog(spark, {k: v.repartition(n) for k, v in graph.tables.items()})
        return [(r.path, round(r.concept_score, 12)) for r in concept.concept_query(c, "rain").collect()]

    assert run(1) == run(7)


def test_concept_anchors_by_stem(spark):
    from relatum.operators import concept

    fts = spark.createDataFrame([("/a", "title", "", "licensed"), ("/b", "title", "", "licenses"), ("/c", "title", "", "other"), ("/d", "title", "", "more")], "path string, source_type string, source_key string, content string")
    assert {r.path for r in concept.text_anchors(fts, "license", stem=True).collect()} == {"/a", "/b"}

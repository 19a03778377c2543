"""Searches against a plain version, over the documents and over texts that are odd."""

import math
import random
import re
import unicodedata
from collections import Counter

import pytest

from relatum.operators import access, concept, fulltext
from relatum.plans import queries as q
from relatum.plans.mapping import catalog_over
from relatum.sources.catalog import Catalog


def plain_terms(text, stem=True):
    low = text.lower()
    if stem:
        low = "".join(unicodedata.normalize("NFD", c)[0] if c in fulltext.ACCENTED else c for c in low)
    found = [t for t in re.split(r"[\W_]+", low) if t]
    return [fulltext.porter(t) for t in found] if stem else found


def places(phrase, ts):
    n = len(phrase.terms)
    ok = lambda i: list(phrase.terms[:-1]) == ts[i : i + n - 1] and i + n <= len(ts) and (ts[i + n - 1].startswith(phrase.terms[-1]) if phrase.prefix else ts[i + n - 1] == phrase.terms[-1])
    return [i for i in range(len(ts)) if ok(i)]


def holds(node, ts):
    if isinstance(node, fulltext.Phrase):
        return bool(places(node, ts))
    if isinstance(node, fulltext.Op):
        sides = [holds(x, ts) for x in node.sides]
        return {"and": all(sides), "or": any(sides), "not": sides[0] and not sides[-1]}[node.kind]
    room = sum(len(p.terms) for p in node.phrases) + node.most
    every = [places(p, ts) for p in node.phrases]
    return all(every) and any(all(any(lo <= i and i + len(p.terms) <= lo + room for i in at) for p, at in zip(node.phrases, every)) for x in every for lo in x)


def plain_search(rows, query, stem=True):
    """{key: rank} by the textbook."""
    node = fulltext.parse_query(query, stem)
    phrases = list(dict.fromkeys(fulltext.leaves(node)))
    texts = {k: plain_terms(t or "", stem) for k, t in rows}
    mean = sum(map(len, texts.values())) / max(len(texts), 1)
    tf = {k: [len(places(p, ts)) for p in phrases] for k, ts in texts.items()}
    df = [sum(n[i] > 0 for n in tf.values()) for i in range(len(phrases))]
    out = {}
    for k, ts in texts.items():
        if holds(node, ts):
            idf = [max(math.log((len(texts) - d + 0.5) / (d + 0.5)), 1e-6) for d in df]
            out[k] = -sum(w * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(ts) / mean)) for w, n in zip(idf, tf[k]))
    return out


TEXTS = ["Licenses and the licensed singer", "a LICENSE, singing", "Café crème brûlée", "cafe culture in the cafes", "", None, "rain on the night drive", "night rain", "driving in rain, the night was long and the drive longer", "the the the", "under_score x2 3d", "pre prefix prefixes presume"]
QUERIES = ["license", "sing", "café", "cafes creme", '"night drive"', "rain NOT drive", "night AND (drive OR license)", "pre*", '"the lic"*', "NEAR(night drive, 3)", "NEAR(night drive)", "NEAR(rain long, 6) OR x2", "the", "nothing", "rain night NOT (drive OR sing)"]


@pytest.fixture(scope="module")
def fts(spark):
    rows = [(f"/p{i}", "chunk", str(i), t) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "path string, source_type string, source_key string, content string")


@pytest.mark.parametrize("stem", [True, False])
def test_searches_against_a_plain_version(spark, fts, tmp_path, stem):
    fulltext.build_index(fts, str(tmp_path / "index"), stem, buckets=4)
    rows = [(f"/p{i}", t) for i, t in enumerate(TEXTS)]
    for query in QUERIES:
        want = {k: round(v, 9) for k, v in plain_search(rows, query, stem).items()}
        assert {r.path: round(r.rank, 9) for r in fulltext.search(fts, query, stem=stem).collect()} == want, query
        assert {r.path: round(r.rank, 9) for r in fulltext.indexed_search(spark, str(tmp_path / "index"), query).collect()} == want, query
    assert want


def test_queries_that_mean_nothing():
    for bad in ("", "OR x", "x OR", "a NOT", "(a", "a)", "NEAR(", "NEAR()", "!!"):
        with pytest.raises(fulltext.QuerySyntaxError):
            fulltext.parse_query(bad)


def test_stemmed_search_of_documents(spark, data):
    rows = {(r.path, r.source_key): r.content for r in catalog_over(spark, data).search_texts.collect()}
    want = plain_search(rows.items(), "stinging")
    got = q.QUERIES["porter_search"](spark, data).collect()
    assert len(got) == min(len(want), 50) and want
    assert [round(r["rank"], 5) for r in got] == [round(x, 5) for x in sorted(want.values())[:50]]


def test_simple_search_against_a_plain_version(spark):
    rng = random.Random(4)
    sources = ["filename", "title", "artist", "album", "folder", "chunk", "genre", "caption"]
    files = [(f"/d{i % 5}/f{i:03d}", f"/d{i % 5}") for i in range(120)]
    texts = [(p, rng.choice(sources), str(i), rng.choice(["a ball game", "balls of arms", "arm", "none"])) for i, (p, _) in enumerate(files[:50])]
    c = Catalog(spark, {"files": spark.createDataFrame([(i, p, p, ".x", 1, None, d) for i, (p, d) in enumerate(files)], "id bigint, path string, filename string, extension string, size_bytes bigint, modified_date string, parent_folder string"), "search_texts": spark.createDataFrame(texts, "path string, source_type string, source_key string, content string")})
    weight = {"filename": 1.0, "title": 0.9, "artist": 0.8, "album": 0.8, "folder": 0.6, "chunk": 0.5, "genre": 0.5}
    want = {}
    for word in ("ball", "balls", "arm", "arms"):
        hits = plain_search([((p, s), t) for p, s, _, t in texts], word)
        for p, s in sorted(hits, key=lambda k: (hits[k], k))[:100]:
            want[p] = max(want.get(p, 0), weight.get(s, 0.4))
    for p in sorted(want, key=lambda p: (-want[p], p))[:50]:
        for s in sorted(x for x, d in files if d == p[:3] and x != p)[:20]:
            want[s] = max(want.get(s, 0), want[p] * 0.5) if s in want else want[p] * 0.5
    got = {r.path: r.score for r in concept.simple_search(c, ["ball", "arm"]).collect()}
    assert got == pytest.approx(want)


def test_session_siblings_against_a_plain_version(spark):
    """Crowded seconds, folders with gaps, edges of slots, and rows without a time or folder."""
    rng = random.Random(5)
    rows = [(f"/x{i:03d}", rng.choice(["/a", "/b"]), f"2024-01-01 {rng.randrange(3):02d}:{rng.choice([0, 0, 0, 29, 30, 59]):02d}:{rng.choice([0, 0, 59]):02d}") for i in range(140)]
    rows += [("/n1", "/a", None), ("/n2", None, "2024-01-01 00:00:00"), ("/n3", None, "2024-01-01 00:00:00"), ("/n4", "/a", "no date")]
    df = spark.createDataFrame(rows, "path string, parent_folder string, modified_date string")
    at = {p: (d, int(m[11:13]) * 3600 + int(m[14:16]) * 60 + int(m[17:])) for p, d, m in rows if m and m[0] == "2" and d}
    for window, limit in ((3600, 15), (1800, 3), (60, 200), (0, 4)):
        want = set()
        for p, (d, t) in at.items():
            near = sorted((abs(u - t), s) for s, (e, u) in at.items() if s != p and e == d and abs(u - t) <= window)[:limit]
            want |= {(p, s, g, k + 1) for k, (g, s) in enumerate(near)}
        assert {tuple(r) for r in access.session_siblings(df, window, limit).collect()} == want


def test_manifest_of_matches(spark, data):
    import json

    got = json.loads(q.QUERIES["match_manifest"](spark, data).first().manifest)
    c = catalog_over(spark, data)
    files = {r.path: r for r in c.files.collect()}
    seed = next(r for r in files.values() if r.id == 3)
    assert got["seed"] == seed.path and got["seed_info"] == {"path": seed.path, "filename": seed.filename, "extension": seed.extension, "size_bytes": seed.size_bytes}
    assert got["generated_at"] == "2024-01-01 00:00:00"
    ranked = got["matches"]
    assert [m["rank"] for m in ranked] == list(range(1, 21))
    assert [m["path"] for m in ranked] == [m["path"] for m in sorted(ranked, key=lambda m: (-m["score"], m["path"]))]
    for m in ranked:
        assert m["filename"] == files[m["path"]].filename
        by = {a["name"]: a["score"] for a in m["axes"]}
        assert m["score"] == pytest.approx((2 * by["bpm"] + by["spectral"]) / 3)


def test_contrast_and_best_pair_against_a_plain_version(spark, data):
    import numpy as np

    rows = [(r.label, np.array(r.embedding, float)) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    p, n = (np.mean([v for k, v in rows if k == y], axis=0) for y in (1, 2))
    want = p - 0.3 * n
    got = np.array(q.QUERIES["contrast_vector"](spark, data).first().v)
    assert np.allclose(got / np.linalg.norm(got), want / np.linalg.norm(want), atol=1e-5)
    c = catalog_over(spark, data)
    segs = {}
    for r in access.segments_with_vectors(c.segments, c.segment_embeddings, "region", "clip:ViT-B-32").collect():
        v = np.array(r.vector, float)
        segs.setdefault(r.path, []).append((r.id, v / np.linalg.norm(v), r.label))
    seed = sorted(segs[min(segs)], key=lambda x: x[0])
    for r in q.QUERIES["segment_best_pair"](spark, data).collect():
        pairs = [(min(max(float(a @ b), 0), 1), x, y) for _, a, x in seed for _, b, y in segs[r.path]]
        assert r.score == pytest.approx(max(s for s, _, _ in pairs), abs=2e-6)
        assert any(abs(s - r.score) < 2e-6 and (x, y) == (r.seed_label, r.cand_label) for s, x, y in pairs)


def test_equal_vectors_give_k_neighbours_each(spark):
    from relatum.operators import knn

    df = spark.createDataFrame([(f"p{i:02d}", [1.0, 0.0] if i < 30 else [0.0, 1.0]) for i in range(40)], "path string, vector array<float>")
    found = knn._nearest(*(lambda r: (r[0], r[1], r[0], r[1]))((__import__("numpy").array([f"p{i:02d}" for i in range(40)], object), __import__("numpy").eye(2)[[0] * 30 + [1] * 10])), 3, 0.1, True)
    assert len(found) == 120
    got = {}
    for r in knn.nearest(df, df, 3, 0.1).collect():
        got.setdefault(r.path_a, []).append(r.path_b)
    for i in range(40):
        pool = [f"p{j:02d}" for j in (range(30) if i < 30 else range(30, 40)) if j != i]
        assert sorted(got[f"p{i:02d}"]) == pool[:3]

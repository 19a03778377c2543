import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from relatum.llm import quality, toxicity
from relatum.llm.queries import QUERIES


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


@pytest.fixture(scope="module")
def larger():
    return "/root/testdata/sf0.1"


def test_quality_on_held_out_labels(spark, larger):
    got = {r.doc_id: r for r in QUERIES["op1_quality"](spark, larger).collect()}
    want = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{larger}/labels.parquet").collect()]
    assert all(got[i].held_out == held(i) and 0 <= got[i].score <= 1 and got[i].predicted == int(got[i].score >= 0.3) for i in list(got)[:500])
    right = [got[i].predicted == y for i, y in want if held(i)]
    assert np.mean(right) > 0.97


def test_toxicity_on_held_out_labels(spark, larger):
    got = {r.doc_id: r for r in QUERIES["op10_toxicity"](spark, larger).collect()}
    pairs = [(got[i].score, y) for i, y in ((r.doc_id, r.toxic) for r in spark.read.parquet(f"{larger}/labels.parquet").collect()) if held(i)]
    hit = np.mean([s >= 0.5 for s, y in pairs if y == 1])
    wrong = np.mean([s >= 0.5 for s, y in pairs if y == 0])
    assert hit > 0.8 and wrong < 0.03


def test_held_out_labels_are_never_used(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    sample = quality.labelled_sample(docs, labels, "quality")
    assert sample.num_rows and not any(held(i) for i in sample.column("doc_id").to_pylist())


@pytest.mark.parametrize("score", [quality.quality_scores, toxicity.toxicity_scores])
def test_odd_rows(odd, none, labels, score):
    got = score(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (2, 3, 4)}) == 1
    assert len({r.score for r in got if r.doc_id == 7}) == 1
    assert score(none, labels).count() == 0
    assert len(score(odd, labels.limit(0)).collect()) == odd.count()


def test_accepted_keeps_columns(odd, labels):
    got = quality.accepted(odd, labels)
    assert got.columns == odd.columns
    assert quality.accepted(odd, labels.limit(0)).count() == odd.count()


def test_word_features_by_hand():
    buckets, n = quality.word_features(pa.array(["ab", "", "ab"]))
    # <ab>: the word, 3 two-, 2 three-, 1 four-grams; <>: the word and one two-gram.
    assert n.tolist() == [7, 2, 7] and buckets[:7].tolist() == buckets[9:].tolist()


def test_readings_of_disguised_words():
    words = pa.array(["idiot", "trash", "pathetic", "the", "moron"])
    model = toxicity.smoothed(toxicity.trigram_counts(words, np.full(5, 1000)))
    for seen, meant in (("1d10t", "idiot"), ("tr@sh", "trash"), ("m.o.r.o.n", "moron"), ("idiooooot", "idiot"), ("p4th3tic", "pathetic")):
        assert toxicity.decode(seen, model) == meant
    col = pa.array(["you i d i o t there", "a b"])
    w, at, bounds = toxicity.words_of(col)
    _, _, apart, owner = toxicity.readings(w, at, bounds, model)
    assert apart[0] == "idiot" and set(owner.tolist()) == {0}


def test_trigram_counts_by_brute_force():
    words = pa.array(["ab", "b", "c3", "é"])
    got = toxicity.trigram_counts(words, np.array([2, 1, 9, 1]))
    want = np.zeros(64**3)
    for word, k in (("ab", 2), ("b", 1), ("é", 1)):
        x = [0, 0, *toxicity.letter_class(np.array([ord(c) for c in word])), 0]
        for i in range(len(word) + 1):
            want[x[i] * 4096 + x[i + 1] * 64 + x[i + 2]] += k
    assert (got == want).all()


def test_long_words_are_read():
    """A word stretched beyond any bound by repeats or separators."""
    words = pa.array(["stupid", "people", "hello", "world", "idiot"])
    model = toxicity.smoothed(toxicity.trigram_counts(words, np.full(5, 1000)))
    seen = pa.array(["i" + "d" * 90 + "iot", "-".join("stupid").replace("-", "-" * 30)])
    restored, source, _, _ = toxicity.readings(seen, np.arange(2), np.array([0, 1, 2]), model)
    assert restored == ["idiot", "stupid"] and source.tolist() == [0, 1]


def test_training_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i % 50, "x" * 1000) for i in range(400)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id bigint, quality int")
    assert quality.labelled_sample(docs, labels, "quality", 30).num_rows == 30
    assert quality.labelled_sample(docs, labels, "quality", 300, 12_500).num_rows == 12
    assert quality.labelled_sample(docs, labels, "quality", 300, 10).num_rows == 0


def test_scores_against_a_plain_version(spark, data, rows, labels):
    """Every text's score again, word by word, from the trained table."""
    logits, bias = quality.fit(spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet"))
    logits = logits.astype(np.float32)
    got = {r.doc_id: r.score for r in QUERIES["op1_quality"](spark, data).collect()}
    for i, text in rows:
        words = [w for w in re.split("[ \\t-\\r]+", text) if w]
        total, n, before = 0.0, 0, None
        for w in words:
            ids, _ = quality.word_features(pa.array([w]))
            total, n = total + float(logits[ids].sum()), n + len(ids)
            if w == before:
                total, n = total + float(logits[quality.REPEAT]), n + 1
            before = w
        assert got[i] == pytest.approx(1 / (1 + np.exp(-(total / max(n, 1) + bias))), abs=1e-5)


def test_joined_words_are_read_apart():
    counts = toxicity.trigram_counts(pa.array(["stupid", "people", "wonder"]), np.array([900.0, 900.0, 900.0]))
    model = toxicity.smoothed(counts)
    found, source, _, _ = toxicity.readings(pa.array(["stup1d-pe0ple.w0nder"]), np.array([0]), np.array([0, 1]), model)
    assert {"stupid", "people", "wonder"} <= set(found) and set(source.tolist()) == {0}

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from relatum.llm import fingerprint, mixing, tokens
from relatum.llm.queries import QUERIES


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.tokenizer_path())


def expected_tokens(rows, tok):
    out, start = [], 0
    for i, text in rows:
        ids = [*tok.encode(text, add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files_round_trip(spark, data, rows, tokenizer):
    got = [tuple(r) for r in QUERIES["op7_token_output"](spark, data).orderBy("doc_id").collect()]
    assert got == expected_tokens(rows, tokenizer)


ODD_WORDS = ["", None, "ΑΣ ΣΑΣ. Σ!", "İstanbul, İ.", "é. á!! क़ क़.", "<|endoftext|>! a<|endoftext|>.x <|startoftext|>", "don't! I'll. it's, 's 'S", "x2. 2! ²! ½, 1d10t!!", "a b c. d\x0be", "ﬁ. ﬁ!! Ǆ, K.", "!!! ... a...b...", "日本語。日本語. 한국어!", "\U0001d400\U0001d401. 👍! 👍🏽.", "a'b. 'tis' ''", "x" * 3000]


def test_words_apart_encode_as_texts(spark, tokenizer):
    df = spark.createDataFrame(list(enumerate(ODD_WORDS)), "doc_id bigint, text string")
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tokens.token_output(df).orderBy("doc_id").collect()]
    assert got == expected_tokens([(i, t or "") for i, t in enumerate(ODD_WORDS)], tokenizer)


def test_whole_texts_and_wide_vocabularies(spark, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokens.tokenizer_path("byte_bpe_50k.json"))
    df = spark.createDataFrame(list(enumerate(ODD_WORDS)), "doc_id bigint, text string")
    tokens.write_tokens(df, str(tmp_path / "t"), "byte_bpe_50k.json", 70_000, by_word=False)
    got = {r.doc_id: r for r in tokens.read_tokens(spark, str(tmp_path / "t")).collect()}
    for i, t in enumerate(ODD_WORDS):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 70_000]
        assert got[i].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_cache_that_overflows(monkeypatch, tokenizer):
    import pyarrow as pa

    monkeypatch.setattr(tokens, "CACHE_WORDS", 5)
    enc = tokens.WordEncoder("word_bpe_49k.json")
    texts = ["alpha beta gamma", "delta epsilon, zeta! eta", "alpha theta iota kappa lambda mu", "nu"]
    for _ in range(2):
        ids, n = enc.encode(pa.array(texts))
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("values", [[], [0], [255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1, 7], list(range(0, 200_000, 37))])
def test_value_coding(values):
    control, data = tokens.encode_values(np.array(values, np.uint32))
    assert len(control) == -(-len(values) // 4)
    assert tokens.decode_values(control, data, len(values)).tolist() == values


def test_ranks_are_by_frequency(spark, documents, tmp_path):
    tokens.write_tokens(documents, str(tmp_path / "t"))
    first = spark.read.parquet(str(tmp_path / "t/ranks")).orderBy("rank").limit(50).collect()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokens.tokenizer_path())
    count = collections.Counter(x for r in documents.collect() for x in [*tok.encode(r.text, add_special_tokens=False).ids, 2])
    assert [r.id for r in first] == [i for i, _ in sorted(count.items(), key=lambda kv: (-kv[1], kv[0]))[:50]]


def test_odd_tokens(odd, none):
    got = tokens.token_output(odd).collect()
    assert len(got) == odd.count()
    order = sorted(got, key=lambda r: r.start)
    assert order[0].start == 0 and all(b.start == a.start + a.n_tokens for a, b in zip(order, order[1:]))
    assert [r.doc_id for r in order[:2]] == [None, None] and {r.n_tokens for r in got if r.doc_id in (2, 3, 4)} == {1}
    assert tokens.token_output(none).count() == 0


def test_fingerprint_report(spark, data, rows):
    got = {r.doc_id: r for r in QUERIES["op8_fingerprints"](spark, data).collect()}
    prints = collections.defaultdict(set)
    for k, (i, text) in enumerate(rows):
        h = len(text) // 2
        edited = text[: len(text) - h] + rows[(k + 1) % len(rows)][1][:h]
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        prints[text].add(got[i].fingerprint)
        prints[edited].add(got[i].edited_fingerprint)
    assert {len(x) for x in prints.values()} == {1} and len({f for x in prints.values() for f in x}) == len(prints)
    near, far = (np.array([got[i][c] for i, _ in rows]) for c in ("near_edited", "near_next"))
    assert ((near >= 0) & (near <= 1) & (far >= 0) & (far <= 1)).all() and (near > far).mean() > 0.95


def test_fingerprints_are_multiset_hashes(spark):
    texts = ["one two\nthree four\nfive", "five\none two\nthree four", "one two\nthree four", "five", "one two\none two\nfive"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    f = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(df).collect()}
    assert f[0] == f[1] and len(set(f.values())) == 4
    row = spark.createDataFrame([(f[0], f[2], f[3])], "a string, b string, c string")
    out = row.select(fingerprint.add_paragraphs(F.col("b"), F.col("c")).alias("sum"), fingerprint.add_paragraphs(F.col("a"), F.col("c"), -1).alias("less")).first()
    assert out["sum"] == f[0] and out["less"] == f[2]


def test_likeness_from_printed_fingerprints(spark, data, rows):
    """What is printed decides: decoded here by hand, and near the share of word pairs in common."""
    got = {r.doc_id: r for r in QUERIES["op8_fingerprints"](spark, data).collect()}

    def lanes(f):
        n, at = int(f[64:72], 16), 72
        m = np.array([int(f[k : k + 4], 16) for k in range(at, len(f), 4)], float)
        return 2 * (m + np.round((n / 2 - m) / 65536) * 65536) - n

    def pairs(text):
        return collections.Counter(p for line in text.split("\n") for p in zip(line.split(" "), [*line.split(" ")[1:], None]))

    prints = {i: r.fingerprint for i, r in got.items()}
    apart = []
    for k, (i, text) in enumerate(rows):
        j, other = rows[(k + 1) % len(rows)]
        edited = text[: len(text) - len(text) // 2] + other[: len(text) // 2]
        for a, b, near, x, y in ((prints[i], got[i].edited_fingerprint, got[i].near_edited, text, edited), (prints[i], prints[j], got[i].near_next, text, other)):
            la, lb = lanes(a), lanes(b)
            want = 1.0 if a == b else min(max(la @ lb / np.sqrt((la @ la) * (lb @ lb)), 0), 1)
            assert near == pytest.approx(want, abs=1e-9)
            p, q = pairs(x), pairs(y)
            norm = np.sqrt(sum(v * v for v in p.values()) * sum(v * v for v in q.values()))
            apart.append(abs(near - sum(v * q[w] for w, v in p.items()) / norm))
    assert np.mean(apart) < 0.08
    row = spark.createDataFrame([(prints[rows[0][0]], prints[rows[1][0]])], "a string, b string")
    assert row.select(fingerprint.fingerprint_likeness(F.col("a"), F.col("b"))).first()[0] == pytest.approx(got[rows[0][0]].near_next)


def test_lanes_of_long_texts_wrap(spark):
    """A text of many chunks: the sum of its halves, and the mean of its lanes stays near none."""
    words = [f"w{i * i % 70_001}" for i in range(70_000)]
    half = len(words) // 2
    texts = [" ".join(words[:half]) + "\n" + " ".join(words[half:]), " ".join(words[:half]), " ".join(words[half:])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in fingerprint.fingerprints(df).collect()}
    row = spark.createDataFrame([(got[1].fingerprint, got[2].fingerprint)], "a string, b string")
    assert row.select(fingerprint.add_paragraphs(F.col("a"), F.col("b"))).first()[0] == got[0].fingerprint
    assert np.allclose(np.array(got[0].lanes), np.array(got[1].lanes) + np.array(got[2].lanes))


def test_odd_fingerprints(odd, none, spark):
    got = fingerprint.fingerprint_report(odd).collect()
    assert len(got) == odd.count() and len({r.fingerprint for r in got if r.doc_id in (2, 3)}) == 1
    assert fingerprint.fingerprint_report(none).count() == 0
    lone = fingerprint.fingerprint_report(spark.createDataFrame([(5, "abcdef")], "doc_id bigint, text string")).first()
    assert lone.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and lone.near_next == 1.0


def test_ranges_of_many_bounds(spark):
    df = spark.createDataFrame([(i * 3, f"text {i}") for i in range(500)], "doc_id bigint, text string")
    rows = {r.doc_id: r for r in fingerprint.with_next(df).where("not ghost").collect()}
    assert len(rows) == 500 and all(rows[i * 3].next_text == f"text {(i + 1) % 500}" for i in range(500))


def targets(sizes, weights=(1, 2, 3)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode())
    names += [None] if None in sizes else []
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in fixed]
        level = (total - sum(fixed.values())) / sum(w[s] for s in rest) if rest else 0
        over = {s: 3 * sizes[s] for s in rest if level * w[s] > 3 * sizes[s]}
        if not over:
            return {s: fixed.get(s, level * w[s]) for s in names}
        fixed |= over


def check_mix(got, rows):
    """rows: (source, text)."""
    sizes = collections.Counter()
    widest = collections.Counter()
    for source, text in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        sizes[source] += n
        widest[source] = max(widest[source], n)
    want, taken = targets(sizes), collections.Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and r.taken in [k * r.size for k in range(4)]
        taken[r.source] += r.taken
    assert len(got) == len(rows)
    assert all(abs(taken[s] - want[s]) <= widest[s] + 1e-6 for s in sizes)


def test_mix_meets_targets_and_reruns_agree(spark, data, documents):
    run = lambda: sorted(map(tuple, QUERIES["op9_mixing"](spark, data).collect()), key=str)
    one = run()
    assert one == run()
    check_mix(mixing.mix_sources(documents).collect(), [(r.source, r.text) for r in documents.collect()])


@pytest.mark.parametrize("limit", [mixing.BROADCAST_SOURCES, 0])
def test_mix_of_skewed_sources_and_several_levels(spark, monkeypatch, limit):
    monkeypatch.setattr(mixing, "BLOCK", 4)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", limit)
    rows = [(i, "w " * (1 + i % 9), "hot" if i % 3 else f"s{i % 7}") for i in range(400)] + [(900, "w", "tiny"), (901, None, "hot"), (902, "w w", None), (903, "w w", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    check_mix(mixing.mix_sources(df).collect(), [(s, t) for _, t, s in rows])


def test_mixing_is_unbiased(spark):
    df = spark.createDataFrame([(i, "w " * (1 + i), "a" if i < 6 else "b") for i in range(12)], "doc_id bigint, text string, source string")
    n, total = 12, collections.Counter()
    for seed in range(n):
        for r in mixing.mix_sources(df, seed=seed * 101).collect():
            total[r.doc_id] += r.copies
    rates = {r.doc_id: r.target / r.source_size for r in mixing.mix_sources(df).collect()}
    assert all(abs(total[i] / n - rates[i]) < 0.6 for i in range(12))


def test_odd_mix(odd, none, spark):
    check_mix(mixing.mix_sources(odd).collect(), [(r.source, r.text) for r in odd.collect()])
    assert mixing.mix_sources(none).count() == 0
    blank = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id bigint, text string, source string")
    assert {(r.taken, r.target) for r in mixing.mix_sources(blank).collect()} == {(0, 0.0)}


def test_workers_hand_back_memory_at_the_end(monkeypatch):
    """Once, after the last batch of a task and not before."""
    from relatum.llm import common

    class Pool:
        released = 0

        def release_unused(self):
            Pool.released += 1

    monkeypatch.setattr(common.pa, "default_memory_pool", Pool)
    out = common.handing_back(lambda batches: (2 * b for b in batches))(iter([1, 2]))
    assert [next(out), next(out)] == [2, 4] and Pool.released == 0
    assert list(out) == [] and Pool.released == 1

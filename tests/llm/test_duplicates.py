import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from relatum.llm import neardup, substrings
from relatum.llm.queries import QUERIES
from tests.llm.conftest import prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def brute_components(rows):
    sets = {k: shingles(t) for k, (_, t) in enumerate(rows)}
    above = {k: k for k in sets}

    def find(x):
        while above[x] != x:
            x = above[x]
        return x

    for a in sets:
        for b in range(a):
            i = len(sets[a] & sets[b])
            if i and 100 * i >= 85 * len(sets[a] | sets[b]):
                above[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for k in sets:
        groups[find(k)].append(rows[k][0])
    return [(rows[k][0], len(sets[k]), min(groups[find(k)])) for k in sets]


def test_near_duplicates_against_brute_force(spark, data, rows):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in QUERIES["op5_near_duplicates"](spark, data).orderBy("doc_id").collect()]
    assert got == brute_components(rows)


@pytest.mark.parametrize("links", [0, 10**6])
def test_near_copies_at_many_distances(spark, monkeypatch, links):
    """Chains and stars of copies on both sides of the threshold, components by joins and in one task."""
    monkeypatch.setattr(neardup, "TASK_LINKS", links)
    rng = random.Random(5)
    docs = []
    for g in range(12):
        words = prose(rng, 80 + 10 * g).split()
        for c in range(8):
            mine = list(words)
            for _ in range(c // 2):
                mine[rng.randrange(len(mine))] = "changed" + str(rng.randrange(99))
            docs.append((len(docs), " ".join(mine)))
            if c % 3 == 0:
                words = mine
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(df).orderBy("doc_id").collect()]
    assert got == brute_components(docs)


def test_crowded_region(spark):
    """A few hundred near copies of one text are one component, and each counts once."""
    rng = random.Random(7)
    words = prose(rng, 300).split()
    docs = []
    for i in range(300):
        mine = list(words)
        mine[rng.randrange(len(mine))] = f"c{i}"
        docs.append((i, " ".join(mine)))
    got = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(bytes([i]), bytes([i + 1])) for i in range(60)], "a binary, b binary")
    for f in (neardup.components, neardup.joined_components):
        assert {bytes(r.root) for r in f(edges).collect()} == {b"\0"}


def test_odd_near_duplicates(odd, none):
    got = collections.defaultdict(list)
    for r in neardup.near_duplicates(odd).collect():
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == odd.count()
    assert [got[i][0].n_shingles for i in (2, 3, 4, 8, 9)] == [0, 0, 0, 1, 1]
    assert [got[i][0].component_id for i in (1, 2, 5, 6, 7, 8, 9)] == [1, 2, 5, 5, 1, 8, 8]
    assert neardup.near_duplicates(none).count() == 0


def brute_repeats(texts, length):
    seen = collections.Counter(t[s : s + length] for t in texts for s in range(len(t) - length + 1))
    out = []
    for t in texts:
        cover = np.zeros(len(t), bool)
        for s in range(len(t) - length + 1):
            if seen[t[s : s + length]] > 1:
                cover[s : s + length] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~cover])
        out.append((len(t), int(cover.sum()), int((np.diff(np.concatenate([[0], cover.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def removed(df, length=substrings.LENGTH):
    return [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.remove_repeats(df, length).orderBy("doc_id").collect()]


@pytest.mark.parametrize("classes", [2000, 3])
def test_repeats_against_brute_force(documents, rows, monkeypatch, classes):
    """Also with anchors dealt to many shards."""
    monkeypatch.setattr(substrings, "SHARD_CLASSES", classes)
    assert removed(documents) == brute_repeats([t.encode() for _, t in rows], substrings.LENGTH)


def test_repeats_of_periodic_and_overlapping_texts(spark):
    rng = random.Random(2)
    shared = prose(rng, 150)
    texts = ["ab" * 700, "abc" * 300 + "x" * 450, shared[:900], prose(rng, 30) + shared[100:700] + prose(rng, 30), shared[450:], "é" * 500, prose(rng, 200), "x" * 399, "x" * 400]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert removed(df) == brute_repeats([t.encode() for t in texts], 400)


def test_passage_shared_by_many(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SHARD_CLASSES", 10)
    rng = random.Random(4)
    passage = prose(rng, 90)
    texts = [prose(rng, 60) + " " + passage[: 430 + i] + " " + prose(rng, 60) for i in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert removed(df) == brute_repeats([t.encode() for t in texts], 400)


def test_odd_repeats(odd, none):
    got = {}
    for r in substrings.remove_repeats(odd).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == odd.count()
    assert [(r.n_bytes, r.n_removed) for r in got[2] + got[3]] == [(0, 0), (0, 0)]
    assert got[5][0].n_removed == got[5][0].n_bytes == got[6][0].n_removed
    assert got[7][0].n_removed == got[7][1].n_removed == got[7][0].n_bytes
    assert substrings.remove_repeats(none).count() == 0


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(0)
    data = np.frombuffer(b"banana" * 20 + bytes(rng.integers(97, 100, 300, dtype=np.uint8)) + b"ab" * 60, np.uint8)
    raw, depth = data.tobytes(), 50
    order, common = substrings.suffix_array(data, depth)
    assert [raw[i : i + depth] for i in order] == sorted(raw[i : i + depth] for i in range(len(raw)))

    def shared(i, j):
        k = 0
        while k < depth and max(i, j) + k < len(raw) and raw[i + k] == raw[j + k]:
            k += 1
        return k

    assert common.tolist() == [shared(i, j) for i, j in zip(order, order[1:])]


def test_kept_bytes_are_what_is_left(documents):
    r = substrings.remove_repeats(documents).where(F.col("n_removed") > 0).first()
    assert len(r.kept) == r.n_bytes - r.n_removed and hashlib.sha256(r.kept).hexdigest() == r.kept_sha256


def crowd(rng, n, passage, own, pairs):
    """Texts that share a passage and are not linked by it, with near pairs among them."""
    shared, docs = prose(rng, passage), []
    for i in range(n):
        mine = [f"own{i}x{k}" for k in range(own)]
        docs.append((len(docs), f"{shared} {' '.join(mine)}"))
        if i < pairs:
            docs.append((len(docs), f"{shared} {' '.join(mine[: own * 3 // 4])} {' '.join(f'new{i}x{k}' for k in range(own // 4))}"))
    rng.shuffle(docs)
    return [(i, t) for i, (_, t) in enumerate(docs)]


def test_near_pairs_inside_a_crowd(spark):
    """Pairs at 0.95 among texts at 0.82 to each other, and a second passage that varies."""
    rng = random.Random(9)
    docs = crowd(rng, 400, 454, 50, 40)
    docs += [(1000 + i, t) for i, t in crowd(rng, 60, 200, 10, 20)]
    words = prose(rng, 300).split()
    for i in range(120):
        mine = list(words)
        for k in rng.sample(range(8), 4):
            mine[30 * k] = f"v{k}"
        docs.append((2000 + i, " ".join([*mine, *(f"u{i}x{k}" for k in range(rng.randrange(60)))])))
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(df).collect())
    assert got == sorted(brute_components(docs))


@pytest.mark.parametrize("percent, least", [(85, 41), (80, 36), (100, 64)])
def test_least_common_follows_the_threshold(percent, least):
    assert neardup.least_common(percent) == least


def test_suffix_arrays_of_many_texts():
    """The order of all suffixes, ends before bytes, and the common prefixes of neighbours within their texts."""
    rng = np.random.default_rng(1)
    texts = [b"ab" * 20, b"ab" * 20, b"", b"\0\0\0", b"\0\0", b"b\0", bytes(rng.integers(0, 3, 200, dtype=np.uint8)), b"aaaaaaaaaaaaaaaaa"]
    order, stop, text = substrings.sorted_suffixes(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts]))
    symbols = [[b + len(texts) for b in t] + [k] for k, t in enumerate(texts)]
    flat = [x for t in symbols for x in t]
    assert order.tolist() == sorted(range(len(flat)), key=lambda i: flat[i : stop[i] + 1])
    before, common = substrings.common_prefixes(order, stop, text)
    for i, j in zip(order[1:].tolist(), order.tolist()):
        k = 0
        while flat[i + k] == flat[j + k]:
            k += 1
        assert (before[i], common[i]) == (j, k)


def brute_sharing(rows, words=51):
    seen = collections.defaultdict(set)
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOWER))
        for s in range(len(w) - words + 1):
            seen[tuple(w[s : s + words])].add(i)
    return {i for ids in seen.values() if len(ids) > 1 for i in ids}


def test_shared_passages_against_brute_force(spark, data, rows):
    got = {r.doc_id for r in QUERIES["op6_substrings"](spark, data).where("shares_passage").collect()}
    assert got == brute_sharing(rows) and got


def test_shared_passages_of_just_enough_words(spark):
    """51 words are shared, 50 are not, nor those that one document repeats; a passage that many hold counts for all."""
    rng = random.Random(8)
    p, q, r, many = (prose(rng, n).split() for n in (51, 50, 60, 55))
    texts = [prose(rng, 40).split() + p + prose(rng, 9).split(), p + prose(rng, 70).split(), prose(rng, 30).split() + q, q + prose(rng, 30).split(), r + ["and"] + r, r[:50]]
    texts += [prose(rng, rng.randrange(30)).split() + many + prose(rng, rng.randrange(30)).split() for _ in range(40)]
    docs = [(i, " ".join(w)) for i, w in enumerate(texts)]
    df = substrings._keyed(spark.createDataFrame(docs, "doc_id bigint, text string"))
    got = {x.id for x in substrings.sharing_documents(df).collect()}
    assert got == brute_sharing(docs) == {0, 1, *range(6, 46)}


def test_words_of_one_pattern_do_not_collide(spark):
    """Two words of 1,024 letters, each the other with its letters swapped, in the order in which polynomial hashes collide."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    swapped = word.translate(str.maketrans("ab", "ba"))
    df = spark.createDataFrame([(1, word), (2, swapped), (3, word * 5), (4, swapped * 5)], "doc_id bigint, text string")
    assert {(r.doc_id, r.component_id) for r in neardup.near_duplicates(df).collect()} == {(i, i) for i in (1, 2, 3, 4)}


def test_pairs_among_hundreds_alike(spark):
    """500 groups around one text, two copies each, at 0.86 to each other and 0.70 to the rest: 500 components."""
    rng = random.Random(11)
    words = [f"w{k}" for k in range(5000)]
    base, docs = rng.sample(words, 400), []
    for _ in range(500):
        group = list(base)
        for k in rng.sample(range(400), 4):
            group[k] = rng.choice(words)
        for _ in range(2):
            mine = list(group)
            for k in rng.sample(range(400), 3):
                mine[k] = rng.choice(words)
            docs.append((len(docs), " ".join(mine)))
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string")).collect())
    sets = {i: shingles(t) for i, t in docs}
    above = list(range(len(docs)))

    def find(x):
        while above[x] != x:
            x = above[x]
        return x

    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                above[y] = x
    assert got == [(i, len(sets[i]), find(i)) for i, _ in docs]
    assert len({c for _, _, c in got}) > 450


@pytest.mark.parametrize("length", [1, 6, 7, 8, 15, 20])
def test_windows_are_sorted_as_far_as_they_go(length):
    """Groups of equal windows against brute force; no more bytes are compared than a window has."""
    rng = np.random.default_rng(length)
    for _ in range(40):
        texts = [rng.integers(0, 2, k).astype(np.uint8).tobytes() for k in rng.integers(0, 60, 8)]
        texts.append(texts[0][5:])
        data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(x) for x in texts])
        want = [x[i : i + length] for x in texts for i in range(len(x) - length + 1)]
        twice, group = substrings.repeated_windows(data, ends, length)
        assert twice.tolist() == [want.count(w) > 1 for w in want]
        assert len({*zip(want, group.tolist(), strict=True)}) == len({*want}) == len({*group.tolist()})
        assert substrings._refined(data, ends, length)[1].max(initial=0) < len(data) + len(ends)

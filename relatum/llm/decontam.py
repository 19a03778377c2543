"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact verification.

Items and texts are read as lower-case words and five-word shingles. A window has as many words as the item it is held
against (a shorter document is one window). Similarity is weighted: the sum of the lesser counts over the sum of the
greater ones, and 0.8 or more is contamination.

1. Windows that cannot reach it are passed over: at least 0.8 of the item's shingles must be known benchmark shingles.
2. Each other window gets a 64-bit SimHash of its shingles. Items lie in five tables, by 13 or 12 bits of theirs; two
   fingerprints within RADIUS differ by at most RADIUS // 5 bits in one of the five, so probing each table at all values
   that near finds every item within the radius.
3. Candidates are verified on their exact shingle counts.

A benchmark goes to executors in parts of about PART_BYTES of text, with one pass over the documents for each part; driver
and executors hold one part at a time.

Defined results: null or blank texts and items match nothing; an item of fewer than five words is one shingle and matches
where its words stand in a row; repeated rows keep their rows; repeated items count once by id, all texts of an id are searched, and items without an id are one; texts of any length are
read whole; an empty table gives an
empty result (no items: nothing is contaminated); other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from relatum.llm.common import drop_staged, handing_back, ragged, shingle_hashes, staged, text_bytes, text_slices, word_hashes

SIZE = 5
SIMILARITY = 0.8
#: Of 64 bits. At a similarity of 0.8 the cosine is at least 0.88 and 10 bits differ on average, with a deviation of 3.
RADIUS = 24
CUTS = (0, 13, 26, 39, 52, 64)
PART_BYTES = 16 << 20


def simhash(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprint of each group of hashes: bit by bit the majority of its members, each as often as it occurs."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1
    total = np.add.reduceat(bits, np.cumsum(counts) - counts, axis=0)
    return np.packbits(total > 0, axis=1).reshape(-1).view(">u8").astype(np.uint64)


class HammingIndex:
    """All fingerprints within RADIUS of a query, by exact search in blocks."""

    def __init__(self, prints: np.ndarray, radius: int = RADIUS):
        self.prints, self.radius = prints, radius
        near = radius // (len(CUTS) - 1)
        self.blocks = []
        for lo, hi in zip(CUTS, CUTS[1:], strict=False):
            value = self._block(prints, lo, hi)
            order = np.argsort(value, kind="stable")
            start = np.searchsorted(value[order], np.arange((1 << (hi - lo)) + 1))
            masks = np.array([sum(1 << b for b in c) for k in range(near + 1) for c in combinations(range(hi - lo), k)], np.int64)
            self.blocks.append((lo, hi, order, start, masks))

    @staticmethod
    def _block(x: np.ndarray, lo: int, hi: int) -> np.ndarray:
        return (x >> np.uint64(lo) & np.uint64((1 << (hi - lo)) - 1)).astype(np.int64)

    def search(self, query: np.uint64) -> np.ndarray:
        found = []
        for lo, hi, order, start, masks in self.blocks:
            probe = self._block(np.array([query]), lo, hi)[0] ^ masks
            hit = probe[start[probe + 1] > start[probe]]
            found += [order[start[v] : start[v + 1]] for v in hit]
        if not found:
            return np.zeros(0, np.int64)
        near = np.unique(np.concatenate(found))
        return near[np.bitwise_count(self.prints[near] ^ query) <= self.radius]


class Benchmark:
    """Items by size in words, with their shingle counts and the index of each size."""

    def __init__(self, ids: list[int], texts: pa.Array):
        words, _, _, first = word_hashes(*text_bytes(texts))
        hashes, counts = shingle_hashes(words, first, SIZE)
        start = np.cumsum(counts) - counts
        self.sizes: dict[int, tuple[list[int], list[Counter], HammingIndex]] = {}
        n = np.diff(first)
        known, of_size = [], {}
        for size in np.unique(n[n > 0]).tolist():
            at = np.flatnonzero(n == size)
            shingles = [hashes[start[i] : start[i] + counts[i]] for i in at]
            if size >= SIZE:
                known += shingles
            prints = simhash(np.concatenate(shingles), counts[at])
            of_size[size] = shingles
            self.sizes[size] = ([ids[i] for i in at], [Counter(x.tolist()) for x in shingles], HammingIndex(prints))
        self.known = np.unique(np.concatenate(known)) if known else np.zeros(0, np.uint64)
        self.first = np.zeros(1 << 16, bool)
        self.first[(self.known >> np.uint64(48)).astype(np.int64)] = True
        #: For each size, which of the known shingles its items have.
        self.mine = {m: np.isin(self.known, np.concatenate(x)) for m, x in of_size.items() if m >= SIZE}

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of known shingles, and which ones they are."""
        maybe = np.flatnonzero(self.first[(hashes >> np.uint64(48)).astype(np.int64)])
        if not len(maybe) or not len(self.known):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.known, hashes[maybe]), len(self.known) - 1)
        same = self.known[at] == hashes[maybe]
        return maybe[same], at[same]


def weighted_similarity(a: Counter, b: Counter) -> float:
    both = sum(min(n, b[x]) for x, n in a.items() if x in b)
    return both / (sum(a.values()) + sum(b.values()) - both)


def matches(col: pa.Array, bench: Benchmark) -> list[dict[int, float]]:
    """For each text: the items it holds, with the best similarity of each."""
    words, _, _, first = word_hashes(*text_bytes(col))
    hashes, counts = shingle_hashes(words, first, SIZE)
    start = np.cumsum(counts) - counts
    out: list[dict[int, float]] = [{} for _ in range(len(col))]
    n_words = np.diff(first)

    def verify(doc: int, size: int, window: np.ndarray) -> None:
        ids, items, index = bench.sizes[size]
        mine = None
        for i in index.search(simhash(window, np.array([len(window)]))[0]).tolist():
            mine = mine or Counter(window.tolist())
            s = weighted_similarity(mine, items[i])
            if s >= SIMILARITY - 1e-12 and s > out[doc].get(ids[i], 0):
                out[doc][ids[i]] = s

    place, which = bench.hits(hashes)
    owner = np.searchsorted(start, place, side="right") - 1
    for size in bench.sizes:
        if size < SIZE:
            # Fewer words than a shingle: their sequence is the shingle, hashed alike.
            n = np.maximum(n_words - size + 1, (n_words > 0).astype(np.int64))
            known = np.array(sorted({x for c in bench.sizes[size][1] for x in c}), np.uint64)
            begin = np.cumsum(n) - n
            runs = _short(words, first, size)
            for at in np.flatnonzero(np.isin(runs, known)).tolist():
                doc = int(np.searchsorted(begin, at, side="right") - 1)
                while n[doc] == 0 or at >= begin[doc] + n[doc]:
                    doc -= 1
                if n_words[doc] >= size:
                    verify(doc, size, runs[at : at + 1])
            continue
        k = size - SIZE + 1
        need = int(np.ceil(SIMILARITY * k - 1e-9))
        ours = bench.mine[size][which]
        at, doc = place[ours], owner[ours]
        # Windows with enough of the size's own shingles: those that span some `need` hits in a row.
        last = np.arange(need - 1, len(at))
        first_hit, last_hit = at[last - need + 1], at[last]
        wide = np.minimum(k, counts[doc[last]])
        near = (doc[last - need + 1] == doc[last]) & (last_hit - first_hit < wide)
        lo = np.maximum(last_hit - wide + 1, start[doc[last]])[near]
        hi = np.minimum(first_hit, start[doc[last]] + counts[doc[last]] - wide)[near]
        windows = np.unique(ragged(lo, np.maximum(hi - lo + 1, 0)))
        for s in windows.tolist():
            d = int(np.searchsorted(start, s, side="right") - 1)
            verify(d, size, hashes[s : s + min(k, int(counts[d]))])
    return out


def _short(words: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words, as shingle_hashes has a text of just these words."""
    n = np.maximum(np.diff(first) - size + 1, (np.diff(first) > 0).astype(np.int64))
    out = []
    for doc in np.flatnonzero(n):
        w = words[first[doc] : first[doc + 1]]
        runs = [w[i : i + size] for i in range(int(n[doc]))]
        flat, _ = shingle_hashes(np.concatenate(runs), np.concatenate([[0], np.cumsum([len(r) for r in runs])]), SIZE)
        out.append(flat)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


#: Stands for an item without an id.
NO_ID = -(1 << 63)


def _parts(benchmark: DataFrame) -> Iterator[tuple[bool, pa.Table]]:
    """The items in parts of bounded size, one after the other, and whether it is the last; a text that repeats under its id once."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("bigint"), F.lit(NO_ID)).alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    n = max(1, -(-int(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for i in range(n):
        yield i + 1 == n, items.where(part == i).toArrow()


def _searched(docs: DataFrame, benchmark: DataFrame, schema, name: str, emit) -> DataFrame:
    """docs after emit(batch, matches of its texts) for each part; executors hold one part at a time, as rows are written between."""
    out, at = docs, None
    for i, (last, table) in enumerate(_parts(benchmark)):
        shared = docs.sparkSession.sparkContext.broadcast((table.column("item_id").to_pylist(), table.column("text").combine_chunks()))

        @handing_back
        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            bench = Benchmark(*shared.value)
            for b in text_slices(batches):
                yield emit(b, matches(b.column("text"), bench))

        out = out.mapInArrow(run, schema(out, f"{name}{i}"))
        if not last:
            before, (out, at) = at, staged(out, "searched")
            shared.destroy()
            if before:
                drop_staged(docs.sparkSession, before)
    return out


def benchmark_matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All columns of docs, and a last one: array<struct<item_id, similarity>> in order of item_id (null first).

    It is `matches`, or where docs has a column of this name in any case, `item_matches` or the first of `item_matches_1`, ...
    """
    kind = ArrayType(StructType([StructField("item_id", LongType()), StructField("similarity", DoubleType())]))
    pairs = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64())]))

    def emit(b: pa.RecordBatch, found: list[dict[int, float]]) -> pa.RecordBatch:
        rows = [[{"item_id": None if i == NO_ID else i, "similarity": m[i]} for i in sorted(m)] for m in found]
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, pairs)], [*b.schema.names, "found"])

    out = _searched(docs, benchmark, lambda df, name: StructType([*df.schema.fields, StructField(name, kind)]), f"matches_{uuid.uuid4().hex}", emit)
    found = [c for c in out.columns if c not in docs.columns]
    taken = {c.lower() for c in docs.columns}
    name = next(n for n in ("matches", "item_matches", *(f"item_matches_{k}" for k in range(1, len(taken) + 2))) if n not in taken)
    # An item whose texts lie in several parts counts once, with its best.
    every = F.flatten(F.array(*found))
    ids = F.array_sort(F.array_distinct(F.transform(every, lambda m: F.coalesce(m["item_id"], F.lit(NO_ID)))))
    best = F.transform(ids, lambda i: F.struct(F.nullif(i, F.lit(NO_ID)).alias("item_id"), F.array_max(F.transform(F.filter(every, lambda m: F.coalesce(m["item_id"], F.lit(NO_ID)) == i), lambda m: m["similarity"])).alias("similarity")))
    return out.select(*docs.columns, (F.col(found[0]) if len(found) == 1 else best).alias(name))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that hold no item."""
    return _searched(docs, benchmark, lambda df, name: docs.schema, "", lambda b, found: b.filter(pa.array([not m for m in found], pa.bool_())))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, n_items, best_item, best_similarity, item_ids for every row of docs (doc_id, text)."""
    rows = benchmark_matches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), benchmark)
    best = F.element_at(F.array_sort(F.transform("matches", lambda m: F.struct((-m["similarity"]).alias("s"), m["item_id"].alias("i")))), 1)
    rows = rows.withColumn("b", F.when(F.size("matches") > 0, best))
    ids = F.transform("matches", lambda m: m["item_id"])
    return rows.select("doc_id", (F.size("matches") > 0).alias("contaminated"), F.size("matches").cast("bigint").alias("n_items"), F.col("b.i").alias("best_item"), (-F.col("b.s")).alias("best_similarity"), ids.alias("item_ids"))

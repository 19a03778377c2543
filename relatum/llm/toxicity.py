"""Toxicity with noisy-channel deobfuscation.

A character trigram model counts every word of all documents. A word that looks disguised (digits or signs among its
letters, letters three times in a row, separators between letters), the parts that separators join, and letters that stand apart become a lattice: each
sign may be one of the letters it imitates, a separator or a repeated letter may be nothing. Viterbi decoding under the
trigram model picks the likeliest reading, and readings count beside the words as written.

The scorer is learned from a bounded sample of labelled rows (`MAX_TRAIN`, by hash of the id): words and word beginnings
get the lower confidence bound of their share of toxic documents, and a logistic layer weighs a document's strongest
evidence, how much of it there is, and its length. The layer is fitted on halves that the shares were not taken from.

Defined results: null, empty and blank texts get the score of no evidence; labels that are null, held out or without a
document are not used; without both labels every score is the share of toxic labels (0 without any); repeated rows keep
their rows; texts and words of any length are read whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relatum.llm.common import held_out, mix64, prefix_hash, ragged, range_hash, text_bytes, text_slices
from relatum.llm.quality import labelled_sample, split_words

MAX_TRAIN = 6000
#: Letters that a sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c"}
SEPARATORS = ".-_*~^'`,/\\:="
EDGE = ".,!?;:|%&*#\"'()[]{}<>/\\-_=~^`"
#: Costs, as negative log odds, of a sign for a letter, of a sign for nothing, of a separator for nothing, and of a letter
#: for nothing in a run of three or more and of two. What drops a letter also drops its cost under the model.
SIGN_COST, DROP_COST, SEPARATOR_COST, REPEAT_COST, DOUBLE_COST = 1.5, 9.0, 0.7, 0.5, 7.0
CLASSES = 64
#: Word beginnings in bytes.
BEGIN = range(3, 12)
#: Standard errors of the lower bound; shares from which a word is evidence.
Z, EVIDENCE = 2.5, 0.35
#: Letters that stand apart in a row, at least.
APART = 4
LONGEST = 16

JOINED = re.compile("[" + re.escape(SEPARATORS) + "]+")
_RUNS = "|".join(f"{c}{c}{c}" for c in "abcdefghijklmnopqrstuvwxyz")
SUSPECT = rf"(?:\pL.*[0-9@$!|+(<.\-_*~^'`,/\\:=].*\pL)|(?:^[0-9@$!|+(<]+\pL)|(?:\pL[0-9@$!|+(<]+$)|{_RUNS}"


def letter_class(points: np.ndarray) -> np.ndarray:
    """1..26 for a-z, 27..63 for other code points; 0 is the edge of a word."""
    low = (points >= 97) & (points <= 122)
    return np.where(low, points - 96, 27 + points % 37).astype(np.int64)


def words_of(col: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct lower-case words without marks at their edges, and where the texts have them."""
    words, at, bounds = split_words(pc.utf8_lower(pc.fill_null(col, "")))
    return pc.utf8_trim(words, EDGE), at, bounds


def trigram_counts(words: pa.Array, weight: np.ndarray) -> np.ndarray:
    """Counts of class trigrams over the words of letters alone, two edges before and one after."""
    pure = pc.match_substring_regex(words, r"^\pL+$").to_numpy(zero_copy_only=False)
    chosen = words.filter(pa.array(pure))
    if not len(chosen):
        return np.zeros(CLASSES**3)
    size = pc.utf8_length(chosen).to_numpy(zero_copy_only=False).astype(np.int64)
    points = np.frombuffer("".join(chosen.to_numpy(zero_copy_only=False).tolist()).encode("utf-32-le"), np.uint32).astype(np.int64)
    padded = np.zeros(len(points) + 3 * len(size), np.int64)
    start = np.cumsum(size + 3) - (size + 3)
    padded[ragged(start + 2, size)] = letter_class(points)
    at = ragged(start, size + 1)
    return np.bincount(padded[at] * CLASSES**2 + padded[at + 1] * CLASSES + padded[at + 2], weights=np.repeat(weight[pure], size + 1), minlength=CLASSES**3)


def language_model(docs: DataFrame) -> np.ndarray:
    """Log probability of a class after two, from all words of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**3)
        for b in text_slices(batches):
            words, at, _ = words_of(b.column("text"))
            total += trigram_counts(words, np.bincount(at, minlength=len(words)))
        gram = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(total[gram].astype(np.int64))], ["gram", "count"])

    found = docs.select("text").mapInArrow(run, "gram bigint, count bigint").groupBy("gram").agg(F.sum("count").alias("count")).toArrow()
    counts = np.zeros(CLASSES**3)
    counts[found.column("gram").to_numpy()] = found.column("count").to_numpy()
    return smoothed(counts)


def smoothed(counts: np.ndarray) -> np.ndarray:
    """Trigrams that fall back on bigrams and these on single classes."""
    tri = counts.reshape(CLASSES, CLASSES, CLASSES)
    two = tri.sum(axis=0)
    one = (two.sum(axis=0) + 1) / (two.sum() + CLASSES)
    p2 = (two + 5 * one) / (two.sum(axis=1, keepdims=True) + 5)
    p3 = (tri + 5 * p2) / (tri.sum(axis=2, keepdims=True) + 5)
    return np.log(p3).astype(np.float32)


def decode(word: str, model: np.ndarray) -> str:
    """The likeliest reading of a disguised word: Viterbi over states of the last two letter classes."""
    # A state's text is a chain of letters, each with what stands before it.
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    runs = [n for n in (len(list(g)) for _, g in groupby(word)) for _ in range(n)]
    before = ""
    for c, run in zip(word, runs, strict=True):
        options: list[tuple[str, float]] = []
        if c.isalpha():
            options.append((c, 0.0))
            if c == before:
                options.append(("", REPEAT_COST if run > 2 else DOUBLE_COST))
        else:
            options += [(x, SIGN_COST) for x in LEET.get(c, "")]
            options.append(("", SEPARATOR_COST if c in SEPARATORS else DROP_COST))
        before = c
        nxt: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (cost, text) in states.items():
            for x, extra in options:
                if x:
                    k = int(letter_class(np.array([ord(x)]))[0]) if not "a" <= x <= "z" else ord(x) - 96
                    to, new = (b, k), cost + extra - float(model[a, b, k])
                else:
                    to, new = (a, b), cost + extra
                if to not in nxt or new < nxt[to][0]:
                    nxt[to] = (new, (text, x) if x else text)
        states = nxt
    ends = [(cost - float(model[a, b, 0]), text) for (a, b), (cost, text) in states.items()]
    least = min(cost for cost, _ in ends)
    return min(_written(text) for cost, text in ends if cost == least)


def _written(chain: tuple | None) -> str:
    out = []
    while chain:
        chain, x = chain
        out.append(x)
    return "".join(reversed(out))


def readings(words: pa.Array, at: np.ndarray, bounds: np.ndarray, model: np.ndarray) -> tuple[list[str], np.ndarray, list[str], np.ndarray]:
    """Restored words with the word each comes from, and words of letters that stood apart with their text."""
    suspect = np.flatnonzero(pc.match_substring_regex(words, SUSPECT).to_numpy(zero_copy_only=False)) if len(words) else np.zeros(0, np.int64)
    found = []
    for i, w in zip(suspect.tolist(), words.take(pa.array(suspect)).to_pylist(), strict=True):
        found.append((decode(w, model), i))
        # Words that signs join are read one by one too; pieces of a letter or two are a word that is spaced out.
        parts = [x for x in JOINED.split(w) if len(x) >= APART]
        found += [(decode(x, model), i) for x in parts if len(x) < len(w)]
    apart, owner = [], []
    if len(at):
        single = pc.utf8_length(words).to_numpy(zero_copy_only=False)[at] == 1
        doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        edge = np.flatnonzero(np.diff(np.concatenate([[-1], np.where(single, doc, -1), [-1]])))
        texts: dict[int, str] = {}
        for lo, hi in zip(edge[:-1], edge[1:], strict=True):
            if hi - lo >= APART and single[lo]:
                letters = "".join(texts.setdefault(k, words[k].as_py()) for k in at[lo:hi].tolist())
                for s in range(len(letters) - APART + 1):
                    part = letters[s : s + LONGEST]
                    apart.append(part if part.isalpha() else decode(part, model))
                    owner.append(int(doc[lo]))
    return [x for x, _ in found], np.array([i for _, i in found], np.int64), apart, np.array(owner, np.int64)


def features(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each word's beginnings and of the whole word; the word each belongs to."""
    data, off = text_bytes(words)
    size, prefix = np.diff(off), prefix_hash(data)
    out, owner = [], []
    for k in BEGIN:
        i = np.flatnonzero(size >= k)
        out.append(mix64(range_hash(prefix, off[i], off[i] + k) + np.uint64(k)))
        owner.append(i)
    i = np.flatnonzero(size > 0)
    out.append(mix64(range_hash(prefix, off[i], off[i + 1]) ^ np.uint64(0xFFFF)))
    owner.append(i)
    # The lowest bit is free for a label.
    return np.concatenate(out) & ~np.uint64(1), np.concatenate(owner)


class Shares:
    """Lower bounds of the toxic share by feature; those of no evidence are left out."""

    def __init__(self, hashes: np.ndarray, bounds: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.bounds = hashes[order], bounds[order].astype(np.float32)
        self.first = np.zeros(1 << 16, bool)
        self.first[(self.hashes >> np.uint64(48)).astype(np.int64)] = True

    def of(self, words: pa.Array) -> np.ndarray:
        """The strongest share of each word."""
        out = np.zeros(len(words), np.float32)
        if not len(self.hashes) or not len(words):
            return out
        h, owner = features(words)
        maybe = np.flatnonzero(self.first[(h >> np.uint64(48)).astype(np.int64)])
        h, owner = h[maybe], owner[maybe]
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = self.hashes[at] == h
        np.maximum.at(out, owner[hit], self.bounds[at[hit]])
        return out


def evidence(col: pa.Array, shares: Shares, model: np.ndarray) -> np.ndarray:
    """For each text: strongest share, its square, log of the words of evidence, log of the words, and 1."""
    words, at, bounds = words_of(col)
    n = np.diff(bounds)
    w = shares.of(words)
    restored, source, apart, owner = readings(words, at, bounds, model)
    np.maximum.at(w, source, shares.of(pa.array(restored, pa.string())))
    per = np.append(w[at], np.float32(0))
    top = np.maximum.reduceat(per, bounds[:-1]) if len(n) else np.zeros(0)
    top = np.where(n > 0, top, 0).astype(np.float64)
    strong = np.concatenate([[0], np.cumsum(w[at] >= EVIDENCE)])
    count = (strong[bounds[1:]] - strong[bounds[:-1]]).astype(np.float64)
    if len(apart):
        s = shares.of(pa.array(apart, pa.string()))
        np.maximum.at(top, owner, s)
        np.add.at(count, owner, s >= EVIDENCE)
    return np.stack([top, top * top, np.log1p(count), np.log1p(n) / 10, np.ones(len(n))], axis=1)


def shares_of(bags: list[np.ndarray], labels: np.ndarray, keep: float = EVIDENCE / 2) -> Shares:
    """From the distinct features of each document."""
    if not bags:
        return Shares(np.zeros(0, np.uint64), np.zeros(0))
    h = np.concatenate([b | np.uint64(y) for b, y in zip(bags, labels, strict=True)])
    h.sort()
    first = np.flatnonzero(np.append(True, (h[1:] ^ h[:-1]) > 1))
    u, n = h[first] & ~np.uint64(1), np.diff(np.append(first, len(h)))
    p = np.add.reduceat(h & np.uint64(1), first) / n
    low = (p + Z * Z / (2 * n) - Z * np.sqrt((p * (1 - p) + Z * Z / (4 * n)) / n)) / (1 + Z * Z / n)
    return Shares(u[low >= keep], low[low >= keep])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Newton steps with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(sample: pa.Table, model: np.ndarray) -> tuple[Shares, np.ndarray]:
    """Shares and logistic weights from doc_id, text, y."""
    y = sample.column("y").to_numpy()
    if len(set(y.tolist())) < 2:
        share = np.clip(y.mean() if len(y) else 0.0, 1e-9, 1 - 1e-9)
        return shares_of([], y), np.array([0, 0, 0, 0, np.log(share / (1 - share))])
    bags, slices = [], []
    for b in text_slices(iter(sample.select(["text"]).to_batches())):
        col = b.column("text")
        slices.append(col)
        words, at, bounds = words_of(col)
        h, owner = features(words)
        order = np.argsort(owner, kind="stable")
        h, n = h[order], np.bincount(owner, minlength=len(words))
        first = np.cumsum(n) - n
        restored, source, _, _ = readings(words, at, bounds, model)
        rh, ro = features(pa.array(restored, pa.string()))
        more: dict[int, list[np.ndarray]] = {}
        for word, x in zip(source[ro].tolist(), rh, strict=True):
            more.setdefault(word, []).append(x)
        for i in range(len(col)):
            mine = np.unique(at[bounds[i] : bounds[i + 1]])
            extra = [x for k in mine.tolist() if k in more for x in more[k]] if more else []
            bags.append(np.unique(np.concatenate([h[ragged(first[mine], n[mine])], np.array(extra, np.uint64)])))
    half = np.arange(len(bags)) % 2 == 0
    parts = [shares_of([b for b, k in zip(bags, half, strict=True) if k == side], y[half == side]) for side in (True, False)]
    both = [np.concatenate([evidence(c, s, model) for c in slices]) for s in parts]
    x = np.where(half[:, None], both[1], both[0])
    return shares_of(bags, y), fit_logistic(x, y.astype(np.float64))


def toxicity_scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text)."""
    model = language_model(docs)
    shares, weights = fit(labelled_sample(docs, labels, label, MAX_TRAIN), model)
    shared = docs.sparkSession.sparkContext.broadcast((model, shares, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, shares, weights = shared.value
        for b in text_slices(batches):
            s = 1 / (1 + np.exp(-np.clip(evidence(b.column("text"), shares, model) @ weights, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")

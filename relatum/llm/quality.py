"""Quality classifier: supervised subword embeddings.

Words, their character n-grams and immediate repeats of a word hash to rows of one embedding table. A document is the
mean of its rows, a softmax layer on top gives the two class probabilities, and both are trained by stochastic gradient
descent in numpy on a bounded sample of labelled rows (`MAX_TRAIN` rows, `MAX_TRAIN_BYTES` of text, by hash of the id). As the model is linear above
the mean, scoring looks up one logit a bucket, once for each distinct word of a slice, over every whole text.

Defined results: null, empty and blank texts get the probability of the bias alone; labels that are null or whose id
is not in docs or is held out are not used; without usable labels every score is 0.5; repeated rows keep their rows;
equal labels of one id are used once, contradictory ones each; texts of any length are scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relatum.llm.common import handing_back, held_out, mix64, prefix_hash, ragged, range_hash, text_bytes, text_slices

BUCKETS = 1 << 17
DIM = 12
GRAMS = (2, 3, 4)
REPEAT = 0  # the bucket of "same word as the one before"
#: Labelled documents that training reads at most, whatever the size of the input.
MAX_TRAIN = 3000
#: Bytes of their texts at most.
MAX_TRAIN_BYTES = 64 << 20


def word_features(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each distinct word (itself and its n-grams between < and >), word after word; how many each has."""
    data, off = text_bytes(words)
    size = np.diff(off)
    # <word> with its marks, so that n-grams at the ends differ from inner ones.
    padded = np.zeros(len(data) + 2 * len(size), np.uint8)
    start = off[:-1] + 2 * np.arange(len(size))
    padded[start], padded[start + size + 1] = ord("<"), ord(">")
    padded[ragged(start + 1, size)] = data
    prefix = prefix_hash(padded)
    out, owner = [mix64(range_hash(prefix, start, start + size + 2)) % np.uint64(BUCKETS - 1) + np.uint64(1)], [np.arange(len(size))]
    for n in GRAMS:
        k = np.maximum(size + 3 - n, 0)
        at = ragged(start, k)
        out.append(mix64(range_hash(prefix, at, at + n) + np.uint64(n)) % np.uint64(BUCKETS - 1) + np.uint64(1))
        owner.append(np.repeat(np.arange(len(size)), k))
    order = np.argsort(np.concatenate(owner), kind="stable")
    return np.concatenate(out)[order].astype(np.int64), 1 + sum(np.maximum(size + 3 - n, 0) for n in GRAMS)


def split_words(col: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the index of each word of the texts in them, and the first word of each text (n + 1)."""
    split = pc.ascii_split_whitespace(pc.fill_null(col, ""))
    flat = split.flatten()
    coded = flat.dictionary_encode()
    at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    bounds = split.offsets.to_numpy().astype(np.int64)
    bounds = bounds - bounds[0]
    full = pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False)[at] > 0 if len(at) else np.zeros(0, bool)
    before = np.concatenate([[0], np.cumsum(full)])
    return coded.dictionary, at[full], before[bounds]


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _repeats(at: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    same = np.zeros(len(at))
    same[1:] = at[1:] == at[:-1]
    same[bounds[:-1][bounds[:-1] < len(at)]] = 0
    return _sums(same, bounds)


def document_bags(col: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets of each text and their shares."""
    words, at, bounds = split_words(col)
    buckets, n = word_features(words)
    first = np.cumsum(n) - n
    repeats = _repeats(at, bounds)
    out = []
    for i in range(len(col)):
        mine = at[bounds[i] : bounds[i + 1]]
        ids = buckets[ragged(first[mine], n[mine])]
        u, c = np.unique(ids, return_counts=True)
        if repeats[i]:
            u, c = np.append(u, REPEAT), np.append(c, repeats[i])
        out.append((u.astype(np.int32), (c / max(c.sum(), 1)).astype(np.float32)))
    return out


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 8, rate: float = 2.0, seed: int = 7) -> tuple[np.ndarray, float]:
    """A logit for each bucket and the bias, for label 1 against 0."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    soft, bias = rng.uniform(-0.5, 0.5, (2, DIM)), np.zeros(2)
    if len(labels):
        share = np.clip(np.mean(labels == 1), 1e-3, 1 - 1e-3)
        bias[1] = np.log(share / (1 - share))
    steps, done = epochs * len(bags), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            u, w = bags[i]
            lr = rate * (1 - done / steps)
            done += 1
            h = w @ table[u]
            z = soft @ h + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = p @ soft
            soft -= lr * np.outer(p, h)
            bias -= 0.1 * lr * p
            # Shares are small, so rows take a longer step than the softmax layer.
            table[u] -= (10 * lr * w)[:, None] * back
    return table @ (soft[1] - soft[0]), float(bias[1] - bias[0])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int = MAX_TRAIN, max_bytes: int = MAX_TRAIN_BYTES) -> pa.Table:
    """doc_id, text, y of at most `limit` labelled rows that are not held out, by hash of the id.

    Of these, those up to max_bytes of text in all. Rows that repeat an id count each.
    """
    order = [F.xxhash64(F.lit("sample"), "doc_id"), F.col("doc_id"), F.col("y")]
    rows = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    rows = rows.distinct().orderBy(*order).limit(limit)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    found = F.broadcast(rows).join(texts, "doc_id").select("doc_id", "text", "y").orderBy(*order, F.xxhash64("text")).limit(limit)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    before = F.sum(size).over(Window.orderBy(*order, F.xxhash64("text")).rowsBetween(Window.unboundedPreceding, -1))
    found = found.where(size <= max_bytes).withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") + size <= max_bytes).drop("before")
    return found.toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending"), ("y", "ascending")])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> tuple[np.ndarray, float]:
    """Trains on the bounded sample; without both labels in it, all logits are 0."""
    sample = labelled_sample(docs, labels, label)
    y = sample.column("y").to_numpy()
    if len(set(y.tolist())) < 2:
        return np.zeros(BUCKETS), 0.0
    bags = []
    for b in text_slices(iter(sample.select(["text"]).to_batches())):
        bags += document_bags(b.column("text"))
    return train(bags, y)


def score_texts(col: pa.Array, logits: np.ndarray, bias: float) -> np.ndarray:
    """Probability of label 1 for each text."""
    words, at, bounds = split_words(col)
    if not len(words):
        return np.full(len(col), 1 / (1 + np.exp(-bias)))
    buckets, n = word_features(words)
    ends = np.cumsum(n)
    cum = np.concatenate([[0.0], np.cumsum(logits[buckets], dtype=np.float64)])
    per_word = cum[ends] - cum[ends - n]
    repeats = _repeats(at, bounds)
    total = _sums(per_word[at], bounds) + repeats * logits[REPEAT]
    count = _sums(n[at].astype(np.float64), bounds) + repeats
    return 1 / (1 + np.exp(-(total / np.maximum(count, 1) + bias)))


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text)."""
    logits, bias = fit(docs, labels, label)
    shared = docs.sparkSession.sparkContext.broadcast((logits.astype(np.float32), bias))

    @handing_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b0 = shared.value
        for b in text_slices(batches):
            s = score_texts(b.column("text"), w, b0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3) -> DataFrame:
    """The rows of docs, with all their columns, that score at least the threshold."""
    logits, bias = fit(docs, labels, label)
    shared = docs.sparkSession.sparkContext.broadcast((logits.astype(np.float32), bias))

    @handing_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b0 = shared.value
        for b in text_slices(batches):
            yield b.filter(pa.array(score_texts(b.column("text"), w, b0) >= threshold))

    return docs.mapInArrow(run, docs.schema)

"""Shared helpers: staged tables in the cluster's shared folder and bounded Arrow text slices."""

from __future__ import annotations

import ctypes
import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once in a Python worker; one longer document is a slice of its own.
SLICE_BYTES = 1 << 20
#: Documents handled at once; document numbers fit in 12 bits.
SLICE_DOCS = 4096


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or the one set already; in local mode one made here.

    On a cluster that names none, executors would not see each other's files: an error.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="relatum-"))
    return jsc.getCheckpointDir().get().rstrip("/")


def staged(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes df as Parquet to the shared folder and reads it back; lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_staged(spark: SparkSession, path: str) -> None:
    """Deletes a staged table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """df.checkpoint() with the shared folder set."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def row_keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs and a column that tells all its rows apart: doc_id, or a number written down where ids are null or repeat."""
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"))
    if ids.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).isEmpty():
        return docs, "doc_id"
    name = f"row_{uuid.uuid4().hex}"
    return staged(docs.withColumn(name, F.monotonically_increasing_id()), "rows")[0], name


def held_out(doc_id: str = "doc_id", folds: int = 5):
    """True where crc32 of the id as text leaves no remainder; such rows never give labels."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(folds) == 0, F.lit(False))


def text_slices(batches: Iterator[pa.RecordBatch], text: str = "text", max_bytes: int = SLICE_BYTES, max_docs: int = SLICE_DOCS) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that the text of each piece stays near max_bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(text))
        ends = np.cumsum(byte_lengths(col))
        lo = 0
        while lo < batch.num_rows:
            base = ends[lo - 1] if lo else 0
            hi = int(np.searchsorted(ends, base + max_bytes, side="right"))
            hi = min(max(hi, lo + 1), lo + max_docs, batch.num_rows)
            yield batch.slice(lo, hi - lo)
            lo = hi


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def handing_back(run: Run) -> Run:
    """run, after which its worker gives back the memory that it holds unused: workers stay for the tasks of later stages."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return wrapped


def byte_lengths(col: pa.Array) -> np.ndarray:
    """UTF-8 bytes of each value, 0 for null."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column in a row, and the n + 1 offsets of its values (null: empty)."""
    import pyarrow.compute as pc

    col = pc.fill_null(col, "").cast(pa.large_binary())
    off = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i], starts[i] + 1, ... lengths[i] of them, for all i in a row."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


#: The odd multiplier of the polynomial byte hash and the two multipliers of the 64-bit finaliser.
BYTE_BASE = 0x9E3779B97F4A7C15 | 1
MIX_1 = 0xBF58476D1CE4E5B9
MIX_2 = 0x94D049BB133111EB

_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + (1 << 16))
        with np.errstate(over="ignore"):
            up = np.full(size, BYTE_BASE, np.uint64)
            up[0] = 1
            down = np.full(size, pow(BYTE_BASE, -1, 1 << 64), np.uint64)
            down[0] = 1
            _POWERS["up"], _POWERS["down"] = np.cumprod(up), np.cumprod(down)
    return _POWERS["up"], _POWERS["down"]


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(MIX_1)
        x ^= x >> np.uint64(27)
        x *= np.uint64(MIX_2)
        x ^= x >> np.uint64(31)
    return x


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums of bytes modulo 2**64, with a leading 0."""
    up, _ = _powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes from starts to ends, alike wherever they stand."""
    _, down = _powers(len(prefix))
    with np.errstate(over="ignore"):
        return (prefix[ends] - prefix[starts]) * down[starts]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


#: Numbers of the byte values and of the places in a word; longer words are hashed whole.
_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(MIX_2))
_PLACES = mix64(np.arange(1, (1 << 12) + 1, dtype=np.uint64) * np.uint64(MIX_1)) | np.uint64(1)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of [^ \\t-\\r]+ with A-Z in lower case: hash, first byte and end of each, and the first word of each document (n + 1)."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    low = _LOWER[data]
    space = _SPACE[data]
    begin, end = np.empty(len(data), bool), np.empty(len(data) + 1, bool)
    begin[0] = True
    begin[1:] = space[:-1]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begin |= edge[:-1]
    begin &= ~space
    end[0] = False
    end[1:-1] = space[1:]
    end[-1] = True
    end |= edge
    end[1:] &= ~space
    end[0] = False
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end)
    size = ends - starts
    # Every byte times a number of its place: unlike a polynomial, this has no words that collide by their pattern.
    short = np.flatnonzero(size <= len(_PLACES))
    n = size[short]
    h = np.zeros(len(starts), np.uint64)
    if len(short):
        at = np.cumsum(n) - n
        with np.errstate(over="ignore"):
            h[short] = np.add.reduceat(_VALUES[low[ragged(starts[short], n)]] * _PLACES[ragged(np.zeros(len(n), np.int64), n)], at)
    for i in np.flatnonzero(size > len(_PLACES)).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(low[starts[i] : ends[i]].tobytes(), digest_size=8).digest())
    return mix64(h ^ size.astype(np.uint64) * np.uint64(MIX_2)), starts, ends, np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, first: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of `size` words (the whole text where it has fewer), document after document; counts of each."""
    n = np.diff(first)
    count = np.where(n >= size, n - size + 1, (n > 0).astype(n.dtype))
    with np.errstate(over="ignore"):
        q = [np.uint64(pow(MIX_1, k + 1, 1 << 64)) for k in range(size)]
        run = np.zeros(max(len(words) - size + 1, 0), np.uint64)
        for k in range(size):
            run += words[k : k + len(run)] * q[k]
        out = np.zeros(int(count.sum()), np.uint64)
        at = np.cumsum(count) - count
        full = n >= size
        dst, src = ragged(at[full], count[full]), ragged(first[:-1][full], count[full])
        out[dst] = run[src]
        for i in np.flatnonzero((n > 0) & ~full):
            h = np.uint64(n[i])
            for k, w in enumerate(words[first[i] : first[i + 1]]):
                h = h + w * q[k]
            out[at[i]] = h
    return mix64(out), count


def distinct_by_doc(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 52-bit hashes of each document (at most 4,096 of them), and how many."""
    doc = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    key = (doc << np.uint64(52)) | (hashes >> np.uint64(12))
    key.sort()
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    n = np.bincount((key >> np.uint64(52)).astype(np.int64), minlength=len(counts))
    return key & np.uint64((1 << 52) - 1), n

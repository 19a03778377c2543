"""Token-id output: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

`write_tokens` tokenizes every text, ranks ids by how often they occur in the whole input, and writes blocks of
documents in ascending id order; `read_tokens` decodes the blocks. A file is a Parquet container whose rows are
blocks: `part`, `seq` (order), `doc_ids`, `counts`, `control` (two bits a value: bytes less one, four values a byte)
and `data` (little-endian value bytes). The rank table lies beside them under `ranks`. Spark's committer gives each
block once, also where executors are lost meanwhile.

Defined results: a null or empty text is the end id alone; equal ids keep all their rows, ordered by id and then text
hash; a null id comes first; a text of any length is encoded whole, in one block; an empty table gives files without blocks; other columns are ignored.
"""

from __future__ import annotations

import itertools
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relatum.llm.common import drop_staged, handing_back, ragged, shared_dir, staged, text_slices

#: Ids of a block, unless one document has more; entries of a worker's word cache.
BLOCK_IDS = 1 << 19
CACHE_WORDS = 500_000
#: Bytes of text encoded at once: the more, the more words are met again.
TOKEN_SLICE = 6 << 20
#: Vocabularies whose normaliser and splitter were read to keep to white space.
BY_WORD = ("word_bpe_49k.json",)
BLOCK_SCHEMA = "part int, seq int, doc_ids array<bigint>, counts array<int>, control binary, data binary"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: ASCII marks that, after a letter or digit, make a token run of their own.
TRAIL = ".,!?;:|%$&*#"
WORD_END = "</w>"


def _solid(c: str) -> bool:
    """Whether c stays a letter or digit when normalised, so that a mark after it starts a run."""
    return c.isalnum() and (c.isascii() or unicodedata.normalize("NFC", c).lower()[-1].isalnum())


class WordEncoder:
    """Encodes texts by their distinct white-space-free pieces.

    The vocabulary's normaliser and splitter never look across white space and drop it, so a text's ids are those of
    its pieces in a row; and a piece's trailing marks are split from the letter or digit before them. Stems of letters
    alone are one splitter word each, so many are encoded as one text, and the ids that end words part them again.
    Vocabularies for which that does not hold are encoded whole (`by_word=False`).
    """

    def __init__(self, name: str, by_word: bool = True):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(tokenizer_path(name))
        self.by_word = by_word
        vocab = self.tok.get_vocab()
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_word[[i for w, i in vocab.items() if w.endswith(WORD_END)]] = True
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.sizes = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        n = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(n.sum())), n

    def _encode_stems(self, stems: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As _encode, for stems of letters alone."""
        if not stems:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        ids, _ = self._encode([" ".join(stems[i : i + 1024]) for i in range(0, len(stems), 1024)])
        ends = np.flatnonzero(self.ends_word[ids])
        if len(ends) != len(stems) or ends[-1] != len(ids) - 1:
            return self._encode(stems)
        return ids, np.diff(np.concatenate([[-1], ends]))

    def _learn(self, stems: list[str]) -> None:
        plain, other = [], []
        for s in stems:
            one = s.isalpha() and (s.isascii() or (unicodedata.is_normalized("NFC", s) and s.lower().isalpha()))
            (plain if one else other).append(s)
        for group, encode in ((plain, self._encode_stems), (other, self._encode)):
            if not group:
                continue
            ids, n = encode(group)
            k = len(self.known)
            while self.used + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            while k + len(n) > len(self.sizes):
                self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
            self.ids[self.used : self.used + len(ids)] = ids
            self.starts[k : k + len(n)] = self.used + np.cumsum(n) - n
            self.sizes[k : k + len(n)] = n
            self.used += len(ids)
            self.known.update(zip(group, range(k, k + len(group)), strict=True))

    def _places(self, *texts: list[str]) -> list[np.ndarray]:
        """Where each string's ids stand in the store."""
        distinct = set().union(*texts)
        missing = [s for s in distinct if s not in self.known]
        if len(self.known) + len(missing) > CACHE_WORDS and self.known:
            self._forget()
            missing = list(distinct)
        self._learn(missing)
        return [np.fromiter(map(self.known.__getitem__, x), np.int64, len(x)) for x in texts]

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each text has."""
        col = pc.fill_null(col, "")
        if not self.by_word:
            return self._encode(col.to_pylist())
        split = pc.ascii_split_whitespace(col)
        pieces = split.flatten().dictionary_encode()
        words = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        stems = [w.rstrip(TRAIL) for w in words]
        parted = [
            (s if len(s) < len(w) and s and _solid(s[-1]) else w) if "<|" not in w else w
            for w, s in zip(words, stems, strict=True)
        ]
        trails = [w[len(s) :] for w, s in zip(words, parted, strict=True)]
        marked = "<|" in "".join(words)
        parted = [s.lower() if s.isascii() and not (marked and "<|" in s) else s for s in parted]
        # Two pieces a word: its stem and its trail, mostly empty.
        pair = np.stack(self._places(parted, trails), axis=1).reshape(-1)
        size = self.sizes[pair]
        ids = self.ids[ragged(self.starts[pair], size)]
        n = size.reshape(-1, 2).sum(axis=1)
        starts = np.cumsum(n) - n
        index = pieces.indices.to_numpy(zero_copy_only=False)
        per = n[index]
        piece_ends = np.concatenate([[0], np.cumsum(per)])
        bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
        # Positions fit in 32 bits here, which halves what the widest gather moves.
        where = np.repeat((starts[index] - piece_ends[:-1]).astype(np.int32), per)
        where += np.arange(len(where), dtype=np.int32)
        return ids[where], np.diff(piece_ends[bounds])


_ENCODERS: dict[tuple[str, bool], WordEncoder] = {}


def encoder(name: str, by_word: bool = True) -> WordEncoder:
    """This worker's encoder, which keeps the words it knows from task to task."""
    key = (name, by_word)
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(name, by_word)
    return _ENCODERS[key]


def tokenized(docs: DataFrame, name: str = "word_bpe_49k.json", end_id: int = 2, by_word: bool = True) -> DataFrame:
    """doc_id, tie, ids (zstd of little-endian 32-bit, or 16-bit where every id is below 65,536), n."""

    @handing_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        enc = encoder(name, by_word)
        kind = np.uint16 if max(enc.tok.get_vocab_size(), end_id + 1) <= 65536 else np.uint32
        for b in text_slices(batches, max_bytes=TOKEN_SLICE):
            ids, n = enc.encode(b.column("text"))
            ends = np.cumsum(n)
            whole = np.full(len(ids) + len(n), end_id, kind)
            keep = np.ones(len(whole), bool)
            keep[ends + np.arange(len(n))] = False
            whole[keep] = ids
            z = zstandard.ZstdCompressor(level=1)
            cuts = np.concatenate([[0], ends + np.arange(1, len(n) + 1)])
            blobs = [z.compress(whole[cuts[i] : cuts[i + 1]].tobytes()) for i in range(len(n))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tie"), pa.array(blobs, pa.binary()), pa.array(n + 1)], ["doc_id", "tie", "ids", "n"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    return rows.mapInArrow(run, "doc_id bigint, tie bigint, ids binary, n bigint")


def _ids(blobs: list[bytes], n: int) -> np.ndarray:
    """The n ids of several rows in a row."""
    import zstandard

    z = zstandard.ZstdDecompressor()
    raw = b"".join(map(z.decompress, blobs))
    return np.frombuffer(raw, np.uint16 if len(raw) == 2 * n else np.uint32)


def id_counts(tokens: DataFrame) -> DataFrame:
    """id, count over the whole table."""

    @handing_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            c = np.bincount(_ids(b.column("ids").to_pylist(), int(np.sum(b.column("n").to_numpy(zero_copy_only=False)))))
            if len(c) > len(total):
                total = np.concatenate([total, np.zeros(len(c) - len(total), np.int64)])
            total[: len(c)] += c
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(total[at])], ["id", "count"])

    return tokens.select("ids", "n").mapInArrow(run, "id bigint, count bigint").groupBy("id").agg(F.sum("count").alias("count"))


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    v = values.astype("<u4")
    length = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    code = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    code[: len(v)] = length - 1
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    keep = np.arange(4) < length[:, None]
    return control.astype(np.uint8).tobytes(), v.view(np.uint8).reshape(-1, 4)[keep].tobytes()


#: Byte lengths of the four values of each control byte, made from the rule above.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1


def decode_values(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values again: lengths by table lookup, bytes by offset."""
    length = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n].astype(np.int64)
    at = np.cumsum(length) - length
    d = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)])
    out = d[at].astype(np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(length > k)
        if not len(more):
            break
        out[more] |= d[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def write_tokens(docs: DataFrame, path: str, name: str = "word_bpe_49k.json", end_id: int = 2, by_word: bool = True) -> None:
    """Tokenizes docs (doc_id, text) and writes the coded files under path."""
    spark = docs.sparkSession
    tokens, at = staged(tokenized(docs, name, end_id, by_word), "tokens")
    # A row for each id of the vocabulary at most, whatever the input's size.
    counts = id_counts(tokens).orderBy(F.desc("count"), "id").select("id").toArrow()
    ranked = counts.column("id").to_numpy()
    rank = np.zeros(int(ranked.max()) + 1 if len(ranked) else 1, np.uint32)
    rank[ranked] = np.arange(len(ranked), dtype=np.uint32)
    spark.createDataFrame(pa.table({"rank": pa.array(np.arange(len(ranked), dtype=np.int64)), "id": pa.array(ranked.astype(np.int64))})).coalesce(1).write.parquet(f"{path}/ranks")
    shared = spark.sparkContext.broadcast(rank)

    @handing_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), itertools.count()
        names = ["part", "seq", "doc_ids", "counts", "control", "data"]

        def block(docs: list, found: list) -> pa.RecordBatch:
            control, data = encode_values(np.concatenate(found))
            cols = [pa.array([part], pa.int32()), pa.array([next(seq)], pa.int32()), pa.array([docs], pa.list_(pa.int64())), pa.array([[len(x) for x in found]], pa.list_(pa.int32())), pa.array([control], pa.binary()), pa.array([data], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names)

        held, found, size = [], [], 0
        for b in batches:
            for doc, blob, n in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist(), b.column("n").to_pylist(), strict=True):
                if held and size + n > BLOCK_IDS:
                    yield block(held, found)
                    held, found, size = [], [], 0
                held.append(doc)
                found.append(shared.value[_ids([blob], n)])
                size += n
        if held:
            yield block(held, found)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = tokens.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
    ordered.mapInArrow(run, BLOCK_SCHEMA).write.option("compression", "zstd").parquet(f"{path}/blocks")
    shared.unpersist()
    drop_staged(spark, at)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Decodes the files: doc_id, start (ids of all documents before), n_tokens, ids_crc32, part, seq, pos."""
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").select("id").toArrow().column("id").to_numpy()
    shared = spark.sparkContext.broadcast(ranks.astype("<u4"))

    @handing_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                n = np.array(r["counts"], np.int64)
                ids = shared.value[decode_values(r["control"], r["data"], int(n.sum()))]
                ends = np.cumsum(n)
                raw = ids.tobytes()
                crc = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
                k = len(n)
                yield pa.RecordBatch.from_arrays([pa.array([r["part"]] * k, pa.int32()), pa.array([r["seq"]] * k, pa.int32()), pa.array(range(k), pa.int32()), pa.array(r["doc_ids"], pa.int64()), pa.array(ends - n), pa.array(n), pa.array(crc, pa.int64())], ["part", "seq", "pos", "doc_id", "inside", "n_tokens", "ids_crc32"])

    blocks = spark.read.parquet(f"{path}/blocks")
    rows = blocks.mapInArrow(run, "part int, seq int, pos int, doc_id bigint, inside bigint, n_tokens bigint, ids_crc32 bigint")
    # Ids before each block: a row a block, added up inside its file and then over files (a row a file).
    sizes = blocks.select("part", "seq", F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("ids"))
    files = sizes.groupBy("part").agg(F.sum("ids").alias("ids"))
    files = files.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("before"))
    inside = sizes.select("part", "seq", (F.sum("ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("ids")).alias("block"))
    base = inside.join(files, "part").select("part", "seq", (F.col("before") + F.col("block")).alias("base"))
    out = rows.join(base, ["part", "seq"])
    return out.select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", "part", "seq", "pos")


def token_output(docs: DataFrame, path: str | None = None, name: str = "word_bpe_49k.json", end_id: int = 2, by_word: bool | None = None) -> DataFrame:
    """Writes the files and returns what reading them gives.

    Texts are encoded by words only with a vocabulary in BY_WORD, or where by_word says that its rules allow it.
    """
    import uuid

    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_tokens(docs, path, name, end_id, name in BY_WORD if by_word is None else by_word)
    return read_tokens(spark, path)

"""Removal of repeated substrings: every byte covered by a 400-byte string that also starts anywhere else.

1. Each window of `length` bytes has an anchor, its leftmost least 32-byte gram by hash. Windows next to each other that
   share one are a run. Equal windows have equal anchors at equal offsets, so a window whose anchor's gram occurs once
   in the collection is not repeated. Runs of equal bytes (by a 128-bit digest) are one class and go on as one body; a
   class of two runs or more settles its own windows.
2. Bodies of an anchor with an open class go to the anchor's shard. A shard's suffix array is refined as Larsson and
   Sadakane do: suffixes sorted by their first bytes fall into groups, and only groups that are not single yet are sorted
   again, by the rank that each suffix has after as many bytes. Kasai's scan gives the common prefixes: in text order a
   prefix is one byte shorter than the one before unless the bytes before both suffixes differ, so only those where they
   differ are counted, all at once. A window is repeated if it has `length` bytes in common with a neighbour.
3. An anchor with more classes than a shard holds is dealt to several. Each writes its windows as a sorted list and cuts it
   by binary search at the bounds of as many ranges; whoever merges a range looks each list up in the others by binary
   search.

Documents that share a passage of more than 50 words are found alike, on words in place of bytes: classes of runs settle
most of them, and windows of the rest are counted.

Defined results: a null or short text keeps all its bytes; repeated rows are documents that repeat each other; an empty
table gives an empty result; texts of any length are read whole, their bodies in bounded batches; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relatum.llm.common import byte_lengths, drop_staged, mix64, prefix_hash, ragged, range_hash, staged, text_bytes, text_slices, word_hashes

LENGTH = 400
GRAM = 32
#: Words that a passage has at least, and words of its anchor.
PASSAGE, PASSAGE_GRAM = 51, 8
#: Classes of one anchor that go to one shard; bytes sorted in one suffix array.
SHARD_CLASSES = 2000
SHARD_BYTES = 1 << 20
#: A run has fewer windows than this; its place is its first window times this, plus its number of windows.
RUN_BITS = 16
RUN = 1 << RUN_BITS
#: Bodies of a document in one Arrow batch.
BODIES = 4096
#: Bytes of a suffix that its first key holds.
HEAD = 7


def _least_before(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` neighbours, from their first on."""
    have = 1
    m = x
    while 2 * have <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    rest = width - have
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def runs_of(data: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of windows over symbols (bytes, or hashes of words): document, first window and number, anchor hash, two halves of a digest."""
    size = np.diff(off)
    windows = np.maximum(size - length + 1, 0)
    if not windows.any():
        return (np.zeros(0, np.int64),) * 6
    prefix = prefix_hash(data)
    at = np.arange(len(data) - gram + 1)
    h = mix64(range_hash(prefix, at, at + gram))
    place = np.uint64(max(int(len(data)).bit_length(), 1))
    least = _least_before((h >> place << place) | at.astype(np.uint64), length - gram + 1)
    s = ragged(off[:-1], windows)
    mine = least[s]
    doc = np.repeat(np.arange(len(size)), windows)
    new = np.ones(len(s), bool)
    new[1:] = (mine[1:] != mine[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(s)))
    lo = s[first]
    anchor = h[(mine[first] & np.uint64((1 << int(place)) - 1)).astype(np.int64)]
    raw, wide = memoryview(np.ascontiguousarray(data)).cast("B"), data.itemsize
    bounds = zip((wide * lo).tolist(), (wide * (lo + count + length - 1)).tolist(), strict=True)
    digest = b"".join([hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in bounds])
    kind = np.frombuffer(digest, np.int64).reshape(-1, 2)
    d = doc[first]
    return d, lo - off[d], count, anchor.view(np.int64), kind[:, 0], kind[:, 1]


#: What of a suffix's first eight bytes is in its text, by how many bytes that has.
_KEPT = np.array([(1 << 64) - (1 << 8 * (8 - k)) for k in range(9)], np.uint64)


def _refined(data: np.ndarray, ends: np.ndarray, depth: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes of texts that end at `ends`, ordered by refinement, by all they have or by their first `depth` bytes.

    The order of all places; for each place, where in the order its equals begin; where its text ends; and the bytes.
    Each text gets a closing place, which sorts before all bytes and is like no other, so that no suffix is compared
    beyond its text; places are those in the texts with their closings.
    """
    begin = np.concatenate([[0], ends[:-1]])
    n = len(data) + len(ends)
    place = np.arange(len(data)) + np.repeat(np.arange(len(ends)), ends - begin)
    text = np.zeros(n + 8, np.uint8)
    text[place] = data
    close = ends + np.arange(len(ends))
    stop = np.repeat(close, np.diff(np.append(-1, close)))
    head = HEAD if depth is None else min(HEAD, depth)
    left = np.minimum(stop - np.arange(n), head)
    key = np.ndarray((n,), ">u8", text, 0, (1,)).astype(np.uint64)
    # Of keys alike but for zeros, the text that ends first comes first; of equal ends, that of the earlier text.
    key = key & _KEPT[left] | left.astype(np.uint64)
    # The quick sort has vector code, and leaves ties in any order: those of places that end go by text, others are refined.
    order = np.argsort(key).astype(np.int32)
    key = key[order]
    ended = (key & np.uint64(255)) < head
    short = np.flatnonzero(ended)
    order[short] = order[short][np.lexsort((order[short], key[short]))]
    new = np.ones(n, bool)
    new[1:] = (key[1:] != key[:-1]) | ended[1:]
    del key
    rank = np.empty(n, np.int32)
    # A group's rank is the place of its first member, so groups split without changing any other rank.
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), 0))
    h = head
    while depth is None or h < depth:
        open_ = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(open_):
            break
        # Places of a group that is open have h bytes each, so that what follows them is in their text or its closing.
        step = h if depth is None else min(h, depth - h)
        pos = order[open_]
        pair = rank[pos].astype(np.uint64) << np.uint64(32) | rank[pos + step].astype(np.uint64)
        by = np.argsort(pair, kind="stable")
        pos, pair = pos[by], pair[by]
        split = np.ones(len(pos), bool)
        split[1:] = pair[1:] != pair[:-1]
        order[open_] = pos
        new[open_] = split
        rank[pos] = open_[np.maximum.accumulate(np.where(split, np.arange(len(pos)), 0))]
        h += step
    return order, rank, stop, text


def sorted_suffixes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array of texts that end at `ends`: the order of all places, where each place's text ends, and the bytes."""
    order, _, stop, text = _refined(data, ends)
    return order, stop, text


def common_prefixes(order: np.ndarray, stop: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place: the place before it in the order (-1 for the first), and how many bytes both have in common."""
    n = len(order)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    at = np.arange(n)
    # Kasai: where the bytes before both suffixes are alike, one less than at the place before.
    same = np.zeros(n, bool)
    inner = at[1:][before[1:] > 0]
    same[inner] = (text[inner - 1] == text[before[inner] - 1]) & (stop[inner - 1] != inner - 1) & (stop[before[inner] - 1] != before[inner] - 1)
    i = at[~same & (before >= 0)]
    j = before[i]
    most = np.minimum(stop[i] - i, stop[j] - j)
    got = np.zeros(len(i), np.int64)
    words = np.lib.stride_tricks.sliding_window_view(text, 8)[:n]
    going = np.flatnonzero(most > 0)
    while len(going):
        a, b = i[going] + got[going], j[going] + got[going]
        differ = words[a] != words[b]
        some = differ.any(axis=1)
        got[going] += np.where(some, differ.argmax(axis=1), 8)
        going = going[~some]
        going = going[got[going] < most[going]]
    counted = np.zeros(n, np.int64)
    counted[i] = np.minimum(got, most)
    start = np.maximum.accumulate(np.where(same, 0, at))
    return before, counted[start] - (at - start)


def suffix_array(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of one text in order, and each one's common prefix with the one before (up to depth)."""
    order, stop, text = sorted_suffixes(data, np.array([len(data)]))
    before, common = common_prefixes(order, stop, text)
    order = order[1:]
    return order, np.minimum(common[order[1:]], depth)


def repeated_windows(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window inside one text (texts end at `ends`): whether an equal one starts elsewhere, and the first of its equals in order."""
    _, group, _, _ = _refined(data, ends, length)
    begin = np.concatenate([[0], ends[:-1]])
    s = ragged(begin + np.arange(len(ends)), np.maximum(ends - begin - length + 1, 0))
    group = group[s].astype(np.int64)
    return np.bincount(group, minlength=1)[group] > 1, group


KEY = "id bigint, tie bigint"


def _keyed(docs: DataFrame) -> DataFrame:
    """Documents by id (null: the least number), and by text hash too if ids repeat."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))).alias("id"), text.alias("text"), F.col("doc_id").cast("bigint").alias("doc_id"))
    repeat = not rows.groupBy("id").count().where("count > 1").limit(1).isEmpty()
    return rows.withColumn("tie", F.xxhash64("text") if repeat else F.lit(0).cast("bigint"))


def _runs(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            doc, lo, n, *more = runs_of(*text_bytes(b.column("text")), length, gram)
            ids = [b.column(c).to_numpy(zero_copy_only=False)[doc] for c in ("id", "tie")]
            yield pa.RecordBatch.from_arrays([*map(pa.array, (*ids, lo * RUN + n, *more))], ["id", "tie", "place", "anchor", "k1", "k2"])

    return docs.select("id", "tie", "text").where(F.octet_length("text") >= length).mapInArrow(run, f"{KEY}, place bigint, anchor bigint, k1 bigint, k2 bigint")


def _intervals(doc: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of consecutive windows of one document: document, first, one past the last."""
    if not len(s):
        return doc, s, s
    order = np.lexsort((s, doc))
    doc, s = doc[order], s[order]
    new = np.ones(len(s), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (s[1:] != s[:-1] + 1)
    first = np.flatnonzero(new)
    return doc[first], s[first], s[np.append(first[1:], len(s)) - 1] + 1


def repeated_intervals(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """id, tie, lo, hi: windows lo..hi-1 of a document (keyed, text) start elsewhere too. A document may have many rows."""
    if not gram <= length < RUN + gram:
        raise ValueError(f"length must be from {gram} to {RUN + gram - 1}")
    spark = docs.sparkSession
    runs, runs_at = staged(_runs(docs, length, gram), "runs")
    # Any run may stand for its class, and which does is settled by writing the classes down.
    some = [F.first(c).alias(c) for c in ("id", "tie", "place")]
    kind = ["anchor", "k1", "k2"]
    classes, classes_at = staged(runs.groupBy(*kind).agg(F.count("*").alias("runs"), *some), "classes")
    lo, n = F.shiftright("place", RUN_BITS), F.col("place").bitwiseAND(RUN - 1)
    twice = runs.join(classes.where("runs > 1").select(*kind), kind, "left_semi").select("id", "tie", lo.alias("lo"), (lo + n).alias("hi"))
    open_ = classes.groupBy("anchor").agg(F.count("*").alias("m"), F.count_if(F.col("runs") == 1).alias("open")).where("m > 1 and open > 0").select("anchor", "m")
    sent = classes.join(open_, "anchor").select("anchor", "m", F.col("runs").alias("copies"), "id", "tie", lo.alias("lo"), n.alias("n"))
    texts = docs.select("id", "tie", "text").join(sent.select("id", "tie").distinct(), ["id", "tie"], "left_semi").dropDuplicates(["id", "tie"])
    wanted = sent.groupBy("id", "tie").agg(F.collect_list(F.struct("anchor", "m", "copies", "lo", "n")).alias("runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "tie", "anchor", "m", "copies", "lo", "body"]
        for b in batches:
            for doc, tie, text, want in zip(*(b.column(c) for c in ("id", "tie", "text", "runs")), strict=True):
                raw, doc, tie = memoryview(text.as_buffer()), doc.as_py(), tie.as_py()
                for first in range(0, len(want), BODIES):
                    rows = want.values[first : first + BODIES].to_pylist()
                    bodies = [raw[r["lo"] : r["lo"] + r["n"] + length - 1].tobytes() for r in rows]
                    k = len(rows)
                    yield pa.RecordBatch.from_arrays([pa.array([doc] * k, pa.int64()), pa.array([tie] * k, pa.int64()), *(pa.array([r[c] for r in rows], pa.int64()) for c in ("anchor", "m", "copies", "lo")), pa.array(bodies, pa.binary())], names)

    bodies = texts.join(wanted, ["id", "tie"]).select("id", "tie", "text", "runs").mapInArrow(cut, f"{KEY}, anchor bigint, m bigint, copies bigint, lo bigint, body binary")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = F.ceil(F.col("m") / SHARD_CLASSES)
    rows = bodies.select("*", shards.alias("shards"), F.pmod(F.xxhash64("id", "tie", "lo"), shards).alias("salt")).repartition(parts, "anchor", "salt").sortWithinPartitions("anchor", "salt")
    found, found_at = staged(rows.mapInArrow(_sorted_shards(length), f"{KEY}, lo bigint, hi bigint, anchor bigint, salt bigint, body bigint, part bigint, windows array<bigint>, at array<bigint>"), "shards")
    local = found.where("hi is not null").select("id", "tie", "lo", "hi")
    lists = found.where("part is not null").select("anchor", "part", "salt", "windows", "at").repartition(parts, "anchor", "part").sortWithinPartitions("anchor", "part")
    merged = lists.mapInArrow(_merged_lists, "anchor bigint, salt bigint, body bigint, first bigint, end bigint")
    whose = found.where("body is not null").select("anchor", "salt", "body", "id", "tie", "lo")
    across = merged.join(whose, ["anchor", "salt", "body"]).select("id", "tie", (F.col("lo") + F.col("first")).alias("lo"), (F.col("lo") + F.col("end")).alias("hi"))
    out, _ = staged(twice.union(local).union(across), "intervals")
    _drop(spark, runs_at, classes_at, found_at)
    return out


def _drop(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        drop_staged(spark, path)


def _sorted_shards(length: int):
    """Shards (rows in order of anchor and salt) to repeated windows, and for dealt anchors to bodies and sorted lists of windows.

    A list's `at` is the body's number times RUN plus the window's place, or -1 where the window is known as repeated.
    """
    names = ["id", "tie", "lo", "hi", "anchor", "salt", "body", "part", "windows", "at"]
    schema = pa.schema([(c, pa.int64()) for c in names[:-2]] + [(c, pa.list_(pa.int64())) for c in names[-2:]])

    def table(**columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def sort(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        ids, ties, anchors, salts, shards, copies, los, bodies = (list(x) for x in zip(*rows, strict=True))
        data = np.frombuffer(b"".join(bodies), np.uint8)
        size = np.array([len(x) for x in bodies])
        twice, group = repeated_windows(data, np.cumsum(size), length)
        n = size - length + 1
        row = np.repeat(np.arange(len(rows)), n)
        first = np.array(los, np.int64)
        s = ragged(first, n)
        ids, ties, copies, shards = (np.array(x, np.int64) for x in (ids, ties, copies, shards))
        chosen = twice & (copies[row] == 1)
        r, lo, hi = _intervals(row[chosen], s[chosen])
        yield table(id=ids[r], tie=ties[r], lo=lo, hi=hi)
        many = np.flatnonzero(shards > 1)
        if not len(many):
            return
        anchors, salts = np.array(anchors, np.int64), np.array(salts, np.int64)
        yield table(id=ids[many], tie=ties[many], lo=first[many], anchor=anchors[many], salt=salts[many], body=many)
        known = twice | (copies[row] > 1)
        edge = np.flatnonzero(np.append(True, (anchors[many][1:] != anchors[many][:-1]) | (salts[many][1:] != salts[many][:-1])))
        for lo, hi in zip(edge, np.append(edge[1:], len(many)), strict=True):
            mine = many[lo:hi]
            w = np.flatnonzero((row >= mine[0]) & (row <= mine[-1]))
            w = w[np.unique(group[w], return_index=True)[1]]
            begin = (np.cumsum(size) - size)[row[w]] + s[w] - first[row[w]]
            raw = memoryview(data)
            value = np.frombuffer(b"".join([hashlib.blake2b(raw[a : a + length], digest_size=8).digest() for a in begin.tolist()]), np.int64)
            order = np.argsort(value)
            value, at = value[order], np.where(known[w], -1, row[w] * RUN + s[w] - first[row[w]])[order]
            k = int(shards[mine[0]])
            cuts = np.searchsorted(value, np.array([(-(1 << 63)) + i * (1 << 64) // k for i in range(1, k)], np.int64))
            bounds = np.concatenate([[0], cuts, [len(value)]])
            full = np.flatnonzero(np.diff(bounds))
            yield table(anchor=np.full(len(full), anchors[mine[0]]), salt=np.full(len(full), salts[mine[0]]), part=full, windows=[value[bounds[i] : bounds[i + 1]] for i in full], at=[at[bounds[i] : bounds[i + 1]] for i in full])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, used, last = [], 0, None
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("id", "tie", "anchor", "salt", "shards", "copies", "lo", "body")), strict=True):
                key = r[2:4]
                if used > SHARD_BYTES and key != last:
                    yield from sort(held)
                    held, used = [], 0
                held.append(r)
                used += len(r[7])
                last = key
        if held:
            yield from sort(held)

    return run


def _merged_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted lists of the shards of an anchor, range by range, to the windows that another shard has too."""
    names = ["anchor", "salt", "body", "first", "end"]

    def merge(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        everything = np.sort(np.concatenate([r[3] for r in rows]))
        for anchor, _, salt, value, at in rows:
            asked = at >= 0
            others = np.searchsorted(everything, value[asked], "right") - np.searchsorted(everything, value[asked], "left")
            body, first = np.divmod(at[asked][others > 1], RUN)
            body, first, end = _intervals(body, first)
            yield pa.RecordBatch.from_arrays([*map(pa.array, (np.full(len(body), anchor, np.int64), np.full(len(body), salt, np.int64), body, first, end))], names)

    held, last = [], None
    for b in batches:
        for i in range(b.num_rows):
            anchor, part, salt = (b.column(c)[i].as_py() for c in ("anchor", "part", "salt"))
            if held and (anchor, part) != last:
                yield from merge(held)
                held = []
            held.append((anchor, part, salt, *(b.column(c)[i].values.to_numpy() for c in ("windows", "at"))))
            last = anchor, part
    if held:
        yield from merge(held)


def _passage_runs(docs: DataFrame, words: int, gram: int) -> DataFrame:
    """Runs of windows of words: document, place, anchor, digest, and probes.

    Every window holds half of what it may have besides its anchor on one side of it: the anchor with these words is a
    probe, the left one or the right one, null where no window of the run has it.
    """
    half = (words - gram + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "tie", "place", "anchor", "kind", "left", "right"]
        for b in text_slices(batches):
            hashes, _, _, first = word_hashes(*text_bytes(b.column("text")))
            doc, lo, n, anchor, kind, _ = runs_of(hashes, first, words, gram)
            begin, prefix = first[:-1][doc] + lo, prefix_hash(hashes)
            # The anchor's place: the first gram of its hash that all windows of the run hold.
            at = ragged(begin + n - 1, words - gram - n + 2)
            same = mix64(range_hash(prefix, at, at + gram)).view(np.int64) == np.repeat(anchor, words - gram - n + 2)
            at, of = at[same], np.repeat(np.arange(len(n)), words - gram - n + 2)[same]
            at = at[np.append(True, of[1:] != of[:-1])] if len(at) else at
            probes = []
            for salt, lo_, hi in ((1, at - half, at + gram), (2, at, at + gram + half)):
                inside = (lo_ >= begin) & (hi <= begin + n + words - 1)
                h = mix64(range_hash(prefix, np.where(inside, lo_, 0), np.where(inside, hi, 0)) + np.uint64(salt)).view(np.int64)
                probes.append(pa.array(h, mask=~inside))
            ids = [b.column(c).to_numpy(zero_copy_only=False)[doc] for c in ("id", "tie")]
            yield pa.RecordBatch.from_arrays([*map(pa.array, (*ids, lo * RUN + n, anchor, kind)), *probes], names)

    rows = docs.select("id", "tie", "text").where(F.octet_length("text") >= 2 * words - 1)
    return rows.mapInArrow(run, f"{KEY}, place bigint, anchor bigint, kind bigint, left bigint, right bigint")


def sharing_documents(docs: DataFrame, words: int = PASSAGE, gram: int = PASSAGE_GRAM) -> DataFrame:
    """id, tie of the documents (keyed, text) that have a passage of this many words in common with another.

    Runs of windows of words with one anchor, as those of bytes. A class of runs in two documents settles these. Of the
    others, those that share a probe with another class are open, and their windows are counted one by one.
    """
    rows, rows_at = staged(_passage_runs(docs, words, gram), "passages")
    key, who = ["anchor", "kind"], F.struct("id", "tie")
    # One document stands for a class.
    classes = rows.groupBy(*key).agg(F.min(F.struct("id", "tie", "place", "left", "right")).alias("least"), F.max(who).alias("most"))
    shared = (F.col("least.id") != F.col("most.id")) | (F.col("least.tie") != F.col("most.tie"))
    classes, classes_at = staged(classes.select(*key, "least.*", shared.alias("shared")), "kinds")
    same = rows.join(classes.where("shared").select(*key), key, "left_semi").select("id", "tie")
    probes = classes.select("id", "tie", "place", "shared", F.explode(F.array_compact(F.array("left", "right"))).alias("probe"))
    met = probes.groupBy("probe").agg(F.count("*").alias("m"), F.bool_and("shared").alias("settled")).where("m > 1 and not settled").select("probe")
    wanted = probes.join(met, "probe", "left_semi").select("id", "tie", "place", "shared").distinct().groupBy("id", "tie").agg(F.collect_list(F.struct("place", "shared")).alias("runs"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            hashes, _, _, first = word_hashes(*text_bytes(b.column("text")))
            runs = b.column("runs")
            doc = np.repeat(np.arange(b.num_rows), pc.list_value_length(runs).to_numpy())
            place, settled = (x.to_numpy(zero_copy_only=False) for x in runs.flatten().flatten())
            lo, n = place >> RUN_BITS, place & (RUN - 1)
            at, of = ragged(first[:-1][doc] + lo, n), np.repeat(np.arange(len(n)), n)
            h = mix64(range_hash(prefix_hash(hashes), at, at + words)).view(np.int64)
            ids = [b.column(c).to_numpy(zero_copy_only=False)[doc][of] for c in ("id", "tie")]
            yield pa.RecordBatch.from_arrays([*map(pa.array, (*ids, settled[of], h))], ["id", "tie", "shared", "window"])

    each, each_at = staged(docs.select("id", "tie", "text").join(wanted, ["id", "tie"]).select("id", "tie", "text", "runs").mapInArrow(windows, f"{KEY}, shared boolean, window bigint"), "windows")
    both = each.groupBy("window").agg(F.min(who).alias("least"), F.max(who).alias("most")).where("least != most").select("window")
    out, _ = staged(same.union(each.where("not shared").join(both, "window", "left_semi").select("id", "tie")).distinct(), "sharing")
    _drop(docs.sparkSession, rows_at, classes_at, each_at)
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary) for every row of docs (doc_id, text)."""
    return _removed(_keyed(docs), length).drop("shares_passage")


def repeat_report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, shares_passage (boolean) for every row of docs (doc_id, text)."""
    keyed = _keyed(docs)
    return _removed(keyed, length, sharing_documents(keyed)).drop("kept")


def _removed(keyed: DataFrame, length: int, sharing: DataFrame | None = None) -> DataFrame:
    found = repeated_intervals(keyed, length).groupBy("id", "tie").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("found"))
    shares = F.lit(False)
    rows = keyed.join(found, ["id", "tie"], "left")
    if sharing is not None:
        rows, shares = rows.join(sharing.withColumn("shares", F.lit(True)), ["id", "tie"], "left"), F.coalesce("shares", F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "shares_passage"]
        for b in text_slices(batches):
            size, removed, spans, digest, kept = byte_lengths(b.column("text")), [], [], [], []
            lists = b.column("found")
            flat = lists.flatten()
            lo, hi = (x.to_numpy(zero_copy_only=False) for x in flat.flatten())
            bounds = np.concatenate([[0], np.cumsum(np.nan_to_num(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)).astype(np.int64))])
            for i, text in enumerate(b.column("text")):
                raw = memoryview(text.as_buffer()) if text.is_valid and size[i] else memoryview(b"")
                mine = slice(bounds[i], bounds[i + 1])
                if mine.start == mine.stop:
                    kept.append(raw.tobytes())
                    removed.append(0)
                    spans.append(0)
                else:
                    a, z = lo[mine], np.maximum.accumulate(hi[mine] + length - 1)
                    first = np.flatnonzero(np.append(True, a[1:] > z[:-1]))
                    begin, end = a[first], z[np.append(first[1:], len(a)) - 1]
                    removed.append(int((end - begin).sum()))
                    spans.append(len(first))
                    cuts = [0, *np.stack([begin, end], axis=1).reshape(-1).tolist(), int(size[i])]
                    kept.append(b"".join(raw[cuts[k] : cuts[k + 1]] for k in range(0, len(cuts), 2)))
                digest.append(hashlib.sha256(kept[-1]).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.binary()), b.column("shares")], names)

    return rows.select("doc_id", "text", "found", shares.alias("shares")).mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary, shares_passage boolean")

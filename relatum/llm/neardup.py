"""Near-duplicate detection with an LSH forest over MinHash signatures.

Each text becomes the set of its five-word shingles. Texts with one set form a class; a class has a MinHash signature of
64 values. The forest holds several sorted orders, each by its own sequence of eight of these values. In each order,
classes that agree on the first four are a region. All pairs of a small region are candidates; in a crowded one a class
is a candidate with its neighbour and with the heads of the rows that share four and eight values with it. Candidates
whose signatures agree enough are confirmed on their full sets.

Confirmation goes in rounds, since links inside a component need no second proof: first the best candidate of each
class, then the four best of each component, then all that still join two components. Classes of crowded regions that
are in several components after that are joined exactly, on their sets. Connected components of the confirmed links give
the result. All of it is shuffled joins of rows of fixed size, but for the sets of candidates.

Defined results: without words or text a row has an empty set, no links and is its own component; repeated rows are in
one component; a null id never becomes a component's id unless all ids in it are null; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relatum.llm.common import MIX_1, MIX_2, checkpointed, distinct_by_doc, drop_staged, handing_back, mix64, shingle_hashes, staged, text_bytes, text_slices, word_hashes

VALUES = 64
ORDERS = 24
DEPTH = 4
#: Rows of a region up to which all its pairs are compared; more go through crowd_pairs().
CROWDED = 16
#: Rows of a crowd that hold a shingle, from which it is core; cores compared at once.
FREQUENT, BLOCK = 32, 2048
#: Links up to which components are found in one task, which holds them all; more are found by joins.
TASK_LINKS = 500_000


def least_common(percent: int) -> int:
    """Signature values in common from which a pair is confirmed: at this similarity fewer have odds of one in 100,000."""
    p, below = percent / 100, 0.0
    for k in range(VALUES):
        below += comb(VALUES, k) * p**k * (1 - p) ** (VALUES - k)
        if below > 1e-5:
            return k
    return VALUES


def _multipliers() -> np.ndarray:
    return mix64(np.arange(1, VALUES + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)


def _order_positions() -> np.ndarray:
    """For each order, eight of the signature's positions; their first four fall evenly over the signature."""
    rng = np.random.default_rng(5)
    heads = np.concatenate([rng.permutation(VALUES).reshape(-1, DEPTH) for _ in range(-(-ORDERS * DEPTH // VALUES))])[:ORDERS]
    tails = np.stack([rng.permutation(np.setdiff1d(np.arange(VALUES), h))[:DEPTH] for h in heads])
    return np.concatenate([heads, tails], axis=1)


def _reduce(f: np.ufunc, x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """f over each document's share of x, for those that have one."""
    full = n > 0
    return f.reduceat(x, (np.cumsum(n) - n)[full]) if full.any() else x[:0]


def shingle_sets(col: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and how many."""
    words, _, _, first = word_hashes(*text_bytes(col))
    return distinct_by_doc(*shingle_hashes(words, first, size))


def _nodes(sets: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A 128-bit digest of each non-empty set."""
    with np.errstate(over="ignore"):
        hi, lo = (_reduce(np.add, mix64(sets ^ np.uint64(s)), n) for s in (MIX_1, MIX_2))
        k = n[n > 0].astype(np.uint64)
    return np.stack([mix64(hi + k), mix64(lo ^ k)], axis=1).astype(">u8")


def _binary(raw: bytes, width: int, n: int, valid: np.ndarray | None = None) -> pa.Array:
    sizes = np.full(n, width) if valid is None else np.where(valid, width, 0)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw)])


def sketches(docs: DataFrame, size: int = 5) -> DataFrame:
    """doc_id, n_shingles, node (empty where the set is), sig, keys, labels of every row."""

    @handing_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mult, pos = _multipliers(), _order_positions()
        for b in text_slices(batches):
            sets, n = shingle_sets(b.column("text"), size)
            full = n > 0
            sig = np.zeros((int(full.sum()), VALUES), np.uint64)
            with np.errstate(over="ignore"):
                for k in range(VALUES):
                    sig[:, k] = _reduce(np.minimum, sets * mult[k], n)
                sig = mix64(sig)
                keys = np.tile(np.arange(1, ORDERS + 1, dtype=np.uint64), (len(sig), 1))
                for d in range(DEPTH):
                    keys = mix64(keys * np.uint64(MIX_2) + sig[:, pos[:, d]])
                labels = np.zeros_like(keys)
                for d in range(DEPTH, 2 * DEPTH):
                    labels = labels << np.uint64(16) | sig[:, pos[:, d]] & np.uint64(0xFFFF)
            # Labels sort as signed numbers in Spark and unsigned here: the sign bit is flipped for the trip.
            labels = (labels ^ np.uint64(1 << 63)).view(np.int64)
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.where(full, ORDERS, 0))]).astype(np.int32))
            cols = [
                b.column("doc_id"), pa.array(n.astype(np.int64)),
                _binary(_nodes(sets, n).tobytes(), 16, len(n), full), _binary((sig & np.uint64(255)).astype(np.uint8).tobytes(), VALUES, len(n), full),
                pa.ListArray.from_arrays(offsets, pa.array(keys.view(np.int64).reshape(-1))), pa.ListArray.from_arrays(offsets, pa.array(labels.reshape(-1))),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_shingles", "node", "sig", "keys", "labels"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id bigint, n_shingles bigint, node binary, sig binary, keys array<bigint>, labels array<bigint>")


@handing_back
def _region_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates a, b of whole regions in order; members of crowded ones also come with b empty and their key."""
    names = ["a", "b", "key"]

    def pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        first = (a[:, 0] < b[:, 0]) | ((a[:, 0] == b[:, 0]) & (a[:, 1] < b[:, 1]))
        same = (a == b).all(axis=1)
        lo, hi = np.where(first[:, None], a, b)[~same], np.where(first[:, None], b, a)[~same]
        pair = np.unique(np.concatenate([lo, hi], axis=1), axis=0) if len(lo) else np.zeros((0, 4), np.uint64)
        n = len(pair)
        return pa.RecordBatch.from_arrays([_binary(pair[:, :2].astype(">u8").tobytes(), 16, n), _binary(pair[:, 2:].astype(">u8").tobytes(), 16, n), pa.nulls(n, pa.int64())], names)

    def found(key: np.ndarray, label: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(key):
            return
        starts = np.append(True, key[1:] != key[:-1])
        few = np.bincount(np.cumsum(starts) - 1)[np.cumsum(starts) - 1] <= CROWDED
        a, b = [], []
        for lag in range(1, CROWDED):
            i = np.arange(lag, len(key))
            i = i[(key[i] == key[i - lag]) & (few[i] | (lag == 1))]
            a.append(node[i])
            b.append(node[i - lag])
        # A crowded region's cheap candidates: neighbours, its head, and the heads of rows equal in all values.
        for first in (starts, starts | np.append(True, label[1:] != label[:-1])):
            at = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
            a.append(node[~few])
            b.append(node[at][~few])
        yield pairs(np.concatenate(a), np.concatenate(b))
        n = int((~few).sum())
        if n:
            yield pa.RecordBatch.from_arrays([_binary(node[~few].astype(">u8").tobytes(), 16, n), pa.nulls(n, pa.binary()), pa.array(key[~few], pa.int64())], names)

    held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 2), np.uint64))
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        node = np.frombuffer(b"".join(batch.column("node").to_pylist()), ">u8").astype(np.uint64).reshape(-1, 2)
        fresh = (batch.column("key").to_numpy(zero_copy_only=False), batch.column("label").to_numpy(zero_copy_only=False), node)
        key, label, node = (np.concatenate(x) for x in zip(held, fresh, strict=True))
        last = int(np.flatnonzero(np.append(True, key[1:] != key[:-1]))[-1])
        # The last region may go on: it waits, and one that is crowded already leaves its first rows and its last.
        yield from found(key[:last], label[:last], node[:last])
        key, label, node = key[last:], label[last:], node[last:]
        if len(key) > CROWDED + 2:
            yield from found(key, label, node)
            keep = np.append(np.arange(CROWDED + 1), len(key) - 1)
            key, label, node = key[keep], label[keep], node[keep]
        held = (key, label, node)
    yield from found(*held)


def candidates(nodes: DataFrame, percent: int = 85) -> tuple[DataFrame, DataFrame]:
    """Pairs a < b of nodes (node, sig, keys, labels) that are region mates in some order; key, node of crowded regions."""
    spark = nodes.sparkSession
    rows = nodes.select("node", F.explode(F.arrays_zip("keys", "labels")).alias("x")).select(F.col("x.keys").alias("key"), F.col("x.labels").alias("label"), "node")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = rows.repartition(parts, "key").sortWithinPartitions("key", "label", "node").mapInArrow(_region_edges, "a binary, b binary, key bigint")
    found, path = staged(found, "regions")
    crowds = checkpointed(found.where(F.col("b").isNull()).select("key", F.col("a").alias("node")).distinct())
    pairs = found.where(F.col("b").isNotNull()).select("a", "b").distinct()
    sig, least = nodes.select("node", "sig"), least_common(percent)
    pairs = pairs.join(sig.toDF("a", "sig_a"), "a").join(sig.toDF("b", "sig_b"), "b")

    @handing_back
    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                sa, sb = (np.frombuffer(b"".join(x.column(c).to_pylist()), np.uint8).reshape(-1, VALUES) for c in ("sig_a", "sig_b"))
                n = (sa == sb).sum(axis=1)
                kept = pa.RecordBatch.from_arrays([x.column("a"), x.column("b"), pa.array(n.astype(np.int32))], ["a", "b", "common"])
                yield kept.filter(pa.array(n >= least))

    out = checkpointed(pairs.mapInArrow(common, "a binary, b binary, common int"))
    drop_staged(spark, path)
    return out, crowds


def crowd_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs a, b of rows (node, root, set), of unlike roots, whose links join the same components as all links of rows do.

    Shingles in at most FREQUENT rows are rare, others are core. Two similar sets that share a rare shingle share one
    among their first ones in order of frequency (prefix filter), whose few holders are paired. Two that share only core
    shingles are for the greater part core. Of those with one core, all meet the row with the least besides it; of those
    with similar cores, each meets that row of the other core: if two rows are linked, one of these two ways links both.
    """
    spark = rows.sparkSession

    @handing_back
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                x = b.slice(lo, 256)
                sets = [np.frombuffer(v, np.int64) for v in x.column("set").to_pylist()]
                at = np.repeat(np.arange(len(sets)), [len(v) for v in sets])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets)), x.column("node").take(pa.array(at))], ["s", "node"])

    held = checkpointed(rows.select("node", "set").mapInArrow(explode, "s bigint, node binary"))
    shared = held.groupBy("s").agg(F.count("*").alias("df")).where("df > 1")
    items = held.join(shared, "s").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("items"))
    size = (F.octet_length("set") / 8).cast("bigint")
    items = checkpointed(rows.select("node", "root", size.alias("n")).join(items, "node"))
    # Shingles of one row come first in the order; what they leave of the prefix is looked up.
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n") - F.size("items"))
    rare = F.filter(F.slice("items", 1, F.greatest(prefix, F.lit(0)).cast("int")), lambda x: x["df"] <= FREQUENT)
    listed = items.select("node", "root", "n", F.explode(rare).alias("x")).groupBy("x.s").agg(F.collect_list(F.struct("node", "root", "n")).alias("l")).where(F.size("l") > 1)
    met = listed.select("l", F.explode("l").alias("x")).select("x", F.explode("l").alias("y")).where("x.node < y.node and x.root != y.root and 100 * least(x.n, y.n) >= " + str(percent) + " * greatest(x.n, y.n)")
    out = met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))

    core = F.array_sort(F.transform(F.filter("items", lambda x: x["df"] > FREQUENT), lambda x: x["s"]))
    heavy = items.withColumn("core", core).where(100 * F.size("core") >= percent * F.col("n"))
    heavy = checkpointed(heavy.select("node", "root", (F.col("n") - F.size("core")).alias("more"), F.sha2(F.array_join("core", ",").cast("binary"), 256).alias("class"), "core"))
    if heavy.limit(1).isEmpty():
        return out.distinct()
    best = checkpointed(heavy.groupBy("class").agg(F.min(F.struct("more", "node", "root")).alias("m"), F.first("core").alias("core")))
    least = best.select("class", F.col("m.node").alias("b"), F.col("m.root").alias("rb"), F.col("m.more").alias("least"))
    # Room: how many shingles besides their cores two rows may have that share no others. Those that do are met above.
    near = best.select("class", F.col("class").alias("other"), (F.floor(100 * F.size("core") / percent) - F.size("core")).alias("room"))
    blocks = -(-best.count() // BLOCK)

    def alike(table: pa.Table) -> pa.Table:
        block, names = table.column("block").to_numpy(), table.column("class").to_pylist()
        sets = [np.asarray(v.values) for v in table.column("core").combine_chunks()]
        n, more = np.array([len(v) for v in sets]), table.column("more").to_numpy()
        vocabulary, at = np.unique(np.concatenate(sets), return_inverse=True)
        row = np.repeat(np.arange(len(sets)), n)
        ia = np.flatnonzero(block == block.min())
        ib = np.flatnonzero(block == block.max())
        inter = np.zeros((len(ia), len(ib)), np.float32)
        order = np.argsort(at, kind="stable")
        at, row = at[order], row[order]
        for lo in range(0, len(vocabulary), BLOCK):
            l, h = np.searchsorted(at, [lo, lo + BLOCK])
            m = np.zeros((len(sets), BLOCK), np.float32)
            m[row[l:h], at[l:h] - lo] = 1
            inter += m[ia] @ m[ib].T
        inter = inter.astype(np.int64)
        room = 100 * inter // percent - (n[ia][:, None] + n[ib][None] - inter)
        i, j = np.nonzero(room >= more[ia][:, None] + more[ib][None])
        room, i, j = room[i, j], ia[i], ib[j]
        return pa.table({"class": pa.array([names[k] for k in np.append(i, j)], pa.string()), "other": pa.array([names[k] for k in np.append(j, i)], pa.string()), "room": np.append(room, room)})

    # Every two blocks of cores meet once.
    dealt = best.select("class", "core", F.col("m.more").alias("more"), F.pmod(F.xxhash64("class"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("k"))
    dealt = dealt.withColumn("i", F.least("block", "k")).withColumn("j", F.greatest("block", "k"))
    found = dealt.groupBy("i", "j").applyInArrow(alike, "class string, other string, room bigint")
    near = near.union(found).distinct()
    to = heavy.select(F.col("node").alias("a"), F.col("root").alias("ra"), "class", "more").join(near, "class").join(least.withColumnRenamed("class", "other"), "other").where("ra != rb and more + least <= room")
    return out.union(to.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets reach the similarity: 100 * intersection >= percent * union."""
    both = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")

    @handing_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            keep = []
            for sa, sb in zip(x.column("set_a"), x.column("set_b"), strict=True):
                sa, sb = np.frombuffer(sa.as_buffer(), np.uint64), np.frombuffer(sb.as_buffer(), np.uint64)
                if 100 * min(len(sa), len(sb)) < percent * max(len(sa), len(sb)):
                    keep.append(False)
                    continue
                at = np.searchsorted(sb, sa)
                inter = int((sb[np.minimum(at, len(sb) - 1)] == sa).sum())
                keep.append(100 * inter >= percent * (len(sa) + len(sb) - inter))
            yield pa.RecordBatch.from_arrays([x.column("a"), x.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "set_a", "set_b").mapInArrow(run, "a binary, b binary")


@handing_back
def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    above: dict[bytes, bytes] = {}

    def find(x: bytes) -> bytes:
        while above[x] != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = find(above.setdefault(a, a)), find(above.setdefault(b, b))
            if a != b:
                above[max(a, b)] = min(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(list(above), pa.binary()), pa.array([find(x) for x in above], pa.binary())], ["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node) of every node in edges (a, b, written already).

    Up to TASK_LINKS of them in one task; beyond, labels hook to the least neighbour's and jump to the label's label.
    """
    if edges.limit(TASK_LINKS + 1).count() <= TASK_LINKS:
        return checkpointed(edges.select("a", "b").repartition(1).mapInArrow(_union_find, "node binary, root binary"))
    return joined_components(edges)


def joined_components(edges: DataFrame) -> DataFrame:
    """As components, by joins alone."""
    both = checkpointed(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    lab = checkpointed(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
    while True:
        near = both.join(lab.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("m"))
        hooked = lab.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        up = lab.select(F.col("node").alias("root"), F.col("root").alias("above"))
        nxt = checkpointed(hooked.join(up, "root").select("node", "old", F.least("root", "above").alias("root")))
        moved = not nxt.where("old != root").limit(1).isEmpty()
        lab = nxt.select("node", "root")
        if not moved:
            return lab


def _merged(root: DataFrame | None, good: DataFrame) -> DataFrame:
    """node, root after links (a, b) of roots."""
    step = components(good)
    if root is None:
        return step
    to = step.toDF("root", "to")
    old = root.join(to, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return checkpointed(old.union(step.join(root.select("node"), "node", "left_anti")))


def _rooted(pairs: DataFrame, root: DataFrame | None) -> DataFrame:
    """pairs with ra, rb, the roots of a and b so far, where they are not one."""
    if root is None:
        return pairs.withColumn("ra", F.col("a")).withColumn("rb", F.col("b"))
    rows = pairs.join(root.toDF("a", "ra"), "a", "left").join(root.toDF("b", "rb"), "b", "left")
    return rows.withColumn("ra", F.coalesce("ra", "a")).withColumn("rb", F.coalesce("rb", "b")).where("ra != rb")


def _confirmed_components(cand: DataFrame, crowds: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """node, root over the confirmed links; None where there are none."""
    root: DataFrame | None = None
    left = cand
    for best in (1, 4, None):
        left = checkpointed(_rooted(left.select("a", "b", "common"), root))
        if left.limit(1).isEmpty():
            break
        picked = left
        if best is not None:
            order = [F.desc("common"), F.col("a"), F.col("b")]
            ranks = [left.withColumn("r", F.row_number().over(Window.partitionBy(c).orderBy(*order))).where(F.col("r") <= best).select("a", "b", "ra", "rb") for c in ("ra", "rb")]
            picked = checkpointed(ranks[0].union(ranks[1]).distinct())
            left = left.join(picked.select("a", "b"), ["a", "b"], "left_anti")
        good = checkpointed(_confirm(picked.select("a", "b"), sets, percent).join(picked, ["a", "b"]).select(F.col("ra").alias("a"), F.col("rb").alias("b")))
        if not good.limit(1).isEmpty():
            root = _merged(root, good)
    # Crowded regions that are not in one component yet are searched to the end.
    known = crowds.withColumn("root", F.col("node")) if root is None else crowds.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    known = checkpointed(known)
    open_ = known.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x != y").select("key")
    rows = checkpointed(known.join(open_, "key").select("node", "root").distinct())
    if rows.limit(1).isEmpty():
        return root
    picked = checkpointed(_rooted(crowd_pairs(rows.join(sets, "node"), percent), root))
    good = checkpointed(_confirm(picked.select("a", "b"), sets, percent).join(picked, ["a", "b"]).select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    return root if good.limit(1).isEmpty() else _merged(root, good)


def near_duplicates(docs: DataFrame, percent: int = 85, size: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text)."""
    base, _ = staged(sketches(docs, size), "sketches")
    full = base.where("n_shingles > 0")
    nodes = checkpointed(full.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("sig").alias("sig"), F.first("keys").alias("keys"), F.first("labels").alias("labels")))
    cand, crowds = candidates(nodes.select("node", "sig", "keys", "labels"), percent)
    wanted = checkpointed(cand.select(F.col("a").alias("node")).union(cand.select(F.col("b").alias("node"))).union(crowds.select("node")).distinct().join(nodes.select("node", "least"), "node"))

    @handing_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            sets, n = shingle_sets(b.column("text"), size)
            node = _nodes(sets, n).reshape(-1, 2)
            ends, raw = 8 * np.cumsum(n), sets.tobytes()
            rows = [raw[e - 8 * k : e] for e, k in zip(ends.tolist(), n.tolist(), strict=True) if k]
            keys = [x.tobytes() for x in node]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(rows, pa.binary())], ["node", "set"])

    no_id = F.lit(-(1 << 63))
    texts = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), no_id).alias("id"), "text").join(wanted.select(F.coalesce("least", no_id).alias("id")).distinct(), "id", "left_semi")
    sets, set_path = staged(texts.select("text").mapInArrow(run, "node binary, set binary").dropDuplicates(["node"]), "sets")
    root = _confirmed_components(cand, crowds, sets, percent)
    if root is None:
        ids = nodes.select("node", F.col("least").alias("component_id"))
    else:
        rooted = nodes.select("node", "least").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
        ids = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "component_id")
    ids = checkpointed(ids)
    drop_staged(docs.sparkSession, set_path)
    out = base.select("doc_id", "n_shingles", "node").join(ids, "node", "left")
    out = out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))

"""Document fingerprints: a homomorphic multiset hash over paragraphs, in Spark expressions only.

A paragraph (a line) hashes to a wide vector: eight identity lanes from four seeded hashes of its text, its number of word
pairs, and content lanes that add up hash bits of its neighbouring word pairs. A document's fingerprint is the sum of its
paragraphs' vectors, modulo 2**32 in identity lanes and the number of pairs and 2**16 in content lanes, so the order of
paragraphs does not matter, and a paragraph is inserted or deleted by adding or subtracting its vector (`add_paragraphs`).
Documents that share word pairs share summands; likeness is the cosine of the centred content lanes, 0 where negative,
and comes from two printed fingerprints alone: with n pairs, a lane stands for the number near n / 2 that it is left by.

Pairs are summed in chunks, four lanes in a 64-bit column, and the chunks of a document with two lanes in a column.

Defined results: a null text is an empty one, with one empty paragraph; repeated rows are documents of their own, in
order of id (null first), text hash and text; a lone document is its own next; texts of any length are read whole, one row
for each of their words at a time; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seeds of the identity hashes; hashes of each word pair; lanes that a 64-bit hash feeds, and bits of each.
SEEDS = (11, 23, 37, 53)
PAIR_HASHES = 2
LANE_BITS = 16
LANES = 64 * PAIR_HASHES
#: One bit in each lane of a column; words in a chunk (no lane of a chunk overflows), as a power of two.
ONES = sum(1 << (LANE_BITS * k) for k in range(4))
CHUNK_BITS = 14
LOW_16, LOW_32 = (1 << 16) - 1, (1 << 32) - 1
EVEN = LOW_16 << 32 | LOW_16
#: Stands for a line break among words, and after a line that stands as a unit; no word is like these.
BREAK, LINE = "\n", "\n\n"


def _bucket_of(doc_id: Column, bounds: list[int]) -> tuple[Column, Column]:
    """How many of the sorted bounds are at most doc_id, and whether one equals it; by a search of two steps.

    The bounds are one literal, however many.
    """
    if not bounds:
        return F.lit(0), F.lit(False)
    step = max(isqrt(len(bounds)), 1)

    def literal(xs: list[int]) -> Column:
        return F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>")

    g = F.coalesce(F.size(F.filter(literal(bounds[::step]), lambda h: h <= doc_id)), F.lit(0))
    group = F.when(g > 0, F.slice(literal(bounds), (g - 1) * step + 1, step))
    k = F.size(F.filter(group, lambda h: h <= doc_id))
    return F.when(g > 0, (g - 1) * step + k).otherwise(0), F.coalesce(F.when(g > 0, F.element_at(group, k) == doc_id), F.lit(False))


def with_next(docs: DataFrame) -> DataFrame:
    """part, ghost, doc_id, tie, text, next_text: rows in ranges of doc_id, one shuffle of the texts.

    The first row of each range is also put last in the range before (and the very first in the last) as a ghost, so
    that every row finds its successor in its own range.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = rows.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 20 * parts).alias("b"), F.min("doc_id").alias("least"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    bounds = sorted(set(found["b"] or []))
    part, at_bound = _bucket_of(F.col("doc_id"), bounds)
    first = F.col("doc_id").isNull() if found["nulls"] else F.col("doc_id") == F.lit(found["least"])
    places = F.array(
        F.struct(F.col("part"), F.lit(False).alias("ghost")),
        F.when(F.col("at_bound"), F.struct((F.col("part") - 1).alias("part"), F.lit(True).alias("ghost"))),
        F.when(first, F.struct(F.lit(len(bounds)).alias("part"), F.lit(True).alias("ghost"))),
    )
    rows = rows.withColumn("part", part).withColumn("at_bound", at_bound)
    rows = rows.select("doc_id", "text", F.explode(F.filter(places, lambda p: p.isNotNull())).alias("p"))
    rows = rows.select("p.part", "p.ghost", "doc_id", F.xxhash64("text").alias("tie"), "text")
    order = Window.partitionBy("part").orderBy("ghost", F.col("doc_id").asc_nulls_first(), "tie", "text")
    return rows.select("*", F.lead("text").over(order).alias("next_text"), F.row_number().over(order).alias("pos"))


def edited_text(text: Column, next_text: Column) -> Column:
    """The last floor(n / 2) code points replaced by the first as many (or all) of the next text."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - half), F.substring(next_text, F.lit(1), half))


def units(text: Column) -> Column:
    """array<struct<a, b>>: words with the next word (BREAK at the end of a line, null at that of the text), and lines with LINE."""
    words = F.split(F.replace(text, F.lit("\n"), F.lit(f" {BREAK} ")), " ")
    pairs = F.arrays_zip(words.alias("a"), F.array_append(F.slice(words, F.lit(2), F.size(words)), F.lit(None)).alias("b"))
    lines = F.transform(F.split(text, "\n"), lambda p: F.struct(p.alias("a"), F.lit(LINE).alias("b")))
    return F.concat(pairs, lines)


def _summed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, i0.., e0.., o0..: sums over the units of each text of rows (keys, text); e and o hold two lanes in each."""
    rows = rows.select(*keys, F.posexplode(units(F.col("text"))).alias("word_at", "u")).select(*keys, F.shiftright("word_at", CHUNK_BITS).alias("chunk"), "u.a", "u.b")
    pair = F.coalesce(F.col("b") != LINE, F.lit(True)) & (F.col("a") != BREAK)
    rows = rows.where(pair | (F.col("b") == LINE)).withColumn("is_line", ~pair)
    rows = rows.withColumn("h0", F.xxhash64("a", F.when(F.col("b") != BREAK, F.col("b"))))
    for r in range(1, PAIR_HASHES):
        rows = rows.withColumn(f"h{r}", F.xxhash64(F.lit(r), "h0"))
    out = [F.count_if(~F.col("is_line")).alias("n")]
    for s, seed in enumerate(SEEDS):
        h = F.xxhash64(F.lit(seed), "a")
        for half, x in enumerate((h.bitwiseAND(F.lit(LOW_32)), F.shiftrightunsigned(h, 32))):
            out.append(F.sum(F.when(F.col("is_line"), x).otherwise(0)).alias(f"i{2 * s + half}"))
    for r in range(PAIR_HASHES):
        for j in range(LANE_BITS):
            bits = F.shiftrightunsigned(f"h{r}", j).bitwiseAND(F.lit(ONES))
            out.append(F.sum(F.when(F.col("is_line"), 0).otherwise(bits)).alias(f"c{r * LANE_BITS + j}"))
    chunks = rows.groupBy(*keys, "chunk").agg(*out)
    even, odd = (lambda c: F.col(c).bitwiseAND(F.lit(EVEN))), (lambda c: F.shiftrightunsigned(c, 16).bitwiseAND(F.lit(EVEN)))
    names = [f"c{k}" for k in range(PAIR_HASHES * LANE_BITS)]
    whole = [F.sum(c).alias(c) for c in ("n", *(f"i{k}" for k in range(2 * len(SEEDS))))]
    return chunks.groupBy(*keys).agg(*whole, *[F.sum(even(c)).alias(f"e{k}") for k, c in enumerate(names)], *[F.sum(odd(c)).alias(f"o{k}") for k, c in enumerate(names)])


def fingerprint_columns() -> list[Column]:
    """fingerprint (hex) and lanes (array of centred content lanes) from the sums."""
    packed = [F.col(f"{x}{k}") for k in range(PAIR_HASHES * LANE_BITS) for x in "eo"]
    lanes = [x.bitwiseAND(F.lit(LOW_16)) for c in packed for x in (c, F.shiftrightunsigned(c, 32))]
    n = F.col("n").bitwiseAND(F.lit(LOW_32))
    wide = [F.lpad(F.hex(x), 8, "0") for x in (*(F.col(f"i{j}").bitwiseAND(F.lit(LOW_32)) for j in range(2 * len(SEEDS))), n)]
    content = [F.lpad(F.hex(F.shiftleft(lanes[j], 16).bitwiseOR(lanes[j + 1])), 8, "0") for j in range(0, len(lanes), 2)]
    return [F.lower(F.concat(*wide, *content)).alias("fingerprint"), centred(F.array(*lanes), n).alias("lanes")]


def centred(lanes: Column, n: Column) -> Column:
    """Twice each lane less n, the lane read as the number nearest n / 2 that leaves it modulo 2**16."""
    return F.transform(lanes, lambda m: (2 * (m + F.round((n / 2 - m) / (1 << LANE_BITS)) * (1 << LANE_BITS)) - n).cast("double"))


def decoded_lanes(fingerprint: Column) -> Column:
    """The centred content lanes of a printed fingerprint."""
    head = 16 * len(SEEDS)
    lanes = F.transform(F.sequence(F.lit(0), F.lit(LANES - 1)), lambda j: F.conv(F.substring(fingerprint, head + 9 + 4 * j, F.lit(4)), 16, 10).cast("bigint"))
    return centred(lanes, F.conv(F.substring(fingerprint, head + 1, 8), 16, 10).cast("bigint"))


def likeness(fa: Column, la: Column, fb: Column, lb: Column) -> Column:
    """1 for equal fingerprints, else the cosine of their centred lanes, 0 where negative or undefined."""
    dot = F.aggregate(F.zip_with(la, lb, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(la, F.lit(0.0), lambda s, x: s + x * x) * F.aggregate(lb, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(fa == fb, 1.0).otherwise(F.least(F.greatest(F.coalesce(dot / F.nullif(norm, F.lit(0.0)), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)))


def fingerprint_likeness(a: Column, b: Column) -> Column:
    """Likeness of two printed fingerprints."""
    return likeness(a, decoded_lanes(a), b, decoded_lanes(b))


def fingerprints(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, fingerprint, lanes of every row of docs (key unique, text)."""
    return _summed(docs.select(key, F.coalesce("text", F.lit("")).alias("text")), [key]).select(key, *fingerprint_columns())


def add_paragraphs(fingerprint: Column, other: Column, sign: int = 1) -> Column:
    """The fingerprint with the other's paragraphs inserted (sign 1) or deleted (-1): lane by lane modulo its power."""
    wide = 2 * len(SEEDS) + 1

    def part(x: Column, start: int, size: int) -> Column:
        return F.conv(F.substring(x, start, size), 16, 10).cast("bigint")

    out = []
    for start, size, n in ((1, 8, wide), (1 + 8 * wide, 4, LANES)):
        for j in range(n):
            at = start + size * j
            out.append(F.lpad(F.hex(F.pmod(part(fingerprint, at, size) + sign * part(other, at, size), F.lit(1 << (4 * size)))), size, "0"))
    return F.lower(F.concat(*out))


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of docs."""
    rows = with_next(docs)
    rows = rows.withColumn("edited", F.when(~F.col("ghost"), edited_text(F.col("text"), F.col("next_text"))))
    keys = ["part", "pos", "ghost", "doc_id", "n_chars", "edited_sha256", "which"]
    texts = F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("t")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("t")))
    rows = rows.select("part", "pos", "ghost", "doc_id", F.char_length("text").cast("bigint").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.explode(F.filter(texts, lambda x: x["t"].isNotNull())).alias("x"))
    rows = rows.select("part", "pos", "ghost", "doc_id", "n_chars", "edited_sha256", "x.which", F.col("x.t").alias("text"))
    prints = _summed(rows, keys).select(*keys, *fingerprint_columns())
    order = Window.partitionBy("part").orderBy("pos", "which")
    # In order: text, edited text, next text.
    for name, by in (("edited", 1), ("next", 2)):
        prints = prints.withColumn(f"f_{name}", F.lead("fingerprint", by).over(order)).withColumn(f"l_{name}", F.lead("lanes", by).over(order))
    out = prints.where((F.col("which") == 0) & ~F.col("ghost"))
    near = [likeness(F.col("fingerprint"), F.col("lanes"), F.col(f"f_{x}"), F.col(f"l_{x}")).alias(f"near_{x}") for x in ("edited", "next")]
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", F.col("f_edited").alias("edited_fingerprint"), *near)

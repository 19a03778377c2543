"""Text scalars: counts, language, chunks, quality, identifiers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Frequent words of each language, in order of preference for ties.
STOP_WORDS = {
    "en": ["the", "and", "is", "in", "to", "of", "a", "that", "it", "for", "was", "with", "as", "this", "but", "not", "are", "from"],
    "de": ["der", "die", "und", "das", "ist", "ein", "eine", "für", "mit", "den", "von", "auf", "nicht", "sich", "auch", "ich", "des", "dem"],
    "fr": ["le", "la", "les", "de", "des", "est", "une", "que", "dans", "pour", "pas", "qui", "sur", "avec", "son", "mais", "nous", "cette"],
    "es": ["el", "la", "los", "las", "de", "que", "en", "por", "con", "una", "del", "para", "como", "pero", "más", "ser", "este", "fue"],
}
#: What makes a passage unfit as a quotation.
UNFIT = (r"(?i)(?:EMPLOYMENT|CONTRACT|SALARY|EMPLOYER|INVOICE|LICENSE)", r"\\[a-z]\d", r"(?i)[0-9a-f]{8,}", r"https?://", r"@gmail|@yahoo|@hotmail", r"(?i)(?:Apache|GPL|MIT) License", r"^\s*[0-9\s.,-]+\s*$")


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def words(text: Column, most: int = -1) -> Column:
    """Non-empty pieces between Unicode white space; with `most`, at least the first so many."""
    return F.array_remove(F.split(text, r"(?U)\s+", most + 2 if most >= 0 else -1), "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("bigint")


def language(text: Column) -> Column:
    """en, de, fr or es by the share of frequent words in the first 500; null below 10 words or a share of 0.02."""
    counts = lambda ws: F.struct(F.size(ws).alias("n"), *[F.size(F.filter(ws, _among(v))).alias(k) for k, v in STOP_WORDS.items()])
    return once(once(F.slice(words(F.lower(text), 500), 1, 500), counts), _likeliest)


def _among(known: list[str]) -> Callable[[Column], Column]:
    return lambda w: w.isin(*known)


def _likeliest(c: Column) -> Column:
    top, out = F.greatest(*[c[k] for k in STOP_WORDS]), None
    for k in STOP_WORDS:
        out = F.when(c[k] == top, k) if out is None else out.when(c[k] == top, k)
    return F.when((c["n"] >= 10) & (top / F.greatest(c["n"], F.lit(1)) >= 0.02), out)


def byte_prefix(text: Column, most: int = 50_000) -> Column:
    """The longest prefix of whole characters within `most` bytes."""
    raw = F.substring(F.encode(text, "UTF-8"), 1, most)
    # Up to three bytes of a cut character go; the first valid length wins.
    tries = [F.try_validate_utf8(F.substring(raw, F.lit(1), F.greatest(F.octet_length(raw) - k, F.lit(0))).cast("string")) for k in range(4)]
    return F.when(F.octet_length(text) <= most, text).otherwise(F.coalesce(*tries))


def chunks(text: Column, size: int = 200, stride: int = 170, most: int = 20) -> Column:
    """array<struct<i, text, n>>: overlapping runs of words; a text of one run stays as it is, trimmed."""

    def cut(w: Column) -> Column:
        starts = F.slice(F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0)), F.lit(stride)), 1, most)
        many = F.transform(starts, lambda s, i: F.struct(i.alias("i"), F.array_join(F.slice(w, s + 1, size), " ").alias("text"), F.least(F.size(w) - s, F.lit(size)).alias("n")))
        return F.when(F.size(w) <= size, F.array(F.struct(F.lit(0).alias("i"), F.trim(text).alias("text"), F.size(w).alias("n")))).otherwise(many)

    return once(words(text), cut)


def segment_id(path: Column, kind: Column, key: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the three parts with NUL between."""
    return F.substring(F.sha2(F.concat(path, F.lit("\0"), kind, F.lit("\0"), key).cast("binary"), 256), 1, 16)


def quotable(text: Column) -> Column:
    """Long enough, mostly letters, with at least six words of three characters that hold a letter, and nothing unfit."""
    letters = F.char_length(F.regexp_replace(text, r"[^\p{L}\s]", ""))
    good = F.size(F.filter(words(text), lambda w: (F.char_length(w) >= 3) & w.rlike(r"\p{L}")))
    fit = (F.char_length(text) >= 30) & (letters / F.greatest(F.char_length(text), F.lit(1)) >= 0.75) & (good >= 6)
    for pattern in UNFIT:
        fit = fit & ~text.rlike(pattern)
    return F.coalesce(fit, F.lit(False))

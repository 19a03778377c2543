"""Full-text search: Boolean queries over stems, phrases, prefixes, nearness, BM25; by a scan or by a stored index.

Terms are runs of letters and digits in lower case, without accents, as Porter stems; `stem=False` searches words as they
are written. A stored index (`build_index`) holds one row for each term and text, in files by hash of the term, so that a
query reads its own terms only; `search` needs none and reads every text once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from relatum.functions.text import once
from relatum.sources.catalog import cut

K1, B = 1.2, 0.75


class QuerySyntaxError(ValueError):
    """A query with nothing to search for, or an operator without its side."""


def _measure(stem: str) -> int:
    """Vowel-consonant sequences in a stem."""
    shape = re.sub(r"(.)\1+", r"\1", "".join("v" if _vowel(stem, i) else "c" for i in range(len(stem))))
    return shape.count("vc")


def _vowel(w: str, i: int) -> bool:
    return w[i] in "aeiou" or (w[i] == "y" and i > 0 and not _vowel(w, i - 1))


def _has_vowel(w: str) -> bool:
    return any(_vowel(w, i) for i in range(len(w)))


def _short(w: str) -> bool:
    """Ends consonant, vowel, consonant other than w, x, y."""
    n = len(w)
    return n >= 3 and not _vowel(w, n - 3) and _vowel(w, n - 2) and not _vowel(w, n - 1) and w[-1] not in "wxy"


#: Suffixes of the second and third step and what takes their place, and those of the fourth.
STEP_2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def porter(w: str) -> str:
    """Stem of a lower-case English word (Porter 1980)."""
    if len(w) <= 2:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        cut = next((s for s in ("ed", "ing") if w.endswith(s) and _has_vowel(w[: -len(s)])), None)
        if cut:
            w = w[: -len(cut)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and not _vowel(w, len(w) - 1) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _short(w):
                w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP_2, STEP_3):
        s = max((x for x in table if w.endswith(x)), key=len, default=None)
        if s and _measure(w[: -len(s)]) > 0:
            w = w[: -len(s)] + table[s]
    s = max((x for x in STEP_4 if w.endswith(x)), key=len, default=None)
    if s and _measure(w[: -len(s)]) > 1 and (s != "ion" or w[: -len(s)].endswith(("s", "t"))):
        w = w[: -len(s)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _short(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


@F.pandas_udf(ArrayType(StringType()))
def porter_terms(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Stems of an array of terms."""
    known: dict[str, str] = {}
    for terms in parts:
        yield terms.map(lambda ts: None if ts is None else [known.get(t) or known.setdefault(t, porter(t)) for t in ts])


#: Accented Latin letters and what they are searched as.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćĉċčďēĕėęěĝğġģĥĩīĭįĵķĺļľńņňōŏőŕŗřśŝşšţťũūŭůűųŵŷźżž"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccccdeeeeegggghiiiijklllnnnooorrrssssttuuuuuuwyzzz"


def folded(text: Column) -> Column:
    """In lower case, without accents."""
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def terms(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def stems(text: Column) -> Column:
    """Stems of the terms of a text without accents."""
    return porter_terms(F.array_remove(F.split(folded(text), r"[^\p{L}\p{N}]+"), ""))


@dataclass(frozen=True)
class Phrase:
    """Terms in a row; of one that is a prefix, the last may go on."""

    terms: tuple[str, ...]
    prefix: bool = False


@dataclass(frozen=True)
class Near:
    """Phrases that stand with at most `most` terms between the first and the last."""

    phrases: tuple[Phrase, ...]
    most: int = 10


@dataclass(frozen=True)
class Op:
    """and, or, not (the first without the second)."""

    kind: str
    sides: tuple


Node = Phrase | Near | Op


def leaves(node: Node) -> list[Phrase]:
    """All phrases of a query, those that must not occur among them."""
    if isinstance(node, Phrase):
        return [node]
    return [p for x in (node.phrases if isinstance(node, Near) else node.sides) for p in leaves(x)]


class _Parser:
    """NOT binds before AND, AND before OR; phrases next to each other bind first of all."""

    def __init__(self, text: str, stem: bool):
        self.tokens = re.findall(r'"[^"]*"\s*\*?|NEAR\s*\(|[()]|,\s*\d+|[^\s()",]+', text)
        self.at, self.stem = 0, stem

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def next(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1] if self.at <= len(self.tokens) else ""

    def phrase(self) -> Phrase | None:
        token = self.next()
        prefix = token.endswith("*")
        found = tuple(t for t in re.split(r"[^\w]|_", token.strip('"*').lower()) if t)
        if self.stem:
            fold = str.maketrans(ACCENTED, PLAIN)
            found = tuple(t.translate(fold) if prefix and i == len(found) - 1 else porter(t.translate(fold)) for i, t in enumerate(found))
        return Phrase(found, prefix) if found else None

    def unit(self) -> Node | None:
        token = self.peek()
        if token == "(":
            self.next()
            out = self.expression()
            if self.next() != ")":
                raise QuerySyntaxError("a parenthesis is not closed")
            return out
        if token.startswith("NEAR"):
            self.next()
            phrases, most = [], 10
            while self.peek() not in ("", ")"):
                if self.peek().startswith(","):
                    most = int(self.next()[1:])
                else:
                    phrases.append(self.phrase())
            if self.next() != ")":
                raise QuerySyntaxError("NEAR is not closed")
            phrases = [p for p in phrases if p]
            if not phrases:
                raise QuerySyntaxError("NEAR of nothing")
            return Near(tuple(phrases), most)
        return self.phrase()

    def row(self) -> Node | None:
        """Units next to each other: all of them."""
        out = []
        while self.peek() not in ("", ")", "AND", "OR", "NOT"):
            out.append(self.unit())
        out = [x for x in out if x]
        return None if not out else out[0] if len(out) == 1 else Op("and", tuple(out))

    def chain(self, word: str, below) -> Node:
        out = below()
        while self.peek() == word:
            self.next()
            other = below()
            if out is None or other is None:
                raise QuerySyntaxError(f"{word} without a side")
            out = Op(word.lower(), (out, other))
        return out

    def expression(self) -> Node | None:
        return self.chain("OR", lambda: self.chain("AND", lambda: self.chain("NOT", self.row)))


def parse_query(text: str, stem: bool = False) -> Node:
    """Terms that must all occur, "phrases", prefix*, NEAR(a b, 5), AND, OR, NOT and parentheses."""
    parser = _Parser(text, stem)
    out = parser.expression()
    if parser.peek():
        raise QuerySyntaxError(f"{parser.peek()} is out of place")
    if out is None:
        raise QuerySyntaxError("nothing to search for")
    return out


@dataclass(frozen=True)
class Query:
    """Alternatives, each of required phrases (a phrase of one term is a term)."""

    alternatives: tuple[tuple[tuple[str, ...], ...], ...]


def parse(text: str, stem: bool = False) -> Query:
    """A plain query, of terms, phrases and OR alone; others raise QuerySyntaxError."""
    node = parse_query(text, stem)

    def sides(x: Node, kind: str) -> list[Node]:
        return [z for y in x.sides for z in sides(y, kind)] if isinstance(x, Op) and x.kind == kind else [x]

    out = [sides(x, "and") for x in sides(node, "or")]
    if not all(isinstance(p, Phrase) and not p.prefix for a in out for p in a):
        raise QuerySyntaxError("not a plain query")
    return Query(tuple(tuple(p.terms for p in a) for a in out))


def _places(phrase: Phrase, ts: Column) -> Column:
    """First places (from 0) of a phrase in an array of terms."""
    *body, last = phrase.terms
    n = len(body)

    def here(i: Column) -> Column:
        hit = reduce(lambda x, y: x & y, [F.get(ts, i + k) == t for k, t in enumerate(body)], F.lit(True))
        end = F.get(ts, i + n)
        return hit & F.coalesce(F.startswith(end, F.lit(last)) if phrase.prefix else end == last, F.lit(False))

    return F.filter(F.sequence(F.lit(0), F.size(ts) - 1), here)


def _is(word: str, prefix: bool = False):
    return (lambda t: F.startswith(t, F.lit(word))) if prefix else (lambda t: t == word)


def _counts(phrases: list[Phrase], ts: Column) -> list[Column]:
    """How often each phrase occurs."""
    out = []
    for p in phrases:
        if len(p.terms) == 1:
            word = p.terms[0]
            n = F.size(F.filter(ts, _is(word, p.prefix)))
        else:
            n = F.when(F.size(ts) >= len(p.terms), F.size(_places(p, ts))).otherwise(0)
        out.append(n)
    return out


def _holds(node: Node, count: dict[Phrase, Column], place) -> Column:
    """Whether a row satisfies the query: `count` how often each phrase occurs, `place` where."""
    if isinstance(node, Phrase):
        return count[node] > 0
    if isinstance(node, Op):
        sides = [_holds(x, count, place) for x in node.sides]
        if node.kind == "not":
            return sides[0] & ~sides[1]
        return reduce((lambda x, y: x & y) if node.kind == "and" else (lambda x, y: x | y), sides)
    every = reduce(lambda x, y: x & y, [count[p] > 0 for p in node.phrases])
    if len(node.phrases) == 1:
        return every
    # From some place of a phrase, all others end or begin within reach on one side or the other.
    least = sum(len(p.terms) for p in node.phrases)

    def within(lo: Column, n: int):
        return lambda x: (x >= lo) & (x + n <= lo + least + node.most)

    def fits(lo: Column) -> Column:
        return reduce(lambda x, y: x & y, [F.exists(place(p), within(lo, len(p.terms))) for p in node.phrases])

    return every & F.exists(F.concat(*[place(p) for p in node.phrases]), fits)


def _distinct(node: Node) -> list[Phrase]:
    return list(dict.fromkeys(leaves(node)))


def _ranked(rows: DataFrame, phrases: list[Phrase], limit: int | None) -> DataFrame:
    """rows with n_<i>, size, and the totals `rows`, `mean`, df_<i> to rank."""
    rank = F.lit(0.0)
    for i in range(len(phrases)):
        df, tf = F.col(f"df_{i}"), F.col(f"n_{i}")
        idf = F.greatest(F.ln((F.col("rows") - df + 0.5) / (df + 0.5)), F.lit(1e-6))
        rank = rank - idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("size") / F.col("mean")))
    out = rows.select("path", "source_type", "source_key", rank.alias("rank"))
    return out.orderBy("rank", "path", "source_type", "source_key").limit(limit) if limit else out


def search(fts: DataFrame, query: str, limit: int | None = None, stem: bool = True) -> DataFrame:
    """Rows of fts (path, source_type, source_key, content) that match, with rank: BM25 with its sign turned, best first.

    A pass over the rows gets each row's counts for the few phrases of the query; of stemmed texts they are written down,
    as the totals that BM25 needs come from them too.
    """
    node = parse_query(query, stem)
    phrases = _distinct(node)
    ts = (stems if stem else terms)(F.col("content"))
    names = [f"n_{i}" for i in range(len(phrases))]

    def counts(w: Column) -> Column:
        return F.struct(F.size(w).alias("size"), w.alias("ts"), *[c.alias(n) for c, n in zip(_counts(phrases, w), names, strict=True)])

    def held(r: Column) -> Column:
        count = {p: r[n] for p, n in zip(phrases, names, strict=True)}
        return F.struct(r["size"].alias("size"), *[r[n].alias(n) for n in names], _holds(node, count, lambda p: _places(p, r["ts"])).alias("holds"))

    found = once(F.coalesce(ts, F.array().cast("array<string>")), lambda w: once(counts(w), held))
    counted = fts.select("path", "source_type", "source_key", found.alias("r")).select("path", "source_type", "source_key", "r.*")
    if stem:
        counted = cut(counted)
    total = counted.agg(F.count("*").alias("rows"), F.avg("size").alias("mean"), *[F.count_if(F.col(n) > 0).alias(f"df_{i}") for i, n in enumerate(names)])
    return _ranked(counted.where("holds").crossJoin(F.broadcast(total)), phrases, limit)


#: Files of postings, by hash of the term.
BUCKETS = 64


def build_index(fts: DataFrame, path: str, stem: bool = True, buckets: int = BUCKETS) -> None:
    """Writes postings (bucket, term, row, places, and the row's columns) and totals under path. Repeated rows count each."""
    ts = (stems if stem else terms)(F.col("content"))
    rows = fts.select("path", "source_type", "source_key", F.monotonically_increasing_id().alias("row"), F.coalesce(ts, F.array().cast("array<string>")).alias("ts"))
    rows.write.mode("overwrite").parquet(f"{path}/rows")
    rows = fts.sparkSession.read.parquet(f"{path}/rows").withColumn("size", F.size("ts"))
    each = rows.select("path", "source_type", "source_key", "row", "size", F.posexplode("ts").alias("place", "term"))
    # One row's places of a term fit where the row's text did; a frequent term has a row for each text, in many files.
    postings = each.groupBy("term", "row").agg(F.sort_array(F.collect_list("place")).alias("places"), *[F.first(c).alias(c) for c in ("path", "source_type", "source_key", "size")])
    postings = postings.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    postings.repartition("bucket", F.pmod("row", F.lit(8))).sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    rows.agg(F.count("*").alias("rows"), F.avg("size").alias("mean"), F.lit(stem).alias("stem"), F.lit(buckets).alias("buckets")).write.mode("overwrite").parquet(f"{path}/totals")


def indexed_search(spark: SparkSession, path: str, query: str, limit: int | None = None) -> DataFrame:
    """As search, from a stored index: reads the postings of the query's terms alone (all buckets if one is a prefix)."""
    totals = spark.read.parquet(f"{path}/totals")
    made = totals.first()
    node = parse_query(query, made["stem"])
    phrases = _distinct(node)
    words = sorted({t for p in phrases for t in (p.terms[:-1] if p.prefix else p.terms)})
    begins = sorted({p.terms[-1] for p in phrases if p.prefix})
    wanted = reduce(lambda x, y: x | y, [F.startswith("term", F.lit(b)) for b in begins], F.col("term").isin(words))
    rows = spark.read.parquet(f"{path}/postings")
    if not begins:
        of = spark.createDataFrame([(w,) for w in words], "w string").select(F.pmod(F.xxhash64("w"), F.lit(made["buckets"])).alias("b")).collect()
        rows = rows.where(F.col("bucket").isin(sorted({r["b"] for r in of})))
    # A sparse array of the row's terms that the query names is enough: places keep their distances.
    rows = rows.where(wanted).groupBy("row").agg(F.collect_list(F.struct("term", "places")).alias("hits"), *[F.first(c).alias(c) for c in ("path", "source_type", "source_key", "size")])

    def place(p: Phrase) -> Column:
        def of_term(word: str, last: bool) -> Column:
            hit = (lambda h: F.startswith(h["term"], F.lit(word))) if last and p.prefix else (lambda h: h["term"] == word)
            return F.flatten(F.transform(F.filter("hits", hit), lambda h: h["places"]))

        first, *rest = [of_term(t, k == len(p.terms) - 1) for k, t in enumerate(p.terms)]
        return F.filter(first, lambda i: reduce(lambda x, y: x & y, [F.array_contains(r, i + k + 1) for k, r in enumerate(rest)], F.lit(True)))

    names = [f"n_{i}" for i in range(len(phrases))]
    count = {p: F.col(n) for p, n in zip(phrases, names, strict=True)}
    counted = rows.select("path", "source_type", "source_key", "size", "hits", *[F.size(place(p)).alias(n) for p, n in zip(phrases, names, strict=True)])
    counted = counted.select("path", "source_type", "source_key", "size", *names, _holds(node, count, place).alias("holds"))
    df = counted.agg(*[F.count_if(F.col(n) > 0).alias(f"df_{i}") for i, n in enumerate(names)])
    return _ranked(counted.where("holds").crossJoin(F.broadcast(totals.select("rows", "mean"))).crossJoin(F.broadcast(df)), phrases, limit)

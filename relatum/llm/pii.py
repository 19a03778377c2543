"""Personal data: base patterns, and bootstrapped contextual extraction that finds further identifiers.

Seeds are base entities (email, ip, card, phone) and all but one in HELD of the long hexadecimal keys, by hash. What
stands around a seed gives lexical patterns: one, two or three words before it, one after it, and what touches it on both
sides; those of one word need a mark besides. Other tokens that look like identifiers (a digit or @ in five or more characters) and the keys held back are
instances too. Spark scores the graph of patterns and instances in rounds: a pattern's confidence is the share that the
scores of its distinct instances have of all that it introduces, ordinary words among them, if enough instances are
trusted; an instance's score is one less the chance that all its confident patterns err; seeds stay at one. Identifiers
that a confident pattern introduces are spans of kind `found`. Keys that none introduces stay spans of kind `key`.
All of it is Spark expressions and joins; only spans with their contexts and counts of words go on from the texts.

Ordinary words are counted for patterns of one word; without them, marks of ordinary prose would seem sure.

Defined results: a null text is an empty one without spans; repeated rows keep their rows, and count once in the graph
as equal contexts and instances (the words around count each time); texts of any length are read whole; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relatum.llm.common import checkpointed, staged

#: Kinds in output order. A search may only start where a run starts or the last match ended: elsewhere the same run
#: has failed already, so matches are those of the plain pattern, without its quadratic scans.
LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KEY = r"(?<![A-Za-z0-9])[0-9A-Fa-f]{32,}+(?![A-Za-z0-9])"
TOKEN = r"(?<![A-Za-z0-9._%+@-])(?=[A-Za-z._%+-]*+[0-9@])[A-Za-z0-9._%+@-]{5,}+"
BYTE_OF_IP = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
#: Characters before and after a span that hold its context; of keys, one in so many is held back from the seeds.
CONTEXT = 64
HELD = 4
ROUNDS = 3
MIN_SUPPORT, MIN_CONFIDENCE = 3.0, 0.6
SPAN = "array<struct<kind:string,start:int,end:int,text:string>>"


def placed(kind: str, matches: Column, between: Column) -> Column:
    """Spans in code points of all matches, from the lengths of what stands between them."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(s: Column, x: Column) -> Column:
        begin = s["at"] + F.char_length(x["between"])
        end = begin + F.char_length(x["match"])
        return F.struct(end.alias("at"), F.array_append(s["out"], F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), x["match"].alias("text"))).alias("out"))

    both = F.zip_with(matches, F.slice(between, F.lit(1), F.size(matches)), lambda m, b: F.struct(m.alias("match"), b.alias("between")))
    return F.aggregate(both, start, step, lambda s: s["out"])


def luhn(digits: Column) -> Column:
    """Whether the check sum of a string of digits is a multiple of ten."""
    def worth(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), worth), F.lit(0), lambda s, x: s + x) % 10 == 0


def valid(kind: str, text: Column) -> Column:
    """What a match must satisfy besides its pattern."""
    if kind == "ip":
        return text.rlike(rf"^{BYTE_OF_IP}(?:\.{BYTE_OF_IP}){{3}}$")
    if kind == "card":
        digits = F.regexp_replace(text, "[^0-9]", "")
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(F.regexp_replace(text, "[^0-9]", "")).between(8, 15)
    return F.lit(True)


def with_spans(docs: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Adds array columns s_<kind> of valid spans to docs (text)."""
    for kind, pattern in kinds.items():
        matches, between = F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), F.split("text", pattern, -1)
        sign = {"email": "@", "phone": "+"}.get(kind)
        if sign:
            matches = F.when(F.contains("text", F.lit(sign)), matches)
        docs = docs.withColumn("m", matches)
        if kind == "card":
            docs = docs.withColumn("m", F.when(F.exists("m", lambda x: F.length(x) >= 16), F.col("m")))
        docs = docs.withColumn(f"s_{kind}", F.when(F.size("m") > 0, placed(kind, F.col("m"), between)))
        docs = docs.withColumn(f"s_{kind}", F.coalesce(F.filter(f"s_{kind}", _valid_span(kind)), F.array().cast(SPAN))).drop("m")
    return docs


def _valid_span(kind: str):
    def check(s: Column) -> Column:
        return valid(kind, s["text"])

    return check


def _alike(text: Column) -> Column:
    """In lower case, all digits alike."""
    return F.translate(F.lower(text), "123456789", "000000000")


#: Marks that may tell what follows them; a pattern of one word needs one, or to touch the span, as plain words say nothing.
MARKS = ":=#>|("
#: Ordinary words with a mark before them, or after them, and what stands there; a word with a digit or @ is none, nor one
#: of more characters than WORD. What is captured is looked ahead at, so that each word can be part of two contexts.
WORD = 200
PLAIN = rf"(?!\S*[0@])(?=\S{{1,{WORD}}}(?!\S))"
LEFT = rf"(?<!\S)(?=(\S{{1,{CONTEXT}}}(?:\s+{PLAIN}(?:\S*[=:\"'(<\[|](?=\S*\p{{L}})[^\p{{L}}\s]*|[^\p{{L}}\s]+)|(?<=[{MARKS}])\s+{PLAIN}))\p{{L}})\S+"
RIGHT = rf"(?<!\S)(?={PLAIN}\S*\p{{L}}([^\p{{L}}\s]+\s+\S{{1,{CONTEXT}}}(?!\S)))\S+"


def patterns(text: Column, start: Column, end: Column) -> Column:
    """Lexical patterns of a span: kind of context and the context, those that its surroundings have."""
    lo = F.greatest(start - CONTEXT, F.lit(0))
    before = _alike(F.substring(text, lo + 1, start - lo))
    after = _alike(F.substring(text, end + 1, F.lit(CONTEXT)))
    words = [F.regexp_extract(before, rf"((?:\S+\s+){{{n}}}\S*)$", 1) for n in (1, 2, 3)]
    touch, trail = F.regexp_extract(before, r"(\S*)$", 1), F.regexp_extract(after, r"^([^\p{L}\p{N}\s]*)(?:\s|$)", 1)
    follow = F.regexp_extract(after, r"^([^\p{L}\p{N}\s]+\s+\S+)(?:\s|$)", 1)
    near = [F.regexp_replace(w, r"\s+", " ") for w in words]
    marked = before.rlike(rf"\S$|[{MARKS}]\s+$")
    found = [F.when((n != "") & (marked if k == 1 else F.lit(True)), F.concat(F.lit(f"{k} "), n)) for k, n in enumerate(near, 1)]
    found.append(F.when(follow != "", F.concat(F.lit("r "), F.regexp_replace(follow, r"\s+", " "))))
    found.append(F.when((touch != "") & (trail != ""), F.concat(F.lit("b "), near[0], F.lit(" \u2026 "), trail)))
    return F.array_compact(F.array(*found))


def word_contexts(docs: DataFrame) -> DataFrame:
    """pattern, others: how many ordinary words stand in each context that a pattern of one word may have."""
    text = _alike(F.coalesce("text", F.lit("")))

    def all_of(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: F.concat(F.lit(f"{kind} "), F.regexp_replace(x, r"\s+", " ")))

    each = docs.select(F.explode(F.concat(all_of("1", LEFT), all_of("r", RIGHT))).alias("pattern"))
    return each.groupBy("pattern").agg(F.count("*").alias("others"))


def joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def extracted(docs: DataFrame) -> DataFrame:
    """One row each: doc_id, key, base (spans), more (keys and candidate tokens), with contexts."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = with_spans(rows, BASE | {"key": KEY, "token": TOKEN})
    rows = rows.withColumn("base", F.concat(*[F.col(f"s_{k}") for k in BASE]))

    def apart(spans: str):
        return lambda x: ~F.exists(spans, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))

    rows = rows.withColumn("keys", F.filter("s_key", apart("base")))
    rows = rows.withColumn("taken", F.concat("base", "keys"))
    rows = rows.withColumn("more", F.concat("keys", F.filter("s_token", apart("taken"))))
    placed_all = F.transform(F.concat("base", "more"), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lower(s["text"]).alias("instance"), patterns(F.col("text"), s["start"], s["end"]).alias("patterns")))
    return rows.select("doc_id", F.monotonically_increasing_id().alias("key"), "base", placed_all.alias("spans"))


def confident_patterns(edges: DataFrame, rounds: int = ROUNDS, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, others: DataFrame | None = None) -> DataFrame:
    """pattern, confidence of the patterns trusted after the last round, from edges (pattern, instance, seed).

    `others` (pattern, others) counts what a pattern introduces besides instances.
    """
    edges = edges.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"))
    # A pattern with too few instances is never trusted, whatever their scores.
    enough = edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= min_support)
    if others is not None:
        enough = enough.join(others, "pattern", "left").withColumn("n", F.col("n") + F.coalesce("others", F.lit(0))).drop("others")
    enough = checkpointed(enough)
    edges = checkpointed(edges.join(enough.select("pattern"), "pattern", "left_semi"))
    scored = edges.withColumn("score", F.col("seed").cast("double"))
    good = None
    for r in range(rounds):
        # An instance vouches for a pattern by what other evidence says of it; seeds by themselves.
        support = scored.groupBy("pattern").agg(F.sum("score").alias("support")).join(enough, "pattern")
        good = checkpointed(support.select("pattern", "support", (F.col("support") / F.col("n")).alias("confidence")).where((F.col("support") >= min_support) & (F.col("confidence") >= min_confidence)))
        if r + 1 < rounds:
            trust = edges.join(good, "pattern").groupBy("instance").agg((1 - F.product(1 - F.least("confidence", F.lit(0.99)))).alias("trust"))
            scored = edges.join(trust, "instance", "left").withColumn("score", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("trust", F.lit(0.0))))
    return good.select("pattern", "confidence")


def held_back(kind: Column, instance: Column) -> Column:
    """Whether a span must be found by its context: tokens, and one key in HELD."""
    return (kind == "token") | ((kind == "key") & (F.pmod(F.xxhash64(F.lit("seed"), instance), F.lit(HELD)) == 0))


def discovered(each: DataFrame, others: DataFrame | None = None, held=held_back) -> DataFrame:
    """key, kind, start, end, found (boolean) of the spans that are not seeds, from each (key, kind, start, end, instance, patterns)."""
    edges = each.select(F.explode("patterns").alias("pattern"), "instance", (~held(F.col("kind"), F.col("instance"))).alias("seed"))
    good = confident_patterns(edges, others=others)
    open_ = each.where(held(F.col("kind"), F.col("instance"))).select("key", "kind", "start", "end", F.explode_outer("patterns").alias("pattern"))
    met = open_.join(good, "pattern", "left").groupBy("key", "kind", "start", "end").agg(F.max("confidence").alias("confidence"))
    return met.select("key", "kind", "start", "end", F.col("confidence").isNotNull().alias("found"))


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_more, n_found, personal for every row of docs (doc_id, text)."""
    rows, _ = staged(extracted(docs), "spans")
    each = rows.select("key", F.explode("spans").alias("s")).select("key", "s.*")
    found = discovered(each, word_contexts(docs.select("text"))).where("kind = 'key' or found")
    seeds = each.where((F.col("kind") == "key") & ~held_back(F.col("kind"), F.col("instance"))).select("key", "kind", "start", "end")
    more = seeds.union(found.select("key", F.when(F.col("found"), "found").otherwise(F.col("kind")).alias("kind"), "start", "end"))
    more = more.groupBy("key").agg(F.sort_array(F.collect_list(F.struct(F.when(F.col("kind") == "key", 0).otherwise(1).alias("o"), "start", "end", "kind"))).alias("more"))
    out = rows.join(more, "key", "left").withColumn("more", F.coalesce(F.transform("more", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))), F.array().cast("array<struct<kind:string,start:int,end:int>>")))
    out = out.withColumn("base", F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    counts = [F.size(F.filter("base", _of_kind(k))).cast("bigint").alias(f"n_{k}") for k in BASE]
    extra = [F.size("more").cast("bigint").alias("n_more"), F.size(F.filter("more", _of_kind("found"))).cast("bigint").alias("n_found"), ((F.size("base") > 0) | (F.size("more") > 0)).alias("personal")]
    return out.select("doc_id", *counts, F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.concat("base", "more")).alias("spans"), *extra)


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind

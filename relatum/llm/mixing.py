"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is to be taken target / source_size times on average. The whole part is certain; the rest is
a copy probability. Two documents with fractional probabilities meet, and words' worth of probability moves from one to
the other, in a random direction with odds that keep each one's expectation, until one of them is 0 or 1. What is left
meets the next. Blocks of bounded size reduce to one residual each, and residuals meet in further levels of the tree,
until each source has one, which is rounded at random. So a source's taken words miss its target by one document at most.

Defined results: null or blank text has size 0 and is never taken; a null source is a source, last in order; repeated
rows are documents of their own; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relatum.llm.common import checkpointed

#: Documents that meet in one block of the reduction tree.
BLOCK = 64
#: Words are [^ \t-\r]+.
WORD = r"[^\x20\x09-\x0D]+"
#: Sources up to which the table of targets is broadcast.
BROADCAST_SOURCES = 10_000


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0) -> DataFrame:
    """source, n_docs, source_size, target. Weights repeat over sources by code point, null last.

    A source gets least(most * size, level * weight), with the one level at which all targets add up to all sizes: in
    order of most * size / weight, the sources before the first that stays below its limit are those cut off.
    """
    per = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    k = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (k % len(weights) + 1).cast("int"))
    per = per.withColumn("w", w).withColumn("most", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    per = per.withColumn("level", (F.sum("source_size").over(whole) - before) / rest)
    fits = F.col("level") * F.col("w") <= F.col("most")
    per = per.withColumn("level", F.coalesce(F.min(F.when(fits, F.struct((F.col("most") / F.col("w")).alias("at"), "level"))).over(whole)["level"], F.lit(0.0)))
    return per.select("source", "n_docs", "source_size", F.least("most", F.col("level") * F.col("w")).alias("target"))


def _uniform(*cols: Column) -> Column:
    """A number in (0, 1) that depends on nothing else."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def _meet(state: Column, unit: Column) -> Column:
    """The residual in state meets unit; the one that is settled goes to state.done."""
    pa, pb, wa, wb = state["open"]["p"], unit["p"], state["open"]["w"], unit["w"]
    up = F.least(wa * (1 - pa), wb * pb)
    down = F.least(wa * pa, wb * (1 - pb))
    rises = unit["u"] * (up + down) < down
    moved = F.when(rises, up).otherwise(-down)
    # Which of the two settles is known from which limit was met; its probability is set to 0 or 1 exactly.
    a_settles = F.when(rises, wa * (1 - pa) <= wb * pb).otherwise(wa * pa <= wb * (1 - pb))
    na = F.when(a_settles, F.when(rises, 1.0).otherwise(0.0)).otherwise(pa + moved / wa)
    nb = F.when(a_settles, pb - moved / wb).otherwise(F.when(rises, 0.0).otherwise(1.0))
    fields = ["doc_id", "copies", "w", "u"]

    def unit_of(x: Column, p: Column) -> Column:
        return F.struct(*[x[f].alias(f) for f in fields[:2]], p.alias("p"), *[x[f].alias(f) for f in fields[2:]])

    a, b = unit_of(state["open"], na), unit_of(unit, nb)
    met = F.struct(F.when(a_settles, b).otherwise(a).alias("open"), F.array_append(state["done"], F.when(a_settles, a).otherwise(b)).alias("done"))
    first = F.struct(unit.alias("open"), state["done"].alias("done"))
    return F.when(state["open"].isNull(), first).otherwise(met)


UNIT = "struct<doc_id:bigint,copies:bigint,p:double,w:double,u:double>"


def _level(units: DataFrame, level: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """One level of the tree: settled units, and a residual for each block."""
    units = units.withColumn("block", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "doc_id", "salt"), F.col("blocks"))).otherwise(F.lit(0).cast("bigint")))
    unit = F.struct("doc_id", "copies", "p", "w", _uniform(F.lit(seed + 1), F.lit(level), F.col("doc_id"), F.col("salt")).alias("u"))
    met = units.groupBy("source", "source_size", "target", "blocks", "block").agg(F.sort_array(F.collect_list(F.struct(F.xxhash64(F.lit(seed + 2), F.lit(level), "doc_id", "salt").alias("k"), unit.alias("x")))).alias("xs"))
    start = F.struct(F.lit(None).cast(UNIT).alias("open"), F.array().cast(f"array<{UNIT}>").alias("done"))
    met = met.select("source", "source_size", "target", "blocks", "block", F.aggregate("xs", start, lambda s, x: _meet(s, x["x"])).alias("m"))
    met = checkpointed(met.select("source", "source_size", "target", "blocks", "block", "m.open", "m.done"))
    settled = met.select("source", "source_size", "target", F.explode("done").alias("x"))
    rest = met.select("source", "source_size", "target", F.greatest(F.ceil(F.col("blocks") / BLOCK), F.lit(1)).alias("blocks"), F.col("block").alias("salt"), F.col("blocks").alias("were"), "open.*").drop("u")
    return settled, rest


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0, seed: int = 17) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every row of docs (doc_id, text, source)."""
    sizes = checkpointed(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size")))
    targets = checkpointed(source_targets(sizes, weights, most))
    # At most BROADCAST_SOURCES rows go to every executor; with more, a shuffled join that splits a hot source.
    small = targets.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    per = F.broadcast(targets) if small else targets.hint("merge")
    rows = sizes.join(per.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    rows = rows.withColumn("copies", F.when(F.col("size") > 0, F.floor(rate)).otherwise(0).cast("bigint")).withColumn("p", F.when(F.col("size") > 0, rate - F.floor(rate)).otherwise(0.0))
    keep = ["source", "source_size", "target", "doc_id", "copies", "size"]
    sure = rows.where("p <= 0").select(*keep)
    open_ = rows.where("p > 0").select("source", "source_size", "target", F.ceil(F.col("n_docs") / BLOCK).alias("blocks"), F.lit(0).cast("bigint").alias("salt"), F.col("n_docs").alias("were"), "doc_id", "copies", "p", F.col("size").cast("double").alias("w"))
    done = [sure]
    most_docs = targets.agg(F.max("n_docs")).first()[0] or 0
    level = 0
    while True:
        settled, open_ = _level(open_, level, seed)
        done.append(settled.select("source", "source_size", "target", "x.doc_id", (F.col("x.copies") + F.col("x.p").cast("bigint")).alias("copies"), F.col("x.w").cast("bigint").alias("size")))
        # Every level leaves a unit for each block, so the widest source tells when all have one.
        most_docs = -(-most_docs // BLOCK)
        level += 1
        if most_docs <= 1:
            break
    last = open_.where(F.col("doc_id").isNotNull() | F.col("w").isNotNull())
    draw = _uniform(F.lit(seed + 3), F.col("source"), F.col("doc_id")) < F.col("p")
    done.append(last.select("source", "source_size", "target", "doc_id", (F.col("copies") + draw.cast("bigint")).alias("copies"), F.col("w").cast("bigint").alias("size")))
    out = reduce(DataFrame.unionByName, done)
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))

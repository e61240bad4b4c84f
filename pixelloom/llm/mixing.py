"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only.

Sources get targets by weight, stopped at a multiple of their size. A document's share of its source's target is a
whole number of copies and a fraction. Fractions are rounded in blocks of about BLOCK documents: two documents move mass
(fraction times size) between them, one way or the other at random so that both expectations stay, until one fraction is 0 or 1. The one
document of each block that stays fractional goes to the next level, where blocks of residuals are rounded likewise, up to one a source. The
mass of a source never changes on the way, and its last document is rounded to the nearer side, so what is taken
misses the target by half a document at most.
Blocks are chosen by a hash of doc_id and text, so a source with most of all rows has more blocks, not larger ones.

Defined cases. Null text: size 0, never taken. Null source: a source of its own, after all others. Null doc_id: rounded like any other.
Rows that repeat doc_id, source and text: each is rounded on its own. All sizes 0: all targets 0. Empty table: no rows. Other
columns don't take part. Equal inputs give equal results, however they are partitioned.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
BLOCK = 200
SEED = 20240607
#: Fixed value: a word is a run of characters that aren't ASCII white space.
WORD = r"[^ \t-\r]+"


def words_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """skey, n, source_size, target, capped for every source of rows (skey, source, size)."""
    spark = rows.sparkSession
    sums = rows.groupBy("skey", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    null_last = F.col("source").isNull()
    # numbered by ranges: in each range by a window, across ranges by the ranges' counts
    ranged = C.materialize(sums.repartitionByRange(C.partitions(spark), null_last, "source").withColumn("range", F.spark_partition_id()), "sources")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("range").agg(F.count("*").alias("held")).select("range", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("range").orderBy(null_last, "source")) - 1
    place = (F.col("before") + F.col("nth")) % len(weights)
    weighted = ranged.withColumn("nth", nth).join(F.broadcast(offsets), "range").select("skey", "source_size", "n", F.element_at(F.array(*[F.lit(w) for w in weights]), (place + 1).cast("int")).cast("long").alias("weight"))
    weighted = C.materialize(weighted, "weighted")
    total, all_weights = weighted.agg(F.sum("source_size"), F.sum("weight")).first()
    total, all_weights = total or 0, all_weights or 1
    free, shares, capped = total, all_weights, -1
    wide = lambda c: c.cast("decimal(19,0)")
    while True:  # each round stops more sources at their limit, until none is above
        over = wide(F.col("weight")) * F.lit(Decimal(free)).cast("decimal(19,0)") > wide(most * F.col("source_size")) * F.lit(Decimal(shares)).cast("decimal(19,0)")
        n, used, rest = weighted.agg(F.coalesce(F.sum(over.cast("long")), F.lit(0)), F.coalesce(F.sum(F.when(over, most * F.col("source_size"))), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0))).first()
        if n == capped or not rest:
            break
        free, shares, capped = total - used, rest, n
    target = F.when(over, (most * F.col("source_size")).cast("double")).otherwise((F.col("weight") * F.lit(free)).cast("double") / F.lit(float(shares)))
    return C.materialize(weighted.select("skey", "n", "source_size", target.alias("target")), "targets")


def uniform(*parts: Column) -> Column:
    """A number from [0, 1) that is always the same for the same parts."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *parts), 11) / F.lit(float(2**53))


def fold(items: Column, level: int) -> Column:
    """struct(up, a, m, id, at): places of items (array of struct(id, a, m)) rounded up, and the item that is left, which is at place `at`."""

    def step(s: Column, k: Column) -> Column:
        nxt = F.element_at(items, k + 1)
        pair = F.struct(
            s.up.alias("up"), s.a.alias("ai"), s.m.alias("mi"), s.at.alias("i"), nxt.a.alias("aj"), nxt.m.alias("mj"), k.alias("j"), uniform(F.lit(level), s.id, nxt.id, k).alias("u"), s.id.alias("idi"), nxt.id.alias("idj"),
            F.least(s.a - s.m, nxt.m).alias("d1"), F.least(s.m, nxt.a - nxt.m).alias("d2"),
        )

        def move(p: Column) -> Column:
            to_i = p.u * (p.d1 + p.d2) < p.d2
            j_gone, i_gone = p.d1 == p.mj, p.d2 == p.mi
            keep_i = F.when(to_i, j_gone).otherwise(~i_gone)
            up = F.when(to_i & ~j_gone, F.array(p.i)).when(~to_i & ~i_gone, F.array(p.j)).otherwise(F.array().cast("array<int>"))
            mass = F.when(to_i, F.when(j_gone, p.mi + p.d1).otherwise(p.mj - p.d1)).otherwise(F.when(i_gone, p.mj + p.d2).otherwise(p.mi - p.d2))
            return F.struct(F.concat(p.up, up).alias("up"), F.when(keep_i, p.ai).otherwise(p.aj).alias("a"), mass.alias("m"), F.when(keep_i, p.idi).otherwise(p.idj).alias("id"), F.when(keep_i, p.i).otherwise(p.j).alias("at"))

        return F.element_at(F.transform(F.array(pair), move), 1)

    head = F.element_at(items, 1)
    start = F.struct(F.array().cast("array<int>").alias("up"), head.a.alias("a"), head.m.alias("m"), head.id.alias("id"), F.lit(0).alias("at"))
    rest = F.when(F.size(items) > 1, F.sequence(F.lit(1), F.size(items) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(rest, start, step)


def rounded(level_rows: DataFrame, blocks: int, level: int) -> DataFrame:
    """key, block, items, up: which of each block's items are rounded up; `blocks` is the most that a source has."""
    grouped = level_rows.groupBy("skey", "block").agg(F.sort_array(F.collect_list(F.struct("id", "a", "m", "tag"))).alias("items")).withColumn("left", fold(F.col("items"), level))
    grouped = C.materialize(grouped, f"level{level}")
    one = F.col("left")
    if blocks <= 1:
        decided = grouped.select("skey", "block", "items", F.when(2 * one.m >= one.a, F.concat(one.up, F.array(one.at))).otherwise(one.up).alias("up"))
        return decided
    above = grouped.select("skey", (F.col("block") / BLOCK).cast("long").alias("block"), one.id.alias("id"), one.a.alias("a"), one.m.alias("m"), F.col("block").alias("tag"))
    above = outcomes(rounded(above, -(-blocks // BLOCK), level + 1)).select("skey", F.col("tag").alias("block"), "is_up")
    return grouped.join(above, ["skey", "block"]).select("skey", "block", "items", F.when(F.col("is_up"), F.concat(one.up, F.array(one.at))).otherwise(one.up).alias("up"))


def outcomes(decided: DataFrame) -> DataFrame:
    """A row per item: skey, id, a, tag, is_up."""
    item = decided.select("skey", "up", F.posexplode("items").alias("at", "item"))
    return item.select("skey", "item.id", "item.a", "item.tag", F.array_contains("up", F.col("at")).alias("is_up"))


def sized(docs: DataFrame) -> DataFrame:
    source = F.col("source").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"), F.coalesce(F.concat(F.lit("s"), source), F.lit("n")).alias("skey"), words_of(C.text_of()).alias("size"), F.xxhash64(C.text_of()).alias("text_hash"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """doc_id, size, source_size, target, taken, skey, text_hash for every row, a table."""
    return C.sealed(docs.sparkSession, lambda: mixed_rows(docs, weights, most), "mixed")


def mixed_rows(docs: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    rows = C.materialize(sized(docs), "sizes")
    targets = source_targets(rows, weights, most)
    joined = C.join_group_facts(rows, targets, "skey", "n", rows.count())
    x = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    blocks = F.ceil(F.col("n") / BLOCK)
    block = F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "text_hash"), blocks)
    level_rows = joined.select("skey", block.alias("block"), F.col("doc_id").alias("id"), F.col("size").cast("double").alias("a"), ((x - F.floor(x)) * F.col("size")).alias("m"), F.struct("source_size", "target", F.floor(x).alias("whole"), "text_hash").alias("tag"))
    most_rows = targets.agg(F.max("n")).first()[0] or 0
    found = outcomes(rounded(level_rows, max(1, -(-most_rows // BLOCK)), 0))
    size = F.col("a").cast("long")
    return found.select(F.col("id").alias("doc_id"), size.alias("size"), F.col("tag.source_size"), F.col("tag.target"), (size * (F.col("tag.whole") + F.col("is_up").cast("long"))).alias("taken"), "skey", "tag.text_hash")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """docs with each row as often as the mix takes it."""
    mixed = mix(docs, weights, most)
    key = F.struct(F.col("doc_id").alias("id"), "skey", "text_hash").alias("k")
    copies = C.materialize(mixed.filter("taken > 0").groupBy(key).agg(F.sort_array(F.collect_list((F.col("taken") / F.col("size")).cast("int"))).alias("copies")), "copies")
    C.discard(mixed)
    # whole rows are one column here, so that names can't clash
    own = F.struct(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")).alias("skey"), F.xxhash64(C.text_of()).alias("text_hash"))
    keyed = docs.select(own.alias("k"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("v"))
    nth = F.lit(1)
    if copies.filter(F.size("copies") > 1).limit(1).count():  # rows that repeat id, source and text share a list of copies
        nth = F.row_number().over(Window.partitionBy("k").orderBy(F.xxhash64("v")))
    # copies grow with docs, so both are shuffled at every size
    joined = keyed.withColumn("nth", nth).join(copies.hint("merge"), "k").withColumn("n", F.get("copies", F.col("nth") - 1)).filter("n > 0")
    return joined.select("v", F.explode(F.sequence(F.lit(1), F.col("n")))).select("v.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(C.load(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")

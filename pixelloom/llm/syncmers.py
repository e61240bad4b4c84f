"""Document fingerprints from closed syncmers.

A k-mer of bytes is an anchor if the least of its s-mers, by a hash, is its first or its last one. That depends on the k-mer alone, so an
edit changes anchors only where it is. A fingerprint keeps, for each of BINS classes of anchors, the one with the least hash, and its place. Likeness is the
share of classes with equal anchors; equal anchors whose distance from each other differs from that of most count half.

The neighbour of a document is its successor by doc_id. Documents are dealt by ranges of doc_id with bounds from quantiles; the first document of each
range is dealt to the range before it too, so neighbours meet in one shuffle of the texts and each task streams through its range.

Defined cases. Null text: the empty text; its fingerprint has no anchor, and is like no other but its like (likeness 1). Texts shorter than a k-mer: one anchor, the
whole text. Null doc_id: before all others. Rows that repeat a doc_id: in the order of a hash of the text. One document: it follows itself. Empty
table: no rows. Other columns don't take part.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Bytes of a k-mer and of an s-mer, classes of anchors, bytes to a unit of place, units that a place may differ by.
K, S, BINS, UNIT, SLACK = 16, 8, 64, 16, 64
#: Hexadecimal digits of a class: anchor, place.
ANCHOR_DIGITS, PLACE_DIGITS = 6, 4
MULTIPLIERS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
NO_ID = -(2**63)
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def mixed(x: np.ndarray) -> np.ndarray:
    x = x * MULTIPLIERS[0]
    x ^= x >> np.uint64(32)
    x *= MULTIPLIERS[1]
    x ^= x >> np.uint64(29)
    return x


def syncmers(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the anchors of a text."""
    n = len(data)
    if n < K:
        words = np.frombuffer(data.ljust(K, b"\0"), "<u8")
        return (mixed(words[:1] * MULTIPLIERS[2] + words[1:] + np.uint64(n)), np.zeros(1, np.int64)) if n else (np.zeros(0, "u8"), np.zeros(0, np.int64))
    words = np.ndarray((n - S + 1,), "<u8", data, strides=(1,)).copy()
    h = mixed(words)
    two = np.minimum(h[:-1], h[1:])
    four = np.minimum(two[:-2], two[2:])
    eight = np.minimum(four[:-4], four[4:])
    last = h[K - S :]
    least = np.minimum(eight[: len(last)], last)
    at = np.flatnonzero((h[: len(last)] == least) | (last == least))
    return mixed(words[at] * MULTIPLIERS[2] + h[at + K - S]), at


def sketch(hashes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """BINS rows of (anchor, place), anchor -1 where a class is empty; the first place of the least hash of each class."""
    out = np.full((BINS, 2), -1, np.int64)
    if len(hashes):
        kind = (hashes >> np.uint64(58)).astype(np.int64)
        order = np.lexsort((places, hashes))
        kinds, first = np.unique(kind[order], return_index=True)
        best = order[first]
        out[kinds, 0] = ((hashes[best] >> np.uint64(20)) & np.uint64(16**ANCHOR_DIGITS - 1)).astype(np.int64)
        out[kinds, 1] = places[best] // UNIT % 16**PLACE_DIGITS
    return out


def to_text(table: np.ndarray) -> str:
    empty = "-" * (ANCHOR_DIGITS + PLACE_DIGITS)
    return "".join(f"{a:0{ANCHOR_DIGITS}x}{p:0{PLACE_DIGITS}x}" if a >= 0 else empty for a, p in table.tolist())


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    some = (a[:, 0] >= 0) | (b[:, 0] >= 0)
    if not some.any():
        return 1.0
    same = (a[:, 0] == b[:, 0]) & some
    shift = (a[same, 1] - b[same, 1] + 16**PLACE_DIGITS // 2) % 16**PLACE_DIGITS
    if not len(shift):
        return 0.0
    usual = np.sort(shift)[len(shift) // 2]
    return float(np.where(np.abs(shift - usual) <= SLACK, 1.0, 0.5).sum() / some.sum())


def edited(text: str, following: str) -> str:
    """The last quarter of text, rounded down, replaced by the beginning of the following one."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def place_among(bounds: list[int], key: Column) -> Column:
    """How many of the sorted bounds aren't over key: first among every step-th one, then among the step behind it."""
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    under = lambda array: F.size(F.filter(array, lambda b: b <= key))
    steps = under(F.array(*[F.lit(x).cast("long") for x in bounds[step - 1 :: step]]))
    return step * steps + under(F.slice(F.array(*[F.lit(x).cast("long") for x in bounds]), step * steps + 1, F.lit(step)))


def in_order(docs: DataFrame) -> DataFrame:
    """doc_id, bucket, guest, text: partitions hold ranges of doc_id in order, each with the first row of the next range (of the first one, after the last) as a guest."""
    spark = docs.sparkSession
    parts = C.partitions(spark)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"), C.text_of().alias("text"))
    bounds = sorted({int(x) for x in keyed.select(F.col("key").cast("double").alias("key")).approxQuantile("key", [k / parts for k in range(1, parts)], 0.25 / parts)}) if parts > 1 else []
    bucket = place_among(bounds, F.col("key"))
    firsts = {r["bucket"]: r["first"] for r in keyed.select(bucket.alias("bucket"), "key").groupBy("bucket").agg(F.min("key").alias("first")).collect()}
    used = sorted(firsts)
    before = {b: used[k - 1] for k, b in enumerate(used)}
    first_of = F.array(*[F.lit(firsts.get(b)).cast("long") for b in range(len(bounds) + 1)])
    before_of = F.array(*[F.lit(before.get(b)).cast("int") for b in range(len(bounds) + 1)])
    own = F.struct(F.col("bucket"), F.lit(False).alias("guest"))
    guest = F.struct(F.get(before_of, F.col("bucket")).alias("bucket"), F.lit(True).alias("guest"))
    dealt = keyed.withColumn("bucket", bucket).withColumn("to", F.explode(F.when(F.get(first_of, F.col("bucket")) == F.col("key"), F.array(own, guest)).otherwise(F.array(own))))
    dealt = dealt.select("doc_id", "key", F.xxhash64("text").alias("order"), F.col("to.bucket").alias("bucket"), F.col("to.guest").alias("guest"), "text")
    return dealt.repartitionById(len(bounds) + 1, F.col("bucket").cast("int")).sortWithinPartitions("bucket", "guest", "key", "order").select("doc_id", "bucket", "guest", "text")


def fingerprint_neighbours(docs: DataFrame) -> DataFrame:
    """A row per document: fingerprints of its text and of its edited text, and how like they and the next document's are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            out: list[tuple] = []
            for doc_id, bucket, guest, value in zip(b.column("doc_id").to_pylist(), b.column("bucket").to_pylist(), b.column("guest").to_pylist(), b.column("text"), strict=True):
                text = value.as_py()
                table = sketch(*syncmers(text.encode("utf-8")))
                if held and held[1] == bucket:
                    out.append(result(held, text, table))
                held = None if guest else (doc_id, bucket, text, table)
            columns = list(zip(*out, strict=True)) if out else [[] for _ in range(7)]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def result(held: tuple, following: str, next_table: np.ndarray) -> tuple:
        doc_id, _, text, table = held
        data = edited(text, following).encode("utf-8")
        edited_table = sketch(*syncmers(data))
        return doc_id, len(text), hashlib.sha256(data).hexdigest(), to_text(table), to_text(edited_table), likeness(table, edited_table), likeness(table, next_table)

    return in_order(docs).mapInArrow(run, SCHEMA)


def op9_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_neighbours(C.load(spark, sf_dir, "documents"))

"""Exact deduplication by a tree merge of sorted digest runs.

Every input partition makes one sorted run of (SHA-256, best id, count, bytes) records, cut into
digest ranges. Runs then meet in rounds: in each, FAN neighbouring runs of a range are merged into
one, without sorting again, and equal digests are folded to the id that stays. After ceil(log_FAN(partitions)) rounds there is
one run a range. A digest occurs once in a run, so a group of copies that holds a third of all
rows costs one record a partition, and no task ever sees the group's rows.

"Verified": a digest's records must agree in byte length and in an independent 64-bit hash at
every merge; otherwise the job fails instead of dropping a text that isn't a copy.

Defined cases. Null text: the empty text. Null doc_id: below every other id; a group of only such rows keeps one
of them, with keep_id null. Rows with equal doc_id and text: one stays, the others are dropped. Empty table: no
rows. Other columns, whatever their names, don't take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Runs that are merged into one in a round.
FAN = 4
#: Records a digest range should hold in the end.
RANGE_RECORDS = 200_000
NO_ID = np.iinfo(np.int64).min
#: A digest's bytes compare as the digest does: all have one length.
RUN = np.dtype([("digest", "S32"), ("id", "i8"), ("n", "i8"), ("bytes", "i8"), ("check", "i8")])
RUN_SCHEMA = "bucket int, run long, records binary"


def folded(records: np.ndarray, keep: str) -> np.ndarray:
    """Sorted records with equal digests made one; checks that they belong to equal texts."""
    if not len(records):
        return records
    digest = records["digest"].copy()
    same = np.concatenate([[False], digest[1:] == digest[:-1]])
    if not same.any():
        return records
    if (same[1:] & ((records["bytes"][1:] != records["bytes"][:-1]) | (records["check"][1:] != records["check"][:-1]))).any():
        raise ValueError("texts of different length or check hash share a SHA-256 digest")
    first = np.flatnonzero(~same)
    out = records[first].copy()
    if keep == "max":
        out["id"] = np.maximum.reduceat(records["id"], first)
    else:  # rows without an id stay last
        ids = np.where(records["id"] == NO_ID, np.iinfo(np.int64).max, records["id"])
        least = np.minimum.reduceat(ids, first)
        out["id"] = np.where(least == np.iinfo(np.int64).max, NO_ID, least)
    out["n"] = np.add.reduceat(records["n"], first)
    return out


def sorted_run(records: np.ndarray, keep: str) -> np.ndarray:
    return folded(records[np.argsort(records["digest"], kind="stable")], keep)


def merged(one: np.ndarray, two: np.ndarray, keep: str) -> np.ndarray:
    """Merge of two sorted runs, without sorting again: each record of the second goes behind those of the first that aren't greater."""
    at = np.searchsorted(one["digest"].copy(), two["digest"].copy(), side="right") + np.arange(len(two))
    out, from_one = np.empty(len(one) + len(two), RUN), np.ones(len(one) + len(two), bool)
    from_one[at] = False
    out[at], out[from_one] = two, one
    return folded(out, keep)


def multiway(runs: list[np.ndarray], keep: str) -> np.ndarray:
    """Merge of several sorted runs, as a tournament of pairs."""
    while len(runs) > 1:
        pairs = [merged(a, b, keep) for a, b in zip(runs[::2], runs[1::2], strict=False)]
        runs = pairs + runs[len(runs) & ~1 :]
    return runs[0]


def runs_of(keyed: DataFrame, buckets: int, keep: str) -> DataFrame:
    """One sorted run a partition and digest range."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, held = TaskContext.get().partitionId(), []
        for b in batches:
            if not b.num_rows:
                continue
            r = np.empty(b.num_rows, RUN)
            r["digest"] = np.frombuffer(b"".join(b.column("digest").to_pylist()), "S32")
            r["id"] = b.column("doc_id").fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)
            r["n"] = 1
            r["bytes"] = b.column("n_bytes").to_numpy(zero_copy_only=False)
            r["check"] = b.column("check").to_numpy(zero_copy_only=False)
            held.append(sorted_run(r, keep))
            if len(held) > 16:
                held = [multiway(held, keep)]
        if not held:
            return
        records = multiway(held, keep)
        lead = records["digest"].astype("S8").view(">u8").astype("u8")
        bucket = (lead >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)
        cuts = np.searchsorted(bucket, np.arange(buckets + 1, dtype="u8"))
        rows = [(k, run, records[a:z].tobytes()) for k, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if z > a]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int32()), pa.array([x[1] for x in rows], pa.int64()), pa.array([x[2] for x in rows], pa.binary())], ["bucket", "run", "records"])

    return keyed.mapInArrow(make, RUN_SCHEMA)


def merge_rounds(runs: DataFrame, count: int, keep: str) -> DataFrame:
    """Merge FAN neighbouring runs a round until each range has one."""
    fan = FAN

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        records = multiway([np.frombuffer(x, RUN) for x in group["records"]], keep)
        return pd.DataFrame({"bucket": group["bucket"].iloc[:1], "run": group["run"].iloc[:1] // fan, "records": [records.tobytes()]})

    while count > 1:
        runs = runs.groupBy("bucket", F.floor(F.col("run") / fan).alias("round")).applyInPandas(lambda _, group: merge(group), RUN_SCHEMA)
        count = -(-count // fan)
    return runs


def copied_groups(runs: DataFrame) -> DataFrame:
    """digest, keep_id, group_size of the digests that occur more than once."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column("records").to_pylist():
                r = np.frombuffer(blob, RUN)
                r = r[r["n"] > 1]
                words = r["digest"].tobytes()
                digests = pa.array([words[i : i + 32] for i in range(0, len(words), 32)], pa.binary())
                yield pa.RecordBatch.from_arrays([digests, pa.array(r["id"], mask=r["id"] == NO_ID), pa.array(r["n"])], ["digest", "keep_id", "group_size"])

    return runs.mapInArrow(expand, "digest binary, keep_id long, group_size long")


def exact_dedup(docs: DataFrame, keep: str = "max") -> DataFrame:
    """One row per document, a table: doc_id, keep_id, group_size, kept, text_sha256. keep: which doc_id of equal texts stays, "max" or "min"."""
    return C.sealed(docs.sparkSession, lambda: decided_rows(docs, keep), "decided")


def decided_rows(docs: DataFrame, keep: str) -> DataFrame:
    text = C.text_of()
    keyed = C.materialize(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
        .select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes"), F.xxhash64("text").alias("check")),
        "digests",
    )
    total = keyed.count()
    buckets = max(C.partitions(docs.sparkSession), -(-total // RANGE_RECORDS))
    groups = C.materialize(copied_groups(merge_rounds(runs_of(keyed, buckets, keep), keyed.rdd.getNumPartitions(), keep)), "groups")
    # rows that repeat both id and text become one row with a count, and one of them stays
    rows = keyed.groupBy("digest", "doc_id").agg(F.count("*").alias("copies"))
    rows = C.join_group_facts(C.materialize(rows, "rows"), groups, "digest", "group_size", total)
    lone = F.col("group_size").isNull()
    stays = F.when(lone, F.lit(True)).otherwise(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    each = F.explode(F.when(F.col("copies") == 1, F.array(F.lit(1))).otherwise(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.select("doc_id", F.when(lone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), stays.alias("stays"), F.lower(F.hex("digest")).alias("text_sha256"), each.alias("nth")).select(
        "doc_id", "keep_id", "group_size", (F.col("stays") & (F.col("nth") == 1)).alias("kept"), "text_sha256"
    )


def kept_documents(docs: DataFrame, keep: str = "max") -> DataFrame:
    """The rows of docs that stay, with all their columns; of rows that repeat id and text the first by a hash of all columns."""
    decided = exact_dedup(docs, keep)
    key = F.struct(F.col("doc_id").cast("long").alias("id"), F.col("text_sha256").alias("digest")).alias("k")
    stays = decided.groupBy(key).agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n"))
    gone, copies = (C.materialize(stays.filter(x).select("k"), "keys") for x in ("not kept", "kept and n > 1"))
    C.discard(decided)
    # whole rows are one column here, so that names can't clash
    own = F.struct(F.col("doc_id").cast("long").alias("id"), F.sha2(C.text_of(), 256).alias("digest"))
    keyed = docs.select(own.alias("k"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("v"))
    same = lambda keys: keyed["k"].eqNullSafe(keys["k"])
    gone = gone.hint("merge")  # copies grow with docs, so both are shuffled at every size
    kept = keyed.join(gone, same(gone), "left_anti")
    if not copies.limit(1).count():
        return kept.select("v.*")
    first = kept.join(copies, same(copies), "left_semi").groupBy("k").agg(F.min_by("v", F.xxhash64("v")).alias("v"))
    return kept.join(copies, same(copies), "left_anti").select("v.*").unionByName(first.select("v.*"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(C.load(spark, sf_dir, "documents"), keep="max")


OP6_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY sha256(coalesce(text, ''))) AS keep_id,
       count(*) OVER (PARTITION BY sha256(coalesce(text, ''))) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY sha256(coalesce(text, ''))) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""

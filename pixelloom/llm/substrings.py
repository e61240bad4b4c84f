"""Removal of repeated byte strings of WIDTH bytes or more, by a sparse suffix array that is sorted deep-shallow.

1. Anchors. Of the K-byte strings in every WIDTH-byte window the one with the least hash is an anchor, so equal windows have equal anchors at equal places; about one
   byte in 35 begins an anchor. An occurrence is an anchor with its context, the bytes that windows around it can reach. Occurrences are dealt by the hash of
   their anchor; those with the context of an earlier one are repeats as far as it reaches, and the first of each context goes on if its anchor has other contexts too.
2. Suffixes. The contexts of an anchor are sorted to the right (as suffixes) and to the left (as reversed prefixes): multikey quicksort to a
   shallow depth, blind tries for the groups that are still equal there. Common prefixes of neighbours in both orders tell which windows around an occurrence
   an earlier one has too.
3. Anchors with very many contexts (MANY or more) are dealt again, by the digest of each window, after every task has kept the first of each, so no
   task gets all of such a group.
4. Removal. The repeated windows of a document, from both steps, are joined with its text.

Strings are compared by 64-bit hashes in steps 1 and 3 and by bytes in step 2. Memory: a task holds its share of occurrences (24 bytes each) or one
anchor's contexts (under MANY).

Defined cases. Null or empty text: nothing to remove, the digest of no bytes. Null doc_id: before all others. Rows with equal doc_id and different texts: in the order of a hash of the text. Rows that
repeat doc_id and text are one document, each with its result. Empty table: no rows. Other columns don't take part.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .jaccard import grouped, mixed

WIDTH, K = 100, 32
#: Places in a window where an anchor can begin.
PLACES = WIDTH - K + 1
#: Bytes to which the quicksort goes, bytes it compares at a time.
SHALLOW, CHUNK = 16, 8
#: Contexts of an anchor from which on windows are dealt one by one; contexts up to which pairs are looked at.
MANY, PAIRS = 200, 12
HELD = 250_000
STEP = np.uint64(0x94D049BB133111EB)
OCCURRENCE = np.dtype([("key", "u8"), ("context", "u8"), ("doc", "i8"), ("at", "u4")])
WINDOW = np.dtype([("digest", "u8"), ("doc", "i8"), ("at", "u4")])
REQUEST = np.dtype([("key", "u8"), ("at", "u4"), ("many", "u4")])
ROUTED = "route long, kind int, doc long, at long, left binary, data binary"


def sliding(values: np.ndarray, best: np.ufunc, width: int) -> np.ndarray:
    """The least or largest of each window, by doubling."""
    span = 1
    while 2 * span <= width:
        values, span = best(values[:-span], values[span:]), 2 * span
    return best(values[: len(values) - (width - span)], values[width - span :]) if span < width else values


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors."""
    n = len(data)
    if n < WIDTH:
        return np.zeros(0, np.int64), np.zeros(0, "u8")
    words = mixed(np.ndarray((n - 7,), "<u8", data, strides=(1,)).copy())
    h = words[: n - K + 1].copy()
    for k in range(8, K, 8):
        h = h * STEP + words[k : k + len(h)]
    h = mixed(h)
    # a string is an anchor if it is the least of some window, the one whose least is largest
    edge = np.zeros(PLACES - 1, "u8")
    at = np.flatnonzero(sliding(np.concatenate([edge, sliding(h, np.minimum, PLACES), edge]), np.maximum, PLACES) == h)
    return at, h[at]


def reach_of(n: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of the context of each occurrence in a text of n bytes, and the byte after it."""
    return np.maximum(at - (PLACES - 1), 0), np.minimum(at + WIDTH, n)


def occurrences(doc: int, data: bytes) -> np.ndarray:
    at, keys = anchors(data)
    out = np.empty(len(at), OCCURRENCE)
    out["key"], out["doc"], out["at"] = mixed(keys + STEP), doc, at  # anchors have small hashes, so they are mixed again
    first, after = reach_of(len(data), at)
    digest, view = xxhash.xxh64_intdigest, memoryview(data)
    # contexts that end early are equal only to such that end as early
    out["context"] = [digest(view[a:z], (i - a) << 32 | (z - i)) for i, a, z in zip(at.tolist(), first.tolist(), after.tolist(), strict=True)]
    return out


def first_of(records: np.ndarray, fields: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """records in the order of fields, doc and at, and which of them are the first with their fields."""
    records = records[np.lexsort([records[f] for f in ("at", "doc", *fields[::-1])])]
    new = np.ones(len(records), bool)
    if len(records):
        new[1:] = np.logical_or.reduce([records[f][1:] != records[f][:-1] for f in fields])
    return records, new


def by_bucket(records: np.ndarray, field: str, buckets: int) -> Iterator[tuple[int, bytes]]:
    bucket = (records[field] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype="u8"))
    for k, (a, z) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        if z > a:
            yield k, records[order[a:z]].tobytes()


def by_doc(docs: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Bytes of the rows of values for each document."""
    order = np.argsort(docs, kind="stable")
    docs, values = docs[order], values[order]
    starts = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]])) if len(docs) else np.zeros(0, np.int64)
    for a, z in zip(starts, np.append(starts[1:], len(docs)), strict=False):
        yield int(docs[a]), values[a:z].tobytes()


def whole_contexts(records: np.ndarray) -> np.ndarray:
    """Places of the contexts of records, as (place of the anchor, marker): the bytes are known where the text is."""
    return np.stack([records["at"], np.full(len(records), 2**32 - 1)], axis=1).astype("<u4")


def batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], [x.split()[0] for x in ROUTED.split(", ")])


def marks(docs: DataFrame, buckets: int) -> DataFrame:
    """(doc, kind, data): kind 0, repeats as pairs (begin, end) or (anchor, 2**32 - 1) for a whole context; kind 1, REQUESTs for contexts."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for b in batches:
            for doc, text in zip(b.column("doc").to_pylist(), b.column("text"), strict=True):
                held.append(occurrences(doc, text.as_py().encode("utf-8")))
                size += len(held[-1])
                if size > HELD:
                    yield sent(held)
                    held, size = [], 0
        if size:
            yield sent(held)

    def sent(held: list[np.ndarray]) -> pa.RecordBatch:
        records, new = first_of(np.concatenate(held), ["key", "context"])
        rows = [(k, 2, None, None, None, data) for k, data in by_bucket(records[new], "key", buckets)]
        rows += [(doc % buckets, 0, doc, None, None, data) for doc, data in by_doc(records["doc"][~new], whole_contexts(records[~new]))]
        return batch(rows)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, ["route"]):
            rows, blobs = [], []
            for kind, doc, data in zip(*(t.column(c).to_pylist() for c in ("kind", "doc", "data")), strict=True):
                if kind == 0:
                    rows.append((doc, 0, data))
                else:
                    blobs.append(np.frombuffer(data, OCCURRENCE))
            if blobs:
                records, new = first_of(np.concatenate(blobs), ["key", "context"])
                rows += [(doc, 0, data) for doc, data in by_doc(records["doc"][~new], whole_contexts(records[~new]))]
                records = records[new]
                starts = np.flatnonzero(np.concatenate([[True], records["key"][1:] != records["key"][:-1]]))
                sizes = np.diff(np.append(starts, len(records)))
                many = np.repeat(sizes, sizes)
                chosen = many > 1
                request = np.empty(int(chosen.sum()), REQUEST)
                request["key"], request["at"], request["many"] = records["key"][chosen], records["at"][chosen], many[chosen] >= MANY
                rows += [(doc, 1, data) for doc, data in by_doc(records["doc"][chosen], request)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["doc", "kind", "data"])

    routed = docs.mapInArrow(find, ROUTED).repartitionById(buckets, F.col("route").cast("int")).sortWithinPartitions("route")
    return routed.mapInArrow(meet, "doc long, kind int, data binary")


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def blind_trie(strings: list[bytes], which: list[int]) -> tuple[list[int], list[int]]:
    """The strings in order, and the common prefix of each with the one before it. Nodes know only the depth where their strings part and the byte there; a
    string goes down blindly, is compared once with what it ends at, and is put in where it parts from that."""
    root: list = [which[0]]  # a leaf: a list of equal strings; a node: a tuple (depth, children by byte, -1 for a string that ends)
    for i in which[1:]:
        s, node = strings[i], root
        while isinstance(node, tuple):
            byte = s[node[0]] if node[0] < len(s) else -1
            node = node[1].get(byte) or next(iter(node[1].values()))
        t = strings[node[0]]
        depth = common_prefix(s, t)
        if depth == len(s) == len(t):
            node.append(i)
            continue
        above, node = None, root
        while isinstance(node, tuple) and node[0] < depth:
            byte = s[node[0]] if node[0] < len(s) else -1
            above, node = (node, byte), node[1][byte]
        byte = s[depth] if depth < len(s) else -1
        if isinstance(node, tuple) and node[0] == depth:
            node[1][byte] = [i]
            continue
        new = (depth, {t[depth] if depth < len(t) else -1: node, byte: [i]})
        if above is None:
            root = new
        else:
            above[0][1][above[1]] = new
    order: list[int] = []
    common: list[int] = []
    todo: list = [(0, root)]
    while todo:
        parted, node = todo.pop()
        if isinstance(node, tuple):
            ways = sorted(node[1])
            todo += [(parted if k == 0 else node[0], node[1][b]) for k, b in reversed(list(enumerate(ways)))]
        else:
            order += node
            common += [parted] + [len(strings[node[0]])] * (len(node) - 1)
    return order, common


def deep_shallow(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """Order of the strings, and the common prefix of each with the one before it (0 for the first)."""
    order: list[int] = []
    common: list[int] = []
    todo = [(0, list(range(len(strings))))]
    while todo:  # multikey quicksort, CHUNK bytes being a character
        depth, which = todo.pop()
        if len(which) > 1 and depth < SHALLOW:
            parts = [strings[i][depth : depth + CHUNK] for i in which]
            pivot = parts[len(parts) // 2]
            less = [i for i, p in zip(which, parts, strict=True) if p < pivot]
            same = [i for i, p in zip(which, parts, strict=True) if p == pivot]
            more = [i for i, p in zip(which, parts, strict=True) if p > pivot]
            todo += [(depth, x) for x in (more,) if x]
            todo.append((depth + CHUNK if len(pivot) == CHUNK else SHALLOW, same))
            todo += [(depth, x) for x in (less,) if x]
            continue
        found, shared = blind_trie(strings, which) if len(which) > 1 else (which, [0])
        if order:
            shared[0] = common_prefix(strings[order[-1]], strings[found[0]])
        order += found
        common += shared
    return order, common


def repeats(at: list[int], lefts: list[bytes], rights: list[bytes]) -> list[tuple[int, int, int]]:
    """(occurrence, begin, end) of bytes around the occurrences, given in order, that an earlier one has too, in windows of WIDTH bytes."""
    c = len(at)
    if c == 2:
        left, right = common_prefix(*lefts), common_prefix(*rights)
        return [(1, at[1] - left, at[1] + right)] if left + right >= WIDTH else []
    sorts = [deep_shallow(x) for x in (lefts, rights)]
    if c <= PAIRS:
        pairs = []
        for order, common in sorts:
            shared = [[0] * c for _ in range(c)]
            for x in range(c):
                least = 2**30
                for y in range(x + 1, c):
                    least = min(least, common[y])
                    shared[order[x]][order[y]] = shared[order[y]][order[x]] = least
            pairs.append(shared)
        return [(j, at[j] - left, at[j] + right) for j in range(c) for i in range(j) if (left := pairs[0][i][j]) + (right := pairs[1][i][j]) >= WIDTH]
    kinds = []
    for (order, common), strings, depths in zip(sorts, (lefts, rights), (np.arange(PLACES), WIDTH - np.arange(PLACES)), strict=True):
        kind = np.empty((len(depths), c), np.int64)
        kind[:, order] = np.cumsum(np.array(common)[None, :] < depths[:, None], axis=1)
        short = np.array([len(s) for s in strings])[None, :] < depths[:, None]
        kinds.append((kind, short))
    both, usable = kinds[0][0] * (c + 1) + kinds[1][0], ~(kinds[0][1] | kinds[1][1])
    found = []
    for d in range(PLACES):
        which = np.flatnonzero(usable[d])
        _, first = np.unique(both[d, which], return_index=True)
        later = np.ones(len(which), bool)
        later[first] = False
        found += [(j, at[j] - d, at[j] - d + WIDTH) for j in which[later].tolist()]
    return found


def window_digests(data: bytes, doc: int, at: int) -> np.ndarray:
    """A WINDOW for each window around an occurrence."""
    first, last = max(at - (PLACES - 1), 0), min(at, len(data) - WIDTH)
    out = np.empty(max(last - first + 1, 0), WINDOW)
    digest, view = xxhash.xxh3_64_intdigest, memoryview(data)
    out["digest"] = [digest(view[i : i + WIDTH]) for i in range(first, last + 1)]
    out["doc"], out["at"] = doc, np.arange(first, last + 1)
    return out


def windows_marked(records: np.ndarray) -> np.ndarray:
    return np.stack([records["at"], records["at"] + WIDTH], axis=1).astype("<u4")


def resolved(docs: DataFrame, requests: DataFrame, buckets: int) -> DataFrame:
    """(doc, kind 0, data): the repeats among contexts that are asked for."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for b in batches:
            rows: list[tuple] = []
            for doc, text, blobs in zip(b.column("doc").to_pylist(), b.column("text"), b.column("asked").to_pylist(), strict=True):
                data = text.as_py().encode("utf-8")
                asked = np.frombuffer(b"".join(blobs), REQUEST)
                done = set()
                for key, at, many in asked.tolist():
                    if not many:
                        rows.append((key - 2**64 if key >= 2**63 else key, 1, doc, at, data[max(at - (PLACES - 1), 0) : at][::-1], data[at : at + WIDTH]))
                    elif at not in done:
                        done.add(at)
                        held.append(window_digests(data, doc, at))
                        size += len(held[-1])
                if size > HELD:
                    yield sent(held)
                    held, size = [], 0
            yield batch(rows)
        if size:
            yield sent(held)

    def sent(held: list[np.ndarray]) -> pa.RecordBatch:
        records = np.unique(np.concatenate(held))  # neighbouring anchors have windows in common
        records, new = first_of(records, ["digest"])
        rows = [(k, 2, None, None, None, data) for k, data in by_bucket(records[new], "digest", buckets)]
        rows += [(doc % buckets, 0, doc, None, None, data) for doc, data in by_doc(records["doc"][~new], windows_marked(records[~new]))]
        return batch(rows)

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, ["route", "kind"]):
            kind, rows = t.column("kind")[0].as_py(), []
            docs = t.column("doc").to_pylist()
            if kind == 0:
                rows = list(zip(docs, t.column("data").to_pylist(), strict=True))
            elif kind == 1:
                found = defaultdict(list)
                at = t.column("at").to_pylist()
                for j, a, z in repeats(at, t.column("left").to_pylist(), t.column("data").to_pylist()) if len(at) > 1 else []:
                    found[docs[j]].append((a, z))
                rows = [(doc, np.array(x, "<u4").tobytes()) for doc, x in found.items()]
            else:
                records, new = first_of(np.concatenate([np.frombuffer(x, WINDOW) for x in t.column("data").to_pylist()]), ["digest"])
                rows = list(by_doc(records["doc"][~new], windows_marked(records[~new])))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([0] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["doc", "kind", "data"])

    asked = requests.groupBy("doc").agg(F.collect_list("data").alias("asked"))
    routed = docs.join(asked.hint("merge"), "doc").mapInArrow(expand, ROUTED).repartitionById(buckets, F.pmod("route", F.lit(buckets)).cast("int")).sortWithinPartitions("route", "kind", "doc", "at")
    return routed.mapInArrow(resolve, "doc long, kind int, data binary")


def spans(n: int, data: list[bytes]) -> list[tuple[int, int]]:
    """Maximal runs of removed bytes."""
    pairs = np.frombuffer(b"".join(data), "<u4").reshape(-1, 2).astype(np.int64)
    whole = pairs[:, 1] == 2**32 - 1
    first, after = reach_of(n, pairs[whole, 0])
    far = after - first >= WIDTH
    begin, end = np.concatenate([first[far], pairs[~whole, 0]]), np.concatenate([after[far], pairs[~whole, 1]])
    edges = np.zeros(n + 1, np.int32)
    np.add.at(edges, begin, 1)
    np.add.at(edges, end, -1)
    covered = np.concatenate([[False], np.cumsum(edges)[:-1] > 0, [False]])
    change = np.flatnonzero(covered[1:] != covered[:-1])
    return list(zip(change[::2].tolist(), change[1::2].tolist(), strict=True))


def cleaned(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """docs (doc, text and others) with spans, the list of removed runs, and kept, the other bytes of each text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, removed, count, digest = [], [], [], []
            for text, data in zip(b.column("text"), b.column("data").to_pylist(), strict=True):
                whole = text.as_py().encode("utf-8")
                runs = spans(len(whole), data) if data else []
                kept, at = hashlib.sha256(), 0
                for a, z in runs:
                    kept.update(whole[at:a])
                    at = z
                kept.update(whole[at:])
                n.append(len(whole))
                removed.append(sum(z - a for a, z in runs))
                count.append(runs)
                digest.append(kept.hexdigest())
            run = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array([len(c) for c in count], pa.int64()), pa.array(digest, pa.string()), pa.array([[{"begin": a, "end": z} for a, z in c] for c in count], run)],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
            )

    data = repeated.groupBy("doc").agg(F.collect_list("data").alias("data"))
    return docs.join(data.hint("merge"), "doc", "left").select("doc_id", "text", "data").mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<begin: long, end: long>>")


def ordered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc (place or id in the order of documents), doc_id, text; and doc, text with each doc once, so that a row isn't a repeat of its own copy."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.text_of().alias("text"))
    ids = rows.select("doc_id")
    n, known, least = ids.agg(F.count("*"), F.count("doc_id"), F.min("doc_id")).first()
    if n == known and (least or 0) >= 0 and not ids.groupBy("doc_id").count().filter("count > 1").limit(1).count():
        rows = rows.select(F.col("doc_id").alias("doc"), "doc_id", "text")
        return rows, rows.select("doc", "text")
    keyed = rows.withColumn("__order", F.xxhash64("text"))
    places = C.numbered(keyed.select("doc_id", "__order").distinct(), ["doc_id", "__order"], "order").select(F.col("doc_id").alias("__id"), F.col("__order").alias("__o"), F.col("number").alias("doc"))
    placed = keyed.join(places, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__order") == F.col("__o"))).select("doc", "doc_id", "text")
    return placed, placed.select("doc", "text").dropDuplicates(["doc"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans of every document, a table."""
    return C.sealed(docs.sparkSession, lambda: removed_repeats(docs), "removed")


def removed_repeats(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    rows, texts = ordered(docs)
    buckets = C.partitions(spark)
    found = C.materialize(marks(texts, buckets), "marks")
    C.release(spark)
    more = C.materialize(resolved(texts, found.filter("kind = 1").select("doc", "data"), buckets), "repeats")
    C.release(spark)
    return cleaned(rows, found.filter("kind = 0").select("doc", "data").unionByName(more.select("doc", "data")))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(C.load(spark, sf_dir, "documents"))

"""Best-fit packing of token sequences by linear grouping.

Documents become pieces of at most `capacity` tokens. What the plan needs to know of the corpus is how many pieces
have each length: at most `capacity` numbers, whatever the corpus holds. On that histogram the driver
  1. cuts the large pieces, longest first, into GROUPS groups of equal cardinality and rounds each
     up to the longest of its group;
  2. solves the configuration problem over those few sizes by column generation and takes the whole part;
  3. substitutes the actual lengths for the rounded ones, which leaves each sequence its true slack;
  4. puts the rest and the small pieces into the tightest slack that holds them, longest first.
The plan is a list of runs of alike sequences, a few thousand whatever the corpus holds. Pieces get a rank among
those of their length by counts for each (length, salt) and a window inside it, so a length that a third of all pieces
share is numbered by many tasks; rank and length then give the place by binary search in the plan.

Defined cases. Null or empty text: only the end id, a piece of one token. Null doc_id: packed, with doc_id null. Rows that
repeat a doc_id are packed as often as they occur. Empty table: no pieces. Other columns don't take part.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

CAPACITY = 4096
#: The id that ends a document.
END_ID = 1
#: Numbers of groups to plan with; the plan with the fewest sequences is taken. Few groups suit corpora with many small pieces, which fill what rounding leaves.
GROUPS = (16, 48)
#: How often emptier sequences are planned again, and the part of a sequence that a full one may leave.
PLANS, FULL = 6, 400
#: A piece is large if fewer than this many of its length fit a sequence.
FEW = 8
#: Distinct words whose ids a worker remembers.
REMEMBERED = 450_000
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


LETTERS = "a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
#: A text without any of these characters is cut into words here; all others are stable under NFC and lower-cased alone.
UNUSUAL = re.compile("[^\\t\\n\\r\\x20-\\x7e\u00c0-\u012f\u0131-\u024f]")
#: Fixed value: the vocabulary's own split of a text into words.
WORD = re.compile(f"[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\\s{LETTERS}0-9]+")
ONLY_LETTERS = re.compile(f"[{LETTERS}]+")


class WordIds:
    """A tokenizer with a memory of words' ids, as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True

    def learn(self, words: list[str]) -> None:
        """Words of letters are encoded in one string and told apart by the tokens that end a word."""
        plain = [w for w in words if ONLY_LETTERS.fullmatch(w)]
        ids = np.array(self.tokenizer.encode(" ".join(plain), add_special_tokens=False).ids, "<u4")
        cuts = 4 * (np.flatnonzero(self.ends[ids]) + 1) if len(ids) else np.zeros(0, np.int64)
        if len(cuts) == len(plain):
            data, cuts = ids.tobytes(), cuts.tolist()
            self.known.update(zip(plain, [data[a:z] for a, z in zip([0, *cuts], cuts, strict=False)], strict=True))
        for w in words:
            if w not in self.known:
                self.known[w] = np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        if UNUSUAL.search(text) or "<|" in text:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        spaced = text.lower().split()
        found = list(map(self.known.get, spaced))
        if None in found:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            missing = {w for w, x in zip(spaced, found, strict=True) if x is None}
            parts = {w: WORD.findall(w) for w in missing}
            self.learn(list({x for p in parts.values() for x in p if x not in self.known}))
            for w, p in parts.items():
                if w not in self.known:
                    self.known[w] = b"".join([self.known[x] for x in p])
            found = [x if x is not None else self.known.get(w) for w, x in zip(spaced, found, strict=True)]
        return b"".join(found)


LOADED: dict[str, WordIds] = {}


def token_ids(path: str, text: str) -> bytes:
    """The text's ids as little-endian unsigned 32-bit integers."""
    if path not in LOADED:
        LOADED[path] = WordIds(path)
    return LOADED[path].ids(text)


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of the pieces of every text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([END_ID], "<u4").tobytes()
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                ids = token_ids(tokenizer, text.as_py()) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for column, value in zip(out, (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.text_of().alias("text")).mapInArrow(cut, PIECE_SCHEMA)


def best_configuration(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes of the highest value that fits: a table over capacities that takes one more of a size while that helps anywhere."""
    best, steps = np.zeros(capacity + 1), []
    for i in np.argsort(-values / sizes):
        s, v = int(sizes[i]), values[i]
        if v <= 0:
            break
        for _ in range(capacity // s):
            with_it = best[: capacity + 1 - s] + v
            better = with_it > best[s:] + 1e-12
            if not better.any():
                break
            best = np.concatenate([best[:s], np.where(better, with_it, best[s:])])
            steps.append((i, s, better))
    counts, at = np.zeros(len(sizes), np.int64), int(np.argmax(best))
    value = float(best[at])
    for i, s, better in reversed(steps):
        if at >= s and better[at - s]:
            counts[i] += 1
            at -= s
    return value, counts


def configurations(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = 2000) -> list[tuple[np.ndarray, int]]:
    """Configurations and how often each is used, by column generation; whole parts only, so sizes may be left over."""
    n = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    for _ in range(rounds):
        duals = np.linalg.solve(basis.T, np.ones(n))
        value, config = best_configuration(sizes, duals, capacity)
        if value <= 1 + 1e-7:
            break
        direction, amounts = np.linalg.solve(basis, config.astype(float)), np.linalg.solve(basis, counts.astype(float))
        ratios = np.where(direction > 1e-9, np.maximum(amounts, 0) / np.where(direction > 1e-9, direction, 1), np.inf)
        basis[:, int(np.argmin(ratios))] = config
    amounts = np.linalg.solve(basis, counts.astype(float))
    return [(basis[:, k].round().astype(np.int64), int(amounts[k] + 1e-6)) for k in range(n) if amounts[k] >= 1 - 1e-6]


class Runs:
    """Runs of alike sequences: how many, their slack, and how many pieces of which length each holds."""

    def __init__(self, capacity: int):
        self.capacity, self.slacks, self.by_slack = capacity, [], defaultdict(list)

    def add(self, count: int, slack: int, items: tuple) -> None:
        if count:
            if not self.by_slack[slack]:
                bisect.insort(self.slacks, slack)
            self.by_slack[slack].append((count, items))

    def place(self, length: int, count: int) -> None:
        """Best fit for count pieces of a length: a sequence takes as many as fit before the next tightest one is tried."""
        while count:
            at = bisect.bisect_left(self.slacks, length)
            slack = self.slacks[at] if at < len(self.slacks) else self.capacity
            if at < len(self.slacks):
                n, items = self.by_slack[slack].pop()
                if not self.by_slack[slack]:
                    self.slacks.pop(at)
            else:
                n, items = -(-count // (slack // length)), ()
            each = slack // length
            full = min(n, count // each)
            self.add(full, slack - each * length, (*items, (length, each)))
            count -= full * each
            left = n - full
            if count and left:
                self.add(1, slack - count * length, (*items, (length, count)))
                left, count = left - 1, 0
            self.add(left, slack, items)

    def all(self) -> list[tuple[int, tuple]]:
        return [r for s in self.slacks for r in self.by_slack[s]]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: tuple[int, ...] = GROUPS, few: int = FEW) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, pieces a sequence, offset), sorted; sequences are numbered from 0."""
    plans = [f(histogram, capacity, g, few) for f in (packed_runs, replanned_runs) for g in groups]
    runs = min(plans, key=lambda runs: sum(n for n, _ in runs))
    out, base, used = [], 0, defaultdict(int)
    for n, items in runs:
        offset = 0
        for x, k in items:
            out.append((x, used[x], n * k, base, k, offset))
            used[x] += n * k
            offset += x * k
        base += n
    return sorted(out)


def replanned_runs(histogram: dict[int, int], capacity: int, groups: int, few: int) -> list[tuple[int, tuple]]:
    """packed_runs of all pieces, then again of those in sequences that it leaves too empty, as long as that fills more of them; the rest by best fit."""
    kept, left = [], dict(histogram)
    for _ in range(PLANS):
        found, rest = packed_runs(left, capacity, groups, few), defaultdict(int)
        for n, items in found:
            if sum(x * k for x, k in items) >= capacity - capacity // FULL:
                kept.append((n, items))
            else:
                for x, k in items:
                    rest[x] += n * k
        if sum(rest.values()) == sum(left.values()):
            break
        left = rest
    runs = Runs(capacity)
    for x in sorted(left, reverse=True):
        runs.place(x, left[x])
    return kept + runs.all()


def packed_runs(histogram: dict[int, int], capacity: int, groups: int, few: int) -> list[tuple[int, tuple]]:
    """Runs of alike sequences: how many, and (length, pieces) of each."""
    left = {length: n for length, n in histogram.items() if n}
    runs = Runs(capacity)
    large = sorted((x for x in left if x * few > capacity and x < capacity), reverse=True)
    total = sum(left[x] for x in large)
    if total >= 4 * groups:
        cut, sizes, members, at = total / groups, [], [], 0
        for x in large:  # a length's pieces may belong to several groups
            n = left[x]
            while n:
                if at >= len(sizes) * cut - 1e-9:
                    sizes.append(x)
                    members.append([])
                take = min(n, max(1, int(np.ceil(len(sizes) * cut - at - 1e-9))))
                members[-1].append([x, take])
                at, n = at + take, n - take
        merged: dict[int, list] = {}
        for s, m in zip(sizes, members, strict=True):
            merged.setdefault(s, []).extend(m)
        size = np.array(list(merged))
        held = list(merged.values())
        for config, uses in configurations(size, np.array([sum(n for _, n in m) for m in held]), capacity):
            while uses:  # as many sequences at a time as take the same actual lengths
                picks, n = [], uses
                for k in np.flatnonzero(config):
                    need = int(config[k])
                    if held[k] and held[k][0][1] >= need:
                        picks.append((k, need))
                        n = min(n, held[k][0][1] // need)
                    else:  # the slots of one sequence take several lengths
                        picks.append((k, need))
                        n = 1
                items: list[tuple[int, int]] = []
                for k, need in picks:
                    want = need * n
                    while want and held[k]:
                        x, have = held[k][0]
                        take = min(have, want)
                        items.append((x, take // n if n > 1 else take))
                        left[x] -= take
                        want -= take
                        held[k][0][1] -= take
                        if not held[k][0][1]:
                            held[k].pop(0)
                runs.add(n, capacity - sum(x * k for x, k in items), tuple(items))
                uses -= n
    for x in sorted(left, reverse=True):
        runs.place(x, left[x])
    return runs.all()


def ranked(pieces: DataFrame, salts: int) -> DataFrame:
    """pieces with rank, from 0 among those of the same length."""
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(salts)).cast("int"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    return salted.withColumn("nth", F.row_number().over(inside)).join(offsets, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("nth") - 1).drop("salt", "nth", "before")


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (a table, read twice) with sequence_id and offset."""
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = np.array(plan(histogram, capacity) or [(0, 0, 0, 0, 1, 0)], np.int64)
    keys = (table[:, 0] << 44) | table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            row = table[np.searchsorted(keys, (length << 44) | rank, side="right") - 1]
            nth = rank - row[:, 1]
            columns = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(row[:, 3] + nth // row[:, 4]), pa.array(row[:, 5] + nth % row[:, 4] * length)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked(pieces, C.partitions(pieces.sparkSession)).mapInArrow(place, PIECE_SCHEMA + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    return pack_pieces(C.materialize(pieces_of(docs, tokenizer, capacity), "pieces"), capacity)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(C.load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))

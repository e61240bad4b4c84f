"""Exact Jaccard join of documents' sets of word shingles, as connected components of the links.

1 - Jaccard similarity is a metric, but two texts that aren't copies have distance 1 or close to it, so Voronoi regions of
sampled pivots would all reach the whole corpus. Documents therefore meet first at parts of their sets, and regions, pivots and windows
do their work inside those groups:

1. Meeting. Sets that link differ in few elements, D at most for their size. The universe of shingles is cut by a hash into more than D parts, so
   one part at least holds the same elements of both sets. Every document sends a hash of each part to the part's group. (Parts without
   elements say nothing: a document with too few others sends also its prefix, the elements with the least hashes, one of which
   linked sets share.) No link is lost, and a passage that many documents share brings only those together whose part lies in the passage.
2. Pivots. The first document of a group is its pivot. Distances of members to pivots that a bound from profiles of the sets
   doesn't rule out are computed from the whole sets; members in reach of a pivot are linked to it, and groups whose members are by then in one component are done.
3. Regions and windows. The other groups are regions that are joined on their own. By the triangle inequality a member of the pivot's component that is nearer to the pivot
   than all members of others, by more than the reach, links with none of them and is left out. Large regions are divided again and again: into Voronoi regions of several
   pivots, which members near a border visit too, or, where members are as far from all pivots, by signatures under another hash (divided()). In small
   regions profiles, another pivot and its windows choose the pairs that are compared.

Defined cases. Null or empty text, or one of only white space: the empty set, linked with nothing. Fewer words than a shingle: one shingle, the whole sequence. Null doc_id: joined
like any other; a component's id is its least doc_id that isn't null. Rows that repeat a doc_id or a text: a result row each. Empty table: no rows. Other columns don't take part.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Growth of the size classes, members of a region that is joined in one task.
RATIO, BLOCK = 1.5, 1000
#: Pivots of a region that is divided, copies of its members that this may make, rounds of division, rows that a copy of a pivot serves.
PIVOTS, MOST_COPIES, ROUNDS, SHARE = 8, 3, 6, 2000
#: Blocks that a region is dealt in at most, unless nothing else has made it smaller.
MANY_BLOCKS = 100
#: Sides of a region's members.
HOME, VISITOR, LEFT, RIGHT = 0, 1, 10, 20
#: A profile is the elements' number in each of COUNTS classes, then its parity in each of many finer ones: a power of 2 that grows with the set between these bounds.
COUNTS, PARITIES = 256, (2048, 65536)
#: Signatures that a task holds at most before it sends them.
HELD = 1_000_000
LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))
SIGN_SCHEMA = "doc_id long, node long, rep long, n long, row long, digest binary, profile binary, bucket int, keys binary"


def mixed(x: np.ndarray) -> np.ndarray:
    x = x * ODD[0]
    x ^= x >> np.uint64(32)
    x *= ODD[1]
    x ^= x >> np.uint64(29)
    return x


def shingles(text: str, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles."""
    parts = text.encode("utf-8").translate(LOWER).split()
    if not parts:
        return np.zeros(0, "u8")
    h = np.array([xxhash.xxh64_intdigest(w) for w in parts], "u8")
    if len(h) < words:
        total = np.array([len(h)], "u8")
        for x in h:
            total = mixed(total + x)
        return total
    n = len(h) - words + 1
    total = mixed(h[:n])
    for k in range(1, words):
        total = mixed(total + h[k : k + n])
    return np.unique(total)


@dataclass(frozen=True)
class Reach:
    """Sets link if den * intersection >= num * union; words of a shingle."""

    num: int = 85
    den: int = 100
    words: int = 4

    def differ(self, n: int) -> int:
        """Elements in which two linked sets can differ, the smaller one having n."""
        return (self.den - self.num) * n // self.num

    def least_partner(self, n: int) -> int:
        return -(-self.num * n // self.den)

    def prefix(self, n: int) -> int:
        return n - self.least_partner(n) + 1

    def links(self, common: int, union: int) -> bool:
        return union > 0 and self.den * common >= self.num * union

    def radius(self) -> float:
        return 1 - self.num / self.den

    def classes(self, n: int) -> tuple[int, int]:
        """First size of the class of n and of the next one; (n, n + 1) where only equal sets link."""
        low = -(-self.num // (self.den - self.num))
        if n < low:
            return n, n + 1
        while n >= (high := int(low * RATIO) + 1):
            low = high
        return low, high

    def parts(self, high: int) -> int:
        d = self.differ(high - 1)
        return 1 if not d else math.ceil(1.02 * (d + 1) + 3 * math.sqrt(0.006 * (d + 1)) + 1)


def signatures(h: np.ndarray, reach: Reach) -> np.ndarray:
    """Hashes of the parts at which the set meets others."""
    n = len(h)
    low, high = reach.classes(n)
    tables = [(low, high)]
    if reach.least_partner(n) < low:
        tables.append(reach.classes(low - 1))
    out, full = [], mixed(h ^ ODD[2])
    safe = True
    for first, after in tables:
        m = reach.parts(after)
        if m == 1:
            out.append(mixed(np.array([full.sum()], "u8") + np.uint64(first)))
            continue
        part = ((mixed(h + np.uint64(first)) >> np.uint64(33)) % np.uint64(m)).astype(np.uint16 if m < 65536 else np.int64)
        order = np.argsort(part, kind="stable")
        starts = np.flatnonzero(np.diff(part[order], prepend=-1) if part.dtype != np.uint16 else np.concatenate([[True], part[order][1:] != part[order][:-1]]))
        safe = safe and len(starts) > reach.differ(min(n, after - 1))
        sums = np.add.reduceat(full[order], starts)
        out.append(mixed(sums + part[order][starts].astype("u8") * ODD[3] + np.uint64(first * int(ODD[2]) % 2**64)))
    if not safe:
        out.append(mixed(np.sort(full)[: reach.prefix(n)] ^ ODD[1]))
    return np.concatenate(out)


def signed(docs: DataFrame, reach: Reach, buckets: int) -> DataFrame:
    """Rows of two kinds. With rep: a document, its node, the first node of its partition with the same set, and for such nodes the profile. With keys: a partition's
    signatures of a bucket, as pairs (key, place of the node), node holding the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, place, seen, keys, owners, held = TaskContext.get().partitionId() << 32, 0, {}, [], [], 0
        for b in batches:
            rows: list[tuple] = []
            for doc_id, row, text in zip(b.column("doc_id").to_pylist(), b.column("row").to_pylist(), b.column("text"), strict=True):
                h = shingles(text.as_py(), reach.words)
                node, rep, digest, profile = base + place, base + place, None, None
                if len(h):
                    known = digest_of(h)
                    rep = seen.setdefault(known, node)
                    if rep == node:
                        digest = known
                        profile = profile_of(h)
                        keys.append(signatures(h, reach))
                        owners.append((place, len(keys[-1])))
                        held += len(keys[-1])
                rows.append((doc_id, node, rep, len(h), row, digest, profile))
                place += 1
            yield batch(rows, [])
            if held > HELD:
                yield batch([], sent(keys, owners, base))
                keys, owners, held = [], [], 0
        if held:
            yield batch([], sent(keys, owners, base))

    def sent(keys: list, owners: list, base: int) -> list[tuple]:
        key = np.concatenate(keys)
        owner = np.repeat(np.array([o for o, _ in owners], "<u4"), [n for _, n in owners])
        bucket = ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        pairs = np.empty((len(key), 2), "<u4")
        pairs[:, 0], pairs[:, 1] = (key & np.uint64(2**32 - 1))[order], owner[order]
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        return [(base, k, pairs[a:z].tobytes()) for k, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if z > a]

    def batch(docs: list[tuple], sent: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary())
        rows = [(*r, None, None) for r in docs] + [(None, r[0], None, None, None, None, None, r[1], r[2]) for r in sent]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], [x.split()[0] for x in SIGN_SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row"), C.text_of().alias("text")).mapInArrow(run, SIGN_SCHEMA)


def row_key() -> Column:
    """Finds a document's row again; what is found is checked by the set's digest."""
    return F.xxhash64(F.col("doc_id").cast("long"), C.text_of())


def profile_of(h: np.ndarray) -> bytes:
    """Elements of the set by class, 255 at most, and their parities by finer class; the sets differ at least as much as either part."""
    counts = np.minimum(np.bincount((h >> np.uint64(56)).astype(np.int64), minlength=COUNTS), 255).astype("u1")
    classes = PARITIES[0]
    while classes < min(4 * len(h), PARITIES[1]):
        classes *= 2
    odd = np.bincount(((h >> np.uint64(36)) % np.uint64(classes)).astype(np.int64), minlength=classes) & 1
    return counts.tobytes() + np.packbits(odd.astype(bool)).tobytes()


@dataclass
class Profiles:
    counts: np.ndarray
    odd: np.ndarray

    @staticmethod
    def of(rows: list[bytes], size: int | None = None) -> Profiles:
        """Profiles of one size; in larger ones pairs of classes are added up, which keeps them parities."""
        size, parts = size or min(map(len, rows)), []
        for r in rows:
            odd = np.frombuffer(r, "u1", offset=COUNTS)
            while COUNTS + len(odd) > size:
                odd = odd[: len(odd) // 2] ^ odd[len(odd) // 2 :]
            parts.append(odd)
        counts = np.stack([np.frombuffer(r, "u1", COUNTS) for r in rows]).astype(np.int16)
        return Profiles(counts, np.stack(parts).view("u8"))

    def differ(self, i, other: Profiles, j) -> np.ndarray:
        """Elements in which sets differ, at least: a bound from each part."""
        by_parity = np.bitwise_count(self.odd[i] ^ other.odd[j]).sum(axis=1, dtype=np.int64)
        return np.maximum(by_parity, np.abs(self.counts[i] - other.counts[j]).sum(axis=1, dtype=np.int64))


def digest_of(h: np.ndarray) -> bytes:
    return hashlib.blake2b(h.tobytes(), digest_size=16).digest()


def met(sent: DataFrame) -> DataFrame:
    """Of the nodes that meet others: (grp, node) in groups of three or more, (a, node) in groups of two, where a is the lesser one, and (degree, node), with how
    many others the node meets, counted once for each key. Groups with the same members count once a bucket."""

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        pairs = [np.frombuffer(x, "<u4").reshape(-1, 2) for x in rows["keys"]]
        key = np.concatenate([p[:, 0] for p in pairs])
        node = np.concatenate([p[:, 1].astype(np.int64) + base for p, base in zip(pairs, rows["node"], strict=True)])
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(starts, len(key)))
        twos, many = starts[sizes == 2], sizes > 2
        two = np.unique(np.stack([node[twos], node[twos + 1]], axis=1), axis=0)
        starts, sizes = starts[many], sizes[many]
        edges = np.cumsum(sizes) - sizes
        members = node[np.repeat(starts - edges, sizes) + np.arange(sizes.sum())]
        if len(members):
            # a group is known by its members: two hashes of sums
            same = mixed(np.add.reduceat(mixed(members.astype("u8")), edges)) ^ mixed(np.add.reduceat(mixed(members.astype("u8") + ODD[2]), edges))
            _, first = np.unique(same, return_index=True)
            chosen = np.zeros(len(sizes), bool)
            chosen[first] = True
            met_by, nth = np.unique(members, return_inverse=True)
            degree = np.bincount(nth, np.repeat(sizes - 1, sizes)).astype(np.int64)
            mask = np.repeat(chosen, sizes)
            group, members = np.repeat(same, sizes).astype(np.int64)[mask], members[mask]
        else:
            group = members = met_by = degree = np.zeros(0, np.int64)
        none = lambda n: np.full(n, None, object)
        columns = {
            "grp": [group, none(len(two)), none(len(met_by))],
            "a": [none(len(group)), two[:, 0], none(len(met_by))],
            "degree": [none(len(group)), none(len(two)), degree],
            "node": [members, two[:, 1], met_by],
        }
        return pd.DataFrame({k: pd.array(np.concatenate([x.astype(object) for x in v]), "Int64") for k, v in columns.items()})

    return sent.groupBy("bucket").applyInPandas(meet, "grp long, a long, degree long, node long")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of the nodes in links (a, b): large-star and small-star steps, until the links are stars around the least nodes. A node with many links doesn't
    get them all in one task."""
    edges = C.materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    total = edges.count()

    def least_of(rows: DataFrame) -> DataFrame:
        facts = rows.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("held"))
        return C.join_group_facts(rows, facts, "u", "held", 2 * total)

    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = C.materialize(least_of(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct(), "edges")
        small = least_of(large).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u != v").distinct()
        small = C.materialize(small, "edges")
        C.discard(edges, large)
        edges = small
        # a star has each node once on the outside, and no node on both sides
        ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("hub")).unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("out"), F.lit(1).alias("hub")))
        if not ends.groupBy("n").agg(F.sum("out").alias("out"), F.max("hub").alias("hub")).filter("out + hub > 1").limit(1).count():
            roots = C.materialize(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), "roots")
            C.discard(edges)
            return roots


def common_size(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())


def with_pivots(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """pairs (a table of pivot, node and others) joined with facts (pivot and others). A pivot of many pairs is copied, so that no task gets all its pairs."""
    counts = pairs.groupBy("pivot").agg(F.count("*").alias("held"))
    copies = F.ceil(F.col("held") / SHARE).cast("int")
    dealt = C.join_group_facts(pairs, counts, "pivot", "held", pairs.count()).withColumn("salt", F.pmod(F.xxhash64("node"), copies).cast("int")).drop("held")
    copied = facts.join(counts.hint("merge"), "pivot").withColumn("salt", F.explode(F.sequence(F.lit(0), copies - 1))).drop("held")
    return dealt.join(copied.hint("merge"), ["pivot", "salt"]).drop("salt")


def compared(pairs: DataFrame, sets: DataFrame, reach: Reach) -> DataFrame:
    """pairs (pivot, node), a table, with their distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x, y in zip(b.column("pivot_set"), b.column("set"), strict=True):
                one, two = np.frombuffer(x.as_py(), "u8"), np.frombuffer(y.as_py(), "u8")
                both = common_size(one, two)
                union = len(one) + len(two) - both
                out.append((1 - both / union, reach.links(both, union)))
            yield pa.RecordBatch.from_arrays([b.column("pivot"), b.column("node"), pa.array([d for d, _ in out], pa.float64()), pa.array([x for _, x in out], pa.bool_())], ["pivot", "node", "distance", "linked"])

    met = with_pivots(pairs, sets.select(F.col("node").alias("pivot"), F.col("set").alias("pivot_set")))
    met = met.join(sets.hint("merge"), "node").select("pivot", "node", "pivot_set", "set")
    return met.mapInArrow(run, "pivot long, node long, distance double, linked boolean")


def bounded(pairs: DataFrame, profiles: DataFrame, reach: Reach) -> DataFrame:
    """pairs (pivot, node), a table, with bound, a distance that theirs isn't under by their profiles, and fits, whether they can link: class counts differ by no more than the sets do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            rows = [b.column(c).to_pylist() for c in ("pivot_profile", "profile")]
            n, m = (b.column(c).to_numpy(zero_copy_only=False) for c in ("pivot_n", "n"))
            small, large = np.minimum(n, m), np.maximum(n, m)
            sizes, differ = np.array([min(len(x), len(y)) for x, y in zip(*rows, strict=True)]), large - small
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                one, two = (Profiles.of([r[i] for i in at], size) for r in rows)
                differ[at] = np.maximum(differ[at], one.differ(slice(None), two, slice(None)))
            fits = (differ <= (reach.den - reach.num) * small // reach.num) & (reach.den * small >= reach.num * large)
            common = (n + m - differ) / 2
            yield pa.RecordBatch.from_arrays([b.column("pivot"), b.column("node"), pa.array(1 - common / (n + m - common)), pa.array(fits)], ["pivot", "node", "bound", "fits"])

    of_pivots = profiles.select(F.col("node").alias("pivot"), F.col("profile").alias("pivot_profile"), F.col("n").alias("pivot_n"))
    return with_pivots(pairs, of_pivots).join(profiles.hint("merge"), "node").mapInArrow(run, "pivot long, node long, bound double, fits boolean")


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of batches that are sorted by keys."""
    held = None
    for b in batches:
        table = pa.Table.from_batches([b])
        table = table if held is None else pa.concat_tables([held, table])
        if table.num_rows:
            columns = [table.column(k).to_numpy() for k in keys]
            starts = [0, *(np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1).tolist()]
            yield from (table.slice(a, z - a) for a, z in zip(starts[:-1], starts[1:], strict=True))
            held = table.slice(starts[-1])
    if held is not None and held.num_rows:
        yield held


@dataclass
class Members:
    """Members of a region: their components and sides, sizes, profiles, and distances to the pivot, nan where unknown. Sides: HOME is compared with all, VISITOR with
    HOME, LEFT and RIGHT with each other."""

    comp: np.ndarray
    side: np.ndarray
    size: np.ndarray
    profiles: Profiles
    distance: np.ndarray

    def partners(self, i: int, reach: Reach) -> np.ndarray:
        """Later members that may link with member i: of another component, of a side that i is compared with, within the window, of like size and counts, neither being the pivot."""
        j = np.arange(i + 1, len(self.comp))
        small, large = np.minimum(self.size[i], self.size[j]), np.maximum(self.size[i], self.size[j])
        meet = (self.side[j] == HOME) | (self.side[i] == HOME) | (self.side[i] + self.side[j] == LEFT + RIGHT)
        fits = (self.comp[j] != self.comp[i]) & meet & (reach.den * small >= reach.num * large)
        fits &= (self.distance[j] != 0) & (self.distance[i] != 0)  # these have been compared
        fits &= ~(np.abs(self.distance[j] - self.distance[i]) > reach.radius() + 1e-9)
        j = j[fits]
        return j[self.profiles.differ(i, self.profiles, j) <= (reach.den - reach.num) * np.minimum(self.size[i], self.size[j]) // reach.num] if len(j) else j


def within(nodes: np.ndarray, sets: list[np.ndarray], members: Members, reach: Reach) -> list[tuple[int, int]]:
    """Links between members, as many as connect those that any links connect, by another pivot and its windows."""
    shared = np.array([common_size(sets[0], h) for h in sets])
    union = len(sets[0]) + members.size - shared
    members.distance = np.where(shared == union, np.nan, 1 - shared / union)
    found = []
    for j in np.flatnonzero(reach.den * shared >= reach.num * union):
        if members.comp[j] != members.comp[0]:
            found.append((int(nodes[0]), int(nodes[j])))
            members.comp[members.comp == members.comp[j]] = members.comp[0]
    for i in range(len(nodes) - 1):
        for j in members.partners(i, reach):
            if members.comp[j] != members.comp[i]:
                both = common_size(sets[i], sets[j])
                if reach.links(both, int(members.size[i] + members.size[j]) - both):
                    found.append((int(nodes[i]), int(nodes[j])))
                    members.comp[members.comp == members.comp[j]] = members.comp[i]
    return found


def open_groups(groups: DataFrame, roots: DataFrame, distances: DataFrame, reach: Reach) -> DataFrame:
    """(region, node, comp, distance, held) of the groups that aren't in one component yet, a table; held is the number of members. distances has for pivots and nodes the distance or a bound of it."""
    member = groups.join(roots.hint("merge"), "node", "left").join(distances.hint("merge"), ["pivot", "node"], "left")
    far = F.when(F.col("node") == F.col("pivot"), 0.0).otherwise(F.col("distance"))
    member = C.materialize(member.select("grp", "size", "node", F.coalesce("root", "node").alias("comp"), (F.col("node") == F.col("pivot")).alias("is_pivot"), far.alias("distance"), "bound"), "members")
    total = member.count()
    main = member.filter("is_pivot").select("grp", F.col("comp").alias("main"), "size")
    sided = C.join_group_facts(member.drop("size"), main, "grp", "size", total)
    # by the triangle inequality a member of the pivot's component that is nearer to the pivot than all others by more than the radius links with none of them
    others = F.col("comp") != F.col("main")
    sided = C.materialize(sided.select("grp", "size", "node", "comp", others.alias("other"), "distance", "bound"), "sided")
    near = sided.filter("other").groupBy("grp").agg(F.min(F.coalesce("distance", "bound", F.lit(0.0))).alias("near"), F.first("size").alias("held"))
    windows = F.col("other") | F.col("distance").isNull() | (F.col("distance") >= F.col("near") - reach.radius() - 1e-9)
    kept = C.join_group_facts(sided, near, "grp", "held", total).filter("near is not null").filter(windows)
    kept = C.materialize(kept.select(F.col("grp").alias("region"), "node", "comp", "distance"), "open")
    C.discard(member, sided)
    return counted(kept, "open")


def counted(members: DataFrame, name: str) -> DataFrame:
    """members (a table, with region and comp) of regions with more than one component, with held, the number of members, a table in place of members."""
    counts = members.groupBy("region").agg(F.count("*").alias("held"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    out = C.materialize(C.join_group_facts(members, counts, "region", "held", members.count()).filter("low < high").drop("low", "high"), name)
    C.discard(members)
    return out


def divided(open_: DataFrame, sets: DataFrame, reach: Reach, size: int) -> DataFrame:
    """(region, node, comp, side): regions of at most `size` members in which all links of the regions in open_ (region, node, comp, held), which are larger, are found again.

    A region is divided by several pivots drawn from it: each member lives in the Voronoi region of the nearest and visits those that are farther by at most twice
    the reach, as by the triangle inequality none of its partners lives in others; and so on, until regions are small. Where that would copy members too often,
    because they are as far from every pivot, the region is dealt as pairs of blocks, or, if it has more than MANY_BLOCKS of them, its members meet again at their signatures under another hash:
    linked sets do, and others that have met by one shared passage rarely do.
    """
    done = []
    state = C.materialize(open_.select("region", "node", "comp", F.lit(HOME).alias("side"), "held"), "regions")
    for level in range(ROUNDS):
        if not state.limit(1).count():
            break
        placed = C.materialize(with_nearest(state, sets, reach, level), "placed")
        C.release(placed.sparkSession)
        total = placed.groupBy("region").agg(F.sum(F.size("into")).alias("copies"), F.count("*").alias("held"))
        cost = C.join_group_facts(placed, total, "region", "held", placed.count())
        parts = C.materialize(cost.withColumn("stuck", F.col("copies") > MOST_COPIES * F.col("held")), "parts")
        C.discard(placed, state)
        voronoi = parts.filter("not stuck").select("region", "node", "comp", "side", "home", F.explode("into").alias("k"))
        voronoi = voronoi.select(F.xxhash64("region", "k", F.lit(level)).alias("region"), "node", "comp", F.when((F.col("side") == HOME) & (F.col("k") == F.col("home")), HOME).otherwise(VISITOR).alias("side"))
        many = F.col("held") * 2 > MANY_BLOCKS * size
        again = signed_again(parts.filter("stuck").filter(many).select("region", "node", "comp", "side"), sets, reach, level)
        done.append(C.materialize(blocks_of(parts.filter("stuck").filter(~many), size), "regions"))
        members = C.materialize(voronoi.unionByName(again), "regions")
        C.discard(parts)
        members = counted(members, "regions")
        done.append(C.materialize(members.filter(F.col("held") <= size).select("region", "node", "comp", "side"), "regions"))
        state = C.materialize(members.filter(F.col("held") > size), "regions")
        C.discard(members)
    done.append(C.materialize(blocks_of(state, size), "regions"))
    C.discard(state)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def with_nearest(state: DataFrame, sets: DataFrame, reach: Reach, level: int) -> DataFrame:
    """state (region, node, comp, side, held) with home, the number of the nearest of its region's pivots, and into, the numbers of the regions it lives in or visits."""
    drawn = F.xxhash64("region", "node", F.lit(level))
    rare = F.pmod(drawn, F.col("held")) < 2 * PIVOTS  # about as many of each region, however large
    pivots = state.filter(rare).groupBy("region").agg(F.slice(F.sort_array(F.collect_set(F.struct(drawn.alias("drawn"), "node"))), 1, PIVOTS).alias("p"), F.first("held").alias("held"))
    chosen = pivots.select("region", "held", F.posexplode("p.node").alias("k", "node")).join(sets.hint("merge"), "node")
    copies = F.ceil(F.col("held") / SHARE).cast("int")
    chosen = chosen.select("region", F.explode(F.sequence(F.lit(0), copies - 1)).alias("salt"), F.lit(0).alias("kind"), "node", F.lit(None).cast("long").alias("comp"), F.col("k").alias("side"), "set")
    members = state.join(sets.hint("merge"), "node").select("region", F.pmod(F.xxhash64("node"), copies).cast("int").alias("salt"), F.lit(1).alias("kind"), "node", "comp", "side", "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for b in batches:
            rows = []
            for region, salt, kind, node, comp, side, blob in zip(*(b.column(c).to_pylist() for c in ("region", "salt", "kind", "node", "comp", "side", "set")), strict=True):
                if at != (region, salt):
                    at, held = (region, salt), []
                h = np.frombuffer(blob, "u8")
                if kind == 0:
                    held.append((side, h))
                    continue
                far = [1 - (both := common_size(h, p)) / (len(h) + len(p) - both) for _, p in held] or [0.0]
                names = [k for k, _ in held] or [0]
                near = min(far)
                rows.append((region, node, comp, side, names[far.index(near)], [k for k, d in zip(names, far, strict=True) if d - near <= 2 * reach.radius() + 1e-9]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["region", "node", "comp", "side", "home", "into"])

    dealt = chosen.unionByName(members).repartition(C.partitions(state.sparkSession), "region", "salt").sortWithinPartitions("region", "salt", "kind", "side", "node")
    return dealt.mapInArrow(run, "region long, node long, comp long, side int, home int, into array<int>")


def signed_again(members: DataFrame, sets: DataFrame, reach: Reach, level: int) -> DataFrame:
    """members (region, node, comp, side) in the groups in which they meet by signatures under another hash; those that meet nobody are left out by counted()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [signatures(mixed(np.frombuffer(blob, "u8") + np.uint64((level + 1) * int(ODD[3]) % 2**64)), reach) for blob in b.column("set").to_pylist()]
            which = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
            key = np.concatenate(keys).astype(np.int64) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), *(b.column(c).take(pa.array(which)) for c in ("region", "node", "comp", "side"))], ["key", "region", "node", "comp", "side"])

    rows = members.join(sets.hint("merge"), "node").select("region", "node", "comp", "side", "set").mapInArrow(run, "key long, region long, node long, comp long, side int")
    return rows.select(F.xxhash64("region", "key").alias("region"), "node", "comp", "side")


def blocks_of(state: DataFrame, size: int) -> DataFrame:
    """(region, node, comp, side): the members of each region of state (region, node, comp, held) in blocks, a region for each pair of blocks."""
    blocks = F.ceil(2 * F.col("held") / size).cast("int")
    dealt = state.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node", "region"), F.col("blocks")).cast("int"))
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    x, y = F.least("block", "other"), F.greatest("block", "other")
    side = F.when(x == y, HOME).when(F.col("block") == x, LEFT).otherwise(RIGHT)
    return other.select(F.xxhash64("region", x, y, F.lit("blocks")).alias("region"), "node", "comp", side.alias("side"))


def dealt_by_region(df: DataFrame) -> DataFrame:
    return df.repartition(C.partitions(df.sparkSession), "region").sortWithinPartitions("region", "node")


def screened(regions: DataFrame, profiles: DataFrame, reach: Reach) -> DataFrame:
    """Of regions (region, node, comp, side, distance) the members that have a possible partner, by their profiles."""
    names = ["region", "node", "comp", "side"]

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, ["region"]):
            members = Members(*(t.column(c).to_numpy() for c in ("comp", "side", "n")), Profiles.of(t.column("profile").to_pylist()), t.column("distance").to_numpy().astype(float))
            some = np.zeros(t.num_rows, bool)
            for i in range(t.num_rows - 1):
                j = members.partners(i, reach)
                some[j] = True
                some[i] |= len(j) > 0
            if some.any():
                yield from t.select(names).filter(pa.array(some)).combine_chunks().to_batches()

    profiled = dealt_by_region(regions.join(profiles.hint("merge"), "node").select(*names, "distance", "n", "profile"))
    return profiled.mapInArrow(screen, "region long, node long, comp long, side int")


def joined(regions: DataFrame, sets: DataFrame, reach: Reach) -> DataFrame:
    """(a, b): links inside the regions (region, node, comp, side)."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, ["region"]):
            held = [np.frombuffer(s, "u8") for s in t.column("set").to_pylist()]
            size = np.array([len(h) for h in held])
            members = Members(t.column("comp").to_numpy().copy(), t.column("side").to_numpy(), size, Profiles.of([profile_of(h) for h in held]), np.zeros(0))
            found = within(t.column("node").to_numpy(), held, members, reach)
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

    return dealt_by_region(regions.join(sets.hint("merge"), "node").select("region", "node", "comp", "side", "set")).mapInArrow(join, "a long, b long")


def sets_of(docs: DataFrame, nodes: DataFrame, chosen: DataFrame, reach: Reach, few: bool = False) -> DataFrame:
    """(node, set) of the chosen nodes, from their rows of docs, a table. few: texts aren't shuffled if the chosen are under Spark's bound for broadcasts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # rows that repeat are in one partition
        for b in batches:
            found = []
            for n, digest, t in zip(b.column("node").to_pylist(), b.column("digest").to_pylist(), b.column("text"), strict=True):
                if n not in seen and digest_of(h := shingles(t.as_py(), reach.words)) == digest:
                    seen.add(n)
                    found.append((n, h.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.int64()), pa.array([h for _, h in found], pa.binary())], ["node", "set"])

    wanted = C.materialize(nodes.join(chosen.hint("merge"), "node").select("node", "row", "digest"), "wanted")
    text = docs.select(row_key().alias("row"), C.text_of().alias("text"))
    found = C.materialize(text.join(wanted if few else wanted.hint("merge"), "row").mapInArrow(run, "node long, set binary"), "sets")
    C.discard(wanted)
    return found


def jaccard_components(docs: DataFrame, reach: Reach | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    return rooted_components(docs, reach).select("doc_id", "n_shingles", "component_id")


def rooted_components(docs: DataFrame, reach: Reach | None = None) -> DataFrame:
    """doc_id, row (its row_key()), n_shingles, root (a node of its component), component_id of every document, a table."""
    return C.sealed(docs.sparkSession, lambda: labelled(*linked_nodes(docs, reach or Reach())), "rooted")


def linked_nodes(docs: DataFrame, reach: Reach) -> tuple[DataFrame, DataFrame]:
    """Documents' nodes, and (node, root) of the nodes that have links. Tables are deleted when they have been read for the last time."""
    spark = docs.sparkSession
    path = C.fresh_path(spark, "signed")
    rows = signed(docs, reach, C.partitions(spark))
    rows.withColumn("sent", F.col("bucket").isNotNull()).write.partitionBy("sent").parquet(path)
    table = spark.read.schema(SIGN_SCHEMA + ", sent boolean").parquet(path)
    nodes = table.filter("not sent").select("doc_id", "node", "rep", "n", "row", "digest", "profile")
    profiles = nodes.filter("profile is not null").select("node", "n", "profile")
    meetings = C.materialize(met(table.filter("sent").select("bucket", "node", "keys")), "met")
    C.remove_path(spark, f"{path}/sent=true")
    C.release(spark)
    groups, stars = grouped_stars(meetings)
    C.discard(meetings)
    bounds = C.materialize(bounded(stars, profiles, reach), "bounds")
    C.discard(stars)
    C.release(spark)
    pairs = C.materialize(bounds.filter("fits").select("pivot", "node"), "pairs")
    sets = sets_of(docs, nodes, pairs.select("pivot").union(pairs.select("node")).toDF("node").distinct(), reach)
    C.release(spark)
    done = C.materialize(compared(pairs, sets, reach), "compared")
    C.discard(pairs)
    C.release(spark)
    roots = components(done.filter("linked").select(F.col("pivot").alias("a"), F.col("node").alias("b")))
    none = F.lit(None).cast("double")
    distances = done.select("pivot", "node", "distance", none.alias("bound")).unionByName(bounds.filter("not fits").select("pivot", "node", none.alias("distance"), "bound"))
    regions = open_groups(groups, roots, distances, reach)
    C.discard(groups, bounds, done)
    C.release(spark)
    small = C.materialize(screened(regions.filter(F.col("held") <= BLOCK).withColumn("side", F.lit(HOME)), profiles, reach), "screened")
    C.release(spark)
    large = regions.filter(F.col("held") > BLOCK)
    more = C.materialize(small.select("node").union(large.select("node")).distinct().join(sets.select("node").hint("merge"), "node", "left_anti"), "more")
    tables = [sets]
    if more.limit(1).count():
        tables.append(sets_of(docs, nodes, more, reach, few=True))
        C.release(spark)
        sets = sets.unionByName(tables[1])
    if large.limit(1).count():
        parts = divided(large, sets, reach, BLOCK).withColumn("distance", F.lit(None).cast("double"))
        small = small.unionByName(C.materialize(screened(parts, profiles, reach), "screened"))
    found = C.materialize(joined(small, sets, reach), "links")
    C.discard(*tables)
    C.release(spark)
    if found.limit(1).count():
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found))
    return nodes, roots


def grouped_stars(meetings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables (grp, node, pivot, size) and (pivot, node) of groups of three or more, and of those and of two."""
    degrees = meetings.filter("degree is not null").groupBy("node").agg(F.sum("degree").alias("degree"))
    member = C.materialize(meetings.filter("grp is not null").select("grp", "node").distinct().join(degrees.hint("merge"), "node"), "degrees")
    # the pivot of a group meets the most others: what copies were made from, if it is there
    pivots = member.groupBy("grp").agg(F.max_by("node", F.struct("degree", "node")).alias("pivot"), F.count("*").alias("size"))
    groups = C.materialize(C.join_group_facts(member.select("grp", "node"), pivots, "grp", "size", member.count()), "groups")
    C.discard(member)
    stars = groups.filter("node != pivot").select("pivot", "node").unionByName(meetings.filter("a is not null").select(F.col("a").alias("pivot"), "node")).distinct()
    return groups, C.materialize(stars, "stars")


def labelled(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    rooted = nodes.select("doc_id", "row", "rep", F.col("n").alias("n_shingles")).join(roots.select(F.col("node").alias("rep"), "root").hint("merge"), "rep", "left")
    rooted = C.materialize(rooted.select("doc_id", "row", "n_shingles", F.coalesce("root", "rep").alias("root")), "labelled")
    facts = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("held"))
    return C.join_group_facts(rooted, facts, "root", "held", rooted.count()).select("doc_id", "row", "n_shingles", "root", "component_id")


def one_of_each(docs: DataFrame, reach: Reach | None = None) -> DataFrame:
    """A row of each component, with all columns: of its least doc_id (null only where all are null), and of several such rows the one with the least row_key().
    Rows that repeat doc_id and text are one component unless the text is empty; the first by a hash of all columns stays."""
    found = rooted_components(docs, reach)
    total = found.count()
    least = F.col("doc_id").eqNullSafe(F.col("component_id"))
    several = found.filter(least).groupBy("root").agg(F.min("row").alias("stays"), F.count("*").alias("rows")).filter("rows > 1")
    tied = C.materialize(C.join_group_facts(found.filter(least), several, "root", "rows", total).filter("rows > 1").select("doc_id", "row", "stays"), "tied")
    gone = C.materialize(found.filter(~least).select("doc_id", "row").unionByName(tied.filter("row != stays").select("doc_id", "row")).distinct(), "gone")
    copies = C.materialize(tied.filter("row = stays").groupBy("doc_id", "row").count().filter("count > 1").select("doc_id", "row"), "copies")
    C.discard(found, tied)
    # whole rows are one column here, so that names can't clash
    keyed = docs.select(F.struct(F.col("doc_id").cast("long").alias("id"), row_key().alias("row")).alias("k"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("v"))
    named = lambda keys: keys.select(F.struct(F.col("doc_id").alias("id"), "row").alias("k"))
    same = lambda keys: keyed["k"].eqNullSafe(keys["k"])
    none, twice = named(gone), named(copies)
    kept = keyed.join(none, same(none), "left_anti")
    if not copies.limit(1).count():
        return kept.select("v.*")
    first = kept.join(twice, same(twice), "left_semi").groupBy("k").agg(F.min_by("v", F.xxhash64("v")).alias("v"))
    return kept.join(twice, same(twice), "left_anti").select("v.*").unionByName(first.select("v.*"))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(C.load(spark, sf_dir, "documents"), Reach(85, 100, 4))

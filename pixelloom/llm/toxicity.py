"""Toxic passages as maximum-scoring segments of token log-odds.

Learning: a token's features are the token and its beginnings (a stem can take any ending). How often features stand in toxic and in
other labelled documents (a bounded sample) gives their log-odds under a Dirichlet prior whose shape is the feature counts of the whole
corpus; only features count that are clearly in more toxic texts, by all texts and by different contexts, and a token has the score of its clearest feature. Every token also costs DRIFT, so that a
segment ends where toxic tokens stop. Scoring: one linear scan finds all maximal scoring segments of a text. Calibration: the best segment
of ordinary texts follows an extreme-value law in text length and score, whose two parameters are fitted on labelled non-toxic rows; a segment's
significance is the negative logarithm of its chance under that law, a document's is the sum over its segments, and a logistic curve makes it a score.

Defined cases. Null or empty text: no segments, the score of a text without evidence. Null doc_id: scored, held_out false. Repeated rows: scored each. Without labels
of both kinds nothing is learned and every score is 0. Empty table: no rows. Other columns don't take part.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .quality import held_out

#: Labelled rows of each kind to learn from at most.
SAMPLE_ROWS = 4_000
#: Mass of the Dirichlet prior in tokens, standard errors for a clear sign, cost of a token, bound of a token's score.
PRIOR, CLEAR, DRIFT, MOST = 2_000.0, 4.5, 0.05, 6.0
#: Lengths in bytes of the beginnings that are features; a whole token is a feature with this byte at its end.
STEMS, WHOLE = (4, 5, 6, 7, 8), b" "
#: Distinct tokens that a worker remembers.
REMEMBERED = 200_000
THRESHOLD = 0.5
FOLDS, HELD_OUT = 5, 0
#: Lower-case letters of ASCII and all bytes of other letters; everything else parts tokens.
TOKEN_BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def tokens(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TOKEN_BYTES).split()


def segments(at: list[int], scores: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, last token, score), where the token at[k] scores scores[k] and each token costs drift.

    The scan keeps candidate segments with the sums before and after them; each new one joins the latest that starts lower and ends lower, so the
    work is linear in the scoring tokens.
    """
    found: list[tuple[int, int, float, float]] = []
    total, done = 0.0, 0
    for i, s in zip(at, scores, strict=True):
        total -= drift * (i - done)
        done = i + 1
        low, total = total, total + s - drift
        if total <= low:
            continue
        first, high = i, total
        k = len(found) - 1
        while True:
            while k >= 0 and found[k][2] >= low:
                k -= 1
            if k < 0 or found[k][3] >= high:
                found.append((first, i, low, high))
                break
            first, low = found[k][0], found[k][2]
            del found[k:]
            k = len(found) - 1
    return [(a, z, high - low) for a, z, low, high in found]


def features(token: bytes) -> list[bytes]:
    return [token + WHOLE, *(token[:k] for k in STEMS if len(token) >= k)]


class Memory(dict):
    """What a function says of each token."""

    def __init__(self, of: Callable):
        self.of = of

    def __missing__(self, token: bytes):
        if len(self) > REMEMBERED:
            self.clear()
        self[token] = found = self.of(token)
        return found


@dataclass(frozen=True)
class Model:
    """Features' scores and clarity; the extreme-value law's decay and size; the logistic curve's offset and slope."""

    scores: dict[bytes, tuple[float, float]]
    decay: float = 1.0
    size: float = 1.0
    offset: float = -40.0
    slope: float = 0.0

    def token_scores(self) -> Memory:
        return Memory(lambda token: max((self.scores[f] for f in features(token) if f in self.scores), default=(0.0, 0.0))[1])

    def passages(self, text: str, memory: Memory) -> tuple[int, list[tuple[int, int, float]]]:
        words = tokens(text)
        if not self.scores:
            return len(words), []
        scores = [memory[w] for w in words]
        at = [i for i, s in enumerate(scores) if s]
        return len(words), segments(at, [scores[i] for i in at], DRIFT) if at else []

    def significance(self, n: int, score: float) -> float:
        """Negative logarithm of the chance that ordinary text of n tokens has a segment of this score."""
        expected = self.size * max(n, 1) * math.exp(-self.decay * score)
        return -math.log(max(-math.expm1(-expected), 1e-300))

    def evidence(self, n: int, found: list[float]) -> float:
        return sum(s for x in found if (s := self.significance(n, x)) > 1.0)

    def score(self, evidence: float) -> float:
        if not self.scores:
            return 0.0
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, self.offset + self.slope * evidence))))


@dataclass
class Seen:
    """What the labelled sample has of a feature, for the two labels: texts, occurrences, and different pairs of neighbours."""

    texts: list[int]
    times: list[int]
    contexts: list[int]


def log_odds(seen: dict[bytes, Seen], texts: list[int], times: list[int], corpus: dict[bytes, int], n_corpus: int) -> dict[bytes, tuple[float, float]]:
    """Clarity and score of the features that are clearly in more toxic texts; texts and times have the sample's totals by label."""
    found = []
    for f, x in seen.items():
        # copies of a text have the same neighbours, so they don't count as many texts
        b, a = (min(x.texts[k], x.contexts[k]) for k in (0, 1))
        share = (a + b) / sum(texts)
        gain = sum(2 * y * math.log(y / (n * share)) for y, n in ((a, texts[1]), (b, texts[0])) if y)
        if a * texts[0] <= b * texts[1] or gain < CLEAR**2:
            continue
        prior = 0.5 + PRIOR * corpus.get(f, 0) / max(n_corpus, 1)
        y, z = (min(x.times[k], x.contexts[k]) + prior for k in (1, 0))
        odds = math.log(y / (times[1] + PRIOR - y)) - math.log(z / (times[0] + PRIOR - z))
        if odds > 2 * DRIFT:
            found.append((math.sqrt(gain), min(MOST, odds), f))
    return {f: (clarity, odds) for clarity, odds, f in found}


def clear(n: Column, n_other: Column, texts: int, texts_other: int) -> Column:
    """Whether a feature of n toxic texts and n_other others is clearly in more of the toxic ones; what isn't is no feature, and the others are few."""
    share = (n + n_other) / float(texts + texts_other)
    part = lambda y, size: F.when(y > 0, 2 * y * F.log(y / (size * share))).otherwise(0.0)
    return (n * texts_other > n_other * texts) & (part(n, texts) + part(n_other, texts_other) >= CLEAR**2)


def texts_with(docs: DataFrame) -> DataFrame:
    """label, feature, n: how many texts of each kind have a feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for label, text in zip(b.column("label").to_pylist(), b.column("text"), strict=True):
                counts.update({(label, f) for w in set(tokens(text.as_py())) for f in features(w)})
                if len(counts) > REMEMBERED:
                    yield batch(counts)
                    counts.clear()
        yield batch(counts)

    def batch(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.int32()), pa.array([k[1] for k in counts], pa.binary()), pa.array(list(counts.values()), pa.int64())], ["label", "feature", "n"])

    return docs.select("label", "text").mapInArrow(run, "label int, feature binary, n long").groupBy("label", "feature").agg(F.sum("n").alias("n"))


def occurrences(docs: DataFrame, vocabulary: frozenset[bytes]) -> DataFrame:
    """label, feature, times, contexts of the vocabulary's features; the feature WHOLE counts all tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Memory(lambda w: [f for f in features(w) if f in vocabulary])
        for b in batches:
            rows: Counter = Counter()
            for label, text in zip(b.column("label").to_pylist(), b.column("text"), strict=True):
                words = tokens(text.as_py())
                framed = [b"", *words, b""]
                for i, w in enumerate(words):
                    for f in known[w]:
                        rows[label, f, framed[i] + b" " + framed[i + 2]] += 1
                rows[label, WHOLE, b""] += len(words)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary()), pa.array(list(rows.values()), pa.int64())], ["label", "feature", "context", "n"])

    rows = docs.select("label", "text").mapInArrow(run, "label int, feature binary, context binary, n long")
    return rows.groupBy("label", "feature").agg(F.sum("n").alias("times"), F.count_distinct("context").alias("contexts"))


def counted(docs: DataFrame, vocabulary: frozenset[bytes]) -> DataFrame:
    """feature, n: counts of the vocabulary's features in all docs; the feature WHOLE counts all tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = Memory(lambda w: [f for f in features(w) if f in vocabulary]), defaultdict(int)
        for b in batches:
            for text in b.column("text"):
                words = tokens(text.as_py())
                counts[WHOLE] += len(words)
                for found in map(known.__getitem__, words):
                    for f in found:
                        counts[f] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["feature", "n"])

    return docs.mapInArrow(run, "feature binary, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def sampled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, label, text of at most SAMPLE_ROWS labelled rows of each kind that aren't held out, a table."""
    usable = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).filter(~held_out(F.col("doc_id"), FOLDS, HELD_OUT))
    kinds = [usable.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS) for k in (0, 1)]
    chosen = C.materialize(kinds[0].unionByName(kinds[1]).dropDuplicates(["doc_id"]), "labels")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.text_of().alias("text"))
    return C.materialize(text.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]), "sample")


def train(docs: DataFrame, labels: DataFrame) -> Model:
    sample = sampled(docs, labels)
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return Model({})
    kinds = C.materialize(texts_with(sample), "kinds")
    other = kinds.filter("label = 0").select("feature", F.col("n").alias("n_other"))
    both = kinds.filter("label = 1").select("feature", "n").join(other.hint("merge"), "feature", "left").select("feature", "n", F.coalesce("n_other", F.lit(0)).alias("n_other"))
    rows = both.filter(clear(F.col("n"), F.col("n_other"), sizes[1], sizes[0])).collect()
    seen = {bytes(r["feature"]): Seen([r["n_other"], r["n"]], [0, 0], [0, 0]) for r in rows}
    vocabulary, times = frozenset(seen), [0, 0]
    for r in occurrences(sample, vocabulary).collect():
        if (f := bytes(r["feature"])) == WHOLE:
            times[r["label"]] = r["times"]
        else:
            seen[f].times[r["label"]], seen[f].contexts[r["label"]] = r["times"], r["contexts"]
    corpus = {bytes(r["feature"]): r["n"] for r in counted(docs.select(C.text_of().alias("text")), vocabulary).collect()}
    model = Model(log_odds(seen, [sizes[0], sizes[1]], times, corpus, corpus.get(WHOLE, 0)))
    sample = sample.withColumn("held_out", F.lit(False))
    found = scanned(sample.filter("label = 0"), model, ["label"]).select("n", "best").collect()
    decay, size = fit_extremes(np.array([(r["n"], r["best"]) for r in found if r["n"]]))
    model = Model(model.scores, decay, size)
    found = [(r["label"], r["evidence"]) for r in scanned(sample, model, ["label"]).select("label", "evidence").collect()]
    evidence = np.array([x for _, x in found])
    offset, slope = fit_curve(evidence, np.array([float(label) for label, _ in found]))
    return Model(model.scores, decay, size, offset, slope)


def fit_extremes(ordinary: np.ndarray) -> tuple[float, float]:
    """decay and size of P(best segment >= x) = 1 - exp(-size * n * exp(-decay * x)), from (n, best) of ordinary texts; texts without a segment only tell that size is small."""
    n, best = (ordinary[:, 0], ordinary[:, 1]) if len(ordinary) else (np.zeros(0), np.zeros(0))
    some = best[best > 0]
    if len(some) < 20:
        return 1.0, max(len(some), 0.5) / max(float(n.sum()), 1.0)
    low = float(np.percentile(some, 10))
    decay = min(3.0, max(0.2, 1 / max(float(np.maximum(some - low, 0).mean()), 1e-3)))
    # each text has a segment of at least `low` with chance 1 - exp(-size * n * exp(-decay * low))
    return decay, float((best >= low).sum()) / float(n.sum()) * math.exp(decay * low)


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic curve over the evidence, both kinds weighing the same, with a slight penalty on the slope."""
    scale = max(float(np.percentile(x[y == 1], 50)) if (y == 1).any() else 1.0, 1e-6)
    z, weight = np.minimum(x / scale, 4.0), np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1))
    w = np.array([-2.0, 4.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-(w[0] + w[1] * z)))
        g = np.array([(weight * (p - y)).sum(), (weight * (p - y) * z).sum() + 1e-3 * w[1]])
        h = weight * p * (1 - p) + 1e-9
        hess = np.array([[h.sum(), (h * z).sum()], [(h * z).sum(), (h * z * z).sum() + 1e-3]])
        w = w - np.clip(np.linalg.solve(hess, g), -2, 2)
    return float(w[0]), float(max(w[1], 0.0) / scale)


def scanned(docs: DataFrame, model: Model, more: list[str]) -> DataFrame:
    """doc_id, held_out, n, score, score of the best segment, evidence, significant passages (first and last token, score) and the columns of more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passage, memory = pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())]), model.token_scores()
        for b in batches:
            n, score, best, evidence, kept = [], [], [], [], []
            for text in b.column("text"):
                size, found = model.passages(text.as_py(), memory)
                n.append(size)
                best.append(max((x for *_, x in found), default=0.0))
                evidence.append(model.evidence(size, [x for *_, x in found]))
                score.append(model.score(evidence[-1]))
                kept.append([{"first": a, "last": z, "score": x} for a, z, x in found if model.significance(size, x) > 1.0])
            columns = [b.column(c) for c in ("doc_id", "held_out", *more)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(score, pa.float64()), pa.array(best, pa.float64()), pa.array(evidence, pa.float64()), pa.array(kept, pa.list_(passage))], ["doc_id", "held_out", *more, "n", "score", "best", "evidence", "passages"])

    extra = "".join(f", {c} int" for c in more)
    return docs.select("doc_id", "held_out", *more, "text").mapInArrow(run, f"doc_id long, held_out boolean{extra}, n long, score double, best double, evidence double, passages array<struct<first: long, last: long, score: double>>")


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, passages of every document."""
    model = train(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id").cast("long"), FOLDS, HELD_OUT).alias("held_out"), C.text_of().alias("text"))
    return scanned(rows, model, []).select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "passages")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(C.load(spark, sf_dir, "documents"), C.load(spark, sf_dir, "labels"))

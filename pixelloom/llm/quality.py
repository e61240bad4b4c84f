"""Quality classifier: a sparse ensemble of rules over text statistics, compiled into Spark column expressions.

On a bounded sample of labelled documents the driver boosts shallow trees, takes every path from a root as a conjunctive rule, and fits
lasso logistic weights for the rules, which makes most of them 0. The rest becomes one column expression, so scoring reads each document
once, alone and without Python.

Defined cases. Null or empty text: statistics of the empty text, scored like any other. Null doc_id: scored, held_out false. Repeated rows: scored each. Labels that
are null or whose doc_id isn't in the table don't count; of several labels of a document the smallest does. Without labels the score is 1; with labels
of one kind it is their share. Empty table: no rows. Other columns don't take part.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Labelled rows to learn from at most, the first by a hash of doc_id.
SAMPLE_ROWS = 8_000
TREES, DEPTH, LEAST_LEAF, RATE = 24, 3, 15, 0.3
LASSO = 2e-3
THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def sampled_labels(labels: DataFrame, label: str, folds: int, fold: int, rows: int) -> DataFrame:
    """doc_id and label of at most `rows` rows that aren't held out, a table."""
    usable = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    one = usable.filter(~held_out(F.col("doc_id"), folds, fold)).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows)
    return C.materialize(one.groupBy("doc_id").agg(F.min("label").alias("label")), "labels")


def statistics(text: Column) -> dict[str, Column]:
    """Numbers that say how a text is made; shares have a floor of 1 in the denominator, so all are defined for the empty text."""
    chars = F.greatest(F.length(text), F.lit(1))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    words, lines = F.split(text, r"[ \t-\r]+"), F.split(text, "\n")
    n_words, n_lines = F.size(words), F.size(lines)
    return {
        "log_words": F.log1p(n_words.cast("double")),
        "upper": count(r"[A-Z]+[A-Z]") / n_words,
        "upper_chars": count("[A-Z]") / chars,
        "symbols": count(r"[#$%&*+/<=>@\\^_`{|}~]") / chars,
        "loud": count("[!?]") / chars,
        "digits": count("[0-9]") / chars,
        "stops": count("[.,;:]") / chars,
        "distinct_words": F.size(F.array_distinct(words)) / n_words,
        "distinct_lines": F.size(F.array_distinct(lines)) / n_lines,
        "word_length": chars / n_words,
    }


@dataclass(frozen=True)
class Rule:
    """Conditions (statistic, is it above, threshold) that all hold."""

    conditions: tuple[tuple[str, bool, float], ...]

    def on(self, table: dict[str, np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([table[k] > t if above else table[k] <= t for k, above, t in self.conditions])

    def column(self, stats: dict[str, Column]) -> Column:
        held = F.lit(True)
        for k, above, t in self.conditions:
            held = held & ((stats[k] > t) if above else (stats[k] <= t))
        return held


def grow(table: dict[str, np.ndarray], residual: np.ndarray, rows: np.ndarray, depth: int, path: tuple, rules: list[Rule], fit: np.ndarray) -> None:
    """A regression tree on the residuals; adds the paths to all its nodes to rules and its values to fit."""
    best, y = (0.0, None, 0.0), residual[rows]
    if depth and len(rows) >= 2 * LEAST_LEAF:
        for name, column in table.items():
            x = column[rows]
            order = np.argsort(x, kind="stable")
            xs, sums = x[order], np.cumsum(y[order])
            k = np.arange(1, len(rows))
            good = (xs[1:] > xs[:-1]) & (k >= LEAST_LEAF) & (len(rows) - k >= LEAST_LEAF)
            if good.any():
                left = sums[:-1]
                gain = np.where(good, left**2 / k + (sums[-1] - left) ** 2 / (len(rows) - k) - sums[-1] ** 2 / len(rows), 0)
                at = int(np.argmax(gain))
                if gain[at] > best[0] + 1e-9:
                    best = (float(gain[at]), name, float((xs[at] + xs[at + 1]) / 2))
    if best[1] is None:
        fit[rows] += RATE * y.mean()
        return
    above = table[best[1]][rows] > best[2]
    for side in (False, True):
        way = (*path, (best[1], side, best[2]))
        rules.append(Rule(way))
        grow(table, residual, rows[above == side], depth - 1, way, rules, fit)


def lasso(matrix: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 1500) -> tuple[float, np.ndarray]:
    """Intercept and weights of logistic regression with an L1 penalty on the weights, by accelerated proximal gradients."""
    n, k = matrix.shape
    full = np.hstack([np.ones((n, 1)), matrix])
    step = 4 * n / max(np.linalg.norm(full, 2) ** 2, 1e-9)
    w = v = np.zeros(k + 1)
    w[0] = v[0] = math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    t = 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(full @ v, -40, 40)))
        new = v - step * (full.T @ (p - y)) / n
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / t_new * (new - w)
        if np.abs(new - w).max() < 1e-7:
            w = new
            break
        w, t = new, t_new
    return float(w[0]), w[1:]


@dataclass(frozen=True)
class Model:
    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def column(self, text: Column) -> Column:
        """The score as one expression that computes each statistic once, wherever the optimizer moves it."""
        stats = statistics(text)
        return F.element_at(F.transform(F.array(F.struct(*[c.alias(k) for k, c in stats.items()])), lambda s: self.score({k: s[k] for k in stats})), 1)

    def score(self, stats: dict[str, Column]) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(rule.column(stats), weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def fit_rules(table: dict[str, np.ndarray], y: np.ndarray) -> Model:
    """Boost trees on logistic residuals, then lasso weights for their distinct rules."""
    if not len(y) or y.min() == y.max():
        return Model(40.0 if not len(y) or y.mean() == 1 else -40.0, ())
    rules: list[Rule] = []
    fit = np.full(len(y), math.log(y.mean() / (1 - y.mean())))
    for _ in range(TREES):
        grow(table, 4 * (y - 1 / (1 + np.exp(-fit))), np.arange(len(y)), DEPTH, (), rules, fit)
    columns, kept = [], []
    seen = set()
    for r in dict.fromkeys(rules):
        on = r.on(table)
        if 0 < on.sum() < len(y) and (key := on.tobytes()) not in seen:
            seen.add(key)
            columns.append(on)
            kept.append(r)
    intercept, weights = lasso(np.stack(columns, axis=1).astype(float), y, LASSO) if kept else (float(fit[0]), [])
    return Model(intercept, tuple((r, float(w)) for r, w in zip(kept, weights, strict=True) if abs(w) > 1e-6))


def train(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, fold: int = HELD_OUT, rows: int = SAMPLE_ROWS) -> Model:
    sample = sampled_labels(labels, "quality", folds, fold, rows)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.text_of().alias("text")).join(F.broadcast(sample), "doc_id")
    stats = statistics(F.col("text"))
    found = text.select("doc_id", "label", *[c.alias(k) for k, c in stats.items()]).dropDuplicates(["doc_id"]).orderBy("doc_id").toPandas()
    return fit_rules({k: found[k].to_numpy(float) for k in stats}, found["label"].to_numpy(float))


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = train(docs, labels)
    doc_id = F.col("doc_id").cast("long")
    names = list(statistics(F.lit("")))
    stats = docs.select(doc_id.alias("doc_id"), C.text_of().alias("text")).select("doc_id", *[c.alias(k) for k, c in statistics(F.col("text")).items()])
    scored = stats.select("doc_id", held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), model.score({k: F.col(k) for k in names}).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier doesn't reject, with all their columns."""
    return docs.filter(train(docs, labels).column(C.text_of()) >= THRESHOLD)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(C.load(spark, sf_dir, "documents"), C.load(spark, sf_dir, "labels"))

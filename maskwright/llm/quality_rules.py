"""Operator 1, quality rules: gradient-boosted trees over document statistics with monotonic constraints.

The trees are grown on the driver from a bounded sample of labelled documents and flattened into numpy node arrays, so
that a batch is scored level by level without recursion. Document statistics cover whole texts in one map pass; nothing
is shuffled.

Edge cases: a null or empty text has all counts 0 and fails the base rules (fewer than 50 words), so it is not kept; a
null id passes through; repeated rows are judged each on its own; without usable labels no trees are grown and the base
rules alone decide; columns other than id and text are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.docstats import BASE, FEATURES, statistics
from maskwright.llm.support import table, trimmed, worker_cache

#: Labelled documents that the trees are grown from at most, the smallest by a hash of the id.
MAX_TRAIN_ROWS = 20_000
#: A document passing the base rules is rejected when its probability of quality 1 is below this.
MIN_PROBABILITY = 0.5
#: Sign of the allowed effect of a statistic on the probability of good quality.
MONOTONE = {"symbol_ratio": -1, "dup_line_ratio": -1, "repeat_ratio": -1, "pipe_ratio": -1, "bang_ratio": -1, "top_word_ratio": -1, "adjacent_ratio": -1}


@dataclass
class FlatTrees:
    """Boosted trees as parallel node arrays. A leaf is its own child, so every row can take the same number of steps."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.bias), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            out += self.value[at]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -50, 50)))


def grow(x: np.ndarray, y: np.ndarray, signs: dict[int, int], *, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 64, l2: float = 2.0, min_rows: int = 5) -> FlatTrees:
    """Fit logistic boosting by histograms. Of a constrained feature, splits in the wrong direction are not taken, and the
    children's leaf values are bounded by the mean of both sides, which keeps the whole ensemble monotone."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    prior = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    bias = float(np.log(prior / (1 - prior)))
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots, margin = [], np.full(len(x), bias)

    def weight(g: np.ndarray | float, h: np.ndarray | float) -> np.ndarray:
        return -np.asarray(g) / (np.asarray(h) + l2)

    def build(rows: np.ndarray, grad: np.ndarray, hess: np.ndarray, level: int, low: float, high: float) -> int:
        me = len(nodes)
        g, h = grad[rows].sum(), hess[rows].sum()
        nodes.append([0, np.inf, me, me, rate * float(np.clip(weight(g, h), low, high))])
        if level == depth or len(rows) < 2 * min_rows:
            return me
        best = (1e-6, -1, -1)
        for f, c in enumerate(cuts):
            if not len(c):
                continue
            b = binned[rows, f]
            gl = np.cumsum(np.bincount(b, grad[rows], len(c) + 1))[:-1]
            hl = np.cumsum(np.bincount(b, hess[rows], len(c) + 1))[:-1]
            nl = np.cumsum(np.bincount(b, minlength=len(c) + 1))[:-1]
            gain = gl**2 / (hl + l2) + (g - gl) ** 2 / (h - hl + l2) - g**2 / (h + l2)
            ok = (nl >= min_rows) & (len(rows) - nl >= min_rows)
            if signs.get(f):
                ok &= signs[f] * (weight(g - gl, h - hl) - weight(gl, hl)) >= 0
            gain = np.where(ok, gain, 0)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), f, k)
        _, f, k = best
        if f < 0:
            return me
        go_left = binned[rows, f] <= k
        a, b = rows[go_left], rows[~go_left]
        bounds = [(low, high), (low, high)]
        if signs.get(f):
            middle = float(np.clip((weight(grad[a].sum(), hess[a].sum()) + weight(grad[b].sum(), hess[b].sum())) / 2, low, high))
            bounds = [(low, middle), (middle, high)] if signs[f] > 0 else [(middle, high), (low, middle)]
        left = build(a, grad, hess, level + 1, *bounds[0])
        right = build(b, grad, hess, level + 1, *bounds[1])
        nodes[me] = [f, cuts[f][k], left, right, 0.0]
        return me

    def flat(since: int) -> FlatTrees:
        part = np.array(nodes, dtype=np.float64).reshape(-1, 5)
        return FlatTrees(part[:, 0].astype(np.int64), part[:, 1], part[:, 2].astype(np.int64), part[:, 3].astype(np.int64), part[:, 4], np.array(roots[since:], np.int64), depth, bias)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        roots.append(build(np.arange(len(x)), p - y, np.maximum(p * (1 - p), 1e-9), 0, -np.inf, np.inf))
        margin += flat(len(roots) - 1).margin(x) - bias
    return flat(0)


def _labelled(docs: DataFrame, labels: DataFrame, max_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a bounded sample: at most ``max_rows`` label rows are broadcast, and as many rows collected."""
    sample = (
        labels.select(F.col("doc_id").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .filter("doc_id is not null and quality in (0, 1)")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_rows)
    )
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("quality_rules")
        for batch in it:
            _, feats = statistics(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(list(feats), pa.list_(pa.float64()))], ["doc_id", "quality", "f"])

    # an id of several document rows counts once for each label, with the least of their statistics: never more rows than the sample
    rows = texts.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "quality").mapInArrow(trimmed(batches), "doc_id long, quality int, f array<double>")
    got = rows.groupBy("doc_id", "quality").agg(F.min("f").alias("f")).toPandas()
    return np.array(got["f"].tolist(), dtype=np.float64).reshape(len(got), len(FEATURES)), got["quality"].to_numpy(np.float64)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> FlatTrees | None:
    """Trees for the probability of quality 1; None when the labels lack one of the classes."""
    x, y = _labelled(docs, labels, max_rows)
    if len(np.unique(y)) < 2:
        return None
    order = np.lexsort((*x.T, y))  # the collected order must not matter
    return grow(x[order], y[order], {FEATURES.index(k): v for k, v in MONOTONE.items()})


def judge(base: np.ndarray, feats: np.ndarray, trees: FlatTrees | None, min_probability: float = MIN_PROBABILITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base_failed, probability of quality 1, kept)."""
    failed = (base[:, 0] < 50) | (100 * base[:, 4] > 50 * base[:, 0])
    p = trees.probability(feats) if trees is not None and len(feats) else np.ones(len(feats))
    return failed, p, ~failed & (p >= min_probability)


def quality_rules(docs: DataFrame, trees: FlatTrees | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, the base counts, ``base_failed``, ``kept`` and the trees' ``probability``."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("quality_rules")
        for batch in it:
            base, feats = statistics(batch.column(1))
            failed, p, kept = judge(base, feats, trees)
            columns = [batch.column(0), *(pa.array(base[:, k]) for k in range(len(BASE))), pa.array(failed), pa.array(kept), pa.array(p)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *BASE, "base_failed", "kept", "probability"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(trimmed(batches), f"doc_id long, {', '.join(f'{c} long' for c in BASE)}, base_failed boolean, kept boolean, probability double")


def keep_good(docs: DataFrame, trees: FlatTrees | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` (all columns as they are) that the rules keep."""
    at = docs.columns.index(text_col)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("quality_rules")
        for batch in it:
            yield batch.filter(pa.array(judge(*statistics(batch.column(at)), trees)[2]))

    return docs.mapInArrow(trimmed(batches), docs.schema)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees = train(docs, table(spark, sf_dir, "labels"))
    return quality_rules(docs, trees).select("doc_id", *BASE, "base_failed", "kept", "probability")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_quality_rules": op1_quality_rules}

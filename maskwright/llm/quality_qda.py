"""Operator 2, quality classifier: regularised quadratic discriminant analysis.

Class means and covariances over transformed document statistics are exact sums over all labelled training rows (added
up in Spark; only one matrix per class reaches the driver). Each covariance is shrunk towards a pooled diagonal; its
Cholesky factor and that factor's inverse are computed once, so a batch of scores is one triangular product for each class. A score is
the logistic of the difference of the Mahalanobis log densities plus the log prior ratio.

Edge cases: a null or empty text is scored on all-zero statistics like any other; a null id counts as not held out and
learns nothing; a label row that is null or not 0/1 is ignored; repeated rows are scored each; without both classes in
the training rows every score is the share of label 1 (0.5 without labels); an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.docstats import FEATURES, statistics
from maskwright.llm.support import materialize, table, worker_cache

#: Weight of the shrinkage target in each class covariance.
SHRINKAGE = 0.1
#: Smallest score that counts as label 1.
CUT = 0.3
HELD_OUT_FOLDS = 5


def transform(feats: np.ndarray) -> np.ndarray:
    """Statistics on scales closer to normal: log(ratio + 0.01) for all ratios; the first two are logs of sizes."""
    out = np.log(feats + 0.01)
    out[:, 0] = feats[:, 0]
    out[:, 1] = np.log1p(feats[:, 1])
    return out


@dataclass
class Discriminant:
    means: np.ndarray  # class x feature
    factors: np.ndarray  # Cholesky factors of the shrunk covariances
    inverses: np.ndarray  # of the factors, lower triangular like them
    log_dets: np.ndarray
    log_priors: np.ndarray
    flat: float | None = None  # constant score where one class has no rows

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.flat is not None:
            return np.full(len(x), self.flat)
        logs = []
        for c in (0, 1):
            z = (x - self.means[c]) @ self.inverses[c].T
            logs.append(self.log_priors[c] - 0.5 * (self.log_dets[c] + (z * z).sum(axis=1)))
        return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -60, 60)))


def lower_inverse(factor: np.ndarray) -> np.ndarray:
    """The inverse of a lower triangular matrix, row by row by forward substitution."""
    out = np.zeros_like(factor)
    for k in range(len(factor)):
        out[k] = -factor[k, :k] @ out[:k]
        out[k, k] += 1
        out[k] /= factor[k, k]
    return out


def fit(counts: np.ndarray, sums: np.ndarray, squares: np.ndarray, shrinkage: float = SHRINKAGE) -> Discriminant:
    """From per-class row counts, sums and sums of outer products."""
    d = sums.shape[1]
    if (counts <= 0).any():
        total = counts.sum()
        return Discriminant(np.zeros((2, d)), np.zeros((2, d, d)), np.zeros((2, d, d)), np.zeros(2), np.zeros(2), float(counts[1] / total) if total else 0.5)
    means = sums / counts[:, None]
    covs = squares / counts[:, None, None] - means[:, :, None] * means[:, None, :]
    pooled = np.diag((covs * counts[:, None, None]).sum(axis=0) / counts.sum())
    target = np.diag(np.maximum(pooled, 1e-4))
    shrunk = (1 - shrinkage) * covs + shrinkage * target
    factors = np.linalg.cholesky(shrunk)
    log_dets = 2 * np.log(np.diagonal(factors, axis1=1, axis2=2)).sum(axis=1)
    return Discriminant(means, factors, np.stack([lower_inverse(f) for f in factors]), log_dets, np.log(counts / counts.sum()))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % HELD_OUT_FOLDS == 0, F.lit(False))


def features(docs: DataFrame) -> DataFrame:
    """doc_id and the transformed statistics of every whole text."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("quality_qda")
        for batch in it:
            x = transform(statistics(batch.column(1))[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(batches, "doc_id long, x array<double>")


def train(feats: DataFrame, labels: DataFrame, shrinkage: float = SHRINKAGE) -> Discriminant:
    """Exact class moments of all labelled rows that are not held out. Each task adds up its rows first."""
    d = len(FEATURES)
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality in (0, 1)")
    rows = feats.filter("doc_id is not null").filter(~held_out()).join(known, "doc_id").select("quality", "x")

    def partial(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("quality_qda")
        total = np.zeros((2, 1 + d + d * d))
        for batch in it:
            x = np.asarray(batch.column(1).flatten()).reshape(-1, d)
            y = np.asarray(batch.column(0))
            for c in (0, 1):
                own = x[y == c]
                total[c] += np.concatenate(([len(own)], own.sum(axis=0), (own.T @ own).ravel()))
        keys = np.arange(2 * total.shape[1], dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(total.ravel())], ["k", "v"])

    got = rows.mapInArrow(partial, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    total = np.zeros(2 * (1 + d + d * d))
    for k, v in got:
        total[k] = v
    total = total.reshape(2, -1)
    return fit(total[:, 0], total[:, 1 : 1 + d], total[:, 1 + d :].reshape(2, d, d), shrinkage)


def score(feats: DataFrame, model: Discriminant, cut: float = CUT) -> DataFrame:
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("quality_qda")
        for batch in it:
            s = model.score(np.asarray(batch.column(1).flatten()).reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= cut).astype(np.int32))], ["doc_id", "score", "predicted"])

    return feats.mapInArrow(batches, "doc_id long, score double, predicted int").select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op2_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    feats = materialize(features(table(spark, sf_dir, "documents")), "features")
    return score(feats, train(feats, table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op2_quality_qda": op2_quality_qda}

"""Quality classifier: regularised quadratic discriminant over document statistics.

Each whole text becomes a row of transformed statistics. Class means and
covariances are summed, a batch at a time, over the labelled training rows on the
executors; the driver sees one (size + size^2) table a class. Training reads the
texts of at most ``TRAIN_ROWS`` labels, those with the smallest hashes of their
ids. Covariances are shrunk towards the pooled one and its diagonal, factored once
(Cholesky; the inverse of the triangular factor is kept), and a text's score is a
logistic function of the difference of the two Gaussian log densities.

Defined results: null and empty texts are scored like any other (their
statistics are zeros); labels that are null or without a document don't count; an id
that is labelled several times counts once, as 0 if any of its labels is; rows of
documents that repeat a labelled id all count; with one class
of labels only, or none, every text gets that class's share of the training
rows (0.5 without any); other columns of the input are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stocktake.llm.common import table

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARKS = np.zeros(256, bool)
_MARKS[[33, 35, 36, 37, 38, 42, 43, 60, 61, 62, 64, 92, 94, 95, 96, 123, 124, 125, 126]] = True
FEATURES = 14
#: Labels that are learnt from, at most; their ids are broadcast (16 bytes each).
TRAIN_ROWS = 200_000


def statistics(text: str) -> list[float]:
    """Transformed statistics of one whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = len(words), len(raw)
    if not n:
        return [0.0] * FEATURES
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    counted = Counter(words)
    distinct = len(counted)
    letters = size - int(count[9:14].sum()) - int(count[32])
    share = lambda x, of: float(np.log1p(100.0 * x / of))
    return [
        float(np.log1p(n)),
        float(np.log(letters / n)),
        share(int(count[_UPPER].sum()), letters),
        share(int(count[_MARKS].sum()), letters),
        share(int(count[33]), n),
        share(int(count[124]), n),
        share(int(count[_DIGIT].sum()), letters),
        share(int(count[44] + count[46]), n),
        share(sum(map(eq, words, words[1:])), n),
        share(max(counted.values()), n),
        float(np.log(n / distinct) / np.log1p(n)),
        share(sum(map(bytes.isupper, words)), n),
        share(raw.count(b"\n") + 1, n),
        share(sum(1 for w in words if len(w) > 2 and w[-1] == w[-2] and w[-1] < 65), n),
    ]


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = pa.array([statistics(t or "") for t in b["text"].to_pylist()], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([b["doc_id"], x], ["doc_id", "x"])


def document_statistics(docs: DataFrame) -> DataFrame:
    """``(doc_id, x)``: one row of statistics for each row of ``docs``."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_featurise, "doc_id long, x array<double>")


def lower_inverse(factor: np.ndarray) -> np.ndarray:
    """The inverse of a lower triangular matrix, by forward substitution."""
    out = np.zeros_like(factor)
    for i in range(len(factor)):
        out[i] = -factor[i, :i] @ out[:i]
        out[i, i] += 1.0
        out[i] /= factor[i, i]
    return out


@dataclass
class Discriminant:
    """A fitted model; ``factors`` are the Cholesky factors of the classes' covariances, ``inverses`` theirs."""

    means: list[np.ndarray]
    factors: list[np.ndarray]
    log_priors: list[float]
    scale: float = 1.0
    flat: float | None = None
    inverses: list[np.ndarray] = field(init=False)

    def __post_init__(self) -> None:
        self.inverses = [lower_inverse(f) for f in self.factors]

    def log_density(self, x: np.ndarray, k: int) -> np.ndarray:
        z = self.inverses[k] @ (x - self.means[k]).T
        return self.log_priors[k] - np.log(np.diag(self.factors[k])).sum() - 0.5 * (z * z).sum(axis=0)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.flat is not None:
            return np.full(len(x), self.flat)
        gap = (self.log_density(x, 1) - self.log_density(x, 0)) / self.scale
        return 1.0 / (1.0 + np.exp(-np.clip(gap, -500, 500)))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each class of a task the sums of all products of ``(1, x)`` with itself."""
    m = np.zeros((2, FEATURES + 1, FEATURES + 1))
    for b in batches:
        x = np.array([[1.0, *statistics(t or "")] for t in b["text"].to_pylist()]).reshape(-1, FEATURES + 1)
        y = b["y"].to_numpy()
        for k in (0, 1):
            m[k] += x[y == k].T @ x[y == k]
    yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array([c.ravel() for c in m], pa.list_(pa.float64()))], ["y", "m"])


def fit(rows: DataFrame, to_pooled: float = 0.1, to_diagonal: float = 0.02, ridge: float = 1e-3, scale: float = 1.0) -> Discriminant:
    """Fit on ``rows(text, y)``: sums over all rows are made on the executors, ``(1 + d)^2`` numbers a class return."""
    sums = rows.where("y in (0, 1)").select("text", "y").mapInArrow(_moments, "y int, m array<double>")
    d = FEATURES + 1
    m = np.zeros((2, d * d))
    for r in sums.select("y", F.posexplode("m")).groupBy("y", "pos").agg(F.sum("col").alias("s")).collect():
        m[r["y"], r["pos"]] = r["s"]
    m = m.reshape(2, d, d)
    n = m[:, 0, 0]
    if n.min() < 2:
        return Discriminant([], [], [], flat=float(n[1] / n.sum()) if n.sum() else 0.5)
    means = [m[k][0, 1:] / n[k] for k in (0, 1)]
    covs = [m[k][1:, 1:] / n[k] - np.outer(means[k], means[k]) for k in (0, 1)]
    pooled = (n[0] * covs[0] + n[1] * covs[1]) / n.sum()
    spread = np.diag(pooled) + ridge
    factors = []
    for c in covs:
        c = (1 - to_pooled) * c + to_pooled * pooled
        c = (1 - to_diagonal) * c + to_diagonal * np.diag(np.diag(c))
        factors.append(np.linalg.cholesky(c + np.diag(ridge + 1e-3 * spread)))
    return Discriminant(means, factors, [float(np.log(n[k] / n.sum())) for k in (0, 1)], scale)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score_table(stats: DataFrame, model: Discriminant) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b["x"].flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, FEATURES)
                yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(model.score(x))], ["doc_id", "score"])

    return stats.mapInArrow(run, "doc_id long, score double")


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Discriminant:
    """Only labels outside the held-out fifth are read, and only the texts of ``most`` of them."""
    marks = labels.where("quality in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("y"))
    marks = marks.groupBy("id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return fit(texts.join(F.broadcast(marks), "id"))


def quality_scores(docs: DataFrame, labels: DataFrame, cut: float = 0.3) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``."""
    scored = score_table(document_statistics(docs), train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, cut: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that score at least ``cut``; texts don't move."""
    model = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.array([statistics(t or "") for t in b["text"].to_pylist()])
                yield b.filter(pa.array(model.score(x) >= cut))

    return docs.mapInArrow(run, docs.schema)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

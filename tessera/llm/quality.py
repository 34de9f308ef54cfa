"""Document quality by regularised quadratic discriminant analysis.

Each text becomes a vector of transformed statistics. Per class a Gaussian
with a shrunken covariance is fitted; a score is the difference of the two
log densities (Mahalanobis terms through Cholesky factors computed once),
calibrated to a probability on the fitting rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table, text_or_empty

FOLDS, THRESHOLD = 5, 0.3
#: Labelled rows that the classifier is fitted on, at most: those whose ids hash lowest.
FIT_ROWS = 20_000
FEATURES = 18
_PUNCTUATION = np.frombuffer(b".,;:?'\"-()", np.uint8)
_SYMBOLS = np.array([c for c in range(33, 127) if not chr(c).isalnum() and c not in _PUNCTUATION and c != ord("!")])


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of a whole text; the empty text has a vector of its own like any other."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    c = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = max(1, len(raw))
    words, lines = text.split(), text.split("\n")
    size = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    k = max(1, len(words))
    kinds = len(set(words))
    p = c[c > 0] / n
    upper = c[65:91].sum()
    letters = max(1, upper + c[97:123].sum() + c[128:].sum())
    pairs = len(set(zip(words, words[1:])))
    share = lambda x, of: float(np.sqrt(x / of))
    return [
        float(np.log1p(len(words))), float(size.mean()), float(np.log1p(size.std())), float(np.log1p(size.max())),
        share(upper, letters), share(c[48:58].sum(), n), share(c[_SYMBOLS].sum(), n), share(c[33], n), share(c[_PUNCTUATION].sum(), n),
        share(c[32] + c[9:14].sum(), n), share(c[10], n), share(c[128:].sum(), n),
        kinds / k, pairs / max(1, len(words) - 1), len(set(lines)) / len(lines), float(np.log1p(len(text) / len(lines))),
        float(-(p * np.log2(p)).sum()) if len(raw) else 0.0, share(sum(map(str.isupper, words)), k),
    ]


class Discriminant:
    """Two Gaussians with covariance (1 - a) S_class + a S_pooled + ridge, and a calibrated log-density difference."""

    def __init__(self, x: np.ndarray, y: np.ndarray, shrink: float = 0.3, ridge: float = 0.02):
        self.ready = len(np.unique(y)) == 2
        if not self.ready:
            self.only = float(y.mean()) if len(y) else 0.5
            return
        self.mid, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = np.clip((x - self.mid) / self.scale, -8, 8)
        pooled = sum(np.cov(z[y == k], rowvar=False, bias=True) * (y == k).mean() for k in (0, 1))
        self.parts = []
        for k in (0, 1):
            own = z[y == k]
            s = (1 - shrink) * np.cov(own, rowvar=False, bias=True) + shrink * pooled + ridge * np.eye(z.shape[1])
            low = np.linalg.cholesky(s)
            self.parts.append((own.mean(axis=0), np.linalg.inv(low), float(np.log(np.diag(low)).sum())))
        m = self._margin(x)
        self.a, self.b = 0.1, 0.0
        for _ in range(50):  # logistic calibration by Newton steps, slightly held back
            q = 1 / (1 + np.exp(-np.clip(self.a * m + self.b, -30, 30)))
            w = q * (1 - q) + 1e-6
            g = np.array([((q - y) * m).sum() + 1e-2 * self.a, (q - y).sum()])
            h = np.array([[(w * m * m).sum() + 1e-2, (w * m).sum()], [(w * m).sum(), w.sum() + 1e-6]])
            d = np.linalg.solve(h, g)
            self.a, self.b = self.a - d[0], self.b - d[1]
            if abs(d).max() < 1e-9:
                break

    def _margin(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mid) / self.scale, -8, 8)
        dense = [-0.5 * (((z - mean) @ inverse.T) ** 2).sum(axis=1) - logdet for mean, inverse, logdet in self.parts]
        return np.clip(dense[1] - dense[0], -60, 60)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.ready:
            return np.full(len(x), self.only)
        return 1 / (1 + np.exp(-np.clip(self.a * self._margin(x) + self.b, -30, 30)))


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"quality": pdf["quality"], "x": [statistics(t) for t in pdf["text"]]})


def fold(col: str = "doc_id"):
    """crc32 of the id as text, modulo the folds; 0 is held out. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % FOLDS


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Discriminant:
    """Fits on labelled documents outside the held-out fold, ``rows`` of them at most; of an id that several rows have, on the text that hashes lowest."""
    known = labels.where("quality in (0, 1) and doc_id is not null").where(fold() != 0).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(known), "doc_id")
    sample = sample.groupBy("doc_id", "quality").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("quality", "text")
    got = sample.mapInPandas(_features, "quality int, x array<double>").toPandas()
    order = np.lexsort(np.array(got["x"].tolist()).T) if len(got) else []
    x = np.array(got["x"].tolist()).reshape(-1, FEATURES)[order]
    return Discriminant(x, got["quality"].to_numpy(float)[order])


def score(docs: DataFrame, model: Discriminant) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; only the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.array([statistics(t) for t in pdf["text"]]).reshape(-1, FEATURES)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "held_out": pdf["held_out"], "score": shared.value.score(x)})

    rows = docs.select(F.col("doc_id").cast("long"), (fold() == 0).alias("held_out"), text_or_empty().alias("text"))
    return rows.mapInPandas(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are predicted good, all columns as they are; fitted on what ``labels`` says of them."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.array([statistics(t) for t in batch.column("text").to_pylist()]).reshape(-1, FEATURES)
                batch = batch.filter(pa.array(shared.value.score(x) >= THRESHOLD))
            yield batch

    return docs.mapInArrow(run, docs.schema)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of all ``documents``, fitted on ``labels``.

    Null and empty texts have a score like any other; null or repeated ids
    keep their rows; without labels of both kinds all scores are the labels'
    mean, or one half; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))

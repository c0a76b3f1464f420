"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class is a Gaussian whose covariance is shrunk towards a multiple of the identity (in units of the pooled spread) by
the oracle-approximating rule; a document's score comes from the difference of the two log densities, whose Mahalanobis
distances use Cholesky factors that are computed once with the model.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, bound_batches, map_rows, stored, texts

NAMES = ("log_chars", "log_words", "word_length", "upper", "digit", "symbol", "stop", "space", "bar", "shout", "wide", "distinct", "line_repeat", "line_length", "capital_words", "short_words")
_KIND = np.zeros((8, 256))
for _row, _bytes in enumerate((range(65, 91), range(48, 58), b"#$%&*<>{}[]^_=+@~\\/", b".,;:?", b" \t\n\r\x0b\x0c", b"|", b"!", range(128, 256))):
    _KIND[_row, list(_bytes)] = 1
#: The least share of the identity in a class covariance.
LEAST_SHRINKAGE = 1e-3


def statistics(text: str) -> list[float]:
    """Transformed statistics of a whole text, none infinite; an empty text has its own point."""
    raw = text.encode("utf-8", "replace")
    n = len(raw)
    words = raw.split()
    w = len(words)
    upper, digit, symbol, stop, space, bar, shout, wide = (_KIND @ np.bincount(np.frombuffer(raw, np.uint8), minlength=256)).tolist()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    root = lambda x, of: math.sqrt(x / max(1, of))
    many = len(set(words))
    return [
        math.log1p(n), math.log1p(w), math.log1p(n / max(1, w)), root(upper, n), root(digit, n), root(symbol, n), root(stop, n), root(space, n), root(bar, n), root(shout, n), root(wide, n),
        math.log((many + 1) / (w + 1)) / math.log(w + 2), root(len(lines) - len(set(lines)), len(lines)), math.log1p(n / max(1, len(lines))), root(sum(x[:1].isupper() for x in words), w), root(sum(len(x) < 4 for x in words), w),
    ]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, x (the statistics in the order of NAMES) of every row; a null text counts as empty."""
    bound_batches(docs.sparkSession)
    return map_rows(texts(docs, id_col, text_col), lambda c: {"doc_id": c["doc_id"], "x": [statistics(t) for t in c["text"]]}, "doc_id long, x array<double>")


@dataclass
class Model:
    """Per class (0, 1): mean, inverse of the Cholesky factor of the shrunk covariance, half its log determinant, log prior; spread: units."""

    mean: np.ndarray
    spread: np.ndarray
    centres: list[np.ndarray]
    factors: list[np.ndarray]
    half_logdet: list[float]
    log_prior: list[float]
    shrinkage: list[float]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z, density = (x - self.mean) / self.spread, []
        for c, f, d, p in zip(self.centres, self.factors, self.half_logdet, self.log_prior, strict=True):
            m = f @ (z - c).T
            density.append(p - d - 0.5 * (m * m).sum(0))
        return density[1] - density[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -35, 35)))


def oas(s: np.ndarray, n: int) -> float:
    """Oracle-approximating shrinkage intensity of a sample covariance of n rows."""
    p, tr, tr2 = len(s), np.trace(s), float((s * s).sum())
    below = (n + 1 - 2 / p) * (tr2 - tr * tr / p)
    return min(1.0, max(LEAST_SHRINKAGE, ((1 - 2 / p) * tr2 + tr * tr) / below if below > 0 else 1.0))


def discriminant(moments: dict[int, tuple[int, np.ndarray, np.ndarray]]) -> Model:
    """From each class's count, sums and sums of products. A class without rows takes the pooled Gaussian and a prior of one row."""
    p = len(NAMES)
    none = (0, np.zeros(p), np.zeros((p, p)))
    own = [moments.get(y, none) for y in (0, 1)]
    n = sum(m[0] for m in own)
    mean = sum(m[1] for m in own) / max(1, n)
    pooled = sum(m[2] for m in own) / max(1, n) - np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.diag(pooled), 1e-12))
    spread[spread < 1e-5] = 1.0
    out = Model(mean, spread, [], [], [], [], [])
    for k, s, ss in own:
        if k < 2:
            centre, cov, few = np.zeros(p), pooled / np.outer(spread, spread), max(2, n)
        else:
            centre, cov, few = (s / k - mean) / spread, (ss / k - np.outer(s / k, s / k)) / np.outer(spread, spread), k
        cov = (cov + cov.T) / 2
        a = oas(cov, few)
        shrunk = (1 - a) * cov + a * max(np.trace(cov) / p, 1e-3) * np.eye(p)
        factor = np.linalg.cholesky(shrunk + 1e-6 * np.eye(p))
        out.centres.append(centre)
        out.factors.append(np.linalg.inv(factor))  # once, so that a batch costs one product
        out.half_logdet.append(float(np.log(np.diag(factor)).sum()))
        out.log_prior.append(math.log((k + 1) / (n + 2)))
        out.shrinkage.append(a)
    return out


def fit(feats: DataFrame, labels: DataFrame, learn: Column | None = None, label_col: str = "quality", id_col: str = "doc_id") -> Model:
    """Moments of all labelled rows for which `learn` holds: each task sums its rows, and Spark the tasks' sums by class and cell.

    Null labels and ids are left out; of repeated ids in labels the larger label counts.
    """
    p = len(NAMES)
    own = labels.filter((F.lit(True) if learn is None else learn) & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg((F.max(label_col) > 0).cast("int").alias("y"))
    out = arrow_schema("y int, cell int, v double")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {y: np.zeros(1 + p + p * p) for y in (0, 1)}
        for b in batches:
            y, x = b.column(1).to_numpy(), np.array(b.column(0).to_pylist(), float).reshape(-1, p)
            for k in (0, 1):
                z = x[y == k]
                held[k] += np.concatenate([[len(z)], z.sum(0), (z.T @ z).ravel()])
        for k, v in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), k), pa.int32()), pa.array(np.arange(len(v)), pa.int32()), pa.array(v)], schema=out)

    cells = feats.join(own, "doc_id").select("x", "y").mapInArrow(sums, "y int, cell int, v double").groupBy("y", "cell").agg(F.sum("v").alias("v"))
    moments: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
    got = {y: np.zeros(1 + p + p * p) for y in (0, 1)}
    for r in cells.collect():  # 2 * (1 + p + p * p) rows
        got[r.y][r.cell] = r.v
    for y, v in got.items():
        moments[y] = int(v[0]), v[1 : 1 + p], v[1 + p :].reshape(p, p)
    return discriminant(moments)


def score(feats: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted of every row of features()."""

    def make(c: dict) -> dict:
        s = model.scores(np.array(c["x"], float).reshape(-1, len(NAMES)))
        return {"doc_id": c["doc_id"], "score": s, "predicted": (s >= 0.5).astype(int)}

    return map_rows(feats, make, "doc_id long, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, learn: Column | None = None, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every row of docs. Texts are read once; statistics, some numbers a row, are stored between the passes.

    Null and empty texts get the score of their statistics; repeated rows equal scores; empty docs give no rows.
    """
    feats = stored(features(docs, id_col, text_col), "statistics")
    return score(feats, fit(feats, labels, learn, label_col, id_col))

"""Text quality by a regularised quadratic discriminant over document statistics.

One pass computes the statistics of every whole text (:func:`statistics`).  The
model is fitted on a bounded sample of labelled rows: per class a mean and a
covariance shrunk towards the pooled diagonal, whose Cholesky factor is kept.
A score is the logistic of the difference of the two log-densities
(Mahalanobis distance and log-determinant, both from the factors), tempered on
the fitted rows so that it can be read as a probability.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .memory import hold
from .shared import bounded, fold, labels_by_id, map_text, need

STATISTICS = (
    "log_words", "log_word_length", "distinct_share", "top_share", "pair_share", "line_share", "log_line_words",
    "upper_share", "digit_share", "mark_share", "symbol_share", "other_share", "plain_share",
)
_EMPTY = np.zeros(len(STATISTICS))
_KIND = np.zeros(256, dtype=np.int64)  # of a UTF-8 byte: 0 other, 1 space, 2 lower, 3 upper, 4 digit, 5 mark, 6 symbol, 7 beyond ASCII
_KIND[[0x20, 9, 10, 11, 12, 13]] = 1
_KIND[ord("a") : ord("z") + 1] = 2
_KIND[ord("A") : ord("Z") + 1] = 3
_KIND[ord("0") : ord("9") + 1] = 4
_KIND[[ord(c) for c in ".,;:!?'\"()-"]] = 5
_KIND[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 6
_KIND[128:] = 7


def statistics(text: str) -> np.ndarray:
    """The statistics of a whole text, each transformed to be roughly normal; zeros for a text without words."""
    words = text.split()
    n = len(words)
    if not n:
        return _EMPTY
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    kind = np.bincount(_KIND[raw], minlength=8).astype(float)
    visible = max(1.0, kind.sum() - kind[1])
    letters = max(1.0, kind[2] + kind[3] + kind[7])
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    plain = sum(c for w, c in counts.items() if w.strip(".,;:!?'\"()-").isalpha())
    log = lambda x: float(np.log(x + 1e-3))
    expect = n**0.8  # distinct words grow more slowly than the text (Heaps)
    return np.array([
        np.log1p(n), np.log(visible / n), np.log(len(counts) / expect), log(max(counts.values()) / n), log(1 - len(set(zip(words, words[1:]))) / max(1, n - 1)), log(1 - len(set(lines)) / len(lines)), np.log1p(n / len(lines)),
        log(kind[3] / letters), log(kind[4] / visible), log(kind[5] / visible), log(kind[6] / visible), log(kind[0] / visible), log(1 - plain / n),
    ])


@dataclass(frozen=True)
class Discriminant:
    """``base`` is the score where a class has no labelled row: 1 or 0 for the class that is there, 0.5 without labels."""

    base: float
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None
    means: np.ndarray | None = None
    factors: np.ndarray | None = None  # inverse Cholesky factors of the class covariances
    logdets: np.ndarray | None = None
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        """log-density of class 1 less that of class 0."""
        z = (x - self.centre) / self.scale
        logs = [-0.5 * (((z - m) @ f.T) ** 2).sum(1) - 0.5 * d for m, f, d in zip(self.means, self.factors, self.logdets, strict=True)]
        return logs[1] - logs[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.base)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.shift, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, shrink: float = 0.1) -> Discriminant:
    """Fits on rows of statistics and 0/1 labels. ``shrink`` is the weight of the pooled diagonal."""
    y = np.asarray(y, dtype=int)
    if not len(y) or y.min() == y.max():
        return Discriminant(base=float(y[0]) if len(y) else 0.5)
    centre, scale = x.mean(0), x.std(0) + 1e-6
    z = (x - centre) / scale
    pooled = np.diag(np.mean([np.var(z[y == k], axis=0) for k in (0, 1)], axis=0) + 1e-3)
    means, factors, logdets = [], [], []
    for k in (0, 1):
        own = z[y == k]
        w = max(shrink, min(1.0, 2 * x.shape[1] / len(own)))  # few rows: nearer to the pooled diagonal
        cov = (1 - w) * np.cov(own.T, bias=True) + w * pooled
        low = np.linalg.cholesky(cov)
        means.append(own.mean(0))
        factors.append(np.linalg.inv(low))
        logdets.append(2 * np.log(np.diag(low)).sum())
    raw = Discriminant(0.5, centre, scale, np.array(means), np.array(factors), np.array(logdets))
    slope, shift = _temper(raw.margin(x), y)
    return Discriminant(0.5, centre, scale, raw.means, raw.factors, raw.logdets, slope, shift)


def _temper(m: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of a logistic curve through margins (Newton's method, lightly regularised; the slope stays positive)."""
    m = np.clip(m, -30, 30)
    a = np.array([1.0, 0.0])
    x = np.stack([m, np.ones_like(m)], 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -40, 40)))
        grad = x.T @ (p - y) + 1e-2 * (a - [1, 0])
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        a = a - step / max(1.0, float(np.abs(step).max()))
        if np.abs(step).max() < 1e-7:
            break
    return max(float(a[0]), 0.05), float(a[1])


def train(docs: DataFrame, labels: DataFrame, trainable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = 20_000) -> Discriminant:
    """Fits on whole texts of labelled rows.

    Labels are taken from rows of ``labels`` where ``trainable`` (a Column over
    ``id_col``) holds and the label is 0 or 1; an id with both labels has none.
    Of more than ``max_labelled`` such ids those with the smallest hash are used,
    and of more texts than that (an id may have several) as many.
    """
    need(docs, id_col, text_col)
    known = bounded(labels_by_id(labels, id_col, label_col, trainable), max_labelled, F.xxhash64("__id"), F.col("__id"))
    own = docs.select(id_col, F.col(text_col).alias("text")).join(F.broadcast(known), F.col(id_col) == F.col("__id"))  # at most max_labelled ids
    rows = map_text(own, "text", ["__y", "__id"], [(s, "double") for s in STATISTICS], lambda: hold(("quality",)) or _columns)
    rows = rows.orderBy(F.xxhash64("__id"), "__id", *STATISTICS, "__y").limit(max_labelled).toPandas()
    return fit(rows[list(STATISTICS)].to_numpy(float), rows["__y"].to_numpy())


def _columns(texts: list[str | None]) -> list[pa.Array]:
    return [pa.array(c) for c in np.array([statistics(t or "") for t in texts]).reshape(len(texts), len(STATISTICS)).T]


def quality_scores(docs: DataFrame, model: Discriminant, carry: tuple[str, ...] = ("doc_id",), text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Columns ``carry`` and ``score_col`` (0 to 1, higher: better) of every row of ``docs``.

    A null or empty text has all statistics 0 and a score like any other.
    Without labels every score is 0.5; with one class only, its label.  Repeated
    rows give repeated scores; an empty table gives an empty result.
    """

    def score(texts: list[str | None]) -> list[pa.Array]:
        x = np.array([statistics(t or "") for t in texts]).reshape(len(texts), len(STATISTICS))
        return [pa.array(model.score(x), pa.float64())]

    return map_text(docs, text_col, list(carry), [(score_col, "double")], lambda: hold(("quality",)) or score)


def quality_fold(id_col: str = "doc_id"):
    """The rows that are held out: crc32 of the id, modulo 4, is 2."""
    return fold(id_col, 4) == 2

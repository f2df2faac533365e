"""Toxicity: cumulative-link ordinal regression on word indicators.

P(grade <= k) = logistic(theta_k - w·x): all thresholds share the weights and stay in order because each lies an
exponential above the one before.  The result is the expected severity, the probability of any toxicity and the grade
that the thresholds give.

Labels say only whether a document is toxic.  If there are more than two label values they are the grades; otherwise the
toxic rows of the sample are graded by how many features they have that mark toxic rows (``MARK`` times as likely there
as elsewhere): 1 up to the median number, 2 above it.  Only features whose association with toxicity exceeds ``SCREEN``
standard deviations enter the model, so the many rare words of long texts add no noise.

A document is toxic from a probability of ``THRESHOLD`` on, which lies in the gap between the classes of held-out rows.

The model is fitted in one task on a sample of at most ``sample`` labelled rows outside the held-out fold (default
12,000).  Defined cases: null and empty texts have no words and get the severity that the thresholds alone give;
without labels, or without toxic ones, nothing is toxic; an
empty table gives no rows; further columns are ignored by ``grade`` and kept by ``drop_toxic``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from paperloom.llm import features as ft
from paperloom.llm import labelled

SAMPLE = 12_000
THRESHOLD = 0.25
MIN_ROWS, MARK, SCREEN, STEPS, RATE, DECAY = 3, 20.0, 6.0, 600, 0.1, 1e-4


def grades_of(label: np.ndarray, starts: np.ndarray, feature: np.ndarray) -> np.ndarray:
    if len(np.unique(label)) > 2:
        return np.unique(label, return_inverse=True)[1]
    toxic = label > 0
    of_toxic = np.repeat(toxic, np.diff(starts))
    there = np.bincount(feature[of_toxic], minlength=ft.DIMS)
    here = np.bincount(feature[~of_toxic], minlength=ft.DIMS)
    marks = (there >= MIN_ROWS) & ((there / max(toxic.sum(), 1)) >= MARK * (here + 0.5) / max((~toxic).sum(), 1))
    marked = np.append(0, np.cumsum(marks[feature], dtype=np.int64))
    many = marked[starts[1:]] - marked[starts[:-1]]
    middle = np.median(many[toxic]) if toxic.any() else 0.0
    return np.where(toxic, np.where(many > middle, 2, 1), 0)


def screened(label: np.ndarray, starts: np.ndarray, feature: np.ndarray) -> np.ndarray:
    """Features that toxic rows have far more, or far less, often than chance allows."""
    toxic = label > 0
    n, share = np.bincount(feature, minlength=ft.DIMS), toxic.mean()
    z = (np.bincount(feature[np.repeat(toxic, np.diff(starts))], minlength=ft.DIMS) - n * share) / np.sqrt(n * share * (1 - share) + 1e-9)
    return np.flatnonzero((np.abs(z) > SCREEN) & (n >= MIN_ROWS))


def fit(label: np.ndarray, starts: np.ndarray, feature: np.ndarray) -> dict[str, np.ndarray]:
    """Weights and thresholds by full gradients with adaptive steps."""
    n = len(label)
    if n == 0 or not (label > 0).any() or not (label <= 0).any():
        return {"at": np.zeros(0), "w": np.zeros(0), "theta": np.array([-30.0 if n and (label > 0).any() else 30.0])}
    grade, at = grades_of(label, starts, feature), screened(label, starts, feature)
    k, d = int(grade.max()), len(at)
    place = np.full(ft.DIMS, -1)
    place[at] = np.arange(d)
    on = place[feature] >= 0
    row, feature = np.repeat(np.arange(n, dtype=np.int32), np.diff(starts))[on], place[feature[on]]
    counts = np.array([(grade <= j).sum() for j in range(k)]) + 0.5
    theta = np.log(counts / (n + 1 - counts))
    p = np.concatenate([np.zeros(d), [theta[0]], np.log(np.maximum(np.diff(theta), 1e-3))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    each = np.arange(n)
    for t in range(1, STEPS + 1):
        w, theta = p[:d], p[d] + np.append(0, np.cumsum(np.exp(p[d + 1 :])))
        z = np.bincount(row, weights=w[feature], minlength=n)
        bounds = np.concatenate([np.full((n, 1), -np.inf), theta[None, :] - z[:, None], np.full((n, 1), np.inf)], axis=1)
        hi, lo = _logistic(bounds[each, grade + 1]), _logistic(bounds[each, grade])
        # slopes of log(hi - lo) in its two bounds, kept finite when both are near 0 or 1
        width = np.maximum(hi - lo, 1e-12)
        up, down = hi * (1 - hi) / width, lo * (1 - lo) / width
        slope = (up - down) / n
        g_theta = np.array([(down[grade == j + 1].sum() - up[grade == j].sum()) / n for j in range(k)])
        steps = np.cumsum(g_theta[::-1])[::-1]
        g = np.concatenate([np.bincount(feature, weights=slope[row], minlength=d) + DECAY * w, steps[:1], steps[1:] * np.exp(p[d + 1 :])])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return {"at": at, "w": p[:d], "theta": p[d] + np.append(0, np.cumsum(np.exp(p[d + 1 :])))}


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> dict[str, np.ndarray]:
    rows = labelled.sample_features(docs, labels, label, ft.word_features, sample, doc, text)
    model = labelled.fit_in_one_task(rows, fit)
    return model or fit(np.zeros(0, dtype=np.int64), np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.int64))


def grade(docs: DataFrame, model: dict[str, np.ndarray], doc: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc, held_out, severity, p_toxic, grade, toxic) of every whole text; the weights travel with the tasks."""
    at, weights, theta = model["at"].astype(np.int64), model["w"], model["theta"]

    def scored(row, feature, n):
        w = np.zeros(ft.DIMS)
        w[at] = weights
        z = np.bincount(row, weights=w[feature], minlength=n)
        above = _logistic(z[:, None] - theta[None, :])
        return above.sum(axis=1), above[:, 0], (above > 0.5).sum(axis=1).astype(np.int32), above[:, 0] > threshold

    return labelled.score_rows(docs, doc, text, ft.word_features, scored, "severity double, p_toxic double, grade int, toxic boolean")


def drop_toxic(docs: DataFrame, model: dict[str, np.ndarray], doc: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose probability of toxicity stays below the threshold; decided in their row, nothing moves."""
    import pyarrow as pa

    from paperloom.llm import textbatch as tb

    at, weights, theta = model["at"].astype(np.int64), model["w"], model["theta"]

    def work(batches):
        w = np.zeros(ft.DIMS)
        w[at] = weights
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i, j, row, feature in ft.pieces(batch.column(text), ft.word_features):
                keep[i:j] = _logistic(np.bincount(row, weights=w[feature], minlength=j - i) - theta[0]) <= threshold
            yield batch.filter(pa.array(keep))

    return tb.small_batches(docs).mapInArrow(work, docs.schema)

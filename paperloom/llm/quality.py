"""Quality classifier: Naive Bayes features under a linear support vector machine.

Features are indicators of words, word pairs and runs of shapes.  Each is scaled by its log-count ratio between the two
classes, a document's vector is brought to length one, and a hinge-loss model is fitted by dual coordinate descent.  The
margin becomes a probability by a logistic curve fitted on a fifth of the sample that a first model has not seen.

The model is fitted in one task on a sample of at most ``sample`` labelled rows outside the held-out fold (default
12,000; about 4 bytes a distinct feature of each).  Defined cases: null and empty texts have no features and get the
model's base score; features in fewer than three sample rows count nothing; without labels every score is 0.5; with one
class only, every score is near that class; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from paperloom.llm import features as ft
from paperloom.llm import labelled

SAMPLE = 12_000
MIN_ROWS, COST, ROUNDS = 3, 1.0, 5
THRESHOLD = 0.3


def log_count_ratios(label: np.ndarray, starts: np.ndarray, feature: np.ndarray, rows: np.ndarray) -> np.ndarray:
    used = np.zeros(len(label), dtype=bool)
    used[rows] = True
    good = np.bincount(feature[np.repeat(used & (label > 0), np.diff(starts))], minlength=ft.DIMS) + 1.0
    bad = np.bincount(feature[np.repeat(used & (label <= 0), np.diff(starts))], minlength=ft.DIMS) + 1.0
    ratio = np.log((good / good.sum()) / (bad / bad.sum()))
    ratio[good + bad < MIN_ROWS + 2] = 0
    return ratio


def dual_coordinate_descent(label: np.ndarray, starts: np.ndarray, feature: np.ndarray, ratio: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, float]:
    """(weights of the scaled features, bias) of the hinge-loss model; one dual variable is solved at a time."""
    sign = np.where(label > 0, 1.0, -1.0)
    ends = np.append(starts[1:], len(feature))
    length = np.array([np.linalg.norm(ratio[feature[a:b]]) for a, b in zip(starts, ends)])
    w, bias, alpha = np.zeros(ft.DIMS), 0.0, np.zeros(len(label))
    order = np.random.default_rng(7)
    for _ in range(ROUNDS):
        for i in order.permutation(rows):
            f = feature[starts[i] : ends[i]]
            v = ratio[f] / (length[i] or 1.0)
            slope = sign[i] * (v @ w[f] + bias) - 1
            new = min(max(alpha[i] - slope / (v @ v + 1), 0.0), COST)
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                w[f] += step * v
                bias += step
                alpha[i] = new
    return w, bias


def margins(w: np.ndarray, bias: float, ratio: np.ndarray, row: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
    v = ratio[feature]
    length = np.sqrt(np.bincount(row, weights=v * v, minlength=n))
    return np.bincount(row, weights=v * w[feature], minlength=n) / np.where(length > 0, length, 1) + bias


def logistic_curve(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """(slope, shift) of the probability of label 1, with targets drawn in from 0 and 1; slope is never negative."""
    good = (label > 0).sum()
    high, low = (good + 1) / (good + 2), 1 / (len(label) - good + 2)
    target = np.where(label > 0, high, low)
    a, b = 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -35, 35)))
        g = np.array([(margin * (p - target)).sum() + 1e-3 * a, (p - target).sum()])
        s = p * (1 - p) + 1e-9
        h = np.array([[(s * margin * margin).sum() + 1e-3, (s * margin).sum()], [(s * margin).sum(), s.sum()]])
        step = np.linalg.solve(h + 1e-6 * np.eye(2), g)
        size = np.abs(step).max()
        a, b = a - step[0] * min(1, 2 / size if size else 1), b - step[1] * min(1, 2 / size if size else 1)
        if size < 1e-8:
            break
    return max(float(a), 0.0), float(b)


def fit(label: np.ndarray, starts: np.ndarray, feature: np.ndarray) -> dict[str, np.ndarray]:
    everyone = np.arange(len(label))
    if len(label) == 0:
        return {"ratio": np.zeros(ft.DIMS), "w": np.zeros(ft.DIMS), "rest": np.array([0.0, 1.0, 0.0])}
    aside = everyone[everyone % 5 == 0]
    first = np.setdiff1d(everyone, aside) if len(label) >= 10 else everyone
    ratio = log_count_ratios(label, starts, feature, first)
    w, bias = dual_coordinate_descent(label, starts, feature, ratio, first)
    seen = np.concatenate([feature[starts[i] : starts[i + 1]] for i in aside])
    row = np.repeat(np.arange(len(aside)), [starts[i + 1] - starts[i] for i in aside])
    slope, shift = logistic_curve(margins(w, bias, ratio, row, seen, len(aside)), label[aside])
    ratio = log_count_ratios(label, starts, feature, everyone)
    w, bias = dual_coordinate_descent(label, starts, feature, ratio, everyone)
    return {"ratio": ratio, "w": w, "rest": np.array([bias, slope, shift])}


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", doc: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> dict[str, np.ndarray]:
    rows = labelled.sample_features(docs, labels, label, ft.style_features, sample, doc, text)
    model = labelled.fit_in_one_task(rows, fit)
    return model or fit(*(np.zeros(0, dtype=np.int64), np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.int64)))


def score(docs: DataFrame, model: dict[str, np.ndarray], doc: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc, held_out, score, predicted) of every whole text; the model (about 1 MB) travels with the tasks."""
    ratio, w = model["ratio"].astype(np.float32), model["w"].astype(np.float32)
    bias, slope, shift = model["rest"]

    def scored(row, feature, n):
        p = 1 / (1 + np.exp(-np.clip(slope * margins(w, bias, ratio, row, feature, n) + shift, -35, 35)))
        return p, (p >= threshold).astype(np.int32)

    return labelled.score_rows(docs, doc, text, ft.style_features, scored, "score double, predicted int")

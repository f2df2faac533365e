"""The trained operators' arithmetic against plain versions: TF-IDF vectors, class ratios, dual solution, likelihood."""

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from paperloom.llm import features as ft
from paperloom.llm import langid, quality, toxicity


def sparse(rng, rows, dims, label):
    """Random feature sets; label 1 prefers the first third of the features."""
    sets = [np.unique(np.where(rng.random(12) < 0.5, rng.integers(0, dims // 3, 12) + (0 if y > 0 else dims // 3), rng.integers(0, dims, 12))) for y in label]
    return np.cumsum([0, *map(len, sets)]), np.concatenate(sets), sets


def test_vectors_are_tf_idf_of_length_one():
    texts = ["the cat and the dog", "der hund und die katze", "the", ""]
    counts = langid._counts(texts)
    idf = np.log(1 + 10 / (1 + np.arange(langid.DIMS) % 7))
    row, feature, weight = langid._vectors(counts, idf)
    for i in range(len(texts)):
        tf = {int(f): counts[i, f] for f in np.flatnonzero(counts[i])}
        raw = {f: (1 + np.log(n)) * idf[f] for f, n in tf.items()}
        length = np.sqrt(sum(x * x for x in raw.values())) or 1
        mine = row == i
        assert {int(f): pytest.approx(x / length) for f, x in raw.items() for x in [x]} == dict(zip(feature[mine].tolist(), weight[mine].tolist()))


def test_log_count_ratios_equal_counting():
    rng = np.random.default_rng(1)
    label = rng.integers(0, 2, 80)
    starts, feature, sets = sparse(rng, 80, 60, label)
    rows = np.arange(0, 80, 2)
    good, bad = Counter(), Counter()
    for i in rows:
        (good if label[i] > 0 else bad).update(sets[i].tolist())
    total = [sum(c.values()) + ft.DIMS for c in (good, bad)]
    ratio = quality.log_count_ratios(label, starts, feature, rows)
    for f in range(60):
        n = good[f] + bad[f]
        assert ratio[f] == pytest.approx(np.log(((good[f] + 1) / total[0]) / ((bad[f] + 1) / total[1])) if n >= quality.MIN_ROWS else 0.0)


def test_dual_coordinate_descent_closes_the_duality_gap(monkeypatch):
    monkeypatch.setattr(quality, "ROUNDS", 300)
    rng = np.random.default_rng(2)
    label = rng.integers(0, 2, 60)
    starts, feature, sets = sparse(rng, 60, 45, label)
    ratio = np.zeros(ft.DIMS)
    ratio[:45] = rng.normal(size=45)
    rows = np.arange(60)
    w, bias = quality.dual_coordinate_descent(label, starts, feature, ratio, rows)
    x = np.zeros((60, 46))
    for i, s in enumerate(sets):
        v = ratio[s]
        x[i, s] = v / (np.linalg.norm(v) or 1)
        x[i, 45] = 1
    sign = np.where(label > 0, 1.0, -1.0)
    mine = np.append(w[:45], bias)

    def primal(u):
        return 0.5 * u @ u + quality.COST * np.maximum(0, 1 - sign * (x @ u)).sum()

    # the dual by projected gradient on a dense matrix
    q = (sign[:, None] * x) @ (sign[:, None] * x).T
    alpha = np.zeros(60)
    for _ in range(20_000):
        alpha = np.clip(alpha + (1 - q @ alpha) / np.linalg.norm(q, 2), 0, quality.COST)
    dual = alpha.sum() - 0.5 * alpha @ q @ alpha
    assert primal(mine) == pytest.approx(dual, rel=1e-3)
    assert mine == pytest.approx(x.T @ (alpha * sign), abs=1e-2)


def test_ordinal_fit_is_stationary_in_its_likelihood():
    rng = np.random.default_rng(3)
    label = (rng.random(400) < 0.4).astype(int) * rng.integers(1, 3, 400)
    starts, feature, sets = sparse(rng, 400, 30, label)
    model = toxicity.fit(label, starts, feature)
    at, grade = model["at"], toxicity.grades_of(label, starts, feature)
    place = {int(f): i for i, f in enumerate(at)}
    x = np.zeros((400, len(at)))
    for i, s in enumerate(sets):
        for f in s.tolist():
            if f in place:
                x[i, place[f]] = 1

    def loss(w, theta):
        z = x @ w
        upper = np.append(theta, np.inf)[grade] - z
        lower = np.append(-np.inf, theta)[grade] - z
        p = 1 / (1 + np.exp(-upper)) - 1 / (1 + np.exp(-np.clip(lower, -700, None)))
        return -np.log(p).mean() + toxicity.DECAY / 2 * w @ w

    w, theta = model["w"], model["theta"]
    assert len(at) >= 3 and (np.diff(theta) > 0).all()
    for k in range(len(w) + len(theta)):
        e = np.zeros(len(w) + len(theta))
        e[k] = 1e-4
        slope = (loss(w + e[: len(w)], theta + e[len(w) :]) - loss(w - e[: len(w)], theta - e[len(w) :])) / 2e-4
        assert abs(slope) < 2e-3


def test_pipeline_on_an_empty_table_and_on_nulls(spark, sf, tmp_path):
    whole = spark.read.parquet(f"{sf}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"{tmp_path}/none/{name}.parquet")
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"{tmp_path}/odd/{name}.parquet")
    whole.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    odd = spark.createDataFrame([(i, t, None, None, None) for i, t in [(1, None), (2, ""), (3, "---"), (4, "---"), (5, "x" * 50_000), (None, "plain words"), (6, "plain words")]], whole.schema)
    odd.write.parquet(f"{tmp_path}/odd/documents.parquet")
    rows = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert sorted(r["text"] for r in rows) == sorted(["", "", "---", "x" * 50_000, "plain words"])

"""Trained operators: accuracy on the held-out fold, and defined results for odd input."""

import zlib

import numpy as np
import pytest

from paperloom.llm import features, quality, toxicity
from paperloom.llm.queries import LLM_QUERIES

BIG = "/root/testdata/sf0.1"


def held(doc):
    return zlib.crc32(str(doc).encode()) % 5 == 0


def truth(spark, column):
    return {r["doc_id"]: r[column] for r in spark.read.parquet(f"{BIG}/labels.parquet").collect()}


def test_quality_on_held_out_rows(spark):
    label = truth(spark, "quality")
    rows = LLM_QUERIES["op10_quality_classifier"][0](spark, BIG).collect()
    assert len(rows) == 10_000 and all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    known = [(label[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in label]
    assert np.mean([a == b for a, b in known]) > 0.97
    assert np.mean([b for a, b in known if a == 1]) > 0.99


def test_toxicity_on_held_out_rows(spark):
    label = truth(spark, "toxic")
    rows = LLM_QUERIES["op8_toxicity"][0](spark, BIG).collect()
    known = [(label[r["doc_id"]], r["toxic"]) for r in rows if r["held_out"] and r["doc_id"] in label]
    assert np.mean([b for a, b in known if a == 1]) > 0.9
    assert np.mean([b for a, b in known if a == 0]) < 0.01
    assert all(0 <= r["p_toxic"] <= r["severity"] <= 2 for r in rows)


DOC = "doc_id long, text string, held_out string, w int"
ODD = [(1, None, "x", 1), (2, "", "x", 1), (2, "", "x", 1), (None, "word", "x", 1), (4, "é!! " * 50_000, "x", 1)]


@pytest.mark.parametrize("module, call, columns", [(quality, quality.score, 4), (toxicity, toxicity.grade, 6)])
def test_odd_rows_and_no_labels(spark, module, call, columns):
    docs = spark.createDataFrame(ODD, DOC)
    labels = spark.createDataFrame([(1, 1), (1, 0), (1, None), (None, 1), (99, 0)], "doc_id long, quality int").selectExpr("*", "quality as toxic")
    for known in (labels, labels.limit(0)):
        out = call(docs, module.train(docs, known))
        rows = out.collect()
        assert len(rows) == len(ODD) and len(out.columns) == columns
        assert [r["held_out"] for r in rows if r["doc_id"] is None] == [True]
        assert call(docs.limit(0), module.train(docs.limit(0), known)).count() == 0


def test_drop_toxic_keeps_columns(spark):
    docs = spark.createDataFrame([*ODD, (7, "you idiot", "x", 1)], DOC)
    at = features.word_features(np.frombuffer(b"idiot", dtype=np.uint8), np.array([0, 5]))[1]
    model = {"at": at.astype(float), "w": np.full(len(at), 10.0), "theta": np.array([5.0])}
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(ODD)


def test_features_do_not_depend_on_pieces(monkeypatch):
    data = ("Some Words, 12 AND ###signs### " * 40 + "é" * 500 + "longword" * 100).encode()
    flat, offsets = np.frombuffer(data, dtype=np.uint8), np.array([0, 700, len(data)])
    whole = features.style_features(flat, offsets), features.word_features(flat, offsets)
    for piece in (1, 50):
        monkeypatch.setattr(features.tb, "PIECE", piece)
        again = features.style_features(flat, offsets), features.word_features(flat, offsets)
        assert all((a == b).all() for x, y in zip(whole, again) for a, b in zip(x, y))


def test_margin_model_separates_by_hand():
    label, starts = np.array([1, 1, 1, 1, 0, 0, 0, 0] * 4), np.arange(0, 65, 2)
    feature = np.array([f for y in label for f in ((3, 9) if y else (5, 9))])
    model = quality.fit(label, starts, feature)
    assert model["w"][3] * model["ratio"][3] > 0 > model["w"][5] * model["ratio"][5]


def test_thresholds_are_ordered_and_severity_grows():
    label = np.array([0] * 200 + [1] * 100 + [2] * 100)
    lists = [[1]] * 200 + [[2]] * 100 + [[2, 3]] * 100
    model = toxicity.fit(label, np.append(0, np.cumsum([len(x) for x in lists])), np.array(sum(lists, [])))
    assert (np.diff(model["theta"]) > 0).all()
    w = dict(zip(model["at"].astype(int), model["w"]))
    assert w.get(1, 0) < model["theta"][0] < w[2] < model["theta"][1] < w[2] + w[3]

"""Language identification: accuracy on the held-out fold, n-gram counts against brute force, odd input."""

import zlib
from collections import Counter

import numpy as np

from paperloom.llm import langid
from paperloom.llm.queries import LLM_QUERIES

BIG = "/root/testdata/sf0.1"


def test_held_out_rows(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "lang").collect()}
    rows = LLM_QUERIES["op1_language_id"][0](spark, BIG).collect()
    assert len(rows) == len(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.97
    assert np.mean([r["rejected"] for r in held]) < 0.05


def grams(text):
    t = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
    t = " ".join(t.split())
    t = f" {t} " if t else " "
    return Counter(t[i : i + n] for n in (2, 3) for i in range(len(t) - n + 1))


def test_counts_equal_brute_force_and_parts_add_up(monkeypatch):
    texts = ["Hello,  world 12 é!", "", "...", "ab", "日本語 テキスト"]
    counts = langid._counts(texts)
    assert counts.sum(axis=1).tolist() == [sum(grams(t).values()) for t in texts]
    text = "some words of a text " * 200
    whole = langid._counts([text])
    monkeypatch.setattr(langid, "CHARS", 100)
    parts = [c for _, _, c in langid._groups([text])]
    assert len(parts) == 1 and (parts[0] == whole).all()
    for odd in ("letterswithoutanyblank" * 60, "ab " + " " * 300 + "cd", "ΑΣ" * 200 + "Σ", "漢字" * 500, "x" * 101, " " * 250, "İ" * 150):
        assert (langid._long_counts(odd) == langid._counts([odd])).all()
    assert [(i, j) for i, j, _ in langid._groups(["a"] * 130 + [text])] == [(0, 64), (64, 128), (128, 130), (130, 131)]


def test_odd_rows(spark):
    rows = [(i, f"the cat and the dog number {i}" if i % 2 else f"der hund und die katze {i}", "en" if i % 2 else "de", 1) for i in range(60)]
    rows += [(100, None, "en", 1), (101, "", "de", 1), (102, "12 !!", None, 1), (None, "the cat and the dog", "xx", 1), (103, "the cat", None, 1), (104, "漢字漢字漢字", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = {r["doc_id"]: r for r in langid.predict(docs, langid.train(docs)).collect()}
    assert [got[i]["lang_pred"] for i in (100, 101, 102)] == ["und"] * 3 and got[100]["score"] == 0
    assert got[None]["lang_pred"] == got[103]["lang_pred"] == "en" and got[None]["held_out"] and got[6]["lang_pred"] == "de"
    assert got[104]["rejected"] and not got[7]["rejected"]
    none = langid.train(docs.filter("lang is null"))
    assert {r["lang_pred"] for r in langid.predict(docs, none).collect()} == {"und"}
    assert langid.predict(docs.limit(0), none).count() == 0


def test_clusters_part_two_groups():
    x = np.zeros((20, 6), dtype=np.float32)
    x[:10, 0] = x[10:, 3] = 1
    x[::2, 1] = 0.1
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c, floor = langid.cluster(x, 2)
    assert sorted(np.argmax(c, axis=1).tolist()) == [0, 3] and (floor < 1).all()

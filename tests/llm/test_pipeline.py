"""Every stage of the corpus pipeline against a brute-force version of its decision, on what the stage before it kept."""

import numpy as np
import public_tokenizers
import pytest
from test_chosenpath import brute
from test_native import brute_hits
from tokenizers import Tokenizer

import corpus_pipeline
from paperloom.llm import secrets, toxicity


@pytest.fixture(scope="module")
def steps(spark, sf, tmp_path_factory):
    """Input and output of every stage, as lists of rows, with odd rows added."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, "en", "s", None), (9002, "", None, "s", 0), (9003, "AKIA" + "Z9" * 9 + " x", "en", None, 24)], docs.schema)
    docs, out = docs.unionByName(odd), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, sf).write.parquet(path)
        done = spark.read.parquet(path)
        out.append((docs.columns, docs.collect(), done.columns, done.collect()))
        docs = done
    return out


def test_columns_are_kept(steps):
    for before, _, after, _ in steps[:-1]:
        assert before == after == ["doc_id", "text", "lang", "source", "n_chars"]


def test_toxicity_goes_by_the_model(spark, sf, steps):
    docs = spark.createDataFrame(steps[0][1])
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    toxic = {r["doc_id"] for r in toxicity.grade(docs, model).filter("toxic").collect()}
    assert {r["doc_id"] for r in steps[0][3]} == {r["doc_id"] for r in steps[0][1]} - toxic
    assert len(steps[0][3]) + len(toxic) == len(steps[0][1])


def test_one_of_each_class_stays(steps):
    want = {c for _, c, _ in brute([(r["doc_id"], r["text"]) for r in steps[1][1]])}
    assert sorted(r["doc_id"] for r in steps[1][3]) == sorted(want)


def test_no_benchmark_window_stays_and_clean_documents_do(spark, sf, steps):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    joined = {}
    for r in steps[2][1]:
        joined[r["doc_id"]] = brute_hits(r["text"], items)[1] == 0 if len(r["text"] or "") < 4000 else None
    kept = {r["doc_id"] for r in steps[2][3]}
    assert all(clean is None or (i in kept) == clean for i, clean in joined.items())
    assert len(kept) < len(joined)


def test_secrets_are_masked_and_nothing_else(spark, steps):
    before, after = {r["doc_id"]: r for r in steps[3][1]}, {r["doc_id"]: r for r in steps[3][3]}
    assert set(before) == set(after)
    spans = {r["doc_id"]: r["all_spans"] for r in secrets.scan(spark.createDataFrame(steps[3][1])).collect()}
    for i, r in before.items():
        text = r["text"]
        for s in sorted(spans[i], key=lambda s: (-s["start"], -s["end"])):
            if text is not None and "\0" not in text[s["start"] : s["end"]]:
                text = text[: s["start"]] + "\0" * (s["end"] - s["start"]) + text[s["end"] :]
        masked = after[i]["text"]
        assert (masked is None) == (text is None)
        if text is not None:
            assert "".join(masked.split("[secret]")) == text.replace("\0", "")
            assert after[i]["n_chars"] == len(masked)
    assert any("[secret]" in (r["text"] or "") for r in after.values())


def test_tokens(steps):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    before, after = {r["doc_id"]: r["text"] or "" for r in steps[4][1]}, {r["doc_id"]: r for r in steps[4][3]}
    assert set(before) == set(after)
    for i, text in before.items():
        ids = np.frombuffer(after[i]["ids"], dtype="<u4").tolist()
        assert ids == tokenizer.encode(text, add_special_tokens=False).ids and after[i]["text"] == text and after[i]["n_tokens"] == len(ids)


def test_run_gives_the_last_stage(spark, sf):
    assert corpus_pipeline.run(spark, sf).columns == ["doc_id", "n_tokens", "ids", "text"]
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "toxicity"

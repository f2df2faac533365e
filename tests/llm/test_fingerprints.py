"""Prefix hashes and fingerprints against plain string comparison."""

import hashlib
import os
import random

import pytest

from paperloom.llm import fingerprints as fp
from paperloom.llm.queries import LLM_QUERIES


def common(a, b):
    return len(os.path.commonprefix([a, b]))


def test_spans_and_extensions_equal_brute_force(monkeypatch):
    rnd = random.Random(2)
    for piece in (7, 1 << 18):
        monkeypatch.setattr(fp, "PIECE", piece)
        a = "".join(rnd.choice("abé😀") for _ in range(120))
        b = a[30:80] + "".join(rnd.choice("abé😀") for _ in range(60))
        x, y = fp.PrefixHashes(a), fp.PrefixHashes(b)
        for _ in range(300):
            i, j, n = rnd.randrange(120), rnd.randrange(110), rnd.randrange(12)
            n = min(n, 120 - i, 110 - j)
            assert x.equal(i, y, j, n) == (a[i : i + n] == b[j : j + n])
            assert x.common_extension(i, y, j) == common(a[i:], b[j:])
    assert fp.PrefixHashes("").common_extension(0, fp.PrefixHashes("a"), 0) == 0


def test_pieces_do_not_change_a_fingerprint(monkeypatch):
    text = "abc é😀" * 400
    whole = fp.fingerprint(text)
    for piece in (1, 16, 100):
        monkeypatch.setattr(fp, "PIECE", piece)
        assert fp.fingerprint(text) == whole


def test_likeness():
    rnd = random.Random(4)
    text = "".join(rnd.choice("abcdefgh ") for _ in range(3000))
    same = fp.fingerprint(text)
    assert fp.likeness(same, fp.fingerprint(text)) == 1 == fp.likeness(fp.fingerprint(""), fp.fingerprint(""))
    assert fp.likeness(fp.fingerprint(""), same) == 0
    assert fp.likeness(same, fp.fingerprint(text[::-1])) < 0.05
    edited = fp.likeness(same, fp.fingerprint(text[:2000] + text[:1000]))
    assert 0.8 * 2000 / 3000 <= edited <= 2000 / 3000 + 0.01
    middle = fp.likeness(same, fp.fingerprint(text[:1500] + "X" + text[1501:]))
    assert 0.79 < middle < 1
    assert fp.likeness(fp.fingerprint("aaaa"), fp.fingerprint("aaaaa")) < 1


def brute(rows):
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = {}
    for (i, t), (_, u) in zip(ordered, ordered[1:] + ordered[:1]):
        t, u = t or "", u or ""
        e = t[: len(t) - len(t) // 3] + u[: len(t) // 3]
        a = fp.fingerprint(t)
        out[i] = (len(t), hashlib.sha256(e.encode()).hexdigest(), a, fp.fingerprint(e), fp.likeness(a, fp.fingerprint(e)), fp.likeness(a, fp.fingerprint(u)))
    return out


@pytest.mark.parametrize("ranges", [1, 2, 5, 60])
def test_report_equals_brute_force(spark, ranges):
    rnd = random.Random(6)
    ids = rnd.sample(range(10_000), 90) + [-5, None]
    rows = [(i, rnd.choice([None, "", "é", "one two three " * rnd.randint(1, 30), "".join(rnd.choice("ab😀") for _ in range(50))])) for i in ids]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, bucket int")
    got = {r["doc_id"]: tuple(r)[1:] for r in fp.edit_report(df, ranges=ranges).collect()}
    assert got == brute(rows)


def test_repeated_rows_and_emptiness(spark):
    df = spark.createDataFrame([(1, "abcabc"), (1, "abcabc"), (2, "xyz")], "doc_id long, text string")
    got = fp.edit_report(df, ranges=3).collect()
    assert sorted(r["doc_id"] for r in got) == [1, 1, 2]
    assert fp.edit_report(df.limit(0), ranges=3).count() == 0
    assert fp.fingerprints(df).count() == 3


def test_query_equals_brute_force(spark, sf):
    plan, _ = LLM_QUERIES["op6_document_fingerprints"]
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert {r["doc_id"]: tuple(r)[1:] for r in plan(spark, sf).collect()} == brute(rows)

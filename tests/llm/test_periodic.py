"""Grammar extensions, periodic runs and their query against brute force."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from paperloom.llm import periodic
from paperloom.llm.mining_queries import op13_periodic_runs
from paperloom.llm.recompress import Grammar


def brute_runs(x, least=12):
    """(start, period, length) by testing every period at every position."""
    n, out = len(x), {}
    for q in range(1, n // 2 + 1):
        t = 0
        while t < n - q:
            e = t
            while e < n - q and x[e] == x[e + q]:
                e += 1
            if e > t and e - t + q >= max(least, 2 * q):
                out.setdefault((t, e - t + q), q)
            t = max(e, t + 1)
    return sorted((s, q, length) for (s, length), q in out.items())


def sequences(seed, count=150):
    rng = np.random.default_rng(seed)
    for _ in range(count):
        docs = []
        for _ in range(rng.integers(1, 6)):
            n, k = int(rng.integers(0, 90)), int(rng.integers(1, 5))
            x = rng.integers(0, k, n)
            if rng.random() < 0.4 and n > 20:
                p, a = int(rng.integers(1, n // 2)), int(rng.integers(0, n // 2))
                x = np.array([x[i] if i < a else x[a + (i - a) % p] for i in range(n)])
            docs.append(x)
        yield docs


def test_extensions_equal_a_scan():
    rng = np.random.default_rng(3)
    for docs in sequences(5, 40):
        x = [-1]
        for t, d in enumerate(docs):
            x += [*d.tolist(), -2 - t]
        x = np.array(x)
        g = Grammar(x)
        i, j = rng.integers(0, len(x), 200), rng.integers(0, len(x), 200)
        i, j = i[i != j], j[i != j]
        for step in (1, -1):
            for a, b, got in zip(i, j, g.extension(i, j, step)):
                n = 0
                while 0 <= a + n * step < len(x) and 0 <= b + n * step < len(x) and x[a + n * step] == x[b + n * step]:
                    n += 1
                assert got == n


def test_runs_equal_brute_force():
    for docs in sequences(1):
        offsets = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
        text, start, length, period = periodic.find_runs(np.concatenate(docs).astype(np.int64), offsets)
        for t, d in enumerate(docs):
            mine = text == t
            assert list(zip(start[mine].tolist(), period[mine].tolist(), length[mine].tolist())) == brute_runs(d.tolist())


def test_long_sequences():
    rng = np.random.default_rng(2)
    once = rng.integers(0, 1000, 3777)
    text, start, length, period = periodic.find_runs(np.tile(once, 20), np.array([0, 20 * 3777]))
    assert (start.tolist(), length.tolist(), period.tolist()) == ([0], [20 * 3777], [3777])
    text, start, length, period = periodic.find_runs(np.zeros(50_000, dtype=np.int64), np.array([0, 50_000]))
    assert (start.tolist(), length.tolist(), period.tolist()) == ([0], [50_000], [1])


def test_query_equals_brute_force(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = {r["doc_id"]: r for r in op13_periodic_runs(spark, sf).collect()}
    assert set(rows) == set(docs)
    for i, text in docs.items():
        w = [x for x in re.split("[\x20\x09-\x0d]+", text or "") if x]
        n, h = len(w), zlib.crc32(str(i).encode())
        g = h // 10
        if n > 1200:
            continue
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(w)
        gone = {k for s, q, length in runs for k in range(s + q, s + length)}
        r = rows[i]
        assert r["n_runs"] == len(runs)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, q, m in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()
        best = min(runs, key=lambda x: (-x[2], x[0], x[1])) if runs else None
        want = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if runs else (None,) * 4
        assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == want


@pytest.mark.parametrize("rows", [[], [(None, None, 1), (1, "", 2), (1, "", 2), (2, " \t\x0b ", 3), (3, "a " * 12, 4), (4, "Ä b " * 7 + "c", 5), (5, "x" * 300_000 + " y" * 13, 6)]])
def test_defined_cases(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs long")
    got = {(r["doc_id"], r["collapsed"], tuple(tuple(x) for x in r["runs"])) for r in periodic.periodic_runs(docs).collect()}
    want = {(None, "", ()), (1, "", ()), (2, "", ()), (3, "a", ((0, 12, 1),)), (4, "Ä b c", ((0, 14, 2),)), (5, "x" * 300_000 + " y", ((1, 13, 1),))}
    assert got == (want if rows else set())

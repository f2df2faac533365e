"""Transforms of shards, their merges and repeated passages against brute force."""

import hashlib

import numpy as np
import pytest

from paperloom.llm import bwt, repeats
from paperloom.llm.mining_queries import op12_suffix_array_dedup


def some_strings(rng):
    strings = [bytes(rng.integers(0, int(rng.integers(1, 4)), int(rng.integers(0, 25))).astype(np.uint8)) for _ in range(rng.integers(1, 8))]
    return strings, np.frombuffer(b"".join(strings), np.uint8), np.cumsum([0, *map(len, strings)])


def common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


@pytest.mark.parametrize("most", [1, 20, 1000])
def test_merged_transforms_equal_sorted_suffixes(most):
    rng = np.random.default_rng(most)
    for _ in range(60):
        strings, data, bounds = some_strings(rng)
        depth = int(rng.integers(1, 9))
        string, offset, lcp = bwt.merge(bwt.shards(data, bounds, most), depth)
        assert sorted(zip(string.tolist(), offset.tolist())) == [(i, j) for i, s in enumerate(strings) for j in range(len(s) + 1)]
        suffixes = [strings[i][j:] for i, j in zip(string, offset)]
        assert [s[:depth] for s in suffixes] == sorted(s[:depth] for s in suffixes)
        assert lcp.tolist() == [0] + [min(depth, common(a, b)) for a, b in zip(suffixes, suffixes[1:])]


@pytest.mark.parametrize("most", [1, 20, 1000])
def test_repeated_intervals_are_equal_stretches(most):
    rng = np.random.default_rng(most)
    for _ in range(60):
        strings, data, bounds = some_strings(rng)
        depth = int(rng.integers(1, 9))
        found = list(zip(*bwt.repeated(bwt.shards(data, bounds, most), depth)))
        assert len(found) == sum(max(0, len(s) - depth + 1) for s in strings)
        pairs = {(strings[i][j : j + depth], n) for i, j, n in found}
        assert len(pairs) == len({p[0] for p in pairs}) == len({p[1] for p in pairs})


def test_segments_hold_every_window_once_and_seeds_follow_content():
    rng = np.random.default_rng(7)
    passage = rng.integers(97, 101, 700).astype(np.uint8)
    texts = [rng.integers(97, 123, n).astype(np.uint8) for n in (0, 99, 100, 101, 500, 3000)] + [passage, passage[50:600], np.full(900, 97, np.uint8)]
    data, offsets = np.concatenate(texts), np.cumsum([0, *map(len, texts)])
    row, start, count, seed, _ = repeats._segments(data, offsets, 100)
    windows = {}
    got = []
    for r, s, c, k in zip(row.tolist(), start.tolist(), count.tolist(), seed.tolist()):
        for at in range(s, s + c):
            got.append((r, at - int(offsets[r])))
            assert windows.setdefault(data[at : at + 100].tobytes(), k) == k
    assert got == [(r, at) for r, t in enumerate(texts) for at in range(len(t) - 99)]


def test_pieces_of_long_texts_hold_every_window_once():
    rng = np.random.default_rng(8)
    sizes = [50, repeats.PIECE, repeats.PIECE + 1, 3 * repeats.PIECE, 120]
    data, offsets = rng.integers(0, 256, sum(sizes)).astype(np.uint8), np.cumsum([0, *sizes])
    seen = {i: [] for i in range(len(sizes))}
    for first, at, part, bounds in repeats._pieces(data, offsets, 100):
        assert len(part) <= repeats.PIECE
        for k in range(len(bounds) - 1):
            n = bounds[k + 1] - bounds[k] - 99
            assert (part[bounds[k] : bounds[k + 1]] == data[offsets[first + k] + at :][: bounds[k + 1] - bounds[k]]).all()
            if n > 0:
                seen[first + k].append((at, at + n))
    for i, size in enumerate(sizes):
        runs = seen[i]
        assert (runs[0][0] == 0 and runs[-1][1] == size - 99 if size >= 100 else not runs)
        assert all(a[1] == b[0] for a, b in zip(runs, runs[1:]))


def brute(rows, least=100):
    """(id, number of bytes, kept) with a set of all windows seen so far."""
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        body = (text or "").encode()
        gone = np.zeros(len(body), dtype=bool)
        for at in range(len(body) - least + 1):
            w = body[at : at + least]
            if w in seen:
                gone[at : at + least] = True
            seen.add(w)
        out.append((i, len(body), bytes(np.frombuffer(body, np.uint8)[~gone])))
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    rng = np.random.default_rng(9)
    pool = ["".join(rng.choice(list("abcdé \0"), int(n))) for n in rng.integers(30, 400, 12)]
    rows = []
    for i in range(120):
        parts = [pool[k] if rng.random() < 0.6 else "".join(rng.choice(list("xyz "), 60)) for k in rng.integers(0, 12, rng.integers(0, 6))]
        rows.append((i, "".join(parts)))
    rows += [(200, "ab" * 300), (201, "z" * 1000), (202, None), (203, ""), (None, pool[0] + pool[1]), (204, rows[5][1]), (205, rows[5][1])]
    docs = spark.createDataFrame([(i, t, i, "k") for i, t in rows], "doc_id long, text string, pos long, key string")
    got = sorted(((r["doc_id"], r["n_bytes"], bytes(r["kept"])) for r in repeats.without_repeats(docs).collect()), key=str)
    assert got == brute(rows)


def test_seeds_with_many_strings_go_by_their_windows(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SEED_BYTES", 2000)
    rng = np.random.default_rng(10)
    line = "".join(rng.choice(list("abcd "), 130))
    rows = [(i, "".join(rng.choice(list("uvw"), 40)) + line + "".join(rng.choice(list("uvw"), 60))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_bytes"], bytes(r["kept"])) for r in repeats.without_repeats(docs).collect()), key=str)
    assert got == brute(rows)


def test_repeated_rows_and_empty_table(spark):
    text = "".join(np.random.default_rng(11).choice(list("abc "), 300))
    docs = spark.createDataFrame([(1, text), (1, text), (1, text), (1, "short"), (1, "short"), (2, text)], "doc_id long, text string")
    got = sorted((r["doc_id"], bytes(r["kept"]).decode()) for r in repeats.without_repeats(docs).collect())
    assert got == sorted([(1, ""), (1, ""), (1, text), (1, "short"), (1, "short"), (2, "")])
    assert repeats.without_repeats(docs.limit(0)).count() == 0


def test_query_equals_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = {i: (n, hashlib.sha256(kept).hexdigest(), n - len(kept)) for i, n, kept in brute(rows)}
    got = {r["doc_id"]: (r["n_bytes"], r["kept_sha256"], r["n_removed"]) for r in op12_suffix_array_dedup(spark, sf).collect()}
    assert got == want and any(x[2] for x in got.values())

"""Similarity classes against brute force over all pairs."""

import random
import re

import pytest

from paperloom.llm import chosenpath
from paperloom.llm.components import components

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def shingles(text, k=5):
    w = ["".join(c.lower() if c.isascii() else c for c in x) for x in WORD.findall(text or "")]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def brute(rows, threshold=0.8):
    sets = [shingles(t) for _, t in rows]
    n = len(rows)
    root, links = list(range(n)), [0] * n

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = {}
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    for i, s in enumerate(sets):
        common = {}
        for g in s:
            for j in holders[g]:
                if j < i:
                    common[j] = common.get(j, 0) + 1
        for j, c in common.items():
            if c >= threshold * (len(s) + len(sets[j]) - c) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    # exact copies of a text without a word are one class; empty texts are alone
    signs = {}
    for i, (_, t) in enumerate(rows):
        if t and not sets[i]:
            signs.setdefault(t, []).append(i)
    for same in signs.values():
        for i in same:
            root[i], links[i] = same[0], len(same) - 1
    least = {}
    for i in range(n):
        least.setdefault(top(i), []).append(rows[i][0])
    return sorted((rows[i][0], min(least[top(i)]), links[i]) for i in range(n))


def classes(spark, rows, **how):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, node string, keep_doc int")
    got = chosenpath.similarity_classes(df, **how).collect()
    return sorted((r["doc_id"], r["keep_doc"], r["n_links"]) for r in got)


def corpus(seed=5):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rnd.choice(vocabulary) for _ in range(40)]
    texts = []
    for _ in range(60):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randint(20, 120))] + (passage if rnd.random() < 0.6 else [])
        texts.append(" ".join(base))
        for _ in range(rnd.choice([0, 0, 1, 3])):
            edited = list(base)
            for _ in range(rnd.randint(0, 4)):
                edited[rnd.randrange(len(edited))] = rnd.choice(vocabulary)
            texts.append(" ".join(edited))
    base = [rnd.choice(vocabulary) for _ in range(90)]
    for _ in range(70):
        edited = list(base)
        edited[rnd.randrange(90)] = rnd.choice(vocabulary)
        texts.append(", ".join(edited))
    texts += ["", "...", "a b", "A B!", "a b c", "x " * 4000, "x " * 9000, texts[0].upper()]
    rnd.shuffle(texts)
    return list(enumerate(texts))


def test_classes_and_links_equal_brute_force(spark):
    rows = corpus()
    assert classes(spark, rows) == brute(rows)


def test_small_buckets_and_blocks_give_the_same(spark):
    rows = corpus(7)
    assert classes(spark, rows, bucket=4, block_rows=10, broadcast_bytes=0, recall=0.99999) == brute(rows)


def test_nulls_repeats_and_emptiness(spark):
    rows = [(1, None), (1, None), (2, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["keep_doc"] or -1, r["n_links"]) for r in chosenpath.similarity_classes(df).collect())
    assert got == [(-1, -1, 2), (1, 1, 0), (1, 1, 0), (2, -1, 2), (2, -1, 2), (3, 3, 0)]
    left = chosenpath.one_per_class(df)
    assert sorted((r["doc_id"] or -1, r["text"]) for r in left.collect() if r["text"]) == [(-1, "a b c d e f")]
    assert left.count() == 3 and left.columns == df.columns
    assert chosenpath.similarity_classes(df.limit(0)).count() == 0


def test_runs_follow_the_recall():
    assert chosenpath.runs_for(0.8, 0.99) < chosenpath.runs_for(0.8, 0.999) < chosenpath.runs_for(0.8, 0.99999)


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(200, 260)] + [(5, x) for x in range(6, 90)] + [(1000, 1000), (-3, 5), (None, 4)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["root"] for r in components(df).collect()}
    assert got == {**{i: 200 for i in range(200, 261)}, **{x: -3 for x in [-3, 5, *range(6, 90)]}}


@pytest.mark.parametrize("seed", [1])
def test_one_per_class_keeps_every_class_once(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in chosenpath.one_per_class(df).collect()}
    assert kept == {c for _, c, _ in brute(rows)}


def test_copies_without_a_word_are_one_class(spark):
    rows = [(i, "-----") for i in range(5, 45)] + [(50, "- -"), (51, "- -"), (52, "!"), (53, ""), (54, ""), (55, None), (56, None), (57, " "), (58, " "), (1, "a b c d e f")]
    assert classes(spark, rows) == brute(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in chosenpath.one_per_class(docs).collect()) == [1, 5, 50, 52, 53, 54, 55, 56, 57]

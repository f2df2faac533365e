"""Shortest paths: how much is shuffled, and hubs against brute force."""

import random

from paperloom.operators import kg_query
from paperloom.plans import inputs, load_all

from test_record_graph import BIGGER, shuffled_records


def test_edges_are_shuffled_a_few_times_only(spark):
    """Once to be distinct, once as neighbours, and where frontiers of the last hop meet; not for the first hop nor to walk back."""
    edges = inputs.trade_edges(spark, BIGGER).count()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")  # as on tables that are too large for it
    try:
        moved = shuffled_records(spark, lambda: load_all()["g4_paths_of_mixed_length"].plan(spark, BIGGER).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert moved < 9 * edges, moved / edges


def test_paths_around_hubs_equal_brute_force(spark):
    rng = random.Random(5)
    pairs = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(70)} | {(0, i) for i in range(20, 50)} | {(1, i) for i in range(45, 60)}
    edges = [(f"v{a}", f"v{b}") if rng.random() < 0.5 else (f"v{b}", f"v{a}") for a, b in pairs] + [("v3", "v3")]
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)

    def shortest(a, b, most):
        paths = [[a]]
        for _ in range(most + 1):
            done = [p for p in paths if p[-1] == b]
            if done:
                return min(done)
            paths = [[*p, x] for p in paths for x in near.get(p[-1], ()) if x not in p]

    asked = [(f"v{a}", f"v{b}") for a in range(0, 60, 7) for b in range(60) if a != b]
    found = kg_query.shortest_paths(
        spark.createDataFrame(asked, "source_id string, target_id string"), spark.createDataFrame(edges + edges[:9], "source_id string, target_id string"), 3, hub=6,
    )
    got = {(r["source_id"], r["target_id"]): list(r["path"]) for r in found.collect()}
    want = {(a, b): p for a, b in asked if (p := shortest(a, b, 3))}
    assert got == want

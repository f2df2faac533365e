"""Graphs of structured records: how much is shuffled, and firsts of shared vertices against brute force."""

import pytest
from pyspark.sql import functions as F

from paperloom.operators import kg_build
from paperloom.plans import load_all
from paperloom.session import cut_lineage

BIGGER = "/root/testdata/sf0.01"


def shuffled_records(spark, work) -> int:
    store = spark.sparkContext._jsc.sc().statusStore()

    def total():
        found = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(found.apply(i).shuffleWriteRecords() for i in range(found.size()))

    before = total()
    work()
    return total() - before


@pytest.mark.parametrize(("name", "times"), [("f19_edge_properties", 1.4), ("f19_vertex_properties", 2.6), ("f19_record_vertices", 2.6)])
def test_order_lines_are_shuffled_once(spark, name, times):
    """Once to become records, and as one number where devices of several records are looked for; the rest are names."""
    lines = spark.read.parquet(f"{BIGGER}/lineitem.parquet").count()
    moved = shuffled_records(spark, lambda: load_all()[name].plan(spark, BIGGER).write.format("noop").mode("overwrite").save())
    assert lines <= moved < times * lines, moved


def test_first_values_where_id_prefixes_and_texts_are_equal_or_missing(spark):
    rows = []
    for i in range(400):
        smiles = [None, "", f"S{i % 17}"][i % 3]
        rows.append((f"same-beginning-{(i * 37) % 400:04d}", f"10.1/{i % 3}", f"donor {i % 5}", f"donor {i % 7}", None if i % 4 else f"x{i % 2}", smiles, f"A{i % 11}" if i % 5 == 2 else None))
    schema = "record_id string, doi string, donor_name string, acceptor_name string, additive_id string, donor_smiles string, acceptor_smiles string"
    records = spark.createDataFrame(rows, schema).withColumn("donor_type", F.lit("T"))
    ids = cut_lineage(kg_build.record_ids(records.repartition(6)))
    of = {r["record_id"]: r for r in ids.collect()}
    want, mentions = {}, {}
    for r in sorted(rows):
        for end, smiles in (("donor_id", r[5]), ("acceptor_id", r[6])):
            vertex = of[r[0]][end]
            mentions[vertex] = mentions.get(vertex, 0) + 1
            if smiles:
                want.setdefault(vertex, smiles)
    got = {(r["id"], r["key"]): r["value"] for r in kg_build.record_properties(ids).collect()}
    assert {v: s for (v, k), s in got.items() if k == "smiles"} == want
    found = {r["id"]: r for r in kg_build.record_vertices(ids).collect()}
    donors = {of[r[0]]["donor_id"]: r[5] for r in sorted(rows, reverse=True) if r[5]}  # an acceptor's structure is a property only
    assert {v: found[v]["smiles"] for v in mentions} == {v: donors.get(v) for v in mentions}
    assert {v: found[v]["mentions"] for v in mentions} == mentions

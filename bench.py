"""Headline queries, one JSON line.  BENCH_SF_DIR and BENCH_CPUS choose the data and the cores."""

from __future__ import annotations

import json
import os
import time

from paperloom.plans import load_all
from paperloom.plans.flagship import answer_contexts
from paperloom.session import build_session, prepare

HEADLINES = [
    "b1_clean_document_text", "c1_identify_sections", "c6_passages", "d4_numerical_values", "d9_reference_content", "e2_copies", "e5_top_k", "e6_probe_top_k",
    "f14_merge_entities", "f15_merge_relations", "f16_upsert_entities", "f19_record_vertices", "f19_record_edges", "g4_shortest_paths", "g8_keyword_hits",
    "h6_query_expansion", "i8_corpus_near_copies", "i9_merge_sources", "i11_budgeted_text", "j8_retrieve_in_rounds", "l6_metric_means", "l12_missing_metrics",
    "m5_model_overlap", "m20_box_stats", "m22_breakdown", "n5_export_ids", "n11_token_usage", "s3_merge_stream",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"), "spark.ui.enabled": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    registered = load_all()
    plans = {name: registered[name].plan for name in HEADLINES}
    plans["answer_contexts"] = answer_contexts
    seconds = {}
    spark.range(1000).selectExpr("sum(id)").collect()
    for name, plan in plans.items():
        start = time.time()
        plan(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()

"""Queries of the operators that mine repeats: phrases, repeated passages, periodic runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import periodic, phrases, repeats
from paperloom.llm.registry import llm_query
from paperloom.sources.readers import table

#: Fixed value: what separates words.
BLANK = r"[\x20\x09-\x0D]+"


def _with_planted_repeats(docs: DataFrame) -> DataFrame:
    """In every tenth document (by the checksum of its id) the words from a on repeat those from a to a + p - 1."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), BLANK), lambda w: w != "")
    planted = docs.filter(h % 10 == 0).withColumn("w", words).withColumn("n", F.size("w").cast("bigint"))
    g = F.floor(h / 10)
    planted = planted.withColumn("a", F.when(F.col("n") > 0, g % F.col("n")).otherwise(0))
    planted = planted.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8)))
    place: Column = F.col("a")
    repeated = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1),
        lambda i: F.get("w", F.when(i < place, i).otherwise(place + (i - place) % F.col("p")).cast("int")),
    )
    edited = planted.select("doc_id", F.when(F.col("n") > 0, F.array_join(repeated, " ")).otherwise("").alias("text"))
    return docs.filter(F.coalesce(h % 10 != 0, F.lit(True))).select("doc_id", "text").unionByName(edited)


@llm_query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    """The periodic runs of every document, the longest one, and the text without what they repeat."""
    docs = _with_planted_repeats(table(spark, sf, "documents").select("doc_id", "text"))
    found = periodic.periodic_runs(docs)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = F.col("best")
    return found.withColumn("best", F.when(F.size("runs") > 0, longest)).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-best["s"]).alias("start"), best["length"].alias("length"),
        (-best["p"]).alias("period"), F.expr("best.length * 1000 div -best.p").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@llm_query("op11_phrase_collocations")
def op11_phrase_collocations(spark: SparkSession, sf: str) -> DataFrame:
    """Every language's first 2000 phrases by association score."""
    found = phrases.frequent_phrases(table(spark, sf, "documents").select("lang", "text"), least=100)
    top = phrases.ranked(phrases.without_contained(found), 2000)
    return top.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@llm_query("op12_suffix_array_dedup")
def op12_suffix_array_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Every document without the bytes that repeat 100 bytes of the corpus before them."""
    kept = repeats.without_repeats(table(spark, sf, "documents").select("doc_id", "text"), least=100)
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return kept.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )

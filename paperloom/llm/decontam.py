"""Benchmark decontamination: test n-grams as a hash set, probed by every word window of the training texts.

Words are runs of letters, digits and non-ASCII characters after A-Z is lower-cased.  A window is ``n`` consecutive
words of a benchmark item; an item of fewer words is one shorter window.  Each window's words and the items that hold
it form the set; a document's words are exploded in place, the hash of the window that begins at each word is looked up
there, and the few hits are verified word by word.  The set is broadcast only while its measured size is below
``broadcast_bytes``; then each document travels once: the row that carries its word count also keeps it in the result
when nothing hits.  Beyond that one narrow row per word (id, text hash, position, window hash) is shuffled to the set,
and the words are met again only by what was found in it.

Defined cases: null and wordless texts have no words and no hits; null, wordless and repeated items add nothing, and
null item ids are left out of the item list; rows that agree in id and text are judged together and all returned; an
empty benchmark or an empty table works; further columns are ignored by ``contamination`` and kept by the removers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What separates words, upper and lower letters, words in a window.
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
N = 10


def words_of(text: Column) -> Column:
    """The words of a text; the split leaves an empty string only at either end."""
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), SEPARATORS, -1), "")


def windows_of(benchmark: DataFrame, item: str = "item_id", text: str = "text", n: int = N) -> DataFrame:
    """(h, window, items): every distinct window with its hash and the sorted item ids that hold it."""
    words = benchmark.select(F.col(item).cast("string").alias("item"), words_of(F.col(text)).alias("w")).filter(F.size("w") > 0)
    last = F.greatest(F.size("w") - n, F.lit(0))
    cut = words.select("item", F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("w", i + 1, n))).alias("window"))
    grouped = cut.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return grouped.withColumn("h", F.xxhash64("window"))


def _probes(w: Column, i: Column, lengths: list[int]) -> Column:
    """For the word at i: one struct (length, hash of the window that begins there) per window length."""
    def at(k: int) -> Column:
        return F.get(w, i + k)

    made = [F.struct(F.lit(k).alias("n"), F.xxhash64(*[at(j) for j in range(k)]).alias("h")) for k in lengths]
    return made[0] if len(made) == 1 else F.explode(F.array(*made))


def _hash_like_probe(window: Column, lengths: list[int]) -> Column:
    out = F.lit(None).cast("bigint")
    for k in lengths:
        out = F.when(F.size(window) == k, F.xxhash64(*[F.get(window, F.lit(j)) for j in range(k)])).otherwise(out)
    return out


def contamination(
    docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    n: int = N, broadcast_bytes: int = 32 << 20,
) -> DataFrame:
    """Per document row: doc, text_hash, n_words, spans (covered word ranges, merged) and the sorted items that hit."""
    windows = windows_of(benchmark, item, item_text, n)
    shape = windows.groupBy(F.size("window").alias("k")).agg(
        F.sum(F.length(F.array_join("window", " ")) + F.length(F.array_join("items", " ")) + 64).alias("bytes")
    ).collect()
    lengths = sorted(r["k"] for r in shape) or [n]
    table = windows.select(_hash_like_probe(F.col("window"), lengths).alias("h"), "window", "items")
    table = table.groupBy("h").agg(F.collect_list(F.struct("window", "items")).alias("entries"))
    keyed = docs.select(F.col(doc).alias("__pl_id"), F.xxhash64(F.col(text)).alias("text_hash"), words_of(F.coalesce(F.col(text), F.lit(""))).alias("w"))
    if sum(r["bytes"] for r in shape) > broadcast_bytes:
        return _by_shuffled_hashes(keyed, table, lengths).withColumnRenamed("__pl_id", doc)
    table = F.broadcast(table)
    at = keyed.select("*", F.posexplode_outer("w").alias("i", "__pl_word")).drop("__pl_word")
    probe = at.select("*", _probes(F.col("w"), F.col("i"), lengths).alias("p")).select("*", "p.n", "p.h").drop("p")
    hit = probe.join(table, "h", "left")
    here = F.slice("w", F.col("i") + 1, F.col("n"))
    true_hits = F.filter("entries", lambda e: (F.size(e.getField("window")) == F.col("n")) & (e.getField("window") == here))
    first = (F.coalesce("i", F.lit(0)) == 0) & (F.col("n") == lengths[0])
    kept = hit.filter(F.col("entries").isNotNull() | first).select(
        "__pl_id", "text_hash", F.size("w").alias("n_words"), F.when(first, 1).alias("row"),
        F.when(F.size(true_hits) > 0, F.struct(F.col("i").alias("start"), (F.col("i") + F.col("n")).alias("end"))).alias("hit"),
        F.flatten(F.transform(true_hits, lambda e: e.getField("items"))).alias("items"),
    )
    grouped = kept.groupBy("__pl_id", "text_hash").agg(
        F.max("n_words").alias("n_words"), F.count("row").alias("rows"), F.array_sort(F.collect_set("hit")).alias("hits"),
        F.collect_set(F.when(F.size("items") > 0, F.col("items"))).alias("item_sets"),
    )
    one = grouped.select(
        "__pl_id", "text_hash", F.col("n_words").cast("bigint").alias("n_words"), _merged(F.col("hits")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten("item_sets"))).alias("items"), "rows",
    )
    copies = one.select("*", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("__pl_copy"))
    return copies.select(F.col("__pl_id").alias(doc), "text_hash", "n_words", "spans", "items")


def _by_shuffled_hashes(keyed: DataFrame, table: DataFrame, lengths: list[int]) -> DataFrame:
    """``contamination`` for a set too large to broadcast: no row but the document's own carries its words."""
    at = keyed.select("__pl_id", "text_hash", "w", F.posexplode("w").alias("i", "__pl_word"))
    probe = at.select("__pl_id", "text_hash", "i", _probes(F.col("w"), F.col("i"), lengths).alias("p")).select("__pl_id", "text_hash", "i", "p.n", "p.h")
    found = probe.join(table, "h").groupBy(F.col("__pl_id").alias("__pl_id2"), F.col("text_hash").alias("__pl_hash2")).agg(
        F.collect_set(F.struct("i", "n", "entries")).alias("found")
    )
    both = keyed.join(found, keyed["__pl_id"].eqNullSafe(found["__pl_id2"]) & (keyed["text_hash"] == found["__pl_hash2"]), "left")

    def verified(x: Column) -> Column:
        here = F.slice("w", x.getField("i") + 1, x.getField("n"))
        true = F.filter(x.getField("entries"), lambda e: (F.size(e.getField("window")) == x.getField("n")) & (e.getField("window") == here))
        span = F.struct(x.getField("i").alias("start"), (x.getField("i") + x.getField("n")).alias("end"))
        return F.struct(span.alias("hit"), F.flatten(F.transform(true, lambda e: e.getField("items"))).alias("items"), (F.size(true) > 0).alias("true"))

    sure = F.filter(F.transform("found", verified), lambda x: x.getField("true"))
    ready = both.withColumn("__pl_sure", F.coalesce(sure, F.expr("array()").cast("array<struct<hit:struct<start:int,end:int>,items:array<string>,true:boolean>>")))
    return ready.select(
        "__pl_id", "text_hash", F.size("w").cast("bigint").alias("n_words"), _merged(F.array_sort(F.array_distinct("__pl_sure.hit"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten("__pl_sure.items"))).alias("items"),
    )


def _merged(hits: Column) -> Column:
    """Sorted ranges → disjoint ranges.  Ends grow with starts except for short items, so a running maximum decides."""
    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.struct(last.getField("start").alias("start"), F.greatest(last.getField("end"), x.getField("end")).alias("end"))
        return (
            F.when(F.size(acc) == 0, F.array(x))
            .when(x.getField("start") <= last.getField("end"), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined)))
            .otherwise(F.concat(acc, F.array(x)))
        )

    return F.aggregate(hits, F.array().cast("array<struct<start:int,end:int>>"), step)


def covered(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0), lambda acc, s: acc + s.getField("end") - s.getField("start")).cast("bigint")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The documents without any hit, with all their columns."""
    found = contamination(docs, benchmark, doc, text, **how).filter(F.size("spans") > 0)
    bad = found.select(F.col(doc).alias("__pl_doc"), F.col("text_hash").alias("__pl_hash")).distinct()
    here = docs.withColumn("__pl_text_hash", F.xxhash64(F.col(text)))
    return here.join(bad, here[doc].eqNullSafe(bad["__pl_doc"]) & (here["__pl_text_hash"] == bad["__pl_hash"]), "left_anti").drop("__pl_text_hash")


def cut_spans(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text", mark: str = " ", **how) -> DataFrame:
    """The documents with every hit word range, and what lies between its words, replaced by ``mark``."""
    found = contamination(docs, benchmark, doc, text, **how).filter(F.size("spans") > 0)
    bad = found.select(F.col(doc).alias("__pl_doc"), F.col("text_hash").alias("__pl_hash"), F.col("spans").alias("__pl_spans")).distinct()
    here = docs.withColumn("__pl_text_hash", F.xxhash64(F.col(text)))
    joined = here.join(bad, here[doc].eqNullSafe(bad["__pl_doc"]) & (here["__pl_text_hash"] == bad["__pl_hash"]), "left")
    words = F.regexp_extract_all(F.col(text), F.lit("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"), F.lit(0))
    gaps = F.split(F.col(text), "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+", -1)
    edges = F.concat(
        F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))), F.col("__pl_spans"),
        F.array(F.struct(F.size("__pl_w").alias("start"), F.size("__pl_w").alias("end"))),
    )

    def kept(k: Column) -> Column:
        a, b = F.get(F.col("__pl_e"), k).getField("end"), F.get(F.col("__pl_e"), k + 1).getField("start")
        pairs = F.transform(F.slice("__pl_w", a + 1, b - a), lambda x, j: F.concat(x, F.get(F.col("__pl_g"), a + j + 1)))
        return F.concat(F.get(F.col("__pl_g"), a), F.array_join(pairs, ""))

    ready = joined.withColumn("__pl_w", F.when(F.col("__pl_spans").isNotNull(), words)).withColumn("__pl_g", F.when(F.col("__pl_spans").isNotNull(), gaps))
    ready = ready.withColumn("__pl_e", F.when(F.col("__pl_spans").isNotNull(), edges))
    pieces = F.transform(F.sequence(F.lit(0), F.size("__pl_spans")), kept)
    return ready.withColumn(text, F.when(F.col("__pl_spans").isNull(), F.col(text)).otherwise(F.array_join(pieces, mark))).select(*docs.columns)

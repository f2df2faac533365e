"""Embedding preparation, search and collection bookkeeping."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import cellindex, vectors
from paperloom.plans import inputs
from paperloom.plans.registry import query
from paperloom.plans.sqlkit import strip, with_inputs
from paperloom.session import new_path
from paperloom.sources.readers import spread, table


@query(
    "e1_embedding_input",
    f"SELECT doc_id, md5({strip('replace(text, chr(10), chr(32))')}) AS text_md5 FROM documents WHERE length({strip('replace(text, chr(10), chr(32))')}) >= 20",
)
def _(spark, sf):
    d = vectors.embedding_input(table(spark, sf, "documents").select("doc_id", "text"))
    return d.select("doc_id", F.md5("text").alias("text_md5"))


@query("e2_copies", "SELECT md5(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_key FROM documents GROUP BY 1")
def _(spark, sf):
    return vectors.copies(table(spark, sf, "documents"), "doc_id")


def length_vectors(texts: list[str]) -> list[list[float]]:
    """A stand-in model for offline runs: counts of a few letters."""
    return [[float(len(t)), float(t.count("e")), float(t.count("a")), float(t.count("\n"))] for t in texts]


@query(
    "e3_embed_once",
    """SELECT doc_id, CAST(length(text) AS DOUBLE) AS chars, CAST(length(text) - length(replace(text, 'e', '')) AS DOUBLE) AS e,
    CAST(length(text) - length(replace(text, 'a', '')) AS DOUBLE) AS a FROM documents""",
)
def _(spark, sf):
    d = vectors.embed_once(table(spark, sf, "documents").select("doc_id", "text"), length_vectors)
    x = F.col("embedding")
    return d.select("doc_id", x[0].cast("double").alias("chars"), x[1].cast("double").alias("e"), x[2].cast("double").alias("a"))


@query("e3_hashed_embedding")
def _(spark, sf):
    d = vectors.hashed_embedding(spread(table(spark, sf, "documents").select("doc_id", "text")))
    return d.select("doc_id", F.round(vectors.dot(F.col("embedding"), F.col("embedding")), 4).alias("squared_norm"))


_PROTO = """prototypes AS (SELECT label, list(m ORDER BY pos) AS centroid FROM (SELECT label, pos, avg(x) AS m FROM
    (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings) GROUP BY label, pos) GROUP BY label)"""


def _with_prototypes(sql: str) -> str:
    return f"WITH {_PROTO} {sql}"


def _prototypes(spark, sf):
    return vectors.prototypes(table(spark, sf, "embeddings"), "label")


@query("e4_cosine", _with_prototypes("SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], centroid), 6) AS similarity FROM embeddings JOIN prototypes USING (label)"))
def _(spark, sf):
    p = _prototypes(spark, sf).withColumnRenamed("embedding", "centroid")
    e = table(spark, sf, "embeddings").join(p, "label")
    return e.select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("centroid")), 6).alias("similarity"))


_SCORE = "round(list_cosine_similarity(e.embedding::DOUBLE[], centroid), 6)"


@query(
    "e5_top_k",
    _with_prototypes(
        f"""SELECT label, vec_id, similarity, row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id) AS rank FROM
        (SELECT p.label, e.vec_id, {_SCORE} AS similarity FROM prototypes p, embeddings e) QUALIFY rank <= 10"""
    ),
)
def _(spark, sf):
    return vectors.top_k(_prototypes(spark, sf), table(spark, sf, "embeddings").select("vec_id", "embedding"), 10, query_id="label")


_CELLS = """cells AS (SELECT vec_id, embedding, arg_max(label, (c, -label)) AS cell FROM (SELECT e.vec_id, e.embedding, p.label,
    round(list_cosine_similarity(e.embedding::DOUBLE[], centroid), 6) AS c FROM embeddings e, prototypes p) GROUP BY vec_id, embedding),
    probes AS (SELECT query_id, embedding, label AS cell FROM (SELECT q.query_id, q.embedding, p.label, row_number() OVER (PARTITION BY q.query_id ORDER BY
    round(list_cosine_similarity(q.embedding::DOUBLE[], centroid), 6) DESC, p.label) AS r FROM qv q, prototypes p) WHERE r <= 3)"""


_PROBED = f"""WITH qv AS (SELECT b.item_id AS query_id, e.embedding FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id), {_PROTO}, {_CELLS}
    SELECT query_id, vec_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM
    (SELECT q.query_id, c.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS similarity FROM probes q JOIN cells c USING (cell))
    QUALIFY rank <= 5"""


@query("e6_probe_top_k", _PROBED)
def _(spark, sf):
    cells = _prototypes(spark, sf).select(F.col("label").alias("cell"), F.col("embedding").alias("centroid"))
    corpus = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return vectors.probe_top_k(inputs.question_vectors(spark, sf), corpus, cells, 5, n_probe=3)


@query("e6_stored_index", _PROBED)
def _(spark, sf):
    """An index of two thirds of the vectors, the rest appended twice (the second time changes nothing), then searched."""
    cells = _prototypes(spark, sf).select(F.col("label").alias("cell"), F.col("embedding").alias("centroid"))
    corpus, path = table(spark, sf, "embeddings").select("vec_id", "embedding"), new_path(spark, "cells")
    cellindex.build(corpus.filter("vec_id % 3 <> 0"), cells, path)
    for _ in range(2):
        cellindex.append(corpus.filter("vec_id % 3 = 0"), path)
    return cellindex.search(inputs.question_vectors(spark, sf), path, 5, n_probe=3)


@query(
    "e6_cell_sizes",
    f"WITH {_PROTO}, {_CELLS[: _CELLS.index('probes AS')].rstrip().rstrip(',')} SELECT cell, count(*) AS vectors FROM cells GROUP BY cell",
)
def _(spark, sf):
    cells = _prototypes(spark, sf).select(F.col("label").alias("cell"), F.col("embedding").alias("centroid"))
    path = new_path(spark, "cells")
    cellindex.build(table(spark, sf, "embeddings").select("vec_id", "embedding"), cells, path)
    return cellindex.cell_sizes(spark, path)


@query("e6_trained_cells")
def _(spark, sf):
    corpus = table(spark, sf, "embeddings").select("vec_id", "embedding")
    cells = vectors.train_cells(corpus, 8)
    return vectors.probe_top_k(inputs.question_vectors(spark, sf), corpus, cells, 5, n_probe=4)


@query(
    "e7_typed_top_k",
    _with_prototypes(
        f"""SELECT * FROM (SELECT label, vec_id, similarity, row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id) AS rank FROM
        (SELECT p.label, e.vec_id, {_SCORE} AS similarity FROM prototypes p JOIN embeddings e USING (label)) QUALIFY rank <= 10) WHERE similarity >= 0.3"""
    ),
)
def _(spark, sf):
    corpus = table(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    q = _prototypes(spark, sf).withColumn("query_id", F.col("label"))
    found = vectors.top_k_in_cells(q, corpus, "label", 10, min_similarity=0.3)
    return found.withColumnRenamed("query_id", "label")


@query("e8_exact_lookup", "SELECT p_partkey, p_name FROM part WHERE p_name IN (SELECT min(p_name) FROM part GROUP BY p_brand)")
def _(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand")
    wanted = p.groupBy("p_brand").agg(F.min("p_name").alias("p_name"))
    return vectors.exact_lookup(p, wanted, "p_name").select("p_partkey", "p_name")


@query(
    "e8_list_by_type",
    "SELECT p_partkey, p_name, p_type, row_number() OVER (PARTITION BY p_type ORDER BY p_name, p_partkey) AS rank FROM part QUALIFY rank <= 20",
)
def _(spark, sf):
    return vectors.list_by_type(table(spark, sf, "part").select("p_partkey", "p_name", "p_type"), "p_type", ["p_name", "p_partkey"], 20)


@query(
    "e9_collection_stats",
    "SELECT label, count(*) AS vectors, min(len(embedding)) AS min_dim, max(len(embedding)) AS max_dim FROM embeddings GROUP BY ROLLUP(label)",
)
def _(spark, sf):
    return vectors.collection_stats(table(spark, sf, "embeddings"), "label")


@query(
    "e10_entity_text",
    """SELECT p_partkey, 'Entity: ' || p_name || ' | Type: ' || p_type || CASE WHEN p_size % 2 = 0 THEN ' | Description: made by ' || p_brand ELSE '' END
    || ' | Properties: brand: ' || p_brand || ', size: ' || p_size AS entity_text FROM part""",
)
def _(spark, sf):
    p = table(spark, sf, "part")
    props = F.array(F.concat(F.lit("brand: "), F.col("p_brand")), F.concat(F.lit("size: "), F.col("p_size").cast("string")))
    desc = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("made by "), F.col("p_brand")))
    return p.select("p_partkey", vectors.entity_text(F.col("p_name"), F.col("p_type"), desc, props).alias("entity_text"))


_HASH = "CAST(('0x' || substr(md5(concat_ws(':', doc_id, md5(text))), 1, 12)) AS BIGINT)"
BUILD = {"chunk": 800, "overlap": 100, "dimensions": 1536}


@query(
    "e11_corpus_fingerprint",
    f"SELECT source, count(*) AS files, CAST(CAST(sum({_HASH}) AS HUGEINT) AS VARCHAR) AS fingerprint FROM documents GROUP BY source",
)
def _(spark, sf):
    return vectors.corpus_fingerprint(table(spark, sf, "documents").withColumn("content_md5", F.md5("text")), ["doc_id", "content_md5"], ["source"])


@query("e11_to_rebuild", "SELECT doc_id, md5(text) AS fingerprint FROM documents WHERE NOT (doc_id % 5 <> 0 AND lang <> 'en')")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", F.md5("text").alias("fingerprint"))
    changed = F.when(F.col("lang") == "en", F.lit("old")).otherwise(F.col("fingerprint"))
    stored = d.select("doc_id", F.when(F.col("doc_id") % 5 == 0, "none").otherwise(changed).alias("fingerprint"))
    return vectors.to_rebuild(d.drop("lang"), stored, "doc_id")


@query(
    "e13_build_metadata",
    with_inputs(
        f"""SELECT d.*, p.* FROM (SELECT count(*) AS files, CAST(CAST(sum({_HASH}) AS HUGEINT) AS VARCHAR) AS fingerprint, md5('{{"chunk": 800, "dimensions": 1536, "overlap": 100}}') AS config_fingerprint, CAST(NULL AS DOUBLE) AS build_seconds FROM documents) d,
        (SELECT count(*) AS passages, count(DISTINCT doc_id) AS documents_with_passages FROM passages) p"""
    ),
)
def _(spark, sf):
    from paperloom.operators.chunking import passages

    return vectors.build_metadata(table(spark, sf, "documents"), passages(inputs.papers(spark, sf).select("doc_id", "text")), config=BUILD)


@query(
    "e13_written_collection",
    f"""SELECT count(*) AS documents, count(*) AS chunks, count(*) FILTER (WHERE length(text) > 0 AND doc_id % 11 <> 0) AS vectors, 4 AS min_dimension, 4 AS dimension,
    CAST(CAST(sum({_HASH}) AS HUGEINT) AS VARCHAR) AS fingerprint, true AS built_now FROM documents""",
)
def _(spark, sf):
    """Vectors of all documents but those whose call failed, counted while they are written."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    made = vectors.embed(d, length_vectors, "text").withColumn("embedding", F.when((F.length("text") > 0) & (F.col("doc_id") % 11 != 0), F.col("embedding")))
    row = vectors.write_collection(made, d, new_path(spark, "vectors"), config=BUILD)
    now = (F.col("build_seconds") > 0) & (F.abs(F.unix_timestamp("built_at") - F.unix_timestamp(F.current_timestamp())) < 3600)
    return row.select("documents", "chunks", "vectors", "min_dimension", "dimension", "fingerprint", now.alias("built_now"))

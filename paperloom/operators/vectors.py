"""Embedding preparation and exact or cell-probed cosine search.

The product of a query block with a batch of passages is one dense matrix product, so scoring runs on Arrow batches in
numpy.  Spark decides who meets whom:

* queries are dealt into blocks that fit a fixed budget; a block is broadcast and the corpus is scanned, unshuffled, once
  per block, so neither side is ever copied through a shuffle;
* inside cells (index cells, entity types) the hot ones are split into as many sub-cells as their size in bytes asks for.

Every task emits at most k rows per query it saw, which are ranked within a salt first and then per query: a query's last
window sees k rows per salt (``SALTS``), not k rows per task.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions.questions import tokens
from paperloom.functions.text import content_hash, strip
from paperloom.operators.hooks import map_batches
from paperloom.session import one_row

QUERY_BYTES = 64 << 20
CELL_BYTES = 64 << 20
CENTROID_BYTES = 256 << 20
SALTS = 64
SCORES_AT_ONCE = 4_000_000
DECIMALS = 6


# --- preparation -----------------------------------------------------------------------------------------------
def embedding_input(df: DataFrame, text: str = "text", min_chars: int = 20) -> DataFrame:
    """Line feeds become blanks, ends are stripped, too short texts (20 for documents, 2 for queries) are dropped."""
    clean = strip(F.replace(F.col(text), F.lit("\n"), F.lit(" ")))
    return df.withColumn(text, clean).filter(F.length(text) >= min_chars)


def embed(
    df: DataFrame, embed_fn: Callable[[list[str]], list[list[float]]], text: str, out: str = "embedding", batch: int = 2000, tries: int = 3, wait: float = 1.0
) -> DataFrame:
    """Add a vector column, and ``<out>_error``, by calling a model once per batch inside the tasks."""
    def floats(texts: list[str]) -> list[list[float]]:
        return [list(map(float, x)) for x in embed_fn(texts)]

    return map_batches(df, T.StructField(out, T.ArrayType(T.FloatType())), floats, lambda p: p[text].tolist(), batch, tries, wait)


def embed_once(df: DataFrame, embed_fn, text: str = "text", out: str = "embedding") -> DataFrame:
    """Call the model for every distinct content only and hand the vector to all copies; NULL texts keep a NULL vector.

    Content with very many copies makes a skewed join key on the left; the right side has one row per key, so adaptive
    skew handling splits the left partition and repeats that row.
    """
    keyed = df.withColumn("content_hash", content_hash(F.col(text)))
    unique = keyed.filter(F.col(text).isNotNull()).groupBy("content_hash").agg(F.any_value(text).alias(text))
    vectors = embed(unique, embed_fn, text, out).select("content_hash", out, f"{out}_error")
    return keyed.join(vectors, "content_hash", "left")


def hashed_embedding(df: DataFrame, text: str = "text", dims: int = 256, out: str = "embedding") -> DataFrame:
    """Bag-of-words vectors by feature hashing: a model-free default that makes text search runnable offline."""
    tf = HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=dims)
    unit = Normalizer(inputCol="_tf", outputCol="_unit")
    done = unit.transform(tf.transform(df.withColumn("_tokens", tokens(F.col(text)))))
    return done.withColumn(out, vector_to_array("_unit", "float32")).drop("_tokens", "_tf", "_unit")


def copies(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Per distinct content: its hash, the number of copies and the smallest key."""
    return df.groupBy(content_hash(F.col(text)).alias("content_hash")).agg(
        F.count("*").alias("copies"), F.min(key).alias("first_key")
    )


# --- similarity ------------------------------------------------------------------------------------------------
def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two array columns; 0 when one has no length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


def prototypes(df: DataFrame, key: str, embedding: str = "embedding") -> DataFrame:
    """Mean vector of each group, combined map-side before the shuffle."""
    mean = Summarizer.mean(array_to_vector(F.col(embedding).cast("array<double>")))
    return df.groupBy(key).agg(vector_to_array(mean).alias(embedding))


def _unit(rows) -> np.ndarray:
    if not len(rows):
        return np.zeros((0, 1))
    m = np.asarray([np.asarray(r, dtype=np.float64) for r in rows])
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _keep_best(q: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int):
    """The k best of every query; equal scores are ordered by vector id."""
    order = np.lexsort((ids, -scores, q))
    q, ids, scores = q[order], ids[order], scores[order]
    starts = np.r_[0, np.flatnonzero(np.diff(q)) + 1] if len(q) else np.array([], int)
    sizes = np.diff(np.r_[starts, len(q)])
    keep = (np.arange(len(q)) - np.repeat(starts, sizes)) < k
    return q[keep], ids[keep], scores[keep]


def _score(qm: np.ndarray, vm: np.ndarray, ids: np.ndarray, k: int):
    """Best k of one batch for every query, a bounded number of scores at a time."""
    parts = []
    step = max(1, SCORES_AT_ONCE // max(1, len(vm)))
    for start in range(0, len(qm), step):
        s = np.round(qm[start : start + step] @ vm.T, DECIMALS)
        if s.shape[1] > k:
            edge = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
            rows, cols = np.nonzero(s >= edge[:, None])
        else:
            rows, cols = (a.ravel() for a in np.indices(s.shape))
        parts.append(_keep_best(rows + start, ids[cols], s[rows, cols], k))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _by_length(rows: pd.Series) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Length → (positions, unit vectors) of the rows that have it."""
    lengths = rows.map(len).to_numpy()
    return {int(d): (at := np.flatnonzero(lengths == d), _unit(rows.iloc[at])) for d in np.unique(lengths)}


def _score_by_length(queries: dict, vectors: pd.Series, ids: np.ndarray, k: int):
    """As ``_score`` for queries and vectors of equal length; None if there are none."""
    parts = []
    for d, (at, vm) in _by_length(vectors).items():
        if d in queries:
            q, v, s = _score(queries[d][1], vm, ids[at], k)
            parts.append((queries[d][0][q], v, s))
    if not parts:
        return None
    return tuple(np.concatenate(x) for x in zip(*parts))


def _scan(queries: DataFrame, corpus: DataFrame, k: int, qid: str, vid: str, emb: str, schema: str) -> DataFrame:
    local = queries.select(qid, emb).toPandas()  # at most QUERY_BYTES, checked by the caller
    held = queries.sparkSession.sparkContext.broadcast((local[qid].to_numpy(), _by_length(local[emb])))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, by_length = held.value
        best = None
        for pdf in batches:
            got = _score_by_length(by_length, pdf[emb], pdf[vid].to_numpy(), k)
            if got is None:
                continue
            best = got if best is None else _keep_best(*[np.concatenate(x) for x in zip(best, got)], k)
        if best is not None:
            yield pd.DataFrame({qid: names[best[0]], vid: best[1], "similarity": best[2]})

    return corpus.select(vid, emb).mapInPandas(run, schema)


def _meet(queries: DataFrame, corpus: DataFrame, keys: list[str], k: int, qid: str, vid: str, emb: str, schema: str) -> DataFrame:
    """Score the queries and vectors that share all keys, one task per key."""

    def run(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        got = _score_by_length(_by_length(q["_e"]), c["_e"], c["_id"].to_numpy(), k)
        if got is None:
            return pd.DataFrame({qid: q["_id"][:0], vid: c["_id"][:0], "similarity": np.array([], float)})
        rows, ids, scores = got
        return pd.DataFrame({qid: q["_id"].to_numpy()[rows], vid: ids, "similarity": scores})

    # fresh names on both sides, because queries and vectors may come from the same table
    def side(df: DataFrame, id_col: str, tag: str):
        names = [f"{tag}{i}" for i in range(len(keys))]
        return df.select(*[F.col(c).alias(n) for c, n in zip(keys, names)], F.col(id_col).alias("_id"), F.col(emb).alias("_e")).groupBy(*names)

    return side(queries, qid, "_q").cogroup(side(corpus, vid, "_c")).applyInPandas(run, schema)


def _block_of(key: str, n: Column) -> Column:
    return F.pmod(F.xxhash64(key), n).cast("int")


def _fan(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), n.cast("int") - 1))


def _rank(local: DataFrame, k: int, qid: str, vid: str) -> DataFrame:
    order = [F.desc("similarity"), F.col(vid)]
    salted = local.withColumn("_salt", F.pmod(F.xxhash64(vid), F.lit(SALTS)))
    first = salted.withColumn("_r", F.row_number().over(Window.partitionBy(qid, "_salt").orderBy(*order))).filter(F.col("_r") <= k)
    last = F.row_number().over(Window.partitionBy(qid).orderBy(*order))
    return first.drop("_salt", "_r").withColumn("rank", last).filter(F.col("rank") <= k)


def _schema(queries: DataFrame, corpus: DataFrame, qid: str, vid: str) -> str:
    kinds = {**dict(queries.dtypes), **dict(corpus.dtypes)}
    return f"{qid} {kinds[qid]}, {vid} {kinds[vid]}, similarity double"


def top_k(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    query_id: str = "query_id",
    vector_id: str = "vec_id",
    embedding: str = "embedding",
    query_bytes: int = QUERY_BYTES,
    min_similarity: float | None = None,
) -> DataFrame:
    """Exact k nearest vectors of every query: (query id, vector id, similarity to six decimals, rank).

    ``min_similarity`` is applied after the ranking and is off unless asked for.  A query meets the vectors of its own
    length, whatever the lengths of other queries.  Rows whose vector is NULL, empty or of a length that the other side
    does not have get no neighbours and are no neighbours; ``unmatched`` counts them.
    """
    queries, corpus = queries.filter(F.size(embedding) > 0), corpus.filter(F.size(embedding) > 0)
    n, size = queries.agg(F.count("*"), F.coalesce(F.sum(F.size(embedding)), F.lit(0))).first()
    schema = _schema(queries, corpus, query_id, vector_id)
    if n == 0:
        return queries.sparkSession.createDataFrame([], f"{schema}, rank int")
    blocks = max(1, -(-size * 8 // query_bytes))
    # three quarters full on average, so that a block dealt by hash stays below the budget
    blocks = blocks if blocks == 1 else -(-blocks * 4 // 3)
    local = None
    for b in range(blocks):
        block = queries if blocks == 1 else queries.filter(_block_of(query_id, F.lit(blocks)) == b)
        found = _scan(block, corpus, k, query_id, vector_id, embedding, schema)
        local = found if local is None else local.unionByName(found)
    ranked = _rank(local, k, query_id, vector_id)
    return ranked if min_similarity is None else ranked.filter(F.col("similarity") >= min_similarity)


def unmatched(queries: DataFrame, corpus: DataFrame, embedding: str = "embedding") -> DataFrame:
    """(side, dims, rows, reason): the rows that ``top_k`` leaves out, counted by length; NULL vectors have NULL dims."""
    def lengths(df: DataFrame, side: str) -> DataFrame:
        dims = F.when(F.col(embedding).isNotNull(), F.size(embedding)).alias("dims")
        return df.groupBy(dims).agg(F.count("*").alias("rows")).withColumn("side", F.lit(side))

    both = lengths(queries, "queries").unionByName(lengths(corpus, "corpus"))
    sides = both.groupBy("dims").agg(F.count("*").alias("sides"), F.collect_list(F.struct("side", "rows")).alias("s"))
    left = sides.filter((F.coalesce(F.col("dims"), F.lit(0)) == 0) | (F.col("sides") == 1))
    reason = F.when(F.col("dims").isNull(), "null").when(F.col("dims") == 0, "empty").otherwise("length")
    return left.select("dims", F.explode("s").alias("x"), reason.alias("reason")).select("x.side", "dims", "x.rows", "reason")


def top_k_in_cells(
    queries: DataFrame,
    corpus: DataFrame,
    cell: str,
    k: int,
    query_id: str = "query_id",
    vector_id: str = "vec_id",
    embedding: str = "embedding",
    min_similarity: float | None = None,
    cell_bytes: int = CELL_BYTES,
) -> DataFrame:
    """As ``top_k``, but a query meets only the vectors of its own cells (it may have a row for each of several).

    A cell whose vectors or queries exceed ``cell_bytes`` is split both ways, so one hot cell becomes many tasks.
    """
    def parts(name: str) -> Column:
        return F.ceil(F.sum(F.size(embedding)) * 8 / cell_bytes).cast("int").alias(name)

    queries, corpus = queries.filter(F.size(embedding) > 0), corpus.filter(F.size(embedding) > 0)
    sizes = corpus.groupBy(cell).agg(parts("_c")).join(queries.groupBy(cell).agg(parts("_r")), cell)
    q = queries.join(sizes, cell).withColumn("_qb", _block_of(query_id, F.col("_r"))).withColumn("_cb", _fan(F.col("_c")))
    v = corpus.join(sizes, cell).withColumn("_cb", _block_of(vector_id, F.col("_c"))).withColumn("_qb", _fan(F.col("_r")))
    schema = _schema(queries, corpus, query_id, vector_id)
    local = _meet(q, v, [cell, "_qb", "_cb"], k, query_id, vector_id, embedding, schema)
    ranked = _rank(local, k, query_id, vector_id)
    return ranked if min_similarity is None else ranked.filter(F.col("similarity") >= min_similarity)


# --- probing a coarse index ------------------------------------------------------------------------------------
def train_cells(corpus: DataFrame, nlist: int, embedding: str = "embedding", seed: int = 7, max_iter: int = 10) -> DataFrame:
    """(cell, centroid) by distributed k-means under the cosine distance."""
    data = corpus.select(array_to_vector(F.col(embedding).cast("array<double>")).alias("features"))
    model = KMeans(k=nlist, distanceMeasure="cosine", seed=seed, maxIter=max_iter).fit(data)
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return corpus.sparkSession.createDataFrame(rows, "cell int, centroid array<double>")


def nearest_cells(df: DataFrame, cells: DataFrame, n: int = 1, embedding: str = "embedding", max_bytes: int = CENTROID_BYTES) -> DataFrame:
    """Add ``cell``: one row for each of the n nearest centroids.  Their size in bytes is checked, then they are broadcast."""
    size = cells.agg(F.coalesce(F.sum(F.size("centroid")) * 8, F.lit(0))).first()[0]
    if size > max_bytes:
        raise ValueError(f"centroids take {size} bytes, more than {max_bytes}")
    local = cells.toPandas().sort_values("cell")
    held = df.sparkSession.sparkContext.broadcast((local["cell"].to_numpy(), _unit(local["centroid"])))

    @F.pandas_udf("array<int>")
    def nearest(e: pd.Series) -> pd.Series:
        names, cm = held.value
        s = np.round(_unit(e) @ cm.T, DECIMALS)
        return pd.Series([names[np.lexsort((names, -row))[:n]].astype("int32") for row in s])

    return df.withColumn("cell", F.explode(nearest(F.col(embedding))))


def probe_top_k(
    queries: DataFrame, corpus: DataFrame, cells: DataFrame, k: int, n_probe: int = 10, query_id: str = "query_id",
    vector_id: str = "vec_id", embedding: str = "embedding",
) -> DataFrame:
    """Approximate search: vectors live in their nearest cell, queries visit ``n_probe`` cells, scores are exact."""
    q = nearest_cells(queries, cells, n_probe, embedding)
    v = nearest_cells(corpus, cells, 1, embedding)
    return top_k_in_cells(q, v, "cell", k, query_id, vector_id, embedding)


# --- lookups, statistics, rebuild detection ---------------------------------------------------------------------
def exact_lookup(df: DataFrame, names: DataFrame, name: str = "name") -> DataFrame:
    """Rows whose name equals one of the wanted names."""
    return df.join(names.select(name).distinct(), name, "left_semi")


def list_by_type(df: DataFrame, type_col: str, order: list[str], limit: int) -> DataFrame:
    """The first rows of every type in a total order."""
    w = Window.partitionBy(type_col).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def collection_stats(df: DataFrame, type_col: str) -> DataFrame:
    """Vectors in total (NULL type) and per type, with the range of dimensions."""
    return df.rollup(type_col).agg(
        F.count("*").alias("vectors"), F.min(F.size("embedding")).alias("min_dim"), F.max(F.size("embedding")).alias("max_dim")
    )


def entity_text(name: Column, entity_type: Column, description: Column, properties: Column) -> Column:
    """The text that represents an entity in the vector store; ``properties`` is an array of ``key: value`` strings."""
    return F.concat_ws(
        " | ",
        F.concat(F.lit("Entity: "), name),
        F.concat(F.lit("Type: "), entity_type),
        F.when(F.coalesce(description, F.lit("")) != "", F.concat(F.lit("Description: "), description)),
        F.when(F.size(properties) > 0, F.concat(F.lit("Properties: "), F.array_join(properties, ", "))),
    )


def corpus_fingerprint(df: DataFrame, parts: list[str], by: list[str] | None = None) -> DataFrame:
    """A fingerprint that does not depend on order, so it aggregates map-side: count and sum of row hashes.

    Sorting and joining all file names would pull the corpus through one task.
    """
    row_hash = F.conv(F.substring(F.md5(F.concat_ws(":", *[F.col(p).cast("string") for p in parts])), 1, 12), 16, 10)
    return df.groupBy(*(by or [])).agg(
        F.count("*").alias("files"), F.sum(row_hash.cast("decimal(20,0)")).cast("string").alias("fingerprint")
    )


def to_rebuild(current: DataFrame, stored: DataFrame, key: str, fingerprint: str = "fingerprint") -> DataFrame:
    """Rows that are new or changed since the stored build."""
    return current.join(stored.select(key, fingerprint), [key, fingerprint], "left_anti")


def config_fingerprint(config: dict) -> str:
    """A fingerprint of the settings that a build depends on."""
    return hashlib.md5(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()


def build_metadata(documents: DataFrame, passages: DataFrame, text: str = "text", config: dict | None = None, seconds: float | None = None) -> DataFrame:
    """One row with document and passage counts, the fingerprints of contents and settings, and the time it took."""
    content = documents.select("doc_id", F.md5(text).alias("content_md5"))
    d = corpus_fingerprint(content, ["doc_id", "content_md5"])
    d = d.withColumn("config_fingerprint", F.lit(config_fingerprint(config or {}))).withColumn("build_seconds", F.lit(seconds).cast("double"))
    p = passages.agg(F.count("*").alias("passages"), F.count_distinct("doc_id").alias("documents_with_passages"))
    return one_row(d, p)


def write_collection(embedded: DataFrame, documents: DataFrame, path: str, text: str = "text", embedding: str = "embedding", config: dict | None = None) -> DataFrame:
    """Write a vector table and return its metadata as one row.

    Chunks, vectors and their dimension are observed in the pass that writes them.  ``documents`` gives the number of files
    and the fingerprint of their contents; ``built_at`` and ``build_seconds`` are those of this write.
    """
    began, seen = time.time(), Observation()
    size = F.when(F.size(embedding) > 0, F.size(embedding))
    counted = embedded.observe(
        seen, F.count(F.lit(1)).alias("chunks"), F.count(size).alias("vectors"), F.min(size).alias("min_dimension"), F.max(size).alias("dimension")
    )
    counted.write.mode("overwrite").parquet(path)
    counts, done = seen.get, time.time()
    content = documents.select("doc_id", F.md5(text).alias("content_md5"))
    return corpus_fingerprint(content, ["doc_id", "content_md5"]).select(
        F.col("files").alias("documents"), *[F.lit(counts[c]).cast("bigint").alias(c) for c in ("chunks", "vectors", "min_dimension", "dimension")], "fingerprint",
        F.lit(config_fingerprint(config or {})).alias("config_fingerprint"), F.timestamp_seconds(F.lit(done)).alias("built_at"), F.lit(done - began).alias("build_seconds"),
    )

"""Jaccard self-join of word shingles by chosen paths.

1. Every text becomes its set of k-word shingle hashes, embedded as ``COORDS`` minimum hashes.  Texts with equal sets
   are one node (a 64-bit sum of the scrambled distinct hashes); copies are never paired.
2. Chosen paths: in each run a node of the recursion picks one coordinate, or two in ``1/threshold - 1`` of the cases,
   by a hash of its path, and splits its sets by their values there, so sets of similarity ``threshold`` keep one
   common child on average.  Buckets of at most ``bucket`` sets are compared directly, larger ones are split again up
   to ``DEPTH`` levels; what is still large then consists of near copies or is compared in blocks, all of it.  Runs are
   repeated until a pair at the threshold is found with probability ``recall`` even at the deepest level.
3. Sets that look alike (estimated similarity above ``threshold - SLACK``) form candidate groups.  Each set of a group
   is read once more, and within a group all links are counted exactly by inverted lists, large groups in pairs of
   blocks.  So a link can only be lost if no path connects its ends to one group.
4. Classes are the components of the exact links.

Defined cases: null and empty texts are alone; other texts without a word have no shingles, and their exact copies are one
class; a text of fewer than k words is one shorter shingle; rows that agree in id and text are copies of each other; an empty table gives no rows; further columns are
ignored by ``similarity_classes`` and kept by ``one_per_class``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm import textbatch as tb
from paperloom.llm.components import components
from paperloom.session import cut_lineage

COORDS, DEPTH, SLACK = 128, 4, 0.15
_U = np.uint64
_FACTORS = tb.mix(np.arange(1, COORDS + 1, dtype=np.uint64) * _U(0xA24BAED4963EE407)) | _U(1)
_OFFSETS = tb.mix(np.arange(1, COORDS + 1, dtype=np.uint64) * _U(0x9FB21C651E98DF25))


def runs_for(threshold: float, recall: float, depth: int = DEPTH) -> int:
    """Runs until a pair at the threshold meets in a bucket of the deepest level with probability ``recall``."""
    two, lost = 1 / threshold - 1, 0.0
    for _ in range(depth):
        one = 1 - threshold + threshold * lost
        lost = (1 - two) * one + two * one * one
    return max(1, math.ceil(math.log(1 - recall) / math.log(lost)))


def chosen(paths: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For every path: the index of the path and the coordinate, for one or two coordinates each."""
    first = tb.mix(paths ^ _U(0x2545F4914F6CDD1D))
    second = tb.mix(first + _U(1))
    extra = np.flatnonzero((second >> _U(11)).astype(np.float64) / 2.0**53 < 1 / threshold - 1)
    a = (first % _U(COORDS)).astype(np.int64)
    b = (a[extra] + 1 + (tb.mix(second[extra]) % _U(COORDS - 1)).astype(np.int64)) % COORDS
    return np.concatenate([np.arange(len(paths)), extra]), np.concatenate([a, b])


def child(paths: np.ndarray, coordinate: np.ndarray, value: np.ndarray) -> np.ndarray:
    return tb.mix(tb.mix(paths + coordinate.astype(np.uint64)) ^ tb.mix(value + _U(0x632BE59BD9B4E019)))


def min_hashes(s: np.ndarray) -> np.ndarray:
    best = np.full(COORDS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(s), 2048):
        np.minimum(best, ((s[i : i + 2048, None] ^ _OFFSETS) * _FACTORS).min(axis=0), out=best)
    return best


def _sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingles) of every text that has any."""
    data, offsets = tb.text_bytes(column)
    for i, j in tb.spans_of_rows(offsets):
        o = offsets[i : j + 1] - offsets[i]
        row, h = tb.shingles(*tb.words(data[offsets[i] : offsets[j]], o), k)
        cut = np.append(np.flatnonzero(np.append(True, row[1:] != row[:-1])), len(row)) if len(row) else np.zeros(1, dtype=np.int64)
        for a, b in zip(cut[:-1], cut[1:]):
            s = np.sort(h[a:b])
            yield i + int(row[a]), s[np.append(True, s[1:] != s[:-1])]


def _node(s: np.ndarray) -> int:
    return int(tb.mix(np.add.reduce(tb.mix(s), keepdims=True) + _U(len(s))).view(np.int64)[0])


def _sketch_batches(k: int, threshold: float, runs: int):
    roots = tb.mix(np.arange(1, runs + 1, dtype=np.uint64) * _U(0xD1342543DE82EF95))
    at, coordinate = chosen(roots, threshold)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            node, size, keys, sketch = [None] * n, [None] * n, [None] * n, [None] * n
            for r, s in _sets(batch.column("text"), k):
                m = min_hashes(s)
                node[r], size[r] = _node(s), len(s)
                keys[r] = child(roots[at], coordinate, m[coordinate]).view(np.int64)
                sketch[r] = (tb.mix(m) >> _U(48)).astype(np.uint16).tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("text_hash"), pa.array(node, pa.int64()), pa.array(size, pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                names=["doc", "text_hash", "node", "size", "keys", "sketch"],
            )

    return work


def _children(threshold: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column("key").to_numpy().view(np.uint64)
            sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), dtype=np.uint16).reshape(-1, COORDS)
            at, coordinate = chosen(paths, threshold)
            keys = child(paths[at], coordinate, sketch[at, coordinate].astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch.column("node").take(pa.array(at))], names=["key", "node"])

    return work


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys of a sorted stream, as whole groups; several small groups come together in one table."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        codes = np.stack([batch.column(c).to_numpy() for c in keys])
        new = np.flatnonzero((codes[:, 1:] != codes[:, :-1]).any(axis=0)) + 1
        same = held and all(held[-1].column(c)[-1].as_py() == batch.column(c)[0].as_py() for c in keys)
        if held and not same:
            yield pa.Table.from_batches(held)
            held = []
        if len(new):
            last = int(new[-1])
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _cuts(table: pa.Table, keys: list[str]) -> np.ndarray:
    codes = np.stack([table.column(c).to_numpy() for c in keys])
    return np.concatenate([[0], np.flatnonzero((codes[:, 1:] != codes[:, :-1]).any(axis=0)) + 1, [table.num_rows]])


def _alike(x: np.ndarray, xs: np.ndarray, y: np.ndarray, ys: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows y look like the row x: by agreeing coordinates and by sizes that allow the threshold."""
    sized = (np.minimum(xs, ys) >= threshold * np.maximum(xs, ys) - 1e-9)
    return sized & ((x == y).sum(axis=-1) >= (threshold - SLACK) * COORDS)


def _spread(sketch: np.ndarray, size: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Group number of every row: rows are visited from one to the next alike one; only left–right pairs count."""
    group = np.full(len(size), -1)
    for start in range(len(size)):
        if group[start] >= 0:
            continue
        group[start], todo = start, [start]
        while todo:
            x = todo.pop()
            open_ = np.flatnonzero((group < 0) & ((left[x] & right) | (right[x] & left)))
            if not len(open_):
                continue
            near = open_[_alike(sketch[x], size[x], sketch[open_], size[open_], threshold)]
            group[near] = start
            todo.extend(near.tolist())
    return group


def _edges(threshold: float):
    """Sorted buckets (key, b, c, side, node, size, sketch) → one edge from each row to the first of its group."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, ["key", "b", "c"]):
            cut = _cuts(table, ["key", "b", "c"])
            node, size, side = (table.column(c).to_numpy() for c in ("node", "size", "side"))
            sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), dtype=np.uint16).reshape(-1, COORDS)
            widths = np.diff(cut)
            two = cut[:-1][widths == 2]
            like = two[_alike(sketch[two], size[two], sketch[two + 1], size[two + 1], threshold)]
            a, b = [node[like]], [node[like + 1]]
            for lo, hi in zip(cut[:-1][widths > 2], cut[1:][widths > 2]):
                s = side[lo:hi]
                group = _spread(sketch[lo:hi], size[lo:hi], s <= 0, s >= 0, threshold)
                rest = np.flatnonzero(group != np.arange(hi - lo))
                a.append(node[lo:hi][rest])
                b.append(node[lo:hi][group[rest]])
            a, b = np.concatenate(a), np.concatenate(b)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return work


def _in_blocks(rows: DataFrame, key: str, blocks: str) -> DataFrame:
    """Adds b, c, side: a group of one block is (0, 0) with side 0; otherwise every row meets every block once.

    In the pair (b, c) of different blocks, rows of b are side -1 and rows of c side 1.
    """
    own = F.pmod(F.xxhash64("node"), F.col(blocks)).cast("int")
    other = F.explode(F.when(F.col(blocks) <= 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col(blocks).cast("int") - 1)))
    return rows.withColumn("own", F.when(F.col(blocks) <= 1, 0).otherwise(own)).withColumn("other", other).withColumns({
        "b": F.least("own", "other"), "c": F.greatest("own", "other"),
        "side": F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), -1).otherwise(1),
    }).drop("own", "other", blocks)


def _stream(rows: DataFrame, work, schema: str) -> DataFrame:
    return rows.repartition("key", "b", "c").sortWithinPartitions("key", "b", "c").mapInArrow(work, schema)


def _exact(threshold: float):
    """Sorted groups (key, b, c, side, node, size, copies, shingles) → per row its links here and a root of its links."""
    scaled = round(threshold * 10_000)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, ["key", "b", "c"]):
            cut = _cuts(table, ["key", "b", "c"])
            node, copies, side = (table.column(c).to_numpy() for c in ("node", "copies", "side"))
            raw = table.column("shingles").to_pylist()
            links, root = np.zeros(len(node), dtype=np.int64), node.copy()
            for lo, hi in zip(cut[:-1], cut[1:]):
                # a node can come twice if its text stands in several rows of one id
                _, one = np.unique(node[lo:hi], return_index=True)
                rows = lo + one
                sets = [np.frombuffer(raw[r], dtype=np.uint64) for r in rows]
                links[rows], root[rows] = _count_links(sets, node[rows], copies[rows], side[rows], scaled)
            some = np.flatnonzero(links > 0)
            yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(links[some]), pa.array(root[some])], names=["node", "links", "root"])

    return work


def _count_links(sets, node, copies, side, scaled) -> tuple[np.ndarray, np.ndarray]:
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    tokens = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    links, parent = np.zeros(n, dtype=np.int64), np.arange(n)

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x in range(n):
        lo, hi = np.searchsorted(tokens, sets[x], "left"), np.searchsorted(tokens, sets[x], "right")
        width = hi - lo
        at = np.repeat(lo - np.append(0, np.cumsum(width)[:-1]), width) + np.arange(width.sum())
        common = np.bincount(owner[at], minlength=n)
        near = 10_000 * common >= scaled * (sizes[x] + sizes - common)
        near &= side == 0 if side[x] == 0 else side == -side[x]
        near[x] = False
        links[x] = copies[near].sum()
        for y in np.flatnonzero(near[:x]):
            a, b = top(x), top(int(y))
            if a != b:
                parent[max(a, b)] = min(a, b)
    return links, node[[top(x) for x in range(n)]]


def _shingle_batches(k: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets: list[bytes | None] = [None] * batch.num_rows
            for r, s in _sets(batch.column("text"), k):
                sets[r] = s.tobytes()
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("key", "node", "copies", "blocks")), pa.array(sets, pa.binary())], names=["key", "node", "copies", "blocks", "shingles"]
            )

    return work


def _small(df: DataFrame, row_bytes: int, limit: int) -> DataFrame:
    """A written table, marked for broadcast while its measured size is below the limit."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def _bucket_sizes(rows: DataFrame) -> DataFrame:
    """Buckets of two sets or more.  Written, so that the join with it is split where one bucket is hot."""
    return cut_lineage(rows.groupBy("key").agg(F.count("*").alias("in_bucket")).filter("in_bucket > 1"))


def _candidate_edges(nodes: DataFrame, threshold: float, bucket: int) -> DataFrame:
    """Edges between nodes that met in a bucket of some path and look alike."""
    first = nodes.select("node", F.explode("keys").alias("key"))
    live = cut_lineage(first.join(_bucket_sizes(first), "key"))
    sketches = cut_lineage(nodes.select("node", "size", "sketch").join(live.select("node").distinct(), "node", "left_semi"))
    edges = None
    for depth in range(1, DEPTH + 1):
        small = live.filter(F.col("in_bucket") <= bucket) if depth < DEPTH else live
        blocks = F.when(F.col("in_bucket") <= 8 * bucket, 1).otherwise(F.ceil(F.col("in_bucket") / (4 * bucket))).cast("int")
        rows = _in_blocks(small.select("key", "node", blocks.alias("blocks")), "key", "blocks").join(sketches, "node")
        found = cut_lineage(_stream(rows, _edges(threshold), "a long, b long").distinct())
        edges = found if edges is None else edges.unionByName(found)
        large = live.filter(F.col("in_bucket") > bucket)
        if depth == DEPTH or large.limit(1).count() == 0:
            break
        grown = large.select("key", "node").join(sketches.select("node", "sketch"), "node").mapInArrow(_children(threshold), "key long, node long")
        grown = cut_lineage(grown.distinct())
        live = cut_lineage(grown.join(_bucket_sizes(grown), "key"))
    return edges


def similarity_classes(
    docs: DataFrame, doc: str = "doc_id", text: str = "text", k: int = 5, threshold: float = 0.8, recall: float = 0.999,
    bucket: int = 256, block_rows: int = 512, block_shingles: int = 1 << 20, broadcast_bytes: int = 32 << 20,
) -> DataFrame:
    """Per document row: doc, text_hash, class (the least id and hash of its class as keep_doc, keep_hash), n_links.

    ``n_links`` counts the other rows of similarity ``threshold`` or more, copies included.
    """
    base = tb.small_batches(docs.select(F.col(doc).alias("doc"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("text")))
    kind = base.schema["doc"].dataType.simpleString()
    table = cut_lineage(base.mapInArrow(
        _sketch_batches(k, threshold, runs_for(threshold, recall)),
        f"doc {kind}, text_hash long, node long, size int, keys array<long>, sketch binary",
    ))
    per_node = cut_lineage(table.filter("node is not null").groupBy("node").agg(
        F.count("*").alias("copies"), F.min(F.struct("doc", "text_hash")).alias("first"), *[F.first(c).alias(c) for c in ("size", "keys", "sketch")]
    ))
    groups = components(_candidate_edges(per_node, threshold, bucket))
    per_node = per_node.drop("keys", "sketch")
    member = groups.join(per_node, "node")
    weight = member.groupBy("root").agg(F.count("*").alias("rows"), F.sum("size").alias("shingles"))
    blocks = F.ceil(F.greatest(F.col("rows") / block_rows, F.col("shingles") / block_shingles)).cast("int")
    member = cut_lineage(member.join(weight.select("root", blocks.alias("blocks")), "root").select(
        F.col("root").alias("key"), "node", "copies", "blocks", "first.doc", "first.text_hash"
    ))
    wanted = _small(member, 64, broadcast_bytes)
    texts = base.join(wanted, base["doc"].eqNullSafe(wanted["doc"]) & (base["text_hash"] == wanted["text_hash"])).select("key", "node", "copies", "blocks", "text")
    sets = texts.mapInArrow(_shingle_batches(k), "key long, node long, copies long, blocks int, shingles binary")
    linked = cut_lineage(_stream(_in_blocks(sets, "key", "blocks"), _exact(threshold), "node long, links long, root long"))
    links = linked.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(linked.select("node", "root"))
    known = per_node.join(links, "node", "left").join(roots, "node", "left").select(
        "node", "copies", "first", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root")
    )
    least = known.groupBy("root").agg(F.min("first").alias("keep"))
    # written, so that the join with the rows is split where very many are copies
    known = cut_lineage(known.join(least, "root").select("node", "keep", (F.col("links") + F.col("copies") - 1).alias("n_links")))
    rows = table.select("doc", "text_hash", "node")
    # texts without a word: exact copies are one class, null and empty ones are alone
    empty = F.col("text_hash").isin(*[F.xxhash64(F.lit(x).cast("string")) for x in (None, "")])
    alone = rows.filter(F.col("node").isNull() & empty).select("doc", "text_hash", F.struct("doc", "text_hash").alias("keep"), F.lit(0).cast("bigint").alias("n_links"))
    signs = rows.filter(F.col("node").isNull() & ~empty)
    same = cut_lineage(signs.groupBy("text_hash").agg(F.min(F.struct("doc", "text_hash")).alias("keep"), (F.count("*") - 1).alias("n_links")))
    copies = signs.join(same, "text_hash").select("doc", "text_hash", "keep", "n_links")
    out = rows.join(known, "node").select("doc", "text_hash", "keep", "n_links").unionByName(alone).unionByName(copies)
    return out.select(F.col("doc").alias(doc), "text_hash", F.col("keep.doc").alias("keep_doc"), F.col("keep.text_hash").alias("keep_hash"), "n_links")


def one_per_class(docs: DataFrame, doc: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The documents without those that repeat another of their class; the least (id, text hash) stays."""
    classes = cut_lineage(similarity_classes(docs, doc, text, **how))
    kept = F.col(doc).eqNullSafe(F.col("keep_doc")) & (F.col("text_hash") == F.col("keep_hash"))
    gone = classes.filter(~kept).select(F.col(doc).alias("__pl_doc"), F.col("text_hash").alias("__pl_hash")).distinct()
    again = classes.filter(kept).groupBy(F.col(doc).alias("__pl_doc"), F.col("text_hash").alias("__pl_hash")).count().filter("count > 1").drop("count")
    here = docs.withColumn("__pl_text_hash", F.xxhash64(F.col(text)))

    def same(other: DataFrame):
        return here[doc].eqNullSafe(other["__pl_doc"]) & (here["__pl_text_hash"] == other["__pl_hash"])

    if again.limit(1).count() == 0:
        return here.join(gone, same(gone), "left_anti").drop("__pl_text_hash")
    both = gone.unionByName(again)
    repeated = here.join(again, same(again), "left_semi").dropDuplicates([doc, "__pl_text_hash"])
    return here.join(both, same(both), "left_anti").unionByName(repeated).drop("__pl_text_hash")

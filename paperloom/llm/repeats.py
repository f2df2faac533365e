"""Repeated passages: every byte covered by a string of ``least`` bytes that also begins earlier in the corpus.

*Who meets whom.*  Of the ``SEED``-byte strings in a window of ``least`` bytes the one with the least hash is its seed; equal
windows have equal seeds at equal places.  A maximal row of windows with one seed is a segment.  Seeds are counted over the
whole corpus, and only segments of repeated seeds go on (a bounded bit table lets some others through, which changes nothing).

*Equal segments* are one string with its first place; wherever else it stands, all its windows are repeats.

*Different strings of one seed* share windows in part.  They are dealt by seed into bins of bounded size.  A bin builds
Burrows-Wheeler transforms of shards of its strings and merges them by refining their interleave to ``least`` bytes
(``bwt``); the windows of a repeated interval are equal, and all but the first in the corpus's order are repeats.  A seed
with more than ``SEED_BYTES`` of strings (a line that a third of all documents quote) would be too much for one task: its
windows become strings of their own, which the grouping of equal strings resolves exactly.

The corpus's order is that of (id, hash of the text, place), null ids last.  A further row of the same id and text is
a repeat from end to end.  Strings are told apart by 128 bits.

Defined cases: a null text is empty; texts shorter than ``least`` bytes hold no repeats; an empty table gives no rows;
further columns are ignored.  Texts are worked on in pieces of ``PIECE`` bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm import bwt
from paperloom.llm import textbatch as tb
from paperloom.llm.bits import BitTable, bit_table
from paperloom.session import cut_lineage

LEAST = 100
SEED = 48
PIECE = 1 << 18
BIN_BYTES = 1 << 20
SEED_BYTES = 4 << 20
COUNTED = 1 << 19
_U = np.uint64
_VALUES = [tb.mix(np.arange(1, 257, dtype=np.uint64) * _U(m)) | _U(1) for m in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)]
PLACE = ["doc", "dh"]


def _sums(data: np.ndarray, which: int) -> np.ndarray:
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_VALUES[which][data] * tb._power("up", len(data)), out=out[1:])
    return out


def _spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges."""
    return tb.mix((sums[end] - sums[start]) * tb._power("down", len(sums))[start] + (end - start).astype(np.uint64))


def _segments(data: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(text, first window, windows, seed, sums) of the segments of some texts of up to ``PIECE`` bytes together."""
    seed_size = min(SEED, least)
    sums = _sums(data, 0)
    n = len(data) - least + 1
    if n <= 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none.astype(np.uint64), sums
    h = tb.mix((sums[seed_size:] - sums[:-seed_size]) * tb._power("down", len(data))[: len(data) - seed_size + 1])
    # the hash's upper bits with the place below them: the least is the leftmost of the least
    low = _U(2 * PIECE - 1)
    m, have, want = h & ~low | np.arange(len(h), dtype=np.uint64), 1, least - seed_size + 1
    while have < want:
        step = min(have, want - have)
        m = np.minimum(m[:-step], m[step:])
        have += step
    inside = np.zeros(n + 1, dtype=np.int32)
    first, last = offsets[:-1], offsets[1:] - least + 1
    full = last > first
    np.add.at(inside, first[full], 1)
    np.add.at(inside, last[full], -1)
    at = np.flatnonzero(np.cumsum(inside[:-1]))
    seeds = m[at]
    new = np.flatnonzero(np.append(True, (seeds[1:] != seeds[:-1]) | (at[1:] != at[:-1] + 1))) if len(at) else at
    start = at[new]
    place = (seeds[new] & low).astype(np.int64)
    return np.searchsorted(offsets, start, side="right") - 1, start, np.diff(np.append(new, len(at))), h[place], sums


def _pieces(data: np.ndarray, offsets: np.ndarray, least: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, place in it, bytes, offsets) of pieces of at most ``PIECE`` bytes whose windows are all windows, each once."""
    for i, j in tb.spans_of_rows(offsets, PIECE):
        begin, end = int(offsets[i]), int(offsets[j])
        if end - begin <= PIECE:
            yield i, 0, data[begin:end], offsets[i : j + 1] - begin
            continue
        for at in range(begin, end - least + 1, PIECE - least + 1):
            part = data[at : min(at + PIECE, end)]
            yield i, at - begin, part, np.array([0, len(part)])


def _input(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, dh, text): a text's hash tells rows of one id apart."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc).alias("doc"), F.xxhash64(body).alias("dh"), body.alias("text"))


def _long_texts(rows: DataFrame, least: int) -> DataFrame:
    return tb.small_batches(rows.filter(F.octet_length("text") >= least))


def seed_counts(rows: DataFrame, least: int) -> DataFrame:
    """(key, c): the segments of every seed, summed in each task before they are shuffled."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts, pa.int64())], names=["key", "c"])

        for batch in batches:
            data, offsets = tb.text_bytes(batch.column("text"))
            for _, _, part, bounds in _pieces(data, offsets, least):
                held.append(_segments(part, bounds, least)[3])
                size += len(held[-1])
                if size >= COUNTED:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    return rows.mapInArrow(work, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


def segments(rows: DataFrame, may: BitTable, least: int, windows: bool = False, with_text: bool = False) -> DataFrame:
    """(key, h1, h2, doc, dh, pos, size) of the segments, or of their single windows, of the seeds of a table.

    ``with_text``: the table holds identities of segments (``_identity``) instead, and their bytes come along as ``body``.
    """
    held = rows.sparkSession.sparkContext.broadcast(may)
    kind = rows.schema["doc"].dataType.simpleString()
    names = ["key", "h1", "h2", *PLACE, "pos", "size"] + (["body"] if with_text else [])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        for batch in batches:
            data, offsets = tb.text_bytes(batch.column("text"))
            hashes = batch.column("dh").to_numpy(zero_copy_only=False).view(np.uint64)
            for i, at, part, bounds in _pieces(data, offsets, least):
                row, start, count, key, sums = _segments(part, bounds, least)
                place = start - bounds[row] + at
                took = table(_identity(hashes[row + i], place)) if with_text else table(key)
                row, start, count, key, place = (x[took] for x in (row, start, count, key, place))
                size = count + least - 1
                if windows:
                    begin = np.cumsum(count) - count
                    step = np.arange(int(count.sum())) - np.repeat(begin, count)
                    row, key = np.repeat(row, count), np.repeat(key, count)
                    start, place = np.repeat(start, count) + step, np.repeat(place, count) + step
                    size = np.full(len(row), least)
                if not len(row):
                    continue
                both = [_spans(sums, start, start + size), _spans(_sums(part, 1), start, start + size)]
                columns = [key, *both, None, None, place.astype(np.int32), size.astype(np.int32)]
                columns = [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) if c is not None else None for c in columns]
                columns[3], columns[4] = (batch.column(c).take(pa.array(row + i)) for c in PLACE)
                if with_text:
                    columns.append(pa.array([part[s:e].tobytes() for s, e in zip(start.tolist(), (start + size).tolist())], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"key long, h1 long, h2 long, doc {kind}, dh long, pos int, size int" + (", body binary" if with_text else "")
    return rows.mapInArrow(work, schema)


def _identity(dh: np.ndarray, pos: np.ndarray) -> np.ndarray:
    return tb.mix(dh + tb.mix(pos.astype(np.uint64)))


def _order() -> Column:
    return F.struct(F.col("doc").isNull().alias("none"), *PLACE, "pos")


def firsts(found: DataFrame) -> DataFrame:
    """(h1, h2, key, size, n, first): every string once, with its number of places and the first of them."""
    return found.groupBy("h1", "h2", "key", "size").agg(F.count("*").alias("n"), F.min(_order()).alias("first"))


def later_places(found: DataFrame, first: DataFrame) -> DataFrame:
    """(doc, dh, start, end) of every place of a string but its first."""
    both = found.join(first.filter("n > 1").select("h1", "h2", "first"), ["h1", "h2"])
    return both.filter(_order() != F.col("first")).select(*PLACE, F.col("pos").cast("bigint").alias("start"), (F.col("pos") + F.col("size")).cast("bigint").alias("end"))


def in_bins(strings: DataFrame, least: int) -> DataFrame:
    """(doc, dh, start, end) of the repeats among strings (key, doc, dh, pos, body); no seed's strings are in two tasks."""
    kind = strings.schema["doc"].dataType.simpleString()
    dealt = strings.select("key", *PLACE, "pos", "body").repartition("key")
    dealt = tb.small_batches(dealt.sortWithinPartitions("key", F.col("doc").isNull(), *PLACE, "pos"))

    def repeats(table: pa.Table) -> pa.RecordBatch | None:
        table = table.combine_chunks()
        key = table["key"].to_numpy()
        new = np.append(True, key[1:] != key[:-1])
        alone = new & np.append(new[1:], True)
        table = table.filter(pa.array(~alone))
        if not table.num_rows:
            return None
        data, bounds = _bytes(table["body"])
        string, offset, interval = bwt.repeated(bwt.shards(data, bounds), least)
        lead = np.full(int(interval[-1]) + 1, len(bounds), dtype=np.int64)
        np.minimum.at(lead, interval, string)
        again = string > lead[interval]
        string, offset = string[again], offset[again]
        order = np.lexsort((offset, string))
        string, offset = string[order], offset[order]
        if not len(string):
            return None
        new = np.append(True, (string[1:] != string[:-1]) | (offset[1:] != offset[:-1] + 1))
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(string)) - 1
        rows = table.take(pa.array(string[first])).combine_chunks()
        pos = rows["pos"].to_numpy().astype(np.int64)
        columns = [*(rows[c].combine_chunks() for c in PLACE), pa.array(pos + offset[first]), pa.array(pos + offset[last] + least)]
        return pa.RecordBatch.from_arrays(columns, names=[*PLACE, "start", "end"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            key = batch.column("key").to_numpy()
            if size >= BIN_BYTES:
                # a bin ends where a seed does
                same = int(np.searchsorted(key, held[-1].column("key")[-1].as_py(), side="right"))
                if same < len(key):
                    held.append(batch.slice(0, same))
                    done = repeats(pa.Table.from_batches(held))
                    if done is not None:
                        yield done
                    batch, held, size = batch.slice(same), [], 0
            held.append(batch)
            size += batch.column("body").nbytes
        if held:
            done = repeats(pa.Table.from_batches(held))
            if done is not None:
                yield done

    return dealt.mapInArrow(work, f"doc {kind}, dh long, start long, end long")


def _bytes(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    values = column.combine_chunks().cast(pa.large_binary())
    if isinstance(values, pa.ChunkedArray):
        values = values.chunk(0)
    bounds = np.frombuffer(values.buffers()[1], dtype=np.int64)[values.offset : values.offset + len(values) + 1]
    return np.frombuffer(values.buffers()[2], dtype=np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def repeated_spans(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc, dh, start, end) in bytes: their union covers every byte of a repeat, and no other, of rows (doc, dh, text)."""
    rows = _long_texts(rows, least)
    repeated = bit_table(cut_lineage(seed_counts(rows, least).filter("c > 1").select("key")))
    found = segments(rows, repeated, least)
    first = cut_lineage(firsts(found))
    seeds = first.groupBy("key").agg(F.count("*").alias("strings"), F.sum("size").alias("bytes")).filter("strings > 1")
    seeds = cut_lineage(seeds)
    shared = first.join(seeds.filter(F.col("bytes") <= SEED_BYTES).select("key"), "key", "left_semi")
    places = shared.select(F.col("first.dh").alias("dh"), F.col("first.pos").alias("pos"))
    strings = segments(rows, bit_table(cut_lineage(_identities(places)), "id"), least, with_text=True)
    spans = later_places(found, first).unionByName(in_bins(strings, least))
    hot = seeds.filter(F.col("bytes") > SEED_BYTES).select("key")
    if hot.limit(1).count():
        single = segments(rows, bit_table(hot), least, windows=True)
        spans = spans.unionByName(later_places(single, firsts(single)))
    return spans


def _identities(places: DataFrame) -> DataFrame:
    """``_identity`` of every (dh, pos)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dh, pos = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("dh", "pos"))
            yield pa.RecordBatch.from_arrays([pa.array(_identity(dh.view(np.uint64), pos).view(np.int64))], names=["id"])

    return places.mapInArrow(work, "id long")


def without_repeats(docs: DataFrame, doc: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """(doc, n_bytes, spans, kept) of every row: the maximal removed runs (start, end) in bytes and the bytes that stay."""
    rows = _input(docs, doc, text)
    kind = rows.schema["doc"].dataType.simpleString()
    # without nulls in the keys, grouping, numbering and joining share one shuffle of either side
    keys = ["none", "known", "dh"]

    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumns({"none": F.col("doc").isNull(), "known": F.coalesce("doc", F.lit(0).cast(kind))})

    spans = keyed(repeated_spans(rows, least)).groupBy(*keys).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    numbered = keyed(rows).withColumn("copy", F.row_number().over(Window.partitionBy(*keys).orderBy("text")))
    both = numbered.join(spans, keys, "left")
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.octet_length("text").cast("bigint").alias("end")))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    gone = F.when((F.col("copy") > 1) & (F.octet_length("text") >= least), whole).otherwise(F.coalesce("spans", none))
    ready = tb.small_batches(both.select("doc", "text", gone.alias("spans")))

    def cut(body: bytes, spans: list[dict]) -> tuple[list[dict], bytes]:
        runs: list[dict] = []
        for s in sorted(spans, key=lambda s: s["start"]):
            if runs and s["start"] <= runs[-1]["end"]:
                runs[-1]["end"] = max(runs[-1]["end"], s["end"])
            else:
                runs.append(dict(s))
        edges = [0, *(x for r in runs for x in (r["start"], r["end"])), len(body)]
        return runs, b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            data, offsets = tb.text_bytes(batch.column("text"))
            made = [cut(data[a:b].tobytes(), s) for a, b, s in zip(offsets.tolist(), offsets[1:].tolist(), batch.column("spans").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(np.diff(offsets)), pa.array([r for r, _ in made], kinds), pa.array([k for _, k in made], pa.binary())],
                names=["doc", "n_bytes", "spans", "kept"],
            )

    return ready.mapInArrow(work, f"doc {kind}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary").withColumnRenamed("doc", doc)

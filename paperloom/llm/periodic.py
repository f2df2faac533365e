"""Periodic runs of words, found by extensions in the run-length grammar of every text.

A run is a stretch of consecutive words with smallest period q, at least ``max(least, 2 q)`` words long, that no neighbouring
word extends.  The words that agree with the word q behind them form a stretch of at least q words there, so one of the
positions 0, q, 2 q, ... lies in it: these harmonic grids hold n log n candidates.  A candidate whose word differs from the
one q behind, or that agrees alone, is none; all others are extended both ways by ``recompress.Grammar``.  Texts are
compressed in batches of bounded size; a longer text is a batch of its own.

Defined cases: words are separated by blanks and the control characters 9 to 13; a null or blank text has no words and no
runs; repeated rows give repeated results; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm import textbatch as tb
from paperloom.llm.recompress import Grammar

LEAST = 12
TEMPLATE = 4096
GRID_AT_ONCE = 1 << 20
WORDS_AT_ONCE = 1 << 16
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def words_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all words, offsets by text)."""
    text = column.cast(pa.large_string()).fill_null("")
    split = pc.ascii_split_whitespace(text)
    if isinstance(split, pa.ChunkedArray):
        split = split.combine_chunks()
    flat, at = split.flatten(), np.asarray(pc.list_value_length(split), dtype=np.int64)
    bounds = np.concatenate([[0], np.cumsum(at)])
    full = np.asarray(pc.greater(pc.binary_length(flat), 0)).astype(bool) if len(flat) else np.zeros(0, dtype=bool)
    kept = np.concatenate([[0], np.cumsum(full)])
    return flat.filter(pa.array(full)), kept[bounds]


def _chunks(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(position, period) of the grids of a text of n words, a bounded number at a time."""
    q = 1
    while 2 * q <= n:
        last, total = q, 0
        while 2 * last <= n and total < GRID_AT_ONCE:
            total += (n - 1) // last
            last += 1
        period = np.arange(q, last, dtype=np.int64)
        size = (n - 1) // period
        begin = np.cumsum(size) - size
        p = np.repeat(period, size)
        yield (np.arange(len(p)) - np.repeat(begin, size)) * p, p
        q = last


_template: list[np.ndarray] = []


def _grid(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    if n > TEMPLATE:
        yield from _chunks(n)
        return
    if not _template:
        i, q = (np.concatenate(x) for x in zip(*_chunks(TEMPLATE)))
        order = np.argsort(i + q, kind="stable")
        _template.extend([i[order], q[order], np.searchsorted((i + q)[order], np.arange(TEMPLATE + 1))])
    i, q, until = _template
    yield i[: until[n]], q[: until[n]]


def _candidates(x: np.ndarray, begin: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Grid positions (in x) and periods whose word, and a neighbour's, equal those a period behind; x has separators."""
    found_i, found_q = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    text = x[begin - 1 : begin + n + 1]
    for i, q in _grid(n):
        agree = text[1 + i] == text[1 + i + q]
        i, q = i[agree], q[agree]
        beside = (text[i] == text[i + q]) | (text[2 + i] == text[2 + i + q])
        found_i.append(i[beside] + begin)
        found_q.append(q[beside])
    return np.concatenate(found_i), np.concatenate(found_q)


def find_runs(symbols: np.ndarray, offsets: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of all runs, by text, start and period, of several sequences laid end to end."""
    texts = len(offsets) - 1
    sizes = np.diff(offsets)
    x = np.empty(len(symbols) + texts + 1, dtype=np.int64)
    apart = np.concatenate([[0], offsets[1:] + np.arange(1, texts + 1)])
    x[apart] = -1 - np.arange(texts + 1)
    inside = np.ones(len(x), dtype=bool)
    inside[apart] = False
    x[inside] = symbols
    found = [_candidates(x, int(apart[t]) + 1, int(sizes[t])) for t in np.flatnonzero(sizes >= least)]
    i = np.concatenate([np.zeros(0, dtype=np.int64), *[f[0] for f in found]])
    q = np.concatenate([np.zeros(0, dtype=np.int64), *[f[1] for f in found]])
    if not len(i):
        return (np.zeros(0, dtype=np.int64),) * 4
    text = np.searchsorted(apart, i) - 1
    # only texts with a candidate are compressed
    used = np.zeros(texts, dtype=bool)
    used[text] = True
    part = np.append(True, np.repeat(used, sizes + 1))
    place = np.cumsum(part) - 1
    grammar = Grammar(x[part])
    at = place[i]
    back = grammar.extension(at - 1, at - 1 + q, -1)
    length = back + grammar.extension(at, at + q) + q
    start = i - back - apart[text] - 1
    keep = length >= np.maximum(least, 2 * q)
    text, start, length, q = text[keep], start[keep], length[keep], q[keep]
    order = np.lexsort((q, length, start, text))
    text, start, length, q = text[order], start[order], length[order], q[order]
    new = np.append(True, (text[1:] != text[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])) if len(q) else np.zeros(0, dtype=bool)
    text, start, length, q = text[new], start[new], length[new], q[new]
    order = np.lexsort((q, start, text))
    return text[order], start[order], length[order], q[order]


def _report(column: pa.Array, least: int) -> list[pa.Array]:
    """(number of words, runs, text without the repeats) of some texts."""
    words, offsets = words_of(column)
    symbols = words.dictionary_encode().indices.to_numpy(zero_copy_only=False) if len(words) else np.zeros(0)
    text, start, length, period = find_runs(symbols.astype(np.int64), offsets, least)
    depth = np.zeros(len(symbols) + 1, dtype=np.int64)
    np.add.at(depth, offsets[text] + start + period, 1)
    np.add.at(depth, offsets[text] + start + length, -1)
    kept = np.cumsum(depth)[:-1] == 0
    ends = np.concatenate([[0], np.cumsum(kept)])[offsets]
    rest = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words.filter(pa.array(kept)))
    spans = pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in (start, length, period)], names=["start", "length", "period"])
    runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(len(offsets))), pa.int32()), spans)
    return [pa.array(np.diff(offsets), pa.int64()), runs.cast(RUNS), pc.binary_join(rest, pa.scalar(" ", pa.large_string())).cast(pa.string())]


def periodic_runs(docs: DataFrame, doc: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """(doc, n_words, runs, collapsed) of every text.

    ``runs`` are (start, length, period) in words, by start and period; ``collapsed`` is the text's words, joined by one
    blank, without those that lie in a run behind its first period.
    """
    base = tb.small_batches(docs.select(F.col(doc).alias("doc"), F.col(text).alias("text")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0), dtype=np.int64)
            for i, j in tb.spans_of_rows(np.concatenate([[0], np.cumsum(sizes)]), 6 * WORDS_AT_ONCE):
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column("doc"), *_report(part.column("text"), least)], names=["doc", "n_words", "runs", "collapsed"])

    schema = f"doc {base.schema['doc'].dataType.simpleString()}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return base.mapInArrow(work, schema).withColumnRenamed("doc", doc)

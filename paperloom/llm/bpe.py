"""Byte-pair encoding and decoding of whole texts, long ones by tree concatenation.

Texts of at most ``leaf`` characters are encoded where they are.  A longer text is cut into leaves, which are encoded as
rows of their own in parallel and put together again.  Cuts are free of error where a letter or digit is followed by a
space or line end, and at every other boundary between the pieces that the merges never cross.  A single piece longer
than a leaf (text without any boundary) is cut into parts; the encodings of two neighbouring parts are joined by
encoding a window of tokens around the join anew, and the window grows until its first token equals the left part's and
its last token the right part's.  Neighbouring parts are joined in pairs, then pairs of pairs, as a tree.

A vocabulary is a rank file (base64 of the bytes, then the id, per line); it is read on the driver and broadcast
(about 1 MB for 50,000 entries).  Token ids are returned as little-endian unsigned 32-bit integers in a binary column.

Defined cases: null texts are empty, an empty text has no tokens; special strings become their ids; rows that agree in
id and text are all returned; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm import textbatch as tb

LEAF = 1 << 15
WINDOW = 1 << 20
SPECIAL = {"<|endoftext|>": 50256}
_SAFE = re.compile(r"[A-Za-z0-9][ \n]")
_made: dict = {}


def encoding(ranks: bytes, special: dict[str, int]):
    """The encoder of a rank file, one per Python process."""
    import public_tokenizers
    import tiktoken

    key = (len(ranks), hash(ranks), tuple(special.items()))
    if key not in _made:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
        _made[key] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=special)
    return _made[key]


def _encode(enc, text: str) -> np.ndarray:
    return enc.encode_to_numpy(text, allowed_special="all", disallowed_special=())


def unsplit(text: str, leaf: int, window: int = WINDOW) -> Iterator[tuple[int, str]]:
    """Leaves of a text without safe cuts: (0, whole pieces) or, for a part of one long piece, (1, first) and (2, next)."""
    from tokenizers.pre_tokenizers import ByteLevel

    splitter, at, held = ByteLevel(add_prefix_space=False, use_regex=True), 0, ""
    size = window
    while at < len(text):
        part = text[at : at + size]
        ends = [end for _, (_, end) in splitter.pre_tokenize_str(part)]
        if at + len(part) < len(text):
            ends.pop()  # the last piece may go on behind the window
            if not ends:
                size *= 2
                continue
        size, begin = window, 0
        for end in ends:
            if end - begin > leaf:
                if held:
                    yield 0, held
                    held = ""
                for i in range(begin, end, leaf):
                    yield (1 if i == begin else 2), part[i : min(i + leaf, end)]
            elif len(held) + end - begin > leaf:
                yield 0, held
                held = part[begin:end]
            else:
                held += part[begin:end]
            begin = end
        at += begin
    if held:
        yield 0, held


def leaves(text: str, leaf: int, special: dict[str, int]) -> Iterator[tuple[int, str]]:
    """A long text as leaves whose encodings, put together, are the encoding of the text."""
    marks = re.split("(" + "|".join(map(re.escape, special)) + ")", text) if special else [text]
    for segment in marks:
        if segment in special:
            yield 0, segment
            continue
        at = 0
        while len(segment) - at > leaf:
            cut = None
            for cut in _SAFE.finditer(segment, at + leaf // 2, at + leaf):
                pass
            if cut:
                yield 0, segment[at : cut.start() + 1]
                at = cut.start() + 1
                continue
            cut = _SAFE.search(segment, at + leaf)
            stop = cut.start() + 1 if cut else len(segment)
            yield from unsplit(segment[at:stop], leaf)
            at = stop
        if at < len(segment):
            yield 0, segment[at:]


def join_encodings(enc, a: list[int], b: list[int], width: int = 4) -> list[int]:
    """The encoding of two neighbouring parts of one piece from their own encodings."""
    while True:
        i, j = max(0, len(a) - width), min(len(b), width)
        anew = enc._encode_single_piece(enc.decode_bytes(a[i:] + b[:j]))
        if (i == 0 or anew[0] == a[i]) and (j == len(b) or anew[-1] == b[j - 1]):
            return a[:i] + anew + b[j:]
        width *= 2


def join_tree(enc, parts: list[list[int]]) -> list[int]:
    while len(parts) > 1:
        parts = [join_encodings(enc, *parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def _decode(enc, ids: bytes | None) -> str:
    return enc.decode_bytes(np.frombuffer(ids or b"", dtype="<u4").tolist()).decode("utf-8", "replace")


def _rows(enc, doc, ids: list[bytes], decoded: bool) -> pa.RecordBatch:
    columns = {"doc": doc, "ids": pa.array(ids, pa.binary())}
    if decoded:
        columns["decoded"] = pa.array([_decode(enc, x) for x in ids], pa.string())
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _short(ranks, special, decoded):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks.value, special)
        for batch in batches:
            ids = [_encode(enc, t or "").astype("<u4").tobytes() for t in batch.column("text").to_pylist()]
            yield _rows(enc, batch.column("doc"), ids, decoded)

    return work


def _cut(leaf, special):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = list(leaves(batch.column("text")[i].as_py(), leaf, special))
                for lo in range(0, len(found), 64):
                    some = found[lo : lo + 64]
                    at = pa.array([i] * len(some))
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("doc").take(at), batch.column("text_hash").take(at), pa.array(range(lo, lo + len(some)), pa.int32()),
                            pa.array([k for k, _ in some], pa.int32()), pa.array([t for _, t in some]),
                        ],
                        names=["doc", "text_hash", "piece", "kind", "text"],
                    )

    return work


def _leaf(ranks, special):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks.value, special)
        for batch in batches:
            ids = [
                (np.array(enc._encode_single_piece(t), dtype="<u4") if kind else _encode(enc, t).astype("<u4")).tobytes()
                for kind, t in zip(batch.column("kind").to_pylist(), batch.column("text").to_pylist())
            ]
            columns = [batch.column(c) for c in ("doc", "text_hash", "piece", "kind")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.binary())], names=["doc", "text_hash", "piece", "kind", "ids"])

    return work


def _together(ranks, special, decoded):
    """Sorted leaves (doc, text_hash, piece) → one row per document row; equal rows come as repeated leaves."""

    def whole(enc, leaves: list[tuple[int, int, bytes]]) -> tuple[bytes, int]:
        out, parts, seen, copies = [], [], -1, 0
        for piece, kind, ids in leaves:
            copies += piece == 0
            if piece == seen:
                continue
            seen = piece
            if kind != 2 and parts:
                out.append(np.array(join_tree(enc, parts), dtype="<u4").tobytes())
                parts = []
            if kind:
                parts.append(np.frombuffer(ids, dtype="<u4").tolist())
            else:
                out.append(ids)
        if parts:
            out.append(np.array(join_tree(enc, parts), dtype="<u4").tobytes())
        return b"".join(out), copies

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks.value, special)
        key, held, kind = None, [], pa.null()

        def emit():
            ids, copies = whole(enc, held)
            return _rows(enc, pa.array([key[0]] * copies, kind), [ids] * copies, decoded)

        for batch in batches:
            kind = batch.schema.field("doc").type
            columns = [batch.column(c).to_pylist() for c in ("doc", "text_hash", "piece", "kind", "ids")]
            for doc, text_hash, *leaf in zip(*columns):
                if held and (doc, text_hash) != key:
                    yield emit()
                    held = []
                key = (doc, text_hash)
                held.append(leaf)
        if held:
            yield emit()

    return work


def encode(
    docs: DataFrame, ranks_path: str, doc: str = "doc_id", text: str = "text", special: dict[str, int] | None = None, leaf: int = LEAF, decoded: bool = False
) -> DataFrame:
    """(doc, ids): the token ids of every whole text; with ``decoded`` also the text they decode to, made in the same pass."""
    special = SPECIAL if special is None else special
    with open(ranks_path, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    base = tb.small_batches(docs.select(F.col(doc).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text")))
    kind = base.schema["doc"].dataType.simpleString()
    schema = f"doc {kind}, ids binary" + ", decoded string" * decoded
    short = base.filter(F.char_length("text") <= leaf).mapInArrow(_short(ranks, special, decoded), schema)
    long = base.filter(F.char_length("text") > leaf).withColumn("text_hash", F.xxhash64("text"))
    cut = long.mapInArrow(_cut(leaf, special), f"doc {kind}, text_hash long, piece int, kind int, text string")
    done = cut.repartition("doc", "text_hash", "piece").mapInArrow(_leaf(ranks, special), f"doc {kind}, text_hash long, piece int, kind int, ids binary")
    whole = done.repartition("doc", "text_hash").sortWithinPartitions("doc", "text_hash", "piece").mapInArrow(_together(ranks, special, decoded), schema)
    return short.unionByName(whole).withColumnRenamed("doc", doc)


def decode(encoded: DataFrame, ranks_path: str, ids: str = "ids", out: str = "decoded", special: dict[str, int] | None = None) -> DataFrame:
    """Adds the text of the ids, special tokens included; a null is empty."""
    special = SPECIAL if special is None else special
    with open(ranks_path, "rb") as f:
        ranks = encoded.sparkSession.sparkContext.broadcast(f.read())
    names = [c for c in encoded.columns if c != out]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks.value, special)
        for batch in batches:
            texts = [_decode(enc, b) for b in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out])

    kept = tb.small_batches(encoded.select(*names))
    return kept.mapInArrow(work, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + f", `{out}` string")

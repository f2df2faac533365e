"""Document fingerprints from prefix polynomial hashes.

``PrefixHashes`` holds, for two bases modulo 2^31 - 1, the hashes of all prefixes of a text: any two spans are compared
in constant time and the longest common extension of two positions is found by binary search.  A fingerprint keeps the
length, the hash of the whole text and the hashes of those prefixes and suffixes whose lengths lie on a grid that grows
by a quarter; it is computed in pieces, so a text of any length needs bounded memory.  The likeness of two fingerprints
is the share of the longer text that their common prefix and common suffix cover, both found by binary search over the
grid and so rounded down by a fifth at most; it is 1 for equal texts only.

Defined cases: a null text is empty; two empty texts are equal (1), an empty and another text unlike (0); an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm import textbatch as tb

PRIME = (1 << 31) - 1
# The bases of the two polynomials.
BASES = (48271, 1_664_525_093 % PRIME)
PIECE = 1 << 18
GROWTH = 1.25
DIGITS = 6
_P = np.uint64(PRIME)
_S = np.uint64(31)


def _reduced(x: np.ndarray) -> np.ndarray:
    """Congruent values below 2^31 + 2^22, given values below 2^53."""
    return (x & _P) + (x >> _S)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    have = 1
    while have < n:
        step = np.uint64(pow(base, have, PRIME))
        more = min(have, n - have)
        out[have : have + more] = (out[:more] * step) % _P
        have += more
    return out


_POWERS = [_powers(b, PIECE) for b in BASES]
_grid = [1]


def grid(n: int) -> list[int]:
    """Grid lengths below n."""
    while _grid[-1] < n:
        _grid.append(max(_grid[-1] + 1, int(_grid[-1] * GROWTH)))
    return _grid[: int(np.searchsorted(_grid, n))]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def prefix_hashes_at(points: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hashes of the prefixes of the given ascending lengths, one row per base."""
    out = np.zeros((len(BASES), len(lengths)), dtype=np.uint64)
    for k, base in enumerate(BASES):
        before, shift = 0, 1
        for start in range(0, max(len(points), 1), PIECE):
            piece = points[start : start + PIECE].astype(np.uint64) + np.uint64(1)
            sums = np.concatenate([[np.uint64(0)], np.cumsum(_reduced(piece * _POWERS[k][: len(piece)]))])
            lo, hi = np.searchsorted(lengths, start, "left" if start == 0 else "right"), np.searchsorted(lengths, start + len(piece), "right")
            local = sums[lengths[lo:hi] - start] % _P
            out[k, lo:hi] = (np.uint64(before) + local * np.uint64(shift)) % _P
            before = (before + int(sums[-1] % _P) * shift) % PRIME
            shift = shift * pow(base, len(piece), PRIME) % PRIME
    return out


class PrefixHashes:
    """The prefix hashes of a text at all lengths."""

    def __init__(self, text: str):
        points = code_points(text)
        self.n = len(points)
        self.sums = prefix_hashes_at(points, np.arange(self.n + 1))

    def span(self, start: int, end: int) -> tuple[int, ...]:
        """A value that is equal for equal spans, wherever they stand."""
        return tuple(
            (int(s[end]) - int(s[start])) * pow(b, -start, PRIME) % PRIME for b, s in zip(BASES, self.sums)
        )

    def equal(self, start: int, other: PrefixHashes, at: int, length: int) -> bool:
        return self.span(start, start + length) == other.span(at, at + length)

    def common_extension(self, start: int, other: PrefixHashes, at: int) -> int:
        """How many characters from ``start`` here and from ``at`` there agree."""
        low, high = 0, min(self.n - start, other.n - at)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.equal(start, other, at, mid) else (low, mid - 1)
        return low


def fingerprint(text: str) -> str:
    points = code_points(text)
    n = len(points)
    short = np.array(grid(n), dtype=np.int64)
    lengths = np.unique(np.concatenate([short, n - short, [n]]))
    sums = prefix_hashes_at(points, lengths)
    at = {int(x): i for i, x in enumerate(lengths)}
    whole = [int(s[at[n]]) for s in sums]
    if n == 0:
        return f"0-{whole[0]:08x}{whole[1]:08x}--"
    prefix = sums[:, [at[int(x)] for x in short]]
    cut = sums[:, [at[n - int(x)] for x in short]]
    suffix = np.stack([
        (np.uint64(w) + _P - c) % _P * np.array([pow(b, -(n - int(x)), PRIME) for x in short], dtype=np.uint64) % _P
        for w, c, b in zip(whole, cut, BASES)
    ])

    def coded(h: np.ndarray) -> str:
        both = tb.mix((h[0] << np.uint64(32)) ^ h[1]) >> np.uint64(64 - 4 * DIGITS)
        return "".join(f"{int(x):0{DIGITS}x}" for x in both)

    return f"{n:x}-{whole[0]:08x}{whole[1]:08x}-{coded(prefix)}-{coded(suffix)}"


def _common(a: str, b: str) -> int:
    """The largest grid length at which both agree, by binary search."""
    low, high = 0, min(len(a), len(b)) // DIGITS
    while low < high:
        mid = (low + high + 1) // 2
        same = a[(mid - 1) * DIGITS : mid * DIGITS] == b[(mid - 1) * DIGITS : mid * DIGITS]
        low, high = (mid, high) if same else (low, mid - 1)
    return _grid[low - 1] if low else 0


def likeness(a: str, b: str) -> float:
    (n, h, p, s), (m, g, q, t) = a.split("-"), b.split("-")
    if n == m and h == g:
        return 1.0
    longer = max(int(n, 16), int(m, 16))
    grid(longer)
    return min((_common(p, q) + _common(s, t)) / longer, 1 - 1 / (longer + 1))


def fingerprints(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, fingerprint) of every text."""
    base = tb.small_batches(docs.select(F.col(doc).alias("doc"), F.col(text).alias("text")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(made, pa.string())], names=["doc", "fingerprint"])

    return base.mapInArrow(work, f"doc {base.schema['doc'].dataType.simpleString()}, fingerprint string").withColumnRenamed("doc", doc)


def _range_number(value: Column, bounds: list) -> Column:
    """How many of the descending bounds lie above the value; two steps over the square root of their number each."""
    width = max(1, int(len(bounds) ** 0.5))
    parts = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    table = F.array(*[F.array(*[F.lit(x) for x in p]) for p in parts])
    coarse = F.size(F.filter(F.array(*[F.lit(p[-1]) for p in parts]), lambda x: x > value))
    fine = F.coalesce(F.size(F.filter(F.get(table, coarse), lambda x: x > value)), F.lit(0))
    return F.when(value.isNull(), F.lit(len(bounds) + 1)).otherwise(F.least(coarse * width + F.greatest(fine, F.lit(0)), F.lit(len(bounds))))


def in_order_with_next(docs: DataFrame, doc: str, text: str, ranges: int) -> DataFrame:
    """Rows (bucket, guest, doc, text) dealt into ranges of descending doc, each followed by the next range's first row.

    Sorted by (bucket, guest, descending doc, text hash), every row's successor stands behind it; the last range is
    followed by the very first row.  Ids are numbers; nulls come last.  Only one short row per range reaches the driver.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(doc).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    shares = [i / ranges for i in range(1, ranges)]
    found = base.agg(F.percentile_approx("doc", shares, 100 * ranges).alias("q")).collect()[0]["q"] if shares else []
    bounds = sorted(set(found or []), reverse=True)
    number = _range_number(F.col("doc"), bounds) if bounds else F.lit(0)
    base = base.withColumn("bucket", number).withColumn("hash", F.xxhash64("text"))
    firsts = base.groupBy("bucket").agg(F.max_by(F.struct("doc", "hash"), F.struct("doc", -F.col("hash"))).alias("first"))
    firsts = sorted(firsts.collect(), key=lambda r: r["bucket"])
    kind = base.schema["doc"].dataType.simpleString()
    guests = [(r["first"]["doc"], r["first"]["hash"], firsts[i - 1]["bucket"]) for i, r in enumerate(firsts)]
    table = spark.createDataFrame(guests, f"first_doc {kind}, first_hash long, before int")
    marked = base.join(F.broadcast(table), base["doc"].eqNullSafe(table["first_doc"]) & (base["hash"] == table["first_hash"]), "left")
    here = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("guest"))
    there = F.struct(F.col("before").alias("bucket"), F.lit(1).alias("guest"))
    both = marked.withColumn("at", F.explode(F.when(F.col("before").isNull(), F.array(here)).otherwise(F.array(here, there))))
    rows = both.select("at.bucket", "at.guest", "doc", "hash", "text")
    dealt = rows.repartition(ranges, "bucket").sortWithinPartitions("bucket", "guest", F.col("doc").desc_nulls_last(), "hash")
    return dealt.select("bucket", "guest", "doc", "text")


def edit_report(docs: DataFrame, doc: str = "doc_id", text: str = "text", ranges: int | None = None) -> DataFrame:
    """Every text's fingerprint next to that of its edited text and of the next document.

    The edited text has its last third replaced by the beginning of the next document, by descending id.
    """
    import hashlib

    ranges = ranges or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = tb.small_batches(in_order_with_next(docs, doc, text, ranges))
    kind = rows.schema["doc"].dataType.simpleString()
    names = ["doc", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def report(doc, text, print_, next_text, next_print) -> tuple:
        n = len(text)
        edited = text[: n - n // 3] + next_text[: n // 3]
        edited_print = print_ if edited == text else fingerprint(edited)
        digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        return doc, n, digest, print_, edited_print, likeness(print_, edited_print), likeness(print_, next_print)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            made = []
            for bucket, guest, doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                print_ = fingerprint(text)
                if before is not None and before[0] == bucket and not before[1]:
                    made.append(report(*before[2:], text, print_))
                before = (bucket, guest, doc, text, print_)
            columns = list(zip(*made)) if made else [[] for _ in names]
            kinds = [batch.schema.field("doc").type, pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    schema = f"doc {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return rows.mapInArrow(work, schema).withColumnRenamed("doc", doc)

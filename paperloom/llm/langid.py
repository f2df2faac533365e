"""Language identification: nearest of several centroids per language over normalised TF-IDF letter n-grams.

Texts are lower-cased and reduced to letters and single blanks; their n-grams of two and three characters are hashed
into ``DIMS`` features, weighted by 1 + log(count) and the inverse document frequency over all learnable rows, and
brought to length one.  A bounded sample of rows per language is clustered by cosine into ``clusters`` centroids.  A text
gets the language of the nearest centroid; if it lies farther from it than nearly all of the centroid's own rows did
(their ``REJECT`` quantile, widened by ``SLACK``), it is marked as rejected.

Document frequencies count every learnable row; only the clustering uses the sample, of about ``per_language`` rows of
each language (default 400), of which each is at most ``DIMS`` numbers.  Centroids (languages x clusters x DIMS x 4
bytes) travel with the tasks.  Defined cases: null texts and texts without a letter are ``und`` with score 0, and so are
all without learnable rows; languages that are null are not learned; equal distances go to the first centroid by
language and number; repeated rows are judged alike; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm import textbatch as tb
from paperloom.llm.labelled import held_out

BITS = 13
DIMS = 1 << BITS
PER_LANGUAGE, CLUSTERS, ROUNDS = 400, 4, 12
REJECT, SLACK = 0.01, 0.05
NONE = "und"
CHARS, ROWS = 1 << 19, 64
_U = np.uint64
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


def _counts(texts: list[str]) -> np.ndarray:
    """n-gram counts, one row per text."""
    joined = [f" {t.lower()} " for t in texts]
    points = np.frombuffer("".join(joined).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    row = np.repeat(np.arange(len(texts)), [len(t) for t in joined])
    c = np.where(_is_letter()[points], points, 32)
    keep = np.append(True, (c[1:] != 32) | (c[:-1] != 32) | (row[1:] != row[:-1]))
    c, row = c[keep].astype(np.uint64), row[keep]
    found = []
    for n, bucket in _buckets(c):
        found.append((row[: len(bucket)] * DIMS + bucket)[row[: len(bucket)] == row[n - 1 :]])
    return np.bincount(np.concatenate(found) if found else np.zeros(0, dtype=np.int64), minlength=len(texts) * DIMS).reshape(len(texts), DIMS)


def _buckets(c: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(n, feature of every n-gram) for pairs and triples of symbols."""
    two = c[:-1] * _U(0x9E3779B97F4A7C15) + c[1:] * _U(0xC2B2AE3D27D4EB4F)
    for n, h in ((2, two), (3, two[:-1] * _U(0x165667B19E3779F9) + c[2:] * _U(0xD6E8FEB86659FD93) if len(c) > 2 else two[:0])):
        if len(h):
            h = h ^ (h >> _U(29))
            yield n, ((h * _U(0xBF58476D1CE4E5B9)) >> _U(64 - BITS)).astype(np.int64)


def _groups(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, last row, counts) for groups of rows of bounded text; a long text is counted in parts."""
    i = 0
    while i < len(texts):
        j, chars = i, 0
        while j < len(texts) and j - i < ROWS and (j == i or chars + len(texts[j] or "") <= CHARS):
            chars += len(texts[j] or "")
            j += 1
        if chars <= CHARS:
            yield i, j, _counts([t or "" for t in texts[i:j]])
        else:
            yield i, j, _long_counts(texts[i])
        i = j


def _long_counts(text: str) -> np.ndarray:
    """As ``_counts`` for one text, a part at a time; the last two symbols of a part lead the next one, wherever it is cut."""
    low, total, carry = f" {text.lower()} ", np.zeros(DIMS, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    for at in range(0, len(low), CHARS):
        points = np.frombuffer(low[at : at + CHARS].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        c = np.concatenate([carry, np.where(_is_letter()[points], points, 32).astype(np.uint64)])
        c = c[np.append(True, (c[1:] != 32) | (c[:-1] != 32))]
        for n, bucket in _buckets(c):
            # those that lie in the lead alone were counted before
            total += np.bincount(bucket[max(len(carry) - n + 1, 0) :], minlength=DIMS)
        carry = c[-2:]
    return total[None, :]


def _vectors(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse (row, feature, weight) of rows of length one."""
    row, feature = np.nonzero(counts)
    weight = (1 + np.log(counts[row, feature])) * idf[feature]
    length = np.sqrt(np.bincount(row, weights=weight * weight, minlength=len(counts)))
    return row, feature, weight / np.where(length[row] > 0, length[row], 1)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, rows = np.zeros(DIMS, dtype=np.int64), 0
    for batch in batches:
        for _, _, counts in _groups(batch.column("text").to_pylist()):
            total += (counts > 0).sum(axis=0)
            rows += len(counts)
    feature = np.append(np.flatnonzero(total), DIMS)
    yield pa.RecordBatch.from_arrays([pa.array(feature), pa.array(np.append(total, rows)[feature])], names=["feature", "n"])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, counts in _groups(batch.column("text").to_pylist()):
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang").slice(i, j - i), batch.column("seed").slice(i, j - i), pa.array([r.astype("<u4").tobytes() for r in counts], pa.binary())],
                names=["lang", "seed", "counts"],
            )


def cluster(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(centroids of length one, least cosine that a row of theirs may have), by cosine; starts far apart."""
    chosen = [int(np.argmax(x @ x.mean(axis=0)))]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(np.argmin((x @ x[chosen].T).max(axis=1))))
    c = x[chosen].copy()
    for _ in range(ROUNDS):
        own = np.argmax(x @ c.T, axis=1)
        for i in range(len(c)):
            if (own == i).any():
                c[i] = x[own == i].mean(axis=0)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    near = x @ c.T
    own = np.argmax(near, axis=1)
    floor = np.array([np.quantile(near[own == i, i], REJECT) if (own == i).any() else 1.0 for i in range(len(c))])
    return c, floor - SLACK


def train(docs: DataFrame, doc: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, clusters: int = CLUSTERS) -> dict:
    """The model of all rows outside the held-out fold whose language is known."""
    base = docs.select(F.col(doc).alias("doc"), F.col(lang).alias("lang"), F.col(text).alias("text")).filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc"))
    )
    sizes = {r["lang"]: r["n"] for r in base.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return {"langs": [], "centroids": np.zeros((0, DIMS), dtype=np.float32), "floor": np.zeros(0), "idf": np.zeros(DIMS)}
    seen = tb.small_batches(base.select("text")).mapInArrow(_frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    n = {r["feature"]: r["n"] for r in seen}
    idf = np.log((1 + n[DIMS]) / (1 + np.array([n.get(i, 0) for i in range(DIMS)]))) + 1

    share = F.create_map(*[F.lit(x) for l, c in sizes.items() for x in (l, min(1 << 20, int((1 << 20) * per_language / c) + 1))])
    seed = F.xxhash64("doc", "text", F.lit("sample"))
    picked = base.select("lang", seed.alias("seed"), "text").filter(F.pmod("seed", F.lit(1 << 20)) < F.element_at(share, F.col("lang")))
    sample = picked.mapInArrow(_sampled, "lang string, seed long, counts binary")

    def fit(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("seed")
        counts = np.stack([np.frombuffer(b, dtype="<u4") for b in table.column("counts").to_pylist()])
        row, feature, weight = _vectors(counts, idf)
        x = np.zeros(counts.shape, dtype=np.float32)
        x[row, feature] = weight
        c, floor = cluster(x, clusters)
        return pa.table({"lang": [key[0].as_py()] * len(c), "number": pa.array(range(len(c)), pa.int32()), "floor": floor.astype(np.float64), "centroid": [v.astype("<f4").tobytes() for v in c]})

    fitted = sample.groupBy("lang").applyInArrow(fit, "lang string, number int, floor double, centroid binary")
    rows = sorted(fitted.collect(), key=lambda r: (r["lang"], r["number"]))
    return {
        "langs": [r["lang"] for r in rows], "floor": np.array([r["floor"] for r in rows]), "idf": idf,
        "centroids": np.stack([np.frombuffer(r["centroid"], dtype="<f4") for r in rows]),
    }


def predict(docs: DataFrame, model: dict, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, held_out, lang_pred, score, rejected) of every whole text; the score is the cosine to the centroid."""
    langs, floor, idf, centroids = model["langs"], model["floor"], model["idf"], np.ascontiguousarray(model["centroids"].T)
    base = tb.small_batches(docs.select(F.col(doc).alias("doc"), held_out(F.col(doc)).alias("held_out"), F.col(text).alias("text")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, score, rejected = [], [], []
            for i, j, counts in _groups(batch.column("text").to_pylist()):
                some = counts.any(axis=1)
                if not langs:
                    pred += [NONE] * (j - i)
                    score += [0.0] * (j - i)
                    rejected += [True] * (j - i)
                    continue
                row, feature, weight = _vectors(counts, idf)
                near = np.zeros((j - i, len(langs)))
                start = np.searchsorted(row, np.arange(j - i))
                if len(row):
                    near[some] = np.add.reduceat(centroids[feature] * weight[:, None], start[some], axis=0)
                best = near.argmax(axis=1)
                top = np.clip(near[np.arange(j - i), best], 0, 1)
                pred += [langs[b] if s else NONE for b, s in zip(best, some)]
                score += np.where(some, top, 0.0).tolist()
                rejected += (~some | (top < floor[best])).tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("held_out"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                names=["doc", "held_out", "lang_pred", "score", "rejected"],
            )

    kind = base.schema["doc"].dataType.simpleString()
    return base.mapInArrow(work, f"doc {kind}, held_out boolean, lang_pred string, score double, rejected boolean").withColumnRenamed("doc", doc)

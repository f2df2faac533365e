"""Secret scans: strong patterns alone, weak ones only where the parts of one credential meet.

Strong kinds are reported wherever they occur: ``assign`` (a keyword, a sign and a value of six characters or more),
``access`` (cloud access ids) and ``hex`` (long hexadecimal runs).  Weak kinds are ``identifier`` (user or client
names), ``weak_secret`` (long mixed runs) and ``endpoint`` (service addresses).  A credential has an identifier, a
secret and mostly an endpoint: parts are joined by overlapping scopes of ``scope`` code points within a document, and a
weak span is reported only when the parts that complete it are in reach: an identifier with a secret, a secret with an
identifier, an endpoint with both.

The texts are searched once and written with their spans; only those with a weak candidate are shuffled after that.  The join meets on (document, cell of the scope);
spans of one kind do not overlap, so the partners of a span are bounded by the scope, not by the document.

Defined cases: null and empty texts have no spans; positions are code points, ends exclusive; spans are ordered by
start, then kind as listed; rows that agree in id and text get the same spans; an empty table works; further columns
are kept, but ``scan`` replaces any named like its results; names that begin with __pl_ are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.session import cut_lineage

SCOPE = 200


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def _any(*words: str) -> str:
    return "(?:" + "|".join(either_case(w) for w in words) + ")"


# The patterns, the value of an assignment as their last group.
VALUE = "([A-Za-z0-9+/_.=-]+)"
_SIGN = "[\"']?\\x20*[:=]\\x20*[\"']?"
PATTERNS = {
    "assign": _any("password", "passwd", "secret", "token", "api_?key") + _SIGN + VALUE,
    "access": "AKIA[A-Z0-9]{16,}",
    "hex": "[0-9a-f]{24,}",
    "identifier": _any("username", "user", "login", "account", "client_?id") + _SIGN + "[A-Za-z0-9@+_.-]{3,}",
    "weak_secret": "[A-Za-z0-9+/]{32,}",
    "endpoint": "(?:https?|ftp|s3|jdbc|postgres|postgresql|mysql|mongodb|redis|amqp)://[^\\x00-\\x20\"'<>]+",
}
KINDS = list(PATTERNS)
STRONG, WEAK = KINDS[:3], KINDS[3:]
MIN_VALUE = 6
OUTPUT = ("base_spans", "all_spans")
SPAN = "struct<start:int,k:int,end:int>"


def _kept(kind: str, match: Column) -> Column:
    if kind == "assign":
        return F.char_length(F.regexp_extract(match, PATTERNS["assign"], 1)) >= MIN_VALUE
    if kind == "weak_secret":
        return F.regexp_like(match, F.lit("[0-9]")) & F.regexp_like(match, F.lit("[A-Za-z]"))
    return F.lit(True)


def spans_of(text: Column, kind: str) -> Column:
    """Every kept match as (start, k, end): the pieces between matches give the positions."""
    pattern = PATTERNS[kind]
    pieces = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sized = F.zip_with(pieces, matches, lambda p, m: F.struct(F.char_length(p).alias("gap"), F.char_length(m).alias("len"), _kept(kind, m).alias("keep")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        start = acc.getField("at") + x.getField("gap")
        end = start + F.coalesce(x.getField("len"), F.lit(0))
        one = F.array(F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("k"), end.alias("end")))
        grown = F.when(F.coalesce(x.getField("keep"), F.lit(False)) & x.getField("len").isNotNull(), F.concat(acc.getField("spans"), one))
        return F.struct(end.alias("at"), grown.otherwise(acc.getField("spans")).alias("spans"))

    found = F.aggregate(sized, zero, step).getField("spans")
    return F.when(F.regexp_like(text, F.lit(pattern)), found).otherwise(F.array().cast(f"array<{SPAN}>"))


def _all_of(text: Column, kinds: list[str]) -> Column:
    return F.array_sort(F.concat(*[spans_of(text, k) for k in kinds]))


def _has_any(text: Column, kinds: list[str]) -> Column:
    return F.regexp_like(text, F.lit("|".join(f"(?:{PATTERNS[k]})" for k in kinds)))


def scan(docs: DataFrame, doc: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """All columns of docs with ``base_spans`` (strong kinds) and ``all_spans`` (with the linked weak ones)."""
    body = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast(f"array<{SPAN}>")
    marked = docs.select(
        *[c for c in docs.columns if c not in OUTPUT], F.xxhash64(text).alias("__pl_hash"),
        F.when(_has_any(body, STRONG), _all_of(body, STRONG)).otherwise(none).alias("base_spans"),
        F.when(_has_any(body, WEAK), _all_of(body, WEAK)).otherwise(none).alias("__pl_weak"),
    )
    # the texts are searched once; what follows reads the written spans
    marked = cut_lineage(marked)
    apart = F.filter("__pl_weak", lambda w: ~F.exists("base_spans", lambda b: (b.getField("start") < w.getField("end")) & (w.getField("start") < b.getField("end"))))
    plain = marked.filter(F.size("__pl_weak") == 0).withColumn("all_spans", F.col("base_spans"))
    mixed = marked.filter(F.size("__pl_weak") > 0).withColumn("__pl_weak", apart)
    parts = mixed.select(F.col(doc).alias("__pl_doc"), "__pl_hash", F.explode(F.concat("base_spans", "__pl_weak")).alias("s")).distinct()
    linked = _linked(parts.select("__pl_doc", "__pl_hash", "s.*"), scope)
    joined = mixed.join(linked, mixed[doc].eqNullSafe(linked["__pl_doc"]) & (mixed["__pl_hash"] == linked["__pl_link_hash"]), "left")
    joined = joined.withColumn("all_spans", F.array_sort(F.concat("base_spans", F.coalesce("__pl_linked", none))))
    names = [*[c for c in docs.columns if c not in OUTPUT], *OUTPUT]
    return plain.select(*names).unionByName(joined.select(*names))


def _linked(parts: DataFrame, scope: int) -> DataFrame:
    """One row per document with links: weak spans whose complement lies within ``scope`` of them."""
    def is_kind(*kinds: str) -> Column:
        return F.col("k").isin(*[KINDS.index(k) for k in kinds])

    role = F.when(is_kind("access", "identifier"), "id").when(is_kind("endpoint"), "at").otherwise("key")
    # Both sides cover every cell they touch: two intervals that overlap meet in the cell where the later one starts.
    reach = parts.withColumn("role", role).withColumn(
        "cell", F.explode(F.sequence(F.floor((F.col("start") - scope) / scope), F.floor((F.col("end") + scope) / scope)))
    ).select(F.col("__pl_doc").alias("d2"), F.col("__pl_hash").alias("h2"), "cell", "role", F.col("start").alias("s2"), F.col("end").alias("e2"))
    weak = parts.filter(is_kind(*WEAK)).withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / scope), F.floor(F.col("end") / scope))))
    meeting = F.floor(F.greatest(F.col("start"), F.col("s2") - scope) / scope)
    near = weak.join(
        reach,
        weak["__pl_doc"].eqNullSafe(reach["d2"]) & (weak["__pl_hash"] == reach["h2"]) & (weak["cell"] == reach["cell"]) & (weak["cell"] == meeting)
        & (F.col("s2") - scope <= F.col("end")) & (F.col("start") <= F.col("e2") + scope),
    )
    roles = near.groupBy("__pl_doc", "__pl_hash", "start", "k", "end").agg(F.collect_set("role").alias("roles"))
    has_id, has_key = F.array_contains("roles", "id"), F.array_contains("roles", "key")
    complete = (
        F.when(is_kind("identifier"), has_key).when(is_kind("weak_secret"), has_id).otherwise(has_id & has_key)
    )
    return (
        roles.filter(complete).groupBy("__pl_doc", F.col("__pl_hash").alias("__pl_link_hash"))
        .agg(F.array_sort(F.collect_list(F.struct("start", "k", "end"))).alias("__pl_linked"))
    )


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s.getField("k")), s.getField("start"), s.getField("end"))), ",")


def redact(docs: DataFrame, doc: str = "doc_id", text: str = "text", mark: str = "[secret]", scope: int = SCOPE) -> DataFrame:
    """The documents with every reported span, overlapping ones as one, replaced by ``mark``."""
    found = scan(docs.withColumnsRenamed({c: f"__pl_own_{c}" for c in OUTPUT}), doc, text, scope)
    zero = F.array().cast("array<struct<start:int,end:int>>")

    def merge(acc: Column, s: Column) -> Column:
        last, one = F.element_at(acc, -1), F.array(F.struct(s.getField("start").alias("start"), s.getField("end").alias("end")))
        longer = F.struct(last.getField("start").alias("start"), F.greatest(last.getField("end"), s.getField("end")).alias("end"))
        return (
            F.when(F.size(acc) == 0, one)
            .when(s.getField("start") < last.getField("end"), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(longer)))
            .otherwise(F.concat(acc, one))
        )

    cuts = F.concat(F.aggregate("all_spans", zero, merge), F.array(F.struct(F.char_length(text).alias("start"), F.lit(0).alias("end"))))
    cut = found.withColumn("__pl_cuts", F.when(F.size("all_spans") > 0, cuts))
    pieces = F.transform(
        "__pl_cuts",
        lambda c, i: F.col(text).substr(
            F.when(i == 0, 0).otherwise(F.get(F.col("__pl_cuts"), i - 1).getField("end")) + 1,
            c.getField("start") - F.when(i == 0, 0).otherwise(F.get(F.col("__pl_cuts"), i - 1).getField("end")),
        ),
    )
    return cut.withColumn(text, F.when(F.col("__pl_cuts").isNull(), F.col(text)).otherwise(F.array_join(pieces, mark))).select(
        *[F.col(f"__pl_own_{c}").alias(c) if c in OUTPUT else c for c in docs.columns]
    )

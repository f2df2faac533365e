"""URL filters: pattern rules behind an index of literal tokens, in Spark expressions only.

A rule is a regular expression over ``host + path`` with the whole tokens (runs of letters and digits) that every
matching url must hold.  Each rule is filed under the one of its tokens that is rarest in the urls at hand.  The tokens
of a url fetch candidate rules from the index, and only candidates run their expression; rules without a token are
candidates of every url.  The index is a constant of the plan, a hash table of at most ``block`` rules; longer rule
lists are applied block by block, each with its own constant, so nothing is shuffled and nothing is left out.

Defined cases: a url that is null or has no ``://`` has empty host and path and gets the default verdict; of several
matching rules the highest (priority, length of name, name) decides; repeated rows are judged one by one; an empty
table or an empty rule list works; further columns of any name are kept.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters lower-cased in hosts; what separates tokens.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN_TOKENS = "[^0-9A-Za-z]+"
ENTRY = "array<array<struct<token:string,pattern:string,priority:int,name:string,verdict:string>>>"


@dataclass(frozen=True)
class Rule:
    """``name`` is reported; ``pattern`` runs on host + path; ``tokens`` must all occur there as whole tokens."""

    name: str
    pattern: str
    verdict: str
    tokens: tuple[str, ...] = ()
    priority: int = 0


def site_rule(host: str, path: str, verdict: str, priority: int = 1) -> Rule:
    """A host with all its subdomains and a path prefix."""
    cut = max((i for i, c in enumerate(path) if not re.match("[0-9A-Za-z]", c)), default=-1) + 1
    whole = [t for t in re.split(BETWEEN_TOKENS, f"{host}/{path[:cut]}") if t]
    return Rule(host + path, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", verdict, tuple(dict.fromkeys(whole)), priority)


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(place: Column) -> Column:
    return F.array_distinct(F.filter(F.split(place, BETWEEN_TOKENS, -1), lambda t: t != ""))


def token_counts(places: DataFrame, place: str, wanted: Iterable[str]) -> dict[str, int]:
    """In how many rows each wanted token occurs; at most one row per wanted token reaches the driver."""
    wanted = sorted(set(wanted))
    if not wanted:
        return {}
    hits = places.select(F.explode(F.array_intersect(tokens_of(F.col(place)), F.array(*[F.lit(t) for t in wanted]))).alias("token"))
    return {r["token"]: r["n"] for r in hits.groupBy("token").agg(F.count("*").alias("n")).collect()}


def _index(rules: list[Rule], counts: dict[str, int]) -> tuple[Column, int]:
    """Constant hash table of rules under their rarest tokens; slot 0 holds those without a token."""
    slots = 1 << max(4, (2 * len(rules)).bit_length())
    table: list[list[dict]] = [[] for _ in range(slots + 1)]
    spark_hash = _crc_slots({t for r in rules for t in r.tokens}, slots)
    for r in rules:
        token = min(r.tokens, key=lambda t: (counts.get(t, 0), t), default="")
        at = spark_hash[token] if token else 0
        table[at].append({"token": token, "pattern": r.pattern, "priority": r.priority, "name": r.name, "verdict": r.verdict})
    return F.from_json(F.lit(json.dumps(table)), ENTRY), slots


def _candidates(tokens: Column, table: Column, slots: int) -> Column:
    def fetch(token: Column) -> Column:
        bucket = F.get(table, F.pmod(F.crc32(F.encode(token, "UTF-8")), F.lit(slots)).cast("int") + 1)
        return F.filter(bucket, lambda r: r.getField("token") == token)

    return F.concat(F.get(table, F.lit(0)), F.flatten(F.transform(tokens, fetch)))


def _crc_slots(tokens: Iterable[str], slots: int) -> dict[str, int]:
    from zlib import crc32

    return {t: crc32(t.encode()) % slots + 1 for t in tokens}


def judge_urls(
    pages: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow", block: int = 10_000, counts: dict[str, int] | None = None
) -> DataFrame:
    """Adds host, path, rule (null if none fits) and verdict; columns of the input with these names are replaced."""
    out = pages.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    if counts is None:
        place = pages.select(F.concat(host_of(F.col(url)), path_of(F.col(url))).alias("place"))
        counts = token_counts(place, "place", (t for r in rules for t in r.tokens))
    place = F.concat("host", "path")
    best = F.lit(None).cast("struct<priority:int,length:int,name:string,verdict:string>")
    for i in range(0, len(rules), block):
        candidates = _candidates(tokens_of(place), *_index(rules[i : i + block], counts))
        fits = F.filter(candidates, lambda r: F.regexp_like(place, r.getField("pattern")))
        ranked = F.transform(
            fits,
            lambda r: F.struct(
                r.getField("priority").alias("priority"), F.char_length(r.getField("name")).alias("length"),
                r.getField("name").alias("name"), r.getField("verdict").alias("verdict"),
            ),
        )
        top = F.array_max(ranked)
        best = F.array_max(F.array(best, top)) if i else top
    out = out.withColumn("__pl_best", best)
    return out.withColumns(
        {"rule": F.col("__pl_best.name"), "verdict": F.coalesce(F.col("__pl_best.verdict"), F.lit(default))}
    ).drop("__pl_best")

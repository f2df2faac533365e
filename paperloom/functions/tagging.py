"""Passage tags and filters as column functions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom import vocab as v
from paperloom.functions.text import any_of, ci, has_any, strip

NUMBER_PATTERN = "(?:" + "|".join(v.NUMBER_UNITS) + ")"


def has_numerical_data(c: Column) -> Column:
    return c.rlike(ci(NUMBER_PATTERN))


def has_methods(c: Column) -> Column:
    return has_any(c, v.METHOD_STEMS)


def has_comparisons(c: Column) -> Column:
    return has_any(c, v.COMPARISON_STEMS)


def find_all(c: Column, patterns: list[str], group: int = 0) -> Column:
    """Matches of every pattern, one pattern after the other."""
    return F.concat(*[F.regexp_extract_all(c, F.lit(ci(p)), F.lit(group)) for p in patterns])


def numerical_values(c: Column, limit: int = v.MAX_NUMBERS) -> Column:
    """Numbers with units, each once, in pattern order then text order."""
    return F.slice(F.array_distinct(find_all(c, v.NUMBER_UNITS)), 1, limit)


def key_metrics(c: Column) -> Column:
    names = [
        F.when(c.rlike(ci(v.WORD_START + pattern + v.WORD_END)), F.lit(name)) for name, pattern in v.METRIC_PATTERNS
    ]
    return F.filter(F.array(*names), lambda x: x.isNotNull())


def technical_terms(c: Column, limit: int = v.MAX_TERMS) -> Column:
    """Material names in sorted order.

    The formula shape is tried at the start of every word, then the known material names as whole words.
    """
    shape = v.WORD_START + "(" + v.FORMULA_SHAPE + ")"
    word_ends = "(?=$|" + v.NOT_WORD + ")"
    found = F.concat(
        F.regexp_extract_all(c, F.lit(ci(shape)), F.lit(1)),
        *[F.regexp_extract_all(c, F.lit(ci(f"{v.WORD_START}({t}){word_ends}")), F.lit(1)) for t in v.MATERIAL_TERMS],
    )
    return F.slice(F.array_sort(F.array_distinct(F.filter(found, lambda t: F.length(t) > 2))), 1, limit)


def content_density(c: Column) -> Column:
    """How many kinds of measured numbers a passage holds per 1,000 characters, as a band."""
    kinds = sum((c.rlike(ci(p)).cast("int") for p in v.NUMBER_UNITS), F.lit(0))
    per_1000 = kinds / (F.length(c) / 1000)
    return (
        F.when(F.length(c) == 0, "low").when(per_1000 > 5, "high").when(per_1000 > 2, "medium").otherwise("low")
    )


def tag_columns(c: Column) -> dict[str, Column]:
    """All passage tags, to be added in one projection."""
    return {
        "has_numerical_data": has_numerical_data(c),
        "has_methods": has_methods(c),
        "has_comparisons": has_comparisons(c),
        "numerical_values": numerical_values(c),
        "key_metrics": key_metrics(c),
        "technical_terms": technical_terms(c),
        "content_density": content_density(c),
    }


def is_reference_content(c: Column, section_type: Column | None = None) -> Column:
    """Does a passage read like a bibliography?

    True for a references section; otherwise, from 50 characters on, when more than 30 % of the marks occur, when
    there are more than three bracketed citations or years, or when most of more than five lines look like entries.
    """
    low = strip(F.lower(c))
    marks = sum((low.rlike(ci(p)).cast("int") for p in v.REFERENCE_MARKS), F.lit(0))
    citations = F.regexp_count(c, F.lit(v.CITATION))
    lines = F.split(c, "\n", -1)
    entry = F.filter(
        F.transform(lines, strip),
        lambda x: (F.length(x) > 10)
        & (
            x.rlike(v.REFERENCE_LINE[0])
            | x.rlike(v.REFERENCE_LINE[1])
            | (x.rlike(v.REFERENCE_LINE_YEAR) & x.rlike(v.REFERENCE_LINE_NAME))
        ),
    )
    by_text = (F.length(low) >= 50) & (
        (marks / len(v.REFERENCE_MARKS) > 0.3)
        | (citations > 3)
        | ((F.size(lines) > 5) & (F.size(entry) / F.size(lines) > 0.5))
    )
    if section_type is None:
        return by_text
    return (F.coalesce(section_type, F.lit("")) == "references") | by_text


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row, however often ``use`` names it: a lambda variable holds it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words_found(c: Column, words: list[str]) -> Column:
    known = F.array(*[F.lit(w) for w in words])
    return once(F.lower(c), lambda low: F.filter(known, lambda w: low.contains(w)))


def names_any(low: Column, words: list[str]) -> Column:
    """``has_any`` for a text that is in lower case already: the words are sought as they stand, without a pattern."""
    return reduce(Column.__or__, [low.contains(w) for w in words])


def metric_values(c: Column) -> Column:
    """Numbers standing before one of the metric units, unit by unit; case matters here."""
    return F.concat(
        *[
            F.regexp_extract_all(c, F.lit(rf"([0-9]+\.?[0-9]*)\s*{any_of([u])}"), F.lit(1))
            for u in v.METRIC_VALUE_UNITS
        ]
    )


def extraction_hints(entity_types: Column) -> Column:
    """Relation families to look for, given the entity types found in a passage."""

    def families(types: Column) -> Column:
        def both(a: str, b: str) -> Column:
            return F.array_contains(types, a) & F.array_contains(types, b)

        return F.array(
            F.when(both("ML_Algorithm", "Metric"), "PREDICTS"),
            F.when(both("Material", "Metric"), "HAS_PROPERTY"),
            F.when(both("Process", "Metric"), "INFLUENCES"),
        )

    return F.filter(once(entity_types, families), lambda x: x.isNotNull())


def content_types(c: Column) -> Column:
    """The entity types that a passage's words point to; the text is lower-cased once."""
    def types(low: Column) -> Column:
        return F.array(
            F.when(names_any(low, v.ML_KEYWORDS), "ML_Algorithm"),
            F.when(names_any(low, v.PERFORMANCE_KEYWORDS), "Metric"),
            F.when(names_any(low, v.HINT_MATERIALS), "Material"),
            F.when(names_any(low, v.NAME_KEYWORDS["Process"]), "Process"),
        )

    return F.filter(once(F.lower(c), types), lambda x: x.isNotNull())


def content_hints(c: Column, shown: int | None = None) -> Column:
    """What a prompt may point out in a passage: the ML methods and metrics it names, and how many values of metrics it holds.

    NULL where it names neither; ``shown`` limits the words per line.
    """
    def named(words: Column, kind: str) -> Column:
        some = words if shown is None else F.slice(words, 1, shown)
        return F.when(F.size(words) > 0, F.concat(F.lit(f"{kind}: "), F.array_join(some, ", ")))

    def lines(found: Column) -> Column:
        ml, metrics, values = found["ml"], found["metrics"], found["values"]
        count = F.when(values > 0, F.concat(F.lit("values: "), values.cast("string")))
        text = F.concat_ws("\n", named(ml, "methods"), named(metrics, "metrics"), count)
        return F.when((F.size(ml) > 0) | (F.size(metrics) > 0), text)

    found = F.struct(
        words_found(c, v.ML_KEYWORDS).alias("ml"), words_found(c, v.PERFORMANCE_KEYWORDS).alias("metrics"),
        F.size(metric_values(c)).alias("values"),
    )
    return once(found, lines)

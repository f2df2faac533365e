"""Entity names: normal forms, canonical keys, identifiers and types."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom import vocab as v
from paperloom.functions.text import any_of, literal_map, strip, strip_latex


def squash(c: Column) -> Column:
    """Lower case without blanks, hyphens and underscores."""
    return F.translate(F.lower(c), "-_ ", "")


def variant_table() -> list[tuple[str, str]]:
    """(spelling key, preferred full name); the first dictionary entry that knows a spelling owns it."""
    table: dict[str, str] = {}
    for short, names in v.ABBREVIATIONS.items():
        for spelling in [short] + [n.lower().replace("-", "").replace("_", "").replace(" ", "") for n in names]:
            table.setdefault(spelling, names[0])
    return list(table.items())


def normalize_name(c: Column) -> Column:
    """Strip LaTeX; a known abbreviation or spelling becomes the preferred full name, all else stays as written.

    The dictionary has a fixed size, so it travels inside the expression and costs no join.
    """
    plain = strip(c)
    latex = reduce(or_, [plain.contains(sign) for sign in "$\\{}^"])
    clean = F.when(latex, strip_latex(plain)).otherwise(plain)
    return F.coalesce(F.try_element_at(literal_map(variant_table()), squash(clean)), clean)


def canonical_name(c: Column) -> Column:
    low = F.lower(normalize_name(c))
    # most names are ASCII words with single signs between them, where one anchored match replaces a search at every place
    simple = low.rlike(r"\A[a-z0-9]++(?:[-_ .:/][a-z0-9]++)*+\z")
    signs = low
    for sign in "- .:/":
        signs = F.replace(signs, F.lit(sign), F.lit("_"))
    # underscores count as signs to be replaced, so that runs of both become one in a single pass
    return F.when(simple, signs).otherwise(F.btrim(F.regexp_replace(low, r"[^\p{L}\p{N}]+", "_"), F.lit("_")))


def entity_id(name: Column, entity_type: Column) -> Column:
    return F.concat(
        entity_type, F.lit("_"), F.substring(F.md5(F.concat(canonical_name(name), F.lit("_"), entity_type)), 1, 12)
    )


def edge_id(source: Column, target: Column, edge_type: Column, suffix: Column) -> Column:
    raw = F.concat(source, F.lit("|"), target, F.lit("|"), edge_type, F.lit("|"), suffix)
    return F.concat(edge_type, F.lit("_"), F.substring(F.md5(raw), 1, 12))


def same_entity(name1: Column, name2: Column, type1: Column | None = None, type2: Column | None = None) -> Column:
    """Equal normal forms; spellings of one dictionary entry share a normal form.  Two given types must agree."""
    equal = F.lower(normalize_name(name1)) == F.lower(normalize_name(name2))
    if type1 is None or type2 is None:
        return equal
    types_agree = type1.isNull() | type2.isNull() | (type1 == "") | (type2 == "") | (type1 == type2)
    return types_agree & equal


def name_score(c: Column) -> Column:
    """Length, ten more for every blank, five more for a capital first letter."""
    first = F.left(c, F.lit(1))
    capital = (first == F.upper(first)) & (first != F.lower(first))
    return F.length(c) + F.regexp_count(c, F.lit(" ")) * 10 + F.when(capital, 5).otherwise(0)


def type_from_label(c: Column) -> Column:
    label = strip(F.upper(c))
    return F.coalesce(F.try_element_at(literal_map(v.ENTITY_TYPE_LABELS.items()), label), F.lit("Concept"))


def type_from_name(label: Column, name: Column) -> Column:
    """A known short label decides; otherwise the first keyword family found in the name, then a formula test."""
    up, low = F.upper(label), F.lower(name)
    short = {s: t for t, labels in v.SHORT_TYPE_LABELS.items() for s in labels}
    by_name = F.lit(None).cast("string")
    for entity_type in reversed(list(v.NAME_KEYWORDS)):
        by_name = F.when(low.rlike(any_of(v.NAME_KEYWORDS[entity_type])), entity_type).otherwise(by_name)
    formula = name.rlike(any_of(v.FORMULA_OPENERS)) & name.rlike(any_of(v.FORMULA_MARKS))
    return F.coalesce(
        F.try_element_at(literal_map(short.items()), up), by_name, F.when(formula, "Formula"), F.lit("Concept")
    )


def relation_type(c: Column) -> Column:
    up = F.upper(F.coalesce(c, F.lit("RELATED_TO")))
    return F.when(up.isin(v.RELATION_TYPES), up).otherwise("RELATED_TO")

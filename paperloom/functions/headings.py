"""Sections of a document as an array column.

All heading families form one pattern that is matched once over the text, so a document is cut where it lies:
nothing is exploded into lines and no window has to put them back in order.  A match wins by position, then by
family order, then by pattern order, and scanning goes on after its end.

Reference-compatible choices: a heading is a prefix test on *any* line, so a sentence that starts with "Analysis"
opens a discussion section and a numbered list line opens a references section.  ``strict_headings`` asks for a line
that ends with the heading words.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom import vocab as v
from paperloom.functions.text import CLOSE, OPEN, strip

FAMILIES = list(v.SECTION_HEADINGS)
STRICT_TAIL = r"[ \t]*:?[ \t]*$"


def heading_alternation(strict: bool = False) -> str:
    tail = STRICT_TAIL if strict else ""
    return "^(?:" + "|".join(v.heading_pattern(f) for f in FAMILIES) + ")" + tail


def family_of(title: Column) -> Column:
    out = F.lit("default")
    for family in reversed(FAMILIES):
        out = F.when(title.rlike("(?iud)^" + v.heading_pattern(family)), family).otherwise(out)
    return out


def marked_pieces(c: Column, strict_headings: bool = False) -> Column:
    """The text cut before every heading; each heading is followed by a marker."""
    return F.split(F.regexp_replace(c, "(?iumd)" + heading_alternation(strict_headings), f"{OPEN}$0{CLOSE}"), OPEN, -1)


def sections(c: Column, pieces: Column) -> Column:
    """``array<struct<text, section_type, title>>`` in document order, from the text and its marked pieces.

    Text before the first heading and every section shorter than 50 characters is left out; a document without
    headings is one section.  ``pieces`` must be a stored column: it is used several times and costs a pass over the
    text.
    """

    def entry(text: Column, kind: Column, title: Column) -> Column:
        return F.struct(text.alias("text"), kind.alias("section_type"), title.alias("title"))

    def head_and_body(p: Column) -> Column:
        return F.struct(
            F.substring_index(p, CLOSE, 1).alias("title"), strip(F.replace(p, F.lit(CLOSE), F.lit(""))).alias("text")
        )

    whole = F.array(entry(c, F.lit("default"), F.lit(v.WHOLE_TEXT_TITLE)))
    preamble = F.array(entry(strip(F.element_at(pieces, 1)), F.lit("default"), F.lit(v.PREAMBLE_TITLE)))
    cut = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), head_and_body)
    rest = F.transform(cut, lambda s: entry(s["text"], family_of(s["title"]), strip(s["title"])))
    found = F.filter(F.concat(preamble, rest), lambda s: F.length(s["text"]) >= v.SECTION_MIN_CHARS)
    return F.when(F.size(pieces) == 1, whole).otherwise(found)

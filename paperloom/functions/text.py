"""Column functions that clean and measure text.  All of them stay in the JVM and look at one row only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom import vocab as v

# noncharacters that mark spans between two rewrites; they cannot occur in interchanged text
OPEN, CLOSE = "\ufdd0", "\ufdd1"


def strip(c: Column) -> Column:
    """Trim every kind of Unicode white space, not just blanks."""
    return F.btrim(c, F.lit(v.STRIP_CHARS))


def literal_map(pairs) -> Column:
    """A constant map, parsed from one expression instead of one call per entry."""

    def show(x) -> str:
        return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(x, str) else str(x)

    return F.expr("map(" + ", ".join(f"{show(k)}, {show(x)}" for k, x in pairs) + ")")


def ci(pattern: str) -> str:
    """Ignore case in every script and let only a line feed end a line."""
    return "(?iud)" + pattern


def any_of(words: list[str]) -> str:
    """An alternation of literal words."""
    special = set("\\.[]{}()*+-?^$|&~#")
    return "|".join("".join("\\" + ch if ch in special else ch for ch in w) for w in words)


def has_any(c: Column, words: list[str]) -> Column:
    """True when the lower-cased text contains one of the words as a substring."""
    return F.lower(c).rlike(any_of(words))


def count_words_present(c: Column, words: list[str]) -> Column:
    low = F.lower(c)
    return sum((low.contains(w).cast("int") for w in words), F.lit(0))


def rewrite_spans(c: Column, pattern: str, group: int, inner: Callable[[Column], Column], left: str, right: str) -> Column:
    """Rewrite only the parts of a text that match ``pattern``, scanning once from left to right.

    The matches are bracketed by marker characters, the text is cut at the markers and the bracketed parts are
    rewritten where they stand, so no row is exploded and nothing is shuffled.
    """
    pieces = F.split(F.regexp_replace(c, pattern, f"{OPEN}${group}{CLOSE}"), OPEN, -1)
    rest = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))
    rewritten = F.transform(
        rest,
        lambda p: F.concat(
            F.lit(left),
            inner(F.substring_index(p, CLOSE, 1)),
            F.lit(right),
            F.substring_index(p, CLOSE, -1),
        ),
    )
    return F.concat(F.element_at(pieces, 1), F.array_join(rewritten, ""))


def repair_formula_numbers(c: Column) -> Column:
    """Close up spaced digits inside ``$…$``: digits, decimal points, percent signs and ranges.

    Each rule is one left-to-right pass whose matches do not overlap, so ``1 9 2`` becomes ``19 2``.
    """

    def inner(x: Column) -> Column:
        x = F.regexp_replace(x, r"([0-9])\s+([0-9])", "$1$2")
        x = F.regexp_replace(x, r"([0-9])\s+(\.)", "$1$2")
        x = F.regexp_replace(x, r"(\.)\s+([0-9])", "$1$2")
        x = F.regexp_replace(x, r"([0-9])\s+(\\%)", "$1$2")
        return F.regexp_replace(x, r"([0-9])\s+(-)\s+([0-9])", "$1$2$3")

    return F.when(c.contains("$"), rewrite_spans(c, r"\$([^$]+)\$", 1, inner, "$", "$")).otherwise(c)


def close_formula_percent(c: Column) -> Column:
    """Drop the blanks inside ``$ 1 5 . 2 \\%``."""
    pattern = r"(\$\s*[0-9\s.]+\s*\\?%\s*)"
    return F.when(
        c.contains("$"), rewrite_spans(c, pattern, 1, lambda x: F.replace(x, F.lit(" "), F.lit("")), "", "")
    ).otherwise(c)


def clean_document_text(c: Column) -> Column:
    """Strip, unify line ends, repair formula numbers, strip every line, keep at most one blank line in a row."""
    c = F.regexp_replace(strip(c), r"\r\n?", "\n")
    c = repair_formula_numbers(c)
    c = F.regexp_replace(c, rf"[{v.LINE_SPACE}]*\n[{v.LINE_SPACE}]*", "\n")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def clean_markdown(c: Column, max_chars: int | None = None) -> Column:
    """Collapse blank runs, turn images into ``[Figure: alt]`` and drop comments; no length cap unless asked for."""
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    c = F.regexp_replace(c, r"!\[([^\]]*)\]\([^)]+\)", "[Figure: $1]")
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", "")
    if max_chars is not None:
        c = F.left(c, F.lit(max_chars))
    return strip(c)


def markdown_title(c: Column, max_lines: int | None = None) -> Column:
    """Text of the first ``# `` line; with ``max_lines``, of one among the first lines."""
    lines = F.split(c, "\n", -1) if max_lines is None else F.slice(F.split(c, "\n", max_lines + 1), 1, max_lines)
    lines = F.transform(lines, strip)
    hit = F.filter(lines, lambda x: x.startswith("# "))
    return F.coalesce(strip(F.substr(F.get(hit, F.lit(0)), F.lit(3))), F.lit("Unknown Title"))


def paper_id(c: Column, max_chars: int = 100) -> Column:
    """An identifier of at most ``max_chars`` characters; a longer one is cut and ends in a hash of the whole text."""
    whole = F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N}_\s-]", ""), r"\s+", "_")
    cut = F.concat(F.left(whole, F.lit(max_chars - 9)), F.lit("_"), F.substring(F.md5(c), 1, 8))
    return F.when(F.length(whole) > max_chars, cut).otherwise(whole)


def content_hash(c: Column, length: int = 32) -> Column:
    return F.substring(F.md5(c), 1, length)


def estimate_tokens(c: Column) -> Column:
    return F.floor(F.length(c) / 4).cast("int")


def strip_latex(c: Column) -> Column:
    """Plain text of a name written with inline LaTeX."""
    c = F.replace(c, F.lit("$"), F.lit(""))
    c = F.regexp_replace(c, r"\\mathrm\{([^}]+)\}", "$1")
    c = F.regexp_replace(c, r"\\text\{([^}]+)\}", "$1")
    c = F.regexp_replace(c, r"_\{([^}]+)\}", "_$1")
    c = F.regexp_replace(c, r"\^\{([^}]+)\}", "^$1")
    return strip(F.replace(c, F.lit("\\"), F.lit("")))


# fixed values: the named entities that occur in search results, "&amp;" last
HTML_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&nbsp;", "\u00a0"),
                 ("&amp;", "&")]


def unescape_html(c: Column) -> Column:
    for name, char in HTML_ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def strip_tags(c: Column) -> Column:
    c = F.regexp_replace(c, r"<[^>]+>", " ")
    return strip(F.regexp_replace(c, r"\s+", " "))


def html_links(html: Column, css_class: str | None = None) -> Column:
    """Anchors of a result page as ``array<struct<href, title>>``, optionally only those of one class."""
    cls = rf'[^>]*class="[^"]*{css_class}[^"]*"' if css_class else ""
    pattern = rf'(?is)<a{cls}[^>]*href="([^"]+)"[^>]*>(.*?)</a>'
    hrefs = F.regexp_extract_all(html, F.lit(pattern), F.lit(1))
    titles = F.regexp_extract_all(html, F.lit(pattern), F.lit(2))
    return F.zip_with(
        hrefs,
        titles,
        lambda h, t: F.struct(
            redirect_target(unescape_html(h)).alias("href"), strip_tags(unescape_html(t)).alias("title")
        ),
    )


def html_snippets(html: Column, css_class: str) -> Column:
    """Summaries of a result page, in page order."""
    pattern = rf'(?is)<(?:a|div)[^>]*class="[^"]*{css_class}[^"]*"[^>]*>(.*?)</(?:a|div)>'
    return F.transform(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), lambda s: strip_tags(unescape_html(s)))


def result_records(html: Column, link_class: str, snippet_class: str) -> Column:
    """The results of a page as ``array<struct<title, url, abstract>>``: the n-th link of a class with the n-th snippet of another.

    A link without a snippet has an empty abstract; results without title and abstract fall out.
    """
    links, snippets = html_links(html, link_class), html_snippets(html, snippet_class)
    records = F.transform(
        links, lambda x, i: F.struct(x["title"].alias("title"), x["href"].alias("url"), F.coalesce(F.get(snippets, i), F.lit("")).alias("abstract"))
    )
    return F.filter(records, lambda r: (r["title"] != "") | (r["abstract"] != ""))


def redirect_target(href: Column) -> Column:
    """Follow a search redirect that carries its target in the ``uddg`` parameter; other links stay as they are."""
    raw = F.regexp_extract(href, r"[?&]uddg=([^&#]+)", 1)
    return F.when(raw != "", F.coalesce(F.try_url_decode(raw), raw)).otherwise(href)


def strip_answer_footer(c: Column) -> Column:
    """Remove the citation lines that an answer ends with."""
    c = F.regexp_replace(c, r"(?iu)\n*\[Sources:.*?\]", "")
    return strip(F.regexp_replace(c, r"(?iu)\n*\[No sources\]", ""))


def category_slug(c: Column) -> Column:
    """File name of a category."""
    return F.replace(F.replace(F.lower(c), F.lit(" & "), F.lit("_")), F.lit(" "), F.lit("_"))


def number_or_null(c: Column) -> Column:
    """Finite doubles only: NaN and infinities become NULL."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None)).otherwise(c).cast("double")


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def float_or_null(c: Column) -> Column:
    return blank_to_null(c).try_cast("double")


def split_reference(c: Column) -> Column:
    """``struct<document_title, location, excerpt>`` of ``Title: Location, Excerpt: "…"``."""
    head = F.substring_index(c, ", Excerpt:", 1)
    at = F.instr(head, ": ")
    return F.struct(
        strip(F.when(at > 0, F.substring_index(head, ": ", 1)).otherwise(head)).alias("document_title"),
        strip(F.when(at > 0, F.substr(head, at + 2)).otherwise(F.lit(""))).alias("location"),
        strip(F.regexp_extract(c, v.EXCERPT, 1)).alias("excerpt"),
    )

"""Cleaning and scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import names
from paperloom.functions import text as tx
from paperloom.plans import inputs
from paperloom.plans.registry import query
from paperloom.plans.source_queries import cleaned_sql, repaired_sql
from paperloom.plans.sqlkit import CLOSE, OPEN, s, strip, sub, with_inputs
from paperloom.sources.readers import spread, table


def _md5(name):
    return F.md5(name)


@query("b1_clean_document_text", with_inputs(f"SELECT doc_id, md5({cleaned_sql('text')}) AS clean_md5 FROM papers"))
def _(spark, sf):
    return inputs.papers(spark, sf).select("doc_id", F.md5(tx.clean_document_text(F.col("text"))).alias("clean_md5"))


@query("b2_repair_formula_numbers", with_inputs(f"SELECT doc_id, md5({repaired_sql('text')}) AS repaired_md5 FROM papers"))
def _(spark, sf):
    return inputs.papers(spark, sf).select("doc_id", F.md5(tx.repair_formula_numbers(F.col("text"))).alias("repaired_md5"))


def _closed_sql(x: str) -> str:
    pieces = f"string_split({sub(x, r'(\$\s*[0-9\s.]+\s*\\?%\s*)', OPEN + chr(92) + '1' + CLOSE)}, {s(OPEN)})"
    return (
        f"array_to_string(list_transform({pieces}, lambda e, i: CASE WHEN i = 1 THEN e ELSE concat(replace(split_part(e, {s(CLOSE)}, 1), ' ', ''), "
        f"split_part(e, {s(CLOSE)}, 2)) END), '')"
    )


@query("b3_close_formula_percent", with_inputs(f"SELECT doc_id, md5({_closed_sql('text')}) AS closed_md5 FROM papers"))
def _(spark, sf):
    return inputs.papers(spark, sf).select("doc_id", F.md5(tx.close_formula_percent(F.col("text"))).alias("closed_md5"))


def latex_sql(x: str) -> str:
    c = f"replace({x}, '$', '')"
    for pattern, new in ((r"\\mathrm\{([^}]+)\}", r"\1"), (r"\\text\{([^}]+)\}", r"\1"), (r"_\{([^}]+)\}", r"_\1"), (r"\^\{([^}]+)\}", r"^\1")):
        c = sub(c, pattern, new)
    return strip(f"replace({c}, '\\', '')")


_LATEX = "CASE p_partkey % 3 WHEN 0 THEN '$\\mathrm{' || p_name || '}_{2}$' WHEN 1 THEN '\\text{' || p_brand || '} ' || p_name || '^{' || p_size || '} ' ELSE p_name || '\\_x' END"


@query("b4_strip_latex", f"SELECT p_partkey, {latex_sql(_LATEX)} AS plain FROM part")
def _(spark, sf):
    k = F.col("p_partkey") % 3
    raw = (
        F.when(k == 0, F.concat(F.lit("$\\mathrm{"), F.col("p_name"), F.lit("}_{2}$")))
        .when(k == 1, F.concat(F.lit("\\text{"), F.col("p_brand"), F.lit("} "), F.col("p_name"), F.lit("^{"), F.col("p_size").cast("string"), F.lit("} ")))
        .otherwise(F.concat(F.col("p_name"), F.lit("\\_x")))
    )
    return table(spark, sf, "part").select("p_partkey", tx.strip_latex(raw).alias("plain"))


def _markdown_sql(x: str) -> str:
    c = sub(x, r"\n{3,}", "\n\n")
    c = sub(c, r"!\[([^\]]*)\]\([^)]+\)", r"[Figure: \1]")
    return strip(sub(c, r"(?s)<!--.*?-->", ""))


@query("b7_clean_markdown", f"SELECT page_id, md5({_markdown_sql("'![Plot](' || url || ')' || chr(10) || chr(10) || chr(10) || html")}) AS clean_md5 FROM pages")
def _(spark, sf):
    raw = F.concat(F.lit("![Plot]("), F.col("url"), F.lit(")\n\n\n"), F.col("html"))
    return table(spark, sf, "pages").select("page_id", F.md5(tx.clean_markdown(raw)).alias("clean_md5"))


@query(
    "b8_markdown_title",
    with_inputs(
        f"""SELECT doc_id, coalesce({strip("substr(list_filter(l, lambda x: starts_with(x, '# '))[1], 3)")}, 'Unknown Title') AS title
        FROM (SELECT doc_id, list_transform(string_split(text, chr(10))[1:20], lambda x: {strip('x')}) AS l FROM papers)"""
    ),
)
def _(spark, sf):
    return inputs.papers(spark, sf).select("doc_id", tx.markdown_title(F.col("text")).alias("title"))


@query("b9_paper_id", rf"SELECT page_id, CASE WHEN length(w) > 30 THEN left(w, 21) || '_' || substr(md5(url), 1, 8) ELSE w END AS paper_id FROM (SELECT page_id, url, regexp_replace(regexp_replace(url, '[^\p{{L}}\p{{N}}_\s-]', '', 'g'), '\s+', '_', 'g') AS w FROM pages)")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.paper_id(F.col("url"), 30).alias("paper_id"))


@query("b10_content_hash", "SELECT doc_id, md5(text) AS full_hash, substr(md5(text), 1, 8) AS short_hash FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.content_hash(F.col("text")).alias("full_hash"), tx.content_hash(F.col("text"), 8).alias("short_hash"))


@query("b12_estimate_tokens", "SELECT doc_id, length(text) // 4 AS tokens FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.estimate_tokens(F.col("text")).alias("tokens"))


def _unescape_sql(x: str) -> str:
    for name, char in tx.HTML_ENTITIES:
        x = f"replace({x}, {s(name)}, {s(char)})"
    return x


def _untag_sql(x: str) -> str:
    return strip(sub(sub(x, r"<[^>]+>", " "), r"\s+", " "))


@query("b13_strip_html", f"SELECT page_id, md5({_untag_sql(_unescape_sql('html'))}) AS text_md5 FROM pages")
def _(spark, sf):
    return spread(table(spark, sf, "pages")).select("page_id", F.md5(tx.strip_tags(tx.unescape_html(F.col("html")))).alias("text_md5"))


_ANCHOR = r'(?is)<a[^>]*href="([^"]+)"[^>]*>(.*?)</a>'


@query(
    "b13_result_links",
    f"""SELECT page_id, no - 1 AS pos, {_unescape_sql('h')} AS href, {_untag_sql(_unescape_sql('t'))} AS title FROM (
    SELECT page_id, unnest(regexp_extract_all(html, {s(_ANCHOR)}, 1)) AS h, unnest(regexp_extract_all(html, {s(_ANCHOR)}, 2)) AS t,
    unnest(range(1, len(regexp_extract_all(html, {s(_ANCHOR)}, 1)) + 1)) AS no FROM pages)""",
)
def _(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.posexplode(tx.html_links(F.col("html"))).alias("pos", "l"))
    return p.select("page_id", "pos", "l.href", "l.title")


@query(
    "b13_result_records",
    """SELECT page_id, pos, title, CASE pos WHEN 0 THEN url ELSE 'https://example.org/' || page_id END AS url, CASE pos WHEN 0 THEN 'about ' || page_id || ' & more' ELSE '' END AS abstract FROM
    (SELECT page_id, url, unnest([0, 1]) AS pos, unnest(['Page ' || page_id, 'second']) AS title FROM pages)""",
)
def _(spark, sf):
    """A result page per row: a redirected link with a snippet, a plain link without, one without any text, and one of another class."""
    i = F.col("page_id").cast("string")
    html = F.concat(
        F.lit('<a rel="x" class="result__a big" href="//search.example/l/?uddg='), F.url_encode("url"), F.lit('&amp;rut=1">Page <b>'), i,
        F.lit('</b></a><a class="result__snippet">about <i>'), i, F.lit('</i> &amp; more</a><a class="result__a" href="https://example.org/'), i,
        F.lit('">second</a><a class="other" href="/x">third</a><a class="result__a" href="/y"> <b></b></a>'),
    )
    p = table(spark, sf, "pages").select("page_id", F.posexplode(tx.result_records(html, "result__a", "result__snippet")).alias("pos", "r"))
    return p.select("page_id", "pos", "r.title", "r.url", "r.abstract")


@query("b13_redirect_target", "SELECT page_id, url AS target FROM pages")
def _(spark, sf):
    wrapped = F.concat(F.lit("//search.example/l/?uddg="), F.url_encode("url"), F.lit("&rut=1"))
    return table(spark, sf, "pages").select("page_id", tx.redirect_target(wrapped).alias("target"))


@query("b14_strip_answer_footer", f"SELECT conv_id, turn, md5({strip('text')}) AS clean_md5 FROM conversations")
def _(spark, sf):
    c = F.col("text")
    noisy = F.when(F.col("turn") % 3 == 0, F.concat(c, F.lit("\n\n[Sources: 5 vector docs + 3 KG entities]"))).when(
        F.col("turn") % 3 == 1, F.concat(c, F.lit("\n[no sources]"))
    ).otherwise(c)
    return table(spark, sf, "conversations").select("conv_id", "turn", F.md5(tx.strip_answer_footer(noisy)).alias("clean_md5"))

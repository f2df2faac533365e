"""From documents to sections to passages, without a shuffle: every document is cut inside its own row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom import vocab as v
from paperloom.functions.headings import marked_pieces, sections
from paperloom.functions.tagging import tag_columns
from paperloom.functions.text import literal_map, strip


def _config(section_type: Column, index: int) -> Column:
    table = literal_map((row[0], row[index]) for row in v.SECTION_CONFIG)
    default = next(row[index] for row in v.SECTION_CONFIG if row[0] == "default")
    return F.coalesce(F.try_element_at(table, section_type), F.lit(default))


def explode_once(df: DataFrame, kept: list, array: str, pos: str, item: str) -> DataFrame:
    """One row per array item.

    A plain explode makes the optimizer test the array's size below the projection that computes it, which would
    compute a costly array twice; the outer form followed by a filter does not.
    """
    return df.select(*kept, F.posexplode_outer(array).alias(pos, item)).filter(F.col(pos).isNotNull())


def _with_sections(df: DataFrame, text: str, strict_headings: bool) -> DataFrame:
    """Add ``_s``.  The pieces are a column of their own, so the headings are searched once per document."""
    cut = df.withColumn("_pieces", marked_pieces(F.col(text), strict_headings))
    return cut.withColumn("_s", sections(F.col(text), F.col("_pieces"))).drop("_pieces")


def section_rows(df: DataFrame, text: str = "text", strict_headings: bool = False) -> DataFrame:
    """One row per section with its position, type, title and text (references included)."""
    kept = [c for c in df.columns if c != text]
    return explode_once(_with_sections(df, text, strict_headings), kept, "_s", "section_no", "s").select(
        *kept, "section_no", F.col("s.section_type"), F.col("s.title").alias("section_title"), F.col("s.text").alias("text")
    )


def windows(text: Column, size: Column, overlap: Column) -> Column:
    """``array<struct<start, end>>``: the whole text if it fits, else windows a step of size − overlap apart.

    A last window that the previous overlap already covers is still emitted.
    """
    n = F.length(text)
    step = F.greatest(size - overlap, F.lit(1))
    return F.when(
        n <= size, F.array(F.struct(F.lit(0).alias("start"), n.alias("end")))
    ).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), step),
            lambda s: F.struct(s.alias("start"), F.least(s + size, n).alias("end")),
        )
    )


def passages(df: DataFrame, text: str = "text", strict_headings: bool = False) -> DataFrame:
    """One row per passage with its section, position and sizes; references sections are left out.

    ``global_chunk_id`` and ``total_chunks`` count within the document.  Both come from the nested array, so neither
    needs a window over the corpus.  Positions are relative to the section.
    """
    kept = [c for c in df.columns if c != text]

    def measure(s: Column) -> Column:
        size, overlap = _config(s["section_type"], 2), _config(s["section_type"], 3)
        whole = F.length(s["text"]) <= size
        spans = F.transform(
            windows(s["text"], size, overlap),
            lambda w: F.struct(
                strip(F.substr(s["text"], w["start"] + 1, w["end"] - w["start"])).alias("content"),
                w["start"].alias("start"),
                w["end"].alias("end"),
            ),
        )
        return F.struct(
            s["section_type"].alias("section_type"),
            s["title"].alias("title"),
            F.length(s["text"]).alias("chars"),
            whole.alias("whole"),
            F.filter(spans, lambda w: whole | (F.length(w["content"]) > 0)).alias("spans"),
        )

    def cut(s: Column) -> Column:
        chars = lambda w: F.when(s["whole"], s["chars"]).otherwise(F.length(w["content"]))
        return F.transform(
            s["spans"],
            lambda w, i: F.struct(
                w["content"].alias("content"),
                s["section_type"].alias("section_type"),
                s["title"].alias("section_title"),
                i.alias("section_chunk_id"),
                F.size(s["spans"]).alias("section_chunks_count"),
                chars(w).alias("chunk_size"),
                F.floor(chars(w) / 4).cast("int").alias("token_count"),
                s["whole"].alias("is_complete_section"),
                w["start"].alias("chunk_start_pos"),
                w["end"].alias("chunk_end_pos"),
            ),
        )

    # lambda variables hold evaluated values: sections, then spans, then passages, each computed once
    in_scope = F.filter(F.col("_s"), lambda s: s["section_type"] != "references")
    cut_docs = _with_sections(df, text, strict_headings).select(
        *kept, F.flatten(F.transform(F.transform(in_scope, measure), cut)).alias("_p")
    )
    rows = explode_once(cut_docs, kept + [F.size("_p").alias("total_chunks")], "_p", "global_chunk_id", "p")
    st = F.col("p.section_type")
    return rows.select(
        *kept,
        "global_chunk_id",
        "total_chunks",
        F.col("p.content").alias("content"),
        st.alias("section_type"),
        F.col("p.section_title"),
        _config(st, 4).alias("section_name"),
        _config(st, 1).alias("section_priority"),
        *[
            F.col(f"p.{c}")
            for c in (
                "section_chunk_id", "section_chunks_count", "chunk_size", "token_count", "is_complete_section",
                "chunk_start_pos", "chunk_end_pos",
            )
        ],
        _config(st, 2).alias("configured_chunk_size"),
        _config(st, 3).alias("configured_overlap"),
    )


def tagged_passages(df: DataFrame, text: str = "text") -> DataFrame:
    """Passages with all content tags."""
    return passages(df, text).withColumns(tag_columns(F.col("content")))


def skipped_references(sections_df: DataFrame) -> DataFrame:
    """How many sections the references rule leaves out, next to the number that stay."""
    ref = F.col("section_type") == "references"
    return sections_df.agg(F.count_if(ref).alias("skipped"), F.count_if(~ref).alias("kept"))


def chunk_stats(p: DataFrame) -> DataFrame:
    """Totals and the section distribution in one pass; the row without a section type is the total."""
    return (
        p.rollup("section_type")
        .agg(
            F.count("*").alias("chunks"),
            F.sum(F.length("content")).alias("characters"),
            F.bround(F.avg(F.length("content")), 6).alias("avg_chunk_size"),
            F.sum("token_count").alias("tokens"),
            F.bround(F.avg("token_count"), 6).alias("avg_tokens"),
            F.sum("chunk_size").alias("covered"),
            F.count_if("is_complete_section").alias("complete_sections"),
            F.max("configured_chunk_size").alias("configured_chunk_size"),
            F.max("configured_overlap").alias("configured_overlap"),
        )
    )


def section_summary(p: DataFrame) -> DataFrame:
    """Per section name: counts, sizes and configuration, by priority."""
    return (
        p.groupBy("section_name", "section_type", "section_priority")
        .agg(
            F.count("*").alias("chunks"),
            F.sum("chunk_size").alias("total_size"),
            F.sum("token_count").alias("total_tokens"),
            F.max("configured_chunk_size").alias("configured_chunk_size"),
            F.max("configured_overlap").alias("configured_overlap"),
        )
        .withColumn("mean_size", F.floor(F.col("total_size") / F.col("chunks")))
        .orderBy("section_priority", "section_name")
    )

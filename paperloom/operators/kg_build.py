"""From extracted facts or structured records to a merged graph.

A graph is kept as long tables: one row per vertex or edge with its scalar fields, and one row per (vertex, paper),
(vertex, description) and (vertex, property value).  A hub that a third of all records mention therefore never becomes
one huge row or one task's list: every table is built by plain aggregates that combine map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from paperloom import vocab as v
from paperloom.functions import names as nm
from paperloom.functions.tagging import is_reference_content
from paperloom.functions.text import any_of, strip
from paperloom.session import cut_lineage, one_row


# --- extraction requests and responses ---------------------------------------------------------------------------
def extraction_requests(
    passages: DataFrame, template: str, content: str = "content", section: str = "section_type", counts: Observation | None = None
) -> DataFrame:
    """Passages worth sending to a model, with the filled prompt (``{text}`` stands for the passage).

    ``counts`` takes, in the pass that reads the passages, their number and how many fell out as references or as too short.
    """
    text = F.col(content)
    reference, short = is_reference_content(text, F.col(section)), F.length(strip(text)) < v.MIN_EXTRACT_CHARS
    marked = passages.withColumns({"_reference": reference, "_short": short})
    if counts is not None:
        marked = marked.observe(
            counts, F.count(F.lit(1)).alias("passages"), F.count_if(F.col("_reference")).alias("reference_passages_filtered"),
            F.count_if(F.col("_short") & ~F.col("_reference")).alias("short_passages_filtered"),
        )
    return marked.filter(~F.col("_reference") & ~F.col("_short")).drop("_reference", "_short").withColumn("prompt", F.replace(F.lit(template), F.lit("{text}"), text))


def entity_prompt_line(name: Column, entity_type: Column, properties: Column, description: Column, description_chars: int | None = None) -> Column:
    """One line of an entity list; ``properties`` is an array of ``key: value`` strings.

    ``description_chars`` shortens descriptions where a prompt has to stay small.
    """
    shown = description if description_chars is None else F.left(description, F.lit(description_chars))
    has_description = F.coalesce(description, F.lit("")) != ""
    return F.concat(
        F.lit("- **"), name, F.lit("** ("), entity_type, F.lit(")"),
        F.when(F.size(properties) > 0, F.concat(F.lit(" ["), F.array_join(properties, ", "), F.lit("]"))).otherwise(""),
        F.when(has_description, F.concat(F.lit("\n  Description: "), shown)).otherwise(""),
    )


def response_json(c: Column) -> Column:
    """The JSON part of a model's answer: a fenced block, else the text if it starts like JSON, else NULL.

    Plain explanations that nothing was found give NULL too.
    """
    plain = F.lower(c).rlike(any_of(v.NO_ENTITY_PHRASES)) & ~(c.contains("{") & c.contains("}"))
    fenced = F.regexp_extract(c, r"(?s)```json\s*(.*?)\s*```", 1)
    bare = strip(c)
    return F.when(plain, None).when(c.rlike(r"(?s)```json.*```"), fenced).when(bare.rlike(r"^[\[{]"), bare)


# A string literal, even one that is never closed, or an escaped character outside of one.
_LITERAL = r'(?s)("[^"\\]*+(?:\\.[^"\\]*+)*+"?|\\.)'


def single_braces(c: Column) -> Column:
    """Halve doubled braces outside strings, if the text doubles its opening braces.

    Well-formed JSON never has ``{{`` outside a string, while ``}}`` simply closes two objects.
    """
    doubled = F.regexp_replace(c, _LITERAL, "").contains("{{")
    return F.when(c.contains("{{") & doubled, F.regexp_replace(c, _LITERAL + r"|(\{)\{|(\})\}", "$1$2$3")).otherwise(c)


def repair_json(c: Column) -> Column:
    """Make a model's JSON parseable: control characters, doubled braces, stray escapes and trailing commas.

    """
    c = F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    c = single_braces(c)
    # an odd run of three or more backslashes loses one, then a backslash before no escape letter is doubled
    c = F.regexp_replace(c, r"(?<!\\)\\((?:\\\\)+)(?!\\)", "$1")
    c = F.regexp_replace(c, r"(?<!\\)((?:\\\\)*)\\(?![\"\\/bfnrt]|u[0-9a-fA-F]{4})", "$1" + "\\" * 4)
    return strip(F.regexp_replace(c, r",\s*([}\]])", "$1"))


ENTITY_SCHEMA = (
    "entities array<struct<name string, type string, description string, properties map<string,string>, confidence double, "
    "source_traceability struct<text_snippet string, context string, figure_table_ref string, section_hint string>>>, "
    "relations array<struct<source_entity string, target_entity string, relation_type string, description string, "
    "properties map<string,string>, confidence double, source_traceability struct<text_snippet string, context string, "
    "figure_table_ref string, evidence_strength string>>>"
)


def parse_responses(df: DataFrame, response: str = "response") -> DataFrame:
    """Answers as structs: ``parsed`` is NULL for plain explanations and for text that stays unreadable."""
    read = F.from_json(repair_json(response_json(F.col(response))), ENTITY_SCHEMA)
    some = F.col("parsed.entities").isNotNull() | F.col("parsed.relations").isNotNull()
    return df.withColumn("parsed", read).withColumn("parsed", F.when(some, F.col("parsed")))


def _present(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def valid_entities(parsed: DataFrame, passage: str = "passage_id") -> DataFrame:
    """One row per acceptable entity: named, typed, traced to a snippet and confident enough.

    Its properties and the whole trace (snippet, context, figure or table, section) come along.
    """
    e = parsed.select(passage, F.posexplode_outer("parsed.entities").alias("pos", "e")).filter(F.col("pos").isNotNull())
    snippet = F.col("e.source_traceability.text_snippet")
    confidence = F.coalesce(F.col("e.confidence"), F.lit(v.DEFAULT_CONFIDENCE))
    has_properties = F.coalesce(F.cardinality("e.properties"), F.lit(0)) > 0
    ok = (
        F.col("e.name").isNotNull() & F.col("e.type").isNotNull() & _present(snippet)
        & ((F.col("e.type") != "ML_Algorithm") | has_properties) & (confidence >= v.MIN_ENTITY_CONFIDENCE)
    )
    name, kind = strip(F.col("e.name")), nm.type_from_label(F.col("e.type"))
    return e.filter(ok).select(
        passage, "pos", name.alias("name"), kind.alias("type"), nm.entity_id(name, kind).alias("entity_id"),
        F.col("e.description").alias("description"), F.col("e.properties").alias("properties"), snippet.alias("text_snippet"),
        *[F.col(f"e.source_traceability.{c}").alias(c) for c in ("context", "figure_table_ref", "section_hint")], confidence.alias("confidence"),
    )


def valid_relations(parsed: DataFrame, entities: DataFrame, passage: str = "passage_id") -> DataFrame:
    """One row per acceptable relation whose two ends were accepted as entities of the same passage."""
    r = parsed.select(passage, F.posexplode_outer("parsed.relations").alias("pos", "r")).filter(F.col("pos").isNotNull())
    trace = F.col("r.source_traceability")
    confidence = F.coalesce(F.col("r.confidence"), F.lit(v.DEFAULT_CONFIDENCE))
    ok = (
        F.col("r.source_entity").isNotNull() & F.col("r.target_entity").isNotNull() & F.col("r.relation_type").isNotNull()
        & _present(trace["text_snippet"]) & _present(trace["evidence_strength"]) & (confidence >= v.MIN_RELATION_CONFIDENCE)
    )
    rows = r.filter(ok).select(
        passage, "pos", strip(F.col("r.source_entity")).alias("source_name"), strip(F.col("r.target_entity")).alias("target_name"),
        nm.relation_type(F.col("r.relation_type")).alias("type"), confidence.alias("confidence"),
        F.col("r.description").alias("description"), F.col("r.properties").alias("properties"),
        *[trace[c].alias(c) for c in ("text_snippet", "context", "figure_table_ref", "evidence_strength")],
    )
    # within a passage the last entity of a name counts
    known = entities.groupBy(passage, "name").agg(F.max_by("entity_id", "pos").alias("id"))
    source = known.select(passage, F.col("name").alias("source_name"), F.col("id").alias("source_id"))
    target = known.select(passage, F.col("name").alias("target_name"), F.col("id").alias("target_id"))
    return rows.join(source, [passage, "source_name"]).join(target, [passage, "target_name"])


def extraction_stats(parsed: DataFrame, entities: DataFrame, relations: DataFrame, response: str = "response", filtered: dict[str, int] | None = None) -> DataFrame:
    """Totals, traced shares and failures as one row; ``filtered`` are the counts that ``extraction_requests`` has observed.

    ``extraction_failures`` are answers that stay unreadable, ``failed_calls`` rows for which the model gave none.
    """
    failed = F.col(f"{response}_error").isNotNull() if f"{response}_error" in parsed.columns else F.col(response).isNull()
    p = parsed.agg(
        F.count("*").alias("responses"), F.count_if(failed).alias("failed_calls"),
        F.count_if(F.col("parsed").isNull() & response_json(F.col(response)).isNotNull()).alias("extraction_failures"),
    )
    e = entities.agg(
        F.count("*").alias("total_entities"), F.count_if(_present(F.col("text_snippet"))).alias("entities_with_traceability"),
        F.count_if(F.col("type") == "Metric").alias("metrics_extracted"),
    )
    r = relations.agg(
        F.count("*").alias("total_relations"), F.count_if(F.col("type") == "PREDICTS").alias("prediction_relations"),
        F.count_if(_present(F.col("text_snippet"))).alias("relations_with_traceability"),
    )

    def rate(kind: str) -> Column:
        total = F.col(f"total_{kind}")
        return F.when(total > 0, F.col(f"{kind}_with_traceability") / total * 100).otherwise(0.0)

    out = one_row(p, e, r).withColumns({"entity_traceability_rate": rate("entities"), "relation_traceability_rate": rate("relations")})
    return out.withColumns({name: F.lit(n).cast("bigint") for name, n in (filtered or {}).items()})


# --- merging -------------------------------------------------------------------------------------------------------
def named_ids(names: DataFrame) -> DataFrame:
    """(name, type, canonical, entity_id, normal_name) of every distinct name, written once.

    The costly name rules run per distinct name, not per mention; being a table of its own, it can be broadcast or, where
    one name is hot, joined in split partitions.
    """
    name, kind = F.col("name"), F.col("type")
    distinct = names.select("name", "type").distinct()
    return cut_lineage(distinct.select("name", "type", nm.canonical_name(name).alias("canonical"), nm.entity_id(name, kind).alias("entity_id"), nm.normalize_name(name).alias("normal_name")))


def keyed_entities(df: DataFrame) -> DataFrame:
    """Mentions with their canonical key, identifier and normal name; mentions without a name or type fall out."""
    return df.drop("canonical", "entity_id", "normal_name").join(named_ids(df), ["name", "type"])


def longest(c: str) -> Column:
    """Longest non-empty text of a group; the smallest one among equals."""
    text = F.col(c)
    # min_by over (−length, text) keeps one candidate per partial aggregate; it passes over NULL ranks, hence missing texts
    return F.min_by(text, F.when(text.isNotNull(), F.struct(-F.length(text), text)))


def best_name(c: str, order: str | None = None) -> Column:
    """The name with the highest score; the earliest among equals, or the smallest when no order is given."""
    tie = F.col(order) if order else F.col(c)
    return F.min_by(F.col(c), F.struct(-nm.name_score(F.col(c)), tie, F.col(c)))


def merge_entities(mentions: DataFrame, order: str | None = None) -> DataFrame:
    """One vertex per canonical name and type with best name, longest description, top confidence and counts.

    A mention is one row of its paper and one of its texts; equal rows are merged first, by hash aggregation, so what is
    left grows with papers plus texts instead of their pairs.  The best texts are then chosen from the few rows that are
    left, so a hub entity spreads over many tasks before its rows meet, and nothing is joined.
    """
    return entities_of_parts(keyed_entity_parts(keyed_entities(mentions), order))


def keyed_entity_parts(keyed: DataFrame, order: str | None = None) -> DataFrame:
    """Mergeable parts of keyed mentions: counts per entity and paper, and one row per entity, without paper, of its best texts."""
    return _best_per(entity_statements(keyed, order), ["entity_id", "type", "paper"])


def entity_statements(keyed: DataFrame, order: str | None = None) -> DataFrame:
    """The distinct papers of every entity with their counts, and its distinct pairs of name and description."""
    key, f = ["entity_id", "type", "paper", "name", "description"], F.col
    rows = keyed.withColumn("_at", f(order) if order else F.lit(None).cast("string"))

    def empty(c: str) -> Column:
        return F.lit(None).cast(rows.schema[c].dataType)

    cells = [
        f("paper"), empty("normal_name"), empty("description"), F.lit(1).cast("bigint"), f("confidence"), empty("_at"),
        empty("paper"), f("normal_name"), f("description"), F.lit(0).cast("bigint"), empty("confidence"), f("_at"),
    ]
    halves = rows.select("entity_id", "type", F.stack(F.lit(2), *cells).alias(*key[2:], "mentions", "confidence", "_at"))
    # a least text would be found by sorting all rows, so without an order there is none to find
    at = F.min("_at") if order else F.lit(None).cast("string")
    return halves.groupBy(*key).agg(F.sum("mentions").alias("mentions"), F.max("confidence").alias("confidence"), at.alias("_at"))


def merge_entity_parts(parts: DataFrame) -> DataFrame:
    """Parts of several batches as those of all their mentions together."""
    return _best_per(parts, ["entity_id", "type", "paper"])


def entities_of_parts(parts: DataFrame) -> DataFrame:
    return _best_per(parts, ["entity_id", "type"], F.count("paper").alias("papers")).drop("_at")


def _counted(keyed: DataFrame, by: list[str]) -> DataFrame:
    return keyed.groupBy("entity_id", "type", *by, F.col("normal_name").alias("name"), "description").agg(
        F.count("*").alias("mentions"), F.max("confidence").alias("confidence"), F.lit(None).cast("string").alias("_at")
    )


def _best_per(rows: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    # rows of papers carry no name, and min_by passes over NULL ranks
    rank = F.when(F.col("name").isNotNull(), F.struct(-nm.name_score(F.col("name")), "_at", "name"))
    return rows.groupBy(*keys).agg(
        F.sum("mentions").alias("mentions"), F.min_by("name", rank).alias("name"), longest("description").alias("description"),
        F.max("confidence").alias("confidence"), F.min_by("_at", rank).alias("_at"), *more,
    )


def entity_papers(mentions: DataFrame) -> DataFrame:
    return keyed_entities(mentions).select("entity_id", "paper").distinct()


def entity_descriptions(mentions: DataFrame) -> DataFrame:
    return keyed_entities(mentions).filter(_present(strip(F.col("description")))).select("entity_id", "description").distinct()


def entity_properties(mentions: DataFrame, key: str = "prop_key", value: str = "prop_value") -> DataFrame:
    """Every distinct value of every property, with the number of values: more than one is a conflict kept as a list."""
    return _properties(keyed_entities(mentions), key, value)


def _properties(keyed: DataFrame, key: str, value: str) -> DataFrame:
    distinct = keyed.select("entity_id", key, value).distinct()
    counts = distinct.groupBy("entity_id", key).agg(F.count("*").alias("values"))
    return distinct.join(counts, ["entity_id", key])


def merge_relations(relations: DataFrame) -> DataFrame:
    """One edge per (source, type, target) with counts, top confidence and the first description."""
    one = F.lit(1).cast("bigint").alias("mentions")
    return relations_of_statements(relations.select("source_id", "type", "target_id", "paper", "description", one, "confidence"))


def relations_of_statements(counted: DataFrame) -> DataFrame:
    """Edges of statements (source, type, target, paper, description) with their mentions and top confidence.

    A statement is two rows, one of its paper and one of its description; equal ones are merged by hashing, spread by
    paper or text where an edge is a hub, and what is left of them is counted, so nothing is expanded to count what is distinct.
    """
    key, f = ["source_id", "type", "target_id"], F.col
    cells = [
        F.lit(True), f("paper").cast("string"), f("mentions"), f("confidence"),
        F.lit(False), f("description"), F.lit(0).cast("bigint"), F.lit(None).cast(counted.schema["confidence"].dataType),
    ]
    halves = counted.select(*key, F.stack(F.lit(2), *cells).alias("_paper", "_value", "mentions", "confidence"))
    merged = halves.groupBy(*key, "_paper", "_value").agg(F.sum("mentions").alias("mentions"), F.max("confidence").alias("confidence"))
    return merged.groupBy(*key).agg(
        F.sum("mentions").alias("mentions"), F.max("confidence").alias("confidence"), F.min(F.when(~f("_paper"), f("_value"))).alias("description"),
        F.count_if(f("_paper") & f("_value").isNotNull()).alias("papers"), F.count_if(~f("_paper") & _present(f("_value"))).alias("descriptions"),
    )


def graph_of(entities: DataFrame, relations: DataFrame, paper: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Accepted entities and relations of all papers as one graph: (vertices, edges, vertex properties)."""
    source = F.col(paper).cast("string").alias("paper")
    keyed = keyed_entities(entities.select("name", "type", "description", "confidence", "properties", source))
    vertices = entities_of_parts(keyed_entity_parts(keyed))
    edges = merge_relations(relations.select("source_id", "type", "target_id", "description", "confidence", source))
    return vertices, edges, _properties(keyed.select("entity_id", F.explode("properties").alias("prop_key", "prop_value")), "prop_key", "prop_value")


def relation_descriptions(relations: DataFrame) -> DataFrame:
    return relations.filter(_present(F.col("description"))).select("source_id", "type", "target_id", "description").distinct()


def joined_descriptions(relations: DataFrame) -> DataFrame:
    """Distinct descriptions of an edge as one ``; `` joined text, in sorted order.

    For edges whose set of distinct texts is known to be small, such as templated ones; ``relation_descriptions`` holds
    the same content for any size.
    """
    return relation_descriptions(relations).groupBy("source_id", "type", "target_id").agg(
        F.array_join(F.array_sort(F.collect_list("description")), "; ").alias("description")
    )


def name_variants(mentions: DataFrame) -> DataFrame:
    """The distinct spellings behind each canonical key."""
    return mentions.select(nm.canonical_name(F.col("name")).alias("canonical"), F.col("name").alias("variant")).distinct()


def upsert_entities(old: DataFrame, new: DataFrame) -> DataFrame:
    """Scalars of a stored graph after new rows arrived: new values replace old ones, the higher confidence stays."""
    o = old.select("id", *[F.col(c).alias(f"o_{c}") for c in old.columns if c != "id"])
    n = new.select("id", *[F.col(c).alias(f"n_{c}") for c in new.columns if c != "id"])
    both = o.join(n, "id", "full_outer")
    is_new = F.col("n_name").isNotNull()
    cols = [
        F.greatest("o_confidence", "n_confidence").alias("confidence") if c == "confidence"
        else F.when(is_new, F.col(f"n_{c}")).otherwise(F.col(f"o_{c}")).alias(c)
        for c in new.columns if c != "id"
    ]
    return both.select("id", *cols)


def upsert_items(old: DataFrame, new: DataFrame, keys: list[str], order: str = "pos") -> DataFrame:
    """List-valued fields as rows: old items that do not come again, then the new ones; (part, order) gives the sequence."""
    kept = old.join(new.select(*keys), keys, "left_anti")
    return kept.select(*keys, F.lit(0).alias("part"), order).unionByName(new.select(*keys, F.lit(1).alias("part"), order))


EDGE_KEY = ["source_id", "target_id", "id", "type"]


def upsert_relations(old: DataFrame, new: DataFrame, vertices: DataFrame) -> DataFrame:
    """Stored edges after new ones arrived; a new edge needs both ends among the vertices."""
    ends = vertices.select("id").distinct()
    usable = new.join(ends.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(
        ends.withColumnRenamed("id", "target_id"), "target_id", "left_semi"
    )
    kept = old.join(usable.select(*EDGE_KEY), EDGE_KEY, "left_anti")
    return kept.unionByName(usable.select(*old.columns))


def dropped_relations(new: DataFrame, vertices: DataFrame) -> DataFrame:
    """How many new edges miss an end."""
    ends = vertices.select("id").distinct().withColumn("_hit", F.lit(True))
    marked = new.join(ends.select(F.col("id").alias("source_id"), F.col("_hit").alias("_s")), "source_id", "left").join(
        ends.select(F.col("id").alias("target_id"), F.col("_hit").alias("_t")), "target_id", "left"
    )
    missing = F.col("_s").isNull() | F.col("_t").isNull()
    return marked.agg(F.count_if(missing).alias("dropped"), F.count_if(~missing).alias("usable"))


def windowed_merge(mentions: DataFrame, window: Column) -> DataFrame:
    """Entities as saved window by window: the last window that saw an entity names it, confidence only rises.

    Windows are merged by one aggregate each and then by one more, instead of one store round trip per window.
    """
    k = keyed_entities(mentions).withColumn("_w", window)
    per_window = _best_per(_counted(k, ["_w"]), ["entity_id", "type", "_w"])
    return per_window.groupBy("entity_id", "type").agg(
        F.max_by("name", "_w").alias("name"), F.max_by("description", "_w").alias("description"), F.max("confidence").alias("confidence"),
        F.sum("mentions").alias("mentions"), F.count("*").alias("windows"),
    )


# --- structured records ------------------------------------------------------------------------------------------
def _device(dataset: str) -> Column:
    doi8 = F.when(F.col("doi").isNotNull(), F.substring(F.md5("doi"), 1, 8)).otherwise("nodoi")
    return F.concat_ws("-", F.lit(dataset), doi8, F.col("record_id"))


def record_ids(records: DataFrame, dataset: str = "records") -> DataFrame:
    """Records with the identifiers of everything they mention.

    Names of materials and papers are resolved once each; the metric vertices are fixed names, so their identifiers are
    literals of the plan.
    """
    f = F.col
    df = records.withColumns(
        {
            "device_name": _device(dataset),
            "additive_name": F.when(f("additive_id").isNotNull(), F.concat(F.lit(dataset + "-"), f("additive_id"))),
        }
    )
    shared = [("donor_name", "Material", "donor_id"), ("acceptor_name", "Material", "acceptor_id"), ("additive_name", "Material", "additive_eid"), ("doi", "Paper", "paper_eid")]
    named = F.array(*[F.struct(f(c).cast("string").alias("name"), F.lit(kind).alias("type")) for c, kind, _ in shared])
    ids = named_ids(df.select(F.explode(named).alias("n")).select("n.*").filter("name IS NOT NULL")).select("name", "type", "entity_id")
    for c, kind, out in shared:
        df = df.join(ids.filter(f("type") == kind).select(f("name").alias(c), f("entity_id").alias(out)), c, "left")
    return df.withColumn("device_id", nm.entity_id(f("device_name"), F.lit("Device")))


def _filled(rows: DataFrame, facts: list[tuple[str, str, Column]]) -> DataFrame:
    """(id, key, value) of facts given as (column of the owner's id, key, value); empty ones are left out.

    Every value is a column, made once a row by compiled code, before the facts become rows.
    """
    f = F.col
    wide = rows.select(*dict.fromkeys(owner for owner, _, _ in facts), *[c.cast("string").alias(f"_v{j}") for j, (_, _, c) in enumerate(facts)])
    cells = [c for j, (owner, k, _) in enumerate(facts) for c in (f(owner), F.lit(k), f(f"_v{j}"))]
    out = wide.select(F.stack(F.lit(len(facts)), *cells).alias("id", "key", "value"))
    return out.filter(f("id").isNotNull() & _present(f("value")))


def _optional(df: DataFrame, column: str) -> Column:
    return F.col(column) if column in df.columns else F.lit(None).cast("string")


def _order_prefix(c: Column) -> Column:
    """A number that orders as the first seven bytes of a text, so that a hash aggregation can carry it."""
    return F.conv(F.rpad(F.substring(F.hex(F.encode(c, "UTF-8")), 1, 14), 14, "0"), 16, 10).cast("bigint")


def _first_values(ids: DataFrame, made: Column, keys: list[str], columns: list[str]) -> DataFrame:
    """One row per vertex: its mentions, and every column's first non-empty value in (record_id, _k) order.

    ``made`` are a record's vertices as an array of structs.  What is aggregated over all mentions are numbers, by hashing
    before anything is shuffled: how often a vertex comes, and the least prefix of the ids of the records that fill a column.
    Only the few records with such a prefix are read again, where the order itself decides.
    """
    marked = ids.withColumn("_p", F.coalesce(_order_prefix(F.col("record_id")), F.lit(-1)))

    def mentions(records: DataFrame) -> DataFrame:
        rows = records.select("record_id", "_p", F.posexplode_outer(made).alias("_k", "v")).filter("v.id IS NOT NULL")
        return rows.select("record_id", "_p", "_k", *[F.when(_present(F.col(f"v.{c}")), F.col(f"v.{c}")).alias(c) if c in columns else F.col(f"v.{c}") for c in [*keys, *columns]])

    least = [F.min(F.when(F.col(c).isNotNull(), F.col("_p"))).alias(f"_p_{c}") for c in columns]
    first = cut_lineage(mentions(marked).groupBy(*keys).agg(F.count("*").alias("mentions"), *least))
    prefixes = first.select(F.explode(F.array(*[f"_p_{c}" for c in columns])).alias("_p")).filter("_p IS NOT NULL").distinct()
    near = mentions(marked.join(cut_lineage(prefixes), "_p", "left_semi")).join(first, keys)
    order = F.struct("record_id", "_k")
    best = [F.min_by(c, F.when(F.col(c).isNotNull() & (F.col("_p") == F.col(f"_p_{c}")), order)).alias(c) for c in columns]
    values = near.groupBy(*keys).agg(*best)
    return first.select(*keys, "mentions").join(values, keys, "left")


def _several(ids: DataFrame) -> DataFrame:
    """Hashes of the devices that more than one record describes: none, where record ids are unique.

    Numbers are dealt out before they are counted, 500,000 to a task on average; a device that shares its hash is only
    treated like one of several records.
    """
    hashes = ids.select(F.xxhash64("device_id").alias("_h"))
    parts = max(ids.sparkSession.sparkContext.defaultParallelism, -(-ids.select("record_id").count() // 500_000))
    return cut_lineage(hashes.repartition(parts, "_h").groupBy("_h").agg(F.count("*").alias("n")).filter("n > 1").select("_h"))


def _split_devices(ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records that alone describe their device, and all others."""
    hashed, several = ids.withColumn("_h", F.xxhash64("device_id")), _several(ids)
    return hashed.join(several, "_h", "left_anti").drop("_h"), hashed.join(several, "_h", "left_semi").drop("_h")


def record_properties(ids: DataFrame, dataset: str = "records") -> DataFrame:
    """(id, key, value) of every vertex of the records; of several values in record order the first counts.

    A device that one record alone describes has its values there, and nothing of it is shuffled but its id.
    """
    def o(c: str) -> Column:
        return _optional(ids, c).cast("string")

    shared = ["smiles", "material_type", "role", "dataset", "additive_id", "doi"]

    def vertex(owner: str, facts: dict[str, Column]) -> Column:
        none = F.lit(None).cast("string")
        return F.struct(F.col(owner).alias("id"), *[facts.get(c, none).alias(c) for c in shared])

    def material(end: str) -> dict[str, Column]:
        return {"smiles": o(f"{end}_smiles"), "material_type": o(f"{end}_type"), "role": F.lit(end), "dataset": F.lit(dataset)}

    made = F.array(
        vertex("donor_id", material("donor")), vertex("acceptor_id", material("acceptor")),
        vertex("additive_eid", {"additive_id": o("additive_id"), "role": F.lit("additive"), "dataset": F.lit(dataset)}),
        vertex("paper_eid", {"doi": o("doi"), "dataset": F.lit(dataset)}),
    )
    firsts = _first_values(ids, made, ["id"], shared)
    values = _filled(firsts, [("id", c, F.col(c)) for c in shared])

    device = [*[("device_id", c, o(c)) for c in v.DEVICE_PROPERTIES], ("device_id", "record_id", F.col("record_id")), ("device_id", "dataset", F.lit(dataset))]
    one, more = _split_devices(ids)
    facts = F.array(*[F.struct(F.lit(k).alias("key"), c.cast("string").alias("value")) for _, k, c in device])
    rows = more.select("record_id", F.col("device_id").alias("id"), F.posexplode(facts).alias("pos", "f")).filter(F.col("id").isNotNull() & _present(F.col("f.value")))
    merged = rows.select("id", "f.key", "f.value", "record_id", "pos").groupBy("id", "key").agg(F.min_by("value", F.struct("record_id", "pos")).alias("value"))
    return values.unionByName(_filled(one, device)).unionByName(merged)


def record_edge_properties(ids: DataFrame, dataset: str = "records") -> DataFrame:
    """(id, key, value) of every edge of the records, its description among them."""
    f = F.col

    def o(c: str) -> Column:
        return _optional(ids, c)

    def number(c: str) -> Column:
        return o(c).cast("double")

    edges: list[Column] = []
    said_of: list[tuple[int, str, Column]] = []

    def edge(source: Column, target: Column, kind: str, suffix: Column, facts: dict[str, Column]) -> None:
        said_of.extend((len(edges), k, c.cast("string")) for k, c in facts.items())
        edges.append(nm.edge_id(source, target, F.lit(kind), suffix))  # NULL if an end is

    def said(*parts: Column | str) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    device = f("device_id")
    for end, eid, name in (("donor", "donor_id", "donor_name"), ("acceptor", "acceptor_id", "acceptor_name"), ("additive", "additive_eid", "additive_id")):
        facts = {"concentration_mg_ml": number(f"{end}_conc_mg_ml"), "description": said("Device ", f("device_name"), f" uses {end} ", f(name), ".")}
        if end == "additive":
            facts |= {"vol_pct": number("additive_vol_pct"), "wt_pct": number("additive_wt_pct")}
        edge(device, f(eid), "USES", F.concat(f("record_id"), F.lit(f"|{end}")), facts)
    gains = {"delta_pce": number("delta_pce"), "pce_baseline": number("pce_baseline"), "morphology_effect": o("morphology_effect"), "mechanism": o("mechanism")}
    edge(f("additive_eid"), device, "ENHANCES", f("record_id"), {**gains, "description": said("Additive ", f("additive_id"), " enhances device ", f("device_name"), ".")})
    for column, metric, unit in v.DEVICE_METRICS:
        value = number(column)
        metric_id = F.when(value.isNotNull(), nm.entity_id(F.lit(metric), F.lit("Metric")))
        text = said("Device ", f("device_name"), f" {metric} = ", value.cast("string"), f" {unit}." if unit else ".")
        edge(device, metric_id, "HAS_PROPERTY", F.concat(f("record_id"), F.lit(f"|{column}")), {"value": value, "unit": F.lit(unit), "description": text})
    edge(f("paper_eid"), device, "CONTAINS", f("record_id"), {"dataset": F.lit(dataset), "description": said("Paper ", f("doi"), " contains device record ", f("record_id"), ".")})
    # identifiers are columns, too, made once a record
    named = ids.withColumns({f"_e{i}": e for i, e in enumerate(edges)})
    return _filled(named, [(f"_e{i}", k, c) for i, k, c in said_of])


def record_vertices(ids: DataFrame, dataset: str = "records") -> DataFrame:
    """Vertices of device records; the first non-null property in record order wins.

    Shared vertices are counted by hashing; a device that one record alone describes is made from that record as it stands.
    """
    f, none = F.col, F.lit(None).cast("string")

    def vertex(eid, name, kind, role, description, smiles=none, material=none) -> Column:
        return F.struct(
            eid.alias("id"), name.alias("name"), F.lit(kind).alias("type"), role.alias("role"), description.alias("description"),
            smiles.alias("smiles"), material.alias("material_type"),
        )

    donor = vertex(f("donor_id"), f("donor_name"), "Material", F.lit("donor"), F.concat(F.lit("Donor "), f("donor_name"), F.lit(f" ({dataset}).")), f("donor_smiles"), f("donor_type"))
    acceptor = vertex(f("acceptor_id"), f("acceptor_name"), "Material", F.lit("acceptor"), F.concat(F.lit("Acceptor "), f("acceptor_name"), F.lit(f" ({dataset}).")))
    additive = vertex(f("additive_eid"), f("additive_name"), "Material", F.lit("additive"), F.concat(F.lit("Additive "), f("additive_id"), F.lit(f" from {dataset}.")))
    device = vertex(
        f("device_id"), f("device_name"), "Device", none,
        F.concat(
            F.lit("Device record "), f("record_id"), F.lit(": "), f("donor_name"), F.lit("/"), f("acceptor_name"),
            F.when(f("additive_id").isNotNull(), F.concat(F.lit(" with additive "), f("additive_id"))).otherwise(""),
            F.when(f("doi").isNotNull(), F.concat(F.lit(", DOI "), f("doi"))).otherwise(""), F.lit("."),
        ),
    )
    paper = vertex(f("paper_eid"), f("doi"), "Paper", none, F.concat(F.lit("Paper (DOI "), f("doi"), F.lit(").")))
    facts = ["name", "description", "role", "smiles", "material_type"]
    key = ["id", "type"]

    def present(prefix: str = "") -> list[Column]:
        return [F.when(_present(f(prefix + c)), f(prefix + c)).alias(c) for c in facts]

    shared = _first_values(ids, F.array(donor, acceptor, additive, paper), key, facts)
    alone, others = _split_devices(ids)
    one = alone.filter("device_id IS NOT NULL").select(device.alias("v"))
    single = one.select("v.id", "v.type", F.lit(1).cast("bigint").alias("mentions"), *present("v."))
    more = others.filter("device_id IS NOT NULL").select("record_id", device.alias("v")).select("record_id", "v.*")
    merged = more.groupBy(*key).agg(F.count("*").alias("mentions"), *[F.min_by(c, F.when(_present(f(c)), f("record_id"))).alias(c) for c in facts])
    return shared.unionByName(single).unionByName(merged).unionByName(metric_vertices(ids), allowMissingColumns=True)


def metric_vertices(df: DataFrame) -> DataFrame:
    rows = [(n, u, f"{n} metric (shared node).") for _, n, u in v.DEVICE_METRICS]
    made = df.sparkSession.createDataFrame(rows, "name string, unit string, description string")
    return made.select(
        nm.entity_id(F.col("name"), F.lit("Metric")).alias("id"), F.lit("Metric").alias("type"), F.lit(0).cast("bigint").alias("mentions"), "name", "description"
    )


def record_edges(ids: DataFrame) -> DataFrame:
    """Edges of device records, one per record and role: USES, ENHANCES, HAS_PROPERTY and CONTAINS."""
    f, none = F.col, F.lit(None).cast("double")

    def suffix(role: str) -> Column:
        return F.concat(f("record_id"), F.lit("|" + role))

    device = f("device_id")
    edges = [
        (device, f("donor_id"), "USES", suffix("donor"), f("donor_conc")),
        (device, f("acceptor_id"), "USES", suffix("acceptor"), none),
        (device, f("additive_eid"), "USES", suffix("additive"), none),
        (f("additive_eid"), device, "ENHANCES", f("record_id"), none),
    ]
    for column, metric, _ in v.DEVICE_METRICS:
        metric_id = F.when(f(column).isNotNull(), nm.entity_id(F.lit(metric), F.lit("Metric")))
        edges.append((device, metric_id, "HAS_PROPERTY", suffix(column), f(column)))
    edges.append((f("paper_eid"), device, "CONTAINS", f("record_id"), none))
    # every identifier is a column, made once a record by compiled code, before the edges become rows
    wide = ids.withColumns({f"_e{i}": nm.edge_id(a, b, F.lit(kind), more) for i, (a, b, kind, more, _) in enumerate(edges)})
    cells = [c for i, (a, b, kind, _, value) in enumerate(edges) for c in (f(f"_e{i}"), a, b, F.lit(kind), value.cast("double"))]
    rows = wide.select(F.stack(F.lit(len(edges)), *cells).alias("id", "source_id", "target_id", "type", "value"), "doi")
    return rows.filter(f("source_id").isNotNull() & f("target_id").isNotNull())


def reconcile(vertices: DataFrame, edges: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Reuse stored vertices of the same name: (vertices to insert, rewritten edges, old id → stored id)."""
    stored = existing.groupBy("name").agg(F.min("id").alias("stored_id"))
    matched = vertices.join(stored, "name", "left")
    other = F.col("stored_id").isNotNull() & (F.col("stored_id") != F.col("id"))
    remap = matched.filter(other).select(F.col("id").alias("old_id"), "stored_id").distinct()
    keep = matched.filter(~other | F.col("stored_id").isNull()).drop("stored_id")
    for end in ("source_id", "target_id"):
        edges = (
            edges.join(remap.withColumnRenamed("old_id", end), end, "left")
            .withColumn(end, F.coalesce("stored_id", end))
            .drop("stored_id")
        )
    return keep, edges, remap

"""Questions to the graph of nations, suppliers and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import questions as qs
from paperloom import vocab as v
from paperloom.operators import kg_query as kg
from paperloom.plans import inputs
from paperloom.plans.registry import query
from paperloom.plans.sqlkit import s, with_inputs
from paperloom.sources.readers import table


def _graph(spark, sf):
    return inputs.trade_vertices(spark, sf), inputs.trade_edges(spark, sf)


@query("g1_entity_by_id", with_inputs("SELECT w.* FROM vertices w WHERE id IN (SELECT 'S' || max(s_suppkey) FROM supplier GROUP BY s_nationkey)"))
def _(spark, sf):
    ids = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.concat(F.lit("S"), F.max("s_suppkey").cast("string")).alias("id"))
    return kg.by_id(inputs.trade_vertices(spark, sf), ids)


@query("g2_search_by_name", with_inputs("SELECT id, name, type FROM vertices WHERE contains(name, 'widget') AND type = 'Part' ORDER BY name, id LIMIT 100"))
def _(spark, sf):
    return kg.search(inputs.trade_vertices(spark, sf), "widget", "Part", 100).select("id", "name", "type")


@query(
    "g3_relations_both_ways",
    with_inputs(
        """SELECT r.id, other_id, relation, direction, o.name AS other_name, o.type AS other_type FROM (SELECT source_id AS id, target_id AS other_id, type AS relation, 'outgoing' AS direction FROM edges
        UNION ALL SELECT target_id, source_id, type, 'incoming' FROM edges) r JOIN vertices x ON x.id = r.id JOIN vertices o ON o.id = other_id"""
    ),
)
def _(spark, sf):
    vs, es = _graph(spark, sf)
    return kg.relations_of(vs, vs, es)


@query(
    "g4_paths_of_mixed_length",
    with_inputs(
        """SELECT source_id, target_id, length, array_to_string(path, '>') AS path FROM (
        SELECT a AS source_id, b AS target_id, 1 AS length, [a, b] AS path FROM pairs JOIN both_ways ON a = x AND b = y
        UNION ALL SELECT a, b, 2, min([a, e.y, b]) FROM pairs JOIN both_ways e ON a = e.x JOIN both_ways f ON f.x = e.y AND f.y = b GROUP BY a, b)
        QUALIFY row_number() OVER (PARTITION BY source_id, target_id ORDER BY length) = 1""",
        both_ways="SELECT DISTINCT source_id AS x, target_id AS y FROM edges UNION SELECT target_id, source_id FROM edges",
        pairs="""SELECT 'S' || s_suppkey AS a, 'N' || s_suppkey % 25 AS b FROM supplier UNION ALL SELECT 'S' || s_suppkey, 'S' || (s_suppkey + 1) FROM supplier
        UNION ALL SELECT 'N' || p_partkey % 25, 'P' || p_partkey FROM part""",
    ),
)
def _(spark, sf):
    """Neighbours, pairs with a common neighbour and pairs out of reach together."""
    sup, part = F.col("s_suppkey"), F.col("p_partkey")

    def name(kind, c):
        return F.concat(F.lit(kind), c.cast("string"))

    s, p = table(spark, sf, "supplier"), table(spark, sf, "part")
    pairs = s.select(name("S", sup).alias("source_id"), name("N", sup % 25).alias("target_id"))
    pairs = pairs.unionByName(s.select(name("S", sup).alias("source_id"), name("S", sup + 1).alias("target_id")))
    pairs = pairs.unionByName(p.select(name("N", part % 25).alias("source_id"), name("P", part).alias("target_id")))
    found = kg.shortest_paths(pairs, inputs.trade_edges(spark, sf), 2)
    return found.select("source_id", "target_id", "length", F.array_join("path", ">").alias("path"))


@query(
    "g4_shortest_paths",
    """WITH sp AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), reach AS (SELECT DISTINCT s_nationkey, s_suppkey, l_partkey FROM supplier JOIN sp ON s_suppkey = l_suppkey)
    SELECT 'N' || a.s_nationkey AS source_id, 'N' || b.s_nationkey AS target_id, 4 AS length,
    array_to_string(min(['N' || a.s_nationkey, 'S' || a.s_suppkey, 'P' || a.l_partkey, 'S' || b.s_suppkey, 'N' || b.s_nationkey]), '>') AS path
    FROM reach a JOIN reach b ON a.l_partkey = b.l_partkey AND b.s_nationkey = (a.s_nationkey + 1) % 25 GROUP BY ALL""",
)
def _(spark, sf):
    n = table(spark, sf, "nation")
    pairs = n.select(
        F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("source_id"),
        F.concat(F.lit("N"), ((F.col("n_nationkey") + 1) % 25).cast("string")).alias("target_id"),
    )
    found = kg.shortest_paths(pairs, inputs.trade_edges(spark, sf), 4)
    return found.select("source_id", "target_id", "length", F.array_join("path", ">").alias("path"))


@query(
    "g5_graph_stats",
    with_inputs(
        """SELECT part, type, n, round(n * 100 / sum(n) OVER (PARTITION BY part), 6) AS share FROM (SELECT 'entity' AS part, type, count(*) AS n FROM vertices GROUP BY type
        UNION ALL SELECT 'relation', type, count(*) FROM edges GROUP BY type) UNION ALL SELECT 'entity', NULL, count(*), 100.0 FROM vertices UNION ALL SELECT 'relation', NULL, count(*), 100.0 FROM edges"""
    ),
)
def _(spark, sf):
    return kg.graph_stats(*_graph(spark, sf))


@query(
    "g6_export_graph",
    with_inputs(
        """SELECT e.source_id, e.type, e.target_id, x.name AS source_name, x.type AS source_type, y.name AS target_name, y.type AS target_type FROM
        (SELECT * FROM edges ORDER BY source_id, type, target_id LIMIT 1000) e JOIN vertices x ON x.id = source_id JOIN vertices y ON y.id = target_id"""
    ),
)
def _(spark, sf):
    vs, es = _graph(spark, sf)
    return kg.export_graph(vs, es, 1000)


_STOP = "[" + ", ".join(s(w) for w in v.STOP_WORDS) + "]"
_KEYWORDS = f"(list_filter(regexp_extract_all(lower(question), {s(v.WORDS)}), lambda w: length(w) > 2 AND NOT list_contains({_STOP}, w)))[1:5]"
_WORDS = f"SELECT item_id, unnest(range(len(k))) AS pos, unnest(k) AS keyword FROM (SELECT item_id, {_KEYWORDS} AS k FROM questions)"


def _words(spark, sf):
    q = inputs.questions(spark, sf)
    return q.select("item_id", F.posexplode_outer(qs.keywords(F.col("question"))).alias("pos", "keyword")).filter(F.col("pos").isNotNull())


@query("g7_keywords", with_inputs("SELECT item_id, pos, keyword FROM words", words=_WORDS))
def _(spark, sf):
    return _words(spark, sf)


_PAIRS = "SELECT DISTINCT keyword, name FROM (SELECT DISTINCT keyword FROM words), (SELECT DISTINCT name FROM vertices) WHERE contains(lower(name), lower(keyword))"
_HITS = """SELECT keyword, 'entity' AS kind, row_number() OVER (PARTITION BY keyword ORDER BY name, id) AS rank, name AS text FROM kwpairs JOIN vertices USING (name) QUALIFY rank <= 5
    UNION ALL SELECT keyword, 'relation', row_number() OVER (PARTITION BY keyword ORDER BY x.name, e.source_id, e.type, y.name, e.target_id) AS rank, x.name || ' ' || e.type || ' ' || y.name
    FROM kwpairs p JOIN vertices x USING (name) JOIN edges e ON e.source_id = x.id JOIN vertices y ON y.id = e.target_id QUALIFY rank <= 10"""


@query("g8_keyword_hits", with_inputs("SELECT * FROM hits", words=_WORDS, kwpairs=_PAIRS, hits=_HITS))
def _(spark, sf):
    return kg.keyword_hits(_words(spark, sf), *_graph(spark, sf))


@query(
    "g8_keyword_summaries",
    with_inputs(
        """SELECT item_id, len(e) AS entities, len(r) AS relations, concat_ws('. ', CASE WHEN len(e) > 0 THEN 'Entities: ' || array_to_string(e[1:5], ', ') END,
        CASE WHEN len(r) > 0 THEN 'Relationships: ' || array_to_string(r[1:5], '; ') END) AS summary FROM (SELECT item_id, coalesce(list(text ORDER BY pos, rank) FILTER (WHERE kind = 'entity'), []) AS e,
        coalesce(list(text ORDER BY pos, rank) FILTER (WHERE kind = 'relation'), []) AS r FROM words JOIN hits USING (keyword) GROUP BY item_id)""",
        words=_WORDS, kwpairs=_PAIRS, hits=_HITS,
    ),
)
def _(spark, sf):
    w = _words(spark, sf)
    return kg.keyword_summaries(w, kg.keyword_hits(w, *_graph(spark, sf)))


_FUZZY = """SELECT term, id, name, type, description, row_number() OVER (PARTITION BY term ORDER BY name, id) AS rank FROM (SELECT DISTINCT keyword AS term FROM words), vertices
    WHERE contains(lower(name), term) OR contains(term, lower(name)) OR contains(lower(description), term) QUALIFY rank <= 10"""


def _facts(spark, sf):
    vs, es = _graph(spark, sf)
    terms = _words(spark, sf).withColumnRenamed("keyword", "term")
    return kg.question_facts(terms, kg.fuzzy_matches(terms, vs)), vs, es


_QFACTS = """SELECT item_id, term, name, id, type FROM (SELECT w.item_id, f.term, f.name, f.id, f.type, row_number() OVER (PARTITION BY w.item_id, f.name ORDER BY w.pos, f.rank) AS one
    FROM words w JOIN fuzzy f ON f.term = w.keyword) WHERE one = 1"""


@query("g9_fuzzy_entities", with_inputs("SELECT * FROM qfacts", words=_WORDS, fuzzy=_FUZZY, qfacts=_QFACTS))
def _(spark, sf):
    return _facts(spark, sf)[0].select("item_id", "term", "name", "id", "type")


_FACT_LINES = """SELECT x.id, concat_ws(chr(10), '• ' || x.name || ' (' || x.type || '):', CASE WHEN x.description <> '' THEN '  Description: ' || x.description END,
        coalesce('  Relationships:' || chr(10) || lines, '  (No relationships found in knowledge graph)')) AS fact FROM vertices x LEFT JOIN
        (SELECT id, string_agg(line, chr(10) ORDER BY rank) AS lines FROM (SELECT id, rank, CASE WHEN direction = 'incoming' THEN '    ← ' ELSE '    → ' END || relation || ': ' || other_name || ' (' || other_type || ')' AS line
        FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY direction DESC, relation, other_name, other_type) AS rank FROM (SELECT DISTINCT r.id, direction, relation, o.name AS other_name, o.type AS other_type FROM
        (SELECT source_id AS id, target_id AS other_id, type AS relation, 'outgoing' AS direction FROM edges UNION ALL SELECT target_id, source_id, type, 'incoming' FROM edges) r JOIN vertices o ON o.id = other_id))
        WHERE rank <= 10) GROUP BY id) l ON l.id = x.id WHERE x.id IN (SELECT id FROM qfacts)"""


@query("g10_fact_lines", with_inputs(_FACT_LINES, words=_WORDS, fuzzy=_FUZZY, qfacts=_QFACTS))
def _(spark, sf):
    facts, vs, es = _facts(spark, sf)
    return kg.fact_lines(facts, vs, es)


@query(
    "g11_sampled_overview",
    with_inputs(
        """SELECT c.id AS source_id, c.name AS source_name, e.type AS relation, e.target_id, t.name AS target_name FROM (SELECT * FROM vertices ORDER BY md5(id || '|0'), id LIMIT 100) c
        LEFT JOIN edges e ON e.source_id = c.id LEFT JOIN vertices t ON t.id = e.target_id"""
    ),
)
def _(spark, sf):
    vs, es = _graph(spark, sf)
    return kg.sampled_overview(vs, es, 100)


@query(
    "g12_question_subgraph",
    with_inputs(
        """SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY seed_rank, target_rank, id) AS rank, id FROM (SELECT item_id, id, seed_rank, target_rank FROM (
        SELECT item_id, seed_rank, 0 AS target_rank, id FROM seeds UNION ALL SELECT item_id, seed_rank, target_rank, target_id FROM seeds JOIN (SELECT source_id, target_id,
        row_number() OVER (PARTITION BY source_id ORDER BY target_id) AS target_rank FROM (SELECT DISTINCT source_id, target_id FROM edges)) ON source_id = id)
        QUALIFY row_number() OVER (PARTITION BY item_id, id ORDER BY seed_rank, target_rank) = 1) QUALIFY rank <= 20""",
        words=_WORDS, kwpairs=_PAIRS,
        seeds="""SELECT item_id, id, row_number() OVER (PARTITION BY item_id ORDER BY name, id) AS seed_rank FROM (SELECT DISTINCT item_id, name, id FROM words JOIN kwpairs USING (keyword)
        JOIN vertices USING (name)) QUALIFY seed_rank <= 10""",
    ),
)
def _(spark, sf):
    return kg.question_subgraph(_words(spark, sf), *_graph(spark, sf))


@query("g13_degrees", with_inputs("SELECT id, count(*) AS degree FROM (SELECT source_id AS id FROM edges UNION ALL SELECT target_id FROM edges) GROUP BY id"))
def _(spark, sf):
    return kg.degrees(inputs.trade_edges(spark, sf))

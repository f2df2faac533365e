"""Lookups, neighbourhoods, paths and statistics over a vertex and an edge table.

"Name contains keyword" has no key to join on.  Instead of comparing every name with every keyword, both sides meet on
the rarest short character sequence that any match must share, and the substring test runs on those few candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.session import Steps, cut_lineage

GRAM = 3


def top_per(df: DataFrame, keys: list[str], order: list, n: int, rank: str = "rank") -> DataFrame:
    """First n rows of every key in a total order.  Spark trims to n per key in every task before it shuffles."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def _grams(c: Column) -> Column:
    def of(n: int) -> Column:
        return F.when(
            F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - (n - 1), F.lit(1))), lambda i: F.substring(c, i, n))
        ).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[of(n) for n in range(1, GRAM + 1)]))


def containing(texts: DataFrame, text: str, parts: DataFrame, part: str) -> DataFrame:
    """Distinct (text, part) pairs where the text contains the part, case ignored.

    A part is looked up by the rarest of its sequences of three characters (a shorter part by itself) among those of the
    texts.  Sequences travel with a hash of their text only and are kept only if some part has them; texts are fetched
    for the candidates that are left.
    """
    t = texts.select(text).distinct().select(F.xxhash64(text).alias("_id"), text, F.lower(text).alias("_t"))
    p = parts.select(part).distinct().select(part, F.lower(part).alias("_p")).filter(F.length("_p") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.length("_p") - (GRAM - 1), F.lit(1)))
    probes = p.select(part, "_p", F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring("_p", i, GRAM)))).alias("_g"))
    grams = t.select("_id", F.explode(_grams(F.col("_t"))).alias("_g")).join(probes.select("_g").distinct(), "_g", "left_semi")
    grams = cut_lineage(grams)
    counts = grams.groupBy("_g").agg(F.count("*").alias("_n"))
    rated = probes.join(counts, "_g", "left").groupBy(part, "_p").agg(
        F.min_by("_g", F.struct(F.coalesce("_n", F.lit(0)), "_g")).alias("_g")
    )
    pairs = rated.join(grams, "_g").select(part, "_p", "_id")
    return pairs.join(t, "_id").filter(F.col("_t").contains(F.col("_p"))).select(text, part)


# --- simple lookups ------------------------------------------------------------------------------------------------
def by_id(vertices: DataFrame, ids: DataFrame) -> DataFrame:
    return vertices.join(ids.select("id").distinct(), "id", "left_semi")


def search(vertices: DataFrame, name_part: str | None = None, kind: str | None = None, limit: int | None = None) -> DataFrame:
    """Vertices whose name contains a text (case matters) and/or of one type, in (name, id) order."""
    if name_part is not None:
        vertices = vertices.filter(F.col("name").contains(name_part))
    if kind is not None:
        vertices = vertices.filter(F.col("type") == kind)
    ordered = vertices.orderBy("name", "id")
    return ordered if limit is None else ordered.limit(limit)


def relations_of(ids: DataFrame, vertices: DataFrame, edges: DataFrame, direction: str = "both") -> DataFrame:
    """Edges at the given vertices with the vertex at the other end."""
    wanted = ids.select("id").distinct()
    other = vertices.select(F.col("id").alias("other_id"), F.col("name").alias("other_name"), F.col("type").alias("other_type"))
    out = edges.select(F.col("source_id").alias("id"), F.col("target_id").alias("other_id"), F.col("type").alias("relation"), F.lit("outgoing").alias("direction"))
    into = edges.select(F.col("target_id").alias("id"), F.col("source_id").alias("other_id"), F.col("type").alias("relation"), F.lit("incoming").alias("direction"))
    chosen = {"outgoing": out, "incoming": into, "both": out.unionByName(into)}[direction]
    return chosen.join(wanted, "id", "left_semi").join(other, "other_id")


def graph_stats(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Totals (NULL type) and counts per type with their share in percent, for vertices and edges."""
    both = vertices.select(F.lit("entity").alias("part"), "type").unionByName(edges.select(F.lit("relation").alias("part"), "type"))
    counts = both.groupBy("part", "type").agg(F.count("*").alias("n"))
    total = Window.partitionBy("part")
    shared = counts.withColumn("share", F.bround(F.col("n") * 100 / F.sum("n").over(total), 6))
    totals = counts.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.lit(None).cast("string").alias("type"), "n", F.lit(100.0).alias("share"))
    return shared.unionByName(totals)


def export_graph(vertices: DataFrame, edges: DataFrame, max_edges: int) -> DataFrame:
    """The first edges in key order with the names of both ends."""
    first = edges.orderBy("source_id", "type", "target_id").limit(max_edges)
    return _with_names(first, vertices)


def _with_names(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    s = vertices.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), F.col("type").alias("source_type"))
    t = vertices.select(F.col("id").alias("target_id"), F.col("name").alias("target_name"), F.col("type").alias("target_type"))
    return edges.join(s, "source_id").join(t, "target_id")


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def sampled_overview(vertices: DataFrame, edges: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n vertices in a seeded order and their outgoing edges; a vertex without edges keeps one row."""
    chosen = vertices.orderBy(F.md5(F.concat(F.col("id"), F.lit(f"|{seed}"))), "id").limit(n)
    out = edges.select("source_id", F.col("type").alias("relation"), "target_id")
    target = vertices.select(F.col("id").alias("target_id"), F.col("name").alias("target_name"))
    return chosen.select(F.col("id").alias("source_id"), F.col("name").alias("source_name")).join(out, "source_id", "left").join(target, "target_id", "left")


# --- paths ---------------------------------------------------------------------------------------------------------
class _Adjacency:
    """Both directions of all edges as a written table (vertex, next), and the few vertices with more than ``hub`` neighbours.

    The table is in ranges of both columns, so a hub lies in several of them and rows are small on disk and when they are
    dealt out.  The neighbours of a hub are dealt into parts where they are joined.
    """

    def __init__(self, steps: Steps, edges: DataFrame, hub: int):
        there, back = (F.col(c) for c in ("source_id", "target_id"))
        both = edges.select(F.explode(F.array(F.struct(there.alias("vertex"), back.alias("next")), F.struct(back.alias("vertex"), there.alias("next")))).alias("e"))
        key = ["vertex", "next"]
        self.rows = steps.cut(both.select("e.*").filter("vertex <> next").repartitionByRange(*key).sortWithinPartitions(*key).distinct())
        degrees = self.rows.groupBy("vertex").agg(F.ceil(F.count("*") / hub).cast("int").alias("parts"))
        self.hubs = steps.cut(degrees.filter("parts > 1"))

    def of(self, roots: DataFrame) -> DataFrame:
        """(root, next) for vertices that are roots: every neighbour is a row of its own."""
        return self.rows.withColumnRenamed("vertex", "root").join(roots, "root", "left_semi")

    def beyond(self, reached: DataFrame) -> DataFrame:
        """Reached vertices with all their neighbours."""
        parts = F.coalesce("parts", F.lit(1))
        dealt = self.rows.join(self.hubs, "vertex", "left").select("vertex", "next", F.pmod(F.xxhash64("next"), parts).cast("int").alias("salt"))
        fanned = reached.join(self.hubs, "vertex", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
        return fanned.join(dealt, ["vertex", "salt"])


class _Side:
    """One end's search: per depth a written table of first reaches (root, vertex, parent, above), without any path.

    The smallest paths of one depth are ordered by ``above``, the rank of the parent, then by the vertex.  Ranks are
    numbered only for a depth from which the search goes on, by a sort by ranges, so a root that reaches most of the graph
    is no single group.  The backward side needs no rank: its smallest way on from a vertex begins with the smallest
    neighbour that is nearer.
    """

    def __init__(self, steps: Steps, roots: DataFrame, adjacent: _Adjacency, forward: bool):
        self.steps, self.adjacent, self.forward = steps, adjacent, forward
        self.levels = [steps.cut(roots.select("root", F.col("root").alias("vertex"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("bigint").alias("above")))]

    @property
    def depth(self) -> int:
        return len(self.levels) - 1

    def frontier(self) -> DataFrame:
        return self.levels[-1].select("root", "vertex", "above")

    def _ranked(self, frontier: DataFrame) -> DataFrame:
        if not self.forward or not self.depth:
            return frontier.withColumnRenamed("above", "rank")
        order = ["root", "above", "vertex"]
        sorted_ = frontier.repartitionByRange(*order).sortWithinPartitions(*order)
        return self.steps.cut(sorted_.select("root", "vertex", F.monotonically_increasing_id().alias("rank")))

    def grow(self, wanted: DataFrame) -> bool:
        """One hop further for the wanted roots; False if nothing new was reached.

        New vertices are those of neither of the last two depths, since neighbours are at most one hop apart.  The first hop
        reaches every neighbour once, so nothing is compared.
        """
        if not self.depth:
            first = self.adjacent.of(wanted)
            self.levels.append(self.steps.cut(first.select("root", F.col("next").alias("vertex"), F.col("root").alias("parent"), F.lit(0).cast("bigint").alias("above"))))
            return not self.levels[-1].isEmpty()
        grown = self.adjacent.beyond(self._ranked(self.frontier().join(wanted, "root", "left_semi")))
        best = F.min(F.struct("rank", "vertex") if self.forward else F.struct("vertex", "rank")).alias("by")
        new = grown.groupBy("root", F.col("next").alias("reached")).agg(best)
        for level in self.levels[-2:]:
            new = new.join(level.select("root", F.col("vertex").alias("reached")), ["root", "reached"], "left_anti")
        new = new.select("root", F.col("reached").alias("vertex"), F.col("by.vertex").alias("parent"), F.col("by.rank").alias("above"))
        self.levels.append(self.steps.cut(new))
        return not self.levels[-1].isEmpty()

    def walk(self, found: DataFrame, root: str, hops: str) -> DataFrame:
        """Prolong ``path`` of met pairs from its outer vertex ``at`` by ``hops`` steps to the root, one join per depth but the first."""
        for depth in range(self.depth, 0, -1):
            step = self.levels[depth].select(F.col("root").alias(root), F.col("vertex").alias("at"), "parent")
            above = found.join(step, [root, "at"], "left") if depth > 1 else found.withColumn("parent", F.col(root))
            both = above.withColumn("parent", F.when(F.col(hops) >= depth, F.col("parent")))
            longer = F.concat(F.array("parent"), "path") if self.forward else F.concat("path", F.array("parent"))
            found = both.select(
                *[c for c in found.columns if c not in ("path", "at")], F.coalesce("parent", "at").alias("at"),
                F.when(F.col("parent").isNotNull(), longer).otherwise(F.col("path")).alias("path"),
            )
        return found


def _probes(steps: Steps, open_: DataFrame, a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Open pairs with the frontier of their source, or of their target where that is smaller; to be held against the other.

    Many pairs may share one end with a great frontier: only their smaller frontiers are written out.
    """
    n_a = a.groupBy("source_id").agg(F.count("*").alias("n_a"))
    n_b = b.groupBy("target_id").agg(F.count("*").alias("n_b"))
    sized = steps.cut(open_.join(n_a, "source_id").join(n_b, "target_id"))
    forward, backward = sized.filter("n_a <= n_b"), sized.filter("n_a > n_b")
    pair = ["source_id", "target_id"]
    return forward.select(*pair).join(a, "source_id"), backward.select(*pair).join(b, "target_id")


def shortest_paths(pairs: DataFrame, edges: DataFrame, max_length: int = 5, hub: int = 10_000) -> DataFrame:
    """Undirected shortest path of every (source_id, target_id) pair, at most ``max_length`` hops; the smallest among equals.

    Both ends search by turns and keep only predecessors.  After every hop the frontiers of the pairs still open are held
    against each other, beginning with the smaller one: pairs that meet get their paths by walking back and are retired, and roots without an open pair grow
    no further.  The neighbours of a vertex with more than ``hub`` of them are joined in parts.  Pairs out of reach are left out.
    """
    steps = Steps(pairs.sparkSession)
    adjacent = _Adjacency(steps, edges, hub)
    open_ = steps.cut(pairs.select("source_id", "target_id").filter("source_id IS NOT NULL AND target_id IS NOT NULL").distinct())
    ahead = _Side(steps, open_.select(F.col("source_id").alias("root")).distinct(), adjacent, True)
    back = _Side(steps, open_.select(F.col("target_id").alias("root")).distinct(), adjacent, False)
    met = None
    for length in range(max_length + 1):
        if length:
            side, end = (ahead, "source_id") if length % 2 else (back, "target_id")
            if not side.grow(open_.select(F.col(end).alias("root")).distinct()):
                break
        a = ahead.frontier().select(F.col("root").alias("source_id"), "vertex", "above")
        b = back.frontier().select(F.col("root").alias("target_id"), "vertex")
        by_a, by_b = _probes(steps, open_, a, b)
        now = by_a.join(b, ["target_id", "vertex"]).unionByName(by_b.join(a, ["source_id", "vertex"]))
        now = now.groupBy("source_id", "target_id").agg(F.min(F.struct("above", "vertex")).alias("m"))
        now = steps.cut(now.select("source_id", "target_id", F.lit(length).alias("length"), F.col("m.vertex").alias("middle")))
        met = now if met is None else met.unionByName(now)
        if now.isEmpty():
            continue
        open_ = steps.cut(open_.join(now, ["source_id", "target_id"], "left_anti"))
        if open_.isEmpty():
            break
    paths = met.withColumn("path", F.array("middle")).withColumn("at", F.col("middle"))
    paths = paths.withColumn("hops_back", F.floor(F.col("length") / 2)).withColumn("hops_ahead", F.col("length") - F.col("hops_back"))
    paths = ahead.walk(paths, "source_id", "hops_ahead").withColumn("at", F.col("middle"))
    paths = back.walk(paths, "target_id", "hops_back")
    return steps.keep(paths.select("source_id", "target_id", "length", "path"))


# --- keyword neighbourhoods -------------------------------------------------------------------------------------------
def keyword_hits(words: DataFrame, vertices: DataFrame, edges: DataFrame, n_entities: int = 5, n_relations: int = 10) -> DataFrame:
    """Per keyword the first entities whose name contains it and the first relations that leave such entities.

    Equal names share their matches, and each name contributes at most as many rows as a keyword can keep, so a name
    carried by a third of all vertices stays small.
    """
    pairs = containing(vertices, "name", words, "keyword")
    few = top_per(vertices.select("name", "id"), ["name"], ["id"], n_entities, "_r").drop("_r")
    entities = top_per(pairs.join(few, "name"), ["keyword"], ["name", "id"], n_entities)
    # only edges that leave a matched name count, and of those the first few per name
    near = vertices.join(pairs.select("name").distinct(), "name", "left_semi")
    out = edges.join(near.select(F.col("id").alias("source_id"), "name"), "source_id").join(
        vertices.select(F.col("id").alias("target_id"), F.col("name").alias("target_name")), "target_id"
    )
    order = ["name", "source_id", "type", "target_name", "target_id"]
    few_out = top_per(out, ["name"], order[1:], n_relations, "_r").drop("_r")
    relations = top_per(pairs.join(few_out, "name"), ["keyword"], order, n_relations)
    return entities.select("keyword", F.lit("entity").alias("kind"), "rank", F.col("name").alias("text")).unionByName(
        relations.select("keyword", F.lit("relation").alias("kind"), "rank", F.concat_ws(" ", "name", "type", "target_name").alias("text"))
    )


def keyword_summaries(questions: DataFrame, hits: DataFrame, id_col: str = "item_id", show: int = 5) -> DataFrame:
    """Per question (one row per keyword with its position) a short text of the first entities and relations found."""
    rows = questions.join(hits, "keyword")
    # at most keywords × (entities + relations) rows meet per question
    grouped = rows.groupBy(id_col).agg(
        *[
            F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("pos", "rank", "text")))).alias(kind)
            for kind in ("entity", "relation")
        ]
    )

    def text(kind: str, label: str, sep: str) -> Column:
        shown = F.transform(F.slice(kind, 1, show), lambda x: x["text"])
        return F.when(F.size(kind) > 0, F.concat(F.lit(label), F.array_join(shown, sep)))

    return grouped.select(
        id_col, F.size("entity").alias("entities"), F.size("relation").alias("relations"),
        F.concat_ws(". ", text("entity", "Entities: ", ", "), text("relation", "Relationships: ", "; ")).alias("summary"),
    )


def fuzzy_matches(terms: DataFrame, vertices: DataFrame, per_term: int = 10) -> DataFrame:
    """Per term the first entities whose name contains it, whose name it contains, or whose description contains it."""
    shapes = vertices.select("name", "description").distinct()
    by_name = containing(shapes, "name", terms, "term").unionByName(containing(terms, "term", shapes, "name").select("name", "term")).distinct()
    by_text = containing(shapes, "description", terms, "term")
    hit = shapes.join(by_name, "name").select("term", "name", "description").unionByName(shapes.join(by_text, "description").select("term", "name", "description"))
    few = top_per(vertices, ["name", "description"], ["id"], per_term, "_r").drop("_r")
    return top_per(hit.distinct().join(few, ["name", "description"]), ["term"], ["name", "id"], per_term)


def question_facts(question_terms: DataFrame, matches: DataFrame, id_col: str = "item_id") -> DataFrame:
    """Entities of each question, each name once: the first term that finds it counts."""
    rows = question_terms.join(matches, "term")
    return top_per(rows, [id_col, "name"], ["pos", "rank"], 1, "_one").drop("_one")


def fact_lines(entities: DataFrame, vertices: DataFrame, edges: DataFrame, shown: int = 10) -> DataFrame:
    """Each entity as a block of text: name, type, description and up to ten relations in both directions."""
    wanted = entities.select("id").distinct()
    rel = relations_of(wanted, vertices, edges).select("id", "direction", "relation", "other_name", "other_type").distinct()
    arrow = F.when(F.col("direction") == "incoming", "    ← ").otherwise("    → ")
    line = F.concat(arrow, F.col("relation"), F.lit(": "), F.col("other_name"), F.lit(" ("), F.col("other_type"), F.lit(")"))
    first = top_per(rel, ["id"], [F.desc("direction"), "relation", "other_name", "other_type"], shown)
    block = first.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("lines"))
    head = F.concat(F.lit("• "), F.col("name"), F.lit(" ("), F.col("type"), F.lit("):"))
    described = F.when(F.coalesce(F.col("description"), F.lit("")) != "", F.concat(F.lit("  Description: "), F.col("description")))
    lines = F.when(F.col("lines").isNotNull(), F.concat(F.lit("  Relationships:\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n")))
    return vertices.join(wanted, "id", "left_semi").join(block, "id", "left").select(
        "id", F.concat_ws("\n", head, described, F.coalesce(lines, F.lit("  (No relationships found in knowledge graph)"))).alias("fact")
    )


def hybrid_retrieve(contexts: DataFrame, entities: DataFrame, vertices: DataFrame, edges: DataFrame, question: str = "query_id", shown: int = 10) -> DataFrame:
    """The contexts of every question, each with ``graph_facts``: what the graph knows about the question's entities.

    ``entities`` holds (question, name, id), as from ``question_facts``; facts stand by name, an empty line apart, and are
    NULL for a question without entities.  A question's entities are few, since terms have a bounded number of matches.
    """
    lines = fact_lines(entities, vertices, edges, shown)
    known = entities.select(question, "name", "id").distinct().join(lines, "id")
    facts = known.groupBy(question).agg(F.array_sort(F.collect_list(F.struct("name", "id", "fact"))).alias("f"))
    return contexts.join(facts.select(question, F.array_join(F.transform("f", lambda x: x["fact"]), "\n\n").alias("graph_facts")), question, "left")


def question_subgraph(words: DataFrame, vertices: DataFrame, edges: DataFrame, id_col: str = "item_id", max_nodes: int = 20) -> DataFrame:
    """Nodes around each question: seeds whose name contains one of its words, then what the seeds point to, capped."""
    seeds_max = max_nodes // 2
    pairs = containing(vertices, "name", words, "keyword")
    names = words.join(pairs, "keyword").select(id_col, "name").distinct()
    few = top_per(vertices.select("name", "id"), ["name"], ["id"], seeds_max, "_r").drop("_r")
    seeds = top_per(names.join(few, "name"), [id_col], ["name", "id"], seeds_max, "seed_rank")
    # a seed can add at most max_nodes nodes, so only its first targets are needed
    out = edges.join(seeds.select(F.col("id").alias("source_id")).distinct(), "source_id", "left_semi")
    near = top_per(out.select("source_id", "target_id").distinct(), ["source_id"], ["target_id"], max_nodes, "target_rank")
    targets = seeds.select(id_col, "seed_rank", F.col("id").alias("source_id")).join(near, "source_id").select(
        id_col, "seed_rank", "target_rank", F.col("target_id").alias("id")
    )
    every = seeds.select(id_col, "seed_rank", F.lit(0).alias("target_rank"), "id").unionByName(targets)
    once = top_per(every, [id_col, "id"], ["seed_rank", "target_rank"], 1, "_one").drop("_one")
    return top_per(once, [id_col], ["seed_rank", "target_rank", "id"], max_nodes).select(id_col, "rank", "id")

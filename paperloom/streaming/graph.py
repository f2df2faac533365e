"""A graph that grows by micro-batches of extracted facts: vertices, edges and properties as versioned parts.

A fact is one row.  ``kind`` = 'entity': a mention with name, type, description, paper, confidence and, if any, prop_key and
prop_value.  ``kind`` = 'relation': (name, type) -relation-> (target_name, target_type) with description, paper, confidence.

Every batch reduces its own facts to mergeable parts (counts per entity and paper, best texts per entity, counts per
statement, the last value per property) and writes them as a version named by its number, so a batch that is tried again replaces its
own version.  Every ``compact`` batches a version holds the merged parts of all before it, and what no retry and no reader
needs any more is deleted.  A read merges ``compact`` versions at most:

* vertices are merged as in a batch run over all facts, whatever the order of arrival;
* an edge counts only while both of its ends are vertices; one whose end comes later waits among the pending ones;
* a property has the value of its latest batch (the greatest one within a batch).

``totals`` are the running totals after every batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import kg_build
from paperloom.session import cut_lineage, remove
from paperloom.streaming.jobs import each_batch

EDGE = ["source_id", "type", "target_id"]
STATEMENT = [*EDGE, "paper", "description"]
KEYS = {"vertices": ["entity_id", "type"], "edges": EDGE}


def _properties(rows: DataFrame) -> DataFrame:
    last = F.max(F.struct("version", "prop_value")).alias("last")
    return rows.groupBy("entity_id", "prop_key").agg(last).select("entity_id", "prop_key", "last.prop_value", "last.version")


def _statements(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*STATEMENT).agg(F.sum("mentions").alias("mentions"), F.max("confidence").alias("confidence"))


MERGE = {"vertices": kg_build.merge_entity_parts, "edges": _statements, "properties": _properties}


def parts_of(facts: DataFrame, version: int) -> dict[str, DataFrame]:
    """The mergeable parts of a batch of facts; names are resolved once for mentions and both ends of relations."""
    mentions = facts.filter("kind = 'entity'").select("name", "type", "description", "paper", "confidence", "prop_key", "prop_value")
    relations = facts.filter("kind = 'relation'")
    ends = [relations.select(F.col(n).alias("name"), F.col(t).alias("type")) for n, t in (("name", "type"), ("target_name", "target_type"))]
    ids = kg_build.named_ids(mentions.select("name", "type").unionByName(ends[0]).unionByName(ends[1]))
    keyed = mentions.join(ids, ["name", "type"])
    source = ids.select("name", "type", F.col("entity_id").alias("source_id"))
    target = ids.select(F.col("name").alias("target_name"), F.col("type").alias("target_type"), F.col("entity_id").alias("target_id"))
    linked = relations.join(source, ["name", "type"]).join(target, ["target_name", "target_type"])
    edges = linked.select("source_id", F.col("relation").alias("type"), "target_id", "paper", "description", "confidence", F.lit(1).cast("bigint").alias("mentions"))
    values = keyed.filter("prop_key IS NOT NULL").select("entity_id", "prop_key", "prop_value", F.lit(version).cast("bigint").alias("version"))
    return {"vertices": kg_build.keyed_entity_parts(keyed), "edges": _statements(edges), "properties": _properties(values)}


def _base(version: int, compact: int) -> int:
    return version - version % compact


def _since(spark: SparkSession, target: str, kind: str, version: int, compact: int) -> DataFrame:
    return spark.read.parquet(*[f"{target}/{kind}/batch={n}" for n in range(_base(version, compact), version + 1)])


def upsert_graph(facts: DataFrame, target: str, compact: int = 8) -> None:
    """Bring the stored graph up to the stream's current end."""
    spark = facts.sparkSession

    def write(batch: DataFrame, version: int) -> None:
        batch = cut_lineage(batch)
        parts = parts_of(batch, version)
        counts = {"entity": 0, "relation": 0, **{r["kind"]: r["count"] for r in batch.groupBy("kind").count().collect()}}
        total = {"mentions": counts["entity"], "relations": counts["relation"], "vertices": 0, "edges": 0}
        if version:
            for name, value in spark.read.parquet(f"{target}/totals/batch={version - 1}").first().asDict().items():
                total[name] += value
        for kind, part in parts.items():
            part = cut_lineage(part)
            if kind in KEYS:
                new = part.select(*KEYS[kind]).distinct()
                if version:
                    new = new.join(_since(spark, target, kind, version - 1, compact).select(*KEYS[kind]), KEYS[kind], "left_anti")
                total[kind] += new.count()
            if version and version % compact == 0:
                part = MERGE[kind](_since(spark, target, kind, version - 1, compact).unionByName(part))
            part.write.mode("overwrite").parquet(f"{target}/{kind}/batch={version}")
        # written last: a reader goes by the latest totals
        spark.createDataFrame([tuple(total.values())], ", ".join(f"{c} long" for c in total)).coalesce(1).write.mode("overwrite").parquet(f"{target}/totals/batch={version}")
        # the retry of this batch reads from the base of the one before; nothing reads what lies before that base
        first = _base(max(version - 1, 0), compact)
        for kind in MERGE:
            for n in range(max(0, first - compact), first):
                remove(spark, f"{target}/{kind}/batch={n}")

    each_batch(facts, target, write)


def totals(spark: SparkSession, target: str) -> DataFrame:
    """(batch, mentions, relations, vertices, edges): running totals; edges waiting for an end are included."""
    return spark.read.parquet(f"{target}/totals")


def _state(spark: SparkSession, target: str, kind: str, compact: int) -> DataFrame:
    last = totals(spark, target).agg(F.max("batch")).first()[0]
    return MERGE[kind](_since(spark, target, kind, last, compact))


def vertices(spark: SparkSession, target: str, compact: int = 8) -> DataFrame:
    return kg_build.entities_of_parts(_state(spark, target, "vertices", compact))


def edges(spark: SparkSession, target: str, compact: int = 8) -> DataFrame:
    """The edges with both ends among the vertices."""
    found = kg_build.relations_of_statements(_state(spark, target, "edges", compact))
    ids = _state(spark, target, "vertices", compact).select("entity_id").distinct()
    for end in ("source_id", "target_id"):
        found = found.join(ids.withColumnRenamed("entity_id", end), end, "left_semi")
    return found


def pending_edges(spark: SparkSession, target: str, compact: int = 8) -> DataFrame:
    """The edges that wait for an end."""
    found = kg_build.relations_of_statements(_state(spark, target, "edges", compact))
    ready = edges(spark, target, compact).select(*EDGE)
    return found.join(ready, EDGE, "left_anti")


def properties(spark: SparkSession, target: str, compact: int = 8) -> DataFrame:
    return _state(spark, target, "properties", compact).drop("version")

"""Context sources run side by side over the questions that need them.

A source is a function from a question table to a context table.  Each runs over its own questions only and is written as
a step of its own, so a source that fails, while its plan is made or while it runs, costs nobody else's contexts: its
questions get the reason instead.  A source may also fail for single questions: rows whose ``<content>_error`` (or
``error``) is set count as failures of their question.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.operators.hooks import ContextSource
from paperloom.session import cut_lineage

#: What every context has; a source that lacks a column gives NULL.
COLUMNS = {"content": "string", "title": "string", "url": "string", "similarity": "double"}


@dataclass(frozen=True)
class Source:
    """A named source, the questions that need it (all, if not said) and its names for the common columns."""

    name: str
    fetch: ContextSource
    needs: Column | None = None
    columns: dict[str, str] = field(default_factory=dict)
    error: str = "error"


class Registry:
    """Sources by name; registering a name again replaces it."""

    def __init__(self, *sources: Source):
        self.sources = {s.name: s for s in sources}

    def register(self, source: Source) -> None:
        self.sources[source.name] = source

    def remove(self, name: str) -> None:
        self.sources.pop(name, None)

    def gather(self, questions: DataFrame, query_id: str = "query_id") -> tuple[DataFrame, DataFrame]:
        """(contexts, outcomes): the contexts of all sources with aligned columns, and one row per question and source.

        Contexts are (query_id, source, content, title, url, similarity).  Outcomes are (query_id, source, outcome, results,
        reason); outcome is found, empty or failed.
        """
        spark = questions.sparkSession
        kind = questions.schema[query_id].dataType.simpleString()
        contexts = spark.createDataFrame([], f"{query_id} {kind}, source string, " + ", ".join(f"{c} {t}" for c, t in COLUMNS.items()))
        outcomes = spark.createDataFrame([], f"{query_id} {kind}, source string, outcome string, results long, reason string")
        for source in self.sources.values():
            asked = questions if source.needs is None else questions.filter(source.needs)
            try:
                rows = cut_lineage(_aligned(source, source.fetch(asked), query_id))
            except Exception as e:  # whatever the source or its tasks raise
                reason = F.lit(f"{type(e).__name__}: {_first_line(e)}")
                outcomes = outcomes.unionByName(_outcome(asked.select(query_id), source, "failed", F.lit(0), reason))
                continue
            contexts = contexts.unionByName(rows.filter("reason IS NULL").drop("reason"))
            counts = rows.groupBy(query_id).agg(F.count_if(F.col("reason").isNull()).alias("results"), F.min("reason").alias("reason"))
            done = asked.select(query_id).join(counts, query_id, "left")
            state = F.when(F.col("results") > 0, "found").when(F.col("reason").isNotNull(), "failed").otherwise("empty")
            outcomes = outcomes.unionByName(_outcome(done, source, state, F.coalesce("results", F.lit(0)), F.col("reason")))
        return contexts, outcomes


def _first_line(e: Exception) -> str:
    """The message's last line that is no trace: for an error in a task, what the source's function raised."""
    lines = [x.strip() for x in str(e).splitlines() if x.strip() and not x.lstrip().startswith(("at ", "File ", "JVM stacktrace"))]
    raised = [x for x in lines if x.split(":")[0].replace(".", "").isidentifier() and x.split(":")[0].endswith(("Error", "Exception", "Timeout"))]
    return (raised or lines or [""])[-1]


def _outcome(rows: DataFrame, source: Source, outcome, results: Column, reason: Column) -> DataFrame:
    state = F.lit(outcome) if isinstance(outcome, str) else outcome
    return rows.select(rows.columns[0], F.lit(source.name).alias("source"), state.alias("outcome"), results.cast("bigint").alias("results"), reason.alias("reason"))


def _aligned(source: Source, found: DataFrame, query_id: str) -> DataFrame:
    names = {c: source.columns.get(c, c) for c in COLUMNS}
    if missing := [n for n in (query_id, names["content"]) if n not in found.columns]:
        raise ValueError(f"source {source.name} gives no {', '.join(missing)}")
    error = F.col(source.error) if source.error in found.columns else F.lit(None)
    return found.select(
        query_id, F.lit(source.name).alias("source"), *[(F.col(n) if n in found.columns else F.lit(None)).cast(COLUMNS[c]).alias(c) for c, n in names.items()],
        error.cast("string").alias("reason"),
    )

"""Comparisons across modes, models and categories of one long or wide score table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom import vocab as v
from paperloom.functions.scores import no_nan, stable_round
from paperloom.operators.evalscores import has_error, long_scores, metric_means, row_mean
from paperloom.session import cut_lineage

WITH, WITHOUT = "agentic_with_kg", "agentic_no_kg"


def paired_classes(runs: DataFrame, metric: str = "answer_correctness", threshold: float = v.CORRECTNESS_THRESHOLD) -> DataFrame:
    """Each answer with graph against the one without: not worse (c1), above the threshold (c2), both, or neither (dropped).

    Answers without a score on the left are dropped; a missing right side fails c1.
    """
    key = ["model", "category", "question_id"]
    a = runs.filter(F.col("mode") == WITH).select(*key, no_nan(F.col(metric)).alias("with_score")).filter(F.col("with_score").isNotNull())
    b = runs.filter(F.col("mode") == WITHOUT).select(*key, no_nan(F.col(metric)).alias("without_score"))
    c1, c2 = F.coalesce(F.col("with_score") >= F.col("without_score"), F.lit(False)), F.col("with_score") > threshold
    label = F.when(c1 & c2, "both").when(c1, "only_c1").when(c2, "only_c2")
    joined = a.join(b, key, "left").withColumn("diff", F.col("with_score") - F.col("without_score"))
    return joined.withColumn("class", label).filter(F.col("class").isNotNull())


def class_counts(classes: DataFrame) -> DataFrame:
    """Counts by category (NULL = all) and class."""
    return classes.rollup("category").agg(
        *[F.count_if(F.col("class") == c).alias(c) for c in ("both", "only_c1", "only_c2")], F.count("*").alias("total")
    )


def high_scores(classes: DataFrame) -> DataFrame:
    return classes.filter(F.col("class").isin("both", "only_c2"))


def on_kept_questions(runs: DataFrame, keep: DataFrame, by: list[str]) -> DataFrame:
    """Metric means over the kept (question_id) rows, with how many rows were left out."""
    marked = runs.join(keep.select("question_id").distinct().withColumn("_keep", F.lit(True)), "question_id", "left")
    kept = F.coalesce("_keep", F.lit(False))
    ok = kept & ~has_error()
    return marked.groupBy(*by).agg(
        F.count_if(kept).alias("kept"), F.count_if(~kept).alias("removed"), *[F.avg(F.when(ok, no_nan(F.col(m)))).alias(m) for m in v.METRICS]
    )


def model_overlap(members: DataFrame) -> DataFrame:
    """Per pair of models and class: questions in common, only in the first, only in the second.

    A question meets the models that hold it; the number of models, not of questions, bounds these pairs.
    """
    m = members.select("model", "class", "question_id").distinct()
    sizes = m.groupBy("class", "model").agg(F.count("*").alias("n"))
    other = m.select(F.col("model").alias("model_2"), "class", "question_id")
    common = m.join(other, ["class", "question_id"]).filter(F.col("model") < F.col("model_2")).groupBy("class", "model", "model_2").agg(F.count("*").alias("common"))
    a = sizes.select("class", F.col("model").alias("model_1"), F.col("n").alias("n_1"))
    b = sizes.select("class", F.col("model").alias("model_2"), F.col("n").alias("n_2"))
    pairs = a.join(b, "class").filter(F.col("model_1") < F.col("model_2"))
    full = pairs.join(common.withColumnRenamed("model", "model_1"), ["class", "model_1", "model_2"], "left").fillna({"common": 0})
    return full.select("class", "model_1", "model_2", "common", (F.col("n_1") - F.col("common")).alias("only_1"), (F.col("n_2") - F.col("common")).alias("only_2"))


def common_to_all(members: DataFrame, by_class: bool = True) -> DataFrame:
    """Questions that every model holds, per class or in any class."""
    n_models = members.select("model").distinct().count()
    key = (["class"] if by_class else []) + ["question_id"]
    return members.groupBy(*key).agg(F.count_distinct("model").alias("models")).filter(F.col("models") == n_models).select(*key)


def appearance_frequency(members: DataFrame) -> DataFrame:
    per_question = members.groupBy("question_id").agg(F.count_distinct("model").alias("models"))
    return per_question.groupBy("models").agg(F.count("*").alias("questions"))


def selected_by(members: DataFrame, min_models: int) -> DataFrame:
    return members.groupBy("question_id").agg(F.count_distinct("model").alias("models")).filter(F.col("models") >= min_models)


def category_distribution(questions: DataFrame, category: str = "category") -> DataFrame:
    """Counts and shares in percent; questions without a category are counted as unknown."""
    counts = questions.groupBy(F.coalesce(category, F.lit("unknown")).alias("category")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.bround(F.col("n") * 100 / F.sum("n").over(Window.partitionBy()), 6))


def crosstab(questions: DataFrame, row: str = "difficulty", column: str = "reasoning") -> DataFrame:
    """Counts by both labels with row, column and grand totals (NULL = all)."""
    return questions.cube(row, column).agg(F.count("*").alias("n"))


def first_category(runs: DataFrame) -> DataFrame:
    """Category of each question as the first model (in name order) states it."""
    return runs.filter(F.col("category").isNotNull()).groupBy("question_id").agg(F.min_by("category", F.struct("model", "mode", "category")).alias("category"))


def weighted_means(summary: DataFrame, weight: Column | None = None, metrics: list[str] = v.METRICS) -> DataFrame:
    """Per model and mode over categories, each category counting by its weight (1 unless given)."""
    w = weight if weight is not None else F.lit(1.0)
    return summary.groupBy("model", "mode").agg(
        *[(F.sum(F.col(m) * w) / F.sum(F.when(F.col(m).isNotNull(), w))).alias(m) for m in metrics]
    )


def category_summary(runs: DataFrame, digits: int = 4) -> DataFrame:
    """Per model, category and mode: questions, questions without a zero, their rate, rounded metric means."""
    zero = F.coalesce(F.greatest(*[(F.col(m) == 0).cast("int") for m in v.METRICS]), F.lit(0)) == 1
    out = runs.groupBy("model", "category", "mode").agg(
        F.count("*").alias("total_qas"), F.count_if(~zero).alias("nonzero_qas"), *[stable_round(F.avg(F.when(~has_error(), no_nan(F.col(m)))), digits).alias(m) for m in v.METRICS]
    )
    return out.withColumn("nonzero_rate", F.bround(F.col("nonzero_qas") * 100 / F.col("total_qas"), 2))


def means_on_common(runs: DataFrame, questions: DataFrame, category: str | None = None) -> DataFrame:
    chosen = runs if category is None else runs.filter(F.col("category") == category)
    return metric_means(chosen.join(questions.select("question_id").distinct(), "question_id", "left_semi"))


def model_matrix(means: DataFrame, mode: str) -> DataFrame:
    """Models by metrics for one mode, best correctness first."""
    rows = means.filter(F.col("mode") == mode).select("model", *v.METRICS)
    return rows.withColumn("position", F.row_number().over(Window.orderBy(F.desc_nulls_last("answer_correctness"), "model")))


def improvements(means: DataFrame, metric: str = "answer_correctness") -> DataFrame:
    """Gains in points between modes, models in order of their score with graph."""
    p = means.groupBy("model").pivot("mode", v.MODES).agg(F.max(metric))

    def gain(a: str, b: str) -> Column:
        return F.bround((F.col(a) - F.col(b)) * 100, 6)

    order = Window.orderBy(F.desc_nulls_last(WITH), "model")
    return p.select(
        "model", gain(WITH, WITHOUT).alias("graph_gain"), gain(WITHOUT, "direct_llm").alias("vector_gain"), gain(WITH, "direct_llm").alias("total_gain"),
        F.row_number().over(order).alias("position"),
    )


def ranking(means: DataFrame) -> DataFrame:
    """Per mode: models by correctness, with the mean of their positive metrics."""
    positive = [F.when(F.col(m) > 0, F.col(m)) for m in v.METRICS]
    kept = F.filter(F.array(*positive), lambda x: x.isNotNull())
    avg = F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda a, x: a + x) / F.size(kept)).otherwise(0.0)
    w = Window.partitionBy("mode").orderBy(F.desc_nulls_last("answer_correctness"), "model")
    return means.select("mode", "model", F.row_number().over(w).alias("position"), F.col("answer_correctness").alias("correctness"), avg.alias("positive_mean"))


def ranking_all_modes(means: DataFrame) -> DataFrame:
    """Every model and mode with a positive score in one list."""
    w = Window.orderBy(F.desc("answer_correctness"), "model", "mode")
    return means.filter(F.col("answer_correctness") > 0).select("model", "mode", F.col("answer_correctness").alias("correctness"), F.row_number().over(w).alias("position"))


def with_data(runs: DataFrame) -> DataFrame:
    """Model, category and mode combinations in which some metric is positive."""
    best = F.greatest(*[F.max(m) for m in v.METRICS])
    return runs.groupBy("model", "category", "mode").agg(best.alias("best")).filter(F.col("best") > 0).select("model", "category", "mode")


def zero_details(runs: DataFrame) -> DataFrame:
    """Every score that is exactly 0."""
    return long_scores(runs, keep=["model", "category", "mode", "question_id"]).filter(F.col("value") == 0).drop("value")


def zero_rollups(zeros: DataFrame) -> DataFrame:
    """Zero counts by mode, category and metric; recomputed from the details, so running twice changes nothing."""
    return zeros.groupingSets([["mode"], ["category"], ["metric"], []], "mode", "category", "metric").agg(F.count("*").alias("zeros"), F.count_distinct("question_id").alias("questions"))


def _bin_of(x: Column, cuts: Column, bins: int) -> Column:
    """How many of the sorted cut points lie below x: first among every ``width``-th of them, then among the next ``width``."""
    width = max(1, int(bins**0.5))
    marks = [i for i in range(width - 1, bins - 1, width)]
    coarse = F.size(F.filter(F.array(*[F.get(cuts, F.lit(i)) for i in marks]), lambda c: c < x)) if marks else F.lit(0)
    return coarse * width + F.size(F.filter(F.slice(cuts, coarse * width + 1, F.lit(width)), lambda c: c < x))


def _binned(hist: DataFrame, by: list[str], bins: int, *more: Column) -> tuple[DataFrame, DataFrame]:
    """(groups, binned): per group the number of values and ``more``; the histogram with the bin of every value, written once."""
    cuts = F.percentile_approx("x", [i / bins for i in range(1, bins)], 20 * bins).alias("_cuts")
    groups = cut_lineage(hist.groupBy(*by).agg(cuts, F.sum("n").alias("_total"), *more))
    binned = hist.join(groups.select(*by, "_cuts", "_total"), by)
    return groups.drop("_cuts"), cut_lineage(binned.withColumn("_bin", _bin_of(F.col("x"), F.col("_cuts"), bins)).drop("_cuts"))


def _quantiles(binned: DataFrame, by: list[str], shares: tuple[float, ...]) -> DataFrame:
    per_bin = binned.groupBy(*by, "_total", "_bin").agg(F.sum("n").alias("_in"))
    upto = F.sum("_in").over(Window.partitionBy(*by).orderBy("_bin"))
    places = F.array(*[F.lit(q) * (F.col("_total") - 1) for q in shares])
    ranks = F.array_distinct(F.flatten(F.transform(places, lambda h: F.array(F.floor(h), F.ceil(h)))))
    spots = per_bin.withColumn("_before", upto - F.col("_in")).withColumn(
        "_ranks", F.filter(ranks, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_in")))
    ).filter(F.size("_ranks") > 0).select(*by, "_bin", "_before", "_ranks")
    run = F.sum("n").over(Window.partitionBy(*by, "_bin").orderBy("x"))
    picked = binned.join(spots, [*by, "_bin"]).withColumn("_end", F.col("_before") + run).withColumn(
        "_rank", F.explode(F.filter("_ranks", lambda r: (r < F.col("_end")) & (r >= F.col("_end") - F.col("n"))))
    )
    found = picked.groupBy(*by, "_total").agg(F.map_from_entries(F.collect_list(F.struct("_rank", "x"))).alias("_at"))

    def linear(h: Column) -> Column:
        low, high = F.element_at("_at", F.floor(h)), F.element_at("_at", F.ceil(h))
        return low + (high - low) * (h - F.floor(h))

    return found.select(*by, F.transform(places, linear).alias("quantiles"))


def exact_quantiles(hist: DataFrame, by: list[str], shares: tuple[float, ...], bins: int = 256) -> DataFrame:
    """(by, quantiles): linear quantiles of a histogram (by, x, n).

    Values are dealt into bins by approximate cut points; counts per bin tell in which bins the wanted ranks lie, and only
    the values of those are numbered.  So no task holds or sorts all values of a group.
    """
    return _quantiles(_binned(hist, by, bins)[1], by, shares)


def box_stats(df: DataFrame, value: str, by: list[str], bins: int = 256) -> DataFrame:
    """Quartiles (linear), mean and outliers beyond 1.5 interquartile ranges; NULL counts as 0.

    Equal values are counted first; the exact quartiles are then picked from that histogram by rank.
    """
    hist = df.groupBy(*by, F.coalesce(no_nan(F.col(value).cast("double")), F.lit(0.0)).alias("x")).agg(F.count("*").alias("n"))
    mean = (F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("mean")
    groups, binned = _binned(cut_lineage(hist), by, bins, mean, F.min("x").alias("low"), F.max("x").alias("high"))
    q = groups.join(_quantiles(binned, by, (0.25, 0.5, 0.75)).withColumnRenamed("quantiles", "q"), by).select(
        *by, F.col("_total").alias("values"), "low", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "high", F.bround("mean", 6).alias("mean")
    )
    q = cut_lineage(q)  # one row per group
    iqr = F.col("q3") - F.col("q1")
    out = (F.col("x") < F.col("q1") - iqr * 1.5) | (F.col("x") > F.col("q3") + iqr * 1.5)
    outliers = binned.join(q.select(*by, "q1", "q3"), by).groupBy(*by).agg(F.sum(F.when(out, F.col("n")).otherwise(0)).alias("outliers"))
    return q.join(outliers, by)


def category_table(runs: DataFrame, digits: int = 4) -> DataFrame:
    """Per category and mode over all models: correctness and rate of questions without zeros, modes in fixed order."""
    order = F.when(F.col("mode") == v.MODES[0], 0).when(F.col("mode") == v.MODES[1], 1).otherwise(2)
    s = category_summary(runs.withColumn("model", F.lit("all")), digits)
    return s.select("category", "mode", order.alias("mode_order"), F.col("answer_correctness").alias("correctness"), "nonzero_rate")


def breakdown(
    records: DataFrame, dimensions: tuple[str, ...] = ("category", "difficulty", "reasoning"), value: str = "avg_correctness",
    threshold: float = v.BREAKDOWN_THRESHOLD, metric: str = "answer_correctness",
) -> DataFrame:
    """Method × dimension × model × group: count, correct count and rate, mean; groups and series best first."""
    method = F.coalesce(*[F.when(F.col("mode") == m, F.lit(label)) for m, label in v.MODE_LABELS.items()], F.col("mode"))
    dims = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("group")) for d in dimensions])
    rows = records.filter(F.col(metric).isNotNull()).select(method.alias("method"), "model", F.col(metric).alias("_x"), F.explode(dims).alias("d")).select("method", "model", "_x", "d.*")
    correct = F.col("_x") >= threshold

    def measures() -> list[Column]:
        return [
            F.count("*").alias("count"), F.count_if(correct).alias("correct_count"), F.avg(correct.cast("double")).alias("correct_rate"), F.avg("_x").alias("avg_correctness")
        ]

    cells = rows.groupBy("method", "dimension", "model", "group").agg(*measures())
    groups = rows.groupBy("method", "dimension", "group").agg(*measures()).select("method", "dimension", "group", F.bround(value, 9).alias("_g"))
    series = rows.groupBy("method", "dimension", "model").agg(*measures()).select("method", "dimension", "model", F.bround(value, 9).alias("_s"))
    wide = cells.join(groups, ["method", "dimension", "group"]).join(series, ["method", "dimension", "model"])
    part = Window.partitionBy("method", "dimension")
    return wide.select(
        "method", "dimension", F.concat(F.col("model"), F.lit(" ("), F.replace("method", F.lit("_"), F.lit(" ")), F.lit(")")).alias("series_label"), "group",
        F.bround(value, 6).alias("value"), "count", "correct_count", F.bround("correct_rate", 6).alias("correct_rate"), F.bround("avg_correctness", 6).alias("avg_correctness"),
        F.dense_rank().over(part.orderBy(F.desc("_g"), "group")).alias("group_order"), F.dense_rank().over(part.orderBy(F.desc("_s"), "model")).alias("series_order"),
    )

"""Comparisons across modes, models and categories."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom import vocab as v
from paperloom.operators import evalcompare as ec
from paperloom.operators import evalscores as ev
from paperloom.plans import inputs
from paperloom.plans.registry import query
from paperloom.plans.score_queries import MEANS, means_sql, row_mean_sql
from paperloom.plans.sqlkit import s, with_inputs
from paperloom.sources.readers import table

M = v.METRICS
_CLASSES = """SELECT * FROM (SELECT model, category, question_id, a.x AS with_score, b.x AS without_score, a.x - b.x AS diff, CASE WHEN coalesce(a.x >= b.x, false) AND a.x > 0.4 THEN 'both'
    WHEN coalesce(a.x >= b.x, false) THEN 'only_c1' WHEN a.x > 0.4 THEN 'only_c2' END AS class FROM (SELECT model, category, question_id, answer_correctness AS x FROM eval_runs WHERE mode = 'agentic_with_kg') a
    LEFT JOIN (SELECT model, category, question_id, answer_correctness AS x FROM eval_runs WHERE mode = 'agentic_no_kg') b USING (model, category, question_id) WHERE a.x IS NOT NULL) WHERE class IS NOT NULL"""


def _sql(text: str, **extra: str) -> str:
    return with_inputs(text, classes=_CLASSES, means=MEANS, **extra)


def _classes(spark, sf):
    return ec.paired_classes(inputs.eval_runs(spark, sf))


def _means(spark, sf):
    return ev.metric_means(inputs.eval_runs(spark, sf))


@query("m1_paired_classes", _sql("SELECT model, category, question_id, with_score, without_score, round(diff, 6) AS diff, class FROM classes"))
def _(spark, sf):
    return _classes(spark, sf).withColumn("diff", F.round("diff", 6))


@query(
    "m2_class_counts",
    _sql("SELECT category, count(*) FILTER (WHERE class = 'both') AS both, count(*) FILTER (WHERE class = 'only_c1') AS only_c1, count(*) FILTER (WHERE class = 'only_c2') AS only_c2, count(*) AS total FROM classes GROUP BY ROLLUP(category)".replace("AS both", 'AS "both"')),
)
def _(spark, sf):
    return ec.class_counts(_classes(spark, sf))


@query("m3_high_scores", _sql("SELECT model, category, question_id, with_score FROM classes WHERE class IN ('both', 'only_c2')"))
def _(spark, sf):
    return ec.high_scores(_classes(spark, sf)).select("model", "category", "question_id", "with_score")


_KEPT = "SELECT DISTINCT question_id FROM classes WHERE class IN ('both', 'only_c2')"


@query(
    "m4_kept_questions",
    _sql(
        f"""SELECT model, mode, count(*) FILTER (WHERE k) AS kept, count(*) FILTER (WHERE NOT k) AS removed, {', '.join(f'round(avg({m}) FILTER (WHERE k AND error IS NULL), 9) AS {m}' for m in M)} FROM
        (SELECT *, question_id IN (SELECT question_id FROM kept) AS k FROM eval_runs) GROUP BY model, mode""", kept=_KEPT,
    ),
)
def _(spark, sf):
    out = ec.on_kept_questions(inputs.eval_runs(spark, sf), ec.high_scores(_classes(spark, sf)), ["model", "mode"])
    return out.select("model", "mode", "kept", "removed", *[F.round(m, 9).alias(m) for m in M])


@query(
    "m5_model_overlap",
    _sql(
        """SELECT a.class, a.model AS model_1, b.model AS model_2, (SELECT count(*) FROM classes x JOIN classes y USING (class, question_id) WHERE x.class = a.class AND x.model = a.model AND y.model = b.model) AS common,
        a.n - (SELECT count(*) FROM classes x JOIN classes y USING (class, question_id) WHERE x.class = a.class AND x.model = a.model AND y.model = b.model) AS only_1,
        b.n - (SELECT count(*) FROM classes x JOIN classes y USING (class, question_id) WHERE x.class = a.class AND x.model = a.model AND y.model = b.model) AS only_2
        FROM (SELECT class, model, count(*) AS n FROM classes GROUP BY ALL) a JOIN (SELECT class, model, count(*) AS n FROM classes GROUP BY ALL) b ON a.class = b.class AND a.model < b.model"""
    ),
)
def _(spark, sf):
    return ec.model_overlap(_classes(spark, sf))


_ALL = "(SELECT count(DISTINCT model) FROM classes)"


@query(
    "m6_common_to_all",
    _sql(f"SELECT class, question_id FROM classes GROUP BY ALL HAVING count(DISTINCT model) = {_ALL} UNION ALL SELECT 'any', question_id FROM classes GROUP BY question_id HAVING count(DISTINCT model) = {_ALL}"),
)
def _(spark, sf):
    c = _classes(spark, sf)
    return ec.common_to_all(c).unionByName(ec.common_to_all(c, False).withColumn("class", F.lit("any")))


@query("m7_appearance_frequency", _sql("SELECT models, count(*) AS questions FROM (SELECT question_id, count(DISTINCT model) AS models FROM classes GROUP BY question_id) GROUP BY models"))
def _(spark, sf):
    return ec.appearance_frequency(_classes(spark, sf))


def _question_labels(spark, sf):
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"))
    return q.select("question_id", *[c.alias(n) for n, c in inputs._labels(F.col("question_id")).items()])


@query(
    "m8_category_distribution",
    f"""SELECT category, count(*) AS n, round_even(count(*) * 100 / sum(count(*)) OVER (), 6) AS share FROM (SELECT CASE WHEN item_id % 10 = 9 THEN 'unknown' ELSE
    CASE item_id % 8 {' '.join(f"WHEN {i} THEN {s(c)}" for i, c in enumerate(v.QA_CATEGORIES))} END END AS category FROM benchmark) GROUP BY category""",
)
def _(spark, sf):
    q = _question_labels(spark, sf).withColumn("category", F.when(F.col("question_id") % 10 != 9, F.col("category")))
    return ec.category_distribution(q)


@query(
    "m9_crosstab",
    "SELECT ['easy', 'medium', 'hard'][1 + item_id % 3] AS difficulty, ['single-hop', 'multi-hop'][1 + item_id % 2] AS reasoning, count(*) AS n FROM benchmark GROUP BY CUBE (['easy', 'medium', 'hard'][1 + item_id % 3], ['single-hop', 'multi-hop'][1 + item_id % 2])",
)
def _(spark, sf):
    return ec.crosstab(_question_labels(spark, sf))


@query("m10_selected_by", _sql("SELECT question_id, count(DISTINCT model) AS models FROM classes GROUP BY question_id HAVING count(DISTINCT model) >= 3"))
def _(spark, sf):
    return ec.selected_by(_classes(spark, sf), 3)


@query(
    "m11_first_category",
    with_inputs("SELECT question_id, CASE WHEN model = 'model_a' THEN category ELSE 'other' END AS category FROM (SELECT question_id, arg_min(category, (model, mode)) AS category, min(model) AS model FROM eval_runs WHERE NOT (model = 'model_a' AND question_id % 4 = 0) GROUP BY question_id)"),
)
def _(spark, sf):
    missing = (F.col("model") == "model_a") & (F.col("question_id") % 4 == 0)
    r = inputs.eval_runs(spark, sf)
    stated = F.when(F.col("model") == "model_a", F.col("category")).otherwise("other")
    return ec.first_category(r.withColumn("category", F.when(~missing, stated)))


_ZERO = "(" + " OR ".join(f"coalesce({m} = 0, false)" for m in M) + ")"
_CATEGORY = f"""SELECT model, category, mode, count(*) AS total_qas, count(*) FILTER (WHERE NOT {_ZERO}) AS nonzero_qas, {', '.join(f'round(avg({m}) FILTER (WHERE error IS NULL), 9) AS {m}' for m in M)},
    round_even(count(*) FILTER (WHERE NOT {_ZERO}) * 100 / count(*), 2) AS nonzero_rate FROM eval_runs GROUP BY model, category, mode"""


@query("m18_category_summary", with_inputs("SELECT * FROM catsum", catsum=_CATEGORY))
def _(spark, sf):
    return ec.category_summary(inputs.eval_runs(spark, sf), 9)


@query(
    "m12_weighted_means",
    with_inputs(f"SELECT model, mode, {', '.join(f'round(sum({m} * total_qas) / sum(total_qas) FILTER (WHERE {m} IS NOT NULL), 7) AS {m}' for m in M)} FROM catsum GROUP BY model, mode", catsum=_CATEGORY),
)
def _(spark, sf):
    w = ec.weighted_means(ec.category_summary(inputs.eval_runs(spark, sf), 9), F.col("total_qas"))
    return w.select("model", "mode", *[F.round(m, 7).alias(m) for m in M])


@query("m12_unweighted_means", with_inputs(f"SELECT model, mode, {', '.join(f'round(avg({m}), 7) AS {m}' for m in M)} FROM catsum GROUP BY model, mode", catsum=_CATEGORY))
def _(spark, sf):
    w = ec.weighted_means(ec.category_summary(inputs.eval_runs(spark, sf), 9))
    return w.select("model", "mode", *[F.round(m, 7).alias(m) for m in M])


@query(
    "m13_means_on_common",
    _sql(
        f"SELECT model, mode, {', '.join(f'round({m}, 9) AS {m}' for m in M)}, round({row_mean_sql(M)}, 9) AS average_score FROM (SELECT model, mode, {means_sql()} FROM eval_runs WHERE question_id IN (SELECT question_id FROM kept) GROUP BY model, mode)",
        kept=f"SELECT question_id FROM classes GROUP BY question_id HAVING count(DISTINCT model) = {_ALL}",
    ),
)
def _(spark, sf):
    m = ec.means_on_common(inputs.eval_runs(spark, sf), ec.common_to_all(_classes(spark, sf), False))
    return m.select("model", "mode", *[F.round(c, 9).alias(c) for c in M + ["average_score"]])


@query(
    "m14_model_matrix",
    _sql(f"SELECT model, {', '.join(f'round({m}, 9) AS {m}' for m in M)}, row_number() OVER (ORDER BY answer_correctness DESC NULLS LAST, model) AS position FROM means WHERE mode = 'agentic_with_kg'"),
)
def _(spark, sf):
    return ec.model_matrix(_means(spark, sf), "agentic_with_kg").select("model", "position", *[F.round(m, 9).alias(m) for m in M])


@query(
    "m15_improvements",
    _sql(
        """SELECT model, round((w - n) * 100, 6) AS graph_gain, round((n - d) * 100, 6) AS vector_gain, round((w - d) * 100, 6) AS total_gain, row_number() OVER (ORDER BY w DESC NULLS LAST, model) AS position FROM
        (SELECT model, max(answer_correctness) FILTER (WHERE mode = 'agentic_with_kg') AS w, max(answer_correctness) FILTER (WHERE mode = 'agentic_no_kg') AS n, max(answer_correctness) FILTER (WHERE mode = 'direct_llm') AS d FROM means GROUP BY model)"""
    ),
)
def _(spark, sf):
    return ec.improvements(_means(spark, sf))


@query(
    "m16_ranking",
    _sql(
        f"""SELECT mode, model, row_number() OVER (PARTITION BY mode ORDER BY answer_correctness DESC NULLS LAST, model) AS position, round(answer_correctness, 9) AS correctness,
        round(coalesce(list_avg(list_filter([{', '.join(M)}], lambda x: x > 0)), 0), 9) AS positive_mean FROM means"""
    ),
)
def _(spark, sf):
    r = ec.ranking(_means(spark, sf))
    return r.withColumns({c: F.round(c, 9) for c in ("correctness", "positive_mean")})


@query("m16_ranking_all_modes", _sql("SELECT model, mode, round(answer_correctness, 9) AS correctness, row_number() OVER (ORDER BY answer_correctness DESC, model, mode) AS position FROM means WHERE answer_correctness > 0"))
def _(spark, sf):
    return ec.ranking_all_modes(_means(spark, sf)).withColumn("correctness", F.round("correctness", 9))


@query("m17_with_data", with_inputs(f"SELECT model, category, mode FROM eval_runs GROUP BY ALL HAVING greatest({', '.join(f'max({m})' for m in M)}) > 0"))
def _(spark, sf):
    return ec.with_data(inputs.eval_runs(spark, sf))


@query("m19_zero_details", with_inputs("SELECT model, category, mode, question_id, metric FROM eval_long WHERE value = 0"))
def _(spark, sf):
    return ec.zero_details(inputs.eval_runs(spark, sf))


@query(
    "m19_zero_rollups",
    with_inputs("SELECT mode, category, metric, count(*) AS zeros, count(DISTINCT question_id) AS questions FROM eval_long WHERE value = 0 GROUP BY GROUPING SETS ((mode), (category), (metric), ())"),
)
def _(spark, sf):
    return ec.zero_rollups(ec.zero_details(inputs.eval_runs(spark, sf)))


def _box_sql(source: str, x: str, key: str) -> str:
    return f"""SELECT {key}, q.n AS values, low, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, high, mean, (SELECT count(*) FROM {source} t WHERE t.{key} = q.{key} AND (coalesce({x}, 0) < q1 - (q3 - q1) * 1.5 OR coalesce({x}, 0) > q3 + (q3 - q1) * 1.5)) AS outliers
    FROM (SELECT {key}, count(*) AS n, min(coalesce({x}, 0)) AS low, quantile_cont(coalesce({x}, 0), 0.25) AS q1, quantile_cont(coalesce({x}, 0), 0.5) AS median, quantile_cont(coalesce({x}, 0), 0.75) AS q3,
    max(coalesce({x}, 0)) AS high, round_even(avg(coalesce({x}, 0)), 6) AS mean FROM {source} GROUP BY {key}) q"""


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("q1", "median", "q3")})


@query("m20_box_stats", _box_sql("lineitem", "l_extendedprice", "l_returnflag"))
def _(spark, sf):
    return _rounded(ec.box_stats(table(spark, sf, "lineitem"), "l_extendedprice", ["l_returnflag"]))


@query("m20_box_scores", with_inputs(_box_sql("eval_runs", "answer_correctness", "mode")))
def _(spark, sf):
    return _rounded(ec.box_stats(inputs.eval_runs(spark, sf), "answer_correctness", ["mode"]))


@query(
    "m21_category_table",
    with_inputs(
        f"""SELECT category, mode, CASE mode WHEN 'direct_llm' THEN 0 WHEN 'agentic_no_kg' THEN 1 ELSE 2 END AS mode_order, round(avg(answer_correctness) FILTER (WHERE error IS NULL), 9) AS correctness,
        round_even(count(*) FILTER (WHERE NOT {_ZERO}) * 100 / count(*), 2) AS nonzero_rate FROM eval_runs GROUP BY category, mode"""
    ),
)
def _(spark, sf):
    return ec.category_table(inputs.eval_runs(spark, sf), 9)


@query(
    "m22_breakdown",
    with_inputs(
        """SELECT method, dimension, model || ' (' || replace(method, '_', ' ') || ')' AS series_label, g AS "group", round(value, 6) AS value, n AS count, c AS correct_count, round(c / n, 6) AS correct_rate, round(value, 6) AS avg_correctness,
        dense_rank() OVER (PARTITION BY method, dimension ORDER BY gv DESC, g) AS group_order, dense_rank() OVER (PARTITION BY method, dimension ORDER BY sv DESC, model) AS series_order FROM
        (SELECT method, dimension, model, g, avg(x) AS value, count(*) AS n, count(*) FILTER (WHERE x >= 0.8) AS c FROM longrec GROUP BY ALL)
        JOIN (SELECT method, dimension, g, round(avg(x), 9) AS gv FROM longrec GROUP BY ALL) USING (method, dimension, g) JOIN (SELECT method, dimension, model, round(avg(x), 9) AS sv FROM longrec GROUP BY ALL) USING (method, dimension, model)""",
        longrec=" UNION ALL ".join(
            f"SELECT CASE mode WHEN 'direct_llm' THEN 'direct' WHEN 'agentic_no_kg' THEN 'no_kg' ELSE 'with_kg' END AS method, '{d}' AS dimension, model, {d} AS g, answer_correctness AS x FROM eval_runs WHERE answer_correctness IS NOT NULL"
            for d in ("category", "difficulty", "reasoning")
        ),
    ),
)
def _(spark, sf):
    return ec.breakdown(inputs.eval_runs(spark, sf))

"""Registered queries: model training on order values and document quality, stored models, importances.

Ridge on one input has a closed form, so the race's split, preparation, fit, figures and stored model are checked against SQL; learners
that grow trees or iterate are checked by rows here and by score bands in the tests.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from checks.base import query, r4, s4, table
from plantlens.operators import metrics
from plantlens.operators.learners import classification_candidates, regression_candidates, smaller
from plantlens.operators.scoring import complete_points
from plantlens.operators.splits import assign_folds, sample_grid
from plantlens.operators.whatif import uncertainty_summary
from plantlens.plans.importance import model_importance, permutation_importance
from plantlens.plans.train import evaluate, predictions, preparation, train
from plantlens.session import cut, scratch_path
from plantlens.sources.registry import load_model, model_scorer, save_model

ALPHA = 10.0


def order_values(spark, sf):
    """One row per order: what its lines hold, and their price in thousands. Orders of one line miss the mean tax."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").cast("double").alias("lines"),
        F.sum("l_quantity").alias("quantity"),
        F.max("l_quantity").alias("most"),
        F.avg("l_discount").alias("discount"),
        F.avg("l_tax").alias("tax"),
        (F.sum("l_extendedprice") / 1000.0).alias("value"),
    )
    return lines.withColumn("tax", F.when(F.col("lines") > 1, F.col("tax")))


SQL_VALUES = "SELECT l_orderkey, sum(l_quantity) AS x, sum(l_extendedprice) / 1000.0::DOUBLE AS y FROM lineitem GROUP BY 1"
HASH = "('0x' || substr(md5('42-' || l_orderkey::VARCHAR), 1, 13))::BIGINT"
#: The split, the fitted preparation and ridge in closed form: its penalty counts only against the slope.
SQL_RIDGE = f"""v AS ({SQL_VALUES}),
    s AS (SELECT *, row_number() OVER (ORDER BY {HASH}) <= count(*) OVER () - ceil(count(*) OVER () * 0.2::DOUBLE) AS is_train FROM v),
    q AS (SELECT quantile_cont(x, 0.5) AS mid, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr FROM s WHERE is_train),
    z AS (SELECT s.*, (x - mid) / iqr AS z FROM s, q),
    f AS (SELECT avg(z) AS mz, avg(y) AS my, covar_pop(z, y) * count(*) / (var_pop(z) * count(*) + {ALPHA}) AS b FROM z WHERE is_train),
    p AS (SELECT z.*, my + b * (z - mz) AS p FROM z, f)"""


def documents_quality(spark, sf):
    """Labelled documents with figures of their texts and their quality as a class."""
    text = F.col("text")
    count = lambda pattern: F.length("text") - F.length(F.regexp_replace(text, pattern, ""))
    words = F.size(F.split(text, r"\s+"))
    figures = table(spark, sf, "documents").select(
        "doc_id", F.log1p(words.cast("double")).alias("words"), (count("[#*$%&|]") / words).alias("symbols"), (count("[A-Z]") / words).alias("capitals"),
        (count("!") / words).alias("calls"), (F.length("text") / words).alias("length"), (F.size(F.array_distinct(F.split(text, r"\s+"))) / words).alias("distinct"),
    )
    labels = table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("poor").alias("class"))
    return figures.join(labels, "doc_id")


def _ridge(spark, sf):
    pool = smaller(regression_candidates(), ["Ridge"], alpha=[ALPHA])
    return train(order_values(spark, sf).select("l_orderkey", "quantity", "value"), "value", "l_orderkey", pool, 1)


@query(
    f"""WITH {SQL_RIDGE}, e AS (SELECT is_train, 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS r2, avg(abs(y - p)) AS mae FROM p GROUP BY 1),
    l AS (SELECT CASE WHEN is_train THEN 'train' ELSE 'test' END AS split, 'r2' AS name, r2 AS value FROM e
      UNION ALL SELECT CASE WHEN is_train THEN 'train' ELSE 'test' END, 'mae', mae FROM e
      UNION ALL SELECT 'train-test', 'r2_gap', max(r2) FILTER (is_train) - max(r2) FILTER (NOT is_train) FROM e)
    SELECT split, name, {s4('value')} AS value FROM l"""
)
def train_value_figures(spark, sf):
    trained, whole, _ = _ridge(spark, sf)
    return evaluate(trained, whole).select("split", "name", r4("value", "value"))


@query(f"WITH {SQL_RIDGE} SELECT l_orderkey, {s4('p')} AS prediction FROM p")
def stored_model_predictions(spark, sf):
    """The raced model, saved, loaded again and run on every order."""
    trained, whole, _ = _ridge(spark, sf)
    path = scratch_path(spark, "value-model")
    save_model(spark, trained, path)
    scored = model_scorer(load_model(spark, path))(whole.select("l_orderkey", "quantity"))
    return scored.select("l_orderkey", r4("prediction", "prediction"))


@query(
    f"""WITH v AS (SELECT l_orderkey, count(*)::DOUBLE AS lines, sum(l_quantity) AS quantity, CASE WHEN count(*) > 1 THEN avg(l_tax) END AS tax FROM lineitem GROUP BY 1),
    f AS (SELECT *, floor((row_number() OVER (ORDER BY {HASH}) - 1) * 5 / count(*) OVER ())::INT AS fold FROM v),
    t AS (SELECT k, f.* FROM f, (SELECT unnest(range(5))::INT AS k) WHERE fold <> k),
    u AS (UNPIVOT (SELECT k, lines, quantity, coalesce(tax, m) AS tax, m FROM t JOIN (SELECT k, quantile_cont(tax, 0.5) AS m FROM t GROUP BY k) USING (k)) ON lines, quantity, tax INTO NAME col VALUE x),
    g AS (SELECT k, col, var_pop(x) AS v, quantile_cont(x, 0.5) AS mid, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr FROM u GROUP BY k, col)
    SELECT k AS fold, col AS "column", {s4('mid', 6)} AS center, {s4('CASE WHEN iqr = 0 THEN 1.0::DOUBLE ELSE iqr END', 6)} AS span FROM g WHERE v > 0.01::DOUBLE"""
)
def fold_preparation(spark, sf):
    """What the preparation learns without each fold: centre and scale of the columns that vary enough."""
    folded = cut(assign_folds(order_values(spark, sf).select("l_orderkey", "lines", "quantity", "tax"), "l_orderkey"))
    rows = []
    for fold in range(5):
        fitted = Pipeline(stages=preparation(["l_orderkey", "fold"])).fit(folded.where(F.col("fold") != fold))
        rows += [(fold, c, mid, span) for c, mid, span in fitted.stages[2].learned()]
    learned = spark.createDataFrame(rows, "fold int, column string, center double, span double")
    return learned.select("fold", "column", r4("center", "center", 6), r4("span", "span", 6))


@query(
    f"""WITH v AS ({SQL_VALUES}), m AS (SELECT avg(x) AS a, avg(y) AS b, corr(x, y) AS c FROM v),
    l AS (SELECT 'mean value' AS candidate, b / 1000.0::DOUBLE AS cv_score, 'ok' AS status, NULL AS error FROM m UNION ALL SELECT 'correlation', c, 'ok', NULL FROM m
      UNION ALL SELECT 'negative', -c, 'ok', NULL FROM m UNION ALL SELECT 'broken', NULL, 'failed', 'no such learner')
    SELECT candidate, {s4('cv_score', 6)} AS cv_score, {s4('greatest(coalesce(cv_score, 0.0::DOUBLE), 0.0::DOUBLE)', 6)} AS shown_score, status, error,
      row_number() OVER (ORDER BY cv_score DESC NULLS LAST, candidate)::INT AS place FROM l"""
)
def scoreboard_order(spark, sf):
    """The scoreboard's order and shown scores on figures of the orders."""
    a, b = order_values(spark, sf).agg(F.avg("value"), F.corr("quantity", "value")).first()
    rows = [("mean value", a / 1000.0, "ok", None), ("correlation", b, "ok", None), ("negative", -b, "ok", None), ("broken", None, "failed", "no such learner")]
    board = metrics.scoreboard(spark, rows).collect()
    placed = [(r["candidate"], r["cv_score"], r["shown_score"], r["status"], r["error"], i + 1) for i, r in enumerate(board)]
    shown = spark.createDataFrame(placed, "candidate string, cv_score double, shown_score double, status string, error string, place int")
    return shown.select("candidate", r4("cv_score", "cv_score", 6), r4("shown_score", "shown_score", 6), "status", "error", "place")


@query()
def train_value_scoreboard(spark, sf):
    """All three regression learners, one drawn setting each (whole grids take hours)."""
    pool = smaller(regression_candidates(), ["Ridge", "RandomForest", "BoostedTrees"], trees=[20], depth=[5])
    return metrics.scoreboard(spark, train(order_values(spark, sf), "value", "l_orderkey", pool, 1)[2])


@query()
def train_quality_report(spark, sf):
    """All four classification learners, one drawn setting each; report on the held-out rows."""
    small = {"trees": [10], "depth": [5], "hidden": [(16,)], "leaf": [10]}
    pool = smaller(classification_candidates(), ["LogisticRegression", "RandomForest", "MLP", "BoostedTrees"], **small)
    trained, whole, _ = train(documents_quality(spark, sf), "class", "doc_id", pool, 1)
    test = predictions(trained, whole.where("split = 'test'"), [trained.target])
    return metrics.class_report(test, trained.target, "predicted")


@query()
def train_quality_importance(spark, sf):
    pool = smaller(classification_candidates(), ["RandomForest"], trees=[20], depth=[6])
    return model_importance(train(documents_quality(spark, sf), "class", "doc_id", pool, 1)[0].model)


@query()
def permuted_importance(spark, sf):
    pool = smaller(regression_candidates(), ["Ridge"], alpha=[ALPHA])
    trained, whole, _ = train(order_values(spark, sf), "value", "l_orderkey", pool, 1)
    held_out = cut(whole.where("split = 'test'"))
    return permutation_importance(trained.model, held_out, trained.feature_order, "value", "l_orderkey", True)


@query()
def stored_model_uncertainty(spark, sf):
    """A stored model run on orders as operating points, with 20 draws of the four inputs."""
    rows = order_values(spark, sf)
    renamed = rows.select("l_orderkey", (F.col("quantity") / 400.0).alias("production_load"), (F.col("lines") * 10.0).alias("cycle_time"),
                          F.col("most").alias("machine_temperature"), (F.col("discount") * 30.0).alias("axis_speed"), "value")
    trained, whole, _ = train(renamed, "value", "l_orderkey", smaller(regression_candidates(), ["Ridge"], alpha=[ALPHA]), 1)
    path = scratch_path(spark, "points-model")
    save_model(spark, trained, path)
    loaded = load_model(spark, path)
    scorer = model_scorer(loaded)

    def score(df):
        return scorer(complete_points(df, {}, None, loaded.feature_order, loaded.temp_mean, keep=["l_orderkey"]))

    return uncertainty_summary(whole.drop("value", "split"), "l_orderkey", score, n_draws=20)


@query(
    """WITH t AS (SELECT unnest(range(p_size)) AS i FROM (SELECT 45 AS p_size)), d AS (SELECT i, i % 3 AS a, (i // 3) % 3 AS b, (i // 9) % 5 AS c FROM t)
    SELECT a::INT AS a, b::INT AS b, c::INT AS c, (SELECT count(*) FROM part WHERE p_size % 3 = a AND p_size % 5 = c) AS n FROM d"""
)
def whole_grid_draw(spark, sf):
    """A draw larger than the product is the whole product; each setting counts the parts it fits."""
    combos = sample_grid({"a": [0, 1, 2], "b": [0, 1, 2], "c": [0, 1, 2, 3, 4]}, 100)
    drawn = spark.createDataFrame([(c["a"], c["b"], c["c"]) for c in combos], "a int, b int, c int")
    parts = table(spark, sf, "part").groupBy((F.col("p_size") % 3).alias("pa"), (F.col("p_size") % 5).alias("pc")).agg(F.count("*").alias("m"))
    met = drawn.join(parts, (F.col("a") == F.col("pa")) & (F.col("c") == F.col("pc")), "left")
    return met.select("a", "b", "c", F.coalesce("m", F.lit(0)).cast("bigint").alias("n"))

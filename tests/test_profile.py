import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plantlens.functions.hashing import permuted, permuted_number
from plantlens.operators import metrics, profile, splits
from plantlens.operators.grid import SEARCH_BOUNDS, best_candidate, candidate_grid
from plantlens.operators.scoring import RAW_DEFAULTS, column_scorer, complete_points, score_points, score_tasks


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(8)
    n = 600
    x = rng.normal(0, 1, n)
    return pd.DataFrame(
        {
            "k": np.arange(n),
            "g": rng.choice(["Low", "High"], n, p=[0.9, 0.1]),
            "x": x,
            "y": np.where(rng.random(n) < 0.1, np.nan, 2 * x + rng.normal(0, 1, n)),
            "few": rng.integers(0, 3, n),
        }
    )


@pytest.fixture(scope="module")
def df(spark, frame):
    from plantlens.sources.tables import nan_to_null

    return nan_to_null(spark.createDataFrame(frame)).cache()


def test_histogram(spark, df, frame):
    counts, edges = np.histogram(frame.x, bins=30)
    rows = profile.histogram(df, "x", 30).orderBy("bin").collect()
    assert [r["n"] for r in rows] == counts.tolist()
    np.testing.assert_allclose([r["lower"] for r in rows], edges[:-1])
    one = spark.createDataFrame([(2.0,), (2.0,), (None,)], "x double")
    assert [r["n"] for r in profile.histogram(one, "x", 3).orderBy("bin").collect()] == [2, 0, 0]
    assert profile.histogram(one.where("x > 5"), "x", 3).agg(F.sum("n")).first()[0] == 0


def test_grouped_density_sums_to_one(df, frame):
    shape = profile.grouped_histogram(df, "g", "x", 20)
    width = (frame.x.max() - frame.x.min()) / 20
    for r in shape.groupBy("g").agg(F.sum("density").alias("d")).collect():
        assert r["d"] * width == pytest.approx(1)


def test_correlations(df, frame):
    want = frame[["x", "y", "few"]].corr()
    for r in profile.correlation_matrix(df, ["x", "y", "few"]).collect():
        assert r["r"] == pytest.approx(want.loc[r["x"], r["y"]])
    rows = profile.target_correlations(df, "y", ["x", "few"]).collect()
    assert [r["feature"] for r in rows] == ["few", "x"]


def test_box(df, frame):
    for r in profile.box_stats(df, ["x"], ["g"]).collect():
        part = frame[frame.g == r["g"]].x
        q1, q2, q3 = part.quantile([0.25, 0.5, 0.75])
        inside = part[(part >= q1 - 1.5 * (q3 - q1)) & (part <= q3 + 1.5 * (q3 - q1))]
        assert (r["q1"], r["median"], r["q3"]) == pytest.approx((q1, q2, q3))
        assert (r["whisker_low"], r["whisker_high"], r["n_outliers"]) == (inside.min(), inside.max(), len(part) - len(inside))
        out = profile.box_outliers(df, ["x"], ["g"], ["k"]).where(F.col("g") == r["g"]).collect()
        assert sorted(o["k"] for o in out) == sorted(set(part.index) - set(inside.index))


def test_counts(df, frame):
    assert profile.is_categorical(df, "g") and profile.is_categorical(df, "few") and not profile.is_categorical(df, "x")
    rows = profile.class_counts(df, "g").collect()
    assert [(r["label"], r["n"]) for r in rows] == [("Low", (frame.g == "Low").sum()), ("Medium", None), ("High", (frame.g == "High").sum())]
    assert [r["few"] for r in profile.value_counts(df, "few").collect()] == [0, 1, 2]
    assert profile.table_shape(df, "y").first().asDict() == {"n_rows": 600, "n_features": 4}
    assert profile.scatter_sample(df, ["x"], "k").count() == 600
    assert 200 < profile.scatter_sample(df, ["x"], "k", 0.5).count() < 400
    s = profile.distribution_summary(df, "x").first()
    np.testing.assert_allclose(list(s), [frame.x.mean(), frame.x.std(ddof=0), *np.percentile(frame.x, [5, 95])])


def test_regression_and_class_metrics(spark):
    rng = np.random.default_rng(2)
    y, p = rng.normal(5, 2, 200), rng.normal(5, 2, 200)
    row = metrics.r2_from(spark.createDataFrame(pd.DataFrame({"y": y, "p": p})), "y", "p").first()
    assert row["r2"] == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert row["mae"] == pytest.approx(np.abs(y - p).mean())
    pairs = [("Low", "Low")] * 3 + [("Low", "High")] + [("Medium", "High")] * 2 + [("High", "High")] * 4
    df = spark.createDataFrame(pairs, "y string, p string")
    report = {r["label"]: r for r in metrics.class_report(df, "y", "p").collect()}
    assert report["Medium"]["precision"] == report["Medium"]["recall"] == report["Medium"]["f1"] == 0.0
    assert report["High"]["precision"] == pytest.approx(4 / 7) and report["Low"]["recall"] == 0.75
    assert report["weighted avg"]["recall"] == pytest.approx(0.7) and report["macro avg"]["support"] == 10
    matrix = {r["label"]: (r["High"], r["Low"], r["Medium"]) for r in metrics.confusion_matrix(df, "y", "p").collect()}
    assert matrix == {"High": (4, 0, 0), "Low": (1, 3, 0), "Medium": (2, 0, 0)}
    board = metrics.scoreboard(spark, [("b", 0.5, "ok", None), ("a", 0.5, "ok", None), ("c", None, "failed", "boom"), ("d", -1.0, "ok", None)])
    assert [(r["candidate"], r["shown_score"]) for r in board.collect()] == [("a", 0.5), ("b", 0.5), ("d", 0.0), ("c", 0.0)]


def test_splits_are_exact_partitions(df, frame):
    plain = splits.train_test_split(df, "k")
    assert {r["split"]: r["count"] for r in plain.groupBy("split").count().collect()} == {"train": 480, "test": 120}
    by = splits.train_test_split(df, "k", by=["g"]).groupBy("g", "split").count().collect()
    for r in by:
        n = (frame.g == r["g"]).sum()
        assert r["count"] == (np.floor(0.8 * n + 0.5) if r["split"] == "train" else n - np.floor(0.8 * n + 0.5))
    folds = splits.assign_folds(df, "k", by=["g"])
    assert folds.count() == 600 and folds.columns == [*df.columns, "fold"]
    sizes = folds.groupBy("g", "fold").count().groupBy("g").agg(F.max("count") - F.min("count"), F.count("*")).collect()
    assert all(r[1] <= 1 and r[2] == 5 for r in sizes)


def test_split_of_tiny_strata(spark):
    df = spark.createDataFrame([(i, "one" if i == 0 else "two") for i in range(4)], "k int, g string")
    rows = splits.assign_folds(df, "k", by=["g"]).collect()
    assert len(rows) == 4 and {r["fold"] for r in rows if r["g"] == "two"} <= set(range(5))
    assert splits.train_test_split(df.limit(1), "k").first()["split"] == "test"
    assert splits.train_test_split(df.limit(0), "k").count() == 0


def test_split_does_not_depend_on_partitions(spark, df):
    one = splits.train_test_split(df.coalesce(1), "k", by=["g"]).orderBy("k").collect()
    many = splits.train_test_split(df.repartition(13), "k", by=["g"]).orderBy("k").collect()
    assert one == many


def test_grid_draw():
    grid = {"a": [1, 2, 3], "b": ["x", "y"]}
    everything = splits.sample_grid(grid, 10)
    assert len(everything) == 6 == len({tuple(c.items()) for c in everything})
    some = splits.sample_grid(grid, 4)
    assert len({tuple(c.items()) for c in some}) == 4 and some == splits.sample_grid(grid, 4)


@pytest.mark.parametrize("n", [1, 7, 100, 256])
def test_every_stratum_holds_one_point(spark, n):
    pdf = candidate_grid(spark, n).toPandas()
    for c, (lo, hi) in SEARCH_BOUNDS.items():
        assert sorted(np.floor((pdf[c] - lo) / (hi - lo) * n).astype(int)) == list(range(n))


def test_best_candidate(spark):
    df = spark.createDataFrame([(3, 1.0, "a"), (1, 1.0, "a"), (2, 5.0, "a"), (4, 2.0, "b"), (5, None, "b")], "k int, s double, g string")
    assert best_candidate(df, "s", "k").first()["k"] == 1
    assert best_candidate(df, "s", "k", "max").first()["k"] == 2
    assert {r["g"]: r["k"] for r in best_candidate(df, "s", "k", by=["g"]).collect()} == {"a": 1, "b": 4}
    assert best_candidate(df.where("k > 9"), "s", "k").count() == 0


def test_completion_and_scoring(spark):
    points = spark.createDataFrame([(1, 0.5, None), (2, 0.6, 0.9)], "id int, production_load double, tool_wear double")
    out = complete_points(points, RAW_DEFAULTS["maintenance"], {"tool_wear": 0.7}, ["tool_wear", "pressure", "load_squared", "unseen"], keep=["id"])
    assert [tuple(r) for r in out.orderBy("id").collect()] == [(1, 0.7, 100.0, 0.25, 0.0), (2, 0.9, 100.0, pytest.approx(0.36), 0.0)]
    assert score_points(points, None) is None
    scored = score_tasks(points, {"energy": column_scorer(F.lit(-1.0)), "emission": column_scorer(F.lit("Low"))}, lambda d, t: d)
    assert [(r["energy"], r["emission"]) for r in scored.collect()] == [(0.01, "Low")] * 2


def test_permutations_are_exact_and_even(spark):
    for n in (1, 2, 3, 4, 5, 45, 99, 101, 2000):
        rows = spark.range(n).select(*[permuted(F.col("id"), n, name, 42).alias(name) for name in ("a", "b", "c")]).toPandas()
        assert all(sorted(rows[c]) == list(range(n)) for c in rows)
        assert rows["a"].tolist() == [permuted_number(i, n, "a", 42) for i in range(n)]
        if n == 45:
            assert all(abs(rows[x].corr(rows[y])) < 0.35 for x, y in (("a", "b"), ("a", "c"), ("b", "c")))
        if n == 2000:
            cells = len(set(zip(rows["a"] * 22 // n, rows["b"] * 22 // n, strict=True)))
            assert abs(rows["a"].corr(rows["b"])) < 0.07 and cells > 0.96 * 484
    assert permuted_number(123_456_789, 3_000_000_000, "a", 1) != permuted_number(123_456_789, 3_000_000_000, "a", 2)


def test_completion_reads_no_mean_that_nobody_asks_for(spark):
    """Without the deviation among the features the points are not run for its mean: points that cannot be run are completed."""
    failing = F.raise_error(F.lit("the points were run")).cast("double")
    points = spark.createDataFrame([(1, 0.5)], "id int, production_load double").withColumn("machine_temperature", failing)
    out = complete_points(points, {}, None, ["production_load", "load_squared"], keep=["id"])
    assert out.columns == ["id", "production_load", "load_squared"]
    with pytest.raises(Exception, match="the points were run"):
        complete_points(points, {}, None, ["production_load", "temperature_deviation"], keep=["id"])

import threading

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plantlens.operators.clean import Fences
from plantlens.operators.learners import (
    Candidate,
    FitFacts,
    classification_candidates,
    regression_candidates,
    smaller,
)
from plantlens.operators.scoring import RAW_DEFAULTS, complete_points
from plantlens.plans import importance
from plantlens.plans.train import evaluate, predictions, prepare_table, train
from plantlens.sources.registry import load_model, model_scorer, save_model
from plantlens.streaming.score import read_readings, write_scored


def broken(settings, facts):
    raise RuntimeError("no such learner")


@pytest.fixture(scope="module")
def readings(spark):
    rng = np.random.default_rng(11)
    n = 500
    pdf = pd.DataFrame({"row_id": np.arange(n), "production_load": rng.uniform(0.3, 1, n), "machine_temperature": rng.normal(60, 8, n), "axis_speed": rng.uniform(0.2, 3, n)})
    pdf["energy"] = 10 + 20 * pdf.production_load + 0.1 * pdf.machine_temperature + 1.4 * pdf.axis_speed + rng.normal(0, 0.5, n)
    pdf["emission_class"] = np.select([pdf.energy < 25, pdf.energy < 30], ["Low", "Medium"], "High")
    return spark.createDataFrame(pdf).cache()


@pytest.fixture(scope="module")
def trained(readings):
    ready, _, mean = prepare_table(readings.drop("emission_class"), "energy", "row_id")
    pool = [*smaller(regression_candidates(), ["Ridge"], alpha=[0.01, 100.0]), Candidate("Broken", broken, {"x": [1]})]
    return train(ready, "energy", "row_id", pool, 2, folds=3, temp_mean=mean)


def test_race_keeps_failures(trained):
    model, whole, board = trained
    assert model.best == "Ridge" and model.settings == {"alpha": 0.01} and model.cv_score > 0.95
    assert ("Broken", None, "failed", "no such learner") in board
    figures = {(r["split"], r["name"]): r["value"] for r in evaluate(model, whole).collect()}
    assert figures["test", "r2"] > 0.95 and figures["test", "mae"] < 0.6
    assert figures["train-test", "r2_gap"] == pytest.approx(figures["train", "r2"] - figures["test", "r2"])


def test_all_failed_gives_none(readings):
    model, _, board = train(readings.drop("emission_class"), "energy", "row_id", [Candidate("Broken", broken, {"x": [1]})], 1, folds=2)
    assert model is None and board[0][2] == "failed"


def test_classifier(readings):
    ready, _, _ = prepare_table(readings.drop("energy"), "emission_class", "row_id")
    tiny = {"c": [1.0], "hidden": [(8,)], "trees": [3], "depth": [3], "rate": [0.1], "rows": [1.0], "features": ["0.8"], "leaf": [10]}
    pool = smaller(classification_candidates(), ["LogisticRegression", "MLP", "RandomForest", "BoostedTrees"], **tiny)
    model, whole, board = train(ready, "emission_class", "row_id", pool, 1, folds=2)
    assert [b[2] for b in board] == ["ok"] * 4 and model.cv_score > 0.8
    labels = {r[0] for r in predictions(model, whole, ["row_id"]).select("predicted").distinct().collect()}
    assert labels == {"Low", "Medium", "High"}


def ridge_that(acts):
    ridge = smaller(regression_candidates(), ["Ridge"], alpha=[1.0])[0]
    return lambda settings, facts: acts() or ridge.build(settings, facts)


@pytest.mark.parametrize("large", [False, True])
def test_a_slow_fit_holds_up_the_next_fold_only_on_large_tables(readings, monkeypatch, large):
    if large:
        monkeypatch.setattr("plantlens.plans.train.MANY_FOLDS_ROWS", 100)
    lock, quick, slow, came = threading.Lock(), [], [], []
    next_fold = threading.Event()

    def fast():
        with lock:
            quick.append(1)
            if len(quick) == 2:
                next_fold.set()

    def waits():
        with lock:
            slow.append(1)
            first = len(slow) == 1
        if first:
            came.append(next_fold.wait(5 if large else 60))

    pool = [Candidate("Slow", ridge_that(waits), {"alpha": [1.0]}), Candidate("Fast", ridge_that(fast), {"alpha": [1.0]})]
    _, _, board = train(readings.drop("emission_class"), "energy", "row_id", pool, 1, folds=2)
    assert {b[2] for b in board} == {"ok"} and len({b[1] for b in board}) == 1
    assert came == [not large]


def test_the_first_fold_names_the_failure(readings):
    seen = []

    def breaks(settings, facts):
        seen.append(facts.rows)
        raise RuntimeError("no such learner\nmore")

    pool = [*smaller(regression_candidates(), ["Ridge"], alpha=[1.0]), Candidate("Breaks", breaks, {"x": [1]})]
    _, _, board = train(readings.drop("emission_class"), "energy", "row_id", pool, 1, folds=2)
    assert ("Breaks", None, "failed", "no such learner") in board and seen


def test_every_candidate_builds():
    facts = FitFacts(100, 2.0, 4, 3)
    for c in [*regression_candidates(), *classification_candidates()]:
        assert c.build({k: v[0] for k, v in c.grid.items()}, facts) is not None


def test_importances(trained):
    model, whole, _ = trained
    rows = importance.model_importance(model.model).collect()
    assert [r["importance"] for r in rows] == sorted(r["importance"] for r in rows)
    permuted = importance.permutation_importance(model.model, whole, model.feature_order, "energy", "row_id", True, repeats=3)
    assert {r["feature"] for r in permuted.collect()} == set(model.feature_order)


def test_shuffle_is_a_permutation_without_fixed_rows(spark):
    df = spark.range(60).select(F.col("id").alias("k"), (F.col("id") * 1.0).alias("a"), (F.col("id") * 10.0).alias("b"), F.lit(1).alias("y"))
    out = importance.shuffled_features(df, ["a", "b"], "k", repeats=3, bucket_rows=25).toPandas()
    assert len(out) == 60 * 3 * 2
    order = ["feature", "repeat", "k"]
    whole = importance.shuffled_features(df, ["a", "b"], "k", repeats=3).toPandas()
    assert out.sort_values(order).reset_index(drop=True).equals(whole[out.columns].sort_values(order).reset_index(drop=True))
    for (feature, _), part in out.groupby(["feature", "repeat"]):
        factor, other, by = (1, "b", 10) if feature == "a" else (10, "a", 1)
        assert sorted(part[feature]) == [i * factor for i in range(60)]
        assert (part[feature] != part.k * factor).all()
        assert (part[other] == part.k * by).all()


def test_store_load_score(spark, trained, readings, tmp_path):
    model, whole, _ = trained
    assert load_model(spark, str(tmp_path / "none")) is None and model_scorer(None) is None
    save_model(spark, model, str(tmp_path / "m"))
    loaded = load_model(spark, str(tmp_path / "m"))
    assert loaded.feature_order == model.feature_order and loaded.temp_mean == model.temp_mean
    points = readings.select("row_id", "production_load", "machine_temperature", "axis_speed")
    full = complete_points(points, RAW_DEFAULTS["energy"], None, loaded.feature_order, loaded.temp_mean, keep=["row_id"])
    scored = model_scorer(loaded)(full)
    assert scored.columns == [*full.columns, "prediction"]
    same = scored.select("row_id", *loaded.feature_order).exceptAll(full.select("row_id", *loaded.feature_order))
    assert same.count() == 0
    direct = {r["row_id"]: r["predicted"] for r in predictions(model, full, ["row_id"]).collect()}
    assert all(direct[r["row_id"]] == pytest.approx(r["prediction"]) for r in scored.collect())


def test_stream_equals_batch(spark, readings, trained, tmp_path):
    model, _, _ = trained
    source = readings.select("row_id", "production_load", "machine_temperature", "axis_speed")
    source.repartition(3).write.parquet(str(tmp_path / "in"))
    fences = Fences.fit(source, "row_id")

    def score(df):
        full = complete_points(df, RAW_DEFAULTS["energy"], None, model.feature_order, model.temp_mean, keep=["row_id"])
        return model_scorer(model)(full).select("row_id", "prediction")

    stream = read_readings(spark, str(tmp_path / "in"), source.schema, files_per_trigger=1)
    query = write_scored(stream, [fences.apply, score], str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 500 and got.exceptAll(score(fences.apply(source))).count() == 0

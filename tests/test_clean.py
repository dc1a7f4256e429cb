import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plantlens.functions import features as feat
from plantlens.functions import scalar
from plantlens.operators import clean
from plantlens.operators.estimators import (
    ExactRobustScaler,
    FeatureVector,
    MedianImputer,
    VarianceFilter,
    Winsoriser,
)
from plantlens.sources import schemas
from plantlens.sources.tables import load_dataset, load_json, nan_to_null, preview, save_json
from pyspark.ml import Pipeline, PipelineModel


@pytest.fixture(scope="module")
def raw():
    rng = np.random.default_rng(3)
    n = 400
    return pd.DataFrame(
        {
            "row_id": np.arange(n),
            "production_load": np.where(rng.random(n) < 0.05, np.nan, rng.uniform(0.3, 1, n)),
            "machine_temperature": np.where(rng.random(n) < 0.03, 900.0, rng.normal(60, 10, n)),
            "flag": (rng.random(n) < 0.05).astype(float),
            "flat": 1.0,
            "name": "x",
        }
    )


def spark_frame(spark, raw):
    return nan_to_null(spark.createDataFrame(raw))


def test_missing_indicator_only_where_missing(spark, raw):
    out = feat.add_missing_indicators(spark_frame(spark, raw))
    assert [c for c in out.columns if c.endswith("_was_missing")] == ["production_load_was_missing"]
    assert out.agg(F.sum("production_load_was_missing")).first()[0] == raw.production_load.isna().sum()


def test_winsorise_like_pandas(spark, raw):
    df = spark_frame(spark, raw)
    out, report = clean.winsorise(df, "row_id")
    q1, q3 = raw.machine_temperature.quantile([0.25, 0.75])
    lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    rows = {r["column"]: r for r in report.collect()}
    assert set(rows) == {"machine_temperature"}
    assert rows["machine_temperature"]["n_capped"] == ((raw.machine_temperature < lo) | (raw.machine_temperature > hi)).sum()
    assert rows["machine_temperature"]["upper_fence"] == pytest.approx(hi, abs=1e-4)
    got = out.orderBy("row_id").toPandas()
    np.testing.assert_allclose(got.machine_temperature, raw.machine_temperature.clip(lo, hi))
    assert got.flag.sum() == raw.flag.sum()
    assert got.production_load.isna().sum() == raw.production_load.isna().sum()


def test_fences_do_not_move_on_second_apply(spark, raw):
    df = spark_frame(spark, raw)
    fences = clean.Fences.fit(df, "row_id")
    once = fences.apply(df)
    assert fences.report(once).count() == 0
    assert once.count() == len(raw)


def test_batch_clean(spark, raw):
    df = spark_frame(spark, raw).drop("row_id")
    cleaned, scaled = clean.clean_batch(df)
    full = raw.production_load.fillna(raw.production_load.median())
    q1, q2, q3 = full.quantile([0.25, 0.5, 0.75])
    got = np.sort(scaled.toPandas().production_load)
    np.testing.assert_allclose(got, np.sort((full - q2) / (q3 - q1)))
    assert "name" in cleaned.columns and "name" not in scaled.columns
    assert {r["flat"] for r in scaled.select("flat").distinct().collect()} == {0.0}


def test_pipeline_stages_and_reload(spark, raw, tmp_path):
    df = spark_frame(spark, raw)
    skip = ["row_id"]
    stages = [Winsoriser(excluded=skip), MedianImputer(excluded=skip), VarianceFilter(excluded=skip), ExactRobustScaler(excluded=skip), FeatureVector(excluded=skip)]
    model = Pipeline(stages=stages).fit(df)
    first = model.transform(df).orderBy("row_id").select("features").collect()
    names = model.stages[-1].getOrDefault("columns")
    assert names == ["production_load", "machine_temperature", "flag"]
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m")).transform(df).orderBy("row_id").select("features").collect()
    assert first == again


def test_percentile_labels(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("x"))
    cuts = clean.percentile_cuts(df, "x")
    counts = {r["l"]: r["count"] for r in df.select(clean.percentile_label("x", cuts).alias("l")).groupBy("l").count().collect()}
    x = np.arange(100)
    q33, q67 = np.percentile(x, [33, 67])
    assert counts == {"Low": int((x < q33).sum()), "Medium": int(((x >= q33) & (x < q67)).sum()), "High": int((x >= q67).sum())}


def test_features_need_their_columns(spark):
    df = spark.createDataFrame([(0.5, 2.0, 3.0, 4.0)], "production_load double, axis_speed double, vibration_level double, vibration_signal double")
    out = feat.add_features(df).first().asDict()
    assert "thermal_load" not in out and "wear_index" not in out
    assert out["mechanical_stress"] == 8.0
    assert out["load_squared"] == 0.25
    assert out["speed_per_load"] == 2.0 / (0.5 + 1e-6)


def test_deviation_uses_stored_mean(spark):
    df = spark.createDataFrame([(50.0,), (70.0,)], "machine_temperature double")
    assert [r[0] for r in feat.add_features(df).select("temperature_deviation").collect()] == [-10.0, 10.0]
    assert [r[0] for r in feat.add_features(df, 40.0).select("temperature_deviation").collect()] == [10.0, 30.0]


def test_scalars(spark):
    df = spark.createDataFrame([("Low",), ("High",), ("odd",), ("3.5",), (None,)], "v string")
    rows = df.select(
        scalar.encode_ordinal(F.col("v")), scalar.label_score(F.col("v")), scalar.label_score(F.col("v"), "number")
    ).collect()
    assert [tuple(r) for r in rows] == [(0, 0.0, 0.0), (2, 2.0, 2.0), (-1, 0.0, None), (-1, 3.5, 3.5), (-1, None, None)]
    x = spark.createDataFrame([(None,), (-5.0,), (0.005,), (9.0,)], "x double")
    assert [r[0] for r in x.select(scalar.clip(F.col("x"), 0.0, 1.0)).collect()] == [None, 0.0, 0.005, 1.0]
    assert [r[0] for r in x.select(scalar.floor_prediction(F.col("x"))).collect()] == [None, 0.01, 0.01, 9.0]
    assert x.select(scalar.display_percent(F.lit(0.12345))).first()[0] in ("12.34%", "12.35%")
    with pytest.raises(ValueError):
        scalar.energy_cost(F.col("x"), 51.0)
    with pytest.raises(ValueError):
        scalar.grid_emission(F.col("x"), 0.05)


def test_schemas(spark):
    df = spark.createDataFrame([(1.0, 2.0, "Low", 3.0)], "axis_speed double, power_factor double, emission_class string, energy double")
    assert schemas.missing_columns(df, "emission") == ["production_load", "cycle_time", "machine_temperature"]
    assert schemas.find_target(df) == "energy"
    assert schemas.find_target(df.drop("energy")) == "emission_class"
    assert schemas.find_target(df.select("axis_speed")) is None
    with pytest.raises(ValueError, match="production_load, cycle_time"):
        schemas.require_columns(df, "emission")
    assert schemas.task_schema("efficiency")["efficiency_class"].dataType.simpleString() == "string"


def test_sources(spark, tmp_path):
    path = tmp_path / "Readings.CSV"
    path.write_text("a,b,c\n1,2.5,x\n,NaN,y\n3,,z\n")
    df = load_dataset(spark, str(path))
    assert dict(df.dtypes) == {"a": "int", "b": "double", "c": "string"}
    assert df.where("b is null").count() == 2 and df.where("a is null").count() == 1
    assert preview(df, 2).count() == 2
    with pytest.raises(ValueError, match=r"\.TXT"):
        load_dataset(spark, "readings.txt")
    with pytest.raises(ValueError, match="unknown"):
        load_dataset(spark, "readings")
    assert load_json(spark, str(tmp_path / "none")) is None
    save_json(spark, str(tmp_path / "r"), {"r2": 0.5, "mae": 1.25})
    assert load_json(spark, str(tmp_path / "r")).first().asDict() == {"r2": 0.5, "mae": 1.25}


def test_uniform_and_normal_draws(spark):
    from plantlens.functions.hashing import digest, normals4, uniform

    z = spark.range(4000).select(uniform(1, "id").alias("u"), *[n.alias(f"z{i}") for i, n in enumerate(normals4(digest(7, "id")))])
    row = z.agg(F.avg("u"), F.min("u"), F.max("u"), F.avg("z0"), F.stddev("z1"), F.corr("z0", "z1"), F.corr("z2", "z3")).first()
    assert abs(row[0] - 0.5) < 0.02 and 0 <= row[1] and row[2] < 1
    assert abs(row[3]) < 0.06 and abs(row[4] - 1) < 0.05 and abs(row[5]) < 0.06 and abs(row[6]) < 0.06
    assert not math.isnan(row[3])

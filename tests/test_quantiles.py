import numpy as np
import pandas as pd
import pytest

from plantlens.operators.quantiles import order_statistics, quantile_values, quantiles
from pyspark.sql import functions as F

PROBS = [0.0, 0.05, 0.25, 0.33, 0.5, 0.67, 0.95, 1.0]


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(1)
    n = 3000
    return pd.DataFrame(
        {
            "g": rng.choice(["a", "b", "c"], n, p=[0.7, 0.29, 0.01]),
            "wide": rng.normal(0, 1e6, n) ** 3,
            "hot": np.where(rng.random(n) < 0.4, 7.0, rng.normal(7, 1e-9, n)),
            "ints": rng.integers(-3, 4, n).astype(float),
            "gappy": np.where(rng.random(n) < 0.5, np.nan, rng.exponential(1, n)),
        }
    )


@pytest.mark.parametrize("settings", [{}, {"exact_rows": 500}, {"exact_rows": 5}])
def test_same_as_pandas_on_every_path(spark, frame, settings):
    df = spark.createDataFrame(frame)
    columns = ["wide", "hot", "ints", "gappy"]
    got = quantile_values(df, columns, PROBS, **settings)
    for c in columns:
        np.testing.assert_allclose(got[c], frame[c].quantile(PROBS).to_numpy(), rtol=1e-12)


@pytest.mark.parametrize("settings", [{}, {"exact_rows": 5}])
def test_groups(spark, frame, settings):
    df = spark.createDataFrame(frame)
    rows = quantiles(df, ["wide", "gappy"], [0.25, 0.9], ["g"], **settings).collect()
    assert len(rows) == 6
    for r in rows:
        part = frame[frame.g == r["g"]][r["column"]]
        assert r["n"] == part.notna().sum()
        np.testing.assert_allclose(r["q"], part.quantile([0.25, 0.9]).to_numpy(), rtol=1e-12)


def test_null_group_and_empty_column(spark):
    df = spark.createDataFrame([(None, 1.0, None), (None, 3.0, None), ("a", 5.0, None)], "g string, x double, y double")
    got = {r["g"]: r["q"] for r in quantiles(df, ["x"], [0.5], ["g"]).collect()}
    assert got == {None: [2.0], "a": [5.0]}
    assert "y" not in quantile_values(df, ["x", "y"], [0.5])


@pytest.mark.parametrize("exact_rows", [3, 1_000_000])
def test_ranks(spark, exact_rows):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).cast("double").alias("x"))
    rows = order_statistics(df, ["x"], [lambda n: F.lit(0), lambda n: n - 1, lambda n: F.floor(n * 0.8)], exact_rows=exact_rows).collect()
    assert {r["pos"]: r["value"] for r in rows} == {0: 0.0, 1: 999.0, 2: 800.0}


def test_many_groups_far_apart(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"g": np.arange(1200) % 40})
    pdf["x"] = pdf.g * 1000.0 - 20000 + rng.normal(0, 1, len(pdf))
    rows = quantiles(spark.createDataFrame(pdf), ["x"], [0.1, 0.5], ["g"], exact_rows=3).collect()
    assert len(rows) == 40
    for r in rows:
        np.testing.assert_allclose(r["q"], pdf[pdf.g == r["g"]].x.quantile([0.1, 0.5]).to_numpy(), rtol=1e-12)


def test_group_column_called_value_and_many_probabilities(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(101)] + [("b", float(-i)) for i in range(51)], "value string, x double")
    probs = [i / 1000 for i in range(1001)]
    got = {r["value"]: r["q"] for r in quantiles(df, ["x"], probs, ["value"], exact_rows=10).collect()}
    np.testing.assert_allclose(got["a"], [p * 100 for p in probs], atol=1e-9)
    np.testing.assert_allclose(got["b"], [p * 50 - 50 for p in probs], atol=1e-9)
    with pytest.raises(ValueError):
        quantiles(df.withColumnRenamed("value", "n"), ["x"], [0.5], ["n"])


def test_bit_equal_over_partitionings_and_pass_sizes(spark, frame):
    df = spark.createDataFrame(frame)
    first = quantile_values(df, ["wide", "gappy"], PROBS)
    for parts, rows in ((1, 1_000_000), (7, 50), (3, 2)):
        assert quantile_values(df.repartition(parts), ["wide", "gappy"], PROBS, exact_rows=rows) == first

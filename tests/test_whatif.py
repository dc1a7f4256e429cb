import numpy as np
import pytest
from pyspark.sql import functions as F

from plantlens.functions.features import energy_signal
from plantlens.functions.hashing import digest, words4
from plantlens.operators import whatif
from plantlens.operators.scoring import RAW_DEFAULTS, complete_points

INPUTS = list(whatif.SENSOR_SPEC)


@pytest.fixture(scope="module")
def points(spark):
    rows = [(i, 0.3 + 0.05 * i, 40.0 + i, 60.0, 1.2) for i in range(8)]
    return spark.createDataFrame(rows, ["point_id", *INPUTS]).cache()


def score(df):
    return complete_points(df, RAW_DEFAULTS["energy"], temp_mean=0.0).withColumn("prediction", energy_signal())


def energy(load, cycle, temp, speed):
    return (10 + 20 * load + 3.5 * load**2 + 0.1 * temp + 0.09 * cycle + 1.4 * speed + 2 * 0.5 + 0.8 - 1.5 * 0.9 + 4 * load * 0.5 + 0.04 * temp * load)


@pytest.fixture(scope="module")
def sampled(points):
    return whatif.draws(points, "point_id").toPandas()


def test_draws(sampled):
    assert len(sampled) == 8 * 300
    assert sampled["production_load__s"].between(0.3, 1.0).all()
    temps = sampled["machine_temperature__s"]
    assert abs(temps.mean() - 60) < 0.2 and abs(temps.std() - 2) < 0.1
    relative = sampled[sampled.point_id == 5]["axis_speed__s"].std()
    assert abs(relative - 0.024) < 0.004


def test_summary_sensitivity_tornado(points, sampled):
    for c in INPUTS:
        sampled[f"{c}__one"] = energy(*[sampled[f"{x}__s"] if x == c else sampled[x] for x in INPUTS])
    sampled["y"] = energy(*[sampled[f"{x}__s"] for x in INPUTS])
    groups = sampled.groupby("point_id")
    for r in whatif.uncertainty_summary(points, "point_id", score).collect():
        y = groups.get_group(r["point_id"])["y"]
        np.testing.assert_allclose([r["mean"], r["std"], r["p5"], r["p95"]], [y.mean(), y.std(ddof=0), *np.percentile(y, [5, 95])])
    for r in whatif.sensitivity(points, "point_id", score).collect():
        assert r["std"] == pytest.approx(groups.get_group(r["point_id"])[f"{r['input']}__one"].std(ddof=0))
    swings = whatif.rank_inputs(whatif.tornado(points, "point_id", score), "point_id", "swing")
    for r in swings.collect():
        part = groups.get_group(r["point_id"])
        ends = np.percentile(part[f"{r['input']}__s"], [5, 95])
        low, high = (energy(*[e if x == r["input"] else part[x].iloc[0] for x in INPUTS]) for e in ends)
        assert r["swing"] == pytest.approx(abs(high - low))
    assert swings.groupBy("point_id").agg(F.max("rank")).where("`max(rank)` <> 4").count() == 0


def test_draws_are_not_shuffled(points):
    plan = whatif.uncertainty_summary(points, "point_id", score)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_untrained_model_gives_the_floor(points):
    row = whatif.uncertainty_summary(points, "point_id", None, n_draws=10).first()
    assert (row["mean"], row["std"], row["p5"]) == pytest.approx((0.01, 0.0, 0.01))


def test_tornado_draws_never_become_rows(points):
    plan = whatif.tornado(points, "point_id", score)._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "sequence" not in plan.lower() and "300" not in plan


def test_tornado_of_repeated_and_missing_keys_and_values(spark):
    """Rows of one key share its draws, a missing value has none, NaN counts as the largest."""
    rows = [(1, 0.5, 40.0, 60.0, 1.0), (1, 0.9, 41.0, None, 1.0), (2, None, 40.0, float("nan"), 1.0), (None, 0.4, 50.0, 70.0, 2.0), (3, float("inf"), 9.0, 60.0, 0.1)]
    df = spark.createDataFrame(rows, "point_id int, " + ", ".join(f"{c} double" for c in INPUTS))
    ends = F.array(F.lit(0.05), F.lit(0.95))
    plain = whatif.draws(df, "point_id").groupBy("point_id").agg(*[F.percentile(f"{c}__s", ends).alias(c) for c in INPUTS])
    want = {(r["point_id"], c): None if r[c] is None else r[c][1] - r[c][0] for r in plain.collect() for c in INPUTS}

    def changed(rows):
        return rows.withColumn("prediction", F.element_at(F.create_map(*[x for c in INPUTS for x in (F.lit(c), F.col(c) + 1000.0)]), F.col("input")))

    got = {(r["point_id"], r["input"]): r["swing"] for r in whatif.tornado(df, "point_id", changed).collect()}
    assert got.keys() == want.keys()
    for k, x in want.items():
        assert (x is None and got[k] is None) or got[k] == pytest.approx(x, abs=1e-9)


def test_draws_need_no_base_conversion(points):
    """Eight hex digits become a number by a checksum undone, the same number as by ``conv``."""
    assert "conv(" not in whatif.draws(points, "point_id")._jdf.queryExecution().optimizedPlan().toString()
    text = points.sparkSession.range(3000).select(digest(42, "id").alias("d"))
    for r in text.select("d", F.array(*words4(F.col("d"))).alias("w")).collect():
        assert r["w"] == [int(r["d"][8 * i : 8 * i + 8], 16) for i in range(4)]


def test_listed_and_counted_percentiles_are_equal(spark, monkeypatch):
    """Repeated and missing keys and missing values: lists for few draws a key, counts by value for many."""
    rows = [(1, 0.5, 40.0, 60.0, 1.0), (1, 0.9, 41.0, None, 1.0), (1, 0.5, 40.0, 60.0, 1.0), (2, None, 40.0, 60.0, 1.0), (None, 0.4, 50.0, 70.0, 2.0), (None, 0.6, 50.0, 70.0, 2.0), (3, 0.5, 9.0, float("nan"), 0.1)]
    df = spark.createDataFrame(rows, "point_id int, " + ", ".join(f"{c} double" for c in INPUTS))
    listed = whatif.uncertainty_summary(df, "point_id", score, n_draws=30)
    monkeypatch.setattr(whatif, "LISTED", 89)
    counted = whatif.uncertainty_summary(df, "point_id", score, n_draws=30)
    plans = [f._jdf.queryExecution().optimizedPlan().toString() for f in (listed, counted)]
    assert ["collect_list" in p for p in plans] == [True, False]
    key = lambda r: str(r["point_id"])
    assert [str(r) for r in sorted(listed.collect(), key=key)] == [str(r) for r in sorted(counted.collect(), key=key)]

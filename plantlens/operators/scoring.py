"""Completing operating points and scoring them in bulk."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantlens.functions.features import add_features
from plantlens.functions.scalar import floor_prediction

# Defaults of the inputs beyond the four primary ones.
RAW_DEFAULTS = {
    "energy": {"tool_wear": 0.5, "ambient_humidity": 50.0, "vibration_level": 1.0, "power_factor": 0.9},
    "efficiency": {"vibration_signal": 1.0, "power_factor": 0.9},
    "emission": {"power_factor": 0.9},
    "maintenance": {"vibration_level": 1.0, "tool_wear": 0.5, "oil_quality": 0.7, "pressure": 100.0},
}

# A scorer adds ``prediction`` to a table of completed points; a fitted model's ``transform``
# is one, and so is ``column_scorer`` around an expression.
Scorer = Callable[[DataFrame], DataFrame]


def column_scorer(expression: Column) -> Scorer:
    return lambda df: df.withColumn("prediction", expression)


def complete_points(
    points: DataFrame,
    defaults: Mapping[str, float],
    overrides: Mapping[str, float] | None = None,
    feature_order: Sequence[str] | None = None,
    temp_mean: float | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Fill, derive and order the features of operating points.

    A value in the point's own row wins, then the override, then the default. Features the
    points never had become 0.0. ``defaults`` may be task defaults or training means.
    """
    given = dict(defaults) | dict(overrides or {})
    have = set(points.columns)
    filled = points.withColumns(
        {c: (F.coalesce(F.col(c).cast("double"), F.lit(v)) if c in have else F.lit(float(v))) for c, v in given.items()}
    )
    if temp_mean is None and feature_order and "temperature_deviation" not in {*feature_order, *keep}:
        temp_mean = 0.0  # nothing asks for the deviation, so its mean need not be read from the points
    derived = add_features(filled, temp_mean)
    if not feature_order:
        return derived
    lacking = {c: F.lit(0.0) for c in feature_order if c not in derived.columns}
    if lacking:
        derived = derived.withColumns(lacking)
    return derived.select(*[c for c in keep if c not in feature_order], *feature_order)


def score_points(points: DataFrame, scorer: Scorer | None, name: str = "prediction", floor: bool = False) -> DataFrame | None:
    """Scored points, ``None`` for an untrained model; energy results are floored."""
    if scorer is None:
        return None
    scored = scorer(points)
    value = floor_prediction(F.col("prediction")) if floor else F.col("prediction")
    return scored.withColumn("prediction", value).withColumnRenamed("prediction", name)


def score_tasks(points: DataFrame, scorers: Mapping[str, Scorer], prepare: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """The same points scored by several task models, one ``<task>`` column each, in one projection chain."""
    base = list(points.columns)
    out = points
    done: list[str] = []
    for task, scorer in scorers.items():
        scored = score_points(prepare(out, task), scorer, task, floor=task == "energy")
        done.append(task)
        out = scored.select(*base, *done)
    return out

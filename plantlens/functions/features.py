"""Derived sensor features; an absent input column leaves its feature out."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantlens.sources.schemas import numeric_columns

# Fixed value: keeps the speed-per-load ratio finite at zero load.
LOAD_EPSILON = 1e-6


def temperature_mean(df: DataFrame) -> float | None:
    """The mean the deviation feature is centred on; fit once, then stored with the model."""
    if "machine_temperature" not in df.columns:
        return None
    return df.agg(F.avg("machine_temperature")).first()[0]


def add_features(df: DataFrame, temp_mean: float | None = None) -> DataFrame:
    """Append the derived features.

    ``temp_mean`` is the stored training mean; without one it is taken from ``df`` itself.
    """
    have = set(df.columns)
    if "machine_temperature" in have and temp_mean is None:
        temp_mean = temperature_mean(df)

    load, temp = F.col("production_load"), F.col("machine_temperature")
    speed, wear = F.col("axis_speed"), F.col("tool_wear")
    vibration = F.col("vibration_signal" if "vibration_signal" in have else "vibration_level")
    recipes: list[tuple[str, set[str], Column]] = [
        ("load_squared", {"production_load"}, load * load),
        ("temperature_deviation", {"machine_temperature"}, temp - F.lit(temp_mean)),
        ("speed_per_load", {"axis_speed", "production_load"}, speed / (load + LOAD_EPSILON)),
        ("thermal_load", {"production_load", "machine_temperature"}, load * temp),
        ("mechanical_stress", {"axis_speed"}, vibration * speed),
        ("wear_index", {"tool_wear", "vibration_level"}, wear * F.col("vibration_level")),
        ("effective_power", {"production_load", "axis_speed", "power_factor"}, load * speed * F.col("power_factor")),
    ]
    if not have & {"vibration_signal", "vibration_level"}:
        recipes = [r for r in recipes if r[0] != "mechanical_stress"]
    return df.withColumns({name: value for name, needs, value in recipes if needs <= have})


def add_missing_indicators(df: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """``<col>_was_missing`` (0/1) for every numeric column holding a NULL; one pass decides."""
    columns = numeric_columns(df, exclude)
    if not columns:
        return df
    gaps = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
    return df.withColumns({f"{c}_was_missing": F.col(c).isNull().cast("int") for c in columns if gaps[c]})


def linear_signal(
    intercept: float,
    weights: Mapping[str, float],
    products: Mapping[tuple[str, str], float] | None = None,
) -> Column:
    """Weighted sum of columns and of column pairs."""
    terms = [F.lit(w) * F.col(c) for c, w in weights.items()]
    terms += [F.lit(w) * F.col(a) * F.col(b) for (a, b), w in (products or {}).items()]
    return reduce(lambda total, term: total + term, terms, F.lit(float(intercept)))


def energy_signal() -> Column:
    """Noise-free energy demand in kWh."""
    # Weights of the energy formula.
    return linear_signal(
        10.0,
        {
            "production_load": 20.0,
            "machine_temperature": 0.10,
            "cycle_time": 0.09,
            "axis_speed": 1.4,
            "tool_wear": 2.0,
            "vibration_level": 0.8,
            "power_factor": -1.5,
        },
        {
            ("production_load", "production_load"): 3.5,
            ("production_load", "tool_wear"): 4.0,
            ("machine_temperature", "production_load"): 0.04,
        },
    )


def efficiency_signal() -> Column:
    # Weights of the efficiency formula; -0.6 * vibration * (1 - power_factor) is written out.
    return linear_signal(
        0.0,
        {
            "power_factor": 2.5,
            "axis_speed": 0.7,
            "cycle_time": -0.04,
            "machine_temperature": -0.05,
            "vibration_signal": -0.28 - 0.6,
            "production_load": 0.9,
        },
        {("vibration_signal", "power_factor"): 0.6},
    )


def emission_signal() -> Column:
    # Weights of the emission formula.
    return linear_signal(
        0.0,
        {
            "production_load": 15.0,
            "machine_temperature": 0.04,
            "axis_speed": 0.40,
            "cycle_time": 0.025,
            "power_factor": -1.2,
        },
        {("production_load", "machine_temperature"): 5.0 / 120},
    )


def maintenance_signal() -> Column:
    # Weights of the maintenance formula; -0.8 * oil * (1 - wear) is written out.
    return linear_signal(
        0.0,
        {
            "vibration_level": 0.70,
            "machine_temperature": 0.04,
            "tool_wear": 1.20,
            "oil_quality": -1.00 - 0.80,
            "pressure": 0.015,
            "production_load": 0.30,
        },
        {("tool_wear", "vibration_level"): 1.50, ("oil_quality", "tool_wear"): 0.80},
    )

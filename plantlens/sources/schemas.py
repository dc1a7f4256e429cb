"""Column contracts of the four sensor tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, NumericType, StringType, StructField, StructType

# Required columns per task, in declared order; the last one is the target.
REQUIRED_COLUMNS = {
    "energy": [
        "production_load",
        "cycle_time",
        "machine_temperature",
        "axis_speed",
        "tool_wear",
        "ambient_humidity",
        "vibration_level",
        "power_factor",
        "energy",
    ],
    "efficiency": [
        "production_load",
        "cycle_time",
        "machine_temperature",
        "axis_speed",
        "vibration_signal",
        "power_factor",
        "efficiency_class",
    ],
    "emission": [
        "production_load",
        "cycle_time",
        "machine_temperature",
        "axis_speed",
        "power_factor",
        "emission_class",
    ],
    "maintenance": [
        "production_load",
        "machine_temperature",
        "axis_speed",
        "vibration_level",
        "tool_wear",
        "oil_quality",
        "pressure",
        "maintenance_class",
    ],
}

# Targets in the order in which they are looked for.
TARGETS = ["energy", "efficiency_class", "emission_class", "maintenance_class"]


def task_schema(task: str) -> StructType:
    return StructType(
        [StructField(c, StringType() if c.endswith("_class") else DoubleType()) for c in REQUIRED_COLUMNS[task]]
    )


def task_target(task: str) -> str:
    return REQUIRED_COLUMNS[task][-1]


def missing_columns(df: DataFrame, task: str) -> list[str]:
    """Required columns the table lacks, in declared order."""
    return [c for c in REQUIRED_COLUMNS[task] if c not in df.columns]


def require_columns(df: DataFrame, task: str) -> DataFrame:
    missing = missing_columns(df, task)
    if missing:
        raise ValueError(f"Incorrect dataset for task '{task}'. Missing columns: {', '.join(missing)}")
    return df


def find_target(df: DataFrame) -> str | None:
    """The first known target the table holds."""
    return next((t for t in TARGETS if t in df.columns), None)


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] | list[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in exclude]

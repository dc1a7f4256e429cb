"""Reading sensor tables and reports."""

from __future__ import annotations

import json
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing readings are NULL everywhere downstream; NaN would count as a value."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def load_dataset(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """CSV with a header (also parquet and JSON lines), chosen by the case-insensitive suffix."""
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    suffix = name.rsplit(".", 1)[-1] if "." in name else ""
    if suffix == "csv":
        reader = spark.read.option("header", True)
        df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    elif suffix == "parquet":
        df = spark.read.parquet(path)
    elif suffix in ("json", "jsonl"):
        df = spark.read.schema(schema).json(path) if schema else spark.read.json(path)
    else:
        shown = suffix.upper() or "unknown"
        raise ValueError(f"Unsupported file format: .{shown}. Use .csv, .parquet or .json; export other formats to CSV.")
    return nan_to_null(df)


def preview(df: DataFrame, rows: int = 5) -> DataFrame:
    return df.limit(rows)


def save_json(spark: SparkSession, path: str, data: dict[str, Any]) -> None:
    """One flat report as a JSON-lines folder."""
    line = json.dumps(data)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_json(spark: SparkSession, path: str) -> DataFrame | None:
    """The report as a one-row table, ``None`` when there is none."""
    try:
        return spark.read.json(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise

"""Shared pieces of the registered queries: table access, rounding, sensor views of the tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plantlens.functions.hashing import uniform
from plantlens.functions.scalar import fixed
from plantlens.session import importable


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL where SQL can say it."""

    def add(fn: Callable[[SparkSession, str], DataFrame]):
        @wraps(fn)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            importable(spark)
            return fn(spark, sf)

        QUERIES[fn.__name__] = run
        if sql is not None:
            SQL[fn.__name__] = sql
        return run

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r4(c: Column | str, name: str, digits: int = 4) -> Column:
    return fixed(F.col(c) if isinstance(c, str) else c, digits).alias(name)


def s4(expression: str, digits: int = 4) -> str:
    """The same rounding in SQL."""
    unit = 10**digits
    return f"floor(({expression}) * {unit}.0::DOUBLE + 0.5::DOUBLE) / {unit}.0::DOUBLE"


def sql_uniform(seed: str, key: str) -> str:
    return f"(('0x' || substr(md5('{seed}-' || {key}::VARCHAR), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE)"


def sql_permuted(rows: str, key: str, n: str, names: list[str], seed: int = 42) -> str:
    """(id, name, x): the place of ``key`` in the keyed permutation of each name, by a recursive walk."""
    left, right = "(x // a)", "(x % a)"
    for step in range(1, 5):
        digest = f"('0x' || substr(md5('{seed}-' || name || '-{step}-' || {right}::VARCHAR), 1, 7))::BIGINT"
        left, right = right, f"(({left} + {digest}) % a)"
    turn = f"{left} * a + {right}"
    listed = ", ".join(f"('{name}')" for name in names)
    return f"""(WITH RECURSIVE s AS (SELECT {key} AS id, name, {key}::BIGINT % n AS x, n, ceil(sqrt(n))::BIGINT AS a FROM {rows}, (SELECT ({n})::BIGINT AS n), (VALUES {listed}) d(name)),
      w AS (SELECT id, name, {turn} AS x, n, a FROM s UNION ALL SELECT id, name, {turn}, n, a FROM w WHERE x >= n) SELECT id, name, x, n FROM w WHERE x < n)"""


SENSOR_RANGES = {
    "cycle_time": (20.0, 80.0),
    "axis_speed": (0.2, 3.0),
    "tool_wear": (0.0, 1.0),
    "ambient_humidity": (20.0, 90.0),
    "vibration_level": (0.5, 4.0),
    "vibration_signal": (0.1, 5.0),
    "power_factor": (0.5, 1.0),
    "oil_quality": (0.1, 1.0),
    "pressure": (60.0, 150.0),
}


def order_sensors(spark: SparkSession, sf: str) -> DataFrame:
    """One sensor reading per order: load from its price, the other inputs from its key's hash."""
    orders = table(spark, sf, "orders")
    load = 0.3 + 0.7 * F.col("o_totalprice") / 500000.0
    columns = {
        c: F.lit(lo) + F.lit(hi - lo) * uniform(c, "o_orderkey") for c, (lo, hi) in SENSOR_RANGES.items()
    }
    base = orders.select(F.col("o_orderkey").alias("row_id"), "o_orderkey", load.alias("production_load"))
    heat = 30.0 + 55.0 * F.col("production_load") + 20.0 * (uniform("heat", "o_orderkey") - 0.5)
    return base.withColumns(columns).withColumn("machine_temperature", heat).drop("o_orderkey")


def sql_order_sensors() -> str:
    columns = ", ".join(
        f"{lo}::DOUBLE + {hi - lo}::DOUBLE * {sql_uniform(c, 'o_orderkey')} AS {c}" for c, (lo, hi) in SENSOR_RANGES.items()
    )
    load = "0.3::DOUBLE + 0.7::DOUBLE * o_totalprice / 500000.0::DOUBLE"
    heat = f"30.0::DOUBLE + 55.0::DOUBLE * ({load}) + 20.0::DOUBLE * ({sql_uniform('heat', 'o_orderkey')} - 0.5::DOUBLE)"
    return f"(SELECT o_orderkey AS row_id, {load} AS production_load, {columns}, {heat} AS machine_temperature FROM orders)"


def gappy_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events as readings: two numeric columns, some values missing."""
    value = F.when(F.col("event_type") != "error", F.col("value"))
    level = F.when(F.col("event_type") != "signup", F.sqrt(F.col("value") + 1.0) * 3.0)
    return table(spark, sf, "events").select(
        "event_id", value.alias("reading"), level.alias("level"), F.col("user_id").cast("double").alias("unit"), "event_type"
    )


SQL_GAPPY_EVENTS = """(SELECT event_id,
    CASE WHEN event_type <> 'error' THEN value END AS reading,
    CASE WHEN event_type <> 'signup' THEN sqrt(value + 1.0::DOUBLE) * 3.0::DOUBLE END AS level,
    user_id::DOUBLE AS unit, event_type FROM events)"""


def point_table(spark: SparkSession, sf: str) -> DataFrame:
    """One operating point per part."""
    p = table(spark, sf, "part")
    return p.select(
        F.col("p_partkey").alias("point_id"),
        (0.3 + 0.7 * F.col("p_size") / 50.0).alias("production_load"),
        (20.0 + 60.0 * (F.col("p_retailprice") - 900.0) / 100.0).alias("cycle_time"),
        (30.0 + 90.0 * uniform("temp", "p_partkey")).alias("machine_temperature"),
        (0.2 + 2.8 * uniform("speed", "p_partkey")).alias("axis_speed"),
    )


SQL_POINTS = f"""(SELECT p_partkey AS point_id,
    0.3::DOUBLE + 0.7::DOUBLE * p_size / 50.0::DOUBLE AS production_load,
    20.0::DOUBLE + 60.0::DOUBLE * (p_retailprice - 900.0::DOUBLE) / 100.0::DOUBLE AS cycle_time,
    30.0::DOUBLE + 90.0::DOUBLE * {sql_uniform('temp', 'p_partkey')} AS machine_temperature,
    0.2::DOUBLE + 2.8::DOUBLE * {sql_uniform('speed', 'p_partkey')} AS axis_speed FROM part)"""


def energy_sql(load="production_load", cycle="cycle_time", temp="machine_temperature", speed="axis_speed",
               wear="0.5", vibration="1.0", power="0.9") -> str:
    """The energy formula in SQL."""
    return (
        f"(10.0::DOUBLE + 20.0::DOUBLE*({load}) + 0.10::DOUBLE*({temp}) + 0.09::DOUBLE*({cycle}) + 1.4::DOUBLE*({speed})"
        f" + 2.0::DOUBLE*({wear}) + 0.8::DOUBLE*({vibration}) - 1.5::DOUBLE*({power}) + 3.5::DOUBLE*({load})*({load})"
        f" + 4.0::DOUBLE*({load})*({wear}) + 0.04::DOUBLE*({temp})*({load}))"
    )

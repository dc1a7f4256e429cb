"""Scalar column functions: clipping, ordinal labels, rates, rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ordinal classes, smallest prediction, default rates and their allowed ranges.
CLASS_ORDER = ["Low", "Medium", "High"]
PREDICTION_FLOOR = 0.01
PRICE_RATE = 10.0
CO2_FACTOR = 0.85
PRICE_RANGE = (1.0, 50.0)
CO2_RANGE = (0.1, 2.0)


def clip(x: Column, lo: Column | float | None, hi: Column | float | None) -> Column:
    """NULL stays NULL, unlike ``least``/``greatest`` which skip it."""
    out = x
    if lo is not None:
        out = F.when(x < lo, lo).otherwise(out)
    if hi is not None:
        out = F.when(x > hi, hi).otherwise(out)
    return out


def floor_prediction(x: Column, lowest: float = PREDICTION_FLOOR) -> Column:
    return F.when(x < lowest, F.lit(lowest)).otherwise(x)


def _in_range(name: str, value: float, bounds: tuple[float, float]) -> float:
    if not bounds[0] <= value <= bounds[1]:
        raise ValueError(f"{name} must lie in [{bounds[0]}, {bounds[1]}], got {value}")
    return float(value)


def energy_cost(kwh: Column, price_rate: float = PRICE_RATE) -> Column:
    return kwh * F.lit(_in_range("price_rate", price_rate, PRICE_RANGE))


def grid_emission(kwh: Column, co2_factor: float = CO2_FACTOR) -> Column:
    return kwh * F.lit(_in_range("co2_factor", co2_factor, CO2_RANGE))


def scale_to_unit(x: Column, lo: float, hi: float) -> Column:
    return (x - lo) / (hi - lo)


def _rank_of(label: Column) -> Column:
    chain = F.when(label == CLASS_ORDER[0], 0)
    for i, name in enumerate(CLASS_ORDER[1:], 1):
        chain = chain.when(label == name, i)
    return chain


def encode_ordinal(label: Column) -> Column:
    """Low/Medium/High to 0/1/2, anything else (NULL too) to -1."""
    return _rank_of(label).otherwise(-1)


def decode_ordinal(code: Column) -> Column:
    chain = F.when(code == 0, CLASS_ORDER[0])
    for i, name in enumerate(CLASS_ORDER[1:], 1):
        chain = chain.when(code == i, name)
    return chain


def label_score(value: Column, unknown: str = "zero") -> Column:
    """Label or number to a score. Other text is 0, or with ``unknown='number'`` parsed as a number."""
    text = value.cast("string")
    number = text.try_cast("double")
    if unknown == "number":
        return F.coalesce(_rank_of(text).cast("double"), number)
    if unknown != "zero":
        raise ValueError("unknown must be 'zero' or 'number'")
    return F.coalesce(_rank_of(text).cast("double"), number, F.when(text.isNotNull(), F.lit(0.0)))


def display_round(x: Column, digits: int = 4) -> Column:
    """Half-even rounding of shown figures."""
    return F.bround(x, digits)


def display_percent(x: Column) -> Column:
    return F.concat(F.format_number(x * 100, 2), F.lit("%"))


def fixed(x: Column, digits: int = 4) -> Column:
    """Round half up by plain arithmetic, the same in every engine."""
    unit = float(10**digits)
    return F.floor(x * unit + 0.5) / F.lit(unit)

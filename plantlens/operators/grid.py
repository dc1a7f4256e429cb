"""Stratified candidate grid and best-candidate choice."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.functions.hashing import permuted, uniform

# Search bounds of the four operating inputs.
SEARCH_BOUNDS = {
    "production_load": (0.3, 1.0),
    "cycle_time": (20.0, 80.0),
    "machine_temperature": (30.0, 120.0),
    "axis_speed": (0.2, 3.0),
}


def stratified_grid(
    ids: DataFrame,
    n: int,
    bounds: Mapping[str, tuple[float, float]] = SEARCH_BOUNDS,
    id_column: str = "id",
    seed: int = 42,
) -> DataFrame:
    """One point per id 0..n-1; in every dimension each of the n equal strata holds exactly one, in an order of its own."""
    if n > 3_000_000_000:
        raise ValueError("the stratum arithmetic is exact up to 3e9 points")
    columns = {}
    for name, (lo, hi) in bounds.items():
        spot = (permuted(F.col(id_column), n, name, seed).cast("double") + uniform(f"{seed}-{name}", id_column)) / F.lit(float(n))
        columns[name] = F.lit(lo) + spot * F.lit(hi - lo)
    return ids.select(id_column).withColumns(columns)


def candidate_grid(spark, n: int, bounds: Mapping[str, tuple[float, float]] = SEARCH_BOUNDS, seed: int = 42) -> DataFrame:
    return stratified_grid(spark.range(n), n, bounds, "id", seed)


def best_candidate(df: DataFrame, score: str, key: str, objective: str = "min", by: Sequence[str] = ()) -> DataFrame:
    """The row with the smallest or largest score (per group), ties to the smallest key."""
    if objective not in ("min", "max"):
        raise ValueError("objective must be 'min' or 'max'")
    rank = F.col(score) if objective == "min" else -F.col(score)
    scored = df.where(F.col(score).isNotNull())
    row = F.struct(*[c for c in df.columns if c not in by])
    best = scored.groupBy(*by).agg(F.min_by(row, F.struct(rank, F.col(key))).alias("best"))
    return best.where(F.col("best").isNotNull()).select(*by, "best.*")

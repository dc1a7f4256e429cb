"""Uncertainty, sensitivity and tornado analysis of a table of operating points.

Points are hash-partitioned by id once; draws are exploded, scored and aggregated inside
those partitions, so the (points x draws) rows are never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantlens.functions.hashing import HEX_8, box_muller, uniforms4
from plantlens.functions.scalar import PREDICTION_FLOOR, clip, floor_prediction
from plantlens.operators.scoring import Scorer

# Measurement uncertainty (kind, standard deviation) and bounds of each input, draws.
SENSOR_SPEC = {
    "production_load": ("relative", 0.03),
    "cycle_time": ("absolute", 0.5),
    "machine_temperature": ("absolute", 2.0),
    "axis_speed": ("relative", 0.02),
}
INPUT_BOUNDS = {
    "production_load": (0.3, 1.0),
    "cycle_time": (10.0, 90.0),
    "machine_temperature": (20.0, 120.0),
    "axis_speed": (0.2, 3.0),
}
DRAWS = 300
SEED = 42

# Draws one task explodes, scores and aggregates.
DRAWS_PER_TASK = 5_000_000
# Draws of one key up to which they are listed and ordered; those of a key with more (many rows share it) are counted by value.
LISTED = 10_000
# Shares of the draws at the ends of a spread, between which a tornado swings, and points whose draws a task holds at a time.
ENDS = (0.05, 0.95)
HEADS = 1_000


def _drawn(name: str, normal: Column, spec: Mapping, bounds: Mapping) -> Column:
    kind, std = spec[name]
    measured = F.col(name).cast("double")
    spread = F.lit(std) * F.abs(measured) if kind == "relative" else F.lit(std)
    lo, hi = bounds[name]
    return clip(measured + spread * normal, F.lit(lo), F.lit(hi))


def _dealt(points: DataFrame, key: str, n_draws: int) -> DataFrame:
    """Points partitioned by key.

    The partition number is given outright, from the number of points: left to itself the
    session would size it by the points and not by the draws.
    """
    usual = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return points.repartition(max(usual, -(-points.count() * n_draws // DRAWS_PER_TASK)), key)


def draws(
    points: DataFrame,
    key: str,
    n_draws: int = DRAWS,
    seed: int = SEED,
    spec: Mapping = SENSOR_SPEC,
    bounds: Mapping = INPUT_BOUNDS,
) -> DataFrame:
    """``n_draws`` rows per point: column ``draw`` and a sampled ``<input>__s`` beside each input."""
    headed = _dealt(points, key, n_draws).withColumn("head__", F.concat_ws("-", F.lit(str(seed)), F.col(key)))
    numbered = headed.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n_draws))))
    text = numbered.withColumn("digest__", F.md5(F.concat("head__", F.lit("-"), F.col("draw").cast("string"))))
    chance = [f"u{i}__" for i in range(4)]
    even = text.withColumns(dict(zip(chance, uniforms4(F.col("digest__")))))
    normal = dict(zip(spec, box_muller([F.col(u) for u in chance])))
    return even.withColumns({f"{c}__s": _drawn(c, normal[c], spec, bounds) for c in spec}).drop("head__", "digest__", *chance)


def _scored(df: DataFrame, scorer: Scorer | None) -> DataFrame:
    if scorer is None:
        return df.withColumn("prediction", F.lit(PREDICTION_FLOOR))
    return scorer(df).withColumn("prediction", floor_prediction(F.col("prediction")))


def simulate(points: DataFrame, key: str, scorer: Scorer | None, n_draws: int = DRAWS, seed: int = SEED, **kw) -> DataFrame:
    """Every draw's floored prediction; an untrained model gives the floor."""
    sampled = draws(points, key, n_draws, seed, **kw)
    inputs = kw.get("spec", SENSOR_SPEC)
    return _scored(sampled.withColumns({c: F.col(f"{c}__s") for c in inputs}), scorer)


def uncertainty_summary(
    points: DataFrame, key: str, scorer: Scorer | None, n_draws: int = DRAWS, seed: int = SEED, **kw
) -> DataFrame:
    """Mean, population deviation, P5 and P95 per point (a point's draws are bounded by ``n_draws``)."""
    runs = simulate(points, key, scorer, n_draws, seed, **kw)
    most = points.groupBy(key).count().agg(F.max("count")).first()[0] or 0
    if most * n_draws <= LISTED:
        spread, ends = F.sort_array(F.collect_list("prediction")), [_end(F.col("p"), share) for share in ENDS]
    else:
        spread, ends = F.percentile("prediction", F.array(*map(F.lit, ENDS))), [F.col("p")[0], F.col("p")[1]]
    return (
        runs.groupBy(key)
        .agg(F.avg("prediction").alias("mean"), F.stddev_pop("prediction").alias("std"), spread.alias("p"))
        .select(key, "mean", "std", ends[0].alias("p5"), ends[1].alias("p95"))
    )


def _end(ordered: Column, share: float) -> Column:
    """The percentile of an ordered array, interpolated as ``percentile`` does; NULL of an empty one."""
    spot = F.lit(share) * (F.size(ordered) - 1)
    below, above = F.floor(spot), F.ceil(spot)
    low, high = F.get(ordered, below.cast("int")), F.get(ordered, above.cast("int"))
    return F.when(low == high, low).otherwise((above - spot) * low + (spot - below) * high)


def _one_at_a_time(sampled: DataFrame, inputs: Sequence[str], value_of) -> DataFrame:
    """One row per input, that input replaced by ``value_of(input)``, the others nominal."""
    options = [
        F.struct(F.lit(name).alias("input"), *[(value_of(c) if c == name else F.col(c)).cast("double").alias(c) for c in inputs])
        for name in inputs
    ]
    rest = [c for c in sampled.columns if c not in inputs]
    return sampled.select(*rest, F.explode(F.array(*options)).alias("o__")).select(*rest, "o__.*")


def sensitivity(points: DataFrame, key: str, scorer: Scorer, n_draws: int = DRAWS, seed: int = SEED, **kw) -> DataFrame:
    """Deviation of the prediction per point when one input varies and the rest stay nominal."""
    inputs = list(kw.get("spec", SENSOR_SPEC))
    varied = _one_at_a_time(draws(points, key, n_draws, seed, **kw), inputs, lambda c: F.col(f"{c}__s"))
    runs = _scored(varied, scorer)
    return runs.groupBy(key, "input").agg(F.stddev_pop("prediction").alias("std"))


def _normals(heads: list[str], n_draws: int) -> np.ndarray:
    """Standard normals of each head's draws (heads x draws x 4), the numbers of ``normals4``."""
    tails = [str(i).encode() for i in range(1, n_draws + 1)]
    digests = b"".join([hashlib.md5(head + tail).digest() for head in map(str.encode, heads) for tail in tails])
    u = (np.frombuffer(digests, ">u4").reshape(len(heads), n_draws, 2, 2).astype(float) + 0.5) / HEX_8
    radius, angle = np.sqrt(-2.0 * np.log(u[..., 0])), 2.0 * np.pi * u[..., 1]
    return np.stack([radius * np.cos(angle), radius * np.sin(angle)], axis=-1).reshape(len(heads), n_draws, 4)


def _ends(drawn: np.ndarray) -> np.ndarray:
    """P5 and P95 along axis 1, interpolated as ``percentile`` does."""
    ordered, out = np.sort(drawn, axis=1), []
    for p in ENDS:
        spot = p * (drawn.shape[1] - 1)
        low, high = int(np.floor(spot)), int(np.ceil(spot))
        out.append(ordered[:, low] if low == high else np.where(ordered[:, low] == ordered[:, high], ordered[:, low], (high - spot) * ordered[:, low] + (spot - low) * ordered[:, high]))
    return np.stack(out, axis=-1)


def _draw_ends(inputs: Sequence[str], n_draws: int, seed: int, spec: Mapping, bounds: Mapping):
    """(key as text, list of the key's points) to P5 and P95 of the draws of each input, one input after the other; NULL without a measured value."""

    def drawn(measured: np.ndarray, name: str, normal: np.ndarray) -> np.ndarray:
        kind, std = spec[name]
        lo, hi = bounds[name]
        spread = std * np.abs(measured) if kind == "relative" else np.full_like(measured, std)
        x = measured[:, None] + spread[:, None] * normal
        return np.where(x > lo, np.where(x < hi, x, hi), np.where(x <= lo, lo, hi))  # NaN counts as the largest

    def run(keys: pa.Array, points: pa.Array) -> pa.Array:
        heads = [f"{seed}-" if k is None else f"{seed}-{k}-" for k in keys.to_pylist()]
        starts, flat = points.offsets.to_numpy(), points.values
        values = [flat.field(c).to_numpy(zero_copy_only=False).astype(float) for c in inputs]
        known = [flat.field(c).is_valid().to_numpy(zero_copy_only=False) for c in inputs]
        out = np.full((len(heads), len(inputs), len(ENDS)), np.nan)
        empty = np.ones((len(heads), len(inputs)), dtype=bool)
        sizes = np.diff(starts)
        for at in range(0, len(heads), HEADS):
            some = np.arange(at, min(at + HEADS, len(heads)))
            normal = _normals([heads[i] for i in some], n_draws)
            for j, name in enumerate(inputs):
                one = sizes[some] == 1
                one[one] = known[j][starts[some[one]]]
                rows = some[one]
                if len(rows):
                    out[rows, j], empty[rows, j] = _ends(drawn(values[j][starts[rows]], name, normal[one, :, j])), False
                for i in np.flatnonzero(sizes[some] > 1):
                    own = slice(starts[some[i]], starts[some[i] + 1])
                    if known[j][own].any():
                        out[some[i], j], empty[some[i], j] = _ends(drawn(values[j][own][known[j][own]], name, normal[i, None, :, j]).reshape(1, -1))[0], False
        width = len(inputs) * len(ENDS)
        cells = pa.array(out.reshape(-1), pa.float64(), mask=np.repeat(empty.reshape(-1), len(ENDS)))
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(heads) * width + 1, width, dtype="int32")), cells)

    return F.arrow_udf(run, "array<double>")


def tornado(
    points: DataFrame,
    key: str,
    scorer: Scorer,
    n_draws: int = DRAWS,
    seed: int = SEED,
    spec: Mapping = SENSOR_SPEC,
    bounds: Mapping = INPUT_BOUNDS,
) -> DataFrame:
    """Swing of the prediction per point and input between the input's P5 and P95.

    A point's draws are the ones of ``draws``, made and ordered beside the point, so they never become rows. Rows that share a key share its draws.
    """
    inputs = list(spec)
    carried = [c for c in points.columns if c != key]
    listed = F.collect_list(F.struct(*[F.col(c).cast("double").alias(c) for c in inputs]))
    ends = _draw_ends(inputs, n_draws, seed, spec, bounds)(F.col(key).cast("string"), F.col("points__"))
    ranges = _dealt(points, key, n_draws).groupBy(key).agg(*[F.first(c).alias(c) for c in carried], listed.alias("points__")).withColumn("ends__", ends).drop("points__")
    two = ranges.withColumn("end__", F.explode(F.array(F.lit(0), F.lit(1))))
    at = {c: F.lit(len(ENDS) * i) + F.col("end__") for i, c in enumerate(inputs)}
    varied = _one_at_a_time(two, inputs, lambda c: F.get("ends__", at[c]))
    runs = _scored(varied, scorer)
    low = F.max(F.when(F.col("end__") == 0, F.col("prediction")))
    high = F.max(F.when(F.col("end__") == 1, F.col("prediction")))
    return runs.groupBy(key, "input").agg(F.abs(high - low).alias("swing"))


def rank_inputs(effects: DataFrame, key: str, value: str) -> DataFrame:
    """Rank of each input within its point, smallest effect first (four rows per point)."""
    order = Window.partitionBy(key).orderBy(value, "input")
    return effects.withColumn("rank", F.row_number().over(order))

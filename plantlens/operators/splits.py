"""Exact splits and folds by the rank of a key hash, without ranking the table.

The hash value at each cut rank is found as an exact order statistic per stratum, so a
split is a comparison per row: no global sort, no window, no shuffle of rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantlens.functions.hashing import permuted_number, uniform
from plantlens.operators.quantiles import RankRule, order_statistics
from plantlens.session import settle

# Seed, held-out share and number of folds.
SEED = 42
TEST_SHARE = 0.2
FOLDS = 5


def _hash_slices(df: DataFrame, key: str, sizes: Sequence[RankRule], by: Sequence[str], seed: int, name: str) -> DataFrame:
    """Number of cut ranks (cumulative row counts, from ``sizes``) a row's hash rank has reached."""
    tagged = df.withColumn("hash__", uniform(seed, key))
    last_ranks = [lambda n, size=size: size(n) - 1 for size in sizes]
    found = order_statistics(tagged, ["hash__"], last_ranks, by)
    cuts = found.groupBy(*by).agg(
        *[F.max(F.when(F.col("pos") == i, F.col("value"))).alias(f"cut{i}__") for i in range(len(sizes))]
    )
    cuts, rows = settle(cuts)
    if not by:
        values = rows[0] if rows else {}
        passed = [_past(F.col("hash__"), F.lit(values[f"cut{i}__"]).cast("double")) for i in range(len(sizes))] if rows else []
        return tagged.withColumn(name, reduce(lambda a, b: a + b, passed, F.lit(0))).drop("hash__")
    right = cuts.withColumnsRenamed({b: f"{b}__g" for b in by})
    on = reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"{b}__g")) for b in by])
    passed = [_past(F.col("hash__"), F.col(f"cut{i}__")) for i in range(len(sizes))]
    joined = tagged.join(right, on, "left").withColumn(name, reduce(lambda a, b: a + b, passed))
    return joined.select(*df.columns, name)


def _past(h: Column, cut: Column) -> Column:
    """An empty slice has no cut value and is passed by every row."""
    return F.when(cut.isNull() | (h > cut), 1).otherwise(0)


def train_test_split(
    df: DataFrame, key: str, test_share: float = TEST_SHARE, by: Sequence[str] = (), seed: int = SEED
) -> DataFrame:
    """Adds ``split`` (train/test). Plain: the test side rounds up; per label: the train side rounds half up."""
    if by:
        size: RankRule = lambda n: F.floor(n * F.lit(1.0 - test_share) + 0.5)
    else:
        size = lambda n: n - F.ceil(n * F.lit(test_share))
    sliced = _hash_slices(df, key, [size], by, seed, "slice__")
    return sliced.withColumn("split", F.when(F.col("slice__") == 0, "train").otherwise("test")).drop("slice__")


def assign_folds(df: DataFrame, key: str, folds: int = FOLDS, by: Sequence[str] = (), seed: int = SEED) -> DataFrame:
    """Adds ``fold`` 0..folds-1; fold sizes differ by at most one, per stratum when given."""
    sizes = [lambda n, i=i: F.ceil(n * F.lit(i) / F.lit(folds)) for i in range(1, folds)]
    return _hash_slices(df, key, sizes, by, seed, "fold")


def sample_grid(grid: dict[str, Sequence], draws: int, seed: int = SEED) -> list[dict]:
    """Seeded draw without replacement from a hyper-parameter product; the whole grid when smaller.

    Combinations are addressed by index, the first ones of a keyed permutation, so the product is never built.
    """
    names = list(grid)
    total = math.prod(len(grid[n]) for n in names)
    picks = range(total) if draws >= total else [permuted_number(i, total, "draw", seed) for i in range(draws)]
    combos = []
    for index in picks:
        combo = {}
        for name in names:
            index, spot = divmod(index, len(grid[name]))
            combo[name] = grid[name][spot]
        combos.append(combo)
    return combos

"""Exact order statistics and quantiles without sorting or gathering a column.

Every pass counts rows per value range (map-side combined, so one hot value or group costs
no more than any other) and keeps the ranges that hold a wanted rank. The first ranges are
logarithmic, later ones cut the kept range evenly; once a kept range holds few rows, or only
one value, its distinct values are counted and the ranks read off. Rows are never shuffled,
only their counts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from plantlens.session import settle

EXACT_ROWS = 1_000_000
CELLS_PER_E_FOLD = 256
CUTS = 4096
MASK_RANGES = 2_000
MASK_SPANS = 12

RankRule = Callable[[Column], Column]
# From a group's row count to the array of wanted ranks.
RankRules = Callable[[Column], Column]


def _melt(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    wide = df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns])
    long = wide.unpivot([F.col(b) for b in by], list(columns), "column", "value")
    return long.where(F.col("value").isNotNull() & ~F.isnan("value"))


def _renamed(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, Column]:
    """``df`` with its keys renamed, and the null-safe condition that joins on them."""
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}__r")) for k in keys])
    return df.withColumnsRenamed({k: f"{k}__r" for k in keys}), on


def _spans(ranges: list[Row], column: str) -> list[tuple[float, float]]:
    """The kept ranges of a column over all groups, merged to at most ``MASK_SPANS`` covering spans."""
    merged: list[list[float]] = []
    for lo, hi in sorted((r["lo"], r["hi"]) for r in ranges if r["column"] == column):
        if merged and lo <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], hi)
        else:
            merged.append([lo, hi])
    while len(merged) > MASK_SPANS:
        gaps = [merged[i + 1][0] - merged[i][1] for i in range(len(merged) - 1)]
        i = gaps.index(min(gaps))
        merged[i : i + 2] = [[merged[i][0], merged[i + 1][1]]]
    return [(lo, hi) for lo, hi in merged]


def _masked(df: DataFrame, columns: Sequence[str], by: Sequence[str], ranges: list[Row] | None) -> DataFrame:
    """Columns with the values outside every kept range set to NULL, so most rows fall away before the join."""
    if ranges is None or len(ranges) > MASK_RANGES:
        return df

    def kept(c: str) -> Column:
        x = F.col(c).cast("double")
        inside = [x.between(lo, hi) for lo, hi in _spans(ranges, c)]
        return F.when(reduce(lambda a, b: a | b, inside, F.lit(False)), x).alias(c)

    return df.select(*by, *[kept(c) for c in columns])


def _holding(counts: DataFrame, part: Sequence[str], order: str, below: Column, wanted: Column) -> DataFrame:
    """Ranges in which at least one wanted rank falls, with the rows before each range."""
    upto = F.sum("rows").over(
        Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    )
    seen = counts.withColumn("before", below + upto - F.col("rows"))
    hit = F.filter(wanted, lambda t: (t["rank"] >= F.col("before")) & (t["rank"] < F.col("before") + F.col("rows")))
    return seen.withColumn("wanted", hit).where(F.size("wanted") > 0)


def order_statistics(
    df: DataFrame,
    columns: Sequence[str],
    ranks: Sequence[RankRule] | RankRules,
    by: Sequence[str] = (),
    exact_rows: int = EXACT_ROWS,
) -> DataFrame:
    """Values at 0-based ranks of each column, per group.

    ``ranks`` holds functions from the group's non-null count to a rank, or is one function to an
    array of ranks. One row per (group, column, position in ``ranks``): ``by..., column, n, pos, value``.
    The same passes run at every size.
    """
    clash = {"column", "n", "pos", "value"} & set(by)
    held = {b: f"g{i}__" for i, b in enumerate(by)}
    found = _order_statistics(df.withColumnsRenamed(held), columns, ranks, list(held.values()), exact_rows)
    if not clash:
        return found.withColumnsRenamed({g: b for b, g in held.items()})
    raise ValueError(f"a group column cannot be called {sorted(clash)[0]!r} here")


def _order_statistics(df: DataFrame, columns: Sequence[str], ranks: Sequence[RankRule] | RankRules, by: Sequence[str], exact_rows: int) -> DataFrame:
    keys = [*by, "column"]
    long = _melt(df, columns, by)
    n = F.col("n")
    asked = ranks(n) if callable(ranks) else F.array(*[rule(n).cast("bigint") for rule in ranks])
    wanted = F.transform(asked, lambda r, i: F.struct(i.alias("pos"), r.cast("bigint").alias("rank")))
    v = F.col("value")
    cell = F.floor(F.signum(v) * F.log1p(F.abs(v)) * CELLS_PER_E_FOLD)
    counts = (
        long.groupBy(*keys, cell.alias("cell"))
        .agg(F.count("*").alias("rows"), F.min("value").alias("lo"), F.max("value").alias("hi"))
        .withColumn("n", F.sum("rows").over(Window.partitionBy(*keys)))
    )
    kept_columns = [*keys, "n", "before", "rows", "lo", "hi", "wanted"]
    ranges, rows = settle(_holding(counts, keys, "cell", F.lit(0), wanted).select(*kept_columns))

    def is_open() -> Column:
        return (F.col("lo") < F.col("hi")) & (F.col("rows") > exact_rows)

    def matched(kept: DataFrame) -> DataFrame:
        """Rows inside a kept range, tagged with the range's lower end (ranges are disjoint)."""
        right, on = _renamed(kept.select(*keys, "lo", "hi"), keys)
        near = _melt(_masked(df, columns, by, rows), columns, by)
        return near.join(right, on & (v >= F.col("lo")) & (v <= F.col("hi"))).select(*keys, "value", "lo", "hi")

    def with_range(counted: DataFrame, kept: DataFrame) -> DataFrame:
        heads = kept.select(*keys, F.col("lo").alias("head"), "n", F.col("before").alias("ahead"), F.col("wanted").alias("todo"))
        right, on = _renamed(heads, keys)
        return counted.join(right, on & (F.col("start") == F.col("head"))).drop(*[f"{k}__r" for k in keys])

    def any_open() -> bool:
        if rows is not None:
            return any(r["lo"] < r["hi"] and r["rows"] > exact_rows for r in rows)
        return bool(ranges.where(is_open()).limit(1).count())

    while any_open():
        share = F.floor((v - F.col("lo")) / (F.col("hi") - F.col("lo")) * CUTS)
        counted = (
            matched(ranges.where("lo < hi"))
            .groupBy(*keys, F.col("lo").alias("start"), share.alias("cell"))
            .agg(F.count("*").alias("rows"), F.min("value").alias("lo"), F.max("value").alias("hi"))
        )
        finer = _holding(with_range(counted, ranges), [*keys, "start"], "cell", F.col("ahead"), F.col("todo"))
        closed = ranges.where("lo = hi").select(*kept_columns)
        ranges, rows = settle(finer.select(*kept_columns).unionByName(closed))

    done = ranges.where("lo = hi").select(*keys, "n", F.col("lo").alias("value"), "wanted")
    if rows is None or any(r["lo"] < r["hi"] for r in rows):
        counted = (
            matched(ranges.where("lo < hi"))
            .groupBy(*keys, F.col("lo").alias("start"), "value")
            .agg(F.count("*").alias("rows"))
        )
        last = _holding(with_range(counted, ranges), [*keys, "start"], "value", F.col("ahead"), F.col("todo"))
        done = done.unionByName(last.select(*keys, "n", "value", "wanted"))
    return done.select(*keys, "n", "value", F.explode("wanted").alias("t")).select(
        *keys, "n", F.col("t.pos").alias("pos"), "value"
    )


def quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    exact_rows: int = EXACT_ROWS,
) -> DataFrame:
    """Linearly interpolated quantiles: one row ``by..., column, n, q`` with ``q`` in ``probs`` order.

    The plan does not grow with the number of probabilities: ranks and results are arrays.
    """
    clash = {"column", "n", "q"} & set(by)
    if clash:
        raise ValueError(f"a group column cannot be called {sorted(clash)[0]!r} here")
    held = {b: f"g{i}__" for i, b in enumerate(by)}
    spots = F.array(*[F.lit(float(p)) for p in probs])

    def ranks(n: Column) -> Column:
        return F.flatten(F.transform(spots, lambda p: F.array(F.floor(p * (n - 1)), F.ceil(p * (n - 1)))))

    found = _order_statistics(df.withColumnsRenamed(held), columns, ranks, list(held.values()), exact_rows)
    at = F.map_from_entries(F.collect_list(F.struct("pos", "value")))
    picked = found.groupBy(*held.values(), "column", "n").agg(at.alias("at__"))

    def between(p: Column, i: Column) -> Column:
        spot = p * (F.col("n") - 1)
        low, high = F.element_at("at__", 2 * i), F.element_at("at__", 2 * i + 1)
        return low + (high - low) * (spot - F.floor(spot))

    out = picked.select(*held.values(), "column", "n", F.transform(spots, between).alias("q"))
    return out.withColumnsRenamed({g: b for b, g in held.items()})


def quantile_values(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    exact_rows: int = EXACT_ROWS,
) -> dict[str, list[float]]:
    """Quantiles of whole columns as plain numbers (as many rows as columns reach the driver)."""
    if not columns:
        return {}
    return {r["column"]: list(r["q"]) for r in quantiles(df, columns, probs, (), exact_rows).collect()}

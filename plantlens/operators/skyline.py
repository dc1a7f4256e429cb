"""Non-dominated rows, front ranks and crowding distance (all costs minimised).

Dominance needs no pair table: each task first drops what its own rows dominate, survivors
are merged in shrinking rounds, and what still remains is checked block against block, each
block pair in its own task of bounded size. Fronts are ranked range after range of the vectors' order.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantlens.session import cut, settle

BLOCK_ROWS = 8_192
RIVALS = 128
# Fronts are ranked in ranges of 16 blocks, in longer ones where these would be more than 8, and never of more than about 20,000 rows.
RANGE_BLOCKS, RANGES, RANKED_ROWS = 16, 8, 20_000
WINDOW_ROWS = 200_000
# Slices, and rows, that one task puts in order.
SLICES = 64
RANGE_ROWS = 500_000


def _beaten(rows: np.ndarray, rivals: np.ndarray) -> np.ndarray:
    """Flags of the rows that some rival dominates."""
    lost = np.zeros(len(rows), dtype=bool)
    for start in range(0, len(rivals), RIVALS):
        some = rivals[start : start + RIVALS]
        no_worse = np.ones((len(some), len(rows)), dtype=bool)
        better = np.zeros((len(some), len(rows)), dtype=bool)
        for d in range(rows.shape[1]):
            mine, theirs = some[:, d, None], rows[None, :, d]
            no_worse &= mine <= theirs
            better |= mine < theirs
        lost |= (no_worse & better).any(axis=0)
    return lost


def _survivors(costs: np.ndarray) -> np.ndarray:
    """Positions of rows that no row of the same block dominates; small sums, the likely winners, compare first."""
    alive = np.argsort(costs.sum(axis=1), kind="stable")
    done, step = 0, 8
    while done < len(alive):
        rows = costs[alive]
        kept = ~_beaten(rows, rows[done : done + step])
        done = int(kept[: done + step].sum())
        alive = alive[kept]
        step = min(2 * step, RIVALS)
    return alive


def _matrix(table: pa.RecordBatch | pa.Table, costs: Sequence[str]) -> np.ndarray:
    return np.column_stack([table.column(c).to_numpy(zero_copy_only=False) for c in costs]) if table.num_rows else np.empty((0, len(costs)))


def _raised(rows: np.ndarray, base: np.ndarray, fronts: dict[int, np.ndarray], block_rows: int) -> np.ndarray:
    """Lowest fronts still open to rows, after the ranked rows of one more range.

    ``base`` is what the ranges before leave open: some row of each lower front dominates the row there, none of a front from ``base`` on. So a
    dominating row of front ``base`` or above is of this range, with one of front ``base`` before it, and the first front that holds none ends the search.
    """
    base = base.copy()
    for start in range(0, len(rows), block_rows):
        some, low = rows[start : start + block_rows], base[start : start + block_rows]
        for rank in sorted(fronts):
            at = np.flatnonzero(low == rank)
            if len(at):
                low[at[_beaten(some[at], fronts[rank])]] += 1
    return base


def _peeled(rows: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Fronts of a block's rows, peeled one by one; no row comes before its ``base``."""
    ranks, left, rank = base.copy(), np.arange(len(rows)), -1
    while len(left):
        rank = max(rank + 1, int(ranks[left].min()))
        ready = left[ranks[left] <= rank]
        top = ready[~_beaten(rows[ready], rows[left])]
        ranks[top] = rank
        left = np.setdiff1d(left, top, assume_unique=True)
    return ranks


def _by_front(rows: np.ndarray, ranks: np.ndarray) -> dict[int, np.ndarray]:
    order = np.argsort(ranks, kind="stable")
    found, first = np.unique(ranks[order], return_index=True)
    return dict(zip(found.tolist(), np.split(rows[order], first[1:]), strict=True)) if len(rows) else {}


def _ranked(rows: np.ndarray, base: np.ndarray, block_rows: int) -> np.ndarray:
    """Fronts of a range's rows, block by block in their order: what dominates a row comes before it."""
    ranks, fronts = base.copy(), {}
    order, step = np.lexsort(rows.T[::-1]), min(block_rows, RIVALS)
    for start in range(0, len(rows), step):
        at = order[start : start + step]
        ranks[at] = _peeled(rows[at], _raised(rows[at], base[at], fronts, step))
        for rank, some in _by_front(rows[at], ranks[at]).items():
            fronts[rank] = np.vstack([fronts[rank], some]) if rank in fronts else some
    return ranks


def _local_skyline(costs: Sequence[str], block_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((0, len(costs)))
        for batch in batches:
            for start in range(0, batch.num_rows, block_rows):
                piece = np.unique(_matrix(batch.slice(start, block_rows), costs), axis=0)
                merged = np.unique(np.vstack([held, piece[_survivors(piece)]]), axis=0)
                held = merged[_survivors(merged)]
                if len(held) > block_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(held[:, i]) for i in range(len(costs))], names=list(costs))
                    held = np.empty((0, len(costs)))
        if len(held):
            yield pa.RecordBatch.from_arrays([pa.array(held[:, i]) for i in range(len(costs))], names=list(costs))

    return run


def _cost_vectors(df: DataFrame, costs: Sequence[str]) -> DataFrame:
    """Complete cost vectors; a NULL or NaN is incomparable and handled by the callers."""
    vectors = df.select(*[F.col(c).cast("double").alias(c) for c in costs])
    return vectors.where(_comparable(costs))


def _comparable(costs: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in costs])


def _schema(costs: Sequence[str]) -> str:
    return ", ".join(f"`{c}` double" for c in costs)


def _candidates(vectors: DataFrame, costs: Sequence[str], block_rows: int) -> tuple[DataFrame, int]:
    """Distinct vectors that may be non-dominated, merged in shrinking rounds, and their number."""
    local = _local_skyline(costs, block_rows)
    left = cut(vectors.mapInArrow(local, _schema(costs)).distinct())
    n = left.count()
    while n > block_rows:
        parts = max(1, n // (4 * block_rows))
        smaller = cut(left.repartition(parts).mapInArrow(local, _schema(costs)))
        m = smaller.count()
        shrunk, left, n = m < 0.8 * n, smaller, m
        if not shrunk:
            break
    return left, n


def _front_vectors(vectors: DataFrame, costs: Sequence[str], block_rows: int) -> DataFrame:
    """Distinct non-dominated cost vectors."""
    left, n = _candidates(vectors, costs, block_rows)
    if n <= block_rows:
        return left.coalesce(1).mapInArrow(_local_skyline(costs, block_rows), _schema(costs))
    return _block_check(left, costs, -(-n // block_rows))


def _block_check(vectors: DataFrame, costs: Sequence[str], blocks: int) -> DataFrame:
    """Every vector against every block; a task sees two blocks only."""
    own = F.pmod(F.xxhash64(*costs), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    base = vectors.withColumn("own__", own)
    targets = base.select(*costs, F.col("own__").alias("t__"), every.alias("f__"), F.lit(True).alias("target__"))
    filters = base.select(*costs, every.alias("t__"), F.col("own__").alias("f__"), F.lit(False).alias("target__"))

    def losing(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.loc[group["target__"], list(costs)]
        against = group.loc[~group["target__"], list(costs)]
        return rows[_beaten(rows.to_numpy(dtype=float), against.to_numpy(dtype=float))]

    losers = targets.unionByName(filters).groupBy("t__", "f__").applyInPandas(losing, _schema(costs)).distinct()
    return vectors.join(losers, list(costs), "left_anti")


def skyline(df: DataFrame, costs: Sequence[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows that no row beats: none is as small in every cost and smaller in one.

    Rows with equal costs stay together; a row with a missing cost is beaten by nothing.
    """
    front, _ = settle(_front_vectors(_cost_vectors(df, costs), costs, block_rows))
    right = front.withColumnsRenamed({c: f"{c}__f" for c in costs})
    on = reduce(lambda a, b: a & b, [F.col(c).cast("double") == F.col(f"{c}__f") for c in costs])
    kept = df.where(_comparable(costs)).join(right, on, "left_semi")
    return kept.unionByName(df.where(~_comparable(costs)))


def _next_range(costs: Sequence[str], block_rows: int, current: int, most: int | None):
    """Raises a range's rows by the ranked rows of the range before ``current``; range ``current``, which has seen all before it, is then ranked."""

    def run(waiting: pa.Table, ranked: pa.Table) -> pa.Table:
        if waiting.num_rows == 0:
            return waiting
        rows, mine = _matrix(waiting, costs), waiting.column("range__")[0].as_py()
        front = _raised(rows, waiting.column("front").to_numpy(), _by_front(_matrix(ranked, costs), ranked.column("front").to_numpy()), block_rows)
        if mine == current:
            front = _ranked(rows, front, block_rows)
        found = waiting.set_column(waiting.schema.get_field_index("front"), "front", pa.array(front, pa.int32()))
        return found if most is None else found.filter(pa.array(front <= most))

    return run


def _ranges(vectors: DataFrame, costs: Sequence[str], block_rows: int, most: int | None) -> list[DataFrame]:
    """The distinct vectors with their fronts, a table for each range of their order; those behind front ``most`` drop out.

    What dominates a vector comes before it in the order of its costs. A step ranks one range in one task and shows it to all later
    ranges, each in a task of its own; no task holds more than two ranges.
    """
    n = vectors.count()
    ranges = max(1, -(-n // RANKED_ROWS), min(RANGES, -(-n // (RANGE_BLOCKS * block_rows))))
    schema = f"range__ int, {_schema(costs)}, front int"
    state = vectors.repartitionByRange(ranges, *costs).select(F.spark_partition_id().alias("range__"), *costs, F.lit(0).alias("front"))
    state, done = cut(state), []
    for current in range(ranges):
        waiting = state.where(F.col("range__") >= current)
        shown = state.where(F.col("range__") == current - 1).withColumn("range__", F.explode(F.sequence(F.lit(current), F.lit(ranges - 1))))
        by = [df.repartition(ranges - current, "range__").groupBy("range__") for df in (waiting, shown)]
        state = cut(by[0].cogroup(by[1]).applyInArrow(_next_range(costs, block_rows, current, most), schema))
        done.append(state.where(F.col("range__") == current).drop("range__"))
    return done


def front_ranks(
    df: DataFrame, costs: Sequence[str], max_rank: int | None = None, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Adds ``front`` 0, 1, 2…: the rows left non-dominated once earlier fronts are removed.

    Distinct vectors are ranked range after range of their order, at most ``block_rows`` of them compared at a time; a small
    table is one range. With ``max_rank`` later fronts get NULL.
    """
    vectors = cut(_cost_vectors(df, costs).distinct())
    ranks, _ = settle(reduce(DataFrame.unionByName, _ranges(vectors, costs, block_rows, max_rank)))
    right = ranks.withColumnsRenamed({c: f"{c}__f" for c in costs})
    on = reduce(lambda a, b: a & b, [F.col(c).cast("double") == F.col(f"{c}__f") for c in costs])
    level = F.when(~_comparable(costs), 0).otherwise(F.col("front"))
    return df.join(right, on, "left").select(*df.columns, level.cast("int").alias("front"))


def _between(window_rows: int):
    """Arrow batches in the order (objective, value) to the same rows with the values before and after them in this partition.

    A task holds one slice of at most ``window_rows`` rows at a time; a slice's last row waits for the next slice.
    """

    def near(rows: pa.Table, before: tuple | None, after: tuple | None) -> pa.RecordBatch:
        names, values = rows.column("objective").to_pylist(), rows.column("value").to_pylist()
        keys = [before, *zip(names, values), after]

        def moved(others: list) -> pa.Array:
            return pa.array([o[1] if o is not None and o[0] == name else None for o, name in zip(others, names)], pa.float64())

        columns = [rows.column(c).combine_chunks() for c in ("objective", "value", "first_key", "last_key")]
        part = pa.array(np.full(len(names), TaskContext.get().partitionId(), dtype="int32"))
        return pa.RecordBatch.from_arrays([*columns, moved(keys[:-2]), moved(keys[2:]), part], names=["objective", "value", "first_key", "last_key", "before", "after", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, held = None, None
        pair = lambda rows, i: (rows.column("objective")[i].as_py(), rows.column("value")[i].as_py())
        for batch in batches:
            for start in range(0, batch.num_rows, window_rows):
                rows = pa.Table.from_batches([batch.slice(start, window_rows)])
                if held is not None:
                    yield near(held, before, pair(rows, 0))
                    before = pair(held, held.num_rows - 1)
                held = rows
        if held is not None:
            yield near(held, before, None)

    return run


def _neighbours(ties: DataFrame, window_rows: int) -> DataFrame:
    """Previous and next distinct value per objective.

    The value lists are dealt in ranges over tasks that go through them in slices of at most ``window_rows``; the ranges' end
    values are stitched together.
    """
    ranges = -(-ties.count() // min(SLICES * window_rows, RANGE_ROWS)) or 1
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ties.schema) + ", before double, after double, part int"
    ordered = ties.repartitionByRange(ranges, "objective", "value").sortWithinPartitions("objective", "value")
    inside = cut(ordered.mapInArrow(_between(window_rows), schema))
    ends = inside.groupBy("objective", "part").agg(F.min("value").alias("first"), F.max("value").alias("last"))
    across = Window.partitionBy("objective").orderBy("part")
    edges, _ = settle(
        ends.select(
            F.col("objective").alias("o"),
            F.col("part").alias("p"),
            F.lag("last").over(across).alias("left_edge"),
            F.lead("first").over(across).alias("right_edge"),
        )
    )
    joined = inside.join(edges, (F.col("objective") == F.col("o")) & (F.col("part") == F.col("p")))
    return joined.withColumns({"before": F.coalesce("before", "left_edge"), "after": F.coalesce("after", "right_edge")}).drop("o", "p", "part", "left_edge", "right_edge")


def _end_gaps(near: DataFrame, span: Column) -> DataFrame:
    """(o__, v__, k__, gap): the gaps of the first and the last key of each run of equal values; all rows between have none."""
    inf = F.lit(float("inf"))

    def gap(previous: Column, following: Column) -> Column:
        return F.when(previous.isNull() | following.isNull(), inf).otherwise((following - previous) / span)

    value, one = F.col("value"), F.col("first_key") == F.col("last_key")
    first = F.struct(F.col("first_key").alias("k__"), gap(F.col("before"), F.when(one, F.col("after")).otherwise(value)).alias("gap"))
    last = F.struct(F.col("last_key").alias("k__"), gap(value, F.col("after")).alias("gap"))
    ends = near.where(F.col("first_key").isNotNull()).select("objective", "value", F.explode(F.when(one, F.array(first)).otherwise(F.array(first, last))).alias("e"))
    return ends.select(F.col("objective").alias("o__"), F.col("value").alias("v__"), "e.k__", "e.gap")


def crowding_distance(
    front: DataFrame, costs: Sequence[str], key: str, window_rows: int = WINDOW_ROWS
) -> DataFrame:
    """Adds ``crowding``: per cost the gap between a row's sorted neighbours over the cost's span, summed.

    The two end rows of each cost are infinite, equal values are ordered by key. Runs of equal
    values collapse to one row (count, first and last key) before any order is made, and only the run's end rows
    are joined back, by value and key, so a frequent value is dealt over all tasks. A row with a
    missing (NULL or NaN) cost has no neighbours: its distance is 0, and the others do not see it.
    """
    long = front.where(_comparable(costs)).select(F.col(key).alias("key__"), *[F.col(c).cast("double").alias(c) for c in costs]).unpivot(
        ["key__"], list(costs), "objective", "value"
    )
    ties = cut(
        long.groupBy("objective", "value").agg(F.min("key__").alias("first_key"), F.max("key__").alias("last_key"))
    )
    lowest_highest = ties.groupBy("objective").agg(F.min("value"), F.max("value")).collect()
    spans = {name: high - low if high > low else 1.0 for name, low, high in lowest_highest}
    # One literal per cost; a table without rows has none.
    span = reduce(lambda rest, name: F.when(F.col("objective") == name, F.lit(spans[name])).otherwise(rest), spans, F.lit(1.0))
    ends = _end_gaps(_neighbours(ties, window_rows), span)
    inner = (F.col("value") - F.col("value")) / span
    on = (F.col("objective") == F.col("o__")) & (F.col("value") == F.col("v__")) & (F.col("key__") == F.col("k__"))
    distances = (
        long.join(ends.hint("merge"), on, "left")
        .select("key__", F.coalesce("gap", inner).alias("gap"))
        .groupBy("key__")
        .agg(F.sum("gap").alias("crowding__"))
    )
    joined = front.join(distances.hint("merge"), F.col(key) == F.col("key__"), "left")
    return joined.withColumn("crowding", F.coalesce("crowding__", F.lit(0.0))).drop("key__", "crowding__")


def most_spread(front: DataFrame, key: str, k: int = 20) -> DataFrame:
    """The ``k`` rows with the largest crowding distance, ties to the smallest key."""
    return front.orderBy(F.desc("crowding"), key).limit(k)

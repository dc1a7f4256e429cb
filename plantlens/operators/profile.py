"""Distribution profiles: counts, histograms, correlations, box statistics."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from plantlens.functions.hashing import uniform
from plantlens.functions.scalar import CLASS_ORDER
from plantlens.operators.clean import FENCE_WIDTH, present
from plantlens.operators.quantiles import quantile_values, quantiles
from plantlens.session import settle
from plantlens.sources.schemas import numeric_columns

# Histogram bins for a target and for energy results, most distinct values shown as bars.
TARGET_BINS = 30
ENERGY_BINS = 35
MAX_BARS = 5


def table_shape(df: DataFrame, target: str) -> DataFrame:
    features = len([c for c in df.columns if c != target])
    return df.agg(F.count("*").alias("n_rows")).select("n_rows", F.lit(features).cast("bigint").alias("n_features"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(column)


def is_categorical(df: DataFrame, column: str) -> bool:
    """Text, or at most five distinct values; a sketch spares the exact count on wide domains."""
    if isinstance(df.schema[column].dataType, StringType):
        return True
    if df.agg(F.approx_count_distinct(column, 0.01)).first()[0] > 10 * MAX_BARS:
        return False
    return df.agg(F.count_distinct(column)).first()[0] <= MAX_BARS


def class_counts(df: DataFrame, column: str, domain: Sequence[str] = tuple(CLASS_ORDER)) -> DataFrame:
    """Counts on a fixed domain in its order; an absent class keeps its row with a NULL count."""
    order = df.sparkSession.createDataFrame(list(enumerate(domain)), "position int, label string")
    counted = df.groupBy(F.col(column).cast("string").alias("label")).agg(F.count("*").alias("n"))
    return order.join(counted, "label", "left").orderBy("position")


def _bin(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    spot = F.floor((x - lo) / (hi - lo) * bins)
    return F.when(lo == hi, F.lit(0)).otherwise(F.least(spot, F.lit(bins - 1))).cast("int")


def histogram(df: DataFrame, column: str, bins: int = TARGET_BINS) -> DataFrame:
    """Equal-width bins over [min, max], the last one closed; empty bins are kept."""
    x = F.col(column).cast("double")
    lo, hi = df.agg(F.min(x), F.max(x)).first()
    spark = df.sparkSession
    all_bins = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    if lo is None:
        return all_bins.select("bin", F.lit(None).cast("double").alias("lower"), F.lit(0).cast("bigint").alias("n"))
    counted = (
        df.where(x.isNotNull()).groupBy(_bin(x, F.lit(lo), F.lit(hi), bins).alias("bin")).agg(F.count("*").alias("n"))
    )
    lower = F.lit(lo) + F.col("bin") * F.lit((hi - lo) / bins)
    return all_bins.join(counted, "bin", "left").select(
        "bin", lower.alias("lower"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )


def grouped_histogram(df: DataFrame, group: str, column: str, bins: int = TARGET_BINS) -> DataFrame:
    """Bins over the column's whole range, counted per group, with the density of each bin."""
    x = F.col(column).cast("double")
    lo, hi = df.agg(F.min(x), F.max(x)).first()
    if lo is None:
        return df.select(group, F.lit(0).alias("bin"), F.lit(0).cast("bigint").alias("n"), x.alias("density")).limit(0)
    counted = (
        df.where(x.isNotNull())
        .groupBy(group, _bin(x, F.lit(lo), F.lit(hi), bins).alias("bin"))
        .agg(F.count("*").alias("n"))
    )
    totals = counted.groupBy(F.col(group).alias("group__")).agg(F.sum("n").alias("total"))
    width = (hi - lo) / bins or 1.0
    return counted.join(totals, F.col(group).eqNullSafe(F.col("group__"))).select(
        group, "bin", "n", (F.col("n") / F.col("total") / F.lit(width)).alias("density")
    )


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pairwise-complete Pearson correlations, long form, from one aggregate over the table."""
    names = list(columns) if columns else numeric_columns(df)
    x = {c: F.col(c).cast("double") for c in names}
    pairs = list(combinations(names, 2))
    aggregates = [F.corr(x[a], x[b]).alias(f"r{i}") for i, (a, b) in enumerate(pairs)]
    aggregates += [F.var_pop(x[c]).alias(f"s{i}") for i, c in enumerate(names)]
    one = df.agg(*aggregates)
    cells = [
        F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"r{i}").alias("r"))
        for i, pair in enumerate(pairs)
        for a, b in (pair, pair[::-1])
    ]
    cells += [
        F.struct(F.lit(c).alias("x"), F.lit(c).alias("y"), F.when(F.col(f"s{i}") > 0, F.lit(1.0)).alias("r"))
        for i, c in enumerate(names)
    ]
    return one.select(F.inline(F.array(*cells)))


def target_correlations(df: DataFrame, target: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Each feature's correlation with the target, weakest first."""
    names = list(columns) if columns else numeric_columns(df, [target])
    y = F.col(target).cast("double")
    one = df.agg(*[F.corr(F.col(c).cast("double"), y).alias(c) for c in names])
    return one.unpivot([], names, "feature", "r").orderBy(F.abs("r"), "feature")


def melt(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (), feature: str = "feature", value: str = "value") -> DataFrame:
    """Long form; NaN becomes NULL."""
    wide = df.select(*keep, *[present(c).alias(c) for c in columns])
    return wide.unpivot([F.col(k) for k in keep], list(columns), feature, value)


def _boxes(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> tuple[DataFrame, Column]:
    """Quartiles and fences per group and column, and the condition joining them to a long table."""
    q1, mid, q3 = (F.col("q")[i] for i in range(3))
    boxes, _ = settle(
        quantiles(df, columns, [0.25, 0.5, 0.75], by).select(
            *[F.col(b).alias(f"{b}__g") for b in by],
            F.col("column").alias("feature__g"),
            q1.alias("q1"),
            mid.alias("median"),
            q3.alias("q3"),
            (q1 - FENCE_WIDTH * (q3 - q1)).alias("lower_fence"),
            (q3 + FENCE_WIDTH * (q3 - q1)).alias("upper_fence"),
        )
    )
    on = F.col("feature__") == F.col("feature__g")
    for b in by:
        on = on & F.col(b).eqNullSafe(F.col(f"{b}__g"))
    return boxes, on


def box_stats(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Quartiles, whiskers (extreme values inside the fences) and outlier counts per group."""
    boxes, on = _boxes(df, columns, by)
    value = F.col("value__")
    inside = value.between(F.col("lower_fence"), F.col("upper_fence"))
    found = melt(df, columns, by, "feature__", "value__").where(value.isNotNull()).join(boxes, on).groupBy(*by, "feature__", "q1", "median", "q3")
    return found.agg(
        F.min(F.when(inside, value)).alias("whisker_low"),
        F.max(F.when(inside, value)).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"),
        F.count("*").alias("n"),
    ).withColumnRenamed("feature__", "feature")


def box_outliers(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """The values outside the fences, with their key columns."""
    boxes, on = _boxes(df, columns, by)
    value = F.col("value__")
    beyond = (value < F.col("lower_fence")) | (value > F.col("upper_fence"))
    long = melt(df, columns, [*by, *keep], "feature__", "value__").join(boxes, on & beyond)
    return long.select(*by, *keep, F.col("feature__").alias("feature"), value.alias("value"))


def scatter_sample(df: DataFrame, columns: Sequence[str], key: str, fraction: float = 1.0, seed: int = 42) -> DataFrame:
    """Points to plot: a projection, thinned by key hash when ``fraction`` is below one."""
    picked = df if fraction >= 1.0 else df.where(uniform(seed, key) < fraction)
    return picked.select(key, *columns)


def distribution_summary(df: DataFrame, column: str) -> DataFrame:
    """Mean, population deviation and the 5th and 95th percentiles of a whole column."""
    p5, p95 = quantile_values(df, [column], [0.05, 0.95]).get(column, (None, None))
    return df.agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("std")).select(
        "mean", "std", F.lit(p5).cast("double").alias("p5"), F.lit(p95).cast("double").alias("p95")
    )


def column_means(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, float]:
    names = list(columns) if columns else numeric_columns(df)
    return df.agg(*[F.avg(c).alias(c) for c in names]).first().asDict()

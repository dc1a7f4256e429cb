"""Winsorising, imputation, scaling, variance filter and percentile labels.

Each is fitted by one exact-quantile or variance aggregate and applied as a stateless
projection, so a fitted step also runs on a streaming table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantlens.functions.scalar import CLASS_ORDER, clip, display_round
from plantlens.operators.quantiles import quantile_values
from plantlens.sources.schemas import numeric_columns

# Fence width in IQRs, smallest variance kept, label percentiles.
FENCE_WIDTH = 1.5
VARIANCE_THRESHOLD = 0.01
LABEL_CUTS = (0.33, 0.67)

REPORT_SCHEMA = "column string, n_capped bigint, lower_fence double, upper_fence double"


@dataclass(frozen=True)
class Fences:
    """Lower and upper fence per column; a column with zero IQR has none."""

    bounds: dict[str, tuple[float, float]]

    @classmethod
    def fit(cls, df: DataFrame, target: str | None = None, columns: Sequence[str] | None = None) -> Fences:
        names = list(columns) if columns else numeric_columns(df, [target] if target else [])
        bounds = {}
        for name, (q1, q3) in quantile_values(df, names, [0.25, 0.75]).items():
            iqr = q3 - q1
            if iqr != 0:
                bounds[name] = (q1 - FENCE_WIDTH * iqr, q3 + FENCE_WIDTH * iqr)
        return cls({c: bounds[c] for c in names if c in bounds})

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: clip(F.col(c), F.lit(lo), F.lit(hi)) for c, (lo, hi) in self.bounds.items()})

    def outside(self, column: str) -> Column:
        lo, hi = self.bounds[column]
        return (F.col(column) < lo) | (F.col(column) > hi)

    def report(self, df: DataFrame, digits: int = 4) -> DataFrame:
        """Capped columns with their counts and rounded fences, in one pass over ``df``."""
        if not self.bounds:
            return df.sparkSession.createDataFrame([], REPORT_SCHEMA)
        counts = df.agg(*[F.count_if(self.outside(c)).alias(c) for c in self.bounds])
        rows = [
            F.struct(
                F.lit(c).alias("column"),
                F.col(c).alias("n_capped"),
                display_round(F.lit(lo), digits).alias("lower_fence"),
                display_round(F.lit(hi), digits).alias("upper_fence"),
            )
            for c, (lo, hi) in self.bounds.items()
        ]
        return counts.select(F.inline(F.array(*rows))).where("n_capped > 0")


def winsorise(df: DataFrame, target: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The capped table and the report of what was capped."""
    fences = Fences.fit(df, target)
    return fences.apply(df), fences.report(df)


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    return {c: q[0] for c, q in quantile_values(df, columns, [0.5]).items()}


def present(column: str) -> Column:
    """The column as a double, NaN as missing."""
    x = F.col(column).cast("double")
    return F.when(~F.isnan(x), x)


def impute(df: DataFrame, fills: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.coalesce(present(c), F.lit(m)) for c, m in fills.items()})


def robust_stats(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Median and IQR per column, an IQR of zero replaced by one (centred, unscaled)."""
    return {
        c: (mid, (q3 - q1) if q3 != q1 else 1.0)
        for c, (q1, mid, q3) in quantile_values(df, columns, [0.25, 0.5, 0.75]).items()
    }


def robust_scale(df: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - F.lit(mid)) / F.lit(span) for c, (mid, span) in stats.items()})


def population_variances(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    if not columns:
        return {}
    return df.agg(*[F.var_pop(present(c)).alias(c) for c in columns]).first().asDict()


def varying_columns(df: DataFrame, columns: Sequence[str], threshold: float = VARIANCE_THRESHOLD) -> list[str]:
    found = population_variances(df, columns)
    return [c for c in columns if found[c] is not None and found[c] > threshold]


def clean_batch(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Imputed table (other columns carried through) and the scaled numeric columns."""
    columns = numeric_columns(df)
    cleaned = impute(df, medians(df, columns))
    scaled = robust_scale(cleaned, robust_stats(cleaned, columns)).select(*columns)
    return cleaned, scaled


def percentile_cuts(df: DataFrame, column: str, probs: Sequence[float] = LABEL_CUTS) -> list[float]:
    return quantile_values(df, [column], list(probs))[column]


def percentile_label(column: str, cuts: Sequence[float]) -> Column:
    """Below the first cut Low, below the second Medium, else High."""
    low, high = cuts
    x = F.col(column)
    return F.when(x < low, CLASS_ORDER[0]).when(x < high, CLASS_ORDER[1]).otherwise(CLASS_ORDER[2])

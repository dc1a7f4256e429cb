"""``pyspark.ml`` stages on plain columns, fitted by exact aggregates and saved with a pipeline.

The built-in imputer and robust scaler approximate their quantiles, and the built-in variance
selector uses the sample variance; these stages use the exact figures.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.functions.scalar import clip
from plantlens.operators import clean
from plantlens.sources.schemas import numeric_columns


class _ColumnStep(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Works on all numeric columns but the excluded ones (target, key, fold)."""

    excluded = Param(Params._dummy(), "excluded", "columns left alone", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, excluded=()):
        super().__init__()
        self._setDefault(excluded=[])
        self._set(excluded=list(self._input_kwargs.get("excluded", ())))

    def _columns(self, df: DataFrame) -> list[str]:
        return numeric_columns(df, self.getOrDefault(self.excluded))

    def _fitted(self, model: _ColumnModel, columns: list[str], first: list, second: list) -> _ColumnModel:
        model._set(columns=columns, first=[float(v) for v in first], second=[float(v) for v in second])
        return model


class _ColumnModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Columns with up to two learned numbers each."""

    columns = Param(Params._dummy(), "columns", "columns worked on", TypeConverters.toListString)
    first = Param(Params._dummy(), "first", "first learned number per column", TypeConverters.toListFloat)
    second = Param(Params._dummy(), "second", "second learned number per column", TypeConverters.toListFloat)

    def learned(self) -> list[tuple]:
        names = self.getOrDefault(self.columns)
        first, second = self.getOrDefault(self.first), self.getOrDefault(self.second)
        return [(c, first[i] if first else None, second[i] if second else None) for i, c in enumerate(names)]


class WinsoriserModel(_ColumnModel):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumns({c: clip(F.col(c), F.lit(lo), F.lit(hi)) for c, lo, hi in self.learned()})


class Winsoriser(_ColumnStep):
    """Caps values at the IQR fences of the fitted table."""

    def _fit(self, dataset: DataFrame) -> WinsoriserModel:
        columns = self._columns(dataset)
        bounds = clean.Fences.fit(dataset, columns=columns).bounds if columns else {}
        return self._fitted(WinsoriserModel(), list(bounds), [b[0] for b in bounds.values()], [b[1] for b in bounds.values()])


class MedianImputerModel(_ColumnModel):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        return clean.impute(dataset, {c: mid for c, mid, _ in self.learned()})


class MedianImputer(_ColumnStep):
    """Fills NULLs with the exact median; a column without any value stays NULL."""

    def _fit(self, dataset: DataFrame) -> MedianImputerModel:
        fills = clean.medians(dataset, self._columns(dataset))
        return self._fitted(MedianImputerModel(), list(fills), list(fills.values()), [])


class VarianceFilterModel(_ColumnModel):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.drop(*[c for c, _, _ in self.learned()])


class VarianceFilter(_ColumnStep):
    """Drops numeric columns whose population variance is at most 0.01 (or unknown)."""

    def _fit(self, dataset: DataFrame) -> VarianceFilterModel:
        columns = self._columns(dataset)
        kept = set(clean.varying_columns(dataset, columns))
        return self._fitted(VarianceFilterModel(), [c for c in columns if c not in kept], [], [])


class ExactRobustScalerModel(_ColumnModel):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        return clean.robust_scale(dataset, {c: (mid, span) for c, mid, span in self.learned()})


class ExactRobustScaler(_ColumnStep):
    """(x - median) / IQR; a column with zero IQR is centred only."""

    def _fit(self, dataset: DataFrame) -> ExactRobustScalerModel:
        stats = clean.robust_stats(dataset, self._columns(dataset))
        return self._fitted(
            ExactRobustScalerModel(), list(stats), [s[0] for s in stats.values()], [s[1] for s in stats.values()]
        )


class FeatureVectorModel(_ColumnModel):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=self.getOrDefault(self.columns), outputCol="features").transform(dataset)


class FeatureVector(_ColumnStep):
    """Assembles the remaining numeric columns, in table order, into ``features``."""

    def _fit(self, dataset: DataFrame) -> FeatureVectorModel:
        return self._fitted(FeatureVectorModel(), self._columns(dataset), [], [])

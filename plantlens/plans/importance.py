"""Which inputs a model relies on."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plantlens.functions.hashing import uniform
from plantlens.operators import metrics
from plantlens.operators.estimators import FeatureVectorModel

# Fixed value: shuffles per feature.
REPEATS = 10

# Rows that one task sorts; the permutation does not depend on it.
BUCKET_ROWS = 250_000


def model_importance(model: PipelineModel) -> DataFrame | None:
    """Built-in importances of the learner, else mean absolute coefficients, smallest first; None when it has neither."""
    names = next(s for s in model.stages if isinstance(s, FeatureVectorModel))
    columns = names.getOrDefault(names.columns)
    values = None
    for stage in model.stages:
        if hasattr(stage, "featureImportances"):
            values = stage.featureImportances.toArray()
        elif hasattr(stage, "coefficientMatrix"):
            values = np.abs(stage.coefficientMatrix.toArray()).mean(axis=0)
        elif hasattr(stage, "coefficients"):
            values = np.abs(stage.coefficients.toArray())
    if values is None:
        return None
    rows = [(c, float(v)) for c, v in zip(columns, values)]
    return SparkSession.active().createDataFrame(rows, "feature string, importance double").orderBy("importance", "feature")


def _successors(df: DataFrame, features: Sequence[str], key: str, repeat: int, seed: int, buckets: int) -> DataFrame:
    """``df`` with ``v__``: the features of the next row in the repeat's hash order, the last row taking the first one's.

    Buckets are ranges of the hash, so a bucket's last row goes on to the first row of the next bucket that has rows: the
    order is one over the whole table, and the number of buckets has no part in the result.
    """
    hashed = df.withColumn("h__", uniform(seed, F.lit(repeat), F.col(key))).withColumn("b__", F.floor(F.col("h__") * buckets))
    values = F.struct(*features)
    heads = hashed.groupBy("b__").agg(F.min_by(values, F.struct("h__", key)).alias("head__"))
    along = Window.orderBy("b__")
    first = F.first("head__").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select("b__", F.coalesce(F.lead("head__").over(along), first).alias("next__"))
    inside = Window.partitionBy("b__").orderBy("h__", key)
    return hashed.withColumn("in__", F.lead(values).over(inside)).join(heads, "b__").withColumn("v__", F.coalesce("in__", "next__")).drop("h__", "b__", "in__", "next__")


def shuffled_features(df: DataFrame, features: Sequence[str], key: str, repeats: int = REPEATS, seed: int = 42, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per (row, repeat, feature) with that feature taken from another row.

    Every repeat sorts the table by its own hash of the key and a row takes the value of its successor. As features are tried one at a time,
    all features share a repeat's order. Needs unique keys.
    """
    buckets = max(1, -(-df.count() // bucket_rows))
    rest = [c for c in df.columns if c not in features]
    if buckets == 1:
        # One sorted run holds the table: all repeats' orders without a shuffle each, the same rows.
        orders = [Window.orderBy(uniform(seed, F.lit(r), F.col(key)), key) for r in range(repeats)]
        values = F.struct(*features)
        nexts = [F.coalesce(F.lead(values).over(o), F.first(values).over(o)) for o in orders]
        every = F.array(*[F.struct(F.lit(r).alias("repeat"), v.alias("v__")) for r, v in enumerate(nexts)])
        rows = df.withColumn("all__", every).withColumn("one__", F.explode("all__")).select(*df.columns, "one__.repeat", "one__.v__")
    else:
        moved = [_successors(df, features, key, r, seed, buckets).withColumn("repeat", F.lit(r)) for r in range(repeats)]
        rows = reduce(DataFrame.unionByName, moved)
    choices = [F.struct(F.lit(f).alias("feature"), *[(F.col("v__")[c] if c == f else F.col(c)).alias(c) for c in features]) for f in features]
    return rows.select(*rest, "repeat", F.explode(F.array(*choices)).alias("c__")).select(*rest, "repeat", "c__.*")


def importance(
    model: PipelineModel, df: DataFrame, features: Sequence[str], target: str, key: str, regression: bool, repeats: int = REPEATS, seed: int = 42
) -> DataFrame:
    """Importances by the first means a model offers: built-in, coefficients, else permutation on ``df``."""
    found = model_importance(model)
    if found is not None:
        return found
    return permutation_importance(model, df, features, target, key, regression, repeats, seed).select("feature", "importance")


def permutation_importance(
    model: PipelineModel,
    df: DataFrame,
    features: Sequence[str],
    target: str,
    key: str,
    regression: bool,
    repeats: int = REPEATS,
    seed: int = 42,
) -> DataFrame:
    """Mean and deviation of the score lost when a feature is shuffled, smallest first."""
    guess = "prediction" if regression else "predicted"

    def score(scored: DataFrame, by: list[str]) -> DataFrame:
        if regression:
            return metrics.r2_from(scored, target, guess, by).withColumnRenamed("r2", "score")
        return metrics.accuracy_from(scored, target, guess, by).withColumnRenamed("accuracy", "score")

    table = df.select(key, target, *features)
    base = score(model.transform(table), []).first()["score"]
    tried = score(model.transform(shuffled_features(table, features, key, repeats, seed)), ["feature", "repeat"])
    drop = F.lit(base) - F.col("score")
    return tried.groupBy("feature").agg(F.avg(drop).alias("importance"), F.stddev_pop(drop).alias("std")).orderBy("importance", "feature")

"""Trained models on disk with the metadata scoring needs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantlens.operators.scoring import Scorer
from plantlens.plans.train import Trained
from plantlens.sources.tables import load_json, save_json


def save_model(spark: SparkSession, trained: Trained, path: str) -> None:
    trained.model.write().overwrite().save(f"{path}/model")
    save_json(
        spark,
        f"{path}/metadata",
        {
            "best": trained.best,
            "cv_score": trained.cv_score,
            "feature_order": trained.feature_order,
            "target": trained.target,
            "regression": trained.regression,
            "temp_mean": trained.temp_mean,
        },
    )


def load_model(spark: SparkSession, path: str) -> Trained | None:
    """The stored model, ``None`` when there is none."""
    found = load_json(spark, f"{path}/metadata")
    if found is None:
        return None
    meta = found.first().asDict()
    try:
        model = PipelineModel.load(f"{path}/model")
    except AnalysisException:
        return None
    order = list(meta["feature_order"])
    return Trained(
        model, meta["best"], meta["cv_score"], [], order, meta["target"], meta["regression"], meta.get("temp_mean")
    )


def model_scorer(trained: Trained | None) -> Scorer | None:
    """Adds ``prediction`` to completed points: a number, or the class label."""
    if trained is None:
        return None

    # The preparation stages overwrite their inputs, so those are put back from a copy.
    copies = {c: f"{c}__in" for c in trained.feature_order}

    def score(points: DataFrame) -> DataFrame:
        copied = points.withColumns({copy: F.col(c) for c, copy in copies.items() if c in points.columns})
        scored = trained.model.transform(copied)
        out = F.col("prediction") if trained.regression else F.col("predicted")
        back = [F.col(copies[c]).alias(c) if c in copies else F.col(c) for c in points.columns]
        return scored.select(*back, out.alias("prediction"))

    return score

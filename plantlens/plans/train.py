"""Table to trained model: split, cross-validated candidate race, refit, evaluation."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from threading import Lock

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from plantlens.functions.features import add_features, add_missing_indicators, temperature_mean
from plantlens.operators import metrics
from plantlens.operators.clean import Fences
from plantlens.operators.estimators import ExactRobustScaler, FeatureVector, MedianImputer, VarianceFilter
from plantlens.operators.learners import (
    CLASSIFICATION_DRAWS,
    REGRESSION_DRAWS,
    Candidate,
    FitFacts,
    classification_candidates,
    regression_candidates,
)
from plantlens.operators.splits import FOLDS, assign_folds, sample_grid, train_test_split
from plantlens.session import cut
from plantlens.sources.schemas import numeric_columns

# Fixed value: fits run side by side; more of them take more of the driver's memory.
PARALLEL = 4

# Rows up to which the fits of several folds run at once; beyond, a fold's fits fill the cores, and caches of other folds would only fill the memory.
MANY_FOLDS_ROWS = 2_000_000

# Rows a training task should at least have; iterative learners run one job per iteration.
ROWS_PER_TASK = 25_000


@dataclass
class Trained:
    model: PipelineModel
    best: str
    cv_score: float
    board: list[tuple[str, float | None, str, str | None]]
    feature_order: list[str]
    target: str
    regression: bool
    temp_mean: float | None = None
    settings: dict = field(default_factory=dict)


def prepare_table(df: DataFrame, target: str, key: str) -> tuple[DataFrame, DataFrame, float | None]:
    """Indicators, winsorising and derived features; also the outlier report and the temperature mean."""
    flagged = add_missing_indicators(df, exclude=(target, key))
    columns = numeric_columns(flagged, (target, key))
    fences = Fences.fit(flagged, columns=columns) if columns else Fences({})
    capped = fences.apply(flagged)
    mean = temperature_mean(capped)
    return add_features(capped, mean), fences.report(flagged), mean


def preparation(excluded: Sequence[str]) -> list:
    """Median imputation, variance filter, robust scaling, assembly; fitted per fold."""
    return [stage(excluded=list(excluded)) for stage in (MedianImputer, VarianceFilter, ExactRobustScaler, FeatureVector)]


def preprocessing_pipeline(learner, excluded: Sequence[str] = ()) -> Pipeline:
    """The preparation stages followed by any ``pyspark.ml`` learner."""
    return Pipeline(stages=[*preparation(excluded), learner])


def _labelled(df: DataFrame, target: str, labels: list[str] | None) -> DataFrame:
    if labels is None:
        return df.withColumn("label", F.col(target).cast("double"))
    chain = F.lit(None).cast("double")
    for i, name in enumerate(labels):
        chain = F.when(F.col(target) == name, F.lit(float(i))).otherwise(chain)
    return df.withColumn("label", chain)


def _score(scored: DataFrame, regression: bool) -> float:
    if regression:
        return metrics.r2_from(scored, "label", "prediction").first()["r2"]
    return metrics.accuracy_from(scored, "label", "prediction").first()["accuracy"]


class _Fold:
    """Prepared rows of one fold: cached for its first candidate, dropped after its last."""

    def __init__(self, make: Callable[[], tuple[DataFrame, DataFrame]], n_classes: int, users: int):
        self._make, self._n_classes, self._users, self._lock = make, n_classes, users, Lock()
        self._made: tuple[DataFrame, DataFrame, FitFacts] | None = None

    def rows(self) -> tuple[DataFrame, DataFrame, FitFacts]:
        with self._lock:
            if self._made is None:
                fit_on, check_on = (df.persist() for df in self._make())
                self._made = fit_on, check_on, _facts(fit_on, self._n_classes)
            return self._made

    def leave(self) -> None:
        with self._lock:
            self._users -= 1
            if self._users == 0 and self._made is not None:
                self._made[0].unpersist()
                self._made[1].unpersist()
                self._made = None


def cross_validate(
    train: DataFrame, target: str, key: str, candidates: Sequence[Candidate], draws: int, labels: list[str] | None, folds: int = FOLDS
) -> tuple[dict[str, tuple[float, dict]], dict[str, str]]:
    """Best mean score and settings per candidate, and the message of each one that failed.

    The preparation is fitted once per fold and shared by all settings, which have no part in it. Learners that iterate run many
    short jobs, so on tables of up to ``MANY_FOLDS_ROWS`` rows no fold waits for the slowest learner of the one before.
    """
    regression = labels is None
    folded = cut(_labelled(assign_folds(train, key, folds, [] if regression else [target]), target, labels))
    excluded = [target, key, "fold", "label"]
    rows = folded.count()
    tasks = -(-rows // ROWS_PER_TASK) or 1
    combos = {c.name: sample_grid(c.grid, draws) for c in candidates}
    scores: dict[str, list[list[float]]] = {c.name: [[0.0] * folds for _ in combos[c.name]] for c in candidates}
    errors: dict[str, dict[int, str]] = {}

    def without(fold: int) -> DataFrame:
        return folded.where(F.col("fold") != fold)

    try:
        with ThreadPoolExecutor(max_workers=min(PARALLEL, folds)) as pool:
            preps = list(pool.map(lambda fold: Pipeline(stages=preparation(excluded)).fit(without(fold)), range(folds)))
    except Exception as error:  # no candidate can be fitted without its preparation
        return {}, {c.name: _message(error) for c in candidates}

    def prepared(fold: int) -> tuple[DataFrame, DataFrame]:
        fit_on = preps[fold].transform(without(fold)).select("label", "features").coalesce(tasks)
        return fit_on, preps[fold].transform(folded.where(F.col("fold") == fold)).select("label", "features")

    parts = [_Fold(lambda fold=fold: prepared(fold), len(labels or []), len(candidates)) for fold in range(folds)]

    def run(fold: int, candidate: Candidate) -> None:
        if candidate.name not in errors:
            fit_on, check_on, facts = parts[fold].rows()
            try:
                for i, settings in enumerate(combos[candidate.name]):
                    model = candidate.build(settings, facts).fit(fit_on)
                    scores[candidate.name][i][fold] = _score(model.transform(check_on), regression)
            except Exception as error:
                errors.setdefault(candidate.name, {})[fold] = _message(error)
        parts[fold].leave()

    at_once = folds if rows <= MANY_FOLDS_ROWS else 1
    for first in range(0, folds, at_once):
        with ThreadPoolExecutor(max_workers=PARALLEL) as pool:
            list(pool.map(lambda pair: run(*pair), [(fold, c) for fold in range(first, min(first + at_once, folds)) for c in candidates]))
    failed = {name: found[min(found)] for name, found in errors.items()}
    best = {}
    for c in candidates:
        if c.name not in failed:
            means = [sum(s) / len(s) for s in scores[c.name]]
            top = max(range(len(means)), key=means.__getitem__)
            best[c.name] = (means[top], combos[c.name][top])
    return best, failed


def _message(error: BaseException) -> str:
    """First line of an error's text, or its kind where it has none."""
    return next(iter(str(error).splitlines()), "") or type(error).__name__


def _facts(prepared: DataFrame, n_classes: int) -> FitFacts:
    row = prepared.agg(F.count("*"), F.stddev_pop("label")).first()
    return FitFacts(int(row[0]), float(row[1] or 0.0), len(prepared.select("features").first()[0]), n_classes)


def train(
    df: DataFrame,
    target: str,
    key: str,
    candidates: Sequence[Candidate] | None = None,
    draws: int | None = None,
    folds: int = FOLDS,
    temp_mean: float | None = None,
) -> tuple[Trained | None, DataFrame, list[tuple[str, float | None, str, str | None]]]:
    """Race the candidates and refit the winner; the table comes back with its ``split`` column.

    A numeric target is a regression, any other one a classification (cast a numeric class to text).
    The first element is ``None`` when every candidate failed.
    """
    regression = isinstance(df.schema[target].dataType, NumericType)
    if candidates is None:
        candidates = regression_candidates() if regression else classification_candidates()
    if draws is None:
        draws = REGRESSION_DRAWS if regression else CLASSIFICATION_DRAWS
    whole = cut(train_test_split(df, key, by=[] if regression else [target]))
    fit_on = whole.where(F.col("split") == "train").drop("split")
    indexer = None
    if not regression:
        indexer = StringIndexer(inputCol=target, outputCol="label", stringOrderType="alphabetAsc", handleInvalid="keep").fit(fit_on)
    labels = list(indexer.labels) if indexer else None
    best, failed = cross_validate(fit_on, target, key, candidates, draws, labels, folds)
    board = [(n, s, "ok", None) for n, (s, _) in best.items()] + [(n, None, "failed", e) for n, e in failed.items()]
    if not best:
        return None, whole, board
    name = min(best, key=lambda n: (-best[n][0], n))
    score, settings = best[name]
    chosen = next(c for c in candidates if c.name == name)
    labelled = _labelled(fit_on, target, labels)
    prep = Pipeline(stages=preparation([target, key, "label"])).fit(labelled)
    prepared = prep.transform(labelled).coalesce(-(-labelled.count() // ROWS_PER_TASK) or 1).persist()
    fitted = chosen.build(settings, _facts(prepared, len(labels or []))).fit(prepared)
    prepared.unpersist()
    stages = [*prep.stages, fitted]
    if labels:
        stages.append(IndexToString(inputCol="prediction", outputCol="predicted", labels=labels))
    order = [c for c in fit_on.columns if c not in (target, key)]
    trained = Trained(PipelineModel(stages), name, score, board, order, target, regression, temp_mean, settings)
    return trained, whole, board


def predictions(trained: Trained, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep`` columns with the prediction (a label for classifiers)."""
    out = "prediction" if trained.regression else "predicted"
    return trained.model.transform(df).select(*keep, F.col(out).alias("predicted"))


def evaluate(trained: Trained, whole: DataFrame) -> DataFrame:
    """Tidy figures of both splits, with the over-fit gap."""
    scored = predictions(trained, whole, ["split", trained.target])
    if trained.regression:
        found = metrics.r2_from(scored, trained.target, "predicted", ["split"])
        long = found.unpivot(["split"], ["r2", "mae"], "name", "value")
        main = "r2"
    else:
        found = metrics.accuracy_from(scored, trained.target, "predicted", ["split"])
        long = found.select("split", F.lit("accuracy").alias("name"), F.col("accuracy").alias("value"))
        main = "accuracy"
    by = {s: F.max(F.when(F.col("split") == s, F.col(main))) for s in ("train", "test")}
    gap = found.agg((by["train"] - by["test"]).alias("value")).select(F.lit("train-test").alias("split"), F.lit(f"{main}_gap").alias("name"), "value")
    return long.unionByName(gap)

"""Candidate learners and their hyper-parameter grids."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml import Estimator
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor

# Seed and draws of the hyper-parameter search.
SEED = 42
REGRESSION_DRAWS = 12
CLASSIFICATION_DRAWS = 10

# Hyper-parameter grids.
TREES = [100, 200, 300]
# Spark grows trees to depth 30 at most; that stands for unlimited depth.
FOREST_DEPTHS = [6, 8, 10, 30]
FOREST_FEATURES = ["0.5", "0.6", "0.8"]
REGRESSION_LEAF = [5, 10, 20]
CLASSIFICATION_LEAF = [10, 15, 25]
RIDGE_ALPHA = [0.01, 0.1, 1.0, 10.0, 100.0]
LOGISTIC_C = [0.1, 0.3, 0.5, 1.0, 2.0]
BOOST_DEPTHS = [3, 5, 7]
BOOST_RATES = [0.03, 0.05, 0.1]
BOOST_ROWS = [0.7, 0.8, 1.0]
BOOST_FEATURES = ["0.6", "0.8", "1.0"]
HIDDEN_LAYERS = [(64,), (64, 32), (128, 64)]
MAX_ITERATIONS = 500


@dataclass(frozen=True)
class FitFacts:
    """What a learner's settings may depend on (``label_std`` is the population deviation)."""

    rows: int
    label_std: float
    n_features: int
    n_classes: int


@dataclass(frozen=True)
class Candidate:
    name: str
    build: Callable[[dict, FitFacts], Estimator]
    grid: dict[str, Sequence]


def _forest(kind):
    def build(p: dict, facts: FitFacts) -> Estimator:
        return kind(
            numTrees=p["trees"],
            maxDepth=p["depth"],
            minInstancesPerNode=p["leaf"],
            featureSubsetStrategy=p["features"],
            labelCol="label",
            seed=SEED,
        )

    return build


def _ridge(p: dict, facts: FitFacts) -> Estimator:
    """Closed-form ridge with penalty ``alpha`` in one pass: Spark's loss is divided by n and by the label's deviation."""
    return LinearRegression(
        regParam=p["alpha"] * facts.label_std / facts.rows,
        elasticNetParam=0.0,
        standardization=False,
        solver="normal",
        labelCol="label",
    )


def _boost(kind, wrap=lambda learner: learner):
    def build(p: dict, facts: FitFacts) -> Estimator:
        learner = kind(
            maxIter=p["trees"],
            maxDepth=p["depth"],
            stepSize=p["rate"],
            subsamplingRate=p["rows"],
            featureSubsetStrategy=p["features"],
            labelCol="label",
            seed=SEED,
        )
        return wrap(learner)

    return build


def _logistic(p: dict, facts: FitFacts) -> Estimator:
    return LogisticRegression(
        regParam=1.0 / (p["c"] * facts.rows), standardization=False, family="multinomial", maxIter=MAX_ITERATIONS, labelCol="label"
    )


def _perceptron(p: dict, facts: FitFacts) -> Estimator:
    layers = [facts.n_features, *p["hidden"], facts.n_classes]
    return MultilayerPerceptronClassifier(layers=layers, maxIter=MAX_ITERATIONS, seed=SEED, labelCol="label")


def regression_candidates() -> list[Candidate]:
    forest = {"trees": TREES, "depth": FOREST_DEPTHS, "leaf": REGRESSION_LEAF, "features": FOREST_FEATURES}
    boost = {"trees": TREES, "depth": BOOST_DEPTHS, "rate": BOOST_RATES, "rows": BOOST_ROWS, "features": BOOST_FEATURES}
    return [
        Candidate("RandomForest", _forest(RandomForestRegressor), forest),
        Candidate("Ridge", _ridge, {"alpha": RIDGE_ALPHA}),
        Candidate("BoostedTrees", _boost(GBTRegressor), boost),
    ]


def classification_candidates() -> list[Candidate]:
    forest = {"trees": TREES, "depth": FOREST_DEPTHS, "leaf": CLASSIFICATION_LEAF, "features": FOREST_FEATURES}
    boost = {"trees": TREES, "depth": BOOST_DEPTHS, "rate": BOOST_RATES, "rows": BOOST_ROWS, "features": BOOST_FEATURES}
    one_vs_rest = _boost(GBTClassifier, lambda learner: OneVsRest(classifier=learner, labelCol="label"))
    return [
        Candidate("RandomForest", _forest(RandomForestClassifier), forest),
        Candidate("LogisticRegression", _logistic, {"c": LOGISTIC_C}),
        Candidate("MLP", _perceptron, {"hidden": HIDDEN_LAYERS}),
        Candidate("BoostedTrees", one_vs_rest, boost),
    ]


def smaller(candidates: list[Candidate], names: Sequence[str], **grid) -> list[Candidate]:
    """The named candidates with parts of their grids replaced."""
    return [
        Candidate(c.name, c.build, {k: grid.get(k, v) for k, v in c.grid.items()}) for c in candidates if c.name in names
    ]

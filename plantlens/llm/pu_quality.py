"""Quality by positive-unlabelled learning with the non-negative risk.

Trusted positives are labelled rows of quality 1; the unlabelled sample is drawn from all documents, whatever their labels.
With class prior pi, the risk is pi E_P[l(g)] + max(0, E_U[l(-g)] - pi E_P[l(-g)]): the second part stands for the
negatives, which nobody labelled, and must not fall below zero. The prior is estimated from the same two
samples: no set of documents can hold fewer unlabelled rows than prior times its share of the positives.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantlens.llm.common import fold_of, query, record_batch, table, text_runs
from plantlens.llm.labelled import label_of, sample_ids, texts_of


@dataclass(frozen=True)
class Fit:
    """Bounds of the sample that comes to the driver, and the settings of the fit."""

    positive_rows: int = 4000
    unlabelled_rows: int = 8000
    most_chars: int = 20_000
    bins: int = 10
    steps: int = 800
    rate: float = 0.05
    ridge: float = 1e-4
    #: Share of the positives that a set must hold to count for the prior.
    least_share: float = 0.5
    prior_rounds: int = 3
    prior_steps: int = 250


def text_figures(text: str | None) -> np.ndarray:
    """Figures of a whole text; label, language and source play no part."""
    data = (text or "").encode("utf-8", "surrogatepass")
    n = max(len(data), 1)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    at = lambda chars: counts[list(chars)].sum()
    words = data.split()
    m = max(len(words), 1)
    times = Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    ends = sum(x.rstrip()[-1:] in (b".", b"!", b"?", b":", b";", b'"') for x in lines)
    packed = len(zlib.compress(data, 1)) if data else 0
    letters = counts[65:91].sum() + counts[97:123].sum() + counts[128:].sum()
    return np.array([
        np.log1p(len(words)),
        np.log1p(len(lines)),
        at(b"#*$%&|<>@^~{}[]\\_=+") / m,
        at(b"!") / m,
        at(b"|<>/") / m,
        counts[65:91].sum() / max(letters, 1),
        counts[48:58].sum() / n,
        at(b".,;:?") / m,
        letters / n,
        n / m,
        len(times) / m,
        max(times.values(), default=0) / m,
        sum(map(eq, words, words[1:])) / m,
        ends / max(len(lines), 1),
        1 - len(set(lines)) / max(len(lines), 1),
        packed / n,
        sum(w[-1:] in b"#*$%&!" for w in times) / max(len(times), 1),
    ])


def one_hot(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Each figure as its bin, beside a constant."""
    parts = [np.ones((len(x), 1))]
    for j, e in enumerate(edges):
        parts.append(np.eye(len(e) + 1)[np.searchsorted(e, x[:, j], side="right")])
    return np.concatenate(parts, axis=1).astype(np.float32)


def log_loss(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, -z)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def pu_risk(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, float]:
    """Both parts of the risk; the second one before it is held at zero."""
    return prior * float(log_loss(zp).mean()), float(log_loss(-zu).mean()) - prior * float(log_loss(-zp).mean())


def minimise(xp: np.ndarray, xu: np.ndarray, prior: float, fit: Fit) -> np.ndarray:
    """Linear weights by Adam on the non-negative risk: while the negatives' part is below zero, its gradient is followed upwards."""
    w, m, v = np.zeros(xp.shape[1], np.float32), 0.0, 0.0
    for t in range(1, fit.steps + 1):
        zp, zu = xp @ w, xu @ w
        grad_p = -(sigmoid(-zp) @ xp) / len(xp)
        grad_rest = sigmoid(zu) @ xu / len(xu) - prior * (sigmoid(zp) @ xp) / len(xp)
        _, rest = pu_risk(zp, zu, prior)
        g = (prior * grad_p + grad_rest if rest >= 0 else -grad_rest) + fit.ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = (w - fit.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return w


def estimate_prior(xp: np.ndarray, xu: np.ndarray, fit: Fit) -> float:
    """Class prior from a separation of positives and unlabelled rows: the ratio of their shares above a score.

    No cut's true ratio lies below the prior, so the cut with the least upper bound of the ratio is the one to read. One third of the rows
    gives the weights, another one the cut, the last one the ratio at this single cut: no figure is read where it
    was chosen. The thirds serve in all six orders and the ratios are averaged. The separation itself depends on a prior, so it
    is made anew with the figure found.
    """
    if min(len(xp), len(xu)) < 6:
        return 0.5
    prior, brief = 0.7, replace(fit, steps=fit.prior_steps)
    for _ in range(fit.prior_rounds):
        found = []
        for own in range(3):
            w = minimise(xp[own::3], xu[own::3], prior, brief)
            for a, b in ((1, 2), (2, 1)):
                sp, su, tp, tu = (np.sort(x[(own + k) % 3 :: 3] @ w) for x, k in ((xp, a), (xu, a), (xp, b), (xu, b)))
                cuts = np.unique(sp[: max(1, int(len(sp) * (1 - fit.least_share)))])
                share_p = 1 - np.searchsorted(sp, cuts) / len(sp)
                share_u = 1 - np.searchsorted(su, cuts) / len(su)
                bound = (share_u + 2 * np.sqrt((share_u * (1 - share_u) + 1 / len(su)) / len(su))) / share_p
                cut = cuts[int(np.argmin(bound))]
                found.append(float((tu >= cut).mean()) / max(float((tp >= cut).mean()), 1 / len(tp)))
        prior = float(np.clip(np.mean(found), 0.05, 0.98))
    return prior


class Model:
    def __init__(self, edges: list[np.ndarray], weights: np.ndarray, prior: float):
        self.edges, self.weights, self.prior = edges, weights, prior
        starts = np.cumsum([1, *[len(e) + 1 for e in edges]])
        self.tables = [weights[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)] if len(weights) else []

    def score(self, text: str | None) -> float:
        if not self.tables:
            return self.prior
        x = text_figures(text)
        z = self.weights[0] + sum(t[np.searchsorted(e, v, side="right")] for t, e, v in zip(self.tables, self.edges, x, strict=True))
        return float(sigmoid(np.array(z)))


def fit_model(positive: list[str], unlabelled: list[str], fit: Fit = Fit(), prior: float | None = None) -> Model:
    """Model of sampled texts, the same in whatever order they come; without rows of one of the kinds every text gets the prior."""
    if not positive or not unlabelled:
        return Model([], np.zeros(0), 0.5 if prior is None else prior)
    positive, unlabelled = (sorted(texts, key=lambda t: (zlib.crc32(t.encode("utf-8", "surrogatepass")), t)) for texts in (positive, unlabelled))
    p, u = (np.array([text_figures(t) for t in texts]) for texts in (positive, unlabelled))
    both = np.concatenate([p, u])
    # Bins by quantile, closer at both ends, where odd texts stand.
    steps = np.unique(np.concatenate([np.linspace(0, 1, fit.bins + 1)[1:-1], [0.005, 0.02, 0.04, 0.96, 0.98, 0.995]]))
    edges = [np.unique(np.quantile(both[:, j], steps)) for j in range(both.shape[1])]
    xp, xu = one_hot(p, edges), one_hot(u, edges)
    prior = estimate_prior(xp, xu, fit) if prior is None else prior
    return Model(edges, minimise(xp, xu, prior, fit), prior)


def train(docs: DataFrame, labels: DataFrame, fit: Fit = Fit(), id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> Model:
    """Model from positives among ``labels`` and from all ``docs`` as unlabelled rows."""
    marked = label_of(labels, id_column, label_column).where("label = 1")
    positive = sample_ids(marked, "k", fit.positive_rows, "positive")
    unlabelled = sample_ids(docs, id_column, fit.unlabelled_rows, "unlabelled")
    texts = texts_of(docs, sorted({*positive, *unlabelled}), fit.most_chars, id_column, text_column)
    return fit_model([texts[i] for i in positive if i in texts], [texts[i] for i in unlabelled if i in texts], fit)


def quality(shared, text: Column) -> Column:
    """Score of a text column by a broadcast model."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for texts in batches:
            yield pd.Series([shared.value.score(t) for t in texts], dtype="float64")

    return F.pandas_udf(run, "double", functionType=F.PandasUDFType.SCALAR_ITER)(text)


def score_documents(docs: DataFrame, model: Model, held_out: Column, id_column: str = "doc_id", text_column: str = "text", limit: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= ``limit``) of every row; a projection without any shuffle.

    NULL text counts as empty; repeated rows get equal scores; an empty table gives no rows; without positives or documents to learn
    from, every score is the prior. No other column is read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, held = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for s, texts in text_runs(batch.column(2), 8_000_000):
                scores = [shared.value.score(t) for t in texts]
                yield record_batch(schema, [ids[s], held[s], scores, [int(x >= limit) for x in scores]])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


@query()
def op8_pu_quality(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = train(docs, labels.where(fold_of("doc_id", 5) != 0))
    return score_documents(docs, model, fold_of("doc_id", 5) == 0)

"""Toxicity by compression: a window that a dictionary of toxic text shortens more than one of ordinary text.

Two zstandard dictionaries are trained on windows of toxic and of ordinary labelled texts. A window's margin is its compressed length
with the ordinary dictionary minus that with the toxic one. Since toxic documents consist mostly of ordinary
words, the toxic dictionary stands before the ordinary one (what both know cancels out), it is trained again on the windows with
large margins, and the ordinary one also on ordinary windows that had a margin. A further part of the toxic dictionary is trained on words with stems that toxic texts
hold more often, since such stems may never repeat as whole words. Scored windows are
single words (long ones, as of scripts without spaces, in overlapping stretches), closed by a constant run that keeps such short inputs compressible; distinct margins above calibrated thresholds
are counted per document and turned into a probability by a logistic fit on a part of the rows that trained no dictionary.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantlens.llm.common import fold_of, query, record_batch, table, text_runs, words_of
from plantlens.llm.labelled import label_of, sample_ids, texts_of

PAD = b"\n" * 24
THRESHOLDS = (1, 2, 3, 4)
#: Bytes of the longest word that is scored whole.
LONG = 256


@dataclass(frozen=True)
class Fit:
    """Bounds of the fitted sample and of the dictionaries.

    At most ``toxic_rows`` and ``ordinary_rows`` labelled rows of at most ``most_chars`` characters come to the driver; ``windows`` of
    each class train dictionaries of ``toxic_bytes``, ``ordinary_bytes`` and ``hard_bytes`` (ordinary windows that had a margin). Stems of
    ``mers`` bytes in at least ``least_texts`` toxic texts, at ``least_lift`` times the rate of ordinary ones, give a dictionary of ``telling_bytes``.
    """

    toxic_rows: int = 1500
    ordinary_rows: int = 2500
    most_chars: int = 20_000
    window_bytes: int = 32
    windows: int = 50_000
    toxic_bytes: int = 6144
    ordinary_bytes: int = 24_576
    hard_bytes: int = 32_768
    level: int = 6
    rounds: int = 3
    remembered: int = 400_000
    telling_bytes: int = 4096
    mers: tuple[int, ...] = (5, 6, 7)
    least_texts: int = 4
    least_lift: float = 6.0


def text_windows(text: str, size: int) -> list[bytes]:
    """Runs of whole words of at least ``size`` bytes, with a space at both ends."""
    out, run, n = [], [], 0
    for word in words_of(text):
        run.append(word)
        n += len(word) + 1
        if n >= size:
            out.append(b" " + b" ".join(run) + b" ")
            run, n = [], 0
    if run:
        out.append(b" " + b" ".join(run) + b" ")
    return out


def scored_words(text: str) -> set[bytes]:
    """Distinct words; one of more than ``LONG`` bytes as stretches of so many, each half a stretch after the last, to its end."""
    out = set(words_of(text))
    for word in [w for w in out if len(w) > LONG]:
        out.remove(word)
        out.update(word[a : a + LONG] for a in [*range(0, len(word) - LONG, LONG // 2), len(word) - LONG])
    return out


def word_window(word: bytes) -> bytes:
    return b" " + word + b" " + PAD


def dictionary(samples: list[bytes], size: int, segment: int, d: int) -> bytes:
    """A trained dictionary's content; with too few samples for training, the samples themselves."""
    try:
        return zstandard.train_dictionary(min(size, max(256, sum(map(len, samples)) // 4)), samples, k=segment, d=d).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[:size]


class Margins:
    """Compressed lengths with both dictionaries; made in each process from the dictionaries' bytes."""

    def __init__(self, toxic: bytes, ordinary: bytes, level: int):
        params = zstandard.ZstdCompressionParameters.from_level(level, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)
        raw = zstandard.DICT_TYPE_RAWCONTENT
        self.plain = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(ordinary, dict_type=raw), compression_params=params).compress
        self.toxic = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(toxic + ordinary, dict_type=raw), compression_params=params).compress

    def of(self, window: bytes) -> int:
        return len(self.plain(window)) - len(self.toxic(window))


class Model:
    """Dictionaries, thresholds and logistic weights; travels in a broadcast of fixed size."""

    def __init__(self, toxic: bytes, ordinary: bytes, weights: np.ndarray, prior: float, fit: Fit):
        self.toxic, self.ordinary, self.weights, self.prior, self.fit = toxic, ordinary, weights, prior, fit

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("margins", "known")}

    def levels(self, words: set[bytes]) -> np.ndarray:
        """How many distinct words reach each threshold. Margins of words are remembered, as words repeat."""
        if not hasattr(self, "margins"):
            self.margins, self.known = Margins(self.toxic, self.ordinary, self.fit.level), {}
        known, of = self.known, self.margins.of
        if len(known) > self.fit.remembered:
            known.clear()
        counts = [0] * (THRESHOLDS[-1] + 1)
        for word in words:
            m = known.get(word)
            if m is None:
                m = known[word] = of(word_window(word))
            if m > 0:
                counts[min(m, THRESHOLDS[-1])] += 1
        return np.cumsum(counts[::-1])[::-1][list(THRESHOLDS)]

    def score(self, text: str | None) -> float:
        if len(self.weights) == 0:
            return self.prior
        words = scored_words(text or "")
        z = float(features(self.levels(words), len(words)) @ self.weights)
        return 1.0 / (1.0 + np.exp(-max(-30.0, min(30.0, z))))


def features(levels: np.ndarray, n_words: int) -> np.ndarray:
    """Counts at each threshold, damped, beside the text's size (long texts meet a threshold by chance more often)."""
    size = np.log1p(n_words)
    per = levels / np.sqrt(n_words + 10.0)
    return np.concatenate([[1.0, size], np.log1p(levels), per])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Logistic weights by Newton's method with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def telling_words(toxic: list[str], ordinary: list[str], fit: Fit) -> tuple[list[bytes], set[bytes]]:
    """Words of toxic texts with a stretch of bytes that more of those hold than ordinary texts do, once for each text; all words with one.

    Stretches of ``fit.mers`` bytes, the space before a word counted in, tell stems apart that no whole word repeats often enough to show.
    """
    stretches = lambda w: {x[i : i + n] for x in (b" " + w + b" ",) for n in fit.mers for i in range(len(x) - n + 1)}
    toxic_words, ordinary_words = ([scored_words(t) for t in texts] for texts in (toxic, ordinary))
    counts = Counter(s for found in toxic_words for s in set().union(*map(stretches, found)))
    often = {s: n for s, n in counts.items() if n >= fit.least_texts}
    counts = Counter(s for found in ordinary_words for s in set().union(*map(stretches, found)) if s in often)
    lift = fit.least_lift * len(toxic) / max(1, len(ordinary))
    telling = {s for s, n in often.items() if n > lift * (counts[s] + 1)}
    known = {w for w in set().union(*toxic_words, *ordinary_words) if not telling.isdisjoint(stretches(w))}
    return [b" " + w + b" " for found in toxic_words for w in sorted(found) if w in known], known


def fit_model(toxic_texts: list[str], ordinary_texts: list[str], prior: float, fit: Fit = Fit()) -> Model:
    """Dictionaries from two thirds of the sampled texts, thresholds' weights from the rest, weighted to the ``prior`` share of toxic rows."""
    if not toxic_texts or not ordinary_texts:
        return Model(b"", b"", np.zeros(0), prior, fit)
    rng = random.Random(7)
    share = lambda rows: (rows, rows) if len(rows) < 30 else ([t for i, t in enumerate(rows) if i % 3], rows[::3])
    (toxic, toxic_rest), (ordinary, ordinary_rest) = share(toxic_texts), share(ordinary_texts)

    def distinct(texts: list[str]) -> list[bytes]:
        """Distinct windows of whole texts: a passage that is repeated everywhere counts once."""
        found = sorted({w for t in texts for w in text_windows(t, fit.window_bytes)})
        rng.shuffle(found)
        return found[: fit.windows]

    toxic_windows, ordinary_windows = distinct(toxic), distinct(ordinary)
    words = sorted({w for t in ordinary for w in scored_words(t)})
    base = dictionary(ordinary_windows, fit.ordinary_bytes, 64, 8)
    telling, excused = telling_words(toxic, ordinary, fit)
    words = [w for w in words if w not in excused]
    stems = dictionary(telling, fit.telling_bytes, 16, 6) if telling else b""
    mark, hard = dictionary(toxic_windows, fit.toxic_bytes, 24, 6), b""
    for turn in range(fit.rounds):
        margins = Margins(stems + mark, hard + base, fit.level)
        wrong = [w for w in words if margins.of(word_window(w)) >= THRESHOLDS[1]]
        rng.shuffle(wrong)
        hard = (b"".join(b" " + w for w in wrong)[: fit.hard_bytes // 2] + hard)[: fit.hard_bytes]
        if turn + 1 < fit.rounds:
            margins = Margins(stems + mark, hard + base, fit.level)
            picked = [w for w in toxic_windows if margins.of(w) >= 3]
            if len(picked) >= 100:
                mark = dictionary(picked, fit.toxic_bytes, 24, 6)
    model = Model(stems + mark, hard + base, np.zeros(0), prior, fit)
    rows = [(t, 1.0) for t in toxic_rest] + [(t, 0.0) for t in ordinary_rest]
    x = np.array([features(model.levels(v := scored_words(t)), len(v)) for t, _ in rows])
    y = np.array([label for _, label in rows])
    model.weights = logistic(x, y)
    # The sample holds more toxic rows than the labelled table; the constant moves back to the table's odds.
    model.weights[0] += np.log(prior / (1 - prior)) - np.log(len(toxic_rest) / len(ordinary_rest))
    return model


def train(docs: DataFrame, labels: DataFrame, fit: Fit = Fit(), id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> Model:
    """Model from the rows of ``docs`` that ``labels`` marks 0 or 1; the share of toxic rows is counted over all labels."""
    marked = label_of(labels, id_column, label_column)
    counts = dict(marked.groupBy("label").count().collect())
    toxic = sample_ids(marked.where("label = 1"), "k", fit.toxic_rows, "toxic")
    ordinary = sample_ids(marked.where("label = 0"), "k", fit.ordinary_rows, "ordinary")
    texts = texts_of(docs, toxic + ordinary, fit.most_chars, id_column, text_column)
    total = sum(counts.values())
    prior = min(0.99, max(0.001, counts.get(1, 0) / total)) if total else 0.0
    return fit_model([texts[i] for i in toxic if i in texts], [texts[i] for i in ordinary if i in texts], prior, fit)


def toxicity(shared, text: Column) -> Column:
    """Score of a text column by a broadcast model."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        model = shared.value
        for texts in batches:
            yield pd.Series([model.score(t) for t in texts], dtype="float64")

    return F.pandas_udf(run, "double", functionType=F.PandasUDFType.SCALAR_ITER)(text)


def score_documents(docs: DataFrame, model: Model, held_out: Column, id_column: str = "doc_id", text_column: str = "text", limit: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= ``limit``) of every row; a projection without any shuffle.

    NULL text counts as empty; repeated rows get equal scores; an empty table gives no rows; without labels of both
    kinds every score is the share of toxic labels. No other column is read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            ids, held = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for s, texts in text_runs(batch.column(2), 8_000_000):
                scores = [m.score(t) for t in texts]
                yield record_batch(schema, [ids[s], held[s], scores, [int(x >= limit) for x in scores]])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


@query()
def op3_toxicity(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = train(docs, labels.where(fold_of("doc_id", 4) != 2))
    return score_documents(docs, model, fold_of("doc_id", 4) == 2)

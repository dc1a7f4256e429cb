"""Language-model scores from a log-frequency Bloom filter.

N-gram counts of the whole training part are put in logarithmic classes; an n-gram of class q enters
the filter q times, as (n-gram, 1) ... (n-gram, q). A count is read by probing (n-gram, 1), (n-gram, 2), ...
until a probe fails, so it can only be read too high, with a probability that falls geometrically.
The filter is built bucket by bucket in tasks (a bucket of the hash space is a section of the
filter); its size follows the number of training tokens, so its load has a proven bound at every size (entries number at
most 4/3 of tokens for each n-gram length). Up to ``max_bits`` it is broadcast. A larger one is never put together: the distinct n-grams of
each run of texts go to the tasks of their buckets, a stretch of neighbouring buckets in one row; each section is made and probed there, and
the classes go back to the run. Both ways read the same sections, so scores do not depend on the way.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.llm.common import END_HASH, Words, fold_of, join_hash, power_of_two, query, record_batch, table, text_runs, text_slices
from plantlens.llm.log_filter import PACKED, STRETCHED, Filter, build_filter, by_stretch, class_counts, packed, probe_sections, stretched
from plantlens.session import cut

ORDER = 2
BITS_PER_TOKEN = 4
MIN_BITS, MAX_BITS = 1 << 20, 1 << 30
BUCKET_TOKENS = 1 << 20
HEAD_WORDS = 1 << 18
#: Bytes of the texts whose n-grams are asked for together.
RUN_BYTES = 8_000_000
#: N-grams that a task counts together before they go to the sections of a filter that is too large to travel.
PACK_GRAMS = 6_000_000
#: Weight of an n-gram whose context is frequent, and the context count at which half of it is reached.
TRUST, HALF = 0.25, 2.0

END = b""
START_HASH = np.uint64(0x5851F42D4C957F2D)
ORDER_SALT = 0x2545F4914F6CDD1D


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and text ends of a task, counted per run of texts; the words are those of ``words_of``."""
    for batch in batches:
        for s in text_slices(batch.column(0), RUN_BYTES):
            texts = batch.column(0).slice(s.start, s.stop - s.start)
            found = pc.ascii_split_whitespace(pc.ascii_lower(texts)).flatten().value_counts()
            words = found.field("values").cast(pa.binary())
            # Space before the first or after the last word leaves an empty one.
            real = pc.greater(pc.binary_length(words), 0)
            yield pa.RecordBatch.from_arrays([words.filter(real), found.field("counts").filter(real)], names=["word", "n"])
            yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([len(texts)], pa.int64())], names=["word", "n"])


def padded(texts: list[str | None], order: int) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words, their hashes with ``order - 1`` start marks before each text and its end after it, and text lengths."""
    words = Words(texts)
    lengths = words.counts + order
    stops = np.cumsum(lengths)
    hashes = np.full(int(stops[-1]) if len(stops) else 0, START_HASH, dtype=np.uint64)
    text = np.repeat(np.arange(len(lengths)), words.counts)
    hashes[np.arange(len(words.hashes)) + text * order + order - 1] = words.hashes
    hashes[stops - 1] = END_HASH
    return words, hashes, lengths


def windows(hashes: np.ndarray, lengths: np.ndarray, order: int) -> list[np.ndarray]:
    """For k = 1 .. order, hashes of the k-word windows ending at each position; windows across texts are 0."""
    place = np.arange(len(hashes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out, run = [], hashes
    for k in range(1, order + 1):
        if k > 1:
            run = np.concatenate([np.zeros(1, np.uint64), join_hash(run[:-1], hashes[1:])])
        salted = run ^ np.uint64(ORDER_SALT * k & 0xFFFFFFFFFFFFFFFF)
        out.append(np.where(place >= k - 1, salted, np.uint64(0)))
    return out


def count_ngrams(order: int, bucket_bits: int, pack: Callable[[list[np.ndarray], int], pa.RecordBatch] = packed, most: int = 1_500_000):
    """Task-side counts of about ``most`` n-grams at a time, packed by bucket or as ``pack`` says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            for _, texts in text_runs(batch.column(0), 1_500_000):
                _, hashes, lengths = padded(texts, order)
                for w in windows(hashes, lengths, order):
                    w = w[w != 0]
                    parts.append(w)
                    size += len(w)
                if size > most:
                    yield pack(parts, bucket_bits)
                    parts, size = [], 0
        if size:
            yield pack(parts, bucket_bits)

    return run


class Read:
    """Counts of a run's n-grams that were read in the tasks of their buckets."""

    def __init__(self, grams: np.ndarray, levels: np.ndarray):
        self.grams, self.levels = grams, levels

    def counts(self, grams: np.ndarray) -> np.ndarray:
        """Counts of n-grams of the run; 0 where the hash is 0."""
        if len(self.grams) == 0:
            return np.zeros(len(grams))
        distinct, back = np.unique(grams, return_inverse=True)
        at = np.minimum(np.searchsorted(self.grams, distinct), len(self.grams) - 1)
        return np.where(self.grams[at] == distinct, class_counts(1)[self.levels[at]], 0.0)[back]


class Model:
    """Filter (none if it is too large to travel), totals and the counts of the most frequent words (by sorted word hash)."""

    def __init__(self, filter_: Filter | None, order: int, tokens: int, words: int, unseen: float, head: tuple[np.ndarray, np.ndarray]):
        self.filter, self.order, self.tokens, self.words, self.unseen, self.head = filter_, order, tokens, words, unseen, head

    def head_counts(self, hashes: np.ndarray) -> np.ndarray:
        """Exact counts of frequent words, 0 for all others."""
        known, counts = self.head
        if len(known) == 0:
            return np.zeros(len(hashes))
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        return np.where(known[at] == hashes, counts[at], 0)

    def log_probabilities(self, filter_: Filter | Read, hashes: np.ndarray, lengths: np.ndarray, distinct: np.ndarray, back: np.ndarray) -> np.ndarray:
        """log10 of each position's probability: n-gram shares mixed with the next shorter ones, down to words."""
        grams = windows(hashes, lengths, self.order)
        words = filter_.counts(distinct ^ np.uint64(ORDER_SALT))[back]
        p = np.where(words > 0, (1 - self.unseen) * words / max(self.tokens, 1), self.unseen)
        context = words
        for k in range(1, self.order):
            before = np.concatenate([[0.0], context[:-1]])
            seen = filter_.counts(np.where(before > 0, grams[k], np.uint64(0)))
            weight = TRUST * before / (before + HALF)
            share = np.minimum(seen / np.maximum(before, 1.0), 1.0)
            p = np.where(before > 0, weight * share + (1 - weight) * p, p)
            context = seen
        return np.log10(np.maximum(p, 1e-300))


def train_model(texts: DataFrame, order: int = ORDER, max_bits: int = MAX_BITS, head_words: int = HEAD_WORDS) -> tuple[Model, DataFrame, int, int]:
    """Model of a one-column table of texts, its exact word counts ``(word, n)`` as a written table, and the filter's bits and bucket bits."""
    counts = cut(texts.mapInArrow(count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") == 1)).first()
    words, tokens, single = int(total[0]), int(total[1]), int(total[2])
    top = counts.orderBy(F.desc("n"), "word").limit(head_words).toArrow()
    frequent = top.column("word").to_pylist()
    hashes = np.full(len(frequent), END_HASH, dtype=np.uint64)
    hashes[[w != END for w in frequent]] = Words([w for w in frequent if w != END]).hashes
    by_hash = np.argsort(hashes)
    head = (hashes[by_hash], top.column("n").to_numpy()[by_hash].astype(np.float64))
    bits = power_of_two(BITS_PER_TOKEN * max(order, 1) / 2 * tokens, MIN_BITS, 1 << 60)
    bucket_bits = power_of_two(order * tokens / BUCKET_TOKENS, 1, bits >> 13).bit_length() - 1
    filter_ = build_filter(texts.mapInArrow(count_ngrams(order, bucket_bits), PACKED), bits, bucket_bits, 1) if bits <= max_bits else None
    unseen = min(0.5, max(single, 1) / max(tokens, 2))
    return Model(filter_, order, tokens, words, unseen, head), counts, bits, bucket_bits


SCORED = "doc_id long, held_out boolean, n_tokens long, n_head long, head_score double, score double, rare array<binary>, times array<long>"


def score_run(model: Model, filter_: Filter | Read, ids: list, held: list, words: Words, hashes: np.ndarray, lengths: np.ndarray) -> pa.RecordBatch:
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_head", pa.int64()), ("head_score", pa.float64()),
                        ("score", pa.float64()), ("rare", pa.list_(pa.binary())), ("times", pa.list_(pa.int64()))])
    all_rest = math.log10(model.tokens + model.words + 1)
    back, distinct = pd.factorize(hashes)
    log_p = model.log_probabilities(filter_, hashes, lengths, distinct, back)
    exact = model.head_counts(distinct)
    frequent, base = (exact > 0)[back], np.where(exact > 0, np.log10(exact + 1), 0.0)[back]
    rows, first = [], 0
    for n, stop in zip(words.counts.tolist(), np.cumsum(lengths).tolist(), strict=True):
        own = slice(stop - n - 1, stop)
        at = np.flatnonzero(~frequent[own]).tolist()
        rare = Counter([words.word(first + i) if i < n else END for i in at])
        rows.append((n + 1, n + 1 - len(at), float(base[own].sum()) - (n + 1) * all_rest, float(log_p[own].sum()), list(rare), list(rare.values())))
        first += n
    return record_batch(schema, [ids, held, *map(list, zip(*rows, strict=True))])


def score_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            ids, held = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for s, texts in text_runs(batch.column(1), 2_000_000):
                yield score_run(model, model.filter, ids[s], held[s], *padded(texts, model.order))

    return run


def as_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows as runs of texts, one row each, compressed: they are written once and dealt once."""
    for batch in batches:
        for s in text_slices(batch.column(1), RUN_BYTES):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_batch(batch.slice(s.start, s.stop - s.start))
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["rows"])


def run_rows(rows: pa.Scalar) -> list[list]:
    """Ids, texts and held-out flags of a run."""
    return [c.to_pylist() for c in pa.ipc.open_stream(rows.as_buffer()).read_all().columns]


def grams_of(hashes: np.ndarray, lengths: np.ndarray, order: int) -> np.ndarray:
    """Distinct n-grams of a run, in order."""
    grams = np.sort(np.concatenate(windows(hashes, lengths, order)))
    return grams[(grams != 0) & np.concatenate([np.ones(min(1, len(grams)), bool), grams[1:] != grams[:-1]])]


def asked_grams(order: int, bucket_bits: int):
    """The distinct n-grams of each run, by stretch of buckets."""
    schema = pa.schema([("run", pa.int64()), ("stretch", pa.int32()), ("sizes", pa.binary()), ("grams", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, rows in zip(batch.column(0), batch.column(1), strict=True):
                _, hashes, lengths = padded(run_rows(rows)[1], order)
                full, *columns = by_stretch(grams_of(hashes, lengths, order), bucket_bits)
                yield record_batch(schema, [[k.as_py()] * len(full), full, *columns])

    return run


def score_runs(shared):
    """Scores of runs that carry the classes of their n-grams, as (stretch, classes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            for rows, read in zip(*batch.columns, strict=True):
                ids, texts, held = run_rows(rows)
                words, hashes, lengths = padded(texts, model.order)
                levels = b"".join(r["levels"] for r in sorted(read.as_py(), key=lambda r: r["stretch"]))
                filter_ = Read(grams_of(hashes, lengths, model.order), np.frombuffer(levels, np.uint8))
                yield score_run(model, filter_, ids, held, words, hashes, lengths)

    return run


def scores_by_section(rows: DataFrame, texts: DataFrame, shared, order: int, bits: int, bucket_bits: int) -> DataFrame:
    """Scores by a filter of the training ``texts`` that is too large to travel: n-grams go to the sections and their classes come back."""
    runs = cut(rows.mapInArrow(as_runs, "rows binary").withColumn("run", F.monotonically_increasing_id()))
    grams = texts.mapInArrow(count_ngrams(order, bucket_bits, stretched, PACK_GRAMS), STRETCHED)
    asked = runs.select("run", "rows").mapInArrow(asked_grams(order, bucket_bits), "run long, stretch int, sizes binary, grams binary")
    read = grams.groupBy("stretch").cogroup(asked.groupBy("stretch")).applyInArrow(probe_sections(bucket_bits, bits >> bucket_bits, 1), "run long, stretch int, levels binary")
    read = read.groupBy("run").agg(F.collect_list(F.struct("stretch", "levels")).alias("read"))
    return runs.join(read.hint("shuffle_merge"), "run").select("rows", "read").mapInArrow(score_runs(shared), SCORED)


def lm_scores(docs: DataFrame, train: DataFrame, id_column: str = "doc_id", text_column: str = "text", order: int = ORDER, max_bits: int = MAX_BITS, head_words: int = HEAD_WORDS) -> DataFrame:
    """Score every row of ``docs`` by the model of the ``train`` rows.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigrams, exact counts) and score.
    ``docs`` has a boolean ``held_out`` beside id and text; other columns are not read. NULL text is an
    empty one (its end alone is scored), repeated rows are scored each on its own, an empty table gives no rows,
    and without training rows every token has the probability left for unseen words.

    Exact counts: the ``head_words`` most frequent words travel with the model; all other words are looked up by a join of
    (row, word) pairs with the table of counts.
    """
    spark = docs.sparkSession
    texts = train.select(F.col(text_column).alias("text"))
    model, counts, bits, bucket_bits = train_model(texts, order, max_bits, head_words)
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"), "held_out")
    if model.filter is None:
        scores = scores_by_section(rows, texts, shared, order, bits, bucket_bits)
    else:
        scores = rows.mapInArrow(score_batches(shared), SCORED)
    scored = cut(scores.withColumn("row", F.monotonically_increasing_id()))
    pairs = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("p")).select("row", F.col("p.rare").alias("word"), F.col("p.times").alias("times"))
    # The words of the model need no join, so the head does not make hot keys here.
    found = pairs.join(counts, "word", "inner").groupBy("row").agg(
        F.sum("times").alias("n_rare"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("rare_score")
    )
    none = F.lit(0)
    return scored.drop("rare", "times").join(found, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_head") + F.coalesce("n_rare", none)).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("head_score") + F.coalesce("rare_score", F.lit(0.0))).alias("base_score"),
        "score",
    )


@query()
def op1_lm_score(spark, sf):
    docs = table(spark, sf, "documents").withColumn("held_out", fold_of("doc_id", 7) == 2)
    return lm_scores(docs, docs.where(~F.col("held_out")))

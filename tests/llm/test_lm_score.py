import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from plantlens.llm import lm_score, log_filter
from plantlens.llm.common import fold_of
from tests.llm.fixtures import documents, empty


def scored(docs, **kw):
    docs = docs.withColumn("held_out", fold_of("doc_id", 7) == 2)
    return lm_score.lm_scores(docs, docs.where(~F.col("held_out")), **kw)


def test_base_figures_equal_brute_force_with_a_small_head(spark):
    docs = documents(spark)
    rows = [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]
    counts = Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update([*t.encode().lower().split(), b""])
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for i, t in rows:
        tokens = [*t.encode().lower().split(), b""]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens)
        want[(i, zlib.crc32(str(i).encode()) % 7 == 2, len(tokens), sum(counts[w] > 0 for w in tokens), n, round(base, 6))] += 1
    got = scored(docs, head_words=7).collect()
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got)


def test_filter_never_reads_a_count_too_low_and_rarely_too_high():
    rng = np.random.default_rng(1)
    grams = rng.integers(1, 1 << 63, 5000).astype(np.uint64)
    counts = rng.geometric(0.3, 5000)
    parts = np.repeat(grams, counts)
    import pyarrow as pa

    rest = ((parts << np.uint64(0)) >> np.uint64(32)).astype(np.uint32)
    table = pa.table({"bucket": pa.array([0], pa.int32()), "grams": [rest.tobytes()], "counts": [np.ones(len(rest), np.uint32).tobytes()]})
    bits = 1 << 17
    section = log_filter.build_section(bits, 1)(table)
    f = log_filter.Filter(np.frombuffer(section.column("bits")[0].as_py(), np.uint8), 0, bits, 1)
    exact = log_filter.class_counts(1)[log_filter.classes(counts, 1)]
    read = f.counts(grams)
    assert (read >= exact).all() and (read > exact).mean() < 0.1
    assert (f.counts(rng.integers(1, 1 << 63, 5000).astype(np.uint64)) > 0).mean() < 0.1


def test_classes_load_the_filter_with_no_more_than_counts():
    counts = np.arange(1, 5000)
    for floor in (1, 3, 10):
        q = log_filter.classes(counts, floor)
        assert (q[counts < floor] == 0).all() and (q <= 4 / 3 * counts / floor + 1e-9).all() and (np.diff(q) >= 0).all()


def test_model_beats_the_base_on_held_out_copies(spark):
    docs = documents(spark)
    got = scored(docs).where("n_tokens > 10").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_longer_ngrams_and_bounded_filter(spark):
    docs = documents(spark)
    assert scored(docs, order=3, max_bits=1 << 20).count() == docs.count()


def test_scores_do_not_depend_on_what_the_broadcast_holds(spark, monkeypatch):
    docs = documents(spark)
    monkeypatch.setattr(lm_score, "BUCKET_TOKENS", 500)
    columns = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens")
    for order in (1, 2, 3):
        whole, parts = ([(*[r[c] for c in columns], round(r["base_score"], 6), round(r["score"], 6)) for r in scored(docs, order=order, max_bits=b).collect()] for b in (1 << 30, 1 << 12))
        assert len(whole) == docs.count() and Counter(whole) == Counter(parts)
    assert scored(empty(spark), max_bits=1).count() == 0


def test_what_a_run_asks_of_the_sections_goes_in_few_rows(spark, monkeypatch):
    """A row to the sections and back holds the n-grams of a whole stretch of buckets; classes and counts are those of single buckets."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    bucket_bits, section_bits = 6, 1 << 13
    grams = np.unique(rng.integers(1, 1 << 63, 40_000).astype(np.uint64) << np.uint64(1))
    counts = rng.geometric(0.4, len(grams)).astype(np.uint32)
    asked = [np.unique(np.concatenate([rng.choice(grams, 3000), rng.integers(1, 1 << 63, 500).astype(np.uint64)])) for _ in range(5)]
    rows = [log_filter.by_stretch(a, bucket_bits) for a in asked]
    assert all(len(r[0]) <= 8 for r in rows) and all(len(log_filter.by_bucket(a, bucket_bits)[0]) > 8 for a in asked)

    whole = np.zeros(section_bits * 64 // 8, np.uint8)
    for bucket, rest, n in zip(*log_filter.by_bucket(grams, bucket_bits, counts), strict=True):
        whole[bucket * section_bits // 8 : (bucket + 1) * section_bits // 8] = log_filter.section_bits_of(rest, n, section_bits, 1)
    reader = log_filter.Filter(whole, bucket_bits, section_bits, 1)
    made = dict(zip(("stretch", "sizes", "grams", "counts"), log_filter.by_stretch(grams, bucket_bits, counts), strict=True))
    got = [b""] * 5
    for stretch in range(8):
        table = pa.table({"sizes": pa.array([made["sizes"][stretch]], pa.binary()), "grams": [made["grams"][stretch]], "counts": [made["counts"][stretch]]})
        wants = [(k, r[1][r[0].index(stretch)], r[2][r[0].index(stretch)]) for k, r in enumerate(rows) if stretch in r[0]]
        runs, sizes, wanted = zip(*wants, strict=True)
        out = log_filter.probe_sections(bucket_bits, section_bits, 1)(table, pa.table({"run": runs, "stretch": [stretch] * len(runs), "sizes": sizes, "grams": wanted}))
        for k, levels in zip(out.column("run").to_pylist(), out.column("levels").to_pylist(), strict=True):
            got[k] += levels
    for a, levels in zip(asked, got, strict=True):
        assert (log_filter.class_counts(1)[np.frombuffer(levels, np.uint8)] == reader.counts(a)).all()


def test_words_are_counted_as_split(spark):
    import pyarrow as pa

    from plantlens.llm.common import words_of

    rng = np.random.default_rng(2)
    signs = ["a", "B", " ", "\n", "é", "É", "\t", "x", "😀", "\r\n", "\x1c", "\x85", "\x0b", "\x0c", "\x00", "\u00a0"]
    texts = ["".join(rng.choice(signs, rng.integers(0, 30))) for _ in range(500)] + [None, "", " "]
    want = Counter(w for t in texts for w in [*words_of(t or ""), b""])
    got = Counter()
    for batch in lm_score.count_words(iter([pa.record_batch({"text": pa.array(texts, pa.string())}), pa.record_batch({"text": pa.array([None, None], pa.string())})])):
        got.update(dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)))
    want[b""] += 2
    assert got == want


def test_empty_tables(spark):
    assert scored(empty(spark)).count() == 0
    docs = documents(spark).withColumn("held_out", F.lit(True))
    alone = lm_score.lm_scores(docs, docs.where("false"))
    assert alone.where("n_known > 0 or train_tokens > 0").count() == 0 and alone.count() == docs.count()


def test_words_as_arrays_equal_split_words():
    import random

    from plantlens.llm.common import Words, words_of

    rng = random.Random(1)
    for _ in range(200):
        texts = ["".join(rng.choice(["a", "B", " ", "\n", "é", "\t", "x", "😀", "\r\n", "\x1c", "\x85", "\x0b"]) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(0, 6))]
        texts += [None] * rng.randint(0, 2)
        words, want = Words(texts), [words_of(t or "") for t in texts]
        flat = [w for x in want for w in x]
        assert words.counts.tolist() == [len(x) for x in want] and [words.word(i) for i in range(len(flat))] == flat
        seen = {}
        assert all(seen.setdefault(w, h) == h for w, h in zip(flat, words.hashes.tolist(), strict=True)) and len(set(seen.values())) == len(seen)
        assert (words._hash(np.frombuffer(words.data, np.uint8), span=5) == words.hashes).all()

import random
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plantlens.llm import sequence_pack as s
from tests.llm.fixtures import documents, empty, syllables


def optimum(items, capacity):
    """Fewest sequences by exhaustive search."""

    @lru_cache(None)
    def go(left, room):
        if not left:
            return 0
        best = 1 + go(left[1:], tuple(sorted((*room, capacity - left[0]))))
        for r in set(room):
            if r >= left[0]:
                others = list(room)
                others.remove(r)
                best = min(best, go(left[1:], tuple(sorted((*others, r - left[0])))))
        return best

    return go(tuple(sorted(items, reverse=True)), ())


def plain_best_fit(items, capacity):
    rooms = []
    for x in sorted(items, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= x]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= x
        else:
            rooms.append(capacity - x)
    return len(rooms)


def contents(plan):
    total = Counter()
    for c in plan:
        for size, each in c.items:
            total[size] += each * c.times
    return dict(total)


def test_fixed_sets_keep_the_optimum():
    rng = random.Random(3)
    fixed_by_size = Counter()
    for _ in range(400):
        capacity = rng.choice([10, 20, 30])
        items = [rng.randint(1 if rng.random() < 0.3 else capacity // 4, capacity) for _ in range(rng.randint(0, 8))]
        fixed, rest = s.reduce_instance(Counter(items), capacity)
        left = [size for size, n in rest.items() for _ in range(n)]
        assert sum(c.times for c in fixed) + optimum(left, capacity) == optimum(items, capacity), items
        for c in fixed:
            fixed_by_size[sum(n for _, n in c.items)] += 1
        best = s.best_fit(Counter(items), capacity)
        assert contents(best) == dict(Counter(items)) and sum(c.times for c in best) == plain_best_fit(items, capacity)
    assert {1, 2, 3} <= set(fixed_by_size)


def test_plan_of_many_pieces():
    rng = np.random.default_rng(5)
    for capacity, items in ((4096, rng.integers(1, 4097, 20_000)), (4096, np.minimum(rng.geometric(0.002, 50_000), 4096)), (100, rng.integers(30, 60, 5000)), (4096, np.full(9001, 1000))):
        counts = dict(zip(*(x.tolist() for x in np.unique(items, return_counts=True)), strict=True))
        plan = s.plan_sequences(counts, capacity)
        assert contents(plan) == counts and all(sum(a * n for a, n in c.items) <= capacity and c.times > 0 for c in plan)
        assert len(plan) <= 6 * capacity
        assert -(-int(items.sum()) // capacity) <= sum(c.times for c in plan)
        few = items[:1500].tolist()
        assert sum(c.times for c in s.plan_sequences(Counter(few), capacity)) <= plain_best_fit(few, capacity)
    dense = np.minimum(rng.geometric(0.002, 50_000), 4096)
    plan = s.plan_sequences(dict(zip(*(x.tolist() for x in np.unique(dense, return_counts=True)), strict=True)))
    assert sum(c.times for c in plan) - -(-int(dense.sum()) // 4096) <= 1
    with pytest.raises(ValueError, match="between 1 and"):
        s.plan_sequences({0: 1})


def check(rows, capacity):
    """Every sequence is filled from 0 without gaps, at most to the capacity."""
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_documents_become_whole_gapless_sequences(spark):
    texts = {i: t for i, t in enumerate([syllables(random.Random(i), 40 * i) for i in range(12)])}
    docs = documents(spark).select("doc_id", "text", "score", "k").unionByName(spark.createDataFrame([(100 + i, t) for i, t in texts.items()], "doc_id long, text string"), allowMissingColumns=True)
    codec = Tokenizer.from_file(s.default_model())
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = [*codec.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        for piece, a in enumerate(range(0, len(ids), 64)):
            part = ids[a : a + 64]
            want[r["doc_id"], piece, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    pieces = s.token_pieces(docs, s.default_model(), capacity=64, with_ids=True)
    packed = s.pack(pieces, 64)
    rows = packed.collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    n = check(rows, 64)
    lengths = [r["length"] for r in rows]
    assert -(-sum(lengths) // 64) <= n <= plain_best_fit(lengths, 64)
    whole = {r["sequence_id"]: r["ids"] for r in s.sequence_tokens(packed).collect()}
    for r in rows:
        assert whole[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == r["ids"]
    assert sum(map(len, whole.values())) == sum(lengths)
    assert s.pack(s.token_pieces(empty(spark), s.default_model())).count() == 0


def test_hot_length_over_many_tasks(spark):
    pieces = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 90 + 1).cast("long").alias("length")).repartition(13)
    rows = s.pack(pieces, 100).collect()
    assert len(rows) == 3000 == len({r["doc_id"] for r in rows})
    assert check(rows, 100) <= plain_best_fit([r["length"] for r in rows], 100)


def test_tokens_by_word_equal_whole_texts(monkeypatch):
    monkeypatch.setattr(s, "REMEMBERED", 3000)
    codec = Tokenizer.from_file(s.default_model())
    with open(s.default_model(), "rb") as file:
        words = s.WordTokens(file.read())
    rng = random.Random(2)
    parts = [" ", "\n", "  ", "\t", "\v", "\f", "\r", "\x1c", "\x85", "\xa0", "\u0301", "\u0327", "e", "É", "ÿÖß", "Größe,", "×", "÷7", "µ", "Σ", "İ", "ẞ", "中", "ᄀ", "ᅡ", "7", "½", "'s", "'", "don't", "ﬁ", "Ab", "😀", "<|", "　", "\u200b", "<|endoftext|>", "\x00", "aaaa"]
    for _ in range(600):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))
        assert words.of(text.encode()).tolist() == codec.encode(text, add_special_tokens=False).ids, text

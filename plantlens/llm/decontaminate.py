"""Benchmark passages in documents: q-gram lemma per diagonal band, then banded alignment.

A passage of L characters that stands in a document with at most k edits shares at least L + 1 - q (k + 1) q-grams with it, on
diagonals (place in the document minus place in the passage) that differ by at most k. Bands of 2 (k + 1)
diagonals that overlap by half hold any such run of diagonals, so regions whose band counts fewer shared q-grams are out
without loss, and the others are aligned within their band. Passages of fewer than q characters have no q-gram; they are looked up whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantlens.llm.common import mix, query, record_batch, table
from plantlens.session import cut

STEP = np.uint64(0x9E3779B97F4A7C15)
#: First and last code points of scripts that are written without spaces between words (Thai to Myanmar, Khmer, kana, Han).
UNSPACED = [(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x312F), (0x31A0, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1B000, 0x1B16F), (0x20000, 0x3FFFF)]


@dataclass(frozen=True)
class Search:
    """``q``: length of q-grams. ``edits_per``: one edit is allowed per so many characters of a segment.

    Items longer than ``whole`` characters are searched as segments of ``segment`` characters, one each ``stride``, so that a stretch of
    ``segment + stride`` characters of a long item is found as well. Items of fewer than ``q`` characters
    (white space joined, lower case) are found where they stand as whole words without an edit; empty ones hold nothing. ``block_chars``: so much text of items
    travels to the workers at once; more items go in further blocks, each with a pass of its own.
    """

    q: int = 12
    edits_per: int = 16
    whole: int = 180
    segment: int = 120
    stride: int = 60
    block_chars: int = 4_000_000


def plain(text: str | None) -> str:
    """Lower case, runs of white space as one space."""
    return " ".join((text or "").lower().split())


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def qgram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q code points from each place on, by doubling the length."""
    have, run, power = 1, codes.astype(np.uint64) + np.uint64(1), STEP
    done, length = None, 0
    with np.errstate(over="ignore"):
        todo = q
        while todo:
            if todo & 1:
                if done is None:
                    done, length = run, have
                else:
                    n = len(run) - length
                    if n <= 0:
                        return np.zeros(0, np.uint64)
                    done, length = done[:n] * power + run[length : length + n], length + have
            todo >>= 1
            if todo:
                n = len(run) - have
                if n <= 0:
                    return np.zeros(0, np.uint64)
                run, power, have = run[:n] * power + run[have : have + n], power * power, have * 2
    return mix(done)


@cache
def word_points() -> np.ndarray:
    """Whether a code point is a letter or digit of a script that sets spaces between words."""
    out = np.fromiter((chr(i).isalnum() for i in range(0x110000)), dtype=bool, count=0x110000)
    for low, high in UNSPACED:
        out[low : high + 1] = False
    return out


def segments(item: str, s: Search) -> list[tuple[int, str]]:
    """Start and text of the parts of an item that are searched."""
    if not item:
        return []
    if len(item) <= s.whole:
        return [(0, item)]
    starts = [*range(0, len(item) - s.segment, s.stride), len(item) - s.segment]
    return [(a, item[a : a + s.segment]) for a in starts]


class Probes:
    """Segments of a block of items with an index of their q-grams."""

    def __init__(self, items: list[tuple[int, str]], search: Search):
        self.search = search
        parts = [(item, start, text) for item, whole in items for start, text in segments(whole, search)]
        self.items = [p[0] for p in parts]
        self.texts = [p[2] for p in parts]
        self.codes = [points(t) for t in self.texts]
        q = search.q
        size = np.array([len(t) for t in self.codes], dtype=np.int64)
        # At least one shared q-gram must be left over by the lemma.
        self.edits = np.maximum(0, np.minimum(size // search.edits_per, size // q - 1))
        self.least = size + 1 - q * (self.edits + 1)
        hashes = [qgram_hashes(c, q) for c in self.codes]
        owner = np.repeat(np.arange(len(parts)), [len(h) for h in hashes]) if parts else np.zeros(0, np.int64)
        place = np.concatenate([np.arange(len(h)) for h in hashes]) if parts else np.zeros(0, np.int64)
        every = np.concatenate(hashes) if parts else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.grams, self.first, self.times = np.unique(every[order], return_index=True, return_counts=True)
        self.owner, self.place = owner[order], place[order]
        # Items below q characters: for each length their hashes, in order, and segments.
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in sorted(set(size[size < q].tolist())):
            own = np.flatnonzero(size == n)
            grams = np.concatenate([qgram_hashes(self.codes[i], n) for i in own])
            order = np.argsort(grams, kind="stable")
            self.short[n] = grams[order], own[order]
        self.present = np.zeros(1 << 22, dtype=bool)
        self.present[(self.grams >> np.uint64(42)).astype(np.int64)] = True

    def candidates(self, codes: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int]]:
        """(text, segment, band) whose shared q-grams meet the lemma's bound; texts begin at ``starts`` of ``codes``."""
        q = self.search.q
        hashes = qgram_hashes(codes, q)
        if len(hashes) == 0 or len(self.grams) == 0:
            return []
        at = np.flatnonzero(self.present[(hashes >> np.uint64(42)).astype(np.int64)])
        index = np.minimum(np.searchsorted(self.grams, hashes[at]), len(self.grams) - 1)
        same = self.grams[index] == hashes[at]
        at, index = at[same], index[same]
        found = []
        todo, total = 0, np.cumsum(self.times[index])
        while todo < len(at):
            # Pairs of equal q-grams in runs of bounded size.
            stop = max(todo + 1, int(np.searchsorted(total, (total[todo - 1] if todo else 0) + 2_000_000)))
            n = self.times[index[todo:stop]]
            where = np.repeat(at[todo:stop], n)
            within = np.arange(len(where)) - np.repeat(np.cumsum(n) - n, n)
            entry = np.repeat(self.first[index[todo:stop]], n) + within
            seg, place = self.owner[entry], self.place[entry]
            text = np.searchsorted(starts, where, side="right") - 1
            # Diagonals are counted from the longest segment's length below 0, so they are positive.
            band = (where - starts[text] - place + (1 << 20)) // (self.edits[seg] + 1)
            for b in (band, band - 1):
                found.append(summed(text, seg, b, np.ones(len(b), np.int64)))
            todo = stop
        if not found:
            return []
        text, seg, band, counts = summed(*map(np.concatenate, zip(*found, strict=True)))
        kept = counts >= self.least[seg]
        return list(zip(text[kept].tolist(), seg[kept].tolist(), band[kept].tolist(), strict=True))

    def whole_words(self, codes: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int]]:
        """(text, segment, end place) of the items below q characters, the first place of each in a text."""
        found: dict[tuple[int, int], int] = {}
        for n, (grams, owner) in self.short.items():
            hashes = qgram_hashes(codes, n)
            if len(hashes) == 0:
                continue
            low = np.searchsorted(grams, hashes)
            at = np.flatnonzero(grams[np.minimum(low, len(grams) - 1)] == hashes)
            # A word may not go on beyond the item; every text ends with a 0, which is no part of a word.
            word, last = word_points(), at + n
            inner = word[codes[np.maximum(at - 1, 0)]] & word[codes[at]] & (at > 0)
            inner |= word[codes[last - 1]] & word[codes[np.minimum(last, len(codes) - 1)]]
            at = at[~inner]
            text = np.searchsorted(starts, at, side="right") - 1
            inside = at + n < np.append(starts[1:], len(codes))[text]
            at, text = at[inside], text[inside]
            # Equal hashes in a text once, at their first place.
            order = np.lexsort((at, hashes[at], text))
            at, text = at[order], text[order]
            new = np.ones(len(at), dtype=bool)
            new[1:] = (text[1:] != text[:-1]) | (hashes[at[1:]] != hashes[at[:-1]])
            for a, t in zip(at[new].tolist(), text[new].tolist(), strict=True):
                for i in range(np.searchsorted(grams, hashes[a]), np.searchsorted(grams, hashes[a], side="right")):
                    if (self.codes[owner[i]] == codes[a : a + n]).all():
                        found[t, int(owner[i])] = a + n - int(starts[t])
        return [(t, s, end) for (t, s), end in found.items()]

    def distance(self, seg: int, band: int, codes: np.ndarray) -> tuple[int, int] | None:
        """Fewest edits of a segment within a band of a text, and the place of its end; None beyond the budget."""
        k = int(self.edits[seg])
        low = band * (k + 1) - (1 << 20)
        return banded(self.codes[seg], codes, low - k, low + 2 * (k + 1) + k, k)


def summed(text: np.ndarray, seg: np.ndarray, band: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct (text, segment, band) in order, with the sums of their counts; three keys, as their product may not fit 64 bits."""
    order = np.lexsort((band, seg, text))
    text, seg, band, counts = text[order], seg[order], band[order], counts[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (seg[1:] != seg[:-1]) | (band[1:] != band[:-1])
    first = np.flatnonzero(new)
    return text[first], seg[first], band[first], np.add.reduceat(counts, first)


def banded(pattern: np.ndarray, text: np.ndarray, low: int, high: int, budget: int) -> tuple[int, int] | None:
    """Edits to find ``pattern`` in ``text`` on the diagonals from ``low`` to ``high - 1``; start and end in the text are free."""
    width, big = high - low, budget + 1
    ramp = np.arange(width, dtype=np.int32)
    padded = np.full(len(pattern) + width, 0xFFFFFFFF, dtype=np.uint32)
    a, b = max(low, 0), min(len(text), low + len(padded))
    if a >= b:
        return None
    padded[a - low : b - low] = text[a:b]
    starts = ramp + low
    row = np.where((starts >= 0) & (starts <= len(text)), 0, big).astype(np.int32)
    for i, c in enumerate(pattern):
        step = row + (padded[i : i + width] != c)
        step[:-1] = np.minimum(step[:-1], row[1:] + 1)
        row = np.minimum.accumulate(step - ramp) + ramp
        if row.min() > budget:
            return None
    ends = ramp + low + len(pattern)
    row = np.where((ends >= 0) & (ends <= len(text)), row, big)
    best = int(row.argmin())
    return (int(row[best]), int(ends[best])) if row[best] <= budget else None


def matches(texts: list[str | None], probes: Probes, limit: int = 1_000_000) -> Iterator[tuple[int, int, int, int]]:
    """(text number, segment, edits, end place) of all segments found, the best band of each; texts in runs of bounded size."""
    start = 0
    while start < len(texts):
        size, stop, codes, starts = 0, start, [], []
        while stop < len(texts) and (size == 0 or size < limit):
            one = points(plain(texts[stop]) + "\0")
            starts.append(size)
            codes.append(one)
            size += len(one)
            stop += 1
        run = np.concatenate(codes)
        best: dict[tuple[int, int], tuple[int, int]] = {(text, seg): (0, end) for text, seg, end in probes.whole_words(run, np.array(starts))}
        for text, seg, band in probes.candidates(run, np.array(starts)):
            if best.get((text, seg), (1, 0))[0] == 0:
                continue
            found = probes.distance(seg, band, codes[text][:-1])
            if found is not None and found < best.get((text, seg), (1 << 30, 0)):
                best[text, seg] = found
        for (text, seg), (edits, end) in sorted(best.items()):
            yield start + text, seg, edits, end
        start = stop


def blocks(benchmark: DataFrame, search: Search, id_column: str, text_column: str) -> Iterator[Probes]:
    """Items in blocks of bounded size; equal (id, text) rows once, NULL texts and ids never."""
    rows = benchmark.select(F.col(id_column).cast("long").alias("i"), F.col(text_column).alias("t")).where("i is not null and t is not null").distinct().orderBy("i", "t")
    held, size = [], 0
    for row in rows.toLocalIterator():
        text = plain(row["t"])
        held.append((row["i"], text))
        size += len(text)
        if size >= search.block_chars:
            yield Probes(held, search)
            held, size = [], 0
    if held:
        yield Probes(held, search)


def leaks(docs: DataFrame, benchmark: DataFrame, search: Search = Search(), doc_id: str = "doc_id", text_column: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Pairs (doc_id, item_id) with the number of the item's segments found, its segments, and the fewest edits of one.

    NULL and empty texts hold nothing; repeated rows give repeated pairs; empty tables give none; other columns are not read.
    """
    spark = docs.sparkSession
    shape = "doc_id long, item_id long, n_found long, n_segments long, edits long"
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "item_id", "n_found", "n_segments", "edits")])
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    done: DataFrame | None = None
    for probes in blocks(benchmark, search, item_id, item_text):
        shared = spark.sparkContext.broadcast(probes)

        def run(batches, shared=shared):
            p = shared.value
            whole: dict[int, int] = {}
            for item in p.items:
                whole[item] = whole.get(item, 0) + 1
            for batch in batches:
                ids, out = batch.column(0).to_pylist(), {}
                for text, seg, edits, _ in matches(batch.column(1).to_pylist(), p):
                    n, least = out.get((text, p.items[seg]), (0, edits))
                    out[text, p.items[seg]] = (n + 1, min(least, edits))
                if out:
                    yield record_batch(schema, [list(c) for c in zip(*((ids[t], i, n, whole[i], e) for (t, i), (n, e) in sorted(out.items())), strict=True)])

        found = rows.mapInArrow(run, shape)
        done = found if done is None else cut(done).unionByName(found)
    return spark.createDataFrame([], shape) if done is None else done


def contaminated(probes, text: Column) -> Column:
    """Whether a text holds any segment of a broadcast block."""

    def run(batches):
        import pandas as pd

        for texts in batches:
            found = np.zeros(len(texts), dtype=bool)
            for i, *_ in matches(texts.tolist(), probes.value):
                found[i] = True
            yield pd.Series(found)

    return F.pandas_udf(run, "boolean", functionType=F.PandasUDFType.SCALAR_ITER)(text)


def without_leaks(docs: DataFrame, benchmark: DataFrame, search: Search = Search(), text_column: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item."""
    spark = docs.sparkSession
    for n, probes in enumerate(blocks(benchmark, search, item_id, item_text)):
        docs = cut(docs) if n else docs
        docs = docs.where(~contaminated(spark.sparkContext.broadcast(probes), F.col(text_column)))
    return docs


@query()
def op9_decontaminate(spark, sf):
    return leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))

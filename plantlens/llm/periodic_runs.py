"""Maximal periodic runs of words in each text, found by block convolution at dyadic scales.

A run is a stretch with smallest period q, at least ``least`` words and 2q long, that no neighbour extends. Its first length - q words
each equal the word q later, so at the scale of block length B, which serves the periods from 2B to below 4B (B = 4 also
those from 1 to 3), a whole block that starts at a multiple of B lies in that part and occurs again q words later. Where blocks occur in the windows that follow them is found by
convolution: the squared differences of a block and a window at all distances are sums of squares minus twice a correlation, which a
number-theoretic transform gives exactly, modulo 65537. Zero there is needed for a match, so no
match is missed, and each distance found is compared with the words themselves and extended to both sides.

Texts of a batch are joined with words of their own between them, and all blocks of a scale are transformed side by side. Blocks are at
most ``LONGEST`` words; larger scales keep their distance between blocks and look through more windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantlens.llm.common import WordNumbers, byte_runs, mix, query, table

#: 2^16 + 1; 3 generates its units, so transforms of up to 2^16 numbers exist.
PRIME = 65537
GENERATOR = 3
LONGEST = 1024
#: Numbers that are transformed side by side.
SLAB = 1 << 16
#: Steps of the joint extension; what still matches then is extended alone, in growing strides.
STEPS = 24
#: Distinct words after which the table of word numbers starts anew, and bytes of text that are joined at a time.
REMEMBERED = 400_000
RUN_BYTES = 1 << 20

RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", RUN_TYPE), ("collapsed", pa.string())])


def fold(x: np.ndarray) -> np.ndarray:
    """Nearer to zero modulo the prime: 2^16 is -1."""
    return (x & 0xFFFF) - (x >> 16)


@lru_cache(maxsize=64)
def roots(size: int, inverse: bool) -> np.ndarray:
    """The first half of the powers of a root of unity of order ``size``."""
    root = pow(GENERATOR, (PRIME - 1) // size, PRIME)
    root = pow(root, -1, PRIME) if inverse else root
    out = [1]
    for _ in range(size // 2 - 1):
        out.append(out[-1] * root % PRIME)
    return np.array(out, dtype=np.int64)[:, None]


def forward(x: np.ndarray) -> np.ndarray:
    """Transform of each column; the results stand in bit-reversed order. Numbers grow twofold a step and stay far below 2^63."""
    n, columns = x.shape
    half = n // 2
    while half:
        parts = x.reshape(-1, 2, half, columns)
        out = np.empty_like(parts)
        np.add(parts[:, 0], parts[:, 1], out=out[:, 0])
        out[:, 1] = fold((parts[:, 0] - parts[:, 1]) * roots(2 * half, False))
        x, half = out, half // 2
    return fold(x.reshape(n, columns))


def backward(x: np.ndarray) -> np.ndarray:
    """Columns from their transforms in bit-reversed order, times the number of rows."""
    n, columns = x.shape
    half = 1
    while half < n:
        parts = x.reshape(-1, 2, half, columns)
        out = np.empty_like(parts)
        turned = fold(parts[:, 1] * roots(2 * half, True))
        np.add(parts[:, 0], turned, out=out[:, 0])
        np.subtract(parts[:, 0], turned, out=out[:, 1])
        x, half = out, half * 2
    return x.reshape(n, columns)


def occurrences(residues: np.ndarray, blocks: np.ndarray, length: int, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(block start, distance from ``low`` to below ``high``) of blocks without any mismatch modulo the prime."""
    n, size = len(residues), 2 * length
    windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([residues, np.zeros(size, np.int64)]), size)
    per_slab = max(1, SLAB // size)
    scale = size % PRIME
    for a in range(0, len(blocks), per_slab):
        starts = blocks[a : a + per_slab]
        own = np.ascontiguousarray(windows[starts, :length].T)
        padded = np.zeros((size, len(starts)), np.int64)
        padded[:length] = own[::-1]
        turned = forward(padded)
        own_squares = (own * own).sum(axis=0)
        for first in range(low // length * length, high, length):
            window = np.ascontiguousarray(windows[np.minimum(starts + first, n)].T)
            found = backward(fold(fold(turned * forward(window))))[length - 1 : size - 1]
            total = np.concatenate([np.zeros((1, len(starts)), np.int64), np.cumsum(window * window, axis=0)])
            squares = own_squares + total[length : size] - total[:length]
            at, block = np.nonzero((fold(squares) * scale - 2 * found) % PRIME == 0)
            distance = at + first
            good = (distance >= low) & (distance < high)
            yield starts[block[good]], distance[good]


def stretches(numbers: np.ndarray, blocks: np.ndarray, distance: np.ndarray, length: int, need) -> list[tuple[int, int, int]]:
    """(start, end, period) of the longest stretches around matching blocks whose words equal those ``period`` later.

    ``numbers`` ends with a number that occurs nowhere else. Only stretches of at least ``need`` equal words are kept.
    """
    last = len(numbers) - 1
    right, left, open_ = blocks.copy(), blocks.copy(), np.zeros(len(blocks), dtype=bool)
    live = np.arange(len(blocks))
    for _ in range(length + STEPS):
        live = live[numbers[right[live]] == numbers[np.minimum(right[live] + distance[live], last)]]
        if not len(live):
            break
        right[live] += 1
    open_[live] = True
    live = np.flatnonzero(right - blocks >= length)
    for _ in range(STEPS):
        live = live[(left[live] > 0) & (numbers[left[live] - 1] == numbers[np.minimum(left[live] - 1 + distance[live], last)])]
        if not len(live):
            break
        left[live] -= 1
    open_[live] = True
    good = (right - blocks >= length) & (open_ | (right - left >= need(distance)))
    order = np.flatnonzero(good)
    order = order[np.lexsort((blocks[order], distance[order]))]
    blocks, distance, left, right, open_ = (v[order] for v in (blocks, distance, left, right, open_))
    out, i = [], 0
    while i < len(blocks):
        q, a, b = int(distance[i]), int(left[i]), int(right[i])
        if open_[i]:
            a, b = extend(numbers, a, q, -1), extend(numbers, b, q, 1)
        if b - a >= need(np.array([q]))[0]:
            out.append((a, b + q, q))
        # Blocks of the same period inside this stretch lead to the same one.
        stop = int(np.searchsorted(distance, q, side="right"))
        i += 1 + int(np.searchsorted(blocks[i + 1 : stop], b))
    return out


def extend(numbers: np.ndarray, at: int, q: int, way: int) -> int:
    """The border of the equal stretch beyond ``at``, in strides that double."""
    stride, last = 64, len(numbers) - q
    while True:
        a, b = (at, min(at + stride, last)) if way > 0 else (max(0, at - stride), at)
        differ = np.flatnonzero(numbers[a:b] != numbers[a + q : b + q])
        if len(differ):
            return a + int(differ[0]) if way > 0 else a + int(differ[-1]) + 1
        at = b if way > 0 else a
        if at == (last if way > 0 else 0):
            return at
        stride = min(stride * 2, 1 << 20)


def runs_of(numbers: np.ndarray, ends: np.ndarray, least: int) -> np.ndarray:
    """Rows (start, end, period) of all runs in joined texts, sorted; ``ends`` are the places of the words that close the texts."""
    found: dict[tuple[int, int], int] = {}
    residues = (mix(numbers.astype(np.uint64) + np.uint64(1)) % np.uint64(PRIME)).astype(np.int64)
    sizes = np.diff(ends, prepend=-1) - 1
    longest = int(sizes.max(initial=0))
    short: list[tuple[int, int, int]] = []
    for block, low, high in [(4, 1, 4), *[(1 << k, 2 << k, 4 << k) for k in range(1, 62) if 4 << k <= max(longest, 8)]]:
        if longest < max(least, 2 * low):
            break
        length = min(block, LONGEST)
        starts = np.arange(0, len(numbers) - length, block)
        text = np.searchsorted(ends, starts)
        # The block stands in one text that is long enough, with room for the block's next occurrence.
        fits = (starts + low + length <= ends[text]) & (sizes[text] >= max(least, 2 * low))
        starts = starts[fits]
        reach = covered(short, length, len(numbers))
        batches = occurrences(residues, starts, length, low, high)
        need = lambda q: np.maximum(least - q, q)
        for at, distance in batches:
            if reach is not None:
                new = reach[at] < at + distance + length
                at, distance = at[new], distance[new]
            for a, b, q in stretches(numbers, at, distance, length, need):
                found[a, b] = min(found.get((a, b), q), q)
                short.append((a, b, q))
    return np.array(sorted((a, b, q) for (a, b), q in found.items()), dtype=np.int64).reshape(-1, 3)


def covered(found: list[tuple[int, int, int]], length: int, n: int) -> np.ndarray | None:
    """For each place, how far a known run of a period up to ``length`` that covers it goes on.

    If it covers a block and the block's copy q words later, the stretch has both periods on at least their sum of words, so q is a multiple
    of a shorter period of the whole stretch.
    """
    rows = [(a, b) for a, b, q in found if q <= length]
    if not rows:
        return None
    reach = np.zeros(n, np.int64)
    starts, stops = np.array(rows, dtype=np.int64).T
    np.maximum.at(reach, starts, stops)
    return np.maximum.accumulate(reach)


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` words stay: all but those that some run holds after its first period."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 1], -1)
    return np.cumsum(edges[:-1]) == 0


def find_runs(texts: list[bytes], least: int, words: WordNumbers | None = None) -> Iterator[tuple[np.ndarray, int, bytes]]:
    """(runs as start, end, period; number of words; text without repeats) of each text."""
    words = words or WordNumbers()
    parts = [words.number(t) for t in texts]
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    ends = np.cumsum(sizes + 1) - 1
    joined = np.empty(int((sizes + 1).sum()), np.int64)
    for part, end in zip(parts, ends.tolist(), strict=True):
        joined[end - len(part) : end] = part
    joined[ends] = len(words.words) + np.arange(len(ends))
    runs = runs_of(joined, ends, least)
    first = np.searchsorted(runs[:, 0], ends - sizes)
    last = np.searchsorted(runs[:, 0], ends, side="right")
    for part, end, a, b in zip(parts, ends.tolist(), first.tolist(), last.tolist(), strict=True):
        mine = runs[a:b].copy()
        mine[:, :2] -= end - len(part)
        yield mine, len(part), words.text(part[kept_words(len(part), mine)] if len(mine) else part)


def periodic_runs(docs: DataFrame, least: int = 12, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and the text without repeats, its words joined by one space.

    Words lie between ASCII white space and are compared as they are. NULL and empty texts have no words, no runs and an empty text;
    repeated rows give repeated results, an empty table gives none. A projection without any shuffle; no other column is read.
    ``least`` must be 10 or more, for the scales to find every run.
    """
    if least < 10:
        raise ValueError("least must be 10 or more")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordNumbers()
        for batch in batches:
            keys, column = batch.column(0), batch.column(1)
            for s in byte_runs(column, RUN_BYTES):
                if len(words.words) > REMEMBERED:
                    words = WordNumbers()
                ids, runs, sizes, texts = keys[s], [], [], []
                for mine, n, text in find_runs(column[s].to_pylist(), least, words):
                    runs.append([{"start": a, "length": b - a, "period": q} for a, b, q in mine.tolist()])
                    sizes.append(n)
                    texts.append(text)
                columns = [ids, pa.array(sizes, pa.int64()), pa.array(runs, RUN_TYPE), pa.array(texts, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, schema=SCHEMA)

    text = F.coalesce(F.col(text_column), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def planted(doc_id: Column, text: Column) -> Column:
    """The text, or for a tenth of the ids one whose words from some place on repeat a stretch of them (words joined by one space)."""
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.greatest(F.size(words), F.lit(1))
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    again = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    moved = F.concat(F.slice(words, F.lit(1), a), F.slice(again, F.lit(1), n - a))
    return F.when(h % 10 == 0, F.array_join(moved, " ")).otherwise(text)


@query()
def op11_runs(spark, sf):
    docs = table(spark, sf, "documents")
    docs = docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic_runs(docs)
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("length"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    found = found.withColumns({"best": best, "lines": lines})
    length = -F.col("best.length")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"),
        F.call_function("div", length * 1000, F.col("best.period")).alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )

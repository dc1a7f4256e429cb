"""Shared pieces of the text operators: folds, words, 64-bit hashes, Arrow helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plantlens.session import importable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL where SQL can say it."""

    def add(fn: Callable[[SparkSession, str], DataFrame]):
        @wraps(fn)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            importable(spark)
            return fn(spark, sf)

        QUERIES[fn.__name__] = run
        if sql is not None:
            SQL[fn.__name__] = sql
        return run

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def fold_of(column: str, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; a NULL key counts as empty text (fold 0)."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case (other letters stay as they are)."""
    return text.encode("utf-8", "surrogatepass").lower().split()


class WordHashes(dict):
    """Word -> 64-bit hash, remembered; emptied at ``limit`` words so that memory stays bounded."""

    def __init__(self, limit: int = 120_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


SPACE_BYTES = np.zeros(256, dtype=bool)
SPACE_BYTES[[9, 10, 11, 12, 13, 32]] = True
#: Odd multiplier of the rolling hash, and its inverse modulo 2^64.
ROLL = 0x9E3779B97F4A7C13
UNROLL = pow(ROLL, -1, 1 << 64)
END_HASH = np.uint64(0x243F6A8885A308D3)


class Words:
    """Words of a run of texts as arrays: hashes, places in the joined lower-case bytes, and how many each text has."""

    powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))

    def __init__(self, texts: list[str | None] | list[bytes]):
        parts = [(t if isinstance(t, bytes) else (t or "").encode("utf-8", "surrogatepass")).lower() for t in texts]
        self.data = b"\n".join([*parts, b""])
        codes = np.frombuffer(self.data, np.uint8)
        space = SPACE_BYTES[codes]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(space) and not space[0]:
            edge = np.concatenate([[0], edge])
        self.starts, self.ends = edge[0::2], edge[1::2]
        sizes = np.array([len(p) + 1 for p in parts], dtype=np.int64)
        self.counts = np.diff(np.searchsorted(self.starts, np.concatenate([[0], np.cumsum(sizes)])))
        self.hashes = self._hash(codes)

    def _hash(self, codes: np.ndarray, span: int = 1 << 21) -> np.ndarray:
        """A polynomial over random values of the bytes, from differences of its running sum; scrambled with the length.

        Stretches of about ``span`` bytes are summed at a time; where a word stands has no part in its hash.
        """
        out = np.empty(len(self.starts), dtype=np.uint64)
        first = 0
        while first < len(out):
            stop = max(first + 1, int(np.searchsorted(self.ends, self.starts[first] + span, side="right")))
            low = self.starts[first]
            starts, ends = self.starts[first:stop] - low, self.ends[first:stop] - low
            up, down = Words._powers(int(ends[-1]))
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_VALUES[codes[low : low + ends[-1]]] * up)])
            out[first:stop] = (total[ends] - total[starts]) * down[starts]
            first = stop
        return mix(out + (self.ends - self.starts).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))

    @staticmethod
    def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
        """Powers of the multiplier and of its inverse; kept for spans of ordinary length."""
        if len(Words.powers[0]) < n:
            size = max(n, 1 << 21)
            made = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, m, np.uint64)])) for m in (ROLL, UNROLL))
            if size > 1 << 22:
                return made[0][:n], made[1][:n]
            Words.powers = made
        return Words.powers[0][:n], Words.powers[1][:n]

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]]


def word_runs(data: bytes, stretch: int = 1 << 20) -> Iterator[list[bytes]]:
    """Words of a text in runs of about ``stretch`` bytes."""
    start = 0
    while start < len(data):
        stop = start + stretch
        while stop < len(data) and data[stop] not in b" \t\n\v\f\r":
            stop += 1
        yield data[start:stop].split()
        start = stop


class WordNumbers:
    """Words of texts as numbers; equal words, as they are, have equal numbers. Long texts are split a stretch at a time."""

    def __init__(self):
        self.numbers: dict[bytes, int] = {}
        self.words: list[bytes] = []

    def number(self, data: bytes, stretch: int = 1 << 20) -> np.ndarray:
        numbers, words, out = self.numbers, self.words, []
        for found in word_runs(data, stretch):
            for w in set(found).difference(numbers):
                numbers[w] = len(words)
                words.append(w)
            out.append(np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)))
        return np.concatenate(out) if out else np.zeros(0, np.int32)

    def text(self, numbers: np.ndarray) -> bytes:
        words = self.words
        return b" ".join([b" ".join(map(words.__getitem__, numbers[a : a + 100_000].tolist())) for a in range(0, len(numbers), 100_000)])


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words (multiply and xor-shift)."""
    x = values ^ (values >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


def join_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a sequence extended by one word."""
    return mix(left * np.uint64(0xD6E8FEB86659FD93) + right)


def text_slices(column: pa.Array, limit: int) -> Iterator[slice]:
    """Runs of rows of about ``limit`` bytes of a text column; a NULL has none."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    start = 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + limit)))
        yield slice(start, stop)
        start = stop


def text_runs(column: pa.Array, limit: int) -> Iterator[tuple[slice, list[str | None]]]:
    """Runs of a text column of about ``limit`` bytes each, as Python strings; one run is held at a time."""
    for s in text_slices(column, limit):
        yield s, column.slice(s.start, s.stop - s.start).to_pylist()


def byte_runs(column: pa.Array, limit: int) -> Iterator[slice]:
    """Runs of rows of about ``limit`` bytes of a binary column without NULLs."""
    total, start = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) + 1), 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + limit)))
        yield slice(start, stop)
        start = stop


def record_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, dict[str, list]]]:
    """Groups of rows with equal keys, from partitions that are sorted by the keys; one group is held at a time."""
    key, rows = None, None
    for batch in batches:
        names = batch.schema.names
        columns = [batch.column(i).to_pylist() for i in range(len(names))]
        found = list(zip(*[columns[names.index(k)] for k in keys], strict=True))
        start = 0
        while start < len(found):
            stop = start + 1
            while stop < len(found) and found[stop] == found[start]:
                stop += 1
            if found[start] != key:
                if rows is not None:
                    yield key, rows
                key, rows = found[start], {n: [] for n in names}
            for name, column in zip(names, columns, strict=True):
                rows[name].extend(column[start:stop])
            start = stop
    if rows is not None:
        yield key, rows


def bloom_positions(keys: np.ndarray, bits: int, probes: int) -> Iterator[np.ndarray]:
    """Bit numbers of 64-bit keys by double hashing; ``bits`` is a power of two."""
    first, step = mix(keys), mix(keys ^ np.uint64(0xA5A5A5A5A5A5A5A5)) | np.uint64(1)
    mask = np.uint64(bits - 1)
    for i in range(probes):
        yield (first + np.uint64(i) * step) & mask


def power_of_two(least: float, low: int, high: int) -> int:
    """The smallest power of two that is at least ``least``, between ``low`` and ``high``."""
    value = low
    while value < least and value < high:
        value *= 2
    return value

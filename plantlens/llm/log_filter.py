"""Log-frequency Bloom filter: counts of 64-bit hashes, kept as logarithmic classes and read by repeated probes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plantlens.llm.common import bloom_positions, record_batch
from plantlens.session import cut

BASE = 1.5
PROBES = 3
#: The highest class.
TOP = 120
PACKED = "bucket int, grams binary, counts binary"
#: A stretch is 2^JOINT neighbouring buckets (fewer if there are few buckets); what goes to the sections and back goes by stretch.
JOINT = 3
STRETCHED = "stretch int, sizes binary, grams binary, counts binary"


def by_bucket(grams: np.ndarray, bucket_bits: int, *others: np.ndarray) -> tuple[list, ...]:
    """Buckets of sorted hashes, the 32 hash bits that follow the bucket's in each, and the same parts of ``others``."""
    bucket = (grams >> np.uint64(64 - bucket_bits)).astype(np.int64) if bucket_bits else np.zeros(len(grams), np.int64)
    rest = ((grams << np.uint64(bucket_bits)) >> np.uint64(32)).astype(np.uint32)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    edges = [*first.tolist(), len(grams)]
    return bucket[first].tolist(), *([a[i:j] for i, j in zip(edges, edges[1:], strict=False)] for a in (rest, *others))


def packed(parts: list[np.ndarray], bucket_bits: int) -> pa.RecordBatch:
    """Counts of hashes, one row per bucket of the hash space: the 32 hash bits that follow the bucket's, and counts."""
    schema = pa.schema([("bucket", pa.int32()), ("grams", pa.binary()), ("counts", pa.binary())])
    grams, counts = np.unique(np.concatenate(parts), return_counts=True)
    full, *columns = by_bucket(grams, bucket_bits, counts.astype(np.uint32))
    return record_batch(schema, [full, *[[a.tobytes() for a in c] for c in columns]])


def joint_bits(bucket_bits: int) -> int:
    """Bucket bits in which the buckets of a stretch differ."""
    return min(JOINT, bucket_bits // 2)


def by_stretch(grams: np.ndarray, bucket_bits: int, *others: np.ndarray) -> tuple[list, ...]:
    """Stretches of sorted hashes; for each how many hashes its buckets have, the 32 hash bits that follow the bucket's, and the same parts of ``others``, as bytes."""
    starts = np.arange(1 << bucket_bits, dtype=np.uint64) << np.uint64(64 - bucket_bits) if bucket_bits else np.zeros(1, np.uint64)
    edges = np.append(np.searchsorted(grams, starts), len(grams))
    rest = ((grams << np.uint64(bucket_bits)) >> np.uint64(32)).astype(np.uint32)
    buckets = 1 << joint_bits(bucket_bits)
    sizes, ends = np.diff(edges).astype(np.uint32).reshape(-1, buckets), edges[::buckets]
    full = np.flatnonzero(np.diff(ends)).tolist()
    return full, [sizes[i].tobytes() for i in full], *([a[ends[i] : ends[i + 1]].tobytes() for i in full] for a in (rest, *others))


def stretched(parts: list[np.ndarray], bucket_bits: int) -> pa.RecordBatch:
    """Counts of hashes, one row per stretch of buckets."""
    schema = pa.schema([("stretch", pa.int32()), ("sizes", pa.binary()), ("grams", pa.binary()), ("counts", pa.binary())])
    grams, counts = np.unique(np.concatenate(parts), return_counts=True)
    return record_batch(schema, list(by_stretch(grams, bucket_bits, counts.astype(np.uint32))))


def build_filter(rows: DataFrame, bits: int, bucket_bits: int, floor: int) -> "Filter":
    """Filter of packed counts. A bucket is a section of the filter, made in one task; only finished sections, ``bits`` in all, come to the driver."""
    section = bits >> bucket_bits
    sections = cut(rows.groupBy("bucket").applyInArrow(build_section(section, floor), "bucket int, bits binary"))
    array = np.zeros(bits // 8, dtype=np.uint8)
    for row in sections.toLocalIterator():
        array[row["bucket"] * section // 8 : (row["bucket"] + 1) * section // 8] = np.frombuffer(row["bits"], np.uint8)
    return Filter(array, bucket_bits, section, floor)


def classes(counts: np.ndarray, floor: int) -> np.ndarray:
    """Class of a count: 0 below ``floor``, else 1 + floor(log_BASE(count / floor)), which is at most 4/3 of count / floor."""
    ratio = np.maximum(counts, 1) / floor
    return np.where(counts >= floor, 1 + np.floor(np.log(np.maximum(ratio, 1.0)) / math.log(BASE) + 1e-9), 0).astype(np.int64)


def class_counts(floor: int, top: int = TOP) -> np.ndarray:
    """The count that stands for each class: the middle of the counts in it."""
    out = [0.0]
    for q in range(1, top + 1):
        low, high = math.ceil(floor * BASE ** (q - 1) - 1e-9), math.ceil(floor * BASE**q - 1e-9) - 1
        out.append((low + max(low, high)) / 2)
    return np.array(out)


def level_keys(grams: np.ndarray, level: int) -> np.ndarray:
    return grams.astype(np.uint64) + np.uint64(level << 33)


def joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint32), *parts])


def section_bits_of(rest: np.ndarray, counts: np.ndarray, section_bits: int, floor: int) -> np.ndarray:
    """The packed bits of one bucket's section from counts of its hashes; a hash may come several times."""
    bits = np.zeros(section_bits, dtype=bool)
    if len(rest):
        both = np.sort(rest.astype(np.uint64) << np.uint64(32) | counts)
        rest, counts = (both >> np.uint64(32)).astype(np.uint32), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], rest[1:] != rest[:-1]]))
        rest, totals = rest[first], np.add.reduceat(counts, first)
        q = classes(totals, floor)
        level = 1
        while len(rest := rest[q >= level]):
            q = q[q >= level]
            for at in bloom_positions(level_keys(rest, level), section_bits, PROBES):
                bits[at] = True
            level += 1
    return np.packbits(bits, bitorder="little")


def build_section(section_bits: int, floor: int):
    """One bucket's section of the filter from its packed counts."""

    def run(group: pa.Table) -> pa.Table:
        rest, counts = (joined([np.frombuffer(b, np.uint32) for b in group.column(c).to_pylist()]) for c in ("grams", "counts"))
        bits = section_bits_of(rest, counts, section_bits, floor)
        return pa.table({"bucket": pa.array([group.column("bucket")[0].as_py()], pa.int32()), "bits": pa.array([bits.tobytes()], pa.binary())})

    return run


def buckets_of(group: pa.Table, buckets: int, columns: list[str]) -> Iterator[list[list[np.ndarray]]]:
    """For each bucket of a stretch its parts of the columns, row by row."""
    sizes = np.frombuffer(b"".join(group.column("sizes").to_pylist()), np.uint32).reshape(-1, buckets).astype(np.int64)
    ends = np.cumsum(sizes, axis=1)
    starts = (ends - sizes).T.tolist()
    arrays = [[np.frombuffer(b, np.uint32) for b in group.column(c).to_pylist()] for c in columns]
    for low, high in zip(starts, ends.T.tolist(), strict=True):
        yield [[a[i:j] for a, i, j in zip(rows, low, high, strict=True)] for rows in arrays]


def probed_once(bits: np.ndarray, rest: np.ndarray, section_bits: int) -> np.ndarray:
    """Classes of hashes that may come several times, each probed once."""
    both = np.sort(rest.astype(np.uint64) << np.uint64(32) | np.arange(len(rest), dtype=np.uint64))
    value, place = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
    new = np.concatenate([np.ones(min(1, len(rest)), bool), value[1:] != value[:-1]])
    levels = np.empty(len(rest), np.uint8)
    levels[place] = probed(bits, None, value[new], section_bits)[np.cumsum(new) - 1]
    return levels


def probe_sections(bucket_bits: int, section_bits: int, floor: int):
    """Classes of the hashes that each run asks of one stretch, read from the sections of its buckets, which are made here one at a time."""
    buckets = 1 << joint_bits(bucket_bits)

    def run(counted: pa.Table, asked: pa.Table) -> pa.Table:
        levels: list[list[bytes]] = [[] for _ in range(asked.num_rows)]
        for (grams, counts), (wanted,) in zip(buckets_of(counted, buckets, ["grams", "counts"]), buckets_of(asked, buckets, ["grams"]), strict=True):
            bits = section_bits_of(joined(grams), joined(counts), section_bits, floor)
            found = probed_once(bits, joined(wanted), section_bits)
            stop = 0
            for row, some in zip(levels, wanted, strict=True):
                row.append(found[stop : stop + len(some)].tobytes())
                stop += len(some)
        return pa.table({"run": asked.column("run"), "stretch": asked.column("stretch"), "levels": pa.array(map(b"".join, levels), pa.binary())})

    return run


def probed(bits: np.ndarray, section: np.ndarray | None, rest: np.ndarray, section_bits: int, alive: np.ndarray | None = None) -> np.ndarray:
    """Classes read by repeated probes of ``alive`` hashes (all, if not given); their sections begin at ``section`` (0, if not given)."""
    level = np.zeros(len(rest), dtype=np.int64)
    alive = np.arange(len(rest)) if alive is None else alive
    step = 1
    while len(alive) and step <= TOP:
        keys = level_keys(rest[alive], step)
        start = None if section is None else section[alive]
        inside = np.arange(len(alive))
        for at in bloom_positions(keys, section_bits, PROBES):
            at = at[inside] if start is None else start[inside] + at[inside]
            hit = (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
            inside = inside[hit.astype(bool)]
            if len(inside) == 0:
                break
        alive = alive[inside]
        level[alive] = step
        step += 1
    return level


class Filter:
    """The filter's bits and how to probe them; travels in a broadcast."""

    def __init__(self, bits: np.ndarray, bucket_bits: int, section_bits: int, floor: int):
        self.bits, self.bucket_bits, self.section_bits, self.floor = bits, bucket_bits, section_bits, floor

    def counts(self, grams: np.ndarray) -> np.ndarray:
        """Counts read by repeated probes; 0 where the first probe fails or the hash is 0."""
        section = (grams >> np.uint64(64 - self.bucket_bits)) * np.uint64(self.section_bits) if self.bucket_bits else np.zeros(len(grams), np.uint64)
        rest = (grams << np.uint64(self.bucket_bits)) >> np.uint64(32)
        level = probed(self.bits, section, rest, self.section_bits, np.flatnonzero(grams != 0))
        return class_counts(self.floor)[level]

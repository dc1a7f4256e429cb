"""Repeatable random numbers from row keys: independent of partitioning and reruns."""

from __future__ import annotations

import hashlib
import math
import zlib
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX_13 = float(2**52)
HEX_8 = float(2**32)


def digest(seed: int | str, *parts: Column | str) -> Column:
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *[F.col(p) if isinstance(p, str) else p for p in parts]))


def hex_number(text: Column, start: int, length: int) -> Column:
    return F.conv(F.substring(text, start, length), 16, 10).cast("bigint")


def uniform(seed: int | str, *parts: Column | str) -> Column:
    """52 bits of the key's digest as a double in [0, 1)."""
    return hex_number(digest(seed, *parts), 1, 13).cast("double") / F.lit(HEX_13)


@cache
def _crc_undone() -> list[list[int]]:
    """Per byte of a CRC-32 a table; the entries of a checksum's four bytes, joined by xor, are the four bytes it was taken of.

    CRC-32 of four bytes is one to one, and a linear map of their bits but for a constant: elimination inverts the map.
    """
    zero = zlib.crc32(bytes(4))
    rows = [(zlib.crc32((1 << i).to_bytes(4, "big")) ^ zero, 1 << i) for i in range(32)]
    for bit in range(32):
        spot = next(i for i in range(bit, 32) if rows[i][0] >> bit & 1)
        rows[bit], rows[spot] = rows[spot], rows[bit]
        image, source = rows[bit]
        rows = [(a ^ image, b ^ source) if i != bit and a >> bit & 1 else (a, b) for i, (a, b) in enumerate(rows)]

    def undone(crc: int) -> int:
        return reduce(lambda found, row: found ^ row[1], [rows[i] for i in range(32) if crc >> i & 1], 0)

    return [[undone((x << 8 * k) ^ (zero if k == 0 else 0)) for x in range(256)] for k in range(4)]


def words4(text: Column) -> list[Column]:
    """The four unsigned 32-bit numbers of a digest, by two cheap built-ins; ``conv`` of eight hex digits costs several times as much."""
    raw = F.unhex(text)
    tables = [F.split(F.lit(" ".join(map(str, table))), " ").cast("array<bigint>") for table in _crc_undone()]

    def word(i: int) -> Column:
        crc = F.crc32(F.substring(raw, 1 + 4 * i, 4))
        return reduce(lambda a, b: a.bitwiseXOR(b), [F.get(t, F.shiftright(crc, 8 * k).bitwiseAND(F.lit(255)).cast("int")) for k, t in enumerate(tables)])

    return [word(i) for i in range(4)]


def uniforms4(text: Column) -> list[Column]:
    """Four doubles in (0, 1) from one digest."""
    return [(word.cast("double") + 0.5) / F.lit(HEX_8) for word in words4(text)]


ROUNDS = 4


def _side(n: int) -> int:
    """The least side of a square that holds n numbers."""
    return math.isqrt(max(n, 1) - 1) + 1


def _walks(n: int) -> int:
    """Steps after which every walk is back among the n numbers.

    A walk passes each of the square's other numbers at most once. They are few (2 in the square root of n), so for large n far fewer steps do, but for a
    chance of 1e-15; a walk that were longer ends in an error, never in a wrong number.
    """
    outside = _side(n) ** 2 - n
    return outside if n < 100 else min(outside, math.ceil(math.log(1e15 * n) / math.log(math.sqrt(n) / 2)))


def permuted(row: Column, n: int, name: str, seed: int) -> Column:
    """The place of ``row`` (0 to n-1) in a keyed permutation of n numbers, without a shuffle.

    A Feistel network on the two digits of a square of numbers, with digests as round functions; a number that falls outside
    is sent on until it falls inside (cycle walking), which keeps the mapping one to one.
    """
    side = F.lit(_side(n)).cast("bigint")

    def turn(pair: Column, step: Column) -> Column:
        part = hex_number(digest(seed, F.lit(name), step, pair["r"]), 1, 7)
        return F.struct(pair["r"].alias("l"), ((pair["l"] + part) % side).alias("r"))

    def network(x: Column) -> Column:
        start = F.struct(F.floor(x / side).cast("bigint").alias("l"), (x % side).alias("r"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda p: p["l"] * side + p["r"])

    inside = lambda x: x < F.lit(n)
    start = network(F.pmod(row.cast("bigint"), F.lit(n).cast("bigint")))
    steps = _walks(n)
    if steps:
        start = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda x, _: F.when(inside(x), x).otherwise(network(x)))
    return F.when(inside(start), start).otherwise(F.raise_error(F.lit("a walk of the permutation is too long; take another seed")).cast("bigint"))


def permuted_number(i: int, n: int, name: str, seed: int) -> int:
    """``permuted`` for one number on the driver."""
    side, x = _side(n), i
    while True:
        left, right = divmod(x, side)
        for step in range(1, ROUNDS + 1):
            left, right = right, (left + int(hashlib.md5(f"{seed}-{name}-{step}-{right}".encode()).hexdigest()[:7], 16)) % side
        x = left * side + right
        if x < n:
            return x


def normals4(text: Column) -> list[Column]:
    """Four standard normal draws from one digest."""
    return box_muller(uniforms4(text))


def box_muller(u: list[Column]) -> list[Column]:
    """Four standard normal draws from four uniform ones, two from each pair."""
    out = []
    for a, b in ((u[0], u[1]), (u[2], u[3])):
        radius = F.sqrt(-2.0 * F.log(a))
        angle = F.lit(2.0 * math.pi) * b
        out += [radius * F.cos(angle), radius * F.sin(angle)]
    return out

"""Packing of token pieces into as few sequences as possible: dominance reduction first, best-fit for the rest.

Lengths are whole numbers up to the capacity, so an instance of any number of pieces is a histogram of at most ``capacity`` numbers. Only
this histogram comes to the driver. There, sets of up to three pieces that provably dominate every other way to fill a sequence with their
largest piece are fixed for good, as often as the counts allow; the shrunken instance goes to best-fit by decreasing length, a
whole class of equal sequences at a time. The plan is a list of classes of equally filled sequences: at most four more per length, whatever
the number of pieces. Pieces are numbered within (task that wrote them, length), numbers become ranks per length by a
running sum over tasks, and a rank is looked up in the plan by a binary search in the tasks.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plantlens.llm.common import query, table, word_runs
from plantlens.session import cut

MODEL = "word_bpe_49k.json"
END = 1
CAPACITY = 4096
#: Bytes of words after which the table of their tokens starts anew.
REMEMBERED = 8_000_000
#: What the tokenizer's pattern makes of plain words in lower case, and which words are plain.
PART = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
PLAIN = re.compile(rb"(?:[!-~]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch


@dataclass(frozen=True)
class Filled:
    """``times`` sequences, each holding ``items``: (length, how many), in the order of their offsets."""

    times: int
    items: tuple[tuple[int, int], ...]


class Stock:
    """Counts per length with the lengths in order."""

    def __init__(self, counts: dict[int, int]):
        self.counts = {s: n for s, n in counts.items() if n > 0}
        self.sizes = sorted(self.counts)

    def take(self, size: int, n: int) -> None:
        self.counts[size] -= n
        if self.counts[size] == 0:
            del self.counts[size]
            self.sizes.pop(bisect_left(self.sizes, size))

    def smallest(self, n: int, without: int, above: int = 0) -> list[int]:
        """Lengths of the ``n`` shortest pieces longer than ``above``, one piece of length ``without`` aside."""
        out: list[int] = []
        for i in range(bisect_right(self.sizes, above), len(self.sizes)):
            size = self.sizes[i]
            out += [size] * min(n - len(out), self.counts[size] - (size == without))
            if len(out) == n:
                break
        return out

    def largest(self, room: int, without: tuple[int, ...]) -> int | None:
        """The longest piece of at most ``room``, the pieces ``without`` aside."""
        for i in range(bisect_right(self.sizes, room) - 1, -1, -1):
            size = self.sizes[i]
            if self.counts[size] > without.count(size):
                return size
        return None

    def best_pair(self, room: int, without: int) -> tuple[int, int] | None:
        """Two pieces (the longer first) with the greatest sum of at most ``room``, a piece ``without`` aside."""
        best, low, high = None, 0, bisect_right(self.sizes, room) - 1
        while low <= high:
            a, b = self.sizes[high], self.sizes[low]
            if a + b > room or self.counts[a] == (a == without):
                high -= 1
                continue
            if self.counts[b] - (b == without) > (a == b) and (best is None or a + b > sum(best)):
                best = a, b
            low += 1
        return best


def dominating(stock: Stock, j: int, capacity: int) -> tuple[int, ...] | None:
    """A set with a piece of length ``j`` that dominates all sets with it, if one of at most three pieces can be proved to.

    A set dominates another when its pieces can take the places of groups of the other's pieces. By how many pieces fit beside j:
    none: {j}. One: {j, longest that fits}; the same holds where that one fills the sequence, for it can take the place of any group.
    Two: {j, longest} if it is as long as the best pair. Else {j, longest, b} if the best pair is (longest, b) and no two pieces
    longer than b fit beside j: then of any two pieces one is at most b and the other at most the longest.
    """
    room = capacity - j
    least = stock.smallest(3, j)
    if not least or least[0] > room:
        return (j,)
    longest = stock.largest(room, (j,))
    if longest == room or len(least) < 2 or least[0] + least[1] > room:
        return j, longest
    if len(least) == 3 and sum(least) <= room:
        return None
    pair = stock.best_pair(room, j)
    if longest >= sum(pair):
        return j, longest
    if pair[0] == longest:
        above = stock.smallest(2, j, pair[1])
        if len(above) < 2 or sum(above) > room:
            return j, *pair
    return None


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[list[Filled], dict[int, int]]:
    """Fix dominating sets until none can be proved; the fixed sets and what is left.

    A set is fixed as often as its lengths last: fewer pieces never let more fit beside j, the longest stays the longest, and
    best pairs only get shorter, so a proof holds for every further copy.
    """
    stock, fixed = Stock(counts), []
    changed = True
    while changed:
        changed = False
        j = stock.sizes[-1] if stock.sizes else 0
        while j:
            found = dominating(stock, j, capacity)
            if found is None:
                at = bisect_left(stock.sizes, j) - 1
            else:
                need = Counter(found)
                times = min(stock.counts[s] // n for s, n in need.items())
                fixed.append(Filled(times, tuple(sorted(need.items(), reverse=True))))
                for s, n in need.items():
                    stock.take(s, n * times)
                changed = True
                at = bisect_right(stock.sizes, j) - 1
            j = stock.sizes[at] if at >= 0 else 0
    return fixed, stock.counts


def best_fit(counts: dict[int, int], capacity: int) -> list[Filled]:
    """Best-fit by decreasing length: each piece goes where it leaves the least room; equal sequences are filled together."""
    rooms: list[int] = []
    classes: dict[int, list[list]] = {}

    def put(room: int, times: int, items: tuple) -> None:
        if room not in classes:
            classes[room] = []
            insort(rooms, room)
        classes[room].append([times, items])

    for size in sorted(counts, reverse=True):
        left, at = counts[size], bisect_left(rooms, size)
        filled: list[tuple[int, int, tuple]] = []
        while left and at < len(rooms):
            room = rooms[at]
            each, waiting = room // size, classes[room]
            while left and waiting:
                times, items = waiting.pop()
                whole = min(times, left // each)
                rest = times - whole
                if whole:
                    filled.append((room - size * each, whole, (*items, (size, each))))
                    left -= whole * each
                if rest and left:
                    filled.append((room - size * left, 1, (*items, (size, left))))
                    left, rest = 0, rest - 1
                if rest:
                    waiting.append([rest, items])
            if waiting:
                at += 1
            else:
                del classes[room]
                rooms.pop(at)
        each = capacity // size
        if left // each:
            filled.append((capacity - size * each, left // each, ((size, each),)))
        if left % each:
            filled.append((capacity - size * (left % each), 1, ((size, left % each),)))
        for entry in filled:
            put(*entry)
    return [Filled(times, items) for room in rooms for times, items in classes[room]]


def plan_sequences(counts: dict[int, int], capacity: int = CAPACITY) -> list[Filled]:
    """Classes of equally filled sequences that hold all pieces of a histogram of lengths (1 to ``capacity``)."""
    if any(not 1 <= s <= capacity for s in counts):
        raise ValueError(f"lengths must lie between 1 and {capacity}")
    fixed, rest = reduce_instance(counts, capacity)
    return fixed + best_fit(rest, capacity)


class Places:
    """The plan as sorted arrays: a piece's (length, rank) gives its sequence and offset."""

    def __init__(self, plan: list[Filled]):
        taken: Counter[int] = Counter()
        rows, first = [], 0
        for cls in plan:
            offset = 0
            for size, each in cls.items:
                rows.append((size, taken[size], first, each, offset))
                taken[size] += cls.times * each
                offset += size * each
            first += cls.times
        rows.sort()
        size, self.rank, self.first, self.each, self.offset = (np.array([r[i] for r in rows], dtype=np.int64) for i in range(5))
        sizes, starts = np.unique(size, return_index=True)
        self.spans = {s: (a, b) for s, a, b in zip(sizes.tolist(), starts.tolist(), np.append(starts, len(rows))[1:].tolist(), strict=True)} if rows else {}

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for size in np.unique(length):
            rows = np.flatnonzero(length == size)
            start, stop = self.spans[int(size)]
            at = start + np.searchsorted(self.rank[start:stop], rank[rows], side="right") - 1
            nth = rank[rows] - self.rank[at]
            sequence[rows] = self.first[at] + nth // self.each[at]
            offset[rows] = self.offset[at] + nth % self.each[at] * size
        return sequence, offset


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it is printable, else the next one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = [b for b in range(256) if b not in printable]
    return {b: chr(256 + other.index(b)) for b in other}


BYTE_LETTERS = byte_letters()


class WordTokens(dict):
    """Word -> its tokens as little-endian numbers of 32 bits; learnt when first met.

    The tokenizer drops white space, and neither its normal form nor its pattern looks across ASCII white space, so a text's
    tokens are those of its words in turn. Plain words (ASCII and the letters of Latin-1, which are their own normal form) are taken apart by
    the tokenizer's pattern here, and their parts, which repeat more often, go to its model; all others go through the tokenizer.
    """

    def __init__(self, file: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.codec = Tokenizer.from_buffer(file)
        self.merge = self.codec.model.tokenize
        self.parts: dict[str, bytes] = {}
        self.held = 0

    def __missing__(self, word: bytes) -> bytes:
        if PLAIN(word) and b"<|" not in word:
            out = b"".join([self.parts.get(p) or self._part(p) for p in PART.findall(word.decode().lower())])
        else:
            out = np.array(self.codec.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()
        self[word] = out
        self.held += len(word)
        return out

    def _part(self, part: str) -> bytes:
        ids = [t.id for t in self.merge(part if part.isascii() else part.encode().decode("latin-1").translate(BYTE_LETTERS))]
        found = self.parts[part] = np.array(ids, "<u4").tobytes()
        return found

    def of(self, text: bytes) -> np.ndarray:
        if self.held > REMEMBERED:
            self.clear()
            self.parts.clear()
            self.held = 0
        get = self.__getitem__
        return np.frombuffer(b"".join([b"".join(map(get, found)) for found in word_runs(text)]), "<u4")


#: One table per process, whatever the number of tasks it runs; what it holds depends on the tokenizer alone.
TABLES: dict[int, WordTokens] = {}


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): each text's tokens and the end id, cut into pieces of at most ``capacity``.

    NULL text is an empty one and gives one piece with the end id alone. The tokenizer's file is read on the driver and travels in a
    broadcast (a vocabulary has a fixed size); no other column is read.
    """
    with open(path, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())
    names = ("doc_id", "piece", "start", "length", "ids_crc32")
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    schema = pa.schema([*zip(names, types, strict=True), *[("ids", pa.list_(pa.int32()))] * with_ids])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, last = shared.value, np.array([end], "<u4")
        mark = zlib.crc32(file)
        if mark not in TABLES:
            TABLES.clear()
            TABLES[mark] = WordTokens(file)
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.concatenate([TABLES[mark].of(text.as_py()), last])
                for piece, a in enumerate(range(0, len(ids), capacity)):
                    part = ids[a : a + capacity]
                    rows.append((key, piece, a, len(part), zlib.crc32(part), *[part.astype(np.int32)] * with_ids))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    text = F.coalesce(F.col(text_column), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def number_in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the number of their task and their number among its rows of equal length."""
    task, seen = TaskContext.get().partitionId(), Counter()
    for batch in batches:
        lengths = batch.column(batch.schema.get_field_index("length")).to_numpy(zero_copy_only=False)
        order = np.argsort(lengths, kind="stable")
        sizes, first, times = np.unique(lengths[order], return_index=True, return_counts=True)
        nth = np.empty(len(lengths), np.int64)
        nth[order] = np.arange(len(lengths)) - np.repeat(first, times)
        nth += np.array([seen[s] for s in sizes.tolist()], np.int64)[np.searchsorted(sizes, lengths)] if len(sizes) else 0
        for s, n in zip(sizes.tolist(), times.tolist(), strict=True):
            seen[s] += n
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(len(lengths), task, np.int64)), pa.array(nth)], names=[*batch.schema.names, "task", "nth"]
        )


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset: in as few sequences of at most ``capacity`` as found, gapless from offset 0.

    Needs a column ``length`` from 1 to ``capacity`` and may hold any others but task, nth, rank, sequence_id, offset. Pieces of one length take each
    other's places freely, so repeated rows and NULL keys need no order; an empty table stays empty. Numbers given by
    a task are used only once written, so a lost executor changes none.
    """
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    numbered = cut(pieces.mapInArrow(number_in_task, f"{columns}, task long, nth long"))
    counts = numbered.groupBy("length", "task").agg(F.count("*").alias("n"))
    # One row per length that occurs, at most ``capacity``.
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    shared = pieces.sparkSession.sparkContext.broadcast(Places(plan_sequences(histogram, capacity)))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = numbered.join(counts.select("length", "task", before.alias("before")), ["length", "task"]).withColumn("rank", F.col("before") + F.col("nth"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):
        import pandas as pd

        sequence, offset = shared.value.of(length.to_numpy(), rank.to_numpy())
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    return ranked.withColumn("place", place("length", "rank")).select(*pieces.columns, "place.sequence_id", "place.offset")


def sequence_tokens(packed: DataFrame) -> DataFrame:
    """sequence_id and its ids in order, from packed pieces with ids; a sequence holds at most ``capacity`` ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


@query()
def op12_pack(spark, sf):
    return pack(token_pieces(table(spark, sf, "documents"), default_model()))

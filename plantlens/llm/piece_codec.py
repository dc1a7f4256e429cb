"""SentencePiece BPE ids by the prefix table of last tokens, and back to text.

For every prefix of a text there is one token that ends the prefix's BPE form. It is found from left to right: an automaton
gives the pieces that end at a place, and the one that may follow the last token of the shorter prefix
(pair test) is the last token of this prefix. Ids are then read backwards through the table. The pair test undoes the
merges at the border of two tokens, latest first, and looks for a merge across the border that would
have come before.

Pieces hold white space only at their start, so a text falls into units (white space, then other characters) that
never merge with each other; units repeat, and a bounded memory of units saves most of the work.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from plantlens.llm.common import query, record_batch, table, text_runs

SPACE = "▁"
MODEL = "piece_bpe_32k.model"
#: Units and pairs that a Python worker remembers: about 120 and 100 MB at most. A worker keeps them after its tasks, beside all later stages.
UNIT_LIMIT = 400_000
PAIR_LIMIT = 800_000
#: Characters of texts whose ids a task holds at a time.
RUN_CHARS = 1_000_000
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


def merges(symbols: list[str], rank: dict[str, int]) -> tuple[list[str], tuple[str, str] | None]:
    """BPE by definition: join the neighbours whose joint piece ranks first, leftmost on ties; also the last pair joined."""
    last = None
    while len(symbols) > 1:
        best, at = None, -1
        for i in range(len(symbols) - 1):
            r = rank.get(symbols[i] + symbols[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        last = (symbols[at], symbols[at + 1])
        symbols = symbols[:at] + [symbols[at] + symbols[at + 1]] + symbols[at + 2 :]
    return symbols, last


class Pieces:
    """Tables of a model, made once on the driver from its file's bytes; the codec itself is made in tasks."""

    def __init__(self, model: bytes):
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        spec, norm = proto.trainer_spec, proto.normalizer_spec
        kinds = {p.type for p in proto.pieces}
        if spec.model_type != 2 or not spec.byte_fallback or spec.treat_whitespace_as_suffix or not kinds <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("a BPE model with byte fallback and without user-defined pieces is needed")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("a model with identity normalisation and a dummy prefix is needed")
        self.ids, scores, self.texts, self.bytes = {}, {}, [], {}
        for i, p in enumerate(proto.pieces):
            if p.type == NORMAL:
                self.ids[p.piece], scores[p.piece] = i, p.score
                if SPACE in p.piece.lstrip(SPACE):
                    raise ValueError("pieces with inner white space are not supported")
            if p.type == BYTE:
                self.bytes[int(p.piece[3:5], 16)] = i
                self.texts.append(bytes([int(p.piece[3:5], 16)]))
            else:
                self.texts.append(b"" if p.type == CONTROL else " ⁇ ".encode() if p.type == UNKNOWN else p.piece.replace(SPACE, " ").encode())
        self.byte_ids, self.control = set(self.bytes.values()), {i for i, p in enumerate(proto.pieces) if p.type == CONTROL}
        order = {s: n for n, s in enumerate(sorted(set(scores.values()), reverse=True))}
        #: Merge order by piece; equal scores share a rank. Single characters stand before all merges.
        self.rank = {p: order[s] for p, s in scores.items() if len(p) > 1}
        blank = [r for p, r in self.rank.items() if not p.strip(SPACE)]
        if SPACE not in self.ids or blank and (min(blank) != max(blank) or max(blank) != max(self.rank.values())):
            raise ValueError("a model whose pieces of white space rank last is needed")
        self.end = next(i for i, p in enumerate(proto.pieces) if p.type == CONTROL and p.piece == "</s>")
        #: The two tokens each piece is made of; a piece that BPE does not make of its own characters is never a token.
        self.halves = {p: (p, p) for p in self.ids if len(p) == 1}
        for p in self.rank:
            whole, last = merges(list(p), self.rank)
            if len(whole) == 1:
                self.halves[p] = last

        ids, size = self.ids, 1 << 16
        if len(self.texts) > size:
            raise ValueError("more than 65536 pieces")
        self.rank_of = [self.rank.get(t, -1) for t in (p.piece if p.type == NORMAL else "" for p in proto.pieces)]
        self.parts_of = [None] * len(self.texts)
        for p, (left, right) in self.halves.items():
            self.parts_of[ids[p]] = (ids[left], ids[right])
        #: Rank of the joint piece by both parts, left * 65536 + right.
        self.joint = {ids[p[:k]] * size + ids[p[k:]]: r for p, r in self.rank.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids}

    def codec(self) -> "Codec":
        """The codec of this process: a broadcast's tables outlive a task, and so does what was remembered."""
        if getattr(self, "made", None) is None:
            self.made = Codec(self)
        return self.made

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "made"}


class Codec:
    def __init__(self, pieces: Pieces):
        self.pieces, self.rank = pieces, pieces.rank
        self.automaton = ahocorasick.Automaton()
        for p in pieces.halves:
            self.automaton.add_word(p, (pieces.ids[p], len(p)))
        self.automaton.make_automaton()
        self.units: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[int, bool] = {}
        self.newline_apart = not any("\n" in p for p in pieces.ids)

    def may_follow(self, left: int, right: int) -> bool:
        """Whether BPE keeps tokens ``left`` and ``right`` apart when they meet.

        Two neighbours at the border stood together until a merge of rank ``limit`` took one of them; of merges of one rank the left one comes first.
        """
        rank, parts, joint = self.pieces.rank_of, self.pieces.parts_of, self.pieces.joint
        limit, wins_tie = 1 << 60, False
        while True:
            r = joint.get((left << 16) + right)
            if r is not None and (r < limit or wins_tie and r == limit):
                return False
            made_left, made_right = rank[left], rank[right]
            if made_left < 0 and made_right < 0:
                return True
            if made_left > made_right:
                limit, wins_tie, left = made_left, False, parts[left][1]
            else:
                limit, wins_tie, right = made_right, True, parts[right][0]

    def tokens(self, unit: str) -> list[int]:
        """Ids of one unit: the prefix table of last tokens, then the way back. Characters without a piece become bytes."""
        size = len(unit)
        last, lengths = [-1] * size, [1] * size
        pairs = self.pairs
        for stop, (piece, n) in self.automaton.iter(unit):
            if last[stop] < 0:
                start = stop - n
                if start >= 0 and (before := last[start]) >= 0:
                    key = (before << 16) + piece
                    fits = pairs.get(key)
                    if fits is None:
                        if len(pairs) >= PAIR_LIMIT:
                            pairs.clear()
                        fits = pairs[key] = self.may_follow(before, piece)
                    if not fits:
                        continue
                last[stop], lengths[stop] = piece, n
        out, at = [], size - 1
        while at >= 0:
            if last[at] >= 0:
                out.append(last[at])
            else:
                out += [self.pieces.bytes[b] for b in reversed(unit[at].encode("utf-8", "surrogatepass"))]
            at -= lengths[at]
        out.reverse()
        return out

    def unit_ids(self, unit: str) -> tuple[int, ...]:
        found = self.units.get(unit)
        if found is None:
            if self.newline_apart and "\n" in unit and len(unit) > 1:
                parts = [p for p in re.split("(\n)", unit) if p]
                return tuple(i for p in parts for i in self.unit_ids(p))
            found = tuple(self.spaced(unit) if unit.startswith(SPACE * 2) else self.tokens(unit))
            if len(unit) <= 64:
                if len(self.units) >= UNIT_LIMIT:
                    self.units.clear()
                self.units[unit] = found
        return found

    def spaced(self, unit: str) -> list[int]:
        """A unit that begins with several white spaces.

        Pieces of white space alone rank last, all alike: they are joined after everything else, always the leftmost pair that can be.
        """
        ids, rank = self.pieces.ids, self.pieces.rank
        run = len(unit) - len(unit.lstrip(SPACE))
        rest = self.tokens(unit[run - 1 :]) if run < len(unit) else [ids[SPACE]]
        if rest[0] == ids[SPACE]:
            rest = rest[1:]
        else:
            run -= 1
        done: list[int] = []
        for _ in range(run):
            done.append(1)
            while len(done) > 1 and SPACE * (done[-2] + done[-1]) in rank:
                done[-2:] = [done[-2] + done[-1]]
        return [ids[SPACE * n] for n in done] + rest

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text without an end id; none for an empty or missing text."""
        ids: list[int] = []
        if not text:
            return ids
        if "  " in text or SPACE in text or text[0] == " " or text[-1] == " ":
            units = re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", SPACE + text.replace(" ", SPACE))
        else:
            units = [SPACE + w for w in text.split(" ")]
        known, add, unit_ids = self.units.get, ids.extend, self.unit_ids
        for unit in units:
            add(known(unit) or unit_ids(unit))
        return ids

    def decode(self, ids: list[int]) -> str:
        """Text of ids: the dummy prefix goes, bytes are read as UTF-8 with one replacement character per wrong byte."""
        texts, bytes_, control = self.pieces.texts, self.pieces.byte_ids, self.pieces.control
        first = next((i for i in ids if i not in control), None)
        body = ids[:-1] if ids and ids[-1] in control else ids
        try:
            # A control id inside ends a run of bytes, so such rows take the way below.
            out = b"".join(map(texts.__getitem__, body)).decode("utf-8" if control.isdisjoint(body) else "ascii")
        except UnicodeDecodeError:
            out, run = "", b""
            for i in ids:
                if i in bytes_:
                    run += texts[i]
                else:
                    out, run = out + each_wrong_byte(run) + texts[i].decode(), b""
            out += each_wrong_byte(run)
        return out[1:] if first is not None and first not in bytes_ and texts[first].startswith(b" ") and first != 0 else out


def each_wrong_byte(data: bytes) -> str:
    out = ""
    while data:
        for size in range(min(4, len(data)), 0, -1):
            try:
                char = data[:size].decode("utf-8")
            except UnicodeDecodeError:
                continue
            if len(char) == 1:
                out, data = out + char, data[size:]
                break
        else:
            out, data = out + "�", data[1:]
    return out


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def load_pieces(path: str) -> Pieces:
    """Tables of a model file; the path is the driver's, the tables travel in a broadcast (a model has a fixed size)."""
    sentencepiece.SentencePieceProcessor(model_file=path)  # raises on a broken file
    return Pieces(model_bytes(path))


def encode_column(docs: DataFrame, path: str, text_column: str = "text", out: str = "ids", end: bool = True) -> DataFrame:
    """``docs`` with an array of ids; the end id closes each row. NULL and empty texts have no other id."""
    shared = docs.sparkSession.sparkContext.broadcast(load_pieces(path))

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        codec = shared.value.codec()
        last = [shared.value.end] if end else []
        for texts in batches:
            yield pd.Series([codec.encode(t) + last for t in texts])

    return docs.withColumn(out, F.pandas_udf(run, "array<int>", functionType=F.PandasUDFType.SCALAR_ITER)(F.col(text_column)))


def decode_column(docs: DataFrame, path: str, ids_column: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the text of an array of ids; NULL and empty arrays give an empty text."""
    shared = docs.sparkSession.sparkContext.broadcast(load_pieces(path))

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        codec = shared.value.codec()
        for rows in batches:
            yield pd.Series([codec.decode([] if r is None else list(r)) for r in rows])

    return docs.withColumn(out, F.pandas_udf(run, "string", functionType=F.PandasUDFType.SCALAR_ITER)(F.col(ids_column)))


def digests(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per row of ``docs``: number and digest of the encoded ids, digest of the text decoded from them, the ids if asked for.

    Encoding and decoding run in one task pass, so the id arrays need not travel between Python and the JVM.
    NULL text is an empty one, repeated rows give repeated results, an empty table gives none; no other column is read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_pieces(path))
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, end, names = shared.value.codec(), shared.value.end, [str(i) for i in range(len(shared.value.texts))]
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for s, texts in text_runs(batch.column(1), RUN_CHARS):
                rows = []
                for text in texts:
                    ids = codec.encode(text)
                    ids.append(end)
                    numbers = " ".join(map(names.__getitem__, ids))
                    row = (len(ids), hashlib.sha256(numbers.encode()).hexdigest(), hashlib.sha256(codec.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
                    rows.append(row + (ids,) * with_ids)
                yield record_batch(schema, [keys[s], *map(list, zip(*rows, strict=True))])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


@query()
def op7_piece_codec(spark, sf):
    return digests(table(spark, sf, "documents"), default_model())

"""Chat texts from event logs: fold deltas, edits and regenerations into final messages, then render them with a loss mask.

Events are partitioned by conversation and range of messages and sorted by message and sequence, so a task holds one message at a time and
a conversation of any length spreads over tasks. Digests of whole conversations are taken from the rendered pieces as they stream
by in order.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plantlens.llm.common import query, record_batch, table

#: Strings that steer a model and must not come out of a text. Fixed values.
CONTROLS = ["<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
MESSAGES_PER_PART = 64


@dataclass(frozen=True)
class Template:
    """Marks around a turn: ``open_`` role ``middle`` text ``close``. Every mark begins with a control string."""

    open_: str = "<|turn|>"
    middle: str = "\n"
    close: str = "<|end|>\n"


BREAK = re.compile("|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROLS) + r"|\\")


def escape(text: str) -> str:
    """A backslash after the first character of each control string, and after each backslash."""
    return BREAK.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    """Backslashes go, but the first of two stays."""
    return re.sub(r"\\(\\?)", r"\1", text)


def role_mark(role: str) -> str:
    return role.replace("%", "%25").replace("\n", "%0A").replace("<", "%3C").replace("[", "%5B")


def render(role: str, text: str, t: Template) -> tuple[str, int, int]:
    """Formatted turn, and where its text starts and how long it is there."""
    head, body = t.open_ + role_mark(role) + t.middle, escape(text)
    return head + body + t.close, len(head), len(body)


def parse(piece: str, t: Template) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    head, _, rest = piece.removeprefix(t.open_).partition(t.middle)
    return unquote(head), unescape(rest.removesuffix(t.close))


def fold(events: list[tuple[int, str, str | None, str | None]]) -> tuple[str, str] | None:
    """Role and text of one message from its events (seq, kind, role, text) in order.

    ``open`` names the role, ``delta`` appends, ``edit`` replaces the text, ``regenerate`` drops it, ``remove`` takes the message away. An
    event delivered twice (same sequence number) counts once; deltas before or without an ``open`` have an empty role.
    """
    role, parts, there, last = "", [], False, object()
    for seq, kind, event_role, text in events:
        if seq == last:
            continue
        last = seq
        if kind == "remove":
            role, parts, there = "", [], False
            continue
        there = True
        if kind == "open":
            role = event_role or ""
        elif kind == "delta":
            parts.append(text or "")
        elif kind == "edit":
            parts = [text or ""]
        elif kind == "regenerate":
            parts = []
        else:
            raise ValueError(f"unknown event kind {kind!r}")
    return (role, "".join(parts)) if there else None


def format_conversations(events: DataFrame, template: Template = Template()) -> DataFrame:
    """``events``: conv_id, message, seq, kind, role, text. One row per message that is left: conv_id, message, formatted, loss_start, loss_length.

    ``message`` orders a conversation's messages; ``formatted`` pieces in that order are its text, and only assistant turns have a loss
    (else both numbers are NULL). NULL texts are empty, events of a NULL conversation or message form one of their own, an
    empty table gives no rows, other columns are not read. One shuffle.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("message", pa.int64()), ("formatted", pa.string()), ("loss_start", pa.int64()), ("loss_length", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            key, own = None, []
            for batch in batches:
                for conv, message, *event in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                    if (conv, message) != key:
                        if own:
                            yield key, fold(own)
                        key, own = (conv, message), []
                    own.append(tuple(event))
            if own:
                yield key, fold(own)

        out: list[tuple] = []
        size = 0
        for (conv, message), found in rows():
            if found is None:
                continue
            role, text = found
            piece, start, length = render(role, text, template)
            out.append((conv, message, piece, *((start, length) if role == "assistant" else (None, None))))
            size += len(piece)
            if len(out) >= 2000 or size > 4_000_000:
                yield record_batch(schema, [list(c) for c in zip(*out, strict=True)])
                out, size = [], 0
        if out:
            yield record_batch(schema, [list(c) for c in zip(*out, strict=True)])

    rows = events.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("message").cast("long").alias("message"), F.col("seq").cast("long").alias("seq"), "kind", "role", "text")
    part = F.floor(F.col("message") / MESSAGES_PER_PART)
    ready = rows.repartition("conv_id", part).sortWithinPartitions("conv_id", "message", "seq", "kind", "role", "text")
    return ready.mapInArrow(run, "conv_id long, message long, formatted string, loss_start long, loss_length long")


def read_back(pieces: DataFrame, template: Template = Template()) -> DataFrame:
    """Per conversation, from formatted pieces alone: turns, their digest, length and digest of the text under the loss mask, length.

    Pieces stream by in order; the digests are carried along, so a conversation of any length needs the memory of one piece.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, key, out = True, None, []

        def closed():
            return (key, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars)

        for batch in batches:
            for conv, piece, start, length in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if first or conv != key:
                    if not first:
                        out.append(closed())
                    first, key, n, chars, loss_chars, turns, loss = False, conv, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                role, text = parse(piece, template)
                turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                n, chars = n + 1, chars + len(piece)
                if start is not None:
                    learned = unescape(piece[start : start + length])
                    loss_chars += len(learned)
                    loss.update(learned.encode("utf-8", "surrogatepass"))
            if len(out) >= 2000:
                yield record_batch(schema, [list(c) for c in zip(*out, strict=True)])
                out = []
        if not first:
            out.append(closed())
        if out:
            yield record_batch(schema, [list(c) for c in zip(*out, strict=True)])

    ready = pieces.select("conv_id", "formatted", "loss_start", "loss_length", "message").repartition("conv_id").sortWithinPartitions("conv_id", "message")
    return ready.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def events_of(turns: DataFrame) -> DataFrame:
    """The event log of a service that streamed these turns: rows (conv_id, turn, role, text) as events.

    Texts come in three deltas. Every third assistant turn was first streamed to its half and regenerated, every other user turn was
    sent with a slip and edited. Repeated rows of a turn are turns of their own, in order of role and text.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.withColumn("message", F.row_number().over(order) - 1).withColumn("text", F.coalesce("text", F.lit("")))
    text, third = F.col("text"), F.greatest(F.floor(F.length("text") / 3), F.lit(0)).cast("int")
    event = lambda kind, body: F.struct(F.lit(kind).alias("kind"), body.cast("string").alias("text"))
    one, rest = text.substr(F.lit(1), third), F.length("text")
    deltas = [event("delta", one), event("delta", text.substr(third + 1, third)), event("delta", text.substr(third * 2 + 1, rest))]
    none = F.lit(None).cast("string")
    plain = F.array(event("open", none), *deltas)
    again = F.array(event("open", none), event("delta", one), event("regenerate", none), *deltas)
    edited = F.array(event("open", none), event("delta", F.concat(F.lit("slip "), one)), event("edit", text))
    turn = F.coalesce("turn", F.lit(0))
    story = F.when((F.col("role") == "assistant") & (turn % 3 == 0), again).when((F.col("role") == "user") & (turn % 2 == 0), edited).otherwise(plain)
    found = rows.select("conv_id", "message", "role", F.posexplode(story).alias("step", "e"))
    return found.select("conv_id", "message", (F.col("message") * 10 + F.col("step")).alias("seq"), "e.kind", F.when(F.col("e.kind") == "open", F.col("role")).alias("role"), "e.text")


def _sql() -> str:
    marks = " + ".join(f"(len(text) - len(replace(text, '{c}', ''))) // {len(c)}" for c in [*CONTROLS, "\\"])
    t = Template()
    fixed = len(t.open_) + len(t.middle) + len(t.close)
    case = "'</s>[INST] ok [/INST]'"
    return f"""WITH d AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
        UNION ALL VALUES (-7, 0, 'user', {case}), (-7, 1, 'assistant', {case})),
      e AS (SELECT *, len(text) + {marks} + len(role) + {fixed} AS chars FROM d)
    SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
      coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
      sum(chars)::BIGINT AS formatted_chars FROM e GROUP BY conv_id"""


def probe_turns(spark) -> DataFrame:
    """Conversation -7, whose texts hold control strings."""
    text = "</s>[INST] ok [/INST]"
    return spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")


@query(_sql())
def op6_chat_format(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe_turns(spark))
    return read_back(format_conversations(events_of(turns)))

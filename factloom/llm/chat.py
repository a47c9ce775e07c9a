"""Chat formatting from event logs.

A log holds a conversation's messages as events: a message is opened, streamed in deltas, edited, generated again or
deleted. Events are folded and rendered message by message, so that a conversation of any length spreads over the
cluster; a running sum over its messages in order then places them, as a stream that holds one message at a time.

Template: an assistant's turn is `<s>text</s>`, any other `<s>[INST]role, newline, text[/INST]`. A control string inside
a text gets one more backslash after its first character (`</s>` becomes `<\\/s>`, `<\\/s>` becomes `<\\\\/s>`); reading
takes one away. Text under the loss mask is what assistants said.

Defined results: a null text or role is empty; events without an opening one open a message themselves; further opening
events of a message id are messages of their own; equal rows are separate messages; ties in order go by kind, role and
text; a null seq comes last; events of an unknown or null kind count for nothing; a null conv_id is a conversation; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, small_batches

KINDS = ("message", "delta", "edit", "regenerate", "delete")
ASSISTANT = "assistant"

_PLAIN = re.compile(r"<(\\*)(/?s>)|\[(\\*)(/?INST\])")
_ESCAPED = re.compile(r"<\\(\\*)(/?s>)|\[\\(\\*)(/?INST\])")
_TURN = re.compile(r"<s>(?:\[INST\]([^\n]*)\n(.*?)\[/INST\]|(.*?)</s>)", re.S)


def escape(text: str) -> str:
    return _PLAIN.sub(lambda m: f"<\\{m[1]}{m[2]}" if m[2] else f"[\\{m[3]}{m[4]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: f"<{m[1]}{m[2]}" if m[2] else f"[{m[3]}{m[4]}", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn and where its text under the loss mask begins and ends (-1: none)."""
    if role == ASSISTANT:
        body = escape(text)
        return f"<s>{body}</s>", 3, 3 + len(body)
    header = escape(role.replace("\\", "\\\\").replace("\n", "\\n"))
    return f"<s>[INST]{header}\n{escape(text)}[/INST]", -1, -1


def parse(formatted: str) -> Iterator[tuple[str, str, int]]:
    """The turns of a rendered stretch: role, text, and where each ends."""
    at = 0
    while m := _TURN.match(formatted, at):
        at = m.end()
        if m[3] is not None:
            yield ASSISTANT, unescape(m[3]), at
        else:
            yield re.sub(r"\\(.)", lambda x: "\n" if x[1] == "n" else x[1], unescape(m[1])), unescape(m[2]), at


def _fold(rendered: bool):
    """Messages from events sorted by message and order, as they are or rendered."""

    def made(rows: list[tuple]) -> pa.RecordBatch:
        if rendered:
            rows = [(conv, seq, role, *render(role, text)) for conv, seq, role, text in rows]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        columns = list(zip(*rows, strict=True))
        return pa.record_batch([pa.array(x, k) for x, k in zip(columns, kinds, strict=False)], names=["conv_id", "seq", "role", "text", "a", "b"][: len(columns)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, None  # held: order, role, parts of the text
        out: list[tuple] = []
        size = 0

        def close() -> int:
            if held is None:
                return 0
            text = "".join(held[2])
            out.append((key[0], held[0], held[1], text))
            return len(text)

        for batch in batches:
            for conv, message, seq, kind, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (conv, message) != key:
                    size += close()
                    key, held = (conv, message), None
                if kind == "message":
                    size += close()
                    held = [seq, role, [text]]
                elif kind == "delete":
                    held = None
                elif held is None:
                    held = [seq, role, [text]]
                elif kind == "delta":
                    held[2].append(text)
                else:  # edited or generated again: what follows replaces what was there
                    held[2] = [text]
                if len(out) >= 1000 or size > CHUNK_BYTES:
                    yield made(out)
                    out, size = [], 0
        close()
        if out:
            yield made(out)

    return run


def _read_back(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of conversations from rendered turns in order: of what parsing finds, and of what the loss mask covers."""
    out: list[tuple] = []
    conv, begun = None, False
    turns = loss = None
    n = chars = total = 0
    left = ""

    def close() -> None:
        if begun:
            if left:
                raise ValueError(f"conversation {conv}: {len(left)} characters are no turn")
            out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), total))

    for batch in batches:
        for c, piece, start, a, b in zip(*(batch.column(k).to_pylist() for k in (0, 3, 4, 5, 6)), strict=True):
            if not begun or c != conv:
                close()
                conv, begun, turns, loss, n, chars, total, left = c, True, hashlib.sha256(), hashlib.sha256(), 0, 0, 0, ""
            total += len(piece)
            left += piece
            end = 0
            for role, text, end in parse(left):  # noqa: B007
                turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                n += 1
            left = left[end:]
            if a is not None:
                said = unescape(piece[a - start : b - start])
                loss.update(said.encode("utf-8", "surrogatepass"))
                chars += len(said)
        if len(out) > 1000:
            yield _digests(out)
            out = []
    close()
    if out:
        yield _digests(out)


_DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.record_batch([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in _DIGESTS.split(", ")])


def _folded(events: DataFrame, rendered: bool, schema: str) -> DataFrame:
    small_batches(events.sparkSession)
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    own = events.where(F.col("kind").isin(*KINDS)).select(F.col("conv_id").cast("long"), F.col("message_id").cast("long"), F.col("seq").cast("long"), "kind", text("role"), text("text"))
    dealt = own.repartition("conv_id", "message_id").sortWithinPartitions("conv_id", "message_id", F.col("seq").asc_nulls_last(), rank, "role", "text")
    return dealt.mapInArrow(_fold(rendered), schema)


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, seq, role, text) of final messages, for events (conv_id, message_id, seq, kind, role, text)."""
    return _folded(events, False, "conv_id long, seq long, role string, text string")


def format_chats(events: DataFrame) -> DataFrame:
    """A row for each rendered turn, in order within a conversation: its text, place and loss mask there."""
    pieces = _folded(events, True, "conv_id long, seq long, role string, text string, a long, b long")
    body = F.substring(F.col("text"), F.lit(1), F.char_length("text") - F.when(F.col("role") == ASSISTANT, 4).otherwise(7))
    plain = F.regexp_replace(F.regexp_replace(body, r"<\\(\\*/?s>)", "<$1"), r"\[\\(\\*/?INST\])", r"\[$1")
    # ties go by the text as it was said: what stands before it is the same
    said = F.when(F.contains(body, F.lit("\\")), plain).otherwise(body)
    ordered = W.partitionBy("conv_id").orderBy(F.col("seq").asc_nulls_last(), "role", said)
    start = F.coalesce(F.sum(F.char_length("text")).over(ordered.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = pieces.select("conv_id", (F.row_number().over(ordered) - 1).cast("long").alias("turn"), "role", F.col("text").alias("formatted"), start.alias("start"), "a", "b")
    at = lambda c: F.when(F.col("a") >= 0, F.col("start") + F.col(c))
    return placed.select("conv_id", "turn", "role", "formatted", "start", at("a").alias("loss_start"), at("b").alias("loss_end"))


def event_log(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) as a log that streams them: what an engine would have written.

    Each message is opened and gets a draft in a delta. What an assistant says is then generated again in three deltas, another's
    message is edited to its first part and goes on in two deltas. A message beside every turn is opened and deleted.
    Turns are below 2^58 in size; a null one comes last.
    """
    n = F.char_length("text")
    cut = [F.lit(0), F.floor(n / 3).cast("int"), F.floor(2 * n / 3).cast("int"), n]
    part = [F.substring(F.col("text"), cut[k] + 1, cut[k + 1] - cut[k]) for k in range(3)]
    event = lambda step, kind, text, other=0: F.struct(F.lit(step).alias("step"), F.lit(kind).alias("kind"), text.alias("text"), F.lit(other).alias("other"))
    said = F.col("role") == ASSISTANT
    again = F.struct(F.lit(2).alias("step"), F.when(said, "regenerate").otherwise("edit").alias("kind"), F.when(said, "").otherwise(part[0]).alias("text"), F.lit(0).alias("other"))
    steps = F.array(
        event(0, "message", F.lit("")), event(0, "message", F.lit("never said"), 1), event(1, "delta", F.lit("a draft</s>")), again,
        event(3, "delta", F.when(said, part[0]).otherwise("")), event(4, "delta", part[1]), event(5, "delta", part[2]), event(6, "delete", F.lit(""), 1),
    )
    own = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("number"))
    told = own.select("conv_id", "turn", "role", "number", F.explode(steps).alias("x"))
    return told.select("conv_id", (2 * F.col("number") + F.col("x.other")).alias("message_id"), (F.coalesce("turn", F.lit(2**59)) * 8 + F.col("x.step")).alias("seq"), F.col("x.kind").alias("kind"), "role", F.col("x.text").alias("text"))


def chat_digests(events: DataFrame) -> DataFrame:
    """What reading the output of format_chats back gives, a row for each conversation."""
    return format_chats(events).mapInArrow(_read_back, _DIGESTS)

"""Chat formatting: typed content parts to one template, with a loss mask, and the way back.

A turn is `### role: ` + content + `</turn>` and a newline. Backslash, `#`, `<`, and in a role also `:`, get a backslash
in front wherever they come from a text, so no text can hold a control string, and dropping the backslashes gives the
text back. A part that isn't text becomes a placeholder `<kind:n>`, whose `<` stands bare since it is control; n counts
the attachments of the conversation.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_batches, short_batches

LEARNT_ROLE = "assistant"
#: Tokens of a placeholder once a model expands it: a tile of an image, a second of audio, a page of a document.
IMAGE_TILE, TOKENS_PER_TILE, TOKENS_PER_SECOND, TOKENS_PER_PAGE = 512, 256, 25, 600
PART_TYPE = "struct<type: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>"
FORMATTED = "conv_id long, turn_index long, role string, formatted string, start long, loss_start long, loss_end long, attachments array<struct<kind: string, ref: string, position: long, tokens: long>>, expanded_tokens long"

_ESCAPED = re.compile(r"[\\#<]")
_ROLE_ESCAPED = re.compile(r"[\\#<:]")
_BACK = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"### ((?:[^\\#<:]|\\.)*): ((?:[^\\#<]|\\.|<(?:image|audio|document|unknown):\d+>)*)</turn>\n", re.DOTALL)


def escape(text: str) -> str:
    return _ESCAPED.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text)


@dataclass
class Flattener:
    """Visits a turn's parts in order; placeholders are numbered over the whole conversation."""

    numbered: int = 0
    out: list[str] = field(default_factory=list)
    size: int = 0
    attachments: list[dict] = field(default_factory=list)

    def put(self, text: str) -> None:
        self.out.append(text)
        self.size += len(text)

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_unknown)(part)

    def visit_text(self, part: dict) -> None:
        self.put(escape(part.get("text") or ""))

    def attach(self, kind: str, part: dict, tokens: int) -> None:
        self.attachments.append({"kind": kind, "ref": part.get("ref"), "position": self.size, "tokens": tokens})
        self.put(f"<{kind}:{self.numbered}>")
        self.numbered += 1

    def visit_image(self, part: dict) -> None:
        tiles = max(1, math.ceil((part.get("width") or 0) / IMAGE_TILE)) * max(1, math.ceil((part.get("height") or 0) / IMAGE_TILE))
        self.attach("image", part, tiles * TOKENS_PER_TILE)

    def visit_audio(self, part: dict) -> None:
        self.attach("audio", part, math.ceil((part.get("seconds") or 0) * TOKENS_PER_SECOND))

    def visit_document(self, part: dict) -> None:
        self.attach("document", part, max(1, part.get("pages") or 0) * TOKENS_PER_PAGE)

    def visit_unknown(self, part: dict) -> None:
        self.attach("unknown", part, 0)

    def taken(self) -> tuple[str, list[dict]]:
        text, found = "".join(self.out), self.attachments
        self.out, self.size, self.attachments = [], 0, []
        return text, found


def format_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str | None = "text", parts_col: str | None = None) -> DataFrame:
    """FORMATTED: a row for each turn of each conversation, in order within a partition.

    A conversation's text is its rows' `formatted`, one after another; `start` is a turn's place in it and
    [loss_start, loss_end) the part to learn, empty but for the assistant's turns. Turns are ordered by turn, ties by role
    and text, and repeated rows stay. The content is parts_col (an array of PART_TYPE) or, without it, text_col; null content
    and null roles are empty, null turns come first, rows of a null conversation form one. Rows are dealt by conversation,
    sorted on disk and streamed, so a long conversation is never held in memory. An empty table gives no rows.
    """
    spark = rows.sparkSession
    short_batches(spark)
    content = F.col(parts_col) if parts_col else F.array(F.struct(F.lit("text").alias("type"), F.col(text_col).alias("text")))
    chosen = rows.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), content.alias("parts"))
    tie = [F.to_json("parts")] if parts_col else [F.col("parts")[0].text]
    dealt = chosen.repartition("conv").sortWithinPartitions("conv", "turn", "role", *tie)
    schema = pa.schema([("conv_id", pa.int64()), ("turn_index", pa.int64()), ("role", pa.string()), ("formatted", pa.string()), ("start", pa.int64()), ("loss_start", pa.int64()), ("loss_end", pa.int64()), ("attachments", pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("position", pa.int64()), ("tokens", pa.int64())]))), ("expanded_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, index, place, flat = object(), 0, 0, Flattener()
        for batch in batches:
            out = []
            for conv, role, parts in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if conv != at:
                    at, index, place, flat = conv, 0, 0, Flattener()
                for part in parts or ():
                    flat.visit(part or {})
                body, found = flat.taken()
                head = f"### {_ROLE_ESCAPED.sub(r'\\\g<0>', role or '')}: "
                text = f"{head}{body}</turn>\n"
                first = place + len(head)
                for one in found:
                    one["position"] += first
                out.append((conv, index, role, text, place, first, first + len(body) * (role == LEARNT_ROLE), found, sum(x["tokens"] for x in found)))
                index += 1
                place += len(text)
            yield as_batches(dict(zip(schema.names, zip(*out, strict=True) if out else [[]] * len(schema), strict=True)), schema)

    return dealt.mapInArrow(run, FORMATTED)


def parse_turn(formatted: str) -> tuple[str, str]:
    """Role and text of a formatted turn, or ValueError."""
    found = _TURN.fullmatch(formatted)
    if not found:
        raise ValueError("not a formatted turn")
    return unescape(found[1]), unescape(found[2])


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, from nothing but the formatted turns and the loss mask, as they stream by in order."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None

        def closed() -> list:
            turns, loss, n, chars, size = state
            return [at, n, turns.hexdigest(), chars, loss.hexdigest(), size]

        for batch in batches:
            out = []
            for conv, text, start, a, b in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if state is None or conv != at:
                    if state is not None:
                        out.append(closed())
                    at, state = conv, [hashlib.sha256(), hashlib.sha256(), 0, 0, 0]
                role, content = parse_turn(text)
                learnt = unescape(text[a - start : b - start])
                state[0].update(f"{role}\n{content}\n".encode())
                state[1].update(learnt.encode())
                state[2] += 1
                state[3] += len(learnt)
                state[4] += len(text)
            if out:
                yield as_batches(dict(zip(schema.names, zip(*out, strict=True), strict=True)), schema)
        if state is not None:
            yield as_batches(dict(zip(schema.names, zip(*[closed()], strict=True), strict=True)), schema)

    return formatted.select("conv_id", "formatted", "start", "loss_start", "loss_end").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

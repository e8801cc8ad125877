"""Chat formatting of typed content parts.

A message is plain text or a list of typed parts: text, image, audio, document.  One
visitor flattens the parts into text with ordered placeholders and records every
attachment: number, kind, reference and expanded token count.

A turn is written as ``### role: text </turn>`` and a line feed.  In a text a backslash
stands before each of ``###``, ``</turn>`` and ``<|``, and a run of n backslashes that
leads to one of them (or to a placeholder) is written 2n times, so no text can be taken
for markup and every text reads back exactly.

Plan: rows meet by (conversation, run of turns), sorted, and stream through the
formatter into pieces of bounded size; the digests stream over a conversation's pieces.
Neither task holds a conversation, however long it is.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillframe.llm.common import small_batches

OPEN, CLOSE, PLACE = "### ", " </turn>\n", "<|"
ROLE_END = ": "
#: Turns of a run, and characters after which a piece is closed.
RUN, PIECE_CHARS = 64, 1 << 20

_CONTROL = re.compile(r"(\\*)(###|</turn>|<\|)")
_ESCAPED = re.compile(r"(\\+)(###|</turn>|<\|)")
_TAIL = re.compile(r"\\+\Z")


def escape(text: str, before_placeholder: bool = False) -> str:
    """Text in which no control string stands by itself."""
    out = _CONTROL.sub(lambda m: m[1] * 2 + "\\" + m[2], text)
    if before_placeholder:
        out = _TAIL.sub(lambda m: m[0] * 2, out)
    return out


def unescape(text: str) -> str:
    """The inverse of :func:`escape`; placeholders stay as they are."""
    return _ESCAPED.sub(lambda m: "\\" * (len(m[1]) // 2) + m[2], text)


@dataclass
class Attachment:
    """What a placeholder stands for: its order within the turn, and the label that stands in the text."""

    number: int
    label: str
    kind: str
    reference: str
    tokens: int


@dataclass
class Flat:
    """Escaped text with placeholders, and the attachments in order."""

    text: str = ""
    attachments: list[Attachment] = field(default_factory=list)


#: Sizes beyond this are taken as unknown.
MOST = 1 << 31


def _size(value) -> float:
    """A positive number, also written as text; anything else counts as one."""
    try:
        x = float(value)
    except (TypeError, ValueError):
        return 1.0
    return x if not isinstance(value, bool) and 0 < x < MOST else 1.0


class PartVisitor:
    """Flattens typed parts in order; one method a kind.

    An image costs one token a tile of ``tile`` pixels a side and one for the whole,
    audio ``audio_rate`` tokens a second begun, a document ``page_tokens`` a page begun.  A
    size that is unknown, no positive number or beyond MOST counts as one pixel, second or
    page.  A part of an unknown kind is kept as an attachment of kind ``other`` without tokens;
    a null part or text is empty.  ``prefix`` leads the number in a placeholder.
    """

    def __init__(self, tile: int = 512, audio_rate: int = 25, page_tokens: int = 800, prefix: str = "") -> None:
        self.tile, self.audio_rate, self.page_tokens, self.prefix = tile, audio_rate, page_tokens, prefix
        self.found: list[Attachment] = []

    def visit(self, content: str | list | None) -> Flat:
        parts = content if isinstance(content, list) else [{"type": "text", "text": content}]
        self.found = []
        out: list[str] = []
        held = ""  # neighbouring texts are one text: a control string may run across their seam
        for part in parts:
            if part is None:
                continue
            kind = part.get("type", "text")
            if kind == "text":
                text = part.get("text")
                held += text if isinstance(text, str) else "" if text is None else json.dumps(text, ensure_ascii=False)
                continue
            if kind not in ("image", "audio", "document"):
                kind = "other"
            out += [escape(held, before_placeholder=True), self._attach(kind, part, getattr(self, f"visit_{kind}")(part))]
            held = ""
        return Flat("".join([*out, escape(held)]), self.found)

    def _attach(self, kind: str, part: dict, tokens: int) -> str:
        reference = str(part.get("url") or part.get("id") or part.get("name") or "")
        number = len(self.found) + 1
        self.found.append(Attachment(number, f"{self.prefix}{number}", kind, reference, tokens))
        return f"{PLACE}{kind} {self.prefix}{number}|>"

    def visit_image(self, part: dict) -> int:
        wide, high = (math.ceil(_size(part.get(k)) / self.tile) for k in ("width", "height"))
        return wide * high + 1

    def visit_audio(self, part: dict) -> int:
        return math.ceil(_size(part.get("seconds"))) * self.audio_rate

    def visit_document(self, part: dict) -> int:
        return math.ceil(_size(part.get("pages"))) * self.page_tokens

    def visit_other(self, part: dict) -> int:
        return 0


def write_role(role: str | None) -> str:
    """A role without markup characters; null is empty."""
    return re.sub(r"[\\:<#\n]", lambda m: f"\\{ord(m[0]):02x}", role or "")


def read_role(text: str) -> str:
    return re.sub(r"\\([0-9a-f]{2})", lambda m: chr(int(m[1], 16)), text)


def format_turn(role: str | None, flat: str) -> tuple[str, int, int]:
    """The marked turn, and where its text starts and ends."""
    head = f"{OPEN}{write_role(role)}{ROLE_END}"
    return f"{head}{flat}{CLOSE}", len(head), len(head) + len(flat)


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of every turn of the formatted text."""
    at = 0
    while at < len(formatted):
        start = formatted.index(ROLE_END, at) + len(ROLE_END)
        end = formatted.index(CLOSE, start)  # a text's own closing string has a backslash before it
        if not formatted.startswith(OPEN, at):
            raise ValueError(f"no turn at {at}")
        yield read_role(formatted[at + len(OPEN):start - len(ROLE_END)]), unescape(formatted[start:end])
        at = end + len(CLOSE)


PIECES = ("conv_id bigint, run bigint, piece int, formatted string, n_turns int, loss array<struct<start:int,stop:int>>, "
          "attachments array<struct<turn:bigint,number:int,label:string,kind:string,reference:string,tokens:bigint>>, attached_tokens bigint")


def _format(typed: bool, trained: frozenset[str]):
    def run(batches) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([
            ("conv_id", pa.int64()), ("run", pa.int64()), ("piece", pa.int32()), ("formatted", pa.string()), ("n_turns", pa.int32()),
            ("loss", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
            ("attachments", pa.list_(pa.struct([("turn", pa.int64()), ("number", pa.int32()), ("label", pa.string()), ("kind", pa.string()), ("reference", pa.string()),
                                                ("tokens", pa.int64())]))),
            ("attached_tokens", pa.int64())])
        key, piece, out, held, ordinal = None, 0, [], [], 0
        size = n = 0
        loss, files = [], []

        def close():
            nonlocal out, loss, files, size, n, piece
            if n:
                held.append({"conv_id": key[0], "run": key[1], "piece": piece, "formatted": "".join(out), "n_turns": n, "loss": loss,
                             "attachments": files, "attached_tokens": sum(f["tokens"] for f in files)})
                piece += 1
            out, loss, files, size, n = [], [], [], 0, 0

        def send():
            nonlocal held
            rows, held = held, []
            return pa.RecordBatch.from_pylist(rows, schema=schema)

        for batch in batches:
            for conv, at, turn, role, text in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if (conv, at) != key:
                    close()
                    key, piece, ordinal = (conv, at), 0, 0
                flat = PartVisitor(prefix=f"{'n' if at is None else at}.{ordinal}.").visit(content_of(text, typed))
                ordinal += 1
                marked, start, stop = format_turn(role, flat.text)
                out.append(marked)
                if role in trained:
                    loss.append({"start": size + start, "stop": size + stop})
                files += [{"turn": turn, **vars(a)} for a in flat.attachments]
                size += len(marked)
                n += 1
                if size >= PIECE_CHARS or n >= 4 * RUN:
                    close()
                    yield send()
            if held:
                yield send()
        close()
        if held:
            yield send()

    return run


def content_of(text: str | None, typed: bool) -> str | list | None:
    """With ``typed`` a JSON list of objects that all have a type is a list of parts; all else is text."""
    if typed and text and text.lstrip().startswith("["):
        try:
            parts = json.loads(text)
        except ValueError:
            return text
        if isinstance(parts, list) and parts and all(isinstance(p, dict) and "type" in p for p in parts):
            return parts
    return text


def format_conversations(turns: DataFrame, typed: bool = True, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Pieces of the formatted conversations: conv_id, run, piece (their order), formatted, n_turns,
    loss (spans of code points that are trained on), attachments and their token count.

    ``turns`` has conv_id, turn, role, text; other columns are ignored.  Null texts are
    empty, a null role is the empty role, null turns come first, rows with one turn
    number are ordered by role and text and all kept, null conversations are one
    conversation.  A placeholder's label is run, place of the row in the run and number in
    the turn (``0.3.1``; a null turn's run is ``n``), so it's unique in the conversation and
    doesn't depend on the pieces.  An empty table gives no rows.
    """
    small_batches(turns.sparkSession)
    rows = turns.select(F.col("conv_id").cast("bigint"), F.expr(f"cast(turn as bigint) div {RUN}").alias("run"), F.col("turn").cast("bigint"),
                        F.col("role").cast("string"), F.col("text").cast("string"))
    return rows.repartition("conv_id", "run").sortWithinPartitions("conv_id", "run", "turn", "role", "text").mapInArrow(
        _format(typed, frozenset(trained)), PIECES)


DIGESTS = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, attached_tokens bigint, "
DIGESTS += "n_attachments bigint, attachments_sha256 string"


def _digest(batches) -> Iterator:
    """One row a conversation, read back from its pieces, which come in order."""
    import pyarrow as pa

    names = [x.split()[0] for x in DIGESTS.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    rows: list[tuple] = []
    some, key = False, None
    turns = loss = files = None
    n = chars = loss_chars = tokens = attached = 0

    def close():
        if some:
            rows.append((key, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, tokens, attached, files.hexdigest()))

    for batch in batches:
        for conv, formatted, spans, own, parts in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss", "attached_tokens", "attachments"))):
            if not some or conv != key:
                close()
                some, key, turns, loss, files = True, conv, hashlib.sha256(), hashlib.sha256(), hashlib.sha256()
                n = chars = loss_chars = tokens = attached = 0
            for role, text in read_turns(formatted):
                turns.update(f"{role}\n{text}\n".encode())
                n += 1
            for span in spans:
                part = unescape(formatted[span["start"]:span["stop"]])
                loss.update(part.encode())
                loss_chars += len(part)
            chars += len(formatted)
            tokens += own
            attached += len(parts)
            for x in parts:
                files.update(f"{x['label']} {x['kind']} {x['reference']} {x['tokens']}\n".encode())
        if rows:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
            rows = []
    close()
    if rows:
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def conversation_digests(pieces: DataFrame) -> DataFrame:
    """One row a conversation: turns and loss text as read back from the formatted pieces, and a digest of its attachments.

    The digests run over a conversation in order, so one task streams it, however long it
    is; it holds one piece at a time.
    """
    return pieces.select("conv_id", "run", "piece", "formatted", "loss", "attached_tokens", "attachments").repartition("conv_id").sortWithinPartitions(
        "conv_id", "run", "piece").mapInArrow(_digest, DIGESTS)

"""Chat formatting with typed content parts.

A turn's content is a text, or an array of typed parts: text, image, audio,
document. A visitor goes through the parts in order and flattens them: texts are
escaped and written out, every attachment becomes the placeholder of its kind, and
its reference, its place in the conversation's text and the number of tokens that
the placeholder expands to are recorded. The result is one row per turn with its piece of
the conversation's text; the pieces in order are the text:

    <|im_start|>role
    body<|im_end|>

Control strings in a text are escaped so that they can be read back: a ``\\`` goes
between ``<`` and ``|``, also where some are there already. So ``<|`` begins control strings
only. Texts that follow each other are one text, so none is put together across parts. In roles
line ends and backslashes are escaped as well. The loss mask is a list of spans, code points
of the conversation's text: the texts of assistant turns, no more and no less.

On Spark: turns are shuffled once by conversation and sorted inside their
partitions; texts then stream through, one turn at a time, so a conversation
may be longer than a worker's memory. A conversation is one task's, as its offsets and digests
go from turn to turn. ``digests`` reads the pieces back the same way, by a parser that
is fed piece by piece.

Defined cases: a null or empty text is an empty body, null parts are no parts; a null role is
empty; rows with a null conversation id are one conversation; turns that tie are in the
order of role and text, null first; rows that repeat are turns; a part of another
type is an ``other`` attachment; an attachment without a size counts one token
(a page's tokens, for documents); extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"
KINDS = ("image", "audio", "document", "other")
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"

_OPEN = re.compile(r"<(?=\\*\|)")
_ESCAPED = re.compile(r"<\\(?=\\*\|)")
_CONTROL = re.compile(r"<\|(im_start|im_end|" + "|".join(KINDS) + r")\|>")


def escape(text: str) -> str:
    return _OPEN.sub(r"<\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub("<", text)


def escape_role(role: str | None) -> str:
    return escape((role or "").replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


@dataclass(frozen=True)
class Costs:
    """Tokens that placeholders expand to."""

    patch: int = 28          # side of the square of pixels that is one token
    audio_rate: float = 25.0  # tokens of a second
    page: int = 1024

    def image(self, width: int | None, height: int | None) -> int:
        return max(1, -(-(width or 0) // self.patch)) * max(1, -(-(height or 0) // self.patch))

    def audio(self, seconds: float | None) -> int:
        ok = seconds is not None and math.isfinite(seconds)
        return max(1, math.ceil(seconds * self.audio_rate)) if ok else 1

    def document(self, pages: int | None) -> int:
        return self.page * max(1, pages or 1)


@dataclass
class Flattener:
    """Visits the parts of one turn. ``at`` is the place in the conversation's text."""

    costs: Costs
    at: int
    ordinal: int
    written: list[str] = field(default_factory=list)
    texts: list[tuple[int, int]] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    open_text: list[str] = field(default_factory=list)

    def raw(self, text: str) -> None:
        self.written.append(text)
        self.at += len(text)

    def close_text(self) -> None:
        text = escape("".join(self.open_text))
        self.open_text.clear()
        if text:
            self.texts.append((self.at, self.at + len(text)))
            self.raw(text)

    def attach(self, kind: str, part: dict, n_tokens: int) -> None:
        self.close_text()
        self.attachments.append({"ordinal": self.ordinal, "kind": kind, "type": part.get("type"), "ref": part.get("ref"), "start": self.at, "n_tokens": n_tokens})
        self.ordinal += 1
        self.raw(f"<|{kind}|>")

    def visit(self, part: dict | None) -> None:
        if part is not None:
            getattr(self, f"visit_{part.get('type')}", self.visit_other)(part)

    def visit_text(self, part: dict) -> None:
        self.open_text.append(part.get("text") or "")

    def visit_image(self, part: dict) -> None:
        self.attach("image", part, self.costs.image(part.get("width"), part.get("height")))

    def visit_audio(self, part: dict) -> None:
        self.attach("audio", part, self.costs.audio(part.get("seconds")))

    def visit_document(self, part: dict) -> None:
        self.attach("document", part, self.costs.document(part.get("pages")))

    def visit_other(self, part: dict) -> None:
        self.attach("other", part, 1)


_ATTACHMENT = pa.struct([("ordinal", pa.int32()), ("kind", pa.string()), ("type", pa.string()), ("ref", pa.string()), ("start", pa.int64()), ("n_tokens", pa.int64())])
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_PIECE = [("seq", pa.int64()), ("start", pa.int64()), ("piece", pa.string()), ("loss", pa.list_(_SPAN)), ("attachments", pa.list_(_ATTACHMENT)), ("n_tokens", pa.int64())]
_PIECE_DDL = ("seq long, start long, piece string, loss array<struct<start:long,end:long>>, attachments "
              "array<struct<ordinal:int,kind:string,type:string,ref:string,start:long,n_tokens:long>>, n_tokens long")
#: Bytes of text in a batch of pieces.
BATCH_BYTES = 4 << 20


def clustered(pieces: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Pieces that were stored, with each conversation in one partition and in order again."""
    return pieces.repartition(F.col(conv_col)).sortWithinPartitions(conv_col, "seq")


def formatted(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
              content_col: str = "text", costs: Costs | None = None) -> DataFrame:
    """(conversation id, seq, start, piece, loss, attachments, n_tokens) of every turn; each conversation is in
    one partition and in order. ``content_col`` holds texts, or arrays of ``PART``."""
    prepare(turns.sparkSession)
    costs = costs or Costs()
    content = F.col(content_col)
    typed = not dict(turns.dtypes)[content_col] == "string"
    if typed:
        content = content.cast(f"array<{PART}>")
    slim = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), content.alias("content"))
    tie = F.to_json("content") if typed else F.col("content")
    ordered = slim.repartition("conv").sortWithinPartitions("conv", "turn", "role", tie)
    kind = dict(slim.dtypes)["conv"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seq, at, ordinal = object(), 0, 0, 0
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for conv, role, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv != now:
                    now, seq, at, ordinal = conv, 0, 0, 0
                v = Flattener(costs, at, ordinal)
                v.raw(f"{START}{escape_role(role)}\n")
                for part in content or [] if typed else [{"type": "text", "text": content}]:
                    v.visit(part)
                v.close_text()
                v.raw(f"{END}\n")
                loss = [{"start": a, "end": b} for a, b in v.texts] if role == LOSS_ROLE else []
                rows.append((conv, seq, at, "".join(v.written), loss, v.attachments, sum(x["n_tokens"] for x in v.attachments)))
                seq, at, ordinal = seq + 1, v.at, v.ordinal
                size += len(rows[-1][3])
                if size > BATCH_BYTES:
                    yield _piece_batch(rows, batch.schema.field(0).type)
                    rows, size = [], 0
            if rows:
                yield _piece_batch(rows, batch.schema.field(0).type)

    out = ordered.select("conv", "role", "content").mapInArrow(write, f"conv {kind}, {_PIECE_DDL}")
    return out.withColumnRenamed("conv", conv_col)


def _piece_batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = [("conv", kind), *_PIECE]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], names=[n for n, _ in kinds])


def expand(piece: str, n_tokens: list[int]) -> str:
    """A text with every placeholder as often as it has tokens."""
    left = iter(n_tokens)
    return _CONTROL.sub(lambda m: m[0] * next(left) if m[1] in KINDS else m[0], piece)


class Reader:
    """Reads turns back from a conversation's text, fed in parts of any length."""

    def __init__(self) -> None:
        self.rest = ""

    def feed(self, text: str) -> Iterator[tuple[str, list[tuple[str, str]]]]:
        """(role, [("text", text) or (kind, placeholder)]) of each turn that is complete."""
        self.rest += text
        while True:
            end = self.rest.find(f"{END}\n")
            if end < 0:
                return
            turn, self.rest = self.rest[:end], self.rest[end + len(END) + 1:]
            if not turn.startswith(START):
                raise ValueError("a turn begins with its control string")
            role, _, body = turn[len(START):].partition("\n")
            parts, at = [], 0
            for m in _CONTROL.finditer(body):
                if m.start() > at:
                    parts.append(("text", unescape(body[at:m.start()])))
                parts.append((m[1], m[0]))
                at = m.end()
            if at < len(body):
                parts.append(("text", unescape(body[at:])))
            yield unescape_role(role), parts


def digests(pieces: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Per conversation, read back from the formatted pieces (as ``formatted`` or ``clustered`` give
    them): n_turns, turns_sha256 (role, \\n, text, \\n of each turn; texts without placeholders), loss_chars,
    loss_sha256, formatted_chars, n_attachments, n_tokens."""
    slim = pieces.select(F.col(conv_col).alias("conv"), "start", "piece", "loss", F.size("attachments").alias("k"), "n_tokens")
    kind = dict(slim.dtypes)["conv"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, id_kind = object(), None, None
        done: list[tuple] = []
        for batch in batches:
            id_kind = batch.schema.field(0).type
            for conv, start, piece, loss, k, n_tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own is None or conv != now:
                    done += [own.row(now)] if own else []
                    now, own = conv, _Digest()
                own.take(start, piece, loss, k, n_tokens)
            if len(done) > 2000:
                yield _digest_batch(done, id_kind)
                done = []
        if own:
            yield _digest_batch([*done, own.row(now)], id_kind)

    out = slim.mapInArrow(read, f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                                "formatted_chars long, n_attachments long, n_tokens long")
    return out.withColumnRenamed("conv", conv_col)


class _Digest:
    def __init__(self) -> None:
        self.reader, self.turns, self.loss = Reader(), sha256(), sha256()
        self.n_turns = self.loss_chars = self.chars = self.k = self.tokens = 0

    def take(self, start: int, piece: str, loss: list[dict], k: int, n_tokens: int) -> None:
        self.chars += len(piece)
        self.k, self.tokens = self.k + k, self.tokens + n_tokens
        for role, parts in self.reader.feed(piece):
            self.n_turns += 1
            text = "".join(t for kind, t in parts if kind == "text")
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "replace"))
        for span in loss:
            text = unescape(piece[span["start"] - start: span["end"] - start])
            self.loss_chars += len(text)
            self.loss.update(text.encode("utf-8", "replace"))

    def row(self, conv: object) -> tuple:
        return (conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.k, self.tokens)


def _digest_batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
    names = ("conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_attachments", "n_tokens")
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=list(names))

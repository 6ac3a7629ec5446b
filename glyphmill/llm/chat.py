r"""Chat formatting with typed content parts.

A message's parts (text, image, audio, document) are flattened by a visitor: text is escaped, everything else becomes a
numbered placeholder, with its reference and the tokens it will expand to recorded beside. A formatted turn is

    <|turn|>ROLE NEWLINE CONTENT <|end|> NEWLINE

and a conversation is its turns one after another. Control strings inside roles and texts are broken by a backslash after
their first character, and backslashes are doubled, so formatting is reversible (`parse_turn`). The loss mask of a turn is
the span of each text part of an assistant.

Each turn is a row, so no conversation is gathered to be formatted. `conversation_digests` streams turns sorted by
conversation and turn; it holds one turn at a time, however many a conversation has.

Parts come as a JSON list; one part needn't be in a list, and a string is a text. A part of another type, or whatever else is no
part, is an attachment of type unknown, whose place is kept. What isn't JSON is a text. Sizes that are no finite positive numbers are 0, and
an attachment has at least one token.

Null texts and roles are empty; rows of equal turn are ordered by role, then text; repeated rows are turns of their own. A
null conversation id is a conversation of its own.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>"
#: Strings with a meaning in this or other common templates, and the escape itself.
_CONTROL = re.compile(r"\\|<\||</?s>|\[/?INST\]")
_ESCAPED = re.compile(r"\\(.)", re.S)
_PLACEHOLDER = re.compile(r"<\|(?:image|audio|document|unknown):\d+\|>")
_TOKENS = 2**31 - 1
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 768


def escape(s: str) -> str:
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], s)


def unescape(s: str) -> str:
    return _ESCAPED.sub(r"\1", s)


def size(x: object) -> float:
    """A size as JSON gave it; 0 for what is no finite positive number."""
    try:
        found = float(x)
    except (TypeError, ValueError, OverflowError):
        return 0.0
    return found if 0 < found < math.inf else 0.0


def plain(x: object) -> str:
    """x as text; half a surrogate pair, which JSON may hold, is a question mark."""
    return str(x).encode("utf-8", "replace").decode()


def typed_parts(given: str) -> list:
    try:
        parts = json.loads(given)
    except (ValueError, RecursionError):
        return [given]
    return parts if isinstance(parts, list) else [parts]


@dataclass
class Flattener:
    """Visits a message's parts in order."""

    out: list[str] = field(default_factory=list)
    length: int = 0
    texts: list[tuple[int, int]] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def put(self, s: str) -> None:
        self.out.append(s)
        self.length += len(s)

    def visit(self, part: object) -> None:
        part = {"text": part} if isinstance(part, str) else part if isinstance(part, dict) else {"type": "unknown"}
        getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_unknown)(part)

    def visit_text(self, part: dict) -> None:
        at = self.length
        text = part.get("text")
        self.put(escape("" if text is None else plain(text)))
        self.texts.append((at, self.length))

    def visit_image(self, part: dict) -> None:
        self.attach("image", part, math.ceil(size(part.get("width")) / PATCH) * math.ceil(size(part.get("height")) / PATCH))

    def visit_audio(self, part: dict) -> None:
        self.attach("audio", part, math.ceil(min(size(part.get("seconds")), _TOKENS) * AUDIO_RATE))

    def visit_document(self, part: dict) -> None:
        self.attach("document", part, int(size(part.get("pages"))) * PAGE_TOKENS)

    def visit_unknown(self, part: dict) -> None:
        self.attach("unknown", part, 0)

    def attach(self, kind: str, part: dict, tokens: int) -> None:
        n = len(self.attachments)
        self.attachments.append({"ordinal": n, "type": kind, "ref": None if part.get("ref") is None else plain(part["ref"]), "tokens": min(max(1, tokens), _TOKENS), "at": self.length})
        self.put(f"<|{kind}:{n}|>")


def format_turn(role: str | None, parts: list) -> tuple[str, list[tuple[int, int]], list[dict]]:
    """The formatted turn, its loss spans in code points, and its attachments."""
    head = f"{TURN}{escape(role or '').replace(chr(10), chr(92) + chr(10))}\n"
    f = Flattener()
    for p in parts:
        f.visit(p)
    loss = [(a + len(head), b + len(head)) for a, b in f.texts] if role == "assistant" else []
    return f"{head}{''.join(f.out)}{END}\n", loss, [{**x, "at": x["at"] + len(head)} for x in f.attachments]


_HEAD = re.compile(re.escape(TURN) + r"((?:[^\\\n]|\\.)*)\n", re.S)


def parse_turn(formatted: str) -> tuple[str, str]:
    """The role, and the text with placeholders left out."""
    m = _HEAD.match(formatted)
    return unescape(m[1]), unescape(_PLACEHOLDER.sub("", formatted[m.end() : -len(END) - 1]))


_OUT = pa.schema([("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("attachments", pa.list_(pa.struct([("ordinal", pa.int32()), ("type", pa.string()), ("ref", pa.string()), ("tokens", pa.int64()), ("at", pa.int32())])))])
_OUT_DDL = "formatted string, loss array<struct<start:int,end:int>>, attachments array<struct<ordinal:int,type:string,ref:string,tokens:bigint,at:int>>"


def format_chat(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", parts_col: str | None = None) -> DataFrame:
    """Per row: conv, turn, role, formatted, loss, attachments. parts_col: JSON of typed parts, used where it's given and not null."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles, texts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            parts = batch.column(4).to_pylist()
            rows = [format_turn(r, typed_parts(p) if p is not None else [{"type": "text", "text": t}]) for r, t, p in zip(roles, texts, parts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array([x[0] for x in rows], pa.string()), pa.array([[{"start": a, "end": b} for a, b in x[1]] for x in rows], _OUT.field("loss").type), pa.array([x[2] for x in rows], _OUT.field("attachments").type)],
                names=["conv", "turn", "role", *_OUT.names],
            )

    kind = {c: turns.schema[c].dataType.simpleString() for c in (conv_col, turn_col)}
    source = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"), (F.col(parts_col).cast("string") if parts_col else F.lit(None).cast("string")).alias("parts"))
    return source.mapInArrow(kernel, f"conv {kind[conv_col]}, turn {kind[turn_col]}, role string, {_OUT_DDL}")


def conversation_digests(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Read formatted turns back: conv_col, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        now, state = None, None

        def closed() -> pa.RecordBatch:
            n, turns, chars, loss, size = state
            return pa.RecordBatch.from_arrays([pa.array([now], schema), pa.array([n], pa.int64()), pa.array([turns.hexdigest()]), pa.array([chars], pa.int64()), pa.array([loss.hexdigest()]), pa.array([size], pa.int64())], names=["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            schema = batch.schema.field(0).type
            done = []
            for conv, text, loss in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if state is None or conv != now:
                    if state is not None:
                        done.append(closed())
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, plain = parse_turn(text)
                state[0] += 1
                state[1].update(f"{role}\n{plain}\n".encode("utf-8", "surrogatepass"))
                state[4] += len(text)
                for span in loss:
                    own = unescape(text[span["start"] : span["end"]])
                    state[2] += len(own)
                    state[3].update(own.encode("utf-8", "surrogatepass"))
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        if state is not None:
            yield closed()

    kind = formatted.schema["conv"].dataType.simpleString()
    # the formatted turn sorts rows of equal turn by role and text
    ordered = formatted.select("conv", "formatted", "loss", "turn").repartition("conv").sortWithinPartitions("conv", "turn", "formatted")
    out = ordered.mapInArrow(kernel, f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return out.withColumnRenamed("conv", conv_col)

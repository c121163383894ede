"""Chat formatting (5): typed content parts, a reversible template, and a loss mask.

A visitor flattens the parts of a turn (text, image, audio, document) into text in which every attachment is a placeholder
with its number in the turn; it records the reference of each attachment and how many tokens it expands to. The template
writes a turn as

    ### role: text</turn>

and a backslash before each control string that a text or role holds, and before each backslash, so that formatting can be
undone. The text of assistant turns is under the loss mask, as code-point spans of the formatted turn.

Each turn is formatted on its own, where it is; a conversation is put together by a sort within partitions and read as a
stream, so that one of any length needs no more memory than one batch of turns.

Defined cases: null texts and parts are empty; a null role is an empty one; a null turn comes first, and turns of equal
numbers are in the order of role and text; repeated rows are turns each; rows of a null conversation are one conversation; an
empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .plan import stored

OPEN, CLOSE, HOLDER = "###", "</turn>", "<|"
_CONTROL = re.compile(r"\\|###|</turn>|<\|")
_ROLE_CONTROL = re.compile(r"\\|###|</turn>|<\||:")
_TOKEN = re.compile(r"\\(?:\\|###|</turn>|<\||:)|###|</turn>|<\||:")
_ESCAPED = r"\\(\\|###|</turn>|<\||:)"
_PART = "type: string, text: string, uri: string, width: int, height: int, seconds: double, pages: int"
PART = "struct<" + _PART.replace(": ", ":") + ">"
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 512


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    return re.sub(_ESCAPED, r"\1", text)


@dataclass
class Flattened:
    """What the visitor makes of a turn: escaped text with placeholders, and its attachments (kind, uri, tokens)."""

    pieces: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def visit(self, part: dict | None) -> None:
        if part:
            getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_unknown)(part)

    def visit_text(self, part: dict) -> None:
        self.pieces.append(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        self.attach("image", part, math.ceil((part.get("width") or PATCH) / PATCH) * math.ceil((part.get("height") or PATCH) / PATCH))

    def visit_audio(self, part: dict) -> None:
        self.attach("audio", part, max(1, math.ceil((part.get("seconds") or 0) * AUDIO_RATE)))

    def visit_document(self, part: dict) -> None:
        self.attach("document", part, max(1, part.get("pages") or 1) * PAGE_TOKENS)

    def visit_unknown(self, part: dict) -> None:
        raise ValueError(f"unknown part {part.get('type')!r}")

    def attach(self, kind: str, part: dict, tokens: int) -> None:
        self.pieces.append(f"{HOLDER}{kind}:{len(self.attachments)}|>")
        self.attachments.append({"kind": kind, "uri": part.get("uri"), "tokens": tokens})


def format_turn(role: str, parts: list[dict | None]) -> tuple[str, int, int, list[dict]]:
    """The formatted turn, the code-point span of its content, and its attachments."""
    flat = Flattened()
    for part in parts:
        flat.visit(part)
    head = f"{OPEN} {_ROLE_CONTROL.sub(lambda m: chr(92) + m.group(), role)}: "
    body = "".join(flat.pieces)
    return head + body + CLOSE + "\n", len(head), len(head) + len(body), flat.attachments


def parse_turns(text: str) -> list[tuple[str, str, int, int]]:
    """Reads formatted turns back: role, content as formatted, and the content's span."""
    out, at = [], 0
    while at < len(text):
        if not text.startswith(OPEN + " ", at):
            raise ValueError(f"no turn begins at {at}")
        head = next(m for m in _TOKEN.finditer(text, at + len(OPEN)) if m.group() == ":")
        begin = head.end() + 1
        end = next(m for m in _TOKEN.finditer(text, begin) if m.group() == CLOSE)
        out.append((unescape(text[at + len(OPEN) + 1 : head.start()]), text[begin : end.start()], begin, end.start()))
        at = end.end() + 1
    return out


def text_parts(text: Column) -> Column:
    """A column of parts that holds a plain text."""
    null = lambda t: F.lit(None).cast(t)
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), null("string").alias("uri"), null("int").alias("width"), null("int").alias("height"), null("double").alias("seconds"), null("int").alias("pages")))


def formatted(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", parts: Column | None = None) -> DataFrame:
    """One formatted row for each turn: conv, turn, role, formatted, span of the content, mask spans, attachments and expanded tokens, ready to be put in order."""
    content = parts if parts is not None else text_parts(F.col("text"))
    flat = rows.select(F.col(conversation).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), content.alias("parts"))
    attachment = pa.list_(pa.struct([("kind", pa.string()), ("uri", pa.string()), ("tokens", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                done, masks, files, edges = [], [], [], []
                for role_, parts_ in zip(part.column("role").to_pylist(), part.column("parts").to_pylist()):
                    text, begin, end, found = format_turn(role_, parts_ or [])
                    done.append(text)
                    masks.append([{"start": begin, "end": end}] if role_ == "assistant" else [])
                    files.append(found)
                    edges.append((begin, end))
                mask = pa.array(masks, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
                tokens = pa.array([sum(x["tokens"] for x in f) for f in files], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("conv"), part.column("turn"), part.column("role"), pa.array(done), *(pa.array(x, pa.int32()) for x in zip(*edges)), mask, pa.array(files, attachment), tokens],
                    ["conv", "turn", "role", "formatted", "begin", "end", "mask", "attachments", "attachment_tokens"],
                )

    kinds = dict(rows.dtypes)
    return flat.mapInArrow(run, f"conv {kinds[conversation]}, turn {kinds[turn]}, role string, formatted string, begin int, end int, mask array<struct<start:bigint,end:bigint>>, attachments array<struct<kind:string,uri:string,tokens:bigint>>, attachment_tokens long")


def read_back(turns: DataFrame, on: str = "conv_id") -> DataFrame:
    """Undoes the formatting of all conversations: number of turns, digests of turns and of masked text, and lengths."""
    kind = dict(turns.dtypes)["conv"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [()] * 6
            arrays = [pa.array(columns[0], arrow_kind)] + [pa.array(c, t) for c, t in zip(columns[1:], (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, ["conv", "n", "turns", "loss", "loss_sha", "chars"])

        def close() -> None:
            if now:
                out.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]))

        arrow_kind = pa.int64()
        for batch in batches:
            arrow_kind = batch.column("conv").type
            for conv, text, mask in zip(*(batch.column(c).to_pylist() for c in ("conv", "formatted", "mask"))):
                if not now or now[0] != conv:
                    close()
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, body, _, _ in parse_turns(text):
                    now[1] += 1
                    now[2].update(f"{role}\n{unescape(body)}\n".encode())
                for m in mask:
                    own = unescape(text[m["start"] : m["end"]])
                    now[3] += len(own)
                    now[4].update(own.encode())
                now[5] += len(text)
            if len(out) >= 1000:
                yield flush()
        close()
        if out:
            yield flush()

    # by turn, role and text: ties are settled by what is said, not by how it is escaped
    body = F.substring(F.col("formatted"), F.col("begin") + 1, F.col("end") - F.col("begin"))
    content = F.regexp_replace(body, _ESCAPED, "$1")
    order = [F.col("conv"), F.col("turn"), F.col("role"), content]
    near = turns.repartition("conv").sortWithinPartitions(*[c.asc_nulls_first() for c in order]).select("conv", "formatted", "mask")
    found = near.mapInArrow(run, f"conv {kind}, n long, turns string, loss long, loss_sha string, chars long")
    return found.select(
        F.col("conv").alias(on), F.col("n").alias("n_turns"), F.col("turns").alias("turns_sha256"), F.col("loss").alias("loss_chars"),
        F.col("loss_sha").alias("loss_sha256"), F.col("chars").alias("formatted_chars"),
    )


def format_and_read(rows: DataFrame, **columns) -> DataFrame:
    """Writes all turns formatted, and reads them back."""
    return read_back(stored(formatted(rows, **columns), "chat"))


def brute_force(rows: list[tuple]) -> list[tuple]:
    """What the query must give but for formatted_chars, from rows of (conv, turn, role, text), for tests."""
    out = []
    for conv in dict.fromkeys(r[0] for r in rows):
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        out.append((conv, len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return out

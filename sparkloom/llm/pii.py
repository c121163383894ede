"""PII (1): personal data in whole texts, plain and disguised, as spans of the original.

Plain identifiers are found by patterns on the text itself. Disguised ones are found by a cascade of transducers, each of
which rewrites some substrings and carries, for every character that it writes, the source characters it stands for:

1. homoglyphs: full-width, mathematical and foreign digits and letters become ASCII, invisible characters disappear;
2. spelled digits: runs with at least three digit words (English, French, German, Spanish), or with fewer if the run is an
   identifier as a whole, become digits, "plus" a sign;
3. at and dot disguises: "(at)", "[dot]", " dot ", "arroba", spaced signs; a bare "at" only before a domain whose dots
   are disguised, as it is a common word.

The same patterns run on the outcome; spans that hold a rewritten character are mapped back and added, unless a plain span of
their kind overlaps. A text in which no transducer finds anything to rewrite can hold no disguised identifier, so only
others are transduced, and always whole.

Defined cases: null and empty texts hold nothing; very long texts, runs of digits and of letters take time in proportion to
their length; repeated rows are searched each alike; an empty table gives an empty
result; all columns are passed on, and the findings are one array of a free name.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as K

KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TWICE = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        total += _TWICE[ord(c) - 48] if i % 2 else ord(c) - 48
    return total % 10 == 0


#: the parts of an e-mail address to either side of its sign, from the sign on; a sign can be looked for much faster than a word
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The matches of EMAIL, found from the signs: a search from every letter is quadratic in runs of letters without a sign."""
    at = done = 0
    while (at := text.find("@", at)) >= 0:
        m = _DOMAIN.match(text, at + 1)
        start = at
        if m:
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                yield start, m.end()
                done = at = m.end()
                continue
        at += 1


def _addresses(text: str) -> Iterator[tuple[int, int, list[str]]]:
    """The matches of IP: of a run of numbers and dots, every four numbers in a row."""
    for m in _NUMBERS.finditer(text):
        if m.end() - m.start() >= 7 and (parts := m.group().split("."))[3:]:
            begin = m.start()
            for k in range(0, len(parts) - 3, 4):
                four = parts[k : k + 4]
                end = begin + sum(map(len, four)) + 3
                yield begin, end, four
                begin = end + 1


def _byte(x: str) -> bool:
    x = x.lstrip("0")
    return len(x) < 3 or (len(x) == 3 and x <= "255")


def plain(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the plain identifiers, leftmost and without overlap in each kind; linear in the text."""
    out = []
    if "@" in text:
        out += [(a, b, 0) for a, b in _emails(text)]
    for a, b, parts in _addresses(text):
        if all(map(_byte, parts)):
            out.append((a, b, 1))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda x: (x[0], x[2]))


# --- transducers -----------------------------------------------------------------------------------------------------


def _homoglyphs() -> dict[str, str]:
    found = {}
    for lo, hi in ((0xFF01, 0xFF5F), (0x1D400, 0x1D800), (0x2460, 0x2474), (0x24B6, 0x24EA), (0x2070, 0x208A), (0x2776, 0x2780)):
        for c in map(chr, range(lo, hi)):
            plain_ = unicodedata.normalize("NFKC", c)
            if len(plain_) == 1 and plain_.isascii():
                found[c] = plain_
    for c in map(chr, range(0x660, 0x1E960)):
        if unicodedata.category(c) == "Nd":
            found[c] = str(unicodedata.digit(c))
    found |= {chr(0x2775 + i): str(i) for i in range(1, 10)} | {"⓪": "0", "⓿": "0", "¹": "1", "²": "2", "³": "3"}
    pairs = "аaеeоoрpсcуyхxіiѕsјjһhԁdԛqԝwАAВBЕEКKМMНHОOРPСCТTХXУYІIЅSЈJ" + "αaοoρpνvιiκkυuΑAΒBΕEΖZΗHΙIΚKΜMΝNΟOΡPΤTΥYΧX" + "ɑaɡgıiⅼlⅰiⅴvⅹxⅽcⅾdⅿmոnսuօoһhցgӏlｏo"
    found |= dict(zip(pairs[::2], pairs[1::2]))
    found |= {c: "." for c in "。．․｡·•∙⋅・"} | {c: "@" for c in "﹫＠"}
    found |= {c: "-" for c in "‐‑‒–—―−­﹣－⁃"} | {c: "+" for c in "＋﹢➕⁺"}
    found |= {c: " " for c in "              　"} | {c: "_" for c in "＿"}
    return found


HOMOGLYPHS = _homoglyphs()
INVISIBLE = "​‌‍⁠﻿­‎‏᠎"
HOMOGLYPHS |= dict.fromkeys(INVISIBLE, "")
_GLYPH = re.compile("[" + "".join(map(re.escape, HOMOGLYPHS)) + "]")
_TRIGGERS = frozenset(HOMOGLYPHS)
#: lead bytes of characters that Latin prose hasn't
_FOREIGN = np.array([b == 0xC2 or b >= 0xC4 for b in range(256)])

DIGITS = {
    w: str(d)
    for d, words in enumerate((
        "zero oh zéro null cero", "one un une eins ein uno una", "two deux zwei zwo dos", "three trois drei tres", "four quatre vier cuatro",
        "five cinq fünf fuenf cinco", "six sechs seis", "seven sept sieben siete", "eight huit acht ocho", "nine neuf neun nueve",
    ))
    for w in words.split()
}
_DIGIT = "(?:" + "|".join(sorted(DIGITS, key=len, reverse=True)) + ")"
_DOT_WORD, _AT_WORD = r"(?:dot|d0t|punto|punkt|point)", r"(?:at|arroba)"
#: repetitions of blanks give nothing back, and runs of them are entered at their beginning only, so that long ones take linear time
_GAP = r"(?:[\x20\t]++[,/)(-]?[\x20\t(]*+|[,/()-][\x20\t(]*+)"
_BETWEEN = rf"(?:[\x20\t]++{_DOT_WORD}[\x20\t]++|{_GAP})"
_LEAD = r"(?:(?<![\x20\t])[\x20\t]++)?+"
_RUN = re.compile(rf"(?i)(?<![^\W_])(?:plus{_GAP}|\+[\x20\t(]*)?(?:{_DIGIT}|[0-9]+)(?:{_BETWEEN}(?:(?:double|triple){_GAP})?(?:{_DIGIT}|[0-9]+)(?![^\W_]))+")
#: two neighbours of a run of which one is spelled: every run with a spelled digit has such
_RUN_TRIGGER = re.compile(rf"(?i)(?<![^\W_])(?:{_DIGIT}{_BETWEEN}(?:(?:double|triple){_GAP})?(?:{_DIGIT}|[0-9]+)|[0-9]+{_BETWEEN}(?:(?:double|triple){_GAP})?{_DIGIT})(?![^\W_])")
_WORD = re.compile(rf"(?i)plus|\+|double|triple|{_DOT_WORD}|{_DIGIT}|[0-9]+")
_DOTS = frozenset("dot d0t punto punkt point".split())

_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
_DOT = re.compile(
    rf"(?i){_LEAD}{_OPEN}[\x20\t]*+(?:{_DOT_WORD}|\.)[\x20\t]*+{_CLOSE}[\x20\t]*+|(?<=[A-Za-z0-9])[\x20\t]++{_DOT_WORD}[\x20\t]++(?=[A-Za-z0-9])|(?<=[A-Za-z0-9])_{_DOT_WORD}_(?=[A-Za-z0-9])"
    r"|(?<=[0-9])[\x20\t]++\.[\x20\t]++(?=[0-9])|(?<=[A-Za-z0-9])[\x20\t]++\.[\x20\t]++(?=[a-z])"
)
_AT = re.compile(
    rf"(?i){_LEAD}{_OPEN}[\x20\t]*+(?:{_AT_WORD}|@)[\x20\t]*+{_CLOSE}[\x20\t]*+|(?<=[A-Za-z0-9])[\x20\t]++arroba[\x20\t]++(?=[A-Za-z0-9])|(?<=[A-Za-z0-9])_(?:at|arroba)_(?=[A-Za-z0-9])"
    r"|(?<=[A-Za-z0-9])[\x20\t]*+@[\x20\t]*+(?=[A-Za-z0-9])"
)
_BARE_AT = re.compile(r"(?i)(?<=[A-Za-z0-9])[\x20\t]++at[\x20\t]++(?=([A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+))")
#: in every match of _DOT, and in every one of _AT that isn't just a sign; _BARE_AT needs a dot that was rewritten
_SIGN_TRIGGER = re.compile(rf"(?i){_OPEN}[\x20\t]*+(?:{_DOT_WORD}|{_AT_WORD}|\.|@)[\x20\t]*+{_CLOSE}|[\x20\t_](?:{_DOT_WORD}|arroba)[\x20\t_]|_at_|[\x20\t]@|@[\x20\t]|[\x20\t]\.[\x20\t]")


class Tape:
    """A text in which each character knows the source characters it stands for, and whether it was rewritten."""

    def __init__(self, text: str):
        self.text = text
        self.start = np.arange(len(text))
        self.end = self.start + 1
        self.new = np.zeros(len(text), bool)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces [a, b) by a string, for edits in order."""
        edits = [e for e in edits if self.text[e[0] : e[1]] != e[2]]
        if not edits:
            return
        out, start, end, new, at = [], [], [], [], 0
        for a, b, s in [*edits, (len(self.text), len(self.text), "")]:
            out.append(self.text[at:a])
            for to, own in ((start, self.start), (end, self.end), (new, self.new)):
                to.append(own[at:a])
            if s:
                out.append(s)
                start.append(np.full(len(s), self.start[a]))
                end.append(np.full(len(s), self.end[b - 1]))
                new.append(np.ones(len(s), bool))
            at = b
        self.text = "".join(out)
        self.start, self.end, self.new = np.concatenate(start), np.concatenate(end), np.concatenate(new)


def _spelled(m: re.Match) -> str | None:
    found, spelled, times, out = _WORD.findall(m.group()), 0, 1, []
    for w in found:
        w = w.lower()
        if w in ("plus", "+"):
            out.append("+")
        elif w in _DOTS:
            out.append(".")
        elif w in ("double", "triple"):
            times = 2 if w == "double" else 3
        else:
            spelled += w in DIGITS
            out.append(DIGITS.get(w, w) * times)
            times = 1
    if spelled >= 3:
        return "".join(out)
    # fewer are a disguise if the run as a whole is an identifier and has none without them
    whole = "".join(out)
    return whole if spelled and any(b - a == len(whole) for a, b, _ in plain(whole)) and not plain(_DOT.sub(".", m.group())) else None


def transduce(text: str) -> Tape:
    tape = Tape(text)
    tape.rewrite([(m.start(), m.end(), HOMOGLYPHS[m.group()]) for m in _GLYPH.finditer(tape.text)])
    tape.rewrite([(m.start(), m.end(), s) for m in _RUN.finditer(tape.text) if (s := _spelled(m)) is not None])
    tape.rewrite([(m.start(), m.end(), ".") for m in _DOT.finditer(tape.text)])
    tape.rewrite([(m.start(), m.end(), "@") for m in _AT.finditer(tape.text)])
    edits = []
    for m in _BARE_AT.finditer(tape.text):
        a, b = m.span(1)
        if any(tape.text[i] == "." and tape.new[i] for i in range(a, b)):
            edits.append((m.start(), m.end(), "@"))
    tape.rewrite(edits)
    return tape


def find(text: str, foreign: bool = True) -> list[tuple[int, int, int, bool]]:
    """(start, end, kind number, plain) of all identifiers, by start and then kind; foreign: it may have homoglyphs."""
    base = plain(text)
    out = [(*x, True) for x in base]
    if (foreign and not _TRIGGERS.isdisjoint(set(text))) or _SIGN_TRIGGER.search(text) or _RUN_TRIGGER.search(text):
        tape = transduce(text)
        if tape.new.any() or len(tape.text) != len(text):
            moved = np.concatenate([[0], np.cumsum(tape.new)])
            for a, b, kind in plain(tape.text):
                start, end = int(tape.start[a]), int(tape.end[b - 1])
                if (moved[b] > moved[a] or end - start != b - a) and not any(k == kind and s < end and start < e for s, e, k in base):
                    out.append((start, end, kind, False))
    return sorted(out, key=lambda x: (x[0], x[2], x[1]))


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("plain", T.BooleanType())])


def detect(docs: DataFrame, text: str = "text", name: str = "spans") -> DataFrame:
    """The rows with an array of (kind, start, end, plain) appended; code points, end exclusive."""
    if name in docs.columns:
        raise ValueError(f"the input has a column {name!r}")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(SPAN))])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("plain", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in K.pieces(batches, text):
            raw, offsets = K.text_bytes(piece.column(text))
            foreign = K.sums_by_row(_FOREIGN[raw], offsets) > 0
            found = [[{"kind": KINDS[k], "start": a, "end": b, "plain": p} for a, b, k, p in find(t or "", f)] for t, f in zip(piece.column(text).to_pylist(), foreign.tolist())]
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(found, kind)], [*piece.schema.names, name])

    return docs.mapInArrow(run, schema)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with every span of the text replaced by its kind in angle brackets (of overlapping ones by the first's)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in K.pieces(batches, text):
            out = []
            for t in piece.column(text).to_pylist():
                at, parts = 0, []
                for a, b, k, _ in find(t or ""):
                    if a >= at:
                        parts += [t[at:a], f"<{KINDS[k]}>"]
                    at = max(at, b)
                out.append(t if t is None else "".join([*parts, t[at:]]))
            columns = [pa.array(out, c.type) if n == text else c for c, n in zip(piece.columns, piece.schema.names)]
            yield pa.RecordBatch.from_arrays(columns, piece.schema.names)

    return docs.mapInArrow(run, docs.schema)


def report(found: DataFrame, on: str = "doc_id", name: str = "spans") -> DataFrame:
    """Counts and digest of the plain spans, the list of all, and how many the transducers added."""
    show = lambda s: F.concat_ws(",", F.transform(s, lambda x: F.concat_ws(":", x.kind, x.start, x["end"])))
    s = F.col(name)
    base = F.filter(s, lambda x: x.plain)
    of_kind = lambda k: F.filter(base, lambda x: x.kind == k)
    return found.select(
        on, *[F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(show(base), 256).alias("base_sha256"), show(s).alias("spans"), (F.size(s) - F.size(base)).cast("long").alias("n_added"),
    )

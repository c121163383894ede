"""Sentence tokenisation: typed spans, unigram segmentation by Viterbi, and joining of split tokens.

Segmentation has no form as an expression, so it runs in Arrow batches; a vocabulary is broadcast while it is under `MOST_PIECES`
pieces, which real ones are by far.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql.functions import pandas_udf

from .text import ALNUM, DIGIT_PREFIX, HAN, MASK, UNIT

MOST_PIECES = 2_000_000
_ZH, _ZH_TENS = "十九八七六五四三两二一零〇", "亿万千百十"
_NUMBER = r"(?:\d*(?:\.\d+)+|\d+(?:,\d+)+|\d+(?:-\d+)+|\d+)[‰%]*"
_ZH_NUMBER = f"(?:(?:[{_ZH}][{_ZH_TENS}])+[{_ZH}]?|[{_ZH}]+)"
_ZH_UNIT = f"{DIGIT_PREFIX}?{_ZH_NUMBER}{UNIT}"
_NON_WORD = f"[^{HAN}〇{ALNUM}\\-.%‰{MASK}]+|\\.(?!\\d)|-(?![a-zA-Z0-9])"
SPAN = re.compile(rf"(?P<dashed>[a-z0-9]+(?:-[a-z0-9]+)+{UNIT}?)|(?P<number>(?:{DIGIT_PREFIX}\s*)?{_NUMBER}\s*{UNIT})|(?P<zh_number>{_ZH_UNIT})|(?P<non_word>{_NON_WORD})")
_LETTER_SPACE = re.compile(r"(?<=[a-zA-Z])\s+(?=[a-zA-Z0-9])")
_HAN_CHAR = re.compile(f"[{HAN}]")
_NON_WORDS = re.compile(_NON_WORD)


def typed_spans(sentence: str) -> list[tuple[str, str]]:
    """The sentence in parts (text, kind); what lies between matches is "str"."""
    sentence, at, out = _LETTER_SPACE.sub(MASK, sentence), 0, []
    for m in SPAN.finditer(sentence):
        if m.start() > at:
            out.append((sentence[at : m.start()], "str"))
        out.append((m.group(), m.lastgroup))
        at = m.end()
    if at < len(sentence):
        out.append((sentence[at:], "str"))
    return out


@dataclass
class Unigram:
    """Segmentation into the pieces with the greatest sum of scores; unknown characters stand alone at a penalty."""

    scores: dict[str, float]
    penalty: float = 10.0

    def __post_init__(self) -> None:
        self.longest = max(map(len, self.scores), default=1)
        self.unknown = min(self.scores.values(), default=0.0) - self.penalty

    def best(self, text: str, most: int = 1) -> list[list[str]]:
        """The `most` best segmentations."""
        states: list[list[tuple[float, int, int, str]]] = [[(0.0, -1, -1, "")]]
        for end in range(1, len(text) + 1):
            found = []
            for start in range(max(0, end - self.longest), end):
                piece = text[start:end]
                score = self.scores.get(piece, self.unknown if end - start == 1 else None)
                if score is not None:
                    found += [(s[0] + score, start, k, piece) for k, s in enumerate(states[start])]
            states.append(sorted(found, key=lambda s: -s[0])[:most])
        out = []
        for k in range(len(states[-1])):
            at, row, pieces = len(text), k, []
            while at > 0:
                _, start, back, piece = states[at][row]
                pieces.append(piece)
                at, row = start, back
            out.append(pieces[::-1])
        return out

    def tokenize(self, text: str) -> list[str]:
        return self.best(text)[0] if text else []

    def tokenize_short(self, text: str, most: int, level: int = 0, deepest: int = 5, combine: bool = False) -> list[str]:
        """Pieces of at most `most` Han characters: longer ones are split by their second-best segmentation, some levels deep."""
        if not text:
            return []
        tokens = self.tokenize(text) if level == 0 else self.best(text, 2)[-1]
        if level and (len(tokens) == 1 or level >= deepest):
            return tokens
        out = []
        for t in tokens:
            out += [t] if len(_HAN_CHAR.findall(t)) <= most else self.tokenize_short(t, most, level + 1, deepest, combine)
        return ["".join(out)] if combine and all(len(_HAN_CHAR.findall(t)) <= 1 for t in out) else out


_LATIN, _DIGITS = re.compile("[A-Za-z]+"), re.compile(_NUMBER)


def join_same_kind(tokens: Sequence[str]) -> list[str]:
    """Neighbours that are both letters, or both numbers, become one token."""
    out: list[str] = []
    last = None
    for t in tokens:
        kind = "letters" if _LATIN.fullmatch(t) else "digits" if _DIGITS.fullmatch(t) else None
        if kind and kind == last:
            out[-1] += t
        else:
            out.append(t)
        last = kind
    return out


def join_numbers_to_words(tokens: Sequence[str]) -> list[str]:
    """A number joins the letters or number before it."""
    out: list[tuple[str, str | None]] = []
    for t in tokens:
        kind = "letters" if _LATIN.fullmatch(t) else "digits" if _DIGITS.fullmatch(t) else None
        if out and kind == "digits" and out[-1][1]:
            out[-1] = (out[-1][0] + t, "both")
        else:
            out.append((t, kind))
    return [t for t, _ in out]


def split_letters_and_numbers(token: str) -> list[tuple[str, str]]:
    pattern = re.compile(rf"(?P<letters>[A-Za-z]+)|(?P<unit>(?:{DIGIT_PREFIX}\s*)?{_NUMBER}\s*{UNIT})|(?P<digits>{_NUMBER})|(?P<zh_number>{_ZH_UNIT})|(?P<word>[^\da-zA-Z]+)")
    return [(m.group(), m.lastgroup) for m in pattern.finditer(token)]


_ZH_WHOLE = re.compile(_ZH_UNIT)


def join_zh_numbers(tokens: Sequence[str], model: Unigram) -> list[str]:
    """A Chinese number with its unit and the single characters around it become one token if the model has it as one."""
    out = list(tokens)
    i = 0
    while i < len(out):
        if _ZH_WHOLE.fullmatch(out[i]):
            single = lambda k: 0 <= k < len(out) and len(out[k]) == 1 and _HAN_CHAR.match(out[k])
            for a, b in ((i - 1, i + 1), (i - 1, i), (i, i + 1)):
                if all(single(k) for k in {a, b} - {i}):
                    whole = "".join(out[a : b + 1])
                    if model.tokenize(whole) == [whole]:
                        out[a : b + 1] = [whole]
                        i = a
                        break
        i += 1
    return out


@dataclass
class SentenceTokenizer:
    """Lower-case, typed spans, segmentation of the rest, joining, cleaning."""

    model: Unigram
    drop_non_words: bool = False
    drop_blank: bool = False
    most: int | None = None

    def __call__(self, sentence: str | None) -> list[str]:
        tokens: list[str] = []
        for part, kind in typed_spans((sentence or "").lower()):
            tokens += [part] if kind != "str" else self.model.tokenize_short(part, self.most) if self.most is not None else self.model.tokenize(part)
        tokens = join_zh_numbers(join_same_kind(tokens), self.model)
        if self.drop_non_words:
            tokens = [t for t in (_NON_WORDS.sub("", x) for x in tokens) if t]
        if self.drop_blank:
            tokens = [t for t in tokens if t.strip()]
        return [t.replace(MASK, " ") for t in tokens]


def load_unigram(pieces: DataFrame) -> Unigram:
    """From (piece, score) rows."""
    rows = pieces.select("piece", "score").limit(MOST_PIECES + 1).collect()
    if len(rows) > MOST_PIECES:
        raise ValueError(f"a vocabulary may have {MOST_PIECES} pieces")
    return Unigram({r[0]: float(r[1]) for r in rows})


def unigram_from_counts(freqs: DataFrame, most: int = 200_000) -> Unigram:
    """Pieces are the most frequent tokens with their log-probabilities."""
    rows = freqs.orderBy(freqs["term_freq"].desc(), freqs["token"]).limit(most).collect()
    total = sum(r["term_freq"] for r in rows) or 1
    return Unigram({r["token"]: math.log(r["term_freq"] / total) for r in rows})


def tokenizer(df: DataFrame, tokenize) -> Column | object:
    """A Column function that runs a tokenizer object over Arrow batches; the object is broadcast once."""
    shared = df.sparkSession.sparkContext.broadcast(tokenize)

    @pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(shared.value)

    return run


def split_long(tokens: Sequence[str], most: int, keep: re.Pattern = SPAN) -> tuple[list[str], list[int]]:
    """Tokens cut to `most` characters but for numbers with units, and for each piece the number of its token."""
    out, index = [], []
    for i, t in enumerate(tokens):
        parts = [t] if len(t) <= most or keep.fullmatch(t) else [t[k : k + most] for k in range(0, len(t), most)]
        out += parts
        index += [i] * len(parts)
    return out, index

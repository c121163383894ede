"""Quality rules (3): word and line statistics, and decision lists that are learned from labelled documents.

A decision list is learned by sequential covering: a rule, a conjunction of thresholds on statistics, is grown on two
thirds of the labelled rows by information gain, pruned on the rest by precision, and the rows that it covers are set
aside before the next one is grown. The list is emitted as one ordered Spark conditional, so that it runs inside
code generation; only the statistics themselves need Python, over Arrow buffers.

Defined cases: a null or empty text has no words and fails the base rules; words and lines have any length; repeated rows are
judged each alike and learned from once; ids may be of any type that labels and documents share; an empty
table gives an empty result; without labels of both kinds the list is empty and keeps what the base rules keep; columns of
the input are passed on whatever their names, as all statistics are in one struct whose name is free in the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as K

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bangs", "n_stops", "n_digits", "n_distinct", "longest")
_SYMBOLS, _UPPER, _BANGS, _STOPS, _DIGITS = (np.isin(np.arange(256), list(x)) for x in (b"#*$%&|<>", bytes(range(65, 91)), b"!?", b".,;:", b"0123456789"))


def counts(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """All counts for each text of a piece."""
    n = len(offsets) - 1
    starts, ends, first = K.spans(K.IS_WORD[raw], offsets)
    lead = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(K.IS_LEAD[raw], out=lead[1:])
    words, row = K.span_hashes(raw, starts, ends), K.row_of(first, len(starts))
    sizes = lead[ends] - lead[starts]
    out = {"n_words": np.diff(first), "word_chars": K.sums_by_row(sizes, first)}
    for name, table in (("n_symbols", _SYMBOLS), ("n_upper", _UPPER), ("n_bangs", _BANGS), ("n_stops", _STOPS), ("n_digits", _DIGITS)):
        out[name] = K.sums_by_row(table[raw], offsets)
    # lines that have a word; the second and later ones of equal lines of a text
    begin, end, _ = K.spans(raw != 10, offsets)
    full = np.searchsorted(starts, end) > np.searchsorted(starts, begin)
    begin, end = begin[full], end[full]
    line_row = np.searchsorted(offsets, begin, "right") - 1
    key = K.mix(K.span_hashes(raw, begin, end) + K.mix(line_row.astype(K.U64)))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[order[1:]] = key[order[1:]] == key[order[:-1]]
    out["n_lines"] = np.bincount(line_row, minlength=n)
    out["n_dup_lines"] = np.bincount(line_row[again], minlength=n)
    # words of 5-word windows that the text has twice
    window = K.shingles(words, 5)
    at = np.flatnonzero(row[: len(window)] == row[4:]) if len(window) else np.zeros(0, np.int64)
    key = K.mix(window[at] + K.mix(row[at].astype(K.U64)))
    order = np.argsort(key)
    twin = key[order[1:]] == key[order[:-1]]
    found = np.unique(np.concatenate([order[1:][twin], order[:-1][twin]]))
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, at[found], 1)
    np.add.at(cover, at[found] + 5, -1)
    out["n_repeat_words"] = K.sums_by_row(np.cumsum(cover[:-1]) > 0, first)
    key = K.mix(words + K.mix(row.astype(K.U64) + K.U64(1 << 40)))
    order = np.argsort(key)
    new = np.ones(len(key), bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    out["n_distinct"] = np.bincount(row[order[new]], minlength=n)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, row, sizes)
    out["longest"] = longest
    return out


def with_counts(docs: DataFrame, text: str = "text", name: str = "counts") -> DataFrame:
    """The rows with a struct of the counts appended, under a name that the input must not have."""
    if name in docs.columns:
        raise ValueError(f"the input has a column {name!r}")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in K.pieces(batches, text):
            found = counts(*K.text_bytes(piece.column(text)))
            struct = pa.StructArray.from_arrays([pa.array(found[c].astype(np.int64)) for c in COUNTS], list(COUNTS))
            yield pa.RecordBatch.from_arrays([*piece.columns, struct], [*piece.schema.names, name])

    return docs.mapInArrow(run, schema)


def free_name(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name = "_" + name
    return name


def statistics(counts: Column) -> dict[str, Column]:
    """The statistics on which rules have thresholds, as Spark expressions over the counts."""
    c = lambda name: counts.getField(name).cast("double")
    words, chars = F.greatest(c("n_words"), F.lit(1.0)), F.greatest(c("word_chars"), F.lit(1.0))
    return {
        "n_words": c("n_words"), "mean_word": c("word_chars") / words, "longest": c("longest"), "symbols": c("n_symbols") / words,
        "upper": c("n_upper") / chars, "bangs": c("n_bangs") / words, "stops": c("n_stops") / words, "digits": c("n_digits") / chars,
        "dup_lines": c("n_dup_lines") / F.greatest(c("n_lines"), F.lit(1.0)), "repeats": c("n_repeat_words") / words,
        "distinct": c("n_distinct") / words, "line_words": c("n_words") / F.greatest(c("n_lines"), F.lit(1.0)),
    }


@dataclass(frozen=True)
class Rule:
    """Rejects a document of which all conditions (statistic, "<=" or ">", threshold) hold."""

    conditions: tuple[tuple[str, str, float], ...]

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, sign, at in self.conditions:
            v = x[:, names.index(name)]
            out &= (v <= at) if sign == "<=" else (v > at)
        return out


def _gain(p: np.ndarray, n: np.ndarray, p0: float, n0: float) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), -np.inf)


def _grow(x: np.ndarray, y: np.ndarray, names: list[str], most: int) -> Rule:
    conditions: list[tuple[str, str, float]] = []
    inside = np.ones(len(x), bool)
    while len(conditions) < most and y[inside].sum() < inside.sum():
        p0, n0 = y[inside].sum(), (~y[inside]).sum()
        best = (1e-9, None)
        for j, name in enumerate(names):
            v, t = x[inside, j], y[inside]
            order = np.argsort(v, kind="stable")
            v, t = v[order], t[order]
            cut = np.flatnonzero(v[1:] > v[:-1])
            if not len(cut):
                continue
            p, n = np.cumsum(t)[cut].astype(float), np.cumsum(~t)[cut].astype(float)
            for sign, gain in (("<=", _gain(p, n, p0, n0)), (">", _gain(p0 - p, n0 - n, p0, n0))):
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (name, sign, float((v[cut[k]] + v[cut[k] + 1]) / 2)))
        if best[1] is None:
            break
        conditions.append(best[1])
        inside &= Rule((best[1],)).holds(x, names)
    return Rule(tuple(conditions))


def learn(x: np.ndarray, rejected: np.ndarray, names: list[str], precision: float = 0.9, most_rules: int = 16, most_conditions: int = 4, seed: int = 7) -> list[Rule]:
    """An ordered list of rejecting rules. A rule stays if its precision holds on the rows that it wasn't grown on."""
    hold = np.random.default_rng(seed).random(len(x)) < 1 / 3
    rules: list[Rule] = []
    left = np.ones(len(x), bool)
    while len(rules) < most_rules:
        grow, prune = left & ~hold, left & hold
        if rejected[grow].sum() < 3 or (~rejected[grow]).sum() == 0:
            break
        rule = _grow(x[grow], rejected[grow], names, most_conditions)
        scores = []
        for k in range(len(rule.conditions), 0, -1):
            short = Rule(rule.conditions[:k])
            covered = short.holds(x[prune], names)
            p, n = rejected[prune][covered].sum(), (~rejected[prune])[covered].sum()
            scores.append(((p - n) / (p + n) if p + n else -1.0, p, short, p / (p + n) if p + n else 0.0))
        if not scores:
            break
        _, support, rule, held = max(scores, key=lambda s: (s[0], s[1]))
        if held < precision or support < 2:
            break
        rules.append(rule)
        left &= ~rule.holds(x, names)
    return rules


def verdict(rules: list[Rule], statistics: dict[str, Column]) -> Column:
    """The list as one ordered conditional: false for what the first rule that holds rejects, else true."""
    out = None
    for rule in rules:
        test = F.lit(True)
        for name, sign, at in rule.conditions:
            test &= (statistics[name] <= at) if sign == "<=" else (statistics[name] > at)
        out = F.when(test, False) if out is None else out.when(test, False)
    return F.lit(True) if out is None else out.otherwise(True)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", on: str = "doc_id", text: str = "text", max_rows: int = 20_000, precision: float = 0.9, seed: int = 7) -> list[Rule]:
    """Learns from at most `max_rows` labelled documents, the first in the order of a seeded hash of their ids.

    A label of 0 is a document to reject; null labels and ids are left out, and of several labels of an id the lowest counts.
    Of several rows of an id the one with the least hash of its text is learned from. What the base rules reject isn't
    learned from, as the list is only asked about the rest. So the driver sees one row of statistics for each chosen id.
    """
    chosen = labels.where(F.col(label).isNotNull() & F.col(on).isNotNull()).groupBy(on).agg(F.min(label).alias("_label"))
    chosen = chosen.orderBy(F.xxhash64(F.lit(seed), on), on).limit(max_rows)
    rows = docs.select(on, text).join(F.broadcast(chosen), on)  # max_rows ids
    found = with_counts(rows.select(on, "_label", F.col(text).alias("text")), "text", "_counts")
    found = found.where(~base_failed(F.col("_counts"))).select(F.col(on).alias("_id"), "_label", "_counts", F.xxhash64("text").alias("_order"))
    # partial sums keep one row for each id before anything is sent, so a hot id stays one row
    one = found.groupBy("_id").agg(F.min_by(F.struct("_label", "_counts"), F.struct("_order", F.to_json("_counts"))).alias("_one"))
    values = statistics(F.col("_one._counts"))
    data = one.select("_id", F.col("_one._label").alias("_label"), *[v.alias(k) for k, v in values.items()]).toPandas()  # max_rows
    data = data.sort_values("_id", kind="stable")
    names = list(values)
    return learn(data[names].to_numpy(float), data["_label"].to_numpy() == 0, names, precision, seed=seed)


def base_failed(counts: Column) -> Column:
    words, repeats = counts.getField("n_words"), counts.getField("n_repeat_words")
    return (words < 10) | (100 * repeats > 20 * words)


def judge(docs: DataFrame, rules: list[Rule], text: str = "text", name: str = "counts") -> DataFrame:
    """The rows with their counts, base_failed and kept in a struct `name` (counts, base_failed, kept)."""
    counted = with_counts(docs, text, free_name(docs, "_counts"))
    c = F.col(counted.columns[-1])
    failed = base_failed(c)
    return counted.select(*docs.columns, F.struct(c.alias("counts"), failed.alias("base_failed"), (~failed & verdict(rules, statistics(c))).alias("kept")).alias(name))


def keep(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that neither the base rules nor the learned list reject, with the same columns."""
    name = free_name(docs, "_judged")
    return judge(docs, fit(docs, labels, **options), name=name).where(F.col(name).kept).select(*docs.columns)

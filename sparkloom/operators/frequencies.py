"""Token frequency tables: term and document frequencies, percentiles, thresholds, and merging of parts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: words, in whole documents, that are counted at a time
WORDS = 200_000
PERCENTS = (0.0, 0.05, 0.1, 0.25, 0.5, 0.75, 0.8, 0.85, 0.9, 0.95, 0.98, 0.99, 1.0)


def frequencies(docs: DataFrame, words: Column, *by: str) -> DataFrame:
    """token, doc_freq, term_freq, for each value of `by`, with one shuffle.

    Each Arrow batch of documents is counted as a whole by numbers of its distinct words, so that a word is one row for each
    batch (and value of `by`) before anything moves, however often it occurs.
    """
    kinds = dict(docs.dtypes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = pa.default_memory_pool()
        for batch in batches:
            lists = batch.column("_words")
            sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
            # documents of about WORDS words at a time
            cuts = np.flatnonzero(np.diff((np.cumsum(sizes) - 1) // WORDS, prepend=-1))
            for at, to in zip(cuts, [*cuts[1:], batch.num_rows]):
                part = batch.slice(at, to - at)
                flat = part.column("_words").flatten()
                if not len(flat):
                    continue
                coded = flat.dictionary_encode()
                code, n = coded.indices.to_numpy(zero_copy_only=False), len(coded.dictionary)
                rows = np.repeat(np.arange(part.num_rows), sizes[at:to])
                group = np.zeros(part.num_rows, np.int64)
                for c in by:
                    own = part.column(c).dictionary_encode(null_encoding="encode")
                    group = np.unique(group * (len(own.dictionary) + 1) + own.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
                # one for each word of a document, with how often it is there
                once, times = np.unique(rows * n + code, return_counts=True)
                keys, first, found = np.unique(group[once // n] * n + once % n, return_index=True, return_inverse=True)
                docs_, terms = np.bincount(found, minlength=len(keys)), np.bincount(found, weights=times, minlength=len(keys))
                taken = pa.array(once[first] // n)
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(taken) for c in by), coded.dictionary.take(pa.array(keys % n)), pa.array(docs_.astype(np.int64)), pa.array(terms.astype(np.int64))], [*by, "token", "d", "n"])
            # so that a worker holds one batch, not two, and gives back what it is done with
            batch = lists = part = flat = coded = code = rows = once = times = keys = first = found = taken = own = None
            pool.release_unused()

    schema = "".join(f"`{c}` {kinds[c]}, " for c in by) + "token string, d long, n long"
    flat = docs.select(*by, words.alias("_words")).mapInArrow(count, schema)
    return flat.groupBy(*by, "token").agg(F.sum("d").alias("doc_freq"), F.sum("n").alias("term_freq"))


def corpus_counts(docs: DataFrame, words: Column) -> DataFrame:
    return docs.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum(F.size(words)), F.lit(0)).cast("long").alias("n_tokens"))


def percentiles(freqs: DataFrame, column: str, percents: Sequence[float] = PERCENTS) -> DataFrame:
    """Exact, linearly interpolated, cut to whole numbers: one row for each percent."""
    rows = F.arrays_zip(F.array(*[F.lit(float(p)) for p in percents]).alias("percent"), F.percentile(column, F.array(*[F.lit(float(p)) for p in percents])).alias("value"))
    return freqs.agg(rows.alias("r")).select(F.explode("r").alias("r")).select(F.col("r.percent").alias("percent"), F.col("r.value").cast("long").alias("value"))


def percentiles_approx(freqs: DataFrame, column: str, percents: Sequence[float] = PERCENTS, accuracy: int = 10_000) -> DataFrame:
    """Values of the data near the percents; bounded memory."""
    p = [float(x) for x in percents]
    got = freqs.agg(F.percentile_approx(column, p, accuracy).alias("v"))
    return got.select(F.explode(F.arrays_zip(F.array(*map(F.lit, p)).alias("percent"), F.col("v").alias("value"))).alias("r")).select("r.percent", "r.value")


def above_threshold(freqs: DataFrame, column: str = "doc_freq", least: int = 20, percent: float = 0.85) -> DataFrame:
    """Rows at or above both the floor and the percentile (cut to a whole number)."""
    bar = freqs.agg(F.greatest(F.lit(least), F.percentile(column, F.lit(percent)).cast("long")).alias("_bar"))
    return freqs.join(F.broadcast(bar), F.col(column) >= F.col("_bar")).drop("_bar")  # one row


def at_least(words: DataFrame, least: int, column: str = "doc_freq") -> DataFrame:
    return words if least <= 1 else words.where(F.col(column) >= least)


def merge_parts(parts: Sequence[DataFrame], least: int = 1, column: str = "doc_freq", key: str = "word") -> DataFrame:
    """Sums of the parts' frequencies, filtered."""
    every = reduce(DataFrame.unionByName, parts)
    summed = every.groupBy(key).agg(F.sum("doc_freq").cast("long").alias("doc_freq"), F.sum("term_freq").cast("long").alias("term_freq"))
    return at_least(summed, least, column)


def ordered(freqs: DataFrame, first: str = "doc_freq", key: str = "token") -> DataFrame:
    second = "term_freq" if first == "doc_freq" else "doc_freq"
    return freqs.orderBy(F.desc(first), F.desc(second), key)


def shuffled(freqs: DataFrame, seed: int, key: str = "token") -> DataFrame:
    """A seeded random order that doesn't depend on partitions."""
    return freqs.orderBy(F.xxhash64(F.lit(seed), key), key)


def word_counts(lists: DataFrame, words: Column, least: int = 1) -> DataFrame:
    """Counts of words in lists, or lists of lists flattened beforehand."""
    return at_least(lists.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n")), least, "n")

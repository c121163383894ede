"""Token weights from frequencies or parts of speech, and weighted vectors of texts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUANTILES = (0.0, 0.01, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.98, 0.99, 0.999, 0.9999, 1.0)


def nearest_quantiles(rows: DataFrame, column: str, points: Sequence[float] = QUANTILES) -> DataFrame:
    """Values at the ranks nearest to the points (half to even); the ranks are found by counts of equal values, not by a window over all rows."""
    spark = rows.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(float(p),) for p in points], "point double"))
    counts = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n"))
    total = F.broadcast(counts.agg(F.sum("_n").alias("_all")))
    # distinct frequencies are few: their number grows with the logarithm of the corpus
    upto = counts.withColumn("_to", F.sum("_n").over(Window.orderBy(column))).withColumn("_from", F.col("_to") - F.col("_n"))
    at = wanted.crossJoin(total).withColumn("_at", F.bround((F.col("_all") - 1) * F.col("point"), 0))
    return upto.join(F.broadcast(at), (F.col("_at") >= F.col("_from")) & (F.col("_at") < F.col("_to"))).select("point", F.col(column).alias("value"))


def frequency_weights(freqs: DataFrame, method: str = "log", base: float | None = None, low: float = 0.1, high: float = 1.0, column: str = "term_freq", clamp: float = 0.99999) -> DataFrame:
    """Adds `weight`: high for rare and low for frequent tokens, by ratio, quantile, logarithm or power of the frequency."""
    f = F.col(column)
    bounds = freqs.agg(F.min(f).alias("_min"), F.max(f).alias("_max"), F.expr(f"percentile_disc({clamp}) within group (order by {column})").alias("_top"))
    joined = freqs.crossJoin(F.broadcast(bounds))  # one row
    span = lambda g: F.try_divide(g(f) - g(F.col("_min")), g(F.col("_max")) - g(F.col("_min")))
    if method == "ratio":
        score = span(lambda x: x.cast("double"))
    elif method == "log":
        score = span(lambda x: F.log(float(base or 10), x + 10))
    elif method == "power":
        score = span(lambda x: F.pow(x, F.lit(base or 0.5)))
    elif method == "quantile":
        points = nearest_quantiles(freqs, column).agg(F.array_sort(F.collect_list(F.struct("point", "value"))).alias("_q"))  # a row for each point
        joined = joined.crossJoin(F.broadcast(points))
        # the point before the first value above the frequency; never the last point
        below = F.size(F.filter("_q", lambda x: x.value <= f))
        score = F.get(F.col("_q"), F.least(F.greatest(below - 1, F.lit(0)), F.size("_q") - 2))["point"]
    else:
        raise ValueError(f"unknown method {method!r}")
    weight = F.when(f <= F.col("_min"), F.lit(high)).when(f >= F.col("_top"), F.lit(low)).otherwise(low + (high - low) * (1 - score))
    return joined.withColumn("weight", F.bround(weight, 4)).drop("_min", "_max", "_top", "_q")


def speech_weight(pos: Column, exclude: Sequence[str], middle: Sequence[str], low: float = 0.1, high: float = 1.0) -> Column:
    return F.when(pos.isin(list(exclude)), low).when(pos.isin(list(middle)), (low + high) / 2).otherwise(high)


def weighted_tokens(tokens: DataFrame, weights: DataFrame, low: float = 0.1, high: float = 1.0, key: str = "token") -> DataFrame:
    """Adds the weight of each token; unknown ones have the middle."""
    return tokens.join(weights.select(key, "weight"), key, "left").withColumn("weight", F.coalesce("weight", F.lit(round((low + high) / 2, 4))))


def text_vectors(tokens: DataFrame, vectors: DataFrame, id_: str = "id", how: str = "mean", distinct: bool = True, normalise: bool = True, weight: str | None = None) -> DataFrame:
    """One vector for each id from rows of (id, token[, weight]): sum of unit token vectors by weight, then of unit length or over the weights.

    Elements are added up by place, so that a long text is summed before the shuffle like any other group.
    """
    rows = tokens.dropDuplicates([id_, "token"]) if distinct else tokens
    w = F.col(weight) if weight else F.lit(1.0)
    length = F.sqrt(F.aggregate(F.col("vector").cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))
    unit = F.transform(F.col("vector").cast("array<double>"), lambda x: F.coalesce(F.try_divide(x, length), F.lit(0.0)))
    joined = rows.join(vectors.select("token", "vector"), "token").select(id_, unit.alias("_v"), w.alias("_w"))
    places = joined.select(id_, "_w", F.posexplode("_v").alias("_i", "_x")).groupBy(id_, "_i").agg(F.sum(F.col("_x") * F.col("_w")).alias("_x"), F.sum(F.abs("_w")).alias("_w"))
    out = places.groupBy(id_).agg(F.array_sort(F.collect_list(F.struct("_i", "_x"))).alias("_p"), F.first("_w").alias("_w"))  # a row for each place
    v = F.transform("_p", lambda p: p["_x"])
    if normalise:
        size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
        v = F.transform(v, lambda x: F.coalesce(F.try_divide(x, size), F.lit(0.0)))
    elif how != "sum":
        v = F.transform(v, lambda x: F.coalesce(F.try_divide(x, F.col("_w")), F.lit(0.0)))
    return out.select(id_, v.alias("vector"))


def pooled(rows: DataFrame, by: str, vector: str = "vector", how: str = "mean") -> DataFrame:
    """Sum, mean or maximum of vectors of a group, by place."""
    f = {"sum": F.sum, "mean": F.avg, "max": F.max}[how]
    flat = rows.select(by, F.posexplode(F.col(vector).cast("array<double>")).alias("i", "x"))
    places = flat.groupBy(by, "i").agg(f("x").alias("x"))
    return places.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p.x).alias("vector"))


def pair_scores(query: DataFrame, samples: DataFrame, at: float = 0.15) -> DataFrame:
    """Word level: for each sample the sum over its distinct words of the squared cosine with the query, small ones cut to 0, by weight.

    query: one row (vector); samples: (sample, token, vector, weight).
    """
    from ..functions import vectors as V

    words = samples.dropDuplicates(["sample", "token"]).crossJoin(F.broadcast(query.select(F.col("vector").alias("_q")).limit(1)))
    own = V.truncate(F.pow(V.cosine(F.col("vector"), F.col("_q")), 2), at, 0.0) * F.col("weight")
    return words.groupBy("sample").agg(F.sum(own).alias("score")).orderBy(F.desc("score"), "sample")


def window_sums(rows: DataFrame, doc: str, place: str, distance: int, with_self: bool = True, vector: str = "vector") -> DataFrame:
    """For each token the sum of the vectors of its neighbours up to `distance` places away."""
    flat = rows.select(doc, place, F.posexplode(F.col(vector).cast("array<double>")).alias("i", "x"))
    w = Window.partitionBy(doc, "i").orderBy(place).rowsBetween(-distance, distance)
    total = F.sum("x").over(w)
    summed = flat.withColumn("s", total if with_self else total - F.col("x"))
    return summed.groupBy(doc, place).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda p: p.s).alias("sum"))


def _unit_sums(rows: DataFrame, doc: str, token: str, vector: str) -> DataFrame:
    """(doc, token, _v, _n): the sum of the unit vectors of a token's rows and how many they are; vectors of length 0 count as none."""
    kinds = dict(rows.dtypes)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                flat, there = part.column(2).flatten().to_numpy(zero_copy_only=False), np.asarray(part.column(2).is_valid())
                m = np.zeros((part.num_rows, len(flat) // max(1, there.sum())))
                m[there] = flat.reshape(there.sum(), -1)
                size = np.sqrt((m * m).sum(axis=1))
                good = size > 0  # not so for nulls either
                m = np.divide(m, size[:, None], out=np.zeros_like(m), where=good[:, None])
                codes = [part.column(i).dictionary_encode() for i in (0, 1)]
                key = codes[0].indices.to_numpy().astype(np.int64) * len(codes[1].dictionary) + codes[1].indices.to_numpy()
                order = np.argsort(key, kind="stable")
                starts = np.flatnonzero(np.diff(key[order], prepend=-1))
                sums, n = np.add.reduceat(m[order], starts, axis=0), np.add.reduceat(good[order].astype(np.int64), starts)
                taken = pa.array(order[starts])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(starts) + 1) * m.shape[1], pa.int32()), pa.array(sums.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0).take(taken), part.column(1).take(taken), lists, pa.array(n)], [doc, token, "_v", "_n"])

    flat = rows.where(F.col(doc).isNotNull() & F.col(token).isNotNull()).select(doc, token, F.col(vector).cast("array<double>").alias("_v"))
    parts = flat.mapInArrow(add, f"`{doc}` {kinds[doc]}, `{token}` {kinds[token]}, _v array<double>, _n long")
    # a row for each batch that has the token; of vectors of length 0 alone there may be empty ones
    lists = parts.groupBy(doc, token).agg(F.collect_list("_v").alias("_l"), F.sum("_n").alias("_n"))
    total = F.aggregate("_l", F.array().cast("array<double>"), lambda s, v: F.zip_with(s, v, lambda x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0))))
    return lists.select(doc, token, total.alias("_v"), "_n")


def least_important(rows: DataFrame, doc: str, token: str = "token", vector: str = "vector") -> DataFrame:
    """The token of each document with the greatest sum of cosines with its other tokens, that is the least to add.

    That sum is the token's unit vector by the sum of the others', so no pair of tokens is made.
    """
    from ..functions import vectors as V

    own = _unit_sums(rows, doc, token, vector)
    counts = own.groupBy(doc).agg(F.sum("_n").alias("_all"), F.count("*").alias("_tokens")).where("_tokens > 1")
    whole = pooled(own, doc, "_v", "sum").withColumnRenamed("vector", "_s")
    both = own.join(counts.join(whole, doc, "left"), doc)
    near = F.when((F.col("_n") > 0) & (F.col("_all") > F.col("_n")), V.dot(F.col("_v"), F.zip_with("_s", "_v", lambda s, x: s - x)))
    return both.select(doc, F.col(token).alias("a"), near.alias("near")).groupBy(doc).agg(F.max_by("a", F.struct("near", "a")).alias("token"))


def blended(token_vectors: DataFrame, splits: DataFrame, whole: float = 1.0, part: float = 0.8) -> DataFrame:
    """Token vectors with the mean of their splits' vectors added: whole * v + part * split; splits: (token, piece)."""
    from ..functions import vectors as V

    pieces = splits.join(token_vectors.select(F.col("token").alias("piece"), "vector"), "piece")
    mean = pooled(pieces, "token").withColumnRenamed("vector", "_split")
    return token_vectors.join(mean, "token", "left").select("token", V.weighted_sum((F.col("vector"), whole), (F.col("_split"), part)).alias("vector"))

"""Rank evaluation of embedding models against their median, and agreement of similarities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = (-1.0, -0.5, -0.2, 0.0, 0.2, 0.4, 0.6, 0.8, 1.0001)


def hit_ranks(hits: DataFrame, similarity: Column, keys: Sequence[str], hit: str = "hit_idx") -> DataFrame:
    """Ranks from 0 of the hits of each key by similarity; a missing one counts as -1, ties are in hit order."""
    w = Window.partitionBy(*keys).orderBy(F.desc("_s"), hit)
    return hits.withColumn("_s", F.coalesce(similarity, F.lit(-1.0))).withColumn("rank", F.row_number().over(w) - 1).drop("_s")


def median_ranks(ranks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The median over models, cut to a whole number."""
    return ranks.groupBy(*keys).agg(F.percentile("rank", F.lit(0.5)).cast("int").alias("median"))


def rank_scores(ranks: DataFrame, anchor: Sequence[str] = ("query", "anchor_idx"), model: str = "model", hit: str = "hit_idx", bias: float = 1.85) -> DataFrame:
    """score = 1 - sum |rank - median| / (sum (n - median) - bias n), for each anchor and model; null where the denominator isn't positive."""
    med = median_ranks(ranks, [*anchor, hit])
    both = ranks.join(med, [*anchor, hit])
    sums = both.groupBy(*anchor, model).agg(F.sum(F.abs(F.col("rank") - F.col("median"))).alias("_d"), F.sum("median").alias("_m"), F.count("*").alias("_n"))
    most = F.col("_n") * F.col("_n") - F.col("_m") - bias * F.col("_n")
    return sums.select(*anchor, model, F.when(most > 0, 1 - F.col("_d") / most).alias("score"))


def overall_scores(scores: DataFrame, query: str = "query", model: str = "model") -> DataFrame:
    """Mean over queries of the mean over a query's anchors."""
    by_query = scores.groupBy(query, model).agg(F.avg("score").alias("score"))
    return by_query.groupBy(model).agg(F.avg("score").alias("score"))


def agreement(pairs: DataFrame, x: str, y: str, order: Sequence[str]) -> DataFrame:
    """Pearson, Spearman (ties by order), mean absolute and squared error, in one row."""
    rank = lambda c: F.row_number().over(Window.orderBy(c, *order))
    ranked = pairs.withColumns({"_rx": rank(x), "_ry": rank(y)})
    d = F.col(x) - F.col(y)
    return ranked.agg(F.corr(x, y).alias("pearson"), F.corr("_rx", "_ry").alias("spearman"), F.avg(F.abs(d)).alias("mae"), F.avg(d * d).alias("mse"))


def calibration(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """Slope and intercept of the least squares line from x to y; 1 and 0 where x hardly varies."""
    flat = F.coalesce(F.var_pop(x), F.lit(0.0)) < 1e-12
    slope = F.try_divide(F.covar_pop(x, y), F.var_pop(x))
    return pairs.agg(F.when(flat, 1.0).otherwise(slope).alias("slope"), F.when(flat, 0.0).otherwise(F.avg(y) - slope * F.avg(x)).alias("intercept"))


def bucket_report(pairs: DataFrame, x: str, y: str, bins: Sequence[float] = BINS) -> DataFrame:
    """By bin of x: count, means, deviation and mean absolute error; empty bins have a row too."""
    spark = pairs.sparkSession
    table = F.broadcast(spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(bins, bins[1:]))], "bin int, lo double, hi double"))
    number = F.size(F.filter(F.array(*[F.lit(float(b)) for b in bins]), lambda e: e <= F.col(x))) - 1
    d = F.col(y) - F.col(x)
    found = pairs.groupBy(number.alias("bin")).agg(F.count("*").alias("n"), F.avg(x).alias("x_mean"), F.avg(y).alias("y_mean"), F.stddev_pop(y).alias("y_std"), F.avg(F.abs(d)).alias("mae"))
    return table.join(found, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def topk_overlap(a: DataFrame, b: DataFrame, k: int, query: str = "query", id_: str = "id") -> DataFrame:
    """Mean share of the k nearest that two rankings (query, id, rank) agree on."""
    left, right = (t.where(F.col("rank") <= k).select(query, id_) for t in (a, b))
    both = left.join(right, [query, id_]).groupBy(query).agg(F.count("*").alias("_n"))
    each = left.select(query).distinct().join(both, query, "left")
    return each.agg(F.avg(F.coalesce("_n", F.lit(0)) / k).alias("overlap"))


def triplet_metrics(triplets: DataFrame, near: str, far: str, margin: float = 0.2) -> DataFrame:
    """Mean hinge loss of similarities to positives and negatives, and the share in the right order."""
    return triplets.agg(F.avg(F.greatest(F.lit(0.0), margin - F.col(near) + F.col(far))).alias("loss"), F.avg((F.col(near) > F.col(far)).cast("double")).alias("accuracy"))


def distillation(pairs: DataFrame, teacher: str, student: str) -> DataFrame:
    """Mean squared error and centred correlation of a student's similarities."""
    d = F.col(teacher) - F.col(student)
    return pairs.agg(F.avg(d * d).alias("mse"), F.corr(teacher, student).alias("corr"), (F.avg(student) - F.avg(teacher)).alias("shift"))

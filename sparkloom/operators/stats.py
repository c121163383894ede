"""Corpus statistics: summaries by date range, ratio buckets, counts by region, balanced shards and shard plans."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINTS = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
EDGES = (0, 1e2, 1e3, 1e4, 1e5, 1e6, 1e7, 1e10)


def boundaries(first: dt.date, today: dt.date, splits: Sequence[tuple[int, int]] = ((2009, 1), (2017, 2), (2021, 4))) -> list[tuple[dt.date, dt.date]]:
    """Half-open date ranges from `first` to today; each year is cut into as many parts as the last entry up to it says."""
    starts = [first]
    for year in range(first.year + 1, today.year + 1):
        parts = [n for y, n in splits if y <= year][-1]
        starts += [dt.date(year, 1 + 12 // parts * k, 1) for k in range(parts)]
    starts = [d for d in starts if d < today]
    return list(zip(starts, [*starts[1:], today]))


def ranges_table(spark: SparkSession, ranges: Sequence[tuple[dt.date, dt.date]]) -> DataFrame:
    return spark.createDataFrame([(a.isoformat(), b.isoformat(), a, b) for a, b in ranges], "range_start string, range_end string, lo date, hi date")


def percentiles_disc(rows: DataFrame, by: str, column: str, points: Sequence[float], accuracy: int = 10_000) -> DataFrame:
    """(by, values): of each group the values at the points, each the first with at least that share of the group's rows up to it; nulls are left out.

    No task holds a group's values. A sketch gives cuts a little below and above each point, rows are counted between and at
    the cuts, and only values of the cells in which the points fall are counted one by one. The cuts only save work: with
    others the result is the same.
    """
    there = rows.where(F.col(column).isNotNull()).select(F.col(by).alias("_by"), F.col(column).alias("_x"))
    shares = sorted({min(1.0, max(0.0, p + e)) for p in points for e in (-2 / accuracy, 2 / accuracy)})
    cuts = there.groupBy(F.col("_by").alias("_own")).agg(F.percentile_approx("_x", shares, accuracy).alias("_cuts"), F.count("*").alias("_all"))
    place = lambda c: (F.col("_x") > c).cast("int") + (F.col("_x") >= c).cast("int")
    # written out for a few cuts; for many, the code of it would be too long to be compiled
    cell = sum(place(F.col("_cuts")[i]) for i in range(len(shares))) if len(shares) <= 4 else F.aggregate("_cuts", F.lit(0), lambda s, c: s + place(c))
    marked = there.join(F.broadcast(cuts), F.col("_by").eqNullSafe(F.col("_own"))).select("_by", "_x", "_all", cell.alias("_cell"))  # a row for each group
    upto = F.sum("_n").over(Window.partitionBy("_by").orderBy("_cell"))  # a row for each cell
    counts = marked.groupBy("_by", "_cell").agg(F.count("*").alias("_n"), F.max("_all").alias("_all")).withColumn("_to", upto)
    asked = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(Decimal(repr(float(p)))).cast("decimal(17,15)").alias("p")) for i, p in enumerate(points)])).alias("_at")
    rank = F.greatest(F.ceil(F.col("_all").cast("decimal(19,0)") * F.col("_at.p")).cast("long"), F.lit(1).cast("long"))
    wanted = counts.select("*", asked).select(F.col("_by").alias("_own"), F.col("_cell").alias("_in"), F.col("_at.i").alias("_i"), (rank - F.col("_to") + F.col("_n")).alias("_rank"), "_n").where("_rank > 0 and _rank <= _n").drop("_n")
    cells = wanted.select("_own", "_in").distinct()
    same = F.col("_by").eqNullSafe(F.col("_own")) & (F.col("_cell") == F.col("_in"))
    few = marked.join(F.broadcast(cells), same).groupBy("_by", "_cell", "_x").agg(F.count("*").alias("_n"))
    last = few.withColumn("_to", F.sum("_n").over(Window.partitionBy("_by", "_cell").orderBy("_x")))
    found = last.join(F.broadcast(wanted), same & (F.col("_rank") <= F.col("_to")) & (F.col("_rank") > F.col("_to") - F.col("_n")))
    return found.groupBy(F.col("_by").alias(by)).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda v: v["_x"]).alias("values"))  # a value for each point


def summaries(rows: DataFrame, date: Column, fields: Sequence[str], ranges: DataFrame, top: int = 10, points: Sequence[float] = POINTS) -> DataFrame:
    """For each range: count, and of each field average, population deviation, median, largest values and percentiles.

    Medians and percentiles are values of the data (discrete); averages are rounded half to even. The largest values come from
    a top-k by window, whose rank limit Spark applies before the shuffle, so no list of all values is built.
    """
    inside = rows.join(F.broadcast(ranges), (date >= F.col("lo")) & (date < F.col("hi")))  # a row for each range
    aggs = [F.count("*").alias("count")]
    for f in fields:
        aggs += [F.bround(F.avg(f), 0).cast("long").alias(f"{f}_avg"), F.bround(F.stddev_pop(f), 0).cast("long").alias(f"{f}_std")]
    out = inside.groupBy("range_start").agg(*aggs)
    for f in fields:
        none = F.array_repeat(F.lit(None).cast(inside.schema[f].dataType), len(points))
        values = percentiles_disc(inside, "range_start", f, [0.5, *points])
        out = out.join(values, "range_start", "left").withColumns({f"{f}_median": F.col("values")[0], f"{f}_percentile": F.coalesce(F.slice("values", 2, len(points)), none)}).drop("values")
    for f in fields:
        w = Window.partitionBy("range_start").orderBy(F.desc_nulls_last(f))
        best = inside.where(F.col(f).isNotNull()).select("range_start", f).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= top)
        lists = best.groupBy("range_start").agg(F.sort_array(F.collect_list(f), asc=False).alias(f"{f}_maxn"))  # `top` values
        out = out.join(lists, "range_start", "left")
    return out


def summaries_approx(rows: DataFrame, date: Column, fields: Sequence[str], ranges: DataFrame, points: Sequence[float] = POINTS, accuracy: int = 10_000) -> DataFrame:
    """As summaries() with percentiles from bounded sketches."""
    inside = rows.join(F.broadcast(ranges), (date >= F.col("lo")) & (date < F.col("hi")))
    return inside.groupBy("range_start").agg(F.count("*").alias("count"), *[F.percentile_approx(f, list(points), accuracy).alias(f"{f}_percentile") for f in fields])


def ratio(field: Column, views: Column) -> Column:
    return F.when(views <= 0, 0.0).otherwise(F.try_divide(field * 100, views))


def bucket(x: Column, edges: Sequence[float] = EDGES) -> Column:
    """The lower edge of the half-open bucket as a text, "others" outside of all."""
    out = None
    for lo, hi in zip(edges, edges[1:]):
        test, label = (x >= lo) & (x < hi), str(int(lo))
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise("others")


def ratio_buckets(rows: DataFrame, views: str, field: str, edges: Sequence[float] = EDGES, digits: int = 4) -> DataFrame:
    """By bucket of views: extremes and count of views, and average, deviation, median of the field's share in percent."""
    r = rows.select(F.col(views).alias("_v"), ratio(F.col(field), F.col(views)).alias("_r")).withColumn("bucket", bucket(F.col("_v"), edges))
    out = r.groupBy("bucket").agg(
        F.min("_v").alias("view_min"), F.max("_v").alias("view_max"), F.count("*").alias("count"), F.bround(F.avg("_r"), digits).alias("ratio_avg"),
        F.bround(F.stddev_pop("_r"), digits).alias("ratio_std"),
    )
    medians = percentiles_disc(r, "bucket", "_r", [0.5]).select("bucket", F.bround(F.col("values")[0], digits).alias("ratio_median"))
    return out.join(medians, "bucket", "left")


def group_counts(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("count")).orderBy(F.desc("count"), *keys)


def predicate_counts(rows: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """How many rows each named predicate holds for, in one pass: (name, doc_count)."""
    counted = rows.agg(F.array(*[F.struct(F.lit(k).alias("name"), F.count_if(v).alias("doc_count")) for k, v in tests.items()]).alias("r"))
    return counted.select(F.explode("r").alias("r")).select("r.name", "r.doc_count")


# --- shards ----------------------------------------------------------------------------------------------------------


def assign_units(units: Sequence[tuple[str, int]], shards: int) -> list[int]:
    """Shard of each (region, count), largest first: least imbalance, then fewest regions in a shard, then fewest splits.

    A pure function for the small table of region totals; the three costs are kept up to date, not computed anew.
    """
    order = sorted(range(len(units)), key=lambda i: -units[i][1])
    target = sum(n for _, n in units) / shards if shards else 0
    totals, regions, spread, out = [0] * shards, [set() for _ in range(shards)], {}, [0] * len(units)
    for i in order:
        region, n = units[i]
        best = None
        for s in range(shards):
            new = region not in regions[s]
            cost = (abs(totals[s] + n - target) - abs(totals[s] - target), int(new), int(new and spread.get(region, 0) > 0), s)
            best = min(best, cost) if best else cost
        s = best[-1]
        totals[s] += n
        if region not in regions[s]:
            spread[region] = spread.get(region, 0) + 1
        regions[s].add(region)
        out[i] = s
    return out


def assigned(counts: DataFrame, shards: int, region: str = "region") -> DataFrame:
    """Adds `shard` to a table of a few region totals (it must fit the driver)."""
    rows = counts.orderBy(F.desc("count"), *[c for c in counts.columns if c != "count"]).collect()
    found = assign_units([(r[region], r["count"]) for r in rows], shards)
    schema = T.StructType([*counts.schema.fields, T.StructField("shard", T.IntegerType())])
    return counts.sparkSession.createDataFrame([(*r, s) for r, s in zip(rows, found)], schema)


def shard_summary(units: DataFrame, region: str = "region") -> DataFrame:
    return units.groupBy("shard").agg(F.sum("count").alias("total"), F.array_sort(F.collect_set(region)).alias("regions"), F.count("*").alias("units"))


def shard_plans(total: int, workers: int, skip: int = 0, most: int | None = None) -> list[tuple[int, int, int]]:
    """(number, rows to skip, rows to take) of equal slices; the last is shorter, empty ones are left out."""
    left = max(0, total - skip) if most is None else min(max(0, total - skip), most)
    size = -(-left // workers) if left else 0
    return [(i, skip + i * size, min(size, left - i * size)) for i in range(workers) if size and left - i * size > 0]


def take_slice(rows: DataFrame, order: Sequence[Column], skip: int, most: int) -> DataFrame:
    return rows.orderBy(*order).offset(skip).limit(most)


def progress(statuses: DataFrame) -> DataFrame:
    """Shards by state, and documents done of all in percent."""
    return statuses.agg(
        F.count("*").alias("shards"), F.count_if(F.col("state") == "done").alias("done"), F.sum("processed_docs").alias("processed"), F.sum("total_docs").alias("total"),
        F.bround(F.try_divide(F.sum("processed_docs") * 100, F.sum("total_docs")), 2).alias("percent"),
    )

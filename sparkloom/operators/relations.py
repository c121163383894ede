"""Filters, joins and set operations on keyed tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: the ranks that a ranked list of hits is thinned to
PICKS = (1, 2, 3, 4, 5, 10, 20, 30, 40, 50)


def field_filter(field: str, values: object | Sequence[object] | None, reverse: bool = False) -> Column | None:
    """Equality or membership; reversed, rows without the field stay. None without values: no filter."""
    many = list(values) if isinstance(values, (list, tuple, set)) else [values]
    many = [v for v in many if v is not None]
    if not many:
        return None
    test = F.col(field) == many[0] if len(many) == 1 else F.col(field).isin(many)
    return ~test | F.col(field).isNull() if reverse else test


def any_of(filters: Sequence[Column | None]) -> Column | None:
    left = [f for f in filters if f is not None]
    return reduce(or_, left) if left else None


def apply(rows: DataFrame, test: Column | None) -> DataFrame:
    return rows if test is None else rows.where(test)


def between(field: str, lo=None, hi=None) -> Column | None:
    """[lo, hi), either end open if None."""
    tests = [t for t in (F.col(field) >= F.lit(lo) if lo is not None else None, F.col(field) < F.lit(hi) if hi is not None else None) if t is not None]
    return reduce(lambda a, b: a & b, tests) if tests else None


def regions(tests: Mapping[str, Column]) -> Column:
    """Names of all groups that a row belongs to; groups may overlap."""
    return F.array_compact(F.array(*[F.when(t, n) for n, t in tests.items()]))


def by_region(rows: DataFrame, tests: Mapping[str, Column]) -> DataFrame:
    """One row for each group of a row, in one scan."""
    return rows.withColumn("region", F.explode(regions(tests)))


def recent(field: str, now: int, days: int) -> Column:
    """Epoch seconds within `days` before a given now."""
    return F.col(field) >= now - days * 86_400


def present(*fields: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f).isNotNull() for f in fields])


def look_up(rows: DataFrame, other: DataFrame, on: str) -> DataFrame:
    """Inner, a row for each match."""
    return rows.join(other, on)


def look_up_ids(rows: DataFrame, other: DataFrame, ids: DataFrame, on: str, needed: Sequence[str] = ()) -> DataFrame:
    """As look_up() for given ids, with fields that the other side must have."""
    right = other.where(present(*needed)) if needed else other
    return rows.join(ids.select(on).distinct(), on, "left_semi").join(right, on)


def done(rows: DataFrame, existing: DataFrame, on: str) -> DataFrame:
    return rows.join(existing.select(on), on, "left_semi").dropDuplicates([on])


def to_do(rows: DataFrame, existing: DataFrame, on: str) -> DataFrame:
    return rows.join(existing.select(on), on, "left_anti").dropDuplicates([on])


def to_do_first(rows: DataFrame, existing: DataFrame, on: str, order: Sequence[Column], quota: int) -> DataFrame:
    return to_do(rows, existing, on).orderBy(*order).limit(quota)


def dictionary(rows: DataFrame, table: DataFrame, on: str) -> DataFrame:
    """Left: unknown keys have nulls."""
    return rows.join(table, on, "left")


def exists(keys: DataFrame, table: DataFrame, on: str) -> DataFrame:
    seen = table.select(on).distinct().withColumn("exists", F.lit(True))
    return keys.join(seen, on, "left").withColumn("exists", F.coalesce("exists", F.lit(False)))


def zip_lists(rows: DataFrame, *lists: str) -> DataFrame:
    """A row for each place of parallel lists, with its place from 0."""
    return rows.select(*[c for c in rows.columns if c not in lists], F.posexplode(F.arrays_zip(*lists)).alias("place", "_z")).select("*", *[F.col(f"_z.{x}").alias(x) for x in lists]).drop("_z")


def latest(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row for each key, the last by order: a struct maximum, so that no window holds a key's rows."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*rows.columns)


def upserted(table: DataFrame, batches: Sequence[DataFrame], key: str) -> DataFrame:
    """The table after batches of rows in order; of a key the last batch's row stays."""
    every = reduce(DataFrame.unionByName, [t.withColumn("_batch", F.lit(i)) for i, t in enumerate([table, *batches])])
    return latest(every, key, ["_batch"]).drop("_batch")


def flattened(rows: DataFrame, drop: Sequence[str] = ()) -> DataFrame:
    """Struct fields as columns named outer_inner; some left out by their dotted names."""
    out = []
    for f in rows.schema.fields:
        if hasattr(f.dataType, "fields"):
            out += [F.col(f"{f.name}.{g}").alias(f"{f.name}_{g}") for g in f.dataType.fieldNames() if f"{f.name}.{g}" not in drop]
        elif f.name not in drop:
            out.append(F.col(f.name))
    return rows.select(*out)


def ordered_values(fields: Sequence[str]) -> Column:
    """A fixed array of numbers, missing ones 0."""
    return F.array(*[F.coalesce(F.col(f), F.lit(0)).cast("long") for f in fields])


def ranked_picks(rows: DataFrame, by: str, order: Sequence[Column], picks: Sequence[int] = PICKS) -> DataFrame:
    """Rows at the given ranks of each group."""
    from pyspark.sql import Window

    w = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(picks)).where(F.col("rank").isin(list(picks)))


def numbered(rows: DataFrame, order: Sequence[Column], by: str | None = None, name: str = "_rank") -> DataFrame:
    """Adds the place of each row from 0 in the order, of all rows or of those of its group, without one task for a group.

    The rows are sorted into slices, stored with the number of their slice, counted by slice, and numbered within it.
    """
    from pyspark.sql import Window

    from ..sources import tables

    own = F.col(by) if by else F.lit(0)
    n = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sliced = tables.stored(rows.repartitionByRange(n, *([own] if by else []), *order).withColumn("_slice", F.spark_partition_id()), "slices")
    counts = sliced.groupBy(own.alias("_own"), F.col("_slice").alias("_at")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_own").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(counts.select("_own", "_at", before.alias("_before")))  # a row for each slice and group in it
    place = F.row_number().over(Window.partitionBy("_slice", own).orderBy(*order)) - 1
    out = sliced.withColumn("_place", place).join(offsets, (F.col("_slice") == F.col("_at")) & own.eqNullSafe(F.col("_own")))
    return out.select(*rows.columns, (F.col("_place") + F.col("_before")).alias(name))


def stratified(rows: DataFrame, n: int, order: Sequence[Column], id_: str, seed: int) -> DataFrame:
    """One row of each of n rank intervals of equal size, by a seeded hash."""
    ranked = numbered(rows, order, name="_r")
    cut = ranked.crossJoin(F.broadcast(ranked.agg(F.count("*").alias("_n")))).withColumn("stratum", F.floor(F.col("_r") * n / F.col("_n")))  # one row
    rest = [c for c in rows.columns]
    return cut.groupBy("stratum").agg(F.min_by(F.struct(*rest), F.struct(F.xxhash64(F.lit(seed), id_), F.col(id_))).alias("_x")).select("stratum", "_x.*")


def intersect_size(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))

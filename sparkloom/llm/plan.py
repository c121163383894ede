"""Plan helpers shared by the operators here: shared storage, semi-joins and global order."""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_INTEGERS = ("tinyint", "smallint", "int", "bigint")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it.

    Only where that is unset and the session runs in one process, as in tests, it is a temporary folder of the
    session; on a cluster an unset folder is an error, as executors would write each to its own disk.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = os.path.join(os.environ.get("TMPDIR", "/tmp"), f"sparkloom-{spark.sparkContext.applicationId}")
    return f"file://{own}"


def whole_ids(df: DataFrame, on: str) -> Column:
    """The id column as long; only whole numbers are ids here."""
    kind = dict(df.dtypes)[on]
    if kind not in _INTEGERS and kind != "void":
        raise TypeError(f"ids are whole numbers; {on!r} is {kind}")
    return df[on].cast("long")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read back: computed once, and safe when an executor is lost."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def running(df: DataFrame, order: Sequence[Column], sums: dict[str, Column], name: str, partitions: int | None = None) -> tuple[DataFrame, dict[str, int]]:
    """Global order and running sums without a one-task window: a range sort, sums within each partition, then offsets.

    Adds for each key of `sums` the sum of its expression over all rows before in `order`. Every partition is a slice of the
    range sort, so a hot key is split; the driver sees one row for each partition only. Also returns the totals. The order
    must be total but for equal rows, which are split over partitions too (by their place in the input).
    """
    spark = df.sparkSession
    n = partitions or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")) // 2)
    flat = df.withColumns({f"_v_{k}": v for k, v in sums.items()}).withColumn("_tie", F.monotonically_increasing_id())
    order = [*order, F.col("_tie")]
    ranged = flat.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id())
    # the partition number is part of the stored rows, so the window below has one task for each slice
    sliced = stored(ranged, name)
    totals = {r["_part"]: r for r in sliced.groupBy("_part").agg(*[F.sum(f"_v_{k}").alias(k) for k in sums]).collect()}
    before, offsets = dict.fromkeys(sums, 0), []
    for part in sorted(totals):
        offsets.append((part, *[before[k] for k in sums]))
        for k in sums:
            before[k] += totals[part][k] or 0
    if not offsets:
        return sliced.drop("_part", "_tie").withColumnsRenamed({f"_v_{k}": k for k in sums}), before
    at = spark.createDataFrame(offsets, "_part int, " + ", ".join(f"_o_{k} long" for k in sums))
    w = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = sliced.withColumns({f"_r_{k}": F.coalesce(F.sum(f"_v_{k}").over(w), F.lit(0)).cast("long") for k in sums})
    out = out.join(F.broadcast(at), "_part")  # as many rows as partitions
    return out.select(*[c for c in df.columns if c not in sums], *[(F.col(f"_r_{k}") + F.col(f"_o_{k}")).alias(k) for k in sums]), before


def join_skewed(rows: DataFrame, groups: DataFrame, on: str, count: str, total: int) -> DataFrame:
    """Inner join of rows with their groups (a stored table), where one key may hold a third of all rows.

    Groups of more than a thousandth of the rows are under a thousand, so they are broadcast; the others are shuffled.
    """
    hot = groups.where(F.col(count) * 1000 > total)
    marked = rows.join(F.broadcast(hot), on)
    cold = rows.join(F.broadcast(hot.select(on)), on, "left_anti").join(groups.where(F.col(count) * 1000 <= total), on)
    return marked.unionByName(cold)

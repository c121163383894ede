"""Incremental builds as streams: new keys are appended once, rows are upserted, and what has been done is kept in a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def source(spark: SparkSession, folder: str, schema, files: int | None = None) -> DataFrame:
    """Parquet files of a folder as they arrive, `files` at most in a batch."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(folder)


def _known(spark: SparkSession, path: str, schema) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def append_new(stream: DataFrame, key: str, path: str, checkpoint: str, make: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Appends rows whose key isn't at `path` yet, after `make`; a batch that is run again appends nothing twice."""
    schema = make(stream).schema

    def one(batch: DataFrame, number: int) -> None:
        known = _known(batch.sparkSession, path, schema).select(key)
        fresh = batch.dropDuplicates([key]).join(known, key, "left_anti")
        make(fresh).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert(stream: DataFrame, key: str, order: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """Keeps the last row of each key; each batch writes the next version of the table and a read takes the last whole one."""
    from ..operators.relations import latest

    schema = stream.schema

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = _known(spark, f"{path}/version={number - 1}", schema)
        latest(before.unionByName(batch), key, order).write.mode("overwrite").parquet(f"{path}/version={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str, by: str, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts in tumbling windows, closed once the watermark has passed."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size), by).count()


def distinct_within(stream: DataFrame, key: str, time: str, late: str = "2 hours") -> DataFrame:
    """Each key once within the watermark; state is dropped behind it."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])

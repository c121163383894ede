"""Scans and sinks: Parquet datasets, frequency and vocabulary tables, passages, shards and keyed stores."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FREQUENCY = "token string, doc_freq bigint, term_freq bigint"
TOKEN_CACHE = "bvid string, ptid bigint, tid bigint, sentence string, tokens array<string>"
PASSAGE = (
    "query string, query_idx bigint, doc_freq bigint, return_hits bigint, total_hits bigint, "
    "hits array<struct<bvid:string,title:string,tags:string,desc:string,owner_name:string,stat_favorite:bigint,elastic_score:double,elastic_score_rank:int>>"
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = "file://" + os.path.join(os.environ.get("TMPDIR", "/tmp"), f"sparkloom-{spark.sparkContext.applicationId}")
    return f"{shared}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to a new shared folder and read back: computed once."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dataset(spark: SparkSession, folder: str, prefix: str = "", schema: str | None = None) -> DataFrame:
    """All Parquet files under a folder whose names start with a prefix."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.option("recursiveFileLookup", True).option("pathGlobFilter", f"{prefix}*.parquet").parquet(folder)


def n_rows(df: DataFrame) -> int:
    """A scan of no columns, which reads footers only."""
    return df.select().count()


def n_rows_estimated(spark: SparkSession, name: str) -> int | None:
    """From statistics of a catalogue table, if it has any."""
    rows = spark.sql(f"describe extended {name}").where("col_name = 'Statistics'").collect()
    found = [part for r in rows for part in r[1].split(", ") if part.endswith(" rows")]
    return int(found[0].split()[0]) if found else None


def batches(df: DataFrame, column: str, size: int) -> Iterator[list]:
    """Lists of values of one column, streamed a partition at a time."""
    held = []
    for row in df.select(column).toLocalIterator():
        held.append(row[0])
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def rows(df: DataFrame) -> Iterator[dict]:
    for row in df.toLocalIterator():
        yield row.asDict(recursive=True)


def collection(df: DataFrame, test: Column | None = None, fields: Sequence[str] = (), order: Sequence[Column] = (), skip: int = 0, most: int | None = None) -> DataFrame:
    """Filter, sort, skip, limit and project, as a document store's cursor does; dotted fields reach into structs."""
    out = df if test is None else df.where(test)
    out = out.orderBy(*order) if order else out
    out = out.offset(skip) if skip else out
    out = out.limit(most) if most is not None else out
    return out.select(*[F.col(f).alias(f.replace(".", "_")) for f in fields]) if fields else out


def read_frequencies(spark: SparkSession, paths: str | list[str], most: int | None = None) -> DataFrame:
    """CSV with a header; "null" and "nan" are words like others. The limit takes the most frequent ones."""
    df = spark.read.schema(FREQUENCY).option("header", True).option("nullValue", "\0").option("emptyValue", "").option("escape", '"').csv(paths)
    return df.orderBy(F.desc("doc_freq"), F.desc("term_freq"), "token").limit(most) if most else df


def write_frequencies(freqs: DataFrame, path: str) -> None:
    """Range-partitioned and sorted, so that files in name order are in order as a whole."""
    freqs.orderBy(F.desc("doc_freq"), F.desc("term_freq"), "token").write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def read_words(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("word")).where("word <> ''")


def read_pieces(spark: SparkSession, path: str, source: str, is_wiki: bool = False) -> DataFrame:
    """(source, is_wiki, rank, piece, score) from lines of piece and score; the rank is the place in the file, by score and piece."""
    parts = F.split("value", "\\s+")
    df = spark.read.text(path).where(F.trim("value") != "").select(parts[0].alias("piece"), F.try_element_at(parts, F.lit(2)).cast("double").alias("score"))
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("score"), "piece")) - 1
    return df.withColumn("source", F.lit(source)).withColumn("is_wiki", F.lit(is_wiki)).withColumn("rank", rank).select("source", "is_wiki", "rank", "piece", "score")


def piece_table(spark: SparkSession, pieces: Sequence[tuple[str, float]], source: str, is_wiki: bool = False) -> DataFrame:
    """A vocabulary in memory, with its places as ranks."""
    data = [(source, is_wiki, i, p, float(s)) for i, (p, s) in enumerate(pieces)]
    return spark.createDataFrame(data, "source string, is_wiki boolean, rank int, piece string, score double")


def write_vocab(pieces: DataFrame, path: str, form: str = "vocab") -> None:
    """Lines of piece and score, of words, or of statistics as JSON, in order."""
    if form == "json":
        pieces.write.mode("overwrite").json(path)
    elif form == "txt":
        pieces.select("word").write.mode("overwrite").text(path)
    else:
        pieces.select(F.concat_ws("\t", "piece", F.col("score").cast("string"))).write.mode("overwrite").text(path)


def read_passages(spark: SparkSession, path: str) -> DataFrame:
    """One row for each hit of each query."""
    df = spark.read.schema(PASSAGE).json(path)
    return df.select("query", "query_idx", "doc_freq", F.posexplode("hits").alias("hit_idx", "hit")).select("query", "query_idx", "doc_freq", "hit_idx", "hit.*")


def append(df: DataFrame, path: str, rows_per_file: int = 100_000) -> None:
    df.write.option("maxRecordsPerFile", rows_per_file).mode("append").parquet(path)


def replace(df: DataFrame, path: str, confirmed: bool = False) -> None:
    if not confirmed:
        raise ValueError("replacing a dataset must be confirmed")
    df.write.mode("overwrite").parquet(path)


def replace_keys(df: DataFrame, path: str, key: str) -> None:
    """Writes the partitions of the keys that are there and leaves others as they are."""
    df.write.option("partitionOverwriteMode", "dynamic").partitionBy(key).mode("overwrite").parquet(path)


def write_samples(df: DataFrame, path: str, shard_size: int, number: str = "sample_idx") -> None:
    """Samples in shards of equal size by their number."""
    df.withColumn("shard_idx", F.floor(F.col(number) / shard_size).cast("int")).write.partitionBy("shard_idx").mode("append").parquet(path)


def read_samples(spark: SparkSession, path: str, start: int, stop: int, shard_size: int, number: str = "sample_idx") -> DataFrame:
    """Samples [start, stop); only their shards are read."""
    df = spark.read.parquet(path)
    return df.where(F.col("shard_idx").between(start // shard_size, max(start, stop - 1) // shard_size) & (F.col(number) >= start) & (F.col(number) < stop))


def get_many(store: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """Values of keys, null for those that aren't there."""
    return keys.join(store, key, "left")


def compact(spark: SparkSession, source: str, target: str, files: int, order: str | None = None) -> None:
    """The same rows in fewer files, sorted within each where a key is given."""
    df = spark.read.parquet(source)
    (df.repartitionByRange(files, order).sortWithinPartitions(order) if order else df.repartition(files)).write.mode("overwrite").parquet(target)


def create_table(spark: SparkSession, name: str, schema: T.StructType | str, partition_by: Sequence[str] = ()) -> None:
    columns = schema if isinstance(schema, str) else ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(f"create table if not exists {name} ({columns}) using parquet" + (f" partitioned by ({', '.join(partition_by)})" if partition_by else ""))


def arrow_batches(df: DataFrame) -> list[pa.RecordBatch]:
    """A bounded result as Arrow, for consumers in this process."""
    return df.toArrow().to_batches()

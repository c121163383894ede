"""Nearest neighbours, all pairs above a similarity, and training triplets, by blocks of a matrix product.

The query side is cut into blocks of bounded size; every block meets all rows of the other side as they are streamed, in one
pass for each group of blocks, so neither side has to fit a task and no pair is made as a row unless it is kept.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import relations

#: vectors of a block of queries: 8,192 x 1,024 floats are 64 MB
BLOCK = 8192
#: rows that meet a block at a time: 8,192 x 512 doubles are 32 MB
ROWS = 512


def _unit(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


class Best:
    """For each of some queries the k names of the least cost, ties by name; `bar` is what a cost must not exceed to count."""

    def __init__(self, ids: np.ndarray, k: int, with_self: bool = False):
        self.ids, self.k, self.with_self, self.bar = ids, k, with_self, np.full(len(ids), np.inf)
        self.held: tuple[np.ndarray, ...] | None = None

    def add(self, q: np.ndarray, cost: np.ndarray, names: np.ndarray) -> None:
        if not self.with_self:
            other = names != self.ids[q]
            q, cost, names = q[other], cost[other], names[other]
        if not len(q):
            return
        if self.held:
            q, cost, names = (np.concatenate(x) for x in zip(self.held, (q, cost, names)))
        order = np.lexsort((np.unique(names, return_inverse=True)[1], cost, q))
        q = q[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        kept = rank < self.k
        order, q, rank = order[kept], q[kept], rank[kept]
        self.held = q, cost[order], names[order]
        last = rank == self.k - 1
        self.bar[q[last]] = self.held[1][last]

    def narrowed(self, cost: np.ndarray, slack: float = 0.0) -> np.ndarray:
        """The bars for a matrix of costs (a row for each query), lowered where the matrix alone has k better ones besides the query itself."""
        loose = ~np.isfinite(self.bar)
        if loose.any() and cost.shape[1] > self.k:
            bar = self.bar.copy()
            bar[loose] = np.partition(cost[loose], self.k, axis=1)[:, self.k]
            return bar + slack
        return self.bar + slack

    def batch(self, name: str, kind: pa.DataType, cost: str, sign: float) -> Iterator[pa.RecordBatch]:
        if self.held:
            q, c, names = self.held
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[q]).cast(kind), pa.array(names).cast(kind), pa.array(sign * c)], ["query", name, cost])


def _names(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """As functions.vectors.rounded()."""
    y = x * 10.0**digits
    near = np.rint(y)
    return np.where(np.abs(y - near) == 0.5, y + np.sign(y) * 0.5, near) / 10.0**digits


def in_blocks(queries: DataFrame, block: int) -> Iterator[pa.Table]:
    """The rows of (query, …) on the driver, about `block` at a time, by a hash of `query`."""
    n = queries.count()
    for b in range(max(1, -(-n // block))):
        yield (queries if n <= block else queries.where(F.pmod(F.xxhash64("query"), F.lit(-(-n // block))) == b)).toArrow()


def best_of(found: Sequence[DataFrame], order: Column, id_: str, k: int) -> DataFrame:
    """The k first rows of each query of what the tasks kept, with their rank."""
    w = Window.partitionBy("query").orderBy(order, id_)
    return reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest(queries: DataFrame, rows: DataFrame, k: int, id_: str = "id", vector: str = "vector", with_self: bool = False, block: int = BLOCK, digits: int | None = None) -> DataFrame:
    """(query, id, similarity, rank): the k most similar rows of each query by cosine, exactly; ties by id.

    Each task keeps k candidates for each query of the block, so the final ranking sees k rows for each task and query. A product
    is looked at only where it reaches the least that its query keeps so far.
    """
    q = queries.where(F.col(vector).isNotNull()).select(F.col(id_).alias("query"), F.col(vector).alias("_v"))
    r = rows.where(F.col(vector).isNotNull()).select(id_, F.col(vector).alias("_v"))
    kind = dict(rows.dtypes)[id_]
    slack = 0.0 if digits is None else 2 * 10.0**-digits
    found = []
    for held in in_blocks(q, block):
        ids, m = _names(held.column("query").combine_chunks()) if held.num_rows else np.zeros(0), _unit(held.column("_v").combine_chunks() if held.num_rows else pa.array([], pa.list_(pa.float64())))
        shared = rows.sparkSession.sparkContext.broadcast((ids, m))

        def best(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, m = shared.value
            kept, name = Best(ids, k, with_self), None
            for batch in batches:
                name = batch.schema.field(0).type
                for i in range(0, batch.num_rows if len(ids) else 0, ROWS):
                    own = batch.slice(i, ROWS)
                    cost = m @ -_unit(own.column(1)).T
                    at, to = np.nonzero(cost <= kept.narrowed(cost, slack)[:, None])
                    c = cost[at, to]
                    kept.add(at, c if digits is None else rounded(c, digits), _names(own.column(0))[to])
            yield from kept.batch(id_, name, "similarity", -1.0)

        found.append(r.mapInArrow(best, f"query {kind}, {id_} {kind}, similarity double"))
    return best_of(found, F.desc("similarity"), id_, k)


def similar_pairs(rows: DataFrame, least: float, id_: str = "id", vector: str = "vector", block: int = BLOCK) -> DataFrame:
    """(a, b, similarity) for all a < b with at least that cosine; a block at a time against all rows."""
    r = rows.where(F.col(vector).isNotNull()).select(id_, F.col(vector).alias("_v"))
    kind = dict(rows.dtypes)[id_]
    n = r.count()
    out = None
    for b in range(max(1, -(-n // block))):
        held = (r if n <= block else r.where(F.pmod(F.xxhash64(id_), F.lit(-(-n // block))) == b)).toArrow()
        shared = rows.sparkSession.sparkContext.broadcast((np.array(held.column(0).to_pylist()), _unit(held.column("_v").combine_chunks()) if held.num_rows else np.zeros((0, 1))))

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, m = shared.value
            for batch in batches:
                for i in range(0, batch.num_rows, 1024):
                    own = batch.slice(i, 1024)
                    if not len(ids) or not own.num_rows:
                        continue
                    names = np.array(own.column(0).to_pylist())
                    sims = m @ _unit(own.column(1)).T
                    x, y = np.nonzero((sims >= least) & (ids[:, None] < names[None, :]))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[x]).cast(own.schema.field(0).type), pa.array(names[y]).cast(own.schema.field(0).type), pa.array(sims[x, y])], ["a", "b", "similarity"])

        one = r.mapInArrow(meet, f"a {kind}, b {kind}, similarity double")
        out = one if out is None else out.unionByName(one)
    return out


def triplets(rows: DataFrame, positives: int, order: str, id_: str = "id", vector: str = "vector", digits: int | None = None) -> DataFrame:
    """(sample_idx, anchor, pos_ids, neg_id): nearest rows as positives, the anchor of the sample before as negative (of the first, the next's)."""
    near = nearest(rows, rows, positives, id_, vector, digits=digits)
    lists = near.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", id_))), lambda x: x[id_]).alias("pos_ids"))
    full = lists.where(F.size("pos_ids") == positives)  # `positives` values
    at = rows.select(F.col(id_).alias("query"), F.col(order).alias("_order")).join(full, "query")
    numbered = relations.numbered(at.select("query", "pos_ids", "_order"), [F.col("_order"), F.col("query")], name="sample_idx")
    # the neighbour in order is an equi-join on the number, so only ids go through the ordered window
    other = numbered.select((F.col("sample_idx") + 1).alias("sample_idx"), F.col("query").alias("_before"))
    second = numbered.where("sample_idx = 1").select(F.lit(0).cast("long").alias("sample_idx"), F.col("query").alias("_after"))
    return numbered.join(other, "sample_idx", "left").join(F.broadcast(second), "sample_idx", "left").select(
        "sample_idx", F.col("query").alias("anchor"), "pos_ids", F.coalesce("_before", "_after").alias("neg_id")
    )


def most_similar(positive: DataFrame, negative: DataFrame, rows: DataFrame, k: int, vector: str = "vector", token: str = "token", first: int | None = None, order: str | None = None) -> DataFrame:
    """The k tokens nearest to the mean of the unit positive vectors less the unit negative ones, given tokens left out; of the `first` by order."""
    from ..functions import vectors as V
    from .weights import pooled

    signed = positive.select(token, V.normalised(F.col(vector)).alias(vector)).unionByName(negative.select(token, F.transform(V.normalised(F.col(vector)), lambda x: -x).alias(vector)))
    query = pooled(signed.withColumn("_one", F.lit("query")), "_one", vector).select(F.col("_one").alias(token), vector)
    pool = rows.orderBy(order).limit(first) if first and order else rows
    pool = pool.join(F.broadcast(signed.select(token).distinct()), token, "left_anti")  # the words that were asked for
    return nearest(query, pool, k, token, vector).select(token, "similarity", "rank")

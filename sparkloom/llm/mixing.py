"""Mixing sources to target weights (10): min-cost flow for overlapping sources.

A document may belong to several sources. Documents are aggregated by membership pattern (the set of their sources); a flow
network then routes word capacity from patterns to source quotas. Each pattern offers its words once at cost 0, a second time
at cost 1, a third at cost 4 and so on (convex), so words are repeated only where a quota can't be met otherwise, and evenly.
The flow of a pattern fixes how often its documents are taken: all of them the same whole number of times, and those that
come first in a seeded hash order once more, until the pattern's flow is met as nearly as whole documents allow.

The driver sees one row for each source and pattern. The place at which a pattern is cut is found in a histogram of hashes of
fixed size; only the documents of the one histogram bin in which a cut falls are sorted.

Defined cases: a null or empty text has size 0; a null source is a source, the last; a membership is a set, whatever its
order and repeats; an empty or null one takes part in nothing; repeated rows are taken like any others, even if a third of all rows are the same; an empty table gives an empty
result; other columns are passed on by resample() and not read by taken().
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .plan import running, stored
from .quality_rules import free_name

BINS = 1 << 12
#: words are counted by what is left when each is cut to its first character
WORD, SPACE = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.length(F.regexp_replace(F.regexp_replace(text, WORD, "w"), SPACE, "")), F.lit(0)).cast("long")


class Flow:
    """Min-cost flow with integral capacities, by successive shortest paths with potentials."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.left: list[int] = []
        self.cost: list[int] = []

    def arc(self, a: int, b: int, capacity: int, cost: int) -> int:
        for x, y, c, w in ((a, b, capacity, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.left.append(c)
            self.cost.append(w)
        return len(self.to) - 2

    def run(self, source: int, sink: int) -> int:
        n, total = len(self.out), 0
        potential = [0] * n
        while True:
            far: list[float] = [float("inf")] * n
            via = [-1] * n
            far[source] = 0
            heap = [(0, source)]
            while heap:
                d, a = heapq.heappop(heap)
                if d > far[a]:
                    continue
                for e in self.out[a]:
                    if self.left[e] > 0 and (to := d + self.cost[e] + potential[a] - potential[self.to[e]]) < far[self.to[e]]:
                        far[self.to[e]] = to
                        via[self.to[e]] = e
                        heapq.heappush(heap, (to, self.to[e]))
            if via[sink] < 0:
                return total
            potential = [p + (d if d < float("inf") else 0) for p, d in zip(potential, far)]
            push, a = None, sink
            while a != source:
                push = self.left[via[a]] if push is None else min(push, self.left[via[a]])
                a = self.to[via[a] ^ 1]
            a = sink
            while a != source:
                self.left[via[a]] -= push
                self.left[via[a] ^ 1] += push
                a = self.to[via[a] ^ 1]
            total += push


def water_fill(sizes: Sequence[int], weights: Sequence[float], total: float, most: float) -> list[float]:
    """Shares of the total by weight, none above `most` times its size; what is cut off is shared again by weight.

    Shares only grow as others are cut off, so they fill up in the order of their limit by weight: one pass.
    """
    out, left, weight = [0.0] * len(sizes), float(total), float(sum(weights))
    for i in sorted(range(len(sizes)), key=lambda i: (most * sizes[i] / weights[i], i)):
        share = left * weights[i] / weight
        out[i] = min(share, float(most * sizes[i]))
        if share > most * sizes[i]:
            left -= out[i]
            weight -= weights[i]
    return out


def route(patterns: Sequence[tuple[int, Sequence[int]]], quotas: Sequence[float], most: int) -> list[int]:
    """Words that each pattern (size, sources) gives in the cheapest flow to the quotas.

    Patterns and sources that aren't connected by overlaps are networks of their own; so where each document has one source,
    any number of sources takes time in proportion.
    """
    root = list(range(len(quotas)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for _, sources in patterns:
        for s in sources[1:]:
            root[find(s)] = find(sources[0])
    nets: dict[int, tuple[list[int], dict[int, int]]] = {}
    for p, (_, sources) in enumerate(patterns):
        own, places = nets.setdefault(find(sources[0]), ([], {}))
        own.append(p)
        for s in sources:
            places.setdefault(s, len(places))
    out = [0] * len(patterns)
    for own, places in nets.values():
        n, m = len(own), len(places)
        net = Flow(n + m + 2)
        first = []
        for k, p in enumerate(own):
            size, sources = patterns[p]
            first.append([net.arc(n + m, k, int(size), r * r) for r in range(most)])
            for s in sources:
                net.arc(k, n + places[s], int(size) * most, 0)
        for s, k in places.items():
            net.arc(n + k, n + m + 1, round(quotas[s]), 0)
        net.run(n + m, n + m + 1)
        for p, arcs in zip(own, first):
            out[p] = sum(net.left[e ^ 1] for e in arcs)
    return out


def plan(rows: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: int = 2) -> tuple[list, list[int], list[float], dict]:
    """For rows of (_members, _size): the sources in order, their sizes and targets, and {pattern: (size, flow)}.

    The order is by code point with null last; weights repeat along it. Patterns and sources must fit the driver.
    """
    found = [(tuple(r[0]), r[1] or 0) for r in rows.groupBy("_members").agg(F.sum("_size")).collect() if r[0]]  # a row for each pattern
    place = lambda s: (s is None, s or "")
    sums: dict = {}
    for p, n in found:
        for s in p:
            sums[s] = sums.get(s, 0) + n
    names = sorted(sums, key=place)
    number = {s: i for i, s in enumerate(names)}
    sizes = [sums[s] for s in names]
    quotas = water_fill(sizes, [weights[i % len(weights)] for i in range(len(names))], share * sum(n for _, n in found), most)
    found.sort(key=lambda x: [place(s) for s in x[0]])
    flows = route([(n, [number[s] for s in p]) for p, n in found], quotas, most)
    return names, sizes, quotas, {p: (n, f) for (p, n), f in zip(found, flows)}


def taken(rows: DataFrame, flows: dict, seed: int = 11, bins: int = BINS) -> DataFrame:
    """rows of (_id, _members, _size, _hash), stored; adds _copies, the times that each is taken."""
    spark = rows.sparkSession
    wanted = [(list(p), f // n if n else 0, f - f // n * n if n else 0) for p, (n, f) in flows.items()]
    table = spark.createDataFrame(wanted, "_pattern array<string>, _base int, _rest long")  # a row for each pattern
    same = lambda a, b: F.to_json(F.struct(a)) == F.to_json(F.struct(b.alias("_members")))
    rows = rows.withColumn("_bin", F.shiftrightunsigned("_hash", 64 - (bins - 1).bit_length()).cast("int"))
    # the bin of each pattern in which its cut falls, and the size before it
    bars = rows.groupBy("_members", "_bin").agg(F.sum("_size").alias("_n"))
    w = Window.partitionBy("_members").orderBy("_bin")  # `bins` rows
    reached = bars.withColumn("_until", F.sum("_n").over(w)).join(F.broadcast(table), same(F.col("_members"), F.col("_pattern")))
    over = F.col("_until") > F.col("_rest")
    cuts = reached.groupBy("_members", "_base", "_rest").agg(
        F.coalesce(F.min(F.when(over, F.col("_bin"))), F.lit(bins)).alias("_cut"), F.coalesce(F.min(F.when(over, F.col("_until") - F.col("_n"))), F.lit(0)).alias("_start")
    )
    cuts = stored(cuts, "cuts").withColumnRenamed("_members", "_pattern")
    rows = rows.join(F.broadcast(cuts), same(F.col("_members"), F.col("_pattern"))).drop("_pattern")
    whole = rows.where(F.col("_bin") != F.col("_cut")).withColumn("_copies", F.col("_base") + (F.col("_bin") < F.col("_cut")).cast("int"))
    edge = rows.where(F.col("_bin") == F.col("_cut"))
    edge, _ = running(edge, [F.to_json(F.struct("_members")), F.col("_hash"), F.col("_id").asc_nulls_first()], {"_sum": F.col("_size")}, "edge")
    # running sums go over all patterns; each starts where its first row does
    firsts = edge.groupBy("_members").agg(F.min("_sum").alias("_from")).withColumnRenamed("_members", "_pattern")  # a row for each pattern
    edge = edge.join(F.broadcast(firsts), same(F.col("_members"), F.col("_pattern"))).drop("_pattern")
    here = F.col("_start") + F.col("_sum") - F.col("_from") + F.col("_size") / 2
    edge = edge.withColumn("_copies", F.col("_base") + (here <= F.col("_rest")).cast("int"))
    return whole.unionByName(edge.select(*whole.columns))


def seeded(docs: DataFrame, members: Column, on: str, text: str, seed: int = 11) -> DataFrame:
    t = F.col(text)
    members = F.array_sort(F.array_distinct(members.cast("array<string>")))
    return docs.select(F.col(on).alias("_id"), members.alias("_members"), words(t).alias("_size"), F.xxhash64(F.lit(seed), F.col(on), t).alias("_hash"))


def mix(docs: DataFrame, members: Column | None = None, on: str = "doc_id", text: str = "text", seed: int = 11, **options) -> DataFrame:
    """For each document of one source: id, size, source_size, target and the words taken."""
    rows = stored(seeded(docs, members if members is not None else F.array("source"), on, text, seed), "sizes")
    names, sizes, quotas, flows = plan(rows, **options)
    spark = docs.sparkSession
    schema = "_source string, source_size long, target double"
    table = F.broadcast(spark.createDataFrame(list(zip(names, sizes, quotas)), schema))  # a row for each source
    out = taken(rows, flows, seed)
    out = out.join(table, F.col("_members")[0].eqNullSafe(F.col("_source")))
    return out.select(F.col("_id").alias(on), F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * F.col("_copies")).alias("taken"))


def resample(docs: DataFrame, members: Column | None = None, on: str = "doc_id", text: str = "text", seed: int = 11, **options) -> DataFrame:
    """The mix itself: each row as many times as it is taken, with the columns of the input."""
    rows = stored(seeded(docs, members if members is not None else F.array("source"), on, text, seed), "sizes")
    flows = plan(rows, **options)[3]
    times = taken(rows, flows, seed).groupBy("_id", "_hash").agg(F.sum("_copies").alias("_copies"), F.count("*").alias("_rows"))
    times = stored(times, "times")
    # rows that are equal in id and text share their copies: the first of them takes what doesn't divide
    key, name = free_name(docs, "_hash"), free_name(docs, "_copies")
    out = docs.withColumn(key, F.xxhash64(F.lit(seed), F.col(on), F.col(text)))
    many = times.where("_rows > 1")
    single = out.join(times.where("_rows = 1").select(F.col("_hash").alias(key), F.col("_copies").alias(name)), key)
    n = many.limit(1).count()
    if n:
        again = out.join(many.select(F.col("_hash").alias(key), F.col("_copies").alias(name), F.col("_rows").alias(name + "_n")), key)
        part = F.floor(F.col(name) / F.col(name + "_n"))
        extra = F.pmod(F.col(name), F.col(name + "_n"))
        slot, _ = running(again, [F.col(key)], {"_slot": F.lit(1)}, "equal")
        low = slot.groupBy(key).agg(F.min("_slot").alias("_low"))
        slot = slot.join(low, key).withColumn(name, part + ((F.col("_slot") - F.col("_low")) < extra).cast("int"))
        single = single.unionByName(slot.select(*single.columns))
    return single.withColumn(name, F.explode(F.array_repeat(F.lit(1), F.col(name).cast("int")))).select(*docs.columns)

"""N-gram Jaccard join (8): near duplicates by a parity-sketch join, exact and without a cap.

A document is its set of 3-word shingles. Sets that are equal form a class, of which one row takes part in the join. The
sketch of a set has P blocks: each shingle goes to one block by a hash and toggles (XOR) a random 64-bit mask in it. Shingles
that two sets share cancel out, so blocks that differ are at most as many as shingles that only one of them has: the block
Hamming distance is a lower bound of the symmetric difference. At Jaccard similarity t that is at most
D = (1 - t) / (1 + t) * (|A| + |B|), so if a set has more than D blocks that aren't empty, at least one of them is equal in
both (pigeonhole), and if blocks are taken in one global order, the first such block is among the first D + 1 of either. These
blocks are the join keys. To have few pairs to verify, T more blocks are taken where there are D + T: then at least T of a
similar pair's blocks meet, and pairs that meet in fewer are dropped without looking at their sets. Keys are made per size band
(sizes 4**b to 4**(b+1); a set near the top of its band also takes part in the next). P is for a whole band the least at which every set of it has enough blocks, so no link can be lost.

The global order puts blocks with rare shingles first, by a count sketch of fixed size over the whole corpus, so that passages
which many documents share are hardly ever keys; it is only an order, any sketch gives the same links. Keys whose count may be
large are spread over a grid of tasks. Pairs that meet are verified on the full sets, grouped by their smallest partner so that
a set is sent to few tasks; groups with too many pairs or too large sets are cut into cells. Components: each task contracts its
links to a forest; what is left goes to one task or, if it is too much for that, by alternating stars. Nothing grows on the driver. The links between n different near copies are n (n - 1) / 2, and all of them are counted.

Such a crowd grows with the corpus, and each of its pairs would meet in hundreds of keys. So the largest crowds are looked for in a
sample; sets near one of the sampled ones get the crowd's label. Pairs within a label aren't made from keys: the overlaps of all of
them come from products of 0-1 matrices, cell by cell of a grid, which give the number of links and a forest that joins what they
join. Pairs of which one isn't in the crowd, and crowds that the sample misses, go by keys; so labels only save work.

Defined cases: null and empty texts, and those without words, have an empty set, n_similar 0 and themselves as component; one
or two words are one shingle; equal texts are linked; repeated rows count each as a document; a null id stays null; ids that
aren't whole numbers raise an error; words and texts have any length; an empty table gives an empty result; other columns aren't read, or passed on by keep_first().
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as K
from .plan import join_skewed, running, stored, whole_ids
from .quality_rules import free_name

U64 = np.uint64
SKETCH_BITS = 20
SLICES = 16
LEVELS = 4
NO_ID = -(1 << 63)
#: a key that may have more members than this is spread over a grid of tasks
GRID = 100_000
#: classes that are broadcast at most with their ids
BROADCAST_CLASSES = 500_000
#: edges, after each task has contracted its own, that one task joins to components
TASK_EDGES = 500_000
#: sets in the sample that is searched for crowds; how many of it with one signature are a crowd; signatures, sets of each and their size at most
SAMPLE = 8192
CROWD = 4
SIGNATURES = 64
OF_EACH = 8
LEADER_SIZE = 4096
#: sets, and their bytes, on a side of a cell of a crowd at most
CELL = 4096
CELL_BYTES = 16 << 20
#: shingles that so many sets of a cell have are multiplied, the pairs of others are counted one by one
HEAVY = 128
#: keys of a bucket that are sorted at once (a key's members stay together), and meetings of pairs that are held before they are added up
SLICE_KEYS = 1 << 18
HELD = 500_000


class Bound:
    """Jaccard similarity of at least num / 100, in integers."""

    def __init__(self, num: int):
        self.num = num

    def partner(self, n):
        """The largest size of a partner."""
        return n * 100 // self.num

    def differ(self, n):
        """How many shingles at most a set of size n and a partner don't share."""
        return (100 - self.num) * (n + self.partner(n)) // (100 + self.num)

    def meet(self, n):
        """In how many blocks a similar pair meets at least whose smaller set has size n."""
        return 1 + n // 16

    def keys(self, n):
        return self.differ(n) + self.meet(n)

    def all_keys(self, n: Column) -> Column:
        """keys() for each of a set's bands, as a column."""
        partner = F.floor(n * 100 / self.num)
        each = F.floor((100 - self.num) * (n + partner) / (100 + self.num)) + 1 + F.floor(n / 16)
        bits = F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)
        top = F.pow(F.lit(4), F.greatest(F.lit(0), F.floor((bits + 1) / 2) - 1) + 1)
        return each * F.when(partner > top, 2).otherwise(1)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted hashes of each text's distinct shingles."""
    starts, ends, first = K.spans(K.IS_WORD[raw], offsets)
    words = K.span_hashes(raw, starts, ends, lower=True)
    every, out = K.shingles(words, width), []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(every[a : b - width + 1]))
        else:
            out.append(K.shingles(words[a:b], b - a) if b > a else np.zeros(0, U64))
    return out


def band_of(n: int) -> int:
    return max(0, (int(n - 1).bit_length() + 1) // 2 - 1)


def blocks_of(band: int, level: int) -> int:
    return int(0.75 * 4 ** (band + 1) * 2**level) + 1 if level < LEVELS else 1 << 62


def tokens(s: np.ndarray, band: int, level: int, rarity: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The blocks of a set that aren't empty, as 64-bit keys, and the rank of each in the global order."""
    salt = K.mix(np.array([(band << 8) + level + 1], U64))[0]
    block = K.mix(s ^ salt) % U64(blocks_of(band, level))
    order = np.argsort(block, kind="stable")
    block = block[order]
    cut = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    parity = np.bitwise_xor.reduceat(K.mix(s[order] + U64(0x632BE59BD9B4E019)), cut)
    keys = K.mix(parity ^ K.mix(block[cut] + salt))
    if rarity is None:
        return keys, np.zeros(len(keys), np.uint8)
    return keys, np.minimum.reduceat(rarity[(s[order] >> U64(64 - SKETCH_BITS)).astype(np.int64)], cut)


def bands(n: int, bound: Bound) -> list[int]:
    b = band_of(n)
    return [b, b + 1] if bound.partner(n) > 4 ** (b + 1) else [b]


def failing(s: np.ndarray, band: int, bound: Bound, known: int = 0) -> int:
    """The known bit mask of levels with those added at which a set has too few blocks."""
    need = bound.keys(len(s))
    for level in range(LEVELS):
        if not known >> level & 1:
            salt = K.mix(np.array([(band << 8) + level + 1], U64))[0]
            if len(np.unique(K.mix(s ^ salt) % U64(blocks_of(band, level)))) < need:
                known |= 1 << level
    return known


def lowest(mask: int) -> int:
    """The first level that isn't in a mask; beyond the last one, each shingle is a block."""
    return next((level for level in range(LEVELS) if not mask >> level & 1), LEVELS)


def level_for(s: np.ndarray, band: int, bound: Bound) -> int:
    return lowest(failing(s, band, bound))


class Crowds:
    """Labels, from 1, of sets near one of the leaders; 0 for others. Leaders near each other share a label."""

    def __init__(self, leaders: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in leaders], np.int64)
        full, who = np.concatenate([np.zeros(0, U64), *leaders]), np.repeat(np.arange(len(leaders)), self.sizes)
        order = np.argsort(full, kind="stable")
        self.shingles, self.first = np.unique(full[order], return_index=True)
        self.first = np.append(self.first, len(full))
        self.who = who[order]
        self.there = np.zeros(1 << 20, bool)
        self.there[(self.shingles >> U64(44)).astype(np.int64)] = True
        label = np.arange(len(leaders))
        for i, x in enumerate(leaders):
            hits = self._hits(x)
            near = label[(100 * hits >= 20 * (len(x) + self.sizes - hits))]
            label[np.isin(label, near)] = near.min() if len(near) else label[i]
        self.labels = np.unique(label, return_inverse=True)[1] + 1

    def _hits(self, s: np.ndarray) -> np.ndarray:
        """How many shingles a set shares with each leader."""
        at = np.searchsorted(self.shingles, s)
        at[at == len(self.shingles)] = 0
        at = at[self.shingles[at] == s]
        n = self.first[at + 1] - self.first[at]
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[at], n)
        return np.bincount(self.who[place], minlength=len(self.sizes))

    def __call__(self, sets: list[np.ndarray]) -> list[int]:
        if not len(self.sizes) or not sets:
            return [0] * len(sets)
        sizes = np.array([len(s) for s in sets])
        ends = np.cumsum(sizes)
        hit = np.concatenate([[0], np.cumsum(self.there[(np.concatenate(sets) >> U64(44)).astype(np.int64)])])
        out = np.zeros(len(sets), np.int64)
        for i in np.flatnonzero((sizes > 0) & (4 * (hit[ends] - hit[ends - sizes]) >= sizes)).tolist():
            hits = self._hits(sets[i])
            share = hits / (sizes[i] + self.sizes - hits)
            best = int(share.argmax())
            if share[best] >= 0.35:
                out[i] = self.labels[best]
        return out.tolist()


def crowds(docs: DataFrame, width: int, least: int) -> Crowds:
    """Leaders from a bounded sample: sets of which at least `least` different ones have the same two smallest shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in K.pieces(batches, "_text"):
            sets = [s for s in shingle_sets(*K.text_bytes(piece.column("_text")), width) if 2 <= len(s) <= LEADER_SIZE]
            if sets:
                pair = np.array([s[:2] for s in sets], U64)
                raw = [s.tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array(K.mix(pair[:, 0] + K.mix(pair[:, 1])).view(np.int64)), pa.array([hashlib.md5(x).digest() for x in raw]), pa.array(raw)], ["sig", "key", "set"])

    part = SAMPLE / max(1, docs.count())
    found = docs if part >= 1 else docs.where(F.rand(8) < part)
    sets = found.select("_text").mapInArrow(run, "sig long, key binary, set binary").groupBy("sig", "key").agg(F.first("set").alias("set"))
    some = sets.groupBy("sig", F.pmod(F.xxhash64("key"), F.lit(OF_EACH)).alias("i")).agg(F.count("*").alias("n"), F.min("set").alias("set"))
    many = some.groupBy("sig").agg(F.sum("n").alias("n"), F.collect_list("set").alias("sets")).where(F.col("n") >= least)  # OF_EACH at most
    rows = many.orderBy(F.desc("n"), "sig").limit(SIGNATURES).collect()
    return Crowds([np.frombuffer(bytes(x), U64) for r in rows for x in r["sets"]])


def overlaps(sets: list[np.ndarray], split: int) -> np.ndarray:
    """The sizes of the intersections of the sets before `split` with those from it on; at 0, of all with all (but themselves).

    Beside the result and the shingles, all that is made is of a slice of them."""
    n, full = len(sets), np.concatenate(sets)
    order = np.argsort(full, kind="stable")
    row = np.repeat(np.arange(n, dtype=np.int32), [len(s) for s in sets])[order]
    full = full[order]
    del order
    first = np.flatnonzero(np.concatenate([[True], full[1:] != full[:-1]]))
    count = np.diff(np.append(first, len(full)))
    del full
    up, left = (split, n - split) if split else (n, n)
    out = np.zeros((up, left), np.float32)
    # pairs of sets that share a rarer shingle
    rare = np.flatnonzero((count > 1) & (count < HEAVY))
    slices = (np.cumsum(count[rare]) - 1) // SLICE_KEYS
    for own in np.split(rare, np.flatnonzero(np.diff(slices)) + 1):
        size = count[own]
        stop = np.repeat(first[own] + size, size)
        at = np.arange(len(stop)) + np.repeat(first[own] - np.cumsum(size) + size, size)
        d = 1
        while len(at):
            fit = at + d < stop
            at, stop = at[fit], stop[fit]
            x, y = row[at].astype(np.int64), row[at + d].astype(np.int64)
            if split:
                fit = (x < split) & (y >= split)
                x, y = x[fit], y[fit] - split
            np.add.at(out.reshape(-1), x * left + y, np.float32(1))
            d += 1
    if not split:  # so far they are above the diagonal
        for i in range(0, n, 256):
            j = i + 256
            out[j:, i:j] = out[i:j, j:].T
            out[i:j, i:j] += out[i:j, i:j].T.copy()
    heavy = np.flatnonzero(count >= HEAVY)
    for i in range(0, len(heavy), 512):
        own = heavy[i : i + 512]
        m = np.zeros((n, len(own)), np.float32)
        for k, c in enumerate(own.tolist()):
            m[row[first[c] : first[c] + count[c]], k] = 1
        for j in range(0, up, 256):
            out[j : j + 256] += m[j : min(up, j + 256)] @ m[split:].T
    return out


def crowd_links(members: DataFrame, bound: Bound, cell: int = CELL, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """Over (_cid, _label, _size, _set): rows (a, b, n): n copies linked with a, or, where n is null, a and b in one component."""
    sides = members.groupBy("_label").agg(F.ceil(F.greatest(F.count("*") / cell, F.sum(F.octet_length("_set")) / cell_bytes)).cast("int").alias("_side"))
    placed = members.join(F.broadcast(sides), "_label")  # as many rows as labels
    own = F.pmod(F.xxhash64("_cid"), F.col("_side")).cast("int")
    placed = placed.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_side") - 1)))
    placed = placed.select("_label", F.least("_own", "_other").alias("_row"), F.greatest("_own", "_other").alias("_column"), "_own", "_cid", "_size", "_set")

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        part, cid, copies = (table.column(c).to_numpy() for c in ("_own", "_cid", "_size"))
        order = np.argsort(part, kind="stable")
        raw = table.column("_set")
        sets = [np.frombuffer(raw[i].as_py(), U64) for i in order.tolist()]
        del table, raw
        part, cid, copies = part[order], cid[order], copies[order]
        split = int((part == part[0]).sum()) % len(part)
        if not split and key[1] != key[2]:
            return  # one side has no sets
        size = np.array([len(s) for s in sets])
        both = overlaps(sets, split)
        del sets
        n, up = len(part), len(both)
        linked = np.zeros(both.shape, bool)
        for i in range(0, up, 256):
            shared = both[i : i + 256].astype(np.int64)
            linked[i : i + 256] = 100 * shared >= bound.num * (size[i : min(up, i + 256), None] + size[None, split:] - shared)
        del both
        if not split:
            np.fill_diagonal(linked, False)
        near, label = np.zeros(n, np.int64), np.arange(n)
        for i in range(0, up, 256):
            block = linked[i : i + 256].astype(np.float64)
            near[i : min(up, i + 256)] += (block @ copies[split:].astype(np.float64)).astype(np.int64)
            if split:
                near[split:] += (copies[i : min(up, i + 256)].astype(np.float64) @ block).astype(np.int64)
        while True:
            before = label.copy()
            for i in range(0, up, 256):
                block, rows = linked[i : i + 256], slice(i, min(up, i + 256))
                label[rows] = np.minimum(label[rows], np.where(block, label[None, split:], n).min(1))
                label[split:] = np.minimum(label[split:], np.where(block, label[rows, None], n).min(0))
            label = label[label]
            if (label == before).all():
                break
        child = np.flatnonzero(label != np.arange(n))
        some = np.flatnonzero(near)
        a, b = np.concatenate([cid[some], cid[child]]), np.concatenate([cid[some], cid[label[child]]])
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array([*near[some].tolist(), *[None] * len(child)], pa.int64())], ["a", "b", "n"])
        K.trim()

    return stored(placed.groupBy("_label", "_row", "_column").applyInArrow(run, "a long, b long, n long"), "crowds")


def survey(docs: DataFrame, on: str, text: str, width: int, bound: Bound, crowd: int = CROWD) -> DataFrame:
    """One scan. Rows of kind 0: id, size and key of each set, and if it is in a crowd its label and, for each key once in a while, the set; 1: slices of the count sketch; 2: masks of the levels at which a set of the band fails."""
    found = docs.select(F.coalesce(whole_ids(docs, on), F.lit(NO_ID)).alias("_id"), F.col(text).alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(crowds(found, width, crowd))
    columns, kinds = ["kind", "id", "n", "data", "label", "set"], (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, failed, sent = np.zeros(1 << SKETCH_BITS, np.int64), {}, set()
        for piece in K.pieces(batches, "_text"):
            sets = shingle_sets(*K.text_bytes(piece.column("_text")), width)
            for s in sets:
                if len(s):
                    for b in bands(len(s), bound):
                        failed[b] = failing(s, b, bound, failed.get(b, 0))
            full = np.concatenate(sets) if sets else np.zeros(0, U64)
            counts += np.bincount((full >> U64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts))
            n = piece.num_rows
            keys, labels = [hashlib.md5(s.tobytes()).digest() for s in sets], shared.value(sets)
            given = [s.tobytes() if label and key not in sent else None for s, key, label in zip(sets, keys, labels)]
            sent = sent if len(sent) < 100_000 else set()
            sent.update(key for key, label in zip(keys, labels) if label)
            yield pa.RecordBatch.from_arrays(
                [pa.array([0] * n, pa.int32()), piece.column("_id"), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(c, t) for c, t in zip((keys, labels, given), kinds[3:]))],
                columns,
            )
        rows = [(2, b, mask, None, 0, None) for b, mask in failed.items()]
        if failed:
            low = np.minimum(counts, (1 << 32) - 1).astype(np.uint32).reshape(SLICES, -1)  # of one task
            rows += [(1, i, 0, x.tobytes(), 0, None) for i, x in enumerate(low)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], columns)

    return stored(found.mapInArrow(run, "kind int, id long, n long, data binary, label int, set binary"), "survey")


def rarity_of(surveyed: DataFrame) -> np.ndarray:
    """The count sketch, added up over tasks slice by slice, as logarithmic levels: 2**SKETCH_BITS bytes."""

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column("data"):
                one = np.frombuffer(x.as_py(), np.uint32).astype(np.int64)
                total = one if total is None else total + one
        level = np.minimum(255, 4 * np.log2(total + 1)).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([level.tobytes()], pa.binary())], ["id", "data"])

    parts = surveyed.where("kind = 1").groupBy("id").applyInArrow(add, "id long, data binary").collect()
    out = np.zeros((SLICES, (1 << SKETCH_BITS) // SLICES), np.uint8)
    for r in parts:
        out[r[0]] = np.frombuffer(bytes(r[1]), np.uint8)
    return out.reshape(-1)


def meetings(batches: Iterator[pa.RecordBatch], bound: Bound, slice_keys: int = SLICE_KEYS, most: int = HELD) -> Iterator[pa.RecordBatch]:
    """Pairs of classes that share keys of one bucket, with how many (a pair may come in several rows) and how many it needs.

    Of a key its lower 32 bits are there: two that are equal in them are taken for one, which only adds pairs. The bucket stays in
    the buffers it came in and is sorted slice by slice, so a task's memory is that of the bucket and of a slice.
    """
    rows, low, high, total = [], 1 << 63, -(1 << 63), 0
    for batch in batches:
        columns = [K.text_bytes(batch.column(c)) for c in ("sig", "step", "n", "label")]
        for i, (base, count) in enumerate(zip(batch.column("base").to_pylist(), batch.column("count").to_pylist())):
            sig, step, n, label = (raw[at[i] : at[i + 1]] for raw, at in columns)
            row = base, sig.view(np.uint32), step.view(np.int32 if len(step) == 4 * count else np.int64), n.view(np.uint16), label.view(np.uint16)
            rows.append(row)
            cid = _cids(row)
            low, high, total = min(low, int(cid.min())), max(high, int(cid.max())), total + count
    # a pair is one number: by the distance from the least class or, should classes be too far apart for that, by their ranks
    names = np.unique(np.concatenate([np.unique(_cids(r)) for r in rows])) if high - low >= 3_000_000_000 else None
    span = high - low + 1 if names is None else len(names)
    none = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint16)
    pairs, held, size = none, [], 0

    def added() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        code = np.concatenate([pairs[0], *(h[0] for h in held)])
        order = np.argsort(code)
        code = code[order]
        cut = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        met = np.concatenate([pairs[1], np.ones(size, np.int32)])[order]
        return code[cut], np.add.reduceat(met, cut, dtype=np.int32), np.concatenate([pairs[2], *(h[1] for h in held)])[order][cut]

    def out() -> Iterator[pa.RecordBatch]:
        for i in range(0, len(pairs[0]), most):
            code, met, least = (x[i : i + most] for x in pairs)
            a, b = np.divmod(code, span)
            a, b = (a + low, b + low) if names is None else (names[a], names[b])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(met), pa.array(bound.meet(least.astype(np.int32)), pa.int32())], ["a", "b", "met", "least"])

    slices = -(-total // slice_keys)
    for i in range(slices):
        sig, cid, n, label = _slice(rows, (i << 32) // slices, ((i + 1 << 32) // slices) - 1)
        # members of a key come by label, those of one label aren't paired: a member's partners go from the next label to the end of the key
        new = np.ones(len(sig), bool)
        new[1:] = sig[1:] != sig[:-1]
        stop = np.append(np.flatnonzero(new), len(sig))[np.cumsum(new)]
        new[1:] |= (label[1:] != label[:-1]) | (label[1:] == 0)
        start = np.append(np.flatnonzero(new), len(sig))[np.cumsum(new)]
        cid = cid - low if names is None else np.searchsorted(names, cid)
        at = np.arange(len(sig))
        d = 0
        while len(at):
            at = at[start[at] + d < stop[at]]  # one that has met all drops out for good
            if not len(at):
                break
            other = start[at] + d
            x, y, u, v = cid[at], cid[other], n[at].astype(np.int32), n[other].astype(np.int32)
            less, more = np.minimum(u, v), np.maximum(u, v)
            fit = (x != y) & ((less * 100 >= more * bound.num) | (more == 65535))
            x, y = x[fit], y[fit]
            held.append((np.minimum(x, y) * span + np.maximum(x, y), less[fit].astype(np.uint16)))
            size += len(x)
            if size > most:
                pairs, held, size = added(), [], 0
                if len(pairs[0]) > most:
                    yield from out()
                    pairs = none
            d += 1
    if size:
        pairs, held, size = added(), [], 0
    yield from out()


def _cids(row: tuple) -> np.ndarray:
    return row[0] + np.cumsum(row[2], dtype=np.int64)


def _slice(rows: list[tuple], least: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key, class, size and label of the members of a bucket's keys from `least` to `most` that have several, by key and label."""
    least, most, parts = np.uint32(least), np.uint32(most), []
    for row in rows:
        _, sig, _, n, label = row
        at = np.flatnonzero((sig >= least) & (sig <= most))
        parts.append((sig[at], _cids(row)[at], n[at], label[at] if len(label) else np.zeros(len(at), np.uint16)))
    sig, cid, n, label = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(sig)
    sig = sig[order]
    same = sig[1:] == sig[:-1]
    inside = np.zeros(len(sig), bool)
    inside[1:] |= same
    inside[:-1] |= same
    sig, order = sig[inside], order[inside]
    label = label[order]
    if label.any():
        again = np.lexsort((label, sig))
        sig, order, label = sig[again], order[again], label[again]
    return sig, cid[order], n[order], label


def candidates(reps: DataFrame, width: int, bound: Bound, levels: dict[int, int], rarity: np.ndarray, buckets: int, grid: int) -> DataFrame:
    """Pairs (a, b), a < b, of classes that share enough keys, but for those of one label; reps: (_cid, _key, _label, _text)."""
    spark = reps.sparkSession
    shared = spark.sparkContext.broadcast((levels, rarity))

    def emit(sigs: list, cids: list, sizes: list, marks: list) -> Iterator[pa.RecordBatch]:
        sig, cid, n, label = (np.concatenate(x) for x in (sigs, cids, sizes, marks))
        bucket = (sig >> U64(32)).astype(np.int64) % buckets
        order = np.argsort(bucket, kind="stable")
        sig, cid, n, label, bucket = sig[order], cid[order], n[order], label[order], bucket[order]
        cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        rows: list[tuple] = []
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(sig)]):
            step = np.diff(cid[a:b], prepend=cid[a])
            small = step.astype(np.int32) if len(step) and np.abs(step).max() < 1 << 31 else step
            rows.append((int(bucket[a]), int(cid[a]), b - a, sig[a:b].astype(np.uint32).tobytes(), small.tobytes(), n[a:b].tobytes(), label[a:b].tobytes() if label[a:b].any() else b""))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()))],
            ["bucket", "base", "count", "sig", "step", "n", "label"],
        )

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, rarity = shared.value
        sigs, cids, sizes, marks, held = [], [], [], [], 0
        for piece in K.pieces(batches, "_text"):
            sets = shingle_sets(*K.text_bytes(piece.column("_text")), width)
            keys = piece.column("_key").to_pylist()
            for s, key, cid, label in zip(sets, keys, piece.column("_cid").to_pylist(), piece.column("_label").to_pylist()):
                if not len(s) or hashlib.md5(s.tobytes()).digest() != key:
                    continue  # another text of the same id
                for band in bands(len(s), bound):
                    token, rank = tokens(s, band, levels[band], rarity)
                    order = np.lexsort((token, rank))[: bound.keys(len(s))]
                    token, rank = token[order], rank[order]
                    # a key with many members: each goes to one row and one column of a grid of side `side`
                    side = np.ceil(np.exp2(rank / 4.0 + 0.25) / grid).astype(np.int64)
                    if side.max() > 1:
                        big = np.flatnonzero(side > 1)
                        own, other = np.repeat(cid % side[big], side[big]), np.concatenate([np.arange(k) for k in side[big]])
                        cell = np.minimum(own, other) * (1 << 20) + np.maximum(own, other) + 1
                        token = np.concatenate([token[side == 1], K.mix(np.repeat(token[big], side[big]) + K.mix(cell.astype(U64)))])
                    sigs.append(token)
                    cids.append(np.full(len(token), cid, np.int64))
                    sizes.append(np.full(len(token), min(len(s), 65535), np.uint16))
                    marks.append(np.full(len(token), label, np.uint16))
                    held += len(token)
            if held > 500_000:
                yield from emit(sigs, cids, sizes, marks)
                sigs, cids, sizes, marks, held = [], [], [], [], 0
        if held:
            yield from emit(sigs, cids, sizes, marks)
        K.trim()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from meetings(batches, bound)
        K.trim()

    signed = reps.mapInArrow(sign, "bucket int, base long, count long, sig binary, step binary, n binary, label binary")
    found = signed.groupBy("bucket").applyInArrow(meet, "a long, b long, met int, least int")
    enough = found.groupBy("a", "b").agg(F.sum("met").alias("met"), F.max("least").alias("least")).where("met >= least")
    return stored(enough.select("a", "b"), "candidates")


def verify(
    pairs: DataFrame, docs: DataFrame, classes: DataFrame, width: int, bound: Bound, group_pairs: int = 2_000_000, group_bytes: int = 24 << 20, small_classes: int = BROADCAST_CLASSES,
) -> DataFrame:
    """The pairs whose sets are as similar as asked.

    Pairs are grouped by their home, the least partner of their second. A home whose pairs or sets are too many for a task is cut
    into cells: rows by a, and, if its sets are too large together, columns by b; so a set with any number of partners is spread.
    """
    spark = pairs.sparkSession
    least = pairs.groupBy("b").agg(F.min("a").alias("_least")).withColumnRenamed("b", "a")
    joined = pairs.join(least, "a", "left").withColumn("_home", F.coalesce("_least", "a")).drop("_least")
    sizes = classes.select("_cid", "_n")
    members = lambda rows: rows.select("_home", F.explode(F.array("a", "b")).alias("_cid")).distinct()
    weight = members(joined).join(sizes, "_cid").groupBy("_home").agg(F.sum(8 * F.col("_n")).alias("_bytes"))
    homes = stored(joined.groupBy("_home").agg(F.count("*").alias("_pairs")).join(weight, "_home"), "homes")
    columns = F.when(F.col("_bytes") > group_bytes, F.ceil(2 * F.col("_bytes") / group_bytes)).otherwise(1)
    rows = F.greatest(F.ceil(F.col("_pairs") / group_pairs), columns)
    # those that are cut are fewer than all pairs / group_pairs and all sets' bytes / group_bytes
    cut = homes.where((F.col("_pairs") > group_pairs) | (F.col("_bytes") > group_bytes)).select("_home", rows.alias("_rows"), columns.alias("_columns"))
    total = homes.agg(F.sum("_pairs"), F.sum("_bytes")).first()
    copied = homes.join(F.broadcast(cut), "_home").agg(F.sum(F.col("_bytes") * (F.col("_rows") + F.col("_columns")))).first()[0] or 0
    joined = joined.join(F.broadcast(cut), "_home", "left")
    cell = lambda c, n: F.pmod(F.xxhash64(c), F.coalesce(F.col(n), F.lit(1)))
    joined = joined.select(F.xxhash64("_home", cell("a", "_rows"), cell("b", "_columns")).alias("_home"), "a", "b")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-((total[1] or 0) + copied + 16 * (total[0] or 0)) // group_bytes))
    slot = lambda: F.pmod(F.xxhash64("_home"), F.lit(parts)).cast("int").alias("_slot")
    slots = members(joined).select(slot(), "_cid").distinct().groupBy("_cid").agg(F.collect_set("_slot").alias("_slots"))
    needed = stored(slots.join(classes.select("_cid", "_rep", "_key"), "_cid"), "needed")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in K.pieces(batches, "_text"):
            rows = []
            for s, key, cid, slots in zip(shingle_sets(*K.text_bytes(piece.column("_text")), width), *(piece.column(c).to_pylist() for c in ("_key", "_cid", "_slots"))):
                if hashlib.md5(s.tobytes()).digest() == key:
                    rows += [(slot, cid, s.tobytes()) for slot in slots]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary()))], ["_slot", "_cid", "_set"])

    small = needed.count() <= small_classes
    texts = docs.join(F.broadcast(needed) if small else needed, docs["_id"] == needed["_rep"]).select("_key", "_cid", "_slots", "_text")
    sent = texts.mapInArrow(sets, "_slot int, _cid long, _set binary")

    def check(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = right.column("_cid").to_numpy()
        values = {c: np.frombuffer(x, U64) for c, x in zip(ids.tolist(), right.column("_set").to_pylist())}
        a, b = left.column("a").to_numpy(), left.column("b").to_numpy()
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        keep = np.zeros(len(a), bool)
        cut = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
        for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(a)]):
            own = values[int(a[i])]
            for k in range(i, j, 4096):
                others = [values[x] for x in b[k : min(j, k + 4096)].tolist()]
                sizes = np.array([len(x) for x in others])
                full = np.concatenate(others)
                at = np.searchsorted(own, full)
                at[at == len(own)] = 0
                hit = np.concatenate([[0], np.cumsum(own[at] == full)])
                ends = np.cumsum(sizes)
                both = hit[ends] - hit[ends - sizes]
                keep[k : k + len(others)] = 100 * both >= bound.num * (len(own) + sizes - both)
        del values
        K.trim()
        return pa.table({"a": a[keep], "b": b[keep]})

    linked = joined.select(slot(), "a", "b").groupBy("_slot").cogroup(sent.groupBy("_slot")).applyInArrow(check, "a long, b long")
    return stored(linked, "links")


def components(links: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """(v, root) for every v that has a link and isn't a root itself, root being the smallest of its component.

    Beyond `task_edges` by alternating stars. Their rounds are plans of many stages and broadcasts, all of which take memory of the
    driver, so few edges are labelled by one task, and a round stores what it uses several times, which else is planned anew each time.
    """

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[p]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = find(a), find(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        rows = [(x, find(x)) for x in parent if find(x) != x]
        for i in range(0, len(rows), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + 100_000])], ["u", "v"])

    edges = stored(links.select("a", "b").mapInArrow(contract, "u long, v long").distinct(), "edges")
    total = edges.count()
    if total <= task_edges:
        return edges.coalesce(1).mapInArrow(contract, "u long, v long").select(F.col("u").alias("_cid"), F.col("v").alias("_root"))
    before, total = None, 2 * total
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n")), "stars")
        large = join_skewed(both.where("v > u"), least, "u", "n", total).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = stored(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "edges")
        least = stored(down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "stars")
        small = join_skewed(down, least, "u", "n", total).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
        edges = stored(small.distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, total = now, 2 * now[0]
    return edges.select(F.col("u").alias("_cid"), F.col("v").alias("_root"))


def _facts(docs: DataFrame, percent: int = 70, width: int = 3, on: str = "doc_id", text: str = "text", grid: int = GRID, bucket_keys: int = 3_000_000, small_classes: int = BROADCAST_CLASSES, crowd: int = CROWD, cell: int = CELL, **limits) -> tuple[DataFrame, DataFrame]:
    """Id, size and key of each row, and for each class: key, n_similar, component, rows, and its least id if it is its component's first."""
    bound = Bound(percent)
    surveyed = survey(docs, on, text, width, bound, crowd)
    own = surveyed.where("kind = 0").select(F.col("id").alias("_id"), F.col("n").alias("_n"), F.col("data").alias("_key"), F.col("label").alias("_label"))
    grouped = own.where("_n > 0").groupBy("_key").agg(F.min("_id").alias("_rep"), F.max("_n").alias("_n"), F.count("*").alias("_size"), F.max("_label").alias("_label"))
    own = own.drop("_label")
    classes, total = running(grouped, [F.col("_rep"), F.col("_key")], {"_cid": F.lit(1), "_before": bound.all_keys(F.col("_n"))}, "classes")
    classes = stored(classes.drop("_before"), "classes")
    levels = {r[0]: lowest(r[1]) for r in surveyed.where("kind = 2").groupBy("id").agg(F.bit_or("n")).collect()}  # a row for each band
    flat = docs.select(F.coalesce(whole_ids(docs, on), F.lit(NO_ID)).alias("_id"), F.col(text).alias("_text"))
    keyed = classes.select("_cid", "_rep", "_key", "_label")
    reps = flat.join(F.broadcast(keyed) if total["_cid"] <= small_classes else keyed, F.col("_id") == F.col("_rep")).select("_cid", "_key", "_label", "_text")
    buckets = max(1, -(-total["_before"] // bucket_keys))  # copies of keys in a grid aren't counted
    pairs = candidates(reps, width, bound, levels, rarity_of(surveyed), buckets, grid)
    links = verify(pairs, flat, classes, width, bound, small_classes=small_classes, **limits)
    sets = surveyed.where("kind = 0 and label > 0").groupBy(F.col("data").alias("_key")).agg(F.first("set", ignorenulls=True).alias("_set"))
    crowded = crowd_links(classes.where("_label > 0").select("_key", "_cid", "_label", "_size").join(sets, "_key"), bound, cell)
    both = links.select(F.col("a").alias("_cid"), F.col("b").alias("_other")).unionByName(links.select(F.col("b").alias("_cid"), F.col("a").alias("_other")))
    sizes = classes.select(F.col("_cid").alias("_other"), F.col("_size").alias("_others"))
    counted = both.join(sizes, "_other").select("_cid", "_others").unionByName(crowded.where("n is not null").select(F.col("a").alias("_cid"), F.col("n").alias("_others")))
    near = counted.groupBy("_cid").agg(F.sum("_others").alias("_near"))
    joined = links.unionByName(crowded.where("n is null").select("a", "b"))
    roots = components(joined).join(classes.select(F.col("_cid").alias("_root"), F.col("_rep").alias("_first")), "_root").select("_cid", "_first")
    facts = classes.join(near, "_cid", "left").join(roots, "_cid", "left")
    facts = stored(facts.select("_key", (F.coalesce("_near", F.lit(0)) + F.col("_size") - 1).alias("_near"), F.coalesce("_first", "_rep").alias("_first"), F.col("_size"), F.when(F.col("_first").isNull(), F.col("_rep")).alias("_kept")), "facts")
    return own, facts


def similar(docs: DataFrame, percent: int = 70, width: int = 3, on: str = "doc_id", **options) -> DataFrame:
    """For each document: n_shingles, n_similar and component_id; options as of _facts()."""
    own, facts = _facts(docs, percent, width, on, **options)
    # one class may hold a third of the rows: the few large ones are broadcast
    rows = own.where("_n > 0")
    out = join_skewed(rows, facts.drop("_kept"), "_key", "_size", own.count()).select("_id", "_n", "_near", "_first")
    out = out.unionByName(own.where("_n = 0").select("_id", "_n", F.lit(0).cast("long").alias("_near"), F.col("_id").alias("_first")))
    shown = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(shown("_id").alias(on), F.col("_n").alias("n_shingles"), F.col("_near").alias("n_similar"), shown("_first").alias("component_id"))


def _keyed(docs: DataFrame, text: str, width: int, name: str) -> DataFrame:
    """The rows with the key of their shingle set, null if they have no words."""
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in K.pieces(batches, text):
            sets = shingle_sets(*K.text_bytes(piece.column(text)), width)
            keys = [hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(keys, pa.binary())], [*piece.schema.names, name])

    return docs.mapInArrow(run, schema)


def keep_first(docs: DataFrame, on: str = "doc_id", text: str = "text", *, width: int = 3, **options) -> DataFrame:
    """One row of each component, that with the smallest id, of rows of one id and shingle set that with the least text, with the
    same columns; rows without words stay."""
    own, facts = _facts(docs, on=on, text=text, width=width, **options)
    first = facts.where(F.col("_kept").isNotNull()).select(F.col("_kept").alias("_id"), "_key")
    chosen = stored(first.unionByName(own.where("_n = 0").select("_id", F.lit(None).cast("binary").alias("_key")).distinct()), "chosen")
    small = chosen.count() <= BROADCAST_CLASSES
    id_, key, row = (free_name(docs, n) for n in ("_chosen_id", "_chosen_key", "_row"))
    ids = chosen.select(F.col("_id").alias(id_)).distinct()
    own_id = F.coalesce(docs[on].cast("long"), F.lit(NO_ID))
    left = docs.join(F.broadcast(ids) if small else ids, own_id == ids[id_], "left_semi")
    if left.groupBy(on).count().where("count > 1").isEmpty():
        return left
    # an id with several rows: those of the chosen sets, one of each, but all that have no words
    marked = _keyed(left, text, width, key)
    sets = chosen.where("_key is not null").select(F.col("_id").alias(id_), F.col("_key").alias(key))
    of_set = (F.coalesce(marked[on].cast("long"), F.lit(NO_ID)) == sets[id_]) & (marked[key] == sets[key])
    found = marked.join(F.broadcast(sets) if small else sets, of_set, "left_semi")
    one = found.groupBy(on, key).agg(F.min_by(F.struct(*docs.columns), F.col(text)).alias(row)).select(f"{row}.*")
    return one.unionByName(marked.where(F.col(key).isNull()).select(*docs.columns))


def brute_force(docs: list[tuple], percent: int = 70, width: int = 3) -> list[tuple]:
    """What similar() gives, from the definition, for tests."""
    import re

    sets = []
    for _, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    parent = list(range(len(docs)))

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    near = [0] * len(docs)
    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                near[i] += 1
                near[j] += 1
                parent[find(i)] = find(j)
    low: dict[int, object] = {}
    for i, (d, _) in enumerate(docs):
        r = find(i)
        low[r] = d if r not in low or d is None or (low[r] is not None and d < low[r]) else low[r]
    return [(d, len(sets[i]), near[i], low[find(i)]) for i, (d, _) in enumerate(docs)]

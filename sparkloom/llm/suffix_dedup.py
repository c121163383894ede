"""Suffix-array dedup (9): every byte that a 100-byte string covers which also starts earlier is removed, by difference covers.

The suffix order of a corpus is only asked where 100-byte strings may be equal, so the work is distributed by content. Each
window of 100 bytes has an anchor, the smallest hash of its 32-byte substrings (leftmost of equal ones). Equal windows have
equal anchors, so

1. anchors are counted over the whole corpus, in as many buckets as it needs, and those that occur twice are marked: in a
   bitmap that is broadcast while 2**`map_bits` bits are enough (a mark set for nothing costs work, never a result); beyond
   that the anchors are counted together with their places, and the marked places are joined to their texts;
2. runs of consecutive windows with one marked anchor, with the bytes that they span, go to the bucket of the anchor; equal
   runs of a batch are combined first, the later ones being known as copies;
3. each bucket sorts its suffixes by the difference-cover algorithm: the triples at positions 1 and 2 modulo 3 are sorted and
   named, names that recur are ranked by recursion on the string of names, the suffixes at positions 0 modulo 3 are sorted by
   their first byte and the rank that follows, and both orders are merged. As only prefixes of 100 bytes are asked for, the
   recursion ends once names stand for that many. Prefixes of neighbours are compared byte by byte, and of each set of equal
   ones all but the earliest are marked. Windows whose hash occurs once in the bucket have no equal, so they aren't sorted;
4. marks return to their documents as intervals.

An anchor that occurs more than `hot` times would make a bucket of unbounded size; its windows are sent one by one, each by a
hash of its own bytes, after equal ones have been combined. Texts that are equal as a whole (by SHA-256) are combined
beforehand; whatever else is taken as equal is compared byte by byte.

Defined cases: null and empty texts have no bytes; texts of under 100 bytes lose nothing; ties of an id are ordered by the
SHA-256 of the text, and of repeated rows one is the first and keeps its bytes; a null id comes before all; ids that aren't
whole numbers raise an error; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .ngram_join import BROADCAST_CLASSES, NO_ID
from .plan import join_skewed, running, stored, whole_ids

U64 = np.uint64
GRAM = 32
PIECE = 1 << 18
SEGMENT = 1 << 22
POSITION_BITS = 24
HOT = 20_000
BUCKET_BYTES = 1_000_000
#: bits of the bitmap of anchors at most: 128 MB; enough for about 16 GB of distinct texts
MAP_BITS = 30
#: bytes of text for each task that counts anchors (a run takes some 35)
COUNT_BYTES = 64 << 20


# --- the difference-cover suffix order -------------------------------------------------------------------------------


def _names(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks of keys, from 1, equal for equal ones, and how many there are."""
    order = np.argsort(keys)
    sorted_ = keys[order]
    new = np.ones(len(keys), np.int64)
    new[1:] = sorted_[1:] != sorted_[:-1]
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(new)
    return rank, int(new.sum())


def _below(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of b how many of a are smaller; both are sorted, so the stable sort only merges two runs."""
    order = np.argsort(np.concatenate([b, a]), kind="stable")
    return np.flatnonzero(order < len(b)) - np.arange(len(b))


def _triples(s: np.ndarray, at: np.ndarray, top: int) -> np.ndarray:
    """One key for each triple of s that orders like it."""
    a, b, c = s[at], s[at + 1], s[at + 2]
    bits = max(1, int(top).bit_length())
    if 3 * bits <= 63:
        return (((a << bits) | b) << bits) | c
    first = _names((a << 32) | b)[0]
    return (first << 32) | c


def suffix_ranks(s: np.ndarray, reach: int) -> np.ndarray:
    """Ranks of all suffixes of s, an array of positive integers, by the difference cover {1, 2} modulo 3.

    Suffixes are told apart by their first `reach` symbols at least; such as agree on more may have equal ranks.
    """
    n = len(s)
    if n < 3:
        padded = np.concatenate([s, [0, 0, 0]])
        return _names(np.array([(int(padded[i]) << 42) | (int(padded[i + 1]) << 21) | int(padded[i + 2]) for i in range(n)], dtype=object).astype(object))[0] if n else np.zeros(0, np.int64)
    s = np.concatenate([s.astype(np.int64), np.zeros(3, np.int64)])
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    top = int(s.max())
    names, kinds = _names(_triples(s, sample, top))
    if kinds < len(sample) and reach > 3:
        # suffixes of the string of names; a zero keeps the two halves apart
        both = np.concatenate([names[: len(one)], [0], names[len(one) :]])
        ranks = suffix_ranks(both + 1, -(-reach // 3))
        names = np.concatenate([ranks[: len(one)], ranks[len(one) + 1 :]])
        names = _names(names)[0]
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = names
    # the suffixes at 0 modulo 3, by first symbol and following rank
    zero = np.arange(0, n, 3)
    key = (s[zero] << 32) | rank[zero + 1]
    order = np.argsort(key)
    zero, key = zero[order], key[order]
    real = sample[sample < n]
    # merge: the number of sampled suffixes before each of the others. Against 1 modulo 3 a symbol and a rank decide, against
    # 2 modulo 3 two symbols and a rank; either kind is in order by its own key
    bits = max(1, int(rank.max()).bit_length())
    near, far = real[real % 3 == 1], real[real % 3 == 2]
    near, far = near[np.argsort(rank[near])], far[np.argsort(rank[far])]
    two_symbols = lambda i: (s[i] << symbol_bits) | s[i + 1]
    symbol_bits = max(1, int(top).bit_length())
    low = _below((s[near] << 32) | rank[near + 1], key)
    if 2 * symbol_bits + bits <= 63:
        low = low + _below((two_symbols(far) << bits) | rank[far + 2], (two_symbols(zero) << bits) | rank[zero + 2])
    else:
        pairs = _names(np.concatenate([two_symbols(far), two_symbols(zero)]))[0]
        low = low + _below((pairs[: len(far)] << 32) | rank[far + 2], (pairs[len(far) :] << 32) | rank[zero + 2])
    out = np.empty(n, np.int64)
    # equal keys keep equal ranks, so a rank is the number of suffixes before, counted once for each set of equal ones
    place = np.arange(len(zero))
    place[1:][key[1:] == key[:-1]] = 0
    out[zero] = 2 * (low + np.maximum.accumulate(place))
    before = np.cumsum(np.bincount(rank[real])) - np.bincount(rank[real])  # by rank
    zeros = np.cumsum(np.bincount(low, minlength=len(real) + 1))
    out[real] = (2 * (before + zeros[before]) + 1)[rank[real]]
    return out


def repeated(text: np.ndarray, valid: np.ndarray, size: int) -> np.ndarray:
    """Which of the valid starts (ascending, in order of priority) begin a `size`-byte string that an earlier valid start begins too.

    Equal strings have equal hashes, so only strings whose hash occurs twice are sorted, with the bytes that they cover.
    """
    out = np.zeros(len(valid), bool)
    if not len(valid):
        return out
    h = K.Hasher(text)(valid, valid + size)
    order = np.argsort(h)
    twice = h[order][1:] == h[order][:-1]
    likely = np.zeros(len(valid), bool)
    likely[order[1:][twice]] = likely[order[:-1][twice]] = True
    likely = np.flatnonzero(likely)
    if len(likely):
        edge = np.zeros(len(text) + 1, np.int32)
        np.add.at(edge, valid[likely], 1)
        np.add.at(edge, valid[likely] + size, -1)
        covered = np.cumsum(edge[:-1]) > 0  # a string's bytes stay together
        at = (np.cumsum(covered) - 1)[valid[likely]]
        out[likely] = sorted_out(text[covered], at, h[likely], size)
    return out


def sorted_out(text: np.ndarray, valid: np.ndarray, h: np.ndarray, size: int) -> np.ndarray:
    """repeated(), by the suffix order of the whole text; h: hashes of the strings."""
    out = np.zeros(len(valid), bool)
    order = np.argsort(suffix_ranks(text.astype(np.int64) + 1, size)[valid])
    at = valid[order]
    same = h[order][1:] == h[order][:-1]
    word = np.ndarray(len(text) - 7, "<u8", text.tobytes(), strides=(1,)) if len(text) >= 8 else None
    left = np.flatnonzero(same)
    for k in [*range(0, size - 8, 8), size - 8] if size >= 8 else []:
        left = left[word[at[left] + k] == word[at[left + 1] + k]]
    if size < 8:
        for k in range(size):
            left = left[text[at[left] + k] == text[at[left + 1] + k]]
    same = np.zeros(len(at) - 1, bool)
    same[left] = True
    group = np.concatenate([[0], np.cumsum(~same)])
    first = np.minimum.reduceat(at, np.flatnonzero(np.concatenate([[True], ~same])))
    out[order] = at != first[group]
    return out


def copies(raw: np.ndarray, begin: np.ndarray, length: np.ndarray, content: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Which runs have the bytes of the one before in an order by hash of content: hashes propose, bytes decide."""
    again = np.zeros(len(order), bool)
    a, b = order[:-1], order[1:]
    same = np.flatnonzero((content[a] == content[b]) & (length[a] == length[b]))
    for k in range(0, len(same), 20_000):
        x, y = a[same[k : k + 20_000]], b[same[k : k + 20_000]]
        n = length[x]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        equal = raw[np.repeat(begin[x], n) + step] == raw[np.repeat(begin[y], n) + step]
        again[y] = np.logical_and.reduceat(equal, np.cumsum(n) - n)
    return again


# --- anchors ---------------------------------------------------------------------------------------------------------


def rolling(raw: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all substrings of `gram` bytes, a power of two, by doubling."""
    h, k, base = K.BYTE_VALUE[raw], 1, 0x100000001B3
    while k < gram:
        h = h[:-k] * U64(base) + h[k:]
        base = base * base % (1 << 64)
        k *= 2
    return K.mix(h)


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    k = 1
    while k * 2 <= width:
        v = np.minimum(v[:-k], v[k:])
        k *= 2
    return np.minimum(v[: -(width - k)], v[width - k :]) if width > k else v


def anchor_runs(raw: np.ndarray, offsets: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: start, number of windows, and the anchor's hash."""
    none = np.zeros(0, np.int64)
    if len(raw) < size:
        return none, none, np.zeros(0, U64)
    h = rolling(raw, gram)
    place = np.arange(len(h), dtype=np.int64).astype(U64)
    low = U64((1 << POSITION_BITS) - 1)
    v = sliding_min((h & ~low) | place, size - gram + 1)
    inside = np.ones(len(v), bool)  # windows within one text
    for_all = offsets[1:-1]
    if len(for_all):
        edge = np.zeros(len(v) + size + 1, np.int64)
        np.add.at(edge, np.maximum(for_all - size + 1, 0), 1)
        np.add.at(edge, for_all, -1)
        inside = np.cumsum(edge)[: len(v)] <= 0
    head = inside.copy()
    head[1:] &= ~inside[:-1] | (v[1:] != v[:-1])
    starts = np.flatnonzero(head)
    stop = np.append(np.flatnonzero(head | ~inside), len(v))
    ends = stop[np.searchsorted(stop, starts, "right")]
    # anchors are the least of many hashes, so they are mixed again to be even over their range
    return starts, ends - starts, K.mix(h[(v[starts] & low).astype(np.int64)] + U64(1))


def segments(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, pa.RecordBatch, np.ndarray]]:
    """Pieces as bytes, offsets, batch and base of each text; a long text comes in segments that overlap by size - 1."""
    for piece in K.pieces(batches, "_text", PIECE):
        raw, offsets = K.text_bytes(piece.column("_text"))
        if len(raw) <= SEGMENT:
            yield raw, offsets, piece, np.zeros(piece.num_rows, np.int64)
        else:
            for i in range(piece.num_rows):
                for base in range(0, max(1, int(offsets[i + 1] - offsets[i]) - size + 1), SEGMENT):
                    part = raw[offsets[i] + base : min(offsets[i + 1], offsets[i] + base + SEGMENT + size - 1)]
                    yield part, np.array([0, len(part)]), piece.slice(i, 1), np.array([base])


# --- the plan --------------------------------------------------------------------------------------------------------


def map_bits_for(total: int) -> int:
    """Bits of a bitmap in which few anchors of `total` bytes meet by chance."""
    return max(16, (total // 16).bit_length())


def marked(texts: DataFrame, total: int, size: int, gram: int, hot: int, count_bytes: int) -> tuple[np.ndarray, int, int, np.ndarray]:
    """Over texts (_text): the bitmap of anchors that occur twice, its bits, how many runs have such, and the hot anchors."""
    bits = map_bits_for(total)
    cut = max(0, min(bits - 3, (total // count_bytes).bit_length()))

    def emit(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        bucket = (values >> U64(64 - cut)).astype(np.int64) if cut else np.zeros(len(values), np.int64)
        edge = np.searchsorted(bucket, np.arange((1 << cut) + 1))
        rows = []
        for b in range(1 << cut):
            if edge[b] < edge[b + 1]:
                own, n = values[edge[b] : edge[b + 1]], counts[edge[b] : edge[b + 1]]
                rows.append((b, own.tobytes(), np.flatnonzero(n > 1).astype(np.int32).tobytes(), n[n > 1].astype(np.int64).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["bucket", "hash", "at", "n"])

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for raw, offsets, _, _ in segments(batches, size):
            hashes = anchor_runs(raw, offsets, size, gram)[2]
            if len(hashes):
                held.append(hashes)
                n += len(hashes)
            if n > 1_000_000:
                yield from emit(held)
                held, n = [], 0
        if n:
            yield from emit(held)

    def count(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = [], []
        for batch in batches:
            for raw, at, n in zip(*(batch.column(c).to_pylist() for c in ("hash", "at", "n"))):
                hashes.append(np.frombuffer(raw, U64))
                own = np.ones(len(hashes[-1]), np.int64)
                own[np.frombuffer(at, np.int32)] = np.frombuffer(n, np.int64)
                counts.append(own)
        h, n = np.concatenate(hashes), np.concatenate(counts)
        del hashes, counts
        order = np.argsort(h)
        h, n = h[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        n, h = np.add.reduceat(n, first), h[first]
        twice = n > 1
        part = np.zeros(1 << (bits - cut), bool)
        part[((h[twice] >> U64(64 - bits)) & U64(len(part) - 1)).astype(np.int64)] = True
        yield pa.RecordBatch.from_arrays(
            [pa.array([key[0].as_py()], pa.int32()), pa.array([int(n[twice].sum())], pa.int64()), pa.array([np.packbits(part).tobytes()], pa.binary()), pa.array([h[n > hot].tobytes()], pa.binary())],
            ["bucket", "n", "bits", "hot"],
        )

    found = texts.select("_text").mapInArrow(collect, "bucket int, hash binary, at binary, n binary")
    rows = found.groupBy("bucket").applyInArrow(count, "bucket int, n long, bits binary, hot binary").collect()  # 2**MAP_BITS bits at most, and one hash for each `hot` runs of what they are enough for
    each = 1 << max(0, bits - cut - 3)
    out = np.zeros((1 << cut) * each, np.uint8)
    for r in rows:
        out[r[0] * each : (r[0] + 1) * each] = np.frombuffer(bytes(r[2]), np.uint8)
    return out, bits, sum(r[1] for r in rows), np.sort(np.concatenate([np.zeros(0, U64), *[np.frombuffer(bytes(r[3]), U64) for r in rows]]))


def located(texts: DataFrame, size: int, gram: int, hot: int) -> tuple[DataFrame, int]:
    """Over texts (_cid, _text) of any total: for each text its runs whose anchor occurs twice, and how many there are in all."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for raw, offsets, piece, base in segments(batches, size):
            at, n, h = anchor_runs(raw, offsets, size, gram)
            row = np.searchsorted(offsets, at, "right") - 1
            cid = piece.column("_cid").to_numpy()[row]
            yield pa.RecordBatch.from_arrays([pa.array(cid), pa.array(at - offsets[row] + base[row]), pa.array(n.astype(np.int32)), pa.array(h.view(np.int64))], ["_cid", "start", "n", "key"])

    runs = stored(texts.select("_cid", "_text").mapInArrow(place, "_cid long, start long, n int, key long"), "runs")
    counts = stored(runs.groupBy("key").agg(F.count("*").alias("_times")).where("_times > 1"), "anchors")
    total = counts.agg(F.sum("_times")).first()[0] or 0
    many = F.struct("start", "n", "key", (F.col("_times") > hot).alias("many"))
    found = join_skewed(runs, counts, "key", "_times", total)
    return found.groupBy("_cid").agg(F.collect_list(many).alias("_runs")), total  # runs of one text each


def intervals(texts: DataFrame, known: tuple[np.ndarray, int, np.ndarray] | None, buckets: int, size: int, gram: int) -> DataFrame:
    """Over texts (_cid, _text): rows (_cid, start, n), n windows from start on that also start earlier.

    known: bitmap, its bits and the hot anchors; without them the texts have their runs in a column _runs.
    """
    shared = texts.sparkSession.sparkContext.broadcast(known)

    def runs_of(raw: np.ndarray, offsets: np.ndarray, piece: pa.RecordBatch, base: np.ndarray) -> tuple[np.ndarray, ...]:
        """Place in raw, windows, anchor, row, and whether the anchor is hot, of the runs to be sent."""
        if known is None:
            parts = []
            for i, (runs, own) in enumerate(zip(piece.column("_runs"), base.tolist())):
                at, n, key, many = (runs.values.field(c).to_numpy(zero_copy_only=False) for c in ("start", "n", "key", "many"))
                here = (at >= own) & (at + n <= own + offsets[i + 1] - offsets[i] - size + 1)
                parts.append((at[here] - own + offsets[i], n[here].astype(np.int64), key[here].view(U64), np.full(int(here.sum()), i), many[here].astype(bool)))
            return tuple(np.concatenate(x) for x in zip(*parts))
        bitmap, bits, hot = shared.value
        at, n, h = anchor_runs(raw, offsets, size, gram)
        bit = (h >> U64(64 - bits)).astype(np.int64)
        there = (bitmap[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 == 1
        at, n, h = at[there], n[there], h[there]
        many = hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h if len(hot) else np.zeros(len(h), bool)
        return at, n, h, np.searchsorted(offsets, at, "right") - 1, many

    class Held:
        """Runs of a batch of texts: equal ones are combined before they are sent."""

        def __init__(self):
            self.parts, self.size = [], 0

        def add(self, raw, hasher, cid, at, start, n, key):
            ends = np.cumsum(n + size - 1)
            index = np.arange(int(ends[-1])) - np.repeat(ends - (n + size - 1), n + size - 1) + np.repeat(at, n + size - 1)
            self.parts.append((cid, start, n, key, hasher(at, at + n + size - 1), raw[index]))
            self.size += len(index)

        def emit(self) -> Iterator[pa.RecordBatch]:
            cid, start, n, key, content, raw = (np.concatenate(x) for x in zip(*self.parts))
            ends = np.cumsum(n + size - 1)
            begins = ends - (n + size - 1)
            again = copies(raw, begins, n + size - 1, content, np.lexsort((start, cid, content)))
            bucket = (K.mix(key) % U64(buckets)).astype(np.int64)
            order = np.lexsort((start, cid, bucket))
            cut = np.flatnonzero(np.concatenate([[True], bucket[order][1:] != bucket[order][:-1]]))
            rows = []
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(order)]):
                own = order[a:b]
                sent = own[~again[own]]
                blob = b"".join([raw[x:y].tobytes() for x, y in zip(begins[sent].tolist(), ends[sent].tolist())])
                rows.append((int(bucket[own[0]]), cid[own].tobytes(), start[own].tobytes(), np.where(again[own], -n[own], n[own]).astype(np.int32).tobytes(), blob))
            self.parts, self.size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()))], ["bucket", "cid", "start", "n", "raw"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held()
        for raw, offsets, piece, base in segments(batches, size):
            at, n, h, row, many = runs_of(raw, offsets, piece, base)
            if not len(at):
                continue
            cid = piece.column("_cid").to_numpy()[row]
            hasher = K.Hasher(raw)
            start = at - offsets[row] + base[row]
            if many.any():
                step = np.arange(int(n[many].sum())) - np.repeat(np.cumsum(n[many]) - n[many], n[many])
                each = np.repeat(at[many], n[many]) + step
                key = hasher(each, each + size)
                held.add(raw, hasher, np.repeat(cid[many], n[many]), each, np.repeat(start[many], n[many]) + step, np.ones(len(each), np.int64), key)
                at, n, h, cid, start = (x[~many] for x in (at, n, h, cid, start))
            if len(at):
                held.add(raw, hasher, cid, at, start, n, h)
            if held.size > 12 << 20:
                yield from held.emit()
        if held.parts:
            yield from held.emit()
        K.trim()

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cids, starts, ns, raws = [], [], [], []
        for batch in batches:
            for c, s, n, r in zip(*(batch.column(x).to_pylist() for x in ("cid", "start", "n", "raw"))):
                cids.append(np.frombuffer(c, np.int64))
                starts.append(np.frombuffer(s, np.int64))
                ns.append(np.frombuffer(n, np.int32).astype(np.int64))
                raws.append(np.frombuffer(r, np.uint8))
        cid, start, n, raw = (np.concatenate(x) for x in (cids, starts, ns, raws))
        del cids, starts, ns, raws
        copy = n < 0
        out = [(cid[copy], start[copy], -n[copy])]
        cid, start, n = cid[~copy], start[~copy], n[~copy]
        if len(n):
            length = n + size - 1
            begin = np.cumsum(length) - length
            content = K.Hasher(raw)(begin, begin + length)
            again = copies(raw, begin, length, content, np.lexsort((start, cid, content)))  # equal runs of several batches
            out.append((cid[again], start[again], n[again]))
            order = np.lexsort((start, cid))
            order = order[~again[order]]
            cid, start, n, begin, length = cid[order], start[order], n[order], begin[order], length[order]
            to = np.cumsum(length) - length
            text = raw[np.arange(int(length.sum())) - np.repeat(to - begin, length)]
            del raw
            record = np.repeat(np.arange(len(n)), n)
            step = np.arange(len(record)) - np.repeat(np.cumsum(n) - n, n)
            valid = to[record] + step
            hit = np.flatnonzero(repeated(text, valid, size))
            if len(hit):
                new = np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (record[hit[1:]] != record[hit[:-1]])])
                first = np.flatnonzero(new)
                count = np.diff(np.append(first, len(hit)))
                out.append((cid[record[hit[first]]], start[record[hit[first]]] + step[hit[first]], count))
        a, b, c = (np.concatenate(x) for x in zip(*out))
        for i in range(0, len(a), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 200_000].astype(np.int64)) for x in (a, b, c)], ["_cid", "start", "n"])
        K.trim()

    sent = texts.mapInArrow(send, "bucket int, cid binary, start binary, n binary, raw binary")
    return sent.groupBy("bucket").applyInArrow(sort, "_cid long, start long, n long")


def cut_out(raw: bytes, starts: list[int], counts: list[int], size: int) -> tuple[int, int, str]:
    """Bytes removed, maximal runs of them, and the digest of the rest."""
    digest, removed, spans, at = hashlib.sha256(), 0, 0, 0
    for start, n in sorted(zip(starts, counts)):
        end = start + n - 1 + size
        if start > at or not spans:
            digest.update(raw[at:start])
            spans += 1
            removed += end - start
        else:
            removed += max(0, end - at)
        at = max(at, end)
    digest.update(raw[at:])
    return removed, spans, digest.hexdigest()


def dedup(
    docs: DataFrame, size: int = 100, gram: int = GRAM, on: str = "doc_id", text: str = "text", hot: int = HOT, bucket_bytes: int = BUCKET_BYTES,
    map_bits: int = MAP_BITS, count_bytes: int = COUNT_BYTES, small_classes: int = BROADCAST_CLASSES,
) -> DataFrame:
    """For each row: its id, n_bytes, n_removed, n_spans and kept_sha256."""
    t = F.coalesce(F.col(text), F.lit("")).cast("binary")
    flat = docs.select(F.coalesce(whole_ids(docs, on), F.lit(NO_ID)).alias("_id"), t.alias("_text"))
    key = F.unhex(F.sha2("_text", 256))
    rows = flat.select("_id", key.alias("_key"), F.octet_length("_text").cast("long").alias("_n"))
    rows = stored(rows.groupBy("_id", "_key").agg(F.max("_n").alias("_n"), F.count("*").alias("_m")), "rows")
    grouped = rows.groupBy("_key").agg(F.min("_id").alias("_rep"), F.max("_n").alias("_n"), F.min_by("_m", "_id").alias("_m"))
    long_ = grouped.where(F.col("_n") >= size)
    classes, totals = running(long_, [F.col("_rep"), F.col("_key")], {"_cid": F.lit(1), "_at": F.col("_n")}, "classes")
    classes = stored(classes.select("_cid", "_rep", "_key", "_m"), "classes")
    small = totals["_cid"] <= small_classes
    keyed = classes.withColumnRenamed("_key", "_own")
    texts = flat.join(F.broadcast(keyed) if small else keyed, F.col("_id") == F.col("_rep")).where(key == F.col("_own"))
    # a text that one id has on several rows takes part once
    own = ["_cid", "_rep", "_own", "_text"]
    once = texts.where("_m = 1").select(own)
    if classes.where("_m > 1").limit(1).count():
        once = once.unionByName(stored(texts.where("_m > 1").select(own).dropDuplicates(["_cid"]), "again"))
    texts = once
    if map_bits_for(totals["_at"]) <= map_bits:
        bitmap, bits, n_runs, hot_ones = marked(texts.select("_text"), totals["_at"], size, gram, hot, count_bytes)
        sources, known = texts, (bitmap, bits, hot_ones)
    else:
        runs, n_runs = located(texts, size, gram, hot)
        sources, known = texts.join(runs, "_cid"), None
    buckets = max(1, -(-n_runs * (size + gram) // bucket_bytes))
    found = intervals(sources.select("_cid", "_text", *([] if known else ["_runs"])), known, buckets, size, gram)
    starts, counts = F.collect_list("start").alias("_starts"), F.collect_list("n").alias("_counts")  # in one order, as both skip nothing
    lists = found.groupBy("_cid").agg(starts, counts)  # of one text each
    # by id and key, as the texts of many classes are already shuffled that way
    lists = lists.join(classes.select("_cid", "_rep", F.col("_key").alias("_own")), "_cid").drop("_cid")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in K.pieces(batches, "_text"):
            out = []
            for raw, starts, counts in zip(*(piece.column(c).to_pylist() for c in ("_text", "_starts", "_counts"))):
                out.append(cut_out(raw, starts or [], counts or [], size))
            made = [pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([piece.column("_own"), piece.column("_rep"), *made], ["_key", "_id", "_removed", "_spans", "_kept"])

    done = texts.join(lists, ["_rep", "_own"], "left").select("_own", "_rep", "_text", "_starts", "_counts")
    done = done.mapInArrow(finish, "_key binary, _id long, _removed long, _spans long, _kept string")
    all_ = rows.join(done, ["_key", "_id"], "left")
    first, short = F.col("_kept").isNotNull(), F.col("_n") < size
    # the first row of a class keeps what its windows leave, others of at least `size` bytes nothing, shorter ones all
    found = F.struct(F.col("_removed").alias("a"), F.col("_spans").alias("b"), F.col("_kept").alias("c"))
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    rest = F.struct(
        F.when(short, F.lit(0)).otherwise(F.col("_n")).cast("long").alias("a"), F.when(short, 0).otherwise(1).cast("long").alias("b"),
        F.when(short, F.lower(F.hex("_key"))).otherwise(nothing).alias("c"),
    )
    # equal rows are given one by one, in chunks, as a third of all rows may be equal
    chunks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("_m") - 1) / 10_000))
    shown = all_.select("_id", "_n", F.when(first, found).alias("_first"), rest.alias("_rest"), "_m", F.explode(chunks).alias("_chunk"))
    here = F.least(F.lit(10_000), F.col("_m") - F.col("_chunk") * 10_000).cast("int")
    of_first = (F.col("_chunk") == 0) & F.col("_first").isNotNull()
    each = F.when(of_first, F.concat(F.array("_first"), F.array_repeat("_rest", here - 1))).otherwise(F.array_repeat("_rest", here))
    shown = shown.select(F.when(F.col("_id") != NO_ID, F.col("_id")).alias(on), F.col("_n").alias("n_bytes"), F.explode(each).alias("_x"))
    return shown.select(on, "n_bytes", F.col("_x.a").alias("n_removed"), F.col("_x.b").alias("n_spans"), F.col("_x.c").alias("kept_sha256"))


def brute_force(docs: list[tuple], size: int = 100) -> list[tuple]:
    """What dedup() gives, from the definition, for tests."""
    seen, out = set(), []
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is not None, docs[i][0] or 0, hashlib.sha256((docs[i][1] or "").encode()).digest()))
    for i in order:
        raw = (docs[i][1] or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - size + 1):
            s = raw[k : k + size]
            if s in seen:
                gone[k : k + size] = b"\x01" * size
            seen.add(s)
        runs = sum(1 for k in range(len(raw)) if gone[k] and not (k and gone[k - 1]))
        out.append((docs[i][0], len(raw), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest()))
    return out

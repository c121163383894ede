"""Benchmark decontamination (4): one Aho-Corasick automaton over all benchmark windows, run once over each whole text.

Texts are normalised to lower-case words. Every item gives its windows of 10 consecutive words (an item of fewer words gives
one window of all of them); all windows of all items form one automaton, so that a text is scanned once whatever the number of
items. Matches are word intervals; they are mapped back to code points of the original text.

The automaton works on numbers of words and lies in a few arrays: its trie is built level by level, so that a node's number is
the rank of its edge (parent and word) among all edges, and goto is a binary search; failure and output links are arrays too.
Texts are cut into stretches that overlap by a window less one word, and all stretches of a piece are scanned in step.

The automaton is built in each Python worker from the broadcast items, in about 75 bytes for each byte of items. A benchmark of
more than `block_bytes` is cut into blocks by a hash of item and text, items of more than `block_bytes` / 4 into overlapping
parts, and the texts are scanned once for each block, so that neither broadcast nor automaton grows.

Defined cases: a null or empty text has no words and isn't contaminated; items without words have no window; a null item id
is named ""; items of equal ids count once; an empty benchmark contaminates nothing; an empty table gives an empty result; texts
and items have any length; repeated documents are judged each alike; all columns are passed on, and the findings are in one
struct of a free name.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as K
from .plan import stored
from .quality_rules import free_name

WINDOW = 10
#: items of one automaton: 4 MB of them take a worker some 300 MB while it is built
BLOCK_BYTES = 4 << 20
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_IS_WORD = np.array([c != 32 for c in _TABLE])

SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
FOUND = T.StructType(
    [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())),
     T.StructField("words", T.ArrayType(SPAN)), T.StructField("spans", T.ArrayType(SPAN))]
)


def normal_words(raw: bytes) -> list[bytes]:
    return raw.translate(_TABLE).split()


#: words of a stretch
STRETCH = 64


class Matcher:
    """The automaton of (item id, text) pairs; node 0 is the root, words of no item have number 0."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        number = lambda w: self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        names = sorted({name or "" for name, _ in items})
        self.names = np.array(names, object)
        place = {name: i for i, name in enumerate(names)}
        texts, starts, owners, sizes, at = [], [], [], [], 0
        for name, text in items:
            words = normal_words((text or "").encode())
            if words:
                n = max(1, len(words) - window + 1)
                texts.append(np.fromiter(map(number, words), np.int64, len(words)))
                starts.append(at + np.arange(n))
                sizes.append(np.full(n, min(len(words), window)))
                owners.append(np.full(n, place[name or ""]))
                at += len(words)
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        self._build(join(texts), join(starts), join(sizes), join(owners))

    def _build(self, text: np.ndarray, start: np.ndarray, size: np.ndarray, owner: np.ndarray) -> None:
        edges, depths, ends, of = [], [0], [], []
        node, n, offsets = np.zeros(len(start), np.int64), 1, [0]
        for depth in range(1, self.window + 1):
            keys, inverse = np.unique((node << 32) | text[start + depth - 1], return_inverse=True)
            edges.append(keys)
            node = n + inverse
            n += len(keys)
            offsets.append(len(keys))
            done = size == depth
            ends.append(node[done])
            of.append(owner[done])
            start, size, owner, node = (x[~done] for x in (start, size, owner, node))
            if not len(start):
                break
        #: sorted, as parents of one level are smaller than those of the next: edge i leads to node i + 1
        self.edges = np.concatenate(edges) if edges else np.zeros(0, np.int64)
        del edges, node
        self.depth = np.repeat(np.arange(len(offsets), dtype=np.int8), [1, *offsets[1:]])
        #: where the edges of a node begin; most have one
        self.edge = np.zeros(n + 1, np.int32)
        own = np.flatnonzero(np.diff(self.edges >> 32, prepend=-1))
        self.edge[(self.edges[own] >> 32) + 1] = np.diff(own, append=len(self.edges))
        np.cumsum(self.edge, out=self.edge)
        #: the root's edges by word
        self.root = np.zeros(len(self.vocabulary) + 1, np.int32)
        self.root[self.edges[: self.edge[1]]] = 1 + np.arange(self.edge[1])
        self.fail = np.zeros(n, np.int32)
        level = 1 + np.cumsum([0, *offsets[1:]])
        ranges = [(a, min(a + 200_000, z)) for lo, z in zip(level[1:-1].tolist(), level[2:].tolist()) for a in range(lo, z, 200_000)]  # from depth 2 on
        for a, z in ranges:
            key = self.edges[a - 1 : z - 1]
            self.fail[a:z] = self.step(self.fail[key >> 32].astype(np.int64), key & 0xFFFFFFFF)
        # items of the nodes at which windows end, and the next such node on the way of failures
        pair = np.unique((np.concatenate(ends) << 32) | np.concatenate(of)) if ends else np.zeros(0, np.int64)
        self.ending, self.owner = (pair >> 32).astype(np.int32), (pair & 0xFFFFFFFF).astype(np.int32)
        self.output = np.zeros(n, np.int32)
        self.output[self.ending] = self.ending
        for a, z in ranges:
            none = a + np.flatnonzero(self.output[a:z] == 0)
            self.output[none] = self.output[self.fail[none]]
        self.empty = n == 1

    def step(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The states after one more word each: goto, or that of the first failure that has one."""
        out = np.zeros(len(state), np.int64)
        left = np.flatnonzero(word)
        while len(left):
            s, w = state[left], word[left]
            at_root = s == 0
            out[left[at_root]] = self.root[w[at_root]]
            left, s, w = left[~at_root], s[~at_root], w[~at_root]
            key, at = (s << 32) | w, self.edge[s].astype(np.int64)
            many = self.edge[s + 1] - at
            at[many == 0] = 0
            several = np.flatnonzero(many > 1)
            at[several] = np.minimum(np.searchsorted(self.edges, key[several]), len(self.edges) - 1)
            found = self.edges[at] == key
            out[left[found]] = at[found] + 1
            left = left[~found]
            state[left] = self.fail[state[left]]
        return out

    def items_at(self, node: int) -> np.ndarray:
        return self.names[self.owner[np.searchsorted(self.ending, node) : np.searchsorted(self.ending, node, "right")]]

    def scan(self, texts: list[bytes]) -> tuple[list[int], list[list[tuple[int, int]]], list[set[str]]]:
        """For each text its number of words, the merged word intervals that matches cover, and the items found."""
        get = self.vocabulary.get
        split = [normal_words(t) for t in texts]
        counts = [len(w) for w in split]
        first = np.concatenate([[0], np.cumsum(counts)])
        intervals: list[list[tuple[int, int]]] = [[] for _ in texts]
        items: list[set[str]] = [set() for _ in texts]
        if self.empty or not first[-1]:
            return counts, intervals, items
        word = np.fromiter((get(w, 0) for words in split for w in words), np.int64, int(first[-1]))
        del split
        # stretches: own words from `begin`, after as many of the same text as a window may reach back
        per = -(-np.diff(first) // STRETCH)
        row = np.repeat(np.arange(len(texts)), per)
        begin = first[row] + STRETCH * (np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per))
        stop = np.minimum(begin + STRETCH, first[row + 1])
        at = np.maximum(begin - self.window + 1, first[row])
        order = np.argsort(at - stop, kind="stable")  # longest first, so that those that go on are a prefix
        at, begin, stop = at[order], begin[order], stop[order]
        state, ends, nodes = np.zeros(len(at), np.int64), [], []
        while len(at):
            state = self.step(state, word[at])
            hit = np.flatnonzero((self.output[state] != 0) & (at >= begin))
            if len(hit):
                ends.append(at[hit] + 1)
                nodes.append(self.output[state[hit]].astype(np.int64))
            at = at + 1
            on = int(np.count_nonzero(at < stop))
            at, begin, stop, state = at[:on], begin[:on], stop[:on], state[:on]
        if not ends:
            return counts, intervals, items
        end, node = np.concatenate(ends), np.concatenate(nodes)
        every = []
        while len(node):  # shorter windows that end at the same word
            every.append((end, node))
            node = self.output[self.fail[node]].astype(np.int64)
            end, node = end[node != 0], node[node != 0]
        end, node = (np.concatenate(x) for x in zip(*every))
        for k, a, b, n in zip((np.searchsorted(first, end - 1, "right") - 1).tolist(), (end - self.depth[node]).tolist(), end.tolist(), node.tolist()):
            intervals[k].append((a - int(first[k]), b - int(first[k])))
            items[k].update(self.items_at(n))
        return counts, [_merge(x, []) for x in intervals], items


def source_spans(raw: bytes, intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code-point spans in the original text of word intervals."""
    data = np.frombuffer(raw, np.uint8)
    starts, ends, _ = K.spans(_IS_WORD[data], np.array([0, len(data)]))
    lead = np.concatenate([[0], np.cumsum(K.IS_LEAD[data])])
    return [(int(lead[starts[a]]), int(lead[ends[b - 1]])) for a, b in intervals]


_matchers: dict[str, Matcher] = {}


def _merge(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for start, end in sorted(a + b):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(merged[-1][1], end))
        else:
            merged.append((start, end))
    return merged


def _scan_block(docs: DataFrame, items: DataFrame, text: str, name: str, window: int) -> DataFrame:
    """One pass over the texts; adds to the struct `name`, where the input has it already."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast([(r[0], r[1]) for r in items.collect()])  # at most block_bytes
    key, again = uuid.uuid4().hex, name in docs.columns
    schema = docs.schema if again else T.StructType([*docs.schema.fields, T.StructField(name, FOUND)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _matchers:
            _matchers.clear()
            _matchers[key] = Matcher(shared.value, window)
        matcher = _matchers[key]
        struct = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string()))] + [(c, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))) for c in ("words", "spans")])
        for piece in K.pieces(batches, text):
            raw, offsets = K.text_bytes(piece.column(text))
            raw, out = raw.tobytes(), []
            earlier = piece.column(name).to_pylist() if again else [None] * piece.num_rows
            texts = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            for doc, old, n, found, names in zip(texts, earlier, *matcher.scan(texts)):
                if old:
                    found = _merge(found, [(x["start"], x["end"]) for x in old["words"]])
                    names = names.union(old["items"])
                pairs = [[{"start": a, "end": b} for a, b in x] for x in (found, source_spans(doc, found) if found else [])]
                out.append({"n_words": n, "n_hit": sum(b - a for a, b in found), "items": sorted(names, key=str.encode), "words": pairs[0], "spans": pairs[1]})
            column = pa.array(out, struct)
            rest = [c for c, k in zip(piece.columns, piece.schema.names) if k != name]
            yield pa.RecordBatch.from_arrays([*rest, column], [*(k for k in piece.schema.names if k != name), name])

    return docs.select(*[c for c in docs.columns if c != name], *([name] if again else [])).mapInArrow(run, schema)


def _parts(items: DataFrame, window: int, most: int) -> DataFrame:
    """Items of more than `most` bytes in parts that overlap by a window less one word, so that each window is in one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts = [text or ""]
                if len(parts[0]) > most:
                    words = [w.decode() for w in normal_words(text.encode())]
                    ends = np.cumsum([len(w.encode()) + 1 for w in words])
                    parts, at = [], 0
                    while at == 0 or at + window <= len(words):
                        to = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most)), at + 1)
                        parts.append(" ".join(words[at : to + window - 1]))
                        at = to
                for i in range(0, len(parts), 100):
                    own = parts[i : i + 100]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(own)), pa.array(own)], ["item", "text"])

    return items.mapInArrow(run, "item string, text string")


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", name: str = "found", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows with a struct appended: n_words, n_hit, items, and the hit words as word intervals and as code-point spans."""
    if name in docs.columns:
        raise ValueError(f"the input has a column {name!r}")
    items = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(item_text).alias("text")).distinct()
    size = items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    if size <= block_bytes:
        return _scan_block(docs, items, text, name, window)
    # parts by a hash: twice as many blocks as would do, so that none is much larger than it may be
    parts = stored(_parts(items, window, block_bytes // 4), "items")
    blocks = -(-2 * size // block_bytes)
    out = docs
    for b in range(blocks):
        out = _scan_block(out, parts.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b), text, name, window)
        if b < blocks - 1:
            out = stored(out, "decontamination")
    return out


def report(found: DataFrame, on: str = "doc_id", name: str = "found") -> DataFrame:
    f = F.col(name)
    return found.select(
        on, f.n_words.alias("n_words"), f.n_hit.alias("n_hit"), F.size(f["items"]).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", f["items"]), 256).alias("items_sha256"), (f.n_hit > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that hold no benchmark window, with the same columns."""
    name = free_name(docs, "_found")
    return find(docs, benchmark, name=name, **options).where(F.col(name).n_hit == 0).select(*docs.columns)


def brute_force(docs: list[tuple], items: list[tuple], window: int = WINDOW) -> list[tuple]:
    """What report() gives, from the definition, for tests."""
    wins = [(str(i) if i is not None else "", [w[k : k + window] for k in range(max(1, len(w) - window + 1))]) for i, t in items if (w := normal_words((t or "").encode()))]
    out = []
    for doc_id, text in docs:
        words = normal_words((text or "").encode())
        hit, names = set(), set()
        for name, windows in wins:
            for win in windows:
                for k in range(len(words) - len(win) + 1):
                    if words[k : k + len(win)] == win:
                        hit.update(range(k, k + len(win)))
                        names.add(name)
        out.append((doc_id, len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return out

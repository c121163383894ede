"""Token-ID output (2): raw id payloads in shards, with a minimal perfect hash index from document keys to shard offsets.

Texts are range-partitioned by id and sorted; each task encodes its slice and writes one shard: a header of 16 bytes (magic,
bytes per id, unused) and then the ids of its documents one after another, little-endian, two bytes each where the
vocabulary allows. Encoding looks words up in a table of each worker, as white space is where the tokenizer cuts: a document
is the concatenation of its words' ids; only words that aren't in the table go through the tokenizer, in batches. That holds
for tokenizers that cut at white space and drop it, as is verified on load with the pieces of a probe text; others encode whole texts.

The index is split by a hash of the key. Each part is a minimal perfect hash in the manner of nested bit arrays: at every level
the keys that fall alone on a bit stay, the others go on to the next; a key's number is the rank of its bit. A table by that
number has a 32-bit fingerprint, by which other keys are told apart, shard, offset, count, and the ids of all documents before.
So a lookup costs a few probes and one read, whatever the corpus size.

Defined cases: a null or empty text has the end id only; repeated ids have a key for each row (id and number of the row, in the
order of a hash of the text); a null id is a key, the first; ids that aren't whole numbers raise an error; an empty table gives no shard and an empty result; other
columns aren't read.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .plan import new_path, stored, whole_ids

U64 = np.uint64
MAGIC = b"SLTOKEN1"
HEADER = 16
#: words that a worker keeps at most, about 200 bytes each, and letters of words likewise; of these there are fewer new ones
WORDS = 500_000
CORES = 800_000
#: lower-case Latin-1 letters, and signs that no contraction begins with
_CORE = re.compile("[a-zß-öø-ÿ]+")
SIGNS = ".,;:!?*$%&#|()"
#: bytes of text whose words are looked up together
PIECE = 1 << 22
#: cores that are encoded as one text, with a sign between them
JOINED = 500
INDEX_KEYS = 200_000
#: rows of one id that are numbered at a time
CHUNK = 10_000


# --- encoding --------------------------------------------------------------------------------------------------------


class Encoder:
    """Encodes whole texts to bytes of ids.

    Two tables: words as they stand, and cores. A word of Latin-1 letters with ASCII signs behind is its lower-case letters and its
    signs, where the tokenizer lower-cases and cuts between letters and signs; so most new words are made of known cores. New cores
    are encoded many at a time, as one text.
    """

    def __init__(self, path: str, end: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if max(self.tokenizer.get_vocab_size(with_added_tokens=True), end + 1) <= 1 << 16 else "<u4")
        self.end = np.array([end], self.dtype).tobytes()
        self.words: dict[bytes, bytes] = {}
        self.cores: dict[str, bytes | None] = {}
        self.tails: dict[str, bytes] = {}
        probe = " Probe,  it's 1\t23 café-s\n\n<|end|> ß! 你好 x́ .. "
        self.by_word = self._ids([probe])[0] == b"".join(self._ids([w.decode() for w in probe.encode().split()]))
        cases = ["Ab", "ÉÀçß", "Öñ", "The", "s", "É", "Ç"]
        tails = ["", ",", ".", "!!", ",***", ".&&&", "%%%", "$$$", "###", "?!", ";", ":", ")"]
        self.by_core = self.by_word and self._ids([c + t for c in cases for t in tails]) == [x + y for x in self._ids([c.lower() for c in cases]) for y in (self._ids([t])[0] for t in tails)]

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, cores: list[str]) -> list[bytes]:
        """_ids() of cores, many at once: the tokenizer cuts at the signs between them, whose id no letters have."""
        out: list[bytes] = []
        sign, width = self._ids(["."])[0], self.dtype.itemsize
        cut_at = np.frombuffer(sign, self.dtype)
        for i in range(0, len(cores), JOINED):
            some = cores[i : i + JOINED]
            raw = self._ids([".".join(some)])[0]
            cuts = (np.flatnonzero(np.frombuffer(raw, self.dtype) == cut_at[0]) * width).tolist() if len(cut_at) == 1 else []
            if len(cuts) == len(some) - 1:
                out += [raw[a:b] for a, b in zip([0, *(c + width for c in cuts)], [*cuts, len(raw)])]
            else:
                out += self._ids(some)
        return out

    def _new(self, words: list[str]) -> list[bytes]:
        if not self.by_core:
            return self._ids(words)
        heads = [w.rstrip(SIGNS) for w in words]
        # the few other letters whose lower case is a core's are the same letters to the tokenizer too
        cores = "\n".join(heads).lower().split("\n")
        every = set(cores)
        new = every.difference(self.cores)
        if len(self.cores) + len(new) > CORES:
            self.cores.clear()
            new = every
        letters = [c for c in new if _CORE.fullmatch(c)]
        self.cores.update(dict.fromkeys(new))  # null: no core
        self.cores.update(zip(letters, self._letters(letters)))
        tails = [w[len(h) :] for w, h in zip(words, heads)]
        signs = list(set(tails).difference(self.tails))
        if len(self.tails) + len(signs) > CORES // 8:
            self.tails.clear()
            signs = list(set(tails))
        self.tails.update(zip(signs, self._ids(signs)))
        ids, tail = list(map(self.cores.__getitem__, cores)), self.tails.__getitem__
        other = [i for i, x in enumerate(ids) if x is None]
        out = [x + tail(t) if t and x is not None else x for x, t in zip(ids, tails)]
        for i, x in zip(other, self._ids([words[i] for i in other])):
            out[i] = x
        return out

    def __call__(self, raw: bytes, offsets: np.ndarray) -> list[bytes]:
        texts = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        if not self.by_word:
            return [x + self.end for x in self._ids([t.decode() for t in texts])]
        split = [t.split() for t in texts]
        every = set().union(*split)
        new = list(every.difference(self.words))
        if len(self.words) + len(new) > WORDS:
            self.words.clear()
            new = list(every)
        if new:
            self.words.update(zip(new, self._new(b"\n".join(new).decode().split("\n"))))
        get = self.words.__getitem__
        return [b"".join(map(get, words)) + self.end for words in split]


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, end: int) -> Encoder:
    if (path, end) not in _encoders:
        _encoders[path, end] = Encoder(path, end)
    return _encoders[path, end]


# --- minimal perfect hash --------------------------------------------------------------------------------------------


def _bit(h1: np.ndarray, h2: np.ndarray, level: int, bits: int) -> np.ndarray:
    return (K.mix(h1 ^ K.mix(h2 + U64(level * 0x9E3779B97F4A7C15 % (1 << 64)))) % U64(bits)).astype(np.int64)


class PerfectHash:
    """Numbers 0 to n - 1 for n distinct 128-bit keys, from about three bits a key."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # words of 64 bits
        counts = [np.bitwise_count(x).astype(np.int64) for x in levels]
        self.before, total = [], 0
        for c in counts:
            self.before.append(total + np.concatenate([[0], np.cumsum(c)[:-1]]) if len(c) else np.zeros(0, np.int64))
            total += int(c.sum())
        self.n = total

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray, spread: float = 2.0, most: int = 200) -> PerfectHash:
        levels: list[np.ndarray] = []
        while len(h1):
            if len(levels) == most:
                raise ValueError("the keys aren't distinct")
            size = max(64, -(-int(spread * len(h1)) // 64) * 64)
            bit = _bit(h1, h2, len(levels), size)
            counts = np.bincount(bit, minlength=size)
            levels.append(np.packbits(counts == 1, bitorder="little").view("<u8"))
            again = counts[bit] > 1
            h1, h2 = h1[again], h2[again]
        return cls(levels)

    def __call__(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The numbers of keys; -1, or any number, for keys that it wasn't built from."""
        out = np.full(len(h1), -1, np.int64)
        left = np.arange(len(h1))
        for level, (words, before) in enumerate(zip(self.levels, self.before)):
            bit = _bit(h1[left], h2[left], level, len(words) * 64)
            word, shift = words[bit >> 6], (bit & 63).astype(U64)
            here = (word >> shift) & U64(1) == 1
            below = np.bitwise_count(word & ((U64(1) << shift) - U64(1)))
            out[left[here]] = before[bit[here] >> 6] + below[here]
            left = left[~here]
        return out


def _entry() -> np.dtype:
    return np.dtype([("print", "<u4"), ("shard", "<u4"), ("offset", "<u8"), ("start", "<u8"), ("count", "<u4")])


def pack_index(h1: np.ndarray, h2: np.ndarray, shard: np.ndarray, offset: np.ndarray, start: np.ndarray, count: np.ndarray) -> bytes:
    ph = PerfectHash.build(h1, h2)
    table = np.zeros(len(h1), _entry())
    at = ph(h1, h2)
    for name, values in (("print", (K.mix(h2) >> U64(32)).astype(np.uint32)), ("shard", shard), ("offset", offset), ("start", start), ("count", count)):
        table[name][at] = values
    sizes = np.array([len(ph.levels), *map(len, ph.levels)], "<i8")
    return sizes.tobytes() + b"".join(x.tobytes() for x in ph.levels) + table.tobytes()


def unpack_index(raw: bytes) -> tuple[PerfectHash, np.ndarray]:
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    sizes = np.frombuffer(raw, "<i8", n, 8).tolist()
    at, levels = 8 * (n + 1), []
    for size in sizes:
        levels.append(np.frombuffer(raw, "<u8", size, at))
        at += 8 * size
    return PerfectHash(levels), np.frombuffer(raw, _entry(), -1, at)


def look_up(index: tuple[PerfectHash, np.ndarray], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Entries of keys; count 0 (and shard 0) for such as aren't there, as told by their fingerprints."""
    ph, table = index
    at = ph(h1, h2)
    out = np.zeros(len(h1), table.dtype)
    there = (at >= 0) & (at < len(table))
    out[there] = table[at[there]]
    wrong = out["print"] != (K.mix(h2) >> U64(32)).astype(np.uint32)
    out[wrong | ~there] = np.zeros(1, table.dtype)
    return out


# --- the plan --------------------------------------------------------------------------------------------------------


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def key_columns(on: str, row: str) -> list:
    key = (F.coalesce(F.col(on).cast("string"), F.lit("\0")), F.col(row).cast("string"))
    return [F.xxhash64(*key).alias("_h1"), F.xxhash64(F.lit("second"), *key).alias("_h2")]


def write(docs: DataFrame, path: str, tokenizer: str, end: int = 2, on: str = "doc_id", text: str = "text", shards: int | None = None) -> DataFrame:
    """Writes shards under path; returns, stored, (_id, _row, _shard, _file, _offset, _count) for each document."""
    spark = docs.sparkSession
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    flat = docs.select(whole_ids(docs, on).alias("_id"), F.col(text).alias("_text"), F.monotonically_increasing_id().alias("_tie"))
    order = [F.col("_id").asc_nulls_first(), F.xxhash64("_text"), F.col("_tie")]
    ranged = flat.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("_tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(tokenizer, end)
        fs, base = _open(path)
        fs.create_dir(base, recursive=True)
        shard = TaskContext.get().partitionId()
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}.bin"  # each attempt has its own; only that of the one that counts is indexed
        out, offset, last, row = None, 0, (), 0
        try:
            for piece in K.pieces(batches, "_text", PIECE):
                if out is None:
                    out = fs.open_output_stream(f"{base}/{name}")
                    out.write(MAGIC + np.array([encode.dtype.itemsize, 0], "<u4").tobytes())
                raw, offsets = K.text_bytes(piece.column("_text"))
                found = encode(raw.tobytes(), offsets)
                out.write(b"".join(found))
                counts = np.array([len(x) for x in found], np.int64) // encode.dtype.itemsize
                rows = []
                for i in piece.column("_id").to_pylist():
                    row = row + 1 if last == (i,) else 0
                    last = (i,)
                    rows.append(row)
                begins = offset + np.cumsum(counts) - counts
                offset += int(counts.sum())
                k = piece.num_rows
                yield pa.RecordBatch.from_arrays(
                    [piece.column("_id"), pa.array(rows, pa.int64()), pa.array([shard] * k, pa.int32()), pa.array([name] * k), pa.array(begins), pa.array(counts)],
                    ["_id", "_row", "_shard", "_file", "_offset", "_count"],
                )
        finally:
            if out is not None:
                out.close()

    written = stored(ranged.mapInArrow(run, "_id long, _row long, _shard int, _file string, _offset long, _count long"), "written")
    # rows of one id may go on in the next shard, so their numbers do too
    edges = written.groupBy("_shard").agg(F.min_by("_id", "_offset").alias("first"), F.max_by("_id", "_offset").alias("last"), F.max_by("_row", "_offset").alias("row")).orderBy("_shard").collect()  # a row for each shard
    carry, before, carried = [], None, 0
    for e in edges:
        carried = carried if before is not None and before["last"] == e["first"] else 0
        if carried:
            carry.append((e["_shard"], e["first"], carried))
        carried = e["row"] + 1 + (carried if e["first"] == e["last"] else 0)
        before = e
    if carry:
        table = F.broadcast(spark.createDataFrame(carry, "_shard int, _first long, _carry long"))
        joined = written.join(table, "_shard", "left")
        more = F.when(F.col("_id").eqNullSafe(F.col("_first")), F.coalesce("_carry", F.lit(0))).otherwise(0)
        written = joined.withColumn("_row", F.col("_row") + more).select(*written.columns)
    return written


def index(written: DataFrame, path: str) -> tuple[DataFrame, dict[int, str], int]:
    """Writes the index under path; returns its stored (part, file) table, the shards' files, and the number of parts."""
    spark = written.sparkSession
    shards = written.groupBy("_shard").agg(F.sum("_count").alias("n"), F.count("*").alias("docs"), F.first("_file").alias("file")).orderBy("_shard").collect()  # a row for each shard
    before, starts = 0, []
    for r in shards:
        starts.append((r[0], before))
        before += r[1]
    parts = max(1, -(-sum(r[2] for r in shards) // INDEX_KEYS))
    keyed = written.select(*key_columns("_id", "_row"), "_shard", "_offset", "_count")
    if starts:
        keyed = keyed.join(F.broadcast(spark.createDataFrame(starts, "_shard int, _before long")), "_shard")
    else:
        keyed = keyed.withColumn("_before", F.lit(0).cast("long"))
    keyed = keyed.withColumn("_part", F.pmod(F.col("_h1"), F.lit(parts)).cast("int"))

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        c = lambda name: table.column(name).to_numpy()
        raw = pack_index(c("_h1").view(U64), c("_h2").view(U64), c("_shard"), c("_offset"), c("_before") + c("_offset"), c("_count"))
        fs, base = _open(path)
        fs.create_dir(base, recursive=True)
        name = f"index-{key[0].as_py():06d}-{uuid.uuid4().hex}.mph"
        with fs.open_output_stream(f"{base}/{name}") as out:
            out.write(raw)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([name])], ["part", "file"])

    return stored(keyed.groupBy("_part").applyInArrow(run, "part int, file string"), "index"), {r[0]: r[3] for r in shards}, parts


def read(keys: DataFrame, path: str, indexed: tuple[DataFrame, dict[int, str], int], on: str = "_id", row: str = "_row") -> DataFrame:
    """For keys (on, row) the start, n_tokens and ids (4 bytes each, little-endian), read through the index; null where there is none."""
    spark = keys.sparkSession
    files, shards, parts = indexed
    hashed = keys.select(F.col(on).alias("_id"), F.col(row).alias("_row"), *key_columns(on, row))
    hashed = hashed.withColumn("_part", F.pmod(F.col("_h1"), F.lit(parts)).cast("int"))
    shared = spark.sparkContext.broadcast((dict(files.collect()), shards))  # names of files

    def probe(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(path)
        name = shared.value[0].get(key[0].as_py())
        loaded = None
        if name:
            with fs.open_input_file(f"{base}/{name}") as f:
                loaded = unpack_index(f.read())
        for batch in batches:
            n = batch.num_rows
            h1, h2 = (batch.column(c).to_numpy().view(U64) for c in ("_h1", "_h2"))
            found = look_up(loaded, h1, h2) if loaded else np.zeros(n, _entry())
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_row"), *(pa.array(found[c].astype(t)) for c, t in (("shard", np.int32), ("offset", np.int64), ("start", np.int64), ("count", np.int64)))],
                ["_id", "_row", "_shard", "_offset", "_start", "_count"],
            )

    found = hashed.groupBy("_part").applyInArrow(probe, "_id long, _row long, _shard int, _offset long, _start long, _count long")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(path)
        handle, current, width = None, None, 2
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out = []
                for shard, offset, count in zip(*(part.column(c).to_pylist() for c in ("_shard", "_offset", "_count"))):
                    if not count:
                        out.append(None)
                        continue
                    if shard != current:
                        if handle:
                            handle.close()
                        handle, current = fs.open_input_file(f"{base}/{shared.value[1][shard]}"), shard
                        head = handle.read(HEADER)
                        if head[:8] != MAGIC:
                            raise ValueError("not a shard of ids")
                        width = int(np.frombuffer(head, "<u4", 1, 8)[0])
                    raw = handle.read_at(count * width, HEADER + offset * width)
                    out.append(np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes())
                there = pa.array([x is not None for x in out])
                null = pa.scalar(None, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_row"), pc.if_else(there, part.column("_start"), null), pc.if_else(there, part.column("_count"), null), pa.array(out, pa.binary())], ["_id", "_row", "start", "n_tokens", "ids"])

    near = found.repartition("_shard").sortWithinPartitions("_shard", "_offset")
    return near.mapInArrow(fetch, "_id long, _row long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, tokenizer: str, end: int = 2, on: str = "doc_id", text: str = "text", shards: int | None = None) -> DataFrame:
    """Writes the documents, indexes them, and reads each back by its key: id, start, n_tokens, ids_crc32."""
    path = new_path(docs.sparkSession, "tokens")
    indexed = index(write(docs, path, tokenizer, end, on, text, shards), path)
    many = docs.groupBy(whole_ids(docs, on).alias("_id")).count()
    # a third of all rows may have one id: their numbers are made in chunks, not in one array
    chunks = many.select("_id", "count", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("count") - 1) / CHUNK))).alias("_chunk"))
    first = F.col("_chunk") * CHUNK
    keys = chunks.select("_id", F.explode(F.sequence(first, F.least(first + CHUNK, F.col("count")) - 1)).alias("_row"))
    found = read(keys, path, indexed)
    return found.select(F.col("_id").alias(on), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def brute_force(docs: list[tuple], tokenizer: str, end: int = 2) -> list[tuple]:
    """What round_trip() gives for distinct ids, by encoding whole texts one by one, for tests."""
    from tokenizers import Tokenizer

    t, start, out = Tokenizer.from_file(tokenizer), 0, []
    for i, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, end]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out

"""Token ids in binary shards with a minimal perfect hash index.

Documents are range-partitioned and sorted by doc_id; each task encodes its
texts and writes shards.  A shard is one file:

    header    8 bytes b"IDSHARD1", then 6 little-endian uint64: bytes per id,
              documents, ids, keys, index levels, bytes of the level bits
    payload   the ids of all documents, end to end, little-endian
    starts    uint64 per document and one more: first id of each document
    keys      int64 per document; nulls: uint8 per document (1: no doc_id)
    index     levels: uint64 (bits per level); bits: packed bits of all levels;
              prints: uint32 per key; docs: uint32 per key (its first document)

The index is a cascade of bit arrays: at each level a key whose hashed bit no
other key wants is placed there, the rest go on.  The rank of a key's bit
among all set bits is its slot, so n keys fill n slots exactly.  The slot's
stored fingerprint tells absent keys.  A lookup is a few bit probes and one
read of the payload.

A text's ids are those of its pieces cut at single spaces after a
non-space character.  The tokenizer's own pre-tokenisation always cuts there,
so each distinct piece is encoded once per worker and its ids are reused.
A special token spelled out in a text has no space inside, so it lies in one
piece and gets its own id, as the library's encoder does by default.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohort_engine.llm import fsio, textkit
from cohort_engine.llm.store import new_folder, written

MAGIC = b"IDSHARD1"
SHARD_IDS = 1 << 24             # a shard is closed when it holds this many ids
SHARD_DOCS = 1 << 20            # or this many documents
CACHE_PIECES = 600_000          # pieces a worker keeps; then it starts anew
SLICE_BYTES = 1 << 20           # text bytes encoded at a time (one row at least)
JOIN = 2048                     # new pieces encoded as one text
END_ID = 2
_MANIFEST = "part int, number int, path string, first_key long, last_key long, docs long, ids long"
U64 = np.uint64


class Encoder:
    """Texts to ids with one tokenizer, reusing the ids of pieces."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.dtype = np.dtype("<u2" if max(vocab.values()) < 1 << 16 else "<u4")
        self.width = np.zeros(max(vocab.values()) + 1, np.int64)   # bytes of an id: a byte-level token has a character per byte
        for token, i in vocab.items():
            self.width[i] = len(token)
        self.reset()

    def reset(self) -> None:
        """Known pieces by hash (sorted), and where their ids are."""
        self.hashes, self.first, self.size = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, self.dtype)

    def _alone(self, texts: list[bytes]) -> list[np.ndarray]:
        got = self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [np.array(x.ids, self.dtype) for x in got]

    def _joined(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per piece) of pieces that are cut apart again by the
        tokenizer: joined to longer texts, whose ids' bytes give the ends."""
        ids, sizes = [], []
        for at in range(0, len(texts), JOIN):
            part = texts[at:at + JOIN]
            got = self._alone([b"".join(part)])[0]
            ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)))
            reach = np.cumsum(self.width[got])
            last = np.searchsorted(reach, ends)
            if not len(got) or reach[-1] != ends[-1] or (reach[last] != ends).any():   # not cut there: one by one
                each = self._alone(part)
                got, count = np.concatenate(each), np.array([len(x) for x in each], np.int64)
            else:
                count = np.diff(last + 1, prepend=0)
            ids.append(got)
            sizes.append(count)
        return np.concatenate(ids), np.concatenate(sizes)

    def _learn(self, hashes: np.ndarray, texts: list[bytes], joinable: np.ndarray) -> None:
        order = np.concatenate([np.flatnonzero(joinable), np.flatnonzero(~joinable)])
        n = int(joinable.sum())
        ids, sizes = self._joined([texts[i] for i in order[:n]]) if n else (np.zeros(0, self.dtype), np.zeros(0, np.int64))
        rest = self._alone([texts[i] for i in order[n:]])
        ids = np.concatenate([ids, *rest])
        sizes = np.concatenate([sizes, np.array([len(x) for x in rest], np.int64)])
        first = len(self.ids) + np.cumsum(sizes) - sizes
        self.ids = np.concatenate([self.ids, ids])
        h = np.concatenate([self.hashes, hashes[order]])
        by = np.argsort(h, kind="stable")
        self.hashes = h[by]
        self.first = np.concatenate([self.first, first])[by]
        self.size = np.concatenate([self.size, sizes])[by]

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.hashes, hashes)
        inside = at < len(self.hashes)
        inside[inside] = self.hashes[at[inside]] == hashes[inside]
        return at, inside

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, row pointer)."""
        raw, off = textkit.text_bytes(texts)
        starts, ptr, solid = piece_starts(raw, off)
        if len(starts) == 0:
            return np.zeros(0, self.dtype), np.zeros(len(off), np.int64)
        ends = np.append(starts[1:], len(raw))
        hashes, where, inverse = np.unique(textkit.hash_spans(raw, starts, ends, fold=False), return_index=True, return_inverse=True)
        if len(self.hashes) > CACHE_PIECES:
            self.reset()
        at, inside = self._find(hashes)
        if not inside.all():
            new, data = where[~inside], raw.tobytes()
            self._learn(hashes[~inside], [data[s:e] for s, e in zip(starts[new].tolist(), ends[new].tolist(), strict=True)],
                        (raw[starts[new]] == 0x20) & solid[ends[new] - 1])
            at, _ = self._find(hashes)
        slot = at[inverse]
        size = self.size[slot]
        ends_at = np.cumsum(size)
        begin = ends_at - size
        ids = self.ids[np.repeat(self.first[slot] - begin, size) + np.arange(int(ends_at[-1]))]
        return ids, np.append(begin, ends_at[-1])[ptr]


def piece_starts(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte positions where a piece starts, the row pointer into them, and
    which bytes end a character that is certainly no white space (multi-byte
    white space starts with C2, E1, E2 or E3).  A piece starts at a row's
    first byte and at a space after such a byte."""
    n = len(raw)
    solid = (raw > 0x20) & (raw != 0x7F)
    wide = raw >= 0x80
    if n > 2:
        wide[1:] &= raw[:-1] != 0xC2
        wide[2:] &= (raw[:-2] < 0xE1) | (raw[:-2] > 0xE3)
    solid &= (raw < 0x80) | wide
    solid[:1] = False
    mark = np.zeros(n + 1, bool)
    mark[1:n] = (raw[1:] == 0x20) & solid[:-1] if n else False
    mark[off] = True
    starts = np.flatnonzero(mark[:n])
    return starts, np.searchsorted(starts, off), solid


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


# -- minimal perfect hash ----------------------------------------------------

_LEVEL = textkit.mix64(np.arange(1, 65, dtype=U64) * U64(0x9E3779B97F4A7C15))


def _bit(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (textkit.mix64(keys ^ _LEVEL[level]) % U64(size)).astype(np.int64)


def prints(keys: np.ndarray) -> np.ndarray:
    return (textkit.mix64(keys * U64(0xD6E8FEB86659FD93) + U64(1)) >> U64(32)).astype(np.uint32)


def build_index(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bits per level, packed bits, slot of each key) of distinct uint64 keys."""
    sizes, arrays, place, rest, at = [], [], np.zeros(len(keys), np.int64), np.arange(len(keys)), 0
    while len(rest):
        if len(sizes) == len(_LEVEL):
            raise ValueError("keys of an index must be distinct")
        size = max(2 * len(rest), 64)
        bit = _bit(keys[rest], len(sizes), size)
        alone = np.bincount(bit, minlength=size)[bit] == 1
        taken = np.zeros(size, bool)
        taken[bit[alone]] = True
        place[rest[alone]] = at + bit[alone]
        sizes.append(size)
        arrays.append(taken)
        at += size
        rest = rest[~alone]
    bits = np.concatenate(arrays) if arrays else np.zeros(0, bool)
    rank = np.concatenate([[0], np.cumsum(bits)])
    return np.array(sizes, "<u8"), np.packbits(bits), rank[place]


def find_slots(keys: np.ndarray, sizes: np.ndarray, bits: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Slot of each key, -1 where no level holds it."""
    slot, rest, at = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    for level, size in enumerate(sizes.tolist()):
        where = at + _bit(keys[rest], level, size)
        hit = bits[where]
        slot[rest[hit]] = rank[where[hit]]
        rest = rest[~hit]
        at += size
    return slot


# -- shards ------------------------------------------------------------------

class Shard:
    """Documents in order, gathered until the shard is written."""

    def __init__(self, dtype: np.dtype):
        self.dtype, self.keys, self.nulls, self.sizes, self.ids, self.count = dtype, array("q"), bytearray(), array("q"), bytearray(), 0

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.keys.append(key or 0)
        self.nulls.append(key is None)
        self.sizes.append(len(ids))
        self.ids += ids.tobytes()
        self.count += len(ids)

    def write(self, path: str) -> None:
        keys, nulls = np.array(self.keys, "<i8"), np.frombuffer(bytes(self.nulls), np.uint8)
        named = np.flatnonzero(nulls == 0)
        distinct, first = np.unique(keys[named].view(U64), return_index=True)
        sizes, bits, slot = build_index(distinct)
        mark, docs = np.zeros(len(distinct), "<u4"), np.zeros(len(distinct), "<u4")
        mark[slot], docs[slot] = prints(distinct), named[first]
        starts = np.zeros(len(keys) + 1, "<u8")
        starts[1:] = np.cumsum(self.sizes)
        with fsio.Writer(path) as f:
            f.write(MAGIC + struct.pack("<6Q", self.dtype.itemsize, len(keys), self.count, len(distinct), len(sizes), len(bits)))
            f.write(self.ids)
            for section in (starts, keys, nulls, sizes, bits, mark, docs):
                f.write(section.tobytes())


class ShardFile:
    """A written shard: its tables in memory, payload read on demand."""

    def __init__(self, path: str):
        self.file = fsio.open_file(path)
        head = self.file.read_at(56, 0)
        if head[:8] != MAGIC:
            raise ValueError(f"no id shard: {path}")
        self.width, self.docs, self.count, keys, levels, nbits = struct.unpack("<6Q", head[8:])
        self.payload = 56
        at = self.payload + self.count * self.width
        rest = self.file.read_at(self.file.size() - at, at)
        self.starts, rest = np.frombuffer(rest[:8 * (self.docs + 1)], "<u8").astype(np.int64), rest[8 * (self.docs + 1):]
        self.keys, rest = np.frombuffer(rest[:8 * self.docs], "<i8"), rest[8 * self.docs:]
        self.nulls, rest = np.frombuffer(rest[:self.docs], np.uint8), rest[self.docs:]
        self.sizes, rest = np.frombuffer(rest[:8 * levels], "<u8"), rest[8 * levels:]
        self.bits = np.unpackbits(np.frombuffer(rest[:nbits], np.uint8)).astype(bool)
        self.prints = np.frombuffer(rest[nbits:nbits + 4 * keys], "<u4")
        self.firsts = np.frombuffer(rest[nbits + 4 * keys:], "<u4")
        self.rank = np.concatenate([[0], np.cumsum(self.bits)])

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids first:last of the payload as little-endian uint32."""
        data = self.file.read_at((last - first) * self.width, self.payload + first * self.width)
        return np.frombuffer(data, "<u2" if self.width == 2 else "<u4").astype("<u4")

    def find(self, keys: np.ndarray) -> np.ndarray:
        """First document with each int64 key, -1 if there is none."""
        k = keys.astype(np.int64).view(U64)
        slot = find_slots(k, self.sizes, self.bits, self.rank)
        ok = slot >= 0
        ok[ok] = self.prints[slot[ok]] == prints(k[ok])
        out = np.full(len(keys), -1, np.int64)
        out[ok] = self.firsts[slot[ok]]
        ok[ok] = self.keys[out[ok]] == keys[ok]         # the stored key settles a false print
        return np.where(ok, out, -1)

    def places(self) -> np.ndarray:
        """Place of every document, by the index; a repeated key's documents
        lie behind its first, those without key are in stored order."""
        out, named = np.arange(self.docs), np.flatnonzero(self.nulls == 0)
        if len(named):
            keys, at = self.keys[named], np.arange(len(named))
            first = np.maximum.accumulate(np.where(np.concatenate([[True], keys[1:] != keys[:-1]]), at, 0))
            found = self.find(keys)
            if (found < 0).any():
                raise ValueError("a stored key is not in the index of its shard")
            out[named] = found + at - first
        return out


# -- the operator --------------------------------------------------------------

def write_store(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID,
                shard_ids: int = SHARD_IDS, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Encodes and writes every text; returns the written manifest, one row
    per shard.  ``tokenizer`` is the path of its file on every worker.

    Defined cases: a null text counts as empty (only the end id); rows without
    doc_id come first in order and are not in the index; repeated doc_ids lie
    side by side, the index names the first; an empty table writes no shard.
    """
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranged = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
              .repartitionByRange(*order).sortWithinPartitions("doc_id", F.xxhash64("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, number, rows = encoder(tokenizer), TaskContext.get().partitionId(), 0, []
        end, shard = np.array([end_id], enc.dtype), Shard(enc.dtype)

        def close() -> None:
            nonlocal number, shard
            path = f"{folder}/shard-{part:06d}-{number:04d}.ids"
            shard.write(path)
            named = np.array(shard.keys)[np.frombuffer(bytes(shard.nulls), np.uint8) == 0]
            rows.append({"part": part, "number": number, "path": path, "first_key": int(named.min()) if len(named) else None,
                         "last_key": int(named.max()) if len(named) else None, "docs": len(shard.keys), "ids": shard.count})
            number, shard = number + 1, Shard(enc.dtype)

        for batch in batches:
            for piece in textkit.slices(batch, "text", SLICE_BYTES):
                ids, ptr = enc.encode(piece.column("text"))
                for r, key in enumerate(piece.column("doc_id").to_pylist()):
                    shard.add(key, np.concatenate([ids[ptr[r]:ptr[r + 1]], end]))
                    if shard.count >= shard_ids or len(shard.keys) >= shard_docs:
                        close()
        if shard.keys:
            close()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(
                [("part", pa.int32()), ("number", pa.int32()), ("path", pa.string()), ("first_key", pa.int64()),
                 ("last_key", pa.int64()), ("docs", pa.int64()), ("ids", pa.int64())]))

    return written(ranged.mapInArrow(run, _MANIFEST), "token-manifest")


def _each(schema: str, make):
    """mapInArrow function that gives ``make(row)``, lists by column, per row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield make(row)
    return run, schema


def read_store(manifest: DataFrame) -> DataFrame:
    """Every document of the shards: doc_id, start (ids of all documents
    before it), n_tokens and the CRC-32 of its ids, read from the files at the
    place that the shard's index gives for its key."""
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)   # one row per shard
    based = manifest.select("path", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))

    def make(row: dict) -> pa.RecordBatch:
        shard = ShardFile(row["path"])
        place, crc, step = shard.places(), np.zeros(shard.docs, np.int64), 1024
        for at in range(0, shard.docs, step):
            own = place[at:at + step]
            first = int(shard.starts[own.min()])
            data = shard.ids(first, int(shard.starts[own.max() + 1]))
            for r, d in enumerate(own, at):
                crc[r] = zlib.crc32(data[shard.starts[d] - first:shard.starts[d + 1] - first])
        return pa.RecordBatch.from_arrays(
            [pa.array(shard.keys.astype(np.int64), mask=shard.nulls.astype(bool)), pa.array(shard.starts[place] + row["base"]),
             pa.array(shard.starts[place + 1] - shard.starts[place]), pa.array(crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return (based.repartition(F.col("path"))
            .mapInArrow(*_each("doc_id long, start long, n_tokens long, ids_crc32 long", make)))


def lookup(manifest: DataFrame, keys: DataFrame, key_col: str = "doc_id", buckets: int = 4096) -> DataFrame:
    """(doc_id, ids) of the keys that are stored, by the index of their shard.
    Keys find their shard by an equi-join on a slice of the key range (shards
    cover the range one after the other), then each shard is opened once per
    group of keys."""
    ends = manifest.agg(F.min("first_key").alias("lo"), F.max("last_key").alias("hi")).first()
    if ends["lo"] is None:
        return keys.select(F.col(key_col).cast("long").alias("doc_id")).limit(0).withColumn("ids", F.array().cast("array<int>"))
    width = max(1, -(-(ends["hi"] - ends["lo"] + 1) // buckets))
    piece = lambda c: F.floor((c - F.lit(ends["lo"])) / width)
    spread = (manifest.filter(F.col("first_key").isNotNull())
              .withColumn("piece", F.explode(F.sequence(piece(F.col("first_key")), piece(F.col("last_key"))))))
    ask = keys.select(F.col(key_col).cast("long").alias("key")).filter(F.col("key").isNotNull()).distinct()
    pairs = (ask.withColumn("piece", piece(F.col("key"))).join(spread, "piece")
             .filter(F.col("key").between(F.col("first_key"), F.col("last_key"))).select("path", "key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = np.array(batch.column("path").to_pylist(), dtype=object)
            asked = np.asarray(batch.column("key")).astype(np.int64)
            for path in dict.fromkeys(paths.tolist()):
                own = asked[paths == path]
                shard = ShardFile(path)
                docs = shard.find(own)
                hit = np.flatnonzero(docs >= 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[hit]), pa.array([shard.ids(int(shard.starts[d]), int(shard.starts[d + 1])).astype(np.int32)
                                                   for d in docs[hit]], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return pairs.repartition("path").sortWithinPartitions("path", "key").mapInArrow(run, "doc_id long, ids array<int>")


def token_store(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Writes the store to a new shared folder; returns its manifest."""
    return write_store(docs, new_folder(spark, "token-store"), tokenizer, end_id)

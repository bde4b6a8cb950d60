"""Token-ID output: a wavelet matrix per shard of documents, read back by rank and select.

A shard holds the ids of whole documents in order as bit-planes, highest bit first; in each plane, the ids stand as
the planes above have dealt them (zeros before ones, stably). With a count of ones before every block of 512 bits, an
id's place in the next plane is a rank, so access, counting and the search for occurrences each walk `width` planes.
A file holds these counts, and the planes in chunks that are compressed one by one with an index, so a lookup unpacks a
chunk of each plane or two and not the file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platehouse.llm.shared import number_below, partitions, quantiles, staged
from platehouse.llm.tokens import encoder

_MAGIC, _BLOCK, _CHUNK = b"WVM2", 512, 8192
_BLOCK_BYTES = _BLOCK // 8
_HEAD = "<4sQB"
#: Up to so many shards, their offsets (24 bytes each) are broadcast; beyond that, shards are shuffled to them.
BROADCAST_SHARDS = 1_000_000


def _wide(n: int) -> str:
    """Counts and offsets take four bytes unless a file is very large."""
    return "<u4" if n < 1 << 28 else "<u8"


class WaveletMatrix:
    """A succinct sequence of unsigned integers, as its file's bytes: only what a call needs is unpacked."""

    def __init__(self, data: bytes):
        magic, self.n, self.width = struct.unpack_from(_HEAD, data)
        if magic != _MAGIC:
            raise ValueError("not a wavelet matrix")
        kind, at = np.dtype(_wide(self.n)), struct.calcsize(_HEAD)
        blocks = -(-self.n // _BLOCK)
        self.row = blocks * _BLOCK_BYTES
        self.chunks = -(-self.row // _CHUNK)

        def column(shape: tuple[int, ...]) -> np.ndarray:
            nonlocal at
            size = int(np.prod(shape))
            found = np.frombuffer(data, kind, size, at).reshape(shape)
            at += size * kind.itemsize
            return found

        #: Ones before each block of each plane, and in all of it.
        self.before = column((self.width, blocks + 1))
        self.index = column((self.width * self.chunks + 1,)).astype(np.int64)
        self.index += at
        self.zeros = self.n - self.before[:, -1].astype(np.int64)
        self.data = data
        self._unpack = zstandard.ZstdDecompressor()
        self._held: dict[int, np.ndarray] = {}

    @classmethod
    def build(cls, ids: np.ndarray, width: int) -> WaveletMatrix:
        return cls(_packed(len(ids), width, _planes(ids, width)))

    def to_bytes(self) -> bytes:
        """One file: head, counts of ones, index of chunks, chunks."""
        return self.data

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        return cls(data)

    def _chunk(self, level: int, chunk: int) -> np.ndarray:
        k = level * self.chunks + chunk
        if k not in self._held:
            self._held[k] = np.frombuffer(self._unpack.decompress(self.data[self.index[k] : self.index[k + 1]]), np.uint8)
        return self._held[k]

    def _block(self, level: int, block: int) -> np.ndarray:
        chunk, at = divmod(block * _BLOCK_BYTES, _CHUNK)
        return self._chunk(level, chunk)[at : at + _BLOCK_BYTES]

    def planes(self) -> np.ndarray:
        """All planes: rows of packed bits, little-endian within a byte."""
        frames = (self._unpack.decompress(self.data[i:j]) for i, j in zip(self.index[:-1], self.index[1:], strict=True))
        return np.frombuffer(b"".join(frames), np.uint8).reshape(self.width, self.row)

    def _bit(self, level: int, at: int) -> int:
        return int(self._block(level, at // _BLOCK)[at % _BLOCK >> 3]) >> (at & 7) & 1

    def _ones(self, level: int, at: int) -> int:
        """Ones in a plane before a place."""
        block, rest = divmod(at, _BLOCK)
        ones = int(self.before[level, block])
        return ones + int(np.unpackbits(self._block(level, block)[: (rest + 7) // 8], count=rest, bitorder="little").sum()) if rest else ones

    def access(self, at: int) -> int:
        """The id at a place."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        value = 0
        for level in range(self.width):
            bit, ones = self._bit(level, at), self._ones(level, at)
            at = int(self.zeros[level]) + ones if bit else at - ones
            value = value << 1 | bit
        return value

    def _range(self, value: int, at: int) -> tuple[int, int]:
        """Where the value's own stretch begins below the last plane, and where it ends for the first `at` ids."""
        low, high = 0, at
        for level in range(self.width):
            a, b = self._ones(level, low), self._ones(level, high)
            low, high = (int(self.zeros[level]) + a, int(self.zeros[level]) + b) if value >> (self.width - 1 - level) & 1 else (low - a, high - b)
        return low, high

    def rank(self, value: int, at: int) -> int:
        """How often a value occurs among the first `at` ids."""
        if not 0 <= value < 1 << self.width:
            return 0
        low, high = self._range(value, min(max(at, 0), self.n))
        return high - low

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def select(self, value: int, k: int) -> int:
        """The place of a value's k-th occurrence, from 0."""
        if not 0 <= k < self.count(value):
            raise IndexError(k)
        at = self._range(value, self.n)[0] + k
        for level in reversed(range(self.width)):
            bit = value >> (self.width - 1 - level) & 1
            at = self._place(level, bit, at - int(self.zeros[level]) if bit else at)
        return at

    def _place(self, level: int, bit: int, k: int) -> int:
        """The place of a plane's k-th bit of a kind: binary search over blocks, then within one."""
        before = self.before[level].astype(np.int64)
        before = before if bit else np.arange(len(before)) * _BLOCK - before
        block = int(np.searchsorted(before, k, side="right")) - 1
        bits = np.unpackbits(self._block(level, block), bitorder="little")
        return block * _BLOCK + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def occurrences(self, value: int) -> list[int]:
        return [self.select(value, k) for k in range(self.count(value))]

    def to_array(self) -> np.ndarray:
        return _sequence(self.n, self.width, self.planes())


def _planes(ids: np.ndarray, width: int) -> np.ndarray:
    if len(ids) and int(ids.max()) >> width:
        raise ValueError(f"an id needs more than {width} bits")
    rest = ids.astype(np.uint16 if width <= 16 else np.uint32)
    planes = np.zeros((width, -(-len(rest) // _BLOCK) * _BLOCK // 8), np.uint8)
    for level in range(width):
        ones = (rest & rest.dtype.type(1 << (width - 1 - level))) != 0
        packed = np.packbits(ones, bitorder="little")
        planes[level, : len(packed)] = packed
        rest = np.concatenate((rest.take(np.flatnonzero(~ones)), rest.take(np.flatnonzero(ones))))
    return planes


def _sequence(n: int, width: int, planes: np.ndarray) -> np.ndarray:
    """All ids at once: from the last plane up, each plane takes its zeros and ones back to their places."""
    kind = np.uint16 if width <= 16 else np.uint32
    out = np.zeros(n, kind)
    for level in reversed(range(width)):
        ones = np.unpackbits(planes[level], count=n, bitorder="little").astype(bool)
        low, high = np.flatnonzero(~ones), np.flatnonzero(ones)
        above = np.empty(n, kind)
        above[low] = out[: len(low)]
        above[high] = out[len(low) :] | kind(1 << (width - 1 - level))
        out = above
    return out


def _packed(n: int, width: int, planes: np.ndarray) -> bytes:
    """A file of planes."""
    kind = _wide(n)
    ones = np.bitwise_count(planes.view("<u8")).reshape(width, -1, _BLOCK // 64).sum(axis=2, dtype=np.int64) if n else np.zeros((width, 0), np.int64)
    before = np.concatenate((np.zeros((width, 1), np.int64), np.cumsum(ones, axis=1)), axis=1)
    pack = zstandard.ZstdCompressor(level=-3)
    chunks = [pack.compress(row[i : i + _CHUNK].tobytes()) for row in planes for i in range(0, planes.shape[1], _CHUNK)]
    ends = np.concatenate(([0], np.cumsum([len(c) for c in chunks], dtype=np.int64)))
    return b"".join((struct.pack(_HEAD, _MAGIC, n, width), before.astype(kind).tobytes(), ends.astype(kind).tobytes(), *chunks))


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, width: int = 16, shard_tokens: int = 1 << 18) -> DataFrame:
    """Encode every whole text, append end_id, and stage wavelet matrices of whole documents in ascending doc_id order.

    Returns the staged shards (part, shard, doc_ids, sizes, n_tokens, payload): part is the range of doc_id that a task
    had, shard counts its files, payload is one file's bytes. Spark's writer commits them, so a lost task leaves no half
    file, on any file system. A shard closes after shard_tokens ids at a document's end.
    Null text is the empty text; a null doc_id comes first; equal doc_ids follow each other in the order of a hash of
    their text; other columns are not read.
    """
    spark = docs.sparkSession

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, shard, held_tokens, encode_all = TaskContext.get().partitionId(), 0, 0, encoder(tokenizer)
        ids, sizes, held = [], [], []

        def closed() -> pd.DataFrame:
            nonlocal shard, held_tokens
            flat = np.concatenate(ids)
            row = pd.DataFrame({"part": [part], "shard": [shard], "doc_ids": [list(held)], "sizes": [list(sizes)], "n_tokens": [len(flat)], "payload": [_packed(len(flat), width, _planes(flat, width))]})
            shard, held_tokens = shard + 1, 0
            for x in (ids, sizes, held):
                x.clear()
            return row

        for batch in batches:
            for i in range(0, len(batch), 1000):
                some = batch.iloc[i : i + 1000]
                for doc, found in zip(some["doc_id"], encode_all(["" if t is None else t for t in some["text"]], end_id), strict=True):
                    ids.append(found)
                    sizes.append(len(found))
                    held.append(None if pd.isna(doc) else int(doc))
                    held_tokens += len(found)
                    if held_tokens >= shard_tokens:
                        yield closed()
        if ids:
            yield closed()

    # Ranges come from a scan of doc_id alone; a doc_id that fills several ranges is dealt over them by its text's hash,
    # and so are rows without one, over ranges of their own before all others.
    n = partitions(spark)
    (starts, none), tie = quantiles(docs, "doc_id", n), F.xxhash64("text")
    below, upto = (number_below(F.col("doc_id"), starts, or_equal) for or_equal in (False, True))
    own = F.when(upto - below > 1, below + F.pmod(tie, F.greatest(upto - below, F.lit(1)))).otherwise(F.greatest(upto - 1, F.lit(0)))
    place = F.when(F.col("doc_id").isNull(), F.pmod(tie, F.lit(max(none, 1)))).otherwise(own + none)
    ordered = docs.select("doc_id", "text").repartitionById(n + none, place.cast("int")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return staged(ordered.mapInPandas(encode, "part int, shard int, doc_ids array<long>, sizes array<long>, n_tokens long, payload binary"), "wavelet")


def read_shards(shards: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, shard columns.

    Offsets come from the small columns only: sums per part, then per shard within its part.
    """
    sizes = shards.select("part", "shard", "n_tokens")
    ahead = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each partition
    parts = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    at = sizes.select("part", "shard", F.coalesce(F.sum("n_tokens").over(ahead), F.lit(0)).alias("_in")).join(parts, "part").select("part", "shard", (F.col("_base") + F.col("_in")).alias("start"))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                data = WaveletMatrix(row.payload).to_array().astype("<u4").tobytes()
                n = np.array(row.sizes, np.int64)
                ends = np.cumsum(n)
                yield pd.DataFrame({"doc_id": pd.array(list(row.doc_ids), "Int64"), "start": row.start + ends - n, "n_tokens": n, "ids_crc32": [zlib.crc32(data[4 * (e - k) : 4 * e]) for e, k in zip(ends, n, strict=True)], "part": row.part, "shard": row.shard})

    at = F.broadcast(at) if sizes.count() <= BROADCAST_SHARDS else at
    return shards.join(at, ["part", "shard"]).mapInPandas(decode, "doc_id long, start long, n_tokens long, ids_crc32 long, part int, shard int")


def occurrences(shards: DataFrame, token_ids: list[int]) -> DataFrame:
    """(token_id, part, shard, n, first_at, last_at) of each shard that has one of the ids: its count and ends, by rank and select.

    Places count from the shard's first id. A lookup unpacks a few chunks of the file.
    """

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                m = WaveletMatrix(row.payload)
                found = [(t, row.part, row.shard, n, m.select(t, 0), m.select(t, n - 1)) for t in token_ids if (n := m.count(t))]
                yield pd.DataFrame(found, columns=["token_id", "part", "shard", "n", "first_at", "last_at"]).astype("int64")

    return shards.select("part", "shard", "payload").mapInPandas(look, "token_id long, part int, shard int, n long, first_at long, last_at long")

"""Token ids as wavelet matrices: one compressed file per shard, with rank and select.

Documents are dealt by doc_id range and sorted, so that shards, numbered by
(task, number in the task), hold consecutive documents in ascending doc_id
order. A shard's distinct tokens are numbered by falling frequency; the numbers'
bits form the planes of the matrix, from the highest, each plane ordered by a
stable partition on the plane above. High planes are then mostly zeros, which
the file's compression uses. Each shard is written as one row of one Parquet file
(zstd) in the shared folder, through Spark's writer, so a lost executor's shards
are simply written again.

A shard closes when it holds ``shard_tokens`` ids; a document is never cut, so a
shard is bounded by that number plus the last run of rows (1 MB of text, or one longer document). Null or empty texts
still have their end id. Rows with a null doc_id come first; rows with the same
doc_id are ordered by a hash of their text, repeated rows stay repeated. An empty
table gives no shards.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, texts_of
from .tokens import starts, task_id, token_runs

MAGIC = b"WMX1"
SUPER = 1024                       # bits that one rank count covers


class WaveletMatrix:
    """Succinct sequence of token ids: access, rank, select, count and occurrences work on the packed planes."""

    def __init__(self, n: int, alphabet: np.ndarray, zeros: list[int], planes: list[np.ndarray]):
        self.n, self.alphabet, self.zeros, self.planes = n, alphabet, zeros, planes
        self.levels = len(planes)
        self.code = {int(t): i for i, t in enumerate(alphabet)}
        self.ranks = []
        for p in planes:
            full = np.zeros(-(-len(p) * 8 // SUPER) * SUPER // 8, np.uint8)
            full[:len(p)] = p
            self.ranks.append(np.concatenate([[0], np.cumsum(np.bitwise_count(full).reshape(-1, SUPER // 8).sum(axis=1, dtype=np.int64))]))

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        every = np.bincount(ids)                                   # as long as the vocabulary, at most
        alphabet = np.flatnonzero(every)
        order = np.argsort(-every[alphabet], kind="stable")
        rank = np.empty(len(every), np.uint16 if len(order) <= 1 << 16 else np.uint32)
        rank[alphabet[order]] = np.arange(len(order))
        cur = rank[ids]
        planes, zeros = [], []
        for level in range(max(1, int(max(len(order), 1) - 1).bit_length()) - 1, -1, -1):
            bit = (cur >> level) & 1 > 0
            low, high = np.flatnonzero(~bit), np.flatnonzero(bit)         # places are taken faster than by a mask of mixed bits
            planes.append(np.packbits(bit, bitorder="little"))
            zeros.append(len(low))
            cur = np.concatenate([cur.take(low), cur.take(high)])
        return cls(len(ids), alphabet[order].astype(np.uint32), zeros, planes)

    def to_bytes(self) -> bytes:
        head = MAGIC + struct.pack("<QII", self.n, len(self.alphabet), self.levels)
        return b"".join([head, self.alphabet.astype("<u4").tobytes(), np.array(self.zeros, "<u8").tobytes(), *[p.tobytes() for p in self.planes]])

    @classmethod
    def from_bytes(cls, b: bytes) -> WaveletMatrix:
        if b[:4] != MAGIC:
            raise ValueError("not a wavelet matrix")
        n, sigma, levels = struct.unpack_from("<QII", b, 4)
        at = 20
        alphabet = np.frombuffer(b, "<u4", sigma, at)
        zeros = np.frombuffer(b, "<u8", levels, at + 4 * sigma).astype(int).tolist()
        at += 4 * sigma + 8 * levels
        size = -(-n // 8)
        return cls(n, alphabet, zeros, [np.frombuffer(b, np.uint8, size, at + i * size) for i in range(levels)])

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        s = i // SUPER
        lo, p = s * SUPER // 8, self.planes[level]
        n = int(self.ranks[level][s]) + int(np.bitwise_count(p[lo:i // 8]).sum())
        return n + (int(p[i // 8]) & (1 << i % 8) - 1).bit_count() if i % 8 else n

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i // 8]) >> i % 8 & 1

    def access(self, i: int) -> int:
        """The token at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        code = 0
        for level in range(self.levels):
            bit = self._bit(level, i)
            ones = self._ones(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            code = code << 1 | bit
        return int(self.alphabet[code])

    def rank(self, token: int, i: int) -> int:
        """Occurrences of a token among the first i places."""
        if token not in self.code:
            return 0
        code, lo, hi = self.code[token], 0, min(max(i, 0), self.n)
        for level in range(self.levels):
            a, b = self._ones(level, lo), self._ones(level, hi)
            if code >> (self.levels - 1 - level) & 1:
                lo, hi = self.zeros[level] + a, self.zeros[level] + b
            else:
                lo, hi = lo - a, hi - b
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _find(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) bit of that value in a plane."""
        r = self.ranks[level]
        before = r if bit else np.minimum(np.arange(len(r)) * SUPER, self.n) - r
        s = int(np.searchsorted(before, k, "right")) - 1
        part = np.unpackbits(self.planes[level][s * SUPER // 8:(s + 1) * SUPER // 8], bitorder="little")
        return s * SUPER + int(np.flatnonzero(part == bit)[k - int(before[s])])

    def select(self, token: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of a token."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        code, lo = self.code[token], 0
        for level in range(self.levels):
            a = self._ones(level, lo)
            lo = self.zeros[level] + a if code >> (self.levels - 1 - level) & 1 else lo - a
        i = lo + k
        for level in range(self.levels - 1, -1, -1):
            bit = code >> (self.levels - 1 - level) & 1
            i = self._find(level, bit, i - self.zeros[level] if bit else i)
        return i

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def tokens(self) -> np.ndarray:
        """All tokens in order: the partitions undone plane by plane, from the last."""
        kind = np.uint16 if self.levels <= 16 else np.uint32
        code = np.zeros(self.n, kind)
        for level in range(self.levels - 1, -1, -1):
            bit = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            above = np.empty(self.n, kind)
            above[np.flatnonzero(~bit)] = code[:self.zeros[level]]
            above[np.flatnonzero(bit)] = code[self.zeros[level]:]
            above |= bit.astype(kind) << kind(self.levels - 1 - level)
            code = above
        return self.alphabet.take(code) if self.n else np.empty(0, np.uint32)


SHARDS = "task long, shard long, n_tokens long, doc_ids array<long>, lengths array<long>, payload binary"


def write_shards(docs: DataFrame, tokenizer: str, end_id: int = 2, shard_tokens: int = 1 << 21) -> DataFrame:
    """Write the shard files and return them as read from storage (columns as in ``SHARDS``)."""

    def shards(batches):
        docs_in, sizes, ids_in, held, number = [], [], [], 0, 0

        def close():
            ids, doc, size = np.concatenate(ids_in), pa.concat_arrays(docs_in), np.concatenate(sizes)
            whole = pa.array([0, len(doc)], pa.int32())
            return pa.RecordBatch.from_arrays([
                pa.array([task_id()], pa.int64()), pa.array([number], pa.int64()), pa.array([len(ids)], pa.int64()), pa.ListArray.from_arrays(whole, doc.cast(pa.int64())),
                pa.ListArray.from_arrays(whole, pa.array(size, pa.int64())), pa.array([WaveletMatrix.build(ids).to_bytes()], pa.binary())],
                names=["task", "shard", "n_tokens", "doc_ids", "lengths", "payload"])

        for doc, ids, at in token_runs(batches, tokenizer, end_id, min(1 << 20, 2 * shard_tokens)):
            docs_in.append(doc)
            sizes.append(np.diff(at))
            ids_in.append(ids)
            held += len(ids)
            if held >= shard_tokens:
                yield close()
                docs_in, sizes, ids_in, held, number = [], [], [], 0, number + 1
        if ids_in:
            yield close()

    rows = texts_of(docs)
    text_hash = F.xxhash64("text")
    dealt = rows.withColumn("__h", text_hash).repartitionByRange("doc_id", "__h").sortWithinPartitions("doc_id", "__h").select("doc_id", "text")
    return staged(dealt.mapInArrow(shards, SHARDS), "wavelet", per_file=1)


def read_documents(shards: DataFrame) -> DataFrame:
    """Documents decoded from the shard files: task, shard, place in the shard, doc_id, n_tokens, start, ids (int32 little-endian)."""

    def decode(batches):
        for b in batches:
            for r in b.to_pylist():
                ids = WaveletMatrix.from_bytes(r["payload"]).tokens().astype("<u4")
                at = np.concatenate([[0], np.cumsum(r["lengths"], dtype=np.int64)]).tolist()
                crc = [zlib.crc32(ids[a:z].data) for a, z in zip(at, at[1:])]
                n = len(crc)
                yield pa.RecordBatch.from_pydict({
                    "task": [r["task"]] * n, "shard": [r["shard"]] * n, "before": at[:-1], "doc_id": pa.array(r["doc_ids"], pa.int64()),
                    "n_tokens": pa.array(r["lengths"], pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    got = shards.select("task", "shard", "doc_ids", "lengths", "payload").mapInArrow(decode, "task long, shard long, before long, doc_id long, n_tokens long, ids_crc32 long")
    first = starts(shards.select("task", "shard", "n_tokens"), ["task", "shard"], "n_tokens", "shard_start").select("task", "shard", "shard_start")
    return got.join(first, ["task", "shard"]).select("doc_id", (F.col("shard_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def lookup(shards: DataFrame, token: int) -> DataFrame:
    """Occurrences of a token in each shard, counted and located on the packed planes: task, shard, n, places."""

    def find(batches):
        for b in batches:
            for r in b.to_pylist():
                places = WaveletMatrix.from_bytes(r["payload"]).occurrences(token)
                yield pa.RecordBatch.from_pydict({"task": [r["task"]], "shard": [r["shard"]], "n": [len(places)], "places": pa.array([places], pa.list_(pa.int64()))})

    return shards.select("task", "shard", "payload").mapInArrow(find, "task long, shard long, n long, places array<long>")

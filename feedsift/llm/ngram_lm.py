"""Bigram language model in sharded Elias-Fano tries.

``log10 p(w | u)`` with ``p(w | u) = c(u, w) / (c(u) + mu) + mu / (c(u) + mu) * p0(w)``
(Dirichlet smoothing; p0 is the base distribution, additive smoothing of the
training tokens' counts, one unknown word included), so the probabilities of all
words after any context add up to one. A text starts after a start mark, and its
end is a token. Contexts seen in training less than ``least_context`` times carry
no entries (p = p0); with 1, every context that was seen does.

A shard's trie has two memory-mapped levels, both Elias-Fano coded: the contexts'
word numbers, with monotone pointers to their successors; and the successors'
word numbers, each context's raised above the last of the context before, so that
the whole level ascends and a successor search for ``word + rise of the context``
within the context's range finds an entry. Beside it stands the quantised log10
of the smoothed count term. A quantum is 1/4096, so an entry is off by a factor of
at most 1.00029.

Everything moves between blocks of documents and segments or shards of words as
compressed messages of distinct entries with counts: word hashes (64 bits) are
numbered and counted by segments, pairs are counted and looked up by shards of
their context, and a context with more than ``context_tokens`` tokens is split
over several shards by its successors. No model part is broadcast or collected;
a group holds about ``segment_words`` words or ``shard_pairs`` pairs.

Null and empty texts are an end alone. Repeated rows are counted and scored as
often as they occur; a null doc_id has the remainder of the empty text. Without
training rows the base distribution is uniform over the one unknown word. An
empty table gives no rows.
"""

from __future__ import annotations

import struct
import tempfile
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, MESSAGE, SPACE_WORDS, Blob, by_segment, crc_fold, group_rows, messages, mix64, pack_u, span_hash, staged, text_bytes, unpack_u, word_spans
from .tokens import task_id

STEP = 4096.0
ADD = 0.1
#: Sources from here on are shards' answers about pairs.
PAIRS = 1 << 62


class EliasFano:
    """A non-decreasing sequence: upper bits in unary, ``low`` lower bits each packed; over a buffer that may be mapped."""

    def __init__(self, n: int, low: int, high: np.ndarray, lows: np.ndarray):
        self.n, self.low, self.high, self.lows = n, low, high, lows
        bits = np.unpackbits(high, bitorder="little")
        self.ones = np.flatnonzero(bits)[:n]                         # select of ones
        zeros = np.flatnonzero(bits == 0)
        self.before = zeros - np.arange(len(zeros))                  # entries before each zero

    @staticmethod
    def dump(a: np.ndarray) -> bytes:
        a = np.asarray(a, np.uint64)
        n = len(a)
        top = int(a[-1]) + 1 if n else 1
        low = max(0, (top // max(n, 1)).bit_length() - 1)
        up = (a >> np.uint64(low)).astype(np.int64)
        high = np.zeros((int(up[-1]) if n else 0) + n + 1, np.uint8)
        high[up + np.arange(n)] = 1
        lows = np.packbits((a[:, None] >> np.arange(low, dtype=np.uint64)).astype(np.uint8) & 1, bitorder="little") if low else np.empty(0, np.uint8)
        packed = np.packbits(high, bitorder="little")
        return struct.pack("<QIQQ", n, low, len(packed), len(lows)) + packed.tobytes() + lows.tobytes()

    @classmethod
    def load(cls, b: np.ndarray, at: int) -> tuple[EliasFano, int]:
        n, low, nh, nl = struct.unpack_from("<QIQQ", b, at)
        at += 28
        return cls(n, low, b[at:at + nh], b[at + nh:at + nh + nl]), at + nh + nl

    def get(self, i: np.ndarray) -> np.ndarray:
        up = (self.ones[i] - i).astype(np.uint64) << np.uint64(self.low)
        return up | self._low(i)

    def _low(self, i: np.ndarray) -> np.ndarray:
        """The lower bits: nine bytes around each entry's first bit hold all of up to 64 bits."""
        if not self.low:
            return np.zeros(len(i), np.uint64)
        bit = i.astype(np.int64) * self.low
        byte, shift = bit >> 3, (bit & 7).astype(np.uint64)
        out = np.zeros(len(i), np.uint64)
        last = len(self.lows) - 1
        for k in range((self.low + 14) // 8):
            x = np.where(byte + k <= last, self.lows[np.minimum(byte + k, last)], 0).astype(np.uint64)
            out |= x << np.uint64(8 * k) >> shift if k < 8 else x << (np.uint64(64) - shift)
        return out & np.uint64((1 << self.low) - 1)

    def successor(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Place of the first entry >= x in each range [lo, hi), hi if there is none."""
        up = np.minimum((x >> np.uint64(self.low)).astype(np.int64), len(self.before))
        a = np.where(up > 0, self.before[np.maximum(up - 1, 0)], 0) if len(self.before) else np.zeros(len(x), np.int64)
        z = np.where(up < len(self.before), self.before[np.minimum(up, len(self.before) - 1)], self.n) if len(self.before) else np.full(len(x), self.n)
        a, z = np.clip(a, lo, hi), np.clip(z, lo, hi)
        while (open_ := a < z).any():                                # bisects the entries with the same upper bits
            i = np.flatnonzero(open_)
            mid = (a[i] + z[i]) // 2
            less = self.get(mid) < x[i]
            a[i[less]] = mid[less] + 1
            z[i[~less]] = mid[~less]
        return a


@dataclass
class Trie:
    """Two levels, contexts and successors, over one buffer."""

    contexts: EliasFano
    pointers: EliasFano
    successors: EliasFano
    codes: np.ndarray

    @staticmethod
    def dump(u: np.ndarray, w: np.ndarray, log10: np.ndarray) -> bytes:
        """From pairs ascending by (u, w) and the log10 of their smoothed terms (none above 0)."""
        ctx, first = np.unique(u, return_index=True)
        ptr = np.append(first, len(u))
        last = w[ptr[1:] - 1] + 1 if len(u) else np.empty(0, np.int64)
        rise = np.concatenate([[0], np.cumsum(last)[:-1]]) if len(u) else last
        codes = np.minimum(np.rint(-log10 * STEP), 65535).astype("<u2")
        return b"".join([EliasFano.dump(ctx), EliasFano.dump(ptr), EliasFano.dump(w + np.repeat(rise, np.diff(ptr))), codes.tobytes()])

    @classmethod
    def load(cls, b: np.ndarray) -> Trie:
        ctx, at = EliasFano.load(b, 0)
        ptr, at = EliasFano.load(b, at)
        suc, at = EliasFano.load(b, at)
        return cls(ctx, ptr, suc, b[at:at + 2 * suc.n].view("<u2"))

    def find(self, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        """1 + the code of each pair's entry, 0 if it has none."""
        out = np.zeros(len(u), np.int64)
        n = self.contexts.n
        if not n or not len(u):
            return out
        x = u.astype(np.uint64)
        j = self.contexts.successor(x, np.zeros(len(u), np.int64), np.full(len(u), n))
        known = np.flatnonzero(j < n)
        known = known[self.contexts.get(j[known]) == x[known]]
        j = j[known]
        lo, hi = self.pointers.get(j).astype(np.int64), self.pointers.get(j + 1).astype(np.int64)
        rise = np.where(lo > 0, self.successors.get(np.maximum(lo - 1, 0)) + np.uint64(1), np.uint64(0))
        want = w[known].astype(np.uint64) + rise
        at = self.successors.successor(want, lo, hi)
        hit = at < hi
        hit[hit] = self.successors.get(at[hit]) == want[hit]
        out[known[hit]] = 1 + self.codes[at[hit]].astype(np.int64)
        return out


def mapped(b: bytes) -> np.ndarray:
    """The bytes memory-mapped from a file that is already unlinked, so nothing stays behind."""
    f = tempfile.TemporaryFile()
    f.write(b)
    f.flush()
    return np.memmap(f, np.uint8, "r") if b else np.empty(0, np.uint8)


@dataclass
class Block:
    """Documents as numbers of the block's distinct words."""

    doc_ids: list
    held: np.ndarray
    at: np.ndarray               # first word of each document, and the end
    words: np.ndarray            # distinct word hashes, ascending
    stream: np.ndarray           # each word's place in ``words``

    @classmethod
    def of(cls, ids: pa.Array, held: np.ndarray, data: np.ndarray, off: np.ndarray) -> Block:
        low = LOWER[data] if len(data) else data
        starts, ends, at = word_spans(low, off, SPACE_WORDS)
        words, stream = np.unique(span_hash(low, starts, ends), return_inverse=True)
        return cls(ids.to_pylist(), held, at, words, stream)

    def dump(self) -> bytes:
        count = np.bincount(self.stream, minlength=len(self.words))
        by = np.argsort(-count, kind="stable")                       # frequent words get small numbers, which compress
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        return Blob.dump(ids=self.doc_ids, held=np.packbits(self.held), at=self.at, words=pack_u(self.words), rank=pack_u(rank, False), stream=pack_u(rank[self.stream], False))

    @classmethod
    def load(cls, b: bytes) -> Block:
        d = Blob.load(b)
        rank = unpack_u(d["rank"], False).astype(np.int64)
        by = np.empty(len(rank), np.int64)
        by[rank] = np.arange(len(rank))
        return cls(d["ids"], np.unpackbits(d["held"], count=len(d["ids"])).astype(bool), d["at"], unpack_u(d["words"]), by[unpack_u(d["stream"], False).astype(np.int64)])

    def train_counts(self) -> np.ndarray:
        learn = np.repeat(~self.held, np.diff(self.at))
        return np.bincount(self.stream[learn], minlength=len(self.words))

    def pairs(self, number: np.ndarray, count: np.ndarray, start: int, end: int, docs: int, end_count: int):
        """Context and word numbers of all predicted tokens, in order (a document's words, then its end), and their counts."""
        n = np.diff(self.at)
        tokens = np.insert(number[self.stream], self.at[1:], end)
        counts = np.insert(count[self.stream], self.at[1:], end_count)
        first = self.at[:-1] + np.arange(len(n))
        context, before = np.empty_like(tokens), np.empty_like(counts)
        context[1:], before[1:] = tokens[:-1], counts[:-1]
        context[first], before[first] = start, docs
        return context, tokens, before, counts, np.repeat(np.arange(len(n)), n + 1)


def score(docs: DataFrame, folds: int = 10, mu: float = 20.0, block_bytes: int = 8 << 20, segment_words: int = 1_000_000,
          shard_pairs: int = 1_500_000, context_tokens: int = 1_000_000, least_context: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document, learning from those whose
    crc32 fold isn't 0."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), (crc_fold(F.col("doc_id"), folds) == 0).alias("held"))

    def pack(batches):
        number = 0
        for b in batches:
            data, off = text_bytes(b.column(1))
            held = b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            i = 0
            while i < b.num_rows:
                j = max(i + 1, int(np.searchsorted(off, off[i] + block_bytes, "right")) - 1)
                block = Block.of(b.column(0).slice(i, j - i), held[i:j], data[off[i]:off[j]], off[i:j + 1] - off[i])
                yield pa.RecordBatch.from_pydict({"to": [task_id() << 32 | number], "payload": pa.array([block.dump()], pa.binary()), "tokens": [len(block.stream) + j - i], "words": [len(block.words)],
                                                  "train_docs": [int((~held[i:j]).sum())]})
                i, number = j, number + 1

    blocks = staged(rows.mapInArrow(pack, "to long, payload binary, tokens long, words long, train_docs long"), "blocks", codec="uncompressed")
    facts = blocks.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "words", "train_docs")]).first()
    seg_bits = max(1, (facts.words // segment_words).bit_length())
    end_count = facts.train_docs

    def ask(batches):
        for b in batches:
            for to, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                block = Block.load(payload)
                count = block.train_counts()
                yield messages([(seg, to, Blob.dump(words=pack_u(block.words[a:z]), count=pack_u(count[a:z], False))) for seg, a, z in by_segment(block.words, 64 - seg_bits)])

    def number_words(t: pa.Table) -> pa.Table:
        got = group_rows(t)
        parts = [Blob.load(r["payload"]) for r in got]
        words = [unpack_u(p["words"]) for p in parts]
        every, inverse = np.unique(np.concatenate(words), return_inverse=True)
        count = np.bincount(inverse, np.concatenate([unpack_u(p["count"], False).astype(np.float64) for p in parts]), len(every)).astype(np.int64)
        cut = np.concatenate([[0], np.cumsum([len(w) for w in words])])
        out = [(r["src"], r["to"], Blob.dump(number=pack_u(inverse[a:z]), count=pack_u(count[inverse[a:z]], False))) for r, a, z in zip(got, cut, cut[1:])]
        out.append((-1, got[0]["to"], struct.pack("<QQQ", len(every), int((count > 0).sum()), int(count.sum()))))
        return pa.Table.from_batches([messages(out)])

    numbered = staged(blocks.select("to", "payload").mapInArrow(ask, MESSAGE).groupBy("to").applyInArrow(number_words, MESSAGE), "words", codec="uncompressed")
    # one row a segment: its distinct words, known words and training tokens; at most words / segment_words * 2 rows
    sums = sorted((r.src, *struct.unpack("<QQQ", bytes(r.payload))) for r in numbered.where("to = -1").select("src", "payload").collect())
    base, total, known, tokens = {}, 0, 0, 0
    for seg, n, k, c in sums:
        base[seg] = total
        total, known, tokens = total + n, known + k, tokens + c
    n_train, n_types = tokens + end_count, known + (end_count > 0)
    norm = n_train + ADD * (n_types + 1)
    start, end = total + 1, total
    shards = max(1, facts.tokens // shard_pairs)
    segments = spark.sparkContext.broadcast(base)

    def opened(rows: list[dict]):
        me = next(r for r in rows if r["src"] == -1)
        block = Block.load(me["payload"])
        parts = []
        for r in (r for r in rows if 0 <= r["src"] < PAIRS):          # segment after segment, as the block's words ascend
            d = Blob.load(r["payload"])
            parts.append((unpack_u(d["number"]).astype(np.int64) + segments.value[r["src"]], unpack_u(d["count"], False).astype(np.int64)))
        number, count = (np.concatenate(c) for c in zip(*parts)) if parts else (np.empty(0, np.int64),) * 2
        ctx, tok, before, counts, doc = block.pairs(number, count, start, end, end_count, end_count)
        # pairs that can have an entry, distinct; their shard splits a large context by its successors
        may = np.flatnonzero((before >= least_context) & (counts > 0))
        split = before[may] // context_tokens + 1
        place = mix64(ctx[may].astype(np.uint64) * np.uint64(1 << 20) + mix64(tok[may].astype(np.uint64)) % split.astype(np.uint64)) % np.uint64(shards)
        order = np.lexsort((tok[may], ctx[may], place))
        p, u, w = place[order], ctx[may][order], tok[may][order]
        new = np.ones(len(p), bool)
        new[1:] = (u[1:] != u[:-1]) | (w[1:] != w[:-1])
        pair_of = np.empty(len(p), np.int64)
        pair_of[order] = np.cumsum(new) - 1
        at = np.flatnonzero(new)
        return block, ctx, tok, before, counts, doc, may, pair_of, p[at], u[at], w[at], before[may][order][at]

    def ask_pairs(t: pa.Table) -> pa.Table:
        rows = group_rows(t)
        block, _, _, _, _, doc, may, pair_of, place, u, w, c = opened(rows)
        learned = np.bincount(pair_of[~block.held[doc[may]]], minlength=len(u))
        to = next(r["to"] for r in rows)
        out = []
        for shard, a, z in by_segment(place, 0):
            ctx, first = np.unique(u[a:z], return_index=True)
            out.append((shard, to, Blob.dump(ctx=pack_u(ctx), n=pack_u(np.diff(np.append(first, z - a)), False), c=pack_u(c[a:z][first], False), w=pack_u(w[a:z], False), k=pack_u(learned[a:z], False))))
        return pa.Table.from_batches([messages(out)])

    def answer(t: pa.Table) -> pa.Table:
        got = group_rows(t)
        us, ws, ks, cs = [], [], [], []
        for r in got:
            d = Blob.load(r["payload"])
            n = unpack_u(d["n"], False).astype(np.int64)
            us.append(np.repeat(unpack_u(d["ctx"]).astype(np.int64), n))
            cs.append(np.repeat(unpack_u(d["c"], False).astype(np.int64), n))
            ws.append(unpack_u(d["w"], False).astype(np.int64))
            ks.append(unpack_u(d["k"], False).astype(np.int64))
        u, w, k, c = (np.concatenate(x) for x in (us, ws, ks, cs))
        seen = np.flatnonzero(k > 0)
        order = seen[np.lexsort((w[seen], u[seen]))]
        u, w, k, c = u[order], w[order], k[order], c[order]
        at = np.flatnonzero(np.concatenate([[True], (u[1:] != u[:-1]) | (w[1:] != w[:-1])])) if len(u) else np.empty(0, np.int64)
        k = np.add.reduceat(k, at) if len(at) else k
        trie = Trie.load(mapped(Trie.dump(u[at], w[at], np.log10(k / (c[at] + mu)))))
        return pa.Table.from_batches([messages([(r["src"], PAIRS + r["to"], pack_u(trie.find(x, y), False)) for r, x, y in zip(got, us, ws)])])

    own = blocks.select("to", F.lit(-1).cast("long").alias("src"), "payload")
    together = own.unionByName(numbered.where("to <> -1"))
    answered = staged(together.groupBy("to").applyInArrow(ask_pairs, MESSAGE).groupBy("to").applyInArrow(answer, MESSAGE), "pairs", codec="uncompressed")

    def scored(t: pa.Table) -> pa.Table:
        rows = group_rows(t)
        block, _, _, before, counts, doc, may, pair_of, *_ = opened(rows)
        got = {r["src"] - PAIRS: unpack_u(r["payload"], False) for r in rows if r["src"] >= PAIRS}
        codes = np.concatenate([got[s] for s in sorted(got)]).astype(np.int64) if got else np.empty(0, np.int64)
        p0 = (counts + ADD) / norm
        p = p0.copy()
        b = before[may]
        code = codes[pair_of]
        p[may] = np.where(code > 0, 10.0 ** (-(code - 1) / STEP), 0.0) + mu / (b + mu) * p0[may]
        plain = (before >= least_context) & (counts == 0)
        p[plain] = mu / (before[plain] + mu) * p0[plain]
        n = len(block.doc_ids)
        return pa.table({
            "doc_id": pa.array(block.doc_ids, pa.int64()), "held_out": block.held, "n_tokens": np.bincount(doc, minlength=n),
            "n_known": np.bincount(doc, counts > 0, n).astype(np.int64), "train_tokens": np.full(n, n_train),
            "base_score": np.bincount(doc, np.log10(p0), n), "score": np.bincount(doc, np.log10(p), n)})

    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return together.unionByName(answered).groupBy("to").applyInArrow(scored, out)

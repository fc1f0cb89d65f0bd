"""Substring deduplication with a count-min prefilter.

A window is ``window`` consecutive words of one document. Documents are packed
into blocks of bounded size, written once to the shared folder. First pass: each
block makes a sketch of its windows, a count-min row of ``2**extra`` cells for
each window of the corpus, kept as the sorted list of cells that it fills. The
blocks' sketches are merged by segments of cells (a segment is one group of
bounded size); a cell filled by two blocks, or twice in one, overestimates its
windows' counts as at least two, and the block learns which of its cells are.
Second pass: only windows in such cells are grouped exactly, by 96 bits of hash
beside the cell; of each block only the first occurrence of a window is sent, as
later ones of the block are known to repeat. A unique window is never removed
and no repeated one is lost; the sketch only saves sending the others.

Documents whose whole word sequence repeats an earlier document's (at least one
window long) are found first, by 128 bits of hash: all their words are covered,
and their windows aren't sent, so a large group of copies costs as one document.

Words are maximal runs of characters other than ASCII white space. "Earlier" is a
smaller doc_id (null before all others), then, for repeated doc_ids, the place
in the input, then the place in the document. Null and empty texts have no words.
Texts shorter than a window lose nothing. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MESSAGE, SPACE_WORDS, by_segment, group_rows, messages, pack_u, sequence_hash, span_hash, staged, text_chunks, texts_of, unpack_u, window_hash, word_spans
from .tokens import task_id

BLOCKS = "to long, payload binary, doc_ids array<long>, n_words array<long>, hi array<long>, lo array<long>"
LOW = np.uint64(0xFFFFFFFF)
NULL_ID = -(1 << 63)
#: Sources from here on are segments' answers of the second pass.
ANSWER = 1 << 62


def blocks_of(docs: DataFrame, block_bytes: int) -> DataFrame:
    """Documents packed into blocks: words joined by single spaces, with counts and the hash of each word sequence."""

    def pack(batches):
        import zstandard

        zip_ = zstandard.ZstdCompressor(level=3)
        number = 0
        for ids, data, off in text_chunks(batches, block_bytes):
            starts, ends, at = word_spans(data, off, SPACE_WORDS)
            raw = data.tobytes()
            body = b"\n".join(b" ".join(raw[a:z].split()) for a, z in zip(off[:-1].tolist(), off[1:].tolist()))
            n = np.diff(at)
            both = [sequence_hash(span_hash(data, starts, ends, s), at).view(np.int64) for s in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([task_id() << 32 | number]), pa.array([zip_.compress(body)], pa.binary())]
                + [pa.array([x], pa.list_(pa.int64())) for x in (ids, n, *both)], names=["to", "payload", "doc_ids", "n_words", "hi", "lo"])
            number += 1

    return staged(texts_of(docs).mapInArrow(pack, BLOCKS), "blocks", codec="uncompressed")


@dataclass
class Block:
    """A block's words and windows; everything here follows from the block alone, so each pass makes it anew."""

    payload: bytes
    window: int
    bits: int

    def __post_init__(self):
        import zstandard

        self.raw = zstandard.ZstdDecompressor().decompress(self.payload)
        self.texts = self.raw.split(b"\n")
        data = np.frombuffer(self.raw, np.uint8)
        stops = np.cumsum([len(t) + 1 for t in self.texts])
        off = np.concatenate([[0], stops])
        off[-1] -= 1
        starts, ends, self.at = word_spans(data, off, SPACE_WORDS)
        self.n = np.diff(self.at)
        per = np.maximum(self.n - self.window + 1, 0)
        self.doc = np.repeat(np.arange(len(self.n)), per)
        self.pos = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
        first = self.at[self.doc] + self.pos
        self.h, self.g = (window_hash(span_hash(data, starts, ends, s), self.window)[first] for s in (0, 1))
        self.cells, self.cell_of, self.count = np.unique(self.h >> np.uint64(64 - self.bits), return_inverse=True, return_counts=True)

    def suspects(self, repeated: np.ndarray, copies: set[int], doc_ids: np.ndarray):
        """Of the windows in repeated cells of documents that are no copies, by (hash, earlier first): their places,
        and which is the first of its hash in the block."""
        skip = np.zeros(len(self.n), bool)
        skip[list(copies)] = True
        w = np.flatnonzero((repeated | (self.count > 1))[self.cell_of] & ~skip[self.doc])
        rank = np.empty(len(doc_ids), np.int64)
        rank[np.lexsort((np.arange(len(doc_ids)), doc_ids))] = np.arange(len(doc_ids))
        w = w[np.lexsort((self.pos[w], rank[self.doc[w]], self.g[w] & LOW, self.h[w]))]
        first = np.ones(len(w), bool)
        first[1:] = (self.h[w[1:]] != self.h[w[:-1]]) | ((self.g[w[1:]] ^ self.g[w[:-1]]) & LOW != 0)
        return w, first


def _flag(bits: list[bytes], n: int) -> np.ndarray:
    """Packed flags of several messages, each led by its count, as one array."""
    parts = [np.unpackbits(np.frombuffer(b, np.uint8, offset=4), count=int.from_bytes(b[:4], "little")) for b in bits]
    out = np.concatenate(parts).astype(bool) if parts else np.empty(0, bool)
    if len(out) != n:
        raise ValueError(f"{len(out)} flags for {n} entries")
    return out


def _packed(flags: np.ndarray) -> bytes:
    return len(flags).to_bytes(4, "little") + np.packbits(flags).tobytes()


def copies_of(info: DataFrame, texts: int, hot_share: int) -> DataFrame:
    """Places (``to``, ``idx``) of all documents but the first of each group of copies.

    Groups of more than one in ``hot_share`` of all ``texts`` documents number fewer than ``hot_share``, so their first
    documents are broadcast; only documents of smaller groups (and single ones) meet their group's first one by a shuffle.
    """
    keys, me = ["hi", "lo", "n"], F.struct("doc_id", "to", "idx")
    groups = info.groupBy(*keys).agg(F.min(me).alias("first"), F.count("*").alias("many")).where("many > 1")
    groups = staged(groups, "copy-groups")
    is_hot = F.col("many") * hot_share > texts
    hot = groups.where(is_hot).select(*keys, F.col("first").alias("hot_first"))
    rest = groups.where(~is_hot).select(*keys, F.lit(0).cast("long").alias("salt"), "first")
    told = info.join(F.broadcast(hot), keys, "left")
    told = told.withColumn("salt", F.when(F.col("hot_first").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64("to", "idx").bitwiseOR(F.lit(1))))
    told = told.join(rest, [*keys, "salt"], "left").withColumn("first", F.coalesce("hot_first", "first"))
    return told.where(F.col("first").isNotNull() & (me != F.col("first"))).select("to", "idx")


def dedup(docs: DataFrame, window: int = 20, extra: int = 8, block_bytes: int = 4 << 20, segment_windows: int = 2_000_000,
          hot_share: int = 1000) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by single spaces (``kept``, as UTF-8 bytes), a row per document."""
    blocks = blocks_of(docs, block_bytes)
    n = F.col("n")
    total, texts = blocks.select(F.explode("n_words").alias("n")).agg(
        F.coalesce(F.sum(F.greatest(n - (window - 1), F.lit(0))), F.lit(0)), F.count_if(n >= window)).first()
    bits = min(63, max(16, int(total).bit_length() + extra))
    seg_bits = min(bits, max(0, (int(total) // segment_windows).bit_length()))

    # copies of whole documents
    info = blocks.select("to", F.posexplode(F.arrays_zip("doc_ids", "n_words", "hi", "lo")).alias("idx", "d"))
    info = info.select("to", "idx", F.coalesce("d.doc_ids", F.lit(NULL_ID)).alias("doc_id"), F.col("d.n_words").alias("n"), "d.hi", "d.lo").where(F.col("n") >= window)
    copies = staged(copies_of(info, texts, hot_share).groupBy("to").agg(F.collect_list("idx").alias("copies")), "copies")

    def sketch(batches):
        for b in batches:
            for to, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                cells = Block(payload, window, bits).cells
                yield messages([(seg, to, pack_u(cells[a:z])) for seg, a, z in by_segment(cells, bits - seg_bits)])

    def merge(t: pa.Table) -> pa.Table:
        rows = group_rows(t)
        parts = [unpack_u(r["payload"]) for r in rows]
        cells = np.sort(np.concatenate(parts))
        twice = cells[1:][cells[1:] == cells[:-1]]                      # each block names a cell once
        ends = np.append(twice, np.uint64(0))                           # a last entry, so that every place has one
        found = ((p, np.searchsorted(twice, p)) for p in parts)
        out = [(r["src"], r["to"], _packed((at < len(twice)) & (ends[at] == p))) for r, (p, at) in zip(rows, found)]
        return pa.Table.from_batches([messages(out)])

    sketched = blocks.select("to", "payload").mapInArrow(sketch, MESSAGE)
    repeated = staged(sketched.groupBy("to").applyInArrow(merge, MESSAGE), "repeated")

    # second pass: the block with its flags, on the key of the block
    empty = F.lit(None)
    own = blocks.select("to", F.lit(-1).cast("long").alias("src"), "payload", "doc_ids", empty.cast("array<int>").alias("copies"))
    flags = repeated.select("to", "src", "payload", empty.cast("array<long>").alias("doc_ids"), empty.cast("array<int>").alias("copies"))
    same = copies.select("to", F.lit(-2).cast("long").alias("src"), empty.cast("binary").alias("payload"), empty.cast("array<long>").alias("doc_ids"), "copies")
    together = own.unionByName(flags).unionByName(same)

    def opened(rows: list[dict]):
        me = next(r for r in rows if r["src"] == -1)
        copied = {i for r in rows if r["src"] == -2 for i in r["copies"]}
        block = Block(me["payload"], window, bits)
        ids = np.array([NULL_ID if i is None else i for i in me["doc_ids"]], np.int64)
        seen = _flag([r["payload"] for r in rows if 0 <= r["src"] < ANSWER], len(block.cells))
        return me, block, ids, copied, *block.suspects(seen, copied, ids)

    def exact(t: pa.Table) -> pa.Table:
        me, block, ids, _, w, is_first = opened(group_rows(t))
        w = w[is_first]
        h, out = block.h[w], []
        for seg, a, z in by_segment(h, 64 - seg_bits) if seg_bits else [(0, 0, len(h))] if len(h) else []:
            p = w[a:z]
            parts = [pack_u(h[a:z]), pack_u(block.g[p] & LOW, False), pack_u(ids[block.doc[p]].view(np.uint64), False)]
            out.append((seg, me["to"], b"".join(len(x).to_bytes(8, "little") + x for x in parts)))
        return pa.Table.from_batches([messages(out)])

    def decide(t: pa.Table) -> pa.Table:
        rows = group_rows(t)
        cols: list[list[np.ndarray]] = [[], [], []]
        for r in rows:
            at, raw = 0, r["payload"]
            for i, c in enumerate(cols):
                n = int.from_bytes(raw[at:at + 8], "little")
                c.append(unpack_u(raw[at + 8:at + 8 + n], i == 0))
                at += 8 + n
        n = [len(x) for x in cols[0]]
        h, g, doc = (np.concatenate(c) for c in cols)
        doc = doc.view(np.int64)
        order = np.lexsort((np.repeat(np.arange(len(rows)), n), doc, g, h))
        win = np.ones(len(h), bool)
        win[order[1:]] = (h[order[1:]] != h[order[:-1]]) | (g[order[1:]] != g[order[:-1]])
        cut = np.concatenate([[0], np.cumsum(n)])
        return pa.Table.from_batches([messages([(r["src"], ANSWER + r["to"], _packed(win[a:z])) for r, a, z in zip(rows, cut, cut[1:])])])

    asked = together.groupBy("to").applyInArrow(exact, MESSAGE)
    decided = staged(asked.groupBy("to").applyInArrow(decide, MESSAGE), "decided")
    answers = decided.select("to", "src", "payload", empty.cast("array<long>").alias("doc_ids"), empty.cast("array<int>").alias("copies"))

    def remove(t: pa.Table) -> pa.Table:
        rows = group_rows(t)
        me, block, _, copied, w, is_first = opened(rows)
        earlier = ~is_first
        earlier[is_first] = ~_flag([r["payload"] for r in rows if r["src"] >= ANSWER], int(is_first.sum()))
        gone = w[earlier]
        start = block.at[block.doc[gone]] + block.pos[gone]
        edge = np.bincount(start, minlength=block.at[-1] + 1) - np.bincount(start + window, minlength=block.at[-1] + 1)
        covered = np.cumsum(edge)[:-1] > 0
        removed, kept = [], []
        for k, text in enumerate(block.texts):
            c = covered[block.at[k]:block.at[k + 1]]
            n = len(c) if k in copied else int(c.sum())
            removed.append(n)
            kept.append(text if n == 0 else b"" if n == len(c) else b" ".join(x for x, y in zip(text.split(b" "), c.tolist()) if not y))
        return pa.table({"doc_id": pa.array(me["doc_ids"], pa.int64()), "n_words": pa.array(block.n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.binary())})

    return together.unionByName(answers).groupBy("to").applyInArrow(remove, "doc_id long, n_words long, n_removed long, kept binary")

"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

A window is ``window`` consecutive words of a benchmark item; an item of fewer
words, but not none, is one window. The symbols of the search are words: for
each pattern length a shift table over blocks of two words tells how far the
search may skip, a zero shift selects the patterns of that suffix block, and the
words' bytes are compared before an occurrence counts.

Only the benchmark's patterns travel to the tasks, in blocks of at most
``max_words`` pattern words, so what is broadcast is bounded whatever the size
of the benchmark; documents are never shuffled.

Null or empty texts (documents or items) have no words: such a document has no
hits and such an item no windows. Repeated documents are judged alike, row by
row; items with the same id count once, a null id as the empty string.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_WORDS, LOWER, mix64, numbered, span_hash, staged, struct_array, text_bytes, text_udf, word_spans

SEGMENT = 256            # words that one search cursor covers
TABLE = 1 << 18
SUMMARY = "struct<n_words: bigint, n_hit: bigint, n_items: bigint, items_sha256: string>"
RESULT = "struct<n_words: bigint, hits: binary, items: array<string>>"


def _blocks(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of the block of ``size`` words that ends at each place (from place size-1 on)."""
    return h if size == 1 else mix64(h[:-1] * np.uint64(3) + h[1:])


@dataclass
class PatternSet:
    """Wu-Manber tables of patterns of one length."""

    length: int
    words: np.ndarray                    # (patterns, length) word hashes
    raw: list[bytes]                     # the patterns' words joined by a space
    items: list[list[str]]
    shift: np.ndarray = field(init=False)
    block: int = field(init=False)

    def __post_init__(self):
        n, m = self.words.shape
        self.block = b = min(2, m)
        blocks = np.stack([_blocks(r, b) for r in self.words])            # (n, m-b+1)
        self.shift = np.full(TABLE, m - b + 1, np.int64)
        for j in range(m - b + 1):
            np.minimum.at(self.shift, (blocks[:, j] % np.uint64(TABLE)).astype(np.int64), m - b - j)
        order = np.argsort(blocks[:, -1], kind="stable")
        self.words, self.raw, self.items = self.words[order], [self.raw[i] for i in order], [self.items[i] for i in order]
        self.suffix = blocks[order, -1]

    def search(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first word, pattern) of all candidates whose words all have the patterns' hashes."""
        m, b = self.length, self.block
        if len(h) < m:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        blocks = _blocks(h, b)                                              # block ending at word p is blocks[p-b+1]
        n = np.diff(first)
        segs = np.where(n >= m, -(-(n - m + 1) // SEGMENT), 0)
        text = np.repeat(np.arange(len(n)), segs)
        k = np.arange(len(text)) - np.repeat(np.cumsum(segs) - segs, segs)
        at = first[text] + k * SEGMENT + m - 1                              # last word of the window under the cursor
        stop = np.minimum(at + SEGMENT, first[text + 1])
        found_at, found = [], []
        while len(at):
            blk = blocks[at - b + 1]
            step = self.shift[(blk % np.uint64(TABLE)).astype(np.int64)]
            zero = np.flatnonzero(step == 0)
            if len(zero):
                lo, hi = np.searchsorted(self.suffix, blk[zero], "left"), np.searchsorted(self.suffix, blk[zero], "right")
                cnt = hi - lo
                if cnt.sum():
                    p = np.repeat(lo, cnt) + np.arange(cnt.sum()) - np.repeat(np.cumsum(cnt) - cnt, cnt)
                    s = np.repeat(at[zero] - m + 1, cnt)
                    same = np.ones(len(p), bool)
                    for j in range(m):                                      # first word first: most candidates end there
                        live = np.flatnonzero(same)
                        same[live] = h[s[live] + j] == self.words[p[live], j]
                    found_at.append(s[same])
                    found.append(p[same])
            at = at + np.maximum(step, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        return (np.concatenate(found_at), np.concatenate(found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64))


def patterns_of(items: list[tuple[str, str | None]], window: int) -> list[PatternSet]:
    """Pattern tables by length from (item id, text) pairs."""
    data, off = text_bytes(pa.array([t or "" for _, t in items], pa.large_string()))
    data = LOWER[data]
    starts, ends, first = word_spans(data, off, ALNUM_WORDS)
    h = span_hash(data, starts, ends)
    raw = data.tobytes()
    by: dict[int, dict[bytes, tuple[np.ndarray, set]]] = {}
    for k, (item, _) in enumerate(items):
        n = first[k + 1] - first[k]
        m = min(n, window)
        for i in range(first[k], first[k + 1] - m + 1) if n else ():
            key = b" ".join(raw[starts[j]:ends[j]] for j in range(i, i + m))
            by.setdefault(int(m), {}).setdefault(key, (h[i:i + m], set()))[1].add(item)
    return [PatternSet(m, np.stack([w for w, _ in v.values()]), list(v), [sorted(s) for _, s in v.values()]) for m, v in sorted(by.items())]


def scan(data: np.ndarray, off: np.ndarray, sets: list[PatternSet]) -> tuple[np.ndarray, list[bytes], list[list[str]]]:
    """Words, hit words (as int32 start/end pairs) and items of each text."""
    data = LOWER[data] if len(data) else data
    starts, ends, first = word_spans(data, off, ALNUM_WORDS)
    n = len(off) - 1
    hits: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    items: list[set[str]] = [set() for _ in range(n)]
    if sets and len(starts):
        h = span_hash(data, starts, ends)
        for ps in sets:
            at, which = ps.search(h, first)
            doc = np.searchsorted(first, at, "right") - 1
            for s, p, d in zip(at.tolist(), which.tolist(), doc.tolist()):
                got = b" ".join(data[starts[j]:ends[j]].tobytes() for j in range(s, s + ps.length))
                if got == ps.raw[p]:                                        # direct comparison
                    hits[d].append((s - int(first[d]), s - int(first[d]) + ps.length))
                    items[d].update(ps.items[p])
    return np.diff(first), [np.array(sorted(set(x)), np.int32).tobytes() for x in hits], [sorted(x) for x in items]


def _covered(spans: list[bytes]) -> int:
    got = sorted((int(a), int(b)) for s in spans for a, b in np.frombuffer(s or b"", np.int32).reshape(-1, 2))
    n, end = 0, 0
    for a, b in got:
        n += max(0, b - max(a, end))
        end = max(end, b)
    return n


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_words: int = 2_000_000, text_col: str = "text", name: str = "contamination") -> DataFrame:
    """``docs`` with one more column ``name``: struct(n_words, n_hit, n_items, items_sha256). A column of that name is replaced.

    An item is one row of the broadcast; items are dealt into blocks by a hash of their id and text so that a block
    holds about ``max_words`` words, and each block is a pass over the documents.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] / 4      # four characters a word
    blocks = max(1, -(-int(total) // max_words))
    plain, named, columns = numbered(docs)
    text = F.col(named(text_col))
    if blocks == 1:                                                 # search and summary in one pass of one Python worker
        sets = spark.sparkContext.broadcast(patterns_of([tuple(r) for r in items.distinct().collect()], window))

        def judged(data, off):
            n, hits, its = scan(data, off, sets.value)
            return _summary(n, [[h] for h in hits], [[x] for x in its])

        return _named(plain.withColumn("__made", text_udf(judged, SUMMARY)(text)), docs.columns, columns, name)
    names = []
    out = plain
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        sets = spark.sparkContext.broadcast(patterns_of([tuple(r) for r in part.distinct().collect()], window))

        def found(data, off, sets=sets):
            n, hits, its = scan(data, off, sets.value)
            return struct_array(n_words=pa.array(n, pa.int64()), hits=pa.array(hits, pa.binary()), items=pa.array(its, pa.list_(pa.string())))

        names.append(f"__hits_{k}")
        out = out.withColumn(names[-1], text_udf(found, RESULT)(text))
        out = staged(out, "decontam")

    def merge(words: pa.Array, hits: pa.Array, items: pa.Array) -> pa.Array:
        return _summary(words, hits.to_pylist(), items.to_pylist())

    merge.__annotations__ = {"words": pa.Array, "hits": pa.Array, "items": pa.Array, "return": pa.Array}
    made = F.arrow_udf(merge, SUMMARY)(F.col(names[0])["n_words"], F.array(*[F.col(n)["hits"] for n in names]), F.array(*[F.col(n)["items"] for n in names]))
    return _named(out.withColumn("__made", made), docs.columns, columns, name)


def _summary(n_words, hits: list[list[bytes]], items: list[list[list[str]]]) -> pa.Array:
    """The counts of each document from its hits and items by block."""
    rows = [sorted(set(x for y in i for x in y)) for i in items]
    return struct_array(
        n_words=pa.array(n_words, pa.int64()), n_hit=pa.array([_covered(x) for x in hits], pa.int64()), n_items=pa.array([len(x) for x in rows], pa.int64()),
        items_sha256=pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in rows], pa.string()))


def _named(made: DataFrame, own: list[str], columns: list[str], name: str) -> DataFrame:
    """``made`` under its own names again, with ``__made`` as the last column."""
    kept = [(c, o) for c, o in zip(columns, own) if o.lower() != name.lower()]
    return made.select(*[F.col(c) for c, _ in kept], "__made").toDF(*[o for _, o in kept], name)


def clean(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """The documents in which no benchmark window occurs, with their own columns."""
    plain, named, columns = numbered(docs)
    judged = contamination(plain, benchmark, text_col=named(kw.pop("text_col", "text")), name="__contamination", **kw)
    return judged.where(F.col("__contamination.n_hit") == 0).select(*columns).toDF(*docs.columns)

"""SimHash near-duplicates with BK-trees.

A document's fingerprint has a bit set where over half of its shingles' XXH64
values (seed 42) have it. Equal fingerprints are one class from the start, so a
group of copies is one entry. Two fingerprints within ``radius`` bits agree in at
least one of ``radius + 1`` bit blocks, so each distinct fingerprint is dealt to
one bucket per block, buckets to shards, and each shard's task grows a BK-tree
per bucket (children keyed by the integer Hamming distance to their parent) and
searches it for every fingerprint of the bucket, following only edges within the
radius. The trees are dealt with their queries instead of being broadcast: a tree
of all fingerprints has no size bound. A bucket with more than ``bucket_limit``
fingerprints is dealt again by the blocks of its other bits, which loses no link.

A bucket hands on only a spanning set of its links; connected components come
from alternating large-star and small-star rounds on tables in the shared folder.

Null and empty texts have fingerprint 0 and are linked like any other. Rows with
a null doc_id belong to the component of their fingerprint without naming it (a
component of such rows alone has a null id). Repeated rows keep their rows.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE_WORDS, staged, text_udf, word_spans

PART = 1 << 16


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 with seed 42 of every run of ``size`` words joined by a space (of all words, if fewer)."""
    import xxhash

    text = b" ".join(words)
    n = len(words)
    if n <= size:
        return np.array([xxhash.xxh64_intdigest(text, 42)], np.uint64) if n else np.empty(0, np.uint64)
    length = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(length + 1) - 1
    starts = ends - length
    cuts = map(slice, starts[:n - size + 1].tolist(), ends[size - 1:].tolist())
    return np.fromiter(map(xxhash.xxh64_intdigest, map(text.__getitem__, cuts), repeat(42)), np.uint64, n - size + 1)


def simhash(h: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), PART):
        ones += np.unpackbits(h[i:i + PART].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprinted(docs: DataFrame, name: str, shingle: int = 3, text_col: str = "text") -> DataFrame:
    """``docs`` with a column of the fingerprint as a long (its 64 bits)."""

    def prints(data, off):
        low = (LOWER[data] if len(data) else data).tobytes()
        got = [simhash(shingle_hashes(low[a:z].split(), shingle)) for a, z in zip(off[:-1].tolist(), off[1:].tolist())]
        return pa.array(np.array(got, np.uint64).view(np.int64))

    return docs.withColumn(name, text_udf(prints, "bigint")(F.col(text_col)))


class BKTree:
    """A BK-tree over distinct 64-bit values, grown level by level; edges are sorted by (parent, distance)."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.values = values
        edge_key, edge_to = [], []
        group = np.zeros(n, np.int64)
        left = np.arange(n)
        self.root = 0
        while len(left):
            _, first = np.unique(group, return_index=True)              # the first value of a group is its node
            node = left[first]
            which = np.searchsorted(group[first], group)
            rest = np.ones(len(left), bool)
            rest[first] = False
            parent, left = node[which[rest]], left[rest]
            d = np.bitwise_count(values[left] ^ values[parent]).astype(np.int64)
            key = parent * 65 + d
            order = np.argsort(key, kind="stable")
            group, left = key[order], left[order]
            keys, at = np.unique(group, return_index=True)
            edge_key.append(keys)
            edge_to.append(left[at])
        key, to = np.concatenate(edge_key), np.concatenate(edge_to)
        order = np.argsort(key)
        self.key, self.to = key[order], to[order]

    def within(self, radius: int, most: int = 1 << 20):
        """Pairs (query, found) of different values within the radius, for all values as queries, in bounded blocks."""
        n = len(self.values)
        todo = [(np.arange(i, min(n, i + 4096)), np.full(min(n, i + 4096) - i, self.root)) for i in range(0, n, 4096)][::-1]
        while todo:
            q, node = todo.pop()
            d = np.bitwise_count(self.values[q] ^ self.values[node]).astype(np.int64)
            near = (d <= radius) & (q != node)
            if near.any():
                yield q[near], node[near]
            lo = np.searchsorted(self.key, node * 65 + np.maximum(d - radius, 0), "left")
            hi = np.searchsorted(self.key, node * 65 + np.minimum(d + radius, 64), "right")
            n_edges = hi - lo
            total = np.cumsum(n_edges)
            if total[-1] == 0:
                continue
            for part in np.split(np.arange(len(q)), np.searchsorted(total, np.arange(most, total[-1], most))) if total[-1] > most else [np.arange(len(q))]:
                k = n_edges[part]
                if k.sum():
                    at = np.repeat(lo[part], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                    todo.append((np.repeat(q[part], k), self.to[at]))


def components(values: np.ndarray, radius: int) -> np.ndarray:
    """For each value the place of a representative of those linked to it, by a search of the values' BK-tree."""
    label = np.arange(len(values))
    if len(values) < 2:
        return label
    for a, b in BKTree(values).within(radius):
        pairs = np.unique(np.stack([label[a], label[b]]), axis=1)
        up: dict[int, int] = {}

        def find(x: int, up=up) -> int:
            while up.get(x, x) != x:
                up[x] = up.get(up[x], up[x])
                x = up[x]
            return x

        for x, y in zip(*pairs.tolist()):
            x, y = find(x), find(y)
            if x != y:
                up[max(x, y)] = min(x, y)
        if up:
            root = np.arange(len(values))
            for x in up:
                root[x] = find(x)
            label = root[label]
    return label


def _blocks(n_bits: int, parts: int) -> list[tuple[int, int]]:
    """(first bit, bits) of parts of about equal width."""
    edge = [round(i * n_bits / parts) for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edge, edge[1:])]


def _bits(col, first: int, n: int):
    return F.shiftrightunsigned(col, first).bitwiseAND(F.lit((1 << n) - 1)) if n < 64 else col


def links(prints: DataFrame, radius: int, bucket_limit: int = 4096, shard_rows: int = 50_000) -> DataFrame:
    """A spanning set of the links between distinct fingerprints (column fp) within the radius: a, b with a < b."""
    fp = F.col("fp")
    blocks = _blocks(64, radius + 1)
    keyed = prints.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("block"), _bits(fp, s, n).alias("value")) for i, (s, n) in enumerate(blocks)])).alias("k")).select("fp", "k.block", "k.value")
    sizes = keyed.groupBy("block", "value").agg(F.count("*").alias("n")).where("n > 1")
    cells = keyed.join(sizes, ["block", "value"]).withColumn("sub", F.lit(-1)).withColumn("part", F.lit(0).cast("long"))
    # a large bucket: its other bits in radius + 1 blocks, of which linked fingerprints share one again
    finer = []
    for i, (s, n) in enumerate(blocks):
        rest = [(a, b) for a, b in ((0, s), (s + n, 64 - s - n)) if b]
        other = F.lit(0).cast("long")
        at = 0
        for a, b in rest:
            other = other.bitwiseOR(F.shiftleft(_bits(fp, a, b), at))
            at += b
        subs = F.array(*[F.struct(F.lit(j).alias("sub"), _bits(other, a, b).alias("part")) for j, (a, b) in enumerate(_blocks(at, radius + 1))])
        finer.append(cells.where((F.col("block") == i) & (F.col("n") > bucket_limit)).drop("sub", "part").withColumn("e", F.explode(subs)).select("fp", "block", "value", "n", "e.sub", "e.part"))
    small = cells.where(F.col("n") <= bucket_limit).select("fp", "block", "value", "n", "sub", "part")
    for f in finer:
        small = small.unionByName(f)
    small = staged(small, "buckets")
    shards = max(1, small.count() // shard_rows)
    dealt = small.withColumn("shard", F.pmod(F.xxhash64("block", "value", "sub", "part"), F.lit(shards)))

    def search(t: pa.Table) -> pa.Table:
        v = t["fp"].to_numpy().view(np.uint64)
        cols = [t[c].to_numpy() for c in ("block", "value", "sub", "part")]
        order = np.lexsort([v, *cols])
        v, cols = v[order], [c[order] for c in cols]
        edge = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1 if len(v) > 1 else np.empty(0, np.int64)
        a, b = [], []
        for x, y in zip([0, *edge.tolist()], [*edge.tolist(), len(v)]):
            if y - x > 1:
                own = v[x:y]
                label = components(own, radius)
                linked = np.flatnonzero(label != np.arange(len(own)))
                a.append(own[label[linked]])
                b.append(own[linked])
        a, b = (np.concatenate(c).view(np.int64) if c else np.empty(0, np.int64) for c in (a, b))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    got = dealt.groupBy("shard").applyInArrow(search, "a long, b long").distinct()
    return staged(got, "links")


def connect(edges: DataFrame) -> DataFrame:
    """(id, root) of every id in ``edges`` (a, b); the root is the least id of the component.

    Rounds go on until the stars don't change; their number grows with the logarithm of the longest path (squared at worst).
    """
    e = edges
    last = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("x"), F.col("m").alias("y"))
        down = large.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        star = down.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("x"), F.col("m").alias("y")), F.struct(F.col("a").alias("x"), F.col("m").alias("y")))).alias("s")).select("s.x", "s.y").where("x <> y").distinct()
        e = staged(star.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "stars")
        now = e.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        if now == last or now.n == 0:
            return e.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("root"))
        last = now


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, bucket_limit: int = 4096) -> DataFrame:
    """doc_id, fp (long) and component_id, the smallest doc_id reachable over links, for every row."""
    prints = staged(fingerprinted(docs.select("doc_id", "text"), "__fp", shingle).select("doc_id", F.col("__fp").alias("fp")), "fingerprints")
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = connect(links(prints.select("fp").distinct(), radius, bucket_limit))
    named = first.join(roots, F.col("fp") == F.col("id"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(named.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, **kw) -> DataFrame:
    """One document of each component, its smallest doc_id, with the documents' own columns.

    Of repeated rows of that doc_id one stays; rows without a doc_id stay as they can't be told apart.
    """
    kept = near_duplicates(docs, **kw).where("doc_id = component_id").select("doc_id").distinct()
    cols = [F.col(f"`{c}`") for c in docs.columns]
    firsts = docs.join(kept, "doc_id", "left_semi").select(*cols)
    plain = [c for c, t in docs.dtypes if not t.startswith("map")]
    firsts = firsts.groupBy("doc_id").agg(F.min_by(F.struct(*cols), F.xxhash64(*[F.col(f"`{c}`") for c in plain])).alias("__row")).select("__row.*")
    return firsts.unionByName(docs.where(F.col("doc_id").isNull()).select(*cols))

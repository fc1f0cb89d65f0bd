"""Approximate nearest neighbours by cross-polytope hashing.

Vectors are scaled to the unit ball by the largest norm and lifted by one
coordinate to unit length, which turns the largest inner product into the
nearest direction. In each of ``tables`` tables a pseudo-rotation (three rounds
of random signs and a fast Hadamard transform) is applied and the vector is
assigned to its nearest signed axis; a second rotation, of which only the first
few axes are used, splits buckets further, so that buckets grow in number with
the rows. A query probes the axes nearest to it in each table. How many is
fitted: a bounded sample of queries is searched exactly over all rows, and the
smallest number of probes that finds ``target`` of their neighbours is taken.

Rows with equal vectors are one entry of the index, with their ids beside it, so
a group of copies is searched once; equal query vectors are searched once. Index
entries and probes of a bucket meet in cells of bounded size: a bucket with more
than ``cell_rows`` entries or probes is split into blocks of either side. Each
cell hands on a query's k best, and the best of all cells are exactly reranked
by double-precision inner products of the original vectors.

Vectors null, empty, zero or with null or non-finite components, and those of
another length than the most frequent one, take no part, nor do rows without an
id. Repeated rows count once; a query's own id is never its neighbour. An id on
several different vectors asks with each of them, and each has its own ranks.
Ties go to the smaller id. With fewer than two rows there are no results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row (a power of two long), orthonormal."""
    n = x.shape[1]
    h = 1
    while h < n:
        x = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


@dataclass
class CrossPolytope:
    """The hash functions: ``signs[table, function, round]`` and how many axes the second function uses (0: none)."""

    dim: int
    tables: int
    second: int
    scale: float

    def __post_init__(self):
        self.width = 1 << (self.dim).bit_length()                    # room for the lifted coordinate
        self.signs = np.random.default_rng(1).choice([-1.0, 1.0], (self.tables, 2, 3, self.width))

    @property
    def buckets(self) -> int:
        return 2 * self.width * max(1, 2 * self.second)

    def unit(self, x: np.ndarray, query: bool) -> np.ndarray:
        out = np.zeros((len(x), self.width))
        if query:
            out[:, :self.dim] = x / np.linalg.norm(x, axis=1, keepdims=True)
        else:
            out[:, :self.dim] = x / self.scale
            out[:, self.dim] = np.sqrt(np.maximum(0, 1 - (out[:, :self.dim] ** 2).sum(axis=1)))
        return out

    def axes(self, u: np.ndarray, table: int) -> list[np.ndarray]:
        """Each function's values on its signed axes."""
        got = []
        for f, n in enumerate((self.width, self.second)):
            if n:
                y = u
                for r in range(3):
                    y = hadamard(y * self.signs[table, f, r])
                got.append(np.concatenate([y[:, :n], -y[:, :n]], axis=1))
        return got

    def keys(self, u: np.ndarray, table: int) -> np.ndarray:
        first, *second = (a.argmax(axis=1) for a in self.axes(u, table))
        return first * (2 * self.second) + second[0] if second else first

    def order(self, u: np.ndarray, table: int) -> np.ndarray:
        """All bucket keys of each query from the most to the least likely: by how far its values fall short of the largest."""
        gaps = [(a.max(axis=1, keepdims=True) - a) ** 2 for a in self.axes(u, table)]
        cost = gaps[0] if len(gaps) == 1 else (gaps[0][:, :, None] + gaps[1][:, None, :]).reshape(len(u), -1)
        return np.argsort(cost, axis=1, kind="stable")


def _matrix(col, dim: int) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    col = col.chunk(0) if isinstance(col, pa.ChunkedArray) else col
    return np.asarray(col.flatten(), np.float64).reshape(-1, dim)


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products summed in order of the components, so that a pair's score doesn't depend on where it is computed."""
    return np.cumsum(q * x, axis=1)[:, -1]


def _best(s: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each row and those that tie with the last up to rounding."""
    if s.shape[1] <= k:
        return np.ones(s.shape, bool)
    last = -np.partition(-s, k - 1, axis=1)[:, k - 1:k]
    return s >= last - 1e-9 * np.maximum(1, np.abs(last))


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id and vec (array of double, without negative zeros) of the rows that take part, each once."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    ok = F.col("id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("vec")).where(ok)
    fine = ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = rows.where(F.coalesce(fine, F.lit(False)))
    return rows.select("id", F.transform("vec", lambda x: x + F.lit(0.0)).alias("vec")).distinct()


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", tables: int = 8,
            target: float = 0.96, sample: int = 128, bucket_rows: int = 400, cell_rows: int = 60_000) -> DataFrame:
    """query_id, rank (from 1), the neighbour's id as ``id_col``, score: the k nearest found of each query row among all
    rows but those of its own id."""
    spark = vectors.sparkSession
    schema = f"query_id long, rank int, {id_col} long, score double"
    rows = usable(vectors, id_col, vec_col)
    rows = staged(rows, "vectors")
    dim = rows.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if dim is None:
        return spark.createDataFrame([], schema)
    dim = dim.dim
    rows = rows.where(F.size("vec") == dim)
    wanted = usable(queries, id_col, vec_col).where(F.size("vec") == dim)
    # equal vectors: one entry with its k + 1 least ids, enough whichever id asks; the limit of the rank cuts each task's rows before the shuffle
    place = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    least = rows.select("vec", "id").distinct().withColumn("place", place).where(F.col("place") <= k + 1)
    index = staged(least.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("rep", F.col("ids")[0]), "entries")
    asked = staged(wanted.groupBy("vec").agg(F.min("id").alias("q")), "queries")
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    facts = index.agg(F.count("*").alias("n"), F.max(norm).alias("m")).first()
    second = 0
    width = 1 << dim.bit_length()
    while 2 * width * max(1, 2 * second) * bucket_rows < facts.n and second < width:
        second = max(1, 2 * second)
    h = CrossPolytope(dim, tables, second, facts.m)
    probes = _fit(index, asked, h, k, target, sample)
    shared = spark.sparkContext.broadcast(h)                        # random signs only

    def hashed(batches):
        h = shared.value
        for b in batches:
            u = h.unit(_matrix(b.column(1), dim), False)
            t = pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(b.num_rows), h.tables))], names=["i"])
            keys = np.stack([h.keys(u, i) + i * h.buckets for i in range(h.tables)], axis=1).ravel()
            take = t.column(0)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), b.column(0).take(take), b.column(1).take(take)], names=["key", "id", "vec"])

    def probing(batches):
        h = shared.value
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                u = h.unit(_matrix(part.column(1), dim), True)
                keys = np.concatenate([h.order(u, j)[:, :probes] + j * h.buckets for j in range(h.tables)], axis=1)
                take = pa.array(np.repeat(np.arange(part.num_rows), keys.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel(), pa.int64()), part.column(0).take(take), part.column(1).take(take)], names=["key", "id", "vec"])

    shape = "key long, id long, vec array<double>"
    left = asked.select("q", "vec").mapInArrow(probing, shape)
    right = index.select("rep", "vec").mapInArrow(hashed, shape)
    # buckets too large for one cell (few: each has over cell_rows of the rows) are split into blocks of either side
    big = left.groupBy("key").agg(F.count("*").alias("nq"), F.lit(0).cast("long").alias("nx")).unionByName(right.groupBy("key").agg(F.lit(0).cast("long").alias("nq"), F.count("*").alias("nx")))
    big = big.groupBy("key").agg(F.sum("nq").alias("nq"), F.sum("nx").alias("nx")).where((F.col("nq") > cell_rows) | (F.col("nx") > cell_rows))
    big = staged(big.select("key", F.ceil(F.col("nq") / cell_rows).cast("int").alias("bq"), F.ceil(F.col("nx") / cell_rows).cast("int").alias("bx")), "large")
    # a table's buckets are dealt to so many cells; a query meets at most tables * min(probes, cells) of them
    cells = max(1, -(-facts.n // cell_rows))

    def celled(side: DataFrame, own: str, other: str) -> DataFrame:
        got = side.join(big, "key", "left").withColumn("me", F.coalesce(F.pmod(F.xxhash64("id"), F.col(own)).cast("int"), F.lit(0)))
        got = got.withColumn("you", F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other) - 1, F.lit(0)))))
        pair = ("me", "you") if own == "bq" else ("you", "me")
        of_table = F.floor(F.col("key") / h.buckets).cast("long") * cells + F.pmod(F.xxhash64("key"), F.lit(cells))
        cell = F.when(F.col(own).isNull(), of_table).otherwise(F.xxhash64("key", *pair).bitwiseOR(F.lit(1 << 40)))
        return got.select(cell.alias("cell"), "key", "id", "vec")

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        qs, xs, ss = [], [], []
        if a.num_rows and b.num_rows:
            ak, bk = a["key"].to_numpy(), b["key"].to_numpy()
            ao, bo = np.argsort(ak, kind="stable"), np.argsort(bk, kind="stable")
            ak, bk = ak[ao], bk[bo]
            q, x = _matrix(a["vec"], dim)[ao], _matrix(b["vec"], dim)[bo]
            qi, xi = a["id"].to_numpy()[ao], b["id"].to_numpy()[bo]
            for key in np.intersect1d(ak, bk):
                a0, a1 = np.searchsorted(ak, key, "left"), np.searchsorted(ak, key, "right")
                b0, b1 = np.searchsorted(bk, key, "left"), np.searchsorted(bk, key, "right")
                for i in range(a0, a1, 256):
                    j = min(i + 256, a1)
                    r, c = np.nonzero(_best(q[i:j] @ x[b0:b1].T, xi[b0:b1], k + 1))
                    qs.append(qi[i:j][r])
                    xs.append(xi[b0:b1][c])
                    ss.append(_scores(q[i:j][r], x[b0:b1][c]))
        if not qs:
            return pa.table({"q": pa.array([], pa.int64()), "rep": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        q, x, s = np.concatenate(qs), np.concatenate(xs), np.concatenate(ss)
        order = np.lexsort((x, -s, q))                              # a query's best of the whole cell, each entry once
        q, x, s = q[order], x[order], s[order]
        keep = np.ones(len(q), bool)
        keep[1:] = (q[1:] != q[:-1]) | (x[1:] != x[:-1])
        q, x, s = q[keep], x[keep], s[keep]
        start = np.searchsorted(q, q, "left")
        keep = np.arange(len(q)) - start <= k
        return pa.table({"q": q[keep], "rep": x[keep], "score": s[keep]})

    found = celled(left, "bq", "bx").groupBy("cell").cogroup(celled(right, "bx", "bq").groupBy("cell")).applyInArrow(search, "q long, rep long, score double")
    best = found.groupBy("q", "rep").agg(F.max("score").alias("score"))
    best = best.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "rep"))).where(F.col("r") <= k + 1)
    # back from entries to rows: at most k + 1 entries of at most k + 1 ids each
    named = best.join(index.select("rep", "ids"), "rep").groupBy("q").agg(F.collect_list(F.struct("score", "ids")).alias("found"))
    out = wanted.join(asked, "vec").select("id", "q").join(named, "q")
    flat = F.flatten(F.transform("found", lambda f: F.transform(f["ids"], lambda i: F.struct((-f["score"]).alias("minus"), i.alias("id")))))
    mine = F.slice(F.array_sort(F.filter(flat, lambda x: x["id"] != F.col("id"))), 1, k)
    got = out.select(F.col("id").alias("query_id"), F.posexplode(mine).alias("p", "x"))
    return got.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.id").alias(id_col), (-F.col("x.minus")).alias("score"))


def exact_sample(index: DataFrame, queries: list[tuple[int, list[float]]], dim: int, k: int) -> dict[int, list[tuple[int, np.ndarray]]]:
    """(entry, vector) of the k nearest entries of each of a few queries, exactly, by one scan over all entries."""
    q = np.array([v for _, v in queries])

    def scan(batches):
        for b in batches:
            x, ids = _matrix(b.column(1), dim), np.asarray(b.column(0))
            s = q @ x.T
            r, c = np.nonzero(_best(s, ids, k))
            yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(ids[c]), pa.array(s[r, c]), b.column(1).take(pa.array(c))], names=["q", "rep", "score", "vec"])

    part = index.select("rep", "vec").mapInArrow(scan, "q long, rep long, score double, vec array<double>")
    part = part.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "rep"))).where(F.col("r") <= k)
    got: dict[int, list] = {}
    for r in part.collect():                                        # sample * k rows
        got.setdefault(r.q, []).append((r.rep, np.array(r.vec)))
    return got


def _fit(index: DataFrame, asked: DataFrame, h: CrossPolytope, k: int, target: float, sample: int) -> int:
    """Probes per table with which the sampled queries find ``target`` of their exact neighbours."""
    some = [(r.q, r.vec) for r in asked.orderBy(F.xxhash64("q"), "q").limit(sample).collect()]
    if not some:
        return 1
    ranks = []
    for i, near in exact_sample(index, some, h.dim, k).items():
        u = h.unit(np.array([some[i][1]]), True)
        x = h.unit(np.stack([v for _, v in near]), False)
        place = []
        for t in range(h.tables):
            order = h.order(u, t)[0]
            at = np.empty(len(order), np.int64)
            at[order] = np.arange(len(order))
            place.append(at[h.keys(x, t)])
        ranks.append(np.min(place, axis=0))
    ranks = np.sort(np.concatenate(ranks))
    return int(ranks[min(len(ranks) - 1, int(np.ceil(target * len(ranks))))]) + 1

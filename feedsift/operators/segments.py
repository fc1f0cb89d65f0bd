"""Ordered work per key without one task per key: sorted segments, their transfer functions, a fold over segments.

Rows are range-partitioned by (key, order), sorted, numbered and checkpointed; a segment is a run of at most ``2 ** bits`` rows of
that order, whatever keys they have. What a greedy process does within a segment depends on what went before only by
a small state. So the segments first tell, in parallel, how every state they may be entered in comes out of them; a fold over a
key's segments (a few numbers each) finds the states really taken; then the segments mark their rows, in parallel again. A key with a third
of all rows is spread over its segments like any other rows.

``pack_rows`` packs rows greedily into blocks, ``keep_within_ttl`` thins rows to one per time to live; both follow
"next start" pointers, found by a binary search over prefix sums or times, with pointer doubling within a segment.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedsift.session import cut_lineage

BITS = 13


def in_segments(df: DataFrame, order: list[str], bits: int = BITS) -> DataFrame:
    """``df`` in ``order`` with ``_row`` (ascending, unique) and ``_seg``; checkpointed, so that both stay as they are."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id())
    return cut_lineage(rows).withColumn("_seg", F.shiftright("_row", bits))


def change_points(columns: list[pa.Array | pa.ChunkedArray]) -> np.ndarray:
    """Where the rows of a table begin to have other values in the columns (nulls are equal)."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        c = pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) and c.num_chunks != 1 else c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
        code = np.asarray(pc.dictionary_encode(c, null_encoding="encode").indices)
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def whole_keys(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """The stream in tables that end where a key does, and where each key begins in them."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        at = change_points([b[k] for k in keys])
        if held and all(held[-1][k][-1].as_py() == b[k][0].as_py() for k in keys):
            at = at[1:]
        if not len(at):
            held.append(b)
            continue
        t = pa.Table.from_batches([*held, b.slice(0, int(at[-1]))])
        if t.num_rows:
            yield t, change_points([t[k] for k in keys])
        held = [b.slice(int(at[-1]))]
    if held:
        t = pa.Table.from_batches(held)
        yield t, change_points([t[k] for k in keys])


def last_of_chain(hop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pointers that go forward (``len(hop)``: out of the segment): the last place before the way out, and the
    number of places on the way, by pointer doubling."""
    n = len(hop)
    at = np.append(np.where(hop < n, hop, np.arange(n)), n).astype(np.int64)
    steps = np.append((hop < n).astype(np.int64), 0)
    while True:
        further = at[at]
        if (further == at).all():
            return at[:n], steps[:n] + 1
        steps = steps + np.where(further != at, steps[at], 0)
        at = further


def mark_chains(hop: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places reached from ``starts`` (one chain each) before ``ends``; all chains take a step at a time."""
    seen = np.zeros(len(hop), bool)
    while True:
        inside = starts < ends
        starts, ends = starts[inside], ends[inside]
        if not len(starts):
            return seen
        seen[starts] = True
        starts = hop[starts]


def _with_states(rows: DataFrame, keys: list[str], value: str, states: DataFrame, mark: Callable[[pa.Table, np.ndarray, dict], dict[str, pa.Array]],
                 added: list[T.StructField]) -> DataFrame:
    """Every segment's rows with the columns that ``mark`` makes from (rows, where the runs begin, {run: state})."""
    def run(t: pa.Table, s: pa.Table) -> pa.Table:
        t = t.sort_by("_row")
        at = change_points([t[k] for k in keys]) if t.num_rows else np.empty(0, np.int64)
        known = {tuple(r[k] for k in keys): r for r in s.to_pylist()}
        firsts = t.select(keys).take(pa.array(at)).to_pylist()
        state = {i: known[tuple(f[k] for k in keys)] for i, f in enumerate(firsts) if tuple(f[k] for k in keys) in known}
        for name, col in mark(t, at, state).items():
            t = t.append_column(name, col)
        return t

    fields = [*rows.schema.fields, *added]
    return rows.groupBy("_seg").cogroup(states.groupBy("_seg")).applyInArrow(run, T.StructType(fields))


def _edge_runs(at: np.ndarray) -> list[int]:
    """Only the first and the last run of a segment can be parts of a key that goes on beyond it."""
    return sorted({0, len(at) - 1}) if len(at) else []


# ---------------------------------------------------------------- greedy packing
def _next_starts(size: np.ndarray, limit: int) -> np.ndarray:
    """For a block that begins at each row of one key: where the next one begins (the number of rows: not here)."""
    total = np.concatenate([[0], np.cumsum(size)])
    n = len(size)
    return np.minimum(np.maximum(np.arange(1, n + 1), np.searchsorted(total, total[:-1] + limit, "right") - 1), n)


def _first_start(size: np.ndarray, limit: int, state: np.ndarray) -> np.ndarray:
    """The row that doesn't fit a block of ``state`` characters that is open already (over the limit: the first one)."""
    j = np.searchsorted(np.cumsum(size), limit - state, "right")
    return np.where(state > limit, 0, j)


def pack_rows(df: DataFrame, keys: list[str], order: list[str], size: str, limit: int, *, bits: int = BITS) -> DataFrame:
    """Number the greedy blocks (``block_no`` from 0) of each key's rows in ``order``: a block takes rows while their sizes come to at
    most ``limit``; a larger row has a block of its own, and if it is a key's first row, block 0 stays empty.

    Sizes are not negative; a null one counts as 0. Rows of one key that are equal in ``order`` come in any order.
    """
    rows = in_segments(df.select(*keys, *[c for c in order if c not in keys], F.coalesce(F.col(size), F.lit(0)).cast("long").alias("_size")), [*keys, *order], bits)
    kinds = [rows.schema[k] for k in keys]
    small, large = T.ArrayType(T.IntegerType()), T.ArrayType(T.LongType())

    def transfer(t: pa.Table) -> pa.Table:
        t = t.sort_by("_row")
        at = change_points([t[k] for k in keys])
        sizes = np.asarray(t["_size"])
        out = []
        for i in _edge_runs(at):
            own = sizes[at[i]:at[i + 1]] if i + 1 < len(at) else sizes[at[i]:]
            last, count = last_of_chain(_next_starts(own, limit))
            state = np.arange(limit + 2)
            first = _first_start(own, limit, state)
            inside = first < len(own)
            begin = np.where(inside, first, 0)
            tail = np.concatenate([[0], np.cumsum(own)])
            left = np.where(inside, tail[-1] - tail[last[begin]], state + tail[-1])
            out.append({**{k: t[k][int(at[i])].as_py() for k in keys}, "_seg": t["_seg"][0].as_py(),
                        "left": np.minimum(left, limit + 1).astype(np.int32), "blocks": np.where(inside, count[begin], 0)})
        schema = pa.schema([*(t.schema.field(k) for k in keys), ("_seg", pa.int64()), ("left", pa.list_(pa.int32())), ("blocks", pa.list_(pa.int64()))])
        return pa.Table.from_pylist(out, schema=schema)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in whole_keys(batches, keys):
            state, block = np.zeros(t.num_rows, np.int64), np.zeros(t.num_rows, np.int64)
            n = np.diff(np.append(at, t.num_rows))
            for a, k in zip(at[n > 1].tolist(), n[n > 1].tolist()):
                s = b = 0
                for i in range(a, a + k):
                    state[i], block[i] = s, b
                    b += t["blocks"][i][s].as_py()
                    s = t["left"][i][s].as_py()
            yield from pa.table([*(t[k] for k in keys), t["_seg"], pa.array(state), pa.array(block)], names=[*keys, "_seg", "state", "block"]).to_batches()

    def mark(t: pa.Table, at: np.ndarray, state: dict) -> dict[str, pa.Array]:
        sizes = np.asarray(t["_size"])
        ends = np.append(at[1:], len(sizes))
        hop, first, base = np.empty(len(sizes), np.int64), np.empty(len(at), np.int64), np.zeros(len(at), np.int64)
        for i, (a, z) in enumerate(zip(at.tolist(), ends.tolist())):
            hop[a:z] = a + _next_starts(sizes[a:z], limit)
            s = state.get(i)
            base[i] = s["block"] if s else 0
            first[i] = a + _first_start(sizes[a:z], limit, np.array([s["state"] if s else 0]))[0]
        begins = np.cumsum(mark_chains(hop, first, ends))
        before = np.where(at > 0, begins[at - 1], 0)
        return {"block_no": pa.array(begins + np.repeat(base - before, ends - at), pa.int64())}

    edges = rows.groupBy("_seg").applyInArrow(transfer, T.StructType([*kinds, T.StructField("_seg", T.LongType()), T.StructField("left", small), T.StructField("blocks", large)]))
    taken = edges.repartition(*keys).sortWithinPartitions(*keys, "_seg").mapInArrow(
        fold, T.StructType([*kinds, *(T.StructField(c, T.LongType()) for c in ("_seg", "state", "block"))]))
    return _with_states(rows, keys, "_size", taken, mark, [T.StructField("block_no", T.LongType())]).drop("_row", "_seg", "_size")


# ---------------------------------------------------------------- one row per time to live
def _successors(t: np.ndarray, at: np.ndarray, ends: np.ndarray, ttl: int) -> np.ndarray:
    """For every row the first one of its run at least ``ttl`` later (the run's end: none). ``t`` ascends within runs."""
    out = np.empty(len(t), np.int64)
    for a, z in zip(at.tolist(), ends.tolist()):
        out[a:z] = a + np.searchsorted(t[a:z], t[a:z] + ttl, "left") if z - a > 1 else z
    return out


def _micros(col: pa.ChunkedArray) -> np.ndarray:
    return np.asarray(col.cast(pa.int64()).combine_chunks())


def keep_within_ttl(df: DataFrame, keys: list[str], ts: str, ttl_seconds: int, tiebreak: list[str], *, bits: int = BITS) -> DataFrame:
    """The rows that are at least the time to live after the row of their key kept before, from its first row on.

    Rows without a time are kept and start no time to live. A segment's answer to "the key's last kept row was at time x" is a step
    function of x, told at the rows of its first time to live only (later ones can't be the first to be kept), steps of one answer joined.
    """
    ttl = int(ttl_seconds) * 1_000_000
    timed = in_segments(df.where(F.col(ts).isNotNull()), [*keys, ts, *tiebreak], bits)
    kinds = [timed.schema[k] for k in keys]
    longs = T.ArrayType(T.LongType())

    def transfer(t: pa.Table) -> pa.Table:
        t = t.sort_by("_row")
        at = change_points([t[k] for k in keys])
        times = _micros(t[ts])
        out = []
        for i in _edge_runs(at):
            own = times[at[i]:at[i + 1]] if i + 1 < len(at) else times[at[i]:]
            last, _ = last_of_chain(_successors(own, np.array([0]), np.array([len(own)]), ttl))
            entry = own[:int(np.searchsorted(own, own[0] + ttl, "left")) + 1]
            kept = own[last[:len(entry)]]
            step = np.append(kept[1:] != kept[:-1], True)              # of rows with one answer the last
            out.append({**{k: t[k][int(at[i])].as_py() for k in keys}, "_seg": t["_seg"][0].as_py(), "entry": entry[step], "kept": kept[step]})
        schema = pa.schema([*(t.schema.field(k) for k in keys), ("_seg", pa.int64()), ("entry", pa.list_(pa.int64())), ("kept", pa.list_(pa.int64()))])
        return pa.Table.from_pylist(out, schema=schema)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in whole_keys(batches, keys):
            since: list[int | None] = [None] * t.num_rows
            n = np.diff(np.append(at, t.num_rows))
            for a, k in zip(at[n > 1].tolist(), n[n > 1].tolist()):
                last: int | None = None
                for i in range(a, a + k):
                    since[i] = last
                    entry, kept = (np.asarray(t[c][i].values) for c in ("entry", "kept"))
                    j = 0 if last is None else int(np.searchsorted(entry, last + ttl, "left"))
                    last = int(kept[j]) if j < len(entry) else last
            yield from pa.table([*(t[k] for k in keys), t["_seg"], pa.array(since, pa.int64())], names=[*keys, "_seg", "last"]).to_batches()

    def mark(t: pa.Table, at: np.ndarray, state: dict) -> dict[str, pa.Array]:
        times = _micros(t[ts])
        ends = np.append(at[1:], len(times))
        first = at.copy()
        for i, s in state.items():
            if s["last"] is not None:
                first[i] = at[i] + np.searchsorted(times[at[i]:ends[i]], s["last"] + ttl, "left")
        return {"_keep": pa.array(mark_chains(_successors(times, at, ends, ttl), first, ends))}

    edges = timed.groupBy("_seg").applyInArrow(transfer, T.StructType([*kinds, T.StructField("_seg", T.LongType()), T.StructField("entry", longs), T.StructField("kept", longs)]))
    taken = edges.repartition(*keys).sortWithinPartitions(*keys, "_seg").mapInArrow(
        fold, T.StructType([*kinds, T.StructField("_seg", T.LongType()), T.StructField("last", T.LongType())]))
    marked = _with_states(timed, keys, ts, taken, mark, [T.StructField("_keep", T.BooleanType())])
    return marked.where("_keep").select(*df.columns).unionByName(df.where(F.col(ts).isNull()))

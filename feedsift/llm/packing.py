"""Packing by concatenation: two-pass prefix sums, then fixed windows.

Pass one tokenises each document once and writes its ids with their place in
the task's run; the totals by task, summed over the tasks, give every run its
global offset. Pass two reads the ids back and cuts them at multiples of the
window: sequence ``s`` holds the global places ``s * width`` to ``(s + 1) * width - 1``.
Only the last sequence can be shorter; no id is lost or repeated.

``sequences`` gives the whole sequences: one that lies within a task's run is made
there, and only the boundary records at the ends of the runs are shuffled.

Null and empty texts still have their end id. Repeated rows and repeated doc_ids
are documents of their own; a null doc_id stays null. An empty table gives no pieces.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, texts_of
from .tokens import starts, task_id, token_runs

RUNS = "task long, local long, doc_id long, n_tokens long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def token_table(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Every document's ids (unsigned 16- or 32-bit, by their largest), written once, with its place in its task's run."""

    def runs(batches):
        place = 0
        for doc, ids, at in token_runs(batches, tokenizer, end_id):
            kind = "<u2" if not len(ids) or ids.max() < 1 << 16 else "<u4"
            raw = memoryview(ids.astype(kind).tobytes())
            size = np.dtype(kind).itemsize
            a = at.tolist()
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(doc), task_id())), pa.array(at[:-1] + place), doc, pa.array(np.diff(at)),
                pa.array([raw[x * size:y * size] for x, y in zip(a, a[1:])], pa.binary())], names=["task", "local", "doc_id", "n_tokens", "ids"])
            place += a[-1]

    return staged(texts_of(docs).mapInArrow(runs, RUNS), "tokens")


def _bases(tokens: DataFrame) -> DataFrame:
    """Global place of the first id of each task's run; one row a task."""
    totals = tokens.groupBy("task").agg(F.sum("n_tokens").alias("n"))
    return starts(totals, ["task", "task"], "n", "base").select("task", "base")


def pieces(tokens: DataFrame, width: int = 1024, with_ids: bool = False) -> DataFrame:
    """Cut the concatenated runs into windows; one row per piece. ``ids`` is null unless asked for."""
    def cut(batches):
        for r in (r for b in batches for i in range(0, b.num_rows, 256) for r in b.slice(i, 256).to_pylist()):
            n, raw = r["n_tokens"], r["ids"]
            ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4")
            g = r["base"] + r["local"]
            edge = np.arange(g // width + 1, -(-(g + n) // width)) * width - g
            at = [0, *edge.tolist(), n]
            m = len(at) - 1
            first = np.array(at[:-1])
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array([r["doc_id"]] * m, pa.int64()), "start": first, "length": np.diff(at),
                "ids_crc32": pa.array([zlib.crc32(ids[x:y].data) for x, y in zip(at, at[1:])], pa.int64()), "doc_tokens": np.full(m, n),
                "sequence_id": (g + first) // width, "offset": (g + first) % width,
                "ids": pa.array([ids[x:y].tobytes() if with_ids else None for x, y in zip(at, at[1:])], pa.binary())})

    def joined(batches):                     # a record batch per document is small; hand them on in larger ones
        held, rows = [], 0
        for x in cut(batches):
            held.append(x)
            rows += x.num_rows
            if rows >= 20_000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, rows = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return tokens.join(F.broadcast(_bases(tokens)), "task").mapInArrow(joined, PIECES)       # one row a task is broadcast


def pack(docs: DataFrame, tokenizer: str, width: int = 1024, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    return pieces(token_table(docs, tokenizer, end_id), width, with_ids)


def sequences(tokens: DataFrame, width: int = 1024) -> DataFrame:
    """sequence_id and the ids (unsigned 32-bit little-endian) of every whole sequence.

    A task hands on each sequence that it holds in full; of the others it makes boundary records
    (sequence_id, offset, ids), which alone are shuffled and joined in order of their offset.
    """
    def runs(batches):
        held: list[np.ndarray] = []
        first = size = 0

        def out(final: bool):
            nonlocal held, first, size
            ids = np.concatenate(held) if held else np.empty(0, "<u4")
            stop = first + size if final else (first + size) // width * width
            cuts = [x for x in [first, *range((first // width + 1) * width, stop, width), stop] if x <= stop] if stop > first else [first]
            spans = list(zip(cuts, cuts[1:]))
            held, first, size = ([ids[stop - first:]], stop, first + size - stop) if stop > first else (held, first, size)
            base = cuts[0]
            return pa.RecordBatch.from_pydict({
                "sequence_id": pa.array([a // width for a, _ in spans], pa.int64()), "offset": pa.array([a % width for a, _ in spans], pa.int64()),
                "whole": pa.array([z - a == width for a, z in spans], pa.bool_()),
                "ids": pa.array([ids[a - base:z - base].astype("<u4").tobytes() for a, z in spans], pa.binary())})

        for b in batches:
            for g, n, raw in zip(*(b.column(c).to_pylist() for c in ("g", "n_tokens", "ids"))):
                if held and g != first + size:
                    yield out(True)
                    held, size = [], 0
                if not held:
                    first = g
                held.append(np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4"))
                size += n
                if size >= 64 * width:
                    yield out(False)
        if size:
            yield out(True)

    placed = tokens.join(F.broadcast(_bases(tokens)), "task").select((F.col("base") + F.col("local")).alias("g"), "n_tokens", "ids")
    made = staged(placed.mapInArrow(runs, "sequence_id long, offset long, whole boolean, ids binary"), "sequences")
    rest = made.where("not whole").groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    joined = F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return made.where("whole").select("sequence_id", "ids").unionByName(rest.select("sequence_id", joined.alias("ids")))

"""Repair of conversations whose turns don't alternate, by the cheapest and then least audit.

A conversation is right if the initials of its roles read ``(s?(ua)+)?``. Four edits make it so: Keep (0), Rerole
to user or assistant (3), Delete (4; the only way with a blank or repeated row) and Insert of an empty user or assistant
row (3); a truncated row that stays costs 3 more. The audit is the string of the edits' initials; of all
cheapest ones the least in ASCII order counts.

After the cost table, the nodes (row, state) are ranked by prefix doubling: the first letter of a node's least
optimal arc ranks it for length 1, and the pair (its rank, the rank of the node 2^k letters on) for length 2^(k+1), with
the pointer doubled. A state and a letter fix the next state, so a node has one optimal arc for its least letter and its
pointer is the least path's. Equal final ranks are equal audits, so that each distinct audit is spelled once, through
the doubled pointers.

Rows are ordered by (conversation, turn, role, digest of the text) with a range partitioning, and cut into segments of at most
``SEGMENT`` rows, whatever conversation they belong to. A segment's min-plus matrix (cost from each state at its start to
each at its end) is all that others need of it: a pass from the last segment of a conversation backwards gives each
segment the costs at its end; the segments then rank their paths from every state they may be entered in, and a pass
forwards picks the one taken. So a conversation of any length is spread over tasks; only SHA-256 reads its
rows in order, as a stream.

Nulls: a null role or text counts as one space, so the row is blank or has an initial of no use; null turns come first and
don't count for gaps; a null conversation id is an id like any other. Rows of one turn are ordered by role and
digest of the text; repeated rows count one by one, the second being a duplicate. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import staged

SEGMENT_BITS = 13
SPACE = " \t\n\x0b\x0c\r"
LETTERS = "DIKR"
DELETE, EDIT, FAR = 4, 3, 1 << 40

#: States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant. Roles: 0 system, 1 user, 2 assistant, 3 any other.
KEEP = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
PUT = np.array([2, 2, 3, 2])                     # the state after an inserted or reroled row
LAST = np.array([0, 6, 3, 0])                    # what is still to pay after the last row
_ROLE = {"s": 0, "u": 1, "a": 2}
_LEGAL = np.zeros((4, 4), bool)
_LEGAL[[0, 1, 2], [1, 2, 1]] = True
OK, BLANK, DUPLICATE, TRUNCATED = range(4)


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, again) after faults dealt by the crc32 of ``conv_id:turn`` modulo 20."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    d = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"),
                             (F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn")).cast("binary")) % 20).alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return d.where("fault <> 0").select(
        "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("again"))


def _rows(rows: DataFrame, order_col: str | None) -> DataFrame:
    """The rows with nulls as one space and the digest that orders rows of one turn."""
    again = F.col(order_col) if order_col else F.lit(0)
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
                       F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), again.cast("int").alias("again")
                       ).withColumn("digest", F.unhex(F.sha2("text", 256)))


_ORDER = ("conv_id", "turn", "role", "digest", "again")


def _coded(rows: DataFrame, segment_bits: int) -> DataFrame:
    """(seg, row_id, conv_id, turn, code) of all rows in order; code: 4 * first fault + role."""
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    first = F.substring("role", 1, 1)
    role = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    light = rows.select(*_ORDER, role.alias("kind"), (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut"))
    light = staged(light.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER).withColumn("row_id", F.monotonically_increasing_id()), "turns")
    firsts = light.where("not blank").groupBy("conv_id", "role", "digest").agg(F.min("row_id").alias("row_id"))
    got = light.select("row_id", "conv_id", "turn", "kind", "blank", "cut").join(firsts.select("row_id", F.lit(True).alias("first")), "row_id", "left")
    fault = F.when(F.col("blank"), BLANK).when(F.col("first").isNull(), DUPLICATE).when(F.col("cut"), TRUNCATED).otherwise(OK)
    got = got.select(F.shiftright("row_id", segment_bits).alias("seg"), "row_id", "conv_id", "turn", (4 * fault + F.col("kind")).alias("code"))
    return staged(got, "coded")


def _codes(col: pa.ChunkedArray) -> np.ndarray:
    """A number for each distinct value, null included."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    col = pa.concat_arrays(col.chunks) if isinstance(col, pa.ChunkedArray) else col
    return np.asarray(pc.dictionary_encode(col, null_encoding="encode").indices)


def _starts(codes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(codes[1:] != codes[:-1]) + 1]) if len(codes) else np.empty(0, np.int64)


class Runs:
    """A segment's rows, cut into the runs of its conversations, and the cost table of their nodes."""

    def __init__(self, t: pa.Table):
        t = t.take(np.argsort(np.asarray(t["row_id"]), kind="stable"))
        self.table = t
        code = np.asarray(t["code"]).astype(np.int64)
        self.role, self.fault = code & 3, code >> 2
        self.at = _starts(_codes(t["conv_id"]))
        self.n = np.diff(np.append(self.at, len(code)))
        self.base = 4 * (self.at + np.arange(len(self.at)))       # a run of n rows has n + 1 rows of four nodes

    def ids(self) -> pa.Array:
        return self.table["conv_id"].take(self.at).combine_chunks()

    def costs(self, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cost to go of every node (a column per way to end), its least optimal letter, and where that leads."""
        width = end.shape[-1]
        cost = np.zeros((4 * (len(self.role) + len(self.n)), width), np.int64)
        letter = np.full(len(cost), -1, np.int8)
        to = np.arange(len(cost))
        four = np.arange(4)
        last = self.base + 4 * self.n
        cost[last[:, None] + four] = end
        by_length = np.argsort(-self.n, kind="stable")
        active = len(by_length)
        for d in range(1, int(self.n.max(initial=0)) + 1):
            while self.n[by_length[active - 1]] < d:
                active -= 1
            r = by_length[:active]
            row = (self.at + self.n)[r] - d
            node = (last[r] - 4 * d)[:, None] + four
            after = cost[node + 4]
            fault = self.fault[row][:, None, None]
            stays = (fault == OK) | (fault == TRUNCATED)
            extra = np.where(fault == TRUNCATED, EDIT, 0)
            goal = KEEP[:, self.role[row]].T
            kept = np.take_along_axis(after, np.maximum(goal, 0)[:, :, None], 1) + extra
            ways = {
                "D": after + DELETE,
                "K": np.where(stays & (goal >= 0)[:, :, None], kept, FAR),
                "R": np.where(stays, after[:, PUT] + EDIT + extra, FAR),
            }
            here = np.minimum(np.minimum(ways["D"], ways["K"]), ways["R"])
            best = np.minimum(np.minimum(here, here[:, PUT] + EDIT), here[:, PUT[PUT]] + 2 * EDIT)
            cost[node] = best
            if width == 1:
                ways["I"] = best[:, PUT] + EDIT
                ends = {"D": node + 4, "I": node[:, PUT], "K": node[:, :1] + 4 + goal, "R": node[:, :1] + 4 + PUT}
                for x in reversed(LETTERS):                     # the least letter is set last
                    hit = ways[x][:, :, 0] == best[:, :, 0]
                    letter[node[hit]] = LETTERS.index(x)
                    to[node[hit]] = ends[x][hit]
        return cost, letter, to

    def matrix(self) -> np.ndarray:
        """Least cost from each state before a run to each state after it (inserts after its last row belong to what follows)."""
        cost, _, _ = self.costs(np.where(np.eye(4, dtype=bool), 0, FAR)[None])
        return np.minimum(cost[self.base[:, None] + np.arange(4)].reshape(-1, 16), FAR)


def rank_paths(letter: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Prefix doubling over nodes with one arc each (letter -1: none, the path ends): final ranks in the order of the
    audits, the pointers for 1, 2, 4, ... letters, and the audits' lengths."""
    rank = letter.astype(np.int64) + 1
    n = (letter >= 0).astype(np.int64)
    hops = [np.where(letter >= 0, to, np.arange(len(to)))]
    while (letter[hops[-1]] >= 0).any():
        hop = hops[-1]
        rank = np.unique(rank * (int(rank.max(initial=0)) + 1) + rank[hop], return_inverse=True)[1]
        n = n + n[hop]
        hops.append(hop[hop])
    return rank, hops, n


def spell(starts: np.ndarray, letter: np.ndarray, ranking: tuple[np.ndarray, list[np.ndarray], np.ndarray]) -> tuple[pa.Array, np.ndarray]:
    """The audit of each start node and the node where it ends; audits of one rank are spelled once."""
    rank, hops, n = ranking
    _, first, same = np.unique(rank[starts], return_index=True, return_inverse=True)
    chosen = starts[first]
    stop = np.cumsum(n[chosen])
    step = np.arange(stop[-1] if len(stop) else 0) - np.repeat(stop - n[chosen], n[chosen])
    node = np.repeat(chosen, n[chosen])
    for k, hop in enumerate(hops):
        node = np.where(step >> k & 1, hop[node], node)
    body = np.frombuffer(LETTERS.encode(), np.uint8)[letter[node]]
    off = np.concatenate([[0], stop]).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(chosen), pa.py_buffer(off), pa.py_buffer(body.tobytes()))
    ends = starts
    for k, hop in enumerate(hops):
        ends = np.where(n[starts] >> k & 1, hop[ends], ends)
    return words.take(pa.array(same)).cast(pa.string()), ends


def _matrices(t: pa.Table) -> pa.Table:
    runs = Runs(t)
    m = pa.array(list(runs.matrix()), pa.list_(pa.int64()))
    return pa.table({"conv_id": runs.ids(), "seg": t["seg"].take(runs.at), "m": m})


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """The stream in tables that end where a conversation does, and where each conversation starts in them."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        at = _starts(_codes(b["conv_id"]))
        if held and held[-1]["conv_id"][-1].as_py() == b["conv_id"][0].as_py():
            at = at[1:]
        if not len(at):
            held.append(b)
            continue
        t = pa.Table.from_batches([*held, b.slice(0, int(at[-1]))])
        if t.num_rows:
            yield t, _starts(_codes(t["conv_id"]))
        held = [b.slice(int(at[-1]))]
    if held:
        t = pa.Table.from_batches(held)
        yield t, _starts(_codes(t["conv_id"]))


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the segments of a conversation, last one first: the costs at the end, and whether it is the last or the first."""
    for t, at in _whole(batches):
        n = np.diff(np.append(at, t.num_rows))
        end = np.tile(LAST, (t.num_rows, 1))
        for a, k in zip(at[n > 1].tolist(), n[n > 1].tolist()):
            m = np.array(t["m"].slice(a, k).to_pylist(), np.int64).reshape(-1, 4, 4)
            for i in range(1, k):
                end[a + i] = np.min(m[i - 1] + end[a + i - 1], 1)
        is_last, is_first = np.zeros(t.num_rows, bool), np.zeros(t.num_rows, bool)
        is_last[at] = True
        is_first[at + n - 1] = True
        yield from pa.table({"conv_id": t["conv_id"], "seg": t["seg"], "end": pa.array(list(end), pa.list_(pa.int64())),
                             "is_last": pa.array(is_last), "is_first": pa.array(is_first)}).to_batches()


_PATHS = "seg long, rows long, blank long, duplicate long, truncated long, illegal long, head int, tail int, low long, high long, turns long, cost long, exits array<int>, audits array<string>"


def _paths(t: pa.Table, ends: pa.Table) -> pa.Table:
    """Per run: counts, and for every state it may be entered in the least audit and the state it leaves in."""
    runs = Runs(t)
    k = len(runs.at)
    key = {c: i for i, c in enumerate(ends["conv_id"].to_pylist())}
    order = pa.array([key[c] for c in runs.ids().to_pylist()], pa.int64())
    ends = ends.take(order)
    cost, letter, to = runs.costs(np.array(ends["end"].to_pylist(), np.int64).reshape(k, 4, 1))
    last = runs.base + 4 * runs.n
    done = np.asarray(ends["is_last"].combine_chunks().to_numpy(zero_copy_only=False))
    for s in (1, 2):                                             # what is still to be inserted after the last row
        letter[last[done] + s] = LETTERS.index("I")
        to[last[done] + s] = last[done] + PUT[s]
    first = np.asarray(ends["is_first"].combine_chunks().to_numpy(zero_copy_only=False))
    width = np.where(first, 1, 4)                                # a conversation begins in state 0
    owner = np.repeat(np.arange(k), width)
    state = np.arange(len(owner)) - np.repeat(np.cumsum(width) - width, width)
    audits, at = spell(runs.base[owner] + state, letter, rank_paths(letter, to))
    off = pa.array(np.concatenate([[0], np.cumsum(width)]), pa.int32())
    exits = pa.ListArray.from_arrays(off, pa.array((at & 3).astype(np.int32)))

    def per_run(x: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(x)])
        return total[runs.at + runs.n] - total[runs.at]

    n = len(runs.role)
    wrong = np.zeros(n, bool)
    wrong[1:] = ~_LEGAL[runs.role[:-1], runs.role[1:]]
    wrong[runs.at] = False
    turn = runs.table["turn"].combine_chunks()
    known = np.asarray(turn.is_valid())
    value = np.asarray(turn.fill_null(0))
    new = known.copy()
    new[1:] &= ~(known[:-1] & (value[1:] == value[:-1]))
    new[runs.at] = known[runs.at]
    some = per_run(known) > 0                                    # null turns come first, so the least known one is at:
    low = np.where(some, value[np.minimum(runs.at + runs.n - per_run(known), n - 1)], 0)
    high = np.where(some, value[runs.at + runs.n - 1], 0)
    return pa.table({
        "conv_id": runs.ids(), "seg": runs.table["seg"].take(runs.at), "rows": runs.n, **{
            name: per_run(runs.fault == f) for name, f in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", TRUNCATED))},
        "illegal": per_run(wrong), "head": pa.array(runs.role[runs.at], pa.int32()), "tail": pa.array(runs.role[runs.at + runs.n - 1], pa.int32()),
        "low": pa.array(low, mask=~some), "high": pa.array(high, mask=~some), "turns": per_run(new),
        "cost": cost[runs.base, 0], "exits": exits, "audits": pa.ListArray.from_arrays(off, audits)})


_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A conversation's segments, first one first, put together along the states in which they are left."""
    for t, at in _whole(batches):
        n = np.diff(np.append(at, t.num_rows))
        one = t.take(at)
        out = {c: np.asarray(one[c]).copy() for c in ("blank", "duplicate", "truncated", "illegal", "turns")}
        high = one["high"].to_pylist()
        low = one["low"].to_pylist()
        audit = pc.list_element(one["audits"], 0).to_pylist()
        for i in np.flatnonzero(n > 1).tolist():
            segs = t.slice(int(at[i]), int(n[i])).to_pylist()
            state, words = 0, []
            for s in segs:
                words.append(s["audits"][state])
                state = s["exits"][state]
            audit[i] = "".join(words)
            for c in out:
                out[c][i] = sum(s[c] for s in segs)
            out["illegal"][i] += sum(not _LEGAL[a["tail"], b["head"]] for a, b in zip(segs, segs[1:]))
            out["turns"][i] -= sum(a["high"] is not None and a["high"] == b["low"] for a, b in zip(segs, segs[1:]))
            low[i] = next((s["low"] for s in segs if s["low"] is not None), None)
            high[i] = segs[-1]["high"]
        gaps = [0 if a is None else z - a + 1 - k for a, z, k in zip(low, high, out.pop("turns").tolist())]
        yield from pa.table({"conv_id": one["conv_id"], "gaps": pa.array(gaps, pa.int64()), **out, "cost": one["cost"],
                             "audit": pa.array(audit, pa.string())}).to_batches()


def audits(rows: DataFrame, order_col: str | None = None, segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """Per conversation that has rows: gaps, faults, illegal pairs, least cost and its least audit.
    Rows that are equal but for ``order_col`` are ordered by it."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    coded = _coded(_rows(rows, order_col), segment_bits)
    m = coded.groupBy("seg").applyInArrow(_matrices, f"conv_id {kind}, seg long, m array<bigint>")
    ends = m.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("seg")).mapInArrow(
        _ends, f"conv_id {kind}, seg long, end array<bigint>, is_last boolean, is_first boolean")
    paths = coded.groupBy("seg").cogroup(ends.groupBy("seg")).applyInArrow(_paths, f"conv_id {kind}, {_PATHS}")
    return paths.repartition("conv_id").sortWithinPartitions("conv_id", "seg").mapInArrow(_taken, f"conv_id {kind}, {_RESULT}")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Per row of the repaired conversations (conv_id, edit, turn, role, text); a conversation begins with (its header,)."""
    state, audit, i = 0, "", 0
    conv = None

    def rest():
        nonlocal state, i
        while i < len(audit) and audit[i] == "I":
            state = int(PUT[state])
            i += 1
            yield conv, "I", None, ("user", "assistant")[state - 2], ""

    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in ("conv_id", "head", "turn", "role", "text"))):
            if row[1] is not None:
                yield from rest()
                conv, audit = row[0], row[1]["audit"]
                state, i = 0, 0
                yield (row[1],)
                continue
            yield from rest()
            edit, (_, _, turn, role, text) = audit[i], row
            i += 1
            if edit == "K":
                state = int(KEEP[state, _ROLE.get(role[:1], 3)])
            elif edit == "R":
                state = int(PUT[state])
                role = ("user", "assistant")[state - 2]
            if edit != "D":
                yield conv, edit, turn, role, text
    yield from rest()


def _in_order(rows: DataFrame, found: DataFrame, order_col: str | None) -> DataFrame:
    """Each conversation's header followed by its rows, in one stream."""
    plain = _rows(rows, order_col)
    head = F.struct(*found.columns)
    headers = found.select("conv_id", head.alias("head"), *(F.lit(None).cast(plain.schema[c].dataType).alias(c) for c in (*_ORDER[1:], "text")))
    body = plain.select("conv_id", F.lit(None).cast(headers.schema["head"].dataType).alias("head"), *_ORDER[1:], "text")
    return headers.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", F.col("head").isNull(), *_ORDER[1:])


def repaired_rows(rows: DataFrame, order_col: str | None = None) -> DataFrame:
    """The repaired conversations: conv_id, position (from 0), edit (I, K or R), turn, role, text."""
    returns = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, position long, edit string, turn long, role string, text string"
    schema = _arrow(rows, returns)

    def run(batches):
        out, position = [], 0
        for b in _edited(batches):
            if len(b) == 1:
                position = 0
                continue
            out.append({"conv_id": b[0], "position": position, "edit": b[1], "turn": b[2], "role": b[3], "text": b[4]})
            position += 1
            if len(out) == 4096:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema=schema)

    return _in_order(rows, audits(rows, order_col), order_col).mapInArrow(run, returns)


def _arrow(rows: DataFrame, returns: str) -> pa.Schema:
    """The Arrow schema of ``returns``, whose first column is the conversation id."""
    kinds = {"long": pa.int64(), "string": pa.string()}
    rest = [c.split() for c in returns.split(", ")[1:]]
    return pa.schema([("conv_id", to_arrow_type(rows.schema["conv_id"].dataType)), *((name, kinds[k]) for name, k in rest)])


def repair(rows: DataFrame, order_col: str | None = None, segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """``audits`` with the SHA-256 of each repaired conversation's ``role:text`` lines."""
    found = audits(rows, order_col, segment_bits)
    returns = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {_RESULT}"
    schema = _arrow(rows, returns)

    def run(batches):
        heads, digests = [], []
        for b in _edited(batches):
            if len(b) == 1:
                heads.append(b[0])
                digests.append(None)
                if len(heads) > 4096:
                    yield flush(heads[:-1], digests[:-1])
                    heads, digests = heads[-1:], digests[-1:]
                continue
            if digests[-1] is None:
                digests[-1] = hashlib.sha256()
            else:
                digests[-1].update(b"\n")
            digests[-1].update(f"{b[3]}:{b[4]}".encode())
        yield flush(heads, digests)

    def flush(heads, digests):
        t = pa.RecordBatch.from_pylist(heads, schema=schema)
        return t.append_column("repaired_sha256", pa.array([(d or hashlib.sha256()).hexdigest() for d in digests], pa.string()))

    return _in_order(rows, found, order_col).mapInArrow(run, f"{returns}, repaired_sha256 string")


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """Every conversation id of ``conversations`` with the repair of its damaged rows (zeros if none is left)."""
    got = repair(damaged(conversations), "again")
    ids = conversations.select(F.col("conv_id").alias("__id")).distinct()
    zero = {c: (F.lit("") if c == "audit" else F.sha2(F.lit(""), 256) if c == "repaired_sha256" else F.lit(0).cast("long")) for c in got.columns[1:]}
    return ids.join(got, F.col("__id").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("__id").alias("conv_id"), *(F.coalesce(F.col(c), z).alias(c) for c, z in zero.items()))

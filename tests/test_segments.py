"""Work over sorted segments against row-by-row versions: greedy packing, journal blocks, time to live."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedsift.operators import chunking as CH
from feedsift.operators import dedup as D
from feedsift.operators import segments as SG
from feedsift.sinks import records as R


def _pack(sizes, limit):
    block, size, out = 0, 0, []
    for s in sizes:
        if size + s <= limit:
            size += s
        else:
            block, size = block + 1, s
        out.append(block)
    return out


@pytest.mark.parametrize("bits", [0, 2, 5])
def test_pack_rows_matches_a_loop(spark, bits):
    rnd = random.Random(bits)
    sizes = {k: [rnd.choice([0, 0, 1, 5, 9, 20, 21, 40]) for _ in range(rnd.randrange(1, 60))] for k in [None, *range(25)]}
    sizes[99] = [rnd.choice([0, 3, 7, 25]) for _ in range(900)]              # a third of the rows and more
    rows = [(k, i, s) for k, v in sizes.items() for i, s in enumerate(v)]
    df = spark.createDataFrame(rows, "k int, i int, n int").repartition(5)
    got = {}
    for r in SG.pack_rows(df, ["k"], ["i"], "n", 20, bits=bits).collect():
        got.setdefault(r.k, []).append((r.i, r.block_no))
    assert {k: [b for _, b in sorted(v)] for k, v in got.items()} == {k: _pack(v, 20) for k, v in sizes.items()}


def test_a_hot_key_is_spread_over_segments(spark):
    df = spark.range(3000).select(F.lit(1).alias("k"), F.col("id").cast("int").alias("i")).unionByName(
        spark.range(600).select(F.col("id").cast("int").alias("k"), F.lit(-1).alias("i")))
    sizes = [r["count"] for r in SG.in_segments(df, ["k", "i"], 6).groupBy("_seg").count().collect()]
    assert max(sizes) <= 64 and len(sizes) >= 3600 // 64


def test_chains():
    hop = np.array([2, 2, 4, 5, 7, 7, 7])
    last, count = SG.last_of_chain(hop)
    assert last.tolist() == [4, 4, 4, 5, 4, 5, 6] and count.tolist() == [3, 3, 2, 2, 1, 1, 1]
    assert SG.mark_chains(hop, np.array([0, 5]), np.array([5, 7])).tolist() == [True, False, True, False, True, True, False]


@pytest.mark.parametrize("bits", [1, 4])
def test_journal_blocks_equal_the_packed_day_text(spark, bits):
    rnd = random.Random(7)
    words = ["alpha", "be.ta", "gamma.", "...", ".", "delta epsilon", "x" * 45, ""]
    rows = []
    for i in range(150):
        day = dt.datetime(2024, 1, rnd.choice([2, 2, 2, 3, 5]), rnd.randrange(24), rnd.randrange(60))
        rows.append((i, rnd.choice(["T", "a.b", None]), rnd.choice([None, " ".join(rnd.choice(words) for _ in range(rnd.randrange(6)))]), day))
    rows += [(900 + i, "no stop", "here", dt.datetime(2024, 1, 6, i)) for i in range(20)] + [(999, "t", "c", None)]
    notes = spark.createDataFrame([(*r, "x", 1) for r in rows], "id long, title string, content string, created_time timestamp_ntz, line string, day int")
    got = {}
    for r in R.journal_blocks(notes, "2024-01-01", "2024-01-08", 40, bits=bits).collect():
        got.setdefault(r.day.day, []).append((r.block_no, r.block))
    texts = {d: "" for d in range(1, 9)}
    for i, title, content, at in sorted((r for r in rows if r[3]), key=lambda r: (r[3], r[0])):
        texts[at.day] += f"{title or ''} {content or ''}\n"
    assert {d: [b for _, b in sorted(v)] for d, v in got.items()} == {d: CH.pack_sentences_py(t, 40) for d, t in texts.items()}
    assert all([n for n, _ in sorted(v)] == list(range(len(v))) for v in got.values())
    lines = sorted((r.day.day, r.line_no, r.line) for r in R.journal_lines(notes, bits=bits).collect())
    assert {d: "".join(x for e, _, x in lines if e == d) for d in texts} == texts
    days = {r.day.day: (r.n_notes, r.n_chars) for r in R.journal_days(notes, "2024-01-01", "2024-01-08").collect()}
    assert days == {d: (sum(e == d for e, _, _ in lines), len(t)) for d, t in texts.items()}


def _kept(times, ttl):
    out, last = [], None
    for t in times:
        keep = last is None or t - last >= ttl
        out.append(keep)
        last = t if keep else last
    return out


@pytest.mark.parametrize("bits", [0, 3, 6])
def test_ttl_matches_a_loop(spark, bits):
    rnd = random.Random(bits)
    start = dt.datetime(2024, 1, 1)
    keys = {k: sorted(rnd.randrange(400) for _ in range(rnd.randrange(1, 40))) for k in range(20)}
    keys[50] = sorted(rnd.randrange(3000) for _ in range(700))                # dense, without a gap
    keys[51] = [5] * 60 + [14, 15, 15, 16, 400]                               # ties
    rows = [(k, f"v{k % 2}", start + dt.timedelta(seconds=s), i) for k, v in keys.items() for i, s in enumerate(v)]
    df = spark.createDataFrame(rows + [(50, "v0", None, -1), (50, "v0", None, -2)], "k int, v string, ts timestamp, arrival int").repartition(4)
    got = sorted((r.k, r.arrival) for r in SG.keep_within_ttl(df, ["k", "v"], "ts", 10, ["arrival"], bits=bits).collect())
    want = [(k, i) for k, v in keys.items() for i, keep in enumerate(_kept(v, 10)) if keep] + [(50, -1), (50, -2)]
    assert got == sorted(want)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "k int, i int, n int, ts timestamp")
    assert SG.pack_rows(df, ["k"], ["i"], "n", 5).count() == 0
    assert D.dedup_within_ttl(df, "k", "ts", 5).count() == 0
    notes = spark.createDataFrame([], "id long, title string, content string, created_time timestamp")
    assert [tuple(r) for r in R.journal_blocks(notes, "2024-01-01", "2024-01-01").select("block_no", "block").collect()] == [(0, "")]

"""Spelling variants against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from feedsift.llm import permuterm
from feedsift.llm.common import table
from tests.conftest import SMALL

LOWER = str.maketrans(permuterm.UPPER, permuterm.SMALL)


def _vocabulary(docs, least=7, damage=31):
    n = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if damage and h % damage == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= least:
                n[w] += 1
    return {w: k for w, k in n.items() if k >= 2}


def _one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def _expected(n, ratio=10):
    near = {w: [v for v in n if v != w and abs(len(v) - len(w)) < 2 and _one_edit(v, w)] for w in n}
    form = {w: min(v, key=lambda x: (-n[x], x)) if v else None for w, v in near.items()}
    form = {w: v if v and n[v] >= ratio * n[w] else None for w, v in form.items()}
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=lambda r: r[0])


def _rows(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=lambda r: r[0])


def _varied(seed):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abéÀ") for _ in range(rnd.randrange(7, 10))) for _ in range(25)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "×÷×÷×÷×"]
    words += ["".join(rnd.choice("acgt") for _ in range(k)) for k in (61, 62, 63, 64, 65, 66, 200)]
    for w in list(words):
        i = rnd.randrange(len(w))
        words += [w[:i] + rnd.choice("abz") + w[i + 1:], w[:i] + w[i + 1:], w[:i] + rnd.choice("aé") + w[i:]]
    return {w: rnd.choice([2, 3, 25, 300, 4000]) for w in words if len(w) >= 7} | {f"chain{c}xxx": 2 * 10**i for i, c in enumerate("abcdefg")}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_variants_match_brute_force(spark, seed):
    n = _varied(seed)
    words = spark.createDataFrame([(i, w, k) for i, (w, k) in enumerate(sorted(n.items()))], "id long, word string, n long").repartition(5)
    assert _rows(permuterm.variants(words)) == _expected(n)


def test_query_on_the_given_table(spark):
    docs = table(spark, SMALL, "documents")
    n = _vocabulary([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    by_less = {}
    for w in n:                                                # brute force within words of one length and two letters less is enough here
        by_less.setdefault(len(w), []).append(w)
    got = _rows(permuterm.spelling_variants(docs, damage=31))
    assert [(r[0], r[3]) for r in got] == sorted(n.items())
    sample = dict(sorted(n.items(), key=lambda x: zlib.crc32(x[0].encode()))[:150])
    near = {w: [v for k in (-1, 0, 1) for v in by_less.get(len(w) + k, []) if v != w and _one_edit(v, w)] for w in sample}
    assert {r[0]: r[4] for r in got if r[0] in sample} == {w: len(v) for w, v in near.items()}


def test_edges(spark, edge_docs, no_docs):
    assert permuterm.spelling_variants(no_docs, damage=31).count() == 0
    n = _vocabulary([(r.doc_id, r.text) for r in edge_docs.select("doc_id", "text").collect()])
    assert _rows(permuterm.spelling_variants(edge_docs, damage=31)) == _expected(n)
    long = "acgt" * 30_000
    rows = [(None, f"{long} {long[:-1]}"), (2, f"{long}\n{long[:-1]}"), (3, f"{long[:500]}t{long[501:]} Straßen STRAßEN"), (3, f"{long[:500]}t{long[501:]}"), (4, None), (5, "")]
    docs = spark.createDataFrame([(*r, "id", 1) for r in rows], "doc_id long, text string, word string, n int")
    want = _expected(_vocabulary(rows, damage=0))
    assert _rows(permuterm.spelling_variants(docs)) == want and len(want) == 4


def test_ranges_may_cross_batches(spark):
    n = _varied(5)
    words = spark.createDataFrame([(i, w, k) for i, (w, k) in enumerate(sorted(n.items()))], "id long, word string, n long").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = _rows(permuterm.variants(words))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == _expected(n)


def test_long_prefixes_agree_with_plain_ones():
    rnd = random.Random(4)
    words = ["".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 9))) for _ in range(200)]
    plain, short = {}, {}
    for w in words:
        for (a, k), (b, j) in zip(permuterm.prefixes(w), permuterm.prefixes(w, plain=3)):
            assert k == j and plain.setdefault(b, a) == a and short.setdefault(a, b) == b


def test_scan_counts_others_once():
    ids, near, best_n, best_id = permuterm.scan(np.array([0, 0, 0, 1, 2, 2]), np.array([0, 1, 2, 1, 0, 2]), np.array([10, 11, 12, 13, 14, 15]), np.array([5, 7, 7, 9, 1, 2]))
    assert dict(zip(ids.tolist(), zip(near.tolist(), best_n.tolist(), best_id.tolist()))) == {
        10: (1, 7, 11), 11: (2, 7, 12), 12: (1, 7, 11), 14: (0, 2, 15), 15: (0, 1, 14)}

"""SimHash groups, line dedup, substring dedup and decontamination against brute force."""

from __future__ import annotations

import numpy as np
import xxhash

from feedsift.llm import decontam, line_dedup, simhash, substring
from feedsift.llm.common import ALNUM_WORDS, LOWER, table
from tests.conftest import SMALL
from tests.llm.conftest import EDGE


def _fingerprint(text):
    w = (text or "").encode().translate(bytes(LOWER)).split()
    shingles = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _components(prints, radius):
    v = np.array(prints, np.uint64)
    root = list(range(len(v)))
    for i in range(len(v)):
        for j in np.flatnonzero(np.bitwise_count(v ^ v[i]) <= radius):
            a, b = i, int(j)
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            root[max(a, b)] = min(a, b)
    out = []
    for i in range(len(v)):
        while root[i] != i:
            i = root[i]
        out.append(i)
    return out


def _check_groups(rows, got, radius=2):
    fp = [_fingerprint(t) for _, t in rows]
    comp = _components(fp, radius)
    least = {}
    for (i, _), c in zip(rows, comp):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    want = sorted(((i, f, least.get(c)) for (i, _), f, c in zip(rows, fp, comp)), key=repr)
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in got), key=repr) == want


def test_simhash_groups(spark):
    docs = table(spark, SMALL, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for limit in (4096, 2):                                   # also with every bucket dealt again
        _check_groups(rows, simhash.near_duplicates(docs, bucket_limit=limit).collect())


def test_simhash_edge_cases(edge_docs, no_docs):
    _check_groups(EDGE, simhash.near_duplicates(edge_docs).collect())
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = simhash.keep_first(edge_docs)
    assert kept.columns == edge_docs.columns and simhash.keep_first(no_docs).count() == 0
    assert sorted(((r.doc_id) for r in kept.collect()), key=repr) == sorted([1, 2, 5, 7, 9, None], key=repr)


def test_bk_tree_and_bucket_splits_lose_no_link(spark):
    r = np.random.default_rng(0)
    base = r.integers(0, 2**63, 30, dtype=np.uint64)
    flips = np.uint64(1) << r.integers(0, 64, (30, 20, 3)).astype(np.uint64)
    v = np.unique((base[:, None] ^ np.bitwise_xor.reduce(flips, axis=2)).ravel())
    want = _components(v, 2)
    for radius in (2,):
        label = simhash.components(v, radius)
        groups = lambda x: sorted(map(tuple, {k: [i for i, y in enumerate(x) if y == k] for k in x}.values()))
        assert groups(label.tolist()) == groups(want)
    df = spark.createDataFrame([(int(x),) for x in v.view(np.int64)], "fp long")
    for limit in (4096, 1):
        root = {r.id: r.root for r in simhash.connect(simhash.links(df, 2, bucket_limit=limit)).collect()}
        got = [root.get(int(x), int(x)) for x in v.view(np.int64)]
        assert groups(got) == groups(want)


def _line_brute(rows, ratio, least):
    """(id, host, text) -> kept texts."""
    pages, seen = {}, {}
    for _, h, t in rows:
        pages[h] = pages.get(h, 0) + 1
        for x in {y.strip() for y in (t or "").split("\n")} - {""}:
            seen[h, x] = seen.get((h, x), 0) + 1
    drop = {k for k, n in seen.items() if n >= least and n > ratio * pages[k[0]]}
    return [(i, h, t if t is None else "\n".join(x for x in t.split("\n") if (h, x.strip()) not in drop)) for i, h, t in rows]


def test_line_dedup(spark):
    docs = table(spark, SMALL, "documents")
    rows = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    for ratio, least in ((0.1, 2), (0.02, 1)):
        got = line_dedup.drop_lines(docs, ratio=ratio, min_pages=least)
        assert got.columns == docs.columns
        got = got.collect()
        assert sorted((r.doc_id, r.source, r.text) for r in got) == sorted(_line_brute(rows, ratio, least))
        assert all(r.n_chars == len(r.text) for r in got if r.text != dict((i, t) for i, _, t in rows)[r.doc_id])


def test_line_dedup_edge_cases(spark, edge_docs, no_docs):
    rows = [(r.doc_id, r.source, r.text) for r in edge_docs.collect()]
    got = line_dedup.drop_lines(edge_docs, ratio=0.1, min_pages=2)
    assert got.columns == edge_docs.columns
    assert sorted(((r.doc_id, r.source, r.text) for r in got.collect()), key=repr) == sorted(_line_brute(rows, 0.1, 2), key=repr)
    assert line_dedup.drop_lines(no_docs).count() == 0
    pages = spark.createDataFrame([(1, "http://u@H.com:80/a", "<p>x</p><script>no</script>y"), (None, None, None), (2, "bad", "")], "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.n_lines, r.n_dropped, r.text) for r in line_dedup.page_lines(pages).collect()}
    assert got == {1: ("h.com", 2, 0, "x\ny"), None: ("", 0, 0, ""), 2: ("", 0, 0, "")}


def _substring_brute(rows, window):
    seen, out = set(), []
    for k, (i, t) in sorted(enumerate(rows), key=lambda r: (r[1][0] is not None, r[1][0] or 0, r[0])):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for a in range(len(w) - window + 1):
            key = tuple(w[a:a + window])
            if key in seen:
                gone[a:a + window] = [True] * window
            seen.add(key)
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=repr)


def _substring_got(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in df.collect()), key=repr)


def test_substring_dedup(spark):
    docs = table(spark, SMALL, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for kw in ({}, {"block_bytes": 20_000, "segment_windows": 3000}, {"extra": -3, "block_bytes": 50_000}):      # also with a crowded sketch
        assert _substring_got(substring.dedup(docs, window=20, **kw)) == _substring_brute(rows, 20)


def test_substring_edge_cases(spark, edge_docs, no_docs):
    assert _substring_got(substring.dedup(edge_docs.coalesce(1), window=3)) == _substring_brute(EDGE, 3)
    assert substring.dedup(no_docs).count() == 0
    rows = [(1, "a " * 50), (2, "a " * 30 + "b c d " * 9), (3, "b c d " * 8), (4, "q " * 2 + "a " * 50), (6, "a " * 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert _substring_got(substring.dedup(df, window=5, block_bytes=40)) == _substring_brute(rows, 5)


def test_substring_hot_copies(spark):
    """A third of all documents are copies of one text, others of smaller groups; both ways of meeting the first one."""
    def text(k):
        return " ".join(f"w{(k * 31 + i * i) % 997}" for i in range(30))

    rows = [(i, text(0) if i % 3 == 0 else text(i % 40 + 1) if i % 3 == 1 else text(100 + i)) for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = _substring_brute(rows, 20)
    for share in (1, 4, 1000):                          # none hot, the third alone, all
        assert _substring_got(substring.dedup(df, window=20, block_bytes=2000, hot_share=share)) == want


def test_substring_hot_copies_are_broadcast_within_a_bound(spark):
    info = spark.createDataFrame([(i % 7, i, i, 30, -1 if i % 3 == 0 else i, -1 if i % 3 == 0 else i) for i in range(90)],
                                 "to long, idx int, doc_id long, n long, hi long, lo long")
    got = substring.copies_of(info, 90, 4)
    assert sorted((r.to, r.idx) for r in got.collect()) == sorted((i % 7, i) for i in range(3, 90, 3))


def _words(t):
    table_ = bytes(c if w else 32 for c, w in zip(LOWER.tolist(), ALNUM_WORDS[LOWER].tolist()))
    return (t or "").encode().translate(table_).split()


def _decontam_brute(rows, items, window):
    wins = {}
    for i, t in items:
        w = _words(t)
        m = min(window, len(w))
        for a in range(len(w) - m + 1) if m else ():
            wins.setdefault(tuple(w[a:a + m]), set()).add("" if i is None else str(i))
    out = []
    for i, t in rows:
        w, hit, its = _words(t), set(), set()
        for m in {len(k) for k in wins}:
            for a in range(len(w) - m + 1):
                if tuple(w[a:a + m]) in wins:
                    hit |= set(range(a, a + m))
                    its |= wins[tuple(w[a:a + m])]
        out.append((i, len(w), len(hit), len(its)))
    return sorted(out, key=repr)


def _decontam_got(df):
    return sorted(((r.doc_id, r.contamination.n_words, r.contamination.n_hit, r.contamination.n_items) for r in df.collect()), key=repr)


def test_decontamination(spark):
    docs, bench = table(spark, SMALL, "documents"), table(spark, SMALL, "benchmark")
    rows, items = [(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()]
    for kw in ({}, {"max_words": 300}):                       # also with the benchmark in several blocks
        assert _decontam_got(decontam.contamination(docs, bench, window=10, **kw)) == _decontam_brute(rows, items, 10)
    assert decontam.clean(docs, bench).columns == docs.columns


def test_decontamination_edge_cases(spark, edge_docs, no_docs):
    items = [(1, "beta gamma"), (2, "BETA-gamma!"), (3, None), (4, ""), (None, "été " * 12), (5, "x"), (5, "alpha beta gamma delta zeta")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert _decontam_got(decontam.contamination(edge_docs, bench, window=10)) == _decontam_brute(EDGE, items, 10)
    assert decontam.clean(edge_docs, bench).columns == edge_docs.columns
    assert decontam.contamination(no_docs, bench).count() == 0
    assert all(r[2] == 0 for r in _decontam_got(decontam.contamination(edge_docs, bench.limit(0))))


def test_wu_manber_finds_every_occurrence():
    r = np.random.default_rng(1)
    words = [f"w{i}" for i in range(4)]
    items = [(str(k), " ".join(r.choice(words, n))) for k, n in enumerate((1, 2, 3, 5, 5, 6))]
    texts = [" ".join(r.choice(words, n)) for n in (0, 1, 3, 700, 1500)]
    import pyarrow as pa

    from feedsift.llm.common import text_bytes

    n, hits, its = decontam.scan(*text_bytes(pa.array(texts)), decontam.patterns_of(items, 5))
    want = [x for _, x in sorted(zip(range(5), [_decontam_brute([(0, t)], items, 5)[0] for t in texts]))]
    assert [(0, int(a), decontam._covered([h]), len(i)) for a, h, i in zip(n, hits, its)] == want

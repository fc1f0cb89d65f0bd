"""The byte network: slopes against differences, reading against a plain loop, held-out accuracy, edges."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedsift.llm import langid
from feedsift.llm.common import LOWER, crc_fold, table
from tests.conftest import MEDIUM
from tests.llm.conftest import EDGE


def test_slopes_match_differences():
    net = langid.Network.start(["a", "b", "c"], 3, dtype=np.float64)
    codes, n, vote = langid.pieces([b"ab cd", b"", b"x", "café ole".encode(), b"zz9zz abcdefg"], 8)
    label = np.array([0, 1, 2, 1, 0])
    loss, slopes = langid.gradients(net, codes, n, vote, label)
    rng = np.random.default_rng(0)
    for w, g in zip(net.weights(), slopes):
        flat, slope = w.reshape(-1), g.reshape(-1)
        for i in {*np.argsort(-np.abs(slope))[:6].tolist(), *rng.integers(0, len(flat), 6).tolist()}:
            old, eps = flat[i], 1e-6
            flat[i] = old + eps
            up = langid.gradients(net, codes, n, vote, label)[0]
            flat[i] = old - eps
            down = langid.gradients(net, codes, n, vote, label)[0]
            flat[i] = old
            assert abs((up - down) / (2 * eps) - slope[i]) < 1e-6
    assert loss > 0


def _plain(net, window):
    """Probabilities at every byte of a window, a byte at a time."""
    h = net.inner.shape[1]
    squash = lambda x: x / (1 + np.abs(x))
    sides = []
    for d, text in ((0, window), (1, window[::-1])):
        state, out = np.zeros(h), []
        for b in text:
            x, g = net.table[d][LOWER[b]].astype(float), state @ net.inner[d].astype(float)
            z, r = 0.5 + 0.5 * squash(x[:h] + g[:h]), 0.5 + 0.5 * squash(x[h:2 * h] + g[h:2 * h])
            c = squash(x[2 * h:] + r * g[2 * h:])
            state = z * state + (1 - z) * c
            out.append(state @ net.out[d])
        sides.append(out if d == 0 else out[::-1])
    logits = np.array(sides[0]) + np.array(sides[1]) + net.bias
    p = np.exp(logits - logits.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def test_reading_matches_a_plain_loop(monkeypatch):
    monkeypatch.setattr(langid, "WINDOW", 20)
    monkeypatch.setattr(langid, "CONTEXT", 3)
    monkeypatch.setattr(langid, "BLOCK", 4)
    net = langid.Network.start(["a", "b", "c"], 5, seed=3)
    texts = [b"", b"A", "Déjà vu, encore une fois.".encode(), b"12345", b"x" * 20, b"The quick brown fox jumps over the lazy dog; " * 3, b"\n"]
    data, off = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    p, letters, labels = langid.Reader(net).judge(data, off)
    own = langid.Reader(net).labels(data, off)
    for k, t in enumerate(texts):
        voted, marks = [], []
        for i in range(0, len(t), 20):
            a, z = max(0, i - 3), min(len(t), i + 23)
            q = _plain(net, t[a:z])[i - a:min(len(t), i + 20) - a]
            marks += q.argmax(1).tolist()
            voted += [x for x, b in zip(q, t[i:i + 20]) if langid._LETTER[b]]
        assert letters[k] == len(voted)
        assert np.allclose(p[k], np.mean(voted, 0) if voted else 0, atol=1e-5)
        assert own[off[k]:off[k + 1]].tolist() == marks
        assert labels[k].sum() == len(voted)


def test_a_text_is_judged_alike_in_any_company():
    net = langid.Network.start(["a", "b"], 16, seed=1)
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(32, 127, n).tolist()) for n in (5, 300, 40_000, 241, 1)]

    def judge(some):
        return langid.Reader(net).judge(np.frombuffer(b"".join(some), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in some])]))[0]

    together = judge(texts)
    assert all(np.allclose(judge([t])[0], q, rtol=0, atol=1e-5) for t, q in zip(texts, together))         # float32 sums


def test_held_out_accuracy(spark):
    docs = table(spark, MEDIUM, "documents")
    net = langid.train(docs)
    got = langid.identified(docs.select("doc_id", "text", F.col("lang").alias("said")), net).where(crc_fold(F.col("doc_id"), 4) == 2)
    rows = got.select("said", "language.*").collect()
    assert len(rows) > 200 and np.mean([r.said == r.lang for r in rows]) > 0.97
    assert all(0 < r.score <= 1 and 0 <= r.share <= 1 for r in rows)
    again = langid.train(docs.repartition(7))
    assert all((a == b).all() for a, b in zip(net.weights(), again.weights()))
    spans = langid.spans(spark.createDataFrame([(1, "Die Straße ist lang und die Bäume sind grün. " * 3), (2, None), (3, "")], "doc_id long, text string"), net).orderBy("doc_id").collect()
    parts = spans[0].language_spans
    assert parts[0].start == 0 and parts[-1].end == len(("Die Straße ist lang und die Bäume sind grün. " * 3).encode())
    assert all(a.end == b.start and a.lang != b.lang for a, b in zip(parts, parts[1:]))
    assert [r.language_spans for r in spans[1:]] == [[], []]


def test_edges(spark, edge_docs, no_docs):
    assert langid.train(no_docs) is None
    assert langid.identified(no_docs, None).count() == 0
    net = langid.train(edge_docs, held_out=9, passes=1)
    assert net.langs == ["en"]
    rows = langid.identified(edge_docs.withColumn("language", F.lit("kept elsewhere")).drop("language"), net).select("doc_id", "text", "language.*").collect()
    assert len(rows) == len(EDGE)
    for r in rows:
        assert (r.lang, r.score) == (("en", 1.0) if any(c.isalpha() for c in r.text or "") else ("und", 0.0))
    odd = spark.createDataFrame([(1, "12 !?"), (2, "☃☃"), (3, "中文"), (4, "a" * 3_000_000)], "doc_id long, text string")
    assert [(r.lang, r.share) for r in langid.identified(odd, net).orderBy("doc_id").select("language.*").collect()] == [("und", 0.0), ("und", 0.0), ("en", 1.0), ("en", 1.0)]
    assert {r.lang for r in langid.identified(edge_docs, None).select("language.lang").collect()} == {"und"}


@pytest.mark.parametrize("column", ["lang", "source", "doc_id"])
def test_other_columns_are_no_inputs(spark, column):
    docs = table(spark, MEDIUM, "documents").limit(120)
    net = langid.Network.start(["de", "en"], 4)
    first = langid.identified(docs.select("doc_id", "text"), net).select("language").collect()
    changed = langid.identified(docs.withColumn(column, F.lit("7").cast(docs.schema[column].dataType)), net).select("language").collect()
    assert first == changed

"""Words that collide in every polynomial hash modulo a power of two are still different words."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from feedsift.llm import ngram_lm, packing, substring, wavelet
from feedsift.llm.common import UnitEncoder, sequence_hash, span_hash, tokenizer_path, window_hash


def _thue_morse(n: int, letters: str) -> str:
    return "".join(letters[bin(i).count("1") & 1] for i in range(n))


ONE, OTHER = _thue_morse(1024, "ab"), _thue_morse(1024, "ba")


def test_hashes_tell_them_apart():
    data = np.frombuffer(f"{ONE} {OTHER}".encode(), np.uint8)
    for seed in (0, 1):
        a, b = span_hash(data, np.array([0, 1025]), np.array([1024, 2049]), seed)
        assert a != b
    words = np.arange(1, 3, dtype=np.uint64)
    x, y = (np.array([words[int(c == "a")] for c in w], np.uint64) for w in (ONE, OTHER))
    assert sequence_hash(x, np.array([0, 1024])) != sequence_hash(y, np.array([0, 1024]))
    assert window_hash(x, 1024) != window_hash(y, 1024)


def test_hashes_depend_on_the_span_alone():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 100, 600_000).astype(np.uint8)
    starts = np.array([3, 500, 300_000, 599_000])
    ends = np.array([9, 290_000, 300_001, 600_000])
    together = span_hash(data, starts, ends)
    alone = [span_hash(data[a:z].copy(), np.array([0]), np.array([z - a]))[0] for a, z in zip(starts, ends)]
    assert together.tolist() == alone
    words = rng.integers(0, 5, 300).astype(np.uint64)
    for window in (1, 2, 3, 20, 300):
        h = window_hash(words, window)
        seen = {}
        for i in range(len(words) - window + 1):
            assert seen.setdefault(words[i:i + window].tobytes(), h[i]) == h[i]
        assert len(set(seen.values())) == len(seen)
    assert len(window_hash(words, 301)) == 0
    at = np.array([0, 0, 20, 300])
    assert sequence_hash(words, at).tolist() == [sequence_hash(words[a:z], np.array([0, z - a]))[0] for a, z in zip(at, at[1:])]


def test_encoder_compares_bytes_when_hashes_agree(monkeypatch):
    import feedsift.llm.common as common

    monkeypatch.setattr(common, "span_hash", lambda data, s, e, seed=0: (e - s).astype(np.uint64) % 2)
    enc = UnitEncoder(tokenizer_path())
    for text in ("ab cd ef gh ab", "cd cd ab xyz", "ef gh  q"):
        ids, _ = enc.encode(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
        assert ids.tolist() == enc.tok.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def pair(spark):
    return spark.createDataFrame([(1, ONE), (2, OTHER)], "doc_id long, text string")


def test_tokens(spark, pair):
    enc = UnitEncoder(tokenizer_path())
    want = {i: enc.tok.encode(t, add_special_tokens=False).ids for i, t in ((1, ONE), (2, OTHER))}
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    got = {r.doc_id: r.ids_crc32 for r in wavelet.read_documents(wavelet.write_shards(pair.coalesce(1), tokenizer_path(), end_id=2)).collect()}
    assert got == {i: crc([*ids, 2]) for i, ids in want.items()}
    pieces = {}
    for r in packing.pack(pair.coalesce(1), tokenizer_path(), width=1 << 20, end_id=0).collect():
        pieces[r.doc_id] = r.ids_crc32
    assert pieces == {i: crc([*ids, 0]) for i, ids in want.items()}


def test_substrings(spark):
    rest = " ".join(f"w{i}" for i in range(19))
    docs = spark.createDataFrame([(1, f"{ONE} {rest}"), (2, f"{OTHER} {rest}"), (3, " ".join(ONE)), (4, " ".join(OTHER[:1023]) + " z")], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.n_removed for r in substring.dedup(docs, window=20).where("doc_id < 3").collect()}
    assert got == {1: 0, 2: 0}
    whole = spark.createDataFrame([(1, " ".join(ONE)), (2, " ".join(OTHER))], "doc_id long, text string").coalesce(1)
    assert [r.n_removed for r in substring.dedup(whole, window=1024).collect()] == [0, 0]


def test_language_model(spark):
    learn, held = (next(i for i in range(100) if (zlib.crc32(str(i).encode()) % 10 == 0) == h) for h in (False, True))
    docs = spark.createDataFrame([(learn, ONE), (held, OTHER)], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.n_known for r in ngram_lm.score(docs).collect()}
    assert got == {learn: 2, held: 1}

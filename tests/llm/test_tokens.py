"""Wavelet shards and packing against plain encoding."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from feedsift.llm import packing, wavelet
from feedsift.llm.common import encoder, table, text_bytes, tokenizer_path
from tests.conftest import SMALL
from tests.llm.conftest import EDGE


@pytest.fixture(scope="module")
def plain():
    tok = Tokenizer.from_file(tokenizer_path())
    tok.encode_special_tokens = True
    return lambda t: tok.encode(t or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("aZé×÷ñ  '.,\n\t\r0١9 　᠎​中-_<|>😀\0\x1c\x85")), max_size=25), max_size=6))
def test_unit_encoder_equals_plain_encoding(plain, texts):
    data, off = text_bytes(pa.array(texts, pa.string()))
    ids, at = encoder(tokenizer_path()).encode(data, off)
    assert [ids[a:z].tolist() for a, z in zip(at, at[1:])] == [plain(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<|endoftext|>", "<|endo", "ftext|>", "<|", "a", "é", " ", "  ", "\n", "'s", ".", "0", "中"]), max_size=12).map("".join), max_size=5))
def test_unit_encoder_equals_the_unchanged_library_call(texts):
    tok = Tokenizer.from_file(tokenizer_path())
    data, off = text_bytes(pa.array(texts, pa.string()))
    ids, at = encoder(tokenizer_path()).encode(data, off)
    assert [ids[a:z].tolist() for a, z in zip(at, at[1:])] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_unit_encoder_added_token():
    data, off = text_bytes(pa.array(["x <|endoftext|>y", "<|endo", "ftext|>"]))
    ids, at = encoder(tokenizer_path()).encode(data, off)
    assert ids[:at[1]].tolist() == [87, 220, 50256, 88] and 50256 not in ids[at[1]:]


def test_unit_encoder_forgets_without_changing_ids(spark, plain):
    enc = encoder(tokenizer_path())
    texts = [r.text for r in table(spark, SMALL, "documents").limit(30).collect()]
    for _ in range(2):
        enc.BOUND = 10
        data, off = text_bytes(pa.array(texts))
        ids, at = enc.encode(data, off)
        assert [ids[a:z].tolist() for a, z in zip(at, at[1:])] == [plain(t) for t in texts]
    del enc.BOUND


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=80), st.integers(0, 10))
def test_wavelet_matrix(ids, token):
    w = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(np.array(ids, np.uint32)).to_bytes())
    assert w.tokens().tolist() == ids and [w.access(i) for i in range(len(ids))] == ids
    assert w.occurrences(token) == [i for i, t in enumerate(ids) if t == token]
    assert [w.rank(token, i) for i in range(len(ids) + 1)] == [ids[:i].count(token) for i in range(len(ids) + 1)]


def test_wavelet_select_over_many_blocks():
    ids = np.random.default_rng(0).integers(0, 3, 5000).astype(np.uint32)
    w = wavelet.WaveletMatrix.build(ids)
    where = np.flatnonzero(ids == 2)
    assert [w.select(2, k) for k in range(0, len(where), 97)] == where[::97].tolist() and w.count(2) == len(where)


def _expected(rows, plain, end):
    """(doc_id, text) in doc_id order, null ids first; ties don't matter to the totals checked here."""
    out, at = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array(plain(t) + [end], "<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_shards_round_trip(spark, plain):
    docs = table(spark, SMALL, "documents")
    shards = wavelet.write_shards(docs.repartition(3), tokenizer_path(), shard_tokens=9000)
    assert shards.count() > 3 and len(shards.inputFiles()) == shards.count()
    got = sorted(map(tuple, wavelet.read_documents(shards).collect()))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got == _expected(rows, plain, 2)
    assert sum(r.n for r in wavelet.lookup(shards, 262).collect()) == sum(plain(t).count(262) for _, t in rows)


def test_shards_edge_cases(edge_docs, no_docs, plain):
    got = wavelet.read_documents(wavelet.write_shards(edge_docs, tokenizer_path())).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == _expected(EDGE, plain, 2)
    assert wavelet.read_documents(wavelet.write_shards(no_docs, tokenizer_path())).count() == 0


def _check_packed(rows, packed, width, plain):
    """Each id in exactly one piece, pieces right, sequences gapless and full but for the last."""
    pieces, seqs = {}, {}
    for r in packed:
        pieces.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    total = 0
    for i, t in set(rows):
        ids = plain(t) + [0]
        copies = rows.count((i, t))
        total += len(ids) * copies
        own = sorted((r.start, r.length) for r in pieces[i] if r.doc_tokens == len(ids))
        cover = np.zeros(len(ids), int)
        for a, n in own:
            cover[a:a + n] += 1
        assert (cover == copies).all()
        for r in pieces[i]:
            if r.doc_tokens == len(ids):
                assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start:r.start + r.length], "<u4").tobytes())
    assert sorted(seqs) == list(range(-(-total // width)))
    for s, parts in seqs.items():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at == width or s == max(seqs) and at == total - s * width


def test_packing(spark, plain):
    docs = table(spark, SMALL, "documents")
    tokens = packing.token_table(docs.repartition(5), tokenizer_path())
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    _check_packed(rows, packing.pieces(tokens).collect(), 1024, plain)
    seqs = {r.sequence_id: r.ids for r in packing.sequences(tokens, 1024).collect()}
    placed = {(r.sequence_id, r.offset): r for r in packing.pieces(tokens, with_ids=True).collect()}
    assert all(seqs[s][4 * o:4 * (o + r.length)] == r.ids for (s, o), r in placed.items())
    assert sum(map(len, seqs.values())) == 4 * sum(r.length for r in placed.values())


def test_packing_edge_cases(edge_docs, no_docs, plain):
    _check_packed(EDGE, packing.pack(edge_docs, tokenizer_path(), width=16).collect(), 16, plain)
    empty = packing.token_table(no_docs, tokenizer_path())
    assert packing.pieces(empty).count() == 0 and packing.sequences(empty).count() == 0

"""Hashing embedder (M5 offline default, P28).

Tokens are runs of letters/digits of the whole lower-cased text; each token adds 1 to bucket ``md5(token)[:8] mod dim``; the
count vector is L2-normalised. One Arrow pass counts a batch of texts: the buckets of tokens seen before come from a
bounded memo, and one ``bincount`` makes the vectors of the whole batch. There is no shuffle, and a batch's memory is that of its texts.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"[^\W_]+")
#: Tokens of the memo at most, and characters of each: longer ones (rare, and of any length) are not kept.
_MEMO_TOKENS, _MEMO_CHARS = 100_000, 32


class _Buckets(dict):
    """Token -> bucket; filled as tokens are met, and emptied when it has grown too large."""

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __missing__(self, token: str) -> int:
        b = int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % self.dim
        if len(token) <= _MEMO_CHARS:
            if len(self) >= _MEMO_TOKENS:
                self.clear()
            self[token] = b
        return b


_MEMO: dict[int, _Buckets] = {}


def count_tokens(texts: list[str], dim: int) -> np.ndarray:
    """(texts, dim): tokens of each lower-cased text per bucket."""
    buckets = _MEMO.setdefault(dim, _Buckets(dim))
    out = np.zeros((len(texts), dim), np.int64)
    for row, text in zip(out, texts):
        found = [buckets[t] for t in _TOKEN.findall(text)]
        if found:
            row += np.bincount(found, minlength=dim)
    return out


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel(), kind))


def _texts(col: pa.Array) -> list[str]:
    return ["" if t is None else t for t in col.to_pylist()]


def bucket_counts(text, dim: int = 64) -> Column:
    """``array<int>`` of length ``dim``: token count per bucket (zeros for a null text)."""
    def count(col: pa.Array) -> pa.Array:
        return _lists(count_tokens(_texts(col), dim), pa.int32())

    count.__annotations__ = {"col": pa.Array, "return": pa.Array}
    return F.arrow_udf(count, "array<int>")(F.lower(F.col(text) if isinstance(text, str) else text))


def hashing_embedding(text, dim: int = 64) -> Column:
    """M5: ``array<double>`` unit vector of hashed token counts; zeros for a text without tokens."""
    def embed(col: pa.Array) -> pa.Array:
        n = count_tokens(_texts(col), dim).astype(float)
        length = np.sqrt((n * n).sum(1, keepdims=True))
        return _lists(np.divide(n, length, out=np.zeros_like(n), where=length > 0), pa.float64())

    embed.__annotations__ = {"col": pa.Array, "return": pa.Array}
    return F.arrow_udf(embed, "array<double>")(F.lower(F.col(text) if isinstance(text, str) else text))

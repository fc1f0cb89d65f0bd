"""Helpers shared by the operators of this subpackage.

Every operator selects the columns it needs by name, or works on a table with
``numbered`` columns, so extra columns of any name never clash with its own; a
null text counts as empty everywhere.
"""

from __future__ import annotations

import os
import re
import uuid
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedsift.session import ensure_checkpoint_dir, ensure_importable


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder that ``spark.checkpoint.dir`` names."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/feedsift-{uuid.uuid4().hex}/{name}"


def staged(df: DataFrame, name: str, codec: str = "zstd", per_file: int = 0) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage and survives a lost executor: the files are in shared
    storage, and a retried task writes its own attempt.
    """
    spark = df.sparkSession
    ensure_importable(spark)
    path = scratch_path(spark, name)
    df.write.option("compression", codec).option("maxRecordsPerFile", per_file).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds`` (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def numbered(df: DataFrame) -> tuple[DataFrame, Callable[[str], str], list[str]]:
    """``df`` with its columns renamed to c0, c1, ..., the function from a column's own name to the new one, and the new names.

    Helper columns (which start with two underscores) can't clash with any of these; ``toDF`` gives the own names back.
    """
    new = [f"c{i}" for i in range(len(df.columns))]
    exact, folded = dict(zip(df.columns, new)), {c.lower(): n for c, n in zip(df.columns, new)}
    return df.toDF(*new), lambda name: exact.get(name) or folded[name.lower()], new


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def pack_u(a: np.ndarray, delta: bool = True) -> bytes:
    """Unsigned numbers as zstd-compressed byte planes, of their differences if ``delta`` (for ascending ones)."""
    import zstandard

    a = np.ascontiguousarray(a, np.uint64)
    d = np.diff(a, prepend=np.uint64(0)) if delta else a
    planes = d.view(np.uint8).reshape(-1, 8).T
    used = [i for i in range(8) if planes[i].any()] if len(a) else []
    body = b"".join(np.ascontiguousarray(planes[i]).tobytes() for i in used)
    head = len(a).to_bytes(8, "little") + bytes([sum(1 << i for i in used)])
    return head + zstandard.ZstdCompressor(level=1).compress(body)


def unpack_u(b: bytes, delta: bool = True) -> np.ndarray:
    import zstandard

    n, mask = int.from_bytes(b[:8], "little"), b[8]
    body = zstandard.ZstdDecompressor().decompress(b[9:], max_output_size=max(1, 8 * n)) if n else b""
    out = np.zeros((n, 8), np.uint8)
    at = 0
    for i in range(8):
        if mask >> i & 1:
            out[:, i] = np.frombuffer(body, np.uint8, n, at)
            at += n
    return np.cumsum(out.view(np.uint64).ravel(), dtype=np.uint64) if delta else out.view(np.uint64).ravel()


class Blob:
    """Named numpy arrays and byte strings in one zstd-compressed byte string."""

    @staticmethod
    def dump(level: int = 1, **parts: np.ndarray) -> bytes:
        import pickle

        import zstandard

        return zstandard.ZstdCompressor(level=level).compress(pickle.dumps(parts, protocol=5))

    @staticmethod
    def load(b: bytes) -> dict:
        import pickle

        import zstandard

        return pickle.loads(zstandard.ZstdDecompressor().decompress(b))


MESSAGE = "to long, src long, payload binary"
_MESSAGE = pa.schema([("to", pa.int64()), ("src", pa.int64()), ("payload", pa.binary())])


def messages(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_MESSAGE)], schema=_MESSAGE)


def by_segment(keys: np.ndarray, shift: int) -> list[tuple[int, int, int]]:
    """(segment, first, end) of the runs of ascending ``keys`` that agree above the lowest ``shift`` bits."""
    if not len(keys):
        return []
    seg = keys >> np.uint64(shift)
    at = np.concatenate([[0], np.flatnonzero(seg[1:] != seg[:-1]) + 1, [len(keys)]]).tolist()
    return [(int(seg[a]), a, z) for a, z in zip(at, at[1:])]


def group_rows(t: pa.Table) -> list[dict]:
    """A group's messages in order of their source."""
    return sorted(t.to_pylist(), key=lambda r: r["src"])


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise a 64-bit value so that all its bits depend on all input bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: Random values of the bytes for each seed; any fixed random numbers do.
_BYTE = np.random.default_rng(20240229).integers(1, 2**64 - 1, (2, 256), dtype=np.uint64)
_STEP = np.uint64(0xA24BAED4963EE407)
_SLICE = 1 << 18


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans ascend and don't overlap. Works in slices of bounded size.

    Every byte is mixed with its place in the span before the sum, so that no rearrangement or exchange of bytes cancels out
    as it does in a polynomial modulo a power of two.
    """
    out = np.empty(len(starts), np.uint64)

    def mixed(lo: int, hi: int, place: np.ndarray) -> np.ndarray:
        return mix64(_BYTE[seed][data[lo:hi]] + place.astype(np.uint64) * _STEP)

    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _SLICE, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        if j == i + 1:                                             # it may be longer than a slice
            out[i] = np.add.reduce([mixed(x, min(x + _SLICE, hi), np.arange(x - lo, min(x + _SLICE, hi) - lo)).sum(dtype=np.uint64) for x in range(lo, hi, _SLICE)], dtype=np.uint64)
        else:
            s, e = starts[i:j] - lo, ends[i:j] - lo
            place = np.arange(hi - lo) - np.repeat(s, np.diff(np.append(s, hi - lo)))
            total = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(mixed(lo, hi, place), out=total[1:])
            out[i:j] = total[e] - total[s]
        i = j
    return mix64(out + (ends - starts).astype(np.uint64) * _STEP)


def window_hash(words: np.ndarray, window: int) -> np.ndarray:
    """Hash of the ``window`` word hashes from each place that has so many, put together from runs of 1, 2, 4, ... words."""
    n = len(words) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    run, length, out, done = mix64(words + _STEP), 1, None, 0
    while True:
        if window & length:
            part = run[done:done + n]
            out = part if out is None else mix64(out * _STEP + part)
            done += length
        if 2 * length > window:
            return out
        run = mix64(run[:-length] * _STEP + run[length:])
        length *= 2


def sequence_hash(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash of the word hashes from each ``at`` to the next one, each mixed with its place."""
    n = np.diff(at)
    place = np.arange(len(words)) - np.repeat(at[:-1], n)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(mix64(words + place.astype(np.uint64) * _STEP), out=total[1:])
    return mix64(total[at[1:]] - total[at[:-1]] + n.astype(np.uint64) * _STEP)


def text_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without nulls, and the offsets of its rows (views, no copies)."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if isinstance(col, pa.ChunkedArray):
        col = col.chunk(0) if col.num_chunks else pa.array([], pa.large_string())
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if len(col) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[off[0]:off[-1]]
    return data, off - off[0]


def text_chunks(batches: Iterable[pa.RecordBatch], size: int = 1 << 20) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(ids, bytes, offsets) of runs of rows with about ``size`` bytes of text; a longer text is a run of its own."""
    for b in batches:
        data, off = text_bytes(b.column(1))
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
            yield b.column(0).slice(i, j - i), data[off[i]:off[j]], off[i:j + 1] - off[i]
            i = j


#: ASCII white space ends a word; in the other class, all but letters, digits and non-ASCII bytes does.
SPACE_WORDS = np.ones(256, bool)
SPACE_WORDS[[0x20, *range(0x09, 0x0E)]] = False
ALNUM_WORDS = np.zeros(256, bool)
ALNUM_WORDS[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def word_spans(data: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes in each text, and the first word's index of each text (one more at the end)."""
    if len(data) == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(off), np.int64)
    w = is_word[data]
    before = np.empty_like(w)
    before[0] = False
    before[1:] = w[:-1]
    before[off[:-1][off[:-1] < len(data)]] = False
    starts = np.flatnonzero(w & ~before)
    after = np.empty_like(w)
    after[-1] = False
    after[:-1] = w[1:]
    last = off[1:] - 1
    after[last[last >= 0]] = False
    ends = np.flatnonzero(w & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


_PLAIN, _TWO, _CONT, _PUNCT = 1, 2, 4, 8
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x21:0x7F] |= _PLAIN
_CLASS[0xC3:0xE0] |= _TWO                 # first byte of a two-byte character that is no white space
_CLASS[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) != "'"]] |= _PUNCT
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def unit_cuts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Places where the byte-level pre-tokenizer always cuts, whatever the rest of the text: text starts; before a
    single space or around a single line feed between two visible characters; before ASCII punctuation (but for the
    apostrophe) after an ASCII letter or a Latin-1 one."""
    n = len(data)
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    cut[n] = False
    if n > 2:
        c = _CLASS[data]
        plain, two = (c & _PLAIN) > 0, (c & _TWO) > 0
        ends = plain.copy()                                # a visible character ends at this byte
        ends[1:] |= two[:-1]
        begins = plain | two
        gap = np.zeros(n, bool)
        gap[1:-1] = ends[:-2] & begins[2:]
        cut[:n] |= gap & (data == 0x20)
        feed = gap & (data == 0x0A)
        cut[:n] |= feed
        cut[1:] |= feed
        letter = _LETTER[data]
        latin = np.zeros(n, bool)
        latin[1:] = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        cut[1:n] |= ((c & _PUNCT) > 0)[1:] & (letter | latin)[:-1]
        cut[n] = False
    return np.flatnonzero(cut)


class UnitEncoder:
    """Token ids of whole texts by the tokenizers library, each distinct unit between sure cuts encoded once.

    Units are told apart by their bytes: those of a call by Arrow's dictionary encoding, those learnt before by a 64-bit hash in
    sorted arrays and a comparison of the bytes (a unit whose hash is another's is encoded each time). The memo is emptied
    when it grows beyond its bound (ids don't change). The vocabulary's added tokens are units of their own, as in the library.
    """

    BOUND = 1_600_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        added = self.tok.get_added_tokens_decoder().values()
        if any(t.single_word or t.lstrip or t.rstrip or t.normalized and self.tok.normalizer for t in added):
            raise ValueError("added tokens that depend on the text around them aren't supported")
        contents = sorted((t.content.encode() for t in added), key=len, reverse=True)
        self.added = re.compile(b"|".join(map(re.escape, contents))) if contents else None
        self._reset()

    def _reset(self) -> None:
        self.keys, self.slot = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.flat, self.ends = array("I"), array("q", [0])
        self.raw, self.raw_ends = bytearray(), array("q", [0])

    def _encode(self, units: list[bytes]) -> None:
        """Append the units' ids, without a place in the memo."""
        for i in range(0, len(units), 2048):
            ids = [e.ids for e in self.tok.encode_batch_fast([u.decode() for u in units[i:i + 2048]], add_special_tokens=False)]
            self.ends.extend(accumulate(map(len, ids[1:]), initial=len(self.flat) + len(ids[0])))
            self.flat.extend(chain.from_iterable(ids))
        stops = len(self.raw) + np.cumsum(np.fromiter(map(len, units), np.int64, len(units)))
        self.raw += b"".join(units)
        self.raw_ends.frombytes(stops.tobytes())

    def _slots(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """The place of the ids of each (distinct) unit, learning those that are new."""
        n = len(off) - 1
        keys = span_hash(data, off[:-1], off[1:])
        at = np.searchsorted(self.keys, keys)
        slot = np.full(n, -1)
        inside = np.flatnonzero(at < len(self.keys))
        inside = inside[self.keys[at[inside]] == keys[inside]]
        if len(inside):
            known = self.slot[at[inside]]
            stops, raw = np.frombuffer(self.raw_ends, np.int64), np.frombuffer(self.raw, np.uint8)
            size = np.diff(off)[inside]
            alike = stops[known + 1] - stops[known] == size
            inside, known, size = inside[alike], known[alike], size[alike]
            step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            differs = data[np.repeat(off[inside], size) + step] != raw[np.repeat(stops[known], size) + step]
            wrong = np.bincount(np.repeat(np.arange(len(size)), size)[differs], minlength=len(size)) > 0
            slot[inside[~wrong]] = known[~wrong]
            del stops, raw                                      # so that the buffers can grow again
        new = np.flatnonzero(slot < 0)
        if len(new):
            first, body = len(self.ends) - 1, data.tobytes()
            self._encode([body[a:z] for a, z in zip(off[new].tolist(), off[new + 1].tolist())])
            slot[new] = first + np.arange(len(new))
            fresh, which = np.unique(keys[new], return_index=True)
            at = np.searchsorted(self.keys, fresh)
            free = np.append(self.keys, ~fresh[-1])[at] != fresh
            fresh, which, at = fresh[free], which[free], at[free]
            self.keys = np.insert(self.keys, at, fresh)
            self.slot = np.insert(self.slot, at, first + which)
        return slot

    def _cuts(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """The sure cuts: around every added token and none within it."""
        cuts = unit_cuts(data, off)
        if self.added is None:
            return cuts
        raw, at, found = data.tobytes(), 0, []
        while m := self.added.search(raw, at):
            a, z = m.span()
            whole = off[np.searchsorted(off, a, "right")] >= z       # not over a border of texts
            at = z if whole else a + 1
            if whole:
                found.append((a, z))
        if not found:
            return cuts
        a, z = np.array(found).T
        k = np.searchsorted(a, cuts, "left") - 1
        cuts = cuts[(k < 0) | (cuts >= z[np.maximum(k, 0)])]
        return np.unique(np.concatenate([cuts, a, z[z < len(data)]]))

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32) of the texts in ``data``, and the offsets of each text's ids."""
        if len(data) == 0:
            return np.empty(0, np.uint32), np.zeros(len(off), np.int64)
        if len(self.keys) > self.BOUND:
            self._reset()
        starts = self._cuts(data, off)
        cuts = np.append(starts, len(data)).astype(np.int64)
        units = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(data)])
        units = pc.dictionary_encode(units, memory_pool=pa.system_memory_pool())        # the default pool would keep the hash table's memory
        slot = self._slots(*text_bytes(units.dictionary))[np.asarray(units.indices)]
        flat, stops = np.frombuffer(self.flat, np.uint32), np.frombuffer(self.ends, np.int64)
        first, n = stops[slot], stops[slot + 1] - stops[slot]
        stop = np.cumsum(n)
        ids = flat[np.arange(stop[-1]) + np.repeat(first - (stop - n), n)]
        del flat, stops                                    # so that the arrays can grow again
        return ids, np.concatenate([[0], stop])[np.searchsorted(starts, off)]


_ENCODERS: dict[str, UnitEncoder] = {}


def encoder(path: str) -> UnitEncoder:
    """This worker's encoder for a vocabulary file (kept between tasks)."""
    if path not in _ENCODERS:
        _ENCODERS[path] = UnitEncoder(path)
    return _ENCODERS[path]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def text_udf(fn: Callable[[np.ndarray, np.ndarray], pa.Array], returns: str):
    """An Arrow UDF over a string column: ``fn(bytes, offsets)`` gets runs of rows of bounded size and gives an array
    with an element per row. Null texts arrive as empty ones."""

    def apply(col: pa.Array) -> pa.Array:
        col = pc.fill_null(col, "") if col.null_count else col
        batch = pa.record_batch([pa.nulls(len(col)), col], names=["i", "t"])
        parts = [fn(d, o) for _, d, o in text_chunks([batch])]
        return pa.concat_arrays(parts) if parts else fn(np.empty(0, np.uint8), np.zeros(1, np.int64))

    apply.__annotations__ = {"col": pa.Array, "return": pa.Array}
    return F.arrow_udf(apply, returns)


def struct_array(**cols: pa.Array) -> pa.Array:
    return pa.StructArray.from_arrays(list(cols.values()), list(cols))

"""Language identification by a bidirectional gated recurrent network over bytes.

Two gated recurrent units (update and reset gates) read the bytes of a text (ASCII letters in lower case), one from each
side; at every position their states give the language probabilities of that position. Gates and candidates are
squashed by x / (1 + |x|), in fitting and reading alike, which numpy does in a sixth of the time of tanh. The probabilities of the positions that hold letters (ASCII letters and
bytes of other characters) are averaged over the document: the largest is the prediction and its score.

Texts are read whole, in windows of ``WINDOW`` bytes with ``CONTEXT`` bytes more on both sides that warm the states up but don't vote;
many windows go through the network at once, so that a very long text takes no more memory than a short one.

The network is fitted with numpy on the driver, by backpropagation through time and Adam, on a bounded sample
(``max_windows`` pieces of ``STEPS`` characters, dealt evenly over the languages, ``per_doc`` of a document, by a hash of
its id). Ids and sources are never inputs.

Nulls: texts that are null or have no letter are ``und`` with score 0, and so is every text if nothing can be learnt (no row
of the training folds with a language and a letter). Repeated rows are judged alike; a null id counts as the empty text in
the fold rule. Sums are float32, so scores may differ in the sixth digit with the company a text is read in.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from .common import LOWER, crc_fold, struct_array, text_udf

WINDOW, CONTEXT, BLOCK, STEPS = 240, 8, 1024, 64
UNKNOWN = "und"
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


@dataclass
class Network:
    """Weights of both directions: input rows per byte (2, 256, 3h), recurrent (2, h, 3h), output (2, h, k) and bias (k).
    The gates are in the order update, reset, candidate."""

    langs: list[str]
    table: np.ndarray
    inner: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def start(cls, langs: list[str], hidden: int, seed: int = 0, dtype: type = np.float32) -> Network:
        rng = np.random.default_rng(seed)
        inner = rng.normal(0, hidden**-0.5, (2, hidden, 3 * hidden))
        return cls(langs, rng.normal(0, 0.3, (2, 256, 3 * hidden)).astype(dtype), inner.astype(dtype),
                   rng.normal(0, hidden**-0.5, (2, hidden, len(langs))).astype(dtype), np.zeros(len(langs), dtype))

    def weights(self) -> list[np.ndarray]:
        return [self.table, self.inner, self.out, self.bias]


def _squashed(x: np.ndarray, room: np.ndarray) -> None:
    """x / (1 + |x|) in place; ``room`` is scratch of the same shape. The slope is (1 - |result|) ** 2."""
    np.abs(x, out=room)
    room += 1
    x /= room


def _both(codes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(2, steps, rows): the rows' bytes from the left and from the right; ``codes`` is (rows, steps), ``n`` the lengths."""
    steps = np.arange(codes.shape[1])
    back = np.where(steps < n[:, None], n[:, None] - 1 - steps, steps)
    return np.stack([codes.T, np.take_along_axis(codes, back, 1).T])


def gradients(net: Network, codes: np.ndarray, n: np.ndarray, vote: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy of the voting positions and its slopes, by backpropagation through time."""
    h, (rows, steps) = net.inner.shape[1], codes.shape
    seen = _both(codes, n)
    alive = np.stack([np.arange(steps)[:, None] < n] * 2)[..., None]            # (2, steps, rows, 1)
    state = np.zeros((steps + 1, 2, rows, h), net.table.dtype)
    kept = []
    for t in range(steps):
        x = np.stack([net.table[d][seen[d, t]] for d in (0, 1)])
        g = state[t] @ net.inner
        zr = x[..., :2 * h] + g[..., :2 * h]
        _squashed(zr, np.empty_like(zr))
        zr = 0.5 * zr + 0.5
        z, r = zr[..., :h], zr[..., h:]
        c = x[..., 2 * h:] + r * g[..., 2 * h:]
        _squashed(c, np.empty_like(c))
        state[t + 1] = np.where(alive[:, t], c + z * (state[t] - c), state[t])
        kept.append((z, r, c, g[..., 2 * h:]))
    at = np.arange(rows)[:, None]
    back = np.where(np.arange(steps) < n[:, None], n[:, None] - 1 - np.arange(steps), np.arange(steps))      # step of the right-to-left pass
    left = state[1:, 0].transpose(1, 0, 2)
    right = state[1:, 1].transpose(1, 0, 2)[at, back]
    logits = left @ net.out[0] + right @ net.out[1] + net.bias
    logits -= logits.max(-1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(-1, keepdims=True)
    total = max(1, int(vote.sum()))
    loss = -float(np.log(np.maximum(p[at, np.arange(steps), label[:, None]], 1e-30))[vote].sum()) / total
    d = p
    d[at, np.arange(steps), label[:, None]] -= 1
    d *= vote[..., None] / total
    flat = d.reshape(-1, d.shape[-1])
    d_out = np.stack([left.reshape(-1, h).T @ flat, right.reshape(-1, h).T @ flat])
    d_state = np.zeros((steps, 2, rows, h), net.table.dtype)
    d_state[:, 0] = (d @ net.out[0].T).transpose(1, 0, 2)
    d_state[:, 1] = (d @ net.out[1].T)[at, back].transpose(1, 0, 2)               # ``back`` is its own inverse
    d_inner = np.zeros_like(net.inner)
    d_x = np.zeros((steps, 2, rows, 3 * h), net.table.dtype)
    later = np.zeros((2, rows, h), net.table.dtype)
    for t in range(steps - 1, -1, -1):
        z, r, c, g = kept[t]
        now = (later + d_state[t]) * alive[:, t]
        dc = now * (1 - z) * (1 - np.abs(c)) ** 2
        dz = now * (state[t] - c) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
        dr = dc * g * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
        d_x[t] = np.concatenate([dz, dr, dc], -1)
        dg = np.concatenate([dz, dr, dc * r], -1)
        d_inner += state[t].transpose(0, 2, 1) @ dg
        later = np.where(alive[:, t], now * z + dg @ net.inner.transpose(0, 2, 1), later)
    d_table = np.zeros_like(net.table)
    for k in (0, 1):
        byte = seen[k].ravel()
        order = np.argsort(byte, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(byte[order].astype(np.int64)) > 0))
        d_table[k, byte[order][first]] = np.add.reduceat(d_x[:, k].reshape(-1, 3 * h)[order], first)
    return loss, [d_table, d_inner, d_out, flat.sum(0)]


def pieces(texts: list[bytes], steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes (rows, steps), lengths and voting positions of the first ``steps`` bytes of each text."""
    n = np.array([min(len(t), steps) for t in texts], np.int64)
    codes = np.frombuffer(b"".join(t[:steps].ljust(steps, b"\0") for t in texts), np.uint8).reshape(len(texts), steps)
    return LOWER[codes], n, _LETTER[codes] & (np.arange(steps) < n[:, None])


def fit(texts: list[bytes], label: np.ndarray, langs: list[str], hidden: int = 16, passes: int = 12, batch: int = 256, rate: float = 0.01, seed: int = 0) -> Network:
    """Adam over ``passes`` shuffled passes with a falling rate; slopes are clipped to norm 1."""
    net = Network.start(langs, hidden, seed)
    codes, n, vote = pieces(texts)
    rng = np.random.default_rng(seed)
    m, v = ([np.zeros_like(w) for w in net.weights()] for _ in range(2))
    total = passes * -(-len(texts) // batch)
    step = 0
    for _ in range(passes):
        order = rng.permutation(len(texts))
        for i in range(0, len(order), batch):
            rows = order[i:i + batch]
            step += 1
            _, slopes = gradients(net, codes[rows], n[rows], vote[rows], label[rows])
            norm = np.sqrt(sum(float((g * g).sum()) for g in slopes))
            now = rate * (1 - step / (total + 1)) / max(1.0, norm)
            for w, g, a, b in zip(net.weights(), slopes, m, v):
                a += 0.1 * (g / max(1.0, norm) - a)
                b += 0.001 * ((g / max(1.0, norm)) ** 2 - b)
                w -= (now * max(1.0, norm) * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)).astype(w.dtype)
    return net


class Reader:
    """The network laid out for reading: a row for each unit, a column for each window."""

    def __init__(self, net: Network):
        h = net.inner.shape[1]
        self.hidden, self.classes = h, len(net.bias)
        self.table = np.ascontiguousarray(net.table.transpose(0, 2, 1), np.float32)
        self.inner = np.ascontiguousarray(net.inner.transpose(0, 2, 1), np.float32)
        self.out = np.ascontiguousarray(net.out.transpose(0, 2, 1), np.float32)
        self.bias = net.bias.astype(np.float32)

    def logits(self, codes: np.ndarray, n: np.ndarray) -> np.ndarray:
        """(steps, classes, rows) for rows in falling order of their lengths; rows that have ended are left out, 32 at a time."""
        rows, steps = codes.shape
        lanes = -(-rows // 32) * 32
        codes = np.pad(codes, ((0, lanes - rows), (0, 0)))
        n = np.pad(n, (0, lanes - rows))
        seen = _both(codes, n).astype(np.intp)
        h = self.hidden
        state = np.zeros((2, h, lanes), np.float32)
        said = np.zeros((2, steps, self.classes, lanes), np.float32)
        wide = lanes
        x, g, room = (np.empty((2, 3 * h, lanes), np.float32) for _ in range(3))
        for t in range(steps):
            need = -(-int(np.count_nonzero(n > t)) // 32) * 32
            if need < wide:
                wide, state = need, np.ascontiguousarray(state[..., :need])
                x, g, room = (np.empty((2, 3 * h, need), np.float32) for _ in range(3))
            if not wide:
                break
            for d in (0, 1):
                np.take(self.table[d], seen[d, t, :wide], axis=1, out=x[d], mode="clip")
            np.matmul(self.inner, state, out=g)
            gate, cand = x[:, :2 * h], g[:, 2 * h:]
            gate += g[:, :2 * h]
            _squashed(gate, room[:, :2 * h])
            gate *= 0.5
            gate += 0.5
            cand *= gate[:, h:]
            cand += x[:, 2 * h:]
            _squashed(cand, room[:, 2 * h:])
            state -= cand
            state *= gate[:, :h]
            state += cand
            said[:, t, :, :wide] = np.matmul(self.out, state)
        back = np.where(np.arange(steps)[:, None] < n, n - 1 - np.arange(steps)[:, None], 0)
        both = said[0] + np.take_along_axis(said[1], back[:, None, :], 0) + self.bias[:, None]
        return both[..., :rows]

    def windows(self, data: np.ndarray, off: np.ndarray):
        """Blocks of windows: (text, start, end, probabilities (steps, classes, windows), voting (steps, windows), first own step)."""
        size = np.diff(off)
        count = -(-size // WINDOW)
        text = np.repeat(np.arange(len(size)), count)
        start = off[text] + WINDOW * (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count))
        end = np.minimum(start + WINDOW, off[text + 1])
        lo, hi = np.maximum(start - CONTEXT, off[text]), np.minimum(end + CONTEXT, off[text + 1])
        order = np.argsort(lo - hi, kind="stable")
        lower = LOWER[data]
        for i in range(0, len(order), BLOCK):
            w = order[i:i + BLOCK]
            n = hi[w] - lo[w]
            at = lo[w][:, None] + np.arange(int(n[0]))
            codes = np.where(at < hi[w][:, None], lower[np.minimum(at, len(data) - 1)], 0)
            p = self.logits(codes, n)
            p -= p.max(1, keepdims=True)
            np.exp(p, out=p)
            p /= p.sum(1, keepdims=True)
            own = (at >= start[w][:, None]) & (at < end[w][:, None])
            yield text[w], lo[w], p, (own & _LETTER[codes]).T, own.T

    def judge(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: the mean probabilities of its letters' positions, their number, and how often each label is a position's own."""
        total, labels = (np.zeros((len(off) - 1, self.classes)) for _ in range(2))
        letters = np.zeros(len(off) - 1)
        parts = []
        for text, lo, p, vote, _ in self.windows(data, off):
            best = p.argmax(1)
            parts.append((text, lo, (p * vote[:, None]).sum(0, dtype=np.float64).T,
                          np.stack([((best == k) & vote).sum(0) for k in range(self.classes)], 1), vote.sum(0)))
        if parts:
            text, lo, some, own, n = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(lo, kind="stable")              # a text's windows always add up in one order
            np.add.at(total, text[order], some[order])
            np.add.at(labels, text, own)
            np.add.at(letters, text, n)
        return total / np.maximum(letters, 1)[:, None], letters, labels

    def labels(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """The label of every byte."""
        out = np.zeros(len(data), np.int64)
        for _, lo, p, _, own in self.windows(data, off):
            at = lo + np.arange(len(p))[:, None]
            out[at[own]] = p.argmax(1)[own]
        return out


def _letters(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def train(docs: DataFrame, folds: int = 4, held_out: int = 2, max_windows: int = 12_000, per_doc: int = 2, hidden: int = 16, passes: int = 12) -> Network | None:
    """Fit on the rows whose crc32 fold isn't ``held_out``; None if there is nothing to learn from."""
    known = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where(
        F.col("lang").isNotNull() & (crc_fold(F.col("doc_id"), folds) != held_out) & _letters(F.col("text")))
    kinds = known.groupBy("lang").agg(F.count("*").alias("n"))               # a row for each language
    kinds = [(r.lang, r.n) for r in kinds.collect()]
    if not kinds:
        return None
    per_lang = max(1, max_windows // per_doc // len(kinds))
    # by the hash, about four times the rows wanted of each language are looked at, however many there are
    share = [(k, min(1.0, (4 * per_lang + 100) / n)) for k, n in kinds]
    chance = F.element_at(F.create_map(*[F.lit(x) for pair in share for x in pair]), F.col("lang"))
    known = known.where((F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)) < chance)
    room = F.greatest(F.lit(1), F.length("text") - STEPS + 1)
    cut = F.array(*[F.substring("text", (F.pmod(F.xxhash64(F.lit(j), "doc_id"), room) + 1).cast("int"), F.lit(STEPS)) for j in range(per_doc)])
    rank = F.row_number().over(Win.partitionBy("lang").orderBy("key", "doc_id", "cut"))
    # at most max_windows pieces (one for each language at least) come to the driver
    rows = known.select("lang", F.xxhash64("doc_id").alias("key"), "doc_id", cut.alias("cut")).withColumn("rank", rank).where(
        F.col("rank") <= per_lang).select("lang", "rank", "cut").toArrow().sort_by([("lang", "ascending"), ("rank", "ascending")])
    langs = sorted(set(rows["lang"].to_pylist()))
    texts = [(x.encode(), k) for k, c in zip(rows["lang"].to_pylist(), rows["cut"].to_pylist()) for x in c]
    return fit([t for t, _ in texts], np.array([langs.index(k) for _, k in texts]), langs, hidden, passes)


def identified(docs: DataFrame, net: Network | None, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct column ``language``: lang, score (the pooled probability) and share (of the letters' positions
    that have this label themselves)."""
    none = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"), F.lit(0.0).alias("share"))
    if net is None:
        return docs.withColumn("language", none)
    shared = docs.sparkSession.sparkContext.broadcast((net.langs, Reader(net)))        # a fixed number of weights

    def judge(data, off):
        langs, reader = shared.value
        p, letters, labels = reader.judge(data, off)
        best = p.argmax(1)
        at = np.arange(len(best))
        return struct_array(lang=pa.array(langs, pa.string()).take(pa.array(best)), score=pa.array(np.clip(np.round(p[at, best], 5), 0, 1)),
                            share=pa.array(labels[at, best] / np.maximum(letters, 1)))

    found = text_udf(judge, "struct<lang: string, score: double, share: double>")(F.col(text_col))
    return docs.withColumn("language", F.when(_letters(F.col(text_col)), found).otherwise(none))


def spans(docs: DataFrame, net: Network, text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``language_spans``: the runs of bytes (start, end, lang) whose positions have one label."""
    shared = docs.sparkSession.sparkContext.broadcast((net.langs, Reader(net)))

    def label(data, off):
        langs, reader = shared.value
        got = reader.labels(data, off)
        new = np.append(True, got[1:] != got[:-1]) if len(got) else np.zeros(0, bool)
        new[off[:-1][off[:-1] < len(got)]] = True
        first = np.flatnonzero(new)
        text = np.searchsorted(off, first, "right") - 1
        end = np.minimum(np.append(first[1:], len(got)), off[text + 1]) if len(first) else first
        rows = struct_array(start=pa.array(first - off[text]), end=pa.array(end - off[text]), lang=pa.array(langs, pa.string()).take(pa.array(got[first])))
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(first, off), pa.int32()), rows)

    return docs.withColumn("language_spans", text_udf(label, "array<struct<start: bigint, end: bigint, lang: string>>")(F.col(text_col)))

"""Secret scans: fixed patterns, and a guess-cost model for values in a credential context.

Base patterns (assign, access, hex) are matched over each whole text. The method
adds spans of kind ``guess``: values that stand in a wider credential context
(names that contain passphrase, credential, access key ..., bearer tokens, connection
strings) whose cheapest segmentation takes at least ``min_log10`` (decimal digits
of) guesses, whatever their length. The cost of a value is found by dynamic
programming over its characters: each piece is a common word (with the cost of its
rank, capitals and look-alike digits), a date, a repeat, a walk over neighbouring
keys, or a brute-force span; the costs of the pieces multiply.

The common words are a fixed list of password words and the most frequent words of
the texts, counted by Spark: those of 3 to 20 letters that occur ``LEAST_COUNT``
times or more, at most ``MOST_WORDS``, without the values that would be spans by the
fixed list alone (so that copies of a secret don't make it a word).

Texts without any of the keywords or patterns' fixed parts are passed over by
plain substring tests, which can't lose a match. Null and empty texts have no
spans. Repeated rows are scanned alike. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, text_chunks, text_udf, word_spans

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Contexts beyond the base patterns: a name that contains a keyword (an author is none), or a connection string; the value,
#: looked ahead at, is group 1 or 2.
CONTEXT = re.compile(
    r"""(?i:(?<![A-Za-z0-9_])(?>[A-Za-z0-9_]*?(?:pass|pwd|secret|token|api_?key|access_?key|private_?key|auth(?!or(?!i))|credential|bearer))[A-Za-z0-9_]*+)"""
    r"""["']?\x20*(?:[:=]+>?|\bis\b)\x20*(?:(?i:bearer|basic)\x20+)?["']?(?=([^\s"'<>,;]+))"""
    r"""|://[^\s/:@]*+:(?=([^\s/@]+)@)""", re.ASCII)
HINTS = ("pass", "pwd", "secret", "token", "key", "auth", "credential", "bearer", "://")

#: Common password words, from the most common.
WORDS = {w: i + 1 for i, w in enumerate((
    "password", "admin", "secret", "letmein", "welcome", "monkey", "dragon", "master", "login", "test", "user", "root", "hello",
    "love", "pass", "access", "token", "key", "example", "default", "change", "changeme", "qwerty", "abc", "god", "sunshine",
    "shadow", "football", "baseball", "princess", "superman", "batman", "summer", "winter", "spring", "autumn", "monday",
    "your", "here", "none", "null", "true", "false", "enter", "insert", "value", "string", "placeholder", "redacted", "hidden"))}
LEET = str.maketrans("@4301!$57", "aaeoiisst")
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
NEAR = {a: {ROWS[r + dr][c + dc] for dr in (-1, 0, 1) for dc in (-1, 0, 1) if (dr or dc) and 0 <= r + dr < len(ROWS) and 0 <= c + dc < len(ROWS[r + dr])}
        for r, row in enumerate(ROWS) for c, a in enumerate(row)}
DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])(?:[-/._]?(?:0[1-9]|[12]\d|3[01]))?)?$|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:(?:19|20)\d\d|\d\d)$")
MAX_WORD = 20
MOST_WORDS, LEAST_COUNT = 50_000, 5
_WORD = re.compile(r"(?<![^\W\d_])[^\W\d_]{3,20}(?![^\W\d_])")
#: A rejected value is searched again for names from here before its end, or from the start of a name that lies across that place.
NAME = 64


def _word_cost(s: str, low: str, plain: str, ranks: dict[str, int]) -> float | None:
    rank = ranks.get(low) or ranks.get(plain)
    if rank is None:
        return None
    cost = math.log10(rank + 1)
    caps = sum(c.isupper() for c in s)
    if caps:
        cost += math.log10(2) if s[0].isupper() and caps == 1 or caps == len(s) else math.log10(max(2, math.comb(len(s), caps)))
    return cost + (math.log10(2) * sum(a != b for a, b in zip(low, plain)) if low not in ranks else 0)


def guess_cost(value: str, ranks: dict[str, int] = WORDS) -> float:
    """log10 of the guesses of the cheapest segmentation of ``value``: best[j] is that of its first j characters."""
    low = "".join(x if len(x := c.lower()) == 1 else c for c in value)
    plain = low.translate(LEET)
    space = sum(size for size, test in ((26, str.islower), (26, str.isupper), (10, str.isdigit)) if any(map(test, value)))
    brute = math.log10(max(10, space + (33 if any(not c.isalnum() for c in value) else 0)))
    best = [0.0]
    run = walk = 1
    same = [0] * 9                                                     # characters, up to here, equal to those p before
    for j in range(1, len(value) + 1):
        if j > 1:
            run = run + 1 if value[j - 1] == value[j - 2] else 1
            walk = walk + 1 if low[j - 1] in NEAR.get(low[j - 2], ()) or low[j - 1].isalnum() and ord(low[j - 1]) - ord(low[j - 2]) == 1 else 1
        cost = best[j - 1] + brute                                     # brute force, one character more
        for i in range(max(0, j - MAX_WORD), j - 2):
            if (c := _word_cost(value[i:j], low[i:j], plain[i:j], ranks)) is not None:
                cost = min(cost, best[i] + c + math.log10(2))
        for i in range(max(0, j - 10), j - 3):
            if DATE.match(value[i:j]):
                cost = min(cost, best[i] + math.log10(365 * 120 if j - i > 4 else 120))
        for k, step in ((run, 0.0), (walk, math.log10(2))):            # a repeat of, or a walk from, one character
            if k >= 3:
                cost = min(cost, best[j - k] + brute + math.log10(k) + step * (k - 1))
        for p in range(2, min(8, j - 1) + 1):                          # a repeat of a longer unit
            same[p] = same[p] + 1 if value[j - 1] == value[j - 1 - p] else 0
            if (k := same[p] // p) and same[p] % p == 0:
                cost = min(cost, best[j - k * p] + math.log10(k + 1))
        best.append(cost)
    return best[-1]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the fixed patterns."""
    got = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    got += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    got += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(got, key=lambda x: (x[0], x[2]))


def _name_start(text: str, a: int, z: int) -> int:
    """Where the search for names goes on in a rejected value: ``NAME`` characters before its end, but not within a name."""
    at = max(a, z - NAME)
    while at > a and (text[at - 1] == "_" or text[at - 1].isascii() and text[at - 1].isalnum()):
        at -= 1
    return at


def in_context(text: str, min_log10: float, cost=guess_cost) -> list[tuple[int, int, float]]:
    """(start, end, cost) of the values in credential context. A value below ``min_log10`` may itself be a name, so the search
    goes on within it; a name at the end of a long one, of up to ``NAME`` characters, is found too."""
    got, at = [], 0
    while m := CONTEXT.search(text, at):
        a, z = m.span(1 if m[1] is not None else 2)
        got.append((a, z, c := cost(text[a:z].rstrip("."))))
        at = z if c >= min_log10 else _name_start(text, a, z)
    return got


def _words_of(part: bytes, min_log10: float, cost) -> list[str]:
    """The words of a text, in lower case, without the values that are spans by the fixed list."""
    text, low = part.decode(), part.lower()
    if any(h in low for h in _HINTS):
        for a, z, c in reversed(in_context(text, min_log10, cost)):
            if c >= min_log10:
                text = f"{text[:a]} {text[z:]}"
    return _WORD.findall(text.lower())


def word_ranks(docs: DataFrame, min_log10: float = 9.0, text_col: str = "text") -> dict[str, int]:
    """Ranks of the fixed words and of the most frequent words of the texts; whole classes of like counts, so that ties don't
    matter, of ``MOST_WORDS`` words at most."""

    def count(batches):
        cost, n = lru_cache(maxsize=4096)(guess_cost), Counter()
        for _, data, off in text_chunks(batches):
            raw = data.tobytes()
            for a, z in zip(off[:-1].tolist(), off[1:].tolist()):
                n.update(_words_of(raw[a:z], min_log10, cost))
            if len(n) > 200_000:
                yield pa.RecordBatch.from_pydict({"word": pa.array(n.keys(), pa.string()), "n": pa.array(n.values(), pa.int64())})
                n.clear()
        yield pa.RecordBatch.from_pydict({"word": pa.array(n.keys(), pa.string()), "n": pa.array(n.values(), pa.int64())})

    texts = docs.select(F.lit(0).alias("i"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"))
    counts = texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)
    counts = staged(counts.withColumn("like", F.floor(8 * F.log2("n")).cast("int")), "word-counts")
    least, held = None, 0
    for r in sorted(counts.groupBy("like").count().collect(), key=lambda r: -r["like"]):      # a few hundred classes
        held += r["count"]
        if held > MOST_WORDS:
            break
        least = r["like"]
    often = [] if least is None else sorted((-r.n, r.word) for r in counts.where(F.col("like") >= least).select("word", "n").collect())
    ranks = {w: i + 1 for i, (_, w) in enumerate(often)}
    return ranks | {w: min(k, ranks.get(w, k)) for w, k in WORDS.items()}


_HEX_BYTES = np.zeros(256, bool)
_HEX_BYTES[[*range(0x30, 0x3A), *range(0x61, 0x67)]] = True


def _hex_runs(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Which texts hold a run of 32 hexadecimal digits."""
    starts, ends, _ = word_spans(data, off, _HEX_BYTES)          # runs end at text borders
    out = np.zeros(len(off) - 1, bool)
    out[np.searchsorted(off, starts[ends - starts >= 32], "right") - 1] = True
    return out


def _spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for a, z, k in spans)


SCHEMA = "struct<n_assign: bigint, n_access: bigint, n_hex: bigint, n_guess: bigint, base_spans: string, spans: string, max_log10: double>"


def secrets(docs: DataFrame, name: str = "secrets", min_log10: float = 9.0, text_col: str = "text", ranks: dict[str, int] | None = None) -> DataFrame:
    """``docs`` with a struct of counts by kind, the base spans, all spans (``kind:start:end``, by start, then kind) and
    the highest guess cost of a value in credential context (null: no such value). Without ``ranks``, those of the words of
    ``docs`` are counted first."""
    words = docs.sparkSession.sparkContext.broadcast(word_ranks(docs, min_log10, text_col) if ranks is None else ranks)

    def scan(data, off):
        raw = data.tobytes()
        hexes = _hex_runs(data, off)
        price = lru_cache(maxsize=4096)(partial(guess_cost, ranks=words.value))
        cols: list[list] = [[] for _ in range(7)]
        for k, (a, z) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
            part = raw[a:z]
            low = part.lower()
            hint = any(h in low for h in _HINTS)
            base, more, cost = [], [], None
            if hint or hexes[k] or b"AKIA" in part:
                text = part.decode()
                base = base_spans(text)
                if hint:
                    values = in_context(text, min_log10, price)
                    more = [(x, y, 3) for x, y, c in values if c >= min_log10]
                    cost = max((c for *_, c in values), default=None)
            every = sorted([*base, *more], key=lambda x: (x[0], x[2]))
            for c, v in zip(cols, (*(sum(x[2] == i for x in every) for i in range(4)), _spans(base), _spans(every), cost)):
                c.append(v)
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        names = ["n_assign", "n_access", "n_hex", "n_guess", "base_spans", "spans", "max_log10"]
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

    return docs.withColumn(name, text_udf(scan, SCHEMA)(F.col(text_col)))


_HINTS = [h.encode() for h in HINTS]


def sha256_hex(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()

"""Grouping of spelling variants by permuterm rotations.

Every word gets a terminator, and all rotations of the marked word are sorted. Words that differ in one code point share,
after rotation, everything but the last one: with ``P = w[i+1:] + $ + w[:i]`` the rotation that ends in the
edited character is ``P + w[i]``. So the words near ``w`` by an edit at ``i`` are the range of rotations with the
prefix ``P``: those one longer than ``P`` are replacements, and the one equal to ``P`` is ``w`` without that character
(from whose side it is an insertion). A range holds at most one rotation for each character of the alphabet and one
more; a scan of the sorted rotations gives each of its words the number of the others and the most frequent of them, so
that no pairs are ever listed. A pair that an edit relates in several places (a character of a run of equal ones) is counted
where the character before it differs.

Rotations are dealt by their prefix and sorted within partitions. A prefix of over ``PLAIN`` code points is replaced by
its length and a 127-bit polynomial hash modulo a prime, which all prefixes of a word share the work for, so that long words cost
their length and not its square.

A word's ``form`` is its near word of the largest count (ties: the least in code-point order) if that is at least ``ratio``
times its own; ``root`` follows forms to the last one, by pointer doubling: counts grow by the factor ``ratio`` with each form, which
bounds the rounds.

Nulls: a null text has no words; a null id counts as the empty text in the damage rule. Repeated rows and ids count each time. An
empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MARK = "$"
PLAIN = 64
PRIME, BASE = 2**127 - 1, 0x2F0B4C7D9A3E5161B82D47C6F1093A57


def occurrences(docs: DataFrame, least: int, damage: int | None = None) -> DataFrame:
    """(word): every run of letters with ``least`` or more code points, in lower case; with ``damage``, a run whose
    crc32 of ``doc_id:run`` it divides has lost one code point."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"),
                       F.explode(F.regexp_extract_all("text", F.lit(f"[A-Za-zÀ-ÿ]{{{least},}}"), F.lit(0))).alias("run"))
    run = runs.select("doc", F.translate("run", UPPER, SMALL).alias("word"))
    if not damage:
        return run.select("word")
    h = run.select("word", F.crc32(F.concat("doc", F.lit(":"), "word").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("word")).cast("int")
    less: Column = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
    return h.select(F.when(F.col("h") % damage == 0, less).otherwise(F.col("word")).alias("word")).where(F.length("word") >= least)


def vocabulary(words: DataFrame, least_count: int) -> DataFrame:
    """(id, word, n): the distinct words seen often enough, numbered in code-point order; written once."""
    n = words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)
    return staged(n.repartitionByRange("word").sortWithinPartitions("word").select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")


def prefixes(word: str, plain: int = PLAIN) -> Iterator[tuple[str, int]]:
    """(prefix, kind) of a word's rotations: kind 0 for a whole rotation as the prefix of longer ones, 1 for a rotation
    without its last character, 2 if the character before that one equals it."""
    n = len(word)
    if n < plain:                                              # the longest prefix has n + 1 code points
        yield from ((word[i:] + MARK + word[:i], 0) for i in range(n + 1))
        yield from ((word[i + 1:] + MARK + word[:i], 2 if i and word[i] == word[i - 1] else 1) for i in range(n))
        return
    head, power = [0], [1]
    for c in word:
        head.append((head[-1] * BASE + ord(c) + 1) % PRIME)
        power.append(power[-1] * BASE % PRIME)

    def rotated(i: int, j: int) -> int:
        """Hash of word[i:] + MARK + word[:j]."""
        tail = head[n] - head[i] * power[n - i]
        return ((tail * BASE + ord(MARK) + 1) * power[j] + head[j]) % PRIME

    def key(i: int, j: int) -> str:
        size = n - i + 1 + j
        return word[i:] + MARK + word[:j] if size <= plain else f"{size}:{rotated(i, j):x}"

    yield from ((key(i, i), 0) for i in range(n + 1))
    yield from ((key(i + 1, i), 2 if i and word[i] == word[i - 1] else 1) for i in range(n))


def _rotations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("prefix", pa.string()), ("kind", pa.int8()), ("id", pa.int64()), ("n", pa.int64())])
    keys: list[str] = []
    kinds, ids, counts = [], [], []

    def flush() -> pa.RecordBatch:
        out = pa.record_batch([pa.array(keys, pa.string()), pa.array(kinds, pa.int8()), pa.array(ids, pa.int64()), pa.array(counts, pa.int64())], schema=schema)
        for x in (keys, kinds, ids, counts):
            x.clear()
        return out

    for b in batches:
        for i, word, n in zip(*(c.to_pylist() for c in b.columns)):
            for key, kind in prefixes(word):
                keys.append(key)
                kinds.append(kind)
                ids.append(i)
                counts.append(n)
                if len(keys) == 1 << 15:
                    yield flush()
    yield flush()


def scan(group: np.ndarray, kind: np.ndarray, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(id, near, best_n, best_id) of the members of ranges with company; ``group`` numbers the ranges, in order."""
    order = np.lexsort((ids, -n, group))
    group, kind, ids, n = group[order], kind[order], ids[order], n[order]
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.empty(0, np.int64)
    size = np.diff(np.append(first, len(group)))
    at = np.repeat(np.arange(len(first)), size)
    per = lambda mask: np.add.reduceat(mask.astype(np.int64), first)[at] if len(first) else mask.astype(np.int64)
    edited, sure, whole = per(kind > 0), per(kind == 1), per(kind == 0)
    near = np.where(kind == 0, sure, edited - 1 + (kind == 1) * whole)
    some = size[at] > 1
    best = np.where(np.arange(len(group)) == first[at], np.minimum(first[at] + 1, max(len(group) - 1, 0)), first[at])
    return ids[some], near[some], n[best][some], ids[best][some]


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The scan of sorted rotations: the last range of a batch waits for the next one."""
    held: list[pa.RecordBatch] = []

    def done(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts)
        group = np.asarray(pc.dictionary_encode(t["prefix"].combine_chunks()).indices)
        out = scan(group, *(np.asarray(t[c]) for c in ("kind", "id", "n")))
        return pa.record_batch([pa.array(x, pa.int64()) for x in out], names=["id", "near", "best_n", "best_id"])

    for b in batches:
        if not b.num_rows:
            continue
        code = np.asarray(pc.dictionary_encode(b["prefix"]).indices)
        cut = int(np.flatnonzero(code == code[-1])[0])
        if cut == 0 and held and held[-1]["prefix"][-1].as_py() == b["prefix"][0].as_py():
            held.append(b)
            continue
        yield done([*held, b.slice(0, cut)])
        held = [b.slice(cut)]
    if held:
        yield done(held)


def near_words(words: DataFrame) -> DataFrame:
    """(id, n_near, best_n, best_id) of the words that have a word one edit away."""
    rotations = words.select("id", "word", "n").mapInArrow(_rotations, "prefix string, kind byte, id long, n long")
    found = rotations.repartition("prefix").sortWithinPartitions("prefix").mapInArrow(_ranges, "id long, near long, best_n long, best_id long")
    best = F.max(F.struct(F.col("best_n").alias("n"), (-F.col("best_id")).alias("back")))
    return found.groupBy("id").agg(F.sum("near").alias("n_near"), best.alias("best")).select(
        "id", "n_near", F.col("best.n").alias("best_n"), (-F.col("best.back")).alias("best_id"))


def variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of a vocabulary."""
    near = staged(near_words(words), "near")
    linked = words.join(near, "id", "left")
    forms = staged(linked.where(F.col("best_n") >= ratio * F.col("n")).select("id", F.col("best_id").alias("form")), "forms")
    most = words.agg(F.max("n")).first()[0] or 1
    longest = max(1, math.floor(math.log(most, ratio)) + 1)        # forms that can follow one another
    last = forms.withColumnRenamed("form", "root")
    for _ in range(math.ceil(math.log2(longest))):
        further = last.select(F.col("id").alias("root"), F.col("root").alias("next"))
        last = staged(last.join(further, "root", "left").select("id", F.coalesce("next", "root").alias("root")), "roots")
    spelled = words.select("id", "word", "n")
    ends = forms.join(last, "id").join(spelled.select(F.col("id").alias("form"), F.col("word").alias("form_word"), F.col("n").alias("form_n")), "form"
                                       ).join(spelled.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root")
    return words.join(near.select("id", "n_near"), "id", "left").join(ends.select("id", "form_word", "root_word", "form_n"), "id", "left").select(
        "word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


def spelling_variants(docs: DataFrame, least: int = 7, least_count: int = 2, ratio: int = 10, damage: int | None = None) -> DataFrame:
    return variants(vocabulary(occurrences(docs, least, damage), least_count), ratio)

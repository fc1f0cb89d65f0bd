"""Text chunking (M1, M2, M8).

* ``fixed_chunks`` — fixed-stride windows with overlap, a pure JVM expression.
* ``recursive_chunks`` — separator-aware splitting (paragraphs, lines, words,
  characters) with overlap, as one fold over the pieces of a text.
* ``pack_sentences`` — greedy packing of ``.``-separated sentences into blocks
  of at most 1800 characters, as one ``aggregate`` with a struct accumulator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Separator order of the recursive splitter (last: single characters).
SEPARATORS = ["\n\n", "\n", " "]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fixed_chunks(text, size: int, overlap: int) -> Column:
    """M1 (fixed stride): ``array<struct(chunk_no, text)>``; windows of ``size`` every ``size - overlap``.

    The last window ends at the end of the text; an empty text has no chunk.
    """
    t = _c(text)
    stride = size - overlap
    n = F.lit(1) + F.ceil(F.greatest(F.length(t) - size, F.lit(0)) / F.lit(stride)).cast("int")
    n = F.when(F.coalesce(F.length(t), F.lit(0)) == 0, F.lit(0)).otherwise(n)
    idx = F.sequence(F.lit(0), n - 1)
    return F.when(n == 0, F.array().cast("array<struct<chunk_no:int,text:string>>")).otherwise(
        F.transform(idx, lambda i: F.struct(i.alias("chunk_no"), F.substring(t, i * stride + 1, size).alias("text"))))


def explode_chunks(df: DataFrame, key: str, text: str, size: int, overlap: int) -> DataFrame:
    """One row per fixed-stride chunk: ``(key, chunk_no, chunk)``."""
    return (df.select(key, F.explode(fixed_chunks(text, size, overlap)).alias("_c"))
            .select(key, F.col("_c.chunk_no").alias("chunk_no"), F.col("_c.text").alias("chunk")))


# ---------------------------------------------------------------- separator-aware splitter
def separator_pieces(text, size: int, overlap: int) -> Column:
    """The text cut into pieces of at most ``size`` characters: at paragraph ends, where a piece is still too long at
    line ends, then after spaces, then every few characters. Separators stay at the end of their piece, so the pieces
    joined are the text."""
    finest = "(?s).{1,%d}" % min(size, max(1, overlap))
    patterns = [f"(?s).*?{sep}|.+" for sep in SEPARATORS] + [finest]

    def cut(t: Column, level: int) -> Column:
        parts = F.regexp_extract_all(t, F.lit(patterns[level]), F.lit(0))
        if level == len(patterns) - 1:
            return parts
        return F.flatten(F.transform(parts, lambda p: F.when(F.length(p) <= size, F.array(p)).otherwise(cut(p, level + 1))))

    return cut(F.coalesce(_c(text), F.lit("")), 0)


def separator_chunks(text, size: int, overlap: int) -> Column:
    """M1 (separator-aware): ``array<struct(chunk_no, text)>``, one fold over the pieces.

    A chunk takes pieces while it holds at most ``size`` characters. The next
    one starts at the first piece of the last ``overlap`` characters that still
    leaves room for the piece that didn't fit, or at that piece. The state holds
    the finished spans, the open span and the starts of the pieces within the
    overlap; an empty text has no chunk.
    """
    span = "array<struct<a:int,z:int>>"
    start = F.struct(F.array().cast(span).alias("done"), F.lit(0).alias("a"), F.lit(0).alias("z"), F.array().cast("array<int>").alias("tail"))

    def step(st, piece):
        end = st["z"] + F.length(piece)
        fits = end - st["a"] <= size
        room = F.filter(st["tail"], lambda b: (end - b <= size) & (b > st["a"]))
        return F.struct(
            F.when(fits, st["done"]).otherwise(F.concat(st["done"], F.array(F.struct(st["a"].alias("a"), st["z"].alias("z"))))).alias("done"),
            F.when(fits, st["a"]).otherwise(F.coalesce(F.get(room, F.lit(0)), st["z"])).alias("a"),
            end.alias("z"),
            F.filter(F.concat(st["tail"], F.array(st["z"])), lambda b: end - b <= overlap).alias("tail"))

    def finish(st):
        return F.when(st["z"] > st["a"], F.concat(st["done"], F.array(F.struct(st["a"].alias("a"), st["z"].alias("z"))))).otherwise(st["done"])

    spans = F.aggregate(separator_pieces(text, size, overlap), start, step, finish)
    return F.transform(spans, lambda x, n: F.struct(n.alias("chunk_no"), F.substring(_c(text), x["a"] + 1, x["z"] - x["a"]).alias("text")))


def recursive_chunks(df: DataFrame, key: str, text: str, size: int, overlap: int) -> DataFrame:
    """M1 (separator-aware): ``(key, chunk_no, chunk)`` rows."""
    return (df.select(key, F.explode(separator_chunks(text, size, overlap)).alias("_c"))
            .select(key, F.col("_c.chunk_no").alias("chunk_no"), F.col("_c.text").alias("chunk")))


# ---------------------------------------------------------------- sentence packing (JVM aggregate)
def pack_sentences(text, limit: int = 1800) -> Column:
    """M2/K7: greedy blocks of ``.``-separated sentences, sizes without separators, joined with ``". "``.

    An oversized first sentence yields an empty first block (trap Q16).
    """
    parts = F.split(F.coalesce(_c(text), F.lit("")), r"\.", -1)
    acc0 = F.struct(F.array().cast("array<string>").alias("blocks"), F.array().cast("array<string>").alias("cur"),
                    F.lit(0).alias("size"))

    def step(acc, s):
        new_size = acc["size"] + F.length(s)
        fits = new_size <= limit
        return F.struct(
            F.when(fits, acc["blocks"]).otherwise(F.concat(acc["blocks"], F.array(F.array_join(acc["cur"], ". "))))
            .alias("blocks"),
            F.when(fits, F.concat(acc["cur"], F.array(s))).otherwise(F.array(s)).alias("cur"),
            F.when(fits, new_size).otherwise(F.length(s)).alias("size"))

    return F.aggregate(parts, acc0, step, lambda acc: F.concat(acc["blocks"], F.array(F.array_join(acc["cur"], ". "))))


def pack_sentences_py(text: str, limit: int = 1800) -> list[str]:
    """Brute-force reference of ``pack_sentences`` for tests."""
    blocks, cur, size = [], [], 0
    for s in text.split("."):
        if size + len(s) <= limit:
            size += len(s)
            cur.append(s)
        else:
            blocks.append(". ".join(cur))
            cur, size = [s], len(s)
    blocks.append(". ".join(cur))
    return blocks


# ---------------------------------------------------------------- chunk index (M8)
def chunk_index(chunks: DataFrame, key: str) -> DataFrame:
    """M8: chunk id = md5 of the chunk text; equal text -> one entry (first doc/chunk kept).

    A hash aggregate on the id, so repeated passages (a hot id) combine map-side.
    """
    c = chunks.withColumn("chunk_id", F.md5("chunk"))
    return c.groupBy("chunk_id").agg(F.min(F.struct(key, "chunk_no")).alias("_first"),
                                     F.first("chunk").alias("chunk"),  # equal for equal ids
                                     F.count(F.lit(1)).alias("n_copies")) \
            .select("chunk_id", F.col(f"_first.{key}").alias(key), F.col("_first.chunk_no").alias("chunk_no"),
                    "chunk", "n_copies")

"""Model enrichment.

Models are plug-ins behind two tiny protocols and run through iterator
pandas UDFs: only the input column crosses to Python (Arrow batches), the
model is built once per task, and everything around the call (gates, cache
join, parsing, unions) stays in the JVM.  Expensive calls only ever see the
rows that need them: gates and the read-through cache are applied first.

The offline stand-ins are deterministic and SQL-expressible (md5 based), which
is what lets the caching, gating and fallback logic be checked by an oracle.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedsift.functions.text import parse_rank
from feedsift.operators.chunking import recursive_chunks
from feedsift.operators.common import spread
from feedsift.operators.filters import rank_gate
from feedsift.settings import DEFAULT, Settings


# ---------------------------------------------------------------- protocols
class TextModel(Protocol):
    name: str

    def generate(self, texts: list[str]) -> list[str]: ...


class Embedder(Protocol):
    name: str
    dim: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


def _md5(s: str) -> str:
    return hashlib.md5(s.encode("utf-8")).hexdigest()


class DigestModel:
    """Stand-in text model: ``prefix + md5(text)`` (empty text -> empty answer)."""

    def __init__(self, prefix: str = "S:", name: str = "digest"):
        self.prefix, self.name = prefix, name

    def generate(self, texts: list[str]) -> list[str]:
        return ["" if not t else self.prefix + _md5(t) for t in texts]

    def reader(self) -> "_DigestReader":
        """A text read part by part: ``read`` takes the parts, ``answer`` is that of ``generate`` for all of them."""
        return _DigestReader(self.prefix)


class _DigestReader:
    def __init__(self, prefix: str):
        self.prefix, self.digest, self.any = prefix, hashlib.md5(), False

    def read(self, part: str) -> None:
        self.any = self.any or bool(part)
        self.digest.update(part.encode("utf-8"))

    def answer(self) -> str:
        return self.prefix + self.digest.hexdigest() if self.any else ""


class RankModel:
    """Stand-in classifier: a JSON rank answer derived from the text's md5 and length."""

    name = "rank-digest"

    def generate(self, texts: list[str]) -> list[str]:
        out = []
        for t in texts:
            h = _md5(t or "")
            n = len(t or "")
            out.append('{"feedback": "fb-%s", "topics": [{"topic": "t%s", "category": "c%s", "score": 0.%d}], '
                       '"overall_score": %s}' % (h[:6], h[6:8], h[8], n % 10, f"{(n % 11) / 10:.1f}"))
        return out


class EmptyModel:
    """Stand-in primary model that answers nothing for texts whose md5 starts with a digit."""

    name = "flaky"

    def generate(self, texts: list[str]) -> list[str]:
        return ["" if _md5(t or "")[0].isdigit() else "P:" + _md5(t or "") for t in texts]


def with_retry(fn: Callable[[], object], tries: int = 3, wait: float = 5.0, sleep=time.sleep):
    """M7: call ``fn`` up to ``tries`` times, waiting ``wait`` seconds between tries; re-raise the last error."""
    last = None
    for i in range(tries):
        try:
            return fn()
        except Exception as e:  # noqa: BLE001 - a provider error of any kind is retried
            last = e
            if i + 1 < tries:
                sleep(wait)
    raise last  # type: ignore[misc]


def _answers(model: TextModel, vals: list[str], tries: int, wait: float) -> tuple[list[str | None], list[str | None]]:
    """(answers, errors): one call for the whole batch; if that fails, one call per text, each with its own retries."""
    try:
        return list(model.generate(vals)), [None] * len(vals)
    except Exception:  # noqa: BLE001 - a provider error of any kind is isolated below
        pass
    out: list[str | None] = []
    errors: list[str | None] = []
    for v in vals:
        try:
            out.append(with_retry(lambda v=v: model.generate([v])[0], tries, wait))
            errors.append(None)
        except Exception as e:  # noqa: BLE001
            out.append(None)
            errors.append(f"{type(e).__name__}: {e}"[:500])
    return out, errors


def model_attempt(model: TextModel, text: Column, *, tries: int = 3, wait: float = 5.0) -> Column:
    """``struct(answer, error)`` per row (Arrow batches): a failing text has an error and no answer, and
    neither repeats nor stops the calls of the other rows."""

    @F.pandas_udf("struct<answer:string,error:string>")
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            answers, errors = _answers(model, s.where(s.notna(), "").tolist(), tries, wait)
            yield pd.DataFrame({"answer": pd.Series(answers, dtype=object), "error": pd.Series(errors, dtype=object)})

    return call(text)


def model_call(model: TextModel, text: Column, *, tries: int = 3, wait: float = 5.0) -> Column:
    """The model's answer per row; NULL where the calls for that text failed (``model_attempt`` tells the error)."""
    return model_attempt(model, text, tries=tries, wait=wait)["answer"]


def text_key(text: Column) -> Column:
    """What a text is known by (16 bytes)."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def with_answers(df: DataFrame, model: TextModel, text: str, out: str, *, key: str | None = None, texts: DataFrame | None = None) -> DataFrame:
    """``df`` with the model's answers to ``text``. Those of a model that has a table besides what a task holds (``rest``) are joined.

    For such a model ``df`` is read twice: for the texts (or ``texts`` is, a cheaper table that has them), and for its rows, which don't
    need the text if their column ``key`` has its ``text_key``.
    """
    if getattr(model, "rest", None) is None:
        return df.withColumn(out, model_call(model, F.col(text)))
    mine = text_key(F.col(text))
    said = model.answers((df if texts is None else texts).select(mine.alias("_text_key"), text), "_text_key", text, out)
    said = said.withColumnRenamed("_text_key", "_said_of")
    return df.withColumn("_mine", F.col(key) if key else mine).join(said, F.col("_mine") == F.col("_said_of"), "left").drop("_mine", "_said_of")


def stored_for(model: TextModel, df: DataFrame) -> DataFrame:
    """``df``, checkpointed if ``with_answers`` reads it twice."""
    from feedsift.session import cut_lineage

    return df if getattr(model, "rest", None) is None else cut_lineage(df)


# ---------------------------------------------------------------- read-through cache
def read_through(df: DataFrame, key: str, text: Column, cache: DataFrame, model: TextModel, out: str, *,
                 now=None, cache_key: str = "item_id", value: str = "value",
                 materialise: bool = False) -> tuple[DataFrame, DataFrame]:
    """Cached value on a hit, else call the model; returns (enriched, new cache rows).

    One left join of the whole batch to the (valid) cache; the model runs only
    on the misses; the misses are what gets appended to the cache.  With
    ``materialise`` the computed misses are checkpointed first, so that a caller
    who uses both results pays for each model call once.
    ``cache`` holds ``item_id, value[, expires_at]`` for one (kind, model).
    """
    c = cache
    if now is not None and "expires_at" in cache.columns:
        n = now if isinstance(now, Column) else F.lit(now)
        c = c.where(F.col("expires_at").isNull() | (F.col("expires_at") > n))
    c = c.select(F.col(cache_key).alias("_ck"), F.col(value).alias("_cv"))
    j = df.join(c, df[key] == c["_ck"], "left")
    base = [df[x] for x in df.columns]
    hits = j.where(F.col("_ck").isNotNull()).select(*base, F.col("_cv").alias(out), F.lit(True).alias("from_cache"))
    misses = spread(j.where(F.col("_ck").isNull()).select(*base))
    computed = with_answers(misses.withColumn("_model_text", text), model, "_model_text", out).drop("_model_text").withColumn("from_cache", F.lit(False))
    if materialise:
        from feedsift.session import cut_lineage

        computed = cut_lineage(computed)
    new_rows = computed.select(F.col(key).alias(cache_key), F.col(out).alias(value))
    return hits.unionByName(computed), new_rows


# ---------------------------------------------------------------- map-reduce summary
def mapreduce_summary(df: DataFrame, key: str, text: str, map_model: TextModel, combine_model: TextModel, *,
                      size: int = DEFAULT.summary_chunk, overlap: int = DEFAULT.summary_overlap,
                      out: str = "summary") -> DataFrame:
    """Separator-aware chunks -> model per chunk -> ordered combine per text -> model once more.

    The chunk outputs of one text are re-assembled in chunk order (explicit
    ``chunk_no``; ``collect_list`` order is not relied on).  Whole texts are
    read: a group holds the chunks of one text, bounded by that text's length,
    and never grows with the table.
    """
    src = spread(df.select(key, F.col(text).alias("_t")))
    chunks = recursive_chunks(src, key, "_t", size, overlap)
    mapped = chunks.withColumn("_m", model_call(map_model, F.col("chunk")))
    combined = (mapped.groupBy(key)
                .agg(F.array_sort(F.collect_list(F.struct("chunk_no", "_m"))).alias("_parts"))
                .select(key, F.array_join(F.transform("_parts", lambda p: p["_m"]), "\n\n").alias("_joined")))
    summ = combined.withColumn(out, model_call(combine_model, F.col("_joined"))).select(key, out)
    return df.join(summ, key, "left").withColumn(out, F.coalesce(F.col(out), F.lit("")))


# ---------------------------------------------------------------- classify and rate
def classify_rank(df: DataFrame, key: str, score: str, content: Column, model: TextModel, *,
                  cache: DataFrame | None = None, enabled: bool = True, short_post: bool = False,
                  model_text: Column | None = None, texts: DataFrame | None = None, model_key: str | None = None,
                  settings: Settings = DEFAULT) -> DataFrame:
    """M4: gated rows get default labels and rate -0.02; the others are ranked (cache first) and parsed.

    The gate measures ``content``; the model reads ``model_text`` when given
    (posts measure ``title: text`` but prompt with ``text``, trap Q21), else
    ``content``.  ``model_key`` (a column with the ``text_key`` of what the model reads) and ``texts`` (a table with the columns
    behind that, of these texts and maybe more, that is cheaper to read than ``df``) are for models with a table
    (``with_answers``).  Adds ``topics``, ``categories``, ``rate``, ``feedback``, ``ranked``.
    """
    gated_flag = rank_gate(F.col(score), content, enabled=enabled, settings=settings)
    d = df.withColumn("_content", model_text if model_text is not None else content).withColumn("_gated", gated_flag)
    label = "array<struct<name:string,score:double>>"
    gated = (d.where(F.col("_gated"))
             .withColumn("topics", F.array().cast(label)).withColumn("categories", F.array().cast(label))
             .withColumn("rate", F.lit(settings.gated_rate)).withColumn("feedback", F.lit(""))
             .withColumn("ranked", F.lit(False)))
    todo = d.where(~F.col("_gated"))
    if cache is not None:
        answered, _ = read_through(todo, key, F.col("_content"), cache, model, "_answer")
        answered = answered.drop("from_cache")
    else:
        of = None if texts is None else texts.withColumn("_content", model_text if model_text is not None else content)
        answered = with_answers(todo, model, "_content", "_answer", key=model_key, texts=of)
    p = parse_rank(F.col("_answer"), short_post=short_post, unparsed_rate=settings.unparsed_rate)
    ranked = (answered.withColumn("_p", p)
              .select(*todo.columns, F.col("_p.topics").alias("topics"), F.col("_p.categories").alias("categories"),
                      F.col("_p.rate").alias("rate"), F.col("_p.feedback").alias("feedback"),
                      F.lit(True).alias("ranked")))
    return gated.unionByName(ranked).drop("_content", "_gated")


# ---------------------------------------------------------------- fallback (M6)
def fallback_enrich(df: DataFrame, text: Column, primary: TextModel, fallback: TextModel, out: str, *,
                    tries: int = 3, wait: float = 5.0) -> DataFrame:
    """M6: primary model; an empty or failed answer (and a primary that is not already the fallback) -> fallback model.

    One pandas UDF per Arrow batch calls the primary on every row and the
    fallback only on the rows left without an answer, so neither model runs
    twice on a row. Calls are isolated per text: if both models fail for a text, it
    has no answer and the fallback's error. Adds ``out``, ``used`` (the model that
    answered) and ``error``.
    """
    same = primary.name == fallback.name

    @F.pandas_udf("struct<answer:string,used:string,error:string>")
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            vals = s.where(s.notna(), "").tolist()
            ans, errors = _answers(primary, vals, tries, wait)
            used = [primary.name if e is None else None for e in errors]
            redo = [i for i, a in enumerate(ans) if not a] if not same else []
            if redo:
                again, errs = _answers(fallback, [vals[i] for i in redo], tries, wait)
                for i, a, e in zip(redo, again, errs):
                    ans[i], used[i], errors[i] = a, fallback.name if e is None else None, e
            yield pd.DataFrame({"answer": pd.Series(ans, dtype=object), "used": pd.Series(used, dtype=object), "error": pd.Series(errors, dtype=object)})

    r = call(text)
    return df.withColumn("_fb", r).withColumn(out, F.col("_fb.answer")).withColumn("used", F.col("_fb.used")) \
        .withColumn("error", F.col("_fb.error")).drop("_fb")


# ---------------------------------------------------------------- journal refine (M11), versions (M12), translate
JOURNAL_PASSES = ["rewrite", "title", "insights", "takeaways", "todo", "summary"]


def journal_refine(df: DataFrame, text: str, model: TextModel) -> DataFrame:
    """Six model passes as one struct column ``refined``: the first rewrites the day's text, the others read the rewrite."""
    first = JOURNAL_PASSES[0]
    out = df.withColumn("_rewrite", model_call(model, F.concat(F.lit(f"{first}|"), F.col(text))))
    return _refined(out, df.columns, model)


def _refined(df: DataFrame, cols: list[str], model: TextModel) -> DataFrame:
    """``cols`` and ``refined``: the rewrite in ``_rewrite`` and the passes that read it."""
    first, *rest = JOURNAL_PASSES
    passes = [model_call(model, F.concat(F.lit(f"{p}|"), F.col("_rewrite"))).alias(p) for p in rest]
    return df.select(*cols, F.struct(F.col("_rewrite").alias(first), *passes).alias("refined"))


def journal_refine_lines(lines: DataFrame, key: str, order: list[str], line: str, model: TextModel) -> DataFrame:
    """M11 over texts that come as rows (``key, *order, line``): a row per key with ``n`` (its lines) and ``refined``.

    Where the model reads a text part by part (``reader``), no text of a key is ever made; another model gets the whole
    text of one key at a time.
    """
    texts = read_lines(lines, key, order, line, model, before=f"{JOURNAL_PASSES[0]}|")
    return _refined(texts.withColumnRenamed("answer", "_rewrite"), [key, "n"], model)


def read_lines(lines: DataFrame, key: str, order: list[str], line: str, model: TextModel, *, before: str = "", tries: int = 3, wait: float = 5.0) -> DataFrame:
    """(key, n, answer): the model's answer to ``before`` and each key's lines in order, NULL where it failed; null lines are left out.

    The lines of a key meet in one task, sorted by Spark (with its spilling), and stream through the model; a task holds one Arrow
    batch of lines and the state of one reader.
    """
    schema = T.StructType([lines.schema[key], T.StructField("n", T.LongType()), T.StructField("answer", T.StringType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, now, reader, n = None, None, None, 0

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([n], pa.int64()), pa.array([reader.answer()], pa.string())], names=[key, "n", "answer"])

        for b in batches:
            kind = b.schema.field(key).type
            keys, texts = b[key].to_pylist(), b[line].to_pylist()
            for k, t in zip(keys, texts):
                if reader is None or k != now:
                    if reader is not None:
                        yield done()
                    now, reader, n = k, _reader(model, tries, wait), 0
                    reader.read(before)
                n += 1
                if t is not None:
                    reader.read(t)
        if reader is not None:
            yield done()

    dealt = lines.select(key, *[c for c in order if c != key], line).repartition(key).sortWithinPartitions(key, *order)
    return dealt.select(key, line).mapInArrow(read, schema)


class _WholeReader:
    """Reads a text part by part for a model that wants it whole."""

    def __init__(self, model: TextModel, tries: int, wait: float):
        self.model, self.tries, self.wait, self.parts = model, tries, wait, []

    def read(self, part: str) -> None:
        self.parts.append(part)

    def answer(self) -> str | None:
        return _answers(self.model, ["".join(self.parts)], self.tries, self.wait)[0][0]


def _reader(model: TextModel, tries: int, wait: float):
    return model.reader() if hasattr(model, "reader") else _WholeReader(model, tries, wait)


def refine_versions(df: DataFrame, key: str, text: str, model: TextModel, rounds: int = 3, *,
                    materialise: bool = True) -> DataFrame:
    """``rounds`` refinement passes; every version is kept (``version`` 1..N), the last is current.

    Each pass feeds the previous version's text to the model.  With
    ``materialise`` every round is written by a reliable ``checkpoint()`` into
    the cluster's ``spark.checkpoint.dir`` before the next round reads it, so a
    round's model calls run once (not again for every later version) and the
    versions stay consistent even with a non-deterministic model.
    """
    from feedsift.session import cut_lineage

    cur = df.select(key, F.col(text).alias("text"))
    versions = []
    for v in range(1, rounds + 1):
        cur = cur.select(key, model_call(model, F.col("text")).alias("text"))
        if materialise:
            cur = cut_lineage(cur)
        versions.append(cur.withColumn("version", F.lit(v)))
    out = versions[0]
    for x in versions[1:]:
        out = out.unionByName(x)
    return out.withColumn("is_current", F.col("version") == rounds)


def translate(df: DataFrame, text: str, model: TextModel | None, out: str = "translation") -> DataFrame:
    """Optional translation column; no configured language (model None) -> ''."""
    if model is None:
        return df.withColumn(out, F.lit(""))
    return df.withColumn(out, model_call(model, F.col(text)))


# ---------------------------------------------------------------- embeddings
def embed_column(embedder: Embedder, text: Column) -> Column:
    """``array<double>`` per whole text by a plugged-in embedder (Arrow batches)."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            vecs = embedder.embed(s.where(s.notna(), "").tolist())
            yield pd.Series([np.asarray(v, dtype=np.float64) for v in vecs])

    return call(text)

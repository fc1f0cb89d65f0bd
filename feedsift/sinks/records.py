"""Published records and derived products.

Each builder turns rows into the rows of the published record; no builder
collects a batch on the driver.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedsift.functions.text import INVALID_RESPONSES, strip
from feedsift.operators import bm25, knn
from feedsift.operators.common import few_per_row, spread
from feedsift.operators.embed import hashing_embedding
from feedsift.operators.enrich import DigestModel, TextModel, journal_refine_lines, model_attempt, model_call, read_lines
from feedsift.operators.segments import BITS, in_segments, pack_rows
from feedsift.session import cut_lineage


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------- J10
def reply_enrich(posts: DataFrame, targets: DataFrame, group_keys: list[str], reply_col: str,
                 target_key: str) -> DataFrame:
    """Left lookup of the replied-to item; a reply whose target is missing gets ``reply_deleted``."""
    t = targets.select(*[F.col(k).alias(f"_t_{k}") for k in group_keys], F.col(target_key).alias("_t_key"),
                       F.col("name").alias("reply_name"), F.col("text").alias("reply_text"), F.lit(True).alias("_found"))
    cond = F.col(reply_col) == F.col("_t_key")
    for k in group_keys:
        cond = cond & (posts[k] == F.col(f"_t_{k}"))
    j = posts.join(t, cond, "left")
    return j.select(*[posts[c] for c in posts.columns], "reply_name", "reply_text",
                    (F.col(reply_col).isNotNull() & F.col("_found").isNull()).alias("reply_deleted"))


# ---------------------------------------------------------------- A8, K7 (journal roll-up)
def _day_lines(notes: DataFrame, day: Column | None) -> DataFrame:
    """``day, created_time, id, line``; notes without a creation time belong to no day."""
    line = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("content", F.lit("")), F.lit("\n"))
    return notes.select((day if day is not None else F.to_date("created_time")).alias("day"), "created_time", "id", line.alias("line")) \
        .where(F.col("day").isNotNull())


#: The order of a day's lines (equal ones of one note by their text).
LINE_ORDER = ["created_time", "id", "line"]


def journal_refined(notes: DataFrame, model: TextModel, *, day: Column | None = None) -> DataFrame:
    """``day, n_notes, refined`` of every day with notes; the model reads a day line by line (``journal_refine_lines``)."""
    return journal_refine_lines(_day_lines(notes, day), "day", LINE_ORDER, "line", model).withColumnRenamed("n", "n_notes")


def journal_days(notes: DataFrame, first: str, last: str, *, day: Column | None = None) -> DataFrame:
    """A row for every day from ``first`` to ``last``, also without notes: how many, their characters, the md5 of the day's
    whole text (its lines in creation order, read as they stream by: no string of a day is made), the last creation time."""
    days = notes.sparkSession.sql(f"SELECT explode(sequence(DATE '{first}', DATE '{last}')) AS day")
    lines = _day_lines(notes, day)
    sums = lines.groupBy("day").agg(F.count(F.lit(1)).alias("n_notes"), F.sum(F.length("line")).alias("n_chars"), F.max("created_time").alias("last_created"))
    texts = read_lines(lines, "day", LINE_ORDER, "line", DigestModel("")).select("day", F.col("answer").alias("text_md5"))
    return days.join(sums, "day", "left").join(texts, "day", "left").withColumns({
        "n_notes": F.coalesce("n_notes", F.lit(0)), "n_chars": F.coalesce("n_chars", F.lit(0)), "text_md5": F.coalesce("text_md5", F.md5(F.lit("")))})


def _numbered(rows: DataFrame, key: str, count: Column, name: str) -> DataFrame:
    """Rows of ``in_segments`` with the sum of ``count`` over the key's rows before each: sums of segments first, then
    within segments, so that no task sees more than a segment's rows or a key's segments."""
    within = Window.partitionBy(key, "_seg").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(key).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(key, "_seg").agg(F.sum(count).alias("_n")).select(key, "_seg", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return rows.withColumn("_in", F.coalesce(F.sum(count).over(within), F.lit(0))).join(sums, [key, "_seg"]).withColumn(name, F.col("_base") + F.col("_in")).drop("_base", "_in")


def journal_lines(notes: DataFrame, *, day: Column | None = None, bits: int = BITS) -> DataFrame:
    """Each day's ``"{title} {content}\\n"`` lines in creation order, numbered from 0: the day's text as rows."""
    rows = in_segments(_day_lines(notes, day), ["day", "created_time", "id"], bits)
    return _numbered(rows, "day", F.lit(1), "line_no").select("day", "line_no", "line")


def journal_blocks(notes: DataFrame, first: str, last: str, limit: int = 1800, *, day: Column | None = None, bits: int = BITS) -> DataFrame:
    """K7/M2: every day's text (an empty one for a day without notes) as blocks of ``.``-separated sentences.

    The same blocks as ``pack_sentences`` of the day's whole text, which is never made: the full stops before each line number
    the sentences, the parts of a sentence meet by that number, sentences are packed by their lengths as rows, and only the
    sentences of one block are put together.
    """
    rows = in_segments(_day_lines(notes, day), ["day", "created_time", "id"], bits)
    stops = F.length("line") - F.length(F.replace("line", F.lit("."), F.lit("")))
    pieces = _numbered(rows, "day", stops, "_first").select("day", "_row", "_first", F.posexplode(F.split("line", r"\.", -1)).alias("_at", "_piece"))
    sentences = cut_lineage(pieces.groupBy("day", (F.col("_first") + F.col("_at")).alias("sentence_no")).agg(
        F.expr("listagg(_piece, '') WITHIN GROUP (ORDER BY _row)").alias("sentence")))
    numbers = pack_rows(sentences.withColumn("_length", F.length("sentence")), ["day"], ["sentence_no"], "_length", limit, bits=bits)
    blocks = sentences.join(numbers, ["day", "sentence_no"]).groupBy("day", "block_no").agg(
        F.expr("listagg(sentence, '. ') WITHIN GROUP (ORDER BY sentence_no)").alias("block"))
    # a day without notes, and one whose first sentence is too long, begins with an empty block
    days = notes.sparkSession.sql(f"SELECT explode(sequence(DATE '{first}', DATE '{last}')) AS day, 0L AS block_no, '' AS block")
    known = numbers.select("day").distinct().withColumn("_known", F.lit(True))
    opened = days.unionByName(known.select("day", F.lit(0).cast("long").alias("block_no"), F.lit("").alias("block"))).distinct()
    return blocks.unionByName(opened.join(blocks.where("block_no = 0").select("day"), "day", "left_anti"))


def journal_rollup(notes: DataFrame, *, day: Column | None = None) -> DataFrame:
    """M11 (input of a model): per day the whole text, the count and the last creation time; days without notes have no row.
    ``journal_lines``, ``journal_blocks`` and ``journal_refined`` do without making one string of a day."""
    return _day_lines(notes, day).groupBy("day").agg(
        F.expr("listagg(line, '') WITHIN GROUP (ORDER BY created_time, id)").alias("text"),
        F.count(F.lit(1)).alias("n_notes"), F.max("created_time").alias("last_created"))


# ---------------------------------------------------------------- P14 / K8 / J16 (action rows)
def _invalid(x: Column) -> Column:
    s = strip(x)
    return x.isNull() | s.isin("", *INVALID_RESPONSES)


def todo_rows(df: DataFrame, key: str, todo: str, trans: str, header: str = "Action Items") -> DataFrame:
    """One row per valid action line, paired with its translation line.

    Lines are zipped and truncated to the shorter list (J16); blank/invalid
    lines are skipped, a first line holding the header is skipped, the first
    3 characters are dropped (trap Q17) and an invalid remainder is skipped.
    """
    staged = df.select(key, F.split(F.coalesce(_c(todo), F.lit("")), "\n", -1).alias("_a"),
                       F.split(F.coalesce(_c(trans), F.lit("")), "\n", -1).alias("_b"))
    n = F.least(F.size("_a"), F.size("_b"))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                        lambda i: F.struct(i.alias("line_no"), F.element_at("_a", i).alias("line"),
                                           F.element_at("_b", i).alias("tline")))
    rows = staged.select(key, F.explode(pairs).alias("_p")).select(key, "_p.*")
    keep = (~_invalid(F.col("line")) & ~((F.col("line_no") == 1) & F.contains(F.col("line"), F.lit(header)))
            & ~_invalid(F.substring("line", 4, 1 << 30)))
    return rows.where(keep).select(key, F.col("line_no").cast("int").alias("line_no"),
                                   F.substring("line", 4, 1 << 30).alias("action"),
                                   F.substring("tline", 4, 1 << 30).alias("translation"))


class ActionListModel:
    """Stand-in action-list model: a header, one action derived from the text, one 'None' line."""

    def __init__(self, prefix: str = "", header: str = "Action Items"):
        self.prefix, self.header, self.name = prefix, header, "actions"

    def generate(self, texts: list[str]) -> list[str]:
        out = []
        for t in texts:
            h = hashlib.md5((self.prefix + (t or "")).encode("utf-8")).hexdigest()
            out.append(f"{self.header}\n1. {h[:8]}\n2. None")
        return out


def todo_generate(pages: DataFrame, key: str, text: str, model: TextModel, translator: TextModel | None) -> DataFrame:
    """Action list per page from the model, plus its translation (optional, M13); a failing page has its ``error``."""
    out = pages.select(key, F.col(text)).withColumn("_todo", model_attempt(model, F.col(text)))
    t = model_attempt(translator, F.col(text)) if translator is not None else F.struct(F.lit("").alias("answer"), F.lit(None).cast("string").alias("error"))
    return out.withColumn("_trans", t).select(key, text, F.col("_todo.answer").alias("todo"), F.col("_trans.answer").alias("todo_trans"),
                                              F.coalesce("_todo.error", "_trans.error").alias("error"))


# ---------------------------------------------------------------- M9 / K14 (evidence)
def collect_evidence(topics: DataFrame, docs: DataFrame, model: TextModel, *, k: int = 3,
                     summarise_over: int = 0) -> DataFrame:
    """M9: the k most similar documents per topic (inner product of hashing embeddings);
    whole bodies over ``summarise_over`` characters are summarised by the model (0: all but empty ones), others kept."""
    q = topics.select(F.col("item_id").alias("query_id"), hashing_embedding(F.col("text")).alias("embedding"))
    r = spread(docs.select("doc_id", "text")).select(F.col("doc_id").alias("item_id"),
                                                      hashing_embedding(F.col("text")).alias("embedding"))
    nb = knn.knn_join(q, r, k, "IP").select(F.col("query_id").alias("item_id"), F.col("item_id").alias("doc_id"), "rnk")
    j = docs.select("doc_id", "text").join(few_per_row(nb, topics), "doc_id").select("doc_id", "item_id", "rnk", "text")
    long_ = F.length("text") > summarise_over
    summ = j.where(long_).withColumn("evidence", model_call(model, F.col("text"))) \
        .withColumn("summarised", F.lit(True))
    keep = j.where(~F.coalesce(long_, F.lit(False))).withColumn("evidence", F.col("text")).withColumn("summarised", F.lit(False))
    return summ.unionByName(keep)


def recent_papers(topics: DataFrame, papers: DataFrame, *, now: Column, days: int, k: int = 5) -> DataFrame:
    """The ``k`` papers most relevant to each topic (BM25 over whole texts), of those the ones published within
    ``days`` before ``now``: the cut to ``k`` comes first, so fewer may be left. ``papers``: ``doc_id, text, published``."""
    found = bm25.search(topics, bm25.build(papers), k).withColumnRenamed("query_id", "item_id")
    dated = papers.select("doc_id", "published", F.col("text").alias("text"))
    return dated.join(few_per_row(found, topics), "doc_id").where(F.col("published") >= now - F.make_dt_interval(F.lit(days))).select("item_id", "doc_id", "rnk", "score", "text")


def collect_all_evidence(topics: DataFrame, docs: DataFrame, papers: DataFrame, model: TextModel, *, now: Column, days: int, k: int = 3, k_papers: int = 5) -> DataFrame:
    """M9: both branches: similar documents (bodies summarised) and relevant recent papers (their own text), by ``kind``."""
    similar = collect_evidence(topics, docs, model, k=k).select("item_id", F.lit("document").alias("kind"), "doc_id", "rnk", "evidence")
    recent = recent_papers(topics, papers, now=now, days=days, k=k_papers)
    return similar.unionByName(recent.select("item_id", F.lit("paper").alias("kind"), "doc_id", "rnk", F.col("text").alias("evidence")))


def reference_list(evidence: DataFrame, group: str, order: str, *, title: str = "title", url: str = "url") -> DataFrame:
    """``- [title](url)`` lines (spaces stripped from the url) per group, in evidence order."""
    line = F.concat(F.lit("- ["), F.col(title), F.lit("]("), F.replace(F.col(url), F.lit(" "), F.lit("")), F.lit(")"))
    e = evidence.withColumn("_line", line)
    return e.groupBy(group).agg(F.expr(f"listagg(_line, '\\n') WITHIN GROUP (ORDER BY {order})").alias("refs"))

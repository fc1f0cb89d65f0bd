"""Trees, relevance search, named files and dated collections over real folders."""

from __future__ import annotations

import datetime as dt
import math
import os
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from feedsift.operators import bm25
from feedsift.sinks import collections as CO
from feedsift.sinks import documents as DOC
from feedsift.sinks.named_files import register_named_text
from feedsift.sources.trees import block_paths, tree_to_text

TREE = "page_id int, block_id int, parent int, pos int, type string, text string, cells array<string>"


def _render(rows, page, parent, separator=""):
    out = ""
    for r in sorted((r for r in rows if r[0] == page and r[2] == parent), key=lambda r: (r[3], str(r[1]))):
        kind, text = r[4], r[5] or ""
        out += {"toggle": text + "\n", "bulleted_list_item": f"- {text}\n", "numbered_list_item": f"1. {text}\n", "code": f"```{text}```", "table": "",
                "table_row": "".join((c or "") + "," for c in r[6] or []) + "\n", "quote": text, "paragraph": text}.get(kind, "")
        if kind in ("toggle", "table"):
            out += _render(rows, page, r[1])
        out += separator
    return out


@pytest.mark.parametrize("separator", ["", "\n"])
def test_trees_render_like_a_walk(spark, separator):
    rnd = random.Random(3)
    kinds = ["toggle", "toggle", "table", "table_row", "bulleted_list_item", "code", "quote", "paragraph", "unknown"]
    rows = []
    for page in range(12):
        for b in range(rnd.randrange(1, 30)):
            rows.append((page, b, rnd.choice([None, *range(b)]) if b else None, rnd.randrange(4), rnd.choice(kinds), rnd.choice([None, f"t{b}"]), rnd.choice([None, ["a", None, "b"]])))
    rows += [(50, b, b - 1 if b else None, 0, "toggle", f"d{b}", None) for b in range(300)]          # one deep chain
    rows += [(60, 1, 99, 0, "paragraph", "lost", None)]                                              # its parent is missing
    df = spark.createDataFrame(rows, TREE).repartition(4)
    got = {r.page_id: r.text for r in tree_to_text(df, separator=separator).collect()}
    assert got == {p: _render(rows, p, None, separator) for p in {r[0] for r in rows}}
    assert max(r.n for r in block_paths(df).select(F.size("path").alias("n")).collect()) == 300


def test_a_circle_of_blocks_is_an_error(spark):
    with pytest.raises(ValueError):
        block_paths(spark.createDataFrame([(1, 1, 2, 0, "toggle", "a", None), (1, 2, 1, 0, "toggle", "b", None)], TREE))
    assert tree_to_text(spark.createDataFrame([], TREE)).count() == 0


def test_bm25_matches_a_loop(spark):
    rnd = random.Random(1)
    docs = [(i, " ".join(rnd.choice(["the", "the", "cat", "dog", "sun", f"w{rnd.randrange(40)}"]) for _ in range(rnd.randrange(0, 30)))) for i in range(80)] + [(90, None), (91, "...")]
    queries = [(1, "The cat, the SUN"), (2, "w3 w4 w5 unseen"), (3, ""), (4, None), (5, "nothing known")]
    words = {i: re.findall(r"[^\W_]+", (t or "").lower()) for i, t in docs}
    mean = sum(map(len, words.values())) / len(words)
    df = Counter(w for ws in words.values() for w in set(ws))
    want = {}
    for q, t in queries:
        score = {}
        for i, ws in words.items():
            tf = Counter(ws)
            hit = [w for w in set(re.findall(r"[^\W_]+", (t or "").lower())) if tf[w]]
            if hit:
                score[i] = round(sum(math.log(1 + (len(words) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(ws) / mean)) for w in hit), 6)
        want[q] = sorted(score, key=lambda i: (-score[i], i))[:5]
    index = bm25.build(spark.createDataFrame(docs, "doc_id int, text string").repartition(3))
    got = {q: [] for q, _ in queries}
    for r in bm25.search(spark.createDataFrame(queries, "item_id int, text string"), index, 5).orderBy("query_id", "rnk").collect():
        got[r.query_id].append(r.doc_id)
    assert got == want
    empty = bm25.build(spark.createDataFrame([], "doc_id int, text string"))
    assert bm25.search(spark.createDataFrame(queries, "item_id int, text string"), empty, 5).count() == 0


def test_named_files_are_written_skipped_and_replaced(spark, tmp_path):
    folder = str(tmp_path / "notes")
    rows = [(f"n{i}.md", f"text {i}\nline") for i in range(25)]
    df = spark.createDataFrame([*rows, ("n3.md", "again"), ("e.md", None)], "file_name string, content string").coalesce(1)
    DOC.write_markdown(df, folder)
    assert {f: (tmp_path / "notes" / f).read_text() for f in os.listdir(folder)} == {**dict(rows), "e.md": ""}
    DOC.write_markdown(spark.createDataFrame([("n1.md", "new"), ("z.md", "z")], "file_name string, content string"), folder)
    assert (tmp_path / "notes" / "n1.md").read_text() == "text 1\nline" and (tmp_path / "notes" / "z.md").read_text() == "z"
    spark.createDataFrame([("n1.md", "new")], "file_name string, content string").write.format("named_text").mode("overwrite").save(folder)
    assert (tmp_path / "notes" / "n1.md").read_text() == "new" and len(os.listdir(folder)) == 27


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    folder = str(tmp_path / "notes")
    register_named_text(spark)
    good = spark.range(40).select(F.concat(F.lit("a"), F.col("id").cast("string")).alias("file_name"), F.lit("x").alias("content"))
    bad = good.unionByName(spark.createDataFrame([("../out.md", "x")], "file_name string, content string"))
    with pytest.raises(Exception, match="not a file name"):
        bad.write.format("named_text").mode("append").save(folder)
    assert not os.path.exists(folder) or os.listdir(folder) == []
    assert not (tmp_path / "out.md").exists()


def test_collections_are_appended_once_and_dropped_by_folder(spark, tmp_path):
    path = str(tmp_path / "vectors")
    assert CO.read_collections(spark, path).count() == 0 and CO.list_collections(spark, path) == []
    day = lambda n: dt.date(2024, 1, n)
    rows = spark.createDataFrame([(f"i{n}", [float(n), 0.5], "a/b", day(n), None) for n in (7, 8, 9, 10)] + [("bad", [0.0], "a/b", day(10), "bad vector size")],
                                 "item_id string, embedding array<double>, model string, as_of date, error string")
    for batch in ("one", "one", "two"):
        CO.append_batch(rows, path, batch)
    assert sorted((r.item_id, r.batch) for r in CO.read_collections(spark, path).collect()) == [(f"i{n}", b) for n in (10, 7, 8, 9) for b in ("one", "two")]
    assert CO.list_collections(spark, path) == [("a/b", day(n)) for n in (7, 8, 9, 10)]
    assert CO.drop_collections(spark, path, "2024-01-11", 3) == [("a/b", day(7)), ("a/b", day(8))]
    assert CO.drop_collections(spark, path, "2024-01-11", 3) == [] and CO.list_collections(spark, path) == [("a/b", day(9)), ("a/b", day(10))]
    left = CO.read_collections(spark, path).where(F.col("as_of") == day(9))
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*as_of", plan)
    assert left.count() == 2


def test_bm25_shuffles_texts_by_document_and_the_best_only(spark, tmp_path):
    """No postings and no scores are dealt anew: one document's rows in two places count as one."""
    docs = [(1, "a b"), (2, "b c c"), (1, "c"), (None, "c c"), (3, None)]
    index = bm25.build(spark.createDataFrame(docs, "doc_id int, text string").repartition(3))
    assert index.docs == 4 and abs(index.mean_tokens - 2.0) < 1e-12
    assert {(r.token, r.doc_id, r.tf, r.n_tokens) for r in index.postings.collect()} == {("a", 1, 1, 3), ("b", 1, 1, 3), ("c", 1, 1, 3), ("b", 2, 1, 3), ("c", 2, 2, 3)}
    spark.createDataFrame([(7, "c c b")], "item_id int, text string").write.parquet(str(tmp_path / "asked"))
    found = bm25.search(spark.read.parquet(str(tmp_path / "asked")), index, 1)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and not [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "query_id" in x and "doc_id" in x]
    assert [(r.query_id, r.doc_id, r.rnk) for r in found.collect()] == [(7, 2, 1)]

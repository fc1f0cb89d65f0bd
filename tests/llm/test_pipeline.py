"""The pipeline against a brute-force version of each stage, and its registration."""

from __future__ import annotations

import corpus_pipeline
from feedsift.llm import decontam, simhash, toxicity
from feedsift.llm.common import table, tokenizer_path
from tests.conftest import MEDIUM, SMALL
from tests.llm.test_dedup import _components, _decontam_brute, _fingerprint, _line_brute


def test_stages_against_brute_force(spark):
    docs = table(spark, SMALL, "documents")
    labels, bench = table(spark, SMALL, "labels"), table(spark, SMALL, "benchmark")
    rows = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    score = {r.doc_id: r.s for r in toxicity.scored(docs, toxicity.train(docs, labels), "s").collect()}
    rows = [r for r in rows if score[r[0]] < 0.5]
    rows = _line_brute(rows, 0.1, 5)
    comp = _components([_fingerprint(t) for _, _, t in rows], 2)
    first = {}
    for (i, _, _), c in zip(rows, comp):
        first[c] = min(i, first.get(c, i))
    rows = [r for r in rows if r[0] in set(first.values())]
    items = [(r.item_id, r.text) for r in bench.collect()]
    hit = {i for i, _, n, _ in _decontam_brute([(i, t) for i, _, t in rows], items, 10) if n}
    rows = [r for r in rows if r[0] not in hit]

    got = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, got, SMALL)
        assert got.columns == docs.columns, name
        got = spark.createDataFrame(got.collect(), docs.schema)
    assert sorted((r.doc_id, r.source, r.text) for r in got.collect()) == sorted(rows)

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    want = sum(len(tok.encode(t, add_special_tokens=False).ids) + 1 for _, _, t in rows)
    packed = corpus_pipeline.run(spark, SMALL)
    assert packed.agg({"length": "sum"}).first()[0] == want
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {i for i, _, _ in rows}


def test_pipeline_edge_cases(spark, edge_docs, no_docs):
    for docs in (edge_docs, no_docs):
        got = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, got, MEDIUM)
            assert got.columns == docs.columns, name
        assert corpus_pipeline.STAGES[-1][1](spark, got, MEDIUM).columns[:2] == ["doc_id", "start"]


def test_stages_leave_columns_with_clashing_names_alone(spark):
    names = ["contamination", "__toxicity", "__drop", "__salt", "__host", "__h", "__s", "__text", "__lines", "__n", "__pages", "__hits_0", "__merged", "__made", "c0", "c1", "C7", "own", "__row"]
    lines = "one line of its own {}\nfollow us\nmore of the page {}"
    rows = [(i, lines.format(i, i * i), "en", "s", 0, *[f"{n} {i}" for n in names]) for i in range(12)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", "n_chars", *names])
    got = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, got, SMALL)
        assert got.columns == docs.columns, name
        got = spark.createDataFrame(got.collect(), docs.schema)
    kept = {r.doc_id: tuple(r) for r in got.collect()}
    assert set(kept) == {r[0] for r in rows}
    assert all("follow us" not in kept[r[0]][1] and kept[r[0]][5:] == r[5:] for r in rows)
    bench = table(spark, SMALL, "benchmark")
    for kw in ({}, {"max_words": 300}):
        marked = decontam.contamination(docs, bench, name="found", **kw)
        assert marked.columns == [*docs.columns, "found"] and {tuple(r)[:-1] for r in marked.collect()} == set(rows)
        assert decontam.contamination(docs, bench, **kw).columns == [c for c in docs.columns if c != "contamination"] + ["contamination"]


def test_line_stage_keeps_a_group_of_copies(spark):
    rows = [(i, "the whole text\nof one page", "en", "s", 26) for i in range(20)]
    rows += [(100 + i, f"own line {i}\nfollow us", "en", "s", 0) for i in range(40)]
    rows += [(200 + i, "of one page", "en", None, 0) for i in range(9)] + [(300, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_boilerplate_lines(spark, docs, SMALL).collect()}
    assert got == {i: f"own line {i - 100}" if 100 <= i < 200 else t for i, t, *_ in rows}
    kept = corpus_pipeline.keep_one_of_each_group(spark, corpus_pipeline.drop_boilerplate_lines(spark, docs, SMALL), SMALL)
    assert {r.text for r in kept.where("doc_id < 100").collect()} == {"the whole text\nof one page"}


def test_registered():
    import __spark_entry__ as e

    names = [n for n in e.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in e.queries()
    assert simhash.near_duplicates.__doc__

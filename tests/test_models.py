"""The classifier against a loop over tokens, sentence centrality against a dense matrix, calls isolated per text."""

from __future__ import annotations

import json
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedsift.operators import classify
from feedsift.operators import enrich as EN
from feedsift.operators import summarise as SU

DOCS = [(1, "Der Hund läuft, der Hund bellt", "de", "1"), (2, "the dog runs and the dog barks", "en", "1"), (3, "the cat sleeps", "en", "0"),
        (4, "", "en", "0"), (5, None, "en", "1"), (6, "le chien", None, "1"), (7, "die Katze schläft", "de", "0"), (7, "die Katze schläft", "de", "0")]


def _words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def test_naive_bayes_matches_a_loop(spark):
    df = spark.createDataFrame([(*r, "x") for r in DOCS], "id int, text string, lang string, good string, token string")
    models = classify.fit(df, "id", "text", ["lang", "good"])
    known = [r for r in DOCS if None not in r]
    vocabulary = {w for r in known for w in _words(r[1])}
    for at, name in ((2, "lang"), (3, "good")):
        m = models[name]
        assert m.classes == sorted({r[at] for r in known})
        for text in ("the dog bellt", "", "unknown words only", "Hund Hund Hund cat"):
            s = []
            for c in m.classes:
                n = Counter(w for r in known if r[at] == c for w in _words(r[1]))
                s.append(math.log(sum(r[at] == c for r in known) / len(known))
                         + sum(math.log((n[w] + 1) / (sum(n.values()) + len(vocabulary))) for w in _words(text)))
            p = np.exp(np.array(s) - max(s))
            assert np.allclose(m.posterior(_words(text)), p / p.sum(), atol=1e-6)
    answer = json.loads(classify.RankClassifier({"topic": models["lang"], "category": models["lang"], "quality": models["good"]}).generate(["the dog"])[0])
    assert answer["topics"][0]["topic"] == "en" and answer["feedback"] == "en/en" and 0 < answer["overall_score"] < 1


def test_classifier_is_bounded_by_its_sample_and_empty_without_labels(spark):
    df = spark.range(500).select(F.col("id"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("text"), F.lit("a").alias("lang"))
    m = classify.fit(df, "id", "text", ["lang"], max_docs=40)["lang"]
    assert len(m.rows) == 40
    none = classify.fit(df.limit(0), "id", "text", ["lang"])
    model = classify.RankClassifier({c: none["lang"] for c in ("topic", "category", "quality")})
    assert model.generate(["x", None]) == ["", ""]
    out = EN.classify_rank(df.limit(3).withColumn("score", F.lit(None).cast("double")), "id", "score", F.col("text"), model)
    assert {(r.rate, len(r.topics)) for r in out.collect()} == {(-0.01, 0)}


def test_classifier_counts_all_labelled_texts(spark):
    df = spark.range(10_050).select("id", F.concat(F.lit("w"), F.col("id").cast("string")).alias("text"), F.when(F.col("id") < 67, "a").otherwise("b").alias("lang"))
    models = classify.fit(df, "id", "text", ["lang"])
    m = models["lang"]
    assert len(m.rows) == 10_050 and np.allclose(m.prior, np.log([67 / 10_050, 9_983 / 10_050])) and np.allclose(m.total, np.log([10_117, 20_033])) and models.rest is None


def test_rare_tokens_met_by_a_join_answer_as_those_in_memory(spark, monkeypatch):
    rows = [(i, f"common{i % 3} common{i % 2} rare{i} rare{i % 7} {'x' * 70}{i % 5}", f"t{i % 3}", "toxic" if i % 4 else "clean", str(i % 2)) for i in range(40)] + [(40, "", "t0", "clean", "1")]
    df = spark.createDataFrame(rows, "id long, text string, topic string, category string, quality string")
    labels = ["topic", "category", "quality"]
    with monkeypatch.context() as m:
        m.setattr(classify, "_HELD_CHARS", 100)
        whole = classify.RankClassifier(classify.fit(df, "id", "text", labels))
    parts, none = (classify.RankClassifier(classify.fit(df, "id", "text", labels, held=n)) for n in (4, 0))
    assert whole.rest is None and 0 < len(parts.models["topic"].rows) <= 4 and not none.models["topic"].rows
    assert all(len(t) <= classify._HELD_CHARS for t in parts.models["topic"].rows)
    texts = [r[1] for r in rows] + ["common1 unknown rare3 rare3 rare3", "nothing known", "common0 common1", "", None] * 3
    asked = spark.createDataFrame([(i, t, [None, -1.0, 2.0, 5.0][i % 4]) for i, t in enumerate(texts)] + [(None, "rare5", None), (3, "rare5", None)], "id long, body string, score double")
    asked = asked.withColumn("known", EN.text_key(F.col("body"))).repartition(3)

    def answers(model, **kw):
        out = EN.classify_rank(asked, "id", "score", F.col("body"), model, **kw)
        assert out.columns[:4] == ["id", "body", "score", "known"]
        return sorted(repr((r.id, r.body, r.topics, r.categories, r.rate, r.feedback, r.ranked)) for r in out.collect())

    want = answers(whole)
    assert len(want) == len(texts) + 2
    for model in (parts, none):
        assert answers(model) == answers(model, model_key="known", texts=asked.repartition(2)) == want
        with pytest.raises(ValueError):
            model.generate(["x"])
    cache = spark.createDataFrame([(0, "kept")], "item_id long, value string")
    got = [{(r.id, r.body, r.a, r.from_cache) for r in EN.read_through(asked, "id", F.col("body"), cache, m, "a")[0].collect()} for m in (whole, parts)]
    assert got[0] == got[1] and (0, texts[0], "kept", True) in got[0]


def test_rank_answers_that_nobody_reads_are_not_made(spark):
    from feedsift.plans import jobs as J

    items = spark.createDataFrame([(i, "l", f"title {i}", f"body {i} word{i % 5}") for i in range(12)], "id long, list_name string, title string, body string")
    trained = items.select("id", "body", *[(F.col("id") % 2).cast("string").alias(c) for c in ("topic", "category", "quality")])
    model = classify.RankClassifier(classify.fit(trained, "id", "body", ["topic", "category", "quality"], held=2))
    vectors = J.rated_vectors_of(items, F.col("body"))
    out = J.curate(items, items.limit(0).select(F.col("id").alias("item_id"), "list_name"), vectors, items.select(F.col("id").alias("item_id"), F.lit(5).alias("user_rating")), model=model)
    assert "MapInArrow" in out.published._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in out.funnel._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_centrality_matches_a_dense_matrix(seed):
    rng = np.random.default_rng(seed)
    words = [[f"w{x}" for x in rng.integers(0, 30, rng.integers(0, 9))] for _ in range(25)]
    vocabulary = sorted({w for ws in words for w in ws})
    x = np.array([[ws.count(v) for v in vocabulary] for ws in words], float)
    x = np.divide(x, np.linalg.norm(x, axis=1, keepdims=True), out=np.zeros_like(x), where=x.any(1, keepdims=True))
    s = x @ x.T
    np.fill_diagonal(s, 0)
    total = s.sum(1)
    v = np.full(25, 1 / 25)
    for _ in range(10):
        v = 0.15 / 25 + 0.85 * (s @ np.divide(v, total, out=np.zeros(25), where=total > 1e-9))
    got, linked = SU.centrality(words, 10, 0.85)
    assert linked and np.allclose(got, v * 25)


def test_summaries_come_from_anywhere_in_the_text():
    text = "\n".join([f"Opening line {i} about nothing{i}" for i in range(400)] + ["The comet returns! The comet shines? See the comet returns"])
    model = SU.CentralSentences(n=2)
    assert "comet" in model.generate(["Nothing here. All alone. " + text[-57:]])[0]
    assert "comet" in SU.KeySentences(n=401).generate([text])[0]
    assert model.generate(["", None, "...", "only one", "no stop\nat all here"]) == ["", "", "", "only one.", "no stop. at all here."]
    skip = SU.CentralSentences(answer_unlinked=False)
    assert skip.generate(["alpha beta. gamma delta", "single"]) == ["", ""]
    long = " ".join(f"Word{i % 977} word{i % 31}." for i in range(60_000))
    assert len(model.generate([long])[0]) > 5


class _Picky:
    def __init__(self, name, bad):
        self.name, self.bad = name, bad

    def generate(self, texts):
        if any(self.bad in t for t in texts):
            raise RuntimeError(f"{self.name} can't")
        return ["" if "empty" in t else f"{self.name}:{t}" for t in texts]


def test_a_failing_text_stops_no_other(spark):
    df = spark.createDataFrame([(1, "fine"), (2, "first"), (3, "first second"), (4, "empty"), (5, None)], "id int, t string").coalesce(1)
    out = EN.fallback_enrich(df, F.col("t"), _Picky("p", "first"), _Picky("f", "second"), "a", tries=1, wait=0)
    rows = {r.id: (r.a, r.used, r.error) for r in out.collect()}
    assert rows == {1: ("p:fine", "p", None), 2: ("f:first", "f", None), 3: (None, None, "RuntimeError: f can't"), 4: ("", "f", None), 5: ("p:", "p", None)}


def test_a_plugged_in_embedder(spark):
    class Lengths:
        name, dim = "lengths", 2

        def embed(self, texts):
            return [[float(len(t)), 1.0] for t in texts]

    df = spark.createDataFrame([(1, "abc"), (2, None)], "id int, t string")
    assert [r.e for r in df.select("id", EN.embed_column(Lengths(), F.col("t")).alias("e")).orderBy("id").collect()] == [[3.0, 1.0], [0.0, 1.0]]

"""Text, vector and model-enrichment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedsift.bind import binding
from feedsift.catalog import register
from feedsift.catalog.util import RUN_TS, duck_ts_text, ts, ts_text
from feedsift.functions import text as X
from feedsift.operators import chunking as CH
from feedsift.operators import classify
from feedsift.operators import enrich as EN
from feedsift.operators import knn
from feedsift.operators.classify import RankClassifier
from feedsift.operators.common import spread
from feedsift.operators.embed import bucket_counts, hashing_embedding
from feedsift.operators.filters import exclude_source_tag, include_tag
from feedsift.operators.summarise import CentralSentences, KeySentences
from feedsift.sinks import records as R
from feedsift.sources.blocks import blocks_to_text
from feedsift.sources.html import page_text as html_page_text
from feedsift.sources.scans import sync_rated
from feedsift.sources.trees import tree_to_text

_TS = duck_ts_text

# ---------------------------------------------------------------- DuckDB spellings of the library expressions
_CHUNKS = """
, n_{name} AS (SELECT {key} AS k, {text} AS t,
       CASE WHEN coalesce(length({text}), 0) = 0 THEN 0
            ELSE 1 + CAST(ceil(greatest(length({text}) - {size}, 0) / {stride}.0) AS INTEGER) END AS n FROM {src})
, {name} AS (SELECT k, CAST(i AS INTEGER) AS chunk_no, substr(t, i * {stride} + 1, {size}) AS chunk
             FROM (SELECT k, t, unnest(range(0, n)) AS i FROM n_{name}))"""


def _chunks_sql(name: str, src: str, key: str, text: str, size: int, overlap: int) -> str:
    return _CHUNKS.format(name=name, src=src, key=key, text=text, size=size, stride=size - overlap)


def _separator_chunks_sql(name: str, src: str, key: str, text: str, size: int, overlap: int) -> str:
    """DuckDB CTEs for ``name(k, chunk_no, chunk)``: the pieces, then one list fold over them."""
    def cut(x: str, level: int) -> str:
        if level == 3:
            return f"regexp_extract_all({x}, '(?s).{{1,{min(size, max(1, overlap))}}}')"
        sep = ["\\n\\n", "\\n", " "][level]
        p = f"p{level}"
        return (f"flatten(list_transform(regexp_extract_all({x}, '(?s).*?{sep}|.+'), lambda {p}: "
                f"CASE WHEN length({p}) <= {size} THEN [{p}] ELSE {cut(p, level + 1)} END))")

    state = "STRUCT(done STRUCT(a INTEGER, z INTEGER)[], a INTEGER, z INTEGER, tail INTEGER[], n INTEGER)"
    end = "(s.z + x.n)"
    return f"""
, {name}_p AS MATERIALIZED (SELECT {key} AS k, {text} AS t, {cut(f"coalesce({text}, '')", 0)} AS pieces FROM {src})
, {name}_s AS MATERIALIZED (SELECT k, t, list_reduce(list_transform(pieces, lambda p: CAST({{'done': [], 'a': 0, 'z': 0, 'tail': [], 'n': length(p)}} AS {state})),
    lambda s, x: CAST({{'done': CASE WHEN {end} - s.a <= {size} THEN s.done ELSE list_append(s.done, {{'a': s.a, 'z': s.z}}) END,
      'a': CASE WHEN {end} - s.a <= {size} THEN s.a ELSE coalesce(list_filter(s.tail, lambda b: {end} - b <= {size} AND b > s.a)[1], s.z) END,
      'z': {end}, 'tail': list_filter(list_append(s.tail, s.z), lambda b: {end} - b <= {overlap}), 'n': 0}} AS {state}),
    CAST({{'done': [], 'a': 0, 'z': 0, 'tail': [], 'n': 0}} AS {state})) AS st FROM {name}_p WHERE len(pieces) > 0)
, {name} AS (SELECT k, CAST(i - 1 AS INTEGER) AS chunk_no, substr(t, spans[i].a + 1, spans[i].z - spans[i].a) AS chunk
  FROM (SELECT k, t, spans, unnest(range(1, len(spans) + 1)) AS i
        FROM (SELECT k, t, list_append(st.done, {{'a': st.a, 'z': st.z}}) AS spans FROM {name}_s)))"""


def _buckets_sql(text: str) -> str:
    return ("list_transform(list_filter(regexp_split_to_array(lower(" + text + "), '[^\\pL\\pN]+'), "
            "lambda t: t <> ''), lambda t: CAST(CAST(('0x' || substr(md5(t), 1, 8)) AS BIGINT) % 64 AS INTEGER))")


def _embed_ctes(name: str, src: str, key: str, text: str) -> str:
    """DuckDB CTEs computing ``name(key, e)``: the normalised hashing embedding, each step materialised."""
    return f"""
, {name}_b AS MATERIALIZED (SELECT {key} AS key, {_buckets_sql(text)} AS bk FROM {src})
, {name}_c AS MATERIALIZED (SELECT key, list_transform(range(64), lambda i: CAST(len(list_filter(bk, lambda x: x = i)) AS DOUBLE)) AS cnt FROM {name}_b)
, {name}_n AS MATERIALIZED (SELECT key, cnt, sqrt(list_sum(list_transform(cnt, lambda w: w * w))) AS nrm FROM {name}_c)
, {name} AS MATERIALIZED (SELECT key, list_transform(cnt, lambda v: CASE WHEN nrm > 0 THEN v / nrm ELSE 0.0 END) AS e FROM {name}_n)"""


def _tokens_sql(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({text}), '[^\\pL\\pN]+'), lambda t: t <> '')"


def _central_sql(name: str, src: str, key: str, text: str, n: int = 2, rounds: int = 10) -> str:
    """DuckDB CTEs for ``name(k, summary, linked)``: PageRank of each text's sentences, one pair of CTEs per round;
    ``name_key(k, summary)`` has the sentences with the most different words instead."""
    blank = "' ' || chr(9) || chr(10) || chr(13)"
    sql = f"""
, {name}_s AS MATERIALIZED (SELECT k, i, s FROM (SELECT k, i, trim(x, {blank}) AS s FROM (SELECT k, unnest(p) AS x, generate_subscripts(p, 1) AS i
    FROM (SELECT {key} AS k, regexp_split_to_array(coalesce({text}, ''), '[.!?\n]+') AS p FROM {src}))) WHERE s <> '')
, {name}_x AS MATERIALIZED (SELECT k, i, w, tf / sqrt(sum(tf * tf) OVER (PARTITION BY k, i)) AS x
    FROM (SELECT k, i, w, CAST(count(*) AS DOUBLE) AS tf FROM (SELECT k, i, unnest({_tokens_sql('s')}) AS w FROM {name}_s) GROUP BY k, i, w))
, {name}_d AS MATERIALIZED (SELECT x.k, x.i, sum(x.x * c.c) - sum(x.x * x.x) AS d, sum(x.x * x.x) AS own, count(*) AS nt
    FROM {name}_x x JOIN (SELECT k, w, sum(x) AS c FROM {name}_x GROUP BY k, w) c USING (k, w) GROUP BY x.k, x.i)
, {name}_v0 AS MATERIALIZED (SELECT s.k, s.i, 1.0::DOUBLE / count(*) OVER (PARTITION BY s.k) AS v, count(*) OVER (PARTITION BY s.k) AS m,
    coalesce(own, 0) AS own, coalesce(nt, 0) AS nt, coalesce(d.d, 0) AS d FROM {name}_s s LEFT JOIN {name}_d d USING (k, i))"""
    for r in range(1, rounds + 1):
        sql += f"""
, {name}_u{r} AS MATERIALIZED (SELECT k, w, sum(x * v / d) AS c FROM {name}_x JOIN {name}_v{r - 1} USING (k, i) WHERE d > 1e-9 GROUP BY k, w)
, {name}_v{r} AS MATERIALIZED (SELECT v.k, v.i, 0.15::DOUBLE / m + 0.85::DOUBLE * (coalesce(h.s, 0) - CASE WHEN d > 1e-9 THEN own * v / d ELSE 0 END) AS v, m, own, nt, d
    FROM {name}_v{r - 1} v LEFT JOIN (SELECT x.k, x.i, sum(x.x * u.c) AS s FROM {name}_x x JOIN {name}_u{r} u USING (k, w) GROUP BY x.k, x.i) h USING (k, i))"""
    return sql + f"""
, {name}_r AS (SELECT k, i, s, max(d) OVER (PARTITION BY k) > 1e-9 AS linked,
      row_number() OVER (PARTITION BY k ORDER BY round(v * m, 9) DESC, nt DESC, i) AS central,
      row_number() OVER (PARTITION BY k ORDER BY nt DESC, i) AS most FROM {name}_v{rounds} JOIN {name}_s USING (k, i))
, {name} AS (SELECT k, string_agg(s, '. ' ORDER BY i) || '.' AS summary, bool_or(linked) AS linked FROM {name}_r WHERE central <= {n} GROUP BY k)
, {name}_key AS (SELECT k, string_agg(s, '. ' ORDER BY i) || '.' AS summary FROM {name}_r WHERE most <= {n} GROUP BY k)"""


def _summary_sql(src: str, key: str, text: str) -> str:
    """DuckDB spelling of the map-reduce summary of ``src`` (chunks 2048/256 of the whole text): ``msum(k, summary)``."""
    return _separator_chunks_sql("mc", src, key, text, 2048, 256) + """
, mk AS (SELECT CAST(k AS VARCHAR) || '|' || CAST(chunk_no AS VARCHAR) AS ck, k, chunk_no, chunk FROM mc)""" \
        + _central_sql("mm", "mk", "ck", "chunk") + """
, mj AS (SELECT mk.k AS jk, string_agg(coalesce(mm.summary, ''), chr(10) || chr(10) ORDER BY chunk_no) AS joined FROM mk LEFT JOIN mm ON mk.ck = mm.k GROUP BY mk.k)""" \
        + _central_sql("msum", "mj", "jk", "joined")


_LABELS = ("topic", "category", "quality")


def _classifier_sql(name: str, src: str, key: str, text: str) -> str:
    """DuckDB CTEs for ``name(k, topic, category, score, quality)``: naive Bayes over ``rank_training``, scored on ``src``."""
    sql = f"""
, {name}_w AS MATERIALIZED (SELECT topic, category, quality, unnest({_tokens_sql('text')}) AS w FROM rank_training)
, {name}_voc AS MATERIALIZED (SELECT count(DISTINCT w) AS v FROM {name}_w)
, {name}_n AS MATERIALIZED (SELECT {key} AS k, len({_tokens_sql(f"coalesce({text}, '')")}) AS t FROM {src})
, {name}_i AS MATERIALIZED (SELECT k, w, count(*) AS tf FROM (SELECT {key} AS k, unnest({_tokens_sql(f"coalesce({text}, '')")}) AS w FROM {src}) GROUP BY k, w)"""
    for x in _LABELS:
        sql += f"""
, {name}_c_{x} AS MATERIALIZED (SELECT {x} AS label, w, count(*) AS n FROM {name}_w GROUP BY {x}, w)
, {name}_t_{x} AS MATERIALIZED (SELECT label, docs, coalesce(n, 0) AS n, sum(docs) OVER () AS total FROM (SELECT {x} AS label, count(*) AS docs FROM rank_training GROUP BY {x})
    LEFT JOIN (SELECT label, sum(n) AS n FROM {name}_c_{x} GROUP BY label) USING (label))
, {name}_h_{x} AS MATERIALIZED (SELECT k, label, sum(tf * ln(n + 1)) AS s FROM {name}_i JOIN {name}_c_{x} USING (w) GROUP BY k, label)
, {name}_s_{x} AS (SELECT n.k, l.label, ln(l.docs / l.total) - n.t * ln(l.n + (SELECT v FROM {name}_voc)) + coalesce(h.s, 0) AS s
    FROM {name}_n n CROSS JOIN {name}_t_{x} l LEFT JOIN {name}_h_{x} h ON h.k = n.k AND h.label = l.label)
, {name}_p_{x} AS MATERIALIZED (SELECT k, label, round(e / sum(e) OVER (PARTITION BY k), 6) AS p FROM (SELECT k, label, exp(s - max(s) OVER (PARTITION BY k)) AS e FROM {name}_s_{x}))
, {name}_b_{x} AS (SELECT k, label, p FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY p DESC, label) AS rk FROM {name}_p_{x}) WHERE rk = 1)"""
    return sql + f"""
, {name} AS MATERIALIZED (SELECT n.k, t.label AS topic, c.label AS category, t.p AS score, coalesce(q.p, 0) AS quality
    FROM {name}_n n JOIN {name}_b_topic t ON t.k = n.k JOIN {name}_b_category c ON c.k = n.k LEFT JOIN {name}_p_quality q ON q.k = n.k AND q.label = '1')"""


def rank_classifier(spark, sf) -> RankClassifier:
    return RankClassifier(classify.fit(binding(spark, sf, "rank_training"), "doc_id", "text", list(_LABELS)))


def _digest_sql(prefix: str, x: str) -> str:
    return f"CASE WHEN coalesce({x}, '') = '' THEN '' ELSE '{prefix}' || md5({x}) END"


# ---------------------------------------------------------------- M1, M2, M8
@register("chunk_overlap", uses=("items",), sql=_chunks_sql("c", "items", "id", "body", 1024, 128) + """
SELECT k AS id, chunk_no, CAST(length(chunk) AS BIGINT) AS chunk_len, md5(chunk) AS chunk_md5 FROM c""")
def chunk_overlap(spark, sf):
    """M1 (index variant, fixed stride): 1024-character windows overlapping by 128, whole texts."""
    c = CH.explode_chunks(binding(spark, sf, "items"), "id", "body", 1024, 128)
    return c.select("id", "chunk_no", F.length("chunk").cast("bigint").alias("chunk_len"), F.md5("chunk").alias("chunk_md5"))


@register("chunk_recursive", uses=("items",), sql=_separator_chunks_sql("c", "items", "id", "body", 2048, 256) + """
SELECT k AS id, chunk_no, CAST(length(chunk) AS BIGINT) AS chunk_len, md5(chunk) AS chunk_md5 FROM c""")
def chunk_recursive(spark, sf):
    """M1 (separator-aware, summary variant 2048/256): chunk rows per text."""
    c = CH.recursive_chunks(binding(spark, sf, "items"), "id", "body", 2048, 256)
    return c.select("id", "chunk_no", F.length("chunk").cast("bigint").alias("chunk_len"), F.md5("chunk").alias("chunk_md5"))


def _pack_sql(src: str, key: str, text: str, limit: int = 1800) -> str:
    """DuckDB spelling of sentence packing: a running size with resets, one recursion step per sentence."""
    return f"""
, sent AS (SELECT k, CAST(generate_subscripts(p, 1) AS INTEGER) AS i, unnest(p) AS s
           FROM (SELECT {key} AS k, string_split(coalesce({text}, ''), '.') AS p FROM {src}))
, nsent AS (SELECT k, max(i) AS n FROM sent GROUP BY k)
, pk(k, i, cur, cnt, size, emit) AS (
    SELECT {key}, 1, '', 0, 0, NULL::VARCHAR FROM {src}
    UNION ALL
    SELECT pk.k, pk.i + 1,
      CASE WHEN pk.size + length(s.s) <= {limit} THEN (CASE WHEN pk.cnt = 0 THEN s.s ELSE pk.cur || '. ' || s.s END) ELSE s.s END,
      CASE WHEN pk.size + length(s.s) <= {limit} THEN pk.cnt + 1 ELSE 1 END,
      CASE WHEN pk.size + length(s.s) <= {limit} THEN pk.size + length(s.s) ELSE length(s.s) END,
      CASE WHEN pk.size + length(s.s) <= {limit} THEN NULL ELSE pk.cur END
    FROM pk JOIN sent s ON s.k = pk.k AND s.i = pk.i)
, packed AS (SELECT k, i, emit AS block FROM pk WHERE emit IS NOT NULL
             UNION ALL SELECT pk.k, pk.i + 1000000000, pk.cur FROM pk JOIN nsent ON pk.k = nsent.k AND pk.i = nsent.n + 1)
, blocks AS (SELECT k, CAST(row_number() OVER (PARTITION BY k ORDER BY i) - 1 AS INTEGER) AS block_no, block FROM packed)"""


@register("pack_sentences", uses=("items",), recursive=True, sql=_pack_sql("items", "id", "body") + """
SELECT k AS id, block_no, CAST(length(block) AS BIGINT) AS block_len, md5(block) AS block_md5 FROM blocks""")
def pack_sentences(spark, sf):
    """M2: sentence blocks of at most 1800 characters per text (JVM ``aggregate``; recursive-SQL oracle)."""
    i = binding(spark, sf, "items")
    b = i.select("id", F.posexplode(CH.pack_sentences("body", 1800)).alias("block_no", "block"))
    return b.select("id", "block_no", F.length("block").cast("bigint").alias("block_len"), F.md5("block").alias("block_md5"))


@register("chunk_index", uses=("items",), sql=_chunks_sql("c", "items", "id", "body", 1024, 128) + """
, h AS (SELECT md5(chunk) AS chunk_id, k, chunk_no,
               row_number() OVER (PARTITION BY md5(chunk) ORDER BY k, chunk_no) AS rn,
               count(*) OVER (PARTITION BY md5(chunk)) AS n_copies FROM c)
SELECT chunk_id, k AS id, chunk_no, CAST(n_copies AS BIGINT) AS n_copies FROM h WHERE rn = 1""")
def chunk_index(spark, sf):
    """M8: chunk ids are the md5 of the chunk text; equal texts share one entry."""
    c = CH.explode_chunks(binding(spark, sf, "items"), "id", "body", 1024, 128)
    out = CH.chunk_index(c, "id")
    return out.select("chunk_id", "id", "chunk_no", F.col("n_copies").cast("bigint"))


# ---------------------------------------------------------------- M5, J15, M9, K14
@register("embed_text", uses=("items",), sql=f"""
, b AS (SELECT id, {_buckets_sql("body")} AS bk FROM items)
, c AS (SELECT id, bk, list_transform(range(64), lambda i: len(list_filter(bk, lambda x: x = i))) AS cnt FROM b)
SELECT id, CAST(len(bk) AS BIGINT) AS n_tokens,
       array_to_string(list_filter(list_transform(range(64), lambda i: CASE WHEN cnt[i + 1] > 0
           THEN CAST(i AS VARCHAR) || ':' || CAST(cnt[i + 1] AS VARCHAR) END), lambda x: x IS NOT NULL), '|') AS buckets
FROM c""")
def embed_text(spark, sf):
    """M5: hashed token counts per text (the offline embedder's input to normalisation)."""
    i = binding(spark, sf, "items").select("id", "body")
    out = spread(i).select("id", bucket_counts("body", 64).alias("cnt"))
    rendered = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda j: F.when(
        F.element_at("cnt", j + 1) > 0, F.concat(j.cast("string"), F.lit(":"), F.element_at("cnt", j + 1).cast("string"))))
    n = F.aggregate("cnt", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return out.select("id", n.alias("n_tokens"), F.array_join(F.filter(rendered, lambda x: x.isNotNull()), "|").alias("buckets"))


_RETRIEVE_SQL = _chunks_sql("c", "documents", "doc_id", "text", 1024, 128) + """
, cc AS MATERIALIZED (SELECT CAST(k AS VARCHAR) || ':' || CAST(chunk_no AS VARCHAR) AS item_id, chunk FROM c)""" + _embed_ctes("r", "cc", "item_id", "chunk") \
    + _embed_ctes("q", "benchmark", "item_id", "text") + """
, p AS (SELECT q.key AS query_id, r.key AS item_id,
               round(greatest(list_inner_product(q.e, q.e) + list_inner_product(r.e, r.e) - 2 * list_inner_product(q.e, r.e), 0), 6) AS distance
        FROM q, r)
, k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, item_id) AS rnk FROM p)
SELECT query_id, CAST(split_part(item_id, ':', 1) AS BIGINT) AS doc_id, CAST(split_part(item_id, ':', 2) AS INTEGER) AS chunk_no, distance
FROM k WHERE rnk <= 3 AND distance <= 0.5"""


def _chunk_vectors(spark, sf):
    d = spread(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    c = CH.explode_chunks(d, "doc_id", "text", 1024, 128)
    return c.select(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("chunk_no").cast("string")).alias("item_id"),
                    hashing_embedding(F.col("chunk")).alias("embedding"))


@register("chunk_retrieve", uses=(), sql=_RETRIEVE_SQL)
def chunk_retrieve(spark, sf):
    """For each benchmark text, the 3 nearest document chunks (squared L2), kept if distance <= 0.5."""
    q = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("query_id"),
                                                              hashing_embedding(F.col("text")).alias("embedding"))
    nb = knn.knn_join(q, _chunk_vectors(spark, sf), 3, "L2_SQUARED")
    nb = nb.where(knn.within_threshold(F.col("distance"), "L2_SQUARED", 0.5))
    return nb.select("query_id", F.split_part("item_id", F.lit(":"), F.lit(1)).cast("bigint").alias("doc_id"),
                     F.split_part("item_id", F.lit(":"), F.lit(2)).cast("int").alias("chunk_no"), "distance")


_EVIDENCE_SQL = _embed_ctes("d", "documents", "doc_id", "text") + _embed_ctes("q", "benchmark", "item_id", "text") + """
, p AS (SELECT q.key AS item_id, d.key AS doc_id, round(list_inner_product(q.e, d.e), 6) AS distance FROM q, d)
, k0 AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY distance DESC, doc_id) AS rnk FROM p)
, k AS (SELECT k0.*, documents.text FROM k0 JOIN documents ON k0.doc_id = documents.doc_id WHERE rnk <= 3)
SELECT item_id, doc_id, CAST(rnk AS INTEGER) AS rnk,
       CASE WHEN length(text) > 0 THEN 'S:' || md5(text) ELSE md5(text) END AS evidence
FROM k WHERE rnk <= 3"""


def _evidence(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    q = spark.read.parquet(f"{sf}/benchmark.parquet")
    return R.collect_evidence(q, d, EN.DigestModel("S:"), k=3)


_RECENT_DAYS = 12
_BM25_SQL = f"""
, bw AS MATERIALIZED (SELECT doc_id, unnest(w) AS w, len(w) AS n FROM (SELECT doc_id, {_tokens_sql("coalesce(text, '')")} AS w FROM papers))
, btf AS MATERIALIZED (SELECT doc_id, w, count(*) AS tf, any_value(n) AS n FROM bw GROUP BY doc_id, w)
, bdf AS MATERIALIZED (SELECT w, count(*) AS df FROM btf GROUP BY w)
, ball AS (SELECT count(*) AS docs, avg(len({_tokens_sql("coalesce(text, '')")})) AS mean FROM papers)
, bq AS (SELECT DISTINCT item_id, unnest({_tokens_sql("text")}) AS w FROM benchmark)
, bscore AS (SELECT item_id, doc_id, round(sum(ln(1.0::DOUBLE + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean))), 6) AS score
    FROM bq JOIN bdf USING (w) JOIN btf USING (w), ball GROUP BY item_id, doc_id)
, btop AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rnk FROM bscore)
, recent AS (SELECT btop.item_id, btop.doc_id, btop.rnk, btop.score, papers.text FROM btop JOIN papers USING (doc_id)
    WHERE rnk <= 5 AND published >= TIMESTAMP '{RUN_TS}' - INTERVAL {_RECENT_DAYS} DAY)"""


@register("collect_evidence", uses=("papers",), sql=_EVIDENCE_SQL.replace("SELECT item_id, doc_id, CAST(rnk AS INTEGER) AS rnk,\n", ", alike AS (SELECT item_id, doc_id, CAST(rnk AS INTEGER) AS rnk,\n") + ")" + _BM25_SQL + """
SELECT item_id, 'document' AS kind, doc_id, rnk, evidence FROM alike
UNION ALL SELECT item_id, 'paper', doc_id, CAST(rnk AS INTEGER), md5(text) FROM recent""")
def collect_evidence(spark, sf):
    """M9: per topic text the 3 most similar documents, whole bodies summarised, and of its 5 most relevant papers the recent ones."""
    topics, docs = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("benchmark", "documents"))
    e = R.collect_all_evidence(topics, docs, binding(spark, sf, "papers"), EN.DigestModel("S:"), now=ts(RUN_TS), days=_RECENT_DAYS)
    whole = (F.col("kind") == "paper") | (F.length("evidence") == 0)
    return e.select("item_id", "kind", "doc_id", F.col("rnk").cast("int").alias("rnk"), F.when(whole, F.md5("evidence")).otherwise(F.col("evidence")).alias("evidence"))


@register("recent_papers", uses=("papers",), sql=_BM25_SQL + """
SELECT item_id, doc_id, CAST(rnk AS INTEGER) AS rnk, score FROM recent""")
def recent_papers(spark, sf):
    """Per topic its 5 most relevant papers by BM25 over an inverted index, then those of the last days."""
    out = R.recent_papers(spark.read.parquet(f"{sf}/benchmark.parquet"), binding(spark, sf, "papers"), now=ts(RUN_TS), days=_RECENT_DAYS)
    return out.select("item_id", "doc_id", F.col("rnk").cast("int").alias("rnk"), "score")


@register("reference_list", uses=(), sql=_EVIDENCE_SQL.replace(
    "SELECT item_id, doc_id, CAST(rnk AS INTEGER) AS rnk,\n       CASE WHEN length(text) > 0 THEN 'S:' || md5(text) ELSE md5(text) END AS evidence\nFROM k WHERE rnk <= 3",
    "SELECT item_id, string_agg('- [' || substr(text, 1, 30) || '](' || replace('https://docs.example/d ' || CAST(doc_id AS VARCHAR), ' ', '') || ')', chr(10) ORDER BY rnk) AS refs\nFROM k WHERE rnk <= 3 GROUP BY item_id"))
def reference_list(spark, sf):
    """``- [title](url)`` lines per topic, url without spaces, in evidence order."""
    e = _evidence(spark, sf).withColumn("title", F.substring("text", 1, 30)) \
        .withColumn("url", F.concat(F.lit("https://docs.example/d "), F.col("doc_id").cast("string")))
    return R.reference_list(e, "item_id", "rnk")


# ---------------------------------------------------------------- J9, M3, M4, M6
@register("cached_enrich", uses=("items", "cache"), sql=f"""
SELECT i.id, coalesce(c.value, {_digest_sql("S:", "i.body")}) AS summary, c.item_id IS NOT NULL AS from_cache
FROM items i LEFT JOIN (SELECT * FROM cache WHERE NOT expired) c ON i.id = c.item_id""")
def cached_enrich(spark, sf):
    """Read-through summary cache; the stand-in model runs on the misses only."""
    i = binding(spark, sf, "items")
    cache = binding(spark, sf, "cache").where(~F.col("expired")) \
        .withColumn("value", X.bytes_to_text(F.encode("value", "UTF-8")))
    out, _new = EN.read_through(i, "id", F.col("body"), cache, EN.DigestModel("S:"), "summary")
    return out.select("id", "summary", "from_cache")


def _hit_rate_variant(name: str, cache_binding: str | None):
    sql = (f"SELECT i.id, coalesce(c.value, {_digest_sql('S:', 'i.body')}) AS summary, "
           "c.item_id IS NOT NULL AS from_cache FROM items i LEFT JOIN "
           + (f"{cache_binding} c ON i.id = c.item_id" if cache_binding else
              "(SELECT NULL::BIGINT AS item_id, NULL::VARCHAR AS value WHERE false) c ON i.id = c.item_id"))

    @register(name, uses=("items",) + ((cache_binding,) if cache_binding else ()), sql=sql)
    def q(spark, sf):
        i = binding(spark, sf, "items")
        if cache_binding:
            cache = binding(spark, sf, cache_binding)
        else:   # cold start: the cache table exists but holds nothing yet
            cache = spark.createDataFrame([], "item_id BIGINT, value STRING")
        out, _new = EN.read_through(i, "id", F.col("body"), cache, EN.DigestModel("S:"), "summary")
        return out.select("id", "summary", "from_cache")

    q.__name__ = name
    q.__doc__ = (f"J9: read-through summary cache at {'0' if not cache_binding else '50' if 'half' in cache_binding else '100'}"
                 " % hits; the model runs on the misses only.")
    return q


cached_enrich_cold = _hit_rate_variant("cached_enrich_cold", None)
cached_enrich_half = _hit_rate_variant("cached_enrich_half", "cache_half")
cached_enrich_warm = _hit_rate_variant("cached_enrich_warm", "cache_all")


@register("mapreduce_summary", uses=("items",), sql=_summary_sql("items", "id", "body") + """
SELECT i.id, coalesce(m.summary, '') AS summary FROM items i LEFT JOIN msum m ON i.id = m.k""")
def mapreduce_summary(spark, sf):
    """Chunks (2048/256) -> their most central sentences -> ordered combine -> the most central of those."""
    i = binding(spark, sf, "items").select("id", "body")
    out = EN.mapreduce_summary(i, "id", "body", CentralSentences(), CentralSentences(), size=2048, overlap=256)
    return out.select("id", "summary")


@register("classify_rank", uses=("scored", "items", "rank_training"), sql="""
, g AS (SELECT s.id, (s.relevant_score > 0 AND s.relevant_score < 4) AS gated, i.body FROM scored s JOIN items i ON s.id = i.id)
, todo AS MATERIALIZED (SELECT id, body FROM g WHERE NOT gated)""" + _classifier_sql("nb", "todo", "id", "body") + """
SELECT id, NOT gated AS ranked,
  CASE WHEN gated THEN '' ELSE topic || ':' || printf('%.6f', score) END AS topics,
  CASE WHEN gated THEN '' ELSE category || ':' || printf('%.6f', score) END AS categories,
  CASE WHEN gated THEN -0.02 ELSE quality END AS rate, CASE WHEN gated THEN '' ELSE topic || '/' || category END AS feedback
FROM g LEFT JOIN nb ON g.id = nb.k""")
def classify_rank(spark, sf):
    """Gated rows get defaults and -0.02; others are ranked by the trained classifier and parsed."""
    from feedsift.functions.labels import render_labels

    s = binding(spark, sf, "scored").join(binding(spark, sf, "items").select("id", "body"), "id")
    out = EN.classify_rank(s, "id", "relevant_score", F.col("body"), rank_classifier(spark, sf))
    return out.select("id", "ranked", render_labels("topics").alias("topics"),
                      render_labels("categories").alias("categories"), F.round("rate", 6).alias("rate"), "feedback")


@register("fallback_enrich", uses=("items",), sql=_central_sql("cs", "items", "id", "body") + """
SELECT items.id, coalesce(CASE WHEN cs.linked THEN cs.summary ELSE cs_key.summary END, '') AS summary,
       CASE WHEN cs.linked THEN 'central-sentences' ELSE 'key-sentences' END AS used
FROM items LEFT JOIN cs ON items.id = cs.k LEFT JOIN cs_key ON items.id = cs_key.k""")
def fallback_enrich(spark, sf):
    """M6: the most central sentences of the whole text; texts whose sentences share no word go to the fallback, the
    sentences with the most different words."""
    i = binding(spark, sf, "items").select("id", "body")
    out = EN.fallback_enrich(i, F.col("body"), CentralSentences(answer_unlinked=False), KeySentences(), "summary")
    return out.select("id", "summary", "used")


# ---------------------------------------------------------------- A8, R9, M11, K7
_ROLLUP = """
, r AS (SELECT CAST(created_time AS DATE) AS day, count(*) AS n,
               string_agg(title || ' ' || content || chr(10), '' ORDER BY created_time, id) AS text,
               max(created_time) AS last_created
        FROM notes GROUP BY CAST(created_time AS DATE))"""


# every day of January, the last ones without notes in small tables
_DAYS = ("2024-01-01", "2024-01-31")
_ALL_DAYS = _ROLLUP.replace(", r AS (", ", r0 AS (") + f"""
, r AS (SELECT d.day, coalesce(n, 0) AS n, coalesce(text, '') AS text, last_created
        FROM (SELECT CAST(unnest(generate_series(DATE '{_DAYS[0]}', DATE '{_DAYS[1]}', INTERVAL 1 DAY)) AS DATE) AS day) d LEFT JOIN r0 ON d.day = r0.day)"""


@register("journal_record", uses=("notes",), recursive=True, sql=_ALL_DAYS + _pack_sql("r", "day", "text") + """
SELECT k AS day, CAST(block_no AS BIGINT) AS block_no, CAST(length(block) AS BIGINT) AS block_len, md5(block) AS block_md5 FROM blocks""")
def journal_record(spark, sf):
    """K7/M2: each day's journal text, also an empty one, as blocks of at most 1800 characters, packed as rows."""
    b = R.journal_blocks(binding(spark, sf, "notes"), *_DAYS)
    return b.select("day", "block_no", F.length("block").cast("bigint").alias("block_len"), F.md5("block").alias("block_md5"))


@register("journal_rollup", uses=("notes",), sql=_ALL_DAYS + f"""
SELECT day, CAST(n AS BIGINT) AS n_notes, CAST(length(text) AS BIGINT) AS n_chars, md5(text) AS text_md5, {_TS("last_created")} AS last_created FROM r""")
def journal_rollup(spark, sf):
    """A row for every day, with or without notes: count, characters, the whole text (its md5), last creation time."""
    out = R.journal_days(binding(spark, sf, "notes"), *_DAYS)
    return out.select("day", F.col("n_notes").cast("bigint"), F.col("n_chars").cast("bigint"), "text_md5", ts_text("last_created").alias("last_created"))


@register("journal_lines", uses=("notes",), sql="""
SELECT CAST(created_time AS DATE) AS day, row_number() OVER (PARTITION BY CAST(created_time AS DATE) ORDER BY created_time, id) - 1 AS line_no,
       md5(title || ' ' || content || chr(10)) AS line_md5 FROM notes""")
def journal_lines(spark, sf):
    """Every day's lines in creation order, numbered without gathering a day in one task."""
    return R.journal_lines(binding(spark, sf, "notes")).select("day", F.col("line_no").cast("bigint"), F.md5("line").alias("line_md5"))


@register("daily_rollup_window", uses=("notes",), sql=f"""
SELECT {_TS("date_trunc('day', created_time)")} AS window_start, CAST(count(*) AS BIGINT) AS n_notes,
       CAST(sum(length(content)) AS BIGINT) AS n_chars FROM notes GROUP BY date_trunc('day', created_time)""")
def daily_rollup_window(spark, sf):
    """One-day tumbling windows over creation time."""
    n = binding(spark, sf, "notes")
    w = n.groupBy(F.window("created_time", "1 day")).agg(F.count(F.lit(1)).alias("n_notes"),
                                                          F.sum(F.length("content")).alias("n_chars"))
    return w.select(ts_text(F.col("window.start")).alias("window_start"), F.col("n_notes").cast("bigint"),
                    F.col("n_chars").cast("bigint"))


@register("journal_refine", uses=("notes",), sql=_ROLLUP + """
, w AS (SELECT day, """ + _digest_sql("S:", "'rewrite|' || text") + """ AS rewrite FROM r)
SELECT day, rewrite, """ + ", ".join(f"{_digest_sql('S:', repr(p + '|') + ' || rewrite')} AS {p}" for p in EN.JOURNAL_PASSES[1:]) + " FROM w")
def journal_refine(spark, sf):
    """A rewrite of each day's roll-up, and five passes over the rewrite (stand-in model)."""
    out = R.journal_refined(binding(spark, sf, "notes"), EN.DigestModel("S:"))
    return out.select("day", *[F.col(f"refined.{p}").alias(p) for p in EN.JOURNAL_PASSES])


# ---------------------------------------------------------------- P14/K8/J16, M10, M12
_TODO_ROWS = """
, l AS (SELECT id, string_split(todo, chr(10)) AS a, string_split(todo_trans, chr(10)) AS b FROM {src})
, z AS (SELECT id, a[i] AS line, b[i] AS tline, i FROM (SELECT id, a, b, unnest(range(1, least(len(a), len(b)) + 1)) AS i FROM l))
SELECT id, CAST(i AS INTEGER) AS line_no, substr(line, 4) AS action, substr(tline, 4) AS translation FROM z
WHERE NOT ({strip_line} IN ('', 'n/a', 'None', 'None.'))
  AND NOT (i = 1 AND contains(line, 'Action Items'))
  AND NOT ({strip_action} IN ('', 'n/a', 'None', 'None.'))"""
_STRIP = "regexp_replace({x}, '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g')"


def _todo_rows_sql(src: str) -> str:
    return _TODO_ROWS.format(src=src, strip_line=_STRIP.format(x="line"), strip_action=_STRIP.format(x="substr(line, 4)"))


@register("todo_rows", uses=("action_lists",), sql=_todo_rows_sql("action_lists"))
def todo_rows(spark, sf):
    """One row per valid action line, paired with its translation line (zip to the shorter)."""
    a = binding(spark, sf, "action_lists")
    return R.todo_rows(a, "id", "todo", "todo_trans").select("id", "line_no", "action", "translation")


_TODO_GEN_SQL = """
, latest AS (SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY last_edited_time DESC, arrival ASC) AS rn FROM rated_pages
    WHERE user_rating IS NOT NULL AND user_rating <> '') WHERE rn = 1)
, pages AS (SELECT id, take_aways FROM latest WHERE source NOT IN ('error', 'signup') AND NOT list_contains(tags, 'action:deepdive')
            AND length(coalesce(take_aways, '')) > 0)
, gen AS (SELECT id, 'Action Items' || chr(10) || '1. ' || substr(md5(take_aways), 1, 8) || chr(10) || '2. None' AS todo,
                 'T' || chr(10) || '1. ' || substr(md5('tr|' || take_aways), 1, 8) || chr(10) || '2. None' AS todo_trans FROM pages)
""" + _todo_rows_sql("gen")


@register("todo_generate", uses=("rated_pages",), sql=_TODO_GEN_SQL)
def todo_generate(spark, sf):
    """F8 exclusion -> F6 take-aways -> action-list model -> translate -> F10/K8 action rows."""
    p = sync_rated(binding(spark, sf, "rated_pages").select("id", "arrival", "source", "user_rating",
                                                            "last_edited_time", "take_aways", "tags"))
    p = exclude_source_tag(p, sources=["error", "signup"]).where(F.length(F.coalesce("take_aways", F.lit(""))) > 0)
    g = R.todo_generate(p, "id", "take_aways", R.ActionListModel(), R.ActionListModel(prefix="tr|", header="T"))
    return R.todo_rows(g, "id", "todo", "todo_trans").select("id", "line_no", "action", "translation")


@register("refine_versions", uses=("rated_pages",), sql="""
, latest AS (SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY last_edited_time DESC, arrival ASC) AS rn FROM rated_pages
    WHERE user_rating IS NOT NULL AND user_rating <> '') WHERE rn = 1)
, v1 AS (SELECT id, CASE WHEN coalesce(take_aways, '') = '' THEN '' ELSE 'S:' || md5(take_aways) END AS t FROM latest
         WHERE list_contains(tags, 'action:deepdive'))
, v2 AS (SELECT id, CASE WHEN t = '' THEN '' ELSE 'S:' || md5(t) END AS t FROM v1)
, v3 AS (SELECT id, CASE WHEN t = '' THEN '' ELSE 'S:' || md5(t) END AS t FROM v2)
SELECT id, 1 AS version, t AS text, false AS is_current FROM v1
UNION ALL SELECT id, 2, t, false FROM v2 UNION ALL SELECT id, 3, t, true FROM v3""")
def refine_versions(spark, sf):
    """Three refinement rounds of the deep-dive pages; all versions kept, the last is current."""
    p = sync_rated(binding(spark, sf, "rated_pages").select("id", "arrival", "source", "user_rating",
                                                            "last_edited_time", "take_aways", "tags"))
    out = EN.refine_versions(include_tag(p), "id", "take_aways", EN.DigestModel("S:"), rounds=3)
    return out.select("id", "version", "text", "is_current")


# ---------------------------------------------------------------- S11, S12, P8, J10, P6
def _page_text_sql() -> str:
    """DuckDB spelling of S11 on the stored pages: drop script/style/template blocks, comments and declarations,
    strip tags, decode the entities the pages use, collapse blank lines, strip."""
    x = "html"
    for pattern in (r"<(script|style|template)\b[^>]*>.*?</(script|style|template)\s*>", r"<!--.*?-->"):
        x = f"regexp_replace({x}, '{pattern}', '', 'gs')"
    x = f"regexp_replace(regexp_replace({x}, '<![^>]*>', '', 'g'), '<[^>]*>', '', 'g')"
    # HTML5 decodes these legacy named references even without the ';' (e.g. "&ampX" -> "&X"); '&amp' goes last so
    # that, as in one decoding pass, it never creates a new reference
    for name, ch in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("lt", "<"), ("gt", ">"), ("nbsp", "\u00a0"),
                     ("amp", "&")):
        x = f"regexp_replace({x}, '&{name};?', '{ch}', 'g')"
    x = f"replace({x}, '&#39;', chr(39))"
    collapsed = f"regexp_replace({x}, '\\n{{2,}}', chr(10), 'g')"
    text = "coalesce(" + _STRIP.format(x=collapsed) + ", '')"
    return f"SELECT page_id, CAST(length(t) AS BIGINT) AS n_chars, md5(t) AS text_md5 FROM (SELECT page_id, {text} AS t FROM pages)"


@register("page_text", uses=(), sql=_page_text_sql())
def page_text(spark, sf):
    """Text of each stored web page (script/style/template skipped), blank lines collapsed; HTML parsed in mapInPandas."""
    p = spark.read.parquet(f"{sf}/pages.parquet")
    t = html_page_text(p)
    return t.select("page_id", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("text_md5"))


_RENDER_SQL = ("CASE type WHEN 'bulleted_list_item' THEN '- ' || text || chr(10) "
               "WHEN 'numbered_list_item' THEN '1. ' || text || chr(10) WHEN 'code' THEN '```' || text || '```' "
               "WHEN 'paragraph' THEN text ELSE '' END")


@register("blocks_to_text", uses=("blocks",), sql=f"""
SELECT page_id, md5(string_agg({_RENDER_SQL}, '' ORDER BY pos)) AS text_md5,
       CAST(length(string_agg({_RENDER_SQL}, '' ORDER BY pos)) AS BIGINT) AS n_chars
FROM blocks GROUP BY page_id""")
def blocks_to_text_q(spark, sf):
    """Blocks rendered by type and concatenated in position order."""
    t = blocks_to_text(binding(spark, sf, "blocks"))
    return t.select("page_id", F.md5("text").alias("text_md5"), F.length("text").cast("bigint").alias("n_chars"))


@register("tree_to_text", uses=("tree_blocks",), recursive=True, sql="""
, walk AS (SELECT page_id, block_id, type, text, cells, [pos] AS path FROM tree_blocks WHERE parent IS NULL
  UNION ALL SELECT b.page_id, b.block_id, b.type, b.text, b.cells, list_append(w.path, b.pos)
  FROM walk w JOIN tree_blocks b ON b.page_id = w.page_id AND b.parent = w.block_id WHERE w.type IN ('toggle', 'table'))
, parts AS (SELECT page_id, path, CASE type WHEN 'toggle' THEN text || chr(10) WHEN 'table_row' THEN array_to_string(cells, ',') || ',' || chr(10)
      WHEN 'bulleted_list_item' THEN '- ' || text || chr(10) WHEN 'code' THEN '```' || text || '```' WHEN 'table' THEN '' ELSE text END AS part FROM walk
  UNION ALL SELECT page_id, list_append(path, 9223372036854775807), '|' FROM walk WHERE len(path) = 1)
SELECT p.page_id, md5(coalesce(string_agg(part, '' ORDER BY path), '')) AS text_md5, CAST(coalesce(sum(length(part)), 0) AS BIGINT) AS n_chars
FROM (SELECT DISTINCT page_id FROM tree_blocks) p LEFT JOIN parts ON p.page_id = parts.page_id GROUP BY p.page_id""")
def tree_to_text_q(spark, sf):
    """Pages of nested blocks, five levels deep: toggles with their children, tables with the cells of their rows."""
    t = tree_to_text(binding(spark, sf, "tree_blocks"), separator="|")
    return t.select("page_id", F.md5("text").alias("text_md5"), F.length("text").cast("bigint").alias("n_chars"))


@register("score_text_digest", uses=("blocks",), sql=f"""
, t AS (SELECT page_id, string_agg({_RENDER_SQL} || chr(10), '' ORDER BY pos) AS text,
               max(CASE WHEN pos = 0 THEN substr(text, 1, 50) END) AS first_text FROM blocks GROUP BY page_id)
SELECT page_id, md5('page ' || CAST(page_id AS VARCHAR) || ': ' || text
                    || CASE WHEN page_id % 2 = 1 AND coalesce(first_text, '') <> '' THEN chr(10) || 'Take aways: ' || first_text ELSE '' END) AS score_md5
FROM t""")
def score_text_digest(spark, sf):
    """``"{title}: {blocks}"`` (blocks joined with newlines) plus take-aways when present."""
    b = binding(spark, sf, "blocks")
    t = blocks_to_text(b, separator="\n")
    first = b.where(F.col("pos") == 0).select("page_id", F.substring("text", 1, 50).alias("first_text"))
    j = t.join(first, "page_id", "left")
    take = F.when(F.col("page_id") % 2 == 1, F.col("first_text")).otherwise(F.lit(""))
    title = F.concat(F.lit("page "), F.col("page_id").cast("string"))
    return j.select("page_id", F.md5(X.score_text_digest(title, F.col("text"), take)).alias("score_md5"))


@register("reply_enrich", uses=("replies",), sql="""
SELECT r.conv_id, r.turn, t.name AS reply_name, t.text IS NOT NULL AS has_reply,
       r.reply_to_turn IS NOT NULL AND t.turn IS NULL AS reply_deleted
FROM replies r LEFT JOIN (SELECT * FROM replies WHERE NOT target_deleted) t
  ON r.conv_id = t.conv_id AND r.reply_to_turn = t.turn""")
def reply_enrich(spark, sf):
    """Look up the replied-to item; a missing target marks the reply as deleted."""
    r = binding(spark, sf, "replies")
    out = R.reply_enrich(r, r.where(~F.col("target_deleted")), ["conv_id"], "reply_to_turn", "turn")
    return out.select("conv_id", "turn", "reply_name", F.col("reply_text").isNotNull().alias("has_reply"), "reply_deleted")


@register("score_text_short", uses=("replies",), sql="""
SELECT r.conv_id, r.turn,
       md5(CASE WHEN coalesce(t.text, '') <> '' THEN t.name || ': ' || t.text ELSE '' END || r.name || ': ' || r.text) AS score_md5
FROM replies r LEFT JOIN (SELECT * FROM replies WHERE NOT target_deleted) t
  ON r.conv_id = t.conv_id AND r.reply_to_turn = t.turn""")
def score_text_short(spark, sf):
    """``[reply_name: reply_text]`` + ``name: text``."""
    r = binding(spark, sf, "replies")
    out = R.reply_enrich(r, r.where(~F.col("target_deleted")), ["conv_id"], "reply_to_turn", "turn")
    st = X.score_text_short(F.col("reply_name"), F.col("reply_text"), F.col("name"), F.col("text"))
    return out.select("conv_id", "turn", F.md5(st).alias("score_md5"))

"""One registered query per operator: the operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedsift.session import ensure_importable

from . import ann, conversation, decontam, langid, line_dedup, ngram_lm, packing, permuterm, secrets, simhash, substring, toxicity, wavelet
from .common import crc_fold, table, tokenizer_path
from .oracles import CONVERSATION, SPELLING

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_importable(spark)
            return fn(spark, sf_dir)

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[fn.__name__] = run
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return deco


@query()
def op1_cross_polytope_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose vec_id is divisible by 20, among all other rows."""
    v = table(spark, sf_dir, "embeddings")
    return ann.nearest(v, v.where("vec_id % 20 = 0"), k=20)


@query()
def op2_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens written to wavelet-matrix shards and read back: global start, length and checksum."""
    shards = wavelet.write_shards(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)
    return wavelet.read_documents(shards)


@query()
def op3_elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and bigram log10 probability of every document, learnt from nine of ten folds."""
    return ngram_lm.score(table(spark, sf_dir, "documents"), folds=10)


@query()
def op4_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by the positive-unlabelled model fitted on four of five folds."""
    docs = table(spark, sf_dir, "documents")
    got = toxicity.scored(docs.select("doc_id", "text"), toxicity.train(docs, table(spark, sf_dir, "labels")), "score")
    return got.select("doc_id", (crc_fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query()
def op5_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    got = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query()
def op6_secret_guess_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: counts and digest of the fixed patterns, and all spans with those the guess cost adds."""
    got = secrets.secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    got = got.select("doc_id", "secrets.*")
    return got.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_guess", "max_log10")


@query("""
WITH p AS (
  SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
    list_filter(list_transform(string_split(regexp_replace(regexp_replace(coalesce(html, ''),
      '(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', '', 'g'), '<[^>]*>', chr(10), 'g'), chr(10)),
      lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS lines,
    row_number() OVER () AS r
  FROM pages),
t AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
b AS (SELECT host, line FROM (SELECT DISTINCT r, host, unnest(lines) AS line FROM p) JOIN t USING (host)
  GROUP BY host, line HAVING count(*) >= 5 AND count(*) > 0.1 * any_value(pages)),
d AS (SELECT host, list(line) AS dropped FROM b GROUP BY host)
SELECT page_id, host, len(lines) AS n_lines, len(lines) - len(list_filter(lines, lambda x: dropped IS NULL OR NOT list_contains(dropped, x))) AS n_dropped,
  sha256(array_to_string(list_filter(lines, lambda x: dropped IS NULL OR NOT list_contains(dropped, x)), chr(10))) AS kept_sha256
FROM p LEFT JOIN d USING (host)
""")
def op7_site_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's lines without its host's boilerplate."""
    got = line_dedup.page_lines(table(spark, sf_dir, "pages"), ratio=0.1, min_pages=5)
    return got.select("page_id", "host", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


@query()
def op8_concat_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' tokens packed into sequences of 1024: one row per piece."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), width=1024, end_id=0).drop("ids")


@query(r"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, i, array_to_string(list_slice(w, i, i + 19), ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
later AS (SELECT r, i FROM (SELECT r, i, row_number() OVER (PARTITION BY s ORDER BY r, i) AS k FROM win) WHERE k > 1),
gone AS (SELECT r, list_sort(list(DISTINCT p)) AS gone FROM (SELECT r, unnest(range(i, i + 20)) AS p FROM later) GROUP BY r),
kept AS (SELECT r, coalesce(string_agg(w[p], ' ' ORDER BY p), '') AS kept
  FROM (SELECT r, w, gone, unnest(range(1, len(w) + 1)) AS p FROM d LEFT JOIN gone USING (r)) WHERE gone IS NULL OR NOT list_contains(gone, p) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (r) LEFT JOIN kept USING (r)
""")
def op9_count_min_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of 20-word windows that start earlier."""
    got = substring.dedup(table(spark, sf_dir, "documents"), window=20)
    return got.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query(f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark),
pat AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS s
  FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
win AS (SELECT r, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM pat) WHERE len(w) >= n)),
hit AS (SELECT r, win.n, i, item FROM win JOIN pat ON win.n = pat.n AND win.s = pat.s),
cov AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (r) LEFT JOIN its USING (r)
""")
def op10_wu_manber_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in an occurrence of a benchmark window."""
    got = decontam.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), window=10)
    return got.select("doc_id", "contamination.*").withColumn("contaminated", F.col("n_hit") > 0)


@query()
def op11_byte_bigru_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document by the byte network fitted on three of four folds."""
    docs = table(spark, sf_dir, "documents")
    got = langid.identified(docs.select("doc_id", "text"), langid.train(docs, folds=4, held_out=2))
    return got.select("doc_id", (crc_fold(F.col("doc_id"), 4) == 2).alias("held_out"), F.col("language.lang").alias("lang_pred"), "language.score", "language.share")


@query(SPELLING)
def op12_permuterm_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the (damaged) documents with the number of words one edit away, its form and its root."""
    return permuterm.spelling_variants(table(spark, sf_dir, "documents"), least=7, least_count=2, ratio=10, damage=31)


@query(CONVERSATION)
def op13_prefix_doubling_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged by rule, with its faults and the least of its cheapest repairs."""
    return conversation.repair_damaged(table(spark, sf_dir, "conversations"))

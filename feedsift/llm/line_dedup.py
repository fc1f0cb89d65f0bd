"""Line deduplication by site-relative frequency.

Pages are grouped by host. A line's frequency is the number of the host's pages
that contain it divided by the host's pages; lines with more than ``ratio`` of
the pages, on at least ``min_pages`` of them, are boilerplate and dropped from
every page of that host. Lines are compared without white space around them;
blank lines are never counted or dropped.

Per page each line counts once, counting is combined before it is shuffled, and a
host's boilerplate is short (its lines have more than ``ratio`` of its pages
each), so it is copied to a fixed number of salts and a hot host's pages are
spread over them. Lines are told apart by two 64-bit hashes.

Null and empty texts have no lines and stay as they are; such pages still count
for their host. A null host is a host of its own. Repeated rows are pages of
their own, unless ``copies_once`` is set: then a host's pages with the same text
count as one page, in a line's pages and in the host's, so that copies don't turn
their own lines into boilerplate. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, staged

SALTS = 32


def _hash(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), F.length(line), line).alias("b"))


def _stripped(line: Column) -> Column:
    return F.regexp_replace(line, r"^\s+|\s+$", "")


def boilerplate(pages: DataFrame, host: Column, lines: Column, ratio: float, min_pages: int, text: Column | None = None) -> DataFrame:
    """(host, drop): each host's array of hashes of its boilerplate lines; hosts without any are left out.

    ``lines`` is the array of a page's lines. With ``text``, a host's pages of the same text count once.
    """
    cols = [host.alias("__host"), F.array_distinct(F.transform(F.filter(F.transform(lines, _stripped), lambda x: x != ""), _hash)).alias("__lines")]
    base = pages.select(*cols) if text is None else pages.select(*cols, _hash(text).alias("__text")).distinct().select("__host", "__lines")
    return boilerplate_of(staged(base, "line-hashes"), ratio, min_pages)


def boilerplate_of(base: DataFrame, ratio: float, min_pages: int) -> DataFrame:
    """(host, drop) from a written table with a row for each page: ``__host`` and the distinct hashes ``__lines``."""
    total = base.groupBy("__host").agg(F.count("*").alias("__pages"))
    found = base.select("__host", F.explode("__lines").alias("__line")).groupBy("__host", "__line").agg(F.count("*").alias("__n")).where(F.col("__n") >= min_pages)
    often = found.join(total, found["__host"].eqNullSafe(total["__host"])).where(F.col("__n") > ratio * F.col("__pages"))
    return often.groupBy(found["__host"]).agg(F.collect_list("__line").alias("__drop"))


def mark(pages: DataFrame, host: Column, lines: Column, ratio: float = 0.1, min_pages: int = 5, text: Column | None = None) -> DataFrame:
    """``pages`` with ``__drop``: the hashes of the lines to drop from the page (null: none)."""
    return salted_join(pages, host, boilerplate(pages, host, lines, ratio, min_pages, text))


def salted_join(pages: DataFrame, host: Column, drop: DataFrame) -> DataFrame:
    drop = drop.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    cols = [F.col(f"`{c}`") for c in pages.columns]
    salted = pages.select(*cols, host.alias("__h"), F.pmod(F.xxhash64(*_plain(pages)), F.lit(SALTS)).cast("int").alias("__s"))
    return salted.join(drop, salted["__h"].eqNullSafe(drop["__host"]) & (salted["__s"] == drop["__salt"]), "left").select(*cols, "__drop")


def _plain(df: DataFrame) -> list[Column]:
    """Columns that can be hashed."""
    return [F.col(f"`{c}`") for c, t in df.dtypes if "map" not in t and "variant" not in t]


def keeps(line: Column, drop: Column) -> Column:
    bare = _stripped(line)
    return drop.isNull() | (bare == "") | ~F.array_contains(drop, _hash(bare))


def drop_lines(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = 0.1, min_pages: int = 5, copies_once: bool = False) -> DataFrame:
    """``docs`` without the boilerplate lines of their host (all other columns as they are, ``n_chars`` recounted if there).

    Texts that lose no line keep every character.
    """
    plain, named, columns = numbered(docs)
    text = F.col(named(text_col))
    marked = mark(plain, F.col(named(host_col)), F.split(F.coalesce(text, F.lit("")), "\n"), ratio, min_pages, F.coalesce(text, F.lit("")) if copies_once else None)
    marked = marked.withColumn("__text", F.when(F.col("__drop").isNull(), text).otherwise(F.array_join(F.filter(F.split(text, "\n"), lambda x: keeps(x, F.col("__drop"))), "\n")))
    kind = dict(docs.dtypes)
    own = {named(text_col): F.col("__text")} | ({named("n_chars"): F.length("__text").cast(kind["n_chars"])} if "n_chars" in kind else {})
    return marked.select(*[own.get(c, F.col(c)).alias(c) for c in columns]).toDF(*docs.columns)


def html_lines(html: Column) -> Column:
    """The lines of a page: its text between tags, without scripts, styles and comments."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", "")
    return F.split(F.regexp_replace(bare, r"<[^>]*>", "\n"), "\n")


def url_host(url: Column) -> Column:
    """Lower-case host of a URL without user and port; empty if it has none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def page_lines(pages: DataFrame, ratio: float = 0.1, min_pages: int = 5) -> DataFrame:
    """page_id, host, n_lines (not blank), n_dropped and the kept lines joined by line feeds, for every page.

    A page's lines are cut and hashed once and written; both passes read them.
    """
    lines = F.filter(F.transform(html_lines(F.col("html")), _stripped), lambda x: x != "")
    cut = pages.select("page_id", url_host(F.col("url")).alias("host"), lines.alias("lines"))
    cut = staged(cut.withColumn("hashes", F.transform("lines", _hash)), "lines")
    drop = boilerplate_of(cut.select(F.col("host").alias("__host"), F.array_distinct("hashes").alias("__lines")), ratio, min_pages)
    marked = salted_join(cut, F.col("host"), drop)
    kept = F.transform(F.filter(F.arrays_zip("lines", "hashes"), lambda x: F.col("__drop").isNull() | ~F.array_contains(F.col("__drop"), x["hashes"])), lambda x: x["lines"])
    marked = marked.select("page_id", "host", F.size("lines").cast("long").alias("n_lines"), F.when(F.col("__drop").isNull(), F.col("lines")).otherwise(kept).alias("kept"))
    return marked.select("page_id", "host", "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"), F.array_join("kept", "\n").alias("text"))

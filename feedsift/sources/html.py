"""Web page -> text (S11), re-aimed at stored HTML.

HTML parsing is sequential per page, so it is a small per-row helper run in
``mapInPandas`` (Spark partitions the pages); the blank-line collapse and
strip (P9) then run as JVM expressions.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedsift.functions.text import refine_text
from feedsift.operators.common import spread

# Elements whose content is not page text (the loader's text extraction skips them).
SKIP_TAGS = {"script", "style", "template"}


class _TextOf(HTMLParser):
    """All text nodes in document order, entities decoded, nothing inserted between them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        if tag in SKIP_TAGS:
            self.skip += 1

    def handle_endtag(self, tag):
        if tag in SKIP_TAGS:
            self.skip = max(0, self.skip - 1)

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(data)


def html_text(html: str | None) -> str:
    """Text of a page: every text node (title included) except script/style/template contents, concatenated."""
    if not html:
        return ""
    p = _TextOf()
    p.feed(html)
    p.close()
    return "".join(p.parts)


def page_text(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """``(key, text)`` with blank lines collapsed and whitespace stripped."""
    schema = T.StructType([T.StructField(key, pages.schema[key].dataType), T.StructField("raw_text", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "raw_text": [html_text(h) for h in b[html].tolist()]})

    out = spread(pages.select(key, html)).mapInPandas(run, schema)
    return out.select(key, refine_text(F.col("raw_text")).alias("text"))

"""Block tree -> text (S12, S13) and digest score text.

Blocks are rows ``(page_id, pos, type, text[, parent])``; children of toggles
and tables are pre-flattened by their parent path, so one ordered roll-up per
page renders the tree.  Order is explicit (``pos``), never collection order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Per-type rendering (prefix, suffix); unknown types render as ''.
RENDER = {
    "paragraph": ("", ""),
    "quote": ("", ""),
    "heading_1": ("", ""),
    "heading_2": ("", ""),
    "heading_3": ("", ""),
    "bulleted_list_item": ("- ", "\n"),
    "numbered_list_item": ("1. ", "\n"),
    "code": ("```", "```"),
    "toggle": ("", "\n"),
    "table_row": ("", "\n"),
}


def render_block(btype: Column, text: Column) -> Column:
    """One block's text by type (table rows carry their cells already joined with trailing commas)."""
    out = F.lit("")
    for t, (pre, suf) in RENDER.items():
        out = F.when(btype == t, F.concat(F.lit(pre), F.coalesce(text, F.lit("")), F.lit(suf))).otherwise(out)
    return out


def table_row_text(cells: Column) -> Column:
    """Table row cells -> ``c1,c2,...,`` (a comma after every cell)."""
    return F.array_join(F.transform(cells, lambda c: F.concat(c, F.lit(","))), "")


def blocks_to_text(blocks: DataFrame, key: str = "page_id", separator: str = "") -> DataFrame:
    """Per page, rendered blocks in ``pos`` order, ``separator`` after every block.

    ``listagg ... WITHIN GROUP (ORDER BY pos)`` builds the page text; a page's
    text is the output row, so the group is bounded by the page itself.
    """
    r = blocks.select(key, "pos", F.concat(render_block(F.col("type"), F.col("text")), F.lit(separator)).alias("_r"))
    return r.groupBy(key).agg(F.expr("listagg(_r, '') WITHIN GROUP (ORDER BY pos)").alias("text"))

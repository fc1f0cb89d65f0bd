"""Nested block trees -> text.

Blocks are rows ``(page_id, block_id, parent, pos, type, text[, cells])``; a page's own blocks have no parent. A toggle is
its title and then its children, a table its rows, a table row its cells with a comma after each; children of any other
block aren't read. Every block's place among all blocks of the page is the path of positions from the root, which is found
by path doubling: in each round a block takes over its ancestor's path and its ancestor's ancestor, so that a tree of
depth d needs about log2(d) joins, whatever the number of blocks. The page's text is then one ordered roll-up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedsift.session import cut_lineage
from feedsift.sources.blocks import render_block, table_row_text

#: The block types whose children are part of their text.
WITH_CHILDREN = ["toggle", "table"]


def block_paths(blocks: DataFrame, key: str = "page_id") -> DataFrame:
    """``blocks`` that are part of their page's text, with ``path``: the (position, id) steps from the root.

    Blocks whose parent is missing or reads no children are left out, and so is everything below them. A circle of
    parents is an error.
    """
    inner = blocks.where(F.col("type").isin(*WITH_CHILDREN)).select(F.col(key).alias("_page"), F.col("block_id").alias("_id"))
    step = F.array(F.struct(F.col("pos").cast("long").alias("pos"), F.col("block_id").cast("string").alias("id")))
    at = blocks.select(F.col(key).alias("_page"), "block_id", F.col("parent").alias("up"), step.alias("path"))
    below = at.where(F.col("up").isNotNull()).join(inner, (at["_page"] == inner["_page"]) & (F.col("up") == F.col("_id")), "left_semi")
    at = cut_lineage(at.where(F.col("up").isNull()).unionByName(below))
    limit = at.count().bit_length() + 1                       # doublings that any tree of so many blocks needs at most
    for _ in range(limit):
        if at.where(F.col("up").isNotNull()).isEmpty():
            return blocks.join(at.select(F.col("_page").alias(key), "block_id", "path"), [key, "block_id"])
        above = at.select(F.col("_page").alias("_p"), F.col("block_id").alias("_b"), F.col("up").alias("_up"), F.col("path").alias("_path"))
        low = at.where(F.col("up").isNotNull())
        moved = low.join(above, (low["_page"] == F.col("_p")) & (F.col("up") == F.col("_b"))).select(
            "_page", "block_id", F.col("_up").alias("up"), F.concat("_path", "path").alias("path"))
        at = cut_lineage(at.where(F.col("up").isNull()).unionByName(moved))
    raise ValueError("blocks are their own ancestors")


def tree_to_text(blocks: DataFrame, key: str = "page_id", separator: str = "") -> DataFrame:
    """Per page the text of its tree; ``separator`` follows every block of the page itself, after its children.

    Every page with blocks has a row. ``cells`` (an array) holds a table row's cells; null texts and cells are empty.
    """
    own = render_block(F.col("type"), F.when(F.col("type") == "table_row", table_row_text(F.transform(F.coalesce("cells", F.array().cast("array<string>")), lambda c: F.coalesce(c, F.lit(""))))
                                             if "cells" in blocks.columns else F.col("text")).otherwise(F.col("text")))
    parts = block_paths(blocks, key).select(key, "path", own.alias("part"))
    if separator:
        last = F.struct(F.lit((1 << 63) - 1).alias("pos"), F.lit("").alias("id"))
        roots = parts.where(F.size("path") == 1)
        parts = parts.unionByName(roots.select(key, F.concat("path", F.array(last)).alias("path"), F.lit(separator).alias("part")))
    text = parts.groupBy(key).agg(F.expr("listagg(part, '') WITHIN GROUP (ORDER BY path)").alias("text"))
    return blocks.select(key).distinct().join(text, key, "left").select(key, F.coalesce("text", F.lit("")).alias("text"))

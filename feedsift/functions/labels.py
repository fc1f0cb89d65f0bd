"""Label arrays: stable top-k, first-k, rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedsift.functions.text import label_normalise


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def topk_labels(labels, k: int = 3) -> Column:
    """``array<struct(name, score)>`` sorted by score desc, **stable** (ties keep input order), first k."""
    with_pos = F.transform(_c(labels), lambda x, i: F.struct(x["name"].alias("name"), x["score"].alias("score"),
                                                             i.alias("pos")))

    def cmp(a, b):
        return (F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1)
                .when(a["pos"] < b["pos"], -1).when(a["pos"] > b["pos"], 1).otherwise(0))

    ranked = F.slice(F.array_sort(with_pos, cmp), 1, k)
    return F.transform(ranked, lambda x: F.struct(x["name"].alias("name"), x["score"].alias("score")))


def firstk(arr, k: int = 3) -> Column:
    """First k elements, no sorting."""
    return F.slice(_c(arr), 1, k)


def normalised_names(labels) -> Column:
    """P11 over a label array: names with commas as spaces, 20 characters."""
    return F.transform(_c(labels), lambda x: label_normalise(x["name"]))


def render_labels(labels) -> Column:
    """Flatten ``array<struct(name, score)>`` to ``name:score|...`` (scores to 6 decimals)."""
    return F.array_join(F.transform(_c(labels), lambda x: F.concat(
        x["name"], F.lit(":"), F.format_string("%.6f", x["score"]))), "|")

"""Row ids that tell every row apart, and joins on keys of which a few hold many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainweave.session import stage_table

#: Keys that hold this share of all rows or more are hot: there are at most 1 / HOT_SHARE of them at any size.
HOT_SHARE = 1e-3


def identified(docs: DataFrame, name: str = "uid") -> DataFrame:
    """docs with a long column ``name`` that differs in every row and rises with doc_id, null last.

    Where doc_id is unique and never null it is the doc_id itself. Else rows are numbered along
    doc_id and written, so that later reads see the same numbers; rows of one doc_id keep the order of
    reading.
    """
    ids = F.col("doc_id").cast("long")
    odd = docs.groupBy(ids.alias("i")).agg(F.count("*").alias("n")).where("n > 1 or i is null")
    if odd.isEmpty():
        return docs.withColumn(name, ids)
    # the row's place is a sort key too, so that a third of all rows under one doc_id is cut into many ranges
    laid = docs.withColumn(name, F.monotonically_increasing_id())
    laid = laid.orderBy(ids.asc_nulls_last(), F.xxhash64(name), name).withColumn(name, F.monotonically_increasing_id())
    return stage_table(laid, "rows")


def fresh_name(docs: DataFrame, name: str) -> str:
    """``name``, with underscores added until docs has no such column, whatever the case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keyed_join(rows: DataFrame, table: DataFrame, keys: list[str], count: str, total: int, share: float = HOT_SHARE) -> DataFrame:
    """Inner join of rows with table (one row a key) where ``count`` tells how many of the ``total`` rows a key has.

    Keys of a share of ``share`` or more (1 / share of them at most) are broadcast and stay where their rows
    are; only the others are shuffled.
    """
    bound = max(2, int(total * share))
    hot = F.broadcast(table.where(F.col(count) >= bound))
    there = rows.join(hot, keys)
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(table.where(F.col(count) < bound), keys)
    return there.unionByName(rest)

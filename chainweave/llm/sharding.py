"""Sharding by byte size: prefix sums over range partitions, cut at equal targets.

Only DataFrame functions. Rows are dealt to range partitions of the order, whose numbers are made
durable in a written table. Totals by partition (one row each) give every partition its starting
byte and row; running sums inside a partition give the rest. A cut never needs one task to see
more than a range partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainweave.llm.rows import fresh_name
from chainweave.session import read_table, stage_table

#: Bytes that a shard spends on a row besides its text.
ROW_BYTES = 8


def text_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(ROW_BYTES)


def shard_by_bytes(rows: DataFrame, order: list[Column], size: Column, n_shards: int) -> DataFrame:
    """``rows`` with ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0 in each shard).

    Shards are contiguous in ``order``. A row goes to the shard that holds the middle of its bytes,
    so that no shard is further from an equal share than half a row at either cut. Equal keys of
    the order may stand either way round; equal rows are interchangeable. No rows give no rows.
    Columns of ``rows`` called shard or slot are kept under ``row`` alone: the result has the
    columns row (a struct of all of them), size, shard and slot.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), size.alias("size"), *[c.alias(f"o{i}") for i, c in enumerate(order)])
    keys = [f"o{i}" for i in range(len(order))]
    dealt = stage_table(keyed.repartitionByRange(n, *keys, "size").withColumn("part", F.spark_partition_id()), "ranges")
    parts = dealt.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    parts = parts.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(Window.partitionBy()).alias("total"),
    )
    inside = Window.partitionBy("part").orderBy(*keys, "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.join(F.broadcast(parts), "part").select(
        "row",
        "size",
        "total",
        (F.col("bytes_before") + F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("start"),
        (F.col("rows_before") + F.count("size").over(inside)).alias("place"),
    )
    middle = F.expr(f"cast(least({n_shards - 1}, ((2 * start + size) * {n_shards}) div (2 * total)) as int)")
    placed = placed.withColumn("shard", middle)
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))  # n_shards rows
    return placed.join(F.broadcast(first), "shard").select("row", "size", "shard", (F.col("place") - F.col("first")).alias("slot"))


def file_order(docs: DataFrame) -> list[Column]:
    """The order in which the rows of a written table stand, or doc_id where docs isn't read from files."""
    try:
        docs.select("_metadata.row_index").schema
    except Exception:
        return [F.col("doc_id")]
    return [F.col("_metadata.file_name"), F.col("_metadata.row_index")]


def shard_documents(docs: DataFrame, n_shards: int = 24) -> DataFrame:
    """Documents with their size, shard and slot, contiguous in the order of the files that hold them.

    A column of docs that is called size, shard or slot gives way to the new one.
    """
    order = file_order(docs)
    kept = [c for c in docs.columns if c not in ("size", "shard", "slot")]
    names = [fresh_name(docs, f"_order{i}") for i in range(len(order))]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], *[c.alias(n) for n, c in zip(names, order, strict=True)])
    out = shard_by_bytes(rows, [F.col(n) for n in names], text_size(F.col("text")), n_shards)
    return out.select(*[F.col("row").getField(c).alias(c) for c in kept], "size", "shard", "slot")


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 24 shards, contiguous by doc_id and near equal in bytes."""
    docs = read_table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.crc32(F.coalesce("text", F.lit(""))).alias("crc"), text_size(F.col("text")).alias("bytes"))
    out = shard_by_bytes(rows, [F.col("doc_id"), F.col("crc")], F.col("bytes"), 24)
    return out.select(
        F.col("row.doc_id").alias("doc_id"),
        "size",
        F.col("row.crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )

"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks. Block i of a source of weight w has its release at floor((i - 1) / w)
and its deadline at ceil(i / w); one block runs in each slot, the released block of the earliest
deadline. With weights that sum to 1 every deadline is met, so that after any number of slots a
source is less than one block away from its weight. When a source has no block left, the weights of
the rest are scaled to 1 and their windows begin anew.

A plan has at most ``max_blocks`` blocks (and one short block for each source) at any size of
input: the block grows with the input. So the schedule is a small table of bounded size, worked out
once and broadcast, while the rows only get ranks and a join, all by DataFrame functions.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainweave.session import read_table

MAX_BLOCKS, MAX_SOURCES, BUCKET_ROWS = 1 << 14, 10_000, 1024
PLAN = "m_source string, m_block long, m_slot long, m_release long, m_deadline long, m_before long"


def pfair(blocks: dict[str, int], weights: dict[str, Fraction]) -> list[tuple[str, int, int, int, int]]:
    """(source, block from 0, slot, release, deadline) for every block, in order of the slots."""
    left, done = {s: n for s, n in blocks.items() if n > 0}, dict.fromkeys(blocks, 0)
    out: list[tuple[str, int, int, int, int]] = []
    while left:
        began, total = len(out), sum((weights[s] for s in left), Fraction(0))
        share = {s: weights[s] / total for s in left}
        waiting = [(began, s, 1) for s in sorted(left)]
        ready: list[tuple[int, str, int, int]] = []
        heapq.heapify(waiting)
        while True:
            slot = len(out)
            while waiting and waiting[0][0] <= slot:
                release, s, i = heapq.heappop(waiting)
                heapq.heappush(ready, (began - (-i * share[s].denominator // share[s].numerator), s, i, release))
            deadline, s, i, release = heapq.heappop(ready)
            out.append((s, done[s], slot, release, deadline))
            done[s] += 1
            left[s] -= 1
            if not left[s]:
                del left[s]
                break
            heapq.heappush(waiting, (began + i * share[s].denominator // share[s].numerator, s, i + 1))
    return out


def sources(docs: DataFrame, source: Column) -> dict[str, int]:
    """Rows of each source; null is a source of its own."""
    rows = docs.groupBy(source.alias("s")).count().take(MAX_SOURCES + 1)
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources; weights are given by source, so name fewer")
    return {r["s"]: r["count"] for r in rows}


def mix(docs: DataFrame, weights: dict[str, float] | None = None, seed: int = 0, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """Columns row (a struct of docs' own columns), source_key, block, slot, release, deadline, position.

    ``weights`` by source as text; a source that it doesn't name, and every source where it is None,
    gets the square root of its rows, which lifts small sources and holds large ones back.
    No row is dropped or repeated: the weights say in which order rows come. ``position`` is 0 to
    rows - 1. Inside a source rows are in the order of a hash of doc_id with ``seed``. Null sources
    form one source, empty docs give an empty plan, and repeated rows keep a place each.
    """
    key = F.concat(F.when(F.col("source").isNull(), "-").otherwise("+"), F.coalesce(F.col("source").cast("string"), F.lit("")))
    total = sources(docs, key)
    size = max(1, -(-sum(total.values()) // max_blocks))
    asked = {s: Fraction((weights or {}).get(s[1:], n**0.5)) for s, n in total.items()}
    share = {s: w.limit_denominator(10**6) or w for s, w in asked.items()}
    if any(w <= 0 for w in share.values()):
        raise ValueError("weights must be above 0")
    order, at = [], 0
    for s, block, slot, release, deadline in pfair({s: -(-n // size) for s, n in total.items()}, share):
        order.append((s, block, slot, release, deadline, at))
        at += min(size, total[s] - block * size)
    spark = docs.sparkSession
    plan = spark.createDataFrame(order, PLAN)
    buckets = spark.createDataFrame([(s, -(-n // BUCKET_ROWS)) for s, n in total.items()], "m_source string, m_buckets long")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    h = F.xxhash64(F.col("doc_id"), F.lit(seed)).alias("m_hash")
    rows = docs.select(row, key.alias("m_source"), h).join(F.broadcast(buckets), "m_source")
    rows = rows.withColumn("m_bucket", F.expr("pmod(xxhash64(m_hash), m_buckets)")).drop("m_buckets")
    counts = rows.groupBy("m_source", "m_bucket").agg(F.count("*").alias("n"))
    w = Window.partitionBy("m_source").orderBy("m_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("m_source", "m_bucket", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("m_start"))
    w = Window.partitionBy("m_source", "m_bucket").orderBy("m_hash", "row.doc_id")
    rows = rows.withColumn("m_rank", F.row_number().over(w) - 1).join(counts, ["m_source", "m_bucket"])
    rows = rows.withColumn("m_rank", F.col("m_rank") + F.col("m_start")).withColumn("m_block", F.expr(f"m_rank div {size}"))
    return rows.join(F.broadcast(plan), ["m_source", "m_block"]).select(
        "row",
        F.expr("if(m_source like '+%', substring(m_source, 2), null)").alias("source_key"),
        F.col("m_block").alias("block"),
        F.col("m_slot").alias("slot"),
        F.col("m_release").alias("release"),
        F.col("m_deadline").alias("deadline"),
        (F.col("m_before") + F.col("m_rank") - F.col("m_block") * size).alias("position"),
    )


def mix_documents(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """All documents, laid out in mixed order: range partitions of the position, sorted inside."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mixed = mix(docs, weights).select("row", "position").repartitionByRange(n, "position").sortWithinPartitions("position")
    return mixed.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op9_mix_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every document stands in the mix of all sources."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix(docs).select(F.col("row.doc_id").alias("doc_id"), F.col("source_key").alias("source"), "block", "slot", "release", "deadline", "position")

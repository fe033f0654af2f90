"""Pairs of transcripts whose spans overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainweave.operators.classify import prepared
from chainweave.operators.intervals import range_join


def span_pairs(queries: DataFrame, refs: DataFrame, any_strand: bool = False) -> DataFrame:
    """(seq, q, r) of transcripts whose spans overlap, on one strand or on any."""
    q = prepared(queries).withColumnRenamed("t", "q")
    r = prepared(refs).select("seq", "strand", F.col("s").alias("s2"), F.col("e").alias("e2"), F.col("t").alias("r"))
    keys = ["seq"] if any_strand else ["seq", "strand"]
    return range_join(q.drop("strand") if any_strand else q, r.drop("strand") if any_strand else r, keys).select("seq", "q", "r")

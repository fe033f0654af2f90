"""Sequence files as rows of pieces, and transcripts' spliced sequences from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainweave.operators.intervals import range_join


def read_fasta(spark: SparkSession, path) -> DataFrame:
    """(seq, start, bases): each line of bases with its place in its sequence, from 1.

    Lines keep their order by file and offset. Sequences end at the next header, and what stands before the first header
    is left out. Lengths are summed in order of lines, file by file.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"), F.trim("value").alias("value"))
    w = Window.partitionBy("file").orderBy("at")
    rows = lines.withColumn("head", F.last(F.when(F.col("value").startswith(">"), F.split(F.substring("value", 2, 1 << 20), r"\s+")[0]), ignorenulls=True).over(w))
    rows = rows.where(~F.col("value").startswith(">") & F.col("head").isNotNull() & (F.col("value") != ""))
    before = Window.partitionBy("file", "head").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(F.col("head").alias("seq"), (F.coalesce(F.sum(F.length("value").cast("long")).over(before), F.lit(0)) + 1).alias("start"), F.col("value").alias("bases"))


def reverse_complement(bases: Column) -> Column:
    return F.reverse(F.translate(bases, "ACGTUNRYKMBVDHacgtunrykmbvdh", "TGCAANYRMKVBHDtgcaanyrmkvbhd"))


def spliced(transcripts: DataFrame, sequence: DataFrame) -> DataFrame:
    """(tid, bases): exons joined in order, in the direction of the strand. sequence: (seq, start, bases), pieces that don't overlap."""
    ex = transcripts.select("tid", "strand", "seq", F.explode("exons").alias("x")).select("tid", "strand", "seq", "x.s", "x.e")
    pieces = sequence.select("seq", F.col("start").alias("s2"), (F.col("start") + F.length("bases") - 1).alias("e2"), "bases")
    cut = F.expr("substring(bases, cast(greatest(s, s2) - s2 + 1 as int), cast(least(e, e2) - greatest(s, s2) + 1 as int))")
    got = range_join(ex, pieces, ["seq"]).select("tid", "strand", F.struct(F.greatest("s", "s2").alias("at"), cut.alias("b")).alias("p"))
    whole = got.groupBy("tid", "strand").agg(F.array_join(F.array_sort(F.collect_list("p"))["b"], "").alias("bases"))  # bounded by a transcript
    return whole.select("tid", F.when(F.col("strand") == "-", reverse_complement(F.col("bases"))).otherwise(F.col("bases")).alias("bases"))

"""Streaming assembly: lines of annotation files as they come, transcripts as far as their lines are known."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainweave.sources.annotation import assemble, features_of


def gathered(features: DataFrame) -> DataFrame:
    """(dset, seq, record, lines) of a stream of features: all lines of a record so far, kept in the state of a streaming aggregate.

    A record is a transcript's id, by which its parts name it, or a gene's. Its state is as large as its own lines.
    """
    record = F.when(F.col("kind").isin("transcript", "gene"), F.col("id")).otherwise(F.col("parent"))
    rows = features.where("kind in ('transcript', 'exon', 'cds', 'utr', 'codon')").withColumn("record", record).where("record is not null")
    return rows.groupBy("dset", "seq", "record").agg(F.collect_list(F.struct(*[c for c in features.columns if c not in ("dset", "seq")])).alias("lines"))


def assemble_stream(lines: DataFrame, sample: str, out: str, checkpoint: str, **how):
    """Starts a query that reads lines (value) and writes, for each micro-batch, the transcripts that its lines touch, whole so far.

    Lines of one transcript may come in any number of batches and in any order; state survives a restart from the checkpoint, and
    a batch that runs again writes its own folder again. ``latest`` gives each transcript as last written.
    """

    def write(batch: DataFrame, number: int) -> None:
        features = batch.select("dset", "seq", F.inline("lines"))
        assemble(features, **how).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = gathered(features_of(lines, sample)).writeStream.outputMode("update")
    return stream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, out: str) -> DataFrame:
    """The transcripts of ``assemble_stream``, each as the last batch wrote it."""
    rows = spark.read.parquet(out)
    newest = rows.withColumn("_n", F.max("batch").over(Window.partitionBy("dset", "seq", "tid")))  # a transcript's versions
    return newest.where("batch = _n").drop("batch", "_n")

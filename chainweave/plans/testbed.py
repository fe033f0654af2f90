"""Exon and transcript tables derived from orders and lineitems: an order is a transcript, its lines are exons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainweave.session import read_table

EXONS_SQL = """
with r as (
  select l_orderkey as tid, l_partkey as p, l_suppkey as sk,
         row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 as i
  from {lineitem})
select tid, case when tid % 2 = 1 then 'qry' else 'ref' end as dset,
       concat('chr', cast(o_custkey % 4 + 1 as varchar(9))) as seq,
       case o_orderstatus when 'F' then '+' when 'O' then '-' else '.' end as strand,
       cast(((tid * 7919) % 97) * 5000 + (i + tid % 3) * 300 + 1000 + case when p % 4 = 0 then 20 else 0 end as bigint) as s,
       cast(((tid * 7919) % 97) * 5000 + (i + tid % 3) * 300 + 1150 + case when sk % 4 = 0 then 15 else 0 end as bigint) as e
from r join {orders} on o_orderkey = tid
"""


def exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tid, dset, seq, strand, s, e), one row for each exon."""
    return spark.sql(EXONS_SQL, lineitem=read_table(spark, sf_dir, "lineitem"), orders=read_table(spark, sf_dir, "orders"))


def transcripts(ex: DataFrame) -> DataFrame:
    """One row for each transcript with its sorted exon chain (merged where exons touch is left to normalize)."""
    t = ex.groupBy("tid", "dset", "seq", "strand").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("exons"))
    return t.select("tid", "dset", "seq", "strand", "exons", F.col("exons")[0]["s"].alias("s"), F.expr("exons[size(exons) - 1].e").alias("e"))

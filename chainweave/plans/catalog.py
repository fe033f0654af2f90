"""Queries of the transcript engine over the derived tables, with SQL for each where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainweave.functions import intervals as fx
from chainweave.operators import compare
from chainweave.operators.intervals import islands, met_by, range_join
from chainweave.plans import relations, samples
from chainweave.plans.testbed import EXONS_SQL, exons, transcripts
from chainweave.session import stage_table

KEY = ["seq", "strand"]
EX = "with recursive ex as (" + EXONS_SQL.format(lineitem="lineitem", orders="orders") + """),
intr as (select tid, dset, seq, strand, e + 1 as s, lead(s) over (partition by tid order by s, e) - 1 as e from ex),
introns as (select tid, dset, seq, strand, s, e from intr where e is not null),
tx as (select tid, dset, seq, strand, min(s) as s, max(e) as e, count(*) as n, sum(e - s + 1) as len from ex group by all),
chain as (select tid, dset, seq, strand, string_agg(s || '-' || e, ',' order by s, e) as chain from introns group by all),
d as (select distinct dset, seq, strand, s, e from ex),
b as (select *, max(e) over (partition by dset, seq, strand order by s, e rows between unbounded preceding and 1 preceding) as u from d),
g as (select *, sum(case when s > u then 1 else 0 end) over (partition by dset, seq, strand order by s, e rows unbounded preceding) as k from b),
isl as (select dset, seq, strand, min(s) as s, max(e) as e from g group by dset, seq, strand, k)
"""


def intron_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transcripts(exons(spark, sf_dir))
    return t.select("tid", "dset", *KEY, F.explode(fx.introns(F.col("exons"))).alias("i")).select("tid", "dset", *KEY, F.col("i.s").alias("s"), F.col("i.e").alias("e"))


def tx_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transcripts(exons(spark, sf_dir))
    return t.select("tid", "dset", *KEY, "s", "e", F.size("exons").cast("long").alias("n"), fx.covered(F.col("exons")).alias("len"))


def chain_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transcripts(exons(spark, sf_dir)).where("size(exons) > 1")
    return t.select("tid", "dset", *KEY, fx.rendered(fx.introns(F.col("exons"))).alias("chain"))


def interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands(exons(spark, sf_dir), ["dset", *KEY])


def base_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True positive, query and reference bases, by sequence and in all."""
    return compare.base_counts(exons(spark, sf_dir)).rollup("seq").agg(*[F.sum(c).cast("long").alias(c) for c in ("tp", "q", "r")])


def intron_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct introns of queries and references and those equal in both."""
    i = intron_rows(spark, sf_dir).groupBy(*KEY, "s", "e").agg(F.max(F.expr("int(dset = 'qry')")).alias("q"), F.max(F.expr("int(dset = 'ref')")).alias("r"))
    return i.groupBy(*KEY).agg(F.sum(F.col("q") * F.col("r")).alias("tp"), F.sum("q").alias("q"), F.sum("r").alias("r"))


def intron_missed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.without_partner(intron_rows(spark, sf_dir), "ref", "qry")


def intron_novel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.without_partner(intron_rows(spark, sf_dir), "qry", "ref")


def exon_missed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.without_partner(exons(spark, sf_dir), "ref", "qry")


def exon_novel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.without_partner(exons(spark, sf_dir), "qry", "ref")


def unique_exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct exons of a set; the first transcript by place and id tells whether one is terminal on a side."""
    return compare.unique_exons(exons(spark, sf_dir))


def exon_level(spark: SparkSession, sf_dir: str, reach: int = 100) -> DataFrame:
    """Distinct exons of queries and references and those that match: equal ends, or near ones where both are terminal."""
    u = unique_exons(spark, sf_dir)
    found = compare.exon_matches(u, reach).groupBy(*KEY).agg(F.countDistinct("s", "e").alias("q_matched"), F.countDistinct("s2", "e2").alias("r_matched"))
    sizes = u.groupBy(*KEY).agg(F.sum(F.expr("int(dset = 'qry')")).alias("q"), F.sum(F.expr("int(dset = 'ref')")).alias("r"))
    return sizes.join(found, KEY, "left").select(*KEY, "q", "r", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("q_matched", "r_matched")])


def chain_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-exon queries and references, and those whose intron chain the other side has."""
    c = chain_key(spark, sf_dir).groupBy(*KEY, "chain").agg(F.sum(F.expr("int(dset = 'qry')")).alias("q"), F.sum(F.expr("int(dset = 'ref')")).alias("r"))
    return c.groupBy(*KEY).agg(F.sum("q").alias("q"), F.sum("r").alias("r"), F.sum(F.expr("if(r > 0, q, 0)")).alias("q_matched"), F.sum(F.expr("if(q > 0, r, 0)")).alias("r_matched"))


def chains_with_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-exon transcripts with their intron chain and bases, from one grouping of the exons."""
    t = transcripts(exons(spark, sf_dir)).where("size(exons) > 1")
    return t.select("tid", "dset", *KEY, fx.rendered(fx.introns(F.col("exons"))).alias("chain"), fx.covered(F.col("exons")).alias("len"))


def equivalence_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts of one intron chain over three samples: members, samples and the longest, first by id."""
    t = chains_with_length(spark, sf_dir)
    return t.groupBy(*KEY, "chain").agg(F.count("*").alias("n"), F.countDistinct(F.expr("tid % 3")).alias("samples"), F.max_by("tid", F.struct("len", -F.col("tid"))).alias("rep"))


def dedupe_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of multi-exon references with one chain: the longest, then the first."""
    t = chains_with_length(spark, sf_dir).where("dset = 'ref'")
    first = t.groupBy(*KEY, "chain").agg(F.min_by(F.struct("tid", "len"), F.struct(-F.col("len"), F.col("tid"))).alias("t"))
    return first.select("t.tid", *KEY, "chain", "t.len")


def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of queries and references that overlap on one strand: pairs and bases by sequence."""
    t = stage_table(tx_summary(spark, sf_dir).select("dset", *KEY, "s", "e"), "spans", tidy=True)
    met = met_by(t.where("dset = 'qry'"), t.where("dset = 'ref'"), KEY)
    return met.groupBy(*KEY).agg(F.sum(F.expr("m * n")).alias("pairs"), F.sum(F.expr("m * bases")).alias("bases"))


def refs_overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tx_summary(spark, sf_dir)
    r, q = t.where("dset = 'ref'").select("tid", *KEY, "s", "e"), islands(t.where("dset = 'qry'"), KEY).select(*KEY, F.col("s").alias("s2"), F.col("e").alias("e2"))
    return range_join(r, q, KEY).select("tid").distinct()


def sequential_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers from 1 in order of sequence, strand and place: counts by key, then ranks inside."""
    u = islands(exons(spark, sf_dir), KEY)
    counts = u.groupBy(*KEY).count()
    before = Window.orderBy("seq", "strand").rowsBetween(Window.unboundedPreceding, -1)  # one row for each key
    counts = counts.select(*KEY, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("n"))
    rank = F.row_number().over(Window.partitionBy(*KEY).orderBy("s"))
    return u.withColumn("k", rank).join(counts, KEY).select(*KEY, "s", "e", (F.col("n") + F.col("k")).alias("id"))


QUERIES = {f.__name__: f for f in (tx_summary, chain_key, interval_union, base_level, intron_level, intron_missed, intron_novel, unique_exons, exon_level, exon_missed, exon_novel, chain_level, equivalence_classes, dedupe_refs, overlap_pairs, refs_overlapping, sequential_ids)}
QUERIES["introns_from_exons"] = intron_rows
QUERIES |= relations.QUERIES | samples.QUERIES

_ALONE = "select distinct a.seq, a.strand, a.s, a.e from {2} a where a.dset = '{0}' and not exists (select 1 from {2} b where b.dset = '{1}' and b.seq = a.seq and b.strand = a.strand and b.s <= a.e and b.e >= a.s)"
_UNIQUE = """, ranked as (select ex.*, ex.s = tx.s as is_left, ex.e = tx.e as is_right,
      row_number() over (partition by ex.dset, ex.seq, ex.strand, ex.s, ex.e order by tx.s, tx.e, tx.tid) as k from ex join tx on tx.tid = ex.tid),
ue as (select dset, seq, strand, s, e, is_left, is_right from ranked where k = 1)
"""

SQL = {
    "introns_from_exons": EX + "select * from introns",
    "tx_summary": EX + "select tid, dset, seq, strand, s, e, n, cast(len as bigint) as len from tx",
    "chain_key": EX + "select * from chain",
    "interval_union": EX + "select * from isl",
    "base_level": EX + """, u as (
      select a.seq, least(a.e, b.e) - greatest(a.s, b.s) + 1 as tp, 0 as q, 0 as r from isl a join isl b on a.seq = b.seq and a.strand = b.strand and a.dset = 'qry' and b.dset = 'ref' and a.s <= b.e and a.e >= b.s
      union all select seq, 0, case when dset = 'qry' then e - s + 1 else 0 end, case when dset = 'ref' then e - s + 1 else 0 end from isl)
    select seq, cast(sum(tp) as bigint) as tp, cast(sum(q) as bigint) as q, cast(sum(r) as bigint) as r from u group by rollup (seq)""",
    "intron_level": EX + """, i as (select seq, strand, s, e, max(cast(dset = 'qry' as int)) as q, max(cast(dset = 'ref' as int)) as r from introns group by seq, strand, s, e)
    select seq, strand, cast(sum(q * r) as bigint) as tp, cast(sum(q) as bigint) as q, cast(sum(r) as bigint) as r from i group by seq, strand""",
    "intron_missed": EX + _ALONE.format("ref", "qry", "introns"),
    "intron_novel": EX + _ALONE.format("qry", "ref", "introns"),
    "exon_missed": EX + _ALONE.format("ref", "qry", "ex"),
    "exon_novel": EX + _ALONE.format("qry", "ref", "ex"),
    "unique_exons": EX + _UNIQUE + "select dset, seq, strand, s, e, is_left, is_right from ue",
    "exon_level": EX + _UNIQUE + """, m as (select a.seq, a.strand, a.s, a.e, b.s as s2, b.e as e2 from ue a join ue b on a.seq = b.seq and a.strand = b.strand and a.dset = 'qry' and b.dset = 'ref' and a.s <= b.e and a.e >= b.s
      and (a.s = b.s or a.is_left and b.is_left and abs(a.s - b.s) <= 100) and (a.e = b.e or a.is_right and b.is_right and abs(a.e - b.e) <= 100)),
    f as (select seq, strand, count(distinct (s, e)) as q_matched, count(distinct (s2, e2)) as r_matched from m group by all)
    select n.*, coalesce(q_matched, 0) as q_matched, coalesce(r_matched, 0) as r_matched
    from (select seq, strand, count(*) filter (dset = 'qry') as q, count(*) filter (dset = 'ref') as r from ue group by all) n left join f on f.seq = n.seq and f.strand = n.strand""",
    "chain_level": EX + """, c as (select seq, strand, chain, count(*) filter (dset = 'qry') as q, count(*) filter (dset = 'ref') as r from chain group by all)
    select seq, strand, cast(sum(q) as bigint) as q, cast(sum(r) as bigint) as r, cast(sum(case when r > 0 then q else 0 end) as bigint) as q_matched, cast(sum(case when q > 0 then r else 0 end) as bigint) as r_matched from c group by seq, strand""",
    "equivalence_classes": EX + """, m as (select c.*, len, row_number() over (partition by c.seq, c.strand, chain order by len desc, c.tid) as k from chain c join tx on tx.tid = c.tid)
    select seq, strand, chain, count(*) as n, count(distinct tid % 3) as samples, max(case when k = 1 then tid end) as rep from m group by seq, strand, chain""",
    "dedupe_refs": EX + """, m as (select c.*, len, row_number() over (partition by c.seq, c.strand, chain order by len desc, c.tid) as k from chain c join tx on tx.tid = c.tid where c.dset = 'ref')
    select tid, seq, strand, chain, cast(len as bigint) as len from m where k = 1""",
    "overlap_pairs": EX + """select a.seq, a.strand, count(*) as pairs, cast(sum(least(a.e, b.e) - greatest(a.s, b.s) + 1) as bigint) as bases
    from tx a join tx b on a.seq = b.seq and a.strand = b.strand and a.dset = 'qry' and b.dset = 'ref' and a.s <= b.e and a.e >= b.s group by a.seq, a.strand""",
    "refs_overlapping": EX + "select distinct a.tid from tx a join tx b on a.seq = b.seq and a.strand = b.strand and a.dset = 'ref' and b.dset = 'qry' and a.s <= b.e and a.e >= b.s",
    "sequential_ids": EX + """, d2 as (select distinct seq, strand, s, e from ex),
    b2 as (select *, max(e) over (partition by seq, strand order by s, e rows between unbounded preceding and 1 preceding) as u from d2),
    g2 as (select *, sum(case when s > u then 1 else 0 end) over (partition by seq, strand order by s, e rows unbounded preceding) as k from b2),
    i2 as (select seq, strand, min(s) as s, max(e) as e from g2 group by seq, strand, k)
    select seq, strand, s, e, row_number() over (order by seq, strand, s) as id from i2""",
}
SQL |= relations.SQL | samples.SQL

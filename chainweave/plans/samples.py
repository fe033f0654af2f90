"""Queries over three samples of the derived queries (tid modulo 3), and SQL that folds row by row where the operators fold by islands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainweave.functions import intervals as fx
from chainweave.operators import context, samples
from chainweave.operators import loci as lc
from chainweave.plans.relations import _CODES, _EX
from chainweave.plans.testbed import exons, transcripts
from chainweave.session import stage_table

N_SAMPLES, REACH = 3, 100


def _sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = transcripts(exons(spark, sf_dir)).withColumn("exons", fx.merge_close(F.col("exons"))).withColumn("sample", F.expr(f"tid % {N_SAMPLES}"))
    t = stage_table(t, "transcripts")
    return t.where("dset = 'qry'"), t.where("dset = 'ref'")


def _kept(q: DataFrame) -> DataFrame:
    """Queries without the duplicates of their sample."""
    stay = samples.deduplicated(q).where("tid = into").select("tid")
    return stage_table(q.join(stay, "tid"), "kept")


def sample_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query and the one of its sample that stands for it: equal chains or matching single exons, and the same where it must lie within."""
    q, _ = _sets(spark, sf_dir)
    inside = samples.deduplicated(q, contain=True).select("tid", F.col("into").alias("held_by"))
    return samples.deduplicated(q).withColumnRenamed("into", "stays_as").join(inside, "tid")


def tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries that are one over three samples: the longest, its best reference and code, and each sample's transcripts."""
    q, r = _sets(spark, sf_dir)
    q = _kept(q)
    out = samples.tracked(q, stage_table(samples.equivalents(q), "heads"), context.class_codes(q, r), list(range(N_SAMPLES)))
    return out.select("head", "tid", F.col("n").cast("long").alias("n"), "len", "n_samples", "ref", "code", *[f"q{i + 1}" for i in range(N_SAMPLES)])


def redundant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries of all samples that another one holds, and whether they still are under each of the options."""
    q, _ = _sets(spark, sf_dir)
    q = _kept(q)
    out = q.select("tid").join(samples.contained(q), "tid", "left")
    for name, how in {"poking": {"poke": samples.POKE}, "same_start": {"tss": REACH}, "in_exon": {"in_exon": True}}.items():
        out = out.join(samples.contained(q, **how).select("tid", F.lit(1).alias(name)), "tid", "left")
    return out.select("tid", F.coalesce("why", F.lit("-")).alias("why"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("poking", "same_start", "in_exon")])


def tss_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries of all samples by extended locus and cluster of start sites."""
    q, _ = _sets(spark, sf_dir)
    q = _kept(q)
    ex = q.select("tid", *lc.KEY, F.explode("exons").alias("x")).select("tid", *lc.KEY, "x.s", "x.e")
    members = lc.loci(stage_table(ex, "exons"), tuple(lc.KEY)).select("tid", "locus")
    return samples.start_clusters(q.select("tid", *lc.KEY, "s", "e").join(members, "tid"), REACH)


def sample_strands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strands that unstranded queries take from what they hang together with over all samples."""
    q, _ = _sets(spark, sf_dir)
    return samples.adopted_strands(q)


def class_codes_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best references and codes where the head of equal transcripts over the samples tells for all of them."""
    q, r = _sets(spark, sf_dir)
    q = _kept(q)
    return samples.class_codes(q, r, stage_table(samples.equivalents(q), "heads"))


QUERIES = {f.__name__: f for f in (sample_duplicates, tracking, redundant, tss_clusters, sample_strands, class_codes_by_class)}

_SAME = """x.s <= {m}.e and x.e >= {m}.s and (x.s = {m}.s and x.e = {m}.e or least(x.e, {m}.e) - greatest(x.s, {m}.s) + 1 >= 0.8 * greatest(x.e - x.s + 1, {m}.e - {m}.s + 1)
      or {m}.e - {m}.s > x.e - x.s and least(x.e, {m}.e) - greatest(x.s, {m}.s) + 1 >= 0.8 * (x.e - x.s + 1) and least(x.e, {m}.e) - greatest(x.s, {m}.s) + 1 >= 0.7 * ({m}.e - {m}.s + 1))"""


def _folded(name: str, more: str) -> str:
    """Single exons by place, one after the other, against a list of those kept."""
    return f""",
{name} as (select distinct sample, seq, strand, 0::bigint as k, []::struct(tid bigint, s bigint, e bigint)[] as kept, null::bigint as lost, null::bigint as winner from so
  union all select sample, seq, strand, k, case when hit is null then list_append(kept, m) when hit.e - hit.s >= m.e - m.s then kept else list_append(list_filter(kept, lambda x: x.tid <> hit.tid), m) end,
    case when hit is null then null when hit.e - hit.s >= m.e - m.s then m.tid else hit.tid end, case when hit is null then null when hit.e - hit.s >= m.e - m.s then hit.tid else m.tid end
  from (select f.sample, f.seq, f.strand, o.k, f.kept, {{'tid': o.tid, 's': o.s, 'e': o.e}} as m, list_filter(f.kept, lambda x: {_SAME.format(m="o")}{more})[-1] as hit
    from {name} f join so o on o.sample = f.sample and o.seq = f.seq and o.strand = f.strand and o.k = f.k + 1)),
{name}_r as (select tid, tid as into_ from so union all select r.tid, f.winner from {name}_r r join {name} f on f.lost = r.into_),
{name}_i as (select tid, into_ from {name}_r where into_ not in (select lost from {name} where lost is not null))"""


_DEDUP = f""",
qs as (select tx.*, tid % {N_SAMPLES} as sample from tx where dset = 'qry'),
so as (select tid, sample, seq, strand, s, e, row_number() over (partition by sample, seq, strand order by s, e, tid) as k from qs where n = 1),
mq as (select qs.*, chain from qs join chain using (tid))""" + _folded("plain", "") + f""",
dup as (select tid, first_value(tid) over (partition by sample, seq, strand, chain order by len desc, tid) as into_ from mq union all select * from plain_i),
kq as materialized (select qs.* from qs join dup using (tid) where tid = into_)
"""
_HOLDER = _folded("held", " and x.s <= o.s and x.e >= o.e") + """,
mf as (select *, coalesce(e > max(e) over (partition by sample, seq, strand, chain order by s, e desc, tid rows between unbounded preceding and 1 preceding), true) as fresh from mq),
hold as (select tid, last_value(case when fresh then tid end ignore nulls) over (partition by sample, seq, strand, chain order by s, e desc, tid rows between unbounded preceding and current row) as into_ from mf union all select * from held_i)
"""
_EQUAL = f""",
cand as (select a.tid, b.tid as other, b.sample as later, b.s, b.e, least(a.e, b.e) - greatest(a.s, b.s) + 1 - abs(a.s - b.s) - abs(a.e - b.e) as score from kq x join kq a on a.tid = x.tid
  join kq b on x.n = 1 and b.n = 1 and x.seq = b.seq and x.strand = b.strand and a.sample < b.sample and x.s <= b.e and x.e >= b.s
  where least(a.e, b.e) - greatest(a.s, b.s) + 1 >= 0.8 * greatest(a.e - a.s + 1, b.e - b.s + 1) or a.e - a.s > b.e - b.s and least(a.e, b.e) - greatest(a.s, b.s) + 1 >= 0.8 * (b.e - b.s + 1) and least(a.e, b.e) - greatest(a.s, b.s) + 1 >= 0.7 * (a.e - a.s + 1)),
pick as (select tid, other from (select *, row_number() over (partition by tid, later order by score desc, s, e, other) as k from cand) where k = 1),
lk as (select tid as a, other as b from pick union select other, tid from pick),
rc as (select tid, tid as o from kq where n = 1 union select rc.tid, lk.b from rc join lk on lk.a = rc.o),
eq as (select tid, min(o) as head from rc group by tid union all select tid, min(tid) over (partition by seq, strand, chain) from kq join chain using (tid))
"""

SQL = {
    "sample_duplicates": _EX + _DEDUP + _HOLDER + "select sample, dup.tid, dup.into_ as stays_as, hold.into_ as held_by from dup join hold using (tid) join qs using (tid)",
    "tracking": _CODES + _DEDUP + _EQUAL + f""",
      mem as (select head, kq.*, row_number() over (partition by head order by len desc, sample, tid) as a, row_number() over (partition by head order by sample, s, e, tid) as b from kq join eq using (tid)),
      rep as (select head, max(case when a = 1 then tid end) as tid, max(case when a = 1 then n end) as n, max(case when a = 1 then len end) as len, count(distinct sample) as n_samples, max(case when b = 1 then tid end) as first_,
        {", ".join(f"coalesce(string_agg(tid || '|' || n || '|' || len, ',' order by tid) filter (sample = {i}), '-') as q{i + 1}" for i in range(N_SAMPLES))} from mem group by head)
      select head, rep.tid, n, rep.len, n_samples, coalesce(h.rid, o.rid) as ref, case when h.rid is not null then '=' else coalesce(o.code, 'u') end as code, {", ".join(f"q{i + 1}" for i in range(N_SAMPLES))}
      from rep left join codes o on o.qid = rep.tid left join codes h on h.qid = rep.first_ and h.code = '='""",
    "redundant": _EX + _DEDUP + f""",
      kc as (select kq.*, chain from kq join chain using (tid)),
      ip as (select a.tid, b.tid as bt, a.strand, a.n as an, b.n as bn, a.s, a.e, b.s as bs, b.e as be, count(*) as k, min(y.i) as y0, max(y.i) as y1 from kq a join kq b on a.seq = b.seq and a.strand = b.strand and a.n > 1 and a.n < b.n and a.s <= b.e and a.e >= b.s
        join gi x on x.tid = a.tid join gi y on y.tid = b.tid and x.a = y.a and x.b = y.b group by all),
      run as (select ip.*, l.s as ls, r.e as re, y0 = 1 as at_first, y1 + 1 = bn as at_last from ip join xi l on l.tid = bt and l.i = y0 join xi r on r.tid = bt and r.i = y1 + 1 where k = an - 1 and y1 - y0 = an - 2),
      f as (select tid, bool_or(s >= ls and e <= re) as plain, bool_or((at_first or s + {samples.POKE} >= ls) and (at_last or e <= re + {samples.POKE})) as poking,
        bool_or(s >= ls and e <= re and case when strand = '+' then at_first and abs(s - bs) <= {REACH} else at_last and abs(e - be) <= {REACH} end) as start_ from run group by tid),
      o as (select kq.tid, exists (select 1 from kc a join kc b on a.seq = b.seq and a.strand = b.strand and a.chain = b.chain where a.tid = kq.tid and (b.len, b.s, b.e, b.tid) > (a.len, a.s, a.e, a.tid)) as same,
        kq.n = 1 and exists (select 1 from kq b where b.n = 1 and b.seq = kq.seq and b.strand = kq.strand and b.tid <> kq.tid and (b.len > kq.len or b.len = kq.len and (b.s, b.e, b.tid) > (kq.s, kq.e, kq.tid)) and least(b.e, kq.e) - greatest(b.s, kq.s) + 1 >= {samples.SINGLE_SHARE} * kq.len) as single,
        kq.n = 1 and exists (select 1 from kq b join ex on ex.tid = b.tid where b.n > 1 and b.seq = kq.seq and b.strand = kq.strand and kq.s >= ex.s and kq.e <= ex.e) as inside from kq)
      select o.tid, case when coalesce(plain, false) then 'chain' when same then 'equal' when single then 'single' else '-' end as why, cast(coalesce(poking, false) or same or single as int) as poking,
        cast(coalesce(start_, false) or same or single as int) as same_start, cast(coalesce(plain, false) or same or single or inside as int) as in_exon from o left join f using (tid)""",
    "tss_clusters": _EX + _DEDUP + f""",
      near as (select distinct a.tid as a, b.tid as b from kq p join ex a on a.tid = p.tid join ex b on a.seq = b.seq and a.strand = b.strand and a.s <= b.e and a.e >= b.s and a.tid <> b.tid join kq q on q.tid = b.tid),
      reach as (select tid, tid as other from kq union select r.tid, n.b from reach r join near n on n.a = r.other),
      lo as (select tid, min(other) as locus from reach group by tid),
      t as (select kq.tid, locus, strand, s, e, case when strand = '-' then e else s end as five, row_number() over (partition by locus order by s, e, kq.tid) as k from kq join lo using (tid)),
      tf as (select distinct locus, strand, 0::bigint as k, []::struct(f bigint, s bigint, e bigint, m bigint[])[] as cl from t
        union all select locus, strand, k, list_append(rest, {{'f': case when strand = '-' then greatest(five, list_max(list_transform(hit, lambda c: c.f))) else least(five, list_min(list_transform(hit, lambda c: c.f))) end,
          's': least(s, list_min(list_transform(hit, lambda c: c.s))), 'e': greatest(e, list_max(list_transform(hit, lambda c: c.e))), 'm': list_append(flatten(list_transform(hit, lambda c: c.m)), tid)}})
        from (select t.*, list_filter(tf.cl, lambda c: c.s <= t.e and c.e >= t.s and abs(c.f - t.five) <= {REACH}) as hit, list_filter(tf.cl, lambda c: not (c.s <= t.e and c.e >= t.s and abs(c.f - t.five) <= {REACH})) as rest
          from tf join t on t.locus = tf.locus and t.k = tf.k + 1)),
      fin as (select locus, unnest(cl) as c from tf where k = (select max(k) from t where t.locus = tf.locus))
      select unnest(c.m) as tid, locus, list_min(c.m) as tss from fin""",
    "sample_strands": _EX + ", " + ", ".join(f"""
      {k}_m as (select tid, strand from tx where dset = 'qry' and strand in ('{c}', '.'){more}),
      {k}_n as (select distinct a.tid as a, b.tid as b from ex a join ex b on a.dset = 'qry' and b.dset = 'qry' and a.seq = b.seq and a.s <= b.e and a.e >= b.s and a.strand in ('{c}', '.') and b.strand in ('{c}', '.') and a.tid <> b.tid
        where a.tid in (select tid from {k}_m) and b.tid in (select tid from {k}_m)),
      {k}_r as (select tid, tid as other from {k}_m union select r.tid, n.b from {k}_r r join {k}_n n on n.a = r.other),
      {k}_t as (select distinct m.tid from {k}_m m join {k}_r r on r.tid = m.tid join {k}_m o on o.tid = r.other where m.strand = '.' and o.strand = '{c}')"""
      for k, c, more in (("fw", "+", ""), ("bw", "-", " and tid not in (select tid from fw_t)"))) + """
      select tid, case when tid in (select tid from fw_t) then '+' when tid in (select tid from bw_t) then '-' else '.' end as strand from tx where dset = 'qry' and strand = '.'""",
    "class_codes_by_class": _CODES + _DEDUP + _EQUAL + """,
      mem as (select head, kq.tid, row_number() over (partition by head order by sample, s, e, tid) as b from kq join eq using (tid)),
      h as (select head, rid from mem join codes on qid = tid where b = 1 and code = '=')
      select mem.tid as qid, coalesce(h.rid, codes.rid) as rid, case when h.rid is not null then '=' else codes.code end as code, h.rid is not null as by_head from mem join codes on qid = tid left join h using (head)""",
}

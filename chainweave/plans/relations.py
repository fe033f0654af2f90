"""Queries on class codes and loci over the derived tables, and SQL that takes the same rules over exploded exons and introns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainweave.functions import intervals as fx
from chainweave.operators import compare, context
from chainweave.operators import loci as lc
from chainweave.operators.best import containers, equal_or_contained
from chainweave.operators.intervals import met_by
from chainweave.plans.testbed import EXONS_SQL, exons, transcripts
from chainweave.session import stage_table

KEY = ["seq", "strand"]


def _transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts(exons(spark, sf_dir)).withColumn("exons", fx.merge_close(F.col("exons")))


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return _sides(stage_table(_transcripts(spark, sf_dir), "transcripts", tidy=True))


def _sides(t: DataFrame) -> tuple[DataFrame, DataFrame]:
    return t.where("dset = 'qry'"), t.where("dset = 'ref'")


def class_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best reference of each query on its strand and its code; u where there is none."""
    q, r = _both(spark, sf_dir)
    return context.class_codes(q, r)


def code_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_codes(spark, sf_dir).groupBy("code").agg(F.count("*").alias("n"))


def loci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts of one set linked by exon overlap on a strand."""
    return lc.loci(exons(spark, sf_dir)).select("tid", "dset", "locus")


def locus_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    ex = exons(spark, sf_dir)
    return lc.locus_table(ex, lc.loci(ex))


def locus_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query and reference loci with exons that overlap."""
    ex = exons(spark, sf_dir)
    return lc.locus_links(ex, lc.loci(ex))


def superloci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lc.superloci(locus_links(spark, sf_dir))


def extended_loci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loci over all sets, of those that hold a query: their span and the transcripts of either set."""
    ex = exons(spark, sf_dir)
    m = lc.loci(ex, ("seq", "strand")).join(ex.groupBy("tid", "dset").agg(F.min("s").alias("s"), F.max("e").alias("e")), "tid")
    out = m.groupBy(*KEY, "locus").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count(F.expr("if(dset = 'qry', 1, null)")).alias("n_qry"), F.count(F.expr("if(dset = 'ref', 1, null)")).alias("n_ref"))
    return out.where("n_qry > 0")


def chain_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-exon queries and references of one intron chain, one to one by place."""
    return lc.chain_matches(_transcripts(spark, sf_dir)).select("qid", "rid")


def transcript_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with single-exon transcripts by near ends or large overlap."""
    return lc.transcript_matches(_transcripts(spark, sf_dir))


def locus_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loci of both sets, those with a matched transcript, and those without any overlapping locus of the other set."""
    t = stage_table(transcripts(exons(spark, sf_dir)), "transcripts", tidy=True)
    ex, some, members = lc.loci_of(t)
    links = stage_table(lc.locus_links(ex, some), "links", tidy=True)
    m = stage_table(lc.transcript_matches(t.withColumn("exons", fx.merge_close(F.col("exons")))), "matches", tidy=True)
    hit = m.select(F.explode(F.array("qid", "rid")).alias("tid")).distinct().withColumn("hit", F.lit(1))
    linked = links.select(F.explode(F.array(F.struct(F.lit("qry").alias("dset"), F.col("qlocus").alias("locus")), F.struct(F.lit("ref").alias("dset"), F.col("rlocus").alias("locus")))).alias("l")).select("l.*").distinct().withColumn("linked", F.lit(1))
    per = members.join(hit, "tid", "left").groupBy("dset", *KEY, "locus").agg(F.max("hit").alias("hit")).join(linked, ["dset", "locus"], "left")
    return per.groupBy(*KEY).agg(*[F.count(F.expr(f"if(dset = '{d}' and {c}, 1, null)")).alias(f"{d}_{n}") for d in ("qry", "ref") for n, c in (("loci", "true"), ("matched", "hit = 1"), ("alone", "linked is null"))])


def tmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a query: best reference, code, size, and the longest transcript of its locus."""
    t = stage_table(transcripts(exons(spark, sf_dir)), "transcripts", tidy=True)
    q, r = _sides(t.withColumn("exons", fx.merge_close(F.col("exons"))))
    ex, some, members = lc.loci_of(t.where("dset = 'qry'"))
    rep = lc.locus_table(ex, some).select("locus", F.col("rep").alias("major_iso_id"))
    out = context.class_codes(q, r).join(q.select(F.col("tid").alias("qid"), fx.covered(F.col("exons")).alias("len")), "qid").join(members.select(F.col("tid").alias("qid"), "locus"), "qid").join(rep, "locus")
    return out.select(F.col("rid").alias("ref_id"), F.col("code").alias("class_code"), F.col("qid").alias("qry_id"), F.col("qn").alias("num_exons"), "len", "major_iso_id", F.col("rlen").alias("ref_match_len"))


def refmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References with the queries that are equal to them or lie in them; a query that is equal to one reference counts there only."""
    q, r = _both(spark, sf_dir)
    links = equal_or_contained(q, r)
    lists = links.groupBy(F.col("rid").alias("ref_id"), F.col("code").alias("class_code")).agg(F.array_sort(F.collect_list("qid")).alias("ids"))
    return lists.select("ref_id", "class_code", F.array_join(F.col("ids").cast("array<string>"), ",").alias("qry_id_list"))


def context_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best codes, those of the surroundings included."""
    t = stage_table(transcripts(exons(spark, sf_dir)), "transcripts", tidy=True)
    q, r = _sides(t.withColumn("exons", fx.merge_close(F.col("exons"))))
    ex, some, members = lc.loci_of(t.where("dset = 'ref'"))
    spans = lc.locus_table(ex, some).select("locus", F.col("s").alias("ls"), F.col("e").alias("le"), "rep")
    return context.class_codes(q, r, members.join(spans, "locus"))


def cross_strand_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries and references of other strands: pairs, those with an intron that agrees but for 10 bases, and those in an intron, by strand."""
    return context.cross_strand_counts(*_both(spark, sf_dir))


def assigned_strands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strands that unstranded queries take from references or from other queries."""
    q, r = _both(spark, sf_dir)
    return context.assigned_strands(q, r.where("strand <> '.'"))


def novel_junctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.novel_junctions(compare.introns_of(_transcripts(spark, sf_dir)))


def self_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different transcripts of the reference whose spans overlap on one strand, by sequence."""
    t = stage_table(_transcripts(spark, sf_dir).where("dset = 'ref'").select(*KEY, "s", "e"), "spans", tidy=True)
    return met_by(t, t, KEY).groupBy(*KEY).agg(F.sum(F.expr("m * (n - 1)")).alias("pairs")).where("pairs > 0")  # each meets itself


def queries_overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries whose span overlaps a reference on their strand, with how many."""
    t = stage_table(_transcripts(spark, sf_dir).select("tid", "dset", *KEY, "s", "e"), "spans", tidy=True)
    q = t.where("dset = 'qry'").drop("dset")
    return q.join(met_by(q, t.where("dset = 'ref'"), KEY), [*KEY, "s", "e"]).groupBy("tid").agg(F.sum("n").alias("n_refs"))


def contained_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries whose intron chain is a run of another query's longer chain and whose span lies in it, with the containers' number."""
    q, _ = _both(spark, sf_dir)
    return containers(q)


def sample_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intron chains over three samples of queries: the transcripts of each sample, '-' where it has none, and how many samples have any."""
    t = _transcripts(spark, sf_dir).where("dset = 'qry' and size(exons) > 1")
    t = t.select(*KEY, fx.rendered(fx.introns(F.col("exons"))).alias("chain"), "tid", F.expr("tid % 3").alias("sample"))
    cell = lambda k: F.coalesce(F.nullif(F.array_join(F.array_sort(F.collect_list(F.expr(f"if(sample = {k}, tid, null)"))).cast("array<string>"), ","), F.lit("")), F.lit("-")).alias(f"s{k}")
    return t.groupBy(*KEY, "chain").agg(F.count_distinct("sample").alias("samples"), cell(0), cell(1), cell(2))


def sequence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts of a set on a sequence: number, bounds and the longest span."""
    return _transcripts(spark, sf_dir).groupBy("dset", "seq").agg(F.count("*").alias("n"), F.min("s").alias("s"), F.max("e").alias("e"), F.max(F.expr("e - s + 1")).alias("longest"))


def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All levels of the comparison."""
    return compare.accuracy(_transcripts(spark, sf_dir))


def missed_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.missed_references(_transcripts(spark, sf_dir))


def queries_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries whose locus overlaps no reference's."""
    return compare.queries_apart(exons(spark, sf_dir))


QUERIES = {f.__name__: f for f in (missed_references, queries_apart, class_codes, code_histogram, loci, locus_table, locus_links, superloci, extended_loci, chain_matches, transcript_matches, locus_level, tmap, refmap, context_codes, cross_strand_pairs, assigned_strands, novel_junctions, self_overlap, queries_overlapping, contained_chains, sample_matrix, sequence_summary, accuracy)}

_EX = "with recursive ex as (" + EXONS_SQL.format(lineitem="lineitem", orders="orders") + """),
tx as (select tid, dset, seq, strand, min(s) as s, max(e) as e, count(*) as n, cast(sum(e - s + 1) as bigint) as len from ex group by all),
xi as (select tid, dset, seq, strand, s, e, row_number() over w as i, lag(e) over w as z, lead(s) over w as b from ex window w as (partition by tid order by s, e)),
gi as (select tid, dset, seq, strand, i, e as a, b, s as p, z from xi where b is not null),
chain as (select tid, string_agg(a || '-' || b, ',' order by i) as chain from gi group by tid)
"""
#: Relations of each pair of overlapping transcripts, by joins of exons and introns; then the rules in their order.
_CODES = _EX + """,
p as (select q.tid as qid, r.tid as rid, q.n as qn, r.n as rn, q.s as qs, q.e as qe, r.s as rs, r.e as re, q.len as ql, r.len as rl, qc.chain = rc.chain as same
  from tx q join tx r on q.seq = r.seq and q.strand = r.strand and q.dset = 'qry' and r.dset = 'ref' and q.s <= r.e and q.e >= r.s
  left join chain qc on qc.tid = q.tid left join chain rc on rc.tid = r.tid),
xx as (select qid, rid, x.i as xi, y.i as yi, x.s as xs, x.e as xe, y.s as ys, y.e as ye, y.b as yb, x.b as xb, qn, rn, qs, qe from p join xi x on x.tid = qid join xi y on y.tid = rid),
ov as (select qid, rid, cast(sum(greatest(0, least(xe, ye) - greatest(xs, ys) + 1)) as bigint) as ovlen,
    min(case when qn = 1 and rn > 1 then case when xs <= ye and xe >= ys and xs > ys - 4 and xe < ye + 4 then yi * 10 + 1 when xs < ye and xe > yb then yi * 10 + 2 when xs > ye and xe < yb then yi * 10 + 3 end end) as turn,
    bool_or(qn > 1 and rn = 1 and xs <= ye and xe >= ys and ys > xs - 4 and ye < xe + 4) as holds,
    bool_or(qn > 1 and rn = 1 and xb is not null and ys > xe and ye < xb) as skips,
    bool_or(qn = 1 and rn > 1 and yb is not null and least(xe, yb - 1) - greatest(xs, ye + 1) + 1 >= 10 and xe - xs + 1 > least(xe, yb - 1) - greatest(xs, ye + 1) + 11) as pre
  from xx group by qid, rid),
part as (select qid, rid, cast(sum(case when yi <= turn // 10 then greatest(0, least(xe, ye) - greatest(xs, ys) + 1) else 0 end) as bigint) as upto from xx join ov using (qid, rid) group by qid, rid),
gg as (select qid, rid, x.i as xi, y.i as yi, x.a as xa, x.b as xb, x.p as xp, x.z as xz, y.a as ya, y.b as yb, y.p as yp, qn, rn from p join gi x on x.tid = qid join gi y on y.tid = rid),
m as (select qid, rid, count(*) filter (xa = ya and xb = yb) as nm, min(yi) filter (xa = ya and xb = yb) as y0, max(yi) filter (xa = ya and xb = yb) as y1, min(xi) filter (xa = ya and xb = yb) as x0, max(xi) filter (xa = ya and xb = yb) as x1,
    coalesce(sum(case when ya <= xb and xa <= yb then cast(xa = ya as int) + cast(xb = yb as int) end), 0) as njm,
    bool_or(ya <= xb and xa <= yb and not (xa = ya and xb = yb)) as cross_, bool_or(yp < xb and xb < ya) as odd from gg group by qid, rid),
ends as (select p.qid, p.rid, q0.e as q0e, ql_.s as qls, r0.e as r0e, r1.s as r1s, rl_.s as rls, rk.e as rke from p
  join xi q0 on q0.tid = qid and q0.i = 1 join xi ql_ on ql_.tid = qid and ql_.i = qn join xi r0 on r0.tid = rid and r0.i = 1 join xi rl_ on rl_.tid = rid and rl_.i = rn
  left join xi r1 on r1.tid = rid and r1.i = 2 left join xi rk on rk.tid = rid and rk.i = rn - 1),
last as (select p.qid, p.rid, bool_or((x.i = 1 or x.p <= rls) and rls < x.a and x.a < re and not (x.i > 1 and x.p = rls and x.z = rke)) as odd2 from p join ends using (qid, rid) join gi x on x.tid = p.qid where rn > 1 group by p.qid, p.rid),
ret as (select qid, rid, bool_or(xi_ < qn and xs <= ya and yb < xe or xi_ > 1 and xs < ya and yb <= xe and (yi = 1 or yp < xs)) as kept
  from (select p.qid, p.rid, p.qn, x.i as xi_, x.s as xs, x.e as xe, y.i as yi, y.a as ya, y.b as yb, y.p as yp from p join xi x on x.tid = qid join gi y on y.tid = rid where qn > 1 and rn > 1) group by qid, rid),
inq as (select p.qid, p.rid, bool_or(qs > y.a and qe < y.b) as within from p join gi y on y.tid = rid group by p.qid, p.rid),
run as (select *, nm = qn - 1 and qn < rn and y1 - y0 = qn - 2 as fwd, nm = rn - 1 and rn < qn and x1 - x0 = rn - 2 as back from p left join m using (qid, rid)),
side as (select qid, rid, coalesce(bool_or(poke is null), false) as spans, coalesce(max(poke), 0) >= 4 as pokes from (
    select r.qid, r.rid, case when qs > g.a then g.b - qs end as poke from run r join gi g on g.tid = r.rid where fwd and g.i < y0 and qs < g.b
    union all select r.qid, r.rid, case when qe < g.b then qe - g.a end from run r join gi g on g.tid = r.rid where fwd and g.i > y1 and qe > g.a
    union all select r.qid, r.rid, case when rs > g.a then g.b - rs end from run r join gi g on g.tid = r.qid where back and g.i < x0 and rs < g.b
    union all select r.qid, r.rid, case when re < g.b then re - g.a end from run r join gi g on g.tid = r.qid where back and g.i > x1 and re > g.a) group by qid, rid),
f as (select r.*, ov.ovlen, turn, holds, skips, pre, upto, q0e, qls, r0e, r1s, rls, rke, coalesce(within, false) as within, coalesce(kept, false) as kept, coalesce(odd2, false) or coalesce(odd, false) as odd_, coalesce(cross_, false) as crossing, coalesce(spans, false) as spans, coalesce(pokes, false) as pokes
  from run r join ov using (qid, rid) join part using (qid, rid) join ends using (qid, rid) left join inq using (qid, rid) left join ret using (qid, rid) left join last using (qid, rid) left join side using (qid, rid)),
coded as (select *, case
    when qn = 1 and rn = 1 then case when abs(qs - rs) <= 1 and abs(qe - re) <= 1 or ovlen >= 0.8 * greatest(ql, rl) or ql > rl and ovlen >= 0.8 * rl and ovlen >= 0.7 * ql then '=' when ql < rl and ovlen >= 0.8 * ql then 'c' when ql >= rl and ovlen >= 0.8 * rl then 'k' else 'o' end
    when qn = 1 then case when qs <= r0e and qe >= rls then 'm' when turn % 10 = 1 then 'c' when turn % 10 = 2 then 'n' when turn % 10 = 3 then 'i' when pre then 'e' else 'o' end
    when rn = 1 then case when holds then 'k' when skips then 'y' else 'o' end
    when within then 'i'
    when qls < r0e then case when qe >= r1s then 'n' else 'o' end
    when rls < q0e then case when qs <= rke then 'n' else 'o' end
    when same then '=' when fwd and not spans and not pokes then 'c' when back and not spans and not pokes then 'k'
    when kept or fwd and spans then case when not pokes and not crossing and not odd_ then 'm' else 'n' end
    when njm > 0 then 'j' when ovlen > 4 then 'o' when qs > rs and qe < re then 'i' else 'y' end as code from f),
ranked as (select qid, rid, code, case code when '=' then 0 when 'c' then 4 when 'k' then 4 when 'm' then 6 when 'n' then 6 when 'j' then 6 when 'e' then 12 when 'o' then 12 when 'i' then 20 else 30 end as rank,
    case when qn = 1 and rn > 1 and code = 'n' then upto when qn > 1 and rn > 1 and code = 'o' and qls < r0e then greatest(0, least(qe, r0e) - greatest(qls, rs) + 1)
      when qn > 1 and rn > 1 and code = 'o' and rls < q0e then greatest(0, least(q0e, re) - greatest(qs, rls) + 1) else ovlen end as ovlen, case when qn > 1 and rn > 1 and not (qls < r0e or rls < q0e) then njm else 0 end as njm, qn, rn, rl from coded),
best as (select * from (select *, row_number() over (partition by qid order by rank, case when qn = 1 and rn > 1 then 1 else 0 end, case when qn > 1 then -njm else 0 end, -ovlen,
    case when rank < 14 then abs(rn - qn) else 0 end, case when rank < 14 then rn else -rn end, -rl, rid) as k from ranked) where k = 1),
codes as (select t.tid as qid, rid, coalesce(code, 'u') as code, cast(coalesce(rank, 94) as int) as rank, coalesce(ovlen, 0) as ovlen, cast(coalesce(njm, 0) as int) as njm, cast(t.n as int) as qn, cast(rn as int) as rn, rl as rlen from tx t left join best on qid = t.tid where t.dset = 'qry')
"""
_LOCI = """,
near as (select distinct a.tid as a, b.tid as b from ex a join ex b on a.dset = b.dset and a.seq = b.seq and a.strand = b.strand and a.s <= b.e and a.e >= b.s and a.tid <> b.tid),
reach as (select tid, tid as other from tx union select r.tid, n.b from reach r join near n on n.a = r.other),
loc as (select tx.tid, dset, seq, strand, s, e, n, len, locus from tx join (select tid, min(other) as locus from reach group by tid) r on r.tid = tx.tid),
lt as (select dset, seq, strand, locus, min(s) as s, max(e) as e, count(*) as n_tx, count(*) filter (n > 1) as n_multi, arg_min(tid, (-len, tid)) as rep from loc group by all),
links as (select distinct a.seq, a.strand, la.locus as qlocus, lb.locus as rlocus from ex a join ex b on a.dset = 'qry' and b.dset = 'ref' and a.seq = b.seq and a.strand = b.strand and a.s <= b.e and a.e >= b.s join loc la on la.tid = a.tid join loc lb on lb.tid = b.tid)
"""
_MATCH = """,
cm as (select q.tid as qid, r.tid as rid from
  (select tx.tid, seq, strand, chain, row_number() over (partition by seq, strand, chain order by s, e, tx.tid) as k from tx join chain using (tid) where dset = 'qry') q join
  (select tx.tid, seq, strand, chain, row_number() over (partition by seq, strand, chain order by s, e, tx.tid) as k from tx join chain using (tid) where dset = 'ref') r using (seq, strand, chain, k))
"""
#: Queries one after the other, each with the references that are taken by then.
_MATCH_ALL = _MATCH + """,
sq as (select tid, seq, strand, s, e, row_number() over (partition by seq, strand order by s, e, tid) as k from tx where n = 1 and dset = 'qry'),
sr as (select tid, seq, strand, s, e, row_number() over (partition by seq, strand order by s, e, tid) as place from tx where n = 1 and dset = 'ref'),
pair as materialized (select q.tid as qid, r.tid as rid, r.place from sq q join sr r on q.seq = r.seq and q.strand = r.strand and q.s <= r.e and q.e >= r.s where abs(q.s - r.s) <= 100 and abs(q.e - r.e) <= 100
  or least(q.e, r.e) - greatest(q.s, r.s) + 1 >= 0.8 * greatest(q.e - q.s + 1, r.e - r.s + 1)
  or q.e - q.s > r.e - r.s and least(q.e, r.e) - greatest(q.s, r.s) + 1 >= 0.8 * (r.e - r.s + 1) and least(q.e, r.e) - greatest(q.s, r.s) + 1 >= 0.7 * (q.e - q.s + 1)),
turn as (select seq, strand, 0::bigint as k, []::bigint[] as taken, null::bigint as qid, null::bigint as rid from (select distinct seq, strand from sq)
  union all select seq, strand, k, case when rid is null then taken else list_append(taken, rid) end, qid, rid from (
    select t.seq, t.strand, q.k, t.taken, q.tid as qid, (select arg_min(p.rid, p.place) from pair p where p.qid = q.tid and not list_contains(t.taken, p.rid)) as rid
    from turn t join sq q on q.seq = t.seq and q.strand = t.strand and q.k = t.k + 1)),
am as (select qid, rid, true as multi from cm union all select qid, rid, false from turn where rid is not null)
"""
_SPANS = "from tx a join tx b on a.seq = b.seq and a.s <= b.e and a.e >= b.s"

SQL = {
    "class_codes": _CODES + "select * from codes",
    "code_histogram": _CODES + "select code, count(*) as n from codes group by code",
    "loci": _EX + _LOCI + "select tid, dset, locus from loc",
    "locus_table": _EX + _LOCI + "select * from lt",
    "locus_links": _EX + _LOCI + "select * from links",
    "superloci": _EX + _LOCI + """, le as (select 'qry:' || qlocus as a, 'ref:' || rlocus as b from links), lr as (select a, b from le union all select b, a from le),
      sr as (select a as n, a as o from lr union select sr.n, lr.b from sr join lr on lr.a = sr.o)
      select substr(n, 1, 3) as dset, substr(n, 5) as locus, min(o) as super from sr group by n""",
    "extended_loci": _EX + """, near as (select distinct a.tid as a, b.tid as b from ex a join ex b on a.seq = b.seq and a.strand = b.strand and a.s <= b.e and a.e >= b.s and a.tid <> b.tid),
      reach as (select tid, tid as other from tx union select r.tid, n.b from reach r join near n on n.a = r.other),
      l as (select tid, min(other) as locus from reach group by tid)
      select seq, strand, locus, min(s) as s, max(e) as e, count(*) filter (dset = 'qry') as n_qry, count(*) filter (dset = 'ref') as n_ref from tx join l using (tid) group by all having n_qry > 0""",
    "chain_matches": _EX + _MATCH + "select qid, rid from cm",
    "transcript_matches": _EX + _MATCH_ALL + "select q.seq, q.strand, qid, rid, multi from am join tx q on q.tid = qid",
    "locus_level": _EX + _LOCI + _MATCH_ALL + """, h as (select qid as tid from am union select rid from am), k as (select 'qry' as dset, qlocus as locus from links union select 'ref', rlocus from links),
      per as (select l.dset, seq, strand, l.locus, bool_or(h.tid is not null) as hit, bool_or(k.locus is not null) as linked from loc l left join h on h.tid = l.tid left join k on k.dset = l.dset and k.locus = l.locus group by all)
      select seq, strand, count(*) filter (dset = 'qry') as qry_loci, count(*) filter (dset = 'qry' and hit) as qry_matched, count(*) filter (dset = 'qry' and not linked) as qry_alone,
        count(*) filter (dset = 'ref') as ref_loci, count(*) filter (dset = 'ref' and hit) as ref_matched, count(*) filter (dset = 'ref' and not linked) as ref_alone from per group by seq, strand""",
    "tmap": _CODES + _LOCI + "select rid as ref_id, code as class_code, qid as qry_id, qn as num_exons, len, rep as major_iso_id, rlen as ref_match_len from codes join loc on loc.tid = qid join lt on lt.dset = 'qry' and lt.locus = loc.locus",
    "refmap": _CODES + """select rid as ref_id, code as class_code, string_agg(qid, ',' order by qid) as qry_id_list from (
      select rid, code, qid from best where code = '=' union all select rid, code, qid from ranked where code = 'c' and qid not in (select qid from best where code = '=')) group by rid, code""",
    "cross_strand_pairs": _EX + f""", p as (select a.tid as qid, b.tid as rid, a.seq, a.strand, a.s, a.e {_SPANS} and a.dset = 'qry' and b.dset = 'ref' and a.strand <> '.' and b.strand <> '.' and a.strand <> b.strand),
      n as (select distinct qid, rid from p join gi x on x.tid = qid join gi y on y.tid = rid where abs(x.a - y.a) <= 10 and abs(x.b - y.b) <= 10),
      i as (select distinct qid, rid from p join gi y on y.tid = rid where p.s > y.a and p.e < y.b)
      select p.seq, p.strand, count(*) as pairs, count(n.qid) as shadows, count(i.qid) as inside from p left join n on n.qid = p.qid and n.rid = p.rid left join i on i.qid = p.qid and i.rid = p.rid group by p.seq, p.strand""",
    "novel_junctions": _EX + """, q as (select seq, strand, a + 1 as s, b - 1 as e, count(distinct tid) as n_tx from gi where dset = 'qry' group by all), r as (select distinct seq, strand, a + 1 as s, b - 1 as e from gi where dset = 'ref')
      select * from q where exists (select 1 from r where r.seq = q.seq and r.strand = q.strand and r.s <= q.e and r.e >= q.s) and not exists (select 1 from r where r.seq = q.seq and r.strand = q.strand and r.s = q.s and r.e = q.e)""",
    "self_overlap": _EX + f"select a.seq, a.strand, count(*) as pairs {_SPANS} and a.strand = b.strand and a.dset = 'ref' and b.dset = 'ref' and a.tid <> b.tid group by a.seq, a.strand",
    "queries_overlapping": _EX + f"select a.tid, count(*) as n_refs {_SPANS} and a.strand = b.strand and a.dset = 'qry' and b.dset = 'ref' group by a.tid",
    "contained_chains": _EX + f""", p as (select a.tid as qid, b.tid as rid, a.n as qn, a.s as qs, a.e as qe {_SPANS} and a.strand = b.strand and a.dset = 'qry' and b.dset = 'qry' and a.n > 1 and a.n < b.n and a.s >= b.s and a.e <= b.e),
      m as (select qid, rid, qn, qs, qe, count(*) as k, min(y.i) as y0, max(y.i) as y1 from p join gi x on x.tid = qid join gi y on y.tid = rid and x.a = y.a and x.b = y.b group by all)
      select qid as tid, count(*) as n_containers from m join xi l on l.tid = rid and l.i = y0 join xi r on r.tid = rid and r.i = y1 + 1 where k = qn - 1 and y1 - y0 = qn - 2 and qs >= l.s and qe <= r.e group by qid""",
    "sequence_summary": _EX + "select dset, seq, count(*) as n, min(s) as s, max(e) as e, max(e - s + 1) as longest from tx group by dset, seq",
}
SQL["sample_matrix"] = _EX + """, i as (select tid, string_agg((a + 1) || '-' || (b - 1), ',' order by i) as chain from gi group by tid)
  select seq, strand, chain, count(distinct tid % 3) as samples, coalesce(string_agg(tid, ',' order by tid) filter (tid % 3 = 0), '-') as s0, coalesce(string_agg(tid, ',' order by tid) filter (tid % 3 = 1), '-') as s1, coalesce(string_agg(tid, ',' order by tid) filter (tid % 3 = 2), '-') as s2
  from tx join i using (tid) where dset = 'qry' group by seq, strand, chain"""
#: Unstranded queries against references of either strand; then those without one against the stranded queries that they share bases with.
SQL["assigned_strands"] = _CODES.replace("q.seq = r.seq and q.strand = r.strand and", "q.seq = r.seq and q.strand = '.' and r.strand <> '.' and") + """, near as (select qid as tid, t.strand from best join tx t on t.tid = rid where ovlen > 0),
  shared as (select a.tid, b.tid as other, b.strand, sum(greatest(0, least(x.e, y.e) - greatest(x.s, y.s) + 1)) as n from tx a join tx b on a.dset = 'qry' and a.strand = '.' and b.dset = 'qry' and b.strand <> '.' and a.seq = b.seq and a.s <= b.e and a.e >= b.s
    join ex x on x.tid = a.tid join ex y on y.tid = b.tid where a.tid not in (select tid from near) group by all),
  most as (select tid, coalesce(max(case when strand = '+' then n end), 0) as f, coalesce(max(case when strand = '-' then n end), 0) as r from shared group by tid)
  select tid, strand from near union all select tid, case when f > r then '+' else '-' end from most where f <> r"""
#: Codes of the surroundings: for each locus of the other strand at most an s, an i and an x, a run behind a locus, and then the best of all.
SQL["context_codes"] = _CODES + _LOCI + """,
had as (select t.tid as qid, t.seq, t.strand, t.s, t.e, t.n, coalesce(code, 'u') as code from tx t left join best on qid = t.tid where t.dset = 'qry'),
cp as (select h.qid, r.tid as rid, h.code as had, locus, h.n as qn, h.s as qs, h.e as qe, {'rid': r.tid, 'rn': r.n, 'rl': r.len} as ref, r.len as rl from had h join tx r on h.seq = r.seq and h.strand in ('+', '-') and r.strand in ('+', '-') and h.strand <> r.strand
  and r.dset = 'ref' and h.s <= r.e and h.e >= r.s join loc on loc.tid = r.tid where h.code not in ('=', 'c', 'j', 'e', 'o')),
sh as (select distinct qid, rid from cp join gi x on x.tid = qid join gi y on y.tid = rid where abs(x.a - y.a) <= 10 and abs(x.b - y.b) <= 10),
ins as (select distinct qid, rid from cp join gi y on y.tid = rid where qs > y.a and qe < y.b),
bs as (select qid, rid, sum(greatest(0, least(x.e, y.e) - greatest(x.s, y.s) + 1)) as n from cp join ex x on x.tid = qid join ex y on y.tid = rid group by all),
cl as (select cp.qid, cp.locus, cp.qn, arg_min(ref, (-rl, cp.rid)) filter (sh.qid is not null) as s, arg_min(ref, (-rl, cp.rid)) filter (ins.qid is not null and had <> 'i') as i,
    arg_min(ref, (-bs.n, cp.rid)) filter (bs.n > 0) as x, arg_min(ref, (-rl, cp.rid)) filter (bs.n = 0) as near
  from cp left join sh on sh.qid = cp.qid and sh.rid = cp.rid left join ins on ins.qid = cp.qid and ins.rid = cp.rid join bs on bs.qid = cp.qid and bs.rid = cp.rid group by all),
lone as (select *, unnest(case when strand = '.' then ['+', '-'] else [strand] end) as side from had where n = 1 and code = 'u'),
behind as (select l.qid, l.n as qn, rep as rid, row_number() over (partition by l.qid order by side, case when side = '+' then -lt.s else lt.s end, lt.locus) as k from lone l join lt on lt.dset = 'ref' and lt.seq = l.seq and lt.strand = l.side
  and case when side = '+' then lt.e between l.s - 1999 and l.s + 5 and lt.s <= l.e else lt.s between l.e + 1 and l.e + 2000 end),
more as (select qid, rid, code, rank, ovlen, njm, qn, rn, rl from ranked
  union all select qid, s.rid, 's', 16, 0, 0, qn, s.rn, s.rl from cl where s is not null union all select qid, i.rid, 'i', 20, 0, 0, qn, i.rn, i.rl from cl where i is not null
  union all select qid, coalesce(x, near).rid, 'x', 18, 0, 0, qn, coalesce(x, near).rn, coalesce(x, near).rl from cl where s is null and i is null
  union all select qid, behind.rid, 'p', 90, 0, 0, qn, tx.n, tx.len from behind join tx on tx.tid = behind.rid where k = 1),
first_ as (select * from (select *, row_number() over (partition by qid order by rank, case when qn = 1 and rn > 1 then 1 else 0 end, case when qn > 1 then -njm else 0 end, -ovlen,
    case when rank < 14 then abs(rn - qn) else 0 end, case when rank < 14 then rn else -rn end, -rl, rid) as k from more) where k = 1)
select t.tid as qid, rid, coalesce(code, 'u') as code, cast(coalesce(rank, 94) as int) as rank, coalesce(ovlen, 0) as ovlen, cast(coalesce(njm, 0) as int) as njm, cast(t.n as int) as qn, cast(rn as int) as rn, rl as rlen
from tx t left join first_ on qid = t.tid where t.dset = 'qry'"""
SQL["missed_references"] = _EX + _MATCH_ALL + "select tid, seq, strand from tx where dset = 'ref' and tid not in (select rid from am)"
SQL["queries_apart"] = _EX + _LOCI + "select tid, strand, case strand when '+' then 'F' when '-' then 'R' else 'U' end as side, seq from loc where dset = 'qry' and locus not in (select qlocus from links)"

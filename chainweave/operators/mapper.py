"""Mapping of queries to references on any strand, and its reports: all overlaps, best overlap, junctions, simple lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainweave.functions import intervals as fx
from chainweave.operators.classify import ORDER, OVERLAP_RANK, RANK, pair_codes, rank_of
from chainweave.operators.context import span_pairs

#: Where a query's first shared base lies in the reference's spliced sequence, from 1.
_REFSTART = """array_min(flatten(transform(r.x, (y, j) -> transform(filter(q.x, x -> x.s <= y.e and x.e >= y.s),
    x -> aggregate(slice(r.x, 1, j), 0L, (n, v) -> n + v.e - v.s + 1) + greatest(x.s, y.s) - y.s + 1))))"""


def mapped(queries: DataFrame, refs: DataFrame, codes: str | None = None, self_map: bool = False, **how) -> DataFrame:
    """(seq, q, r, code, rank, ovlen, njm, opposite) of all pairs whose spans overlap.

    A pair of opposite strands that would share exons has the code x and no shared bases. ``codes`` keeps the
    codes it lists; with self_map pairs of one id go.
    """
    p = pair_codes(span_pairs(queries, refs, any_strand=True), **how).where("code is not null").withColumn("rank", rank_of("code"))
    p = p.withColumn("opposite", F.expr("q.strand <> r.strand and q.strand <> '.' and r.strand <> '.'"))
    hidden = F.col("opposite") & (F.col("rank") < OVERLAP_RANK)
    p = p.withColumns({"code": F.when(hidden, "x").otherwise(F.col("code")), "ovlen": F.when(hidden, 0).otherwise(F.col("ovlen")), "rank": F.when(hidden, RANK["x"]).otherwise(F.col("rank"))})
    if codes:
        p = p.where(F.col("code").isin(*codes))
    return p.where("q.id <> r.id") if self_map else p


def ordered(pairs: DataFrame) -> DataFrame:
    """pairs with ``order``: a struct that sorts a query's references, the best first."""
    p = pairs.withColumns({"qn": F.col("q.n"), "rn": F.col("r.n"), "rlen": F.col("r.len"), "rcds": F.expr("r.ce > 0"), "rid": F.col("r.id")})
    return p.withColumn("order", F.struct(*[F.expr(x).alias(f"o{i}") for i, x in enumerate(ORDER)])).drop("qn", "rn", "rlen", "rcds", "rid")


def overlap_table(pairs: DataFrame, best: bool = False) -> DataFrame:
    """qid, code, rid, ref_cov (per cent of the reference), bias (0.5: overlap in its middle), introns (number, and which of them match, in the direction of the strand), njm."""
    p = pairs
    if best:
        p = ordered(p).groupBy("q.id").agg(F.min_by(F.struct("q", "r", "code", "ovlen", "njm"), "order").alias("p")).select("p.*")
    p = p.withColumn("start", F.expr(_REFSTART))
    shift = F.expr("if(r.strand = '-', r.len - ovlen - (start - 1), start - 1) + ovlen div 2 - r.len div 2")
    which = "filter(transform(r.c, (y, j) -> if(array_contains(q.c, y), if(r.strand = '-', size(r.c) - j, j + 1), null)), v -> v is not null)"
    hit = F.array_join(F.array_sort(F.expr(which)).cast("array<string>"), ",")
    return p.select(
        F.col("q.id").alias("qid"),
        "code",
        F.col("r.id").alias("rid"),
        F.when(F.col("ovlen") > 0, F.round(100.0 * F.col("ovlen") / F.col("r.len"), 0)).alias("ref_cov"),
        F.when(F.col("ovlen") > 0, F.round(0.5 + shift / F.col("r.len"), 2)).alias("bias"),
        F.when(hit != "", F.concat_ws(":", F.size("r.c").cast("string"), hit)).otherwise(".").alias("introns"),
        "njm",
    )


def junction_table(queries: DataFrame, pairs: DataFrame, genes: DataFrame) -> DataFrame:
    """qid, place (seq:strand:exons), refs (code|ref|gene, best first), genes, junctions of every query.

    genes (tid, gene) names the references. junctions are the query's introns that no reference of its strand has, as
    ``s-e:`` and n (novel) or . (known) for either end, ss where both are known.
    """
    every = queries.select(F.col("tid").alias("qid"), F.concat_ws(":", "seq", "strand", fx.rendered(F.col("exons"))).alias("place"), fx.introns(F.col("exons")).alias("introns"))
    p = ordered(pairs).join(genes.select(F.col("tid").alias("gid"), "gene"), F.col("r.id") == F.col("gid"), "left")
    ref = F.struct("order", F.concat_ws("|", "code", F.col("r.id").cast("string"), F.coalesce("gene", F.lit("."))).alias("ref"))
    known = F.collect_set(F.when(~F.col("opposite"), F.col("r.c")))
    found = p.groupBy(F.col("q.id").alias("qid")).agg(F.array_sort(F.collect_list(ref)).alias("refs"), F.array_sort(F.collect_set(F.when(F.col("rank") < OVERLAP_RANK, F.col("gene")))).alias("genes"), F.flatten(known).alias("known"))
    out = every.join(found, "qid", "left")
    novel = """filter(transform(introns, i -> case when exists(known, k -> k.a = i.s - 1 and k.b = i.e + 1) then null
        else concat(i.s, '-', i.e, ':', case when exists(known, k -> k.a = i.s - 1) and exists(known, k -> k.b = i.e + 1) then 'ss'
          else concat(if(coalesce(exists(known, k -> k.a = i.s - 1), false), '.', 'n'), if(coalesce(exists(known, k -> k.b = i.e + 1), false), '.', 'n')) end) end), v -> v is not null)"""
    dot = lambda c: F.coalesce(F.nullif(F.array_join(c, ","), F.lit("")), F.lit("."))
    return out.select("qid", "place", dot(F.col("refs.ref")).alias("refs"), dot(F.col("genes")).alias("genes"), dot(F.expr(novel)).alias("junctions"))


def simple_table(pairs: DataFrame) -> DataFrame:
    """qid and ``ref:percent`` of the references that share exon bases with a query, not those of the opposite strand."""
    p = pairs.where("not opposite and ovlen > 0").select(F.col("q.id").alias("qid"), F.struct(F.col("r.id").alias("id"), F.format_string("%s:%.1f", F.col("r.id").cast("string"), 100.0 * F.col("ovlen") / F.col("r.len")).alias("t")).alias("v"))
    return p.groupBy("qid").agg(F.array_join(F.array_sort(F.collect_list("v"))["t"], ",").alias("refs"))


def text_lines(pairs: DataFrame) -> DataFrame:
    """(qid, line): a header for each query, then a line for each reference, best first."""
    p = ordered(pairs)
    place = F.format_string("%s:%d-%d", "seq", F.col("q.s"), F.col("q.e"))
    head = F.concat(F.lit(">"), F.concat_ws(" ", F.col("q.id").cast("string"), place, F.col("q.strand"), fx.rendered(F.col("q.x"))))
    line = F.concat_ws("\t", "code", "seq", "r.strand", F.col("r.s").cast("string"), F.col("r.e").cast("string"), F.col("r.id").cast("string"), fx.rendered(F.col("r.x")))
    rows = p.groupBy(F.col("q.id").alias("qid")).agg(F.first(head).alias("head"), F.array_sort(F.collect_list(F.struct("order", line.alias("line"))))["line"].alias("lines"))
    return rows.select("qid", F.posexplode(F.concat(F.array("head"), F.col("lines"))).alias("i", "line"))

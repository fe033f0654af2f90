"""Accuracy of a query set against a reference set at six levels, with missed and novel features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainweave.functions import intervals as fx
from chainweave.operators.intervals import islands, range_join
from chainweave.operators.loci import KEY, locus_links, loci, single_matches, strict_chain_matches, superloci, transcript_matches
from chainweave.session import stage_table


def introns_of(t: DataFrame) -> DataFrame:
    """(tid, dset, seq, strand, s, e) of transcripts' introns."""
    i = t.select("tid", "dset", *KEY, F.explode(fx.introns(F.col("exons"))).alias("i"))
    return i.select("tid", "dset", *KEY, F.col("i.s").alias("s"), F.col("i.e").alias("e"))


def unique_exons(ex: DataFrame) -> DataFrame:
    """Distinct exons of a set, with whether they end their transcript on a side; of several transcripts the first by place and id tells."""
    ends = ex.groupBy("tid", "dset", *KEY).agg(F.min("s").alias("ts"), F.max("e").alias("te"))
    x = ex.join(ends, ["tid", "dset", *KEY])
    flags = F.min_by(F.struct((F.col("s") == F.col("ts")).alias("l"), (F.col("e") == F.col("te")).alias("r")), F.struct("ts", "te", "tid")).alias("f")
    return x.groupBy("dset", *KEY, "s", "e").agg(flags).select("dset", *KEY, "s", "e", F.col("f.l").alias("is_left"), F.col("f.r").alias("is_right"))


def exon_matches(u: DataFrame, reach: int = 100) -> DataFrame:
    """(seq, strand, s, e, s2, e2): exons of queries and references with equal ends, or ends at most ``reach`` apart where both are terminal."""
    q = u.where("dset = 'qry'").drop("dset")
    r = u.where("dset = 'ref'").select(*KEY, F.col("s").alias("s2"), F.col("e").alias("e2"), F.col("is_left").alias("l2"), F.col("is_right").alias("r2"))
    near = f"(s = s2 or is_left and l2 and abs(s - s2) <= {reach}) and (e = e2 or is_right and r2 and abs(e - e2) <= {reach})"
    return range_join(q, r, KEY).where(near).select(*KEY, "s", "e", "s2", "e2")


def without_partner(rows: DataFrame, mine: str, other: str, by: list[str] = KEY) -> DataFrame:
    """Distinct intervals of one set that none of the other set overlaps, within ``by``."""
    i = rows.select("dset", *by, "s", "e").distinct()
    a, b = i.where(f"dset = '{mine}'").drop("dset"), i.where(f"dset = '{other}'").select(*by, F.col("s").alias("s2"), F.col("e").alias("e2"))
    met = range_join(a, b, by).select(*by, "s", "e").distinct()
    return a.join(met, [*by, "s", "e"], "left_anti")


def novel_junctions(introns: DataFrame) -> DataFrame:
    """Query introns (seq, strand, s, e, n_tx) that overlap a reference intron, none of which is equal."""
    q = introns.where("dset = 'qry'").groupBy(*KEY, "s", "e").agg(F.count_distinct("tid").alias("n_tx"))
    r = introns.where("dset = 'ref'").select(*KEY, F.col("s").alias("s2"), F.col("e").alias("e2")).distinct()
    met = range_join(q, r, KEY).select(*KEY, "s", "e").distinct()
    return q.join(met, [*KEY, "s", "e"], "left_semi").join(r.select(*KEY, F.col("s2").alias("s"), F.col("e2").alias("e")), [*KEY, "s", "e"], "left_anti")


def missed_references(t: DataFrame, reach: int = 100) -> DataFrame:
    """(tid, seq, strand) of references that no query matches."""
    hit = transcript_matches(t, reach).select(F.col("rid").alias("tid"))
    return t.where("dset = 'ref'").select("tid", *KEY).join(hit, "tid", "left_anti")


def queries_apart(ex: DataFrame) -> DataFrame:
    """(tid, strand, side, seq) of queries in loci that overlap no reference's locus; side is F, R or U for forward, reverse and unstranded."""
    ex = stage_table(ex, "exons")
    members = stage_table(loci(ex), "loci")
    met = locus_links(ex, members).select(F.col("qlocus").alias("locus")).distinct()
    out = members.where("dset = 'qry'").join(met, "locus", "left_anti")
    return out.select("tid", "strand", F.expr("case strand when '+' then 'F' when '-' then 'R' else 'U' end").alias("side"), "seq")


def base_counts(ex: DataFrame) -> DataFrame:
    """(seq, tp, q, r): bases of the unions of queries and references and of what they share."""
    u = islands(ex, ["dset", *KEY])
    q, r = u.where("dset = 'qry'").drop("dset"), u.where("dset = 'ref'").select(*KEY, F.col("s").alias("s2"), F.col("e").alias("e2"))
    both = range_join(q, r, KEY).select("seq", fx.overlap_len("s", "e", "s2", "e2").alias("tp"), F.lit(0).alias("q"), F.lit(0).alias("r"))
    size = u.select("seq", F.lit(0).alias("tp"), F.expr("if(dset = 'qry', e - s + 1, 0)").alias("q"), F.expr("if(dset = 'ref', e - s + 1, 0)").alias("r"))
    return both.unionByName(size)


def accuracy(t: DataFrame, reach: int = 100, per_seq: bool = False, strict: bool = False, met_refs: bool = False, met_queries: bool = False) -> DataFrame:
    """level, q_matched, q, r_matched, r, sn, pr of transcripts (tid, dset, seq, strand, exons), and missed and novel counts as levels of their own.

    ``seq`` comes first if per_seq, null for all. Sensitivity and precision are percentages, null where there is nothing to
    divide by. Matching needs one strand; unstranded queries count as unmatched. Introns are held against those of
    the same super-locus only. With ``strict`` a transcript is matched by near ends only, and chains in common are counted as
    ``strict_chain_matches`` does. With ``met_refs`` only references whose locus overlaps a query's count, with ``met_queries`` only
    queries whose locus overlaps a reference's.
    """
    t = stage_table(t.select("tid", "dset", *KEY, "exons"), "transcripts")
    ex = stage_table(t.select("tid", "dset", *KEY, F.explode("exons").alias("x")).select("tid", "dset", *KEY, "x.s", "x.e"), "exons")
    members = stage_table(loci(ex), "loci")
    links = stage_table(locus_links(ex, members).where("strand <> '.'"), "links")
    for d, on, side_locus in (("ref", met_refs, "rlocus"), ("qry", met_queries, "qlocus")):
        if on:
            met = members.where(f"dset = '{d}'").join(links.select(F.col(side_locus).alias("locus")).distinct(), "locus", "left_semi")
            members = stage_table(members.where(f"dset <> '{d}'").unionByName(met), "loci")
    if met_refs or met_queries:
        counted = members.select("tid", "dset", *KEY)
        t, ex = (stage_table(x.join(counted, ["tid", "dset", *KEY], "left_semi"), "counted") for x in (t, ex))
    sup = stage_table(superloci(links), "superloci")
    # every level is rows of (seq, side, feature counts)
    side = lambda d: F.expr(f"cast(dset = '{d}' as long)")
    zero = F.lit(0).cast("long")
    rows = [base_counts(ex.where("strand <> '.' or dset = 'qry'")).select("seq", F.lit("base").alias("level"), F.col("tp").alias("q_matched"), "q", F.col("tp").alias("r_matched"), "r")]

    def level(name: str, totals: DataFrame, q_hit: DataFrame, r_hit: DataFrame) -> None:
        rows.append(totals.select("seq", F.lit(name).alias("level"), zero.alias("q_matched"), side("qry").alias("q"), zero.alias("r_matched"), side("ref").alias("r")))
        rows.append(q_hit.select("seq", F.lit(name).alias("level"), F.lit(1).alias("q_matched"), zero.alias("q"), zero.alias("r_matched"), zero.alias("r")))
        rows.append(r_hit.select("seq", F.lit(name).alias("level"), zero.alias("q_matched"), zero.alias("q"), F.lit(1).alias("r_matched"), zero.alias("r")))

    u = stage_table(unique_exons(ex), "unique")
    met = exon_matches(u.where("strand <> '.'"), reach)
    level("exon", u, met.select("seq", "strand", "s", "e").distinct(), met.select("seq", "strand", "s2", "e2").distinct())
    introns = stage_table(introns_of(t), "introns")
    di = introns.select("dset", *KEY, "s", "e").distinct()
    same = di.where("strand <> '.'").groupBy(*KEY, "s", "e").agg(F.count("*").alias("n")).where("n = 2")
    level("intron", di, same, same)
    chains = t.where("size(exons) > 1")
    if strict:
        pairs, met = strict_chain_matches(t.where("strand <> '.'"), reach)
        matched = stage_table(pairs.unionByName(single_matches(t.where("strand <> '.'"), reach, strict=True)), "matches")
        met = met.select("seq", F.explode(F.expr("sequence(1L, n)")))
        level("chain", chains, met, met)
    else:
        matched = stage_table(transcript_matches(t.where("strand <> '.'"), reach), "matches")
        level("chain", chains, matched.where("multi"), matched.where("multi"))
    level("transcript", t, matched, matched)
    lt = members.select("dset", "seq", "locus").distinct()
    hit = lambda d, c: members.where(f"dset = '{d}'").join(matched.select(F.col(c).alias("tid")), "tid").select("seq", "locus").distinct()
    level("locus", lt, hit("qry", "qid"), hit("ref", "rid"))
    # missed and novel: features without any overlap, introns within super-loci
    named = sup.withColumnRenamed("super", "su")
    inside = introns.join(members.select("tid", "dset", *KEY, F.col("locus").cast("string").alias("locus")), ["tid", "dset", *KEY]).join(named, ["dset", "locus"], "left")
    inside = inside.withColumn("su", F.coalesce("su", F.concat_ws(":", "dset", "locus")))
    alone = {"exon": (u.where("strand <> '.'"), KEY), "intron": (inside, [*KEY, "su"])}
    none = F.lit(0).cast("long")
    for name, (x, by) in alone.items():
        rows.append(without_partner(x, "ref", "qry", by).select(*KEY, "s", "e").distinct().select("seq", F.lit(f"missed {name}").alias("level"), none.alias("q_matched"), none.alias("q"), F.lit(1).alias("r_matched"), none.alias("r")))
        novel = without_partner(x, "qry", "ref", by).select(*KEY, "s", "e").distinct()
        if name == "exon":
            novel = novel.unionByName(u.where("dset = 'qry' and strand = '.'").select(*KEY, "s", "e"))
        rows.append(novel.select("seq", F.lit(f"novel {name}").alias("level"), F.lit(1).alias("q_matched"), none.alias("q"), none.alias("r_matched"), none.alias("r")))
    lone = lambda d, c: lt.where(f"dset = '{d}'").join(links.select(F.col(c).alias("locus")).distinct(), "locus", "left_anti")
    rows.append(lone("ref", "rlocus").select("seq", F.lit("missed locus").alias("level"), none.alias("q_matched"), none.alias("q"), F.lit(1).alias("r_matched"), none.alias("r")))
    rows.append(lone("qry", "qlocus").select("seq", F.lit("novel locus").alias("level"), F.lit(1).alias("q_matched"), none.alias("q"), none.alias("r_matched"), none.alias("r")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    sums = [F.sum(c).cast("long").alias(c) for c in ("q_matched", "q", "r_matched", "r")]
    total = out.groupBy("level").agg(*sums)
    if per_seq:
        total = out.groupBy("seq", "level").agg(*sums).unionByName(total.withColumn("seq", F.lit(None).cast("string")))
    share = lambda a, b: F.round(F.try_divide(100.0 * F.col(a), F.col(b)), 4)
    return total.withColumns({"sn": share("r_matched", "r"), "pr": share("q_matched", "q")})

"""Several samples in one table: duplicates within a sample, equal transcripts across samples, tracking, redundant transcripts, and clusters of start sites.

Transcripts are rows of sample, tid (unique over samples), seq, strand, exons (sorted structs of s and e).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainweave.functions import intervals as fx
from chainweave.operators.best import best_matches, equal_chains, folded, members
from chainweave.operators.classify import best_codes
from chainweave.operators.components import connected_components
from chainweave.operators.intervals import islands, range_join
from chainweave.operators.loci import KEY, loci, near_exons
from chainweave.session import stage_table

#: Bases that an end may poke into a container's intron; the share of the shorter of two single exons.
POKE, SINGLE_SHARE = 50, 0.85


def laid(t: DataFrame) -> DataFrame:
    """sample, tid, seq, strand, s, e, n, len and c (introns) of transcripts; has_cds false where there is no such column."""
    cds = F.coalesce(F.col("has_cds"), F.lit(False)) if "has_cds" in t.columns else F.lit(False)
    return t.select("sample", "tid", *KEY, F.expr("exons[0].s").alias("s"), F.expr("exons[size(exons) - 1].e").alias("e"), F.size("exons").alias("n"), fx.covered(F.col("exons")).alias("len"), fx.introns(F.col("exons")).alias("c"), cds.alias("has_cds"))


def _fold(contain: bool) -> Callable[[pa.Table], pa.Table]:
    def fold(island: pa.Table) -> pa.Table:
        """Single exons by place: each meets the last kept one that it matches, and the longer of the two stays, else the earlier."""
        x = island.sort_by([("s", "ascending"), ("e", "ascending")])
        s, e, first = (x.column(c).to_numpy() for c in ("s", "e", "first"))
        owner = np.arange(len(s))
        kept = np.zeros(len(s), dtype=bool)
        widest = int((e - s).max()) + 1
        for i in range(len(s)):
            lo = np.searchsorted(s, s[i] - widest)
            at = lo + np.flatnonzero(kept[lo:i] & (e[lo:i] >= s[i]))
            hit = at[near_exons(int(s[i]), int(e[i]), s[at], e[at], 0)]
            if contain:
                hit = hit[(s[hit] <= s[i]) & (e[hit] >= e[i])]
            kept[i] = True
            if len(hit):
                j = hit[-1]
                lost = i if e[j] - s[j] >= e[i] - s[i] else j
                kept[lost], owner[lost] = False, j + i - lost
        while (owner[owner] != owner).any():
            owner = owner[owner]
        return pa.table({**{c: pa.repeat(island.column(c)[0], len(s)) for c in ("sample", *KEY)}, "s": s, "e": e, "into": first[owner]})

    return fold


def deduplicated(t: DataFrame, contain: bool = False) -> DataFrame:
    """(sample, tid, into) for transcripts of one strand of a sample: into is the transcript that stands for tid, itself if it stays.

    Chains of equal introns are one transcript; with ``contain`` only those that lie within the one that stays. The one
    with coding bases stays, then the longer, then the first by tid. Single exons that match (one end to end, or most of
    the longer covered) are taken by place, each against the last one kept; equal intervals are one row of an
    island, which is walked in one task with 40 bytes for each different interval.
    """
    x = stage_table(laid(t), "laid")
    by = ["sample", *KEY]
    multi = x.where("n > 1")
    if contain:  # by start, the longest first: what ends no later than all before lies in the last one that stayed
        w = Window.partitionBy(*by, "c").orderBy("s", F.desc("e"), F.desc("has_cds"), "tid")
        multi = multi.withColumn("fresh", F.coalesce(F.col("e") > F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)))
        multi = multi.withColumn("into", F.last(F.when(F.col("fresh"), F.col("tid")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        multi = multi.select(*by, "tid", "into")
    else:
        best = multi.groupBy(*by, "c").agg(F.min_by("tid", F.struct(~F.col("has_cds"), -F.col("len"), "tid")).alias("into"))
        multi = multi.join(best, [*by, "c"]).select(*by, "tid", "into")
    one = x.where("n = 1")
    spots = one.groupBy(*by, "s", "e").agg(F.min("tid").alias("first"))
    isl = islands(spots, by).select(*by, F.col("s").alias("island"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    folded = range_join(spots, isl, by).drop("s2", "e2").groupBy(*by, "island").applyInArrow(_fold(contain), f"sample {dict(x.dtypes)['sample']}, seq string, strand string, s long, e long, into {dict(x.dtypes)['tid']}")
    one = one.join(folded, [*by, "s", "e"]).select(*by, "tid", "into")
    return multi.unionByName(one).select("sample", "tid", "into")


def equivalents(t: DataFrame) -> DataFrame:
    """(tid, head): transcripts that are one over the samples, head being the smallest tid of them; each transcript has one row.

    Multi-exon ones have equal introns. A single exon is linked, in each later sample, to the one that matches it with
    the highest score: bases in common less the distances of their ends, then the first by place.
    """
    x = stage_table(laid(t), "laid")
    multi = x.where("n > 1")
    multi = multi.join(multi.groupBy(*KEY, "c").agg(F.min("tid").alias("head")), [*KEY, "c"]).select("tid", "head")
    one = x.where("n = 1").select("sample", "tid", *KEY, "s", "e")
    later = one.select(*KEY, F.col("sample").alias("later"), F.col("tid").alias("other"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    pairs = range_join(one, later, KEY).where("sample < later").withColumn("both", F.expr("least(e, e2) - greatest(s, s2) + 1"))
    pairs = pairs.where("both >= 0.8 * greatest(e - s + 1, e2 - s2 + 1) or e - s > e2 - s2 and both >= 0.8 * (e2 - s2 + 1) and both >= 0.7 * (e - s + 1)")
    score = F.expr("both - abs(s - s2) - abs(e - e2)")
    best = pairs.groupBy("tid", "later").agg(F.min_by("other", F.struct(-score, "s2", "e2", "other")).alias("other"))
    comps = connected_components(best.select("tid", "other")).select(F.col("node").alias("tid"), F.col("component").alias("head"))
    alone = one.select("tid").join(comps.select("tid"), "tid", "left_anti").select("tid", F.col("tid").alias("head"))
    return multi.unionByName(comps).unionByName(alone)


def consensus(t: DataFrame, heads: DataFrame) -> DataFrame:
    """(head, tid): the longest transcript of those that are one, the first by sample and tid of equal ones."""
    x = laid(t).join(heads, "tid")
    return x.groupBy("head").agg(F.min_by("tid", F.struct(-F.col("len"), "sample", "tid")).alias("tid"))


def tracked(t: DataFrame, heads: DataFrame, codes: DataFrame, samples: list, labels: DataFrame | None = None) -> DataFrame:
    """head, tid (of the consensus), n, len, ref, code, n_samples, and a column for each of ``samples``: q1, q2 and so on.

    A cell lists the sample's transcripts as ``tid|exons|bases``, or as ``labels`` (tid, v) says, by tid, or is '-'. ``codes`` has the best reference and the
    code of each query (qid, rid, code). If the head of what is one transcript equals a reference, that one is every
    member's; else the consensus tells.
    """
    x = stage_table(laid(t).join(heads, "tid").drop("c"), "members")
    rep = x.groupBy("head").agg(F.min_by(F.struct("tid", "n", "len"), F.struct(-F.col("len"), "sample", "tid")).alias("m"), F.count_distinct("sample").alias("n_samples"), F.min_by("tid", F.struct("sample", "s", "e", "tid")).alias("first"))
    own = codes.select(F.col("qid").alias("tid"), F.col("rid").alias("ref"), "code")
    head = codes.where("code = '='").select(F.col("qid").alias("first"), F.col("rid").alias("head_ref"))
    rep = rep.select("head", "m.*", "n_samples", "first").join(own, "tid", "left").join(head, "first", "left")
    rep = rep.select("head", "tid", "n", "len", "n_samples", F.coalesce("head_ref", "ref").alias("ref"), F.when(F.col("head_ref").isNotNull(), "=").otherwise(F.coalesce("code", F.lit("u"))).alias("code"))
    said = x.withColumn("v", F.concat_ws("|", "tid", "n", "len")) if labels is None else x.join(labels.select("tid", "v"), "tid")
    item = F.struct("tid", "v")
    cells = said.groupBy("head").pivot("sample", samples).agg(F.array_sort(F.collect_list(item)))  # a sample's copies of one transcript
    cells = cells.select("head", *[F.when(F.size(F.coalesce(f"`{k}`", F.array())) > 0, F.array_join(F.transform(f"`{k}`", lambda v: v["v"]), ",")).otherwise("-").alias(f"q{i + 1}") for i, k in enumerate(samples)])
    return rep.join(cells, "head")


def contained(t: DataFrame, poke: int = 0, tss: int | None = None, in_exon: bool = False, share: float = SINGLE_SHARE) -> DataFrame:
    """(tid, why) of transcripts that another one of their strand holds: why is 'equal', 'chain', 'single' or 'exon'.

    - equal: of equal introns, all but the longest one, the last by place and tid of equal ones;
    - chain: the introns are a run of a longer chain's, and the ends stay in the exons beside the run; with ``poke`` an end may
      lie so many bases beyond them, and beyond the container. With ``tss`` the 5' introns must be the same and
      the 5' ends at most so far apart;
    - single: a single exon of which a longer one covers ``share``;
    - exon (with ``in_exon``): a single exon within an exon of a chain.

    Chains meet on their first two introns, each different chain once. Where a run ends inside the longer chain its exon there
    is the chain's own; where it ends with it, the farthest end of all transcripts of that chain decides.
    """
    x = stage_table(laid(t), "laid")
    multi, one = x.where("n > 1"), x.where("n = 1")
    order = F.struct("len", "s", "e", "tid")
    chains = multi.groupBy(*KEY, "c").agg(F.max(order).alias("top"), F.min("s").alias("s0"), F.max("e").alias("e0"), F.count("*").alias("m"))
    chains = stage_table(chains.withColumn("k", F.monotonically_increasing_id()), "chains")
    equal = multi.join(chains.where("m > 1"), [*KEY, "c"]).where("tid <> top.tid").select("tid", F.lit("equal").alias("why"))

    # places of a chain's introns; an inner chain of one intron asks for the first only
    at = chains.where("size(c) > 1").select(*KEY, F.col("k").alias("ko"), F.col("c").alias("co"), "s0", "e0", F.posexplode("c").alias("i", "x")).withColumn("y", F.get("co", F.col("i") + 1))
    inner = chains.select(*KEY, F.col("k").alias("ki"), F.col("c").alias("ci"), F.col("c")[0].alias("x"), F.get("c", F.lit(1)).alias("y"))
    run = F.expr("size(ci) < size(co) and slice(co, i + 1, size(ci)) = ci")
    two = at.join(inner.where("size(ci) > 1"), [*KEY, "x", "y"]).where(run)
    lone = at.drop("y").join(inner.where("size(ci) = 1").drop("y"), [*KEY, "x"]).where(run)
    runs = two.drop("y").unionByName(lone)
    left, right = F.expr("if(i > 0, co[i - 1].e + 1, null)"), F.expr("if(i + size(ci) < size(co), co[i + size(ci)].s - 1, null)")
    runs = stage_table(runs.select(*KEY, "ki", "ko", "s0", "e0", left.alias("left"), right.alias("right")), "runs")
    own = multi.join(chains.select(*KEY, "c", F.col("k").alias("ki")), [*KEY, "c"]).select(*KEY, "tid", "s", "e", "ki")
    # the exon beside an inner end bounds it; at the container's own end the container does, or with poke nothing
    inside = F.expr(f"(left is null or s + {poke} >= left) and (right is null or e <= right + {poke})")
    if not poke:
        inside = inside & F.expr("(left is not null or s >= s0) and (right is not null or e <= e0)")
    if tss is None:
        bounds = runs.groupBy("ki", "left", "right").agg(F.min("s0").alias("s0"), F.max("e0").alias("e0"))
        held = own.join(bounds, "ki").where(inside)
    else:
        runs = runs.where("(strand = '+' and left is null) or (strand <> '+' and right is null)")
        five = F.expr("if(strand = '+', s, e)")
        ends = multi.join(chains.select(*KEY, "c", F.col("k").alias("ko")), [*KEY, "c"]).select("ko", five.alias("five2"), F.expr("if(strand = '+', e, s)").alias("three2"))
        ends = ends.groupBy("ko", "five2").agg(F.min("three2").alias("t0"), F.max("three2").alias("t1")).withColumn("bin", F.expr(f"five2 div {max(1, tss)}"))
        rows = own.withColumn("five", five).withColumn("bin", F.explode(F.expr(f"array(five div {max(1, tss)} - 1, five div {max(1, tss)}, five div {max(1, tss)} + 1)")))
        held = rows.join(runs.drop(*KEY, "s0", "e0"), "ki").join(ends, ["ko", "bin"]).where(f"abs(five - five2) <= {tss}")
        held = held.withColumn("s0", F.expr("if(strand = '+', five2, t0)")).withColumn("e0", F.expr("if(strand = '+', t1, five2)")).where(inside)
    chain = held.select("tid").distinct().withColumn("why", F.lit("chain"))

    spots = one.groupBy(*KEY, "s", "e").agg(F.max("tid").alias("last"), F.count("*").alias("m"))
    same = one.join(spots.where("m > 1"), [*KEY, "s", "e"]).where("tid <> last").select("tid", F.lit("single").alias("why"))
    wide = spots.select(*KEY, F.col("s").alias("s2"), F.col("e").alias("e2"))
    longer = "(e2 - s2 > e - s or e2 - s2 = e - s and (s2 > s or s2 = s and e2 > e))"
    in_longer = range_join(spots.select(*KEY, "s", "e"), wide, KEY).where(f"{longer} and least(e, e2) - greatest(s, s2) + 1 >= {share} * (e - s + 1)").select(*KEY, "s", "e").distinct()
    single = one.join(in_longer, [*KEY, "s", "e"], "left_semi").select("tid", F.lit("single").alias("why"))
    out = equal.unionByName(chain).unionByName(same).unionByName(single)
    if in_exon:
        ex = t.where("size(exons) > 1").select(*KEY, F.explode("exons").alias("x")).select(*KEY, F.col("x.s").alias("s2"), F.col("x.e").alias("e2")).distinct()
        met = range_join(spots.select(*KEY, "s", "e"), ex, KEY).where("s >= s2 and e <= e2").select(*KEY, "s", "e").distinct()
        out = out.unionByName(one.join(met, [*KEY, "s", "e"], "left_semi").select("tid", F.lit("exon").alias("why")))
    return out.groupBy("tid").agg(F.min("why").alias("why"))


def _starts(reach: int) -> Callable[[pa.Table], pa.Table]:
    def fold(group: pa.Table) -> pa.Table:
        """By place, a transcript joins the clusters that it overlaps and whose outermost 5' end is near; several become one."""
        x = group.sort_by([("s", "ascending"), ("e", "ascending")])
        minus = x.column("strand")[0].as_py() == "-"
        clusters: list[list] = []  # 5' end, start, end, members
        for k, (s, e) in enumerate(zip(x.column("s").to_pylist(), x.column("e").to_pylist())):
            five = e if minus else s
            near = [c for c in clusters if c[1] <= e and c[2] >= s and abs(c[0] - five) <= reach]
            merged = [(max if minus else min)([five, *[c[0] for c in near]]), min([s, *[c[1] for c in near]]), max([e, *[c[2] for c in near]]), [k, *[m for c in near for m in c[3]]]]
            clusters = [c for c in clusters if not any(c is n for n in near)] + [merged]
        out = np.zeros(x.num_rows, dtype=np.int64)
        for i, c in enumerate(clusters):
            out[c[3]] = i
        return pa.table({**{c: x.column(c) for c in ("locus", *KEY, "s", "e", "session")}, "cluster": pa.array(out)})

    return fold


def start_clusters(t: DataFrame, reach: int = 100) -> DataFrame:
    """(tid, locus, tss) of transcripts (tid, locus, seq, strand, s, e): tss is the smallest tid of its cluster of 5' ends.

    Only ends of one locus and strand that hang together by steps of ``reach`` bases can meet, so that a large locus is cut
    there and each piece is folded by itself; transcripts of one span are one row of it.
    """
    t = stage_table(t.select("tid", "locus", *KEY, "s", "e", F.expr("if(strand = '-', e, s)").alias("five")), "starts")
    by = ["locus", *KEY]
    points = t.select(*by, F.col("five").alias("s"), F.col("five").alias("e")).distinct()
    pieces = islands(points, by, reach).select(*by, F.col("s").alias("s2"), F.col("e").alias("e2"))
    sessions = range_join(points, pieces, by).select(*by, F.col("s").alias("five"), F.col("s2").alias("session"))
    spots = t.select(*by, "s", "e", "five").distinct().join(sessions, [*by, "five"]).drop("five")
    folded = spots.groupBy(*by, "session").applyInArrow(_starts(reach), f"locus {dict(t.dtypes)['locus']}, seq string, strand string, s long, e long, session long, cluster long")
    each = stage_table(t.join(folded, [*by, "s", "e"]).select("tid", *by, "session", "cluster"), "clustered")
    first = each.groupBy(*by, "session", "cluster").agg(F.min("tid").alias("tss"))
    return each.join(first, [*by, "session", "cluster"]).select("tid", "locus", "tss")


def adopted_strands(t: DataFrame) -> DataFrame:
    """(tid, strand) of unstranded transcripts: the strand of the transcripts of any sample that they hang together with, '.' if there are none.

    What hangs together shares exon bases, also by way of other unstranded transcripts. The forward strand comes first:
    what it takes is lost to the other one.
    """
    ex = stage_table(t.select("tid", "seq", "strand", F.explode("exons").alias("x")).select("tid", "seq", "strand", "x.s", "x.e"), "exons")
    open_, taken = ex, None
    for strand in "+-":
        sub = open_.where(F.col("strand").isin(strand, "."))
        members = loci(sub, ("seq",)).join(sub.select("tid", "strand").distinct(), "tid")
        held = members.where(F.col("strand") == strand).select("locus").distinct()
        got = stage_table(members.where("strand = '.'").join(held, "locus", "left_semi").select("tid", F.lit(strand).alias("strand")), "adopted")
        taken = got if taken is None else taken.unionByName(got)
        open_ = open_.join(got.select("tid"), "tid", "left_anti")
    return t.where("strand = '.'").select("tid").join(taken, "tid", "left").select("tid", F.coalesce("strand", F.lit(".")).alias("strand"))


def class_codes(t: DataFrame, refs: DataFrame, heads: DataFrame) -> DataFrame:
    """(qid, rid, code, by_head) of the best reference of each transcript, told by the head of what is one over the samples.

    Where the head of a class (its first transcript by sample and place) equals a reference, so does each member, though it
    may be nearer to another. Chains that equal a reference's are found by their introns; only what is not settled by then
    is held against other references.
    """
    x = stage_table(laid(t).join(heads, "tid").select("sample", "tid", "s", "e", "head"), "members")
    first = x.groupBy("head").agg(F.min_by("tid", F.struct("sample", "s", "e", "tid")).alias("first"))
    x = stage_table(x.join(first, "head").select("tid", "first"), "members")
    q, r = folded(t, KEY), folded(refs, KEY)
    equal = stage_table(members(t, q, best_codes(equal_chains(q, r, KEY)), KEY).select("qid", "rid", "code"), "equal")

    def told(codes: DataFrame) -> DataFrame:
        """All members of classes whose head equals a reference."""
        return x.join(codes.where("code = '='").select(F.col("qid").alias("first"), "rid"), "first").select(F.col("tid").alias("qid"), "rid", F.lit("=").alias("code"), F.lit(True).alias("by_head"))

    settled = stage_table(told(equal), "settled")
    own = equal.join(settled.select("qid"), "qid", "left_anti")
    left = t.join(settled.select(F.col("qid").alias("tid")), "tid", "left_anti").join(own.select(F.col("qid").alias("tid")), "tid", "left_anti")
    coded = stage_table(best_matches(left, refs).select("qid", "rid", "code"), "coded")
    more = stage_table(told(coded), "settled")
    rest = coded.unionByName(own).join(more.select("qid"), "qid", "left_anti").withColumn("by_head", F.lit(False))
    out = settled.unionByName(more).unionByName(rest)
    none = t.select(F.col("tid").alias("qid")).join(out.select("qid"), "qid", "left_anti")
    return out.unionByName(none.select("qid", F.lit(None).cast(dict(out.dtypes)["rid"]).alias("rid"), F.lit("u").alias("code"), F.lit(False).alias("by_head")))

"""The comparison's reports as rows: best references, references with their queries, extended loci, tracking, and annotated lines.

Transcripts are rows of dset ('ref' or a query sample), tid, gene, gene_name, seq, strand, exons, fpkm, tpm, cov.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainweave.functions import intervals as fx
from chainweave.operators import context, samples
from chainweave.operators import loci as lc
from chainweave.operators.classify import best_codes
from chainweave.session import stage_table

#: Order of strands in running numbers.
STRAND = "case strand when '+' then 0 when '-' then 1 else 2 end"


def numbered(rows: DataFrame, order: list[str], name: str = "id") -> DataFrame:
    """rows (seq, strand, ...) with running numbers from 1 by sequence, strand and then ``order``, which must be unique there.

    Ranks are taken inside a sequence and strand; only their counts, one row each, are added up in one place.
    """
    key = ["seq", "strand"]
    counts = rows.groupBy(*key).count()
    before = Window.orderBy("seq", F.expr(STRAND)).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*key, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_n"))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*[F.expr(c) for c in order]))
    return rows.withColumn("_k", rank).join(counts, key).withColumn(name, F.col("_n") + F.col("_k")).drop("_n", "_k")


def exons_of(t: DataFrame) -> DataFrame:
    return t.select("tid", "dset", "seq", "strand", F.explode("exons").alias("x")).select("tid", "dset", "seq", "strand", "x.s", "x.e")


class Comparison:
    """Query transcripts against references: the tables that all reports share, each computed once."""

    def __init__(self, queries: DataFrame, refs: DataFrame, sequence: DataFrame | None = None) -> None:
        self.q, self.r = stage_table(queries, "queries"), stage_table(refs, "refs")
        ex = exons_of(self.q).unionByName(exons_of(self.r))
        self.members = stage_table(lc.loci(ex), "loci")
        self.loci = stage_table(lc.locus_table(ex, self.members), "locus_table")
        spans = self.loci.where("dset = 'ref'").select("locus", F.col("s").alias("ls"), F.col("e").alias("le"), "rep")
        ref_loci = self.members.where("dset = 'ref'").join(spans, "locus")
        self.codes = stage_table(context.class_codes(self.q, self.r, ref_loci, sequence), "codes")

    def _ids(self, t: DataFrame, name: str) -> DataFrame:
        return t.select(F.col("tid").alias(f"{name}_id"), F.coalesce("gene", "gene_name", "tid").alias(f"{name}_gene_id"), F.coalesce("gene_name", "gene", "tid").alias(f"{name}_gene_name"))

    def tmap(self) -> DataFrame:
        """One row a query, in no order."""
        rep = self.members.join(self.loci.select("dset", "locus", "rep"), ["dset", "locus"]).select(F.col("tid").alias("qid"), F.col("rep").alias("major_iso_id"))
        q = self.q.select(F.col("tid").alias("qid"), fx.covered(F.col("exons")).alias("len"), "fpkm", "tpm", "cov")
        out = self.codes.join(q, "qid").join(rep, "qid", "left").withColumnsRenamed({"qid": "qry_id", "rid": "ref_id", "code": "class_code", "qn": "num_exons", "rlen": "ref_match_len"})
        out = out.join(self._ids(self.q, "qry"), "qry_id").join(self._ids(self.r, "ref"), "ref_id", "left")
        return out.select("ref_gene_id", "ref_id", "class_code", "qry_gene_id", "qry_id", "num_exons", "fpkm", "tpm", "cov", "len", F.coalesce("major_iso_id", "qry_id").alias("major_iso_id"), "ref_match_len")

    def refmap(self) -> DataFrame:
        """References that equal queries or hold them (ref_gene, ref_id, class_code, qry_id_list); a query equal to one reference counts there only."""
        rows = stage_table(context.candidates(self.q, self.r).where("code in ('=', 'c')"), "candidates")
        best = best_codes(rows).where("code = '='")
        links = best.select("rid", "code", "qid").unionByName(rows.where("code = 'c'").join(best.select("qid"), "qid", "left_anti").select("rid", "code", "qid"))
        links = links.withColumnsRenamed({"qid": "qry_id", "rid": "ref_id"}).join(self._ids(self.q, "qry"), "qry_id").join(self._ids(self.r, "ref"), "ref_id")
        lists = links.groupBy(F.col("ref_gene_name").alias("ref_gene"), "ref_id", F.col("code").alias("class_code")).agg(F.array_sort(F.collect_list(F.concat_ws("|", "qry_gene_id", "qry_id"))).alias("ids"))
        return lists.select("ref_gene", "ref_id", "class_code", F.array_join("ids", ",").alias("qry_id_list"))

    def extended(self) -> DataFrame:
        """(tid, dset, seq, strand, locus) of loci over all sets that hold a query, and of their references."""
        ex = exons_of(self.q).unionByName(exons_of(self.r))
        m = lc.loci(ex, ("seq", "strand")).join(ex.select("tid", "dset").distinct(), "tid")
        return m.join(m.where("dset <> 'ref'").select("locus").distinct(), "locus", "left_semi")

    def loci_table(self) -> DataFrame:
        """xloc, place, refs and queries of every extended locus, in running numbers."""
        m = stage_table(self.extended(), "extended")
        t = self.q.unionByName(self.r).select("tid", "dset", F.coalesce("gene", "gene_name", "tid").alias("gene"), F.expr("exons[0].s").alias("s"), F.expr("exons[size(exons) - 1].e").alias("e"))
        g = m.join(t, ["tid", "dset"]).groupBy("seq", "strand", "locus").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.array_sort(F.collect_list(F.expr("if(dset = 'ref', concat_ws('|', gene, tid), null)"))).alias("refs"), F.array_sort(F.collect_list(F.expr("if(dset <> 'ref', tid, null)"))).alias("queries"))
        listed = lambda c: F.when(F.size(c) > 0, F.array_join(c, ",")).otherwise("-").alias(c)
        n = numbered(g, ["s", "e", "locus"])
        return n.select(F.format_string("XLOC_%06d", "id").alias("xloc"), F.format_string("%s[%s]%d-%d", "seq", "strand", "s", "e").alias("place"), listed("refs"), listed("queries"), "locus")

    def tracking(self, prefix: str = "TCONS") -> DataFrame:
        """One row a query transcript of a single sample: its number, extended locus, best reference, code and measures."""
        x = self.loci_table().select("locus", "xloc").join(self.extended().select("tid", "dset", "locus"), "locus").where("dset <> 'ref'").select("tid", "xloc")
        q = self.q.select("tid", F.coalesce("gene", "gene_name", "tid").alias("gene"), "seq", "strand", F.expr("exons[0].s").alias("s"), F.expr("exons[size(exons) - 1].e").alias("e"), F.size("exons").alias("n"), fx.covered(F.col("exons")).alias("len"), "fpkm", "tpm", "cov")
        rows = numbered(q, ["s", "e", "tid"]).join(x, "tid").join(self.codes.select(F.col("qid").alias("tid"), F.col("rid").alias("ref_id"), "code"), "tid").join(self._ids(self.r, "ref"), "ref_id", "left")
        mine: Column = F.format_string("q1:%s|%s|%d|%8.6f|%8.6f|%8.6f|%d", "gene", "tid", "n", "fpkm", "tpm", "cov", "len")
        return rows.select(F.format_string(prefix + "_%08d|%d|%d", "id", "n", "len").alias("tcons"), "xloc", F.coalesce(F.concat_ws("|", F.col("ref_gene_id"), F.when(F.col("ref_gene_id").isNotNull(), F.col("ref_id"))), F.lit("-")).alias("ref"), "code", mine.alias("q1"))

    def sample_names(self) -> list[str]:
        """Names of the query samples in order; there are as many as files."""
        return [r["dset"] for r in self.q.select("dset").distinct().orderBy("dset").collect()]

    def kept(self) -> DataFrame:
        """Queries of all samples, numbered, without the duplicates of their sample, and the head of those that are one (head)."""
        if not hasattr(self, "_kept"):
            order = F.array(*map(F.lit, self.sample_names()))
            t = self.q.withColumn("sample", (F.array_position(order, F.col("dset")) - 1).cast("int"))
            t = stage_table(t.join(samples.deduplicated(t).where("tid = into").select("tid"), "tid"), "kept")
            self._kept = stage_table(t.join(samples.equivalents(t), "tid"), "kept")
        return self._kept

    def tracking_by_sample(self, prefix: str = "TCONS") -> DataFrame:
        """One row for what is one transcript over the samples: its number, extended locus, best reference, code, and a column for each sample.

        A sample's transcripts are listed as ``q1:gene|id|exons|fpkm|tpm|cov|bases``, or '-'. head, tid, seq, strand, s and e of the
        longest one come last.
        """
        t = self.kept()
        label = F.format_string("%s|%s|%d|%8.6f|%8.6f|%8.6f|%d", F.coalesce("gene", "gene_name", "tid"), F.col("tid").cast("string"), F.size("exons"), "fpkm", "tpm", "cov", fx.covered(F.col("exons")))
        names = self.sample_names()
        rows = samples.tracked(t, t.select("tid", "head"), self.codes.select("qid", "rid", "code"), list(range(len(names))), t.select("tid", label.alias("v")))
        x = self.loci_table().select("locus", "xloc").join(self.extended().where("dset <> 'ref'").select("tid", "locus"), "locus").select("tid", "xloc")
        place = t.select("tid", "seq", "strand", F.expr("exons[0].s").alias("s"), F.expr("exons[size(exons) - 1].e").alias("e"))
        rows = numbered(rows.join(place, "tid"), ["s", "e", "tid"]).join(x, "tid").join(self._ids(self.r, "ref").withColumnRenamed("ref_id", "ref"), "ref", "left")
        cells = [F.when(F.col(f"q{i + 1}") == "-", "-").otherwise(F.concat(F.lit(f"q{i + 1}:"), f"q{i + 1}")).alias(f"q{i + 1}") for i in range(len(names))]
        ref = F.when(F.col("ref").isNotNull(), F.concat_ws("|", "ref_gene_id", "ref")).otherwise("-").alias("ref")
        return rows.select(F.format_string(prefix + "_%08d|%d|%d", "id", "n", "len").alias("tcons"), "xloc", ref, "code", *cells, "n_samples", "head", "tid", "seq", "strand", "s", "e", "id")

    def loci_by_sample(self) -> DataFrame:
        """xloc, place, refs and a list of transcripts for each sample, '-' where it has none."""
        names = self.sample_names()
        m = self.extended().where("dset <> 'ref'").select("tid", "dset", "locus")
        cells = m.groupBy("locus").pivot("dset", names).agg(F.array_sort(F.collect_list("tid")))
        cells = cells.select("locus", *[F.when(F.size(F.coalesce(f"`{k}`", F.array())) > 0, F.array_join(f"`{k}`", ",")).otherwise("-").alias(f"q{i + 1}") for i, k in enumerate(names)])
        return self.loci_table().drop("queries").join(cells, "locus").select("xloc", "place", "refs", *[f"q{i + 1}" for i in range(len(names))])

    def combined(self, prefix: str = "TCONS", keep: bool = True, poke: int = 0, tss: int | None = None, in_exon: bool = False, keep_equal: bool = False) -> DataFrame:
        """Attributes of the combined set, a row a transcript: tcons, xloc, tid, ref, code, contained, tss, n_samples, redundant.

        What is one over the samples is its longest transcript. With ``keep`` false those that another one of their extended locus holds
        (see ``samples.contained``) are ``redundant``, but for those equal to a reference if ``keep_equal``. tss numbers the clusters of
        start sites from 1 by the smallest number of their transcripts.
        """
        rows = stage_table(self.tracking_by_sample(prefix), "tracking")
        t = self.kept().join(rows.select("tid", "xloc", "id"), "tid")
        held = samples.contained(t.select("sample", "tid", "seq", "strand", "exons"), poke, tss, in_exon)
        starts = samples.start_clusters(t.select(F.col("id").alias("tid"), F.col("xloc").alias("locus"), "seq", "strand", F.expr("exons[0].s").alias("s"), F.expr("exons[size(exons) - 1].e").alias("e")))
        starts = starts.select(F.col("tid").alias("id"), "tss")
        rank = starts.select("tss").distinct().join(rows.select(F.col("id").alias("tss"), "seq", "strand"), "tss")
        starts = starts.join(numbered(rank, ["tss"], "tss_id").select("tss", "tss_id"), "tss").select("id", "tss_id")
        out = rows.join(held, "tid", "left").join(starts, "id")
        gone = F.lit(not keep) & F.col("why").isNotNull() & ~(F.lit(keep_equal) & (F.col("code") == "="))
        return out.select(F.split("tcons", r"\|")[0].alias("tcons"), "xloc", "tid", "ref", "code", F.col("why").alias("contained"), "tss_id", "n_samples", gone.alias("redundant"))

    def annotated(self) -> DataFrame:
        """Lines (seq, s, line) of queries and their exons, with the locus, the best reference and its code."""
        x = self.loci_table().select("locus", "xloc").join(self.extended().where("dset <> 'ref'").select("tid", "locus"), "locus").select("tid", "xloc")
        t = self.q.join(x, "tid").join(self.codes.select(F.col("qid").alias("tid"), F.col("rid").alias("ref_id"), "code"), "tid").join(self._ids(self.r, "ref"), "ref_id", "left")
        head = F.format_string('transcript_id "%s"; gene_id "%s";', "tid", F.coalesce("gene", "tid"))
        more = F.concat(head, F.when(F.col("code").isin("=", "c", "k", "m", "n", "j", "e", "o"), F.format_string(' gene_name "%s";', "ref_gene_name")).otherwise(""), F.format_string(' xloc "%s";', "xloc"), F.coalesce(F.format_string(' cmp_ref "%s";', "ref_id"), F.lit("")), F.format_string(' class_code "%s";', "code"))
        whole = F.struct(F.lit(0).alias("i"), F.lit("transcript").alias("kind"), F.expr("exons[0].s").alias("s"), F.expr("exons[size(exons) - 1].e").alias("e"), more.alias("info"))
        parts = F.transform("exons", lambda v, i: F.struct((i + 1).alias("i"), F.lit("exon").alias("kind"), v["s"].alias("s"), v["e"].alias("e"), F.concat(head, F.format_string(' exon_number "%d";', i + 1)).alias("info")))
        rows = t.select("seq", "strand", "tid", F.coalesce("source", F.lit(".")).alias("source"), F.explode(F.concat(F.array(whole), parts)).alias("v"))
        line = F.concat_ws("\t", "seq", "source", "v.kind", "v.s", "v.e", F.lit("."), "strand", F.lit("."), "v.info")
        return rows.select("seq", "strand", "tid", F.col("v.i").alias("i"), line.alias("line"))


def stats_text(levels: DataFrame) -> DataFrame:
    """(n, line) of the accuracy table and the counts of missed and novel features, from ``compare.accuracy``."""
    names = {"base": "Base level", "exon": "Exon level", "intron": "Intron level", "chain": "Intron chain level", "transcript": "Transcript level", "locus": "Locus level"}
    order = F.create_map(*[F.lit(x) for i, k in enumerate(names) for x in (k, i)])
    title = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    table = levels.where(F.col("level").isin(*names)).select(F.try_element_at(order, F.col("level")).alias("n"), F.format_string("%18s: %7.1f     | %7.1f    |", F.try_element_at(title, F.col("level")), "sn", "pr").alias("line"))
    of = {"missed exon": "exon", "novel exon": "exon", "missed intron": "intron", "novel intron": "intron", "missed locus": "locus", "novel locus": "locus"}
    parent = F.create_map(*[F.lit(x) for kv in of.items() for x in kv])
    place = F.create_map(*[F.lit(x) for i, k in enumerate(of) for x in (k, 10 + i)])
    total = levels.select(F.col("level").alias("p"), F.col("q").alias("tq"), F.col("r").alias("tr"))
    lost = levels.where(F.col("level").isin(*of)).withColumn("p", F.try_element_at(parent, F.col("level"))).join(total, "p")
    n, m = F.expr("if(level like 'missed%', r_matched, q_matched)"), F.expr("if(level like 'missed%', tr, tq)")
    counts = lost.select(F.try_element_at(place, F.col("level")).alias("n"), F.format_string("%21s: %7d/%d\t(%5.1f%%)", F.concat(F.initcap(F.split("level", " ")[0]), F.lit(" "), F.regexp_replace(F.split("level", " ")[1], "locus", "loci")), n, m, 100.0 * n / m).alias("line"))
    return table.unionByName(counts)

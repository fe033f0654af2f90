"""Readers of GTF, GFF3, TLF and BED text, as column functions over lines, and the assembly of transcripts from features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainweave.functions.intervals import merge_close

#: A transcript of this span less 500 or more is dropped; so is a single exon without a transcript's line whose ends are less than LEAST_SPAN apart.
MAX_SPAN, LEAST_SPAN = 7_000_000, 10
_NONE = "cast(array() as array<struct<s:bigint,e:bigint>>)"


def gff_attribute(info: Column, key: str) -> Column:
    """Value of ``key=value``, null if there is none."""
    return F.nullif(F.regexp_extract(info, rf"(?:^|;)\s*{key}=([^;]*)", 1), F.lit(""))


def gtf_attribute(info: Column, key: str) -> Column:
    """Value of ``key "value"``, null if there is none; a value without quotes is none."""
    return F.nullif(F.regexp_extract(info, rf'(?:^|;)\s*{key}\s+"([^"]*)"', 1), F.lit(""))


def decoded(text: Column) -> Column:
    """``%XX`` codes as characters; a percent sign that begins no code stays."""
    return F.try_url_decode(F.regexp_replace(F.replace(text, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25"))


def feature_kind(kind: Column) -> Column:
    """Class of a feature type: utr, exon, codon, cds, intron, transcript, gene, match or other."""
    k = F.lower(kind)
    out = F.when(k.contains("utr"), "utr").when(k.endswith("exon"), "exon").when(k.rlike("^(start|stop)_?codon"), "codon").when(k.startswith("cds"), "cds")
    out = out.when(k.startswith("intron") | k.endswith("intron"), "intron").when(k.endswith("rna") | k.endswith("transcript") | k.endswith("_gene_segment"), "transcript")
    return out.when(k.endswith("gene"), "gene").when(k.endswith("match"), "match").otherwise("other")


def _columns(lines: DataFrame) -> DataFrame:
    """Tab-separated fields c of the lines that have eight or more; comment lines are out."""
    return lines.where(~F.col("value").startswith("#")).select(F.split("value", "\t").alias("c")).where(F.size("c") >= 8)


def read_features(spark: SparkSession, path, sample: str) -> DataFrame:
    """One row for each GTF or GFF3 line of known coordinates: dset, seq, source, kind, s, e, score, strand, phase, info, id, parent, gene, gene_name.

    Bad coordinates are skipped, reversed ones swapped. A line is GFF3 if it has an ID or a Parent, which
    holds for each line by itself; a line of several parents gives one row for each. In GTF the parent of
    exons is their transcript_id.
    """
    return features_of(spark.read.text(path), sample)


def features_of(lines: DataFrame, sample: str) -> DataFrame:
    """The same of lines (value), which may be a stream."""
    c = _columns(lines)
    a, b, info = F.expr("try_cast(c[3] as bigint)"), F.expr("try_cast(c[4] as bigint)"), F.coalesce(F.try_element_at("c", F.lit(9)), F.lit(""))
    rows = c.select(F.lit(sample).alias("dset"), F.col("c")[0].alias("seq"), F.col("c")[1].alias("source"), feature_kind(F.col("c")[2]).alias("kind"), F.when(a.isNotNull() & b.isNotNull(), F.least(a, b)).alias("s"), F.greatest(a, b).alias("e"), F.expr("try_cast(c[5] as double)").alias("score"), F.col("c")[6].alias("strand"), F.col("c")[7].alias("phase"), info.alias("info"))
    rows = rows.where("s is not null and e is not null and kind <> 'match' and strand in ('+', '-', '.')").withColumn("gff3", F.col("info").rlike(r"(?:^|;)\s*(ID|Parent)="))
    g3, gt = (lambda k: gff_attribute(F.col("info"), k)), (lambda k: gtf_attribute(F.col("info"), k))
    name = F.when(F.col("gff3"), F.coalesce(*map(g3, ("gene_name", "geneName", "gene_sym", "gene")))).otherwise(F.coalesce(*map(gt, ("gene_name", "gene_sym", "gene", "genesymbol"))))
    gene = F.when(F.col("gff3"), F.coalesce(g3("geneID"), g3("gene_id"))).otherwise(gt("gene_id"))
    gtf_id = F.when(F.col("kind") == "gene", gene).otherwise(gt("transcript_id"))
    rows = rows.select("*", F.when(F.col("gff3"), g3("ID")).otherwise(F.when(F.col("kind").isin("gene", "transcript"), gtf_id)).alias("id"), gene.alias("gene"), decoded(name).alias("gene_name"), F.when(F.col("gff3"), g3("Parent")).otherwise(F.when(F.col("kind") == "transcript", gt("gene_id")).otherwise(gt("transcript_id"))).alias("parents"))
    return rows.withColumn("parent", F.explode_outer(F.split("parents", ","))).drop("parents", "gff3")


def _merged(spans: Column) -> Column:
    """Sorted spans with neighbours joined that overlap or touch."""
    return merge_close(F.array_sort(spans), 0)


def assemble(features: DataFrame, reference: bool = False, close: int = 4, single_exon: bool = True) -> DataFrame:
    """Transcripts from features, whatever the order of lines: dset, tid, gene, gene_name, seq, strand, source, exons, cs, ce, fpkm, tpm, cov.

    Exons and coding parts of one parent on one sequence make a transcript, with or without a line of its own;
    coding parts count as exons as well. Parts on another strand than a stranded parent are left out; an
    unstranded parent takes its parts' strand. A transcript line without parts has one exon. Exons that overlap or
    touch are joined, then those at most ``close`` bases apart. Spans of MAX_SPAN are dropped, tiny single exons that no
    transcript's line names, single-exon transcripts unless ``single_exon``, and unstranded ones of a reference.
    """
    lines = features.where("kind = 'transcript' and id is not null")
    number = lambda k: F.coalesce(F.expr(f"""try_cast(coalesce(nullif(regexp_extract(info, '(?:^|;)\\\\s*{k}[= ]+"?([^";]+)', 1), ''), '0') as double)"""), F.lit(0.0)).alias(k.lower())
    lines = lines.select("dset", "seq", F.col("id").alias("tid"), F.col("strand").alias("own"), "source", F.col("s").alias("ls"), F.col("e").alias("le"), "gene", "gene_name", "parent", *map(number, ("FPKM", "TPM", "cov")))
    key = ["dset", "seq", "tid"]
    lines = lines.groupBy(*key).agg(*[F.first(c, ignorenulls=True).alias(c) for c in lines.columns if c not in key])
    parts = features.where("kind in ('exon', 'cds', 'utr', 'codon') and parent is not null")
    span = F.struct("s", "e")
    part = parts.groupBy("dset", "seq", F.col("parent").alias("tid"), F.col("strand").alias("pstrand")).agg(
        F.collect_list(F.when(F.col("kind").isin("exon", "cds"), span)).alias("x"), F.min(F.when(F.col("kind") == "cds", F.col("s"))).alias("cs"), F.max(F.when(F.col("kind") == "cds", F.col("e"))).alias("ce"),
        F.first("gene", ignorenulls=True).alias("pgene"), F.first("gene_name", ignorenulls=True).alias("pname"), F.first("source").alias("psource"))
    genes = features.where("kind = 'gene' and id is not null").groupBy("dset", "seq", F.col("id").alias("parent")).agg(F.first(F.coalesce("gene", "id")).alias("ggene"), F.first("gene_name", ignorenulls=True).alias("gname"))
    t = lines.join(part, key, "full").where("own is null or own = '.' or pstrand is null or pstrand = own or pstrand = '.'")
    t = t.join(genes, ["dset", "seq", "parent"], "left")
    strand = F.when(F.col("own").isin("+", "-"), F.col("own")).otherwise(F.coalesce("pstrand", "own"))
    exons = F.when(F.coalesce(F.size("x"), F.lit(0)) > 0, F.col("x")).otherwise(F.array(F.struct(F.col("ls").alias("s"), F.col("le").alias("e"))))
    t = t.select("dset", "tid", F.coalesce("gene", "ggene", "parent", "pgene").alias("gene"), F.coalesce("gene_name", "gname", "pname").alias("gene_name"), "seq", strand.alias("strand"), F.coalesce("source", "psource").alias("source"), exons.alias("x"), F.col("own").isNotNull().alias("lined"), "cs", "ce", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("fpkm", "tpm", "cov")])
    # parts of an unstranded parent may come from several strands' rows: one row a transcript and strand
    t = t.groupBy("dset", "tid", "seq", "strand").agg(F.flatten(F.collect_list("x")).alias("x"), *[F.first(c, ignorenulls=True).alias(c) for c in ("gene", "gene_name", "source", "fpkm", "tpm", "cov")], F.min("cs").alias("cs"), F.max("ce").alias("ce"), F.max("lined").alias("lined"))
    t = t.withColumn("exons", merge_close(_merged(F.col("x")), close)).drop("x").where(F.expr("size(exons) > 0"))
    t = t.where(F.expr(f"exons[size(exons) - 1].e - exons[0].s + 501 <= {MAX_SPAN}"))
    t = t.where(F.expr(f"lined or size(exons) > 1 or exons[0].e - exons[0].s >= {LEAST_SPAN}")).drop("lined")
    t = t if single_exon else t.where("size(exons) > 1")
    return t.where("strand <> '.'") if reference else t


def read_transcripts(spark: SparkSession, path, sample: str, **how) -> DataFrame:
    """Transcripts of GTF or GFF3 files."""
    return assemble(read_features(spark, path, sample), **how)


def read_gtf(spark: SparkSession, path, sample: str) -> DataFrame:
    """(tid string, gene, dset, seq, strand, s, e) of exon lines."""
    f = read_features(spark, path, sample).where("kind = 'exon' and parent is not null")
    return f.select(F.col("parent").alias("tid"), F.coalesce("gene", F.lit("")).alias("gene"), "dset", "seq", "strand", "s", "e")


def read_bed(spark: SparkSession, path, sample: str) -> DataFrame:
    """The same rows from BED lines, whose starts count from 0. Lines of fewer than 12 columns, or whose blocks leave the span, are one exon."""
    lines = spark.read.text(path).where("not startswith(value, '#') and not startswith(value, 'track') and not startswith(value, 'browser')")
    c = lines.select(F.split("value", "\t").alias("c")).where(F.size("c") >= 3)
    c = c.select("c", F.expr("try_cast(c[1] as bigint)").alias("a"), F.expr("try_cast(c[2] as bigint)").alias("b")).where("b > a")
    blocks = "transform(filter(split(get(c, 11), ','), x -> x <> ''), (x, i) -> named_struct('o', try_cast(x as bigint), 'n', try_cast(get(split(get(c, 10), ','), i) as bigint)))"
    whole = "array(named_struct('o', 0L, 'n', b - a))"
    c = c.withColumn("x", F.expr(f"if(size(c) >= 12, {blocks}, {whole})"))
    good = "size(x) > 0 and x[0].o = 0 and forall(x, v -> v.o is not null and v.n is not null and v.n > 0 and v.o + v.n <= b - a)"
    c = c.withColumn("x", F.expr(f"if({good}, x, {whole})")).withColumn("block", F.explode("x"))
    strand = F.when(F.get("c", F.lit(5)).isin("+", "-"), F.get("c", F.lit(5))).otherwise(".")
    name = F.coalesce(F.get("c", F.lit(3)), F.concat_ws(":", F.col("c")[0], F.col("c")[1]))
    start = F.col("a") + F.col("block.o")
    return c.select(name.alias("tid"), name.alias("gene"), F.lit(sample).alias("dset"), F.col("c")[0].alias("seq"), strand.alias("strand"), (start + 1).alias("s"), (start + F.col("block.n")).alias("e"))


def read_tlf(spark: SparkSession, path, sample: str) -> DataFrame:
    """The same rows from one-line transcripts, whose attributes list ``exons=s-e,s-e``; bad parts are skipped, reversed ones swapped."""
    c = _columns(spark.read.text(path)).select("c", F.coalesce(F.try_element_at("c", F.lit(9)), F.lit("")).alias("info"))
    x = F.explode(F.split(gff_attribute(F.col("info"), "exons"), ",")).alias("x")
    rows = c.select(gff_attribute(F.col("info"), "ID").alias("tid"), F.coalesce(gff_attribute(F.col("info"), "geneID"), gff_attribute(F.col("info"), "ID")).alias("gene"), F.lit(sample).alias("dset"), F.col("c")[0].alias("seq"), F.col("c")[6].alias("strand"), x)
    a, b = F.expr("try_cast(split(x, '-')[0] as bigint)"), F.expr("try_cast(get(split(x, '-'), 1) as bigint)")
    return rows.select("tid", "gene", "dset", "seq", "strand", F.when(a.isNotNull() & b.isNotNull(), F.least(a, b)).alias("s"), F.greatest(a, b).alias("e")).where("tid is not null and s is not null and e is not null")


def read_file_list(spark: SparkSession, path: str) -> DataFrame:
    """(sample, file) of a list of files, one a line; short lines, comments and indented lines are skipped."""
    return spark.read.text(path).where("length(value) > 2 and not startswith(value, '#') and not startswith(value, ' ')").select((F.row_number().over(_by_line()) - 1).alias("sample"), F.trim("value").alias("file"))


def _by_line():
    from pyspark.sql import Window

    return Window.orderBy(F.monotonically_increasing_id())  # a list of input files is small


def exon_rows(transcripts: DataFrame) -> DataFrame:
    """(tid, dset, seq, strand, s, e) of transcripts' exons."""
    return transcripts.select("tid", "dset", "seq", "strand", F.explode("exons").alias("x")).select("tid", "dset", "seq", "strand", "x.s", "x.e")

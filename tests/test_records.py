"""Attributes, ids that come again, and coding chains, from text."""

import random

import pytest
from pyspark.sql import functions as F

from chainweave.functions import coding
from chainweave.sources import annotation, records

GTF = """c\ts\tgene\t1\t900\t.\t+\t.\tgene_id "G"; gene_name "N"; description "kinase"; level "3";
c\ts\ttranscript\t1\t900\t.\t+\t.\tgene_id "G"; transcript_id "T"; tag "basic"; product "kinase"; note "a; b";
c\ts\texon\t1\t100\t.\t+\t.\tgene_id "G"; transcript_id "T"; exon_number "1"; exon_id "E1"; tag "ccds"; biotype "mRNA"; score "5"; level 1;
c\ts\texon\t800\t900\t.\t+\t.\tgene_id "G"; transcript_id "T"; exon_number "2"; exon_id "E2"; tag "ccds"; biotype "mRNA"; score "6"; level 1;
c\ts\tCDS\t20\t100\t.\t+\t0\tgene_id "G"; transcript_id "T"; protein_id "P"; biotype "protein";
c\ts\texon\t50\t90\t.\t-\t.\tgene_id "H"; transcript_id "U"; biotype "x"; biotype "y";
"""


def features(spark, tmp_path, text, name="a.gtf"):
    (tmp_path / name).write_text(text)
    return annotation.read_features(spark, str(tmp_path / name), "q")


def test_attributes(spark, tmp_path):
    t, parts = records.attribute_table(features(spark, tmp_path, GTF))
    got = {r.tid: r.attrs for r in t.collect()}
    # equal on all exons: lifted, renamed where the transcript says otherwise; the gene's word comes last
    assert got["T"] == {"gene_id": "G", "transcript_id": "T", "tag": "basic", "product": "kinase", "note": "a; b", "exon_tag": "ccds", "biotype": "mRNA", "CDS_biotype": "protein", "level": "1", "protein_id": "P", "gene_name": "N"}
    assert got["U"] == {"biotype": "y"}
    left = {(r.tid, r.kind, r.s): r.attrs for r in parts.collect()}
    assert left[("T", "exon", 1)] == {"score": "5"} and left[("T", "exon", 800)] == {"score": "6"} and left[("T", "cds", 20)] == {}


def test_gff3_attributes(spark):
    rows = spark.createDataFrame([("ID=t1;Name=a%3Bb;note=x=y;;k=1;k=2",), ("",), ('tag "q"',)], "info string")
    assert [r.a for r in rows.select(records.attributes(F.col("info")).alias("a")).collect()] == [{"ID": "t1", "Name": "a;b", "note": "x=y", "k": "2"}, {}, {"tag": "q"}]


def test_ids_used_again(spark, tmp_path):
    line = 'c\ts\texon\t{}\t{}\t.\t+\t.\ttranscript_id "T"; gene_id "G";\n'
    text = "".join(line.format(s, s + 100) for s in (1000, 2000, 9_000_000, 9_000_500, 16_500_000))
    f = features(spark, tmp_path, text)
    got = {r.tid: [tuple(x) for x in r.exons] for r in annotation.assemble(records.parted_ids(f)).collect()}
    assert got == {"T": [(1000, 1100), (2000, 2100)], "T.2": [(9_000_000, 9_000_100), (9_000_500, 9_000_600)], "T.3": [(16_500_000, 16_500_100)]}
    # within reach it stays one record, whatever the order of lines
    near = features(spark, tmp_path, "".join(reversed(text.splitlines(True)[:2])), "b.gtf")
    assert [r.tid for r in annotation.assemble(records.parted_ids(near)).collect()] == ["T"]


@pytest.mark.parametrize("strand", ["+", "-"])
def test_phases_by_brute_force(spark, strand):
    r, rows = random.Random(3), []
    for i in range(80):
        at, exons = 100, []
        for _ in range(r.randrange(1, 7)):
            exons.append((at, at + r.randrange(0, 60)))
            at = exons[-1][1] + r.randrange(2, 50)
        cs, ce = sorted(r.sample(range(90, at + 20), 2))
        rows.append((i, exons, cs, ce, r.randrange(3)))
    t = spark.createDataFrame(rows, "i long, exons array<struct<s:long,e:long>>, cs long, ce long, first int")
    got = {x.i: [tuple(v) for v in x.out] for x in t.select("i", coding.phased(coding.clipped(F.col("exons"), F.col("cs"), F.col("ce")), F.lit(strand), F.col("first")).alias("out")).collect()}
    for i, exons, cs, ce, first in rows:
        want, n = [], (3 - first) % 3
        segs = [(max(s, cs), min(e, ce)) for s, e in exons if e >= cs and s <= ce]
        for s, e in segs if strand == "+" else segs[::-1]:
            want.append((s, e, -n % 3))
            n += e - s + 1
        assert got[i] == (want if strand == "+" else want[::-1])


def test_following_chains(spark):
    exons = [(1, 100), (200, 300), (400, 500)]
    cases = [([(20, 100), (200, 300), (400, 450)], True), ([(220, 300), (400, 500)], True), ([(20, 100), (200, 250)], True), ([(20, 90), (200, 250)], False), ([(20, 100), (203, 250)], False),
             ([(20, 100), (200, 300), (400, 510)], False), ([(150, 300), (400, 450)], False), ([(20, 60)], True), ([(20, 60), (62, 100), (200, 300), (400, 450)], False), ([(420, 500), (600, 620)], False)]
    t = spark.createDataFrame([(i, c, exons) for i, (c, _) in enumerate(cases)], "i int, c array<struct<s:long,e:long>>, x array<struct<s:long,e:long>>")
    assert [r.y for r in t.orderBy("i").select(coding.follows(F.col("c"), F.col("x")).alias("y")).collect()] == [y for _, y in cases]


def test_coding_chains_from_text(spark, tmp_path):
    lines = [("A", "+", "exon", 1, 100, "."), ("A", "+", "exon", 200, 300, "."), ("A", "+", "CDS", 51, 100, "0"), ("A", "+", "CDS", 200, 250, "."),
             ("B", "-", "exon", 1, 100, "."), ("B", "-", "exon", 200, 300, "."), ("B", "-", "CDS", 51, 100, "1"), ("B", "-", "CDS", 200, 251, "2"),
             ("C", "+", "exon", 1, 300, "."), ("C", "+", "CDS", 10, 60, "."), ("C", "+", "CDS", 60, 100, "."), ("D", "+", "CDS", 10, 60, "."), ("D", "+", "CDS", 70, 100, ".")]
    f = features(spark, tmp_path, "".join(f'c\ts\t{k}\t{s}\t{e}\t.\t{st}\t{p}\ttranscript_id "{t}";\n' for t, st, k, s, e, p in lines))
    got = {r.tid: ([tuple(x) for x in r.cds], r.separate) for r in records.coding_chains(f, annotation.assemble(f)).collect()}
    assert got == {
        "A": ([(51, 100, 0), (200, 250, 1)], False),
        "B": ([(51, 100, 1), (200, 251, 2)], False),
        "C": ([(10, 60, 0), (60, 100, 0)], True),  # a frame shift: one base is read twice
        "D": ([(10, 60, 0), (70, 100, 0)], False),
    }

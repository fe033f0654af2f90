"""A small comparison from text files to reports. Exons of four annotated transcripts and of five assembled ones, and the known results."""

import pytest
from pyspark.sql import functions as F

from chainweave.operators import compare, context, loci, reports
from chainweave.sources import annotation

REFS = {
    "rna157470": ("gene55473", "MGAM", "+", "411-495,1995-2051,2602-2726,9665-9753,12115-12164,12577-12744,14174-14326,14664-14864,16634-16788,17438-17606,17880-17976,18710-18822,20083-20208,21352-21480,21736-21846,22191-22253,24448-24582,25379-25466,26264-26402,27215-27348,56500-56534,56627-56743,57445-57593,58211-58295,59473-59529,61493-61617,62682-62770,64510-64559,65149-65319,67694-68627"),
    "rna157473": ("gene55476", "PRSS58", "-", "219891-219958,219568-219648,217435-217573,216955-217211,214372-214511,214038-214270"),
    "rna157497": ("gene55581", "C7orf34", "+", "962573-962821,963419-963937"),
    "rna157474": ("gene55477", "TRY2P", "-", "233852-234148,233047-233200,230181-231784"),
}
CODING = {"rna157473": "219568-219607,217435-217573,216955-217211,214372-214511,214121-214270", "rna157497": "962614-962821,963419-963654"}
QUERIES = {
    "STRG.1.1": ("+", "403-495,1995-2726,9665-10275"),
    "STRG.3.1": ("-", "214032-214270,214372-214511,216955-217211,217435-217573,219568-219648,219891-219967"),
    "STRG.4.2": ("-", "230172-231784,233047-233179"),
    "STRG.6.2": ("+", "962573-962829,963419-963937"),
    "STRG.7.1": ("+", "520-1746"),
}
LEVELS = {"base": (47.6, 61.8), "exon": (22.0, 64.3), "intron": (21.6, 88.9), "chain": (25.0, 25.0), "transcript": (25.0, 20.0), "locus": (25.0, 20.0)}
LOST = {"missed exon": 27, "novel exon": 1, "missed intron": 28, "novel intron": 0, "missed locus": 0, "novel locus": 1}


def spans(text):
    return [tuple(map(int, x.split("-"))) for x in text.split(",")]


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    gff = ["##gff-version 3"]
    for tid, (gene, name, strand, text) in REFS.items():
        x = spans(text)
        lo, hi = min(a for a, _ in x), max(b for _, b in x)
        gff.append(f"NT\tr\tgene\t{lo}\t{hi}\t.\t{strand}\t.\tID={gene};Name={name};gene={name};note=100%25")
        gff += [f"NT\tr\texon\t{a}\t{b}\t.\t{strand}\t.\tID=x{a};Parent={tid};gene={name}" for a, b in x]
        gff.append(f"NT\tr\tmRNA\t{hi}\t{lo}\t.\t{strand}\t.\tID={tid};Parent={gene};gene={name}")
        gff += [f"NT\tr\tCDS\t{a}\t{b}\t.\t{strand}\t0\tID=c{a};Parent={tid}" for a, b in spans(CODING.get(tid, "0-0")) if b]
    gtf = []
    for tid, (strand, text) in QUERIES.items():
        x, info = spans(text), f'transcript_id "{tid}"; gene_id "{tid[:6]}";'
        gtf.append(f'NT\ts\ttranscript\t{x[0][0]}\t{x[-1][1]}\t1000\t{strand}\t.\t{info} FPKM "2.5";')
        gtf += [f"NT\ts\texon\t{a}\t{b}\t1000\t{strand}\t.\t{info}" for a, b in x]
    (d / "refs.gff").write_text("\n".join(gff) + "\n")
    (d / "query.gtf").write_text("\n".join(gtf) + "\n")
    return d


@pytest.fixture(scope="module")
def sets(spark, files):
    r = annotation.read_transcripts(spark, str(files / "refs.gff"), "ref", reference=True)
    q = annotation.read_transcripts(spark, str(files / "query.gtf"), "qry")
    return q.cache(), r.cache()


def test_assembly(sets):
    q, r = sets
    got = {x.tid: x for x in r.collect()}
    assert {t: (x.gene, x.gene_name, x.strand, [(e.s, e.e) for e in x.exons]) for t, x in got.items()} == {t: (g, n, st, sorted(spans(x))) for t, (g, n, st, x) in REFS.items()}
    assert (got["rna157473"].cs, got["rna157473"].ce, got["rna157474"].cs) == (214121, 219607, None)
    assert {x.tid: (x.gene, x.fpkm, len(x.exons)) for x in q.collect()} == {t: (t[:6], 2.5, len(spans(x))) for t, (_, x) in QUERIES.items()}


def test_levels(sets):
    q, r = sets
    got = {x.level: x for x in compare.accuracy(q.unionByName(r)).collect()}
    assert {k: (round(got[k].sn, 1), round(got[k].pr, 1)) for k in LEVELS} == LEVELS
    assert {k: max(got[k].q_matched, got[k].r_matched) for k in LOST if k in got} | {k: 0 for k in LOST if k not in got} == LOST
    lines = [x.line for x in reports.stats_text(compare.accuracy(q.unionByName(r))).orderBy("n").collect()]
    assert "47.6" in lines[0] and "61.8" in lines[0] and any("27/41" in x for x in lines)


def test_reports(sets):
    c = reports.Comparison(*sets)
    tmap = {x.qry_id: x for x in c.tmap().collect()}
    assert {t: (x.ref_gene_id, x.ref_id, x.class_code, x.num_exons, x.len, x.ref_match_len, x.major_iso_id) for t, x in tmap.items()} == {
        "STRG.1.1": ("gene55473", "rna157470", "m", 3, 1436, 4199, "STRG.1.1"), "STRG.3.1": ("gene55476", "rna157473", "=", 6, 933, 918, "STRG.3.1"),
        "STRG.4.2": ("gene55477", "rna157474", "c", 2, 1746, 2055, "STRG.4.2"), "STRG.6.2": ("gene55581", "rna157497", "j", 2, 776, 768, "STRG.6.2"), "STRG.7.1": ("gene55473", "rna157470", "i", 1, 1227, 4199, "STRG.7.1")}
    assert sorted(tuple(x) for x in c.refmap().collect()) == [("PRSS58", "rna157473", "=", "STRG.3|STRG.3.1"), ("TRY2P", "rna157474", "c", "STRG.4|STRG.4.2")]
    assert [tuple(x)[:4] for x in c.loci_table().orderBy("xloc").collect()] == [
        ("XLOC_000001", "NT[+]403-68627", "gene55473|rna157470", "STRG.1.1"), ("XLOC_000002", "NT[+]520-1746", "-", "STRG.7.1"), ("XLOC_000003", "NT[+]962573-963937", "gene55581|rna157497", "STRG.6.2"),
        ("XLOC_000004", "NT[-]214032-219967", "gene55476|rna157473", "STRG.3.1"), ("XLOC_000005", "NT[-]230172-234148", "gene55477|rna157474", "STRG.4.2")]
    track = [tuple(x) for x in c.tracking().orderBy("tcons").collect()]
    assert track[0] == ("TCONS_00000001|3|1436", "XLOC_000001", "gene55473|rna157470", "m", "q1:STRG.1|STRG.1.1|3|2.500000|0.000000|0.000000|1436")
    assert [x[1:4] for x in track[1:]] == [("XLOC_000002", "gene55473|rna157470", "i"), ("XLOC_000003", "gene55581|rna157497", "j"), ("XLOC_000004", "gene55476|rna157473", "="), ("XLOC_000005", "gene55477|rna157474", "c")]
    lines = [x.line.split("\t") for x in c.annotated().orderBy("tid", "i").collect()]
    assert len(lines) == 5 + 14 and lines[0][2:5] == ["transcript", "403", "10275"] and 'class_code "m"' in lines[0][8]


def test_self_comparison(sets):
    """A set against itself matches at every level, and every code is '='."""
    _, r = sets
    q = r.withColumn("dset", F.lit("qry"))
    got = {x.level: x for x in compare.accuracy(q.unionByName(r)).collect()}
    assert all((got[k].sn, got[k].pr) == (100.0, 100.0) for k in LEVELS) and not set(got) & set(LOST)
    assert {(x.qid == x.rid, x.code) for x in context.class_codes(q, r).collect()} == {(True, "=")}


def tx(spark, rows):
    shape = "dset string, tid long, seq string, strand string, exons array<struct<s:long,e:long>>"
    return spark.createDataFrame([(d, i, "c", st, spans(x)) for d, i, st, x in rows], shape)


def test_codes_of_surroundings(spark):
    t = tx(spark, [
        ("ref", 1, "+", "10000-10200,10500-10700,11000-11200"), ("ref", 2, "-", "50000-50400"), ("ref", 3, "+", "90000-90100,95000-95100"),
        ("qry", 11, "-", "10050-10195,10505-10600"),  # an intron that agrees but for 5 bases: s
        ("qry", 12, "-", "10800-10900"),  # in an intron of the other strand: i
        ("qry", 13, "-", "11150-11400"),  # plain overlap of the other strand: x
        ("qry", 14, "+", "11900-12000"), ("qry", 15, "+", "13199-13300"), ("qry", 16, "+", "13200-13300"),  # runs within 2000 bases: p p u
        ("qry", 17, "-", "48500-48600"), ("qry", 18, ".", "48500-48600"), ("qry", 19, "-", "47999-47999"),  # before a locus on -: p p u
        ("qry", 20, "+", "10000-10200,10500-10700"), ("qry", 21, "+", "500000-500010,500100-500110"),
    ])
    q, r = t.where("dset = 'qry'"), t.where("dset = 'ref'")
    c = reports.exons_of(r)
    m = loci.loci(c)
    table = m.join(loci.locus_table(c, m).select("locus", F.col("s").alias("ls"), F.col("e").alias("le"), "rep"), "locus")
    seq = spark.createDataFrame([("c", 500001, "acgtacgtac"), ("c", 500095, "NNNNNacgtNNNNNNNNNN"), ("x", 1, "aaa")], "seq string, start long, bases string")
    got = {x.qid: (x.code, x.rid) for x in context.class_codes(q, r, table, seq).collect()}
    assert got == {11: ("s", 1), 12: ("i", 1), 13: ("x", 1), 14: ("p", 1), 15: ("p", 1), 16: ("u", None), 17: ("p", 2), 18: ("p", 2), 19: ("u", None), 20: ("c", 1), 21: ("r", None)}


def test_single_exon_matches_by_brute_force(spark):
    """One-to-one matches in order of place, against a loop over all queries."""
    import random

    r = random.Random(4)
    rows = [(r.choice(("qry", "ref")), i, "+", f"{a}-{a + r.randrange(80, 140)}") for i, a in enumerate(r.randrange(1000, 4000) for _ in range(160))]
    by = sorted((spans(x)[0], i, d) for d, i, _, x in rows)
    taken, want = set(), set()
    for (s, e), i, d in by:
        for (s2, e2), j, d2 in by if d == "qry" else []:
            n, m, both = e - s + 1, e2 - s2 + 1, min(e, e2) - max(s, s2) + 1
            if d2 == "ref" and j not in taken and both > 0 and (abs(s - s2) <= 20 and abs(e - e2) <= 20 or both >= 0.8 * max(n, m) or n > m and both >= 0.8 * m and both >= 0.7 * n):
                taken.add(j)
                want.add((i, j))
                break
    got = {(x.qid, x.rid) for x in loci.transcript_matches(tx(spark, rows), 20).collect()}
    assert got == want and len(want) > 20


def test_streaming_mapper(spark, files, tmp_path):
    from chainweave.streaming.mapper import map_batch, map_stream

    t = tx(spark, [("ref", 1, "+", "1000-1200,1500-1700"), ("qry", 2, "+", "1000-1200,1500-1710"), ("qry", 3, "+", "1250-1300"), ("qry", 4, "-", "1000-1100")])
    q, r = t.where("dset = 'qry'"), t.where("dset = 'ref'")
    q.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(q.schema).parquet(str(tmp_path / "in"))
    map_stream(stream, r, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    want = sorted(tuple(x) for x in map_batch(q, r).collect())
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    assert sorted(tuple(x) for x in got.select(*map_batch(q, r).columns).collect()) == want and [x[2] for x in want] == ["=", "i"]


def test_other_readers(spark, tmp_path):
    (tmp_path / "a.tlf").write_text("c\ts\ttranscript\t1\t90\t.\t+\t.\tID=T1;exons=10-20,40-30,x-3;geneID=G\n")
    assert [tuple(x) for x in annotation.read_tlf(spark, str(tmp_path / "a.tlf"), "q").collect()] == [("T1", "G", "q", "c", "+", 10, 20), ("T1", "G", "q", "c", "+", 30, 40)]
    (tmp_path / "a.bed").write_text("c\t5\t9\nc\t9\t40\tB\t0\t-\t9\t40\t0\t2\t5,90,\t0,21,\nc\t9\t3\n")
    assert [tuple(x) for x in annotation.read_bed(spark, str(tmp_path / "a.bed"), "q").collect()] == [("c:5", "c:5", "q", "c", ".", 6, 9), ("B", "B", "q", "c", "-", 10, 40)]
    odd = "c\ts\texon\t1\t9\t.\t+\t.\tParent=A,B\nc\ts\texon\t11\t19\t.\t+\t.\tParent=A\nc\ts\texon\t40\t50\t.\t-\t.\tParent=A\nc\ts\tmRNA\t1\t19\t.\t+\t.\tID=A\nc\ts\tmRNA\t60\t80\t.\t+\t.\tID=N\nc\ts\tprotein_match\t1\t2\t.\t+\t.\tID=Z\nc\ts\texon\t1\t9\t.\t?\t.\tParent=B\n"
    (tmp_path / "a.gff").write_text(odd)
    got = {x.tid: (x.strand, [(e.s, e.e) for e in x.exons]) for x in annotation.read_transcripts(spark, str(tmp_path / "a.gff"), "q").collect()}
    assert got == {"A": ("+", [(1, 19)]), "N": ("+", [(60, 80)])}  # B is one exon of 9 bases that no line names




def test_mapper_reports(spark):
    from chainweave.operators import mapper

    t = tx(spark, [
        ("ref", 1, "+", "1000-1099,1200-1299,1400-1499"), ("ref", 2, "-", "1000-1099,1200-1299,1400-1499"), ("ref", 3, "+", "1000-1099,1150-1299"),
        ("qry", 11, "+", "1050-1099,1200-1299,1450-1459"), ("qry", 12, "-", "1000-1099,1400-1420"), ("qry", 13, "+", "5000-5010,5100-5110"),
    ])
    q, r = t.where("dset = 'qry'"), t.where("dset = 'ref'")
    p = mapper.mapped(q, r).cache()
    got = {(x.qid, x.rid): tuple(x)[1:2] + tuple(x)[3:] for x in mapper.overlap_table(p).collect()}
    assert got[11, 1] == ("j", 53.0, 0.43, "2:1", 3) and got[11, 2][:3] == ("x", None, None) and got[12, 2][0] == "j"
    assert {(x.qid, x.rid) for x in mapper.overlap_table(p, best=True).collect()} == {(11, 1), (12, 2)}
    genes = spark.createDataFrame([(1, "A"), (2, "B"), (3, "A")], "tid long, gene string")
    rows = {x.qid: (x.refs, x.genes, x.junctions) for x in mapper.junction_table(q, p, genes).collect()}
    assert rows[11] == ("j|1|A,j|3|A,x|2|B", "A", "1300-1449:.n") and rows[12][1:] == ("B", "1100-1399:ss") and rows[13] == (".", ".", "5011-5099:nn")
    assert {x.qid: x.refs for x in mapper.simple_table(p).collect()} == {11: "1:53.3,3:60.0", 12: "2:40.3"}
    assert [x.line.split("\t")[0] for x in mapper.text_lines(p).where("qid = 11").orderBy("i").collect()] == [">11 c:1050-1459 + 1050-1099,1200-1299,1450-1459", "j", "j", "x"]
    assert mapper.mapped(r, r, codes="=", self_map=True).count() == 0 and mapper.mapped(q, r, codes="x").count() == 3


def test_sequences(spark, tmp_path):
    from chainweave.sources import fasta

    (tmp_path / "a.fa").write_text("junk\n>c one\nACGTA\nCGTTT\n\n>d\nGGGG\n")
    s = fasta.read_fasta(spark, str(tmp_path / "a.fa"))
    assert sorted(tuple(x) for x in s.collect()) == [("c", 1, "ACGTA"), ("c", 6, "CGTTT"), ("d", 1, "GGGG")]
    got = {x.tid: x.bases for x in fasta.spliced(tx(spark, [("qry", 1, "+", "2-6,9-10"), ("qry", 2, "-", "2-6,9-10")]), s).collect()}
    assert got == {1: "CGTACTT", 2: "AAGTACG"}


def test_strict_levels_by_brute_force(spark):
    """Near ends only, chains counted at each look, against the loop over queries and references in order of place."""
    import random

    r = random.Random(8)
    chains = ["{}-1200,1500-1700,2000-{}", "{}-1200,1500-{}"]
    rows = [(r.choice(("qry", "ref")), i, r.choice("+-"), r.choice(chains).format(1000 + r.choice([0, 5, 30, 30, 60]), 2200 + r.choice([0, 5, 40]))) for i in range(70)]
    rows += [(r.choice(("qry", "ref")), 100 + i, "+", f"{a}-{a + r.randrange(80, 100)}") for i, a in enumerate(r.randrange(5000, 5200) for _ in range(30))]
    exons = {i: spans(x) for _, i, _, x in rows}
    order = lambda i: (exons[i][0][0], exons[i][-1][1], i)
    hits, pairs, near = 0, set(), 20
    for strand in "+-":
        q, ref = (sorted((i for d, i, st, _ in rows if d == k and st == strand), key=order) for k in ("qry", "ref"))
        taken = set()
        for i in q:
            for j in ref:
                a, b = exons[i], exons[j]
                if j in taken or a[-1][1] < b[0][0] or b[-1][1] < a[0][0] or [(x[1], y[0]) for x, y in zip(a, a[1:])] != [(x[1], y[0]) for x, y in zip(b, b[1:])]:
                    continue
                ends = abs(a[0][0] - b[0][0]) <= near and abs(a[-1][1] - b[-1][1]) <= near
                hits += len(a) > 1
                if ends:
                    taken.add(j)
                    pairs.add((i, j))
                    break
    t = tx(spark, rows)
    got, looks = loci.strict_chain_matches(t, near)
    single = loci.single_matches(t, near, strict=True)
    assert {(x.qid, x.rid) for x in got.unionByName(single).collect()} == pairs and looks.agg(F.sum("n")).first()[0] == hits > len(pairs)
    levels = {x.level: x for x in compare.accuracy(t, near, strict=True).collect()}
    assert (levels["chain"].q_matched, levels["transcript"].q_matched, levels["transcript"].r_matched) == (hits, len(pairs), len(pairs))


def test_only_what_meets_counts(spark):
    """References and queries of loci that overlap nothing can be left out of every level."""
    t = tx(spark, [("ref", 1, "+", "1000-1200,1500-1700"), ("ref", 2, "+", "9000-9200,9500-9700"), ("qry", 3, "+", "1000-1200,1500-1700"), ("qry", 4, "+", "5000-5100"), ("qry", 5, ".", "1000-1100")])
    sizes = lambda **how: {x.level: (x.q, x.r, x.q_matched, x.r_matched) for x in compare.accuracy(t, **how).collect()}
    plain, refs, both = sizes(), sizes(met_refs=True), sizes(met_refs=True, met_queries=True)
    assert plain["transcript"] == (3, 2, 1, 1) and plain["missed locus"][3] == 1 and plain["novel locus"][2] == 2
    assert refs["transcript"] == (3, 1, 1, 1) and "missed locus" not in refs and refs["base"][:2] == (604, 402) and refs["intron"] == (1, 1, 1, 1)
    assert both["transcript"] == both["locus"] == both["chain"] == (1, 1, 1, 1) and both["exon"] == (2, 2, 2, 2) and both["base"] == (402, 402, 402, 402)


def test_samples_in_reports(spark, tmp_path):
    """Three samples from text files: duplicates go, equal chains are one row, cells are '-' where a sample has none."""
    line = 'c\ts\texon\t{}\t{}\t.\t{}\t.\ttranscript_id "{}"; gene_id "{}";'
    chain = {"A": [("1000-1200,1500-1700,2000-2200", "a1"), ("1050-1200,1500-1700,2000-2100", "a2"), ("9000-9300", "a3")], "B": [("990-1200,1500-1700,2000-2300", "b1"), ("1100-1200,1500-1600", "b2")], "C": [("9010-9300", "c1"), ("9020-9120", "c2")]}
    for name, rows in chain.items():
        (tmp_path / f"{name}.gtf").write_text("\n".join(line.format(*p, "+", t, f"g{t}") for x, t in rows for p in spans(x)) + "\n")
    (tmp_path / "r.gtf").write_text("\n".join(line.format(*p, "+", "r1", "G") for p in spans("1000-1200,1500-1700,2000-2200")) + "\n")
    q = None
    for name in chain:
        t = annotation.read_transcripts(spark, str(tmp_path / f"{name}.gtf"), name)
        q = t if q is None else q.unionByName(t)
    c = reports.Comparison(q, annotation.read_transcripts(spark, str(tmp_path / "r.gtf"), "ref", reference=True))
    rows = {x.tid: x for x in c.tracking_by_sample().collect()}
    assert {t: (x.xloc, x.ref, x.code, x.n_samples) for t, x in rows.items()} == {"b1": ("XLOC_000001", "G|r1", "=", 2), "b2": ("XLOC_000001", "G|r1", "c", 1), "a3": ("XLOC_000002", "-", "u", 2), "c2": ("XLOC_000002", "-", "u", 1)}
    b1 = rows["b1"]
    assert (b1.q1, b1.q2, b1.q3) == ("q1:ga1|a1|3|0.000000|0.000000|0.000000|603", "q2:gb1|b1|3|0.000000|0.000000|0.000000|713", "-") and b1.tcons == "TCONS_00000001|3|713"
    assert [rows["a3"][f"q{k}"].split("|")[1:3] if rows["a3"][f"q{k}"] != "-" else "-" for k in (1, 2, 3)] == [["a3", "1"], "-", ["c1", "1"]]
    assert sorted(tuple(x) for x in c.loci_by_sample().collect()) == [("XLOC_000001", "c[+]990-2300", "G|r1", "a1,a2", "b1,b2", "-"), ("XLOC_000002", "c[+]9000-9300", "-", "a3", "-", "c1,c2")]
    both = {x.tid: (x.contained, x.redundant, x.tss_id) for x in c.combined(keep=False).collect()}
    assert both == {"b1": (None, False, 1), "b2": ("chain", True, 2), "a3": (None, False, 3), "c2": ("single", True, 3)}


def test_streaming_assembly(spark, tmp_path):
    """Lines of one transcript over several batches and a restart give the transcripts of one read."""
    import random

    from chainweave.streaming.assembly import assemble_stream, latest

    lines = []
    for tid, (strand, text) in QUERIES.items():
        info = f'transcript_id "{tid}"; gene_id "{tid[:6]}";'
        lines.append(f"NT\ts\ttranscript\t{spans(text)[0][0]}\t{spans(text)[-1][1]}\t.\t{strand}\t.\t{info} FPKM \"1.5\";")
        lines += [f"NT\ts\texon\t{a}\t{b}\t.\t{strand}\t.\t{info}" for a, b in spans(text)]
    random.Random(1).shuffle(lines)
    (tmp_path / "in").mkdir()
    paths = str(tmp_path / "out"), str(tmp_path / "check")
    for k in range(3):  # each start goes on from the checkpoint
        for part in range(2):
            (tmp_path / "in" / f"{k}{part}.gtf").write_text("\n".join(lines[2 * k + part :: 6]) + "\n")
        stream = spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / "in"))
        assemble_stream(stream, "q", *paths).awaitTermination()
    (tmp_path / "all.gtf").write_text("\n".join(lines) + "\n")
    want = annotation.read_transcripts(spark, str(tmp_path / "all.gtf"), "q")
    got = latest(spark, paths[0]).select(*want.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count() == len(QUERIES)
    assert spark.read.parquet(paths[0]).count() > len(QUERIES)

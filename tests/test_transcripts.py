import random

import duckdb
import pytest
from pyspark.sql import functions as F

from chainweave.operators import classify
from chainweave.operators.components import connected_components
from chainweave.operators.intervals import islands, range_join
from chainweave.plans import catalog
from chainweave.sources.annotation import read_bed, read_gtf

SF = "/root/testdata/sf0.001"
A, S = "1000-1200, 1500-1700, 2000-2200", "1000-1200"
CODES = [
    ("950-1200, 1500-1700, 2000-2300", A, "="), ("1050-1200, 1500-1650", A, "c"), ("600-700, 1000-1200, 1500-1700, 2000-2200, 2500-2600", A, "k"),
    ("1000-1700, 2000-2200", A, "m"), ("1000-1800, 2000-2200", A, "n"), ("1000-1200, 1550-1700, 2000-2200", A, "j"), ("1100-1190, 1510-1600", A, "o"),
    ("1050-1150", A, "c"), ("1150-2100", A, "m"), ("1150-1600", A, "n"), ("1250-1400", A, "i"), ("1100-1300", A, "e"), ("2195-2400", A, "o"),
    ("1250-1300, 1400-1450", A, "i"), ("1000-1205", S, "="), ("1000-1100", S, "c"), ("900-1400", S, "k"), ("1150-1400", S, "o"),
    ("990-1300, 1500-1600", S, "k"), ("500-900, 1300-1500", S, "y"), ("1100-1300, 1500-1600", S, "o"), ("800-850, 1250-1450, 1750-1950, 2300-2400", A, "y"),
    ("500-600, 1050-1900", A, "n"), ("1050-1200, 1500-1703", A, "c"), ("1050-1200, 1500-1704", A, "j"), ("1300-1450, 1750-1900", A, "i"),
]


def chain(text):
    return [tuple(map(int, x.split("-"))) for x in text.split(", ")]


TIES = [  # query, references, the better one
    # both j: the first shares three sites and 303 bases, the second one site and 602 bases
    ("1000-1200, 1500-1700, 2000-2200", ["1100-1200, 1500-1700, 2100-2200", "1000-1200, 1490-1710, 1990-2200"], 0),
    # both e, equal bases: 2 exons are nearer to 1 than 3 are
    ("1100-1300", ["900-1200, 1600-1700, 1900-2000", "900-1200, 1600-1700"], 1),
    # both i, no bases: more exons
    ("1250-1300", ["1000-1200, 1500-1700", "1000-1200, 1500-1700, 2000-2200"], 1),
    # both o: the single-exon reference, though it shares fewer bases
    ("1150-1400", ["1300-1500, 1600-1700", "1000-1200"], 1),
]


def structs(spark, rows):
    """Transcripts of (id, exons as text, strand) on one sequence, in the struct form."""
    t = spark.createDataFrame([(i, "a", st, chain(x)) for i, x, st in rows], "tid long, seq string, strand string, exons array<struct<s:long,e:long>>")
    return classify.prepared(t).select("t.id", "t")


def coded(spark, pairs, **how):
    """Codes, shared bases and junctions of (query, reference) chains."""
    q = structs(spark, [(i, p[0], "+") for i, p in enumerate(pairs)]).withColumnRenamed("t", "q")
    r = structs(spark, [(i, p[1], "+") for i, p in enumerate(pairs)]).withColumnRenamed("t", "r")
    return [(x.code, x.ovlen, x.njm) for x in classify.pair_codes(q.join(r, "id"), **how).orderBy("id").collect()]


def test_common_splice_sites(spark):
    q = "1000-1200, 1500-1700, 2000-2200"
    refs = [("1000-1200, 1500-1700, 2000-2200", 4), ("1000-1200, 1490-1700, 2000-2200", 3), ("1000-1200, 1490-1710, 1990-2200", 1), ("1000-1200, 2000-2200", 2), ("1000-2200", 0)]
    assert [x[2] for x in coded(spark, [(q, r) for r, _ in refs])] == [n for _, n in refs]
    assert [x[2] for x in coded(spark, [(r, q) for r, _ in refs])] == [n for _, n in refs]


@pytest.mark.parametrize("query,refs,best", TIES)
def test_best_reference(spark, query, refs, best):
    q = structs(spark, [(1, query, "+")]).select(F.col("t").alias("q"))
    r = structs(spark, [(i, x, "+") for i, x in enumerate(refs)]).select(F.col("t").alias("r"))
    rows = classify.with_codes(q.crossJoin(r)).cache()
    (got,) = classify.best_codes(rows).collect()
    assert (len({x["rank"] for x in rows.collect()}), got.rid) == (1, best)


def test_codes(spark):
    assert [x[0] for x in coded(spark, [(q, r) for q, r, _ in CODES])] == [c for _, _, c in CODES]
    assert coded(spark, [("1-5", "6-9")])[0][0] is None


def test_shared_bases_of_chains_apart(spark):
    """Only the exons between two chains count, though another one overlaps too."""
    q, r = "1201-1206, 1268-1277", "1000-1035, 1092-1172, 1201-1277"
    assert coded(spark, [(q, r)]) == [("o", 6, 0)]


def test_strict_and_coding_codes(spark):
    pairs = [(A, A), ("1001-1200, 1500-1700, 2000-2201", A), ("1002-1200, 1500-1700, 2000-2200", A), ("1000-1201", S), ("1000-1205", S)]
    assert [x[0] for x in coded(spark, pairs, strict=True)] == ["=", "=", "~", "=", "~"]
    q = structs(spark, [(0, A, "+"), (1, "1010-1200, 1500-1700, 2000-2200", "+")]).withColumn("q", F.col("t").withField("cs", F.lit(1100).cast("long"))).drop("t")
    r = structs(spark, [(0, A, "+"), (1, A, "+")]).withColumnRenamed("t", "r")
    assert [x.code for x in classify.pair_codes(q.join(r, "id"), strict=True, cds=True).orderBy("id").collect()] == [":", "_"]


def test_codes_of_random_chains(spark):
    """Swapping both sides swaps c and k of chains; a chain is equal to itself; and SQL over exploded introns agrees on the tables."""
    r = random.Random(2)
    pairs = []
    for _ in range(400):
        at, x = 1000, []
        for _ in range(r.randrange(2, 6)):
            x.append((at, at + r.randrange(20, 90)))
            at = x[-1][1] + r.randrange(10, 90)
        cut = x[r.randrange(len(x) - 1) :] if r.random() < 0.5 else x[: r.randrange(2, len(x) + 1)]
        pairs.append((x, cut if len(cut) > 1 else x))
    text = lambda c: ", ".join(f"{s}-{e}" for s, e in c)
    there = coded(spark, [(text(a), text(b)) for a, b in pairs])
    back = coded(spark, [(text(b), text(a)) for a, b in pairs])
    assert [{"c": "k", "k": "c"}.get(x[0], x[0]) for x in there] == [x[0] for x in back] and [x[1:] for x in there] == [x[1:] for x in back]
    assert {x[0] for x in there} == {"k", "="} and all((x[0] == "=") == (a == b) for x, (a, b) in zip(there, pairs, strict=True))


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    rows = con.sql(catalog.SQL[name]).project(", ".join(cols)).fetchall()
    assert sorted(map(repr, map(tuple, got.select(*cols).collect()))) == sorted(map(repr, rows))


def test_islands_and_pairs_by_brute_force(spark):
    rows = [("a", s, s + n) for s, n in [(1, 5), (3, 9), (13, 2), (100, 3000), (2500, 10), (5000, 1)]]
    df = spark.createDataFrame(rows, "seq string, s long, e long")
    assert sorted(tuple(r) for r in islands(df, ["seq"]).select("s", "e").collect()) == [(1, 12), (13, 15), (100, 3100), (5000, 5001)]
    pairs = range_join(df, df.withColumnsRenamed({"s": "s2", "e": "e2"}), ["seq"])
    want = sorted((a[1], b[1]) for a in rows for b in rows if a[1] <= b[2] and a[2] >= b[1])
    assert sorted((r.s, r.s2) for r in pairs.collect()) == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 100: 100, 101: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_readers(spark, tmp_path):
    (tmp_path / "a.gtf").write_text('#x\nchr1\ts\texon\t20\t10\t.\t+\t.\ttranscript_id "T"; gene_id "G";\nchr1\ts\texon\tx\t10\t.\t+\t.\ttranscript_id "T";\nshort\n')
    (tmp_path / "a.bed").write_text("chr1\t9\t40\tB\t0\t-\t9\t40\t0\t2\t5,10,\t0,21,\n")
    assert [tuple(r) for r in read_gtf(spark, str(tmp_path / "a.gtf"), "q").collect()] == [("T", "G", "q", "chr1", "+", 10, 20)]
    assert sorted((r.s, r.e) for r in read_bed(spark, str(tmp_path / "a.bed"), "q").collect()) == [(10, 14), (31, 40)]


def test_functions_in_sql(spark):
    """Codes by SQL text are those of the operator, and the other functions agree with plain Python."""
    from chainweave.functions.registered import register

    assert set(register(spark)) >= {"class_code", "sub_chain"}
    rows = [(i, chain(q), chain(r)) for i, (q, r, _) in enumerate(CODES)]
    spark.createDataFrame(rows, "i long, q array<struct<s:long,e:long>>, r array<struct<s:long,e:long>>").createOrReplaceTempView("chain_pairs")
    got = spark.sql("select i, class_code(q, r) as code, strict_class_code(q, r) as strict, sub_chain(q, r) as sub, shared_bases(q, r) as n, covered(q) as len, size(introns_of(q)) as m from chain_pairs order by i").collect()
    assert [x.code for x in got] == [c for _, _, c in CODES]
    assert [x.strict for x in got] == [x[0] for x in coded(spark, [(q, r) for q, r, _ in CODES], strict=True)]
    for x, (_, q, r) in zip(got, rows):
        gaps = lambda c: [(a[1] + 1, b[0] - 1) for a, b in zip(c, c[1:])]
        at = next((i for i in range(len(r) - len(q) + 1) if len(q) > 1 and gaps(r)[i : i + len(q) - 1] == gaps(q)), None)
        assert x.sub == (at is not None and q[0][0] >= r[at][0] and q[-1][1] <= r[at + len(q) - 1][1])
        assert (x.n, x.len, x.m) == (sum(max(0, min(a[1], b[1]) - max(a[0], b[0]) + 1) for a in q for b in r), sum(b - a + 1 for a, b in q), len(q) - 1)
    assert spark.sql("select class_code(array(named_struct('s', 1L, 'e', 5L)), array(named_struct('s', 9L, 'e', 15L)))").first()[0] is None

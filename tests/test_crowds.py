"""Crowded places: equal transcripts are told once, and what is told is the same as from all pairs."""

import random

import pytest

from chainweave.operators import classify, context

SCHEMA = "tid long, seq string, strand string, exons array<struct<s:long,e:long>>, cs long, ce long"
PLAIN = ["tid", "seq", "strand", "exons"]


def crowd(seed, n, first=0):
    """Transcripts of two places that share exons, many of them equal or parts of others."""
    r, out = random.Random(seed), []
    for tid in range(first, first + n):
        at, k = r.choice([0, 400, 90, 9000 + 140 * r.randrange(30)]), r.randrange(0, 4)
        exons = [(at + 300 * i + 1000 + r.choice([0, 0, 3, 20]), at + 300 * i + 1150 + r.choice([0, 0, 3, 15])) for i in range(k, k + r.randrange(1, 6))]
        coding = r.choice([(None, None), (exons[0][0], exons[-1][1])])
        out.append((tid, "c", r.choice("+-."), exons, *coding))
    return out


def counted(monkeypatch):
    """The numbers of pairs that are held against each other exon by exon."""
    seen, own = [], classify.pair_codes

    def count(pairs, **how):
        seen.append(pairs.count())
        return own(pairs, **how)

    monkeypatch.setattr(classify, "pair_codes", count)
    return seen


def copies(spark, chain, n, first=0, step=1, strand="+"):
    return spark.createDataFrame([(first + step * i, "c", strand, chain) for i in range(n)], "tid long, seq string, strand string, exons array<struct<s:long,e:long>>")


@pytest.mark.parametrize("any_strand", [False, True])
def test_best_matches_are_those_of_all_pairs(spark, any_strand):
    from chainweave.operators.best import COLUMNS, best_matches

    q, r = (spark.createDataFrame(crowd(k, 250, 1000 * k), SCHEMA).cache() for k in (0, 1))
    r = r.where("tid % 3 > 0")
    want = classify.best_codes(classify.with_codes(context.span_pairs(q, r, any_strand))).select(*COLUMNS).collect()
    got = best_matches(q, r, any_strand).select(*COLUMNS).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert {"=", "c", "k", "j"} < {x.code for x in got}


def test_class_codes_hold_equal_transcripts_once(spark, monkeypatch):
    chain, part = [(1000, 1100), (1300, 1400), (1700, 1800)], [(1020, 1100), (1300, 1380)]
    q = copies(spark, chain, 600).unionByName(copies(spark, part, 600, 5000)).unionByName(copies(spark, [(1000, 1390)], 600, 9000))
    r = copies(spark, chain, 700, 20000)
    seen = counted(monkeypatch)
    got = context.class_codes(q, r).collect()
    assert sum(seen) < 1000
    assert len(got) == 1800 and {(x.code, x.rid, x.qid // 4000) for x in got} == {("=", 20000, 0), ("c", 20000, 1), ("n", 20000, 2)}



def test_met_by_counts_without_pairs(spark):
    from chainweave.operators.intervals import met_by

    r = random.Random(3)
    a, b = ([("c", s, s + r.choice([0, 3, 40, 900])) for s in (r.randrange(5, 4000, 7) for _ in range(n))] for n in (120, 150))
    t, u = (spark.createDataFrame(x, "seq string, s long, e long") for x in (a, b))
    for piece in (64, 1 << 16):
        got = {(x.s, x.e): (x.m, x.n, x.bases) for x in met_by(t, u, ["seq"], piece).collect()}
        both = {(s, e): [min(e, f) - max(s, d) + 1 for _, d, f in b if s <= f and e >= d] for _, s, e in a}
        assert got == {k: (a.count(("c", *k)), len(v), sum(v)) for k, v in both.items() if v}
    twice = met_by(t.withColumn("copies", t.s * 0 + 2), u, ["seq"]).collect()
    assert {(x.s, x.e): x.m for x in twice} == {k: 2 * v[0] for k, v in got.items()}


def test_span_counts_make_no_pairs(spark, monkeypatch):
    from chainweave.plans import catalog, relations

    sf = "/root/testdata/sf0.001"
    want = {x: sorted(map(tuple, catalog.QUERIES[x](spark, sf).collect())) for x in ("overlap_pairs", "self_overlap", "queries_overlapping")}
    t = catalog.tx_summary(spark, sf).collect()
    q, r = ([x for x in t if x.dset == d] for d in ("qry", "ref"))
    meet = lambda x, y: x.seq == y.seq and x.strand == y.strand and x.s <= y.e and x.e >= y.s
    n = {x.tid: sum(meet(x, y) for y in r) for x in q}
    assert want["queries_overlapping"] == sorted((k, v) for k, v in n.items() if v)
    assert sum(x[2] for x in want["self_overlap"]) == sum(meet(x, y) and x.tid != y.tid for x in r for y in r)
    assert sum(x[2] for x in want["overlap_pairs"]) == sum(n.values())
    for module in (catalog, relations):
        monkeypatch.setattr(module, "range_join", None, raising=False)
    for x, rows in want.items():
        assert sorted(map(tuple, catalog.QUERIES[x](spark, sf).collect())) == rows


def test_containers_count_equal_transcripts_once(spark):
    from chainweave.operators.best import containers

    rows = crowd(4, 300) + [(tid + 1000, *x) for tid, *x in crowd(4, 300)]
    x = [(t, s, e, tuple((a[1], b[0]) for a, b in zip(e, e[1:]))) for t, _, s, e, _, _ in rows]

    def holds(q, r):
        n, c, d = len(q[3]), q[3], r[3]
        at = next((i for i in range(len(d) - n + 1) if d[i : i + n] == c), None)
        return q[1] == r[1] and 0 < n < len(d) and at is not None and q[2][0][0] >= r[2][at][0] and q[2][-1][1] <= r[2][at + n][1]

    want = {q[0]: n for q in x if (n := sum(holds(q, r) for r in x))}
    got = {y.tid: y.n_containers for y in containers(spark.createDataFrame(rows, SCHEMA).select(*PLAIN)).collect()}
    assert got == want and max(got.values()) > 2


def test_cross_strand_counts(spark, monkeypatch):
    monkeypatch.setattr(context, "BLOCK", 16)
    monkeypatch.setattr(context, "span_pairs", None)  # no pair is made
    q, r = crowd(5, 150), crowd(6, 150, 1000)
    # introns of 6 bases that agree but for 10, in transcripts that don't overlap
    q.append((900, "c", "+", [(50100, 50100), (50107, 50107)], None, None))
    r.append((1900, "c", "-", [(50090, 50092), (50098, 50099)], None, None))
    gaps = lambda x: [(a[1], b[0]) for a, b in zip(x[3], x[3][1:])]
    want = {}
    for a in q:
        for b in r:
            if {a[2], b[2]} == {"+", "-"} and a[3][0][0] <= b[3][-1][1] and a[3][-1][1] >= b[3][0][0]:
                w = want.setdefault(a[2], [0, 0, 0])
                w[0] += 1
                w[1] += any(abs(x[0] - y[0]) <= 10 and abs(x[1] - y[1]) <= 10 for x in gaps(a) for y in gaps(b))
                w[2] += any(a[3][0][0] > y[0] and a[3][-1][1] < y[1] for y in gaps(b))
    got = context.cross_strand_counts(*(spark.createDataFrame(x, SCHEMA).select(*PLAIN) for x in (q, r))).collect()
    assert {x.strand: [x.pairs, x.shadows, x.inside] for x in got} == want


def test_codes_of_the_other_strand_by_loops(spark):
    q, r = crowd(7, 120), [(tid, seq, strand, x, cs, ce) for tid, seq, strand, x, cs, ce in crowd(8, 40, 1000)]
    q += [(500 + i, "c", "+-"[i % 2], [(1170 + i, 1280)], None, None) for i in range(12)]
    locus = {b[0]: b[0] % 5 if b[2] == "+" else 10 + b[0] % 5 for b in r}
    had = {a[0]: "uimyn="[a[0] % 6] for a in q}
    # equal transcripts have one code and one locus
    for rows, of, key in ((q, had, lambda a: (a[2], tuple(a[3]), a[4])), (r, locus, lambda a: (a[2], tuple(a[3])))):
        first = {}
        for a in rows:
            of[a[0]] = first.setdefault(key(a), of[a[0]])
    gaps = lambda x: [(a[1], b[0]) for a, b in zip(x, x[1:])]
    size = lambda x: sum(b - a + 1 for a, b in x)
    want = []
    for a in q:
        if a[2] == "." or had[a[0]] == "=":
            continue
        s, e, x = a[3][0][0], a[3][-1][1], a[3]
        for lo in set(locus.values()):
            met = [b for b in r if {a[2], b[2]} == {"+", "-"} and locus[b[0]] == lo and s <= b[3][-1][1] and e >= b[3][0][0]]
            bases = {b[0]: sum(max(0, min(v[1], w[1]) - max(v[0], w[0]) + 1) for v in x for w in b[3]) for b in met}
            longest = lambda some: min(some, key=lambda b: (-size(b[3]), b[0]), default=None)
            sh = longest([b for b in met if any(abs(v[0] - w[0]) <= 10 and abs(v[1] - w[1]) <= 10 for v in gaps(x) for w in gaps(b[3]))])
            ins = longest([b for b in met if had[a[0]] != "i" and any(s > w[0] and e < w[1] for w in gaps(b[3]))])
            want += [(a[0], c, b[0]) for c, b in (("s", sh), ("i", ins)) if b]
            if met and not sh and not ins:
                on = [b for b in met if bases[b[0]]]
                want.append((a[0], "x", (min(on, key=lambda b: (-bases[b[0]], b[0])) if on else longest(met))[0]))
    t, u = (spark.createDataFrame(x, SCHEMA).select(*PLAIN) for x in (q, r))
    loci, best = spark.createDataFrame(list(locus.items()), "tid long, locus long"), spark.createDataFrame(list(had.items()), "qid long, code string")
    got = [(x.qid, x.code, x.rid) for x in context.cross_strand(t, u, loci, best).collect()]
    assert sorted(got) == sorted(want) and {x[1] for x in got} == set("six")


def test_loci_and_strands_hold_equal_transcripts_once(spark, monkeypatch):
    from chainweave.operators import loci as lc

    rows = crowd(9, 200)
    t = spark.createDataFrame(rows, SCHEMA).select("tid", "seq", "strand", "exons").selectExpr("*", "if(tid % 2 = 1, 'qry', 'ref') as dset").cache()
    parent = {x[0]: x[0] for x in rows}

    def top(x):
        return x if parent[x] == x else top(parent[x])

    for a in rows:
        for b in rows:
            if a[2] == b[2] and (a[0] - b[0]) % 2 == 0 and any(v[0] <= w[1] and v[1] >= w[0] for v in a[3] for w in b[3]):
                x, y = sorted((top(a[0]), top(b[0])))
                parent[y] = x
    _, some, every = lc.loci_of(t)
    assert {x.tid: x.locus for x in every.collect()} == {x: top(x) for x in parent} and some.count() < len(rows)
    chain = [(1000, 1100), (1300, 1400), (1700, 1800)]
    q, r = copies(spark, chain, 600, strand="."), copies(spark, chain, 700, 20000, strand="-")
    seen = counted(monkeypatch)
    assert {tuple(x)[1] for x in context.assigned_strands(q, r).collect()} == {"-"} and sum(seen) < 1000


def test_contained_and_equal_queries_are_listed(spark):
    from chainweave.operators.best import equal_or_contained

    q, r = (spark.createDataFrame(crowd(k, 200, 1000 * k), SCHEMA).cache() for k in (11, 12))
    rows = context.candidates(q, r).cache()
    best = classify.best_codes(rows).where("code = '='")
    want = best.select("rid", "code", "qid").unionByName(rows.where("code = 'c'").join(best.select("qid"), "qid", "left_anti").select("rid", "code", "qid"))
    got = sorted(map(tuple, equal_or_contained(q, r).select("rid", "code", "qid").collect()))
    assert got == sorted(map(tuple, want.collect())) and {x[1] for x in got} == {"=", "c"}

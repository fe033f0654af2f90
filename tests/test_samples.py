"""Samples held against loops over random transcripts."""

import itertools
import random

import pytest

from chainweave.operators import loci, samples
from chainweave.operators.intervals import WIDTHS, range_join

SCHEMA = "sample long, tid long, seq string, strand string, exons array<struct<s:long,e:long>>"


def rows_of(seed, n=140):
    r, out = random.Random(seed), []
    chains = [sorted(r.sample(range(100, 3000, 50), 2 * r.randrange(2, 5))) for _ in range(6)]
    for tid in range(1, n + 1):
        strand = r.choice("+-.")
        if r.random() < 0.5:
            s = r.randrange(100, 900, 7)
            exons = [(s, s + r.randrange(60, 130, 5))]
        else:
            c = r.choice(chains)
            k = 2 * r.randrange(0, len(c) // 2 - 1)
            c = c[k : r.randrange(k + 4, len(c) + 1, 2) if k + 4 < len(c) else len(c)]
            exons = [(a, b) for a, b in zip(c[::2], c[1::2])]
            exons[0] = (exons[0][0] - r.choice([0, 0, 10, 40, 70]), exons[0][1])
            exons[-1] = (exons[-1][0], exons[-1][1] + r.choice([0, 0, 10, 40, 70]))
        out.append((tid % 3, tid, "c", strand, exons))
    return out


def introns(x):
    return tuple((a[1] + 1, b[0] - 1) for a, b in zip(x, x[1:]))


def size(x):
    return sum(b - a + 1 for a, b in x)


def single(q, r):
    (a, b), (c, d) = q, r
    both, n, m = min(b, d) - max(a, c) + 1, b - a + 1, d - c + 1
    return both > 0 and (q == r or both >= 0.8 * max(n, m) or n > m and both >= 0.8 * m and both >= 0.7 * n)


@pytest.fixture(scope="module", params=[1, 2])
def case(spark, request):
    rows = rows_of(request.param)
    return rows, spark.createDataFrame(rows, SCHEMA).cache()


@pytest.mark.parametrize("contain", [False, True])
def test_duplicates(case, contain):
    rows, t = case
    into, key = {}, lambda r: (r[4][0][0], r[4][-1][1], r[1])
    for g in {(r[0], r[3]) for r in rows}:
        kept, lost = [], {}
        for m in sorted((r for r in rows if (r[0], r[3]) == g and len(r[4]) == 1), key=key):
            hit = [k for k in kept if single(m[4][0], k[4][0]) and (not contain or k[4][0][0] <= m[4][0][0] and k[4][0][1] >= m[4][0][1])]
            if hit and size(hit[-1][4]) >= size(m[4]):
                lost[m[1]] = hit[-1][1]
                continue
            if hit:
                kept.remove(hit[-1])
                lost[hit[-1][1]] = m[1]
            kept.append(m)
        for m in (r for r in rows if (r[0], r[3]) == g and len(r[4]) == 1):
            at = m[1]
            while at in lost:
                at = lost[at]
            into[m[1]] = at
    got = {r.tid: r["into"] for r in samples.deduplicated(t, contain).collect()}
    assert {k: v for k, v in got.items() if k in into} == into and set(got) == {r[1] for r in rows}
    for r in (r for r in rows if len(r[4]) > 1):
        same = [o for o in rows if o[0] == r[0] and o[3] == r[3] and introns(o[4]) == introns(r[4])]
        if contain:
            inside = [o for o in same if o[4][0][0] <= r[4][0][0] and o[4][-1][1] >= r[4][-1][1]]
            assert got[r[1]] in {o[1] for o in inside} and got[got[r[1]]] == got[r[1]]
            spans = {(o[4][0][0], o[4][-1][1]) for o in inside}
            assert (got[r[1]] == r[1]) == (len(spans) == 1 and r[1] == min(o[1] for o in inside))
        else:
            assert got[r[1]] == min(same, key=lambda o: (-size(o[4]), o[1]))[1]


def test_equivalents_and_cells(spark, case):
    rows, t = case
    links = {r[1]: {r[1]} for r in rows}
    for q in rows:
        if len(q[4]) > 1:
            links[q[1]] |= {o[1] for o in rows if o[3] == q[3] and introns(o[4]) == introns(q[4])}
            continue
        for later in range(q[0] + 1, 3):
            hits = [o for o in rows if o[0] == later and o[3] == q[3] and len(o[4]) == 1 and single(q[4][0], o[4][0])]
            if hits:
                (a, b) = q[4][0]
                best = max(hits, key=lambda o: (min(b, o[4][0][1]) - max(a, o[4][0][0]) + 1 - abs(a - o[4][0][0]) - abs(b - o[4][0][1]), -o[4][0][0], -o[4][0][1], -o[1]))
                links[q[1]].add(best[1])
                links[best[1]].add(q[1])
    heads = {}
    for i in sorted(links):
        todo = [i]
        while todo:
            x = todo.pop()
            if x not in heads:
                heads[x] = i
                todo += links[x]
    found = samples.equivalents(t)
    assert {r.tid: r.head for r in found.collect()} == heads
    codes = spark.createDataFrame([(r[1], 7, "=" if r[1] % 2 else "j") for r in rows], "qid long, rid long, code string")
    out = {r.head: r for r in samples.tracked(t, found, codes, [0, 1, 2]).collect()}
    for head, group in itertools.groupby(sorted(rows, key=lambda r: heads[r[1]]), key=lambda r: heads[r[1]]):
        group = list(group)
        for k in range(3):
            cell = ",".join(f"{r[1]}|{len(r[4])}|{size(r[4])}" for r in sorted(group, key=lambda r: r[1]) if r[0] == k) or "-"
            assert out[head][f"q{k + 1}"] == cell
        assert out[head].n_samples == len({r[0] for r in group})
        assert out[head].tid == min(group, key=lambda r: (-size(r[4]), r[0], r[1]))[1]


@pytest.mark.parametrize("how", [{}, {"poke": 50}, {"tss": 30}, {"tss": 30, "poke": 50}, {"in_exon": True}])
def test_contained(case, how):
    rows, t = case

    def holds(a, b):
        """Whether a holds b."""
        x, y, ca, cb = a[4], b[4], introns(a[4]), introns(b[4])
        if a[1] == b[1] or a[3] != b[3] or x[-1][1] < y[0][0] or y[-1][1] < x[0][0]:
            return False
        later = (size(x), x[0][0], x[-1][1], a[1]) > (size(y), y[0][0], y[-1][1], b[1])
        if len(x) == len(y) == 1:
            return later and min(x[0][1], y[0][1]) - max(x[0][0], y[0][0]) + 1 >= 0.85 * size(y)
        if len(x) == len(y):
            return ca == cb and later
        if len(y) == 1:
            return bool(how.get("in_exon")) and any(s <= y[0][0] and y[0][1] <= e for s, e in x)
        at = next((i for i in range(len(ca) - len(cb) + 1) if ca[i : i + len(cb)] == cb), None)
        if len(y) > len(x) or at is None:
            return False
        poke, n = how.get("poke", 0), len(cb)
        if at > 0 and y[0][0] + poke < x[at][0] or at + n < len(ca) and y[-1][1] > x[at + n][1] + poke:
            return False
        if "tss" in how:
            if (at > 0) if a[3] == "+" else (at + n < len(ca)):
                return False
            if abs(x[0][0] - y[0][0] if a[3] == "+" else x[-1][1] - y[-1][1]) > how["tss"]:
                return False
        return bool(poke) or y[0][0] >= x[0][0] and y[-1][1] <= x[-1][1]

    want = {b[1] for b in rows if any(holds(a, b) for a in rows)}
    assert {r.tid for r in samples.contained(t, **how).collect()} == want


@pytest.mark.parametrize("reach", [0, 40, 150])
def test_start_clusters(spark, reach):
    r = random.Random(reach)
    rows = [(i, i % 4, "c", "+-.+"[i % 4], s, s + r.randrange(20, 400)) for i, s in enumerate(r.randrange(1, 1500) for _ in range(160))]
    want = {}
    for locus in range(4):
        cl = []
        for i, _, _, strand, s, e in sorted((x for x in rows if x[1] == locus), key=lambda x: (x[4], x[5], x[0])):
            five = e if strand == "-" else s
            hit = [c for c in cl if c["s"] <= e and c["e"] >= s and abs(c["f"] - five) <= reach]
            new = {"f": (max if strand == "-" else min)([five] + [c["f"] for c in hit]), "s": min([s] + [c["s"] for c in hit]), "e": max([e] + [c["e"] for c in hit]), "m": [i] + [m for c in hit for m in c["m"]]}
            cl = [c for c in cl if c not in hit] + [new]
        want |= {m: min(c["m"]) for c in cl for m in c["m"]}
    t = spark.createDataFrame(rows, "tid long, locus long, seq string, strand string, s long, e long")
    assert {x.tid: x.tss for x in samples.start_clusters(t, reach).collect()} == want


def test_empty(spark):
    t = spark.createDataFrame([], SCHEMA)
    assert samples.deduplicated(t).count() == samples.equivalents(t).count() == samples.contained(t, in_exon=True).count() == 0
    assert samples.start_clusters(spark.createDataFrame([], "tid long, locus long, seq string, strand string, s long, e long")).count() == 0


def test_pile_of_single_exons(spark):
    """Thousands of equal single exons on both sides, and near ones that push each other on."""
    rows = [(i, d, "c", "+", [(1000, 1200)]) for d, n in (("qry", 0), ("ref", 10_000)) for i in range(n, n + 5000)]
    rows += [(i, d, "c", "+", [(5000 + i % 300, 5500 + i % 300)]) for d, n in (("qry", 20_000), ("ref", 30_000)) for i in range(n, n + 300)]
    t = spark.createDataFrame(rows, "tid long, dset string, seq string, strand string, exons array<struct<s:long,e:long>>")
    got = {(r.qid, r.rid) for r in loci.single_matches(t).collect()}
    assert {x for x in got if x[0] < 10_000} == {(i, 10_000 + i) for i in range(5000)}
    place = {i: (x[0][0], x[0][1], i) for i, _, _, _, x in rows}
    taken, want = set(), set()
    for q in sorted((i for i in place if 20_000 <= i < 30_000), key=place.get):
        for r in sorted((i for i in place if i >= 30_000), key=place.get):
            if r not in taken and (abs(place[q][0] - place[r][0]) <= 100 or single(place[q][:2], place[r][:2])):
                taken.add(r)
                want.add((q, r))
                break
    assert {x for x in got if x[0] >= 20_000} == want


@pytest.mark.parametrize("lengths", [(50, 50), (50, 5000), (40_000, 50), (3_000_000, 300)])
def test_range_join_at_other_widths(spark, lengths):
    r = random.Random(7)
    a, b = ([(s, s + r.randrange(n)) for s in (r.randrange(200_000) for _ in range(150))] for n in lengths)
    left = spark.createDataFrame([("c", *x) for x in a], "seq string, s long, e long")
    right = spark.createDataFrame([("c", *x) for x in b], "seq string, s2 long, e2 long")
    got = sorted((x.s, x.e, x.s2, x.e2) for x in range_join(left, right, ["seq"]).collect())
    assert got == sorted((*x, *y) for x in a for y in b if x[0] <= y[1] and x[1] >= y[0])
    assert WIDTHS[0] == 1024 and range_join(left.limit(0), right, ["seq"]).count() == range_join(left, right.limit(0), ["seq"]).count() == 0

"""Source audit, personal data and token alignment held against plain Python."""

import collections
import hashlib
import random
import re

import duckdb
import pytest

from chainweave.llm import pii, source_audit, token_alignment

SCHEMA = "doc_id long, text string, lang string, source string, Source_ string, term string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_like_sql(spark, name, query, sql, rows, tmp_path):
    """The query's rows and those of its SQL over documents made of ``rows``."""
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = query(spark, str(tmp_path))
    r = con.execute(sql)
    names = [c[0] for c in r.description]
    assert set(names) == set(got.columns), name
    return sorted(map(repr, (tuple(x[c] for c in names) for x in got.collect()))), sorted(map(repr, r.fetchall()))


def corpus(seed, n=400):
    r = random.Random(seed)
    vocab = [a + b for a in ("Thé", "qua", "MOR", "lis", "ß") for b in ("ban", "der", "tik", "olo")]
    rows = []
    for i in range(n):
        words = r.choices(vocab, weights=[1 / (k + 1) for k in range(len(vocab))], k=r.randrange(0, 40))
        text = None if i % 41 == 0 else " ".join(words) + (" 42x__y" if i % 5 else "")
        lang, source = r.choice(["en", "en", "fr", None]), r.choice(["a", "a", "b", "c", None])
        rows.append((i // 2 if i % 7 else None, text, lang, source, "x", "y"))
    rows += [(1000, "", "xx", "alone", "", ""), (1001, "..", "xx", "other", "", ""), (1001, "w " * 50_000, "en", "b", "", "")]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_audit_by_sql(spark, tmp_path, seed):
    got, want = rows_like_sql(spark, "op11", source_audit.op11_source_audit, source_audit.OP11_SQL, corpus(seed), tmp_path)
    assert got == want and any("'term'" in x for x in got)


def test_audit_by_brute_force(spark):
    rows, least, top = corpus(3), 20, 3
    seen, held, groups = collections.Counter(), collections.Counter(), set()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOW))
        seen.update((lang, source, t) for t in found)
        held.update((lang, t) for t in set(found))
    want = set()
    for lang in {g[0] for g in groups}:
        kept = [t for (la, t), n in held.items() if la == lang and n >= least]
        own = sorted(s for la, s in groups if la == lang)
        p = {}
        for s in own:
            total = sum(seen[lang, s, t] for t in kept)
            p[s] = {t: 1 + 10**9 * (seen[lang, s, t] + 5) // (total + 5 * len(kept)) for t in kept}
        total = sum(seen[lang, s, t] for s in own for t in kept)
        q = {t: 1 + 10**9 * (sum(seen[lang, s, t] for s in own) + 5) // (total + 5 * len(kept)) for t in kept}
        for s in own:
            pairs = sorted(((sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in own if o != s), key=lambda x: (-x[0], x[1].encode()))
            terms = sorted(((p[s][t] - q[t], t) for t in kept if seen[lang, s, t] and p[s][t] > q[t]), key=lambda x: (-x[0], x[1].encode()))[:top]
            want |= {(lang, s, part, o, v, i + 1) for part, x in (("pair", pairs), ("term", terms)) for i, (v, o) in enumerate(x)}
    for limit in (source_audit.MAX_BROADCAST_BYTES, 0):
        got = source_audit.audit_sources(spark.createDataFrame(rows, SCHEMA), least, top, limit).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_share_of_huge_counts(spark):
    """Counts beyond what a long can scale are divided as decimals."""
    for count, total, kept in ((3, 17, 2), (source_audit.PLAIN_COUNT, 10**12, 7), (10**15 + 1, 10**18 + 7, 10**6)):
        got = spark.sql(f"select {source_audit.share(f'{count}L', f'{total}L', f'{kept}L')} as p").first()["p"]
        assert got == 1 + 10**9 * (count + 5) // (total + 5 * kept)


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, v):
    d = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(x) <= 255 for x in v.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def private_rows():
    r = random.Random(5)
    vocab = [a + b + c for a in ("Thé", "qua", "mor", "lis") for b in ("ban", "der", "tik", "olo") for c in ("sen", "ra", "ßu", "ing")]
    rows = []
    for i in range(300):
        w = [r.choice(vocab) for _ in range(r.randrange(5, 60))]
        if i % 10 == 0:
            w[2:2] = ["Projet", "Zebulon", "bob.smith@corp.example.org", "Quarzwerk" if i % 20 else "x"]
        if i % 7 == 0:
            w += ["+1 (499) 555-6503 ", "call", "4111 1111 1111 1111", "10.0.0.1", "999.1.1.1", "1.2.3.4.5.6.7.8", "007.0.00.1"]
        if i % 50 == 0:
            w += ["QUARZWERK", "a@b.cd_e@f.gh", "éabc@x.com", "+123456789012345", "4111111111111112", "1" * 13 + "-", "a@b", "\U0001f600 1.2.3.4"]
        rows.append((None if i % 31 == 0 else i // 2, None if i == 17 else "" if i == 18 else " ".join(w) + ("." if i % 2 else ""), "en", "s", "", ""))
    return rows


def test_private_data_by_sql(spark, tmp_path):
    got, want = rows_like_sql(spark, "op12", pii.op12_pii, pii.OP12_SQL, private_rows(), tmp_path)
    assert got == want and sum("term:" in x for x in got) > 20


def test_private_data_by_brute_force(spark):
    rows = [(i, x[1], *x[2:]) for i, x in enumerate(private_rows())]
    # runs without a match that a pattern must not read again from each place, and more matches than a chunk
    rows.append((900, "7" * 20_000 + " " + "a" * 100_000 + " " + "1.2." * 5000 + " +1" + " " * 5000 + "b@" * 3000, "", "", "", ""))
    rows.append((901, " ".join(f"u{i}@x{i}.org 10.0.{i % 300}.1" for i in range(700)), "", "", "", ""))
    got = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, text, *_ in rows:
        for k in PLAIN:
            assert [tuple(x) for x in got[i][k]] == [m.span() for m in re.finditer(PLAIN[k], text or "") if valid(k, m.group())], (i, k)
    # a word that stands only by the address gives it away; the common ones don't
    terms = collections.Counter(rows[i][1][s:e].lower() for i, x in got.items() if i < 900 for s, e in x["term"])
    assert {"zebulon", "projet", "quarzwerk", "call"} <= set(terms) and terms["zebulon"] == 30
    assert not [i for i, x in got.items() if x["term"] and not any(x[k] for k in PLAIN)]
    same = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(rows, SCHEMA), limit=0).collect()}
    assert same == got


def test_sanitised_texts(spark):
    rows = [(i, x[1], *x[2:]) for i, x in enumerate(private_rows())]
    got = {r.doc_id: r for r in pii.sanitise(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows) and got[17].text is None and got[18].text == ""
    for i, text, *_ in rows:
        t = got[i].text or ""
        assert "bob.smith" not in t and "10.0.0.1" not in t and "555-6503" not in t
        if got[i].n_masked:
            assert not re.search("zebulon|quarzwerk", t, re.I)
        else:
            assert got[i].text == text
    assert sum(r.n_removed for r in got.values()) > 0 and sum(r.n_generalised for r in got.values()) > 0


def test_no_private_data(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert pii.find_personal_data(empty).count() == pii.sanitise(empty).count() == source_audit.audit_sources(empty).count() == token_alignment.align_documents(empty).count() == 0


def aligned(texts):
    """Counts and alignments of whole texts."""
    from sentencepiece import SentencePieceProcessor

    ta, bytes_a = token_alignment.byte_tokenizer(token_alignment.BYTE_BPE)
    tb = SentencePieceProcessor(model_file=token_alignment.PIECE_BPE)
    bytes_b = token_alignment.piece_tokenizer(token_alignment.PIECE_BPE)[1]
    docs, counts = {}, collections.Counter()
    for i, text in texts:
        docs[i] = None
        a, b = (ta.encode(" " + text, add_special_tokens=False).ids, tb.encode(text)) if text else ([], [])
        raw, xa, xb = (" " + (text or "")).encode(), [bytes_a[x] for x in a], [bytes_b[x] for x in b]
        if not text or b"".join(xa) != raw or b"".join(xb) != raw:
            continue
        ends_a, ends_b = ([sum(map(len, x[: k + 1])) for k in range(len(x))] for x in (xa, xb))
        span = lambda ends, x: [(e - len(t), e) for e, t in zip(ends, x)]
        links, j = [], 0
        for x, (s, e) in zip(a, span(ends_a, xa)):
            while ends_b[j] <= s:
                j += 1
            k = j
            while k < len(b) and ends_b[k] - len(xb[k]) < e:
                links.append((x, b[k]))
                k += 1
        groups, i0, j0 = [], 0, 0
        for e in sorted({*ends_a} & {*ends_b}):
            i1, j1 = ends_a.index(e) + 1, ends_b.index(e) + 1
            groups.append(",".join(map(str, a[i0:i1])) + "|" + ",".join(map(str, b[j0:j1])))
            i0, j0 = i1, j1
        docs[i] = (len(a), len(b), groups, links)
        counts.update(links)
    top = collections.Counter()
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    none = (0, 0, 0, 0, 0, 0, "")
    return {i: none if d is None else (d[0], d[1], len(d[2]), len(d[3]), sum(counts[x] == top[x[1]] for x in d[3]), sum(counts[x] for x in d[3]), ";".join(d[2])) for i, d in docs.items()}


ODD = ["a▁b c", None, "", " ", "  x  y\r\n z", "a\tb\n\n\nc   d", "<|endoftext|> hi </s> <s>", "　 a \U0001f600 b\U0001f600 c", "a\x00b c", "don't  I'll", "x" * 3000 + " y", "café café ́", "c c c", "a▁b c", "\n\n", "q  r  s", "c c c"]


@pytest.mark.parametrize("how", [{}, {"block_bytes": 50, "max_pairs": 3}])
def test_alignment_by_whole_texts(spark, how):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()
    texts = [*enumerate(ODD), *((100 + i, r.text) for i, r in enumerate(rows) if i < (12 if how else 60))]
    docs = spark.createDataFrame([(i, t, "", "", "", "") for i, t in texts], SCHEMA)
    got = {r.doc_id: (*(r[c] for c in token_alignment.COUNTS), r.groups) for r in token_alignment.align_documents(docs, **how).collect()}
    assert got == aligned(texts)


def test_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "one two", "", "", "", ""), (1, "one two", "", "", "", ""), (None, "three", "", "", "", ""), (None, None, "", "", "", "")], SCHEMA)
    got = sorted((r.doc_id or 0, r.n_a) for r in token_alignment.align_documents(docs).collect())
    assert got == [(0, 0), (0, 1), (1, 2), (1, 2)]


def test_safe_spaces():
    """No segment's end may be where a token of either vocabulary goes on."""
    assert token_alignment.safe_spaces(token_alignment.BYTE_BPE, token_alignment.PIECE_BPE) == "\t\n\x0b\x0c "


def test_digest(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in token_alignment.op13_token_alignment(spark, sf).collect()}
    whole = {r.doc_id: r.groups for r in token_alignment.align_documents(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert {i: r.groups_sha256 for i, r in got.items()} == {i: hashlib.sha256(g.encode()).hexdigest() if g else "" for i, g in whole.items()}


def test_terms_are_counted_before_they_meet(spark):
    # 400 documents that all hold the 5 wanted terms: a join of documents' words with them would make 2,000 rows
    rows = spark.createDataFrame([(i, "call alpha beta gamma delta " + "word" * (i % 3)) for i in range(400)], "uid long, text string")
    terms = spark.createDataFrame([(t,) for t in ("call", "alpha", "beta", "gamma", "delta")], "term string")
    for limit in (pii.MAX_BROADCAST_BYTES, 0):
        got = pii._documents_with(rows, terms, pii._words, limit)
        assert {(r.term, r.dt) for r in got.collect()} == {(t, 400) for t in ("call", "alpha", "beta", "gamma", "delta")}
        lines = got._jdf.queryExecution().optimizedPlan().toString().split("\n")
        at = {k: [i for i, x in enumerate(lines) if k in x] for k in ("Join", "Aggregate")}
        assert at["Join"] and max(at["Join"]) < min(at["Aggregate"])

import base64
import collections
import hashlib
import itertools
import random
import re
import time
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chainweave import session
from chainweave.llm import bytewords, chat, collinear, decontaminate, language, mixing, ngram_join, queries, sharding, spotsigs, suffix_dedup, suffix_tree_lm

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def words(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}x" for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    base = words(1, 300)
    near = base.split()
    near[150] = "changed"
    texts = [base, base, " ".join(near), words(2, 200), None, "", "one two", "é" * 300 + base, words(3, 60) + " " + base[:1200], "1234 !!", words(4, 5000, 5000)]
    rows = [(i, t, "en" if i % 2 else None, None if i == 3 else f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text):
    w = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
    return {tuple(w[i : i + min(5, len(w))]) for i in range(max(1, len(w) - 4))} if w else set()


def test_join_by_brute_force(docs, empty):
    rows = docs.collect()
    sets, comp = {r.doc_id: shingles(r.text) for r in rows}, {r.doc_id: r.doc_id for r in rows}
    for _ in rows:
        for a, b in itertools.combinations(sets, 2):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                comp[a] = comp[b] = min(comp[a], comp[b])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs).collect()}
    assert got == {i: (len(sets[i]), comp[i]) for i in sets}
    assert ngram_join.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    rows = con.sql(queries.SQL[name]).project(", ".join(cols)).fetchall()
    assert sorted(map(repr, map(tuple, got.select(*cols).collect()))) == sorted(map(repr, rows))


def test_decontamination_of_odd_rows(spark, docs, empty):
    items = spark.createDataFrame([(1, "One TWO"), (2, None), (3, words(2, 30))], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r.items) for r in decontaminate.contamination(docs, items).collect()}
    assert got[6] == (2, ["1"]) and got[3] == (30, ["3"]) and got[4] == (0, []) and got[0] == (0, [])
    assert {r.doc_id for r in decontaminate.remove_contaminated(docs, items).collect()} == set(range(11)) - {3, 6}
    assert decontaminate.contamination(docs, items.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(empty, items).count() == 0


@pytest.mark.parametrize("max_broadcast", [decontaminate.MAX_BROADCAST_BYTES, 0])
def test_decontamination_of_repeated_rows(spark, docs, max_broadcast):
    """Rows of one doc_id and rows without one are judged each by itself, whichever way the sides meet; clashing names stay."""
    items = spark.createDataFrame([(1, words(70, 14)), (2, "tiny ITEM"), (None, "null item")], "item_id long, text string")
    clean = words(71, 40)
    texts = [(None, words(70, 14)), (None, clean), (5, "!" + " ".join(words(70, 14).split()[1:])), (5, clean + " tiny item"), (5, clean + " null item"), (5, None)]
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_hit, r.n_items) for r in decontaminate.contamination(rows, items, max_broadcast).collect())
    assert got == sorted([(-1, 14, 14, 1), (-1, 40, 0, 0), (5, 13, 13, 1), (5, 42, 2, 1), (5, 42, 0, 0), (5, 0, 0, 0)])
    odd = rows.withColumn("UID", F.lit(1)).withColumn("a.b", F.lit(2)).withColumn("len", F.lit(3))
    kept = decontaminate.remove_contaminated(odd, items, max_broadcast)
    assert kept.columns == odd.columns and sorted(map(tuple, kept.collect()), key=repr) == sorted([(None, clean, 1, 2, 3), (5, clean + " null item", 1, 2, 3), (5, None, 1, 2, 3)], key=repr)


def test_join_of_repeated_rows(spark):
    """Rows of one doc_id or of none are documents of their own; one row of each group stays."""
    a, b = words(80, 60), words(81, 60)
    rows = spark.createDataFrame([(1, a), (1, b), (3, b + " z"), (2, a), (2, a), (None, b), (None, words(82, 60)), (4, None), (4, "")], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_id)) for r in ngram_join.near_duplicates(rows).collect() if r.n_shingles)
    assert got == [("1", "1"), ("1", "1"), ("2", "1"), ("2", "1"), ("3", "1"), ("None", "1"), ("None", "None")]
    odd = rows.withColumn("uid", F.lit(1)).withColumn("a.b", F.lit(2))
    kept = ngram_join.keep_first(odd)
    assert kept.columns == odd.columns
    assert sorted((str(r[0]), str(r[1])) for r in kept.collect()) == sorted([("1", a), ("1", b), ("None", words(82, 60)), ("4", "None"), ("4", "")])


def test_decontamination_words_by_regex(spark):
    texts = [None, "", " \t--", "One", "-One, TWO.", "ÉTÉ Été a_B\x00c", "İ x", "\u00a0A\u00a0 b", "7Up\n\n[^x]"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = rows.select("text", decontaminate.word_list(rows.text).alias("w"), decontaminate.word_count(rows.text).alias("n")).collect()
    for r in got:
        low = "".join(c.lower() if c.isascii() else c for c in r.text or "")
        want = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        assert r.w == want and r.n == len(want)


def test_language(spark, docs, empty):
    assert language.fit(empty) is None
    model = language.fit(docs)
    got = {r.row.doc_id: r for r in language.identify(docs, model).collect()}
    assert got[4].lang_pred == got[5].lang_pred == got[9].lang_pred == "und" and got[9].rejected
    assert got[0].lang_pred == "en" and 0 < got[0].score <= 1
    assert {r.lang_pred for r in language.identify(docs, None).collect()} == {"und"}
    rows = language.op3_language(spark, "/root/testdata/sf0.01").collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.98 * len(held)


def test_rejection(spark):
    """Texts of other languages, random letters, encoded bytes and numbers go; texts of the learned languages stay, short ones too."""
    import base64

    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = random.Random(6)
    finnish = "tämä on suomenkielinen teksti joka kertoo pitkän tarinan metsästä ja järvestä sekä ihmisistä jotka asuvat siellä kaukana pohjoisessa ja kalastavat talvella jäällä "
    odd = [finnish * 2, "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(900)), base64.b64encode(r.randbytes(600)).decode(), r.randbytes(500).hex(), "Съешь же ещё этих мягких французских булок, да выпей чаю. " * 3, "12 345 ½ ²³", None, ""]
    rows = spark.createDataFrame([(10**6 + i, t, None, "odd", len(t or "")) for i, t in enumerate(odd)], docs.schema)
    kept = {x.doc_id for x in corpus_pipeline.language_id(spark, docs.unionByName(rows), "").select("doc_id").collect()}
    every = {x.doc_id for x in docs.select("doc_id").collect()}
    assert kept == every
    model = language.fit(docs)
    got = {x.row.doc_id: x for x in language.identify(rows, model).collect()}
    assert got[10**6 + 5].lang_pred == "und" and got[10**6 + 5].score == 0  # no letter: a fraction and powers are none


def tree_by_hand(texts, depth, least):
    """Log10 probability of the next token after some others, from plain counts; and the words known."""
    import math

    toks = [[*(t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split(), None] for t in texts]
    words = collections.Counter(w for t in toks for w in t)
    n, v = sum(words.values()), len(words)
    nexts = collections.defaultdict(collections.Counter)
    for t in toks:
        for d in range(1, depth + 1):
            for i in range(d, len(t)):
                nexts[tuple(t[i - d : i])][t[i]] += 1
    seen = lambda c: sum(nexts[c[:-1]][c[-1]] for _ in (0,)) if len(c) > 1 else words[c[0]]
    states = {}

    def p(w, context):
        if not context:
            return (words[w] + 0.5) / (n + 0.5 * (v + 1))
        if context not in states:
            return p(w, context[1:])
        c, total = states[context]
        return (c.get(w, 0) + (total - sum(c.values()) + 20) * p(w, context[1:])) / (total + 20)

    for d in range(1, depth + 1):
        for c in sorted((c for c in nexts if len(c) == d), key=repr):
            kept = {w: k for w, k in nexts[c].items() if k >= 2}
            if seen(c) >= least and kept and (d == 1 or c[1:] in states and nexts[c[:-1]][c[-1]] >= 2 and c[:-1] in states):
                t, total = sum(kept.values()), seen(c)
                gain = sum(k * math.log(k / total / p(w, c[1:])) for w, k in kept.items())
                gain += (total - t) * math.log((total - t) / total / max(1e-12, 1 - sum(p(w, c[1:]) for w in kept))) if total > t else 0
                if gain >= 0.5 * len(kept) * math.log(n):
                    states[c] = (kept, total)
    return toks, words, n, v, states, p


def test_suffix_tree_by_brute_force(spark, docs, empty):
    import math

    r = random.Random(12)
    heads = ["the old", "a very", "on the", "in a"]
    odd = [" ".join(f"{r.choice(heads)} w{r.randrange(6)} and {r.choice(('x', 'Y', 'z'))}{r.randrange(3)}" for _ in range(r.randrange(1, 30))) for _ in range(60)]
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(100 + i, t) for i, t in enumerate(odd)] + [(100, odd[1]), (None, odd[2]), (None, None)]
    every = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held_out", F.expr("coalesce(doc_id % 5 = 1, false)"))
    _, words_, n, v, states, p = tree_by_hand([t for i, t in rows if i is None or i % 5 != 1], 2, 8)
    tree = suffix_tree_lm.learn(every.where("not held_out"), 2, 8)
    assert (tree.n, tree.v, tree.states) == (n, v, [sum(len(c) == d for c in states) for d in (1, 2)]) and all(tree.states)
    want = []
    for i, text in rows:
        t = [*(text or "").lower().split(), None]
        base = sum(math.log10((words_[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        model = sum(math.log10(p(w, tuple(t[max(0, k - 2) : k]))) for k, w in enumerate(t))
        want.append((-1 if i is None else i, len(t), sum(words_[w] > 0 for w in t), n, round(base, 6), round(model, 6)))
    got = suffix_tree_lm.score(every, tree).collect()
    assert sorted((-1 if x.doc_id is None else x.doc_id, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6), round(x.score, 6)) for x in got) == sorted(want)
    # every state's distribution sums to 1 over all words and the unknown one
    for c in [(), *states]:
        assert sum(p(w, c) for w in words_) + p("unknown!", c) == pytest.approx(1)
    none = suffix_tree_lm.score(every.limit(3), suffix_tree_lm.learn(empty)).collect()
    assert {x.train_tokens for x in none} == {0} and suffix_tree_lm.score(empty.selectExpr("doc_id", "text", "true as held_out"), tree).count() == 0


def test_memory_goes_back():
    """What a task has freed doesn't stay with the worker; a bucket's values keep their order."""
    taken = lambda: int(Path("/proc/self/statm").read_text().split()[1]) * 4096
    before = taken()
    held = [np.ones(12_000) for _ in range(2000)]
    most = taken()
    del held
    bytewords.give_back()
    assert most - before > 100 << 20 and taken() - before < (most - before) / 4
    key = np.arange(50_000, dtype=np.uint64)
    got = suffix_tree_lm.packed(suffix_tree_lm.bucket_of(key), [key], ["a"])
    assert all((np.diff(np.frombuffer(x.as_py(), dtype=np.uint64).astype(np.int64)) > 0).all() for x in got.column(1))


def test_weights_by_bucket():
    """A bucket's weights are few rows however many batches they come in, and every one is found again where it was put."""
    r = np.random.default_rng(3)
    key = r.integers(0, 2**64, 100_000, dtype=np.uint64)
    cols = [key.view(np.int64), r.random(len(key)) < 0.5, r.random(len(key))]
    batches = [pa.RecordBatch.from_arrays([pa.array(c[i : i + 5000]) for c in cols], names=["key", "word", "value"]) for i in range(0, len(key), 5000)]
    got = list(suffix_tree_lm.weight_rows(iter(batches)))
    assert sum(b.num_rows for b in got) <= 1 << suffix_tree_lm.BUCKET_BITS  # twenty times as many before
    assert (np.diff(np.concatenate([b.column(0).to_numpy() for b in got])) > 0).all()
    back = [np.concatenate([suffix_tree_lm.joined(b.column(c), 0, b.num_rows, k) for b in got]) for c, k in ((3, np.uint8), (4, np.float64), (5, np.bool_))]
    put = suffix_tree_lm.within(key)
    as_put = np.argsort(suffix_tree_lm.bucket_of(key), kind="stable")
    assert (suffix_tree_lm.widened(back[0]) == put[as_put]).all() and (back[1] == cols[2][as_put]).all() and (back[2] == cols[1][as_put]).all()
    table = np.sort(np.append(key, np.array([0, 1, 2, 2**64 - 2, 2**64 - 1], dtype=np.uint64)))
    asked = np.append(table[::7], r.integers(0, 2**64, 50_000, dtype=np.uint64))
    for some in (table, table[:1], table[:0]):
        hit, at = suffix_tree_lm.spots(some, suffix_tree_lm.firsts(some), asked)
        assert (hit == np.isin(asked, some)).all() and (some[at] == asked[hit]).all()
    third = got[0].slice(2, 1)
    inside = suffix_tree_lm.bucket_of(key) == third.column(0)[0].as_py()
    assert (suffix_tree_lm.widened(suffix_tree_lm.joined(third.column(3), 0, 1, np.uint8)) == put[inside]).all()


def test_suffix_tree_gain(spark):
    """On held-out documents the tree is better than single words, and it has more states where there is more text."""
    sizes = []
    for sf in ("sf0.001", "sf0.01"):
        d = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text", F.expr("crc32(cast(doc_id as string)) % 5 = 1").alias("held_out"))
        tree = suffix_tree_lm.learn(d.where("not held_out"))
        sizes.append(tree.states)
        x = suffix_tree_lm.score(d, tree).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
        print(tree.states, x.s / x.n, x.b / x.n)
        assert x.s > x.b
    assert sum(sizes[1]) > 2 * sum(sizes[0]) and all(b > a for a, b in zip(*sizes, strict=True))


def test_chat_parts(spark):
    part = lambda kind, text=None, ref=None, units=None: (kind, text, ref, units)
    rows = [(1, 0, "user", [part("text", "see <|image|> \\"), part("image", ref="a.png", units=2.0), part("audio", ref="b", units=3.5)]), (1, 1, "assistant", [part("text", "### x\n</turn>\n")]), (None, None, None, None)]
    out = chat.format_chat(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PART}"))
    out = out.withColumn("turns", chat.read_back(out.formatted)).withColumn("loss", chat.masked(out.formatted, out["mask"]))
    got = {r.conv_id: r for r in out.collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("user", "see <|image|> \\<|image|><|audio|>"), ("assistant", "### x\n</turn>\n")]
    assert got[1].loss == "### x\n</turn>\n"
    assert [(a.type, a.ref, a.tokens) for a in got[1].attachments] == [("image", "a.png", 512), ("audio", "b", 100)]
    assert [(t.role, t.text) for t in got[None].turns] == [("", "")]


def test_fingerprints(docs, empty):
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    got = {r.doc_id: r for r in spotsigs.fingerprint_neighbours(docs, bucket_rows=3).collect()}
    assert got[0].fingerprint == got[1].fingerprint and got[0].near_next == 1.0 and len(got) == len(rows)
    for r, after in zip(rows, rows[1:] + rows[:1], strict=True):
        t, x = r.text or "", after.text or ""
        edited = t[: len(t) - len(t) // 2] + x[: len(t) // 2]
        assert got[r.doc_id].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        own, new, other = (set(memoryview(base64.b64decode(x)).cast("I")) for x in (got[r.doc_id].fingerprint, got[r.doc_id].edited_fingerprint, got[after.doc_id].fingerprint))
        like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        assert (got[r.doc_id].near_edited, got[r.doc_id].near_next) == (like(own, new), like(own, other))  # without a floor
    assert spotsigs.fingerprint_neighbours(empty).count() == 0


def test_passages(spark, docs, empty):
    shared = words(9, 60)
    more = spark.createDataFrame([(100, words(10, 80) + " " + shared), (101, shared + " " + words(11, 90)), (102, words(12, 400))], "doc_id long, text string")
    got = collinear.passages(docs.select("doc_id", "text").unionByName(more)).collect()
    found = {i for r in got for i in (r.doc_id, r.other_id)}
    assert {100, 101, 0, 1, 2, 7, 8} <= found and not found & {102, 3, 10}
    assert next((r.start, r.other_start, r.n_words) for r in got if r.doc_id == 101) == (0, 80, 60)
    assert collinear.passages(empty).count() == 0


def test_staging_leaves_no_shuffle_files(spark):
    """What a tidily staged table was shuffled by is dropped when it is written, and the session's setting stays as it was."""
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").split()
    shuffled = lambda: {f for f in files() if "/shuffle_" in f}
    was, before = spark.conf.get(session.CLEANUP), shuffled()
    table = session.stage_table(spark.range(10_000).repartition(4, "id"), "some", tidy=True)
    end = time.monotonic() + 10
    while shuffled() - before and time.monotonic() < end:
        time.sleep(0.1)
    assert not shuffled() - before and spark.conf.get(session.CLEANUP) == was
    assert table.count() == 10_000
    session.release(table)


def test_passages_among_fragments(spark):
    """Documents that hold a whole passage meet, although many others hold parts of it only; so do rows without doc_id and equal texts."""
    p = words(50, 60, 10**6).split()
    own = lambda i: words(6000 + i, 40, 10**6).split()
    rows = [(i, " ".join([*own(i), *(p[:30] if i % 2 else p[30:]), *own(100 + i)])) for i in range(60)]
    rows += [(100 + i, " ".join([*own(200 + i), *p, *own(300 + i)])) for i in range(3)]
    rows += [(None, " ".join([*own(400), *p])), (7, " ".join(own(500) * 2)), (7, " ".join(own(500) * 2)), (8, None), (9, "")]
    got = collinear.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    pairs = {(x.doc_id, x.other_id) for x in got}
    assert {(101, 100), (102, 100), (None, 100), (7, 7)} <= pairs and {i for p in pairs for i in p} == {100, 101, 102, None, 7}
    whole = {(x.doc_id, x.other_id) for x in got if (x.n_words, x.identity) == ((80, 1.0) if x.doc_id == 7 else (60, 1.0))}
    assert {(101, 100), (102, 100), (None, 100), (7, 7)} <= whole


def test_exact_passages_by_brute_force(spark):
    """Every document that shares 50 words with another one has a passage, and no other, over random cuts of common texts."""
    r = random.Random(8)
    texts = [words(700 + i, 400, 10**6).split() for i in range(4)]
    rows = []
    for i in range(80):
        parts = []
        for _ in range(r.randrange(1, 4)):
            t, n = r.choice(texts), r.choice((20, 44, 49, 50, 51, 70, 120))
            at = r.randrange(len(t) - n)
            parts += [words(r.random(), r.randrange(0, 60), 10**6).split(), t[at : at + n]]
        rows.append((i, " ".join(w for p in parts for w in p)))
    held = collections.defaultdict(set)
    for i, t in rows:
        w = t.split()
        for k in range(len(w) - 49):
            held[tuple(w[k : k + 50])].add(i)
    want = {i for s in held.values() if len(s) > 1 for i in s}
    got = {x for r in collinear.passages(spark.createDataFrame(rows, "doc_id long, text string"), least_identity=0.98).collect() for x in (r.doc_id, r.other_id)}
    assert want <= got


def test_fuzzy_passages(spark):
    """Passages changed at even steps or at random places, by changed, added and dropped words; too different ones stay out."""
    r = random.Random(5)
    rows, expected = [], set()

    def plant(passage, copy, holds):
        i = len(rows)
        rows.extend((i + k, " ".join([*words(1000 + i + k, 90, 10**6).split(), *p, *words(3000 + i + k, 90, 10**6).split()])) for k, p in ((0, passage), (1, copy)))
        if holds:
            expected.add(i + 1)

    def passage(n):
        return words(r.random(), n, 10**6).split()

    for n, step in ((50, 5), (55, 40), (60, 25), (100, 10), (200, 8), (200, 5), (200, 50)):
        p = passage(n)
        plant(p, [f"c{r.random()}" if k % step == step // 2 else w for k, w in enumerate(p)], True)
    for n, edits in ((50, 5), (50, 10), (80, 8), (120, 20), (200, 20), (200, 38)):
        for _ in range(3):
            p = passage(n)
            q = list(p)
            for k in sorted(r.sample(range(1, n - 1), edits), reverse=True):
                q[k : k + 1] = r.choice(([f"c{r.random()}"], [q[k], f"c{r.random()}"], [])) if n > 50 else [f"c{r.random()}"]
            plant(p, q, True)
    for n, step in ((60, 3), (200, 2), (45, 50)):
        p = passage(n)
        plant(p, [f"c{r.random()}" if k % step == step - 1 else w for k, w in enumerate(p)], False)
    got = collinear.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id for x in got} == expected
    assert all(x.other_id == x.doc_id - 1 and x.n_words >= 50 and x.identity >= 0.8 for x in got)
    texts = dict(rows)
    for x in got:
        a, b = texts[x.doc_id].split()[x.start : x.end], texts[x.other_id].split()[x.other_start : x.other_end]
        d = list(range(len(b) + 1))
        for i, w in enumerate(a):
            last, d[0] = d[0], i + 1
            for j, v in enumerate(b):
                last, d[j + 1] = d[j + 1], min(last + (w != v), d[j] + 1, d[j + 1] + 1)
        assert x.identity == pytest.approx(1 - d[-1] / max(len(a), len(b)))


def test_likeness_by_brute_force(spark, docs):
    """Pruned likeness equals plain Jaccard from the least value on, and groups by signatures those of all pairs."""
    r = random.Random(5)
    for _ in range(300):
        a, b = (sorted(r.sample(range(60), r.choice((0, 1, 3, 20, 50)))) for _ in range(2))
        plain = len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0
        for least in (0.1, 0.5, 0.8):
            import numpy as np

            assert spotsigs.jaccard(np.array(a, dtype=np.uint32), np.array(b, dtype=np.uint32), least) == (plain if plain >= least or not (a or b) else 0.0)
    base = [" ".join(r.choice(("the", "of", "and", f"x{r.randrange(300)}")) for _ in range(200)) for _ in range(6)]
    texts = [*base, *(b + " the end of it" for b in base[:4]), base[0][: len(base[0]) // 2], *(" ".join(w for k, w in enumerate(b.split()) if k % 30) for b in base), None, "", "one"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [set(x.tolist()) for x in spotsigs.signatures([t or "" for t in texts], spotsigs._hash_words(list(spotsigs.ANCHORS)))]
    comp = list(range(len(texts)))
    for _ in texts:
        for i, j in itertools.combinations(range(len(texts)), 2):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                comp[i] = comp[j] = min(comp[i], comp[j])
    got = {x.doc_id: (x.n_signatures, x.component_id) for x in spotsigs.near_groups(rows).collect()}
    assert got == {i: (len(s), c) for i, (s, c) in enumerate(zip(sets, comp, strict=True))} and len(set(comp)) < len(comp) - 6


def test_parts_read_back(spark):
    """A literal placeholder in a text and the placeholder of a part are told apart; odd types come back."""
    part = lambda kind, text=None: (kind, text, None, None)
    rows = [(1, 0, "a:b", [part("text", "see <|image|> \\<|x|>"), part("image"), part("o|d\\d>"), part("text", "end"), part("text", "")]), (1, 1, "", [])]
    out = chat.format_chat(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PART}"))
    (got,) = out.select(F.transform(chat.bodies(F.col("formatted")), chat.read_parts).alias("p")).collect()
    assert [[tuple(x) for x in p] for p in got.p] == [[("text", "see <|image|> \\<|x|>"), ("image", None), ("o|d\\d>", None), ("text", "end")], []]
    assert chat.format_chat(spark.createDataFrame([], f"conv_id long, turn long, role string, parts {chat.PART}")).count() == 0


def test_fuzzy_passages_among_fragments(spark):
    """Two documents share a fuzzy passage; 60 earlier and later ones hold 20 words of it each, and so all that leaders see."""
    p = words(61, 60, 10**6).split()
    changed = [f"c{k}" if k % 10 == 4 else w for k, w in enumerate(p)]
    own = lambda i: words(8000 + i, 70, 10**6).split()
    rows = [(i if i < 30 else 500 + i, " ".join([*own(i), *p[at : at + 20], *own(100 + i)])) for i in range(60) for at in [(i * 7) % 41]]
    rows += [(200 + i, " ".join([*own(200 + i), *q, *own(300 + i)])) for i, q in enumerate((p, changed))]
    got = collinear.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(x.doc_id, x.other_id) for x in got} == {(201, 200)} and all(x.n_words >= 50 and x.identity >= 0.8 for x in got)


def test_mix_of_small_weights(spark, docs):
    got = mixing.mix(docs, {"s0": 1e-9, "s1": 1.0}).collect()
    assert sorted(r.position for r in got) == list(range(11))


@pytest.mark.parametrize("crowd", [suffix_dedup.CROWD, 1])
@pytest.mark.parametrize("first", [False, True])
def test_suffix_dedup_by_brute_force(spark, docs, empty, first, crowd):
    """Also equal rows of one doc_id, different texts of one, null ids, texts of one letter, one letter of difference and ties."""
    base = words(1, 300)
    more = [(20, base[:900]), (20, base[:900]), (20, base[50:700] + "!"), (None, base[100:950]), (None, None), (21, "a" * 700), (22, "b" + "a" * 650), (23, base[:450] + "#" + base[451:]), (24, words(6, 150) * 2)]
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    raw = [(99 if r.doc_id is None else r.doc_id, (r.text or "").encode()) for r in rows.collect()]
    seen = collections.Counter(t[i : i + 400] for _, t in raw for i in range(len(t) - 399))

    def brute(order):
        want, met = [], set()
        for d, t in order:
            gone = [False] * len(t)
            for i in range(len(t) - 399):
                s = t[i : i + 400]
                if s in met if first else seen[s] > 1:
                    gone[i : i + 400] = [True] * 400
                met.add(s)
            want.append((d, len(t), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), bytes(b for b, g in zip(t, gone, strict=True) if not g)))
        return sorted(want)

    got = suffix_dedup.remove_repeats(rows, keep_first=first, crowd=crowd).collect()
    got = sorted((99 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got)
    # rows of one doc_id stand in any order
    ways = [sorted(raw, key=lambda r: r[0]), sorted(raw[::-1], key=lambda r: r[0])]
    same = [[i for i, r in enumerate(ways[0]) if r[0] == d] for d in (99, 20)]
    ways = [[ways[0][k] for k in [*p, *[i for i in range(len(raw)) if i not in same[0] and i not in same[1]], *q]] for p in itertools.permutations(same[0]) for q in itertools.permutations(same[1])] if first else ways[:1]
    ways = [sorted(w, key=lambda r: r[0]) for w in ways]
    assert got in [brute(w) for w in ways]
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_longest_factors_by_brute_force():
    """Longest earlier matches of all suffixes of random texts, from their order and the matches of neighbours."""
    np = pytest.importorskip("numpy")
    r = random.Random(3)
    for n, least in ((1, 1), (2, 1), (40, 1), (200, 3), (300, 8)):
        t = "".join(r.choice("ab") for _ in range(n))
        order = sorted(range(n), key=lambda i: t[i:])

        def match(i, j, t=t):
            k = 0
            while max(i, j) + k < len(t) and t[i + k] == t[j + k]:
                k += 1
            return k

        lcp = np.array([0] + [match(i, j) for i, j in itertools.pairwise(order)])
        got = suffix_dedup.longest_factors(np.array(order), lcp, least)
        want = [max([0] + [match(i, j) for j in range(i)]) for i in order]
        assert got.tolist() == [w if w >= least else 0 for w in want]


def test_runs_of_long_texts(monkeypatch):
    """Segments of a long text have every window once, at its place."""
    np = pytest.importorskip("numpy")
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 1000)
    for n in (0, 399, 400, 1000, 1001, 3333):
        buf = np.frombuffer(words(31, 1500, 10**6).encode()[:n], dtype=np.uint8)
        got = []
        for _, s, part, off in suffix_dedup.segments(buf, np.array([0, n]), 400):
            _, lo, hi, place, _ = suffix_dedup.cut_runs(part, off, 400)
            assert all(part[a : b + 400].tobytes() == buf[s + a : s + b + 400].tobytes() and b <= p <= a + 336 for a, b, p in zip(lo, hi, place, strict=True))
            got += [s + w for a, b in zip(lo, hi, strict=True) for w in range(a, b + 1)]
        assert got == list(range(max(0, n - 399)))


def test_pfair_deviation(docs, empty):
    from fractions import Fraction

    w = {"a": Fraction(5), "b": Fraction(3), "c": Fraction(1)}
    plan = mixing.pfair({"a": 50, "b": 30, "c": 10}, w)
    done = collections.Counter()
    for s, block, slot, release, deadline in plan:
        assert release <= slot < deadline and block == done[s]
        done[s] += 1
        assert all(abs(done[k] - w[k] / 9 * (slot + 1)) < 1 for k in w)
    got = mixing.mix(docs).collect()
    assert sorted(r.position for r in got) == list(range(11)) and {r.source_key for r in got} == {None, "s0", "s1"}
    assert mixing.mix(empty).count() == 0


def test_shards(spark, docs, empty):
    got = sorted(sharding.shard_documents(docs.withColumn("shard", docs.doc_id).withColumn("_order0", F.lit(0)), 3).collect(), key=lambda r: (r.shard, r.slot))
    assert [r.doc_id for r in got] == list(range(11)) and [r.size for r in got] == [len((r.text or "").encode()) + 8 for r in got]
    for s in {r.shard for r in got}:
        assert [r.slot for r in got if r.shard == s] == list(range(sum(r.shard == s for r in got)))
    assert sharding.shard_documents(empty, 3).count() == 0
    rows = sharding.op10_shards(spark, SF).collect()
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all(r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in rows)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == [*docs.columns, "size", "shard", "slot"]
    bad = {r.doc_id for r in decontaminate.op2_decontaminate(spark, SF).where("contaminated").collect()}
    later = {r.doc_id for r in ngram_join.op1_ngram_join(spark, SF).where("doc_id <> component_id").collect()}
    assert {r.doc_id for r in got.collect()} == {r.doc_id for r in docs.collect()} - bad - later


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Nulls in every column, empty texts, repeated rows and doc_ids, and columns with the names that stages use; then empty tables."""
    import corpus_pipeline

    clean = [words(900 + i, 60, 60) for i in range(12)]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(clean)] + [(0, clean[0], "en", "s", 1), (None, clean[1], None, None, None), (None, clean[2] + " more", "en", None, 1), (3, words(990, 70, 60), None, "t", 1), (20, None, "en", "s", 1), (21, "", "en", "s", 1), (22, "--", None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    names = ["row", "uid", "shard", "rejected", "position", "m_source", "len", "a.b"]
    docs = docs.select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])
    docs.write.parquet(str(tmp_path / "a" / "documents.parquet"))
    items = spark.createDataFrame([(1, clean[5]), (None, clean[6]), (3, None)], "item_id long, text string")
    items.write.parquet(str(tmp_path / "a" / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "a"))
    assert got.columns == [c for c in docs.columns if c != "shard"] + ["size", "shard", "slot"]
    kept = sorted((str(r.doc_id), r.text) for r in got.collect())
    want = [(str(i), t) for i, t in enumerate(clean) if i != 5] + [("3", words(990, 70, 60))]
    assert kept == sorted(want)
    docs.limit(0).write.parquet(str(tmp_path / "b" / "documents.parquet"))
    items.limit(0).write.parquet(str(tmp_path / "b" / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "b")).count() == 0


def test_shards_by_brute_force(spark):
    """Each row is in the shard that holds the middle of its bytes, in order of doc_id."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    sizes = sorted((r.doc_id, zlib.crc32((r.text or "").encode()), len((r.text or "").encode()) + 8) for r in rows)
    total, at, want, slots = sum(s for *_, s in sizes), 0, {}, collections.Counter()
    for i, crc, size in sizes:
        shard = min(23, (2 * at + size) * 24 // (2 * total))
        want[i] = (size, crc, "bytes", shard, slots[shard], None)
        slots[shard] += 1
        at += size
    got = {r.doc_id: (r.size, r.text_crc32, r.law, r.shard, r.slot, r.grown_shard) for r in sharding.op10_shards(spark, SF).collect()}
    assert got == want and len(slots) == 24


def test_mix_plan_by_brute_force(spark):
    """Earliest deadline first at every slot: releases and deadlines follow from the square root of a source's rows, until one runs out."""
    from fractions import Fraction

    rows = mixing.op9_mix_plan(spark, SF).collect()
    n = collections.Counter(r.source for r in rows)
    share = {s: Fraction(k**0.5).limit_denominator(10**6) for s, k in n.items()}
    left, done, began, slot, want = dict(n), collections.Counter(), 0, 0, {}
    while left:
        total = sum(share[s] for s in left)
        own = {s: share[s] / total for s in left}
        start = dict(done)
        while True:
            open_ = []
            for s in left:
                i = done[s] - start.get(s, 0)
                release, deadline = began + int(i / own[s]), began + -int(-(i + 1) // own[s])
                if release <= slot:
                    open_.append((deadline, "-" if s is None else "+" + s, s, release))
            deadline, _, s, release = min(open_)
            want[s, done[s]] = (slot, release, deadline)
            assert release <= slot < deadline
            done[s] += 1
            slot += 1
            left[s] -= 1
            if not left[s]:
                del left[s]
                began = slot
                break
    # on this table a block is one row
    assert {(r.source, r.block): (r.slot, r.release, r.deadline) for r in rows} == want and sorted(r.position for r in rows) == list(range(len(rows)))
    assert all(r.position == r.slot for r in rows)


def test_seeds_once_and_outside_spans(spark):
    """A hot seed that came twice counts once, and seeds inside a found span no longer ask."""
    row = lambda doc, pos, asks: (1000 * doc + pos, doc, pos, True, asks)
    rows = [row(d, p, d > 1) for d in (1, 2) for p in range(20)] + [row(2, p, True) for p in range(5)] + [row(3, p, True) for _ in range(3) for p in range(3)]
    shared = spark.createDataFrame(rows, collinear.SEED)
    got = sorted((r.doc, r.pos, r.asks) for r in collinear.dense_rows(shared).collect())
    assert got == [(d, p, d > 1) for d in (1, 2) for p in range(20)]
    found = spark.createDataFrame([(2, 0, 12), (2, 3, 9), (7, 0, 99)], "uid long, start int, end int")
    got = sorted((r.doc, r.pos, r.asks) for r in collinear.dense_rows(shared, found).collect())
    assert got == [(d, p, d > 1 and p > 8) for d in (1, 2) for p in range(20)]


def test_pairs_of_a_batch_as_one_by_one():
    """Alignments of long and short texts in one table, and what may share a passage, as by plain loops."""
    r = np.random.default_rng(3)
    pairs = []
    for k in range(60):
        x = r.integers(0, 2**32, int(r.choice([50, 90, 200, 700])), dtype=np.uint32)
        y = x.copy()
        y[r.random(len(y)) < r.choice([0.0, 0.1, 0.3, 0.9])] = 7
        y = np.delete(y, r.integers(0, len(y), k % 7))
        pairs.append((x, np.concatenate([y, r.integers(0, 2**32, int(r.integers(0, 30)), dtype=np.uint32)])))
    plain = [collinear.longest_part(x, y, 0.8) for x, y in pairs]
    assert [(min(p[1] - p[0], p[3] - p[2]), p[4]) for p in collinear.longest_parts(pairs, 0.8)] == [(min(p[1] - p[0], p[3] - p[2]), p[4]) for p in plain]
    n, m = (np.array([len(p[k]) for p in pairs]) for k in (0, 1))
    x, y = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
    may = collinear.may_hold(x, y, np.cumsum(n) - n, n, np.cumsum(m) - m, m, 50, 0.8)
    holds = np.array([min(p[1] - p[0], p[3] - p[2]) >= 50 for p in plain])
    assert may[holds].all() and not may.all() and holds.any()


def test_pairs_need_seeds_with_those_of_many_places(spark):
    """A pair's places in b count once each, and with b's seeds of many places; only pairs of LEAST_SEEDS are chained."""
    rows = [(1, 2, p, p, 0) for p in range(7)] + [(1, 3, p, p, 0) for p in range(6)] + [(1, 4, p, p, 1) for p in range(6)] + [(1, 5, p, 3, 5) for p in range(9)]
    got = collinear.chain_rows(spark.createDataFrame(rows, "a long, b long, pa int, pb int, h int"), least=collinear.K).collect()
    assert {(r.b, r.b0, r.b1) for r in got} == {(2, 0, 10), (4, 0, 9)}


def test_pairs_by_bytes_of_words_lose_none():
    """Looking at the last byte of words leaves every pair that whole words leave, and drops pairs without seeds in common."""
    r = np.random.default_rng(4)
    pairs = [(x, np.where(r.random(len(x)) < k % 10 / 10, r.integers(0, 2**32, len(x), dtype=np.uint32), x)) for k in range(50) for x in [r.integers(0, 2**32, 50 + 3 * k, dtype=np.uint32)]]
    n = np.array([len(x) for x, _ in pairs])
    x, y = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
    whole, by_byte = (collinear.may_hold(x.astype(t), y.astype(t), np.cumsum(n) - n, n, np.cumsum(n) - n, n, 50, 0.8) for t in (np.uint32, np.uint8))
    assert whole.any() and not by_byte.all() and not (whole & ~by_byte).any()

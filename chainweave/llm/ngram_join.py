"""Near-duplicate groups by a Jaccard join on word shingles with adaptive multi-match prefixes.

Shingles have one global order: by the level of an estimated document frequency, then by hash. A
document of n shingles that has a partner at similarity t shares at least ceil(t n) of them, so the
first n - ceil(t n) + L shingles of both partners have L in common at least. Each document picks
its own L from the estimated cost of its candidates: a longer prefix costs postings, but asks for
more matches. Two documents are candidates if they share min(L, L') prefix shingles, which holds
for every pair above the threshold. The estimate only steers cost; results are exact.

Groups of any size stay linear: equal sets are folded to one row first; then, in a few rounds, each
posting list links its documents to one leader, the links that verify are contracted to components,
and only lists that still join different components go on. What is left then is paired in full.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainweave.llm import bytewords as bw
from chainweave.llm.bounded import bloom, maybe_in
from chainweave.llm.rows import fresh_name, identified, keyed_join
from chainweave.operators.components import connected_components
from chainweave.session import read_table, stage_table

WORDS, PERCENT, ROUNDS = 5, 80, 2
#: The frequency sketch has 2**21 counters at any size of input.
SKETCH_BITS, PARTS, LEVELS = 21, 64, (1, 2, 4, 8, 16)
VERIFY_COST = 4.0


def needed(n: np.ndarray | int, percent: int = PERCENT):
    """Shingles that any partner shares with a set of n."""
    return (percent * n + 99) // 100


def doc_sets(batches: Iterator[pa.RecordBatch], k: int | Callable) -> Iterator[tuple[object, np.ndarray]]:
    """(doc_id, sorted distinct hashes) of every row of (doc_id, text): of k-word shingles, or what k itself gives of the batches."""
    if callable(k):
        yield from k(batches)
        return
    for batch in batches:
        ids = batch.column(0)
        for i, j, buf, off in bw.pieces(batch):
            h, first = bw.word_hashes(buf, off, bw.NOT_SPACE)
            for r in range(i, j):
                yield ids[r].as_py(), bw.shingles(h[first[r - i] : first[r - i + 1]], k)


def frequency_levels(docs: DataFrame, k: int) -> np.ndarray:
    """uint8 level of each counter: the logarithm of what it holds above the mean of all counters."""
    size, cut = 1 << SKETCH_BITS, bw.U(64 - SKETCH_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        held: list[np.ndarray] = []
        room = 0
        for _, s in doc_sets(batches, k):
            held.append((s >> cut).astype(np.int64))
            room += len(s)
            if room > 1 << 20:
                total += np.bincount(np.concatenate(held), minlength=size)
                held, room = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=size)
        if total.any():
            small = np.minimum(total, 65535).astype(np.uint16)
            rows = [x.tobytes() for x in np.split(small, PARTS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array(np.random.default_rng().integers(0, 64, PARTS), pa.int32()), pa.array(rows, pa.binary())], names=["part", "fan", "n"])

    def add(key: tuple, table: pa.Table) -> pa.Table:
        got = np.zeros(size // PARTS, dtype=np.uint32)
        for x in table.column("n"):
            raw = x.as_py()
            got += np.frombuffer(raw, dtype=np.uint16 if len(raw) == 2 * len(got) else np.uint32)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "fan": pa.array([0], pa.int32()), "n": pa.array([got.tobytes()], pa.binary())})

    kind = "part int, fan int, n binary"
    rows = docs.mapInArrow(count, kind).groupBy("part", "fan").applyInArrow(add, kind).groupBy("part").applyInArrow(add, kind).collect()  # 64 rows
    counts = np.zeros((PARTS, size // PARTS), dtype=np.uint32)
    for r in rows:
        counts[r["part"]] = np.frombuffer(bytes(r["n"]), dtype=np.uint32)
    mean = counts.mean()
    return np.concatenate([np.floor(np.log2(np.maximum(1.0, c - mean - 4 * np.sqrt(mean)))).astype(np.uint8) for c in counts])


def prefix(s: np.ndarray, levels: np.ndarray, percent: int) -> tuple[int, int, np.ndarray]:
    """(L, rarity, first shingles in the global order) of a set, L being the one of least estimated cost.

    Rarity is 0 to 255: low for a set of frequent shingles, which is the middle of its group.
    """
    n = len(s)
    need = int(needed(n, percent))
    level = levels[s >> bw.U(64 - SKETCH_BITS)]
    longest = min(n, n - need + LEVELS[-1])
    order = np.lexsort((s, level))[:longest]
    partners = np.cumsum(np.exp2(level[order].astype(np.float64)) - 1)
    best, cost = 1, None
    for ell in LEVELS:
        size = n - need + ell
        if ell > need or size > n:
            break
        c = size + VERIFY_COST * partners[size - 1] / ell
        if cost is None or c < cost:
            best, cost = ell, c
    return best, int(255 - 8 * level.mean()), s[order[: n - need + best]]


def sketch_sets(docs: DataFrame, levels: Broadcast, k: int, percent: int) -> DataFrame:
    """(doc_id, n, ell, rarity, set_key, prefix) of every document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "ell", "rarity", "set_key", "prefix"]

        def out(held: list) -> pa.RecordBatch:
            cols = list(zip(*held, strict=True))
            off = np.concatenate([[0], np.cumsum([len(x) for x in cols[5]])]).astype(np.int32)
            flat = pa.array(np.concatenate(cols[5]).view(np.int64))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.binary()), pa.ListArray.from_arrays(off, flat)], names=names)

        held: list = []
        for i, s in doc_sets(batches, k):
            ell, rarity, p = prefix(s, levels.value, percent) if len(s) else (1, 255, s)
            held.append((i, len(s), ell, rarity, hashlib.blake2b(s.tobytes(), digest_size=16).digest(), p))
            if len(held) == 500:
                yield out(held)
                held = []
        if held:
            yield out(held)

    return docs.mapInArrow(rows, "doc_id long, n long, ell int, rarity int, set_key binary, prefix array<long>")


def verified(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets have the similarity, from the texts."""
    wanted = bloom(pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = maybe_in(wanted.value, batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            batch = batch.filter(pa.array(keep))
            got = list(doc_sets([batch], k))
            if got:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in got], pa.int64()), pa.array([x[1].tobytes() for x in got], pa.binary())], names=["doc_id", "s"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), dtype=np.uint64), np.frombuffer(y.as_py(), dtype=np.uint64)
                both = np.sort(np.concatenate([x, y]))
                n = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * n >= percent * (len(x) + len(y) - n))
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    found = stage_table(docs.mapInArrow(sets, "doc_id long, s binary"), "sets")
    rows = pairs.join(found.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b")
    rows = rows.join(found.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a")
    return rows.select("a", "b", "sa", "sb").mapInArrow(judge, "a long, b long")


def groups(docs: DataFrame, k: int | Callable = WORDS, percent: int = PERCENT, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs (doc_id long, text string), whose doc_ids are unique and not null.

    Null and empty texts have no shingles and stay alone, as every document without a link does: its
    component is its own doc_id. Equal sets are linked.
    """
    known = docs
    levels = docs.sparkSession.sparkContext.broadcast(frequency_levels(known, k))
    every = stage_table(sketch_sets(docs, levels, k, percent), "prefixes")
    filled = every.where("n > 0")
    firsts = stage_table(filled.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows")), "firsts")
    reps = filled.join(firsts.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    post = reps.select("doc_id", (F.col("n") * 32 + F.col("ell")).alias("meta"), "rarity", F.posexplode("prefix").alias("pos", "tok"))
    post = post.select("tok", "doc_id", "meta", (F.col("pos").cast("long") * 256 + F.col("rarity")).alias("spot"))
    token = Window.partitionBy("tok")
    post = stage_table(post.withColumn("df", F.count("*").over(token)).where("df > 1").drop("df"), "shared")
    # Shingles before a posting that no other prefix has are in no partner that meets there: of the
    # others there are ``room``, which with those from the posting on must reach what a partner needs.
    before = Window.partitionBy("doc_id").orderBy("spot")
    post = post.withColumn("room", F.row_number().over(before) - 1)
    post = post.withColumn("after", F.count("*").over(Window.partitionBy("doc_id")) - 1 - F.col("room"))
    post = post.where(f"room + meta div 32 - spot div 256 >= ({percent} * (meta div 32) + 99) div 100")
    post = stage_table(post, "postings")

    def overlap(a: str, b: str) -> str:
        """Shingles that a linked pair shares at least, as SQL: ceil(t (n + m) / (1 + t))."""
        return f"(({percent} * ({a} div 32 + {b} div 32) + {99 + percent}) div {100 + percent})"

    def fits(a: str, b: str, i: str, j: str, r: str, q: str):
        """Whether two sets that meet at places i and j of the global order, with room r and q, can be alike at all."""
        n, m, i, j = f"({a} div 32)", f"({b} div 32)", f"({i} div 256)", f"({j} div 256)"
        return F.expr(f"100 * least({n}, {m}) >= {percent} * greatest({n}, {m}) and least({r}, {q}) + least({n} - {i}, {m} - {j}) >= {overlap(a, b)}")

    def matches(a: str, b: str):
        """Prefix shingles that a pair shares at least.

        Of the two, the one whose prefix ends first has all its matches up to there inside both
        prefixes, and need - L shingles behind it.
        """
        behind = F.greatest(*[F.expr(f"({percent} * ({x} div 32) + 99) div 100 - {x} % 32") for x in (a, b)])
        return F.greatest(F.least(F.col(a) % 32, F.col(b) % 32), F.expr(overlap(a, b)) - behind)

    links, open_ = None, post.withColumn("comp", F.col("doc_id"))
    for turn in range(rounds):
        # first the middle of each group leads, then a different document for each shingle
        first = (F.col("spot") % 256, F.xxhash64("doc_id")) if turn == 0 else (F.lit(0), F.xxhash64("doc_id", "tok", F.lit(turn)))
        lead = F.min(F.struct(first[0].alias("r"), first[1].alias("h"), "doc_id", "meta", "spot", "room", "comp")).over(token)
        pairs = open_.withColumn("lead", lead).where("lead.comp <> comp")
        pairs = pairs.select("doc_id", "meta", "spot", "room", *[F.col(f"lead.{c}").alias(f"lead_{c}") for c in ("doc_id", "meta", "spot", "room")])
        pairs = pairs.where(fits("meta", "lead_meta", "spot", "lead_spot", "room", "lead_room")).groupBy("doc_id", "lead_doc_id", "meta", "lead_meta").agg(F.count("*").alias("n"))
        # a pair may share more shingles, led by others: what is left out here comes up again below
        pairs = pairs.where(2 * F.col("n") >= matches("meta", "lead_meta")) if turn == 0 else pairs
        pairs = pairs.select(F.least("doc_id", "lead_doc_id").alias("a"), F.greatest("doc_id", "lead_doc_id").alias("b")).distinct()
        fresh = stage_table(verified(known, stage_table(pairs, "pairs"), k, percent), "links")
        links = fresh if links is None else links.unionByName(fresh)
        open_ = still_open(post, connected_components(links), token)
    # The first of the shingles that a pair must share has the others behind it in both prefixes, among
    # those that some other prefix has: meeting at that one is enough, and the rest is counted after.
    mine = open_.select("tok", F.col("doc_id").alias("a"), F.col("meta").alias("ma"), F.col("spot").alias("sa"), F.col("room").alias("ra"), F.col("after").alias("fa"), F.col("comp").alias("ca"))
    other = open_.select("tok", F.col("doc_id").alias("b"), F.col("meta").alias("mb"), F.col("spot").alias("sb"), F.col("room").alias("rb"), F.col("after").alias("fb"), F.col("comp").alias("cb"))
    pairs = mine.join(other, "tok").where("a < b and ca <> cb").where(fits("ma", "mb", "sa", "sb", "ra", "rb"))
    pairs = pairs.where(F.least("fa", "fb") + 1 >= matches("ma", "mb")).select("a", "b", "ma", "mb").distinct()
    pairs = sharing(stage_table(pairs, "pairs"), filled, matches("ma", "mb"))
    fresh = verified(known, stage_table(pairs, "pairs"), k, percent)
    comps = connected_components(links.unionByName(fresh)).select(F.col("node").alias("rep"), F.col("component"))
    lone = every.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    out = keyed_join(filled.select("doc_id", "n", "set_key"), firsts, ["set_key"], "rows", filled.count())
    out = out.join(comps, "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
    return out.unionByName(lone)


def sharing(pairs: DataFrame, sets: DataFrame, least: Column) -> DataFrame:
    """The pairs (a, b) whose prefixes share as many shingles as they must."""
    held = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("prefix").alias("pa")), "a")
    held = held.join(sets.select(F.col("doc_id").alias("b"), F.col("prefix").alias("pb")), "b")
    return held.where(F.size(F.array_intersect("pa", "pb")) >= least).select("a", "b").distinct()


def still_open(post: DataFrame, comps: DataFrame, token) -> DataFrame:
    """Postings of the tokens that stand in more than one component."""
    named = post.join(comps.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    named = named.select("tok", "doc_id", "meta", "spot", "room", "after", F.coalesce("component", "doc_id").alias("comp"))
    spread = named.withColumn("lo", F.min("comp").over(token)).withColumn("hi", F.max("comp").over(token))
    return stage_table(spread.where("lo < hi").select("tok", "doc_id", "meta", "spot", "room", "after", "comp"), "postings")


def near_duplicates(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs (doc_id, text), see ``groups``.

    Every row is a document of its own, whatever its doc_id: rows of one doc_id are linked only if their sets are alike.
    The component is the smallest doc_id in it, null where no row of it has one.
    """
    rows = identified(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    ids = rows.select("uid", "doc_id")
    out = groups(rows.select(F.col("uid").alias("doc_id"), "text"), k, percent, rounds).withColumnRenamed("doc_id", "uid")
    named = out.join(ids, "uid").join(ids.select(F.col("uid").alias("component_id"), F.col("doc_id").alias("first")), "component_id")
    return named.select("doc_id", "n_shingles", F.col("first").alias("component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """docs with one row of each group: the one of the smallest doc_id, or one of them. All columns are kept as they are."""
    name = fresh_name(docs, "uid")
    rows = identified(docs, name)
    dropped = groups(rows.select(F.col(name).alias("doc_id"), "text")).where("doc_id <> component_id").select(F.col("doc_id").alias(name))
    return rows.join(dropped, name, "left_anti").drop(name)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose 5-word shingles are alike to 0.8 or more."""
    return near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


OP1_SQL = r"""
with recursive w as (
  select doc_id, [x for x in string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') if x <> ''] as w from documents),
sh as (
  select distinct doc_id, md5_number(array_to_string(w[i:i + least(len(w), 5) - 1], ' ')) as s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) as i from w where len(w) > 0)),
n as (select doc_id, count(*) as n from sh group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
e as (select a as u, b as v from l union all select b, a from l),
r as (select u, v from e union select r.u, e.v from r join e on r.v = e.u)
select w.doc_id, coalesce(n.n, 0) as n_shingles, least(w.doc_id, coalesce(m.v, w.doc_id)) as component_id
from w left join n on n.doc_id = w.doc_id left join (select u, min(v) as v from r group by u) m on m.u = w.doc_id
"""

"""Removal of repeated byte strings by longest-previous-factor arrays, taken from suffix order.

A byte goes if it lies in a string of LENGTH bytes that starts elsewhere as well. For a suffix, its longest
match with an earlier suffix (the longest previous factor) is one of two: with the nearest smaller
position before it in suffix order, or with the nearest smaller one after it. The same over larger
positions gives the longest later match. A string of LENGTH bytes is repeated if such a factor is
that long.

To sort suffixes where they are, each window of LENGTH bytes is filed under its anchor: the 64-byte
gram of the least hash in it, which equal windows share at the same distance. Neighbouring windows
with one anchor form a run. Equal runs are folded to one, with a count. Where an anchor has several
different runs, their bytes go to one task, which sorts what follows the anchor and, reversed, what
stands before it; for each distance, suffixes of one left side are in suffix order by their right
sides. An anchor of more than CROWD different runs is split by window instead and settled by counts.

Folding rests on 128-bit hashes of whole runs, and so does splitting; all other matches compare bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainweave.llm import bytewords as bw
from chainweave.llm.bounded import bloom, maybe_in
from chainweave.llm.rows import identified, keyed_join
from chainweave.session import read_table, stage_table

LENGTH, GRAM = 400, 64
#: Different runs of one anchor that one task sorts (about 600 bytes each); bytes sorted at once.
CROWD, FLUSH = 20_000, 1 << 24
#: Longer texts are cut into overlapping segments of so many bytes; places in them take POSITION_BITS.
SEGMENT, POSITION_BITS = 1 << 23, bw.U(28)
KEY = ["anchor", "w1", "w2"]


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of every w consecutive values."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def cut_runs(buf: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(row, lo, hi, place, anchor) of the runs in texts buf[off[r]:off[r + 1]]: windows lo to hi, anchored at place."""
    n = len(buf) - length + 1
    if n <= 0:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(5))
    gram = min(GRAM, length)
    sums, at = bw.prefix_sums(buf), np.arange(len(buf) - gram + 1)
    grams = bw.span_hash(sums, at, at + gram)
    low = (bw.U(1) << POSITION_BITS) - bw.U(1)
    least = sliding_least((grams & ~low) | at.astype(np.uint64), length - gram + 1)
    place = (least & low).astype(np.int64)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    inside = np.flatnonzero(row[:n] == row[length - 1 :])
    if not len(inside):
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(5))
    turn = np.ones(len(inside), dtype=bool)
    turn[1:] = (place[inside[1:]] != place[inside[:-1]]) | (inside[1:] != inside[:-1] + 1)
    first = np.flatnonzero(turn)
    lo, hi = inside[first], inside[np.append(first[1:], len(inside)) - 1]
    return row[lo], lo, hi, place[lo], grams[place[lo]]


def segments(buf: np.ndarray, off: np.ndarray, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, byte of that row, bytes, offsets): the texts as they are, or overlapping parts of one long text."""
    if len(off) > 2 or len(buf) <= SEGMENT:
        yield 0, 0, buf, off
        return
    for s in range(0, len(buf) - length + 1, SEGMENT):
        part = buf[s : s + SEGMENT + length - 1]
        yield 0, s, part, np.array([0, len(part)])


def run_rows(docs: DataFrame, length: int) -> DataFrame:
    """(anchor, w1, w2, uid, lo, span, at) of every run of docs (uid, text): its windows start at bytes lo to lo + span, the anchor at lo + at."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, _, buf, off in bw.pieces(batch):
                for r, s, part, cut in segments(buf, off, length):
                    row, lo, hi, place, anchor = cut_runs(part, cut, length)
                    if not len(row):
                        continue
                    raw = part.tobytes()
                    both = np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(lo.tolist(), (hi + length).tolist(), strict=True)]), dtype=np.int64).reshape(-1, 2)
                    cols = [pa.array(anchor.view(np.int64)), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), pa.array(ids[i + r + row])]
                    cols += [pa.array(x.astype(np.int32)) for x in (lo - cut[row] + s, hi - lo, place - lo)]
                    yield pa.RecordBatch.from_arrays(cols, names=[*KEY, "uid", "lo", "span", "at"])

    return docs.select("uid", "text").mapInArrow(rows, "anchor long, w1 long, w2 long, uid long, lo int, span int, at int")


def run_texts(docs: DataFrame, reps: DataFrame, length: int) -> DataFrame:
    """reps (anchor, w1, w2, uid, lo, span, at) with their bytes (run), cut from the texts."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw, got = batch.column(1)[i].as_py().encode(), batch.column(2)[i].values
                cols = [got.field(j) for j in range(len(got.type))]
                lo, span = cols[3].to_numpy(), cols[4].to_numpy()
                run = pa.array([raw[a:b] for a, b in zip(lo.tolist(), (lo + span + length).tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*cols[:3], pa.array(np.full(len(lo), batch.column(0)[i].as_py()), pa.int64()), *cols[3:], run], names=[*KEY, "uid", "lo", "span", "at", "run"])

    asked = reps.groupBy("uid").agg(F.collect_list(F.struct(*KEY, "lo", "span", "at")).alias("runs"))  # bounded by the text's length
    return docs.select("uid", "text").join(asked, "uid").mapInArrow(cut, "anchor long, w1 long, w2 long, uid long, lo int, span int, at int, run binary")


def shared_starts(order: np.ndarray, group: np.ndarray, texts: list[bytes], width: int) -> np.ndarray:
    """Bytes that each text of an order shares with the one before it, 0 for the first of a group."""
    size = np.array([min(len(t), width) for t in texts], dtype=np.int64)
    out = np.zeros(len(order), dtype=np.int64)
    for i in range(0, len(order), 8192):
        part = order[max(0, i - 1) : i + 8192]
        m = np.frombuffer(b"".join([texts[k][:width].ljust(width, b"\0") for k in part]), dtype=np.uint8).reshape(len(part), width)
        same = np.append(m[1:] == m[:-1], np.zeros((len(part) - 1, 1), dtype=bool), axis=1)
        out[i + (i == 0) : i + 8192] = np.minimum(same.argmin(axis=1), np.minimum(size[part[1:]], size[part[:-1]]))
    new = np.append(True, group[order][1:] != group[order][:-1])
    out[new] = 0
    return out


class Least:
    """Minima of any stretch of an array, from minima of stretches of powers of two."""

    def __init__(self, x: np.ndarray) -> None:
        self.rows = [x]
        while len(self.rows[-1]) > 1 << (len(self.rows) - 1):
            last, step = self.rows[-1], 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(last[:-step], last[step:]))

    def over(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Minima of x[a:b], for a < b."""
        k = np.frexp((b - a).astype(float))[1] - 1
        out = np.empty(len(a), dtype=self.rows[0].dtype)
        for level in np.unique(k):
            m = k == level
            row = self.rows[level]
            out[m] = np.minimum(row[a[m]], row[b[m] - (1 << int(level))])
        return out


def nearest_smaller(value: np.ndarray, lcp: np.ndarray, least: int) -> np.ndarray:
    """Length of the match of each suffix with the nearest one before it in suffix order whose value is smaller.

    lcp[i] is the match of i with i - 1. Matches shorter than ``least`` count as 0. All suffixes between
    i and what it looks at have larger values, so that it may go on from there to where that one looks.
    """
    n = len(value)
    look, reach = np.arange(n) - 1, lcp.copy()
    todo = np.flatnonzero(reach >= least)
    reach[reach < least] = 0
    while len(todo):
        j = look[todo]
        todo = todo[value[j] > value[todo]]
        j = look[todo]
        reach[todo], look[todo] = np.minimum(reach[todo], reach[j]), look[j]
        todo = todo[reach[todo] >= least]
    return np.where(reach >= least, reach, 0)


def longest_factors(value: np.ndarray, lcp: np.ndarray, least: int) -> np.ndarray:
    """The longest match of each suffix with one of a smaller value, from suffix order; below ``least`` it is 0."""
    back = np.append(lcp[1:], 0)[::-1]
    return np.maximum(nearest_smaller(value, lcp, least), nearest_smaller(value[::-1], back, least)[::-1])


def repeated_windows(group: np.ndarray, at: np.ndarray, span: np.ndarray, texts: list[bytes], position: np.ndarray, length: int, keep_first: bool) -> tuple[np.ndarray, np.ndarray]:
    """(run, window of the run, from 0) of windows that other runs of their group have, or have earlier by ``position``.

    Runs are told by their anchor's group, the anchor's place in their bytes, their windows beyond the
    first, and their bytes.
    """
    m = len(texts)
    rights, lefts = [t[a:] for t, a in zip(texts, at.tolist(), strict=True)], [t[:a][::-1] for t, a in zip(texts, at.tolist(), strict=True)]
    right, left = (np.array(sorted(range(m), key=lambda i, s=s: (group[i], s[i]))) for s in (rights, lefts))
    after, before = Least(shared_starts(right, group, rights, length)), shared_starts(left, group, lefts, length)
    rank = np.empty(m, dtype=np.int64)
    rank[right] = np.arange(m)
    new = np.append(True, group[left][1:] != group[left][:-1])
    runs, windows = [], []
    for d in range(int((at - span).min()), int(at.max()) + 1):
        # suffixes that start d bytes before the anchor: one class for each text of those d bytes
        one = np.empty(m, dtype=np.int64)
        one[left] = np.cumsum(new | (before < d))
        here = np.flatnonzero((at >= d) & (at - span <= d))
        here = here[np.argsort(one[here] * m + rank[here])]
        pair = np.flatnonzero(one[here[1:]] == one[here[:-1]]) + 1
        if not len(pair):
            continue
        lcp = np.zeros(len(here), dtype=np.int64)
        lcp[pair] = d + after.over(rank[here[pair - 1]] + 1, rank[here[pair]] + 1)
        factor = longest_factors(position[here], lcp, length)
        if not keep_first:
            factor = np.maximum(factor, longest_factors(-position[here], lcp, length))
        hit = here[factor >= length]
        runs.append(hit)
        windows.append(at[hit] - d)
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *runs]), np.concatenate([none, *windows])


def sorted_windows(texts: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """(anchor, w1, w2, from, to): windows of the runs of texts that others of their anchor have."""

    def settle(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        col = {c: t.column(c).to_numpy() for c in (*KEY, "uid", "lo", "span", "at")}
        at, span = col["at"].astype(np.int64), col["span"].astype(np.int64)
        position = np.empty(len(at), dtype=np.int64)
        position[np.lexsort((col["lo"] + at, col["uid"]))] = np.arange(len(at))
        run, window = repeated_windows(col["anchor"], at, span, t.column("run").to_pylist(), position, length, keep_first)
        order = np.lexsort((window, run))
        run, window = run[order], window[order]
        first = np.flatnonzero(np.append(True, (run[1:] != run[:-1]) | (window[1:] != window[:-1] + 1))) if len(run) else run
        last = np.append(first[1:], len(run))[: len(first)] - 1
        cols = [pa.array(col[c][run[first]]) for c in KEY] + [pa.array(window[x].astype(np.int32)) for x in (first, last)]
        return pa.RecordBatch.from_arrays(cols, names=[*KEY, "from", "to"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            while batch.num_rows:
                if size > FLUSH:  # up to the end of an anchor's rows
                    anchors = batch.column(0).to_numpy()
                    end = int(np.argmin(np.append(anchors == held[-1].column(0)[-1].as_py(), False)))
                    if end < batch.num_rows:
                        if end:
                            held.append(batch.slice(0, end))
                        yield settle(held)
                        held, size, batch = [], 0, batch.slice(end)
                        continue
                held.append(batch)
                size += batch.nbytes
                break
        if held:
            yield settle(held)

    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = texts.repartition(n, "anchor").sortWithinPartitions("anchor")
    return laid.mapInArrow(walk, "anchor long, w1 long, w2 long, from int, to int")


def counted_windows(texts: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """The same for anchors of any number of runs: one row a window, counted by the window's hash."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                run, span = batch.column(7)[i].as_py(), batch.column(5)[i].as_py()
                both = np.frombuffer(b"".join([xxhash.xxh3_128_digest(run[s : s + length]) for s in range(span + 1)]), dtype=np.int64).reshape(-1, 2)
                fixed = [pa.array(np.full(span + 1, batch.column(j)[i].as_py()), pa.int64()) for j in range(4)]
                place = batch.column(4)[i].as_py() + np.arange(span + 1)
                yield pa.RecordBatch.from_arrays([*fixed, pa.array(place.astype(np.int32)), pa.array(np.arange(span + 1, dtype=np.int32)), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=[*KEY, "uid", "s", "window", "h1", "h2"])

    w = stage_table(texts.mapInArrow(rows, "anchor long, w1 long, w2 long, uid long, s int, window int, h1 long, h2 long"), "windows")
    kept = F.min(F.struct("uid", "s")) if keep_first else F.lit(None).cast("struct<uid:bigint,s:int>")
    found = stage_table(w.groupBy("anchor", "h1", "h2").agg(F.count("*").alias("n"), kept.alias("kept")).where("n > 1"), "windows")
    hit = keyed_join(w, found, ["anchor", "h1", "h2"], "n", w.count())
    if keep_first:
        hit = hit.where("uid <> kept.uid or s <> kept.s")
    return hit.select(*KEY, F.col("window").alias("from"), F.col("window").alias("to"))


def repeated(docs: DataFrame, length: int = LENGTH, keep_first: bool = False, crowd: int = CROWD) -> DataFrame:
    """(uid, lo, hi) for docs (uid, text): windows lo to hi of a text also start elsewhere.

    With keep_first only windows that have a copy before them count, in order of uid and place.
    """
    runs = stage_table(run_rows(docs, length), "runs")
    first = F.min(F.struct("uid", "lo")) if keep_first else F.struct(F.first("uid").alias("uid"), F.first("lo").alias("lo"))
    wholes = runs.groupBy(*KEY).agg(F.count("*").alias("n"), F.first("span").alias("span"), F.first("at").alias("at"), first.alias("rep"))
    wholes = stage_table(wholes, "wholes")
    anchors = wholes.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
    mixed = stage_table(keyed_join(wholes, stage_table(anchors, "anchors"), ["anchor"], "kinds", wholes.count()), "mixed")
    texts = run_texts(docs, mixed.select(*KEY, "rep.uid", "rep.lo", "span", "at"), length)
    crowded = mixed.where(F.col("kinds") > crowd).select("anchor").distinct()
    if crowded.isEmpty():
        parts = sorted_windows(texts, length, keep_first)
    else:
        texts = stage_table(texts, "texts")
        sizes = mixed.groupBy("anchor").agg(F.max("kinds").alias("kinds"))
        texts = keyed_join(texts, sizes, ["anchor"], "kinds", wholes.count())
        names = [*KEY, "uid", "lo", "span", "at", "run"]
        parts = sorted_windows(texts.where(F.col("kinds") <= crowd).select(*names), length, keep_first)
        parts = parts.unionByName(counted_windows(texts.where(F.col("kinds") > crowd).select(*names), length, keep_first))
    parts = parts.groupBy(*KEY).agg(F.collect_list(F.struct("from", "to")).alias("parts"))  # at most one for each window of a run
    found = wholes.join(parts, KEY, "left")
    found = stage_table(found.where("n > 1 or parts is not null").select(*KEY, "n", "rep", "parts"), "found")
    hit = keyed_join(runs, found, KEY, "n", runs.count())
    # a repeated run goes as a whole, but for the first one if that is kept
    all_of_it = F.expr("n > 1 and (uid <> rep.uid or lo <> rep.lo)") if keep_first else F.expr("n > 1")
    spans = F.when(all_of_it, F.array(F.struct(F.lit(0).alias("from"), F.col("span").alias("to")))).otherwise(F.col("parts"))
    hit = hit.select("uid", "lo", F.explode(spans).alias("p"))
    return hit.select("uid", (F.col("lo") + F.col("p.from")).alias("lo"), (F.col("lo") + F.col("p.to")).alias("hi"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep_first: bool = False, with_kept: bool = True, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (binary) for every row of docs (doc_id, text).

    Null texts are empty and texts shorter than ``length`` keep all. Every row is a document of its own, whatever
    its doc_id: equal rows are copies of each other, and with keep_first the first of them in order of reading stays.
    Null doc_ids come last.
    """
    docs = identified(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))
    spans = stage_table(repeated(docs, length, keep_first, crowd), "spans")
    spans = spans.groupBy("uid").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))  # at most one for each byte of the text
    wanted = bloom(spans.select("uid"))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(maybe_in(wanted.value, batch.column(0).to_numpy(zero_copy_only=False))))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, text, got in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                raw = np.frombuffer(text.encode(), dtype=np.uint8)
                depth = np.zeros(len(raw) + 1, dtype=np.int32)
                np.add.at(depth, [x["lo"] for x in got], 1)
                np.add.at(depth, [x["hi"] + length for x in got], -1)
                gone = np.cumsum(depth)[:-1] > 0
                left = raw[~gone].tobytes()
                out.append((i, int(gone.sum()), int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1)), hashlib.sha256(left).hexdigest(), left if with_kept else None))
            names = ["uid", "n_removed", "n_spans", "kept_sha256", "kept"]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], names=names)

    texts = docs.select("uid", "text").mapInArrow(some, "uid long, text string")
    done = texts.join(spans, "uid").select("uid", "text", "spans").mapInArrow(cut, "uid long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    sizes = docs.select("uid", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole_sha256"), *([F.col("text")] if with_kept else []))
    out = sizes.join(done, "uid", "left")
    zero = F.lit(0).cast("long")
    return out.select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", zero).alias("n_removed"),
        F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"),
        *([F.coalesce("kept", F.col("text").cast("binary")).alias("kept")] if with_kept else []),
    )


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated strings of 400 bytes."""
    return remove_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"), with_kept=False)

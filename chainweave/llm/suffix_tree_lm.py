"""A probabilistic suffix tree over words, learned and applied as Spark jobs.

Symbols are words, the end of a text, and one unknown word. The root has the smoothed share of every word in
the training texts. A context of d words is a state if it occurs LEAST_CONTEXT times, its shorter suffix
is a state, and the divergence of its next-symbol distribution from that of the suffix pays for
its size. Next symbols that occur once after a context are left to the suffix; the others are smoothed with it:

    P(w | context) = (count + left * P(w | suffix)) / (count of the context + SMOOTH),  left = SMOOTH + those that occur once

which sums to 1 over all words and the unknown one. The longest state that ends the words before a place
gives the probability there. Its logarithm is a sum: a weight of the word, one for each suffix of the
longest state (how much is left to shorter ones), and one for each entry (suffix, word) that there is. So
the tree is one table of weights by hash of word sequences, and it grows with the corpus: nothing of it
is kept by share or collected. Weights of a share of LOCAL_SHARE are also sent to all tasks (1 / share of each
kind at most); texts ask the table for the others, and sums by text come back.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainweave.llm import bytewords as bw
from chainweave.llm.bounded import bloom, maybe_in
from chainweave.llm.language import held_out
from chainweave.session import read_table, release, stage_table

DEPTH, LEAST_CONTEXT, LEAST_ENTRY, SMOOTH = 2, 32, 2, 20.0
LOCAL_SHARE = 4e-6
#: Hash ranges of counts and weights; tokens counted, and answers added up, at once; documents asked for at once.
BUCKET_BITS, FLUSH, PART_DOCS = 12, 1_500_000, 60_000
#: Bits of the filter of weights that may be asked for, 16 MB: it lets one absent key of fifty through at 10 million weights and is full at some hundred million.
KNOWN_BITS = 27
END = bw.mix(np.array([0x656E64], dtype=np.uint64))[0]
FOLD = bw.U(0xD6E8FEB86659FD93)
LEFT = bw.U(0x5851F42D4C957F2D)


def longer(before: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Keys of sequences of d + 1 words from those of d words that end one word before, and with, the last word."""
    return bw.mix(before * FOLD + last)


def rest_key(context: np.ndarray) -> np.ndarray:
    """Keys of a context's weight for what it leaves to its suffix."""
    return bw.mix(context ^ LEFT)


def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every token of the texts: lower-cased words and an end each."""
    h, first = bw.word_hashes(buf, off, bw.NOT_SPACE)
    n = len(off) - 1
    row = np.repeat(np.arange(n), np.diff(first))
    out = np.full(len(h) + n, END, dtype=np.uint64)
    out[np.arange(len(h)) + row] = h
    return np.repeat(np.arange(n), np.diff(first) + 1), out


def bucket_of(key: np.ndarray) -> np.ndarray:
    return (bw.mix(key) >> bw.U(64 - BUCKET_BITS)).astype(np.int64)


COUNTED = "bucket int, a binary, b binary, n binary"


def within(key: np.ndarray) -> np.ndarray:
    """What tells keys of one bucket apart, in the high bits; the low byte is 0."""
    return bw.mix(key) << bw.U(BUCKET_BITS)


def packed(bucket: np.ndarray, cols: list[np.ndarray], names: list[str], short: bool = False) -> pa.RecordBatch:
    """One row for each bucket that occurs, with its values of every column as bytes; if short, the first one's without their low byte."""
    order = np.argsort(bucket.astype(np.uint16), kind="stable")  # by counting, as buckets are few
    at = bucket[order]
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.zeros(0, dtype=np.int64)
    ends = np.append(first, len(at))
    out = [pa.array(at[first].astype(np.int32))]
    for i, c in enumerate(cols):
        raw = np.ascontiguousarray(c[order])
        size = raw.itemsize
        if short and not i:
            raw, size = np.ascontiguousarray(raw.view(np.uint8).reshape(-1, 8)[:, 1:]), 7
        out.append(pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((ends * size).astype(np.int32)), pa.py_buffer(raw)]))
    return pa.RecordBatch.from_arrays(out, names=["bucket", *names])


def summed(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs (a, b) with their n added up."""
    h = longer(a, b)
    order = np.argsort(h)  # one sort of hashes takes a quarter of the time of one by a and b
    h, a, b, n = h[order], a[order], b[order], n[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])) if len(a) else np.zeros(0, dtype=bool)
    if (new[1:] & (h[1:] == h[:-1])).any():  # pairs of one hash may lie mixed
        order = np.lexsort((b, a))
        a, b, n = a[order], b[order], n[order]
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
    first = np.flatnonzero(new)
    return a[first], b[first], np.add.reduceat(n, first) if len(first) else n


def joined(col: pa.Array, lo: int, hi: int, kind: type) -> np.ndarray:
    """The bytes of rows lo to hi of a binary column, which stand one behind the other, as values of a kind."""
    col = col.cast(pa.large_binary())
    off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset + lo : col.offset + hi + 1]
    return np.frombuffer(col.buffers()[2] or b"", dtype=np.uint8)[off[0] : off[-1]].view(kind)


def widened(raw: np.ndarray) -> np.ndarray:
    """Values from their bytes without the low one."""
    out = np.zeros((len(raw) // 7, 8), dtype=np.uint8)
    out[:, 1:] = raw.reshape(-1, 7)
    return out.view(np.uint64).reshape(-1)


def runs(*cols: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, end) of the runs of rows that are equal in all columns."""
    n = len(cols[0])
    new = np.zeros(max(0, n - 1), dtype=bool)
    for c in cols:
        new |= c[1:] != c[:-1]
    cut = [0, *(np.flatnonzero(new) + 1).tolist(), n] if n else []
    return zip(cut[:-1], cut[1:], strict=True)


def firsts(table: np.ndarray) -> np.ndarray:
    """For each prefix of hashes, two or more for each key of the sorted table up to 2**22, the first place of those that have it or a higher one; then the length."""
    bits = min(22, max(1, len(table).bit_length() + 1))
    return np.append(0, np.cumsum(np.bincount((table >> bw.U(64 - bits)).astype(np.int64), minlength=1 << bits)))


def spots(table: np.ndarray, first: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is in the sorted table of hashes, and the places of those that are. ``first`` is that of ``firsts``."""
    prefix = (keys >> bw.U(65 - len(first).bit_length())).astype(np.int64)
    at, end = first[prefix], first[prefix + 1]
    hit = np.zeros(len(keys), dtype=bool)
    left = np.flatnonzero(at < end)
    while len(left):
        same = table[at[left]] == keys[left]
        hit[left[same]] = True
        left = left[~same]
        at[left] += 1
        left = left[at[left] < end[left]]
    return hit, at[hit]


def pair_counts(train: DataFrame, pairs, least: int = 1) -> DataFrame:
    """(a, b, n) of the distinct pairs of keys that ``pairs(row, key)`` gives of each piece of train (text), counted, if they occur ``least`` times."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            a, b = (np.concatenate(c) for c in zip(*held, strict=True))
            a, b, n = summed(a, b, np.ones(len(a), dtype=np.int64))
            order = np.argsort(a)  # equal values beside each other take less room
            a, b, n = a[order], b[order], n[order]
            return packed(bucket_of(a), [a, b, n.astype(np.uint32)], ["a", "b", "n"])

        for batch in batches:
            for _, _, buf, off in bw.pieces(batch):
                held.append(pairs(*tokens(buf, off)))
                size += len(held[-1][0])
                if size > FLUSH:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        now, size, limit = None, 0, FLUSH

        def settle() -> tuple[np.ndarray, ...]:
            a, b, n = (np.concatenate(c) for c in zip(*held, strict=True))
            return summed(a, b, n.astype(np.int64))

        def rows(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            if least > 1:
                a, b, n = (x[n >= least] for x in (a, b, n))
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(n)], names=["a", "b", "n"])

        for batch in batches:
            buckets = batch.column(0).to_numpy()
            for lo, hi in runs(buckets):
                if held and buckets[lo] != now:
                    yield rows(*settle())
                    held, size, limit = [], 0, FLUSH
                now = buckets[lo]
                held.append(tuple(joined(batch.column(c), lo, hi, k) for c, k in ((1, np.uint64), (2, np.uint64), (3, np.uint32))))
                size += len(held[-1][0])
                if size > limit:  # equal pairs are folded as they come
                    held = [settle()]
                    size = len(held[0][0])
                    limit = max(FLUSH, 2 * size)
        if held:
            yield rows(*settle())
            held = []
        bw.give_back()

    parts = int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = train.select("text").mapInArrow(count, COUNTED).repartition(parts, "bucket").sortWithinPartitions("bucket")
    return laid.mapInArrow(add, "a long, b long, n long")


@dataclass
class Tree:
    """Size of the training texts, the number of states of each depth, and the table of weights (key, word, rest, n, value)."""

    n: int
    v: int
    weights: DataFrame
    states: list[int]


def sequences(row: np.ndarray, key: np.ndarray, depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For d of 0 to depth: places and keys of the sequences of d + 1 tokens that end there, within a row."""
    at, k = np.arange(len(key)), key
    out = [(at, k)]
    for d in range(1, depth + 1):
        inside = row[d:] == row[:-d] if d < len(row) else np.zeros(0, dtype=bool)
        full = np.zeros(len(key), dtype=np.uint64)
        full[out[-1][0]] = out[-1][1]
        at = d + np.flatnonzero(inside)
        out.append((at, longer(full[at - 1], full[at])))
    return out


def learn(train: DataFrame, depth: int = DEPTH, least_context: int = LEAST_CONTEXT) -> Tree:
    """The tree of train (text), of contexts of up to ``depth`` words."""

    def single(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return key, np.zeros(len(key), dtype=np.uint64)

    words = stage_table(pair_counts(train, single).select(F.col("a").alias("key"), "n"), "words")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    size = total["n"] + 0.5 * (total["v"] + 1)
    # a weight is log10 of the probability over that of the unknown word
    weights = words.select("key", F.lit(True).alias("word"), F.lit(False).alias("rest"), "n", F.log10((F.col("n") + 0.5) / 0.5).alias("value"))
    parents = words.select("key", ((F.col("n") + 0.5) / size).alias("p"))
    contexts = words.where((F.col("n") >= least_context) & (F.col("key") != int(np.int64(END.astype(np.int64))))).select(F.col("key").alias("context"), F.col("n").alias("total"))
    states, used = [], [words]
    for d in range(1, depth + 1):
        wanted = bloom(contexts.select("context"))

        def pairs(row: np.ndarray, key: np.ndarray, d=d, wanted=wanted) -> tuple[np.ndarray, np.ndarray]:
            at, k = sequences(row, key, d - 1)[-1]
            full = np.zeros(len(key), dtype=np.uint64)
            full[at] = k
            at = at[1:][(row[at[1:]] == row[at[1:] - 1]) & (at[1:] == at[:-1] + 1)] if len(at) else at
            some = maybe_in(wanted.value, full[at - 1].view(np.int64)) if len(at) else np.zeros(0, dtype=bool)
            return full[at[some] - 1], full[at[some]]

        counted = pair_counts(train, pairs, LEAST_ENTRY).select(F.col("a").alias("context"), F.col("b").alias("key"), "n")
        entries = counted.join(contexts, "context").join(parents, "key")  # a third of one word's followers is still one row each
        entries = stage_table(entries.select("context", F.col("key").alias("last"), "n", "p", "total"), "entries")
        sums = entries.groupBy("context", "total").agg(F.sum("n").alias("t"), F.count("*").alias("k"), F.sum("p").alias("s"), F.sum(F.col("n") * F.log(F.col("n") / F.col("total") / F.col("p"))).alias("g"))
        rest = "if(total > t, (total - t) * ln((total - t) / total / greatest(1 - s, 1e-12)), 0)"
        kept = sums.where(F.expr(f"g + {rest} >= 0.5 * k * {np.log(max(2, total['n']))}"))
        kept = kept.select("context", F.expr(f"total - t + {SMOOTH}").alias("left"), F.expr(f"total + {SMOOTH}").alias("t"), "total")
        kept = stage_table(kept, "states")
        states.append(kept.count())
        used.append(kept)
        if not states[-1]:
            release(entries)
            break
        got = entries.drop("total").join(kept.drop("total"), "context")
        got = stage_table(with_key(got).select("key", "n", "p", "left", "t"), "entries")
        release(entries)
        used.append(got)
        weights = weights.unionByName(got.select("key", F.lit(False).alias("word"), F.lit(False).alias("rest"), "n", F.log10(1 + F.col("n") / (F.col("left") * F.col("p"))).alias("value")))
        weights = weights.unionByName(with_key(kept, rest=True).select("key", F.lit(False).alias("word"), F.lit(True).alias("rest"), F.col("total").alias("n"), F.log10(F.col("left") / F.col("t")).alias("value")))
        parents = got.select("key", ((F.col("n") + F.col("left") * F.col("p")) / F.col("t")).alias("p"))
        contexts = got.where(F.col("n") >= least_context).select(F.col("key").alias("context"), F.col("n").alias("total"))
    weights = stage_table(weights, "weights")
    release(*used)
    return Tree(total["n"], total["v"], weights, states)


def with_key(rows: DataFrame, rest: bool = False) -> DataFrame:
    """rows (context, last, n, p, t; or context, t) with the key of the longer sequence, or of the context's rest."""
    names = [c for c in rows.columns if c not in ("context", "last")]
    kinds = dict(rows.dtypes)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            context = batch.column(0).to_numpy().view(np.uint64)
            key = rest_key(context) if rest else longer(context, batch.column(1).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *batch.columns[1 if rest else 2 :]], names=["key", *names])

    return rows.select("context", *([] if rest else ["last"]), *names).mapInArrow(keys, ", ".join(["key long", *[f"{c} {kinds[c]}" for c in names]]))


ASKED = "bucket int, side int, part long, a binary, b binary, c binary, ids array<long>, held array<boolean>"
ANSWER = "part long, ids array<long>, held array<boolean>, rows binary, sums binary"


def weight_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ASKED rows (side 0) of the weights (key, word, value), packed by bucket."""
    held: list[pa.RecordBatch] = []
    size = 0

    def flush() -> pa.RecordBatch:
        key, word, value = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in range(3))
        p = packed(bucket_of(key.view(np.uint64)), [within(key.view(np.uint64)), value, word], ["a", "b", "c"], short=True)
        n = p.num_rows
        cols = [p.column(0), pa.array(np.zeros(n, dtype=np.int32)), pa.array(np.zeros(n, dtype=np.int64)), *p.columns[1:], pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.bool_()))]
        return pa.RecordBatch.from_arrays(cols, names=["bucket", "side", "part", "a", "b", "c", "ids", "held"])

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size > FLUSH:  # a row of a bucket has many weights
            yield flush()
            held, size = [], 0
    if size:
        yield flush()
        held = []
    bw.give_back()


def score(docs: DataFrame, tree: Tree) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for docs (doc_id, text, held_out).

    Null texts are empty: one end. Every row is scored by itself, whatever its doc_id. Without training texts
    every count is 0.
    """
    spark, depth = docs.sparkSession, len(tree.states)
    local = tree.weights.where(F.col("n") >= max(1.0, LOCAL_SHARE * tree.n)).select("key", "word", "value").toPandas()  # 1 / LOCAL_SHARE of each kind at most
    order = np.argsort(local["key"].to_numpy().view(np.uint64))
    near = spark.sparkContext.broadcast((local["key"].to_numpy().view(np.uint64)[order], local["word"].to_numpy()[order], local["value"].to_numpy()[order]))
    far = tree.weights.where(F.col("n") < max(1.0, LOCAL_SHARE * tree.n)).select("key", "word", "value")
    # words are asked for in any case, other weights only after a state, which are few
    states, known = bloom(tree.weights.where("rest").select("key")), bloom(far.where("not word").select("key"), KNOWN_BITS)

    def asked_keys(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and keys of every weight that the texts may have: first the words, then what comes after states.

        A state's own suffix, and the context that it goes on, are states, so that those of d + 1 words stand after those of d.
        """
        rows, keys = [row], [key]
        at, k = np.arange(len(key)), key  # places where sequences of d + 1 words end, and their keys
        for _ in range(depth):
            on = np.flatnonzero((at[1:] == at[:-1] + 1) & (row[at[1:]] == row[at[:-1]]))
            rest = rest_key(k[on])
            some = maybe_in(states.value, rest.view(np.int64))
            on = on[some]
            at, k = at[on + 1], longer(k[on], k[on + 1])
            rows += [row[at], row[at]]
            keys += [rest[some], k]
        return np.concatenate(rows), np.concatenate(keys)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For a part of some rows: what is known of them here (side 2), and what isn't by hash range (side 1)."""
        words, is_word, value = near.value
        first = firsts(words)
        done = 0
        for batch in batches:
            for i, j, buf, off in bw.pieces(batch, limit=4 << 20):
                for lo in range(0, j - i, PART_DOCS):
                    cut = off[lo : lo + PART_DOCS + 1]
                    m = len(cut) - 1
                    row, key = tokens(buf[cut[0] : cut[-1]], cut - cut[0])
                    rows, keys = asked_keys(row, key)
                    here, at = spots(words, first, keys)
                    w, x = is_word[at], value[at]
                    sums = np.stack([np.bincount(row, minlength=m), np.bincount(rows[here], w, minlength=m), np.bincount(rows[here], x * w, minlength=m), np.bincount(rows[here], x * ~w, minlength=m)]).astype(np.float64)
                    part = (TaskContext.get().partitionId() << 24) + done
                    done += 1
                    ids, flags = (batch.column(c).slice(i + lo, m) for c in (0, 2))
                    null = pa.nulls(1, pa.binary())
                    head = [pa.array(bucket_of(np.array([part], dtype=np.uint64)), pa.int32()), pa.array([2], pa.int32()), pa.array([part], pa.int64()), pa.array([sums.tobytes()], pa.binary()), null, null, pa.ListArray.from_arrays(pa.array([0, m], pa.int32()), ids), pa.ListArray.from_arrays(pa.array([0, m], pa.int32()), flags)]
                    yield pa.RecordBatch.from_arrays(head, names=["bucket", "side", "part", "a", "b", "c", "ids", "held"])
                    plain = np.count_nonzero(~here[: len(key)])
                    rows, keys = rows[~here].astype(np.uint16), keys[~here]
                    some = np.append(np.ones(plain, dtype=bool), maybe_in(known.value, keys[plain:].view(np.int64), KNOWN_BITS))
                    p = packed(bucket_of(keys[some]), [within(keys[some]), rows[some]], ["a", "b"], short=True)
                    n = p.num_rows
                    cols = [p.column(0), pa.array(np.ones(n, dtype=np.int32)), pa.array(np.full(n, part)), p.column(1), p.column(2), pa.nulls(n, pa.binary()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.bool_()))]
                    yield pa.RecordBatch.from_arrays(cols, names=["bucket", "side", "part", "a", "b", "c", "ids", "held"])
                bw.give_back()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums by part and row of the weights asked for; a bucket's weights come before its questions."""
        now, have, found = None, [], None
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            place, known_, base, more = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.argsort(place)
            place = place[order]
            first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
            sums = np.stack([np.add.reduceat(x[order], first) for x in (known_, base, more)])
            part, row = place[first] >> 16, place[first].astype(np.uint16)
            cut = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            ends = np.append(cut, len(part))
            out = [(int(part[lo]), row[lo:hi].tobytes(), sums[:, lo:hi].tobytes()) for lo, hi in zip(ends[:-1], ends[1:], strict=True)]
            cols = list(zip(*out, strict=True))
            n = len(out)
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.bool_())), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], names=["part", "ids", "held", "rows", "sums"])

        for batch in batches:
            buckets, sides, parts_ = (batch.column(c).to_numpy() for c in range(3))
            for lo, hi in runs(buckets, sides):
                bucket, side = buckets[lo], sides[lo]
                if side == 2:  # what a part knows by itself goes on
                    own = batch.slice(lo, hi - lo)
                    yield pa.RecordBatch.from_arrays([own.column(2), own.column(6), own.column(7), pa.nulls(hi - lo, pa.binary()), own.column(3)], names=["part", "ids", "held", "rows", "sums"])
                    continue
                if bucket != now:
                    now, have, found = bucket, [], None
                if side == 0:
                    have.append(tuple(joined(batch.column(c), lo, hi, k) for c, k in ((3, np.uint8), (4, np.float64), (5, np.bool_))))
                    continue
                if not have:
                    continue
                if found is None:
                    key, value, word = (np.concatenate(c) for c in zip(*have, strict=True))
                    key = widened(key)
                    order = np.argsort(key)
                    found = key[order], value[order], word[order], firsts(key[order])
                key, value, word, first = found
                keys, rows = widened(joined(batch.column(3), lo, hi, np.uint8)), joined(batch.column(4), lo, hi, np.uint16)
                ends = np.frombuffer(batch.column(4).cast(pa.large_binary()).buffers()[1], dtype=np.int64)[batch.column(4).offset + lo : batch.column(4).offset + hi + 1]
                place = (np.repeat(parts_[lo:hi], np.diff(ends) // 2) << 16) | rows
                hit, at = spots(key, first, keys)
                w, x = word[at], value[at]
                held.append((place[hit], w.astype(np.float64), x * w, x * ~w))
                size += len(x)
                if size > FLUSH:
                    yield flush()
                    held, size = [], 0
                    bw.give_back()
        if size:
            yield flush()
            held = []
        bw.give_back()

    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
    size = tree.n + 0.5 * (tree.v + 1)

    def total(key: tuple, got: pa.Table) -> pa.Table:
        """All rows of one part, whose number is bounded."""
        ids = flags = sums = None
        more = []
        for i, f, rows, x in zip(*[got.column(c).to_pylist() for c in ("ids", "held", "rows", "sums")], strict=True):
            if i is not None:
                ids, flags, sums = i, f, np.frombuffer(x, dtype=np.float64).reshape(4, -1).copy()
            else:
                more.append((np.frombuffer(rows, dtype=np.uint16).astype(np.int64), np.frombuffer(x, dtype=np.float64).reshape(3, -1)))
        for rows, x in more:
            for c in range(3):
                np.add.at(sums[c + 1], rows, x[c])
        base = sums[0] * np.log10(0.5 / size) + sums[2]
        cols = [ids, flags, sums[0].round().astype(np.int64), sums[1].round().astype(np.int64), base, base + sums[3]]
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = docs.select("doc_id", "text", "held_out").mapInArrow(ask, ASKED).unionByName(far.mapInArrow(weight_rows, ASKED))
    got = both.repartition(parts, "bucket").sortWithinPartitions("bucket", "side").mapInArrow(answer, ANSWER)
    out = got.groupBy("part").applyInArrow(total, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tree.n).cast("long").alias("train_tokens"), "base_score", "score")


def op4_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability under a tree learned from four of five."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(held_out(5, 1), F.lit(False)).alias("held_out"))
    return score(docs, learn(docs.where("not held_out")))

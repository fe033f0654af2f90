"""Alignment of two tokenizers' tokens over the same bytes, each distinct segment of text once.

A text is cut before runs of white space, at those characters only that no token of either vocabulary holds
behind another character, so that neither tokenizer can merge across a cut. Documents are packed into blocks of
bounded bytes: the block's distinct segments, and each document as places among them. Distinct segments of all blocks
are tokenized and aligned once, with the places that they have in blocks; then each block meets the alignments of its
segments and composes its documents.

Defined results: a null or empty text, and one of which a tokenizer doesn't give back the bytes, has no tokens, counts
of 0 and an empty alignment, and adds nothing to any count; rows of one doc_id, or of none, are documents of their own;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainweave.llm.rows import keyed_join
from chainweave.session import read_table, stage_table

FOLDER = "/opt/tokenizers"
BYTE_BPE, PIECE_BPE = f"{FOLDER}/byte_bpe_50k.json", f"{FOLDER}/piece_bpe_32k.model"
#: Bytes of text of a block of documents; a longer text is a block of its own.
BLOCK_BYTES = 14 << 20
#: Bytes of text that are cut, and segments that are composed, at a time.
PART_BYTES, PART_SEGMENTS = 1 << 20, 1 << 18
#: Blocks whose places of a segment are kept in one row: 56 GB of text. A segment is aligned once for each so many.
LISTED_BLOCKS = 4096
#: Id pairs up to which their counts are broadcast (20 bytes each); beyond it they are joined.
MAX_BROADCAST_PAIRS = 1 << 20
#: White space of either tokenizer's splitting rule.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
WIDE_SPACES = [c.encode() for c in SPACES if ord(c) > 127]
BLOCK = "block long, doc_id array<long>, ends array<long>, words binary, segs array<string>, n array<long>"
SEGMENT = "ok boolean, n_a long, groups string, links array<struct<a:int,b:int,k:long>>, n long, places array<struct<block:long,pos:int>>"
DOCUMENT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
SCORED = ["places", "ok", "n_a", "groups", "n_best", "count_sum"]
COUNTS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def _byte_of() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@functools.cache
def byte_tokenizer(path: str):
    """(tokenizer, bytes by id) of a byte-level vocabulary; its special strings are plain text."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task a core
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    special = {x["content"] for x in json.loads(t.to_str())["added_tokens"]}
    to, out = _byte_of(), {}
    for token, i in t.get_vocab().items():
        out[i] = token.encode() if token in special else bytes(to[c] for c in token)
    return t, [out.get(i, b"") for i in range(max(out) + 1)]


@functools.cache
def piece_tokenizer(path: str):
    """(tokenizer that adds no space of its own, bytes by id) of a piece vocabulary."""
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    model.normalizer_spec.add_dummy_prefix = False  # segments bring their white space along
    t = SentencePieceProcessor(model_proto=model.SerializeToString())
    pieces = [t.id_to_piece(i) for i in range(t.get_piece_size())]
    return t, [bytes([int(p[3:5], 16)]) if t.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]


def safe_spaces(a_path: str, b_path: str) -> str:
    """ASCII white space before which a text can be cut: no token of either vocabulary holds it behind another character.

    Merges only make tokens, and the byte-level rule for pretokens parts every run of other characters from the white
    space that follows, so that both sides of a cut are tokenized as they would be in the whole text.
    """
    tokens = {x.decode("utf-8", "surrogateescape") for _, vocab in (byte_tokenizer(a_path), piece_tokenizer(b_path)) for x in vocab}
    behind = {y for t in tokens for x, y in zip(t, t[1:]) if x not in SPACES}
    return "".join(c for c in "\t\n\x0b\x0c\r " if c not in behind)


def cuts(buf: np.ndarray, starts: np.ndarray, safe: str) -> np.ndarray:
    """Where segments begin in the bytes of texts that begin at ``starts``: there, and at safe white space behind anything else."""
    kind = np.zeros(256, dtype=np.uint8)
    kind[[ord(c) for c in SPACES if ord(c) < 128]] = 1
    kind[[ord(c) for c in safe]] |= 2
    k = kind[buf]
    at = np.flatnonzero((k[1:] & 2 != 0) & (k[:-1] & 1 == 0)) + 1
    wide = np.zeros(len(at), dtype=bool)
    high = np.flatnonzero(buf[at - 1] >= 0x80)  # the last byte of a longer character, which may be a space too
    for c in WIDE_SPACES:
        same = np.ones(len(high), dtype=bool)
        for i, x in enumerate(reversed(c)):
            same &= buf[np.maximum(at[high] - 1 - i, 0)] == x
        wide[high] |= same
    return np.union1d(at[~wide], starts)


def packed(texts: list[str], safe: str) -> tuple[pa.DictionaryArray, np.ndarray]:
    """(segments of all texts, number of them up to the end of each text)."""
    raw = [b" " + t.encode() for t in texts]
    buf = np.frombuffer(b"".join(raw), dtype=np.uint8)
    ends = np.cumsum([len(x) for x in raw])
    at = cuts(buf, np.concatenate([[0], ends[:-1]]), safe)
    offsets = np.append(at, len(buf)).astype(np.int64)
    segs = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(buf)])
    return segs.dictionary_encode(), np.searchsorted(at, ends)


def to_planes(words: np.ndarray) -> bytes:
    """Places as planes of their lowest to highest bytes, which compress well: frequent segments come early in a block."""
    return np.ascontiguousarray(words.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, dtype=np.uint8).reshape(4, -1).T).view("<i4").reshape(-1)


def _packer(safe: str, block_bytes: int, part_bytes: int = PART_BYTES):
    def row(block: int, ids: list[int | None], parts: list[pa.DictionaryArray], ends: list[np.ndarray]) -> pa.RecordBatch:
        chunks = pa.chunked_array(parts).unify_dictionaries().chunks  # one dictionary for all
        segs, words = chunks[-1].dictionary.cast(pa.string()), np.concatenate([c.indices.to_numpy() for c in chunks]).astype(np.int32)
        before = np.cumsum([0, *[len(c) for c in chunks[:-1]]])
        last = np.concatenate([e + n for e, n in zip(ends, before)])
        n = np.bincount(words, minlength=len(segs))
        cols = [pa.array([block]), pa.array([ids], pa.list_(pa.int64())), pa.array([last], pa.list_(pa.int64())), pa.array([to_planes(words)], pa.binary())]
        cols += [pa.ListArray.from_arrays(pa.array([0, len(segs)], pa.int32()), segs), pa.array([n], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(cols, names=["block", "doc_id", "ends", "words", "segs", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, texts, parts, ends, size, done = TaskContext.get().partitionId() << 32, [], [], [], [], 0, 0

        def cut() -> None:  # texts are cut in small parts, so that only places among segments are held for a block
            part, end = packed(texts, safe)
            parts.append(part)
            ends.append(end)
            texts.clear()

        for batch in batches:
            for i, t in zip(batch.column(0), batch.column(1)):
                ids.append(i.as_py())
                texts.append(t.as_py())
                size += len(texts[-1])
                if size >= part_bytes:
                    cut()
                    done, size = done + size, 0
                    if done >= block_bytes:
                        yield row(block, ids, parts, ends)
                        pa.default_memory_pool().release_unused()
                        block, ids, parts, ends, done = block + 1, [], [], [], 0
        if texts:
            cut()
        if ids:
            yield row(block, ids, parts, ends)

    return run


def align(a: list[bytes], b: list[bytes]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(pairs of places that overlap, ends of groups as places after the last of a and b) of two cuttings of the same bytes."""
    links, ends, i, j = [], [], 0, 0
    x = len(a[0]) if a else 0
    y = len(b[0]) if b else 0
    while i < len(a) and j < len(b):
        links.append((i, j))
        if x == y:
            ends.append((i + 1, j + 1))
        step_a, step_b = x <= y, y <= x
        if step_a:
            i += 1
            x += len(a[i]) if i < len(a) else 0
        if step_b:
            j += 1
            y += len(b[j]) if j < len(b) else 0
    return links, ends


def aligned(seg: str, a: list[int], b: list[int], bytes_a: list[bytes], bytes_b: list[bytes]) -> tuple:
    """(ok, n_a, groups, links) of a segment."""
    raw, ta, tb = seg.encode(), [bytes_a[i] for i in a], [bytes_b[i] for i in b]
    if b"".join(ta) != raw or b"".join(tb) != raw:
        return False, 0, "", []
    links, ends = align(ta, tb)
    groups = (",".join(map(str, a[i0:i1])) + "|" + ",".join(map(str, b[j0:j1])) for (i0, j0), (i1, j1) in zip([(0, 0), *ends], ends))
    return True, len(a), ";".join(groups), [{"a": x, "b": y, "k": k} for (x, y), k in Counter((a[i], b[j]) for i, j in links).items()]


def _aligner(a_path: str, b_path: str, step: int = 2048):
    pairs = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("k", pa.int64())]))
    types = [pa.bool_(), pa.int64(), pa.string(), pairs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (ta, bytes_a), (tb, bytes_b) = byte_tokenizer(a_path), piece_tokenizer(b_path)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                segs = part.column(0).to_pylist()
                ids_a = [x.ids for x in ta.encode_batch(segs, add_special_tokens=False)]
                rows = [aligned(s, x, y, bytes_a, bytes_b) for s, x, y in zip(segs, ids_a, tb.encode(segs, num_threads=1))]
                cols = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays([*cols, part.column(1), part.column(2)], names=["ok", "n_a", "groups", "links", "n", "places"])
            pa.default_memory_pool().release_unused()  # the worker is kept for other tasks

    return run


def _scorer(shared: Broadcast):
    """Adds n_best and count_sum of a segment's links, from the broadcast id pairs (keys in order, counts, best)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, best = shared.value
        for batch in batches:
            col = dict(zip(batch.schema.names, batch.columns))
            flat = col["links"].flatten()
            a, b, k = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
            at = np.searchsorted(keys, a << 32 | b) % max(1, len(keys))
            # a segment that stands only in texts that can't be aligned has pairs that nothing counts
            k = np.where(keys[at] == (a << 32 | b), k, 0) if len(keys) else k[:0]
            ends = np.concatenate([[0], np.cumsum(col["links"].value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            sums = []
            for x in (best, counts):
                total = np.concatenate([[0], np.cumsum(k * x[at])]) if len(keys) else np.zeros(ends[-1] + 1, dtype=np.int64)
                sums.append(pa.array(total[ends[1:]] - total[ends[:-1]], pa.int64()))
            yield pa.RecordBatch.from_arrays([*[col[c] for c in SCORED[:4]], *sums], names=SCORED)
            pa.default_memory_pool().release_unused()

    return run


def _spoilt(blocks: pa.Table) -> list[tuple[int, int, int]]:
    """(block, pos, lost): how often segments stand in documents that hold one of the block's bad segments."""
    out = []
    for r in blocks.to_pylist():
        words, ends = from_planes(r["words"]), np.array(r["ends"])
        bad = np.isin(words, r["bad"])
        doc = np.searchsorted(ends, np.arange(len(words)), side="right")
        lost = np.bincount(words[np.isin(doc, doc[bad])])
        out += [(r["block"], int(i), int(lost[i])) for i in np.flatnonzero(lost)]
    return out


def _losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = _spoilt(pa.Table.from_batches([batch]))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64()))], names=["block", "pos", "lost"])


def _compose(blocks: pa.Table, segs: pa.Table) -> pa.Table:
    """The documents of a block, from the alignments of its segments."""
    out = []
    order = np.argsort(segs.column("pos").to_numpy())
    segs = segs.take(pa.array(order))
    groups = segs.column("groups").combine_chunks().cast(pa.large_string())
    ok, groups = groups.is_valid().to_numpy(zero_copy_only=False), groups.fill_null("")
    per = {c: segs.column(c).to_numpy() for c in ("n_a", "n_best", "count_sum")}
    per["n_groups"] = pc.add(pc.count_substring(groups, ";"), 1).to_numpy(zero_copy_only=False)
    # a group has one token of either side, and one more for each comma
    per["n_b"] = pc.count_substring(groups, ",").to_numpy(zero_copy_only=False) + 2 * per["n_groups"] - per["n_a"]
    for r in range(blocks.num_rows):
        all_words = from_planes(blocks.column("words")[r].as_py())
        all_ends, ids = np.array(blocks.column("ends")[r].values), blocks.column("doc_id")[r].values
        i = 0
        while i < len(all_ends):  # a part of the documents, or one long one
            at = all_ends[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(all_ends, at + PART_SEGMENTS)))
            words, ends = all_words[at : all_ends[j - 1]], all_ends[i:j] - at
            starts = np.concatenate([[0], ends[:-1]])
            whole = np.logical_and.reduceat(ok[words], starts)
            sums = {c: np.where(whole, np.add.reduceat(x[words], starts), 0) for c, x in per.items()}
            # tokens that share no inner end overlap in one pair less than there are tokens
            sums["n_links"] = sums["n_a"] + sums["n_b"] - sums["n_groups"]
            lists = pa.LargeListArray.from_arrays(pa.array(np.append(starts, ends[-1]), pa.int64()), groups.take(pa.array(words)))
            joined = pc.if_else(pa.array(whole), pc.binary_join(lists, pa.scalar(";", pa.large_string())), pa.scalar("", pa.large_string()))
            out.append(pa.table({"doc_id": ids[i:j], **{c: pa.array(sums[c], pa.int64()) for c in COUNTS}, "groups": joined.cast(pa.string())}))
            i = j
    del segs, groups
    pa.default_memory_pool().release_unused()
    return pa.concat_tables(out)


def align_documents(docs: DataFrame, a_path: str = BYTE_BPE, b_path: str = PIECE_BPE, block_bytes: int = BLOCK_BYTES, max_pairs: int = MAX_BROADCAST_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) for docs (doc_id, text).

    groups is the alignment as text, ``a1,a2|b1;a3|b2,b3``: ids of either side between common ends.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    none = rows.where("text is null or text = ''").select("doc_id", *[F.lit(0).cast("long").alias(c) for c in COUNTS], F.lit("").alias("groups"))
    blocks = stage_table(rows.where("text <> ''").mapInArrow(_packer(safe_spaces(a_path, b_path), block_bytes), BLOCK), "blocks")
    chunks = max(1, -(-blocks.count() // LISTED_BLOCKS))

    found = blocks.select("block", F.posexplode(F.arrays_zip("segs", "n")).alias("pos", "x")).select("block", "pos", F.col("x.segs").alias("seg"), F.col("x.n").alias("n"))
    # rows go to their segment's task as they are: lists made before the shuffle would only make it larger
    found = found.withColumn("chunk", F.pmod(F.xxhash64("block"), F.lit(chunks)).cast("int")).repartition("seg", "chunk")
    each = found.groupBy("seg", "chunk").agg(F.sum("n").alias("n"), F.collect_list(F.struct("block", "pos")).alias("places"))
    each = each.select("seg", "n", "places").mapInArrow(_aligner(a_path, b_path), SEGMENT)
    each = stage_table(each.withColumn("id", F.monotonically_increasing_id()), "aligned")

    bad = each.where("not ok").select(F.inline("places"))
    counted = each.where("ok").select("id", "n", "links")
    if not bad.isEmpty():  # what stands in documents that can't be aligned doesn't count
        lost = blocks.select("block", "ends", "words").join(bad.groupBy("block").agg(F.collect_list("pos").alias("bad")), "block")
        lost = stage_table(lost.mapInArrow(_losses, "block long, pos int, lost long"), "lost")
        lost = each.where("ok").select("id", F.inline("places")).join(lost, ["block", "pos"]).groupBy("id").agg(F.sum("lost").alias("lost"))
        counted = counted.join(lost, "id", "left").withColumn("n", F.col("n") - F.coalesce("lost", F.lit(0))).where("n > 0")
    pairs = counted.select("n", F.inline("links")).groupBy("a", "b").agg(F.sum(F.col("n") * F.col("k")).alias("c"), F.count("*").alias("m"))
    pairs = stage_table(pairs, "pairs")
    top = pairs.groupBy("b").agg(F.max("c").alias("top"))  # one row for an id of the vocabulary
    pairs = pairs.join(F.broadcast(top), "b").select("a", "b", "c", "m", (F.col("c") == F.col("top")).cast("long").alias("best"))
    n_pairs, total = pairs.agg(F.count("*"), F.coalesce(F.sum("m"), F.lit(0))).first()
    if n_pairs <= max_pairs:
        known = pairs.select(F.expr("shiftleft(cast(a as bigint), 32) | b").alias("key"), "c", "best").orderBy("key").toArrow()
        shared = spark.sparkContext.broadcast(tuple(known.column(c).to_numpy() for c in ("key", "c", "best")))
        scored = each.mapInArrow(_scorer(shared), "places array<struct<block:long,pos:int>>, ok boolean, n_a long, groups string, n_best long, count_sum long")
    else:
        sums = keyed_join(each.where("ok").select("id", F.inline("links")), pairs, ["a", "b"], "m", total)
        sums = sums.groupBy("id").agg(F.sum(F.col("k") * F.col("best")).alias("n_best"), F.sum(F.col("k") * F.col("c")).alias("count_sum"))
        scored = each.join(sums, "id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_best", "count_sum")})
    # a segment that can't be aligned has no groups
    shipped = scored.select(F.inline("places"), "n_a", "n_best", "count_sum", F.expr("if(ok, groups, null)").alias("groups"))
    out = blocks.select("block", "doc_id", "ends", "words").groupBy("block").cogroup(shipped.groupBy("block")).applyInArrow(_compose, DOCUMENT)
    return out.unionByName(none)


def op13_token_alignment(spark: SparkSession, sf_dir: str, folder: str = FOLDER) -> DataFrame:
    """Every document's alignment: counts, links by their pairs' counts, and the digest of the groups."""
    out = align_documents(read_table(spark, sf_dir, "documents"), f"{folder}/{os.path.basename(BYTE_BPE)}", f"{folder}/{os.path.basename(PIECE_BPE)}")
    return out.select("doc_id", *COUNTS, F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256"))

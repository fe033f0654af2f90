"""SpotSigs: fingerprints of the chains of content words that follow common words.

Every occurrence of an anchor (a common word) starts a chain of the next content words, spaced by
``SPACING``; a signature is the hash of the anchor and its chain, a fingerprint the set of a text's
signatures. A text with words but without any chain has one signature, of all its words.
Sets are compared by Jaccard, from LEAST on. Lengths are cut into partitions that grow by 1 / LEAST, so that two
sets alike to that are in one partition or in neighbours; others, and sets whose sizes alone are too far
apart, aren't compared. ``near_groups`` seeks all documents that are alike by their signatures.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainweave.llm import bytewords as bw
from chainweave.llm.ngram_join import groups
from chainweave.session import read_table

#: Anchors where no others are given: function words of English, German, French and Spanish.
ANCHORS = (
    "the of and to in is that it for with as was on be by at this from are or an have not which but "
    "der die das und ist ein eine den von zu mit auf im dem sich des nicht es als auch "
    "le la les et un une du que qui dans est pour sur pas au par ce il avec "
    "el los las del se por con una su para al lo como no si"
).split()
CHAIN, SPACING = 2, 1
#: Where a search has no need of likeness below a bound, lengths are held against it first.
LEAST = 0.1


def _hash_words(words: list[str]) -> np.ndarray:
    batch = pa.RecordBatch.from_arrays([pa.array(words, pa.string())], names=["text"])
    (_, _, buf, off) = next(bw.pieces(batch))
    return np.sort(bw.word_hashes(buf, off, bw.ALNUM)[0])


def signatures(texts: list[str], anchors: np.ndarray, chain: int = CHAIN, spacing: int = SPACING) -> list[np.ndarray]:
    """The sorted distinct 32-bit signatures of each text."""
    out: list[np.ndarray] = []
    for _, _, buf, off in bw.pieces(pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], names=["text"])):
        h, first = bw.word_hashes(buf, off, bw.ALNUM)
        row = np.repeat(np.arange(len(off) - 1), np.diff(first))
        at = np.minimum(np.searchsorted(anchors, h), len(anchors) - 1)
        common = anchors[at] == h
        content = np.flatnonzero(~common)
        spots = np.flatnonzero(common)
        link = np.searchsorted(content, spots)
        whole = link + (chain - 1) * spacing < len(content)
        spots, link = spots[whole], link[whole]
        same = row[content[link + (chain - 1) * spacing]] == row[spots]
        spots, link = spots[same], link[same]
        sig = h[spots]
        for c in range(chain):
            sig = bw.mix(sig * bw.U(0xD6E8FEB86659FD93) + h[content[link + c * spacing]])
        keys = np.unique((row[spots].astype(np.uint64) << bw.U(32)) | (sig >> bw.U(32)))
        cut = np.searchsorted(keys, np.arange(len(off), dtype=np.uint64) << bw.U(32))
        for r in range(len(off) - 1):
            s = (keys[cut[r] : cut[r + 1]] & bw.U(0xFFFFFFFF)).astype(np.uint32)
            if not len(s) and first[r + 1] > first[r]:
                s = (bw.chained(h[first[r] : first[r + 1]], int(first[r + 1] - first[r])) >> bw.U(32)).astype(np.uint32)
            out.append(s)
    return out


def written(s: np.ndarray) -> str:
    """A fingerprint as text: the signatures' bytes in base 64."""
    return base64.b64encode(s.astype("<u4").tobytes()).decode()


def length_partition(n: int, least: float = LEAST) -> int:
    """Partitions grow by 1 / least, so that partners are in one partition or in neighbours."""
    return 0 if n == 0 else 1 + int(math.log(n) / math.log(1 / least) + 1e-9)


def jaccard(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Likeness of two fingerprints; with ``least`` 0.0 below it, and sets that can't reach it by length aren't compared. Two empty ones are alike."""
    n, m = sorted((len(a), len(b)))
    if m == 0:
        return 1.0
    if least and (length_partition(m, least) - length_partition(n, least) > 1 or n < least * m):
        return 0.0
    both = np.sort(np.concatenate([a, b]))
    inter = int(np.count_nonzero(both[1:] == both[:-1]))
    out = inter / (n + m - inter)
    return out if out >= least else 0.0


def near_groups(docs: DataFrame, percent: int = 80, words: tuple[str, ...] | list[str] = ANCHORS) -> DataFrame:
    """(doc_id, n_signatures, component_id) of every row of docs (doc_id, text), whose doc_ids are unique and not null.

    Documents whose signature sets are alike to ``percent`` are linked, by the join of the n-gram operator: candidates share
    rare signatures, sizes and places bound them before they are counted, and groups of any size stay linear.
    """
    anchors = _hash_words(list(words))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, np.ndarray]]:
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                texts = part.column(1).cast(pa.large_string()).fill_null("").to_pylist()
                for d, s in zip(part.column(0).to_pylist(), signatures(texts, anchors), strict=True):
                    yield d, np.sort(bw.mix(s.astype(np.uint64)))

    return groups(docs.select("doc_id", "text"), sets, percent).withColumnRenamed("n_shingles", "n_signatures")


def fingerprint_neighbours(docs: DataFrame, bucket_rows: int = 1000, max_buckets: int = 8192, words: tuple[str, ...] | list[str] = ANCHORS) -> DataFrame:
    """op6's digest of every row of docs (doc_id, text), each compared with the next by doc_id.

    Ids are cut into buckets at ids that occur; the first rows of a bucket also go, marked, to the
    end of the bucket before (those of the first to the last), so that a task that walks through a bucket in
    order meets every next document while it holds two rows only. Rows of one id are in order of
    text; null ids come first. One single row is its own next. Null texts are empty.
    """
    spark = docs.sparkSession
    low = -(2**63)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(low)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    n = rows.count()
    parts = max(1, min(max_buckets, n // bucket_rows))
    cuts = rows.agg(F.percentile_approx("id", [i / parts for i in range(parts)], 100_000).alias("cuts"), F.min("id").alias("first")).first()
    bounds = np.array(sorted({*(cuts["cuts"] or []), *([cuts["first"]] if cuts["first"] is not None else [])}), dtype=np.int64)

    @F.pandas_udf("int")
    def bucket(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(), side="right") - 1).astype("int32")

    cut_ids = spark.createDataFrame([(int(b), (k - 1) % len(bounds)) for k, b in enumerate(bounds)], "id long, before int")
    own = rows.withColumn("bucket", bucket("id")).withColumn("tail", F.lit(False))
    tails = rows.join(F.broadcast(cut_ids), "id").select("id", "text", F.col("before").alias("bucket"), F.lit(True).alias("tail"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = own.unionByName(tails).repartition(parts, "bucket").sortWithinPartitions("bucket", "tail", "id", "text")
    anchors = _hash_words(list(words))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_signatures"]

    def digest(held: list[tuple]) -> pa.RecordBatch:
        """Rows of held that stand before a row of their bucket; the last entry is only looked at."""
        todo = [i for i in range(len(held) - 1) if not held[i][3] and held[i][2] == held[i + 1][2]]
        edited = [held[i][1][: len(held[i][1]) - len(held[i][1]) // 2] + held[i + 1][1][: len(held[i][1]) // 2] for i in todo]
        own, new = signatures([x[1] for x in held], anchors), signatures(edited, anchors)
        cols = (
            pa.array([None if held[i][0] == low else held[i][0] for i in todo], pa.int64()),
            pa.array([len(held[i][1]) for i in todo], pa.int64()),
            pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited], pa.string()),
            pa.array([written(own[i]) for i in todo], pa.string()),
            pa.array([written(x) for x in new], pa.string()),
            pa.array([jaccard(own[i], x) for i, x in zip(todo, new, strict=True)], pa.float64()),
            pa.array([jaccard(own[i], own[i + 1]) for i in todo], pa.float64()),
            pa.array([len(own[i]) for i in todo], pa.int32()),
        )
        return pa.RecordBatch.from_arrays(list(cols), names=names)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for i in range(0, batch.num_rows, 100):
                held += list(zip(*[c.to_pylist() for c in batch.slice(i, 100).columns], strict=True))
                yield digest(held)
                held = held[-1:]

    kind = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_signatures int"
    return laid.select("id", "text", "bucket", "tail").mapInArrow(walk, kind)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, with their likeness."""
    return fingerprint_neighbours(read_table(spark, sf_dir, "documents").select("doc_id", "text"))

"""Language identification by the nearest of several centroids per language.

A text's vector holds hashed 2- and 3-byte grams of its lower-cased letters, log-scaled, times an
inverse document frequency over all training documents, at unit length. Each language's labelled
sample is split into clusters by spherical k-means; a text takes the language of the centroid of the
largest cosine. The centroids are fitted on a bounded sample of distinct labelled texts
(``sample_rows`` in all); document frequencies and predictions cover every row and whole texts.

A text is rejected by its distance. Cosines rise with the number of different grams, so the limit does too:
sample texts that no centroid was fitted on, whole and cut to shorter lengths, show what texts of a size
reach in their language, and REJECT of the low quantile of that is the least cosine a text may have.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from chainweave.llm import bytewords as bw
from chainweave.session import read_table, stage_table

DIM, SAMPLE_ROWS, CLUSTERS, LEAST_ROWS = 4096, 1600, 4, 8
#: A text is rejected below this part of the cosine that 99 of 100 texts of its size reach. Texts of fewer than 2**FEW - 1 grams are kept.
REJECT, LOW, FEW = 0.6, 0.01, 4
SIZES = 16
LETTER = regex.compile(r"\p{L}")
#: Lower-cased ASCII letters and all other non-ASCII bytes stay, the rest becomes a space.
FOLD = np.full(256, 32, dtype=np.uint8)
FOLD[97:123], FOLD[128:] = np.arange(97, 123), np.arange(128, 256)
FOLD[65:91] = np.arange(97, 123)


def grams(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Log-scaled counts of hashed grams, one row of DIM for each text."""
    n = len(off) - 1
    x = FOLD[buf].astype(np.uint64)
    out = np.zeros(n * DIM, dtype=np.float32)
    row = np.repeat(np.arange(n), np.diff(off))
    for size in (2, 3):
        if len(x) < size:
            continue
        h = np.full(len(x) - size + 1, bw.U(size), dtype=np.uint64)
        for i in range(size):
            h = h * bw.U(257) + x[i : len(x) - size + 1 + i]
        inside = row[size - 1 :] == row[: len(h)]
        at = row[: len(h)] * DIM + (bw.mix(h) >> bw.U(52)).astype(np.int64)
        out += np.bincount(at[inside], minlength=n * DIM).astype(np.float32)
    return np.log1p(out).reshape(n, DIM)


def unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-12)


def clusters(m: np.ndarray, k: int, steps: int = 12) -> np.ndarray:
    """Unit centroids of at most k clusters of the unit rows of m; starts are the rows farthest from each other."""
    at = [int(np.argmax(m @ unit(m.sum(axis=0, keepdims=True))[0]))]
    near = m @ m[at[0]]
    while len(at) < min(k, len(m)) and near.min() < 0.999:
        at.append(int(near.argmin()))
        near = np.maximum(near, m @ m[at[-1]])
    c = m[at]
    for _ in range(steps):
        own = (m @ c.T).argmax(axis=1)
        c = unit(np.stack([m[own == i].sum(axis=0) if (own == i).any() else c[i] for i in range(len(c))]))
    return c


def document_frequency(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Number of documents and, of each gram bin, the documents that have it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DIM + 1, dtype=np.int64)
        for batch in batches:
            for _, _, buf, off in bw.pieces(batch):
                total[:DIM] += (grams(buf, off) > 0).sum(axis=0)
                total[DIM] += len(off) - 1
        yield pa.RecordBatch.from_arrays([pa.array(range(DIM + 1), pa.int32()), pa.array(total)], names=["bin", "n"])

    rows = docs.select("text").mapInArrow(count, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()  # DIM + 1 rows
    total = np.zeros(DIM + 1)
    for r in rows:
        total[r["bin"]] = r["n"]
    return int(total[DIM]), total[:DIM]


def size_class(m: np.ndarray) -> np.ndarray:
    """Logarithm of the number of different grams of each row."""
    return np.minimum(SIZES - 1, np.log2((m > 0).sum(axis=1) + 1).astype(np.int64))


class Model:
    """Centroids (unit rows), their languages, the least cosine of each size class, and gram weights."""

    def __init__(self, idf: np.ndarray, centroids: np.ndarray, langs: list[str]) -> None:
        self.idf, self.centroids, self.langs, self.least = idf, centroids, langs, np.zeros(SIZES)

    def predict(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the best centroid, its cosine and the size class, for each text."""
        m = grams(buf, off)
        cos = unit(m * self.idf) @ self.centroids.T
        best = cos.argmax(axis=1)
        return best, cos[np.arange(len(best)), best], size_class(m)


def calibrated(model: Model, sample: DataFrame) -> Model:
    """The model with limits from texts it wasn't fitted on: a size class takes its own low quantile, or that of the next smaller one."""
    held = sample.sparkSession.sparkContext.broadcast(model)

    def cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.encode() for t in batch.column(0).to_pylist()]
            cuts = [t[: 1 << k].decode(errors="ignore") for t in texts for k in range(FEW, 31) if 1 << k < len(t)] + [t.decode() for t in texts]
            for _, _, buf, off in bw.pieces(pa.RecordBatch.from_arrays([pa.array(cuts, pa.large_string())], names=["text"])):
                _, cos, size = held.value.predict(buf, off)
                yield pa.RecordBatch.from_arrays([pa.array(size), pa.array(cos.astype(np.float64))], names=["size", "cos"])

    got = sample.select("text").mapInArrow(cosines, "size long, cos double").groupBy("size").agg(F.percentile_approx("cos", LOW, 10_000).alias("low"), F.count("*").alias("n"))
    low = {r["size"]: r["low"] for r in got.collect() if r["n"] >= LEAST_ROWS}  # SIZES rows at most
    for c in range(FEW, SIZES):
        model.least[c] = low.get(c, model.least[c - 1] / REJECT) * REJECT
    return model


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, k: int = CLUSTERS) -> Model | None:
    """A model from labelled rows (doc_id, text, lang); None where no row has a label and a letter.

    The sample holds at most ``sample_rows`` distinct texts, as many of each language, those of the least hashes.
    So it has room for sample_rows / LEAST_ROWS languages: the most frequent ones.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("text", "lang", F.xxhash64("text").alias("h"))
    found = [r["lang"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max(1, sample_rows // LEAST_ROWS)).collect()]
    if not found:
        return None
    each = max(LEAST_ROWS, sample_rows // len(found))
    n, df = document_frequency(docs.select("text"))
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    # one language may hold most rows: the least hashes of each of many parts first, then of those
    distinct = rows.where(F.col("lang").isin(found)).select("lang", "h").distinct().withColumn("part", F.pmod(F.col("h"), F.lit(256)))
    some = distinct.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy("h"))).where(F.col("rank") <= each)
    top = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    picked = some.withColumn("rank", top).where(F.col("rank") <= each).select("lang", "h")  # at most sample_rows or LEAST_ROWS a language
    sample = stage_table(rows.join(F.broadcast(picked), ["h", "lang"]).dropDuplicates(["lang", "h"]), "sample")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, off in bw.pieces(batch):
                m = unit(grams(buf, off) * idf).astype(np.float16)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array([x.tobytes() for x in m], pa.binary())], names=["lang", "h", "v"])

    got = sample.select("lang", "text", "h").mapInArrow(vectors, "lang string, h long, v binary").orderBy("lang", "h").toPandas()
    langs, centroids = [], []
    fitted = (got["h"] % 4 != 0).to_numpy()
    for lang in sorted(set(got["lang"])):
        mine = (got["lang"] == lang).to_numpy()
        use = mine & fitted if (mine & fitted).sum() >= LEAST_ROWS // 2 else mine
        m = np.stack([np.frombuffer(v, dtype=np.float16) for v in got["v"][use]]).astype(np.float32)
        c = clusters(unit(m), k)
        langs += [lang] * len(c)
        centroids.append(c)
    return calibrated(Model(idf, np.concatenate(centroids), langs), sample.where("h % 4 = 0"))


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """(row, lang_pred, score, rejected): row is a struct of docs' own columns.

    Null texts and texts without a letter are ``und`` with score 0, and rejected; so is every text where
    there is no model. Other texts take the nearest centroid's language; rejected says that even it
    is far away. Only the text is an input.
    """
    names = docs.columns
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), "text")
    kind = StructType([kept.schema["row"], StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())])
    held = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            texts = batch.column(1)
            for i, j, buf, off in bw.pieces(batch):
                known = np.array([t is not None and LETTER.search(t) is not None for t in texts.slice(i, j - i).to_pylist()]) & (m is not None)
                best, cos, size = m.predict(buf, off) if m is not None else (np.zeros(j - i, dtype=int), np.zeros(j - i), None)
                cos = np.where(known, np.clip(cos, 0, 1), 0).astype(np.float64)
                lang = [m.langs[b] if ok else "und" for b, ok in zip(best, known, strict=True)]
                far = ~known | (cos < m.least[size]) if m is not None else ~known
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(lang, pa.string()), pa.array(cos), pa.array(far)], names=["row", "lang_pred", "score", "rejected"])

    return kept.mapInArrow(rows, kind)


def held_out(mod: int, fold: int) -> Column:
    """Whether a document is in the fold that is kept from learning."""
    return F.crc32(F.col("doc_id").cast("string")) % mod == fold


def drop_rejected(docs: DataFrame) -> DataFrame:
    """docs whose text is near a language learned from their own labelled rows. All columns are kept as they are."""
    out = identify(docs, fit(docs)).where("not rejected")
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from three of four."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out(4, 2)))
    out = identify(docs.select("doc_id", "text").withColumn("held_out", held_out(4, 2)).select("doc_id", "held_out", "text"), model)
    return out.select(F.col("row.doc_id").alias("doc_id"), F.col("row.held_out").alias("held_out"), "lang_pred", "score", "rejected")

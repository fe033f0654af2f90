"""Source divergence audit: how far the word use of a language's sources lies apart.

Every term that enough documents of its language hold becomes one wide row: its counts in an array with a
place for each source of the language. Higher-order functions turn a wide row into what it adds to each pair
of sources, which is summed before anything is shuffled. Arithmetic is in whole numbers.

Defined results: null text, lang and source are empty strings; rows of one doc_id, or of none, are documents of
their own; a source without terms is a group like any other, with all counts 0; a language without kept terms has
pairs of value 0 and no terms; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainweave.llm.bytewords import LOWER, pieces, words
from chainweave.llm.decontaminate import PLAIN, UPPER
from chainweave.session import read_table, stage_table

#: Runs of ASCII letters and of everything beyond ASCII.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
LETTER = np.ones(256, dtype=bool)
LETTER[[*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False
LEAST_DOCUMENTS = 30
TOP = 50
SCALE, PRIOR = 1_000_000_000, 5
#: Counts up to this one times SCALE fit a long; greater ones are divided as decimals.
PLAIN_COUNT = (2**63 - 1) // SCALE - PRIOR
#: Bytes of the languages' tables of sources up to which they are broadcast; beyond it they are joined by salted keys.
MAX_BROADCAST_BYTES, SALT = 64 << 20, 64


def share(count: str, total: str, kept: str) -> str:
    """SQL for the smoothed share 1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * kept)), exact for any long."""
    below = f"({total} + {PRIOR} * {kept})"
    plain = f"({SCALE} * ({count} + {PRIOR})) div {below}"
    wide = f"(cast({SCALE} as decimal(38,0)) * ({count} + {PRIOR})) div cast({below} as decimal(20,0))"
    return f"1 + case when {count} <= {PLAIN_COUNT} then {plain} else {wide} end"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (lang, source, term) within parts of a task's texts: occurrences and documents."""
    for batch in batches:
        langs, sources = batch.column(0).dictionary_encode(), batch.column(1).dictionary_encode()
        width = len(sources.dictionary)
        group = langs.indices.to_numpy().astype(np.int64) * width + sources.indices.to_numpy()
        for i, j, buf, off in pieces(batch):
            low = LOWER[buf]
            start, end, first = words(low, off, LETTER)
            if not len(start):
                continue
            at = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)  # the terms, end to end
            term = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(at), pa.py_buffer(low[LETTER[low]])]).dictionary_encode()
            code, n = term.indices.to_numpy().astype(np.int64), len(term.dictionary)
            doc = np.repeat(np.arange(i, j), np.diff(first))
            own = np.unique(doc * n + code)  # a document's distinct terms
            key, occurrences = np.unique(group[doc] * n + code, return_counts=True)
            documents = np.unique(group[own // n] * n + own % n, return_counts=True)[1]
            texts = term.dictionary.take(pa.array(key % n)).cast(pa.string())
            g = key // n
            yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(g // width)), sources.dictionary.take(pa.array(g % width)), texts, pa.array(occurrences), pa.array(documents)], names=["lang", "source", "term", "n", "d"])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n: occurrences, d: documents) of docs (lang, source, text), none of them null.

    Texts are cut and counted in parts of about a megabyte by arrays, so that what the shuffle gets is counted already.
    """
    rows = docs.select("lang", "source", "text").mapInArrow(_counted, "lang string, source string, term string, n long, d long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def audit_sources(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP, max_broadcast: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """(lang, source, part, item, value, rank) for docs (text, lang, source).

    Part ``pair``: the other sources of the language by the sum of share differences over all kept terms. Part
    ``term``: the ``top`` terms that a source uses more than its language. Ties go by item.
    """
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    groups = docs.groupBy("lang", "source").agg(F.lit(1).alias("_")).drop("_")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1  # one row a group
    groups = stage_table(groups.withColumn("place", place), "groups")

    entries = F.collect_list(F.when(F.col("n") > 0, F.struct("source", "n")))  # one entry a source, each with a count
    kept = term_counts(docs).groupBy("lang", "term").agg(F.sum("d").alias("d"), entries.alias("found")).where(F.col("d") >= least)
    kept = stage_table(kept.select("lang", "term", "found"), "kept")
    sums = kept.select("lang", F.inline("found")).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    vocab = kept.groupBy("lang").agg(F.count("*").alias("v"))
    groups = groups.join(sums, ["lang", "source"], "left").join(vocab, "lang", "left").select("lang", "source", "place", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v"))
    groups = stage_table(groups, "groups")

    # one row a language: its sources in order, their sums, and the share that a source without a term gives it
    by_lang = groups.groupBy("lang", "v").agg(F.sum("total").alias("all"), F.array_sort(F.collect_list(F.struct("place", "source", "total"))).alias("g"))
    by_lang = by_lang.where("v > 0").select("lang", "v", "all", F.expr("g.source").alias("sources"), F.expr("g.total").alias("totals"), F.expr(f"transform(g, x -> {share('0L', 'x.total', 'v')})").alias("none"))
    size = groups.agg(F.sum(F.octet_length("source") + 32).alias("n")).first()["n"] or 0
    if size <= max_broadcast:
        wide = kept.join(F.broadcast(by_lang), "lang")
    else:
        salted = by_lang.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        wide = kept.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALT)).cast("int")).join(salted, ["lang", "salt"]).drop("salt")
    # the map is bound once a row: a lambda would make it anew for each source
    counts = "transform(array(map_from_arrays(found.source, found.n)), m -> transform(sources, s -> coalesce(m[s], 0L)))[0]"
    wide = stage_table(wide.select("lang", "term", "v", "all", "sources", "totals", "none", F.expr(counts).alias("counts")), "wide")
    # the vectors are in the staged table, so that no lambda computes them again
    wide = wide.select("lang", "term", "v", "all", "sources", "none", "counts", F.expr(f"transform(counts, (c, i) -> {share('c', 'totals[i]', 'v')})").alias("p"), F.expr("filter(sequence(0, size(counts) - 1), i -> counts[i] = 0)").alias("zeros"))

    # a pair of sources that both lack a term differs by the same amount for all such terms: V times that amount is the
    # base, and a term only adds to the pairs of the sources that have it
    own = wide.select("lang", "counts", "p", "none", "zeros", F.posexplode("counts").alias("i", "c")).where("c > 0")
    own = own.select("lang", "i", "p", "none", F.expr("filter(zeros, j -> j < i)").alias("zeros"))  # pairs come from the smaller place that has the term
    own = own.select("lang", "i", "zeros", F.size("p").alias("m"), F.expr("""posexplode(concat(
        zip_with(slice(p, i + 2, size(p)), slice(none, i + 2, size(p)), (x, z) -> abs(p[i] - x) - abs(none[i] - z)),
        transform(zeros, j -> abs(p[i] - p[j]) - abs(none[i] - none[j])))) as (k, f)"""))
    own = own.select("lang", "i", F.expr("if(k < m - 1 - i, i + 1 + k, zeros[k - (m - 1 - i)])").alias("j"), "f")
    adds = own.groupBy("lang", F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).agg(F.sum("f").alias("f"))
    adds = adds.unionByName(adds.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "f"))
    level = F.expr(f"case when v > 0 then {share('0L', 'total', 'v')} else 0L end")
    a = groups.select("lang", "source", F.col("place").alias("a"), "v", level.alias("pa"))
    b = groups.select("lang", F.col("source").alias("item"), F.col("place").alias("b"), level.alias("pb"))
    pairs = a.join(b, "lang").where("a <> b").join(adds, ["lang", "a", "b"], "left")  # the result's own rows
    pairs = pairs.select("lang", "source", "item", (F.col("v") * F.abs(F.col("pa") - F.col("pb")) + F.coalesce("f", F.lit(0))).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))

    q = F.expr(share("aggregate(counts, 0L, (x, c) -> x + c)", "all", "v"))
    over = wide.withColumn("q", q).select("lang", "term", "sources", "counts", "q", F.posexplode("p").alias("i", "pi")).where("counts[i] > 0 and pi > q")
    over = over.select("lang", F.expr("sources[i]").alias("source"), F.col("term").alias("item"), (F.col("pi") - F.col("q")).alias("value"))
    over = over.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    out = pairs.withColumn("part", F.lit("pair")).unionByName(over.withColumn("part", F.lit("term")))
    return out.select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents."""
    return audit_sources(read_table(spark, sf_dir, "documents"))


OP11_SQL = f"""
with d as (select row_number() over () as uid, coalesce(lang, '') as lang, coalesce(source, '') as source, translate(coalesce(text, ''), '{UPPER}', '{PLAIN}') as text from documents),
g as (select distinct lang, source from d),
w as (select uid, lang, source, unnest(regexp_extract_all(text, '{TERM}')) as term from d),
k as (select lang, term from w group by lang, term having count(distinct uid) >= {LEAST_DOCUMENTS}),
c as (select w.lang, source, term, count(*) as n from w join k using (lang, term) group by all),
v as (select g0.lang, count(k.term) as v from (select distinct lang from g) g0 left join k using (lang) group by all),
gn as (select g.lang, g.source, v, coalesce(sum(n), 0)::hugeint as total from g join v using (lang) left join c on c.lang = g.lang and c.source = g.source group by all),
ln as (select lang, sum(total)::hugeint as total from gn group by lang),
p as (select gn.lang, gn.source, k.term, coalesce(n, 0) as n, 1 + ({SCALE}::hugeint * (coalesce(n, 0) + {PRIOR})) // (total + {PRIOR} * v) as p
  from gn join k using (lang) left join c on c.lang = gn.lang and c.source = gn.source and c.term = k.term),
q as (select k.lang, k.term, 1 + ({SCALE}::hugeint * (coalesce(sum(n), 0) + {PRIOR})) // (ln.total + {PRIOR} * v) as q
  from k join v using (lang) join ln using (lang) left join c on c.lang = k.lang and c.term = k.term group by k.lang, k.term, ln.total, v),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(sum(abs(x.p - y.p)), 0) as value
  from g a join g b on a.lang = b.lang and a.source <> b.source left join p x on x.lang = a.lang and x.source = a.source
  left join p y on y.lang = b.lang and y.source = b.source and y.term = x.term group by all),
over_ as (select p.lang, p.source, 'term' as part, p.term as item, p.p - q.q as value from p join q using (lang, term) where n > 0 and p.p > q.q),
u as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (select * from pairs union all select * from over_))
select lang, source, part, item, cast(value as bigint) as value, cast(rank as int) as rank from u where part = 'pair' or rank <= {TOP}
"""

"""Benchmark decontamination: a broadcast hash table of test windows against every document window.

Only DataFrame functions. A document's words are hashed once; each window's hash comes from its
words' hashes and probes the broadcast table inside the scan, in one generated stage. A probe that
hits is held against the window's words, so that a result never rests on a hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainweave.llm.rows import fresh_name, identified
from chainweave.session import read_table

UPPER, PLAIN = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NOT_WORD_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
#: Bytes of windows and item lists up to which the test side is broadcast; beyond it the join is shuffled.
MAX_BROADCAST_BYTES = 64 << 20


#: The ASCII characters that part words; none of them is special to trim.
PARTING = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def _split(text: Column, parts: str) -> Column:
    """Words of a text; trimmed first, so that no empty word needs to be filtered out."""
    return F.when(F.trim(text, F.lit(PARTING)) == "", F.array().cast("array<string>")).otherwise(F.split(F.trim(text, F.lit(PARTING)), parts))


def word_list(text: Column) -> Column:
    """Lower-cased (A to Z) words; null has none."""
    text = F.coalesce(text, F.lit(""))
    # lower() is the faster, and the same for plain ASCII
    low = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, PLAIN))
    return _split(low, NOT_WORD)


def word_count(text: Column) -> Column:
    return F.size(_split(F.coalesce(text, F.lit("")), NOT_WORD_ANY_CASE)).cast("long")


def item_windows(items: DataFrame, k: int = WINDOW) -> DataFrame:
    """(len, window, items) of distinct windows: items are the ids, as text, that have the window."""
    w = items.select(F.col("item_id").cast("string").alias("item"), word_list(F.col("text")).alias("words")).where("size(words) > 0 and item is not null")
    w = w.withColumn("len", F.least(F.size("words"), F.lit(k)))
    w = w.select("item", "len", F.explode(F.expr("transform(sequence(1, size(words) - len + 1), i -> slice(words, i, len))")).alias("ws"))
    return w.select("item", "len", F.array_join("ws", " ").alias("window")).groupBy("len", "window").agg(F.array_sort(F.collect_set("item")).alias("items"))


def hits(docs: DataFrame, items: DataFrame, k: int = WINDOW, max_broadcast: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """(uid, start, len, items) for every place of docs (uid, text) where an item's window occurs; start counts words from 0.

    A large test side is met by a shuffle of (uid, place, hash) only; what meets is held against the words of its
    documents afterwards.
    """
    windows = item_windows(items, k)
    size = F.octet_length("window") + 40 + F.aggregate("items", F.lit(0), lambda n, x: n + F.octet_length(x) + 16)
    sizes = {r["len"]: r["n"] for r in windows.groupBy("len").agg(F.sum(size).alias("n")).collect()}  # k rows at most
    if not sizes:
        return docs.sparkSession.createDataFrame([], "uid long, start int, len int, items array<string>")
    lens = sorted(sizes)
    rows = docs.select("uid", word_list(F.col("text")).alias("words"))
    rows = rows.withColumn("hashes", F.expr(f"case when size(words) >= {lens[0]} then transform(words, x -> xxhash64(x)) end"))
    rows = rows.select("*", F.explode(F.array(*map(F.lit, lens))).alias("len"))
    # coalesce: of a plain column, Spark would infer a filter that splits and hashes every text twice
    rows = rows.select("uid", "words", "hashes", "len", F.posexplode(F.coalesce("hashes", F.array().cast("array<bigint>"))).alias("start", "first"))
    rows = rows.where("start + len <= size(hashes)")

    def combined(hash_at) -> Column:
        """Hash of a window from those of its words."""
        out = F.lit(None).cast("long")
        for n in lens:
            out = F.when(F.col("len") == n, F.xxhash64(*[hash_at(j) for j in range(n)])).otherwise(out)
        return out

    rows = rows.withColumn("hash", combined(lambda j: F.get("hashes", F.col("start") + j)))
    own_words = F.split("window", " ")
    own = windows.select(F.col("len").alias("w_len"), combined(lambda j: F.xxhash64(F.get(own_words, F.lit(j)))).alias("w_hash"), "window", "items")
    meet = (F.col("hash") == F.col("w_hash")) & (F.col("len") == F.col("w_len"))
    # as many words on both sides: a prefix is the whole. An equality would become a join key, built for every window
    same = F.startswith(F.concat(F.array_join(F.slice("words", F.col("start") + 1, F.col("len")), " "), F.lit(" ")), F.concat("window", F.lit(" ")))
    if sum(sizes.values()) <= max_broadcast:
        return rows.join(F.broadcast(own), meet).where(same).select("uid", "start", "len", "items")
    found = rows.select("uid", "start", "len", "hash").join(own, meet)
    found = found.groupBy("uid").agg(F.collect_list(F.struct("start", "len", "window", "items")).alias("found"))  # bounded by the text
    found = docs.select("uid", word_list(F.col("text")).alias("words")).join(found, "uid").select("uid", "words", F.explode("found").alias("f"))
    return found.select("uid", "words", "f.*").where(same).select("uid", "start", "len", "items")


def hit_summary(found: DataFrame) -> DataFrame:
    """(uid, n_hit, items): words inside any hit, and the sorted distinct items."""
    before = Window.partitionBy("uid").orderBy("start", "len").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("len")
    rows = found.withColumn("until", F.coalesce(F.max(end).over(before), F.lit(0)))
    rows = rows.withColumn("fresh", F.greatest(F.lit(0), end - F.greatest("start", "until")))
    return rows.groupBy("uid").agg(F.sum("fresh").cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))


def contamination(docs: DataFrame, items: DataFrame, max_broadcast: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_hit, n_items, items, contaminated.

    Null or empty texts have no words and no hits; an empty benchmark leaves everything clean, and so do items
    without id or words. Every row is judged by its own text, also rows of one doc_id or of none.
    """
    docs = identified(docs.select("doc_id", "text"))
    found = hit_summary(hits(docs, items, max_broadcast=max_broadcast))
    rows = docs.select("uid", "doc_id", word_count(F.col("text")).alias("n_words"))
    n = F.coalesce("n_hit", F.lit(0).cast("long"))
    got = F.coalesce("items", F.array().cast("array<string>"))
    return rows.join(found, "uid", "left").select("doc_id", "n_words", n.alias("n_hit"), F.size(got).cast("long").alias("n_items"), got.alias("items"), (n > 0).alias("contaminated"))


def remove_contaminated(docs: DataFrame, items: DataFrame, max_broadcast: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """docs without the rows in whose text a benchmark window occurs; other columns are kept as they are."""
    name = fresh_name(docs, "uid")
    rows = identified(docs, name)
    found = hits(rows.select(F.col(name).alias("uid"), "text"), items, max_broadcast=max_broadcast)
    return rows.join(found.select(F.col("uid").alias(name)).distinct(), name, "left_anti").drop(name)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of every benchmark window in every whole document."""
    docs, items = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    out = contamination(docs.select("doc_id", "text"), items)
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP2_SQL = r"""
with d as (
  select doc_id, [x for x in string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') if x <> ''] as w from documents),
b as (
  select cast(item_id as varchar) as item, [x for x in string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') if x <> ''] as w from benchmark),
bw as (
  select distinct item, n, array_to_string(w[i:i + n - 1], ' ') as win
  from (select item, w, least(len(w), 10) as n, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from b where len(w) > 0)),
dw as (
  select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as win
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from bw) where len(w) >= n)),
h as (select doc_id, i, dw.n, item from dw join bw on dw.n = bw.n and dw.win = bw.win),
c as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from h) group by doc_id),
m as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from h) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join c on d.doc_id = c.doc_id left join m on d.doc_id = m.doc_id
"""

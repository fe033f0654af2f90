"""Personal data, and the terms around it that give it away, with DataFrame functions only.

Patterns find e-mail addresses, IP addresses, card and phone numbers; each distinct value is a protected entity. How
much a term tells of an entity is their pointwise mutual information over the corpus: over all documents, n hold
the term in a context of the entity, of dt that hold the term, dc that hold the entity, and D in all. A term
discloses an entity if it tells half of the entity's information or more:

    log(n * D / (dc * dt)) >= log(D / dc) / 2,    that is    n * n * D >= dc * dt * dt

which is compared in whole numbers. In documents that hold the entity such a term is a span too, wherever it stands.
``sanitise`` replaces the spans: a term by its stem, where the stem tells too little by the same test, else it goes.

Defined results: a null text is empty and has no spans; rows of one doc_id, or of none, are documents of their own, and
copies count as documents; an empty table gives no rows; a term inside a span of a pattern is part of that span;
contexts end at the next match of the same pattern; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainweave.llm.decontaminate import PLAIN, UPPER
from chainweave.llm.rows import identified
from chainweave.session import read_table, stage_table

KINDS = ("email", "ip", "card", "phone")
#: Possessive forms that match what the plain forms do, without recursion; \G and the look behind keep a run of
#: characters without a match from being read again from each of its places.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text with a match must contain.
HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
WORD, LEAST_LETTERS, STEM = r"\p{L}+", 3, 3
#: Characters on each side of an entity that are its context, and documents that must show a term in an entity's context.
CONTEXT, LEAST_DOCUMENTS = 120, 3
#: Bytes of flagged terms or documents up to which they are broadcast; beyond it joins are shuffled.
MAX_BROADCAST_BYTES = 64 << 20
CHUNK = 256
SPAN = "struct<s:bigint,e:bigint,v:string,around:string>"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once a row."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _low(text: Column) -> Column:
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, PLAIN))


def _words(text: Column) -> Column:
    """Distinct terms of a text, A to Z lower-cased."""
    return F.array_distinct(F.regexp_extract_all(_low(text), F.lit(rf"\p{{L}}{{{LEAST_LETTERS},}}"), F.lit(0)))


def located(text: Column, pattern: Column, context: int = 0) -> Column:
    """All matches of a pattern from left to right: (s, e, v, around), places in code points, e exclusive.

    Places are running sums over the pieces between matches. They are summed in chunks, so that many matches
    don't copy a growing list each time.
    """

    def step(pieces: Column) -> Callable[[Column, Column], Column]:
        def near(m: Column, i: Column) -> Column:
            gap, after = F.get(pieces, i), F.get(pieces, i + 1)
            if not context:
                around = F.lit(None).cast("string")
            else:  # a word that the cut goes through is left out
                left = F.when(F.length(gap) > context, F.regexp_replace(F.substring(gap, -context, context), rf"^{WORD}", "")).otherwise(gap)
                right = F.when(F.length(after) > context, F.regexp_replace(F.substring(after, 1, context), rf"{WORD}$", "")).otherwise(after)
                around = F.concat(left, F.lit("\n"), right)
            return F.struct(F.length(gap).cast("long").alias("gap"), F.length(m).cast("long").alias("len"), m.alias("v"), around.alias("around"))

        return near

    none = F.array().cast(f"array<{SPAN}>")

    def laid(chunk: Column, base: Column) -> Column:
        start = F.struct(base.alias("at"), none.alias("out"))

        def put(acc: Column, x: Column) -> Column:
            s = acc["at"] + x["gap"]
            span = F.struct(s.alias("s"), (s + x["len"]).alias("e"), x["v"].alias("v"), x["around"].alias("around"))
            return F.struct((s + x["len"]).alias("at"), F.array_append(acc["out"], span).alias("out"))

        return F.aggregate(chunk, start, put, lambda acc: acc["out"])

    def bases(chunks: Column) -> Column:
        sums = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x["gap"] + x["len"]))
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(sums, start, lambda a, x: F.struct((a["at"] + x).alias("at"), F.array_append(a["out"], a["at"]).alias("out")), lambda a: a["out"])

    def placed(steps: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / CHUNK).cast("int")), lambda c: F.slice(steps, c * CHUNK + 1, CHUNK))
        return _let(chunks, lambda cs: _let(bases(cs), lambda bs: F.flatten(F.transform(cs, lambda c, i: laid(c, F.get(bs, i))))))

    found = F.regexp_extract_all(text, pattern, F.lit(0))
    some = lambda ms: _let(F.split(text, pattern, -1), lambda pieces: _let(F.transform(ms, step(pieces)), placed))
    return _let(found, lambda ms: F.when(F.size(ms) > 0, some(ms)).otherwise(none))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    def total(back: Column) -> Column:
        def add(acc: Column, i: Column) -> Column:
            d = back.substr(i, F.lit(1)).cast("int")
            return acc + F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

        return F.aggregate(F.sequence(F.lit(1), F.length(back)), F.lit(0), add)

    return _let(F.reverse(_digits(v)), total) % 10 == 0


VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(rf"^{PART}\.{PART}\.{PART}\.{PART}$"),
    "card": lambda v: F.when(F.length(_digits(v)).between(13, 19), _luhn(v)).otherwise(F.lit(False)),
    "phone": lambda v: F.length(_digits(v)).between(9, 15),
}


def entity(kind: str, v: Column) -> Column:
    """The value that a match stands for, under its kind's name."""
    return F.concat(F.lit(f"{kind}:"), F.lower(v) if kind == "email" else v if kind == "ip" else _digits(v))


def base_spans(text: Column, kind: str, context: int = CONTEXT) -> Column:
    """The valid matches of a kind; a failing match is dropped, and nothing inside it is tried again."""
    spans = F.when(text.rlike(HINTS[kind]), located(text, F.lit(PATTERNS[kind]), context)).otherwise(F.array().cast(f"array<{SPAN}>"))
    return F.filter(spans, lambda x: VALID[kind](x["v"]))


def found_in(rows: DataFrame) -> DataFrame:
    """(uid, doc_id, email, ip, card, phone: arrays of (s, e), entities, pairs: ``entity newline term``), staged."""
    text = F.coalesce("text", F.lit(""))
    out = rows.select("uid", "doc_id", *[base_spans(text, k).alias(k) for k in KINDS])

    def named(k: str) -> Column:
        return F.transform(k, lambda x: F.struct(entity(k, x["v"]).alias("entity"), _words(x["around"]).alias("terms")))

    out = out.withColumn("named", F.concat(*map(named, KINDS)))
    pairs = F.flatten(F.transform("named", lambda x: F.transform(x["terms"], lambda t: F.concat(x["entity"], F.lit("\n"), t))))
    places = [F.transform(k, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))).alias(k) for k in KINDS]
    return stage_table(out.select("uid", "doc_id", *places, F.array_distinct("named.entity").alias("entities"), F.array_distinct(pairs).alias("pairs")), "spans")


def _small(df: DataFrame, size: Column, limit: int) -> DataFrame:
    """df, to be broadcast if it is found to be small."""
    n = df.agg(F.sum(size).alias("n")).first()["n"] or 0
    return F.broadcast(df) if n <= limit else df


def _documents_with(rows: DataFrame, terms: DataFrame, units: Callable[[Column], Column], limit: int) -> DataFrame:
    """(term, dt) of the wanted terms (distinct) over all documents: counted first, so that the join meets each term once."""
    dt = rows.select(F.explode(units(F.coalesce("text", F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("dt"))
    return dt.join(_small(terms, F.octet_length("term") + 24, limit), "term")  # a semi join would be moved below the counts


def _telling(joint: DataFrame, entities: DataFrame, terms: DataFrame, total: int) -> DataFrame:
    """(entity, term, full: the entity stands near the term in each document of the term) of pairs that pass the test."""
    out = joint.join(terms, "term").join(entities, "entity")
    n, d = F.col("n").cast("decimal(15,0)"), lambda c: F.col(c).cast("decimal(15,0)")
    out = out.where(n * n * F.lit(total).cast("decimal(8,0)" if total < 10**8 else "decimal(15,0)") >= d("dc") * d("dt") * d("dt"))
    return out.select("entity", "term", (F.col("n") >= F.col("dt")).alias("full"))


def disclosing(rows: DataFrame, spans: DataFrame, least: int = LEAST_DOCUMENTS, limit: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """(entity, term, full) of the terms that disclose an entity, staged; rows are (uid, text) and spans from found_in."""
    pair = F.split("pair", "\n")
    joint = spans.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    joint = stage_table(joint.select(pair[0].alias("entity"), pair[1].alias("term"), "n"), "joint")
    dc = spans.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("dc")).where(F.col("dc") >= least)
    dt = _documents_with(rows, joint.select("term").distinct(), _words, limit)
    return stage_table(_telling(joint, dc, dt, spans.count()), "telling")


def term_spans(rows: DataFrame, spans: DataFrame, telling: DataFrame, limit: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """(uid, terms: array of (s, e, v)) of documents that hold a disclosing term of one of their own entities."""
    few = _small(telling, F.octet_length("entity") + F.octet_length("term") + 48, limit)
    known = telling.select("entity").distinct()
    known = _small(known, F.octet_length("entity") + 24, limit)
    touched = spans.select("uid", F.explode("entities").alias("entity")).join(known, "entity", "left_semi")
    touched = stage_table(touched.groupBy("uid").agg(F.collect_list("entity").alias("entities")), "touched")  # a document's own entities
    size = F.aggregate("entities", F.lit(24), lambda a, x: a + F.octet_length(x) + 16)
    own = rows.select("uid", "text").join(_small(touched, size, limit), "uid").select("uid", "entities", F.explode(_words(F.col("text"))).alias("term"))
    terms = own.join(few, "term").where(F.array_contains("entities", F.col("entity"))).groupBy("uid").agg(F.array_sort(F.collect_set("term")).alias("words"))
    terms = stage_table(terms, "terms")
    size = F.aggregate("words", F.lit(24), lambda a, x: a + F.octet_length(x) + 16)
    pattern = F.concat(F.lit(r"(?i)(?<!\p{L})(?:"), F.array_join("words", "|"), F.lit(r")(?!\p{L})"))
    return rows.select("uid", "text").join(_small(terms, size, limit), "uid").select("uid", located(F.col("text"), pattern).alias("terms"))


def all_spans(rows: DataFrame, least: int = LEAST_DOCUMENTS, limit: int = MAX_BROADCAST_BYTES) -> tuple[DataFrame, DataFrame]:
    """(uid, doc_id, email, ip, card, phone, term: arrays of (s, e), entities) of rows (uid, doc_id, text), and the disclosing terms."""
    spans = found_in(rows)
    telling = disclosing(rows, spans, least, limit)
    added = term_spans(rows, spans, telling, limit)
    base = F.concat(*KINDS)
    free = F.filter("terms", lambda t: ~F.exists("base", lambda b: (b["s"] < t["e"]) & (t["s"] < b["e"])))
    none = F.array().cast("array<struct<s:bigint,e:bigint>>")
    out = spans.drop("pairs").join(added, "uid", "left").withColumn("base", base)
    out = out.withColumn("term", F.coalesce(F.transform(free, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))), none))
    return out.drop("base", "terms"), telling


def find_personal_data(docs: DataFrame, least: int = LEAST_DOCUMENTS, limit: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """(doc_id, email, ip, card, phone, term) for docs (doc_id, text): spans in code points, ends exclusive."""
    rows = identified(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    return all_spans(rows, least, limit)[0].select("doc_id", *KINDS, "term")


def sanitise(docs: DataFrame, least: int = LEAST_DOCUMENTS, limit: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """(doc_id, text, n_masked, n_generalised, n_removed) for docs (doc_id, text).

    A span of a pattern becomes its kind's name in brackets. A disclosing term becomes its first letters and a star if
    the words of that stem, taken as one term, don't disclose the entity; else it is removed.
    """
    rows = identified(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    spans, telling = all_spans(rows, least, limit)
    spans = stage_table(spans, "all_spans")
    stems = lambda text: F.array_distinct(F.transform(_words(text), lambda w: F.substring(w, 1, STEM)))
    broad = telling.select("entity", F.substring("term", 1, STEM).alias("term")).distinct()
    dt = _documents_with(rows, broad.select("term").distinct(), stems, limit)
    dc = spans.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("dc"))
    # documents that hold the entity and a word of the stem, which is an upper bound of those with it in the context
    held = spans.where("size(entities) > 0").select("uid", "entities").join(rows.select("uid", "text"), "uid")
    held = held.select("entities", F.explode(stems(F.col("text"))).alias("term")).join(_small(broad, F.octet_length("entity") + 48, limit), "term")
    held = held.where(F.array_contains("entities", F.col("entity"))).groupBy("entity", "term").agg(F.count("*").alias("n"))
    narrow = stage_table(_telling(held, dc, dt, spans.count()).select("entity", F.col("term").alias("stem")), "stems")
    lost = telling.withColumn("stem", F.substring("term", 1, STEM)).join(narrow, ["entity", "stem"], "left_semi").select("entity", "term")
    lost = spans.where("size(entities) > 0").select("uid", F.explode("entities").alias("entity")).join(lost, "entity").groupBy("uid").agg(F.collect_set("term").alias("lost"))
    out = rows.join(spans.drop("doc_id"), "uid").join(lost, "uid", "left")
    out = out.withColumn("chars", F.when(F.size(F.concat(*KINDS, "term")) > 0, F.split(F.coalesce("text", F.lit("")), "")))
    word = lambda x: F.array_join(F.slice("chars", (x["s"] + 1).cast("int"), (x["e"] - x["s"]).cast("int")), "")

    def renamed(x: Column) -> Column:
        return F.when(F.array_contains(F.coalesce("lost", F.array().cast("array<string>")), _low(word(x))), "").otherwise(F.concat(F.substring(word(x), 1, STEM), F.lit("*")))

    def edits(k: str, by: Callable[[Column], Column]) -> Column:
        return F.transform(k, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), by(x).alias("by")))

    named = [edits(k, lambda x, to=f"[{k.upper()}]": F.lit(to)) for k in KINDS]
    out = out.withColumn("edits", F.array_sort(F.concat(*named, edits("term", renamed))))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    cut = lambda s, e: F.array_join(F.slice("chars", (s + 1).cast("int"), F.greatest(F.lit(0), e - s).cast("int")), "")

    def put(acc: Column, x: Column) -> Column:  # a span that starts inside the one before only lengthens it
        fresh = F.concat(acc["out"], F.array(cut(acc["at"], x["s"]), x["by"]))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(x["s"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"))

    done = F.aggregate("edits", start, put, lambda acc: F.concat(F.array_join(acc["out"], ""), cut(acc["at"], F.size("chars").cast("long"))))
    n_removed = F.size(F.filter("edits", lambda x: x["by"] == ""))
    return out.select(
        "doc_id", F.when(F.col("chars").isNull(), F.col("text")).otherwise(done).alias("text"),
        F.size(F.concat(*KINDS)).alias("n_masked"), (F.size("term") - n_removed).alias("n_generalised"), n_removed.alias("n_removed"),
    )


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The personal data and the disclosing terms of all documents."""
    out = find_personal_data(read_table(spark, sf_dir, "documents"))
    told = lambda k: F.transform(k, lambda x: F.concat(F.lit(f"{k}:"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string")))
    base = F.concat(*map(told, KINDS))
    return out.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(F.concat(base, told("term")), ",").alias("spans"))


_PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": PATTERNS["phone"]}
_PLACED = "list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0)"
OP12_SQL = rf"""
with d as materialized (select row_number() over () as uid, doc_id, coalesce(text, '') as text from documents),
f as materialized ({" union all ".join(f"select uid, {i} as o, '{k}' as kind, regexp_extract_all(text, '{_PLAIN[k]}') as ms, string_split_regex(text, '{_PLAIN[k]}') as ps from d" for i, k in enumerate(KINDS))}),
m as (select uid, o, kind, ms, ps, unnest(range(1, len(ms) + 1)) as i from f where len(ms) > 0),
v as (select uid, o, kind, ms[i] as v, regexp_replace(ms[i], '[^0-9]', '', 'g') as digits, {_PLACED} as s, ps[i] as l, ps[i + 1] as r from m),
b as materialized (select uid, o, kind, s, s + length(v) as e, kind || ':' || case kind when 'email' then lower(v) when 'ip' then v else digits end as entity,
    case when length(l) > {CONTEXT} then regexp_replace(right(l, {CONTEXT}), '^{WORD}', '') else l end || chr(10) || case when length(r) > {CONTEXT} then regexp_replace(left(r, {CONTEXT}), '{WORD}$', '') else r end as around
  from v where kind = 'email' or kind = 'ip' and regexp_full_match(v, '{PART}\.{PART}\.{PART}\.{PART}') or kind = 'phone' and length(digits) between 9 and 15
    or kind = 'card' and length(digits) between 13 and 19 and list_sum(list_transform(range(length(digits)), lambda j: (cast(reverse(digits)[j + 1] as int) * (1 + j % 2)) - case when cast(reverse(digits)[j + 1] as int) * (1 + j % 2) > 9 then 9 else 0 end)) % 10 = 0),
de as (select distinct uid, entity from b),
dc as (select entity, count(*) as dc from de group by entity having count(*) >= {LEAST_DOCUMENTS}),
joint as (select entity, term, count(*) as n from (select distinct uid, entity, unnest(regexp_extract_all(translate(around, '{UPPER}', '{PLAIN}'), '\p{{L}}{{{LEAST_LETTERS},}}')) as term from b) group by all having count(*) >= {LEAST_DOCUMENTS}),
w as materialized (select uid, regexp_extract_all(text, '{WORD}') as ms, string_split_regex(text, '{WORD}') as ps from d),
dt as (select term, count(*) as dt from (select distinct uid, translate(unnest(ms), '{UPPER}', '{PLAIN}') as term from w) where term in (select term from joint) group by term),
told as (select entity, term from joint join dc using (entity) join dt using (term) where n::hugeint * n * (select count(*) from d) >= dc::hugeint * dt * dt),
x as (select uid, ms, ps, unnest(range(1, len(ms) + 1)) as i from w where uid in (select uid from de join told using (entity))),
t as (select uid, {_PLACED} as s, ms[i] as v from x where exists (select 1 from told join de using (entity) where de.uid = x.uid and term = translate(ms[i], '{UPPER}', '{PLAIN}'))),
a as (select uid, o, kind, s, e from b union all
  select uid, {len(KINDS)}, 'term', s, s + length(v) from t where not exists (select 1 from b where b.uid = t.uid and b.s < t.s + length(v) and t.s < b.e))
select doc_id, {", ".join(f"count(*) filter (kind = '{k}') as n_{k}" for k in KINDS)},
  sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' order by o, s) filter (o < {len(KINDS)}), '')) as base_sha256,
  coalesce(string_agg(kind || ':' || s || ':' || e, ',' order by o, s), '') as spans
from d left join a using (uid) group by uid, doc_id
"""

"""Chat formatting of typed content parts, reversible, with a loss mask. Only DataFrame functions.

A turn is written as ``### role:``, a line feed, its body, a line feed, ``</turn>`` and a line feed.
In bodies and roles a backslash goes before every backslash, ``#``, ``<``, in roles ``:`` and in types ``|`` and ``>``, so that
no text can look like a turn's mark or a placeholder, and taking one backslash away before any
character gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainweave.session import read_table

HEAD, COLON, FOOT = "### ", ":\n", "\n</turn>\n"
PART = "array<struct<type:string,text:string,ref:string,units:double>>"
#: Tokens that one unit stands for: an image's tile, a second of audio, a document's page.
UNIT_TOKENS = {"image": 256, "audio": 25, "document": 512}
CHARS_A_TOKEN = 4


def escape(text: Column, chars: str = r"\\#<") -> Column:
    return F.regexp_replace(text, f"([{chars}])", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def visit(part: Column) -> Column:
    """What one part is in the body: escaped text, or a placeholder that names its type."""
    kind = F.coalesce(part["type"], F.lit("text"))
    return F.when(kind == "text", escape(F.coalesce(part["text"], F.lit("")))).otherwise(F.concat(F.lit("<|"), escape(kind, r"\\#<|>"), F.lit("|>")))


def part_tokens(part: Column) -> Column:
    """Text: one token for four characters, rounded up. Others: whole units times the tokens of a unit, one unit at least."""
    kind, units = F.coalesce(part["type"], F.lit("text")), F.greatest(F.lit(1.0), F.ceil(F.coalesce(part["units"], F.lit(1.0))).cast("double"))
    out = F.when(kind == "text", F.ceil(F.length(F.coalesce(part["text"], F.lit(""))) / CHARS_A_TOKEN))
    for name, tokens in UNIT_TOKENS.items():
        out = out.when(kind == name, units * tokens)
    return out.otherwise(units).cast("long")


def format_chat(turns: DataFrame) -> DataFrame:
    """One row for each conv_id from rows (conv_id, turn, role, parts), parts being of type PART.

    formatted string; mask array<struct<start:long,chars:long>>: where the bodies of assistant turns
    stand in it, in code points from 0; attachments array<struct<turn,type,ref,tokens>> in the order
    of their placeholders; n_tokens long: tokens of all parts, attachments expanded.
    Null roles and texts are empty, null parts are no parts. Turns are in order of turn (null first),
    role and body; repeated rows are repeated turns. Rows without conv_id form one conversation.
    """
    parts = F.coalesce(F.col("parts"), F.array().cast(PART))
    rows = turns.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.array_join(F.transform(parts, visit), "").alias("body"),
        F.transform(F.filter(parts, lambda p: F.coalesce(p["type"], F.lit("text")) != "text"), lambda p: F.struct(F.col("turn").alias("turn"), p["type"].alias("type"), p["ref"].alias("ref"), part_tokens(p).alias("tokens"))).alias("files"),
        F.aggregate(parts, F.lit(0).cast("long"), lambda n, p: n + part_tokens(p)).alias("tokens"),
    )
    head = F.concat(F.lit(HEAD), escape(F.col("role"), r"\\#<:"), F.lit(COLON))
    rows = rows.withColumn("head", head).withColumn("piece", F.concat("head", "body", F.lit(FOOT)))
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "body").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("until", F.sum(F.length("piece").cast("long")).over(w))
    span = F.struct((F.col("until") - F.length("piece") + F.length("head")).alias("start"), F.length("body").cast("long").alias("chars"))
    item = F.struct("until", "piece", F.when(F.col("role") == "assistant", span).alias("span"), "files")
    out = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("items"), F.sum("tokens").alias("n_tokens"))
    return out.select(
        "conv_id",
        F.array_join(F.transform("items", lambda x: x["piece"]), "").alias("formatted"),
        F.filter(F.transform("items", lambda x: x["span"]), lambda s: s.isNotNull()).alias("mask"),
        F.flatten(F.transform("items", lambda x: x["files"])).alias("attachments"),
        "n_tokens",
    )


def read_back(formatted: Column) -> Column:
    """array<struct<role,text>> of a formatted conversation's turns; placeholders stay as they are, see ``read_parts``."""
    whole = rf"(?s)^{HEAD}((?:[^:\\]|\\.)*){COLON}(.*)$"
    pieces = F.filter(F.split(formatted, FOOT), lambda p: p != "")
    return F.transform(pieces, lambda p: F.struct(unescape(F.regexp_extract(p, whole, 1)).alias("role"), unescape(F.regexp_extract(p, whole, 2)).alias("text")))


def read_parts(text: Column) -> Column:
    """array<struct<type,text>> of a turn's body as it stands in the format: runs of text, and placeholders by type (null text)."""
    pieces = F.regexp_extract_all(text, F.lit(r"(?s)<\|(?:[^|\\]|\\.)*\|>|(?:\\.|[^\\<])+"), F.lit(0))
    kind = lambda p: F.when(p.startswith("<|"), unescape(F.regexp_extract(p, r"(?s)^<\|(.*)\|>$", 1))).otherwise("text")
    return F.transform(pieces, lambda p: F.struct(kind(p).alias("type"), F.when(~p.startswith("<|"), unescape(p)).alias("text")))


def bodies(formatted: Column) -> Column:
    """The turns' bodies as they stand in the format."""
    whole = rf"(?s)^{HEAD}((?:[^:\\]|\\.)*){COLON}(.*)$"
    return F.transform(F.filter(F.split(formatted, FOOT), lambda p: p != ""), lambda p: F.regexp_extract(p, whole, 2))


def masked(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped, with nothing between the spans."""
    return F.array_join(F.transform(mask, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["chars"].cast("int")))), "")


def plain_parts(text: Column) -> Column:
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("double").alias("units")))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted; every digest is read back from the output."""
    said = r"\### Assistant: </turn> ok"
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    out = format_chat(rows.unionByName(planted).select("conv_id", "turn", "role", plain_parts(F.col("text")).alias("parts")))
    out = out.withColumn("turns", read_back(F.col("formatted"))).withColumn("loss", masked(F.col("formatted"), F.col("mask")))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "n_tokens",
    )


OP5_SQL = r"""
with t as (
  select conv_id, cast(turn as bigint) as turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e as (
  select *, length(regexp_replace(role, '[\\#<:]', '..', 'g')) + length(regexp_replace(text, '[\\#<]', '..', 'g')) + 15 as chars,
         regexp_replace(text, '([\\#<])', '\\\1', 'g') as body from t)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, body)) as turns_sha256,
       cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, role, body) filter (role = 'assistant'), '')) as loss_sha256,
       cast(sum(chars) as bigint) as formatted_chars,
       cast(sum((length(text) + 3) // 4) as bigint) as n_tokens
from e group by conv_id
"""

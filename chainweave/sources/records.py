"""Records behind transcripts: attribute tables, ids that are used again far away, and coding chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainweave.functions import coding
from chainweave.sources.annotation import MAX_SPAN, decoded

#: Attributes that only number exons.
NUMBERING = ("exon_id", "exon_number")

def attributes(info: Column) -> Column:
    """All attributes of a line as a map. GFF3 has ``key=value``, GTF ``key "value"`` (a value without quotes counts too); of a key that comes
    twice the last value stays."""
    part = F.filter(F.transform(F.split(info, r';(?=(?:[^"]*"[^"]*")*[^"]*$)'), lambda x: F.trim(x)), lambda x: x != "")
    key = lambda x: F.regexp_extract(x, r'^([^\s="]+)', 1)
    value = lambda x: F.regexp_replace(F.trim(F.regexp_replace(x, r'^[^\s="]+\s*=?\s*', "")), '^"|"$', "")
    pairs = F.filter(F.transform(part, lambda x: F.struct(key(x).alias("k"), decoded(value(x)).alias("v"))), lambda p: (p["k"] != "") & p["v"].isNotNull())

    def last(found: Column) -> Column:
        keys = F.array_distinct(found["k"])
        return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(found, lambda p: p["k"] == k), -1)["v"]))

    return F.element_at(F.transform(F.array(pairs), last), 1)  # the pairs are parsed once


def _lifted(parts: DataFrame, prefix: str) -> DataFrame:
    """(dset, seq, tid, k, v, prefix): attributes that all parts of a transcript have with one value, but for numbering."""
    key = ["dset", "seq", "tid"]
    n = parts.groupBy(*key).agg(F.count("*").alias("n"))
    each = parts.select(*key, F.explode("attrs").alias("k", "v")).groupBy(*key, "k").agg(F.count("*").alias("m"), F.count_distinct("v").alias("values"), F.min("v").alias("v"))
    same = each.join(n, key).where((F.col("m") == F.col("n")) & (F.col("values") == 1) & ~F.col("k").isin(*NUMBERING))
    return same.select(*key, "k", "v", F.lit(prefix).alias("prefix"))


def attribute_table(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Attributes of transcripts (dset, seq, tid, attrs) and what is left to their parts (dset, seq, tid, kind, s, e, attrs).

    What all exons (or all coding parts) of a transcript say with one value is said by the transcript: under its own
    name if the transcript doesn't have it, not again if it says the same, and as ``exon_name`` or ``CDS_name`` if it
    says otherwise. Numbers and ids of exons go. A transcript without a gene's name and id takes its gene's, and of
    its gene's attributes those it lacks, but not a description that is its product.
    """
    f = features.withColumn("attrs", attributes(F.col("info")))
    key = ["dset", "seq", "tid"]
    own = f.where("kind = 'transcript' and id is not null").groupBy("dset", "seq", F.col("id").alias("tid")).agg(F.first("attrs").alias("own"), F.first("parent", ignorenulls=True).alias("parent"))
    genes = f.where("kind = 'gene' and id is not null").groupBy("dset", "seq", F.col("id").alias("parent")).agg(F.first("attrs").alias("gene"))
    parts = f.where("kind in ('exon', 'cds') and parent is not null").select("dset", "seq", F.col("parent").alias("tid"), "kind", "s", "e", F.map_filter("attrs", lambda k, v: ~k.isin("ID", "Parent", "transcript_id", "gene_id")).alias("attrs"))
    up = _lifted(parts.where("kind = 'exon'"), "exon_").unionByName(_lifted(parts.where("kind = 'cds'"), "CDS_"))
    gathered = up.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("k", "prefix", "v"))).alias("up"))  # a transcript's distinct keys
    ids = own.select(*key).unionByName(parts.select(*key)).distinct()
    t = ids.join(own, key, "left").join(gathered, key, "left").join(genes, ["dset", "seq", "parent"], "left")
    empty = F.create_map().cast("map<string,string>")
    mine, up_ = F.coalesce("own", empty), F.coalesce("up", F.array().cast("array<struct<k:string,prefix:string,v:string>>"))
    # the exons' word comes before the coding parts' where the transcript says nothing
    fresh = F.filter(up_, lambda x: ~F.map_contains_key(mine, x["k"]) & ((x["prefix"] == "exon_") | ~F.exists(up_, lambda y: (y["k"] == x["k"]) & (y["prefix"] == "exon_"))))
    other = F.filter(up_, lambda x: F.try_element_at(mine, x["k"]) != x["v"])
    second = F.filter(up_, lambda x: ~F.map_contains_key(mine, x["k"]) & (x["prefix"] == "CDS_") & F.exists(up_, lambda y: (y["k"] == x["k"]) & (y["prefix"] == "exon_") & (y["v"] != x["v"])))
    named = F.concat(F.transform(fresh, lambda x: F.struct(x["k"].alias("k"), x["v"].alias("v"))), F.transform(F.concat(other, second), lambda x: F.struct(F.concat(x["prefix"], x["k"]).alias("k"), x["v"].alias("v"))))
    t = t.select(*key, "gene", F.map_from_entries(F.concat(F.filter(F.map_entries(mine), lambda x: ~F.exists(named, lambda y: y["k"] == x["key"])), F.transform(named, lambda x: F.struct(x["k"].alias("key"), x["v"].alias("value"))))).alias("attrs"))
    more = F.map_filter(F.coalesce("gene", empty), lambda k, v: ~F.map_contains_key(F.col("attrs"), k) & ~k.isin("ID", "Parent") & ~((k == "description") & F.coalesce(F.try_element_at("attrs", F.lit("product")) == v, F.lit(False))))
    t = t.select(*key, F.map_concat("attrs", more).alias("attrs"))
    gone = up.groupBy(*key, F.expr("if(prefix = 'exon_', 'exon', 'cds')").alias("kind")).agg(F.collect_set("k").alias("gone"))
    left = F.map_filter("attrs", lambda k, v: ~F.array_contains(F.coalesce("gone", F.array().cast("array<string>")), k) & ~k.isin(*NUMBERING))
    return t, parts.join(gone, [*key, "kind"], "left").select(*key, "kind", "s", "e", left.alias("attrs"))


def parted_ids(features: DataFrame, reach: int = MAX_SPAN) -> DataFrame:
    """features in which an id that is used again more than ``reach`` bases on is an id of its own.

    Lines of one id (a transcript's own, and its parts' by their parent) are taken by place on a sequence; where the next one
    starts farther than ``reach`` behind the end of all before it, another record begins. The first keeps its
    id, those behind it get ``id.2`` and so on.
    """
    # a part belongs to a transcript's id by its parent; transcripts themselves and genes by their own
    record = F.when(F.col("kind").isin("transcript", "gene"), F.col("id")).otherwise(F.col("parent"))
    f = features.withColumn("_record", record).withColumn("_kind", F.expr("if(kind = 'gene', 'gene', 'tx')"))
    by = ["dset", "seq", "_kind", "_record"]
    w = Window.partitionBy(*by).orderBy("s", "e", "strand")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    far = F.col("s") - F.max("e").over(before) > reach
    f = f.withColumn("_new", F.coalesce(far, F.lit(False)).cast("int"))
    f = f.withColumn("_part", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    named = lambda c: F.when(F.col("_record").isNotNull() & (F.col("_part") > 0), F.concat(c, F.lit("."), (F.col("_part") + 1).cast("string"))).otherwise(F.col(c))
    own = F.col("kind").isin("transcript", "gene")
    return f.withColumn("id", F.when(own, named("id")).otherwise(F.col("id"))).withColumn("parent", F.when(own, F.col("parent")).otherwise(named("parent"))).select(*features.columns)


def coding_chains(features: DataFrame, transcripts: DataFrame) -> DataFrame:
    """(dset, tid, seq, strand, cds, separate, phase) of transcripts with coding parts.

    cds are sorted segments (s, e, phase). A coding chain that follows the exons is given as the exons clipped to its bounds;
    one that doesn't (a frame shift, say) is kept as it was read, and ``separate``. The first segment's phase in the direction
    of the strand is read from its line, the others' are counted on from it; a chain of which all lines give a phase, the
    first not 0, keeps its lines' phases.
    """
    parts = features.where("kind = 'cds' and parent is not null").select("dset", "seq", F.col("parent").alias("tid"), F.struct("s", "e", F.expr("try_cast(phase as int)").alias("phase")).alias("x")).distinct()
    read = parts.groupBy("dset", "seq", "tid").agg(F.array_sort(F.collect_list("x")).alias("read"))
    t = transcripts.select("dset", "tid", "seq", "strand", "exons").join(read, ["dset", "seq", "tid"])
    first = F.when(F.col("strand") == "-", F.element_at("read", -1)["phase"]).otherwise(F.element_at("read", 1)["phase"])
    t = t.withColumn("phase", F.coalesce(first, F.lit(0))).withColumn("separate", ~coding.follows(F.col("read"), F.col("exons")))
    bounds = F.col("read")[0]["s"], F.element_at("read", -1)["e"]
    own = F.when((F.col("phase") > 0) & F.forall("read", lambda x: x["phase"].isNotNull()), F.col("read")).otherwise(coding.phased(F.col("read"), F.col("strand"), F.col("phase")))
    follow = coding.phased(coding.clipped(F.col("exons"), *bounds), F.col("strand"), F.col("phase"))
    return t.select("dset", "tid", "seq", "strand", F.when(F.col("separate"), own).otherwise(follow).alias("cds"), "separate", "phase")

"""Coding segments of exon chains: clipping, reading phases, and whether a coding chain follows its exons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NONE = "array<struct<s:bigint,e:bigint,phase:int>>"


def clipped(exons: Column, cs: Column, ce: Column) -> Column:
    """The parts of exons between coding bounds; none where there are no bounds."""
    inside = F.filter(exons, lambda x: (x["e"] >= cs) & (x["s"] <= ce))
    return F.coalesce(F.transform(inside, lambda x: F.struct(F.greatest(x["s"], cs).alias("s"), F.least(x["e"], ce).alias("e"))), F.array().cast("array<struct<s:bigint,e:bigint>>"))


def phased(segments: Column, strand: Column, first: Column) -> Column:
    """Sorted segments with the bases that each must skip to reach a codon's start, read in the direction of the strand.

    ``first`` is the phase of the first segment in that direction, 0 if it isn't known: lengths before a segment are summed modulo 3.
    """
    back = strand == "-"
    directed = F.when(back, F.reverse(segments)).otherwise(segments)
    lead = F.when(first.isin(1, 2), 3 - first).otherwise(0).cast("long")
    start = F.struct(lead.alias("n"), F.array().cast(_NONE).alias("out"))

    def put(acc: Column, x: Column) -> Column:
        seg = F.struct(x["s"].alias("s"), x["e"].alias("e"), ((3 - acc["n"] % 3) % 3).cast("int").alias("phase"))
        return F.struct((acc["n"] + x["e"] - x["s"] + 1).alias("n"), F.array_append(acc["out"], seg).alias("out"))

    out = F.aggregate(directed, start, put, lambda acc: acc["out"])
    return F.when(back, F.reverse(out)).otherwise(out)


def follows(segments: Column, exons: Column) -> Column:
    """Whether a coding chain agrees with its exons: from the exon of its first base on, all inner ends are the exons', and its last base lies
    in the exon reached. One segment always does."""
    n, m = F.size(segments), F.size(exons)
    at = F.array_position(F.transform(exons, lambda x: (segments[0]["s"] >= x["s"]) & (segments[0]["s"] <= x["e"])), True).cast("int")
    own = F.slice(exons, F.greatest(at, F.lit(1)), n)
    inner = F.forall(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda i: (F.get(own, i)["e"] == F.get(segments, i)["e"]) & (F.get(own, i + 1)["s"] == F.get(segments, i + 1)["s"]))
    end, last = F.get(segments, n - 1)["e"], F.get(own, n - 1)
    many = (n <= m) & (at > 0) & (F.size(own) == n) & F.coalesce(inner, F.lit(False)) & (end >= last["s"]) & (end <= last["e"])
    return F.when(n < 2, True).otherwise(F.coalesce(many, F.lit(False)))

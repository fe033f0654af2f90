"""Column functions over closed intervals and exon chains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlaps(s1, e1, s2, e2) -> Column:
    return (F.col(s1) <= F.col(e2)) & (F.col(e1) >= F.col(s2))


def overlap_len(s1, e1, s2, e2) -> Column:
    return F.greatest(F.lit(0), F.least(F.col(e1), F.col(e2)) - F.greatest(F.col(s1), F.col(s2)) + 1)


def introns(exons: Column) -> Column:
    """The gaps between neighbouring exons of a sorted chain; a single exon has none."""
    n = F.size(exons)
    gap = lambda i: F.struct((F.get(exons, i - 1)["e"] + 1).alias("s"), (F.get(exons, i)["s"] - 1).alias("e"))
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), gap)).otherwise(F.array().cast("array<struct<s:bigint,e:bigint>>"))


def covered(exons: Column) -> Column:
    return F.aggregate(exons, F.lit(0).cast("long"), lambda n, x: n + x["e"] - x["s"] + 1)


def merge_close(exons: Column, gap: int = 4) -> Column:
    """A sorted chain with neighbours merged that are at most ``gap`` bases apart (or overlap)."""
    none = F.array().cast("array<struct<s:bigint,e:bigint>>")

    def add(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))
        near = (F.size(done) > 0) & (x["s"] - F.try_element_at(done, F.lit(-1))["e"] - 1 <= gap)
        return F.when(near, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(F.struct(x["s"].alias("s"), x["e"].alias("e")))))

    return F.aggregate(exons, none, add)


def rendered(exons: Column) -> Column:
    """``s-e,s-e`` text of a chain."""
    return F.array_join(F.transform(exons, lambda x: F.concat(x["s"].cast("string"), F.lit("-"), x["e"].cast("string"))), ",")

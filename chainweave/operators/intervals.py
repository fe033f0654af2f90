"""Interval joins and interval unions as DataFrame plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainweave.session import stage_table

#: Bases of a bin when unions are made piece by piece.
PIECE = 1 << 16
#: Widths of bins, from short intervals to long ones: an interval's own width is the least that is not below its length.
WIDTHS = (1 << 10, 1 << 14, 1 << 18, 1 << 22, 1 << 26, 1 << 32)


def islands(df: DataFrame, keys: list[str], reach: int = 0, piece: int = PIECE) -> DataFrame:
    """Unions of intervals (s, e) that overlap, or are at most ``reach`` bases apart, within keys.

    Unions are made inside bins of ``piece`` bases by start first. What of them hangs together over bins follows
    from one row a bin: the farthest end before it, and how many unions begin before it.
    """
    d = df.select(*keys, "s", "e").distinct().withColumn("bin", F.expr(f"s div {piece}"))
    w = Window.partitionBy(*keys, "bin").orderBy("s", "e")
    d = d.withColumn("until", F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    d = d.withColumn("k", F.sum(F.when(F.col("s") > F.col("until") + reach, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = d.groupBy(*keys, "bin", "k").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    before = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # one row a bin
    ends = parts.groupBy(*keys, "bin").agg(F.max("e").alias("end")).select(*keys, "bin", F.max("end").over(before).alias("carry"))
    parts = parts.join(ends, [*keys, "bin"]).withColumn("fresh", F.expr(f"carry is null or s > carry + {reach}"))
    starts = parts.groupBy(*keys, "bin").agg(F.sum(F.col("fresh").cast("long")).alias("n")).select(*keys, "bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # of a bin's unions those that hang on to what came before are the first ones
    own = Window.partitionBy(*keys, "bin").orderBy("s")
    parts = parts.join(starts, [*keys, "bin"]).withColumn("n", F.col("base") + F.sum(F.col("fresh").cast("long")).over(own))
    return parts.groupBy(*keys, "n").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("n")


def _level(length: Column) -> Column:
    out = F.lit(len(WIDTHS) - 1)
    for i in range(len(WIDTHS) - 2, -1, -1):
        out = F.when(length <= WIDTHS[i], i).otherwise(out)
    return out


def range_join(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of rows whose intervals (a: s, e; b: s2, e2) overlap, equal in keys.

    A pair meets in the bins of the longer of the two intervals, at most two of which hold either; only the first
    bin that both touch counts, so that no pair comes twice and nothing has to be made distinct. An interval is
    only laid into bins of widths that intervals of the other side have, so that short ones among short ones have one
    row each. A crowded bin is a skewed join key, which adaptive execution splits.
    """
    width = F.element_at(F.array(*map(F.lit, WIDTHS)), F.col("_level") + 1)

    def own(df: DataFrame, s: str, e: str) -> DataFrame:
        return df.withColumn("_level", _level(F.expr(f"{e} - {s} + 1")))

    def occurring(df: DataFrame, s: str, e: str) -> Column:
        """The levels of a side's intervals as bits of one number, found when the join runs."""
        return own(df.select(s, e), s, e).agg(F.bit_or(F.expr("shiftleft(1, _level)"))).scalar()

    def lifted(df: DataFrame, s: str, e: str, beyond: int, levels: Column) -> DataFrame:
        """A row for each level from its own (plus ``beyond``) on that the other side has intervals of."""
        df = own(df, s, e).withColumn("_there", F.coalesce(levels, F.lit(0)))
        upward = f"slice(array({', '.join(map(str, range(len(WIDTHS))))}), _level + {beyond + 1}, {len(WIDTHS)})"
        return df.withColumn("_level", F.explode(F.expr(f"filter({upward}, l -> (_there & shiftleft(1, l)) <> 0)"))).drop("_there")

    def binned(df: DataFrame, s: str, e: str) -> DataFrame:
        return df.withColumn("_w", width).withColumn("_bin", F.explode(F.expr(f"sequence({s} div _w, {e} div _w)"))).drop("_w")

    def meet(x: DataFrame, y: DataFrame) -> DataFrame:
        met = binned(x, "s", "e").join(binned(y, "s2", "e2"), [*keys, "_level", "_bin"])
        return met.withColumn("_w", width).where("s <= e2 and e >= s2 and _bin = greatest(s, s2) div _w").drop("_level", "_bin", "_w")

    here, there = occurring(a, "s", "e"), occurring(b, "s2", "e2")
    return meet(own(a, "s", "e"), lifted(b, "s2", "e2", 0, here)).unionByName(meet(lifted(a, "s", "e", 1, there), own(b, "s2", "e2")))


def met_by(a: DataFrame, b: DataFrame, keys: list[str], piece: int = PIECE) -> DataFrame:
    """(keys, s, e, m, n, bases) of the different intervals of a that meet any of b: how many of a they are, how many of b overlap one of them and in how many bases.

    A row with copies is so many intervals. No pair is made: those of b that begin by an interval's end, less those that end before it, and the bases of b up to a
    place, come from running sums, made in bins of ``piece`` bases after those of the bins before.
    """
    size = lambda df: F.sum("copies") if "copies" in df.columns else F.count("*")
    spots = stage_table(a.groupBy(*keys, "s", "e").agg(size(a).alias("m")), "spots", tidy=True)
    event = lambda at, n, x: {"at": at, "begun": f"{n} * {x}", "first": f"{n} * {x} * {at}", "ended": f"{n} * (1 - {x})", "last": f"{n} * (1 - {x}) * {at}"}
    rows = lambda df, at, n, x: df.select(*keys, *[F.expr(v).cast("long").alias(k) for k, v in event(at, n, x).items()])
    held = stage_table(b.groupBy(*keys, "s", "e").agg(size(b).alias("n")), "spots", tidy=True)
    points = rows(held, "s", "n", "1").unionByName(rows(held, "e", "n", "0")).unionByName(rows(spots, "e", "0", "1")).unionByName(rows(spots, "(s - 1)", "0", "1"))
    sums = ["begun", "first", "ended", "last"]
    points = points.groupBy(*keys, "at").agg(*[F.sum(c).alias(c) for c in sums]).withColumn("bin", F.expr(f"at div {piece}"))
    before = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # one row a bin
    bins = points.groupBy(*keys, "bin").agg(*[F.sum(c).alias(c) for c in sums]).select(*keys, "bin", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_0") for c in sums])
    here = Window.partitionBy(*keys, "bin").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    points = points.select(*keys, "bin", "at", *[F.sum(c).over(here).alias(c) for c in sums]).join(bins, [*keys, "bin"])
    points = points.select(*keys, "at", *[(F.col(c) + F.col(f"{c}_0")).alias(c) for c in sums]).withColumn("upto", F.expr("begun * (at + 1) - first - ended * at + last"))
    low = points.select(*keys, (F.col("at") + 1).alias("s"), F.col("ended"), F.col("upto").alias("upto_0"))
    high = points.select(*keys, F.col("at").alias("e"), "begun", "upto")
    out = spots.join(low, [*keys, "s"]).join(high, [*keys, "e"])
    return out.select(*keys, "s", "e", "m", (F.col("begun") - F.col("ended")).alias("n"), (F.col("upto") - F.col("upto_0")).alias("bases")).where("n > 0")

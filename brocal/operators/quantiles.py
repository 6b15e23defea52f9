"""Exact quantiles without a task that holds all values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brocal.session import cut

#: Bins of an octave; a bin's values differ by some two per cent.
BINS = 32
#: Bins that are looked into are broadcast up to this number (some 50 bytes each).
BROADCAST_BINS = 100_000


def _bin(x: Column) -> Column:
    """A whole number that grows with x, whatever its scale; not-a-number comes last, as in any order of doubles."""
    size = F.greatest(F.least(F.floor(F.log2(F.abs(x)) * BINS), F.lit(99_998)), F.lit(-99_998)) + 100_000
    return F.when(F.isnan(x), 300_000).when(x == 0, 0).when(x > 0, size).otherwise(-size).cast("int")


def quantiles(df: DataFrame, x: Column, shares: Sequence[float], by: Column | None = None) -> DataFrame:
    """`grupo`, `q`: the interpolated quantiles of `x` (a double) at `shares`, exact, for each value of `by`, or of all rows.

    1. Rows are counted by group and bin, with partial results; the running
       counts of a group's bins (some tens of thousands at most) tell which
       bin holds each rank that is asked for.
    2. Only the values of these bins are counted, each bin on its own, and the
       values at the ranks read off.

    No task sees more than the distinct values of one bin of one group.  Null
    values count as none; a group without values has no row, and without `by`
    nor values the result has one row with a null `q`.
    """
    alone = by is None
    v = df.select((F.lit(0) if alone else by).alias("grupo"), x.alias("x")).where("x is not null").withColumn("b", _bin(F.col("x")))
    bins = cut(v.groupBy("grupo", "b").agg(F.count(F.lit(1)).alias("n")))
    upto = Window.partitionBy("grupo").orderBy("b")
    whole = Window.partitionBy("grupo")
    placed = bins.select("grupo", "b", "n", (F.sum("n").over(upto) - F.col("n")).alias("antes"), F.sum("n").over(whole).alias("total"))
    at = F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(float(p)) * (F.col("total") - 1)).alias("at")) for i, p in enumerate(shares)])
    asked = placed.select("grupo", "b", "n", "antes", F.explode(at).alias("p")).select("grupo", "b", "n", "antes", "p.i", "p.at", F.explode(F.array_distinct(F.array(F.floor("p.at"), F.ceil("p.at")))).alias("rango"))
    asked = cut(asked.where((F.col("rango") >= F.col("antes")) & (F.col("rango") < F.col("antes") + F.col("n"))).drop("n"))
    wanted = asked.select("grupo", "b").distinct()
    if asked.count() <= BROADCAST_BINS:
        wanted = F.broadcast(wanted)
    g = F.col("grupo").eqNullSafe(F.col("__g"))
    held = v.join(wanted.withColumnsRenamed({"grupo": "__g", "b": "__b"}), g & (F.col("b") == F.col("__b"))).groupBy("grupo", "b", "x").agg(F.count(F.lit(1)).alias("k"))
    run = Window.partitionBy("grupo", "b").orderBy("x")
    held = held.select("grupo", "b", "x", (F.sum("k").over(run) - F.col("k")).alias("desde"), "k")
    asked = asked.withColumnsRenamed({"grupo": "__g", "b": "__b"})
    here = F.col("rango") - F.col("antes")
    found = held.join(asked, g & (F.col("b") == F.col("__b")) & (here >= F.col("desde")) & (here < F.col("desde") + F.col("k")))
    per = found.groupBy("grupo", "i").agg(F.min("at").alias("at"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    part = F.col("at") - F.floor("at")
    value = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise((1 - part) * F.col("lo") + part * F.col("hi"))
    out = per.groupBy("grupo").agg(F.map_from_entries(F.collect_list(F.struct("i", value.alias("v")))).alias("m"))
    out = out.select("grupo", F.array(*[F.col("m")[i] for i in range(len(shares))]).alias("q"))
    if not alone:
        return out
    # one row, even of no values
    return out.agg(F.first("q").alias("q")).select(F.lit(0).alias("grupo"), "q")

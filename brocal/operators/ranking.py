"""Ranks and samples without a single-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters of the hash that cut a group into parts (16 to the power of it).
PREFIX = 3


def global_rank(df: DataFrame, coarse: Sequence[Column], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """`df` with its row number in the order of all rows.

    `coarse` are ascending sort keys that come before `order` and cut the rows
    into groups; only the counts of the groups go through one task, each
    group is numbered in its own.
    """
    keyed = df.withColumns({f"__c{i}": c for i, c in enumerate(coarse)})
    by = [f"__c{i}" for i in range(len(coarse))]
    sizes = keyed.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*[F.col(c).alias(f"__b{c}") for c in by], F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    match = None
    for c in by:
        one = F.col(c).eqNullSafe(F.col(f"__b{c}"))
        match = one if match is None else match & one
    inside = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return keyed.withColumn("__i", inside).join(sizes, match).withColumn(name, (F.col("__before") + F.col("__i")).cast("bigint")).select(*df.columns, name)


def hash_order(key: str, seed: int = 42) -> Column:
    """A random but repeatable order of rows: md5 of key and seed."""
    return F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))


def sample_exact(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Simple random sample without replacement of exactly n rows."""
    return df.withColumn("__h", hash_order(key, seed)).orderBy("__h", key).limit(n).drop("__h")


def rank_within(df: DataFrame, by: str, key: str, seed: int, name: str = "__i") -> DataFrame:
    """`df` with its row number among the rows with the same `by`, in the order of hash and key.

    Rows are numbered by group and first characters of the hash, and those
    that come before counted, so a group of any size is many tasks.
    """
    keyed = df.withColumns({"__by": F.col(f"`{by}`"), "__h": hash_order(key, seed)}).withColumn("__p", F.substring("__h", 1, PREFIX))
    sizes = keyed.groupBy("__by", "__p").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__by").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("__by").alias("__g"), F.col("__p").alias("__q"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__by", "__p").orderBy("__h", key))
    ranked = keyed.withColumn("__r", inside).join(sizes, F.col("__by").eqNullSafe(F.col("__g")) & (F.col("__p") == F.col("__q")))
    return ranked.withColumn(name, F.col("__before") + F.col("__r")).select(*df.columns, name)


def sample_strata(df: DataFrame, key: str, stratum: str, fraction: float, seed: int = 42) -> DataFrame:
    """round(fraction * size) rows of each stratum, at least one."""
    sizes = df.groupBy(F.col(stratum).alias("__s")).agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * fraction + 0.5)).alias("__take"))
    return rank_within(df, stratum, key, seed).join(sizes, F.col(stratum).eqNullSafe(F.col("__s"))).where("__i <= __take").select(*df.columns)


def balance(df: DataFrame, key: str, label: str, how: str = "under", seed: int = 42) -> DataFrame:
    """All classes at the size of the smallest (under), or of the largest (over): then rows repeat in turn, with their `copia`."""
    sizes = df.groupBy(F.col(label).alias("__s")).agg(F.count(F.lit(1)).alias("__n"))
    goal = sizes.agg((F.min if how == "under" else F.max)("__n").alias("__goal"))
    ranked = rank_within(df, label, key, seed).join(sizes.join(F.broadcast(goal)), F.col(label).eqNullSafe(F.col("__s")))
    if how == "under":
        return ranked.where("__i <= __goal").select(*df.columns, F.lit(0).cast("bigint").alias("copia"))
    times = F.floor((F.col("__goal") - F.col("__i")) / F.col("__n"))
    return ranked.withColumn("copia", F.explode(F.sequence(F.lit(0).cast("bigint"), times.cast("bigint")))).select(*df.columns, "copia")


def split(df: DataFrame, key: str, share: float = 0.8, seed: int = 42) -> DataFrame:
    """`df` with `parte`, train or test, by the hash of the key: the same row is always on the same side."""
    bucket = F.conv(F.substring(hash_order(key, seed), 1, 8), 16, 10).cast("bigint")
    return df.withColumn("parte", F.when(bucket < int(share * 2**32), "train").otherwise("test"))

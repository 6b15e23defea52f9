"""Joins of many rows back to a table of keys, whatever share of the rows one key holds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brocal.session import cut

#: A key with more than this share of all rows is hot: there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 1 / 1000
#: And it has more rows than this, as few rows need no splitting.
HOT_ROWS = 100_000
#: Members of a group from which its pairs are made by blocks.
BLOCK = 2_000
#: Blocks of a join that a task gets on the average, and the most tasks.
BLOCKS, TASKS = 4, 10_000


def hot_limit(total: int) -> int:
    return max(HOT_ROWS, int(total * HOT_SHARE))


def join_back(rows: DataFrame, wanted: DataFrame, by: Sequence[str], size: str, limit: int, crowded: DataFrame | None = None) -> DataFrame:
    """`rows` joined to `wanted` on `by`; `size` is a column of `wanted` with the number of rows of the key.

    Keys with more than `limit` rows (see `hot_limit`) are few by arithmetic
    and meet their rows by broadcast.  All rows of crowded keys are taken off
    (`crowded` lists such keys where they are not all in `wanted`) before the
    others are shuffled to theirs.
    """
    by = list(by)
    hot = F.col(size) > limit
    listed = (wanted.where(hot) if crowded is None else crowded).select(*by)
    of_hot = rows.join(F.broadcast(wanted.where(hot).drop(size)), by)
    of_rest = rows.join(F.broadcast(listed), by, "left_anti").join(wanted.where(~hot).drop(size), by)
    return of_hot.unionByName(of_rest)


def left_back(rows: DataFrame, wanted: DataFrame, by: Sequence[str], size: str, limit: int) -> DataFrame:
    """All `rows`, with the columns of `wanted` (but `size`) where their key is there; hot keys as in `join_back`. Keys of `rows` aren't null."""
    by = list(by)
    hot = F.broadcast(wanted.where(F.col(size) > limit).drop(size))
    of_rest = rows.join(hot.select(*by), by, "left_anti").join(wanted.where(F.col(size) <= limit).drop(size), by, "left")
    return rows.join(hot, by).unionByName(of_rest)


def block_pairs(rows: DataFrame, member: str, by: Sequence[str], most: int = BLOCK) -> DataFrame:
    """a, b (a < b): the pairs of different members of each group, once for each group that they share.

    Groups of more than `most` are cut into blocks by hash, and blocks meet
    pairwise, each two of them in a task of their own.  For results that are
    the pairs themselves; members are listed once in a group.
    """
    by = list(by)
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(*by, F.ceil(F.col("__n") / most).cast("int").alias("__k"))
    placed = rows.select(*by, F.col(member).alias("__m")).join(sizes, by).withColumn("__i", F.pmod(F.xxhash64("__m"), F.col("__k")).cast("int"))
    ahead = placed.select(*by, F.col("__m").alias("__x"), F.col("__i").alias("__p"), F.explode(F.sequence(F.col("__i"), F.col("__k") - 1)).alias("__q"))
    back = placed.select(*by, F.col("__m").alias("__y"), F.explode(F.sequence(F.lit(0), F.col("__i"))).alias("__p"), F.col("__i").alias("__q"))
    met = ahead.join(back, [*by, "__p", "__q"]).where((F.col("__x") != F.col("__y")) & ((F.col("__p") != F.col("__q")) | (F.col("__x") < F.col("__y"))))
    return met.select(F.least("__x", "__y").alias("a"), F.greatest("__x", "__y").alias("b"))


def block_join(a: DataFrame, b: DataFrame, on: str, how: str, most: int = BLOCK) -> DataFrame:
    """`a` joined to `b` on a column, for keys of many rows on both sides, whose result is far larger than both.

    Both sides of a key of more than `most` x `most` result rows are cut into
    blocks by hash, and blocks meet pairwise.  Such keys have rows on both
    sides, so each `how` treats them alike; the others are joined as they are.
    """
    na, nb = (d.where(F.col(on).isNotNull()).groupBy(on).agg(F.count(F.lit(1)).alias(n)) for d, n in ((a, "__na"), (b, "__nb")))
    hot = cut(na.join(nb, on).where(F.col("__na") * F.col("__nb") > most * most).select(on, *[F.ceil(F.col(n) / most).cast("int").alias(k) for n, k in (("__na", "__ka"), ("__nb", "__kb"))]))
    blocks = hot.agg(F.sum(F.col("__ka") * F.col("__kb"))).first()[0]
    if not blocks:
        return a.join(b, on, how)
    tasks = max(1, min(TASKS, blocks // BLOCKS))

    def placed(d: DataFrame, own: str, other: str, k: str, others: str) -> DataFrame:
        d = d.withColumn(own, F.xxhash64(*d.columns)).join(F.broadcast(hot), on)
        d = d.withColumn(own, F.pmod(F.col(own), F.col(k)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(others) - 1))).drop("__ka", "__kb")
        # a number of its own, else few bytes would be put together in few tasks
        return d.repartition(tasks, on, "__i", "__j")

    met = placed(a, "__i", "__j", "__ka", "__kb").hint("merge").join(placed(b, "__j", "__i", "__kb", "__ka"), [on, "__i", "__j"]).drop("__i", "__j")
    keys = F.broadcast(hot.select(on))
    return met.unionByName(a.join(keys, on, "left_anti").join(b.join(keys, on, "left_anti"), on, how))

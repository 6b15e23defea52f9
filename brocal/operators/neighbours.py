"""The nearest rows of a table, exact at any size: all pairs of blocks are compared, and the best of the blocks merged."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brocal.session import ship

#: Rows of a block, on average; of its queries, so many are compared at a time.
BLOCK, AT_ONCE = 10_000, 128


def _matrix(t: pa.Table) -> np.ndarray:
    return np.array([[np.nan if v is None else v for v in r] for r in t.column("x").to_pylist()], float)


def _pairs(k: int):
    def compare(queries: pa.Table, donors: pa.Table) -> pa.Table:
        keys, dist, orders, values = [], [], [], []
        if queries.num_rows and donors.num_rows:
            donors = donors.sort_by("orden")
            q, t = _matrix(queries), _matrix(donors)
            qg, tg = (x.column("grupo").to_numpy() for x in (queries, donors))
            order, value = (donors.column(c).to_numpy() for c in ("orden", "valor"))
            for at in range(0, len(q), AT_ONCE):
                part = q[at : at + AT_ONCE]
                d, both = np.zeros((len(part), len(t))), np.zeros((len(part), len(t)))
                # squared distance over the columns that both have, scaled up to all
                for c in range(q.shape[1]):
                    gap = part[:, c, None] - t[None, :, c]
                    have = ~np.isnan(gap)
                    d += np.where(have, gap, 0.0) ** 2
                    both += have
                d = np.where(both > 0, d * q.shape[1] / np.maximum(both, 1), np.inf)
                other = qg[at : at + AT_ONCE, None] != tg[None, :]
                # rows of the same group come last and are left out; donors are in order already, so a stable sort settles ties
                near = np.argsort(np.where(other, d, np.nan), axis=1, kind="stable")[:, :k]
                for i, row in enumerate(near):
                    row = row[other[i, row]]
                    keys += [at + i] * len(row)
                    dist.append(d[i, row])
                    orders.append(order[row])
                    values.append(value[row])
        join = lambda x, kind: pa.array(np.concatenate(x) if x else [], kind)
        return pa.table({"k": queries.column("k").take(pa.array(keys, pa.int64())), "d": join(dist, pa.float64()), "orden": join(orders, pa.int64()), "valor": join(values, pa.float64())})

    return compare


def nearest(queries: DataFrame, donors: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """k, cerca: the `k` nearest donors of each query, as structs of d, orden, valor, the nearest first.

    Both tables have x (an array of doubles) and grupo (bigint); queries have
    k, donors orden (bigint, settles ties) and valor.  Donors of the query's own
    group are not taken.  Distance is Euclidean over what both rows have,
    scaled up for the rest.
    """
    ship(queries.sparkSession)
    n, m = (max(1, math.ceil(d.count() / block)) for d in (queries, donors))
    left = queries.withColumn("i", F.pmod(F.xxhash64("k"), F.lit(n)).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    right = donors.withColumn("j", F.pmod(F.xxhash64("orden"), F.lit(m)).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    kind = queries.schema["k"].dataType.simpleString()
    pairs = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(_pairs(k), f"k {kind}, d double, orden bigint, valor double")
    return pairs.groupBy("k").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "orden", "valor"))), 1, k).alias("cerca"))

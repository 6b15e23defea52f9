import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from brocal.operators import prep as P
from brocal.operators.skew import block_join

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def parties(spark):
    """Customers and suppliers by nation, counted from the files alone."""
    c, s = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("customer", "supplier"))
    return [{r[0]: r[1] for r in d.groupBy(k).count().collect()} for d, k in ((c, "c_nationkey"), (s, "s_nationkey"))]


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
def test_registered_joins_take_the_whole_tables(spark, parties, how):
    a, b = parties
    expected = sum(n * b[k] for k, n in a.items() if k in b)
    expected += sum(n for k, n in a.items() if k not in b) * (how in ("left", "outer")) + sum(n for k, n in b.items() if k not in a) * (how in ("right", "outer"))
    assert __spark_entry__.queries()[f"integ_join_{how}"](spark, DATA).count() == expected


def test_registered_union_and_key_report_take_the_whole_tables(spark, parties):
    a, b = parties
    rows = __spark_entry__.queries()["integ_union"](spark, DATA).collect()
    assert {r["c_nationkey"]: r["n"] for r in rows} == {k: a.get(k, 0) + b.get(k, 0) for k in {*a, *b}}
    r = __spark_entry__.queries()["integ_keys"](spark, DATA).first()
    assert tuple(r) == (len(a), len(b), len({*a} & {*b}), len({*a} - {*b}), len({*b} - {*a}))


def test_keys_without_a_partner(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "k int, name string"), spark.createDataFrame([(2, "p"), (2, "q"), (3, "r")], "k int, name string")
    made = {how: sorted(map(tuple, P.joined(a, b, "k", how).collect()), key=str) for how in ("inner", "left", "right", "outer")}
    both, left, right = [(2, "y", "p"), (2, "y", "q")], [(1, "x", None), (None, "z", None)], [(3, None, "r")]
    assert made == {h: sorted(both + left * (h in ("left", "outer")) + right * (h in ("right", "outer")), key=str) for h in made}
    assert tuple(P.key_report(a, b, "k").first()) == (2, 2, 1, 1, 1)


@pytest.mark.parametrize("rows, block", [(300, 37), (24_000, 10_000)])
def test_imputed_values_come_from_the_nearest_of_all_rows(spark, rows, block):
    r = random.Random(1)
    data = [(i, None if i % (rows // 60) == 0 else r.random(), r.random() if r.random() > 0.1 else None, r.random()) for i in range(rows)]
    df = spark.createDataFrame(data, "id long, v double, a double, b double")
    made = {x["id"]: x["valor"] for x in P.impute_knn(df, "id", "v", ["a", "b"], **({"block": block} if block < 10_000 else {})).collect()}
    m = np.array([[np.nan if x is None else x for x in d[1:]] for d in data])
    z = (m - np.nanmean(m, axis=0)) / np.nanstd(m, axis=0, ddof=1)
    donors = np.flatnonzero(~np.isnan(m[:, 0]))
    assert len(made) == rows and all(made[i] == data[i][1] for i in donors)
    for i in set(range(rows)) - {*donors.tolist()}:
        gap = z[donors] - z[i]
        d = np.nansum(gap**2, axis=1) * 3 / (~np.isnan(gap)).sum(axis=1)
        assert made[i] == pytest.approx(m[donors[np.argsort(d)[:5]], 0].mean())


def test_association_of_columns_with_millions_of_rows_a_cell(spark):
    """The products of the counts pass 64 bits."""
    n = 20_000_000
    df = spark.range(n).select(F.when(F.col("id") < n // 2, "x").otherwise("y").alias("a"), F.when(F.col("id") < n // 4 * 3, "p").otherwise("q").alias("b"))
    # cells 1/2, 0, 1/4, 1/4: phi = (1/2 * 1/4 - 0 * 1/4) / sqrt(1/2 * 1/2 * 3/4 * 1/4)
    assert P.cramers_v(df, "a", "b").first()["v"] == pytest.approx(0.125 / (3 / 64) ** 0.5, abs=1e-6)


def test_keys_of_many_pairs_are_joined_by_blocks(spark):
    """Every kind of join equals the plain one, and no task makes all rows of the large key."""
    a = spark.createDataFrame([(k, f"a{i}") for i in range(300) for k in ([1] if i < 250 else [2, None] if i < 280 else [4])], "k int, x string")
    b = spark.createDataFrame([(k, f"b{i}") for i in range(120) for k in ([1, 3] if i < 90 else [2, None])], "k int, y string")
    for how in ("inner", "left", "right", "outer"):
        got = block_join(a, b, "k", how, 20)
        assert got.columns == ["k", "x", "y"] and sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, a.join(b, "k", how).collect()), key=str)
    of_task = block_join(a, b, "k", "inner", 20).groupBy(F.spark_partition_id()).count().collect()
    assert len(of_task) > 8 and max(r["count"] for r in of_task) < 250 * 90 / 3
    assert block_join(a, b, "k", "outer").count() == a.join(b, "k", "outer").count()

from datetime import datetime as D

from pyspark.sql import functions as F

from brocal.operators.copies import first_by, keep_one, surplus_copies
from brocal.operators.orphans import Reference, unresolved, unresolved_report
from brocal.operators.skew import join_back

ROWS = "id long, robot string, sensor string, ts long, extra string"


def test_one_copy_stays_and_rows_without_identifier_are_no_copies(spark):
    df = spark.createDataFrame([(3, "a", "t", 1, "x"), (1, "a", "t", 1, "y"), (2, "a", "t", 2, None), (4, None, "t", 1, "z"), (5, None, "t", 1, "z")], ROWS)
    kept = keep_one(df, ["robot", "sensor", "ts"], ["id"], count=True, unique=True)
    assert sorted((r["id"], r["extra"], r["copies"]) for r in kept.collect()) == [(1, "y", 2), (2, None, 1), (4, "z", 1), (5, "z", 1)]
    assert [r["id"] for r in surplus_copies(df, ["robot", "sensor", "ts"], ["id"], "id").collect()] == [3]


def test_ties_are_settled_by_the_payload(spark):
    df = spark.createDataFrame([(1, "a", "t", 1, "b"), (1, "a", "t", 1, "a"), (1, "a", "t", 1, "a")], ROWS)
    assert [r["extra"] for r in keep_one(df, ["robot"], ["id"]).collect()] == ["a"]


def test_empty_tables_and_clashing_names(spark):
    df = spark.createDataFrame([], "id long, __row string, __order string, __alone string, copies int")
    assert keep_one(df, ["__row"], ["id"]).count() == 0
    one = spark.createDataFrame([(1, "a", "b", "c", 7)], df.schema)
    assert keep_one(one, ["__row"], ["id"]).collect()[0]["copies"] == 7


def test_a_hot_message_needs_no_room(spark):
    df = spark.range(50_000).select((F.col("id")).alias("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    assert surplus_copies(df, ["k"], ["id"], "id").count() == 16_666


def test_first_by_treats_null_as_a_value(spark):
    df = spark.createDataFrame([(2, None), (1, None), (3, "x")], "id long, email string")
    assert sorted(r["id"] for r in first_by(df, ["email"], ["id"]).collect()) == [1, 3]
    assert sorted(r["id"] for r in first_by(df, ["email"], ["id"], keep_nulls=True).collect()) == [1, 2, 3]


def tables(spark):
    t = lambda d: D(2026, 1, d)
    users = spark.createDataFrame([("u1", t(1), None), ("U2 ", t(5), t(10)), ("u3", t(20), None)], "_id string, ingested_at timestamp, deleted_at timestamp")
    likes = spark.createDataFrame(
        [("a", " U1", t(2)), ("b", "u2", t(6)), ("c", "u2", t(10)), ("d", "u3", t(2)), ("e", "u9", t(2)), ("f", None, t(2)), ("g", "", t(2)), ("g", "", t(2)), ("h", "u9", None)],
        "_id string, user_id string, ingested_at timestamp",
    )
    return {"likes": likes}, {"users": users}


def test_references_that_do_not_resolve(spark):
    got = unresolved(*tables(spark), [Reference("likes", "user_id", "users")])
    rows = sorted((r["fila_id"], r["periodo"] or "", r["clase"]) for r in got.collect())
    assert rows == [("c", "2026-01", "deleted"), ("d", "2026-01", "late"), ("e", "2026-01", "missing"), ("g", "2026-01", "missing"), ("g", "2026-01", "missing"), ("h", "", "missing")]
    assert sum(r["filas"] for r in unresolved_report(got).collect()) == 6


def test_empty_parents_and_children(spark):
    children, parents = tables(spark)
    ref = [Reference("likes", "user_id", "users")]
    assert unresolved(children, {"users": parents["users"].limit(0)}, ref).count() == 8
    assert unresolved({"likes": children["likes"].limit(0)}, parents, ref).count() == 0


def test_hot_keys_come_back_whole(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 600, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    wanted = rows.groupBy("k").agg(F.count("*").alias("n")).where("k = 'hot' or k > '9'")
    expected = rows.join(wanted, "k").count()
    assert join_back(rows, wanted, ["k"], "n", 100).count() == expected

import random
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from brocal.operators import late as L
from brocal.operators import spikes as S
from brocal.operators.finger import EMPTY, GONE, OPEN, PUBLISHED, FingerTree, merge
from brocal.operators.late import MINUTE, high_marks, late_corrections, merged_periods

T0 = datetime(2026, 1, 12)
SCHEMA = "lectura_id long, robot_id string, sensor string, ts timestamp_ntz, valor double, lote long"


def found(spark, rows, **k):
    df = spark.createDataFrame(rows, SCHEMA)
    limits = spark.createDataFrame([("t", -40.0, 150.0), ("b", 0.0, 100.0)], "sensor string, min_fisico double, max_fisico double")
    out = S.implausible(df, [F.col("robot_id"), F.col("sensor")], F.col("sensor"), "ts", "valor", "lectura_id", limits, {"b": 100.0})
    return sorted(r[0] for r in out.collect())


def series(values, sensor="t", robot="r", first=0):
    return [(first + i, robot, sensor, T0 + timedelta(minutes=i), v, i) for i, v in enumerate(values)]


def noise(n, seed=1):
    r = random.Random(seed)
    return [50 + r.gauss(0, 1) for _ in range(n)]


def test_spikes_bounds_and_stuck_runs_across_days(spark):
    v = noise(4000)
    for i in (5, 700, 1438, 1439, 1440, 2879, 3990):  # within days, over midnight, near the ends
        v[i] = 90.0
    v[100], v[200], v[300] = float("nan"), -41.0, 150.0
    v[1435 - 200 : 1445 - 200] = [51.0] * 10
    v[2875:2878], v[2000:2005] = [49.5] * 3, [48.0] * 5
    v[1436:1438] = [49.0, 51.5]
    v[3200:] = [x + 200 - 150 for x in v[3200:]]  # a lasting step
    expected = {5, 700, 1438, 1439, 1440, 2879, 3990, 100, 200, 300, *range(1235, 1245)}
    assert set(found(spark, series(v))) == expected


def test_four_in_a_row_are_a_level_and_ramps_are_none(spark):
    v = noise(600)
    v[300:304] = [90.0] * 2 + [91.0] * 2
    v[400:403] = [90.0, 91.0, 92.0]
    v[500:600] = [v[i] + min(i - 500, 60) for i in range(500, 600)]  # a rise that stays
    assert found(spark, series(v)) == [400, 401, 402]


def test_copies_come_out_with_their_reading_and_empty_readings_are_skipped(spark):
    rows = series(noise(200))
    rows[100] = (*rows[100][:4], 90.0, 100)
    rows[101] = (*rows[101][:4], None, 101)
    rows += [(1000, *rows[100][1:]), (1001, *rows[100][1:4], None, 150), (1002, *rows[50][1:])]
    assert found(spark, rows) == [100, 1000]


def test_full_battery_is_not_stuck_and_empty_tables(spark):
    v = [80 - i * 0.2 + random.Random(i).random() for i in range(60)]
    assert found(spark, series(v[:30] + [100.0] * 20 + v[30:], "b")) == []
    assert found(spark, series(v[:30] + [99.0] * 6 + v[30:], "b")) == list(range(30, 36))
    assert found(spark, []) == []
    assert found(spark, [(1, None, None, T0, 999.0, 0), (2, "r", "t", None, 999.0, 0), (3, "r", "t", T0, 151.0, 0)]) == [3]


def test_pieces_give_what_the_whole_series_gives():
    x = np.array(noise(500))
    x[[60, 61, 200, 333]] = 95
    inside = S.standoff_inside(x)[S.REACH : -S.REACH]
    assert np.allclose(inside, S.standoff(x)[S.REACH : -S.REACH])
    d = np.abs(np.random.default_rng(1).normal(size=5000))
    b, c = np.unique(S.bin_of(d), return_counts=True)
    assert abs(S.scatter_of(b, c) / (S.MAD * np.median(d)) - 1) < 0.05


def test_finger_tree_against_a_dictionary():
    r = random.Random(5)
    tree, plain, low = FingerTree(), {}, 0
    for step in range(4000):
        key = max(low, 1000 + step // 2 - int(r.expovariate(0.05)))
        part = (1, 1, float(key), float(key), float(key))
        tree.insert(key, part)
        plain[key] = merge(plain.get(key, EMPTY), part)
        if step % 97 == 0:
            low = max(low, 1000 + step // 2 - 60)
            gone = tree.evict(low)
            assert gone == sorted((k, v) for k, v in plain.items() if k < low)
            plain = {k: v for k, v in plain.items() if k >= low}
        if step % 50 == 0:
            assert list(tree.entries()) == sorted(plain.items())
            a, b = sorted((r.randrange(900, 3200), r.randrange(900, 3200)))
            whole = EMPTY
            for k, v in plain.items():
                if a <= k < b:
                    whole = merge(whole, v)
            assert tree.between(a, b) == whole and tree.root.total[0] == sum(v[0] for v in plain.values())


def test_corrections_and_cut_off(spark):
    at = lambda m: T0 + timedelta(minutes=m)
    rows = [(1, "a", "t", at(0), 1.0, 0), (2, "a", "t", at(6), 2.0, 1), (3, "a", "t", at(1), None, 2), (4, "a", "t", at(8), 4.0, 2), (5, "a", "t", at(2), float("nan"), 3), (6, "b", "t", at(3), 6.0, 3),
            (7, "a", "t", at(21), 7.0, 4), (8, "a", "t", at(4), 8.0, 5), (9, "a", "t", None, 9.0, 5), (10, None, "t", at(4), 9.0, 5), (11, "a", "t", at(4), 9.0, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    source = [F.col("robot_id"), F.col("sensor")]
    got = {r["lectura_id"]: r["destino"] for r in late_corrections(df, source, "ts", "lote", "lectura_id").collect()}
    assert got == {5: "corrige", 6: "corrige", 8: "descartada", 10: "descartada"}
    p = {(r["fuente"], r["inicio_us"]): r for r in merged_periods(late_corrections(df, source, "ts", "lote", "lectura_id", "valor", emit="periods")).collect()}
    a = p["a\x1ft", int((T0 - datetime(1970, 1, 1)) / timedelta(microseconds=1))]
    assert (a["primera_filas"], a["primera_n"], a["primera_suma"], a["final_filas"], a["final_n"], a["corrigen"], a["descartadas"]) == (2, 1, 1.0, 3, 1, 1, 1)
    assert late_corrections(df.limit(0), source, "ts", "lote", "lectura_id").count() == 0
    assert [r["marca"] for r in high_marks(df, "lote", "ts").orderBy("lote").collect()][0] is None
    assert MINUTE == 60_000_000


def _day(n=450_000):
    """One source-day whose noise changes within the day, with excursions and stuck runs, as sorted readings."""
    r = np.random.default_rng(3)
    x = 50 + r.normal(size=n) * np.where(np.arange(n) < n // 2, 1.0, 4.0)
    x[r.integers(20, n - 20, 300)] += 40
    x[1000:1010] = x[199_990:200_010] = 51.0
    return x


def _judged(x, size):
    n = len(x)
    t = pa.table({"fuente": pa.array(np.full(n, 7)), "dia": pa.array(np.zeros(n, np.int64)), "ts": np.arange(n), "fila": np.arange(n), "copias": np.ones(n, np.int64), "valor": x, "marca": pa.array(np.zeros(n, np.int8))})
    rows = pa.Table.from_batches(list(S.judge_pieces(iter(t.to_batches(max_chunksize=size)))))
    sure = rows.filter(pc.equal(rows["clase"], S.OUT))["fila"].to_pylist()
    rest = rows.filter(pc.not_equal(rows["clase"], S.OUT)).sort_by([("ts", "ascending")]).combine_chunks()
    got = pa.Table.from_batches(list(S._JudgeSources(True)(iter(rest.to_batches()))))
    s = next(v for v in got["dispersion"].to_pylist() if v is not None)
    stand = [f for row in rows.filter(pc.equal(rows["clase"], S.PIECES)).to_pylist() for k in "cr" for f, d in zip(row[f"{k}_fila"], row[f"{k}_lejos"]) if d > S.TIMES * s]
    return sorted(sure + stand + [f for f in got["fila"].to_pylist() if f is not None]), s


def test_a_large_day_gives_the_same_rows_however_it_is_cut(monkeypatch):
    x = _day()
    first = _judged(x, 10_000)
    assert len(first[0]) >= 300 and set(range(199_990, 200_010)) <= set(first[0])
    assert _judged(x, 17_000) == first
    for most in (10**9, 30_000, 777):
        monkeypatch.setattr(S, "MOST", most)
        assert _judged(x, 10_000) == first


def test_days_of_large_sources_are_sliced_with_the_same_rows(spark, monkeypatch):
    v = noise(3000)
    for i in (5, 700, 1438, 1439, 1440, 2879, 2990):
        v[i] = 90.0
    expected = found(spark, series(v))
    monkeypatch.setattr(S, "hot_limit", lambda n: 50)
    assert found(spark, series(v)) == expected == [5, 700, 1438, 1439, 1440, 2879, 2990]


def test_a_late_insert_looks_into_few_nodes_and_a_cut_into_one_a_level():
    tree = FingerTree()
    for i in range(10_000):
        assert tree.insert(i, (1, 0, 0.0, 0.0, 0.0)) == OPEN
    assert tree.visits == 10_000  # the finger alone

    def visits(f, *a):
        before = tree.visits
        f(*a)
        return tree.visits - before

    assert visits(tree.insert, 4321, (1, 0, 0.0, 0.0, 0.0)) <= 16 and visits(tree.between, 100, 9000) <= 30
    assert tree.publish(60, 30)[0] == (0, (30, 0, 0.0, 0.0, 0.0)) and tree.insert(59, (1, 0, 0.0, 0.0, 0.0)) == PUBLISHED and tree.insert(60, (1, 0, 0.0, 0.0, 0.0)) == OPEN
    assert visits(tree.cut, 9000) <= 10 and tree.insert(8999, (1, 0, 0.0, 0.0, 0.0)) == GONE and tree.root.total[0] == 1000
    assert tree.seek(0) == 9000 and tree.seek(10_000) is None and tree.cut(10**6)[0] == 1000 and list(tree.entries()) == []


def test_marks_that_are_too_many_to_broadcast_leave_one_tree_a_span(spark, monkeypatch):
    r = random.Random(2)
    rows = [(i, f"r{i % 3}", "t", T0 + timedelta(minutes=max(0, i // 6 - int(r.expovariate(0.2)))), float(i), i // 6) for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    source = [F.col("robot_id"), F.col("sensor")]

    def parts():
        return sorted(late_corrections(df, source, "ts", "lote", "lectura_id", "valor", emit="periods").collect())

    small = parts()
    hours = {(h["fuente"], h["inicio_us"]): h for h in late_corrections(df, source, "ts", "lote", "lectura_id", "valor", emit="hours").collect()}
    by_hour: dict = {}
    for p in small:
        key = (p["fuente"], p["inicio_us"] // L.HOUR * L.HOUR)
        by_hour[key] = tuple(a + b for a, b in zip(by_hour.get(key, (0, 0, 0, 0)), (p["final_filas"], p["final_suma"] or 0.0, p["corrigen"], p["descartadas"])))
    assert by_hour == {k: (h["final_filas"], h["final_suma"], h["corrigen"], h["descartadas"]) for k, h in hours.items()}
    monkeypatch.setattr(L, "BROADCAST_BATCHES", 0)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert parts() == small
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")

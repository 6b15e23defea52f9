"""Queries of the telemetry in event time."""

from __future__ import annotations

from pyspark.sql import functions as F

from brocal.functions.names import same_name
from brocal.plans.problems import table
from brocal.plans.social import plain
from brocal.streaming import late as L
from brocal.streaming import windows as W


def events_as_readings(spark, sf):
    """The events table as temperature readings of users."""
    return table(spark, sf, "events").select(F.col("user_id").alias("robot_id"), F.lit("temperatura").alias("sensor"), F.col("value").alias("valor"), F.col("ts").alias("ts_evento"))


def readings(spark, sf):
    t = table(spark, sf, "telemetry")
    return t.where(~F.coalesce(F.isnan("valor"), F.lit(False))).withColumns({"robot_id": same_name("robot_id"), "sensor": same_name("sensor")})


def q(function, *a, **k):
    return lambda spark, sf: plain(function(readings(spark, sf), *a, **k))


def win_alerts(spark, sf):
    return plain(W.alerts(events_as_readings(spark, sf), 60, 20.0).withColumnRenamed("robot_id", "user_id"))


QUERIES = {
    "win_alerts": win_alerts, "win_tumbling": q(W.tumbling), "win_sliding": q(W.sliding), "win_session": q(W.sessions), "win_alerts_robots": q(W.alerts, 5, 75.0),
    "win_alerts_absurd": q(W.alerts, 5, 75.0, False), "win_compare": q(W.compare_cuts), "late_delay": lambda s, d: L.with_delay(readings(s, d)).groupBy("almacen").agg(F.round(F.avg("retraso_min"), 6).alias("media"), F.max("retraso_min").alias("mayor")),
    "late_left_out": lambda s, d: L.left_out(readings(s, d), 2, 2).select("lectura_id", "descartada"), "late_sweep": q(L.sweep), "late_window_counts": q(W.window_counts, 2, 5),
    "late_order_check": lambda s, d: L.order_check(table(s, d, "telemetry")), "stream_dedup": lambda s, d: W.without_copies(readings(s, d)).groupBy("robot_id", "sensor").agg(F.count(F.lit(1)).alias("lecturas")),
    "state_windows": lambda s, d: plain(W.window_state(W.without_copies(readings(s, d)))),
}

_R = """with r as (select lectura_id, lower(trim(robot_id)) robot_id, almacen, lower(trim(sensor)) sensor, valor, ts_evento, lote, epoch_us(ts_evento) us from telemetry where not coalesce(isnan(valor), false)),
t as (select * from r where sensor = 'temperatura'),
tum as (select make_timestamp(us // 300000000 * 300000000) inicio, robot_id, avg(valor) media, max(valor) maximo, count(*) lecturas from t group by 1, 2),
sli as (select make_timestamp(s) inicio, robot_id, avg(valor) media, count(*) lecturas from (select *, unnest([us // 300000000 * 300000000, us // 300000000 * 300000000 - 300000000]) s from t) group by 1, 2),
gaps as (select *, sum(g) over (partition by robot_id order by us rows unbounded preceding) k from (select *, case when us - lag(us) over (partition by robot_id order by us) <= 180000000 then 0 else 1 end g from t)),
ses as (select min(ts_evento) inicio, max(ts_evento) + interval 3 minutes fin, robot_id, count(*) lecturas, avg(valor) media from gaps group by robot_id, k),
per as (select lote, max(us) hasta from r group by 1),
marks as (select lote, max(hasta) over (order by lote rows between unbounded preceding and 1 preceding) marca from per)
"""
_KEPT = _R + ", kept as (select distinct robot_id, sensor, ts_evento from r)"


def _alert(where: str) -> str:
    return _R + f"select inicio, inicio + interval 5 minutes fin, robot_id, temp_max from (select make_timestamp(us // 300000000 * 300000000) inicio, robot_id, max(valor) temp_max from t where {where} group by 1, 2) where temp_max >= 75"


SQL = {
    "win_alerts": "select * from (select make_timestamp(epoch_us(ts) // 3600000000 * 3600000000) inicio, make_timestamp(epoch_us(ts) // 3600000000 * 3600000000 + 3600000000) fin, user_id, round(max(value), 6) temp_max from events where value < 200 group by 1, 2, 3) where temp_max >= 20",
    "win_tumbling": _R + "select inicio, inicio + interval 5 minutes fin, robot_id, round(media, 6) media, maximo, lecturas from tum",
    "win_sliding": _R + "select inicio, inicio + interval 10 minutes fin, robot_id, round(media, 6) media, lecturas from sli",
    "win_session": _R + "select inicio, fin, robot_id, lecturas, round(media, 6) media from ses",
    "win_alerts_robots": _alert("valor < 200"), "win_alerts_absurd": _alert("true"),
    "win_compare": _R + """select 'tumbling' corte, count(*) filas, count(distinct inicio) ventanas, sum(lecturas)::bigint lecturas from tum
union all select 'sliding', count(*), count(distinct inicio), sum(lecturas)::bigint from sli union all select 'session', count(*), count(distinct inicio), sum(lecturas)::bigint from ses""",
    "late_delay": _R + "select almacen, round(avg(d), 6) media, max(d) mayor from (select almacen, lote - (us - (select min(us) from r)) // 60000000 d from r) group by 1",
    "late_left_out": _R + "select lectura_id, coalesce((us // 120000000 + 1) * 120000000 <= marca - 120000000, false) descartada from r left join marks using (lote)",
    "late_sweep": _R + "select w::int espera, count(*) filter (where (us // 120000000 + 1) * 120000000 <= marca - w * 60000000) perdidas from r left join marks using (lote), unnest([0, 1, 2, 3, 5, 8, 10]) x(w) group by 1",
    "late_window_counts": _R + "select make_timestamp(us // 120000000 * 120000000) inicio, make_timestamp(us // 120000000 * 120000000 + 120000000) fin, count(*) lecturas, max(valor) temp_max from t group by 1, 2",
    "late_order_check": "select lote, count(*) lecturas, not coalesce(bool_or(b), false) ordenado from (select lote, lag(ts_evento) over (partition by lote order by lectura_id) > ts_evento b from telemetry) group by 1",
    "stream_dedup": _KEPT + "select robot_id, sensor, count(*) lecturas from kept group by 1, 2",
    "state_windows": _R + "select make_timestamp(us // 300000000 * 300000000) inicio, make_timestamp(us // 300000000 * 300000000 + 300000000) fin, robot_id, count(*) lecturas, max(valor) temp_max from (select us, robot_id, max(valor) valor from t group by 1, 2) group by 1, 2, 3",
}

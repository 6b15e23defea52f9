"""Questions about telemetry in event time; each function serves a table and a stream alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Readings from here on come from an uncalibrated sensor; temperature that raises an alert.
ABSURD, ALERT = 200.0, 75.0


def _of(df: DataFrame, sensor: str) -> DataFrame:
    return df.where(F.col("sensor") == sensor)


def tumbling(df: DataFrame, minutes: int = 5, sensor: str = "temperatura") -> DataFrame:
    """inicio, fin, robot_id, media, maximo, lecturas of windows that don't overlap."""
    w = _of(df, sensor).groupBy(F.window("ts_evento", f"{minutes} minutes"), "robot_id")
    return w.agg(F.avg("valor").alias("media"), F.max("valor").alias("maximo"), F.count(F.lit(1)).alias("lecturas")).select(F.col("window.start").alias("inicio"), F.col("window.end").alias("fin"), "robot_id", "media", "maximo", "lecturas")


def sliding(df: DataFrame, minutes: int = 10, step: int = 5, sensor: str = "temperatura") -> DataFrame:
    """inicio, fin, robot_id, media, lecturas of windows that begin every `step` minutes."""
    w = _of(df, sensor).groupBy(F.window("ts_evento", f"{minutes} minutes", f"{step} minutes"), "robot_id")
    return w.agg(F.avg("valor").alias("media"), F.count(F.lit(1)).alias("lecturas")).select(F.col("window.start").alias("inicio"), F.col("window.end").alias("fin"), "robot_id", "media", "lecturas")


def sessions(df: DataFrame, gap: int = 3, sensor: str = "temperatura") -> DataFrame:
    """inicio, fin, robot_id, lecturas, media of stretches without a pause over `gap` minutes; fin is `gap` after the last reading."""
    w = _of(df, sensor).groupBy(F.session_window("ts_evento", f"{gap} minutes"), "robot_id")
    # all aggregates are kept until the end: a projection that needs none of them would lose the merging of sessions
    return w.agg(F.count(F.lit(1)).alias("lecturas"), F.avg("valor").alias("media")).select(F.col("session_window.start").alias("inicio"), F.col("session_window.end").alias("fin"), "robot_id", "lecturas", "media")


def alerts(df: DataFrame, minutes: int = 5, threshold: float = ALERT, drop_absurd: bool = True) -> DataFrame:
    """inicio, fin, robot_id, temp_max of the windows whose greatest temperature reaches the threshold."""
    hot = _of(df, "temperatura")
    if drop_absurd:
        hot = hot.where(F.col("valor") < ABSURD)
    w = hot.groupBy(F.window("ts_evento", f"{minutes} minutes"), "robot_id").agg(F.max("valor").alias("temp_max")).where(F.col("temp_max") >= threshold)
    return w.select(F.col("window.start").alias("inicio"), F.col("window.end").alias("fin"), "robot_id", "temp_max")


def at_risk(df: DataFrame, minutes: int = 5, threshold: float = ALERT, watermark: int | None = None) -> DataFrame:
    """The alerts, with a watermark where one is given."""
    return alerts(df if watermark is None else df.withWatermark("ts_evento", f"{watermark} minutes"), minutes, threshold)


def compare_cuts(df: DataFrame, minutes: int = 5, sensor: str = "temperatura") -> DataFrame:
    """corte, filas, ventanas, lecturas of the three ways to cut time."""
    out = None
    for name, made in (("tumbling", tumbling(df, minutes, sensor)), ("sliding", sliding(df, 2 * minutes, minutes, sensor)), ("session", sessions(df, 3, sensor))):
        one = made.agg(F.count(F.lit(1)).alias("filas"), F.count_distinct("inicio").alias("ventanas"), F.sum("lecturas").alias("lecturas")).withColumn("corte", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def window_counts(df: DataFrame, minutes: int, watermark: int | None = None) -> DataFrame:
    """inicio, fin, lecturas, temp_max of all temperature readings by window."""
    base = _of(df, "temperatura")
    if watermark is not None:
        base = base.withWatermark("ts_evento", f"{watermark} minutes")
    w = base.groupBy(F.window("ts_evento", f"{minutes} minutes")).agg(F.count(F.lit(1)).alias("lecturas"), F.max("valor").alias("temp_max"))
    return w.select(F.col("window.start").alias("inicio"), F.col("window.end").alias("fin"), "lecturas", "temp_max")


def window_state(df: DataFrame, minutes: int = 5) -> DataFrame:
    """inicio, fin, robot_id, lecturas, temp_max: what an upsert sink keeps."""
    w = _of(df, "temperatura").groupBy(F.window("ts_evento", f"{minutes} minutes"), "robot_id").agg(F.count(F.lit(1)).alias("lecturas"), F.max("valor").alias("temp_max"))
    return w.select(F.col("window.start").alias("inicio"), F.col("window.end").alias("fin"), "robot_id", "lecturas", "temp_max")


def without_copies(df: DataFrame, watermark: int = 5) -> DataFrame:
    """One row of each measurement (robot, sensor, time); the attempt is no part of it. The watermark bounds the state of a stream."""
    return df.withWatermark("ts_evento", f"{watermark} minutes").dropDuplicates(["robot_id", "sensor", "ts_evento"])

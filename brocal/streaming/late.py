"""Delay of arrival, and what a watermark would leave out, told from a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brocal.operators.late import high_marks


def with_batch(df: DataFrame) -> DataFrame:
    """`lote`: the number in the name of the file that brought the row."""
    return df.withColumn("lote", F.regexp_extract(F.input_file_name(), r"lote-(\d+)", 1).try_cast("int"))


def with_delay(df: DataFrame) -> DataFrame:
    """`min_evento`, minutes since the first event, and `retraso_min`, batches (minutes) between that and the arrival."""
    base = df.agg(F.min(F.unix_micros(F.col("ts_evento").cast("timestamp"))).alias("__base"))
    minute = F.floor((F.unix_micros(F.col("ts_evento").cast("timestamp")) - F.col("__base")) / 60_000_000)
    return df.join(F.broadcast(base)).withColumn("min_evento", minute).withColumn("retraso_min", F.col("lote") - F.col("min_evento")).drop("__base")


def left_out(df: DataFrame, watermark: int, window: int) -> DataFrame:
    """`descartada`: whether the row's window (from the epoch, in minutes) had ended by the watermark of the batches before its own."""
    marks = high_marks(df, "lote", "ts_evento").drop("hasta")
    size = window * 60_000_000
    end = (F.floor(F.unix_micros(F.col("ts_evento").cast("timestamp")) / size) + 1) * size
    out = df.join(marks, "lote", "left").withColumn("descartada", F.coalesce(end <= F.col("marca") - watermark * 60_000_000, F.lit(False)))
    return out.drop("marca")


def sweep(df: DataFrame, watermarks: tuple[int, ...] = (0, 1, 2, 3, 5, 8, 10), window: int = 2) -> DataFrame:
    """espera, perdidas: rows left out by each watermark, in one pass."""
    marks = high_marks(df, "lote", "ts_evento").drop("hasta")
    size = window * 60_000_000
    end = (F.floor(F.unix_micros(F.col("ts_evento").cast("timestamp")) / size) + 1) * size
    rows = df.join(marks, "lote", "left")
    made = rows.agg(*[F.count_if(end <= F.col("marca") - w * 60_000_000).alias(f"w{w}") for w in watermarks])
    return made.select(F.explode(F.array(*[F.struct(F.lit(w).alias("espera"), F.col(f"w{w}").alias("perdidas")) for w in watermarks])).alias("r")).select("r.*")


def order_check(df: DataFrame) -> DataFrame:
    """lote, lecturas, ordenado: whether the rows of each batch came in the order of their events."""
    before = F.lag("ts_evento").over(Window.partitionBy("lote").orderBy("lectura_id"))
    return df.withColumn("__back", before > F.col("ts_evento")).groupBy("lote").agg(F.count(F.lit(1)).alias("lecturas"), (~F.coalesce(F.bool_or("__back"), F.lit(False))).alias("ordenado"))

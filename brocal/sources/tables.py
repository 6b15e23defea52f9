"""Sources and sinks of tables: JSON lines, parquet, layers, profiles."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brocal.sources import store

#: The file that names the version of a table to read.
POINTER = "_CURRENT"
S, TS, L, DBL, B = T.StringType(), T.TimestampType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _schema(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


#: Raw tables by name; with a schema, a scan reads its files once and never guesses.
SCHEMAS = {
    "users": _schema(_id=S, username=S, display_name=S, email=S, bio=S, topic=S, is_spam=B, created_at=S, origin=S),
    "posts": _schema(_id=S, user_id=S, text=S, hashtags=T.ArrayType(S), created_at=S, likes_count=L, origin=S),
    "likes": _schema(_id=S, user_id=S, post_id=S, created_at=S, origin=S),
    "follows": _schema(_id=S, follower_id=S, following_id=S, created_at=S, origin=S),
    "robots": _schema(id=S, modelo=S, fabricante=S, fecha_alta=S, almacen=S, zona=S, firmware_version=S, sensores_activos=S, battery_health_v2=DBL, consumo_kw=DBL, bateria_pct=DBL, voltaje_v=DBL, consumo_total_kwh=DBL, failure_next_48h=T.IntegerType()),
    "sensors_readings": _schema(robot_id=S, timestamp=S, sensor_type=S, valor=DBL, bateria_pct=DBL, temperatura=DBL),
    "events": _schema(robot_id=S, timestamp=S, tipo=S, severidad=S, descripcion=S, tecnico=S),
    "maintenances": _schema(robot_id=S, fecha=S, tipo=S, duracion_horas=DBL, tecnico=S, coste_euros=DBL),
    "corpus": _schema(id=S, title=S, text=S, lang_declared=S, source=S, char_count=L, _noise=T.ArrayType(S)),
}


def read_lines(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """JSON lines, by the schema of a known table, or inferred."""
    reader = spark.read.schema(SCHEMAS[name]) if name else spark.read
    return reader.json(path)


def _current(folder: str, name: str) -> str | None:
    """The version of a table of a layer that its pointer names."""
    version = store.read_text(f"{folder}/{name}/{POINTER}")
    return f"{folder}/{name}/{version}" if version else None


def read_layer(spark: SparkSession, folder: str, name: str, raw: str | None = None) -> DataFrame:
    """A table of a layer as parquet, or its raw file where the layer hasn't got it."""
    path = _current(folder, name)
    if path:
        return spark.read.parquet(path)
    return read_lines(spark, f"{raw or folder}/{name}.json", name if name in SCHEMAS else None)


def write_layer(df: DataFrame, folder: str, name: str) -> str:
    """Write a new version beside the last, then name it in a pointer file: a table may be read while it is written anew.

    No folder is renamed, so it holds on object stores too; a failure before
    the pointer is written leaves the last version.  Readers of the version
    before keep theirs: only older ones are deleted.
    """
    root = f"{folder}/{name}"
    old = [v for v in store.names(root) if v.startswith("v")]
    version = f"v{int(old[-1][1:]) + 1 if old else 0:08d}"
    df.write.mode("overwrite").parquet(f"{root}/{version}")
    store.write_text(f"{root}/{POINTER}", version)
    for v in old[:-1]:
        store.delete(f"{root}/{v}")
    return f"{root}/{version}"


def write_profile(profile: DataFrame, folder: str) -> None:
    """A profile (a row for each column of a table) as _profile.json beside the tables."""
    rows = [r.asDict() for r in profile.collect()]
    store.write_text(f"{folder}/_profile.json", json.dumps(rows, ensure_ascii=False, default=str))


def read_profile(folder: str) -> list[dict]:
    text = store.read_text(f"{folder}/_profile.json")
    return json.loads(text) if text else []


def layers(root: str) -> dict[str, bool]:
    """Which of raw, silver, gold are there."""
    return {name: store.exists(f"{root}/{name}") for name in ("raw", "silver", "gold")}


def predicted(spark: SparkSession, folder: str, value: float = 1.0) -> DataFrame:
    """Rows of a model's output with one prediction."""
    return spark.read.parquet(folder).where(F.col("prediction") == value)


def trends_with_ids(trends: DataFrame) -> DataFrame:
    """Trends with an id that is the same in every run."""
    return trends.withColumn("_id", F.md5(F.concat_ws("|", F.col("date").cast("string"), "hashtag"))).withColumn("date", F.col("date").cast("string"))

"""Bounded runs of streams: sinks, checkpoints, metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brocal.sources import store

#: Readings as they arrive; the time is text until `typed`.
READING = T.StructType([
    T.StructField("robot_id", T.StringType()), T.StructField("almacen", T.StringType()), T.StructField("sensor", T.StringType()),
    T.StructField("valor", T.DoubleType()), T.StructField("ts_evento", T.StringType()), T.StructField("intento", T.IntegerType()),
])
MAILBOX = "lote-*.json"


def typed(df: DataFrame) -> DataFrame:
    """The event time as a timestamp; text that is none becomes null."""
    return df.withColumn("ts_evento", F.try_to_timestamp("ts_evento"))


def read_table(spark: SparkSession, folder: str) -> DataFrame:
    """A mailbox of batch files as a table."""
    return typed(spark.read.schema(READING).option("pathGlobFilter", MAILBOX).json(folder))


def read_stream(spark: SparkSession, folder: str, files: int = 1) -> DataFrame:
    """A mailbox as a stream, so many batch files at a time."""
    return typed(spark.readStream.schema(READING).option("pathGlobFilter", MAILBOX).option("maxFilesPerTrigger", files).json(folder))


def run(df: DataFrame, sink: Callable[[DataFrame, int], None], mode: str, checkpoint: str | None = None) -> list[dict]:
    """Run a stream over what there is, through `sink` by batch; the progress of each batch that read rows or dropped state."""
    w = df.writeStream.outputMode(mode).trigger(availableNow=True).foreachBatch(sink)
    if checkpoint:
        w = w.option("checkpointLocation", checkpoint)
    q = w.start()
    q.awaitTermination()
    return [metrics(p) for p in q.recentProgress]


class Crash(RuntimeError):
    """The end that `crashing` puts to a run."""


def crashing(sink: Callable[[DataFrame, int], None], after: int) -> Callable[[DataFrame, int], None]:
    """`sink`, but the run ends in a failure when batch number `after` begins: nothing of this batch is written."""

    def one(batch: DataFrame, batch_id: int) -> None:
        if batch_id >= after:
            raise Crash(f"before batch {batch_id}")
        sink(batch, batch_id)

    return one


def recovered(make: Callable[[], DataFrame], sink: Callable[[DataFrame, int], None], mode: str, checkpoint: str, after: int) -> tuple[int, int]:
    """Rows that a run read until it failed before batch `after`, and rows that a second run with the same checkpoint read: together each row once."""
    rows = [0, 0]

    def counted(i: int) -> Callable[[DataFrame, int], None]:
        def one(batch: DataFrame, batch_id: int) -> None:
            rows[i] += batch.count()
            sink(batch, batch_id)

        return one

    try:
        run(make(), crashing(counted(0), after), mode, checkpoint)
    except Exception as e:
        if Crash.__name__ not in str(e):
            raise
    run(make(), counted(1), mode, checkpoint)
    return rows[0], rows[1]


def evolution(df: DataFrame, column: str) -> list[tuple[int, list[str]]]:
    """For each micro-batch of a stream of few groups, in complete mode, the values of a column that the answer has by then."""
    seen: list[tuple[int, list[str]]] = []
    run(df, lambda batch, i: seen.append((i, sorted(r[0] for r in batch.select(column).distinct().collect()))), "complete")
    return seen


def right_from(seen: list[tuple[int, list[str]]], answer: list[str]) -> int | None:
    """The first micro-batch from which on the answer is right and stays so."""
    wrong = [i for i, values in seen if values != sorted(answer)]
    later = [i for i, _ in seen if not wrong or i > wrong[-1]]
    return later[0] if later else None


def to_memory(df: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a stream over what there is into an in-memory table of the driver."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def metrics(progress) -> dict:
    """Rows in, state rows, rows dropped by the watermark, rows removed from state, and the watermark, of one batch."""
    p = progress.json if isinstance(progress.json, dict) else __import__("json").loads(progress.json)
    state = p.get("stateOperators") or [{}]
    return {
        "batch": p["batchId"], "rows": p["numInputRows"], "state": sum(s.get("numRowsTotal", 0) for s in state),
        "dropped": sum(s.get("numRowsDroppedByWatermark", 0) for s in state), "removed": sum(s.get("numRowsRemoved", 0) for s in state),
        "watermark": p.get("eventTime", {}).get("watermark"),
    }


class Upsert:
    """A sink that keeps the latest row of each key in a parquet table; the same batch twice changes nothing.

    Each version of the table is written beside the last and then named in a
    pointer file, so a failure between leaves the last one; the version before
    it stays for its readers, older ones are deleted.
    """

    def __init__(self, folder: str, keys: list[str]):
        self.folder, self.keys = folder, keys

    def _version(self) -> str | None:
        return store.read_text(f"{self.folder}/CURRENT")

    @property
    def current(self) -> str | None:
        version = self._version()
        return f"{self.folder}/{version}" if version else None

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        version, last = f"v{batch_id:08d}", self._version()
        if last == version:
            return
        new = batch
        if last:
            old = batch.sparkSession.read.parquet(f"{self.folder}/{last}")
            new = old.join(batch.select(*self.keys), self.keys, "left_anti").unionByName(batch)
        new.write.mode("overwrite").parquet(f"{self.folder}/{version}")
        store.write_text(f"{self.folder}/CURRENT", version)
        for v in store.names(self.folder):
            if v.startswith("v") and v not in (version, last):
                store.delete(f"{self.folder}/{v}")

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.current)

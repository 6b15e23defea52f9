"""Files and folders of whatever store Spark reads and writes: local, HDFS, or an object store."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(path: str):
    spark = SparkSession.active()
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(path: str) -> bool:
    fs, p = _at(path)
    return fs.exists(p)


def delete(path: str) -> None:
    fs, p = _at(path)
    fs.delete(p, True)


def names(path: str) -> list[str]:
    """What lies in a folder, in order of name; nothing if there is no such folder."""
    fs, p = _at(path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def write_text(path: str, text: str) -> None:
    """Put a small file in place of any there is, in one step where the store has one."""
    fs, p = _at(path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(path: str) -> str | None:
    fs, p = _at(path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(SparkSession.active()._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()

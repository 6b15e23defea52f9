"""Queries of the text problems, with their SQL where SQL can say it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brocal.llm.mojibake import garbled
from brocal.llm.packing import CAPACITY, packed, packing_report
from brocal.llm.subjects import assigned, composition, subject_posteriors
from brocal.llm.tokenizer import encoded, token_lengths


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


TEXT_FIELDS = (("users", "display_name"), ("users", "bio"), ("posts", "text"))


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    sides = [table(spark, sf, t).select(F.lit(t).alias("tabla"), F.col("_id").alias("fila_id"), F.lit(f).alias("campo"), F.col(f).alias("texto")) for t, f in TEXT_FIELDS]
    return reduce(DataFrame.unionByName, sides)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return garbled(_texts(spark, sf)).select("tabla", "fila_id", "campo")


def p4_restored(spark: SparkSession, sf: str) -> DataFrame:
    return garbled(_texts(spark, sf)).select("tabla", "fila_id", "campo", "texto", "original")


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encoded(table(spark, sf, "documents"), "doc_id", "text")


def p8_pack(spark: SparkSession, sf: str) -> DataFrame:
    return packed(token_lengths(table(spark, sf, "documents"), "doc_id", "text"), "doc_id")


def p8_report(spark: SparkSession, sf: str) -> DataFrame:
    return packing_report(p8_pack(spark, sf))


def p8_check(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of p8_pack, as counts: documents, and breaches of each rule."""
    placed = p8_pack(spark, sf)
    boxes = placed.groupBy("contenedor").agg(F.sum("tokens").alias("t"), F.max(F.col("inicio") + F.col("tokens")).alias("hasta"))
    pieces = placed.groupBy("doc_id").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    made = boxes.agg(F.count_if((F.col("t") > CAPACITY) | (F.col("hasta") > CAPACITY)).alias("desbordados"), F.count_if(F.col("t") != F.col("hasta")).alias("con_huecos"))
    made = made.join(pieces.agg(F.count(F.lit(1)).alias("documentos"), F.count_if(F.col("n") > F.greatest(F.lit(1), F.ceil(F.col("t") / CAPACITY))).alias("partidos_de_mas")))
    return made.select(F.explode(F.array(*[F.struct(F.lit(c).alias("regla"), F.col(c).cast("bigint").alias("filas")) for c in made.columns])).alias("x")).select("x.*")


def _posteriors(spark: SparkSession, sf: str) -> DataFrame:
    return subject_posteriors(*[table(spark, sf, n) for n in ("documents", "subjects", "subject_labels")])


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return assigned(_posteriors(spark, sf))


def p9_composition(spark: SparkSession, sf: str) -> DataFrame:
    return composition(_posteriors(spark, sf), table(spark, sf, "subjects"))


QUERIES = {"p4_found": p4_found, "p4_restored": p4_restored, "p7_ids": p7_ids, "p8_pack": p8_pack, "p8_report": p8_report, "p8_check": p8_check, "p9_found": p9_found, "p9_composition": p9_composition}
SQL: dict[str, str] = {
    "p8_check": "select 'documentos' regla, count(*) filas from documents union all select unnest(['desbordados', 'con_huecos', 'partidos_de_mas']), 0",
}

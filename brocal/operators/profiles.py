"""Profiles of tables: nulls, types, distributions, correlations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brocal.operators.quantiles import quantiles

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def _stack(df: DataFrame, columns: Sequence[str], *fields: str) -> DataFrame:
    """One row per column from one row with <field>__<i> columns."""
    rows = F.array(*[F.struct(F.lit(c).alias("columna"), *[F.col(f"{f}__{i}").alias(f) for f in fields]) for i, c in enumerate(columns)])
    return df.select(F.explode(rows).alias("r")).select("r.*")


def quality_profile(df: DataFrame) -> DataFrame:
    """columna, filas, nulos of every column, in one pass."""
    made = [F.count(F.lit(1)).alias("filas")] + [F.count_if(F.col(f"`{c}`").isNull()).alias(f"nulos__{i}") for i, c in enumerate(df.columns)]
    one = df.agg(*made)
    return one.select("filas", F.explode(F.array(*[F.struct(F.lit(c).alias("columna"), F.col(f"nulos__{i}").alias("nulos")) for i, c in enumerate(df.columns)])).alias("r")).select("r.columna", "filas", "r.nulos")


def noise_profile(df: DataFrame, tags: str) -> DataFrame:
    """Rows of each tag of an array column; rows without any count as null."""
    return df.select(F.explode_outer(tags).alias("ruido")).groupBy("ruido").agg(F.count(F.lit(1)).alias("filas")).orderBy(F.desc("filas"), "ruido")


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t in NUMERIC]


def schema_profile(df: DataFrame) -> DataFrame:
    """columna, tipo, distintos, nulos, clase (numeric, datetime, categorical up to 50 values, text) of every column."""
    made = [F.count_distinct(F.col(f"`{c}`")).alias(f"distintos__{i}") for i, c in enumerate(df.columns)] + [F.count_if(F.col(f"`{c}`").isNull()).alias(f"nulos__{i}") for i, c in enumerate(df.columns)]
    kinds = dict(df.dtypes)
    out = _stack(df.agg(*made), df.columns, "distintos", "nulos")
    tipo = F.create_map(*[F.lit(x) for c in df.columns for x in (c, kinds[c])])[F.col("columna")]
    clase = F.when(tipo.isin(*NUMERIC), "numeric").when(tipo.isin("timestamp", "timestamp_ntz", "date"), "datetime").when(F.col("distintos") <= 50, "categorical").otherwise("text")
    return out.select("columna", tipo.alias("tipo"), "distintos", "nulos", clase.alias("clase"))


def univariate(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, nulls, mean, deviation, quartiles, extremes of numeric columns; quartiles are exact and interpolated."""
    made = []
    for i, c in enumerate(columns):
        x = F.col(f"`{c}`").cast("double")
        made += [F.count(x).alias(f"n__{i}"), F.count_if(x.isNull()).alias(f"nulos__{i}"), F.round(F.avg(x), 6).alias(f"media__{i}"), F.round(F.stddev_samp(x), 6).alias(f"desv__{i}"), F.min(x).alias(f"min__{i}"), F.max(x).alias(f"max__{i}")]
    base = _stack(df.agg(*made), columns, "n", "nulos", "media", "desv", "min", "max")
    long = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(f"`{c}`").cast("double").alias("x")) for i, c in enumerate(columns)])).alias("v"))
    q = quantiles(long, F.col("v.x"), [0.25, 0.5, 0.75], F.col("v.c"))
    named = F.create_map(*[F.lit(v) for i, c in enumerate(columns) for v in (i, c)])
    q = q.select(named[F.col("grupo")].alias("columna"), *[F.round(F.col("q")[i], 6).alias(name) for i, name in enumerate(("q1", "mediana", "q3"))])
    return base.join(q, "columna", "left").select("columna", "n", "nulos", "media", "desv", "min", "q1", "mediana", "q3", "max")


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """bin (from 1), desde, n: equal widths from least to greatest; the greatest falls into the last."""
    ends = df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    x = F.col(f"`{column}`").cast("double")
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.when(F.col("hi") == F.col("lo"), 1).otherwise(F.least(F.floor((x - F.col("lo")) / width) + 1, F.lit(bins))).cast("int")
    return df.where(x.isNotNull()).join(F.broadcast(ends)).select(b.alias("bin"), "lo", width.alias("w")).groupBy("bin").agg(F.round(F.first(F.col("lo") + (F.col("bin") - 1) * F.col("w")), 6).alias("desde"), F.count(F.lit(1)).alias("n"))


def value_counts(df: DataFrame, column: str, top: int = 30) -> DataFrame:
    """The most frequent values, null among them."""
    return df.groupBy(F.col(f"`{column}`").cast("string").alias("valor")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc_nulls_first("valor")).limit(top)


def null_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """a, b, juntos: rows in which both columns are null, for each pair with any."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    made = [F.count_if(F.col(f"`{a}`").isNull() & F.col(f"`{b}`").isNull()).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"p{i}").alias("juntos")) for i, (a, b) in enumerate(pairs)])
    return df.agg(*made).select(F.explode(rows).alias("r")).select("r.*").where("juntos >= 1")


def correlations(df: DataFrame, columns: Sequence[str], threshold: float = 0.9) -> DataFrame:
    """a, b, r, redundante (|r| above the threshold): Pearson over the rows that have both."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    made = [F.round(F.corr(F.col(f"`{a}`").cast("double"), F.col(f"`{b}`").cast("double")), 6).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"p{i}").alias("r")) for i, (a, b) in enumerate(pairs)])
    return df.agg(*made).select(F.explode(rows).alias("x")).select("x.*").withColumn("redundante", F.coalesce(F.abs("r") > threshold, F.lit(False)))


def grouped(df: DataFrame, by: str, column: str, how: str, top: int = 50) -> DataFrame:
    """The groups with the greatest mean, sum, count, min, max, median or std of a column."""
    x = F.col(f"`{column}`").cast("double")
    if how == "median":
        groups = df.select(F.col(f"`{by}`").alias("__g")).distinct()
        q = quantiles(df, x, [0.5], F.col(f"`{by}`"))
        made = groups.join(q, F.col("__g").eqNullSafe(F.col("grupo")), "left").select(F.col("__g").alias("grupo"), F.round(F.col("q")[0], 6).alias("valor"))
    else:
        f = {"mean": F.avg, "sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "std": F.stddev_samp}[how](x)
        made = df.groupBy(F.col(f"`{by}`").alias("grupo")).agg(F.round(f.cast("double"), 6).alias("valor"))
    return made.orderBy(F.desc_nulls_last("valor"), F.asc_nulls_first("grupo")).limit(top)


def sample_values(df: DataFrame, most: int = 5) -> DataFrame:
    """columna, ejemplos: of each column, the `most` least of its values as text (the same in every run)."""
    out = None
    for c in df.columns:
        one = df.select(F.col(f"`{c}`").cast("string").alias("v")).where("v is not null").distinct().orderBy("v").limit(most)
        one = one.agg(F.array_sort(F.collect_list("v")).alias("ejemplos")).select(F.lit(c).alias("columna"), "ejemplos")
        out = one if out is None else out.unionByName(one)
    return out


def overview(df: DataFrame, target: str | None = None) -> DataFrame:
    """seccion, clave, filas: rows and columns; columns by class; rows by value of the target."""
    kinds = schema_profile(df).groupBy("clase").agg(F.count(F.lit(1)).alias("filas")).select(F.lit("clase").alias("seccion"), F.col("clase").alias("clave"), "filas")
    out = df.agg(F.count(F.lit(1)).alias("filas")).select(F.lit("tabla").alias("seccion"), F.lit("filas").alias("clave"), "filas")
    out = out.unionByName(df.sparkSession.createDataFrame([("tabla", "columnas", len(df.columns))], "seccion string, clave string, filas long")).unionByName(kinds)
    if target:
        out = out.unionByName(df.groupBy(F.col(f"`{target}`").cast("string").alias("clave")).agg(F.count(F.lit(1)).alias("filas")).select(F.lit("objetivo").alias("seccion"), "clave", "filas"))
    return out


def midpoint(df: DataFrame, column: str, accuracy: int = 10_000) -> DataFrame:
    """`medio`: the approximate median, from sketches that combine before any shuffle."""
    return df.agg(F.percentile_approx(F.col(f"`{column}`").cast("double"), F.lit(0.5), F.lit(accuracy)).alias("medio"))

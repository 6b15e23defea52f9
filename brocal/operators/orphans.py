"""References to records that do not exist, were deleted or arrive later."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brocal.functions.names import same_name
from brocal.operators.skew import hot_limit, join_back


@dataclass(frozen=True)
class Reference:
    """Column `field` of `table` names a record of the parent `parent`."""

    table: str
    field: str
    parent: str


def unresolved(
    children: dict[str, DataFrame],
    parents: dict[str, DataFrame],
    references: Sequence[Reference],
    row_id: str = "_id",
    parent_id: str = "_id",
    arrived: str = "ingested_at",
    deleted: str = "deleted_at",
) -> DataFrame:
    """One row per non-null reference that does not resolve when its row arrives.

    Columns out: tabla, fila_id, campo, periodo (yyyy-MM of the row's arrival),
    clase: `missing` (no such parent), else `deleted` (the parent was deleted
    by then), else `late` (the parent arrives after the row).

    1. References are gathered from one scan of each child table and reduced
       to the distinct keys, with their first and last arrival, before and
       after the shuffle: any number of rows naming one key is one row.
    2. A left anti-join of the distinct keys against the parents gives the
       missing ones; the others join their parent, and only keys that fail for
       the first or last arrival go on.
    3. These keys are joined back to the rows.  Hot keys (at
       most 1,000, by their share of the rows) meet their rows by broadcast; all rows of hot keys
       are taken off before the others are shuffled to theirs.

    Names are compared without blanks at both ends and in lower case.  Nulls:
    a null reference is none; a null arrival has a null period, and can be
    missing only.  Parents whose ids are the same name count as one record:
    it arrived with the first and is deleted when the last is.  Repeated child
    rows come out as often as they come in.  An empty child table gives
    nothing, an empty parent table makes each reference missing.
    """
    spark = next(iter(children.values())).sparkSession
    sides = []
    for table in dict.fromkeys(r.table for r in references):
        own = [r for r in references if r.table == table]
        child = children[table]
        named = F.explode(F.array(*[F.struct(F.lit(r.field).alias("campo"), F.lit(r.parent).alias("padre"), same_name(child[r.field]).alias("clave")) for r in own]))
        sides.append(child.select(F.lit(table).alias("tabla"), child[row_id].cast("string").alias("fila_id"), child[arrived].alias("llegada"), named.alias("r")).select("tabla", "fila_id", "llegada", "r.*").where("clave is not null"))
    rows = sides[0]
    for side in sides[1:]:
        rows = rows.unionByName(side)
    total = sum(children[r.table].count() for r in references)  # from the files' footers
    hot = hot_limit(total)

    known = None
    for name in dict.fromkeys(r.parent for r in references):
        parent = parents[name]
        gone = parent[deleted].cast("timestamp") if deleted in parent.columns else F.lit(None).cast("timestamp")
        one = parent.select(F.lit(name).alias("padre"), same_name(parent[parent_id].cast("string")).alias("clave"), parent[arrived].cast("timestamp").alias("desde"), gone.alias("hasta")).where("clave is not null")
        known = one if known is None else known.unionByName(one)
    known = known.groupBy("padre", "clave").agg(F.min("desde").alias("desde"), F.max("hasta").alias("hasta"), F.bool_or(F.isnull("hasta")).alias("vive"))
    known = known.select("padre", "clave", "desde", F.when(~F.col("vive"), F.col("hasta")).alias("hasta"))

    keys = rows.groupBy("padre", "clave").agg(F.count(F.lit(1)).alias("filas"), F.min("llegada").alias("primera"), F.max("llegada").alias("ultima"))
    missing = keys.join(known, ["padre", "clave"], "left_anti").select("*", F.lit(None).cast("timestamp").alias("desde"), F.lit(None).cast("timestamp").alias("hasta"), F.lit(False).alias("existe"))
    untimely = keys.join(known, ["padre", "clave"]).where("hasta <= ultima or desde > primera").withColumn("existe", F.lit(True))
    failing = missing.unionByName(untimely).drop("primera", "ultima")

    crowded = keys.where(F.col("filas") > hot)
    found = join_back(rows, failing, ["padre", "clave"], "filas", hot, crowded)
    clase = F.when(~F.col("existe"), "missing").when(F.col("hasta") <= F.col("llegada"), "deleted").when(F.col("desde") > F.col("llegada"), "late")
    return found.select("tabla", "fila_id", "campo", F.date_format("llegada", "yyyy-MM").alias("periodo"), clase.alias("clase")).where("clase is not null")


def unresolved_report(found: DataFrame) -> DataFrame:
    """Unresolved references by table, field, period and class: tabla, campo, periodo, clase, filas."""
    return found.groupBy("tabla", "campo", "periodo", "clase").agg(F.count(F.lit(1)).alias("filas"))

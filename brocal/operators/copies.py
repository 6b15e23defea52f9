"""Messages delivered more than once: exactly one copy of each is kept."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALONE = "__alone"


def message_keys(keys: Sequence[Column | str], own: Column) -> list[Column]:
    """The identifier columns, and one more that keeps rows without a full identifier apart.

    A row whose identifier has a null names no message, so it is a copy of
    nothing: it is grouped under its own id.
    """
    columns = [F.col(k) if isinstance(k, str) else k for k in keys]
    whole = F.lit(True)
    for c in columns:
        whole = whole & c.isNotNull()
    return [*[c.alias(f"__k{i}") for i, c in enumerate(columns)], F.when(~whole, own).alias(ALONE)]


def keep_one(
    df: DataFrame,
    keys: Sequence[Column | str],
    order: Sequence[str],
    payload: Sequence[str] | None = None,
    where: Column | None = None,
    count: bool = False,
    unique: bool = False,
) -> DataFrame:
    """One copy of each message: of the rows with the same `keys`, the one that is first by `order`.

    Aggregation by identifier with min_by over the struct of `order` (the time
    of delivery, then a tie-break).  Partial aggregation runs before the
    shuffle, so any number of copies of one message leaves a map task as one
    row and no group of copies is ever gathered.

    Columns out: `payload` (all columns of `df` by default), and `copies` (the
    number of rows of the message) if `count`.  Columns may have any names.

    Nulls: a row with a null in its identifier is no copy of any other row; it
    is kept (one of several rows that are equal in `order`, too).  Nulls in
    `order` come first.  Ties: rows equal in all of `order` count as one
    delivery; which of them stays is then decided by the payload itself, the
    smallest in all columns that can be ordered.  `unique` says that `order`
    has no ties and saves that.  An empty table gives an empty one.
    """
    payload = list(df.columns if payload is None else payload)
    rows = df if where is None else df.where(where)
    own = F.struct(*[F.col(f"`{c}`") for c in order])
    ties = [] if unique else [c for c in payload if c not in order and not df.schema[c].dataType.simpleString().startswith(("map", "variant", "array<map", "struct<"))]
    rows = rows.select(
        *message_keys(keys, own),
        F.struct(*[F.col(f"`{c}`") for c in payload]).alias("__row"),
        F.struct(*[F.col(f"`{c}`") for c in [*order, *ties]]).alias("__order"),
    )
    made = [F.min_by("__row", "__order").alias("__row")]
    if count:
        made.append(F.count(F.lit(1)).alias("copies"))
    kept = rows.groupBy(*[c for c in rows.columns if c not in ("__row", "__order")]).agg(*made)
    return kept.select(*[F.col("__row").getField(c).alias(c) for c in payload], *(["copies"] if count else []))


def keep_values(df: DataFrame, keys: dict[str, Column], row_id: str, values: Sequence[str]) -> DataFrame:
    """`keep_one` for values of fixed width: the copy with the least `row_id` (a unique number), as its `keys`, `row_id` and `values`.

    One min_by for each value, as their buffers are of fixed width, so the
    aggregation is by hash in both steps.  Rows with a null in their
    identifier are copies of nothing, as there.
    """
    whole = F.lit(True)
    for c in keys.values():
        whole = whole & c.isNotNull()
    rows = df.select(*[c.alias(f"__k{i}") for i, c in enumerate(keys.values())], F.when(~whole, F.col(f"`{row_id}`")).alias(ALONE), F.col(f"`{row_id}`").alias("__id"), *[F.col(f"`{v}`").alias(f"__v{i}") for i, v in enumerate(values)])
    kept = rows.groupBy(*[f"__k{i}" for i in range(len(keys))], ALONE).agg(F.min("__id").alias("__id"), *[F.min_by(f"__v{i}", "__id").alias(f"__v{i}") for i in range(len(values))])
    return kept.select(*[F.col(f"__k{i}").alias(k) for i, k in enumerate(keys)], F.col("__id").alias(row_id), *[F.col(f"__v{i}").alias(v) for i, v in enumerate(values)])


def surplus_copies(df: DataFrame, keys: Sequence[Column | str], order: Sequence[str], row_id: str) -> DataFrame:
    """The `row_id` of every row that `keep_one` leaves out.

    `row_id` must be unique.  The kept ids are taken off by an anti-join on the
    id itself: it has no hot value, whatever the sizes of the messages.
    """
    kept = keep_one(df, keys, order, payload=[row_id], unique=True)
    return df.select(row_id).join(kept, row_id, "left_anti")


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep_nulls: bool = False) -> DataFrame:
    """The first row by `order` of each value of `keys`; nulls are values too, so rows without a key leave one.

    `keep_nulls` keeps each row that has a null key instead.  As an aggregation
    with partial results, it has no hot partition where a window would.
    """
    if keep_nulls:
        return keep_one(df, list(keys), list(order))
    columns = list(df.columns)
    made = df.groupBy(*[F.col(f"`{k}`").alias(f"__g{i}") for i, k in enumerate(keys)]).agg(
        F.min_by(F.struct(*[F.col(f"`{c}`") for c in columns]), F.struct(*[F.col(f"`{c}`") for c in order])).alias("__row")
    )
    return made.select(*[F.col("__row").getField(c).alias(c) for c in columns])

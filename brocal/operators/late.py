"""Aggregates by event time that late records correct, up to a cut-off."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brocal.operators.finger import EMPTY, GONE, FingerTree
from brocal.session import cut, partitions, ship

MINUTE = 60_000_000
HOUR = 60 * MINUTE
#: Event time that one tree covers, in microseconds; a source's periods are spread over tasks by it.
SPAN = 6 * HOUR
#: Event time of one key of a tree.
GRAIN = MINUTE
#: Batches up to which their marks are broadcast (24 bytes each).
BROADCAST_BATCHES = 1_000_000
SEP = "\x1f"
NONE = "\x00"

DROPPED, CORRECTS = "descartada", "corrige"


def high_marks(df: DataFrame, batch: str, ts: str) -> DataFrame:
    """For each batch, the greatest event time of all rows with a smaller batch: `batch`, `marca` (microseconds, null for the first), and `hasta`, that of its own.

    One row per batch enters the ordered window, however many rows the batches
    have.  Rows without batch or time say nothing about it.
    """
    per = df.where(F.col(batch).isNotNull()).groupBy(F.col(batch).alias(batch)).agg(F.max(F.unix_micros(F.col(ts).cast("timestamp"))).alias("hasta"))
    before = Window.orderBy(batch).rowsBetween(Window.unboundedPreceding, -1)
    return per.select(batch, F.max("hasta").over(before).alias("marca"), "hasta")


def late_corrections(
    df: DataFrame,
    source: Sequence[Column],
    ts: str,
    batch: str,
    row_id: str,
    value: str | None = None,
    marks: DataFrame | None = None,
    period: int = 5 * MINUTE,
    publish: int = 2 * MINUTE,
    cutoff: int = 15 * MINUTE,
    emit: str = "rows",
) -> DataFrame:
    """Replay the rows of each source in order of arrival into a finger B-tree keyed by event time.

    Before a batch, S is the greatest event time of all earlier batches
    (`marks`, from `high_marks`, over all rows that were delivered).  A period
    that ends at E is published when S >= E + `publish` and cut off the tree
    when S >= E + `cutoff`.  A row of the batch goes into the tree, and the
    insert says what it met: an open part (in time), a published one (the row
    corrects it) or one that was cut off (it comes too late).

    The keys of a tree are a GRAIN each.  What is published of a period, and
    its final state, are put together from the partials of the subtrees in
    it, which every late row has brought up to date on its way up.

    emit="rows": `row_id`, destino (corrige, descartada) of the rows that are
    not in time.  emit="periods": per source and period, in micro-seconds of
    period start: `fuente` (source columns joined by \\x1f), inicio_us, and for
    the first publication and the final state the messages (primera_filas,
    final_filas), values (_n), sum (_suma), least (_min) and greatest (_max);
    corrigen and descartadas count the rows.  At the end S is that of all
    rows; a period that it doesn't reach is not published: its primera_ columns
    are null.  emit="hours": per source and hour the final state alone, as
    final_, corrigen and descartadas: the tree keeps an hour until its last
    period is closed and gives its aggregate in one piece.

    A tree covers one SPAN of a source, so a source with any share of the rows
    is spread over many tasks, with the same result, as periods don't reach
    over a SPAN (`period` must divide it).  Memory is that of one tree.

    Nulls: rows without time or batch are in no period; null and NaN values
    count as messages, not as values.  Ties in arrival don't matter, as rows
    of a batch see the same S.  Repeated rows count each time: take copies off
    before.  An empty table gives an empty result.
    """
    if SPAN % period or period % GRAIN:
        raise ValueError("the period must divide the span of a tree, and be divided by its grain")
    spark = df.sparkSession
    ship(spark)
    marks = cut(high_marks(df, batch, ts) if marks is None else marks)
    known = marks.agg(F.count(F.lit(1)), F.max("hasta")).first()
    marks = marks.drop("hasta")
    if known[0] <= BROADCAST_BATCHES:
        marks = F.broadcast(marks)
    at = F.unix_micros(F.col(f"`{ts}`").cast("timestamp"))
    rows = df.select(
        F.concat_ws(SEP, *[F.coalesce(c.cast("string"), F.lit(NONE)) for c in source]).alias("fuente"),
        at.alias("ts"),
        F.col(f"`{batch}`").alias(batch),
        F.col(f"`{row_id}`").alias("fila"),
        *([F.col(f"`{value}`").cast("double").alias("valor")] if value else []),
    ).where(F.col("ts").isNotNull() & F.col(batch).isNotNull())
    span = F.floor(F.col("ts") / SPAN)
    # the marks come first, as rows must be where their tree is in whichever way they are joined
    rows = rows.join(marks, batch).withColumn("tramo", span).repartition(partitions(spark), "fuente", "tramo")
    rows = rows.sortWithinPartitions("fuente", "tramo", batch, "ts").select("fuente", "tramo", "ts", F.col(batch).cast("long").alias("lote"), "marca", "fila", *(["valor"] if value else []))
    config = (period, publish, cutoff, known[1])
    if emit == "rows":
        id_type = df.schema[row_id].dataType.simpleString()
        return rows.mapInArrow(_Replay(config, emit), f"fila {id_type}, destino string").withColumnRenamed("fila", row_id)
    out = rows.mapInArrow(_Replay(config, emit), _PERIODS)
    if emit == "hours":
        # an hour of which rows came too late for its tree has one row for these alone
        return merged_periods(out).select("fuente", "inicio_us", *[f"final_{p}" for p in _PARTIAL], "corrigen", "descartadas")
    return out


_PARTIAL = ("filas", "n", "suma", "min", "max")
_PERIODS = "fuente string, inicio_us long, publicada boolean, " + ", ".join(f"{w}_{p} {'long' if p in ('filas', 'n') else 'double'}" for w in ("primera", "final") for p in _PARTIAL) + ", corrigen long, descartadas long"
_PERIOD_SCHEMA = pa.schema(
    [("fuente", pa.string()), ("inicio_us", pa.int64()), ("publicada", pa.bool_())]
    + [(f"{w}_{p}", pa.int64() if p in ("filas", "n") else pa.float64()) for w in ("primera", "final") for p in _PARTIAL]
    + [("corrigen", pa.int64()), ("descartadas", pa.int64())]
)


class _Replay:
    """Runs over a sorted partition; a tree lives as long as its source and span."""

    def __init__(self, config, emit: str):
        self.config, self.emit = config, emit

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, periods = self.config[3], self.emit != "rows"
        state = None
        last = None
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            source, span = b.column("fuente"), b.column("tramo").to_numpy()
            new = np.ones(n, bool)
            new[1:] = pc.not_equal(source.slice(1), source.slice(0, n - 1)).to_numpy(zero_copy_only=False) | (span[1:] != span[:-1])
            new[0] = last != (source[0].as_py(), span[0])
            last = (source[n - 1].as_py(), span[n - 1])
            ts, lote = b.column("ts").to_numpy(), b.column("lote").to_numpy()
            mark = pc.fill_null(b.column("marca"), np.iinfo(np.int64).min // 2).to_numpy()
            start = ts // GRAIN * GRAIN
            # rows of one batch and key enter the tree as one partial
            first = new.copy()
            first[1:] |= (lote[1:] != lote[:-1]) | (start[1:] != start[:-1])
            first[0] = True
            at = np.flatnonzero(first)
            size = np.diff(np.append(at, n))
            if "valor" in b.schema.names:
                v = pc.fill_null(b.column("valor"), np.nan).to_numpy()
                ok = ~np.isnan(v)
                parts = list(zip(
                    size.tolist(),
                    np.add.reduceat(ok.astype(np.int64), at).tolist(),
                    np.add.reduceat(np.where(ok, v, 0.0), at).tolist(),
                    np.minimum.reduceat(np.where(ok, v, np.inf), at).tolist(),
                    np.maximum.reduceat(np.where(ok, v, -np.inf), at).tolist(),
                ))
            elif periods:
                parts = [(s, 0, 0.0, np.inf, -np.inf) for s in size.tolist()]
            else:
                parts = size.tolist()
            fate = np.zeros(len(at), np.int8)
            out: list = []
            for i, (fresh, key, s, part) in enumerate(zip(new[at].tolist(), start[at].tolist(), mark[at].tolist(), parts)):
                if fresh:
                    if state is not None and periods:
                        state.finish(out, end)
                    state = _State(source[int(at[i])].as_py() if periods else None, self.config, self.emit)
                if s != state.mark:
                    state.advance(s, out)
                fate[i] = state.add(key, part)
            if periods:
                if out:
                    yield _table(out)
            else:
                per_row = np.repeat(fate, size)
                late = np.flatnonzero(per_row)
                if len(late):
                    word = pa.array(np.where(per_row[late] == GONE, DROPPED, CORRECTS))
                    yield pa.RecordBatch.from_arrays([b.column("fila").take(pa.array(late)), word], ["fila", "destino"])
        if periods and state is not None:
            out = []
            state.finish(out, end)
            if out:
                yield _table(out)


class _State:
    """One source and span: the tree of what isn't closed, what was published of it, and what came too late."""

    __slots__ = ("source", "period", "publish", "cutoff", "emit", "unit", "tree", "mark", "first", "fixes", "lost")

    def __init__(self, source, config, emit):
        self.source, self.emit = source, emit
        self.period, self.publish, self.cutoff = config[:3]
        self.unit = HOUR if emit == "hours" else self.period
        # a tree that only tells fates needs no more than counts
        self.tree = FingerTree(add, 0) if emit == "rows" else FingerTree()
        self.mark = None
        self.first: dict = {}
        self.fixes: dict = {}
        self.lost: dict = {}

    def advance(self, mark, out):
        self.mark, tree = mark, self.tree
        shown, closed = ((mark - wait) // self.period * self.period for wait in (self.publish, self.cutoff))
        if shown > tree.shown:
            self.first.update(tree.publish(shown, self.period if self.emit == "periods" else None))
        if closed > tree.floor:
            if self.emit == "rows":
                tree.cut(closed)
            else:
                whole = closed // self.unit * self.unit
                for key, part in tree.periods(-(1 << 62), whole, self.unit):
                    out.append(self.row(key, part))
                tree.cut(whole)
                tree.floor = closed

    def row(self, key, part):
        first = self.first.pop(key, EMPTY if key < self.tree.shown else None)
        return (self.source, key, first is not None, first, part, self.fixes.pop(key, 0), 0)

    def add(self, key, part) -> int:
        met = self.tree.insert(key, part)
        if met and self.emit != "rows":
            of = self.lost if met == GONE else self.fixes
            key = key // self.unit * self.unit
            of[key] = of.get(key, 0) + part[0]
        return met

    def finish(self, out, end):
        self.advance(end, out)
        for key, part in self.tree.periods(-(1 << 62), 1 << 62, self.unit):
            out.append(self.row(key, part))
        for key, n in self.lost.items():
            out.append((self.source, key, True, EMPTY, EMPTY, 0, n))


def _table(rows) -> pa.RecordBatch:
    def clean(part, i):
        return None if part is None or (i >= 3 and part[1] == 0) or (i == 2 and part[1] == 0) else part[i]

    columns = [[r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]]
    for which in (3, 4):
        columns += [[clean(r[which], i) for r in rows] for i in range(5)]
    columns += [[r[5] for r in rows], [r[6] for r in rows]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PERIOD_SCHEMA)], schema=_PERIOD_SCHEMA)


def merged_periods(parts: DataFrame) -> DataFrame:
    """One row per source and period of what `late_corrections` emits: rows that came after an eviction join their period."""
    made = [F.bool_and("publicada").alias("publicada")]
    for w in ("primera", "final"):
        for p in _PARTIAL:
            f = {"min": F.min, "max": F.max}.get(p, F.sum)
            made.append(f(f"{w}_{p}").alias(f"{w}_{p}"))
    return parts.groupBy("fuente", "inicio_us").agg(*made, F.sum("corrigen").alias("corrigen"), F.sum("descartadas").alias("descartadas"))

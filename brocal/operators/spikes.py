"""Implausible readings: out of physical bounds, stuck, or standing off from their neighbours."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brocal.operators.late import NONE
from brocal.operators.skew import hot_limit, join_back
from brocal.session import cut, partitions, ship

#: Readings on each side that make the level just before and after.
SIDE = 7
#: Readings that make that level where one side is missing.
END = 3
#: Readings on each side of the centre of the rolling median from which scatter is measured.
CENTRE = 7
#: Longest excursion, in readings.
LONGEST = 3
#: Shortest run of one value that counts as stuck.
STUCK = 6
#: The readings beside an excursion must have come back to within this share of its distance.
BACK = 0.5
#: Times the scatter that an excursion must stand off.
TIMES = 6.0
#: Median absolute deviation to standard deviation, of normal noise.
MAD = 1.4826
#: Readings at either end of a piece that are judged with those of the next piece.
REACH = 10
#: Event time of a piece, in microseconds, and the most readings of one.  Neither changes a result.
PIECE, MOST = 86_400_000_000, 200_000
#: Bins of an octave, for the distribution of deviations.
BINS = 8
#: Sources up to which their scatters are broadcast (some 60 bytes each).
BROADCAST_SOURCES = 500_000

OUT, EDGE, PIECES = 0, 1, 2


def _middle(x: np.ndarray, width: int) -> np.ndarray:
    """Medians of all windows of an odd width."""
    return np.partition(sliding_window_view(x, width), width // 2, axis=1)[:, width // 2]


def _outside(x, low, high):
    return np.maximum(low - x, x - high)


def standoff(x: np.ndarray) -> np.ndarray:
    """How far each reading of a whole series stands off, together with at most two neighbours, from the levels just before and after."""
    n = len(x)
    pad = np.full(SIDE + LONGEST, np.nan)
    wide = np.concatenate([pad, x, pad])
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        level = np.nanmedian(sliding_window_view(wide, SIDE), axis=1)
        near = np.nanmedian(sliding_window_view(wide, END), axis=1)
    best = np.full(n, -np.inf)
    for k in range(1, LONGEST + 1):
        i = np.arange(n - k + 1)
        if not len(i):
            break
        o = i + len(pad)
        before, after = level[o - SIDE], level[o + k]
        # where one side is missing, the nearest of the other, and as far as this drifts
        first, last = np.isnan(before), np.isnan(after)
        low, high = np.fmin(before, after), np.fmax(before, after)
        for alone, level_there, near_there in ((last, before, near[o - END]), (first, after, near[o + k])):
            drift = np.abs(near_there - level_there)
            low, high = np.where(alone, near_there - drift, low), np.where(alone, near_there + drift, high)
        d = np.min([_outside(x[i + q], low, high) for q in range(k)], axis=0)
        with np.errstate(invalid="ignore"):
            beside = np.fmax(_outside(wide[o - 1], low, high), _outside(wide[o + k], low, high))
            d = np.where(np.isnan(d) | (beside > BACK * d), -np.inf, d)
        for q in range(k):
            best[i + q] = np.maximum(best[i + q], d)
    return best


def standoff_inside(x: np.ndarray) -> np.ndarray:
    """The same for the readings that have REACH others on both sides; -inf for the rest."""
    n = len(x)
    best = np.full(n, -np.inf)
    if n < 2 * REACH + 1:
        return best
    level = _middle(x, SIDE)
    for k in range(1, LONGEST + 1):
        i = np.arange(SIDE, n - k - SIDE + 1)
        before, after = level[i - SIDE], level[i + k]
        low, high = np.minimum(before, after), np.maximum(before, after)
        with np.errstate(invalid="ignore"):
            d = np.min([_outside(x[i + q], low, high) for q in range(k)], axis=0)
            beside = np.fmax(_outside(x[i - 1], low, high), _outside(x[i + k], low, high))
            d = np.where(np.isnan(d) | (beside > BACK * d), -np.inf, d)
        for q in range(k):
            best[i + q] = np.maximum(best[i + q], d)
    return best


def runs(x: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Length of the run of equal readings that each one is in; runs end at `breaks`."""
    new = breaks.copy()
    new[1:] |= x[1:] != x[:-1]
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(x)))
    return np.repeat(size, size)


def deviations(x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Distance from the rolling median; near the ends of a piece, from that of its nearest whole window."""
    n, width = len(x), 2 * CENTRE + 1
    if n < width:
        return np.abs(x - np.median(x)) if n else x
    middle = _middle(x, width)
    centre = np.clip(np.arange(n), np.minimum(starts + CENTRE, n - 1 - CENTRE), np.maximum(ends - 1 - CENTRE, CENTRE))
    centre = np.clip(centre, CENTRE, n - 1 - CENTRE)
    with np.errstate(invalid="ignore"):
        return np.abs(x - middle[centre - CENTRE])


def bin_of(d: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        b = np.floor(np.log2(d) * BINS)
    return np.where(np.isfinite(b), np.clip(b, -20_000, 20_000), np.where(d > 0, 20_000, -30_000)).astype(np.int32)


def scatter_of(bins: np.ndarray, counts: np.ndarray) -> float:
    """Scatter from the distribution of deviations: MAD, or the mean deviation where more than half are none."""
    if not len(bins):
        return 0.0
    order = np.argsort(bins)
    bins, counts = bins[order], counts[order]
    upto = np.cumsum(counts)
    half = upto[-1] / 2
    i = int(np.searchsorted(upto, half))
    if bins[i] > -30_000:
        part = (half - (upto[i] - counts[i])) / counts[i]
        return MAD * float(2.0 ** ((bins[i] + part) / BINS))
    some = bins > -30_000
    return 1.2533 * float(np.sum(counts[some] * 2.0 ** ((bins[some] + 0.5) / BINS)) / upto[-1])


_ROW = [("clase", pa.int8()), ("fuente", pa.int64()), ("ts", pa.int64()), ("fila", pa.int64()), ("copias", pa.int64()), ("valor", pa.float64()), ("marca", pa.int8()), ("decide", pa.bool_())]
#: Of a piece: the distribution of its deviations, and its readings that stand off at all, those of one copy (c_) and of more (r_).
_LISTS = [("bandas", pa.int32()), ("cuentas", pa.int64()), ("c_fila", pa.int64()), ("c_lejos", pa.float64()), ("r_ts", pa.int64()), ("r_fila", pa.int64()), ("r_copias", pa.int64()), ("r_lejos", pa.float64())]
_FOUND = pa.schema(_ROW + [(n, pa.list_(t)) for n, t in _LISTS])
_FOUND_DDL = "clase tinyint, fuente long, ts long, fila long, copias long, valor double, marca tinyint, decide boolean, bandas array<int>, cuentas array<bigint>, c_fila array<bigint>, c_lejos array<double>, r_ts array<bigint>, r_fila array<bigint>, r_copias array<bigint>, r_lejos array<double>"
#: Bits of `marca`: impossible; at the value at which the sensor is full.
BAD, FULL = 1, 2


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole pieces with the starts of these; a piece is closed at every MOST readings of its source-day, wherever batches end."""
    held: list = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows <= MOST:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        starts = _starts(t)
        end = int(starts[-1])
        yield t.slice(0, end).combine_chunks(), starts[:-1]
        rest = t.slice(end).combine_chunks()
        held, rows = rest.to_batches(), rest.num_rows
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, _starts(t)


def _starts(t: pa.Table) -> np.ndarray:
    source, day, n = t.column("fuente").combine_chunks(), t.column("dia").to_numpy(), t.num_rows
    new = np.ones(n, bool)
    new[1:] = pc.not_equal(source.slice(1), source.slice(0, n - 1)).to_numpy(zero_copy_only=False) | (day[1:] != day[:-1])
    at = np.flatnonzero(new)
    place = np.arange(n) - np.repeat(at, np.diff(np.append(at, n)))
    return np.flatnonzero(place % MOST == 0)


def _lists(owner: np.ndarray, m: int, *values: np.ndarray) -> list[pa.Array]:
    """List columns of m rows of values whose owners are in order."""
    offsets = pa.array(np.searchsorted(owner, np.arange(m + 1)).astype(np.int32))
    return [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in values]


def judge_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For sorted readings: those that are found without the rest of the series, ends of pieces, and what each piece holds."""
    for t, starts in _pieces(batches):
        n, m = t.num_rows, len(starts)
        x = t.column("valor").to_numpy().copy()
        x[np.isnan(x)] = np.inf
        mark = t.column("marca").to_numpy()
        bad, full = (mark & BAD) > 0, (mark & FULL) > 0
        size = np.diff(np.append(starts, n))
        start, end = np.repeat(starts, size), np.repeat(starts + size, size)
        at = np.arange(n)
        breaks = np.zeros(n, bool)
        breaks[starts] = True
        stuck = runs(x, breaks) >= STUCK
        away = np.minimum(at - start, end - 1 - at)
        inside, ends = away >= REACH, away < 2 * REACH
        d = standoff_inside(x)
        dev = deviations(x, start, end)
        use = inside & ~stuck & ~bad & np.isfinite(dev)
        piece = np.repeat(np.arange(m), size)
        key, counts = np.unique(piece[use].astype(np.int64) * 100_000 + (bin_of(dev[use]) + 40_000), return_counts=True)
        flagged = inside & (bad | (stuck & ~full))
        stand = np.flatnonzero(inside & ~flagged & (d > 0))
        for kind, which in ((OUT, flagged), (EDGE, ends)):
            i = np.flatnonzero(which)
            if len(i):
                take = t.take(pa.array(i))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(i), kind, np.int8)), *[take.column(c).combine_chunks() for c in ("fuente", "ts", "fila", "copias")], pa.array(x[i]), pa.array(mark[i]), pa.array(~inside[i]), *[pa.nulls(len(i), pa.list_(kind)) for _, kind in _LISTS]],
                    schema=_FOUND,
                )
        lists = _lists(key // 100_000, m, (key % 100_000 - 40_000).astype(np.int32), counts.astype(np.int64))
        when, row, copies = (t.column(c).to_numpy() for c in ("ts", "fila", "copias"))
        one, more = stand[copies[stand] == 1], stand[copies[stand] > 1]
        lists += _lists(piece[one], m, row[one], d[one]) + _lists(piece[more], m, when[more], row[more], copies[more], d[more])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(m, PIECES, np.int8)), t.column("fuente").combine_chunks().take(pa.array(starts)), *[pa.nulls(m, kind) for _, kind in _ROW[2:]], *lists],
            schema=_FOUND,
        )


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of one `fuente` each, of a partition sorted by it."""
    held: list = []
    for b in batches:
        source, n = b.column("fuente"), b.num_rows
        if not n:
            continue
        new = pc.not_equal(source.slice(1), source.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), n]
        for a, z in zip(cuts, cuts[1:]):
            if held and held[-1].column("fuente")[0].as_py() != source[a].as_py():
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(b.slice(a, z - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


class _JudgeSources:
    """Of each source: its scatter, and the readings near the ends of its pieces, in the series of all of these."""

    def __init__(self, excursions: bool):
        self.excursions = excursions

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            whole = t.column("clase").to_numpy() == PIECES
            of_pieces, t = t.filter(pa.array(whole)), t.filter(pa.array(~whole)).combine_chunks()
            bins, counts = (of_pieces.column(c).combine_chunks().flatten().to_numpy() for c in ("bandas", "cuentas"))
            x = t.column("valor").to_numpy()
            mark, decide = t.column("marca").to_numpy(), t.column("decide").to_numpy()
            bad, n = (mark & BAD) > 0, len(x)
            breaks = np.zeros(n, bool)
            breaks[:1] = True
            stuck = runs(x, breaks) >= STUCK if n else breaks
            dev = deviations(x, np.zeros(n, np.int64), np.full(n, n))
            own = bin_of(dev[decide & ~stuck & ~bad & np.isfinite(dev)])
            bins, place = np.unique(np.concatenate([bins, own]), return_inverse=True)
            s = scatter_of(bins, np.bincount(place, np.concatenate([counts, np.ones(len(own), np.int64)])))
            hit = bad | (stuck & ((mark & FULL) == 0))
            if self.excursions and n:
                d = standoff(x)
                hit |= (d > TIMES * s) & (d > 0)
            found = t.filter(pa.array(hit & decide))
            m = found.num_rows
            name = of_pieces.column("fuente").combine_chunks().slice(0, 1)
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([name, found.column("fuente").combine_chunks()]), *[pa.concat_arrays([pa.nulls(1, pa.int64()), found.column(c).combine_chunks()]) for c in ("ts", "fila", "copias")], pa.array([s] + [None] * m, pa.float64())], ["fuente", "ts", "fila", "copias", "dispersion"])


def implausible(
    df: DataFrame,
    source: list[Column],
    sensor: Column,
    ts: str,
    value: str,
    row_id: str,
    limits: DataFrame,
    full: dict[str, float] | None = None,
    excursions: bool = True,
) -> DataFrame:
    """The `row_id` (a long, unique) of all delivered rows whose reading is implausible for its source.

    A reading is the first delivered copy with a value of the rows with one
    `source` (and `sensor`) and `ts`; the rows of its other copies come out with it.  It is
    implausible if it is

    * not a number, or outside the physical `limits` of its sensor (columns
      sensor, min_fisico, max_fisico; ends included; none for other sensors);
    * one of STUCK or more readings in a row with the same value, unless that
      is the value at which the sensor is `full`;
    * in an excursion of at most LONGEST readings, each further than TIMES the
      scatter outside the medians of the SIDE readings before and after it,
      with the readings beside it back at BACK of its distance or nearer.
      Where the series begins or ends, the END nearest on the one side count,
      widened by how far they are from the SIDE nearest.  Without `excursions`
      this is left out.

    Scatter is MAD times the median deviation of the source's readings from
    their rolling median (Hampel filter), stuck and impossible ones left out,
    over the whole series.  It comes from distributions in BINS an octave, so
    it is exact to a few per cent.

    In shuffles a source goes by a hash; all sources are counted beforehand,
    and another hash is taken while two of them share one.

    A series is judged in pieces of a day, of MOST readings at most; the
    readings of source-days with over a thousandth of all rows are spread over
    slices of the day, so no source is gathered in one task.  Only 2 * REACH
    readings at either end of each piece meet those of the next, and nothing
    is decided about a reading before its REACH neighbours on both sides are
    there, so results are those of the whole series, wherever it is cut.  All
    readings that stand off at all wait in lists, one for each piece, until
    the scatter of their source is known.

    Nulls: null values are no readings; a row with a null source or time is a
    reading of a series of its own kind (null sources count as one name), rows
    without time are none.  Repeated and tied rows count as copies.  Constant
    series have no scatter: any excursion stands off.  An empty table gives an
    empty result.  Other columns of `df` are not looked at.
    """
    spark = df.sparkSession
    ship(spark)
    full_at = spark.createDataFrame([(name, float(at)) for name, at in (full or {}).items()], "__s string, __full double")
    bounds = limits.select(F.lower(F.trim("sensor")).alias("__s"), F.col("min_fisico").alias("__low"), F.col("max_fisico").alias("__high")).where("__s is not null").groupBy("__s").agg(F.max("__low").alias("__low"), F.min("__high").alias("__high"))
    bounds = cut(bounds.join(full_at, "__s", "full").withColumn("limite", F.row_number().over(Window.orderBy("__s"))))
    bounds = F.broadcast(bounds) if bounds.count() <= BROADCAST_SOURCES else bounds
    names = [*[F.coalesce(c.cast("string"), F.lit(NONE)) for c in source], F.coalesce(sensor.cast("string"), F.lit(NONE))]
    of = [f"__f{i}" for i in range(len(names))]
    day = F.floor(F.col("ts") / PIECE)
    rows = df.select(
        *[c.alias(n) for c, n in zip(names, of)],
        sensor.alias("__s"),
        F.unix_micros(F.col(f"`{ts}`").cast("timestamp")).alias("ts"),
        F.col(f"`{row_id}`").alias("fila"),
        F.col(f"`{value}`").cast("double").alias("valor"),
    ).where(F.col("valor").isNotNull() & F.col("ts").isNotNull())
    days = cut(rows.groupBy(*of, day.alias("dia")).agg(F.count(F.lit(1)).alias("n")))
    known = cut(days.select(*of).distinct())
    # as few bits as a hash needs to keep so many sources apart, nine times in ten
    bits = min(62, 2 * known.count().bit_length() + 4)
    for seed in range(100):
        number = F.pmod(F.xxhash64(F.lit(seed), *of), F.lit(1 << bits))
        if known.agg(F.count(F.lit(1)) == F.count_distinct(number)).first()[0]:
            break
    limit = hot_limit(days.agg(F.sum("n")).first()[0] or 0)
    hot = days.where(F.col("n") > limit).select(number.alias("fuente"), "dia", F.ceil(F.col("n") / limit).alias("veces"))
    rows = rows.withColumn("fuente", number)
    # keys and values of fixed width only, so copies are taken off in a hash aggregation
    marked = rows.join(bounds.select("__s", "limite"), "__s", "left").groupBy("fuente", "limite", "ts").agg(F.min("fila").alias("fila"), F.min_by("valor", "fila").alias("valor"), F.count(F.lit(1)).alias("copias"))
    is_bad = F.isnan("valor") | (F.col("valor") < F.col("__low")) | (F.col("valor") > F.col("__high"))
    mark = F.when(is_bad, BAD).otherwise(0) + F.when(F.col("valor") == F.col("__full"), FULL).otherwise(0)
    readings = marked.join(bounds.drop("__s"), "limite", "left").withColumn("dia", day).join(F.broadcast(hot), ["fuente", "dia"], "left")
    part = F.floor((F.col("ts") / PIECE - F.col("dia")) * F.col("veces"))
    readings = readings.select("fuente", (F.col("dia") * 1_000_000 + F.coalesce(part, F.lit(0))).alias("dia"), "ts", "fila", "copias", "valor", mark.cast("tinyint").alias("marca"))
    pieces = cut(readings.repartition(partitions(spark), "fuente", "dia").sortWithinPartitions("fuente", "dia", "ts").mapInArrow(judge_pieces, _FOUND_DDL))
    by_source = pieces.where(F.col("clase") != OUT).select("clase", "fuente", "ts", "fila", "copias", "valor", "marca", "decide", "bandas", "cuentas")
    by_source = cut(by_source.repartition(partitions(spark), "fuente").sortWithinPartitions("fuente", "ts").mapInArrow(_JudgeSources(excursions), "fuente long, ts long, fila long, copias long, dispersion double"))
    found = ["fuente", "ts", "fila", "copias"]
    out = pieces.where(F.col("clase") == OUT).select(*found).unionByName(by_source.where("dispersion is null").select(*found))
    if excursions:
        scatter = by_source.where("dispersion is not null").select("fuente", "dispersion")
        if scatter.count() <= BROADCAST_SOURCES:
            scatter = F.broadcast(scatter)
        stand = pieces.where(F.col("clase") == PIECES).join(scatter, "fuente")
        far = lambda *lists: F.explode(F.filter(F.arrays_zip(*lists), lambda x: x[lists[-1]] > TIMES * F.col("dispersion"))).alias("x")
        more = stand.select("fuente", far("r_ts", "r_fila", "r_copias", "r_lejos")).select("fuente", *[F.col(f"x.r_{c}").alias(c) for c in found[1:]])
        one = stand.select("fuente", far("c_fila", "c_lejos")).select("fuente", F.lit(None).cast("long").alias("ts"), F.col("x.c_fila").alias("fila"), F.lit(1).cast("long").alias("copias"))
        out = out.unionByName(more).unionByName(one)
    out = cut(out)
    again = out.where("copias > 1").select("fuente", "ts", "copias")
    copies = rows.select("fuente", "ts", "fila")
    if again.count() <= BROADCAST_SOURCES:
        others = copies.join(F.broadcast(again.drop("copias")), ["fuente", "ts"])
    else:
        others = join_back(copies, again, ["fuente", "ts"], "copias", limit)
    return out.where("copias = 1").select(F.col("fila").alias(row_id)).unionByName(others.select(F.col("fila").alias(row_id)))

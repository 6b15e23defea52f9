"""Placing items of varying length into containers of fixed capacity."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brocal.session import cut, partitions, ship

CAPACITY = 2048
#: Iterations of the fit of repeat counts, and how small its steps may become.
STEPS, ENOUGH = 400, 1e-6
#: Parts that all items are numbered in, shared out among the lengths by their numbers of items.
PARTS = 65_536


def patterns_of(present: np.ndarray, capacity: int) -> np.ndarray:
    """All patterns of two or three of the lengths that fill a container exactly; rows of lengths, 0 for none."""
    have = np.zeros(capacity + 1, bool)
    have[present] = True
    found = []
    for a in present[present <= capacity // 2].tolist():
        if have[capacity - a]:
            found.append(np.array([[a, capacity - a, 0]]))
        b = np.arange(a, (capacity - a) // 2 + 1)
        b = b[have[b] & have[capacity - a - b]]
        if len(b):
            found.append(np.stack([np.full(len(b), a), b, capacity - a - b], axis=1))
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def fit(patterns: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """Non-negative repeat counts with which the patterns use about the lengths of the histogram: least squares, by accelerated projected gradients."""
    n = len(histogram)
    if not len(patterns):
        return np.zeros(0)
    used = patterns > 0
    rows = np.nonzero(used)[0]
    cols = patterns[used]
    scale = max(1.0, float(histogram.max()))
    target = histogram / scale

    def uses(x):
        return np.bincount(cols, x[rows], minlength=n)

    def back(r):
        return np.bincount(rows, r[cols], minlength=len(patterns))

    v = np.ones(len(patterns))
    for _ in range(30):  # the largest curvature, for the step
        v = back(uses(v))
        size = float(np.linalg.norm(v))
        v /= size
    x = np.zeros(len(patterns))
    y, t = x, 1.0
    for _ in range(STEPS):
        new = np.maximum(0.0, y - back(uses(y) - target) / (1.05 * size))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t2 * (new - x)
        done = np.abs(new - x).sum() <= ENOUGH * max(1.0, new.sum())
        x, t = new, t2
        if done:
            break
    return x * scale


@dataclass
class Plan:
    """Patterns with repeat counts: (lengths, repeats), lengths in the order in which they lie in the container."""

    patterns: list[tuple[tuple[int, ...], int]]
    capacity: int

    @property
    def containers(self) -> int:
        return sum(n for _, n in self.patterns)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Which lengths lie together, and how often.

    Patterns of two or three lengths that fill a container are fitted to the
    histogram, their repeat counts rounded down as far as the items reach, and
    what is left is packed largest first, each container closed by the pair or
    item that fits best, and repeated while its lengths last.  The work depends
    on the number of different lengths, not of items.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is not within the capacity")
        left[length] += n
    out: list[tuple[tuple[int, ...], int]] = []
    if left[capacity]:
        out.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    patterns = patterns_of(np.flatnonzero(left), capacity)
    repeats = np.floor(fit(patterns, left.astype(float)) + 1e-9).astype(np.int64)
    for i in np.argsort(-repeats, kind="stable"):
        if repeats[i] <= 0:
            break
        lengths = [int(x) for x in patterns[i] if x]
        n = min(int(repeats[i]), *(int(left[x]) // lengths.count(x) for x in lengths))
        if n > 0:
            out.append((tuple(sorted(lengths, reverse=True)), n))
            for x in lengths:
                left[x] -= n
    while True:
        have = np.flatnonzero(left)
        if not len(have):
            return Plan(out, capacity)
        chosen, room, spare = [], capacity, left.copy()
        while True:
            fits = np.flatnonzero(spare[: room + 1])
            if not len(fits):
                break
            pick = int(fits[-1])
            if chosen:
                # two that fill the rest exactly, or else the largest that fits
                other = room - fits
                exact = fits[(other >= fits) & (spare[np.maximum(other, 0)] > (other == fits))]
                if spare[room] == 0 and len(exact):
                    pick = room - int(exact[-1])
            chosen.append(pick)
            spare[pick] -= 1
            room -= pick
        n = min(int(left[x]) // chosen.count(x) for x in set(chosen))
        out.append((tuple(chosen), n))
        for x in chosen:
            left[x] -= n


class _Place:
    """Looks up (length, rank among the items of this length) in the plan."""

    def __init__(self, broadcast):
        self.broadcast = broadcast

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, starts, base, times, offset = self.broadcast.value
        total = int(base.max()) if len(base) else 0
        for b in batches:
            length, rank = b.column("tokens").to_numpy(), b.column("__rank").to_numpy()
            if len(keys):
                i = np.maximum(0, np.searchsorted(keys, (length << 44) + rank, side="right") - 1)
                local = rank - starts[i]
                box = base[i] + local // times[i]
                at = offset[i] + local % times[i] * length
            else:
                box, at = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            box = np.where(length == 0, rank % (total + 1), box)
            at = np.where(length == 0, 0, at)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column("pieza"), pa.array(box), pa.array(at), b.column("tokens")], [b.schema.names[0], "pieza", "contenedor", "inicio", "tokens"])


def lookup(p: Plan) -> tuple[np.ndarray, ...]:
    """The plan by length and rank: for each length and pattern its first rank, first container, times it lies in one, and offset there."""
    rows = []
    first = 0
    used: dict[int, int] = {}
    for lengths, n in p.patterns:
        at = 0
        for x in dict.fromkeys(lengths):
            m = lengths.count(x)
            rows.append((x, used.get(x, 0), first, m, at))
            used[x] = used.get(x, 0) + m * n
            at += m * x
        first += n
    rows.sort()
    t = np.array(rows, np.int64).reshape(-1, 5)
    return (t[:, 0] << 44) + t[:, 1], t[:, 1].copy(), t[:, 2].copy(), t[:, 3].copy(), t[:, 4].copy()


def packed(lengths: DataFrame, key: str, tokens: str = "tokens", capacity: int = CAPACITY) -> DataFrame:
    """Each piece of each item with its place: `key`, pieza, contenedor, inicio (offset in the container), tokens.

    An item within the capacity is one piece.  A longer one is cut into full
    containers and a rest, numbered from 0.  Containers are numbered from 0.

    Only the histogram of lengths (at most `capacity` rows) goes to the driver,
    where `plan` packs it.  Items of one length are numbered in parts, as many
    as its share of PARTS, so that parts are of about one size whatever the
    lengths; part sizes (at most PARTS + capacity rows) are broadcast.

    Items of length 0 or null take no room and are spread over the containers
    (container 0 if there is none).  Items may be repeated and keys null; each
    row is an item of its own.  An empty table gives an empty one.  Extra
    columns are left out.
    """
    spark = lengths.sparkSession
    ship(spark)
    kind = lengths.schema[key].dataType.simpleString()
    n = F.coalesce(F.col(f"`{tokens}`").cast("bigint"), F.lit(0))
    full, rest = F.floor(n / capacity).cast("bigint"), n % capacity
    sizes = F.concat(F.array_repeat(F.lit(capacity).cast("bigint"), full.cast("int")), F.when((rest > 0) | (n == 0), F.array(rest)).otherwise(F.array().cast("array<bigint>")))
    items = lengths.select(F.col(f"`{key}`"), F.posexplode(sizes).alias("pieza", "tokens"))
    items = cut(items.withColumn("__id", F.spark_partition_id() + F.monotonically_increasing_id()))
    histogram = {r["tokens"]: r["n"] for r in items.groupBy("tokens").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = max(1, sum(histogram.values()))
    # a part of fewer than 1,000 items saves nothing
    salts = spark.createDataFrame([(k, max(1, min(-(-m * PARTS // total), m // 1000))) for k, m in histogram.items()], "tokens long, __parts long")
    items = items.join(F.broadcast(salts), "tokens").withColumn("__salt", F.col("__id") % F.col("__parts"))
    parts = cut(items.groupBy("tokens", "__salt").agg(F.count(F.lit(1)).alias("__n")))
    made = plan({k: v for k, v in histogram.items() if k > 0}, capacity)
    before = Window.partitionBy("tokens").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("tokens", "__salt", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy("tokens", "__salt").orderBy(key, "pieza")
    ranked = items.withColumn("__i", F.row_number().over(within).cast("bigint") - 1).join(F.broadcast(offsets), ["tokens", "__salt"])
    ranked = ranked.select(F.col(f"`{key}`"), "pieza", "tokens", (F.col("__before") + F.col("__i")).alias("__rank"))
    shared = spark.sparkContext.broadcast(lookup(made))
    return ranked.mapInArrow(_Place(shared), f"`{key}` {kind}, pieza int, contenedor long, inicio long, tokens long")


def packing_report(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: pieces, tokens, containers, the least number that could hold the tokens, and the share of space that is filled."""
    boxes = placed.groupBy("contenedor").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("p"))
    return boxes.agg(
        F.sum("p").alias("piezas"), F.sum("t").alias("tokens"), F.count(F.lit(1)).alias("contenedores"),
        F.ceil(F.sum("t") / capacity).alias("minimo"), F.max("t").alias("mayor"), F.round(F.sum("t") / (F.count(F.lit(1)) * capacity), 6).alias("llenado"),
    )

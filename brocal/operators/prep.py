"""Data preparation: missing values, outliers, integration, encoding, discretisation, scaling."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brocal.operators.neighbours import BLOCK, nearest
from brocal.operators.quantiles import quantiles
from brocal.operators.skew import block_join

# ---------------------------------------------------------------- missing values


def drop_missing(df: DataFrame, how: str = "any", thresh: int | None = None, subset: Sequence[str] | None = None) -> DataFrame:
    """Rows without nulls (any), not all null (all), or with at least `thresh` values."""
    return df.na.drop(how=how, thresh=thresh, subset=list(subset) if subset else None)


def missing_columns(profile: DataFrame) -> DataFrame:
    """Of a quality profile, the columns with nulls and their share."""
    return profile.where("nulos > 0").withColumn("pct", F.round(100 * F.col("nulos") / F.col("filas"), 4))


def impute(df: DataFrame, column: str, how: str = "mean", constant: float | None = None) -> DataFrame:
    """`df` with the column's nulls replaced by its mean, median, mode (the least of the most frequent) or a constant."""
    x = F.col(f"`{column}`")
    if how == "constant":
        return df.withColumn(column, F.coalesce(x, F.lit(constant)))
    if how == "mode":
        value = df.where(x.isNotNull()).groupBy(x.alias("__v")).agg(F.count(F.lit(1)).alias("__n")).agg(F.min_by("__v", F.struct(-F.col("__n"), "__v")).alias("__v"))
    else:
        value = df.agg(F.avg(x).alias("__v")) if how == "mean" else quantiles(df, x.cast("double"), [0.5]).select(F.col("q")[0].alias("__v"))
    return df.join(F.broadcast(value)).withColumn(column, F.coalesce(x, F.col("__v"))).drop("__v")


def spread(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count(column).alias("n"), F.round(F.avg(column), 6).alias("media"), F.round(F.stddev_samp(column), 6).alias("desv"))


def compare_imputers(df: DataFrame, column: str, others: dict[str, DataFrame] | None = None) -> DataFrame:
    """metodo, n, media, desv, perdida (1 - deviation over that of the present values), for drop, mean, median and any other filled tables."""
    made = {"drop": df.where(F.col(column).isNotNull()), "mean": impute(df, column, "mean"), "median": impute(df, column, "median"), **(others or {})}
    out = None
    for name, d in made.items():
        one = spread(d, column).withColumn("metodo", F.lit(name))
        out = one if out is None else out.unionByName(one)
    base = spread(made["drop"], column).select(F.col("desv").alias("__base"))
    return out.join(F.broadcast(base)).withColumn("perdida", F.round(1 - F.col("desv") / F.col("__base"), 6)).drop("__base")


def impute_knn(df: DataFrame, key: str, column: str, features: Sequence[str], k: int = 5, block: int = BLOCK) -> DataFrame:
    """`key`, valor: the column with nulls replaced by the mean of the k nearest rows that have it.

    Distance is Euclidean over standardised features that both rows have,
    scaled up for missing ones.  Rows with nulls are compared with all that have
    a value, in blocks; of equally near ones, the hash of the key decides.
    """
    columns = list(dict.fromkeys([*features, column]))
    number = {c: F.col(c).cast("double") for c in columns}
    df = df.select(key, *[F.when(~F.isnan(x), x).alias(c) for c, x in number.items()])
    made = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    x = F.array(*[(F.col(c) - (made[f"m{i}"] or 0.0)) / (made[f"s{i}"] or 1.0) for i, c in enumerate(columns)])
    need = df.where(F.col(column).isNull()).select(F.col(key).alias("k"), x.alias("x"), F.lit(0).cast("bigint").alias("grupo"))
    have = df.where(F.col(column).isNotNull()).select(F.xxhash64(key).alias("orden"), x.alias("x"), F.lit(1).cast("bigint").alias("grupo"), F.col(column).alias("valor"))
    filled = nearest(need, have, k, block).select(F.col("k").alias(key), F.aggregate("cerca", F.lit(0.0), lambda s, r: s + r["valor"], lambda s: s / F.size("cerca")).alias("valor"))
    kept = df.select(key, F.col(column).alias("valor"))
    return kept.where("valor is not null").unionByName(kept.where("valor is null").drop("valor").join(filled, key, "left"))


# ---------------------------------------------------------------- outliers


def bounds(df: DataFrame, column: str, how: str = "iqr", times: float = 1.5) -> DataFrame:
    """bajo, alto: quartiles widened by `times` the range between them, or mean and `times` deviations."""
    x = F.col(f"`{column}`").cast("double")
    if how == "zscore":
        return df.agg((F.avg(x) - times * F.stddev_samp(x)).alias("bajo"), (F.avg(x) + times * F.stddev_samp(x)).alias("alto"))
    q = quantiles(df, x, [0.25, 0.75])
    return q.select((F.col("q")[0] - times * (F.col("q")[1] - F.col("q")[0])).alias("bajo"), (F.col("q")[1] + times * (F.col("q")[1] - F.col("q")[0])).alias("alto"))


def outliers(df: DataFrame, column: str, how: str = "iqr", times: float = 1.5) -> DataFrame:
    """Rows outside the bounds, with these."""
    x = F.col(f"`{column}`")
    return df.join(F.broadcast(bounds(df, column, how, times))).where((x < F.col("bajo")) | (x > F.col("alto")))


def handle_outliers(df: DataFrame, column: str, action: str, how: str = "iqr", times: float = 1.5) -> DataFrame:
    """Outliers removed, clipped to the bounds (cap), or the column's logarithm taken (log1p, shifted to begin at 1 if any value is negative)."""
    x = F.col(f"`{column}`").cast("double")
    if action == "log":
        low = df.agg(F.min(x).alias("__lo"))
        return df.join(F.broadcast(low)).withColumn(column, F.log1p(x + F.when(F.col("__lo") < 0, 1 - F.col("__lo")).otherwise(0.0))).drop("__lo")
    with_bounds = df.join(F.broadcast(bounds(df, column, how, times)))
    if action == "remove":
        return with_bounds.where(x.isNull() | x.between(F.col("bajo"), F.col("alto"))).drop("bajo", "alto")
    return with_bounds.withColumn(column, F.when(x.isNotNull(), F.greatest(F.least(x, F.col("alto")), F.col("bajo")))).drop("bajo", "alto")


# ---------------------------------------------------------------- integration


def union_by_schema(a: DataFrame, b: DataFrame) -> tuple[str, DataFrame | None]:
    """strict_union of equal columns, common_columns_only, or blocked (None) where there are none in common."""
    common = [c for c in a.columns if c in b.columns]
    if set(a.columns) == set(b.columns):
        return "strict_union", a.unionByName(b)
    if common:
        return "common_columns_only", a.select(*common).unionByName(b.select(*common))
    return "blocked", None


def joined(a: DataFrame, b: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """Join on a key; other columns of the same name get _a and _b."""
    same = [c for c in a.columns if c in b.columns and c != on]
    a = a.withColumnsRenamed({c: f"{c}_a" for c in same})
    b = b.withColumnsRenamed({c: f"{c}_b" for c in same})
    return block_join(a, b, on, how)


def key_report(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    """claves_a, claves_b, comunes, solo_a, solo_b of the distinct keys."""
    both = a.select(F.col(on).alias("k"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select(F.col(on).alias("k"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    per = both.where("k is not null").groupBy("k").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return per.agg(F.sum("a").cast("bigint").alias("claves_a"), F.sum("b").cast("bigint").alias("claves_b"), F.count_if((F.col("a") + F.col("b")) == 2).alias("comunes"), F.count_if(F.col("b") == 0).alias("solo_a"), F.count_if(F.col("a") == 0).alias("solo_b"))


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """v: association of two categorical columns, from all cells of their table, empty ones too."""
    n = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("o"))
    ra, rb = n.groupBy("a").agg(F.sum("o").alias("ra")), n.groupBy("b").agg(F.sum("o").alias("rb"))
    total = n.agg(F.sum("o").alias("t"))
    # the sum over all cells of (o - e)^2 / e is the sum over the cells that have rows of o^2 / e, less the total;
    # as floats, since the products of counts pass 64 bits from some millions of rows
    cells = n.join(ra, "a").join(rb, "b").join(F.broadcast(total))
    o = F.col("o").cast("double")
    part = cells.agg(F.sum(o / F.col("ra") * (o / F.col("rb")) * F.col("t")).alias("s"), F.max("t").alias("t"), F.count_distinct("a").alias("ka"), F.count_distinct("b").alias("kb"))
    chi, small = F.col("s") - F.col("t"), F.least("ka", "kb") - 1
    return part.select(F.round(F.when(small > 0, F.sqrt(F.greatest(chi, F.lit(0.0)) / (F.col("t") * small))).otherwise(0.0), 6).alias("v"))


def redundant(df: DataFrame, correlations: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Of each redundant pair, the column with the smaller variance: a, b, r, sobra."""
    made = df.agg(*[F.var_samp(c).alias(f"v{i}") for i, c in enumerate(columns)])
    v = made.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"v{i}").alias("v")) for i, c in enumerate(columns)])).alias("x")).select("x.*")
    out = correlations.where("redundante").join(F.broadcast(v.select(F.col("c").alias("a"), F.col("v").alias("va"))), "a").join(F.broadcast(v.select(F.col("c").alias("b"), F.col("v").alias("vb"))), "b")
    return out.select("a", "b", "r", F.when(F.col("va") < F.col("vb"), F.col("a")).otherwise(F.col("b")).alias("sobra"))


def redundant_categories(df: DataFrame, columns: Sequence[str], threshold: float = 0.9) -> DataFrame | None:
    """Of each two categorical columns whose Cramer's V is above the threshold, the one with fewer values (the second on a tie): a, b, v, sobra."""
    kinds = df.agg(*[F.count_distinct(c).alias(f"k{i}") for i, c in enumerate(columns)]).first()
    out = None
    for i, a in enumerate(columns):
        for j in range(i + 1, len(columns)):
            b = columns[j]
            less = a if kinds[f"k{i}"] < kinds[f"k{j}"] else b
            one = cramers_v(df, a, b).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "v", F.lit(less).alias("sobra")).where(F.col("v") > threshold)
            out = one if out is None else out.unionByName(one)
    return out


def drop_correlated(df: DataFrame, correlations: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """`df` without the columns that repeat another: of each redundant pair whose columns are both still there, strongest first, the one with the smaller variance goes."""
    pairs = redundant(df, correlations, columns).orderBy(F.desc(F.abs("r")), "a", "b").collect()
    gone: list[str] = []
    for p in pairs:
        if p["a"] not in gone and p["b"] not in gone:
            gone.append(p["sobra"])
    return df.drop(*gone), gone


# ---------------------------------------------------------------- encoding and discretisation


def one_hot(df: DataFrame, column: str, top: int) -> DataFrame:
    """`df` with a 0/1 column per frequent value, and one for all others (OTROS)."""
    values = [r[0] for r in df.where(F.col(column).isNotNull()).groupBy(column).count().orderBy(F.desc("count"), column).limit(top).collect()]
    flags = {f"{column}_{v}": (F.coalesce(F.col(column) == v, F.lit(False))).cast("int") for v in values}
    return df.withColumns(flags | {f"{column}_OTROS": F.coalesce(~F.col(column).isin(values), F.lit(False)).cast("int")})


def ordinal(column: str, order: Sequence[str]) -> Column:
    """1 for the first; 0 marks values that are not in the order, and null."""
    out = F
    for i, v in enumerate(order):
        out = out.when(F.col(column) == v, i + 1)
    return out.otherwise(0)


def multivalued(df: DataFrame, column: str, sep: str = ",") -> DataFrame:
    """valor, filas of a column of separated lists; and `df` keeps its rows elsewhere."""
    items = F.array_distinct(F.filter(F.transform(F.split(column, sep), lambda x: F.trim(x)), lambda x: x != ""))
    return df.select(F.explode(items).alias("valor")).groupBy("valor").agg(F.count(F.lit(1)).alias("filas"))


def multivalued_flags(df: DataFrame, column: str, vocabulary: Sequence[str], sep: str = ",") -> DataFrame:
    items = F.transform(F.split(column, sep), lambda x: F.trim(x))
    return df.withColumns({f"{column}_{v}": F.coalesce(F.array_contains(items, v), F.lit(False)).cast("int") for v in sorted(vocabulary)})


def edges_equal_width(df: DataFrame, column: str, bins: int) -> list[float]:
    lo, hi = df.agg(F.min(column).cast("double"), F.max(column).cast("double")).first()
    return [] if lo is None else [lo + (hi - lo) * i / bins for i in range(bins + 1)]


def edges_equal_frequency(df: DataFrame, column: str, bins: int) -> list[float]:
    q = quantiles(df, F.col(column).cast("double"), [i / bins for i in range(bins + 1)]).first()["q"]
    return sorted(set(q)) if q else []


def discretise(column: str, edges: Sequence[float]) -> Column:
    """Bin from 1, each with its upper edge; the least value is in the first."""
    x = F.col(column).cast("double")
    out = F.when(x.isNull(), None)
    for i, e in enumerate(edges[1:]):
        out = out.when(x <= e, i + 1)
    return out.otherwise(len(edges) - 1)


def _entropy(n: np.ndarray) -> float:
    p = n[n > 0] / n.sum()
    return float(-(p * np.log2(p)).sum()) if len(p) else 0.0


def mdlp_cuts(values: np.ndarray, counts: np.ndarray) -> list[float]:
    """Cut points that class entropy pays for by minimum description length; `counts` has a row per value, a column per class."""
    cuts: list[float] = []
    stack = [(0, len(values))]
    while stack:
        a, z = stack.pop()
        part = counts[a:z]
        total = part.sum(axis=0)
        n = total.sum()
        if z - a < 2 or n == 0:
            continue
        left = np.cumsum(part, axis=0)[:-1]
        right = total - left
        nl, nr = left.sum(axis=1), right.sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            pl, pr = left / nl[:, None], right / nr[:, None]
            el = -np.nansum(np.where(pl > 0, pl * np.log2(pl), 0), axis=1)
            er = -np.nansum(np.where(pr > 0, pr * np.log2(pr), 0), axis=1)
        e = (nl * el + nr * er) / n
        i = int(np.argmin(e))
        whole = _entropy(total)
        k, kl, kr = (int((x > 0).sum()) for x in (total, left[i], right[i]))
        delta = math.log2(3**k - 2) - (k * whole - kl * el[i] - kr * er[i])
        if whole - e[i] <= (math.log2(n - 1) + delta) / n:
            continue
        cuts.append(float((values[a + i] + values[a + i + 1]) / 2))
        stack += [(a, a + i + 1), (a + i + 1, z)]
    return sorted(cuts)


def edges_mdlp(df: DataFrame, column: str, label: str, digits: int = 4) -> list[float]:
    """Least value, cuts, greatest value; the executors count classes by value (rounded, so that their number is bounded)."""
    per = df.where(F.col(column).isNotNull() & F.col(label).isNotNull()).groupBy(F.round(F.col(column).cast("double"), digits).alias("v"), F.col(label).cast("string").alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()
    if not per:
        return []
    values, classes = sorted({r["v"] for r in per}), sorted({r["c"] for r in per})
    m = np.zeros((len(values), len(classes)))
    vi, ci = {v: i for i, v in enumerate(values)}, {c: i for i, c in enumerate(classes)}
    for r in per:
        m[vi[r["v"]], ci[r["c"]]] += r["n"]
    return [values[0], *mdlp_cuts(np.array(values), m), values[-1]]


# ---------------------------------------------------------------- scaling


def scaled(df: DataFrame, column: str, how: str) -> DataFrame:
    """`df` with `escalado`: zscore (sample deviation), minmax, robust (median and quartile range) or decimal (by a power of ten)."""
    x = F.col(f"`{column}`").cast("double")
    if how == "zscore":
        one, f = df.agg(F.avg(x).alias("__a"), F.stddev_samp(x).alias("__b")), (x - F.col("__a")) / F.col("__b")
    elif how == "minmax":
        one, f = df.agg(F.min(x).alias("__a"), (F.max(x) - F.min(x)).alias("__b")), (x - F.col("__a")) / F.col("__b")
    elif how == "robust":
        q = quantiles(df, x, [0.25, 0.5, 0.75])
        one, f = q.select(F.col("q")[1].alias("__a"), (F.col("q")[2] - F.col("q")[0]).alias("__b")), (x - F.col("__a")) / F.col("__b")
    else:
        most = F.max(F.abs(x))
        one, f = df.agg(F.lit(0.0).alias("__a"), F.when(most >= 1, F.pow(F.lit(10.0), F.ceil(F.log10(most)))).otherwise(1.0).alias("__b")), x / F.col("__b")
    return df.join(F.broadcast(one)).withColumn("escalado", F.when(F.col("__b") == 0, 0.0).otherwise(f)).drop("__a", "__b")


def compare_scalings(df: DataFrame, column: str) -> DataFrame:
    """metodo, media, desv, min, max, pct (share in [0, 0.1], in per cent) of the four."""
    out = None
    for how in ("zscore", "minmax", "robust", "decimal"):
        e = F.col("escalado")
        one = scaled(df, column, how).agg(F.round(F.avg(e), 6).alias("media"), F.round(F.stddev_samp(e), 6).alias("desv"), F.round(F.min(e), 6).alias("min"), F.round(F.max(e), 6).alias("max"), F.round(100 * F.avg(e.between(0, 0.1).cast("double")), 6).alias("pct")).withColumn("metodo", F.lit(how))
        out = one if out is None else out.unionByName(one)
    return out


# ---------------------------------------------------------------- filter selection


def filter_scores(df: DataFrame, columns: Sequence[str], label: str, bins: int = 10) -> DataFrame:
    """columna, pearson (absolute), varianza, chi2 (of sums by class, on values shifted to begin at 0), info (mutual, of equal-width bins)."""
    ends = df.agg(*[F.min(c).cast("double").alias(f"lo{i}") for i, c in enumerate(columns)], *[F.max(c).cast("double").alias(f"hi{i}") for i, c in enumerate(columns)], F.count(label).alias("n"), F.avg(F.col(label).cast("double")).alias("p")).first()
    y, out = F.col(label).cast("double"), None
    for i, c in enumerate(columns):
        lo, hi = ends[f"lo{i}"], ends[f"hi{i}"]
        if lo is None:
            continue
        x = F.col(c).cast("double")
        rows = df.where(x.isNotNull() & y.isNotNull())
        b = F.least(F.floor((x - lo) / max((hi - lo) / bins, 1e-300)), F.lit(bins - 1))
        per = rows.groupBy(b.alias("b"), y.alias("y")).agg(F.count(F.lit(1)).alias("n"))
        pb, py, t = per.groupBy("b").agg(F.sum("n").alias("nb")), per.groupBy("y").agg(F.sum("n").alias("ny")), per.agg(F.sum("n").alias("t"))
        info = per.join(pb, "b").join(py, "y").join(F.broadcast(t)).agg(F.round(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("nb") * F.col("ny")))), 6).alias("info"))
        sums = rows.groupBy(y.alias("y")).agg(F.sum(x - lo).alias("o"), F.count(F.lit(1)).alias("n"))
        whole = sums.agg(F.sum("o").alias("so"), F.sum("n").alias("sn"))
        expected = F.col("so") * F.col("n") / F.col("sn")
        chi = sums.join(F.broadcast(whole)).agg(F.round(F.sum(F.pow(F.col("o") - expected, F.lit(2.0)) / F.nullif(expected, F.lit(0.0))), 6).alias("chi2"))
        base = rows.agg(F.round(F.abs(F.corr(x, y)), 6).alias("pearson"), F.round(F.var_samp(x), 6).alias("varianza"))
        one = base.join(F.broadcast(chi)).join(F.broadcast(info)).withColumn("columna", F.lit(c))
        out = one if out is None else out.unionByName(one)
    return out

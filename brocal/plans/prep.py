"""Queries of exploration and data preparation, over the robots, the telemetry and the order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from brocal.operators import prep as P
from brocal.operators import profiles as R
from brocal.operators import ranking as K
from brocal.plans.problems import table
from brocal.plans.social import plain

NUM = ["battery_health_v2", "consumo_kw", "bateria_pct", "voltaje_v", "consumo_total_kwh"]
CATEGORIES = ["fabricante", "almacen", "zona"]
LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def t(name):
    return lambda spark, sf: table(spark, sf, name)


def q(name, f):
    return lambda spark, sf: plain(f(table(spark, sf, name)))


def lines(spark, sf):
    """Order lines with the tax missing in one of seven orders, by arithmetic."""
    d = table(spark, sf, "lineitem")
    return d.withColumn("l_tax", F.when(F.col("l_orderkey") % 7 != 0, F.col("l_tax")))


def readings(d):
    """Temperatures that are numbers."""
    return d.where((F.lower(F.trim("sensor")) == "temperatura") & ~F.isnan("valor"))


def ql(f):
    return lambda spark, sf: plain(f(lines(spark, sf)))


def parties(spark, sf):
    """All customers and all suppliers, with columns of the same name for what both have."""
    a = table(spark, sf, "customer").select("c_nationkey", "c_custkey", F.col("c_name").alias("name"))
    return a, table(spark, sf, "supplier").select(F.col("s_nationkey").alias("c_nationkey"), "s_suppkey", F.col("s_name").alias("name"))


def join_kind(how):
    def query(spark, sf):
        a, b = parties(spark, sf)
        return P.joined(a, b, "c_nationkey", how).select("c_nationkey", "c_custkey", "s_suppkey", "name_a", "name_b")

    return query


def union_permissive(spark, sf):
    a, b = parties(spark, sf)
    mode, df = P.union_by_schema(a, b)
    return df.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n")).withColumn("modo", F.lit(mode))


def mdlp(spark, sf):
    d = table(spark, sf, "robots")
    return spark.createDataFrame([(i, float(e)) for i, e in enumerate(P.edges_mdlp(d, "bateria_pct", "failure_next_48h"))], "i int, edge double")


def edges(spark, sf):
    d = table(spark, sf, "robots")
    rows = [("width", i, e) for i, e in enumerate(P.edges_equal_width(d, "bateria_pct", 5))] + [("frequency", i, e) for i, e in enumerate(P.edges_equal_frequency(d, "bateria_pct", 4))]
    return plain(spark.createDataFrame(rows, "how string, i int, edge double"))


def binned(spark, sf):
    d = table(spark, sf, "robots")
    b = P.discretise("bateria_pct", P.edges_equal_width(d, "bateria_pct", 5))
    return d.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def flags(spark, sf):
    d = P.multivalued_flags(table(spark, sf, "robots"), "sensores_activos", ["temperatura", "bateria", "vibracion"])
    return d.agg(*[F.sum(f"sensores_activos_{v}").cast("bigint").alias(v) for v in ("bateria", "temperatura", "vibracion")])


def knn(spark, sf):
    d = table(spark, sf, "robots")
    return P.impute_knn(d, "id", "battery_health_v2", NUM)


def one_hot_sums(d):
    """Rows of each flag."""
    made = P.one_hot(d, "o_orderpriority", 3)
    flags = [F.struct(F.lit(c).alias("bandera"), F.col(f"`{c}`").alias("n")) for c in made.columns if c not in d.columns]
    return made.select(F.explode(F.array(*flags)).alias("x")).groupBy("x.bandera").agg(F.sum("x.n").alias("n"))


def dropped(d):
    """Columns that repeat another at a correlation of 0.3."""
    gone = P.drop_correlated(d, R.correlations(d, NUM, 0.3), NUM)[1]
    return d.sparkSession.createDataFrame([(i, c) for i, c in enumerate(gone)], "i int, columna string")


def redundant(d):
    return P.redundant(d, R.correlations(d, NUM), NUM)


def sizes(f):
    """How many rows of each class an operator leaves."""
    return lambda spark, sf: f(table(spark, sf, "orders")).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "eda_schema": q("robots", R.schema_profile), "eda_univariate": q("lineitem", lambda d: R.univariate(d, LINE)), "eda_histogram": q("lineitem", lambda d: R.histogram(d, "l_extendedprice")),
    "eda_value_counts": q("robots", lambda d: R.value_counts(d, "zona")), "eda_samples": q("robots", lambda d: R.sample_values(d.drop(*NUM, "failure_next_48h")).select("columna", F.array_join("ejemplos", "|").alias("ejemplos"))),
    "eda_overview": q("robots", lambda d: R.overview(d, "failure_next_48h")), "eda_midpoint": q("lineitem", lambda d: R.midpoint(d, "l_quantity")), "eda_null_pairs": q("robots", lambda d: R.null_pairs(d, d.columns)), "eda_correlations": q("robots", lambda d: R.correlations(d, NUM)),
    "missing_columns": q("robots", lambda d: P.missing_columns(R.quality_profile(d))), "missing_drop": q("robots", lambda d: P.drop_missing(d, subset=NUM).agg(F.count(F.lit(1)).alias("n"))),
    "missing_thresh": q("robots", lambda d: P.drop_missing(d, thresh=13).agg(F.count(F.lit(1)).alias("n"))),
    "impute_mean": ql(lambda d: P.spread(P.impute(d, "l_tax", "mean"), "l_tax")), "impute_median": ql(lambda d: P.spread(P.impute(d, "l_tax", "median"), "l_tax")), "impute_mode": ql(lambda d: P.spread(P.impute(d, "l_tax", "mode"), "l_tax")),
    "impute_constant": ql(lambda d: P.spread(P.impute(d, "l_tax", "constant", 0.5), "l_tax")), "impute_compare": ql(lambda d: P.compare_imputers(d, "l_tax")), "impute_knn": knn,
    "outliers_iqr": q("telemetry", lambda d: P.outliers(readings(d), "valor", "iqr").select("lectura_id", "valor", "bajo", "alto")),
    "outliers_zscore": q("telemetry", lambda d: P.outliers(readings(d), "valor", "zscore", 3.0).select("lectura_id", "valor")),
    "outliers_cap": ql(lambda d: P.spread(P.handle_outliers(d, "l_extendedprice", "cap", "iqr", 0.3), "l_extendedprice")),
    "outliers_remove": ql(lambda d: P.spread(P.handle_outliers(d, "l_extendedprice", "remove", "iqr", 0.3), "l_extendedprice")),
    "outliers_log": q("customer", lambda d: P.spread(P.handle_outliers(d, "c_acctbal", "log"), "c_acctbal")),
    **{f"integ_join_{h}": join_kind(h) for h in ("inner", "left", "right", "outer")}, "integ_union": union_permissive, "integ_keys": lambda s, d: P.key_report(*parties(s, d), "c_nationkey"),
    "integ_cramers_v": q("lineitem", lambda d: P.cramers_v(d, "l_returnflag", "l_linestatus")), "integ_redundant": q("robots", redundant), "integ_drop_correlated": q("robots", dropped), "integ_redundant_categories": q("robots", lambda d: P.redundant_categories(d, CATEGORIES, 0.02)),
    "trans_one_hot": q("orders", one_hot_sums),
    "trans_ordinal": q("orders", lambda d: d.groupBy(P.ordinal("o_orderpriority", ["5-LOW", "3-MEDIUM", "1-URGENT"]).alias("code")).agg(F.count(F.lit(1)).alias("n"))),
    "trans_multivalued": q("robots", lambda d: P.multivalued(d, "sensores_activos")), "trans_flags": flags, "trans_edges": edges, "trans_binned": binned, "trans_mdlp": mdlp,
    **{f"trans_groupby_{h}": q("lineitem", lambda d, h=h: R.grouped(d, "l_returnflag", "l_quantity", h)) for h in ("mean", "sum", "count", "min", "max", "median", "std")},
    **{f"norm_{h}": q("customer", lambda d, h=h: P.scaled(d, "c_acctbal", h).select("c_custkey", "escalado")) for h in ("zscore", "minmax", "robust", "decimal")}, "norm_compare": q("customer", lambda d: P.compare_scalings(d, "c_acctbal")),
    "filter_scores": q("robots", lambda d: P.filter_scores(d, ["bateria_pct", "voltaje_v", "consumo_total_kwh"], "failure_next_48h")),
    "sample_exact": q("orders", lambda d: K.sample_exact(d, "o_orderkey", 500).select("o_orderkey")), "sample_strata": q("orders", lambda d: K.sample_strata(d, "o_orderkey", "o_orderstatus", 0.1).select("o_orderkey")),
    "balance_under": q("orders", lambda d: K.balance(d, "o_orderkey", "o_orderstatus", "under").select("o_orderkey", "copia")), "balance_over": q("orders", lambda d: K.balance(d, "o_orderkey", "o_orderstatus", "over").select("o_orderkey", "copia")),
    "split_hash": q("orders", lambda d: K.split(d, "o_orderkey").select("o_orderkey", "parte")),
}


def _uni(c):
    return f"select '{c}' columna, count({c}) n, count(*) - count({c}) nulos, round(avg({c}), 6) media, round(stddev_samp({c}), 6) desv, min({c}) as min, round(quantile_cont({c}, 0.25), 6) q1, round(quantile_cont({c}, 0.5), 6) mediana, round(quantile_cont({c}, 0.75), 6) q3, max({c}) as max from lineitem"


_ROBOT_COLUMNS = ["id", "modelo", "fabricante", "fecha_alta", "almacen", "zona", "firmware_version", "sensores_activos", *NUM, "failure_next_48h"]
_L = "with l as (select * replace (case when l_orderkey % 7 != 0 then l_tax end as l_tax) from lineitem)\n"
_R = "with r as (select lectura_id, valor from telemetry where lower(trim(sensor)) = 'temperatura' and not isnan(valor))\n"
_SPREAD = "select count(x) n, round(avg(x), 6) media, round(stddev_samp(x), 6) desv from "
_IQR = "(select q1 - {k} * (q3 - q1) bajo, q3 + {k} * (q3 - q1) alto from (select quantile_cont(l_extendedprice, 0.25) q1, quantile_cont(l_extendedprice, 0.75) q3 from l))"
_H = "with a as (select c_nationkey, c_custkey, c_name as name from customer), b as (select s_nationkey c_nationkey, s_suppkey, s_name as name from supplier)\n"
_PAIRS = [(a, b) for i, a in enumerate(NUM) for b in NUM[i + 1 :]]
_CORR = " union all ".join(f"select '{a}' a, '{b}' b, round(corr({a}, {b}), 6) r, coalesce(abs(round(corr({a}, {b}), 6)) > 0.9, false) redundante from robots" for a, b in _PAIRS)
_HASH = "md5({k}::varchar || ':42')"


def _join(how):
    key = {"inner": "a.c_nationkey", "left": "a.c_nationkey", "right": "b.c_nationkey", "full": "coalesce(a.c_nationkey, b.c_nationkey)"}[how]
    return _H + f"select {key} c_nationkey, c_custkey, s_suppkey, a.name name_a, b.name name_b from a {how} join b on a.c_nationkey = b.c_nationkey"


def _scale(how):
    return {
        "zscore": "(c_acctbal - avg(c_acctbal) over ()) / stddev_samp(c_acctbal) over ()", "minmax": "(c_acctbal - min(c_acctbal) over ()) / (max(c_acctbal) over () - min(c_acctbal) over ())",
        "robust": "(c_acctbal - quantile_cont(c_acctbal, 0.5) over ()) / (quantile_cont(c_acctbal, 0.75) over () - quantile_cont(c_acctbal, 0.25) over ())",
        "decimal": "c_acctbal / case when max(abs(c_acctbal)) over () >= 1 then pow(10, ceil(log10(max(abs(c_acctbal)) over ()))) else 1 end",
    }[how]


SQL = {
    "eda_univariate": " union all ".join(_uni(c) for c in LINE),
    "eda_histogram": """with e as (select min(l_extendedprice) lo, max(l_extendedprice) hi from lineitem)
select bin, round(any_value(lo + (bin - 1) * (hi - lo) / 30), 6) desde, count(*) n from (select least(floor((l_extendedprice - lo) / ((hi - lo) / 30)) + 1, 30)::int bin, lo, hi from lineitem, e) group by bin""",
    "eda_value_counts": "select zona valor, count(*) n from robots group by 1 order by n desc, valor nulls first limit 30",
    "eda_null_pairs": "select * from (" + " union all ".join(f"select '{a}' a, '{b}' b, count(*) filter (where {a} is null and {b} is null) juntos from robots" for i, a in enumerate(_ROBOT_COLUMNS) for b in _ROBOT_COLUMNS[i + 1 :]) + ") where juntos >= 1",
    "eda_correlations": _CORR,
    "missing_columns": "select columna, filas, nulos, round(100 * nulos / filas, 4) pct from (" + " union all ".join(f"select '{c}' columna, count(*) filas, count(*) - count({c}) nulos from robots" for c in _ROBOT_COLUMNS) + ") where nulos > 0",
    "missing_drop": "select count(*) n from robots where " + " and ".join(f"{c} is not null" for c in NUM),
    "missing_thresh": "select count(*) n from robots where " + " + ".join(f"({c} is not null)::int" for c in _ROBOT_COLUMNS) + " >= 13",
    "impute_mean": _L + _SPREAD + "(select coalesce(l_tax, avg(l_tax) over ()) x from l)", "impute_median": _L + _SPREAD + "(select coalesce(l_tax, quantile_cont(l_tax, 0.5) over ()) x from l)",
    "impute_mode": _L + _SPREAD + "(select coalesce(l_tax, (select l_tax from l where l_tax is not null group by 1 order by count(*) desc, 1 limit 1)) x from l)",
    "impute_constant": _L + _SPREAD + "(select coalesce(l_tax, 0.5) x from l)",
    "impute_compare": _L + """, m as (select 'drop' metodo, l_tax x from l where l_tax is not null union all select 'mean', coalesce(l_tax, avg(l_tax) over ()) from l union all select 'median', coalesce(l_tax, quantile_cont(l_tax, 0.5) over ()) from l),
s as (select metodo, count(x) n, round(avg(x), 6) media, round(stddev_samp(x), 6) desv from m group by 1) select *, round(1 - desv / (select desv from s where metodo = 'drop'), 6) perdida from s""",
    "outliers_iqr": _R + "select lectura_id, round(valor, 6) valor, round(bajo, 6) bajo, round(alto, 6) alto from r, (select q1 - 1.5 * (q3 - q1) bajo, q3 + 1.5 * (q3 - q1) alto from (select quantile_cont(valor, 0.25) q1, quantile_cont(valor, 0.75) q3 from r)) where valor < bajo or valor > alto",
    "outliers_zscore": _R + "select lectura_id, round(valor, 6) valor from r, (select avg(valor) a, stddev_samp(valor) s from r) where abs(valor - a) > 3 * s",
    "outliers_cap": _L + _SPREAD + f"(select greatest(least(l_extendedprice, alto), bajo) x from l, {_IQR.format(k=0.3)})", "outliers_remove": _L + _SPREAD + f"(select l_extendedprice x from l, {_IQR.format(k=0.3)} where l_extendedprice between bajo and alto)",
    "outliers_log": _SPREAD + "(select ln(1 + c_acctbal + case when min(c_acctbal) over () < 0 then 1 - min(c_acctbal) over () else 0 end) x from customer)",
    "integ_join_inner": _join("inner"), "integ_join_left": _join("left"), "integ_join_right": _join("right"), "integ_join_outer": _join("full"),
    "integ_union": _H + "select c_nationkey, count(*) n, 'common_columns_only' modo from (select c_nationkey, name from a union all select c_nationkey, name from b) group by 1",
    "integ_keys": _H + """, k as (select c_nationkey k, max(x) a, max(y) b from (select c_nationkey, 1 x, 0 y from a union all select c_nationkey, 0, 1 from b) group by 1)
select sum(a)::bigint claves_a, sum(b)::bigint claves_b, count(*) filter (where a + b = 2) comunes, count(*) filter (where b = 0) solo_a, count(*) filter (where a = 0) solo_b from k""",
    "integ_cramers_v": """with n as (select l_returnflag a, l_linestatus b, count(*) o from lineitem group by 1, 2), x as (select a, sum(o) ra from n group by 1), y as (select b, sum(o) rb from n group by 1), t as (select sum(o) t from n),
cells as (select coalesce(o, 0) o, ra * rb / t e from x cross join y cross join t left join n using (a, b)) select round(sqrt(sum(pow(o - e, 2) / e) / ((select t from t) * (least((select count(*) from x), (select count(*) from y)) - 1))), 6) v from cells""",
    "integ_redundant": f"with c as ({_CORR}), v as (" + " union all ".join(f"select '{c}' c, var_samp({c}) v from robots" for c in NUM) + ") select a, b, r, case when x.v < y.v then a else b end sobra from c join v x on x.c = a join v y on y.c = b where redundante",
    "trans_one_hot": """with top as (select o_orderpriority v from orders group by 1 order by count(*) desc, 1 limit 3)
select 'o_orderpriority_' || v bandera, count(*) n from orders join top on o_orderpriority = v group by 1 union all select 'o_orderpriority_OTROS', count(*) from orders where o_orderpriority not in (select v from top)""",
    "trans_ordinal": "select case o_orderpriority when '5-LOW' then 1 when '3-MEDIUM' then 2 when '1-URGENT' then 3 else 0 end code, count(*) n from orders group by 1",
    "trans_multivalued": "select valor, count(*) filas from (select unnest(list_distinct(list_transform(string_split(sensores_activos, ','), lambda x: trim(x)))) valor from robots) where valor != '' group by 1",
    "trans_flags": "select " + ", ".join(f"count(*) filter (where list_contains(list_transform(string_split(sensores_activos, ','), lambda x: trim(x)), '{v}')) {v}" for v in ("bateria", "temperatura", "vibracion")) + " from robots",
    "trans_edges": """select 'width' how, i::int i, round(lo + (hi - lo) * i / 5, 6) edge from (select min(bateria_pct) lo, max(bateria_pct) hi from robots), range(6) r(i)
""" + " ".join(f"union all select 'frequency', {i}, round(quantile_cont(bateria_pct, {i / 4}), 6) from robots" for i in range(5)) + """""",
    "trans_binned": "select case when x <= lo + w then 1 when x <= lo + w * 2 then 2 when x <= lo + w * 3 then 3 when x <= lo + w * 4 then 4 else 5 end bin, count(*) n from (select bateria_pct x, min(bateria_pct) over () lo, (max(bateria_pct) over () - min(bateria_pct) over ()) / 5 w from robots) group by 1",
    **{f"trans_groupby_{h}": f"select l_returnflag grupo, round({f}::double, 6) valor from lineitem group by 1 order by 2 desc limit 50" for h, f in {"mean": "avg(l_quantity)", "sum": "sum(l_quantity)", "count": "count(l_quantity)", "min": "min(l_quantity)", "max": "max(l_quantity)", "median": "quantile_cont(l_quantity, 0.5)", "std": "stddev_samp(l_quantity)"}.items()},
    **{f"norm_{h}": f"select c_custkey, round({_scale(h)}, 6) escalado from customer" for h in ("zscore", "minmax", "robust", "decimal")},
    "norm_compare": " union all ".join(f"select '{h}' metodo, round(avg(e), 6) media, round(stddev_samp(e), 6) desv, round(min(e), 6) as min, round(max(e), 6) as max, round(100 * avg((e between 0 and 0.1)::int), 6) pct from (select {_scale(h)} e from customer)" for h in ("zscore", "minmax", "robust", "decimal")),
    "sample_exact": f"select o_orderkey from orders order by {_HASH.format(k='o_orderkey')}, o_orderkey limit 500",
    "sample_strata": f"select o_orderkey from (select o_orderkey, row_number() over (partition by o_orderstatus order by {_HASH.format(k='o_orderkey')}, o_orderkey) i, count(*) over (partition by o_orderstatus) n from orders) where i <= greatest(1, floor(n * 0.1 + 0.5))",
    "balance_under": f"with r as (select o_orderkey, row_number() over (partition by o_orderstatus order by {_HASH.format(k='o_orderkey')}, o_orderkey) i, count(*) over (partition by o_orderstatus) n from orders) select o_orderkey, 0 as copia from r where i <= (select min(n) from r)",
    "balance_over": f"with r as (select o_orderkey, row_number() over (partition by o_orderstatus order by {_HASH.format(k='o_orderkey')}, o_orderkey) i, count(*) over (partition by o_orderstatus) n from orders), g as (select max(n) g from r) select o_orderkey, unnest(range((g - i) // n + 1)) as copia from r, g",
    "split_hash": f"select o_orderkey, case when ('0x' || substr({_HASH.format(k='o_orderkey')}, 1, 8))::bigint < 3435973836 then 'train' else 'test' end parte from orders",
}
SQL["eda_schema"] = " union all ".join(
    "select '{c}' columna, '{t}' tipo, count(distinct {c}) distintos, count(*) - count({c}) nulos, {k} clase from robots".format(
        c=c, t="double" if c in NUM else "int" if c == "failure_next_48h" else "string",
        k="'numeric'" if c in NUM or c == "failure_next_48h" else f"case when count(distinct {c}) <= 50 then 'categorical' else 'text' end")
    for c in _ROBOT_COLUMNS
)


def _filter_sql(c):
    y = "failure_next_48h::double"
    return f"""select '{c}' columna, (select round(abs(corr({c}, {y})), 6) from r) pearson, (select round(var_samp({c}), 6) from r) varianza,
  (select round(sum(pow(o - so * n / sn, 2) / nullif(so * n / sn, 0)), 6) from (select *, sum(o) over () so, sum(n) over () sn from (select {y} y, sum({c} - lo) o, count(*) n from r, (select min({c}) lo from robots) group by 1))) chi2,
  (select round(sum(n / t * ln(n * t / (nb * ny))), 6) from (select *, sum(n) over (partition by b) nb, sum(n) over (partition by y) ny, sum(n) over () t from
    (select least(floor(({c} - lo) / ((hi - lo) / 10)), 9) b, {y} y, count(*)::double n from r, (select min({c}) lo, max({c}) hi from robots) group by 1, 2))) info
from (select 1)""".replace("from r", f"from (select * from robots where {c} is not null and failure_next_48h is not null) r")


SQL["filter_scores"] = " union all ".join(_filter_sql(c) for c in ["bateria_pct", "voltaje_v", "consumo_total_kwh"])
SQL["eda_samples"] = " union all ".join(f"select '{c}' columna, (select string_agg(v, '|' order by v) from (select distinct {c} v from robots where {c} is not null order by 1 limit 5)) ejemplos" for c in _ROBOT_COLUMNS if c not in NUM and c != "failure_next_48h")
SQL["eda_overview"] = f"""select 'tabla' seccion, 'filas' clave, count(*) filas from robots union all select 'tabla', 'columnas', {len(_ROBOT_COLUMNS)} union all select 'clase', clase, count(*) from ({SQL["eda_schema"]}) group by 2
union all select 'objetivo', failure_next_48h::varchar, count(*) from robots group by 2"""


def _cramer_sql(a, b):
    rows = f"(select {a} a, {b} b from robots where {a} is not null and {b} is not null)"
    return f"""select '{a}' a, '{b}' b, v, case when (select count(distinct {a}) from robots) < (select count(distinct {b}) from robots) then '{a}' else '{b}' end sobra from (
  select round(sqrt(greatest(sum(pow(coalesce(o, 0) - ra * rb / t, 2) / (ra * rb / t)), 0) / (any_value(t) * (least(count(distinct x.a), count(distinct y.b)) - 1))), 6) v
  from (select a, count(*)::double ra from {rows} group by 1) x cross join (select b, count(*)::double rb from {rows} group by 1) y cross join (select count(*)::double t from {rows}) t
  left join (select a, b, count(*) o from {rows} group by 1, 2) n on n.a = x.a and n.b = y.b) where v > 0.02"""


SQL["integ_redundant_categories"] = " union all ".join(_cramer_sql(a, b) for i, a in enumerate(CATEGORIES) for b in CATEGORIES[i + 1 :])

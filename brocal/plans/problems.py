"""Queries of the general training-data problems, with their SQL where SQL can say it."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brocal.functions.names import same_name
from brocal.operators import instants as I
from brocal.operators.copies import keep_values, surplus_copies
from brocal.operators.instants import instants, to_normalise
from brocal.operators.late import SEP, high_marks, late_corrections, merged_periods
from brocal.operators.orphans import Reference, unresolved, unresolved_report
from brocal.operators.spikes import implausible


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")



def message() -> list:
    """The identifier of a delivered reading."""
    return [same_name("robot_id"), same_name("sensor"), F.col("ts_evento")]


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "telemetry")
    return implausible(rows, message()[:2], same_name("sensor"), "ts_evento", "valor", "lectura_id", table(spark, sf, "sensor_limits"), {"bateria": 100.0})


def _late(spark: SparkSession, sf: str, emit: str, *values: str) -> DataFrame:
    rows = table(spark, sf, "telemetry")
    kept = keep_values(rows, dict(zip(("robot_id", "sensor", "ts_evento"), message())), "lectura_id", ["lote", *values])
    return late_corrections(kept, [F.col("robot_id"), F.col("sensor")], "ts_evento", "lote", "lectura_id", *values, marks=high_marks(rows, "lote", "ts_evento"), emit=emit)


def _named(parts: DataFrame, *first: str) -> DataFrame:
    """Source columns by name, and sums to six decimals, as the order of addition differs."""
    names = F.split("fuente", SEP)
    rest = [c for c in parts.columns[2:] if c not in first]
    return parts.select(names[0].alias("robot_id"), names[1].alias("sensor"), "inicio_us", *first, *[F.round(c, 6).alias(c) if c.endswith("suma") else F.col(c) for c in rest])


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return _late(spark, sf, "rows")


def p2_periods(spark: SparkSession, sf: str) -> DataFrame:
    return _named(merged_periods(_late(spark, sf, "periods", "valor")), "publicada")


def p2_hours(spark: SparkSession, sf: str) -> DataFrame:
    return _named(_late(spark, sf, "hours", "valor"))


def p1_certain(spark: SparkSession, sf: str) -> DataFrame:
    """The cases of p1_found that need no scatter: impossible and stuck readings."""
    rows = table(spark, sf, "telemetry")
    return implausible(rows, message()[:2], same_name("sensor"), "ts_evento", "valor", "lectura_id", table(spark, sf, "sensor_limits"), {"bateria": 100.0}, excursions=False)


REFERENCES = (
    Reference("likes", "user_id", "users"),
    Reference("likes", "post_id", "posts"),
    Reference("follows", "follower_id", "users"),
    Reference("follows", "following_id", "users"),
)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    names = ("likes", "follows", "users", "posts")
    tables = {n: table(spark, sf, n) for n in names}
    return unresolved({n: tables[n] for n in names[:2]}, {n: tables[n] for n in names[2:]}, REFERENCES)


def p3_report(spark: SparkSession, sf: str) -> DataFrame:
    return unresolved_report(p3_found(spark, sf))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "telemetry").select("lectura_id", "robot_id", "sensor", "ts_evento")
    return surplus_copies(rows, message(), ["lectura_id"], "lectura_id")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    sides = []
    for name in ("posts", "likes"):
        rows = table(spark, sf, name).select(F.lit(name).alias("tabla"), F.col("_id").alias("fila_id"), "created_at", "client_tz", "ingested_at")
        # a filter would be pushed below the projection and evaluate it twice; explode drops the nulls after it
        sides.append(instants(rows.where(to_normalise(rows, "created_at")), "created_at", "client_tz", "ingested_at").select("tabla", "fila_id", F.explode(F.array_compact(F.array("epoch_us"))).alias("epoch_us")))
    return sides[0].unionByName(sides[1])


QUERIES = {"p1_found": p1_found, "p1_certain": p1_certain, "p2_found": p2_found, "p2_periods": p2_periods, "p2_hours": p2_hours, "p3_found": p3_found, "p3_report": p3_report, "p5_found": p5_found, "p6_found": p6_found}

_REFS = " union all ".join(
    f"select '{r.table}' tabla, _id fila_id, '{r.field}' campo, ingested_at, '{r.parent}' padre, lower(trim({r.field}, ' ' || chr(9) || chr(10) || chr(13))) clave from {r.table} where {r.field} is not null"
    for r in REFERENCES
)
_P3 = f"""with refs as ({_REFS}),
known as (select 'users' padre, lower(trim(_id)) clave, ingested_at desde, deleted_at hasta from users
          union all select 'posts', lower(trim(_id)), ingested_at, deleted_at from posts),
judged as (select tabla, fila_id, campo, strftime(r.ingested_at, '%Y-%m') periodo,
             case when k.clave is null then 'missing' when k.hasta <= r.ingested_at then 'deleted' when k.desde > r.ingested_at then 'late' end clase
           from refs r left join known k on r.padre = k.padre and r.clave = k.clave)
"""
_P2 = """with per as (select lote, max(epoch_us(ts_evento)) hasta from telemetry group by 1),
marks as (select lote, max(hasta) over (order by lote rows between unbounded preceding and 1 preceding) marca from per),
kept as (select lectura_id, lower(trim(robot_id)) robot_id, lower(trim(sensor)) sensor, epoch_us(ts_evento) // 300000000 * 300000000 inicio_us, lote,
           case when isnan(valor) then null else valor end valor
         from telemetry qualify row_number() over (partition by lower(trim(robot_id)), lower(trim(sensor)), ts_evento order by lectura_id) = 1),
judged as (select k.*, case when marca >= inicio_us + 1200000000 then 'descartada' when marca >= inicio_us + 420000000 then 'corrige' end destino
           from kept k join marks using (lote))
"""


def _p6_sql() -> str:
    """The notations one by one, with the calendar and the zones of the database."""
    sides = " union all ".join(f"select '{t}' tabla, _id fila_id, trim(created_at, ' ' || chr(9) || chr(10) || chr(13)) t, trim(client_tz) client, epoch_us(ingested_at) llega from {t} where created_at is not null and not regexp_matches(created_at, '{I.CANONICAL}')" for t in ("posts", "likes"))
    read = []
    for name, pattern in I.NOTATIONS.items():
        parts = re.findall(r"\(\?<\w(\w)>", pattern)
        plain = "^(?:" + re.sub(r"\(\?<\w\w>", "(", pattern).replace("'", "''") + ")$"
        fields = ", ".join(f"nullif(r.{p}, '') {p}" if p in parts else f"null::varchar {p}" for p in I.PARTS)
        read.append(f"select tabla, fila_id, client, llega, {fields} from (select *, regexp_extract(t, '{plain}', {parts!r}, 'i') r from src where regexp_matches(t, '{plain}', 'i'))")
    month = "case " + " ".join(f"when lower(w) in ({', '.join(repr(n) for n in names)}) then {m}" for m, names in I.MONTHS.items()) + " else m::int end"
    named = "case upper(a) " + " ".join(f"when '{k}' then {v}" for k, v in I.ABBREVIATIONS.items()) + " end"
    unit = "case lower(u) " + " ".join(f"when '{k}' then {v}" for k, v in I.UNITS.items()) + " end"
    counts = ", ".join(f"{{'far': abs({v} - llega), 'us': {v}}}" for v in (
        "(c::hugeint * 1000000 + case when c like '-%' then -1 else 1 end * rpad(coalesce(k, ''), 6, '0')[:6]::hugeint)", "(c::hugeint * 1000 + case when c like '-%' then -1 else 1 end * rpad(coalesce(k, ''), 6, '0')[:3]::hugeint)", "c::hugeint", "floor(c::hugeint::decimal(38, 3) / 1000)::hugeint"))
    return f"""with src as ({sides}),
parts as ({" union all ".join(read)}),
fields as (select *, try_cast(lpad(y, 4, '0') || '-' || lpad(({month})::varchar, 2, '0') || '-' || lpad(d, 2, '0') as date) dia, n::int minuto, coalesce(s, '0')::int segundo, rpad(coalesce(f, ''), 6, '0')[:6]::bigint frac,
    case when p is null then h::int when h::int between 1 and 12 then h::int % 12 + case lower(p) when 'p' then 12 else 0 end end hora,
    case when o is not null then case when o like '-%' then -1 else 1 end * (o[2:3]::int * 60 + coalesce(nullif(replace(o[4:], ':', ''), ''), '0')::int) else {named} end desfase from parts),
clocks as (select *, epoch_us(dia::timestamp) + ((hora * 60 + minuto) * 60 + segundo)::bigint * 1000000 + frac reloj from fields),
valid as (select *, case when hora between 0 and 23 and minuto between 0 and 59 and segundo between 0 and 59 and coalesce(desfase, 0) between -1080 and 1080 then reloj end clock, zonas.name zona
  from clocks left join pg_timezone_names() zonas on zonas.name = coalesce(z, client, 'UTC') and regexp_matches(zonas.name, '^(?:(?:Africa|America|Antarctica|Asia|Atlantic|Australia|Europe|Indian|Pacific)/[A-Za-z_/-]+|Etc/UTC|UTC|GMT)$')),
placed as (select *, case when desfase is null then epoch_us(timezone(zona, make_timestamp(clock))) end aqui from valid),
told as (select tabla, fila_id, coalesce(clock - desfase::bigint * 60000000,
    case when epoch_us(timezone(zona, make_timestamptz(aqui - 3600000000))) = clock then aqui - 3600000000 else aqui end,
    case when c is not null then (select case when x.far <= {I.NEAR_DAYS * 86_400_000_000} then x.us end from (select list_min([{counts}]) x))::bigint end,
    llega - r::bigint * ({unit}) * 1000000) epoch_us from placed)
select * from told where epoch_us is not null"""


SQL = {
    "p6_found": _p6_sql(),
    "p1_certain": """with delivered as (select lectura_id, coalesce(lower(trim(robot_id)), chr(0)) robot, coalesce(lower(trim(sensor)), chr(0)) sensor, ts_evento, valor from telemetry where valor is not null and ts_evento is not null),
readings as (select * from delivered qualify row_number() over (partition by robot, sensor, ts_evento order by lectura_id) = 1),
steps as (select *, valor is distinct from lag(valor) over w or lag(lectura_id) over w is null starts from readings window w as (partition by robot, sensor order by ts_evento)),
numbered as (select *, sum(starts::int) over (partition by robot, sensor order by ts_evento) run from steps),
sized as (select *, count(*) over (partition by robot, sensor, run) n from numbered),
hit as (select robot, sensor, ts_evento from sized left join sensor_limits l using (sensor)
  where isnan(valor) or valor < min_fisico or valor > max_fisico or (n >= 6 and not (sensor = 'bateria' and valor = 100)))
select lectura_id from delivered join hit using (robot, sensor, ts_evento)""",
    "p2_hours": _P2 + """select robot_id, sensor, inicio_us // 3600000000 * 3600000000 inicio_us,
  count(*) filter (where destino is distinct from 'descartada') final_filas, count(valor) filter (where destino is distinct from 'descartada') final_n,
  round(sum(valor) filter (where destino is distinct from 'descartada'), 6) final_suma, min(valor) filter (where destino is distinct from 'descartada') final_min,
  max(valor) filter (where destino is distinct from 'descartada') final_max, count(*) filter (where destino = 'corrige') corrigen, count(*) filter (where destino = 'descartada') descartadas
from judged group by 1, 2, 3""",
    "p2_found": _P2 + "select lectura_id, destino from judged where destino is not null",
    "p2_periods": _P2 + """, grouped as (select robot_id, sensor, inicio_us, inicio_us + 420000000 <= (select max(hasta) from per) publicada,
  count(*) filter (where destino is null) a, count(valor) filter (where destino is null) b, sum(valor) filter (where destino is null) c,
  min(valor) filter (where destino is null) d, max(valor) filter (where destino is null) e,
  count(*) filter (where destino is distinct from 'descartada') final_filas, count(valor) filter (where destino is distinct from 'descartada') final_n,
  round(sum(valor) filter (where destino is distinct from 'descartada'), 6) final_suma, min(valor) filter (where destino is distinct from 'descartada') final_min,
  max(valor) filter (where destino is distinct from 'descartada') final_max,
  count(*) filter (where destino = 'corrige') corrigen, count(*) filter (where destino = 'descartada') descartadas from judged group by 1, 2, 3)
select robot_id, sensor, inicio_us, publicada, case when publicada then a end primera_filas, case when publicada then b end primera_n,
  case when publicada then round(c, 6) end primera_suma, case when publicada then d end primera_min, case when publicada then e end primera_max,
  final_filas, final_n, final_suma, final_min, final_max, corrigen, descartadas from grouped""",
    "p3_found": _P3 + "select * from judged where clase is not null",
    "p3_report": _P3 + "select tabla, campo, periodo, clase, count(*) as filas from judged where clase is not null group by all",
    "p5_found": """select lectura_id from telemetry
qualify row_number() over (partition by lower(trim(robot_id)), lower(trim(sensor)), ts_evento order by lectura_id) > 1""",
}

"""Made-up dirty tables for tests, from seeded hashes: the same rows in every run, made by the executors at any size.

Each table has `_ruido`, the kinds of dirt of a row, as ground truth.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = datetime(2026, 8, 1)
NAMES = ("Lucía", "Martín", "Sofía", "Hugo", "Inés", "Álvaro", "Noa", "Iván", "Begoña", "Raúl")
TAGS = ("cine", "música", "ciencia", "viajes", "cocina", "deporte", "libros", "historia")
SENTENCES = (
    "La exposición reúne más de cien obras de la colección del museo.", "El equipo publicó los resultados de la campaña de medición.", "Según el archivo, la ciudad creció junto al río durante siglos.",
    "La biblioteca abre también por la mañana en los meses de verano.", "El taller enseña a leer mapas antiguos y a dibujarlos de nuevo.", "Muchos vecinos recuerdan aún la última crecida.", "El autor describe la técnica con ejemplos y pocas fórmulas.",
)


def chance(what: str, *of: Column | str, seed: int = 42) -> Column:
    """A number from 0 to below 1 that depends on the seed, its purpose and the row alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(what), *of), 11) * F.lit(2.0**-53)


def whole(what: str, n: int | Column, *of: Column | str, seed: int = 42) -> Column:
    return F.floor(chance(what, *of, seed=seed) * n).cast("int")


def normal(what: str, *of: Column | str, seed: int = 42) -> Column:
    a, b = chance(what + "/a", *of, seed=seed), chance(what + "/b", *of, seed=seed)
    return F.sqrt(-2 * F.log(1 - a)) * F.cos(2 * 3.141592653589793 * b)


def pick(what: str, values: Sequence, *of: Column | str, seed: int = 42) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), whole(what, len(values), *of, seed=seed))


def garbled(text: Column) -> Column:
    """UTF-8 read as Latin-1."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def in_some_notation(at: Column, *of: Column | str, seed: int = 42) -> Column:
    """A time in one of five notations; relative ones count back from NOW."""
    kind = whole("notation", 5, *of, seed=seed)
    days = F.greatest(F.datediff(F.lit(NOW).cast("timestamp"), at), F.lit(0)).cast("string")
    return (
        F.when(kind == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")).when(kind == 1, F.unix_timestamp(at).cast("string")).when(kind == 2, F.date_format(at, "MM/dd/yyyy hh:mm a"))
        .when(kind == 3, F.date_format(at, "dd-MM-yyyy HH:mm")).otherwise(F.concat(F.lit("hace "), days, F.lit(" días")))
    )


def _dirt(**kinds: Column) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in kinds.items()])).alias("_ruido")


def _id(prefix: str, n: Column) -> Column:
    return F.concat(F.lit(prefix), F.lpad(n.cast("string"), 9, "0"))


def _before(days: int, *of: Column | str, seed: int) -> Column:
    return F.timestamp_seconds(F.unix_timestamp(F.lit(NOW).cast("timestamp")) - whole("age", days * 86_400, *of, seed=seed))


def social(spark: SparkSession, users: int = 3_000, posts: int = 80_000, likes: int = 200_000, follows: int = 50_000, seed: int = 42) -> dict[str, DataFrame]:
    """users, posts, likes, follows: second accounts, missing fields, wrong encodings, names with blanks, spam, orphans, repeats, a burst of one text, self-follows."""
    k = lambda what, share, *of: chance(what, *of, seed=seed) < share
    twice, lack, broken, blank, spam = k("twice", 0.08, "id"), k("lack", 0.04, "id"), k("broken", 0.10, "id"), k("blank", 0.05, "id"), k("spam", 0.05, "id")
    person = F.when(twice & (F.col("id") > 0), whole("who", F.col("id"), "id", seed=seed)).otherwise(F.col("id"))
    shown = F.concat(pick("name", NAMES, person, seed=seed), F.lit(" "), pick("surname", NAMES, person, seed=seed))
    u = spark.range(users).select(
        _id("u_", F.col("id")).alias("_id"), F.concat(F.lit("user"), F.when(blank, " ").otherwise("_"), person.cast("string")).alias("username"), F.when(broken, garbled(shown)).otherwise(shown).alias("display_name"),
        F.when(~lack, F.concat(F.lit("user"), person.cast("string"), F.lit("@sitio.example"))).alias("email"), F.when(spam, "FOLLOW ME for the BEST DEALS").otherwise(F.concat(F.lit("Me gusta "), pick("topic", TAGS, "id", seed=seed))).alias("bio"),
        pick("topic", TAGS, "id", seed=seed).alias("topic"), spam.alias("is_spam"), in_some_notation(_before(900, "id", seed=seed), "id", seed=seed).alias("created_at"), F.lit("seed").alias("origin"),
        _dirt(segunda=twice & (F.col("id") > 0), falta=lack, encoding=broken, blancos=blank, spam=spam),
    )
    ghost, broken, burst = k("ghost", 0.04, "id"), k("broken", 0.08, "id"), F.col("id") % 1000 == 7
    text = F.when(burst, "Mira esto ya mismo").otherwise(F.concat(pick("text", SENTENCES, "id", seed=seed), F.lit(" "), F.col("id").cast("string")))
    tag = pick("tag", TAGS, "id", seed=seed)
    p = spark.range(posts).select(
        _id("p_", F.col("id")).alias("_id"), _id("u_", F.when(burst, 1).when(ghost, users + F.col("id")).otherwise(F.floor(users * F.pow(chance("author", "id", seed=seed), F.lit(2.0))))).alias("user_id"),
        F.when(broken, garbled(text)).otherwise(text).alias("text"), F.array(F.when(k("loud", 0.3, "id"), F.concat(F.lit("#"), F.initcap(tag), F.lit("."))).otherwise(tag)).alias("hashtags"),
        in_some_notation(_before(300, "id", seed=seed), "id", seed=seed).alias("created_at"), F.lit(0).cast("bigint").alias("likes_count"), F.lit("seed").alias("origin"), _dirt(huerfano=ghost & ~burst, encoding=broken, rafaga=burst),
    )
    again, ghost = k("again", 0.02, "id") & (F.col("id") > 0), k("ghost", 0.03, "id")
    of = F.when(again, F.col("id") - 1).otherwise(F.col("id"))
    like = spark.range(likes).select(
        _id("l_", F.col("id")).alias("_id"), _id("u_", whole("user", users, of, seed=seed)).alias("user_id"), _id("p_", whole("post", posts, of, seed=seed) + F.when(ghost, posts).otherwise(0)).alias("post_id"),
        in_some_notation(_before(200, "id", seed=seed), "id", seed=seed).alias("created_at"), F.lit("seed").alias("origin"), _dirt(repetido=again, huerfano=ghost),
    )
    own, ghost = k("own", 0.02, "id"), k("ghost", 0.03, "id")
    one = whole("from", users, "id", seed=seed)
    f = spark.range(follows).select(
        _id("f_", F.col("id")).alias("_id"), _id("u_", one).alias("follower_id"), _id("u_", F.when(own, one).when(ghost, users + one).otherwise(whole("to", users, "id", seed=seed))).alias("following_id"),
        in_some_notation(_before(200, "id", seed=seed), "id", seed=seed).alias("created_at"), F.lit("seed").alias("origin"), _dirt(propio=own, fantasma=ghost & ~own),
    )
    return {"users": u, "posts": p, "likes": like, "follows": f}


def fleet(spark: SparkSession, robots: int = 2_060, readings: int = 98_000, events: int = 9_000, maintenances: int = 3_000, seed: int = 1234) -> dict[str, DataFrame]:
    """robots, sensors_readings, events, maintenances: values missing by chance, by another column and by their own size; columns that follow the battery."""
    r = spark.range(robots).withColumns({
        "bateria_pct": F.round(20 + 80 * chance("battery", "id", seed=seed), 2), "salud": F.round(1 - 0.6 * F.pow(chance("health", "id", seed=seed), F.lit(2.0)), 4), "consumo": F.round(2 + F.abs(normal("power", "id", seed=seed)), 3),
    })
    worn = F.col("salud") < 0.7
    lack_chance, lack_other, lack_own = chance("mcar", "id", seed=seed) < 0.1, (F.col("id") % 5 == 0) & (chance("mar", "id", seed=seed) < 0.5), worn & (chance("mnar", "id", seed=seed) < 0.3)
    r = r.select(
        F.concat(F.lit("RBT-"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("id"), pick("model", ("Alfa", "Beta-2", "Gamma XL"), "id", seed=seed).alias("modelo"), F.when(chance("maker", "id", seed=seed) > 0.05, pick("maker", ("Norte", "Sur"), "id", seed=seed)).alias("fabricante"),
        in_some_notation(_before(1500, "id", seed=seed), "id", seed=seed).alias("fecha_alta"), pick("store", ("Rotterdam", "Malmo", "Vigo"), "id", seed=seed).alias("almacen"), F.when(chance("zone", "id", seed=seed) > 0.1, pick("zone", ("A", "B", "C"), "id", seed=seed)).alias("zona"),
        F.concat((1 + F.col("id") % 4).cast("string"), F.lit(".0")).alias("firmware_version"), F.array_join(F.slice(F.array(*[F.lit(x) for x in ("temperatura", "bateria", "vibracion")]), 1, 1 + whole("sensors", 3, "id", seed=seed)), ",").alias("sensores_activos"),
        F.when(~(lack_chance | lack_own), F.col("salud")).alias("battery_health_v2"), F.when(~lack_other, F.col("consumo")).alias("consumo_kw"), "bateria_pct", F.round(0.4 * F.col("bateria_pct") + 1.99 * chance("volt", "id", seed=seed) - 0.995, 3).alias("voltaje_v"),
        F.round(0.08 * F.col("bateria_pct") + 0.59 * chance("kwh", "id", seed=seed) - 0.295, 3).alias("consumo_total_kwh"), (chance("fail", "id", seed=seed) < F.when(worn, 0.7).when(F.col("bateria_pct") < 30, 0.4).otherwise(0.05)).cast("int").alias("failure_next_48h"), _dirt(azar=lack_chance, otra=lack_other, propia=lack_own),
    )
    robot = lambda what: F.concat(F.lit("RBT-"), F.lpad(whole(what, robots, "id", seed=seed).cast("string"), 4, "0"))
    absurd = chance("absurd", "id", seed=seed) < 0.005
    s = spark.range(readings).select(
        robot("r").alias("robot_id"), in_some_notation(_before(30, "id", seed=seed), "id", seed=seed).alias("timestamp"), pick("kind", ("temperatura", "bateria", "vibracion"), "id", seed=seed).alias("sensor_type"), F.when(chance("null", "id", seed=seed) > 0.03, F.round(40 + 10 * normal("v", "id", seed=seed), 3)).alias("valor"),
        F.round(20 + 80 * chance("b", "id", seed=seed), 2).alias("bateria_pct"), F.when(absurd, 1000.0).otherwise(F.round(40 + 12 * normal("t", "id", seed=seed), 2)).alias("temperatura"), _dirt(absurdo=absurd),
    )
    e = spark.range(events).select(robot("re").alias("robot_id"), in_some_notation(_before(60, "id", seed=seed), "id", seed=seed).alias("timestamp"), pick("etype", ("parada", "choque", "aviso"), "id", seed=seed).alias("tipo"), pick("sev", ("baja", "media", "alta", "crítica"), "id", seed=seed).alias("severidad"), F.lit("sin detalle").alias("descripcion"), pick("tech", NAMES, "id", seed=seed).alias("tecnico"), _dirt())
    m = spark.range(maintenances).select(robot("rm").alias("robot_id"), in_some_notation(_before(400, "id", seed=seed), "id", seed=seed).alias("fecha"), pick("mtype", ("revisión", "batería", "rueda"), "id", seed=seed).alias("tipo"), F.round(0.5 + 6 * chance("h", "id", seed=seed), 2).alias("duracion_horas"), pick("tech", NAMES, "id", seed=seed).alias("tecnico"), F.round(50 + 400 * chance("c", "id", seed=seed), 2).alias("coste_euros"), _dirt())
    return {"robots": r, "sensors_readings": s, "events": e, "maintenances": m}


#: Kinds of noise of a corpus, with their share of the documents.
NOISE = {"exact_dup": 0.04, "near_dup": 0.05, "html_residual": 0.1, "boilerplate": 0.1, "wrong_lang": 0.05, "broken_encoding": 0.07, "pii": 0.08, "gibberish": 0.03, "too_short": 0.04, "too_long": 0.01}


def corpus(spark: SparkSession, documents: int = 5_450, seed: int = 42) -> DataFrame:
    """id, title, text, lang_declared, source, char_count, `_ruido`: articles with at most one kind of NOISE each; copies are of the document before."""
    draw, kinds = chance("noise", "id", seed=seed), {}
    # of four documents the first two may be noisy, the third is clean, and the fourth may be a copy of it
    for places, names in (((3,), ("exact_dup", "near_dup")), ((0, 1), [k for k in NOISE if not k.endswith("_dup")])):
        upto = 0.0
        for name in names:
            share = NOISE[name] * 4 / len(places)
            kinds[name] = (F.col("id") % 4).isin(*places) & (draw >= upto) & (draw < upto + share)
            upto += share
    copy = kinds["exact_dup"] | kinds["near_dup"]
    of = F.when(copy, F.col("id") - 1).otherwise(F.col("id"))
    sentences = F.array(*[pick(f"sentence/{i}", SENTENCES, of, seed=seed) for i in range(26)])
    base = F.concat(F.lit("Artículo "), of.cast("string"), F.lit(". "), F.array_join(F.slice(sentences, F.lit(1), 6 + whole("n", 20, of, seed=seed)), " "))
    text = (
        F.when(kinds["near_dup"], F.concat(base, F.lit(" Fin."))).when(kinds["html_residual"], F.concat(F.lit("<p>[[Museo|El museo]] <b>"), base, F.lit("</b><ref>nota</ref></p>"))).when(kinds["boilerplate"], F.concat(base, F.lit("\n== Referencias ==\nCategorías: arte")))
        .when(kinds["wrong_lang"], F.repeat(F.lit("The museum is open to all of the visitors in this town and that is for the best. "), 4)).when(kinds["broken_encoding"], garbled(base)).when(kinds["pii"], F.concat(base, F.lit(" Escriba a ana"), of.cast("string"), F.lit("@sitio.example o llame al +34 600 111 222.")))
        .when(kinds["gibberish"], F.repeat(F.md5(of.cast("string")), 8)).when(kinds["too_short"], F.lit("Nota breve.")).when(kinds["too_long"], F.repeat(base, 20)).otherwise(base)
    )
    return spark.range(documents).select(
        F.col("id").cast("string").alias("id"), F.concat(F.lit("Artículo "), of.cast("string")).alias("title"), text.alias("text"), F.lit("es").alias("lang_declared"), pick("source", ("wiki", "prensa", "foro"), "id", seed=seed).alias("source"), F.length(text).cast("bigint").alias("char_count"),
        _dirt(**kinds),
    )


@dataclass
class Fleet:
    """A fleet that sends a reading per sensor and minute: what goes wrong with it."""

    robots: int = 40
    minutes: int = 30
    seed: int = 42
    start: datetime = datetime(2026, 8, 9, 10, 0)
    stores: tuple[str, ...] = ("Malmo", "Vigo", "Rotterdam")
    #: Its readings come a minute late, and not at all during an outage (first minute, end): then they come at its end.
    slow: str = "Rotterdam"
    outage: tuple[int, int] = (5, 9)
    #: Robots that go silent at a minute, whose sensor is absurd, whose clock is off by minutes, that overheat from half-time on.
    silent: dict[int, int] = field(default_factory=lambda: {17: 12, 19: 20})
    absurd: tuple[int, ...] = (3,)
    drift: dict[int, int] = field(default_factory=lambda: {8: -4})
    hot: tuple[int, ...] = (0, 11)
    again: float = 0.04
    empty: float = 0.02


def arrival(minute: Column, slow: Column, outage: tuple[int, int], batches: int) -> Column:
    """The batch in which a reading of a minute arrives: at once from most stores; from a slow one a minute later, or at the end of an outage; null after the last batch."""
    at = F.when(slow & (minute >= outage[0]) & (minute < outage[1]), F.lit(outage[1])).when(slow, minute + 1).otherwise(minute)
    return F.when(at < batches, at.cast("int"))


def _among(column: Column, values: dict[int, int]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[column] if values else F.lit(None).cast("int")


def telemetry(spark: SparkSession, f: Fleet) -> DataFrame:
    """robot_id, almacen, sensor, valor, ts_evento (text), intento, minuto, lote (null: never arrives)."""
    r = spark.range(f.robots * f.minutes * 3).select((F.col("id") % f.robots).cast("int").alias("r"), F.floor(F.col("id") / f.robots / 3).cast("int").alias("m"), F.pmod(F.floor(F.col("id") / f.robots), F.lit(3)).cast("int").alias("s"))
    r = r.where(F.coalesce(F.col("m") < _among(F.col("r"), f.silent), F.lit(True)))
    of = ("r", "m", "s")
    store = F.get(F.array(*[F.lit(x) for x in f.stores]), F.col("r") % len(f.stores))
    heat = 55 + 2 * normal("t", *of, seed=f.seed) + F.when(F.col("r").isin(*f.hot) & (F.col("m") >= f.minutes // 2), 25).otherwise(0)
    value = F.when(F.col("s") == 0, F.when(F.col("r").isin(*f.absurd), 1000.0).otherwise(heat)).when(F.col("s") == 1, 100 - 0.5 * F.col("m")).otherwise(F.abs(normal("v", *of, seed=f.seed)))
    clock = F.timestamp_seconds(F.unix_timestamp(F.lit(f.start).cast("timestamp")) + (F.col("m") + F.coalesce(_among(F.col("r"), f.drift), F.lit(0))) * 60 + whole("second", 60, *of, seed=f.seed))
    once = r.select(
        F.concat(F.lit("RBT-"), F.lpad(F.col("r").cast("string"), 4, "0")).alias("robot_id"), store.alias("almacen"), F.get(F.array(*[F.lit(x) for x in ("temperatura", "bateria", "vibracion")]), F.col("s")).alias("sensor"),
        F.when(chance("empty", *of, seed=f.seed) >= f.empty, F.round(value, 2)).alias("valor"), F.date_format(clock, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts_evento"), F.col("m").alias("minuto"), arrival(F.col("m"), store == f.slow, f.outage, f.minutes).alias("lote"), (chance("again", *of, seed=f.seed) < f.again).alias("__again"),
    )
    copies = once.where("__again").select(*[c for c in once.columns if c not in ("lote", "__again")], F.when(F.col("lote") + 1 < f.minutes, F.col("lote") + 1).alias("lote"), F.lit(2).alias("intento"))
    return once.drop("__again").withColumn("intento", F.lit(1)).unionByName(copies.where("lote is not null"))


def emit(spark: SparkSession, folder: str, f: Fleet | None = None) -> dict:
    """Write lote-NNNN.json, a file a minute, and _emision.json with what is true of them.  For a folder of this machine: a mailbox for tests."""
    f = f or Fleet()
    rows = telemetry(spark, f).cache()
    path = Path(folder)
    path.mkdir(parents=True, exist_ok=True)
    boxes: dict[int, list[str]] = {m: [] for m in range(f.minutes)}
    for r in rows.where("lote is not null").orderBy("lote", F.xxhash64("robot_id", "sensor", "ts_evento", "intento")).toLocalIterator():
        boxes[r["lote"]].append(json.dumps({k: r[k] for k in ("robot_id", "almacen", "sensor", "valor", "ts_evento", "intento")}))
    for m, lines in boxes.items():
        (path / f"lote-{m:04d}.json").write_text("".join(x + "\n" for x in lines))
    first = F.col("intento") == 1
    t = rows.agg(F.count_if(F.col("lote").isNotNull()).alias("lecturas"), F.count_if(first & (F.col("lote") > F.col("minuto"))).alias("tarde"), F.count_if(~first).alias("copias"), F.count_if(F.col("lote").isNull()).alias("nunca")).first().asDict()
    truth = t | {"silenciosos": sorted(f"RBT-{r:04d}" for r in f.silent), "calientes": sorted(f"RBT-{r:04d}" for r in f.hot), "absurdos": sorted(f"RBT-{r:04d}" for r in f.absurd), "inicio": (f.start + timedelta()).isoformat()}
    (path / "_emision.json").write_text(json.dumps(truth))
    rows.unpersist()
    return truth

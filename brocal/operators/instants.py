"""Timestamps in many notations, precisions and zones, brought to one UTC instant."""

from __future__ import annotations

import re
import zoneinfo
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brocal.functions.names import BLANKS

#: Month names by number: Spanish, English and Portuguese, short and whole.
MONTHS: dict[int, tuple[str, ...]] = {
    1: ("ene", "enero", "jan", "january", "janeiro"),
    2: ("feb", "febrero", "february", "fev", "fevereiro"),
    3: ("mar", "marzo", "march", "março"),
    4: ("abr", "abril", "apr", "april"),
    5: ("may", "mayo", "mai", "maio"),
    6: ("jun", "junio", "june", "junho"),
    7: ("jul", "julio", "july", "julho"),
    8: ("ago", "agosto", "aug", "august"),
    9: ("sep", "sept", "septiembre", "setiembre", "september", "set", "setembro"),
    10: ("oct", "octubre", "october", "out", "outubro"),
    11: ("nov", "noviembre", "november", "novembro"),
    12: ("dic", "diciembre", "dec", "december", "dez", "dezembro"),
}
#: Zone abbreviations with their offset in minutes.
ABBREVIATIONS: dict[str, int] = {"Z": 0, "UTC": 0, "GMT": 0, "CET": 60, "CEST": 120}
#: Seconds of the units in "hace 3 horas"; a day is 24 hours.
UNITS: dict[str, int] = {"segundo": 1, "minuto": 60, "hora": 3600, "día": 86400, "dia": 86400, "semana": 604800}
#: Microseconds of the units in which a pure number may count.
COUNTS: tuple[tuple[str, int, int], ...] = (("s", 1_000_000, 1), ("ms", 1_000, 1), ("us", 1, 1), ("ns", 1, 1_000))
#: A pure number is an instant only if one of the units puts it this near to the arrival.
NEAR_DAYS = 3660
#: How the instants that need no work are written.
CANONICAL = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{6}Z$"

_MONTH = "|".join(sorted((re.escape(n) for names in MONTHS.values() for n in names), key=len, reverse=True))
_WEEKDAY = r"\p{L}{3,9}\.?,[ ]+"
_CLOCK = r"(?<{p}h>\d\d?):(?<{p}n>\d\d)(?::(?<{p}s>\d\d)(?:[.,](?<{p}f>\d{{1,12}}))?)?"
_ZONE = r"(?:[ ]?(?<{p}o>[+-]\d\d(?::?[0-5]\d)?)(?:\[[A-Za-z0-9_+/-]+\])?|[ ]?(?<{p}a>Z|UTC|GMT|CEST|CET)|[ ]?\[(?<{p}z>[A-Za-z0-9_+/-]+)\])?"

#: The one alternation.  Groups are named <notation><part>; parts: y year, m month, w month name, d day,
#: h hour, n minute, s second, f fraction, p am or pm, o offset, a abbreviation, z zone,
#: c count since 1970 with k its decimals, r how many units ago with u the unit.
NOTATIONS: dict[str, str] = {
    "A": r"(?<Ay>\d{4})-(?<Am>\d\d)-(?<Ad>\d\d)[Tt ]" + _CLOCK.format(p="A") + _ZONE.format(p="A"),
    "B": r"(?<By>\d{4})(?<Bm>\d\d)(?<Bd>\d\d)T(?<Bh>\d\d)(?<Bn>\d\d)(?:(?<Bs>\d\d)(?:[.,](?<Bf>\d{1,12}))?)?" + _ZONE.format(p="B"),
    "C": r"(?<Cm>\d\d?)/(?<Cd>\d\d?)/(?<Cy>\d{4})[ ]+" + _CLOCK.format(p="C") + r"(?:[ ]?(?<Cp>[AaPp])\.?[Mm]\.?)?" + _ZONE.format(p="C"),
    "D": r"(?<Dd>\d\d?)-(?<Dm>\d\d?)-(?<Dy>\d{4})[ ]+" + _CLOCK.format(p="D") + _ZONE.format(p="D"),
    "E": rf"(?:{_WEEKDAY})?(?<Ed>\d\d?)[ ]+(?:de[ ]+)?(?<Ew>{_MONTH})\.?[ ]+(?:de[ ]+)?(?<Ey>\d{{4}}),?[ ]+" + _CLOCK.format(p="E") + _ZONE.format(p="E"),
    "F": r"(?<Fc>-?\d{1,19})(?:\.(?<Fk>\d{1,12}))?",
    "G": rf"hace[ ]+(?<Gr>\d{{1,6}})[ ]+(?<Gu>{'|'.join(UNITS)})s?",
}
PARTS = "ymwdhnsfpoazckru"
ALTERNATION = "(?iu)^(?:" + "|".join(NOTATIONS.values()) + ")$"
_SPLIT = "\x1f"


@cache
def zones() -> tuple[str, ...]:
    """Zone names that both Python's and Java's copy of the tz database have under one name."""
    return tuple(sorted(z for z in zoneinfo.available_timezones() if re.fullmatch(r"(?:Africa|America|Antarctica|Asia|Atlantic|Australia|Europe|Indian|Pacific)/[A-Za-z_/-]+", z)) + ["Etc/UTC", "UTC", "GMT"])



def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a Gregorian date, by integer arithmetic (years from 0)."""
    z = y - F.when(m <= 2, 1).otherwise(0)
    era = F.floor(z / 400)
    yoe = z - era * 400
    doy = F.floor((153 * (m + F.when(m > 2, -3).otherwise(9)) + 2) / 5) + d - 1
    doe = yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy
    return era * 146097 + doe - 719468


def month_length(y: Column, m: Column) -> Column:
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    return F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)


def instants(df: DataFrame, text: str, zone: str | None, arrived: str | None, out: str = "epoch_us") -> DataFrame:
    """`df` with `out`: the instant that `text` states, in microseconds since 1970-01-01 UTC, or null.

    All notations are one regular expression with named groups.  One pass over
    each text replaces it by its components; they are then numbers, checked
    against the calendar, and the instant is put together by integer day
    arithmetic.  No Python, no shuffle, one row out per row in.

    A clock time without offset or zone is in `zone` (a column), or UTC where
    that is null.  One that occurs twice means the earlier instant; one that
    is skipped is read with the offset before the change.  Pure numbers count
    in the unit that puts them nearest to `arrived` and within NEAR_DAYS of
    it; relative times count back from it.  Missing seconds are zero; digits
    after microseconds are cut; blanks at both ends are ignored.

    Null results: null or empty text, text in no notation, fields out of range
    (month 13, February 30, 24:00, second 60, 13 pm, offsets over 18 hours),
    a zone that is not in the tz database, numbers and relative times where
    `arrived` is null.  Texts may be of any length: the alternation is anchored
    and has no nested repetition, so one that fits nothing fails at the first
    character that doesn't.  Other columns of `df`, whatever their names, stay
    as they are; a column named `out` is replaced.
    """
    raw = F.trim(df[text], F.lit(BLANKS))
    packed = _SPLIT.join("".join(f"${{{n}{p}}}" for n in NOTATIONS if f"(?<{n}{p}>" in NOTATIONS[n]) for p in PARTS)
    fields = F.split(F.when(~F.contains(raw, F.lit(_SPLIT)), F.regexp_replace(raw, F.lit(ALTERNATION), F.lit(packed))), _SPLIT)
    own = [F.col(f"`{c}`") for c in df.columns if c != out]
    zone_text = F.trim(df[zone], F.lit(BLANKS)) if zone else F.lit(None).cast("string")
    into = F.unix_micros(df[arrived].cast("timestamp")) if arrived else F.lit(None).cast("bigint")
    work = df.select(*own, fields.alias("__bx_p"), zone_text.alias("__bx_zone"), into.alias("__bx_in"))
    # text in no notation stays one piece: its parts are null; parts that a notation lacks are empty
    work = work.select(*own, "__bx_zone", "__bx_in", *[F.get("__bx_p", F.lit(PARTS.index(p))).alias(f"__bx_{p}") for p in PARTS[1:]], F.when(F.size("__bx_p") > 1, F.get("__bx_p", F.lit(0))).alias("__bx_y"))
    part = {p: F.col(f"__bx_{p}") for p in PARTS}
    # parts are digits or empty; a cast of empty text, even try_cast, goes through an exception
    digits = lambda c, kind: F.nullif(c, F.lit("")).cast(kind)
    num = {p: digits(part[p], "bigint") for p in "ymdhnsr"}
    months = F.create_map(*[F.lit(x) for m, names in MONTHS.items() for n in names for x in (n, m)])
    named = F.create_map(*[F.lit(x) for k, v in ABBREVIATIONS.items() for x in (k, v)])
    units = F.create_map(*[F.lit(x) for k, v in UNITS.items() for x in (k, v)])
    month = F.when(part["w"] == "", num["m"]).otherwise(months[F.lower(part["w"])].cast("bigint"))
    hour = F.when(part["p"] == "", num["h"]).when(num["h"].between(1, 12), num["h"] % 12 + F.when(F.lower(part["p"]) == "p", 12).otherwise(0))
    minutes = digits(F.substring(part["o"], 2, 2), "int") * 60 + F.coalesce(digits(F.replace(F.substring(part["o"], 4, 3), F.lit(":"), F.lit("")), "int"), F.lit(0))
    offset = F.when(part["o"] != "", F.when(part["o"].startswith("-"), -minutes).otherwise(minutes)).when(part["a"] != "", named[F.upper(part["a"])])
    work = work.select(
        *own, "__bx_in",
        num["y"].alias("__bx_y"), month.alias("__bx_m"), num["d"].alias("__bx_d"), hour.alias("__bx_h"), num["n"].alias("__bx_n"),
        F.coalesce(num["s"], F.lit(0)).alias("__bx_s"), F.substring(F.rpad(part["f"], 6, "0"), 1, 6).cast("bigint").alias("__bx_f"),
        offset.cast("bigint").alias("__bx_off"),
        F.when(part["z"] != "", part["z"]).otherwise(F.coalesce("__bx_zone", F.lit("UTC"))).alias("__bx_tz"),
        digits(part["c"], "decimal(19,0)").alias("__bx_c"), F.rpad(part["k"], 6, "0").alias("__bx_k"),
        (num["r"] * units[F.lower(part["u"])].cast("bigint") * 1_000_000).alias("__bx_ago"),
    )
    days = days_from_civil(F.col("__bx_y"), F.col("__bx_m"), F.col("__bx_d"))
    valid = (
        (F.col("__bx_y") >= 1) & F.col("__bx_m").between(1, 12) & F.col("__bx_d").between(1, 31) & (F.col("__bx_d") <= month_length(F.col("__bx_y"), F.col("__bx_m")))
        & F.col("__bx_h").between(0, 23) & F.col("__bx_n").between(0, 59) & F.col("__bx_s").between(0, 59)
        & (F.col("__bx_off").isNull() | F.col("__bx_off").between(-1080, 1080))
    )
    clock = F.when(valid, ((days * 24 + F.col("__bx_h")) * 60 + F.col("__bx_n")) * 60_000_000 + F.col("__bx_s") * 1_000_000 + F.col("__bx_f")).cast("bigint")
    work = work.withColumn("__bx_clock", clock)
    zoned = F.when(F.col("__bx_tz").isin(*zones()), F.col("__bx_tz"))
    there = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros("__bx_clock"), zoned))
    local = F.when(F.col("__bx_off").isNotNull(), F.col("__bx_clock") - F.col("__bx_off") * 60_000_000).when(F.col("__bx_clock").isNotNull(), there)

    def counted(us: int, per: int) -> Column:
        # decimals count as far as they reach microseconds; digits after are cut
        whole = F.col("__bx_c") * us
        more = F.substring("__bx_k", 1, {1_000_000: 6, 1_000: 3}.get(us, 0)).cast("bigint") if per == 1 and us > 1 else F.lit(0)
        value = F.floor(whole / per) if per > 1 else F.when(F.col("__bx_c") < 0, whole - more).otherwise(whole + more)
        return value.cast("decimal(38,0)")

    options = [F.struct(F.abs(counted(us, per) - F.col("__bx_in")).alias("far"), counted(us, per).alias("us")) for _, us, per in COUNTS]
    best = F.col("__bx_best")
    work = work.withColumn("__bx_best", F.when(F.col("__bx_c").isNotNull() & F.col("__bx_in").isNotNull(), F.array_min(F.array(*options))))
    count = F.when(best["far"] <= NEAR_DAYS * 86_400_000_000, best["us"]).cast("bigint")
    done = work.withColumn("__bx_at", F.coalesce(local, count, F.col("__bx_in") - F.col("__bx_ago")))
    return done.select(*own, F.col("__bx_at").alias(out))


def to_normalise(df: DataFrame, text: str) -> Column:
    """Whether the text is not already written in the one unambiguous form."""
    return df[text].isNotNull() & ~df[text].rlike(CANONICAL)

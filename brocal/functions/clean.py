"""Column functions that clean dirty social and corpus fields; all of them stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Broken sequences of the social fields and what they stand for (fixed values).
BROKEN_SOCIAL = {"Ã¡": "á", "Ã©": "é", "Ã\xad": "í", "Ã³": "ó", "Ãº": "ú", "Ã±": "ñ", "Ã¼": "ü", "Ã\x81": "Á", "Ã\x89": "É"}
#: Those of the corpus (fixed values).
BROKEN_CORPUS = {"Ã¡": "á", "Ã©": "é", "Ã\xad": "í", "Ã³": "ó", "Ãº": "ú", "Ã±": "ñ", "Ã¼": "ü", "Â¿": "¿", "Â¡": "¡"}
#: Words whose number tells Spanish from English (fixed values).
STOP_ES = ("el", "la", "los", "de", "que", "en", "y", "a", "con", "por", "para")
STOP_EN = ("the", "of", "and", "to", "in", "is", "that", "for", "with", "this")
#: Where the furniture at the end of an article begins (fixed values).
BOILERPLATE = ("== Véase también ==", "== Referencias ==", "== Enlaces externos ==", "Categorías:")
#: Personal data that is redacted (fixed values).
EMAIL = r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b"
PHONE = r"\+?\d[\d\s]{7,}\d"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_when(text: Column | str, now: Column) -> Column:
    """A timestamp in one of five notations, tried in order; null for any other.

    Seconds since 1970 (10 digits or more), ISO 8601 (with offset, Z or none,
    which means UTC), MM/dd/yyyy hh:mm AM, dd-MM-yyyy HH:mm, and "hace N días"
    or "hace N horas" before `now`.
    """
    t = F.trim(_col(text))
    iso = F.regexp_replace(F.regexp_replace(t, "^(\\d{4}-\\d\\d-\\d\\d)[T ]", "$1 "), "(\\d\\d)(\\d\\d)$", "$1:$2")
    iso = F.when(t.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(\.\d{1,6})?([+-]\d\d:?\d\d|Z)?$"), F.when(t.rlike(r"[+-]\d{4}$"), iso).otherwise(F.regexp_replace(t, "^(\\d{4}-\\d\\d-\\d\\d)[T ]", "$1 ")))
    n = F.regexp_extract(t, r"^hace (\d+) (?:días?|horas?)", 1).try_cast("int")
    hours = F.when(t.rlike(r"^hace \d+ días?"), n * 24).when(t.rlike(r"^hace \d+ horas?"), n)
    return F.coalesce(
        F.when(t.rlike(r"^\d{10,11}$"), F.timestamp_seconds(t.try_cast("bigint"))),
        iso.try_cast("timestamp"),
        F.when(t.rlike(r"^\d\d/\d\d/\d{4} \d\d:\d\d (AM|PM)$"), F.try_to_timestamp(t, F.lit("MM/dd/yyyy hh:mm a"))),
        F.when(t.rlike(r"^\d\d-\d\d-\d{4} \d\d:\d\d$"), F.try_to_timestamp(t, F.lit("dd-MM-yyyy HH:mm"))),
        now - F.make_dt_interval(hours=hours),
    )


def timestamp_notation(text: Column | str) -> Column:
    """Which of the notations a timestamp is written in."""
    t = F.trim(_col(text))
    return (
        F.when(t.rlike(r"^\d{10,}$"), "epoch").when(t.rlike(r"^\d{4}-\d\d-\d\d"), "iso").when(t.rlike(r"^\d\d/\d\d/\d{4}"), "us")
        .when(t.rlike(r"^\d\d-\d\d-\d{4}"), "eu").when(F.lower(t).startswith("hace "), "relative").otherwise("other")
    )


def fix_encoding(text: Column | str, broken: dict[str, str] = BROKEN_SOCIAL) -> Column:
    """Each broken sequence replaced, in order."""
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), broken.items(), _col(text))


def normal_hashtags(tags: Column | str) -> Column:
    """Lower case, without # in front, stops behind and blanks; longer than one character; each once, in order. Null gives an empty list."""
    tags = _col(tags)
    one = lambda t: F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.trim(t), "^#+", ""), "\\.+$", "")))
    return F.coalesce(F.array_sort(F.array_distinct(F.filter(F.transform(tags, one), lambda t: F.length(t) > 1))), F.array().cast("array<string>"))


def normal_username(name: Column | str) -> Column:
    return F.lower(F.regexp_replace(_col(name), r"\s+", "_"))


def tags_in(text: Column | str) -> Column:
    """Hashtags in a text, lower case, each once, in order."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(_col(text), F.lit(r"#([\p{L}\p{N}_]+)"), 1), F.lower)))


def mentions_in(text: Column | str) -> Column:
    """Mentioned names in a text, lower case, each once, in order."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(_col(text), F.lit(r"@([\p{L}\p{N}_]+)"), 1), F.lower)))


def strip(text: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(_col(text), r"^\s+|\s+$", "")


#: Markup to remove, in this order, and what stays of it (fixed values).
MARKUP = (
    (r"(?s)<ref[^>/]*>.*?</ref>", ""),
    (r"<ref[^>]*/>", ""),
    (r"(?s)\{\{.*?\}\}", ""),
    (r"\[\[[^\]|]+\|([^\]]+)\]\]", "$1"),
    (r"\[\[([^\]]+)\]\]", "$1"),
    (r"(?s)<!--.*?-->", ""),
    (r"<[^>]+>", ""),
)


def strip_html(text: Column | str) -> Column:
    """Without references, templates, comments, tags and the furniture at the end; links keep their text; at most one empty line in a row."""
    t = reduce(lambda c, m: F.regexp_replace(c, *m), MARKUP, _col(text))
    t = F.regexp_replace(t, "(?s)(?:" + "|".join(BOILERPLATE) + ").*", "")
    return F.regexp_replace(t, r"\n{3,}", "\n\n")


def redact(text: Column | str) -> Column:
    """E-mail addresses and telephone numbers replaced by their kind."""
    return F.regexp_replace(F.regexp_replace(_col(text), EMAIL, "[EMAIL]"), PHONE, "[TELEFONO]")


def redactions(text: Column | str) -> Column:
    once = F.regexp_replace(_col(text), EMAIL, "[EMAIL]")
    return F.regexp_count(_col(text), F.lit(EMAIL)) + F.regexp_count(once, F.lit(PHONE))


def _votes(text: Column, stop: tuple[str, ...]) -> Column:
    return F.regexp_count(F.lower(text), F.lit(r"(?<![\p{L}\p{N}_])(?:" + "|".join(stop) + r")(?![\p{L}\p{N}_])"))


def voted_language(text: Column | str) -> Column:
    """es or en by which of their stop words are more; es on a tie."""
    text = _col(text)
    return F.when(_votes(text, STOP_EN) > _votes(text, STOP_ES), "en").otherwise("es")


def spam_rule(flag: Column | str, bio: Column | str) -> Column:
    """Flagged, or a bio that shouts the usual phrases; never null."""
    up = F.upper(_col(bio))
    return F.when(_col(flag), True).when(up.contains("FOLLOW ME") | up.contains("BEST DEALS"), True).otherwise(False)

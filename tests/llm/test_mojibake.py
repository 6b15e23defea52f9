import random

import pytest

from brocal.llm.mojibake import SUSPECT, garbled, segments

CLEAN = [
    "Mañana presento la exposición de música y quedó mejor de lo que esperaba.", "¿Habéis visto el último número? ¡Increíble!", "Ayer terminé el artículo sobre álgebra con café y mucha ilusión.",
    "NÃO PERCAM A SESSÃO DE cine EM SÃO MARTINHO", "FÃ DE cine E DE PÃO", "Ångström, ±5 °C y ½ taza", "Nadie me avisó de la colección. ¿Qué os parece? …", "Ingeniería, senderismo y montaña", "Begoña Zubiñaga", "Nothing beats a quiet evening of music.",
    "┌──────┐ cartel de cine └──────┘", "Привет из клуба, увидимся завтра", "50 ¢ la copia, 3 £ el póster, 200 ¥ el sello", "¿? ¡! ¿alguien sabe algo de cine?", "https://sitio.example/ver?n=1&m=2 é",
]
SCHEMA = "tabla string, fila_id string, campo string, texto string"


def corpus(spark, extra):
    rows = [("t", f"c{i}", "f", CLEAN[i % len(CLEAN)]) for i in range(len(CLEAN) * 40)]
    return spark.createDataFrame(rows + [("t", f"x{i}", "f", x) for i, x in enumerate(extra)], SCHEMA)


def test_wrong_decodings_are_found_and_taken_back(spark):
    text = CLEAN[0]
    once = [text.encode().decode(e) for e in ("latin-1", "cp850", "mac_roman", "cp437")]
    twice = text.encode().decode("latin-1").encode().decode("latin-1")
    part = text.replace("música", "mÃºsica")
    other = CLEAN[0].encode("cp850").decode("cp1252")
    lost = [text.encode("ascii", "replace").decode(), text.encode("latin-1").decode("utf-8", "replace")]
    got = {r["fila_id"]: r["original"] for r in garbled(corpus(spark, [*once, twice, part, other, *lost])).collect()}
    assert set(got) == {f"x{i}" for i in range(9)}
    assert all(got[f"x{i}"] == text for i in range(7))
    assert got["x7"] is None and got["x8"] is None


def test_odd_but_whole_text_is_no_case(spark):
    assert garbled(corpus(spark, [None, "", "    ", "SEÑOR ÁNGEL", "a" * 50_000 + " é"])).count() == 0


def test_empty_table_and_repeated_rows(spark):
    df = corpus(spark, ["cafÃ© con leche"] * 3)
    assert garbled(df).count() == 3
    assert garbled(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_segments_against_brute_force(seed):
    r = random.Random(seed)
    scores = [r.choice((-3, -1, -0.5, 1, 2)) for _ in range(30)]
    best = max((sum(scores[i:j]) for i in range(30) for j in range(i + 1, 31)), default=0)
    got = segments(scores)
    if best > 0:
        assert max(s for *_, s in got) == pytest.approx(best)
    assert all(sum(scores[b:e]) == pytest.approx(s) and s > 0 for b, e, s in got)
    assert all(a[1] <= b[0] for a, b in zip(sorted(got), sorted(got)[1:]))
    assert SUSPECT


def test_text_that_was_damaged_many_times_is_restored(spark):
    clean = [f"El árbol número {i} está allí: mañana, según el niño, habrá más canción y corazón" for i in range(400)]
    bad = "mañana habrá más canción"
    for _ in range(6):
        bad = "".join(bytes([b]).decode("latin-1") if b in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else bytes([b]).decode("cp1252") for b in bad.encode("utf-8"))
    df = spark.createDataFrame([("t", str(i), "c", x) for i, x in enumerate([*clean, bad, "todo � mal", "sin\x93comillas\x94", None, ""])], "tabla string, fila_id string, campo string, texto string")
    got = {r["fila_id"]: r["original"] for r in garbled(df).collect()}
    assert got == {"400": "mañana habrá más canción", "401": None, "402": None}

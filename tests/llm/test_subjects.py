import random

from brocal.llm.prose import fold, parts, repaired
from brocal.llm.subjects import assigned, composition, learn, subject_posteriors, unpack

TOPICS = {
    "deporte": ["el tercer set", "la canasta de tres", "el revés cruzado", "la maratón de otoño", "el tiro libre"],
    "salud": ["la válvula mitral", "el cribado poblacional", "la terapia de grupo", "el periodo de incubación", "el fármaco anticoagulante"],
    "arte": ["el óleo sobre lienzo", "la pincelada suelta", "el claroscuro", "el cuarteto de cuerda", "el plano secuencia"],
}
VERBS = ["depende de", "se apoya en", "precede a", "convive con", "explica en parte"]
FILLER = ["La puerta queda abierta a nuevas ideas.", "No hay una única respuesta válida.", "El texto se revisó 7 veces."]


def document(r, subjects, n=8):
    out = []
    for s in subjects:
        out += [f"{r.choice(TOPICS[s]).capitalize()} {r.choice(VERBS)} {r.choice(TOPICS[s])}." for _ in range(n)]
    return "\n".join(out + r.sample(FILLER, 2))


def corpus(spark, n=400):
    r = random.Random(4)
    docs, labels = [], []
    for i in range(n):
        own = r.sample(list(TOPICS), 1 if r.random() < 0.8 else 2)
        docs.append((i, document(r, own), None, r.choice(["a", "b", None]), "extra"))
        labels += [(i, s) for s in own]
    docs += [(n, None, "t", "a", ""), (n + 1, "", "t", "a", ""), (n + 2, " ".join(FILLER), None, None, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string, title string, source string, posterior string")
    known = [x for x in labels if x[0] % 2 == 0]
    return d, spark.createDataFrame([(s,) for s in TOPICS], "subject string"), spark.createDataFrame([*known, *known[:5], (10**6, "arte"), (0, None), (2, "otra")], "doc_id long, subject string"), set(labels)


def test_held_out_accuracy(spark):
    d, s, known, truth = corpus(spark)
    post = subject_posteriors(d, s, known).cache()
    got = {tuple(x) for x in assigned(post).collect()}
    hit = len(got & truth)
    assert 2 * hit / (len(got) + len(truth)) > 0.97
    assert not {x for x in got if x[0] >= 400}
    assert sum(r["documentos"] for r in composition(post, s).collect()) == len(got)


def test_without_labels_or_documents(spark):
    d, s, known, _ = corpus(spark, 20)
    assert subject_posteriors(d, s, known.limit(0)).count() == 0
    assert subject_posteriors(d.limit(0), s, known).count() == 0


def test_prose_leaves_code_menus_and_markup_out():
    text = "== Historia ==\nEl rey<br/> huyó{{cita|x}} de noche. La ciudad se rindió.\n```python\nx = 1\n```\n>>> print(x)\nDeportes | Economía | Salud\nMás leído: fútbol\n- [14:22] Se fue a www.sitio.example hoy.\nTodos los derechos reservados."
    prose, headings, addresses = parts(text)
    assert [" ".join(p.split()) for p in prose] == ["El rey huyó de noche.", "La ciudad se rindió.", "Se fue a www.sitio.example hoy."]
    assert headings == ["Historia"] and addresses == ["www.sitio.example"]
    assert fold("ÁRBOL ñandú") == "arbol nandu" and repaired("cafÃ© solo") == "café solo"


def test_the_model_learns_where_a_quarter_begins():
    counts = {(0, p): 100.0 for p in range(0, 13 * 27) if unpack(p)[1:] == (1, 1, 1)}
    post = learn(counts, {}, 1)
    by = [x for _, x in sorted((unpack(p)[0], v) for (_, p), v in post.items())]
    assert by == sorted(by) and by[0] < 0.5 < by[-1]


def test_sentences_are_judged_at_once_as_one_by_one():
    from brocal.llm.subjects import SENTENCE, Voter
    from brocal.llm.prose import words

    lexicon = {"gol": (0, 2.5), "partido gol": (0, 1.5), "atomo": (1, 3.5), "juez": (2, 3.2), "gol juez": (2, 4.0)}
    sentences = ["Un partido, gol.", "Gol", "El ÁTOMO", "gol juez", "nada", "", "juez atomo átomo"]

    def one(s):
        found, ws = [0.0] * 3, words(s)
        for t in ws + [f"{a} {b}" for a, b in zip(ws, ws[1:])]:
            if t in lexicon:
                found[lexicon[t][0]] += lexicon[t][1]
        return found.index(max(found)) if max(found) > SENTENCE else -1

    assert Voter(lexicon, 3, {}).subjects(sentences) == [one(s) for s in sentences] == [0, -1, 1, 2, -1, -1, 1]
    assert Voter({}, 3, {}).subjects(sentences) == [-1] * 7

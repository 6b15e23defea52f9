"""Queries of the text corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from brocal.functions import clean
from brocal.operators import corpus as C
from brocal.operators.ranking import split
from brocal.plans.problems import table


def docs(spark, sf):
    return table(spark, sf, "documents")


def q(f):
    return lambda spark, sf: f(docs(spark, sf))


def bpe_merges(spark, sf):
    merges, _ = C.train_bpe(docs(spark, sf))
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(merges)], "i int, a string, b string")


def bpe_ids(spark, sf):
    d = docs(spark, sf)
    return C.encode_bpe(d, *C.train_bpe(d))


def generated(spark, sf):
    return spark.createDataFrame([(C.generate(C.ngram_counts(docs(spark, sf)), "el", 12),)], "text string")


def held_out(d):
    """Both models from the training side, judged on the clean texts of the other side."""
    sides = split(d, "doc_id")
    train, test = sides.where("parte = 'train'").drop("parte"), sides.where("parte = 'test'").drop("parte")
    return C.compare_training(train, C.cleaned(train), C.cleaned(test))


def bpe_stats(spark, sf):
    d = docs(spark, sf)
    merges, vocabulary = C.train_bpe(d)
    return C.vocabulary_stats(d, C.encode_bpe(d, merges, vocabulary), merges, vocabulary)


def degrees(d):
    return C.similarity_degrees(C.similar_pairs(d)[1], 20)


QUERIES = {
    "corpus_stats": q(C.corpus_stats), "clean_encoding": q(lambda d: d.where("text is not null").select("doc_id", F.md5(clean.fix_encoding("text", clean.BROKEN_CORPUS)).alias("h"))),
    "clean_html": q(lambda d: d.where("text is not null").select("doc_id", F.length(clean.strip_html("text")).alias("n"), F.md5(clean.strip_html("text")).alias("h"))), "clean_length": q(C.length_classes),
    "clean_language": q(C.language_quality), "clean_pii": q(C.redaction_count), "clean_pipeline": q(C.cleaning_report),
    "dedup_exact": q(C.exact_report), "dedup_exact_classes": q(C.exact_classes), "dedup_minhash": q(C.signatures), "dedup_lsh": q(C.lsh_pairs), "dedup_lsh_loose": q(lambda d: C.lsh_pairs(d, similar=0.5, words=3)), "dedup_near": q(C.near_duplicates), "dedup_degrees": q(degrees),
    "lm_ngrams": q(C.ngram_counts), "lm_stats": q(lambda d: C.lm_stats(C.ngram_counts(d))), "lm_perplexity": q(held_out), "lm_generate": generated,
    "bpe_words": q(lambda d: C.word_table(d).select("palabra", "veces")), "bpe_merges": bpe_merges, "bpe_ids": bpe_ids, "bpe_stats": bpe_stats,
}


def _fixed(c):
    for a, b in clean.BROKEN_CORPUS.items():
        c = f"replace({c}, '{a}', '{b}')"
    return c


def _staged_html(source: str) -> str:
    """The same in steps, as each marker names its input twice."""
    inner = "t0"
    for f in ("regexp_replace({}, '<ref[^>/]*>.*?</ref>', '', 'gs')", "regexp_replace({}, '<ref[^>]*/>', '', 'g')", "regexp_replace({}, '\\{{\\{{.*?\\}}\\}}', '', 'gs')", "regexp_replace({}, '\\[\\[[^\\]|]+\\|([^\\]]+)\\]\\]', '\\1', 'g')", "regexp_replace({}, '\\[\\[([^\\]]+)\\]\\]', '\\1', 'g')", "regexp_replace({}, '<!--.*?-->', '', 'gs')", "regexp_replace({}, '<[^>]+>', '', 'g')"):
        inner = f.format(inner)
    out = f"h0 as (select doc_id, lang, {inner} t from ({source}))"
    for i, m in enumerate(clean.BOILERPLATE):
        out += f",\nh{i + 1} as (select doc_id, lang, case when contains(t, '{m}') then substr(t, 1, instr(t, '{m}') - 1) else t end t from h{i})"
    return out + f",\nhtml as (select doc_id, lang, regexp_replace(t, '\\n{{3,}}', chr(10) || chr(10), 'g') t from h{len(clean.BOILERPLATE)})"


_WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')"
_SETS = f"""with recursive w as (select doc_id, {_WORDS} w from documents where text is not null),
s as (select doc_id, list_sort(list_distinct(case when len(w) > 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) else [array_to_string(w, ' ')] end)) s from w where len(w) > 0),
m as (select doc_id, min(doc_id) over (partition by s) rep, s from s),
reps as (select doc_id id, s, len(s) n from m where doc_id = rep),
tok as (select id, n, unnest(s) t from reps),
pairs as (select a, b, c / (na + nb - c) jaccard from (select x.id a, y.id b, any_value(x.n) na, any_value(y.n) nb, count(*) c from tok x join tok y on x.t = y.t and x.id < y.id group by 1, 2) where c / (na + nb - c) >= 0.8),
und as (select a, b from pairs union select b, a from pairs),
walk as (select id, id clase from reps union select und.b, clase from walk join und on und.a = walk.id),
cls as (select id, min(clase) clase from walk group by 1)
"""
_GRAMS = """w as (select {p} list_concat(['<s>', '<s>'], regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+|[.,;:¿?¡!]'), ['</s>']) w from {t} where text is not null),
g as (select {p} w[i] || ' ' || w[i + 1] contexto, w[i + 2] token from (select {p} w, unnest(range(1, len(w) - 1)) i from w))"""
_STOP = lambda words: "len(regexp_extract_all(' ' || regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', '  ', 'g') || ' ', ' (?:" + "|".join(words) + ") '))"
_EN = f"({_STOP(clean.STOP_EN)} > {_STOP(clean.STOP_ES)})"
_PHONE = clean.PHONE
_EMAIL = clean.EMAIL.replace("\\w", "A-Za-z0-9_")  # as Java reads it
_CLEAN = f"""{_staged_html(f"select doc_id, lang, {_fixed('text')} t0 from documents where text is not null")},
red as (select doc_id, regexp_replace(regexp_replace(t, '{_EMAIL}', '[EMAIL]', 'g'), '{_PHONE}', '[TELEFONO]', 'g') as text from html),
kept as (select doc_id, text from red where length(text) between 100 and 10000 and not {_EN})"""


_TRAIN = "('0x' || substr(md5(doc_id::varchar || ':42'), 1, 8))::bigint < 3435973836"


def _model(name: str, source: str) -> str:
    g = _GRAMS.format(p="", t=source).replace("w as (", f"w_{name} as (", 1).replace("g as (", f"g_{name} as (", 1).replace("from w))", f"from w_{name}))")
    return g + f",\nc_{name} as (select contexto, token, count(*) veces from g_{name} group by 1, 2), t_{name} as (select contexto, sum(veces) tc from c_{name} group by 1), u_{name} as (select token, sum(veces) u from c_{name} group by 1), n_{name} as (select count(distinct token) + 1 v, sum(veces) t from c_{name})"


def _perplexity(name: str, label: str) -> str:
    return f"""select '{label}' modelo, sum(k)::bigint tokens, round(exp(-sum(k * ln(greatest(p, 1e-12))) / sum(k)), 4) perplejidad from (
  select k, case when tc is not null then (coalesce(veces, 0) + 0.1::double) / (tc + 0.1::double * v) else (coalesce(u, 0) + 0.1::double) / (t + 0.1::double * v) end p
  from (select contexto, token, count(*) k from g_valid group by 1, 2) left join c_{name} using (contexto, token) left join t_{name} using (contexto) left join u_{name} using (token), n_{name})"""


SQL = {
    "corpus_stats": "select source, count(*) documentos, sum(length(text))::bigint caracteres, round(avg(length(text)), 1) media from documents group by 1",
    "clean_encoding": f"select doc_id, md5({_fixed('text')}) h from documents where text is not null",
    "clean_html": "with " + _staged_html("select doc_id, lang, text t0 from documents where text is not null") + " select doc_id, length(t) n, md5(t) h from html",
    "clean_length": "select case when length(text) < 100 then 'too_short' when length(text) > 10000 then 'too_long' when text is not null then 'kept' end clase, count(*) documentos from documents group by 1",
    "clean_language": f"select round(count(*) filter (where said and tru) / count(*) filter (where said), 6) as precision, round(count(*) filter (where said and tru) / count(*) filter (where tru), 6) as recall from (select {_EN} said, lower(lang) != 'es' tru from documents where text is not null and lang is not null)",
    "clean_pii": f"select coalesce(sum(n), 0)::bigint redacciones, count(*) filter (where n > 0) documentos from (select len(regexp_extract_all(text, '{_EMAIL}')) + len(regexp_extract_all(regexp_replace(text, '{_EMAIL}', '[EMAIL]', 'g'), '{_PHONE}')) n from documents)",
    "clean_pipeline": "with " + _CLEAN + " select 'antes' momento, count(*) documentos, coalesce(sum(length(text)), 0)::bigint caracteres from documents where text is not null union all select 'despues', count(*), coalesce(sum(length(text)), 0)::bigint from kept",
    "dedup_exact": "select sum(n)::bigint total, count(*) unicos, sum(n)::bigint - count(*) duplicados from (select count(*) n from documents where text is not null group by md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')))",
    "dedup_exact_classes": "select doc_id, min(doc_id) over (partition by h) clase, count(*) over (partition by h) copias from (select doc_id, md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) h from documents where text is not null)",
    "dedup_near": _SETS + "select doc_id, clase, (select count(*) from und where und.a = m.rep) enlaces from m join cls on cls.id = m.rep",
    "dedup_degrees": _SETS + "select id, count(*) vecinos, round(avg(jaccard), 6) media from (select a id, jaccard from pairs union all select b, jaccard from pairs) group by 1 order by 2 desc, avg(jaccard) desc, 1 limit 20",
    "lm_ngrams": "with " + _GRAMS.format(p="", t="documents") + " select contexto, token, count(*) veces from g group by 1, 2",
    "lm_stats": "with " + _GRAMS.format(p="", t="documents") + " select count(distinct contexto) contextos, count(distinct token) + 1 tipos, count(*) veces from g",
    "lm_perplexity": "with " + _CLEAN + f""",
trained as (select * from documents where {_TRAIN}), kept_train as (select * from kept where {_TRAIN}), kept_test as (select * from kept where not {_TRAIN}),
""" + _model("dirty", "trained") + ",\n" + _model("clean", "kept_train") + ",\n" + _model("valid", "kept_test") + "\n" + _perplexity("dirty", "sucio") + "\nunion all " + _perplexity("clean", "limpio"),
    "bpe_words": f"select palabra, count(*) veces from (select unnest({_WORDS}) palabra from documents) group by 1",
}

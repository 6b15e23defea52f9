import random
from pathlib import Path

from pyspark.sql import functions as F

import __spark_entry__
from brocal.operators import corpus as C
from brocal.session import shared_folder


def test_rare_words_count_past_200_000(spark):
    common = spark.range(200_000).select("id", F.concat(F.lit("a"), F.col("id"), F.lit(" a"), F.col("id")).alias("text"))
    rare = spark.createDataFrame([(200_000, "ñandú")], "id long, text string")
    d = common.unionByName(rare).withColumnRenamed("id", "doc_id")
    merges, vocabulary = C.train_bpe(d, 3)
    assert {"ñ", "ú"} <= vocabulary.keys()
    ids = C.encode_bpe(d.where("doc_id = 200000"), merges, vocabulary).first()["ids"]
    assert C.decode_bpe(ids, vocabulary) == "ñandú"


def test_registered_with_the_default_number_of_merges(spark):
    assert __spark_entry__.queries()["bpe_merges"](spark, "/root/testdata/sf0.001").count() == 500


def test_near_duplicates_write_less_than_their_texts(spark):
    """Shingles, some five times their text, stay off the disk; the pairs are those of all pairs of texts."""
    r = random.Random(8)
    texts = [" ".join(f"palabra{r.randrange(5000)}" for _ in range(600)) for _ in range(60)]
    for i in range(20):
        w = texts[i].split()
        w[r.randrange(600)] = "otra"
        texts.append(" ".join(w[: 600 - r.randrange(120)]))
    texts += [texts[0], "uno dos tres cuatro cinco", "uno dos tres cuatro cinco", "uno", ""]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    folder = Path(shared_folder(spark).removeprefix("file:"))
    size = lambda: sum(p.stat().st_size for p in folder.rglob("part-*"))
    before = size()
    members, pairs = C.similar_pairs(d)
    got = {(x["a"], x["b"]): x["jaccard"] for x in pairs.collect()}
    assert size() - before < sum(map(len, texts)) / 4
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) > 5 else {tuple(w)} for i, t in enumerate(texts) if (w := t.split())}
    reps = {x["doc_id"]: x["rep"] for x in members.collect()}
    assert reps == {i: min(j for j in sets if sets[j] == sets[i]) for i in sets}
    alike = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in set(reps.values()) for j in set(reps.values()) if i < j}
    assert got == {k: v for k, v in alike.items() if v >= 0.8} and len(got) > 5


def test_words_are_not_matched_again_for_each_shingle(spark):
    """A filter on words or similarity would be moved below, and match the words wherever it reads them."""
    d = spark.createDataFrame([(1, "uno dos tres cuatro cinco seis"), (2, "uno dos tres cuatro cinco siete")], "doc_id long, text string")
    plan = C.similar_pairs(d)[1]._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "regexp_extract_all" in x and ("Filter" in x or "lambda" in x)]


def test_degrees_in_the_order_of_the_mean_itself(spark):
    pairs = spark.createDataFrame([(1, 2, 0.9000001), (3, 4, 0.9000004)], "a long, b long, jaccard double")
    assert [(x["id"], x["media"]) for x in C.similarity_degrees(pairs, 3).collect()] == [(3, 0.9), (4, 0.9), (1, 0.9)]


def test_parities_never_take_off_a_similar_pair(spark):
    """Texts of any length, whose parities have different numbers of bits, against all pairs of sets."""
    r = random.Random(5)
    texts = []
    for n in (1, 4, 5, 6, 9, 30, 335, 341, 345, 700, 1500):
        w = [f"p{r.randrange(10**6)}" for _ in range(n)]
        for more in range(0, n // 5 + 2, max(1, n // 25)):
            texts.append(" ".join([*w, *(f"q{r.randrange(10**6)}" for _ in range(more))]))
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) > 5 else {tuple(w)} for i, t in enumerate(texts) if (w := t.split())}
    for similar in (0.8, 0.4):
        _, pairs = C.similar_pairs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), similar=similar)
        alike = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in sets for j in sets if i < j and sets[i] != sets[j]}
        assert {(x["a"], x["b"]): x["jaccard"] for x in pairs.collect()} == {k: v for k, v in alike.items() if v >= similar}


def test_near_duplicates_without_a_key(spark):
    """A class needs a text with a key, as in the SQL; copies without one follow it."""
    d = spark.createDataFrame([(None, "a b c d e f g"), (None, "sin clave"), (7, "a b c d e f g"), (8, "otra cosa"), (9, None)], "doc_id long, text string")
    assert {tuple(x) for x in C.near_duplicates(d).collect()} == {(None, 7, 0), (7, 7, 0), (8, 8, 0)}


def test_pairs_by_broadcast_and_without(spark, monkeypatch):
    texts = [" ".join(f"p{k}" for k in range(i, i + 40)) for i in (0, 0, 1, 2, 100, 101, 100)]
    d = spark.createDataFrame([*enumerate(texts), (None, texts[0]), (None, "nadie")], "doc_id long, text string")
    for few in (0, 1000):
        monkeypatch.setattr(C, "FEW", few)
        members, pairs = C.similar_pairs(d)
        assert {(x["a"], x["b"]) for x in pairs.collect()} == {(0, 2), (0, 3), (2, 3), (4, 5)}
        assert {tuple(x) for x in members.collect()} == {(0, 0), (1, 0), (2, 2), (3, 3), (4, 4), (5, 5), (6, 4), (None, 0), (None, None)}

import pytest
from pyspark.sql import functions as F

from brocal.functions import clean
from brocal.operators import corpus as C
from brocal.operators import graph as G
from brocal.operators import prep as P
from brocal.operators import ranking as K
from brocal.sources.mailbox import emit
from brocal.sources.tables import layers, read_layer, read_profile, write_layer, write_profile
from brocal.streaming import late as L
from brocal.streaming import runs as R
from brocal.streaming import windows as W


@pytest.fixture(scope="module")
def mailbox(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("buzon"))
    return folder, emit(folder)


def same(a, b):
    def rows(df):
        return sorted(str([round(v, 6) if isinstance(v, float) else v for v in r]) for r in df.collect())

    return rows(a) == rows(b)


def test_stream_gives_what_the_table_gives(spark, mailbox):
    folder, truth = mailbox
    table = R.read_table(spark, folder)
    assert table.count() == truth["lecturas"] + truth["copias"]
    for f, name in ((W.tumbling, "m_tumbling"), (W.at_risk, "m_risk")):
        assert same(R.to_memory(f(R.read_stream(spark, folder, 4)), name), f(table))
    assert W.without_copies(table).count() == truth["lecturas"]
    assert {r["robot_id"] for r in W.at_risk(table).collect()} == {"RBT-0000"}


def test_windows_cover_each_reading(spark, mailbox):
    table = R.read_table(spark, mailbox[0])
    n = table.count()
    assert W.tumbling(table).agg(F.sum("lecturas")).first()[0] == n
    assert W.sliding(table).agg(F.sum("lecturas")).first()[0] == 2 * n
    assert W.sessions(table).agg(F.sum("lecturas")).first()[0] == n


def test_resume_reads_nothing_again_and_upserts_are_idempotent(spark, mailbox, tmp_path):
    seen, sink = [], R.Upsert(str(tmp_path / "t"), ["inicio", "robot_id"])

    def both(batch, i):
        seen.append(batch.count())
        sink(batch, i)

    flow = lambda: W.window_state(R.read_stream(spark, mailbox[0], 10))
    first = R.run(flow(), both, "update", str(tmp_path / "ck"))
    again = R.run(flow(), both, "update", str(tmp_path / "ck"))
    assert sum(m["rows"] for m in first) == R.read_table(spark, mailbox[0]).count() and sum(m["rows"] for m in again) == 0
    assert same(sink.table(spark).select("inicio", "robot_id", "lecturas", "temp_max"), W.window_state(R.read_table(spark, mailbox[0])).select("inicio", "robot_id", "lecturas", "temp_max"))


def test_watermark_loses_less_the_longer_it_waits(spark, mailbox):
    table = L.with_batch(R.read_table(spark, mailbox[0]))
    lost = [r["perdidas"] for r in L.sweep(table).orderBy("espera").collect()]
    assert lost == sorted(lost, reverse=True) and lost[0] > 0 and lost[-1] == 0
    assert L.left_out(table, 2, 2).where("descartada").count() == lost[2]
    assert L.with_delay(table).agg(F.max("retraso_min")).first()[0] <= 5


def test_layers_can_be_written_over_themselves(spark, tmp_path):
    root = str(tmp_path / "silver")
    write_layer(spark.range(5), root, "t")
    write_layer(read_layer(spark, root, "t").where("id > 1"), root, "t")
    assert read_layer(spark, root, "t").count() == 3 and layers(str(tmp_path))["silver"]
    write_profile(spark.range(2), root)
    assert read_profile(root) == [{"id": 0}, {"id": 1}]


def test_cleaning_functions(spark):
    df = spark.createDataFrame([("  <ref a>x</ref>Hola [[a|b]] {{t}}<b>!</b>\n\n\n\n<!-- c -->escribe a ana@sitio.org o al +34 600 111 222\n== Referencias ==\nfin", ["##Cine. ", "#cine", "a", None])], "t string, h array<string>")
    r = df.select(clean.strip_html("t").alias("s"), clean.redact("t").alias("p"), clean.normal_hashtags("h").alias("h"), clean.redactions("t").alias("n")).first()
    assert r["s"] == "  Hola b !\n\nescribe a ana@sitio.org o al +34 600 111 222\n" and "[EMAIL]" in r["p"] and "[TELEFONO]" in r["p"] and r["h"] == ["cine"] and r["n"] == 2


def test_mdlp_and_bins(spark):
    df = spark.range(400).select(F.col("id").cast("double").alias("x"), F.when(F.col("id") < 150, 0).otherwise(1).alias("y"), "id")
    assert P.edges_mdlp(df, "x", "y") == [0.0, 149.5, 399.0]
    assert sorted(r["count"] for r in df.groupBy(P.discretise("x", P.edges_equal_width(df, "x", 4))).count().collect()) == [100, 100, 100, 100]


def test_global_rank_and_components(spark):
    df = spark.range(500).select((F.col("id") % 7).alias("a"), F.hash("id").alias("b"), "id")
    ranked = K.global_rank(df, [-F.col("a")], [F.col("b"), F.col("id")]).orderBy("rank").collect()
    assert [r["id"] for r in ranked] == [r["id"] for r in sorted(df.collect(), key=lambda r: (-r["a"], r["b"], r["id"]))]
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in [*range(31), 100, 101, 200]], "id long")
    assert {r["id"]: r["clase"] for r in C.components(nodes, edges).collect()} == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 200: 200}


def test_merges_against_counting_anew(spark):
    words = [("abab", 5), ("abc", 4), ("bcab", 3), ("cc", 3)]
    table = {tuple([*w, C.END]): n for w, n in words}
    slow = []
    for _ in range(6):
        count = {}
        for s, n in table.items():
            for p in zip(s, s[1:]):
                count[p] = count.get(p, 0) + n
        if not count:
            break
        best = max(count, key=count.get)
        slow.append(best)
        new = {}
        for s, n in table.items():
            t, i = [], 0
            while i < len(s):
                if s[i : i + 2] == best:
                    t.append(s[i] + s[i + 1])
                    i += 2
                else:
                    t.append(s[i])
                    i += 1
            new[tuple(t)] = n
        table = new
    assert C.learn_merges(words, 6) == slow
    df = spark.createDataFrame([(1, "abab abc"), (2, None)], "doc_id long, text string")
    merges, vocabulary = C.train_bpe(df, 10)
    got = {r["doc_id"]: list(r["ids"]) for r in C.encode_bpe(df, merges, vocabulary).collect()}
    assert C.decode_bpe(got[1], vocabulary) == "abab abc" and got[2] == []


def test_shortest_path_both_ways(spark):
    nodes = spark.createDataFrame([(c, f"name_{c}") for c in "abcdef"], "id string, username string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "c"), ("d", "e")], "src string, dst string")
    r = G.shortest_path(nodes, edges, "a", "name_e").first()
    assert r["distance"] == 4 and [n["id"] for n in r["path"]] == ["a", "b", "c", "d", "e"]
    assert G.shortest_path(nodes, edges, "e", "a").first()["distance"] == 4
    assert G.shortest_path(nodes, edges, "a", "a").first()["distance"] == 0
    assert G.shortest_path(nodes, edges, "a", "f").count() == 0


def test_a_map_keeps_groups_apart():
    import numpy as np

    from brocal.operators.embed import tsne

    r = np.random.default_rng(0)
    x = np.concatenate([r.normal(0, 1, (40, 5)), r.normal(12, 1, (40, 5))])
    y = tsne(x, 10)
    a, b = y[:40], y[40:]
    assert np.linalg.norm(a.mean(0) - b.mean(0)) > 2 * max(a.std(), b.std())

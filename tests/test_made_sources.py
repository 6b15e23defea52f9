import pytest
from pyspark.sql import functions as F

from brocal.operators import corpus as C
from brocal.operators import graph as G
from brocal.operators import profiles as R
from brocal.operators import social as S
from brocal.sources import made as M
from brocal.sources import tables as T
from brocal.streaming import late as L
from brocal.streaming import runs
from brocal.streaming import windows as W



@pytest.fixture(scope="module")
def mailbox(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("buzon"))
    return folder, M.emit(spark, folder, M.Fleet(robots=24, minutes=24))


def test_the_social_tables_are_dirty_as_said_and_come_out_clean(spark):
    raw = M.social(spark, 400, 3000, 5000, 2000)
    again = M.social(spark, 400, 3000, 5000, 2000)
    assert raw["posts"].exceptAll(again["posts"]).count() == 0
    counts = {r["ruido"]: r["filas"] for r in R.noise_profile(raw["posts"], "_ruido").collect()}
    assert counts["rafaga"] == 3 and counts["huerfano"] > 60 and counts["encoding"] > 150
    for name, df in raw.items():
        assert set(T.SCHEMAS[name].names) <= set(df.columns), name
    now = F.lit(M.NOW).cast("timestamp")
    users = S.silver_users(raw["users"], now)
    posts = S.silver_posts(raw["posts"], users, now)
    assert users.where("email is not null").groupBy("email").count().where("count > 1").count() == 0 and users.where("instr(username, ' ') > 0 or created_at is null").count() == 0
    assert posts.join(users, posts["user_id"] == users["_id"], "left_anti").count() == 0 and 0 < posts.count() < 3000
    likes = S.silver_likes(raw["likes"], users, posts, now)
    assert likes.count() == likes.dropDuplicates(["user_id", "post_id"]).count()
    assert S.silver_follows(raw["follows"], users, now).where("follower_id = following_id").count() == 0


def test_the_fleet_keeps_its_relations(spark, tmp_path):
    t = M.fleet(spark, 500, 2000, 300, 200)
    r = t["robots"]
    assert r.where("abs(voltaje_v - 0.4 * bateria_pct) > 1 or abs(consumo_total_kwh - 0.08 * bateria_pct) > 0.3").count() == 0
    worn = r.groupBy((F.col("battery_health_v2") < 0.7).alias("w")).agg(F.avg("failure_next_48h").alias("f")).where("w is not null").orderBy("w").collect()
    assert worn[1]["f"] > 3 * worn[0]["f"]
    for name, df in t.items():
        assert set(T.SCHEMAS[name].names) == set(df.columns) - {"_ruido"}, name
    r.drop("_ruido").write.json(str(tmp_path / "robots"))
    back = T.read_lines(spark, str(tmp_path / "robots"), "robots")
    assert back.exceptAll(r.select(*back.columns)).count() == 0 and back.schema == T.SCHEMAS["robots"]


def test_the_corpus_has_its_noise(spark):
    d = M.corpus(spark, 1500).withColumn("doc_id", F.col("id").cast("long"))
    n = {r["ruido"]: r["filas"] for r in R.noise_profile(d, "_ruido").collect()}
    assert set(n) == {*M.NOISE, None} and all(abs(n[k] - 1500 * s) < 40 for k, s in M.NOISE.items())
    exact = d.where(F.array_contains("_ruido", "exact_dup")).select("doc_id")
    assert C.exact_classes(d).join(exact, "doc_id").where("copias < 2").count() == 0
    kinds = {r["clase"]: r["documentos"] for r in C.length_classes(d).collect()}
    assert kinds["too_short"] == n["too_short"]
    assert C.cleaned(d).where("instr(text, '@sitio') > 0 or instr(text, '<ref>') > 0 or instr(text, 'Categorías:') > 0").count() == 0


def test_when_readings_arrive(spark):
    cases = [(6, True, 9), (20, True, 21), (29, True, None), (10, False, 10), (6, False, 6)]
    df = spark.createDataFrame([(m, s) for m, s, _ in cases], "m int, s boolean")
    assert [r[0] for r in df.select(M.arrival(F.col("m"), F.col("s"), (5, 9), 30)).collect()] == [c[2] for c in cases]


def test_the_emission_says_what_is_true(spark, mailbox):
    folder, truth = mailbox
    table = L.with_batch(runs.read_table(spark, folder))
    assert table.count() == truth["lecturas"] and W.without_copies(table).count() == truth["lecturas"] - truth["copias"]
    late = L.with_delay(table)
    by = {r["almacen"]: r["d"] for r in late.groupBy("almacen").agg(F.avg("retraso_min").alias("d")).collect()}
    assert by["Rotterdam"] > by["Malmo"] + 0.5 and by["Rotterdam"] > by["Vigo"] + 0.5
    last = table.groupBy("robot_id").agg(F.max("lote").alias("m"))
    assert set(truth["silenciosos"]) <= {r[0] for r in last.where("m < 22").collect()}
    hot = {r["robot_id"] for r in W.alerts(table).collect()}
    assert hot == set(truth["calientes"]) and {r["robot_id"] for r in W.alerts(table, drop_absurd=False).collect()} == hot | set(truth["absurdos"])


def test_recovery_after_a_failure_and_the_answer_by_batch(spark, mailbox, tmp_path):
    folder, truth = mailbox
    n = runs.read_table(spark, folder).where("sensor = 'temperatura'").count()
    sink = runs.Upsert(str(tmp_path / "t"), ["inicio", "robot_id"])
    seen = []
    first, second = runs.recovered(lambda: runs.read_stream(spark, folder, 6), lambda b, i: seen.append((i, b.count())), "append", str(tmp_path / "ck1"), 2)
    assert first > 0 and second > 0 and first + second == truth["lecturas"] and len({i for i, _ in seen}) == len(seen)
    runs.recovered(lambda: W.window_state(runs.read_stream(spark, folder, 6)), sink, "update", str(tmp_path / "ck2"), 2)
    assert sink.table(spark).agg(F.sum("lecturas")).first()[0] == n
    answer = sorted(truth["calientes"])
    steps = runs.evolution(W.at_risk(runs.read_stream(spark, folder, 6)), "robot_id")
    assert steps[-1][1] == answer and runs.right_from(steps, answer) > 0 and runs.right_from(steps, ["nobody"]) is None


def test_readers_of_the_network_and_idempotent_edges(spark):
    users = spark.createDataFrame([("a", "ana", ""), ("b", "bea", "Bea"), ("c", "carl", None)], "_id string, username string, display_name string").withColumn("bio", F.lit(None).cast("string")).withColumn("posts_count", F.lit(None).cast("bigint"))
    likes = spark.createDataFrame([("a", "p1", 1), ("b", "p1", 2), ("c", "p2", 3)], "user_id string, post_id string, created_at int")
    follows = spark.createDataFrame([("a", "b"), ("c", "b"), ("b", "a")], "follower_id string, following_id string")
    posts = spark.createDataFrame([("p1", "a", ["x"], 1), ("p2", "a", ["y"], 2), ("p3", "b", ["x"], 3)], "_id string, user_id string, hashtags array<string>, created_at int")
    ids = lambda df, c="_id": [r[c] for r in df.collect()]
    assert ids(S.likes_of(likes, users, "p1"), "user_id") == ["b", "a"] and ids(S.related(follows, users, "b")) == ["a", "c"] and ids(S.related(follows, users, "a", "following")) == ["b"]
    assert ids(S.listed_posts(posts, "a")) == ["p2", "p1"] and ids(S.listed_posts(posts, tag="x")) == ["p3", "p1"] and ids(S.post(posts, "p2")) == ["p2"] and ids(S.listed_posts(posts, skip=1, limit=1)) == ["p2"]
    assert [tuple(r) for r in S.documents_of(users).orderBy("_id").select("display_name", "bio", "posts_count").collect()] == [("ana", "", 0), ("Bea", "", 0), ("carl", "", 0)]
    nodes = users.select(F.col("_id").alias("id"), "username")
    edges = follows.select(F.col("follower_id").alias("src"), F.col("following_id").alias("dst"))
    assert [(r["id"], r["followers"], r["posts"]) for r in G.influencers(nodes, edges, 10, posts).collect()] == [("b", 2, 1), ("a", 1, 2)]
    pairs = spark.createDataFrame([(1, 2, 0.9), (2, 1, 0.9), (3, 3, 1.0)], "a long, b long, jaccard double")
    once = G.similar_edges(pairs)
    assert [tuple(r) for r in once.collect()] == [(1, 2, 0.9)] and G.similar_edges(once.unionByName(pairs)).count() == 1
    trends = spark.createDataFrame([("2026-01-01", "x", 3)], "date string, hashtag string, post_count long")
    assert T.trends_with_ids(trends).first()["_id"] == T.trends_with_ids(trends).first()["_id"]


def test_overview_midpoint_and_noise_of_columns(spark):
    df = spark.createDataFrame([(i, float(i % 10), "ab"[i % 2], i % 2) for i in range(101)], "id long, x double, c string, y int")
    got = {(r["seccion"], r["clave"]): r["filas"] for r in R.overview(df, "y").collect()}
    assert got == {("tabla", "filas"): 101, ("tabla", "columnas"): 4, ("clase", "numeric"): 3, ("clase", "categorical"): 1, ("objetivo", "0"): 51, ("objetivo", "1"): 50}
    assert R.midpoint(df, "id").first()["medio"] == 50 and {r["columna"]: r["ejemplos"] for r in R.sample_values(df, 2).collect()}["c"] == ["a", "b"]

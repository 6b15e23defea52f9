import random
from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from brocal.operators import social as S


def made(spark, users, tags, seed):
    """Posts of users who draw from a few sets of tags, and follows, one user following most."""
    r = random.Random(seed)
    kinds = [r.sample(tags, r.randrange(0, 5)) for _ in range(12)]
    own = {f"u{i:03}": set(r.choice(kinds)) for i in range(users)}
    posts = [(u, list(t), u.endswith("7")) for u, t in own.items()]
    names = list(own)
    follows = {(r.choice(names), r.choice(names)) for _ in range(3 * users)} | {(names[0], v) for v in names[1 : users // 2]}
    follows = {(a, b) for a, b in follows if a != b}
    return own, follows, spark.createDataFrame(posts, "user_id string, hashtags array<string>, is_spam boolean"), spark.createDataFrame(sorted(follows), "follower_id string, following_id string")


def test_recommended_are_the_best_of_all_pairs(spark):
    own, follows, posts, df = made(spark, 120, list("abcdefgh"), 5)
    friends = Counter((a, d) for a, b in follows for c, d in follows if b == c and a != d)
    pairs = {(a, b): (len(own[a] & own[b]), friends[a, b]) for a in own for b in own if a != b and (a, b) not in follows}
    pairs = {k: v for k, v in pairs.items() if any(v)}
    ms, mf = (max(v[i] for v in pairs.values()) for i in (0, 1))
    expected = set()
    for u in own:
        ranked = sorted((-round(0.6 * s / ms + 0.4 * f / mf, 6), b, s, f) for (a, b), (s, f) in pairs.items() if a == u)
        expected |= {(u, b, s, f, i + 1) for i, (_, b, s, f) in enumerate(ranked[:4])}
    assert {tuple(x) for x in S.follow_recommender(posts, df, 4).select("user_id", "candidate", "shared", "friends", "rank").collect()} == expected


def test_edge_types_are_those_of_the_edges(spark):
    own, _, posts, df = made(spark, 90, list("abcdef"), 6)
    edges = S.community_edges(posts, df).groupBy("type").agg(F.count(F.lit(1)), F.round(F.avg("weight"), 6))
    assert {tuple(x) for x in S.edge_types(posts, df).collect()} == {tuple(x) for x in edges.collect()}
    weights = [n for a, b in combinations([u for u in own if not u.endswith("7")], 2) if (n := len(own[a] & own[b]))]
    assert ("shared_hashtag", len(weights), round(sum(weights) / len(weights), 6)) in {tuple(x) for x in S.edge_types(posts, df).collect()}
    assert S.edge_types(posts.limit(0), df.limit(0)).count() == 0


def test_a_tag_of_all_users_is_not_listed_by_pairs(spark):
    """Some 20,000 million pairs."""
    n = 200_000
    posts = spark.range(n).select(F.format_string("u%06d", "id").alias("user_id"), F.array(F.lit("x")).alias("hashtags"), F.lit(False).alias("is_spam"))
    none = spark.createDataFrame([], "follower_id string, following_id string")
    assert [tuple(x) for x in S.edge_types(posts, none).collect()] == [("shared_hashtag", n * (n - 1) // 2, 1.0)]
    best = S.follow_recommender(posts, none)
    assert best.count() == 10 * n and {x["candidate"] for x in best.where("user_id = 'u100000'").collect()} == {f"u{i:06}" for i in range(10)}

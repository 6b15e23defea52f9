"""Property-graph questions over node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brocal.session import cut

MOST_HOPS = 6


def user_nodes(users: DataFrame) -> DataFrame:
    """Users that are no spam."""
    return users.where(~F.col("is_spam")).select(F.col("_id").alias("id"), "username", F.col("display_name").alias("name"))


def tag_nodes(posts: DataFrame) -> DataFrame:
    return posts.select(F.explode("hashtags").alias("name")).distinct()


def follow_edges(follows: DataFrame, nodes: DataFrame) -> DataFrame:
    """src, dst of follows between users of the graph."""
    e = follows.select(F.col("follower_id").alias("src"), F.col("following_id").alias("dst")).distinct()
    for side in ("src", "dst"):
        e = e.join(nodes.select(F.col("id").alias(side)), side, "left_semi")
    return e


def interest_edges(posts: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, tag of users of the graph and the tags of their posts."""
    return posts.select(F.col("user_id").alias("id"), F.explode("hashtags").alias("tag")).distinct().join(nodes.select("id"), "id", "left_semi")


def similar_edges(pairs: DataFrame) -> DataFrame:
    """Undirected edges a < b, each once, however often they are merged in."""
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "jaccard").where("a != b").groupBy("a", "b").agg(F.max("jaccard").alias("jaccard"))


def graph_stats(nodes: DataFrame, tags: DataFrame, follows: DataFrame, interests: DataFrame) -> DataFrame:
    """One row: users, hashtags, follows, interests."""
    parts = None
    for name, df in (("users", nodes), ("hashtags", tags), ("follows", follows), ("interests", interests)):
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")
        parts = one if parts is None else parts.unionByName(one)
    return parts.groupBy().pivot("what", ["users", "hashtags", "follows", "interests"]).agg(F.first("n"))


def followers(follows: DataFrame) -> DataFrame:
    return follows.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("followers"))


def influencers(nodes: DataFrame, follows: DataFrame, top: int = 10, posts: DataFrame | None = None) -> DataFrame:
    """The users with the most followers; with the number of their `posts`, if these are given."""
    best = nodes.join(followers(follows), "id").orderBy(F.desc("followers"), "id").limit(top)
    if posts is None:
        return best
    written = posts.join(F.broadcast(best.select(F.col("id").alias("user_id"))), "user_id", "left_semi").groupBy(F.col("user_id").alias("id")).agg(F.count(F.lit(1)).alias("posts"))
    return best.join(F.broadcast(written), "id", "left").fillna(0, ["posts"]).orderBy(F.desc("followers"), "id")


def communities(interests: DataFrame, top: int = 10) -> DataFrame:
    return interests.groupBy(F.col("tag").alias("hashtag")).agg(F.count(F.lit(1)).alias("users")).orderBy(F.desc("users"), "hashtag").limit(top)


def bridges(nodes: DataFrame, interests: DataFrame, follows: DataFrame, least: int = 3, top: int = 10) -> DataFrame:
    """Users of at least so many tags, with these; users without followers stay."""
    t = interests.groupBy("id").agg(F.array_sort(F.collect_set("tag")).alias("tags")).withColumn("tag_count", F.size("tags")).where(F.col("tag_count") >= least)
    return nodes.join(t, "id").join(followers(follows), "id", "left").fillna(0, ["followers"]).orderBy(F.desc("tag_count"), F.desc("followers"), "id").limit(top)


def _shared(interests: DataFrame, me: str) -> DataFrame:
    mine = interests.where(F.col("id") == me).select("tag")
    return interests.where(F.col("id") != me).join(mine, "tag", "left_semi").groupBy("id").agg(F.array_sort(F.collect_set("tag")).alias("shared_tags"))


def mutual_interests(nodes: DataFrame, interests: DataFrame, me: str, top: int = 10) -> DataFrame:
    """Users with tags in common with one user, with these."""
    return nodes.join(_shared(interests, me), "id").withColumn("shared_count", F.size("shared_tags")).orderBy(F.desc("shared_count"), "id").limit(top)


def tag_pairs(interests: DataFrame, top: int = 20) -> DataFrame:
    """Pairs of tags by the users of both."""
    a, b = interests.select("id", F.col("tag").alias("tag1")), interests.select("id", F.col("tag").alias("tag2"))
    return a.join(b, "id").where("tag1 < tag2").groupBy("tag1", "tag2").agg(F.count(F.lit(1)).alias("shared_users")).orderBy(F.desc("shared_users"), "tag1", "tag2").limit(top)


def my_communities(nodes: DataFrame, interests: DataFrame, follows: DataFrame, me: str, top: int = 8, members: int = 5) -> DataFrame:
    """The tags of one user with the number of their other users and the most followed of these."""
    mine = interests.where(F.col("id") == me).select("tag")
    others = interests.where(F.col("id") != me).join(mine, "tag", "left_semi").join(nodes.select("id", "username"), "id").join(followers(follows), "id", "left").fillna(0, ["followers"])
    ranked = others.withColumn("i", F.row_number().over(Window.partitionBy("tag").orderBy(F.desc("followers"), "id")))
    size = others.groupBy("tag").agg(F.count(F.lit(1)).alias("size"))
    best = ranked.where(F.col("i") <= members).groupBy("tag").agg(F.sort_array(F.collect_list(F.struct("i", "id", "username", "followers"))).alias("m"))
    return size.join(best, "tag").select(F.col("tag").alias("hashtag"), "size", F.transform("m", lambda x: F.struct(x["id"].alias("id"), x["username"].alias("username"), x["followers"].alias("followers"))).alias("top_members")).orderBy(F.desc("size"), "hashtag").limit(top)


def community_overlap(nodes: DataFrame, interests: DataFrame, follows: DataFrame, me: str, top: int = 15) -> DataFrame:
    """Users by tags in common with one user, and who follows whom."""
    s = _shared(interests, me).withColumn("overlap", F.size("shared_tags"))
    out = nodes.select("id", "username").join(s, "id").orderBy(F.desc("overlap"), "id").limit(top)
    i_follow = follows.where(F.col("src") == me).select(F.col("dst").alias("id"), F.lit(True).alias("i_follow"))
    follows_me = follows.where(F.col("dst") == me).select(F.col("src").alias("id"), F.lit(True).alias("follows_me"))
    return out.join(i_follow, "id", "left").join(follows_me, "id", "left").select("id", "username", F.col("shared_tags").alias("shared"), "overlap", F.coalesce("i_follow", F.lit(False)).alias("i_follow"), F.coalesce("follows_me", F.lit(False)).alias("follows_me"))


def distances(edges: DataFrame, start: DataFrame, hops: int, into: DataFrame | None = None) -> DataFrame:
    """id, dist, previous: every node within so many hops from the nodes `id` of `start`, breadth first.

    Each hop joins the frontier to the edges and takes off what was reached
    before; it is written to the shared folder, so plans don't grow.  With
    `into`, the search ends when all its ids are reached.
    """
    reached = cut(start.select("id", F.lit(0).alias("dist"), F.lit(None).cast("string").alias("previous")))
    frontier = reached
    for hop in range(1, hops + 1):
        new = frontier.join(edges, frontier["id"] == edges["src"]).groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("previous"))
        new = cut(new.join(reached.select("id"), "id", "left_anti").select("id", F.lit(hop).alias("dist"), "previous"))
        if new.isEmpty():
            break
        reached = reached.unionByName(new)
        frontier = new
        if into is not None and into.join(reached.select("id"), "id", "left_anti").isEmpty():
            break
    return reached


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def turned(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def shortest_path(nodes: DataFrame, follows: DataFrame, a: str, b: str, hops: int = MOST_HOPS) -> DataFrame:
    """One row (path, distance) with the users of a shortest path in any direction, named by id or user name; none if there is no path."""
    start, end = (nodes.where((F.col("id") == x) | (F.col("username") == x)).select("id") for x in (a, b))
    reached = distances(both_ways(follows), start, hops, end)
    at = reached.join(end, "id", "left_semi").select("id", "dist", "previous").orderBy("dist", "id").limit(1).collect()
    if not at:
        return nodes.sparkSession.createDataFrame([], "path array<struct<id:string,username:string>>, distance int")
    steps = [at[0]["id"]]
    before = at[0]["previous"]
    while before is not None:  # as many steps as the path has edges
        steps.append(before)
        row = reached.where(F.col("id") == before).select("previous").first()
        before = row["previous"]
    steps.reverse()
    order = F.array(*[F.lit(s) for s in steps])
    path = nodes.where(F.col("id").isin(*steps)).select(F.struct(F.array_position(order, F.col("id")).alias("i"), "id", "username").alias("n")).agg(F.sort_array(F.collect_list("n")).alias("p"))
    return path.select(F.transform("p", lambda n: F.struct(n["id"].alias("id"), n["username"].alias("username"))).alias("path"), F.lit(len(steps) - 1).alias("distance"))


def ego_neighbours(nodes: DataFrame, follows: DataFrame, me: str, depth: int = 2) -> DataFrame:
    """id, username, dist of the users within so many hops from one user, which isn't among them."""
    start = nodes.where(F.col("id") == me).select("id")
    return distances(follows, start, min(depth, 3)).where("dist > 0").join(nodes.select("id", "username"), "id").select("id", "username", "dist")


def ego_edges(neighbours: DataFrame, follows: DataFrame) -> DataFrame:
    """source, target of follows among the neighbours."""
    e = follows
    for side in ("src", "dst"):
        e = e.join(neighbours.select(F.col("id").alias(side)), side, "left_semi")
    return e.select(F.col("src").alias("source"), F.col("dst").alias("target"))


def reach(nodes: DataFrame, follows: DataFrame, me: str) -> DataFrame:
    """hop1, hop2, hop3: other users from whom one user is reached within so many follows."""
    start = nodes.where(F.col("id") == me).select("id")
    d = distances(turned(follows), start, 3).where("dist > 0")
    return d.agg(*[F.count_if(F.col("dist") <= k).alias(f"hop{k}") for k in (1, 2, 3)])


def distances_from(nodes: DataFrame, follows: DataFrame, names: list[str], me: str, hops: int = MOST_HOPS) -> DataFrame:
    """username, name, followers, distance of the named users to one user along follows; -1 without a path; ascending."""
    start = nodes.where(F.col("id") == me).select("id")
    d = distances(turned(follows), start, hops).select("id", "dist")
    named = nodes.where(F.col("username").isin(*names)).join(d, "id", "left").join(followers(follows), "id", "left")
    return named.select("username", "name", F.coalesce("followers", F.lit(0)).alias("followers"), F.coalesce("dist", F.lit(-1)).alias("distance")).orderBy("distance", "username")

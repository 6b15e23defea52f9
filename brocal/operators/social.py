"""The social network from raw to silver to gold, and its document queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brocal.functions.clean import fix_encoding, normal_hashtags, normal_username, parse_when, spam_rule
from brocal.operators.copies import first_by
from brocal.operators.ranking import global_rank
from brocal.operators.skew import block_pairs, hot_limit, left_back
from brocal.session import cut

#: Parts into which the copies of one text by one author are split.
SPLIT = 64
#: Bursts up to which they are broadcast (some 100 bytes each).
BROADCAST_BURSTS = 100_000


def _filled(*columns: str) -> Column:
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull() & (F.col(c) != "")
    return ok


def silver_users(raw: DataFrame, now: Column, keep_nulls: bool = False) -> DataFrame:
    """Encoding, names and times put right; rows without id or name dropped; the first user by id of each e-mail kept; spam flagged."""
    df = raw.withColumns({
        "display_name": fix_encoding("display_name"), "bio": fix_encoding("bio"),
        "created_at": parse_when("created_at", now), "username": normal_username("username"),
    }).where(_filled("_id", "username"))
    return first_by(df, ["email"], ["_id"], keep_nulls).withColumn("is_spam", spam_rule("is_spam", "bio"))


def silver_posts(raw: DataFrame, users: DataFrame, now: Column, total: bool = False) -> DataFrame:
    """Text, tags and times put right; posts without id, text or known author dropped; repeats of one text by one author flagged.

    The fourth copy in order of time and all later ones are spam; with `total`
    all copies of a text that occurs more than three times.  Copies are counted
    by author and hash of the text first; the time of a fourth copy is found
    among the four earliest of each of SPLIT parts of a group, so a burst of
    any size is never gathered.
    """
    known = cut(users.select(F.col("_id").alias("user_id")))
    df = raw.withColumn("text", fix_encoding("text")).where(_filled("_id", "user_id", "text")).join(known, "user_id", "left_semi").withColumn("__h", F.md5("text"))
    of = ["user_id", "__h"]
    many = cut(df.groupBy(*of).agg(F.count(F.lit(1)).alias("__n")).where("__n > 3").withColumn("__many", F.lit(True)))
    at = parse_when("created_at", now)
    if not total:
        few = many.count() <= BROADCAST_BURSTS
        part = Window.partitionBy(*of, "__s").orderBy("__at")
        early = df.join(F.broadcast(many) if few else many, of).select(*of, "__n", "__many", at.alias("__at"), F.pmod(F.xxhash64("_id"), F.lit(SPLIT)).alias("__s")).withColumn("__i", F.row_number().over(part)).where("__i <= 4")
        many = cut(early.withColumn("__i", F.row_number().over(Window.partitionBy(*of).orderBy("__at"))).where("__i = 4").select(*of, "__n", "__many", F.col("__at").alias("__from")))
    # either way the same rows; few bursts need no shuffle of the texts
    out = df.join(F.broadcast(many.drop("__n")), of, "left") if many.count() <= BROADCAST_BURSTS else left_back(df, many, of, "__n", hot_limit(raw.count()))
    out = out.withColumns({"hashtags": normal_hashtags("hashtags"), "created_at": at})
    spam = F.col("__many").isNotNull()
    if not total:
        # without a time a row comes before all that have one
        spam = spam & F.coalesce(F.col("created_at") >= F.col("__from"), F.col("__from").isNull())
    return out.withColumn("is_spam", spam).withColumn("likes_count", F.lit(0).cast("bigint")).select(*[c for c in df.columns if c not in ("__h", "is_spam", "likes_count")], "is_spam", "likes_count")


def silver_likes(raw: DataFrame, users: DataFrame, posts: DataFrame, now: Column) -> DataFrame:
    """Likes between known users and posts, the first of each pair."""
    df = raw.withColumn("created_at", parse_when("created_at", now)).where(_filled("_id", "user_id", "post_id"))
    df = df.join(users.select(F.col("_id").alias("user_id")), "user_id", "left_semi").join(posts.select(F.col("_id").alias("post_id")), "post_id", "left_semi")
    return first_by(df, ["user_id", "post_id"], ["created_at", "_id"])


def silver_follows(raw: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """Follows between two different known users, the first of each pair."""
    df = raw.withColumn("created_at", parse_when("created_at", now)).where(_filled("_id", "follower_id", "following_id")).where("follower_id != following_id")
    for side in ("follower_id", "following_id"):
        df = df.join(users.select(F.col("_id").alias(side)), side, "left_semi")
    return first_by(df, ["follower_id", "following_id"], ["created_at", "_id"])


def counted(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.groupBy(F.col(key).alias("_id")).agg(F.count(F.lit(1)).alias(name))


def likes_received(likes: DataFrame, posts: DataFrame) -> DataFrame:
    """Likes of each author's posts; likes are counted by post before they meet their authors."""
    per_post = counted(likes, "post_id", "n")
    return per_post.join(posts.select("_id", "user_id"), "_id").groupBy(F.col("user_id").alias("_id")).agg(F.sum("n").alias("likes_received"))


def user_stats(users: DataFrame, posts: DataFrame, likes: DataFrame, follows: DataFrame) -> DataFrame:
    """Activity of each user: counts, likes per post, days active (both ends count), posts per day."""
    written = posts.groupBy(F.col("user_id").alias("_id")).agg(F.count(F.lit(1)).alias("posts_count"), F.min("created_at").alias("first"), F.max("created_at").alias("last"))
    df = users.select("_id", "username", "display_name", "is_spam", "origin", "created_at")
    for side in (written, counted(likes, "user_id", "likes_given"), likes_received(likes, posts), counted(follows, "following_id", "followers_count"), counted(follows, "follower_id", "following_count")):
        df = df.join(side, "_id", "left")
    df = df.fillna(0, ["posts_count", "likes_given", "likes_received", "followers_count", "following_count"])
    df = df.withColumn("days_active", F.when(F.col("first").isNotNull(), F.datediff("last", "first") + 1).otherwise(0))
    return df.withColumns({
        "avg_likes_per_post": F.when(F.col("posts_count") > 0, F.col("likes_received") / F.col("posts_count")).otherwise(0.0),
        "posts_per_day": F.when(F.col("days_active") > 0, F.col("posts_count") / F.col("days_active")).otherwise(0.0),
    }).drop("first", "last")


def post_rankings(posts: DataFrame, likes: DataFrame) -> DataFrame:
    """Posts that are not spam with their likes and rank: most likes, then latest, then id."""
    df = posts.where(~F.col("is_spam")).drop("likes_count").join(counted(likes, "post_id", "likes_count"), "_id", "left").fillna(0, ["likes_count"])
    day = F.coalesce(F.datediff(F.lit("1970-01-01").cast("date"), F.to_date("created_at")), F.lit(2**30))
    return global_rank(df, [-F.col("likes_count"), day], [F.col("created_at").desc_nulls_last(), F.col("_id")])


def hashtag_trends(posts: DataFrame) -> DataFrame:
    """Posts and authors of each tag and day, ranked within the day."""
    used = posts.where(~F.col("is_spam")).select(F.to_date("created_at").alias("date"), "user_id", F.explode("hashtags").alias("hashtag"))
    df = used.groupBy("date", "hashtag").agg(F.count(F.lit(1)).alias("post_count"), F.count_distinct("user_id").alias("unique_users"))
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("date").orderBy(F.desc("post_count"), "hashtag")))


def spam_features(users: DataFrame, posts: DataFrame, likes: DataFrame, follows: DataFrame) -> DataFrame:
    """What a spam classifier sees of each user; label 1 for spam. All missing numbers are 0."""
    one = F.col("posts_count")
    written = posts.groupBy(F.col("user_id").alias("_id")).agg(
        F.count(F.lit(1)).alias("posts_count"), F.avg(F.length("text")).alias("avg_text_length"), F.count_distinct("text").alias("u"),
        F.avg(F.size("hashtags")).alias("avg_hashtags_per_post"), F.min("created_at").alias("first"), F.max("created_at").alias("last"),
    )
    written = written.withColumn("unique_texts_ratio", F.col("u") / one).withColumn("days_active", F.when(F.col("first").isNotNull(), F.greatest(F.datediff("last", "first"), F.lit(1))).otherwise(1))
    written = written.withColumn("posts_per_day", one / F.col("days_active")).drop("u", "first", "last")
    df = users.select("_id", "username", "is_spam")
    for side in (written, counted(likes, "user_id", "likes_given"), likes_received(likes, posts), counted(follows, "following_id", "followers_count"), counted(follows, "follower_id", "following_count")):
        df = df.join(side, "_id", "left")
    df = df.fillna(0)
    ratio = F.when(F.col("followers_count") > 0, F.col("following_count") / F.col("followers_count")).otherwise(F.col("following_count").cast("double"))
    return df.withColumns({"follow_ratio": ratio, "label": F.col("is_spam").cast("int")}).drop("is_spam")


def community_edges(posts: DataFrame, follows: DataFrame, most_users: int | None = None) -> DataFrame:
    """Weighted edges: follows (weight 1), and pairs of users by the tags that both used.

    The pairs of users of one tag are the result itself, so it grows with the
    square of a tag's users, made by blocks in many tasks; `most_users` leaves out tags with more of them
    (a tag that all use says nothing), none by default.
    """
    followed = follows.select(F.col("follower_id").alias("source"), F.col("following_id").alias("target"), F.lit("follows").alias("type"), F.lit(1.0).alias("weight"))
    used = posts.where(~F.col("is_spam")).select("user_id", F.explode("hashtags").alias("tag")).distinct()
    if most_users is not None:
        used = used.join(used.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= most_users).select("tag"), "tag", "left_semi")
    shared = block_pairs(used, "user_id", ["tag"]).groupBy(F.col("a").alias("source"), F.col("b").alias("target")).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return followed.unionByName(shared.withColumn("type", F.lit("shared_hashtag")))


# Loads: counters filled back from the rows that they count.


def loaded_users(silver: DataFrame) -> DataFrame:
    zero = {c: F.lit(0).cast("bigint") for c in ("followers_count", "following_count", "posts_count")}
    return silver.select("_id", "username", "display_name", "bio", "is_spam", "origin", "created_at").withColumns(zero)


def loaded_posts(users: DataFrame, posts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Posts with their author's name, and users with the number of their posts."""
    named = posts.join(users.select(F.col("_id").alias("user_id"), "username"), "user_id").withColumn("mentions", F.array().cast("array<string>"))
    return named, users.drop("posts_count").join(counted(posts, "user_id", "posts_count"), "_id", "left").fillna(0, ["posts_count"])


def loaded_likes(posts: DataFrame, likes: DataFrame) -> DataFrame:
    """Posts with the number of their likes."""
    return posts.drop("likes_count").join(counted(likes, "post_id", "likes_count"), "_id", "left").fillna(0, ["likes_count"])


def loaded_follows(users: DataFrame, follows: DataFrame) -> DataFrame:
    """Users with the numbers of their followers and of those they follow."""
    users = users.drop("followers_count", "following_count")
    for key, name in (("following_id", "followers_count"), ("follower_id", "following_count")):
        users = users.join(counted(follows, key, name), "_id", "left")
    return users.fillna(0, ["followers_count", "following_count"])


# Document queries.


def search_users(users: DataFrame, text: str, skip: int = 0, limit: int = 20) -> DataFrame:
    """Users whose name, display name or bio contains the text, in any case; a leading @ doesn't count."""
    term = text.lstrip("@").lower()
    hit = F.lit(False)
    for c in ("username", "display_name", "bio"):
        hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(term)), F.lit(False))
    return users.where(hit).orderBy("username", "_id").offset(skip).limit(limit)


def timeline(posts: DataFrame, follows: DataFrame, user: str, skip: int = 0, limit: int = 20) -> DataFrame:
    """The latest posts of a user and of those whom the user follows."""
    spark = posts.sparkSession
    whom = follows.where(F.col("follower_id") == user).select(F.col("following_id").alias("user_id")).unionByName(spark.range(1).select(F.lit(user).alias("user_id"))).distinct()
    return posts.join(whom, "user_id", "left_semi").orderBy(F.desc("created_at"), "_id").offset(skip).limit(limit)


def listed_posts(posts: DataFrame, user: str | None = None, tag: str | None = None, skip: int = 0, limit: int = 20) -> DataFrame:
    """The latest posts, of one user or with one tag if given."""
    if user is not None:
        posts = posts.where(F.col("user_id") == user)
    return posts_with_tag(posts, tag, skip, limit) if tag is not None else posts.orderBy(F.desc("created_at"), "_id").offset(skip).limit(limit)


def post(posts: DataFrame, post_id: str) -> DataFrame:
    return posts.where(F.col("_id") == post_id)


def likes_of(likes: DataFrame, users: DataFrame, post_id: str, skip: int = 0, limit: int = 20) -> DataFrame:
    """Who liked a post, the latest first."""
    given = likes.where(F.col("post_id") == post_id).select("user_id", "created_at")
    return given.join(users.select(F.col("_id").alias("user_id"), "username"), "user_id").orderBy(F.desc("created_at"), "user_id").offset(skip).limit(limit)


def related(follows: DataFrame, users: DataFrame, user: str, side: str = "followers", skip: int = 0, limit: int = 20) -> DataFrame:
    """The followers of a user, or (side "following") those whom the user follows, by name."""
    of, other = ("following_id", "follower_id") if side == "followers" else ("follower_id", "following_id")
    ids = follows.where(F.col(of) == user).select(F.col(other).alias("_id")).distinct()
    return users.join(ids, "_id", "left_semi").select("_id", "username").orderBy("username", "_id").offset(skip).limit(limit)


def documents_of(users: DataFrame) -> DataFrame:
    """User rows as documents without gaps: empty text is none, names fall back on the user name, counters and flags on nothing."""
    text = {c: F.nullif(F.col(c), F.lit("")) for c in ("username", "display_name", "bio") if c in users.columns}
    filled = {c: F.coalesce(F.col(c), F.lit(0).cast(t)) for c, t in users.dtypes if t in ("int", "bigint", "double") and c.endswith("_count")}
    flags = {c: F.coalesce(F.col(c), F.lit(False)) for c, t in users.dtypes if t == "boolean"}
    df = users.withColumns(text).withColumns(filled | flags)
    return df.withColumns({"display_name": F.coalesce("display_name", "username"), "bio": F.coalesce("bio", F.lit(""))})


def posts_with_tag(posts: DataFrame, tag: str, skip: int = 0, limit: int = 20) -> DataFrame:
    return posts.where(F.array_contains("hashtags", tag)).orderBy(F.desc("created_at"), "_id").offset(skip).limit(limit)


def trending(trends: DataFrame, limit: int = 10) -> DataFrame:
    """Tags by the number of their posts over all days."""
    return trends.groupBy("hashtag").agg(F.sum("post_count").alias("total")).orderBy(F.desc("total"), "hashtag").limit(limit)


def tag_sets(used: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(user_id, set) of `used` (user_id, tag; distinct), and (set, tags, k, n): the different sets of tags, of k tags and n users.

    Users with the same tags share the same tags with everybody, so pairs are
    of sets, of which there are far fewer than users.
    """
    own = used.groupBy("user_id").agg(F.array_sort(F.collect_list("tag")).alias("tags"))
    own = cut(own.select("user_id", "tags", F.md5(F.to_json("tags")).alias("set")))
    return own.select("user_id", "set"), cut(own.groupBy("set").agg(F.first("tags").alias("tags"), F.count(F.lit(1)).alias("n")).withColumn("k", F.size("tags")))


def set_pairs(sets: DataFrame) -> DataFrame:
    """a, b (a < b), shared: the pairs of different sets with a tag in common, and the number of these."""
    members = sets.select("set", F.explode("tags").alias("tag"))
    return block_pairs(members, "set", ["tag"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


def edge_types(posts: DataFrame, follows: DataFrame) -> DataFrame:
    """type, edges, mean_weight of the `community_edges`, which are counted by pairs of tag sets and not listed."""
    used = posts.where(~F.col("is_spam")).select("user_id", F.explode("hashtags").alias("tag")).distinct()
    _, sets = tag_sets(used)
    n, big = sets.select("set", "n"), "decimal(38,0)"
    within = sets.select((F.col("n") * (F.col("n") - 1) / 2).cast(big).alias("edges"), F.col("k").cast("bigint").alias("w"))
    across = set_pairs(sets).join(n.select(F.col("set").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("set").alias("b"), F.col("n").alias("nb")), "b")
    across = across.select((F.col("na") * F.col("nb")).cast(big).alias("edges"), F.col("shared").alias("w"))
    shared = within.unionByName(across).agg(F.sum("edges").alias("edges"), F.sum(F.col("edges").cast("double") * F.col("w")).alias("w")).where("edges > 0")
    shared = shared.select(F.lit("shared_hashtag").alias("type"), F.col("edges").cast("bigint").alias("edges"), F.round(F.col("w") / F.col("edges").cast("double"), 6).alias("mean_weight"))
    followed = follows.agg(F.count(F.lit(1)).alias("edges")).where("edges > 0").select(F.lit("follows").alias("type"), "edges", F.lit(1.0).alias("mean_weight"))
    return followed.unionByName(shared)


def most_shared(of: DataFrame, sets: DataFrame, pairs: DataFrame, follows: DataFrame, top: int) -> DataFrame:
    """user_id, candidate, shared: at least the `top` users who share most tags with each user (then by name), but for those whom the user follows; others too.

    A user needs as many more of those who share most with the user's set as
    the user follows, plus one, the user.  The lists of a set are as long as
    its users need, and take only the sets that share so many tags that the
    list is not full before.
    """
    need = of.join(counted(follows, "follower_id", "f").withColumnRenamed("_id", "user_id"), "user_id", "left").select("user_id", "set", (F.coalesce("f", F.lit(0)) + top + 1).alias("need"))
    need = cut(need)
    longest = need.groupBy("set").agg(F.max("need").alias("most"))
    both = pairs.select("a", "b", "shared").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "shared"))
    both = both.unionByName(sets.select(F.col("set").alias("a"), F.col("set").alias("b"), F.col("k").cast("bigint").alias("shared")))
    both = both.join(sets.select(F.col("set").alias("b"), "n"), "b").join(longest.withColumnRenamed("set", "a"), "a")
    # users who share more than a level's tags
    level = both.groupBy("a", "shared").agg(F.sum("n").alias("n"))
    level = level.withColumn("before", F.sum("n").over(Window.partitionBy("a").orderBy(F.desc("shared"))) - F.col("n")).select("a", "shared", "before")
    wanted = cut(both.join(level, ["a", "shared"]).where("before < most").select("a", "b", "shared", "most"))
    # no list takes more of a set than the longest that takes of it
    at = of.withColumn("i", F.row_number().over(Window.partitionBy("set").orderBy("user_id")))
    at = at.join(wanted.groupBy(F.col("b").alias("set")).agg(F.max("most").alias("m")), "set").where("i <= m").select(F.col("set").alias("b"), F.col("user_id").alias("candidate"), "i")
    listed = wanted.join(at, "b").where("i <= most").select("a", "candidate", "shared", "most")
    listed = listed.withColumn("i", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("shared"), "candidate"))).where("i <= most").select(F.col("a").alias("set"), "candidate", "shared", "i")
    return need.join(listed, "set").where("i <= need and user_id != candidate").select("user_id", "candidate", "shared")


def follow_recommender(posts: DataFrame, follows: DataFrame, top: int = 10) -> DataFrame:
    """Whom to follow: 0.6 of shared tags and 0.4 of friends of friends, each over its maximum; not whom one follows already.

    Of those who share tags but are no friends of friends, only the `top` of
    most shared tags can be among the best (a tag more outweighs the rounding of
    scores up to 600,000 shared tags): they are found by `most_shared`,
    without listing all pairs.  Friends of friends are listed all.
    """
    used = posts.select("user_id", F.explode("hashtags").alias("tag")).where("user_id is not null").distinct()
    follows = cut(follows.select("follower_id", "following_id"))
    of, sets = tag_sets(used)
    known = follows.select(F.col("follower_id").alias("user_id"), F.col("following_id").alias("candidate"))
    ab = follows.select(F.col("follower_id").alias("user_id"), F.col("following_id").alias("via"))
    bc = follows.select(F.col("follower_id").alias("via"), F.col("following_id").alias("candidate"))
    fof = ab.join(bc, "via").where("user_id != candidate").groupBy("user_id", "candidate").agg(F.count_distinct("via").alias("friends"))
    # the tags that friends of friends share, from their sets
    named = [of.select(F.col("user_id").alias(c), F.col("set").alias(s)) for c, s in (("user_id", "sa"), ("candidate", "sb"))]
    tags = [sets.select(F.col("set").alias(s), F.col("tags").alias(t)) for s, t in (("sa", "ta"), ("sb", "tb"))]
    fof = fof.join(known, ["user_id", "candidate"], "left_anti").join(named[0], "user_id", "left").join(named[1], "candidate", "left").join(tags[0], "sa", "left").join(tags[1], "sb", "left")
    fof = fof.select("user_id", "candidate", F.coalesce(F.array_size(F.array_intersect("ta", "tb")).cast("bigint"), F.lit(0)).alias("shared"), "friends")
    near = most_shared(of, sets, cut(set_pairs(sets)), follows, top).join(known, ["user_id", "candidate"], "left_anti").withColumn("friends", F.lit(0).cast("bigint"))
    df = cut(fof.unionByName(near).groupBy("user_id", "candidate").agg(F.max("shared").alias("shared"), F.max("friends").alias("friends")))
    most = df.agg(F.max("shared").alias("ms"), F.max("friends").alias("mf"))
    df = df.join(F.broadcast(most)).withColumn("score", F.round(0.6 * F.col("shared") / F.greatest("ms", F.lit(1)) + 0.4 * F.col("friends") / F.greatest("mf", F.lit(1)), 6)).drop("ms", "mf")
    df = df.withColumn("reason", F.when((F.col("shared") > 0) & (F.col("friends") > 0), "ambos").when(F.col("shared") > 0, "hashtags").otherwise("amigos"))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("score"), "candidate"))
    return df.withColumn("rank", rank).where(F.col("rank") <= top)

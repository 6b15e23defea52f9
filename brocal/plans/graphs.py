"""Queries of the property graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from brocal.operators import graph as G
from brocal.plans.social import ME, _SILVER, silver

YOU = "u_000000007"


def graph(spark, sf):
    s = silver(spark, sf)
    nodes = G.user_nodes(s["users"])
    return nodes, G.tag_nodes(s["posts"]), G.follow_edges(s["follows"], nodes), G.interest_edges(s["posts"], nodes)


def q(f):
    return lambda spark, sf: f(*graph(spark, sf))


def _flat(c):
    return F.array_join(c, " ").alias(c)


def famous(n, t, f, i):
    """The first users by id stand for famous ones."""
    names = [r["username"] for r in n.orderBy("id").limit(8).collect()]
    return G.distances_from(n, f, names, ME).select("username", "followers", "distance")


QUERIES = {
    "graph_stats": q(G.graph_stats), "graph_influencers": q(lambda n, t, f, i: G.influencers(n, f).select("id", "username", "followers")), "graph_communities": q(lambda n, t, f, i: G.communities(i)),
    "graph_bridges": q(lambda n, t, f, i: G.bridges(n, i, f).select("id", _flat("tags"), "tag_count", "followers")),
    "graph_mutual_interests": q(lambda n, t, f, i: G.mutual_interests(n, i, ME).select("id", _flat("shared_tags"), "shared_count")), "graph_tag_pairs": q(lambda n, t, f, i: G.tag_pairs(i)),
    "graph_my_communities": q(lambda n, t, f, i: G.my_communities(n, i, f, ME).select("hashtag", "size", F.array_join(F.transform("top_members", lambda m: m["id"]), " ").alias("members"))),
    "graph_community_overlap": q(lambda n, t, f, i: G.community_overlap(n, i, f, ME).select("id", _flat("shared"), "overlap", "i_follow", "follows_me")),
    "graph_shortest_path": q(lambda n, t, f, i: G.shortest_path(n, f, ME, YOU).select("distance", F.size("path").alias("nodes"))),
    "graph_ego_network": q(lambda n, t, f, i: G.ego_neighbours(n, f, ME, 2).select("id", "dist")),
    "graph_ego_edges": q(lambda n, t, f, i: G.ego_edges(G.ego_neighbours(n, f, ME, 2), f)),
    "graph_reach": q(lambda n, t, f, i: G.reach(n, f, ME)), "graph_famous": q(famous),
}

_G = _SILVER.replace("with su", "with recursive su", 1) + f""", n as (select _id id, username from su where not is_spam),
f as (select distinct follower_id src, following_id dst from sw where follower_id in (select id from n) and following_id in (select id from n)),
i as (select distinct user_id id, unnest(hashtags) tag from sp where user_id in (select id from n)),
fo as (select dst id, count(*) followers from f group by 1),
mine as (select tag from i where id = '{ME}'),
sh as (select id, array_to_string(list_sort(list(tag)), ' ') shared_tags, count(*) c from i where id != '{ME}' and tag in (select tag from mine) group by 1),
und as (select src, dst from f union select dst, src from f),
walk as (select id, 0 d from n where id = '{ME}' union select und.dst, d + 1 from walk join und on und.src = walk.id where d < 6),
fwd as (select id, 0 d from n where id = '{ME}' union select f.dst, d + 1 from fwd join f on f.src = fwd.id where d < 2),
rev as (select id, 0 d from n where id = '{ME}' union select f.src, d + 1 from rev join f on f.dst = rev.id where d < 6),
nb as (select id, min(d) dist from fwd group by 1 having min(d) > 0)
"""
SQL = {
    "graph_stats": _G + "select (select count(*) from n) users, (select count(distinct t) from (select unnest(hashtags) t from sp)) hashtags, (select count(*) from f) follows, (select count(*) from i) interests",
    "graph_influencers": _G + "select id, username, followers from n join fo using (id) order by followers desc, id limit 10",
    "graph_communities": _G + "select tag hashtag, count(*) users from i group by 1 order by 2 desc, 1 limit 10",
    "graph_bridges": _G + "select id, array_to_string(list_sort(list(tag)), ' ') tags, count(*)::int tag_count, coalesce(max(followers), 0) followers from i left join fo using (id) group by id having count(*) >= 3 order by 3 desc, 4 desc, 1 limit 10",
    "graph_mutual_interests": _G + "select id, shared_tags, c::int shared_count from sh order by c desc, id limit 10",
    "graph_tag_pairs": _G + "select a.tag tag1, b.tag tag2, count(*) shared_users from i a join i b on a.id = b.id and a.tag < b.tag group by 1, 2 order by 3 desc, 1, 2 limit 20",
    "graph_my_communities": _G + f"""select tag hashtag, count(*) as size, array_to_string(list(id order by followers desc, id)[:5], ' ') members
from (select tag, i.id, coalesce(followers, 0) followers from i left join fo on fo.id = i.id where i.id != '{ME}' and tag in (select tag from mine)) group by 1 order by 2 desc, 1 limit 8""",
    "graph_community_overlap": _G + f"select id, shared_tags shared, c::int overlap, id in (select dst from f where src = '{ME}') i_follow, id in (select src from f where dst = '{ME}') follows_me from sh order by c desc, id limit 15",
    "graph_shortest_path": _G + f"select min(d)::int distance, min(d)::int + 1 nodes from walk where id = '{YOU}' having min(d) is not null",
    "graph_ego_network": _G + "select id, dist from nb",
    "graph_ego_edges": _G + "select src source, dst target from f where src in (select id from nb) and dst in (select id from nb)",
    "graph_reach": _G + "select count(*) filter (where d <= 1) hop1, count(*) filter (where d <= 2) hop2, count(*) filter (where d <= 3) hop3 from (select id, min(d) d from rev group by 1 having min(d) between 1 and 3)",
    "graph_famous": _G + "select username, coalesce(followers, 0) followers, coalesce(d, -1) distance from (select * from n order by id limit 8) left join fo using (id) left join (select id, min(d) d from rev group by 1) using (id)",
}

"""Lookups that turn job outputs into readable tables (C19-C23, J6-J9, P7,
P8, P14, F16, F17).  Each runs for all keys at once; filter by id for one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.functions.lists import numeric_tokens, split_list
from rivulet.functions.scalars import thousands, truncate_text
from rivulet.operators.etl import keyed_sample


def popularity_lookup(ids: DataFrame, popularity: DataFrame, id_col: str = "itemId") -> DataFrame:
    """(itemId, user_count, user_count_text): 0 for ids without popularity."""
    j = ids.select(id_col).join(popularity.select(id_col, "user_count"), id_col, "left")
    n = F.coalesce(F.col("user_count"), F.lit(0)).cast("long")
    return j.select(id_col, n.alias("user_count"), thousands(n).alias("user_count_text"))


def _cards(lists: DataFrame, key: str, list_col: str, details: DataFrame, detail_key: str,
           length: int, out_key: str) -> DataFrame:
    toks = lists.select(key, F.size(split_list(list_col, ";")).alias("_n"),
                        F.posexplode(numeric_tokens(list_col, ";")).alias("_pos", out_key))
    j = toks.join(details.withColumnRenamed(detail_key, out_key), out_key, "left")
    return j.withColumn("rank", (F.col("_pos") + 1).cast("long")) \
        .withColumn("valid", F.col("_n") == length).drop("_pos", "_n")


def similar_user_cards(similar: DataFrame, users: DataFrame, length: int = 10) -> DataFrame:
    """One row per listed similar user with its profile; ``valid`` flags
    lists that do not hold exactly ``length`` ids."""
    prof = users.select("userId", "name", "gender", "age", "fans", "following")
    c = _cards(similar, "userId", "similarUsers", prof, "userId", length, "similarId")
    return c.select("userId", "rank", "similarId", "name", "gender", "age", "fans", "following", "valid")


def recommendation_cards(recs: DataFrame, items: DataFrame, length: int = 10, title_len: int = 35) -> DataFrame:
    """One row per recommended item with its card; title cut to ``title_len``."""
    card = items.select("itemId", "length", "comment", "like", "watch", "share",
                        truncate_text("name", title_len).alias("title"))
    c = _cards(recs, "userId", "itemId", card, "itemId", length, "recItem")
    return c.select("userId", "rank", F.col("recItem").alias("itemId"), "length", "comment", "like", "watch",
                    "share", "title", "valid")


def cluster_peers(members: DataFrame, key: str, k: int = 10, seed: int = 7) -> DataFrame:
    """(key, cluster, peerId, rank): up to k other members of the same cluster,
    a deterministic sample (smallest md5 of 'seed:cluster:id').

    No pairs within a cluster are formed: each cluster keeps its first k + 1
    members in sample order as one array, every member joins that row on its
    cluster, drops itself and takes the first k of the rest, so nothing is
    shuffled by member."""
    m = members.select(key, "cluster")
    sample = keyed_sample(m, "cluster", key, k + 1, seed).groupBy("cluster").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", key))), lambda x: x[key]).alias("_peers"))
    others = F.slice(F.filter("_peers", lambda x: x != F.col(key)), 1, k)
    return (m.join(sample, "cluster").select(key, "cluster", F.posexplode(others).alias("_pos", "peerId"))
            .select("cluster", key, "peerId", (F.col("_pos") + 1).cast("long").alias("rank")))


def user_peers(user_clusters: DataFrame, users: DataFrame, k: int = 10, seed: int = 7) -> DataFrame:
    peers = cluster_peers(user_clusters, "userId", k, seed)
    prof = users.select(F.col("userId").alias("peerId"), "name", "gender", "age", "fans", "following")
    return peers.join(prof, "peerId", "left").select(
        "userId", "cluster", "rank", "peerId", "name", "gender", "age", "fans", "following")


def item_peers(item_clusters: DataFrame, items: DataFrame, k: int = 10, seed: int = 7,
               title_len: int = 35) -> DataFrame:
    peers = cluster_peers(item_clusters, "itemId", k, seed)
    card = items.select(F.col("itemId").alias("peerId"), "length", "comment", "like", "watch", "share",
                        truncate_text("name", title_len).alias("title"))
    return peers.join(card, "peerId", "left").select(
        "itemId", "cluster", "rank", "peerId", "length", "comment", "like", "watch", "share", "title")

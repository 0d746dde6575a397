"""Queries: list codecs, popularity, similarity (stand-in data of FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.functions.lists import long_to_wide, numeric_tokens, wide_to_long
from rivulet.operators import popularity as pop
from rivulet.operators import similarity as sim
from rivulet.plans.registry import query
from rivulet.sources import tables as T


def wide_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer, the part keys of all its order lines joined by ';' in
    (order, line) order, with formatting noise: every third line padded with a
    blank and a tab, line 5 left empty, a trailing ';' for every fourth user."""
    li = T.read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    o = T.read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    tok = (F.when(F.col("l_linenumber") % 3 == 0,
                  F.concat(F.lit(" "), F.col("l_partkey").cast("string"), F.lit("\t")))
           .when(F.col("l_linenumber") == 5, F.lit(""))
           .otherwise(F.col("l_partkey").cast("string")))
    lines = li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("o_custkey").alias("userId"), "l_orderkey", "l_linenumber", tok.alias("tok"))
    # the token itself is the last sort key: (order, line) is not unique in the data
    wide = long_to_wide(lines, "userId", "tok", ["l_orderkey", "l_linenumber", "tok"], sep=";", out_col="itemId")
    return wide.select("userId", F.when(F.col("userId") % 4 == 0, F.concat("itemId", F.lit(";")))
                       .otherwise(F.col("itemId")).alias("itemId"))


@query("wide_to_long")
def q_wide_to_long(spark, sf_dir):
    return wide_to_long(wide_lists(spark, sf_dir), "userId", "itemId", ";", drop_blank=True, pos_col="pos")


@query("wide_to_long_keep_blank")
def q_wide_to_long_keep_blank(spark, sf_dir):
    return wide_to_long(wide_lists(spark, sf_dir), "userId", "itemId", ";", drop_blank=False, pos_col="pos")


@query("long_to_wide")
def q_long_to_wide(spark, sf_dir):
    return long_to_wide(T.interactions(spark, sf_dir), "userId", "itemId", ["itemId"], sep="; ")


@query("long_to_wide_parts")
def q_long_to_wide_parts(spark, sf_dir):
    """Bounded rows: lists cut into ordered parts of at most 16 items."""
    return long_to_wide(T.interactions(spark, sf_dir), "userId", "itemId", ["itemId"], sep="; ", max_items=16)


@query("numeric_token_list")
def q_numeric_token_list(spark, sf_dir):
    """Numeric tokens of the noisy lists with junk tokens mixed in; position
    counted after the filter, duplicates kept."""
    w = wide_lists(spark, sf_dir)
    noisy = F.concat(F.lit("x1;"), F.col("itemId"), F.lit("; 12a ;-3;"), (F.col("userId") % 10).cast("string"))
    arr = numeric_tokens(noisy, ";")
    return w.select("userId", F.posexplode(arr).alias("pos", "itemId"))


@query("item_popularity")
def q_item_popularity(spark, sf_dir):
    return pop.item_popularity(T.interactions(spark, sf_dir))


@query("item_popularity_approx_facts")
def q_item_popularity_approx_facts(spark, sf_dir):
    """Items of the sketch form, and those off by more than five standard errors and one user."""
    sketch = q_item_popularity_approx(spark, sf_dir).withColumnRenamed("user_count", "approx")
    both = pop.item_popularity(T.interactions(spark, sf_dir), ordered=False).join(sketch, "itemId", "left")
    off = F.abs(F.col("approx") - F.col("user_count")) > F.greatest(F.lit(1.0), F.col("user_count") * 0.25)
    return both.agg(F.count("approx").alias("items"), F.sum(off.cast("long")).alias("off"))


@query("item_popularity_approx")
def q_item_popularity_approx(spark, sf_dir):
    return pop.item_popularity(T.interactions(spark, sf_dir), approx=True)


@query("item_popularity_lists")
def q_item_popularity_lists(spark, sf_dir):
    """Popularity straight from the noisy wide lists, blank tokens counted."""
    return pop.popularity_from_lists(wide_lists(spark, sf_dir), drop_blank=False)


@query("user_item_sets")
def q_user_item_sets(spark, sf_dir):
    s = sim.user_item_sets(T.interactions(spark, sf_dir))
    return s.select("userId", F.array_join(F.col("items").cast("array<string>"), ";").alias("items"),
                    F.size("items").cast("bigint").alias("n_items"))


@query("item_audience")
def q_item_audience(spark, sf_dir):
    return sim.item_audience(T.interactions(spark, sf_dir))


@query("items_per_user")
def q_items_per_user(spark, sf_dir):
    return sim.items_per_user(T.interactions(spark, sf_dir))


@query("pair_cocounts")
def q_pair_cocounts(spark, sf_dir):
    pc = sim.pair_cocounts(T.interactions(spark, sf_dir), "cosine")
    return pc.select("u", "v", F.col("co").cast("bigint").alias("co"))


@query("pair_cocounts_small_buckets")
def q_pair_cocounts_small_buckets(spark, sf_dir):
    """Same co-counts with a bucket size of 8 users, so every item is split into
    several buckets: the hot-item path gives the same answer."""
    pc = sim.pair_cocounts(T.interactions(spark, sf_dir), "cosine", bucket_size=8)
    return pc.select("u", "v", F.col("co").cast("bigint").alias("co"))


@query("user_similarity_cosine")
def q_user_similarity_cosine(spark, sf_dir):
    s = sim.user_similarity(T.interactions(spark, sf_dir), "cosine")
    return s.select("userId", "otherId", F.round("sim", 6).alias("sim"))


@query("user_similarity_iif")
def q_user_similarity_iif(spark, sf_dir):
    s = sim.user_similarity(T.event_interactions(spark, sf_dir), "iif")
    return s.select("userId", "otherId", F.round("sim", 6).alias("sim"))


@query("similar_users_wide")
def q_similar_users_wide(spark, sf_dir):
    return sim.similar_users(T.interactions(spark, sf_dir), n=10)


@query("similar_users_iif")
def q_similar_users_iif(spark, sf_dir):
    return sim.similar_users(T.event_interactions(spark, sf_dir), n=10, method="iif")


@query("similar_users_hot_items")
def q_similar_users_hot_items(spark, sf_dir):
    """similar_users_iif through the hot-item path: the 8 items with the
    largest audiences are treated as hot (threshold read from the data), so
    no pairs are formed inside them; the result must not change."""
    inter = T.event_interactions(spark, sf_dir)
    sizes = sim.item_audience(inter).orderBy(F.desc("n_users")).limit(9).collect()
    threshold = sizes[-1]["n_users"] if len(sizes) == 9 else 0
    return sim.similar_users(inter, n=10, method="iif", hot_threshold=threshold)


def _text_ids(spark, sf_dir):
    inter = T.event_interactions(spark, sf_dir)
    return inter.select(F.concat(F.lit("u"), F.col("userId").cast("string")).alias("userId"),
                        F.concat(F.lit("i"), F.col("itemId").cast("string")).alias("itemId"))


@query("similar_users_text_ids")
def q_similar_users_text_ids(spark, sf_dir):
    """Text ids, every item hot: all candidates come from classes of users."""
    return sim.similar_users(_text_ids(spark, sf_dir), n=10, hot_threshold=1)


@query("similar_users_heavy")
def q_similar_users_heavy(spark, sf_dir):
    """50 heavy users with one private item per event, so nearly equal similarities;
    one hot item is common to all and one to a third."""
    ev = T.read_table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), (F.col("user_id") % 50).cast("string")).alias("userId"),
        F.col("user_id"), F.col("event_id"))
    inter = ev.select("userId", F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("itemId"))
    inter = inter.unionByName(ev.select("userId", F.lit("all").alias("itemId")))
    third = ev.where(F.col("user_id") % 50 % 3 == 0).select("userId", F.lit("third").alias("itemId"))
    return sim.similar_users(inter.unionByName(third), n=3, hot_threshold=4)


@query("usercf_text_ids")
def q_usercf_text_ids(spark, sf_dir):
    r = sim.usercf_recommend(_text_ids(spark, sf_dir), n=5, k=3, hot_threshold=20)
    return r.select("userId", "itemId", "score", F.col("rank").cast("bigint").alias("rank"))


@query("usercf_recommend")
def q_usercf_recommend(spark, sf_dir):
    r = sim.usercf_recommend(T.interactions(spark, sf_dir), n=5, k=10)
    return r.select("userId", "itemId", "score", F.col("rank").cast("bigint").alias("rank"))

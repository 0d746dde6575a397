"""Queries: cleaning, quotas, sampling, pages, events, lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivulet.functions.scalars import normalize_gender, parse_duration, strip_tags
from rivulet.operators import etl, lookup, pages
from rivulet.operators.popularity import item_popularity
from rivulet.operators.rerank import rerank
from rivulet.operators.similarity import similar_users
from rivulet.plans.registry import query
from rivulet.sources import tables as T


@query("parse_duration")
def q_parse_duration(spark, sf_dir):
    r = T.raw_items(spark, sf_dir)
    return r.select("key", "duration", parse_duration("duration").alias("length"))


@query("normalize_gender")
def q_normalize_gender(spark, sf_dir):
    r = T.raw_users(spark, sf_dir)
    return r.select("id", "sex", normalize_gender("sex", "id").alias("gender"))


@query("column_ops")
def q_column_ops(spark, sf_dir):
    """Drop a column if present, rename, fixed column order, constant rating."""
    r = T.raw_users(spark, sf_dir).drop("level").drop("no_such_column")
    r = r.withColumnsRenamed({"id": "userId", "sex": "gender_raw"})
    return r.select("userId", "name", "gender_raw", "following", "fans", F.lit(1.0).alias("rating"))


@query("drop_null_rows")
def q_drop_null_rows(spark, sf_dir):
    r = T.raw_items(spark, sf_dir).select("key", "title", parse_duration("duration").alias("length"))
    return r.na.drop(subset=["length", "title"])


@query("casts")
def q_casts(spark, sf_dir):
    r = T.raw_items(spark, sf_dir)
    return r.select("key", F.col("plays").cast("string").alias("plays_text"),
                    F.split("duration", ":")[0].try_cast("int").alias("lead_int"),
                    F.col("plays").cast("float").alias("plays_f32"))


@query("row_ids")
def q_row_ids(spark, sf_dir):
    p = T.read_table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return etl.row_ids(p, ["p_partkey"], "row_id")


@query("encode_ids")
def q_encode_ids(spark, sf_dir):
    _, dictionary = etl.encode_ids(T.interactions(spark, sf_dir), "itemId", "item_idx")
    return dictionary


@query("union_by_name")
def q_union_by_name(spark, sf_dir):
    inter = T.interactions(spark, sf_dir)
    a = inter.where(F.col("itemId") % 2 == 0).select("userId", "itemId")
    b = inter.where(F.col("itemId") % 2 == 1).select("itemId", "userId", F.lit("b").alias("src"))
    return a.unionByName(b, allowMissingColumns=True)


@query("distinct_pairs")
def q_distinct_pairs(spark, sf_dir):
    li = T.read_table(spark, sf_dir, "lineitem")
    o = T.read_table(spark, sf_dir, "orders")
    pairs = li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("o_custkey").alias("userId"), F.col("l_partkey").alias("itemId"))
    return pairs.distinct()


@query("seen_except")
def q_seen_except(spark, sf_dir):
    cand = T.event_interactions(spark, sf_dir)
    return cand.join(T.interactions(spark, sf_dir), ["userId", "itemId"], "left_anti")


@query("clean_items")
def q_clean_items(spark, sf_dir):
    return etl.clean_items(T.raw_items(spark, sf_dir))


@query("invert_lists")
def q_invert_lists(spark, sf_dir):
    return etl.invert_lists(T.items_table(spark, sf_dir))


@query("clean_users")
def q_clean_users(spark, sf_dir):
    lists = etl.invert_lists(T.items_table(spark, sf_dir))
    return etl.clean_users(T.raw_users(spark, sf_dir), lists)


@query("renumber_users")
def q_renumber_users(spark, sf_dir):
    return etl.renumber_users(T.raw_users(spark, sf_dir), ["mid"]).select("id", "mid", "name", "age")


@query("category_share_null")
def q_category_share_null(spark, sf_dir):
    s = etl.category_share(T.skewed_items(spark, sf_dir))
    return s.select("category", "cat_watch", F.round("share", 6).alias("share"))


@query("audience_quota_spread")
def q_audience_quota_spread(spark, sf_dir):
    """Quotas of 0, 20, 100 and between."""
    return _quota(spark, sf_dir, T.skewed_items(spark, sf_dir))


@query("stratified_sample_spread")
def q_stratified_sample_spread(spark, sf_dir):
    """Audiences larger than their quota, and quotas of 0."""
    quota = _quota(spark, sf_dir, T.skewed_items(spark, sf_dir)).select("itemId", "k")
    aud = T.interactions(spark, sf_dir).join(quota, "itemId")
    s = etl.keyed_sample(aud, "itemId", "userId", "k", seed=42, at_most=etl.QUOTA_HIGH)
    return s.select("itemId", "userId", F.col("rank").cast("long").alias("rank"))


@query("popularity_lookup_spread")
def q_popularity_lookup_spread(spark, sf_dir):
    """Counts beyond a thousand, and items nobody used."""
    ev = T.read_table(spark, sf_dir, "events").select(
        F.col("event_id").alias("userId"), (F.get_json_object("props", "$.k").cast("long") % 7).alias("itemId"))
    ids = T.read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("itemId"))
    return lookup.popularity_lookup(ids, item_popularity(ev, ordered=False))


@query("item_peers_long_titles")
def q_item_peers_long_titles(spark, sf_dir):
    """Peers of items whose titles are below and beyond the cut; three peers of each."""
    more = F.expr("repeat(concat(' / ', name), CAST(itemId % 4 AS INT))")
    items = T.items_table(spark, sf_dir).withColumn("name", F.concat("name", F.lit(" / "), "category", more))
    c = T.item_meta(spark, sf_dir).select("itemId", "cluster")
    return lookup.item_peers(c, items, k=3).select("itemId", "cluster", "rank", "peerId", "title")


@query("parse_duration_edges")
def q_parse_duration_edges(spark, sf_dir):
    """Hours beyond an int, missing and non-numeric parts."""
    p = T.read_table(spark, sf_dir, "part")
    k, m = F.col("p_partkey"), F.col("p_size").cast("string")
    h, s = (k.cast("long") * 9999).cast("string"), (k % 60).cast("string")
    dur = (F.when(k % 6 == 0, F.concat_ws(":", h, m, s))
           .when(k % 6 == 1, F.concat(h, F.lit("99999999999999999999:0:1")))
           .when(k % 6 == 2, F.concat(m, F.lit(":"))).when(k % 6 == 3, F.concat(F.lit("x:"), s))
           .when(k % 6 == 4, F.lit("")).otherwise(F.concat_ws(":", m, s)))
    return p.select(k.alias("key"), dur.alias("duration"), parse_duration(dur).alias("length"))


@query("json_fields_missing")
def q_json_fields_missing(spark, sf_dir):
    ev = T.read_table(spark, sf_dir, "events")
    ev = ev.withColumn("props", F.when(F.col("event_id") % 3 == 0, F.lit('{"other": 1}')).otherwise(F.col("props")))
    return pages.event_fields(ev).select("event_id", "k")


@query("category_share")
def q_category_share(spark, sf_dir):
    s = etl.category_share(etl.clean_items(T.raw_items(spark, sf_dir)))
    return s.select("category", "cat_watch", F.round("share", 6).alias("share"))


def _quota(spark, sf_dir, items):
    n_users = T.read_table(spark, sf_dir, "customer").count()
    return etl.audience_quota(items, n_users)


@query("audience_quota")
def q_audience_quota(spark, sf_dir):
    return _quota(spark, sf_dir, etl.clean_items(T.raw_items(spark, sf_dir)))


@query("stratified_sample")
def q_stratified_sample(spark, sf_dir):
    """Per item, up to its quota k (20..100) of its actual audience, sampled by
    md5 of '42:item:user'."""
    quota = _quota(spark, sf_dir, T.items_table(spark, sf_dir)).select("itemId", "k")
    aud = T.interactions(spark, sf_dir).join(quota, "itemId")
    s = etl.keyed_sample(aud, "itemId", "userId", "k", seed=42, at_most=etl.QUOTA_HIGH)
    return s.select("itemId", "userId", F.col("rank").cast("long").alias("rank"))


@query("page_fields")
def q_page_fields(spark, sf_dir):
    return pages.page_fields(T.read_table(spark, sf_dir, "pages"))


@query("strip_tags")
def q_strip_tags(spark, sf_dir):
    return T.read_table(spark, sf_dir, "pages").select("page_id", strip_tags("html").alias("text"))


@query("level_class")
def q_level_class(spark, sf_dir):
    from rivulet.functions.scalars import LEVEL_MARKERS, first_match_class
    p = T.read_table(spark, sf_dir, "pages")
    return p.select("page_id", first_match_class("html", LEVEL_MARKERS).alias("level"),
                    first_match_class("url", pages.SECTIONS).alias("section"))


@query("json_fields")
def q_json_fields(spark, sf_dir):
    return pages.event_fields(T.read_table(spark, sf_dir, "events")).select("event_id", "k")


@query("epoch_format")
def q_epoch_format(spark, sf_dir):
    return pages.event_fields(T.read_table(spark, sf_dir, "events")).select("event_id", "epoch", "ts_text")


@query("popularity_lookup")
def q_popularity_lookup(spark, sf_dir):
    ids = T.read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("itemId"))
    return lookup.popularity_lookup(ids, item_popularity(T.interactions(spark, sf_dir), ordered=False))


@query("similar_user_cards")
def q_similar_user_cards(spark, sf_dir):
    sim = similar_users(T.interactions(spark, sf_dir), n=10)
    return lookup.similar_user_cards(sim, T.users_table(spark, sf_dir))


@query("recommendation_cards")
def q_recommendation_cards(spark, sf_dir):
    recs = rerank(T.ranked_lists(spark, sf_dir), T.item_meta(spark, sf_dir))
    return lookup.recommendation_cards(recs, T.items_table(spark, sf_dir))


@query("user_peers")
def q_user_peers(spark, sf_dir):
    c = T.read_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("userId"), F.col("c_nationkey").alias("cluster"))
    return lookup.user_peers(c, T.users_table(spark, sf_dir))


@query("item_peers")
def q_item_peers(spark, sf_dir):
    c = T.item_meta(spark, sf_dir).select("itemId", "cluster")
    return lookup.item_peers(c, T.items_table(spark, sf_dir))

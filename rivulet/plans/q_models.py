"""Queries: features, k-means, re-ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivulet.functions.lists import count_splits, long_to_wide
from rivulet.operators import clusters as cl
from rivulet.operators import minibatch as mb
from rivulet.operators import rerank as rr
from rivulet.plans.q_lists import wide_lists
from rivulet.plans.registry import query
from rivulet.sources import tables as T

K_ASSIGN = 8


@query("user_features")
def q_user_features(spark, sf_dir):
    return cl.user_features(T.users_table(spark, sf_dir))


@query("item_features")
def q_item_features(spark, sf_dir):
    return cl.item_features(T.items_table(spark, sf_dir))


@query("count_splits")
def q_count_splits(spark, sf_dir):
    w = wide_lists(spark, sf_dir)
    return w.select("userId", count_splits("itemId").cast("bigint").alias("n_tokens"))


def _points_and_centroids(spark, sf_dir):
    e = T.read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return e, e.where(F.col("vec_id") < K_ASSIGN)


@query("kmeans_assign")
def q_kmeans_assign(spark, sf_dir):
    pts, cen = _points_and_centroids(spark, sf_dir)
    a = cl.kmeans_assign(pts, cen)
    return a.select("vec_id", "cluster", F.round("dist", 6).alias("dist"))


@query("kmeans_step")
def q_kmeans_step(spark, sf_dir):
    pts, cen = _points_and_centroids(spark, sf_dir)
    s = cl.kmeans_step(pts, cen)
    return s.select("cluster", F.col("dim").cast("bigint").alias("dim"), F.round("value", 6).alias("value"), "n")


@query("kmeans_users")
def q_kmeans_users(spark, sf_dir):
    feats = cl.user_features(T.users_table(spark, sf_dir))
    return cl.kmeans(feats, cl.USER_FEATURES, k=20).select("userId", "cluster")


@query("kmeans_items")
def q_kmeans_items(spark, sf_dir):
    feats = cl.item_features(T.items_table(spark, sf_dir))
    return cl.kmeans(feats, cl.ITEM_FEATURES, k=50).select("itemId", "cluster")


def _cluster_facts(feats, features, k):
    """Rows, ids and labels of a fit, and the rows that are not labelled with their nearest centre."""
    labelled, centres = cl.kmeans(feats, features, k=k, with_centres=True)
    off = mb.rows_off_nearest(labelled, features, centres).first()["n_off"]
    return labelled.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(labelled.columns[0]).alias("n_ids"),
                        F.sum((F.coalesce("cluster", F.lit(-1)).between(0, k - 1)).cast("long")).alias("labelled"),
                        (F.countDistinct("cluster") > 1).alias("parted"), F.lit(off).cast("long").alias("n_off"))


@query("kmeans_users_facts")
def q_kmeans_users_facts(spark, sf_dir):
    return _cluster_facts(cl.user_features(T.users_table(spark, sf_dir)), cl.USER_FEATURES, 20)


@query("kmeans_items_facts")
def q_kmeans_items_facts(spark, sf_dir):
    return _cluster_facts(cl.item_features(T.items_table(spark, sf_dir)), cl.ITEM_FEATURES, 50)


#: Steps of the checked mini-batch fits; they start from the first keyed rows and move no centre.
CHECKED_BATCHES = 6


@query("kmeans_minibatch_users")
def q_kmeans_minibatch_users(spark, sf_dir):
    feats = cl.user_features(T.users_table(spark, sf_dir))
    return mb.kmeans_minibatch(feats, cl.USER_FEATURES, 20, "userId", mb.USER_BATCH, batches=CHECKED_BATCHES, reassign=0.0,
                               patience=None, init="first").select("userId", "cluster")


@query("kmeans_minibatch_items")
def q_kmeans_minibatch_items(spark, sf_dir):
    feats = cl.item_features(T.items_table(spark, sf_dir))
    return mb.kmeans_minibatch(feats, cl.ITEM_FEATURES, 50, "itemId", mb.ITEM_BATCH, batches=CHECKED_BATCHES, reassign=0.0,
                               patience=None, init="first").select("itemId", "cluster")


@query("kmeans_minibatch_facts")
def q_kmeans_minibatch_facts(spark, sf_dir):
    """The whole method (spread start, lost centres moved, early stop): every row has its nearest centre, and the
    batches came closer to the centres than they were to the first ones."""
    parts = []
    for name, feats, features, key, size, k in (
            ("users", cl.user_features(T.users_table(spark, sf_dir)), cl.USER_FEATURES, "userId", mb.USER_BATCH, 20),
            ("items", cl.item_features(T.items_table(spark, sf_dir)), cl.ITEM_FEATURES, "itemId", mb.ITEM_BATCH, 50)):
        feats = mb.written_once(feats)
        model = mb.fit_minibatch(feats, features, k, key, size, batches=15)
        labelled = mb.label_rows(feats, model, features)
        facts = mb.rows_off_nearest(labelled, features, model.centres, model.means)
        parts.append(facts.select(F.lit(name).alias("side"), "n_rows", "n_off", F.lit(len(model.centres)).cast("long").alias("centres"),
                                  F.lit(min(model.inertia) <= model.inertia[0]).alias("closer")))
    return parts[0].unionByName(parts[1])


@query("streak_cap")
def q_streak_cap(spark, sf_dir):
    known = rr.known_items(T.ranked_lists(spark, sf_dir), T.item_meta(spark, sf_dir))
    s = rr.streak_cap(known, 5)
    return s.select("userId", "pos", "itemId", F.col("run").cast("bigint").alias("run"),
                    F.col("run_idx").cast("bigint").alias("run_idx"))


@query("rerank")
def q_rerank(spark, sf_dir):
    return rr.rerank(T.ranked_lists(spark, sf_dir), T.item_meta(spark, sf_dir))


@query("rerank_from_wide")
def q_rerank_from_wide(spark, sf_dir):
    """The same lists written as '; ' strings with junk tokens around them,
    parsed back (numeric tokens only) and re-ranked: equals 'rerank'."""
    wide = long_to_wide(T.ranked_lists(spark, sf_dir), "userId", "itemId", ["pos"], sep="; ")
    noisy = wide.select("userId", F.concat(F.lit("x; "), F.col("itemId"), F.lit("; -1;")).alias("itemId"))
    return rr.rerank(rr.lists_from_wide(noisy), T.item_meta(spark, sf_dir))

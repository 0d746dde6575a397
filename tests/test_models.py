"""Invariants for the iterative models (no SQL oracle possible)."""

import numpy as np
from pyspark.sql import functions as F

from rivulet.operators import clusters as cl
from rivulet.operators import factors as fac
from rivulet.sources import tables as T

SF = "/root/testdata/sf0.001"


def test_als_recommend_invariants(spark):
    inter = T.interactions(spark, SF)
    uf, itf = fac.train_factors(inter, rank=8, max_iter=5)
    recs = fac.factor_recommend(uf, itf, inter, n=5, user_bias=None, item_bias=None).cache()
    assert recs.join(inter, ["userId", "itemId"], "left_semi").count() == 0        # nothing seen
    assert recs.where((F.col("score") < 0) | (F.col("score") > 1)).count() == 0
    per_user = recs.groupBy("userId").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("mx"),
                                          F.min("rank").alias("r1"))
    assert per_user.where("n > 5 OR r1 != 1").count() == 0
    assert per_user.where("mx < 1.0").count() == 0      # best unseen item scales to 1
    ranks = recs.groupBy("userId").agg(F.sort_array(F.collect_list("rank")).alias("r")).collect()
    assert all(r.r == list(range(1, len(r.r) + 1)) for r in ranks)


def test_kmeans_invariants(spark):
    feats = cl.item_features(T.items_table(spark, SF))
    out = cl.kmeans(feats, cl.ITEM_FEATURES, k=5, max_iter=10).cache()
    assert out.count() == feats.count()
    assert out.where("cluster < 0 OR cluster >= 5").count() == 0
    # every row carries the label of its nearest centre: recompute centres and re-assign
    pdf = out.toPandas()
    X = pdf[cl.ITEM_FEATURES].to_numpy(dtype=float)
    centres = np.stack([X[pdf.cluster == c].mean(axis=0) for c in sorted(pdf.cluster.unique())])
    labels = sorted(pdf.cluster.unique())
    d = ((X[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2)
    nearest = np.array(labels)[d.argmin(axis=1)]
    assert (nearest == pdf.cluster.to_numpy()).mean() > 0.99


def test_kmeans_cost_does_not_rise(spark):
    pts = T.read_table(spark, SF, "embeddings").select("vec_id", "embedding")
    cen = pts.where("vec_id < 6")
    costs = []
    for _ in range(3):
        a = cl.kmeans_assign(pts, cen)
        costs.append(a.agg(F.sum("dist")).first()[0])
        step = cl.kmeans_step(pts, cen)
        rows = step.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("dim", "value"))).alias("v"))
        cen = rows.select(F.col("cluster").cast("long").alias("vec_id"),
                          F.transform("v", lambda x: x["value"].cast("float")).alias("embedding"))
    assert costs[1] <= costs[0] + 1e-9 and costs[2] <= costs[1] + 1e-9


def test_factors_of_ids_of_any_type(spark):
    inter = T.interactions(spark, SF).where("userId < 60")
    big = inter.select((F.col("userId") + (1 << 40)).alias("userId"), F.col("itemId").cast("string").alias("itemId"))
    assert fac._small_integers(inter) and not fac._small_integers(big) and not fac._small_integers(big.select("userId", F.col("userId").alias("itemId")))
    for pairs in (inter, big):
        uf, itf = fac.train_factors(pairs, rank=3, max_iter=2)
        assert uf.dtypes[0] == pairs.dtypes[0] and itf.dtypes[0] == pairs.dtypes[1]
        assert {r[0] for r in uf.select("userId").collect()} == {r[0] for r in pairs.select("userId").distinct().collect()}
        assert {r[0] for r in itf.select("itemId").collect()} == {r[0] for r in pairs.select("itemId").distinct().collect()}

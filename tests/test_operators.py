"""Operators against brute-force Python models on small fixtures."""

import itertools
import math
import random
from collections import Counter
from itertools import groupby, islice
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rivulet.operators import clusters as cl, scoring
from rivulet.operators import etl, factors, lookup, rerank, similarity
from rivulet.operators.popularity import item_popularity, popularity_from_lists


def test_popularity_edges(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, None), (3, ""), (3, "b"), (4, "b")],
                               "userId long, itemId string")
    got = [(r.itemId, r.user_count) for r in item_popularity(df).collect()]
    assert got == [("a", 2), ("b", 2), ("", 1)]            # null item dropped, ties by id
    wide = spark.createDataFrame([(1, "a; b;"), (2, "a")], "userId long, itemId string")
    p = {r.itemId: r.user_count for r in popularity_from_lists(wide).collect()}
    assert p == {"a": 2, "b": 1, "": 1}
    p2 = {r.itemId: r.user_count for r in popularity_from_lists(wide, drop_blank=True).collect()}
    assert p2 == {"a": 2, "b": 1}


def _brute_sims(pairs, method):
    items = defaultdict(set)
    users = defaultdict(set)
    for u, i in pairs:
        items[i].add(u)
        users[u].add(i)
    co = defaultdict(float)
    for i, us in items.items():
        w = 1.0 if method == "cosine" else 1.0 / math.log(1 + len(us))
        for a, b in itertools.permutations(us, 2):
            co[(a, b)] += w
    return {k: v / math.sqrt(len(users[k[0]]) * len(users[k[1]])) for k, v in co.items()}


@pytest.mark.parametrize("method", ["cosine", "iif"])
@pytest.mark.parametrize("bucket", [3, 2048])
def test_similarity_with_hot_item(spark, method, bucket):
    rng = random.Random(5)
    pairs = {(u, 0) for u in range(40)}                     # one item every user has
    pairs |= {(rng.randrange(40), rng.randrange(1, 15)) for _ in range(120)}
    pairs |= {(100, 50), (101, 50), (102, 51)}              # identical pair, a loner
    df = spark.createDataFrame(sorted(pairs), "userId long, itemId long")
    got = {(r.userId, r.otherId): r.sim for r in similarity.user_similarity(df, method, bucket).collect()}
    exp = _brute_sims(pairs, method)
    assert set(got) == set(exp)
    assert all(abs(got[k] - exp[k]) < 1e-12 for k in exp)
    ident = 1.0 if method == "cosine" else 1.0 / math.log(3)    # identical users, item of 2 users
    assert abs(got[(100, 101)] - ident) < 1e-12 and all(k[0] != 102 for k in got)


def _brute_topk(pairs, method, k):
    sims = _brute_sims(pairs, method)
    by = defaultdict(list)
    for (u, v), x in sims.items():
        by[u].append((-round(x, 10), v))
    return {u: [v for _, v in sorted(c)[:k]] for u, c in by.items()}


@pytest.mark.parametrize("method", ["cosine", "iif"])
def test_nearest_users_hot_item_path(spark, method):
    rng = random.Random(9)
    pairs = set()
    for u in range(120):
        if u % 3:                                            # two hot items with large audiences
            pairs.add((u, 0))
        if u % 4 == 0:
            pairs.add((u, 1))
        for _ in range(rng.choice([0, 1, 2, 4])):
            pairs.add((u, rng.randrange(2, 40)))
    pairs |= {(500, 0), (501, 0), (501, 1)}                   # users with hot items only
    df = spark.createDataFrame(sorted(pairs), "userId long, itemId long")
    d = similarity.materialized_interactions(df)
    got_rows = similarity.nearest_users(d, 5, method, bucket_size=7, distinct=True, hot_threshold=25)
    got = defaultdict(list)
    for r in sorted(got_rows.collect(), key=lambda r: (r.userId, r.rank)):
        got[r.userId].append(r.otherId)
    assert dict(got) == _brute_topk(pairs, method, 5)


@pytest.mark.parametrize("ids", ["long", "string"])
def test_nearest_users_same_for_every_threshold(spark, ids):
    # users with many private items and nearly tied similarities, some exactly tied, and common items
    pairs = set()
    for u in range(12):
        pairs |= {(u, 10_000 * (u + 1) + i) for i in range(2000 + u // 3)}
        pairs.add((u, 0))
        pairs |= {(u, j) for j in (1, 2, 3) if u % (j + 1) == 0}
        pairs |= {(u, 5) for _ in range(u in (4, 7))}
    df = spark.createDataFrame(sorted(pairs), "userId long, itemId long")
    df = df.select(*[F.col(c).cast(ids).alias(c) for c in df.columns])
    rows = {}
    for t in (None, 0, 1, 2, 4, 6, 11, 12):
        got = similarity.nearest_users(df, 2, "iif", bucket_size=5, hot_threshold=t).collect()
        rows[t] = sorted((r.userId, r["rank"], r.otherId, r.sim) for r in got)
    assert len(rows[None]) == 24 and all(r == rows[None] for r in rows.values())


def test_similar_users_and_usercf(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (2, "c"), (3, "a"), (4, "z"),
                                (5, "  "), (6, "b"), (6, "c")], "userId long, itemId string")
    su = {r.userId: r.similarUsers for r in similarity.similar_users(df, n=2).collect()}
    assert su[4] == "" and 5 not in su                       # no neighbour; all-blank user vanishes
    assert su[1] == "2;3"                                    # 0.816 (2), 0.707 (3), 0.5 (6)
    recs = similarity.usercf_recommend(df, n=5, k=10).collect()
    got = {(r.userId, r.itemId) for r in recs}
    assert (1, "c") in got and (99, "a") not in got
    assert all(not (u == 2) for u, _ in got)                 # user 2 saw everything its neighbours saw


def _brute_factor(U, V, bu, bi, seen, n):
    out = {}
    for u, fu in U.items():
        sc = {i: float(np.dot(np.float64(fu), np.float64(fv))) + bu[u] + bi[i] for i, fv in V.items()
              if (u, i) not in seen}
        if not sc:
            continue
        mn, mx = min(sc.values()), max(sc.values())
        den = 1.0 if mx == mn else mx - mn
        order = sorted(sc, key=lambda i: (-round(sc[i], 9), i))[:n]
        out[u] = [(i, round((sc[i] - mn) / den, 4)) for i in order]
    return out


@pytest.mark.parametrize("slice_bytes", [256 << 20, 200])
def test_factor_recommend_brute_force(spark, slice_bytes):
    rng = np.random.default_rng(3)
    U = {u: rng.normal(size=4).astype(np.float32).tolist() for u in range(12)}
    V = {i: rng.normal(size=4).astype(np.float32).tolist() for i in range(100, 130)}
    V[200] = V[100]                                          # exact tie with item 100
    bu = {u: 0.3 * u for u in U}
    bi = {i: (0.5 if i % 3 == 0 else 0.0) for i in V}
    seen = {(u, i) for u in U for i in V if (u * 7 + i) % 5 == 0}
    seen |= {(11, i) for i in V}                             # user 11 saw everything
    seen |= {(10, i) for i in V if i != 106}                 # user 10 has one unseen item
    ud = spark.createDataFrame([(u, f, bu[u]) for u, f in U.items()], "userId long, features array<float>, bias double")
    idf = spark.createDataFrame([(i, f, bi[i]) for i, f in V.items()], "itemId long, features array<float>, bias double")
    sd = spark.createDataFrame(sorted(seen), "userId long, itemId long")
    rows = factors.factor_recommend(ud, idf, sd, n=5, max_slice_bytes=slice_bytes).collect()
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.userId, r.rank)):
        got[r.userId].append((r.itemId, r.score))
    exp = _brute_factor(U, V, bu, bi, seen, 5)
    assert dict(got) == exp
    assert 11 not in got and got[10] == [(106, 0.0)]


def test_factor_candidates_keep_n_rows_per_user_and_block(spark):
    rng = np.random.default_rng(5)
    users = spark.createDataFrame([(f"u{i}", rng.normal(size=4).tolist()) for i in range(20)],
                                  "userId string, features array<double>")
    items = spark.createDataFrame([(f"i{i}", rng.normal(size=4).tolist()) for i in range(400)],
                                  "itemId string, features array<double>")
    seen = spark.createDataFrame([(f"u{u}", f"i{i}") for u in range(20) for i in range(u, u + 100)],
                                 "userId string, itemId string")
    blocks = factors._blocks(20, 400, 4, 2000, spark.sparkContext.defaultParallelism)[1]
    assert blocks > 5
    cand = factors.factor_candidates(users, items, seen, 3, max_slice_bytes=2000)
    assert cand.count() <= 20 * blocks * 3 and cand.join(seen, ["userId", "itemId"], "left_semi").count() == 0
    small = factors.factor_recommend(users, items, seen, 3, max_slice_bytes=2000).collect()
    assert sorted(small) == sorted(factors.factor_recommend(users, items, seen, 3).collect()) and len(small) == 60


def test_train_factors_any_id_type(spark):
    big = [(f"user {u}", 2 ** 40 + i) for u in range(12) for i in range(10) if (u + i) % 3]
    uf, itf = factors.train_factors(spark.createDataFrame(big, "userId string, itemId long"), rank=3, max_iter=2)
    assert {r.userId for r in uf.collect()} == {u for u, _ in big}
    assert {r.itemId for r in itf.collect()} == {i for _, i in big}


def test_factor_loss_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    U = {u: rng.normal(size=3).astype(np.float32).tolist() for u in range(6)}
    V = {i: rng.normal(size=3).astype(np.float32).tolist() for i in range(10, 15)}
    seen = {(0, 10), (1, 11), (5, 14), (5, 10)}
    ud = spark.createDataFrame([(u, f, 0.1 * u) for u, f in U.items()], "userId long, features array<float>, bias double")
    idf = spark.createDataFrame([(i, f, 0.01 * i) for i, f in V.items()], "itemId long, features array<float>, bias double")
    sd = spark.createDataFrame(sorted(seen), "userId long, itemId long")
    got = factors.factor_loss(ud, idf, sd, reg=0.01).first()
    errs, sq = [], 0.0
    for u, fu in U.items():
        for i, fv in V.items():
            p = float(np.dot(np.float64(fu), np.float64(fv))) + 0.1 * u + 0.01 * i
            errs.append((p - (1.0 if (u, i) in seen else 0.0)) ** 2)
    sq = sum(float(np.dot(np.float64(f), np.float64(f))) for f in list(U.values()) + list(V.values()))
    sq += sum((0.1 * u) ** 2 for u in U) + sum((0.01 * i) ** 2 for i in V)
    assert abs(got.mse - round(np.mean(errs), 6)) < 1e-6
    assert abs(got.loss - round(np.mean(errs) + 0.005 * sq, 6)) < 1e-6


# ---- re-rank: window form against a plain sequential statement of the rules

def _rerank_model(ids, meta, length=10, max_run=5, cold=500, min_clusters=3):
    """The rules one by one: runs by grouping, slots by position, each replacement from counts of clusters."""
    runs = groupby((v for v in ids if v in meta), key=lambda v: meta[v][0])
    slots = [v for _, run in runs for v in islice(run, max_run)][:length]
    if len(slots) < length:
        return slots
    later = [v for v in ids[length:] if v in meta]
    watch = [meta[v][1] for v in slots]
    fresh = [v for v in later if meta[v][1] < cold]
    if min(watch) >= cold and fresh:
        slots[watch.index(max(watch))] = fresh[0]
    held = Counter(meta[v][0] for v in slots)
    other = [v for v in later if meta[v][0] not in held]
    spare = [i for i, v in enumerate(slots) if held[meta[v][0]] > 1]
    # a slot may go if its cluster stays; one more cluster must then be enough
    if len(held) == min_clusters - 1 and other and spare:
        slots[spare[0]] = other[0]
    return slots


@pytest.mark.parametrize("prefix", [1000, 12, 3])
def test_rerank_randomised(spark, prefix):
    rng = random.Random(11)
    meta = {i: (rng.choice([0, 0, 0, 1, 2]), rng.choice([100, 600, 700, 900, 900, 1200])) for i in range(60)}
    lists = {}
    for u in range(400):
        n = rng.choice([3, 9, 12, 20, 30])
        lists[u] = [rng.randrange(70) for _ in range(n)]     # ids >= 60 have no metadata
    rows = [(u, p, i) for u, ids in lists.items() for p, i in enumerate(ids)]
    ldf = spark.createDataFrame(rows, "userId long, pos int, itemId long")
    mdf = spark.createDataFrame([(i, c, w) for i, (c, w) in meta.items()], "itemId long, cluster int, watch long")
    got = {r.userId: r.itemId for r in rerank.rerank(ldf, mdf, prefix=prefix).collect()}
    exp = {u: "; ".join(map(str, _rerank_model(ids, meta))) for u, ids in lists.items()}
    exp = {u: s for u, s in exp.items() if s}
    assert got == exp


def test_rerank_rejects_duplicate_meta(spark):
    lists = spark.createDataFrame([(1, 0, 5)], "userId long, pos int, itemId long")
    meta = spark.createDataFrame([(5, 0, 100), (5, 1, 900)], "itemId long, cluster int, watch long")
    with pytest.raises(ValueError):
        rerank.rerank(lists, meta)


@pytest.mark.parametrize("reuse", ["true", "false"])
def test_row_ids_many_partitions(spark, reuse):
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    try:
        df = spark.range(0, 5000).select((F.col("id") * 7 % 5003).alias("k"))
        out = etl.row_ids(df, ["k"], "rid", partitions=7).collect()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    pairs = sorted((r.k, r.rid) for r in out)
    assert [p[1] for p in pairs] == list(range(1, 5001))


def test_kmeans_assign_same_for_every_block_size(spark, monkeypatch):
    rng = np.random.default_rng(2)
    pts = spark.createDataFrame([(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(200)]
                                + [(999, None)], "vec_id long, embedding array<float>")
    cen = pts.where("vec_id < 5")
    a = {r.vec_id: (r.cluster, r.dist) for r in cl.kmeans_assign(pts, cen).collect()}
    monkeypatch.setattr(cl, "BLOCK_CELLS", 1)
    b = {r.vec_id: (r.cluster, r.dist) for r in cl.kmeans_assign(pts, cen).collect()}
    assert a == b and all(a[i] == (i, 0.0) for i in range(5)) and a[999] == (None, None)
    X = {r.vec_id: np.array(r.embedding, dtype=float) for r in pts.where("vec_id < 999").collect()}
    assert all(a[i][0] == min(range(5), key=lambda c: ((x - X[c]) ** 2).sum()) for i, x in X.items())
    monkeypatch.setattr(cl, "MAX_MODEL_BYTES", 8)
    with pytest.raises(ValueError):
        cl.kmeans_assign(pts, cen)


def test_kmeans_labels_every_row(spark):
    df = spark.createDataFrame([(i, float(i % 7), None if i % 5 == 0 else float(i % 3)) for i in range(100)],
                               "id long, x double, y double")
    out = cl.kmeans(df, ["x", "y"], k=3)
    assert out.count() == 100 and out.where("cluster < 0 OR cluster >= 3").count() == 0
    assert out.columns == ["id", "x", "y", "cluster"]


def test_cluster_peers(spark):
    members = spark.createDataFrame([(i, i % 3) for i in range(40)] + [(99, 7)], "userId long, cluster int")
    peers = lookup.cluster_peers(members, "userId", k=10).collect()
    by = defaultdict(list)
    for r in peers:
        by[r.userId].append(r)
    assert 99 not in by                                       # alone in its cluster: no peers
    for u, rs in by.items():
        assert len(rs) == 10 and all(r.peerId != u and r.cluster == u % 3 for r in rs)
        assert all(r.peerId % 3 == u % 3 for r in rs)


def test_quota_rounding(spark):
    # pool of 'a' = round(200 / 2e7 * 1000 * 100) = 1 user; item 1: 100 * 45/200 = 22.5 -> 22
    # (half to even), item 2: 77.5 -> 78; 'b' has no watch -> 0; 'c' clamps to 100; 'd' to 20
    items = spark.createDataFrame([(1, "a", 45), (2, "a", 155), (3, "b", 0), (4, "c", 19_999_000),
                                   (5, "d", 800), (6, "d", 0)], "itemId long, category string, watch long")
    q = {r.itemId: r.k for r in etl.audience_quota(items, n_users=1000).collect()}
    assert q == {1: 22, 2: 78, 3: 0, 4: 100, 5: 100, 6: 20}


def test_invert_and_clean_users(spark):
    items = spark.createDataFrame([(1, "3; 4"), (2, "4;;3 "), (3, None)], "itemId long, userId string")
    inv = {r.userId: r.itemId for r in etl.invert_lists(items).collect()}
    assert inv == {"3": "1; 2", "4": "1; 2"}
    raw = spark.createDataFrame([(3, "m3", "a", "男", 5, 3000, 2, 30), (4, "m4", "b", "保密", 1, 100, -1, 9),
                                 (5, "m5", "c", "女", 0, 0, 6, 99)],
                                "id long, mid string, name string, sex string, following long, fans long, level int, "
                                "age int")
    cu = {r.userId: r for r in etl.clean_users(raw, etl.invert_lists(items)).collect()}
    assert set(cu) == {"3", "4"} and cu["3"].gender == "M" and cu["3"].age == 30 and cu["4"].age == 14
    ids = {r.mid: (r.id, r.age) for r in etl.renumber_users(raw, ["name"]).collect()}
    assert ids == {"m3": (1, 30), "m4": (2, 14), "m5": (3, 60)}


def test_scorer_takes_tied_items_by_id():
    A = np.array([[1.0, 1.0, 1.0, 1.0],      # all tied: the first items
                  [3.0, 1.0, 2.0, 1.0],      # tie at the k-th value: smaller item first
                  [5.0, 4.0, 3.0, 2.0]])
    none = np.zeros(0, np.int64)
    block = scoring.ItemBlock(np.eye(4), np.zeros(4))
    for n, want in ((2, [{0, 1}, {1, 3}, {2, 3}]), (3, [{0, 1, 2}, {1, 2, 3}, {1, 2, 3}]), (9, [{0, 1, 2, 3}] * 3)):
        row, pos, *_ = block.best_unseen(-A, np.zeros(3), none, none, n)
        assert [set(pos[row == i].tolist()) for i in range(3)] == want


def test_rerank_long_list_candidates_beyond_prefix(spark):
    # one user with 3,000 known items, all warm and in clusters 0/1, except a
    # cold item at position 2,500 and a cluster-2 item at position 2,700
    meta = {i: (i % 2, 900) for i in range(3000)}
    meta[5000] = (0, 100)
    meta[6000] = (2, 900)
    ids = list(range(2500)) + [5000] + list(range(2500, 2700)) + [6000] + list(range(2700, 3000))
    ldf = spark.createDataFrame([(1, p, i) for p, i in enumerate(ids)], "userId long, pos int, itemId long")
    mdf = spark.createDataFrame([(i, c, w) for i, (c, w) in meta.items()], "itemId long, cluster int, watch long")
    got = rerank.rerank(ldf, mdf, prefix=1000).collect()
    assert got[0].itemId == "; ".join(map(str, _rerank_model(ids, meta)))
    # the cold item takes slot 1 (all slots tie on watch), then the new-cluster
    # item evicts it from slot 1, the first slot whose cluster repeats
    assert got[0].itemId.startswith("6000; ") and "5000" not in got[0].itemId

"""Mini-batch k-means and biased factors against plain numpy."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rivulet.operators import biased, factors, minibatch as mb

FEATURES = ["a", "b"]


def points(spark, n=90, seed=1):
    rng = random.Random(seed)
    rows = [(f"r{i}", float(rng.choice([0, 100, 900]) + rng.randint(0, 20)), None if i % 11 == 0 else float(rng.randint(0, 50)), "x") for i in range(n)]
    return rows, spark.createDataFrame([*rows, (None, 5000.0, 1.0, "x")], "id string, a double, b double, centre string")


def by_hand(rows, k, size, batches):
    mean = [np.mean([r[i] for r in rows + [(None, 5000.0, 1.0)] if r[i] is not None]) for i in (1, 2)]
    x = {r[0]: np.array([r[i] if r[i] is not None else mean[i - 1] for i in (1, 2)]) for r in rows}
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    first, seen = [], set()
    for i in sorted(x, key=md5):
        if tuple(x[i]) not in seen and len(first) < k:
            first.append(x[i])
            seen.add(tuple(x[i]))
    centre, total, count = np.array(first), np.zeros((len(first), 2)), np.zeros(len(first))
    nb = max(1, -(-len(rows) // size))
    for t in range(batches):
        mine = [v for i, v in x.items() if int(md5(f"{i}:{t // nb}")[:8], 16) % nb == t % nb]
        near = [int(((v - centre) ** 2).sum(axis=1).argmin()) for v in mine]
        for c, v in zip(near, mine):
            total[c] += v
            count[c] += 1
        for c in set(near):
            centre[c] = total[c] / count[c]
    return x, centre


@pytest.mark.parametrize("size,batches", [(20, 9), (1000, 3)])
def test_steps_equal_numpy(spark, size, batches):
    rows, df = points(spark)
    x, centre = by_hand(rows, 5, size, batches)
    model = mb.fit_minibatch(df, FEATURES, 5, "id", size, batches=batches, reassign=0.0, patience=None, init="first")
    assert np.allclose(model.centres, centre, rtol=1e-12) and model.moved == 0
    got = {r.id: r.cluster for r in mb.label_rows(df, model, FEATURES).where("id IS NOT NULL").collect()}
    assert got == {i: int(((v - centre) ** 2).sum(axis=1).argmin()) for i, v in x.items()}


def test_batches_are_a_part_of_the_rows_and_cover_an_epoch(spark):
    df = spark.range(4000).select(F.col("id"), F.array(F.col("id").cast("double")).alias(mb.VEC))
    few = mb.keyed_batches(df, "id", 4000, 100, 3)
    assert 200 < few.count() < 400 and {r.batch for r in few.select("batch").distinct().collect()} == {0, 1, 2}
    whole = mb.keyed_batches(df, "id", 4000, 1000, 9)  # two epochs and a batch
    counts = {r.id: r["count"] for r in whole.where("batch < 8").groupBy("id").count().collect()}
    assert len(counts) == 4000 and set(counts.values()) == {2}


def test_lost_centres_move_and_rows_have_their_nearest(spark):
    rows = [(i, float(i % 3 * 1000), 0.0) for i in range(60)] + [(100 + i, 1e6 + i, 1e6) for i in range(6)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    stuck = mb.fit_minibatch(df, FEATURES, 4, "id", 66, batches=6, reassign=0.0, patience=None, init="first")
    model = mb.fit_minibatch(df, FEATURES, 4, "id", 66, batches=6, reassign=0.5, patience=None, init="first")
    assert stuck.moved == 0 and model.moved > 0
    for m in (stuck, model, mb.fit_minibatch(df, FEATURES, 4, "id", 10, batches=40, patience=3)):
        labelled = mb.label_rows(df, m, FEATURES, dist_col="d")
        assert tuple(mb.rows_off_nearest(labelled, FEATURES, m.centres, m.means).first()) == (66, 0)
        assert len(m.inertia) <= 40 and labelled.where("d IS NULL").count() == 0
    wrong = labelled.withColumn("cluster", (F.col("cluster") + 1) % 4)
    assert mb.rows_off_nearest(wrong, FEATURES, m.centres, m.means).first()["n_off"] > 0


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, 1.0, None), (3, 4.0, None)], "id long, a double, b double")
    out = mb.kmeans_minibatch(df, FEATURES, 5, "id", 10, batches=2)
    assert {r.id: r.cluster for r in out.collect()}[1] == {r.id: r.cluster for r in out.collect()}[2]
    with pytest.raises(ValueError):
        mb.fit_minibatch(df.limit(0), FEATURES, 2, "id", 10)


# ---- factors with biases ------------------------------------------------------------

def dense(inter, users, items):
    y = np.zeros((len(users), len(items)))
    for u, i in inter:
        y[users.index(u), items.index(i)] = 1
    return y


def loss_by_hand(y, u, bu, v, bi, reg):
    p = u @ v.T + bu[:, None] + bi
    return ((p - y) ** 2).mean() + reg / 2 * ((u ** 2).sum() + (v ** 2).sum() + (bu ** 2).sum() + (bi ** 2).sum())


def matrices(side, col, ids):
    rows = {r[col]: r for r in side.collect()}
    return np.array([rows[i]["features"] for i in ids]), np.array([rows[i]["bias"] for i in ids])


def test_half_sweeps_solve_the_normal_equations(spark):
    rng = random.Random(3)
    inter = sorted({(f"u{rng.randint(0, 11)}", rng.randint(0, 14) ** 2) for _ in range(70)})
    users, items = sorted({u for u, _ in inter}) + ["new"], sorted({i for _, i in inter})
    df = spark.createDataFrame([*inter, inter[0], (None, 4), ("u1", None)], "userId string, itemId long")
    y, reg, history = dense(inter, users, items), 0.01, []
    u, v = biased.train_biased_factors(df, rank=3, sweeps=3, reg=reg, users=spark.createDataFrame([(x,) for x in users], "userId string"), history=history)
    (um, bu), (vm, bi) = matrices(u, "userId", users), matrices(v, "itemId", items)
    # the last half sweep solved the items: least squares of every item for these users
    z = np.hstack([um, np.ones((len(users), 1))])
    for j in range(len(items)):
        want = np.linalg.solve(z.T @ z + np.eye(4) * reg * y.size / 2, z.T @ (y[:, j] - bu))
        assert np.allclose(np.append(vm[j], bi[j]), want, atol=1e-8)
    assert abs(history[-1][0] - loss_by_hand(y, um, bu, vm, bi, reg)) < 1e-10
    losses = [h[0] for h in history]
    assert len(losses) == 6 and all(b <= a + 1e-12 for a, b in zip(losses, losses[1:])) and losses[-1] < y.mean()


def test_start_is_the_same_for_any_partitioning_and_looks_normal(spark):
    ids = spark.range(3000).select(F.col("id").alias("itemId"))
    a = {r.itemId: r.features for r in biased.start_factors(ids.repartition(7), "itemId", 4, 0.5, 1).collect()}
    b = {r.itemId: r.features for r in biased.start_factors(ids.coalesce(1), "itemId", 4, 0.5, 1).collect()}
    x = np.array(list(a.values()))
    assert a == b and abs(x.mean()) < 0.02 and abs(x.std() - 0.5) < 0.02


def test_recommendations_follow_the_groups(spark):
    """Two groups with their own items: what is recommended to a user belongs to the group."""
    rng = random.Random(5)
    inter = [(u, 100 * (u % 2) + rng.randint(0, 14)) for u in range(40) for _ in range(7)]
    df = spark.createDataFrame(inter, "userId long, itemId long")
    u, v = biased.train_biased_factors(df, rank=2, sweeps=6, reg=2e-3)
    recs = factors.factor_recommend(u, v, df, n=3).collect()
    right = [r.itemId // 100 == r.userId % 2 for r in recs]
    assert np.mean(right) > 0.95
    with pytest.raises(ValueError):
        biased.train_biased_factors(df.limit(0))


def test_training_by_blocks(spark, monkeypatch):
    """Many small blocks give the factors of one; nothing but the last factors is kept, and the sums over the seen pairs are those of a join."""
    import os

    rng = random.Random(8)
    inter = [(f"u{rng.randint(0, 30)}", rng.randint(0, 25)) for _ in range(200)]
    df, made = spark.createDataFrame(inter, "userId string, itemId int"), []
    write = biased._Side.write_pairs
    monkeypatch.setattr(biased._Side, "write_pairs", lambda self, *a: made.append(self) or write(self, *a))
    out = []
    for least, at_once in ((1024, 100_000), (3, 7)):
        monkeypatch.setattr(biased, "LEAST_IDS", least)
        monkeypatch.setattr(biased, "PAIRS_AT_ONCE", at_once)
        history = []
        u, v = biased.train_biased_factors(df, rank=3, sweeps=2, reg=1e-3, history=history)
        loss = factors.factor_loss(u, v, df, 1e-3, digits=None).first()
        assert abs(loss["loss"] - history[-1][0]) < 1e-12 and abs(loss["mse"] - history[-1][1]) < 1e-12
        out.append([matrices(u, "userId", sorted({x for x, _ in inter})), matrices(v, "itemId", sorted({x for _, x in inter}))])
    assert made[0].n_blocks == 1 and made[2].n_blocks > 5
    assert all(np.allclose(x, y, atol=1e-10) for a, b in zip(*out) for x, y in zip(a, b))
    for side in made:
        files = [f for f in os.listdir(side.folder) if f.startswith("factors-") and not f.startswith(".")]
        assert sorted(files) == sorted(os.path.basename(f) for f in side.factors.values())

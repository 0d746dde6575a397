"""What steps hold and copy follows their rows, not the sizes of their blocks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rivulet.operators import factors, rerank
from rivulet.operators import minibatch as mb


def test_small_blocks_copy_nothing_more_often():
    for n, slice_bytes in ((60_000, 16 << 10), (60_000, 64 << 20), (900_000, 64 << 20)):
        ub, ib, ig = factors._blocks(n, n, 64, slice_bytes, 12)
        assert ib == math.ceil(n * 66 * 8 / slice_bytes)
        assert ig <= 24 and ub * ig >= 24 and n * 66 * 8 / ub <= 1.01 * factors.HELD_BYTES


@pytest.mark.parametrize("text", [False, True])
@pytest.mark.parametrize("twice", [False, True])
def test_blocks_equal_the_streamed_scorer(spark, text, twice):
    rng = np.random.default_rng(11)
    name = (lambda c, i: f"{c}{i}") if text else (lambda c, i: i)
    items = [(name("i", i), [float(x) for x in np.round(rng.normal(size=3))], float(i % 2)) for i in range(90)]
    items += [r for r in items if twice][:40]
    kind = "string" if text else "long"
    users = spark.createDataFrame([(name("u", u), [float(x) for x in np.round(rng.normal(size=3))], 0.5) for u in range(25)], f"userId {kind}, features array<float>, bias double")
    its = spark.createDataFrame(items, f"itemId {kind}, features array<float>, bias double")
    seen = spark.createDataFrame([(name("u", int(rng.integers(25))), name("i", int(rng.integers(90)))) for _ in range(400)], f"userId {kind}, itemId {kind}")
    a = sorted(map(tuple, factors.factor_recommend(users, its, seen, n=6).collect()))
    for slice_bytes in (40, 200, 1000):
        assert a == sorted(map(tuple, factors.factor_recommend(users, its, seen, n=6, max_slice_bytes=slice_bytes).collect()))


def test_als_takes_fewer_blocks_of_large_tables(spark, monkeypatch):
    ratings = spark.range(400).select((F.col("id") % 20).cast("int").alias("u"), F.col("id").cast("int").alias("i"), F.lit(1.0).alias("rating"))
    assert factors._als_blocks(ratings, 32, 10) == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(factors, "SWEEP_BYTES", 1)
    assert factors._als_blocks(ratings, 32, 10) == 2
    monkeypatch.setattr(factors, "BLOCK_RATINGS", 134)
    assert factors._als_blocks(ratings, 32, 10) == 3


def test_rerank_deals_its_rows_to_as_many_tasks_as_they_need(spark, monkeypatch):
    monkeypatch.setattr(rerank, "ROWS_PER_TASK", 20)
    lists = spark.createDataFrame([(u, p, (u + p) % 9) for u in range(40) for p in range(12)], "userId long, pos int, itemId long")
    meta = spark.createDataFrame([(i, i % 3, 900) for i in range(9)], "itemId long, cluster int, watch long")
    assert rerank.rerank_slots(lists, meta).rdd.getNumPartitions() >= 24


def test_minibatch_makes_its_rows_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    df = spark.range(60).select("id", (F.col("id") % 7).cast("double").alias("x")).mapInArrow(count, "id long, x double")
    assert mb.kmeans_minibatch(df, ["x"], 3, "id", 16, batches=3).count() == 60
    assert made.value == 60

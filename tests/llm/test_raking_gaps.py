"""What the sweeps leave between the marginals and their targets."""

import random

from pyspark.sql import functions as F

from rivulet.llm import raking


def test_gaps_shrink_and_the_last_dimension_fits(spark):
    rng = random.Random(3)
    rows = [(f"s{i}", f"l{j}", rng.randint(1, 900)) for i in range(5) for j in range(4) if (i + j) % 3] + [("none", "l0", 0)]
    cells = spark.createDataFrame(rows, "source string, lang string, tokens long")
    dims = ["source", "lang"]
    targets = {d: cells.select(F.col(d).alias("value")).distinct().where("value <> 'none'") for d in dims}
    targets = {d: t.withColumn("share", F.lit(1.0 / t.count())) for d, t in targets.items()}
    worst = []
    for sweeps in (1, 3, 12):
        gaps = raking.marginal_gaps(raking.rake(cells, dims, targets, sweeps), dims, targets).collect()
        assert len(gaps) == 9 and all(abs(g.gap) < 1e-12 for g in gaps if g.dimension == "lang")
        worst.append(max(abs(g.gap) for g in gaps))
    assert worst[0] > worst[1] > worst[2] and worst[2] < 1e-3
    assert raking.marginal_gaps(raking.rake(cells.limit(0), dims, targets), dims, targets).count() == 0

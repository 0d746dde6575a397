"""Mini-batch k-means (C10): centres learned from keyed batches, then one pass that labels every row.

Batches.  In epoch e a row belongs to batch hash(id, e) mod nb, with nb = rows /
batch_size rounded up, so a batch is a random tenth of a percent of a huge table
and no sort or numbering of all rows is needed.  Only the rows of the batches
that will be used are kept: one scan writes them once, by batch, and every step
reads the folder of its own batch.  With 10**10 rows, 100 batches of 4,096 rows
are 409,600 rows out of one filtered scan.

Step.  The rows of the batch get the nearest centre (ties to the smaller
number), per centre their sums and count are added to the centre's totals, and
the centre becomes total / count: the running mean, which is a step of size
1 / count towards each row.  The model (k x features totals) lives on the
driver, its size is checked; a step moves k x features numbers.

Lost centres.  Unscaled features leave some centres without rows.  After a
step, centres that hold less than ``reassign`` of the largest count are moved to
the rows of this batch that lie farthest from their centre, and start again
with the smallest count of the others.

Stop.  With ``patience``, training ends once the smoothed mean distance of the
batches has not fallen for that many batches.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.operators.clusters import MAX_MODEL_BYTES, kmeans_assign
from rivulet.session import shared_path

USER_BATCH, ITEM_BATCH = 1024, 4096
VEC = "kmeans_vec"


@dataclass
class MiniBatchModel:
    """Centre k = totals[k] / counts[k]; ``inertia`` has the mean squared distance of each batch before its step."""
    centres: np.ndarray
    totals: np.ndarray
    counts: np.ndarray
    means: dict[str, float]
    inertia: list[float] = field(default_factory=list)
    moved: int = 0

    def as_table(self, spark, vec: str = "vec") -> DataFrame:
        rows = [(i, [float(x) for x in c]) for i, c in enumerate(self.centres)]
        return spark.createDataFrame(rows, f"centre int, {vec} array<double>")


def _key(id_col: str, epoch):
    """32 hash bits of (id, epoch)."""
    text = F.concat_ws(":", F.col(f"`{id_col}`").cast("string"), epoch.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def column_means(df: DataFrame, features: list[str]) -> dict[str, float]:
    """Mean of each feature over its known values, 0 if there is none."""
    r = df.agg(*[F.avg(F.col(f"`{c}`").cast("double")).alias(f"m{i}") for i, c in enumerate(features)]).first()
    return {c: (r[i] if r[i] is not None else 0.0) for i, c in enumerate(features)}


def with_vector(df: DataFrame, features: list[str], means: dict[str, float], name: str = VEC) -> DataFrame:
    """``df`` with its features as one array; an unknown value is the column's mean."""
    return df.withColumn(name, F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(means[c])) for c in features]))


def keyed_batches(points: DataFrame, id_col: str, n_rows: int, batch_size: int, batches: int) -> DataFrame:
    """(batch, id, vec) of the first ``batches`` batches of all epochs."""
    per_epoch = max(1, -(-n_rows // batch_size))
    epochs = -(-batches // per_epoch)
    rows = points.select(F.col(f"`{id_col}`").alias("id"), F.col(VEC).alias("vec"))
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))) if epochs > 1 else F.lit(0))
    rows = rows.withColumn("batch", (F.col("epoch") * per_epoch + F.pmod(_key("id", F.col("epoch")), F.lit(per_epoch))).cast("int"))
    return rows.where(F.col("batch") < batches).select("batch", "id", "vec")


def _first_rows(points: DataFrame, id_col: str, k: int) -> np.ndarray:
    """The k distinct vectors with the smallest keys."""
    rows = (points.where(F.col(f"`{id_col}`").isNotNull()).groupBy(VEC).agg(F.min(F.struct(F.md5(F.col(f"`{id_col}`").cast("string")).alias("h"), F.col(f"`{id_col}`").alias("id"))).alias("o"))
            .orderBy("o").limit(k).select(VEC).collect())
    return np.array([r[0] for r in rows], np.float64)


def _spread_rows(sample: DataFrame, k: int, seed: int) -> np.ndarray:
    """k-means++ on the bounded first batch: each next centre drawn by its squared distance to the chosen ones."""
    x = np.array([r["vec"] for r in sample.orderBy("id").collect()], np.float64)
    rng = np.random.default_rng(seed)
    chosen = [x[rng.integers(len(x))]]
    near = ((x - chosen[0]) ** 2).sum(axis=1)
    while len(chosen) < k and near.max() > 0:
        chosen.append(x[rng.choice(len(x), p=near / near.sum())])
        near = np.minimum(near, ((x - chosen[-1]) ** 2).sum(axis=1))
    return np.array(chosen)


def _step(model: MiniBatchModel, rows: DataFrame, reassign: float) -> float | None:
    """One batch; returns its mean squared distance before the step, None if it has no rows."""
    spark = rows.sparkSession
    near = kmeans_assign(rows, model.as_table(spark), "vec", "centre", "centre")
    dims = model.centres.shape[1]
    sums = near.groupBy("centre").agg(F.count(F.lit(1)).alias("n"), F.sum("dist").alias("d"), F.max(F.struct("dist", "vec")).alias("far"),
                                      *[F.sum(F.col("vec")[i]).alias(f"s{i}") for i in range(dims)]).collect()  # k rows at most
    n = sum(r["n"] for r in sums)
    if not n:
        return None
    for r in sums:
        c = r["centre"]
        model.counts[c] += r["n"]
        model.totals[c] += [r[f"s{i}"] for i in range(dims)]
        model.centres[c] = model.totals[c] / model.counts[c]
    if reassign > 0:
        _move_lost(model, near, reassign)
    return sum(r["d"] for r in sums) / n


def _move_lost(model: MiniBatchModel, near: DataFrame, reassign: float) -> None:
    lost = np.flatnonzero(model.counts < reassign * model.counts.max())
    if not len(lost):
        return
    far = near.select("dist", "id", "vec").orderBy(F.desc("dist"), "id").limit(int(len(lost))).collect()
    others = np.delete(model.counts, lost)
    start = max(1, int(others.min()) if len(others) else 1)
    for c, r in zip(lost, far):
        if r["dist"] > 0:
            model.centres[c], model.counts[c] = r["vec"], start
            model.totals[c] = model.centres[c] * start
            model.moved += 1


def fit_minibatch(df: DataFrame, features: list[str], k: int, id_col: str, batch_size: int, batches: int = 100,
                  reassign: float = 0.01, patience: int | None = 10, init: str = "k-means++", seed: int = 42) -> MiniBatchModel:
    """Train on at most ``batches`` keyed batches of about ``batch_size`` rows.

    Unscaled features; an unknown value counts as its column's mean.  ``init``:
    'k-means++' on the first batches, or 'first', the k distinct rows with the
    smallest keys.  Fewer distinct rows than k give fewer centres.  Rows with a
    null id are not learned from; an empty table is an error."""
    spark = df.sparkSession
    means = column_means(df, features)
    points = with_vector(df.where(F.col(f"`{id_col}`").isNotNull()), features, means).select(id_col, VEC)
    n_rows = points.count()
    if not n_rows:
        raise ValueError("no rows to learn from")
    if k * len(features) * 8 > MAX_MODEL_BYTES:
        raise ValueError(f"{k} centres of {len(features)} features exceed {MAX_MODEL_BYTES} bytes")
    path = shared_path(spark, "kmeans-batches")
    parts = keyed_batches(points, id_col, n_rows, batch_size, batches)
    parts.write.partitionBy("batch").parquet(path)
    parts = spark.read.schema(parts.schema).parquet(path)
    if init == "first":
        first = _first_rows(points, id_col, k)
    else:
        sample = parts.where(F.col("batch") < max(1, -(-3 * k // batch_size)))  # 3 k rows at least
        first = _spread_rows(sample if sample.limit(1).count() else parts, k, seed)
    model = MiniBatchModel(first.copy(), np.zeros_like(first), np.zeros(len(first), np.int64), means)
    smooth, best, since = None, np.inf, 0
    weight = min(1.0, 2.0 * batch_size / (n_rows + 1))
    for b in range(batches):
        cost = _step(model, parts.where(F.col("batch") == b).select("id", "vec"), reassign)
        if cost is None:
            continue
        model.inertia.append(cost)
        smooth = cost if smooth is None else smooth * (1 - weight) + cost * weight
        best, since = (smooth, 0) if smooth < best else (best, since + 1)
        if patience is not None and since >= patience:
            break
    return model


def label_rows(df: DataFrame, model: MiniBatchModel, features: list[str], out_col: str = "cluster", dist_col: str | None = None) -> DataFrame:
    """``df`` with the number of the nearest centre of every row, one pass without a shuffle."""
    near = kmeans_assign(with_vector(df, features, model.means), model.as_table(df.sparkSession, VEC), VEC, "centre", out_col)
    return near.drop(VEC).withColumnRenamed("dist", dist_col) if dist_col else near.drop(VEC, "dist")


def kmeans_minibatch(df: DataFrame, features: list[str], k: int, id_col: str, batch_size: int, out_col: str = "cluster", **options) -> DataFrame:
    """``df`` + ``out_col``: train on keyed batches, then label every row; what ``df`` is made of runs once."""
    df = written_once(df)
    return label_rows(df, fit_minibatch(df, features, k, id_col, batch_size, **options), features, out_col)


def written_once(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: means, counts, batches, first centres and labels each scan it."""
    path = shared_path(df.sparkSession, "kmeans-rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rows_off_nearest(labelled: DataFrame, features: list[str], centres: np.ndarray, means: dict[str, float] | None = None,
                     label_col: str = "cluster", slack: float = 1e-9) -> DataFrame:
    """One row (n_rows, n_off): rows whose label's centre lies farther than the nearest one, by more than ``slack`` of its distance."""
    model = MiniBatchModel(np.asarray(centres, np.float64), centres, np.ones(len(centres), np.int64), means or column_means(labelled, features))
    spark = labelled.sparkSession
    near = kmeans_assign(with_vector(labelled.select(label_col, *features), features, model.means), model.as_table(spark, VEC), VEC, "centre", "nearest")
    own = near.join(model.as_table(spark).withColumnRenamed("centre", label_col), label_col, "left")
    gap = F.aggregate(F.zip_with(VEC, "vec", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x)
    off = F.coalesce(gap > F.col("dist") * (1 + slack) + slack, F.lit(True))
    return own.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(off.cast("long")).alias("n_off"))

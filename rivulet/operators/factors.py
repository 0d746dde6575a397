"""Latent-factor recommendations.

score(u, i) = u . v_i + b_u + b_i over items the user has not seen; per user
the scores are min-max scaled over the unseen items (all 0 when they are
equal), and the best n are returned.  b_u cancels in ranking and scaling but
is kept in the raw score.

Physical plan of the scorer.  Users are cut into hash blocks and items into hash
groups; a pair (user block, item group) is one run of rows of a sorted partition,
its users first.  A task holds the user block (``HELD_BYTES`` at most) with the
lists of seen items, and streams the items past it in the order of their ids,
block by block of ``max_slice_bytes`` at most, so a group may have any number of
blocks and small blocks copy nothing more often.  Numbers of blocks and groups are
chosen so that the work of a pair is bounded and the copies of users (one per item
group, with n rows of output each) and of items (one per user block) are as few as
that allows.  A pair emits at most n rows per user, which also carry the lowest and
highest unseen score of the group.  One group's rows are final; of several, a window
per user gives the exact top n, minimum and maximum: users x groups x n rows, never
users x items.  Nothing passes through the driver.

An item table of at most ``max_slice_bytes`` (counted first) is broadcast
instead: users stream through one Arrow stage beside their lists of seen items,
nothing is copied per block, every user's rows are final where they are made, and
``scoring.ItemBlock`` skips the items that cannot reach a user's list or ends.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegralType, LongType, StructField, StructType

from rivulet.functions.lists import long_to_wide
from rivulet.operators.etl import encode_ids
from rivulet.operators.scoring import ItemBlock, rank_keys
from rivulet.operators.topk import rank_key, top_k
from rivulet.session import shared_path, ship_package

SCORE_DIGITS = 9          # ranking key: raw score rounded to this many digits
DEFAULT_SLICE_BYTES = 64 << 20   # numpy bytes of one block of users or items
CHUNK_CELLS = 1_000_000          # users x items scores held at once by one task (8 MB)
HELD_BYTES = 32 << 20            # numpy bytes of the users of one pair
GROUP_BYTES = 512 << 20          # numpy bytes of the items of one pair, which it sorts and streams
TASK_CELLS = 50_000_000_000      # users x items scores of one block pair at most
PAIRS_PER_CORE = 2               # block pairs per core at least, so that small tables use all cores


def _dot(a: str, b: str):
    """Dot product of two array columns as a JVM expression."""
    return F.aggregate(F.zip_with(F.col(a), F.col(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, z: acc + z)


def _with_bias(df: DataFrame, bias: str | None) -> DataFrame:
    if bias and bias in df.columns:
        return df.withColumn("bias", F.col(bias).cast("double"))
    return df.withColumn("bias", F.lit(0.0))


def _blocks(n_users: int, n_items: int, rank: int, max_slice_bytes: int, cores: int, n: int = 1) -> tuple[int, int, int]:
    """(user blocks, item blocks, item groups): enough pairs for the work and the cores, item blocks and user blocks that
    fit a task, and of those the numbers that copy the fewest bytes."""
    one = (rank + 2) * 8
    ib = max(1, min(math.ceil(n_items * one / max_slice_bytes), n_items))
    pairs = max(PAIRS_PER_CORE * cores, math.ceil(n_users * n_items / TASK_CELLS))
    ig = round(math.sqrt(pairs * n_items * one / max(1, n_users * (one + n * 40))))
    ig = max(1, math.ceil(n_items * one / GROUP_BYTES), min(ig, ib))
    return max(1, min(max(math.ceil(n_users * one / HELD_BYTES), math.ceil(pairs / ig)), n_users)), ib, ig


class _Users:
    """The users of a pair and the best unseen items that the blocks streamed past them have given."""

    def __init__(self, held, n: int, block_rows: int):
        import pyarrow as pa
        import pyarrow.compute as pc

        t = pa.Table.from_batches(held).combine_chunks()
        self.ids, self.bias = t.column(3).combine_chunks(), t.column(6).to_numpy().astype(np.float64)
        self.x = _flat(t.column(5).combine_chunks()).astype(np.float64).reshape(len(self.ids), -1)
        lists = t.column(7).combine_chunks()
        seen, of = lists.flatten(), np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        by = np.argsort(seen.to_numpy(), kind="stable") if pa.types.is_integer(seen.type) else None
        self.seen, self.of = (seen, of) if by is None else (seen.take(pa.array(by)), of[by])
        self.sorted = None if by is None else self.seen.to_numpy()
        self.n, self.block_rows, self.items, self.waiting, self.item_ids, self.at = n, block_rows, [], 0, [], 0
        m = len(self.ids)
        self.mn, self.mx, self.worst = np.full(m, np.inf), np.full(m, -np.inf), np.full(m, np.inf)
        self.best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        self.new, self.n_new = [], 0

    def add(self, batch) -> None:
        while batch.num_rows:
            part = batch.slice(0, self.block_rows - self.waiting)
            self.items.append(part)
            self.waiting += part.num_rows
            batch = batch.slice(part.num_rows)
            if self.waiting == self.block_rows:
                self._score()

    def _score(self) -> None:
        import pyarrow as pa
        import pyarrow.compute as pc

        t = pa.Table.from_batches(self.items).combine_chunks()
        self.items, self.waiting = [], 0
        ids = t.column(4).combine_chunks()
        block = ItemBlock(_flat(t.column(5).combine_chunks()).astype(np.float64).reshape(len(ids), -1), t.column(6).to_numpy().astype(np.float64))
        seen, of = self.seen, self.of
        if self.sorted is not None:      # items come in the order of their ids
            a, z = np.searchsorted(self.sorted, ids[0].as_py(), "left"), np.searchsorted(self.sorted, ids[len(ids) - 1].as_py(), "right")
            seen, of = seen.slice(a, z - a), of[a:z]
        pos = pc.index_in(seen, value_set=ids)
        ok = pos.is_valid().to_numpy(zero_copy_only=False)
        row, pos = of[ok], pc.fill_null(pos, -1).to_numpy(zero_copy_only=False)[ok].astype(np.int64)
        if self.item_ids and self.item_ids[-1][-1] == ids[0]:
            row, pos = row[pos > 0], pos[pos > 0]    # of a repeated id the first row counts as seen, here in the block before
        by = np.argsort(row, kind="stable")
        row, pos = row[by], pos[by]
        step = max(1, CHUNK_CELLS // min(2048, len(ids)))
        for lo in range(0, len(self.x), step):
            hi = min(lo + step, len(self.x))
            a, z = np.searchsorted(row, (lo, hi))
            r, p, s, mn, mx, _ = block.best_unseen(self.x[lo:hi], self.bias[lo:hi], row[a:z] - lo, pos[a:z], self.n,
                                                   self.worst[lo:hi], self.mn[lo:hi])
            self.mn[lo:hi], self.mx[lo:hi] = mn, np.maximum(self.mx[lo:hi], mx)
            self.new.append((r + lo, p + self.at, s))
            self.n_new += len(r)
        self.item_ids.append(ids)
        self.at += len(ids)
        if self.n_new >= max(100_000, len(self.x)) or len(self.item_ids) == 1:
            self._merge()

    def _merge(self) -> None:
        row, pos, score = (np.concatenate((b, *[x[i] for x in self.new])) for i, b in enumerate(self.best))
        key = rank_keys(score)
        by = np.lexsort((pos, key, row))
        row, key = row[by], key[by]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        self.worst[row[rank == self.n - 1]] = key[rank == self.n - 1]
        self.best = [row[rank < self.n], *(x[by[rank < self.n]] for x in (pos, score))]
        self.new, self.n_new = [], 0

    def rows(self, names: list[str]):
        import pyarrow as pa

        if self.waiting:
            self._score()
        self._merge()
        row, pos, score = self.best
        if not len(row):
            return
        ids = pa.chunked_array(self.item_ids).combine_chunks()
        rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
        for a in range(0, len(row), CHUNK_CELLS):
            r = row[a:a + CHUNK_CELLS]
            yield pa.RecordBatch.from_arrays([self.ids.take(pa.array(r)), ids.take(pa.array(pos[a:a + CHUNK_CELLS])), pa.array(score[a:a + CHUNK_CELLS]),
                                              pa.array(self.mn[r]), pa.array(self.mx[r]), pa.array(rank[a:a + CHUNK_CELLS])], names=names)


def _score_pairs(n: int, block_rows: int, names: list[str]):
    """For ``mapInArrow`` over rows (ub, ig, item, userId, itemId, features, bias, seen), sorted, users before items and those by id."""
    def run(batches):
        key, held, users = None, [], None
        for whole in batches:
            marks = np.stack([whole.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1)
            cut = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1
            for a, z in zip([0, *cut], [*cut, whole.num_rows]):
                if a == z:
                    continue
                b, (ub, ig, is_item) = whole.slice(a, z - a), marks[a]
                if (ub, ig) != key:
                    if users is not None:
                        yield from users.rows(names)
                    key, held, users = (ub, ig), [], None
                if not is_item:
                    held.append(b)
                    continue
                if held:
                    users, held = _Users(held, n, block_rows), []
                if users is not None:
                    users.add(b)
        if users is not None:
            yield from users.rows(names)

    return run


def factor_candidates(users: DataFrame, items: DataFrame, seen: DataFrame, n: int,
                      user_bias: str | None = "bias", item_bias: str | None = "bias",
                      max_slice_bytes: int = DEFAULT_SLICE_BYTES) -> DataFrame:
    """Unseen candidates (userId, itemId, raw, mn, mx): the best n of every user in
    every item group, with the group's lowest and highest unseen score."""
    return _candidates(users, items, seen, n, user_bias, item_bias, max_slice_bytes)[0].drop("rank")


def _candidates(users: DataFrame, items: DataFrame, seen: DataFrame, n: int, user_bias: str | None, item_bias: str | None,
                max_slice_bytes: int) -> tuple[DataFrame, bool]:
    """The candidates with their rank in their group, and whether that is final: one group only, no user twice."""
    spark = users.sparkSession
    u = _with_bias(users.select("userId", "features", *([user_bias] if user_bias in users.columns else [])), user_bias)
    it = _with_bias(items.select("itemId", "features", *([item_bias] if item_bias in items.columns else [])), item_bias)
    uid, iid = u.schema["userId"].dataType, it.schema["itemId"].dataType
    schema = StructType([StructField("userId", uid), StructField("itemId", iid),
                         *[StructField(c, DoubleType()) for c in ("raw", "mn", "mx")], StructField("rank", LongType())])
    facts = it.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("features")).alias("rank")).first()
    rank = facts["rank"] or 0
    n_users = u.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("userId").alias("ids")).first()
    ub, _, ig = _blocks(n_users["n"], facts["n"], rank, max_slice_bytes, spark.sparkContext.defaultParallelism, n)
    # vectors travel as they are if both sides are alike: floats take half the bytes of doubles
    floats = all(f.schema["features"].dataType == ArrayType(FloatType(), f.schema["features"].dataType.containsNull) for f in (u, it))
    vector = F.col("features").cast("array<float>" if floats else "array<double>").alias("features")

    def block(c: str, k: int):
        return F.pmod(F.xxhash64(c), F.lit(k)).cast("int")

    lists = (seen.select(F.col("userId").cast(uid), F.col("itemId").cast(iid)).where("itemId IS NOT NULL").distinct()
             .groupBy("userId", block("itemId", ig).alias("ig")).agg(F.collect_list("itemId").alias("seen")))
    ship_package(spark)
    u = u.select("userId", "features", "bias", block("userId", ub).alias("ub"),
                 F.explode(F.sequence(F.lit(0), F.lit(ig - 1))).alias("ig"))
    u = u.join(lists, ["userId", "ig"], "left").select(
        "ub", "ig", F.lit(0).alias("item"), "userId", F.lit(None).cast(iid).alias("itemId"), vector, "bias", "seen")
    it = it.where("itemId IS NOT NULL").select(
        F.explode(F.sequence(F.lit(0), F.lit(ub - 1))).alias("ub"), block("itemId", ig).alias("ig"), F.lit(1).alias("item"),
        F.lit(None).cast(uid).alias("userId"), "itemId", vector, "bias", F.lit(None).cast(ArrayType(iid)).alias("seen"))
    # The work of a pair is not its bytes: an explicit partition count keeps AQE from joining pairs up.
    rows = u.unionByName(it).repartition(ub * ig, "ub", "ig").sortWithinPartitions("ub", "ig", "item", "itemId")
    block_rows = max(1, max_slice_bytes // ((rank + 2) * 8))
    return rows.mapInArrow(_score_pairs(n, block_rows, schema.names), schema), ig == 1 and n_users["n"] == n_users["ids"]


def _flat(col) -> np.ndarray:
    """The values of a list column's rows, one after another."""
    return col.flatten().to_numpy(zero_copy_only=False)


def _streamed(users: DataFrame, items: DataFrame, seen: DataFrame, n: int, user_bias: str | None, item_bias: str | None,
              cells=None) -> DataFrame:
    """(userId, itemId, raw, mn, mx, rank): the final rows of every user, with the item table in every task.

    ``cells`` (an accumulator) counts the user-item cells that were multiplied."""
    import pyarrow as pa
    import pyarrow.compute as pc

    spark = users.sparkSession
    ship_package(spark)
    u = _with_bias(users.select("userId", "features", *([user_bias] if user_bias in users.columns else [])), user_bias)
    it = _with_bias(items.select("itemId", "features", *([item_bias] if item_bias in items.columns else [])), item_bias)
    uid, iid = u.schema["userId"].dataType, it.schema["itemId"].dataType
    table = it.select("itemId", "features", "bias").where("itemId IS NOT NULL").toArrow()   # max_slice_bytes at most
    table = table.take(pc.sort_indices(table.column(0))).combine_chunks()
    ids = table.column(0).combine_chunks()
    v = np.zeros((0, 1)) if not len(ids) else _flat(table.column(1).combine_chunks()).astype(np.float64).reshape(len(ids), -1)
    known = spark.sparkContext.broadcast((ids, v, table.column(2).to_numpy().astype(np.float64)))
    lists = (seen.select(F.col("userId").cast(uid), F.col("itemId").cast(iid)).where("itemId IS NOT NULL")
             .groupBy("userId").agg(F.collect_set("itemId").alias("seen")))
    rows = u.select("userId", "features", "bias").join(lists, "userId", "left").select("userId", "features", "bias", "seen")
    schema = StructType([StructField("userId", uid), StructField("itemId", iid), *[StructField(c, DoubleType()) for c in ("raw", "mn", "mx")],
                         StructField("rank", LongType())])

    def run(batches):
        ids, v, bias = known.value
        block = ItemBlock(v, bias) if len(v) else None
        step = max(1, CHUNK_CELLS // 2048)
        for whole in batches:
            for at in range(0, whole.num_rows if block else 0, step):
                b = whole.slice(at, step)
                x = _flat(b.column(1)).astype(np.float64).reshape(b.num_rows, -1)
                have = pc.fill_null(pc.list_value_length(b.column(3)), 0).to_numpy(zero_copy_only=False)
                pos = pc.index_in(b.column(3).flatten(), value_set=ids)
                ok = pos.is_valid().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(b.num_rows), have)[ok]
                pos = pc.fill_null(pos, -1).to_numpy(zero_copy_only=False)[ok].astype(np.int64)
                r, p, score, mn, mx, n_cells = block.best_unseen(x, b.column(2).to_numpy(zero_copy_only=False), row, pos, n)
                if cells is not None:
                    cells.add(int(n_cells))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(r)), ids.take(pa.array(p)), pa.array(score), pa.array(mn[r]), pa.array(mx[r]),
                     pa.array(np.arange(len(r)) - np.searchsorted(r, r) + 1)], names=schema.names)

    return rows.mapInArrow(run, schema)


def factor_recommend(users: DataFrame, items: DataFrame, seen: DataFrame, n: int = 5,
                     user_bias: str | None = "bias", item_bias: str | None = "bias",
                     max_slice_bytes: int = DEFAULT_SLICE_BYTES, digits: int = 4, cells=None) -> DataFrame:
    """(userId, itemId, score, rank), best first, score min-max scaled over the
    user's unseen items and rounded to ``digits`` (C5).  A user with fewer than
    n unseen items gets fewer rows; one who saw everything gets none."""
    facts = items.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("features")).alias("rank")).first()
    if facts["n"] * ((facts["rank"] or 0) + 2) * 8 <= max_slice_bytes:
        top = _streamed(users, items, seen, n, user_bias, item_bias, cells)
        denom = F.when(F.col("mx") == F.col("mn"), F.lit(1.0)).otherwise(F.col("mx") - F.col("mn"))
        return top.select("userId", "itemId", F.round((F.col("raw") - F.col("mn")) / denom, digits).alias("score"), "rank")
    cand, final = _candidates(users, items, seen, n, user_bias, item_bias, max_slice_bytes)
    denom = F.when(F.col("mx") == F.col("mn"), F.lit(1.0)).otherwise(F.col("mx") - F.col("mn"))
    if not final:
        w = Window.partitionBy("userId")
        cand = cand.drop("rank").withColumn("mn", F.min("mn").over(w)).withColumn("mx", F.max("mx").over(w))
        cand = top_k(cand, "userId", [F.desc(rank_key("raw", SCORE_DIGITS)), F.asc("itemId")], n)
    return cand.select("userId", "itemId", F.round((F.col("raw") - F.col("mn")) / denom, digits).alias("score"),
                       F.col("rank").cast("long").alias("rank"))


def retrieval(users: DataFrame, items: DataFrame, seen: DataFrame, n: int = 100,
              max_slice_bytes: int = DEFAULT_SLICE_BYTES) -> DataFrame:
    """(userId, itemId) with the best n unseen items joined by '; ' (C6)."""
    rec = factor_recommend(users, items, seen, n, max_slice_bytes=max_slice_bytes)
    return long_to_wide(rec, "userId", "itemId", ["rank"], sep="; ")


def _moments(df: DataFrame, kind: str) -> DataFrame:
    """Per-partition partial sums of f f^T, f, b f, b, b^2, |f|^2 and the row
    count, reduced by (kind, name, idx) to one small table."""
    import pyarrow as pa

    def part(batches):
        G = sf = sbf = None
        sb = sbb = sff = 0.0
        cnt = 0
        for b in batches:
            if not b.num_rows:
                continue
            X = _flat(b.column(0)).astype(np.float64).reshape(b.num_rows, -1)
            bias = b.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
            if G is None:
                r = X.shape[1]
                G, sf, sbf = np.zeros((r, r)), np.zeros(r), np.zeros(r)
            G += X.T @ X
            sf += X.sum(axis=0)
            sbf += bias @ X
            sb += bias.sum()
            sbb += (bias * bias).sum()
            sff += (X * X).sum()
            cnt += b.num_rows
        if G is None:
            return
        r = G.shape[0]
        rows = [("G", i, v) for i, v in enumerate(G.ravel())]
        rows += [("f", i, v) for i, v in enumerate(sf)] + [("bf", i, v) for i, v in enumerate(sbf)]
        rows += [("b", 0, sb), ("bb", 0, sbb), ("ff", 0, sff), ("n", 0, float(cnt)), ("r", 0, float(r))]
        name, idx, val = zip(*rows)
        yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(idx, pa.int64()), pa.array(np.array(val, np.float64))], names=["name", "idx", "val"])

    ship_package(df.sparkSession)
    m = df.select("features", "bias").mapInArrow(part, "name string, idx long, val double")
    return (m.groupBy("name", "idx").agg(F.sum("val").alias("val"))
            .withColumn("kind", F.lit(kind)))


def factor_loss(users: DataFrame, items: DataFrame, seen: DataFrame, reg: float = 0.01,
                user_bias: str | None = "bias", item_bias: str | None = "bias", digits: int | None = 6,
                seen_terms: DataFrame | None = None) -> DataFrame:
    """Mean squared error of p = u.v + b_u + b_i against the 0/1 seen matrix over
    all user x item cells, plus reg * (|U|^2 + |V|^2 + |b_u|^2 + |b_i|^2) / 2 (A16).

    Without a cross join: sum(p^2) over all cells follows from the two factor
    Gram matrices and a few sums; sum(p) over seen cells needs only the seen
    pairs joined to their factors, or is given with their number: ``seen_terms``
    (term, val), p_seen and n_seen in any number of parts."""
    u = _with_bias(users, user_bias).select("userId", "features", "bias")
    it = _with_bias(items, item_bias).select("itemId", "features", "bias")
    mu = _moments(u, "u")
    mi = _moments(it, "i")

    def vec(m, name, alias):
        return m.where(F.col("name") == name).select("idx", F.col("val").alias(alias))

    # Every term becomes (term, val) rows; one pivot sums them into one row.
    t1 = (vec(mu, "G", "gu").join(vec(mi, "G", "gi"), "idx")
          .select(F.lit("t1").alias("term"), (F.col("gu") * F.col("gi")).alias("val")))
    t34 = (vec(mu, "bf", "ubf").join(vec(mi, "f", "if_"), "idx")
           .join(vec(mu, "f", "uf"), "idx").join(vec(mi, "bf", "ibf"), "idx")
           .select(F.lit("t34").alias("term"),
                   (F.col("ubf") * F.col("if_") + F.col("uf") * F.col("ibf")).alias("val")))
    scal = (mu.select(F.concat(F.lit("u_"), "name").alias("term"), "val", "idx")
            .unionByName(mi.select(F.concat(F.lit("i_"), "name").alias("term"), "val", "idx"))
            .where(F.col("idx") == 0).drop("idx"))
    if seen_terms is None:
        sd = seen.select("userId", "itemId").distinct()
        pairs = (sd.join(u.withColumnRenamed("features", "fu").withColumnRenamed("bias", "bu"), "userId")
                 .join(it.withColumnRenamed("features", "fi").withColumnRenamed("bias", "bi"), "itemId"))
        seen_terms = pairs.select(F.explode(F.array(
            F.struct(F.lit("p_seen").alias("term"), (_dot("fu", "fi") + F.col("bu") + F.col("bi")).alias("val")),
            F.struct(F.lit("n_seen").alias("term"), F.lit(1.0).alias("val")))).alias("t")).select("t.*")
    terms = ["t1", "t34", "u_b", "u_bb", "u_ff", "u_n", "i_b", "i_bb", "i_ff", "i_n", "p_seen", "n_seen"]
    row = (t1.unionByName(t34).unionByName(scal).unionByName(seen_terms)
           .groupBy().pivot("term", terms).agg(F.sum("val")))
    row = row.select(*[F.coalesce(F.col(t), F.lit(0.0)).alias(t) for t in terms])
    sum_p2 = (F.col("t1") + F.col("i_n") * F.col("u_bb") + F.col("u_n") * F.col("i_bb")
              + 2 * F.col("t34") + 2 * F.col("u_b") * F.col("i_b"))
    mse = (sum_p2 - 2 * F.col("p_seen") + F.col("n_seen")) / (F.col("u_n") * F.col("i_n"))
    regt = F.lit(reg) * 0.5 * (F.col("u_ff") + F.col("i_ff") + F.col("u_bb") + F.col("i_bb"))
    cut = (lambda c: c) if digits is None else (lambda c: F.round(c, digits))
    return row.select(cut(mse + regt).alias("loss"), cut(mse).alias("mse"))


def train_factors(inter: DataFrame, rank: int = 32, max_iter: int = 10, reg: float = 0.01,
                  unobserved_weight: float = 0.1, seed: int = 42):
    """Implicit-feedback factors with ALS (C4).  Returns (user_factors,
    item_factors) as (userId|itemId, features) frames feeding the same scorer.

    Every distinct interaction gets rating 1 (P15).  Weight 1 for observed and
    ``unobserved_weight`` for the rest is ALS confidence 1 + alpha with
    alpha = 1 / unobserved_weight - 1.  Whole-number ids that fit ALS's 32 bits are
    used as they are; ids of any other type or size are replaced by dense codes
    0..n-1 (``encode_ids``), which the factors are decoded from."""
    from pyspark.ml.recommendation import ALS

    d = inter.select("userId", "itemId").where("userId IS NOT NULL AND itemId IS NOT NULL").distinct()
    plain = _small_integers(d)
    if plain:
        ratings = d.select(F.col("userId").cast("int").alias("u"), F.col("itemId").cast("int").alias("i"), F.lit(1.0).alias("rating"))
    else:
        path = shared_path(inter.sparkSession, "als-pairs")
        d.write.parquet(path)
        d = inter.sparkSession.read.schema(d.schema).parquet(path)    # read by both dictionaries and the ratings
        _, users = encode_ids(d.select("userId"), "userId", "u")
        _, items = encode_ids(d.select("itemId"), "itemId", "i")
        ratings = d.join(users, "userId").join(items, "itemId").select(
            F.col("u").cast("int").alias("u"), F.col("i").cast("int").alias("i"), F.lit(1.0).alias("rating"))
    blocks = _als_blocks(ratings, rank, max_iter)
    als = ALS(rank=rank, maxIter=max_iter, regParam=reg, implicitPrefs=True,
              alpha=1.0 / unobserved_weight - 1.0, userCol="u", itemCol="i", ratingCol="rating",
              seed=seed, coldStartStrategy="drop", numUserBlocks=blocks, numItemBlocks=blocks)
    model = als.fit(ratings)
    if plain:
        kinds = [inter.schema[c].dataType for c in ("userId", "itemId")]
        return tuple(f.select(F.col("id").cast(k).alias(c), "features") for f, k, c in
                     zip((model.userFactors, model.itemFactors), kinds, ("userId", "itemId")))
    uf = model.userFactors.join(users, F.col("id") == F.col("u")).select("userId", "features")
    itf = model.itemFactors.join(items, F.col("id") == F.col("i")).select("itemId", "features")
    return uf, itf


#: Bytes that all sweeps of a training may shuffle before it gives up blocks, and the ratings of one block at most.
SWEEP_BYTES = 16 << 30
BLOCK_RATINGS = 16_000_000


def _als_blocks(ratings: DataFrame, rank: int, max_iter: int) -> int:
    """One block per core (ALS's fixed default of 10 under-uses a large cluster), or fewer: every sweep sends each factor
    to nearly every block, so large tables take as few as hold their ratings."""
    f = ratings.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("u").alias("u"), F.approx_count_distinct("i").alias("i")).first()
    cores, a_block = ratings.sparkSession.sparkContext.defaultParallelism, max(1, (f["u"] + f["i"]) * (rank * 4 + 16) * max_iter)
    return max(2, min(cores, max(SWEEP_BYTES // a_block, math.ceil(f["n"] / BLOCK_RATINGS))))


def _small_integers(pairs: DataFrame) -> bool:
    """Whether both ids are whole numbers within 32 bits."""
    if not all(isinstance(pairs.schema[c].dataType, IntegralType) for c in ("userId", "itemId")):
        return False
    r = pairs.agg(F.least(F.min("userId"), F.min("itemId")), F.greatest(F.max("userId"), F.max("itemId"))).first()
    return r[0] is None or (-(1 << 31) <= r[0] and r[1] < (1 << 31))

"""Factors with user and item biases, trained on the loss over all user x item cells.

    loss = mean over all cells (u.v + b_u + b_i - seen)**2 + reg / 2 (|U|^2 + |V|^2 + |b_u|^2 + |b_i|^2)

With one side fixed this is a least squares problem with a closed form that
never visits the unseen cells: with z_i = (v_i, 1), x_u = (u, b_u) and
c = reg * users * items / 2,

    (sum_i z_i z_i^T + c I) x_u = sum over the seen items of u (z_i) - sum_i b_i z_i

The matrix and the last sum are the same for every user: a few moments of the
item table.  The sum over the seen items needs the pairs: they are dealt once to
hash blocks of the users and once to blocks of the items, as positions in the other
side's blocks, and written (8 bytes a pair and side).  A half sweep is one task a
block: it reads the other side's factors past its pairs, block by block, adds them
up, solves, and writes its own factors.  Nothing is shuffled in a sweep and the
factors before are deleted; a task holds the factors of one block of each side and
a part of a cell's pairs, so a popular item costs time, no memory.  A half sweep
cannot raise the loss.  Only (rank + 1)^2 numbers a block pass through the driver.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.operators.factors import factor_loss
from rivulet.session import opened, shared_path, ship_package
from rivulet.sources.commits import _path, file_system

BLOCK_BYTES = 32 << 20       # factors of one block at most
LEAST_IDS = 1024             # small tables have a block for each core, but none smaller than this
BLOCKS_PER_CORE = 2
PAIRS_AT_ONCE = 100_000      # pairs whose factors a task gathers at once
ROWS_OUT = 10_000            # rows of a batch of the factor table


def _written(df: DataFrame, name: str, paths: list[str]) -> DataFrame:
    path = shared_path(df.sparkSession, name)
    paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def draws(id_col: str, rank: int, scale: float, seed: int) -> F.Column:
    """Normal draws keyed by (seed, id, position)."""
    def uniform(k, salt):
        h = F.xxhash64(F.lit(seed), F.lit(salt), F.col(id_col).cast("string"), k)
        return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(1 << 53)

    return F.transform(F.sequence(F.lit(1), F.lit(rank)), lambda k: F.sqrt(-2 * F.log(uniform(k, 1))) * F.cos(2 * np.pi * uniform(k, 2)) * F.lit(scale))


def start_factors(ids: DataFrame, id_col: str, rank: int, scale: float, seed: int) -> DataFrame:
    """(id, features, bias): normal draws keyed by (seed, id, position), the same for any partitioning; bias 0."""
    return ids.select(id_col, draws(id_col, rank, scale, seed).alias("features"), F.lit(0.0).alias("bias"))


def _drop(spark: SparkSession, path: str) -> None:
    file_system(spark, path).delete(_path(spark, path), True)


def _put(path: str, *parts) -> None:
    fs, name = opened(path)
    fs.create_dir(name.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(name, compression=None) as f:
        for p in parts:
            f.write(p)


def _runs(batches, keys: int):
    """(key, table) of rows that come together, by their first ``keys`` columns."""
    held, key = [], None
    for b in batches:
        if not b.num_rows:
            continue
        marks = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(keys)], axis=1)
        cut = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1
        for a, z in zip([0, *cut], [*cut, len(marks)]):
            new = tuple(marks[a].tolist())
            if new != key:
                if held:
                    yield key, pa.Table.from_batches(held).combine_chunks()
                held, key = [], new
            held.append(b.slice(a, z - a))
    if held:
        yield key, pa.Table.from_batches(held).combine_chunks()


def _positions(values: pa.Array, ids: pa.Array) -> np.ndarray:
    """Where each value stands among the different ``ids``."""
    try:
        at = pc.index_in(values, value_set=ids)
    except pa.ArrowNotImplementedError:      # structs and lists
        known = {repr(x): i for i, x in enumerate(ids.to_pylist())}
        return np.array([known[repr(x)] for x in values.to_pylist()], np.int32)
    return at.to_numpy(zero_copy_only=False).astype(np.int32)


class _Side:
    """The ids of users or items in hash blocks: files of ids and of the factors that they have now."""

    def __init__(self, ids: DataFrame, col: str, n: int, rank: int, folder: str):
        self.spark, self.col, self.rank, self.folder = ids.sparkSession, col, rank, f"{folder}/{col}"
        self.kind = ids.schema[col].dataType.simpleString()
        cores = self.spark.sparkContext.defaultParallelism
        self.n_blocks = max(1, math.ceil(n * (rank + 1) * 8 / BLOCK_BYTES), min(BLOCKS_PER_CORE * cores, n // LEAST_IDS))
        self.ids, self.factors, self.pairs = {}, {}, {}

    def block(self) -> F.Column:
        return F.pmod(F.xxhash64(self.col), F.lit(self.n_blocks)).cast("int")

    def tasks(self, blocks) -> DataFrame:
        """A row and a task for each block."""
        blocks = sorted(blocks)
        n = max(1, len(blocks))
        at = F.element_at(F.lit(np.array(blocks or [0], np.int64)), (F.col("id") + 1).cast("int"))
        return self.spark.range(0, len(blocks), 1, n).select(at.alias("block"))

    def write_ids(self, ids: DataFrame, scale: float | None, seed: int) -> None:
        """Files of the ids of each block, and with ``scale`` of the factors to start from."""
        rows = ids.select(self.block().alias("block"), self.col).repartition(self.n_blocks, "block").sortWithinPartitions("block", self.col)
        if scale is not None:
            rows = rows.select("block", self.col, draws(self.col, self.rank, scale, seed).alias("features"))
        folder, rank = self.folder, self.rank

        def run(batches):
            for (block,), t in _runs(batches, 1):
                path, name = f"{folder}/ids-{block}-{uuid.uuid4().hex}", f"{folder}/factors-{block}-{uuid.uuid4().hex}"
                sink = pa.BufferOutputStream()
                with pa.ipc.new_file(sink, pa.schema([t.schema.field(1)])) as out:
                    out.write_table(t.select([1]), max_chunksize=t.num_rows)
                _put(path, sink.getvalue())
                if scale is not None:
                    x = t.column(2).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, rank)
                    _put(name, np.column_stack((x, np.zeros(len(x)))).tobytes())
                yield pa.RecordBatch.from_pydict({"block": [block], "path": [path], "factors": [name]}, schema=pa.schema(
                    [("block", pa.int64()), ("path", pa.string()), ("factors", pa.string())]))

        for r in rows.mapInArrow(run, "block long, path string, factors string").collect():      # a row for each block
            self.ids[r["block"]] = r["path"]
            if scale is not None:
                self.factors[r["block"]] = r["factors"]

    def write_pairs(self, pairs: DataFrame, other: _Side) -> None:
        """Files of the pairs of each block: for each block of the other side the positions in both, in their order."""
        rows = (pairs.select(self.block().alias("a"), other.block().alias("b"), self.col, other.col)
                .repartition(self.n_blocks, "a").sortWithinPartitions("a", "b"))
        known, others, folder = self.ids, other.ids, self.folder

        def run(batches):
            at, mine, parts, met, path = None, None, None, [], None

            def close():
                parts.close()
                return pa.RecordBatch.from_pydict({"block": [at], "path": [path], "others": [[b for b, _ in met]], "sizes": [[n for _, n in met]]},
                                                  schema=pa.schema([("block", pa.int64()), ("path", pa.string()), ("others", pa.list_(pa.int64())),
                                                                    ("sizes", pa.list_(pa.int64()))]))

            for (a, b), t in _runs(batches, 2):
                if a != at:
                    if parts is not None:
                        yield close()
                    at, mine, met, path = a, _ids(known[a]), [], f"{folder}/pairs-{a}-{uuid.uuid4().hex}"
                    fs, name = opened(path)
                    fs.create_dir(name.rsplit("/", 1)[0], recursive=True)
                    parts = fs.open_output_stream(name, compression=None)
                i, j = _positions(t.column(2).combine_chunks(), mine), _positions(t.column(3).combine_chunks(), _ids(others[b]))
                by = np.lexsort((j, i))
                parts.write(np.stack((i[by], j[by]), axis=1).tobytes())
                met.append((b, len(i)))
            if parts is not None:
                yield close()

        for r in rows.mapInArrow(run, "block long, path string, others array<long>, sizes array<long>").collect():   # a row for each block
            self.pairs[r["block"]] = r["path"], list(zip(r["others"], r["sizes"]))

    def replace(self, factors: dict[int, str]) -> None:
        old, self.factors = self.factors, factors
        for path in old.values():
            _drop(self.spark, path)

    def moments(self) -> tuple[np.ndarray, np.ndarray]:
        """(sum z z^T, sum b z) with z = (features, 1)."""
        files, size = self.factors, self.rank + 1

        def run(batches):
            for b in batches:
                for block in b.column(0).to_pylist():
                    x = _factors(files[block], size)
                    bias, z = x[:, -1].copy(), np.column_stack((x[:, :-1], np.ones(len(x))))
                    yield pa.RecordBatch.from_pydict({"block": [block], "m": [np.vstack((z.T @ z, bias @ z)).tobytes()]})

        rows = sorted((r["block"], bytes(r["m"])) for r in self.tasks(files).mapInArrow(run, "block long, m binary").collect())  # (rank + 1)^2 numbers a block
        total = sum((np.frombuffer(m).reshape(-1, size) for _, m in rows), np.zeros((size + 1, size)))
        return total[:-1], total[-1]

    def table(self) -> DataFrame:
        """(id, features, bias)"""
        ids, files, size, col = self.ids, self.factors, self.rank + 1, self.col

        def run(batches):
            for b in batches:
                for block in b.column(0).to_pylist():
                    mine, x = _ids(ids[block]), _factors(files[block], size)
                    for lo in range(0, len(x), ROWS_OUT):
                        part = x[lo:lo + ROWS_OUT]
                        ends = pa.array(np.arange(len(part) + 1, dtype=np.int32) * (size - 1))
                        yield pa.RecordBatch.from_arrays(
                            [mine.slice(lo, len(part)), pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(part[:, :-1]).reshape(-1))),
                             pa.array(np.ascontiguousarray(part[:, -1]))], names=[col, "features", "bias"])

        return self.tasks(files).mapInArrow(run, f"`{col}` {self.kind}, features array<double>, bias double")


def _ids(path: str) -> pa.Array:
    fs, name = opened(path)
    return pa.ipc.open_file(fs.open_input_file(name)).get_batch(0).column(0)


def _factors(path: str, size: int) -> np.ndarray:
    fs, name = opened(path)
    with fs.open_input_file(name) as f:
        return np.frombuffer(f.read(), np.float64).reshape(-1, size)


def _cells(file: tuple[str, list]):
    """(other block, positions here, positions there) of a block's pairs, some at a time."""
    path, met = file
    fs, name = opened(path)
    with fs.open_input_file(name) as f:
        for b, n in met:
            for lo in range(0, n, PAIRS_AT_ONCE):
                part = np.frombuffer(f.read(8 * min(PAIRS_AT_ONCE, n - lo)), np.int32).reshape(-1, 2)
                yield b, part[:, 0], part[:, 1]


def solve_side(side: _Side, fixed: _Side, cells: float, reg: float) -> None:
    """The best factors of one side for the ``fixed`` other one's."""
    gram, right = fixed.moments()
    size = len(right)
    inverse = np.linalg.inv(gram + np.eye(size) * (reg * cells / 2))
    ids, pairs, given, folder = side.ids, side.pairs, fixed.factors, side.folder

    def run(batches):
        for batch in batches:
            for block in batch.column(0).to_pylist():
                s = np.zeros((len(_ids(ids[block])), size))
                at, v = None, None
                for b, i, j in _cells(pairs[block]) if block in pairs else ():
                    if b != at:
                        v = _factors(given[b], size).copy()
                        at, v[:, -1] = b, 1.0
                    first = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1])))
                    s[i[first]] += np.add.reduceat(v[j], first, axis=0)
                path = f"{folder}/factors-{block}-{uuid.uuid4().hex}"
                _put(path, np.ascontiguousarray((s - right) @ inverse).tobytes())
                yield pa.RecordBatch.from_pydict({"block": [block], "path": [path]})

    made = side.tasks(ids).mapInArrow(run, "block long, path string").collect()      # a row for each block
    side.replace({r["block"]: r["path"] for r in made})


def seen_terms(side: _Side, other: _Side) -> DataFrame:
    """The terms p_seen and n_seen of ``factor_loss`` from the pairs' blocks: (term, val)."""
    size, pairs, mine, others = side.rank + 1, side.pairs, side.factors, other.factors

    def run(batches):
        for batch in batches:
            for block in batch.column(0).to_pylist():
                u, total, n, at, v = _factors(mine[block], size), 0.0, 0, None, None
                for b, i, j in _cells(pairs[block]):
                    if b != at:
                        at, v = b, _factors(others[b], size)
                    x, y = u[i], v[j]
                    total += np.einsum("ij,ij->", x[:, :-1], y[:, :-1]) + x[:, -1].sum() + y[:, -1].sum()
                    n += len(i)
                yield pa.RecordBatch.from_pydict({"term": ["p_seen", "n_seen"], "val": [float(total), float(n)]})

    return side.tasks(pairs).mapInArrow(run, "term string, val double")


def train_biased_factors(inter: DataFrame, rank: int = 32, sweeps: int = 10, reg: float = 1e-6, seed: int = 42,
                         users: DataFrame | None = None, items: DataFrame | None = None, history: list | None = None) -> tuple[DataFrame, DataFrame]:
    """(users: userId, features, bias), (items: itemId, features, bias) for ``factor_recommend``.

    ``inter``: (userId, itemId) of any types; repeated pairs count once, rows
    with a null are left out.  ``users`` and ``items`` name further ids that
    have no interaction but whose cells count; default the ids of ``inter``.
    ``history`` gets the (loss, squared error) after every half sweep.  ``reg`` is
    the weight of the loss above: it is compared with a mean over all cells, so
    useful values are of the order of 1 / (users * items)."""
    written = []
    pairs = _written(inter.select("userId", "itemId").where("userId IS NOT NULL AND itemId IS NOT NULL").distinct(), "factor-pairs", written)
    users = _written((users.select("userId").where("userId IS NOT NULL") if users is not None else pairs.select("userId")).distinct(), "factor-users", written)
    items = _written((items.select("itemId").where("itemId IS NOT NULL") if items is not None else pairs.select("itemId")).distinct(), "factor-items", written)
    n_users, n_items = users.count(), items.count()
    if not n_users or not n_items:
        raise ValueError("no interactions to learn from")
    spark = pairs.sparkSession
    ship_package(spark)
    folder = shared_path(spark, "factor-blocks")
    u, v = _Side(users, "userId", n_users, rank, folder), _Side(items, "itemId", n_items, rank, folder)
    u.write_ids(users, None, seed)
    v.write_ids(items, (2.0 / (n_items + rank)) ** 0.5, seed)
    u.write_pairs(pairs, v)
    v.write_pairs(pairs, u)
    for path in written:
        _drop(spark, path)
    for _ in range(sweeps):
        for side, fixed in ((u, v), (v, u)):
            solve_side(side, fixed, n_users * n_items, reg)
            if history is not None:
                history.append(tuple(factor_loss(u.table(), v.table(), None, reg, digits=None, seen_terms=seen_terms(u, v)).first()))
    return u.table(), v.table()

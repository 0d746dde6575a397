"""Exact cosine range join of vectors by pivots.

Unit vectors with cosine >= c lie within r = sqrt(2 - 2c) of each other.  A
bounded number of pivots cuts the space into cells (nearest pivot).  By the
triangle inequality, sharpened to the bisector of two pivots, a vector can only
have a partner in another pivot's cell if it lies within r of the bisector, and
so must the partner.

Equal vectors are one node with a count.  Nodes are written once, cell by cell,
in blocks of at most ``block`` vectors of one cell; a task holds a block and reads
one half of the others past it, each pair of blocks once, without those whose
cells lie too far off.  No vector is copied for a pair: what is written grows with
the vectors, not with the pairs.  A task returns one row per vector that has links:
how many it found and a representative of the vector's local component, never
the pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql import types as T

from rivulet.llm.common import binaries, drop_path, longs, map_arrow, staged, work_dir
from rivulet.llm.components import connected_components
from rivulet.llm.text import BASE, U, mix
from rivulet.llm.token_frames import _filesystem

#: Vectors aimed at per cell, and the bound of the pivots that every task holds.
CELL = 16_384
MAX_PIVOTS = 512
#: Small tables are cut into as many cells as there are cores, but not below this many vectors.
LEAST_CELL = 64
#: Vectors of a cell that one block holds.
BLOCK = 8_192
#: Tasks per core that hold blocks, at least, and runs of held blocks per core at most.
PARTS_PER_CORE, RUNS_PER_CORE = 4, 32
#: What rounding may add to distances and single-precision cosines.
SLACK = 1e-4


def _single(src: DataFrame) -> bool:
    """Whether the vectors are of single precision, which their bytes then keep."""
    kind = src.schema["vec"].dataType
    return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)


def _vectors(src: DataFrame) -> DataFrame:
    """(id, good, dim, h1, h2, body): the vector's bytes, and 128 bits that name it."""
    kind, width = (np.float32, 4) if _single(src) else (np.float64, 8)

    def run(batches):
        for b in batches:
            arr = b.column(1)
            n = len(arr)
            size = np.array([0 if v is None else v for v in pc.list_value_length(arr).to_pylist()], np.int64)
            flat = arr.flatten()
            holes = flat.is_null().to_numpy(zero_copy_only=False)
            x = flat.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # -0.0 becomes 0.0
            off = np.concatenate(([0], np.cumsum(size)))
            bad = holes | ~np.isfinite(x)
            row = np.repeat(np.arange(n), size)
            good = (np.bincount(row, bad, n) == 0) & (np.bincount(row, np.where(bad, 0, x != 0), n) > 0)
            place = (np.arange(len(x)) - off[row]).astype(np.uint64) * U(BASE)
            names = []
            for salt in (3, 5):
                run_ = np.zeros(len(x) + 1, np.uint64)
                np.cumsum(mix(x.view(np.uint64) ^ mix(place + U(salt))), out=run_[1:])
                names.append((run_[off[1:]] - run_[off[:-1]]).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(good), longs(size), longs(names[0]), longs(names[1]),
                                              binaries(x.astype(kind).tobytes(), off * width)],
                                             names=["id", "good", "dim", "h1", "h2", "body"])

    return map_arrow(src, run, "id long, good boolean, dim long, h1 long, h2 long, body binary")


def _unit(bodies, dim: int, single: bool) -> np.ndarray:
    x = np.frombuffer(b"".join(bodies), np.float32 if single else np.float64).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def pick_pivots(nodes: DataFrame, cell: int, limit: int, single: bool) -> dict[int, np.ndarray]:
    """Unit pivots by dimension: the nodes with the smallest id hashes, ``limit`` at most in all."""
    n = nodes.count()
    cores = nodes.sparkSession.sparkContext.defaultParallelism
    k = min(limit, max(1, math.ceil(n / cell), min(cores, n // LEAST_CELL)))
    rows = nodes.orderBy(F.xxhash64("node"), "node").select("dim", "body").limit(k).collect()
    out: dict[int, list[bytes]] = {}
    for r in rows:
        out.setdefault(r["dim"], []).append(bytes(r["body"]))
    return {d: _unit(v, d, single) for d, v in out.items()}


def near_bisector(x: np.ndarray, own: np.ndarray, other: np.ndarray, r: float) -> np.ndarray:
    """Which unit rows of pivot ``own``'s cell may have a partner within ``r`` in ``other``'s."""
    gap = 2 * math.sqrt(max(2 - 2 * float(own @ other), 0))
    return 2 * (x @ (own - other)) <= r * gap + SLACK


class _Block:
    """Vectors of one cell."""

    def __init__(self, batch: pa.RecordBatch, dim: int, single: bool):
        self.node, self.n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        self.x = _unit([v.as_buffer() for v in batch.column(2)], dim, single)
        self.rough = self.x.astype(np.float32)


def _hits(a: _Block, at: np.ndarray, b: _Block, bt: np.ndarray, same: bool, cos: float, step: int = 1024):
    """(rows of a, rows of b, linked?) tile by tile for the rows ``at`` and ``bt``; ``same``: each pair of one block once.

    Single precision finds candidates, double decides."""
    sa, sb = (x.rough if len(i) == len(x.x) else x.rough[i] for x, i in ((a, at), (b, bt)))
    for i in range(0, len(at), step):
        for j in range(i if same else 0, len(bt), step):
            s = sa[i:i + step] @ sb[j:j + step].T
            if same and i == j:
                np.fill_diagonal(s, -1)
            ra = np.flatnonzero(s.max(axis=1) >= cos - SLACK)
            if not len(ra):
                continue
            rough = s[ra] >= cos - SLACK
            if same and i == j:
                rough &= np.arange(s.shape[1]) > ra[:, None]
            rb = np.flatnonzero(rough.any(axis=0))
            ia, ib = at[i + ra], bt[j + rb]
            hit = rough[:, rb] & (a.x[ia] @ b.x[ib].T >= cos)
            if hit.any():
                yield ia, ib, hit


class _Held:
    """A block, the links that its vectors have had so far, and the first row of each one's component by them."""

    def __init__(self, block: _Block, cos: float):
        self.block, self.cos = block, cos
        self.links, self.part = np.zeros(len(block.x), np.int64), np.arange(len(block.x))

    def _rows(self, node, links, peer):
        at = np.flatnonzero(links)
        if len(at):
            yield pa.RecordBatch.from_arrays([longs(node[at]), longs(links[at]), longs(peer[at])], names=["node", "links", "peer"])

    def meet(self, other: _Block | None, at: np.ndarray, bt: np.ndarray):
        """Links with another block (None: with itself): the rows of the other's vectors."""
        a, b, n = self.block, other or self.block, len(self.part)
        shift = 0 if other is None else n
        links = self.links if other is None else np.zeros(len(b.x), np.int64)
        part = self.part if other is None else np.concatenate((self.part, n + np.arange(len(b.x))))
        for ia, ib, hit in _hits(a, at, b, bt, other is None, self.cos):
            self.links[ia] += hit @ b.n[ib]
            links[ib] += hit.T @ a.n[ia]
            for i in np.flatnonzero(hit.any(axis=1)):
                near, p = part[shift + ib[hit[i]]], part[ia[i]]
                if (near != p).any():
                    join = np.unique(np.append(near, p))
                    part[np.isin(part, join)] = join[0]
        self.part = part[:n]
        if other is not None:   # a linked vector's component starts in the held block
            yield from self._rows(b.node, links, a.node[np.where(links > 0, part[n:], 0)])

    def rows(self):
        yield from self._rows(self.block.node, self.links, self.block.node[self.part])


def _homes(nodes: DataFrame, pivots: dict[int, np.ndarray], single: bool) -> DataFrame:
    """(dim, cell, node, n, body): each node with its nearest pivot's cell, cell by cell."""
    known = nodes.sparkSession.sparkContext.broadcast(pivots)  # MAX_PIVOTS vectors

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                dims = b.column(1).to_numpy()
                cell = np.zeros(b.num_rows, np.int64)
                for d in np.unique(dims):
                    p, rows = known.value.get(int(d)), np.flatnonzero(dims == d)
                    if p is not None:
                        x = _unit([v.as_buffer() for v in b.column(3).take(pa.array(rows))], int(d), single)
                        cell[rows] = (x @ p.T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([b.column(1), longs(cell), b.column(0), b.column(2), b.column(3)],
                                                 names=["dim", "cell", "node", "n", "body"])

    homes = map_arrow(nodes.select("node", "dim", "n", "body"), run, "dim long, cell long, node long, n long, body binary")
    return homes.repartitionByRange("dim", "cell", "node").sortWithinPartitions("dim", "cell", "node")


def _written_blocks(homes: DataFrame, pivots: dict[int, np.ndarray], block: int, folder: str, single: bool) -> list:
    """Blocks of one cell each, written below ``folder`` as record batches of a file per task: rows (dim, cell, rows,
    reach, path, at), ``reach`` the largest distance to the pivot."""
    known = homes.sparkSession.sparkContext.broadcast(pivots)
    schema = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("body", pa.binary())])

    def run(batches):
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        task = TaskContext.get()
        fs, path = _filesystem(folder)
        fs.create_dir(path, recursive=True)
        name = f"blocks-{task.partitionId():06d}-{task.taskAttemptId()}.arrow"
        made, held, key, size = [], [], None, 0
        with fs.open_output_stream(f"{path}/{name}", compression=None) as f, pa.ipc.new_file(f, schema) as out:
            def close():
                t = pa.Table.from_batches(held).select(["node", "n", "body"]).combine_chunks().cast(schema)
                d, c = key
                p, reach = known.value.get(d), 2.0
                if p is not None:
                    x = _unit([v.as_buffer() for v in t.column(2).chunk(0)], d, single)
                    reach = math.sqrt(max(2 - 2 * float((x @ p[c]).min()), 0))
                out.write_table(t, max_chunksize=t.num_rows)
                made.append((d, c, t.num_rows, reach, f"{folder}/{name}", len(made)))

            for b in (x for part in ([first], batches) for x in part):
                marks = np.stack([b.column(i).to_numpy() for i in range(2)], axis=1)
                cut = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1
                for lo, hi in zip([0, *cut], [*cut, b.num_rows]):
                    while lo < hi:
                        if tuple(marks[lo].tolist()) != key or size == block:
                            if held:
                                close()
                            held, key, size = [], tuple(marks[lo].tolist()), 0
                        part = b.slice(lo, min(hi - lo, block - size))
                        held.append(part)
                        size, lo = size + part.num_rows, lo + part.num_rows
            close()
        yield pa.RecordBatch.from_pydict({c: [m[i] for m in made] for i, c in enumerate(("dim", "cell", "rows", "reach", "path", "at"))})

    rows = map_arrow(homes, run, "dim long, cell long, rows long, reach double, path string, at long").collect()  # a row for each block
    return sorted(tuple(r) for r in rows)


def partners(blocks: list, a: int, first: int, n: int) -> list[int]:
    """Of the ``n`` blocks of one length of vector from ``first`` on, those that block ``a`` meets: itself and a half of
    the others, each pair at one of its ends."""
    k = a - first
    half = n // 2 if n % 2 or k < n // 2 else n // 2 - 1
    return [first + (k + o) % n for o in range(half + 1)]


def _joined(spark, blocks: list, pivots: dict[int, np.ndarray], cos: float, single: bool) -> DataFrame:
    """(node, links, peer) of all pairs of blocks that may hold linked vectors."""
    r = math.sqrt(max(2 - 2 * cos, 0)) + 1e-6
    span: dict[int, tuple[int, int]] = {}
    for i, m in enumerate(blocks):
        first, n = span.get(m[0], (i, 0))
        span[m[0]] = first, n + 1
    cores = spark.sparkContext.defaultParallelism
    groups = max(1, math.ceil(PARTS_PER_CORE * cores / max(1, len(blocks))))   # tasks that share the partners of a block
    known = spark.sparkContext.broadcast((blocks, span, pivots))  # MAX_PIVOTS vectors, a few numbers for each block

    def run(batches):
        blocks, span, pivots = known.value
        files, held, at_held = {}, None, None

        def load(i: int) -> _Block:
            path, at = blocks[i][4:]
            if path not in files:
                if len(files) > 64:
                    files.clear()
                fs, name = _filesystem(path)
                files[path] = pa.ipc.open_file(fs.open_input_file(name))
            return _Block(files[path].get_batch(at), blocks[i][0], single)

        for batch in batches:
            for k in batch.column(0).to_pylist():
                a, g = divmod(k, groups)
                d, c, _, reach = blocks[a][:4]
                if at_held != a:
                    held, at_held = load(a), a
                mine = _Held(held, cos)
                every = np.arange(len(held.x))
                for b in partners(blocks, a, *span[d])[g::groups]:
                    if b == a:
                        yield from mine.meet(None, every, every)
                        continue
                    e, p = blocks[b][1], pivots.get(d)
                    if e != c and math.sqrt(max(2 - 2 * float(p[c] @ p[e]), 0)) > reach + blocks[b][3] + r + SLACK:
                        continue
                    at = every if e == c else np.flatnonzero(near_bisector(held.x, p[c], p[e], r))
                    if not len(at):
                        continue
                    other = load(b)
                    bt = np.arange(len(other.x)) if e == c else np.flatnonzero(near_bisector(other.x, p[e], p[c], r))
                    if len(bt):
                        yield from mine.meet(other, at, bt)
                yield from mine.rows()

    n = len(blocks) * groups
    tasks = spark.range(0, n, 1, max(1, min(n, RUNS_PER_CORE * cores)))
    return map_arrow(tasks, run, "node long, links long, peer long")


def cosine_links(vectors: DataFrame, cos: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding",
                 cell: int = CELL, max_pivots: int = MAX_PIVOTS, block: int = BLOCK) -> DataFrame:
    """One row per row of ``vectors``: id, n_links, component_id, kept.

    Rows with cosine >= ``cos`` are linked; n_links counts the other rows linked
    directly, component_id is the smallest id reachable, kept marks it.  Vectors
    that are null, empty, zero or hold a null or non-finite component link with
    nothing, as do vectors of different lengths with each other.  Null id:
    linked with nothing, component_id null, kept.  Repeated rows link with each
    other.  Rows with one id and different vectors are different vectors, each
    with its own links.  Equal vectors are found by a 128-bit name.  Other
    columns are not read.
    """
    if not 0 < cos <= 1:
        raise ValueError("cos must lie in (0, 1]")
    src = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").alias("vec"))
    spark, single = src.sparkSession, _single(src)
    vec = staged(_vectors(src).drop("body"), "vectors")     # the bytes are made again for the nodes, not kept
    good = F.col("good") & F.col("id").isNotNull()
    usable = vec.where(good)
    name = ["dim", "h1", "h2"]
    # nodes are numbered, not named by an id: one id may stand before several vectors
    nodes = staged(_vectors(src).where(good).groupBy(*name).agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("body").alias("body"))
                   .withColumn("node", F.monotonically_increasing_id()), "nodes")
    pivots, folder = pick_pivots(nodes, cell, max_pivots, single), work_dir(spark, "blocks")
    blocks = _written_blocks(_homes(nodes, pivots, single), pivots, block, folder, single)
    found = staged(_joined(spark, blocks, pivots, cos, single), "links")
    drop_path(spark, folder)
    comp = staged(connected_components(found, "node", "peer").toDF("node", "component"), "components")
    comp = comp.union(comp.select("component", "component").distinct())
    low = comp.join(nodes.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("component_id"))
    total = found.groupBy("node").agg(F.sum("links").alias("links"))
    merged = staged(nodes.select(*name, "node", "least", "n").join(total, "node", "left").join(comp.join(low, "component"), "node", "left").select(
        *name, (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("component_id", "least").alias("component_id")), "merged")
    linked = usable.select("id", *name).join(merged, name).select("id", "n_links", "component_id")
    alone = vec.where(~F.col("good") | F.col("id").isNull()).select(
        "id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id",
                                            F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))

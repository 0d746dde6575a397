"""Near-duplicate documents by HyperMinHash over word shingles.

Sketch: the shingle hashes of a document fall into 256 buckets; each bucket
keeps its smallest hash as a register of 16 bits, 6 for the leading-zero count
and 10 for the bits that follow (0: empty bucket).  Documents with the same
shingle set are one node.  Registers are cut into bands; nodes that share a
band are a candidate group, and groups with the same members count once.
Inside a group the collision-corrected estimate links nodes; components of
these links are clusters, and inside a cluster the full sets confirm.  Only
spanning forests leave a task, never the pairs.

Small sets use wider bands, by size class: a document emits bands of its class
and, near the class border, of the class below, so two sets that can reach the
threshold always meet in one class.

Recall: a pair is no candidate if every common shingle lies in a band that a
differing one breaks.  From about 200 shingles on, at the threshold 0.85 the 42
bands of 6 registers miss a pair with a probability near 2e-9 (0.8: 3e-6).  c
common and d differing shingles miss w bands with at most (d / w)^c, at 0.8 for
sets of 16 shingles (4 / 16)^16 = 2e-10, less up to 128.  For sets of fewer than
``SMALL`` this is not small ((1 / 4)^4 for 4 and 5 shingles), so they, and sets
that can reach the threshold with one of them, are also candidates by single
shingles: similar sets of n share one of the first n - ceil(t n) + 1 in the
order of the hashes, and no such pair is lost.

Skew: copies collapse before anything else; band groups reduce to a few numbers
with map-side combining; a group beyond ``GROUP`` nodes is dealt to pairs of
blocks, each a group of its own.  A cluster beyond ``block`` shingles is dealt to
blocks too.  A few blocks meet in pairs.  Of more, every block is first confirmed
together with a few pivots of the cluster, which joins nearly all of a group of
near copies; then only the nodes outside the largest component so found, the rest,
meet each other and every block.  No task holds an unbounded group and no pair is
left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.llm.common import binaries, fresh, longs, map_arrow, map_text, staged, text_buffer
from rivulet.llm.components import connected_components
from rivulet.llm.text import BASE, U, mix, shingle_sets

P_BITS = 8
REGISTERS = 1 << P_BITS
R_BITS = 10
#: Standard deviations that an estimate may lie below the threshold before a pair is rejected unverified.
SLACK = 6.0
#: Shingles and nodes of one block of a cluster; larger clusters are split into blocks.
BLOCK = 1 << 20
BLOCK_NODES = 1 << 13
#: Clusters of up to so many blocks are compared by pairs of blocks at once, larger ones with pivots first.
FEW_BLOCKS = 8
#: Nodes of such a cluster that every block of it holds at first.
PIVOTS = 4
#: Sets of fewer shingles are candidates by single shingles too.
SMALL = 16
#: Nodes of a candidate group that one task holds.
GROUP = 1 << 14

L = T.LongType()


def registers(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, REGISTERS) uint16 registers of sorted distinct hashes."""
    n = len(offsets) - 1
    out = np.zeros((n, REGISTERS), np.uint16)
    at = 0
    while at < n:  # bounded steps: the intermediate arrays are many times the result
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + (1 << 16), "right")) - 1)
        out[at:to] = _registers(sets[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at])
        at = to
    return out


def _registers(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    out = np.zeros((n, REGISTERS), np.uint16)
    if not len(sets):
        return out
    doc = np.repeat(np.arange(n), np.diff(offsets))
    bucket = (sets >> U(64 - P_BITS)).astype(np.int64)
    cell = doc * REGISTERS + bucket
    head = np.concatenate(([True], cell[1:] != cell[:-1]))  # sorted: the smallest hash of each bucket
    low = sets[head] << U(P_BITS)
    _, exp = np.frexp((low >> U(11)).astype(np.float64))  # 53 bits: exact
    zeros = np.minimum(53 - exp, 52)
    mantissa = (low << (zeros + 1).astype(np.uint64)) >> U(64 - R_BITS)
    out.reshape(-1)[cell[head]] = ((zeros + 1) << R_BITS).astype(np.uint16) | mantissa.astype(np.uint16)
    return out


def set_names(sets: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit names of each set (order-free sums of two mixings)."""
    out = []
    for salt in (1, 2):
        run = np.zeros(len(sets) + 1, np.uint64)
        np.cumsum(mix(sets ^ U(BASE * salt % (1 << 64))), out=run[1:])
        out.append((run[offsets[1:]] - run[offsets[:-1]]).view(np.int64))
    return out[0], out[1]


def sketches(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text",
             keep: list[str] | None = None, with_registers: bool = True, num: int = 80, den: int = 100) -> DataFrame:
    """``keep`` columns (default the id), n_shingles, fp1, fp2 (the set's name) of each row.

    With registers also these and, for small sets, the candidate keys at num / den.
    A name that ``keep`` has already gets leading underscores.
    """
    keep = keep or [id_col]
    names = fresh(keep, "n_shingles", "fp1", "fp2", "regs", "firsts")
    fields = [T.StructField(c, L) for c in names[:3]]
    if with_registers:
        fields += [T.StructField(c, T.BinaryType()) for c in names[3:]]

    def fn(text):
        sets, off = shingle_sets(*text_buffer(text), k)
        a, b = set_names(sets, off)
        cols = [longs(np.diff(off)), longs(a), longs(b)]
        if with_registers:
            cols.append(binaries(registers(sets, off).tobytes(), np.arange(len(off)) * (2 * REGISTERS)))
            cols.append(prefix_bodies(sets, off, num, den))
        return cols

    return map_text(docs, text_col, keep, fields, fn)


def band_width(n: np.ndarray) -> np.ndarray:
    """Registers in a band, by set size."""
    return np.select([n < 8, n < 16, n < 32, n < 64], [64, 32, 16, 8], 6)


def band_keys(ids: np.ndarray, n: np.ndarray, regs: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, id) of every band with a register that is not empty, for a row's class and a lower one it borders."""
    keys, who = [], []
    mine, below = band_width(n), band_width(-(-n * num // den))
    for w in (6, 8, 16, 32, 64):
        pick = np.flatnonzero((mine == w) | ((below >= w) & (mine < w)))
        for at in range(0, len(pick), 4096):
            p = pick[at:at + 4096]
            r = regs[p][:, :REGISTERS // w * w].reshape(len(p), -1, w).astype(np.uint64)
            h = np.zeros(r.shape[:2], np.uint64)
            for j in range(w):
                h = mix(h * U(BASE) + r[:, :, j])
            h = mix(h + (np.arange(r.shape[1], dtype=np.uint64) * U(64) + U(w)) * U(BASE))
            full = r.any(axis=2)
            keys.append(h[full])
            who.append(np.broadcast_to(ids[p][:, None], full.shape)[full])
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(keys).view(np.int64), np.concatenate(who)


def prefixes(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """How many shingles of a set of ``n`` are candidate keys; none if it is far from small."""
    least = -(-n * num // den)
    return np.where(least < SMALL, n - least + 1, 0)


def prefix_bodies(sets: np.ndarray, offsets: np.ndarray, num: int, den: int) -> pa.Array:
    """The candidate keys of each set: its first sorted hashes, mixed."""
    take = prefixes(np.diff(offsets), num, den)
    to = np.concatenate(([0], np.cumsum(take)))
    at = np.arange(to[-1]) - np.repeat(to[:-1] - offsets[:-1], take)
    return binaries(mix(sets[at] ^ U(BASE)).tobytes(), to * 8)


def _bands(nodes: DataFrame, num: int, den: int) -> DataFrame:
    def run(batches):
        for b in batches:
            if b.num_rows:
                regs = _registers_of(b.column(2))
                for at in range(0, b.num_rows, 4096):
                    s = slice(at, at + 4096)
                    key, who = band_keys(b.column(0).to_numpy()[s], b.column(1).to_numpy()[s], regs[s], num, den)
                    yield pa.RecordBatch.from_arrays([longs(key), longs(who)], names=["key", "node"])
                bodies = b.column(3).to_pylist()
                who = np.repeat(b.column(0).to_numpy(), [len(x) // 8 for x in bodies])
                yield pa.RecordBatch.from_arrays([longs(np.frombuffer(b"".join(bodies), np.int64)), longs(who)], names=["key", "node"])

    return map_arrow(nodes.select("node", "n_shingles", "regs", "firsts"), run, "key long, node long")


def random_matches(n: np.ndarray, m: int) -> np.ndarray:
    """Expected equal registers of two unrelated sets of n and m shingles."""
    r = n / m
    return 0.169919487159739 * 2.0 ** (P_BITS - R_BITS) * 4 * r / (1 + r) ** 2


def _registers_of(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _floor(size_a, size_b, either, t: float):
    """The least estimate that is not rejected."""
    return t - SLACK * np.sqrt(t * (1 - t) / np.maximum(either, 1))


def estimated(regs_a: np.ndarray, regs_b: np.ndarray, size_a, size_b, t: float) -> np.ndarray:
    """Whether the collision-corrected estimates of rows of ``regs_a`` with those of ``regs_b`` may reach ``t``."""
    same = ((regs_a == regs_b) & (regs_a != 0)).sum(axis=1)
    either = ((regs_a != 0) | (regs_b != 0)).sum(axis=1)
    est = (same - random_matches(size_a, size_b)) / np.maximum(either, 1)
    return est >= _floor(size_a, size_b, either, t)


def link_group(ids: np.ndarray, size: np.ndarray, regs: np.ndarray, num: int, den: int, confirm=None) -> np.ndarray:
    """Spanning links (smallest id, id) of the rows of one group, as an (n, 2) array.

    Rows are linked when sizes and estimate allow the similarity num / den and
    ``confirm(i, j)``, if given, holds.  Rows already connected are not compared.
    """
    order = np.lexsort((ids, size))
    size_, regs = size[order], regs[order]
    part = np.arange(len(ids))
    for i in range(len(ids) - 1):
        hi = int(np.searchsorted(size_, size_[i] * den // num, "right"))  # larger sets cannot reach the threshold
        c = i + 1 + np.flatnonzero(part[i + 1:hi] != part[i])
        for at in range(0, len(c), 4096):
            j = c[at:at + 4096]
            near = j[estimated(regs[j], regs[i], size_[j], size_[i], num / den)]
            if confirm is None:
                if len(near):
                    part[np.isin(part, part[near])] = part[i]
                continue
            for x in near:
                if part[x] != part[i] and confirm(order[i], order[x]):
                    part[part == part[x]] = part[i]
    out = []
    ids = ids[order]
    for p in np.unique(part):
        who = np.unique(ids[part == p])
        if len(who) > 1:
            out.append(np.stack((np.full(len(who) - 1, who[0]), who[1:]), axis=1))
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def _groups(batches, keys: int):
    """Record batches of whole groups from rows sorted by the first ``keys`` columns, with the group borders."""
    held, last = [], None

    def borders(t):
        cols = [t.column(i).to_numpy() for i in range(keys)]
        new = np.zeros(t.num_rows, bool)
        new[:1] = True
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        return np.append(np.flatnonzero(new), t.num_rows)

    for b in batches:
        if not b.num_rows:
            continue
        at = borders(b)
        first = tuple(b.column(i)[0].as_py() for i in range(keys))
        cut = 0 if last is None or first != last else int(at[1])
        if held and cut < b.num_rows:  # the group held so far ends here
            t = pa.concat_batches([*held, b.slice(0, cut)])
            held = []
            yield t, borders(t)
        if cut == b.num_rows:
            held.append(b)
            continue
        tail = int(at[-2])
        if tail > cut:
            t = b.slice(cut, tail - cut)
            yield t, borders(t)
        held, last = [b.slice(tail)], tuple(b.column(i)[tail].as_py() for i in range(keys))
    if held:
        t = pa.concat_batches(held)
        yield t, borders(t)


def _edges(found: list[np.ndarray]):
    if found:
        e = np.concatenate(found)
        yield pa.RecordBatch.from_arrays([longs(e[:, 0]), longs(e[:, 1])], names=["a", "b"])


def _dealt(rows: DataFrame, blocks: Column, node: str, *rest: str) -> DataFrame:
    """Rows of a group sent to every pair of its blocks that holds their own: (rest, i, j, node)."""
    mine = F.pmod(F.xxhash64(node), blocks).cast("int")
    pair = F.explode(F.transform(F.sequence(F.lit(0), blocks - 1),
                                 lambda o: F.struct(F.least(o, mine).alias("i"), F.greatest(o, mine).alias("j"))))
    return rows.withColumn("p", pair).select(*rest, "p.i", "p.j", node)


def _likely(groups: DataFrame, num: int, den: int) -> DataFrame:
    """Spanning links by estimate of the candidate groups (key, i, j, node, n_shingles, regs)."""
    def run(batches):
        for t, at in _groups(batches, 3):
            ids, size, regs = t.column(3).to_numpy(), t.column(4).to_numpy(), _registers_of(t.column(5))
            found = []
            two = at[:-1][np.diff(at) == 2]  # most groups: all at once
            if len(two):
                fit = np.minimum(size[two], size[two + 1]) * den >= np.maximum(size[two], size[two + 1]) * num
                two = two[fit]
                two = two[estimated(regs[two], regs[two + 1], size[two], size[two + 1], num / den)]
                found.append(np.sort(np.stack((ids[two], ids[two + 1]), axis=1), axis=1))
            for g in np.flatnonzero(np.diff(at) > 2):
                s = slice(at[g], at[g + 1])
                found.append(link_group(ids[s], size[s], regs[s], num, den))
            yield from _edges(found)

    g = groups.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
    return map_arrow(g, run, "a long, b long")


def missing_links(ids: np.ndarray, size: np.ndarray, regs: np.ndarray, part: np.ndarray, side: np.ndarray, num: int, den: int, confirm) -> np.ndarray:
    """Links that join the parts of one group, found as in ``link_group`` but from rows already parted; with two
    sides only rows of different sides are compared."""
    order = np.lexsort((ids, size))
    size_, regs, part, side = size[order], regs[order], part[order].copy(), side[order]
    two = len(ids) and side.min() != side.max()
    out = []
    for i in range(len(ids) - 1):
        hi = int(np.searchsorted(size_, size_[i] * den // num, "right"))
        c = i + 1 + np.flatnonzero((part[i + 1:hi] != part[i]) & (side[i + 1:hi] != side[i])) if two else i + 1 + np.flatnonzero(part[i + 1:hi] != part[i])
        for at in range(0, len(c), 4096):
            j = c[at:at + 4096]
            for x in j[estimated(regs[j], regs[i], size_[j], size_[i], num / den)]:
                if part[x] != part[i] and confirm(order[i], order[x]):
                    out.append((ids[order[i]], ids[order[x]]))
                    part[part == part[x]] = part[i]
    return np.array(out, np.int64).reshape(-1, 2)


def _verified(groups: DataFrame, num: int, den: int, parted: bool = False) -> DataFrame:
    """Spanning links, confirmed on full sets, of the groups (cluster, i, j, node, part, side, body); with ``parted``
    only those between rows of different parts and sides."""
    def run(batches):
        for t, at in _groups(batches, 3):
            ids, part, side, body = t.column(3).to_numpy(), t.column(4).to_numpy(), t.column(5).to_numpy(), t.column(6)
            found = []
            for g in np.flatnonzero(np.diff(at) > 1):
                s = slice(at[g], at[g + 1])
                sets = [np.frombuffer(body[r].as_buffer(), np.uint64) for r in range(at[g], at[g + 1])]
                size = np.array([len(x) for x in sets], np.int64)

                def confirm(i, j):
                    both = size[i] + size[j] - len(np.unique(np.concatenate((sets[i], sets[j]))))
                    return den * both >= num * (size[i] + size[j] - both)

                regs = registers(np.concatenate(sets), np.concatenate(([0], np.cumsum(size))))
                found.append(missing_links(ids[s], size, regs, part[s], side[s], num, den, confirm) if parted else
                             link_group(ids[s], size, regs, num, den, confirm))
            yield from _edges(found)

    g = groups.repartition("cluster", "i", "j").dropDuplicates(["cluster", "i", "j", "node"])  # repeated rows; needs no other exchange
    return map_arrow(g.sortWithinPartitions("cluster", "i", "j", "node").select("cluster", "i", "j", "node", "part", "side", "body"), run, "a long, b long")


def _split_clusters(body: DataFrame, block: int, num: int, den: int) -> DataFrame:
    """Links (a, b) of clusters of several blocks; ``body``: (node, cluster, blocks, n_shingles, body), written."""
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    first = Window.partitionBy("cluster").orderBy(F.xxhash64("node"), "node")
    pivots = (body.select("node", "cluster").distinct().withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= PIVOTS)
              .select("node", "cluster", F.lit(True).alias("pivot")))
    rows = body.join(pivots, ["node", "cluster"], "left")
    place = F.when(F.col("pivot"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(mine))
    none = F.lit(0).cast("long")
    dealt = rows.withColumn("i", F.explode(place)).select("cluster", "i", F.col("i").alias("j"), "node", none.alias("part"), none.alias("side"), "body")
    links = staged(_verified(dealt, num, den), "block-links")
    part = connected_components(links)
    known = staged(body.select("node", "cluster", "blocks", "n_shingles").distinct().join(part.toDF("node", "component"), "node", "left")
                   .withColumn("part", F.coalesce("component", "node")).drop("component"), "parts")
    main = known.groupBy("cluster", "part").count().groupBy("cluster").agg(F.max_by("part", F.struct("count", -F.col("part"))).alias("main"))
    rest = known.join(main, "cluster").where(F.col("part") != F.col("main"))
    size = staged(rest.groupBy("cluster").agg(F.greatest(F.ceil(F.sum("n_shingles") / block), F.ceil(F.count(F.lit(1)) / BLOCK_NODES))
                                              .cast("int").alias("rests")), "rests")
    if size.isEmpty():
        return links
    here = body.select("node", "body").dropDuplicates(["node"]).join(known, "node").join(size, "cluster").join(main, "cluster")
    # blocks 0 .. rests - 1 hold the rest, the following ones the largest component: pairs with the rest in them
    own = F.pmod(F.xxhash64("node", F.lit(1)), F.col("rests")).cast("int")
    here = here.withColumn("mine", F.when(F.col("part") == F.col("main"), F.col("rests") + mine).otherwise(own))

    def pair(o):
        return F.struct(F.least(o, F.col("mine")).alias("i"), F.greatest(o, F.col("mine")).alias("j"))

    rests, every = F.sequence(F.lit(0), F.col("rests") - 1), F.sequence(F.lit(0), F.col("rests") + F.col("blocks") - 1)
    meets = F.when(F.col("part") == F.col("main"), F.transform(rests, pair)).otherwise(F.transform(every, pair))
    dealt = here.withColumn("p", F.explode(meets)).select("cluster", "p.i", "p.j", "node", "part", F.col("mine").cast("long").alias("side"), "body")
    return links.union(_verified(dealt, num, den, parted=True))


def set_components(docs: DataFrame, sk: DataFrame, k: int, num: int, den: int, id_col: str, text_col: str,
                   block: int = BLOCK) -> DataFrame:
    """(n_shingles, fp1, fp2, component_id) of every distinct non-empty shingle set."""
    name = ["n_shingles", "fp1", "fp2"]
    # nodes are numbered, not named by an id: one id may stand before several texts
    nodes = staged(sk.where((F.col("n_shingles") > 0) & F.col("doc").isNotNull()).groupBy(*name).agg(
        F.min("doc").alias("least"), F.first("regs").alias("regs"), F.first("firsts").alias("firsts"))
        .withColumn("node", F.monotonically_increasing_id()), "nodes")
    bands = _bands(nodes, num, den)
    groups = (bands.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("n"),
                                       F.bit_xor(F.xxhash64("node")).alias("who")).where("low < high"))
    groups = staged(groups.groupBy("low", "high", "n", "who").agg(F.min("key").alias("key")).select(
        "key", F.ceil(F.col("n") / GROUP).cast("int").alias("blocks")), "groups")  # the same members once
    member = _dealt(bands.join(groups, "key"), F.col("blocks"), "node", "key")
    likely = _likely(member.join(nodes.select("node", "n_shingles", "regs"), "node").select(
        "key", "i", "j", "node", "n_shingles", "regs"), num, den)

    member = connected_components(likely)
    member = staged(member.union(member.select("component", "component").distinct()).toDF("node", "cluster")
                    .join(nodes.select("node", "least", *name), "node"), "members")
    big = staged(member.groupBy("cluster").agg(F.greatest(F.ceil(F.sum("n_shingles") / block), F.ceil(F.count(F.lit(1)) / BLOCK_NODES))
                                               .cast("int").alias("blocks")).where("blocks > 1"), "big")
    member = member.join(big, "cluster", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))

    def bodies(which: DataFrame) -> DataFrame:
        text = docs.select(F.col(f"`{id_col}`").cast("long").alias("least"), F.col(f"`{text_col}`").alias("text")).join(which, "least")
        body = map_text(text, "text", ["node", "cluster", "blocks", *name],
                        [T.StructField("body", T.BinaryType()), *[T.StructField(c, L) for c in ("n", "x", "y")]], lambda text: _set_bodies(text, k))
        return body.where((F.col("n") == F.col("n_shingles")) & (F.col("x") == F.col("fp1")) & (F.col("y") == F.col("fp2")))  # not another text of this id

    none = F.lit(0).cast("long")
    few = _dealt(bodies(member.where(F.col("blocks") <= FEW_BLOCKS)), F.col("blocks"), "node", "cluster", "body")
    links = _verified(few.select("cluster", "i", "j", "node", none.alias("part"), none.alias("side"), "body"), num, den)
    if not big.where(F.col("blocks") > FEW_BLOCKS).isEmpty():
        large = staged(bodies(member.where(F.col("blocks") > FEW_BLOCKS)).select("node", "cluster", "blocks", "n_shingles", "body"), "bodies")
        links = links.union(_split_clusters(large, block, num, den))
    comp = staged(connected_components(links).toDF("node", "component"), "components")
    low = comp.union(comp.select("component", "component").distinct()).join(nodes.select("node", "least"), "node").groupBy("component").agg(
        F.min("least").alias("component_id"))
    of = comp.union(comp.select("component", "component").distinct()).join(low, "component").select("node", "component_id")
    return nodes.select(*name, "node", "least").join(of, "node", "left").select(*name, F.coalesce("component_id", "least").alias("component_id"))


def _set_bodies(text: pa.Array, k: int) -> list[pa.Array]:
    """The whole sets, their sizes and names."""
    sets, off = shingle_sets(*text_buffer(text), k)
    a, b = set_names(sets, off)
    return [binaries(sets.tobytes(), off * 8), longs(np.diff(off)), longs(a), longs(b)]


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id",
                    text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, fp1, fp2, component_id, kept.

    Rows are linked when num / den or more of their shingles are shared;
    component_id is the smallest id reachable.  Null text, empty text and text
    without words: no shingles, component_id = id, kept.  Null id: linked with
    nothing, component_id null, kept.  Repeated rows are copies of each other.
    Rows with one id and different texts are different documents: each is linked
    by its own text, and each is kept if no smaller id is reachable from it.
    Shingles are compared by 64-bit hashes, equal sets found by a 128-bit name.
    Columns of ``docs`` other than the two named are not read.
    """
    sk = staged(sketches(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").alias("text")),
                         k, "doc", num=num, den=den), "sketches")
    sets = staged(set_components(docs, sk, k, num, den, id_col, text_col, block), "sets")
    none = F.col("doc").isNull() | (F.col("n_shingles") == 0)
    named = sk.drop("regs", "firsts")
    linked = named.where(~none).join(sets, ["n_shingles", "fp1", "fp2"])
    alone = named.where(none).withColumn("component_id", F.col("doc"))
    return linked.unionByName(alone).select(
        F.col("doc").alias(id_col), "n_shingles", "fp1", "fp2", "component_id",
        F.coalesce(F.col("doc") == F.col("component_id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each group, with their columns.

    Of a group the row with the smallest id stays; of rows with the same id and
    the same shingle set the one whose columns have the smallest hash; rows with
    the same id and different sets are judged each on its own.  Rows with a null
    id stay.
    """
    cols = docs.columns
    name = fresh(cols, "n_shingles", "fp1", "fp2")
    doc, a, b, row = fresh([*cols, *name], "kept_doc", "kept_a", "kept_b", "kept_row")
    kept = near_duplicates(docs, k, num, den, id_col, text_col).where("kept").where(F.col(f"`{id_col}`").isNotNull())
    kept = staged(kept.select(F.col(f"`{id_col}`").alias(doc), F.col("fp1").alias(a), F.col("fp2").alias(b)).distinct(), "kept")
    known = F.col(f"`{id_col}`").cast("long").isNotNull()
    named = sketches(docs.where(known), k, id_col, text_col, keep=cols, with_registers=False)
    stay = named.join(kept, (F.col(f"`{id_col}`").cast("long") == F.col(doc)) & (F.col(name[1]) == F.col(a)) & (F.col(name[2]) == F.col(b)))
    whole = F.struct(*[F.col(f"`{c}`") for c in cols])
    stay = stay.groupBy(doc, a, b).agg(F.min_by(whole, F.xxhash64(F.to_json(whole))).alias(row))
    return stay.select(*[F.col(row)[c].alias(c) for c in cols]).unionByName(docs.where(~known))

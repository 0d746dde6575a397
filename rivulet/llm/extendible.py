"""Sharding by extendible hashing.

A directory is indexed by the leading bits of a key's hash.  A bucket holds all
keys with its prefix; only buckets with more bytes than the limit split, on one
more bit, until every shard fits.  Bytes are summed once by prefix at a depth
somewhat beyond the expected one; the sums of all shorter prefixes follow from
these.  Prefixes that are still too large there are refined from their own keys
alone, until they fit or hold a single key.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import fresh, staged

BITS = 60
#: Bits looked at beyond the expected depth, and at each refinement.
AHEAD = 4
STEP = 8
SHARD_BYTES = 1 << 20


def hash_of(key: Column) -> Column:
    """60 bits of the key's md5."""
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def _prefix(h: Column, depth: int) -> Column:
    return F.shiftright(h, BITS - depth)


def _level(keys: DataFrame, above: int, depth: int, limit: int) -> DataFrame:
    """(cell, split, depth, prefix, shard_bytes) of each prefix of ``depth`` bits.

    Looks at the prefixes of ``above`` to ``depth`` bits; shorter ones are known
    to be split.  split: the cell itself must split further; else depth and
    prefix name its shard.
    """
    cells = staged(keys.groupBy(_prefix(F.col("h"), depth).alias("cell")).agg(
        F.sum("bytes").alias("bytes"), F.min("h").alias("low"), F.max("h").alias("high")), "shard_cells")
    up = cells.withColumn("d", F.explode(F.sequence(F.lit(above), F.lit(depth)))).withColumn(
        "p", F.expr(f"shiftright(cell, {depth} - d)"))
    nodes = staged(up.groupBy("d", "p").agg(F.sum("bytes").alias("b"), F.min("low").alias("lo"), F.max("high").alias("hi"))
                   .withColumn("full", (F.col("b") > limit) & (F.col("lo") < F.col("hi"))), "shard_nodes")
    # prefixes only lose bytes as they grow, so the shard is the first that is not full
    path = up.select("cell", "d", "p").join(nodes, ["d", "p"])
    leaf = path.where(~F.col("full")).groupBy("cell").agg(F.min(F.struct("d", "p", "b")).alias("leaf"))
    return staged(cells.select("cell").join(leaf, "cell", "left").select(
        "cell", F.col("leaf").isNull().alias("split"), F.col("leaf.d").alias("depth"), F.col("leaf.p").alias("prefix"),
        F.col("leaf.b").alias("shard_bytes")), "shard_level")


def assign_shards(docs: DataFrame, limit: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with a struct ``shard`` (renamed if taken): shard_id (the bits), depth, n_bytes, shard_bytes, oversized.

    The key is the id; a null id is replaced by its text's md5.  Rows with equal
    keys cannot be parted: a shard of one key that exceeds the limit is marked
    oversized.  Null and empty texts weigh nothing.  An empty table stays empty.
    """
    h, size, result = fresh(docs.columns, "__h", "__bytes", "shard")
    text = F.col(f"`{text_col}`").cast("string")
    key = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.md5(F.coalesce(text, F.lit(""))))
    keyed = docs.withColumns({h: hash_of(key), size: F.coalesce(F.octet_length(text), F.lit(0)).cast("long")})
    keys = staged(keyed.groupBy(F.col(h).alias("h")).agg(F.sum(size).alias("bytes")), "shard_keys")
    total = keys.agg(F.sum("bytes")).first()[0] or 0
    above, depth = 0, min(BITS, max(1, math.ceil(math.log2(max(1, total / limit)))) + AHEAD)
    taken = [*docs.columns, h, size, result]
    out, found, rest = keyed, [], keys
    while True:
        level = _level(rest, above, depth, limit)
        names = fresh(taken, *[f"__{n}{depth}" for n in ("cell", "split", "depth", "prefix", "bytes")])
        taken += names
        side = level.toDF(*names)
        out = out.join(side, _prefix(F.col(h), depth) == F.col(names[0]), "left")
        found.append(names)
        more = level.where("split").select("cell")
        if depth >= BITS or more.isEmpty():
            break
        rest = staged(rest.join(more, _prefix(F.col("h"), depth) == F.col("cell"), "left_semi"), "shard_keys")
        above, depth = depth + 1, min(BITS, depth + STEP)
    d, p, b = (F.coalesce(*[F.col(n[i]) for n in found]) for i in (2, 3, 4))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.struct(
        F.when(d == 0, F.lit("")).otherwise(F.lpad(F.conv(p.cast("string"), 10, 2), d, F.lit("0"))).alias("shard_id"),
        d.alias("depth"), F.col(size).alias("n_bytes"), b.alias("shard_bytes"), (b > limit).alias("oversized")).alias(result))


def write_shards(docs: DataFrame, out_dir: str, **options) -> DataFrame:
    """Write ``docs`` with one folder per shard and return the directory: shard_id, depth, docs, bytes."""
    a = assign_shards(docs, **options)
    shard = a.columns[-1]
    name, = fresh(docs.columns, "shard_id")
    rows = a.select(*[F.col(f"`{c}`") for c in docs.columns], F.concat(F.lit("b"), F.col(shard)["shard_id"]).alias(name))
    rows.repartition(name).write.partitionBy(name).parquet(out_dir)
    return a.groupBy(F.col(shard)["shard_id"].alias("shard_id"), F.col(shard)["depth"].alias("depth")).agg(
        F.count(F.lit(1)).alias("docs"), F.sum(F.col(shard)["n_bytes"]).alias("bytes"))

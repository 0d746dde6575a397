"""Connected components of an edge table, by alternating star contraction.

Each round joins every node with the smallest of its neighbours (large star,
then small star), so the graph becomes one star per component in a number of
rounds that grows with the logarithm of its size.  Only ids move; a node with
very many neighbours is one hot join key, which adaptive execution splits
(both join sides come straight from an exchange).  Rounds are written to the
shared folder, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import drop_path, staged_at

MAX_ROUNDS = 100


def _smallest(edges: DataFrame) -> DataFrame:
    """(x, m): the smallest y of each x.  Keyed by another expression, so that the join to it is
    exchanged on both sides and a hot x can be split."""
    return (edges.groupBy(F.bitwise_not("x").alias("nx")).agg(F.min("y").alias("m"))
            .select(F.bitwise_not("nx").alias("x"), "m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.col("v").alias("y")),
                                          F.struct(F.col("v").alias("x"), F.col("u").alias("y")))).alias("e")).select("e.*")
    low = _smallest(both).select("x", F.least("x", "m").alias("m"))
    return both.join(low, "x").where((F.col("y") > F.col("x")) & (F.col("y") > F.col("m"))).select(
        F.col("y").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.col("u").alias("x"), F.col("v").alias("y"))
    return down.join(_smallest(down), "x").select(F.explode(F.array(
        F.struct(F.col("y").alias("u"), F.col("m").alias("v")),
        F.struct(F.col("x").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u > v").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every node that is not the smallest of its component.

    Nodes that are the smallest of theirs, or have no edge, have no row.  Null
    ends and self loops are ignored; an empty edge table gives an empty table.
    """
    spark = edges.sparkSession
    cur, path = staged_at(
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).distinct(), "edges")
    mark = _signature(cur)
    for _ in range(MAX_ROUNDS):
        if mark[0] == 0:
            break
        nxt, nxt_path = staged_at(_small_star(_large_star(cur)), "edges")
        new = _signature(nxt)
        drop_path(spark, path)
        cur, path = nxt, nxt_path
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError("components did not settle")
    return cur.select(F.col("u").alias("id"), F.col("v").alias("component"))


def _signature(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]

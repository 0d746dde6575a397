"""Mixing to target weights: iterative proportional fitting, then sampling.

Documents fall into cells (source, language, topic).  The token sums of the
cells are raked to the three target marginals: each sweep scales every value of
a dimension to its target in turn.  A document's weight is the factor of its
cell; its probability is that factor over the largest one, so the expected
tokens of the sample have exactly the raked shares.  The draw is a hash of the
id.

DataFrame operations only.  Cells and marginals are grouped sums with map-side
combining; only the cell table is iterated on, written once a sweep.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import drop_path, fresh, staged_at

SWEEPS = 8
TEMPERATURE = 0.95
WORD = r"[^\x20\x09-\x0D]+"


def tokens_of(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def key_of(value: Column) -> Column:
    """A value as a join key in which null is a value of its own."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit("null"))


def draw_of(id_: Column) -> Column:
    """A number in [0, 1) from the id; null ids share one draw."""
    return F.conv(F.substring(F.md5(F.coalesce(id_.cast("string"), F.lit(""))), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def smoothed_targets(cells: DataFrame, dims: list[str], temperature: float = TEMPERATURE) -> dict[str, DataFrame]:
    """(value, share) of each dimension: shares of the tokens to the power ``temperature``, scaled to 1."""
    out = {}
    for d in dims:
        m = cells.groupBy(F.col(d).alias("value")).agg(F.sum("tokens").alias("t")).where("t > 0").select(
            "value", F.pow(F.col("t").cast("double"), F.lit(temperature)).alias("s"))
        out[d] = m.crossJoin(F.broadcast(m.agg(F.sum("s").alias("all")))).select("value", (F.col("s") / F.col("all")).alias("share"))
    return out


def rake(cells: DataFrame, dims: list[str], targets: dict[str, DataFrame], sweeps: int = SWEEPS) -> DataFrame:
    """``cells`` (dims, tokens) with ``factor``: after ``sweeps`` rounds, sums of tokens x factor have the target shares.

    Values without a target, or without tokens, keep their factor; the last
    dimension fits exactly, the others to the convergence reached.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    spark = cells.sparkSession
    goal, paths = {}, []
    for d in dims:
        goal[d], p = staged_at(targets[d], "target")
        paths.append(p)
    cur, path = staged_at(cells.withColumn("factor", F.lit(1.0)), "cells")
    for _ in range(sweeps):
        nxt = cur
        for d in dims:
            now = nxt.groupBy(F.col(d).alias("value")).agg(F.sum(F.col("tokens") * F.col("factor")).alias("now"))
            scale = goal[d].join(now, "value").where("now > 0").select(
                F.col("value").alias(d), (F.col("share") * F.lit(float(total)) / F.col("now")).alias("scale"))
            nxt = nxt.join(scale, d, "left").withColumn("factor", F.col("factor") * F.coalesce("scale", F.lit(1.0))).drop("scale")
        new, new_path = staged_at(nxt.select(*dims, "tokens", "factor"), "cells")
        drop_path(spark, path)
        cur, path = new, new_path
    for p in paths:
        drop_path(spark, p)
    return cur


def marginal_gaps(fitted: DataFrame, dims: list[str], targets: dict[str, DataFrame]) -> DataFrame:
    """(dimension, value, target, share, gap) of raked cells: what the sweeps have left between shares and targets.

    Values without a target or without weight have no row."""
    out = None
    for d in dims:
        got = fitted.groupBy(F.col(d).alias("value")).agg(F.sum(F.col("tokens") * F.col("factor")).alias("weight")).where("weight > 0")
        total = got.agg(F.sum("weight")).first()[0] or 1.0
        part = got.join(targets[d], "value").select(F.lit(d).alias("dimension"), "value", F.col("share").alias("target"),
                                                    (F.col("weight") / F.lit(total)).alias("share"))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("gap", F.col("share") - F.col("target"))


def mixed(docs: DataFrame, dims: dict[str, Column], targets: dict[str, DataFrame] | None = None, id_col: str = "doc_id",
          text_col: str = "text", sweeps: int = SWEEPS, temperature: float = TEMPERATURE) -> DataFrame:
    """``docs`` with a struct ``mix`` (renamed if taken): n_tokens, weight, keep_prob, sampled.

    ``dims`` names expressions over ``docs``; null values are a value of their
    own.  ``targets`` gives (value, share) per dimension, with ``key_of`` values;
    by default the smoothed shares of the corpus.  Rows with the same id share a
    draw, as do all null ids.  Null and empty texts have no tokens: they carry
    no weight in the fit and are drawn like their cell.  An empty table stays empty.
    """
    names = list(dims)
    keys = fresh(docs.columns, *[f"__{n}" for n in names])
    result, n_tok = fresh([*docs.columns, *keys], "mix", "__tokens")
    keyed = docs.withColumns({k: key_of(dims[n]) for k, n in zip(keys, names)} | {n_tok: tokens_of(F.col(f"`{text_col}`"))})
    cells, path = staged_at(keyed.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)]).agg(F.sum(n_tok).alias("tokens")), "cells")
    fitted = rake(cells, names, targets or smoothed_targets(cells, names, temperature), sweeps)
    top = fitted.where("tokens > 0").agg(F.max("factor")).first()[0] or 1.0
    drop_path(docs.sparkSession, path)
    other = fresh([*docs.columns, *keys, n_tok, result], *[f"__c{i}" for i in range(len(names))], "__factor")
    fitted = fitted.select(*names, "factor").toDF(*other)
    on = [F.col(k) == F.col(o) for k, o in zip(keys, other)]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    factor = F.col(other[-1])
    prob = F.round(F.least(factor / F.lit(top), F.lit(1.0)), 9)
    return keyed.join(fitted, cond).select(*[F.col(f"`{c}`") for c in docs.columns], F.struct(
        F.col(n_tok).alias("n_tokens"), F.round(factor, 6).alias("weight"), prob.alias("keep_prob"),
        (draw_of(F.col(f"`{id_col}`")) < prob).alias("sampled")).alias(result))


def sampled(docs: DataFrame, dims: dict[str, Column], **options) -> DataFrame:
    """The rows of ``docs`` that the draw takes."""
    out = mixed(docs, dims, **options)
    return out.where(F.col(out.columns[-1])["sampled"]).drop(out.columns[-1])

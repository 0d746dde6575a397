"""Quality classifier: document evidence joined with what is known of its site.

A logistic classifier over dense text measures, fitted on all labelled
documents, gives each document a log-odds.  Documents are grouped by
site and by path within the site; a group's posterior is its mean evidence
shrunk toward the level above (path to site, site to global) by empirical
Bayes: the weight of a group of n documents is n / (n + kappa), kappa the ratio
of the spread of documents to the spread of groups, both estimated from grouped
sums.  A document's own evidence is left out of its group.  The posterior
log-odds is the document's plus what its path adds to the global log-odds.

Evidence is summed as integers (millionths), so sums are exact.  Group sums
have map-side combining, so a site with a third of all rows is one row per
task.  The group table is joined back by hash; Spark broadcasts it only below
its size limit.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.llm.common import fresh, labelled, map_arrow, map_text, staged, text_buffer
from rivulet.llm.quality_llr import SYMBOL, rule_counts
from rivulet.llm.text import per_row

#: Numbers that ``measures`` gives for each text.
MEASURES = 9
MICRO = 1_000_000
RIDGE = 1e-3
KAPPA_MAX = 1e6


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[np.frombuffer(chars, np.uint8)] = True
    return t


UPPER, LOWERCASE = _table(bytes(range(65, 91))), _table(bytes(range(97, 123)))
DIGIT, BANG, STOP = _table(b"0123456789"), _table(b"!"), _table(b".,;:?")


def measures(text: pa.Array) -> np.ndarray:
    """(rows, MEASURES) shares and means of each text; all 0 for an empty one."""
    data, off = text_buffer(text)
    c = rule_counts(data, off)
    size = np.maximum(np.diff(off), 1)
    n = np.maximum(c["n_words"], 1)
    up, low = per_row(UPPER[data], off), per_row(LOWERCASE[data], off)
    return np.stack([
        up / np.maximum(up + low, 1),
        per_row(DIGIT[data], off) / size,
        c["n_symbols"] / n,
        per_row(BANG[data], off) / n,
        per_row(STOP[data], off) / n,
        c["word_chars"] / n / 10,
        c["n_repeat_words"] / n,
        c["n_dup_lines"] / np.maximum(per_row(data == 10, off) + 1, 1),
        np.log1p(c["n_words"]) / 10,
    ], axis=1)


def summed(rows: DataFrame, fn: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """What ``fn`` makes of the measures and labels of a batch, summed over all rows (x, good); a task sends one row."""
    def run(batches):
        total = None
        for b in batches:
            if b.num_rows:
                s = fn(b.column(0).flatten().to_numpy().reshape(-1, MEASURES), b.column(1).to_numpy(zero_copy_only=False))
                total = s if total is None else total + s
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["s"])

    got = map_arrow(rows, run, "s array<double>").collect()
    return np.array([math.fsum(c) for c in zip(*(r["s"] for r in got), strict=True)])


def fit_logistic(rows: DataFrame, steps: int = 25) -> tuple[np.ndarray, float]:
    """Weights and intercept by Newton steps with a ridge; without both kinds, the evidence is 0.

    ``rows`` (x, good) is read once for each step: gradient and curvature are sums over the rows.
    """
    total = summed(rows, lambda x, good: np.concatenate(([len(x), good.sum()], x.sum(axis=0))))
    if not len(total) or total[1] in (0, total[0]):
        return np.zeros(MEASURES), 0.0
    n, mean = total[0], total[2:] / total[0]
    sd = np.sqrt(summed(rows, lambda x, good: ((x - mean) ** 2).sum(axis=0)) / n)
    sd[sd < 1e-9] = 1.0
    m = MEASURES + 1
    w = np.zeros(m)
    ridge = np.full(m, RIDGE * n)
    ridge[-1] = 0
    for _ in range(steps):
        def slopes(x, good, w=w):
            z = np.hstack([(x - mean) / sd, np.ones((len(x), 1))])
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            return np.concatenate((z.T @ (good - p), ((z * (p * (1 - p))[:, None]).T @ z).ravel()))

        s = summed(rows, slopes)
        step = np.linalg.solve(s[m:].reshape(m, m) + np.diag(ridge + 1e-9), s[:m] - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1] / sd, float(w[-1] - (w[:-1] / sd) @ mean)


def classifier(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_id: str, label: str) -> tuple[np.ndarray, float]:
    """Logistic weights from all labelled documents: measures (9 numbers a document), not texts, meet the labels by hash."""
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where("id IS NOT NULL")
    made = map_text(src, "text", ["id"], [T.StructField("x", T.ArrayType(T.DoubleType()))], lambda t: [pa.array(list(measures(t)))])
    rows = made.join(labelled(labels, label_id, label).hint("shuffle_hash"), "id").dropDuplicates(["id"])
    return fit_logistic(staged(rows.select("x", (F.col("label") == 1).alias("good")), "measures"))


def evidence(docs: DataFrame, text_col: str, keep: list[str], model: tuple[np.ndarray, float], name: str) -> DataFrame:
    """``keep`` and the probability in millionths that the classifier alone gives each text."""
    w, b = model

    def fn(text):
        p = 1 / (1 + np.exp(-np.clip(measures(text) @ w + b, -13, 13)))
        return [pa.array(np.clip(np.rint(p * MICRO), 1, MICRO - 1).astype(np.int64))]

    return map_text(docs, text_col, keep, [T.StructField(name, T.LongType())], fn)


def _kappa(n: float, groups: float, within: float, between: float) -> float:
    """Spread of documents over spread of groups, the part of the latter that chance explains taken off."""
    if n <= groups:
        return KAPPA_MAX
    s2 = within / (n - groups)
    tau2 = (between - groups * s2) / n
    return min(KAPPA_MAX, s2 / tau2) if tau2 > 0 else KAPPA_MAX


def group_posteriors(ev: DataFrame, site: str, path: str) -> tuple[DataFrame, dict]:
    """(site, path, sums of both) per path, and the global mean and both kappas."""
    by_path = staged(ev.groupBy(F.col(site).alias("site"), F.col(path).alias("path")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("p").alias("s"), F.sum((F.col("p") * F.col("p")).cast("decimal(13,0)")).cast("double").alias("q")), "paths")
    by_site = by_path.groupBy("site").agg(F.sum("n").alias("site_n"), F.sum("s").alias("site_s"))
    both = staged(by_path.join(by_site.withColumnRenamed("site", "site_"), F.col("site").eqNullSafe(F.col("site_"))).drop("site_"), "groups")
    m = float(MICRO)
    t = both.agg(F.sum("n"), F.sum("s"), F.sum("q"), F.count(F.lit(1)), F.sum(F.pow("s", F.lit(2)) / F.col("n")),
                 F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col("site_s") / F.col("site_n"), 2))).first()
    if not t[0]:
        return both, {"mean": 0.5, "site": KAPPA_MAX, "path": KAPPA_MAX}
    mu = t[1] / t[0]
    u = both.select("site", "site_n", "site_s").distinct().agg(
        F.count(F.lit(1)), F.sum(F.pow("site_s", F.lit(2)) / F.col("site_n")),
        F.sum(F.col("site_n") * F.pow(F.col("site_s") / F.col("site_n") - F.lit(mu), 2))).first()
    return both, {"mean": mu / m,
                  "site": _kappa(t[0], u[0], (t[2] - u[1]) / m / m, u[2] / m / m),
                  "path": _kappa(t[0], t[3], (t[2] - t[4]) / m / m, t[5] / m / m)}


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def site_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 site: str = "source", path: str = "lang", label_id: str = "doc_id", label: str = "quality",
                 columns: list[str] | None = None, threshold: float = 0.5,
                 places: DataFrame | None = None) -> DataFrame:
    """``columns`` of ``docs`` (default all) and a struct ``quality_result`` (renamed if taken) with
    doc_prob, site_prob, path_prob, prob, kept.

    ``places`` (id, site, path) names the site and path of documents, host and
    path of their page, say; ids it lacks, or has a null site for, take the columns ``site`` and
    ``path``.  Of several rows of an id the smallest counts.  The join with it
    moves ``columns``, so leave the text out of them.  Without ``places`` nothing is joined by id.
    The texts are read twice: for the measures of those with a label, and for the evidence,
    which is written once and then read.  site_prob and path_prob are the shrunk means without the document itself;
    kept: prob >= threshold.  Null and empty texts get the evidence of a text
    without words.  Null sites and paths are groups of their own.  Null ids are
    judged but never labelled, repeated rows judged each.  Without labels of
    both kinds every document has even odds and is kept.
    """
    columns = columns or docs.columns
    model = classifier(docs, labels, id_col, text_col, label_id, label)
    p, result = fresh(docs.columns, "p", "quality_result")
    own_site, own_path = fresh([*docs.columns, p, result], "own_site", "own_path")
    keep = list(dict.fromkeys([*columns, id_col, site, path]))
    named = evidence(docs, text_col, keep, model, p)
    if places is not None:
        key, = fresh([*docs.columns, p, result, own_site, own_path], "place_id")
        where = places.toDF(key, "site", "path").where(F.col("site").isNotNull()).groupBy(key).agg(
            F.min(F.struct(F.col("site").cast("string").alias("site"), F.col("path").cast("string").alias("path"))).alias(own_path))
        named = named.join(where, F.col(f"`{id_col}`") == F.col(key), "left").drop(key)
        known = F.col(own_path).isNotNull()  # a page's host is never the same site as a source of that name
        named = named.withColumn(own_site, F.when(known, F.concat(F.lit("host "), F.col(own_path)["site"])).otherwise(F.concat(F.lit("source "), F.col(f"`{site}`").cast("string"))))
        named = named.withColumn(own_path, F.when(known, F.col(own_path)["path"]).otherwise(F.col(f"`{path}`").cast("string")))
    else:
        named = named.withColumn(own_site, F.col(f"`{site}`")).withColumn(own_path, F.col(f"`{path}`"))
    named = staged(named, "evidence")
    groups, prior = group_posteriors(named.select(F.col(own_site).alias("site"), F.col(own_path).alias("path"), F.col(p).alias("p")), "site", "path")
    g = groups.select(F.struct("*").alias("g"), F.col("site").alias("g_site"), F.col("path").alias("g_path"))
    g = g.toDF(*fresh(named.columns, "g", "g_site", "g_path"))
    gs, gp = g.columns[1:]
    named = named.join(g, F.col(own_site).eqNullSafe(g[gs]) & F.col(own_path).eqNullSafe(g[gp]))
    own, st = F.col(p), F.col(g.columns[0])
    mu = F.lit(prior["mean"])
    site_prob = ((st["site_s"] - own) / MICRO + prior["site"] * mu) / (st["site_n"] - 1 + prior["site"])
    path_prob = ((st["s"] - own) / MICRO + prior["path"] * site_prob) / (st["n"] - 1 + prior["path"])
    prob = 1 / (1 + F.exp(-(_logit(own / MICRO) + _logit(path_prob) - F.lit(_number_logit(prior["mean"])))))
    return named.select(*[F.col(f"`{c}`") for c in columns], F.struct(
        (own / MICRO).alias("doc_prob"), site_prob.alias("site_prob"), path_prob.alias("path_prob"), prob.alias("prob"),
        (prob >= threshold).alias("kept")).alias(result))


def _number_logit(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return math.log(p / (1 - p))


def good_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps."""
    judged = site_quality(docs, labels, **options)
    return judged.where(F.col(judged.columns[-1])["kept"]).drop(judged.columns[-1])

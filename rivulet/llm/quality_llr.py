"""Quality rules: base counts of a text and a length-normalised log-likelihood ratio.

Two multinomials over hashed byte n-grams (n = 1, 2, 3): one of the trusted
documents (all with label 1), one of all documents.  A document's score is the
mean log ratio target / raw over its n-grams.  Log ratios are held as integers,
so a score does not depend on how rows are dealt to tasks.  The threshold is
the one that parts all labelled documents best; every document is judged by it.

All passes read whole texts in slices of bounded bytes.  Only counts leave a
task that counts n-grams, summed by bucket with map-side combining.  Labels are
joined by hash and never broadcast: the join that finds the trusted texts moves
texts once.  Labelled scores stay where they lie: the threshold comes from
running sums over score ranges, of which the driver gets one row each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.llm.common import labelled, longs, map_arrow, map_text, staged, text_buffer, text_slices
from rivulet.llm.text import BASE, SPACE, U, mix, per_row, prefix_hash, span_hash, windows, words

GRAMS = (1, 2, 3)
BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
#: Log ratios are held in units of 1 / SCALE.
SCALE = 1 << 16
SMOOTHING = 0.5

SYMBOL = np.zeros(256, bool)
SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def rule_counts(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts of each row (see ``quality_rules``)."""
    n = len(off) - 1
    prefix = prefix_hash(data)
    w = words(data, off, prefix)
    ink = ~SPACE[data]
    out = {"n_words": np.diff(w.first), "word_chars": per_row(ink & ((data & 0xC0) != 0x80), off),
           "n_symbols": per_row(SYMBOL[data], off)}

    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate((off[:-1], breaks + 1)))
    ends = np.sort(np.concatenate((breaks, off[1:])))
    # a break ends a line of its row and begins the next, so sorted starts and ends pair up row by row
    run = np.zeros(len(data) + 1, np.int64)
    np.cumsum(ink, out=run[1:])
    row = np.repeat(np.arange(n), np.diff(np.searchsorted(breaks, off)) + 1)
    inked = run[ends] > run[starts]
    row, h = row[inked], span_hash(prefix, starts[inked], ends[inked])
    h = mix(h + row.astype(np.uint64) * U(BASE))
    once = np.unique(h, return_index=True)[1]
    out["n_dup_lines"] = np.bincount(row, minlength=n) - np.bincount(row[once], minlength=n)

    at, h = windows(w, 3)
    covered = np.zeros(len(w.hash) + 2, bool)
    if len(at):
        h = mix(h + w.doc[at].astype(np.uint64) * U(BASE))
        order = np.argsort(h, kind="stable")
        s = h[order]
        same = s[1:] == s[:-1]
        again = np.concatenate((same, [False])) | np.concatenate(([False], same))
        hit = at[order[again]]
        for j in range(3):
            covered[hit + j] = True
    out["n_repeat_words"] = np.bincount(w.doc[covered[:len(w.doc)]], minlength=n)
    return out


def gram_buckets(data: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, whether the n-gram lies inside one row) of the n-gram at each position."""
    code = np.full(len(data), n, np.uint32)
    inside = np.ones(len(data), bool)
    for j in range(n):
        code <<= np.uint32(8)
        code[:len(data) - j] |= data[j:]
        if j:
            edge = off[1:] - j
            inside[edge[edge >= 0]] = False
    return (code * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS), inside


def gram_counts(text: pa.Array) -> np.ndarray:
    data, off = text_buffer(text)
    out = np.zeros(BUCKETS, np.int64)
    for n in GRAMS:
        b, inside = gram_buckets(data, off, n)
        out += np.bincount(b[inside], minlength=BUCKETS)
    return out


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Integer log ratios of the smoothed multinomials; all 0 without a target."""
    if not target.sum():
        return np.zeros(BUCKETS, np.int64)
    p = (target + SMOOTHING) / (target.sum() + SMOOTHING * BUCKETS)
    q = (raw + SMOOTHING) / (raw.sum() + SMOOTHING * BUCKETS)
    return np.rint(np.log(p / q) * SCALE).astype(np.int64)


def gram_scores(text: pa.Array, ratios: np.ndarray) -> np.ndarray:
    """Mean log ratio of each row; 0 for a row without n-grams."""
    data, off = text_buffer(text)
    total, grams = np.zeros(len(off) - 1, np.int64), np.zeros(len(off) - 1, np.int64)
    size = np.diff(off)
    for n in GRAMS:
        b, inside = gram_buckets(data, off, n)
        run = np.zeros(len(data) + 1, np.int64)
        np.cumsum(np.where(inside, ratios[b], 0), out=run[1:])
        total += run[off[1:]] - run[off[:-1]]
        grams += np.maximum(size - n + 1, 0)
    return total / np.maximum(grams, 1) / SCALE


def corpus_counts(texts: DataFrame, name: str) -> np.ndarray:
    """Counts (column ``name``) by bucket of the n-grams of all rows of the one column of ``texts``."""
    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for part in text_slices(b, 0):
                total += gram_counts(part.column(0))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([longs(at), longs(total[at])], names=["bucket", name])

    rows = map_arrow(texts, run, f"bucket long, {name} long").groupBy("bucket").agg(F.sum(name).alias(name)).toPandas()  # BUCKETS rows at most
    out = np.zeros(BUCKETS, np.int64)
    out[rows["bucket"]] = rows[name]
    return out


def corpus_ratios(docs: DataFrame, known: DataFrame, id_col: str, text_col: str) -> np.ndarray:
    """Log ratios from all texts of ``docs`` against those of the ids with label 1 in ``known``."""
    good = known.where("label = 1").select("id")
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    trusted = src.where("id IS NOT NULL AND text <> ''").join(good.hint("shuffle_hash"), "id", "left_semi")
    return log_ratios(corpus_counts(src.select("text"), "raw"), corpus_counts(trusted.select("text"), "target"))


def best_threshold(scores: np.ndarray, good: np.ndarray) -> float:
    """The score that parts good from bad with the largest sum of both hit rates; ties go to the
    lowest, and without one of the two kinds every document passes."""
    if not good.any() or good.all():
        return float("-inf")
    s = np.unique(scores)
    kept_good = 1 - np.searchsorted(np.sort(scores[good]), s, "left") / good.sum()
    cut_bad = np.searchsorted(np.sort(scores[~good]), s, "left") / (~good).sum()
    i = int(np.argmax(kept_good + cut_bad))
    return float((s[i] + s[i - 1]) / 2) if i else float("-inf")


def table_threshold(known: DataFrame) -> float:
    """``best_threshold`` of the rows (score, good) of a table of any size.

    Scores are dealt to tasks by range.  Which score of a range is best does not depend on the
    ranges below it, so each gives its best one, and their totals then tell which range has the best of
    all.  Sums of hit rates are compared as integers, exact in 64 bits up to 3 billion rows.
    """
    counts = known.groupBy("score").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    ranged = staged(counts.repartitionByRange("score").withColumn("part", F.spark_partition_id()), "scores")
    parts = sorted(ranged.groupBy("part").agg(F.max("score").alias("high"), F.sum("good").alias("good"), F.sum("bad").alias("bad")).collect(),
                   key=lambda r: r["high"])
    n_good, n_bad = sum(r["good"] for r in parts), sum(r["bad"] for r in parts)
    if not n_good or not n_bad:
        return float("-inf")
    w = Window.partitionBy("part").orderBy("score")
    below = w.rowsBetween(Window.unboundedPreceding, -1)
    gain = (F.coalesce(F.sum("bad").over(below), F.lit(0)) * F.lit(n_good).cast("long")
            - F.coalesce(F.sum("good").over(below), F.lit(0)) * F.lit(n_bad).cast("long"))
    best = {r["part"]: r["best"] for r in ranged.select("part", F.struct(
        gain.alias("gain"), (-F.col("score")).alias("low"), F.lag("score").over(w).alias("before")).alias("best"))
        .groupBy("part").agg(F.max("best").alias("best")).collect()}
    top, cut, base, high = -1, float("-inf"), 0, None
    for r in parts:
        b = best[r["part"]]
        if base + b["gain"] > top:
            before = high if b["before"] is None else b["before"]
            top, cut = base + b["gain"], float("-inf") if before is None else (before - b["low"]) / 2
        base += r["bad"] * n_good - r["good"] * n_bad
        high = r["high"]
    return cut


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  label_id: str = "doc_id", label: str = "quality") -> DataFrame:
    """One row per row of ``docs``: id, the base counts, base_failed, score, kept.

    n_words: words ``[^\\x20\\x09-\\x0D]+``; word_chars: code points in them;
    n_symbols: characters of ``[#*$%&|<>]``; n_dup_lines: lines with a word,
    equal to an earlier line; n_repeat_words: words in 3-word windows that occur
    twice or more.  base_failed: n_words < 50, or more than half of the words
    repeat.  kept: not base_failed and score >= the threshold.

    Null and empty texts have all counts 0 and fail.  Null ids are judged like
    others, but are never labelled.  Repeated rows are judged each.  Without
    labels of both kinds no score rejects.  Every labelled document counts for
    the target and the threshold.  Other columns are not read.
    """
    known = staged(labelled(labels, label_id, label), "labels")
    ratios = corpus_ratios(docs, known, id_col, text_col)

    def fn(text):
        c = rule_counts(*text_buffer(text))
        return [*(longs(c[x]) for x in COUNTS), pa.array(gram_scores(text, ratios))]

    L = T.LongType()
    judged = staged(map_text(docs, text_col, [id_col], [*(T.StructField(x, L) for x in COUNTS), T.StructField("score", T.DoubleType())], fn)
                    .withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")), "judged")
    scored = (judged.where(~F.col("base_failed")).join(known.hint("shuffle_hash"), judged[id_col] == known["id"])
              .groupBy("id").agg((F.max("label") == 1).alias("good"), F.min("score").alias("score")))
    cut = table_threshold(scored)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(cut)))

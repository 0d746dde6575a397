"""How far the sources of a language differ in their terms.

Counting: a task lower-cases the Arrow text buffer of a slice of documents,
notes the start of every term and sorts these pointers by the bytes they point
at with a multikey quicksort that takes eight bytes as one character: all open
slices of a depth are sorted by their next character at once, runs of equal
characters stay open as slices of the next depth.  What ends as a run of equal
pointers is one term; the documents in the run give its document frequency and,
by (language, source), its counts.  Only these sums leave the task.

Divergence: with p = 1 + floor(10**9 (count + 1) / (N + V)) a source is compared
with its language term by term and with every other source of the language as a
whole, by f = floor((p - q)**2 / q).  Terms that neither source has all give the
same f, terms that only one has depend on that source's p alone; so a pair is

    V f00 + (terms of a: f(p, q0) - f00) + (terms of b: f(p0, q) - f00)
          + (common terms: f(p, q) - f(p, q0) - f(p0, q) + f00)

The first three come from histograms of p.  The last is summed by tasks that
hold a hash slice of the terms for two blocks of sources: they add the pairs of
a term's sources into a table of the two blocks and return one number a pair.
All arithmetic is exact; sums stay below 2**63 while V is below 2 * 10**9.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.llm.common import binaries, drop_path, fresh, longs, map_arrow, staged, staged_at, text_buffer, text_slices
from rivulet.llm.terms import LETTERS, spans, term_runs
from rivulet.llm.text import LOWER

#: Text bytes whose pointers a task sorts at once.
SLICE = 4 << 20
#: Sources of one block, and (term, source) counts aimed at in one hash slice of terms.
BLOCK = 512
SLICE_ROWS = 100_000
#: Pairs of sources that a task lays out at once.
PAIRS = 1 << 20
TOP = 200


def _character(padded: np.ndarray, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Eight bytes from each position as one number in byte order, 0 beyond the term's end."""
    eight = np.ndarray((len(padded) - 7,), ">u8", padded, strides=(1,))
    left = np.clip(ends - at, 0, 8).astype(np.uint64)
    raw = eight[np.minimum(at, len(eight) - 1)].astype(np.uint64)
    cut = np.uint64(64) - np.uint64(8) * left
    return np.where(left > 0, raw >> np.minimum(cut, np.uint64(63)) << np.minimum(cut, np.uint64(63)), np.uint64(0))


def sorted_pointers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, run): the terms' numbers in the order of their bytes, and for each place the number of its run of equal terms."""
    n = len(starts)
    order = np.arange(n)
    border = np.zeros(n, bool)  # a place that starts a slice
    border[:1] = True
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    place, depth = np.arange(n), 0
    while len(place):
        slice_ = np.cumsum(border[place]) if depth else np.zeros(n, np.int64)
        mine = order[place]
        key = _character(padded, starts[mine] + depth, ends[mine])
        by = np.lexsort((key, slice_)) if depth else np.argsort(key)
        mine, key = mine[by], key[by]
        order[place] = mine
        new = np.ones(len(place), bool)
        new[1:] = (key[1:] != key[:-1]) | (slice_[1:] != slice_[:-1])
        border[place] |= new
        # slices of equal full characters are open, unless they are a single term
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(place)))
        place = place[np.repeat(size > 1, size) & ((key & np.uint64(0xFF)) != 0)]
        depth += 8
    return order, np.cumsum(border) - 1


def _slice_counts(text: pa.Array, group: np.ndarray) -> tuple[np.ndarray, bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Term sums of some rows: (offsets, bytes) of the terms, and of each (term, group): term, group, n, docs."""
    data, off = text_buffer(text)
    data = LOWER[data]
    starts, ends, first = term_runs(data, off, LETTERS)
    order, run = sorted_pointers(data, starts, ends)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    pair, n = np.unique(run * max(len(group), 1) + doc[order], return_counts=True)
    term, doc = pair // max(len(group), 1), pair % max(len(group), 1)
    width = int(group.max()) + 1 if len(group) else 1
    key = term * width + group[doc]
    by = np.argsort(key, kind="stable")
    head = np.flatnonzero(np.concatenate(([True], key[by][1:] != key[by][:-1]))) if len(key) else np.zeros(0, np.int64)
    total = np.add.reduceat(n[by], head) if len(head) else n
    docs = np.diff(np.append(head, len(key)))
    one = order[np.flatnonzero(np.diff(run, prepend=-1))]  # a pointer of each term
    size = ends[one] - starts[one]
    body = data[spans(starts[one], size)].tobytes()
    return np.concatenate(([0], np.cumsum(size))), body, key[by][head] // width, key[by][head] % width, np.stack((total, docs))


def _long_text(text: str, limit: int):
    """Pieces of a very long text, cut where no term is."""
    at = 0
    while at < len(text):
        to = min(len(text), at + limit)
        while to < len(text) and (text[to].isascii() and text[to].isalpha() or ord(text[to]) > 127):
            to += 1
        yield text[at:to]
        at = to


def term_counts(docs: DataFrame, limit: int = SLICE) -> DataFrame:
    """(lang, source, term, n, docs) sums of each slice of ``docs`` (text, lang, source, none null)."""
    names = ["lang", "source", "term", "n", "docs"]

    def rows(part):
        lang, source = (part.column(i).dictionary_encode() for i in (1, 2))
        width = max(len(source.dictionary), 1)
        group = lang.indices.to_numpy().astype(np.int64) * width + source.indices.to_numpy()
        if part.num_rows == 1 and len(part.column(0)[0].as_buffer()) > 2 * limit:
            total = Counter()
            for piece in _long_text(part.column(0)[0].as_py(), limit):
                off, body, _, _, sums = _slice_counts(pa.array([piece]), group)
                total.update(dict(zip((body[a:b] for a, b in zip(off[:-1], off[1:])), sums[0].tolist())))
            terms = pa.array(list(total), pa.binary()).cast(pa.string())
            g, sums = np.zeros(len(total), np.int64), np.array([list(total.values()), [1] * len(total)], np.int64).reshape(2, -1)
            g += group[0]
        else:
            off, body, term, g, sums = _slice_counts(part.column(0), group)
            terms = binaries(body, off).cast(pa.string()).take(pa.array(term))
        yield pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(g // width)), source.dictionary.take(pa.array(g % width)),
                                          terms, longs(sums[0]), longs(sums[1])], names=names)

    def run(batches):
        held, size = [], 0
        for b in batches:
            for part in text_slices(b, 0, limit):
                bytes_ = pc.sum(pc.binary_length(part.column(0))).as_py() or 0
                if held and size + bytes_ > limit:
                    yield from rows(_joined(held))
                    held, size = [], 0
                held.append(part)
                size += bytes_
        if held:
            yield from rows(_joined(held))

    return map_arrow(docs.select("text", "lang", "source"), run, "lang string, source string, term string, n long, docs long")


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.concat_batches(parts)


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10**9 (count + 1) / (total + terms)), exact; null without terms."""
    big = F.lit(1_000_000_000).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)")
    return F.when(terms > 0, 1 + F.call_function("div", big, (total + terms).cast("decimal(20,0)")).cast("long"))


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def _common(entries: DataFrame, block: int) -> DataFrame:
    """(lang, a, b, common): the sum over common terms of ordered pairs of sources, from rows
    (lang, i, j, slice, term, no, p, p0) where i <= j are the blocks that meet."""
    def f(p, q):
        return (p - q) ** 2 // q

    def sums(t):
        i, j = t.column(1)[0].as_py(), t.column(2)[0].as_py()
        term = t.column(4).combine_chunks() if isinstance(t.column(4), pa.ChunkedArray) else t.column(4)
        no, p, p0 = (t.column(c).to_numpy() for c in (5, 6, 7))
        new = np.ones(t.num_rows, bool)
        new[1:] = pc.not_equal(term.slice(1), term.slice(0, t.num_rows - 1)).to_numpy(zero_copy_only=False)
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, t.num_rows))
        mine = np.repeat(size, size)  # partners of each row: all rows of its term
        table = np.zeros((2 * block, 2 * block), np.int64)  # blocks i and j beside each other
        col = np.where(no // block == i, no - i * block, block + no - j * block)
        start = np.repeat(head, size)
        ends = np.cumsum(mine)
        at = 0
        while at < t.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
            a = np.repeat(np.arange(at, to), mine[at:to])
            b = spans(start[at:to], mine[at:to])
            ok = (a != b) if i == j else (no[a] // block != no[b] // block)
            a, b = a[ok], b[ok]
            np.add.at(table.reshape(-1), col[a] * (2 * block) + col[b],
                      f(p[a], p[b]) - f(p[a], p0[b]) - f(p0[a], p[b]) + f(p0[a], p0[b]))
            at = to
        a, b = np.nonzero(table)
        back = np.concatenate((np.arange(block) + i * block, np.arange(block) + j * block))
        yield pa.RecordBatch.from_arrays([pa.array([t.column(0)[0].as_py()] * len(a), pa.string()), longs(back[a]), longs(back[b]),
                                          longs(table[a, b])], names=["lang", "a", "b", "common"])

    def run(batches):
        held, key = [], None
        for whole in batches:
            for b in _by_group(whole):
                now = tuple(b.column(c)[0].as_py() for c in range(4))
                if held and now != key:
                    yield from sums(_joined(held))
                    held = []
                held.append(b)
                key = now
        if held:
            yield from sums(_joined(held))

    rows = entries.select("lang", "i", "j", "slice", "term", "no", "p", "p0")
    rows = rows.repartition("lang", "i", "j", "slice").sortWithinPartitions("lang", "i", "j", "slice", "term")
    return map_arrow(rows, run, "lang string, a long, b long, common long").groupBy("lang", "a", "b").agg(F.sum("common").alias("common"))


def _by_group(b: pa.RecordBatch):
    """The runs of rows with the same first four columns."""
    if not b.num_rows:
        return
    new = np.zeros(b.num_rows, bool)
    for c in range(4):
        x = b.column(c)
        new[1:] |= pc.not_equal(x.slice(1), x.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)
    cut = np.append(np.flatnonzero(new), b.num_rows)
    at = 0
    for to in cut:
        yield b.slice(at, to - at)
        at = int(to)


def audit(docs: DataFrame, min_docs: int = 3, top: int = TOP, text_col: str = "text", lang_col: str = "lang",
          source_col: str = "source", block: int = BLOCK, limit: int = SLICE, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(lang, source, part, item, value, rank) of every (lang, source) that occurs.

    Part ``pair``: item is each other source of the language, value the summed
    divergence of this source's shares from that one's, 0 if the language keeps
    no term; all ranks.  Part ``term``: item is each kept term that the source
    uses and uses more than the language does, value its divergence from the
    language's share, the ``top`` first.  Ranks count from 1, by value
    descending, then by the item's bytes.  A language keeps the terms in at
    least ``min_docs`` of its documents.  Null text, lang and source are read as
    ''; empty texts have no terms; every row is a document, repeated ones too;
    an empty table gives no rows; other columns are not read.
    """
    src = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n)
                        for c, n in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))])
    counts, path = staged_at(term_counts(src, limit).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all_n")).where(
        F.col("docs") >= min_docs).drop("docs")
    used = staged(counts.drop("docs").join(kept, ["lang", "term"]), "used")
    drop_path(docs.sparkSession, path)

    groups = src.select("lang", "source").distinct()
    size = used.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    by_lang = used.groupBy("lang", "term").agg(F.first("all_n").alias("n")).groupBy("lang").agg(
        F.count(F.lit(1)).alias("terms"), F.sum("n").alias("all_total"))
    zero = F.lit(0).cast("long")
    stats = groups.join(size, ["lang", "source"], "left").join(by_lang, "lang", "left").select(
        "lang", "source", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long").alias("no"),
        *[F.coalesce(c, zero).alias(c) for c in ("total", "terms", "all_total")])
    stats = staged(stats.withColumn("p0", share(zero, F.col("total"), F.col("terms"))), "sources")

    shares = used.join(stats, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))
    q = share(F.col("all_n"), F.col("all_total"), F.col("terms"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    terms = shares.withColumn("q", q).where("p > q").select("lang", "source", F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", rank).where(F.col("rank") <= top)

    # sums over the terms of one source against a share that another source gives all terms it lacks
    alone = shares.groupBy("lang", "no", "p0", "p").agg(F.count(F.lit(1)).alias("k"))
    level = stats.where("terms > 0").select("lang", F.col("p0").alias("z")).distinct()
    p, p0, z = F.col("p"), F.col("p0"), F.col("z")
    alone = staged(alone.join(level, "lang").groupBy("lang", "no", "z").agg(
        F.sum(F.col("k") * (divergence(p, z) - divergence(p0, z))).alias("as_p"),
        F.sum(F.col("k") * (divergence(z, p) - divergence(z, p0))).alias("as_q")), "alone")

    rows = used.count()
    slices = max(1, -(-rows // slice_rows))
    blocks = F.floor((F.max("no").over(Window.partitionBy("lang"))) / block).cast("long") + 1
    dealt = stats.withColumn("blocks", blocks).select("lang", "source", "no", "p0", "total", "terms", F.floor(F.col("no") / block).cast("long").alias("mine"), "blocks")
    pair = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.struct(
        F.least(o, F.col("mine")).alias("i"), F.greatest(o, F.col("mine")).alias("j"))))
    entries = used.join(dealt, ["lang", "source"]).select(
        "lang", pair.alias("x"), F.pmod(F.xxhash64("term"), F.lit(slices)).alias("slice"), "term", "no",
        share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), "p0").select("lang", "x.i", "x.j", "slice", "term", "no", "p", "p0")
    common = _common(entries, block)

    a = stats.select("lang", "source", F.col("no").alias("a"), F.col("p0").alias("pa"), "terms")
    b = stats.select("lang", F.col("source").alias("item"), F.col("no").alias("b"), F.col("p0").alias("pb"))
    pairs = a.join(b, "lang").where("a <> b")
    pairs = (pairs.join(common, ["lang", "a", "b"], "left")
             .join(alone.select("lang", F.col("no").alias("a"), F.col("z").alias("pb"), "as_p"), ["lang", "a", "pb"], "left")
             .join(alone.select("lang", F.col("no").alias("b"), F.col("z").alias("pa"), "as_q"), ["lang", "b", "pa"], "left"))
    value = F.coalesce(F.col("terms") * divergence(F.col("pa"), F.col("pb")), zero) + F.coalesce("common", zero) \
        + F.coalesce("as_p", zero) + F.coalesce("as_q", zero)
    pairs = pairs.select("lang", "source", "item", value.alias("value")).withColumn("rank", rank)

    lang, source = fresh(["part", "item", "value", "rank"], lang_col, source_col)
    out = [x.select(F.col("lang").alias(lang), F.col("source").alias(source), F.lit(n).alias("part"), "item", "value", "rank")
           for n, x in (("pair", pairs), ("term", terms))]
    return out[0].unionByName(out[1])

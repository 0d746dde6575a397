"""Ranked lexical search by two trees: items against documents, exact.

A document's coordinate for a term is (10**9 tf) div (1000 tf + 8 m), an item's
is the term's weight times its repeats; the score is their product summed over
terms, all whole numbers.  Items form a tree whose nodes hold the largest weight
of each term below them; every task builds such a tree over each block of its
documents, those that share their rarest item term side by side.  The product
of two nodes bounds every score below them.  Where it is less than the weakest
k-th score of the node's items, the pair of nodes is skipped, which no result
can notice; a pair of leaves is the score itself.

Stages: one pass over the texts keeps, for each document, its length and its
counts of the items' terms (a written table); two sums over that table give the
corpus figures; a search of a hash sample of about ``seed_rows`` documents gives
each item a score that its k-th can't fall below; then all documents are
searched.  A task returns at most k rows an item.

Memory: items are handled in batches of about ``item_bytes`` text bytes (one
pass over the documents each), so the terms and the tree that every task holds
are bounded whatever the number of items.  Terms are compared by 64-bit hashes.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.llm.common import binaries, drop_path, longs, map_arrow, map_text, staged, staged_at, text_buffer
from rivulet.llm.terms import LETTERS_DIGITS, spans, term_runs
from rivulet.llm.text import LOWER, prefix_hash, span_hash

#: Text bytes of the items that one batch holds.
ITEM_BYTES = 4 << 20
#: Documents of a leaf of a document tree, and children of the other nodes; the same for items.
LEAF, FAN = 16, 8
ITEM_LEAF, ITEM_FAN = 4, 8
#: Documents and term counts of one document tree.
BLOCK_ROWS, BLOCK_TERMS = 8_192, 1 << 20
#: Documents whose scores give the first bounds.
SEED_ROWS = 8_192


def term_hashes(text) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each term, first term of each row with the end) of a text array, A-Z lower-cased."""
    data, off = text_buffer(text)
    data = LOWER[data]
    starts, ends, first = term_runs(data, off, LETTERS_DIGITS)
    return span_hash(prefix_hash(data), starts, ends), first


def grouped(row: np.ndarray, code: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, how often) of the distinct pairs, in order."""
    key, n = np.unique(row * width + code, return_counts=True)
    return key // width, key % width, n


def levels(row: np.ndarray, code: np.ndarray, value: np.ndarray, rows: int, leaf: int, fan: int) -> list[tuple]:
    """A tree over rows 0 .. rows - 1 with entries sorted by row: a list, the rows first and the root last, of
    (first entry of each node with the end, codes, largest values, children of a node)."""
    out = []
    width = int(code.max()) + 1 if len(code) else 1
    size = 1
    while True:
        out.append((np.searchsorted(row, np.arange(rows + 1)), code, value, size))
        if rows <= 1:
            return out
        size = leaf if len(out) == 1 else fan
        rows = -(-rows // size)
        key = (row // size) * width + code
        order = np.argsort(key, kind="stable")
        key = key[order]
        head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        value = np.maximum.reduceat(value[order], head) if len(head) else value
        row, code = key[head] // width, key[head] % width


class ItemTree:
    """Items as rows of (item, code, weight), ordered so that items with the same frequent terms are neighbours."""

    def __init__(self, row: np.ndarray, code: np.ndarray, weight: np.ndarray, rows: int):
        by_weight = np.lexsort((code, weight, row))  # frequent terms have small weights
        first = np.searchsorted(row[by_weight], np.arange(rows))
        last = np.searchsorted(row[by_weight], np.arange(rows), "right") - 1
        keys = [code[by_weight][np.minimum(first + i, last)] for i in (2, 1, 0)]
        self.order = np.lexsort(keys) if rows else np.zeros(0, np.int64)  # place in the tree -> item
        place = np.empty(rows, np.int64)
        place[self.order] = np.arange(rows)
        at = np.lexsort((code, place[row]))
        self.levels = levels(place[row][at], code[at], weight[at], rows, ITEM_LEAF, ITEM_FAN)
        self.below = np.cumprod([x[3] for x in self.levels])  # items below a node of each level

    def bounds(self, level: int, nodes: np.ndarray, dense: np.ndarray) -> np.ndarray:
        ptr, code, value, _ = self.levels[level]
        size = ptr[nodes + 1] - ptr[nodes]
        at = spans(ptr[nodes], size)
        run = np.zeros(len(at) + 1, np.int64)
        np.cumsum(dense[code[at]] * value[at], out=run[1:])
        to = np.cumsum(size)
        return run[to] - run[to - size]

    def alive(self, dense: np.ndarray, live: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The items of ``live`` whose bound against a node's coordinates reaches their least score, and the bounds."""
        for level in range(len(self.levels) - 1, 0, -1):
            if len(live) <= 2 * self.below[level] and level > 1 or not len(live):
                continue  # too few left for nodes of this size to skip many at once
            nodes, head, node = np.unique(live // self.below[level], return_index=True, return_inverse=True)
            weakest = np.minimum.reduceat(least[live], head)
            live = live[(self.bounds(level, nodes, dense) >= weakest)[node]]
        if not len(live):
            return live, np.zeros(0, np.int64)
        score = self.bounds(0, live, dense)
        fit = score >= least[live]
        return live[fit], score[fit]


class Best:
    """The k best (score, id) of each item so far; ``least`` is the score that a further one needs at least."""

    def __init__(self, least: np.ndarray, k: int):
        self.k, self.least, self.heaps = k, np.maximum(least, 1), {}

    def add(self, items: np.ndarray, scores: np.ndarray, doc: int) -> None:
        for i, s in zip(items.tolist(), scores.tolist()):
            heap = self.heaps.setdefault(i, [])
            if len(heap) < self.k:
                heapq.heappush(heap, (s, -doc))
            elif (s, -doc) > heap[0]:
                heapq.heapreplace(heap, (s, -doc))
            if len(heap) == self.k:
                self.least[i] = max(self.least[i], heap[0][0])


def search_block(tree: ItemTree, ids: np.ndarray, row: np.ndarray, code: np.ndarray, value: np.ndarray, weight: np.ndarray,
                 best: Best, dense: np.ndarray) -> int:
    """Search the documents ``ids`` with entries (row, code, value); ``dense`` is all 0 before and after.

    Returns how many document leaves were reached.
    """
    lead = np.lexsort((code, weight[code], row))
    last = np.searchsorted(row[lead], np.arange(len(ids)), "right") - 1
    order = np.argsort(code[lead][last], kind="stable")  # by the rarest term
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    at = np.lexsort((code, place[row]))
    docs = levels(place[row][at], code[at], value[at], len(ids), LEAF, FAN)
    stack = [(len(docs) - 1, 0, np.arange(len(tree.order)))]
    reached = 0
    while stack:
        level, node, live = stack.pop()
        ptr, c, v, fan = docs[level]
        s = slice(ptr[node], ptr[node + 1])
        dense[c[s]] = v[s]
        live, score = tree.alive(dense, live, best.least)
        dense[c[s]] = 0
        if not len(live):
            continue
        if level == 0:
            reached += 1
            best.add(live, score, int(ids[order[node]]))
        else:
            to = len(docs[level - 1][0]) - 1
            stack += [(level - 1, i, live) for i in range(min(to, (node + 1) * fan) - 1, node * fan - 1, -1)]
    return reached


def _counted(docs: DataFrame, vocab: np.ndarray) -> DataFrame:
    """(doc, n, codes, tfs): terms of the text, and the counts of the terms in ``vocab`` (sorted hashes)."""
    known = docs.sparkSession.sparkContext.broadcast(vocab)

    def fn(text):
        terms = known.value
        h, first = term_hashes(text)
        mark = np.zeros(1 << 16, bool)
        mark[(terms >> np.uint64(48)).astype(np.int64)] = True
        maybe = np.flatnonzero(mark[(h >> np.uint64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(terms, h[maybe]), max(len(terms) - 1, 0))
        hit = terms[at] == h[maybe] if len(terms) else np.zeros(0, bool)
        doc = np.searchsorted(first, maybe[hit], "right") - 1
        doc, code, tf = grouped(doc, at[hit], max(len(terms), 1))
        off = 4 * np.searchsorted(doc, np.arange(len(first)))
        return [longs(np.diff(first)), binaries(code.astype(np.int32).tobytes(), off), binaries(tf.astype(np.int32).tobytes(), off)]

    B = T.BinaryType()
    return map_text(docs, "text", ["doc"], [T.StructField("n", T.LongType()), T.StructField("codes", B), T.StructField("tfs", B)], fn)


def _frequencies(counted: DataFrame, terms: int) -> DataFrame:
    """(code, df), summed in each task before the shuffle."""
    def run(batches):
        df = np.zeros(terms, np.int64)
        for b in batches:
            for v in b.column(0):
                df[np.frombuffer(v.as_buffer(), np.int32)] += 1  # codes of a document are distinct
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([longs(at), longs(df[at])], names=["code", "df"])

    return map_arrow(counted.select("codes"), run, "code long, df long").groupBy("code").agg(F.sum("df").alias("df"))


def length_factor(n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """m of each document: 25 + (75 n N) div L, whatever the size of the product."""
    if not len(n) or 75 * int(n.max()) * docs < 1 << 63:
        return 25 + 75 * n * docs // max(terms, 1)
    return np.array([25 + 75 * int(x) * docs // terms for x in n], np.int64)


def _searched(counted: DataFrame, model: tuple, k: int) -> DataFrame:
    """(key, doc, score): the k best of each item in each task, none below the item's least score."""
    known = counted.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        tree, keys, weight, least, n_docs, n_terms = known.value
        best, dense = Best(least, k), np.zeros(max(len(weight), 1), np.int64)
        for whole in batches:
            bytes_ = np.array([len(v.as_buffer()) for v in whole.column(2)], np.int64)
            at = 0
            while at < whole.num_rows:
                to = at + max(1, int(np.searchsorted(np.cumsum(bytes_[at:at + BLOCK_ROWS]), 4 * BLOCK_TERMS, "right")))
                b = whole.slice(at, to - at)
                size = bytes_[at:to] // 4
                at = to
                code, tf = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.int32).astype(np.int64) for i in (2, 3))
                m = np.repeat(length_factor(b.column(1).to_numpy(), n_docs, n_terms), size)
                value = 1_000_000_000 * tf // (1000 * tf + 8 * m)
                search_block(tree, b.column(0).to_numpy(), np.repeat(np.arange(len(size)), size), code, value, weight, best, dense)
        found = [(keys[tree.order[i]], -doc, score) for i, heap in best.heaps.items() for score, doc in heap]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), longs([x[1] for x in found]),
                                          longs([x[2] for x in found])], names=["key", "doc", "score"])

    usable = counted.where(F.col("doc").isNotNull() & (F.length("codes") > 0)).select("doc", "n", "codes", "tfs")
    return map_arrow(usable, run, "key string, doc long, score long")


def _top(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("key").orderBy(F.desc("score"), "doc")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _batch(docs: DataFrame, items: list[tuple[str, str]], k: int, seed_rows: int) -> DataFrame | None:
    """(key, doc, score, rank) of the items (key, text)."""
    h, first = term_hashes(pa.array([t for _, t in items], pa.string()))
    vocab, code = np.unique(h, return_inverse=True)
    if not len(vocab):
        return None
    row, code, n = grouped(np.repeat(np.arange(len(items)), np.diff(first)), code, len(vocab))
    present, row = np.unique(row, return_inverse=True)  # items without terms have no answer
    keys = [items[i][0] for i in present]
    counted, path = staged_at(_counted(docs, vocab), "term-counts")
    n_docs, n_terms, n_rows = counted.agg(F.sum((F.col("n") > 0).cast("long")), F.sum("n"), F.count(F.lit(1))).first()
    if not n_docs:
        drop_path(docs.sparkSession, path)
        return None
    df = np.zeros(len(vocab), np.int64)
    for r in _frequencies(counted, len(vocab)).collect():  # a row for each term of the batch
        df[r["code"]] = r["df"]
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    tree = ItemTree(row, code, weight[code] * n, len(keys))
    least = np.zeros(len(keys), np.int64)
    if n_rows > 4 * seed_rows:
        cut = int((1 << 63) * min(1.0, 2 * seed_rows / n_rows)) - (1 << 63)
        some = counted.where(F.xxhash64("doc", "n", "codes") < cut)
        place = {keys[i]: p for p, i in enumerate(tree.order.tolist())}
        seeds = _top(_searched(some, (tree, keys, weight, least, n_docs, n_terms), k), k).where(F.col("rank") == k)
        for r in seeds.select("key", "score").collect():  # a row for each item of the batch
            least[place[r["key"]]] = r["score"]
    out = staged(_top(_searched(counted, (tree, keys, weight, least, n_docs, n_terms), k), k), "ranked")
    drop_path(docs.sparkSession, path)
    return out


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", item_bytes: int = ITEM_BYTES,
                  seed_rows: int = SEED_ROWS) -> DataFrame:
    """(item, rank, doc, score): each item's ``k`` best documents with a score above 0, ties by smaller id.

    Null text has no terms.  An item without terms has no row; every row of
    ``items`` is an item, so a repeated row has its answers twice, and a null
    item id is returned as null.  Every row of ``docs`` is a document: a repeated
    one takes as many ranks.  Documents with a null id count in the corpus
    figures and are not ranked.  Empty tables give no rows.  Other columns are
    not read.
    """
    spark = docs.sparkSession
    body = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = staged(items.select(F.col(f"`{item_col}`").alias("item"), F.col(f"`{item_text}`").cast("string").alias("text"))
                  .where(F.col("text").isNotNull()).withColumn("key", F.sha2("text", 256)), "items")
    texts = rows.groupBy("key").agg(F.first("text").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    batches = max(1, math.ceil(total / item_bytes))
    parts = []
    for i in range(batches):
        mine = texts.where(F.pmod(F.xxhash64("key"), F.lit(batches)) == i).orderBy("key").collect() if total else []  # about item_bytes
        found = _batch(body, [(r["key"], r["text"]) for r in mine], k, seed_rows) if mine else None
        if found is not None:
            parts.append(found)
    out = parts[0] if parts else spark.createDataFrame([], "key string, doc long, score long, rank int")
    for p in parts[1:]:
        out = out.unionByName(p)
    return rows.select("item", "key").join(out, "key").select(
        F.col("item").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("doc").alias(id_col), "score")

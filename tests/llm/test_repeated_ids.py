"""One id before several texts or vectors, columns with the operators' own names, texts beyond one slice."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rivulet.llm import hyperminhash, vector_join
from rivulet.llm.common import SLICE_BYTES

SF = "/root/testdata/sf0.001"
OWN_NAMES = ["n_shingles", "fp1", "fp2", "regs", "firsts", "text_in", "__text", "__n", "__x", "__y", "kept", "kept_doc", "kept_row", "component_id",
             "doc", "node", "id", "key", "site", "path", "prob", "g", "h", "lang_pred", "lang_score", "lang_result", "quality_result", "mix", "least"]


def sentence(seed, n=60):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randint(0, 10_000)}" for _ in range(n))


def near(text):
    w = text.split()
    return " ".join([*w[:-1], "other"])


def test_texts_with_one_id_are_linked_by_their_own_text(spark):
    a, b = sentence(1), sentence(2)
    rows = [(5, a), (5, b), (2, near(a)), (3, near(b)), (7, sentence(3)), (7, sentence(4)), (7, sentence(4))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = hyperminhash.near_duplicates(docs, 5, 80, 100).join(docs.withColumn("n", F.lit(1)).groupBy("doc_id").count(), "doc_id")
    found = sorted((r.doc_id, r.component_id, r.kept) for r in got.collect())
    assert found == [(2, 2, True), (3, 3, True), (5, 2, False), (5, 3, False), (7, 7, True), (7, 7, True), (7, 7, True)]
    stay = sorted(map(tuple, hyperminhash.deduplicated(docs, 5, 80, 100).collect()))
    assert stay == sorted([(2, near(a)), (3, near(b)), (7, sentence(3)), (7, sentence(4))])


def test_no_text_is_lost(spark):
    """Every text has a text at 0.8 or more, or itself, among those that stay, reachable by links."""
    rng = random.Random(6)
    base = [sentence(100 + i, rng.choice([4, 5, 6, 9, 30, 80])) for i in range(25)]
    rows = [(rng.randint(0, 9), rng.choice([t, t, near(t), near(near(t))])) for t in base for _ in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def shingles(t):
        w = t.lower().split()
        return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4)))

    sets = {shingles(t) for _, t in rows}
    part = {s: s for s in sets}
    for s in sets:
        for t in sets:
            if part[s] != part[t] and 100 * len(s & t) >= 80 * len(s | t):
                old = part[t]
                part = {k: part[s] if v == old else v for k, v in part.items()}
    stay = {part[shingles(r.text)] for r in hyperminhash.deduplicated(docs, 5, 80, 100).collect()}
    assert stay == set(part.values())


def test_rows_alike_but_for_other_columns_choose_the_same_one(spark):
    t = sentence(9)
    rows = [(1, t, x) for x in "badc"]
    one = {hyperminhash.deduplicated(spark.createDataFrame(r, "doc_id long, text string, x string"), 5).first().x for r in (rows, rows[::-1], rows[2:] + rows[:2])}
    assert len(one) == 1


def test_vectors_with_one_id_keep_their_own_links(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=16), rng.normal(size=16)
    rows = [(1, x.tolist()), (1, y.tolist()), (2, (x + 0.01).tolist()), (3, (y + 0.01).tolist()), (4, rng.normal(size=16).tolist())]
    for cell in (16_384, 2):
        got = vector_join.cosine_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.95, cell=cell)
        assert sorted(map(tuple, got.collect())) == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 0, 4, True)]


@pytest.fixture(scope="module")
def clashing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return docs.select("*", *[F.col("doc_id").cast("string").alias(c) for c in OWN_NAMES])


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_with_clashing_columns(spark, clashing, name, stage):
    plain = stage(spark, clashing.drop(*OWN_NAMES), SF)
    got = stage(spark, clashing, SF)
    if name != "tokens":
        assert got.columns == clashing.columns and got.where("kept <> string(doc_id) or kept_row <> string(doc_id)").count() == 0
    assert sorted(r[0] for r in got.select("doc_id").collect()) == sorted(r[0] for r in plain.select("doc_id").collect())


def test_stages_take_a_text_beyond_one_slice(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = docs.where("lang = 'en' and n_chars > 2000").limit(4).collect()
    long = "\n".join(good[i % 4].text for i in range(5 * SLICE_BYTES // (len(good[0].text) + len(good[1].text)) * 2))
    assert len(long) > 4 * SLICE_BYTES
    more = docs.unionByName(spark.createDataFrame([(10**6, long, "en", good[0].source, len(long)), (10**6 + 1, long + " end", "en", good[0].source, len(long))], docs.schema))
    kept = {name: stage(spark, more, SF) for name, stage in corpus_pipeline.STAGES[1:3]}
    assert kept["language"].where("doc_id >= 1000000").count() == 2
    assert [r.doc_id for r in kept["near_dedup"].where("doc_id >= 1000000").collect()] == [10**6]
    judged = dict(corpus_pipeline.STAGES)["quality"](spark, more, SF)
    assert judged.columns == docs.columns
    ids = dict(corpus_pipeline.STAGES)["tokens"](spark, more.where("doc_id >= 1000000"), SF)
    assert ids.count() == 2


def test_vector_join_writes_each_vector_once(spark, monkeypatch):
    """However many cells and blocks there are, no vector is copied for a pair of them."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 24))
    v = np.concatenate((base, base[:60] + 0.01 * rng.normal(size=(60, 24))))
    x = v / np.sqrt((v * v).sum(axis=1, keepdims=True))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    made = []
    write = vector_join._written_blocks
    monkeypatch.setattr(vector_join, "_written_blocks", lambda *a: made.append(write(*a)) or made[-1])
    got = {r["vec_id"]: r["n_links"] for r in vector_join.cosine_links(df, 0.95, cell=20, block=9).collect()}
    assert got == dict(enumerate(((x @ x.T >= 0.95).sum(axis=1) - 1).tolist()))
    assert sum(b[2] for b in made[0]) == len(v) and max(b[2] for b in made[0]) == 9 and len({b[1] for b in made[0]}) > 9
    for n in range(1, 8):
        met = [frozenset((a, b)) for a in range(5, 5 + n) for b in vector_join.partners(None, a, 5, n)]
        assert len(met) == len(set(met)) == n * (n + 1) // 2

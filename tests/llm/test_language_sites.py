"""Language by compressed sizes recomputed plainly; sites from pages; staged tables."""

import os
import random
import zlib
from collections import defaultdict

import numpy as np
import zstandard
from pyspark.sql import functions as F

from rivulet.llm import lang_zstd, queries, site_bayes
from rivulet.llm.common import scratch, staged

SF = "/root/testdata/sf0.001"
SYLLABLES = {"aa": ["ba", "do", "ki", "lu"], "bb": ["zor", "tep", "vin", "mask"], "cc": ["ñu", "éa", "öß", "xy"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def plain(t):
    return "".join(c for c in t.lower() if not (ord(c) < 128 and not c.isalpha() and c not in " \t\n\v\f\r")).encode().translate(bytes.maketrans(b"\t\n\v\f\r", b"     "))


def sizes_by_hand(t, model):
    """Compressed size of each language, smallest first, with a compressor made anew for every text."""
    body = plain(t)
    if len(body) < 128:
        body = b" " + b" ".join([body] * max(8, -(-128 // len(body)))) + b" "
    out = []
    for lang, dictionary in model.items():
        total = 0
        for i in range(0, len(body), 2048):
            d = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            c = zstandard.ZstdCompressor(level=6, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)
            total += len(c.compress(body[i:i + 2048]))
        out.append((total, lang))
    return sorted(out)


def documents(spark, n=60):
    rng = random.Random(4)
    rows = [(i, text(rng, lang, rng.choice([1, 3, 30, 900])), lang) for i, lang in enumerate(sorted(SYLLABLES) * n)]
    rows += [(None, "ba do", "aa"), (9000, None, "aa"), (9001, "ba do ki", None), (9002, "12 .. 3", "bb"), (9003, "", "cc"), (9003, "ba", "aa")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_sizes_and_choice_equal_plain_compression(spark):
    rows, docs = documents(spark)
    model = lang_zstd.learn(docs)
    assert sorted(model) == sorted(SYLLABLES)
    got = {(r.doc_id, r.text): r.lang_result for r in lang_zstd.identify(docs, model).collect()}
    for i, t, lang in rows:
        r = got[i, t]
        if not t or not any(c.isalpha() for c in t):
            assert (r.lang_pred, r.score, r.accepted) == ("und", 0.0, False)
            continue
        sizes = sizes_by_hand(t, model)
        margin = (sizes[1][0] - sizes[0][0]) / sizes[1][0]
        assert (r.lang_pred, r.score, r.accepted) == (sizes[0][1], margin, margin >= 0.01)
        if len(t.split()) > 2 and lang:
            assert r.lang_pred == lang


def test_learned_rows_are_the_smallest_hashes(spark, monkeypatch):
    monkeypatch.setattr(lang_zstd, "SAMPLE_TEXTS", 5)
    rows, docs = documents(spark, 150)
    copies = spark.createDataFrame([(20_001, "only one text here", "dd")] * 300, "doc_id long, text string, lang string")
    docs = docs.union(copies)
    seen = {}
    monkeypatch.setattr(lang_zstd, "_distinct", lambda sample: seen.update(sample) or {k: [" ".join(t) for t in v] for k, v in sample.items()})
    lang_zstd.learn(docs)
    hashed = docs.where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL").withColumn("h", F.xxhash64("doc_id", "text")).collect()
    want = defaultdict(list)
    for r in sorted(hashed, key=lambda r: (r.h, r.doc_id, r.text)):
        if zlib.crc32(str(r.doc_id).encode()) % 5:
            want[r.lang].append([r.text])
    assert seen == {lang: v[:5][::-1] for lang, v in want.items()}


def test_number_of_languages_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(lang_zstd, "LANGUAGES", 2)
    _, docs = documents(spark)
    docs = docs.union(docs.where("lang = 'cc'")).union(docs.where("lang = 'aa'"))
    assert sorted(lang_zstd.learn(docs)) == ["aa", "cc"]
    assert lang_zstd.learn(docs.limit(0)) == {} and lang_zstd.learn(docs.withColumn("lang", F.lit(None).cast("string"))) == {}


def test_whole_sampled_texts_are_learned(spark):
    long = text(random.Random(1), "aa", 5000) + " onlyattheend"
    docs = spark.createDataFrame([(1, long, "aa"), (2, text(random.Random(2), "bb", 50), "bb")], "doc_id long, text string, lang string")
    model = lang_zstd.learn(docs)
    assert len(model["aa"]) == len(long) and b"onlyattheend" in model["aa"]


def test_places_replace_the_columns(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "word " * int(rng.integers(1, 60)) + "x!" * int(rng.integers(0, 9)), f"s{i % 3}", "en") for i in range(80)] + [(None, "null id", "s1", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(80)], "doc_id long, quality int")
    places = spark.createDataFrame([(i, f"h{i % 2}", "p") for i in range(0, 40)] + [(0, "h9", "z"), (70, None, "q"), (500, "h0", "p"), (None, "h1", "p")],
                                   "id long, site string, path string")
    got = site_bayes.site_quality(docs, labels, columns=["doc_id"], places=places).collect()
    assert len(got) == len(rows)
    # the same by naming the places in the columns
    def place(i, source):
        return (f"host h{i % 2}", "p") if i is not None and i < 40 else (f"source {source}", "en")
    named = spark.createDataFrame([(i, t, *place(i, s)) for i, t, s, _ in rows], "doc_id long, text string, source string, lang string")
    want = site_bayes.site_quality(named, labels, columns=["doc_id"]).collect()
    key = lambda r: -1 if r.doc_id is None else r.doc_id
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        assert a.doc_id == b.doc_id and np.allclose(list(a.quality_result)[:4], list(b.quality_result)[:4], rtol=1e-12)
    assert len({r.quality_result.site_prob for r in got}) > 3


def test_query_takes_hosts_from_pages(spark):
    plain_ = site_bayes.site_quality(queries.table(spark, SF, "documents"), queries.table(spark, SF, "labels"), columns=["doc_id"])
    a = {r.doc_id: r.site_prob for r in queries.op8_site_bayes(spark, SF).collect()}
    b = {r.doc_id: round(r.quality_result.site_prob, 9) for r in plain_.collect()}
    pages = queries.page_documents(spark, SF).where("doc_id IS NOT NULL").select("doc_id").distinct().count()
    assert a.keys() == b.keys() and pages > 0 and sum(a[i] != b[i] for i in a) >= min(pages, len(a)) // 2


def test_scratch_deletes_what_was_staged(spark):
    with scratch(spark):
        with scratch(spark):
            inner = staged(spark.range(3), "x").inputFiles()[0]
        outer = staged(spark.range(3), "x").inputFiles()[0]
        assert not os.path.exists(inner.removeprefix("file:")) and os.path.exists(outer.removeprefix("file:").removeprefix("//"))
    assert not os.path.exists(outer.removeprefix("file:").removeprefix("//"))


def test_a_worker_forgets_other_operators():
    from rivulet.llm import common, prefix_bpe, token_frames
    import public_tokenizers
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        token_frames.encoder(f.read())
    prefix_bpe.codec(prefix_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    common.enter(prefix_bpe.__name__)
    assert token_frames.encoder.cache_info().currsize == 0 and prefix_bpe.codec.cache_info().currsize == 1
    common.enter("another")
    assert prefix_bpe.codec.cache_info().currsize == 0

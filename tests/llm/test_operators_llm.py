"""The operators against brute force on small fixtures: nulls, empty and long texts, copies, empty tables, clashing names."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from rivulet.llm import extendible, hyperminhash, lang_zstd, prefix_bpe, quality_llr, queries, raking, site_bayes, token_frames, url_gbt, vector_join
from rivulet.llm.components import connected_components

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, p long, mix string, g string, shard string, lang_result string"


def words(t):
    return WORD.findall(t or "")


def prose(rng, n):
    return " ".join(rng.choice(["ab", "cde", "fgh", "ij", "klm", "nop", "qr", "stu", "vw", "xyz"]) + str(rng.randint(0, 40)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [prose(rng, n) for n in (3, 5, 12, 40, 90, 90, 300, 4000)]
    texts = [None, "", "  \n\t ", "one", "one two", "ONE two", *base]
    for b in base[2:]:  # near copies: one word in 60 changed, at least one
        w = b.split()
        for _ in range(3):
            v = list(w)
            for i in rng.sample(range(len(v)), max(1, len(v) // 60)):
                v[i] = "new" + str(rng.randint(0, 9))
            texts.append(" ".join(v))
    texts += [base[4]] * 6 + [base[3] + "\n" + base[3] + "\nX"]
    out = [(i, t, [None, "en", "fr"][i % 3], [None, "s1", "s2", "s1"][i % 4], 1, "m", "g", "s", "l") for i, t in enumerate(texts)]
    return out + [(None, base[4], "en", "s1", 1, "m", "g", "s", "l"), (None, None, None, None, None, None, None, None, None), out[8], out[8]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(6, 1), (7, 1), (8, 1), (9, 0), (10, 1), (11, 1), (None, 1), (12, None), (8, 1)], "doc_id long, quality int")


def components(ids, linked):
    """Smallest reachable id by repeated relaxation."""
    low = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


def shingles(t, k):
    w = words((t or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


@pytest.mark.parametrize("k,num,block", [(3, 85, 1 << 22), (5, 80, 1 << 22), (3, 85, 300)])
def test_near_duplicates(docs, rows, k, num, block):
    got = sorted((tuple(r) for r in hyperminhash.near_duplicates(docs, k, num, 100, block=block)
                  .select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)
    sets = {r[0]: shingles(r[1], k) for r in rows if r[0] is not None}
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
              and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    low = components(sets, linked)
    want = sorted([(r[0], len(shingles(r[1], k)), low.get(r[0]), r[0] is None or low[r[0]] == r[0]) for r in rows], key=str)
    assert got == want and linked
    assert len({low[r[0]] for r in rows if r[0] is not None}) < len(sets)


def test_deduplicated_keeps_columns_and_one_row_of_each_group(docs, rows, empty):
    out = hyperminhash.deduplicated(docs, 3, 85, 100)
    assert out.columns == docs.columns
    ids = [r["doc_id"] for r in out.collect()]
    low = {r["doc_id"]: r["component_id"] for r in hyperminhash.near_duplicates(docs, 3, 85, 100).collect()}
    assert sorted(i for i in ids if i is not None) == sorted({v for k, v in low.items() if k is not None})
    assert ids.count(None) == 2
    assert hyperminhash.deduplicated(empty).count() == 0 and hyperminhash.near_duplicates(empty).count() == 0


def test_dense_group_of_near_copies_is_one_component(spark):
    rng = random.Random(9)
    w = prose(rng, 120).split()
    rows = []
    for i in range(300):
        v = list(w)
        v[rng.randrange(len(v))] = f"x{i}"
        rows.append((i, " ".join(v)))
    got = hyperminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, 100, block=5000).collect()
    assert {r["component_id"] for r in got} == {0}


def test_small_sets_that_differ_in_one_word(spark):
    rng = random.Random(12)
    rows = []
    for i in range(3000):
        w = [f"w{rng.randrange(10 ** 6)}" for _ in range(9)]
        rows += [(2 * i, " ".join(w[:8])), (2 * i + 1, " ".join(w))]
    got = hyperminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80, 100).collect()
    assert [r["doc_id"] for r in got if r["component_id"] != r["doc_id"] // 2 * 2] == []


@pytest.mark.parametrize("num", [80, 85, 50])
def test_small_similar_sets_share_a_first_shingle(num):
    rng = np.random.default_rng(6)
    met = 0
    for _ in range(6000):
        c, d, e = rng.integers(1, 19), rng.integers(0, 4), rng.integers(0, 4)
        h = rng.integers(0, 1 << 64, c + d + e, np.uint64)
        a, b = np.sort(h[:c + d]), np.sort(np.delete(h, np.s_[c:c + d]))
        if 100 * c < num * (c + d + e) or min(len(a), len(b)) >= hyperminhash.SMALL:
            continue
        keys = hyperminhash.prefix_bodies(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]), num, 100).to_pylist()
        assert np.intersect1d(*[np.frombuffer(x, np.uint64) for x in keys]).size
        met += 1
    assert met > 500


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 3)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    clean = [e for e in edges if e[0] is not None]
    low = components({x for e in clean for x in e}, clean)
    assert got == {k: v for k, v in low.items() if k != v}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_vector_join(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 16))
    v = [*base, *(base[:20] + 0.05 * rng.normal(size=(20, 16))), *(base[:3] * 2.0), *([base[0]] * 3)]
    v += [base[5] + 0.02 * rng.normal(size=16) for _ in range(30)]
    rows = [(i, [float(np.float32(x)) for x in e], 0) for i, e in enumerate(v)]
    n = len(rows)
    odd = [(n, None, 0), (n + 1, [0.0] * 16, 0), (n + 2, [1.0, None] + [0.0] * 14, 0), (n + 3, [float("nan")] * 16, 0),
           (n + 4, [], 0), (n + 5, [1.0, 2.0], 0), (n + 6, [1.0, 2.0], 1), (None, rows[0][1], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, n long")
    x = {r[0]: np.array(r[1]) for r in rows + odd[5:7]}
    linked = [(a, b) for a in x for b in x if a < b and len(x[a]) == len(x[b])
              and x[a] @ x[b] / np.sqrt((x[a] @ x[a]) * (x[b] @ x[b])) >= 0.95]
    low = components([r[0] for r in rows + odd[:7]], linked)
    want = {i: (sum(i in e for e in linked), low[i], low[i] == i) for i in low} | {None: (0, None, True)}
    for cell, block in ((16384, 8192), (16, 8192), (16, 7)):
        got = {r[0]: tuple(r)[1:] for r in vector_join.cosine_links(df, cell=cell, block=block).collect()}
        assert got == want
    assert vector_join.cosine_links(df.limit(0)).count() == 0


def test_token_files(spark, docs, rows, tmp_path):
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    tk = Tokenizer.from_file(path)
    extra = [(900 + i, t) for i, t in enumerate(["Word, word. WORD!! don't <|endoftext|>, <|ENDOFTEXT|> x", "é e\u0301, Σας. İ\u2003a\xa0b 12,5!", "a\tb\n\nc"])]
    df = docs.select("doc_id", "text", F.lit(1).alias("start")).union(spark.createDataFrame(extra, "a long, b string").selectExpr("a", "b", "1"))
    manifest = token_frames.write_token_files(df, f"file://{tmp_path}/t", path, frame_bytes=4096)
    got = token_frames.read_token_files(manifest).collect()
    ids = {t: np.array(tk.encode(t, add_special_tokens=False).ids + [2], "<u4") for t in {r[1] or "" for r in rows} | {e[1] for e in extra}}
    want = sorted((r[0], len(ids[r[1] or ""]), zlib.crc32(ids[r[1] or ""].tobytes())) for r in [*rows, *extra] if r[0] is not None)
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got if r["doc_id"] is not None) == want
    got = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, None, *sorted(x for x, _, _ in want)]
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1]]
    paths = [r["path"] for r in manifest.collect()]
    some = token_frames.read_documents(paths, [13, 901])
    assert some[13].tolist() == ids[rows[13][1]].tolist() and some[901].tolist() == ids[extra[1][1]].tolist()
    assert token_frames.token_files(df.limit(0), path).count() == 0


def test_reader_opens_only_needed_frames_and_checks_them(tmp_path):
    p = tmp_path / "f"
    with open(p, "wb") as f:
        w = token_frames.FrameWriter(f, 400)
        for i in range(100):
            w.add(i, np.arange(i % 50 + 1, dtype="<u4").tobytes())
        w.add(None, b"")
        w.close()

    class Src:
        def __init__(self, f):
            self.f, self.read, self.seek = f, f.read, f.seek

        def size(self):
            return os.path.getsize(p)

    with open(p, "rb") as f:
        r = token_frames.FrameReader(Src(f))
        assert r.document(77).tolist() == list(range(28)) and r.opened == 1 and r.document(200) is None
        at = int(r.at[3]) + 6
    body = bytearray(p.read_bytes())
    body[at] ^= 255
    p.write_bytes(bytes(body))
    with open(p, "rb") as f, pytest.raises(Exception):
        token_frames.FrameReader(Src(f)).frame(3)


def test_quality_rules(docs, rows, labels, empty):
    got = sorted((tuple(r) for r in quality_llr.quality_rules(docs, labels).select(
        "doc_id", *quality_llr.COUNTS, "base_failed").collect()), key=str)

    def counts(t):
        t = t or ""
        w = words(t)
        tri = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
        cover = {i + j for i, x in enumerate(tri) if tri.count(x) > 1 for j in range(3)} if len(tri) < 700 else None
        lines = [x for x in t.split("\n") if words(x)]
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), cover

    for g, r in zip(got, sorted(rows, key=lambda r: str((r[0], *map(int, counts(r[1])[:4])))), strict=True):
        n, chars, sym, dup, cover = counts(r[1])
        assert g[:5] == (r[0], n, chars, sym, dup)
        if cover is not None:
            assert g[5] == len(cover) and g[6] == (n < 50 or 100 * len(cover) > 50 * n)
    assert quality_llr.quality_rules(empty, labels).count() == 0
    assert all(r["kept"] == (not r["base_failed"]) for r in quality_llr.quality_rules(docs, labels.limit(0)).collect())


def test_quality_scores_against_plain_counting():
    import pyarrow as pa
    texts = ["abc abd", "", None, "zzz | zzz", "é"]
    raw, target = quality_llr.gram_counts(pa.array(texts)), quality_llr.gram_counts(pa.array(texts[:1]))
    ratios = quality_llr.log_ratios(raw, target)
    got = quality_llr.gram_scores(pa.array(texts), ratios)
    for t, g in zip(texts, got):
        b = (t or "").encode()
        grams = [b[i:i + n] for n in quality_llr.GRAMS for i in range(len(b) - n + 1)]
        at = [((int.from_bytes(bytes([len(x)]) + x, "big") & 0xFFFFFFFF) * 2654435761 & 0xFFFFFFFF) >> 16 for x in grams]
        assert g == sum(int(ratios[i]) for i in at) / max(1, len(at)) / quality_llr.SCALE


def test_quality_threshold_and_labelled_accuracy(spark):
    assert quality_llr.best_threshold(np.array([1., 2, 3, 4]), np.array([False, False, True, True])) == 2.5
    assert quality_llr.best_threshold(np.array([1.]), np.array([True])) == float("-inf")
    q = queries.op4_quality_rules(spark, SF).join(queries.table(spark, SF, "labels"), "doc_id")
    hit = q.groupBy("quality").agg(F.avg(F.col("kept").cast("int"))).collect()
    assert all(v > 0.85 if k else v < 0.15 for k, v in hit)


def test_prefix_bpe(docs, rows, empty):
    import tiktoken
    ranks = prefix_bpe.Merges(prefix_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))).rank
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = prefix_bpe.encode_texts(docs, path, public_tokenizers.PATTERN, columns=["doc_id"])
    got = sorted(((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], tuple(r["ids"])) for r in out.collect()), key=str)
    want = []
    for r in rows:
        ids = enc.encode_ordinary(r[1] or "")
        want.append((r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((r[1] or "").encode()).hexdigest(), tuple(ids)))
    assert got == sorted(want, key=str)
    assert {bytes(r["decoded"]).decode() for r in prefix_bpe.decode_ids(out, path).collect()} == {r[1] or "" for r in rows}
    assert prefix_bpe.encode_texts(empty, path, public_tokenizers.PATTERN).count() == 0
    codec = prefix_bpe.Codec(prefix_bpe.read_ranks(path), public_tokenizers.PATTERN)
    rng = random.Random(1)
    for _ in range(2000):
        t = "".join(rng.choice("aab  \n\t'sStllvé中0123!!..😀\u0301\u2003\xa0") for _ in range(rng.randint(0, 40)))
        assert codec.encode(t) == enc.encode_ordinary(t)


def test_prefix_table_appends_and_edits():
    m = prefix_bpe.Merges(prefix_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    rng = random.Random(2)
    for _ in range(200):
        s = bytes(rng.choice(b"thenaio ") for _ in range(30))
        a, b = sorted((rng.randrange(31), rng.randrange(31)))
        t = prefix_bpe.PrefixTable(m, s[:10])
        t.append(s[10:])
        assert t.tokens() == prefix_bpe.PrefixTable(m, s).tokens()
        t.edit(a, b, b"ing")
        assert t.data == s[:a] + b"ing" + s[b:] and t.tokens() == prefix_bpe.PrefixTable(m, t.data).tokens()


def test_language(spark, docs, empty):
    out = queries.op6_language(spark, SF).join(queries.table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").toPandas()
    held = out[out.held_out]
    assert len(held) > 20 and (held.lang_pred == held.lang).mean() > 0.9
    assert out.score.between(0, 1).all()
    assert out.held_out.tolist() == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out.doc_id]
    model = tuple(lang_zstd.learn(queries.table(spark, SF, "documents")).items())
    for t in (None, "", " 12 !?", "★ — 3"):
        assert lang_zstd.predict(t, model) == ("und", 0.0)
    assert lang_zstd.predict("x", ()) == ("und", 0.0) and lang_zstd.predict("x", (("en", b"a b"),)) == ("en", 1.0)
    res = lang_zstd.identify(docs, dict(model))
    assert res.count() == docs.count() and res.columns[:-1] == docs.columns and res.columns[-1] == "_lang_result"
    assert lang_zstd.identified(empty).count() == 0


def test_language_with_a_shared_head(spark):
    head = ("Skip to main content. This page is part of the public archive of our news service; please read the terms of use "
            "before you copy, print or share any part of it. Sign in, subscribe, contact us, about the editors, help and site map. ") * 2
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents").withColumn("headed", F.crc32(F.concat(F.lit("h"), "doc_id")) % 3 == 0)
    docs = docs.withColumn("text", F.concat(F.when(F.col("headed"), head[:256]).otherwise(""), "text"))
    out = lang_zstd.identify(docs, lang_zstd.learn(docs), columns=["lang", "headed", "doc_id"])
    rows = out.where(lang_zstd.held_out("doc_id") & F.col("headed")).join(
        docs.where(F.size(F.split("text", " ")) >= 60).select("doc_id"), "doc_id").select("lang", "lang_result.lang_pred").collect()
    assert len(rows) > 40 and np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.95


def test_language_keeps_short_good_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = queries.table(spark, sf, "documents"), queries.table(spark, sf, "labels")
    short = docs.where(F.size(F.split(F.trim("text"), r"\s+")) <= 5).join(labels.where("quality = 1"), "doc_id")
    rows = lang_zstd.identify(short, lang_zstd.learn(docs), columns=["lang"]).select("lang", "lang_result.*").collect()
    kept = [r for r in rows if r["accepted"]]
    assert len(rows) > 20 and len(kept) > 0.85 * len(rows)
    assert sum(r["lang"] == r["lang_pred"] for r in kept) > 0.9 * len(kept)


RULES = queries.URL_RULES


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/en/1x", "http://example.org/en/2", "http://example.org/es/9?x=/en/", "http://org",
            "http://x.com/fr/1", "http://com/de/2", "http://x.com/en/1", "http://notorg/", "http://a.b://c.org/z", "http://example.org?/es/", "a://b.com/de/#/fr/"]
    labelled = spark.createDataFrame([(f"http://casino{i}-win.net/a?b={i}&c=1", 1) for i in range(40)]
                                     + [(f"http://news.net/en/{i}", 0) for i in range(60)] + [(None, 1), ("http://x.net", None)], "url string, bad int")
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(None, urls[5], "h"), (3, urls[3], "h"), (90, "http://casino9-win.net/a?b=3&c=4", "h")],
                                  "page_id long, url string, host string")
    got = {r["page_id"]: r for r in url_gbt.judge(pages, labelled, RULES).collect()}
    for i, u in enumerate(urls):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fit = [(len(r), r, v) for v, r in RULES if (host == r[:r.index("/")] or host.endswith("." + r[:r.index("/")])) and path.startswith(r[r.index("/"):])]
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, max(fit)[1] if fit else None)
        assert got[i]["verdict"] == (max(fit)[2] if fit else "block" if got[i]["bad_prob"] >= 0.5 else "allow")
    assert got[90]["verdict"] == "block" and got[10]["verdict"] == "allow"
    assert url_gbt.judge(pages, labelled.limit(0), RULES).where("rule IS NULL AND verdict = 'block'").count() == 0
    assert url_gbt.judge(pages.limit(0), labelled, RULES).count() == 0


def test_site_quality(spark, docs, labels, empty):
    out = site_bayes.site_quality(docs, labels)
    assert out.columns[:-1] == docs.columns and out.count() == docs.count()
    assert site_bayes.site_quality(empty, labels).count() == 0 and site_bayes.site_quality(docs, labels.limit(0)).where("NOT quality_result.kept").count() == 0
    got = site_bayes.site_quality(queries.table(spark, SF, "documents"), queries.table(spark, SF, "labels")).toPandas()
    r = got.quality_result.apply(lambda x: x.asDict())
    p = np.array([x["doc_prob"] for x in r])
    got["p"], got["path_prob"], got["prob"] = p, [x["path_prob"] for x in r], [x["prob"] for x in r]
    n, mu = len(got), p.mean()

    def kappa(groups, center):
        g = groups.p.agg(["sum", "count"])
        s2 = ((p ** 2).sum() - (g["sum"] ** 2 / g["count"]).sum()) / (n - len(g))
        tau2 = ((g["count"] * (g["sum"] / g["count"] - center) ** 2).sum() - len(g) * s2) / n
        return min(site_bayes.KAPPA_MAX, s2 / tau2) if tau2 > 0 else site_bayes.KAPPA_MAX

    site, path = got.groupby("source"), got.groupby(["source", "lang"])
    mean_of = {k: v.p.mean() for k, v in site}
    ks = kappa(site, mu)
    kp = kappa(path, np.array([mean_of[k[0]] for k in path.p.sum().index]))
    for i in range(0, n, 7):
        row = got.iloc[i]
        s, q = got[got.source == row.source].p, got[(got.source == row.source) & (got.lang == row.lang)].p
        sp = (s.sum() - row.p + ks * mu) / (len(s) - 1 + ks)
        pp = (q.sum() - row.p + kp * sp) / (len(q) - 1 + kp)
        logit = lambda x: np.log(x / (1 - x))
        assert abs(row.path_prob - pp) < 1e-6 and abs(row.prob - 1 / (1 + np.exp(-(logit(row.p) + logit(pp) - logit(mu))))) < 1e-5
    lab = got.merge(queries.table(spark, SF, "labels").toPandas(), on="doc_id")
    assert ((lab.prob >= 0.5) == (lab.quality == 1)).mean() > 0.9


def test_raking(spark, docs, empty):
    dims = {"source": F.col("source"), "lang": F.col("lang")}
    out = raking.mixed(docs, dims)
    assert out.count() == docs.count() and out.columns[:-1] == docs.columns and out.columns[-1] == "_mix"
    assert raking.mixed(empty, dims).count() == 0 and raking.sampled(docs, dims).columns == docs.columns
    tables = raking.mixed(queries.table(spark, SF, "documents"), queries.mix_dims()).selectExpr("source", "lang", "mix.*").toPandas()
    tables["w"] = tables.n_tokens * tables.weight
    for d in ("source", "lang"):
        t = tables.groupby(d).agg(raw=("n_tokens", "sum"), got=("w", "sum"))
        want = t.raw ** raking.TEMPERATURE
        assert np.allclose(t.got / t.got.sum(), want / want.sum(), atol=2e-3)
    assert tables.keep_prob.between(0, 1).all() and tables.keep_prob.max() == 1


@pytest.mark.parametrize("limit", [1, 700, 5000, 1 << 30])
def test_sharding(docs, rows, limit, empty, tmp_path):
    out = extendible.assign_shards(docs, limit)
    assert out.columns[:-1] == docs.columns and out.columns[-1] == "_shard"
    key = [hashlib.md5(str(r[0]).encode() if r[0] is not None else hashlib.md5((r[1] or "").encode()).hexdigest().encode()).hexdigest() for r in rows]
    h = [int(k[:15], 16) for k in key]
    size = [len((r[1] or "").encode()) for r in rows]

    def leaf(i):
        for d in range(61):
            same = [j for j in range(len(h)) if h[j] >> (60 - d) == h[i] >> (60 - d)]
            if sum(size[j] for j in same) <= limit or len({h[j] for j in same}) == 1:
                return format(h[i], "060b")[:d], d, size[i], sum(size[j] for j in same)

    want = sorted(str((rows[i][0], *leaf(i))) for i in range(len(rows)))
    assert sorted(str((r["doc_id"], *tuple(r["_shard"])[:4])) for r in out.collect()) == want
    assert extendible.assign_shards(empty, limit).count() == 0
    if limit == 5000:
        directory = extendible.write_shards(docs, str(tmp_path / "s"), limit=limit).collect()
        assert sum(r["docs"] for r in directory) == len(rows) and len(os.listdir(tmp_path / "s")) >= len(directory)


def test_pipeline_stages(spark):
    import corpus_pipeline
    docs = queries.table(spark, SF, "documents")
    labels = queries.table(spark, SF, "labels")
    good = corpus_pipeline.quality(spark, docs, SF)
    assert good.columns == docs.columns
    lab = docs.join(labels, "doc_id").select("doc_id", "quality").toPandas().set_index("doc_id").quality
    stay = {r[0] for r in good.select("doc_id").collect()}
    assert np.mean([(i in stay) == bool(q) for i, q in lab.items()]) > 0.9
    kept = corpus_pipeline.near_dedup(spark, docs, SF)
    want = {r["component_id"] for r in hyperminhash.near_duplicates(docs, 5, 80, 100).collect()}
    assert kept.columns == docs.columns and {r[0] for r in kept.select("doc_id").collect()} == want
    for f in (corpus_pipeline.language, corpus_pipeline.mix):
        out = f(spark, docs, SF)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()
    assert corpus_pipeline.run(spark, SF).count() > 0


@pytest.fixture(scope="module")
def many_labels(spark):
    """More labelled documents than the 20,000 that models were once fitted on: (texts, good, docs, labels)."""
    rng = np.random.default_rng(3)
    n, vocabulary = 20_400, np.array(["alpha", "Brick", "cedar 12", "delta!", "ember", "# | fig", "GROVE,", "hazel. 7"])
    good = rng.random(n) < 0.5
    lean = np.where(good[:, None], [.2, .1, .15, .1, .15, .05, .1, .15], [.1, .15, .1, .15, .1, .15, .15, .1])
    texts = [" ".join(vocabulary[rng.choice(8, 12, p=p)]) + f" {i} " + " ".join(f"w{j}{'abcdefg'[(i + j) % 7]}" for j in range(50)) for i, p in enumerate(lean)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("source", F.lit("s")).withColumn("lang", F.lit("en"))
    labels = spark.createDataFrame([(i, int(g)) for i, g in enumerate(good)], "doc_id long, quality int")
    return texts, good, docs, labels


def test_quality_counts_every_label(many_labels):
    import pyarrow as pa
    texts, good, docs, labels = many_labels
    arr = pa.array(texts)
    ratios = quality_llr.log_ratios(quality_llr.gram_counts(arr), quality_llr.gram_counts(arr.filter(pa.array(good))))
    scores = quality_llr.gram_scores(arr, ratios)
    cut = quality_llr.best_threshold(scores, good)
    got = quality_llr.quality_rules(docs, labels).orderBy("doc_id").toPandas()
    assert not got.base_failed.any() and 0.6 * len(good) < (got.kept == good).sum() < len(good)
    assert got.score.tolist() == scores.tolist() and got.kept.tolist() == (scores >= cut).tolist()


def test_site_classifier_learns_from_every_label(many_labels):
    import pyarrow as pa
    texts, good, docs, labels = many_labels
    w, b = site_bayes.classifier(docs, labels, "doc_id", "text", "doc_id", "quality")
    x = site_bayes.measures(pa.array(texts))
    sd = np.where(x.std(axis=0) < 1e-9, 1.0, x.std(axis=0))
    p = 1 / (1 + np.exp(-(x @ w + b)))
    slope = ((x - x.mean(axis=0)) / sd).T @ (good - p) - site_bayes.RIDGE * len(x) * w * sd
    assert np.abs(slope).max() < 1e-4 and abs((good - p).sum()) < 1e-4 and np.abs(w).max() > 0.1


def test_threshold_of_a_table(spark):
    rng = np.random.default_rng(8)
    for n, kinds in ((0, 1), (1, 1), (2, 2), (60, 7), (3000, 90), (3000, 10**6)):
        scores = rng.integers(0, kinds, n) / 8 - 3
        good = rng.random(n) < np.clip(scores / (kinds / 8) + 0.9, 0.1, 0.9)
        for flags in (good, ~good, np.ones(n, bool)):
            rows = spark.createDataFrame([(float(s), bool(g)) for s, g in zip(scores, flags)], "score double, good boolean").repartition(3)
            got = quality_llr.table_threshold(rows)
            s = np.unique(scores)
            if not flags.any() or flags.all():
                assert got == float("-inf")
                continue
            gain = [int((scores[~flags] < v).sum() * flags.sum() - (scores[flags] < v).sum() * (~flags).sum()) for v in s]
            i = int(np.argmax(gain))  # the lowest of equal ones
            assert got == (float((s[i] + s[i - 1]) / 2) if i else float("-inf"))

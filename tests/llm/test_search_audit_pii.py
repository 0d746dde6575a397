"""Ranked search, source audit and personal data against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rivulet.llm import dual_tree, pii_transducer, queries, source_audit

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, term string, item string, key string, n long, p0 long, rank int"
LOWER = str.maketrans({i: i + 32 for i in range(65, 91)})
LOOK_ALIKE_WORDS = ["alpha", "Beta", "gamma9", "x", "été", "straße", "delta-4", "a", "ab", "abc", "abcdefgh", "abcdefghi", "abcdefghj", "abcdefghij"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)

    def prose(n):
        return rng.choice([" ", "\n"]).join(rng.choice(LOOK_ALIKE_WORDS) for _ in range(n))

    texts = [None, "", " .. ", "alpha", "ALPHA alpha", *[prose(rng.randint(1, 60)) for _ in range(60)], "rareword " * 3]
    out = [(i, t, [None, "en", "fr"][i % 3], [None, "s1", "s2", "s1", "s3"][i % 5], "t", "i", "k", 1, 2, 3) for i, t in enumerate(texts)]
    return out + [out[9], out[9], (None, "alpha rareword", "en", "s1", "t", "i", "k", 1, 2, 3), (None,) * 10, (900, None, "xx", "only", *[None] * 6),
                  (901, "", "xx", "other", *[None] * 6)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


# ---- ranked search ---------------------------------------------------------------

def search_by_hand(docs, items, k=10):
    def terms(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))

    bags = [(i, terms(t)) for i, t in docs]
    n_docs, length = sum(bool(b) for _, b in bags), sum(len(b) for _, b in bags)
    df = Counter(t for _, b in bags for t in set(b))
    out = []
    for item, text in items:
        scores = []
        for doc, bag in bags:
            if doc is None:
                continue
            m, tf = 100 - 75 + 75 * len(bag) * n_docs // max(length, 1), Counter(bag)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in terms(text) if tf[t])
            if s > 0:
                scores.append((-s, doc))
        out += [(item, r, doc, -s) for r, (s, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


ITEMS = [(1, "Alpha x"), (2, "abcdefghi abcdefghi ABCDEFGHIJ été"), (3, None), (4, ""), (5, "nowhere"), (6, "gamma9 straße delta a ab 4"), (7, "rareword"),
         (None, "beta abc"), (1, "Alpha x"), *[(20 + i, " ".join(LOOK_ALIKE_WORDS[i % 14:i % 14 + 3])) for i in range(40)]]


@pytest.mark.parametrize("item_bytes,seed_rows,small", [(1 << 22, 8192, False), (1 << 22, 4, True), (60, 8192, True)])
def test_search_equals_brute_force(spark, docs, rows, item_bytes, seed_rows, small, monkeypatch):
    if small:  # many nodes
        for name, v in (("LEAF", 2), ("FAN", 2), ("ITEM_LEAF", 2), ("ITEM_FAN", 2), ("BLOCK_ROWS", 13)):
            monkeypatch.setattr(dual_tree, name, v)
    items = spark.createDataFrame([(i, t, "z") for i, t in ITEMS], "item_id long, text string, score string")
    got = dual_tree.ranked_search(docs, items, 10, item_bytes=item_bytes, seed_rows=seed_rows)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == search_by_hand([(r[0], r[1]) for r in rows], ITEMS)


def test_search_of_empty_tables(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    none = spark.createDataFrame([], DOCS)
    for d, i in ((none, items), (docs, items.limit(0)), (none, items.limit(0)), (none.withColumn("text", F.lit(None).cast("string")), items)):
        assert dual_tree.ranked_search(d, i).count() == 0


def test_trees_skip_and_bounds_hold():
    """Documents of two vocabularies: an item of one never reaches the leaves of the other."""
    rng = np.random.default_rng(3)
    n, width = 4000, 400
    row = np.repeat(np.arange(n), 12)
    code = np.sort(rng.integers(0, width // 2, (n, 12)) + (np.arange(n) % 2)[:, None] * (width // 2), axis=1).reshape(-1)
    keep = np.concatenate(([True], (code[1:] != code[:-1]) | (row[1:] != row[:-1])))
    row, code = row[keep], code[keep]
    value, weight = rng.integers(1, 900, len(row)), rng.integers(1, 30, width)
    irow = np.repeat(np.arange(30), 5)
    icode = np.stack([rng.choice(width // 2, 5, replace=False) for _ in range(30)])
    icode.sort(axis=1)
    icode = icode.reshape(-1)
    tree = dual_tree.ItemTree(irow, icode, weight[icode], 30)
    best, dense = dual_tree.Best(np.zeros(30, np.int64), 10), np.zeros(width, np.int64)
    reached = dual_tree.search_block(tree, np.arange(n), row, code, value, weight, best, dense)
    assert reached <= n // 2 + dual_tree.LEAF and not dense.any()
    full = np.zeros((n, width), np.int64)
    full[row, code] = value
    for place, heap in best.heaps.items():
        q = np.zeros(width, np.int64)
        at = irow == tree.order[place]
        q[icode[at]] = weight[icode[at]]
        s = full @ q
        want = sorted(((-x, i) for i, x in enumerate(s.tolist()) if x > 0))[:10]
        assert sorted((-x, -d) for x, d in heap) == want


# ---- source audit ------------------------------------------------------------------

def audit_by_hand(rows, top=200):
    bags = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))) for _, t, lang, source, *_ in rows]
    out = []
    for lang in {x[0] for x in bags}:
        df = Counter(t for x in bags if x[0] == lang for t in set(x[2]))
        kept = {t for t, n in df.items() if n >= 3}

        def shares(members):
            c = Counter(t for x in members for t in x[2] if t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}, c

        q, _ = shares([x for x in bags if x[0] == lang])
        sources = sorted({x[1] for x in bags if x[0] == lang})
        p = {s: shares([x for x in bags if x[:2] == (lang, s)]) for s in sources}
        for s in sources:
            pair = [(o, sum((p[s][0][t] - p[o][0][t]) ** 2 // p[o][0][t] for t in kept)) for o in sources if o != s]
            term = [(t, (p[s][0][t] - q[t]) ** 2 // q[t]) for t in kept if p[s][1][t] and p[s][0][t] > q[t]]
            for part, found, limit in (("pair", pair, None), ("term", term, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, r) for r, (i, v) in enumerate(found[:limit], 1)]
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"block": 2, "limit": 64, "slice_rows": 5, "top": 3}])
def test_audit_equals_brute_force(docs, rows, options, monkeypatch):
    if options:
        monkeypatch.setattr(source_audit, "PAIRS", 3)
    got = source_audit.audit(docs.drop("item"), **options)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == audit_by_hand(rows, options.get("top", 200))


def test_audit_of_empty_and_clashing(spark, docs):
    assert source_audit.audit(spark.createDataFrame([], DOCS)).count() == 0
    named = docs.select("text", F.col("lang").alias("value"), F.col("source").alias("item"))
    got = source_audit.audit(named, lang_col="value", source_col="item")
    assert got.columns == ["_value", "_item", "part", "item", "value", "rank"] and got.count() > 0


def test_pointer_sort_is_the_order_of_the_bytes():
    rng = random.Random(2)
    for n in (0, 1, 500):
        terms = ["".join(rng.choice("aé") for _ in range(rng.choice([1, 7, 8, 9, 16, 30]))) for _ in range(n)]
        raw = [t.encode() for t in terms]
        data = np.frombuffer(b" ".join(raw), np.uint8)
        size = np.array([len(r) for r in raw], np.int64)
        starts = np.cumsum(size + 1) - size - 1
        order, run = source_audit.sorted_pointers(data, starts, starts + size)
        assert [raw[i] for i in order] == sorted(raw)
        distinct = sorted(set(raw))
        assert [distinct[r] for r in run] == sorted(raw)


def test_a_text_beyond_one_slice_is_one_document(spark):
    long = ("word été abcdefghijk " * 60_000) + "tail"
    docs = spark.createDataFrame([(1, long, "en", "a"), (2, "word tail", "en", "b"), (3, "word tail", "en", "b")], "doc_id long, text string, lang string, source string")
    c = {(r.source, r.term): (r.n, r.docs) for r in source_audit.term_counts(docs.select("text", "lang", "source"), limit=50_000)
         .groupBy("source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).collect()}
    assert c == {("a", "word"): (60_000, 1), ("a", "été"): (60_000, 1), ("a", "abcdefghijk"): (60_000, 1), ("a", "tail"): (1, 1),
                 ("b", "word"): (2, 2), ("b", "tail"): (2, 2)}
    found = dual_tree.ranked_search(docs, spark.createDataFrame([(1, "tail word")], "item_id long, text string"))
    assert [tuple(r) for r in found.orderBy("rank").collect()] == search_by_hand([(1, long), (2, "word tail"), (3, "word tail")], [(1, "tail word")])


# ---- personal data -------------------------------------------------------------------

def base_by_hand(t):
    """The rules as plain expressions over the text."""
    def luhn(d):
        return sum(sum(map(int, str(int(c) * (1 + i % 2)))) for i, c in enumerate(reversed(d))) % 10 == 0

    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub(r"\D", "", m.group())
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    return sorted(out + [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub(r"\D", "", m.group())) <= 15])


# (text, the added spans' texts)
DISGUISED = [
    ("mail john dot smith at example dot com now", ["john dot smith at example dot com"]),
    ("ä a.b [at] example [dot] com.", ["a.b [at] example [dot] com"]),
    ("jоhn@example.com x", ["jоhn@example.com"]),
    ("αdmin@ехample.com", ["αdmin@ехample.com"]),
    ("j​ohn@exam​ple.com", ["j​ohn@exam​ple.com"]),
    ("john arroba ejemplo punto es", ["john arroba ejemplo punto es"]),
    ("max (at) firma (punkt) de, danke", ["max (at) firma (punkt) de"]),
    ("bosbt.42 at mail8.example.com", ["bosbt.42 at mail8.example.com"]),
    ("john@example dot com and more", ["john@example dot com"]),
    ("john @ example . com", ["john @ example . com"]),
    ("john_at_example_dot_com", ["john_at_example_dot_com"]),
    ("call ＋４４ ２０ ７９４６ ０９５８ 12", ["＋４４ ２０ ７９４６ ０９５８ 12"]),
    ("plus one nine eight eight five five five two four eight five ok", ["plus one nine eight eight five five five two four eight five"]),
    ("+un neuf huit huit cinq cinq cinq deux quatre huit cinq", ["+un neuf huit huit cinq cinq cinq deux quatre huit cinq"]),
    ("+1 (nine eight eight) double five five-2485", ["+1 (nine eight eight) double five five-2485"]),
    ("nine eight eight five five five two four eight five", ["nine eight eight five five five two four eight five"]),
    ("four one one one one one one one one one one one one one one one", ["four one one one one one one one one one one one one one one one"]),
    ("4111–1111–1111–1111 x", ["4111–1111–1111–1111"]),
    ("4l11 1111 1111 1111", ["4l11 1111 1111 1111"]),
    ("one nine two dot one six eight dot zero dot one", ["one nine two dot one six eight dot zero dot one"]),
    ("192[.]168[.]0[.]1 and 10 dot 0 dot 0 dot 1", ["192[.]168[.]0[.]1", "10 dot 0 dot 0 dot 1"]),
    ("john(a)example.com or max[a]firma.de", ["john(a)example.com", "max[a]firma.de"]),
    ("john&#64;example&#46;com", ["john&#64;example&#46;com"]), ("john&commat;example&period;com", ["john&commat;example&period;com"]),
    ("max (ät) firma.de", ["max (ät) firma.de"]),
    # nothing to add
    ("item (a) www.x.com, (b) y.org, f(a)g.hello", []), ("&#8364; 5 &amp; &#65;&#64;", []),
    ("see the page at example.com or http://a.org", []), ("the cat at the door dot and", []), ("+33 1 23 45 67 89 un jour, huit", []),
    ("we met at dot com", []), ("a@b.c 1.2.3.4 and +1 (988) 555-2485 4111111111111111", []), ("seven one", []), ("triple one double two three", []),
    ("Il a un chat et une maison; null Uhr acht", []), ("привет как дела", []), ("a@b", []), ("@@ .@. a@.b", []),
]


def test_disguised_identifiers():
    for text, want in DISGUISED:
        base = pii_transducer.base_spans(text)
        more = [(s, k, e) for s, k, e in pii_transducer.disguised_spans(text) if (s, k, e) not in base]
        assert [text[s:e] for s, _, e in more] == want, text


def test_base_rules_equal_plain_expressions():
    rng = random.Random(8)
    bits = ["a", "B.c", "@", ".", "-", "+", "4111", "1111 1111", "1.2.3.4", "255.0", " ", "  ", "x@y.z", "(988) 555-2485", "9", "é", "\n", "+1", "0000255.1.1.256", "5500000000000004"]
    for _ in range(20_000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert pii_transducer.base_spans(t) == base_by_hand(t), t


def test_spans_of_rewritten_text_lie_in_the_source():
    rng = random.Random(4)
    bits = ["j", "о", " at ", "[at]", " dot ", "(.)", "com", "one ", "five-", "plus ", "4", "l", "١", "＠", ".", "​", " ", "é", "+", "b@c.de", "double two "]
    for _ in range(20_000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))
        for s, k, e in pii_transducer.disguised_spans(t):
            assert 0 <= s < e <= len(t) and t[s] not in pii_transducer.INVISIBLE and t[e - 1] not in pii_transducer.INVISIBLE


def test_needs_never_hide_a_span(spark):
    texts = [t for t, _ in DISGUISED] + ["x " + t.upper() for t, _ in DISGUISED] + ["", "a@b.c", "1.2.3.4", "4111111111111111", "+12345678901"]
    need = pii_transducer.needs(pa.array(texts))
    for i, t in enumerate(texts):
        for _, k, _ in pii_transducer.base_spans(t):
            assert need[pii_transducer.KINDS[k]][i]
        assert need["hidden"][i] or not set(pii_transducer.disguised_spans(t)) - set(pii_transducer.base_spans(t)), t


def test_pii_table_and_mask(spark):
    long = "filler words here " * 80_000 + "x (at) mail8.example.com"
    rows = [(1, None, "b"), (2, "", "b"), (None, "a@b.cd", "b"), (3, "é 1.2.3.4, a@b.cd", "b"), (3, "é 1.2.3.4, a@b.cd", "b"), (4, "x [at] y.com", "b"), (5, long, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, masked_text string")
    got = {(r.doc_id, r.n): r.pii for r in pii_transducer.pii_spans(docs).withColumn("n", F.length("text")).collect()}
    assert [(s.kind, s.start, s.end, s.base) for s in got[(3, 17)]] == [("ip", 2, 9, True), ("email", 11, 17, True)]
    assert got[(1, None)] == [] and got[(2, 0)] == [] and [s.base for s in got[(4, 12)]] == [False]
    assert [(s.start, s.end) for s in got[(5, len(long))]] == [(len(long) - 24, len(long))]
    out = pii_transducer.masked(docs).where("doc_id < 5").collect()
    assert sorted((r.doc_id, r.text or "", r.masked_text) for r in out) == [
        (1, "", "b"), (2, "", "b"), (3, "é <ip>, <email>", "b"), (3, "é <ip>, <email>", "b"), (4, "<email>", "b")]
    assert [r.doc_id for r in out if r.text is None] == [1]
    with pytest.raises(ValueError):
        pii_transducer.pii_spans(docs.withColumn("PII", F.lit(1)))
    assert pii_transducer.pii_spans(docs.limit(0)).count() == 0


def test_pii_query_on_given_documents(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op13_pii_transducer(spark, SF).collect():
        base = base_by_hand(docs[r.doc_id])
        names = ",".join(f"{pii_transducer.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert r.base_sha256 == hashlib.sha256(names.encode()).hexdigest() and r.spans == names  # none of these is in disguise
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in base) for i in range(4)]

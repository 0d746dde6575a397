"""Texts far beyond one slice of a task: counts, ids and sizes of the whole text."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
import public_tokenizers
import tiktoken
import base64
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rivulet.llm import extendible, prefix_bpe, quality_llr, queries, raking, token_frames
from rivulet.llm.common import SLICE_BYTES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    words = ["été", "word", "x#y", "**", "it's", "a", "naïve", "1234", "Zürich,", "the", "end.", "<b>"] + [f"w{i}" for i in range(4000)]
    prose = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\n", "\t"]) for _ in range(260_000))
    lines = "\n".join(rng.choice(["same line here", "another line", f"line {rng.randrange(10 ** 6)}"]) for _ in range(90_000))
    one = "abc" * 120_000  # a single word
    out = [prose, lines, one, "short text", "", None]
    assert all(len(t) > SLICE_BYTES for t in out[:3]) and len(prose) > 4 * SLICE_BYTES
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("source", F.lit("s"))


def test_quality_counts_of_whole_texts(spark, docs, texts):
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_llr.quality_rules(docs, labels).collect()}
    for i, t in enumerate(texts):
        w = WORD.findall(t or "")
        windows = [tuple(w[j:j + 3]) for j in range(len(w) - 2)]
        n = Counter(windows)
        repeat = len({j + d for j, x in enumerate(windows) if n[x] > 1 for d in range(3)})
        seen, dup = set(), 0
        for line in (t or "").split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, repeat), i


def test_byte_ids_of_whole_texts(docs, texts):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in prefix_bpe.encode_texts(docs, path, public_tokenizers.PATTERN, columns=["doc_id"], with_ids=False).collect()}
    for i, t in enumerate(texts):
        if i == 2:
            continue  # the library needs very long for one piece of 360,000 letters; see the next test
        ids = enc.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    for i, t in enumerate(texts):
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_one_long_piece():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    piece = "abc" * 6000
    assert prefix_bpe.codec(prefix_bpe.read_ranks(path), public_tokenizers.PATTERN).encode(piece) == enc.encode_ordinary(piece)


def test_token_files_of_whole_texts(spark, docs, texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    got = {r.doc_id: r for r in token_frames.token_files(docs, path).collect()}
    start = 0
    for i, text in enumerate(texts):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(raw)), i
        start += len(ids)


def test_mix_and_shards_of_whole_texts(docs, texts):
    mixed = {r.doc_id: r.mix.n_tokens for r in raking.mixed(docs, queries.mix_dims()).collect()}
    assert mixed == {i: len(WORD.findall(t or "")) for i, t in enumerate(texts)}
    shards = {r.doc_id: r.shard for r in extendible.assign_shards(docs.select("doc_id", "text"), limit=SLICE_BYTES).collect()}
    assert {i: s.n_bytes for i, s in shards.items()} == {i: len((t or "").encode()) for i, t in enumerate(texts)}
    assert shards[0].oversized and not shards[3].oversized

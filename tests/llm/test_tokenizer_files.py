"""Token files of tokenizers that may and may not be applied word by word."""

import json

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from rivulet.llm import token_frames

TEXTS = ["Two  words,  three\n\n blanks .", " leading", "trailing ", "", "It's <|endoftext|> here", "a\tb\x0bc", "ÀÉ ñandú", "x" * 300]


def test_rules_are_recognised():
    word, byte = (open(public_tokenizers.path(f), encoding="utf-8").read() for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    assert token_frames.parts_at_blanks(word) and not token_frames.parts_at_blanks(byte)
    other = json.loads(word)
    for change in ({"normalizer": None}, {"pre_tokenizer": None}, {"truncation": {"max_length": 5}}, {"normalizer": {"type": "Sequence", "normalizers": []}},
                   {"added_tokens": [{**other["added_tokens"][0], "lstrip": True}]}):
        assert not token_frames.parts_at_blanks(json.dumps({**other, **change}))


def test_files_hold_the_ids_of_whole_texts(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = public_tokenizers.path(name)
        t = Tokenizer.from_file(path)
        manifest = token_frames.write_token_files(docs, token_frames.work_dir(spark, "tok"), path, end_id=2)
        got = token_frames.read_documents([r.path for r in manifest.collect()], range(len(TEXTS)))
        for i, text in enumerate(TEXTS):
            assert np.array_equal(got[i], [*t.encode(text, add_special_tokens=False).ids, 2]), (name, text)

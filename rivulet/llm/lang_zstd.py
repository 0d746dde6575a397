"""Language identification by compression.

Each language has a raw-content zstandard dictionary made of a bounded sample
of its labelled texts, whole, without phrases that another language's sample
has too or that were already taken.  A text is lower-cased, stripped of ASCII digits and
signs, cut into blocks (the whole text, so the dictionary matters throughout)
and compressed with every dictionary; the smallest total names the language.
A text so short that zstandard would store it as it is, is repeated first: the
copies cost the same with every dictionary, the first one does not.
The score is the relative margin to the second; below ``min_margin`` the answer
is marked as not accepted.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.llm.common import fresh, map_text, remembers

#: Whole texts sampled for each language, and languages learned, those with the most documents: the bound of what is
#: learned from.  Every text is compressed with every dictionary, so time grows with the languages.
SAMPLE_TEXTS = 128
LANGUAGES = 256
#: Words in a row that are taken once.
PHRASE = 4
BLOCK_BYTES = 2048
#: Texts of fewer bytes are repeated, ``COPIES`` times and to this size at least.
SHORT_BYTES = 128
COPIES = 8
LEVEL = 6
MIN_MARGIN = 0.01
UNKNOWN = "und"

_LETTERS = bytes(range(97, 123))
_DROP = bytes(b for b in range(128) if b not in _LETTERS and b not in b" \t\n\v\f\r")
_SPACES = bytes.maketrans(b"\t\n\v\f\r", b"     ")


def plain(text: str) -> bytes:
    """Lower case, without ASCII digits and signs, white space as blanks."""
    return text.lower().encode().translate(_SPACES, _DROP)


def held_out(id_col: str) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text is divisible by 5."""
    return F.crc32(F.col(f"`{id_col}`").cast("string")) % 5 == 0


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Dictionary bytes of every language of the documents that are not held out.

    The sample of a language are the documents with the smallest hashes of id and
    text; rows with a null id, text or language are not learned from.  Counts a
    language give a hash below which about four times the sample lies, so that
    no task ranks a whole language; one with too few rows below it (copies of
    one row) is ranked whole.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    rows = rows.where(F.col("id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull()).where(~held_out("id"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()}
    if not counts:
        return {}
    rows = rows.withColumn("h", F.xxhash64("id", "text"))
    got = _smallest(rows, {lang: min(1.0, 4 * SAMPLE_TEXTS / n) for lang, n in counts.items()})
    short = [lang for lang, n in counts.items() if len(got.get(lang, [])) < min(SAMPLE_TEXTS, n)]
    if short:
        got |= _smallest(rows, dict.fromkeys(short, 1.0))
    model = _dictionaries(_cleaned(_distinct({lang: [[t] for t in reversed(texts)] for lang, texts in sorted(got.items())})))
    _compressors.cache_clear()  # those of the halves are not needed again
    return model


def _smallest(rows: DataFrame, part: dict[str, float]) -> dict[str, list[str]]:
    """The texts with the smallest hashes of each language, of those in the lowest ``part`` of all hashes."""
    cuts = [(lang, min((1 << 63) - 1, int(p * (1 << 64)) - (1 << 63))) for lang, p in part.items()]
    cut = rows.sparkSession.createDataFrame(cuts, "lang string, cut long")  # LANGUAGES rows at most
    first = Window.partitionBy("lang").orderBy("h", "id", "text")
    few = rows.join(F.broadcast(cut), "lang").where(F.col("h") <= F.col("cut"))
    got = few.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= SAMPLE_TEXTS).select("lang", "rank", "text").collect()
    out: dict[str, list[str]] = {}
    for r in sorted(got, key=lambda r: (r["lang"], r["rank"])):
        out.setdefault(r["lang"], []).append(r["text"])
    return out


def _phrases(words: list[bytes]) -> list[int]:
    """Hashes of the runs of ``PHRASE`` words; of fewer words, of all of them."""
    return [hash(tuple(words[j:j + PHRASE])) for j in range(max(1, len(words) - PHRASE + 1))] if words else []


def _distinct(sample: dict[str, list[list[str]]]) -> dict[str, list[str]]:
    """The texts of the pieces without the words of a phrase that another language or an earlier text has.

    A language that would lose all its words keeps them.
    """
    split = {lang: [[plain(p).split() for p in t] for t in texts] for lang, texts in sample.items()}
    owner: dict[int, str | None] = {}
    for lang, texts in split.items():
        for g in (g for t in texts for p in t for g in _phrases(p)):
            owner[g] = lang if owner.get(g, lang) == lang else None
    out = {}
    for lang, texts in split.items():
        seen, left = set(), []
        for t in texts:
            keep, own = [], set()
            for p in t:
                drop = set()
                for j, g in enumerate(_phrases(p)):
                    own.add(g)
                    if owner[g] is None or g in seen:
                        drop.update(range(j, j + PHRASE))
                keep += [w for j, w in enumerate(p) if j not in drop]
            seen |= own
            if keep:
                left.append(b" ".join(keep).decode())
        out[lang] = left or [" ".join(t) for t in sample[lang]]
    return out


def _dictionaries(sample: dict[str, list[str]]) -> dict[str, bytes]:
    return {k: b" ".join(map(plain, v)) for k, v in sorted(sample.items())}


def _cleaned(sample: dict[str, list[str]]) -> dict[str, list[str]]:
    """The sample without texts that the other half of it gives another language (wrong labels).

    A tie gives it no other.  A language that would lose all its texts keeps them.
    """
    halves = [{k: v[i::2] for k, v in sample.items() if v[i::2]} for i in (0, 1)]
    models = [tuple(_dictionaries(h).items()) for h in halves]
    out = {}
    for lang, texts in sample.items():
        told = [predict(t, models[1 - i % 2]) for i, t in enumerate(texts)]
        good = [t for t, (name, margin) in zip(texts, told) if name == lang or margin == 0 and name != UNKNOWN]
        out[lang] = good or texts
    return out


@lru_cache(maxsize=4)
def _compressors(model: tuple[tuple[str, bytes], ...]):
    out = []
    for lang, body in model:
        d = zstandard.ZstdCompressionDict(body, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        out.append((lang, zstandard.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False,
                                                   write_dict_id=False)))
    return out


remembers(__name__, _compressors.cache_clear)


def predict(text: str | None, model: tuple[tuple[str, bytes], ...]) -> tuple[str, float]:
    """(language, margin): the smallest compressed size; ``und`` without a letter.

    A tie has margin 0 and the first name, which says nothing.
    """
    if not text or not model:
        return UNKNOWN, 0.0
    body = plain(text)
    if not any(c in body for c in _LETTERS) and not any(c.isalpha() for c in text):
        return UNKNOWN, 0.0
    if 0 < len(body) < SHORT_BYTES:
        body = b" " + b" ".join([body] * max(COPIES, -(-SHORT_BYTES // len(body)))) + b" "
    cut = [body[i:i + BLOCK_BYTES] for i in range(0, len(body), BLOCK_BYTES)] or [b""]
    sizes = [(sum(len(c.compress(b)) for b in cut), lang) for lang, c in _compressors(model)]
    sizes.sort()
    if len(sizes) == 1:
        return sizes[0][1], 1.0
    return sizes[0][1], (sizes[1][0] - sizes[0][0]) / sizes[1][0]


def identify(docs: DataFrame, model: dict[str, bytes], text_col: str = "text", columns: list[str] | None = None,
             min_margin: float = MIN_MARGIN, name: str = "lang_result") -> DataFrame:
    """``columns`` of ``docs`` (default all) with a struct ``name`` (renamed if taken) of lang_pred, score, accepted.

    Null text and text without a letter: ``und``, score 0, not accepted.  Only
    the text is looked at; repeated rows get the same answer.  With no learned
    language everything is ``und``; with more than ``LANGUAGES`` in the table,
    those with the fewest documents are never answered.
    """
    columns = columns or docs.columns
    known = tuple(sorted(model.items()))
    a, b = fresh(docs.columns, "lang_pred", "lang_score")

    def fn(text):
        got = [predict(t, known) for t in text.to_pylist()]
        return [pa.array([g[0] for g in got], pa.string()), pa.array(np.array([g[1] for g in got], np.float64))]

    out = map_text(docs, text_col, columns, [T.StructField(a, T.StringType()), T.StructField(b, T.DoubleType())], fn)
    name, = fresh(columns, name)
    return out.select(*[F.col(f"`{c}`") for c in columns], F.struct(
        F.col(a).alias("lang_pred"), F.col(b).alias("score"),
        ((F.col(a) != UNKNOWN) & (F.col(b) >= min_margin)).alias("accepted")).alias(name))


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
               min_margin: float = MIN_MARGIN) -> DataFrame:
    """The rows of ``docs`` whose language is told with the margin asked for."""
    out = identify(docs, learn(docs, id_col, text_col, lang_col), text_col, min_margin=min_margin)
    return out.where(F.col(out.columns[-1])["accepted"]).drop(out.columns[-1])


def accuracy(predicted: list[str], truth: list[str]) -> float:
    return float(pc.mean(pc.cast(pc.equal(pa.array(predicted), pa.array(truth)), pa.float64())).as_py() or 0.0)

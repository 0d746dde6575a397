"""Personal data in plain and in disguise, with spans of the source text.

Plain identifiers are read from the text as it stands (``base_spans``).  For
disguised ones three transducers rewrite the text one after another:

1. characters: homoglyphs, full-width and other compatibility forms, digits of
   other scripts, dashes, blanks and numeric character references become ASCII;
   invisible characters go;
2. spelled digits: runs of two or more digit words of four languages become
   digits, ``plus`` before them a sign, ``double`` and ``triple`` repeat;
3. ``at`` and ``dot``: in brackets, or as words where an address or a dotted
   number stands around them.

Each keeps its edits as sorted intervals (output, input), never a position per
character, and maps a span of its output back to its input.  The same rules
read the last output; a span that holds an edit, mapped through the three, is
added to the plain ones.

What costs time runs only where a text can need it: byte counts of the whole
Arrow slice (signs, digits, lead bytes, trigger words by hash) say which rules
a row needs.  All rules are linear in the length of the text.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.llm.common import fresh, map_text, text_buffer
from rivulet.llm.terms import LETTERS, term_runs
from rivulet.llm.text import LOWER, per_row, prefix_hash, span_hash

KINDS = ("email", "ip", "card", "phone")

# ---- plain identifiers ---------------------------------------------------------

_LOCAL = "A-Za-z0-9._%+-"
_LOCAL_TAIL = re.compile(f"[{_LOCAL}]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")  # a match always starts and ends at a run of digits
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def _emails(text: str):
    """The text before an @ cannot hold another @, so each @ has at most one match and needs one look."""
    done = 0
    at = text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at + 1)
        start = at
        while start > done and _LOCAL_TAIL.match(text[start - 1]):
            start -= 1
        if m and start < at:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and (not part or int(part) <= 255)


def base_spans(text: str, kinds=KINDS) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the plain identifiers of ``kinds``, sorted."""
    out = []
    if "email" in kinds:
        out += [(s, 0, e) for s, e in _emails(text)]
    if "ip" in kinds:
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(_small(p) for p in m.groups())]
    if "card" in kinds:
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                d = re.sub("[^0-9]", "", m.group())
                if 14 <= len(d) <= 19 and _luhn(d):
                    out.append((m.start(), 2, m.end()))
    if "phone" in kinds:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out)


# ---- transducers ---------------------------------------------------------------

# Letters that look like ASCII ones (Cyrillic, Greek, Latin small forms).
LOOKALIKES = dict(zip(
    "АВЕЅІЈКМНОРСТУХЗавеѕіјкмнорстухһԁԛԝѵɡɩ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαιονρυϲ",
    "ABESIJKMHOPCTYX3abesijkmhopctyxhdqwvgi" "ABEZHIKMNOPTYXaiovpuc"))
# Signs and blanks.
LOOKALIKES |= dict.fromkeys("‐‑‒–—―−﹣", "-") | dict.fromkeys("․。｡﹒", ".") | {"﹫": "@", "﹢": "+", "　": " ", "\xa0": " ", " ": " "}
LOOKALIKES |= dict.fromkeys(map(chr, range(0x2000, 0x200B)), " ")
# Invisible characters.
INVISIBLE = "\xad͏؜᠎​‌‍‎‏⁠⁡⁢⁣⁤﻿"
# Letters that stand for digits inside a number.
DIGIT_LETTERS = {"O": "0", "o": "0", "I": "1", "l": "1"}
# Digit words, in the order of the digits.
DIGIT_WORDS = ["zero oh null zéro cero", "one eins un uno", "two zwei zwo deux dos", "three drei trois tres", "four vier quatre cuatro",
               "five fünf fuenf cinq cinco", "six sechs seis", "seven sieben sept siete", "eight acht huit ocho", "nine neun neuf nueve"]
REPEATS = {"double": 2, "triple": 3}
PLUS_WORDS = "plus más"
AT_WORDS = "at ät arroba arobase klammeraffe chez bei"
DOT_WORDS = "dot punto point punkt"
# Last labels that make a domain of words credible.
ENDINGS = set("com org net edu gov mil int info biz name io ai app dev co me tv uk us ca au de fr es it nl be ch at eu pl se no dk fi ie pt br mx ar jp cn in ru za nz".split())

DIGIT = {w: str(d) for d, ws in enumerate(DIGIT_WORDS) for w in ws.split()}


def _any(words) -> str:
    return "|".join(sorted(words, key=len, reverse=True))


_NO_LETTER_BEFORE, _NO_LETTER_AFTER = r"(?<![^\W\d_])", r"(?![^\W\d_])"
_DIGIT_WORD = rf"{_NO_LETTER_BEFORE}(?:(?:{_any(REPEATS)})[ -])?(?:{_any(DIGIT)}){_NO_LETTER_AFTER}"
_GAP = rf"(?:[ \t]{{1,3}}(?:{_any(DOT_WORDS.split())})[ \t]{{1,3}}|[ \t\r\n,()]{{1,3}}(?:-[ ]?)?|-|\.)"
_SPELLED = re.compile(rf"(?:{_NO_LETTER_BEFORE}(?:{_any(PLUS_WORDS.split())})[ \t\r\n(-]{{1,3}})?(?:{_DIGIT_WORD}|[0-9]+)(?:{_GAP}(?:{_DIGIT_WORD}|[0-9]+))+", re.I)
_PIECE = re.compile(rf"(?P<plus>(?:{_any(PLUS_WORDS.split())})[ \t\r\n(-]{{1,3}})|(?P<word>{_DIGIT_WORD})|(?P<number>[0-9]+)|(?P<gap>{_GAP})", re.I)
_HIDDEN_DOT = rf"(?:[ \t]{{0,3}}[\[({{<][ \t]{{0,3}}(?:{_any(DOT_WORDS.split())}|\.)[ \t]{{0,3}}[\])}}>][ \t]{{0,3}}|[ \t]{{1,3}}(?:{_any(DOT_WORDS.split())}|\.)[ \t]{{1,3}}|[_*](?:{_any(DOT_WORDS.split())})[_*])"
_DIGIT_DOT = re.compile(rf"(?<=[0-9]){_HIDDEN_DOT}(?=[0-9])", re.I)
_AT = re.compile(rf"(?P<letter>[\[({{]a[\])}}](?=[A-Za-z0-9]))|(?P<bracket>[ \t]{{0,3}}[\[({{<][ \t]{{0,3}}(?:{_any(AT_WORDS.split())}|@)[ \t]{{0,3}}[\])}}>][ \t]{{0,3}})"
                 rf"|(?P<word>(?:[ \t]{{1,3}}|[_*-])(?:{_any(AT_WORDS.split())})(?:[ \t]{{1,3}}|[_*-]))|(?P<sign>[ \t]{{0,3}}@[ \t]{{0,3}})", re.I)
_MIXED = re.compile(rf"{_NO_LETTER_BEFORE}(?=[OoIl]*[0-9])(?=[0-9]*[OoIl])[0-9OoIl]+{_NO_LETTER_AFTER}")
_REFERENCE = re.compile(r"&(?:#0*([0-9]{2,3})|#[xX]0*([0-9a-fA-F]{2})|(commat|period|plus));")
_LABEL = re.compile(r"[A-Za-z0-9-]+")
_ANY_DOT = re.compile(rf"\.|{_HIDDEN_DOT}", re.I)
_DOT_BEFORE = re.compile(rf"(?P<dot>{_HIDDEN_DOT})\Z", re.I)


@lru_cache(1)
def _odd_characters() -> re.Pattern:
    """Every character that the first transducer may change."""
    wide = r"！-～℀-⅏①-⓿　-〿﹐-﹯\U0001d400-\U0001d7ff"
    digits = "".join(f"\\U{c:08x}-\\U{c + 9:08x}" for c in range(0x80, 0x20000) if unicodedata.decimal(chr(c), None) == 0)
    return re.compile("[" + wide + digits + "".join(f"\\U{ord(c):08x}" for c in (*LOOKALIKES, *INVISIBLE)) + "]")


@lru_cache(4096)
def _plain(c: str) -> str:
    if c in INVISIBLE:
        return ""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    d = unicodedata.decimal(c, None)
    same = str(d) if d is not None else unicodedata.normalize("NFKC", c)
    return same if len(same) == 1 and same.isascii() else c


class Rewrite:
    """A text after edits [(start, end, replacement)], sorted and apart, and the way back for spans."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]):
        out, at, shift = [], 0, 0
        self.first, self.last, self.start, self.end = [], [], [], []  # output and input intervals of the edits
        for s, e, new in edits:
            out += [text[at:s], new]
            self.first.append(s + shift)
            shift += len(new) - (e - s)
            self.last.append(e + shift)
            self.start.append(s)
            self.end.append(e)
            at = e
        self.text = "".join([*out, text[at:]]) if edits else text

    def back(self, span: tuple[int, int]) -> tuple[int, int]:
        s, e = span
        i, j = bisect_right(self.first, s) - 1, bisect_right(self.first, e - 1) - 1
        s = s if i < 0 else self.start[i] if s < self.last[i] else s + self.end[i] - self.last[i]
        e = e if j < 0 else self.end[j] if e <= self.last[j] else e + self.end[j] - self.last[j]
        return s, e

    def spelled(self, s: int, e: int) -> int:
        """How many edits that wrote something lie inside an output span."""
        i, j = bisect_left(self.first, s), bisect_right(self.last, e)
        return sum(a < b for a, b in zip(self.first[i:j], self.last[i:j]))

    def touches(self, span: tuple[int, int]) -> bool:
        i = bisect_left(self.last, span[0])
        while i < len(self.first) and self.first[i] < span[1]:
            if self.last[i] > span[0]:
                return True
            i += 1
        return False


def plain_characters(text: str) -> Rewrite:
    edits = [(m.start(), m.end(), c) for m in _REFERENCE.finditer(text) if (c := _referred(m))]
    edits += [(m.start() + i, m.start() + i + 1, DIGIT_LETTERS[c]) for m in _MIXED.finditer(text) for i, c in enumerate(m.group()) if c in DIGIT_LETTERS]
    if not text.isascii():
        edits += [(m.start(), m.end(), new) for m in _odd_characters().finditer(text) if (new := _plain(m.group())) != m.group()]
    apart, at = [], 0
    for e in sorted(edits):
        if e[0] >= at:
            apart.append(e)
            at = e[1]
    return Rewrite(text, apart)


def _referred(m: re.Match) -> str | None:
    """The printable ASCII character that a reference stands for."""
    code = {"commat": 64, "period": 46, "plus": 43}[m[3]] if m[3] else int(m[1]) if m[1] else int(m[2], 16)
    return chr(code) if 0x20 <= code < 0x7F else None


def plain_digits(text: str) -> Rewrite:
    edits = []
    for run in _SPELLED.finditer(text):
        pieces = list(_PIECE.finditer(text, run.start(), run.end()))
        if sum(p.lastgroup == "word" for p in pieces) < 2:
            continue
        for i, p in enumerate(pieces):
            if p.lastgroup == "plus":
                edits.append((p.start(), p.end(), "+"))
            elif p.lastgroup == "word":
                *again, word = re.split("[ -]", p.group().lower())
                edits.append((p.start(), p.end(), DIGIT[word] * (REPEATS[again[0]] if again else 1)))
            elif p.lastgroup == "gap" and re.fullmatch(r"[ \t\r\n,()-]+", p.group()) and "word" in (pieces[i - 1].lastgroup, pieces[i + 1].lastgroup):
                edits.append((p.start(), p.end(), ""))
    return Rewrite(text, edits)


def _address(text: str, m: re.Match, floor: int) -> list[tuple[int, int, str]]:
    """The edits that make an address of the text around the ``at`` match, none if it is none."""
    edits = []
    start = pos = m.start()
    hidden = 0
    while True:  # to the left: atoms and hidden dots
        while pos > floor and _LOCAL_TAIL.match(text[pos - 1]):
            pos -= 1
        if pos == start:
            break
        start = pos
        dot = _DOT_BEFORE.search(text, max(floor, pos - 24), pos)
        if not dot or dot.start() <= floor or not _LOCAL_TAIL.match(text[dot.start() - 1]):
            break
        edits.append((dot.start(), dot.end(), "."))
        hidden += 1
        start = pos = dot.start()
    if start == m.start():
        return []
    local = text[start:m.start()]
    label = _LABEL.match(text, m.end())
    dots, worded, last = 0, 0, ""
    while label:
        last = label.group()
        dot = _ANY_DOT.match(text, label.end())
        label = _LABEL.match(text, dot.end()) if dot else None
        if label:
            dots += 1
            if dot.group() != ".":
                if dot.group().strip(" \t").isalpha() and label.group().lower() not in ENDINGS and not _ANY_DOT.match(text, label.end()):
                    label = None  # words after the address
                    dots -= 1
                    continue
                edits.append((dot.start(), dot.end(), "."))
                worded += 1
    if not dots:
        return []
    if m.lastgroup == "sign" and not (hidden or worded or m.group() != "@"):
        return []  # a plain one
    if m.lastgroup in ("word", "letter") or m.lastgroup == "sign" and m.group() != "@":
        telling = m.lastgroup == "letter" or worded or hidden or re.search(r"[0-9._%+]", local.strip(".")) or m.group()[0] in "_*-"
        if last.lower() not in ENDINGS or not telling:
            return []  # "see the page at example.com"
    return sorted([*edits, (m.start(), m.end(), "@")])


def plain_signs(text: str) -> Rewrite:
    edits = [(m.start(), m.end(), ".") for m in _DIGIT_DOT.finditer(text)]
    floor = 0
    for m in _AT.finditer(text):
        if m.start() >= floor:
            found = _address(text, m, floor)
            edits += found
            floor = max([m.end(), *(e for _, e, _ in found)])  # an address holds one sign
    out, at = [], 0
    for e in sorted(set(edits)):
        if e[0] >= at:
            out.append(e)
            at = e[1]
    return Rewrite(text, out)


def disguised_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), in the source, of the identifiers that appear once the text is rewritten."""
    steps = []
    for step in (plain_characters, plain_digits, plain_signs):
        steps.append(step(steps[-1].text if steps else text))
    last = steps[-1].text
    if not any(s.first for s in steps):
        return []
    found = base_spans(last)
    words = steps[1]
    for m in _CARD.finditer(last):  # ten and more spelled digits without a sign
        if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15 and not any(k > 1 and s < m.end() and e > m.start() for s, k, e in found):
            span = steps[2].back(m.span())
            if words.spelled(*span) >= 10:
                found.append((m.start(), 3, m.end()))
    out = []
    for s, k, e in found:
        span, touched = (s, e), False
        for step in reversed(steps):
            touched = touched or step.touches(span)
            span = step.back(span)
        if touched:
            out.append((span[0], k, span[1]))
    return sorted(set(out))


# ---- tables --------------------------------------------------------------------

SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                                 T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


@lru_cache(1)
def _triggers() -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the words that let the second (1) and third (2) transducer act, and which."""
    words = {**dict.fromkeys(DIGIT, 1), **dict.fromkeys(AT_WORDS.split() + DOT_WORDS.split(), 2)}
    words |= {"".join(c if c.isascii() else c.upper() for c in w): k for w, k in words.items()}  # only A-Z are lower-cased in bytes
    data = np.frombuffer("".join(words).encode(), np.uint8)
    to = np.cumsum([len(w.encode()) for w in words])
    h = span_hash(prefix_hash(data), np.concatenate(([0], to[:-1])), to)
    order = np.argsort(h)
    return h[order], np.array(list(words.values()))[order]


def _before(data: np.ndarray, two: bytes) -> np.ndarray:
    """Where the two bytes start."""
    out = np.zeros(len(data), bool)
    out[:-1] = (data[:-1] == two[0]) & (data[1:] == two[1])
    return out


def needs(text: pa.Array) -> dict[str, np.ndarray]:
    """Which rules each row can need, from counts over the bytes of the whole slice."""
    data, off = text_buffer(text)
    digit = (data >= 0x30) & (data <= 0x39)
    dotted = np.zeros(len(data), bool)
    if len(data) > 2:
        dotted[1:-1] = digit[:-2] & (data[1:-1] == 0x2E) & digit[2:]
    lead = (data >= 0xC2) & (data != 0xC3)  # Latin letters of 0xC3 are never changed
    low = LOWER[data]
    starts, ends, _ = term_runs(data, off, LETTERS)
    h = span_hash(prefix_hash(low), starts, ends)
    known, kind = _triggers()
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    hit = known[at] == h
    spelled, sign = np.zeros(len(data), bool), np.zeros(len(data), bool)
    spelled[starts[hit & (kind[at] == 1)]] = True
    sign[starts[hit & (kind[at] == 2)]] = True
    at_sign = per_row(data == 0x40, off)
    letter = np.isin(data, np.frombuffer(b"OoIl", np.uint8))
    mixed = np.zeros(len(data), bool)
    mixed[1:] = digit[:-1] & letter[1:] | letter[:-1] & digit[1:]
    return {"email": at_sign > 0, "ip": per_row(dotted, off) >= 3, "card": per_row(digit, off) >= 14,
            "phone": (per_row(data == 0x2B, off) > 0) & (per_row(digit, off) >= 10),
            "hidden": (per_row(lead | mixed, off) > 0) | (per_row(spelled, off) > 1) | (per_row(sign, off) > 0) | (at_sign > 0)
                      | (per_row((data == 0x5B) | (data == 0x28), off) > 0) & (per_row(digit, off) >= 4) | (per_row(_before(data, b"&#") | _before(data, b"&c") | _before(data, b"&p"), off) > 0)
                      | (per_row(_before(low, b"a)") | _before(low, b"a]") | _before(low, b"a}"), off) > 0)}


def _spans(text: pa.Array) -> pa.Array:
    need = needs(text)
    some = np.any(list(need.values()), axis=0)
    out = []
    for i in range(len(text)):
        rows = []
        if some[i]:
            t = text[i].as_py()
            base = base_spans(t, [k for k in KINDS if need[k][i]])
            more = set(disguised_spans(t)) - set(base) if need["hidden"][i] else ()
            rows = [{"kind": KINDS[k], "start": s, "end": e, "base": b} for s, k, e, b in
                    sorted([(*x, True) for x in base] + [(*x, False) for x in more])]
        out.append(rows)
    return pa.array(out, _ARROW)


def pii_spans(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, out_col: str = "pii") -> DataFrame:
    """``keep`` columns (default all) and ``out_col``: the identifiers of the whole text as (kind, start, end, base).

    Positions count code points, ends are exclusive; ``base`` marks plain
    identifiers.  Sorted by start, then by kind in the order of ``KINDS``.  Null,
    empty and clean texts: no spans.  Repeated rows and null ids are judged like
    any other; a column named like ``out_col`` must be left out of ``keep``.
    """
    keep = docs.columns if keep is None else keep
    if out_col.lower() in {c.lower() for c in keep}:
        raise ValueError(f"{out_col} is a column of the documents; name another out_col")
    return map_text(docs, text_col, keep, [T.StructField(out_col, SPAN)], lambda text: [_spans(text)])


def masked(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every identifier of the text replaced by its kind in angle brackets.

    Overlapping spans are one, named after the first.  Null text stays null;
    other columns are kept as they are.
    """
    def fn(text):
        out = []
        for i, spans in enumerate(_spans(text).to_pylist()):
            t, parts, at = text[i].as_py(), [], 0
            for s in spans:
                if s["start"] >= at:
                    parts += [t[at:s["start"]], f"<{s['kind']}>"]
                at = max(at, s["end"])
            out.append(t if not spans else "".join([*parts, t[at:]]))
        return [pa.array(out, pa.string())]

    name, = fresh(docs.columns, "masked_text")
    made = map_text(docs, text_col, docs.columns, [T.StructField(name, T.StringType())], fn)
    return made.select(*[F.col(f"`{name}`").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def digest(spans: Column) -> Column:
    """kind:start:end of the spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

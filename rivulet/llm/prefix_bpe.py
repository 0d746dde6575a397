"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a piece the encoding is unique, so one number describes it:
the last token.  A token that ends at a position is that last token exactly
when it may follow the last token of the prefix before it, that is, when the
merges would not have joined across the border.  Appending bytes therefore only
adds entries, and an edit only recomputes those behind it.

Pieces are the matches of the split pattern; a piece that is a token itself is
encoded as that token, as rank-based encoders do.  A worker keeps the encoding
of pieces it has met, up to a bound.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rivulet.llm.common import fresh, longs, map_arrow, map_text, remembers

#: Pieces and token pairs that a worker remembers, at most; the memory is emptied when full.
PIECE_MEMORY = 500_000
CHAR_MEMORY = 24_000_000
PAIR_MEMORY = 400_000

#: Text bytes whose pieces are looked up at once.
TEXT_BYTES = 1 << 19


def read_ranks(path: str) -> bytes:
    """A rank file (base64 token, blank, rank per line), read on the driver and sent to the tasks."""
    with open(path, "rb") as f:
        return f.read()


class Merges:
    """Tokens with their ranks, and the two parts that each token is merged from."""

    def __init__(self, rank_file: bytes):
        self.rank: dict[bytes, int] = {}
        for line in rank_file.splitlines():
            if line.strip():
                token, r = line.split()
                self.rank[base64.b64decode(token)] = int(r)
        self.bytes_of = {r: t for t, r in self.rank.items()}
        self.longest = max(map(len, self.rank), default=1)
        self.parts: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        for r in sorted(self.bytes_of):
            t = self.bytes_of[r]
            if len(t) > 1 and (cut := self._last_merge(t, r)):
                self.parts[r] = cut
                self.joined[cut] = r
        # a token that merging never makes occurs only as a whole piece
        self.usable = {t: r for t, r in self.rank.items() if len(t) == 1 or r in self.parts}
        self.known: dict[tuple[int, int], bool] = {}

    def _last_merge(self, t: bytes, r: int) -> tuple[int, int] | None:
        """The two tokens that merging below rank ``r`` leaves of ``t``, if it leaves two."""
        own = [(a, b) for i in range(1, len(t))
               if (a := self.rank.get(t[:i], r)) < r and (b := self.rank.get(t[i:], r)) < r]
        if len(own) < 2:
            return own[0] if own else None
        left = [t[i:i + 1] for i in range(len(t))]
        while len(left) > 2:
            best, at = r, -1
            for i in range(len(left) - 1):
                x = self.rank.get(left[i] + left[i + 1], r)
                if x < best:
                    best, at = x, i
            if at < 0:
                return None
            left[at:at + 2] = [left[at] + left[at + 1]]
        return self.rank[left[0]], self.rank[left[1]]

    def may_follow(self, a: int, b: int) -> bool:
        """Whether token ``b`` can stand after token ``a``.

        Time runs backwards over the merges that made the two.  Whenever the
        pieces that touch the border form a token that would have been merged
        before they grew further, the border could not have survived.  Of equal
        ranks the left one comes first, which the two limits express.
        """
        x, y, limit, ok = a, b, 1 << 62, True
        while True:
            if self.joined.get((x, y), limit) < limit:
                ok = False
                break
            px, py = self.parts.get(x), self.parts.get(y)
            if px is None and py is None:
                break
            if py is None or (px is not None and x > y):
                limit, x = x, px[1]
            else:
                limit, y = y + 1, py[0]
        if len(self.known) >= PAIR_MEMORY:
            self.known.clear()
        self.known[a, b] = ok
        return ok


class PrefixTable:
    """The last token of every prefix of a byte string that can grow, shrink and be edited."""

    def __init__(self, merges: Merges, data: bytes = b""):
        self.merges, self.data, self.last = merges, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        m, start = self.merges, len(self.data)
        data = self.data = self.data + more
        last, usable, may, known = self.last, m.usable, m.may_follow, m.known
        for end in range(start + 1, len(data) + 1):
            for begin in range(max(0, end - m.longest), end):
                t = usable.get(data[begin:end])
                if t is None:
                    continue
                if begin:
                    a = last[begin - 1]
                    fits = known.get((a, t))
                    if not (may(a, t) if fits is None else fits):
                        continue
                last.append(t)
                break
            else:
                raise ValueError(f"byte {data[end - 1]} has no token")

    def truncate(self, size: int) -> None:
        self.data = self.data[:size]
        del self.last[size:]

    def edit(self, start: int, end: int, new: bytes) -> None:
        """Replace data[start:end]; prefixes before ``start`` are kept as they are."""
        tail = self.data[end:]
        self.truncate(start)
        self.append(new + tail)

    def tokens(self) -> list[int]:
        """The token ids of the whole string."""
        out, at = [], len(self.data)
        while at:
            t = self.last[at - 1]
            out.append(t)
            at -= len(self.merges.bytes_of[t])
        return out[::-1]


class Codec:
    """Encodes and decodes texts: pieces by the pattern, each by its prefix table."""

    def __init__(self, rank_file: bytes, pattern: str):
        self.merges = Merges(rank_file)
        self.split = regex.compile(pattern)
        self.decimal = {r: str(r) for r in self.merges.bytes_of}
        self.known: dict[str, bytes] = {}
        self.held = 0

    def decode(self, ids) -> bytes:
        return b"".join(map(self.merges.bytes_of.__getitem__, ids))

    def _learn(self, pieces: set[str]) -> None:
        """Encode new pieces in sorted order, so that each starts from the prefix it shares with the one before."""
        table = PrefixTable(self.merges)
        for piece in sorted(pieces):
            body = piece.encode()
            whole = self.merges.rank.get(body)
            if whole is not None:
                ids = [whole]
            else:
                same = 0
                for x, y in zip(body, table.data):
                    if x != y:
                        break
                    same += 1
                table.truncate(same)
                table.append(body[same:])
                ids = table.tokens()
            self.known[piece] = array("i", ids).tobytes()
            self.held += len(piece)

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as 32-bit numbers in bytes."""
        cut = [self.split.findall(t) for t in texts]
        met = set().union(*cut)
        new = {p for p in met if p not in self.known}
        if len(self.known) + len(new) > PIECE_MEMORY or self.held > CHAR_MEMORY:
            self.known, self.held, new = {}, 0, met
        self._learn(new)
        get = self.known.__getitem__
        return [b"".join(map(get, c)) for c in cut]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.ids([text])[0], np.int32).tolist()


@lru_cache(maxsize=2)
def codec(rank_file: bytes, pattern: str) -> Codec:
    return Codec(rank_file, pattern)


remembers(__name__, codec.cache_clear)


def encode_texts(docs: DataFrame, rank_path: str, pattern: str, text_col: str = "text",
                 columns: list[str] | None = None, with_ids: bool = True) -> DataFrame:
    """``columns`` of ``docs`` (default all) with n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids.

    A name that ``columns`` already has is prefixed with underscores.  Null
    text is encoded as empty: no ids.  Every row is encoded by itself, so
    repeated rows and null ids need no care.
    """
    columns = columns or docs.columns
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(rank_path))  # one vocabulary file
    names = fresh(columns, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids)
    kinds = [T.LongType(), T.StringType(), T.StringType(), T.ArrayType(T.IntegerType())]

    def fn(text):
        c = codec(ranks.value, pattern)
        count, ids_hash, body_hash = [], [], []
        body = c.ids([t or "" for t in text.to_pylist()])
        for raw in body:
            ids = np.frombuffer(raw, np.int32).tolist()
            count.append(len(ids))
            ids_hash.append(hashlib.sha256(" ".join(map(c.decimal.__getitem__, ids)).encode()).hexdigest())
            body_hash.append(hashlib.sha256(c.decode(ids)).hexdigest())
        out = [longs(count), pa.array(ids_hash, pa.string()), pa.array(body_hash, pa.string())]
        if with_ids:
            off = np.concatenate(([0], np.cumsum(count))).astype(np.int32)
            out.append(pa.ListArray.from_arrays(pa.array(off), pa.array(np.frombuffer(b"".join(body), np.int32))))
        return out

    return map_text(docs, text_col, columns, [T.StructField(a, k) for a, k in zip(names, kinds)], fn, TEXT_BYTES)


def decode_ids(tokens: DataFrame, rank_path: str, ids_col: str = "ids") -> DataFrame:
    """``tokens`` with a column ``decoded`` (binary): the bytes of the ids; null ids give null."""
    ranks = tokens.sparkSession.sparkContext.broadcast(read_ranks(rank_path))
    name, = fresh(tokens.columns, "decoded")
    at, names = tokens.columns.index(ids_col), [*tokens.columns, name]

    def run(batches):
        for b in batches:
            c = codec(ranks.value, ".+")
            got = [None if x is None else c.decode(x) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.binary())], names=names)

    return map_arrow(tokens, run, T.StructType([*tokens.schema.fields, T.StructField(name, T.BinaryType())]))

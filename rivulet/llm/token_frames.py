"""Token-id files: independent zstandard frames with a trailing seek table.

A file holds the ids of its documents as little-endian unsigned 32-bit numbers,
in ascending document order, in frames of bounded size that decompress alone.
Behind the data frames stand two skippable frames: the documents (id and number
of ids, zstandard-compressed) and a seek table in the public seekable format
(compressed size, decompressed size and checksum of each frame: the low 32 bits
of XXH64 of the decompressed bytes).  A reader fetches the tail, finds the
frames of the documents asked for and decompresses only those.

Writing: a range shuffle by id deals whole texts out, each task writes one file
under a name of its own attempt, and the manifest, committed by Spark, names
the files that count; a lost executor leaves at most an unnamed file.
"""

from __future__ import annotations

import itertools
import json
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rivulet.llm.common import longs, map_arrow, remembers, staged, text_slices, work_dir

# Fixed values of the zstandard seekable format.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_SEEK = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

FRAME_BYTES = 1 << 18
#: Text bytes whose words are encoded at once.
TEXT_BYTES = 1 << 20
LEVEL = 1
#: Words whose ids a worker remembers, at most; the memory is emptied when full.
WORD_MEMORY = 1_200_000
CHAR_MEMORY = 24_000_000


#: Signs between a letter or digit and a blank; no apostrophe, which may belong to a contraction.
END_SIGNS = re.compile(r"[.,;:!?](?<=[A-Za-z0-9].)[.,;:!?]*(?![^ \n])")


def _plain(text: str) -> str:
    """A text of the same ids with fewer distinct words: ASCII in lower case, signs at a word's end apart.

    The tokenizer lower-cases too and ends a token between letters and signs.  A
    text with "<" may hold a special token, whose letters count as they are.
    """
    if "<" in text:
        return text
    return END_SIGNS.sub(r" \g<0>", text.lower() if text.isascii() else text)


# The rules of a tokenizer file under which ``_plain`` and encoding by words are right.
WORD_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
WORD_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}


def parts_at_blanks(model: str) -> bool:
    """Whether the tokenizer file has the rules above, with nothing that looks over a blank."""
    m = json.loads(model)
    cut = (m.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    return ((m.get("normalizer") or {}).get("normalizers") == WORD_NORMALIZER and cut[0] == WORD_SPLIT
            and all(s["type"] == "ByteLevel" and not s["add_prefix_space"] and not s["use_regex"] for s in cut[1:])
            and not any(t["lstrip"] or t["rstrip"] for t in m.get("added_tokens") or []) and not m.get("truncation") and not m.get("padding"))


class WordEncoder:
    """Encodes texts with the tokenizers library, each distinct word once.

    Where blanks and line feeds always end a token, and neither normalisation
    nor lower-casing reaches over them (``parts_at_blanks``), the ids of a text
    are those of its words, one after another (tested against whole texts).
    Texts for any other tokenizer are encoded whole.
    """

    def __init__(self, model: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(model)
        self.by_word = parts_at_blanks(model)
        self.known: dict[str, bytes] = {}
        self.held = 0

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit numbers."""
        if not self.by_word:
            return [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        cut = [_plain(t).replace("\n", " ").split(" ") for t in texts]
        met = set().union(*cut)
        new = met.difference(self.known)
        if len(self.known) + len(new) > WORD_MEMORY or self.held > CHAR_MEMORY:
            self.known, self.held, new = {}, 0, met
        new = list(new)
        self.held += sum(map(len, new))
        for at in range(0, len(new), 64):
            self.known.update(self._encode(new[at:at + 64]))
        get = self.known.__getitem__
        return [b"".join(map(get, c)) for c in cut]

    def _encode(self, part: list[str]) -> Iterator[tuple[str, bytes]]:
        """One call for many words, parted again by where each token starts."""
        e = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
        starts = np.cumsum([0, *(len(w) + 1 for w in part)])
        cut = (4 * np.searchsorted(np.fromiter((o[0] for o in e.offsets), np.int64, len(e)), starts)).tolist()
        raw = np.array(e.ids, "<u4").tobytes()
        return zip(part, (raw[a:b] for a, b in zip(cut, cut[1:])))


@lru_cache(maxsize=2)
def encoder(model: str) -> WordEncoder:
    return WordEncoder(model)


remembers(__name__, encoder.cache_clear)


class FrameWriter:
    """Writes documents to a stream; ``close`` writes the document list and the seek table."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES):
        self.out, self.limit = out, frame_bytes
        self.zip = zstandard.ZstdCompressor(level=LEVEL)
        self.open, self.size = [], 0
        self.frames: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int, bool, int]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.size and self.size + len(ids) > self.limit:
            self._frame()
        self.docs.append((doc_id or 0, doc_id is None, len(ids) // 4))
        for at in range(0, len(ids), self.limit):  # a long document takes several frames
            part = ids[at:at + self.limit]
            self.open.append(part)
            self.size += len(part)
            if self.size >= self.limit:
                self._frame()

    def _frame(self) -> None:
        body = b"".join(self.open)
        if body:
            packed = self.zip.compress(body)
            self.out.write(packed)
            self.frames.append((len(packed), len(body), xxhash.xxh64_intdigest(body) & 0xFFFFFFFF))
        self.open, self.size = [], 0

    def close(self) -> None:
        self._frame()
        d = np.array(self.docs, [("id", "<i8"), ("null", "?"), ("n", "<u8")])
        index = self.zip.compress(d.tobytes())
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        self.frames.append((8 + len(index), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
        table = b"".join(struct.pack("<III", *f) for f in self.frames)
        foot = struct.pack("<IBI", len(self.frames), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(table) + len(foot)) + table + foot)


class FrameReader:
    """Random access to a token file (an object with ``read``, ``seek`` and ``size``)."""

    def __init__(self, src):
        self.src = src
        end = src.size()
        n, flag, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEKABLE_MAGIC or not flag & CHECKSUM_FLAG:
            raise ValueError("no seek table")
        self.frames = np.frombuffer(self._at(end - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.at = np.concatenate(([0], np.cumsum(self.frames[:, 0])))
        self.first = np.concatenate(([0], np.cumsum(self.frames[:, 1])))
        index = self._at(int(self.at[n - 1]) + 8, int(self.frames[-1, 0]) - 8)
        docs = np.frombuffer(zstandard.ZstdDecompressor().decompress(index), [("id", "<i8"), ("null", "?"), ("n", "<u8")])
        self.ids, self.null, self.count = docs["id"], docs["null"], docs["n"].astype(np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.count)))
        self.unzip = zstandard.ZstdDecompressor()
        self.opened = 0

    def _at(self, where: int, size: int) -> bytes:
        self.src.seek(where)
        return self.src.read(size)

    def frame(self, k: int) -> bytes:
        """The decompressed bytes of frame ``k``, after its checksum has been compared."""
        size, full, check = (int(x) for x in self.frames[k])
        body = self.unzip.decompress(self._at(int(self.at[k]), size), max_output_size=full)
        self.opened += 1
        if len(body) != full or xxhash.xxh64_intdigest(body) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return body

    def parts(self, doc: int) -> Iterator[bytes]:
        """The bytes of the ``doc``-th document, frame by frame; only its frames are read."""
        a, b = 4 * int(self.start[doc]), 4 * int(self.start[doc + 1])
        k = int(np.searchsorted(self.first, a, "right")) - 1
        while a < b:
            body, base = self._cached(k), int(self.first[k])
            part = body[a - base:b - base]
            yield part
            a, k = a + len(part), k + 1

    def _cached(self, k: int) -> bytes:
        if getattr(self, "_last", (None,))[0] != k:
            self._last = k, self.frame(k)
        return self._last[1]

    def document(self, doc_id: int) -> np.ndarray | None:
        """The ids of the first document with this id, or None."""
        hit = np.flatnonzero((self.ids == doc_id) & ~self.null)
        return np.frombuffer(b"".join(self.parts(int(hit[0]))), "<u4") if len(hit) else None


def _filesystem(uri: str):
    from pyarrow import fs
    uri = re.sub(r"^file:/+", "file:///", uri)
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


def write_token_files(docs: DataFrame, out_dir: str, model_path: str, end_id: int = 2, id_col: str = "doc_id",
                      text_col: str = "text", frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Encode every text, append ``end_id`` and write token files below ``out_dir``, in ascending id order.

    Returns the manifest: part (files in order), path, n_docs, n_tokens.  Null
    text is empty (the end id alone); null ids come first; rows with the same id
    are all written, ordered by the hash of their text.  Other columns are not
    read.  An empty table gives an empty manifest or files without documents.
    """
    with open(model_path, encoding="utf-8") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file
    end = struct.pack("<I", end_id)
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    tie = F.xxhash64("text")
    src = src.repartitionByRange("id", tie).sortWithinPartitions("id", tie)

    def run(batches):
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        task = TaskContext.get()
        enc = encoder(model.value)
        fs, folder = _filesystem(out_dir)
        fs.create_dir(folder, recursive=True)
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.tok.zst"
        with fs.open_output_stream(f"{folder}/{name}", compression=None) as f:
            w = FrameWriter(f, frame_bytes)
            for b in itertools.chain([first], batches):
                for part in text_slices(b, 1, TEXT_BYTES):
                    ids = enc.encode([t or "" for t in part.column(1).to_pylist()])
                    for doc, body in zip(part.column(0).to_pylist(), ids):
                        w.add(doc, body + end)
            w.close()
        yield pa.RecordBatch.from_pydict({"part": [task.partitionId()], "path": [f"{out_dir}/{name}"], "n_docs": [len(w.docs)],
                                          "n_tokens": [sum(d[2] for d in w.docs)]})

    return staged(map_arrow(src, run, "part long, path string, n_docs long, n_tokens long"), "manifest")


def read_token_files(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document, from the files: id, start (ids of all documents before it), n_tokens, ids_crc32."""
    base = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each file
    files = manifest.select("path", "part", F.coalesce(base, F.lit(0)).alias("base"))
    files = files.repartitionByRange(max(1, manifest.count()), "part")  # a task for each file

    def run(batches):
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                fs, name = _filesystem(path)
                with fs.open_input_file(name) as f:
                    r = FrameReader(f)
                    crc = np.zeros(len(r.ids), np.int64)
                    for d in range(len(r.ids)):
                        c = 0
                        for part in r.parts(d):
                            c = zlib.crc32(part, c)
                        crc[d] = c
                for at in range(0, len(crc), 10_000):
                    s = slice(at, at + 10_000)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(r.ids[s], mask=r.null[s]), longs(r.start[:-1][s] + base), longs(r.count[s]), longs(crc[s])],
                        names=[id_col, "start", "n_tokens", "ids_crc32"])

    return map_arrow(files, run, f"`{id_col}` long, start long, n_tokens long, ids_crc32 long")


def read_documents(paths: Iterable[str], wanted: Iterable[int]) -> dict[int, np.ndarray]:
    """The ids of the wanted documents; only frames that hold them are decompressed."""
    out, wanted = {}, set(wanted)
    for p in paths:
        fs, name = _filesystem(p)
        with fs.open_input_file(name) as f:
            r = FrameReader(f)
            for d in wanted.intersection(r.ids[~r.null].tolist()):
                out[d] = r.document(d)
    return out


def token_files(docs: DataFrame, model_path: str, **options) -> DataFrame:
    """Write the token files to the shared folder and read them back (see the two functions)."""
    out_dir = work_dir(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, out_dir, model_path, **options))

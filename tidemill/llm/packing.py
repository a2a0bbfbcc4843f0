"""Packing along a Hilbert curve (operator 9).

A document's words are hashed into a vector, the vector is projected to a few
dimensions, and the point's place on a Hilbert curve is its key. Documents
are range-sorted by (key, doc_id); each range is tokenised in that order and
cut into sequences as one stream, so neighbours on the curve share sequences
and padding arises at the end of a range only, where the rest is cut into
powers of two.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm import textkit as tk

SEQUENCE = 4096
#: The id behind each document.
END = 2
#: Hashed vector size, dimensions and bits a dimension of the curve.
FEATURES, DIMS, BITS = 4096, 4, 12
#: Distinct words whose ids a worker remembers, at most.
CACHE_WORDS = 150_000

def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of integer points (n, dims) with coordinates under 2**bits (Skilling's transform)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) > 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _projection() -> np.ndarray:
    return np.random.default_rng(9).standard_normal((FEATURES, DIMS)).astype(np.float32)


def with_key(docs: DataFrame) -> DataFrame:
    """Add the Hilbert key of each text; texts without words are at the centre of the cube."""
    keep = docs.columns

    def run(batches):
        table = _projection()
        for piece in tk.slices(batches):
            buf, offsets = tk.utf8(piece.column("text"))
            buf = tk.LOWER[buf]
            start, end, rows = tk.words(buf, offsets, tk.NOT_BLANK)
            at = (tk.word_hashes(buf, start, end) >> np.uint64(40)).astype(np.int64) % FEATURES
            mean = tk.segment_sum(table[at], rows) / np.maximum(np.diff(rows), 1)[:, None]
            point = ((np.tanh(4 * mean) + 1) / 2 * ((1 << BITS) - 1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(piece.column(c).combine_chunks() for c in keep), pa.array(hilbert(point))], names=[*keep, "_key"])

    return docs.mapInArrow(run, tk.extended(docs, "_key long"))


#: Words of plain Latin letters with ASCII marks behind: one pre-token each, lower-cased letter by letter, in composed form already.
_PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*)([!-&(-/:-@\[-`{-~]*)")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes themselves, others from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class Ids:
    """Token ids of texts, word by word: no token of this vocabulary crosses a blank.

    The tokenizer's model splits plain words directly; all others pass through
    the whole tokenizer with its normaliser and pre-tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker for each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.known: dict[str, bytes] = {"": b""}
        self.pieces: dict[str, bytes] = {"": b""}

    def _piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            raw = piece if piece.isascii() else "".join([self.letters[b] for b in piece.encode()])
            found = self.pieces[piece] = array("I", [t.id for t in self.model.tokenize(raw)]).tobytes()
        return found

    def _learn(self, words) -> None:
        for w in words:
            plain = _PLAIN.fullmatch(w)
            if plain and "<|" not in w:  # which may begin a special token
                self.known[w] = self._piece(plain[1].lower()) + self._piece(plain[2])
            else:
                self.known[w] = array("I", self.tokenizer.encode(w, add_special_tokens=False).ids).tobytes()

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [(t or "").replace("\n", " ").split(" ") for t in texts]
        if len(self.known) > CACHE_WORDS:
            self.known = {"": b""}
        if len(self.pieces) > CACHE_WORDS:
            self.pieces = {"": b""}
        self._learn({w for ws in split for w in ws} - self.known.keys())
        end, get = array("I", [END]).tobytes(), self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, ws)) + end, "<u4") for ws in split]


@cache
def ids_of(path: str) -> Ids:
    """One for each vocabulary and Python worker."""
    return Ids(path)


_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def _lay(held: list[tuple[int, int, int, np.ndarray]], size: int, first: int):
    """Cut held pieces (doc_id, start, doc_tokens, ids) into sequences of ``size`` numbered from ``first``; the last may be short."""
    seq, at = first, 0
    for doc_id, start, total, ids in held:
        used = 0
        while used < len(ids):
            take = min(size - at, len(ids) - used)
            part = ids[used : used + take]
            yield doc_id, start + used, take, zlib.crc32(part.tobytes()), total, seq, at
            used += take
            at += take
            if at == size:
                seq, at = seq + 1, 0


def pack(docs: DataFrame, path: str, size: int = SEQUENCE) -> DataFrame:
    """Pieces of all rows of docs (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are the end id alone. Each repeated row is packed for
    itself. An empty table gives no pieces; other columns of docs are left out.
    """
    keyed = with_key(docs.select("doc_id", "text"))
    ordered = keyed.repartitionByRange(tk.tasks(docs), "_key", "doc_id").sortWithinPartitions("_key", "doc_id")

    def run(batches):
        ids = ids_of(path)
        seq, held, waiting = TaskContext.get().partitionId() << 32, [], 0
        for piece in tk.slices(batches):
            for doc_id, tokens in zip(piece.column("doc_id").to_pylist(), ids(piece.column("text").to_pylist()), strict=True):
                held.append((doc_id, 0, len(tokens), tokens))
                waiting += len(tokens)
            whole, out, rest, done = waiting // size * size, [], [], 0
            for doc_id, start, total, tokens in held:
                take = min(len(tokens), whole - done)
                if take:
                    out.append((doc_id, start, total, tokens[:take]))
                    done += take
                if take < len(tokens):
                    rest.append((doc_id, start + take, total, tokens[take:]))
            yield _batch(_lay(out, size, seq))
            seq, held, waiting = seq + whole // size, rest, waiting - whole
        while waiting:  # the rest in powers of two, which need no padding
            part = min(1 << (waiting.bit_length() - 1), size)
            out, rest, done = [], [], 0
            for doc_id, start, total, tokens in held:
                take = min(len(tokens), part - done)
                if take:
                    out.append((doc_id, start, total, tokens[:take]))
                    done += take
                if take < len(tokens):
                    rest.append((doc_id, start + take, total, tokens[take:]))
            yield _batch(_lay(out, size, seq))
            seq, held, waiting = seq + 1, rest, waiting - part

    return ordered.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def _batch(rows) -> pa.RecordBatch:
    rows = list(rows)
    columns = zip(*rows, strict=True) if rows else [[]] * len(_PIECES)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PIECES, strict=True)], schema=_PIECES)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_packing(spark, sf_dir: str) -> DataFrame:
    """``pack`` of all documents; a null text is the end id alone."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary())

"""Text helpers shared by the operators: column expressions, and byte-level tokenising of Arrow batches with NumPy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Words of letters and digits after lower-casing A-Z; every character outside ASCII is part of a word. Stated as what a
#: word holds: Java matches a negated class of several ranges about ten times slower.
ALNUM_WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"
#: The same words before lower-casing, for counting.
ANY_CASE_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else. Pure ASCII takes the faster built-in, which is the same there."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


# ---- Arrow batches as byte arrays -------------------------------------------------------------------------------

CHUNK_BYTES = 2 << 20


def _class_table(inside) -> np.ndarray:
    return np.array([inside(b) for b in range(256)], dtype=bool)


#: Bytes of a word: letters and digits after lower-casing (capitals count), or anything outside ASCII.
ALNUM_BYTES = _class_table(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)
#: Bytes of a word between blanks.
NONBLANK_BYTES = _class_table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (splitmix)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FOLDED_VALUE = _BYTE_VALUE.copy()
_FOLDED_VALUE[0x41:0x5B] = _BYTE_VALUE[0x61:0x7B]
_BASE = 0xD6E8FEB86659FD93 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, kept by the worker and extended when a longer text comes."""
    have = len(_POWERS.get("up", ()))
    if have < n:
        size = max(n, CHUNK_BYTES)
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


@dataclass
class Chunk:
    """Consecutive texts of a batch: rows ``first`` .. ``first + len(offsets) - 1``, their bytes and byte offsets."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a string array into pieces of about ``limit`` bytes (a longer text makes its own piece). Null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    n = len(texts)
    if n == 0:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    start = 0
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), n)
        low, high = offsets[start], offsets[end]
        yield Chunk(start, data[low:high], offsets[start : end + 1] - low)
        start = end


@dataclass
class Words:
    """Words of a chunk: byte range of each, and for each row the number of its first word (``len(rows) + 1`` values)."""

    start: np.ndarray
    end: np.ndarray
    row_first: np.ndarray

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.row_first) - 1), np.diff(self.row_first))


def find_words(chunk: Chunk, inside: np.ndarray) -> Words:
    """Maximal runs of word bytes; a run never crosses a row."""
    flags = inside[chunk.data]
    before = np.zeros(len(flags), dtype=bool)
    before[1:] = flags[:-1]
    cuts = chunk.offsets[:-1]
    before[cuts[cuts < len(flags)]] = False
    start = np.flatnonzero(flags & ~before)
    after = np.zeros(len(flags), dtype=bool)
    after[:-1] = flags[1:]
    lasts = chunk.offsets[1:] - 1
    after[lasts[lasts >= 0]] = False
    end = np.flatnonzero(flags & ~after) + 1
    return Words(start, end, np.searchsorted(start, chunk.offsets))


def prefix_hash(chunk: Chunk, fold: bool = True) -> np.ndarray:
    """Prefix sums of a polynomial hash of the bytes (``fold`` reads A-Z as a-z): one entry more than bytes."""
    up, _ = _powers(len(chunk.data) + 1)
    sums = np.zeros(len(chunk.data) + 1, dtype=np.uint64)
    np.cumsum((_FOLDED_VALUE if fold else _BYTE_VALUE)[chunk.data] * up[:-1], out=sums[1:])
    return sums


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range, equal for equal (folded) bytes wherever they stand."""
    _, down = _powers(len(sums))
    return mix64((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def word_hashes(chunk: Chunk, words: Words, fold: bool = True) -> np.ndarray:
    return range_hash(prefix_hash(chunk, fold), words.start, words.end)


def hash_word(word: str) -> int:
    """The hash that ``word_hashes`` gives a word, for small tables made on the driver."""
    chunk = next(chunks(pa.array([word])))
    return int(range_hash(prefix_hash(chunk), np.array([0]), np.array([len(chunk.data)]))[0])


def gram_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` consecutive words (whatever rows they lie in; callers keep those inside a row)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(size):
        out = out * np.uint64(0x9DDFEA08EB382D69) + hashes[j : j + n]
        out ^= out >> np.uint64(29)
    return mix64(out)

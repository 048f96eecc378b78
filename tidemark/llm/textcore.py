"""Vectorised word, line and window hashing over Arrow string batches.

Every scan of the text operators runs in ``mapInArrow``.  A batch is cut into chunks of about
``CHUNK_BYTES`` (a longer document makes a chunk of its own, never a prefix), and each chunk is
handled as one byte array with document offsets, so memory is bounded by the chunk and not by the
batch.  Null texts count as empty.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 19
_U = np.uint64
_Q = _U(0xC2B2AE3D27D4EB4F)
#: Spans longer than this many bytes are hashed one by one with a keyed digest.
LONG = 256
_KEY = hashlib.blake2b(b"tidemark spans", digest_size=32).digest()
_K0, _K1 = (_U(int.from_bytes(_KEY[i : i + 8], "little")) for i in (0, 8))
#: Masks of 0 to 8 low bytes.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)

#: ASCII A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of ``[^\x20\x09-\x0D]``: what is not ASCII white space.
NONSPACE = np.ones(256, bool)
NONSPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]``: digits, a-z and all beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: Bytes of runs of letters: a-z and all beyond ASCII.
LETTERS = np.zeros(256, bool)
LETTERS[0x61:0x7B] = LETTERS[0x80:] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> _U(33))
    h *= _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


#: What the hash of a span of each size begins with.
_SIZES = mix((np.arange(LONG + 1).astype(_U) * _Q) ^ _K0)


class Chunk:
    """Some documents of a batch: their bytes and offsets, and the rows lo to hi they come from."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, lo: int, hi: int):
        self.buf, self.off, self.lo, self.hi = buf, off, lo, hi
        self._words = None

    @property
    def n(self) -> int:
        return self.hi - self.lo

    def lowered(self) -> "Chunk":
        return Chunk(LOWER[self.buf], self.off, self.lo, self.hi)

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs of bytes that are inside; a run ends with its document."""
        inner = self.off[(self.off > 0) & (self.off < len(self.buf))]
        before = np.zeros(len(inside), bool)
        before[1:] = inside[:-1]
        before[inner] = False
        after = np.zeros(len(inside), bool)
        after[:-1] = inside[1:]
        after[inner - 1] = False
        return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1

    def words(self, alphabet: np.ndarray) -> "Words":
        return Words(self, *self.runs(alphabet[self.buf]))

    def eights(self, at: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The next 8 bytes from each position as an integer, of which at most ``left`` count."""
        if self._words is None:
            padded = np.zeros(len(self.buf) + 8, np.uint8)
            padded[: len(self.buf)] = self.buf
            self._words = np.ndarray((len(self.buf) + 1,), "<u8", padded, strides=(1,))
        return self._words[at] & _LOW[np.minimum(left, 8)]

    def forget(self) -> None:
        """Leave out the copy that ``eights`` reads, before the chunk is sent anywhere."""
        self._words = None

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of the bytes of each span, wherever it stands.

        Eight bytes a step go through a keyed bijective finaliser, so that no structure of a text makes
        different spans meet; longer spans have a digest.
        """
        size = ends - starts
        h = mix((_SIZES[np.minimum(size, LONG)] ^ self.eights(starts, size)) + _K1)
        for k in range(8, min(int(size.max(initial=0)), LONG), 8):
            more = np.flatnonzero(size > k)
            h[more] = mix((h[more] ^ self.eights(starts[more] + k, size[more] - k)) + _K1)
        for i in np.flatnonzero(size > LONG).tolist():
            h[i] = int.from_bytes(hashlib.blake2b(self.buf[starts[i] : ends[i]].tobytes(), digest_size=8, key=_KEY).digest(), "little")
        return h

    def heads(self) -> np.ndarray:
        """Byte positions where characters begin."""
        return np.flatnonzero((self.buf & 0xC0) != 0x80)

    def grams(self, n: int, block: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(document, hash) of all runs of n characters within a document, ``block`` of them at a time, so that a long text takes no more memory than others."""
        heads = np.append(self.heads(), len(self.buf))
        for lo in range(0, len(heads) - n, block):
            at, end = heads[lo : min(lo + block, len(heads) - n)], heads[lo + n : lo + n + block]
            doc = np.searchsorted(self.off, at, "right") - 1
            inside = end <= self.off[doc + 1]
            at, end, doc = at[inside], end[inside], doc[inside]
            yield doc, self.hashes(at, end)

    def counts(self, positions: np.ndarray) -> np.ndarray:
        """How many of the sorted byte positions lie in each document."""
        at = np.searchsorted(positions, self.off)
        return np.diff(at)


class Words:
    """The words of a chunk; first and count say which belong to each document."""

    def __init__(self, chunk: Chunk, starts: np.ndarray, ends: np.ndarray):
        self.chunk, self.starts, self.ends = chunk, starts, ends
        at = np.searchsorted(starts, chunk.off)
        self.first, self.count = at[:-1], np.diff(at)
        self.doc = np.repeat(np.arange(chunk.n), self.count)
        self.hash = chunk.hashes(starts, ends)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of each run of ``size`` words within a document."""
        m = len(self.hash) - size + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, _U)
        at = np.flatnonzero(self.doc[:m] == self.doc[size - 1 :])
        acc = self.hash[at]
        for k in range(1, size):
            acc *= _Q
            acc += self.hash[at + k]
        return at, mix(acc + _U(size))

    def short(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(document, hash of its whole word sequence) where there are 1 to ``size`` - 1 words."""
        docs = np.flatnonzero((self.count > 0) & (self.count < size))
        acc = self.hash[self.first[docs]].copy()
        length = self.count[docs]
        for k in range(1, size - 1):
            more = length > k
            acc[more] = acc[more] * _Q + self.hash[self.first[docs[more]] + k]
        return docs, mix(acc + length.astype(_U))

    def text(self, i: int, size: int) -> tuple[bytes, ...]:
        return tuple(bytes(self.chunk.buf[s:e]) for s, e in zip(self.starts[i : i + size], self.ends[i : i + size]))


_since_tidy = 0


def tidy(handled: int, every: int = 16 << 20) -> None:
    """Give freed memory back to the system after each ``every`` bytes of text, so that workers stay small."""
    global _since_tidy
    _since_tidy += handled
    if _since_tidy >= every:
        _since_tidy = 0
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library keeps its own house
            pass


def chunks(texts: pa.Array | pa.ChunkedArray, limit: int = 0) -> Iterator[Chunk]:
    """The rows of a string array in order, in chunks of at most ``limit`` bytes unless one row is longer."""
    limit = limit or CHUNK_BYTES
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    texts = pc.fill_null(texts, "")
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield Chunk(raw[off[lo] : off[hi]], (off[lo : hi + 1] - off[lo]).astype(np.int64), lo, hi)
        lo = hi
    tidy(int(off[n] - off[0]))


def per_doc(values: np.ndarray, first: np.ndarray, count: np.ndarray, dtype=np.int64) -> np.ndarray:
    """Sums of ``values`` over each document's words."""
    sums = np.zeros(len(values) + 1, dtype)
    np.cumsum(values, out=sums[1:], dtype=dtype)
    return sums[first + count] - sums[first]


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values in order, by one sort."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def in_sorted(keys: np.ndarray, h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Positions of h that lie in the sorted keys; ``bits`` (see ``bitmap``) settles most of them."""
    near = np.flatnonzero(bits[(h >> _U(44)).astype(np.int64)])
    if not len(near) or not len(keys):
        return np.zeros(0, np.int64)
    at = np.searchsorted(keys, h[near])
    at[at == len(keys)] = 0
    return near[keys[at] == h[near]]


def bitmap(keys: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << 20, bool)
    bits[(keys >> _U(44)).astype(np.int64)] = True
    return bits

"""Word-shingle sets, their digests and their minwise tokens, over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tidemark.llm.textcore import NONSPACE, chunks, mix

_U = np.uint64
SHINGLE = 5
#: Minwise tokens of a document.
TOKENS = 64
_rng = np.random.default_rng(0x5EED)
_A = _rng.integers(1, 1 << 63, TOKENS, dtype=np.uint64) * _U(2) + _U(1)
_B = _rng.integers(0, 1 << 63, TOKENS, dtype=np.uint64)


def sets(texts: pa.Array, size: int = SHINGLE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For chunks of rows lo to hi: their distinct shingle hashes, sorted in each row, and each row's count.

    A text of 1 to ``size`` - 1 words has its whole word sequence as one shingle; without words it has none.
    """
    for c in chunks(texts):
        w = c.lowered().words(NONSPACE)
        at, h = w.windows(size)
        docs, whole = w.short(size)
        doc, h = np.concatenate([w.doc[at], docs]), np.concatenate([h, whole])
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
        yield c.lo, c.hi, h[new], np.bincount(doc[new], minlength=c.n)


def sketch(h: np.ndarray, n: np.ndarray, minwise: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(digest 1, digest 2, minwise tokens as a row of uint32) of consecutive sets of sizes n; empty sets have zeros."""
    tokens = np.zeros((len(n), TOKENS), np.uint32)
    full = np.flatnonzero(n)
    first = (np.cumsum(n) - n)[full]
    d1, d2 = np.zeros(len(n), _U), np.zeros(len(n), _U)
    if len(full):
        d1[full] = np.add.reduceat(h, first)
        d2[full] = np.add.reduceat(mix(h ^ _U(0xA5A5A5A5A5A5A5A5)), first)
        for k in range(TOKENS if minwise else 0):
            tokens[full, k] = np.minimum.reduceat(((h * _A[k] + _B[k]) >> _U(32)).astype(np.uint32), first)
    return d1, d2, tokens

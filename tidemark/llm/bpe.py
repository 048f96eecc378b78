"""Exact byte-level BPE of whole texts with the tokenizers library, with repeated words encoded once.

The byte-level pre-tokenizer never joins bytes across (a) the start of a white-space run, (b) the
last character of a run that a non-space follows, (c) a non-space after white space other than a
blank, and (d) an ASCII letter or digit and a following sign other than an apostrophe.  A text cut
there encodes to the concatenation of its parts, so each distinct part of up to ``LONGEST`` bytes is
given to the library once per worker and looked up afterwards by its bytes: a hash picks the slot, and
the slot's own copy of the bytes must be equal.  Longer parts are told apart by their bytes within a
chunk.  Texts with white space beyond ASCII or with a special token's string go to the library whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tidemark.llm.textcore import Chunk, chunks, mix

_U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
ALPHA = np.zeros(256, bool)
ALPHA[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
SIGN = np.zeros(256, bool)
SIGN[0x21:0x7F] = ~ALPHA[0x21:0x7F]
SIGN[0x27] = False
#: Lead bytes of the white space beyond ASCII.
LEADS = np.zeros(256, bool)
LEADS[[0xC2, 0xE1, 0xE2, 0xE3]] = True
#: UTF-8 of the white space beyond ASCII (fixed values of the Unicode White_Space property).
WIDE = {
    int.from_bytes(chr(c).encode().ljust(3, b"\0"), "big")
    for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of documents; ``slots`` parts at most are remembered, and none longer than ``LONGEST`` bytes."""

    EIGHTS = 3
    LONGEST = 8 * EIGHTS
    _shared: dict[tuple[str, int], "Encoder"] = {}

    def __init__(self, path: str, slots: int = 1 << 20):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        (self.newline,) = self._ids("\n")
        self.slots = slots
        self._clear()

    @classmethod
    def shared(cls, path: str) -> "Encoder":
        """One encoder a worker process, whose memory of parts serves all its tasks."""
        if (path, os.getpid()) not in cls._shared:
            cls._shared[path, os.getpid()] = cls(path)
        return cls._shared[path, os.getpid()]

    def _clear(self) -> None:
        self.bytes = np.zeros((self.EIGHTS, self.slots), _U)
        self.size = np.zeros(self.slots, np.int8)
        self.at = np.zeros(self.slots, np.int32)
        self.len = np.zeros(self.slots, np.int8)
        self.pool = np.zeros(4 * self.slots, self.dtype)
        self.used = 0

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _encode_parts(self, raw: bytes, chunk: Chunk, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each part); parts without white space but a leading blank share one call."""
        plain = ~SPACE[chunk.buf[ends - 1]]
        size, found = np.zeros(len(starts), np.int64), []
        which = np.flatnonzero(plain)
        for lo in range(0, len(which), 2000):
            some = which[lo : lo + 2000]
            text = b"\n".join([raw[s:e] for s, e in zip(starts[some].tolist(), ends[some].tolist())]) + b"\n"
            ids = np.array(self.tokenizer.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids, self.dtype)
            cut = np.flatnonzero(ids == self.newline)
            assert len(cut) == len(some)
            size[some] = np.diff(cut, prepend=-1) - 1
            found.append(ids[ids != self.newline])
        others = np.flatnonzero(~plain)
        spaced = [np.array(self._ids(raw[starts[i] : ends[i]].decode()), self.dtype) for i in others.tolist()]
        size[others] = [len(x) for x in spaced]
        where = np.cumsum(size) - size
        out = np.zeros(int(size.sum()), self.dtype)
        if found:
            n = size[which]
            out[np.arange(int(n.sum())) + np.repeat(where[which] - (np.cumsum(n) - n), n)] = np.concatenate(found)
        for i, x in zip(others.tolist(), spaced):
            out[where[i] : where[i] + len(x)] = x
        return out, size

    def _distinct(self, raw: bytes, starts: np.ndarray, ends: np.ndarray, h: np.ndarray, eights: np.ndarray, miss: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(parts, which of them each missed part equals), by their bytes: those that a hash puts together are compared."""
        _, first, back = np.unique(h[miss], return_index=True, return_inverse=True)
        one = miss[first]
        head, long = one[back], ends - starts
        sure = (long[miss] <= self.LONGEST) & (long[head] == long[miss]) & (eights[:, head] == eights[:, miss]).all(0)
        rest, more = np.flatnonzero(~sure), {}
        for k, i in zip(rest.tolist(), miss[rest].tolist()):
            back[k] = more.setdefault(raw[starts[i] : ends[i]], (len(one) + len(more), i))[0]
        return np.concatenate([one, np.array([i for _, i in more.values()], np.int64)]), back

    def _wide(self, chunk: Chunk) -> np.ndarray:
        """Which documents hold white space beyond ASCII or a special token."""
        found = np.zeros(chunk.n, bool)
        b = chunk.buf
        lead = np.flatnonzero(LEADS[b])
        if len(lead):
            nxt = np.zeros(len(b) + 2, np.int64)
            nxt[: len(b)] = b
            code = (nxt[lead] << 16) | (nxt[lead + 1] << 8)
            code |= np.where(nxt[lead] == 0xC2, 0, nxt[lead + 2])
            bad = lead[np.isin(code, np.array(sorted(WIDE)))]
            found[np.searchsorted(chunk.off, bad, "right") - 1] = True
        raw = b.tobytes()
        for s in self.special:
            p = raw.find(s)
            while p >= 0:
                found[np.searchsorted(chunk.off, p, "right") - 1] = True
                p = raw.find(s, p + 1)
        return found

    def encode_chunk(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents one after another, number of ids of each)."""
        b, off = chunk.buf, chunk.off
        if not len(b):
            return np.zeros(0, self.dtype), np.zeros(chunk.n, np.int64)
        sp = SPACE[b]
        inner = off[(off > 0) & (off < len(b))]
        before, after, blank = np.zeros(len(b), bool), np.zeros(len(b), bool), np.zeros(len(b), bool)
        before[1:] = sp[:-1]
        before[inner] = False
        after[:-1] = sp[1:]
        last = np.zeros(len(b), bool)
        last[inner - 1] = last[-1] = True
        after[last] = True
        blank[1:] = b[:-1] == 0x20
        start = np.where(sp, ~before | ~after, before & ~blank)
        start[1:] |= SIGN[b[1:]] & ALPHA[b[:-1]]
        start[0] = start[inner] = True
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], len(b))
        long = ends - starts
        eights = np.zeros((self.EIGHTS, len(starts)), _U)
        h = long.astype(_U)
        for k in range(self.EIGHTS):
            more = np.flatnonzero(long > 8 * k)
            eights[k, more] = chunk.eights(starts[more] + 8 * k, long[more] - 8 * k)
            h[more] = mix(h[more] ^ eights[k, more])
        slot = (h & _U(self.slots - 1)).astype(np.int64)
        same = self.size[slot] == np.minimum(long, 127)
        for k in range(self.EIGHTS):
            same &= self.bytes[k, slot] == eights[k]
        at, size = self.at[slot].astype(np.int64), self.len[slot].astype(np.int64)
        miss = np.flatnonzero(~same)
        pool = self.pool
        if len(miss):
            raw = b.tobytes()
            one, back = self._distinct(raw, starts, ends, h, eights, miss)
            ids, n = self._encode_parts(raw, chunk, starts[one], ends[one])
            where = np.cumsum(n) - n
            # a part has no more ids than bytes, so what is remembered fits the small columns
            keep = np.flatnonzero(long[one] <= self.LONGEST)
            pool = np.concatenate([self.pool[: self.used], ids])
            at[miss], size[miss] = (where + self.used)[back], n[back]
            if self.used + len(ids) > len(self.pool):
                self._clear()
            else:
                self.pool[self.used : self.used + len(ids)] = ids
                s, o = slot[one[keep]], one[keep]
                self.bytes[:, s], self.size[s], self.at[s], self.len[s] = eights[:, o], long[o], where[keep] + self.used, n[keep]
                self.used += len(ids)
        total = int(size.sum())
        where = np.cumsum(size) - size
        ids = pool[np.arange(total) + np.repeat(at - where, size)]
        docs = np.searchsorted(starts, off)
        sums = np.append(where, total)
        bounds = sums[docs]
        wide = np.flatnonzero(self._wide(chunk))
        if not len(wide):
            return ids, np.diff(bounds)
        parts, raw = [ids[x:y] for x, y in zip(bounds[:-1], bounds[1:])], b.tobytes()
        for i in wide.tolist():
            parts[i] = np.array(self._ids(raw[off[i] : off[i + 1]].decode()), self.dtype)
        return np.concatenate(parts), np.array([len(p) for p in parts])

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text in order; nulls are empty."""
        for chunk in chunks(texts):
            ids, n = self.encode_chunk(chunk)
            ends = np.cumsum(n)
            for s, e in zip((ends - n).tolist(), ends.tolist()):
                yield ids[s:e]

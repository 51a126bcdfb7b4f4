"""Texts as sequences of chunks that tokenise independently.

A chunk is a run of white space with the run of other characters after it;
neither byte-level BPE with a word pattern nor a lattice whose pieces hold
spaces only in front ever joins characters across such a border. Each
different chunk is worked out once per Python worker and kept in a bounded
store under a 64-bit hash (with C chunks kept, the chance that one lookup
meets another chunk's hash is C / 2**64).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash

from .wordhash import U, mix, string_buffers, words

#: \x1c-\x1f are white space to Python's str but not to Unicode.
_CHUNK = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")
_SPACES = re.compile(r" +[^ ]*|[^ ]+")
_ONLY_SPACE = np.zeros(256, bool)
_ONLY_SPACE[32] = True
_BARE, _ODD = U(0x5851F42D4C957F2D), U(0x14057B7EF767814F)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of consecutive runs that begin at ``starts``."""
    total = int(lengths.sum())
    out = np.ones(total, np.int64)
    if total:
        keep = lengths > 0
        s, n = starts[keep], lengths[keep]
        ends = np.cumsum(n)
        out[0] = s[0]
        out[ends[:-1]] = s[1:] - (s[:-1] + n[:-1] - 1)
        np.cumsum(out, out=out)
    return out


class Store:
    """Hash -> number, for ``limit`` chunks at a time.

    ``learn(strings)`` works out new chunks and appends their values to the
    subclass's arrays; ``clear()`` empties them, also when ``crowded()``.
    """

    limit = 2_000_000

    def crowded(self) -> bool:
        return False

    def __init__(self):
        self.keys, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def numbers(self, keys: np.ndarray, strings) -> np.ndarray:
        """Numbers of different ``keys``; ``strings(k)``: the chunks of keys[k]."""
        place = np.searchsorted(self.keys, keys)
        have = np.zeros(len(keys), bool)
        inside = place < len(self.keys)
        have[inside] = self.keys[place[inside]] == keys[inside]
        new = np.flatnonzero(~have)
        if len(new) and len(self.keys) and (len(self.keys) + len(new) > self.limit or self.crowded()):
            Store.__init__(self)
            self.clear()
            have[:] = False
            new = np.arange(len(keys))
        out = np.zeros(len(keys), np.int64)
        out[have] = self.at[place[have]] if have.any() else 0
        if len(new):
            base = len(self.keys)
            self.learn(strings(new))
            out[new] = base + np.arange(len(new))
            where = np.searchsorted(self.keys, keys[new])
            order = np.argsort(keys[new], kind="stable")
            self.keys = np.insert(self.keys, where[order], keys[new][order])
            self.at = np.insert(self.at, where[order], out[new][order])
        return out


def _ends_white(buf: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether the bytes before each end are white space other than a space."""
    a = buf[ends - 1]
    b = buf[np.maximum(ends - 2, 0)]
    c = buf[np.maximum(ends - 3, 0)]
    out = ((a >= 9) & (a <= 13)) | ((a >= 28) & (a <= 31)) | ((b == 0xC2) & ((a == 0x85) | (a == 0xA0)))
    out |= (c == 0xE1) & (b == 0x9A) & (a == 0x80)
    out |= (c == 0xE2) & (b == 0x80) & ((a <= 0x8A) | (a == 0xA8) | (a == 0xA9) | (a == 0xAF))
    return out | ((c == 0xE2) & (b == 0x81) & (a == 0x9F)) | ((c == 0xE3) & (b == 0x80) & (a == 0x80))


def numbered(col: pa.Array, store: Store, first_space: bool, only_spaces: bool):
    """(number of each chunk in order, chunks per text).

    Fast path: a chunk is a space and the run of other bytes after it.
    ``first_space``: a text's first chunk gets a space, too. Texts with a
    space that does not begin a chunk (runs of spaces, a space at either end
    or after other white space) are cut by pattern. ``only_spaces``: other
    white space does not matter.
    """
    h, index, counts, s, e, buf = words(col, lower=False, keep_bytes=True, space=_ONLY_SPACE)
    n = len(counts)
    size = np.diff(string_buffers(col)[1])
    spaces = size - np.bincount(index, e - s, n).astype(np.int64)
    odd = spaces != np.maximum(counts - 1, 0)
    heads = np.zeros(len(h), bool)
    heads[(np.cumsum(counts) - counts)[counts > 0]] = True
    if not only_spaces and len(h):
        last = np.zeros(len(h), bool)
        last[(np.cumsum(counts) - 1)[counts > 0]] = True
        odd |= np.bincount(index, _ends_white(buf, e) & ~last, n) > 0
    bare = heads & (not first_space)
    key = np.where(bare, mix(h ^ _BARE), h)
    use = ~odd[index]
    at = np.flatnonzero(use)
    odd_chunks = []
    for k in np.flatnonzero(odd):
        text = col[int(k)].as_py()
        odd_chunks.append((_SPACES if only_spaces else _CHUNK).findall(" " + text if first_space else text))
    flat = [c for x in odd_chunks for c in x]
    odd_keys = np.fromiter((xxhash.xxh64_intdigest(c.encode()) for c in flat), np.uint64, len(flat)) ^ _ODD
    every = np.concatenate([key[at], odd_keys])
    names, first, inverse = np.unique(every, return_index=True, return_inverse=True)

    def strings(which):
        out = []
        raw = buf.tobytes() if len(which) else b""
        for k in first[which].tolist():
            if k < len(at):
                w = at[k]
                out.append(("" if bare[w] else " ") + raw[s[w]:e[w]].decode())
            else:
                out.append(flat[k - len(at)])
        return out

    got = store.numbers(names, strings)[inverse]
    if not flat and not odd.any():
        return got, counts
    chunks = counts.copy()
    chunks[odd] = [len(x) for x in odd_chunks]
    owner = np.concatenate([index[at], np.repeat(np.flatnonzero(odd), chunks[odd])])
    return got[np.argsort(owner, kind="stable")], chunks

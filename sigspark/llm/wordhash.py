"""Words of whole texts as 64-bit hashes, vectorised over an Arrow batch.

Used inside ``mapInArrow`` tasks. A word is a maximal run of bytes outside
space and \\t..\\r; its hash is a polynomial over random byte values modulo
2**64, finished by a mixer, so that equal words have equal hashes in every
task. With V distinct words the chance of any collision is about V**2/2**65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_P = U(0x9E3779B97F4A7C15 | 1)
_PINV = U(pow(int(_P), -1, 1 << 64))
#: Bytes that are hashed at once; longer texts are cut at white space.
SEGMENT = 1 << 20

_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finisher."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _POWERS.get("n", 0) < n:
        size = max(n, SEGMENT + 4096)
        for name, base in (("p", _P), ("q", _PINV)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _POWERS[name] = np.multiply.accumulate(a)
        _POWERS["n"] = size
    return _POWERS["p"], _POWERS["q"]


def string_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; null counts as empty."""
    col = col.fill_null("") if col.null_count else col
    col = col.cast(pa.large_string())
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64, n + 1, col.offset * 8)
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0]:off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = SEGMENT) -> Iterator[pa.RecordBatch]:
    """Row ranges of about ``limit`` text bytes, one row at least."""
    if batch.num_rows == 0:
        return
    _, off = string_buffers(batch.column(text))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def _segments(buf: np.ndarray, breaks: np.ndarray, space: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cut [0, len) near every SEGMENT bytes at a text's start or a space."""
    lo, n = 0, len(buf)
    while lo < n:
        hi = lo + SEGMENT
        if hi >= n:
            yield lo, n
            return
        k = int(np.searchsorted(breaks, hi, "right")) - 1
        if breaks[k] > lo:
            hi = int(breaks[k])
        else:
            step = np.flatnonzero(space[buf[hi:hi + SEGMENT]])
            while not len(step) and hi < n:  # one word longer than a segment
                hi = min(n, hi + SEGMENT)
                step = np.flatnonzero(space[buf[hi:hi + SEGMENT]])
            hi = min(n, hi + (int(step[0]) if len(step) else 0))
            nxt = int(np.searchsorted(breaks, lo, "right"))
            if nxt < len(breaks) and breaks[nxt] < hi:
                hi = int(breaks[nxt])
        yield lo, hi
        lo = hi


def words(col: pa.Array, lower: bool = True, keep_bytes: bool = False, space: np.ndarray = _SPACE):
    """(hash, text index, count of words per text[, start, end, bytes]).

    ``hash`` lists the words of all texts in order; ``index`` says which
    text each belongs to. ``space``: which bytes separate words.
    """
    buf, off = string_buffers(col)
    n_docs = len(off) - 1
    vals = _BYTE_LOWER if lower else _BYTE
    hs, ss, es = [], [], []
    starts_of = np.unique(off[:-1])
    for lo, hi in _segments(buf, starts_of, space):
        seg = buf[lo:hi]
        on = ~space[seg]
        first = on.copy()
        first[1:] &= ~on[:-1]
        last = on.copy()
        last[:-1] &= ~on[1:]
        a, b = np.searchsorted(starts_of, (lo + 1, hi))
        cut = starts_of[a:b] - lo
        first[cut] = on[cut]
        last[cut - 1] = on[cut - 1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        if not len(s):
            continue
        p, q = _powers(len(seg))
        cum = np.empty(len(seg) + 1, np.uint64)
        cum[0] = 0
        np.cumsum(vals[seg] * p[:len(seg)], out=cum[1:])
        h = (cum[e] - cum[s]) * q[s]
        hs.append(mix(h + (e - s).astype(np.uint64) * U(0xD6E8FEB86659FD93)))
        ss.append(s + lo)
        es.append(e + lo)
    h = np.concatenate(hs) if hs else np.zeros(0, np.uint64)
    s = np.concatenate(ss) if ss else np.zeros(0, np.int64)
    index = np.searchsorted(off, s, "right") - 1
    counts = np.bincount(index, minlength=n_docs).astype(np.int64)
    if keep_bytes:
        return h, index, counts, s, (np.concatenate(es) if es else s), buf
    return h, index, counts


def runs(index: np.ndarray, counts: np.ndarray, h: np.ndarray, n: int):
    """Hashes of every run of ``n`` words inside one text, and its text.

    A text of 1 to n-1 words has one run, of all its words.
    """
    out_h, out_i = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(h)
    if m:
        mult = mix(np.arange(1, n + 1, dtype=np.uint64) * _P) | U(1)
        if m >= n:
            acc = np.zeros(m - n + 1, np.uint64)
            for k in range(n):
                acc += h[k:m - n + 1 + k] * mult[k]
            inside = index[:m - n + 1] == index[n - 1:]
            out_h, out_i = mix(acc[inside]), index[:m - n + 1][inside]
        short = np.flatnonzero((counts > 0) & (counts < n))
        if len(short):
            ends = np.cumsum(counts)
            extra = np.zeros(len(short), np.uint64)
            for k in range(n - 1):
                has = counts[short] > k
                extra[has] += h[(ends - counts)[short][has] + k] * mult[k]
            extra = mix(extra ^ (counts[short].astype(np.uint64) * _PINV))
            out_h, out_i = np.concatenate([out_h, extra]), np.concatenate([out_i, short])
            order = np.argsort(out_i, kind="stable")
            out_h, out_i = out_h[order], out_i[order]
    return out_h, out_i

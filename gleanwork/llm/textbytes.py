"""Vectorised words and hashes over the bytes of many texts at once.

A word is a run of bytes other than space and \\x09-\\x0D, which for UTF-8 is the same as
the run of characters. Words and lines are identified by 64-bit polynomial hashes that do
not depend on the process, the batch or the position, so they can be shuffled and joined.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = 0x9E3779B97F4A7C55  # odd, so that it has an inverse modulo 2**64
#: Bytes hashed at once; texts are cut into pieces of about this size for the temporaries only.
CHUNK = 1 << 18
#: Bytes of text handled together by ``pieces``.
PIECE = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
        done += step
    return out


_POW: list[np.ndarray] = []


def powers() -> tuple[np.ndarray, np.ndarray]:
    if not _POW:
        _POW.extend((_powers(BASE, CHUNK + 1), _powers(pow(BASE, -1, 1 << 64), CHUNK + 1)))
    return _POW[0], _POW[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on all of them."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def column(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    big = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    _, offsets, data = col.buffers()
    kind = np.int64 if big else np.int32
    offs = np.frombuffer(offsets, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def pieces(buf: np.ndarray, offs: np.ndarray, size: int = PIECE):
    """Runs of whole texts of about ``size`` bytes: (first, after last, bytes, offsets)."""
    n, lo = len(offs) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + size, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text number of every word."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~SPACE[buf]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    cut = offs[1:-1]
    cut = cut[(cut > 0) & (cut < len(buf))]
    first[cut] |= word[cut]
    last[cut - 1] |= word[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, by differences of running polynomial sums."""
    pw, inv = powers()
    out = np.empty(len(starts), np.uint64)
    lo, n = 0, len(starts)
    while lo < n:
        at = int(starts[lo])
        hi = int(np.searchsorted(ends, at + CHUNK, "right"))
        if hi <= lo:  # one span longer than a chunk
            out[lo] = _long(buf[at : int(ends[lo])])
            lo += 1
            continue
        part = buf[at : int(ends[hi - 1])]
        total = np.empty(len(part) + 1, np.uint64)
        total[0] = 0
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * pw[: len(part)], out=total[1:])
        s, e = starts[lo:hi] - at, ends[lo:hi] - at
        out[lo:hi] = mix((total[e] - total[s]) * inv[s])
        lo = hi
    return out


def _long(span: np.ndarray) -> np.uint64:
    pw, _ = powers()
    h, scale = 0, 1
    for i in range(0, len(span), CHUNK):
        part = span[i : i + CHUNK].astype(np.uint64) + np.uint64(1)
        h = (h + scale * int(np.sum(part * pw[: len(part)], dtype=np.uint64))) % (1 << 64)
        scale = scale * pow(BASE, CHUNK, 1 << 64) % (1 << 64)
    return mix(np.array([h], np.uint64))[0]


def per_text(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sums of a 0/1 value per byte for each text."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def rolling(words: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``width`` words within one text, and the position of its first word."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[:n] == doc[width - 1 :])
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = h * np.uint64(0xD1342543DE82EF95) + words[k : k + n]
    return mix(h[at]), at


def shingle_sets(buf: np.ndarray, offs: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, over lower-cased (A-Z) words.

    A text of fewer words than ``width`` has one shingle of all its words, one without words none.
    """
    low = LOWER[buf]
    s, e, doc = spans(low, offs)
    h = hashes(low, s, e)
    roll, at = rolling(h, doc, width)
    bounds = np.searchsorted(doc[at] if len(at) else np.zeros(0, np.int64), np.arange(len(offs)))
    words = np.searchsorted(doc, np.arange(len(offs)))
    out = []
    for i in range(len(offs) - 1):
        own = roll[bounds[i] : bounds[i + 1]]
        if not len(own) and words[i + 1] > words[i]:
            x = np.uint64(0)
            with np.errstate(over="ignore"):
                for v in h[words[i] : words[i + 1]]:
                    x = x * np.uint64(0xD1342543DE82EF95) + v
            own = mix(np.array([x], np.uint64))
        out.append(np.unique(own))
    return out


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))

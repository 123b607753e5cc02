"""Content-defined anchors: places that two texts share wherever they share a long enough string.

Of all ``k``-byte strings inside a window of ``length`` bytes, the one with the smallest hash is the
window's anchor (the leftmost of equal ones).  Equal windows have equal anchors, and neighbouring
windows mostly share one, so a text has about one anchor per fourteen bytes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
PLACE = np.uint64(20)  # bits that hold a position while minima are taken
CHUNK = (1 << 20) - 4096
BATCH = 1 << 16  # bytes of short texts that are worked off at once, few enough to stay in a core's cache


def words_of(data: bytes) -> np.ndarray:
    """The 8 bytes from every position as one number, copied so that later reads are aligned."""
    return np.ascontiguousarray(np.ndarray((len(data) - 7,), "<u8", data, strides=(1,)))


def gram_hashes(w: np.ndarray, n: int, k: int) -> np.ndarray:
    """Hashes of all k-byte strings; k is a multiple of 8, ``w`` from :func:`words_of`, ``n`` the text's length."""
    m = n - k + 1
    h = w[:m] * MIX[0]
    for j in range(8, k, 8):
        h ^= h >> np.uint64(31)
        h += w[j : j + m]
        h *= MIX[(j // 8) % 3]
    h ^= h >> np.uint64(29)
    h *= MIX[3]
    h ^= h >> np.uint64(32)
    return h


def slide_min(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every ``size`` consecutive values."""
    n, s = len(x) - size + 1, 1
    while 2 * s <= size:
        x = np.minimum(x[:-s], x[s:])
        s *= 2
    return np.minimum(x[:n], x[size - s : size - s + n]) if s < size else x


def span_hashes(w: np.ndarray, start: np.ndarray, size: np.ndarray, most: int) -> np.ndarray:
    """Hashes of the bytes start .. start + size - 1, size from 8 to ``most``; equal for equal bytes and ``most``."""
    h = size.astype(np.uint64) * MIX[0]
    end = start + size - 8
    for j in range(0, most, 8):
        h ^= w[np.minimum(start + j, end)] * MIX[1 + (j // 8) % 2]
        h ^= h >> np.uint64(31)
        h *= MIX[3]
        h += np.uint64(j + 1)
    h ^= h >> np.uint64(29)
    return h * MIX[2]


def _joined(parts: list[bytes], length: int, k: int) -> tuple[np.ndarray, ...]:
    """Part, anchor's hash, first and last window start within the part, context's hash; parts hold a window at least."""
    data = b"".join(parts)
    sizes = np.asarray([len(p) for p in parts], dtype=np.int64)
    w = words_of(data)
    h = gram_hashes(w, len(data), k)
    key = (h >> PLACE << PLACE) | np.arange(len(h), dtype=np.uint64)
    low = slide_min(key, length - k + 1)
    which = np.repeat(np.arange(len(parts)), sizes - length + 1)
    at = np.arange(len(which)) + which * (length - 1)  # window starts; none reaches into the next part
    place = (low[at] & np.uint64((1 << 20) - 1)).astype(np.int64)
    turn = np.concatenate([[0], np.nonzero(place[1:] != place[:-1])[0] + 1])
    part, first = which[turn], at[turn]
    last = at[np.concatenate([turn[1:], [len(place)]]) - 1]
    begin = (np.cumsum(sizes) - sizes)[part]
    return part, h[place[turn]], first - begin, last - begin, span_hashes(w, first, last - first + length, 2 * length - k)


def anchors_of(texts: Iterable[bytes], length: int = 50, k: int = 24, wanted: Iterable[bool] | None = None) -> Iterator[tuple]:
    """(text, *anchors) of every text in turn, see :func:`anchors`; texts that are not ``wanted`` get no anchors.

    Short texts are worked off together, which changes nothing in their results.
    """
    empty = np.empty(0, np.int64)
    none = np.empty(0, np.uint64), empty, empty, np.empty(0, np.uint64)
    group: list[tuple[bytes, bool]] = []
    size = 0

    def flush() -> Iterator[tuple]:
        parts = [t for t, short in group if short]
        if parts:
            part, *found = _joined(parts, length, k)
            cut = np.searchsorted(part, np.arange(len(parts) + 1)).tolist()
        i = 0
        for t, short in group:
            yield (t, *(x[cut[i] : cut[i + 1]] for x in found)) if short else (t, *none)
            i += short

    for t, want in zip(texts, wanted) if wanted is not None else ((t, True) for t in texts):
        n = len(t)
        long = want and n > min(BATCH, CHUNK)
        if group and (long or size + n > BATCH):
            yield from flush()
            group, size = [], 0
        if long:
            out = []
            for at in range(0, n - length + 1, CHUNK):
                _, h, first, last, c = _joined([t[at : at + CHUNK + length - 1]], length, k)
                out.append((h, first + at, last + at, c))
            yield (t, *(np.concatenate(x) for x in zip(*out)))
        else:
            group.append((t, want and n >= length))
            size += n
    yield from flush()


def anchors(data: bytes, length: int = 50, k: int = 24) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per anchor: hash of its k bytes, first window start, last window start, hash of all bytes of its windows.

    The windows of an anchor are a run of starts; runs follow each other and cover every start once.
    A long text is worked off in overlapping parts; a run that a part cuts is two runs there, which
    changes no window's anchor.
    """
    return next(anchors_of([data], length, k))[1:]

"""XXH64 over many byte spans of one buffer at a time, as NumPy vector arithmetic."""

from __future__ import annotations

import numpy as np
import xxhash

# Fixed values of the public XXH64 specification.
P1 = np.uint64(11400714785074694791)
P2 = np.uint64(14029467366897019727)
P3 = np.uint64(1609587929392839161)
P4 = np.uint64(9650029242287828579)
P5 = np.uint64(2870177450012600261)

#: Longer spans are rare and go to the C library one by one.
LONG = 512


def _rotl(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * P2, 31) * P1


def xxh64_spans(data: bytes, starts: np.ndarray, lengths: np.ndarray, seed: int) -> np.ndarray:
    """uint64 digests of data[s:s + n] for each start s and length n."""
    raw = np.frombuffer(data + b"\0" * 8, np.uint8)
    words = np.ndarray(len(raw) - 7, "<u8", raw, 0, (1,))
    halves = np.ndarray(len(raw) - 7, "<u4", raw, 0, (1,))
    base = np.uint64(seed)
    with np.errstate(over="ignore"):
        h = np.full(len(starts), base + P5, np.uint64)
        at = starts.copy()
        rest = lengths.copy()
        big = np.flatnonzero(lengths >= 32)
        if len(big):
            accs = [np.full(len(big), v, np.uint64) for v in (base + P1 + P2, base + P2, base, base - P1)]
            stripes = lengths[big] // 32
            for k in range(int(min(stripes.max(), LONG // 32))):
                on = np.flatnonzero(stripes > k)
                where = at[big[on]] + 32 * k
                for lane in range(4):
                    accs[lane][on] = _round(accs[lane][on], words[where + 8 * lane])
            merged = _rotl(accs[0], 1) + _rotl(accs[1], 7) + _rotl(accs[2], 12) + _rotl(accs[3], 18)
            for acc in accs:
                merged = (merged ^ _round(np.zeros_like(acc), acc)) * P1 + P4
            h[big] = merged
            at[big] += 32 * stripes
            rest[big] -= 32 * stripes
        h += lengths.astype(np.uint64)
        for _ in range(3):
            on = np.flatnonzero(rest >= 8)
            lane = _round(np.zeros(len(on), np.uint64), words[at[on]])
            h[on] = _rotl(h[on] ^ lane, 27) * P1 + P4
            at[on] += 8
            rest[on] -= 8
        on = np.flatnonzero(rest >= 4)
        h[on] = _rotl(h[on] ^ (halves[at[on]].astype(np.uint64) * P1), 23) * P2 + P3
        at[on] += 4
        rest[on] -= 4
        for _ in range(3):
            on = np.flatnonzero(rest >= 1)
            h[on] = _rotl(h[on] ^ (raw[at[on]].astype(np.uint64) * P5), 11) * P1
            at[on] += 1
            rest[on] -= 1
        h ^= h >> np.uint64(33)
        h *= P2
        h ^= h >> np.uint64(29)
        h *= P3
        h ^= h >> np.uint64(32)
    view = memoryview(data)
    for k in np.flatnonzero(lengths > LONG):
        h[k] = xxhash.xxh64_intdigest(view[starts[k] : starts[k] + lengths[k]], seed)
    return h

"""MD5 of many short texts at once."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np

# Fixed values of MD5: constants and rotations of its rounds, and its start.
_ADDED = [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
_TURNED = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Digests computed at once: what they need stays within a core's cache.
PIECE = 1 << 15


def _first_words(words: list[np.ndarray | int], shape: tuple[int, ...]) -> np.ndarray:
    """The first word of the MD5 of one-block messages, given as 16 words that broadcast to shape.  It is settled after 61 of 64 steps."""
    a, b, c, d = (np.full(shape, x, np.uint32) for x in _START)
    f, high = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for i in range(61):
        if i < 16:
            at = i
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            at = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            at = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            at = 7 * i % 16
            np.bitwise_not(d, out=f)
            f |= b
            f ^= c
        f += a
        f += words[at]
        f += np.uint32(_ADDED[i])
        np.left_shift(f, np.uint32(_TURNED[i]), out=high)
        f >>= np.uint32(32 - _TURNED[i])
        f |= high
        f += b
        a, d, c, b, f = d, c, b, f, a
    return (b + np.uint32(_START[0])).byteswap()


def _block(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows).view("<u4")


def md5_heads(prefixes: Sequence[bytes], suffixes: Sequence[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each prefix and suffix the first 32 bits of the MD5 of both joined, as (places of prefixes, places of suffixes, matrix), in pieces."""
    by_size: dict[int, list[int]] = {}
    for at, suffix in enumerate(suffixes):
        by_size.setdefault(len(suffix), []).append(at)
    sizes = np.array([len(p) for p in prefixes], dtype=np.int64)
    for size in np.unique(sizes).tolist():
        places = np.flatnonzero(sizes == size)
        for more, others in by_size.items():
            ends, total = np.array(others), size + more
            step = max(PIECE // len(ends), 1)
            for low in range(0, len(places), step):
                starts = places[low : low + step]
                if total > 55:
                    # Longer than one block.
                    whole = [[int.from_bytes(hashlib.md5(prefixes[i] + suffixes[j]).digest()[:4], "big") for j in others] for i in starts.tolist()]
                    yield starts, ends, np.array(whole, dtype=np.uint32)
                    continue
                left, right = np.zeros((len(starts), 64), np.uint8), np.zeros((len(ends), 64), np.uint8)
                left[:, :size] = np.frombuffer(b"".join(prefixes[i] for i in starts.tolist()), np.uint8).reshape(len(starts), size)
                right[:, size:total] = np.frombuffer(b"".join(suffixes[j] for j in others), np.uint8).reshape(len(ends), more)
                right[:, total] = 0x80
                right[:, 56:58] = divmod(8 * total, 256)[::-1]
                a, b = _block(left), _block(right)
                used = total // 4 + 1
                words = [a[:, k, None] | b[None, :, k] if k < used else b[0, k] for k in range(16)]
                yield starts, ends, _first_words(words, (len(starts), len(ends)))

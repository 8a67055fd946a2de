"""XXH64 over many spans of one byte buffer at once, with numpy."""

from __future__ import annotations

import numpy as np
import xxhash

_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Spans beyond this go to the library one by one.
_LONG = 255


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _lane(x: np.ndarray) -> np.ndarray:
    return _rotl(x * _P2, 31) * _P1


def padded(data: bytes) -> np.ndarray:
    out = np.zeros(len(data) + 16, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out


def xxh64_spans(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray, seed: int = 42) -> np.ndarray:
    """The hash of ``buf[s:s+n]`` for every s, n. ``buf`` is ``padded``."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = len(buf)
    u64 = np.ndarray((n - 7,), "<u8", buf, 0, (1,))
    u32 = np.ndarray((n - 3,), "<u4", buf, 0, (1,))
    starts, lens = starts.astype(np.int64), lens.astype(np.int64)
    with np.errstate(over="ignore"):
        s = np.uint64(seed)
        h = np.full(len(starts), s + _P5, np.uint64)
        big = np.flatnonzero((lens >= 32) & (lens <= _LONG))
        if len(big):
            acc = [np.full(len(big), v, np.uint64) for v in (s + _P1 + _P2, s + _P2, s, s - _P1)]
            stripes, at = lens[big] >> 5, starts[big]
            for k in range(int(stripes.max())):
                on = np.flatnonzero(stripes > k)
                for j in range(4):
                    acc[j][on] = _rotl(acc[j][on] + u64[at[on] + (32 * k + 8 * j)] * _P2, 31) * _P1
            x = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
            for a in acc:
                x = (x ^ _lane(a)) * _P1 + _P4
            h[big] = x
        h += lens.astype(np.uint64)
        pos, rem = starts + (lens & ~31), lens & 31
        rem[lens > _LONG] = 0
        for k in range(3):
            on = np.flatnonzero(rem >= 8 * (k + 1))
            h[on] = _rotl(h[on] ^ _lane(u64[pos[on] + 8 * k]), 27) * _P1 + _P4
        pos += rem & ~7
        rem &= 7
        on = np.flatnonzero(rem >= 4)
        h[on] = _rotl(h[on] ^ (u32[pos[on]].astype(np.uint64) * _P1), 23) * _P2 + _P3
        pos[on] += 4
        rem[on] -= 4
        for k in range(3):
            on = np.flatnonzero(rem > k)
            h[on] = _rotl(h[on] ^ (buf[pos[on] + k].astype(np.uint64) * _P5), 11) * _P1
        h ^= h >> np.uint64(33)
        h *= _P2
        h ^= h >> np.uint64(29)
        h *= _P3
        h ^= h >> np.uint64(32)
    for i in np.flatnonzero(lens > _LONG):
        h[i] = xxhash.xxh64_intdigest(buf[starts[i] : starts[i] + lens[i]].tobytes(), seed=seed)
    return h


def mix(h: np.ndarray, other: np.ndarray | int) -> np.ndarray:
    """A hash of two hashes, order kept."""
    with np.errstate(over="ignore"):
        x = (np.asarray(h, np.uint64) * _P1) ^ (_rotl(np.asarray(other, np.uint64), 29) * _P2)
        x ^= x >> np.uint64(32)
        x *= _P3
        return x ^ (x >> np.uint64(29))

"""XXH64 of many byte ranges at once.

Ranges of one length are hashed together, each step of the published algorithm
being one array operation over all of them.
"""

from __future__ import annotations

import numpy as np
import xxhash

# Fixed values of XXH64 (its five primes).
P1, P2, P3, P4, P5 = (
    np.uint64(11400714785074694791),
    np.uint64(14029467366897019727),
    np.uint64(1609587929392839161),
    np.uint64(9650029242287828579),
    np.uint64(2870177450012600261),
)
LONGEST = 256  # longer ranges are rare and hashed one by one


def _rotate(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _round(lane: np.ndarray, acc: np.ndarray | np.uint64 = np.uint64(0)) -> np.ndarray:
    return _rotate(acc + lane * P2, 31) * P1


def _same_length(raw: np.ndarray, start: np.ndarray, size: int, seed: np.uint64) -> np.ndarray:
    lanes = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    at = 0
    if size >= 32:
        accs = [np.full(len(start), s) for s in (seed + P1 + P2, seed + P2, seed, seed - P1)]
        while at + 32 <= size:
            accs = [_round(lanes[start + (at + 8 * i)], a) for i, a in enumerate(accs)]
            at += 32
        h = _rotate(accs[0], 1) + _rotate(accs[1], 7) + _rotate(accs[2], 12) + _rotate(accs[3], 18)
        for a in accs:
            h = (h ^ _round(a)) * P1 + P4
    else:
        h = np.full(len(start), seed + P5)
    h += np.uint64(size)
    while at + 8 <= size:
        h = _rotate(h ^ _round(lanes[start + at]), 27) * P1 + P4
        at += 8
    if at + 4 <= size:
        h = _rotate(h ^ ((lanes[start + at] & np.uint64(0xFFFFFFFF)) * P1), 23) * P2 + P3
        at += 4
    while at < size:
        h = _rotate(h ^ (raw[start + at].astype(np.uint64) * P5), 11) * P1
        at += 1
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    return h ^ (h >> np.uint64(32))


def xxh64(data: bytes, start: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    """Unsigned XXH64 of data[start[i]:end[i]] for every i."""
    raw = np.frombuffer(data + b"\0" * 8, np.uint8)
    sizes = end - start
    out = np.empty(len(start), np.uint64)
    if not len(start):
        return out
    kind = np.minimum(sizes, LONGEST + 1).astype(np.uint16)
    order = np.argsort(kind, kind="stable")
    cuts = np.flatnonzero(np.diff(kind[order])) + 1
    with np.errstate(over="ignore"):
        for rows in np.split(order, cuts):
            size = int(kind[rows[0]])
            if size <= LONGEST:
                out[rows] = _same_length(raw, start[rows], size, np.uint64(seed))
            else:
                for i in rows:
                    out[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]], seed)
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads the bits of 64-bit values."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
    return h ^ (h >> np.uint64(32))

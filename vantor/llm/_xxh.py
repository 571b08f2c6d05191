"""XXH64 of many stretches of one buffer at once (the published algorithm, in numpy)."""

from __future__ import annotations

import numpy as np

#: The algorithm's fixed primes.
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * P2, 31) * P1


def xxh64(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int) -> np.ndarray:
    """The unsigned hashes of ``data[s : s + n]`` for each start s and length n."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    wide = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    half = np.ndarray((len(data) + 1,), "<u4", padded, 0, (1,))
    s = np.uint64(seed)
    acc = np.full(len(starts), s + P5, np.uint64)
    at, left = starts.astype(np.int64), lengths.astype(np.int64)
    big = np.flatnonzero(left >= 32)
    if len(big):
        with np.errstate(over="ignore"):
            lanes = [np.full(len(big), x, np.uint64) for x in (s + P1 + P2, s + P2, s, s - P1)]
        live = np.arange(len(big))
        while len(live):
            who = big[live]
            for k in range(4):
                lanes[k][live] = _round(lanes[k][live], wide[at[who] + 8 * k])
            at[who] += 32
            left[who] -= 32
            live = live[left[who] >= 32]
        h = _rotl(lanes[0], 1) + _rotl(lanes[1], 7) + _rotl(lanes[2], 12) + _rotl(lanes[3], 18)
        for v in lanes:
            h = (h ^ _round(np.uint64(0), v)) * P1 + P4
        acc[big] = h
    acc += lengths.astype(np.uint64)
    live = np.flatnonzero(left >= 8)
    while len(live):
        acc[live] = _rotl(acc[live] ^ _round(np.uint64(0), wide[at[live]]), 27) * P1 + P4
        at[live] += 8
        left[live] -= 8
        live = live[left[live] >= 8]
    live = np.flatnonzero(left >= 4)
    acc[live] = _rotl(acc[live] ^ (half[at[live]].astype(np.uint64) * P1), 23) * P2 + P3
    at[live] += 4
    left[live] -= 4
    live = np.flatnonzero(left > 0)
    while len(live):
        acc[live] = _rotl(acc[live] ^ (padded[at[live]].astype(np.uint64) * P5), 11) * P1
        at[live] += 1
        left[live] -= 1
        live = live[left[live] > 0]
    acc = (acc ^ (acc >> np.uint64(33))) * P2
    acc = (acc ^ (acc >> np.uint64(29))) * P3
    return acc ^ (acc >> np.uint64(32))

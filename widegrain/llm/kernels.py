"""Numpy kernels over the UTF-8 bytes of many texts at once: words, hashes, windows."""

from __future__ import annotations

import numpy as np
from xxhash import xxh64_intdigest

U64 = np.uint64
_MASK = (1 << 64) - 1
#: XXH64's five primes (fixed values of the published hash).
P1, P2, P3, P4, P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
#: Fewer spans of one length, for each 32 bytes of it, are hashed one by one.
LONE = 100
#: Odd multiplier of the polynomial hashes of short runs, and the constants of a 64-bit finaliser.
WORD_BASE = 0xD6E8FEB86659FD93
MIX_1, MIX_2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB

_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n, kept for the next call."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length() if n > 1 else 1)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.ones(1, U64)
            step = b
            while len(p) < size:
                p = np.concatenate([p, p * U64(step)])
                step = step * step & _MASK
            out.append(p)
        _POWERS[base] = (out[0], out[1])
    return _POWERS[base]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: near values become far ones."""
    x = (x ^ (x >> U64(30))) * U64(MIX_1)
    x = (x ^ (x >> U64(27))) * U64(MIX_2)
    return x ^ (x >> U64(31))


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and each text's first word (texts + 1 entries)."""
    if len(buf) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~IS_SPACE[buf]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[offsets[offsets < len(buf)]] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    ends_at = offsets[1:]
    after[ends_at[ends_at > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U64(r)) | (x >> U64(64 - r))


def xxh64_spans(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each byte span; spans of one length are hashed together where there are many."""
    out = np.empty(len(starts), U64)
    if not len(starts):
        return out
    data = np.concatenate([buf, np.zeros(8, np.uint8)])
    by8 = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    by4 = np.ndarray((len(data) - 3,), "<u4", data, strides=(1,))
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    view = memoryview(np.ascontiguousarray(buf))
    for group in np.split(order, cuts):
        size, s = int(lengths[group[0]]), starts[group]
        if len(group) < LONE * (1 + size // 32):
            out[group] = [xxh64_intdigest(view[a : a + size], seed) for a in s.tolist()]
            continue
        out[group] = _xxh64_group(by8, by4, data, s, size, seed)
    return out


def _xxh64_group(by8, by4, data, s, size: int, seed: int) -> np.ndarray:
    mask = (1 << 64) - 1
    at = 0

    def lane_round(acc, lane):
        return _rotl(acc + lane * U64(P2), 31) * U64(P1)

    if size >= 32:
        acc = [np.full(len(s), (seed + d) & mask, U64) for d in (P1 + P2, P2, 0, -P1)]
        while at + 32 <= size:
            acc = [lane_round(a, by8[s + at + 8 * i]) for i, a in enumerate(acc)]
            at += 32
        h = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
        for a in acc:
            h = (h ^ lane_round(np.zeros(1, U64), a)) * U64(P1) + U64(P4)
        h = h + U64(size)
    else:
        h = np.full(len(s), (seed + P5 + size) & mask, U64)
    while at + 8 <= size:
        h = _rotl(h ^ lane_round(np.zeros(1, U64), by8[s + at]), 27) * U64(P1) + U64(P4)
        at += 8
    if at + 4 <= size:
        h = _rotl(h ^ (by4[s + at].astype(U64) * U64(P1)), 23) * U64(P2) + U64(P3)
        at += 4
    while at < size:
        h = _rotl(h ^ (data[s + at].astype(U64) * U64(P5)), 11) * U64(P1)
        at += 1
    h = (h ^ (h >> U64(33))) * U64(P2)
    h = (h ^ (h >> U64(29))) * U64(P3)
    return h ^ (h >> U64(32))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each byte span, equal for equal content wherever it lies.

    XXH64, not a polynomial: of those modulo 2**64, equal-hashed texts can be written down.
    """
    return xxh64_spans(buf, starts, ends - starts, seed)


def rolling(values: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k values in a row, by doubling; entry i covers i..i+k-1."""
    base, done, have = WORD_BASE, 0, None
    power, width, block = base, 1, values
    while k:
        if k & 1:
            if have is None:
                have, done = block, width
            else:  # have covers `done` values from its start; append a block of `width` after them
                n = len(have) - width
                have = have[: max(n, 0)] * U64(power) + block[done : done + max(n, 0)] if n > 0 else have[:0]
                done += width
        k >>= 1
        if k:
            n = len(block) - width
            block = block[:n] * U64(power) + block[width : width + n] if n > 0 else block[:0]
            power = power * power & _MASK
            width *= 2
    return have


def sliding_argmin(values: np.ndarray, k: int) -> np.ndarray:
    """Leftmost place of the least value among each k in a row."""
    pos = np.arange(len(values))
    width = 1
    while width < k:
        step = min(width, k - width)
        n = len(pos) - step
        if n <= 0:
            return pos[:0]
        left, right = pos[:n], pos[step:]
        pos = np.where(values[left] <= values[right], left, right)
        width += step
    return pos


def join_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Spans joined by one space within each group of `counts` spans: bytes, group offsets."""
    lens = ends - starts + 1
    if not len(starts):
        return b"", np.zeros(len(counts) + 1, np.int64)
    total = np.cumsum(lens)
    at = np.arange(total[-1]) - np.repeat(total - lens, lens) + np.repeat(starts, lens)
    out = buf[np.minimum(at, len(buf) - 1)]
    out[total - 1] = 0x20
    group_ends = np.concatenate([[0], np.cumsum(counts)])
    edge = np.concatenate([[0], total])[group_ends]
    return out.tobytes(), edge

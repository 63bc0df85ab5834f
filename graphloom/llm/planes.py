"""Fingerprints as vertical bit planes, and distances of many of them at once."""

from __future__ import annotations

import numpy as np


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """A row for each bit; lane i of a row's 64-bit words is fingerprint i. Fingerprints are words of 64 bits, or rows of several."""
    n = len(fps)
    words = -(-n // 64)
    bits = np.zeros((words * 64, fps.size * 8 // n if n else 8), dtype=np.uint8)
    bits[:n] = np.ascontiguousarray(fps, dtype="<u8").view(np.uint8).reshape(n, -1) if n else 0
    return np.packbits(np.unpackbits(bits, axis=1, bitorder="little").T.copy(), axis=1, bitorder="little").view("<u8")


def column_sums(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Counts per lane, as bitmaps, least significant first. columns[k] holds bitmaps that are worth 2 ** k each; carry-save adders take three at a time."""
    out, k = [], 0
    carries: list[np.ndarray] = []
    while k < len(columns) or carries:
        x = np.concatenate([*([columns[k]] if k < len(columns) else []), *carries])
        carries = []
        while len(x) > 1:
            t = len(x) // 3
            if t:
                a, b, c = x[:t], x[t : 2 * t], x[2 * t : 3 * t]
                half = a ^ b
                carries.append((a & b) | (c & half))
                x = np.concatenate([half ^ c, x[3 * t :]])
            else:
                carries.append((x[0] & x[1])[None])
                x = (x[0] ^ x[1])[None]
        out.append(x[0])
        k += 1
    return out


def at_most(counts: list[np.ndarray], most: int) -> np.ndarray:
    """The lanes whose count is ``most`` or less."""
    above, equal = np.zeros_like(counts[0]), ~np.zeros_like(counts[0])
    for k in range(max(len(counts), most.bit_length()) - 1, -1, -1):
        bit = counts[k] if k < len(counts) else np.zeros_like(above)
        if most >> k & 1:
            equal = equal & bit
        else:
            above = above | (equal & bit)
            equal = equal & ~bit
    return ~above


def near_lanes(planes: np.ndarray, fp: int, radius: int, lanes: np.ndarray) -> np.ndarray:
    """Of the lanes given, those whose fingerprint differs from fp in ``radius`` bits or fewer.

    Differences of half the planes are counted first; words in which no lane is
    left are abandoned before the other half.
    """
    n, words = len(lanes), planes.shape[1]
    bits = np.zeros(words * 64, dtype=bool)
    bits[:n] = lanes
    live = np.packbits(bits, bitorder="little").view("<u8")
    flip = np.array([~np.uint64(0) if fp >> p & 1 else np.uint64(0) for p in range(len(planes))])[:, None]
    half = len(planes) // 2
    at = np.flatnonzero(live)
    counts = column_sums([planes[:half, at] ^ flip[:half]])
    now = live[at] & at_most(counts, radius)
    keep = np.flatnonzero(now)
    at = at[keep]
    rest = column_sums([planes[half:, at] ^ flip[half:]])
    both = [np.stack([x[k] if k < len(x) else np.zeros(len(at), np.uint64) for x in ([c[keep] for c in counts], rest)]) for k in range(max(len(counts), len(rest)))]
    out = np.zeros(words, dtype="<u8")
    out[at] = now[keep] & at_most(column_sums(both), radius)
    return np.unpackbits(out.view(np.uint8), bitorder="little")[:n].astype(bool)


def pair_sums(x: np.ndarray) -> list[np.ndarray]:
    """The same for a power of two of bitmaps, by adding halves to each other: fewer and longer steps."""
    sums, n = [x], len(x)
    while n > 1:
        n //= 2
        added, carry = [], None
        for bit in sums:
            a, b = bit[:n], bit[n:]
            half, both = a ^ b, a & b
            if carry is None:
                added.append(half)
                carry = both
            else:
                added.append(half ^ carry)
                half &= carry
                half |= both
                carry = half
        sums = [*added, carry]
    return [bit[0] for bit in sums]


def near_shifted(planes: np.ndarray, d: int, live: np.ndarray, radius: int, half: int) -> np.ndarray:
    """Of the lanes i of a bitmap, those whose fingerprint and that of lane i + d differ in ``half`` or fewer of the first half of the bits, and in ``radius`` or fewer of all.

    Words in which no lane is left after the first half are abandoned.
    """
    words, bits = divmod(d, 64)
    first, end = len(planes) // 2, planes.shape[1]

    def differing(some: np.ndarray, at: np.ndarray) -> np.ndarray:
        if len(at) == end - words:  # all that have a partner
            low = some[:, words:] >> np.uint64(bits)
            if bits:
                low[:, :-1] |= some[:, words + 1 :] << np.uint64(64 - bits)
            low ^= some[:, : end - words]
            return low
        low = some.take(at + words, 1) >> np.uint64(bits)
        if bits:
            low |= some.take(np.minimum(at + words + 1, end - 1), 1) << np.uint64(64 - bits)
        low ^= some.take(at, 1)
        return low

    out = np.zeros_like(live)
    at = np.flatnonzero(live[: end - words])
    if len(at) * 2 > end - words:
        at = np.arange(end - words)
    if not len(at):
        return out
    counts = pair_sums(differing(planes[:first], at))
    now = live[at] & at_most(counts, half)
    keep = np.flatnonzero(now)
    if not len(keep):
        return out
    rest = pair_sums(differing(planes[first:], at[keep]))
    both = [np.stack([c[keep], x]) for c, x in zip(counts, rest)]
    out[at[keep]] = now[keep] & at_most(column_sums(both), radius)
    return out

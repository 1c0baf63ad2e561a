"""Hashed character n-grams of many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Characters that are looked at in one step.
STEP = 1 << 19
#: Code points with an entry of their own in letter tables; above, only ideographs are letters.
KNOWN = 0x20000


def lower_letters() -> np.ndarray:
    """For each code point its small letter, or a blank if it is no letter."""
    out = np.full(KNOWN, 32, dtype=np.uint32)
    for c in range(KNOWN):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def letters(text: str, table: np.ndarray) -> np.ndarray:
    """Small letters of a text, with one blank for each run of anything else."""
    points = code_points(text)
    if len(points) and points.max() >= KNOWN:
        high = points >= KNOWN
        points = points.copy()
        odd = [int(c) if chr(c).isalpha() else 32 for c in points[high]]
        points[high] = 32
        out = table[points]
        out[high] = odd
    else:
        out = table[points]
    blank = out == 32
    keep = np.ones(len(out), dtype=bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    return out[keep]


def hashed(codes: list[np.ndarray], bits: int, orders: tuple[int, ...] = (1, 2, 3)) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(which text, bucket) of each n-gram, step by step.

    A text stands between blanks, and no n-gram reaches from one text into the next.
    """
    most = max(orders)
    pad = np.full(most, 32, dtype=np.uint32)
    stream = np.concatenate([x for c in codes for x in (pad[:1], c, pad)]) if codes else pad[:0]
    owner = np.repeat(np.arange(len(codes)), [len(c) + 1 + most for c in codes])
    tail = np.zeros(len(stream), dtype=bool)
    ends = np.cumsum([len(c) + 1 + most for c in codes])
    for k in range(1, most + 1):
        tail[ends - k] = True
    odd = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], dtype=np.uint32)
    for at in range(0, len(stream), STEP):
        part = stream[at : at + STEP + most - 1]
        n = min(STEP, len(stream) - at)
        use = ~tail[at : at + n]
        whose = owner[at : at + n][use]
        code = np.zeros(n, dtype=np.uint32)
        for k in range(most):
            more = np.zeros(n, dtype=np.uint32)
            seen = part[k : k + n]
            more[: len(seen)] = seen
            code = (code + more * odd[k]) * odd[4] + odd[k]
            if k + 1 in orders:
                h = (code ^ (code >> np.uint32(15))) * odd[1]
                yield whose, (h >> np.uint32(32 - bits))[use]

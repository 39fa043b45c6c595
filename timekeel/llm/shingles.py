"""Sets of word shingles as sorted 63-bit hashes, which a signed long orders alike."""

from __future__ import annotations

import numpy as np

WORDS = 5
_rng = np.random.default_rng(2024)
#: A random number for each byte, A-Z counting as a-z, and 0 where words are parted.
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE[ord("A"):ord("Z") + 1] = BYTE[ord("a"):ord("z") + 1]
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: An odd multiplier and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


class Powers:
    """Powers of the multiplier, kept as far as the longest text needed them."""

    def __init__(self):
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    @staticmethod
    def grown(have: np.ndarray, base: int, n: int) -> np.ndarray:
        while len(have) < n:
            have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
        return have

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = self.grown(self.up, BASE, n), self.grown(self.down, INVERSE, n)
        return self.up[:n], self.down[:n]


POWERS = Powers()


def mixed(h: np.ndarray) -> np.ndarray:
    """The finishing steps of a 64-bit mixer, so that the order of hashes is as good as random."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of the distinct shingles; of the whole text if it has fewer words; empty without words."""
    if not text:
        return np.zeros(0, np.uint64)
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    space = SPACE[b]
    # One blank after each word: drop blanks at the start and those after a blank.
    keep = np.ones(len(b), dtype=bool)
    keep[0] = not space[0]
    keep[1:] = ~(space[1:] & space[:-1])
    b, space = b[keep], space[keep]
    if not len(b):
        return np.zeros(0, np.uint64)
    value = BYTE[b]
    value[space] = 0x5851F42D4C957F2D
    up, down = POWERS.get(len(b) + 1)
    total = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum(value * up[:-1], out=total[1:])
    ends = np.flatnonzero(space)
    if not space[-1]:
        ends = np.append(ends, len(b))
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(ends) > words:
        starts, ends = starts[: len(ends) - words + 1], ends[words - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    return np.unique(mixed((total[ends] - total[starts]) * down[starts]) >> np.uint64(1))

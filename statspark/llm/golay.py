"""List decoding of the perfect binary Golay code (23, 12, 7), by syndrome.

Every 23-bit word lies within 3 bits of exactly one codeword. The *near*
codewords of a word are those within 4 bits: one if the word is at most 2 bits
from its codeword, six otherwise. If two words differ in at most one bit, the
codeword nearest to one is near the other, so they share a key.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

#: Generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
N, K = 23, 12
#: Fills up lists of near codewords.
NONE = -1


def syndrome(word: int) -> int:
    """The remainder of the word's polynomial by the generator, 11 bits."""
    for bit in range(N - 1, N - K - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - (N - K))
    return word


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of all 12- and 11-bit halves (4096 + 2048 entries), and per syndrome the errors of weight 4 or less."""
    unit = [syndrome(1 << i) for i in range(N)]
    halves = np.zeros((2, 4096), dtype=np.int64)
    for half, base, bits in ((0, 0, 12), (1, 12, 11)):
        for x in range(1 << bits):
            s = 0
            for i in range(bits):
                if x >> i & 1:
                    s ^= unit[base + i]
            halves[half, x] = s
    errors: list[list[int]] = [[] for _ in range(1 << (N - K))]
    for weight in range(5):
        for at in combinations(range(N), weight):
            s = e = 0
            for i in at:
                s ^= unit[i]
                e |= 1 << i
            if not errors[s] or weight >= 3:
                errors[s].append(e)
    # A coset of leader weight 2 or less has no other word of weight 4 or less (distance 7 forbids it) but for weight 4 on leader 3.
    out = np.full((1 << (N - K), 6), NONE, dtype=np.int64)
    for s, found in enumerate(errors):
        out[s, : len(found)] = found
    return halves, out


def near(words: np.ndarray) -> np.ndarray:
    """The 12-bit indices of the near codewords of 23-bit words, nearest first; (n, 6), filled up with NONE."""
    halves, errors = tables()
    words = words.astype(np.int64)
    e = errors[halves[0, words & 4095] ^ halves[1, words >> 12]]
    return np.where(e == NONE, NONE, (words[:, None] ^ e) >> (N - K))

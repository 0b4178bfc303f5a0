"""The Threefry-4x64 counter-based random generator (Salmon et al., 2011), over arrays of counters.

A draw is a function of key and place alone, so a stream can be entered anywhere, and parts of it are made apart.
"""

from __future__ import annotations

import numpy as np

# Rotations of even and odd pairs by round, the key schedule's parity, and the rounds.
ROTATIONS = ((14, 16), (52, 57), (23, 40), (5, 37), (25, 33), (46, 12), (58, 22), (32, 32))
PARITY, ROUNDS = 0x1BD11BDAA9FC1A22, 20
#: 32-bit draws in a block of four 64-bit words.
DRAWS = 8


def blocks(counters: np.ndarray, key: tuple[int, int, int, int]) -> np.ndarray:
    """Random blocks (uint64 [n, 4]) of counters (uint64 [n, 4])."""
    schedule = [np.uint64(k) for k in (*key, PARITY ^ key[0] ^ key[1] ^ key[2] ^ key[3])]
    x = [counters[:, i] + schedule[i] for i in range(4)]
    for r in range(ROUNDS):
        for turn, a, b in zip(ROTATIONS[r % 8], (0, 2), ((1, 3) if r % 2 == 0 else (3, 1)), strict=True):
            x[a] = x[a] + x[b]
            x[b] = (x[b] << np.uint64(turn) | x[b] >> np.uint64(64 - turn)) ^ x[a]
        if r % 4 == 3:
            step = r // 4 + 1
            x = [x[i] + schedule[(step + i) % 5] for i in range(4)]
            x[3] = x[3] + np.uint64(step)
    return np.stack(x, 1)


class Stream:
    """32-bit draws of a seed, in order; `discard` skips any number of them at once."""

    def __init__(self, seed: int = 0):
        self.key, self.place = (seed, 0, 0, 0), 0

    def discard(self, n: int) -> None:
        self.place += n

    def draws(self, n: int) -> np.ndarray:
        """The next n draws."""
        first, last = self.place // DRAWS, -(-(self.place + n) // DRAWS)
        counters = np.zeros((last - first, 4), np.uint64)
        counters[:, 0] = np.arange(first, last, dtype=np.uint64)
        words = blocks(counters, self.key).astype("<u8").view("<u4").ravel()
        out = words[self.place - first * DRAWS :][:n]
        self.place += n
        return out

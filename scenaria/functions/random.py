"""The pinned generator of the sampling estimates.

Splitmix64 seeds a xoshiro256++ stream for each block of samples, and bounded
draws use Lemire's method with rejection. Blocks are numbered, so results depend
on seed and sample count alone, never on partitions.

A step of xoshiro is linear over bits. So the state some steps ahead is a product
with a matrix of bits, a block's one stream is cut into lanes that each begin where
the one before ends, and all lanes run side by side as uint64 arrays. A draw that is
rejected would shift all later ones; in the rare block that has one, the stream is
run number by number.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

BLOCK = 65_536
SEED = 0xC1BBA512C1BBA512
_M = (1 << 64) - 1
#: The increment and multipliers of splitmix64.
GOLDEN, MIX_1, MIX_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def splitmix64(state: int) -> tuple[int, int]:
    """(output, next state)."""
    state = (state + GOLDEN) & _M
    z = state
    z = (z ^ z >> 30) * MIX_1 & _M
    z = (z ^ z >> 27) * MIX_2 & _M
    return z ^ z >> 31, state


class Stream:
    """xoshiro256++."""

    def __init__(self, seed: int):
        words = []
        for _ in range(4):
            word, seed = splitmix64(seed)
            words.append(word)
        self.s = words if any(words) else [GOLDEN, 0, 0, 0]

    def next(self) -> int:
        a, b, c, d = self.s
        out = (_turn(a + d & _M, 23) + a) & _M
        c ^= a
        d ^= b
        self.s = [a ^ d, b ^ c, c ^ (b << 17 & _M), _turn(d, 45)]
        return out

    def below(self, bound: int) -> int:
        while True:
            product = self.next() * bound
            low = product & _M
            if low >= bound or low >= (-bound & _M) % bound:
                return product >> 64


def _turn(x: int, k: int) -> int:
    return (x << k | x >> 64 - k) & _M


def block_stream(seed: int, block: int) -> Stream:
    return Stream(seed ^ (block * GOLDEN & _M))


#: Lanes that a block is cut into.
LANES = 512


def _ahead(state: np.ndarray) -> np.ndarray:
    """The next state of every lane; state: four rows of uint64."""
    a, b, c, d = state
    c, d = c ^ a, d ^ b
    return np.stack([a ^ d, b ^ c, c ^ (b << np.uint64(17)), d << np.uint64(45) | d >> np.uint64(19)])


def _bits(state: np.ndarray) -> np.ndarray:
    """Four words of each lane as 256 rows of bits."""
    words = np.ascontiguousarray(state.T).view(np.uint8).reshape(state.shape[1], 32)
    return np.unpackbits(words, axis=1, bitorder="little").T


def _words(bits: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64).T


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Over bits; sums of 256 ones are exact in float32."""
    return ((a.astype(np.float32) @ b.astype(np.float32)) % 2).astype(np.uint8)


@lru_cache(16)
def _leap(steps: int) -> np.ndarray:
    """The matrix that takes a state so many steps ahead."""
    power, out = _bits(_ahead(_words(np.eye(256, dtype=np.uint8)))), np.eye(256, dtype=np.uint8)
    while steps:
        if steps & 1:
            out = _product(power, out)
        power = _product(power, power)
        steps >>= 1
    return out


def lanes(seed: list[int], apart: int, count: int) -> np.ndarray:
    """Four rows of uint64 for `count` lanes, each `apart` steps ahead of the one before."""
    state = _bits(np.array(seed, np.uint64)[:, None])
    step = _leap(apart)
    while state.shape[1] < count:
        state = np.concatenate([state, _product(step, state)], axis=1)
        step = _product(step, step)
    return _words(state[:, :count])


def block_digits(seed: int, block: int, samples: int, sizes: tuple[int, ...]) -> np.ndarray:
    """Starting scenarios of one block, drawn descriptor by descriptor."""
    each = -(-samples // LANES)
    state = lanes(block_stream(seed, block).s, each * len(sizes), -(-samples // each)) if sizes else None
    out = np.empty((each, 0 if state is None else state.shape[1], len(sizes)), np.int64)
    half, low = np.uint64(32), np.uint64(0xFFFFFFFF)
    for row in out:
        for k, n in enumerate(sizes):
            a, d = state[0], state[3]
            total = a + d
            drawn = (total << np.uint64(23) | total >> np.uint64(41)) + a
            state = _ahead(state)
            size = np.uint64(n)
            if (drawn * size < np.uint64((1 << 64) % n)).any():
                return _one_by_one(seed, block, samples, sizes)
            row[:, k] = ((drawn >> half) * size + ((drawn & low) * size >> half) >> half).astype(np.int64)
    return out.transpose(1, 0, 2).reshape(-1, len(sizes))[:samples]


def _one_by_one(seed: int, block: int, samples: int, sizes: tuple[int, ...]) -> np.ndarray:
    stream = block_stream(seed, block)
    return np.array([[stream.below(n) for n in sizes] for _ in range(samples)], np.int64).reshape(samples, len(sizes))


#: Coefficients of Acklam's approximation to the normal quantile, highest power first.
CENTRE_TOP = (-3.969683028665376e1, 2.209460984245205e2, -2.759285104469687e2, 1.383577518672690e2, -3.066479806614716e1, 2.506628277459239e0)
CENTRE_BOTTOM = (-5.447609879822406e1, 1.615858368580409e2, -1.556989798598866e2, 6.680131188771972e1, -1.328068155288572e1, 1.0)
TAIL_TOP = (-7.784894002430293e-3, -3.223964580411365e-1, -2.400758277161838e0, -2.549732539343734e0, 4.374664141464968e0, 2.938163982698783e0)
TAIL_BOTTOM = (7.784695709041462e-3, 3.224671290700398e-1, 2.445134137142996e0, 3.754408661907416e0, 1.0)
TAIL = 0.02425


def normal_quantile(p: float) -> float:
    if not 0 < p < 1:
        raise ValueError(f"p must be in (0, 1), got {p}")
    if p > 1 - TAIL:
        return -normal_quantile(1 - p) if p > 0.5 else 0.0
    if p < TAIL:
        q = math.sqrt(-2 * math.log(p))
        return float(np.polyval(TAIL_TOP, q) / np.polyval(TAIL_BOTTOM, q))
    q = p - 0.5
    return float(np.polyval(CENTRE_TOP, q * q) * q / np.polyval(CENTRE_BOTTOM, q * q))


def z_for(confidence: float) -> float:
    if not 0 < confidence < 1:
        raise ValueError(f"confidence must be in (0, 1), got {confidence}")
    return normal_quantile(1 - (1 - confidence) / 2)


def wilson(hits: int, n: int, z: float) -> tuple[float, float]:
    if n <= 0 or not 0 <= hits <= n:
        raise ValueError(f"{hits} hits of {n}")
    share, spread = hits / n, z * z / n
    middle = (share + spread / 2) / (1 + spread)
    half = z * math.sqrt(share * (1 - share) / n + spread / (4 * n)) / (1 + spread)
    return max(0.0, middle - half), min(1.0, middle + half)

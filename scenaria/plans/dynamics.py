"""Batch dynamics of the global rule over stretches of the scenario space.

Signatures split into a low and a high part. The scores of all low parts are a
table of at most LOW columns, and those of one high part a single vector, so a
whole stretch is scored by one addition per variant, whatever the number of
descriptors.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from ..model import Model
from .rules import GLOBAL, Rule, Threshold

LOW = 16_384


def digits_of(signatures: np.ndarray, model: Model) -> np.ndarray:
    out = np.empty((len(signatures), len(model.sizes)), np.int64)
    rest = np.asarray(signatures, np.int64)
    for k, n in enumerate(model.sizes):
        rest, out[:, k] = np.divmod(rest, n)
    return out


def signatures_of(digits: np.ndarray, model: Model) -> np.ndarray:
    return digits @ np.array(model.places, np.int64)


class Space:
    """The scores of a space, in two parts. Pickles as its model."""

    def __init__(self, model: Model):
        self.model = model
        k, n = 0, 1
        while k < len(model.sizes) and n * model.sizes[k] <= LOW:
            n *= model.sizes[k]
            k += 1
        self.split, self.low = k, n
        wide = 4 * (len(model.sizes) + 1) * int(np.abs(model.matrix).max(initial=0))
        self.type = np.int16 if wide <= 32767 else np.int64
        low_digits = digits_of(np.arange(n), model)[:, :k]
        self.owns = [low_digits[:, d].astype(np.int8 if model.sizes[d] < 128 else np.int64) for d in range(k)]
        scores = np.zeros((n, model.dimensions), np.int64)
        for d in range(k):
            scores += model.matrix[model.offsets[d] + low_digits[:, d]]
        self.rows = scores.astype(self.type)
        self.scores = np.ascontiguousarray(self.rows.T)

    def __reduce__(self):
        return Space, (self.model,)

    def high(self, index: int) -> tuple[list[int], np.ndarray]:
        digits, scores = [], np.zeros(self.model.dimensions, np.int64)
        for d in range(self.split, len(self.model.sizes)):
            index, x = divmod(index, self.model.sizes[d])
            digits.append(x)
            scores += self.model.matrix[self.model.offsets[d] + x]
        return digits, scores.astype(self.type)

    def blocks(self, index: int) -> Iterator[tuple[int, np.ndarray | int, np.ndarray, np.ndarray]]:
        """For one high part, by descriptor: (descriptor, incumbents, scores of variants, scores of incumbents)."""
        high_digits, high = self.high(index)
        for d, (o, n) in enumerate(zip(self.model.offsets, self.model.sizes, strict=True)):
            block = self.scores[o : o + n] + high[o : o + n, None]
            if d < self.split:
                own = self.owns[d]
                # the digit runs through its values in stretches of its place, so incumbents' scores are strided copies
                mine = np.empty(self.low, self.type)
                shape = -1, n, self.model.places[d]
                to = mine.reshape(shape)
                for v in range(n):
                    to[:, v] = block[v].reshape(shape)[:, v]
            else:
                own = high_digits[d - self.split]
                mine = block[own]
            yield d, own, block, mine

    def successors(self, index: int, margin: int = 0) -> np.ndarray:
        """Signatures that the low parts under one high part move to."""
        out = np.zeros(self.low, np.int64)
        for d, own, block, mine in self.blocks(index):
            best, top = np.zeros(self.low, np.int8 if len(block) < 128 else np.int64), block[0]
            for v in range(1, len(block)):
                more = block[v] > top
                best = np.where(more, np.asarray(v, best.dtype), best)
                top = np.maximum(top, block[v])
            moves = top - mine > margin
            out += np.multiply(np.where(moves, best, np.asarray(own, best.dtype)), self.model.places[d], dtype=np.int64)
        return out

    def moved(self, signatures: np.ndarray, margin: int = 0) -> np.ndarray:
        """Successors of any signatures: a row of the low table and one of the high parts that occur, added."""
        low, high = signatures % self.low, signatures // self.low
        parts, back = np.unique(high, return_inverse=True)
        table = np.stack([self.high(int(k))[1] for k in parts]) if len(parts) <= 4_096 else None
        out = np.zeros(len(signatures), np.int64)
        for a in range(0, len(signatures), 65_536):
            at = slice(a, a + 65_536)
            if table is None:
                d = digits_of(signatures[at], self.model)
                scores = sum((self.model.matrix[self.model.offsets[k] + d[:, k]] for k in range(self.split, len(self.model.sizes))), np.zeros((len(d), self.model.dimensions), np.int64)) + self.rows[low[at]]
            else:
                scores = self.rows[low[at]] + table[back[at]]
            each = np.arange(len(scores))
            for o, n, p in zip(self.model.offsets, self.model.sizes, self.model.places, strict=True):
                block, own = scores[:, o : o + n], signatures[at] // p % n
                best = block.argmax(axis=1)
                out[at] += np.where(block[each, best] - block[each, own] > margin, best, own) * p
        return out

    def consistent(self, index: int, margin: int = 0) -> np.ndarray:
        """Signatures under one high part that no rival beats by more than margin."""
        good = np.ones(self.low, bool)
        for _, _, block, mine in self.blocks(index):
            good &= block.max(axis=0) - mine <= margin
            if not good.any():
                return np.zeros(0, np.int64)
        return np.nonzero(good)[0] + index * self.low


def fast(rule: Rule) -> bool:
    return isinstance(rule, Threshold)


@lru_cache(4)
def space_of(model: Model) -> Space:
    return Space(model)


def step_signatures(signatures: np.ndarray, model: Model, rule: Rule = GLOBAL) -> np.ndarray:
    if fast(rule):
        return space_of(model).moved(np.asarray(signatures, np.int64), rule.margin)
    return signatures_of(rule.step(digits_of(signatures, model), model), model)


def stretch(space: Space, first: int, last: int, rule: Rule) -> Iterator[np.ndarray]:
    """Successors of the signatures first..last, in order, some at a time."""
    if fast(rule):
        for index in range(first // space.low, last // space.low + 1):
            begin = index * space.low
            yield space.successors(index, rule.margin)[max(0, first - begin) : last - begin + 1]
    else:
        for at in range(first, last + 1, 65_536):
            yield step_signatures(np.arange(at, min(last, at + 65_535) + 1), space.model, rule)


class TooMany(Exception):
    """The states reached are more than one machine should hold."""


def resolve(states: np.ndarray, model: Model, rule: Rule = GLOBAL, most: int = 20_000_000) -> np.ndarray:
    """Where each state ends: the signature of a fixed point, or -1 for a cycle. TooMany beyond `most` states.

    The states are closed under the rule first: each round steps the states that are
    new and merges them into the sorted list of those known. Then each pointer is
    doubled until it spans the closure, after which it stands on an attractor.
    """
    known = np.unique(states)
    to = step_signatures(known, model, rule)
    new = to
    while True:
        new = np.unique(new)
        at = np.searchsorted(known, new)
        seen = at < len(known)
        seen[seen] = known[at[seen]] == new[seen]
        new, at = new[~seen], at[~seen]
        if not len(new):
            break
        if len(known) + len(new) > most:
            raise TooMany(f"more than {most} states are reached")
        step = step_signatures(new, model, rule)
        known, to, new = np.insert(known, at, new), np.insert(to, at, step), step
    jump = np.searchsorted(known, to)
    step = jump
    for _ in range(max(1, int(len(known)).bit_length())):
        jump = jump[jump]
    ends = np.where(step[jump] == jump, known[jump], -1)
    return ends[np.searchsorted(known, states)]

"""Succession rules: how a batch of scenarios moves on.

A rule has step(digits, model) -> digits on arrays of shape (scenarios,
descriptors). It must be deterministic and depend on the scenario alone. A rule
whose fixed points are exactly the scenarios that no rival variant beats by more
than `margin` says so, which opens the fast kernel searches; others leave margin
None.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

import numpy as np

from ..model import Model


class Rule(Protocol):
    margin: int | None

    def step(self, digits: np.ndarray, model: Model) -> np.ndarray: ...


def balances(digits: np.ndarray, model: Model) -> np.ndarray:
    """Scores of all variants, (scenarios, dimensions)."""
    out = np.zeros((len(digits), model.dimensions), np.int64)
    for k, o in enumerate(model.offsets):
        out += model.matrix[o + digits[:, k]]
    return out


def _moved(block: np.ndarray, own: np.ndarray, margin: int) -> np.ndarray:
    """The best variant where it beats the incumbent by more than margin, else the incumbent; ties go to the lowest."""
    at = np.arange(len(block))
    best = block.argmax(axis=1)
    return np.where(block[at, best] - block[at, own] > margin, best, own)


@dataclass(frozen=True)
class Threshold:
    """All descriptors move at once, each only for a gain of more than m."""

    m: int = 0

    @property
    def margin(self) -> int:
        return self.m

    def step(self, digits: np.ndarray, model: Model) -> np.ndarray:
        b = balances(digits, model)
        return np.stack([_moved(b[:, o : o + n], digits[:, k], self.m) for k, (o, n) in enumerate(zip(model.offsets, model.sizes, strict=True))], axis=1)


@dataclass(frozen=True)
class Global(Threshold):
    """All descriptors move at once to their best variant; ties keep the incumbent."""

    m: int = 0


@dataclass(frozen=True)
class Sequential:
    """Descriptors move in order, each seeing the moves before it."""

    margin: int = 0

    def step(self, digits: np.ndarray, model: Model) -> np.ndarray:
        digits, b = digits.copy(), balances(digits, model)
        for k, (o, n) in enumerate(zip(model.offsets, model.sizes, strict=True)):
            to = _moved(b[:, o : o + n], digits[:, k], 0)
            b += model.matrix[o + to] - model.matrix[o + digits[:, k]]
            digits[:, k] = to
        return digits


GLOBAL, SEQUENTIAL = Global(), Sequential()


def margin_of(rule: Rule) -> int | None:
    return getattr(rule, "margin", None)


def succession_step(model: Model, digits, rule: Rule = GLOBAL) -> tuple[int, ...]:
    return tuple(int(x) for x in rule.step(np.array([model.check(digits)]), model)[0])


def succession_trace(model: Model, digits, rule: Rule = GLOBAL, max_steps: int | None = None) -> tuple[list[tuple[int, ...]], int]:
    """States up to the first repeated one, which is included, and the length of the cycle (1: fixed point; 0: stopped before)."""
    most = min(model.scenario_count() + 10, 10_000_000) if max_steps is None else max_steps
    states = [model.check(digits)]
    seen = {states[0]: 0}
    for k in range(1, most + 1):
        states.append(succession_step(model, states[-1], rule))
        if states[-1] in seen:
            return states, k - seen[states[-1]]
        seen[states[-1]] = k
    return states, 0


def fast_product(rule: Rule) -> bool:
    """Whether descriptors that do not act on each other move independently under it."""
    return type(rule) in (Global, Sequential)

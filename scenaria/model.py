"""Cross-impact models as immutable values.

A model has descriptors, each with variants, and a square matrix of integer
judgements: row = source variant, column = target variant. A scenario takes one
variant of each descriptor and is a list of 0-based digits; its signature reads
them as a mixed-radix number whose first digit is the least significant.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import cached_property
from math import prod

import numpy as np

INT64 = 2**63 - 1
#: What DECIMAL(38,0) holds; larger spaces are refused.
WIDEST = 10**38 - 1


@dataclass(frozen=True, eq=False)
class Model:
    """kernel: consistent scenarios that came with the model (None: not known)."""

    descriptors: tuple[str, ...]
    variants: tuple[tuple[str, ...], ...]
    matrix: np.ndarray
    kernel: tuple[tuple[int, ...], ...] | None = None

    def __post_init__(self):
        m = np.array(self.matrix, np.int64)
        m.setflags(write=False)
        object.__setattr__(self, "matrix", m)
        n = sum(map(len, self.variants))
        if len(self.descriptors) != len(self.variants):
            raise ValueError(f"{len(self.descriptors)} descriptors but {len(self.variants)} lists of variants")
        if any(not v for v in self.variants):
            raise ValueError("every descriptor needs a variant")
        if m.shape != (n, n):
            raise ValueError(f"the matrix is {m.shape}, but the variants need {n} x {n}")

    @classmethod
    def build(cls, sizes: Sequence[int], matrix) -> Model:
        """With names D1.., v0..; for synthetic models."""
        return cls(tuple(f"D{k + 1}" for k in range(len(sizes))), tuple(tuple(f"v{j}" for j in range(n)) for n in sizes), np.asarray(matrix))

    # -- shape ---------------------------------------------------------------
    @cached_property
    def sizes(self) -> tuple[int, ...]:
        return tuple(map(len, self.variants))

    @cached_property
    def offsets(self) -> tuple[int, ...]:
        return tuple(int(x) for x in np.cumsum((0, *self.sizes))[:-1])

    @cached_property
    def places(self) -> tuple[int, ...]:
        """Weight of each digit in the signature."""
        return tuple(prod(self.sizes[:k]) for k in range(len(self.sizes)))

    @property
    def dimensions(self) -> int:
        return len(self.matrix)

    def scenario_count(self) -> int:
        n = prod(self.sizes)
        if n > WIDEST:
            raise OverflowError(f"{n} scenarios: more than DECIMAL(38,0) can number. Split the model into its islands (split) first.")
        return n

    def max_signature(self) -> int:
        n = self.scenario_count()
        if n - 1 > INT64:
            raise OverflowError(f"{n} scenarios: signatures do not fit 64 bits. What still works: find_consistent with branch and bound, estimate_basins, transition_graph, and product_basins where the model splits.")
        return n - 1

    # -- scenarios -----------------------------------------------------------
    def check(self, digits: Sequence[int]) -> tuple[int, ...]:
        digits = tuple(int(x) for x in digits)
        if len(digits) != len(self.sizes):
            raise ValueError(f"{len(digits)} digits for {len(self.sizes)} descriptors: give one variant for each")
        for name, n, x in zip(self.descriptors, self.sizes, digits, strict=True):
            if not 0 <= x < n:
                raise ValueError(f'variant {x} of "{name}" is outside 0..{n - 1}')
        return digits

    def signature(self, digits: Sequence[int]) -> int:
        return sum(x * p for x, p in zip(self.check(digits), self.places, strict=True))

    def inv_signature(self, signature: int) -> tuple[int, ...]:
        if not 0 <= signature < self.scenario_count():
            raise ValueError(f"signature {signature} is outside 0..{self.scenario_count() - 1}")
        return tuple(signature // p % n for p, n in zip(self.places, self.sizes, strict=True))

    def impact_balance(self, digits: Sequence[int]) -> np.ndarray:
        rows = np.array(self.offsets) + np.array(self.check(digits))
        return self.matrix[rows].sum(axis=0)

    def inner_product(self, u: Sequence[int], v: Sequence[int]) -> int:
        """The balance of u, read at v's variants and summed."""
        return int(self.impact_balance(u)[np.array(self.offsets) + np.array(self.check(v))].sum())

    def named_balance(self, digits: Sequence[int]) -> dict[str, dict]:
        """By descriptor: scores of the variants, the selected one, and whether none beats it."""
        b, out = self.impact_balance(digits), {}
        for name, names, o, x in zip(self.descriptors, self.variants, self.offsets, digits, strict=True):
            block = b[o : o + len(names)]
            out[name] = {"scores": dict(zip(names, map(int, block), strict=True)), "selected": names[x], "consistent": bool(block[x] >= block.max())}
        return out

    def is_consistent(self, digits: Sequence[int]) -> bool:
        return all(x["consistent"] for x in self.named_balance(digits).values())

    # -- names ---------------------------------------------------------------
    def descriptor_index(self, key: str | int) -> int:
        if isinstance(key, str):
            if key not in self.descriptors:
                raise KeyError(f'no descriptor "{key}". Available: {", ".join(self.descriptors)}')
            return self.descriptors.index(key)
        if not 0 <= key < len(self.descriptors):
            raise IndexError(f"descriptor {key} is outside 0..{len(self.descriptors) - 1}")
        return int(key)

    def variant_index(self, descriptor: str | int, key: str | int) -> int:
        d = self.descriptor_index(descriptor)
        names = self.variants[d]
        if isinstance(key, str):
            if key not in names:
                raise KeyError(f'no variant "{key}" of "{self.descriptors[d]}". Available: {", ".join(names)}')
            return names.index(key)
        if not 0 <= key < len(names):
            raise IndexError(f'variant {key} of "{self.descriptors[d]}" is outside 0..{len(names) - 1}')
        return int(key)

    def resolve(self, scenario: Sequence[int | str] | Mapping) -> tuple[int, ...]:
        """Digits of a list (names or indices) or of a mapping that sets every descriptor exactly once."""
        if not isinstance(scenario, Mapping):
            if len(scenario) != len(self.sizes):
                raise ValueError(f"{len(scenario)} entries for {len(self.sizes)} descriptors: give one variant for each")
            return tuple(self.variant_index(d, v) for d, v in enumerate(scenario))
        found: dict[int, int] = {}
        for d, v in scenario.items():
            at = self.descriptor_index(d)
            if at in found:
                raise ValueError(f'descriptor "{self.descriptors[at]}" is given twice')
            found[at] = self.variant_index(at, v)
        if missing := [n for k, n in enumerate(self.descriptors) if k not in found]:
            raise ValueError(f"every descriptor must be given; missing: {', '.join(missing)}")
        return tuple(found[k] for k in range(len(self.sizes)))

    def names(self, digits: Sequence[int]) -> dict[str, str]:
        return {d: v[x] for d, v, x in zip(self.descriptors, self.variants, digits, strict=True)}

    # -- cells and edits: every edit gives a new model -------------------------
    def cell(self, source: tuple[str | int, str | int], target: tuple[str | int, str | int]) -> tuple[int, int]:
        return tuple(self.offsets[self.descriptor_index(d)] + self.variant_index(d, v) for d, v in (source, target))

    def get_impact(self, source, target) -> int:
        return int(self.matrix[self.cell(source, target)])

    def with_impact(self, source, target, value: int) -> Model:
        m = self.matrix.copy()
        m[self.cell(source, target)] = int(value)
        return replace(self, matrix=m, kernel=None)

    def fix(self, descriptor: str | int, variant: str | int) -> Model:
        """Pinned to one variant, which keeps its row and column; the kernel is no longer known."""
        d = self.descriptor_index(descriptor)
        v = self.variant_index(d, variant)
        keep = [k for k in range(self.dimensions) if not self.offsets[d] <= k < self.offsets[d] + self.sizes[d] or k == self.offsets[d] + v]
        variants = tuple((x[v],) if k == d else x for k, x in enumerate(self.variants))
        return Model(self.descriptors, variants, self.matrix[np.ix_(keep, keep)])

    def permuted(self, order: Sequence[int]) -> Model:
        """Descriptors in another order."""
        rows = [self.offsets[d] + j for d in order for j in range(self.sizes[d])]
        return Model(tuple(self.descriptors[d] for d in order), tuple(self.variants[d] for d in order), self.matrix[np.ix_(rows, rows)])

    def with_kernel(self, kernel: Iterable[Sequence[int]] | None) -> Model:
        return replace(self, kernel=None if kernel is None else tuple(tuple(map(int, x)) for x in kernel))

    def same_as(self, other: Model) -> bool:
        return self.descriptors == other.descriptors and self.variants == other.variants and np.array_equal(self.matrix, other.matrix)


def signature_order(scenarios: Iterable[Sequence[int]]) -> list[tuple[int, ...]]:
    """Ascending signature without working it out: digits compared from the last."""
    return sorted((tuple(int(x) for x in s) for s in scenarios), key=lambda s: s[::-1])

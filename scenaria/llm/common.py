"""What the operators of this folder share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import Scratch, materialise, shared_dir

__all__ = ["WHITESPACE", "Scratch", "let", "materialise", "shared_dir", "spread_join", "text_of", "thrifty", "tokenizer_path"]

#: The six characters `[\x20\x09-\x0D]` that count as white space in the contracts.
WHITESPACE = " \t\n\v\f\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once.

    Spark inlines an aliased column into each place that uses it, and inside a
    lambda that repeats it for every element; a lambda variable is not inlined.
    """
    return F.transform(F.array(value), body)[0]


def text_of(name: str = "text") -> Column:
    """A text column, null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: In a Python worker: how to drop what the operator that was served last remembers.
_last: list[Callable[[], object]] = []


def take_over(forget: Callable[[], object]) -> None:
    """What another operator remembers in this worker is dropped."""
    if _last and _last[0] is not forget:
        _last[0]()
    _last[:] = [forget]


def give_back() -> None:
    """Freed memory that the allocators of Arrow and C hold goes back to the system."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim:
        trim(0)


def thrifty(work: Callable[[Iterator], Iterator], forget: Callable[[], object]) -> Callable[[Iterator], Iterator]:
    """work on the batches of a task, such that the worker does not keep the memory of every task it ever ran.

    A worker serves one operator after the other, and what it holds counts against
    its executor also while it waits. forget: a function of a module, which drops what
    work remembers from task to task; the next task of the same operator finds it still.
    """

    @wraps(work)
    def run(batches: Iterator) -> Iterator:
        take_over(forget)
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


#: A key with fewer rows is never taken for a hot one.
LEAST_HOT = 1024
#: Hot keys that are broadcast, at most (a few numbers each).
MOST_HOT = 100_000


def hot_bound(total: int) -> int:
    """How many of `total` rows make a key hot: so many that fewer than MOST_HOT keys can be."""
    return max(LEAST_HOT, total // MOST_HOT + 1)


def spread_join(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """rows with the columns of the one row of groups that has their key; others are left out.

    groups: a table; size is its column with the number of rows a key has. Hot keys
    would each bring all their rows to one task: these rows stay where they are and
    meet the groups of hot keys by broadcast, which are few whatever the input is.
    Both are read more than once.
    """
    total, largest = groups.agg(F.sum(size), F.max(size)).first()
    bound = hot_bound(total or 0)
    if (largest or 0) < bound:
        return rows.join(groups, key)
    hot = groups.filter(F.col(size) >= bound)
    cool = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(groups.filter(F.col(size) < bound), key)
    return rows.join(F.broadcast(hot), key).unionByName(cool)

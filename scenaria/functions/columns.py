"""Column expressions over scenarios: encoding, scoring, succession, consistency.

A scenario is an array<int> column of digits or a bigint signature. Matrices are
literals, so everything stays in the JVM; the plan grows with descriptors times
variants, which suits small and middling models (larger ones go in batches).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import INT64, Model


def digits(signature: str, model: Model) -> Column:
    """array<int> of a signature column."""
    return F.array(*(digit(signature, model, k) for k in range(len(model.sizes))))


def digit(signature: str, model: Model, k: int) -> Column:
    """One digit of a signature column, in integer arithmetic."""
    return F.expr(f"cast(({signature} div {model.places[k]}) % {model.sizes[k]} as int)")


def signature(digits: Column, model: Model) -> Column:
    """bigint where the space fits, decimal(38,0) beyond; overflow is an error under ANSI."""
    kind = "bigint" if model.scenario_count() - 1 <= INT64 else "decimal(38,0)"
    total = F.lit(0).cast(kind)
    for k, p in enumerate(model.places):
        total = (total + digits[k].cast(kind) * F.lit(str(p)).cast(kind)).cast(kind)
    return total


def names(digits: Column, model: Model) -> Column:
    """map<descriptor, variant>."""
    pick = [F.element_at(F.array(*map(F.lit, vs)), digits[k] + 1) for k, vs in enumerate(model.variants)]
    return F.map_from_arrays(F.array(*map(F.lit, model.descriptors)), F.array(*pick))


def space(spark: SparkSession, model: Model, partitions: int | None = None) -> DataFrame:
    """sig, d0, d1, ...: the scenario space, lazily."""
    base = spark.range(0, model.max_signature() + 1, 1, partitions) if partitions else spark.range(model.max_signature() + 1)
    base = base.withColumnRenamed("id", "sig")
    return base.select("sig", *(digit("sig", model, k).alias(f"d{k}") for k in range(len(model.sizes))))


def score(model: Model, target: int, of: Sequence[Column]) -> Column:
    """The balance of one matrix column: a literal array looked up for each descriptor, constants folded."""
    total, fixed = None, 0
    for k, (o, n) in enumerate(zip(model.offsets, model.sizes, strict=True)):
        cells = model.matrix[o : o + n, target].tolist()
        if len(set(cells)) == 1:
            fixed += cells[0]
            continue
        term = F.element_at(F.array(*map(F.lit, cells)), of[k] + 1)
        total = term if total is None else total + term
    return F.lit(fixed) if total is None else total + F.lit(fixed) if fixed else total


def balance(model: Model, of: Sequence[Column]) -> list[Column]:
    return [score(model, c, of) for c in range(model.dimensions)]


def best(block: Sequence[Column], own: Column, margin: int = 0) -> Column:
    """The variant a descriptor moves to: greatest (score, incumbent, lowest index), or the incumbent within margin."""
    top = F.greatest(*(F.struct(s.cast("int").alias("s"), (own == j).alias("i"), F.lit(-j).alias("j")) for j, s in enumerate(block))) if len(block) > 1 else None
    if top is None:
        return F.lit(0)
    if not margin:
        return -top["j"]
    mine = F.element_at(F.array(*block), own + 1)
    lowest = F.greatest(*(F.struct(s.cast("int").alias("s"), F.lit(-j).alias("j")) for j, s in enumerate(block)))
    return F.when(lowest["s"] - mine > margin, -lowest["j"]).otherwise(own)


def step(model: Model, of: Sequence[Column], margin: int = 0) -> list[Column]:
    """Digits of the successor under the global (or a threshold) rule."""
    scores = balance(model, of)
    return [best(scores[o : o + n], of[k], margin) for k, (o, n) in enumerate(zip(model.offsets, model.sizes, strict=True))]


def consistent(model: Model, of: Sequence[Column], margin: int = 0) -> Column:
    """AND over descriptors, those with most variants first: a row leaves at the first that fails."""
    scores = balance(model, of)
    good = F.lit(True)
    for k in sorted(range(len(model.sizes)), key=lambda k: -model.sizes[k]):
        block = scores[model.offsets[k] : model.offsets[k] + model.sizes[k]]
        if len(block) > 1:
            good = good & (F.greatest(*block) - F.element_at(F.array(*block), of[k] + 1) <= margin)
    return good


def encode(model: Model, of: Sequence[Column]) -> Column:
    total = F.lit(0).cast("bigint")
    for p, d in zip(model.places, of, strict=True):
        total = total + d.cast("bigint") * F.lit(p)
    return total


def json_count(n: Column) -> Column:
    """Counts for JSON: beyond 2^53, where doubles lose units, as a string; a reader tells the two apart by their quotes."""
    return F.when(n > 2**53, F.concat(F.lit('"'), n.cast("string"), F.lit('"'))).otherwise(n.cast("string"))


def wilson(hits: Column, n: Column, z: float) -> tuple[Column, Column]:
    """Score interval of a binomial share, within 0 and 1."""
    share, spread = hits / n, F.lit(z * z) / n
    middle = (share + spread / 2) / (1 + spread)
    half = F.lit(z) * F.sqrt(share * (1 - share) / n + spread / (4 * n)) / (1 + spread)
    return F.greatest(F.lit(0.0), middle - half), F.least(F.lit(1.0), middle + half)

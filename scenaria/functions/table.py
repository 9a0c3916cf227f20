"""A table function for SQL: SELECT * FROM succession_trace(signature)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..model import Model
from ..plans.rules import GLOBAL, Rule, succession_trace
from ..session import ship


def register_trace(spark: SparkSession, model: Model, rule: Rule = GLOBAL, name: str = "succession_trace") -> None:
    """Rows step, sig, cycle_length: the states from a start to the first repeat (cycle_length 1: a fixed point)."""

    class Trace:
        def eval(self, start: int):
            states, length = succession_trace(model, model.inv_signature(start), rule)
            for k, u in enumerate(states):
                yield k, model.signature(u), length

    ship(spark).udtf.register(name, udtf(Trace, returnType="step int, sig bigint, cycle_length int"))

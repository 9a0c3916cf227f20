"""How long exact basins of a model would take here, from a timed part of its space."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import SparkSession

from ..model import Model
from ..plans.rules import GLOBAL, Rule
from .basins import basins_frame

#: Starts that are timed: so many that the work outweighs the start of a job.
TIMED = 4_000_000


@dataclass(frozen=True)
class Forecast:
    scenarios: int
    timed_starts: int
    starts_per_second: float
    seconds: float


def forecast_basins(spark: SparkSession, model: Model, rule: Rule = GLOBAL, starts: int = TIMED) -> Forecast:
    """The first `starts` of the space are counted and timed; the rest is taken to run at the same pace."""
    count = model.scenario_count()
    part = min(count, starts)
    began = time.perf_counter()
    basins_frame(spark, model, rule, 0, part - 1).count()
    pace = part / (time.perf_counter() - began)
    return Forecast(count, part, pace, count / pace)

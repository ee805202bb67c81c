"""Per-metric settings of the hierarchy."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SECOND = 1_000_000_000
#: Default settings, fixed values: 10 s, 365 days, 10.
INTERVAL_MIN, INTERVAL_MAX, FACTOR = 10 * SECOND, 365 * 86400 * SECOND, 10


@dataclass(frozen=True)
class SeriesConfig:
    """Levels are interval_min * interval_factor^k up to interval_max, in ns."""

    interval_min: int = INTERVAL_MIN
    interval_max: int = INTERVAL_MAX
    interval_factor: int = FACTOR
    input: str | None = None

    def __post_init__(self) -> None:
        if self.interval_min <= 0 or self.interval_max < self.interval_min:
            raise ValueError("interval_min must be positive and interval_max no less")
        if self.interval_factor < 2 or self.interval_min % self.interval_factor:
            raise ValueError("interval_factor must be 2 or more and divide interval_min")

    def levels(self) -> list[int]:
        out = [self.interval_min]
        while out[-1] <= self.interval_max // self.interval_factor:
            out.append(out[-1] * self.interval_factor)
        return out

    def choose(self, interval_max: int) -> tuple[int, int]:
        """The level that answers a request for interval_max, and the upper bound that regrouping uses."""
        upper = min(interval_max, self.interval_max)
        return max(x for x in self.levels() if x <= upper), upper


def check_evolution(old: dict[str, SeriesConfig], new: dict[str, SeriesConfig]) -> dict[str, SeriesConfig]:
    """Metrics may be added; the intervals of a known one never change; an input feeds one metric."""
    for name, config in new.items():
        if not name:
            raise ValueError("a metric needs a name")
        known = old.get(name)
        if known and (known.interval_min, known.interval_max, known.interval_factor) != (config.interval_min, config.interval_max, config.interval_factor):
            raise ValueError(f"the intervals of {name} can't change")
    merged = old | new
    inputs = [c.input for c in merged.values() if c.input]
    if len(inputs) != len(set(inputs)):
        raise ValueError("an input may feed only one metric")
    return merged


def config_frame(spark: SparkSession, configs: dict[str, SeriesConfig]) -> DataFrame:
    rows = [(m, c.input or m, c.interval_min, c.interval_max, c.interval_factor) for m, c in configs.items()]
    return spark.createDataFrame(rows, "metric string, input string, interval_min long, interval_max long, interval_factor long")


def level_frame(spark: SparkSession, configs: dict[str, SeriesConfig]) -> DataFrame:
    """(metric, levels)."""
    return spark.createDataFrame([(m, c.levels()) for m, c in configs.items()], "metric string, levels array<long>")


def read_configs(spark: SparkSession, path: str) -> dict[str, SeriesConfig]:
    """Settings of a JSON document {"metrics": {name: {"input": ..., "interval_min": ...}}}; unknown keys are errors."""
    import json

    text = spark.read.text(path, wholetext=True).first()[0]
    document = json.loads(text)
    if set(document) - {"metrics"}:
        raise ValueError(f"unknown keys {sorted(set(document) - {'metrics'})}")
    try:
        return check_evolution({}, {name: SeriesConfig(**settings) for name, settings in document["metrics"].items()})
    except TypeError as e:
        raise ValueError(str(e)) from e


def levels_of(interval_min: Column, interval_max: Column, factor: Column) -> Column:
    """The levels as an array column; powers that overflow are left out."""
    power = F.transform(F.sequence(F.lit(0), F.lit(62)), lambda k: F.pow(factor.cast("double"), k))
    whole = F.filter(power, lambda p: p * interval_min <= interval_max.cast("double"))
    exact = F.transform(whole, lambda p: p.cast("long") * interval_min)
    return F.filter(exact, lambda x: x <= interval_max)

"""The hierarchy: tumbling aggregates of every level, with empty stretches as runs.

Each sample's value holds since the sample before. A level's interval is complete when a later
sample reaches its end; only complete intervals are rows. Consecutive equal intervals within a gap
are one row with repeat; no gap is ever expanded interval by interval.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.algebra import FIELDS, added, held, is_decimal, times
from tidemark.operators.config import SeriesConfig, level_frame
from tidemark.operators.samples import Stretches, numbered, segments, stretches

COLUMNS = ("metric", "level", "time", "repeat", *FIELDS)


def segment_parts(seg: DataFrame, decimal: bool) -> DataFrame:
    """Rows (metric, level, b, repeat, FIELDS) of segments (metric, prev, time, value, level): what each adds to the intervals that
    it meets, at most three rows. Products stay within the segment, so none overflows."""
    one, lv = F.lit(1).cast("long"), F.col("level")
    seg = seg.withColumns({"b0": F.expr("prev div level"), "b1": F.expr("time div level")})
    part = lambda at, duration, n, repeat: F.struct(at.alias("b"), duration.alias("d"), F.lit(n).cast("long").alias("n"), repeat.alias("repeat"))
    # up to the end of its first interval, whole intervals, from the start of its last
    single = F.array(part(F.col("b1"), F.col("time") - F.col("prev"), 1, one))
    head = part(F.col("b0"), (F.col("b0") + 1) * lv - F.col("prev"), 0, one)
    run = part(F.col("b0") + 1, lv, 0, F.col("b1") - F.col("b0") - 1)
    tail = part(F.col("b1"), F.col("time") - F.col("b1") * lv, 1, one)
    parts = F.when(F.col("b0") == F.col("b1"), single).otherwise(F.filter(F.array(head, run, tail), lambda p: p["repeat"] > 0))
    rows = seg.select("metric", "level", "value", F.explode(parts).alias("p")).select("metric", "level", "value", "p.*")
    fields = held(F.col("value"), F.col("d"), F.col("n"), decimal)
    return rows.select("metric", "level", "b", "repeat", *(c.alias(k) for k, c in fields.items()))


def met(flat: DataFrame) -> DataFrame:
    """The parts of each interval added up, in each task before they move. A run is whole intervals with this one part each, so
    that it meets nothing: the parts are made once for both."""
    return flat.groupBy("metric", "level", "b", "repeat").agg(*added())


def raised(rows: DataFrame, levels: DataFrame | list[int], decimal: bool) -> DataFrame:
    """rows, what new samples add to the intervals of the lowest level (met()), as what they add to those of every level, each of which
    is a multiple of the lowest. A run keeps its shape: at most three rows for each level."""
    one, f = F.lit(1).cast("long"), F.col("f")
    rows = rows.join(levels, "metric") if isinstance(levels, DataFrame) else rows.withColumn("levels", F.array(*(F.lit(x).cast("long") for x in levels)))
    rows = rows.withColumn("up", F.explode("levels")).withColumn("f", F.expr("up div level"))
    rows = rows.withColumns({"p0": F.expr("b div f"), "p1": F.expr("(b + repeat - 1) div f")})
    part = lambda at, n, again: F.struct(at.alias("b"), n.alias("n"), again.alias("repeat"))
    same = F.array(part(F.col("b"), one, F.col("repeat")))
    single = F.array(part(F.col("p0"), F.col("repeat"), one))
    head = part(F.col("p0"), (F.col("p0") + 1) * f - F.col("b"), one)
    run = part(F.col("p0") + 1, f, F.col("p1") - F.col("p0") - 1)
    tail = part(F.col("p1"), F.col("b") + F.col("repeat") - F.col("p1") * f, one)
    parts = F.when(f == 1, same).when(F.col("p0") == F.col("p1"), single).otherwise(F.filter(F.array(head, run, tail), lambda p: p["repeat"] > 0))
    kinds = {c: rows.schema[c].dataType for c in ("sum", "integral")}
    rows = rows.select("metric", F.col("up").alias("level"), *FIELDS, F.explode(parts).alias("p")).withColumns(times(F.col("p.n"), decimal))
    return rows.select("metric", "level", "p.b", "p.repeat", *(F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in FIELDS))


#: Whether an interval, or run, ends by the metric's last sample.
COMPLETE = "b + repeat <= __last div level"


def new_parts(seg: DataFrame, levels: DataFrame | list[int], decimal: bool) -> DataFrame:
    """What segments (metric, prev, time, value) add to the intervals of all levels, not yet met but for the lowest."""
    if isinstance(levels, list):
        rows = met(segment_parts(seg.withColumn("level", F.lit(levels[0]).cast("long")), decimal))
        return rows if len(levels) == 1 else raised(rows, levels, decimal)
    lowest = levels.select("metric", F.get("levels", F.lit(0)).alias("level"))
    return raised(met(segment_parts(seg.join(lowest, "metric"), decimal)), levels, decimal)


def level_rows(raw: DataFrame, levels: list[int] | DataFrame, cuts: Stretches | None = None) -> DataFrame:
    """Rows (COLUMNS) of levels from raw (metric, time, value): samples meet intervals of the lowest level, and these those of the
    others. levels: of all metrics, or a frame (metric, levels), ascending."""
    last = raw.groupBy("metric").agg(F.max("time").alias("__last"))
    runs = new_parts(segments(raw, cuts), levels, is_decimal(raw))
    runs = (runs if isinstance(levels, list) and len(levels) == 1 else met(runs)).join(last, "metric").where(COMPLETE)
    return runs.select("metric", "level", (F.col("b") * F.col("level")).alias("time"), "repeat", *FIELDS)


def advanced(new: DataFrame, levels: DataFrame, state: DataFrame) -> DataFrame:
    """What new accepted samples (metric, time, value) add to a hierarchy: rows (COLUMNS, open, last). state and the open rows are
    each metric's and level's open interval so far, with the metric's last time; the other rows are the
    intervals now complete. Nothing older is read. levels: (metric, levels)."""
    was = state.groupBy("metric").agg(F.max("last").alias("__was"))
    now = new.groupBy("metric").agg(F.max("time").alias("__now"))
    seg = segments(new).join(was, "metric", "left").withColumn("prev", F.when(F.col("prev") == F.col("time"), F.coalesce("__was", "time")).otherwise(F.col("prev")))
    flat = new_parts(seg, levels, is_decimal(new))
    held_open = state.select("metric", "level", F.expr("time div level").alias("b"), F.lit(1).cast("long").alias("repeat"), *FIELDS)
    ends = now.join(was, "metric", "full").select("metric", F.coalesce("__now", "__was").alias("__last"))
    rows = met(flat.unionByName(held_open)).join(ends, "metric")
    return rows.select("metric", "level", (F.col("b") * F.col("level")).alias("time"), "repeat", *FIELDS, (~F.expr(COMPLETE)).alias("open"), F.col("__last").alias("last"))


def base_level(raw: DataFrame, level: int, cuts: Stretches | None = None) -> DataFrame:
    return level_rows(raw, [level], cuts)


def next_level(rows: DataFrame, factor: int, last: DataFrame) -> DataFrame:
    """The level above rows, which all are of one level; last (metric, last) tells which intervals are complete."""
    decimal = is_decimal(rows, "sum")
    one, f = F.lit(1).cast("long"), F.lit(factor).cast("long")
    rows = rows.withColumns({"i": F.expr("time div level"), "up": F.col("level") * factor})
    rows = rows.withColumns({"p0": F.expr(f"i div {factor}"), "p1": F.expr(f"(i + repeat - 1) div {factor}")})
    part = lambda at, n, repeat: F.struct(at.alias("b"), n.alias("times"), repeat.alias("again"))
    head = part(F.col("p0"), (F.col("p0") + 1) * f - F.col("i"), one)
    run = part(F.col("p0") + 1, f, F.col("p1") - F.col("p0") - 1)
    tail = part(F.col("p1"), F.col("i") + F.col("repeat") - F.col("p1") * f, one)
    single = F.array(part(F.col("p0"), F.col("repeat"), one))
    parts = F.when(F.col("p0") == F.col("p1"), single).otherwise(F.filter(F.array(head, run, tail), lambda p: p["again"] > 0))
    rows = rows.select("metric", "up", *FIELDS, F.explode(parts).alias("p")).select("metric", "up", *FIELDS, "p.*")
    n = F.col("times")
    rows = rows.withColumns(times(n, decimal))
    flat = rows.select("metric", "up", "b", F.col("again").alias("repeat"), *FIELDS)
    mixed = flat.where("repeat = 1").groupBy("metric", "up", "b").agg(*added()).withColumn("repeat", one)
    runs = flat.where("repeat > 1").unionByName(mixed).join(last, "metric")
    runs = runs.where("b + repeat <= last div up")
    kinds = {c: rows.schema[c].dataType for c in ("sum", "integral")}
    return runs.select("metric", F.col("up").alias("level"), (F.col("b") * F.col("up")).alias("time"), "repeat", *(F.col(c).cast(kinds[c]) if c in kinds else F.col(c) for c in FIELDS))


def hierarchy(raw: DataFrame, config: SeriesConfig) -> DataFrame:
    """Rows of all levels of metrics with one config."""
    return level_rows(raw, config.levels())


def rolled_up(rows: DataFrame, config: SeriesConfig, last: DataFrame) -> DataFrame:
    """All levels from rows of the lowest, without samples: each level from the one below. The same rows as
    hierarchy() makes, but for where runs are cut."""
    out = rows
    for _ in config.levels()[1:]:
        rows = next_level(rows, config.interval_factor, last)
        out = out.unionByName(rows)
    return out


def hierarchies(raw: DataFrame, configs: dict[str, SeriesConfig]) -> DataFrame:
    """The same for metrics of several configs, in one plan; samples of other metrics are left out."""
    if not configs:
        raise ValueError("no metric is configured")
    return level_rows(raw, level_frame(raw.sparkSession, configs))


def expand(rows: DataFrame, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """One row for each interval, within [start, end) of interval starts if given: a run gives no more rows
    than the window has intervals."""
    lo = F.col("time") if start is None else F.greatest(F.col("time"), F.ceil((start - F.col("time")) / F.col("level")).cast("long") * F.col("level") + F.col("time"))
    last = F.col("time") + (F.col("repeat") - 1) * F.col("level")
    hi = last if end is None else F.least(last, F.col("time") + F.expr("0L") + (F.floor((end - 1 - F.col("time")) / F.col("level"))).cast("long") * F.col("level"))
    rows = rows.withColumns({"__lo": lo, "__hi": hi}).where("__lo <= __hi")
    return rows.withColumn("time", F.explode(F.sequence("__lo", "__hi", "level"))).withColumn("repeat", F.lit(1).cast("long")).drop("__lo", "__hi")


def block_summary(raw: DataFrame, size: int = 1024) -> DataFrame:
    """Zone aggregates: one row for each size consecutive samples of a metric, from the sample before the block on."""
    cuts = stretches(raw, "time")
    rows = numbered(segments(raw, cuts), cuts).withColumn("block", F.expr(f"__i div {size}"))
    fields = held(F.col("value"), F.col("time") - F.col("prev"), F.lit(1), is_decimal(raw))
    flat = rows.select("metric", "block", "time", "prev", *(c.alias(k) for k, c in fields.items()))
    return flat.groupBy("metric", "block").agg(F.min("prev").alias("since"), F.min("time").alias("first"), F.max("time").alias("last"), *added())

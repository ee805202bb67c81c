"""History requests over raw samples and levels.

A request names a metric, a kind, a window [start, end) and the longest interval wanted. The plan
builder settles on the driver what needs no data (validity, level, factor), probes what does with
aggregates over pruned scans, and returns one declarative DataFrame with literal filters on metric,
level and time, so that they reach the files.

raw: metric, time, value. levels: metric, level, time, repeat and the six fields.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.algebra import FIELDS, added, held, is_decimal, or_empty, times
from tidemark.operators.config import SeriesConfig
from tidemark.operators.samples import ONE, STRETCH_ROWS, Stretches, nearest, segments, stretches

LAST_VALUE, AGGREGATE, AGGREGATE_TIMELINE, FLEX_TIMELINE = "LAST_VALUE", "AGGREGATE", "AGGREGATE_TIMELINE", "FLEX_TIMELINE"
#: Bytes that a point takes in a response, and the limit of a response: fixed values.
RAW_POINT, AGGREGATE_POINT, MAX_RESPONSE = 13, 53, 15 << 20


@dataclass(frozen=True)
class Request:
    metric: str
    type: str
    start: int = 0
    end: int = 0
    interval_max: int = 0

    def validate(self) -> None:
        if self.type == LAST_VALUE:
            return
        if self.start < 0 or self.end < self.start:
            raise ValueError("invalid time range")
        if self.type not in (AGGREGATE, AGGREGATE_TIMELINE, FLEX_TIMELINE):
            raise ValueError(f"unknown request type {self.type!r}")
        if self.is_aggregate and self.start >= self.end:
            raise ValueError("an aggregate needs start < end")

    @property
    def is_aggregate(self) -> bool:
        return self.type == AGGREGATE or self.interval_max < 0


class ResponseTooLarge(ValueError):
    """The response would be larger than the limit."""


def check_size(points: int, bytes_each: int, limit: int) -> None:
    if points > limit // bytes_each:
        raise ResponseTooLarge(f"about {points} points would exceed {limit} bytes; ask for a shorter range or a larger interval")


def last_value(raw: DataFrame, metric: str) -> DataFrame:
    """The metric's latest sample, or no row."""
    top = raw.where(F.col("metric") == metric).agg(F.max(F.struct("time", "value")).alias("p"))
    return top.where("p is not null").select("p.time", "p.value")


def _empty(raw: DataFrame, start: int) -> DataFrame:
    none = raw.sparkSession.range(1).select(F.lit(start).cast("long").alias("time"), *(F.lit(None).cast(k).alias(c) for c, k in zip(FIELDS, ("double", "double", "double", "long", "double", "long"), strict=True)))
    return none.select("time", *(c.alias(k) for k, c in or_empty().items()))


def _cuts(rows: DataFrame, n: int) -> Stretches:
    return ONE if n <= STRETCH_ROWS else stretches(rows, "time")


def aggregate(raw: DataFrame, metric: str, start: int, end: int) -> DataFrame:
    """One row: the aggregate of [start, end), which is clipped to the metric's samples; Empty if they don't meet.
    The first sample at or after the clipped end holds up to it without being counted."""
    first, last = _ends(raw, metric)
    if first is None or end <= first or start > last:
        return _empty(raw, start)
    total = _summed(raw, metric, max(start, first), min(end, last))
    return total.select(F.lit(start).cast("long").alias("time"), *(c.alias(k) for k, c in or_empty().items()))


def _ends(raw: DataFrame, metric: str) -> tuple[int | None, int | None]:
    return tuple(raw.where(F.col("metric") == metric).agg(F.min("time"), F.max("time")).first())


def _summed(raw: DataFrame, metric: str, lo: int, hi: int) -> DataFrame:
    """The aggregate of [lo, hi) within the metric's samples, in the type of the values."""
    own = raw.where((F.col("metric") == metric) & (F.col("time") >= lo))
    # one pass: the closing sample, and how many there are up to it
    close, n = own.agg(F.min(F.when(F.col("time") >= hi, F.col("time"))), F.count_if(F.col("time") < hi)).first()
    rows = own.where(F.col("time") <= close)
    rows = segments(rows, _cuts(rows, n))
    # the window's first sample has no sample before it in the window: it holds from the window's start
    since = F.when(F.col("prev") == F.col("time"), F.lit(lo)).otherwise(F.col("prev"))
    n = F.when(F.col("time") < hi, 1).otherwise(0)
    fields = held(F.col("value"), F.least(F.col("time"), F.lit(hi)) - since, n, is_decimal(raw))
    return rows.select(*(c.alias(k) for k, c in fields.items())).agg(*added())


def aggregate_from_levels(raw: DataFrame, levels: DataFrame, config: SeriesConfig, metric: str, start: int, end: int) -> DataFrame:
    """The same from the coarsest level that lies inside the window, and raw samples at its borders only: a
    long window reads a few intervals and less than two of them in samples."""
    first, last = _ends(raw, metric)
    if first is None or end <= first or start > last:
        return _empty(raw, start)
    lo, hi = max(start, first), min(end, last)
    inside = [x for x in config.levels() if hi // x - -(-lo // x) >= 1]
    if not inside:
        return aggregate(raw, metric, start, end)
    level = inside[-1] if len(inside) < 2 or hi // inside[-1] - -(-lo // inside[-1]) >= 2 else inside[-2]
    a, b = -(-lo // level) * level, hi // level * level
    rows = own_level(levels, metric, level).where((F.col("time") < b) & (F.col("time") + F.col("repeat") * level > a))
    lo_i, hi_i = F.greatest(F.col("time"), F.lit(a)), F.least(F.col("time") + F.col("repeat") * level, F.lit(b))
    middle = rows.withColumns(times(((hi_i - lo_i) / level).cast("long"), is_decimal(rows, "sum"))).select(*FIELDS)
    parts = [middle] + [_summed(raw, metric, x, y) for x, y in ((lo, a), (b, hi)) if x < y]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.agg(*added()).select(F.lit(start).cast("long").alias("time"), *(c.alias(k) for k, c in or_empty().items()))


def own_level(levels: DataFrame, metric: str, level: int) -> DataFrame:
    return levels.where((F.col("level") == level) & (F.col("metric") == metric))


def overlapping(rows: DataFrame, start: int, end: int) -> DataFrame:
    """Rows of levels cut to the window: time and repeat of the intervals whose start lies in
    [start - start % level, end). Both bounds reach the files: time is stored, and so is where a row ends."""
    lv = F.col("level")
    begin = F.lit(start) - F.lit(start) % lv
    rows = rows.where((F.col("time") < end) & F.lit(start < end))
    if "until" in rows.columns:
        rows = rows.where(F.col("until") > start)
    lo = F.greatest(F.col("time"), begin)
    hi = F.least(F.col("time") + (F.col("repeat") - 1) * lv, F.lit(end - 1))
    rows = rows.withColumns({"__lo": lo, "__hi": hi}).where("__hi >= __lo")
    return rows.withColumns({"time": F.col("__lo"), "repeat": F.expr("(__hi - __lo) div level + 1")}).drop("__lo", "__hi")


def timeline(levels: DataFrame, metric: str, level: int, start: int, end: int) -> DataFrame:
    """Each complete interval of a level in the window."""
    rows = overlapping(own_level(levels, metric, level), start, end)
    each = F.explode(F.sequence(F.col("time"), F.col("time") + (F.col("repeat") - 1) * level, F.lit(level).cast("long")))
    return rows.withColumn("time", each).select("time", *FIELDS)


def grouped(rows: DataFrame, decimal: bool, *keys: str) -> DataFrame:
    """rows (level, time, repeat, FIELDS, origin, span) in groups that are span long from origin on: a run gives a part to each
    group that it meets, no more rows than the answer has."""
    rows = rows.withColumns({"g0": F.expr("(time - origin) div span"), "g1": F.expr("(time + (repeat - 1) * level - origin) div span")})
    rows = rows.withColumn("g", F.explode(F.sequence("g0", "g1")))
    lo = F.greatest(F.col("time"), F.col("g") * F.col("span") + F.col("origin"))
    hi = F.least(F.col("time") + F.col("repeat") * F.col("level"), (F.col("g") + 1) * F.col("span") + F.col("origin"))
    rows = rows.withColumns({"__h": hi, "__l": lo})
    rows = rows.withColumns(times(F.expr("(__h - __l) div level"), decimal)).withColumn("time", F.col("g") * F.col("span") + F.col("origin"))
    return rows.groupBy(*keys, "time").agg(*added()).select(*keys, "time", *FIELDS)


def regrouped(levels: DataFrame, metric: str, level: int, factor: int, start: int, end: int, origin: int) -> DataFrame:
    """Groups of factor intervals one after another, from origin on, the first in the window; the last may be short.
    Intervals of a metric have no holes, so that a group is a stretch of time from the first."""
    rows = overlapping(own_level(levels, metric, level), start, end)
    rows = rows.withColumns({"origin": F.lit(origin).cast("long"), "span": F.lit(level * factor).cast("long")})
    return grouped(rows, is_decimal(levels, "sum"))


def raw_window(raw: DataFrame, metric: str, start: int, end: int) -> DataFrame:
    """Samples in [start, end) and the one at or before start."""
    own = raw.where(F.col("metric") == metric)
    before = own.where(F.col("time") <= start).agg(F.max("time")).first()[0]
    lo = start if before is None else before
    return own.where((F.col("time") >= lo) & (F.col("time") < end))


def raw_aggregates(rows: DataFrame, cuts: Stretches | None = None) -> DataFrame:
    """Each sample as an aggregate since the one before; the first of duration 0."""
    fields = held(F.col("value"), F.col("time") - F.col("prev"), F.lit(1), is_decimal(rows))
    return segments(rows, cuts).select("time", *(c.alias(k) for k, c in fields.items()))


def smoothed(rows: DataFrame, start: int, end: int, interval: int, cuts: Stretches | None = None) -> DataFrame:
    """One aggregate for each interval from start on, up to the last sample; the first holds all time since the
    sample before start."""
    seg = segments(rows, cuts).where(F.col("time") >= start)
    since = F.when(F.col("prev") == F.col("time"), F.lit(start)).otherwise(F.col("prev"))
    seg = seg.withColumn("since", since).withColumn("last", F.expr(f"(time - {start}) div {interval}"))
    first = F.expr(f"greatest(0L, since - {start}) div {interval}")
    cells = seg.withColumn("k", F.explode(F.sequence(first, F.col("last"))))
    lo = F.when(F.col("k") == 0, F.col("since")).otherwise(F.greatest(F.col("since"), F.col("k") * interval + start))
    d = F.least(F.col("time"), (F.col("k") + 1) * interval + start) - lo
    fields = held(F.col("value"), d, F.when(F.col("k") == F.col("last"), 1).otherwise(0), is_decimal(rows))
    out = cells.select("k", *(c.alias(k) for k, c in fields.items())).groupBy("k").agg(*added())
    return out.select((F.col("k") * interval + start).alias("time"), *FIELDS)


def history(raw: DataFrame, levels: DataFrame, configs: dict[str, SeriesConfig], request: Request, max_response: int = MAX_RESPONSE) -> DataFrame:
    """The response to a request, by time: (time, value), or (time, six fields). Metrics without config are errors,
    configured ones without samples give no rows."""
    if request.metric not in configs:
        raise KeyError(f"unknown metric {request.metric!r}")
    request.validate()
    config, metric, start, end = configs[request.metric], request.metric, request.start, request.end
    if request.type == LAST_VALUE:
        return last_value(raw, metric)
    if request.is_aggregate:
        return aggregate(raw, metric, start, end)
    if request.interval_max >= config.interval_min:
        level, upper = config.choose(request.interval_max)
        # one probe for all levels that a fallback may reach
        own = levels.where((F.col("metric") == metric) & F.col("level").isin([x for x in config.levels() if x <= level]))
        probe = overlapping(own, start, end).groupBy("level").agg(F.sum("repeat").alias("n"), F.min("time").alias("origin"))
        found = {r["level"]: r for r in probe.collect()}  # a row for each level
        while level >= config.interval_min and level not in found:
            level //= config.interval_factor
        if level < config.interval_min:
            return levels.select("time", *FIELDS).limit(0)
        factor = upper // level if request.type == FLEX_TIMELINE else 1
        check_size(-(-found[level]["n"] // factor), AGGREGATE_POINT, max_response)
        out = timeline(levels, metric, level, start, end) if factor == 1 else regrouped(levels, metric, level, factor, start, end, found[level]["origin"])
        return out.orderBy("time")
    rows = raw_window(raw, metric, start, end)
    n = rows.count()
    if request.type == AGGREGATE_TIMELINE:
        check_size(n, AGGREGATE_POINT, max_response)
        return raw_aggregates(rows, _cuts(rows, n)).orderBy("time")
    if n and request.interval_max > 0 and (end - start) // n < request.interval_max:
        check_size(min(n, (end - start) // request.interval_max + 1), AGGREGATE_POINT, max_response)
        return smoothed(rows, start, end, request.interval_max, _cuts(rows, n)).orderBy("time")
    check_size(n, RAW_POINT, max_response)
    return rows.select("time", "value").orderBy("time")


def delta_encoded(response: DataFrame) -> DataFrame:
    """A response as one row of parallel arrays; times as differences, the first absolute."""
    others = [c for c in response.columns if c != "time"]
    packed = response.agg(F.array_sort(F.collect_list(F.struct("time", *others))).alias("p"))
    delta = F.transform("p", lambda x, i: x["time"] - F.when(i > 0, F.get(F.col("p"), i - 1)["time"]).otherwise(0))
    field = lambda c: F.transform("p", lambda x: x[c]).alias(c)
    return packed.select(delta.alias("time_delta"), *map(field, others))


#: Requests (request_id, metric, type, start, end, interval_max) answered in one job.
REQUESTS = "request_id long, metric string, type string, start long, end long, interval_max long"


def timelines(levels: DataFrame, configs: dict[str, SeriesConfig], requests: DataFrame) -> DataFrame:
    """Timelines of many requests (REQUESTS) whose interval_max is at least their metric's interval_min: request_id, time and
    the six fields. Levels, fallbacks and origins are settled by one aggregate, in the same plan."""
    spark = levels.sparkSession
    rows = [(m, x, c.interval_max) for m, c in configs.items() for x in c.levels()]
    ladder = spark.createDataFrame(rows, "metric string, level long, __top long")
    asked = requests.withColumnRenamed("end", "__end").join(ladder, "metric").withColumn("upper", F.least("interval_max", "__top")).where("level <= upper and start < __end")
    own = levels.join(asked, ["metric", "level"]).where("time < __end and time + repeat * level > start")
    lo = F.greatest(F.col("time"), F.expr("start - start % level"))
    hi = F.least(F.expr("time + (repeat - 1) * level"), F.col("__end") - 1)
    own = own.withColumns({"__lo": lo, "__hi": hi}).where("__hi >= __lo")
    own = own.withColumns({"time": F.col("__lo"), "repeat": F.expr("(__hi - __lo) div level + 1")})
    # the coarsest level with a row answers
    chosen = own.groupBy("request_id").agg(F.max(F.struct("level", -F.col("time"))).alias("p")).select("request_id", F.col("p.level").alias("level"), (-F.col("p.col2")).alias("origin"))
    rows = own.join(chosen, ["request_id", "level"])
    span = F.when(F.col("type") == FLEX_TIMELINE, F.expr("upper div level * level")).otherwise(F.col("level"))
    return grouped(rows.withColumn("span", span), is_decimal(levels, "sum"), "request_id")


def last_values(raw: DataFrame) -> DataFrame:
    """Each metric's latest sample."""
    return raw.groupBy("metric").agg(F.max(F.struct("time", "value")).alias("p")).select("metric", "p.time", "p.value")


#: Samples in a cell of aggregate_windows, about, and cells that make one of the next step.
CELL_ROWS, STEP = 4096, 16


def aggregate_windows(raw: DataFrame, windows: DataFrame) -> DataFrame:
    """AGGREGATE for many windows (window_id, metric, start, end) in one job: window_id, start and the six fields.

    Samples are dealt to cells of about CELL_ROWS, and totals made of cells, of STEP cells, of STEP * STEP and so
    on. A window's first sample and the one that closes it are found as of its ends; of the samples between, those in its
    two border cells are read one by one, and the rest comes as at most 2 * STEP totals of each size."""
    decimal = is_decimal(raw)
    cuts = stretches(raw, "time", CELL_ROWS)
    seg = segments(raw, cuts)
    top = 0
    while STEP**top < cuts.count:
        top += 1
    ends = raw.groupBy("metric").agg(F.min("time").alias("first"), F.max("time").alias("last"))
    w = windows.withColumnRenamed("end", "__end").join(ends, "metric").where("__end > first and start <= last")
    w = w.select("window_id", "metric", F.greatest("start", "first").alias("lo"), F.least("__end", "last").alias("hi"))
    ends_of = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("lo").alias("at")), F.struct(F.lit(1).alias("side"), F.col("hi").alias("at"))))
    asked = w.select("window_id", "metric", "lo", "hi", ends_of.alias("e")).select("window_id", "metric", "lo", "hi", "e.*")
    near = nearest(seg.select("metric", "time", "prev", "value"), asked, True, cuts)
    side = lambda k: F.max(F.when(F.col("side") == k, F.col("p")))
    w = near.groupBy("window_id", "metric", "lo", "hi").agg(side(0).alias("f"), side(1).alias("c"))
    # what a window is made of: its first and closing samples, single samples of its border cells, and totals
    own = lambda v, d, n: F.struct(*(x.alias(k) for k, x in held(v, d, F.lit(n), decimal).items()))
    counted = F.col("f.time") < F.col("hi")
    opening = own(F.col("f.value"), F.col("f.time") - F.col("lo"), 1)
    closing = own(F.col("c.value"), F.col("hi") - F.greatest("lo", F.when(counted, F.col("c.prev")).otherwise(F.col("lo"))), 0)
    w = w.withColumns({"first": cuts.of(F.col("f.time")), "b0": cuts.of(F.col("hi"))}).withColumn("a0", F.col("first") + 1)
    piece = lambda k, cell, direct: F.struct(F.lit(k).alias("k"), cell.alias("cell"), direct.alias("own"))
    nothing = F.lit(None).cast(w.select(closing.alias("x")).schema["x"].dataType)
    border = F.transform(F.array_distinct(F.array("first", "b0")), lambda x: piece(-1, x, nothing))
    pieces = [F.when(counted, F.concat(F.array(piece(-2, F.lit(0).cast("long"), opening)), border)), F.array(piece(-2, F.lit(0).cast("long"), closing))]
    goes_on = counted & (F.col("a0") < F.col("b0"))
    run = lambda lo, hi: F.when(lo < hi, F.sequence(lo, hi - 1)).otherwise(F.array().cast("array<bigint>"))
    for k in range(top + 1):
        w = w.withColumns({f"a{k + 1}": F.expr(f"(a{k} + {STEP - 1}) div {STEP}"), f"b{k + 1}": F.expr(f"b{k} div {STEP}"), f"go{k}": goes_on})
        a, b, up_a, up_b = (F.col(f"{x}{j}") for j in (k, k + 1) for x in "ab")
        final = (up_a >= up_b) | F.lit(k == top)
        cells = F.when(final, run(a, b)).otherwise(F.concat(run(a, up_a * STEP), run(up_b * STEP, b)))
        pieces.append(F.when(F.col(f"go{k}"), F.transform(cells, lambda x: piece(k, x, nothing))))  # noqa: B023
        goes_on = F.col(f"go{k}") & ~final
    every = F.explode(F.flatten(F.filter(F.array(*pieces), lambda x: x.isNotNull())))
    w = w.select("window_id", "metric", "hi", F.col("f.time").alias("since"), every.alias("p")).select("window_id", "metric", "hi", "since", "p.*")
    flat = seg.select("metric", "time", cuts.of(F.col("time")).alias("cell"), *(c.alias(k) for k, c in held(F.col("value"), F.col("time") - F.col("prev"), F.lit(1), decimal).items()))
    totals = flat.groupBy("metric", "cell").agg(*added()).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(top))))
    totals = totals.groupBy("metric", "k", F.expr(f"cell div cast(pow({STEP}, k) as long)").alias("cell")).agg(*added())
    table = flat.withColumn("k", F.lit(-1)).unionByName(totals, allowMissingColumns=True)
    met = w.join(table, ["metric", "k", "cell"], "left").where("own is not null or time > since and time < hi or k >= 0 and count is not null")
    met = met.select("window_id", *(F.when(F.col("own").isNotNull(), F.col(f"own.{c}")).otherwise(F.col(c)).alias(c) for c in FIELDS))
    sums = met.groupBy("window_id").agg(*added())
    return windows.select("window_id", "start").join(sums, "window_id", "left").select("window_id", "start", *(c.alias(k) for k, c in or_empty().items()))

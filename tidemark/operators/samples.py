"""Samples: routing, decoding, acceptance, segments.

One long metric may hold a third of all rows, so nothing here sorts a metric as a whole: rows are
cut into stretches of arrival or time, each stretch is one window, and one row for each stretch
carries over what the next needs. Stretches follow the rows: quantiles of the column are cut evenly, into as many
stretches as the counted rows ask for, so that bursts are spread too.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.algebra import finite

#: Rows of a table in a stretch, about, and quantiles between which stretches are cut.
STRETCH_ROWS, QUANTILES = 1 << 16, 64


@dataclass(frozen=True)
class Stretches:
    """Ascending edges, each of which but the last begins `each` equally wide stretches."""

    edges: tuple[int, ...]
    each: int = 1

    @property
    def count(self) -> int:
        return self.each * max(1, len(self.edges) - 1)

    def of(self, column: Column) -> Column:
        """The number of a value's stretch, from 0; values outside belong to the first or the last, null to none: -1."""
        n = max(1, len(self.edges) - 1)
        ends = [self.edges[min(i + 1, len(self.edges) - 1)] for i in range(n)]

        # leaves are bare numbers: with more in them a stage's method is too long (8,000 bytes) for the JVM to compile
        def between(i: int, j: int) -> Column:
            if j - i <= 1:
                return F.lit(i).cast("long")
            middle = (i + j) // 2
            return F.when(column < self.edges[middle], between(i, middle)).otherwise(between(middle, j))

        found = between(0, n)
        if self.each > 1:
            of = lambda values: F.get(F.array(*(F.lit(x).cast("long") for x in values)), found.cast("int"))
            lo, hi = of(self.edges[:n]), of(ends)
            width = of([max(1, -(-(b - a + 1) // self.each)) for a, b in zip(self.edges, ends, strict=False)])
            at = F.floor((F.greatest(F.least(column, hi), lo) - lo) / width).cast("long")
            found = F.least(at, F.lit(self.each - 1).cast("long")) + found * self.each
        # what is used three times is computed once only where no condition guards it
        return F.coalesce(found + (column - column).cast("long"), F.lit(-1).cast("long"))


ONE = Stretches((0,))


def stretches(df: DataFrame, column: str, rows: int = STRETCH_ROWS) -> Stretches:
    """Stretches of about so many rows of df, by one pass over the column."""
    shares = [k / QUANTILES for k in range(1, QUANTILES)]
    n, lo, hi, inner = df.agg(F.count(column), F.min(column), F.max(column), F.percentile_approx(column, shares, 2000)).first()
    if n <= rows:
        return ONE
    edges = tuple(sorted({lo, *inner, hi}))
    return Stretches(edges, max(1, -(-n // (rows * max(1, len(edges) - 1)))))


def accept(samples: DataFrame, last: DataFrame | None = None, cuts: Stretches | None = None) -> DataFrame:
    """Of samples (metric, arrival, time, value) those later than every one accepted before: finite values with
    time above the greatest earlier finite time, above 0, and above last (metric, last) if given. The first
    arrival wins; arrivals that tie count by time, then value; a null arrival is the first."""
    cuts = cuts or stretches(samples, "arrival")
    counts = finite(F.col("value")) & F.col("time").isNotNull()
    rows = samples.withColumns({"__c": cuts.of(F.col("arrival")), "__t": F.when(counts, F.col("time"))})
    tops = rows.groupBy("metric", "__c").agg(F.max("__t").alias("__top"))
    earlier = Window.partitionBy("metric").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("metric", "__c", F.max("__top").over(earlier).alias("__before"))
    inside = Window.partitionBy("metric", "__c").orderBy("arrival", "time", "value").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__own", F.max("__t").over(inside)).join(tops, ["metric", "__c"])
    floor = F.greatest(F.coalesce("__own", F.lit(0)), F.coalesce("__before", F.lit(0)))
    if last is not None:
        rows = rows.join(last.select("metric", F.col("last").alias("__last")), "metric", "left")
        floor = F.greatest(floor, F.coalesce("__last", F.lit(0)))
    return rows.where(counts & (F.col("time") > floor)).select(*samples.columns)


def segments(raw: DataFrame, cuts: Stretches | None = None) -> DataFrame:
    """raw (metric, time, value) with prev, the metric's time before; the first sample's own time."""
    cuts = cuts or stretches(raw, "time")
    rows = raw.withColumn("__c", cuts.of(F.col("time")))
    ends = rows.groupBy("metric", "__c").agg(F.max("time").alias("__end"))
    ends = ends.select("metric", "__c", F.lag("__end").over(Window.partitionBy("metric").orderBy("__c")).alias("__before"))
    inside = Window.partitionBy("metric", "__c").orderBy("time")
    rows = rows.withColumn("prev", F.lag("time").over(inside)).join(ends, ["metric", "__c"])
    return rows.withColumn("prev", F.coalesce("prev", "__before", "time")).drop("__c", "__before")


def numbered(raw: DataFrame, cuts: Stretches | None = None) -> DataFrame:
    """raw with __i, the sample's number within its metric by time, from 0."""
    cuts = cuts or stretches(raw, "time")
    rows = raw.withColumn("__c", cuts.of(F.col("time")))
    counts = rows.groupBy("metric", "__c").agg(F.count("*").alias("n"))
    before = Window.partitionBy("metric").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("metric", "__c", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__first"))
    own = F.row_number().over(Window.partitionBy("metric", "__c").orderBy("time")) - 1
    rows = rows.withColumn("__own", own).join(counts, ["metric", "__c"])
    return rows.withColumn("__i", F.col("__own") + F.col("__first")).drop("__c", "__own", "__first")


def route(samples: DataFrame, configs: DataFrame) -> DataFrame:
    """samples (input, ...) with metric in place of input; inputs of no metric are an error."""
    known = configs.select("input", "metric")
    stray = samples.select("input").distinct().join(known, "input", "left_anti").limit(1).collect()
    if stray:
        raise ValueError(f"input {stray[0][0]!r} isn't configured")
    return samples.join(known, "input").drop("input")


def decode_chunks(chunks: DataFrame) -> DataFrame:
    """Points of chunks (metric, arrival, time_delta array, value array): times are running sums of the deltas.
    Arrays of different length and sums beyond 64 bits are errors; arrival counts on within a chunk."""
    same = F.size("time_delta") == F.size("value")
    checked = chunks.withColumn("__ok", F.when(same, F.lit(True)).otherwise(F.raise_error(F.lit("a chunk's times and values differ in length")).cast("boolean"))).where("__ok")
    add = lambda acc, d: F.struct((acc["t"] + d).alias("t"), F.concat(acc["out"], F.array(acc["t"] + d)).alias("out"))
    none = F.struct(F.lit(0).cast("long").alias("t"), F.array().cast("array<bigint>").alias("out"))
    times = F.aggregate("time_delta", none, add, lambda acc: acc["out"])
    points = checked.select("metric", "arrival", F.posexplode(F.arrays_zip(times.alias("time"), F.col("value"))).alias("pos", "p"))
    return points.select("metric", "arrival", "pos", F.col("p.time").alias("time"), F.col("p.value").alias("value"))


def encode_chunks(points: DataFrame, size: int = 500) -> DataFrame:
    """Chunks (metric, chunk, time_delta, value) of at most size points each (metric, time, value); the first time
    of a chunk is absolute."""
    rows = numbered(points).withColumn("chunk", F.expr(f"__i div {size}"))
    packed = rows.groupBy("metric", "chunk").agg(F.array_sort(F.collect_list(F.struct("time", "value"))).alias("p"))
    delta = F.transform("p", lambda x, i: x["time"] - F.when(i > 0, F.get(F.col("p"), i - 1)["time"]).otherwise(0))
    return packed.select("metric", "chunk", delta.alias("time_delta"), F.transform("p", lambda x: x["value"]).alias("value"))


def nearest(samples: DataFrame, asked: DataFrame, forward: bool, cuts: Stretches) -> DataFrame:
    """asked (metric, at, ...) with p, a struct of the columns of the metric's latest sample at or before at, or with forward the
    earliest at or after it; null without one. Samples and places asked for are united and cut into
    stretches; no place meets every sample."""
    fields = F.struct("time", *[c for c in samples.columns if c not in ("metric", "time")])
    others = [c for c in asked.columns if c not in ("metric", "at")]
    place = F.struct(*(F.col(c) for c in others))
    both = samples.select("metric", F.col("time").alias("at"), fields.alias("__s")).unionByName(asked.select("metric", "at", place.alias("__w")), allowMissingColumns=True)
    rows = both.withColumns({"__c": cuts.of(F.col("at")), "__asked": F.col("__w").isNotNull()})
    best, order = (F.min, F.desc) if forward else (F.max, F.asc)
    tops = rows.groupBy("metric", "__c").agg(best("__s").alias("__top"))
    around = Window.partitionBy("metric").orderBy(order("__c")).rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("metric", "__c", best("__top").over(around).alias("__around"))
    inside = Window.partitionBy("metric", "__c").orderBy(order("at"), "__asked").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__own", best("__s").over(inside)).where("__asked").join(tops, ["metric", "__c"])
    return rows.select("metric", "at", "__w.*", F.coalesce("__own", "__around").alias("p"))


def predecessors(raw: DataFrame, windows: DataFrame) -> DataFrame:
    """For windows (window_id, metric, start): the latest sample at or before start, null times without one."""
    asked = windows.select("metric", F.col("start").alias("at"), "window_id")
    found = nearest(raw.select("metric", "time", "value"), asked, False, stretches(raw, "time"))
    return found.select("window_id", "metric", F.col("at").alias("start"), F.col("p.time").alias("time"), F.col("p.value").alias("value"))

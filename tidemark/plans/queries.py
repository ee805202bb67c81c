"""Driver queries of the engine, one for each operator, and the same in SQL.

Series come from the test tables: `events` by event_type (dense) or user_id (sparse, with gaps), `orders`
by priority (disordered arrivals). Values are decimals, so that sums are the same in any order and engine.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.algebra import FIELDS, means
from tidemark.operators.config import SeriesConfig, config_frame
from tidemark.operators.hierarchy import base_level, block_summary, expand, hierarchy
from tidemark.operators.samples import accept, decode_chunks, encode_chunks, predecessors, route, segments
from tidemark.plans.history import (
    AGGREGATE,
    AGGREGATE_TIMELINE,
    FLEX_TIMELINE,
    LAST_VALUE,
    REQUESTS,
    Request,
    aggregate_from_levels,
    aggregate_windows,
    delta_encoded,
    last_values,
)

from tidemark.sources.store import Store, orphans
from tidemark.streaming.ingest import completed, write_to_store

S = 1_000_000_000
HOUR = 3600 * S
#: 1 h, 10 h, 100 h.
CONFIG = SeriesConfig(HOUR, 100 * HOUR, 10)
TYPES = ("click", "error", "purchase", "signup", "view")
METRIC = "view"
#: 2024-01-05 07:20:00.5, and the windows built on it.
START = 1704439200 * S + S // 2
DAY = 24 * HOUR
#: 2024-01-28 00:00:05: the 100 h interval that holds it never completes in the test tables.
LATE = 1706400000 * S + 5 * S
EXACT = "decimal(12,2)"


def events(spark: SparkSession, sf_dir: str, metric: str = "event_type", exact: bool = True) -> DataFrame:
    """Samples (metric, arrival, time, value) of the events table."""
    time = (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("time")
    value = F.col("value").cast(EXACT) if exact else F.col("value")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col(metric).cast("string").alias("metric"), F.col("event_id").alias("arrival"), time, value.alias("value"))


def raw_of(spark: SparkSession, sf_dir: str, metric: str = "event_type") -> DataFrame:
    return accept(events(spark, sf_dir, metric)).drop("arrival")


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles."""
    return df.select(*(F.col(c).cast("double").alias(c) if t.startswith("decimal") else F.col(c) for c, t in df.dtypes))


def one(raw: DataFrame) -> DataFrame:
    return raw.where(F.col("metric") == METRIC)


def folder_of(spark: SparkSession) -> str:
    """A new folder that all executors share; a temporary one only where no such folder is set."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return f"{told.rstrip('/')}/tidemark-{uuid.uuid4().hex}"
    made = tempfile.mkdtemp(prefix="tidemark-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    return f"file://{made}"


_stores: dict[tuple[str, str], Store] = {}


def store_of(spark: SparkSession, sf_dir: str) -> Store:
    """The events table in a store, made once for a session: requests read its files."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stores:
        store = Store(spark, folder_of(spark), value=EXACT)
        store.configure(dict.fromkeys(TYPES, CONFIG))
        store.append(events(spark, sf_dir))
        _stores[key] = store
    return _stores[key]


def ask(kind: str, start: int = 0, end: int = 0, interval: int = 0) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plain(store_of(spark, sf_dir).history(Request(METRIC, kind, start, end, interval)))

    return query


def many_timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five metrics, three requests each: of a level, regrouped, and one that falls back."""
    kinds = ((AGGREGATE_TIMELINE, START, START + 4 * DAY, 2 * HOUR), (FLEX_TIMELINE, START, START + 9 * DAY, 7 * HOUR), (FLEX_TIMELINE, LATE, LATE + 30 * HOUR, 1000 * HOUR))
    rows = [(3 * i + j, m, *k) for i, m in enumerate(TYPES) for j, k in enumerate(kinds)]
    return plain(store_of(spark, sf_dir).histories(spark.createDataFrame(rows, REQUESTS)))


def last_values_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(last_values(store_of(spark, sf_dir).raw()))


def accept_nonfinite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doubles, with NaN, infinite and null values among them: none of these is accepted nor moves the clock."""
    e = events(spark, sf_dir, exact=False)
    odd = F.when(F.col("arrival") % 7 == 0, F.lit(float("nan"))).when(F.col("arrival") % 11 == 0, F.lit(float("inf"))).when(F.col("arrival") % 13 == 0, F.lit(float("-inf")))
    return accept(e.withColumn("value", F.when(F.col("arrival") % 17 == 0, F.lit(None)).otherwise(F.coalesce(odd, "value"))))


def level_base_doubles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lowest level over doubles; sums to the cent, integrals to nine digits."""
    raw = accept(events(spark, sf_dir, exact=False)).drop("arrival")
    rows = expand(base_level(raw, HOUR))
    return rows.select("metric", "time", "minimum", "maximum", F.round("sum", 2).alias("sum"), "count", F.format_string("%.8e", F.col("integral")).alias("integral"), "active_time")


def accept_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    time = (F.unix_micros(F.col("o_orderdate").cast("timestamp")) * 1000).alias("time")
    return accept(orders.select(F.col("o_orderpriority").alias("metric"), F.col("o_orderkey").alias("arrival"), time, F.col("o_totalprice").alias("value")))


def segments_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(segments(raw_of(spark, sf_dir)).select("metric", "time", "prev", "value"))


def level_query(k: int) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = hierarchy(raw_of(spark, sf_dir), CONFIG).where(F.col("level") == CONFIG.levels()[k])
        return plain(expand(rows).select("metric", "time", *FIELDS))

    return query


def level_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(expand(base_level(raw_of(spark, sf_dir), 60 * S)).select("metric", "time", *FIELDS))


def level_runs_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(expand(base_level(raw_of(spark, sf_dir, "user_id"), HOUR)).select("metric", "time", *FIELDS))


def windows(spark: SparkSession) -> DataFrame:
    step = F.col("id") * 7 * HOUR + F.col("id")
    return spark.range(90).select(F.col("id").alias("window_id"), F.get(F.array(*map(F.lit, TYPES)), (F.col("id") % 5).cast("int")).alias("metric"), (START + step).alias("start"))


def predecessor_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(predecessors(raw_of(spark, sf_dir), windows(spark)))


def aggregate_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = windows(spark).withColumn("end", F.col("start") + (F.col("window_id") % 7 + 1) * 5 * HOUR)
    return aggregate_windows(raw_of(spark, sf_dir), asked)


def chunk_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = encode_chunks(raw_of(spark, sf_dir), 500).withColumnRenamed("chunk", "arrival")
    return plain(decode_chunks(chunks).select("metric", "time", "value"))


def response_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times and values of an encoded response, decoded again by their running sum."""
    packed = delta_encoded(store_of(spark, sf_dir).history(Request(METRIC, FLEX_TIMELINE, START, START + DAY)))
    each = packed.select(F.posexplode(F.arrays_zip("time_delta", "value")).alias("pos", "p"))
    return plain(each.select(F.col("pos").cast("long").alias("pos"), F.col("p.time_delta").alias("delta"), F.col("p.value").alias("value")))


def input_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    configs = {f"metric/{t}": SeriesConfig(HOUR, 100 * HOUR, 10, t) for t in TYPES}
    routed = route(events(spark, sf_dir).withColumnRenamed("metric", "input"), config_frame(spark, configs))
    return plain(routed.select("metric", "arrival", "time", "value"))


def union_hot_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store that holds the first days only, and a request that the rest, not committed, answers with it."""
    every, split = events(spark, sf_dir), START + 3 * DAY
    store = Store(spark, folder_of(spark), value=EXACT)
    store.configure(dict.fromkeys(TYPES, CONFIG))
    store.append(every.where(F.col("time") < split))
    last = store.state().groupBy("metric").agg(F.max("last").alias("last"))
    tail = accept(every.where(F.col("time") >= split), last)
    return plain(store.history(Request(METRIC, AGGREGATE_TIMELINE, START, START + 9 * DAY, 2 * HOUR), tail))


def block_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(block_summary(raw_of(spark, sf_dir)).select("metric", "block", "first", "last", *FIELDS))


def aggregate_from_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = store_of(spark, sf_dir)
    return plain(aggregate_from_levels(store.raw(metric=METRIC), store.levels(metric=METRIC), CONFIG, METRIC, START, START + 20 * DAY))


def mean_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = expand(base_level(raw_of(spark, sf_dir), HOUR))
    return rows.select("metric", "time", *(c.alias(k) for k, c in means().items()))


def orphans_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("k"), F.col("o_orderkey")).alias("path"))
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.concat(F.lit("k"), F.col("l_orderkey")).alias("path"))
    return orphans(orders, items)


def streamed(spark: SparkSession, sf_dir: str) -> Store:
    """The events table as a stream into a store: half of it, then, by a restart from the checkpoint, the rest; the store."""
    folder = folder_of(spark)
    source = spark.read.parquet(f"{sf_dir}/events.parquet")
    middle = source.agg(F.max("event_id")).first()[0] // 2
    store = Store(spark, f"{folder}/store", value=EXACT)
    store.configure(dict.fromkeys(TYPES, CONFIG))
    time = (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("time")
    for half in (source.where(F.col("event_id") <= middle), source.where(F.col("event_id") > middle)):
        half.write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(source.schema).parquet(f"{folder}/in")
        samples = stream.select(F.col("event_type").alias("metric"), F.col("event_id").alias("arrival"), time, F.col("value").cast(EXACT).alias("value"))
        write_to_store(samples, store, f"{folder}/checkpoint").awaitTermination()
    return store


def stream_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(streamed(spark, sf_dir).raw())


def stream_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = expand(streamed(spark, sf_dir).levels().where(F.col("level") == HOUR))
    return plain(rows.select("metric", "time", *FIELDS))


def stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator with its state within the stream, into files: 10 h intervals."""
    folder = folder_of(spark)
    source = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    time = (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("time")
    samples = stream.select(F.col("event_type").alias("metric"), F.col("event_id").alias("arrival"), time, "value")
    out = completed(samples, dict.fromkeys(TYPES, CONFIG)).writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint")
    out.trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    rows = expand(spark.read.parquet(f"{folder}/out").where(F.col("level") == 10 * HOUR))
    return rows.select("metric", "time", "minimum", "maximum", "count", "active_time")


def compacted(spark: SparkSession, sf_dir: str) -> Store:
    """Five appends, of which a selective and then a whole compaction merge the parts; an append after that goes on."""
    every = events(spark, sf_dir)
    top = every.agg(F.max("arrival")).first()[0]
    store = Store(spark, folder_of(spark), value=EXACT)
    store.configure(dict.fromkeys(TYPES, CONFIG))
    edges = [0, *(top * k // 6 for k in range(1, 6)), top + 1]
    for lo, hi in zip(edges[:5], edges[1:6], strict=True):
        store.append(every.where((F.col("arrival") >= lo) & (F.col("arrival") < hi)))
    before = store.snapshot()
    merged = store.compact(fan_in=2, full=3 * min(r for r, _ in before.raw.values()))
    whole = store.compact(whole=True)
    if not (len(before.raw) == 5 and 1 < len(merged.raw) < 5 and len(whole.raw) == len(whole.level) == 1 and not set(whole.raw) & set(before.raw)):
        raise RuntimeError("the parts weren't merged")
    store.append(every.where(F.col("arrival") >= edges[5]))
    store.vacuum(grace_ms=0)
    return store


def compact_invariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = expand(compacted(spark, sf_dir).levels().where(F.col("level") == HOUR))
    return plain(rows.select("metric", "time", *FIELDS))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "timeline_level": ask(AGGREGATE_TIMELINE, START, START + 9 * DAY, 2 * HOUR),
    "accept_filter": accept_filter,
    "segments": segments_query,
    "level_base": level_query(0),
    "level_mid": level_query(1),
    "level_top": level_query(2),
    "level_runs": level_runs,
    "level_runs_sparse": level_runs_sparse,
    "last_value": ask(LAST_VALUE),
    "aggregate_window": ask(AGGREGATE, START, START + 3 * DAY),
    "aggregate_clip_left": ask(AGGREGATE, 1, START),
    "aggregate_clip_right": ask(AGGREGATE, START, 9_000_000_000 * S),
    "aggregate_empty": ask(AGGREGATE, 1, 5),
    "aggregate_negative_interval": ask(FLEX_TIMELINE, START, START + DAY, -1),
    "aggregate_many_windows": aggregate_many,
    "aggregate_from_blocks": aggregate_from_blocks,
    "flex_level_regroup": ask(FLEX_TIMELINE, START, START + 9 * DAY, 7 * HOUR),
    "level_fallback": ask(FLEX_TIMELINE, LATE, LATE + 30 * HOUR, 1000 * HOUR),
    "many_timelines": many_timelines,
    "last_values": last_values_query,
    "accept_nonfinite": accept_nonfinite,
    "level_base_doubles": level_base_doubles,
    "timeline_raw_aggregates": ask(AGGREGATE_TIMELINE, START, START + DAY, 5),
    "flex_raw_values": ask(FLEX_TIMELINE, START, START + DAY, 0),
    "flex_raw_smoothing": ask(FLEX_TIMELINE, START, START + 2 * DAY, HOUR - S),
    "predecessor_asof": predecessor_asof,
    "chunk_roundtrip": chunk_roundtrip,
    "response_deltas": response_deltas,
    "input_mapping": input_mapping,
    "union_hot_tail": union_hot_tail,
    "block_summary": block_query,
    "mean_weighted": mean_weighted,
    "orphans_anti": orphans_anti,
    "stream_accept": stream_accept,
    "stream_levels": stream_levels,
    "stream_state": stream_state,
    "compact_invariance": compact_invariance,
}

_LAST = "(SELECT max(time) FROM raw)"


def _raw(metric: str = "event_type", only: bool = False) -> str:
    """CTEs raw (metric, time, value), with exact values, and seg with prev."""
    where = f"WHERE event_type = '{METRIC}'" if only else ""
    return f"""
raw0 AS (SELECT {metric}::VARCHAR AS metric, event_id AS arrival, epoch_ns(ts) AS time, value::DECIMAL(12,2) AS value FROM events {where}),
run AS (SELECT *, max(time) OVER (PARTITION BY metric ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM raw0),
raw AS (SELECT metric, time, value FROM run WHERE time > greatest(coalesce(top, 0), 0)),
seg AS (SELECT metric, time, value, coalesce(lag(time) OVER (PARTITION BY metric ORDER BY time), time) AS prev FROM raw)"""


_SUMS = """min(value)::DOUBLE AS minimum, max(value)::DOUBLE AS maximum, sum(value * n)::DOUBLE AS sum, sum(n)::BIGINT AS count,
  sum(value * d::DECIMAL(18,0))::DOUBLE AS integral, sum(d)::BIGINT AS active_time"""


def _cells(level: int) -> str:
    return f"""
cut AS (SELECT metric, value, time, prev, unnest(range(prev // {level}, time // {level} + 1)) AS b FROM seg),
cells AS (SELECT metric, value, b, least(time, (b + 1) * {level}) - greatest(prev, b * {level}) AS d, CASE WHEN b = time // {level} THEN 1 ELSE 0 END AS n FROM cut),
ends AS (SELECT metric, max(time) AS last FROM raw GROUP BY metric)"""


def _level(level: int, metric: str = "event_type", fields: str = _SUMS) -> str:
    return f"""WITH {_raw(metric)}, {_cells(level)}
SELECT c.metric, b * {level} AS time, {fields} FROM cells c JOIN ends e ON c.metric = e.metric
WHERE (b + 1) * {level} <= last GROUP BY c.metric, b"""


def _aggregate(start: int, end: int) -> str:
    return f"""WITH {_raw(only=True)}, lim AS (SELECT min(time) AS f, max(time) AS l FROM raw),
w AS (SELECT greatest({start}, f) AS b, least({end}, l) AS e, NOT ({end} <= f OR {start} > l) AS meets FROM lim),
r AS (SELECT time, value, lag(time) OVER (ORDER BY time) AS pt, b, e FROM raw, w WHERE meets AND time >= b),
k AS (SELECT value, least(time, e) - coalesce(pt, b) AS d, CASE WHEN time < e THEN 1 ELSE 0 END AS n FROM r WHERE time < e OR pt IS NULL OR pt < e),
a AS (SELECT {_SUMS} FROM k)
SELECT {start}::BIGINT AS time, coalesce(minimum, 'inf'::DOUBLE) AS minimum, coalesce(maximum, '-inf'::DOUBLE) AS maximum, coalesce(sum, 0) AS sum,
  coalesce(count, 0) AS count, coalesce(integral, 0) AS integral, coalesce(active_time, 0) AS active_time FROM a"""


def _timeline(level: int, factor: int, start: int, end: int) -> str:
    return f"""WITH {_raw(only=True)}, {_cells(level)},
g AS (SELECT b * {level} AS bt, value, d, n FROM cells WHERE (b + 1) * {level} <= {_LAST} AND b * {level} >= {start - start % level} AND b * {level} < {end}),
o AS (SELECT *, (bt - (SELECT min(bt) FROM g)) // {level} // {factor} AS grp FROM g)
SELECT min(bt) AS time, {_SUMS} FROM o GROUP BY grp"""


def _flex(upper: int, start: int, end: int) -> str:
    """A flexible timeline by the coarsest level up to upper that has an interval in the window."""
    levels = ", ".join(f"({x})" for x in CONFIG.levels() if x <= upper)
    return f"""WITH {_raw(only=True)}, lv(level) AS (VALUES {levels}),
cut AS (SELECT level, value, time, prev, unnest(range(prev // level, time // level + 1)) AS b FROM seg, lv),
g AS (SELECT level, b * level AS bt, value, least(time, (b + 1) * level) - greatest(prev, b * level) AS d, CASE WHEN b = time // level THEN 1 ELSE 0 END AS n
  FROM cut WHERE (b + 1) * level <= {_LAST} AND b * level >= {start} - {start} % level AND b * level < {end}),
o AS (SELECT *, (bt - (SELECT min(bt) FROM g WHERE level = (SELECT max(level) FROM g))) // level // ({upper} // level) AS grp FROM g WHERE level = (SELECT max(level) FROM g))
SELECT min(bt) AS time, {_SUMS} FROM o GROUP BY grp"""


def _window(start: int, end: int) -> str:
    """CTEs with rs: the samples of a raw window, its predecessor and lag."""
    return f"""{_raw(only=True)},
rs0 AS (SELECT time, value FROM raw WHERE time >= coalesce((SELECT max(time) FROM raw WHERE time <= {start}), {start}) AND time < {end}),
rs AS (SELECT time, value, lag(time) OVER (ORDER BY time) AS pt FROM rs0)"""


_M = HOUR - S
#: The fields that doubles give in any order.
_EXACT = "min(value)::DOUBLE AS minimum, max(value)::DOUBLE AS maximum, sum(n)::BIGINT AS count, sum(d)::BIGINT AS active_time"
_WINDOWS = f"""w AS (SELECT i AS window_id, [{", ".join(f"'{t}'" for t in TYPES)}][i % 5 + 1] AS metric, {START} + i * 7 * {HOUR} + i AS start FROM (SELECT unnest(range(90)) AS i))"""

ORACLE: dict[str, str] = {
    "timeline_level": _timeline(HOUR, 1, START, START + 9 * DAY),
    "accept_filter": """
WITH s AS (SELECT o_orderpriority AS metric, o_orderkey AS arrival, epoch_ns(o_orderdate) AS time, o_totalprice AS value FROM orders),
r AS (SELECT *, max(CASE WHEN isfinite(value) THEN time END) OVER (PARTITION BY metric ORDER BY arrival, time, value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM s)
SELECT metric, arrival, time, value FROM r WHERE isfinite(value) AND time > greatest(coalesce(top, 0), 0)""",
    "segments": f"WITH {_raw()} SELECT metric, time, prev, value::DOUBLE AS value FROM seg",
    "level_base": _level(HOUR),
    "level_mid": _level(10 * HOUR),
    "level_top": _level(100 * HOUR),
    "level_runs": _level(60 * S),
    "level_runs_sparse": _level(HOUR, "user_id"),
    "last_value": f"WITH {_raw(only=True)} SELECT time, value::DOUBLE AS value FROM raw ORDER BY time DESC LIMIT 1",
    "aggregate_window": _aggregate(START, START + 3 * DAY),
    "aggregate_clip_left": _aggregate(1, START),
    "aggregate_clip_right": _aggregate(START, 9_000_000_000 * S),
    "aggregate_empty": _aggregate(1, 5),
    "aggregate_negative_interval": _aggregate(START, START + DAY),
    "aggregate_many_windows": f"""WITH {_raw()}, {_WINDOWS},
v AS (SELECT w.*, start + (window_id % 7 + 1) * 5 * {HOUR} AS "end" FROM w),
lim AS (SELECT metric, min(time) AS f, max(time) AS l FROM raw GROUP BY metric),
u AS (SELECT v.window_id, v.metric, v.start, greatest(v.start, f) AS b, least("end", l) AS e FROM v JOIN lim ON v.metric = lim.metric WHERE NOT ("end" <= f OR v.start > l)),
r AS (SELECT u.window_id, s.time, s.value, b, e, lag(s.time) OVER (PARTITION BY u.window_id ORDER BY s.time) AS pt FROM u JOIN raw s ON s.metric = u.metric AND s.time >= b),
k AS (SELECT window_id, value, least(time, e) - coalesce(pt, b) AS d, CASE WHEN time < e THEN 1 ELSE 0 END AS n FROM r WHERE time < e OR pt IS NULL OR pt < e),
a AS (SELECT window_id, {_SUMS} FROM k GROUP BY window_id)
SELECT v.window_id, v.start, coalesce(minimum, 'inf'::DOUBLE) AS minimum, coalesce(maximum, '-inf'::DOUBLE) AS maximum, coalesce(sum, 0) AS sum,
  coalesce(count, 0) AS count, coalesce(integral, 0) AS integral, coalesce(active_time, 0) AS active_time FROM v LEFT JOIN a ON v.window_id = a.window_id""",
    "aggregate_from_blocks": _aggregate(START, START + 20 * DAY),
    "flex_level_regroup": _timeline(HOUR, 7, START, START + 9 * DAY),
    "level_fallback": _flex(100 * HOUR, LATE, LATE + 30 * HOUR),
    "many_timelines": f"""WITH {_raw()}, lv(level) AS (VALUES {", ".join(f"({x})" for x in CONFIG.levels())}),
k(j, flex, a, z, upper) AS (VALUES (0, false, {START}, {START + 4 * DAY}, {2 * HOUR}), (1, true, {START}, {START + 9 * DAY}, {7 * HOUR}), (2, true, {LATE}, {LATE + 30 * HOUR}, {100 * HOUR})),
m AS (SELECT i, [{", ".join(f"'{t}'" for t in TYPES)}][i + 1] AS metric FROM (SELECT unnest(range(5)) AS i)),
ends AS (SELECT metric, max(time) AS last FROM raw GROUP BY metric),
cut AS (SELECT metric, level, value, time, prev, unnest(range(prev // level, time // level + 1)) AS b FROM seg, lv),
g AS (SELECT 3 * i + j AS request_id, flex, upper, c.metric, level, b * level AS bt, value, least(time, (b + 1) * level) - greatest(prev, b * level) AS d, CASE WHEN b = time // level THEN 1 ELSE 0 END AS n
  FROM cut c JOIN m ON c.metric = m.metric JOIN ends e ON c.metric = e.metric, k WHERE level <= upper AND (b + 1) * level <= last AND b * level >= a - a % level AND b * level < z),
t AS (SELECT request_id, max(level) AS level FROM g GROUP BY request_id),
f AS (SELECT g.*, min(bt) OVER (PARTITION BY g.request_id) AS o FROM g JOIN t ON g.request_id = t.request_id AND g.level = t.level),
x AS (SELECT *, (bt - o) // level // CASE WHEN flex THEN upper // level ELSE 1 END AS grp FROM f)
SELECT request_id::BIGINT AS request_id, min(bt) AS time, {_SUMS} FROM x GROUP BY request_id, grp""",
    "last_values": f"WITH {_raw()} SELECT metric, max(time) AS time, arg_max(value, time)::DOUBLE AS value FROM raw GROUP BY metric",
    "accept_nonfinite": """
WITH s AS (SELECT event_type AS metric, event_id AS arrival, epoch_ns(ts) AS time, CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 7 = 0 THEN 'nan'::DOUBLE
  WHEN event_id % 11 = 0 THEN 'inf'::DOUBLE WHEN event_id % 13 = 0 THEN '-inf'::DOUBLE ELSE value END AS value FROM events),
r AS (SELECT *, max(CASE WHEN isfinite(value) THEN time END) OVER (PARTITION BY metric ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM s)
SELECT metric, arrival, time, value FROM r WHERE isfinite(value) AND time > greatest(coalesce(top, 0), 0)""",
    "level_base_doubles": _level(HOUR, fields="""min(value)::DOUBLE AS minimum, max(value)::DOUBLE AS maximum, sum(value * n)::DOUBLE AS sum, sum(n)::BIGINT AS count,
  printf('%.8e', sum(value * d::DECIMAL(18,0))::DOUBLE) AS integral, sum(d)::BIGINT AS active_time"""),
    "timeline_raw_aggregates": f"""WITH {_window(START, START + DAY)}
SELECT time, value::DOUBLE AS minimum, value::DOUBLE AS maximum, value::DOUBLE AS sum, 1::BIGINT AS count,
  (value * coalesce(time - pt, 0)::DECIMAL(18,0))::DOUBLE AS integral, coalesce(time - pt, 0)::BIGINT AS active_time FROM rs""",
    "flex_raw_values": f"WITH {_window(START, START + DAY)} SELECT time, value::DOUBLE AS value FROM rs",
    "flex_raw_smoothing": f"""WITH {_window(START, START + 2 * DAY)},
p AS (SELECT time, value, coalesce(pt, {START}) AS pt, (time - {START}) // {_M} AS kl FROM rs WHERE time >= {START}),
c AS (SELECT *, unnest(range(greatest(0, pt - {START}) // {_M}, kl + 1)) AS k FROM p),
x AS (SELECT k, value, least(time, {START} + (k + 1) * {_M}) - CASE WHEN k = 0 THEN pt ELSE greatest(pt, {START} + k * {_M}) END AS d, CASE WHEN k = kl THEN 1 ELSE 0 END AS n FROM c)
SELECT {START} + k * {_M} AS time, {_SUMS} FROM x GROUP BY k""",
    "predecessor_asof": f"""WITH {_raw()}, {_WINDOWS},
m AS (SELECT w.window_id, max(r.time) AS time FROM w JOIN raw r ON r.metric = w.metric AND r.time <= w.start GROUP BY w.window_id)
SELECT w.window_id, w.metric, w.start, m.time, r.value::DOUBLE AS value FROM w LEFT JOIN m ON m.window_id = w.window_id LEFT JOIN raw r ON r.metric = w.metric AND r.time = m.time""",
    "chunk_roundtrip": f"WITH {_raw()} SELECT metric, time, value::DOUBLE AS value FROM raw",
    "response_deltas": f"WITH {_window(START, START + DAY)} SELECT row_number() OVER (ORDER BY time) - 1 AS pos, time - coalesce(pt, 0) AS delta, value::DOUBLE AS value FROM rs",
    "input_mapping": "SELECT 'metric/' || event_type AS metric, event_id AS arrival, epoch_ns(ts) AS time, value FROM events",
    "union_hot_tail": _timeline(HOUR, 1, START, START + 9 * DAY),
    "block_summary": f"""WITH {_raw()},
nb AS (SELECT *, (row_number() OVER (PARTITION BY metric ORDER BY time) - 1) // 1024 AS block, time - prev AS d, 1 AS n FROM seg)
SELECT metric, block, min(time) AS first, max(time) AS last, {_SUMS} FROM nb GROUP BY metric, block""",
    "mean_weighted": _level(HOUR, fields="CASE WHEN sum(n) > 0 THEN sum(value * n)::DOUBLE / sum(n) END AS mean, CASE WHEN sum(d) > 0 THEN sum(value * d::DECIMAL(18,0))::DOUBLE / sum(d) END AS weighted_mean"),
    "orphans_anti": "SELECT DISTINCT 'k' || o_orderkey AS path FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
    "stream_accept": f"WITH {_raw()} SELECT metric, time, value::DOUBLE AS value FROM raw",
    "stream_levels": _level(HOUR),
    "stream_state": _level(10 * HOUR, fields=_EXACT),
    "compact_invariance": _level(HOUR),
}

"""Streaming ingest: accepted samples and completed intervals, exactly once.

write_to_store() keeps the state in the store: each batch is appended as one version, which holds the batch's number
for its stream. Whatever a crash leaves undone is done again or found done; state, samples and intervals change
together. The store's open intervals seed any new stream.

completed() is the same as an operator within a stream, without a store. State of a metric: its last accepted time and the open
interval of each level. A batch's samples of one metric are sorted by one task, in bounded memory: more than RUN_ROWS of them through
sorted runs in a temporary file; late and repeated samples are dropped; wall time closes nothing.
Output rows are samples (level 0) and level rows with repeat, as the batch plans make them.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions.algebra import FIELDS
from tidemark.operators.config import SeriesConfig, config_frame
from tidemark.operators.samples import decode_chunks, route
from tidemark.sources.store import Files, Store
from tidemark.streaming.code import ship
from tidemark.streaming.runs import RUN_ROWS, accepted, in_order

OUTPUT = "metric string, level long, time long, repeat long, value double, minimum double, maximum double, sum double, count long, integral double, active_time long"
STATE = "last long, bucket array<long>, minimum array<double>, maximum array<double>, sum array<double>, count array<long>, integral array<double>, active_time array<long>"
#: Points that a delivered chunk holds at most: arrivals of chunks are so far apart.
CHUNK_POINTS = 1 << 20
NAMES = [c.split()[0] for c in OUTPUT.split(", ")]


def intervals(time: np.ndarray, prev: np.ndarray, value: np.ndarray, level: int, open_at: int | None, held: list) -> tuple[pd.DataFrame, int, list]:
    """Completed rows of one level for new segments, and the interval that stays open with its aggregate."""
    b0, b1 = prev // level, time // level
    same, far = b0 == b1, b1 - b0 > 1

    def rows(b, repeat, v, d, n) -> pd.DataFrame:
        return pd.DataFrame({"b": b, "repeat": repeat, "minimum": v, "maximum": v, "sum": np.where(n > 0, v, 0.0), "count": n, "integral": v * d, "active_time": d})

    one = lambda mask: np.ones(mask.sum(), np.int64)
    every = np.ones(len(time), bool)
    head = rows(b0[~same], one(~same), value[~same], (b0[~same] + 1) * level - prev[~same], 0 * one(~same))
    run = rows(b0[far] + 1, b1[far] - b0[far] - 1, value[far], level * one(far), 0 * one(far))
    tail = rows(b1, one(every), value, np.where(same, time - prev, time - b1 * level), one(every))
    parts = [head, run[run["repeat"] == 1], tail]
    if open_at is not None:
        parts.append(pd.DataFrame([[open_at, 1, *held]], columns=["b", "repeat", *FIELDS]))
    mixed = pd.concat([p for p in parts if len(p)], ignore_index=True).groupby("b", as_index=False).agg(
        {"repeat": "max", "minimum": "min", "maximum": "max", "sum": "sum", "count": "sum", "integral": "sum", "active_time": "sum"}
    )
    now = int(b1[-1])
    left = mixed[mixed["b"] == now]
    done = pd.concat([mixed[mixed["b"] < now], run[run["repeat"] > 1]], ignore_index=True)
    return done, now, [left[c].iloc[0].item() for c in FIELDS]


def advance(config: SeriesConfig, metric: str, pdf: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple | None]:
    """Output rows and the new state for one metric's new samples."""
    pdf = pdf.sort_values(["arrival", "time", "value"])
    time, value = pdf["time"].to_numpy(np.int64), pdf["value"].to_numpy(float)
    last = state[0] if state else 0
    keep = accepted(time, value, last)
    time, value = time[keep], value[keep]
    if not len(time):
        return pd.DataFrame(columns=NAMES), state
    prev = np.r_[last if state else time[0], time[:-1]]
    out = [pd.DataFrame({"level": 0, "time": time, "repeat": 1, "value": value})]
    after: list[list] = [[] for _ in range(7)]
    for i, level in enumerate(config.levels()):
        held = [state[2 + f][i] for f in range(6)] if state else []
        done, now, left = intervals(time, prev, value, level, state[1][i] if state else None, held)
        out.append(done.assign(level=level, time=done["b"] * level).drop(columns="b"))
        for f, x in enumerate([now, *left]):
            after[f].append(x)
    table = pd.concat([x for x in out if len(x)], ignore_index=True).reindex(columns=NAMES)
    table["metric"] = metric
    return table, (int(time[-1]), *after)


def advances(config: SeriesConfig, metric: str, batches: Iterable[pd.DataFrame], state: tuple | None, rows: int = RUN_ROWS) -> Iterator[tuple[pd.DataFrame, tuple | None]]:
    """The same for new samples in any number, about so many at once: output rows and the state after them."""
    for pdf in in_order(batches, state[0] if state else 0, rows):
        table, state = advance(config, metric, pdf, state)
        yield table, state


def completed(samples: DataFrame, configs: dict[str, SeriesConfig], rows: int = RUN_ROWS) -> DataFrame:
    """A stream of samples (metric, arrival, time, value) as a stream of OUTPUT rows; a metric that isn't configured is an error. rows: samples
    that a task sorts at once."""
    ship(samples.sparkSession)

    def step(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if key[0] not in configs:
            raise ValueError(f"metric {key[0]!r} isn't configured")
        kinds, new = {"level": "int64", "time": "int64", "repeat": "int64"}, None
        for table, new in advances(configs[key[0]], key[0], batches, state.get if state.exists else None, rows):
            yield table.astype(kinds)
        if new is not None:
            state.update(new)

    # as in accept(): a null arrival is the first; a null time is none, and time 0 is never accepted
    arrival, time = F.coalesce(F.col("arrival").cast("long"), F.lit(-(1 << 63))), F.coalesce("time", F.lit(0).cast("long"))
    chosen = samples.select("metric", arrival.alias("arrival"), time.alias("time"), F.col("value").cast("double").alias("value"))
    return chosen.groupBy("metric").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def stream_id(store: Store, checkpoint: str) -> str:
    """The id that Spark gave the stream of a checkpoint: the same after every restart."""
    return json.loads(Files(store.spark, checkpoint.rstrip("/")).read("metadata"))["id"]


def write_to_store(samples: DataFrame, store: Store, checkpoint: str, **trigger) -> StreamingQuery:
    """Appends a stream of samples (metric, arrival, time, value) to a store, one version a batch."""

    def commit(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            store.append(batch, (stream_id(store, checkpoint), number))
        finally:
            batch.unpersist()

    return samples.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def write_chunks_to_store(chunks: DataFrame, store: Store, checkpoint: str, **trigger) -> StreamingQuery:
    """The same for deliveries of chunks (input, arrival, time_delta, value): they are decoded, and inputs renamed to
    the metrics that they feed. arrival is a delivery's number; its points count on within it."""

    def commit(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            routed = route(batch, config_frame(store.spark, store.configs()))
            points = decode_chunks(routed)
            store.append(points.select("metric", "time", "value", (F.col("arrival") * CHUNK_POINTS + F.col("pos")).alias("arrival")), (stream_id(store, checkpoint), number))
        finally:
            batch.unpersist()

    return chunks.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

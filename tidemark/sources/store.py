"""A store of raw samples and levels in a folder: Parquet parts and versioned snapshots.

Layout: raw/part=<id>/shard=<n>/ and level/part=<id>/open=<bool>/level=<l>/shard=<n>/, sorted within files by metric and
time, so that file statistics prune. The open rows of the newest level part are the state: each metric's and
level's interval that no later sample has reached the end of, with the metric's last time. An append reads
the state and the new samples, nothing older.

snapshots/<version>.json says which parts a version adds and drops; every FULL_EVERY versions a .full.json beside it holds
the whole, so that opening reads a bounded number of files. A version is committed by giving a finished
file its name, which fails if another writer was first: readers see whole versions only, and a reader
keeps the version that it opened. Files go through Spark's Hadoop file systems. Where these rename without a check
(object stores), only one writer may be active.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.algebra import finite
from tidemark.operators.config import SeriesConfig, check_evolution, config_frame, level_frame
from tidemark.operators.hierarchy import COLUMNS, advanced, hierarchies
from tidemark.operators.samples import accept

KINDS = ("raw", "level")
#: Versions between whole snapshots; parts of fewer rows than FULL_ROWS may be merged, FAN_IN or more at once.
FULL_EVERY, FULL_ROWS, FAN_IN = 16, 20_000_000, 4
#: Small parts are merged whatever their sizes once the newest is so old. Parts that nothing names are deleted when they are older
#: than the grace, which must cover the longest write.
REST_MS, GRACE_MS = 3_600_000, 6 * 3_600_000


class Conflict(RuntimeError):
    """Another writer committed first."""


def orphans(listed: DataFrame, reachable: DataFrame) -> DataFrame:
    """Paths that are listed but not reachable."""
    return listed.select("path").distinct().join(reachable.select("path"), "path", "left_anti")


class Files:
    """The few file operations that Spark's readers and writers lack, on any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        jvm = spark._jvm
        self.path = lambda p: jvm.org.apache.hadoop.fs.Path(f"{root}/{p}")
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.path("").getFileSystem(self.conf)
        self.jvm = jvm

    def create(self, name: str, text: str) -> None:
        """Creates a file that must not exist: its content is written aside, then given the name."""
        aside, path = self.path(f".{uuid.uuid4().hex}.tmp"), self.path(name)
        out = self.fs.create(aside, False)
        out.write(bytearray(text.encode()))
        out.close()
        self.fs.mkdirs(path.getParent())
        try:
            if self.fs.getScheme() == "file":
                local = lambda p: self.jvm.java.nio.file.Path.of(p.toUri().getPath(), self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("java.lang.String"), 0))
                self.jvm.java.nio.file.Files.createLink(local(path), local(aside))  # fails if there is one; a rename would not
            else:
                options = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
                self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self.conf).rename(aside, path, options)
        except Exception as e:
            if "AlreadyExists" in str(e):
                raise Conflict(name) from e
            raise
        finally:
            self.fs.delete(aside, False)

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        text = self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return text

    def names(self, folder: str) -> list[str]:
        if not self.fs.exists(self.path(folder)):
            return []
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self.path(folder)))

    def age_ms(self, name: str) -> int:
        return self.jvm.java.lang.System.currentTimeMillis() - self.fs.getFileStatus(self.path(name)).getModificationTime()

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


@dataclass
class Snapshot:
    """A version: its parts as {id: [rows, written at ms]}, the part whose open rows are the state, configs, the last batch
    of each stream, and running counts."""

    version: int = 0
    raw: dict[str, list[int]] = field(default_factory=dict)
    level: dict[str, list[int]] = field(default_factory=dict)
    state: str = ""
    configs: dict[str, dict] = field(default_factory=dict)
    streams: dict[str, int] = field(default_factory=dict)
    counts: dict[str, int] = field(default_factory=dict)

    def delta(self, new: Snapshot) -> dict:
        out: dict = {"version": new.version, "state": new.state}
        for name in ("raw", "level", "configs", "streams", "counts"):
            old, now = getattr(self, name), getattr(new, name)
            out[name] = {"put": {k: v for k, v in now.items() if old.get(k) != v}, "gone": [k for k in old if k not in now]}
        return out

    def after(self, delta: dict) -> Snapshot:
        changed = {k: {x: v for x, v in (getattr(self, k) | delta[k]["put"]).items() if x not in delta[k]["gone"]} for k in ("raw", "level", "configs", "streams", "counts")}
        return Snapshot(version=delta["version"], state=delta["state"], **changed)


def due(parts: dict[str, list[int]], full: int = FULL_ROWS, fan_in: int = FAN_IN, rested: bool = False) -> list[list[str]]:
    """Runs of small neighbouring parts worth one rewrite: fan_in or more of which none outweighs the others, so that rows
    are rewritten a logarithmic number of times, or enough to fill a part; any two if they have rested."""
    out, run = [], []

    def close() -> None:
        group = run[:]
        while len(group) > 1:
            sizes = [parts[p][0] for p in group]
            if rested or sum(sizes) >= full or len(group) >= fan_in and 2 * max(sizes) <= sum(sizes):
                out.append(group)
                break
            group = group[1:]
        run.clear()

    for part, (rows, _) in parts.items():
        if rows >= full:
            close()
        else:
            run.append(part)
            if sum(parts[p][0] for p in run) >= full:
                close()
    close()
    return out


class Store:
    """value: the type of values, double or a decimal, whose sums are the same in any order."""

    def __init__(self, spark: SparkSession, root: str, shards: int = 8, value: str = "double"):
        self.spark, self.root, self.shards = spark, root.rstrip("/"), shards
        self.files = Files(spark, self.root)
        total = "double" if value == "double" else "decimal(38,2)"
        self.value = value
        self.schemas = {
            "raw": f"metric string, time long, value {value}, shard int, part string",
            "level": f"metric string, time long, repeat long, minimum {value}, maximum {value}, sum {total}, count long, integral {total}, active_time long, "
            "until long, last long, open boolean, level long, shard int, part string",
        }

    # snapshots

    def snapshot(self, version: int | None = None) -> Snapshot:
        names = self.files.names("snapshots")
        known = sorted(int(x.split(".")[0]) for x in names if not x.endswith(".full.json"))
        whole = sorted(int(x.split(".")[0]) for x in names if x.endswith(".full.json"))
        target = version if version is not None else max(known, default=0)
        if target and target not in known:
            raise KeyError(f"no version {target}")
        start = max((v for v in whole if v <= target), default=0)
        out = Snapshot(**json.loads(self.files.read(f"snapshots/{start:012d}.full.json"))) if start else Snapshot()
        for v in range(start + 1, target + 1):
            out = out.after(json.loads(self.files.read(f"snapshots/{v:012d}.json")))
        return out

    def commit(self, base: Snapshot, **changes) -> Snapshot:
        """The version after base; Conflict if there is one already."""
        new = Snapshot(**{**asdict(base), **changes, "version": base.version + 1})
        self.files.create(f"snapshots/{new.version:012d}.json", json.dumps(base.delta(new)))
        if new.version % FULL_EVERY == 0:  # a help to readers: deltas alone say the same
            self.files.create(f"snapshots/{new.version:012d}.full.json", json.dumps(asdict(new)))
        return new

    def configs(self, snapshot: Snapshot | None = None) -> dict[str, SeriesConfig]:
        return {m: SeriesConfig(**c) for m, c in (snapshot or self.snapshot()).configs.items()}

    def configure(self, configs: dict[str, SeriesConfig]) -> Snapshot:
        """Adds metrics; what a known one has can't change."""
        base = self.snapshot()
        return self.commit(base, configs={m: asdict(c) for m, c in check_evolution(self.configs(base), configs).items()})

    # reading

    def _read(self, kind: str, parts: list[str]) -> DataFrame:
        """All columns of parts, by one scan."""
        if not parts:
            return self.spark.createDataFrame([], self.schemas[kind])
        return self.spark.read.schema(self.schemas[kind]).option("basePath", f"{self.root}/{kind}").parquet(*(f"{self.root}/{kind}/part={p}" for p in parts))

    def raw(self, snapshot: Snapshot | None = None, metric: str | None = None) -> DataFrame:
        return self._pick(self._read("raw", list((snapshot or self.snapshot()).raw)), metric).select("metric", "time", "value")

    def levels(self, snapshot: Snapshot | None = None, metric: str | None = None) -> DataFrame:
        """Complete intervals: COLUMNS, and until, where a row ends."""
        rows = self._pick(self._read("level", list((snapshot or self.snapshot()).level)), metric)
        return rows.where("not open").select(*COLUMNS, "until")

    def state(self, snapshot: Snapshot | None = None) -> DataFrame:
        """Open intervals: COLUMNS and last."""
        snapshot = snapshot or self.snapshot()
        return self._read("level", [snapshot.state] if snapshot.state else []).where("open").select(*COLUMNS, "last")

    def _pick(self, rows: DataFrame, metric: str | None) -> DataFrame:
        # the shard is a folder: only its files are read
        return rows if metric is None else rows.where((F.col("metric") == metric) & (F.col("shard") == F.pmod(F.xxhash64(F.lit(metric)), F.lit(self.shards)).cast("int")))

    def history(self, request, tail: DataFrame | None = None, max_response: int | None = None) -> DataFrame:
        """A response over one pinned version, and a tail of accepted samples not yet committed if given: their intervals are
        made from the state, as an append would."""
        from tidemark.plans import history as h

        pinned = self.snapshot()
        raw, levels, configs = self.raw(pinned, request.metric), self.levels(pinned, request.metric), self.configs(pinned)
        if tail is not None:
            new = tail.where(F.col("metric") == request.metric).select("metric", "time", F.col("value").cast(self.value).alias("value"))
            raw = raw.unionByName(new)
            if request.metric in configs:
                frame = level_frame(self.spark, {request.metric: configs[request.metric]})
                fresh = advanced(new, frame, self.state(pinned).where(F.col("metric") == request.metric)).where("not open")
                levels = levels.unionByName(self._ended(fresh).select(*COLUMNS, "until"))
        return h.history(raw, levels, configs, request, max_response or h.MAX_RESPONSE)

    def histories(self, requests: DataFrame) -> DataFrame:
        """Level timelines of many requests in one job."""
        from tidemark.plans import history as h

        pinned = self.snapshot()
        return h.timelines(self.levels(pinned), self.configs(pinned), requests)

    # writing

    def _ended(self, rows: DataFrame) -> DataFrame:
        """level rows with until; an open one may end beyond the largest time."""
        until = F.when(F.col("repeat") * F.col("level") <= F.lit((1 << 63) - 1) - F.col("time"), F.col("time") + F.col("repeat") * F.col("level")).otherwise(F.lit((1 << 63) - 1))
        return rows.withColumn("until", until)

    def _write(self, rows: DataFrame, kind: str, level_of_compression: int = 1) -> tuple[str, list[int]]:
        part = uuid.uuid4().hex
        keys = (["open", "level"] if kind == "level" else []) + ["shard"]
        rows = rows.withColumn("shard", F.pmod(F.xxhash64("metric"), F.lit(self.shards)).cast("int"))
        names = [f.split()[0] for f in self.schemas[kind].split(", ")]
        kinds = dict(f.split() for f in self.schemas[kind].split(", "))
        rows = rows.select(*(F.col(n).cast(kinds[n]).alias(n) for n in names if n != "part"))
        # salted by time: a metric with a third of all rows fills several files
        rows = rows.repartition(*keys, F.pmod(F.xxhash64("metric", F.expr("time div 86400000000000")), F.lit(4)))
        writer = rows.sortWithinPartitions(*keys, "metric", "time").write.partitionBy(*keys)
        writer.option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(level_of_compression)).parquet(f"{self.root}/{kind}/part={part}")
        return part, [self._read(kind, [part]).count(), int(time.time() * 1000)]  # the files' footers say how many

    def append(self, samples: DataFrame, mark: tuple[str, int] | None = None) -> Snapshot:
        """Accepts samples (metric, arrival, time, value) and commits them with the intervals that they complete. mark: a stream
        and its batch's number; a batch that the store has isn't taken again. Counts what isn't accepted."""
        base = self.snapshot()
        if mark and base.streams.get(mark[0], -1) >= mark[1]:
            return base
        configs = self.configs(base)
        known = config_frame(self.spark, configs).select("metric") if configs else self.spark.createDataFrame([], "metric string")
        # one pass: samples received, how many of them no number, and a metric that isn't configured
        bad = F.count_if(~F.coalesce(finite(F.col("value")), F.lit(False)))
        told = samples.groupBy("metric").agg(F.count("*").alias("n"), bad.alias("bad")).join(known.withColumn("known", F.lit(True)), "metric", "left")
        received, unfit, stray = told.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0)), F.max(F.when(F.col("known").isNull(), F.struct("metric")))).first()
        if stray:
            raise ValueError(f"metric {stray[0]!r} isn't configured")
        state = self.state(base)
        rows = accept(samples, state.groupBy("metric").agg(F.max("last").alias("last")))
        raw, told = self._write(rows.select("metric", "time", "value"), "raw")
        new = self._read("raw", [raw]).select("metric", "time", "value")
        level, level_told = self._write(self._ended(advanced(new, level_frame(self.spark, configs), state)), "level")
        found = {"received": received, "accepted": told[0], "unfit": unfit, "late": received - told[0] - unfit, "appends": 1}
        counts = {k: base.counts.get(k, 0) + v for k, v in found.items()}
        streams = base.streams | ({mark[0]: mark[1]} if mark else {})
        return self.commit(base, raw=base.raw | {raw: told}, level=base.level | {level: level_told}, state=level, streams=streams, counts=counts)

    # maintenance

    def compact(self, whole: bool = False, full: int = FULL_ROWS, fan_in: int = FAN_IN, rest_ms: int = REST_MS, pool: str | None = None) -> Snapshot:
        """Merges runs of small parts that are due, or with whole all parts of each kind, sorted and compressed harder; large and
        unchanged parts are left alone, and without anything due there is no new version. Readers of older versions aren't
        disturbed. pool: the scheduler pool that the rewriting runs in."""
        base, now = self.snapshot(), int(time.time() * 1000)
        if pool:
            self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", pool)
        changed, state = {}, base.state
        for kind in KINDS:
            parts = dict(getattr(base, kind))
            rested = bool(parts) and now - max(t for _, t in parts.values()) >= rest_ms
            groups = ([list(parts)] if len(parts) > 1 else []) if whole else due(parts, full, fan_in, rested)
            for group in groups:
                rows = self._read(kind, group)
                if kind == "level":
                    rows = rows.where(~F.col("open") | (F.col("part") == state)) if state in group else rows.where("not open")
                made, told = self._write(rows.drop("part", "shard"), kind, 9)
                parts = {made if p == group[0] else p: told if p == group[0] else v for p, v in parts.items() if p not in group[1:]}
                state = made if kind == "level" and state in group else state
            if groups:
                changed[kind] = parts
        if pool:
            self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)
        return self.commit(base, state=state, **changed) if changed else base

    def listed(self) -> DataFrame:
        rows = [(f"{kind}/{p}",) for kind in KINDS for p in self.files.names(kind)]
        return self.spark.createDataFrame(rows, "path string")

    def reachable(self, keep: int = 1) -> DataFrame:
        """Parts of the newest keep versions, with how many of these name them."""
        newest = self.snapshot().version
        rows = [(f"{kind}/part={p}",) for v in range(max(1, newest - keep + 1), newest + 1) for kind in KINDS for p in getattr(self.snapshot(v), kind)]
        return self.spark.createDataFrame(rows, "path string").groupBy("path").agg(F.count("*").alias("versions"))

    def vacuum(self, keep: int = 1, grace_ms: int = GRACE_MS) -> list[str]:
        """Deletes parts that none of the newest versions names and that are older than the grace, which covers
        parts being written. The candidates are parts, not rows: few."""
        found = [r.path for r in orphans(self.listed(), self.reachable(keep)).collect()]
        gone = [p for p in found if self.files.age_ms(p) >= grace_ms]
        for p in gone:
            self.files.delete(p)
        return gone

    def maintain(self, keep: int = 1, **options) -> dict:
        """One round of maintenance: compaction, then vacuum; what it did."""
        before = self.snapshot()
        after = self.compact(**options)
        return {"merged": {k: len(set(getattr(before, k)) - set(getattr(after, k))) for k in KINDS}, "version": after.version, "deleted": self.vacuum(keep)}

    def statistics(self) -> DataFrame:
        """Of each part: kind, files, bytes, rows, whether the newest version names it, and its fill: tenths of FULL_ROWS."""
        newest = self.snapshot()
        live = {f"{kind}/part={p}": rows for kind in KINDS for p, (rows, _) in getattr(newest, kind).items()}
        rows = []
        for path in (r.path for r in self.listed().collect()):
            summary = self.files.fs.getContentSummary(self.files.path(path))
            n = live.get(path)
            rows.append((path.split("/")[0], path, summary.getFileCount(), summary.getLength(), n, path in live, None if n is None else min(10, 10 * n // FULL_ROWS)))
        return self.spark.createDataFrame(rows, "kind string, path string, files long, bytes long, rows long, live boolean, fill int")

    def rebuilt(self) -> DataFrame:
        """All levels made anew from the raw samples: what levels() must hold but for where runs are cut."""
        return hierarchies(self.raw(), self.configs())

"""Plans of history requests against the model."""

import math
import random

import model
import pytest
from pyspark.sql import functions as F
from tidemark.functions.algebra import FIELDS
from tidemark.operators.config import SeriesConfig
from tidemark.operators import hierarchy as hierarchy_module
from tidemark.operators.hierarchy import expand, hierarchy, rolled_up
from tidemark.operators.samples import Stretches, accept
from tidemark.plans.history import Request, ResponseTooLarge, aggregate_from_levels, aggregate_windows, delta_encoded, history

CONFIG = SeriesConfig(100, 10000, 10)


def series(seed, n=250):
    rng, t, out = random.Random(seed), 0, []
    for _ in range(n):
        t += rng.choice([1, 7, 30, 100, 250, 1000, 12000, -20, 0, 50])
        out.append((t, rng.choice([float(rng.randint(-50, 50)), math.nan, math.inf, 3.0])))
    return out


@pytest.fixture(scope="module")
def data(spark):
    points = {"a": series(1), "b": series(2), "one": [(150, 2.0)], "five": [(110, 2.0), (120, 4.0), (200, 8.0), (230, -2.0), (400, 3.0)]}
    rows = [(m, i, t, v) for m, p in points.items() for i, (t, v) in enumerate(p)]
    raw = accept(spark.createDataFrame(rows, "metric string, arrival long, time long, value double")).drop("arrival").cache()
    levels = hierarchy(raw, CONFIG).cache()
    return {m: model.accepted(p) for m, p in points.items()}, raw, levels


def rows_of(df):
    if "value" in df.columns:
        return [tuple(r) for r in df.select("time", "value").collect()]
    return [(r["time"], tuple(r[c] for c in FIELDS)) for r in df.select("time", *FIELDS).collect()]


def close(a, b):
    assert len(a) == len(b), (a, b)
    for (t, x), (u, y) in zip(a, b, strict=True):
        assert t == u
        assert x == pytest.approx(y, rel=1e-9, abs=1e-9)


def test_acceptance(data):
    points, raw, _ = data
    for m, expected in points.items():
        assert sorted((r.time, r.value) for r in raw.where(F.col("metric") == m).collect()) == expected


def test_levels(data):
    points, _, levels = data
    got = {}
    for r in expand(levels).collect():
        got.setdefault((r.metric, r.level), {})[r.time] = tuple(r[c] for c in FIELDS)
    for m, p in points.items():
        for level in CONFIG.levels():
            close(sorted(got.get((m, level), {}).items()), sorted(model.level_rows(p, level).items()))


def test_rolled_up(data):
    points, raw, levels = data
    last = raw.groupBy("metric").agg(F.max("time").alias("last"))
    rows = expand(rolled_up(levels.where("level = 100"), CONFIG, last)).select("metric", "level", "time", *FIELDS)
    direct = expand(levels).select("metric", "level", "time", *FIELDS)
    close([(r[:3], r[3:]) for r in sorted(map(tuple, rows.collect()))], [(r[:3], r[3:]) for r in sorted(map(tuple, direct.collect()))])


def test_runs_stay_runs(spark):
    raw = spark.createDataFrame([("x", 110, 2.0), ("x", 100_000_000_000_110, 4.0)], "metric string, time long, value double")
    rows = hierarchy(raw, SeriesConfig(100, 100_000, 10)).collect()
    assert len(rows) <= 6 * 4
    first = min((r for r in rows if r.level == 100), key=lambda r: r.time)
    assert (first.time, first["count"], first.integral, first.active_time) == (100, 1, 360.0, 90)


def test_requests(data):
    points, raw, levels = data
    rng = random.Random(5)
    for m in ("a", "five"):
        span = points[m][-1][0]
        for kind in ("AGGREGATE", "AGGREGATE_TIMELINE", "FLEX_TIMELINE"):
            for _ in range(1 if kind == "AGGREGATE" else 5 if m == "a" else 2):
                start = rng.randint(0, span)
                end = start + rng.choice([1, 90, 1500, span])
                interval = rng.choice([0, 40, 100, 350, 1000, 4500, 20000, -1])
                request = Request(m, kind, start, end, interval)
                got = rows_of(history(raw, levels, dict.fromkeys(points, CONFIG), request))
                close(got, model.timeline(points[m], CONFIG, kind, start, end, interval))


def test_five_points(data):
    _, raw, levels = data
    configs = {"five": CONFIG, "none": CONFIG}
    (row,) = rows_of(history(raw, levels, configs, Request("five", "AGGREGATE", 110, 400)))
    assert row[1][2:] == (12.0, 4, 1130.0, 290)
    assert rows_of(history(raw, levels, configs, Request("five", "FLEX_TIMELINE", 115, 400)))[0][0] == 110
    assert rows_of(history(raw, levels, configs, Request("five", "LAST_VALUE", -5, -9))) == [(400, 3.0)]
    assert rows_of(history(raw, levels, configs, Request("none", "LAST_VALUE"))) == []
    packed = delta_encoded(history(raw, levels, configs, Request("five", "FLEX_TIMELINE", 115, 400))).first()
    assert packed.time_delta == [110, 10, 80, 30]


def test_errors(data):
    _, raw, levels = data
    configs = {"a": CONFIG}
    with pytest.raises(KeyError):
        history(raw, levels, configs, Request("zz", "LAST_VALUE"))
    for bad in (Request("a", "AGGREGATE", 5, 5), Request("a", "FLEX_TIMELINE", -1, 5), Request("a", "FLEX_TIMELINE", 9, 5), Request("a", "WHAT", 1, 5)):
        with pytest.raises(ValueError):
            history(raw, levels, configs, bad)
    with pytest.raises(ResponseTooLarge):
        history(raw, levels, configs, Request("a", "FLEX_TIMELINE", 0, 10**9), max_response=100)
    with pytest.raises(ResponseTooLarge):
        history(raw, levels, configs, Request("a", "AGGREGATE_TIMELINE", 0, 10**9, 100), max_response=100)
    for wrong in ((0, 10, 2), (100, 10, 10), (100, 1000, 1), (101, 1000, 10)):
        with pytest.raises(ValueError):
            SeriesConfig(*wrong)


def test_aggregates_by_other_ways(spark, data):
    points, raw, levels = data
    rng = random.Random(9)
    windows = []
    for m in points:
        for _ in range(15):
            start = rng.randint(0, points[m][-1][0] + 50)
            windows.append((len(windows), m, start, start + rng.choice([1, 60, 700, 9000, 200000])))
    windows += [(len(windows), "five", 110, 400), (len(windows) + 1, "nobody", 1, 5)]
    got = {r.window_id: tuple(r[c] for c in FIELDS) for r in aggregate_windows(raw, spark.createDataFrame(windows, "window_id long, metric string, start long, end long")).collect()}
    for i, m, start, end in windows:
        assert got[i] == pytest.approx(model.aggregate(points.get(m, []), start, end)), (m, start, end)
    for _, m, start, end in windows[::20]:
        if m in points:
            (row,) = rows_of(aggregate_from_levels(raw, levels, CONFIG, m, start, end))
            assert row[1] == pytest.approx(model.aggregate(points[m], start, end)), (m, start, end)


def test_many_stretches_and_cells(spark, data, monkeypatch):
    """The same with stretches of a few rows and cells of three: carries between stretches, totals of several sizes."""
    from tidemark.operators import samples
    from tidemark.plans import history as h

    points, raw, _ = data
    small = lambda df, column, rows=16: STRETCHES(df, column, min(rows, 16))
    STRETCHES = samples.stretches
    for module in (samples, h):
        monkeypatch.setattr(module, "stretches", small)
    monkeypatch.setattr(h, "CELL_ROWS", 3)
    monkeypatch.setattr(h, "STEP", 4)
    monkeypatch.setattr(samples, "QUANTILES", 8)
    rows = [(m, i, t, v) for m, s in (("a", 1), ("b", 2)) for i, (t, v) in enumerate(series(s))]
    got = accept(spark.createDataFrame(rows, "metric string, arrival long, time long, value double"))
    for m in "ab":
        assert sorted((r.time, r.value) for r in got.where(F.col("metric") == m).collect()) == points[m]
    levels = {}
    for r in expand(hierarchy(raw, CONFIG)).collect():
        levels.setdefault((r.metric, r.level), {})[r.time] = tuple(r[c] for c in FIELDS)
    for m, p in points.items():
        for level in CONFIG.levels():
            close(sorted(levels.get((m, level), {}).items()), sorted(model.level_rows(p, level).items()))
    test_aggregates_by_other_ways(spark, data)


def test_numbering_stretches_is_compiled(spark):
    """Methods of over 8,000 bytes are interpreted by the JVM for good."""
    cuts = Stretches(tuple(range(0, 6500, 100)), 5)
    rows = spark.range(-50, 6550).select(F.when(F.col("id") != 77, F.col("id")).alias("id"))
    out = rows.withColumn("c", cuts.of(F.col("id")))
    plan = out._jdf.queryExecution().executedPlan()
    made = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenStringSeq(plan)
    assert max(made.apply(i)._3().maxMethodCodeSize() for i in range(made.size())) < 8000
    for r in out.collect():
        x = None if r.id is None else min(max(r.id, 0), 6400)
        i = None if x is None else min(x // 100, 63)
        assert r.c == (-1 if x is None else 5 * i + min((x - 100 * i) // 21, 4))


def test_samples_meet_the_lowest_level_only(spark):
    """The coarser levels come from its rows, and the parts of samples are made once."""
    raw = spark.createDataFrame([("x", t, 1.0) for t in (110, 250, 3300, 99000)], "metric string, time long, value double")
    parts = []
    with pytest.MonkeyPatch.context() as patch:
        real = hierarchy_module.segment_parts
        patch.setattr(hierarchy_module, "segment_parts", lambda *a: parts.append(real(*a)) or parts[-1])
        rows = hierarchy_module.level_rows(raw, [100, 1000, 10000])
    assert len(parts) == 1 and {r.level for r in parts[0].select("level").distinct().collect()} == {100}
    points = [(r.time, r.value) for r in raw.collect()]
    for level in (100, 1000, 10000):
        found = {r.time: tuple(r[c] for c in FIELDS) for r in expand(rows.where(F.col("level") == level)).collect()}
        assert found == model.level_rows(points, level)
    assert rows.where("repeat > 1").count() >= 3

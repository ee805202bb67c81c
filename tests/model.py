"""A plain model of the semantics, sample by sample, to compare plans with."""

import math

INF = math.inf
EMPTY = (INF, -INF, 0.0, 0, 0.0, 0)


def held(v, d, n):
    return (v, v, v * n if n else 0.0, n, v * d, d)


def add(a, b):
    return (min(a[0], b[0]), max(a[1], b[1]), a[2] + b[2], a[3] + b[3], a[4] + b[4], a[5] + b[5])


def accepted(points):
    out, last = [], 0
    for t, v in points:
        if t > last and v is not None and math.isfinite(v):
            out.append((t, v))
            last = t
    return out


def level_rows(points, level):
    """{start: aggregate} of complete intervals; gaps are expanded, so keep them small."""
    out = {}
    previous = None
    for t, v in points:
        previous = t if previous is None else previous
        for b in range(previous // level, t // level + 1):
            d = min(t, (b + 1) * level) - max(previous, b * level)
            n = 1 if b == t // level else 0
            out[b * level] = add(out.get(b * level, EMPTY), held(v, d, n))
        previous = t
    return {b: a for b, a in out.items() if points and b + level <= points[-1][0]}


def aggregate(points, start, end):
    if not points or end <= points[0][0] or start > points[-1][0]:
        return EMPTY
    start, end = max(start, points[0][0]), min(end, points[-1][0])
    out, previous = EMPTY, start
    for t, v in points:
        if t < start:
            continue
        if t >= end:
            return add(out, held(v, end - previous, 0))
        out, previous = add(out, held(v, t - previous, 1)), t
    return out


def timeline(points, config, kind, start, end, interval):
    """(time, value) or (time, aggregate) rows."""
    if kind == "AGGREGATE" or interval < 0:
        return [(start, aggregate(points, start, end))]
    if interval >= config.interval_min:
        level, upper = config.choose(interval)
        while level >= config.interval_min:
            factor = upper // level if kind == "FLEX_TIMELINE" else 1
            rows = sorted((t, a) for t, a in level_rows(points, level).items() if start - start % level <= t < end and start < end)
            out = []
            for i in range(0, len(rows), factor):
                a = EMPTY
                for _, x in rows[i : i + factor]:
                    a = add(a, x)
                out.append((rows[i][0], a))
            if out:
                return out
            level //= config.interval_factor
        return []
    before = [p for p in points if p[0] <= start][-1:]
    rs = before + [p for p in points if start < p[0] < end]
    rs = [p for p in rs if p[0] < end]
    if not rs:
        return []
    if kind == "AGGREGATE_TIMELINE":
        return [(t, held(v, t - (rs[i - 1][0] if i else t), 1)) for i, (t, v) in enumerate(rs)]
    if interval > 0 and (end - start) // len(rs) < interval:
        previous, i, out, begin = min(start, rs[0][0]), 0, [], start
        while i < len(rs) and rs[i][0] < start:
            previous, i = rs[i][0], i + 1
        while i < len(rs) and begin < end:
            stop, a = min(end, begin + interval), EMPTY
            while i < len(rs) and rs[i][0] < stop:
                a, previous, i = add(a, held(rs[i][1], rs[i][0] - previous, 1)), rs[i][0], i + 1
            if i < len(rs):
                a, previous = add(a, held(rs[i][1], stop - previous, 0)), stop
            out.append((begin, a))
            begin = stop
        return out
    return rs

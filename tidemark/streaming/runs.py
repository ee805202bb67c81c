"""A metric's samples of one batch in order of arrival, whatever their number.

Up to `rows` samples are sorted at once; more go as sorted runs to a temporary file, and runs are merged by at most FAN_IN,
of each of which a block is held. Samples that a run itself shows to be late are left out, so memory is a few times `rows`.
"""

from __future__ import annotations

import heapq
import os
import tempfile
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import numpy as np
import pandas as pd

#: Samples that are sorted at once, and runs that are merged at once.
RUN_ROWS, FAN_IN = 1 << 17, 64
SAMPLE = np.dtype([("arrival", np.int64), ("time", np.int64), ("value", np.float64)])


def accepted(time: np.ndarray, value: np.ndarray, last: int) -> np.ndarray:
    """Which samples, in order of arrival, are later than all accepted before."""
    clock = np.where(np.isfinite(value), time, np.iinfo(np.int64).min)
    before = np.maximum.accumulate(np.r_[last, clock])[:-1]
    return np.isfinite(value) & (time > before)


def ordered(parts: list[np.ndarray]) -> np.ndarray:
    rows = np.concatenate(parts)
    return rows[np.lexsort((rows["value"], rows["time"], rows["arrival"]))]


def upto(rows: np.ndarray, bound: tuple) -> int:
    """How many of the sorted rows are not above bound."""
    lo, hi = 0, len(rows)
    for name, x in zip(SAMPLE.names, bound, strict=True):
        column = rows[name][lo:hi]
        lo, hi = lo + int(np.searchsorted(column, x, "left")), lo + int(np.searchsorted(column, x, "right"))
    return hi


def merged(file: BinaryIO, runs: list[tuple[int, int]], rows: int) -> Iterator[np.ndarray]:
    """The rows of sorted runs (first, end) of a file, sorted, about so many at once."""
    each, left = max(1, rows // len(runs)), list(runs)
    held: list[np.ndarray] = [np.empty(0, SAMPLE)] * len(runs)
    firsts: list[tuple] = []
    lasts: list[tuple] = []  # of runs with more in the file: what is above the least of these may still meet others

    def fill(i: int) -> None:
        lo, end = left[i]
        n = min(each, end - lo)
        file.seek(lo * SAMPLE.itemsize)
        held[i], left[i] = np.frombuffer(file.read(n * SAMPLE.itemsize), SAMPLE), (lo + n, end)
        heapq.heappush(firsts, (held[i][0].item(), i))
        if lo + n < end:
            heapq.heappush(lasts, (held[i][-1].item(), i))

    for i in range(len(runs)):
        fill(i)
    ready: list[np.ndarray] = []
    n = 0
    while firsts:
        bound, spent = lasts[0] if lasts else (None, None)
        while firsts and (bound is None or firsts[0][0] <= bound):
            i = heapq.heappop(firsts)[1]
            k = len(held[i]) if bound is None else upto(held[i], bound)
            ready.append(held[i][:k])
            held[i], n = held[i][k:], n + k
            if len(held[i]):
                heapq.heappush(firsts, (held[i][0].item(), i))
        if spent is not None:
            heapq.heappop(lasts)
            fill(spent)
        if n >= rows:
            yield ordered(ready)
            ready, n = [], 0
    if ready:
        yield ordered(ready)


def scratch() -> BinaryIO:
    """A file without a name, in a folder that Spark gave the worker if there is one."""
    folders = [d for d in os.environ.get("SPARK_LOCAL_DIRS", "").split(",") if d and os.access(d, os.W_OK)]
    return tempfile.TemporaryFile(dir=folders[0] if folders else None)


def in_order(batches: Iterable[pd.DataFrame], last: int, rows: int = RUN_ROWS, fan_in: int = FAN_IN) -> Iterator[pd.DataFrame]:
    """Samples (arrival, time, value) of batches, sorted, in frames of at most about twice so many rows. Those that can't be accepted after
    last may be missing."""
    parts: list[np.ndarray] = []
    n, runs, file = 0, [], None

    def write(to: BinaryIO, made: np.ndarray, into: list[tuple[int, int]]) -> None:
        at = into[-1][1] if into else 0
        to.write(made.tobytes())
        into.append((at, at + len(made)))

    def pruned() -> np.ndarray:
        made = ordered(parts)
        return made[accepted(made["time"], made["value"], last)]

    try:
        for pdf in batches:
            for lo in range(0, len(pdf), rows):
                some = pdf.iloc[lo : lo + rows]
                part = np.empty(len(some), SAMPLE)
                for name in SAMPLE.names:
                    part[name] = some[name].to_numpy(SAMPLE[name])
                parts.append(part)
                n += len(part)
                if n >= rows:
                    made = pruned()
                    parts, n = [], 0
                    if len(made):
                        file = file or scratch()
                        write(file, made, runs)
        rest = pruned() if parts else np.empty(0, SAMPLE)
        parts = []
        if file is None:
            if len(rest):
                yield pd.DataFrame(rest)
            return
        if len(rest):
            write(file, rest, runs)
        while len(runs) > fan_in:
            longer, to = [], scratch()
            for lo in range(0, len(runs), fan_in):
                begin = longer[-1][1] if longer else 0
                whole: list[tuple[int, int]] = [(begin, begin)]
                for made in merged(file, runs[lo : lo + fan_in], rows):
                    write(to, made, whole)
                longer.append((begin, whole[-1][1]))
            file.close()
            file, runs = to, longer
        for made in merged(file, runs, rows):
            yield pd.DataFrame(made)
    finally:
        if file is not None:
            file.close()

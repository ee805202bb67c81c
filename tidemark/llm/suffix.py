"""Repeated passages: every byte covered by a string of LENGTH bytes that starts anywhere else.

Instead of sorting the suffixes at a fixed difference cover of positions, suffixes are sampled where
the text itself says: a position is sampled if the hash of the GRAM bytes from it is least in some
window of LENGTH bytes. Two equal strings of LENGTH bytes hold samples at the same place in them, as
two positions of a difference cover would, with a fiftieth of the positions. Samples are named by
the hash of their GRAM bytes; names that occur once go. A sample's context is all that a string of
LENGTH bytes through it can hold. Equal contexts are repeated as a whole. Where a name has different
contexts, those are compared with each other string by string: every string in them is hashed,
and strings met twice mark their bytes.

Texts are UTF-8 bytes; nothing crosses documents. Null and empty texts have no bytes. Rows with one
doc_id are documents of their own, and equal rows are repeats of each other. Equality is that of
64-bit hashes of LENGTH bytes within a name. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._shared import lean, row_key, ship, small, text_of, written
from tidemark.llm.near import mix
from tidemark.llm.tokens import parts

LENGTH, GRAM = 200, 100
LEFT = LENGTH - GRAM
#: Bytes of a text handled at once, and contexts of one name compared in one task.
TILE, MANY = 1 << 20, 20_000
#: Names up to which they are broadcast.
BROADCAST_NAMES = 3_000_000

_A = 0xD6E8FEB86659FD93
_A_INVERSE = pow(_A, -1, 1 << 64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _table() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


_TABLE = _table()


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, at least n of each."""
    held = _powers.get(0)
    if held is None or len(held[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, _A, np.uint64), np.full(size, _A_INVERSE, np.uint64)
        up[0] = down[0] = 1
        held = _powers[0] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return held


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Sums from which span() takes the hash of any stretch."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * powers(len(data))[1][: len(data)], out=out[1:])
    return out


def span(prefix: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return mix((prefix[hi] - prefix[lo]) * powers(len(prefix))[0][lo])


def sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """The least or greatest of each width numbers one after another."""
    n = len(x) - width + 1
    pad = -len(x) % width
    fill = np.uint64(0xFFFFFFFFFFFFFFFF if least else 0)
    blocks = np.r_[x, np.full(pad, fill)].reshape(-1, width)
    take = np.minimum if least else np.maximum
    ahead = take.accumulate(blocks, axis=1).reshape(-1)
    behind = take.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return take(behind[:n], ahead[width - 1 : width - 1 + n])


def samples(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sampled positions of a text of bytes, their names and the hashes of their contexts."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    windows = len(data) - LENGTH + 1
    for a in range(0, max(windows, 0), TILE):
        b = min(a + TILE, windows)
        low, high = max(a - LEFT, 0), min(b + LEFT + LENGTH, len(data))
        prefix = prefix_hashes(data[low:high])
        start = np.arange(a - low, b - low + LEFT)
        grams = span(prefix, start, start + GRAM)
        least = sliding(grams, LEFT + 1, True)
        most = sliding(np.r_[np.zeros(LEFT, np.uint64), least, np.zeros(LEFT, np.uint64)], LEFT + 1, False)
        at = np.flatnonzero(grams == most)
        place = start[at]
        lo, hi = np.maximum(place - LEFT, 0), np.minimum(place + LENGTH, high - low)
        context = mix(span(prefix, lo, hi) + ((place - lo) * 1024 + (hi - lo)).astype(np.uint64))
        found.append((place + low, grams[at], context))
    if not found:
        none = np.zeros(0, np.uint64)
        return none.astype(np.int64), none, none
    at, name, context = (np.concatenate(x) for x in zip(*found, strict=True))
    _, first = np.unique(at, return_index=True)
    return at[first], name[first], context[first]


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode(), np.uint8)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in parts(batch, "text"):
            rows = [samples(_bytes(t)) for t in part.column("text").to_pylist()]
            sizes = [len(r[0]) for r in rows]
            keys = [np.repeat(part.column(c).to_numpy(), sizes) for c in ("k", "d")]
            at, name, context = (np.concatenate([r[i] for r in rows]) if rows else np.zeros(0, np.int64) for i in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*keys, at.astype(np.int64), name.view(np.int64), context.view(np.int64))], ["k", "d", "at", "name", "context"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of wanted contexts of each text."""
    for batch in batches:
        for row in batch.to_pylist():
            data, out = (row["text"] or "").encode(), []
            for w in row["want"]:
                lo = max(w["at"] - LEFT, 0)
                out.append((w["name"], row["k"], row["d"], w["at"], w["n"], w["kinds"], w["at"] - lo, data[lo : w["at"] + LENGTH]))
            columns = list(zip(*out, strict=True))
            kinds = [pa.int64()] * 7 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["name", "k", "d", "at", "n", "kinds", "left", "bytes"])


def string_hashes(left: np.ndarray, contexts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For contexts, the hash of the string that starts l bytes before the sample, for l from 0 to LEFT, and
    whether the context holds it."""
    width = LEFT + LENGTH
    data = np.zeros((len(contexts), width), np.uint8)
    for i, (l, c) in enumerate(zip(left.tolist(), contexts, strict=True)):
        data[i, LEFT - l : LEFT - l + len(c)] = np.frombuffer(c, np.uint8)
    right = np.array([len(c) for c in contexts]) - left
    prefix = np.zeros((len(contexts), width + 1), np.uint64)
    up, down = powers(width + 1)
    np.cumsum(_TABLE[data] * down[:width], axis=1, out=prefix[:, 1:])
    start = LEFT - np.arange(LEFT + 1)
    hashes = mix((prefix[:, start + LENGTH] - prefix[:, start]) * up[start])
    back = np.arange(LEFT + 1)
    return hashes, (back[None, :] <= left[:, None]) & (LENGTH - back[None, :] <= right[:, None])


def _runs(held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, first and last columns of the runs of true in a matrix."""
    edge = np.diff(np.pad(held, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(edge == 1)
    return row, first, np.nonzero(edge == -1)[1] - 1


def _marks(k: np.ndarray, d: np.ndarray, at: np.ndarray, held: np.ndarray) -> pa.RecordBatch:
    row, first, last = _runs(held)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (k[row], d[row], at[row] - last, at[row] - first + LENGTH)], ["k", "d", "lo", "hi"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of contexts sorted by name, the strings that another context of the name holds too."""

    def marks(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows)
        name, k, d, at, n, left = (table.column(c).to_numpy() for c in ("name", "k", "d", "at", "n", "left"))
        hashes, valid = string_hashes(left, table.column("bytes").to_pylist())
        keys = mix(hashes + mix(name.view(np.uint64) + np.uint64(1))[:, None] + (np.arange(LEFT + 1, dtype=np.uint64) << np.uint64(48))[None, :])
        row, col = np.nonzero(valid)
        _, which, count = np.unique(keys[row, col], return_inverse=True, return_counts=True)
        held = np.zeros(valid.shape, bool)
        held[row, col] = count[which] > 1
        held[n > 1] = False  # those are repeated as a whole
        return _marks(k, d, at, held)

    waiting: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        at = 0
        names = batch.column("name").to_numpy()
        while at < len(names):
            to = min(at + 4096, len(names))
            if to < len(names):
                to = int(np.searchsorted(names, names[to - 1], side="right"))
            if to < len(names):
                yield marks([*waiting, batch.slice(at, to - at)])
                waiting, size = [], 0
            else:
                first = int(np.searchsorted(names, names[-1], side="left"))
                first = max(first, at)
                if first > at:
                    yield marks([*waiting, batch.slice(at, first - at)])
                    waiting, size = [], 0
                elif waiting and waiting[-1].column("name")[-1].as_py() != names[at]:
                    yield marks(waiting)
                    waiting, size = [], 0
                waiting.append(batch.slice(first, to - first))
                size += to - first
            at = to
    if size:
        yield marks(waiting)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All strings of contexts, one by one: for names with very many of them."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 2048):
            part = batch.slice(lo, 2048)
            hashes, valid = string_hashes(part.column("left").to_numpy(), part.column("bytes").to_pylist())
            row, col = np.nonzero(valid)
            own = [part.column(c).to_numpy()[row] for c in ("name", "k", "d", "at", "n")]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*own, col, hashes[row, col].view(np.int64))], ["name", "k", "d", "at", "n", "back", "string"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(k, d, lo, hi): repeated stretches of bytes by the keys of a row; they may overlap."""
    ship(docs.sparkSession)
    keyed = docs.select(*[c.alias(n) for c, n in zip(row_key(), ("k", "d"), strict=True)], "text").where(F.octet_length("text") >= LENGTH)
    found = written(keyed.mapInArrow(lean(_sampled), "k long, d long, at long, name long, context long"), "suffix-samples")
    names = written(found.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name"), "suffix-names")
    found = written(found.join(small(names, names.count(), BROADCAST_NAMES), "name", "left_semi"), "suffix-found")
    by_context = written(found.groupBy("name", "context").agg(F.count("*").alias("n"), F.min(F.struct("k", "d", "at")).alias("r")), "suffix-contexts")
    whole = found.join(by_context.where("n > 1").select("name", "context"), ["name", "context"], "left_semi")
    whole = whole.select("k", "d", F.greatest(F.col("at") - LEFT, F.lit(0)).alias("lo"), (F.col("at") + LENGTH).alias("hi"))
    mixed = by_context.groupBy("name").agg(F.count("*").alias("kinds"), F.min("n").alias("m")).where("kinds > 1 and m = 1").select("name", "kinds")
    want = by_context.join(mixed, "name").select("name", "n", "kinds", "r.*")
    want = want.groupBy("k", "d").agg(F.collect_list(F.struct("name", "at", "n", "kinds")).alias("want"))
    want = written(want, "suffix-wanted")
    n_want = want.count()
    some = keyed.join(small(want.select("k", "d"), n_want), ["k", "d"], "left_semi").dropDuplicates(["k", "d"]).join(want, ["k", "d"])
    contexts = written(some.mapInArrow(lean(_contexts), "name long, k long, d long, at long, n long, kinds long, left long, bytes binary"), "suffix-bytes")
    few = contexts.where(F.col("kinds") <= MANY).repartition("name").sortWithinPartitions("name")
    part = few.mapInArrow(lean(_compared), "k long, d long, lo long, hi long")
    spans = whole.unionByName(part)
    hot = contexts.where(F.col("kinds") > MANY)
    if hot.limit(1).count():
        strings = hot.mapInArrow(lean(_hashed), "name long, k long, d long, at long, n long, back long, string long")
        twice = strings.groupBy("name", "back", "string").agg(F.count("*").alias("c")).where("c > 1").drop("c")
        met = strings.where("n = 1").join(twice, ["name", "back", "string"], "left_semi")
        spans = spans.unionByName(met.select("k", "d", (F.col("at") - F.col("back")).alias("lo"), (F.col("at") - F.col("back") + LENGTH).alias("hi")))
    return spans


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            data, kept, at, removed, spans = (row["text"] or "").encode(), hashlib.sha256(), 0, 0, 0
            end = -1
            for s in sorted((s["lo"], s["hi"]) for s in row["spans"] or ()):
                lo, hi = max(s[0], at), min(s[1], len(data))
                if hi <= at:
                    continue
                kept.update(data[at:lo])
                spans += lo > end or end < 0
                removed, at, end = removed + hi - lo, hi, hi
            kept.update(data[at:])
            out.append((row["doc_id"], len(data), removed, spans, kept.hexdigest()))
        columns = list(zip(*out, strict=True)) or [()] * 5
        kinds = [pa.int64()] * 4 + [pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def suffix_report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256. Only texts with a repeated stretch move."""
    spans = written(repeated_spans(docs).distinct().groupBy("k", "d").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "suffix-spans")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[c.alias(n) for c, n in zip(row_key(), ("k", "d"), strict=True)])
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    n = spans.count()
    ids = small(spans.select("k", "d"), n)
    cut = keyed.join(ids, ["k", "d"], "left_semi").join(spans, ["k", "d"]).select("doc_id", "text", "spans").mapInArrow(lean(_cut), schema)
    clean = keyed.join(ids, ["k", "d"], "left_anti")
    zero = F.lit(0).cast("long")
    clean = clean.select("doc_id", F.octet_length(text_of()).cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(text_of(), 256).alias("kept_sha256"))
    return cut.unionByName(clean)

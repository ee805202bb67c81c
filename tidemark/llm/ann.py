"""Approximate nearest neighbours by inner product, over robust-pruned directed graphs.

Vectors are folded to distinct ones and dealt by hash to SHARDS shards, or more where one
would hold over LARGE: every search visits each shard, so their number stays as it is while they can grow. Each shard is one
graph, built in memory: points are inserted in growing batches; a greedy beam search proposes a
point's neighbours, and pruning keeps the nearest and drops those that a kept one is nearer to by
the factor ALPHA; reverse edges are pruned alike. One added coordinate makes all vectors of a shard
equally long, so that nearness by distance is nearness by inner product. A beam search answers
each block of queries on every shard, and the shards' best are merged on exact scores.

Queries are the rows whose vec_id is divisible by QUERY_EVERY; a query's candidates are all rows but
those of its own vec_id. Vectors that are null, empty, zero or hold null or non-finite components
take no part, nor do rows without vec_id; vectors of different length don't meet. Repeated rows
count once. Columns other than vec_id and embedding are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._shared import lean, ship, small, written

QUERY_EVERY, NEAREST = 20, 20
#: Shards at least, distinct vectors in a shard, about, at most; queries in a block.
SHARDS, LARGE, BLOCK = 8, 16384, 8192
#: Distinct vectors and queries that a task folds before it hands them on.
FOLD = 50_000
#: Beams: of a query, and of a point that is inserted.
DEGREE, BEAM, BUILD_BEAM, ALPHA, EXPAND = 32, 512, 96, 1.2, 4
#: A shard's longest vectors, which every query tries beside its beam.
LONGEST = 512
#: Points linked exhaustively before insertion begins.
SEED_POINTS = 256


def nearness(points: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Less the squared distances of lengthened points, given by numbers that broadcast. The last coordinate's
    difference comes from the lengths: next to a long vector the coordinates themselves are alike."""
    v, far = points[:, :-1], points[:, -1]
    length2 = np.einsum("ij,ij->i", v, v)
    inner = np.einsum("...j,...j->...", v[at], v[to])
    return -(length2[at] + length2[to] - 2 * inner + risen(length2[at] - length2[to], far[at] + far[to]))


def risen(gap: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.divide(gap, total, out=np.zeros(np.broadcast(gap, total).shape), where=total > 0) ** 2


def search(points: np.ndarray, graph: np.ndarray, entry: int, queries: np.ndarray, beam: int = BEAM, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each query the beam's point numbers (-1: none) and inner products, best first; with own, the
    queries are these points and nearness takes the products' place."""
    n, q = len(points), len(queries)
    ids = np.full((q, beam), -1, np.int64)
    score = np.full((q, beam), -np.inf)
    done = np.ones((q, beam), bool)
    seen = np.zeros((q, n + 1), bool)
    seen[:, n] = True  # where -1 points
    ids[:, 0], score[:, 0], done[:, 0], seen[:, entry] = entry, queries @ points[entry] if own is None else nearness(points, own, np.full(q, entry)), False, True
    live = np.arange(q)
    while len(live):
        own_ids, own_score, own_done = ids[live], score[live], done[live]
        order = np.argsort(own_done, axis=1, kind="stable")[:, :EXPAND]  # beams are sorted: the best that are open
        opened = ~np.take_along_axis(own_done, order, 1)
        np.put_along_axis(own_done, order, True, 1)
        near = graph[np.take_along_axis(own_ids, order, 1)]
        near = np.where(opened[:, :, None], near, -1).reshape(len(live), -1)
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[seen[live[:, None], near]] = -1
        seen[live[:, None], near] = True
        at, slot = np.nonzero(near >= 0)
        fresh = np.full(near.shape, -np.inf)
        fresh[at, slot] = np.einsum("ij,ij->i", points[near[at, slot]], queries[live[at]]) if own is None else nearness(points, own[live[at]], near[at, slot])
        all_ids, all_score = np.hstack([own_ids, near]), np.hstack([own_score, fresh])
        all_done = np.hstack([own_done, near < 0])
        best = np.argsort(-all_score, axis=1, kind="stable")[:, :beam]
        ids[live], score[live] = np.take_along_axis(all_ids, best, 1), np.take_along_axis(all_score, best, 1)
        done[live] = np.take_along_axis(all_done, best, 1)
        live = live[~done[live].all(axis=1)]
    return ids, score


def prune(points: np.ndarray, own: np.ndarray, cand: np.ndarray, score: np.ndarray, alpha: float) -> np.ndarray:
    """Robust pruning: for each own point at most DEGREE of its candidates (-1: none), nearest first."""
    out = np.full((len(own), DEGREE), -1, np.int32)
    for lo in range(0, len(own), 256):
        c, s = cand[lo : lo + 256], score[lo : lo + 256].copy()
        s[(c < 0) | (c == own[lo : lo + 256, None])] = -np.inf
        order = np.argsort(-s, axis=1, kind="stable")
        c, s = np.take_along_axis(c, order, 1), np.take_along_axis(s, order, 1)
        alive = np.isfinite(s)
        v, last = points[c][:, :, :-1], points[c][:, :, -1]
        length2 = np.einsum("ijk,ijk->ij", v, v)
        between = length2[:, :, None] + length2[:, None] - 2 * (v @ v.transpose(0, 2, 1))
        between = np.maximum(between + risen(length2[:, :, None] - length2[:, None], last[:, :, None] + last[:, None]), 0)
        far = np.maximum(-np.where(alive, s, 0), 0)
        rows = np.arange(len(c))
        for r in range(DEGREE):
            first = alive.argmax(axis=1)
            has = alive[rows, first]
            if not has.any():
                break
            out[lo + rows[has], r] = c[rows[has], first[has]]
            alive &= ~(has[:, None] & (alpha * alpha * between[rows, first] <= far))
            alive[rows, first] = False
        # places left go to the nearest that were dropped: among vectors of unequal length few are kept otherwise
        for i, (o, k) in enumerate(zip(out[lo : lo + 256], c, strict=True)):
            free = np.flatnonzero(o < 0)
            more = k[np.isfinite(s[i]) & ~np.isin(k, o)][: len(free)]
            o[free[: len(more)]] = more
    return out


def build(points: np.ndarray, seed: int = 7, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """The graph (n, DEGREE) of points that are equally long, and its entry."""
    n = len(points)
    graph = np.full((n, DEGREE), -1, np.int32)
    entry = int((points @ points.mean(axis=0)).argmax()) if n else 0
    order = np.random.default_rng(seed).permutation(n)
    order = np.r_[entry, order[order != entry]].astype(np.int64) if n else order
    at = min(n, SEED_POINTS)
    first = order[:at]
    if at > 1:
        score = nearness(points, first[:, None], first[None])
        near = np.argsort(-score, axis=1, kind="stable")[:, : 3 * DEGREE]
        graph[first] = prune(points, first, first[near], np.take_along_axis(score, near, 1), alpha)
    while at < n:
        batch = order[at : at + min(1024, at)]
        cand, score = search(points, graph, entry, points[batch], BUILD_BEAM, batch)
        graph[batch] = prune(points, batch, cand, score, alpha)
        link_back(points, graph, batch, alpha)
        at += len(batch)
    return graph, entry


def link_back(points: np.ndarray, graph: np.ndarray, batch: np.ndarray, alpha: float) -> None:
    """Adds the edges to batch's points from those that they point to."""
    source = np.repeat(batch, DEGREE)
    target = graph[batch].reshape(-1).astype(np.int64)
    source, target = source[target >= 0], target[target >= 0]
    score = nearness(points, source, target)
    order = np.lexsort((-score, target))
    source, target = source[order], target[order]
    lead = np.flatnonzero(np.r_[True, target[1:] != target[:-1]]) if len(target) else np.zeros(0, int)
    place = np.arange(len(target)) - np.repeat(lead, np.diff(np.r_[lead, len(target)]))
    fits = place < 2 * DEGREE  # of very many that point here, the nearest
    rows = np.cumsum(np.r_[True, target[1:] != target[:-1]])[fits] - 1 if len(target) else np.zeros(0, int)
    own = target[lead]
    more = np.full((len(own), 2 * DEGREE), -1, np.int64)
    more[rows, place[fits]] = source[fits]
    both = np.hstack([graph[own].astype(np.int64), more])
    both.sort(axis=1)
    both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
    count = (both >= 0).sum(axis=1)
    few = count <= DEGREE
    kept = -np.sort(-both, axis=1)[:, :DEGREE]
    graph[own[few]] = kept[few]
    full = np.flatnonzero(~few)
    for lo in range(0, len(full), 1024):
        part = full[lo : lo + 1024]
        score = nearness(points, both[part], own[part][:, None])
        graph[own[part]] = prune(points, own[part], both[part], score, alpha)


def lengthened(vectors: np.ndarray) -> np.ndarray:
    """Vectors, scaled, with a coordinate that makes all equally long."""
    norm2 = (vectors**2).sum(axis=1)
    top = float(norm2.max()) or 1.0
    return np.hstack([vectors, np.sqrt(np.maximum(top - norm2, 0))[:, None]]) / np.sqrt(top)


def exact(queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed from the first component to the last."""
    out = np.zeros(ids.shape)
    for d in range(queries.shape[1]):
        out += queries[:, d, None] * vectors[:, d][ids]
    out[ids < 0] = -np.inf
    return out


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct vectors, as bytes of doubles, with their smallest ids, and the queries; a task hands on FOLD at a time."""
    held: dict[bytes, set[int]] = {}
    queries: list[tuple[int, bytes]] = []

    def out() -> pa.RecordBatch:
        columns = [
            pa.array([None] * len(held) + [q for q, _ in queries], pa.int64()), pa.array([*held, *(k for _, k in queries)], pa.binary()),
            pa.array([sorted(s)[: NEAREST + 1] for s in held.values()] + [None] * len(queries), pa.list_(pa.int64())),
        ]
        held.clear(), queries.clear()
        return pa.RecordBatch.from_arrays(columns, ["query_id", "vec", "ids"])

    for batch in batches:
        lists = batch.column("embedding")
        values, offsets, known = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy(), lists.is_valid().to_numpy(zero_copy_only=False)
        for i, vec_id in enumerate(batch.column("vec_id").to_pylist()):
            v = values[offsets[i] : offsets[i + 1]]
            if vec_id is None or not known[i] or not len(v) or not np.isfinite(v).all() or not v.any():
                continue
            key = (v + 0.0).tobytes()  # -0.0 is 0.0
            ids = held.setdefault(key, set())
            ids.add(vec_id)
            if len(ids) > 4 * NEAREST:
                held[key] = set(sorted(ids)[: NEAREST + 1])
            if vec_id % QUERY_EVERY == 0:
                queries.append((vec_id, key))
            if len(held) + len(queries) >= FOLD:
                yield out()
    yield out()


def _build_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("vec", ignore_index=True)
    vectors = np.stack([np.frombuffer(v) for v in pdf["vec"]])
    graph, entry = build(lengthened(vectors))
    ids = [np.asarray(x, np.int64) for x in pdf["ids"]]
    sizes = np.array([len(x) for x in ids], np.int32)
    return pd.DataFrame({
        "dim": [vectors.shape[1]], "shard": [pdf["shard"][0]], "n": [len(vectors)], "entry": [entry], "vectors": [vectors.tobytes()],
        "graph": [graph.tobytes()], "sizes": [sizes.tobytes()], "ids": [np.concatenate(ids).tobytes()],
    })


def _search_shard(index: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    names = ["h1", "h2", "vec_id", "score"]
    if not len(index) or not len(asked):
        return pd.DataFrame({"h1": [], "h2": [], "vec_id": [], "score": []}).astype({"h1": "int64", "h2": "int64", "vec_id": "int64"})
    x = index.iloc[0]
    vectors = np.frombuffer(x["vectors"]).reshape(x["n"], -1)
    graph = np.frombuffer(x["graph"], np.int32).reshape(x["n"], DEGREE)
    sizes, ids = np.frombuffer(x["sizes"], np.int32), np.frombuffer(x["ids"], np.int64)
    starts = np.cumsum(sizes) - sizes
    points = lengthened(vectors)
    long = np.argsort(points[:, -1], kind="stable")[:LONGEST]  # the least is added to the longest
    out = []
    for lo in range(0, len(asked), 512):
        part = asked.iloc[lo : lo + 512]
        q = np.stack([np.frombuffer(v) for v in part["vec"]])
        found, _ = search(points, graph, int(x["entry"]), np.hstack([q, np.zeros((len(q), 1))]))
        found = np.hstack([np.where(np.isin(found, long), -1, found), np.tile(long, (len(q), 1))])
        score = exact(q, vectors, found)
        at, slot = np.nonzero(found >= 0)
        node = found[at, slot]
        count = sizes[node]
        row = np.repeat(at, count)
        own = ids[np.repeat(starts[node], count) + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)]
        value = np.repeat(score[at, slot], count)
        order = np.lexsort((own, -value, row))
        row, own, value = row[order], own[order], value[order]
        first = np.searchsorted(row, row)
        keep = np.arange(len(row)) - first <= NEAREST
        out.append(pd.DataFrame({"h1": part["h1"].to_numpy()[row[keep]], "h2": part["h2"].to_numpy()[row[keep]], "vec_id": own[keep], "score": value[keep]}))
    return pd.concat(out)[names]


def nearest(embeddings: DataFrame) -> DataFrame:
    """Per query its nearest: query_id, rank (from 1), vec_id, score."""
    ship(embeddings.sparkSession)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    folded = rows.mapInArrow(lean(_folded), "query_id long, vec binary, ids array<long>")
    hashed = folded.withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit(7), "vec"), "dim": (F.length("vec") / 8).cast("int")})
    hashed = written(hashed, "ann-folded")
    merged = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, NEAREST + 1)  # a list for each task and vector
    points = written(hashed.where("query_id is null").groupBy("dim", "h1", "h2", "vec").agg(merged.alias("ids")), "ann-points")
    n = points.count()
    shards = max(SHARDS, n // LARGE + 1)
    queries = hashed.where("query_id is not null").select("query_id", "h1", "h2", "dim", "vec")
    asked = written(queries.dropDuplicates(["h1", "h2"]).drop("query_id"), "ann-asked")
    blocks = asked.count() // BLOCK + 1
    # counts of partitions are given, so that shards aren't put together in few tasks
    index = points.withColumn("shard", F.pmod("h1", F.lit(shards))).select("dim", "shard", "vec", "ids").repartition(4 * shards, "dim", "shard").groupBy("dim", "shard")
    index = written(index.applyInPandas(_build_shard, "dim int, shard long, n int, entry int, vectors binary, graph binary, sizes binary, ids binary"), "ann-index")
    left = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = asked.withColumn("block", F.pmod("h2", F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    keys, tasks = ["dim", "shard", "block"], 4 * shards * blocks
    left, right = (x.repartition(tasks, *keys).groupBy(*keys) for x in (left, right))
    found = left.cogroup(right).applyInPandas(_search_shard, "h1 long, h2 long, vec_id long, score double")
    best = Window.partitionBy("h1", "h2").orderBy(F.desc("score"), "vec_id")
    found = written(found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= NEAREST + 1).drop("r"), "ann-found")
    each = queries.select("query_id", "h1", "h2").distinct()
    pairs = each.join(small(found, found.count()), ["h1", "h2"]).where("vec_id != query_id")
    own = Window.partitionBy("query_id", "h1", "h2").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= NEAREST).select("query_id", "rank", "vec_id", "score")

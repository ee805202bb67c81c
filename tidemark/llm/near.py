"""MinHash near-dedup by dart throwing over weighted 5-word shingles.

A document is a weighted set: its shingles of five lower-cased words (fewer words: one shingle
of all), each weighing as often as it occurs. A shingle of weight w covers w unit cells. Hashed
darts fall on each cell as a Poisson process along a rank axis; a document keeps the darts of
its own cells up to a rank that holds about k ln k + 4k darts whatever its length, and for each
of k coordinates the earliest. Two documents agree on a coordinate with the probability of their
weighted Jaccard similarity. Bands of coordinates propose candidates, which are verified with the
exact similarity, and verified links are closed to classes.

In a band's bucket nobody is paired with everybody: each member is paired with the bucket's hub
(the member found in the largest buckets, which is the original among edited copies), and members
left outside their hub's class elect a new one. Members of buckets that still hold several classes
are taken to the end by an exact prefix filter: a document's cells are ordered, seldom ones first,
and two documents can be similar only if they share a cell early enough in both orders. Within such
a cell, hubs are tried first and then every pair of different classes. No pair of a bucket is left
untried unless its classes are one or the filter excludes it. Identical texts are folded before.

Null, empty and white-space texts are classes of their own. Rows with one doc_id are one document: they
share a class, and so do the documents that any of them is similar to. A row with a null doc_id has the class of a
document with the same words, or null; it links nothing itself. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._shared import lean, ship, small, text_of, words_of, written

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 24, 4
COORDINATES = BANDS * ROWS
#: Rounds of hubs, before all that is left is tried.
ROUNDS = 2
#: Cells are ordered by counts in so many buckets over all documents to be filtered; any order is right, seldom first is fast.
SKETCH = 1 << 18
#: Words handled at once in a worker, and documents: each has about 820 darts, however short it is.
PART_WORDS = 1 << 18
PART_DOCS = 1 << 10

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def unit_cells(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the unit cells of documents given as word hashes one after another, and their counts."""
    ends = np.cumsum(sizes)
    counts = np.where(sizes >= SHINGLE, sizes - SHINGLE + 1, (sizes > 0).astype(sizes.dtype))
    owner = np.repeat(np.arange(len(sizes)), counts)
    first = np.repeat(ends - sizes, counts) + (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts))
    shingles, last = np.zeros(len(first), np.uint64), ends[owner] - 1
    for k in range(SHINGLE):
        at = first + k
        word = np.where(at <= last, words[np.minimum(at, max(len(words) - 1, 0))], _GOLD) if len(words) else words
        shingles = mix(shingles * _GOLD + word)
    at = 0
    for n in counts.tolist():
        shingles[at : at + n].sort()
        at += n
    if not len(shingles):
        return shingles, counts
    fresh = np.r_[True, (shingles[1:] != shingles[:-1]) | (owner[1:] != owner[:-1])]
    place = np.arange(len(shingles))
    copy = place - np.maximum.accumulate(np.where(fresh, place, 0))
    return mix(shingles + copy.astype(np.uint64) * _GOLD), counts


def dart_signatures(cells: np.ndarray, counts: np.ndarray, k: int = COORDINATES) -> np.ndarray:
    """For each document with cells, its k earliest darts; a row of zeros for one without."""
    found = np.zeros((len(counts), k), np.uint64)
    waiting, reach = np.flatnonzero(counts), k * (np.log(k) + 4)
    starts = np.cumsum(counts) - counts
    while len(waiting):
        n = counts[waiting]
        owner = np.repeat(np.arange(len(waiting)), n)
        cell = cells[np.repeat(starts[waiting], n) + (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n))]
        limit = (reach / n)[owner]
        rank = np.zeros(len(owner))
        keys, ranks, darts, throw = [], [], [], 0
        while len(cell):
            throw += 1
            dart = mix(cell + np.uint64(throw * int(_M1) % (1 << 64)))
            rank = rank - np.log(((dart >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53)
            hit = np.flatnonzero(rank < limit)
            cell, owner, limit, rank, dart = cell[hit], owner[hit], limit[hit], rank[hit], dart[hit]
            keys.append(owner * k + (mix(dart ^ _M2) % np.uint64(k)).astype(np.int64))
            ranks.append(rank)
            darts.append(dart)
        key, rank, dart = np.concatenate(keys), np.concatenate(ranks), np.concatenate(darts)
        order = np.lexsort((rank, key))
        key, dart = key[order], dart[order]
        lead = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        part, full = np.zeros(len(waiting) * k, np.uint64), np.zeros(len(waiting) * k, bool)
        part[key[lead]], full[key[lead]] = dart[lead], True
        done = full.reshape(-1, k).all(axis=1)
        found[waiting[done]] = part.reshape(-1, k)[done]
        waiting, reach = waiting[~done], reach * 2
    return found


def band_keys(signatures: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(signatures), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        keys = mix(keys * _GOLD + signatures[:, r::ROWS])
    return keys


def _parts(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with the hashes of their words and the counts of these, a bounded number of documents and words each."""
    lists = batch.column(column)
    offsets = lists.offsets.to_numpy()
    at = 0
    while at < batch.num_rows:
        to = min(at + PART_DOCS, max(at + 1, int(np.searchsorted(offsets, offsets[at] + PART_WORDS, side="right")) - 1))
        words = lists.values.slice(offsets[at], offsets[to] - offsets[at]).to_numpy(zero_copy_only=False).view(np.uint64)
        yield batch.slice(at, to - at), words, np.diff(offsets[at : to + 1]).astype(np.int64)
        at = to


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, words, sizes in _parts(batch, "words"):
            cells, counts = unit_cells(words, sizes)
            bands = band_keys(dart_signatures(cells, counts))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("c1"), part.column("c2"), pa.array(counts), _lists(bands.reshape(-1), np.full(len(counts), BANDS))],
                ["doc_id", "c1", "c2", "n", "bands"],
            )


def _celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, words, sizes in _parts(batch, "words"):
            cells, counts = unit_cells(words, sizes)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), _lists(cells, counts)], ["node", "cells"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SKETCH, np.int64)
    for batch in batches:
        for _, words, sizes in _parts(batch, "words"):
            cells, _ = unit_cells(words, sizes)
            total += np.bincount((cells % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "held"])


def prefixes(cells: np.ndarray, counts: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first cells of documents in the sketch's order, their documents and places: those before which so few
    stand that the rest may still make a document similar to one of 4/5 of its size."""
    owner = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((cells, sketch[(cells % np.uint64(SKETCH)).astype(np.int64)], owner))
    place = np.arange(len(cells)) - np.repeat(np.cumsum(counts) - counts, counts)
    early = np.flatnonzero(5 * (counts[owner] - place) >= 4 * counts[owner])
    return cells[order][early], owner[early], place[early]


def hashed_words(docs: DataFrame) -> DataFrame:
    words = F.transform(words_of(F.lower(text_of())), lambda w: F.xxhash64(w))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), words.alias("words"))


def classes(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that a node reaches, for nodes with an edge (a, b). Each round
    takes the least label around and jumps to that label's label."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).where("a != b").distinct(), "near-edges")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "near-labels")
    while True:
        around = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("m"))
        near = labels.join(around, labels["node"] == around["a"]).select("node", F.col("label").alias("old"), F.least("label", "m").alias("l"))
        roots = labels.select(F.col("node").alias("l"), F.col("label").alias("up"))
        new = written(near.join(roots, "l", "left").select("node", "old", F.least("l", F.coalesce("up", "l")).alias("label")), "near-labels")
        labels = new.select("node", "label")
        if not new.where("old != label").limit(1).count():
            return labels


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Of pairs (a, b), those whose exact similarity is SIMILAR or more. Only documents in pairs are read
    again; a hub's cells meet its partners' by a join that Spark splits where it is skewed."""
    ends = written(pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "doc_id"), "near-ends")
    texts = docs.where("doc_id is not null").join(small(ends, ends.count()), "doc_id", "left_semi")
    sets = hashed_words(texts).mapInArrow(lean(_celled), "node long, cells array<long>")
    with_b = pairs.join(sets.withColumnRenamed("node", "b").withColumnRenamed("cells", "cb"), "b")
    with_a = with_b.join(sets.withColumnRenamed("node", "a").withColumnRenamed("cells", "ca"), "a")
    common = F.size(F.array_intersect("ca", "cb"))
    found = with_a.withColumn("c", common).where(F.col("c") >= SIMILAR * (F.size("ca") + F.size("cb") - F.col("c")))
    return found.select("a", "b").distinct()  # a document of several rows may meet another more than once


def with_fame(rows: DataFrame, tag: str) -> DataFrame:
    """(key, node, n, pos) of keys with several rows, with how many rows a node meets."""
    often = rows.groupBy("key").agg(F.count("*").alias("held")).where("held > 1")
    rows = written(rows.join(often, "key"), tag)
    fame = rows.groupBy("node").agg(F.sum("held").alias("fame"))
    return written(rows.join(fame, "node").select("key", "node", "n", "pos", "fame"), tag)


#: Whether rows that share a key may be similar: what stands from their places on suffices for c >= 0.8 (na + nb - c).
CLOSE = "a != b and 9 * least(na - pa, nb - pb) >= 4 * (na + nb)"


class Links:
    """The verified links so far, the pairs tried and the classes of the links."""

    def __init__(self, docs: DataFrame):
        self.docs, self.edges, self.tried, self.labels = docs, None, None, None

    def label(self, rows: DataFrame, node: str, to: str) -> DataFrame:
        if self.labels is None:
            return rows.withColumn(to, F.col(node))
        return rows.join(self.labels.select(F.col("node").alias(node), F.col("label").alias(to)), node, "left").withColumn(to, F.coalesce(to, node))

    def mixed(self, rows: DataFrame) -> DataFrame:
        """rows with their labels, of keys that hold several classes."""
        held = written(self.label(rows, "node", "label"), "near-held")
        several = held.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x != y")
        return held.join(several.select("key"), "key", "left_semi")

    def attempt(self, pairs: DataFrame) -> bool:
        """Verifies pairs (a, b, na, nb, pa, pb) that weren't tried. False if there are none."""
        pairs = pairs.where(CLOSE).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if self.tried is not None:
            pairs = pairs.join(self.tried, ["a", "b"], "left_anti")
        pairs = written(pairs, "near-pairs")
        if not pairs.limit(1).count():
            return False
        new = written(verified(pairs, self.docs), "near-links")
        self.tried = pairs if self.tried is None else self.tried.unionByName(pairs)
        if new.limit(1).count():
            self.edges = new if self.edges is None else self.edges.unionByName(new)
            self.labels = classes(self.edges)
        return True

    def by_hubs(self, rows: DataFrame) -> None:
        """Pairs the rows of each key with its hub; those left outside its class elect another."""
        for _ in range(ROUNDS):
            best = F.max(F.struct("fame", -F.col("node"), "n", "pos")).alias("h")
            hub = rows.groupBy("key").agg(best).select("key", (-F.col("h.col2")).alias("a"), F.col("h.n").alias("na"), F.col("h.pos").alias("pa"))
            pairs = rows.join(hub, "key").select("a", "na", "pa", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"))
            if not self.attempt(pairs):
                break
            held = self.label(self.label(rows.join(hub.select("key", "a"), "key"), "node", "label"), "a", "up")
            rows = written(held.where("label != up").select("key", "node", "n", "pos", "fame"), "near-rest")

    def by_prefixes(self, nodes: DataFrame, many: int) -> None:
        """Tries all pairs of nodes of different classes that can be similar."""
        spark = self.docs.sparkSession
        words = hashed_words(self.docs.where("doc_id is not null").join(small(nodes, many), "doc_id", "left_semi"))
        counts = words.mapInArrow(lean(_counted), "at long, held long").groupBy("at").agg(F.sum("held").alias("held")).toArrow()  # at most SKETCH
        sketch = np.zeros(SKETCH, np.int64)
        sketch[counts.column("at").to_numpy()] = counts.column("held").to_numpy()
        sent = spark.sparkContext.broadcast(sketch)

        def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, hashes, sizes in _parts(batch, "words"):
                    cells, counts = unit_cells(hashes, sizes)
                    key, owner, place = prefixes(cells, counts, sent.value)
                    node = part.column("doc_id").to_numpy(zero_copy_only=False)
                    columns = (key.view(np.int64), node[owner], counts[owner], place)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["key", "node", "n", "pos"])

        rows = with_fame(words.mapInArrow(lean(first), "key long, node long, n long, pos long"), "near-prefixes")
        rows = written(self.mixed(rows), "near-prefixes").drop("label")
        self.by_hubs(rows)
        left = written(self.mixed(rows), "near-left").select("key", "node", "n", "pos", "label")
        one, two = (left.select("key", *(F.col(c).alias(x) for c, x in zip(("node", "n", "pos", "label"), names, strict=True))) for names in (("a", "na", "pa", "la"), ("b", "nb", "pb", "lb")))
        self.attempt(one.join(two, "key").where("la != lb and a < b"))


def near_classes(docs: DataFrame) -> DataFrame:
    """One row for each of docs: doc_id, class_id (the smallest doc_id of its class), class_links (verified
    links between different texts in the class)."""
    spark = docs.sparkSession
    ship(spark)
    hashed = hashed_words(docs).withColumns({"c1": F.xxhash64("words"), "c2": F.xxhash64(F.lit(7), F.col("words"))})
    signed = hashed.mapInArrow(lean(_signed), "doc_id long, c1 long, c2 long, n long, bands array<long>")
    signed = written(signed, "near-signed")
    some = signed.where("n > 0")
    reps = written(some.where("doc_id is not null").groupBy("c1", "c2").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("bands").alias("bands")), "near-reps")
    rows = with_fame(reps.select("node", "n", F.lit(0).cast("long").alias("pos"), F.explode("bands").alias("key")), "near-rows")
    links = Links(docs)
    links.by_hubs(rows)
    mixed = links.mixed(rows).select(F.col("node").alias("doc_id")).distinct()
    mixed = written(mixed, "near-mixed")
    many = mixed.count()
    if many:
        links.by_prefixes(mixed, many)
    edges, labels = links.edges, links.labels
    named = written(some.select("doc_id", "c1", "c2").join(reps.select("c1", "c2", "node"), ["c1", "c2"], "left").select("doc_id", "node"), "near-named")
    # documents of several texts hold these together
    several = named.where("doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z")
    held = written(named.join(several.select("doc_id", "a"), "doc_id").select("a", F.col("node").alias("b")).where("a < b").distinct(), "near-held")
    if held.limit(1).count():
        labels = classes(held if edges is None else edges.unionByName(held))
    if labels is None:
        named = named.select("doc_id", F.col("node").alias("class_id"))
    else:
        named = named.join(labels, "node", "left").select("doc_id", F.coalesce("label", "node").alias("class_id"))
    empty = signed.where("n = 0").select("doc_id")
    if empty.limit(1).count():  # an empty row of a document that has other texts is in its class
        empty = empty.join(named.where("doc_id is not null").groupBy("doc_id").agg(F.min("class_id").alias("class_id")), "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
        named = named.unionByName(empty)
    if edges is None:
        return named.withColumn("class_links", F.lit(0).cast("long"))
    count = edges.distinct().join(labels, edges["a"] == labels["node"]).groupBy("label").agg(F.count("*").alias("class_links")).withColumnRenamed("label", "class_id")
    return named.join(count, "class_id", "left").select("doc_id", "class_id", F.coalesce("class_links", F.lit(0)).cast("long").alias("class_links"))


def without_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each class, of the smallest doc_id (of several rows of that, the one of the smallest hash of text); rows
    without doc_id stay if their words are nowhere else."""
    found = near_classes(docs)
    keys = written(found.where("doc_id = class_id").groupBy("doc_id").agg(F.count("*").alias("rows")), "near-kept")
    single = keys.where("rows = 1").select("doc_id")
    kept = docs.join(small(single, keys.count()), "doc_id", "left_semi").select(*docs.columns)
    again = keys.where("rows > 1").select("doc_id")
    if again.limit(1).count():
        rows = docs.join(again, "doc_id", "left_semi").select("doc_id", F.struct(*docs.columns).alias("__row"), F.struct(F.xxhash64("text"), "text").alias("__h"))
        kept = kept.unionByName(rows.groupBy("doc_id").agg(F.min_by("__row", "__h").alias("__row")).select("__row.*"))
    if found.where("doc_id is null").limit(1).count():
        words = words_of(F.lower(text_of()))
        hashed = docs.withColumns({"__c": F.xxhash64(F.transform(words, lambda w: F.xxhash64(w))), "__e": F.size(words) == 0})
        nameless = hashed.where("doc_id is null")
        seen = hashed.where("doc_id is not null").select("__c").distinct()
        fresh = nameless.where("not __e").join(seen, "__c", "left_anti").dropDuplicates(["__c"])
        kept = kept.unionByName(fresh.select(*docs.columns)).unionByName(nameless.where("__e").select(*docs.columns))
    return kept

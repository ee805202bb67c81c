"""Harmonic packing: pieces of documents by reciprocal-capacity classes.

A document's ids (the end id included) are cut into pieces of the sizes capacity // k: a whole
capacity while that goes, then greedily the largest reciprocal that fits, until what is left is
short. A piece of length n is of class k = capacity // n; a sequence of class k holds k pieces of
it, so classes fill without looking at each other. Pieces are numbered within class and stretch
(of a hashed split of documents), counts of stretches give each its first number, and number
div k is the sequence: no task needs another's pieces. What the last sequence of each class lacks
is less than the class count; those few pieces, whose number doesn't grow with the input, share
sequences by first fit decreasing.

Null and empty texts have only the end id. Rows with one doc_id are documents of their own, and
alike rows are told apart by their numbers. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._shared import lean, ship, written
from tidemark.llm.tokens import encoder, parts

CAPACITY = 4096
#: What is left of a document below this length isn't cut further.
SHORT = 128
#: Pieces in a stretch within which they are numbered.
STRETCH = 8192


def cuts(n: int, capacity: int = CAPACITY, short: int = SHORT) -> list[int]:
    """Lengths of the pieces of a document of n ids."""
    out = [capacity] * (n // capacity)
    n %= capacity
    while n >= short:
        k = -(-capacity // n)  # the smallest k with capacity // k <= n
        while capacity // k > n:
            k += 1
        out.append(capacity // k)
        n -= capacity // k
    return out + [n] * (n > 0)


def pieces_of(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row for each piece: row (a number of the document), doc_id, start, length, ids_crc32, doc_tokens, k."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            for part in parts(batch, "text"):
                rows = []
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encode(part.column("text")), strict=True):
                    at = 0
                    for n in cuts(len(ids)):
                        rows.append((doc_id, at, n, zlib.crc32(ids[at : at + n]), len(ids)))
                        at += n
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        lean(cut), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    )
    return found.withColumn("k", F.expr(f"{CAPACITY} div length"))


def first_fit(pieces: pd.DataFrame) -> pd.DataFrame:
    """Sequences and offsets of the few pieces that filled no sequence of their class."""
    pieces = pieces.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], ignore_index=True)
    room = np.zeros(0, np.int64)
    bins, offsets = [], []
    for n in pieces["length"].to_numpy():
        fits = np.flatnonzero(room >= n)
        if not len(fits):
            room = np.r_[room, CAPACITY]
            fits = [len(room) - 1]
        bins.append(fits[0])
        offsets.append(CAPACITY - room[fits[0]])
        room[fits[0]] -= n
    return pieces.drop(columns="all").assign(sequence_id=np.array(bins, np.int64), offset=np.array(offsets, np.int64))


def packed(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    ship(docs.sparkSession)
    pieces = written(pieces_of(docs, tokenizer), "pack-pieces")
    stretches = pieces.count() // STRETCH + 1
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(stretches)))
    sums = pieces.groupBy("k", "part").agg(F.count("*").alias("n"))
    by_class = Window.partitionBy("k")
    before = by_class.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("k", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), F.sum("n").over(by_class).alias("all"))
    inside = Window.partitionBy("k", "part").orderBy("doc_id", "start", "ids_crc32", "length")
    numbered = pieces.withColumn("i", F.row_number().over(inside) - 1).join(sums, ["k", "part"]).withColumn("i", F.col("i") + F.col("first"))
    numbered = written(numbered.withColumn("bin", F.expr("i div k")).withColumn("full", F.expr("(i div k + 1) * k <= all")).drop("part", "first", "all"), "pack-numbered")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    in_bin = Window.partitionBy("k", "bin").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    full = numbered.where("full").withColumn("offset", F.coalesce(F.sum("length").over(in_bin), F.lit(0)))
    full = full.withColumn("sequence_id", F.col("bin") * (CAPACITY + 1) + F.col("k"))
    schema = ", ".join(f"{c} long" for c in names)
    rest = numbered.where("not full").select(*names[:5], F.lit(0).alias("all")).groupBy("all").applyInPandas(first_fit, schema)
    rest = rest.withColumn("sequence_id", F.col("sequence_id") * (CAPACITY + 1))
    return full.select(*names).unionByName(rest.select(*names))

"""Mixing sources to target weights.

Each source's words, its documents one after another in a hashed order, are cut into blocks
of fixed length. Output slots are dealt to shards; each shard draws its sources from a
multinomial. A source's slots, numbered across shards, walk through pseudorandom permutations
of its blocks (one for each pass), and slots meet blocks by index. All columns are DataFrame
functions and all draws are hashes: reruns agree.

Targets: sources by code point, null last, weigh WEIGHTS repeating and share RATIO times all
words; a target stops at CAP times its source's words, and the excess is shared again by
weight. Draws leave a source some slots over or short; slots over go to sources that are short,
so that each source takes its target to within a block.

Null and empty texts have size 0 and take nothing. Rows with the same doc_id are documents of
their own; rows alike in every column are interchangeable. A table without words gives targets of 0. Columns of the input are not read but for
doc_id, source and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._shared import let, row_key, small, text_of, written

WEIGHTS = (3, 1, 2)
RATIO = 1.5
CAP = 2
#: Words in a block; a source of under 64 blocks is cut finer.
BLOCK = 128
#: Slots in an output shard.
SHARD = 8192
#: Slots that one task makes.
TASK_SLOTS = 1 << 16
#: Documents in a stretch within which places are numbered.
CHUNK = 4096
GRID = 4096
LONG = "long"


def targets(sizes: DataFrame) -> DataFrame:
    """One row for each source: sid (from 0), source, source_size, target, block, n_blocks, n_slots."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    src = sizes.groupBy("source").agg(F.sum("size").cast(LONG).alias("source_size")).withColumn("sid", F.row_number().over(by_name) - 1)
    weights = F.array(*map(F.lit, WEIGHTS))
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    src = src.withColumns({
        "w": F.get(weights, F.col("sid") % len(WEIGHTS)).cast(LONG), "cap": F.col("source_size") * CAP,
        "all": F.sum("source_size").over(everything) * F.lit(RATIO),
    }).withColumn("full", F.col("cap") / F.col("w"))
    # water level: the first source, by how soon it is full, that the level left by those before it doesn't fill
    soon = Window.orderBy("full", "sid")
    before = F.coalesce(F.sum("cap").over(soon.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("w").over(soon.rowsBetween(0, Window.unboundedFollowing))
    src = src.withColumn("level", (F.col("all") - before) / left)
    ordered = soon.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = F.first(F.when(F.col("level") <= F.col("full"), F.col("level")), ignorenulls=True).over(ordered)
    src = src.withColumn("target", F.least(F.col("cap").cast("double"), level * F.col("w")))
    block = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.col("source_size") / 64))).cast(LONG)
    src = src.withColumn("block", block).withColumn("n_blocks", F.ceil(F.col("source_size") / F.col("block")).cast(LONG))
    slots = F.least(F.round(F.col("target") / F.col("block")).cast(LONG), F.col("n_blocks") * CAP)
    return src.withColumn("n_slots", slots).select("sid", "source", "source_size", "target", "block", "n_blocks", "n_slots")


def uniform(*parts: Column) -> Column:
    """A hashed number in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def shard_counts(src: DataFrame, total: int, seed: int) -> DataFrame:
    """(shard, sid, count): multinomial draws of each shard, then slots over a source's n_slots
    handed to sources that are short. Rows grow with shards times sources."""
    spark = src.sparkSession
    by_sid = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    cdf = src.where("n_slots > 0").select("sid", "n_slots", F.coalesce(F.sum("n_slots").over(by_sid), F.lit(0)).alias("lo"))
    cdf = cdf.withColumns({"a": F.col("lo") / F.lit(float(total)), "b": (F.col("lo") + F.col("n_slots")) / F.lit(float(total))})
    cell = lambda c: F.least(F.floor(c * GRID), F.lit(GRID - 1)).cast("int")
    grid = cdf.select("sid", "a", "b", F.explode(F.sequence(cell(F.col("a")), cell(F.col("b")))).alias("cell"))
    slots = spark.range(total).select((F.col("id") / SHARD).cast(LONG).alias("shard"), uniform(F.lit(seed), F.col("id")).alias("u"))
    slots = slots.withColumn("cell", cell(F.col("u")))
    drawn = slots.join(small(grid, src.count()), "cell").where("u >= a and u < b").groupBy("shard", "sid").agg(F.count("*").alias("n"))
    along = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    drawn = drawn.join(small(src.select("sid", "n_slots"), src.count()), "sid").withColumn("before", F.coalesce(F.sum("n").over(along), F.lit(0)))
    keep = F.greatest(F.lit(0), F.least(F.col("n"), F.col("n_slots") - F.col("before")))
    drawn = written(drawn.select("shard", "sid", "n", keep.alias("keep")), "mix-draws")
    over = drawn.where("n > keep").groupBy("shard").agg(F.sum(F.col("n") - F.col("keep")).alias("k"))
    over = over.withColumn("first", F.coalesce(F.sum("k").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    has = drawn.groupBy("sid").agg(F.sum("keep").alias("has"))
    short = src.select("sid", "n_slots").join(has, "sid", "left").select("sid", (F.col("n_slots") - F.coalesce("has", F.lit(0))).alias("k")).where("k > 0")
    short = short.withColumn("first", F.coalesce(F.sum("k").over(by_sid), F.lit(0)))
    units = lambda df, c: df.select(c, F.explode(F.sequence(F.col("first"), F.col("first") + F.col("k") - 1)).alias("i"))
    handed = units(over, "shard").join(units(short, "sid"), "i").groupBy("shard", "sid").agg(F.count("*").alias("n"))
    both = drawn.select("shard", "sid", F.col("keep").alias("n")).unionByName(handed)
    return both.groupBy("shard", "sid").agg(F.sum("n").alias("count")).where("count > 0")


def permuted(j: Column, n: Column, *seed: Column) -> Column:
    """A pseudorandom bijection of 0..n-1 (n up to 2^40): each round mixes the bits of numbers below
    the largest power of two in n and turns the ring by a hashed shift."""
    bits = F.length(F.bin(n)) - 1
    m = F.call_function("shiftleft", F.lit(1).cast(LONG), bits)
    half = F.greatest(F.lit(1), (bits / 2).cast("int"))
    fold = lambda x: x.bitwiseXOR(F.call_function("shiftright", x, half))
    x = j
    for r in range(1, 4):
        odd = F.shiftleft(F.xxhash64(F.lit(r), *seed).bitwiseAND(F.lit((1 << 19) - 1)), 1) + 1
        turn = F.pmod(F.xxhash64(F.lit(-r), *seed), n)
        x = let(x, lambda v: F.pmod(F.when(v < m, fold((fold(v) * odd).bitwiseAND(m - 1))).otherwise(v) + turn, n))  # noqa: B023
    return x


def slot_plan(src: DataFrame, counts: DataFrame, total: int, seed: int) -> DataFrame:
    """One row for each output slot: shard, sid, pass, block."""
    along = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    runs = counts.withColumn("first", F.coalesce(F.sum("count").over(along), F.lit(0)))
    runs = runs.join(small(src.select("sid", "n_blocks"), src.count()), "sid")
    # a row here becomes up to SHARD slots: dealt to as many tasks as there are slots for
    runs = runs.repartition(total // TASK_SLOTS + 1, "sid", "shard")
    slots = runs.select("shard", "sid", "n_blocks", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("count") - 1)).alias("i"))
    slots = slots.withColumns({"pass": F.expr("i div n_blocks"), "j": F.expr("i % n_blocks")})
    block = permuted(F.col("j"), F.col("n_blocks"), F.lit(seed), F.col("sid"), F.col("pass"))
    return slots.select("shard", "sid", "pass", block.alias("block"))


def _keys(docs: DataFrame) -> list[Column]:
    """Two columns that tell rows apart by all their columns."""
    return [F.xxhash64(*[F.col(c) for c in docs.columns]).alias("__k"), *row_key()[1:]]


def mix_plan(docs: DataFrame, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Documents with their place in their source (sid, place, size, block length, keys of the row),
    and how often each block is used (sid, block, uses)."""
    words = F.regexp_count(text_of(), F.lit(r"[^\x20\x09-\x0D]+"))
    sizes = written(docs.select("doc_id", "source", words.cast(LONG).alias("size"), *_keys(docs)), "mix-sizes")
    rows = sizes.count()
    src = written(targets(sizes), "mix-sources")
    n_src = src.count()
    total = src.agg(F.coalesce(F.sum("n_slots"), F.lit(0))).first()[0]
    placed = sizes.join(small(src, n_src), sizes["source"].eqNullSafe(src["source"])).drop("source")
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "__k"), F.lit(rows // CHUNK + 1)))
    sums = placed.groupBy("sid", "chunk").agg(F.sum("size").alias("n"))
    sums = sums.withColumn("first", F.coalesce(F.sum("n").over(Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy("sid", "chunk").orderBy("doc_id", "__k", "size")
    placed = placed.withColumns({"rn": F.row_number().over(inside), "at": F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    placed = placed.join(sums.select("sid", "chunk", "first"), ["sid", "chunk"]).withColumn("at", F.col("at") + F.col("first")).drop("first")
    uses = slot_plan(src, shard_counts(src, total, seed), total, seed).groupBy("sid", "block").agg(F.count("*").alias("uses"))
    return placed.withColumnRenamed("block", "len"), uses


def taken_parts(placed: DataFrame, uses: DataFrame) -> DataFrame:
    """Documents by the blocks they lie in: lo and n (words, within the document) and uses; rows of
    size 0 once, with null lo."""
    last = F.expr("(at + size - 1) div len")
    blocks = placed.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.expr("at div len"), last))))
    parts = blocks.join(uses, ["sid", "block"], "left").withColumn("uses", F.coalesce("uses", F.lit(0)))
    lo = F.greatest(F.col("at"), F.col("block") * F.col("len"))
    hi = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * F.col("len"))
    return parts.withColumns({"lo": lo - F.col("at"), "n": hi - lo})


def mix_report(docs: DataFrame, seed: int = 42) -> DataFrame:
    """Per document: doc_id, size, source_size, target and taken, the words that the mix takes."""
    parts = taken_parts(*mix_plan(docs, seed))
    taken = F.coalesce(F.sum(F.col("n") * F.col("uses")), F.lit(0)).cast(LONG)
    out = parts.groupBy("sid", "chunk", "rn", "doc_id", "size", "source_size", "target").agg(taken.alias("taken"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, seed: int = 42) -> DataFrame:
    """docs with the words that the mix takes: text is the parts taken once in order, then, after a
    newline, those taken again; n_chars follows it. Documents of which nothing is taken go."""
    parts = taken_parts(*mix_plan(docs, seed)).where("uses > 0")
    cuts = parts.groupBy("sid", "chunk", "rn", "__k", "__d", "size").agg(
        F.array_sort(F.collect_list(F.struct("lo", "n", "uses"))).alias("__cuts"), F.sum("n").alias("__once")
    ).select("__k", "__d", F.col("size").alias("__size"), "__cuts", "__once")
    whole = docs.select(F.struct(*docs.columns).alias("__row"), *_keys(docs)).groupBy("__k", "__d").agg(F.first("__row").alias("__row"))
    both = whole.join(cuts, ["__k", "__d"]).withColumn("__pieces", F.regexp_extract_all(F.col("__row.text"), F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0)))

    def cut(least: int) -> Column:
        chosen = F.filter(F.col("__cuts"), lambda c: c["uses"] >= least)
        return F.array_join(F.flatten(F.transform(chosen, lambda c: F.slice(F.col("__pieces"), (c["lo"] + 1).cast("int"), c["n"].cast("int")))), "")

    once = F.when(F.col("__once") == F.col("__size"), F.col("__row.text")).otherwise(F.rtrim(cut(1)))
    again = F.rtrim(cut(2))
    out = both.select(*[F.col(f"__row.`{c}`") for c in docs.columns if c != "text"], F.when(again == "", once).otherwise(F.concat(once, F.lit("\n"), again)).alias("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)

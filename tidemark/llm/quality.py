"""Quality rules: plain rules, and a hashed n-gram likelihood ratio.

Multinomials over hashed n-grams (one and two tokens) are counted: one over every document, and one
over each half of a trusted target, all documents labelled good. A document's score is its mean log
ratio, target over raw, over its n-grams. It is scored with the half of the target that it isn't in (halves by hashed
id), so no document's own counts speak for it. A bucket's ratio is (target + PRIOR) / (expected + PRIOR), where
expected is what the raw distribution lets the target have: buckets that can't be judged yet count for nothing, and more
data moves them to their ratio instead of moving the scale.

A document is kept if it passes the plain rules and its score reaches the cut: the QUANTILE of the target's own scores
(each by the other half) less MARGIN. Without good labels all scores are 0 and the plain rules alone decide.
All columns are DataFrame functions.

Null and empty texts have no words and fail the rules. Rows with the same doc_id are judged one by one.
Columns of the input that bear a result's name are replaced by it.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._shared import WS, let, small, text_of, words_of, written

BUCKETS = 1 << 16
#: Counts that a bucket's ratio is drawn to 1 with.
PRIOR = 4.0
#: The cut: this quantile of the target's scores, less a margin in nats per n-gram; of texts with MIN_WORDS words.
QUANTILE, MARGIN, MIN_WORDS = 0.005, 0.1, 50
SYMBOLS = "#*$%&|<>"
TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"
#: Weights are kept as whole numbers of 1/SCALE nats, within two bytes: sums don't depend on their order.
SCALE, MOST = 4000, 32_767
#: Up to so many windows found twice, their places are looked up; beyond, all windows are sorted.
FEW = 24
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")


def tokens_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def bucket(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(BUCKETS)).cast("int")


def repeat_words(words: Column) -> Column:
    """How many words stand in 3-word windows that the array has twice or more. Windows are told
    apart by 64-bit hashes; only arrays with many windows twice are sorted with their places."""

    def total(p: Column) -> Column:
        gaps = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda acc, g: acc + g)

    def few(windows: Column, twice: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.size(windows) - 1), lambda i: F.array_contains(twice, F.get(windows, i)))
        return let(places, total)

    def twice_of(windows: Column) -> Column:
        return let(F.sort_array(windows), lambda s: F.array_distinct(F.filter(s, lambda x, k: x.eqNullSafe(F.get(s, k + 1)))))

    def covered(windows: Column) -> Column:
        return let(twice_of(windows), lambda t: F.when(F.size(t) <= FEW, few(windows, t)).otherwise(many(windows)))

    def many(windows: Column) -> Column:
        pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            same = lambda k, j: F.get(s, k)["h"].eqNullSafe(F.get(s, j)["h"])
            own = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: (k > 0) & same(k, k - 1) | same(k, k + 1))
            return F.sort_array(F.transform(own, lambda k: F.get(s, k)["i"]))

        return let(let(pairs, starts), total)

    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    )
    found = let(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(F.lit(0).cast("long")))
    return F.when(F.size(words) >= 3, found).otherwise(F.lit(0).cast("long"))


def base_rules(text: Column) -> dict[str, Column]:
    """The plain counts of a text that isn't null."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WS)) != "")
    counted = let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).alias("twice")))
    return {
        "__words": counted,
        "word_chars": F.length(F.translate(text, WS, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    }


def half_of(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(11), doc_id), F.lit(2)).cast("int")


def target_ids(labels: DataFrame) -> DataFrame:
    """(__id, __t): every document labelled good and its half."""
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("__id")).distinct()
    good = written(good.withColumn("__t", half_of(F.col("__id"))), "quality-target")
    return small(good, good.count())


def ngram_weights(docs: DataFrame, target: DataFrame) -> DataFrame:
    """(__half, __table): for each half of the target each bucket's log ratio in units of 1/SCALE nats, two rows of BUCKETS numbers
    whatever the input. One pass over all documents, in which a task sends at most BUCKETS sums."""
    marked = docs.select(F.col("doc_id").alias("__id"), text_of().alias("__x")).join(target, "__id", "left")
    tokens = marked.select("__t", tokens_of(F.col("__x")).alias("__w"))
    pairs = tokens.select("__t", F.inline(F.arrays_zip(F.col("__w").alias("a"), F.expr("slice(__w, 2, size(__w))").alias("b"))))
    both = F.when(F.col("b").isNull(), F.array(bucket(F.col("a")))).otherwise(F.array(bucket(F.col("a")), bucket(F.col("a"), F.col("b"))))
    counts = (
        pairs.select("__t", F.explode(both).alias("bucket")).groupBy("bucket")
        .agg(F.count("*").alias("raw"), (F.count("__t") - F.coalesce(F.sum("__t"), F.lit(0))).alias("t0"), F.coalesce(F.sum("__t"), F.lit(0)).alias("t1"))
    )
    counts = written(counts, "quality-counts")
    raw, *totals = counts.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("raw", "t0", "t1"))).first()

    def weight(k: int) -> Column:
        expected = (F.col("raw") + 1) / F.lit(float(raw + BUCKETS)) * F.lit(float(totals[k]))
        ratio = F.round(SCALE * F.log((F.col(f"t{k}") + PRIOR) / (expected + PRIOR)))
        return F.coalesce(F.greatest(F.lit(-MOST), F.least(F.lit(MOST), ratio)), F.lit(0)).cast("smallint").alias(f"w{k}")

    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left")
    rows = every.select(F.struct("bucket", weight(0), weight(1)).alias("x")).agg(F.array_sort(F.collect_list("x")).alias("x"))  # BUCKETS of them
    tables = F.array(*(F.struct(F.lit(k).alias("__half"), F.transform("x", lambda x: x[f"w{k}"]).alias("__table")) for k in (0, 1)))  # noqa: B023
    return written(rows.select(F.inline(tables)), "quality-weights")


def scored(docs: DataFrame, weights: DataFrame) -> DataFrame:
    """docs with __table, the weights by the half of the target that a document isn't in."""
    return docs.withColumn("__half", 1 - half_of(F.col("doc_id"))).join(F.broadcast(weights), "__half").drop("__half")


def score_of(text: Column, table: Column) -> Column:
    """Mean log ratio of a text's n-grams; 0 without any."""

    def mean(w: Column) -> Column:
        one = lambda i: F.get(table, bucket(F.get(w, i))).cast("int")
        two = lambda i: F.when(i + 1 < F.size(w), F.get(table, bucket(F.get(w, i), F.get(w, i + 1))).cast("int")).otherwise(0)
        total = F.aggregate(F.sequence(F.lit(0), F.size(w) - 1), F.lit(0).cast("long"), lambda acc, i: acc + one(i) + two(i))
        return F.when(F.size(w) == 0, F.lit(0.0)).otherwise(total / F.lit(float(SCALE)) / (2 * F.size(w) - 1))

    return let(tokens_of(text), mean)


def quantile(scores: DataFrame, q: float) -> float | None:
    """The exact quantile of scores, interpolated between neighbours; None of none. A histogram of at most 2 * MOST + 1
    cells finds the cells of the neighbours, and only these cells' values are looked at one by one."""
    cell = F.floor(F.col("score") * SCALE)
    counts = scores.groupBy(cell.alias("cell")).agg(F.count("*").alias("held")).orderBy("cell").toArrow()
    cells, ends = counts.column("cell").to_numpy(), np.cumsum(counts.column("held").to_numpy())
    if not len(cells):
        return None
    at = q * (int(ends[-1]) - 1)
    ranks = math.floor(at), math.ceil(at)
    first, last = (int(x) for x in np.searchsorted(ends, ranks, side="right"))
    near = scores.where(cell.isin([int(cells[first]), int(cells[last])])).groupBy("score").agg(F.count("*").alias("held")).orderBy("score").toArrow()
    upto = np.cumsum(near.column("held").to_numpy()) + (int(ends[first - 1]) if first else 0)
    low, high = (float(near.column("score")[int(x)].as_py()) for x in np.searchsorted(upto, ranks, side="right"))
    return low if low == high else (ranks[1] - at) * low + (at - ranks[0]) * high


def cut_of(docs: DataFrame, target: DataFrame, weights: DataFrame) -> float:
    """The score that documents must reach."""
    own = docs.select("doc_id", text_of().alias("__x")).join(target.withColumnRenamed("__id", "doc_id"), "doc_id", "left_semi").where(F.size(words_of(F.col("__x"))) >= MIN_WORDS)
    found = quantile(written(scored(own, weights).select(score_of(F.col("__x"), F.col("__table")).alias("score")), "quality-scores"), QUANTILE)
    return float("-inf") if found is None else found - MARGIN


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, score and kept."""
    target = target_ids(labels)
    weights = ngram_weights(docs, target)
    cut = cut_of(docs, target, weights)
    text = text_of()
    own = [c for c in docs.columns if c not in RESULTS]
    out = scored(docs, weights).select(*own, *(c.alias(k) for k, c in base_rules(text).items()), score_of(text, F.col("__table")).alias("score"))
    out = out.withColumns({"n_words": F.col("__words.n"), "n_repeat_words": F.col("__words.twice")}).drop("__words")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= cut))

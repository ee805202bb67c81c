"""Line dedup: explode normalised lines, hash, count distinct documents per hash, drop lines
over the threshold, reassemble by position.

A line's key is the line without ASCII white space at both ends, A-Z lower-cased. A key of
at least min_chars code points found in at least min_docs documents keeps its lines only in
the largest doc_id holding it.

Null and empty texts are one empty line. Rows with one doc_id (null is an id of its own, the
smallest) are one document for counting; each row is cut on its own. Columns of the input
named n_lines or n_dropped are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._shared import WS, ascii_lower, row_key, small, text_of, written

MIN_CHARS = 40
MIN_DOCS = 5
#: Dropped lines (8 bytes each, and 24 a document) up to which their places are broadcast.
PLACES = 1_000_000


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs (doc_id, text, ...) with the text cut, n_lines (before) and n_dropped.

    A first count of lines, which is at least the count of documents, leaves few lines for the
    exact steps; both counts are pre-aggregated in each task, so a line that is everywhere costs
    a row a task. Which side of a join is broadcast is decided by counted rows.
    """
    lines = F.split(text_of(), "\n")
    rows = (
        docs.select(*row_key(), F.col("doc_id").alias("__id"), F.posexplode(lines).alias("__pos", "__line"))
        .withColumn("__key", ascii_lower(F.btrim("__line", F.lit(WS)))).where(F.length("__key") >= min_chars)
        .select("__k", "__d", "__id", "__pos", F.xxhash64("__key").alias("__h1"), F.xxhash64(F.lit(7), "__key").alias("__h2"))
    )
    often = written(rows.groupBy("__h1", "__h2").agg(F.count("*").alias("__n")).where(F.col("__n") >= min_docs).drop("__n"), "lines-often")
    found = written(rows.join(small(often, often.count()), ["__h1", "__h2"], "left_semi"), "lines-found")
    hot = (
        found.select("__h1", "__h2", "__id").distinct().groupBy("__h1", "__h2")
        .agg(F.count("*").alias("__n"), F.max("__id").alias("__keeper")).where(F.col("__n") >= min_docs).drop("__n")
    )
    hot = written(hot, "lines-hot")
    dropped = found.join(small(hot, hot.count()), ["__h1", "__h2"]).where(~F.col("__id").eqNullSafe(F.col("__keeper")))
    dropped = written(dropped.select("__k", "__d", "__pos").distinct(), "lines-dropped")
    # few places to drop come to the texts; else both sides are dealt by document
    drops = small(dropped.groupBy("__k", "__d").agg(F.collect_list("__pos").alias("__drop")), dropped.count(), PLACES)
    keyed = docs.select(*[c for c in docs.columns if c not in ("n_lines", "n_dropped")], *row_key())
    out = keyed.join(drops, ["__k", "__d"], "left").withColumn("__lines", lines)
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__drop")), lambda i: F.get(F.col("__lines"), i))
    cut = out.withColumns({
        "text": F.when(F.col("__drop").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")),
        "n_lines": F.size("__lines").cast("long"),
        "n_dropped": F.when(F.col("__drop").isNull(), 0).otherwise(F.size("__drop")).cast("long"),
    })
    return cut.select(*docs.columns, *[c for c in ("n_lines", "n_dropped") if c not in docs.columns])

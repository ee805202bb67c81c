"""Helpers of the training-data operators: shared folder, small column tools."""

from __future__ import annotations

import atexit
import ctypes
import io
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a written table is broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: The ASCII white space that separates words.
WS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_own: dict[str, str] = {}
_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where that is unset, one of our own (removed at exit)."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return f"file://{_own[app]}"


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/tidemark-{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df, written to the shared folder and read again: the lineage ends there, so that
    a lost executor costs no more than its own tasks."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    tidy()
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows are few; else Spark's shuffle joins hold."""
    return F.broadcast(df) if rows <= limit else df


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, which may not share the driver's folders."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    top = Path(__file__).resolve().parents[1]
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, str(p.relative_to(top.parent)))
    folder = tempfile.mkdtemp(prefix="tidemark-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    Path(folder, "tidemark_code.zip").write_bytes(buffer.getvalue())
    spark.sparkContext.addPyFile(os.path.join(folder, "tidemark_code.zip"))


def tidy() -> None:
    """Gives memory that a Python worker has freed back to the machine: workers are kept between tasks."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # other C libraries have none
        pass


def lean(step):
    """An Arrow step that tidies up after each batch that it made, and at its end."""

    def run(batches):
        for made in step(batches):
            yield made
            tidy()
        tidy()

    return run


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text that isn't null, as an array."""
    trimmed = F.btrim(text, F.lit(WS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def row_key(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """Two columns that tell rows apart by id and text; rows alike in both share them."""
    return [F.xxhash64(F.col(id_col), F.col(text_col)).alias("__k"), F.coalesce(F.col(id_col), F.lit(0)).cast("long").alias("__d")]

"""Sends this package to the executors, whose Python workers may not see the driver's folders."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    top = Path(__file__).resolve().parents[1]
    packed = Path(tempfile.mkdtemp(prefix="tidemark-stream-code-"), "tidemark_stream_code.zip")
    with zipfile.ZipFile(packed, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, str(p.relative_to(top.parent)))
    spark.sparkContext.addPyFile(str(packed))
    _sent.add(app)

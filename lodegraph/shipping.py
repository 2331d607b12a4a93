"""Gives executors this package, wherever the driver imported it from."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

#: Rows and bytes of text that a Python worker takes at once.
ARROW_ROWS = 512
BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Adds the package's sources to the session's Python files, once a context."""
    context = spark.sparkContext
    if getattr(context, "_lodegraph_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="lodegraph-"), "lodegraph_sources.zip")
    with zipfile.ZipFile(target, "w") as out:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.join("lodegraph", os.path.relpath(path, here)))
    context.addPyFile(target)
    context._lodegraph_shipped = True


def bounded_arrow(spark: SparkSession) -> None:
    """Keeps what is read at once, and what passes between the JVM and Python, small enough for long texts; ships the
    package. These settings of the session stay."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", ARROW_ROWS)

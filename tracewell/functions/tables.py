"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[str] = []



#: Rows of a table of files, ranges or keys that is still sent to all executors (some 100 bytes each).
FEW = 500_000
#: Rows and bytes of one Arrow batch sent to a Python worker; contents may be large, so both stay small.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches, unless it has tighter bounds."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def few(df: DataFrame) -> DataFrame:
    """df marked for broadcast if it has at most FEW rows; beyond, the join shuffles."""
    return F.broadcast(df) if df.count() <= FEW else df


def persisted(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write df as Parquet under spark.checkpoint.dir, in folders by a column if one is given, and read it back; where that is unset, a new folder of this machine serves local sessions only."""
    path = shared_folder(df.sparkSession, label)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder that driver and executors share, deleted at the session's end."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tracewell-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(cleanup, spark)
    _written.append(path)
    return path


def cleanup(spark: SparkSession) -> None:
    """Deletes the intermediate tables of this session; results that still read them must have been written before."""
    while _written:
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_written.pop())
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may be gone at exit
            _written.clear()


def starts(sizes: DataFrame, part: str, n: str) -> DataFrame:
    """(part, start): for each range of a sorted table, the sum of the ranges before; one number for each range goes to the driver."""
    rows, at = [], 0
    for p, size in sorted((r[part], r[n]) for r in sizes.collect()):
        rows.append((p, at))
        at += size
    return sizes.sparkSession.createDataFrame(rows, f"{part} int, start long")

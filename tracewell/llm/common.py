"""Shared helpers: the shared intermediate folder, table reads and group iteration over sorted Arrow batches."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch sent to a Python worker; texts may be very long, so both stay small.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20

_written: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors and the driver share: spark.checkpoint.dir, or a new local one where it is unset and all run on this machine (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tracewell-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def persisted(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back; lineage ends there, so a lost executor costs nothing upstream."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _written:
        atexit.register(cleanup, spark)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def release(df: DataFrame) -> None:
    """Delete what persisted() wrote for df, once nothing reads it any more."""
    path = getattr(df, "_written_to", None)
    if path in _written:
        _written.remove(path)
        drop(df.sparkSession, path)


def cleanup(spark: SparkSession) -> None:
    """Delete the intermediate tables of this session; results that still read them must have been written before."""
    while _written:
        drop(spark, _written.pop())


def drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone at exit
        pass


def python_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches, unless it has tighter bounds."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def starts(sizes: DataFrame, part: str = "part", n: str = "n") -> DataFrame:
    """(part, start): for each range of a sorted table, the sum of the ranges before; one number for each range goes to the driver."""
    rows, at = [], 0
    for p, size in sorted((r[part], r[n]) for r in sizes.collect()):
        rows.append((p, at))
        at += size
    return sizes.sparkSession.createDataFrame(rows, f"{part} int, start long")


def crc_bucket(column: str, modulus: int):
    """crc32 of the id as text, modulo: the split into learned and held-out rows; null ids count as bucket of the empty string."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys in sorted batches, each as one table; a run may span batches."""
    import numpy as np

    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(n, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), n]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(c[a] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)

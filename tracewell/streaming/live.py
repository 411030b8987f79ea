"""Structured Streaming: stateless parsers line by line, all parsers file by file, and windowed correlation with a watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracewell.functions.tables import persisted
from tracewell.sources import lines as L
from tracewell.sources.parsers import PARSERS, Options, parse

#: Parsers without state over lines; the others need whole files.
STATELESS = frozenset(PARSERS) - {"auth", "syslog", "messages", "kern", "cron", "auditd", "bash_history", "csv", "apt", "udev"}


def read_stream(spark: SparkSession, folder: str, kind: str, options: Options = Options()) -> DataFrame:
    """Events of text files that arrive in a folder; line numbers are unknown in a stream."""
    if kind not in STATELESS:
        raise ValueError(f"{kind} needs whole files")
    lines = spark.readStream.format("text").load(folder).select(F.col("value").alias("line"), F.element_at(F.split("_metadata.file_path", "/"), -1).alias("src_file"), F.lit(None).cast("int").alias("line_no"), F.year("_metadata.file_modification_time").alias("file_year"))
    return parse(lines, kind, options)


def ingest_stream(spark: SparkSession, folder: str, kind: str, out: str, checkpoint: str, options: Options = Options(), **trigger) -> StreamingQuery:
    """Parses text files that arrive in a folder, by any parser, into a table of events at out.

    A file arrives whole in one micro-batch, so parsers that carry state from line to line (years, audit records, blocks)
    see what they see in a batch, and rows equal those of engine.ingest. Each micro-batch writes the folder of its own
    number, so one that is repeated after a restart from the checkpoint replaces what it had written. trigger: as for
    DataStreamWriter.trigger; files per batch are bounded by the source's own option, maxFilesPerTrigger, 1000 here.
    """
    root, _ = L.root_of(spark, folder)
    text = spark.readStream.format("text").option("lineSep", "\n").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1000).load(folder)
    path = L.path_of(F.col("_metadata.file_path"))
    rows = text.select(path.alias("path"), L.label_of(path, root).alias("src_file"), F.col("_metadata.file_block_start").alias("block"), F.year("_metadata.file_modification_time").alias("file_year"), "value")

    def written(batch: DataFrame, number: int) -> None:
        raw = persisted(batch.withColumn("pos", F.monotonically_increasing_id()), "stream")
        parse(L.numbered(raw), kind, options).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return rows.writeStream.foreachBatch(written).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def bursts(events: DataFrame, matches: Column, by: str, length: str = "5 minutes", least: int = 5, late: str = "10 minutes") -> DataFrame:
    """Windows in which a key has at least ``least`` matching events; rows later than the watermark are dropped."""
    ts = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    n = ts.where(matches).groupBy(F.window("ts", length), F.col(by)).agg(F.count("*").alias("n"))
    return n.where(F.col("n") >= least).select(by, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")


def sessions(events: DataFrame, by: str, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a key that end after a gap."""
    ts = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return ts.groupBy(F.session_window("ts", gap), F.col(by)).agg(F.count("*").alias("n")).select(by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")

"""Triage marks as an append-only log; the state of a mark is its latest version."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators.timeline import with_seq

MARKS = "mid long, version long, event_id long, state string, label string, note string, created timestamp_ntz, context string, rule string, deleted boolean"
STATES = ("pending", "TP", "FP", "discarded")


class Marks:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def log(self) -> DataFrame:
        try:
            return self.spark.read.schema(MARKS).parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], MARKS)

    def current(self) -> DataFrame:
        latest = self.log().groupBy("mid").agg(F.max_by(F.struct("*"), "version").alias("m"))
        return latest.select("m.*").where("not deleted")

    def _append(self, row: DataFrame) -> None:
        row.select(*[f.strip().split()[0] for f in MARKS.split(",")]).coalesce(1).write.mode("append").parquet(self.path)

    def add(self, event_id: int | None, state: str = "pending", label: str | None = None, note: str | None = None, rule: str | None = None, context: str | None = None) -> int:
        if state not in STATES:
            raise ValueError(f"no state {state}")
        mid = uuid.uuid4().int >> 65  # 63 random bits: writers need not know of each other
        row = self.spark.createDataFrame([(mid, 1, event_id, state, label, note, None, context, rule, False)], MARKS).withColumn("created", F.localtimestamp())
        self._append(row)
        return mid

    def update(self, mid: int, state: str | None = None, label: str | None = None, note: str | None = None, deleted: bool = False) -> None:
        old = self.current().where(F.col("mid") == mid)
        values = {"state": state, "label": label, "note": note}
        new = old.withColumns({k: F.coalesce(F.lit(v).cast("string"), F.col(k)) for k, v in values.items()}).withColumn("deleted", F.lit(deleted)).withColumn("version", F.col("version") + 1)
        self._append(self.spark.createDataFrame(new.collect(), MARKS))  # one row

    def delete(self, mid: int) -> None:
        self.update(mid, deleted=True)

    def counts(self) -> DataFrame:
        return self.current().groupBy("state").agg(F.count("*").alias("n"))

    def with_events(self, events: DataFrame) -> DataFrame:
        """Every mark with its event and the event's seq, if it is still there."""
        m = self.current()
        if "seq" not in events.columns:
            events = with_seq(events)
        return m.join(events.withColumnRenamed("id", "event_id"), "event_id", "left")

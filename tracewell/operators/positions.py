"""Positions of a case that grows: kept in ranges, of which an append numbers only those that it falls into."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell.functions.tables import few, persisted

#: Rows of one range aimed at.
RANGE_ROWS = 1_000_000
#: Rows without a time come last; ids break ties.
ORDER = ["late", "ts", "id"]
ROWS = "id long, late boolean, ts timestamp_ntz, own long, gen int, number long"
RANGES = "late boolean, ts timestamp_ntz, id long, n long, top long, gen int, number long"


def _keyed(events: DataFrame) -> DataFrame:
    return events.select(F.col("ts").isNull().alias("late"), "ts", F.col("id").cast("long").alias("id"))


class Positions:
    """1-based positions by (ts, id) below a folder that all executors share.

    rows/gen=G/number=R: the rows of a range with their place in it, written by append G. ranges/gen=G: after append G, the
    first key, size and place of each range, in which a reader finds all it needs; an append counts from when this table is
    complete, so one that breaks off changes nothing and is replaced by the next. Positions are a row's place in its range
    plus the sizes of the ranges before, so an append rewrites the ranges its rows fall into and no others. These are cut
    anew at RANGE_ROWS, also if all rows fall into one. One writer at a time.

    Ids must be distinct and not be there yet. An append of no rows changes nothing; without an append there are no positions.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _found(self, folder: str) -> list:
        root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return [(fs, x.getPath()) for x in fs.listStatus(root) if x.isDirectory()] if fs.exists(root) else []

    def generation(self) -> int:
        """Number of the last complete append; 0: none."""
        return max((int(p.getName().split("=")[1]) for fs, p in self._found(f"{self.path}/ranges") if fs.exists(p.suffix("/_SUCCESS"))), default=0)

    def ranges(self) -> DataFrame:
        """A row for each range: first key, size, largest id, and where its rows lie."""
        return self.spark.read.schema(RANGES).parquet(f"{self.path}/ranges/gen={self.generation()}")

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(ROWS).parquet(f"{self.path}/rows")

    def _placed(self, new: DataFrame, ranges: DataFrame) -> DataFrame:
        """new with old, the range that each row falls into: the last one that begins at or before it.

        First keys and new rows are sorted together; each part looks at its own, and the last first key of a part passes on.
        """
        firsts = ranges.select(*ORDER, F.col("number").alias("old"), F.lit(0).alias("kind"))
        both = firsts.unionByName(new.select(*ORDER, F.lit(None).cast("long").alias("old"), F.lit(1).alias("kind")))
        both = persisted(both.repartitionByRange(*ORDER).withColumn("part", F.spark_partition_id()), "pos")
        least = ranges.agg(F.min_by("number", F.struct(*ORDER)).alias("least")).first()["least"]
        ends = both.groupBy("part").agg(F.max_by("old", F.when(F.col("kind") == 0, F.struct(*ORDER))).alias("end"))
        # one row for each part
        ends = ends.select("part", F.last("end", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("end"))
        own = F.last("old", ignorenulls=True).over(Window.partitionBy("part").orderBy(*ORDER, "kind").rowsBetween(Window.unboundedPreceding, 0))
        found = both.withColumn("own", own).where("kind = 1").join(F.broadcast(ends), "part")
        return found.select(*ORDER, F.coalesce("own", "end", F.lit(least)).alias("old"))

    def top(self) -> int | None:
        """The largest id that has a position."""
        return self.ranges().agg(F.max("top").alias("top")).first()["top"] if self.generation() else None

    def add(self, events: DataFrame) -> None:
        """Takes in events (id, ts)."""
        last, new = self.generation(), persisted(_keyed(events), "pos")
        gen, kept = last + 1, self.spark.createDataFrame([], RANGES)
        if last:
            placed = persisted(self._placed(new, self.ranges()), "pos")
            touched = few(persisted(placed.select(F.col("old").alias("number")).distinct(), "pos"))
            kept = self.ranges().join(touched, "number", "left_anti")
            stay = self._rows().join(few(self.ranges().select("gen", "number").join(touched, "number")), ["gen", "number"])
            placed = placed.unionByName(stay.select(*ORDER, F.col("number").alias("old")))
        else:
            placed = new.withColumn("old", F.lit(-1).cast("long"))
        total = placed.count()
        if not total:
            return
        cut = persisted(placed.repartitionByRange(math.ceil(total / RANGE_ROWS), *ORDER).withColumn("part", F.spark_partition_id()), "pos")
        # a range is what one part holds of an old range: nothing lies between its rows
        made = cut.groupBy("old", "part").agg(F.min(F.struct(*ORDER)).alias("low"), F.count("*").alias("n"), F.max("id").alias("top"))
        made = persisted(made.withColumn("number", F.lit(gen << 32) + F.row_number().over(Window.orderBy("low"))), "pos")
        own = F.row_number().over(Window.partitionBy("number").orderBy(*ORDER)).cast("long")
        rows = cut.join(few(made.select("old", "part", "number")), ["old", "part"]).withColumn("own", own)
        rows.select("id", "late", "ts", "own", "number").write.mode("overwrite").partitionBy("number").parquet(f"{self.path}/rows/gen={gen}")
        made = made.select("low.*", "n", "top", F.lit(gen).alias("gen"), "number")
        kept.select(made.columns).unionByName(made).write.mode("overwrite").parquet(f"{self.path}/ranges/gen={gen}")

    def seq(self) -> DataFrame:
        """id, seq of all rows."""
        before = F.coalesce(F.sum("n").over(Window.orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        starts = few(self.ranges().select("gen", "number", before.alias("start")))  # one row for each range
        return self._rows().join(starts, ["gen", "number"]).select("id", (F.col("own") + F.col("start")).alias("seq"))

    def vacuum(self) -> None:
        """Deletes what the last append replaced; nobody may be reading an earlier state."""
        last = self.generation()
        if not last:
            return
        live = {(r["gen"], r["number"]) for r in self.ranges().select("gen", "number").collect()}  # one row for each range
        for fs, p in self._found(f"{self.path}/ranges"):
            if int(p.getName().split("=")[1]) < last:
                fs.delete(p, True)
        for _, g in self._found(f"{self.path}/rows"):
            for fs, p in self._found(g.toString()):
                if (int(g.getName().split("=")[1]), int(p.getName().split("=")[1])) not in live:
                    fs.delete(p, True)

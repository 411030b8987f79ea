"""Global positions, pages, sorting and context around anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell.functions.columns import extra
from tracewell.functions.tables import persisted, starts
from tracewell.schema import SHOWN, TYPES

MOST_ROWS_AROUND, MOST_TIME_ROWS = 5000, 800


def with_seq(events: DataFrame) -> DataFrame:
    """events with seq, their 1-based position by (ts, id), rows without ts last.

    No single partition sorts everything: narrow rows are cut into ranges, each range numbers its own, and the driver
    adds up one count for each range.
    """
    late, order = F.col("ts").isNull().alias("late"), ["late", "ts", "id"]
    ranged = events.select("id", "ts", late).repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    ranged = persisted(ranged, "seq")
    first = starts(ranged.groupBy("part").agg(F.count("*").alias("n")), "part", "n")
    own = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    # two numbers for each range
    placed = ranged.select("id", "part", own.alias("own")).join(F.broadcast(first), "part")
    return events.join(placed.select("id", (F.col("own") + F.col("start")).cast("long").alias("seq")), "id")


def ordering(sort: str | None = None, desc: bool = False) -> list[Column]:
    """Nulls last in both directions, id as tie-break; an unknown column gives the default order."""
    if sort and sort.lower().startswith("x:"):
        c = extra(sort[2:])
    elif sort in TYPES or sort in ("id", "seq"):
        c = F.col(f"`{sort}`")
    else:
        return [F.col("ts").asc_nulls_last(), F.col("id").asc()]
    tie = F.col("id").desc() if desc and sort in ("ts", "seq") else F.col("id").asc()
    return [c.desc_nulls_last() if desc else c.asc_nulls_last(), tie]


def page(rows: DataFrame, sort: str | None = None, desc: bool = False, limit: int = 500, offset: int = 0) -> DataFrame:
    out = rows.orderBy(*ordering(sort, desc))
    return (out.offset(offset) if offset else out).limit(limit)


def shown(rows: DataFrame) -> DataFrame:
    """The columns of a result page."""
    return rows.select(*(["seq"] if "seq" in rows.columns else []), "id", *SHOWN)


def in_range(rows: DataFrame, start: str | None = None, end: str | None = None, source: str | None = None) -> DataFrame:
    """Inclusive time range (rows without ts drop out) and source; (all) and '' are no filter. A bare end date is its midnight."""
    if source and source != "(all)":
        rows = rows.where(F.col("source") == source)
    if start:
        rows = rows.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end:
        rows = rows.where(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))
    return rows


def context_rows(seqd: DataFrame, anchors: DataFrame, before: int, after: int) -> DataFrame:
    """(anchor, seq, id, ...): rows within before/after positions of each anchor id.

    Positions are exact, so the range join is an equi-join on generated positions; no cross product arises.
    """
    before, after = (min(max(0, x), MOST_ROWS_AROUND) for x in (before, after))
    at = seqd.join(anchors.select(F.col("id").alias("anchor")).distinct(), F.col("id") == F.col("anchor"))
    want = at.select("anchor", F.explode(F.sequence(F.col("seq") - before, F.col("seq") + after)).alias("seq"))
    return want.join(seqd, "seq")


def context_time(events: DataFrame, anchors: DataFrame, seconds_before: int, seconds_after: int, parts: int | None = None) -> DataFrame:
    """(anchor, id, ts, ...): rows within a time span of each row of anchors (id, ts); both sides are dealt to spans of time, so it is an equi-join with a residual.

    parts deals the spans to so many tasks, where a result is far larger than what is shuffled for it.
    """
    span = max(1, seconds_before + seconds_after) * 1_000_000
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    a = anchors.where("ts is not null").select(F.col("id").alias("anchor"), us.alias("_a"))
    a = a.select("anchor", "_a", F.explode(F.sequence(F.floor((F.col("_a") - seconds_before * 1_000_000) / span), F.floor((F.col("_a") + seconds_after * 1_000_000) / span))).alias("_bin"))
    e = events.where("ts is not null").withColumn("_us", us).withColumn("_bin", F.floor(F.col("_us") / span))
    e = e.repartition(parts, "_bin") if parts else e
    near = (F.col("_us") >= F.col("_a") - seconds_before * 1_000_000) & (F.col("_us") <= F.col("_a") + seconds_after * 1_000_000)
    return e.join(a, "_bin").where(near).drop("_bin", "_us", "_a")


def last_before(events: DataFrame, probe: Column, define: Column, by: list[str], value: str) -> DataFrame:
    """As-of join: for each probe row the latest value among defining rows of the same key at or before it; one sort, no self-join."""
    w = Window.partitionBy(*by).orderBy("ts", F.when(define, 0).otherwise(1), "id").rowsBetween(Window.unboundedPreceding, 0)
    found = F.last(F.when(define, F.col(value)), ignorenulls=True).over(w)
    return events.where((probe | define) & F.col("ts").isNotNull()).withColumn("found", found).where(probe)


def islands(events: DataFrame, by: list[str], value: str) -> DataFrame:
    """Runs of equal values in time order of each key: island number and the change flag that starts it."""
    w = Window.partitionBy(*by).orderBy("ts", "id")
    changed = (~F.col(value).eqNullSafe(F.lag(value).over(w))) | (F.row_number().over(w) == 1)
    return events.withColumn("_change", changed.cast("int")).withColumn("island", F.sum("_change").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_change")

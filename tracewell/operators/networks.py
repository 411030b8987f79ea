"""Nested networks as disjoint intervals, each with its most specific network."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tracewell.functions.tables import bounded_batches

#: Rows of a batch that a sweep hands on.
OUT_ROWS = 1000


def innermost(nets: DataFrame, head: str, bounds: dict[str, Column] | None = None) -> DataFrame:
    """(head, net_start, net_end, ...) with intervals that may nest -> disjoint intervals of the same columns.

    bounds: new bounds, where intervals are cut at those of their head; of intervals that are equal then, the one that was
    narrower counts.

    A line sweeps over the sorted intervals of each head with the open ones on a stack, so a task holds as many rows as
    intervals lie in one another (an address has 32 or 128 bits). Where an interval begins, it takes over from the one
    around it, and hands back where it ends. Of equal intervals the one whose other columns sort last counts; one that
    begins inside another and ends beyond it counts to its own end.
    """
    spark, schema = nets.sparkSession, nets.schema
    bounded_batches(spark)
    keyed = schema["net_start"].dataType.simpleString() == "string"  # keys of ip_key, else numbers
    arrow = to_arrow_schema(schema)

    def number(x):
        return int(x[1:], 16) if keyed else x

    def written(n: int, like) -> str | int:
        return f"{like[0]}{n:0{len(like) - 1}x}" if keyed else n

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[int, dict]] = []
        out: list[dict] = []
        here, cursor = object(), 0

        def close(upto: int | None) -> None:
            """Ends open intervals that end before a place, or all."""
            nonlocal cursor
            while stack and (upto is None or stack[-1][0] < upto):
                end, row = stack.pop()
                take(end, row)

        def take(end: int, row: dict) -> None:
            nonlocal cursor
            if cursor <= end:
                out.append(row | {"net_start": written(cursor, row["net_start"]), "net_end": written(end, row["net_start"])})
                cursor = end + 1

        for b in batches:
            for row in b.to_pylist():
                start, end = number(row["net_start"]), number(row["net_end"])
                if row[head] != here:
                    close(None)
                    here, cursor = row[head], start
                close(start)
                if stack:
                    take(start - 1, stack[-1][1])
                cursor = start
                stack.append((end, row))
            if len(out) >= OUT_ROWS:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out.clear()
        close(None)
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    what = [c for c in nets.columns if c not in (head, "net_start", "net_end")]
    pieces = nets.withColumns({"_low": F.col("net_start"), "_high": F.col("net_end")} | (bounds or {}))
    order = [F.asc(head), F.asc("net_start"), F.desc("net_end"), F.asc("_low"), F.desc("_high"), *what]
    return pieces.repartition(head).sortWithinPartitions(*order).select(*nets.columns).mapInArrow(sweep, schema)

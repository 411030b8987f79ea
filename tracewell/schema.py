"""The normalized event row and adapters that map other tables to it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Name and type of every column of an event, after its id.
COLUMNS: list[tuple[str, T.DataType]] = [
    ("ts", T.TimestampNTZType()),
    ("source", T.StringType()),
    ("host", T.StringType()),
    ("program", T.StringType()),
    ("pid", T.IntegerType()),
    ("severity", T.StringType()),
    ("user", T.StringType()),
    ("src_ip", T.StringType()),
    ("src_port", T.IntegerType()),
    ("exe", T.StringType()),
    ("method", T.StringType()),
    ("path", T.StringType()),
    ("status", T.IntegerType()),
    ("bytes", T.LongType()),
    ("referer", T.StringType()),
    ("user_agent", T.StringType()),
    ("event", T.StringType()),
    ("message", T.StringType()),
    ("extra", T.StringType()),
    ("src_file", T.StringType()),
    ("line_no", T.IntegerType()),
    ("raw", T.StringType()),
    ("sigma_ok", T.IntegerType()),
    ("sigma_logsource", T.StringType()),
]
TYPES = dict(COLUMNS)
NUMERIC = frozenset(n for n, t in COLUMNS if isinstance(t, (T.IntegerType, T.LongType)))
EVENT_SCHEMA = T.StructType([T.StructField("id", T.LongType())] + [T.StructField(n, t) for n, t in COLUMNS])
#: What a result page shows besides seq and id.
SHOWN = [n for n, _ in COLUMNS if n not in ("extra", "raw", "sigma_ok", "sigma_logsource")]


def conform(df: DataFrame) -> DataFrame:
    """Every event column, in order; those that df lacks are null."""
    have = set(df.columns)
    out = [F.col("id").cast("long").alias("id")] if "id" in have else []
    return df.select(*out, *[(F.col(f"`{n}`") if n in have else F.lit(None)).cast(t).alias(n) for n, t in COLUMNS])


def from_app_events(events: DataFrame) -> DataFrame:
    """Event rows of an application's event table (event_id, ts, user_id, event_type, value, props)."""
    severity = F.when(F.col("event_type") == "error", "error").otherwise("info")
    user = F.col("user_id").cast("string")
    return conform(
        events.select(
            F.col("event_id").alias("id"),
            "ts",
            F.lit("app").alias("source"),
            user.alias("user"),
            severity.alias("severity"),
            F.col("event_type").alias("event"),
            F.col("event_type").alias("message"),
            F.floor("value").cast("long").alias("bytes"),
            F.col("props").alias("extra"),
            F.concat_ws(" ", F.concat(F.lit("level="), severity), F.concat(F.lit("user="), user), F.concat(F.lit("event="), F.col("event_type")), F.concat(F.lit("k="), F.get_json_object("props", "$.k"))).alias("raw"),
        )
    )

"""Facets, statistics, dashboards, histograms and network views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell.functions.columns import basename, extra, ip_class, ip_key, ip_to_long
from tracewell.functions.tables import persisted
from tracewell.operators.networks import innermost
from tracewell.schema import TYPES


def field_text(name: str) -> Column:
    if name.lower().startswith("x:"):
        return extra(name[2:])
    if name not in TYPES and name != "id":
        raise ValueError(f"no field {name}")
    return F.col(f"`{name}`").cast("string")


def facet(rows: DataFrame, name: str, limit: int = 20) -> DataFrame:
    """value, n: the commonest values, without null and empty."""
    v = rows.select(field_text(name).alias("value")).where("value is not null and value <> ''")
    return v.groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(limit)


def facet_totals(rows: DataFrame, name: str) -> DataFrame:
    """matched, distinct_values of a facet."""
    v = rows.select(field_text(name).alias("value")).where("value is not null and value <> ''")
    return v.agg(F.count("*").alias("matched"), F.countDistinct("value").alias("distinct_values"))


def extra_keys(rows: DataFrame) -> DataFrame:
    """key: distinct keys of extra, those beginning with _ hidden."""
    keys = rows.where("extra is not null").select(F.explode(F.expr("json_object_keys(extra)")).alias("key"))
    return keys.where(~F.col("key").startswith("_")).distinct()


def stats(rows: DataFrame, by: str = "source") -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def inventory(rows: DataFrame) -> DataFrame:
    """kind, name, n, first_ts, last_ts: the whole, each source and each file, in one pass."""
    names = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("name")) for k, v in (("total", F.lit("")), ("source", F.col("source")), ("file", F.col("src_file")))])
    return rows.select("ts", F.inline(names)).where("name is not null").groupBy("kind", "name").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def counters(rows: DataFrame) -> DataFrame:
    """One row: total, time span and distinct counts."""
    distinct = [F.countDistinct(c).alias(f"n_{c}") for c in ("src_ip", "user", "src_file", "source")]
    return rows.agg(F.count("*").alias("total"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), *distinct)


def tops(rows: DataFrame, limit: int = 10) -> DataFrame:
    """field, value, n, rank of the commonest values of six fields, in one pass over the rows."""
    from pyspark.sql.window import Window

    fields = {"src_ip": F.col("src_ip"), "user": F.col("user"), "program": F.col("program"), "exe": basename(F.col("exe")), "source": F.col("source"), "severity": F.coalesce("severity", F.lit("—"))}
    pairs = F.array(*[F.struct(F.lit(k).alias("field"), v.alias("value")) for k, v in fields.items()])
    n = rows.select(F.inline(pairs)).where("value is not null and value <> ''").groupBy("field", "value").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "value"))
    return n.withColumn("rank", rank).where(F.col("rank") <= limit)


def histogram(rows: DataFrame, buckets: int = 120) -> DataFrame:
    """bucket, n: equal-width buckets between the first and last ts, the last one closed, empty ones with 0; one bucket if there is no span."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    t = rows.where("ts is not null").select(us.alias("us"))
    span = t.agg(F.min("us").alias("a"), F.max("us").alias("b"))  # one row
    b = F.when(F.col("b") == F.col("a"), F.lit(0)).otherwise(F.least(F.expr(f"((us - a) * {buckets}) div (b - a)"), F.lit(buckets - 1)))
    n = t.join(F.broadcast(span)).groupBy(b.cast("long").alias("bucket")).agg(F.count("*").alias("n"))
    every = span.where("a is not null").select(F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("a") == F.col("b"), F.lit(0)).otherwise(F.lit(buckets - 1)).cast("long"))).alias("bucket"))
    return every.join(n, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def ip_detail(rows: DataFrame, ip: str) -> DataFrame:
    """One row for an address: total, span, and events of severity fail."""
    return rows.where(F.col("src_ip") == ip).agg(F.count("*").alias("total"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.when(F.col("severity") == "fail", 1)).alias("fails"))


def ip_counts(rows: DataFrame) -> DataFrame:
    return rows.where("src_ip is not null and src_ip <> ''").groupBy("src_ip").agg(F.count("*").alias("n"))


def ip_profile(rows: DataFrame, ip: str, users: int = 8, samples: int = 8) -> dict[str, DataFrame]:
    """detail, sources, users and first rows of one address."""
    own = rows.where(F.col("src_ip") == ip)
    return {
        "detail": ip_detail(rows, ip),
        "sources": own.groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source"),
        "users": facet(own, "user", users),
        "samples": own.orderBy(F.col("ts").asc_nulls_last(), "id").limit(samples),
    }


def facet_network(rows: DataFrame, ranges: DataFrame, name: str, limit: int = 20) -> DataFrame:
    """value, n: the commonest values of a column of ranges (net_start, net_end, ...) over the rows' addresses; internal ones go under internal.

    Addresses are counted before they meet the ranges, so the join sees one row for each address.
    """
    n = ip_counts(rows).withColumn("ip_number", ip_to_long(F.col("src_ip"))).where("ip_number is not null")
    placed = enrich_ip(n, ranges.select("net_start", "net_end", F.col(name).alias("value")))
    value = F.when(ip_class(F.col("src_ip")).isin("loopback", "internal"), "internal").otherwise(F.col("value"))
    counted = placed.select(value.alias("value"), "n").where("value is not null")
    return counted.groupBy("value").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "value").limit(limit)


def network(rows: DataFrame, ip: str | None = None, port: int | None = None, limit: int = 3000, source: str | None = None, event: str | None = None) -> DataFrame:
    """Rows that speak of a connection, in time order."""
    m = F.col("message")
    has = F.col("src_ip").isNotNull() | F.col("source").isin("access", "weberror") | F.col("event").like("ssh%") | m.contains("SRC=") | m.contains("SADDR=")
    out = rows.where(has)
    if ip:
        out = out.where(F.col("src_ip") == ip)
    if port is not None:
        out = out.where(F.col("src_port") == port)
    if source:
        out = out.where(F.col("source") == source)
    if event:
        out = out.where(F.col("event") == event)
    return out.orderBy(F.col("ts").asc_nulls_last(), "id").limit(limit)


def enrich_ip(rows: DataFrame, ranges: DataFrame, ip_number: str = "ip_number") -> DataFrame:
    """Left range join to (net_start, net_end, ...) over IPv4 numbers; of ranges that lie in one another the most specific counts.

    Ranges are cut at /16 boundaries and made disjoint there, so both sides meet on the upper half of the address: an
    equi-join at any size.
    """
    cut = ranges.withColumn("_hi", F.explode(F.sequence(F.shiftright("net_start", 16), F.shiftright("net_end", 16))))
    first = F.shiftleft("_hi", 16)
    cut = innermost(cut, "_hi", {"net_start": F.greatest("net_start", first), "net_end": F.least("net_end", first + 65535)})
    left = rows.withColumn("_hi", F.shiftright(ip_number, 16))
    inside = (left["_hi"] == cut["_hi"]) & (left[ip_number] >= cut["net_start"]) & (left[ip_number] <= cut["net_end"])
    return left.join(cut, inside, "left").drop("_hi", "net_start", "net_end")


def enrich_any(rows: DataFrame, ip: Column, ranges: DataFrame) -> DataFrame:
    """Left range join of addresses of either version to (net_start, net_end, ...), bounds being keys (see net_bounds); of networks that lie in one another the most specific counts.

    Both sides stand in one order of keys, where each address takes the interval that began last; no theta join. The order
    is cut into ranges of about equal size, each of which looks at its own rows, and the last interval of each range passes
    on to the later ones, so addresses that share their leading part use all tasks. A network that spans several leading
    parts is cut at each.
    """
    what = [c for c in ranges.columns if c not in ("net_start", "net_end")]
    left = rows.withColumn("_key", ip_key(ip))
    keys = persisted(left.where("_key is not null").select("_key").distinct(), "keys")
    heads = keys.select(F.substring("_key", 1, HEAD_DIGITS).alias("_head")).distinct()
    r = ranges.withColumn("_from", F.substring("net_start", 1, HEAD_DIGITS)).withColumn("_to", F.substring("net_end", 1, HEAD_DIGITS))
    narrow = r.where("_from = _to").withColumn("_head", F.col("_from"))
    wide = r.where("_from <> _to").join(heads, (F.col("_head") >= F.col("_from")) & (F.col("_head") <= F.col("_to")))
    length = F.length("net_start")
    bounds = {"net_start": F.greatest("net_start", F.rpad("_head", length, F.lit("0"))), "net_end": F.least("net_end", F.rpad("_head", length, F.lit("f")))}
    cut = innermost(narrow.unionByName(wide).select("_head", "net_start", "net_end", *what), "_head", bounds)
    marks = cut.select(F.col("net_start").alias("_key"), F.lit(0).alias("_kind"), F.struct("net_end", *what).alias("_net"))
    probes = keys.select("_key", F.lit(1).alias("_kind"), F.lit(None).cast(marks.schema["_net"].dataType).alias("_net"))
    ranged = persisted(marks.unionByName(probes).repartitionByRange("_key", "_kind").withColumn("_part", F.spark_partition_id()), "ranges")
    ends = ranged.groupBy("_part").agg(F.max_by("_net", F.when(F.col("_kind") == 0, F.col("_key"))).alias("_end"))
    # one interval for each range
    carried = ends.select("_part", F.last("_end", ignorenulls=True).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    w = Window.partitionBy("_part").orderBy("_key", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.withColumn("_at", F.last("_net", ignorenulls=True).over(w)).join(F.broadcast(carried), "_part").where("_kind = 1")
    placed = placed.withColumn("_at", F.coalesce("_at", "_carried")).where(F.col("_at.net_end") >= F.col("_key"))
    return left.join(placed.select("_key", *[F.col(f"_at.{c}").alias(c) for c in what]), "_key", "left").drop("_key")


#: Leading digits of a key at which enrich_any cuts networks: the version and 16 bits.
HEAD_DIGITS = 5

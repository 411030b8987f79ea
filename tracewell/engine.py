"""One object over a case: ingest, open, search, facets, timeline, context, rules, indicators and read-only SQL."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell import export
from tracewell.functions.columns import ip_in_cidr
from tracewell.operators import analytics, binaries, ioc, timeline
from tracewell.functions.tables import few, persisted, starts
from tracewell.operators.positions import Positions
from tracewell.plans import readonly
from tracewell.plans import rules as R
from tracewell.plans.search import EXTRA_PREFIXES, OPERATOR, Fields, compile_query, normal_name
from tracewell.schema import EVENT_SCHEMA, conform
from tracewell.sources import detect
from tracewell.sources.lines import read, root_of
from tracewell.sources.parsers import PARSERS, Options, parse

#: Columns that a saved case has Bloom filters of.
LOOKED_UP = ("src_ip", "user", "exe", "path")
#: First lines of a skipped file that its manifest row shows.
PREVIEW_LINES = 4


def ingest(spark: SparkSession, path: str, kind: str | None = None, options: Options = Options(), prefer_content: bool = False, catch_all: bool = True, start: str | None = None, end: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(events, manifest): files below path parsed by their type; rows without a time survive the time window.

    Files are opened once: their lines are written to the shared folder by type, each type is parsed once, and the
    manifest counts what the parsers wrote. The manifest has a row for each file: ok, skipped (binary, empty, or of no
    known type without catch_all) or error (with its reason; lines before a damage are kept), the base year, the number of
    events, and a preview of what was skipped. A path that is one file of no known type is a ValueError without catch_all.
    """
    files, lines = read(spark, path)
    files = persisted(files, "files")
    types = lines.select("src_file").distinct().withColumn("type", F.lit(kind)) if kind else detect.detected(lines, prefer_content, catch_all)
    types = persisted(types, "types")  # one row for each file
    if not catch_all and root_of(spark, path)[1] and files.where("not binary and error is null").count() and not types.where("type is not null").count():
        raise ValueError(f"the type of {path} cannot be told; name one of {', '.join(sorted(PARSERS))}")
    typed = persisted(lines.join(few(types.where("type is not null")), "src_file"), "lines", by="type")
    present = [r["type"] for r in types.where("type is not null").select("type").distinct().collect()]  # at most as many as there are parsers
    out = spark.createDataFrame([], EVENT_SCHEMA).drop("id")
    for t in sorted(present):
        out = out.unionByName(parse(typed.where(F.col("type") == t).drop("type"), t, options))
    if start or end:
        lo, hi = (F.lit(x).try_cast("timestamp_ntz") for x in (start or "0001-01-01", end or "9999-12-31"))
        out = out.where(F.col("ts").isNull() | F.coalesce(F.col("ts") >= lo, F.lit(True)) & F.coalesce(F.col("ts") <= hi, F.lit(True)))
    out = persisted(out, "events")
    counts = out.groupBy("src_file").agg(F.count("*").alias("events"))
    status = F.when(F.col("error").isNotNull(), "error").when(F.col("type").isNull(), "skipped").otherwise("ok")
    shown = lines.where(F.col("line_no") <= PREVIEW_LINES).groupBy("src_file").agg(F.array_sort(F.collect_list(F.struct("line_no", F.substring("line", 1, 2000).alias("line")))).alias("_l"))
    manifest = files.join(types, "src_file", "left").join(counts, "src_file", "left").join(shown, "src_file", "left")
    preview = F.when((status != "ok") & F.col("_l").isNotNull(), F.substring(F.array_join(F.transform("_l", lambda x: x["line"]), "\n"), 1, 2000))
    manifest = manifest.select("src_file", "type", F.coalesce("events", F.lit(0)).alias("events"), status.alias("status"), F.coalesce(F.lit(options.base_year), F.col("file_year")).alias("base_year"), "bytes", F.when(F.col("binary"), "binary").otherwise(F.col("error")).alias("reason"), preview.alias("preview"))
    return out, manifest


def numbered(events: DataFrame) -> DataFrame:
    """events with id: by file name, then line, counted up within ranges of files; positions add the counts before."""
    order = ["src_file", "line_no"]
    ranged = persisted(events.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ids")
    first = starts(ranged.groupBy("_part").agg(F.count("*").alias("n")), "_part", "n")
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    # two numbers for each range
    return conform(ranged.withColumn("_own", own).join(F.broadcast(first), "_part").withColumn("id", F.col("_own") + F.col("start")))


class Case:
    """Events with their positions, and everything that asks about them."""

    def __init__(self, events: DataFrame, seqd: bool = True):
        self.spark = events.sparkSession
        self.events = timeline.with_seq(events) if seqd and "seq" not in events.columns else events
        self._keys: dict[str, str | None] = {}

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Case:
        """A saved case; positions of one that was appended to come from its ranges."""
        events, kept = spark.read.parquet(path), Positions(spark, f"{path}/_positions")
        return cls(events.drop("seq").join(kept.seq(), "id") if kept.generation() else events)

    @staticmethod
    def append(spark: SparkSession, path: str, found: DataFrame) -> None:
        """Adds events without id to a saved case: ids there stay, new ones go on after them, and only the ranges of positions that new rows fall into are numbered again.

        The first append gives the case its ranges. One that broke off after its events were written is made good by the
        next, which takes in all events beyond the largest id that has a position; append no rows to do just that.
        """
        there = spark.read.parquet(path)
        top = there.agg(F.max("id").alias("top")).first()["top"]
        new = numbered(found).withColumn("id", F.col("id") + (0 if top is None else top + 1))
        Case(new, seqd=False).save(path, "append")
        kept, events = Positions(spark, f"{path}/_positions"), spark.read.parquet(path).select("id", "ts")
        covered = kept.top()
        kept.add(events if covered is None else events.where(F.col("id") > covered))

    def save(self, path: str, mode: str = "overwrite") -> None:
        """Cut into ranges of source, time and id, so one large source is many files and time and id ranges prune them; Bloom filters let a lookup skip the files of a range that lack a value."""
        ranged = self.events.repartitionByRange("source", "ts", "id").sortWithinPartitions("source", "ts", "id").write.mode(mode).partitionBy("source")
        for c in LOOKED_UP:
            ranged = ranged.option(f"parquet.bloom.filter.enabled#{c}", "true")
        ranged.parquet(path)

    @staticmethod
    def saved(spark: SparkSession, folder: str) -> list[str]:
        """Names of the cases below a folder."""
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(x.getPath().getName() for x in fs.listStatus(path) if x.isDirectory() and fs.exists(x.getPath().suffix("/_SUCCESS"))) if fs.exists(path) else []

    @staticmethod
    def reset(spark: SparkSession, path: str) -> None:
        """Deletes all events of a case; marks lie elsewhere and stay."""
        spark.createDataFrame([], EVENT_SCHEMA).write.mode("overwrite").partitionBy("source").parquet(path)

    def fields_of(self, query: str) -> Fields:
        """Fields with the extra keys that a query may name; keys of other names stay where they are, however many the logs have."""
        said = re.findall(r"[\w.\-@]+", query) if OPERATOR.search(query) else []
        plain = Fields()
        names = {normal_name(x[len(p) :] if x.lower().startswith(p) else x) for x in said for p in ("", *EXTRA_PREFIXES)} - {""}
        new = {n for n in names if n not in self._keys and plain.resolve(n) is None}
        if new:
            found = analytics.extra_keys(self.events).where(F.regexp_replace(F.lower("key"), r"[_\-.@]", "").isin(sorted(new)))
            spelt = sorted((r["key"] for r in found.collect()), reverse=True)  # spellings of names in the query
            self._keys |= {n: next((k for k in spelt[::-1] if normal_name(k) == n), None) for n in new}
        return Fields([k for n in names if (k := self._keys.get(n))])

    def matching(self, query: str, regex: bool = False, source: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
        rows = timeline.in_range(self.events, start, end, source)
        if not query.strip():
            return rows
        if regex:
            from tracewell.functions.columns import regex_text

            return rows.where(regex_text().rlike("(?iu)" + query))
        return rows.where(compile_query(query, self.fields_of(query))[0])

    def search(self, query: str, sort: str | None = None, desc: bool = False, limit: int = 500, offset: int = 0, **where) -> DataFrame:
        return timeline.shown(timeline.page(self.matching(query, **where), sort, desc, limit, offset))

    def timeline(self, sort: str | None = None, desc: bool = False, limit: int = 2000, offset: int = 0, **where) -> DataFrame:
        return timeline.shown(timeline.page(self.matching("", **where), sort, desc, limit, offset))

    def facet(self, name: str, query: str = "", limit: int = 20, **where) -> DataFrame:
        return analytics.facet(self.matching(query, **where), name, limit)

    def context(self, event_id: int, before: int = 5, after: int = 5, unit: str = "lines") -> DataFrame:
        anchor = self.events.where(F.col("id") == event_id).select("id", "ts")
        if unit == "lines":
            return timeline.context_rows(self.events, anchor, before, after).orderBy("seq")
        scale = {"minutes": 60, "seconds": 1}[unit]
        near = timeline.context_time(self.events, anchor, before * scale, after * scale).orderBy("seq").limit(timeline.MOST_TIME_ROWS + 1)
        # truncated tells that more rows than are shown lie in the span
        return near.withColumn("truncated", F.count("*").over(Window.partitionBy()) > timeline.MOST_TIME_ROWS).orderBy("seq").limit(timeline.MOST_TIME_ROWS)

    def record(self, event_id: int) -> DataFrame:
        return self.events.where(F.col("id") == event_id)

    def record_text(self, event_id: int) -> str | None:
        """The original text of an event, indented where it is JSON."""
        row = self.record(event_id).select("raw").first()
        if row is None or row["raw"] is None:
            return None
        try:
            return json.dumps(json.loads(row["raw"]), indent=2, ensure_ascii=False)
        except ValueError:
            return row["raw"]

    def snapshot(self, event_id: int, around: int = 5) -> str:
        """The lines around an event as text, for a mark that must outlive the events."""
        near = self.context(event_id, around, around).select("seq", "id", "ts", "source", F.coalesce("raw", "message").alias("text"))
        return "\n".join(f"{'>' if r['id'] == event_id else ' '} {r['seq']} {r['ts'] or '-'} {r['source']} {r['text'] or ''}" for r in near.collect())

    def report(self, rules: list[R.Rule] | None = None, known: DataFrame | None = None, marks: DataFrame | None = None, title: str = "Case report") -> str:
        """An HTML page; known: catalogue of binaries, marks: Marks.current()."""
        found = self.findings(rules, 10).orderBy(F.desc("n"), "rule") if rules else None
        ran = binaries.executed(self.events, known) if known is not None else None
        return export.report(title, analytics.counters(self.events), found, ran, analytics.facet(self.events, "src_ip", 50), marks)

    def stats(self) -> DataFrame:
        return analytics.stats(self.events)

    def dashboard(self, top: int = 10) -> dict[str, DataFrame]:
        return {"counters": analytics.counters(self.events), "tops": analytics.tops(self.events, top), "histogram": analytics.histogram(self.events)}

    def network(self, **where) -> DataFrame:
        return analytics.network(self.events, **where)

    def indicators(self, per_type: int = 400) -> DataFrame:
        curated = F.concat_ws(" ", "message", "exe", "path", "referer")
        found = ioc.extracted(self.events, F.concat_ws(" ", curated, F.col("src_ip"), F.col("raw")), curated, F.col("user_agent"), import_hash_twice=False)
        return ioc.rolled_up(found, per_type)

    def sweep(self, indicators: list[str]) -> DataFrame:
        columns = ("message", "raw", "exe", "path", "user", "src_ip", "program", "source", "host", "referer", "user_agent", "extra")
        return ioc.sweep_summary(ioc.sweep(self.events, F.concat_ws(" ", *(F.col(f"`{c}`") for c in columns)), indicators))

    def findings(self, rules: list[R.Rule], samples: int = 200) -> DataFrame:
        return R.findings(self.events, rules, samples)

    def detect(self, rules: list[R.Rule], samples: int = 200) -> R.Detection:
        """Single rules and correlations in one call, with what was applied and what was skipped and why."""
        return R.detect(self.events, rules, samples)

    def sql(self, text: str, args: dict | None = None, limit: int = 1000) -> DataFrame:
        """A read-only statement over the view events; limited unless it has a limit of its own."""
        readonly.check(self.spark, text, {"events"})
        self.events.createOrReplaceTempView("events")
        self.spark.udf.register("ip_in_cidr", ip_in_cidr)
        out = self.spark.sql(text.rstrip().rstrip(";"), args)
        readonly.check_analysed(out, {"events"})
        return out if re.search(r"\blimit\s+\d+\s*;?\s*$", text, re.I) else out.limit(limit)


__all__ = ["PARSERS", "Case", "Options", "ingest", "numbered"]

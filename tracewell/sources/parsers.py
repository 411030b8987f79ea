"""Parsers: lines (src_file, line_no, line, ...) -> event rows.

Stateless ones are projections. State over a file's lines (see ``stateful``) is taken up block by block, and what passes
from block to block is one narrow row each, so a large file is no single task.

Only \\n ends a line: patterns run with Unix line ends, so \\r, U+0085 and U+2028 are characters like others.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell.functions.columns import hex_decoded, parsed_ts, sockaddr
from tracewell.functions.tables import few, persisted
from tracewell.plans.rules import classify
from tracewell.schema import conform

# The formats' line patterns; groups in the order of the fields they hold.
SYSLOG = r"^(?:TimeStamp=)?([A-Z][a-z]{2})\s+(\d{1,2})\s+(\d{2}:\d{2}:\d{2})\s+(?:<([^>]+)>\s+)?(\S+)\s+([^\s:\[]+)(?:\[(\d+)\])?:\s?(.*)$"
SYSLOG_ISO = r"^(?:TimeStamp=)?(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:[+-]\d{2}:?\d{2}|Z)?)\s+(?:<([^>]+)>\s+)?(\S+)\s+([^\s:\[]+)(?:\[(\d+)\])?:\s?(.*)$"
ACCESS = r"""^(\S+)\s+\S+\s+(\S+)\s+\[([^\]]+)\]\s+"([^"]*)"\s+(\d{3}|-)\s+(\d+|-)(?:\s+"([^"]*)"\s+"([^"]*)")?"""
ACCESS_VIA = r"""^(\S+)\s+->\s+(\S+)\s+\S+\s+(\S+)\s+\[([^\]]+)\]\s+(?:\[(\d+)\]\s+)?"([^"]*)"\s+(\d{3}|-)\s+(\d+|-)(?:\s+"([^"]*)"\s+"([^"]*)")?"""
AUDIT = r"^type=(\S+)\s+msg=audit\((\d+)\.(\d+):(\d+)\):\s*(.*)$"
PAIR = r"""(\w+)=("[^"]*"|'[^']*'|\S+)"""
NGINX_ERROR = r"^(\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}) \[(\w+)\] (\d+)#\d+:\s*(.*)$"
APACHE_ERROR = r"^\[([A-Z][a-z]{2} [A-Z][a-z]{2} +\d+ \d{2}:\d{2}:\d{2}(?:\.\d+)? \d{4})\] \[(?:[\w-]+:)?(\w+)\] (?:\[pid (\d+)(?::tid \d+)?\] )?(?:\[client ([^\]]+)\] )?(.*)$"
APPLOG = r"^(?:TimeStamp=)?(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?)\s+(.*)$"
APPLOG_LEVEL = r"(?i)^\[?(INFO|DEBUG|WARN|WARNING|ERROR|ERR|NOTICE|CRIT|CRITICAL|TRACE|FATAL)\b\]?\s*:?\s*(.*)$"
TS_ISO = r"(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?)"
TS_SLASH = r"(\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2})"
TS_CTIME = r"(?:[A-Z][a-z]{2}\s+)?([A-Z][a-z]{2})\s+(\d{1,2})\s+(\d{2}:\d{2}:\d{2})(?:\s+([A-Z]{2,4}))?\s+(\d{4})"
TS_ANY = f"{TS_ISO}|{TS_SLASH}|{TS_CTIME}"
DMESG = r"^\[\s*(\d+\.\d+)\]\s?(.*)$"
LOG_START, LOG_END = r"(?i)^Log started:\s*(.+)$", r"(?i)^Log ended:\s*(.+)$"
DPKG = r"^(Unpacking|Setting up|Removing|Installing|Purging|Selecting|Preparing|Processing|Configuring)\b"
FONTCONFIG = r"(: caching,|: skipping,|: cleaning |: not cleaning|^fc-cache:|caching, new cache contents:)"
UDEV = r"^(UEVENT|UDEV)\s*\[\s*(\d+(?:\.\d+)?)\]\s+(\S+)\s+(.*)$"
HISTORY_MARK = r"^#\s*(\d+)\s*$"
MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
ACCEPTED = r"Accepted (\w+) for (\S+) from ([\da-fA-F:.]+) port (\d+)"
FAILED = r"Failed (\w+) for (?:invalid user )?(\S+) from ([\da-fA-F:.]+) port (\d+)"
INVALID = r"Invalid user (\S+) from ([\da-fA-F:.]+)(?: port (\d+))?"
SUDO = r"^\s*(\S+)\s*:.*?USER=(\S+)\s*;\s*COMMAND=(.*)$"
OPENED, CLOSED = r"session opened for user (\S+)", r"session closed for user (\S+)"


@dataclass(frozen=True)
class Options:
    base_year: int | None = None
    offset_minutes: int = 0
    user: str | None = None


#: Lines of a file that one block of a stateful parser has.
BLOCK_LINES = 10_000
#: Characters of a block's text in one row, what each line counts besides its own, and characters of a block's message.
BLOCK_CHARS, LINE_CHARS, MESSAGE_CHARS = 8_000_000, 64, 2000
#: A character that is no white space, as Unicode has it.
VISIBLE = r"[^\s\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_SEPARATOR = "\u0001"


def _is(pattern: str, text: str | Column = "line") -> Column:
    return (F.col(text) if isinstance(text, str) else text).rlike("(?d)" + pattern)


def _x(pattern: str, group: int, text: str | Column = "line") -> Column:
    """A group of a match, null where it is empty or missing."""
    return _known(F.regexp_extract(F.col(text) if isinstance(text, str) else text, "(?d)" + pattern, group))


def _known(v: Column) -> Column:
    return F.when(v != "", v)


def _groups(pattern: str, count: int, text: str | Column = "line") -> Column:
    """All groups of the first match as an array that counts from 1, in one pass over the text; one element without a match."""
    t = F.replace(F.col(text) if isinstance(text, str) else text, F.lit(_SEPARATOR), F.lit("\ufffd"))
    flags, rest = ("(?i)", pattern[4:]) if pattern.startswith("(?i)") else ("", pattern)
    whole = f"(?d){flags}^[\\s\\S]*?(?:{rest})[\\s\\S]*" if not rest.startswith("^") else f"(?d){flags}{rest.removesuffix('$')}[\\s\\S]*"
    return F.split(F.regexp_replace(t, whole, "".join(f"{_SEPARATOR}${i}" for i in range(1, count + 1))), _SEPARATOR, -1)


def _hit(groups: str) -> Column:
    return F.size(groups) > 1


def _at(groups: str, i: int) -> Column:
    """A group of ``_groups``, null where it is empty or missing."""
    return _known(F.get(F.col(groups), F.lit(i)))


def stateful(d: DataFrame, value: Column, changed: Callable[[Column, Column], Column]) -> DataFrame:
    """_prev: the last known value of an earlier line of the file; _count: changes(earlier value, value) up to and with the line.

    Each block of lines sorts and counts its own; first and last values and the number of changes of each block pass on.
    """
    block = ["src_file", "_blk"]
    d = d.withColumn("_blk", F.floor(F.col("line_no") / BLOCK_LINES)).withColumn("_value", value)
    w = Window.partitionBy(*block).orderBy("line_no")
    before = F.last("_value", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("_inner", before)
    step = F.when(F.col("_inner").isNotNull() & F.col("_value").isNotNull(), F.coalesce(changed(F.col("_inner"), F.col("_value")).cast("int"), F.lit(0))).otherwise(0)
    d = d.withColumn("_step", step)
    at = F.when(F.col("_value").isNotNull(), F.col("line_no"))
    blocks = d.select(*block, "line_no", "_value", "_step").groupBy(*block).agg(F.min_by("_value", at).alias("_first"), F.max_by("_value", at).alias("_last"), F.sum("_step").alias("_steps"))
    over = Window.partitionBy("src_file").orderBy("_blk")
    blocks = blocks.withColumn("_carried", F.last("_last", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)))
    blocks = blocks.withColumn("_edge", F.when(F.col("_first").isNotNull(), F.coalesce(changed(F.col("_carried"), F.col("_first")).cast("int"), F.lit(0))).otherwise(0))
    earlier = F.coalesce(F.sum(F.col("_steps") + F.col("_edge")).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("_edge")
    blocks = blocks.select(*block, "_carried", earlier.alias("_earlier"))
    own = F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("_own", own).join(blocks, block)
    return d.withColumns({"_prev": F.coalesce("_inner", "_carried"), "_count": F.col("_earlier") + F.col("_own")}).drop("_blk", "_value", "_inner", "_step", "_own", "_carried", "_earlier")


def keyed_last(d: DataFrame, keys: list[str], position: Column, order: list[str], value: str) -> DataFrame:
    """_last: the last known value of a key up to and with a row, by order; position rises with the order.

    Rows of a key are cut into blocks of BLOCK_LINES positions, each of which looks at its own rows; each block's last value
    passes on to the later blocks of its key, one row a block. So a key with all rows uses as many tasks as it has blocks.
    """
    block = [*keys, "_blk"]
    d = d.withColumn("_blk", F.floor(position / BLOCK_LINES))
    inner = F.last(value, ignorenulls=True).over(Window.partitionBy(*block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    at = F.when(F.col(value).isNotNull(), F.struct(*order))
    blocks = d.groupBy(*block).agg(F.max_by(value, at).alias("_end"))
    over = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_carried", F.last("_end", ignorenulls=True).over(over)).drop("_end")
    return d.withColumn("_inner", inner).join(blocks, block).withColumn("_last", F.coalesce("_inner", "_carried")).drop("_blk", "_inner", "_carried")


def _dash(v: Column) -> Column:
    return F.when(v != "-", v)


def _month(name: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS) for x in (m, i + 1)]), name)


def _made(year: Column, month: Column, day: Column, time: Column) -> Column:
    text = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
    return F.when(month.isNotNull() & year.isNotNull(), F.concat(text, F.lit("T"), time).try_cast("timestamp_ntz"))


def _less(ts: Column, minutes: int) -> Column:
    return ts - F.make_dt_interval(mins=F.lit(minutes)) if minutes else ts


def scanned_ts(line: Column, offset_minutes: int = 0) -> Column:
    """A time anywhere in the line: ISO, then slashes, then ctime, whose UTC or GMT is not shifted."""
    iso = F.regexp_extract(line, TS_ISO, 1)
    slash = F.replace(F.regexp_extract(line, TS_SLASH, 1), F.lit("/"), F.lit("-")).try_cast("timestamp_ntz")
    part = [F.regexp_extract(line, TS_CTIME, i) for i in range(6)]
    ctime = _made(F.when(part[5] != "", part[5]), _month(F.when(part[1] != "", part[1])), part[2], part[3])
    return F.coalesce(parsed_ts(F.when(iso != "", iso), offset_minutes), _less(slash, offset_minutes), F.when(part[4].isin("UTC", "GMT"), ctime).otherwise(_less(ctime, offset_minutes)))


# Words of priorities and of levels, by the severity they stand for.
PRIORITIES = {"error": "emerg alert crit err error", "warn": "warning warn", "info": "notice info", "debug": "debug"}
LEVELS = {"error": "fatal critical crit error err", "warn": "warning warn", "info": "notice info", "debug": "debug trace"}


def _severity(word: Column, words: dict[str, str] = LEVELS) -> Column:
    w, out = F.lower(word), F.lit(None).cast("string")
    for severity, names in words.items():
        out = F.when(w.isin(names.split()), severity).otherwise(out)
    return out


def _json(pairs: dict[str, Column]) -> Column:
    """JSON text of what is not null; null if nothing is."""
    s = F.to_json(F.struct(*[v.alias(k) for k, v in pairs.items()]))
    return F.when(s != "{}", s)


def _lines(lines: DataFrame) -> DataFrame:
    return lines.where(_is(VISIBLE))


def syslog(lines: DataFrame, o: Options, source: str = "syslog") -> DataFrame:
    d = _lines(lines).withColumn("_a", _groups(SYSLOG, 8))
    d = d.withColumns({"_m": _month(_at("_a", 1)), "_b": F.when(~_hit("_a"), _groups(SYSLOG_ISO, 6))})
    # the year goes up where the month falls by more than one; other lines do not count
    d = stateful(d, F.col("_m"), lambda before, month: month < before - 1)
    base = F.lit(o.base_year) if o.base_year else F.col("file_year")
    a, b = F.col("_m").isNotNull(), F.coalesce(_hit("_b"), F.lit(False))

    def pick(i: int, j: int) -> Column:
        return F.when(a, _at("_a", i)).when(b, _at("_b", j))

    odd = F.when(~_hit("_a"), scanned_ts(F.col("line"), o.offset_minutes))  # a line with an unknown month has no time
    ts = F.when(a, _less(_made(base + F.col("_count"), F.col("_m"), _at("_a", 2), _at("_a", 3)), o.offset_minutes)).when(b, parsed_ts(_at("_b", 1))).otherwise(odd)
    d = d.withColumns(
        {
            "ts": ts,
            "source": F.lit(source),
            "host": pick(5, 3),
            "program": pick(6, 4),
            "pid": pick(7, 5).try_cast("int"),
            "severity": _severity(F.substring_index(pick(4, 2), ".", -1), PRIORITIES),
            "message": F.when(a | b, F.coalesce(pick(8, 6), F.lit(""))).otherwise(F.col("line")),
            "raw": F.col("line"),
        }
    )
    return _auth(d) if source == "auth" else d


#: Events of authentication: name, severity, pattern, and which groups hold user, address and port (0: none).
_AUTH = (
    ("ssh_accepted", "accept", ACCEPTED, 4, (2, 3, 4)),
    ("ssh_failed", "fail", FAILED, 4, (2, 3, 4)),
    ("ssh_invalid_user", "fail", INVALID, 3, (1, 2, 3)),
    ("sudo", "info", SUDO, 3, (1, 0, 0)),
    ("session_opened", "info", OPENED, 1, (1, 0, 0)),
    ("session_closed", "info", CLOSED, 1, (1, 0, 0)),
)


def _auth(d: DataFrame) -> DataFrame:
    m = F.col("message")
    kind = F.lit(None).cast("int")
    for i, (name, _, pattern, _, _) in reversed(list(enumerate(_AUTH))):
        fits = _is(pattern, m)
        kind = F.when(fits & (F.col("program") == "sudo") if name == "sudo" else fits, i).otherwise(kind)
    d = d.withColumn("_kind", kind)
    found = F.lit(None).cast("array<string>")
    for i, (_, _, pattern, count, _) in enumerate(_AUTH):
        found = F.when(F.col("_kind") == i, _groups(pattern, count, m)).otherwise(found)
    d = d.withColumn("_g", found)

    def of(values: list) -> Column:
        return F.get(F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values]), F.col("_kind"))

    def group(k: int) -> Column:
        return _known(F.get(F.col("_g"), of([x[4][k] if x[4][k] else 99 for x in _AUTH])))

    return d.withColumns({"event": of([x[0] for x in _AUTH]), "severity": F.coalesce(of([x[1] for x in _AUTH]), F.col("severity")), "user": group(0), "src_ip": group(1), "src_port": group(2).try_cast("int")})


def access(lines: DataFrame, o: Options) -> DataFrame:
    d = _lines(lines).withColumn("_v", F.when(F.col("line").contains("->"), _groups(ACCESS_VIA, 10)))
    d = d.withColumn("_via", F.coalesce(_hit("_v"), F.lit(False)))
    d = d.withColumn("_a", F.when(~F.col("_via"), _groups(ACCESS, 8)))
    via, known = F.col("_via"), F.col("_via") | _hit("_a")

    def pick(i: int, j: int) -> Column:
        """Group i of the plain form, j of the other; 0: it has none."""
        return F.when(via, _at("_v", j) if j else F.lit(None)).otherwise(_at("_a", i) if i else F.lit(None))

    # dd/Mon/yyyy:hh:mm:ss zone
    d = d.withColumn("_t", pick(3, 4)).withColumn("_z", F.trim(F.substring("_t", 21, 40)))
    iso = F.concat(F.substring("_t", 8, 4), F.lit("-"), F.lpad(_month(F.substring("_t", 4, 3)).cast("string"), 2, "0"), F.lit("-"), F.substring("_t", 1, 2), F.lit("T"), F.substring("_t", 13, 8))
    shaped = (F.substring("_t", 3, 1) == "/") & (F.substring("_t", 7, 1) == "/") & (F.substring("_t", 12, 1) == ":")
    zone = F.substring("_z", 2, 4).try_cast("int")
    minutes = F.when(F.substring("_z", 1, 1).isin("+", "-") & (F.length("_z") >= 5) & zone.isNotNull(), F.when(F.col("_z").startswith("-"), -1).otherwise(1) * (F.floor(zone / 100) * 60 + zone % 100)).otherwise(0).cast("int")
    ts = F.when(known, F.when(shaped, iso.try_cast("timestamp_ntz")) - F.make_dt_interval(mins=minutes)).otherwise(scanned_ts(F.col("line")))
    request, status = pick(4, 6), _dash(pick(5, 7)).try_cast("int")
    d = d.withColumn("_r", F.split(F.trim(request), r"\s+"))
    return d.withColumns(
        {
            "ts": ts,
            "source": F.lit("access"),
            "program": F.when(known, "http"),
            "event": F.when(known, "http_request"),
            "src_ip": _dash(pick(1, 1)),
            "user": _dash(pick(2, 3)),
            "pid": pick(0, 5).try_cast("int"),
            "method": F.when(F.size("_r") >= 2, F.get("_r", F.lit(0))),
            "path": F.when(F.size("_r") >= 2, F.get("_r", F.lit(1))).otherwise(_known(F.get("_r", F.lit(0)))),
            "status": status,
            "bytes": _dash(pick(6, 8)).try_cast("long"),
            "referer": pick(7, 9),
            "user_agent": pick(8, 10),
            "severity": F.when(status >= 500, "error").when(status >= 400, "warn").when(known, "info"),
            "message": F.when(known, F.coalesce(request, F.lit(""))).otherwise(F.col("line")),
            "extra": F.when(via, _json({"dst": _at("_v", 2)})),
            "raw": F.col("line"),
        }
    )


def weberror(lines: DataFrame, o: Options) -> DataFrame:
    d = _lines(lines)
    n, a, line = _is(NGINX_ERROR), _is(APACHE_ERROR), F.col("line")
    message = F.when(n, _x(NGINX_ERROR, 4)).when(a, _x(APACHE_ERROR, 5)).otherwise(line)
    client = F.when(n, _x(r"client:\s*([\da-fA-F:.]+)", 1)).when(a, F.regexp_replace(_x(APACHE_ERROR, 4), r":\d+$", ""))
    request = r'request:\s*"(\S+) (\S+)[^"]*"'
    return d.withColumns(
        {
            "ts": scanned_ts(F.when(n, _x(NGINX_ERROR, 1)).when(a, F.regexp_replace(_x(APACHE_ERROR, 1), r"\.\d+ ", " ")), o.offset_minutes),
            "source": F.lit("weberror"),
            "program": F.when(n, "nginx").when(a, "apache"),
            "event": F.lit("web_error"),
            "severity": F.when(n, _x(NGINX_ERROR, 2)).when(a, _x(APACHE_ERROR, 2)),
            "pid": F.when(n, _x(NGINX_ERROR, 3)).when(a, _x(APACHE_ERROR, 3)).try_cast("int"),
            "src_ip": client,
            "method": F.when(n, _x(request, 1)),
            "path": F.when(n, _x(request, 2)),
            "message": message,
            "raw": line,
        }
    )


def bash_history(lines: DataFrame, o: Options) -> DataFrame:
    d = lines.where("line <> ''")
    d = stateful(d, F.col("line"), lambda before, line: F.lit(False))
    d = d.withColumn("ts", F.timestamp_seconds(_x(HISTORY_MARK, 1, "_prev").try_cast("long")).cast("timestamp_ntz")).where(~_is(HISTORY_MARK))
    return d.withColumns({"source": F.lit("bash_history"), "program": F.lit("bash"), "event": F.lit("command"), "user": F.lit(o.user).cast("string"), "message": F.col("line"), "raw": F.col("line")})


def applog(lines: DataFrame, o: Options) -> DataFrame:
    known, rest = _is(APPLOG), _x(APPLOG, 2)
    level = _x(APPLOG_LEVEL, 1, F.coalesce(rest, F.lit("")))
    return _lines(lines).withColumns(
        {
            "ts": F.when(known, parsed_ts(_x(APPLOG, 1), o.offset_minutes)).otherwise(scanned_ts(F.col("line"), o.offset_minutes)),
            "source": F.lit("applog"),
            "severity": _severity(level),
            "message": F.coalesce(F.when(level.isNotNull(), _x(APPLOG_LEVEL, 2, rest)), rest, F.when(known, F.lit("")).otherwise(F.col("line"))),
            "raw": F.col("line"),
        }
    )


def _unquoted(v: Column) -> Column:
    first = F.substring(v, 1, 1)
    return F.when(first.isin('"', "'") & (F.substring(v, -1, 1) == first) & (F.length(v) >= 2), F.substring(v, 2, F.length(v) - 2)).otherwise(v)


def pairs(text: Column) -> Column:
    """key=value pairs in order, unquoted: array of (k, v)."""
    keys, values = (F.regexp_extract_all(text, F.lit(PAIR), F.lit(i)) for i in (1, 2))
    return F.transform(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda p: F.struct(p["k"].alias("k"), _unquoted(p["v"]).alias("v")))


def _indexed(d: DataFrame) -> DataFrame:
    """_k and _v: keys and values of the pairs _p, the last first, so the first place of a key holds its last value."""
    return d.withColumns({"_k": F.reverse(F.col("_p.k")), "_v": F.reverse(F.col("_p.v"))})


def _last(key: str) -> Column:
    """Value of the last pair with a key; null if there is none."""
    return F.get(F.col("_v"), (F.array_position(F.col("_k"), key) - 1).cast("int"))


def _distinct(p: Column) -> Column:
    """Of pairs with equal keys the last, as map keys must be distinct."""
    n = F.size(p)
    return F.filter(p, lambda x, i: F.array_position(F.col("_k"), x["k"]) == n - i)


# Keys that fill a column, and keys that hold the time.
LOGFMT_KEYS = {
    "user": "user usr username acct account",
    "src_ip": "src_ip srcip ip addr client clientip remote remote_addr",
    "host": "host hostname",
    "pid": "pid",
    "src_port": "port sport src_port",
    "status": "status code status_code statuscode",
    "method": "method verb",
    "path": "path url uri request",
    "exe": "exe cmd command executable",
    "program": "program proc process service prog app",
    "severity": "severity level lvl sev",
    "bytes": "bytes size length bytes_sent",
    "referer": "referer referrer",
    "user_agent": "user_agent ua useragent",
    "message": "msg message",
}
LOGFMT_TIMES = "ts time timestamp date @timestamp datetime eventtime".split()
CSV_TIMES = "ts time timestamp datetime date @timestamp eventtime _time time_generated timegenerated".split()
HEADER = r"(?U)^[A-Za-z_][\w .\-/@]{0,48}$"
_INTEGER = {"src_port": "int", "pid": "int", "status": "int", "bytes": "long"}


def _columns(d: DataFrame, entries: Column) -> DataFrame:
    """_e: entries (k, v) with c, the column that a key fills, null if the value cannot; _c and _w: all c and v."""
    names = F.create_map(*[F.lit(x) for c, keys in LOGFMT_KEYS.items() for k in keys.split() for x in (k, c)])

    def entry(x: Column) -> Column:
        c = F.try_element_at(names, F.lower(x["k"]))
        fits = F.when(c.isin(*_INTEGER), x["v"].try_cast("long").isNotNull()).otherwise(x["v"] != "")
        return F.struct(x["k"].alias("k"), x["v"].alias("v"), F.when(fits, c).alias("c"), c.isNotNull().alias("known"))

    return d.withColumn("_e", F.transform(entries, entry)).withColumns({"_c": F.col("_e.c"), "_w": F.col("_e.v")})


def _filled() -> dict[str, Column]:
    """Of several keys of a column the first in the line fills it."""
    out = {}
    for column in LOGFMT_KEYS:
        v = F.get(F.col("_w"), (F.array_position(F.col("_c"), column) - 1).cast("int"))
        out[column] = v.try_cast(_INTEGER[column]) if column in _INTEGER else v
    out["severity"] = F.coalesce(_severity(out["severity"]), out["severity"])
    return out


def _rest(times: list[str], last_only: bool = False) -> Column:
    """JSON of the entries that fill no column; an empty value of a column's key fills none and is not kept."""
    n = F.size("_e")
    left = F.filter("_e", lambda x, i: ~x["k"].isin(*times) & ((F.array_position(F.col("_c"), x["c"]) != i + 1) | (x["c"].isNull() & ~(x["known"] & (x["v"] == "")))))
    if last_only:  # of equal names the last
        keys = F.transform(left, lambda x: x["k"])
        left = F.filter(left, lambda x, i: ~F.array_contains(F.slice(keys, i + 2, n), x["k"]))
    return F.when(F.size(left) > 0, F.to_json(F.map_from_entries(F.transform(left, lambda x: F.struct(x["k"], x["v"])))))


def _time_of(v: Column, o: Options) -> Column:
    return F.coalesce(parsed_ts(v), scanned_ts(v, o.offset_minutes))


def logfmt(lines: DataFrame, o: Options) -> DataFrame:
    """key=value lines: of equal keys the last value counts, at the place of the first; keys of columns in any case."""
    d = _indexed(_lines(lines).withColumn("_p", pairs(F.col("line"))))
    once = F.filter("_p", lambda x, i: F.array_position(F.col("_p.k"), x["k"]) == i + 1)
    d = _columns(d, F.transform(once, lambda x: F.struct(x["k"].alias("k"), F.get(F.col("_v"), (F.array_position(F.col("_k"), x["k"]) - 1).cast("int")).alias("v"))))
    stamp = F.coalesce(*[_last(k) for k in LOGFMT_TIMES if k.isalpha()])
    d = d.withColumns(_filled()).withColumns({"ts": F.coalesce(_time_of(stamp, o), scanned_ts(F.col("line"), o.offset_minutes)), "extra": _rest(LOGFMT_TIMES)})
    return d.withColumns({"source": F.lit("logfmt"), "message": F.coalesce("message", "line"), "raw": F.col("line")})


def cells(line: str) -> Column:
    """The cells of a CSV line, unquoted and trimmed."""
    found = F.regexp_extract_all(line, F.lit(r"""(?:^|,)("(?:[^"]|"")*"|[^,]*)"""), F.lit(1))
    return F.transform(found, lambda c: F.trim(F.replace(_unquoted(F.trim(c)), F.lit('""'), F.lit('"'))))


def is_header(found: str) -> Column:
    """Whether all of at least two cells look like names."""
    return (F.size(found) >= 2) & F.forall(found, lambda c: c.rlike(HEADER))


def csv(lines: DataFrame, o: Options) -> DataFrame:
    """The first non-blank line is the header if all its cells look like names; else columns are col1, col2, ...

    The first time column that can be read gives the time; time columns stay in extra, too. Cells beyond the header are
    named by their place.
    """
    # one row for each file; sent to all tasks, as a join by file would put all lines of a file into one
    heads = _lines(lines).groupBy("src_file").agg(F.min_by("line", "line_no").alias("_head"), F.min("line_no").alias("_at"))
    heads = heads.withColumn("_first", cells("_head")).withColumn("_named", is_header("_first"))
    heads = few(persisted(heads.select("src_file", "_at", "_named", F.when(F.col("_named"), F.col("_first")).alias("_names")), "heads"))
    d = _lines(lines).join(heads, "src_file").where(~(F.col("_named") & (F.col("line_no") == F.col("_at"))))
    named = F.transform(cells("line"), lambda v, i: F.struct(F.coalesce(F.get(F.col("_names"), i), F.concat(F.lit("col"), (i + 1).cast("string"))).alias("k"), v.alias("v")))
    d = _columns(d, F.filter(named, lambda x: x["v"] != ""))
    d = d.withColumn("_times", F.transform(F.filter("_e", lambda x: F.lower(x["k"]).isin(*CSV_TIMES)), lambda x: x["v"]))
    later = F.transform(F.slice("_times", 2, F.greatest(F.size("_times") - 1, F.lit(0))), lambda v: _time_of(v, o))
    stamp = F.coalesce(_time_of(F.get("_times", F.lit(0)), o), F.get(F.filter(later, lambda x: x.isNotNull()), F.lit(0)))
    d = d.withColumns(_filled()).withColumns({"ts": F.coalesce(stamp, scanned_ts(F.col("line"), o.offset_minutes)), "extra": _rest([], True)})
    return d.withColumns({"source": F.lit("csv"), "event": F.lit("csv"), "message": F.coalesce("message", "line"), "raw": F.col("line")})


def dmesg(lines: DataFrame, o: Options) -> DataFrame:
    return _lines(lines).withColumns({"source": F.lit("dmesg"), "program": F.lit("kernel"), "event": F.lit("kernel"), "message": F.coalesce(_x(DMESG, 2), F.col("line")), "extra": _json({"ktime": _x(DMESG, 1).try_cast("double")}), "raw": F.col("line")})


def fontconfig(lines: DataFrame, o: Options) -> DataFrame:
    head = F.substring_index("line", ":", 1)
    return _lines(lines).withColumns({"source": F.lit("fontconfig"), "event": F.lit("fontconfig"), "path": F.when(head.contains("/") & F.col("line").contains(":"), F.trim(head)), "message": F.col("line"), "raw": F.col("line")})


def raw(lines: DataFrame, o: Options) -> DataFrame:
    return _lines(lines).withColumns({"ts": scanned_ts(F.col("line"), o.offset_minutes), "source": F.lit("raw"), "event": F.lit("raw"), "message": F.col("line"), "raw": F.col("line")})


def running(d: DataFrame, keys: list[str], amounts: dict[str, Column]) -> DataFrame:
    """For each name, the sum of an amount over the earlier lines of a key; each block of lines adds up its own, and one row a block passes on."""
    block = [*keys, "_blk"]
    d = d.withColumns({"_blk": F.floor(F.col("line_no") / BLOCK_LINES), **{f"{n}_one": v for n, v in amounts.items()}})
    before = Window.partitionBy(*block).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    sums = d.groupBy(*block).agg(*[F.sum(f"{n}_one").alias(f"{n}_sum") for n in amounts])
    sums = sums.select(*block, *[F.coalesce(F.sum(f"{n}_sum").over(over), F.lit(0)).alias(f"{n}_carried") for n in amounts])
    d = d.withColumns({f"{n}_own": F.coalesce(F.sum(f"{n}_one").over(before), F.lit(0)) for n in amounts}).join(sums, block)
    d = d.withColumns({n: F.col(f"{n}_own") + F.col(f"{n}_carried") for n in amounts})
    return d.drop("_blk", *[f"{n}{x}" for n in amounts for x in ("_one", "_own", "_carried")])


def _blocks(lines: DataFrame, starts: Column, ends: Column, amounts: dict[str, Column]) -> DataFrame:
    """_in, _start: whether a line is in a block, and the line its block starts at (outside: its own); _part: which part of the block; amounts as for running.

    A block ends with its end line, the next start or the file. Parts hold BLOCK_CHARS, so no task gathers a whole block
    that never ends.
    """
    mark = F.when(starts, F.struct(F.lit(True).alias("open"), "line_no")).when(ends, F.struct(F.lit(False).alias("open"), "line_no"))
    d = stateful(lines.withColumn("_starts", starts), mark, lambda before, own: F.lit(False))
    d = d.withColumn("_in", F.col("_starts") | F.coalesce(F.col("_prev.open"), F.lit(False)))
    d = d.withColumn("_start", F.when(F.col("_in") & ~F.col("_starts"), F.col("_prev.line_no")).otherwise(F.col("line_no"))).drop("_prev", "_count")
    d = running(d, ["src_file", "_start"], {"_chars": F.length("line").cast("long") + LINE_CHARS, **amounts})
    return d.withColumn("_part", F.floor(F.col("_chars") / BLOCK_CHARS))


def _parts(d: DataFrame) -> DataFrame:
    """A row for each part of a block: its first line's number and its raw text."""
    g = d.groupBy("src_file", "_start", "_part").agg(F.min("line_no").alias("line_no"), F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("_l"))
    return g.withColumn("raw", F.array_join(F.transform("_l", lambda x: x["line"]), "\n")).drop("_l")


def _trimmed(v: Column) -> Column:
    return F.regexp_extract(v, f"(?s)({VISIBLE}(?:.*{VISIBLE})?)", 1)


def apt(lines: DataFrame, o: Options) -> DataFrame:
    """An event for each block of a package log and for each line outside.

    The message are the block's verb lines, 2000 characters at most, or its first line after the start. Only verbs that
    reach into the message are gathered; the rest is counted. A block whose text is longer than BLOCK_CHARS goes on in
    further events with the same time and message, whose raw text are the next lines and whose extra tells the part.
    """
    text = _trimmed(F.col("line"))
    verb = F.col("line").rlike(DPKG)
    d = _blocks(_lines(lines), text.rlike(LOG_START), text.rlike(LOG_END), {"_verbs": F.when(verb, F.length("line").cast("long") + 2).otherwise(0)})
    body = F.when(~F.col("_starts"), F.col("line"))
    ended = F.when(text.rlike(LOG_END), F.regexp_replace(_trimmed(F.regexp_extract(text, LOG_END, 1)), r"\s+", " "))
    shown = F.when(verb & (F.col("_verbs") < MESSAGE_CHARS), F.struct("line_no", F.substring("line", 1, MESSAGE_CHARS).alias("line")))
    folds = d.groupBy("src_file", "_start").agg(
        F.max("_in").alias("_in"),
        F.min_by("line", "line_no").alias("_head"),
        F.min_by(body, F.when(body.isNotNull(), F.col("line_no"))).alias("_body"),
        F.max(ended).alias("_ended"),
        F.count_if(verb).alias("_actions"),
        F.array_sort(F.collect_list(shown)).alias("_shown"),
    )
    g = _parts(d).join(folds, ["src_file", "_start"])
    verbs = F.array_join(F.transform("_shown", lambda x: x["line"]), "; ")
    started = F.regexp_replace(_trimmed(F.regexp_extract(_trimmed(F.col("_head")), LOG_START, 1)), r"\s+", " ")
    first = F.col("_part") == 0
    extra = _json({"log_ended": F.when(first, F.col("_ended")), "actions": F.when(first & F.col("_in") & (F.col("_actions") > 0), F.col("_actions")), "part": F.when(~first, F.col("_part"))})
    message = F.when(F.col("_in"), F.substring(F.when(F.col("_actions") > 0, verbs).otherwise(F.coalesce("_body", "_head")), 1, MESSAGE_CHARS)).otherwise(F.col("_head"))
    return g.withColumns({"ts": F.when(F.col("_in"), F.coalesce(parsed_ts(started), scanned_ts(started, o.offset_minutes))), "source": F.lit("apt"), "program": F.lit("dpkg"), "event": F.lit("dpkg"), "message": message, "extra": extra})


def udev(lines: DataFrame, o: Options) -> DataFrame:
    """An event for each block of a device monitor, with its KEY=value lines, the last of equal keys, and for each line outside.

    A block whose text is longer than BLOCK_CHARS goes on in further events with the same time, message and path, whose
    raw text and keys are those of the next lines.
    """
    d = _blocks(lines, _trimmed(F.col("line")).rlike(UDEV), ~_is(VISIBLE), {}).where(_is(VISIBLE))
    d = persisted(d, "blocks")  # parts, keys, paths and folds read it, and would find the blocks anew
    pair = d.where(F.col("_in") & ~F.col("_starts") & F.col("line").contains("="))
    at = F.instr("line", "=")
    pair = pair.select("src_file", "_start", "_part", "line_no", _trimmed(F.substring(F.col("line"), F.lit(1), at - 1)).alias("k"), _trimmed(F.substring(F.col("line"), at + 1, F.length("line"))).alias("v"))
    block = ["src_file", "_start"]
    last = pair.groupBy(*block, "_part", "k").agg(F.max_by("v", "line_no").alias("v"), F.min("line_no").alias("n"))
    keys = last.groupBy(*block, "_part").agg(F.array_sort(F.collect_list(F.struct("n", "k", "v"))).alias("_p"))
    paths = pair.where("k = 'DEVPATH'").groupBy(*block).agg(F.max_by("v", "line_no").alias("_path"))
    # one row for each block
    folds = d.groupBy(*block).agg(F.max("_in").alias("_in"), F.min_by("line", "line_no").alias("_head")).join(paths, block, "left")
    g = _parts(d).join(folds, block).join(keys, [*block, "_part"], "left")
    h = _trimmed(F.col("_head"))
    kind, seconds, action, device = (F.regexp_extract(h, UDEV, i) for i in range(1, 5))
    entries = F.map_from_entries(F.transform("_p", lambda x: F.struct(x["k"], x["v"])))
    return g.withColumns(
        {
            "ts": F.when(F.col("_in"), F.timestamp_micros((seconds.try_cast("double") * 1000000).cast("long")).cast("timestamp_ntz")),
            "source": F.lit("udev"),
            "program": F.lit("udev"),
            "event": F.when(F.col("_in"), F.lower(kind)).otherwise("udev"),
            "path": _known(F.col("_path")),
            "message": F.when(F.col("_in"), F.concat_ws(" ", kind, action, device)).otherwise(F.col("_head")),
            "extra": F.when(F.col("_p").isNotNull(), F.to_json(entries)),
        }
    )


def auditd(lines: DataFrame, o: Options, decode_quoted: bool = True) -> DataFrame:
    """One event for each record; records of one serial that follow each other share what the others know.

    Values are unquoted before hex is decoded, so a quoted argument that looks like hex is decoded as well, unless
    decode_quoted is off.
    """
    # rows stay narrow while they are dealt out: a body is the end of its line, and pairs are read again at the end
    d = _lines(lines).withColumn("_g", _groups(AUDIT, 5))
    d = d.withColumns({"_t": F.lower(_at("_g", 1)), "_epoch": _at("_g", 2), "_serial": _at("_g", 4), "_from": F.length("line") - F.length(F.coalesce(_at("_g", 5), F.lit("")))}).drop("_g")
    narrow = d.columns

    def paired(d: DataFrame) -> DataFrame:
        """_k and _v: keys and values, the last first, so the first place of a key holds its last value."""
        body, inner = F.col("_body"), F.col("_inner")
        d = d.withColumn("_body", F.replace(F.substring(F.col("line"), F.col("_from") + 1, F.length("line")), F.lit(_SEPARATOR), F.lit("\ufffd")))
        d = d.withColumn("_inner", F.when(body.contains("msg='"), F.regexp_extract(body, r"msg='([^']*=[^']*)'", 1)).otherwise(""))
        d = d.withColumn("_outer", F.when(inner != "", F.regexp_replace(body, r"msg='[^']*'", "")).otherwise(body))

        def found(group: int) -> Column:
            own, outer = (F.regexp_extract_all(x, F.lit(PAIR), F.lit(group)) for x in ("_inner", "_outer"))
            return F.reverse(F.when(inner == "", outer).otherwise(F.concat(own, outer)))

        return d.withColumns({"_k": found(1), "_v": F.transform(found(2), _unquoted)}).drop("_inner", "_outer")

    def decoded(v: Column, key: str) -> Column:
        if decode_quoted:
            return hex_decoded(v)
        return F.when(F.col("_body").contains(F.concat(F.lit(key + '="'), v, F.lit('"'))), v).otherwise(hex_decoded(v))

    def get(k: str) -> Column:
        return _last(k)

    is_exec = F.col("_t") == "execve"

    def of(kind: str, value: Column) -> Column:
        return F.when(F.col("_t") == kind, value)

    def read(key: str) -> Column:
        """A value as text, and whether that took decoding."""
        v = F.col("_" + key)
        text = decoded(v, key)
        return F.when(v.isNotNull(), F.struct(text.alias("text"), (text != v).alias("coded")))

    # a block of lines finds its groups and what they know; those at its edges may go on in its neighbours
    block = ["src_file", "_blk"]
    at = Window.partitionBy(*block).orderBy("line_no")
    serial = F.coalesce("_serial", F.lit(""))  # a serial is never empty
    d = d.withColumn("_blk", F.floor(F.col("line_no") / BLOCK_LINES)).withColumns({"_before": F.lag(serial).over(at), "_after": F.lead(serial).over(at)})
    step = F.coalesce((F.col("_before") != serial).cast("int"), F.lit(0))
    own = F.sum(step).over(at.rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumns({"_own": own, "_head": F.col("_before").isNull(), "_tail": F.col("_after").isNull()}).drop("_before", "_after")
    placed = [*narrow, "_blk", "_own", "_head", "_tail"]
    d = paired(d).select(*placed, "_body", get("pid").try_cast("int").alias("pid"), get("exe").alias("_exe"), of("syscall", get("ppid")).alias("_gppid"), of("cwd", get("cwd")).alias("_cwd"), of("proctitle", get("proctitle")).alias("_proctitle"), get("saddr").alias("_saddr"))
    ip, port = sockaddr(F.col("_saddr"))
    d = d.select(*placed, "pid", "_exe", of("syscall", F.col("_exe")).alias("_gexe"), "_gppid", read("cwd").alias("_gcwd"), read("proctitle").alias("_gtitle"), ip.alias("_gip"), port.alias("_gport"))
    facts = [c for c in d.columns if c.startswith("_g")]

    def known(*keys: str) -> dict[str, Column]:
        group = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return {k: (F.last if k in ("_gip", "_gport") else F.first)(k, ignorenulls=True).over(group) for k in facts}

    d = persisted(d.withColumns(known(*block, "_own")), "audit")
    # the first and the last line of each block: their groups are numbered through the file and share what they know
    edges = d.where("_head or _tail").select(*block, "line_no", "_own", "_head", serial.alias("_s"), *facts)
    through = Window.partitionBy("src_file").orderBy("line_no")
    step = F.when(F.col("_head"), F.coalesce((F.lag("_s").over(through) != F.col("_s")).cast("int"), F.lit(0))).otherwise(F.col("_own"))
    edges = edges.withColumn("_step", step).withColumn("_island", F.sum("_step").over(through.rowsBetween(Window.unboundedPreceding, 0)))
    edges = edges.withColumns(known("src_file", "_island"))
    first, last = ((f"_{name}", by(F.struct(*facts), "line_no")) for name, by in (("first", F.min_by), ("last", F.max_by)))
    blocks = edges.groupBy(*block).agg(F.min("_island").alias("_earlier"), F.max("_own").alias("_steps"), *(v.alias(k) for k, v in (first, last)))
    shared = {k: F.when(F.col("_own") == 0, F.col(f"_first.{k}")).when(F.col("_own") == F.col("_steps"), F.col(f"_last.{k}")).otherwise(F.col(k)) for k in facts}
    d = d.join(few(persisted(blocks, "blocks")), block).withColumns({"_island": F.col("_earlier") + F.col("_own"), **shared}).drop("_blk", "_own", "_head", "_tail", "_earlier", "_steps", "_first", "_last")
    # parent: the exe last seen for the process whose id is this one's ppid, up to and with this group
    seen = d.where(F.col("pid").isNotNull() & F.col("_exe").isNotNull())
    keyed = seen.select("src_file", F.col("pid").cast("string").alias("_of"), "_island", F.lit(0).alias("_kind"), "line_no", F.col("_exe").alias("_def"))
    asks = F.coalesce(is_exec & F.col("_gppid").isNotNull(), F.lit(False))
    probes = d.where(asks).select("src_file", F.col("_gppid").alias("_of"), "_island", F.lit(1).alias("_kind"), "line_no", F.lit(None).cast("string").alias("_def"))
    known_last = keyed_last(keyed.unionByName(probes), ["src_file", "_of"], F.col("_island"), ["_island", "_kind", "line_no"], "_def")
    parents = known_last.where("_kind = 1").select("src_file", "line_no", F.col("_last").alias("_parent"))
    # lines that ask for no parent are not dealt out again
    d = d.where(asks).join(parents, ["src_file", "line_no"], "left").unionByName(d.where(~asks).withColumn("_parent", F.lit(None).cast("string")))
    d = paired(d)
    d = d.withColumn("_count", F.when(is_exec, get("argc").try_cast("int")))

    def place(i: Column) -> Column:
        return F.get(F.col("_v"), (F.array_position(F.col("_k"), F.concat(F.lit("a"), i.cast("string"))) - 1).cast("int"))

    def argument(v: Column, i: Column) -> Column:
        if decode_quoted:
            return hex_decoded(v)
        return F.when(F.col("_body").contains(F.concat(F.lit("a"), i.cast("string"), F.lit('="'), v, F.lit('"'))), v).otherwise(hex_decoded(v))

    places = F.when(F.col("_count") > 0, F.sequence(F.lit(0), F.col("_count") - 1)).otherwise(F.array().cast("array<int>"))
    d = d.withColumn("_given", F.transform(places, place)).withColumn("_read", F.transform("_given", argument))
    d = d.withColumns(
        {
            "ts": F.timestamp_seconds(F.col("_epoch").try_cast("long")).cast("timestamp_ntz"),
            "event": F.col("_t"),
            "user": F.coalesce(get("acct"), get("auid"), get("uid")),
            "src_ip": F.when(get("addr") != "?", get("addr")),
            "_ok": F.coalesce(get("success"), get("res")),
            "_args": F.array_join("_read", " "),
            "_coded": F.col("_read") != F.col("_given"),
        }
    )
    shared = F.col("_t").isin("syscall", "sockaddr")
    more = {
        "serial": F.col("_serial"),
        "ppid": F.when(is_exec, F.col("_gppid")),
        "cwd": F.when(is_exec, F.col("_gcwd.text")),
        "proctitle": F.when(is_exec, F.col("_gtitle.text")),
        "parent_exe": F.col("_parent"),
        "dst_ip": F.when(shared, F.col("_gip")),
        "dst_port": F.when(shared, F.col("_gport")),
        "_dec": _known(F.concat_ws(",", F.when(is_exec & F.col("_coded"), "cmd"), F.when(is_exec & F.col("_gcwd.coded"), "cwd"), F.when(shared & F.col("_gip").isNotNull(), "dst_ip,dst_port"), F.when(is_exec & F.col("_gtitle.coded"), "proctitle"))),
    }
    # each array is made once for a line, not once for each of its pairs
    d = d.withColumn("_more", F.array(*more.values())).withColumn("_names", F.array_compact(F.array(*[F.when(F.get("_more", F.lit(i)).isNotNull(), k) for i, k in enumerate(more)])))
    d = d.withColumns({"_own": F.reverse(F.array_except("_k", "_names")), "_more": F.array_compact("_more")})  # of equal keys the last
    values = F.transform("_own", lambda k: F.get(F.col("_v"), (F.array_position(F.col("_k"), k) - 1).cast("int")))
    values = F.when(F.size("_own") == F.size("_k"), F.reverse("_v")).otherwise(values)  # mostly no key is left out
    d = d.withColumns({"_names": F.concat("_own", "_names"), "_more": F.concat(values, F.col("_more"))})
    other = F.coalesce(get("comm"), get("op"), F.substring("_body", 1, 500))
    return d.withColumns(
        {
            "source": F.lit("auditd"),
            "program": F.lit("auditd"),
            "exe": F.when(is_exec, F.coalesce("_exe", "_gexe")).otherwise(F.col("_exe")),
            "severity": F.when(F.col("_ok").isin("no", "failed"), "fail").when(F.col("_ok").isin("yes", "success"), "info"),
            "message": F.when(F.col("_t").isNull(), F.col("line")).when(is_exec & (F.col("_args") != ""), F.col("_args")).otherwise(other),
            "extra": F.when(F.size("_names") > 0, F.to_json(F.map_from_arrays("_names", "_more"))),
            "raw": F.col("line"),
        }
    )


def _family(source: str) -> Callable[[DataFrame, Options], DataFrame]:
    return lambda lines, o: syslog(lines, o, source)


#: Parser by type name.
PARSERS: dict[str, Callable[[DataFrame, Options], DataFrame]] = {
    "auth": _family("auth"),
    "syslog": _family("syslog"),
    "messages": _family("syslog"),
    "kern": _family("kern"),
    "cron": _family("cron"),
    "access": access,
    "weberror": weberror,
    "auditd": auditd,
    "bash_history": bash_history,
    "applog": applog,
    "logfmt": logfmt,
    "csv": csv,
    "dmesg": dmesg,
    "apt": apt,
    "fontconfig": fontconfig,
    "udev": udev,
    "raw": raw,
}


def parse(lines: DataFrame, kind: str, options: Options = Options()) -> DataFrame:
    """Event rows (without id) of lines of one type, with their rule log source."""
    out = conform(PARSERS[kind](lines, options))
    ok, key = classify()
    return out.withColumns({"sigma_ok": ok, "sigma_logsource": key})

"""Registered queries of the log engine and their DuckDB equivalents.

Parsers are shown by rendering table rows as log lines and parsing them back, so the oracle is the table itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell import engine
from tracewell.functions.columns import IPV4, hex_decoded, in_cidr, ip_class, ip_to_long, net_bounds, sockaddr
from tracewell.functions.tables import shared_folder
from tracewell.operators import analytics, binaries, ioc, timeline
from tracewell.operators.positions import Positions
from tracewell.plans import rules as R
from tracewell.plans.search import Fields, compile_query
from tracewell.schema import conform, from_app_events
from tracewell.sources import detect
from tracewell.sources.parsers import Options, parse

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The normalized event row of the events table, as SQL.
EV = """ev AS (SELECT event_id AS id, ts, 'app' AS source, CAST(user_id AS VARCHAR) AS "user", event_type AS event, CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS severity,
 event_type AS message, CAST(floor(value) AS BIGINT) AS bytes, props AS extra,
 'level=' || CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END || ' user=' || CAST(user_id AS VARCHAR) || ' event=' || event_type || ' k=' || (props->>'k') AS raw FROM events)"""
#: What free text is matched against: message, raw, user and source; the other columns are null here.
TEXT = "concat_ws(' ', message, raw, \"user\", source)"


def add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_app_events(read(spark, sf_dir, "events"))


FIELDS = Fields(["k"])


def _search(query: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return events(spark, sf_dir).where(compile_query(query, FIELDS)[0]).select("id", "ts", "user", "event")

    return run


def search(name: str, query: str, where: str) -> None:
    add(f"search_{name}", _search(query), f'WITH {EV} SELECT id, ts, "user", event FROM ev WHERE {where}')


search("equals", "event=error", "lower(event) = 'error'")
search("double_equals", "event==ERROR", "lower(event) = 'error'")
search("contains", "event:err", "event ILIKE '%err%'")
search("negated", "-event=error", "NOT coalesce(lower(event) = 'error', false)")
search("not_equal", "event!=view user=7", "NOT coalesce(lower(event) = 'view', false) AND \"user\" = '7'")
search("number_list", "bytes:1,2,3,4,5", "bytes IN (1, 2, 3, 4, 5)")
search("number_range", "bytes>=100 bytes<200", "bytes >= 100 AND bytes < 200")
search("number_glob", "bytes:1*", "CAST(bytes AS VARCHAR) ILIKE '1%'")
search("number_as_text", "size=abc OR size=7", "CAST(bytes AS VARCHAR) = 'abc' OR bytes = 7")
search("extra_key", "x:k=87", "lower(props_k) = '87'".replace("props_k", "(extra->>'k')"))
search("extra_alias", "eventdata.K:8", "(extra->>'k') ILIKE '%8%'")
search("time_day", "ts:2024-01-10", "CAST(ts AS VARCHAR) LIKE '2024-01-10%'")
search("time_hour", 'ts:"2024-01-10 03"', "CAST(ts AS VARCHAR) LIKE '2024-01-10 03%'")
search("time_from", "ts>=2024-01-15T12:00:00Z", "ts >= TIMESTAMP '2024-01-15 12:00:00'")
search("groups", "(event=click OR event=view) NOT user=5", "(event = 'click' OR event = 'view') AND NOT coalesce(\"user\" = '5', false)")
search("symbols", "event=click || event=signup && ! user=9", "event = 'click' OR (event = 'signup' AND NOT coalesce(\"user\" = '9', false))")
search("regex", "/user=1[0-3] event=p/", "regexp_matches(coalesce(raw, message, ''), 'user=1[0-3] event=p', 'i')")
search("field_regex", "event:/^(cl|si)/", "regexp_matches(event, '^(cl|si)', 'i')")
search("field_glob", "event:?ur*se", "event ILIKE '_ur%se' ESCAPE '\\'")
search("free_text", "ERROR", f"{TEXT} ILIKE '%error%'")
search("free_glob", "*eve?t*click*", f"{TEXT} ILIKE '%eve_t%click%'")
search("phrase", '"event=view k=1"', f"{TEXT} ILIKE '%event=view k=1%'")
search("present", "user:*", "\"user\" IS NOT NULL AND \"user\" <> ''")
search("missing", "src_ip:- severity:error", "severity ILIKE '%error%'")
search("text_order", "event>login", "lower(event) > 'login'")
search("alias", "username=42 sev=info", "\"user\" = '42' AND severity = 'info'")
search("spaced", "event = purchase user contains 1", "lower(event) = 'purchase' AND \"user\" ILIKE '%1%'")
search("nulls_kept", "-path:login -referer=x", "true")


def _seq(s: SparkSession, d: str) -> DataFrame:
    return timeline.with_seq(events(s, d)).select("seq", "id", "ts")


SEQ = f'WITH {EV}, sq AS (SELECT *, row_number() OVER (ORDER BY ts NULLS LAST, id) AS seq FROM ev)'
add("timeline_seq", _seq, f"{SEQ} SELECT seq, id, ts FROM sq")


def _seq_appended(s: SparkSession, d: str) -> DataFrame:
    """The table in three appends: the first days, late arrivals between them, and the rest."""
    e = events(s, d).select("id", "ts")
    kept = Positions(s, shared_folder(s, "positions"))
    late = F.coalesce(F.col("ts") < F.lit("2024-01-10").cast("timestamp_ntz"), F.lit(False))
    for rows in (late & (F.col("id") % 3 > 0), late & (F.col("id") % 3 == 0), ~late):
        kept.add(e.where(rows))
    return kept.seq()


add("timeline_seq_appended", _seq_appended, f"{SEQ} SELECT seq, id FROM sq")


def _error_page(s: SparkSession, d: str) -> DataFrame:
    rows = events(s, d).where(compile_query("event=error x:k>5", FIELDS)[0])
    return timeline.page(rows, "ts", True, 200).select("id", "ts", "user", "event", "bytes", "extra")


add("search_error_page", _error_page, f'WITH {EV} SELECT id, ts, "user", event, bytes, extra FROM ev WHERE event = \'error\' AND lower(extra->>\'k\') > \'5\' ORDER BY ts DESC NULLS LAST, id DESC LIMIT 200')
add("page_offset", lambda s, d: timeline.page(events(s, d), "bytes", True, 100, 50).select("id", "bytes"), f"WITH {EV} SELECT id, bytes FROM ev ORDER BY bytes DESC NULLS LAST, id LIMIT 100 OFFSET 50")
add("page_by_extra", lambda s, d: timeline.page(events(s, d), "x:k", False, 100).select("id", "extra"), f"WITH {EV} SELECT id, extra FROM ev ORDER BY extra->>'k' NULLS LAST, id LIMIT 100")
add("time_window", lambda s, d: timeline.in_range(events(s, d), "2024-01-05", "2024-01-07").select("id", "ts"), f"WITH {EV} SELECT id, ts FROM ev WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-07'")


def _context_rows(s: SparkSession, d: str) -> DataFrame:
    seqd = timeline.with_seq(events(s, d)).select("seq", "id", "ts", "event")
    return timeline.context_rows(seqd, seqd.where("event = 'purchase'"), 5, 3).select("anchor", "seq", "id")


add("context_rows", _context_rows, f"{SEQ} SELECT a.id AS anchor, b.seq, b.id FROM sq a JOIN sq b ON b.seq BETWEEN a.seq - 5 AND a.seq + 3 WHERE a.event = 'purchase'")


def _context_time(s: SparkSession, d: str) -> DataFrame:
    e = events(s, d).select("id", "ts", "event")
    return timeline.context_time(e, e.where("event = 'signup'"), 600, 1800, 4 * s.sparkContext.defaultParallelism).select("anchor", "id", "ts")


add("context_time", _context_time, f"WITH {EV} SELECT a.id AS anchor, b.id, b.ts FROM ev a JOIN ev b ON b.ts BETWEEN a.ts - INTERVAL 600 SECOND AND a.ts + INTERVAL 1800 SECOND WHERE a.event = 'signup'")


def _as_of(s: SparkSession, d: str) -> DataFrame:
    e = events(s, d)
    got = timeline.last_before(e.withColumn("raw_id", F.col("id")), F.col("event") == "purchase", F.col("event") == "click", ["user"], "raw_id")
    return got.select("id", F.col("found").alias("click_id"))


add("as_of_click", _as_of, f"WITH {EV} SELECT p.id, c.id AS click_id FROM (SELECT * FROM ev WHERE event = 'purchase') p ASOF LEFT JOIN (SELECT * FROM ev WHERE event = 'click') c ON p.\"user\" = c.\"user\" AND p.ts >= c.ts")
add(
    "islands_by_user",
    lambda s, d: timeline.islands(events(s, d), ["user"], "event").groupBy("user", "island").agg(F.min("event").alias("event"), F.count("*").alias("n"), F.min("ts").alias("first_ts")).withColumn("island", F.col("island").cast("long")),
    f'WITH {EV}, f AS (SELECT *, CASE WHEN event IS DISTINCT FROM lag(event) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS c FROM ev WINDOW w AS (PARTITION BY "user" ORDER BY ts, id)), g AS (SELECT *, sum(c) OVER (PARTITION BY "user" ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS island FROM f) SELECT "user", CAST(island AS BIGINT) AS island, min(event) AS event, count(*) AS n, min(ts) AS first_ts FROM g GROUP BY ALL',
)

add("facet_event", lambda s, d: analytics.facet(events(s, d), "event"), f"WITH {EV} SELECT event AS value, count(*) AS n FROM ev WHERE event <> '' GROUP BY 1 ORDER BY n DESC, value LIMIT 20")
add("facet_user", lambda s, d: analytics.facet(events(s, d), "user", 15), f"WITH {EV} SELECT \"user\" AS value, count(*) AS n FROM ev GROUP BY 1 ORDER BY n DESC, value LIMIT 15")
add("facet_extra", lambda s, d: analytics.facet(events(s, d), "x:k"), f"WITH {EV} SELECT extra->>'k' AS value, count(*) AS n FROM ev WHERE (extra->>'k') <> '' GROUP BY 1 ORDER BY n DESC, value LIMIT 20")
add("facet_totals", lambda s, d: analytics.facet_totals(events(s, d), "user"), f"WITH {EV} SELECT count(*) AS matched, count(DISTINCT \"user\") AS distinct_values FROM ev WHERE \"user\" <> ''")
add("extra_keys", lambda s, d: analytics.extra_keys(events(s, d)), f"WITH {EV} SELECT DISTINCT unnest(json_keys(extra)) AS key FROM ev")
add("stats_by_event", lambda s, d: analytics.stats(events(s, d), "event"), f"WITH {EV} SELECT event, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM ev GROUP BY 1")
add("dashboard_counters", lambda s, d: analytics.counters(events(s, d)), f"WITH {EV} SELECT count(*) AS total, min(ts) AS first_ts, max(ts) AS last_ts, CAST(0 AS BIGINT) AS n_src_ip, count(DISTINCT \"user\") AS n_user, CAST(0 AS BIGINT) AS n_src_file, count(DISTINCT source) AS n_source FROM ev")
add(
    "dashboard_tops",
    lambda s, d: analytics.tops(events(s, d)).select("field", "value", "n", F.col("rank").cast("long").alias("rank")),
    f"WITH {EV}, u AS (SELECT 'user' AS field, \"user\" AS value FROM ev UNION ALL SELECT 'source', source FROM ev UNION ALL SELECT 'severity', severity FROM ev), g AS (SELECT field, value, count(*) AS n FROM u GROUP BY ALL) SELECT field, value, n, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS rank FROM g QUALIFY rank <= 10",
)
add(
    "histogram",
    lambda s, d: analytics.histogram(events(s, d)),
    f"WITH {EV}, t AS (SELECT epoch_us(ts) AS us FROM ev WHERE ts IS NOT NULL), m AS (SELECT min(us) AS a, max(us) AS b FROM t), n AS (SELECT least(((us - a) * 120) // (b - a), 119) AS bucket, count(*) AS n FROM t, m GROUP BY 1) SELECT CAST(r AS BIGINT) AS bucket, coalesce(n, 0) AS n FROM (SELECT unnest(range(0, 120)) AS r) LEFT JOIN n ON r = bucket",
)

IP = "concat('10.', CAST(user_id % 200 AS VARCHAR), '.', CAST(event_id % 256 AS VARCHAR), '.7')"


def _with_ip(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "events").withColumn("ip", F.concat_ws(".", F.lit("10"), (F.col("user_id") % 200).cast("string"), (F.col("event_id") % 256).cast("string"), F.lit("7")))


add("cidr_filter", lambda s, d: _with_ip(s, d).where(in_cidr(F.col("ip"), "10.16.0.0/12")).select("event_id", "ip"), f"SELECT event_id, {IP} AS ip FROM events WHERE user_id % 200 BETWEEN 16 AND 31")
add("ip_class", lambda s, d: _with_ip(s, d).select(ip_class(F.col("ip")).alias("class")).groupBy("class").agg(F.count("*").alias("n")), "SELECT 'internal' AS class, count(*) AS n FROM events")


def _enriched(s: SparkSession, d: str) -> DataFrame:
    ranges = s.createDataFrame([(167772160, 168820735, "net-a"), (169000000, 170000000, "net-b"), (180000000, 181000000, "net-c")], "net_start long, net_end long, org string")
    rows = read(s, d, "events").select("event_id", (F.lit(167772160) + (F.col("user_id") % 200) * 65536 + (F.col("event_id") % 256) * 256 + 7).alias("ip_number"))
    return analytics.enrich_ip(rows, ranges).groupBy("org").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


add(
    "ip_range_join",
    _enriched,
    "WITH r(net_start, net_end, org) AS (VALUES (167772160, 168820735, 'net-a'), (169000000, 170000000, 'net-b'), (180000000, 181000000, 'net-c')), e AS (SELECT event_id, 167772160 + (user_id % 200) * 65536 + (event_id % 256) * 256 + 7 AS n FROM events) SELECT org, count(*) AS n, min(event_id) AS first_id FROM e LEFT JOIN r ON n BETWEEN net_start AND net_end GROUP BY 1",
)

_NESTED = {"10.0.0.0/8": "eight", "10.16.0.0/12": "twelve", "10.17.0.0/16": "sixteen", "10.17.4.0/22": "twentytwo", "10.17.5.7/32": "host", "10.150.0.0/15": "fifteen", "192.168.0.0/16": "none"}


def _nested(s: SparkSession, d: str) -> DataFrame:
    nets = s.createDataFrame([(*(int(x[1:], 16) for x in net_bounds(k)), v) for k, v in _NESTED.items()], "net_start long, net_end long, org string")
    rows = _with_ip(s, d).withColumn("ip_number", ip_to_long(F.col("ip")))
    return analytics.enrich_ip(rows, nets).select("event_id", "ip", "org")


add(
    "ip_longest_prefix",
    _nested,
    f"SELECT event_id, {IP} AS ip, CASE WHEN user_id % 200 = 17 AND event_id % 256 = 5 THEN 'host' WHEN user_id % 200 = 17 AND event_id % 256 BETWEEN 4 AND 7 THEN 'twentytwo' WHEN user_id % 200 = 17 THEN 'sixteen' WHEN user_id % 200 BETWEEN 16 AND 31 THEN 'twelve' WHEN user_id % 200 IN (150, 151) THEN 'fifteen' ELSE 'eight' END AS org FROM events",
)
add("facet_network", lambda s, d: analytics.facet_network(_with_ip(s, d).withColumn("src_ip", F.concat_ws(".", F.lit("11"), (F.col("user_id") % 200).cast("string"), F.lit("0"), F.lit("7"))), s.createDataFrame([(184549376, 185597951, "net-a"), (186000000, 190000000, "net-b")], "net_start long, net_end long, org string"), "org"), "SELECT CASE WHEN user_id % 200 < 16 THEN 'net-a' ELSE 'net-b' END AS value, CAST(count(*) AS BIGINT) AS n FROM events WHERE user_id % 200 < 16 OR 184549376 + (user_id % 200) * 65536 + 7 BETWEEN 186000000 AND 190000000 GROUP BY 1")


def _addressed(s: SparkSession, d: str) -> DataFrame:
    return events(s, d).withColumn("src_ip", F.concat(F.lit("10.0.0."), (F.col("id") % 20).cast("string"))).withColumn("severity", F.when(F.col("event").isin("error", "view"), "fail").otherwise(F.col("severity"))).withColumn("event", F.when(F.col("event") == "error", "ssh_failed").otherwise(F.col("event")))


_ADDRESSED = f"WITH {EV}, a AS (SELECT * REPLACE (CASE WHEN event = 'error' THEN 'ssh_failed' ELSE event END AS event, CASE WHEN event IN ('error', 'view') THEN 'fail' ELSE severity END AS severity), '10.0.0.' || (id % 20) AS src_ip FROM ev)"
add("ip_detail", lambda s, d: analytics.ip_profile(_addressed(s, d), "10.0.0.7")["detail"], f"{_ADDRESSED} SELECT count(*) AS total, min(ts) AS first_ts, max(ts) AS last_ts, CAST(count(*) FILTER (severity = 'fail') AS BIGINT) AS fails FROM a WHERE src_ip = '10.0.0.7'")
add("ip_users", lambda s, d: analytics.ip_profile(_addressed(s, d), "10.0.0.7")["users"], f'{_ADDRESSED} SELECT "user" AS value, count(*) AS n FROM a WHERE src_ip = \'10.0.0.7\' GROUP BY 1 ORDER BY n DESC, value LIMIT 8')
add("ip_samples", lambda s, d: analytics.ip_profile(_addressed(s, d), "10.0.0.7")["samples"].select("id", "ts", "event"), f"{_ADDRESSED} SELECT id, ts, event FROM a WHERE src_ip = '10.0.0.7' ORDER BY ts NULLS LAST, id LIMIT 8")
add("ip_counts", lambda s, d: analytics.ip_counts(_addressed(s, d)), f"{_ADDRESSED} SELECT src_ip, count(*) AS n FROM a GROUP BY 1")
add("network", lambda s, d: analytics.network(_addressed(s, d), ip="10.0.0.7", event="ssh_failed").select("id", "ts"), f"{_ADDRESSED} SELECT id, ts FROM a WHERE src_ip = '10.0.0.7' AND event = 'ssh_failed' ORDER BY ts NULLS LAST, id LIMIT 3000")

RULES = """
title: errors of one user
name: errors
logsource: {category: application}
level: high
tags: [attack.credential_access, attack.t1110]
detection:
  sel: {event: error}
  not_low: {bytes|lt: 10}
  condition: sel and not not_low
---
title: purchases or sign-ups
name: buys
logsource: {category: application}
level: low
tags: [attack.t1078]
detection:
  sel_a: {event|startswith: pur}
  sel_b: {event|endswith: up}
  condition: 1 of sel_*
---
title: keyword
logsource: {category: application}
detection:
  words: ['event=click k=1', 'event=view k=2?']
  condition: words
---
title: values
logsource: {category: application}
detection:
  a: {user|re: '^1[0-9]$', k|gte: 50}
  b: {event: [click, view]}
  c: {user|contains|all: ['1', '2']}
  condition: (a and b) or c
---
title: other system
logsource: {product: windows}
detection: {sel: {a: b}, condition: sel}
---
title: many errors
correlation: {type: event_count, rules: [errors], group-by: [user], timespan: 1d, condition: {gte: 3}}
---
title: many keys
correlation: {type: value_count, rules: [buys], group-by: [user], timespan: 2d, condition: {gte: 3, field: k}}
---
title: errors and buys
correlation: {type: temporal, rules: [errors, buys], group-by: [user], timespan: 12h}
"""
_RULES = R.load_text(RULES)
_HITS = {
    "errors of one user": "event = 'error' AND NOT (bytes < 10)",
    "purchases or sign-ups": "event ILIKE 'pur%' OR event ILIKE '%up'",
    "keyword": "raw ILIKE '%event=click k=1%' OR raw ILIKE 'event=view k=2_' OR message ILIKE '%event=click k=1%' OR message ILIKE 'event=view k=2_'",
    "values": "(regexp_matches(\"user\", '^1[0-9]$') AND TRY_CAST(extra->>'k' AS DOUBLE) >= 50 AND event IN ('click', 'view')) OR (\"user\" ILIKE '%1%' AND \"user\" ILIKE '%2%')",
}
_HIT_SQL = " UNION ALL ".join(f"SELECT '{t}' AS rule, id, ts, \"user\", extra FROM ev WHERE {w}" for t, w in _HITS.items())
add("rule_hits", lambda s, d: R.hits(events(s, d), _RULES).select("rule", "id"), f"WITH {EV}, h AS ({_HIT_SQL}) SELECT rule, id FROM h")
add(
    "rule_findings",
    lambda s, d: R.findings(events(s, d), _RULES, 3).select("rule", "level", "n", F.array_join(F.col("sample_ids").cast("array<string>"), ",").alias("samples")),
    f"WITH {EV}, h AS ({_HIT_SQL}), r AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY ts NULLS LAST, id) AS k FROM h) SELECT rule, CASE rule WHEN 'errors of one user' THEN 'high' WHEN 'purchases or sign-ups' THEN 'low' ELSE 'medium' END AS level, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY k) FILTER (k <= 3) AS samples FROM r GROUP BY 1",
)
add("rule_applicability", lambda s, d: R.applicability(events(s, d), _RULES).select("rule", "log_source", "events", F.col("skipped").isNull().alias("runs")), "WITH n AS (SELECT count(*) AS events FROM events), r(rule, log_source, runs) AS (VALUES ('errors of one user', 'application', true), ('purchases or sign-ups', 'application', true), ('keyword', 'application', true), ('values', 'application', true), ('other system', NULL, false)) SELECT rule, log_source, CAST(CASE WHEN runs THEN events ELSE 0 END AS BIGINT) AS events, runs FROM r, n")
add("attack_matrix", lambda s, d: R.matrix(R.findings(events(s, d), _RULES, 1), _RULES).select("tactic", "technique", "n"), f"WITH {EV}, h AS ({_HIT_SQL}) SELECT CASE rule WHEN 'errors of one user' THEN 'credential-access' ELSE 'other' END AS tactic, CASE rule WHEN 'errors of one user' THEN 'T1110' ELSE 'T1078' END AS technique, CAST(count(*) AS BIGINT) AS n FROM h WHERE rule IN ('errors of one user', 'purchases or sign-ups') GROUP BY ALL")


def _correlated(title: str) -> Callable[[SparkSession, str], DataFrame]:
    rule = next(r for r in _RULES if r.title == title)
    return lambda s, d: R.correlate(events(s, d), _RULES, rule)


def _bucket(seconds: int) -> str:
    return f"make_timestamp(CAST(floor(epoch(ts) / {seconds}) AS BIGINT) * {seconds} * 1000000)"


_E, _B = (f"SELECT *, '{k}' AS rule FROM ev WHERE {_HITS[t]}" for k, t in (("e", "errors of one user"), ("b", "purchases or sign-ups")))
_AGG = "min(id) AS first_id, min(ts) AS first_ts, max(ts) AS last_ts"
add("correlation_event_count", _correlated("many errors"), f'WITH {EV}, h AS ({_E}) SELECT "user", {_bucket(86400)} AS start, count(*) AS n, {_AGG} FROM h GROUP BY 1, 2 HAVING n >= 3')
add("correlation_value_count", _correlated("many keys"), f'WITH {EV}, h AS ({_B}) SELECT "user", {_bucket(172800)} AS start, count(DISTINCT extra->>\'k\') AS n, {_AGG} FROM h GROUP BY 1, 2 HAVING n >= 3')
add("correlation_temporal", _correlated("errors and buys"), f'WITH {EV}, h AS ({_E} UNION ALL {_B}) SELECT "user", {_bucket(43200)} AS start, count(DISTINCT rule) AS n, {_AGG} FROM h GROUP BY 1, 2 HAVING n >= 2')


def _documents(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "documents").select(F.col("doc_id").alias("id"), F.lit(None).cast("timestamp_ntz").alias("ts"), "text")


# lookarounds are beyond the oracle's regular expressions, so each pattern is widened by the neighbours it excludes and the match cut out
add(
    "ioc_hashes",
    lambda s, d: ioc.extracted(_documents(s, d), F.lit(""), F.col("text"), ipv6=False).where("type = 'sha1'").groupBy("value").agg(F.count("*").alias("n"), F.min("id").alias("first_id")),
    "WITH m AS (SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(regexp_replace(text, '[^0-9A-Za-z_]', ' ', 'g'), '(?:^| )([0-9A-Fa-f]{40})(?: |$)', 1))) AS value FROM documents) SELECT value, count(*) AS n, min(doc_id) AS first_id FROM m GROUP BY 1",
)
add(
    "ioc_urls",
    lambda s, d: ioc.extracted(read(s, d, "pages").select(F.col("page_id").alias("id"), F.lit(None).cast("timestamp_ntz").alias("ts"), "url"), F.col("url"), ipv6=False).where("type = 'url'").select("id", "value"),
    "SELECT page_id AS id, rtrim(regexp_extract(url, 'https?://[^\\s\"''`<>\\]\\[{}|\\\\^]+'), '.,);]}\"''>') AS value FROM pages WHERE regexp_matches(url, 'https?://[^\\s]+')",
)
add(
    "ioc_domains",
    lambda s, d: ioc.rolled_up(ioc.extracted(read(s, d, "pages").select(F.col("page_id").alias("id"), F.lit(None).cast("timestamp_ntz").alias("ts"), "url"), F.col("url"), ipv6=False).where("type = 'domain'"), 50).select("value", "n", "first_id"),
    "WITH m AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS value FROM pages) SELECT value, count(*) AS n, min(page_id) AS first_id FROM m WHERE regexp_matches(value, '\\.(com|org|net)$') GROUP BY 1 ORDER BY n DESC, value LIMIT 50",
)
def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _ioc_sql() -> str:
    """All types but ipv6. Lookarounds give way to the neighbours they allow; what stands in no value is doubled, so that two values need not share one."""

    def bare(name: str) -> str:
        p = ioc.PATTERNS[name].removeprefix("(?i)")
        p = p[p.index(")") + 1 :] if p.startswith("(?<!") else p
        return p[: p.index("(?!")] if "(?!" in p else p

    def every(name: str, source: str, before: str = "", after: str = "", keep: str = "") -> str:
        text = f"regexp_replace(t, {_quoted(f'([^{keep}])')}, {_quoted(r'\1\1')}, 'g')" if keep else "t"
        flag = "(?i)" if ioc.PATTERNS[name].startswith("(?i)") else ""
        return f"SELECT id, unnest(regexp_extract_all({text}, {_quoted(flag + before + bare(name) + after)}, 1)) AS value FROM {source}"

    def listed(words: str) -> str:
        return ", ".join(map(_quoted, words.split()))

    def domain(d: str) -> str:
        tld = f"regexp_extract({d}, '[^.]*$')"
        return f"length({d}) <= 253 AND {tld} NOT IN ({listed(ioc.FILE_EXTENSIONS)}) AND {d} NOT IN ({listed(ioc.NO_HOSTS)}) AND (length({tld}) = 2 OR {tld} IN ({listed(ioc.GTLDS)})) AND contains({d}, '.')"

    ip = f"regexp_matches(value, {_quoted(IPV4)})"
    word, hosts = r"(?:^|[^\w])", " UNION ALL SELECT id, value FROM hosts"
    parts = {
        "ipv4": (every("ipv4", "c", r"(?:^|[^\w.])", r"(?:[^\w.]|$)", r"\w.") + hosts, "value", ip + r" AND NOT regexp_matches(value, '^(?:0\.0\.0\.0|255\.255\.255\.255|2[45]\d\..*)$')"),
        "email": (every("email", "c", r"(?:^|[^\w.+\-])", r"(?:[^\w.\-]|$)", r"\w.%+@\-"), "lower(value)", domain("regexp_extract(lower(value), '[^@]*$')")),
        "domain": (every("domain", "c", r"(?:^|[^\w@.\-/])", r"(?:[^\w\-]|$)", r"\w@./\-") + hosts, "lower(value)", domain("lower(value)") + f" AND NOT {ip}"),
        "unixpath": (every("unixpath", "c", word), "value", "true"),
        "winpath": (every("winpath", "c", word), "value", "true"),
        "registry": (every("registry", "c", word), "value", "true"),
        "pipe": (every("pipe", "c"), "value", "true"),
        "imphash": (every("imphash", "hashed"), "lower(value)", "true"),
    } | {k: (every(k, "hashed", word, r"(?:[^\w]|$)", r"\w"), "lower(value)", "true") for k in ("md5", "sha1", "sha256")}
    found = " UNION ALL ".join(f"SELECT id, '{k}' AS type, {v} AS value FROM ({q}) WHERE {w}" for k, (q, v, w) in parts.items())
    url, field = _quoted(ioc.URL), _quoted(ioc.HEX_FIELD)
    return (
        "WITH d AS (SELECT doc_id AS id, coalesce(text, '') AS t FROM documents),"
        f" u AS (SELECT id, rtrim(unnest(regexp_extract_all(t, {url})), {_quoted(ioc.URL_END)}) AS value FROM d), urls AS (SELECT * FROM u WHERE length(value) > 8),"
        " host AS (SELECT id, lower(regexp_extract(value, '^[A-Za-z]+://(?:[^/@]*@)?([^/:?#]+)', 1)) AS value FROM urls), hosts AS (SELECT * FROM host WHERE value <> ''),"
        f" c AS (SELECT id, regexp_replace(t, {url}, ' ', 'g') AS t FROM d), hashed AS (SELECT id, regexp_replace(t, {field}, ' ', 'g') AS t FROM d)"
        f" SELECT DISTINCT id, type, value FROM (SELECT id, 'url' AS type, value FROM urls UNION ALL {found})"
    )


# every type in whole documents but ipv6, whose short form SQL does not have
add("ioc_documents", lambda s, d: ioc.extracted(_documents(s, d), F.col("text"), ipv6=False, windows=True).select("id", "type", "value"), _ioc_sql())
_LABELS = ", ".join(f"('{k}', '{v}')" for k, v in ioc.LABELS.items())
add(
    "ioc_totals",
    lambda s, d: ioc.totals(ioc.extracted(_documents(s, d), F.col("text"), ipv6=False, windows=True)).select("type", "label", "total", "grand_total"),
    f"WITH f AS ({_ioc_sql()}), g AS (SELECT DISTINCT CASE WHEN type IN ('unixpath', 'winpath') THEN 'filepath' ELSE type END AS type, value FROM f), l(type, label) AS (VALUES {_LABELS}), n AS (SELECT type, count(*) AS total FROM g GROUP BY 1) SELECT type, label, total, CAST(sum(total) OVER () AS BIGINT) AS grand_total FROM n JOIN l USING (type)",
)
_WANTED = ["apache license", "MIT License", "no such thing", "AKIA"]
add(
    "ioc_sweep",
    lambda s, d: ioc.sweep_summary(ioc.sweep(_documents(s, d), F.col("text"), _WANTED), 3).select("indicator", "n", F.array_join(F.col("sample_ids").cast("array<string>"), ",").alias("samples")),
    f"WITH w AS (SELECT unnest({_WANTED}) AS indicator), m AS (SELECT indicator, doc_id, row_number() OVER (PARTITION BY indicator ORDER BY doc_id) AS k FROM w JOIN documents ON contains(lower(text), lower(indicator))) SELECT indicator, count(*) AS n, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY k) FILTER (k <= 3) AS samples FROM m GROUP BY 1",
)
#: More than are looked for one by one: each string of three of these letters, and longer ones.
_MANY = [a + b + c for a in "aeinorst" for b in "aeinorst" for c in "aeinorst"] + _WANTED
add(
    "ioc_sweep_many",
    lambda s, d: ioc.sweep(_documents(s, d), F.col("text"), _MANY).groupBy("indicator").agg(F.count("*").alias("n"), F.min("id").alias("first_id")),
    f"WITH w AS (SELECT unnest({_MANY}) AS indicator), d AS (SELECT doc_id, lower(text) AS t FROM documents) SELECT indicator, count(*) AS n, min(doc_id) AS first_id FROM w JOIN d ON contains(t, lower(indicator)) GROUP BY 1",
)

# parsers: render, then parse


def _rendered(s: SparkSession, d: str, line) -> DataFrame:
    e = read(s, d, "events")
    # the tables are small files that one task reads; log files come in many splits
    return e.select(F.lit("f.log").alias("src_file"), F.col("event_id").cast("int").alias("line_no"), line.alias("line"), F.lit(2024).alias("file_year")).repartition(s.sparkContext.defaultParallelism)


_TS = "date_format(ts, 'yyyy-MM-dd HH:mm:ss')"
_CUT = "date_trunc('second', ts)"
_STATUS = "CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 404 ELSE 200 END"


def _parse_logfmt(s: SparkSession, d: str) -> DataFrame:
    line = F.expr(f"concat('ts=', replace({_TS}, ' ', 'T'), 'Z level=', if(event_type='error','ERROR','info'), ' user=', user_id, ' event=', event_type, ' pid=', event_id, ' k=\"', event_id % 7, '\"')")
    return parse(_rendered(s, d, line), "logfmt").select("line_no", "ts", "severity", "user", F.get_json_object("extra", "$.event").alias("event"), "pid", F.get_json_object("extra", "$.k").alias("k"))


add("parse_logfmt", _parse_logfmt, f"SELECT CAST(event_id AS INTEGER) AS line_no, {_CUT} AS ts, CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS severity, CAST(user_id AS VARCHAR) AS \"user\", event_type AS event, CAST(event_id AS INTEGER) AS pid, CAST(event_id % 7 AS VARCHAR) AS k FROM events")


def _parse_access(s: SparkSession, d: str) -> DataFrame:
    line = F.expr(f"concat('10.0.0.', user_id % 256, ' - u', user_id, ' [', date_format(ts, 'dd/MMM/yyyy:HH:mm:ss'), ' +0200] \"GET /', event_type, '/', event_id, ' HTTP/1.1\" ', {_STATUS}, ' ', event_id * 3, ' \"-\" \"agent/1.0\"')")
    return parse(_rendered(s, d, line), "access").select("line_no", "ts", "src_ip", "user", "method", "path", "status", "bytes", "severity", "user_agent")


add("parse_access", _parse_access, f"SELECT CAST(event_id AS INTEGER) AS line_no, {_CUT} - INTERVAL 2 HOUR AS ts, '10.0.0.' || (user_id % 256) AS src_ip, 'u' || user_id AS \"user\", 'GET' AS method, '/' || event_type || '/' || event_id AS path, CAST({_STATUS} AS INTEGER) AS status, event_id * 3 AS bytes, CASE {_STATUS} WHEN 500 THEN 'error' WHEN 404 THEN 'warn' ELSE 'info' END AS severity, 'agent/1.0' AS user_agent FROM events")


def _parse_auth(s: SparkSession, d: str) -> DataFrame:
    message = "CASE event_type WHEN 'error' THEN concat('Failed password for invalid user u', user_id, ' from 10.1.2.3 port ', 1000 + event_id % 5000, ' ssh2') WHEN 'click' THEN concat('Accepted publickey for u', user_id, ' from 10.1.2.4 port 22 ssh2') ELSE 'Connection closed' END"
    line = F.expr(f"concat(date_format(ts, 'MMM'), ' ', lpad(cast(day(ts) as string), 2, ' '), ' ', date_format(ts, 'HH:mm:ss'), ' web01 sshd[', event_id, ']: ', {message})")
    return parse(_rendered(s, d, line), "auth", Options(base_year=2024)).select("line_no", "ts", "host", "program", "pid", "event", "severity", "user", "src_ip", "src_port", "sigma_logsource")


add(
    "parse_auth",
    _parse_auth,
    f"SELECT CAST(event_id AS INTEGER) AS line_no, {_CUT} AS ts, 'web01' AS host, 'sshd' AS program, CAST(event_id AS INTEGER) AS pid, CASE event_type WHEN 'error' THEN 'ssh_failed' WHEN 'click' THEN 'ssh_accepted' END AS event, CASE event_type WHEN 'error' THEN 'fail' WHEN 'click' THEN 'accept' END AS severity, CASE WHEN event_type IN ('error', 'click') THEN 'u' || user_id END AS \"user\", CASE event_type WHEN 'error' THEN '10.1.2.3' WHEN 'click' THEN '10.1.2.4' END AS src_ip, CAST(CASE event_type WHEN 'error' THEN 1000 + event_id % 5000 WHEN 'click' THEN 22 END AS INTEGER) AS src_port, 'linux/sshd' AS sigma_logsource FROM events",
)


def _parse_auditd(s: SparkSession, d: str) -> DataFrame:
    line = F.expr("concat('type=', upper(event_type), ' msg=audit(', 1700000000 + event_id, '.123:', event_id, '): pid=', event_id, ' uid=', user_id, ' exe=\"/usr/bin/', event_type, '\" success=', if(event_type='error','no','yes'))")
    return parse(_rendered(s, d, line), "auditd").select("line_no", "ts", "event", "user", "pid", "exe", "severity")


add("parse_auditd", _parse_auditd, "SELECT CAST(event_id AS INTEGER) AS line_no, make_timestamp((1700000000 + event_id) * 1000000) AS ts, event_type AS event, CAST(user_id AS VARCHAR) AS \"user\", CAST(event_id AS INTEGER) AS pid, '/usr/bin/' || event_type AS exe, CASE WHEN event_type = 'error' THEN 'fail' ELSE 'info' END AS severity FROM events")


def _parse_csv(s: SparkSession, d: str) -> DataFrame:
    o = read(s, d, "orders")
    rows = o.select(F.lit("o.csv").alias("src_file"), (F.col("o_orderkey") + 1).cast("int").alias("line_no"), F.expr("concat(date_format(o_orderdate, 'yyyy-MM-dd'), 'T00:00:00Z,u', o_custkey, ',\"', o_orderpriority, ', x\",', o_orderkey)").alias("line"), F.lit(2024).alias("file_year"))
    head = s.createDataFrame([("o.csv", -2147483648, "timestamp,user,priority name,pid", 2024)], rows.schema)
    return parse(head.unionByName(rows.repartition(s.sparkContext.defaultParallelism)), "csv").select("line_no", "ts", "user", "pid", F.get_json_object("extra", "$['priority name']").alias("priority"))


add("parse_csv", _parse_csv, "SELECT CAST(o_orderkey + 1 AS INTEGER) AS line_no, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS ts, 'u' || o_custkey AS \"user\", CAST(o_orderkey AS INTEGER) AS pid, o_orderpriority || ', x' AS priority FROM orders")


def _year_rollover(s: SparkSession, d: str) -> DataFrame:
    """The whole table: every month, across each new year."""
    o = read(s, d, "orders")
    months = o.select(F.date_trunc("month", "o_orderdate").alias("m")).distinct()
    rows = months.select(F.lit("syslog").alias("src_file"), F.row_number().over(Window.orderBy("m")).alias("line_no"), F.concat(F.date_format("m", "MMM"), F.lit("  1 00:00:00 h cron[1]: x")).alias("line"), F.lit(2000).alias("file_year"))
    first = o.agg(F.year(F.min("o_orderdate"))).first()[0] or 1992
    return parse(rows, "syslog", Options(base_year=int(first))).select("line_no", "ts")


add("parse_year_rollover", _year_rollover, "SELECT CAST(row_number() OVER (ORDER BY m) AS INTEGER) AS line_no, CAST(m AS TIMESTAMP) AS ts FROM (SELECT DISTINCT date_trunc('month', o_orderdate) AS m FROM orders)")


def _year_rollovers(s: SparkSession, d: str) -> DataFrame:
    """A file for each priority, each with its own new years."""
    o = read(s, d, "orders")
    months = o.select(F.col("o_orderpriority").alias("src_file"), F.date_trunc("month", "o_orderdate").alias("m")).distinct()
    at = F.row_number().over(Window.partitionBy("src_file").orderBy("m"))
    rows = months.select("src_file", at.alias("line_no"), F.concat(F.date_format("m", "MMM"), F.lit("  1 00:00:00 h cron[1]: x")).alias("line"), F.lit(2000).alias("file_year"))
    first = o.agg(F.year(F.min("o_orderdate"))).first()[0] or 1992
    return parse(rows, "syslog", Options(base_year=int(first))).select("src_file", "line_no", "ts")


add("parse_year_rollovers", _year_rollovers, "SELECT o_orderpriority AS src_file, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY m) AS INTEGER) AS line_no, CAST(m AS TIMESTAMP) AS ts FROM (SELECT DISTINCT o_orderpriority, date_trunc('month', o_orderdate) AS m FROM orders)")


def _ingested(s: SparkSession, d: str) -> DataFrame:
    """Log files written from the table, plain and compressed, read back by ingest."""
    folder = shared_folder(s, "logs")
    line = F.expr(f"concat('ts=', replace({_TS}, ' ', 'T'), 'Z level=', if(event_type='error','ERROR','info'), ' user=', user_id, ' event=', event_type, ' pid=', event_id)")
    e = read(s, d, "events").select("event_type", line.alias("value")).repartition(s.sparkContext.defaultParallelism)
    e.where("event_type = 'error'").select("value").write.option("compression", "gzip").text(f"{folder}/packed")
    e.where("event_type <> 'error' or event_type is null").select("value").write.text(f"{folder}/plain")
    found, manifest = engine.ingest(s, folder)
    files = manifest.select("src_file", "type", F.col("status").alias("file_status"))
    return found.join(files, "src_file").select("ts", "severity", "user", F.get_json_object("extra", "$.event").alias("event"), "pid", "type", "file_status")


add("ingest_events", _ingested, f"SELECT {_CUT} AS ts, CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS severity, CAST(user_id AS VARCHAR) AS \"user\", event_type AS event, CAST(event_id AS INTEGER) AS pid, 'logfmt' AS type, 'ok' AS file_status FROM events")


def _lines_of(s: SparkSession, d: str, *lines: str) -> DataFrame:
    """Several lines for each event, as SQL over its columns; line numbers count through the file."""
    e = read(s, d, "events").select((F.col("event_id") * len(lines)).alias("_n"), F.posexplode(F.array(*map(F.expr, lines))).alias("_i", "line"))
    return e.select(F.lit("f.log").alias("src_file"), (F.col("_n") + F.col("_i")).cast("int").alias("line_no"), "line", F.lit(2024).alias("file_year")).repartition(s.sparkContext.defaultParallelism)


def _stitched(s: SparkSession, d: str) -> DataFrame:
    head = "concat('type={} msg=audit(', 1700000000 + event_id, '.5:', event_id, '): ', {})"
    lines = _lines_of(
        s,
        d,
        head.format("SYSCALL", "concat('success=yes ppid=', event_id + 99999, ' pid=', event_id + 100000, ' exe=\"/usr/bin/', event_type, '\"')"),
        head.format("EXECVE", "concat('argc=2 a0=\"', event_type, '\" a1=', hex(cast(concat('-u ', user_id) as binary)))"),
        head.format("CWD", "concat('cwd=\"/home/u', user_id, '\"')"),
        head.format("SOCKADDR", "concat('saddr=02000035', '0A', lpad(hex(user_id % 256), 2, '0'), '0001', '0000000000000000')"),
    )
    got = parse(lines, "auditd")
    return got.select("line_no", "event", "exe", "message", *[F.get_json_object("extra", f"$.{k}").alias(k) for k in ("ppid", "cwd", "parent_exe", "dst_ip", "dst_port", "_dec")], "sigma_logsource").where("event in ('execve', 'syscall', 'sockaddr')")


_PARENT = "WITH e AS (SELECT e.*, p.event_type AS before FROM events e LEFT JOIN events p ON p.event_id = e.event_id - 1) "
_ADDRESS = "'10.' || (user_id % 256) || '.0.1' AS dst_ip, '53' AS dst_port, 'dst_ip,dst_port' AS _dec, 'linux/auditd' AS sigma_logsource"
add(
    "parse_auditd_stitched",
    _stitched,
    _PARENT
    + "SELECT CAST(event_id * 4 + 1 AS INTEGER) AS line_no, 'execve' AS event, '/usr/bin/' || event_type AS exe, event_type || ' -u ' || user_id AS message, CAST(event_id + 99999 AS VARCHAR) AS ppid, '/home/u' || user_id AS cwd, '/usr/bin/' || before AS parent_exe, NULL AS dst_ip, NULL AS dst_port, 'cmd' AS _dec, 'linux/process_creation' AS sigma_logsource FROM e"
    + f" UNION ALL SELECT CAST(event_id * 4 AS INTEGER), 'syscall', '/usr/bin/' || event_type, left('success=yes ppid=' || (event_id + 99999) || ' pid=' || (event_id + 100000) || ' exe=\"/usr/bin/' || event_type || '\"', 500), CAST(event_id + 99999 AS VARCHAR), NULL, NULL, {_ADDRESS} FROM e"
    + f" UNION ALL SELECT CAST(event_id * 4 + 3 AS INTEGER), 'sockaddr', NULL, 'saddr=020000350A' || lpad(printf('%X', user_id % 256), 2, '0') || '00010000000000000000', NULL, NULL, NULL, {_ADDRESS} FROM e",
)


def _one(kind: str, columns: list, *lines: str, **options) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: parse(_lines_of(s, d, *lines), kind, Options(**options)).selectExpr("line_no", *columns)


_N = "CAST(event_id AS INTEGER) AS line_no"
add(
    "parse_weberror",
    _one("weberror", ["ts", "program", "event", "severity", "pid", "src_ip", "method", "path"], "concat(date_format(ts, 'yyyy/MM/dd HH:mm:ss'), ' [', if(event_type = 'error', 'error', 'warn'), '] ', event_id, '#0: *1 open() failed, client: 10.0.0.', user_id % 256, ', request: \"GET /', event_type, ' HTTP/1.1\"')", offset_minutes=60),
    f"SELECT {_N}, {_CUT} - INTERVAL 1 HOUR AS ts, 'nginx' AS program, 'web_error' AS event, CASE event_type WHEN 'error' THEN 'error' ELSE 'warn' END AS severity, CAST(event_id AS INTEGER) AS pid, '10.0.0.' || (user_id % 256) AS src_ip, 'GET' AS method, '/' || event_type AS path FROM events",
)
add(
    "parse_weberror_apache",
    _one("weberror", ["ts", "program", "severity", "pid", "src_ip", "message"], "concat('[', date_format(ts, 'EEE MMM dd HH:mm:ss'), '.123456 ', year(ts), '] [core:error] [pid ', event_id, ':tid 7] [client 10.0.0.', user_id % 256, ':443] ', event_type)"),
    f"SELECT {_N}, {_CUT} AS ts, 'apache' AS program, 'error' AS severity, CAST(event_id AS INTEGER) AS pid, '10.0.0.' || (user_id % 256) AS src_ip, event_type AS message FROM events",
)
add(
    "parse_applog",
    _one("applog", ["ts", "severity", "message"], "concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss'), ',250 ', if(event_type = 'error', 'FATAL', 'INFO'), ': ', event_type, ' ', user_id)", offset_minutes=-60),
    f"SELECT {_N}, {_CUT} + INTERVAL 1 HOUR + INTERVAL 250 MILLISECOND AS ts, CASE event_type WHEN 'error' THEN 'error' ELSE 'info' END AS severity, event_type || ' ' || user_id AS message FROM events",
)
add(
    "parse_history",
    _one("bash_history", ["ts", "user", "event", "message"], "concat('#', 1700000000 + event_id)", "concat('ls /', event_type)", "'pwd'", user="joe"),
    "SELECT CAST(event_id * 3 + 1 AS INTEGER) AS line_no, make_timestamp((1700000000 + event_id) * 1000000) AS ts, 'joe' AS \"user\", 'command' AS event, 'ls /' || event_type AS message FROM events UNION ALL SELECT CAST(event_id * 3 + 2 AS INTEGER), NULL, 'joe', 'command', 'pwd' FROM events",
)
add(
    "parse_dmesg",
    _one("dmesg", ["ts", "program", "message", "double(get_json_object(extra, '$.ktime')) AS ktime"], "concat('[', lpad(concat(event_id, '.5'), 12, ' '), '] usb ', event_type)"),
    f"SELECT {_N}, CAST(NULL AS TIMESTAMP) AS ts, 'kernel' AS program, 'usb ' || event_type AS message, event_id + 0.5::DOUBLE AS ktime FROM events",
)
add("parse_fontconfig", _one("fontconfig", ["path", "event"], "concat('/usr/share/', event_type, ': caching, new cache contents: ', user_id)"), f"SELECT {_N}, '/usr/share/' || event_type AS path, 'fontconfig' AS event FROM events")
add("parse_raw", _one("raw", ["ts", "message"], "concat('note ', date_format(ts, 'EEE MMM dd HH:mm:ss'), ' UTC ', year(ts), ' of ', user_id)", offset_minutes=60), f"SELECT {_N}, {_CUT} AS ts, 'note ' || strftime(ts, '%a %b %d %H:%M:%S') || ' UTC ' || year(ts) || ' of ' || user_id AS message FROM events")
add(
    "parse_apt",
    _one("apt", ["ts", "event", "message", "int(get_json_object(extra, '$.actions')) AS actions"], "concat('Log started: ', date_format(ts, 'yyyy-MM-dd  HH:mm:ss'))", "concat('Unpacking ', event_type)", "concat('Setting up u', user_id)", "concat('Log ended: ', date_format(ts, 'yyyy-MM-dd  HH:mm:ss'))"),
    f"SELECT CAST(event_id * 4 AS INTEGER) AS line_no, {_CUT} AS ts, 'dpkg' AS event, 'Unpacking ' || event_type || '; Setting up u' || user_id AS message, 2 AS actions FROM events",
)
add(
    "parse_udev",
    _one("udev", ["ts", "event", "path", "message", "get_json_object(extra, '$.SEQNUM') AS seqnum"], "concat('UDEV  [', 1700000000 + event_id, '.5] ', event_type, ' /devices/x (usb)')", "concat('DEVPATH=/devices/', user_id)", "concat('SEQNUM=', event_id)", "''"),
    "SELECT CAST(event_id * 4 AS INTEGER) AS line_no, make_timestamp((1700000000 + event_id) * 1000000 + 500000) AS ts, 'udev' AS event, '/devices/' || user_id AS path, 'UDEV ' || event_type || ' /devices/x (usb)' AS message, CAST(event_id AS VARCHAR) AS seqnum FROM events",
)


def _recipe(kind: str, text: str) -> Callable[[SparkSession, str], DataFrame]:
    """A shipped recipe over parsed lines."""
    return lambda s, d: s.sql(text, events={"auth": _auth_lines, "access": _access_lines}[kind](s, d))


def _auth_lines(s: SparkSession, d: str) -> DataFrame:
    message = "CASE event_type WHEN 'error' THEN concat('Failed password for root from 10.1.2.', user_id % 50, ' port 22 ssh2') WHEN 'click' THEN concat('Accepted publickey for u', user_id, ' from 10.1.2.', user_id % 50, ' port 22 ssh2') ELSE 'joe : TTY=pts/0 ; USER=root ; COMMAND=/bin/ls' END"
    return parse(_lines_of(s, d, f"concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss'), 'Z web01 ', if(event_type IN ('error', 'click'), 'sshd', 'sudo'), '[7]: ', {message})"), "auth")


def _access_lines(s: SparkSession, d: str) -> DataFrame:
    return parse(_lines_of(s, d, f"concat('10.1.2.', user_id % 50, ' - - [', date_format(ts, 'dd/MMM/yyyy:HH:mm:ss'), ' +0000] \"GET /cgi-bin/', event_type, '.sh HTTP/1.1\" ', {_STATUS}, ' 5')"), "access")


_FROM = "'10.1.2.' || (user_id % 50)"
add("recipe_failures_by_ip", _recipe("auth", "SELECT src_ip, count(*) AS attempts FROM {events} WHERE event IN ('ssh_failed', 'ssh_invalid_user') GROUP BY src_ip ORDER BY attempts DESC, src_ip LIMIT 20"), f"SELECT {_FROM} AS src_ip, count(*) AS attempts FROM events WHERE event_type = 'error' GROUP BY 1 ORDER BY attempts DESC, src_ip LIMIT 20")
add("recipe_brute_force", _recipe("auth", "WITH brute AS (SELECT src_ip FROM {events} WHERE event = 'ssh_failed' GROUP BY src_ip HAVING count(*) > 5) SELECT e.ts, e.event, e.user, e.src_ip FROM {events} e JOIN brute b USING (src_ip) WHERE e.event IN ('ssh_failed', 'ssh_accepted')"), f"WITH e AS (SELECT {_CUT} AS ts, CASE event_type WHEN 'error' THEN 'ssh_failed' ELSE 'ssh_accepted' END AS event, CASE event_type WHEN 'error' THEN 'root' ELSE 'u' || user_id END AS \"user\", {_FROM} AS src_ip FROM events WHERE event_type IN ('error', 'click')) SELECT * FROM e WHERE src_ip IN (SELECT src_ip FROM e WHERE event = 'ssh_failed' GROUP BY 1 HAVING count(*) > 5)")
add("recipe_sudo", _recipe("auth", "SELECT ts, user, message FROM {events} WHERE source = 'auth' AND message LIKE '%COMMAND=%'"), f"SELECT {_CUT} AS ts, 'joe' AS \"user\", 'joe : TTY=pts/0 ; USER=root ; COMMAND=/bin/ls' AS message FROM events WHERE event_type NOT IN ('error', 'click')")
add("recipe_failed_passwords", _recipe("auth", "SELECT src_ip, count(*) AS n FROM {events} WHERE source = 'auth' AND message ILIKE '%failed password%' GROUP BY src_ip"), f"SELECT {_FROM} AS src_ip, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1")
add("recipe_first_last", _recipe("auth", "SELECT src_ip, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n FROM {events} WHERE src_ip IS NOT NULL GROUP BY src_ip"), f"SELECT {_FROM} AS src_ip, min({_CUT}) AS first_seen, max({_CUT}) AS last_seen, count(*) AS n FROM events WHERE event_type IN ('error', 'click') GROUP BY 1")
add("recipe_one_ip", _recipe("access", "SELECT ts, source, event, coalesce(exe, path, message) AS detail FROM {events} WHERE src_ip = '10.1.2.7'"), f"SELECT {_CUT} AS ts, 'access' AS source, 'http_request' AS event, '/cgi-bin/' || event_type || '.sh' AS detail FROM events WHERE user_id % 50 = 7")
add("recipe_web_errors", _recipe("access", "SELECT ts, src_ip, method, path, status FROM {events} WHERE source = 'access' AND status >= 400"), f"SELECT {_CUT} AS ts, {_FROM} AS src_ip, 'GET' AS method, '/cgi-bin/' || event_type || '.sh' AS path, CAST({_STATUS} AS INTEGER) AS status FROM events WHERE {_STATUS} >= 400")
add("recipe_web_shell", _recipe("access", "SELECT ts, src_ip, path, status FROM {events} WHERE source = 'access' AND (path LIKE '%.sh' OR path LIKE '%/cgi-bin/%') AND status >= 500"), f"SELECT {_CUT} AS ts, {_FROM} AS src_ip, '/cgi-bin/' || event_type || '.sh' AS path, 500 AS status FROM events WHERE event_type = 'error'")
add("recipe_time_range", _recipe("access", "SELECT ts, source, program, message FROM {events} WHERE ts BETWEEN TIMESTAMP_NTZ '2024-01-05 00:00:00' AND TIMESTAMP_NTZ '2024-01-05 23:59:59'"), f"SELECT {_CUT} AS ts, 'access' AS source, 'http' AS program, 'GET /cgi-bin/' || event_type || '.sh HTTP/1.1' AS message FROM events WHERE {_CUT} BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-05 23:59:59'")
add("recipe_exec_with_syscall", lambda s, d: s.sql("SELECT e.line_no, e.message AS cmd, s.exe FROM {events} e JOIN {events} s ON get_json_object(e.extra, '$.serial') = get_json_object(s.extra, '$.serial') AND s.event = 'syscall' WHERE e.event = 'execve'", events=parse(_lines_of(s, d, "concat('type=SYSCALL msg=audit(1700000000.5:', event_id, '): success=yes exe=\"/usr/bin/', event_type, '\"')", "concat('type=EXECVE msg=audit(1700000000.5:', event_id, '): argc=1 a0=\"', event_type, '\"')"), "auditd")), "SELECT CAST(event_id * 2 + 1 AS INTEGER) AS line_no, event_type AS cmd, '/usr/bin/' || event_type AS exe FROM events")
add("inventory", lambda s, d: analytics.inventory(events(s, d)), f"WITH {EV} SELECT 'total' AS kind, '' AS name, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM ev UNION ALL SELECT 'source', source, count(*), min(ts), max(ts) FROM ev GROUP BY source")


def _with_ip6(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "events").withColumn("ip", F.concat(F.lit("2001:db8:"), F.lower(F.hex(F.col("user_id") % 4096)), F.lit("::"), F.lower(F.hex(F.col("event_id") % 65536))))


add("ip_class_6", lambda s, d: _with_ip6(s, d).select(ip_class(F.col("ip")).alias("class")).groupBy("class").agg(F.count("*").alias("n")), "SELECT 'documentation' AS class, count(*) AS n FROM events")
add(
    "ip_range_join_6",
    lambda s, d: analytics.enrich_any(_with_ip6(s, d), F.col("ip"), s.createDataFrame([(*net_bounds("2001:db8::/42"), "low"), (*net_bounds("2001:db8:40::/42"), "high")], "net_start string, net_end string, org string")).groupBy("org").agg(F.count("*").alias("n")),
    "SELECT CASE WHEN user_id % 4096 < 64 THEN 'low' WHEN user_id % 4096 < 128 THEN 'high' END AS org, count(*) AS n FROM events GROUP BY 1",
)
_NESTED6 = {"2001:db8::/32": "32", "2001:db8:100::/40": "40", "2001:db8:120::/44": "44", "2001:db8:123::/48": "48", "2000::/3": "3"}
add(
    "ip_longest_prefix_6",
    lambda s, d: analytics.enrich_any(_with_ip6(s, d), F.col("ip"), s.createDataFrame([(*net_bounds(k), v) for k, v in _NESTED6.items()], "net_start string, net_end string, org string")).select("event_id", "org"),
    "SELECT event_id, CASE WHEN user_id % 4096 = 291 THEN '48' WHEN (user_id % 4096) // 16 = 18 THEN '44' WHEN (user_id % 4096) // 256 = 1 THEN '40' ELSE '32' END AS org FROM events",
)
add("finding_matches", lambda s, d: R.hits(events(s, d), _RULES).where("rule = 'errors of one user'").select("id", "rule_id", "matched"), f"WITH {EV} SELECT id, 'errors of one user' AS rule_id, 'event=error' || coalesce(' · bytes=' || bytes, '') AS matched FROM ev WHERE {_HITS['errors of one user']}")


def _detected(s: SparkSession, d: str) -> DataFrame:
    e = read(s, d, "events")
    logfmt = F.expr("concat('level=info user=', user_id, ' event=', event_type)")
    access = F.expr("concat('10.0.0.1 - - [01/Jan/2024:00:00:00 +0000] \"GET / HTTP/1.1\" 200 ', event_id)")
    audit = F.expr("concat('type=SYSCALL msg=audit(1700000000.1:', event_id, '): pid=1')")
    line = F.when(F.col("event_type") == "view", logfmt).when(F.col("event_type") == "click", access).otherwise(audit)
    rows = e.select(F.concat(F.lit("part-"), F.col("event_type")).alias("src_file"), F.col("event_id").cast("int").alias("line_no"), line.alias("line"), F.lit(2024).alias("file_year"))
    return detect.detected(rows)


add("detect_content", _detected, "SELECT DISTINCT 'part-' || event_type AS src_file, CASE event_type WHEN 'view' THEN 'logfmt' WHEN 'click' THEN 'access' ELSE 'auditd' END AS type FROM events")
add("hex_decode", lambda s, d: read(s, d, "events").select("event_id", hex_decoded(F.hex(F.concat(F.lit("cmd "), F.col("event_type")).cast("binary"))).alias("text")), "SELECT event_id, 'cmd ' || event_type AS text FROM events")


def _sockaddr(s: SparkSession, d: str) -> DataFrame:
    a = F.expr("concat('0200', lpad(hex(event_id % 65536), 4, '0'), '0A', lpad(hex(user_id % 256), 2, '0'), '0001', '0000000000000000')")
    ip, port = sockaddr(a)
    return read(s, d, "events").select("event_id", ip.alias("ip"), port.alias("port"))


add("sockaddr_decode", _sockaddr, "SELECT event_id, '10.' || (user_id % 256) || '.0.1' AS ip, CAST(event_id % 65536 AS VARCHAR) AS port FROM events")


def _ran(s: SparkSession, d: str) -> DataFrame:
    """Events of an audit log and of sudo, from the table, against a small catalogue."""
    e = read(s, d, "events")
    audit = e.select(F.col("event_id").alias("id"), "ts", F.lit("auditd").alias("source"), F.concat(F.lit("/usr/bin/"), "event_type").alias("exe"), F.lit("x").alias("message"), F.expr("concat('{\"euid\":\"', user_id % 3, '\",\"auid\":\"', user_id % 4, '\"}')").alias("extra"))
    sudo = e.where("event_type in ('purchase', 'view')").select((-F.col("event_id") - 1).alias("id"), "ts", F.lit("auth").alias("source"), F.lit(None).cast("string").alias("exe"), F.concat(F.lit("joe : COMMAND=/bin/"), F.upper("event_type"), F.lit(" -x")).alias("message"), F.lit(None).cast("string").alias("extra"))
    known = binaries.catalogue(s, {"click": "functions: {shell: [{code: c}]}", "purchase": "---\nfunctions:\n  sudo:\n  - code: '--- a'\n  shell:\n  - code: b\n---\n", "absent": "functions: {shell: [{code: c}]}"})
    got = binaries.executed(conform(audit.unionByName(sudo)), known, 3)
    return got.select("bin", "n", "n_root", "n_sudo", "as_root", "by_sudo", "escalated", F.array_join("auids", ",").alias("auids"), "danger", F.array_join(F.array_sort(F.map_keys("functions")), ",").alias("techniques"), F.array_join(F.col("samples").cast("array<string>"), ",").alias("samples"))


add(
    "binaries_executed",
    _ran,
    "WITH s AS (SELECT event_type AS bin, 'exe' AS sign, event_id AS id, ts, user_id % 3 = 0 AS root, CAST(user_id % 4 AS VARCHAR) AS auid FROM events UNION ALL SELECT event_type, 'sudo', -event_id - 1, ts, false, NULL FROM events WHERE event_type IN ('purchase', 'view')),"
    " k AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY ts NULLS LAST, id) AS r FROM s WHERE bin IN ('click', 'purchase')),"
    " g AS (SELECT bin, count(*) AS n, count(*) FILTER (root) AS n_root, count(*) FILTER (sign = 'sudo') AS n_sudo, coalesce(string_agg(DISTINCT auid, ',' ORDER BY auid) FILTER (root AND auid <> '0'), '') AS auids, string_agg(CAST(id AS VARCHAR), ',' ORDER BY r) FILTER (r <= 3) AS samples FROM k GROUP BY 1)"
    " SELECT bin, n, n_root, n_sudo, n_root > 0 AS as_root, n_sudo > 0 AS by_sudo, auids <> '' AS escalated, auids, n_root > 0 OR n_sudo > 0 OR auids <> '' AS danger, CASE bin WHEN 'click' THEN 'shell' ELSE 'shell,sudo' END AS techniques, samples FROM g",
)


def _two_sources(s: SparkSession, d: str) -> DataFrame:
    """Web and login events from the table: c-ip is a field of web logs alone."""
    web = F.col("event_type") == "click"
    rows = read(s, d, "events").select(
        F.col("event_id").alias("id"),
        "ts",
        F.when(web, "access").otherwise("auth").alias("source"),
        F.when(F.col("user_id") % 3 != 0, F.col("user_id").cast("string")).alias("user"),
        F.when(F.col("user_id") % 5 != 0, F.concat(F.lit("10.0.0."), (F.col("user_id") % 5).cast("string"))).alias("src_ip"),
        F.when(web, 500).alias("status"),
        F.when(F.col("event_type") == "error", "ssh_failed").alias("event"),
    )
    rules = R.load_text(_TWO)
    return R.correlate(conform(rows), rules, rules[2]).withColumnRenamed("c-ip", "c_ip")


_TWO = """
title: web
name: web
logsource: {category: webserver}
detection: {a: {sc-status: 500}, condition: a}
---
title: ssh
name: ssh
logsource: {product: linux, service: auth}
detection: {a: {event: ssh_failed}, condition: a}
---
title: both
correlation: {type: temporal, rules: [web, ssh], group-by: [c-ip], timespan: 1d}
"""
add(
    "correlation_two_sources",
    _two_sources,
    f"WITH h AS (SELECT event_id AS id, ts, event_type AS rule, CASE WHEN event_type = 'click' AND user_id % 5 <> 0 THEN '10.0.0.' || (user_id % 5) END AS c_ip FROM events WHERE event_type IN ('click', 'error') AND ts IS NOT NULL) SELECT c_ip, {_bucket(86400)} AS start, count(DISTINCT rule) AS n, {_AGG} FROM h GROUP BY 1, 2 HAVING n >= 2",
)

# set operations and the shipped recipes, as SQL over a temporary view


def _sql(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(text, ev=events(spark, sf_dir), labels=read(spark, sf_dir, "labels"), documents=read(spark, sf_dir, "documents"))

    return run


def sql(name: str, text: str) -> None:
    """The same text on both engines; {ev} and other tables in braces."""
    add(f"sql_{name}", _sql(text), f"WITH {EV} " + text.replace("{ev}", "ev").replace("{labels}", "labels").replace("{documents}", "documents").replace("`user`", '"user"').replace("WITH bad", ", bad", 1))


sql("first_last", "SELECT `user`, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM {ev} GROUP BY `user`")
sql("burst_then_buy", "WITH bad AS (SELECT `user`, count(*) AS n FROM {ev} WHERE event = 'error' GROUP BY `user` HAVING count(*) > 5) SELECT e.`user`, bad.n AS errors, min(e.ts) AS first_buy FROM {ev} e JOIN bad ON e.`user` = bad.`user` WHERE e.event = 'purchase' GROUP BY e.`user`, bad.n")
sql("union_signals", "SELECT sign, count(*) AS n FROM (SELECT 'a' AS sign FROM {ev} WHERE event = 'error' UNION ALL SELECT 'b' AS sign FROM {ev} WHERE bytes > 50 UNION ALL SELECT 'c' AS sign FROM {ev} WHERE severity = 'info') GROUP BY sign")
sql("semi_labels", "SELECT doc_id, lang FROM {documents} WHERE EXISTS (SELECT 1 FROM {labels} l WHERE l.doc_id = {documents}.doc_id AND l.toxic = 1)".replace("{documents}.doc_id", "d.doc_id").replace("FROM {documents} WHERE", "FROM {documents} d WHERE"))
sql("anti_labels", "SELECT d.doc_id FROM {documents} d WHERE NOT EXISTS (SELECT 1 FROM {labels} l WHERE l.doc_id = d.doc_id)")

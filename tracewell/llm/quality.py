"""Quality rules by host; DataFrame functions only.

Each document is measured in its own row and put to several rules: the base rule, and softer ones (RULES) that a good
document may fail by chance. Failures of each rule are counted by host (a map-side aggregate, so a host with a third of
all rows is no hot key), and each host's failure rate is shrunk towards a beta prior that is fitted for the rule to all
hosts by the method of moments: small hosts are judged by the prior, large ones by their own record.

The prior sets the limit, too: a host is bad by a rule if its shrunken rate lies LIMIT_DEVIATIONS deviations of the prior
above the prior's mean, so it stands out from the other hosts, or above HOST_LIMIT. Host verdicts are joined back to the
documents' ids, not to their texts. A document is rejected if it fails the base rule, if it fails a rule that its host is
bad by, or if its host fails the base rule more often than HOST_LIMIT. So documents that fail no rule stay, but for hosts
where most documents are bad.

The host of a document is its source. Defined cases: a null text has no words and fails for being short; a null source has
no host record and passes that part. A rate of exactly the limit passes. Texts of any length are read whole. Repeated rows
count as often as they occur. Extra columns of any name are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import persisted

WORD_GAP = r"[\x20\x09-\x0D]+"
WINDOW = 5
#: Hosts whose shrunken failure rate is above this are rejected.
HOST_LIMIT = 0.5
#: Deviations of the prior above its mean at which a host stands out.
LIMIT_DEVIATIONS = 3.0
#: Rules by name, as SQL over a document's measures: the base rule, then signs of boilerplate and junk.
RULES = {
    "base": "base_failed",
    "symbols": "10 * n_symbols > word_chars",
    "lines": "10 * n_dup_lines > 3 * n_lines",
    "repeats": "10 * n_repeat_words > n_words",
    "lengths": "word_chars > 12 * n_words OR word_chars < 2 * n_words",
}
#: The prior weighs between these numbers of documents.
LEAST_PRIOR, MOST_PRIOR = 2.0, 1000.0


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed for every row."""
    d = docs.select("doc_id", F.col("source").cast("string").alias("host"), F.coalesce(F.col("text"), F.lit("")).alias("t"))
    gap = " \t\n\x0b\x0c\r"
    d = d.select("doc_id", "host", "t", F.filter(F.split("t", WORD_GAP, -1), lambda x: x != "").alias("words"))
    lines = F.filter(F.split("t", "\n", -1), lambda x: F.translate(x, gap, "") != "")
    d = d.select(
        "doc_id",
        "host",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("t", gap, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    windows = F.when(F.size("h") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("h") - WINDOW), lambda i: F.xxhash64(*[F.get("h", i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
    d = d.select("doc_id", "host", "n_words", "word_chars", "n_symbols", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), windows.alias("w"))
    # equal windows stand together once sorted; most texts have none and skip that
    same = F.size(F.array_distinct("w")) < F.size("w")
    ordered = F.when(same, F.sort_array(F.transform("w", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))).otherwise(F.array().cast("array<struct<x:bigint,i:int>>"))
    d = d.select("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", ordered.alias("o"))
    again = F.sort_array(
        F.transform(
            F.filter("o", lambda e, k: F.coalesce((F.get("o", k - 1)["x"] == e["x"]) & (k > 0), F.lit(False)) | F.coalesce(F.get("o", k + 1)["x"] == e["x"], F.lit(False))),
            lambda e: e["i"],
        )
    )
    d = d.select("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", again.alias("p"))
    # each repeated window covers its words up to the next repeated window
    covered = F.aggregate(F.transform("p", lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get("p", k + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    d = d.select("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", covered.cast("long").alias("n_repeat_words"))
    return d.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def host_rates(measures: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """host, n, and for each rule: failed_, rate_ (shrunk) and bad_; host_failed: the base rate is above limit."""
    failed = [F.sum(F.expr(x).cast("long")).alias(f"failed_{r}") for r, x in RULES.items()]
    hosts = measures.where(F.col("host").isNotNull()).groupBy("host").agg(F.count("*").alias("n"), *failed)
    # beta prior by moments: mean of all documents, variance of the hosts' rates beyond what counting alone gives
    moments = [x for r in RULES for x in (F.sum(f"failed_{r}").alias(f"f_{r}"), F.var_pop(F.col(f"failed_{r}") / F.col("n")).alias(f"v_{r}"))]
    m = hosts.agg(F.sum("n").alias("d"), F.avg(1 / F.col("n")).alias("inv"), *moments).first()  # one row
    out = hosts
    for r in RULES:
        mean = m[f"f_{r}"] / m["d"] if m["d"] else 0.0
        spread = mean * (1 - mean)
        beyond = max((m[f"v_{r}"] or 0.0) - spread * (m["inv"] or 0.0), 0.0)
        weight = MOST_PRIOR if beyond <= 0 else min(MOST_PRIOR, max(LEAST_PRIOR, spread / beyond - 1))
        most = min(limit, mean + LIMIT_DEVIATIONS * math.sqrt(spread / (weight + 1)))
        rate = (F.col(f"failed_{r}") + F.lit(mean * weight)) / (F.col("n") + F.lit(float(weight)))
        out = out.withColumn(f"rate_{r}", rate).withColumn(f"bad_{r}", F.col(f"rate_{r}") > most)
    return out.withColumn("host_failed", F.col("rate_base") > limit)


def judged(docs: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept for every row."""
    measures = persisted(measured(docs), "quality")
    verdicts = host_rates(measures, limit).select("host", "host_failed", *[f"bad_{r}" for r in RULES])
    out = measures.join(verdicts, "host", "left")
    rejected = F.col("base_failed") | F.coalesce(F.col("host_failed"), F.lit(False))
    for r, x in RULES.items():
        rejected = rejected | (F.coalesce(F.col(f"bad_{r}"), F.lit(False)) & F.expr(x))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~rejected).alias("kept"))


def oracle_sql(limit: float = HOST_LIMIT) -> str:
    """The same result in DuckDB, by exploding words and windows."""
    gap = "[\\x20\\x09-\\x0D]"
    counted = ", ".join(f"sum(CAST({x} AS INT)) AS f_{r}" for r, x in RULES.items())
    moments = ", ".join(f"coalesce(sum(f_{r}) / sum(n), 0.0) AS m_{r}, coalesce(var_pop(f_{r} / n), 0.0) AS v_{r}" for r in RULES)
    beyond = {r: f"greatest(v_{r} - m_{r} * (1 - m_{r}) * inv, 0.0)" for r in RULES}
    weights = "SELECT *, " + ", ".join(f"CASE WHEN {b} <= 0 THEN {MOST_PRIOR} ELSE least({MOST_PRIOR}, greatest({LEAST_PRIOR}, m_{r} * (1 - m_{r}) / {b} - 1)) END AS w_{r}" for r, b in beyond.items()) + " FROM p"
    rate = {r: f"(f_{r} + m_{r} * w_{r}) / (n + w_{r})" for r in RULES}
    verdicts = ", ".join(f"{rate[r]} > least({limit}, m_{r} + {LIMIT_DEVIATIONS} * sqrt(m_{r} * (1 - m_{r}) / (w_{r} + 1))) AS bad_{r}" for r in RULES) + f", {rate['base']} > {limit} AS host_failed"
    rejected = " OR ".join(f"(coalesce(bad_{r}, false) AND ({x}))" for r, x in RULES.items())
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, CAST(source AS VARCHAR) AS host, coalesce(text, '') AS t FROM documents),
w AS MATERIALIZED (SELECT r, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
x AS (SELECT r, i, array_to_string(ws[i:i+4], ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
y AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM x) WHERE n > 1),
z AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM y, (SELECT unnest(range(0, 5)) AS k) GROUP BY r),
l AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
m AS MATERIALIZED (
  SELECT d.doc_id, d.host, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(len(regexp_replace(d.t, '{gap}+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(len(d.t) - len(regexp_replace(d.t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(l.n_lines, 0) AS n_lines, CAST(coalesce(l.n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(z.n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    len(w.ws) < 10 OR 100 * coalesce(z.n_repeat_words, 0) > 20 * len(w.ws) AS base_failed
  FROM d JOIN w USING (r) LEFT JOIN z USING (r) LEFT JOIN l USING (r)),
h AS (SELECT host, count(*) AS n, {counted} FROM m WHERE host IS NOT NULL GROUP BY host),
p AS (SELECT avg(1 / n) AS inv, {moments} FROM h),
v AS (SELECT host, {verdicts} FROM h, ({weights}))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR coalesce(host_failed, false) OR {rejected}) AS kept
FROM m LEFT JOIN v USING (host)"""

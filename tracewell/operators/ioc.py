"""Indicators of compromise: extraction, classes, roll-up and sweeps."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell.functions.columns import IPV4, _hex6, ip_class
from tracewell.functions.tables import bounded_batches

#: Top-level domains that count besides those of two letters, and file extensions that never do.
GTLDS = "com net org info biz gov edu mil int name pro mobi asia tel io co ai app dev xyz online site top club shop store tech cloud live icu vip work link click download host space website email fun life world today news blog page run zip mov cc tv me su pw cyou sbs lol monster quest rest cfd bond digital agency solutions services network systems group team center"
FILE_EXTENSIONS = "sh py pl rb ps1 bat cmd vbs js jse wsf exe dll sys so bin dat db log conf cfg ini txt md yml yaml json xml csv tsv html htm css png jpg jpeg gif svg ico pdf doc docx xls xlsx ppt pptx zip tar gz tgz bz2 xz rar 7z iso img tmp bak old swp lock pid sock key pem crt cer php asp aspx jsp jar war class o a ko map lnk url reg"

#: Hosts of schemas that every document of some formats names, and what may stand at the end of a URL in a sentence.
NO_HOSTS = "schemas.microsoft.com schemas.xmlsoap.org www.w3.org schemas.openxmlformats.org"
URL_END = """.,);]}"'>"""

#: What indicators look like; group 1 is the indicator.
URL = r"""(?i)\b(?:https?|ftps?)://[^\s"'`<>\]\[{}|\\^]+"""
PATTERNS = {
    "ipv4": r"(?<![\w.])(\d{1,3}(?:\.\d{1,3}){3})(?![\w.])",
    "ipv6": r"(?<![\w:.])([A-Fa-f0-9]{0,4}(?::[A-Fa-f0-9]{0,4}){2,7})(?![\w:.])",
    "email": r"(?<![\w.+\-])([A-Za-z0-9._%+\-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24})(?![\w.\-])",
    "domain": r"(?<![\w@.\-/])((?:[A-Za-z0-9](?:[A-Za-z0-9\-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24})(?![\w\-])",
    "unixpath": r"(?<![\w])(/(?:[\w.@\-]+/)+[\w.@\-]+)",
    "winpath": r"""(?<![\w])([A-Za-z]:\\(?:[^\\/:*?"<>|\s]+\\?)+)""",
    "registry": r"""(?i)(?<![\w])((?:HK(?:LM|CU|U|CR|CC)|HKEY_[A-Z_]+)\\[^\s"'`<>|?*]+)""",
    "pipe": r"""(?i)(\\\\[.\w\-]+\\pipe\\[^\s"'`<>|?*]+|\\pipe\\[\w.\-{}]+)""",
    "imphash": r"(?i)IMPHASH=([A-Fa-f0-9]{32})",
    "md5": r"(?<![\w])([A-Fa-f0-9]{32})(?![\w])",
    "sha1": r"(?<![\w])([A-Fa-f0-9]{40})(?![\w])",
    "sha256": r"(?<![\w])([A-Fa-f0-9]{64})(?![\w])",
}
#: Fields of audit records that hold hex text which is no hash.
HEX_FIELD = r"(?i)\b(?:saddr|proctitle|a\d+|cwd|exe)=[0-9a-f]{8,}\b"
#: Types as they are shown, in order.
LABELS = {
    "ipv4": "IPv4",
    "ipv6": "IPv6",
    "domain": "Domains",
    "url": "URLs",
    "email": "Emails",
    "useragent": "User agents",
    "sha256": "SHA256",
    "sha1": "SHA1",
    "md5": "MD5",
    "imphash": "Imphash",
    "filepath": "File paths",
    "registry": "Registry keys",
    "pipe": "Named pipes",
    "service": "Services",
    "task": "Scheduled tasks",
}


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def valid_domain(d: Column) -> Column:
    """A name whose last part is a country or a known top-level domain and no file extension, and that says something."""
    top = F.substring_index(d, ".", -1)
    registered = top.rlike("^[a-z]{2}$") | top.isin(*GTLDS.split())
    return d.contains(".") & registered & ~top.isin(*FILE_EXTENSIONS.split()) & ~d.isin(*NO_HOSTS.split()) & (F.length(d) <= 253)


def valid_ipv4(ip: Column) -> Column:
    return ip.rlike(IPV4) & ~ip.rlike(r"^(?:0\.0\.0\.0|255\.255\.255\.255|2[45]\d\..*)$")


def compressed_ipv6(candidates: Column) -> Column:
    """The valid ones of an array of addresses, in the short form: zeros at the front of a group are dropped, the first longest run of two or more zero groups becomes ::."""

    def one(x: Column) -> Column:
        digits = _hex6(x)
        groups = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.regexp_replace(F.substring(digits, i * 4 + 1, F.lit(4)), "^0{1,3}", ""))
        text = F.concat(F.lit(":"), F.array_join(groups, ":"), F.lit(":"))
        out = F.substring(text, 2, F.length(text) - 2)
        for n in range(2, 9):  # the longest run is the last to be tried
            run = ":" + "0:" * n
            at = F.instr(text, run)
            short = F.concat(F.substring(text, F.lit(1), at - 1), F.lit("::"), F.substring(text, at + len(run), F.length(text)))
            trimmed = F.regexp_replace(F.regexp_replace(short, "^:(?!:)", ""), "(?<!:):$", "")
            out = F.when(at > 0, trimmed).otherwise(out)
        return F.when(digits.isNotNull() & (digits != "0" * 32), out)

    return F.array_compact(F.transform(candidates, one))


def extracted(events: DataFrame, text: Column, hash_text: Column | None = None, user_agent: Column | None = None, ipv6: bool = True, windows: bool = False, import_hash_twice: bool = True) -> DataFrame:
    """id, ts, type, value: each indicator once for each event; URLs are blanked before the other scans. windows: registry keys and pipes too; import_hash_twice: what stands as an import hash is an MD5, too."""
    clean = F.coalesce(text, F.lit(""))
    d = events.select("id", "ts", clean.alias("_t"), F.regexp_replace(F.coalesce(hash_text if hash_text is not None else text, F.lit("")), HEX_FIELD, " ").alias("_h"), (user_agent if user_agent is not None else F.lit(None).cast("string")).alias("_ua"))
    urls = F.filter(F.transform(_all("_t", f"({URL})"), lambda u: F.rtrim(u, F.lit(URL_END))), lambda u: F.length(u) > 8)
    d = d.withColumn("_u", urls).withColumn("_t", F.regexp_replace("_t", URL, " "))
    hosts = F.filter(F.transform("_u", lambda u: F.lower(F.regexp_extract(u, r"^[A-Za-z]+://(?:[^/@]*@)?([^/:?#]+)", 1))), lambda h: h != "")
    d = d.withColumn("_hosts", hosts)
    found = {
        "url": F.col("_u"),
        "ipv4": F.filter(F.concat(_all("_t", PATTERNS["ipv4"]), F.col("_hosts")), valid_ipv4),
        "email": F.filter(F.transform(_all("_t", PATTERNS["email"]), F.lower), lambda e: valid_domain(F.substring_index(e, "@", -1))),
        "domain": F.filter(F.concat(F.transform(_all("_t", PATTERNS["domain"]), F.lower), F.col("_hosts")), lambda h: valid_domain(h) & ~h.rlike(IPV4)),
        "unixpath": _all("_t", PATTERNS["unixpath"]),
        "winpath": _all("_t", PATTERNS["winpath"]),
        "useragent": F.when(F.col("_ua").isNotNull() & ~F.col("_ua").isin("", "-"), F.array("_ua")).otherwise(F.array().cast("array<string>")),
    } | {k: F.transform(_all("_h", PATTERNS[k]), F.lower) for k in ("md5", "sha1", "sha256")}
    found["imphash"] = F.transform(_all("_h", PATTERNS["imphash"]), F.lower)
    if not import_hash_twice:
        found["md5"] = F.filter(found["md5"], lambda x: ~F.array_contains(found["imphash"], x))
    if windows:
        found |= {k: _all("_t", PATTERNS[k]) for k in ("registry", "pipe")}
    if ipv6:
        maybe = F.when(F.col("_t").contains("::") | F.col("_t").rlike("[A-Fa-f0-9]:[A-Fa-f0-9]"), _all("_t", PATTERNS["ipv6"])).otherwise(F.array().cast("array<string>"))
        d = d.withColumn("_m6", maybe)
        found["ipv6"] = F.when(F.size("_m6") > 0, compressed_ipv6(F.col("_m6"))).otherwise(F.array().cast("array<string>"))
    pairs = F.array_distinct(F.concat(*[F.transform(v, _typed(k)) for k, v in found.items()]))
    return d.select("id", "ts", F.inline(pairs))


def _typed(kind: str):
    return lambda x: F.struct(F.lit(kind).alias("type"), x.alias("value"))


def rolled_up(found: DataFrame, per_type: int = 400) -> DataFrame:
    """type, value, n (events), first_id, first_ts, class: the commonest of each type."""
    n = found.groupBy("type", "value").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.min_by("ts", "id").alias("first_ts"))
    rank = F.row_number().over(Window.partitionBy("type").orderBy(F.desc("n"), "value"))
    return n.withColumn("_r", rank).where(F.col("_r") <= per_type).drop("_r").withColumn("class", F.when(F.col("type").isin("ipv4", "ipv6"), ip_class(F.col("value"))))


def shown_type(kind: Column) -> Column:
    """Paths of either system are shown as file paths."""
    return F.when(kind.isin("unixpath", "winpath"), "filepath").otherwise(kind)


def place(kind: Column) -> Column:
    """Position of a type among those shown, from 1; null for others."""
    return F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(LABELS, 1) for x in (k, i)]), shown_type(kind))


def totals(found: DataFrame) -> DataFrame:
    """place, type, label, total (its different values), grand_total: a row for each shown type that occurs, in order."""
    n = found.select(shown_type(F.col("type")).alias("type"), "value").distinct().groupBy("type").agg(F.count("*").alias("total"))
    label = F.element_at(F.create_map(*[F.lit(x) for k, v in LABELS.items() for x in (k, v)]), F.col("type"))
    n = n.select(place(F.col("type")).alias("place"), "type", label.alias("label"), "total")
    # at most a row for each type
    return n.withColumn("grand_total", F.sum("total").over(Window.partitionBy())).orderBy("place")


def grouped(found: DataFrame, per_type: int = 400) -> DataFrame:
    """rolled_up by shown types, in their order: the commonest values of each, with its label, its total and the grand total."""
    merged = found.withColumn("type", shown_type(F.col("type")))
    out = rolled_up(merged, per_type).join(F.broadcast(totals(found)), "type")
    return out.orderBy("place", F.desc("n"), "value")


#: Up to this many indicators are looked for one by one; more by one automaton.
FEW_INDICATORS = 32
#: Hits of a batch that a sweep hands on.
OUT_ROWS = 10_000


def sweep(events: DataFrame, text: Column, indicators: list[str]) -> DataFrame:
    """indicator, id, ts of events whose text contains an indicator, case-insensitively: one pass, whatever the number of indicators.

    A few indicators are compared by built-in functions; a longer list becomes an Aho-Corasick automaton in each task.
    """
    wanted = list(dict.fromkeys(i for i in (x.strip() for x in indicators) if i))
    if not wanted:
        return events.select(F.lit("").alias("indicator"), "id", "ts").limit(0)
    lowered = events.select("id", "ts", F.lower(F.coalesce(text, F.lit(""))).alias("_text"))
    if len(wanted) <= FEW_INDICATORS:
        some = F.array(*[F.struct(F.lit(w).alias("shown"), F.lit(w.lower()).alias("low")) for w in wanted])
        return lowered.select(F.explode(F.filter(some, lambda i: F.contains(F.col("_text"), i["low"]))).alias("_i"), "id", "ts").select(F.col("_i.shown").alias("indicator"), "id", "ts")
    bounded_batches(events.sparkSession)
    shown: dict[str, list[str]] = {}
    for w in wanted:
        shown.setdefault(w.lower(), []).append(w)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for low in shown:
            automaton.add_word(low, low)
        automaton.make_automaton()
        for b in batches:
            names, rows = [], []

            def hits() -> pa.RecordBatch:
                at = pa.array(rows, pa.int64())
                return pa.record_batch([pa.array(names, pa.string()), b.column("id").take(at), b.column("ts").take(at)], names=["indicator", "id", "ts"])

            for k, t in enumerate(b.column("_text")):
                for low in {v for _, v in automaton.iter(t.as_py())}:
                    names += shown[low]
                    rows += [k] * len(shown[low])
                if len(rows) >= OUT_ROWS:
                    yield hits()
                    names, rows = [], []
            yield hits()

    kinds = {c: lowered.schema[c].dataType.simpleString() for c in ("id", "ts")}
    return lowered.mapInArrow(search, f"indicator string, id {kinds['id']}, ts {kinds['ts']}")


def sweep_summary(found: DataFrame, samples: int = 50) -> DataFrame:
    """indicator, n, sample_ids"""
    rank = F.row_number().over(Window.partitionBy("indicator").orderBy(F.col("ts").asc_nulls_last(), "id"))
    first = found.withColumn("_r", rank).where(F.col("_r") <= samples).groupBy("indicator").agg(F.array_sort(F.collect_list(F.struct("_r", "id"))).alias("s"))
    n = found.groupBy("indicator").agg(F.count("*").alias("n"))
    return n.join(first, "indicator").select("indicator", "n", F.transform("s", lambda x: x["id"]).alias("sample_ids"))

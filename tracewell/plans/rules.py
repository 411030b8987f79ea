"""Detection rules: YAML -> rule -> Column; all rules of a set run in one scan, large sets by an index of the texts they need."""

from __future__ import annotations

import base64
import ipaddress
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell.functions.columns import extra, in_cidr, like_escape
from tracewell.functions.tables import persisted
from tracewell.schema import COLUMNS as EVENT_COLUMNS


class RuleError(ValueError):
    """A rule that cannot be applied; the message says why."""


@dataclass
class Rule:
    title: str
    detection: dict = field(default_factory=dict)
    logsource: dict = field(default_factory=dict)
    id: str = ""
    name: str = ""
    level: str = "medium"
    tags: list[str] = field(default_factory=list)
    correlation: dict | None = None


LEVELS = ("critical", "high", "medium", "low", "informational")


def load_text(text: str) -> list[Rule]:
    out = []
    for doc in yaml.safe_load_all(text):
        if doc:
            out.append(Rule(str(doc.get("title", "")), doc.get("detection") or {}, doc.get("logsource") or {}, str(doc.get("id", "")), str(doc.get("name", "")), str(doc.get("level", "medium")), [str(t) for t in doc.get("tags") or []], doc.get("correlation")))
    return out


def load_dir(path: str) -> tuple[list[Rule], list[tuple[str, str]]]:
    """Rules of all .yml and .yaml files below path, and (file, error) of those that cannot be read."""
    rules, errors = [], []
    for f in sorted(p for p in Path(path).rglob("*") if p.suffix.lower() in (".yml", ".yaml")):
        try:
            rules += load_text(f.read_text(encoding="utf-8"))
        except (yaml.YAMLError, OSError, AttributeError) as e:
            errors.append((str(f), str(e)))
    return rules, errors


# fixed values: which events rules look at, and the log source they count to
def classify() -> tuple[Column, Column]:
    """(sigma_ok, sigma_logsource) of an event from source, event and program."""
    s, e, p = (F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("source", "event", "program"))
    key = (
        F.when((s == "auth") & p.startswith("sshd"), "linux/sshd")
        .when((s == "auth") & (p == "sudo"), "linux/sudo")
        .when(s == "auth", "linux/auth")
        .when((s == "auditd") & (e == "execve"), "linux/process_creation")
        .when(s == "auditd", "linux/auditd")
        .when(s == "cron", "linux/cron")
        .when(s.isin("syslog", "kern"), "linux/syslog")
        .when(s == "access", "webserver")
        .when(s == "weberror", "linux/modsecurity")
    )
    return key.isNotNull().cast("int"), key


def _program(prefix: str, *sources: str) -> Column:
    return F.col("source").isin(*sources) & F.lower("program").like(prefix + "%")


#: Which events feed a log source.
LOGSOURCES: dict[str, Callable[[], Column]] = {
    "linux/process_creation": lambda: (F.col("source") == "auditd") & (F.col("event") == "execve"),
    "linux/sysmon": lambda: (F.col("source") == "auditd") & (F.col("event") == "execve"),
    "linux/network_connection": lambda: (F.col("source") == "auditd") & extra("dst_ip").isNotNull(),
    "linux/file_event": lambda: (F.col("source") == "auditd") & F.col("event").isin("path", "openat", "open", "create", "unlink"),
    "linux/auditd": lambda: F.col("source") == "auditd",
    "linux/auth": lambda: F.col("source") == "auth",
    "linux/sshd": lambda: _program("sshd", "auth"),
    "linux/sudo": lambda: (F.col("source") == "auth") & ((F.lower("program") == "sudo") | F.col("raw").contains("sudo:")),
    "linux/cron": lambda: (F.col("source") == "cron") | _program("cron", "syslog"),
    "linux/syslog": lambda: F.col("source").isin("syslog", "kern"),
    "linux/clamav": lambda: _program("clam", "syslog", "kern") | (F.col("source") == "clamav"),
    "linux/vsftpd": lambda: _program("vsftpd", "syslog"),
    "linux/guacamole": lambda: _program("guac", "syslog"),
    "linux/modsecurity": lambda: F.col("source") == "weberror",
    "webserver": lambda: F.col("source") == "access",
    "linux": lambda: F.col("source").isin("auth", "auditd", "syslog", "kern", "cron"),
    "application": lambda: F.col("source") == "app",
}


#: Which log source a rule's product, category and service select, in order; * is anything, - is nothing.
ROUTES = (
    ("*", "webserver", "*", "webserver"),
    ("apache", "*", "*", "webserver"),
    ("nginx", "*", "*", "webserver"),
    ("iis", "*", "*", "webserver"),
    ("*", "*", "apache", "webserver"),
    ("*", "*", "nginx", "webserver"),
    ("modsecurity", "*", "*", "linux/modsecurity"),
    ("*", "*", "modsecurity", "linux/modsecurity"),
    ("-", "application", "*", "application"),
    *(("linux", k.removeprefix("linux/"), "*", k) for k in LOGSOURCES if "/" in k),
    *(("linux", "-", k.removeprefix("linux/"), k) for k in LOGSOURCES if "/" in k),
    ("linux", "*", "*", "linux"),
)


def logsource_key(logsource: dict) -> str | None:
    """Key of LOGSOURCES, or None where a rule is for other systems."""
    asked = [str(logsource.get(k) or "-").lower() for k in ("product", "category", "service")]
    return next((r[3] for r in ROUTES if all(w in ("*", x) for w, x in zip(r[:3], asked, strict=True))), None)


def _command() -> Column:
    return F.coalesce(F.when(F.col("message") != "", F.col("message")), F.col("exe"))


#: Columns by rule field: for all, for processes, for web requests; the rest is looked up in extra.
_FIELDS = {"User": "user", "user": "user", "exe": "exe", "Image": "exe", "pid": "pid", "host": "host", "hostname": "host", "program": "program", "process": "program", "src_ip": "src_ip", "SourceIp": "src_ip", "event": "event", "severity": "severity", "bytes": "bytes", "message": "message"}
_WEB_FIELDS = {"c-ip": "src_ip", "cs-method": "method", "sc-status": "status", "sc-bytes": "bytes", "cs-bytes": "bytes", "cs-host": "host", "cs-user-agent": "user_agent", "cs-referer": "referer"} | {k: "path" for k in ("cs-uri", "cs-uri-stem", "cs-uri-query", "c-uri", "c-uri-query", "cs-uri-stem-query")}
_EXTRA_FIELDS = {"DestinationIp": "dst_ip", "DestinationPort": "dst_port"}
_PROCESS_EXTRA = {"ParentImage": "parent_exe", "CurrentDirectory": "cwd", "DestinationHostname": "dst_ip"}


def resolve(key: str, name: str) -> Column:
    if name == "type":
        return F.upper("event")
    if name == "CommandLine":
        return _command()
    if key == "webserver" and (name in _WEB_FIELDS or name.lower() in ("cs-user-agent", "cs-referer")):
        return F.col(_WEB_FIELDS.get(name) or _WEB_FIELDS[name.lower()])
    if key == "linux/process_creation":
        if name in _PROCESS_EXTRA:
            return extra(_PROCESS_EXTRA[name])
        if name in ("ParentCommandLine", "LogonId"):
            return F.lit(None).cast("string")
    if name in _EXTRA_FIELDS:
        return extra(_EXTRA_FIELDS[name])
    if name in _FIELDS:
        return F.col(f"`{_FIELDS[name]}`")
    safe = re.sub(r"[^\w.\-]", "", name)
    return extra(safe) if safe else F.lit(None).cast("string")


def like_of(value: str) -> str:
    """Wildcards * and ? as LIKE; a backslash before one of them makes it plain."""
    out, i = [], 0
    while i < len(value):
        c = value[i]
        if c == "\\" and i + 1 < len(value) and value[i + 1] in "*?\\":
            out.append(like_escape(value[i + 1]))
            i += 1
        else:
            out.append({"*": "%", "?": "_"}.get(c) or like_escape(c))
        i += 1
    return "".join(out)


def _offsets(text: str) -> list[str]:
    """Base64 forms of a text at the three offsets, without what depends on its neighbours."""
    raw = text.encode()
    return [base64.b64encode(b" " * i + raw).decode()[(0, 2, 3)[i] : (None, -3, -2)[(len(raw) + i) % 3]] for i in range(3)]


def _value(column: Column, value, mods: list[str], key: str) -> Column:
    text = column.cast("string")
    if "exists" in mods:
        return text.isNotNull() if value else text.isNull()
    if value is None:
        return text.isNull()
    if "fieldref" in mods:
        other = resolve(key, str(value)).cast("string")
        for m, f in (("startswith", text.startswith), ("endswith", text.endswith), ("contains", text.contains)):
            if m in mods:
                return f(other)
        return text == other
    if isinstance(value, bool):
        yes = ("true", "1", "yes", "enabled")
        return F.lower(text).isin(*yes) if value else F.lower(text).isin("false", "0", "no", "disabled")
    for m, op in (("lte", "__le__"), ("lt", "__lt__"), ("gte", "__ge__"), ("gt", "__gt__")):
        if m in mods:
            return getattr(text.try_cast("double"), op)(float(value))
    if "cidr" in mods:
        net = ipaddress.ip_network(str(value), strict=False)
        return in_cidr(text, str(value)) if net.version == 4 else in_cidr6(text, str(value))
    if "re" in mods:
        flags = "".join(f for f in "ims" if f in mods)
        return text.rlike((f"(?{flags}u)" if flags else "") + str(value))
    if isinstance(value, (int, float)) and not {"contains", "startswith", "endswith"} & set(mods):
        return text == str(value)
    many = [str(value)]
    if "base64" in mods:
        many = [base64.b64encode(v.encode()).decode() for v in many]
    if "base64offset" in mods:
        many = [o for v in many for o in _offsets(v)]
    if "windash" in mods:
        many = [re.sub(r"(^|\s)[-/–—―]", lambda m, d=d: m[1] + d, v, count=1) for v in many for d in "-/–—―"]
    out = None
    for v in many:
        like = like_of(v)
        like = ("%" if {"contains", "endswith"} & set(mods) else "") + like + ("%" if {"contains", "startswith"} & set(mods) else "")
        p = text.like(like) if "cased" in mods else text.ilike(like)
        out = p if out is None else out | p
    return out


def in_cidr6(text: Column, cidr: str) -> Column:
    """IPv6 membership needs address parsing that the JVM side lacks: an Arrow UDF over candidates only."""
    net = ipaddress.ip_network(cidr, strict=False)

    @F.pandas_udf("boolean")
    def inside(s: pd.Series) -> pd.Series:
        def one(x: str | None) -> bool:
            try:
                return x is not None and ipaddress.ip_address(x) in net
            except ValueError:
                return False

        return s.map(one)

    return F.when(text.contains(":"), inside(text)).otherwise(F.lit(False))


def _all_of(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def _any_of(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out | p
    return out


def _keyword(value) -> Column:
    if value is None:
        return F.lit(True)
    text = str(value)
    like = like_of(text) if re.search(r"[*?]", text) else f"%{like_escape(text)}%"
    return F.col("raw").ilike(like) | F.col("message").ilike(like)


def selection(body, key: str) -> Column:
    """A map is AND over its fields, a list OR over its items; plain items are keywords."""
    if isinstance(body, dict):
        parts = []
        for name, values in body.items():
            field_name, *mods = str(name).split("|")
            values = values if isinstance(values, list) else [values]
            if not values:
                raise RuleError(f"no values for {name}")
            if not field_name:
                parts.append((_all_of if "all" in mods else _any_of)([_keyword(v) for v in values]))
                continue
            column = resolve(key, field_name)
            parts.append((_all_of if "all" in mods else _any_of)([_value(column, v, mods, key) for v in values]))
        if not parts:
            raise RuleError("empty selection")
        return _all_of(parts)
    if isinstance(body, list) and body:
        return _any_of([selection(x, key) if isinstance(x, (dict, list)) else _keyword(x) for x in body])
    if body is not None and not isinstance(body, list):
        return _keyword(body)
    raise RuleError("empty selection")


_CONDITION = re.compile(r"\(|\)|[^\s()]+")


def condition(text: str, parts: dict[str, Column]) -> Column:
    """and, or, not, parentheses, ``1 of x*``, ``all of them``. NOT is three-valued here: null stays null."""
    tokens, at = _CONDITION.findall(text), 0

    def peek() -> str:
        return tokens[at].lower() if at < len(tokens) else ""

    def take() -> str:
        nonlocal at
        if at >= len(tokens):
            raise RuleError(f"condition ends early: {text}")
        at += 1
        return tokens[at - 1]

    def either() -> Column:
        out = both()
        while peek() == "or":
            take()
            out = out | both()
        return out

    def both() -> Column:
        out = unary()
        while peek() == "and":
            take()
            out = out & unary()
        return out

    def unary() -> Column:
        if peek() == "not":
            take()
            return ~unary()
        t = take()
        if t == "(":
            out = either()
            if take() != ")":
                raise RuleError(f"missing ) in {text}")
            return out
        if t.lower() in ("1", "any", "all") and peek() == "of":
            take()
            pattern = take()
            names = [n for n in parts if not n.startswith("_")] if pattern.lower() == "them" else [n for n in parts if re.fullmatch(re.escape(pattern).replace(r"\*", ".*"), n)]
            if not names:
                raise RuleError(f"{pattern} names no selection")
            return (_all_of if t.lower() == "all" else _any_of)([parts[n] for n in names])
        if t not in parts:
            raise RuleError(f"no selection {t}")
        return parts[t]

    out = either()
    if at < len(tokens):
        raise RuleError(f"unexpected {tokens[at]} in {text}")
    return out


def predicate(rule: Rule) -> Column:
    """Whether an event is a hit, log source included."""
    key = logsource_key(rule.logsource)
    if key is None:
        raise RuleError("log source does not apply")
    if not rule.detection:
        raise RuleError("no detection")
    body = dict(rule.detection)
    text = body.pop("condition", None)
    body.pop("timeframe", None)
    if text is None:
        raise RuleError("no condition")
    parts = {k: selection(v, key) for k, v in body.items()}
    return LOGSOURCES[key]() & _any_of([condition(str(t), parts) for t in (text if isinstance(text, list) else [text])])


def split(rules: list[Rule]) -> tuple[list[tuple[Rule, Column]], list[tuple[Rule, str]]]:
    """Rules with their predicates, and skipped rules with the reason."""
    good, skipped = [], []
    for r in rules:
        if r.correlation:
            continue
        try:
            good.append((r, predicate(r)))
        except (RuleError, NotImplementedError, ValueError) as e:
            skipped.append((r, str(e)))
    return good, skipped


def applicability(events: DataFrame, rules: list[Rule]) -> DataFrame:
    """rule, level, log_source, events (that feed its log source), predicate, skipped (why it cannot run): one scan for all log sources."""
    keys = sorted({k for r in rules if not r.correlation and (k := logsource_key(r.logsource))})
    feeds = F.array(*[F.when(LOGSOURCES[k](), F.lit(k)) for k in keys]) if keys else F.array().cast("array<string>")
    n = events.select(F.explode(F.filter(feeds, lambda x: x.isNotNull())).alias("log_source")).groupBy("log_source").agg(F.count("*").alias("events"))
    good, skipped = split(rules)
    rows = [(r.title, r.level, logsource_key(r.logsource), str(p._jc) if hasattr(p, "_jc") else str(p), None) for r, p in good]
    rows += [(r.title, r.level, logsource_key(r.logsource), None, why) for r, why in skipped]
    listed = events.sparkSession.createDataFrame(rows, "rule string, level string, log_source string, predicate string, skipped string")
    return listed.join(n, "log_source", "left").select("rule", "level", "log_source", F.coalesce("events", F.lit(0)).alias("events"), "predicate", "skipped")


def key_of(rules: list[Rule]) -> dict[int, str]:
    """An id for each rule by its place: its own, its title where it has none, with a number where another rule has that, too."""
    out: dict[int, str] = {}
    for r in rules:
        name, n = r.id or r.title, 2
        while name in out.values():
            name, n = f"{r.id or r.title}#{n}", n + 1
        out[id(r)] = name
    return out


def _named(body) -> list[str]:
    """Fields that a selection names, in order."""
    if isinstance(body, dict):
        return [n for k in body if (n := str(k).split("|")[0])]
    return [n for x in body for n in _named(x)] if isinstance(body, list) else []


def matched(rule: Rule) -> Column:
    """What the fields that a rule names hold, as text."""
    names = dict.fromkeys(n for k, v in rule.detection.items() if k not in ("condition", "timeframe") for n in _named(v))
    key = logsource_key(rule.logsource)
    shown = [F.when(v.isNotNull() & (v != ""), F.concat(F.lit(f"{n}="), v)) for n in names for v in (resolve(key, n).cast("string"),)]
    return F.concat_ws(" · ", *shown) if shown else F.lit("")


@dataclass(frozen=True)
class Need:
    """Texts of which a row that is hit must hold at least one; none is named where anything may be hit."""

    texts: frozenset[str] | None = None

    def __and__(self, other: Need) -> Need:
        known = [x for x in (self, other) if x.texts is not None]
        # the rarer need is the one whose shortest text is longest
        return max(known, key=lambda x: (min(map(len, x.texts), default=0), -len(x.texts))) if known else Need()

    def __or__(self, other: Need) -> Need:
        return Need() if self.texts is None or other.texts is None else Need(self.texts | other.texts)

    def __invert__(self) -> Need:
        return Need()


#: Letters of a text that is looked for at least; its characters are those that stand for themselves in every column, JSON included.
LEAST_TEXT = 3
_PLAIN = re.compile(r"[a-z0-9 ._:=-]+")


def _need_of(likes: list[str]) -> Need:
    """The longest plain run of each pattern."""
    runs = [max(_PLAIN.findall(x.lower()), key=len, default="") for x in likes]
    return Need(frozenset(runs)) if runs and all(len(x) >= LEAST_TEXT for x in runs) else Need()


def _need_value(value, mods: list[str]) -> Need:
    if value is None or isinstance(value, (bool, int, float)) or {"exists", "fieldref", "cidr", "re", "lt", "lte", "gt", "gte"} & set(mods):
        return Need()
    many = [str(value)]
    if "base64" in mods:
        many = [base64.b64encode(v.encode()).decode() for v in many]
    if "base64offset" in mods:
        many = [o for v in many for o in _offsets(v)]
    # a dash of any kind may stand for the first one, and wildcards for anything
    return _need_of([re.sub(r"[*?\\]|(?:(?:^|\s)[-/–—―])", "\n", v) for v in many])


def _need(body) -> Need:
    """What a selection needs; the same tree as selection()."""
    if isinstance(body, dict):
        parts = []
        for name, values in body.items():
            _, *mods = str(name).split("|")
            values = values if isinstance(values, list) else [values]
            parts.append((_all_of if "all" in mods else _any_of)([_need_value(v, mods) for v in values]))
        return _all_of(parts)
    if isinstance(body, list):
        return _any_of([_need(x) if isinstance(x, (dict, list)) else _need_value(x, []) for x in body])
    return _need_value(body, [])


def needed(rule: Rule) -> Need:
    """What a row must hold for the rule to hit it, by the rule's own condition."""
    body = dict(rule.detection)
    text = body.pop("condition", None)
    body.pop("timeframe", None)
    parts = {k: _need(v) for k, v in body.items()}
    return _any_of([condition(str(t), parts) for t in (text if isinstance(text, list) else [text])])


#: Rules in one projection: its code stays small enough to be compiled, whatever the size of a set.
RULES_AT_ONCE = 100


def hits(events: DataFrame, rules: list[Rule]) -> DataFrame:
    """events with rule (title), rule_id and matched, a row for each hit.

    Up to RULES_AT_ONCE rules are one projection over one scan. A larger set is indexed: one automaton over the texts that
    its rules need tells for each row, in one scan, which groups of rules it may hit; the rows of each group are written to
    a folder of their own and meet that group's rules alone. Rules that need no text share further scans.
    """
    good, _ = split(rules)
    if not good:
        return events.withColumns({"rule": F.lit(""), "rule_id": F.lit(""), "matched": F.lit("")}).limit(0)
    ids, columns = key_of(rules), events.columns

    def marked(rows: DataFrame, some: list[tuple[Rule, Column]]) -> DataFrame:
        marks = F.array(*[F.when(p, F.struct(F.lit(r.title).alias("rule"), F.lit(ids[id(r)]).alias("rule_id"), matched(r).alias("matched"))) for r, p in some])
        return rows.withColumn("_hit", F.explode(F.filter(marks, lambda x: x.isNotNull()))).select(*columns, "_hit.*")

    def in_groups(some: list) -> list[list]:
        return [some[at : at + RULES_AT_ONCE] for at in range(0, len(some), RULES_AT_ONCE)]

    needs = {id(r): needed(r).texts for r, _ in good} if len(good) > RULES_AT_ONCE else {}
    indexed = sorted((x for x in good if needs.get(id(x[0]))), key=lambda x: (logsource_key(x[0].logsource), min(needs[id(x[0])])))
    if len(indexed) <= RULES_AT_ONCE:
        indexed = []
    chosen = {id(r) for r, _ in indexed}
    parts = [marked(events, group) for group in in_groups([x for x in good if id(x[0]) not in chosen])]
    if indexed:
        groups = in_groups(indexed)
        rows = events.withColumn("_group", F.explode(_groups_of(events, [{t for r, _ in g for t in needs[id(r)]} for g in groups])))
        rows = persisted(rows, "candidates", by="_group")
        parts += [marked(rows.where(F.col("_group") == k), group) for k, group in enumerate(groups)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _groups_of(events: DataFrame, texts: list[set[str]]) -> Column:
    """Numbers of the sets of which a row holds a text, by one pass over what the row says."""
    by_text: dict[str, list[int]] = {}
    for k, some in enumerate(texts):
        for t in some:
            by_text.setdefault(t, []).append(k)
    said = F.lower(F.concat_ws("\n", *[F.col(f"`{n}`").cast("string") for n, t in EVENT_COLUMNS if n in events.columns], _command()))

    @F.pandas_udf("array<int>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for t, groups in by_text.items():
            automaton.add_word(t, groups)
        automaton.make_automaton()
        every = list(range(len(texts)))

        def groups_of(x: str) -> list[int]:
            # letters may stand in JSON as escapes
            return every if "\\u" in x else sorted({g for _, groups in automaton.iter(x) for g in groups})

        for s in batches:
            yield s.map(groups_of)

    return found(said)


def findings(events: DataFrame, rules: list[Rule], samples: int = 200) -> DataFrame:
    """rule, level, n, sample_ids (the first by ts and id), what matched in each, and rule_id: a row for each rule with hits.

    Hits are narrow and written once, so the events are read once for counts and samples.
    """
    found = persisted(hits(events, rules).select("rule_id", "ts", "id", "matched"), "hits")
    rank = F.row_number().over(Window.partitionBy("rule_id").orderBy(F.col("ts").asc_nulls_last(), "id"))
    first = found.withColumn("_r", rank).where(F.col("_r") <= samples).groupBy("rule_id").agg(F.array_sort(F.collect_list(F.struct("_r", "id", "matched"))).alias("s"))
    n = found.groupBy("rule_id").agg(F.count("*").alias("n"))
    ids = key_of(rules)
    named = events.sparkSession.createDataFrame([(ids[id(r)], r.title, r.level) for r in rules], "rule_id string, rule string, level string")
    return n.join(first, "rule_id").join(F.broadcast(named), "rule_id").select("rule", "level", "n", F.transform("s", lambda x: x["id"]).alias("sample_ids"), F.transform("s", lambda x: x["matched"]).alias("matched"), "rule_id")


def level_rank(level: Column) -> Column:
    """0 for critical up to the number of levels for unknown ones."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, LEVELS)), F.lower(level)), F.lit(0)) - 1, F.lit(len(LEVELS)).cast("long"))


@dataclass
class Detection:
    """Findings by level and count, correlations by title, how many rules were applied, and those that were not, with the reason."""

    findings: DataFrame
    correlations: dict[str, DataFrame]
    applied: int
    skipped: list[tuple[Rule, str]]

    def total(self) -> int:
        return self.findings.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def detect(events: DataFrame, rules: list[Rule], samples: int = 200) -> Detection:
    good, skipped = split(rules)
    found = findings(events, rules, samples)
    correlations: dict[str, DataFrame] = {}
    for r in rules:
        if r.correlation:
            try:
                correlations[r.title] = correlate(events, rules, r)
            except (RuleError, KeyError) as e:
                skipped.append((r, str(e)))
    return Detection(found.orderBy(level_rank(F.col("level")), F.desc("n"), "rule_id"), correlations, len(good) + len(correlations), skipped)


def seconds(span: str) -> int:
    m = re.fullmatch(r"\s*(\d+)\s*([smhdwMy]?)\s*", str(span or ""))
    n = int(m[1]) * {"": 1, "s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800, "M": 2592000, "y": 31536000}[m[2]] if m else 0
    return n or 60


def correlate(events: DataFrame, rules: list[Rule], correlation: Rule, sliding: int = 0) -> DataFrame:
    """Groups and time buckets that meet a correlation: keys, start, n, first_id, first_ts, last_ts.

    Buckets are aligned to the epoch; a burst across a bucket's edge is missed unless sliding gives a step in seconds.
    """
    c = correlation.correlation
    base = [r for r in rules if not r.correlation and (r.name in c["rules"] or r.id in c["rules"] or r.title in c["rules"])]
    if len(base) < len(c["rules"]):
        raise RuleError("a base rule is missing")
    by, ids = list(c.get("group-by") or []), key_of(base)
    # fields mean what they mean in the log source of each rule; a rule that does not apply has no correlation
    sources = {ids[id(r)]: logsource_key(r.logsource) for r in base}
    if None in sources.values():
        raise RuleError("the log source of a base rule does not apply")

    def own(name: str) -> Column:
        out = F.lit(None).cast("string")
        for key in dict.fromkeys(sources.values()):
            out = F.when(F.col("rule_id").isin([k for k, v in sources.items() if v == key]), resolve(key, name).cast("string")).otherwise(out)
        return out

    found = hits(events, base).where("ts is not null")
    found = found.select("id", "ts", F.col("rule_id").alias("rule"), *[own(k).alias(f"by_{i}") for i, k in enumerate(by)], *([own(c["condition"]["field"]).alias("counted")] if c["type"] == "value_count" else []))
    keys = [f"by_{i}" for i in range(len(by))]  # null keys are a group like others
    length = f"{seconds(c.get('timespan'))} seconds"
    bucket = F.window("ts", length, f"{sliding} seconds") if sliding else F.window("ts", length)
    if c["type"] == "event_count":
        n = F.count("*")
    elif c["type"] == "value_count":
        n = F.countDistinct("counted")
    elif c["type"] in ("temporal", "temporal_ordered"):
        n = F.countDistinct("rule")
    else:
        raise RuleError(f"correlation type {c['type']}")
    out = found.groupBy(bucket.alias("w"), *keys).agg(n.alias("n"), F.min("id").alias("first_id"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    if c["type"].startswith("temporal"):
        out = out.where(F.col("n") >= len(base))
    else:
        for op, v in (c.get("condition") or {}).items():
            if op != "field":
                out = out.where({"gte": F.col("n") >= v, "gt": F.col("n") > v, "lte": F.col("n") <= v, "lt": F.col("n") < v, "eq": F.col("n") == v}[op])
    return out.select(*[F.col(f"by_{i}").alias(k) for i, k in enumerate(by)], F.col("w.start").alias("start"), "n", "first_id", "first_ts", "last_ts")


#: Tactics in the order of the matrix.
TACTICS = "reconnaissance resource-development initial-access execution persistence privilege-escalation defense-evasion credential-access discovery lateral-movement collection command-and-control exfiltration impact".split()


def matrix(found: DataFrame, rules: list[Rule], correlations: dict[str, DataFrame] | None = None, samples: int = 10) -> DataFrame:
    """tactic, technique, n, rules, level (the worst), sample_ids: hits and correlated groups rolled up by the rules' tags; a technique without a tactic is under other."""
    ids, rows = key_of(rules), []
    for r in rules:
        tags = [t.lower().removeprefix("attack.").replace("_", "-") for t in r.tags if t.lower().startswith("attack.")]
        tactics = [t for t in tags if t in TACTICS] or ["other"]
        rows += [(ids[id(r)], a, t.upper()) for a in tactics for t in tags if re.fullmatch(r"t\d{4}(\.\d{3})?", t)]
    spark = found.sparkSession
    tags = spark.createDataFrame(rows or [("", "", "")], "rule_id string, tactic string, technique string")
    all_ = found.select("rule_id", "rule", "level", "n", "sample_ids")
    for r in rules:
        if correlations and r.title in correlations:
            one = correlations[r.title].agg(F.sum("n").cast("long").alias("n"), F.slice(F.array_sort(F.collect_set("first_id")), 1, samples).alias("sample_ids")).where("n is not null")
            all_ = all_.unionByName(one.select(F.lit(ids[id(r)]).alias("rule_id"), F.lit(r.title).alias("rule"), F.lit(r.level).alias("level"), "n", "sample_ids"))
    g = all_.join(F.broadcast(tags), "rule_id").groupBy("tactic", "technique")
    out = g.agg(F.sum("n").alias("n"), F.array_sort(F.collect_set("rule")).alias("rules"), F.min_by("level", level_rank(F.col("level"))).alias("level"), F.array_distinct(F.array_sort(F.flatten(F.collect_list(F.slice("sample_ids", 1, samples))))).alias("ids"))
    return out.select("tactic", "technique", "n", "rules", "level", F.slice("ids", 1, samples).alias("sample_ids"))

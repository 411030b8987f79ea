"""The search language: text -> tokens -> syntax tree -> Column."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.functions.columns import contains_ci, extra, glob_to_like, regex_text, search_text
from tracewell.schema import NUMERIC, TYPES


class QueryError(ValueError):
    """The query text cannot be understood."""


#: Other names of columns, normalised (lower case, without _ - . @).
ALIASES = {
    "ts": "time timestamp date",
    "src_ip": "ip sip srcip sourceip clientip client remoteip rhost addr",
    "src_port": "port sport dport sourceport",
    "program": "prog proc process service app",
    "message": "msg",
    "severity": "sev level priority",
    "user_agent": "ua",
    "path": "url uri request requesturi",
    "status": "code statuscode httpstatus",
    "bytes": "size length",
    "user": "username account acct",
    "host": "computer hostname",
    "line_no": "line",
    "event": "eventtype type",
}
_NAMES = {a: column for column, names in ALIASES.items() for a in names.split()}
EXTRA_PREFIXES = ("eventdata.", "event_data.", "extra.", "x:")
OPERATOR = re.compile(r"(==|!=|>=|<=|=|:|>|<)")
_WORDS = {"or": "OR", "||": "OR", "and": "AND", "&&": "AND", "not": "NOT", "!": "NOT"}


def normal_name(name: str) -> str:
    return re.sub(r"[_\-.@]", "", name.lower())


@dataclass(frozen=True)
class Field:
    name: str
    kind: str  # num, ts, text
    column: Column = field(compare=False)


class Fields:
    """Resolves names: alias, column, then known key of extra."""

    def __init__(self, extra_keys: Iterable[str] = ()):
        self.keys = {normal_name(k): k for k in extra_keys}

    def resolve(self, name: str) -> Field | None:
        low = name.lower()
        for p in EXTRA_PREFIXES:
            if low.startswith(p) and len(name) > len(p):
                key = name[len(p) :]
                key = self.keys.get(normal_name(key), key)
                return Field(key, "text", extra(key))
        n = normal_name(name)
        column = _NAMES.get(n) or next((c for c in TYPES if normal_name(c) == n), None)
        if column:
            return Field(column, "num" if column in NUMERIC else "ts" if column == "ts" else "text", F.col(f"`{column}`"))
        if n in self.keys:
            return Field(self.keys[n], "text", extra(self.keys[n]))
        return None


@dataclass(frozen=True)
class Token:
    kind: str  # ( ) OR AND NOT term
    text: str = ""
    literal: bool = False


def tokenize(query: str) -> list[Token]:
    out: list[Token] = []
    i, n = 0, len(query)
    while i < n:
        c = query[i]
        if c.isspace():
            i += 1
            continue
        if c in "()":
            out.append(Token(c))
            i += 1
            continue
        negated = c == "-" and i + 1 < n and not query[i + 1].isspace() and query[i + 1] != "("
        if negated:
            out.append(Token("NOT"))
            i += 1
        text, literal, regex = [], False, False
        start = i
        while i < n:
            c = query[i]
            at_value = i == start or query[i - 1] in ":="
            if c == "/" and at_value and not regex and query.find("/", i + 1) > 0:
                end = query.find("/", i + 1)
                text.append(query[i : end + 1])
                i, regex = end + 1, True
                continue
            if c in "\"'":
                end = query.find(c, i + 1)
                if end < 0:
                    raise QueryError(f"unclosed quote {c}")
                literal = literal or i == start
                text.append(query[i + 1 : end])
                i = end + 1
                continue
            if c.isspace() or c == ")" and (i + 1 >= n or query[i + 1].isspace() or query[i + 1] == ")"):
                break
            text.append(c)
            i += 1
        word = "".join(text)
        kind = _WORDS.get(word.lower()) if not literal and not negated else None
        out.append(Token(kind) if kind else Token("term", word, literal))
    return out


def merge_spaced(tokens: list[Token], fields: Fields) -> list[Token]:
    """``f = v``, ``f= v`` and ``f =v`` become one term if f is a field; ``f contains v`` for any name."""
    out: list[Token] = []
    i = 0

    def term(k: int) -> str | None:
        return tokens[k].text if k < len(tokens) and tokens[k].kind == "term" else None

    while i < len(tokens):
        t = tokens[i]
        a, b, c = term(i), term(i + 1), term(i + 2)
        if t.kind == "term" and not t.literal and a:
            if b and c is not None and b.lower() == "contains" and re.fullmatch(r"[\w.\-@:]+", a):
                out.append(Token("term", f"{a}:{c}"))
                i += 3
                continue
            if b and c is not None and OPERATOR.fullmatch(b) and fields.resolve(a):
                out.append(Token("term", f"{a}{b}{c}"))
                i += 3
                continue
            m = re.fullmatch(r"(.+?)(==|!=|>=|<=|=|:|>|<)", a)
            if m and b is not None and fields.resolve(m[1]):
                out.append(Token("term", a + b))
                i += 2
                continue
            if b and re.match(r"(==|!=|>=|<=|=|>|<).+", b) and fields.resolve(a):
                out.append(Token("term", a + b))
                i += 2
                continue
        out.append(t)
        i += 1
    return out


# syntax tree


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Not:
    part: object


@dataclass(frozen=True)
class Text:
    text: str
    literal: bool = False


@dataclass(frozen=True)
class Compare:
    field: Field
    op: str
    value: str


class Parser:
    def __init__(self, tokens: list[Token], fields: Fields):
        self.tokens, self.fields, self.at = tokens, fields, 0
        self.warnings: list[str] = []

    def peek(self) -> str:
        return self.tokens[self.at].kind if self.at < len(self.tokens) else ""

    def parse(self):
        if not self.tokens:
            raise QueryError("empty query")
        tree = self.either()
        if self.peek():
            raise QueryError(f"unexpected {self.peek()}")
        return tree

    def either(self):
        parts = [self.both()]
        while self.peek() == "OR":
            self.at += 1
            parts.append(self.both())
        return parts[0] if len(parts) == 1 else Or(tuple(parts))

    def both(self):
        parts = [self.negation()]
        while self.peek() in ("AND", "NOT", "(", "term"):
            if self.peek() == "AND":
                self.at += 1
                if self.peek() == "OR":  # AND OR is read as OR
                    break
            parts.append(self.negation())
        return parts[0] if len(parts) == 1 else And(tuple(parts))

    def negation(self):
        if self.peek() == "NOT":
            self.at += 1
            return Not(self.negation())
        return self.primary()

    def primary(self):
        kind = self.peek()
        if kind == "(":
            self.at += 1
            if self.peek() == ")":
                raise QueryError("empty ()")
            tree = self.either()
            if self.peek() != ")":
                raise QueryError("missing )")
            self.at += 1
            return tree
        if kind != "term":
            raise QueryError(f"unexpected {kind or 'end'}")
        t = self.tokens[self.at]
        self.at += 1
        return Text(t.text, True) if t.literal else self.term(t.text)

    def term(self, text: str):
        if text.startswith("/"):
            return Text(text)
        skip = 2 if text.lower().startswith("x:") else 0
        m = OPERATOR.search(text, skip)
        if not m or not m.start():
            return Text(text)
        name, op, value = text[: m.start()], m.group(), text[m.end() :]
        found = self.fields.resolve(name)
        if not found:
            if len(name) > 1 and not value.startswith(("\\", "/")) and not (op == ":" and not value):
                self.warnings.append(f"{name} is no field; searched as text")
            return Text(text)
        if value == "":
            raise QueryError(f"{name}{op} needs a value")
        if op == "!=":
            return Not(Compare(found, "=", value))
        return Compare(found, "=" if op == "==" else op, value)


def parse(query: str, fields: Fields | None = None):
    """(tree, warnings)"""
    fields = fields or Fields()
    p = Parser(merge_spaced(tokenize(query), fields), fields)
    return p.parse(), p.warnings


# lowering


def lower(tree) -> Column:
    """A negation keeps rows where its part is null: a null is no match."""
    if isinstance(tree, Or):
        out = lower(tree.parts[0])
        for p in tree.parts[1:]:
            out = out | lower(p)
        return out
    if isinstance(tree, And):
        out = lower(tree.parts[0])
        for p in tree.parts[1:]:
            out = out & lower(p)
        return out
    if isinstance(tree, Not):
        return ~F.coalesce(lower(tree.part), F.lit(False))
    if isinstance(tree, Text):
        return _text(tree)
    return _compare(tree)


def _is_regex(v: str) -> bool:
    return len(v) > 2 and v[0] == v[-1] == "/"


def _text(t: Text) -> Column:
    if t.literal:
        return contains_ci(search_text(), t.text)
    if _is_regex(t.text):
        return regex_text().rlike("(?iu)" + t.text[1:-1])
    inner = t.text.strip("*")
    if re.search(r"[*?]", inner):
        return search_text().ilike(f"%{glob_to_like(inner)}%")
    return contains_ci(search_text(), inner)


def _compare(c: Compare) -> Column:
    col, op, v = c.field.column, c.op, c.value
    as_text = col.cast("string")
    if op in (":", "="):
        if op == ":" and v == "*":
            return col.isNotNull() & (as_text != "")
        if op == ":" and v == "-" or op == "=" and v == "-" and c.field.kind != "text":
            return col.isNull() | (as_text == "")
        if op == ":" and _is_regex(v):
            return as_text.rlike("(?iu)" + v[1:-1])
    if c.field.kind == "num":
        return _number(c)
    if c.field.kind == "ts":
        return _time(c)
    if op == "=":
        return F.lower(as_text) == F.lit(v.lower())
    if op == ":":
        if re.search(r"[*?]", v):
            return as_text.ilike(glob_to_like(v))
        return contains_ci(as_text, v)
    low = F.lower(as_text)
    return {">": low > v.lower(), ">=": low >= v.lower(), "<": low < v.lower(), "<=": low <= v.lower()}[op]


def _number(c: Compare) -> Column:
    col, op, v = c.field.column, c.op, c.value
    if op in (":", "="):
        parts = [p.strip() for p in v.split(",")]
        if all(re.fullmatch(r"[+-]?\d+", p) for p in parts):
            numbers = [int(p) for p in parts]
            return col == numbers[0] if len(numbers) == 1 else col.isin(numbers)
        if op == ":" and re.search(r"[*?]", v):
            return col.cast("string").ilike(glob_to_like(v))
        return F.lower(col.cast("string")) == F.lit(v.lower())
    if not re.fullmatch(r"[+-]?\d+(?:\.\d+)?", v):
        raise QueryError(f"{c.field.name}{op} needs a number, not {v}")
    n = F.lit(float(v) if "." in v else int(v))
    return {">": col > n, ">=": col >= n, "<": col < n, "<=": col <= n}[op]


_PREFIX = re.compile(r"(\d{4})(?:-(\d{2})(?:-(\d{2})(?: (\d{2})(?::(\d{2})(?::(\d{2}))?)?)?)?)?")
_UNIT = ("year", "month", "day", "hour", "minute", "second")


def _time(c: Compare) -> Column:
    col, op = c.field.column, c.op
    v = c.value.replace("T", " ")
    v = v[:-1] if v.endswith("Z") else v
    if op not in (":", "="):
        n = F.lit(v).try_cast("timestamp_ntz")
        return {">": col > n, ">=": col >= n, "<": col < n, "<=": col <= n}[op]
    m = _PREFIX.fullmatch(v)
    if m:  # a whole unit of time: a half-open range, which the scan can prune by
        given = [g for g in m.groups() if g]
        full = "-".join((given + ["01", "01"])[:3]) if len(given) < 3 else "-".join(given[:3])
        full += " " + ":".join((given[3:] + ["00", "00", "00"])[:3])
        start = F.lit(full).try_cast("timestamp_ntz")
        return (col >= start) & (col < start + F.expr(f"interval 1 {_UNIT[len(given) - 1]}"))
    return col.cast("string").like(glob_to_like(v) + "%" if "*" not in v else glob_to_like(v))


def compile_query(query: str, fields: Fields | None = None) -> tuple[Column, list[str]]:
    """(predicate, warnings)"""
    tree, warnings = parse(query, fields)
    return lower(tree), warnings


def token_for(name: str, value: str | None, include: bool = True) -> str:
    """Search term for a cell: field=value, or field:- where it is empty; a leading - excludes."""
    if value in (None, ""):
        term = f"{name}:-"
    elif re.search(r"[\s\"'()]", value):
        q = "'" if '"' in value else '"'
        term = f"{name}={q}{value}{q}"
    else:
        term = f"{name}={value}"
    return term if include else f"-{term}"

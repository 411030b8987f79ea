"""Secret scans with a trigram index; DataFrame functions only.

From each rule's regular expression a Boolean query over trigrams is derived: AND over what a match must contain, OR over
its alternatives. The index is an inverted one, written once for a table: a posting (trigram, key) for each trigram that
some query asks for and each text that holds it. Queries intersect and unite postings; the texts that satisfy one are its
rule's candidates, and only they are verified by the expression. Rules without mandatory trigrams scan every text.

A text's key is its hash, so copies share their postings, and texts never move: postings and candidates are narrow, and
candidates meet the texts by a broadcast where they are counted and few, else by a join. Two texts of one hash can only
make each other candidates.

Offsets are code points. They come from the text between matches and the matches themselves, summed in blocks of about the
square root of their number, so a text with many thousand matches stays cheap.

Defined cases: texts of any length are scanned whole. A null text counts as empty and has no spans; its base_sha256 is that of the empty string. Rows are neither
dropped nor merged; extra columns of any name are ignored. Spans of one kind never overlap, those of different kinds may.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import persisted


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: A match counts only if this group has at least this many characters.
    group: int = 0
    least: int = 0


#: The base rules. 16 hex digits or 18 of a key id are the same as dropping shorter maximal runs.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: Rules beyond the base.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", r"[Bb]earer\x20+[A-Za-z0-9._~+/-]{20,}"),
)
RULES = BASE + MORE
MASK = "[SECRET]"
#: Candidates that are broadcast at most: two numbers each, 32 MB together.
BROADCAST_KEYS = 2_000_000

#: Strings that a literal part may stand for before it is cut off, and characters of a class that are spelled out.
MOST_STRINGS, MOST_CLASS = 32, 5

# a query is True, a trigram, or ("and" | "or", queries)


def trigram_query(pattern: str):
    """Boolean query over lower-case trigrams that every match of the pattern satisfies; True if it has none."""
    exact, query = _node(_parser.parse(pattern))
    return _all([query, _of(exact)])


def _all(queries: list):
    parts = []
    for q in queries:
        if q is True:
            continue
        for x in q[1] if isinstance(q, tuple) and q[0] == "and" else (q,):
            if x not in parts:
                parts.append(x)
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any(queries: list):
    parts = []
    for q in queries:
        if q is True:
            return True
        for x in q[1] if isinstance(q, tuple) and q[0] == "or" else (q,):
            if x not in parts:
                parts.append(x)
    # an alternative that asks for all that another does, and more, adds nothing
    sets = [frozenset(x[1]) if isinstance(x, tuple) and x[0] == "and" else frozenset([x]) for x in parts]
    parts = [x for x, a in zip(parts, sets, strict=True) if not any(b < a for b in sets)]
    return True if not parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of(strings: set[str] | None):
    """Query for one of these strings occurring; None: unknown."""
    if not strings:
        return True
    return _any([_all([s[i : i + 3].lower() for i in range(len(s) - 2)]) for s in sorted(strings)])


def _node(seq) -> tuple[set[str] | None, object]:
    """(all strings that the sequence can match, or None, query for the rest)."""
    exact: set[str] = {""}
    queries: list = []
    whole = True  # exact still stands for the sequence from its start
    for op, value in seq:
        sub: set[str] | None = None
        query = True
        if op is C.LITERAL:
            sub = {chr(value)}
        elif op is C.IN:
            sub = _class(value)
        elif op is C.SUBPATTERN:
            sub, query = _node(value[3])
        elif op is C.BRANCH:
            got = [_node(x) for x in value[1]]
            if all(s is not None for s, _ in got):
                sub = set().union(*(s for s, _ in got))
                query = _any([q for _, q in got])
            else:
                query = _any([_all([q, _of(s)]) for s, q in got])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            least, most, inner = value
            strings, inside = _node(inner)
            if (least, most) == (0, 1) and strings is not None and inside is True:
                sub = strings | {""}
            elif least >= 1:
                if least == most == 1:
                    sub, query = strings, inside
                else:
                    query = _all([inside, _of(strings)])
        elif op is C.AT:
            continue
        if sub is not None and len(sub) * len(exact) <= MOST_STRINGS:
            exact = {a + b for a in exact for b in sub}
            queries.append(query)
        else:
            queries += [_of(exact), query]
            if sub is not None:
                queries.append(_of(sub))
            exact, whole = {""}, False
    if not whole:
        queries.append(_of(exact))
    return (exact if whole else None), _all(queries)


def _class(items) -> set[str] | None:
    out: set[str] = set()
    for op, value in items:
        if op is C.LITERAL:
            out.add(chr(value))
        elif op is C.RANGE and value[1] - value[0] < MOST_CLASS:
            out |= {chr(c) for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len({c.lower() for c in out}) <= MOST_CLASS else None


def trigrams(query) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


def vocabulary(rules: tuple[Rule, ...] = RULES) -> list[str]:
    """The trigrams that the rules' queries ask for."""
    return sorted(set().union(*(trigrams(trigram_query(r.pattern)) for r in rules)))


def satisfied(query, words: list[str], maps: list[Column]) -> Column:
    """The query as intersections and unions of postings."""
    if query is True:
        return F.lit(True)
    if isinstance(query, str):
        k = words.index(query)
        return maps[k // 62].bitwiseAND(F.lit(1 << (k % 62)).cast("long")) != 0
    if query[0] == "and":
        plain = [q for q in query[1] if isinstance(q, str)]
        parts = [satisfied(q, words, maps) for q in query[1] if not isinstance(q, str)]
        for at in range(len(maps)):  # one AND for all postings that must meet
            want = sum(1 << (words.index(t) % 62) for t in plain if words.index(t) // 62 == at)
            if want:
                parts.append(maps[at].bitwiseAND(F.lit(want).cast("long")) == F.lit(want).cast("long"))
        return reduce(lambda a, b: a & b, parts)
    return reduce(lambda a, b: a | b, [satisfied(q, words, maps) for q in query[1]])


def text_key(text: Column) -> Column:
    return F.xxhash64(text)


def postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The index: (trigram, key), trigram being its place in the vocabulary."""
    low = F.lower("_text")
    d = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("_text")).select(text_key(F.col("_text")).alias("key"), low.alias("_low"))
    have = F.array(*[F.when(F.contains("_low", F.lit(t)), F.lit(k)) for k, t in enumerate(vocabulary(rules))])
    return d.select(F.explode(F.array_compact(have)).alias("trigram"), "key")


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, rules): texts whose postings satisfy the query of a rule, with bit i set for rule i; rules without a query are left out, as every text is theirs."""
    words = vocabulary(rules)
    k = F.col("trigram")
    at = [F.bit_or(F.when((k >= a) & (k < a + 62), F.call_function("shiftleft", F.lit(1).cast("long"), (k - a).cast("int"))).otherwise(F.lit(0).cast("long"))).alias(f"m{a}") for a in range(0, len(words), 62)]
    maps = index.groupBy("key").agg(*at)
    columns = [F.col(f"m{a}") for a in range(0, len(words), 62)]
    bits = [F.when(satisfied(q, words, columns), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, q in enumerate(trigram_query(r.pattern) for r in rules) if q is not True]
    if not bits:
        return maps.select("key", F.lit(0).cast("long").alias("rules")).limit(0)
    return maps.select("key", reduce(lambda a, b: a.bitwiseOR(b), bits).alias("rules")).where("rules <> 0")


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def scanned(docs: DataFrame, rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, _text, and _found: array of (start, order, kind, end) sorted by start, then by the rules' order."""
    index = persisted(postings(docs, rules), "trigrams")
    found = persisted(candidates(index, rules), "candidates")
    few = found.count() <= BROADCAST_KEYS
    d = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    d = d.withColumn("_key", text_key(F.col("_text"))).join((F.broadcast(found) if few else found).select(F.col("key").alias("_key"), F.col("rules").alias("_rules")), "_key", "left")
    none = F.array().cast("array<string>")

    def verified(i: int, r: Rule, group: int) -> Column:
        out = F.regexp_extract_all("_text", F.lit(f"({r.pattern})"), F.lit(group))
        return out if trigram_query(r.pattern) is True else F.when(F.col("_rules").bitwiseAND(F.lit(1 << i).cast("long")) != 0, out).otherwise(none)

    hits = [verified(i, r, 1).alias(f"_h{i}") for i, r in enumerate(rules)]
    hits += [verified(i, r, r.group + 1).alias(f"_g{i}") for i, r in enumerate(rules) if r.group]
    d = d.select(*keep, "_text", *hits)
    # what stands before each match, then the length of both
    gaps = [F.when(F.size(f"_h{i}") > 0, F.split("_text", r.pattern, -1)).otherwise(none).alias(f"_s{i}") for i, r in enumerate(rules)]
    d = d.select("*", *gaps)

    def steps(i: int) -> Column:
        return F.transform(f"_h{i}", lambda h, k: F.length(h) + F.length(F.get(f"_s{i}", k))).alias(f"_l{i}")

    def blocks(i: int) -> Column:
        w = F.col(f"_w{i}")
        return F.transform(F.sequence(F.lit(0), w), lambda b: _sum(F.slice(f"_l{i}", b * w + 1, w))).alias(f"_b{i}")

    d = d.select("*", *map(steps, range(len(rules))))
    d = d.select("*", *[F.greatest(F.ceil(F.sqrt(F.size(f"_l{i}"))).cast("int"), F.lit(1)).alias(f"_w{i}") for i in range(len(rules))])
    d = d.select("*", *map(blocks, range(len(rules))))

    def spans(i: int, r: Rule) -> Column:
        w = F.col(f"_w{i}")

        def one(h: Column, k: Column) -> Column:
            block = F.floor(k / w).cast("int")
            end = _sum(F.slice(f"_b{i}", F.lit(1), block)) + _sum(F.slice(f"_l{i}", block * w + 1, k - block * w + 1))
            return F.struct((end - F.length(h)).alias("start"), F.lit(i).alias("order"), F.lit(r.kind).alias("kind"), end.alias("end"), (F.length(F.get(f"_g{i}", k)) >= r.least if r.group else F.lit(True)).alias("ok"))

        return F.filter(F.transform(f"_h{i}", one), lambda x: x["ok"])

    return d.select(*keep, "_text", F.array_sort(F.concat(*[spans(i, r) for i, r in enumerate(rules)])).alias("_found"))


def shown(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat(x["kind"], F.lit(":"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))), ",")


def digests(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    d = scanned(docs, rules)
    base = F.filter("_found", lambda x: x["order"] < len(BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("_found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return d.select("doc_id", *[count(r.kind) for r in BASE], F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("_found")).alias("spans"))


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mask: str = MASK) -> DataFrame:
    """docs, all columns as they are, with every span of text replaced by mask; n_chars, where it is a column, follows the text.

    Overlapping spans give one mask. A null text stays null.
    """
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text"))
    d = scanned(whole, rules, ("_row",))
    d = d.withColumn("_n", F.size("_found")).withColumn("_w", F.greatest(F.ceil(F.sqrt("_n")).cast("int"), F.lit(1)))
    # the furthest end before each span, from maxima of blocks of about the square root of their number
    ends = F.transform("_found", lambda x: x["end"])
    d = d.withColumn("_ends", ends)
    d = d.withColumn("_tops", F.transform(F.sequence(F.lit(0), F.col("_w")), lambda b: F.coalesce(F.array_max(F.slice("_ends", b * F.col("_w") + 1, F.col("_w"))), F.lit(0))))

    def before(k: Column) -> Column:
        block = F.floor(k / F.col("_w")).cast("int")
        top = F.coalesce(F.array_max(F.slice("_tops", F.lit(1), block)), F.lit(0))
        return F.greatest(top, F.coalesce(F.array_max(F.slice("_ends", block * F.col("_w") + 1, k - block * F.col("_w"))), F.lit(0)))

    # where a span begins beyond all earlier ones, a mask begins; it reaches to the furthest end before the next of these
    heads = F.filter(F.transform("_found", lambda x, k: F.struct(x["start"].alias("start"), before(k).alias("before"))), lambda x: x["start"] >= x["before"])
    d = d.withColumn("_heads", heads).withColumn("_chars", F.when(F.col("_n") > 0, F.split("_text", "", -1)))

    def piece(x: Column, k: Column) -> Column:
        done = F.when(k == 0, F.lit(0)).otherwise(x["before"])
        return F.array_join(F.slice("_chars", done + 1, x["start"] - done), "")

    pieces = F.array_join(F.transform("_heads", piece), mask)
    last = F.array_max("_ends")
    rest = F.array_join(F.slice("_chars", last + 1, F.greatest(F.size("_chars") - last, F.lit(0))), "")
    clean = F.when(F.col("_n") > 0, F.concat(pieces, F.lit(mask), rest)).otherwise(F.col("_row")["text"])
    d = d.select("_row", clean.alias("_clean"))
    out = []
    for f in docs.schema.fields:
        c = F.col("_row").getField(f.name)
        if f.name == "text":
            c = F.col("_clean")
        elif f.name == "n_chars":
            c = F.when(F.col("_row").getField("text").isNull(), c).otherwise(F.length("_clean").cast(f.dataType))
        out.append(c.alias(f.name))
    return d.select(*out)


def _duck(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same result in DuckDB, without any index."""
    parts, unions = [], []
    for i, r in enumerate(rules):
        p = _duck(r.pattern)
        parts.append(f"regexp_extract_all(t, {p}) AS h{i}, regexp_split_to_array(t, {p}) AS s{i}" + (f", regexp_extract_all(t, {p}, {r.group}) AS g{i}" if r.group else ""))
        keep = f"len(g{i}[k]) >= {r.least}" if r.group else "true"
        unions.append(
            f"SELECT r, {i} AS o, '{r.kind}' AS kind, coalesce(list_sum(list_transform(s{i}[1:k], lambda x: len(x))), 0) + coalesce(list_sum(list_transform(h{i}[1:k-1], lambda x: len(x))), 0) AS a, len(h{i}[k]) AS n"
            f" FROM (SELECT *, unnest(range(1, len(h{i}) + 1)) AS k FROM m WHERE len(h{i}) > 0) WHERE {keep}"
        )
    counts = ", ".join(f"count(*) FILTER (o = {i}) AS n{i}" for i in range(len(BASE)))
    text = "kind || ':' || CAST(a AS BIGINT) || ':' || CAST(a + n AS BIGINT)"
    return (
        "WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), "
        f"m AS MATERIALIZED (SELECT r, {', '.join(parts)} FROM d), "
        f"f AS ({' UNION ALL '.join(unions)}), "
        f"g AS (SELECT r, {counts}, coalesce(string_agg({text}, ',' ORDER BY a, o) FILTER (o < {len(BASE)}), '') AS base, string_agg({text}, ',' ORDER BY a, o) AS spans FROM f GROUP BY r) "
        "SELECT doc_id, " + ", ".join(f"CAST(coalesce(n{i}, 0) AS BIGINT) AS n_{r.kind}" for i, r in enumerate(BASE)) + ", sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (r)"
    )

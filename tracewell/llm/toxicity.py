"""Toxicity by a learned lexicon, matched with Levenshtein automata, and context windows.

Learning finds words and word stems (prefixes) that mark label 1, over a bounded hash sample of labelled rows. The lexicon
becomes a trie; its intersection with the Levenshtein automata of its terms is one automaton, made deterministic while it
runs, so a token leaves it at the first letter that no term can reach with the edits allowed, the first letter included.
A token that clean rows of the sample hold is a word of its own and no misspelling, however near it is to a term. Each hit
is then judged by the window around it: inside quotation marks or beside a reporting word it counts as quoted, else as
abuse. How much a quoted hit counts, and a misspelled one of each term (short terms have neighbours by chance), is learned
from rows that have no other hits, from a prior on.

Inflected terms also come about by chance, the more so in long texts. So the hits of a text, each weighed by its term's
log odds and its window, are summed to its evidence, and a logistic curve over that sum and over its density gives the
score. The curve is drawn towards a prior curve, so few labelled rows move it little and none leave it as it is.

Bounds are on what is learned, not on what is scored: about ``rows_per_label`` rows of each label, chosen by a hash of the
id, of which one for each sketch counts; ``most_terms`` terms, the strongest first; words of 3 to 40 letters. Every text is
scored whole, whatever its length.

Defined cases: null and empty texts have no hits and get the base rate as score; with nothing to learn from, every score
is 0. A score of exactly the limit is toxic. Rows are neither dropped nor merged. Extra columns of any name are ignored. A
null label is not learned from; where an id has several labels, the highest counts; of texts with one sketch the least
is learned from, so the model depends on the rows alone and not on how they are spread.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import crc_bucket, persisted, python_batches

TOKEN = re.compile(r"[^\W_]+(?:[*@$'’][^\W_]+)*")
#: Prefix lengths that can be stems.
STEMS = range(4, 9)
#: Tokens on each side of a hit that its window holds.
WINDOW = 6
#: Words that report speech, in the languages of the corpus.
REPORTING = frozenset("said says wrote quoted quote called word term slur dit écrit cité mot terme sagte schrieb zitiert wort begriff dijo escribió citó palabra término".split())
QUOTES = {'"': '"', "“": "”", "«": "»", "„": "“"}
#: What a misspelled or quoted hit counts for, before any evidence, and how many rows that belief weighs.
PRIOR = {"fuzzy": 0.8, "quoted": 0.1}
PRIOR_ROWS = 4
CACHE_TOKENS = 120_000
#: Rows with label 1 that a term needs, its least log-likelihood ratio and its least probability of label 1.
LEAST_ROWS, LEAST_RATIO, LEAST_P = 6, 12.0, 0.2
#: Clean rows from which on a token is a word of its own.
ORDINARY_ROWS = 2
#: The curve before any evidence: intercept, and slopes of the summed evidence and of its density; and how much it weighs.
PRIOR_CURVE, CURVE_WEIGHT = (-9.0, 3.0, 3.0), (0.01, 0.1, 0.1)
REJECT = 0.7


def edits_allowed(term: str) -> int:
    """By length; stems (ending in ``*``) need five letters for one edit, as any word may follow."""
    n = len(term.rstrip("*"))
    return 0 if n < (5 if term.endswith("*") else 4) else 1 if n < 9 else 2


class Automaton:
    """Trie of terms intersected with their Levenshtein automata, deterministic state by state as tokens need it.

    A term ending in ``*`` is a stem: tokens need only begin with it. Tokens of ``ordinary`` match without edits only.
    """

    def __init__(self, terms: list[str], ordinary: frozenset[str] = frozenset()):
        self.terms, self.ordinary = terms, ordinary
        self.children: list[dict[str, int]] = []
        self.ends: list[list[tuple[int, bool]]] = []
        self.roots: list[tuple[int, int]] = []  # (trie root, edits allowed)
        self.limit: list[int] = []
        for edits in (0, 1, 2):
            own = [(i, t) for i, t in enumerate(terms) if edits_allowed(t) == edits]
            if own:
                root = self._node(edits)
                for i, t in own:
                    node = root
                    for c in t.rstrip("*"):
                        node = self.children[node].setdefault(c, -1) if self.children[node].get(c, -1) >= 0 else self._child(node, c, edits)
                    self.ends[node].append((i, t.endswith("*")))
                self.roots.append((root, edits))
        self.letters = {c for kids in self.children for c in kids}
        start = frozenset(self._close({root: 0 for root, _ in self.roots}).items())
        self.ids = {(start, None): 0}
        self.states: list[tuple[frozenset, tuple | None]] = [(start, None)]
        self.moves: list[dict[str, int]] = [{}]
        self.result: list[tuple[int, int] | None] = [None]
        self.cache: dict[str, tuple[int, int] | None] = {}

    def _node(self, edits: int) -> int:
        self.children.append({})
        self.ends.append([])
        self.limit.append(edits)
        return len(self.children) - 1

    def _child(self, node: int, c: str, edits: int) -> int:
        k = self._node(edits)
        self.children[node][c] = k
        return k

    def _close(self, states: dict[int, int]) -> dict[int, int]:
        """Letters of a term that the token lacks."""
        todo = list(states.items())
        while todo:
            node, e = todo.pop()
            if e < self.limit[node] and states.get(node) == e:
                for k in self.children[node].values():
                    if e + 1 < states.get(k, 9):
                        states[k] = e + 1
                        todo.append((k, e + 1))
        return states

    def _step(self, state: int, c: str) -> int:
        here, stem = self.states[state]
        out: dict[int, int] = {}

        def add(node: int, e: int) -> None:
            if e < out.get(node, 9):
                out[node] = e

        for node, e in here:
            if c in self.children[node]:
                add(self.children[node][c], e)
            if e < self.limit[node]:
                add(node, e + 1)
                for k in self.children[node].values():
                    add(k, e + 1)
        self._close(out)
        for node, e in sorted(out.items()):
            for i, is_stem in self.ends[node]:
                if is_stem and (stem is None or (e, i) < stem):
                    stem = (e, i)
        key = (frozenset(out.items()), stem)
        k = self.ids.get(key)
        if k is None:
            k = self.ids[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
            whole = min(((e, i) for node, e in out.items() for i, is_stem in self.ends[node] if not is_stem), default=None)
            self.result.append(min((x for x in (whole, stem) if x), default=None))
        self.moves[state][c] = k
        return k

    def match(self, token: str) -> tuple[int, int] | None:
        """(edits, term number) of the best term, or None."""
        state, moves, letters = 0, self.moves, self.letters
        for c in token:
            if c not in letters:
                c = ""
            k = moves[state].get(c)
            if k is None:
                k = self._step(state, c)
            state = k
            if not self.states[state][0]:
                break
        return self.result[state]

    def find(self, token: str) -> tuple[int, int] | None:
        cache = self.cache
        if token in cache:
            return cache[token]
        got = self.match(token)
        if got and got[0] and token in self.ordinary:
            got = None
        if len(cache) >= CACHE_TOKENS:
            cache.clear()
        if len(token) <= 64:
            cache[token] = got
        return got


def quoted_spans(text: str) -> list[tuple[int, int]]:
    """Spans between quotation marks that open and close on one line."""
    out, at = [], 0
    for line in text.split("\n"):
        i = 0
        while i < len(line):
            close = QUOTES.get(line[i])
            j = line.find(close, i + 1) if close else -1
            if j > 0:
                out.append((at + i, at + j))
                i = j
            i += 1
        at += len(line) + 1
    return out


def hits(auto: Automaton, text: str) -> list[tuple[int, str]]:
    """(term number, kind) of every hit; kind is plain, fuzzy, quoted or both."""
    low = text.lower()
    wanted = {t: m for t in set(TOKEN.findall(low)) if (m := auto.find(t)) is not None}
    if not wanted:
        return []
    spans = quoted_spans(low) if any(q in low for q in QUOTES) else []
    tokens = [(m.start(), m.group()) for m in TOKEN.finditer(low)]
    out, k = [], 0
    for i, (at, t) in enumerate(tokens):
        if t in wanted:
            while k < len(spans) and spans[k][1] < at:
                k += 1
            inside = k < len(spans) and spans[k][0] < at
            near = any(x in REPORTING for _, x in tokens[max(0, i - WINDOW) : i + WINDOW + 1])
            edits, term = wanted[t]
            out.append((term, ("both" if inside or near else "fuzzy") if edits else ("quoted" if inside or near else "plain")))
    return out


def logit(p: float) -> float:
    p = min(0.999, max(0.001, p))
    return math.log(p / (1 - p))


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30.0, 30.0)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, prior: tuple = PRIOR_CURVE, steps: int = 50) -> np.ndarray:
    """Coefficients of a logistic regression (intercept first), drawn towards the prior's, by damped Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    penalty, centre = np.diag(CURVE_WEIGHT), np.array(prior)
    b = centre.copy()
    for _ in range(steps):
        p = sigmoid(x @ b)
        gradient = x.T @ (weight * (p - y)) + penalty @ (b - centre)
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + penalty
        step = np.linalg.solve(hessian, gradient)
        b -= step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
    return b


class Model:
    """Terms with their odds; quoted and misspelled: what such hits count for, the latter by term; base: score without hits."""

    def __init__(self, terms: dict[str, float], base: float, rate: float = 0.5, ordinary: frozenset[str] = frozenset(), quoted: float = PRIOR["quoted"], misspelled: list[float] | None = None):
        self.terms = list(terms)
        self.base = base
        self.ordinary = ordinary
        self.quoted = quoted
        self.misspelled = misspelled or [PRIOR["fuzzy"]] * len(terms)
        self.odds = [max(0.0, logit(p) - logit(rate)) for p in terms.values()]
        self.curve = np.array(PRIOR_CURVE)
        self._auto: Automaton | None = None

    @property
    def auto(self) -> Automaton:
        if self._auto is None:
            self._auto = Automaton(self.terms, self.ordinary)
        return self._auto

    def __getstate__(self):
        return self.__dict__ | {"_auto": None}

    def evidence(self, text: str | None) -> tuple[float, float] | None:
        """Log of the summed evidence of a text and of its density; None without hits."""
        found = hits(self.auto, text) if text and self.terms else []
        if not found:
            return None
        total = sum(self.odds[term] * (self.misspelled[term] if kind in ("fuzzy", "both") else 1.0) * (self.quoted if kind in ("quoted", "both") else 1.0) for term, kind in found)
        return math.log1p(total), math.log1p(100.0 * total / (20 + sum(1 for _ in TOKEN.finditer(text))))

    def score(self, text: str | None) -> float:
        x = self.evidence(text)
        return self.base if x is None else float(sigmoid(self.curve @ (1.0, *x)))


def features(text: str | None) -> set[str]:
    """``word`` for whole words and ``stem*`` for prefixes."""
    words = set(TOKEN.findall((text or "").lower()))
    return {w for w in words if 2 < len(w) <= 40} | {w[:k] + "*" for w in words for k in STEMS if len(w) > k}


def sketch(text: str) -> int:
    """The least hash of the five-word shingles: near copies mostly share it, and only one of them is learned from."""
    w = text.lower().split()
    return min((zlib.crc32(" ".join(w[i : i + 5]).encode()) for i in range(max(1, len(w) - 4))), default=0)


def choose(rows: list[tuple[str, int, int]], n1: int, n0: int, rate: float, most: int, least_p: float = LEAST_P) -> dict[str, float]:
    """Terms that mark label 1, each with the probability of label 1 given the term; rows: (feature, rows with label 1, with label 0).

    A term is left out when one already chosen covers it: a longer prefix, or a shorter one that adds next to nothing.
    """
    scored = []
    for f, d1, d0 in rows:
        r1, r0 = d1 / max(1, n1), (d0 + 0.5) / (n0 + 1)
        p = rate * r1 / (rate * r1 + (1 - rate) * r0)
        seen, share = d1 / max(1, d1 + d0), n1 / max(1, n1 + n0)
        ratio = d1 * math.log(max(seen, 1e-9) / max(share, 1e-9)) + (d0 * math.log((1 - seen) / (1 - share)) if d0 else 0.0)
        if p >= least_p and d1 >= LEAST_ROWS and ratio >= LEAST_RATIO:
            scored.append((f, d1, p, ratio))
    scored.sort(key=lambda x: (-x[3], -len(x[0].rstrip("*")), x[0]))
    chosen: dict[str, float] = {}
    best: dict[str, int] = {}  # prefix of a chosen term -> its count
    stems: set[str] = set()
    for f, d1, p, _ in scored:
        root = f.rstrip("*")
        if len(chosen) >= most or any(root[:k] in stems for k in STEMS if k <= len(root)) or f.endswith("*") and d1 - best.get(root, 0) < max(5, 0.05 * d1):
            continue
        chosen[f] = p
        if f.endswith("*"):
            stems.add(root)
        for k in range(2, len(root) + 1):
            best[root[:k]] = best.get(root[:k], 0) + d1
    return chosen


def fit(docs: DataFrame, labels: DataFrame, learn=None, rows_per_label: int = 6000, most_terms: int = 2000) -> Model:
    """Learn from at most about rows_per_label rows of each label; learn: a condition on doc_id."""
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    if learn is not None:
        marked = marked.where(learn)
    marked = marked.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(1) or not sizes.get(0):
        return Model({}, 0.0)
    share = F.when(F.col("toxic") == 1, F.lit(min(1.0, rows_per_label / sizes[1]))).otherwise(F.lit(min(1.0, rows_per_label / sizes[0])))
    chosen = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share * 1_000_003).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # about 2 * rows_per_label rows of two numbers, whatever the corpus size, so a broadcast is safe
    sample = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")
    python_batches(docs.sparkSession)

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("sketch", pa.array([sketch(t) for t in b.column("text").to_pylist()], pa.int64()))

    sample = persisted(sample.mapInArrow(sketched, "text string, toxic int, sketch long").groupBy("sketch", "toxic").agg(F.min("text").alias("text")).select("text", "toxic"), "tox")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c1, c0, n = Counter(), Counter(), [0, 0]
        for b in batches:
            for t, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                n[y] += 1
                (c1 if y else c0).update(features(t))
        keys = [k for k in c1] + [k for k in c0 if k not in c1]
        yield pa.record_batch([pa.array([*keys, ""], pa.string()), pa.array([*(c1[k] for k in keys), n[1]], pa.int64()), pa.array([*(c0[k] for k in keys), n[0]], pa.int64())], names=["f", "d1", "d0"])

    counts = persisted(sample.mapInArrow(count, "f string, d1 long, d0 long").groupBy("f").agg(F.sum("d1").alias("d1"), F.sum("d0").alias("d0")), "tox")
    n1, n0 = counts.where("f = ''").select("d1", "d0").first() or (0, 0)
    if not n1 or not n0:
        return Model({}, 0.0)
    rate = sizes[1] / (sizes[1] + sizes[0])
    # words of a bounded sample, and of these only what is far commoner under label 1
    near = counts.where((F.col("d1") >= LEAST_ROWS) & (F.col("d1") / F.lit(n1) > 2.5 * (F.col("d0") + 0.5) / F.lit(n0))).where("f <> ''")
    terms = choose([(r["f"], r["d1"], r["d0"]) for r in near.collect()], n1, n0, rate, most_terms)
    if not terms:
        return Model({}, min(rate, 0.5), rate)
    bare_terms = docs.sparkSession.sparkContext.broadcast(Model(terms, 0.0))

    def mistaken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = bare_terms.value.auto
        for b in batches:
            yield b.filter(pa.array([(m := auto.match(t.as_py())) is not None and m[0] > 0 for t in b.column("f")], pa.bool_()))

    # words near a term that are words of their own: again words of the bounded sample
    words = counts.where((F.col("d0") >= ORDINARY_ROWS) & ~F.col("f").endswith("*") & (F.col("f") != "")).select("f")
    ordinary = frozenset(r["f"] for r in words.mapInArrow(mistaken, "f string").collect())
    model = Model(terms, 0.0, rate, ordinary)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()  # (term or -1 without hits or -2 for quoted hits alone, label) -> rows
        auto = shared.value.auto
        for b in batches:
            for t, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                got = hits(auto, t)
                seen = {k for _, k in got}
                for i in {-1} if not got else {-2} if seen == {"quoted"} else {i for i, _ in got} if seen == {"fuzzy"} else ():
                    c[i, y] += 1
        rows = sorted(c.items())
        yield pa.record_batch([pa.array([i for (i, _), _ in rows], pa.int32()), pa.array([y for (_, y), _ in rows], pa.int32()), pa.array([n for _, n in rows], pa.int64())], names=["hit", "toxic", "n"])

    seen = {(r["hit"], r["toxic"]): r["n"] for r in sample.mapInArrow(kinds, "hit int, toxic int, n long").groupBy("hit", "toxic").agg(F.sum("n").alias("n")).collect()}
    scale = {1: rate / n1, 0: (1 - rate) / n0}  # the two labels were sampled at different shares
    bare = [seen.get((-1, y), 0) * scale[y] for y in (0, 1)]
    base = bare[1] / sum(bare) if sum(bare) else rate

    def counts_for(hit: int, prior: float) -> float:
        a, b = seen.get((hit, 1), 0), seen.get((hit, 0), 0) * (scale[0] / scale[1])
        return (a + PRIOR_ROWS * prior) / (a + b + PRIOR_ROWS)

    model = Model(terms, min(base, 0.5), rate, ordinary, counts_for(-2, PRIOR["quoted"]), [counts_for(i, PRIOR["fuzzy"]) for i in range(len(terms))])
    weighed = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(*x, y) for t, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True) if (x := weighed.value.evidence(t)) is not None]
            yield pa.record_batch([pa.array([r[k] for r in rows], pa.float64() if k < 2 else pa.int32()) for k in range(3)], names=["total", "dense", "toxic"])

    # three numbers for each row of the bounded sample; in a fixed order, so that sums do not depend on the partitions
    points = sample.mapInArrow(measure, "total double, dense double, toxic int").orderBy("total", "dense", "toxic").toPandas().to_numpy(float)
    y = points[:, 2]
    weight = np.where(y > 0, scale[1], scale[0]) * (n1 + n0)
    model.curve = logistic(points[:, :2], y, weight)
    return model


def predict(docs: DataFrame, model: Model, held_out=None) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    python_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            got = [m.score(t.as_py()) for t in b.column("text")]
            yield pa.record_batch([b.column("doc_id"), b.column("held_out"), pa.array(got, pa.float64()), pa.array([int(x >= REJECT) for x in got], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])
        m.auto.cache.clear()  # workers live on for other tasks

    held = F.lit(False) if held_out is None else held_out
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns as they are, that score below the limit."""
    python_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            yield b.filter(pa.array([m.score(t.as_py()) < REJECT for t in b.column("text")], pa.bool_()))
        m.auto.cache.clear()

    return docs.mapInArrow(run, docs.schema)


def held_out_rows():
    """The rows that the query does not learn labels from."""
    return crc_bucket("doc_id", 3) == 1

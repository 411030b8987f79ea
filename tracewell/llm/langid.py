"""Language identification by word-first backoff.

A known word scores its per-language log frequency. An unseen word is covered from the left by the longest known
character n-grams, falling back to progressively shorter ones.

The model is fitted on at most about ``docs_per_lang`` labelled rows of each language (chosen by a hash of id and text).
Each language keeps its commonest words and, of each length, n-grams: ``words_per_lang`` and ``grams`` of them, or fewer
where many languages share ``most_words``, so what is collected and broadcast is bounded whatever the corpus size and no
language is left out. Words of more than 48 letters and words that occur once in a language's sample are not learned (they
are scored by n-grams like any unseen word). Prediction covers every row and whole texts.

Defined cases: a null text, or one without any letter, is ``und`` with score 0; so is every row if there is nothing to
learn from. Ties go to the language that sorts first. Rows are neither dropped nor merged; repeated rows give repeated
results; very long texts are counted by word, so they cost memory by their vocabulary. Extra columns of any name are
ignored. A null id is kept as null and counts as the empty string when held-out rows are chosen.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tracewell.llm.common import crc_bucket, python_batches

#: Runs of letters; the few numeric characters that also fit are dropped by the check for a letter.
WORD = re.compile(r"[^\W\d_]+")
LONGEST_GRAM = 5
UNDETERMINED = "und"
#: Words kept in a worker's cache of word scores, and the longest word that is cached.
CACHE_WORDS, CACHE_CHARS = 120_000, 48
#: At most this many words' worth of evidence counts towards the score, which else is 1 for any long text.
EVIDENCE = 8.0


class Model:
    """Log frequencies by language: words, and n-grams of each length."""

    def __init__(self, counts: dict[str, dict[str, int]], docs: dict[str, int], grams: int = 60_000):
        self.langs = sorted(counts)
        k = len(self.langs)
        self.prior = np.log(np.array([max(1, docs.get(x, 1)) for x in self.langs], float)) if k else np.zeros(0)
        self.words, self.word_rows = self._table([counts[x] for x in self.langs])
        self.grams: list[tuple[dict[str, int], np.ndarray]] = []
        for n in range(1, LONGEST_GRAM + 1):
            by_lang = []
            for x in self.langs:
                c: Counter = Counter()
                for w, m in counts[x].items():
                    p = f"^{w}$" if n > 1 else w
                    for i in range(len(p) - n + 1):
                        c[p[i : i + n]] += m
                by_lang.append(dict(c.most_common(grams)))
            self.grams.append(self._table(by_lang))
        self.cache: dict[str, int] = {}
        self.rows = np.zeros((1024, k), np.float32)

    @staticmethod
    def _table(by_lang: list[dict[str, int]]) -> tuple[dict[str, int], np.ndarray]:
        """Row numbers of entries, and their log frequencies by language."""
        vocabulary = sorted(set().union(*by_lang)) if by_lang else []
        counts = np.array([[c.get(w, 0) for c in by_lang] for w in vocabulary], float).reshape(len(vocabulary), len(by_lang))
        rows = np.log((counts + 0.5) / (counts.sum(0) + 0.5 * max(1, len(vocabulary))))
        return {w: i for i, w in enumerate(vocabulary)}, rows.astype(np.float32)

    def word(self, w: str) -> np.ndarray:
        """Log scores of one lower-case word for each language."""
        known = self.words.get(w)
        if known is not None:
            return self.word_rows[known]
        total, p, i = np.zeros(len(self.langs)), f"^{w}$", 0
        while i < len(p):
            for n in range(min(LONGEST_GRAM, len(p) - i), 0, -1):
                ids, rows = self.grams[n - 1]
                g = ids.get(p[i : i + n])
                if g is not None:
                    total += rows[g]
                    i += n
                    break
            else:
                i += 1
        return total

    def _row(self, w: str) -> int:
        if len(self.cache) >= CACHE_WORDS:
            self.cache.clear()
        k = len(self.cache)
        if k >= len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[k] = self.word(w)
        self.cache[w] = k
        return k

    def without_prior(self) -> Model:
        """This model with all languages alike beforehand, so a text that tells nothing has no language."""
        self.prior = np.zeros(len(self.langs))
        return self

    def forget(self) -> None:
        """Empties the cache at the end of a task, as workers live on for other tasks."""
        self.cache.clear()
        self.rows = np.zeros((1024, len(self.langs)), np.float32)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs:
            return UNDETERMINED, 0.0
        found = Counter(WORD.findall(text.lower()))
        if not any(c.isalpha() for w in found for c in w):
            return UNDETERMINED, 0.0
        total, cache, rows, times = self.prior.copy(), self.cache, [], []
        for w, n in found.items():
            k = cache.get(w)
            if k is None:
                if len(w) > CACHE_CHARS:
                    total += n * self.word(w)
                    continue
                if len(cache) >= CACHE_WORDS and rows:  # the rows found so far would be overwritten
                    total += np.array(times, float) @ self.rows[rows]
                    rows, times = [], []
                k = self._row(w)
            rows.append(k)
            times.append(n)
        if rows:
            total += np.array(times, float) @ self.rows[rows]
        n = sum(found.values())
        z = (total - total.max()) * min(1.0, EVIDENCE / n)
        p = np.exp(z)
        best = int(np.argmax(total))
        return self.langs[best], float(p[best] / p.sum())


def fit(docs: DataFrame, learn=None, docs_per_lang: int = 3000, words_per_lang: int = 40_000, grams: int = 60_000, most_words: int = 2_000_000) -> Model:
    """Count words by language in the JVM over a bounded hash sample of labelled rows; learn: a further condition on them."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    if learn is not None:
        rows = rows.where(learn)
    rows = rows.select("lang", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_003)).alias("_h"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model({}, {})
    shares = docs.sparkSession.createDataFrame([(k, min(1.0, docs_per_lang / n)) for k, n in sizes.items()], "lang string, share double")
    # one number for each language
    sample = rows.join(F.broadcast(shares), "lang").where(F.col("_h") < F.col("share") * 1_000_003)
    words_per_lang = max(1, min(words_per_lang, most_words // len(sizes)))
    words = sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))).alias("w"))
    counts = words.where(F.length("w") <= CACHE_CHARS).groupBy("lang", "w").agg(F.count("*").alias("n")).where("n > 1")
    ranked = counts.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "w")))
    found: dict[str, dict[str, int]] = {k: {} for k in sizes}
    for r in ranked.where(F.col("_r") <= words_per_lang).select("lang", "w", "n").toPandas().itertuples(index=False):
        found[r.lang][r.w] = int(r.n)
    return Model({k: c for k, c in found.items() if c}, sizes, max(1, min(grams, 2 * most_words // len(sizes))))


RESULT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def predict(docs: DataFrame, model: Model, held_out=None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row."""
    python_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            got = [m.predict(t.as_py()) for t in b.column("text")]
            yield pa.record_batch([b.column("doc_id"), b.column("held_out"), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])
        m.forget()

    held = F.lit(False) if held_out is None else held_out
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text").mapInArrow(run, RESULT)


def identified(docs: DataFrame, model: Model, min_score: float = 0.0) -> DataFrame:
    """The rows of docs whose language is determined with at least min_score; lang is that language, all other columns are as they are.

    If there is nothing to learn from, no language can be determined, and every row with a letter stays, with its lang.
    """
    python_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            if m.langs:
                got = [m.predict(t.as_py()) for t in b.column("text")]
                kept = [x[0] != UNDETERMINED and x[1] >= min_score for x in got]
                at = b.schema.get_field_index("lang")
                b = b.set_column(at, b.schema.field(at), pa.array([x[0] for x in got], b.schema.field(at).type))
            else:
                kept = [any(c.isalpha() for c in t.as_py() or "") for t in b.column("text")]
            yield b.filter(pa.array(kept, pa.bool_()))
        m.forget()

    return docs.mapInArrow(run, docs.schema)


def held_out_rows():
    """The rows that the query does not learn from."""
    return crc_bucket("doc_id", 4) == 2

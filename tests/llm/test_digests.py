"""Fingerprints, whitening and the divergence audit: plain versions of each, and odd input."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_cases import DOCS, EXTRA, long_text, texts
from tests.oracle import connect, same
from tracewell.llm import divergence, entries, fingerprints, whitening
from tracewell.llm.common import table

LETTERS = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i != 7 else None, None if i == 12 else "s", None, *EXTRA) for i, t in texts()]
    return spark.createDataFrame(rows, DOCS)


def plain_digest(text):
    """Length code and quartile codes, counted one triplet at a time."""
    b = text.encode()
    padded = b if len(b) > 2 or not b else b.ljust(3, b"\0")
    counts = [0] * fingerprints.BUCKETS
    for i in range(len(padded) - 2):
        code = padded[i] * 65536 + padded[i + 1] * 256 + padded[i + 2]
        counts[(code * fingerprints.MULTIPLIER >> fingerprints.SHIFT) % fingerprints.BUCKETS] += 1
    s, n = sorted(counts), fingerprints.BUCKETS
    cuts = [s[n * k // 4 - 1] for k in (1, 2, 3)]
    return [min(255, 1 + int(math.log(len(b)) / math.log(fingerprints.LENGTH_BASE))) if b else 0, *[sum(c > q for q in cuts) for c in counts]]


def plain_likeness(a, b):
    steps = min(abs(a[0] - b[0]), fingerprints.LENGTH_STEPS)
    most = sum(map(max, a[1:], b[1:])) + steps
    return 1 - (sum(abs(x - y) for x, y in zip(a[1:], b[1:], strict=True)) + steps) / max(most, 1)


def plain_hex(d):
    return f"{d[0]:02x}" + "".join(f"{d[i] << 6 | d[i + 1] << 4 | d[i + 2] << 2 | d[i + 3]:02x}" for i in range(1, len(d), 4))


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_fingerprints_equal_a_plain_count(docs, parts, monkeypatch):
    monkeypatch.setattr(fingerprints, "PIECE", 1000)
    unique = docs.where("doc_id is not null").dropDuplicates(["doc_id"]).repartition(parts)
    rows = sorted((r["doc_id"], r["text"] or "") for r in unique.collect())
    got = {r["doc_id"]: r for r in fingerprints.compared(unique).collect()}
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        made = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        r, a, b, c = got[i], plain_digest(t), plain_digest(made), plain_digest(after)
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(made.encode()).hexdigest()
        assert (r["fingerprint"], r["edited_fingerprint"]) == (plain_hex(a), plain_hex(b))
        assert r["near_edited"] == pytest.approx(plain_likeness(a, b)) and r["near_next"] == pytest.approx(plain_likeness(a, c))


def test_fingerprint_cases(docs, spark):
    got = fingerprints.compared(docs).collect()
    assert len(got) == docs.count() and {r["fingerprint"] for r in got if r["doc_id"] in (4, 5)} == {"00" * (1 + fingerprints.BUCKETS // 4)}
    assert len({r["fingerprint"] for r in got if r["doc_id"] in (1, None)}) == 1
    one = fingerprints.compared(docs.where("doc_id = 2")).first()
    assert one["near_next"] == 1.0
    assert fingerprints.compared(docs.limit(0)).collect() == []
    ids = spark.createDataFrame([("b", "bb"), ("a", "aaaa")], "doc_id string, text string")
    want = {"a": "aabb", "b": "ba"}
    assert {r["doc_id"]: r["edited_sha256"] for r in fingerprints.compared(ids).collect()} == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in want.items()}


def test_likeness_of_digest_columns(docs):
    d = fingerprints.fingerprinted(docs.where("doc_id is not null").dropDuplicates(["doc_id"]))
    by = {r["doc_id"]: r["fingerprint"] for r in d.collect()}
    pairs = d.alias("a").join(d.alias("b"), F.col("a.doc_id") <= F.col("b.doc_id")).select(F.col("a.doc_id").alias("i"), F.col("b.doc_id").alias("j"), fingerprints.likeness(F.col("a.fingerprint"), F.when(F.col("b.doc_id") != 9, F.col("b.fingerprint"))).alias("s"))
    for r in pairs.collect():
        if r["j"] == 9:
            assert r["s"] is None
        else:
            assert 0 <= r["s"] <= 1 and (r["s"] == 1) == (by[r["i"]] == by[r["j"]])
    assert {(r["i"], r["j"]): r["s"] for r in pairs.collect()}[(1, 2)] > 0.7


def test_edited_texts_are_nearer_than_the_next(spark, sf_dir):
    rows = entries.op11_fingerprints(spark, sf_dir).collect()
    assert sum(r["near_edited"] > r["near_next"] for r in rows) >= 0.98 * len(rows)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "x") for i, v in rows], "vec_id long, embedding array<float>, label int, x string, n string")


@pytest.mark.parametrize("n,d,tile", [(200, 10, 4), (90, 70, 32), (50, 3, 2)])
def test_whitening_equals_brute_force(spark, n, d, tile, monkeypatch):
    monkeypatch.setattr(whitening, "TILE", tile)
    monkeypatch.setattr(whitening, "ROWS", 7)
    rng = np.random.default_rng(n)
    v = (rng.normal(size=(n, d)) @ rng.normal(size=(d, d))).astype(np.float32)
    rows = vectors(spark, enumerate(v.tolist())).repartition(5)
    got = sorted(whitening.components(rows).collect(), key=lambda r: (r["vec_id"], r["component"]))
    x = np.floor(v.astype(float) * 64).astype(np.int64) + 1_000_000
    s = x.sum(0)
    z = (n * x - s) / n
    values, axes = np.linalg.eigh(z.T @ z / n)
    k = min(32, d)
    values, axes = values[::-1], axes[:, ::-1]
    assert len(got) == n * k and {r["n"] for r in got} == {n}
    assert [r["deviation"] for r in got[::k]] == [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True)) for row in x]
    w = np.array([r["whitened"] for r in got]).reshape(n, k)
    want = z @ axes[:, :k] / np.sqrt(values[:k])
    want *= np.sign((want * w).sum(0))
    assert np.abs(w - want).max() < 1e-7
    assert np.allclose([r["explained"] for r in got[:k]], values[:k] / values.sum(), rtol=1e-9)
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-8
    assert np.abs(w.T @ w / n - w.mean(0)[:, None] * w.mean(0) - np.eye(k)).max() < 1e-8


def test_whitening_cases(spark):
    good = [(i, [float(i), float(i * i % 7), 1.0]) for i in range(20)]
    odd = [(90, None), (91, [1.0, None, 2.0]), (92, [1.0, float("nan"), 2.0]), (93, [float("inf"), 1.0, 2.0]), (94, [1.0, 2.0]), (95, []), (96, [1e30, 1.0, 1.0])]
    rows = vectors(spark, [*good, *odd, (None, [3.0, 3.0, 1.0]), good[3]])
    got = whitening.components(rows).collect()
    # the third dimension does not vary, so there are two components; null and repeated ids are rows like others
    assert len(got) == 2 * 22 and {r["n"] for r in got} == {22} and {r["component"] for r in got} == {1, 2}
    assert Counter(r["vec_id"] for r in got)[3] == 4 and Counter(r["vec_id"] for r in got)[None] == 2
    schema = whitening.components(rows).schema
    for few in (rows.limit(0), vectors(spark, odd), vectors(spark, good[:1]), vectors(spark, [good[0]] * 5)):
        out = whitening.components(few)
        assert out.collect() == [] and out.columns == schema.names


def test_whitening_of_large_entries_stays_exact(spark):
    v = [[float(2**40 + i * 2**20), float(-(2**50)), float(i % 3)] for i in range(40)]
    x = [[math.floor(64 * c) + 1_000_000 for c in r] for r in v]
    s = [sum(c) for c in zip(*x, strict=True)]
    frame = spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<double>")
    want = {i: sum((40 * a - b) ** 2 for a, b in zip(r, s, strict=True)) for i, r in enumerate(x)}
    got = {r["vec_id"]: r["deviation"] for r in whitening.components(frame).collect()}
    assert got == {i: w if w < 2**63 else None for i, w in want.items()} and None in got.values()


def plain_audit(rows, min_docs, k):
    """Every group and kept term, one by one."""
    count, held, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in LETTERS.findall(text or "")]
        count[lang, source].update(terms)
        held[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in held[lang].items() if n >= min_docs]
        of_lang = sum((count[g] for g in groups if g[0] == lang), Counter())

        def shares(c):
            whole = sum(c[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // whole for t in kept}

        q, p = shares(of_lang), {s: shares(count[lang, s]) for g, s in groups if g == lang}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in p:
            pair = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in p if o != s]
            term = [(t, f(p[s][t], q[t])) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pair, None), ("term", term, k)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, i) for i, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


def audit_rows():
    rng = np.random.default_rng(5)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)] + ["É", "é", "ÀB", "日本", "ſ", "K"]
    rows = []
    for i in range(400):
        lang, source = ("en", "de", None)[i % 3], (f"s{i % 7}", None, "x" * 50)[0 if i % 5 else i % 3]
        pick = rng.zipf(1.3, 30) % len(words)
        rows.append((" ".join(words[(j + i % 7) % len(words)].upper() if j % 2 else words[j] for j in pick) + " 12_3-a", lang, source))
    return [*rows, (None, "en", "empty"), ("", "xx", "a"), ("one two", "xx", "b"), (None, "yy", None), (long_text(), "en", "s1"), *rows[:20]]


@pytest.mark.parametrize("sources,bucket,tied,held,min_docs", [(128, 2048, 64, 200_000, 10), (2, 16, 2, 50, 3), (3, 50, 0, 10, 1)])
def test_audit_equals_every_group_and_term(spark, monkeypatch, sources, bucket, tied, held, min_docs):
    for name, value in (("SOURCES", sources), ("BUCKET", bucket), ("TIED", tied), ("HELD", held)):
        monkeypatch.setattr(divergence, name, value)
    rows = audit_rows()
    frame = spark.createDataFrame([(*r, 1, "x", "x", "x") for r in rows], "text string, lang string, source string, doc_id int, term string, n string, p string").repartition(6)
    assert sorted(map(tuple, divergence.audited(frame, min_docs).collect())) == plain_audit(rows, min_docs, 10)
    assert divergence.audited(frame.limit(0)).collect() == []


@pytest.mark.parametrize("tied", [0, 3, 1000])
def test_radix_selection_equals_sorting(spark, monkeypatch, tied):
    monkeypatch.setattr(divergence, "TIED", tied)
    rng = np.random.default_rng(1)
    rows = {(f"g{int(g)}", f"{'é' * int(a % 3)}t{int(a)}", int(v)) for g, a, v in zip(rng.integers(0, 5, 3000), rng.integers(0, 700, 3000), rng.choice([0, 1, 65535, 65536, 10**9, 7 * 65536 + 3], 3000), strict=True)}
    rows = list({(g, i): v for g, i, v in rows}.items())
    rows = [(g, i, v) for (g, i), v in rows] + [("alone", "x", 5)]
    got = divergence.leading(spark.createDataFrame(rows, "g string, item string, value long"), ["g"], 10).collect()
    want = []
    for g in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1].encode()))[:10]
        want += [(*r, i) for i, r in enumerate(mine, 1)]
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("name", ["op11_fingerprints", "op13_divergence"])
def test_queries_equal_their_sql(spark, sf_dir, name):
    same(entries.QUERIES[name](spark, sf_dir), connect(sf_dir), entries.ORACLE_SQL[name])


def test_whitening_of_the_table(spark, sf_dir):
    got = entries.op12_whitening(spark, sf_dir)
    n = table(spark, sf_dir, "embeddings").count()
    assert got.count() == 32 * n and got.agg(F.max("identity_error")).first()[0] < 1e-10

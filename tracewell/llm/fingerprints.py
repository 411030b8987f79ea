"""Document fingerprints: a quartile bucket digest.

Every triplet of neighbouring bytes of a text is hashed into one of BUCKETS buckets and counted. The digest is the length
code (a logarithm of the bytes) and two bits for each bucket: how many of the three quartiles of the text's own bucket
counts its count exceeds. Two digests differ by the sum of their bucket steps and of their length steps (at most
LENGTH_STEPS), divided by the most that the same buckets could differ; likeness is one minus that, so it lies from 0 to 1,
and equal digests have 1.

``compared`` sets each document against its next one, in ascending doc_id. Texts move once, compressed: rows are sorted by
ranges of doc_id, each task hands a text to the row before it, and the last row of a range meets the first one of the next
range that has rows by a join on the range's number, so no window over all rows is needed. One number for each range goes
to the driver.

Defined cases: a null text is empty; the empty text has a digest of its own, which is like itself (1) and like no other
(0). A text of one or two bytes counts as one triplet, filled up by zero bytes. Rows of the same doc_id stand in an order
that their texts decide; null ids come first. A table of one row is its own next document. Texts of any length are counted
whole, in pieces of bounded memory. Repeated rows stay; extra columns of any name are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import persisted, python_batches

BUCKETS = 1024
#: Bucket of a triplet of bytes a, b, c: the bits of (65536 a + 256 b + c) * MULTIPLIER from SHIFT on, so that SQL can state it.
MULTIPLIER, SHIFT = 2_654_435_761, 20
#: Base of the length code's logarithm, and what a difference of lengths adds at most.
LENGTH_BASE, LENGTH_STEPS = 1.25, 24
#: Bytes of text that are counted at once.
PIECE = 1 << 20


def bucket_counts(texts: list[bytes]) -> np.ndarray:
    """Triplets of each text by bucket."""
    out = np.zeros((len(texts), BUCKETS), np.int64)
    group, size, first = [], 0, 0

    def count() -> None:
        flat = np.frombuffer(b"".join(group), np.uint8).astype(np.uint64)
        if len(flat) >= 3:
            owner = np.repeat(np.arange(first, first + len(group)), [len(x) for x in group])
            bucket = ((flat[:-2] << np.uint64(16) | flat[1:-1] << np.uint64(8) | flat[2:]) * np.uint64(MULTIPLIER) >> np.uint64(SHIFT)).astype(np.int64) % BUCKETS
            one = owner[:-2] == owner[2:]
            found = np.bincount((owner[:-2][one] - first) * BUCKETS + bucket[one], minlength=len(group) * BUCKETS)
            out[first : first + len(group)] += found.reshape(len(group), BUCKETS)

    for i, x in enumerate(texts):
        x = x if len(x) > 2 or not x else x.ljust(3, b"\0")
        for at in range(0, max(1, len(x) - 2), PIECE):  # pieces share the two bytes that a triplet reaches over
            if group and (at or size + len(x) > PIECE):
                count()
                group, size, first = [], 0, i
            group.append(x[at : at + PIECE + 2])
            size += len(group[-1])
    if group:
        count()
    return out


def length_code(size: int) -> int:
    return min(255, 1 + int(math.log(size) / math.log(LENGTH_BASE))) if size else 0


def codes(texts: list[bytes]) -> np.ndarray:
    """A row for each text: its length code, then the quartile codes of its buckets."""
    counts = bucket_counts(texts)
    ranked = np.sort(counts, axis=1)
    out = np.zeros((len(texts), BUCKETS + 1), np.int16)
    for k in (1, 2, 3):
        out[:, 1:] += counts > ranked[:, BUCKETS * k // 4 - 1, None]
    out[:, 0] = [length_code(len(x)) for x in texts]
    return out


def digests(rows: np.ndarray) -> list[str]:
    """Codes as hexadecimal text: two digits of length, then four buckets a byte."""
    q = rows[:, 1:].reshape(len(rows), -1, 4)
    packed = (q[:, :, 0] << 6 | q[:, :, 1] << 4 | q[:, :, 2] << 2 | q[:, :, 3]).astype(np.uint8)
    return [f"{int(n):02x}{p.tobytes().hex()}" for n, p in zip(rows[:, 0], packed, strict=True)]


def parsed(texts: list[str]) -> np.ndarray:
    """The codes of digests."""
    flat = np.frombuffer(bytes.fromhex("".join(texts)), np.uint8).reshape(len(texts), 1 + BUCKETS // 4)
    q = np.stack([flat[:, 1:] >> s & 3 for s in (6, 4, 2, 0)], axis=2).reshape(len(texts), BUCKETS)
    return np.concatenate([flat[:, :1], q], axis=1).astype(np.int16)


def likenesses(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One minus the bounded difference score of rows of codes."""
    steps = np.minimum(np.abs(a[:, 0] - b[:, 0]), LENGTH_STEPS).astype(np.int64)
    differ = np.abs(a[:, 1:] - b[:, 1:]).sum(1, dtype=np.int64) + steps
    most = np.maximum(a[:, 1:], b[:, 1:]).sum(1, dtype=np.int64) + steps
    return 1.0 - differ / np.maximum(most, 1)


def fingerprinted(docs: DataFrame, text: str = "text", into: str = "fingerprint") -> DataFrame:
    """docs with the digest of a text column; nothing moves."""

    @F.pandas_udf("string")
    def digest(s: pd.Series) -> pd.Series:
        return pd.Series(digests(codes([x.encode() for x in s.fillna("")])), dtype=object)

    python_batches(docs.sparkSession)
    return docs.withColumn(into, digest(F.col(text)))


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two digest columns, 0 to 1; null where one is null."""

    @F.pandas_udf("double")
    def compare(x: pd.Series, y: pd.Series) -> pd.Series:
        known = x.notna() & y.notna()
        out = pd.Series(np.full(len(x), np.nan)).astype(object).where(lambda v: v.notna(), None)
        if known.any():
            out[known.to_numpy()] = likenesses(parsed(list(x[known])), parsed(list(y[known])))
        return out

    return compare(a, b)


#: What compared() adds to the id.
RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: Characters of texts that are held before they are compared.
HELD = 4 << 20


def edited(text: str, after: str) -> str:
    """The text with its last half replaced by the first characters of the next one."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def comparison(pairs: list[tuple[str, str]]) -> list[tuple]:
    """The result columns of texts and their next texts."""
    texts, made, after = ([x.encode() for x in side] for side in ([a for a, _ in pairs], [edited(a, b) for a, b in pairs], [b for _, b in pairs]))
    own, ed, nx = codes(texts), codes(made), codes(after)
    return list(zip([len(a) for a, _ in pairs], [hashlib.sha256(x).hexdigest() for x in made], digests(own), digests(ed), likenesses(own, ed).tolist(), likenesses(own, nx).tolist(), strict=True))


NAMES = [x.split()[0] for x in RESULT.split(", ")]
TYPES = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def columns(found: list[tuple]) -> list[pa.Array]:
    cols = zip(*found, strict=True) if found else [()] * len(TYPES)
    return [pa.array(c, t) for c, t in zip(cols, TYPES, strict=True)]


def compared(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    python_batches(spark)

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=3)
        for b in batches:
            raw = [x.as_buffer() for x in b.column("text").cast(pa.binary())]
            yield pa.record_batch([b.column("doc_id"), b.column("tie"), pa.array([len(x) for x in raw], pa.int64()), pa.array([codec.compress(x, asbytes=True) for x in raw], pa.binary())], names=["doc_id", "tie", "size", "packed"])

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, part = pa.Codec("zstd"), TaskContext.get().partitionId()
        ids, pairs, held, last = [], [], 0, None

        def rows(ids: list, pairs: list, edge: str | None, text: str | None) -> pa.RecordBatch:
            found, n = comparison(pairs) if pairs else [(None,) * len(NAMES)] * len(ids), len(ids)
            return pa.record_batch([pa.array(ids, id_type), *columns(found), pa.array([part] * n, pa.int32()), pa.array([edge] * n, pa.string()), pa.array([text] * n, pa.string())], names=["doc_id", *NAMES, "part", "edge", "text"])

        for b in batches:
            id_type = b.schema.field("doc_id").type
            for key, size, packed in zip(b.column("doc_id").to_pylist(), b.column("size").to_pylist(), b.column("packed"), strict=True):
                text = codec.decompress(packed.as_buffer(), size, asbytes=True).decode() if size else ""
                if last is None:
                    yield rows([key], [], "first", text)
                else:
                    ids.append(last[0])
                    pairs.append((last[1], text))
                    held += len(last[1])
                    if held >= HELD or len(ids) >= 1000:
                        yield rows(ids, pairs, None, None)
                        ids, pairs, held = [], [], 0
                last = (key, text)
        if ids:
            yield rows(ids, pairs, None, None)
        if last is not None:
            yield rows([last[0]], [], "last", last[1])

    text = F.coalesce("text", F.lit(""))
    packed = docs.select("doc_id", F.struct(F.xxhash64(text), F.crc32(text.cast("binary"))).alias("tie"), text.alias("text")).mapInArrow(shrink, f"doc_id {kind}, tie struct<a:bigint,b:bigint>, size bigint, packed binary")
    ranged = packed.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    done = persisted(ranged.mapInArrow(follow, f"doc_id {kind}, {RESULT}, part int, edge string, text string"), "fingerprints")
    parts = sorted(r["part"] for r in done.where("edge = 'first'").select("part").collect())
    after = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, after int")
    first = done.where("edge = 'first'").select(F.col("part").alias("after"), F.col("text").alias("next_text"))
    ends = done.where("edge = 'last'").select("doc_id", "text", "part").join(F.broadcast(after), "part").join(first, "after").select("doc_id", "text", "next_text")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = comparison(list(zip(b.column("text").to_pylist(), b.column("next_text").to_pylist(), strict=True)))
            yield pa.record_batch([b.column("doc_id"), *columns(found)], names=["doc_id", *NAMES])

    inner = done.where("edge is null").drop("part", "edge", "text")
    return inner.unionByName(ends.mapInArrow(finish, f"doc_id {kind}, {RESULT}"))


def oracle_sql() -> str:
    """The same result in DuckDB, from the bytes of each text as hexadecimal digits."""
    steps = f"least(abs(a.size_code - b.size_code), {LENGTH_STEPS})"
    near = f"1 - (sum(abs(a.code - b.code)) + any_value({steps})) / greatest(sum(greatest(a.code, b.code)) + any_value({steps}), 1)"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, coalesce(text, '') AS t FROM documents),
e AS MATERIALIZED (SELECT r, doc_id, t, len(t) AS n, coalesce(lead(r) OVER (ORDER BY r), 1) AS after, coalesce(lead(t) OVER (ORDER BY r), first_value(t) OVER (ORDER BY r)) AS nx FROM d),
x AS MATERIALIZED (SELECT r AS id, t AS s FROM e UNION ALL SELECT -r, left(t, CAST(n - n // 2 AS BIGINT)) || left(nx, CAST(n // 2 AS BIGINT)) FROM e),
y AS MATERIALIZED (SELECT id, sha256(s) AS sha, octet_length(encode(s)) AS size, regexp_extract_all(rpad(hex(encode(s)), CAST(CASE WHEN s = '' THEN 0 ELSE greatest(6, 2 * octet_length(encode(s))) END AS INT), '0'), '..') AS h FROM x),
z AS MATERIALIZED (SELECT id, sha, CASE WHEN size = 0 THEN 0 ELSE least(255, 1 + CAST(floor(ln(size) / ln({LENGTH_BASE})) AS INT)) END AS size_code, h FROM y),
c AS (SELECT id, ((CAST('0x' || h[i] || h[i+1] || h[i+2] AS BIGINT) * {MULTIPLIER}) >> {SHIFT}) % {BUCKETS} AS b, count(*) AS n FROM (SELECT id, h, unnest(range(1, len(h) - 1)) AS i FROM z) GROUP BY ALL),
g AS MATERIALIZED (SELECT z.id, z.size_code, k.b, coalesce(c.n, 0) AS n FROM z CROSS JOIN (SELECT unnest(range({BUCKETS})) AS b) k LEFT JOIN c ON c.id = z.id AND c.b = k.b),
o AS (SELECT id, n, row_number() OVER (PARTITION BY id ORDER BY n) AS k FROM g),
q AS (SELECT id, max(n) FILTER (k = {BUCKETS // 4}) AS q1, max(n) FILTER (k = {BUCKETS // 2}) AS q2, max(n) FILTER (k = {BUCKETS * 3 // 4}) AS q3 FROM o GROUP BY id),
v AS MATERIALIZED (SELECT id, size_code, b, CAST(n > q1 AS INT) + CAST(n > q2 AS INT) + CAST(n > q3 AS INT) AS code FROM g JOIN q USING (id)),
f AS (SELECT id, any_value(printf('%02x', size_code)) || string_agg(printf('%02x', s), '' ORDER BY w) AS print FROM (SELECT id, size_code, b // 4 AS w, CAST(sum(code << (6 - 2 * (b % 4))) AS INT) AS s FROM v GROUP BY ALL) GROUP BY id),
m AS (SELECT a.id AS r, {near} AS near_edited FROM v a JOIN v b ON b.id = -a.id AND b.b = a.b WHERE a.id > 0 GROUP BY a.id),
l AS (SELECT a.id AS r, {near} AS near_next FROM v a JOIN e ON e.r = a.id JOIN v b ON b.id = e.after AND b.b = a.b GROUP BY a.id)
SELECT e.doc_id, e.n AS n_chars, z.sha AS edited_sha256, fa.print AS fingerprint, fb.print AS edited_fingerprint, m.near_edited, l.near_next
FROM e JOIN z ON z.id = -e.r JOIN f fa ON fa.id = e.r JOIN f fb ON fb.id = -e.r JOIN m ON m.r = e.r JOIN l ON l.r = e.r"""

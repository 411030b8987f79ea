"""Packing along a space-filling curve.

Each document's hashed token counts are projected to four dimensions; the Hilbert key of that point orders the corpus, and
documents are laid end to end along the curve and cut every ``length`` tokens. So neighbours in content share sequences,
and only the last sequence is short.

Order and positions are settled on narrow rows (key, id, token count); token ids cross the cluster once, compressed, when
each document meets its position. Ties of the key go by doc_id, then by row, so a third of all rows may share one key:
range boundaries fall inside it.

Ids are those of the tokenizer as it is, so the string of a special token in a text gives that token's id. Such texts, and
those with a run of 3,000 characters without white space, go through the tokenizer itself; all others through ranks made
from its file, which give the same ids. Texts of any length are encoded whole.

Defined cases: a null text counts as empty and yields the end id alone; repeated rows are packed as often as they occur;
an empty table gives no pieces; a null id stays null and sorts first. Extra columns of any name are ignored.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from tracewell.llm.common import persisted, python_batches, starts

END = 0
DIMENSIONS, BITS, BUCKETS = 4, 12, 1024
#: Fixed value: how byte-level tokenizers split text before merging.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Runs without white space that the merge loop of the rank encoder would take quadratic time for.
LONG_RUN = re.compile(r"\S{3000}")


@functools.lru_cache(maxsize=2)
def whole_tokenizer(json_path: str) -> Tokenizer:
    """The tokenizer itself."""
    return Tokenizer.from_file(json_path)


@functools.lru_cache(maxsize=2)
def added_tokens(json_path: str) -> tuple[str, ...]:
    """Strings that the tokenizer cuts out of a text before it splits the rest."""
    import json

    with open(json_path, encoding="utf-8") as f:
        return tuple(t["content"] for t in json.load(f).get("added_tokens", []))


@functools.lru_cache(maxsize=2)
def ranked(json_path: str) -> tiktoken.Encoding | None:
    """The same vocabulary and merges as ranks, which give the same ids several times faster (tested); None if the file is of another kind.

    Ranks are taken from the tokenizer's own file, where that is byte-level BPE without a prefix space whose merges are in id order.
    """
    import json

    with open(json_path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    if spec["model"].get("type") not in (None, "BPE") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
        return None
    vocabulary, merges = spec["model"]["vocab"], spec["model"]["merges"]
    joined = [m if isinstance(m, str) else " ".join(m) for m in merges]
    ids = [vocabulary[m.replace(" ", "")] for m in joined]
    if ids != sorted(ids):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    to_byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(to_byte[c] for c in w): i for w, i in vocabulary.items() if w not in special}
    return tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})


def token_ids(text: str | None, json_path: str) -> np.ndarray:
    """Ids of the whole text, then the end id, as little-endian unsigned 32-bit numbers."""
    fast = ranked(json_path)
    text = text or ""
    if fast is None or LONG_RUN.search(text) or any(t in text for t in added_tokens(json_path)):
        return np.array([*whole_tokenizer(json_path).encode(text, add_special_tokens=False).ids, END], "<u4")
    return np.append(fast.encode_to_numpy(text, disallowed_special=()), END).astype("<u4")


@functools.lru_cache(maxsize=1)
def _projection() -> np.ndarray:
    return np.random.default_rng(20240607).standard_normal((BUCKETS, DIMENSIONS))


def point(ids: np.ndarray) -> np.ndarray:
    """Square roots of hashed token counts, scaled to length one and projected."""
    counts = np.bincount((ids.astype(np.uint64) * np.uint64(2654435761) >> np.uint64(16)) % np.uint64(BUCKETS), minlength=BUCKETS)
    v = np.sqrt(counts)
    return (v / np.linalg.norm(v)) @ _projection()


def hilbert(points: np.ndarray, span: float = 4.0) -> np.ndarray:
    """Hilbert keys of rows with DIMENSIONS coordinates, each cut to BITS bits over -span..span."""
    top = (1 << BITS) - 1
    x = np.clip((points + span) / (2 * span) * top, 0, top).astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (BITS - 1)
    while q > 1:  # undo excess work, from coordinates to the transposed key
        p = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            t = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] ^= t
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (BITS - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(BITS - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def tokenized(docs: DataFrame, json_path: str) -> DataFrame:
    """doc_id, key, n (tokens), ids (compressed), written to the shared folder with a row number of its own."""
    python_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 100):
                part = b.slice(at, 100)
                ids = [token_ids(t.as_py(), json_path) for t in part.column("text")]
                keys = hilbert(np.array([point(x) for x in ids]))
                packed = [zlib.compress((x.astype("<u2") if x.max() < 65536 else x).tobytes(), 1) for x in ids]
                yield pa.record_batch([part.column("doc_id"), pa.array(keys, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([2 if x.max() < 65536 else 4 for x in ids], pa.int32()), pa.array(packed, pa.binary())], names=["doc_id", "key", "n", "width", "ids"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, key long, n long, width int, ids binary")
    return persisted(out.withColumn("row", F.monotonically_increasing_id()), "pack")


def positions(rows: DataFrame) -> DataFrame:
    """row, position: tokens before each row of (row, doc_id, key, n) along the curve.

    Ranges get a running sum each; what goes to the driver is one number for each range.
    """
    order = ["key", "doc_id", "row"]
    ranged = persisted(rows.select("row", "doc_id", "key", "n").repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "pack")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = starts(ranged.groupBy("part").agg(F.sum("n").alias("n")))
    # two numbers for each range, so the broadcast is bounded by the number of partitions
    return ranged.select("row", "part", before.alias("before")).join(F.broadcast(first), "part").select("row", (F.col("before") + F.col("start")).alias("position"))


def packed(docs: DataFrame, json_path: str, length: int = 1024) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row for each piece."""
    rows = tokenized(docs, json_path)
    placed = rows.select("row", "doc_id", "n", "width", "ids").join(positions(rows), "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for doc, n, width, ids, p in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n", "width", "ids", "position")), strict=True):
                x = np.frombuffer(zlib.decompress(ids), f"<u{width}").astype("<u4")
                a = 0
                while a < n:
                    size = min(length - (p + a) % length, n - a)
                    out.append((doc, a, size, zlib.crc32(x[a : a + size].tobytes()), n, (p + a) // length, (p + a) % length))
                    a += size
            if out:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=PIECES)

    return placed.mapInArrow(run, ", ".join(f"{c} long" for c in PIECES))


PIECES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

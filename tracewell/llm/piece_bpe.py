"""SentencePiece encoding and decoding for merge-type (BPE) models, by backtracking.

A chunk is encoded without running its merges: Aho-Corasick gives every vocabulary piece that matches, the longest piece
is tried first at each position, two neighbouring pieces must be compatible (re-merging their joined text gives back just
these two), and a bitfield keeps the positions from which no encoding goes on, so that none is tried twice.

A text is cut where no merge can reach across: before the space symbol after another character, and around characters
that occur in no longer piece. Both rules are read off the vocabulary, and each chunk's result is kept in a bounded cache.

Defined cases: a null text counts as empty; an empty text has no ids and decodes to an empty text. A character outside the
vocabulary becomes its UTF-8 bytes' pieces, or the unknown piece in models without them. Texts of any length are encoded
whole. Extra columns of any name are ignored; rows are neither dropped nor merged.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import python_batches

SPACE = "▁"
LETTER = re.compile(r"[^\W\d_]")
CACHE_CHUNKS, CACHE_CHARS, CACHE_PAIRS = 300_000, 64, 500_000


def normalizer(model: bytes) -> dict:
    """The normalizer_spec (field 3) of a model file: name, add_dummy_prefix, remove_extra_whitespaces, escape_whitespaces."""

    def fields(data: bytes) -> Iterator[tuple[int, object]]:
        i = 0

        def varint() -> int:
            nonlocal i
            out = shift = 0
            while True:
                b = data[i]
                i += 1
                out |= (b & 127) << shift
                shift += 7
                if b < 128:
                    return out

        while i < len(data):
            tag = varint()
            kind = tag & 7
            if kind == 0:
                yield tag >> 3, varint()
            elif kind == 2:
                n = varint()
                yield tag >> 3, data[i : i + n]
                i += n
            else:
                n = 8 if kind == 1 else 4
                yield tag >> 3, data[i : i + n]
                i += n

    spec = dict(fields(next((v for k, v in fields(model) if k == 3), b"")))
    return {"name": spec.get(1, b"").decode(), "charsmap": spec.get(2, b""), "prefix": bool(spec.get(3, 1)), "squeeze": bool(spec.get(4, 1)), "escape": bool(spec.get(5, 1))}


class Encoder:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        spec = normalizer(data)
        if spec["charsmap"] or spec["squeeze"] or not spec["escape"]:
            raise NotImplementedError(f"only identity normalisation is supported, not {spec['name']!r}")
        sp = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.prefix = spec["prefix"]
        n = sp.vocab_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(n)]
        pieces = [sp.id_to_piece(i) for i in range(n)]
        self.ids = {p: i for i, (p, s) in enumerate(zip(pieces, special, strict=True)) if not s}
        self.shown = {p: (str(i), p.replace(SPACE, " ")) for p, i in self.ids.items()}
        self.rank = {p: -sp.get_score(i) for p, i in self.ids.items()}
        self.bytes = {int(p[1:-1], 16): i for i, p in enumerate(pieces) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.pieces = pieces
        self.unknown = sp.unk_id()
        self.unknown_text = " ⁇ "
        self.auto = ahocorasick.Automaton()
        for p in self.ids:
            self.auto.add_word(p, len(p))
        self.auto.make_automaton()
        joined = {c for p in self.ids if len(p) > 1 for c in p}
        alone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in joined)
        follow = "".join(sorted({re.escape(b) for p in self.ids for a, b in zip(p, p[1:], strict=False) if LETTER.match(a) and not LETTER.match(b) and b != SPACE}))
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            word = f"[^{alone}]+" if alone else ".+"
        else:  # letters, after them only what some piece has after a letter
            letter, other = LETTER.pattern + "+", f"(?:(?![{SPACE}{alone}])[\\W\\d_])"
            run = f"(?:{letter}(?:[{follow}]{other}*)?)" if follow else f"(?:{letter})"
            word = f"{SPACE}*(?:{run}+|{other}+{run}*)|{SPACE}+"
        self.chunk = re.compile(f"{word}|[{alone}]" if alone else word, re.DOTALL)
        self.cache: dict[str, tuple[str, int, str]] = {}
        self.older: dict[str, tuple[str, int, str]] = {}
        self.pairs: dict[tuple[str | None, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """Plain merging: the best-ranked pair first, the leftmost of equals."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best = min(((rank.get(parts[i] + parts[i + 1], float("inf")), i) for i in range(len(parts) - 1)))
            if best[0] == float("inf"):
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def compatible(self, a: str | None, b: str) -> bool:
        key = (a, b)
        ok = self.pairs.get(key)
        if ok is None:
            ok = self.merged(b) == [b] if a is None else self.merged(a + b) == [a, b]
            if len(self.pairs) >= CACHE_PAIRS:  # wrong pairs are kept too, so that each is merged once
                self.pairs.clear()
            self.pairs[key] = ok
        return ok

    def split(self, chunk: str) -> list[str]:
        """Pieces of a chunk, by backtracking."""
        n = len(chunk)
        at: list[list[int] | None] = [None] * (n + 1)  # lengths that match at each position, shortest first
        for end, size in self.auto.iter(chunk):
            start = end - size + 1
            if at[start] is None:
                at[start] = [size]
            else:
                at[start].append(size)
        failed = bytearray((n >> 3) + 1)
        pos, out, pairs = 0, [], self.pairs
        last = None
        while pos < n:
            sizes = at[pos]
            if sizes is None:  # outside the vocabulary: stands alone and merges with nothing
                sizes = at[pos] = [1]
            while sizes:
                end = pos + sizes.pop()  # a position is entered once until it fails, so what is left here stays its own
                piece = chunk[pos:end]
                if not failed[end >> 3] >> (end & 7) & 1 and (pairs.get((last, piece)) or self.compatible(last, piece)):
                    out.append(piece)
                    last, pos = piece, end
                    break
            else:
                failed[pos >> 3] |= 1 << (pos & 7)
                if not out:
                    raise AssertionError("no encoding")
                pos -= len(out.pop())
                last = out[-1] if out else None
        return out

    def ids_of(self, piece: str) -> list[int]:
        i = self.ids.get(piece)
        if i is not None:
            return [i]
        return [self.bytes[b] for b in piece.encode()] if self.bytes else [self.unknown]

    def chunk_result(self, chunk: str) -> tuple[str, int, str]:
        """Ids joined by commas, their number, the decoded text."""
        got = self.cache.get(chunk)
        if got is None:
            got = self.older.get(chunk)
            if got is not None:
                self.keep(chunk, got)
                return got
            one = self.shown.get
            parts = [one(p) for p in self.split(chunk)]
            if None in parts:
                ids = [i for p in self.split(chunk) for i in self.ids_of(p)]
                got = (",".join(map(str, ids)), len(ids), self.decode_ids(ids))
            else:
                got = (",".join([p[0] for p in parts]), len(parts), "".join([p[1] for p in parts]))
            if len(chunk) <= CACHE_CHARS:
                self.keep(chunk, got)
        return got

    def keep(self, chunk: str, got: tuple[str, int, str]) -> None:
        """Two generations: a full cache becomes the older one, from which chunks in use come back."""
        if len(self.cache) >= CACHE_CHUNKS:
            self.older, self.cache = self.cache, {}
        self.cache[chunk] = got

    def chunks(self, text: str) -> list[str]:
        if not text:
            return []
        return self.chunk.findall((SPACE if self.prefix else "") + text.replace(" ", SPACE))

    def encode(self, text: str) -> list[int]:
        return [i for c in self.chunks(text) for i in map(int, self.chunk_result(c)[0].split(","))]

    def decode_ids(self, ids: list[int]) -> str:
        """Text of ids with the space symbol as space; the dummy prefix is still there."""
        out, run = [], bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                run.append(b)
                continue
            if run:
                out.append(run.decode(errors="replace"))
                run.clear()
            out.append(self.unknown_text if i == self.unknown else self.pieces[i].replace(SPACE, " "))
        if run:
            out.append(run.decode(errors="replace"))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        text = self.decode_ids(ids)
        return text[1:] if self.prefix and text.startswith(" ") else text

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, sha256 of the joined ids, sha256 of the decoded text."""
        cached, one = self.cache.get, self.chunk_result  # a cache replaced meanwhile is still right
        parts = [cached(c) or one(c) for c in self.chunks(text or "")]
        decoded = "".join([p[2] for p in parts])
        if self.prefix and decoded.startswith(" "):
            decoded = decoded[1:]
        return sum([p[1] for p in parts]), hashlib.sha256(",".join([p[0] for p in parts]).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process and model file; the path must hold on every machine."""
    return Encoder(path)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    python_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            got = [e.digest(t.as_py()) for t in b.column("text")]
            yield pa.record_batch([b.column("doc_id"), pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.string()), pa.array([x[2] for x in got], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array), decoded (text): the operator's full result."""
    python_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            ids = [e.encode(t.as_py() or "") for t in b.column("text")]
            yield pa.record_batch([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([e.decode(x) for x in ids], pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")

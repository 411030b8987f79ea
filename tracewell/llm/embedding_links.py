"""Near-duplicate vectors by an inverted multi-index.

Two codebooks, one for each half of the vectors, form a product grid; every vector is indexed in its cell. A query visits
cells in order of its distance to their codeword pairs (multi-sequence traversal) until the target recall is reached, and
meets the vectors there exactly, in blocks of bounded size. The distance at which a traversal stops is set on the sample
that the codebooks are fitted on: vectors turned to just the threshold's angle must be found with the target rate. Each
length of vector has codebooks of its own; their number of codewords grows with the label groups, so that a cell holds
about CELL_ROWS vectors of a group.

Equal vectors collapse first and count by weight. A block returns counts for each vector and spanning links, never pairs,
so a group of near copies of any size costs matrix products only; a crowded cell is cut into parts that meet in pairs.

The bounds are on what is learned from: SAMPLE_ROWS rows and SAMPLE_NUMBERS numbers over all lengths, and MOST_CODES
codewords for a half. Every vector is indexed. Beyond MOST_CODES, cells grow with the corpus, and crowded cells are cut.

Defined cases: a cosine of exactly the threshold links. Vectors that are null, empty, zero or hold null or non-finite numbers, and those with a null label or a null
id, link with nothing (n_links 0; their component is their own id). Vectors of different lengths never link. Repeated rows
are vectors of their own and link with each other. Extra columns of any name are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import grouped, persisted, python_batches
from tracewell.llm.components import connected_components

#: Numbers in the sample that codebooks are fitted on, at most, and its rows.
SAMPLE_NUMBERS, SAMPLE_ROWS = 4_000_000, 20_000
#: Vectors of one cell aimed at, rows of one part of a crowded cell, and codewords of a half at most.
CELL_ROWS, PART_ROWS, MOST_CODES = 64, 2048, 1024
TARGET_RECALL = 0.9999
#: Lengths of vectors that get a grid, the commonest first; groups of another length are compared whole, in parts.
MOST_LENGTHS = 50


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(5)
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = (-2 * x @ centres.T + (centres**2).sum(1)).argmin(1)
        for j in range(k):
            own = x[near == j]
            if len(own):
                centres[j] = own.mean(0)
    return centres


class MultiIndex:
    """Codebooks of the two halves and the limit of a traversal."""

    def __init__(self, sample: np.ndarray, codes: int, threshold: float, recall: float = TARGET_RECALL):
        self.dim = sample.shape[1] if len(sample) else 0
        self.half = self.dim // 2
        codes = max(1, min(codes, len(sample)))
        codes = min(codes, len(np.unique(sample, axis=0))) if len(sample) else 1
        self.books = [kmeans(h, codes) for h in (sample[:, : self.half], sample[:, self.half :])] if len(sample) and self.half else []
        self.limit = self._limit(sample, threshold, recall) if self.books else 0.0

    def excess(self, x: np.ndarray) -> list[np.ndarray]:
        """For each half, squared distances to the codewords less the least one."""
        out = []
        for book, h in zip(self.books, (x[:, : self.half], x[:, self.half :]), strict=True):
            d = -2 * h @ book.T + (book**2).sum(1)
            out.append(d - d.min(1, keepdims=True))
        return out

    def home(self, ex: list[np.ndarray]) -> np.ndarray:
        return ex[0].argmin(1) * len(self.books[1]) + ex[1].argmin(1)

    def _limit(self, sample: np.ndarray, threshold: float, recall: float) -> float:
        x = sample[:4000]
        noise = np.random.default_rng(9).standard_normal(x.shape)
        noise -= (noise * x).sum(1, keepdims=True) * x
        noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
        y = threshold * x + math.sqrt(max(0.0, 1 - threshold**2)) * noise
        a, b = self.excess(x), self.excess(y)
        rows = np.arange(len(x))
        there = a[0][rows, b[0].argmin(1)] + a[1][rows, b[1].argmin(1)]
        back = b[0][rows, a[0].argmin(1)] + b[1][rows, a[1].argmin(1)]
        return float(np.quantile(np.minimum(there, back), recall)) + 1e-9  # one of the two finding the other is enough

    def visited(self, e1: np.ndarray, e2: np.ndarray) -> list[int]:
        """Cells in order of distance up to the limit, by multi-sequence traversal of the two sorted halves."""
        o1, o2 = np.argsort(e1, kind="stable"), np.argsort(e2, kind="stable")
        s1, s2 = e1[o1].tolist(), e2[o2].tolist()
        heap, seen, out, width = [(s1[0] + s2[0], 0, 0)], {(0, 0)}, [], len(s2)
        while heap:
            d, i, j = heapq.heappop(heap)
            if d > self.limit:
                break
            out.append(int(o1[i]) * width + int(o2[j]))
            for p, q in ((i + 1, j), (i, j + 1)):
                if p < len(s1) and q < width and (p, q) not in seen:
                    seen.add((p, q))
                    heapq.heappush(heap, (s1[p] + s2[q], p, q))
        return out


def units(rows: list[bytes]) -> np.ndarray:
    """Rows of raw 32-bit floats as unit vectors in double precision."""
    x = np.frombuffer(b"".join(rows), np.float32).reshape(len(rows), -1).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # keeps squares within range
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def valid():
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def fit(reps: DataFrame, threshold: float) -> dict[int, MultiIndex]:
    """For each length of vector with a crowded group, codebooks from a bounded hash sample; reps: uid, group, dim, vec."""
    groups = reps.groupBy("group", "dim").agg(F.count("*").alias("n"))
    # the size of the group that a vector finds itself in, on average; lengths whose groups fit in a cell need no grid
    sizes = groups.groupBy("dim").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("mean")).where(F.col("mean") > CELL_ROWS).where("dim > 1")
    most = sizes.orderBy(F.desc("n"), "dim").limit(MOST_LENGTHS).collect()
    total = sum(r["n"] for r in most)
    out = {}
    for r in most:
        rows = min(r["n"], max(256, min(SAMPLE_ROWS, SAMPLE_NUMBERS // r["dim"]) * r["n"] // total))
        got = reps.where((F.col("dim") == r["dim"]) & (F.pmod(F.xxhash64("uid"), F.lit(1_000_003)) < rows / r["n"] * 1_000_003)).select("uid", "vec").collect()
        if got:
            sample = units([bytes(x["vec"]) for x in sorted(got, key=lambda x: x["uid"])])
            out[r["dim"]] = MultiIndex(sample, min(MOST_CODES, math.ceil(math.sqrt(r["mean"] / CELL_ROWS))), threshold)
    return out


def _indexed(reps: DataFrame, index: dict[int, MultiIndex]) -> DataFrame:
    """A row for each vector in its own cell and one for each further cell that it visits."""
    shared = reps.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            dims = b.column("dim").to_numpy()
            vecs = b.column("vec").to_pylist()
            cell = np.full(b.num_rows, -1)
            visits: list[list[int]] = [[] for _ in range(b.num_rows)]
            for dim in np.unique(dims).tolist():
                ix = shared.value.get(dim)
                if ix is None:
                    continue
                at = np.flatnonzero(dims == dim)
                ex = ix.excess(units([vecs[i] for i in at]))
                cell[at] = ix.home(ex)
                for k, i in enumerate(at):
                    visits[i] = [c for c in ix.visited(ex[0][k], ex[1][k]) if c != cell[i]]
            for i, (g, u, w) in enumerate(zip(*(b.column(c).to_pylist() for c in ("group", "uid", "weight")), strict=True)):
                own = int(cell[i])
                out.append((g, own, True, u, w, own, visits[i], vecs[i]))
                out.extend((g, c, False, u, w, own, None, vecs[i]) for c in visits[i])
            for k in range(0, len(out), 5000):
                cols = list(zip(*out[k : k + 5000], strict=True))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.binary()), strict=True)], names=["group", "cell", "home", "uid", "weight", "own", "visits", "vec"])

    return reps.mapInArrow(run, "group long, cell int, home boolean, uid long, weight long, own int, visits array<int>, vec binary")


def block(t: pa.Table, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(uid, links added, a uid of its component in this block) of the rows of one block that have links."""
    home = t.column("home").to_numpy(zero_copy_only=False)
    side = t.column("side").to_numpy()  # 1: as query, 2: as indexed vector
    uid, weight, own = (t.column(c).to_numpy() for c in ("uid", "weight", "own"))
    x = units(t.column("vec").to_pylist())
    q, h = np.flatnonzero(side == 1), np.flatnonzero(side == 2)
    if not len(q) or not len(h):
        return (np.zeros(0, np.int64),) * 3
    hit = (x[q] @ x[h].T >= threshold) & (uid[q][:, None] != uid[h][None, :])
    if not hit.any():
        return (np.zeros(0, np.int64),) * 3
    links = np.zeros(len(uid), np.int64)
    links[q] += hit @ weight[h]
    # an indexed vector that does not visit its visitor's cell learns of the link here
    cells = {c: k for k, c in enumerate(np.unique(own[q][~home[q]]).tolist())}
    if cells:
        mutual = np.zeros((len(cells) + 1, len(h)), bool)
        visits = t.column("visits").to_pylist()
        for k, i in enumerate(h):
            for c in visits[i] or ():
                if c in cells:
                    mutual[cells[c], k] = True
        mutual[-1] = True  # vectors of the same cell meet in both directions
        row = np.array([len(cells) if home[i] else cells[own[i]] for i in q])
        links[h] += (hit & ~mutual[row]).T @ weight[q]
    low = uid.copy()
    while True:  # smallest uid reachable over the block's links
        before = low.copy()
        big = np.iinfo(np.int64).max
        low[q] = np.minimum(low[q], np.where(hit, low[h][None, :], big).min(1))
        low[h] = np.minimum(low[h], np.where(hit, low[q][:, None], big).min(0))
        both: dict[int, int] = {}
        for u, v in zip(uid.tolist(), low.tolist(), strict=True):  # a row may stand on both sides
            both[u] = min(v, both.get(u, v))
        low = np.array([both[u] for u in uid.tolist()], np.int64)
        if (low == before).all():
            break
    keep = (links > 0) | (low != uid)
    return uid[keep], links[keep], low[keep]


def block_results(cells: DataFrame, threshold: float) -> DataFrame:
    """uid, links, low: partial counts and spanning links from every block."""
    sizes = cells.groupBy("group", "cell").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts"), F.sum(F.col("home").cast("int")).alias("homes"))
    # a cell where nothing is indexed answers nobody
    sized = cells.join(sizes.where("homes > 0"), ["group", "cell"]).withColumn("part", F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int"))
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    as_query = sized.withColumn("i", F.col("part")).withColumn("j", F.explode(every)).withColumn("side", F.lit(1))
    as_home = sized.where("home").withColumn("j", F.col("part")).withColumn("i", F.explode(every)).withColumn("side", F.lit(2))
    keys = ["group", "cell", "i", "j"]
    columns = [*keys, "side", "home", "uid", "weight", "own", "visits", "vec"]
    rows = as_query.select(*columns).unionByName(as_home.select(*columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in grouped(batches, keys):
            if g.num_rows > 2:
                uid, links, low = block(g, threshold)
                if len(uid):
                    yield pa.record_batch([pa.array(uid), pa.array(links), pa.array(low)], names=["uid", "links", "low"])

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "uid long, links long, low long")


def linked(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row; vectors: vec_id, embedding, label."""
    spark = vectors.sparkSession
    python_batches(spark)
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"), F.col("label").cast("string").alias("label"))
    ok = valid()
    v = v.withColumn("h1", F.when(ok, F.xxhash64("label", "embedding"))).withColumn("h2", F.when(ok, F.xxhash64(F.lit(17), "embedding", "label")))
    groups = v.where(ok).groupBy("h1", "h2").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"), F.first("embedding").alias("embedding"), F.first("label").alias("label"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vecs = [np.asarray(x, np.float32) for x in b.column("embedding").to_pylist()]
            yield pa.record_batch([*(b.column(c) for c in ("h1", "h2", "least", "weight", "label")), pa.array([len(x) for x in vecs], pa.int32()), pa.array([x.tobytes() for x in vecs], pa.binary())], names=["h1", "h2", "least", "weight", "label", "dim", "vec"])

    packed = groups.select("h1", "h2", "least", "weight", "label", "embedding").mapInArrow(pack, "h1 long, h2 long, least long, weight long, label string, dim int, vec binary")
    reps = persisted(packed.withColumn("group", F.xxhash64("label", "dim")).withColumn("uid", F.monotonically_increasing_id()), "emb")
    index = fit(reps, threshold)
    cells = persisted(_indexed(reps.select("group", "uid", "weight", "dim", "vec"), index), "emb")
    found = persisted(block_results(cells, threshold), "emb")
    counts = found.groupBy("uid").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("uid").alias("a"), F.col("low").alias("b")))
    known = reps.select("h1", "h2", "uid", "least", "weight").join(parts.select(F.col("node").alias("uid"), "component"), "uid", "left").join(counts, "uid", "left")
    known = persisted(known.select("h1", "h2", F.coalesce("component", "uid").alias("component"), "least", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")), "emb")
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(least, "component").select("h1", "h2", "component_id", "n_links")
    out = v.select("vec_id", "h1", "h2").join(known, ["h1", "h2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))

"""Embedding whitening from a tiled covariance.

Entries become whole numbers, x = floor(64 c) + 1000000, so sums and deviations are exact. The covariance is made in tiles:
dimensions are cut into column blocks of TILE, rows into row blocks of ROWS; each pair of column blocks is a tile. Column
blocks, centred before anything is multiplied, are shuffled by row block and tile, each task multiplies the pair of a tile,
and the products are summed by tile. A task holds two column blocks of one row block, whatever the number of rows and
dimensions; a hot label or id plays no part, as row blocks are cut by position. The assembled covariance, whose size is
the square of the dimensions and does not depend on the rows, goes to the driver, which finds its eigenvectors.

``whitened`` projects the centred rows on the leading components and divides by the root of the eigenvalue. The identity
error is measured by a second tiled covariance, over all whitened rows.

Defined cases: rows whose vector is null or holds null or non-finite entries are dropped, as are entries too large for a
whole number of 62 bits. Vectors need one length: the commonest (of equally common ones the longest) counts, and rows of
another are dropped. Components without variance (an eigenvalue within rounding of zero) are left out, so a table of one
row, or of equal rows, gives no rows; neither does an empty table. A deviation beyond the long type is null. Repeated rows
and null ids are rows like others; extra columns of any name are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import persisted, python_batches, release

#: Dimensions of a column block, and rows of a row block at most.
TILE, ROWS = 32, 1000
COMPONENTS = 32
SCALE, OFFSET = 64, 1_000_000
#: Products up to this size are made in machine integers, others exactly in Python's.
SAFE = 1 << 62
#: Eigenvalues below this share of the largest, times the dimensions, are rounding.
ROUNDING = 1e-14


def whole_vectors(rows: DataFrame) -> DataFrame:
    """vec_id and x, the whole-number vector, for every row that stays."""
    c = F.col("embedding")
    usable = c.isNotNull() & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float(1 << 56)))
    good = rows.where(usable & (F.size(c) > 0)).select("vec_id", c.alias("c"))
    length = good.groupBy(F.size("c").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    good = good.where(F.size("c") == (length["n"] if length else 0))
    return good.select("vec_id", F.transform("c", lambda v: F.floor(v.cast("double") * SCALE).cast("long") + OFFSET).alias("x"))


def matrix(column: pa.Array, kind: type = np.int64) -> np.ndarray:
    """A row for each list of an Arrow column; all have one length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0), kind)


def exact(a: np.ndarray, most: int) -> np.ndarray:
    """The array in machine integers if what is made of it stays within most, else in Python's."""
    return a if most < SAFE else a.astype(object)


def sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """Number of rows and exact sum of each dimension; one row for each batch and dimension is summed, one a dimension comes back."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = matrix(b.column("x"))
                s = exact(x, int(np.abs(x).max()) * len(x)).sum(0)
                yield pa.record_batch([pa.array(range(-1, len(s)), pa.int32()), pa.array([str(len(x)), *map(str, s.tolist())], pa.string())], names=["k", "s"])

    found = vectors.select("x").mapInArrow(add, "k int, s string").groupBy("k").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    by = {r["k"]: int(r["s"]) for r in found}
    n = by.pop(-1, 0)
    return n, [by[k] for k in sorted(by)]


def centred(x: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    """n * x - S, exactly."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, s), default=0)
    return exact(x, most) * n - np.array(s, np.int64 if most < SAFE else object)


def covariance(rows: DataFrame, column: str, n: int, s: list, whole: bool) -> np.ndarray:
    """Tiled covariance of an array column over all rows, with divisor n: centred by the sums s, exactly where entries are whole."""
    d = len(s)
    blocks = -(-d // TILE)
    mean = np.array(s, float) / n

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                x = matrix(b.column(column).slice(at, ROWS), np.int64 if whole else np.float64)
                z = (centred(x, n, s) / n).astype(float) if whole else x - mean
                sides = [np.ascontiguousarray(z[:, c * TILE : (c + 1) * TILE]).tobytes() for c in range(blocks)]
                tiles = [(i, j, c) for i in range(blocks) for j in range(i, blocks) for c in {i, j}]
                for t in range(0, len(tiles), 64):
                    some = tiles[t : t + 64]
                    yield pa.record_batch([pa.array([f"{part}-{k}"] * len(some)), *[pa.array([y[q] for y in some], pa.int32()) for q in range(3)], pa.array([len(x)] * len(some), pa.int32()), pa.array([sides[y[2]] for y in some], pa.binary())], names=["block", "i", "j", "c", "rows", "side"])
                k += 1

    def multiply(group: pa.Table) -> pa.Table:
        i, j, rows_ = (group.column(k)[0].as_py() for k in ("i", "j", "rows"))
        sides = {c: np.frombuffer(v.as_buffer(), float).reshape(rows_, -1) for c, v in zip(group.column("c").to_pylist(), group.column("side"), strict=True)}
        m = sides[i].T @ sides[j]
        a, b = np.indices(m.shape)
        return pa.table({"a": pa.array((a + i * TILE).ravel(), pa.int32()), "b": pa.array((b + j * TILE).ravel(), pa.int32()), "v": pa.array(m.ravel())})

    pieces = rows.select(column).mapInArrow(cut, "block string, i int, j int, c int, rows int, side binary")
    products = pieces.groupBy("block", "i", "j").applyInArrow(multiply, "a int, b int, v double")
    out = np.zeros((d, d))
    for a, b, v in products.groupBy("a", "b").agg(F.sum("v")).toPandas().itertuples(index=False):
        out[a, b] = out[b, a] = v / n
    return out


class Whitener:
    """Rows, sums, eigenvalues and eigenvectors (as columns) of a fit; explained is each component's share of the trace."""

    def __init__(self, n: int, s: list[int], v: np.ndarray | None = None, components: int = COMPONENTS):
        self.n, self.s = n, s
        values, vectors = np.linalg.eigh(v) if v is not None and v.size else (np.zeros(0), np.zeros((0, 0)))
        order = np.argsort(-values, kind="stable")[:components]
        order = [k for k in order if values[k] > ROUNDING * len(s) * values.max() and values[k] > 0]
        self.values, self.vectors = values[order], vectors[:, order]
        self.explained = self.values / np.trace(v) if len(order) else self.values


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitener:
    """The whitener of all whole-number vectors."""
    n, s = sums(vectors)
    return Whitener(n, s, covariance(vectors, "x", n, s, True) if n else None, components)


def whitened(vectors: DataFrame, model: Whitener) -> DataFrame:
    """vec_id, deviation and whitened, an array with an entry for each component, for every row."""
    n, s, project = model.n, model.s, model.vectors / np.sqrt(model.values)
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("x"))
            if not len(x):
                continue
            y = centred(x, n, s)
            most = int(np.abs(y).max())
            squares = (exact(y, most * most * y.shape[1]) ** 2).sum(1).tolist()
            w = (y / n).astype(float) @ project
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))
            yield pa.record_batch([b.column("vec_id"), pa.array([int(v) if v < 1 << 63 else None for v in squares], pa.int64()), values], names=["vec_id", "deviation", "whitened"])

    return vectors.mapInArrow(run, f"vec_id {kind}, deviation long, whitened array<double>")


def identity_error(rows: DataFrame, n: int, components: int) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity."""
    s = rows.select(*[F.sum(F.get("whitened", F.lit(k))) for k in range(components)]).first()
    return float(np.abs(covariance(rows, "whitened", n, list(s), False) - np.eye(components)).max())


def components(rows: DataFrame) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for every row that stays and each component."""
    python_batches(rows.sparkSession)
    vectors = persisted(whole_vectors(rows), "vectors")
    model = fit(vectors)
    k = len(model.values)
    made = whitened(vectors, model)
    made = persisted(made, "whitened") if k else rows.sparkSession.createDataFrame([], made.schema)
    release(vectors)
    error = identity_error(made, model.n, k) if k else 0.0
    share = F.get(F.array(*[F.lit(float(v)) for v in model.explained]).cast("array<double>"), F.col("pos"))
    out = made.select("vec_id", "deviation", F.posexplode("whitened").alias("pos", "value"))
    return out.select("vec_id", (F.col("pos") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", F.col("value").alias("whitened"), share.alias("explained"), F.lit(error).alias("identity_error"))

"""Near-duplicates by an LSH forest over MinHash signatures, confirmed on full shingle sets.

1. Texts with the same words collapse to one representative (a pre-aggregated group-by), so copies cost one row.
2. Each representative's signature stands in TREES sorted orders, each over PER_TREE values of its own. Rows with a common
   prefix of LEVELS[0] values form a region. A region that is too large for one task goes to a deeper prefix; inside a
   task its rows are sorted and cut at ever longer common prefixes until no run has more than CROWDED rows. Rows of a run,
   and the next NEAR rows of the order (those with the longest common prefixes) beyond it, are compared by signature.
   Runs that stay crowded to the end of their order are joined as they are.
3. Depth costs recall: a pair at the threshold shares d values of an order with probability s^d. So each row reports how deep
   it went in each order, and rows that would miss a pair with more than MISSED get further sorted orders, over other
   choices of the same values, until they would not. Pairs that compare well join one candidate cluster.
4. Inside each cluster pairs are confirmed exactly, in blocks of bounded size, as products of shingle incidence matrices.
   In clusters wider than a block, members linked to one lead are joined after one comparison each, and only the others
   meet everybody. Only spanning links leave a block, and components of those are the result.

A candidate cluster is a superset of the true groups, so leads and spanning trees lose nothing that the exact step could
find. A pair at the threshold is missed with probability of at most MISSED by all orders, and 5e-4 by the signatures.

Defined cases: texts without words (null, empty, blank) have an empty set and link with nothing; shorter texts than a
shingle are one shingle. Words are runs between ASCII white space, lower-cased over A-Z only; texts of any length are read
whole. A similarity of exactly the threshold links. Repeated rows are copies of each other; different texts under one id
are documents of their own that share a name. Rows with a null id link with nothing and have a null component. An empty
table gives no rows. Extra columns of any name are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import grouped, persisted, python_batches, release
from tracewell.llm.components import connected_components

SHINGLE = 5
TREES, PER_TREE = 12, 8
#: Prefixes by which rows are dealt out, and rows of a region that one task takes.
LEVELS, REGION_ROWS = (3, 5, 8), 2048
#: Rows of a run that are all compared, and neighbours beyond it.
CROWDED, NEAR = 512, 16
#: Probability with which all orders may miss a pair at the threshold.
MISSED = 1e-3
#: Values that a further order deals out by, and its whole length.
FURTHER_KEY, FURTHER_LENGTH = 8, 12
#: Shingles and rows of one part when a cluster is confirmed, and cells of one incidence matrix.
BLOCK_SHINGLES, BLOCK_ROWS, BLOCK_CELLS = 1_000_000, 2000, 8_000_000
CACHE_WORDS = 150_000

_rng = np.random.default_rng(7)
_MULTIPLIERS = _rng.integers(0, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A = _rng.integers(0, 2**63, TREES * PER_TREE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, TREES * PER_TREE, dtype=np.uint64)
_C = _rng.integers(0, 2**63, PER_TREE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_set(words: list[bytes]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles."""
    n = len(words)
    if n < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)], np.uint64) if n else np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    s = h[: n - SHINGLE + 1] * _MULTIPLIERS[0]
    for i in range(1, SHINGLE):
        s = s + h[i : n - SHINGLE + 1 + i] * _MULTIPLIERS[i]
    return np.unique(_mix(s))


def signature(shingles: np.ndarray) -> np.ndarray:
    out = np.full(TREES * PER_TREE, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(shingles), 2048):
        x = shingles[at : at + 2048, None] * _A + _B
        out = np.minimum(out, (x >> np.uint64(32)).min(0).astype(np.uint32))
    return out


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, c1 and c2 (hash of the words), n (set size), sig; written to the shared folder."""
    python_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c1, c2, n, sig = [], [], [], []
            for t in b.column("text"):
                w = words_of(t.as_py())
                s = shingle_set(w)
                one, two = digest(w)
                c1.append(one)
                c2.append(two)
                n.append(len(s))
                sig.append(signature(s).tobytes() if len(s) else b"")
            yield pa.record_batch([b.column("doc_id"), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.array(n, pa.int64()), pa.array(sig, pa.binary())], names=["doc_id", "c1", "c2", "n", "sig"])
        _words.clear()  # workers live on for other tasks

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, c1 long, c2 long, n long, sig binary")
    return persisted(out, "mh")


def _trees(reps: DataFrame) -> DataFrame:
    """A row for each tree: k3, k5, k8 (hashes of the order's first values), tree, rep, low (one byte of each value)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint32).reshape(b.num_rows, TREES, PER_TREE)
            low = [x.tobytes() for x in (sig & 255).astype(np.uint8).reshape(b.num_rows, -1)]
            for t in range(TREES):
                run_, keys = np.full(b.num_rows, t + 1, np.uint64), {}
                for i in range(PER_TREE):
                    run_ = _mix(run_ + sig[:, t, i].astype(np.uint64) * _C[i])
                    keys[i + 1] = run_.view(np.int64)
                yield pa.record_batch([*(pa.array(keys[d]) for d in LEVELS), pa.array(np.full(b.num_rows, t), pa.int32()), b.column("rep"), pa.array(low, pa.binary())], names=["k3", "k5", "k8", "tree", "rep", "low"])

    return reps.select("rep", "sig").mapInArrow(run, "k3 long, k5 long, k8 long, tree int, rep long, low binary")


def order_of(tree: int) -> np.ndarray:
    """The values of a signature in the sequence of one sorted order; those from TREES on are the further ones."""
    if tree < TREES:
        return np.arange(tree * PER_TREE, (tree + 1) * PER_TREE)
    return np.random.default_rng(1000 + tree).permutation(TREES * PER_TREE)[:FURTHER_LENGTH]


def _further(rows: DataFrame, count: int) -> DataFrame:
    """rep, low -> a row for each of ``count`` further orders: key (hash of its first values), tree, rep, low."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            low = np.frombuffer(b"".join(b.column("low").to_pylist()), np.uint8).reshape(b.num_rows, -1)
            for t in range(TREES, TREES + count):
                first = np.ascontiguousarray(low[:, order_of(t)[:FURTHER_KEY]]).view(np.uint64).ravel()
                key = _mix(_mix(first * _C[0] + np.uint64(t)) * _C[1])
                yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(np.full(b.num_rows, t), pa.int32()), b.column("rep"), b.column("low")], names=["key", "tree", "rep", "low"])

    return rows.select("rep", "low").mapInArrow(run, "key long, tree int, rep long, low binary")


def least_agreement(threshold: float) -> float:
    """Share of agreeing signature bytes that a pair at the threshold falls below with probability 5e-4."""
    k = TREES * PER_TREE
    s = threshold - 3.3 * math.sqrt(threshold * (1 - threshold) / k)
    return s + (1 - s) / 256


def _roots(n: int, pairs: Iterator[tuple[int, np.ndarray]]) -> list[int]:
    """Union-find over rows 0..n-1; pairs: (row, rows it links to)."""
    up = list(range(n))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, others in pairs:
        a = root(i)
        for j in others:
            b = root(int(j))
            if a != b:
                a, b = min(a, b), max(a, b)
                up[b] = a
    return [root(i) for i in range(n)]


def sorted_runs(order: np.ndarray, depth: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Rows in sorted order, and the runs (from, to, common prefix) that they are cut into: the shortest prefix from depth on that leaves no more than CROWDED."""
    at = np.lexsort(order.T[::-1])
    x, width = order[at], order.shape[1]
    differ = x[1:] != x[:-1]
    common = np.where(differ.any(1), differ.argmax(1), width)  # longest common prefix of neighbours
    todo, runs = [(0, len(x), depth)], []
    while todo:
        a, b, d = todo.pop()
        if b - a <= CROWDED or d >= width:
            runs.append((a, b, d))
            continue
        cuts = [a, *(a + 1 + np.flatnonzero(common[a : b - 1] <= d)).tolist(), b]
        todo += [(i, j, d + 1) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
    return at, runs


def region_links(low: np.ndarray, tree: int, depth: int, least: float) -> tuple[list[int], np.ndarray]:
    """(root of each row, depth that each row went to) in one region of an order."""
    n = len(low)
    if n <= CROWDED:
        return _roots(n, ((i, i + 1 + np.flatnonzero((low[i + 1 :] == low[i]).sum(1) >= least)) for i in range(n - 1))), np.full(n, depth)
    at, runs = sorted_runs(low[:, order_of(tree)], depth)
    m, deep = low[at], np.zeros(n, int)

    def pairs() -> Iterator[tuple[int, np.ndarray]]:
        for a, b, d in runs:
            deep[at[a:b]] = d
            if b - a > CROWDED:  # alike in the whole order
                yield int(at[a]), at[a + 1 : b]
                continue
            for i in range(a, b - 1):
                yield int(at[i]), at[i + 1 + np.flatnonzero((m[i + 1 : b] == m[i]).sum(1) >= least)]
        for k in range(1, NEAR + 1):  # the longest common prefixes across the ends of runs
            for i in np.flatnonzero((m[k:] == m[:-k]).sum(1) >= least):
                yield int(at[i]), at[i + k : i + k + 1]

    return _roots(n, pairs()), deep


def _region_links(rows: DataFrame, key: str, depth: int, threshold: float) -> DataFrame:
    """a, b: spanning links of the rows of each region that may reach the threshold; and a, null, depth of rows that went deeper than the first level."""
    least = least_agreement(threshold) * TREES * PER_TREE

    def batch(a: list[int], b: list[int | None], d: list[int]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(d, pa.int32())], names=["a", "b", "depth"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[int] = []
        b: list[int | None] = []
        d: list[int] = []
        for g in grouped(batches, [key]):
            n = g.num_rows
            rep = g.column("rep").to_pylist()
            if n > 1:
                m = np.frombuffer(b"".join(g.column("low").to_pylist()), np.uint8).reshape(n, -1)
                roots, deep = region_links(m, g.column("tree")[0].as_py(), depth, least)
            else:
                roots, deep = [0], [depth]
            for i, r in enumerate(roots):
                if r != i:
                    a.append(rep[i])
                    b.append(rep[r])
                    d.append(0)
                if LEVELS[0] < deep[i]:
                    a.append(rep[i])
                    b.append(None)
                    d.append(int(deep[i]))
            if len(a) > 20_000:
                yield batch(a, b, d)
                a, b, d = [], [], []
        yield batch(a, b, d)

    return rows.select(key, "tree", "rep", "low").repartition(key).sortWithinPartitions(key).mapInArrow(run, "a long, b long, depth int")


def _joined(rows: DataFrame, key: str) -> DataFrame:
    """Links of all rows of regions that are alike in a whole key, to the first of them."""
    first = rows.groupBy(key).agg(F.min("rep").alias("first"))
    return rows.join(first, key).select(F.col("rep").alias("a"), F.col("first").alias("b"))


def candidate_links(reps: DataFrame, threshold: float) -> DataFrame:
    """a, b over rep: their components are the candidate clusters."""
    rows = persisted(_trees(reps), "mh")

    def counted(rows: DataFrame, key: str, least: int) -> DataFrame:
        return rows.join(rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= least), key)

    # a region of one row has no pair; of the rest, the count decides the depth
    many = persisted(counted(rows, "k3", 2), "mh")
    links = [_region_links(many.where(F.col("n") <= REGION_ROWS), "k3", LEVELS[0], threshold)]
    deeper = persisted(counted(many.where(F.col("n") > REGION_ROWS).drop("n"), "k5", 1), "mh")
    links.append(_region_links(deeper.where(F.col("n") <= REGION_ROWS), "k5", LEVELS[1], threshold))
    deepest = persisted(counted(deeper.where(F.col("n") > REGION_ROWS).drop("n"), "k8", 1), "mh")
    links.append(_region_links(deepest.where(F.col("n") <= REGION_ROWS), "k8", LEVELS[2], threshold))
    hot = deepest.where(F.col("n") > REGION_ROWS)
    links.append(_joined(hot, "k8").withColumn("depth", F.lit(0)))
    links.append(hot.select(F.col("rep").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(LEVELS[2]).alias("depth")))
    found = links[0]
    for x in links[1:]:
        found = found.unionByName(x)
    found = persisted(found, "mh")
    for x in (many, deeper, deepest):
        release(x)
    # how likely each row is to miss a pair at the threshold, from its depth in each order
    miss = [0.0] + [math.log1p(-(min(threshold, 0.9999) ** d)) for d in range(1, PER_TREE + 1)]
    lost = F.element_at(F.array(*[F.lit(m - miss[LEVELS[0]]) for m in miss]), F.col("depth") + 1)
    needy = found.where("b is null").groupBy("a").agg(F.sum(lost).alias("lost")).where(F.col("lost") + TREES * miss[LEVELS[0]] > math.log(MISSED))
    more = persisted(rows.where("tree = 0").join(needy.select(F.col("a").alias("rep")), "rep").select("rep", "low"), "mh")
    release(rows)
    out = found.where("b is not null").select("a", "b")
    if more.take(1):
        orders = math.ceil(math.log(MISSED) / miss[FURTHER_KEY])
        further = persisted(counted(_further(more, orders), "key", 2), "mh")
        out = out.unionByName(_region_links(further.where(F.col("n") <= REGION_ROWS), "key", FURTHER_KEY, threshold).where("b is not null").select("a", "b"))
        out = out.unionByName(_joined(further.where(F.col("n") > REGION_ROWS), "key"))
    return out.where("a <> b").distinct()


def block_links(sets: list[np.ndarray], threshold: float) -> list[int]:
    """Roots of the links between sets whose Jaccard similarity reaches the threshold, exactly."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    per = round(threshold * 100)

    def linked(both: np.ndarray, i: int, js: np.ndarray) -> np.ndarray:
        return 100 * both >= per * (size[i] + size[js] - both)

    if n <= 6:
        pairs = ((i, np.array([j for j in range(i + 1, n) if linked(np.int64(len(np.intersect1d(sets[i], sets[j], assume_unique=True))), i, j)], int)) for i in range(n))
        return _roots(n, pairs)
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rows = np.repeat(np.arange(n), size)
    column = np.cumsum(counts > 1) - 1  # shingles of one set alone are in no intersection
    keep = counts[inverse] > 1
    rows, cols = rows[keep], column[inverse[keep]]
    order = np.argsort(cols, kind="stable")
    rows, cols = rows[order], cols[order]
    width = int(column[-1]) + 1 if len(column) else 0
    step = max(256, BLOCK_CELLS // n)
    both = np.zeros((n, n), np.float32)
    for at in range(0, width, step):
        lo, hi = np.searchsorted(cols, [at, at + step])
        m = np.zeros((n, min(step, width - at)), np.float32)
        m[rows[lo:hi], cols[lo:hi] - at] = 1
        both += m @ m.T

    def pairs() -> Iterator[tuple[int, np.ndarray]]:
        for i in range(n - 1):
            js = np.arange(i + 1, n)
            yield i, js[linked(both[i, i + 1 :].astype(np.int64), i, js)]

    return _roots(n, pairs())


def _cored(members: DataFrame, threshold: float) -> DataFrame:
    """cluster, rep, n, set, lead, core: which members of a wide cluster are linked to one of them, its lead.

    In a group of near copies that is nearly all, after one comparison each; their own pairs need no further look.
    """
    leads = members.groupBy("cluster").agg(F.min(F.struct(F.xxhash64("rep").alias("h"), "rep", "set")).alias("x"))
    both = members.join(leads.select("cluster", F.col("x.rep").alias("lead"), F.col("x.set").alias("lead_set")), "cluster")
    per = round(threshold * 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            core = []
            for x, y in zip(b.column("set").to_pylist(), b.column("lead_set").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                core.append(100 * common >= per * (len(x) + len(y) - common))
            yield pa.record_batch([*(b.column(c) for c in ("cluster", "rep", "n", "set", "lead")), pa.array(core, pa.bool_())], names=["cluster", "rep", "n", "set", "lead", "core"])

    return both.mapInArrow(run, "cluster long, rep long, n long, set binary, lead long, core boolean")


def digest(words: list[bytes]) -> tuple[int, int]:
    """Two 64-bit halves of a hash of the words."""
    d = xxhash.xxh3_128_intdigest(b" ".join(words))
    return (d >> 64) - (1 << 63), (d & ((1 << 64) - 1)) - (1 << 63)


def confirmed_links(docs: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """a, b over rep: spanning links of each block of each cluster; members: cluster, rep, and doc_id, c1, c2 of a document with its text."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(members.select("doc_id", "c1", "c2", "cluster", "rep"), "doc_id")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, c1, c2, cluster, rep in zip(*(b.column(c) for c in ("text", "c1", "c2", "cluster", "rep")), strict=True):
                w = words_of(t.as_py())
                if digest(w) == (c1.as_py(), c2.as_py()):  # another text may stand under the same id
                    s = shingle_set(w)
                    out.append((cluster.as_py(), rep.as_py(), len(s), s.tobytes()))
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["cluster", "rep", "n", "set"])
        _words.clear()

    sets = persisted(texts.mapInArrow(hashed, "cluster long, rep long, n long, set binary"), "mh")

    def parts(rows) -> Column:
        """Parts that rows (a condition) of a cluster are cut into."""
        return F.greatest(F.ceil(F.sum(F.when(rows, F.col("n"))) / BLOCK_SHINGLES), F.ceil(F.count(F.when(rows, 1)) / BLOCK_ROWS)).cast("int")

    wide = persisted(sets.groupBy("cluster").agg(parts(F.lit(True)).alias("parts")).where("parts > 1").select("cluster"), "mh")
    narrow = sets.join(wide, "cluster", "left_anti").select("cluster", F.lit(0).alias("kind"), F.lit(0).alias("i"), F.lit(0).alias("j"), "rep", "set")
    cored = persisted(_cored(sets.join(wide, "cluster"), threshold), "mh")
    of = cored.groupBy("cluster").agg(F.greatest(parts(F.col("core")), F.lit(1)).alias("cores"), parts(~F.col("core")).alias("rests")).where("rests > 0")
    placed = cored.join(of, "cluster").withColumn("own", F.pmod(F.xxhash64("rep"), F.when(F.col("core"), F.col("cores")).otherwise(F.col("rests"))).cast("int"))

    def upto(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    # the core is linked already; the rest meets itself and the core
    rest = placed.where("not core")
    blocks = narrow
    for rows, kind, other in ((rest, 0, "rests"), (rest, 1, "cores"), (placed.where("core"), 1, "rests")):
        x = rows.withColumn("other", upto(other))
        ends = (F.least("own", "other"), F.greatest("own", "other")) if kind == 0 else (F.col("other"), F.col("own")) if other == "cores" else (F.col("own"), F.col("other"))
        blocks = blocks.unionByName(x.select("cluster", F.lit(kind).alias("kind"), ends[0].alias("i"), ends[1].alias("j"), "rep", "set"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in grouped(batches, keys):
            if g.num_rows < 2:
                continue
            rep = g.column("rep").to_pylist()
            roots = block_links([np.frombuffer(s, np.uint64) for s in g.column("set").to_pylist()], threshold)
            found = [(rep[i], rep[r]) for i, r in enumerate(roots) if r != i]
            if found:
                yield pa.record_batch([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

    keys = ["cluster", "kind", "i", "j"]
    found = blocks.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")
    return found.unionByName(cored.where("core and rep <> lead").select(F.col("rep").alias("a"), F.col("lead").alias("b")))


def near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row; links need a similarity of at least threshold."""
    sketch = sketched(docs)
    known = sketch.where("doc_id is not null and n > 0")
    first = known.groupBy("c1", "c2").agg(F.min(F.struct("doc_id", "sig")).alias("x"))
    reps = persisted(first.select("c1", "c2", F.col("x.doc_id").alias("doc_id"), F.col("x.sig").alias("sig")).withColumn("rep", F.monotonically_increasing_id()), "mh")
    clusters = persisted(connected_components(candidate_links(reps, threshold)), "mh")
    names = reps.select("rep", "doc_id", "c1", "c2")
    members = names.join(clusters.select(F.col("node").alias("rep"), F.col("component").alias("cluster")), "rep")
    groups = persisted(connected_components(confirmed_links(docs, members, threshold)), "mh")
    of = persisted(names.join(groups.select(F.col("node").alias("rep"), "component"), "rep", "left").select("c1", "c2", "doc_id", F.coalesce("component", "rep").alias("root")), "mh")
    of = of.join(of.groupBy("root").agg(F.min("doc_id").alias("component")), "root").select("c1", "c2", "component")
    out = sketch.select("doc_id", "c1", "c2", "n").join(of, ["c1", "c2"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows of docs, all columns as they are, without near-duplicates: of each group the smallest id stays, with all rows that bear it."""
    dropped = near_duplicates(docs, threshold).where("not kept").select(F.col("doc_id").alias("_dropped")).distinct()
    return docs.join(dropped, docs["doc_id"] == dropped["_dropped"], "left_anti")

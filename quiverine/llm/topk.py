"""Exact top-k by inner product, with norm buckets.

Vectors are grouped by their length: a bucket holds norms within a ninth of
each other. They are written once, in folders by bucket, and scanned in place,
from long buckets to short ones, against blocks of queries that are broadcast:
``QUERY_BYTES`` of them at a time. The first scan is of ``FIRST`` vectors, each
further one of ``GROWTH`` times as many as all before. After each scan the k-th
best score so far is a query's threshold, which no final result can fall below,
and within a task thresholds rise with what the task has found. A query takes
part only while the longest vector to come could reach its threshold.

In a bucket's vectors at hand the threshold becomes one on the cosine, and
picks the pruning for a query: a low one leaves length pruning (vectors too
short to reach it are left out, and the others multiplied with all such queries
at once), a high one coordinate pruning (in the query's largest coordinates, a
vector at that cosine must lie within a range, found by bisection in that
coordinate's order; what is left is multiplied). Products are exact integers.

Defined results: vectors that are null or hold a null or non-finite component
take no part, nor do rows without an id. Only vectors of the query's dimension
are candidates. Rows with the query's own id are not. A query repeated as a
whole counts once; a vector repeated is a candidate each time. A query with
fewer than k candidates gets them all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quiverine.llm.common import checkpoint, read, steps

#: Bytes of queries that one scan answers.
QUERY_BYTES = 32 << 20
#: Vectors, about, of the first scan, and by how many times their number grows.
FIRST, GROWTH = 65_536, 16
#: Scores that a task computes at once.
SCORES = 1 << 21
#: Steps of a bucket for each doubling of the norm.
STEPS = 8
FOCUS = 3
_NONE = -(1 << 63)


def integer_vectors(df: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(id, v, dim, norm) with v the floor of ``scale`` times each component."""
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = df.filter(F.col(key).isNotNull() & F.col(vector).isNotNull() & usable)
    rows = rows.select(F.col(key).cast("long").alias("id"), F.transform(vector, lambda x: F.floor(x.cast("double") * scale)).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return rows.withColumn("dim", F.size("v")).withColumn("norm", norm)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim) if dim else np.zeros((len(column), 0), np.int64)


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer products of rows with a vector: in doubles where those are exact, else in 64-bit or unbounded integers."""
    size = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if size < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    if size < 1 << 63:
        return a @ b
    out = a.astype(object) @ b.astype(object)
    return np.array([min(max(int(x), -(2**63)), 2**63 - 1) for x in out], np.int64)


def coordinates_prune(cosine: np.ndarray, dim: int) -> np.ndarray:
    """Whether a threshold on the cosine leaves a narrow range in a coordinate: the range over the spread of a unit vector's coordinates."""
    return np.sqrt(np.maximum(0, 1 - cosine * cosine)) * np.sqrt(dim) < 2.5


class Group:
    """The vectors of one bucket and dimension at hand, in order of falling length, with coordinate orders made as they are asked for."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, norms: np.ndarray) -> None:
        order = np.argsort(-norms, kind="stable")
        self.ids, self.vectors, self.norms = ids[order], vectors[order], norms[order]
        self.big, self.dim = int(np.abs(vectors).max(initial=0)), vectors.shape[1]
        self.doubles = self.vectors.astype(np.float64)
        self.unit: np.ndarray | None = None
        self.orders: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def reach(self, need: np.ndarray) -> np.ndarray:
        """How many of the longest vectors have this norm or more."""
        return np.searchsorted(-self.norms, -need, "right")

    def _within(self, coordinate: int, low: float, high: float) -> np.ndarray:
        if coordinate not in self.orders:
            order = np.argsort(self.unit[:, coordinate], kind="stable")
            self.orders[coordinate] = (order, self.unit[order, coordinate])
        order, values = self.orders[coordinate]
        return order[np.searchsorted(values, low, "left") : np.searchsorted(values, high, "right")]

    def candidates(self, query: np.ndarray, norm: float, need: float) -> np.ndarray:
        """Positions of all vectors that can be at ``need`` or more along the query, by its largest coordinates."""
        if self.unit is None:
            self.unit = self.doubles / np.maximum(self.norms, 1e-300)[:, None]
        n = int(self.reach(np.array([need]))[0])
        cosine = min(1.0, need / self.norms[0])
        unit = query / norm
        left = np.arange(n)
        for number, f in enumerate(np.argsort(-np.abs(unit))[:FOCUS]):
            q = float(unit[f])
            room = np.sqrt(max(0.0, (1 - q * q) * (1 - cosine * cosine))) + 1e-9
            low = q * cosine - room if q >= -cosine else -1.0 - 1e-9
            high = q * cosine + room if q <= cosine else 1.0 + 1e-9
            if not number:
                left = self._within(int(f), low, high)
                left = left[left < n]
            else:
                own = self.unit[left, f]
                left = left[(own >= low) & (own <= high)]
        return left

    def scores(self, at: np.ndarray | slice, query: np.ndarray) -> np.ndarray:
        if self.big * int(np.abs(query).max(initial=0)) * max(1, self.dim) < 1 << 53:
            return (self.doubles[at] @ query.astype(np.float64)).astype(np.int64)
        return exact_products(self.vectors[at], query)

    def best(self, queries: Queries, which: np.ndarray, thresholds: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, id, score) of what reaches the thresholds of the queries ``which``, and is among the k best here or ties with them."""
        if not len(self.ids):
            return
        low = thresholds[which] <= 0
        norms = queries.norms[which]
        # A little slack keeps rounding from dropping a tie.
        need = np.where(low | (norms == 0), 0.0, thresholds[which] / np.maximum(norms, 1e-300) * (1 - 1e-9))
        could = low | (need <= self.norms[0])
        which, need, low = which[could], need[could], low[could]
        by_coordinate = ~low & coordinates_prune(np.minimum(1.0, need / max(self.norms[0], 1e-300)), self.dim)
        for q, least in zip(which[by_coordinate].tolist(), need[by_coordinate].tolist(), strict=True):
            at = self.candidates(queries.doubles[q], queries.norms[q], least)
            yield self._kept(np.full(len(at), q), at, self.scores(at, queries.vectors[q]), queries, thresholds)
        which, need = which[~by_coordinate], need[~by_coordinate]
        order = np.argsort(need, kind="stable")
        step = max(1, SCORES // len(self.ids))
        for a in range(0, len(order), step):
            own = which[order[a : a + step]]
            yield from self._by_length(queries, own, int(self.reach(need[order[a : a + 1]])[0]), thresholds, k)

    def _by_length(self, queries: Queries, which: np.ndarray, n: int, thresholds: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The ``n`` longest against a block of queries."""
        if self.big * queries.big * max(1, self.dim) >= 1 << 53:
            for q in which.tolist():
                at = np.arange(n)
                yield self._kept(np.full(n, q), at, self.scores(at, queries.vectors[q]), queries, thresholds)
            return
        scores = queries.doubles[which] @ self.doubles[:n].T
        scores[queries.ids[which][:, None] == self.ids[None, :n]] = -np.inf
        least = np.where(thresholds[which] == _NONE, -np.finfo(float).max, thresholds[which].astype(float))
        if n > 4 * k and (scores >= least[:, None]).sum() > 4 * k * len(which):
            least = np.maximum(least, np.partition(scores, n - k, axis=1)[:, n - k])
        q, at = np.nonzero(scores >= np.maximum(least, -np.finfo(float).max)[:, None])
        yield which[q], self.ids[at], scores[q, at].astype(np.int64)

    def _kept(self, q: np.ndarray, at: np.ndarray, scores: np.ndarray, queries: Queries, thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        good = (scores >= thresholds[q]) & (self.ids[at] != queries.ids[q])
        return q[good], self.ids[at[good]], scores[good]


class Queries:
    """The queries of one dimension in a block; their places there are ``at``."""

    def __init__(self, at: np.ndarray, ids: np.ndarray, vectors: np.ndarray, norms: np.ndarray) -> None:
        self.at, self.ids, self.vectors, self.norms = at, ids, vectors, norms
        self.doubles = vectors.astype(np.float64)
        self.big = int(np.abs(vectors).max(initial=0))


class Best:
    """The k best of each query so far, and the thresholds that follow."""

    def __init__(self, thresholds: np.ndarray, k: int) -> None:
        self.thresholds, self.k = thresholds.copy(), k
        self.rows = tuple(np.zeros(0, np.int64) for _ in range(3))

    def add(self, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        q, ids, scores = (np.concatenate([own, *(f[c] for f in found)]) for c, own in enumerate(self.rows))
        order = np.lexsort((ids, ~scores, q))  # ~x falls as x rises, without overflow
        q, ids, scores = q[order], ids[order], scores[order]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
        kept = rank < self.k
        self.rows = q[kept], ids[kept], scores[kept]
        last = rank == self.k - 1
        self.thresholds[q[last]] = np.maximum(self.thresholds[q[last]], scores[last])


def scans(sizes: list[tuple[int, int]]) -> list[list[tuple[int, float, float]]]:
    """Buckets (bucket, vectors) shared out to scans, long ones first: (bucket, from, to), shares of it by a hash."""
    out: list[list[tuple[int, float, float]]] = [[]]
    room = FIRST
    for bucket, n in sorted(sizes, reverse=True):
        at = 0.0
        while at < 1.0:
            to = min(1.0, at + room / n)
            if n * (1.0 - to) < FIRST / 4:  # no scan for a remnant
                to = 1.0
            out[-1].append((bucket, at, to))
            room -= int(n * (to - at))
            at = to
            if room <= 0:
                seen = sum(int(m) for b, m in sizes if b > bucket) + int(n * at)
                out.append([])
                room = max(FIRST, GROWTH * seen)
    return [scan for scan in out if scan]


def _in_scan(scan: list[tuple[int, float, float]]) -> Column:
    whole = [b for b, low, high in scan if (low, high) == (0.0, 1.0)]
    drawn = F.pmod(F.xxhash64("id", "v"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    where = F.col("bucket").isin(whole)
    for b, low, high in scan:
        if (low, high) != (0.0, 1.0):
            where |= (F.col("bucket") == b) & (drawn >= low) & ((drawn < high) if high < 1.0 else F.lit(True))
    return where


def _scanned(vectors: DataFrame, block: list[Queries], thresholds: np.ndarray, k: int) -> DataFrame:
    """(at, vec_id, score) of each task's best for the queries of a block."""
    shared = vectors.sparkSession.sparkContext.broadcast((block, thresholds))  # QUERY_BYTES of queries, about

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, thresholds = shared.value
        by_dim = {q.vectors.shape[1]: (q, Best(thresholds[q.at], k)) for q in block}
        for batch in steps(batches):
            ids, dims, buckets, norms = (batch.column(c).to_numpy() for c in ("id", "dim", "bucket", "norm"))
            for dim in np.unique(dims):
                if int(dim) not in by_dim:
                    continue
                queries, best = by_dim[int(dim)]
                for bucket in np.unique(buckets[dims == dim])[::-1]:
                    rows = np.flatnonzero((dims == dim) & (buckets == bucket))
                    group = Group(ids[rows], _matrix(batch.column("v").take(pa.array(rows)), int(dim)), norms[rows])
                    for found in group.best(queries, np.arange(len(queries.ids)), best.thresholds, k):
                        if len(found[0]):
                            best.add([found])
        for queries, best in by_dim.values():
            q, ids, scores = best.rows
            if len(q):
                yield pa.RecordBatch.from_arrays([pa.array(queries.at[q]), pa.array(ids), pa.array(scores)], ["at", "vec_id", "score"])

    return vectors.select("id", "dim", "bucket", "norm", "v").mapInArrow(run, "at long, vec_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("at").orderBy(F.col("score").desc(), F.col("vec_id")))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best of ``vectors``; both as ``integer_vectors`` makes them."""
    bucket = F.when(F.col("norm") > 0, F.floor(F.log2("norm") * STEPS)).otherwise(F.lit(-100_000)).cast("int")
    vectors = checkpoint(vectors.withColumn("bucket", bucket), by=["bucket"])
    # A row for each bucket: some hundreds, as norms have exponents.
    sizes = vectors.groupBy("bucket").agg(F.count("*").alias("n"), F.max("norm").alias("longest")).collect()
    longest = {r["bucket"]: r["longest"] for r in sizes}
    plan = scans([(r["bucket"], r["n"]) for r in sizes])
    asked = checkpoint(queries.select("id", "v", "dim", "norm").dropDuplicates(["id", "v"]))
    n, cells = asked.agg(F.count("*"), F.sum("dim")).first()
    blocks = max(1, -(-8 * (cells or 0) // QUERY_BYTES), -(-n // (QUERY_BYTES // 256)))
    out = None
    for number in range(blocks if n and sizes else 0):
        own = asked.filter(F.pmod(F.xxhash64("id", "v", F.lit("block")), F.lit(blocks)) == number).toArrow().combine_chunks()
        found = _block(vectors, plan, longest, own, k)
        out = found if out is None else out.unionByName(found)
    schema = "query_id long, rank int, vec_id long, score long"
    return vectors.sparkSession.createDataFrame([], schema) if out is None else out


def _block(vectors: DataFrame, plan: list, longest: dict[int, float], own: pa.Table, k: int) -> DataFrame:
    """The results of the queries of one block."""
    spark = vectors.sparkSession
    ids, dims, norms = (own.column(c).to_numpy() for c in ("id", "dim", "norm"))
    thresholds = np.full(len(ids), _NONE, np.int64)
    block = []
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        block.append(Queries(at, ids[at], _matrix(own.column("v").take(pa.array(at)).combine_chunks(), int(dim)), norms[at]))
    best = None
    for scan in plan:
        most = max(longest[b] for b, _, _ in scan)
        live = (thresholds <= 0) | (norms * most * (1 + 1e-9) >= thresholds)
        if not live.any():
            break  # nor does any shorter vector reach a threshold
        now = []
        for q in block:
            on = live[q.at]
            if on.any():
                now.append(Queries(q.at[on], q.ids[on], q.vectors[on], q.norms[on]))
        found = _scanned(vectors.filter(_in_scan(scan)), now, thresholds, k)
        best = checkpoint(_ranked(found if best is None else best.drop("rank").unionByName(found), k))
        if scan is not plan[-1]:
            reached = best.filter(F.col("rank") == k).select("at", "score").toArrow()
            thresholds[reached.column("at").to_numpy()] = reached.column("score").to_numpy()
    names = spark.createDataFrame(pa.table({"at": pa.array(np.arange(len(ids))), "query_id": pa.array(ids)}))
    return best.join(names, "at").select("query_id", "rank", "vec_id", "score")


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract: floor(256 x), queries whose id is divisible by 50, five best."""
    vectors = integer_vectors(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", 256)
    return top_k(vectors, vectors.filter(F.col("id") % 50 == 0), 5)


ORACLE = """
WITH ints AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM ints q JOIN ints c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

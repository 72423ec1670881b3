"""k-means: spread-out starting centres, then rounds of means and nearest centres.

Two ways lead to the same rules. ``fit_block`` works on a block in memory, for
samples of a stated bound and for tests. ``fit`` works on a table of any size,
kept by the executors in blocks: a round is one pass that finds each vector's
nearest centre and sums by centre within a task; only centres, one row each,
come to the driver.

The rules: the first centre is drawn evenly, each further one in proportion to
the squared distance from the nearest so far. A round replaces each centre by
the mean of its vectors, and stops if the largest move, over the largest norm
of the new centres, is under ``epsilon``; else vectors go to their nearest
centre, the first of equals. There are at most ``rounds`` rounds; large tables
can take several times the default, so ``fit`` takes None for no limit.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiverine.errors import InvalidArgs
from quiverine.functions import vector as V
from quiverine.operators.events import Listener, tell
from quiverine.operators.sampling import WeightedIndex
from quiverine.operators.vectors import matrix

ROUNDS = 100
#: Stop rules by element type.
EPSILON_FLOAT, EPSILON_DOUBLE = 1e-6, 1e-12
#: Vectors whose distances to all centres are held at once.
BLOCK = 2048


@dataclass(frozen=True)
class Codebook:
    """Centres, and the centre of every vector."""

    centroids: np.ndarray
    indices: np.ndarray


def nearest_block(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centre, the first of equals, and the squared distance.

    The product form finds a few centres that rounding can't tell apart; exact
    differences decide between them.
    """
    nearest = np.empty(len(rows), np.int64)
    distance = np.empty(len(rows))
    norms = (centroids * centroids).sum(axis=1)
    for a in range(0, len(rows), BLOCK):
        part = rows[a : a + BLOCK]
        own = (part * part).sum(axis=1)
        rough = norms - 2 * (part @ centroids.T)
        least = rough.min(axis=1)
        close = rough <= (least + 1e-9 * (own + np.abs(least) + norms.max(initial=0)))[:, None]
        best = close.argmax(axis=1)
        for k in np.flatnonzero(close.sum(axis=1) > 1):
            among = np.flatnonzero(close[k])
            best[k] = among[((part[k] - centroids[among]) ** 2).sum(axis=1).argmin()]
        nearest[a : a + BLOCK] = best
        distance[a : a + BLOCK] = ((part - centroids[best]) ** 2).sum(axis=1)
    return nearest, distance


def spread(rows: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the starting centres, and each row's centre among them."""
    n = len(rows)
    if n < k:
        raise InvalidArgs(f"{n} vectors can't make {k} clusters")
    if n == k:
        return np.arange(n), np.arange(n)
    chosen = [int(rng.integers(n))]
    nearest = np.zeros(n, np.int64)
    distance = ((rows - rows[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < k:
        if not distance.sum() > 0:
            raise InvalidArgs(f"fewer than {k} distinct vectors")
        picked = WeightedIndex(distance).sample(lambda total: rng.random() * total)
        new = ((rows - rows[picked]) ** 2).sum(axis=1)
        closer = new < distance
        nearest[closer] = len(chosen)
        distance = np.minimum(distance, new)
        chosen.append(picked)
    return np.array(chosen), nearest


def sum_by(indices: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """The sum of the rows of each of k indices."""
    order = np.argsort(indices, kind="stable")
    present, starts = np.unique(indices[order], return_index=True)
    out = np.zeros((k, rows.shape[1]))
    if len(present):
        out[present] = np.add.reduceat(rows[order], starts, axis=0)
    return out


def moved(old: np.ndarray, new: np.ndarray) -> float:
    """The largest move over the largest new norm; 0 if all new centres are zero."""
    norm = float(np.sqrt((new * new).sum(axis=1)).max())
    return float(np.sqrt(((new - old) ** 2).sum(axis=1)).max()) / norm if norm > 0 else 0.0


def fit_block(rows: np.ndarray, k: int, seed: int = 0, init: np.ndarray | None = None, rounds: int = ROUNDS, epsilon: float = EPSILON_FLOAT, listener: Listener | None = None) -> Codebook:
    """k-means of a block; ``init`` names starting centres instead of drawing them."""
    rows = np.asarray(rows, float)
    if k < 1:
        raise InvalidArgs("k must be positive")
    tell(listener, "start_init", k=k)
    if init is None:
        chosen, indices = spread(rows, k, np.random.default_rng(seed))
        centroids = rows[chosen].copy()
    else:
        centroids = np.asarray(init, float).copy()
        indices, _ = nearest_block(rows, centroids)
    tell(listener, "finish_init")
    for number in range(rounds):
        tell(listener, "start_update", round=number)
        counts = np.bincount(indices, minlength=k)
        if (counts == 0).any():
            raise InvalidArgs(f"cluster {int((counts == 0).argmax())} is empty")
        new = sum_by(indices, rows, k) / counts[:, None]
        shift = moved(centroids, new)
        centroids = new
        tell(listener, "finish_update", round=number, shift=shift)
        if shift < epsilon:
            break
        tell(listener, "start_reassign", round=number)
        indices, _ = nearest_block(rows, centroids)
        tell(listener, "finish_reassign", round=number)
    return Codebook(centroids, indices)


def centroid_table(df_session, centroids: np.ndarray) -> DataFrame:
    """(cluster, centroid) of centres at hand."""
    return df_session.createDataFrame([(k, c.tolist()) for k, c in enumerate(centroids)], "cluster int, centroid array<double>")


def assign(vectors: DataFrame, centroids: np.ndarray, to: str = "cluster") -> DataFrame:
    """``vectors`` with the nearest centre and the squared distance, in numpy blocks. The centres, k rows, are shipped with the code."""
    schema = vectors.schema
    at = vectors.columns.index("vec")
    names = [*vectors.columns, to, "squared_distance"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                nearest, distance = nearest_block(matrix(batch.column(at)), centroids)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest.astype(np.int32)), pa.array(distance)], names)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields]
    return vectors.mapInArrow(run, ", ".join([*fields, f"`{to}` int, squared_distance double"]))


def assign_sql(vectors: DataFrame, centroids: DataFrame, to: str = "cluster") -> DataFrame:
    """The same in built-in expressions: (vec_ord, cluster, squared_distance).

    ``centroids`` (cluster, centroid) becomes one array beside each vector, so
    no pair of vector and centre is ever a row. It holds k rows by definition.
    """
    gathered = centroids.agg(F.array_sort(F.collect_list(F.struct(F.col("cluster"), F.col("centroid")))).alias("all"))
    best = F.array_min(F.transform("all", lambda c: F.struct(V.squared_distance(F.col("vec"), c["centroid"]).alias("d"), c["cluster"].alias("c"))))
    found = vectors.join(F.broadcast(gathered)).withColumn("best", best)
    return found.select("vec_ord", F.col("best.c").alias(to), F.col("best.d").alias("squared_distance"))


def means_sql(vectors: DataFrame, assigned: DataFrame) -> DataFrame:
    """(cluster, centroid): the mean of each cluster's vectors."""
    cells = vectors.join(assigned.select("vec_ord", "cluster"), "vec_ord").select("cluster", F.posexplode("vec").alias("pos", "x"))
    means = cells.groupBy("cluster", "pos").agg(F.avg("x").alias("x"))
    return means.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda c: c["x"]).alias("centroid"))


def shift_sql(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row: the largest move over the largest new norm."""
    both = old.withColumnRenamed("centroid", "old").join(new, "cluster")
    norm, move = F.max(V.norm2("centroid")), F.max(V.norm2(V.subtract("centroid", "old")))
    return both.agg(F.when(norm > 0, move / norm).otherwise(F.lit(0.0)).alias("shift"))


def lloyd_sql(vectors: DataFrame, centroids: DataFrame, rounds: int) -> DataFrame:
    """Centres after so many rounds of nearest centre and mean, as one plan: for few rounds."""
    for _ in range(rounds):
        centroids = means_sql(vectors, assign_sql(vectors, centroids))
    return centroids


def _blocks(vectors: DataFrame) -> RDD:
    """The vectors as blocks of numbers, kept by the executors for the rounds of a fit."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = matrix(batch.column(0))
            for a in range(0, len(rows), BLOCK):
                part = rows[a : a + BLOCK]
                yield pa.RecordBatch.from_arrays([pa.array([part.shape[1]], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["width", "numbers"])

    packed = vectors.select("vec").mapInArrow(pack, "width int, numbers binary").rdd
    return packed.map(lambda r: np.frombuffer(r["numbers"]).reshape(-1, r["width"])).persist(StorageLevel.MEMORY_AND_DISK)


def _sums(blocks: RDD, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each centre's number of nearest vectors and their sum: summed in each task, then by centre."""
    k, width = centroids.shape

    def partial(parts: Iterator[np.ndarray]) -> Iterator[tuple[int, tuple[int, np.ndarray]]]:
        counts, sums = np.zeros(k, np.int64), np.zeros((k, width))
        for rows in parts:
            nearest, _ = nearest_block(rows, centroids)
            counts += np.bincount(nearest, minlength=k)
            sums += sum_by(nearest, rows, k)
        for c in np.flatnonzero(counts).tolist():
            yield c, (int(counts[c]), sums[c])

    # A pair for each task and centre goes to the centre's merging task; k come to the driver.
    merged = blocks.mapPartitions(partial).reduceByKey(lambda a, b: (a[0] + b[0], a[1] + b[1]), min(k, 64, blocks.getNumPartitions()))
    counts, sums = np.zeros(k, np.int64), np.zeros((k, width))
    for c, (n, s) in merged.collect():
        counts[c], sums[c] = n, s
    return counts, sums


def fit(vectors: DataFrame, k: int, seed: int = 0, init: np.ndarray | None = None, sample: int = 65_536, rounds: int | None = ROUNDS, epsilon: float = EPSILON_FLOAT, listener: Listener | None = None) -> np.ndarray:
    """Centres of a table (vec_ord, vec) of any size.

    The starting centres are drawn by the rule above from at most about
    ``sample`` vectors, chosen evenly by a hash of their ordinals; a table that
    is no larger takes part as a whole. Every round reads all vectors. Without
    a limit of rounds (None) they go on until a move is under ``epsilon``.
    """
    n = vectors.count()
    if n < k:
        raise InvalidArgs(f"{n} vectors can't make {k} clusters")
    if init is None:
        rows = sampled(vectors, sample, n)
        tell(listener, "start_init", k=k)
        chosen, _ = spread(rows, k, np.random.default_rng(seed))
        centroids = rows[chosen].copy()
        tell(listener, "finish_init")
    else:
        centroids = np.asarray(init, float).copy()
    blocks = _blocks(vectors)
    try:
        for number in itertools.count() if rounds is None else range(rounds):
            tell(listener, "start_update", round=number)
            counts, sums = _sums(blocks, centroids)
            if (counts == 0).any():
                raise InvalidArgs(f"cluster {int((counts == 0).argmax())} is empty")
            new = sums / counts[:, None]
            shift = moved(centroids, new)
            centroids = new
            tell(listener, "finish_update", round=number, shift=shift)
            if shift < epsilon:
                break
    finally:
        blocks.unpersist()
    return centroids


def sampled(vectors: DataFrame, most: int, n: int | None = None) -> np.ndarray:
    """At most about ``most`` vectors as a block, in order of their ordinals, chosen by a hash of them; all, if they are no more."""
    n = vectors.count() if n is None else n
    if n > most:
        drawn = F.pmod(F.xxhash64("vec_ord"), F.lit(1 << 40)) / F.lit(float(1 << 40))
        vectors = vectors.filter(drawn < most / n)
    found = vectors.select("vec_ord", "vec").toArrow()
    order = np.argsort(found.column("vec_ord").to_numpy(), kind="stable")
    return matrix(found.column("vec").combine_chunks())[order]


def least_distance(vectors: DataFrame, chosen: DataFrame) -> DataFrame:
    """(vec_ord, weight): the squared distance to the nearest of the chosen centres, by which the next is drawn."""
    return assign_sql(vectors, chosen).select("vec_ord", F.col("squared_distance").alias("weight"))

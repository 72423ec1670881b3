"""k nearest neighbours: probe the nearest partitions, sum up table distances of codes, keep the best.

The distance of a vector is that of its reconstruction from codes. Ties go to
the smaller (partition_index, vector_index). Fewer than k rows come back if the
probed partitions hold fewer.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quiverine.errors import InvalidArgs
from quiverine.functions import vector as V
from quiverine.operators.vectors import as_column, matrix
from quiverine.sources.tables import keep

#: Queries that one scan answers, and that meet a piece of a partition at once; and their bytes.
QUERY_ROWS, QUERY_BYTES = 16_384, 64 << 20
#: Vectors of a partition that one task holds against the queries of a table.
PIECE = 1 << 18
#: What is sent to every task at most: centres, codebooks and a block of queries.
BROADCAST_BYTES = 512 << 20
RESULT = "query_id long, partition_index int, vector_index int, vector_id string, squared_distance double"


def check_query(queries: np.ndarray, centroids: np.ndarray, k: int, nprobe: int) -> None:
    if k < 1 or nprobe < 1:
        raise InvalidArgs("k and nprobe must be positive")
    if nprobe > len(centroids):
        raise InvalidArgs(f"nprobe {nprobe} exceeds the number of partitions {len(centroids)}")
    if queries.ndim != 2 or queries.shape[1] != centroids.shape[1]:
        raise InvalidArgs(f"queries have {queries.shape[-1]} elements, vectors {centroids.shape[1]}")
    if not np.isfinite(queries).all():
        raise InvalidArgs("a query holds a NaN or an infinity")


def probe(queries: np.ndarray, centroids: np.ndarray, nprobe: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest partitions of each query, nearest first, and their squared distances."""
    distance = np.stack([((centroids - q) ** 2).sum(axis=1) for q in queries]) if len(queries) else np.zeros((0, len(centroids)))
    order = np.argsort(distance, axis=1, kind="stable")[:, :nprobe]
    return order, np.take_along_axis(distance, order, axis=1)


def code_norms(books: np.ndarray) -> np.ndarray:
    """The squared norm (divisions, codes) of each code vector."""
    return np.einsum("dcw,dcw->dc", books, books)


def distance_tables(query: np.ndarray, centroids: np.ndarray, books: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Squared distances (centroids, divisions, codes) of the query's slices, localized by each centre, from the code vectors."""
    divisions, _, width = books.shape
    local = (query - centroids).reshape(len(centroids), divisions, width).transpose(1, 2, 0)
    squares = np.square(local).sum(axis=1)[:, None, :]
    return np.maximum(norms[:, :, None] - 2 * np.matmul(books, local) + squares, 0).transpose(2, 0, 1)


def distance_table(query: np.ndarray, centroid: np.ndarray, books: np.ndarray, norms: np.ndarray | None = None) -> np.ndarray:
    """The same of one centre."""
    return distance_tables(query, centroid[None], books, code_norms(books) if norms is None else norms)[0]


def table_distances(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The squared distance of each row of codes (rows, divisions) by a distance table."""
    return table[np.arange(table.shape[0]), codes].sum(axis=1)


def nearest_rows(distance: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k least, and of all that tie with the last of them."""
    return np.arange(len(distance)) if len(distance) <= k else np.flatnonzero(distance <= np.partition(distance, k - 1)[k - 1])


def _sent(spark: SparkSession, *arrays: np.ndarray):
    """Arrays, broadcast behind a check of their size."""
    size = sum(a.nbytes for a in arrays)
    if size > BROADCAST_BYTES:
        raise InvalidArgs(f"centres, codebooks or queries of {size} bytes; at most {BROADCAST_BYTES} are sent to every task")
    return spark.sparkContext.broadcast(arrays)


def scan(encoded: DataFrame, queries: np.ndarray, centroids: np.ndarray, books: np.ndarray, k: int, nprobe: int, first_id: int = 0) -> DataFrame:
    """The k best rows of each query and task, of queries of a bounded number of bytes.

    Probing is done here, on the centres, so the scan's filter names the
    partitions and reads no others. Each task keeps k rows for each query.
    """
    probes, _ = probe(queries, centroids, nprobe)
    sent = _sent(encoded.sparkSession, queries, centroids, books, probes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, centroids, books, probes = sent.value
        norms = code_norms(books)
        best: dict[int, tuple[np.ndarray, ...]] = {}
        for batch in batches:
            partition, index = (batch.column(c).to_numpy() for c in (0, 1))
            codes = matrix(batch.column(3)).astype(np.int64)
            for p in np.unique(partition):
                at = np.flatnonzero(partition == p)
                for q in np.flatnonzero((probes == p).any(axis=1)).tolist():
                    d = table_distances(distance_table(queries[q], centroids[p], books, norms), codes[at])
                    near = nearest_rows(d, k)
                    own = (np.full(len(near), p), index[at[near]], np.array(batch.column(2).take(pa.array(at[near])).to_pylist(), object), d[near])
                    if q in best:
                        own = tuple(np.concatenate(x) for x in zip(best[q], own, strict=True))
                    order = np.lexsort((own[1], own[0], own[3]))[:k]
                    best[q] = tuple(x[order] for x in own)
        if best:
            n = [len(b[0]) for b in best.values()]
            columns = [np.concatenate(x) for x in zip(*best.values(), strict=True)]
            yield _found(np.repeat(np.fromiter(best, np.int64), n) + first_id, *columns)

    probed = encoded.filter(F.col("partition_index").isin(np.unique(probes).tolist()))
    return probed.select("partition_index", "vector_index", "vector_id", "codes").mapInArrow(run, RESULT)


def _found(query_id: np.ndarray, partition: np.ndarray, index: np.ndarray, ids: np.ndarray, distance: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(query_id), pa.array(partition.astype(np.int32)), pa.array(index.astype(np.int32)), pa.array(ids, pa.string()), pa.array(distance.astype(float))]
    return pa.RecordBatch.from_arrays(columns, ["query_id", "partition_index", "vector_index", "vector_id", "squared_distance"])


def best_rows(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query."""
    order = Window.partitionBy("query_id").orderBy("squared_distance", "partition_index", "vector_index")
    return found.withColumn("__rank", F.row_number().over(order)).filter(F.col("__rank") <= k).drop("__rank")


def knn_batch(encoded: DataFrame, queries: np.ndarray, centroids: np.ndarray, books: np.ndarray, k: int, nprobe: int) -> DataFrame:
    """The k best of every query at hand: one scan of the vectors for up to ``QUERY_BYTES`` of queries. ``knn_table`` takes more than a driver holds."""
    queries = np.asarray(queries, float)
    check_query(queries, centroids, k, nprobe)
    most = max(1, min(QUERY_ROWS, QUERY_BYTES // (8 * max(1, queries.shape[1]))))
    found = None
    for a in range(0, len(queries), most):
        own = scan(encoded, queries[a : a + most], centroids, books, k, nprobe, a)
        found = own if found is None else found.unionByName(own)
    if found is None:
        return encoded.sparkSession.createDataFrame([], RESULT)
    return best_rows(found, k)


def knn_table(encoded: DataFrame, sizes: DataFrame, queries: DataFrame, centroids: np.ndarray, books: np.ndarray, k: int, nprobe: int) -> DataFrame:
    """The k best of every row of a table (query_id, vec) of any size; ``sizes`` is (partition_index, num_vectors).

    A query goes to its probed partitions, and meets there pieces of at most
    ``PIECE`` vectors; a partition that many queries ask for is met by them in
    blocks of about ``QUERY_ROWS``. So neither a large partition nor one that
    is often asked for is one task's.
    """
    check_query(np.zeros((0, centroids.shape[1])), centroids, k, nprobe)
    sent = _sent(encoded.sparkSession, centroids, books)
    width = centroids.shape[1]

    def localize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, _ = sent.value
        for batch in batches:
            for part in (batch.slice(a, 1024) for a in range(0, batch.num_rows, 1024)):
                rows = matrix(part.column(1)) if len(part.column(1).flatten()) == width * part.num_rows else np.zeros((0, 0))
                check_query(rows, centroids, k, nprobe)
                near, _ = probe(rows, centroids, nprobe)
                local = rows.repeat(nprobe, axis=0) - centroids[near.ravel()]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.arange(len(rows)).repeat(nprobe))), pa.array(near.ravel().astype(np.int32)), as_column(local)], ["query_id", "partition_index", "local"])

    asked = keep(queries.select(F.col("query_id").cast("long"), F.col("vec").cast("array<double>")).mapInArrow(localize, "query_id long, partition_index int, local array<double>"))
    # A row for each partition of the index.
    demand = asked.groupBy("partition_index").agg(F.count("*").alias("n")).join(sizes, "partition_index")
    demand = demand.select("partition_index", F.ceil(F.col("n") / QUERY_ROWS).cast("int").alias("blocks"), F.ceil(F.col("num_vectors") / PIECE).cast("int").alias("pieces"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    to = asked.join(F.broadcast(demand), "partition_index").select(
        "partition_index", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int").alias("block"), each("pieces").alias("piece"), F.lit(1).alias("side"), "query_id", "local",
        F.lit(None).cast("int").alias("vector_index"), F.lit(None).cast("string").alias("vector_id"), F.lit(None).cast("array<int>").alias("codes"),
    )
    own = encoded.join(F.broadcast(demand), "partition_index").select(
        "partition_index", each("blocks").alias("block"), F.floor(F.col("vector_index") / PIECE).cast("int").alias("piece"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("query_id"),
        F.lit(None).cast("array<double>").alias("local"), "vector_index", "vector_id", "codes",
    )
    key = ["partition_index", "block", "piece"]
    meeting = own.unionByName(to).repartition(*key).sortWithinPartitions(*key, "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, books = sent.value
        norms = code_norms(books)
        at, held, piece = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in range(4)])
            for a, b in itertools.pairwise([*np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)]).tolist(), batch.num_rows]):
                part, now = batch.slice(a, b - a), tuple(keys[:3, a])
                if now != at:
                    at, held, piece = now, [], None
                if keys[3, a] == 0:
                    held.append((part.column("vector_index").to_numpy(), np.array(part.column("vector_id").to_pylist(), object), matrix(part.column("codes")).astype(np.int64)))
                    continue
                if piece is None and held:
                    piece, held = tuple(np.concatenate(x) for x in zip(*held, strict=True)), []
                if piece is None:
                    continue
                index, ids, codes = piece
                for query_id, local in zip(part.column("query_id").to_pylist(), matrix(part.column("local")), strict=True):
                    d = table_distances(distance_table(local, np.zeros(width), books, norms), codes)
                    near = nearest_rows(d, k)
                    near = near[np.lexsort((index[near], d[near]))[:k]]
                    yield _found(np.full(len(near), query_id), np.full(len(near), now[0]), index[near], ids[near], d[near])

    return best_rows(meeting.mapInArrow(run, RESULT), k)


def knn(encoded: DataFrame, query, centroids: np.ndarray, books: np.ndarray, k: int, nprobe: int) -> DataFrame:
    """The k best of one query, nearest first."""
    block = np.asarray(query, float).reshape(1, -1)
    check_query(block, centroids, k, nprobe)
    found = scan(encoded, block, centroids, books, k, nprobe)
    return found.drop("query_id").orderBy("squared_distance", "partition_index", "vector_index").limit(k)


def probe_sql(queries: DataFrame, centroids: DataFrame, nprobe: int) -> DataFrame:
    """(query_id, partition_index, probe_rank, squared_distance, localized), of (query_id, vec) and (partition_index, centroid), in built-in expressions."""
    gathered = centroids.agg(F.array_sort(F.collect_list(F.struct("partition_index", "centroid"))).alias("all"))  # the index's centres
    near = F.array_sort(F.transform("all", lambda c: F.struct(V.squared_distance(F.col("vec"), c["centroid"]).alias("d"), c["partition_index"].alias("p"), c["centroid"].alias("c"))))
    found = queries.join(F.broadcast(gathered)).select("query_id", "vec", F.posexplode(F.slice(near, 1, nprobe)).alias("probe_rank", "best"))
    return found.select("query_id", F.col("best.p").alias("partition_index"), "probe_rank", F.col("best.d").alias("squared_distance"), V.subtract("vec", "best.c").alias("localized"))


def distance_table_sql(probes: DataFrame, codebooks: DataFrame, divisions: int, vector_size: int) -> DataFrame:
    """(query_id, partition_index, division, code, squared_distance)."""
    slices = probes.select("query_id", "partition_index", F.posexplode(V.divide("localized", divisions, vector_size)).alias("division", "sub"))
    joined = slices.join(F.broadcast(codebooks), "division")  # divisions times codes rows
    return joined.select("query_id", "partition_index", "division", "code", V.squared_distance("sub", "code_vector").alias("squared_distance"))


def adc_sql(encoded: DataFrame, table: DataFrame) -> DataFrame:
    """(query_id, partition_index, vector_index, vector_id, squared_distance) of every vector of the probed partitions: codes joined to the table and summed."""
    codes = encoded.select("partition_index", "vector_index", "vector_id", F.posexplode("codes").alias("division", "code"))
    joined = codes.join(table, ["partition_index", "division", "code"])
    return joined.groupBy("query_id", "partition_index", "vector_index", "vector_id").agg(F.sum("squared_distance").alias("squared_distance"))


def n_best(df: DataFrame, n: int, key: str, *ties: str) -> DataFrame:
    """The n rows of the smallest ``key``."""
    if n < 1:
        raise InvalidArgs("n must be positive")
    return df.orderBy(key, *ties).limit(n)


def knn_exact(vectors: DataFrame, query, k: int) -> DataFrame:
    """(vec_ord, squared_distance): the k truly nearest vectors, to measure recall by."""
    distance = V.squared_distance("vec", V.literal(query))
    return vectors.select("vec_ord", distance.alias("squared_distance")).orderBy("squared_distance", "vec_ord").limit(k)

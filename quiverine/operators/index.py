"""Building an index, and asking it."""

from __future__ import annotations

import copy
import threading
from collections import OrderedDict
from collections.abc import Iterable, Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, replace
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiverine.errors import InvalidArgs
from quiverine.operators import attributes as A
from quiverine.operators import kmeans, quantize, query
from quiverine.operators.events import Event, Listener, tell
from quiverine.operators.partitions import number_within, sizes
from quiverine.operators.vectors import Extent, as_column, extent, matrix, numbered
from quiverine.sources.tables import keep, remove, work_path

#: Bytes of a training sample on the driver, whatever the width of vectors.
SAMPLE_BYTES = 256 << 20
#: Bytes of partitions that the driver keeps for ``search``, and values set one by one that wait on it.
RESIDENT_BYTES, PENDING = 256 << 20, 100_000
ENCODED = "partition_index int, vector_index int, vector_id string, codes array<int>"


def stable_id(order: Column, seed: int) -> Column:
    """An id in the form of a version 4 UUID, from the ordinal and a seed: the same whenever it is computed."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), order.cast("string")))
    variant = F.substring(F.lit("89ab"), 1, 4)
    digit = F.substr(variant, F.pmod(F.conv(F.substring(h, 17, 1), 16, 10).cast("int"), F.lit(4)) + 1, F.lit(1))
    parts = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("4"), F.substring(h, 14, 3)), F.concat(digit, F.substring(h, 18, 3)), F.substring(h, 21, 12)]
    return F.concat_ws("-", *parts)


@dataclass(frozen=True)
class IndexBuilder:
    """How to build an index: partitions, divisions, codes per division, and training."""

    partitions: int = 10
    divisions: int = 8
    clusters: int = 16
    seed: int = 0
    sample: int = 65_536
    rounds: int = kmeans.ROUNDS
    epsilon: float = kmeans.EPSILON_FLOAT

    def _with(self, name: str, value: int) -> IndexBuilder:
        if value < 1:
            raise InvalidArgs(f"{name} must be positive")
        return replace(self, **{name: value})

    def with_partitions(self, n: int) -> IndexBuilder:
        return self._with("partitions", n)

    def with_divisions(self, n: int) -> IndexBuilder:
        return self._with("divisions", n)

    def with_clusters(self, n: int) -> IndexBuilder:
        return self._with("clusters", n)

    def with_seed(self, seed: int) -> IndexBuilder:
        return replace(self, seed=seed)

    def build(self, df: DataFrame, order: str = "vec_id", vec: str = "embedding", listener: Listener | None = None) -> Index:
        """An index of the vectors of ``df``; ``order`` is a whole number that tells rows apart.

        Ordinals, widths, counts and divisibility are checked before any
        training. Training sees all vectors of a table of at most ``sample``
        (and of at most SAMPLE_BYTES), else an even sample of about so many;
        every vector is encoded, once, into a table that queries read.
        """
        vectors = numbered(df, order, vec)
        found = extent(vectors)
        n, width = found.n, found.width
        if n < max(self.partitions, self.clusters):
            raise InvalidArgs(f"{n} vectors can't make {self.partitions} partitions and {self.clusters} codes")
        if width % self.divisions:
            raise InvalidArgs(f"vectors of {width} elements can't be cut into {self.divisions} equal divisions")
        tell(listener, "start_ids")
        tell(listener, "finish_ids")
        tell(listener, "start_partition")
        inner = (lambda e: tell(listener, "cluster", event=e)) if listener else None
        most = max(self.partitions * 8, self.clusters * 8, min(self.sample, SAMPLE_BYTES // (8 * width)))
        block = kmeans.sampled(vectors, most, n)
        centroids = kmeans.fit_block(block, self.partitions, self.seed, rounds=self.rounds, epsilon=self.epsilon, listener=inner).centroids
        tell(listener, "finish_partition")
        tell(listener, "start_divide", divisions=self.divisions)
        nearest, _ = kmeans.nearest_block(block, centroids)
        residues = vectors.sparkSession.createDataFrame(_residue_rows(block - centroids[nearest]))
        tell(listener, "finish_divide")
        books = quantize.train_codebooks(residues, self.divisions, self.clusters, width, self.seed, sample=2 * most, rounds=self.rounds, epsilon=self.epsilon, listener=listener)
        return self.encode(vectors, centroids, books, found)

    def encode(self, vectors: DataFrame, centroids: np.ndarray, books: np.ndarray, known: Extent | None = None) -> Index:
        """An index of (vec_ord, vec) by centres and codebooks at hand.

        One pass encodes; its table, in the shared folder, is put in order and
        numbered, and kept in folders by partition. Queries read those only.
        """
        known = known or extent(vectors)
        spark = vectors.sparkSession
        path = work_path(spark, "codes")
        raw = keep(quantize.encode(vectors, centroids, books), path=path)
        placed = number_within(raw, "partition_index", "vec_ord")
        rows = placed.select("partition_index", "vector_index", stable_id(F.col("vec_ord"), self.seed).alias("vector_id"), "codes", "vec_ord")
        index = Index(keep(rows, by=["partition_index"]), centroids, books, known=known)
        remove(spark, path)
        return index


def _residue_rows(rows: np.ndarray) -> pa.Table:
    return pa.table({"vec_ord": pa.array(np.arange(len(rows))), "residue": as_column(rows)})


class Neighbour(NamedTuple):
    """A row of a result that is at hand."""

    partition_index: int
    vector_index: int
    vector_id: str
    squared_distance: float


class _Resident:
    """Partitions that the driver holds: places, ids and codes. The least recently asked for go first."""

    def __init__(self, most: int) -> None:
        self.most, self.size = most, 0
        self.held: OrderedDict[int, tuple[np.ndarray, list[str], np.ndarray]] = OrderedDict()
        self.lock = threading.Lock()

    def get(self, partition: int) -> tuple[np.ndarray, list[str], np.ndarray] | None:
        with self.lock:
            if partition in self.held:
                self.held.move_to_end(partition)
            return self.held.get(partition)

    def put(self, partition: int, index: np.ndarray, ids: list[str], codes: np.ndarray) -> None:
        own = index, ids, codes
        with self.lock:
            if partition not in self.held:
                self.held[partition] = own
                self.size += _bytes_of(len(ids), codes.shape[1])
            while self.size > self.most and len(self.held) > 1:
                _, (_, old, codes) = self.held.popitem(last=False)
                self.size -= _bytes_of(len(old), codes.shape[1])


def _bytes_of(vectors: int, divisions: int) -> int:
    return vectors * (2 * divisions + 4 + 93)  # two bytes a code, a place, and an id as Python holds it


class Index:
    """Encoded vectors with the centres and codebooks that read them, and attributes.

    ``encoded`` has ENCODED's columns, and ``vec_ord`` while the index has not
    been stored. ``query`` gives a DataFrame and leaves all to the cluster.
    ``search`` gives rows at once: partitions that fit in ``resident`` bytes
    are read once, kept on the driver and searched there; larger ones are
    searched by the cluster.
    """

    def __init__(self, encoded: DataFrame | None, centroids: np.ndarray | None, books: np.ndarray | None, log: list[DataFrame] | None = None, known: Extent | None = None, resident: int = RESIDENT_BYTES) -> None:
        self._encoded, self._centroids, self._books = encoded, centroids, books
        self._norms: np.ndarray | None = None
        self._log = list(log or [])
        self._known = known
        # Values set one by one: a chain of (entry, earlier entries) that copies of the index share.
        self._pending: tuple | None = None
        self._seq = 0
        self._names: list[str] | None = None
        self._sizes: dict[int, int] | None = None
        self._resident = _Resident(resident)
        self._pool: ThreadPoolExecutor | None = None

    # What is held

    @property
    def encoded(self) -> DataFrame:
        return self.rows()

    @property
    def centroids(self) -> np.ndarray:
        return self._centroids

    @centroids.setter
    def centroids(self, rows: np.ndarray) -> None:
        self._centroids = rows

    @property
    def books(self) -> np.ndarray:
        return self._books

    @books.setter
    def books(self, rows: np.ndarray) -> None:
        self._books, self._norms = rows, None

    def rows(self, partitions: Sequence[int] | None = None) -> DataFrame:
        """The encoded vectors, of some partitions if they are named."""
        return self._encoded if partitions is None else self._encoded.filter(F.col("partition_index").isin(list(partitions)))

    @property
    def spark(self):
        return self._encoded.sparkSession

    @property
    def _knows_ordinals(self) -> bool:
        return "vec_ord" in self._encoded.columns

    @property
    def vector_size(self) -> int:
        return self.centroids.shape[1]

    @property
    def num_partitions(self) -> int:
        return self.centroids.shape[0]

    @property
    def num_divisions(self) -> int:
        return self.books.shape[0]

    @property
    def num_codes(self) -> int:
        return self.books.shape[1]

    @property
    def subvector_size(self) -> int:
        return self.vector_size // self.num_divisions

    @property
    def num_vectors(self) -> int:
        return sum(self.sizes().values())

    def sizes(self) -> dict[int, int]:
        """The number of vectors of each partition that has any, counted once."""
        if self._sizes is None:
            self._sizes = {r["partition_index"]: r["num_vectors"] for r in sizes(self._encoded).collect()}
        return self._sizes

    def vector_ids(self) -> DataFrame:
        return self.encoded.select("vector_id")

    def partition_sizes(self) -> DataFrame:
        return self.spark.createDataFrame(sorted(self.sizes().items()), "partition_index int, num_vectors long")

    def _check_partition(self, index: int) -> None:
        if not 0 <= index < self.num_partitions:
            raise InvalidArgs(f"no partition {index}")

    def partition(self, index: int) -> DataFrame:
        """The rows of one partition in their order."""
        self._check_partition(index)
        return self.rows([index]).orderBy("vector_index")

    def encoded_vector(self, partition: int, index: int) -> list[int] | None:
        row = self.rows([partition]).filter(F.col("vector_index") == index).select("codes").first()
        return None if row is None else list(row["codes"])

    def vector_id(self, partition: int, index: int) -> str | None:
        row = self.rows([partition]).filter(F.col("vector_index") == index).select("vector_id").first()
        return None if row is None else row["vector_id"]

    def centroid_table(self) -> DataFrame:
        return self.spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(self.centroids)], "partition_index int, centroid array<double>")

    def codebook_table(self) -> DataFrame:
        rows = [(d, c, self.books[d, c].tolist()) for d in range(self.num_divisions) for c in range(self.num_codes)]
        return self.spark.createDataFrame(rows, "division int, code int, code_vector array<double>")

    def codebook(self, division: int) -> np.ndarray:
        if not 0 <= division < self.num_divisions:
            raise InvalidArgs(f"no division {division}")
        return self.books[division]

    # Queries

    def probed(self, vector, nprobe: int) -> list[int]:
        """The partitions that a query of this vector reads, nearest first."""
        block = np.asarray(vector, float).reshape(1, -1)
        query.check_query(block, self.centroids, 1, nprobe)
        return query.probe(block, self.centroids, nprobe)[0][0].tolist()

    def query(self, vector, k: int, nprobe: int) -> DataFrame:
        """The k nearest of one vector, nearest first: (partition_index, vector_index, vector_id, squared_distance)."""
        return query.knn(self.rows(self.probed(vector, nprobe)), vector, self.centroids, self.books, k, nprobe)

    def query_batch(self, vectors, k: int, nprobe: int) -> DataFrame:
        """The k nearest of many vectors; query_id is a vector's place among them."""
        return query.knn_batch(self.rows(), np.asarray(vectors, float), self.centroids, self.books, k, nprobe)

    def query_table(self, queries: DataFrame, k: int, nprobe: int) -> DataFrame:
        """The k nearest of every row of a table (query_id, vec) of any size."""
        return query.knn_table(self.rows(), self.partition_sizes(), queries, self.centroids, self.books, k, nprobe)

    def query_partition(self, vector, partition: int, k: int) -> DataFrame:
        """The k nearest of one vector within one partition."""
        self._check_partition(partition)
        block = np.asarray(vector, float).reshape(1, -1)
        query.check_query(block, self.centroids, k, self.num_partitions)
        found = query.scan(self.rows([partition]), block, self.centroids, self.books, k, self.num_partitions)
        return found.drop("query_id").orderBy("squared_distance", "vector_index").limit(k)

    def search(self, vector, k: int, nprobe: int, listener: Listener | None = None) -> list[Neighbour]:
        """The rows of ``query`` at once; ``listener`` hears each step when it begins and when it is done."""
        tell(listener, "start_query_init")
        self.centroids, self.books  # noqa: B018  a stored index reads them when they are first asked for
        tell(listener, "finish_query_init")
        near = self._probe(vector, k, nprobe, listener)
        self._load(near)
        return self._answer(vector, near, k, listener)

    def query_async(self, vector, k: int, nprobe: int, listener: Listener | None = None) -> Future:
        """A future of the rows of ``search``. What it needs is read side by side: centres beside codebooks, partitions beside each other.

        ``listener`` hears the twelve events of asynchronous queries, of several threads.
        """
        pools = self._pools()
        ask, read = pools.ask, pools.read

        def told(what: str, work, **detail):
            tell(listener, f"start_{what}", **detail)
            found = work()
            tell(listener, f"finish_{what}", **detail)
            return found

        def run() -> list[Neighbour]:
            books = read.submit(told, "load_codebooks", lambda: self.books)
            told("load_centroids", lambda: self.centroids)
            near = self._probe(vector, k, nprobe, listener)
            loads = [read.submit(told, "load_partition", lambda p=p: self._load([p]), partition=p) for p in near]
            books.result()
            return self._answer(vector, near, k, listener, loads)

        return ask.submit(run)

    def _pools(self) -> _Pools:
        if self._pool is None:
            self._pool = _Pools(ThreadPoolExecutor(8), ThreadPoolExecutor(8))
        return self._pool

    def _probe(self, vector, k: int, nprobe: int, listener: Listener | None) -> list[int]:
        query.check_query(np.asarray(vector, float).reshape(1, -1), self.centroids, k, nprobe)
        tell(listener, "start_probe")
        near = query.probe(np.asarray(vector, float).reshape(1, -1), self.centroids, nprobe)[0][0].tolist()
        tell(listener, "finish_probe", partitions=near)
        return near

    def _fits(self, partition: int) -> bool:
        return _bytes_of(self.sizes().get(partition, 0), self.num_divisions) <= self._resident.most

    def _load(self, partitions: Sequence[int]) -> None:
        """Read the partitions that fit and aren't held yet."""
        missing = [p for p in partitions if self._fits(p) and self._resident.get(p) is None]
        if missing:
            for p, table in self._read(missing).items():
                order = np.argsort(table.column("vector_index").to_numpy(), kind="stable")
                codes = matrix(table.column("codes").combine_chunks()).reshape(-1, self.num_divisions)
                ids = table.column("vector_id").take(pa.array(order)).to_pylist()
                self._resident.put(p, table.column("vector_index").to_numpy()[order], ids, codes[order].astype(np.uint16 if self.num_codes <= 1 << 16 else np.uint32))

    def _read(self, partitions: list[int]) -> dict[int, pa.Table]:
        """Rows of partitions of bounded size, by one job."""
        found = self.rows(partitions).select("partition_index", "vector_index", "vector_id", "codes").toArrow()
        of = found.column("partition_index").to_numpy()
        return {p: found.filter(pa.array(of == p)) for p in partitions}

    def _answer(self, vector, near: list[int], k: int, listener: Listener | None, loads: list[Future] | None = None) -> list[Neighbour]:
        """The k best of the probed partitions, each searched as it is there."""
        if self._norms is None:
            self._norms = query.code_norms(self.books)
        tables = query.distance_tables(np.asarray(vector, float), self.centroids[near], self.books, self._norms)
        found = []
        for n, p in enumerate(near):
            if loads:
                loads[n].result()
            tell(listener, "start_partition_query", partition=p)
            found += self._search_partition(vector, p, tables[n], k)
            tell(listener, "finish_partition_query", partition=p)
        return self._select(found, k, listener)

    def _search_partition(self, vector, partition: int, table: np.ndarray, k: int) -> list[Neighbour]:
        held = self._resident.get(partition)
        if held is None and self._fits(partition):  # others have pushed it out
            self._load([partition])
            held = self._resident.get(partition)
        if held is None:
            return [Neighbour(*r) for r in self.query_partition(vector, partition, k).collect()]
        index, ids, codes = held
        d = query.table_distances(table, codes)
        near = query.nearest_rows(d, k)
        near = near[np.lexsort((index[near], d[near]))[:k]]
        return [Neighbour(partition, int(index[i]), ids[i], float(d[i])) for i in near]

    @staticmethod
    def _select(found: list[Neighbour], k: int, listener: Listener | None) -> list[Neighbour]:
        tell(listener, "start_select", k=k)
        found = sorted(found, key=lambda r: (r.squared_distance, r.partition_index, r.vector_index))[:k]
        tell(listener, "finish_select", k=k)
        return found

    # Attributes

    def _with(self, **changes) -> Index:
        """A copy with its own attributes; the vectors, and what is held of them, are shared."""
        other = copy.copy(self)
        other._pool = None
        for name, value in changes.items():
            setattr(other, name, value)
        return other

    def set_attribute_at(self, vec_ord: int, name: str, value: str | int) -> Index:
        """An index in which the vector with this ordinal has this value.

        No job runs: values wait on the driver until attributes are read, or
        ``PENDING`` of them wait. An unknown ordinal raises at once if the
        index's ordinals are all numbers from a first to a last, else when
        attributes are read.
        """
        text, number = A.value_of(value)
        if not self._knows_ordinals:
            raise InvalidArgs("a stored index knows its vectors by vector_id only")
        if self._known is not None and (not self._known.first <= vec_ord <= self._known.last):
            raise InvalidArgs("an attribute is set on an unknown vector")
        depth = self._pending[2] + 1 if self._pending else 1
        other = self._with(_pending=((vec_ord, name, text, number, self._seq), self._pending, depth), _seq=self._seq + 1, _names=None)
        if depth >= PENDING:
            other._flush()
        return other

    def set_attributes(self, values: DataFrame, name: str) -> Index:
        """An index with the values (vec_ord or vector_id, value) of a table under one name; raises if a vector is unknown."""
        key = "vec_ord" if "vec_ord" in values.columns else "vector_id"
        if key == "vec_ord" and not self._knows_ordinals:
            raise InvalidArgs("a stored index knows its vectors by vector_id only")
        self._flush()
        own = values.select(key, "value", F.lit(name).alias("name"), F.lit(self._seq).cast("long").alias("seq"))
        return self._with(_log=[*self._log, self._placed(own, key)], _seq=self._seq + 1, _names=None)

    def _placed(self, values: DataFrame, key: str) -> DataFrame:
        """Log entries of (key, name, value, seq), kept in folders by partition."""
        rows = self.rows()
        known = rows.select("partition_index", "vector_id", *([key] if key == "vec_ord" else []))
        own = keep(values.join(known, key, "left").select("partition_index", "vector_id" if key == "vec_ord" else key, "name", "value", "seq"), by=["partition_index"])
        if not own.filter("partition_index is null").isEmpty():  # a folder of their own
            raise InvalidArgs("an attribute is set on an unknown vector")
        return own

    def _flush(self) -> None:
        """Place the values that wait: one job for all."""
        if self._pending is None:
            return
        rows, at = [], self._pending
        while at is not None:
            (vec_ord, name, text, number, seq), at, _ = at
            rows.append((vec_ord, name, (text, number), seq))
        values = self.spark.createDataFrame(rows, f"vec_ord long, name string, value {A.VALUE}, seq long")
        self._log = [*self._log, self._placed(values, "vec_ord")]
        self._pending = None

    def written(self, partitions: Sequence[int] | None = None) -> DataFrame:
        """The log of attributes, all that was written, of some partitions if they are named."""
        self._flush()
        if not self._log:
            return self.spark.createDataFrame([], A.LOG)
        log = self._log[0]
        for more in self._log[1:]:
            log = log.unionByName(more)
        return log if partitions is None else log.filter(F.col("partition_index").isin(list(partitions)))

    def attributes(self, partitions: Sequence[int] | None = None) -> DataFrame:
        """(partition_index, vector_id, name, value), the last value of each name."""
        return A.last_wins(self.written(partitions))

    def names(self) -> list[str]:
        if self._names is None:
            self._names = [r["name"] for r in self.written().select("name").distinct().orderBy("name").collect()]
        return self._names

    def get_attribute(self, vector_id: str, name: str, partition: int | None = None) -> str | int | None:
        """One value, or None if the vector lacks it; raises if there is no such vector. A partition named, as a result names it, is all that is read."""
        where = None if partition is None else [partition]
        own = F.col("vector_id") == vector_id
        if self.rows(where).filter(own).isEmpty():
            raise InvalidArgs(f"no vector {vector_id}")
        row = A.last_wins(self.written(where).filter(own & (F.col("name") == name))).select("value").first()
        return None if row is None else A.python_value(row["value"])

    def get_attribute_async(self, vector_id: str, name: str, partition: int | None = None) -> Future:
        return self._pools().ask.submit(self.get_attribute, vector_id, name, partition)

    def with_attribute(self, results: DataFrame, name: str, to: str = "value", partitions: Sequence[int] | None = None) -> DataFrame:
        """Query results with one attribute, null where a vector lacks it.

        ``partitions`` names those that the results can come from (``probed``
        tells them): only their logs are read.
        """
        return A.with_attribute(results, self.attributes(partitions), name, to)

    def all_attributes(self) -> DataFrame:
        """(vector_id, attributes): every vector's map, empty where it has none."""
        return A.all_attributes(self.encoded, self.attributes())


class _Pools(NamedTuple):
    """Threads for queries, and others for what queries wait for."""

    ask: ThreadPoolExecutor
    read: ThreadPoolExecutor


def recall(index: Index, vectors: DataFrame, queries: Iterable, k: int, nprobe: int) -> float:
    """The share of truly nearest vectors that queries find; ``index`` must know its vectors' ordinals."""
    hits = total = 0
    for q in queries:
        true = {r["vec_ord"] for r in query.knn_exact(vectors, q, k).collect()}
        found = index.query(q, k, nprobe).join(index.encoded.select("vector_id", "vec_ord"), "vector_id")
        hits += len(true & {r["vec_ord"] for r in found.collect()})
        total += len(true)
    return hits / total if total else 1.0


__all__ = ["Event", "Index", "IndexBuilder", "Neighbour", "recall", "stable_id"]

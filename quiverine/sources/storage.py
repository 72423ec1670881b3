"""Stored indexes: tables in a folder, named by their contents, and a manifest.

A snapshot is immutable. Its tables are Parquet: vectors and attribute logs in
folders by partition, codebooks in folders by division. The manifest, which
lists every file with the digest of its bytes and their number, is written last
and so commits the snapshot. Its own digest is the snapshot's id. Any path that
Spark can write will do.

Loading reads the manifest only. Centres, each codebook, and each partition's
vectors and attributes are read, and verified, when they are first asked for.
"""

from __future__ import annotations

import io
import json
import re
import threading
from collections.abc import Iterator, Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiverine.errors import InvalidArgs, InvalidData, StorageError, VerificationFailure
from quiverine.functions.content import content_id, content_id_of
from quiverine.operators import attributes as A
from quiverine.operators.index import ENCODED, RESIDENT_BYTES, Index
from quiverine.operators.vectors import matrix

VECTORS, CENTROIDS, CODEBOOKS, ATTRIBUTES = "partitions", "centroids", "codebooks", "attributes"
STORED_LOG = f"vector_id string, name_index int, value {A.VALUE}, partition_index int"
_SUFFIX = ".manifest.json"
#: Vectors of a file.
SLICE = 1_000_000
#: What an attribute takes in memory, over what it takes in its file.
UNPACKED = 20


@contextmanager
def reading(what: str) -> Iterator[None]:
    """Errors of Spark and of file systems as errors of the engine."""
    try:
        yield
    except (Py4JJavaError, PySparkException) as error:
        if "ChecksumException" in str(error):
            raise VerificationFailure(f"{what} does not have its checksum") from error
        raise StorageError(f"{what} can't be read or written: {str(error).splitlines()[0]}") from error


def _filesystem(spark: SparkSession, path: str):
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()), own


_default_scheme: dict[str, str] = {}


def _local_path(spark: SparkSession, path: str) -> str | None:
    """The path in the local file system, if that is what Spark means by it."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        app = spark.sparkContext.applicationId
        if app not in _default_scheme:
            _default_scheme[app] = spark._jvm.org.apache.hadoop.fs.FileSystem.getDefaultUri(spark._jsc.hadoopConfiguration()).getScheme()
        return path if _default_scheme[app] == "file" and path.startswith("/") else None
    return "/" + rest.lstrip("/") if scheme == "file" else None


def write_bytes(spark: SparkSession, folder: str, content: bytes, suffix: str) -> str:
    """Write a file named by its content's digest; returns the digest."""
    name = content_id_of(content)
    with reading(f"{folder}/{name}{suffix}"):
        fs, path = _filesystem(spark, f"{folder}/{name}{suffix}")
        out = fs.create(path, True)
        try:
            out.write(bytearray(content))
        finally:
            out.close()
    return name


def read_bytes(spark: SparkSession, path: str, verify: str | None = None) -> bytes:
    """A small file's bytes; raises if they don't have the digest ``verify``.

    What is to be verified and lies in the driver's own file system is read
    past Hadoop, whose bytes come to Python slowly.
    """
    local = _local_path(spark, path) if verify is not None else None
    if local is not None:
        try:
            with open(local, "rb") as file:
                content = file.read()
        except OSError as error:
            raise StorageError(f"{path} can't be read: {error}") from error
    else:
        with reading(path):
            fs, own = _filesystem(spark, path)
            stream = fs.open(own)
            try:
                content = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
            finally:
                stream.close()
    if verify is not None and content_id_of(content) != verify:
        raise VerificationFailure(f"{path} does not have the digest that names it")
    return content


def file_digests(spark: SparkSession, folder: str, files: Sequence[str] | None = None) -> DataFrame:
    """(path below the folder, digest, bytes) of every Parquet file in it, or of those named."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    found = reader.load(folder if files is None else [f"{folder}/{f}" for f in files])
    # What stands before the last mention of one of our tables is where the folder happens to be.
    below = F.regexp_extract("path", rf".*/((?:{VECTORS}|{CENTROIDS}|{CODEBOOKS}|{ATTRIBUTES})/.*)$", 1)
    return found.select(below.alias("path"), content_id(F.col("content")).alias("digest"), F.col("length").alias("bytes"))


def save(index: Index, folder: str, compression: str = "zstd") -> str:
    """Write a snapshot; returns its id."""
    spark = index.spark
    with reading(folder):
        fs, path = _filesystem(spark, folder)
        if fs.exists(path) and fs.listStatus(path):
            raise InvalidArgs(f"{folder} is not empty; a snapshot is not written over")
        write = lambda df: df.write.option("compression", compression)
        vectors = index.rows().select("vector_index", "vector_id", "codes", "partition_index")
        # A file for each partition and slice of the places in it.
        write(vectors.repartition("partition_index", F.floor(F.col("vector_index") / SLICE))).partitionBy("partition_index").parquet(f"{folder}/{VECTORS}")
        write(index.centroid_table().coalesce(1)).parquet(f"{folder}/{CENTROIDS}")
        write(index.codebook_table().coalesce(1)).partitionBy("division").parquet(f"{folder}/{CODEBOOKS}")
        names = index.names()
        log = A.encode_names(index.attributes(), spark.createDataFrame(list(enumerate(names)), "name_index int, name string"))
        stored = log.select("vector_id", "name_index", "value", "partition_index")
        sizes = index.sizes()
        slices = -(-max(sizes.values(), default=1) // SLICE)
        write(stored.repartition("partition_index", F.pmod(F.hash("vector_id"), F.lit(slices)))).partitionBy("partition_index").parquet(f"{folder}/{ATTRIBUTES}")
        files = {r["path"]: [r["digest"], r["bytes"]] for r in file_digests(spark, folder).collect()}
    header = {
        "vector_size": index.vector_size, "num_partitions": index.num_partitions, "num_divisions": index.num_divisions, "num_codes": index.num_codes,
        "partition_sizes": [sizes.get(p, 0) for p in range(index.num_partitions)], "attribute_names": names, "files": files,
    }
    return write_bytes(spark, folder, json.dumps(header, sort_keys=True).encode(), _SUFFIX)


def snapshot_id(spark: SparkSession, folder: str) -> str:
    """The id of the one snapshot in a folder."""
    with reading(folder):
        fs, path = _filesystem(spark, folder)
        if not fs.exists(path):
            raise StorageError(f"no folder {folder}")
        found = [f.getPath().getName() for f in fs.listStatus(path)]
    found = [f.removesuffix(_SUFFIX) for f in found if f.endswith(_SUFFIX) and not f.startswith(".")]
    if len(found) != 1:
        raise InvalidData(f"{folder} holds {len(found)} manifests")
    return found[0]


def header(spark: SparkSession, folder: str, name: str | None = None) -> dict:
    """The manifest, verified and checked."""
    name = name or snapshot_id(spark, folder)
    found = json.loads(read_bytes(spark, f"{folder}/{name}{_SUFFIX}", verify=name))
    for key in ("vector_size", "num_partitions", "num_divisions", "num_codes"):
        if not isinstance(found.get(key), int) or found[key] < 1:
            raise InvalidData(f"the manifest's {key} is not a positive number")
    if found["vector_size"] % found["num_divisions"]:
        raise InvalidData("vector_size is not a multiple of num_divisions")
    if found.get("attribute_names") != sorted(set(found.get("attribute_names", []))):
        raise InvalidData("attribute names are not distinct and in order")
    if len(found.get("partition_sizes", [])) != found["num_partitions"]:
        raise InvalidData("the manifest does not tell the size of every partition")
    return found


def verify(spark: SparkSession, folder: str, files: dict[str, list]) -> None:
    """Raise unless the folder holds just these files, with these digests."""
    with reading(folder):
        now = {r["path"]: r["digest"] for r in file_digests(spark, folder).collect()}
    _compare(now, {path: digest for path, (digest, _) in files.items()})


def _compare(now: dict[str, str], wanted: dict[str, str]) -> None:
    if now != wanted:
        bad = sorted(k for k in now.keys() | wanted.keys() if now.get(k) != wanted.get(k))
        raise VerificationFailure(f"{len(bad)} files differ from the manifest, {bad[0]} first")


class StoredIndex(Index):
    """An index whose parts are read when they are asked for.

    Subclasses say how: ``_read_centroids``, ``_read_codebook``,
    ``_read`` (rows of partitions of bounded size, on the driver), ``_rows``
    and ``_base_log`` (tables of partitions, after verifying them), and
    ``_read_log`` (a partition's attributes, if their size is bounded).
    """

    def __init__(self, spark: SparkSession, folder: str, head: dict, sizes: dict[int, int] | None, resident: int = RESIDENT_BYTES) -> None:
        super().__init__(None, None, None, resident=resident)
        self._spark, self.folder, self.head = spark, folder, head
        self._sizes = sizes
        self._codebooks: dict[int, np.ndarray] = {}
        self._checked: dict[str, set[int]] = {VECTORS: set(), ATTRIBUTES: set(), "entries": set()}
        self._logs: dict[int, dict[str, dict]] = {}
        self._guard = threading.RLock()

    # What the header tells

    @property
    def spark(self) -> SparkSession:
        return self._spark

    @property
    def vector_size(self) -> int:
        return self.head["vector_size"]

    @property
    def num_partitions(self) -> int:
        return self.head["num_partitions"]

    @property
    def num_divisions(self) -> int:
        return self.head["num_divisions"]

    @property
    def num_codes(self) -> int:
        return self.head["num_codes"]

    @property
    def _knows_ordinals(self) -> bool:
        return False

    def names(self) -> list[str]:
        return list(self.head["attribute_names"]) if not self._log else sorted({*self.head["attribute_names"], *super().names()})

    # What is read

    @property
    def centroids(self) -> np.ndarray:
        with self._guard:
            if self._centroids is None:
                rows = self._read_centroids()
                if rows.shape != (self.num_partitions, self.vector_size):
                    raise InvalidData("the centroids do not have the header's shape")
                self._centroids = rows
            return self._centroids

    @property
    def books(self) -> np.ndarray:
        if self._books is None:
            self._books = np.stack([self.codebook(d) for d in range(self.num_divisions)])
        return self._books

    def codebook(self, division: int) -> np.ndarray:
        if not 0 <= division < self.num_divisions:
            raise InvalidArgs(f"no division {division}")
        if division not in self._codebooks:
            rows = self._read_codebook(division)
            if rows.shape != (self.num_codes, self.subvector_size):
                raise InvalidData(f"codebook {division} does not have the header's shape")
            self._codebooks[division] = rows
        return self._codebooks[division]

    def _unchecked(self, what: str, partitions: Sequence[int] | None) -> list[int]:
        wanted = range(self.num_partitions) if partitions is None else partitions
        return [p for p in wanted if p not in self._checked[what]]

    def rows(self, partitions: Sequence[int] | None = None) -> DataFrame:
        return self._rows(partitions)

    def written(self, partitions: Sequence[int] | None = None) -> DataFrame:
        """The log of attributes; that of the snapshot is checked, by partition, when it is first asked for."""
        base = self._base_log(partitions)
        with self._guard:
            if left := self._unchecked("entries", partitions):
                A.check_log(self._base_log(left), self._rows(left))
                self._checked["entries"].update(left)
        if not self._log:
            return base
        return base.unionByName(super().written(partitions))

    def get_attribute(self, vector_id: str, name: str, partition: int | None = None) -> str | int | None:
        """As of any index; a partition's attributes, if their size is bounded, are read once and kept."""
        if partition is None or self._log or not self._fits(partition):
            return super().get_attribute(vector_id, name, partition)
        self._check_partition(partition)
        if partition not in self._logs:
            found = self._read_log(partition)
            if found is None:
                return super().get_attribute(vector_id, name, partition)
            self._load([partition])
            known = set(self._resident.get(partition)[1])
            if not known >= found.keys():
                raise InvalidData("an attribute log names a vector that its partition doesn't hold")
            while len(self._logs) > 1 and sum(self._log_bytes(p) for p in [*self._logs, partition]) > self._resident.most:
                self._logs.pop(next(iter(self._logs)))
            self._logs[partition] = {v: found.get(v, {}) for v in known}
        own = self._logs[partition].get(vector_id)
        if own is None:
            raise InvalidArgs(f"no vector {vector_id}")
        return own.get(name)

    def _log_bytes(self, partition: int) -> int:
        return self.sizes().get(partition, 0) * 100


class Snapshot(StoredIndex):
    """An index on a snapshot."""

    def __init__(self, spark: SparkSession, folder: str, head: dict, resident: int = RESIDENT_BYTES) -> None:
        super().__init__(spark, folder, head, {p: n for p, n in enumerate(head["partition_sizes"]) if n}, resident)
        self._files: dict[tuple[str, int | None], list[str]] = {}
        for path in sorted(head["files"]):
            place = re.search(r"/(?:partition_index|division)=(\d+)/", path)
            self._files.setdefault((path.split("/")[0], int(place[1]) if place else None), []).append(path)

    def _table(self, name: str, place: int | None = None) -> pa.Table:
        """The verified files of a bounded table, on the driver."""
        files = self._files.get((name, place), [])
        tables = [pq.ParquetFile(io.BytesIO(read_bytes(self._spark, f"{self.folder}/{f}", verify=self.head["files"][f][0]))).read() for f in files]
        if not tables:
            raise InvalidData(f"the snapshot holds no {name} {'' if place is None else place}".rstrip())
        return pa.concat_tables(tables)

    def _read_centroids(self) -> np.ndarray:
        rows = self._table(CENTROIDS).sort_by("partition_index")
        return matrix(rows.column("centroid").combine_chunks())

    def _read_codebook(self, division: int) -> np.ndarray:
        rows = self._table(CODEBOOKS, division).sort_by("code")
        return matrix(rows.column("code_vector").combine_chunks())

    def _read(self, partitions: list[int]) -> dict[int, pa.Table]:
        empty = pa.table({"vector_index": pa.array([], pa.int32()), "vector_id": pa.array([], pa.string()), "codes": pa.array([], pa.list_(pa.int32()))})
        return {p: self._table(VECTORS, p) if (VECTORS, p) in self._files else empty for p in partitions}

    def _verify(self, name: str, partitions: Sequence[int] | None) -> None:
        with self._guard:
            left = self._unchecked(name, partitions)
            files = [f for p in left for f in self._files.get((name, p), [])]
            if files:
                with reading(self.folder):
                    now = {r["path"]: r["digest"] for r in file_digests(self._spark, self.folder, files).collect()}
                _compare(now, {f: self.head["files"][f][0] for f in files})
            self._checked[name].update(left)

    def _rows(self, partitions: Sequence[int] | None) -> DataFrame:
        self._verify(VECTORS, partitions)
        found = self._spark.read.schema(ENCODED).parquet(f"{self.folder}/{VECTORS}").select("partition_index", "vector_index", "vector_id", "codes")
        return found if partitions is None else found.filter(F.col("partition_index").isin(list(partitions)))

    def _base_log(self, partitions: Sequence[int] | None) -> DataFrame:
        self._verify(ATTRIBUTES, partitions)
        names = self._spark.createDataFrame(list(enumerate(self.head["attribute_names"])), "name_index int, name string")
        found = self._spark.read.schema(STORED_LOG).parquet(f"{self.folder}/{ATTRIBUTES}")
        if partitions is not None:
            found = found.filter(F.col("partition_index").isin(list(partitions)))
        return found.join(names, "name_index", "left").select("partition_index", "vector_id", "name", "value", F.lit(-1).cast("long").alias("seq"))

    def _log_bytes(self, partition: int) -> int:
        return UNPACKED * sum(self.head["files"][f][1] for f in self._files.get((ATTRIBUTES, partition), []))

    def _read_log(self, partition: int) -> dict[str, dict] | None:
        if self._log_bytes(partition) > self._resident.most:
            return None
        out: dict[str, dict] = {}
        if (ATTRIBUTES, partition) in self._files:
            names = self.head["attribute_names"]
            table = self._table(ATTRIBUTES, partition).combine_chunks()
            texts, numbers = table.column("value").combine_chunks().flatten()
            for vector_id, at, text, number in zip(table.column("vector_id").to_pylist(), table.column("name_index").to_pylist(), texts.to_pylist(), numbers.cast(pa.uint64()).to_pylist(), strict=True):
                if vector_id is None or at is None or not 0 <= at < len(names) or (text is None and number is None):
                    raise InvalidData("an attribute log holds an entry without id, name or value")
                out.setdefault(vector_id, {})[names[at]] = number if text is None else text
        return out


def load(spark: SparkSession, folder: str, name: str | None = None, check_files: bool = False, resident: int = RESIDENT_BYTES) -> Snapshot:
    """An index on a snapshot. What it holds is read, and verified, as it is asked for; ``check_files`` verifies all of it first."""
    head = header(spark, folder, name)
    if check_files:
        verify(spark, folder, head["files"])
    return Snapshot(spark, folder, head, resident)


def load_async(spark: SparkSession, folder: str, name: str | None = None) -> Future:
    """A future of ``load``."""
    pool = ThreadPoolExecutor(1)
    try:
        return pool.submit(load, spark, folder, name)
    finally:
        pool.shutdown(wait=False)

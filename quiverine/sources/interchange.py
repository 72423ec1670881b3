"""Indexes in the content-addressed message files that other engines read and write.

Layout: a header at the root, ``partitions`` (partitions, and their centroids),
``codebooks`` and ``attributes``. A file's name is the digest of its bytes on
disk. Header, partitions and attribute logs are zlib streams; centroids and
codebooks are plain. A file is verified when it is first read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator, Sequence
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiverine.errors import InvalidArgs, InvalidData, StorageError, VerificationFailure
from quiverine.functions.content import content_id
from quiverine.operators import attributes as A
from quiverine.operators.index import ENCODED, RESIDENT_BYTES, Index
from quiverine.operators.query import BROADCAST_BYTES
from quiverine.operators.vectors import as_column
from quiverine.sources import messages
from quiverine.sources.storage import ATTRIBUTES, UNPACKED, VECTORS, StoredIndex, _filesystem, read_bytes, reading, write_bytes

SUFFIX = ".binpb"


def inflate(content: bytes) -> bytes:
    """A zlib stream that fills the file."""
    stream = zlib.decompressobj()
    try:
        out = stream.decompress(content) + stream.flush()
    except zlib.error as e:
        raise InvalidData(f"a compressed file can't be read: {e}") from None
    if not stream.eof or stream.unused_data:
        raise InvalidData("a compressed file is cut, or goes on after its end")
    return out


def uuid_of(text: str) -> dict[str, int]:
    number = uuid.UUID(text).int
    return {"upper": number >> 64, "lower": number & (1 << 64) - 1}


def text_of(halves: dict[str, int] | None) -> str:
    if halves is None:
        raise InvalidData("an id is missing")
    return str(uuid.UUID(int=halves["upper"] << 64 | halves["lower"]))


def export(index: Index, folder: str) -> str:
    """Write an index; returns the header's name.

    Tasks put the messages together, one for each partition as the format has
    it; the driver writes them one after the other.
    """
    spark = index.spark
    write = lambda kind, message, where, pack: write_bytes(spark, f"{folder}{where}", (zlib.compress if pack else bytes)(messages.dump(kind, message)), SUFFIX)
    names, size, divisions = index.names(), index.vector_size, index.num_divisions
    place = {name: k for k, name in enumerate(names)}
    if index.centroids.nbytes > BROADCAST_BYTES:
        raise InvalidArgs("the centres are too large to be sent to every task")
    sent = spark.sparkContext.broadcast(index.centroids)

    def partition(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("vector_index")
        codes = table.column("codes").combine_chunks().flatten().to_numpy().astype(np.uint32)
        message = {
            "vector_size": size, "num_divisions": divisions, "centroid": sent.value[key[0].as_py()], "encoded_vectors": {"vector_size": divisions, "data": codes},
            "vector_ids": [uuid_of(u) for u in table.column("vector_id").to_pylist()],
        }
        return pa.table({"partition_index": pa.array([key[0].as_py()], pa.int32()), "content": pa.array([zlib.compress(messages.dump("partition", message))], pa.binary())})

    def entries(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.sort_by([("vector_id", "ascending"), ("name", "ascending")]).to_pylist()
        own = [{"vector_id": uuid_of(r["vector_id"]), "name_index": place[r["name"]], "value": r["value"]} for r in rows]
        # What stands before the entries, the name of the partition's file, is added when that is known.
        return pa.table({"partition_index": pa.array([key[0].as_py()], pa.int32()), "content": pa.array([messages.dump("attributes_log", {"partition_id": "", "entries": own})], pa.binary())})

    schema = "partition_index int, content binary"
    partition_ids, log_ids = {}, {}
    for row in index.rows().groupBy("partition_index").applyInArrow(partition, schema).toLocalIterator():
        partition_ids[row["partition_index"]] = write_bytes(spark, f"{folder}/partitions", bytes(row["content"]), SUFFIX)
    for p in range(index.num_partitions):
        if p not in partition_ids:
            message = {"vector_size": size, "num_divisions": divisions, "centroid": index.centroids[p], "encoded_vectors": {"vector_size": divisions, "data": []}}
            partition_ids[p] = write("partition", message, "/partitions", True)
    for row in index.attributes().groupBy("partition_index").applyInArrow(entries, schema).toLocalIterator():
        p = row["partition_index"]
        content = messages.dump("attributes_log", {"partition_id": partition_ids[p]}) + bytes(row["content"])
        log_ids[p] = write_bytes(spark, f"{folder}/attributes", zlib.compress(content), SUFFIX)
    for p in range(index.num_partitions):
        if p not in log_ids:
            log_ids[p] = write("attributes_log", {"partition_id": partition_ids[p], "entries": []}, "/attributes", True)
    vectors = lambda rows: {"vector_size": rows.shape[1], "data": rows.ravel()}
    in_order = lambda ids: [ids[p] for p in range(index.num_partitions)]
    header = {
        "vector_size": size, "num_partitions": index.num_partitions, "num_divisions": divisions, "num_codes": index.num_codes,
        "partition_ids": in_order(partition_ids), "partition_centroids_id": write("vector_set", vectors(index.centroids), "/partitions", False),
        "codebook_ids": [write("vector_set", vectors(b), "/codebooks", False) for b in index.books], "attributes_log_ids": in_order(log_ids), "attribute_names": names,
    }
    return write("database", header, "", True)


def find_header(spark: SparkSession, folder: str) -> str:
    fs, path = _filesystem(spark, folder)
    if not fs.exists(path):
        raise StorageError(f"no folder {folder}")
    found = [f.getPath().getName() for f in fs.listStatus(path) if f.isFile()]
    found = [f.removesuffix(SUFFIX) for f in found if f.endswith(SUFFIX) and not f.startswith(".")]
    if len(found) != 1:
        raise InvalidData(f"{folder} holds {len(found)} headers; name one")
    return found[0]


def _vector_set(spark: SparkSession, path: str, name: str, shape: tuple[int, int]) -> np.ndarray:
    found = messages.parse("vector_set", read_bytes(spark, path, verify=name))
    if found["vector_size"] != shape[1] or len(found["data"]) != shape[0] * shape[1]:
        raise InvalidData(f"{path} does not have the header's shape")
    return found["data"].astype(float).reshape(shape)


def _checked_header(spark: SparkSession, folder: str, name: str) -> dict:
    head = messages.parse("database", inflate(read_bytes(spark, f"{folder}/{name}{SUFFIX}", verify=name)))
    for key in ("vector_size", "num_partitions", "num_divisions", "num_codes"):
        if not head[key]:
            raise InvalidData(f"the header's {key} is zero")
    if head["vector_size"] % head["num_divisions"]:
        raise InvalidData("vector_size is not a multiple of num_divisions")
    for key, n in (("partition_ids", "num_partitions"), ("codebook_ids", "num_divisions"), ("attributes_log_ids", "num_partitions")):
        if len(head[key]) != head[n]:
            raise InvalidData(f"the header names {len(head[key])} {key}, not {head[n]}")
    return head


def _partition(head: dict, content: bytes, name: str) -> tuple[list[str], np.ndarray]:
    """Ids and codes of a partition's message, checked against the header."""
    divisions = head["num_divisions"]
    found = messages.parse("partition", inflate(content))
    encoded = found["encoded_vectors"] or {"vector_size": 0, "data": np.zeros(0, np.uint64)}
    ids = [text_of(u) for u in found["vector_ids"]]
    if found["vector_size"] != head["vector_size"] or found["num_divisions"] != divisions or (ids and encoded["vector_size"] != divisions) or len(encoded["data"]) != len(ids) * divisions:
        raise InvalidData(f"partition {name} does not have the header's shape")
    if len(encoded["data"]) and int(encoded["data"].max()) >= head["num_codes"]:
        raise InvalidData(f"partition {name} holds a code beyond the codebooks")
    return ids, encoded["data"].astype(np.int32).reshape(-1, divisions)


def _entries(head: dict, content: bytes, name: str, place: int) -> Iterator[tuple[str, str, str | int]]:
    """(vector_id, name, value) of a partition's log, in the order written."""
    names = head["attribute_names"]
    found = messages.parse("attributes_log", inflate(content))
    if found["partition_id"] != head["partition_ids"][place]:
        raise InvalidData(f"attribute log {name} belongs to another partition")
    for entry in found["entries"]:
        value = entry["value"]
        if value is None or (value["string_value"] is None and value["uint64_value"] is None):
            raise InvalidData("an attribute without a value")
        if entry["name_index"] >= len(names):
            raise InvalidData("an attribute name is not in the header")
        yield text_of(entry["vector_id"]), names[entry["name_index"]], value["uint64_value"] if value["string_value"] is None else value["string_value"]


class MessageIndex(StoredIndex):
    """An index on message files: each is verified, and parsed, when it is first asked for."""

    def __init__(self, spark: SparkSession, folder: str, head: dict, resident: int = RESIDENT_BYTES) -> None:
        super().__init__(spark, folder, head, None, resident)
        self._lengths = None

    def _name(self, what: str, place: int) -> str:
        return self.head["partition_ids" if what == VECTORS else "attributes_log_ids"][place]

    def _path(self, what: str, place: int) -> str:
        return f"{self.folder}/{what}/{self._name(what, place)}{SUFFIX}"

    def _content(self, what: str, place: int) -> bytes:
        return read_bytes(self._spark, self._path(what, place), verify=self._name(what, place))

    def sizes(self) -> dict[int, int]:
        """The number of vectors of each partition, which only the partitions tell: one pass over all, once."""
        if self._sizes is None:
            self._sizes = {r["partition_index"]: r["n"] for r in self.rows().groupBy("partition_index").agg(F.count("*").alias("n")).collect()}
        return self._sizes

    def _length(self, what: str, place: int) -> int:
        with reading(self._path(what, place)):
            fs, path = _filesystem(self._spark, self._path(what, place))
            return fs.getFileStatus(path).getLen()

    def _fits(self, partition: int) -> bool:
        """By the length of its file, whatever is in it: unpacked, a partition is at most so many times as long."""
        return UNPACKED * self._length(VECTORS, partition) <= self._resident.most

    def _log_bytes(self, partition: int) -> int:
        return UNPACKED * self._length(ATTRIBUTES, partition)

    def _read_centroids(self) -> np.ndarray:
        name = self.head["partition_centroids_id"]
        return _vector_set(self._spark, f"{self.folder}/partitions/{name}{SUFFIX}", name, (self.num_partitions, self.vector_size))

    def _read_codebook(self, division: int) -> np.ndarray:
        name = self.head["codebook_ids"][division]
        return _vector_set(self._spark, f"{self.folder}/codebooks/{name}{SUFFIX}", name, (self.num_codes, self.subvector_size))

    def _read(self, partitions: list[int]) -> dict[int, pa.Table]:
        out = {}
        for p in partitions:
            ids, codes = _partition(self.head, self._content(VECTORS, p), self._name(VECTORS, p))
            out[p] = pa.table({"vector_index": pa.array(np.arange(len(ids), dtype=np.int32)), "vector_id": pa.array(ids, pa.string()), "codes": as_column(codes)})
        return out

    def _read_log(self, partition: int) -> dict[str, dict] | None:
        if self._log_bytes(partition) > self._resident.most:
            return None
        out: dict[str, dict] = {}
        for vector_id, name, value in _entries(self.head, self._content(ATTRIBUTES, partition), self._name(ATTRIBUTES, partition), partition):
            out.setdefault(vector_id, {})[name] = value
        return out

    def _files(self, what: str, partitions: Sequence[int] | None) -> DataFrame:
        """(place, name, content) of the files of these partitions alone; their digests are compared first, in the JVM.

        Spark's sources pass over names that begin with an underscore, as one
        digest in 64 does: such a file comes by way of the driver.
        """
        places = list(range(self.num_partitions) if partitions is None else partitions)
        hidden = [p for p in places if self._name(what, p).startswith("_")]
        places = [p for p in places if p not in set(hidden)]
        found = self._shown(what, places) if places else None
        for p in hidden:
            if self._length(what, p) > BROADCAST_BYTES:
                raise StorageError(f"{self._path(what, p)} is too large to be read by the driver")
            content = bytearray(self._content(what, p))
            self._checked[what].add(p)
            own = self._spark.createDataFrame([(p, self._name(what, p), content)], "place int, name string, content binary")
            found = own if found is None else found.unionByName(own)
        return self._spark.createDataFrame([], "place int, name string, content binary") if found is None else found

    def _shown(self, what: str, places: list[int]) -> DataFrame:
        with reading(self.folder):
            files = self._spark.read.format("binaryFile").load(sorted({self._path(what, p) for p in places}))
        files = files.select(F.regexp_extract("path", rf"([^/]+){SUFFIX.replace('.', '[.]')}$", 1).alias("name"), "content")
        with self._guard:
            if left := self._unchecked(what, places):
                wanted = {self._name(what, p) for p in left}
                with reading(self.folder):
                    bad = files.filter((content_id(F.col("content")) != F.col("name")) & F.col("name").isin(sorted(wanted))).select("name").first()
                if bad is not None:
                    raise VerificationFailure(f"{bad['name']} does not have the digest that names it")
                self._checked[what].update(left)
        order = self._spark.createDataFrame([(p, self._name(what, p)) for p in places], "place int, name string")
        return files.join(order, "name").select("place", "name", "content")

    def _rows(self, partitions: Sequence[int] | None) -> DataFrame:
        head = self.head

        def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for place, name, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    ids, codes = _partition(head, content, name)
                    n = len(ids)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, place, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(ids, pa.string()), as_column(codes)], ["partition_index", "vector_index", "vector_id", "codes"])

        return self._files(VECTORS, partitions).mapInArrow(parse, ENCODED)

    def _base_log(self, partitions: Sequence[int] | None) -> DataFrame:
        head = self.head
        value_type = pa.struct([("string_value", pa.string()), ("uint64_value", pa.decimal128(20, 0))])

        def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for place, name, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    rows = list(_entries(head, content, name, place))
                    n = len(rows)
                    values = [{"string_value": v if isinstance(v, str) else None, "uint64_value": None if isinstance(v, str) else Decimal(v)} for _, _, v in rows]
                    own = [pa.array(np.full(n, place, np.int32)), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array(values, value_type), pa.array(np.arange(n) - n)]
                    yield pa.RecordBatch.from_arrays(own, ["partition_index", "vector_id", "name", "value", "seq"])

        return self._files(ATTRIBUTES, partitions).mapInArrow(parse, A.LOG)


def load(spark: SparkSession, folder: str, name: str | None = None, resident: int = RESIDENT_BYTES) -> MessageIndex:
    """An index on message files; only the header is read now."""
    return MessageIndex(spark, folder, _checked_header(spark, folder, name or find_header(spark, folder)), resident)


__all__ = ["MessageIndex", "export", "find_header", "inflate", "load", "text_of", "uuid_of"]

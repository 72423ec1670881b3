"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import os
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quiverine.sources.tables import keep as checkpoint
from quiverine.sources.tables import work_path

#: Rows and bytes that a step in Python takes at a time, of an Arrow batch of any size; one longer row is a step of its own.
STEP_ROWS, STEP_BYTES = 1024, 8 << 20
#: Bits of a sieve: 32 for each of four million rows.
SIEVE_BITS = 1 << 27


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of ``sf_dir`` by Spark's own reader (any Hadoop path)."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a bounded number of rows and bytes; without empty ones."""
    for batch in batches:
        at, most = 0, STEP_ROWS
        while at < batch.num_rows:
            part = batch.slice(at, most)
            if part.num_rows > 1 and part.nbytes > STEP_BYTES:
                most = max(1, part.num_rows // 2)
                continue
            yield part
            at += part.num_rows
            most = min(STEP_ROWS, 2 * most)


@contextmanager
def without_gc() -> Iterator[None]:
    """While memos grow that hold no cycles, and that walking would cost more than they do."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``fn`` over bounded steps of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with without_gc():
            for batch in steps(batches):
                yield fn(batch)

    return df.mapInArrow(run, schema)


def positional(df: DataFrame) -> tuple[DataFrame, list[str], int, int]:
    """``df`` with columns c0, c1, ... whatever they are called, those names, and the places of doc_id and text."""
    names = [f"c{k}" for k in range(len(df.columns))]
    return df.toDF(*names), names, df.columns.index("doc_id"), df.columns.index("text")


def fresh(names: list[str], wanted: str) -> str:
    """``wanted``, or a longer name that no column has."""
    taken = {n.lower() for n in names}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def id_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus)


def sieved(rows: DataFrame, few: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` without most of those that ``few`` has no row for by ``on``, and with all others: what a join moves then follows ``few``.

    By a bit for each hash of ``few``, some 32 times as many as it has rows, at
    most ``SIEVE_BITS``: a broadcast of 16 MB at most. More rows than that make
    it let more through.
    """
    bits = min(SIEVE_BITS, max(1 << 15, 1 << (32 * few.count()).bit_length()))
    slot = F.pmod(F.xxhash64(*on), F.lit(bits)) + 1
    full = few.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("__bucket"))
    full = full.agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("__bits"))
    place = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring("__bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    passed = rows.withColumn("__bucket", F.bitmap_bucket_number(slot)).join(F.broadcast(full), "__bucket")
    return passed.filter(F.floor(byte / F.pow(F.lit(2), place % 8)) % 2 == 1).select(*rows.columns)


def blas_threads() -> None:
    """One BLAS thread for a task: the cluster gives a task one core."""
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS"):
        os.environ.setdefault(name, "1")


__all__ = ["arrow_map", "blas_threads", "checkpoint", "fresh", "id_bucket", "positional", "read", "sieved", "steps", "without_gc", "work_path"]

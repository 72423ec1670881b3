"""Figures: the published configuration of 100,000 vectors of 1,536 elements, and kernels over ten million elements."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiverine.functions import vector as V
from quiverine.operators.index import IndexBuilder
from quiverine.operators.query import knn_exact
from quiverine.operators.vectors import as_column, numbered
from quiverine.sources import storage
from quiverine.sources.tables import keep, work_path


def random_vectors(spark: SparkSession, n: int, width: int, seed: int = 0, unit: bool = False, tasks: int = 16) -> DataFrame:
    """(vec_id, embedding) of random numbers from 0 to 1, or of random directions at length 1; equal for equal seeds."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k in batch.column(0).to_pylist():
                rng = np.random.default_rng((seed, k))
                row = rng.normal(size=width) if unit else rng.random(width, np.float32)
                rows.append(row / np.linalg.norm(row) if unit else row)
            yield pa.RecordBatch.from_arrays([batch.column(0), as_column(np.array(rows, np.float32).reshape(-1, width))], ["vec_id", "embedding"])

    return spark.range(0, n, 1, tasks).mapInArrow(make, "vec_id long, embedding array<float>")


def _seconds(work: Callable) -> tuple[float, object]:
    began = time.perf_counter()
    found = work()
    return round(time.perf_counter() - began, 6), found


def published(spark: SparkSession, vectors: int = 100_000, size: int = 1536, divisions: int = 12, partitions: int = 100, codes: int = 256, k: int = 10, nprobe: int = 5, queries: int = 20) -> dict[str, float]:
    """Seconds of each step of the published benchmark, and recall against brute force.

    One vector is asked twice, of an index just loaded and of one that holds
    what it has read; then its neighbours' attribute is fetched, each time.
    """
    out: dict[str, float] = {}
    out["prepare"], df = _seconds(lambda: keep(random_vectors(spark, vectors, size)))
    out["build"], index = _seconds(lambda: IndexBuilder(partitions, divisions, codes).build(df))
    values = df.select(F.col("vec_id").alias("vec_ord"), F.struct(F.lit(None).cast("string").alias("string_value"), F.col("vec_id").cast("decimal(20,0)").alias("uint64_value")).alias("value"))
    out["set_attributes"], index = _seconds(lambda: index.set_attributes(values, "datum_id"))
    folder = work_path(spark, "published")
    out["save"], name = _seconds(lambda: storage.save(index, folder))
    vector = np.random.default_rng(99).random(size, np.float32).astype(float)
    storage.load(spark, folder, name).search(vector, k, nprobe)  # what Python and the JVM compile once
    out["load_header"], stored = _seconds(lambda: storage.load(spark, folder, name))
    for round_ in ("cold", "warm"):
        out[f"query_{round_}"], found = _seconds(lambda: stored.search(vector, k, nprobe))
        out[f"attributes_{round_}"], _ = _seconds(lambda: [stored.get_attribute(r.vector_id, "datum_id", r.partition_index) for r in found])
    stored = storage.load(spark, folder, name)
    for round_ in ("cold", "warm"):
        out[f"async_query_{round_}"], found = _seconds(lambda: stored.query_async(vector, k, nprobe).result())
        out[f"async_attributes_{round_}"], _ = _seconds(lambda: [f.result() for f in [stored.get_attribute_async(r.vector_id, "datum_id", r.partition_index) for r in found]])
    out["query_by_cluster"], _ = _seconds(lambda: stored.query(vector, k, nprobe).collect())
    asked = np.random.default_rng(7).random((queries, size), np.float32).astype(float)
    out["batch_by_cluster_each"] = round(_seconds(lambda: stored.query_batch(asked, k, nprobe).collect())[0] / queries, 6)
    known = numbered(df, "vec_id", "embedding")
    ordinals = {r["vector_id"]: r["vec_ord"] for r in index.rows().select("vector_id", "vec_ord").toLocalIterator()}
    for name, probes in (("recall", nprobe), ("recall_all_probed", partitions)):
        hits = 0
        for q in asked[:3]:
            true = {r["vec_ord"] for r in knn_exact(known, q, k).collect()}
            hits += len(true & {ordinals[r.vector_id] for r in stored.search(q, k, probes)})
        out[name] = round(hits / (3 * k), 3)
    return out


def kernels(spark: SparkSession, elements: int = 10_000_000, width: int = 1000, rounds: int = 5) -> dict[str, list[float]]:
    """Seconds of each kernel over a table of ``elements`` in vectors of ``width``, round by round; ``locality`` is the sum over vectors of 100."""
    pairs = random_vectors(spark, elements // width, width).withColumnRenamed("embedding", "x")
    pairs = keep(pairs.join(random_vectors(spark, elements // width, width, seed=1).withColumnRenamed("embedding", "y"), "vec_id"))
    x, y = F.col("x"), F.col("y")
    measured = {
        "dot": F.sum(V.dot(x, y)), "norm2": F.sum(V.norm2(x)), "min": F.min(V.smallest(x)), "scale": F.sum(F.get(V.scale(x, 0.5), F.lit(0))),
        "subtract": F.sum(F.get(V.subtract(x, y), F.lit(0))), "sum": F.sum(V.total(x)), "locality": F.sum(F.aggregate(V.chunk(x, 100), F.lit(0.0), lambda s, v: s + V.total(v))),
    }
    return {name: [_seconds(lambda value=value: pairs.agg(value).collect())[0] for _ in range(rounds)] for name, value in measured.items()}

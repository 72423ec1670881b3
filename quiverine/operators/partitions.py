"""Coarse partitions: nearest centres, residuals, places within a partition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quiverine.functions import vector as V
from quiverine.operators.kmeans import nearest_block
from quiverine.operators.sampling import in_order
from quiverine.operators.vectors import as_column, matrix


def residuals(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_ord, partition_index, residue): what is left of each vector after its nearest centre is taken off."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = matrix(batch.column(1))
                nearest, _ = nearest_block(rows, centroids)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nearest.astype(np.int32)), as_column(rows - centroids[nearest])], ["vec_ord", "partition_index", "residue"])

    return vectors.select("vec_ord", "vec").mapInArrow(run, "vec_ord long, partition_index int, residue array<double>")


def residuals_sql(vectors: DataFrame, assigned: DataFrame, centroids: DataFrame) -> DataFrame:
    """The same in built-in expressions, from (vec_ord, cluster) and (cluster, centroid)."""
    joined = vectors.join(assigned.select("vec_ord", "cluster"), "vec_ord").join(F.broadcast(centroids), "cluster")  # k centres
    return joined.select("vec_ord", F.col("cluster").alias("partition_index"), V.subtract("vec", "centroid").alias("residue"))


def reconstruct(residues: DataFrame, centroids: DataFrame) -> DataFrame:
    """(vec_ord, vec): each residual with its centre added again."""
    by_partition = centroids.withColumnRenamed("cluster", "partition_index")
    return residues.join(F.broadcast(by_partition), "partition_index").select("vec_ord", V.add("residue", "centroid").alias("vec"))


def sizes(assigned: DataFrame, partitions: int | None = None) -> DataFrame:
    """(partition_index, num_vectors)."""
    return assigned.groupBy("partition_index").agg(F.count("*").alias("num_vectors"))


def number_within(df: DataFrame, group: str, order: str, to: str = "vector_index") -> DataFrame:
    """``df`` with each row's place, from 0, within its group in the order of ``order``.

    Rows are written once in the order of group and ``order``, dealt evenly, so
    a large group spans several stretches and no task holds it. A stretch adds
    what its group holds in the ones before, one row per group and stretch.
    """
    parts = in_order(df, group, order)
    counts = parts.groupBy(group, "__task").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = Window.partitionBy(group).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(group, "__task", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__add"))
    # Stretches and groups are both in order: the rows of ``offsets`` are at most the stretches and the groups together.
    placed = parts.join(offsets, [group, "__task"])
    return placed.withColumn(to, (F.col("__at") + F.col("__add")).cast("int")).select(*df.columns, to)

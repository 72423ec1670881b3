"""Product quantization: one codebook per division of the residuals, and codes.

Codebooks are shared by all partitions. Each division is trained by a task of
its own on the same bounded sample of residuals; a table that is no larger
takes part as a whole.
"""

from __future__ import annotations

import pickle
import threading
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiverine.errors import InvalidArgs
from quiverine.functions import vector as V
from quiverine.operators.events import Event, Listener, tell
from quiverine.operators.kmeans import EPSILON_FLOAT, ROUNDS, fit_block, nearest_block
from quiverine.operators.vectors import as_column, matrix
from quiverine.sources.tables import keep


def train_codebooks(
    residues: DataFrame, divisions: int, codes: int, vector_size: int, seed: int = 0, sample: int = 65_536, rounds: int = ROUNDS, epsilon: float = EPSILON_FLOAT, listener: Listener | None = None
) -> np.ndarray:
    """The codebooks (divisions, codes, width) of (vec_ord, residue).

    Each division is a job of its own, several at a time; ``listener`` hears
    when each begins and ends, and the events of its k-means in between, as the
    task that ran it has noted them.
    """
    if vector_size % divisions:
        raise InvalidArgs(f"vectors of {vector_size} elements can't be cut into {divisions} equal divisions")
    n = residues.count()
    if n < codes:
        raise InvalidArgs(f"{n} vectors can't make {codes} clusters")
    width = vector_size // divisions
    if n > sample:
        drawn = F.pmod(F.xxhash64("vec_ord"), F.lit(1 << 40)) / F.lit(float(1 << 40))
        residues = residues.filter(drawn < sample / n)
    residues = keep(residues.select("vec_ord", "residue"))
    telling = threading.Lock()

    def one(d: int) -> np.ndarray:
        def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [b for b in batches if b.num_rows]  # at most ``sample`` rows
            if held:
                table = pa.Table.from_batches(held)
                rows = matrix(table.column(1).combine_chunks())[np.argsort(table.column(0).to_numpy(), kind="stable")]
                noted: list[Event] = []
                book = fit_block(rows, codes, seed + 1 + d, rounds=rounds, epsilon=epsilon, listener=noted.append)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(codes, dtype=np.int32)), as_column(book.centroids), pa.array([pickle.dumps(noted)] + [None] * (codes - 1))], ["code", "code_vector", "noted"])

        with telling:
            tell(listener, "start_quantize", division=d)
        slices = residues.select("vec_ord", F.slice("residue", d * width + 1, width)).repartition(1)
        found = slices.mapInArrow(train, "code int, code_vector array<double>, noted binary").collect()
        with telling:
            for event in pickle.loads(next(bytes(r["noted"]) for r in found if r["noted"] is not None)):
                tell(listener, "cluster", event=event, division=d)
            tell(listener, "finish_quantize", division=d)
        return np.array([r["code_vector"] for r in sorted(found, key=lambda r: r["code"])])

    with ThreadPoolExecutor(min(divisions, 16)) as pool:
        return np.stack(list(pool.map(one, range(divisions))))


def codes_of(rows: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The nearest code of every division of every row."""
    divisions, _, width = books.shape
    return np.stack([nearest_block(rows[:, d * width : (d + 1) * width], books[d])[0] for d in range(divisions)], axis=1).astype(np.int32)


def encode(vectors: DataFrame, centroids: np.ndarray, books: np.ndarray) -> DataFrame:
    """(vec_ord, partition_index, codes): partition, residual and codes of each vector in one pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = matrix(batch.column(1))
                nearest, _ = nearest_block(rows, centroids)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nearest.astype(np.int32)), as_column(codes_of(rows - centroids[nearest], books))], ["vec_ord", "partition_index", "codes"])

    return vectors.select("vec_ord", "vec").mapInArrow(run, "vec_ord long, partition_index int, codes array<int>")


def encode_sql(residues: DataFrame, codebooks: DataFrame, divisions: int, vector_size: int) -> DataFrame:
    """(vec_ord, partition_index, codes) from (vec_ord, partition_index, residue) and (division, code, code_vector), in built-in expressions.

    The codebooks, divisions times codes rows by definition, become one array
    beside each vector.
    """
    books = codebooks.groupBy("division").agg(F.array_sort(F.collect_list(F.struct("code", "code_vector"))).alias("book"))
    books = books.agg(F.array_sort(F.collect_list(F.struct("division", "book"))).alias("books"))
    slices = V.divide("residue", divisions, vector_size)
    nearest = lambda sub, book: F.array_min(F.transform(book, lambda c: F.struct(V.squared_distance(sub, c["code_vector"]).alias("d"), c["code"].alias("c"))))["c"]
    codes = F.transform(F.sequence(F.lit(0), F.lit(divisions - 1)), lambda d: nearest(F.get(F.col("slices"), d), F.get(F.col("books"), d)["book"]))
    joined = residues.withColumn("slices", slices).join(F.broadcast(books))
    return joined.select("vec_ord", "partition_index", codes.alias("codes"))

"""Tables of vectors: an ordinal, and an array of numbers of one width."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quiverine.errors import InvalidArgs
from quiverine.functions import vector as V


def from_block(spark: SparkSession, data, vector_size: int) -> DataFrame:
    """(vec_ord, vec) from a flat block of numbers or a two-dimensional array."""
    block = np.asarray(data, dtype=float)
    if vector_size < 1 or block.size % vector_size:
        raise InvalidArgs(f"{block.size} elements do not make vectors of {vector_size}")
    rows = block.reshape(-1, vector_size)
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rows)], "vec_ord long, vec array<double>")


def numbered(df: DataFrame, order: str, vec: str) -> DataFrame:
    """(vec_ord, vec) of a table whose column ``order`` is a whole number per row."""
    return df.select(F.col(order).cast("long").alias("vec_ord"), F.col(vec).cast("array<double>").alias("vec"))


@dataclass(frozen=True)
class Extent:
    """What one pass tells of a table of vectors."""

    n: int
    width: int
    first: int | None = None
    last: int | None = None

    @property
    def contiguous(self) -> bool:
        """Whether the ordinals are all whole numbers from the first to the last."""
        return self.n > 0 and self.first is not None and self.last - self.first + 1 == self.n


def extent(df: DataFrame) -> Extent:
    """The number of vectors (vec_ord, vec), their width and ordinals, in one pass.

    Raises as ``check`` does, and if an ordinal is null or stands twice.
    """
    found = df.agg(*_shape("vec"), F.min("vec_ord"), F.max("vec_ord"), F.count("vec_ord"), F.count_distinct("vec_ord")).first()
    n, width = _checked(*found[:4])
    first, last, named, distinct = found[4:]
    if named != n:
        raise InvalidArgs(f"{n - named} vectors have no ordinal")
    if distinct != n:
        raise InvalidArgs(f"{n} vectors have {distinct} different ordinals")
    return Extent(n, width, first, last)


def check(df: DataFrame, vec: str = "vec") -> tuple[int, int]:
    """The number of vectors and their width, in one pass.

    Raises if widths differ, or an element is null or not finite.
    """
    return _checked(*df.agg(*_shape(vec)).first())


def _shape(vec: str) -> list[Column]:
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return [F.count("*"), F.min(F.size(vec)), F.max(F.size(vec)), F.count(F.when(F.col(vec).isNull() | bad, 1))]


def _checked(n: int, least: int | None, most: int | None, wrong: int) -> tuple[int, int]:
    if not n:
        return 0, 0
    if wrong:
        raise InvalidArgs(f"{wrong} vectors are null or hold null, NaN or infinite elements")
    if least != most or not least:
        raise InvalidArgs(f"vectors have {least} to {most} elements; one positive width is asked for")
    return n, most


def divided(df: DataFrame, divisions: int, vector_size: int) -> DataFrame:
    """(vec_ord, division, sub): each vector's slices, a row each."""
    cut = V.divide("vec", divisions, vector_size)
    return df.select("vec_ord", F.posexplode(cut).alias("division", "sub"))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of one width as a two-dimensional array."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    return flat.reshape(n, -1) if n else np.zeros((0, 0))


def as_column(rows: np.ndarray) -> pa.Array:
    """A two-dimensional array as a list column."""
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * width, width, dtype=np.int32) if width else np.zeros(n + 1, np.int32)), pa.array(np.ascontiguousarray(rows).ravel()))

"""Tables between stages: written to the shared folder that the session names, so a lost executor's work need not be done again."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiverine.errors import InvalidContext

_local: dict[str, str] = {}
_registered: set[str] = set()


def work_folder(spark: SparkSession) -> str:
    """The shared folder of the session (``spark.checkpoint.dir``).

    Only a local session that names none gets a folder of its own; on a
    cluster, where executors share no local folder, that raises.
    """
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if sc.master != "local" and not sc.master.startswith("local["):
        raise InvalidContext("spark.checkpoint.dir names no shared folder for tables between stages")
    if sc.applicationId not in _local:
        _local[sc.applicationId] = tempfile.mkdtemp(prefix="work-")
    return _local[sc.applicationId]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table, or a folder of them."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _remove_at_exit(spark: SparkSession, folder: str) -> None:
    try:
        remove(spark, folder)
    except Exception:  # noqa: BLE001  the session may have ended first
        return


def work_path(spark: SparkSession, kind: str = "table") -> str:
    """A new path in the shared folder; what stands there is deleted when the application ends."""
    folder = f"{work_folder(spark)}/tables-{spark.sparkContext.applicationId}"
    if folder not in _registered:
        _registered.add(folder)
        atexit.register(_remove_at_exit, spark, folder)
    return f"{folder}/{kind}-{uuid.uuid4().hex}"


def keep(df: DataFrame, by: Sequence[str] = (), path: str | None = None) -> DataFrame:
    """``df`` written as Parquet, in folders by the columns ``by``, and read again: computed once, its lineage cut."""
    spark = df.sparkSession
    path = path or work_path(spark)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*(F.col(f"`{c}`") for c in df.columns))

"""Attributes: named values, texts or whole numbers up to 2^64 - 1, of vectors.

Values live in a long table (partition_index, vector_id, name, value, seq); of
several values under a name the one with the largest ``seq`` holds.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiverine.errors import InvalidArgs, InvalidData

VALUE = "struct<string_value:string,uint64_value:decimal(20,0)>"
LOG = f"partition_index int, vector_id string, name string, value {VALUE}, seq long"
MOST = (1 << 64) - 1


def value_of(value: str | int) -> tuple[str | None, Decimal | None]:
    """A driver-side value as a row of the value type."""
    if isinstance(value, bool) or not isinstance(value, (str, int)):
        raise InvalidArgs("an attribute is a text or a whole number")
    if isinstance(value, str):
        return value, None
    if not 0 <= value <= MOST:
        raise InvalidArgs("an attribute's number is from 0 to 2^64 - 1")
    return None, Decimal(value)


def python_value(row) -> str | int | None:
    """The other way round; raises if the value is neither."""
    if row is None:
        return None
    if row["string_value"] is None and row["uint64_value"] is None:
        raise InvalidData("an attribute without a value")
    return row["string_value"] if row["string_value"] is not None else int(row["uint64_value"])


def text_value(column: Column) -> Column:
    return F.struct(column.cast("string").alias("string_value"), F.lit(None).cast("decimal(20,0)").alias("uint64_value"))


def number_value(column: Column) -> Column:
    return F.struct(F.lit(None).cast("string").alias("string_value"), column.cast("decimal(20,0)").alias("uint64_value"))


def last_wins(log: DataFrame) -> DataFrame:
    """(partition_index, vector_id, name, value) of a log: the last value of each name."""
    latest = log.groupBy("partition_index", "vector_id", "name").agg(F.max_by("value", "seq").alias("value"))
    return latest.select("partition_index", "vector_id", "name", "value")


def names(log: DataFrame) -> DataFrame:
    """(name_index, name): the distinct names in order, numbered from 0."""
    ordered = log.agg(F.array_sort(F.collect_set("name")).alias("names"))
    return ordered.select(F.posexplode("names").alias("name_index", "name"))


def encode_names(log: DataFrame, dictionary: DataFrame) -> DataFrame:
    return log.join(dictionary, "name").drop("name")


def decode_names(log: DataFrame, dictionary: DataFrame) -> DataFrame:
    return log.join(dictionary, "name_index").drop("name_index")


def with_attribute(rows: DataFrame, attributes: DataFrame, name: str, to: str = "value") -> DataFrame:
    """``rows`` (with partition_index and vector_id) with the value of one name, null where there is none."""
    own = attributes.filter(F.col("name") == name).select("partition_index", "vector_id", F.col("value").alias(to))
    return rows.join(own, ["partition_index", "vector_id"], "left")


def all_attributes(encoded: DataFrame, attributes: DataFrame) -> DataFrame:
    """(vector_id, attributes): every vector's map of names to values, empty where it has none."""
    maps = attributes.groupBy("vector_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("attributes"))
    empty = F.create_map().cast(f"map<string,{VALUE}>")
    return encoded.select("vector_id").join(maps, "vector_id", "left").select("vector_id", F.coalesce("attributes", empty).alias("attributes"))


def check_log(log: DataFrame, encoded: DataFrame) -> None:
    """Raise if a value is missing, or stands under a partition that doesn't hold its vector; one job."""
    empty = F.col("vector_id").isNull() | F.col("name").isNull() | F.col("value").isNull() | (F.col("value.string_value").isNull() & F.col("value.uint64_value").isNull())
    held = encoded.select("partition_index", "vector_id", F.lit(True).alias("held"))
    found = log.join(held, ["partition_index", "vector_id"], "left")
    empties, strays = found.agg(F.count(F.when(empty, 1)), F.count(F.when(F.col("held").isNull(), 1))).first()
    if empties:
        raise InvalidData("an attribute log holds an entry without id, name or value")
    if strays:
        raise InvalidData("an attribute log names a vector that its partition doesn't hold")

"""Helpers that the training-data operators share: tables and columns; storage and counted broadcasts are the library's."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import BROADCAST_ROWS, materialise, new_path, release, remove, ship, small_or_not

__all__ = ["BROADCAST_ROWS", "WHITE", "fresh", "kept", "materialise", "new_path", "partitions", "release", "remove", "ship", "small_or_not", "table", "texts_of", "without_rows"]

#: The ASCII white space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """The name, or the name with marks behind it that no column of df has (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without_rows(docs: DataFrame, dropped: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs, every column kept, without the rows at the places (uid) of a stored table."""
    at = fresh(docs, "__uid")
    gone = small_or_not(dropped.select(F.col("uid").alias(at)), rows)
    return docs.withColumn(at, F.monotonically_increasing_id()).join(gone, at, "left_anti").drop(at)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_kept: dict[str, dict] = {}


def kept(owner: str) -> dict:
    """What this worker process keeps for an operator between its tasks. Workers serve one operator after another: when
    one begins, what the one before kept is let go and free memory is given back to the system."""
    if owner not in _kept:
        _kept.clear()
        pa.default_memory_pool().release_unused()
        if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:  # glibc only
            trim(0)
        _kept[owner] = {}
    return _kept[owner]


def texts_of(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column's values; null counts as empty."""
    column = column.cast(pa.binary()) if not pa.types.is_large_string(column.type) else column.cast(pa.large_binary())
    return [x or b"" for x in column.to_pylist()]

"""The driver's tables as page rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.values import to_money
from ..storage import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as the pages of a file, in time."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("filename"), place.alias("page"), "event_id", "event_type", "value", "props")


def turn_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's turns as the pages of a file."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("filename"), F.col("turn").alias("page"), "role", "text")


def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source's documents as the pages of a file."""
    return table(spark, sf_dir, "documents").select(F.col("source").alias("filename"), F.col("doc_id").alias("page"), "lang", "text")


def order_lines(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Lines as pages: the order is the file; place in it by all of a line's columns, as line numbers repeat."""
    lines = table(spark, sf_dir, "lineitem")
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"))
    return lines.select(F.col("l_orderkey").alias("filename"), place.alias("page"), "l_partkey", "l_quantity", to_money(F.col("l_extendedprice")).alias("amount"), "l_extendedprice", *more)

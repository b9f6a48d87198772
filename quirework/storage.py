"""Tables written in the folder that the cluster shares, numbering of rows that never meet in one task, and broadcasts of
counted tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side of a join is broadcast only if its counted rows (of a few narrow columns) stay within this.
BROADCAST_ROWS = 1_000_000

_PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors of any cluster, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_quirework_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="quirework-"), f"quirework-{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(p for p in _PACKAGE.rglob("*") if p.suffix in (".py", ".txt")):
            z.write(f, f.relative_to(_PACKAGE.parent))
    sc.addPyFile(path)  # the driver serves it; executors do not see the driver's folder
    sc._quirework_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint folder. Only where
    executors are threads of the driver may both be unset; a temporary folder serves then, as in tests."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = getattr(sc, "_quirework_tables", None)
        if found is None:
            found = sc._quirework_tables = f"file://{tempfile.mkdtemp(prefix='quirework-')}"
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one; it goes when the application ends."""
    path = f"{shared_dir(spark)}/quirework/{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def remove(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again: lineage ends there, and every executor can
    read it after others are lost. The table goes when the application ends, or by release."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quirework_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete the table of a materialised df that nothing reads any more."""
    remove(df.sparkSession, df._quirework_path)


def small_or_not(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint on a materialised df of at most `rows` rows; beyond that df itself, for a shuffled join."""
    return F.broadcast(df) if df.count() <= rows else df


def number_rows(df: DataFrame, name: str, order: list[str | Column], by: list[str] = ()) -> DataFrame:
    """df with `name`: the place of a row from 1 in the order, within equal `by`.

    Rows are dealt by ranges of the order, numbered in their range, and moved on by the counts of the ranges before; no
    task sees more than one range, whatever the number of rows of a `by`.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialise(df.repartitionByRange(parts, *by, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    ahead = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*by, "__part").agg(F.count("*").alias("__n"))
    before = counts.select(*by, "__part", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy(*by, "__part").orderBy(*order))
    # null-safe, as rows with a null `by` are numbered too
    same = [F.col(f"__l.{c}").eqNullSafe(F.col(f"__r.{c}")) for c in [*by, "__part"]]
    joined = dealt.withColumn("__own", own).alias("__l").join(before.alias("__r"), same)
    return joined.select(*[F.col(f"__l.`{c}`") for c in df.columns], (F.col("__own") + F.col("__before")).alias(name))

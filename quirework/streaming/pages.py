"""The fixed-format plan on a stream of extracted pages.

Pages of a file may come in any batch and order. Every micro-batch adds its pages to a store that is partitioned by a
hash of the file name, reads back the partitions of the files it touched, and writes these files' records anew under the
batch's number; a batch that runs twice overwrites its own output, so results are exactly once. A file's records are
those of its latest batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.precise import assemble
from ..specs import FieldSpec

#: Partitions of the store; a batch reads those of its files only.
BUCKETS = 256


def _batch(specs: list[FieldSpec], store: str, out: str, buckets: int) -> Callable[[DataFrame, int], None]:
    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        pages = batch.withColumn("bucket", F.pmod(F.xxhash64("filename"), F.lit(buckets)).cast("int"))
        pages.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/batch={number}")
        mine = spark.read.option("basePath", store).schema(pages.schema.add("batch", "long")).parquet(f"{store}/batch={number}")
        touched = mine.select("filename", "bucket").distinct()
        here = [r.bucket for r in touched.select("bucket").distinct().collect()]  # at most `buckets` numbers
        if not here:
            return
        known = spark.read.option("basePath", store).schema(pages.schema.add("batch", "long")).parquet(store)
        # a later batch's pages are no part of this one, also when it runs again
        known = known.filter(F.col("bucket").isin(here) & (F.col("batch") <= number)).join(touched.select("filename"), "filename", "left_semi")
        assemble(known.drop("bucket", "batch"), specs).records.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return run


def stream_records(pages: DataFrame, specs: list[FieldSpec], store: str, out: str, checkpoint: str, buckets: int = BUCKETS, **trigger) -> StreamingQuery:
    """Start the stream of pages (filename, page, continues, the fields); trigger as for writeStream.trigger."""
    writer = pages.writeStream.foreachBatch(_batch(specs, store, out, buckets)).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def latest_records(spark: SparkSession, out: str) -> DataFrame:
    """The records of every file's latest batch."""
    rows = spark.read.option("basePath", out).parquet(f"{out}/batch=*")
    last = rows.groupBy("filename").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["filename", "batch"], "left_semi").drop("batch")

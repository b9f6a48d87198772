"""Binary files to page rows through an optional decoder.

Edge cases: a file above the size limit, and one that the decoder refuses, is one row with its error and takes no part in
anything else; equal names are told apart in the order of their paths; a file without pages has no rows; an empty folder
gives no rows. Names are numbered apart from the contents and joined by path: by broadcast up to a million files, beyond
that contents move once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evidence import choose_text, classify, safe_name, sniff, unique_names
from ..storage import materialise, number_rows, ship, small_or_not

_PAGES = "filename string, ordinal long, page int, plain string, layout string, image_share double, ink double, error string"
#: A decoder turns (format, bytes) into pages as (plain text, layout text, image share, ink share or None).
Decoder = Callable[[str, bytes], list[tuple[str, str, float, float | None]]]
MAX_BYTES = 200 * 1024 * 1024
#: Characters of an error that are kept.
ERROR_CHARS = 180


def files(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES, order: DataFrame | None = None) -> DataFrame:
    """filename (unique), ordinal (the upload order from 1), format, content and error of the files at path. A file above
    max_bytes has no content but an error. order: path and ordinal of every file, where paths do not give the order."""
    ship(spark)
    found = spark.read.format("binaryFile").load(path)
    names = found.select("path", safe_name(F.col("path")).alias("name"))  # the content is not read for this
    placed = names.join(order.select("path", "ordinal"), "path") if order is not None else number_rows(names, "ordinal", ["path"])
    named = small_or_not(materialise(unique_names(placed, "name", "ordinal").select("path", "ordinal", F.col("unique_name").alias("filename")), "file-names"))
    # the filters on length reach the source, so contents of files that are too large are not read
    small = found.filter(F.col("length") <= max_bytes).select("path", "content", F.lit(None).cast("string").alias("error"))
    why = F.concat(F.lit("the file has "), F.col("length").cast("string"), F.lit(f" bytes, more than {max_bytes}"))
    large = found.filter(F.col("length") > max_bytes).select("path", F.lit(None).cast("binary").alias("content"), why.alias("error"))
    rows = small.unionByName(large)
    return rows.join(named, "path").select("filename", "ordinal", sniff(F.col("content"), F.col("path")).alias("format"), "content", "error")


def plain_text(kind: str, data: bytes) -> list[tuple[str, str, float, float | None]]:
    """The decoder that needs no library: form feeds part pages of UTF-8 text; other bytes are refused."""
    return [(p, p, 0.0, None) for p in data.decode("utf-8").split("\f")]


def scan(found: DataFrame, decode: Decoder = plain_text) -> DataFrame:
    """Page rows of files, classified: filename, ordinal, page, text (layout unless it lost much), image_share, ink, kind,
    hint, error. A file that cannot be read is one row with its error and without a kind."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                bad = lambda why: [(r.filename, r.ordinal, 1, None, None, None, None, why[:ERROR_CHARS])]  # noqa: B023, E731
                try:
                    rows = bad(r.error) if r.error else [(r.filename, r.ordinal, i, *p, None) for i, p in enumerate(decode(r.format, bytes(r.content)), 1)]
                except Exception as e:
                    rows = bad(str(e) or type(e).__name__)
                yield pd.DataFrame(rows, columns=["filename", "ordinal", "page", "plain", "layout", "image_share", "ink", "error"])

    pages = found.mapInPandas(run, _PAGES).withColumn("text", choose_text(F.col("plain"), F.col("layout"))).drop("plain", "layout")
    good = F.col("error").isNull()
    done = classify(pages, "text", "image_share", "ink")
    return done.withColumn("kind", F.when(good, F.col("kind"))).withColumn("hint", F.when(good, F.col("hint")))


def quarantined(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages of files that were read, file names with their errors), both in the upload order when sorted by ordinal."""
    bad = pages.filter(F.col("error").isNotNull())
    return pages.filter(F.col("error").isNull()).drop("error"), bad.select("ordinal", "filename", "error")

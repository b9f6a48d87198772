"""Page evidence: which pages are native text, scanned or blank, and file and page names.

Edge cases: a null text is an empty one; a page without text is blank only if its ink is known to be little; a null or
empty path has the default name; repeated names are told apart in their order, also where one name is very frequent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import texts
from ..functions.values import strip
from ..storage import number_rows

# Thresholds of the page kinds; names of files.
MAX_CID, MAX_BAD, IMAGE_SHARE, IMAGE_CHARS, MIN_CHARS, INK = 3, 0.2, 0.7, 200, 30, 0.0004
LAYOUT_SHARE = 0.5
IMAGE_FORMATS = ("png", "jpg", "jpeg", "bmp", "tif", "tiff", "webp", "gif")
NAME_CHARS, DEFAULT_NAME = 120, "file.pdf"
#: First bytes of image files, in hexadecimal digits; for names that do not tell the format.
IMAGE_MAGIC = ("89504E47", "FFD8FF", "424D", "49492A00", "4D4D002A", "47494638", "52494646")


def choose_text(plain: Column, layout: Column) -> Column:
    """Layout text unless it lost more than half of the plain text."""
    a, b = F.coalesce(layout, F.lit("")), F.coalesce(plain, F.lit(""))
    return F.when(F.length(a) >= LAYOUT_SHARE * F.length(b), a).otherwise(b)


def page_kind(text: Column, image_share: Column, ink: Column) -> Column:
    """native, scanned or blank, by the first rule that holds; a page without text whose ink is unknown is scanned."""
    t = F.coalesce(text, F.lit(""))
    n = F.length(strip(t))
    return (
        F.when(n == 0, F.when(F.coalesce(ink, F.lit(1.0)) < INK, "blank").otherwise("scanned"))
        .when((texts.cid_count(t) > MAX_CID) | (texts.quality_bad(t) > MAX_BAD), "scanned")
        .when((image_share > IMAGE_SHARE) & (n < IMAGE_CHARS), "scanned")
        .when(n < MIN_CHARS, "scanned")
        .otherwise("native")
    )


def classify(pages: DataFrame, text: str = "text", image_share: str | None = None, ink: str | None = None) -> DataFrame:
    """pages with kind, and hint: the weak text of a scanned page, which is dropped where it is unreadable."""
    t = F.coalesce(F.col(text), F.lit(""))
    share = F.coalesce(F.col(image_share), F.lit(0.0)) if image_share else F.lit(0.0)
    dark = F.col(ink) if ink else F.lit(None).cast("double")
    readable = (texts.cid_count(t) <= MAX_CID) & (texts.quality_bad(t) <= MAX_BAD)
    return pages.withColumn("kind", page_kind(t, share, dark)).withColumn("hint", F.when((F.col("kind") == "scanned") & readable, t).otherwise(""))


def sniff(content: Column, path: Column) -> Column:
    """pdf or image of a file's bytes and name: the mark of a PDF first, then the extension, then the marks of images;
    pdf for the rest."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    start = F.hex(F.substring(content, 1, 4))
    magic = F.lit(False)
    for mark in IMAGE_MAGIC:
        magic = magic | start.startswith(mark)
    return F.when(F.coalesce(start, F.lit("")) == b"%PDF".hex().upper(), "pdf").when(ext.isin(*IMAGE_FORMATS) | F.coalesce(magic, F.lit(False)), "image").otherwise("pdf")


def safe_name(path: Column, default: str = DEFAULT_NAME) -> Column:
    """The last part of a path with backslashes and control characters as _, without outer white space, at most 120
    characters."""
    base = F.regexp_extract(F.coalesce(path, F.lit("")), r"([^/]*)$", 1)
    name = strip(F.regexp_replace(base, r"[\\\x00-\x1f\x7f]", "_"))
    return F.substring(F.when(name == "", default).otherwise(name), 1, NAME_CHARS)


def unique_names(files: DataFrame, name: str = "name", order: str = "ordinal") -> DataFrame:
    """files with unique_name: repeated names get (1), (2), ... before the extension, in the order. Numbered by ranges:
    a name that a third of all files has is no single task's."""
    place = (F.col("__n") - 1).cast("string")
    stem, ext = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)
    numbered = number_rows(files, "__n", [order], [name])
    return numbered.withColumn("unique_name", F.when(F.col("__n") == 1, F.col(name)).otherwise(F.concat(stem, F.lit("("), place, F.lit(")"), ext))).drop("__n")


def kind_counts(pages: DataFrame, by: list[str]) -> DataFrame:
    """Pages of each kind, per `by`."""
    return pages.groupBy(*by).agg(F.count("*").alias("total"), *[F.count_if(F.col("kind") == k).alias(k) for k in ("native", "scanned", "blank")])

"""Splitting of mixed files: layout labels for unknown pages, format variants of a type, type groups and their files.

Titles and layouts are computed once and stored; first appearances are found per (type, signature) and only these are
numbered, by ranges of the order.

Edge cases: a null or empty type is an unknown one; blank pages are left as they are; a page without any text or layout
has no label; ties do not occur, as a page stands once in its file (repeated pages get equal results).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import texts
from ..functions.values import canonical, strip
from ..storage import materialise, number_rows, small_or_not
from .grouping import roots

# What marks a variant of a type, before its number; types that say nothing; reasons that are added; the
# characters of a reason.
VARIANT = "·版式"
UNKNOWN_KEYS = ("", "未知文档", "未知")
FALLBACK_REASON, SPLIT_REASON, REASON_CHARS = "；按重复版式兜底分组", "；检测到页面用途或版式不同，拆为独立子类型", 120


def safe_type(c: Column) -> Column:
    name = F.substring(strip(F.coalesce(c, F.lit(""))), 1, 60)
    return F.when(name == "", texts.UNKNOWN).otherwise(name)


def _two(c: Column) -> Column:
    return F.when(c < 10, F.concat(F.lit("0"), c.cast("string"))).otherwise(c.cast("string"))


def layouts(pages: DataFrame, text: str = "text", layout: str | None = None, file: str = "filename", page: str = "page") -> DataFrame:
    """file, page, title, title_key and layout of every page, stored. layout: a column with the page's own figures."""
    title = texts.title_candidate(F.col(text))
    shape = texts.layout_signature(F.col(text), F.col(layout) if layout else None)
    return materialise(pages.select(file, page, title.alias("title"), shape.alias("layout")).withColumn("title_key", canonical(F.col("title"))), "layouts")


def layout_fallback(pages: DataFrame, file: str = "filename", page: str = "page", doc_type: str = "document_type", text: str = "text", layout: str | None = None) -> DataFrame:
    """pages with document_type replaced where it is unknown: pages of one signature share the title of the first of
    them, or a number in the order of first appearance over all files; fallback tells which. Where pages have a kind,
    blank ones are left out; where they have reason and confidence, these tell of the fallback."""
    unknown = canonical(F.col(doc_type)).isin(*UNKNOWN_KEYS)
    if "kind" in pages.columns:
        unknown = unknown & F.coalesce(F.col("kind") != "blank", F.lit(True))
    shapes = layouts(pages.filter(unknown), text, layout, file, page)
    signature = F.when(F.length("title_key") >= 4, texts.format_signature(F.col("title_key"), F.col("layout"))).otherwise(F.col("layout"))
    seen = shapes.withColumn("__s", signature).filter(F.col("__s") != "")
    place = F.struct(F.col(file), F.col(page))
    label = F.when(F.col("title_key") != "", F.substring("title", 1, 48)).otherwise("")
    first = materialise(seen.groupBy("__s").agg(F.min(place).alias("__at"), F.min_by(label, place).alias("__label")), "signatures")
    numbered = number_rows(first, "__n", ["__at"]).select("__s", F.when(F.col("__label") != "", F.col("__label")).otherwise(F.concat(F.lit(texts.UNKNOWN + VARIANT), _two(F.col("__n")))).alias("__label"))
    labels = seen.select(file, page, "__s").distinct().join(numbered, "__s").select(F.col(file).alias("__f"), F.col(page).alias("__p"), "__label")
    joined = pages.join(labels, (F.col(file) == F.col("__f")) & (F.col(page) == F.col("__p")), "left").drop("__f", "__p")
    found = F.col("__label").isNotNull()
    out = joined.withColumn("fallback", found).withColumn(doc_type, F.coalesce("__label", F.col(doc_type)))
    if "reason" in pages.columns:
        out = out.withColumn("reason", F.when(found, F.substring(F.concat(F.coalesce("reason", F.lit("")), F.lit(FALLBACK_REASON)), 1, REASON_CHARS)).otherwise(F.col("reason")))
    if "confidence" in pages.columns:
        out = out.withColumn("confidence", F.when(found, "low").otherwise(F.col("confidence")))
    return out.drop("__label")


def inherited(pages: DataFrame, signature: str, type_key: str, continues: Column, anchor: Column, file: str = "filename", page: str = "page") -> DataFrame:
    """pages with the signature of the page that their chain of anchors ends at: a continuation takes that of its anchor
    before it, if the anchor is a page of the same file and type."""
    marked = materialise(pages.withColumn("__a", F.when(F.coalesce(continues, F.lit(False)), anchor.cast("long"))), "continued")
    known = marked.select(F.col(file).alias("__kf"), F.col(page).cast("long").alias("__kp"), F.col(type_key).alias("__kt")).distinct()
    tied = (F.col(file) == F.col("__kf")) & (F.col("__a") == F.col("__kp")) & (F.col(type_key) == F.col("__kt")) & (F.col("__a") < F.col(page))
    parents = marked.join(known, tied, "left").withColumn("__parent", F.coalesce("__kp", F.col(page).cast("long"))).drop("__kf", "__kp", "__kt", "__a")
    resolved = roots(parents.withColumn(page, F.col(page).cast("long")), "__parent", file, page).drop("__parent")
    heads = resolved.select(F.col(file).alias("__hf"), F.col(page).alias("__hp"), F.col(signature).alias("__hs")).distinct()
    joined = resolved.join(heads, (F.col(file) == F.col("__hf")) & (F.col("root") == F.col("__hp")), "left")
    return joined.withColumn(signature, F.coalesce("__hs", F.col(signature))).drop("__hf", "__hp", "__hs", "root").withColumn(page, F.col(page).cast(pages.schema[page].dataType))


def format_variants(pages: DataFrame, signature: Column, file: str = "filename", page: str = "page", doc_type: str = "document_type", continues: Column | None = None, anchor: Column | None = None) -> DataFrame:
    """pages with variant: the number of their signature within their type by first appearance over all files, and
    split_type: type and variant where the type has more than one; unknown types are left as they are. With continues and
    anchor, a continuation has the signature of its anchor's chain."""
    name = safe_type(F.col(doc_type))
    rows = pages.withColumn("__base", canonical(name)).withColumn("__s", signature)
    rows = materialise(rows, "format-pages") if continues is None else inherited(rows, "__s", "__base", continues, anchor, file, page)
    known = rows.filter(~F.col("__base").isin(*UNKNOWN_KEYS))
    first = materialise(known.groupBy("__base", "__s").agg(F.min(F.struct(F.col(file), F.col(page))).alias("__at")), "formats")
    many = first.groupBy("__base").agg((F.count("*") > 1).alias("__many"))
    numbered = small_or_not(materialise(number_rows(first, "variant", ["__at"], ["__base"]).join(many, "__base").drop("__at"), "variants"))
    joined = rows.join(numbered, ["__base", "__s"], "left")
    return joined.withColumn("split_type", F.when(F.col("__many"), F.concat(name, F.lit(VARIANT), _two(F.col("variant")))).otherwise(name)).drop("__base", "__s", "__many")


def type_groups(pages: DataFrame, doc_type: str, anchor: str, file: str = "filename", page: str = "page", fallback: str | None = None) -> DataFrame:
    """One row a type: its name at its first page, pages, logical documents, fallback pages, source files and first
    page. Documents and files are counted exactly, in two steps, so no task gathers a type's pages."""
    rows = pages.withColumn("type_key", canonical(safe_type(F.col(doc_type)))).withColumn("__name", safe_type(F.col(doc_type))).withColumn("__f", F.col(fallback) if fallback else F.lit(False))
    at = F.struct(F.col(file), F.col(page))
    docs = rows.groupBy("type_key", file, anchor).agg(F.count("*").alias("n"), F.count_if("__f").alias("f"), F.min(at).alias("at"), F.min_by("__name", at).alias("name"))
    files = docs.groupBy("type_key", file).agg(F.sum("n").alias("n"), F.sum("f").alias("f"), F.count("*").alias("d"), F.min("at").alias("at"), F.min_by("name", "at").alias("name"))
    return files.groupBy("type_key").agg(F.min_by("name", "at").alias("document_type"), F.sum("n").alias("page_count"), F.sum("d").alias("logical_documents"), F.sum("f").alias("fallback_pages"), F.count("*").alias("source_files"), F.min("at").alias("first"))


def segments(pages: DataFrame, doc_type: str, anchor: str, number: str, file: str = "filename", page: str = "page") -> DataFrame:
    """One row a logical document of a type: its pages and its first number that is known."""
    rows = pages.withColumn("type_key", canonical(safe_type(F.col(doc_type))))
    known = F.when(F.coalesce(F.col(number).cast("string"), F.lit("")) != "", F.col(page))
    return rows.groupBy("type_key", file, anchor).agg(F.array_sort(F.collect_list(page)).alias("pages"), F.min_by(number, known).alias("document_no"))


def save_types(pages: DataFrame, path: str, job: str, doc_type: str = "document_type", anchor: str = "anchor", number: str = "document_no", file: str = "filename", page: str = "page", fallback: str | None = None) -> DataFrame:
    """Write pages in folders by type, in page order, and beside them the manifest and the documents' segments; return the
    manifest: what type_groups tells of each type, and the name of its file. A type's pages are dealt by file, so a type
    of any size is written by many tasks; readers of one type read its folder only."""
    rows = materialise(pages.withColumn("type_key", canonical(safe_type(F.col(doc_type)))), "typed-pages")
    rows.repartition("type_key", file).sortWithinPartitions("type_key", file, page).write.partitionBy("type_key").parquet(f"{path}/pages")
    groups = type_groups(rows, doc_type, anchor, file, page, fallback)
    name = F.concat(texts.slug(F.col("document_type")), F.lit("_"), texts.slug(F.lit(job)))
    groups.select("type_key", "document_type", name.alias("file_name"), "page_count", "logical_documents", "fallback_pages", "source_files").write.parquet(f"{path}/manifest")
    segments(rows, doc_type, anchor, number, file, page).write.parquet(f"{path}/segments")
    return pages.sparkSession.read.parquet(f"{path}/manifest")

"""Field specifications out of labelled lines of sample pages, per document type."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import canonical, norm_date, strip, to_num
from ..specs import FieldSpec, normalize_fields

#: Fields of a schema, and characters of a label.
MOST, LABEL_CHARS = 40, 30


def labelled_values(pages: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """keep, label, value of every line "label: value"."""
    line = F.explode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line")
    found = pages.select(*keep, line)
    pattern = rf"(?U)^\s*([^:：\n]{{1,{LABEL_CHARS}}}?)\s*[:：]\s*(\S.*)$"
    rows = found.filter(F.col("line").rlike(pattern))
    return rows.select(*keep, strip(F.regexp_extract("line", pattern, 1)).alias("label"), strip(F.regexp_extract("line", pattern, 2)).alias("value"))


def inventories(pages: DataFrame, doc_type: str, page_key: list[str], text: str = "text", most: int = MOST) -> DataFrame:
    """type_key, label, pages, coverage (share of the type's pages), numbers, dates: the labels of each type on most
    pages, equal labels by their canonical form under their smallest spelling. Counts are aggregated before they meet."""
    typed = pages.withColumn("type_key", canonical(F.col(doc_type)))
    values = labelled_values(typed, ["type_key", *page_key], text).withColumn("label_key", canonical(F.col("label"))).filter(F.col("label_key") != "")
    is_date = norm_date(F.col("value")).rlike(r"^\d{4}-\d{2}-\d{2}$")
    per_page = values.groupBy("type_key", "label_key", *page_key).agg(F.min("label").alias("label"), F.bool_and(to_num(F.col("value")).isNotNull()).alias("number"), F.bool_and(is_date).alias("date"))
    labels = per_page.groupBy("type_key", "label_key").agg(F.min("label").alias("label"), F.count("*").alias("pages"), F.count_if("number").alias("numbers"), F.count_if("date").alias("dates"))
    totals = typed.groupBy("type_key").agg(F.count("*").alias("type_pages"))
    place = F.row_number().over(Window.partitionBy("type_key").orderBy(F.desc("pages"), "label_key"))
    ranked = labels.withColumn("place", place).filter(F.col("place") <= most).join(totals, "type_key")
    return ranked.select("type_key", "place", "label", "pages", (F.col("pages") / F.col("type_pages")).alias("coverage"), "numbers", "dates")


def schemas(found: DataFrame) -> dict[str, list[FieldSpec]]:
    """Specifications by type out of inventories (at most MOST rows a type on the driver)."""
    out: dict[str, list[dict]] = {}
    for r in found.orderBy("type_key", "place").collect():
        kind = "number" if r.numbers == r.pages else "date" if r.dates == r.pages else "text"
        out.setdefault(r.type_key, []).append({"key": r.label.lower(), "label": r.label, "type": kind, "coverage": r.coverage, "source_variants": [r.label]})
    return {t: normalize_fields(fields) for t, fields in out.items()}

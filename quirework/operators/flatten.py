"""Flat outputs of records: detail rows with declared and undeclared columns, field values, statuses, and cell texts.

Edge cases: a record without rows has no detail rows; a null cell stays null; an undeclared column is null where a row
does not have it; a null confidence, check or repair counts as not given.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labels of evidence codes, of statuses and of ticked fields; characters that sheet names may not hold, what
# stands for them, the name of a sheet without one, its length, and the characters of an error in a status.
EVIDENCE_LABELS = {"native_text": "电子解析", "vision": "AI视觉", "ocr_text": "OCR文本", "failed": "失败"}
NO_EVIDENCE, TICKED, UNTICKED, UNCHECKED = "—", "✓", "✗", "—"
FINE, BROKEN, REPAIRED = "✅", "❌ ", "已复核"
FAILED, TO_REVIEW, DONE = "失败", "待复核", "完成"
SHEET_FORBIDDEN, SHEET_STAND_IN, SHEET_DEFAULT, SHEET_CHARS, STATUS_CHARS = "[]:*?/\\", "_", "明细", 31, 60
#: Undeclared columns that details are widened by, at most.
MAX_EXTRA = 1_000


def details(records: DataFrame, keep: list[str], table_fields: list[str]) -> DataFrame:
    """Every row of every table field: keep, table, row_no from 1, and the rows' columns, missing ones null."""
    parts = []
    for t in table_fields:
        rows = records.select(*keep, F.posexplode(t).alias("__at", "__row"))
        parts.append(rows.select(*keep, F.lit(t).alias("table"), (F.col("__at") + 1).alias("row_no"), "__row.*"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def extra_columns(found: DataFrame, order: list[str], extra: str = "_extra", most: int = MAX_EXTRA) -> list[str]:
    """Names of the undeclared columns of details, in the order in which rows first have them: distinct names only are
    counted and sent to the driver. More than `most` are refused."""
    names = found.select(*order, F.posexplode(F.map_keys(extra)).alias("at", "name")).groupBy("name").agg(F.min(F.struct(*order, "at")).alias("first"))
    out = [r["name"] for r in names.orderBy("first", "name").limit(most + 1).collect()]
    if len(out) > most:
        raise ValueError(f"details have more than {most} undeclared columns; keep them in {extra}")
    return out


def widened(found: DataFrame, names: list[str], extra: str = "_extra") -> DataFrame:
    """Details with the undeclared columns behind the declared ones, in place of the map."""
    return found.withColumns({n: F.try_element_at(extra, F.lit(n)) for n in names}).drop(extra) if names else found.drop(extra)


def field_values(records: DataFrame, keep: list[str], fields: list[str]) -> DataFrame:
    """One row for every record and field: keep, field, value as text, status found or not_found."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    rows = records.select(*keep, F.inline(pairs))
    return rows.withColumn("status", F.when(F.coalesce(F.col("value"), F.lit("")) == "", "not_found").otherwise("found"))


def _given(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def row_status(error: Column, failed: Column, repaired: Column) -> Column:
    """error before a failed check before repaired before ok."""
    return F.when(_given(error), "error").when(_given(failed), "failed").when(_given(repaired), "repaired").otherwise("ok")


def review_status(error: Column, ambiguous: Column, boundary: Column) -> Column:
    """Failed, to be reviewed (an ambiguous field, or a boundary of low confidence), or done."""
    return F.when(_given(error), FAILED).when(_given(ambiguous) | _given(boundary == "low"), TO_REVIEW).otherwise(DONE)


def ambiguous(field_meta: Column) -> Column:
    """Whether a field of a record is ambiguous."""
    return _given(F.exists(F.map_values(field_meta), lambda m: m["status"] == "ambiguous"))


def evidence_label(codes: Column) -> Column:
    """Labels of evidence codes joined by +; a dash for none."""
    known = F.create_map(*[F.lit(x) for kv in EVIDENCE_LABELS.items() for x in kv])
    parts = F.filter(F.split(F.coalesce(codes, F.lit("")), r"\+"), lambda c: c != "")
    named = F.transform(parts, lambda c: F.coalesce(F.try_element_at(known, c), c))
    return F.when(F.size(parts) == 0, NO_EVIDENCE).otherwise(F.array_join(named, "+"))


def cell(c: Column, kind: str) -> Column:
    """A field as a sheet shows it: numbers as they are, ticks as signs, tables as their number of rows, else text."""
    if kind == "number":
        return c
    if kind == "checkbox":
        return F.when(c, TICKED).when(~c, UNTICKED).otherwise("")
    if kind == "table":
        return F.concat(F.coalesce(F.array_size(c), F.lit(0)).cast("string"), F.lit("行"))
    return F.coalesce(c.cast("string"), F.lit(""))


def check_sign(match: Column) -> Column:
    return F.when(match, TICKED).when(~match, UNTICKED).otherwise(UNCHECKED)


def sheet_title(raw: str, used: set[str]) -> str:
    """A name of at most 31 characters with _ for forbidden ones, told apart from used ones by a number; it is used then."""
    base = raw.translate(dict.fromkeys(map(ord, SHEET_FORBIDDEN), SHEET_STAND_IN))[:SHEET_CHARS] or SHEET_DEFAULT
    names = [base, *(base[: SHEET_CHARS - len(f"-{n}")] + f"-{n}" for n in range(2, len(used) + 3))]
    used.add(title := next(n for n in names if n not in used))
    return title

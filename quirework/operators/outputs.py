"""What users take home: sheets of a job as DataFrames by title, result rows, and their writing.

A sheet is a projection of records; only sheet titles and column labels are made on the driver. Columns have technical
names, and `labels` tells what a shown sheet calls them.

Edge cases: an empty job has its sheets without rows; a schema without fields has a summary of the documents alone; sheets
of equal titles are told apart by a number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import texts
from ..specs import FieldSpec, scalars, tables
from . import flatten
from .common import Records
from .mixed import Mixed

# Titles of sheets, and labels of their columns.
SUMMARY, DETAILS, CHECKS = "提取汇总", "明细数据", "算术校验"
COMMON_SUMMARY, FIELD_EVIDENCE, BOUNDARIES, ISSUES, INDEX = "统一汇总", "字段证据", "文档边界", "异常记录", "文档索引"
TABLE_TITLE, TYPE_TITLE, DETAIL_TITLE = "明细-{}", "汇总-{}", "{}-{}"
LABELS = {
    "document_id": "文档ID", "filename": "文件名", "pages": "页码", "document_type": "文档类型", "document_no": "文档编号", "schema_type": "字段方案", "confidence": "置信度", "evidence": "证据来源", "repaired": "复核", "status": "状态",
    "segmentation_confidence": "边界置信度", "segmentation_reason": "判断依据", "table": "表格", "row_no": "行号", "field": "字段", "message": "说明", "value": "提取值", "source_label": "原字段名", "said": "证据原文", "source_page": "证据页",
    "sum_from_table": "表格求和", "declared": "声明值", "diff": "差额", "match": "结果",
}


def labels(sheet: DataFrame, specs: list[FieldSpec]) -> list[str]:
    """What a shown sheet calls its columns."""
    known = dict(LABELS)
    for s in specs:
        known |= {s.key: s.label, f"{s.key}_rows": f"{s.label}(行数)", f"check_{s.key}": f"校验:{s.label}"}
        known |= {c.key: f"{c.label}({c.key})" for c in s.columns if c.key not in known}
    return [known.get(c, c) for c in sheet.columns]


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)


# --- fixed-format jobs ---------------------------------------------------------------------------------------------


def summary(records: DataFrame, specs: list[FieldSpec], validations: DataFrame | None = None, key: tuple[str, ...] = ("filename", "group_no"), repaired: bool | None = None) -> DataFrame:
    """One row a record: file, pages, scalars, row counts of tables, confidence, evidence, repaired (with repaired=None only
    if any record is), the signs of the checks, status, and row_status, the colour of the row."""
    has, checked = set(records.columns), [s for s in scalars(specs) if s.sum_check]
    if repaired is None:
        repaired = "repaired" in has and not records.filter("repaired").isEmpty()
    rows = records
    if validations is not None and checked:
        marks = validations.groupBy(*key).agg(*[F.max(F.when(F.col("field") == s.key, F.col("match"))).alias(f"__check_{s.key}") for s in checked])
        rows = records.join(marks, list(key), "left")
    check = lambda s: F.col(f"__check_{s.key}") if validations is not None else F.lit(None).cast("boolean")
    error = F.col("error").isNotNull() if "error" in has else F.lit(False)
    failed = F.lit(False)
    for s in checked:
        failed = failed | F.coalesce(~check(s), F.lit(False))
    again = F.coalesce(F.col("repaired"), F.lit(False)) if "repaired" in has else F.lit(False)
    status = F.when(error, F.concat(F.lit(flatten.BROKEN), F.substring(F.col("error"), 1, flatten.STATUS_CHARS))).otherwise(flatten.FINE) if "error" in has else F.lit(flatten.FINE)
    return rows.select(
        "filename", "pages",
        *[flatten.cell(F.col(s.key), s.type).alias(s.key) for s in scalars(specs)],
        *[F.coalesce(F.array_size(s.key), F.lit(0)).alias(f"{s.key}_rows") for s in tables(specs)],
        _text("confidence") if "confidence" in has else F.lit("").alias("confidence"),
        flatten.evidence_label(F.col("evidence") if "evidence" in has else F.lit("")).alias("evidence"),
        *([F.when(again, flatten.REPAIRED).otherwise("").alias("repaired")] if repaired else []),
        *[flatten.check_sign(check(s)).alias(f"check_{s.key}") for s in checked],
        status.alias("status"), flatten.row_status(error, failed, again).alias("row_status"),
    )


def checks(validations: DataFrame) -> DataFrame:
    return validations.select("filename", "pages", "field", "label", "sum_from_table", "declared", "diff", flatten.check_sign(F.col("match")).alias("match"))


def fixed_sheets(records: DataFrame, specs: list[FieldSpec], validations: DataFrame | None, key: tuple[str, ...] = ("filename", "group_no")) -> dict[str, DataFrame]:
    """Summary, detail rows and checks of a fixed-format job; the last two only where there may be some."""
    out = {SUMMARY: summary(records, specs, validations, key)}
    if tables(specs):
        found = flatten.details(records, ["filename", "pages"], [s.key for s in tables(specs)])
        out[DETAILS] = flatten.widened(found, flatten.extra_columns(found, ["filename", "pages", "table", "row_no"])) if "_extra" in found.columns else found
    if validations is not None:
        out[CHECKS] = checks(validations)
    return out


# --- cross-layout and mixed jobs -----------------------------------------------------------------------------------

_DOCUMENT = ("document_id", "filename", "pages", "document_type", "document_no")


def _fields(specs: list[FieldSpec], have: list[str]) -> list[Column]:
    return [flatten.cell(F.col(s.key) if s.key in have else F.lit(None).cast("string"), s.type if s.key in have else "text").alias(s.key) for s in specs]


def document_summary(records: DataFrame, specs: list[FieldSpec], boundary: bool = True) -> DataFrame:
    """One row a document with its fields and status; without boundary a weak boundary alone is no matter of review."""
    edge = F.col("segmentation_confidence") if boundary else F.lit("")
    status = flatten.review_status(F.col("error").isNotNull(), flatten.ambiguous(F.col("field_meta")), edge)
    return records.select(*map(_text, _DOCUMENT), *_fields(specs, records.columns), _text("confidence"), _text("segmentation_confidence"), status.alias("status"))


def field_evidence(records: DataFrame, specs: list[FieldSpec]) -> DataFrame:
    """One row for every document and field: its value, and where it comes from."""
    def one(s: FieldSpec) -> Column:
        meta = F.try_element_at("field_meta", F.lit(s.key))
        value = flatten.cell(F.col(s.key), s.type).cast("string") if s.key in records.columns else F.lit("")
        told = [F.coalesce(meta[a].cast("string"), F.lit("")).alias(b) for a, b in (("source_label", "source_label"), ("evidence", "said"), ("confidence", "confidence"), ("status", "status"), ("source_page", "source_page"))]
        return F.struct(F.lit(s.label).alias("field"), F.coalesce(value, F.lit("")).alias("value"), *told)

    return records.select(*map(_text, _DOCUMENT[:4]), F.inline(F.array(*map(one, specs))))


def table_sheet(records: DataFrame, spec: FieldSpec, number: bool = False) -> DataFrame:
    """The rows of one table field, its declared columns only."""
    kept = [*_DOCUMENT[:3], "document_no" if number else "document_type"]
    rows = records.select(*map(_text, kept), F.explode(spec.key).alias("__row"))
    have = {f.name for f in rows.schema["__row"].dataType.fields}
    return rows.select(*kept, *[(F.col("__row")[c.key] if c.key in have else F.lit("")).alias(c.key) for c in spec.columns])


def boundaries(records: DataFrame, kind: str = "document_type") -> DataFrame:
    return records.select(*map(_text, (*_DOCUMENT[:3], kind, "document_no", "segmentation_confidence", "segmentation_reason")))


def common_sheets(found: Records, specs: list[FieldSpec]) -> dict[str, DataFrame]:
    """Summary, evidence, a sheet for every table field, boundaries, and issues if there are any."""
    out = {COMMON_SUMMARY: document_summary(found.records, specs)}
    if specs:
        out[FIELD_EVIDENCE] = field_evidence(found.records, specs)
    used = {COMMON_SUMMARY, FIELD_EVIDENCE, BOUNDARIES, ISSUES}
    for s in (s for s in tables(specs) if s.key in found.records.columns):
        out[flatten.sheet_title(TABLE_TITLE.format(s.label), used)] = table_sheet(found.records, s)
    out[BOUNDARIES] = boundaries(found.records)
    if not found.issues.isEmpty():
        out[ISSUES] = found.issues
    return out


def mixed_sheets(found: Mixed, schemas: dict[str, list[FieldSpec]]) -> dict[str, DataFrame]:
    """Index of all documents, a summary and tables of every type, boundaries, and issues if there are any."""
    index = found.index()
    status = flatten.review_status(F.col("error").isNotNull(), F.col("ambiguous"), F.col("segmentation_confidence"))
    out = {INDEX: index.select(*map(_text, ("document_id", "filename", "pages", "schema_type", "document_no", "confidence", "segmentation_confidence")), status.alias("status"))}
    used = {INDEX, BOUNDARIES, ISSUES}
    for name, specs in schemas.items():
        records = found.by_type[name]
        out[flatten.sheet_title(TYPE_TITLE.format(name), used)] = document_summary(records, specs, boundary=False).drop("document_type")
        for s in (s for s in tables(specs) if s.key in records.columns):
            out[flatten.sheet_title(DETAIL_TITLE.format(name, s.label), used)] = table_sheet(records, s, number=True)
    out[BOUNDARIES] = boundaries(index, "schema_type")
    if not found.issues.isEmpty():
        out[ISSUES] = found.issues
    return out


# --- rows and files ------------------------------------------------------------------------------------------------


def result_rows(records: DataFrame, specs: list[FieldSpec], keep: list[str]) -> DataFrame:
    """keep, the scalars, and `_tables`: a struct of the table fields; null tables are empty. What starts with _source and
    the pages' inventories are left out."""
    have = set(records.columns)
    kept = [c for c in keep if c in have and not c.startswith("_source") and c != "_inventory"]
    held = [s for s in tables(specs) if s.key in have]
    packed = F.struct(*[F.coalesce(s.key, F.array().cast(records.schema[s.key].dataType)).alias(s.key) for s in held]) if held else F.create_map().cast("map<string,string>")
    return records.select(*kept, *[s.key for s in scalars(specs) if s.key in have], packed.alias("_tables"))


def json_lines(rows: DataFrame) -> DataFrame:
    """Result rows as JSON texts, nulls included."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def slug(name: str) -> str:
    """`texts.slug` of a title on the driver."""
    kept = "".join(c if c.isascii() and c.isalnum() or "一" <= c <= "鿿" or c in "._-" else " " for c in name)
    return "_".join(kept.split())[:80].strip("._") or texts.UNKNOWN


def write_sheets(sheets: dict[str, DataFrame], path: str, form: str = "parquet") -> dict[str, str]:
    """Write every sheet to a folder of its own under path, by many tasks; titles and their folders."""
    out, used = {}, set()
    for title, sheet in sheets.items():
        folder = flatten.sheet_title(slug(title), used)
        writer = sheet.write.format(form)
        (writer.option("header", True) if form == "csv" else writer).save(f"{path}/{folder}")
        out[title] = f"{path}/{folder}"
    return out

"""Cross-layout mode: pages of any layout to logical documents, and their fields to one value each with its evidence.

Pages have filename, page and, as far as known: kind, error, document_type, document_no, continues, anchor,
segment_confidence, segment_reason, evidence, confidence, the fields' columns (a table field is an array of rows) and
field_meta, a map from a field's key to {source_label, evidence, confidence, status}.

Edge cases: blank pages are left out, pages of unknown kind are not; a page with an error is a document of its own that
breaks nothing; a page with an anchor belongs to it, also where the anchor is no page of the file; a null or empty type is
an unknown one; a field without a value is null with the status not_found, a table without rows an empty list; repeated
(file, page) rows belong to one document and are ordered by value; no pages give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import clean, coerce, conf_name, conf_rank, one_of, strip
from ..specs import CONFIDENCES, FieldSpec, scalars, tables
from ..storage import materialise
from . import fold, grouping

# What issues say, and the joint of several reasons.
BOUNDARY_FIELD, BOUNDARY_LOW, CONFLICT, JOINT = "文档边界", "文档边界置信度较低", "多页候选值冲突：", "；"
STATUSES = ("found", "not_found", "not_applicable", "ambiguous")
#: Identity hints of a page, and the characters of their parts.
HINTS, HINT_CHARS = 8, {"label": 80, "value": 160, "role": 120}

META = "struct<source_label:string,evidence:string,confidence:string,status:string,source_page:string,row_count:int>"
_PAGE = {"error": "string", "document_type": "string", "document_no": "string", "continues": "boolean", "anchor": "long", "segment_confidence": "string", "segment_reason": "string", "evidence": "string", "confidence": "string", "field_meta": "map<string,struct<source_label:string,evidence:string,confidence:string,status:string>>"}


@dataclass
class Records:
    """records: one row a document, with field_meta; issues: document_id, field, message."""

    records: DataFrame
    issues: DataFrame


def identity_hints(raw: Column) -> Column:
    """Of an array of {label, value, role} those with a value, cut to their lengths, at most eight."""
    some = F.filter(raw, lambda h: clean(h["value"]).isNotNull())
    part = lambda h, k: F.substring(strip(F.coalesce(h[k], F.lit(""))), 1, HINT_CHARS[k]).alias(k)
    return F.slice(F.transform(some, lambda h: F.struct(*[part(h, k) for k in HINT_CHARS])), 1, HINTS)


def field_meta(meta: Column, has_value: Column) -> Column:
    """A field's evidence as given, with a known confidence and status; the status of none is whether there is a value."""
    status = F.when(meta["status"].isin(*STATUSES), meta["status"]).when(has_value, "found").otherwise("not_found")
    return F.struct(clean(meta["source_label"]).alias("source_label"), clean(meta["evidence"]).alias("evidence"), one_of(meta["confidence"], CONFIDENCES, "").alias("confidence"), status.alias("status"))


def coerced_rows(rows: Column, spec: FieldSpec) -> Column:
    """Rows given as maps with the declared columns in their types; rows without any value are left out."""
    made = F.transform(rows, lambda r: F.struct(*[coerce(F.try_element_at(r, F.lit(c.key)), c.type).alias(c.key) for c in spec.columns]))
    some = lambda r: reduce(Column.__or__, [r[c.key].isNotNull() & (r[c.key].cast("string") != "") for c in spec.columns])
    return F.filter(made, some)


def documents(pages: DataFrame, prefix: str = "doc_", only_anchors: bool = False) -> DataFrame:
    """pages with document_id, in the order of the files and their documents' first pages. Pages with an error are
    documents of their own; pages with an anchor belong to it; the others to the group of their type and number
    (`grouping.number_groups`), or with only_anchors to themselves. All columns that a document needs are there."""
    have = set(pages.columns)
    full = pages.withColumns({c: F.lit(None).cast(t) for c, t in _PAGE.items() if c not in have} | {"page": F.col("page").cast("long"), "anchor": F.col("anchor").cast("long") if "anchor" in have else F.lit(None).cast("long")})
    if "kind" in have:
        full = full.filter(F.coalesce(F.col("kind") != "blank", F.lit(True)))
    full = materialise(full, "document-pages")
    is_error = F.coalesce(F.col("error"), F.lit("")) != ""
    own = lambda df, how, key: df.withColumn("__how", F.lit(how)).withColumn("__key", key)
    good = full.filter(~is_error)
    parts = [own(full.filter(is_error), 0, F.col("page")), own(good.filter("anchor is not null"), 1, F.when(F.col("anchor") == 0, F.col("page")).otherwise(F.col("anchor")) if only_anchors else F.col("anchor"))]
    free = good.filter("anchor is null")
    if only_anchors:
        parts.append(own(free, 1, F.col("page")))
    else:
        narrow = free.select("filename", "page", "document_type", "document_no", "continues").distinct()
        found = grouping.number_groups(narrow, F.col("document_type"), F.col("document_no"), F.col("continues")).select("filename", "page", F.col("root").alias("__key")).distinct()
        parts.append(free.join(found, ["filename", "page"]).withColumn("__how", F.lit(2)))
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    heads = rows.groupBy("filename", "__how", "__key").agg(F.min("page").alias("__first"))
    ids = grouping.document_ids(heads, ["filename", "__first", "__how"], prefix)
    return rows.join(ids.drop("__first"), ["filename", "__how", "__key"]).drop("__how", "__key")


def _meta(label: Column, evidence: Column, confidence: Column, status: Column, page: Column, rows: Column) -> Column:
    parts = (label, evidence, confidence, status, page.cast("string"), rows.cast("int"))
    return F.struct(*[p.alias(n) for p, n in zip(parts, ("source_label", "evidence", "confidence", "status", "source_page", "row_count"), strict=True)]).cast(META)


def _scalar_values(rows: DataFrame, specs: list[FieldSpec]) -> DataFrame:
    """document_id, field, value, meta, conflict of every scalar field with a value."""
    known = dict(rows.dtypes)
    named = [F.struct(F.lit(s.key).alias("field"), F.lit(known[s.key] in ("double", "float")).alias("number"), F.col(s.key).cast("string").alias("value"), F.try_element_at("field_meta", F.lit(s.key)).alias("m")) for s in specs]
    cells = rows.select("document_id", "page", F.explode(F.array(*named)).alias("c")).select("document_id", "page", "c.field", "c.number", "c.value", F.col("c.m.source_label").alias("source_label"), F.col("c.m.evidence").alias("said"), F.col("c.m.confidence").alias("confidence"), F.col("c.m.status").alias("given"))
    best = fold.choose(cells, ["document_id", "field"], status="given", number=F.col("number"), keep=["source_label", "said", "given"])
    status = F.when(F.col("status") == "ambiguous", "ambiguous").otherwise(F.coalesce("given", F.lit("found")))
    meta = _meta(F.col("source_label"), F.col("said"), F.coalesce("chosen_confidence", F.lit("")), status, F.col("source_page"), F.lit(None))
    return best.select("document_id", "field", F.col("chosen").alias("value"), meta.alias("meta"), "conflict")


def _table_values(rows: DataFrame, spec: FieldSpec) -> DataFrame:
    """document_id, the table field's rows in page order, and its meta."""
    some = rows.withColumn("__rows", fold.whole_rows(spec, rows.schema[spec.key].dataType)).filter(F.size("__rows") > 0).withColumn("__m", F.try_element_at("field_meta", F.lit(spec.key)))
    of = lambda k: F.col("__m")[k]
    seen = F.when(of("evidence") != "", of("evidence"))
    out = some.groupBy("document_id").agg(
        F.flatten(fold.ordered(F.col("__rows"), F.col("page"), plain=False)).alias("__value"),
        F.min_by(of("source_label"), F.when(of("source_label") != "", F.col("page"))).alias("label"),
        F.array_join(F.array_distinct(fold.ordered(seen, F.col("page"))), JOINT).alias("said"),
        conf_name(F.min(conf_rank(of("confidence")))).alias("confidence"),
        fold.page_list().alias("pages"),
    )
    meta = _meta(F.col("label"), F.col("said"), F.col("confidence"), F.lit("found"), F.col("pages"), F.size("__value"))
    return out.select("document_id", F.col("__value").alias(spec.key), meta.alias(f"__meta_{spec.key}"))


def fold_documents(rows: DataFrame, specs: list[FieldSpec]) -> Records:
    """Records and issues of pages with a document_id. A scalar field has the value of the highest confidence, then of the
    lowest page; differing values make it ambiguous and an issue. Rows of a table field are joined in page order."""
    rows = materialise(rows, "documents")
    first = lambda c: F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("page"))).alias(c)
    heads = rows.groupBy("document_id", "filename").agg(
        fold.page_list().alias("pages"), F.min("page").alias("first_page"), first("document_type"), first("document_no"), first("error"),
        conf_name(F.min(conf_rank(F.col("confidence")))).alias("confidence"), conf_name(F.min(conf_rank(F.col("segment_confidence")))).alias("segmentation_confidence"),
    )
    records = heads.withColumn("document_type", F.coalesce("document_type", F.lit(grouping.UNKNOWN_TYPE)))
    for column, name, sep in (("evidence", "evidence", "+"), ("segment_reason", "segmentation_reason", JOINT)):
        kinds = fold.distinct_in_order(rows, ["document_id"], column, "page", name, sep)
        records = records.join(kinds, "document_id", "left").withColumn(name, F.coalesce(name, F.lit("")))
    held = [s for s in scalars(specs) if s.key in rows.columns]
    none = _meta(F.lit(None), F.lit(None), F.lit(""), F.lit("not_found"), F.lit(None), F.lit(None))
    metas, conflicts = [], None
    if held:
        values = materialise(_scalar_values(rows, held), "document-values")
        wide = values.groupBy("document_id").agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct("value", "meta")))).alias("__values"))
        records = records.join(wide, "document_id", "left")
        for s in held:
            cell = F.try_element_at("__values", F.lit(s.key))
            records = records.withColumn(s.key, cell["value"].cast(rows.schema[s.key].dataType))
            metas.append((s.key, F.coalesce(cell["meta"], none)))
        conflicts = values.filter(F.size("conflict") > 0)
    for s in (s for s in tables(specs) if s.key in rows.columns):
        records = records.join(_table_values(rows, s), "document_id", "left")
        empty = _meta(F.lit(None), F.lit(""), F.lit(""), F.lit("not_found"), F.lit(""), F.lit(0))
        metas.append((s.key, F.coalesce(F.col(f"__meta_{s.key}"), empty)))
        records = records.withColumn(s.key, F.coalesce(s.key, F.array().cast(records.schema[s.key].dataType)))
    good = F.col("error").isNull()
    meta = F.map_from_arrays(F.array(*[F.lit(k) for k, _ in metas]), F.array(*[m for _, m in metas])) if metas else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(f"array<{META}>"))
    records = records.withColumn("field_meta", F.when(good, meta))
    records = materialise(records.drop("__values", *[f"__meta_{s.key}" for s in tables(specs)]), "document-records")
    issues = records.filter(~good).select("document_id", F.lit("").alias("field"), F.col("error").alias("message"))
    low = records.filter(good & (F.col("segmentation_confidence") == "low"))
    issues = issues.unionByName(low.select("document_id", F.lit(BOUNDARY_FIELD).alias("field"), F.when(F.col("segmentation_reason") != "", F.col("segmentation_reason")).otherwise(BOUNDARY_LOW).alias("message")))
    if conflicts is not None:
        label = F.create_map(*[F.lit(x) for s in held for x in (s.key, s.label)])
        told = conflicts.join(records.filter(good).select("document_id"), "document_id", "left_semi")
        issues = issues.unionByName(told.select("document_id", F.try_element_at(label, F.col("field")).alias("field"), F.concat(F.lit(CONFLICT), F.array_join("conflict", " / ")).alias("message")))
    return Records(records, issues)


def assemble(pages: DataFrame, specs: list[FieldSpec]) -> Records:
    """Records and issues of pages, grouped by anchors, numbers, types and continuations."""
    return fold_documents(documents(pages), specs)

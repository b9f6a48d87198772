"""The default extractor: labelled values and table rows out of page text, in column expressions.

Another extractor is a function from pages (filename, page, kind, text) to pages with the fields' columns; put the
filter on blank pages before it, and write its result before anything reads it twice.
"""

from __future__ import annotations

import re
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import coerce, strip, to_num, unread
from ..specs import ColumnSpec, FieldSpec, scalars, tables

# Characters that stand for each other in labels, and the label of a totals line.
EQUAL = {"(": "[（(]", "（": "[（(]", ")": "[）)]", "）": "[）)]", "¥": "[¥￥]", "￥": "[¥￥]", ":": "[:：]", "：": "[:：]"}
TOTALS, VALUE_CHARS = "合计", 60


class Extractor(Protocol):
    def __call__(self, pages: DataFrame, specs: list[FieldSpec]) -> DataFrame: ...


def label_pattern(label: str) -> str:
    return "".join(EQUAL.get(c, re.escape(c)) for c in label)


def _found(text: Column, label: str, gap: str) -> Column:
    return F.regexp_extract(text, rf"(?U){label_pattern(label)}{gap}([^\n]{{1,{VALUE_CHARS}}})", 1)


def _value(found: Column, kind: str) -> Column:
    """What was found up to two spaces; the number in it where the field is one."""
    value = strip(F.regexp_replace(strip(found), r"(?U)\s{2,}(?s:.*)$", ""))
    return F.translate(F.regexp_extract(value, r"-?[\d,，]+(?:\.\d+)?", 0), ",，", "") if kind == "number" else value


def scalar(text: Column, spec: FieldSpec) -> Column:
    """What follows the label: after a colon, else after white space; up to two spaces or 60 characters. Each pattern
    runs once, the second only where the first finds nothing."""
    some = lambda gap: F.transform(F.array(_value(_found(text, spec.label, gap), spec.type)), lambda v: F.when(v != "", v))[0]
    return F.coalesce(some(r"\s*[:：]\s*"), some(r"\s+"))


def table_rows(text: Column, spec: FieldSpec) -> Column:
    """Lines that look like rows: parts between two or more spaces, at least all but two of the columns, a digit, not
    two labels of columns, not a totals line."""
    n = len(spec.columns)
    parts = lambda line: F.filter(F.split(line, r"(?U)\s{2,}"), lambda p: p != "")
    # a single space between a number and a word also parts them where parts are missing
    loose = lambda line: F.regexp_replace(line, r"(?U)(?<=^|\s)([\d,，.\-]+)\s+(?=\S)", "$1  ")

    def may_be(line: Column) -> Column:
        labels = sum((line.contains(c.label).cast("int") for c in spec.columns), F.lit(0))
        return line.rlike(r"(?U)\d") & ~line.startswith(TOTALS) & (labels < 2)

    # what lines alone tell comes first, so that only lines which may be rows are split
    lines = F.filter(F.transform(F.split(text, "\n"), strip), may_be)
    split = F.transform(F.transform(lines, lambda x: F.struct(x.alias("line"), parts(x).alias("p"))), lambda x: F.when(F.size(x["p"]) < n, parts(loose(x["line"]))).otherwise(x["p"]))
    rows = F.filter(split, lambda p: F.size(p) >= max(2, n - 2))
    return F.transform(rows, lambda p: F.struct(*[F.try_element_at(p, F.lit(i + 1)).alias(c.key) for i, c in enumerate(spec.columns)]))


def rule_extract(pages: DataFrame, specs: list[FieldSpec], text: str = "text") -> DataFrame:
    """pages with a column for every field: scalars coerced to their type, tables as arrays of rows."""
    t, held = F.coalesce(F.col(text), F.lit("")), scalars(specs)
    # found texts are columns of their own before types are made of them, as these read them more than once
    found = pages.withColumns({f"__raw_{s.key}": scalar(t, s) for s in held}) if held else pages
    out = {s.key: to_num(F.col(f"__raw_{s.key}")) if s.type == "number" else coerce(F.col(f"__raw_{s.key}"), s.type) for s in held}
    return found.withColumns(out | {s.key: table_rows(t, s) for s in tables(specs)}).drop(*[f"__raw_{s.key}" for s in held])


def coerced(pages: DataFrame, specs: list[FieldSpec]) -> DataFrame:
    """pages whose fields are texts, with every field in its type; the text of a number that cannot be read stays beside
    it in <key>_raw, which is null where the number could be read."""
    raw = {f"{s.key}_raw": unread(F.col(s.key), s.type) for s in scalars(specs) if s.type == "number"}
    kept = pages.withColumns(raw) if raw else pages
    return kept.withColumns({s.key: coerce(F.col(s.key).cast("string"), s.type) for s in scalars(specs)})


def json_rows(payload: Column, field: str) -> Column:
    """A table field of a JSON answer: the field if it is a list, else its items, else nothing; null for bad JSON."""
    v = F.try_parse_json(payload)
    return F.coalesce(F.try_variant_get(v, f"$.{field}", "array<variant>"), F.try_variant_get(v, f"$.{field}.items", "array<variant>"), F.when(v.isNotNull(), F.array().cast("array<variant>")))


def label_columns(row: Column, spec: FieldSpec) -> Column:
    """A row given as a map: declared columns under their key or their label (with any white space around it), of which
    the first cell that is not empty counts; all other cells are kept in _extra."""
    known = [x for c in spec.columns for x in (c.key, c.label)]

    def cell(c: ColumnSpec) -> Column:
        mine = F.filter(F.map_entries(row), lambda e: ((e["key"] == c.key) | (strip(e["key"]) == c.label)) & (e["value"] != ""))
        return F.try_element_at(mine, F.lit(1))["value"].alias(c.key)

    return F.struct(*map(cell, spec.columns), F.map_filter(row, lambda k, _: ~(k.isin(*known) | strip(k).isin(*[c.label for c in spec.columns]))).alias("_extra"))

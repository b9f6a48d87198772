"""The fixed-format plan: pages, extraction, continuation chains, folding, sum checks, repair and splicing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import flatten, fold, grouping, outputs, validate
from ..operators.extract import Extractor, rule_extract
from ..specs import FieldSpec, group_field, tables
from ..storage import materialise


@dataclass
class Result:
    pages: DataFrame
    records: DataFrame
    validations: DataFrame

    def details(self, specs: list[FieldSpec]) -> DataFrame:
        return flatten.details(self.records, ["filename", "group_no"], [s.key for s in tables(specs)])

    def sheets(self, specs: list[FieldSpec]) -> dict[str, DataFrame]:
        return outputs.fixed_sheets(self.records, specs, self.validations, ("filename", "group_no"))


def assemble(pages: DataFrame, specs: list[FieldSpec]) -> Result:
    """Records and validations of extracted pages (filename, page, continues, the fields; optionally error)."""
    key = group_field(specs)
    is_error = F.col("error").isNotNull() if "error" in pages.columns else F.lit(False)
    grouped = grouping.with_errors(pages, is_error, lambda p: grouping.chain(p, F.col(key.key) if key else None, F.col("continues")))
    # an error page is a record of its own
    single = grouped.withColumn("group_no", F.when(F.col("is_error"), -F.col("page").cast("long")).otherwise(F.col("group_no")))
    records = fold.fold(single, specs, ["filename", "group_no", "is_error"])
    checked = any(s.sum_check for s in specs)
    validations = validate.sum_checks(records, specs, ["filename", "group_no", "pages"] + (["repaired"] if "repaired" in records.columns else [])) if checked else None
    return Result(grouped, records, validations)


def run(pages: DataFrame, specs: list[FieldSpec], extract: Extractor = rule_extract, repair: Extractor | None = None, most: int = validate.REPAIR_MAX) -> Result:
    """The whole plan on page rows (filename, page, kind, text, continues); pages of unknown kind are taken as not blank.
    Extracted pages are written before they are read again: an extractor may be slow and need not give the same answer
    twice. With `repair`, the pages of the first failing records of each file are extracted anew, with a note of what was
    wrong, spliced in (of several new rows of a page the last), and everything is folded again, once."""
    done = materialise(extract(pages.filter(F.coalesce(F.col("kind") != "blank", F.lit(True))), specs), "extracted")
    first = assemble(done, specs)
    if repair is None or first.validations is None:
        return first
    checked = materialise(first.validations, "validations")
    failing = validate.to_repair(checked, ["filename"], ["group_no"], most)
    notes = validate.repair_notes(checked, ["filename", "group_no"])
    again = first.pages.join(failing.join(notes, ["filename", "group_no"]), ["filename", "group_no"]).select(*pages.columns, "note")
    fixed = materialise(repair(again, specs).select(*done.columns).withColumn("__order", F.monotonically_increasing_id()), "repaired")
    return assemble(materialise(validate.splice(done, fixed, ["filename", "page"], "__order"), "spliced"), specs)

"""Pages of several document types to records, each under the schema of its type.

Edge cases: a document whose type has no schema, and a page with an error, is a record all the same, without fields; a
document's type is the first known one of its pages, else unknown; everything else is as `common` says.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import canonical
from ..specs import FieldSpec
from ..storage import materialise
from . import common, grouping


@dataclass
class Mixed:
    """by_type: the records of each schema; others: those without a schema and those with an error; issues of all."""

    by_type: dict[str, DataFrame]
    others: DataFrame
    issues: DataFrame

    def index(self) -> DataFrame:
        """One row for every document, whatever its schema."""
        columns = ["document_id", "filename", "pages", "document_type", "document_no", "schema_type", "confidence", "segmentation_confidence", "segmentation_reason", "error"]
        status = F.exists(F.map_values("field_meta"), lambda m: m["status"] == "ambiguous")
        parts = [df.select(*columns, F.coalesce(status, F.lit(False)).alias("ambiguous")) for df in (*self.by_type.values(), self.others)]
        return reduce(DataFrame.unionByName, parts)


def schema_of(doc_type: Column, schemas: list[str]) -> Column:
    """The first schema whose canonical name is the type's, or null. Schemas are the driver's list, so the choice is an
    expression, not a join."""
    key = lambda c: F.when(canonical(c) == "", grouping.UNKNOWN_TYPE).otherwise(canonical(c))
    choice = F.lit(None).cast("string")
    for name in reversed(schemas):
        choice = F.when(key(doc_type) == key(F.lit(name)), F.lit(name)).otherwise(choice)
    return choice


def assemble(pages: DataFrame, schemas: dict[str, list[FieldSpec]]) -> Mixed:
    """Records of each schema and the others: pages of one file and anchor (their own page where there is none) are a
    document, with document_id mix_doc_0001, ... in the order of file and first page over all types."""
    rows = materialise(common.documents(pages, "mix_doc_", only_anchors=True), "mixed-pages")
    named = F.when(F.coalesce(F.col("document_type"), F.lit("")) != "", F.col("page"))
    types = rows.groupBy("document_id").agg(F.coalesce(F.min_by("document_type", named), F.lit(grouping.UNKNOWN_TYPE)).alias("type"), F.max("error").alias("bad"))
    chosen = F.when(F.coalesce(F.col("bad"), F.lit("")) == "", schema_of(F.col("type"), list(schemas)))
    typed = materialise(rows.join(types.select("document_id", chosen.alias("schema_type"), F.col("type").alias("__type")), "document_id"), "mixed-typed")
    by_type, issues = {}, []
    for name, specs in schemas.items():
        found = common.fold_documents(typed.filter(F.col("schema_type") == name).drop("__type"), specs)
        by_type[name] = found.records.withColumn("schema_type", F.lit(name))
        issues.append(found.issues)
    rest = common.fold_documents(typed.filter("schema_type is null").drop("__type"), [])
    return Mixed(by_type, rest.records.withColumn("schema_type", F.col("document_type")), reduce(DataFrame.unionByName, issues, rest.issues))

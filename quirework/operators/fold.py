"""Groups of pages to records: carried scalars, joined rows, confidences, and the choice among differing values.

Only a document's own rows are ever gathered (pages and table rows of one group); distinct values and evidences are
made distinct before they are gathered.

Edge cases: null, empty text and empty lists are no values; a group without a value has null, a table field without rows
an empty list; rows that are null or have no cell are left out; equal page numbers within a group are ordered by value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType

from ..functions.values import conf_name, conf_rank, value_key
from ..specs import FieldSpec, scalars, tables
from .extract import label_columns

#: Conflicting values that an issue lists.
LISTED = 5


def ordered(value: Column, order: Column, plain: bool = True) -> Column:
    """Aggregate: the group's values in order, nulls left out; those of one place by value, where these can be compared
    (plain)."""
    pairs = F.collect_list(F.when(value.isNotNull(), F.struct(order.alias("o"), value.alias("v"))))
    by_place = lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0)
    return F.transform(F.array_sort(pairs) if plain else F.array_sort(pairs, by_place), lambda x: x["v"])


def _has_map(kind: DataType) -> bool:
    return isinstance(kind, ArrayType) and isinstance(kind.elementType, MapType)


def page_list(page: str = "page") -> Column:
    """Aggregate: pages as 1+2+5."""
    return F.concat_ws("+", F.transform(F.array_sort(F.collect_list(page)), lambda x: x.cast("string")))


def carried(spec: FieldSpec, page: str = "page") -> Column:
    """Aggregate: the first or last value that is not empty, by page."""
    c = F.col(spec.key)
    has = c.isNotNull() & (c.cast("string") != "")
    return (F.max_by if spec.carry == "last" else F.min_by)(c, F.when(has, F.col(page))).alias(spec.key)


def whole_rows(spec: FieldSpec, kind: DataType) -> Column:
    """A table field's rows that hold anything. Rows given as maps get the declared columns, under key or label, and the
    others in _extra; a field that is no list of rows has none."""
    c = F.col(spec.key)
    if not isinstance(kind, ArrayType):
        return F.array()
    if isinstance(kind.elementType, MapType):
        kept = F.filter(c, lambda r: r.isNotNull() & (F.size(r) > 0))
        return F.transform(kept, lambda r: label_columns(r, spec)) if spec.columns else kept
    return F.filter(c, lambda r: r.isNotNull())


def fold(pages: DataFrame, specs: list[FieldSpec], by: list[str], page: str = "page") -> DataFrame:
    """One record a group: pages, scalars, joined table rows, and, where the pages have them, evidence (distinct, in
    page order), confidence (the lowest known), kinds (of its pages, in order) and repaired (of any page)."""
    has = set(pages.columns)
    held = [s for s in tables(specs) if s.key in has]
    rows = pages.withColumns({s.key: whole_rows(s, pages.schema[s.key].dataType) for s in held}) if held else pages
    out = [page_list(page).alias("pages"), F.count("*").alias("n_pages"), F.min(page).alias("first_page")]
    out += [carried(s, page) for s in scalars(specs) if s.key in has]
    out += [F.flatten(ordered(F.col(s.key), F.col(page), not _has_map(pages.schema[s.key].dataType))).alias(s.key) for s in held]
    if "evidence" in has:
        out.append(F.array_join(F.array_distinct(ordered(F.when(F.col("evidence") != "", F.col("evidence")), F.col(page))), "+").alias("evidence"))
    if "confidence" in has:
        out.append(conf_name(F.min(conf_rank(F.col("confidence")))).alias("confidence"))
    if "kind" in has:
        out.append(ordered(F.col("kind"), F.col(page)).alias("kinds"))
    if "repaired" in has:
        out.append(F.coalesce(F.bool_or("repaired"), F.lit(False)).alias("repaired"))
    if "error" in has:
        out.append(F.min_by("error", F.when(F.col("error").isNotNull(), F.col(page))).alias("error"))
    return rows.groupBy(*by).agg(*out)


def distinct_in_order(rows: DataFrame, by: list[str], value: str, order: str, name: str, sep: str = "+") -> DataFrame:
    """by, name: the distinct values in the order of their first row. Made distinct before they are gathered, so a
    group of any size costs its distinct values only."""
    first = rows.filter(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(*by, value).agg(F.min(order).alias("__o"))
    return first.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__o", value))), lambda x: x[value]), sep).alias(name))


def choose(candidates: DataFrame, by: list[str], value: str = "value", confidence: str = "confidence", page: str = "page", status: str | None = None, number: bool | Column = False, keep: list[str] = ()) -> DataFrame:
    """Of each group's candidates (values that are not empty and not marked not_applicable) the one of the highest
    confidence, then of the lowest page: chosen, chosen_confidence, source_page, `keep` columns of the chosen row, status
    (found or ambiguous) and conflict: up to five differing values by first page, or none. number: whether values compare
    as numbers, or a column that tells so."""
    c = F.col(value)
    rows = candidates.filter(c.isNotNull() & (c.cast("string") != ""))
    if status:
        rows = rows.filter(F.coalesce(F.col(status) != "not_applicable", F.lit(True)))
    rank = F.struct(F.coalesce(conf_rank(F.col(confidence)), F.lit(-1)).alias("r"), (-F.col(page)).alias("p"))
    key = F.when(number, value_key(c, True)).otherwise(value_key(c)) if isinstance(number, Column) else value_key(c, number)
    # per distinct value first: what a group holds is then bounded by its distinct values
    held = F.struct(c.alias("value"), F.col(confidence).alias("confidence"), F.col(page).alias("page"), *keep)
    each = rows.withColumn("__k", key).groupBy(*by, "__k").agg(F.max_by(held, rank).alias("best"), F.max(rank).alias("rank"), F.min(page).alias("first"), F.min_by(c, page).alias("shown"))
    order = Window.partitionBy(*by).orderBy("first")
    listed = each.withColumn("place", F.row_number().over(order)).withColumn("listed", F.when(F.col("place") <= LISTED, F.struct("first", "shown")))
    out = listed.groupBy(*by).agg(F.max_by("best", "rank").alias("best"), F.count("*").alias("n"), F.array_sort(F.collect_list("listed")).alias("all"))
    none = F.array().cast(f"array<{dict(candidates.dtypes)[value]}>")
    return out.select(
        *by,
        F.col("best.value").alias("chosen"),
        F.col("best.confidence").alias("chosen_confidence"),
        F.col("best.page").alias("source_page"),
        *[F.col(f"best.{k}").alias(k) for k in keep],
        F.when(F.col("n") > 1, "ambiguous").otherwise("found").alias("status"),
        F.when(F.col("n") > 1, F.transform("all", lambda x: x["shown"])).otherwise(none).alias("conflict"),
    )

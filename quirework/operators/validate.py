"""Declared totals against their rows, repair of the records that fail, and splicing of repaired pages.

Amounts are summed as they stand (ten decimals) and rounded once. Rows are a record's table field (an array), or rows of
a table of their own (`check_lines`), which are summed by partial aggregation and never gathered.

Edge cases: a null or empty table has the sum 0 and does not match; an amount that is no number leaves its record
unmatched, the others are summed all the same; a null declared total has no difference and does not match; repeated keys
of records are checked one by one; records with errors are not checked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, NumericType

from ..functions.values import AMOUNT, to_amount, to_money
from ..specs import FieldSpec

# How far a declared total may be off, and records repaired in a job.
TOLERANCE, REPAIR_MAX = 0.011, 6
_MONEY = "decimal(30,2)"


def _amount(c: Column, kind: DataType | None) -> Column:
    """An exact amount: columns of numbers are cast, all others are read as text."""
    return c.try_cast(AMOUNT) if isinstance(kind, NumericType) else to_amount(c)


def sums_of_rows(rows: Column, column: str, kind: DataType | None = None) -> Column:
    """Struct of a table field's rows: total (two decimals), unread (rows without a number), n. kind: the column's type,
    text if it is not known."""
    zero = F.lit(0).cast(AMOUNT)

    def add(sums: Column, amount: Column) -> Column:
        return F.struct((sums["total"] + F.coalesce(amount, zero)).cast(AMOUNT).alias("total"), (sums["unread"] + amount.isNull().cast("long")).alias("unread"), (sums["n"] + 1).alias("n"))

    def end(sums: Column) -> Column:
        return F.struct(F.round(sums["total"], 2).cast(_MONEY).alias("total"), sums["unread"].alias("unread"), sums["n"].alias("n"))

    amounts = F.transform(rows, lambda r: _amount(r[column], kind))
    start = F.struct(zero.alias("total"), F.lit(0).cast("long").alias("unread"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(F.coalesce(amounts, F.array().cast(f"array<{AMOUNT}>")), start, add, end)


def verdict(declared: Column, total: Column, unread: Column, n: Column) -> dict[str, Column]:
    """match: there are rows, all with numbers, and the declared total is near their sum; diff: how far it is off."""
    diff = (declared - total).cast(_MONEY)
    return {"diff": diff, "match": F.coalesce((unread == 0) & (n > 0) & (F.abs(diff) < TOLERANCE), F.lit(False))}


def sum_checks(records: DataFrame, specs: list[FieldSpec], keep: list[str]) -> DataFrame:
    """One row for every record and checked field: keep, field, label, table, column, sum_from_table, declared, diff,
    match."""
    if "is_error" in records.columns:
        records = records.filter(~F.coalesce("is_error", F.lit(False)))
    checked = [s for s in specs if s.sum_check and s.sum_check.table in records.columns]
    if not checked:
        raise ValueError("no field has a sum check")
    # every sum is a column of its own before it is read four times
    kinds = [{f.name: f.dataType for f in getattr(records.schema[s.sum_check.table].dataType.elementType, "fields", [])} for s in checked]
    summed = records.withColumns({f"__sum_{i}": sums_of_rows(F.col(s.sum_check.table), s.sum_check.column, kinds[i].get(s.sum_check.column)) for i, s in enumerate(checked)})
    checks = []
    for i, s in enumerate(checked):
        sums, declared = F.col(f"__sum_{i}"), to_money(F.col(s.key))
        found = verdict(declared, sums["total"], sums["unread"], sums["n"])
        named = [F.lit(x).alias(n) for n, x in (("field", s.key), ("label", s.label), ("table", s.sum_check.table), ("column", s.sum_check.column))]
        checks.append(F.struct(*named, sums["total"].alias("sum_from_table"), declared.alias("declared"), found["diff"].alias("diff"), found["match"].alias("match")))
    return summed.select(*keep, F.explode(F.array(*checks)).alias("c")).select(*keep, "c.*")


def check_lines(records: DataFrame, lines: DataFrame, key: list[str], declared: str, amount: str) -> DataFrame:
    """records with sum_from_table, n_rows, diff and match of their lines, which are a table of their own with the same
    key. Lines are aggregated before they meet the records, so a record of any number of lines costs one row; lines of
    no record are left out, a null key meets nothing."""
    number = _amount(F.col(amount), lines.schema[amount].dataType)
    sums = lines.groupBy(*key).agg(F.round(F.sum(number), 2).cast(_MONEY).alias("__total"), F.count_if(number.isNull()).alias("__unread"), F.count("*").alias("__n"))
    joined = records.join(sums, key, "left").withColumn("sum_from_table", F.coalesce("__total", F.lit(0).cast(_MONEY))).withColumn("n_rows", F.coalesce("__n", F.lit(0).cast("long")))
    said = _amount(F.col(declared), records.schema[declared].dataType).try_cast(_MONEY)
    found = verdict(said, F.col("sum_from_table"), F.coalesce("__unread", F.lit(0)), F.col("n_rows"))
    return joined.withColumns(found).drop("__total", "__unread", "__n")


def to_repair(validations: DataFrame, job: list[str], order: list[str], most: int = REPAIR_MAX) -> DataFrame:
    """The first `most` failing records of each job, in the order. A job's list is cut in each task before it is cut as a
    whole, so a job of any size sends few rows on."""
    failing = validations.filter(~F.col("match")).select(*job, *order).distinct()
    return failing.withColumn("__n", F.row_number().over(Window.partitionBy(*job).orderBy(*order))).filter(F.col("__n") <= most).drop("__n")


def splice(pages: DataFrame, repaired: DataFrame, key: list[str], order: str) -> DataFrame:
    """pages with the repaired page of the same key in their place; of several repaired pages the last in `order` (a
    column of repaired) counts, and those of no page are left out. Columns are those of pages, and repaired: whether a row
    is a repaired one, or was one before."""
    columns = [c for c in pages.columns if c not in key and c != "repaired"]
    chosen = repaired.groupBy(*key).agg(F.max_by(F.struct(*columns), order).alias("__new"))
    joined = pages.join(chosen, key, "left")
    is_new = F.col("__new").isNotNull()
    before = F.coalesce("repaired", F.lit(False)) if "repaired" in pages.columns else F.lit(False)
    return joined.select(*key, *[F.when(is_new, F.col("__new")[c]).otherwise(F.col(c)).alias(c) for c in columns], (is_new | before).alias("repaired"))


def repair_notes(validations: DataFrame, by: list[str]) -> DataFrame:
    """by, note: what the repair of a failing record is told, a line for each failing field in the order of their names."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    line = F.concat(F.col("label"), F.lit(": declared "), text("declared"), F.lit(", rows of "), F.col("table"), F.lit("."), F.col("column"), F.lit(" sum to "), text("sum_from_table"), F.lit(", off by "), text("diff"))
    lines = validations.filter(~F.col("match")).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("field", line.alias("line")))).alias("lines"))
    return lines.select(*by, F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("note"))

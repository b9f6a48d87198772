"""Pages to logical documents: continuation chains, number groups, local boundaries, boundary verdicts.

All groupings work within a file: windows and joins are keyed by it (or by file and type), so files are independent
tasks. Pages are given as columns filename, page and what an operator names; they are a deterministic read.

Edge cases: a null `continues` is false, a null or empty key, number or type is unknown (types then are all of one unknown
type), and a number of stripped characters only is no number. (file, page) is a key: pages that repeat it are ordered
arbitrarily by `chain`; where pointers are followed (`roots` and what uses it) one of them is taken for each, and all rows
get its result. Empty tables give empty results; other columns are kept.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import canonical, clean
from ..storage import materialise, number_rows, release

# Pages that one boundary call sees, document types without a name, and reasons and fields of issues.
CHUNK_PAGES = 40
UNKNOWN_TYPE, UNKNOWN_DOCUMENT = "未知", "未知文档"
NUMBER_CONFLICT, LOCAL_GROUPING, BOUNDARY_FIELD = "原始文档编号冲突，已安全拆分", "AI边界复核失败，使用本地归组", "文档边界"
REASON_CHARS, ERROR_CHARS = 240, 180


def chain(pages: DataFrame, key: Column | None, continues: Column, file: str = "filename", page: str = "page") -> DataFrame:
    """pages with group_no, from 1 in each file: a page starts a group if it is the file's first, if its key is known
    and differs from the key in force, or if it has no key and does not continue.

    The key in force is the last event before the page: any page with a key, or one that does not continue (which
    clears the key). Both are window expressions over one sort.
    """
    gid = F.lit(None).cast("string") if key is None else F.when(key.cast("string") != "", key.cast("string"))
    order = Window.partitionBy(file).orderBy(page)
    before, upto = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    rows = pages.withColumn("__gid", gid).withColumn("__cont", F.coalesce(continues, F.lit(False)))
    event = F.when(F.col("__gid").isNotNull() | ~F.col("__cont"), F.struct("__gid"))
    rows = rows.withColumn("__force", F.last(event, ignorenulls=True).over(before)["__gid"]).withColumn("__first", F.row_number().over(order) == 1)
    starts = F.col("__first") | F.when(F.col("__gid").isNotNull(), ~F.col("__gid").eqNullSafe(F.col("__force"))).otherwise(~F.col("__cont"))
    return rows.withColumn("group_no", F.sum(starts.cast("int")).over(upto)).drop("__gid", "__cont", "__force", "__first")


def with_errors(pages: DataFrame, is_error: Column, grouped) -> DataFrame:
    """Group the pages without errors by grouped(pages); every page with an error is a group of its own (group_no null)
    and breaks no chain."""
    flagged = pages.withColumn("is_error", F.coalesce(is_error, F.lit(False)))
    good = grouped(flagged.filter(~F.col("is_error")))
    return good.unionByName(flagged.filter("is_error").withColumn("group_no", F.lit(None).cast("long")), allowMissingColumns=True)


def roots(pages: DataFrame, parent: str = "parent", file: str = "filename", page: str = "page") -> DataFrame:
    """pages with root: the end of each page's chain of parents, by pointer jumping; rounds grow with the logarithm of
    the longest chain, and each round's pointers are written, so lineage stays short."""
    # one row a page, so that repeated pages cannot multiply
    pointers = materialise(pages.groupBy(file, page).agg(F.min(parent).alias("root")), "parents")
    stored = pointers
    while True:
        up = pointers.select(F.col(file), F.col(page).alias("root"), F.col("root").alias("__up"))
        jumped = materialise(pointers.join(up, [file, "root"]).select(file, page, F.col("__up").alias("root"), (F.col("__up") != F.col("root")).alias("__moved")), "parents")
        release(stored)
        pointers, stored = jumped.drop("__moved"), jumped
        if jumped.filter("__moved").isEmpty():
            return pages.join(pointers, [file, page])


def number_groups(pages: DataFrame, doc_type: Column, number: Column, continues: Column, file: str = "filename", page: str = "page") -> DataFrame:
    """Pages without anchors: a page joins the group of the first page of its type and number, else, if it continues,
    that of the page of its type before it, else it starts one. root is the group's first page."""
    t, n = canonical(F.coalesce(F.when(doc_type != "", doc_type), F.lit(UNKNOWN_TYPE))), canonical(clean(number))
    rows = pages.withColumn("__t", t).withColumn("__n", F.when(n != "", n)).withColumn("__c", F.coalesce(continues, F.lit(False)))
    same = F.min(page).over(Window.partitionBy(file, "__t", "__n"))
    before = F.lag(page).over(Window.partitionBy(file, "__t").orderBy(page))
    parent = F.when(F.col("__n").isNotNull() & (same < F.col(page)), same).when(F.col("__c") & before.isNotNull(), before).otherwise(F.col(page))
    # stored once: the pages are read for the pointers, and again beside the roots
    stored = materialise(rows.withColumn("parent", parent).drop("__t", "__n", "__c"), "number-groups")
    return roots(stored, "parent", file, page)


def local_boundaries(pages: DataFrame, doc_type: Column, number: Column, role: Column, anchor: Column, file: str = "filename", page: str = "page") -> DataFrame:
    """Anchors put right within a file: a page with a number follows the page before it of the same type and number; one
    without, that continues, the latest page of its type that does not; else a given anchor before the page holds.
    root is the first page of the document."""
    t, n = canonical(F.coalesce(F.when(doc_type != "", doc_type), F.lit(UNKNOWN_DOCUMENT))), canonical(clean(number))
    rows = pages.withColumn("__t", t).withColumn("__n", F.when(n != "", n)).withColumn("__go", F.coalesce(role == "continuation", F.lit(False))).withColumn("__a", anchor.cast("long"))
    numbered = F.lag(page).over(Window.partitionBy(file, "__t", "__n").orderBy(page))
    by_type = Window.partitionBy(file, "__t").orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    head = F.coalesce(F.last(F.when(~F.col("__go"), F.col(page)), ignorenulls=True).over(by_type), F.first(page).over(by_type))
    known = rows.select(F.col(file), F.col(page).cast("long").alias("__a"), F.lit(True).alias("__known"))
    parent = (
        F.when(F.col("__n").isNotNull() & numbered.isNotNull(), numbered)
        .when(F.col("__n").isNull() & F.col("__go") & head.isNotNull(), head)
        .when(F.col("__known") & (F.col("__a") < F.col(page)), F.col("__a"))
        .otherwise(F.col(page))
    )
    joined = rows.join(known.distinct(), [file, "__a"], "left").withColumn("parent", parent.cast("long"))
    return roots(materialise(joined.drop("__t", "__n", "__go", "__a", "__known"), "local-boundaries"), "parent", file, page)


def _plain(value) -> str:
    text = "" if value is None or value != value else str(value)
    return "".join(c for c in text.lower() if c.isascii() and c.isalnum() or "一" <= c <= "鿿")


def _settle(pages: pd.DataFrame) -> pd.DataFrame:
    """One file: accept, override or refuse the verdicts page by page; pages of a failed call fall back."""
    pages = pages.sort_values("page").reset_index(drop=True)
    latest_numbered: dict[tuple[str, str], int] = {}
    latest_typed: dict[str, int] = {}
    numbers: dict[int, str] = {}
    anchors: dict[int, int] = {}
    accepted: set[int] = set()
    out = []
    for r in pages.itertuples(index=False):
        own_type, own_no = _plain(r.doc_type) or _plain(UNKNOWN_TYPE), _plain(r.doc_no)
        prior = latest_numbered.get((own_type, own_no)) if own_no else None
        if prior is None and r.continues == 1:
            prior = latest_typed.get(own_type)
        fallback = r.page if prior is None else anchors[prior]
        if r.failed:
            said_type, said_no, anchor, confidence, reason = own_type, own_no, fallback, "low", LOCAL_GROUPING
        else:
            said_type, said_no = _plain(r.v_type) or own_type, _plain(r.v_no) or own_no
            anchor = None if r.v_anchor is None or r.v_anchor != r.v_anchor else int(r.v_anchor)
            confidence = r.v_confidence if r.v_confidence in ("low", "medium", "high") else "low"
            reason = (r.v_reason or "").strip()[:REASON_CHARS]
            if anchor is None or anchor > r.page or anchor != r.page and anchor not in accepted:
                anchor = fallback
            prior = latest_numbered.get((said_type, said_no)) if said_no else None
            if prior is not None:
                anchor = anchors[prior]
            if anchor != r.page and said_no and numbers.get(anchor) and numbers[anchor] != said_no:
                anchor, confidence, reason = r.page, "low", NUMBER_CONFLICT
        anchors[r.page] = anchor
        accepted.add(anchor)
        numbers[r.page] = said_no
        latest_typed[said_type] = r.page
        if said_no:
            latest_numbered[said_type, said_no] = r.page
        out.append((r.filename, r.page, anchor, confidence, reason))
    return pd.DataFrame(out, columns=["filename", "page", "anchor", "confidence", "reason"])


def _chunked(pages: DataFrame, verdicts: DataFrame, chunk: int) -> DataFrame:
    """pages with their verdicts, the place of their call in the file, and whether a page of the call has an error."""
    narrow = pages.select("filename", F.col("page").cast("long").alias("page"), "doc_type", "doc_no", "continues")
    said = verdicts.withColumn("page", F.col("page").cast("long"))
    said = said if "v_error" in said.columns else said.withColumn("v_error", F.lit(None).cast("string"))
    place = F.row_number().over(Window.partitionBy("filename").orderBy("page")) - 1
    joined = narrow.join(said, ["filename", "page"], "left").withColumn("call", F.floor(place / chunk))
    return joined.withColumn("failed", F.max("v_error").over(Window.partitionBy("filename", "call")).isNotNull())


def refine_boundaries(pages: DataFrame, verdicts: DataFrame, chunk: int = CHUNK_PAGES) -> DataFrame:
    """filename, page, anchor, confidence and reason of every page, from verdicts (filename, page, v_anchor, v_type,
    v_no, v_confidence, v_reason, and v_error where a call failed) on pages (filename, page, doc_type, doc_no, continues).

    A page's verdict may point to itself or to an accepted anchor before it; else the page falls back to its number,
    then to its type. An equal number in the file wins over the verdict, and a differing number at the anchor splits.
    If a call failed, all of the `chunk` pages that it saw fall back. Whether an anchor is accepted depends on the pages
    before it, so a file's few narrow columns are folded in order by one task; files have up to thousands of pages.
    """
    kind = dict(pages.dtypes)["filename"]
    columns = ["filename", "page", "doc_type", "doc_no", "continues", "v_anchor", "v_type", "v_no", "v_confidence", "v_reason", "failed"]
    return _chunked(pages, verdicts, chunk).select(*columns).groupBy("filename").applyInPandas(_settle, f"filename {kind}, page long, anchor long, confidence string, reason string")


def boundary_issues(pages: DataFrame, verdicts: DataFrame, chunk: int = CHUNK_PAGES) -> DataFrame:
    """document_id (empty), field and message of every failed call: its file, first and last page, and error."""
    failed = _chunked(pages, verdicts, chunk).filter("failed").groupBy("filename", "call").agg(F.min("page").alias("a"), F.max("page").alias("b"), F.min_by("v_error", F.when(F.col("v_error").isNotNull(), F.col("page"))).alias("e"))
    message = F.concat(F.col("filename").cast("string"), F.lit(" 第"), F.col("a").cast("string"), F.lit("-"), F.col("b").cast("string"), F.lit("页边界复核失败，已使用本地安全归组："), F.substring("e", 1, ERROR_CHARS))
    return failed.select(F.lit("").alias("document_id"), F.lit(BOUNDARY_FIELD).alias("field"), message.alias("message"))


def document_ids(records: DataFrame, order: list[str], prefix: str = "doc_") -> DataFrame:
    """records with document_id: doc_0001, doc_0002, ... in the order, by ranges of it."""
    numbered = number_rows(records, "__id", order)
    place = F.col("__id").cast("string")
    return numbered.withColumn("document_id", F.concat(F.lit(prefix), F.when(F.length(place) < 4, F.lpad(place, 4, "0")).otherwise(place))).drop("__id")

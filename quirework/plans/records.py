"""Queries over whole records: what users take home, cross-layout documents, splitting with inheritance, and models."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import boxes, common, doubles, flatten, fold, model, outputs, split, validate
from ..sources.tables import event_pages, order_lines, table, turn_pages
from ..specs import FieldSpec, normalize_common_fields, normalize_fields
from ..storage import materialise, new_path
from .catalogue import EVENTS, ORDER_SPECS, ROOTS, _orders
from .registry import query

_DOC = "CASE WHEN k < 10000 THEN lpad(k::VARCHAR, 4, '0') ELSE k::VARCHAR END"


# --- fixed-format outputs ------------------------------------------------------------------------------------------


@query(
    """WITH l AS (SELECT l_orderkey AS k, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS total, count(*) AS n FROM lineitem GROUP BY 1),
o AS (SELECT o_orderkey AS k, o_custkey, o_orderstatus AS s, coalesce(n, 0) AS n, coalesce(total, 0) AS total, CASE WHEN o_orderkey % 2 = 0 THEN coalesce(total, 0) ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS declared FROM orders LEFT JOIN l ON l.k = o_orderkey),
c AS (SELECT *, k % 11 = 0 AS bad, n > 0 AND abs(declared - total) < 0.011 AS match, k % 5 = 0 AS again FROM o)
SELECT o_custkey AS filename, k::VARCHAR AS pages, CAST(declared AS DOUBLE) AS declared, CASE s WHEN 'F' THEN '✓' WHEN 'O' THEN '✗' ELSE '' END AS closed, CAST(n AS INTEGER) AS lines_rows,
       CASE WHEN k % 3 = 0 THEN 'low' ELSE '' END AS confidence, CASE k % 3 WHEN 0 THEN '电子解析+AI视觉' WHEN 1 THEN 'paper' ELSE '—' END AS evidence, CASE WHEN again THEN '已复核' ELSE '' END AS repaired,
       CASE WHEN bad THEN '—' WHEN match THEN '✓' ELSE '✗' END AS check_declared, CASE WHEN bad THEN '❌ page ' || repeat('x', 55) ELSE '✅' END AS status,
       CASE WHEN bad THEN 'error' WHEN NOT match THEN 'failed' WHEN again THEN 'repaired' ELSE 'ok' END AS row_status FROM c"""
)
def summary_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary sheet of orders as records: checks, evidence, repairs and errors."""
    k = F.col("o_orderkey")
    orders = materialise(_orders(spark, sf_dir), "order-records")
    sums = validate.sums_of_rows(F.col("lines"), "amount")["total"]
    records = orders.select(
        F.col("o_custkey").alias("filename"), k.alias("group_no"), k.cast("string").alias("pages"), F.when(k % 2 == 0, sums).otherwise(F.col("o_totalprice").cast("decimal(30,2)")).cast("double").alias("declared"),
        F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False).alias("closed"), "lines", F.when(k % 3 == 0, "low").alias("confidence"), F.when(k % 3 == 0, "native_text+vision").when(k % 3 == 1, "paper").otherwise("").alias("evidence"),
        (k % 5 == 0).alias("repaired"), F.when(k % 11 == 0, "page " + "x" * 90).alias("error"), (k % 11 == 0).alias("is_error"),
    )
    specs = normalize_fields([ORDER_SPECS[0], {"key": "closed", "type": "checkbox"}, ORDER_SPECS[1]])
    validations = validate.sum_checks(records, specs, ["filename", "group_no", "pages"])
    return outputs.summary(records, specs, validations).withColumn("declared", F.col("declared").cast("double"))


@query(
    """SELECT l_orderkey AS o_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS INTEGER) AS row_no,
       CASE WHEN l_partkey % 4 <> 3 THEN l_partkey::VARCHAR END AS part, l_suppkey::VARCHAR AS supplier, CASE WHEN l_partkey % 2 = 0 THEN l_linenumber::VARCHAR END AS line FROM lineitem"""
)
def extra_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as maps: a cell under its key, its label, with white space, or empty under one and full under the other;
    undeclared cells become columns."""
    p = F.col("l_partkey")
    lines = order_lines(spark, sf_dir, "l_suppkey", "l_linenumber")
    text = lambda c: F.col(c).cast("string")
    part = F.when(p % 4 == 0, F.create_map(F.lit("part"), text("l_partkey"))).when(p % 4 == 1, F.create_map(F.lit(" 零件 "), text("l_partkey"))).when(p % 4 == 2, F.create_map(F.lit("part"), F.lit(""), F.lit("零件"), text("l_partkey"))).otherwise(F.create_map(F.lit("part"), F.lit("")))
    row = F.map_concat(part, F.create_map(F.lit("supplier"), text("l_suppkey")), F.when(p % 2 == 0, F.create_map(F.lit("line"), text("l_linenumber"))).otherwise(F.create_map().cast("map<string,string>")))
    specs = normalize_fields([{"key": "rows", "type": "table", "description": "列：part 零件"}])
    pages = lines.select("filename", "page", F.array(row, F.lit(None).cast("map<string,string>"), F.create_map().cast("map<string,string>")).alias("rows"))
    found = materialise(flatten.details(fold.fold(pages, specs, ["filename"]), ["filename"], ["rows"]), "details")
    return flatten.widened(found, sorted(flatten.extra_columns(found, ["filename", "row_no"]))).drop("table").withColumnRenamed("filename", "o_orderkey")


@query(
    """WITH l AS (SELECT l_orderkey AS k, count(*) AS n, sum(l_partkey) AS parts FROM lineitem GROUP BY 1)
SELECT o_orderkey, o_orderstatus AS state, coalesce(n, 0) AS n_rows, coalesce(parts, 0) AS parts FROM orders LEFT JOIN l ON k = o_orderkey"""
)
def result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows as JSON lines, read back."""
    records = _orders(spark, sf_dir).withColumnRenamed("o_orderstatus", "state").withColumn("_source_file", F.lit("x"))
    specs = normalize_fields([{"key": "state"}, ORDER_SPECS[1]])
    lines = outputs.json_lines(outputs.result_rows(records, specs, ["o_orderkey", "_source_file"]))
    back = lines.select(F.from_json("json", "o_orderkey long, state string, _source_file string, _tables struct<lines:array<struct<l_partkey:long>>>").alias("r")).select("r.*")
    parts = F.aggregate("_tables.lines", F.lit(0).cast("long"), lambda s, x: s + x["l_partkey"])
    return back.select("o_orderkey", "state", F.size("_tables.lines").cast("long").alias("n_rows"), parts.alias("parts"))


# --- cross-layout documents ----------------------------------------------------------------------------------------

#: A customer's orders as pages: numbers on some, continuations, anchors on the pages of every fifth customer, errors.
_PAGES = """x AS (SELECT o_custkey AS f, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p, o_orderkey AS k, o_orderstatus AS ty, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 5)::VARCHAR END AS no,
  o_orderkey % 2 = 1 AS cont, o_orderkey % 13 = 0 AS bad, o_orderpriority AS v, CASE o_orderkey % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE '' END AS c, o_totalprice AS price FROM orders),
y AS (SELECT *, CASE WHEN f % 5 = 0 THEN p - p % 2 + 1 END AS a FROM x),
w AS (SELECT f, p, ty, no, cont, min(p) OVER (PARTITION BY f, ty, no) AS same, lag(p) OVER (PARTITION BY f, ty ORDER BY p) AS before FROM y WHERE NOT bad AND a IS NULL),
t AS (SELECT f, p, CASE WHEN no IS NOT NULL AND same < p THEN same WHEN cont AND before IS NOT NULL THEN before ELSE p END AS parent FROM w)"""
_DOCUMENTS = (
    ROOTS.replace("SELECT f AS filename, p AS page, parent AS root FROM r WHERE parent = node", ", q AS (SELECT f, p, parent AS root FROM r WHERE parent = node)")
    + """,
z AS (SELECT y.*, CASE WHEN bad THEN 0 WHEN a IS NOT NULL THEN 1 ELSE 2 END AS how, CASE WHEN bad THEN y.p WHEN a IS NOT NULL THEN a ELSE q.root END AS key FROM y LEFT JOIN q ON q.f = y.f AND q.p = y.p),
h AS (SELECT f, how, key, min(p) AS first FROM z GROUP BY f, how, key), n AS (SELECT *, row_number() OVER (ORDER BY f, first) AS k FROM h),
d AS (SELECT z.f, z.p, z.ty, z.no, z.bad, z.v, z.c, z.price, z.k AS o, 'doc_' || CASE WHEN n.k < 10000 THEN lpad(n.k::VARCHAR, 4, '0') ELSE n.k::VARCHAR END AS id FROM z JOIN n ON n.f = z.f AND n.how = z.how AND n.key = z.key),
g AS (SELECT id, v, min(p) AS o, max((CASE c WHEN 'high' THEN 2 WHEN 'medium' THEN 1 WHEN 'low' THEN 0 ELSE -1 END) * 100000 - p) AS rank FROM (SELECT * FROM d WHERE v <> '') GROUP BY id, v),
b AS (SELECT id, arg_max(v, rank) AS priority, count(*) AS kinds, string_agg(v, ' / ' ORDER BY o) FILTER (WHERE place <= 5) AS listed FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o) AS place FROM g) GROUP BY id)"""
)


def _common_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[FieldSpec]]:
    from pyspark.sql import Window

    k = F.col("o_orderkey")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = table(spark, sf_dir, "orders").withColumn("page", place)
    confidence = F.when(k % 4 == 0, "high").when(k % 4 == 1, "medium").when(k % 4 == 2, "low").otherwise("")
    meta = F.struct(F.lit("Priority").alias("source_label"), k.cast("string").alias("evidence"), confidence.alias("confidence"), F.lit(None).cast("string").alias("status"))
    pages = rows.select(
        F.col("o_custkey").alias("filename"), "page", F.col("o_orderstatus").alias("document_type"), F.when(k % 3 == 0, (k % 5).cast("string")).alias("document_no"), (k % 2 == 1).alias("continues"),
        F.when(k % 13 == 0, "unreadable").alias("error"), F.when(F.col("o_custkey") % 5 == 0, F.col("page") - F.col("page") % 2 + 1).alias("anchor"), F.when(k % 7 == 0, "low").otherwise("high").alias("segment_confidence"), F.when(k % 7 == 0, "weak").otherwise("").alias("segment_reason"),
        confidence.alias("confidence"), F.col("o_orderpriority").alias("priority"), F.array(F.struct(F.col("o_totalprice").alias("price"))).alias("prices"), F.create_map(F.lit("priority"), meta).alias("field_meta"),
    )
    specs = normalize_common_fields([{"key": "priority", "label": "Priority"}, {"key": "prices", "label": "Prices", "type": "table", "columns": [{"key": "price", "type": "number"}]}])
    return pages, specs


@query(
    f"""WITH RECURSIVE {_PAGES}{_DOCUMENTS},
e AS (SELECT id, any_value(f) AS f, string_agg(p::VARCHAR, '+' ORDER BY p) AS pages, arg_min(ty, p) AS ty, arg_min(no, p) FILTER (WHERE no IS NOT NULL) AS no, bool_or(bad) AS bad, count(*) AS n_prices,
      min(CASE c WHEN 'high' THEN 2 WHEN 'medium' THEN 1 WHEN 'low' THEN 0 END) AS r, bool_or(o % 7 = 0) AS weak FROM d GROUP BY id)
SELECT e.id AS document_id, f::VARCHAR AS filename, pages, ty AS document_type, coalesce(no, '') AS document_no, priority, n_prices || '行' AS prices, CASE r WHEN 2 THEN 'high' WHEN 1 THEN 'medium' WHEN 0 THEN 'low' ELSE '' END AS confidence,
       CASE WHEN weak THEN 'low' ELSE 'high' END AS segmentation_confidence, CASE WHEN bad THEN '失败' WHEN kinds > 1 OR weak THEN '待复核' ELSE '完成' END AS status
FROM e JOIN b ON b.id = e.id"""
)
def common_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as pages, to documents by anchors, numbers and continuations, with one value a field."""
    pages, specs = _common_pages(spark, sf_dir)
    return outputs.document_summary(common.assemble(pages, specs).records, specs)


@query(
    f"""WITH RECURSIVE {_PAGES}{_DOCUMENTS},
e AS (SELECT id, bool_or(bad) AS bad, bool_or(o % 7 = 0) AS weak FROM d GROUP BY id)
SELECT id AS document_id, '' AS field, 'unreadable' AS message FROM e WHERE bad
UNION ALL SELECT id, '文档边界', 'weak' FROM e WHERE NOT bad AND weak
UNION ALL SELECT e.id, 'Priority', '多页候选值冲突：' || listed FROM e JOIN b ON b.id = e.id WHERE NOT bad AND kinds > 1"""
)
def common_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, specs = _common_pages(spark, sf_dir)
    return common.assemble(pages, specs).issues


@query(
    f"""WITH RECURSIVE {_PAGES}{_DOCUMENTS},
e AS (SELECT d.id, any_value(f) AS f, string_agg(p::VARCHAR, '+' ORDER BY p) AS pages, arg_min(ty, p) AS ty, bool_or(bad) AS bad, count(*) AS n FROM d GROUP BY d.id),
m AS (SELECT id, max((CASE c WHEN 'high' THEN 2 WHEN 'medium' THEN 1 WHEN 'low' THEN 0 ELSE -1 END) * 100000 - p) AS rank FROM d WHERE v <> '' GROUP BY id),
s AS (SELECT d.* FROM d JOIN m ON m.id = d.id AND (CASE c WHEN 'high' THEN 2 WHEN 'medium' THEN 1 WHEN 'low' THEN 0 ELSE -1 END) * 100000 - p = rank)
SELECT e.id AS document_id, e.f::VARCHAR AS filename, pages, e.ty AS document_type, 'Priority' AS field, priority AS value, CASE WHEN e.bad THEN '' ELSE 'Priority' END AS source_label, CASE WHEN e.bad THEN '' ELSE s.o::VARCHAR END AS said,
       CASE WHEN e.bad THEN '' ELSE s.c END AS confidence, CASE WHEN e.bad THEN '' WHEN kinds > 1 THEN 'ambiguous' ELSE 'found' END AS status, CASE WHEN e.bad THEN '' ELSE s.p::VARCHAR END AS source_page FROM e JOIN b ON b.id = e.id JOIN s ON s.id = e.id
UNION ALL SELECT id, f::VARCHAR, pages, ty, 'Prices', n || '行', '', '', '', CASE WHEN bad THEN '' ELSE 'found' END, CASE WHEN bad THEN '' ELSE pages END FROM e"""
)
def common_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document's value of each field comes from."""
    pages, specs = _common_pages(spark, sf_dir)
    return outputs.field_evidence(common.assemble(pages, specs).records, specs)


# --- splitting -----------------------------------------------------------------------------------------------------


@query(
    f"""WITH RECURSIVE x AS (SELECT f, p, event_type AS ty, event_id % 3 AS sig, CASE WHEN event_id % 2 = 0 AND event_type <> 'signup' THEN p - 1 - event_id % 5 END AS a FROM ({EVENTS})),
t AS (SELECT x.f, x.p, coalesce(k.p, x.p) AS parent FROM x LEFT JOIN x k ON k.f = x.f AND k.p = x.a AND k.ty = x.ty){ROOTS.replace("SELECT f AS filename, p AS page, parent AS root FROM r WHERE parent = node", ", q AS (SELECT f, p, parent AS root FROM r WHERE parent = node)")},
s AS (SELECT x.f, x.p, x.ty, h.sig FROM x JOIN q ON q.f = x.f AND q.p = x.p JOIN x h ON h.f = q.f AND h.p = q.root),
o AS (SELECT ty, sig, min((f, p)) AS pos FROM s GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY ty ORDER BY pos) AS variant, count(*) OVER (PARTITION BY ty) AS m FROM o)
SELECT s.f AS filename, s.p AS page, variant, CASE WHEN m > 1 THEN s.ty || '·版式0' || variant ELSE s.ty END AS split_type FROM s JOIN n ON n.ty = s.ty AND n.sig = s.sig"""
)
def inherited_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format variants where continuations have the format of their anchor's chain."""
    pages = event_pages(spark, sf_dir).withColumnRenamed("event_type", "document_type")
    continues = (F.col("event_id") % 2 == 0) & (F.col("document_type") != "signup")
    found = split.format_variants(pages, (F.col("event_id") % 3).cast("string"), continues=continues, anchor=F.col("page") - 1 - F.col("event_id") % 5)
    return found.select("filename", F.col("page").cast("long").alias("page"), "variant", "split_type")


_TYPED = "x AS (SELECT conv_id AS f, turn AS p, CASE WHEN role = 'assistant' THEN 'Reply / note' ELSE role END AS ty, turn - turn % 2 AS a, CASE WHEN turn % 3 = 1 THEN conv_id::VARCHAR END AS no FROM conversations)"


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("role") == "assistant", "Reply / note").otherwise(F.col("role"))
    p = F.col("page")
    return turn_pages(spark, sf_dir).drop("text").withColumn("document_type", kind).withColumn("anchor", p - p % 2).withColumn("document_no", F.when(p % 3 == 1, F.col("filename").cast("string"))).withColumn("fallback", p % 4 == 0)


@query(
    f"""WITH {_TYPED}
SELECT regexp_replace(lower(ty), '[^a-z]', '', 'g') AS type_key, arg_min(ty, (f, p)) AS document_type, replace(arg_min(ty, (f, p)), ' / ', '_') || '_job_7' AS file_name, count(*) AS page_count,
       count(DISTINCT (f, a)) AS logical_documents, count(*) FILTER (WHERE p % 4 = 0) AS fallback_pages, count(DISTINCT f) AS source_files FROM x GROUP BY ty"""
)
def type_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages saved by type, and their manifest as it was written."""
    return split.save_types(_typed(spark, sf_dir), new_path(spark, "types"), "job 7", fallback="fallback")


@query(
    f"""WITH {_TYPED}
SELECT regexp_replace(lower(ty), '[^a-z]', '', 'g') AS type_key, f AS filename, a AS anchor, string_agg(p::VARCHAR, '+' ORDER BY p) AS pages, arg_min(no, p) FILTER (WHERE no IS NOT NULL) AS document_no FROM x GROUP BY ty, f, a"""
)
def type_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.segments(_typed(spark, sf_dir), "document_type", "anchor", "document_no").withColumn("pages", F.array_join(F.col("pages").cast("array<string>"), "+"))


# --- boxes and models ----------------------------------------------------------------------------------------------


@query(
    f"""WITH a AS ({EVENTS}), x AS (SELECT f, p // 10 AS pg, p % 10 AS line, event_type AS word, event_id, 60 + event_id % 3 * 5 - length(event_type) * 9 AS gap FROM a),
l AS (SELECT f, pg, line, word || CASE WHEN gap > 20 THEN '   ' WHEN gap > 8 THEN '  ' ELSE ' ' END || event_id AS t FROM x)
SELECT f AS filename, pg AS page, string_agg(t, chr(10) ORDER BY line) AS text FROM l GROUP BY f, pg"""
)
def ocr_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten events as the lines of a page, of two boxes each: the second stands a little lower."""
    e = event_pages(spark, sf_dir)
    top = (F.col("page") % 10) * 20
    box = lambda left, down, text: F.struct(left.cast("double").alias("left"), (top + down).cast("double").alias("top"), (top + down + 10).cast("double").alias("bottom"), text.alias("text"))
    rows = e.select("filename", F.floor(F.col("page") / 10).alias("page"), F.inline(F.array(box(60 + F.col("event_id") % 3 * 5, 3, F.col("event_id").cast("string")), box(F.lit(0), 0, F.col("event_type")))))
    return boxes.page_texts(rows)


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 9 THEN o_orderstatus END AS state, CASE WHEN o_orderkey % 10 <> 9 AND o_orderkey % 7 <> 0 THEN o_totalprice END AS total, CASE WHEN o_orderkey % 10 <> 9 AND o_orderkey % 7 = 0 THEN 'about ' || o_totalprice::DECIMAL(18,2) END AS total_raw,
       CASE WHEN o_orderkey % 10 = 9 THEN 0 ELSE CAST(1 + o_orderkey % 3 AS INTEGER) END AS n_rows, CASE WHEN o_orderkey % 10 = 9 THEN 'failed' WHEN o_orderkey % 2 = 0 THEN 'native_text' ELSE 'ocr_text' END AS evidence,
       CASE WHEN o_orderkey % 10 = 9 THEN 'the model is out of order' END AS error FROM orders"""
)
def model_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages read by a stand-in for a model that cannot see, is not always reached, and answers badly or cut off at first;
    it never answers to one page in ten."""
    k, o = F.col("o_orderkey"), table(spark, sf_dir, "orders")
    money = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    text = F.concat(F.lit("page: "), k.cast("string"), F.lit("\nstate: "), F.col("o_orderstatus"), F.lit("\ntotal: "), F.when(k % 7 == 0, F.concat(F.lit("about "), money)).otherwise(money), F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), k % 3), lambda i: F.concat(F.lit("\nrows: "), i.cast("string"))), ""))
    pages = o.select(k.alias("o_orderkey"), F.when(k % 2 == 0, "native").otherwise("scanned").alias("kind"), F.when(k % 2 == 0, text).alias("text"), F.when(k % 2 == 1, text).alias("hint"))
    specs = normalize_fields([{"key": "state"}, {"key": "total", "type": "number"}, {"key": "rows", "type": "table", "description": "列：cell 格"}])
    maker = doubles.Reader(bad_json=frozenset({1, 4}), cut_off=frozenset({2, 5}), unreachable=frozenset({3, 6}), broken=frozenset({9}), blind=True)
    found = materialise(model.model_extractor(maker, vision=True, sleep=_no_wait)(pages, specs), "model-answers")
    return found.select("o_orderkey", "state", "total", "total_raw", F.size("rows").alias("n_rows"), "evidence", "error")


def _no_wait(seconds: float) -> None:
    """Queries over stand-ins do not wait."""


@query(
    """WITH x AS (SELECT conv_id AS f, turn AS p, role FROM conversations), y AS (SELECT *, f % 6 = 0 AS off, p % 5 = 0 AS never FROM x)
SELECT f AS filename, p AS page, CASE WHEN off OR never THEN '未知文档' ELSE role END AS document_type, CASE WHEN off OR never THEN 'unknown' WHEN p % 2 = 1 THEN 'continuation' ELSE 'first' END AS page_role,
       CASE WHEN off OR never THEN p WHEN EXISTS (SELECT 1 FROM x WHERE x.f = y.f AND x.p = y.p - y.p % 2) THEN p - p % 2 ELSE p END AS anchor_page, CASE WHEN off OR never THEN 'low' ELSE 'high' END AS confidence,
       CASE WHEN off THEN 'network' WHEN never THEN 'model' ELSE 'none' END AS fallback FROM y"""
)
def classify_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns classified in batches by a stand-in that leaves pages out of long answers (they are asked for alone), never
    answers to some, and is not reached for every sixth conversation."""
    turns = turn_pages(spark, sf_dir).select("filename", F.col("page").cast("long").alias("page"), F.concat(F.col("role"), F.lit(" "), F.coalesce("text", F.lit(""))).alias("text"))
    last = turns.agg(F.max("filename")).first()[0] or 0
    maker = doubles.Sorter(frozenset(str(i) for i in range(0, last + 1, 6)), never=5)
    found = materialise(model.classify_pages(turns, maker, sleep=_no_wait), "classified")
    network = F.col("reason").startswith(model.NETWORK_FALLBACK)
    return found.select("filename", "page", "document_type", "page_role", "anchor_page", "confidence", F.when(network, "network").when(F.col("classify_error").isNotNull(), "model").otherwise("none").alias("fallback"))


def _merge(schemas: list[dict]) -> dict:
    """A stand-in for a model that merges schemas: labels with their counts."""
    out: dict[str, int] = {}
    for s in schemas:
        for label, n in s.items():
            out[label] = out.get(label, 0) + n
    return out


@query(
    """SELECT o_orderpriority AS type_key, count(*) AS sampled, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS dates, count(*) FILTER (WHERE o_orderkey % 2 = 0) AS totals FROM orders GROUP BY 1"""
)
def schema_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was observed on pages, merged to a schema of each type: in batches, then the partial schemas."""
    k = F.col("o_orderkey")
    seen = F.concat(F.lit('{"no": 1'), F.when(k % 3 == 0, ', "date": 1').otherwise(""), F.when(k % 2 == 0, ', "total": 1').otherwise(""), F.lit("}"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("type_key"), k.alias("place"), seen.alias("inventory"))
    found = model.consolidated(rows, _merge)
    n = lambda c: F.coalesce(F.get_json_object("schema", f"$.{c}").cast("long"), F.lit(0))
    return found.select("type_key", "sampled", n("date").alias("dates"), n("total").alias("totals"))


@query(
    """WITH x AS (SELECT event_id AS id, event_id % 4 AS m, event_type AS ty, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
SELECT id AS event_id, CASE WHEN m = 3 THEN '未知' ELSE ty END AS document_type, CASE WHEN m = 0 THEN k::VARCHAR END AS document_no, CASE m WHEN 0 THEN 'first' WHEN 1 THEN 'continuation' ELSE 'unknown' END AS page_role, m = 1 AS continues,
       CAST(CASE m WHEN 0 THEN 8 WHEN 1 THEN 1 ELSE 0 END AS INTEGER) AS n_hints, CASE WHEN m = 0 THEN 80 ELSE 0 END AS label_chars, CASE m WHEN 0 THEN 'high' ELSE '' END AS confidence FROM x"""
)
def observed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model observed on pages, as their types, numbers, roles and identity hints."""
    m, ty = F.col("event_id") % 4, F.col("event_type")
    hint = F.lit(json.dumps({"label": "x" * 100, "value": "v", "role": None}))
    many = F.concat(F.lit("["), F.array_join(F.array_repeat(hint, 12), ","), F.lit("]"))
    body = (
        F.when(m == 0, F.concat(F.lit('{"document_type": " '), ty, F.lit(' ", "document_no": '), F.get_json_object("props", "$.k"), F.lit(', "page_role": "first", "confidence": "high", "identity_hints": '), many, F.lit("}")))
        .when(m == 1, F.concat(F.lit('{"document_type": "'), ty, F.lit('", "document_no": "null", "page_role": "continuation", "confidence": "sure", "identity_hints": [{"value": ""}, {"value": "a"}]}')))
        .when(m == 2, F.concat(F.lit('{"document_type": "'), ty, F.lit('", "page_role": "middle"}'))).otherwise("not read")
    )
    found = model.observed_pages(table(spark, sf_dir, "events").select("event_id", "event_type", "props").withColumn("inventory", body))
    label = F.coalesce(F.length(F.try_element_at("identity_hints", F.lit(1))["label"]), F.lit(0))
    return found.select("event_id", "document_type", "document_no", "page_role", "continues", F.size("identity_hints").alias("n_hints"), label.alias("label_chars"), "confidence")

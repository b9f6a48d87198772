"""Queries over the driver's tables, one for each operator or family of operators, and DuckDB SQL beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import payload, texts, values
from ..operators import discover, evidence, extract, flatten, fold, grouping, mixed, sample, split, validate
from ..sources.tables import document_pages, event_pages, order_lines, table, turn_pages
from ..specs import normalize_fields
from ..storage import materialise
from .registry import QUERIES, SQL, query

__all__ = ["QUERIES", "SQL", "flagship"]

EVENTS = "SELECT user_id AS f, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p, event_id, event_type, value, props FROM events"
# the chain: x has f, p, gid (null for none) and cont
CHAIN = """, e AS (SELECT *, CASE WHEN gid IS NOT NULL THEN gid WHEN NOT cont THEN '' END AS ev FROM x),
l AS (SELECT *, last_value(ev IGNORE NULLS) OVER (PARTITION BY f ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev,
             row_number() OVER (PARTITION BY f ORDER BY p) AS rn FROM e),
g AS (SELECT *, sum(CASE WHEN rn = 1 THEN 1 WHEN gid IS NOT NULL THEN (gid IS DISTINCT FROM prev)::INT ELSE (NOT cont)::INT END)
                OVER (PARTITION BY f ORDER BY p ROWS UNBOUNDED PRECEDING) AS group_no FROM l)"""


@query(
    f"""WITH x AS (SELECT *, CASE WHEN event_type IN ('purchase', 'signup') THEN event_type END AS gid, event_type IN ('view', 'error') AS cont FROM ({EVENTS}))
{CHAIN}
SELECT f AS user_id, CAST(group_no AS BIGINT) AS group_no, count(*) AS n_pages, string_agg(p::VARCHAR, '+' ORDER BY p) AS pages,
       arg_min(value, p) AS first_value, arg_max(value, p) AS last_value FROM g GROUP BY f, group_no"""
)
def chain_merge_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = event_pages(spark, sf_dir)
    key = F.when(F.col("event_type").isin("purchase", "signup"), F.col("event_type"))
    rows = grouping.chain(pages, key, F.col("event_type").isin("view", "error")).withColumn("first_value", F.col("value")).withColumn("last_value", F.col("value"))
    specs = normalize_fields([{"key": "first_value", "type": "number"}, {"key": "last_value", "type": "number", "carry": "last"}])
    return fold.fold(rows, specs, ["filename", "group_no"]).select(F.col("filename").alias("user_id"), "group_no", "n_pages", "pages", "first_value", "last_value")


@query(
    f"""WITH x AS (SELECT conv_id AS f, turn AS p, NULL::VARCHAR AS gid, role = 'assistant' AS cont, role, coalesce(text, '') AS text FROM conversations)
{CHAIN}
SELECT f AS conv_id, CAST(group_no AS BIGINT) AS group_no, string_agg(p::VARCHAR, '+' ORDER BY p) AS pages, count(*) AS n_pages,
       string_agg(role, '+' ORDER BY p) AS roles, md5(string_agg(text, chr(10) ORDER BY p)) AS text_md5 FROM g GROUP BY f, group_no"""
)
def chain_merge_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grouping.chain(turn_pages(spark, sf_dir), None, F.col("role") == "assistant")
    of = lambda c: fold.ordered(c, F.col("page"))
    return rows.groupBy(F.col("filename").alias("conv_id"), "group_no").agg(
        fold.page_list().alias("pages"), F.count("*").alias("n_pages"), F.array_join(of(F.col("role")), "+").alias("roles"), F.md5(F.array_join(of(F.coalesce("text", F.lit(""))), "\n")).alias("text_md5")
    )


@query(
    f"""WITH a AS ({EVENTS}), x AS (SELECT *, NULL::VARCHAR AS gid, event_type = 'view' AS cont FROM a WHERE event_type <> 'error')
{CHAIN}
SELECT f AS user_id, 'record' AS kind, min(p) AS first_page, max(p) AS last_page, count(*) AS n_pages FROM g GROUP BY f, group_no
UNION ALL SELECT f, 'error', p, p, 1 FROM a WHERE event_type = 'error'"""
)
def error_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = event_pages(spark, sf_dir)
    rows = grouping.with_errors(pages, F.col("event_type") == "error", lambda p: grouping.chain(p, None, F.col("event_type") == "view"))
    own = rows.withColumn("group", F.coalesce("group_no", -F.col("page").cast("long")))
    folded = own.groupBy("filename", "group", "is_error").agg(F.min("page").cast("long").alias("first_page"), F.max("page").cast("long").alias("last_page"), F.count("*").alias("n_pages"))
    return folded.select(F.col("filename").alias("user_id"), F.when(F.col("is_error"), "error").otherwise("record").alias("kind"), "first_page", "last_page", "n_pages")


CONFIDENCE_SQL = "CASE WHEN toxic = 1 THEN 'low' WHEN quality = 1 THEN 'high' WHEN quality = 0 THEN 'medium' END"


def _confidence():
    return F.when(F.col("toxic") == 1, "low").when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "medium")


@query(
    f"""WITH x AS (SELECT source, lang, d.doc_id, {CONFIDENCE_SQL} AS c FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
f AS (SELECT source, lang, min(doc_id) AS o FROM x WHERE lang <> '' GROUP BY source, lang),
e AS (SELECT source, string_agg(lang, '+' ORDER BY o) AS evidence FROM f GROUP BY source),
m AS (SELECT source, min(CASE c WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 END) AS r, count(*) AS n_pages FROM x GROUP BY source)
SELECT m.source, evidence, CASE r WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE '' END AS confidence, n_pages FROM m LEFT JOIN e ON m.source = e.source"""
)
def fold_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left").withColumn("confidence", _confidence())
    kinds = fold.distinct_in_order(rows, ["source"], "lang", "doc_id", "evidence")
    return rows.groupBy("source").agg(values.min_conf(F.col("confidence")).alias("confidence"), F.count("*").alias("n_pages")).join(kinds, "source", "left")


# amounts of five decimals: an order declares the rounded sum, the sum of rounded amounts, or something else
DECLARED_SQL = """t AS (SELECT l_orderkey AS k, round(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * 0.335), 2) AS total, sum(round(CAST(l_extendedprice AS DECIMAL(18,2)) * 0.335, 2)) AS rounded, count(*) AS n FROM lineitem GROUP BY 1),
o AS (SELECT o_orderkey, o_custkey, coalesce(n, 0) AS n_rows, coalesce(total, 0) AS total,
             CASE o_orderkey % 4 WHEN 0 THEN coalesce(total, 0) WHEN 1 THEN rounded ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS declared
      FROM orders LEFT JOIN t ON k = o_orderkey),
v AS (SELECT *, declared - total AS diff, n_rows > 0 AND coalesce(abs(declared - total) < 0.011, false) AS match FROM o)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    exact = F.col("l_extendedprice").cast("decimal(18,2)") * F.lit("0.335").cast("decimal(4,3)")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), exact.alias("amount"))


def _declared(spark: SparkSession, sf_dir: str, lines: DataFrame) -> DataFrame:
    """Orders, checked against their lines' amounts."""
    own = lines.groupBy("o_orderkey").agg(F.round(F.sum("amount"), 2).alias("exact"), F.sum(F.round("amount", 2)).alias("rounded"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice").join(own, "o_orderkey", "left")
    kind = F.col("o_orderkey") % 4
    declared = F.when(kind == 0, F.coalesce("exact", F.lit(0))).when(kind == 1, F.col("rounded")).otherwise(values.to_money(F.col("o_totalprice")))
    return validate.check_lines(orders.select("o_orderkey", "o_custkey", declared.cast("decimal(30,2)").alias("declared")), lines, ["o_orderkey"], "declared", "amount")


@query(f"WITH {DECLARED_SQL} SELECT o_orderkey, n_rows, CAST(total AS DOUBLE) AS sum_from_table, CAST(declared AS DOUBLE) AS declared, CAST(diff AS DOUBLE) AS diff, match FROM v")
def sum_check_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _declared(spark, sf_dir, _lines(spark, sf_dir))
    return found.select("o_orderkey", "n_rows", *[F.col(c).cast("double").alias(c) for c in ("sum_from_table", "declared", "diff")], "match")


@query(
    f"""WITH {DECLARED_SQL},
r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM v WHERE NOT match)
SELECT v.o_custkey, v.o_orderkey, r.n IS NOT NULL AS repaired, CAST(CASE WHEN r.n IS NOT NULL THEN total + v.o_orderkey % 3 ELSE declared END AS DOUBLE) AS declared
FROM v LEFT JOIN r ON r.o_custkey = v.o_custkey AND r.o_orderkey = v.o_orderkey AND r.n <= 6"""
)
def repair_splice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders are a job; the first failing ones are repaired one to three times, and the last repair counts."""
    records = materialise(_declared(spark, sf_dir, _lines(spark, sf_dir)), "orders")
    failing = validate.to_repair(records, ["o_custkey"], ["o_orderkey"])
    again = records.join(failing, ["o_custkey", "o_orderkey"], "left_semi").select("o_custkey", "o_orderkey", "sum_from_table", F.explode(F.sequence(F.lit(0).cast("long"), F.col("o_orderkey") % 3)).alias("attempt"))
    fixed = again.select("o_custkey", "o_orderkey", (F.col("sum_from_table") + F.col("attempt")).cast("decimal(30,2)").alias("declared"), "attempt")
    pages = records.select("o_custkey", "o_orderkey", "declared")
    return validate.splice(pages, fixed, ["o_custkey", "o_orderkey"], "attempt").withColumn("declared", F.col("declared").cast("double"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their lines as a table field."""
    rows = order_lines(spark, sf_dir).groupBy(F.col("filename").alias("o_orderkey")).agg(fold.ordered(F.struct(F.col("l_partkey"), F.col("l_quantity"), F.col("amount")), F.col("page")).alias("lines"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    return orders.join(rows, "o_orderkey", "left")


ORDER_SPECS = [
    {"key": "declared", "label": "Total", "type": "number", "carry": "last", "sum_check": {"table": "Lines", "column": "amount"}},
    {"key": "lines", "label": "Lines", "type": "table", "description": "列：l_partkey part, l_quantity quantity, amount amount"},
]


@query(
    """SELECT l_orderkey AS o_orderkey, 'lines' AS "table", CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS INTEGER) AS row_no,
       l_partkey, l_quantity, l_extendedprice AS amount FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)"""
)
def detail_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = flatten.details(_orders(spark, sf_dir), ["o_orderkey"], ["lines"])
    return found.withColumn("amount", F.col("amount").cast("double"))


@query(
    """WITH u AS (SELECT c_custkey AS k, unnest(['c_name', 'c_mktsegment', 'c_nationkey']) AS field, unnest([c_name, c_mktsegment, c_nationkey::VARCHAR]) AS value FROM customer)
SELECT k AS c_custkey, field, value, CASE WHEN coalesce(value, '') = '' THEN 'not_found' ELSE 'found' END AS status FROM u"""
)
def evidence_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten.field_values(table(spark, sf_dir, "customer"), ["c_custkey"], ["c_name", "c_mktsegment", "c_nationkey"])


@query(
    r"""WITH c AS (SELECT o_custkey AS k, o_orderkey AS p, o_orderpriority AS v, CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 ELSE 0 END AS r,
       regexp_replace(lower(o_orderpriority), '[^0-9a-z\x{4e00}-\x{9fff}]+', '', 'g') AS vk FROM orders WHERE o_orderpriority <> ''),
w AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY r DESC, p) AS n FROM c),
d AS (SELECT k, vk, min(p) AS o, arg_min(v, p) AS v FROM c GROUP BY k, vk),
l AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY o) AS n, count(*) OVER (PARTITION BY k) AS m FROM d),
s AS (SELECT k, any_value(m) AS m, string_agg(v, ' / ' ORDER BY o) FILTER (WHERE n <= 5) AS listed FROM l GROUP BY k)
SELECT w.k AS o_custkey, w.v AS chosen, CASE w.r WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS chosen_confidence, w.p AS source_page,
       CASE WHEN m > 1 THEN 'ambiguous' ELSE 'found' END AS status, CASE WHEN m > 1 THEN listed ELSE '' END AS conflict
FROM w JOIN s ON s.k = w.k WHERE w.n = 1"""
)
def conflict_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", F.when(F.col("o_orderstatus") == "F", "high").when(F.col("o_orderstatus") == "O", "medium").otherwise("low").alias("confidence"))
    found = fold.choose(rows, ["o_custkey"], "o_orderpriority", "confidence", "o_orderkey")
    return found.withColumn("conflict", F.array_join("conflict", " / "))


# t: f, p, parent; the root of every page by following parents
ROOTS = """, r AS (SELECT f, p, parent, p AS node FROM t UNION ALL SELECT r.f, r.p, t.parent, t.p FROM r JOIN t ON t.f = r.f AND t.p = r.parent WHERE r.parent <> r.node)
SELECT f AS filename, p AS page, parent AS root FROM r WHERE parent = node"""


@query(
    f"""WITH RECURSIVE x AS (SELECT f, p, event_type AS ty, CASE WHEN event_type IN ('purchase', 'signup') THEN (event_id % 7)::VARCHAR END AS no, event_type IN ('view', 'error') AS cont FROM ({EVENTS})),
w AS (SELECT *, min(p) OVER (PARTITION BY f, ty, no) AS same, lag(p) OVER (PARTITION BY f, ty ORDER BY p) AS before FROM x),
t AS (SELECT f, p, CASE WHEN no IS NOT NULL AND same < p THEN same WHEN cont AND before IS NOT NULL THEN before ELSE p END AS parent FROM w)
{ROOTS}"""
)
def explicit_number_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.when(F.col("event_type").isin("purchase", "signup"), (F.col("event_id") % 7).cast("string"))
    pages = materialise(event_pages(spark, sf_dir), "event-pages")
    return grouping.number_groups(pages, F.col("event_type"), number, F.col("event_type").isin("view", "error")).select("filename", F.col("page").cast("long").alias("page"), F.col("root").cast("long").alias("root"))


@query(
    f"""WITH RECURSIVE x AS (SELECT f, p, event_type AS ty, CASE WHEN event_type = 'purchase' THEN (event_id % 5)::VARCHAR END AS no,
       event_type IN ('view', 'error') AS go, CASE WHEN event_id % 4 = 0 THEN p - 1 - event_id % 3 END AS a FROM ({EVENTS})),
w AS (SELECT x.*, lag(x.p) OVER (PARTITION BY x.f, x.ty, x.no ORDER BY x.p) AS numbered,
             last_value(CASE WHEN NOT go THEN x.p END IGNORE NULLS) OVER b AS head, first_value(x.p) OVER b AS top, k.p IS NOT NULL AS known
      FROM x LEFT JOIN (SELECT f, p FROM x) k ON k.f = x.f AND k.p = x.a
      WINDOW b AS (PARTITION BY x.f, x.ty ORDER BY x.p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT f, p, CASE WHEN no IS NOT NULL AND numbered IS NOT NULL THEN numbered WHEN no IS NULL AND go AND coalesce(head, top) IS NOT NULL THEN coalesce(head, top)
                        WHEN known AND a < p THEN a ELSE p END AS parent FROM w)
{ROOTS}"""
)
def local_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = materialise(event_pages(spark, sf_dir).withColumn("page", F.col("page").cast("long")), "event-pages")
    role = F.when(F.col("event_type").isin("view", "error"), "continuation").otherwise("first")
    number = F.when(F.col("event_type") == "purchase", (F.col("event_id") % 5).cast("string"))
    anchor = F.when(F.col("event_id") % 4 == 0, F.col("page") - 1 - F.col("event_id") % 3)
    return grouping.local_boundaries(pages, F.col("event_type"), number, role, anchor).select("filename", "page", "root")


@query()
def boundary_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts made from the turns: assistants answer the turn before them, every fifth verdict points ahead of itself
    and must be refused."""
    turns = turn_pages(spark, sf_dir)
    pages = turns.select("filename", "page", F.col("role").alias("doc_type"), F.when(F.col("page") % 3 == 0, (F.col("filename") % 4).cast("string")).alias("doc_no"), (F.col("role") == "assistant").alias("continues"))
    ahead = (F.col("filename") + F.col("page")) % 5 == 0
    verdicts = turns.select("filename", "page", F.when(ahead, F.col("page") + 1).when(F.col("role") == "assistant", F.col("page") - 1).otherwise(F.col("page")).alias("v_anchor"), F.lit(None).cast("string").alias("v_type"), F.lit(None).cast("string").alias("v_no"), F.lit("high").alias("v_confidence"), F.lit("turn order").alias("v_reason"))
    return grouping.refine_boundaries(pages, verdicts)


LINES_SQL = r"list_filter(list_transform(string_split_regex({t}, '\r\n|[\n\r\x0b\x0c\x1c-\x1e]'), lambda x: regexp_replace(regexp_replace(x, '[\s\p{{Z}}]+', ' ', 'g'), '^ | $', '', 'g')), lambda x: x <> '')"
STRIP_SQL = r"regexp_replace(coalesce({t}, ''), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
LAYOUT_SQL = (
    "CASE WHEN len(ls) = 0 THEN '' ELSE '[' || least(round_even(length(st) / 240.0, 0)::INT, 40) || ', ' || least(round_even(len(ls) / 5.0, 0)::INT, 80) || ', ' || "
    "least(round_even(len(list_filter(ls, lambda x: length(x) >= 45)) / 3.0, 0)::INT, 80) || ', ' || "
    r"least(round_even(len(list_filter(ls, lambda x: len(regexp_extract_all(x, '\p{Nd}')) >= 2)) / 3.0, 0)::INT, 80) || ', 0]' END"
)
TITLE_SQL = (
    r"coalesce(list_filter(list_transform(ls, lambda x: regexp_replace(x, '[\s\p{Z}|]+', '', 'g')), lambda x: length(x) >= 3 AND NOT regexp_full_match(x, '(附件|附表|附录)\p{Nd}*[:：]?') "
    r"AND NOT regexp_full_match(x, '[\p{Nd}./：:()（）\-—_]+') AND NOT (length(x) <= 16 AND regexp_matches(x, '(时间|日期|单位|页码|第\p{Nd}+页)')))[1], '')[1:80]"
)
KEY_SQL = r"regexp_replace(lower({x}), '[^0-9a-z\x{{4e00}}-\x{{9fff}}]+', '', 'g')"
SHAPES = f"""s0 AS (SELECT doc_id, source, lang, {STRIP_SQL.format(t="text")} AS st FROM documents),
s1 AS (SELECT *, {LINES_SQL.format(t="st")} AS ls FROM s0),
s2 AS (SELECT doc_id, source, lang, {LAYOUT_SQL} AS layout, {TITLE_SQL} AS title FROM s1),
s3 AS (SELECT *, {KEY_SQL.format(x="title")} AS tk FROM s2)"""


@query(f"WITH {SHAPES} SELECT doc_id, layout, title FROM s3")
def layout_and_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", texts.layout_signature(F.col("text")).alias("layout"), texts.title_candidate(F.col("text")).alias("title"))


@query(
    f"""WITH {SHAPES},
a AS (SELECT lang AS b, layout AS sig, min((source, doc_id)) AS o FROM s3 GROUP BY 1, 2),
n AS (SELECT b, sig, row_number() OVER (PARTITION BY b ORDER BY o) AS variant, count(*) OVER (PARTITION BY b) AS m FROM a)
SELECT doc_id, variant, CASE WHEN m > 1 THEN lang || '·版式' || CASE WHEN variant < 10 THEN '0' ELSE '' END || variant ELSE lang END AS split_type
FROM s3 JOIN n ON n.b = lang AND n.sig = layout"""
)
def format_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = document_pages(spark, sf_dir).withColumnRenamed("lang", "document_type").withColumn("layout", texts.layout_signature(F.col("text"))).drop("text")
    found = split.format_variants(pages, F.col("layout"))  # stores the layouts, and reads them twice
    return found.select(F.col("page").alias("doc_id"), "variant", "split_type")


@query(
    f"""WITH {SHAPES},
u AS (SELECT *, CASE WHEN length(tk) >= 4 THEN 'title:' || tk || '|layout:' || layout ELSE layout END AS sig FROM s3),
a AS (SELECT sig, min((source, doc_id)) AS o, arg_min(CASE WHEN tk <> '' THEN CASE WHEN title = '' THEN '未知文档' ELSE title[1:48] END ELSE '' END, (source, doc_id)) AS lb FROM u WHERE sig <> '' GROUP BY 1),
n AS (SELECT *, row_number() OVER (ORDER BY o) AS k FROM a)
SELECT doc_id, n.sig IS NOT NULL AS fallback, coalesce(CASE WHEN lb <> '' THEN lb ELSE '未知文档·版式' || CASE WHEN k < 10 THEN '0' ELSE '' END || k END, '未知文档') AS document_type
FROM u LEFT JOIN n ON n.sig = u.sig"""
)
def layout_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = document_pages(spark, sf_dir).drop("lang").withColumn("document_type", F.lit(texts.UNKNOWN))
    return split.layout_fallback(pages).select(F.col("page").alias("doc_id"), "fallback", "document_type")


@query(
    """WITH x AS (SELECT conv_id AS f, turn AS p, role, turn - turn % 2 AS a FROM conversations)
SELECT role AS type_key, arg_min(role, (f, p)) AS document_type, count(*) AS page_count, count(DISTINCT (f, a)) AS logical_documents,
       count(*) FILTER (WHERE p % 4 = 0) AS fallback_pages, count(DISTINCT f) AS source_files FROM x GROUP BY role"""
)
def type_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = turn_pages(spark, sf_dir).drop("text").withColumn("anchor", F.col("page") - F.col("page") % 2).withColumn("fallback", F.col("page") % 4 == 0)
    return split.type_groups(pages, "role", "anchor", fallback="fallback").drop("first")


BAD_SQL = r"regexp_replace(coalesce(text, ''), '[\s\p{Z}]+', '', 'g')"


KINDS_SQL = rf"""b AS (SELECT doc_id, source, length({STRIP_SQL.format(t="text")}) AS n, {BAD_SQL} AS body, coalesce(text, '') AS t FROM documents),
r AS (SELECT doc_id, source, n, len(regexp_extract_all(t, '\(cid:')) > 3 OR (CASE WHEN length(body) = 0 THEN 1.0 ELSE len(regexp_extract_all(body, '[\p{{C}}\x{{fffd}}]')) / length(body) END) > 0.2 AS odd FROM b),
k AS (SELECT *, CASE WHEN n = 0 OR odd OR n < 30 OR (doc_id % 3 = 0 AND n < 200) THEN 'scanned' ELSE 'native' END AS shared, CASE WHEN n = 0 OR odd OR n < 30 THEN 'scanned' ELSE 'native' END AS kind FROM r)"""


@query(f"WITH {KINDS_SQL} SELECT doc_id, shared AS kind FROM k")
def page_kind_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third page is mostly image."""
    share = F.when(F.col("doc_id") % 3 == 0, 0.9).otherwise(0.1)
    return evidence.classify(table(spark, sf_dir, "documents").select("doc_id", "text", share.alias("share")), image_share="share").select("doc_id", "kind")


@query(
    rf"""WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[ \t\r\x0b\x0c\p{{Z}}]+(\n|$)', '\1', 'g'), ' {{3,}}', '   ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g') AS t FROM documents),
b AS (SELECT doc_id, {STRIP_SQL.format(t="t")} AS t FROM a)
SELECT doc_id, md5(CASE WHEN length(t) > 14000 THEN t[1:7000] || chr(10) || '……(本页中部省略)……' || chr(10) || right(t, 7000) ELSE t END) AS text_md5 FROM b"""
)
def compress_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(texts.compress_layout(F.col("text"))).alias("text_md5"))


@query(rf"""SELECT p_partkey, {KEY_SQL.format(x="coalesce(p_name, '') || ' ' || coalesce(p_brand, '')")} AS key FROM part""")
def canonical_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", values.canonical(F.concat(F.coalesce("p_name", F.lit("")), F.lit(" "), F.coalesce("p_brand", F.lit("")))).alias("key"))


@query(
    """WITH x AS (SELECT o_orderkey AS k, CAST(o_totalprice AS DECIMAL(18,2)) AS p, o_orderkey % 8 AS m FROM orders)
SELECT k AS o_orderkey, CASE WHEN m IN (0, 1, 2) THEN p::DOUBLE WHEN m = 3 THEN -p::DOUBLE WHEN m = 4 THEN k / 4.0 END AS number,
       CASE WHEN m = 5 THEN p || 'x' WHEN m = 6 THEN 'nan' WHEN m = 7 AND k % 16 = 7 THEN '1_000' END AS raw FROM x"""
)
def number_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts as they may stand on a page: signs, full-width digits, and what is no number."""
    p, k = F.col("o_totalprice").cast("decimal(18,2)"), F.col("o_orderkey")
    plain, m = p.cast("string"), k % 8
    shown = (
        F.when(m == 0, plain).when(m == 1, F.concat(F.lit("￥ "), F.format_number(p, 2), F.lit("\u3000元"))).when(m == 2, F.translate(plain, "0123456789.", "０１２３４５６７８９．"))
        .when(m == 3, F.concat(F.lit(" －"), F.format_number(p, 2))).when(m == 4, F.concat((k * 25).cast("string"), F.lit("e-2"))).when(m == 5, F.concat(plain, F.lit("x"))).when(m == 6, "nan").when(k % 16 == 7, "1_000").otherwise("null")
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", values.coerce(shown, "number").alias("number"), values.unread(shown, "number").alias("raw"))


@query(
    """WITH x AS (SELECT o_orderkey AS k, o_orderdate AS d, o_orderkey % 6 AS m FROM orders)
SELECT k AS o_orderkey, CASE WHEN m <= 3 THEN strftime(d, '%Y-%m-%d') WHEN m = 4 THEN strftime(d, '%Y') || '-13-45' ELSE 'order ' || k END AS day FROM x"""
)
def date_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in several shapes: the first of two counts, an impossible one is kept, and a text without one too."""
    d, k = F.col("o_orderdate"), F.col("o_orderkey")
    part = lambda f: F.date_format(d, f)
    m = k % 6
    shown = (
        F.when(m == 0, part("yyyy/M/d")).when(m == 1, F.concat(F.lit("填发 "), part("yyyy"), F.lit("年"), part("M"), F.lit(" 月"), part("d"), F.lit("日")))
        .when(m == 2, F.translate(part("yyyy.MM.dd"), "0123456789.", "０１２３４５６７８９．")).when(m == 3, F.concat(part("yyyy-MM-dd"), F.lit(" to 2099-01-01"))).when(m == 4, F.concat(part("yyyy"), F.lit("-13-45")))
        .otherwise(F.concat(F.lit("\t order "), k.cast("string"), F.lit(" ")))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", values.norm_date(shown).alias("day"))


@query("SELECT o_orderkey, o_orderstatus = 'F' AS ticked, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus = 'O' END AS open FROM orders")
def checkbox_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select("o_orderkey", values.checkbox(F.when(s == "F", " 是 ").otherwise("no")).alias("ticked"), values.checkbox(F.when(s == "O", "YES").when(s == "P", "null").otherwise("x")).alias("open"))


#: Share of pieces from which passages of the benchmark count as alike.
SIMILAR = 0.05
GRAMS_SQL = r"regexp_replace(regexp_replace(regexp_replace(lower(coalesce(text, '')), '\p{Nd}+', '0', 'g'), '[\s\p{Z}]+', ' ', 'g')[1:12000], '[\s\p{Z}]+', '', 'g')"


@query(
    f"""WITH c AS (SELECT item_id, {GRAMS_SQL} AS c FROM benchmark),
l AS (SELECT item_id, list_distinct(list_transform(generate_series(0, greatest(1, length(c) - 3) - 1, 3), lambda i: c[i + 1:i + 4])) AS g FROM c),
k AS (SELECT item_id, list_append(CASE WHEN len(g) > 1200 THEN list_sort(g)[1:1200] ELSE g END, 'kind:native') AS g FROM l),
g AS (SELECT min(item_id) AS item_id, list_sort(g) AS g FROM k GROUP BY list_sort(g)),
p AS (SELECT a.item_id AS a, b.item_id AS b, len(list_intersect(a.g, b.g)) AS shared, len(a.g) + len(b.g) AS n FROM g a JOIN g b ON a.item_id < b.item_id)
SELECT a, b, shared, shared / (n - shared) AS similarity FROM p WHERE shared / (n - shared) >= {SIMILAR}"""
)
def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of the benchmark that are alike; equal ones are one class."""
    grams = table(spark, sf_dir, "benchmark").select("item_id", texts.fingerprint(F.col("text"), F.lit("native")).alias("grams"))
    return sample.similar_pairs(grams, "item_id", least=SIMILAR)


@query()
def diverse_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to SAMPLE_PAGES differing passages of the benchmark, which is one file here."""
    pages = table(spark, sf_dir, "benchmark").select(F.lit("benchmark").alias("filename"), F.col("item_id").alias("page"), "text", F.lit("native").alias("kind"))
    return sample.representative(pages)


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN 'N-' || o_orderkey END AS number, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS total,
       o_orderstatus = 'F' AS closed, CAST(1 + o_orderkey % 3 + (o_orderkey % 5 <> 0)::INTEGER AS INTEGER) AS n_rows, (o_custkey + o_orderkey % 3)::VARCHAR AS last_cell FROM orders"""
)
def rule_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page texts made from orders, read back by the default extractor: labels may be missing, numbers unreadable, and
    there are one to three rows, after one space or more, a line with two values that looks like one, and lines that do not."""
    o = table(spark, sf_dir, "orders")
    money, k = F.col("o_totalprice").cast("decimal(18,2)"), F.col("o_orderkey")
    line = lambda i: F.when(F.lit(i) <= k % 3, F.concat(F.lit("\n"), (F.col("o_custkey") + i).cast("string"), F.when((k + i) % 2 == 0, "   part one   10.5").otherwise(" part   20"))).otherwise("")
    body = F.concat(
        F.when(k % 5 != 0, F.concat(F.lit("Order No： N-"), k.cast("string"), F.lit("   Order No: other"))).otherwise("Order number missing"), F.lit("\nDate "), F.date_format("o_orderdate", "yyyy年M月d日"), F.lit(" and 2099-01-01"),
        F.lit("\nTotal(¥): "), F.when(k % 7 != 0, F.concat(F.lit("￥ "), F.format_number(money, 2))).otherwise("unknown"), F.lit("\nClosed: "), F.when(F.col("o_orderstatus") == "F", "是").otherwise("否"),
        F.lit("\nseq   name   amount"), line(0), line(1), line(2), F.lit("\n合计   30.5   x\nno digits   here   at all"),
    )
    specs = normalize_fields(
        [
            {"key": "number", "label": "Order No"}, {"key": "day", "label": "Date", "type": "date"}, {"key": "total", "label": "Total(¥)", "type": "number"}, {"key": "closed", "label": "Closed", "type": "checkbox"},
            {"key": "rows", "label": "Rows", "type": "table", "description": "列：seq seq, name name, amount amount"},
        ]
    )
    found = extract.rule_extract(o.select("o_orderkey", body.alias("text")), specs)
    return found.select("o_orderkey", "number", "day", "total", "closed", F.size("rows").alias("n_rows"), F.try_element_at("rows", F.lit(-1))["seq"].alias("last_cell"))


@query(
    """WITH x AS (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(event_id % 4 AS INTEGER) AS m FROM events)
SELECT event_id, CASE WHEN m <> 3 THEN k END AS k, CASE m WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 0 END AS n_rows FROM x"""
)
def json_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with a list, with a list as items, with something else, and broken ones."""
    p, m = F.col("props"), F.col("event_id") % 4
    rows = F.when(m == 0, F.concat(F.lit("["), p, F.lit(","), p, F.lit("]"))).when(m == 1, F.concat(F.lit('{"items": ['), p, F.lit("]}"))).otherwise('"none"')
    whole = F.concat(F.lit('{"head": '), p, F.lit(', "rows": '), rows, F.when(m == 3, "").otherwise("}"))
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json(whole), "$.head.k", "bigint").alias("k"), F.size(extract.json_rows(whole, "rows")).alias("n_rows"))


@query(
    f"""WITH {KINDS_SQL}, x AS (SELECT source, CASE WHEN n = 0 AND doc_id % 2 = 0 THEN 'blank' ELSE kind END AS kind FROM k)
SELECT source, count(*) AS total, count(*) FILTER (WHERE kind = 'native') AS native, count(*) FILTER (WHERE kind = 'scanned') AS scanned, count(*) FILTER (WHERE kind = 'blank') AS blank FROM x GROUP BY source"""
)
def kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by kind; of those without text every other one has next to no ink."""
    pages = table(spark, sf_dir, "documents").select("source", "text", F.when(F.col("doc_id") % 2 == 0, 0.0001).otherwise(0.5).alias("ink"))
    return evidence.kind_counts(evidence.classify(pages, ink="ink"), ["source"])


@query("SELECT role, count(*) AS pages, count(DISTINCT (conv_id, turn - turn % 2)) AS documents FROM conversations GROUP BY role")
def doc_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = turn_pages(spark, sf_dir).select("role", "filename", (F.col("page") - F.col("page") % 2).alias("anchor"))
    return turns.groupBy("role").agg(F.count("*").alias("pages"), F.count_distinct(F.struct("filename", "anchor")).alias("documents"))


@query(
    r"""WITH b AS (SELECT page_id, trim(regexp_replace(regexp_extract(CASE page_id % 5 WHEN 0 THEN 'x/a\b' || chr(127) || '.pdf' WHEN 1 THEN 'y/ report ' WHEN 2 THEN '' ELSE split_part(split_part(url, '?', 1), '#', 1) END, '([^/]*)$', 1), '[\\\x00-\x1f\x7f]', '_', 'g')) AS n FROM pages),
m AS (SELECT page_id, (CASE WHEN coalesce(n, '') = '' THEN 'file.pdf' ELSE n END)[1:120] AS name FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY page_id) - 1 AS k FROM m)
SELECT page_id, CASE WHEN k = 0 THEN name ELSE regexp_extract(name, '^(.*?)(\.[^.]*)?$', 1) || '(' || k || ')' || regexp_extract(name, '^(.*?)(\.[^.]*)?$', 2) END AS unique_name FROM r"""
)
def safe_unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last parts of addresses, and three names that a third of all pages share."""
    m = F.col("page_id") % 5
    path = F.when(m == 0, "x/a\\b\x7f.pdf").when(m == 1, "y/ report ").when(m == 2, "").otherwise(F.regexp_extract("url", r"^([^?#]*)", 1))
    named = table(spark, sf_dir, "pages").select("page_id", evidence.safe_name(path).alias("name"))
    return evidence.unique_names(named, "name", "page_id").select("page_id", "unique_name")


@query(
    f"""WITH {DECLARED_SQL}
SELECT o_custkey, count(*) AS total, count(*) FILTER (WHERE match) AS passed,
       CASE WHEN count(*) FILTER (WHERE match) < count(*) THEN 'failed' ELSE 'ok' END AS status FROM v GROUP BY o_custkey"""
)
def validation_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = _declared(spark, sf_dir, _lines(spark, sf_dir))
    totals = checked.groupBy("o_custkey").agg(F.count("*").alias("total"), F.count_if("match").alias("passed"))
    return totals.withColumn("status", flatten.row_status(F.lit(False), F.col("passed") < F.col("total"), F.lit(False)))


@query(
    f"""WITH x AS (SELECT *, NULL::VARCHAR AS gid, event_type IN ('view', 'error') AS cont FROM ({EVENTS}))
{CHAIN}, d AS (SELECT f, group_no, min(p) AS a FROM g GROUP BY f, group_no), n AS (SELECT *, row_number() OVER (ORDER BY f, a) AS k FROM d)
SELECT f AS user_id, a AS first_page, 'doc_' || CASE WHEN k < 10000 THEN lpad(k::VARCHAR, 4, '0') ELSE k::VARCHAR END AS document_id FROM n"""
)
def document_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grouping.chain(event_pages(spark, sf_dir), None, F.col("event_type").isin("view", "error"))
    heads = rows.groupBy("filename", "group_no").agg(F.min("page").cast("long").alias("first_page"))
    return grouping.document_ids(heads, ["filename", "first_page"]).select(F.col("filename").alias("user_id"), "first_page", "document_id")


@query(
    """WITH x AS (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(event_id % 5 AS INTEGER) AS m FROM events)
SELECT event_id, CASE WHEN m < 3 THEN k END AS k, CASE m WHEN 2 THEN nullif(CAST(event_id % 4 AS INTEGER), 0) WHEN 3 THEN 2 END AS n FROM x"""
)
def json_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers: as they should be, with thoughts and fences, cut off behind one of four rows, a list, and no JSON."""
    p, m, e = F.col("props"), F.col("event_id") % 5, F.col("event_id")
    rows = F.array_join(F.transform(F.sequence(F.lit(1).cast("long"), e % 4 + 1), lambda i: F.concat(F.lit('{"i": '), i.cast("string"), F.lit("}"))), ", ")
    cut = F.concat(F.regexp_replace(p, r"\}\s*$", ""), F.lit(', "rows": ['), F.expr("substring(r, 1, length(r) - 2)"))
    answer = F.when(m == 0, p).when(m == 1, F.concat(F.lit("<think>{no}</think>```json\n"), p, F.lit("\n```"))).when(m == 2, cut).when(m == 3, F.concat(F.lit("found: ["), p, F.lit(","), p, F.lit(",]"))).otherwise("no answer at all")
    found = payload.parse_payload(table(spark, sf_dir, "events").withColumn("r", rows).select("event_id", answer.alias("a")), "a")
    size = lambda path: F.size(F.try_variant_get("parsed", path, "array<variant>"))
    n = F.when(m == 2, size("$.rows")).when(m == 3, size("$.items"))
    return found.select("event_id", F.try_variant_get("parsed", "$.k", "bigint").alias("k"), n.alias("n"))


@query(
    """WITH l AS (SELECT lower(o_orderstatus) AS type_key, o_orderkey AS k, unnest(['No', 'Date', 'Total', 'Note']) AS label FROM orders),
m AS (SELECT * FROM l WHERE (label <> 'Date' OR k % 3 <> 0) AND (label <> 'Note' OR k % 4 = 0)),
t AS (SELECT lower(o_orderstatus) AS type_key, count(*) AS n FROM orders GROUP BY 1),
c AS (SELECT type_key, label, count(*) AS pages, count(*) FILTER (WHERE label = 'Total' AND k % 10 <> 0 OR label = 'Note') AS numbers, count(*) FILTER (WHERE label = 'Date' AND k % 2 = 0) AS dates FROM m GROUP BY 1, 2)
SELECT c.type_key, CAST(row_number() OVER (PARTITION BY c.type_key ORDER BY pages DESC, lower(label)) AS INTEGER) AS place, label, pages, pages / n AS coverage, numbers, dates FROM c JOIN t ON t.type_key = c.type_key"""
)
def schema_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of page texts made from orders, per status as type: some pages lack a label, some values are of another type."""
    k = F.col("o_orderkey")
    body = F.concat(
        F.lit("No: N-"), k.cast("string"), F.when(k % 3 != 0, F.concat(F.lit("\nDate："), F.when(k % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("soon"))).otherwise(""), F.lit("\n total text\nTotal: "),
        F.when(k % 10 != 0, F.col("o_totalprice").cast("decimal(18,2)").cast("string")).otherwise("none"), F.when(k % 4 == 0, "\nNote: 7").otherwise(""),
    )
    pages = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", body.alias("text"))
    return discover.inventories(pages, "o_orderstatus", ["o_orderkey"])


@query(
    f"""WITH a AS ({EVENTS}), x AS (SELECT f, p, event_type AS ty, value, event_type = 'error' AS bad, CASE WHEN event_type = 'error' THEN -p ELSE p - (p - 1) % 3 END AS d FROM a),
h AS (SELECT f, d, bad, min(p) AS first, coalesce(arg_min(ty, p) FILTER (WHERE ty <> 'signup'), '未知') AS s, string_agg(p::VARCHAR, '+' ORDER BY p) AS pages, arg_min(value, p) AS value FROM x GROUP BY f, d, bad),
n AS (SELECT *, row_number() OVER (ORDER BY f, first) AS k FROM h)
SELECT 'mix_doc_' || CASE WHEN k < 10000 THEN lpad(k::VARCHAR, 4, '0') ELSE k::VARCHAR END AS document_id, s AS schema_type, pages, CASE WHEN s IN ('purchase', 'view') THEN value END AS value, CASE WHEN bad THEN 'boom' END AS error FROM n"""
)
def mixed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three events of a user are a document; purchases and views have schemas, the others have none, errors stand alone,
    and sign-ups do not tell their type."""
    events = event_pages(spark, sf_dir)
    kind = F.when(F.col("event_type") != "signup", F.col("event_type"))
    pages = events.select("filename", "page", kind.alias("document_type"), "value", (F.col("page") - (F.col("page") - 1) % 3).alias("anchor"), F.when(F.col("event_type") == "error", "boom").alias("error"))
    specs = normalize_fields([{"key": "value", "type": "number"}])
    found = mixed.assemble(pages, {"purchase": specs, "view": specs})
    parts = [df.select("document_id", "schema_type", "pages", "value", "error") for df in found.by_type.values()]
    return parts[0].unionByName(parts[1]).unionByName(found.others.select("document_id", "schema_type", "pages", F.lit(None).cast("double").alias("value"), "error"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which orders' declared totals disagree with their lines: lines are pages that continue the order's first one."""
    lines = order_lines(spark, sf_dir)
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("filename"), values.to_money(F.col("o_totalprice")).alias("declared"))
    pages = lines.join(orders, "filename").select("filename", "page", (F.col("page") > 1).alias("continues"), "declared", F.array(F.struct("l_partkey", "l_quantity", "amount")).alias("lines"))
    chained = grouping.chain(pages, None, F.col("continues"))
    specs = normalize_fields(ORDER_SPECS)
    return validate.sum_checks(fold.fold(chained, specs, ["filename", "group_no"]), specs, ["filename", "pages"])


from . import records  # noqa: E402,F401  (more queries, which use the SQL above)

import pytest
from pyspark.sql import functions as F

from quirework.functions import texts, values


def one(spark, column, **given):
    row = spark.createDataFrame([tuple(given.values())], ", ".join(f"{k} string" for k in given))
    return row.select(column.alias("x")).first().x


def every(spark, column, cases):
    rows = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, v string").select("i", column.alias("x")).collect()
    assert [r.x for r in sorted(rows)] == [want for _, want in cases]


def test_numbers(spark):
    every(spark, values.to_num(F.col("v")), [("￥８7,0９6.25元", 87096.25), ("4，321", 4321.0), ("　-17 ", -17.0), ("$ 1.5e3", 1500.0), ("7d", None), ("2_0", None), ("nan", None), ("Infinity", None), ("1..2", None), ("", None), (None, None)])
    every(spark, values.unread(F.col("v"), "number"), [("12", None), ("about 12", "about 12"), ("null", None), ("", None), (None, None)])
    every(spark, values.safe_int(F.col("v")), [(" ４2 ", 42), ("1.5", None), ("x", None), ("9" * 30, None), (None, None)])
    exact = [str(r) if r is not None else None for r in [x.x for x in spark.createDataFrame([("0.335",), ("1e30",), ("x",)], "v string").select(values.to_amount(F.col("v")).alias("x")).collect()]]
    assert exact == ["0.3350000000", None, None]


def test_dates(spark):
    cases = [("２０３１年4月9日", "2031-04-09"), ("due 2031/12/1, not 2032/1/1", "2031-12-01"), ("2031－02．30", "2031-02-30"), ("2031-77-88", "2031-77-88"), (" soon ", "soon"), ("", None), (None, None)]
    every(spark, values.norm_date(F.col("v")), cases)


def test_values(spark):
    every(spark, values.checkbox(F.col("v")), [("✓", True), (" Y ", True), ("nope", False), ("None", None), (None, None)])
    every(spark, values.canonical(F.col("v")), [("Q-7 海é.", "q7海"), (None, "")])
    every(spark, values.clean(F.col("v")), [("　k ", "k"), ("null", None), (" ", ""), (None, None)])
    every(spark, values.coerce(F.col("v"), "multiline"), [(" a\nb ", "a\nb"), ("None", None)])
    every(spark, values.one_of(F.col("v"), ("a", "b"), "z"), [("a", "a"), ("c", "z"), (None, "z")])
    every(spark, values.value_key(F.col("v"), True), [("1.00", "n:1.0"), ("1", "n:1.0")])


def test_texts(spark):
    page = "附表2：\n7/31\n单位：箱\n 航次 装载单 |\nbody"
    assert one(spark, texts.title_candidate(F.col("t")), t=page) == "航次装载单"
    assert one(spark, texts.title_candidate(F.col("t")), t="12\n" * 40 + "第3页\nLate title\nother") == "Latetitle"
    assert one(spark, texts.title_candidate(F.col("t")), t=None) == ""
    assert one(spark, texts.compress_layout(F.col("t")), t="p     q　\n\n\n\t\nr\n") == "p   q\n\nr"
    long = one(spark, texts.compress_layout(F.col("t")), t="y" * 20_000)
    assert len(long) == 14_000 + len(texts.MIDDLE_MARK)
    assert one(spark, texts.layout_signature(F.col("t")), t="") == ""
    assert one(spark, texts.layout_signature(F.col("t")), t=" \n\n") == ""
    many = "\n".join(["x" * 50, "1 2", "", " a  b "] * 12)
    assert one(spark, texts.layout_signature(F.col("t")), t=many) == "[3, 7, 4, 4, 0]"
    layout = spark.createDataFrame([((210.0, 297.0, 45, 2),), (None,)], "m struct<w:double,h:double,lines:int,images:int>")
    assert [r.x for r in layout.select(texts.layout_signature(F.lit("a"), F.col("m")).alias("x")).collect()] == ['["portrait", 0.7, 1, 2]', "[0, 0, 0, 0, 0]"]
    assert one(spark, texts.fingerprint(F.col("t"), F.lit("native")), t="Xy 907 zabcd") == ["xy0z", "zabc", "kind:native"]
    assert one(spark, texts.fingerprint(F.col("t"), F.lit("scanned")), t="") == ["kind:scanned"]
    assert one(spark, texts.quality_bad(F.col("t")), t="mn�\u0002") == 0.5
    assert one(spark, texts.quality_bad(F.col("t")), t=" ") == 1.0


@pytest.mark.parametrize(("name", "want"), [("Invoice / 7 ", "Invoice_7"), (" .海运.单. ", "海运.单"), ("///", "未知文档"), ("", "未知文档"), (None, "未知文档"), ("k" * 90, "k" * 80)])
def test_slug(spark, name, want):
    assert one(spark, texts.slug(F.col("t")), t=name) == want


def test_network_failures(spark):
    every(spark, texts.is_network_failure(F.col("v")), [("Server disconnected", True), ("read TIMEOUT", True), ("bad answer", False), (None, False)])

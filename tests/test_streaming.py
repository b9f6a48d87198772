from quirework.specs import normalize_fields
from quirework.streaming.pages import latest_records, stream_records

PAGES = "filename string, page int, continues boolean, no string, total double"


def test_records_of_a_stream(spark, tmp_path):
    specs = normalize_fields([{"key": "no", "group_key": True}, {"key": "total", "type": "number", "carry": "last"}])
    source, store, out, mark = (f"file://{tmp_path}/{x}" for x in ("in", "store", "out", "mark"))
    first = [("f", 3, True, None, 9.0), ("f", 1, False, "A", 1.0), ("g", 1, False, "X", 5.0)]
    second = [("f", 2, False, "B", 2.0), ("h", 1, False, None, None)]
    for rows in (first, second):
        spark.createDataFrame(rows, PAGES).coalesce(1).write.mode("append").parquet(source)
        pages = spark.readStream.schema(PAGES).parquet(source)
        stream_records(pages, specs, store, out, mark, buckets=4, availableNow=True).awaitTermination(120)
    got = {(r.filename, r.pages, r.no, r.total) for r in latest_records(spark, out).collect()}
    assert got == {("f", "1", "A", 1.0), ("f", "2+3", "B", 9.0), ("g", "1", "X", 5.0), ("h", "1", None, None)}

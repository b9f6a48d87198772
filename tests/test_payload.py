import json

import pytest

from quirework.functions.payload import parse_payload, repair_json
from quirework.operators import discover


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('{"a": 1}', {"a": 1}),
        ('"a": 1}', {"a": 1}),
        ('<think>{"x": 0}</think>\n```json\n{"a": [1, 2]}\n```', {"a": [1, 2]}),
        ('Here it is: {"a": "x{y", "b": 2} as asked', {"a": "x{y", "b": 2}),
        ('{"a": 1, "rows": [{"x": 1}, {"x": 2', {"a": 1, "rows": [{"x": 1}]}),
        ('{"a": 1, "b": "cut of', {"a": 1}),
        ('{"a": [1, 2,], }', {"a": [1, 2]}),
        ("[1, 2]", {"items": [1, 2]}),
        ("no answer", None),
        ("", None),
        (None, None),
    ],
)
def test_repair(text, want):
    got = repair_json(text)
    assert (None if got is None else json.loads(got)) == want


def test_parse_payload(spark):
    df = spark.createDataFrame([(1, '{"a": 1}'), (2, "```{\"a\": 2}```"), (3, "nothing"), (4, None), (5, "[7]")], "i int, p string")
    got = {r.i: None if r.x is None else json.loads(r.x) for r in parse_payload(df, "p").selectExpr("i", "to_json(parsed) AS x").collect()}
    assert got == {1: {"a": 1}, 2: {"a": 2}, 3: None, 4: None, 5: {"items": [7]}}


def test_discovered_schemas(spark):
    rows = [("Log", 1, "Ship：Aurora\nDay: 2031年1月2日\nTons: 1,000.00"), ("log", 2, "Ship: Bell\nTons：￥20"), ("x", 3, None)]
    df = spark.createDataFrame(rows, "kind string, page int, text string")
    found = discover.schemas(discover.inventories(df, "kind", ["page"]))
    assert {s.label: (s.type, s.coverage) for s in found["log"]} == {"Ship": ("text", 1.0), "Tons": ("number", 1.0), "Day": ("date", 0.5)}
    assert "x" not in found

import pytest

from quirework import specs
from quirework.specs import SumCheck, group_field, normalize_common_fields, normalize_fields, parse_columns, required_fields


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Rows of the voyage. 列：leg 航段, port 港口, eta 到达", [("leg", "航段"), ("port", "港口"), ("eta", "到达")]),
        ("列: 港口; eta：到达。", [("col1", "港口"), ("eta", "到达")]),
        ("列：a 甲, a 乙, 丙", [("a", "甲"), ("a_2", "乙"), ("col3", "丙")]),
        ("列：, x, , y", [("x", "x"), ("y", "y")]),
        ("列：2nd 第二, _id", [("col1", "2nd 第二"), ("_id", "_id")]),
        ("列：", []),
        ("no list here", []),
        ("", []),
        (None, []),
    ],
)
def test_columns(text, want):
    assert [(c.key, c.label) for c in parse_columns(text)] == want


def test_fields():
    found = normalize_fields(
        [
            {"key": "freight", "type": "number", "carry": "last", "sum_check": {"table": "Legs", "column": "费用"}},
            {"key": "legs", "label": "Legs", "type": "table", "description": "列：leg 航段, cost 费用"},
            {"key": "bill of lading", "group_key": True, "type": "odd", "carry": "never"},
            {"key": "bill of lading"},
            "not a field",
            {"key": "duty", "sum_check": {"table": "freight", "column": "cost"}},
            {"key": "tax", "sum_check": {"table": "legs", "column": "levy"}},
            {"key": " 船名 !", "label": " "},
            {},
        ]
    )
    assert [s.key for s in found] == ["freight", "legs", "bill_of_lading", "bill_of_lading_4", "duty", "tax", "船名", "field_9"]
    assert [s.sum_check for s in found if s.key in ("freight", "duty", "tax")] == [SumCheck("legs", "cost"), None, SumCheck("legs", "levy")]
    assert (found[2].type, found[2].carry, found[2].label, group_field(found).key) == ("text", "first", "bill_of_lading", "bill_of_lading")
    assert found[6].label == "船名"
    assert normalize_fields(None) == [] and group_field([]) is None


def test_common_fields():
    found = normalize_common_fields(
        [
            {"key": "运费", "label": "Freight", "type": "number", "coverage": "1.7", "merge_confidence": "high", "source_variants": [" a ", "", None, *range(30)], "group_key": True, "sum_check": {"table": "legs", "column": "x"}},
            {"key": "legs", "type": "table", "columns": [{"key": "eta", "type": "date"}, {"key": "eta", "type": "table"}, {"label": "x"}, 7]},
            {"key": "old", "type": "table", "description": "列：a 甲, b"},
            {"key": "nan", "coverage": float("nan"), "source_variants": "abc"},
        ]
    )
    first, legs, old, nan = found
    assert (first.key, first.coverage, first.merge_confidence, first.source_variants[:2], len(first.source_variants)) == ("field_1", 1.0, "high", ("a", "0"), specs.MAX_VARIANTS)
    assert not first.group_key and first.sum_check is None
    assert [(c.key, c.label, c.type) for c in legs.columns] == [("eta", "eta", "date"), ("eta_2", "eta_2", "text"), ("column_3", "x", "text")]
    assert [(c.key, c.label) for c in old.columns] == [("a", "甲"), ("b", "b")]
    assert nan.coverage == 0.0 and nan.source_variants == ()


def test_required_fields():
    assert [s.key for s in required_fields('[{"key": "a"}]')] == ["a"]
    for bad in (None, "", "[]", '["x"]', "{}", "[", '"x"'):
        with pytest.raises(ValueError):
            required_fields(bad)


def test_presets():
    found = specs.presets()
    assert len(found) == 5 and specs.default_fields() == list(found.values())[-1]
    for fields in found.values():
        assert len({s.key for s in fields}) == len(fields)
        for s in fields:
            assert s.sum_check is None or s.sum_check.column in [c.key for t in fields if t.key == s.sum_check.table for c in t.columns]
    assert sum(s.sum_check is not None for fields in found.values() for s in fields) == 4
    assert specs.public(specs.default_fields())[0]["sum_check"] is False

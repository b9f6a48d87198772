"""Conversations with a model, over stand-ins that fail on purpose."""

import json

import pytest
from pyspark.sql import functions as F

from quirework.operators import doubles, model
from quirework.specs import normalize_fields

SPECS = normalize_fields([{"key": "ship"}, {"key": "tons", "type": "number"}, {"key": "rows", "type": "table", "description": "列：cell 格"}])


def scripted(*answers):
    """A call that gives the answers one by one (raising those that are errors), and what it was asked."""
    left, asked = list(answers), []

    def call(kind, system, user, tokens):
        asked.append((kind, user, tokens))
        answer = left.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return answer if isinstance(answer, tuple) else (answer, "end")

    return call, asked


def test_retries():
    waits, tries = [], []

    def act(error, good_at):
        tries.clear()

        def run():
            tries.append(1)
            if len(tries) < good_at:
                raise error
            return "ok"

        return run

    assert model.robust(act(TimeoutError(), 5), sleep=waits.append) == "ok" and len(waits) == 4
    assert all(low <= w <= low + model.JITTER for w, low in zip(waits, (1.2, 2.4, 4.8, 8.0), strict=True))
    with pytest.raises(TimeoutError):
        model.robust(act(TimeoutError(), 6), sleep=waits.append)
    with pytest.raises(doubles.Unreachable):
        model.robust(act(doubles.Unreachable(404), 2), sleep=waits.append)
    assert len(tries) == 1
    with pytest.raises(model.ModelError):
        model.robust(act(model.ModelError("x"), 2), sleep=waits.append)


def test_asking():
    call, asked = scripted(('{"a": 1, "b', model.CUT_OFF), '{"a": 1, "b": 2}')
    assert model.ask(call, "text", "s", "u", 100) == {"a": 1, "b": 2} and [t for _, _, t in asked] == [100, model.HARD_TOKENS]
    call, asked = scripted("no idea", '{"a": 1}')
    assert model.ask(call, "text", "s", "u", 100) == {"a": 1} and asked[1][1] == "u" + model.REMINDER
    call, asked = scripted(TimeoutError(), "[1]")
    assert model.ask(call, "text", "s", "u", 100, sleep=lambda s: None) == {"items": [1]}
    call, asked = scripted("no", "no")
    with pytest.raises(ValueError):
        model.ask(call, "text", "s", "u", 100)


def test_extraction_ladder():
    page = {"kind": "native", "text": "x", "hint": None, "note": "look again"}
    call, asked = scripted("?", "?", '{"ship": "Aurora"}', '{"items": [{"cell": "1"}, 7]}')
    assert model.extract_page(SPECS, call, page, True) == ({"ship": "Aurora", "rows": [{"cell": "1"}]}, "native_text")
    assert "look again" in asked[0][1]
    call, _ = scripted("?", "?", '{"ship": "Aurora"}', model.ModelError("x"))
    assert model.extract_page(SPECS, call, page, True)[0] == {"ship": "Aurora", "rows": []}
    call, asked = scripted(model.ModelError("x", no_vision=True), '{"ship": "B", "rows": {"a": 1}}')
    assert model.extract_page(SPECS, call, page | {"kind": "scanned", "hint": "h"}, True) == ({"ship": "B", "rows": []}, "ocr_text") and [k for k, _, _ in asked] == ["vision", "text"]
    call, _ = scripted(model.ModelError("x", no_vision=True))
    with pytest.raises(model.ModelError):
        model.extract_page(SPECS, call, {"kind": "scanned", "text": None, "hint": None}, True)
    call, _ = scripted('{"ship": "C"}')
    assert model.extract_page(SPECS, call, page | {"kind": "scanned"}, True)[1] == "vision"


def test_tokens():
    assert model.tokens_for(SPECS[:2], "x") == 780
    assert model.tokens_for(SPECS, "") == 780 + 30 * (15 + 14 * 4)
    assert model.tokens_for(SPECS, "1 2\n3 4\nx\n55\n66\n77\n") == 780 + 5 * 71 and model.tokens_for(SPECS, "12\n" * 10_000) == model.HARD_TOKENS


def test_model_extractor(spark):
    rows = [(1, "native", "page: 1\nship: Aurora\ntons: 1,200\n_confidence: high\n_is_continuation: true"), (9, "native", "page: 9\nship: B"), (3, None, None), (4, "native", "tons: heavy\nrows: a\nrows: b")]
    df = spark.createDataFrame(rows, "id int, kind string, text string")
    found = {r.id: r for r in model.model_extractor(doubles.Reader(broken=frozenset({9})), sleep=lambda s: None)(df, SPECS).collect()}
    assert (found[1].ship, found[1].tons, found[1].confidence, found[1].continues, found[1].error) == ("Aurora", 1200.0, "high", True, None)
    assert (found[9].ship, found[9].evidence, found[9].error, found[9].rows) == (None, "failed", "the model is out of order", [])
    assert (found[4].tons, found[4].tons_raw, [r.cell for r in found[4].rows]) == (None, "heavy", ["a", "b"]) and found[3].error is None
    assert model.model_extractor(doubles.Reader())(df.limit(0), SPECS).count() == 0


def test_classification_falls_back_page_by_page():
    pages = [(p, f"log {p}") for p in range(1, 7)]
    call, asked = scripted(json.dumps({"pages": [{"page": 1, "document_type": "old"}, {"page": 1, "document_type": "log"}, {"page": "x"}, 7]}), *["?", "?"] * 2, *[json.dumps([{"page": p}]) for p in (4, 5, 6)])
    found = model.classify_batch(call, "", "f", pages, sleep=lambda s: None)
    assert found[1]["document_type"] == "log" and found[2]["reason"].startswith(model.MODEL_FALLBACK) and found[4] == {"page": 4} and len(asked) == 8
    call, asked = scripted(doubles.Unreachable(403))
    found = model.classify_batch(call, "", "f", pages)
    assert len(asked) == 1 and all(x["reason"].startswith(model.NETWORK_FALLBACK) and x["confidence"] == "low" for x in found.values())


def test_items_are_put_right(spark):
    pages = spark.createDataFrame([("f", p) for p in range(1, 6)], "filename string, page long")
    rows = [("f", 1, "  ", "null", "odd", "1", "sure", "r" * 200), ("f", 2, "Log", " 7 ", "first", "1", "high", None), ("f", 3, "Log", None, None, "9", None, ""), ("f", 4, "Log", None, None, "5", "low", "x")]
    items = spark.createDataFrame(rows, "filename string, page long, document_type string, document_no string, page_role string, anchor_page string, confidence string, reason string")
    got = {r.page: r for r in model.normalize_items(pages, items).collect()}
    assert (got[1].document_type, got[1].document_no, got[1].page_role, got[1].confidence, len(got[1].reason)) == ("未知文档", None, "unknown", "low", 120)
    assert (got[2].document_no, got[2].anchor_page, got[2].reason) == ("7", 1, "")
    assert [got[p].anchor_page for p in (3, 4, 5)] == [3, 4, 5] and got[5].reason == model.UNCLASSIFIED


def test_schemas_are_merged_in_batches(spark):
    calls = spark.sparkContext.accumulator(0)

    def merge(schemas):
        calls.add(1)
        return {"n": sum(s.get("n", 1) for s in schemas)}

    rows = [("a", i, "{}") for i in range(70)] + [("b", 0, "{}")]
    df = spark.createDataFrame(rows, "type_key string, place int, inventory string")
    assert {r.type_key: (json.loads(r.schema), r.sampled) for r in model.consolidated(df, merge, fan=8).collect()} == {"a": ({"n": 70}, 70), "b": ({"n": 1}, 1)}
    assert calls.value == 18 + 3 + 1 + 1
    assert model.consolidated(df.limit(0), merge).count() == 0


def test_observed_pages(spark):
    df = spark.createDataFrame([('{"identity_hints": [{"label": null, "value": " v "}], "page_summary": "' + "s" * 300 + '"}',), (None,)], "inventory string")
    first, none = model.observed_pages(df).collect()
    assert (first.document_type, len(first.page_summary), [tuple(h) for h in first.identity_hints]) == ("未知", 240, [("", "v", "")])
    assert (none.document_type, none.continues, none.identity_hints) == ("未知", False, [])
    assert df.select(F.lit(1)).count() == 2

"""Cross-layout and mixed records: golden cases, and random pages against a sequential model."""

import random
import re

from pyspark.sql import functions as F

from quirework.operators import common, mixed, outputs
from quirework.specs import normalize_common_fields

META = "map<string,struct<source_label:string,evidence:string,confidence:string,status:string>>"
SPECS = normalize_common_fields([{"key": "port", "label": "Port"}, {"key": "tons", "label": "Tons", "type": "number"}, {"key": "legs", "label": "Legs", "type": "table", "columns": [{"key": "a"}]}])
PAGES = f"filename string, page int, kind string, document_type string, document_no string, continues boolean, anchor int, segment_confidence string, segment_reason string, evidence string, confidence string, error string, port string, tons double, legs array<struct<a:string>>, field_meta {META}"


def plain(text):
    return re.sub("[^0-9a-z一-鿿]", "", (text or "").lower())


def page(n, **given):
    base = dict.fromkeys(re.findall(r"(\w+) (?:string|int|boolean|double|array|map)", PAGES))
    return base | {"filename": "f", "page": n, "kind": "native"} | given


def frame(spark, rows):
    return spark.createDataFrame([tuple(r.values()) for r in rows], PAGES)


def model(pages):
    """Groups of pages as lists, in the order in which a reader in page order opens them."""
    groups, anchored, numbered, latest = [], {}, {}, {}
    for p in sorted((p for p in pages if p["kind"] != "blank"), key=lambda p: (p["filename"], p["page"])):
        file, kind = p["filename"], plain(p["document_type"] or "未知")
        if p["error"]:
            groups.append([p])
            continue
        if p["anchor"] is not None:
            if (file, p["anchor"]) not in anchored:
                groups.append([])
                anchored[file, p["anchor"]] = groups[-1]
            anchored[file, p["anchor"]].append(p)
            continue
        number = plain(p["document_no"]) or None
        own = numbered.get((file, kind, number)) if number else None
        if own is None and p["continues"]:
            own = latest.get((file, kind))
        if own is None:
            groups.append(own := [])
        own.append(p)
        latest[file, kind] = own
        if number:
            numbered[file, kind, number] = own
    return groups


def best(group, key, value_key):
    rank = {"low": 0, "medium": 1, "high": 2}
    meta = lambda p: (p["field_meta"] or {}).get(key) or (None, None, None, None)
    some = [p for p in group if p[key] not in (None, "") and meta(p)[3] != "not_applicable"]
    if not some:
        return None, "not_found", None, []
    chosen = max(some, key=lambda p: (rank.get(meta(p)[2], -1), -p["page"]))
    kinds = list({value_key(p[key]): p[key] for p in reversed(some)}.items())[::-1]
    return chosen[key], "ambiguous" if len(kinds) > 1 else meta(chosen)[3] or "found", str(chosen["page"]), [str(v) for _, v in kinds] if len(kinds) > 1 else []


def test_records_against_a_model(spark):
    rnd = random.Random(21)
    rows = []
    for i in range(60):
        for n in range(1, rnd.randint(2, 12)):
            meta = {k: (rnd.choice([None, "L"]), rnd.choice(["e1", "e2", None]), rnd.choice(["low", "medium", "high", None]), rnd.choice([None, "found", "not_applicable"])) for k in ("port", "tons", "legs") if rnd.random() < 0.8}
            rows.append(page(n, filename=f"f{i}", kind=rnd.choice(["native", "native", None, "blank"]), document_type=rnd.choice(["Log", "lo-g", "Crew", None]), document_no=rnd.choice([None, None, "N-1", "n1", "é"]), continues=rnd.choice([True, False, None]),
                             anchor=rnd.choice([None, None, None, 1, 2, 50]), segment_confidence=rnd.choice(["low", "high", None]), segment_reason=rnd.choice(["r1", "r2", "", None]), evidence=rnd.choice(["native_text", "vision", None]), confidence=rnd.choice(["low", "high", "odd"]),
                             error="bad" if rnd.random() < 0.08 else None, port=rnd.choice(["Kiel", "kiel!", "Oslo", "", None]), tons=rnd.choice([1.0, 2.5, None]), legs=[(rnd.choice("xyz"),) for _ in range(rnd.randrange(3))] or None, field_meta=meta))
    found = common.assemble(frame(spark, rows), SPECS)
    got = {r.document_id: r for r in found.records.collect()}
    groups, issues = model(rows), []
    assert len(got) == len(groups)
    for i, group in enumerate(groups, 1):
        r, name = got[f"doc_{i:04d}"], f"doc_{i:04d}"
        assert (r.filename, r.pages) == (group[0]["filename"], "+".join(str(p["page"]) for p in group))
        if group[0]["error"]:
            assert r.error == "bad" and r.field_meta is None
            issues.append((name, "", "bad"))
            continue
        first = lambda k: next((p[k] for p in group if p[k]), None)  # noqa: B023, E731
        assert (r.document_type, r.document_no) == (first("document_type") or "未知", first("document_no"))
        reasons = common.JOINT.join(dict.fromkeys(p["segment_reason"] for p in group if p["segment_reason"]))
        assert r.segmentation_reason == reasons and r.evidence == "+".join(dict.fromkeys(p["evidence"] for p in group if p["evidence"]))
        if r.segmentation_confidence == "low":
            assert any(p["segment_confidence"] == "low" for p in group)
            issues.append((name, common.BOUNDARY_FIELD, reasons or common.BOUNDARY_LOW))
        for key, label, vk in (("port", "Port", plain), ("tons", "Tons", lambda v: v)):
            value, status, source, conflict = best(group, key, vk)
            assert (r[key], r.field_meta[key].status, r.field_meta[key].source_page) == (value, status, source), (name, key)
            if conflict:
                issues.append((name, label, common.CONFLICT + " / ".join(conflict)))
        legs = [x[0] for p in group for x in p["legs"] or []]
        assert [x.a for x in r.legs] == legs and (r.field_meta["legs"].row_count, r.field_meta["legs"].status) == (len(legs), "found" if legs else "not_found")
        assert r.field_meta["legs"].source_page == "+".join(str(p["page"]) for p in group if p["legs"])
    assert sorted((r.document_id, r.field, r.message) for r in found.issues.collect()) == sorted(issues)


def test_interleaved_types(spark):
    rows = [page(1, document_type="Log", document_no="L-1"), page(2, document_type="Crew"), page(3, document_type="Log", continues=True), page(4, kind="blank"), page(5, document_type="Crew", error="x")]
    assert [(r.document_id, r.pages) for r in common.assemble(frame(spark, rows), SPECS).records.orderBy("document_id").collect()] == [("doc_0001", "1+3"), ("doc_0002", "2"), ("doc_0003", "5")]
    empty = common.assemble(frame(spark, rows).limit(0), SPECS)
    assert empty.records.count() == 0 and empty.issues.count() == 0
    assert list(outputs.common_sheets(empty, SPECS)) == [outputs.COMMON_SUMMARY, outputs.FIELD_EVIDENCE, "明细-Legs", outputs.BOUNDARIES]


def test_common_sheets(spark, tmp_path):
    meta = {"port": ("From", "Kiel harbour", "high", "found")}
    rows = [page(1, document_type="Log", port="Kiel", tons=2.5, legs=[("x",), ("y",)], field_meta=meta, segment_confidence="low"), page(2, document_type="Log", port="Oslo")]
    found = common.assemble(frame(spark, rows), SPECS)
    sheets = outputs.common_sheets(found, SPECS)
    first, second = sheets[outputs.COMMON_SUMMARY].orderBy("document_id").collect()
    assert (first.port, first.legs, first.status, second.legs, second.status) == ("Kiel", "2行", "待复核", "0行", "完成")
    told = {(r.pages, r.field): r for r in sheets[outputs.FIELD_EVIDENCE].collect()}
    assert len(told) == 6 and (told["1", "Port"].said, told["1", "Port"].source_label, told["2", "Tons"].status) == ("Kiel harbour", "From", "not_found")
    assert [r.a for r in sheets["明细-Legs"].collect()] == ["x", "y"] and [r.message for r in sheets[outputs.ISSUES].collect()] == [common.BOUNDARY_LOW]
    written = outputs.write_sheets(sheets, str(tmp_path / "book"), "csv")
    assert len(set(written.values())) == len(sheets) and spark.read.option("header", True).csv(written[outputs.BOUNDARIES]).count() == 2
    lines = [r.json for r in outputs.json_lines(outputs.result_rows(found.records, SPECS, ["document_id", "_inventory"])).collect()]
    assert '"_tables":{"legs":[]}' in lines[1] and '"tons":null' in lines[1]


def test_mixed_records(spark):
    schemas = {"Log": normalize_common_fields([{"key": "port"}]), "Crew": normalize_common_fields([{"key": "legs", "label": "Legs", "type": "table", "columns": [{"key": "a"}, {"key": "missing"}]}])}
    rows = [page(1, document_type="L og!", port="Kiel", anchor=1), page(2, document_type=None, anchor=2), page(3, document_type="crew", anchor=2, legs=[("x",)]), page(4, document_type="Menu", port="z"), page(5, error="torn"), page(6, document_type="Log", anchor=0)]
    found = mixed.assemble(frame(spark, rows), schemas)
    assert [(r.document_id, r.pages, r.port) for r in found.by_type["Log"].orderBy("document_id").collect()] == [("mix_doc_0001", "1", "Kiel"), ("mix_doc_0005", "6", None)]
    assert [(r.document_id, r.pages, [x.a for x in r.legs]) for r in found.by_type["Crew"].collect()] == [("mix_doc_0002", "2+3", ["x"])]
    assert [(r.document_id, r.schema_type, r.error) for r in found.others.orderBy("document_id").collect()] == [("mix_doc_0003", "Menu", None), ("mix_doc_0004", "未知", "torn")]
    assert [(r.document_id, r.message) for r in found.issues.collect()] == [("mix_doc_0004", "torn")]
    sheets = outputs.mixed_sheets(found, schemas)
    assert list(sheets) == [outputs.INDEX, "汇总-Log", "汇总-Crew", "Crew-Legs", outputs.BOUNDARIES, outputs.ISSUES]
    assert {r.document_id: r.status for r in sheets[outputs.INDEX].collect()}["mix_doc_0004"] == "失败" and sheets[outputs.INDEX].count() == 5
    assert [(r.a, r.missing) for r in sheets["Crew-Legs"].collect()] == [("x", "")]


def test_rows_are_coerced(spark):
    spec = normalize_common_fields([{"key": "t", "type": "table", "columns": [{"key": "day", "type": "date"}, {"key": "n", "type": "number"}]}])[0]
    df = spark.createDataFrame([([{"day": "2031/1/2", "n": "1,5x"}, {"n": "７"}, {"z": "1"}, {"day": "null"}],)], "t array<map<string,string>>")
    assert [tuple(r) for r in df.select(common.coerced_rows(F.col("t"), spec).alias("r")).first().r] == [("2031-01-02", None), (None, 7.0)]
    meta = spark.createDataFrame([(("a", "null", "sure", "odd"), True), (("", None, "low", "ambiguous"), False), (None, False)], "m struct<source_label:string,evidence:string,confidence:string,status:string>, has boolean")
    assert [tuple(r.x) for r in meta.select(common.field_meta(F.col("m"), F.col("has")).alias("x")).collect()] == [("a", None, "", "found"), (None, None, "low", "ambiguous"), (None, None, "", "not_found")]

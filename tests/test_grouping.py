"""Groupings against plain sequential models on random files."""

import random

from pyspark.sql import functions as F

from quirework.operators import grouping


def chain_model(pages):
    """pages of one file in order: (key or None, continues) -> group numbers."""
    out, group, force = [], 0, None
    for i, (key, cont) in enumerate(pages):
        key = key or None
        start = i == 0 or (key != force if key is not None else not cont)
        if start:
            group, force = group + 1, key
        elif key is not None:
            force = key
        out.append(group)
    return out


def random_files(rnd, n):
    return {f"f{i}": [(rnd.choice([None, "", "a", "b"]), rnd.random() < 0.5) for _ in range(rnd.randint(1, 12))] for i in range(n)}


def test_chain(spark):
    files = random_files(random.Random(3), 120)
    rows = [(f, p, k, c) for f, pages in files.items() for p, (k, c) in enumerate(pages, 1)]
    df = spark.createDataFrame(rows, "filename string, page int, key string, cont boolean")
    got = {(r.filename, r.page): r.group_no for r in grouping.chain(df, F.col("key"), F.col("cont")).collect()}
    want = {(f, p): g for f, pages in files.items() for p, g in enumerate(chain_model(pages), 1)}
    assert got == want
    bare = {(r.filename, r.page): r.group_no for r in grouping.chain(df, None, F.col("cont")).collect()}
    assert bare == {(f, p): g for f, pages in files.items() for p, g in enumerate(chain_model([(None, c) for _, c in pages]), 1)}


def test_error_pages_break_no_chain(spark):
    df = spark.createDataFrame([("f", 1, False, False), ("f", 2, False, True), ("f", 3, True, False)], "filename string, page int, cont boolean, bad boolean")
    rows = {r.page: r.group_no for r in grouping.with_errors(df, F.col("bad"), lambda p: grouping.chain(p, None, F.col("cont"))).collect()}
    assert rows == {1: 1, 2: None, 3: 1}


def number_model(pages):
    """(type, number, continues) in order -> first page of each page's group, by groups that learn numbers."""
    explicit, last, out = {}, {}, []
    for p, (t, no, cont) in enumerate(pages, 1):
        root = explicit.get((t, no)) if no else None
        if root is None and cont:
            root = last.get(t)
        if root is None:
            root = p
        last[t] = root
        if no:
            explicit[t, no] = root
        out.append(root)
    return out


def test_number_groups(spark):
    rnd = random.Random(5)
    files = {f"f{i}": [(rnd.choice("xy"), rnd.choice([None, "1", "2"]), rnd.random() < 0.5) for _ in range(rnd.randint(1, 15))] for i in range(80)}
    rows = [(f, p, *x) for f, pages in files.items() for p, x in enumerate(pages, 1)]
    df = spark.createDataFrame(rows, "filename string, page int, t string, no string, cont boolean")
    got = {(r.filename, r.page): r.root for r in grouping.number_groups(df, F.col("t"), F.col("no"), F.col("cont")).collect()}
    assert got == {(f, p): g for f, pages in files.items() for p, g in enumerate(number_model(pages), 1)}


def local_model(pages):
    """(type, number, role, anchor) in order -> anchors."""
    anchors, heads, out = {}, {}, []
    for p, (t, no, role, a) in enumerate(pages, 1):
        anchor = anchors.get(a if a is not None else p)
        if anchor is None or anchor > p:
            anchor = p
        if no:
            prior = next((q for q in range(p - 1, 0, -1) if pages[q - 1][0] == t and pages[q - 1][1] == no), None)
            if prior:
                anchor = anchors[prior]
        elif role == "continuation" and t in heads:
            anchor = heads[t]
        anchors[p] = anchor
        if role != "continuation" or t not in heads:
            heads[t] = anchor
        out.append(anchor)
    return out


def test_local_boundaries(spark):
    rnd = random.Random(7)
    files = {f"f{i}": [(rnd.choice("xy"), rnd.choice([None, None, "1", "2"]), rnd.choice(["first", "continuation", "single"]), rnd.choice([None, *range(1, 12)])) for _ in range(rnd.randint(1, 12))] for i in range(80)}
    rows = [(f, p, *x) for f, pages in files.items() for p, x in enumerate(pages, 1)]
    df = spark.createDataFrame(rows, "filename string, page long, t string, no string, role string, a long")
    got = {(r.filename, r.page): r.root for r in grouping.local_boundaries(df, F.col("t"), F.col("no"), F.col("role"), F.col("a")).collect()}
    assert got == {(f, p): g for f, pages in files.items() for p, g in enumerate(local_model(pages), 1)}


def verdict_model(pages, chunk):
    """One file's pages (type, number, continues, verdict) in order -> (anchor, confidence, reason), rule by rule over
    lists of what was decided before. A verdict is None or (anchor, type, number, confidence, error)."""
    done = []  # (type, number, anchor)
    out = []
    for at in range(0, len(pages), chunk):
        part = pages[at : at + chunk]
        failed = any(v and v[4] for _, _, _, v in part)
        for place, (t, no, cont, v) in enumerate(part, at + 1):
            own = t or "未知"
            same = [a for (u, m, a) in done if no and u == own and m == no]
            typed = [a for (u, _, a) in done if u == own]
            anchor = same[-1] if same else typed[-1] if cont and typed else place
            said_t, said_no, confidence, reason = own, no, "low", grouping.LOCAL_GROUPING
            if not failed:
                want, vt, vno, confidence, _ = v or (None, None, None, "low", None)
                said_t, said_no, reason = vt or own, vno or no, "said" if v else ""
                if want is not None and want <= place and (want == place or want in [a for _, _, a in done]):
                    anchor = want
                equal = [a for (u, m, a) in done if said_no and u == said_t and m == said_no]
                if equal:
                    anchor = equal[-1]
                held = done[anchor - 1][1] if anchor != place else None
                if said_no and held and held != said_no:
                    anchor, confidence, reason = place, "low", grouping.NUMBER_CONFLICT
            done.append((said_t, said_no, anchor))
            out.append((anchor, confidence, reason))
    return out


def test_boundary_verdicts_against_a_model(spark):
    rnd = random.Random(9)
    files = {}
    for i in range(150):
        pages = []
        for p in range(1, rnd.randint(1, 16)):
            verdict = None if rnd.random() < 0.2 else (rnd.choice([None, p, p, p - 1, p - 2, p + 1, 1]), rnd.choice([None, None, "x", "y"]), rnd.choice([None, None, None, "1", "2"]), rnd.choice(["high", "low"]), "lost" if rnd.random() < 0.04 else None)
            pages.append((rnd.choice(["x", "y", None]), rnd.choice([None, None, "1", "2"]), rnd.random() < 0.4, verdict))
        files[f"f{i}"] = pages
    rows = [(f, p, t, no, c) for f, pages in files.items() for p, (t, no, c, _) in enumerate(pages, 1)]
    said = [(f, p, v[0], v[1], v[2], v[3], "said", v[4]) for f, pages in files.items() for p, (*_, v) in enumerate(pages, 1) if v]
    pages = spark.createDataFrame(rows, "filename string, page int, doc_type string, doc_no string, continues boolean")
    verdicts = spark.createDataFrame(said, "filename string, page int, v_anchor int, v_type string, v_no string, v_confidence string, v_reason string, v_error string")
    got = {(r.filename, r.page): (r.anchor, r.confidence, r.reason) for r in grouping.refine_boundaries(pages, verdicts, chunk=5).collect()}
    want = {(f, p): x for f, pages_ in files.items() for p, x in enumerate(verdict_model(pages_, 5), 1)}
    assert got == want
    calls = {(f, a // 5) for f, pages_ in files.items() for a, (*_, v) in enumerate(pages_) if v and v[4]}
    issues = grouping.boundary_issues(pages, verdicts, chunk=5).collect()
    assert len(issues) == len(calls) > 0 and all(r.field == grouping.BOUNDARY_FIELD and r.message.endswith("lost") for r in issues)
    assert grouping.refine_boundaries(pages.limit(0), verdicts).count() == 0


def test_an_equal_number_joins_far_pages(spark):
    """Over several calls, also where the call of the later page failed."""
    rows = [("g", p, "log" if p in (1, 90) else f"t{p}", "L-9" if p in (1, 90) else None, False) for p in range(1, 95)]
    pages = spark.createDataFrame(rows, "filename string, page long, doc_type string, doc_no string, continues boolean")
    said = spark.createDataFrame([("g", 91, None, None, None, None, None, "no answer")], "filename string, page long, v_anchor long, v_type string, v_no string, v_confidence string, v_reason string, v_error string")
    got = {r.page: r for r in grouping.refine_boundaries(pages, said).collect()}
    assert got[90].anchor == 1 and got[90].reason == grouping.LOCAL_GROUPING and got[2].reason == ""
    assert [r.message for r in grouping.boundary_issues(pages, said).collect()] == ["g 第81-94页边界复核失败，已使用本地安全归组：no answer"]


def test_repeated_pages_do_not_multiply(spark):
    rows = [("f", 1, "x", "1", False), ("f", 2, "x", "1", True), ("f", 2, "x", "1", True), (None, 1, "x", None, None)]
    df = spark.createDataFrame(rows, "filename string, page int, t string, no string, cont boolean")
    got = grouping.number_groups(df.filter("filename is not null"), F.col("t"), F.col("no"), F.col("cont")).collect()
    assert sorted((r.page, r.root) for r in got) == [(1, 1), (2, 1), (2, 1)]
    assert grouping.number_groups(df.limit(0), F.col("t"), F.col("no"), F.col("cont")).count() == 0
    assert grouping.chain(df, None, F.col("cont")).count() == 4


def test_document_ids(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("a", 1)], "filename string, page int")
    got = {(r.filename, r.page): r.document_id for r in grouping.document_ids(df, ["filename", "page"]).collect()}
    assert got == {("a", 1): "doc_0001", ("a", 2): "doc_0002", ("b", 1): "doc_0003"}
    assert grouping.document_ids(df.limit(0), ["filename", "page"]).count() == 0

"""Extraction and classification by a model behind a pluggable call: retries, reminders, fallbacks, batches.

A call is a function (kind, system, user, max_tokens) -> (text, stop), where kind is text or vision and stop tells
max_tokens for a cut-off answer. It is made once per task from a picklable factory, so clients are never shipped. Python
holds the conversation only; answers leave it as JSON text, and values are taken out of them and coerced natively. What a
call returns need not be the same twice: write a result before it is read twice.

Edge cases: a page whose calls all fail is a row with an error (or, classified, a fallback item of its own); an answer
that is no JSON is asked for again once; null texts are empty; no pages make no calls.
"""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import texts
from ..functions.payload import repair_json
from ..functions.values import clean, coerce, one_of, safe_int, unread
from ..specs import CONFIDENCES, FieldSpec, scalars, tables
from ..storage import ship
from .common import identity_hints
from .extract import label_columns
from .split import safe_type

Call = Callable[[str, str, str, int], tuple[str, str]]
#: A factory of calls, which travels to the tasks.
Maker = Callable[[], Call]

# Retries and waits (seconds) of a call, statuses that a retry cannot mend, limits of tokens, pages and
# characters of a classification, and of the parts of its items; roles; the reasons of fallbacks.
RETRIES, LONGEST_WAIT, FIRST_WAIT, JITTER = 4, 8.0, 0.6, 0.4
FINAL_STATUS = (400, 401, 403, 404, 413, 422)
CUT_OFF, HARD_TOKENS = "max_tokens", 32_768
BATCH_PAGES, PAGE_CHARS, EVIDENCE_CHARS, HINT_CHARS, SUMMARY_CHARS, ERROR_CHARS = 6, 2_200, 8_000, 800, 240, 220
#: Batches that are merged in one go of a task.
TOGETHER = 64
ROLES = ("first", "continuation", "single", "unknown")
REMINDER = "\n\nThe last answer was no JSON. Answer again, with one JSON object and nothing else."
NETWORK_FALLBACK, MODEL_FALLBACK, UNCLASSIFIED = "AI网关连接失败，改按版式兜底：", "AI分拣失败，待按版式兜底：", "AI分拣失败，暂按单页保存"


class ModelError(RuntimeError):
    """The model answered, but not with what was asked for; no_vision: it cannot read images at all."""

    def __init__(self, message: str, no_vision: bool = False):
        super().__init__(message)
        self.no_vision = no_vision


def robust(act: Callable[[], Any], retries: int = RETRIES, sleep: Callable[[float], None] = time.sleep) -> Any:
    """act(), again after a growing wait while the network fails and a retry may help."""
    for attempt in range(1, retries + 2):
        try:
            return act()
        except (ConnectionError, TimeoutError) as e:
            if attempt > retries or getattr(e, "status_code", None) in FINAL_STATUS:
                raise
            sleep(min(LONGEST_WAIT, FIRST_WAIT * 2**attempt) + random.uniform(0, JITTER))


def ask(call: Call, kind: str, system: str, user: str, tokens: int, sleep: Callable[[float], None] = time.sleep) -> dict:
    """The object that the model answers: a cut-off answer is asked for with more room, one that is no JSON with a
    reminder; ValueError if that is none either."""
    once = lambda u, n: robust(lambda: call(kind, system, u, n), sleep=sleep)
    text, stop = once(user, tokens)
    if stop == CUT_OFF and tokens < HARD_TOKENS:
        text, stop = once(user, HARD_TOKENS)
        found = repair_json(text)
    else:
        found = None if stop == CUT_OFF else repair_json(text)
    if found is None:
        found = repair_json(once(user + REMINDER, max(tokens, HARD_TOKENS))[0])
    if found is None:
        raise ValueError("the answer is no JSON")
    return json.loads(found)


def tokens_for(specs: list[FieldSpec], evidence: str, rows: int = 30) -> int:
    """Tokens that an answer may need: for each scalar, and for each row (lines with two digits or more, or `rows` where
    nothing is known of the page) and column of the tables."""
    columns = sum(max(4, len(s.columns)) for s in tables(specs))
    lines = max(4, sum(sum(c.isdigit() for c in line) >= 2 for line in evidence.split("\n"))) if evidence else rows
    return min(HARD_TOKENS, 700 + 40 * len(scalars(specs)) + (lines * (15 + 14 * columns) if columns else 0))


def instructions(specs: list[FieldSpec]) -> str:
    """What a model is told of the fields."""
    lines = ["Read the fields from the page. Answer with one JSON object.", *(f"{s.key} ({s.type}): {s.label}. {s.description}".strip() for s in specs)]
    lines += [f"Rows of {s.key} are objects with the keys {', '.join(c.key for c in s.columns)}." for s in tables(specs) if s.columns]
    return "\n".join([*lines, "_is_continuation: whether the page goes on from the one before. _confidence: low, medium or high."])


def _rows(answer: dict, key: str) -> list[dict]:
    given = answer.get(key) if isinstance(answer.get(key), list) else answer.get("items")
    return [r for r in given if isinstance(r, dict)] if isinstance(given, list) else []


def extract_page(specs: list[FieldSpec], call: Call, page: dict[str, Any], vision: bool, sleep: Callable[[float], None] = time.sleep) -> tuple[dict, str]:
    """(values, evidence) of a page (kind, text, hint, note). One request for all fields; where that fails, one for the
    scalars and one for every table, of which each may fail alone. A page that is not native is read as an image where the
    model can, else by its text."""
    native = page["kind"] == "native"
    text = (page["text"] if native else page["hint"] or page["text"]) or ""
    parts = [text[:EVIDENCE_CHARS] if native else text[:HINT_CHARS] if vision else text, f"Check again: {page['note']}" if page.get("note") else ""]
    user, system = "\n\n".join(filter(None, parts)), instructions(specs)

    def read(kind: str) -> dict:
        try:
            return ask(call, kind, system, user, tokens_for(specs, text), sleep)
        except (ValueError, ModelError) as e:
            if getattr(e, "no_vision", False) or not tables(specs):
                raise
        answer = ask(call, kind, instructions(scalars(specs)), user, HARD_TOKENS, sleep) if scalars(specs) else {}
        for s in tables(specs):
            try:
                answer[s.key] = _rows(ask(call, kind, instructions([s]), user, HARD_TOKENS, sleep), s.key)
            except Exception:  # the other fields are worth keeping
                answer[s.key] = []
        return answer

    kind = "vision" if vision and not native else "text"
    try:
        answer = read(kind)
    except ModelError as e:
        if not e.no_vision or kind == "text" or not text:
            raise
        kind, answer = "text", read("text")
    for s in tables(specs):
        answer[s.key] = _rows(answer, s.key)
    return answer, "native_text" if native else "vision" if kind == "vision" else "ocr_text"


def _declared(rows: Column, spec: FieldSpec) -> Column:
    return F.transform(F.filter(rows, lambda r: F.size(r) > 0), lambda r: label_columns(r, spec))


def model_extractor(make: Maker, vision: bool = False, sleep: Callable[[float], None] = time.sleep):
    """An extractor (see `extract.Extractor`) by a model. Whether it can read images is settled before the job. Pages get
    the fields, continues, confidence, evidence, error, and <key>_raw of numbers that could not be read."""

    def extract(pages: DataFrame, specs: list[FieldSpec]) -> DataFrame:
        ship(pages.sparkSession)
        have = set(pages.columns)
        given = [F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in ("kind", "text", "hint", "note")]
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            call = make()
            for batch in batches:
                answers = []
                for r in batch[["__kind", "__text", "__hint", "__note"]].itertuples(index=False, name=None):
                    page = {k: v if isinstance(v, str) else None for k, v in zip(("kind", "text", "hint", "note"), r, strict=True)}
                    try:
                        values, evidence = extract_page(specs, call, page, vision, sleep)
                        answers.append((json.dumps(values, ensure_ascii=False), evidence, None))
                    except Exception as e:
                        answers.append((None, "failed", (str(e) or type(e).__name__)[:ERROR_CHARS]))
                out = batch.drop(columns=["__kind", "__text", "__hint", "__note"])
                yield out.assign(__answer=[a[0] for a in answers], __evidence=[a[1] for a in answers], __error=[a[2] for a in answers])

        asked = pages.select(*pages.columns, *[c.alias(f"__{n}") for c, n in zip(given, ("kind", "text", "hint", "note"), strict=True)])
        said = asked.mapInPandas(run, f"{kinds}, __answer string, __evidence string, __error string").withColumn("__v", F.try_parse_json("__answer"))
        text = lambda k: F.try_variant_get("__v", f"$['{k}']", "string")
        out: dict[str, Column] = {}
        for s in scalars(specs):
            out[s.key] = coerce(text(s.key), s.type)
            if s.type == "number":
                out[f"{s.key}_raw"] = unread(text(s.key), s.type)
        for s in tables(specs):
            rows = F.coalesce(F.try_variant_get("__v", f"$['{s.key}']", "array<map<string,string>>"), F.array().cast("array<map<string,string>>"))
            out[s.key] = _declared(rows, s) if s.columns else rows
        out |= {"continues": F.coalesce(F.try_variant_get("__v", "$._is_continuation", "boolean"), F.lit(False)), "confidence": F.coalesce(one_of(text("_confidence"), CONFIDENCES, ""), F.lit("")), "evidence": F.col("__evidence"), "error": F.col("__error")}
        return said.withColumns(out).drop("__answer", "__evidence", "__error", "__v")

    return extract


# --- classification ------------------------------------------------------------------------------------------------

_ITEM = "document_type string, document_no string, page_role string, anchor_page string, confidence string, reason string, classify_error string"


def _items(answer: Any) -> dict[int, dict]:
    """Items by page of an answer; of several for a page the last."""
    given = answer.get("pages", answer.get("items")) if isinstance(answer, dict) else answer
    out = {}
    for item in given if isinstance(given, list) else []:
        try:
            out[int(item["page"])] = item
        except (TypeError, ValueError, KeyError):
            continue
    return out


def _fallback(reason: str, error: str | None = None) -> dict:
    return {"page_role": "unknown", "confidence": "low", "reason": reason, "classify_error": error}


def classify_batch(call: Call, system: str, filename: str, batch: list[tuple[int, str]], sleep: Callable[[float], None] = time.sleep) -> dict[int, dict]:
    """Items of a batch of (page, text): one request for all; pages that its answer lacks are asked for alone, unless the
    network failed; what stays without an item gets a fallback with the reason."""

    def request(part: list[tuple[int, str]]) -> dict[int, dict]:
        user = json.dumps({"source_file": filename, "pages": [{"page": p, "text": t[:PAGE_CHARS]} for p, t in part]}, ensure_ascii=False)
        return _items(ask(call, "text", system, user, HARD_TOKENS, sleep))

    found, broken, network = {}, None, False
    try:
        found = request(batch)
    except Exception as e:
        broken = f"{type(e).__name__}: {e}"[:ERROR_CHARS]
        network = any(sign in broken.lower() for sign in texts.NETWORK_SIGNS)
    out = {}
    for page, text in batch:
        if page in found:
            out[page] = found[page]
        elif network:
            out[page] = _fallback(NETWORK_FALLBACK + broken, broken)
        else:
            try:
                out[page] = request([(page, text)])[page]
            except Exception as e:
                why = broken or f"{type(e).__name__}: {e}"[:ERROR_CHARS]
                out[page] = _fallback(MODEL_FALLBACK + why, why)
    return out


def classify_pages(pages: DataFrame, make: Maker, system: str = "", batch: int = BATCH_PAGES, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """pages (filename, page, text; blank ones are asked nothing) with document_type, document_no, page_role, anchor_page,
    confidence, reason and classify_error. `batch` neighbouring pages of a file are one request, and a task of its own, so a
    file of any length is spread over the cluster."""
    ship(pages.sparkSession)
    asked = pages if "kind" not in pages.columns else pages.filter(F.coalesce(F.col("kind") != "blank", F.lit(True)))
    hint = F.col("hint") if "hint" in pages.columns else F.lit(None)
    place = F.row_number().over(Window.partitionBy("filename").orderBy("page")) - 1
    narrow = asked.select("filename", F.col("page").cast("long").alias("page"), F.coalesce(F.when(F.col("text") != "", F.col("text")), hint, F.lit("")).alias("text"), F.floor(place / batch).alias("call"))
    kind = dict(pages.dtypes)["filename"]

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(zip(part["page"].tolist(), part["text"].tolist(), strict=True))
        found = classify_batch(make(), system, str(key[0]), rows, sleep)
        names = [c.split()[0] for c in _ITEM.split(", ")]
        plain = lambda v: None if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
        return pd.DataFrame([(key[0], p, *(plain(found[p].get(n)) for n in names)) for p, _ in rows], columns=["filename", "page", *names])

    items = narrow.groupBy("filename", "call").applyInPandas(run, f"filename {kind}, page long, {_ITEM}")
    return normalize_items(pages.withColumn("page", F.col("page").cast("long")), items)


def normalize_items(pages: DataFrame, items: DataFrame) -> DataFrame:
    """pages with the item of each: a page without one gets a fallback; types, numbers, roles and confidences are put
    right; an anchor must be a page of the file, not behind its own."""
    joined = pages.join(items, ["filename", "page"], "left").withColumn("__a", safe_int(F.col("anchor_page")))
    known = pages.select("filename", F.col("page").alias("__a"), F.lit(True).alias("__known")).distinct()
    rows = joined.join(known, ["filename", "__a"], "left")
    given = F.col("reason").isNotNull() | F.col("document_type").isNotNull() | F.col("page_role").isNotNull()
    return rows.withColumns({
        "document_type": safe_type(F.col("document_type")), "document_no": clean(F.col("document_no")), "page_role": one_of(F.col("page_role"), ROLES, "unknown"),
        "anchor_page": F.when(F.coalesce(F.col("__known") & (F.col("__a") <= F.col("page")), F.lit(False)), F.col("__a")).otherwise(F.col("page")),
        "confidence": one_of(F.col("confidence"), CONFIDENCES, "low"), "reason": F.substring(F.when(given, F.coalesce("reason", F.lit(""))).otherwise(UNCLASSIFIED), 1, 120),
    }).drop("__a", "__known")


# --- observed pages ------------------------------------------------------------------------------------------------


def observed_pages(pages: DataFrame, inventory: str = "inventory") -> DataFrame:
    """pages with document_type, document_no, page_role, continues, page_summary, identity_hints and confidence out of
    what a model observed (JSON text)."""
    v = F.try_parse_json(inventory)
    text = lambda k: F.try_variant_get(v, f"$.{k}", "string")
    hints = F.coalesce(F.try_variant_get(v, "$.identity_hints", "array<struct<label:string,value:string,role:string>>"), F.array().cast("array<struct<label:string,value:string,role:string>>"))
    role = one_of(text("page_role"), ROLES, "unknown")
    kind = F.btrim(F.coalesce(text("document_type"), F.lit("")))
    return pages.withColumns({
        "document_type": F.when(kind == "", "未知").otherwise(kind), "document_no": clean(text("document_no")), "page_role": role, "continues": F.coalesce(role == "continuation", F.lit(False)),
        "page_summary": F.substring(F.btrim(F.coalesce(text("page_summary"), F.lit(""))), 1, SUMMARY_CHARS), "identity_hints": identity_hints(hints), "confidence": F.coalesce(one_of(text("confidence"), CONFIDENCES, ""), F.lit("")),
    })


def consolidated(inventories: DataFrame, merge: Callable[[list[dict]], dict], by: str = "type_key", order: str = "place", inventory: str = "inventory", batch: int = 4, fan: int = 64) -> DataFrame:
    """by, schema (JSON) and sampled (inventories) of every type: batches of inventories (JSON texts) in their order are
    merged to partial schemas, and these `fan` at a time until one is left. A single partial schema is not merged again,
    and no task holds more than TOGETHER times `fan` of them."""
    ship(inventories.sparkSession)
    place = F.row_number().over(Window.partitionBy(by).orderBy(order, inventory)) - 1
    kind = dict(inventories.dtypes)[by]

    def merged(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for to, own in part.sort_values(["to", "at"]).groupby("to"):
            schemas = own["schema"].tolist()
            whole = bool(own["raw"].iloc[0]) or len(schemas) > 1
            schema = json.dumps(merge([json.loads(t) for t in schemas]), ensure_ascii=False, sort_keys=True) if whole else schemas[0]
            out.append((key[0], int(to), schema, int(own["n"].sum()), False))
        return pd.DataFrame(out, columns=[by, "at", "schema", "n", "raw"])

    rows = inventories.select(by, place.cast("long").alias("at"), F.col(inventory).alias("schema"), F.lit(1).cast("long").alias("n"), F.lit(True).alias("raw"))
    most = rows.groupBy(by).count().agg(F.max("count")).first()[0] or 0
    step = batch
    while True:
        # a task takes some neighbouring batches, as a group of its own for each would cost more than it holds
        grouped = rows.withColumn("to", F.floor(F.col("at") / step)).withColumn("some", F.floor(F.col("to") / TOGETHER)).groupBy(by, "some")
        rows = grouped.applyInPandas(merged, f"`{by}` {kind}, at long, schema string, n long, raw boolean")
        most, step = -(-most // step), fan
        if most <= 1:
            return rows.select(by, "schema", F.col("n").alias("sampled"))

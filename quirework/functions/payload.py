"""Answers of an extractor as JSON text: parsed natively, and repaired in Python only where that fails."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_THOUGHT = re.compile(r"<think>.*?(?:</think>|\Z)", re.S | re.I)
_FENCE = re.compile(r"^\s*```[A-Za-z]*\s*|\s*```\s*$")
_COMMA = re.compile(r",(\s*[}\]])")


def _closed(text: str) -> str:
    """The first object or list of a text, with what a cut-off answer left open closed behind its last whole part."""
    stack: list[str] = []
    inside = escaped = False
    whole: tuple[int, list[str]] | None = None  # a cut after which only closers are missing
    for i, c in enumerate(text):
        if inside:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                inside = False
        elif c == '"':
            inside = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]":
            if not stack or stack[-1] != c:
                break
            stack.pop()
            if not stack:
                return text[: i + 1]
            whole = (i + 1, list(stack))
        elif c == "," and stack:
            whole = (i, list(stack))
    if whole is None:
        return text + ('"' if inside else "") + "".join(reversed(stack))
    at, missing = whole
    return text[:at] + "".join(reversed(missing))


def repair_json(text: str | None) -> str | None:
    """Valid JSON out of an answer with thoughts, fences, words around it, trailing commas or a cut-off end; something
    that is no object becomes its `items`. Null where nothing can be read."""
    if text is None:
        return None
    bare = _FENCE.sub("", _THOUGHT.sub("", text)).strip()
    start = min((i for i in (bare.find("{"), bare.find("[")) if i >= 0), default=-1)
    tries = [bare, "{" + bare]
    if start >= 0:
        cut = _closed(bare[start:])
        tries += [cut, _COMMA.sub(r"\1", cut)]
    for t in tries:
        try:
            value = json.loads(t)
        except ValueError:
            continue
        return json.dumps(value if isinstance(value, dict) else {"items": value}, ensure_ascii=False)
    return None


def _repaired(texts: Column) -> Column:
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(repair_json)

    return F.pandas_udf(run, "string")(texts)


def parse_payload(rows: DataFrame, payload: str, name: str = "parsed") -> DataFrame:
    """rows with the payload as a variant, in one pass: only payloads that are no JSON object are handed to Python, the
    others stay null there."""
    given, mark = F.try_parse_json(F.col(payload)), f"__{name}"
    fine = rows.withColumn(mark, F.when(F.try_variant_get(given, "$", "map<string,variant>").isNotNull(), given))
    odd = F.when(F.col(mark).isNull(), F.col(payload))
    return fine.withColumn(name, F.coalesce(F.col(mark), F.try_parse_json(_repaired(odd)))).drop(mark)

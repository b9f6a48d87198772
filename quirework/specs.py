"""Field specifications: what a document's records hold. Driver-side Python, fixed before a plan is built.

Specifications come from plain dictionaries (typed by users, proposed by models, or from the preset catalogue). What is
missing or odd in them gets a defined value; nothing raises but a list that holds no field at all (`required_fields`).
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace
from functools import cache
from importlib import resources
from typing import Any

# Field types, carries, confidences; the word that starts a list of columns, and what parts its columns.
FIELD_TYPES = ("text", "number", "date", "checkbox", "table", "multiline")
CARRIES = ("first", "last")
CONFIDENCES = ("low", "medium", "high")
COLUMNS_WORD, COLUMNS_PARTED_BY = "列", ",，、;；\n"
#: Source labels kept per field in cross-layout mode.
MAX_VARIANTS = 20
#: Characters of keys beside ASCII letters, digits and underscore in fixed-format mode; cross-layout mode has none.
CHINESE = "一-鿿"


@dataclass(frozen=True)
class ColumnSpec:
    key: str
    label: str
    type: str = "text"
    description: str = ""
    source_variants: tuple[str, ...] = ()


@dataclass(frozen=True)
class SumCheck:
    """The field's value should be the sum of a column of a table field."""

    table: str
    column: str


@dataclass(frozen=True)
class FieldSpec:
    key: str
    label: str
    type: str = "text"
    description: str = ""
    group_key: bool = False
    carry: str = "first"
    sum_check: SumCheck | None = None
    columns: tuple[ColumnSpec, ...] = ()
    source_variants: tuple[str, ...] = ()
    coverage: float = 0.0
    merge_confidence: str = ""


# --- cleaning single values ----------------------------------------------------------------------------------------


def _text(value: Any) -> str:
    return "" if value is None or value is False else str(value).strip()


def _one_of(allowed: tuple[str, ...], otherwise: str) -> Callable[[Any], str]:
    return lambda value: value if isinstance(value, str) and value in allowed else otherwise


def _share(value: Any) -> float:
    try:
        number = float(value)
    except (TypeError, ValueError):
        return 0.0
    return sorted((0.0, number, 1.0))[1] if number == number else 0.0


def _variants(value: Any) -> tuple[str, ...]:
    return tuple(filter(None, map(_text, value)))[:MAX_VARIANTS] if isinstance(value, (list, tuple)) else ()


#: Attributes that are cleaned alone, whatever the rest of a field says.
_CLEAN: dict[str, Callable[[Any], Any]] = {
    "type": _one_of(FIELD_TYPES, "text"),
    "description": _text,
    "group_key": bool,
    "carry": _one_of(CARRIES, "first"),
    "source_variants": _variants,
    "coverage": _share,
    "merge_confidence": _one_of(CONFIDENCES, ""),
}


class _Names:
    """Hands out keys: wanted ones as they are, repeated ones with their place behind them."""

    def __init__(self, extra: str, stand_in: str):
        self._odd, self._stand_in, self._given = re.compile(f"[^A-Za-z0-9_{extra}]+"), stand_in, set()

    def take(self, wanted: str, place: int) -> str:
        return self.keep(self._odd.sub("_", wanted).strip("_") or f"{self._stand_in}{place}", place)

    def keep(self, name: str, place: int) -> str:
        if name in self._given:
            name = f"{name}_{place}"
        self._given.add(name)
        return name


def _dictionaries(raw: Iterable[Any] | None) -> Iterator[tuple[int, dict[str, Any]]]:
    """Places from 1 and dictionaries; other things keep their place but are left out."""
    return ((place, x) for place, x in enumerate(raw or (), 1) if isinstance(x, dict))


# --- columns -------------------------------------------------------------------------------------------------------


def _declarations(text: str) -> Iterator[tuple[int, str, str]]:
    """(place, key, label) of every part of a list of columns, character by character; key or label may be empty."""
    place, part = 1, ""
    for c in text + "\n":
        if c not in COLUMNS_PARTED_BY:
            part += c
            continue
        if part:
            bare = part.strip().rstrip("。.")
            cut = 0
            while cut < len(bare) and (bare[cut] == "_" or bare[cut].isascii() and bare[cut].isalnum()):
                cut += 1
            keyed = cut and not bare[0].isdigit()
            if bare:
                yield place, bare[:cut] if keyed else "", (bare[cut:].lstrip().removeprefix(":").removeprefix("：") if keyed else bare).strip()
            place, part = place + 1, ""
        # separators in a row part nothing, but one at the very start leaves an empty first place
        elif place == 1 and c != "\n":
            place = 2
    return


def parse_columns(description: str) -> tuple[ColumnSpec, ...]:
    """Columns out of a description that ends in a list like 「列：no 序号, name 名称」. A part without a key is named by
    its place (col2), a repeated key gets its place behind it."""
    at = re.search(rf"{COLUMNS_WORD}\s*[:：]\s*", description or "")
    if not at:
        return ()
    names = _Names(CHINESE, "")
    return tuple(ColumnSpec(names.keep(key or f"col{place}", place), label or key) for place, key, label in _declarations(description[at.end() :]))


def _columns(raw: Any) -> tuple[ColumnSpec, ...]:
    """Columns given as dictionaries."""
    names, kind, out = _Names("", "column_"), _one_of(tuple(t for t in FIELD_TYPES if t != "table"), "text"), []
    for place, c in _dictionaries(raw if isinstance(raw, (list, tuple)) else None):
        key = names.take(_text(c.get("key")), place)
        out.append(ColumnSpec(key, _text(c.get("label")) or key, kind(c.get("type")), _text(c.get("description")), _variants(c.get("source_variants"))))
    return tuple(out)


# --- fields --------------------------------------------------------------------------------------------------------


def _fields(raw: Iterable[Any] | None, extra: str, columns: Callable[[dict[str, Any], str], tuple[ColumnSpec, ...]]) -> list[tuple[FieldSpec, dict[str, Any]]]:
    names, out = _Names(extra, "field_"), []
    for place, given in _dictionaries(raw):
        key = names.take(_text(given.get("key")), place)
        known = {name: clean(given.get(name)) for name, clean in _CLEAN.items()}
        held = columns(given, known["description"]) if known["type"] == "table" else ()
        out.append((FieldSpec(key=key, label=_text(given.get("label")) or key, columns=held, **known), given))
    return out


def _named(things: Iterable[Any], name: str) -> Any | None:
    """The thing of that key, else that of that label (of several with one label the last)."""
    things = list(things)
    return next((t for t in things if t.key == name), None) or next((t for t in reversed(things) if t.label == name), None)


def normalize_fields(raw: Iterable[Any] | None, keep: str = CHINESE) -> list[FieldSpec]:
    """Specifications in fixed-format mode: columns are read from the description, a sum check may name its table and
    column by key or label. A check of no table is dropped, an unknown column is kept as it is written."""
    found = _fields(raw, keep, lambda _, description: parse_columns(description))
    every, out = [spec for spec, _ in found], []
    for spec, given in found:
        wanted = given.get("sum_check")
        table = _named(every, str(wanted.get("table", ""))) if isinstance(wanted, dict) else None
        if table is not None and table.type == "table":
            column = _text(wanted.get("column"))
            hit = next((c for c in table.columns if c.key == column), None) or next((c for c in table.columns if c.label == column), None)
            spec = replace(spec, sum_check=SumCheck(table.key, hit.key if hit else column))
        out.append(spec)
    return out


def normalize_common_fields(raw: Iterable[Any] | None) -> list[FieldSpec]:
    """Specifications in cross-layout mode: ASCII keys, typed columns as dictionaries (or, without them, read from the
    description), and no grouping, carrying or checking."""
    found = _fields(raw, "", lambda given, description: _columns(given.get("columns")) or _columns([{"key": c.key, "label": c.label} for c in parse_columns(description)]))
    return [replace(spec, group_key=False, carry="first", sum_check=None) for spec, _ in found]


def required_fields(form: str | None, common: bool = False) -> list[FieldSpec]:
    """Specifications from a JSON list; a ValueError for bad JSON, another thing than a list, and an empty list."""
    raw = json.loads(form or "[]")
    if not isinstance(raw, list):
        raise ValueError("fields are a list")
    found = normalize_common_fields(raw) if common else normalize_fields(raw)
    if not found:
        raise ValueError("no field is given")
    return found


# --- presets -------------------------------------------------------------------------------------------------------


@cache
def presets() -> dict[str, list[FieldSpec]]:
    """The preset catalogue by document type; the last type is the default.

    A line is a document type, or behind spaces a field: key, label, type, then `group`, `last`, `sum:table.column`; the
    columns of a table follow behind `列：`.
    """
    out: dict[str, list[dict[str, Any]]] = {}
    for line in resources.files(__package__).joinpath("presets.txt").read_text("utf-8").splitlines():
        if not line.strip() or line.startswith("#"):
            continue
        if not line[0].isspace():
            fields = out.setdefault(line.strip(), [])
            continue
        declared, _, columns = line.partition(f"{COLUMNS_WORD}：")
        key, label, kind, *marks = declared.split()
        field: dict[str, Any] = {"key": key, "label": label, "type": kind, "group_key": "group" in marks, "carry": "last" if "last" in marks else "first"}
        if columns:
            field["description"] = f"{COLUMNS_WORD}：{columns}"
        for mark in marks:
            if mark.startswith("sum:"):
                field["sum_check"] = dict(zip(("table", "column"), mark[4:].split("."), strict=True))
        fields.append(field)
    return {name: normalize_fields(fields) for name, fields in out.items()}


def default_fields() -> list[FieldSpec]:
    return list(presets().values())[-1]


# --- parts of a list ----------------------------------------------------------------------------------------------


def scalars(specs: list[FieldSpec]) -> list[FieldSpec]:
    return [s for s in specs if s.type != "table"]


def tables(specs: list[FieldSpec]) -> list[FieldSpec]:
    return [s for s in specs if s.type == "table"]


def group_field(specs: list[FieldSpec]) -> FieldSpec | None:
    return next((s for s in specs if s.group_key), None)


def public(specs: list[FieldSpec]) -> list[dict[str, Any]]:
    """Fields as plain dictionaries, as a program that shows or stores them takes them."""
    return [{"key": s.key, "label": s.label, "type": s.type, "sum_check": s.sum_check is not None} for s in specs]

"""Stand-ins for a model, for tests and queries: they answer by rule, and fail on purpose where they are told to."""

from __future__ import annotations

import json
import re
import zlib
from dataclasses import dataclass

from .model import CUT_OFF, HARD_TOKENS, REMINDER, ModelError


class Unreachable(ConnectionError):
    def __init__(self, status_code: int | None = None):
        super().__init__(f"connection refused ({status_code})")
        self.status_code = status_code


@dataclass(frozen=True)
class Reader:
    """A maker of calls that read "key: value" lines of the page into an object; repeated keys become a list of rows
    {"cell": value}. Of pages named by a line "page: n", those with n % 10 in a set have the fault."""

    bad_json: frozenset[int] = frozenset()
    cut_off: frozenset[int] = frozenset()
    unreachable: frozenset[int] = frozenset()
    broken: frozenset[int] = frozenset()
    blind: bool = False

    def __call__(self):
        tries: dict[int, int] = {}

        def call(kind: str, system: str, user: str, tokens: int) -> tuple[str, str]:
            if self.blind and kind == "vision":
                raise ModelError("no image can be read", no_vision=True)
            page = int(m[1]) if (m := re.search(r"^page: (\d+)$", user, re.M)) else 0
            mark, n = zlib.crc32(user.encode()), page % 10
            tries[mark] = tries.get(mark, 0) + 1
            if n in self.unreachable and tries[mark] < 3:
                raise Unreachable()
            if n in self.broken:
                raise ModelError("the model is out of order")
            seen: dict[str, list[str]] = {}
            for key, value in re.findall(r"^([a-z_]+): (.*)$", user, re.M):
                seen.setdefault(key, []).append(value)
            answer = {k: [{"cell": x} for x in v] if len(v) > 1 or k == "rows" else v[0] for k, v in seen.items()}
            text = json.dumps(answer)
            if n in self.bad_json and REMINDER not in user:
                return "Here you are: no object", "end"
            if n in self.cut_off and tokens < HARD_TOKENS:
                return text[: len(text) // 2], CUT_OFF
            return text, "end"

        return call


@dataclass(frozen=True)
class Sorter:
    """A maker of calls that classify pages by the first word of their text. An answer to several pages leaves out those
    with page % 7 == 3; requests of files in `unreachable` never get through; pages in `never` have no item at all."""

    unreachable: frozenset[str] = frozenset()
    never: int = 11

    def __call__(self):
        def call(kind: str, system: str, user: str, tokens: int) -> tuple[str, str]:
            asked = json.loads(user.removesuffix(REMINDER))
            if asked["source_file"] in self.unreachable:
                raise Unreachable(403)
            pages = [p for p in asked["pages"] if (len(asked["pages"]) == 1 or p["page"] % 7 != 3) and p["page"] % self.never]
            items = [{"page": p["page"], "document_type": p["text"].split(" ")[0], "page_role": "continuation" if p["page"] % 2 else "first", "anchor_page": p["page"] - p["page"] % 2, "confidence": "high", "reason": "by rule"} for p in pages]
            return json.dumps({"pages": items}), "end"

        return call

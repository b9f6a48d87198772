"""Recognised boxes of a scanned page to text in the page's layout.

Boxes are clustered into lines by the running mean of their middles, which depends on the box before, so a page is folded
by one task; a page has some thousands of boxes at most, and only narrow columns go there.

Edge cases: boxes without text or with a null edge are left out; a page without boxes has no row; equal middles keep the
order of their left edges, then of their texts.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# How far a box may be from its line, gaps that are three or two spaces, and the width of a character, all
# as shares of the median height; characters of a page.
SAME_LINE, WIDE, MIDDLE, CHAR_WIDTH, LIMIT = 0.6, 2.0, 0.8, 0.9, 6_000
#: Neighbouring pages that are folded in one go.
TOGETHER = 64


def page_text(boxes: list[tuple[float, float, float, str]], limit: int = LIMIT) -> str:
    """Text of a page's boxes (left edge, top, bottom, text): lines from above, gaps as one to three spaces."""
    if not boxes:
        return ""
    heights = sorted(max(1.0, bottom - top) for _, top, bottom, _ in boxes)
    height = heights[len(heights) // 2]
    lines: list[list[tuple[float, str]]] = []
    level = None
    for middle, left, text in sorted(((top + bottom) / 2, left, text) for left, top, bottom, text in boxes):
        if level is not None and abs(middle - level) <= SAME_LINE * height:
            lines[-1].append((left, text))
            level = (level + middle) / 2
        else:
            lines.append([(left, text)])
            level = middle
    out = []
    for line in lines:
        shown, end = "", None
        for left, text in sorted(line, key=lambda b: b[0]):
            gap = 0 if end is None else left - end
            shown += ("" if end is None else " " * (1 + (gap > MIDDLE * height) + (gap > WIDE * height))) + text
            end = left + len(text) * CHAR_WIDTH * height
        out.append(shown)
    return "\n".join(out)[:limit]


def page_texts(boxes: DataFrame, by: tuple[str, ...] = ("filename", "page"), limit: int = LIMIT) -> DataFrame:
    """by and text of every page, from boxes with left, top, bottom and text. The last of by is a number; TOGETHER
    neighbouring pages are folded in one go, as a group of its own for each would cost more than it holds."""
    ok = boxes.filter((F.coalesce("text", F.lit("")) != "") & F.col("left").isNotNull() & F.col("top").isNotNull() & F.col("bottom").isNotNull())
    narrow = ok.select(*by, *[F.col(c).cast("double").alias(c) for c in ("left", "top", "bottom")], "text")

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for key, page in part.groupby(list(by), dropna=False):
            out.append((*key, page_text(list(page[["left", "top", "bottom", "text"]].itertuples(index=False, name=None)), limit)))
        return pd.DataFrame(out, columns=[*by, "text"])

    kinds = dict(narrow.dtypes)
    several = narrow.groupBy(*by[:-1], F.floor(F.col(by[-1]) / TOGETHER))
    return several.applyInPandas(fold, ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "text string"]))

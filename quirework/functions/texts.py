"""Titles, layouts, quality and fingerprints of page texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import canonical, strip

# Limits of the page text, the fingerprint and the layout bins; labels that are no titles.
TEXT_LIMIT, FINGERPRINT_CHARS, MAX_GRAMS, GRAM, GRAM_STEP = 14_000, 12_000, 1_200, 4, 3
MIDDLE_MARK = "\n……(本页中部省略)……\n"
LAYOUT_BINS = ((240.0, 40), (5.0, 80), (3.0, 80), (3.0, 80), (10.0, 80))
APPENDIX = r"(?U)^(附件|附表|附录)\d*[:：]?$"
NUMBERS_ONLY = r"(?U)^[\d./：:()（）\-—_]+$"
SHORT_LABEL = r"(?U)(时间|日期|单位|页码|第\d+页)"
UNKNOWN = "未知文档"
#: What tells that a call failed on the way.
NETWORK_SIGNS = ("connecterror", "connection", "timeout", "winerror", "server disconnected", "transport", "network")

#: Lines in which a title is looked for first; only where they hold none are all lines read.
TITLE_LINES = 12
_LINE_END = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"
#: Whether a character is printable, for the share of unreadable ones.
_UNREADABLE = r"[\p{C}\p{Zl}\p{Zp}�]"


def quality_bad(text: Column) -> Column:
    """Share of unreadable characters among those that are no white space; 1 if there are none."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", "")
    bad = F.length(body) - F.length(F.regexp_replace(body, _UNREADABLE, ""))
    return F.when(F.length(body) == 0, 1.0).otherwise(bad / F.length(body))


def cid_count(text: Column) -> Column:
    """How often a glyph without a character stands in the text."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\(cid:"))


def compress_layout(text: Column) -> Column:
    """Layout text made short: no white space at line ends, at most three spaces and one blank line in a row; above
    TEXT_LIMIT characters the middle goes."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[\s&&[^\n]]+(?=\n|\z)", "")
    t = strip(F.regexp_replace(F.regexp_replace(t, " {3,}", "   "), "\n{3,}", "\n\n"))
    half = TEXT_LIMIT // 2
    return F.when(F.length(t) > TEXT_LIMIT, F.concat(F.substring(t, 1, half), F.lit(MIDDLE_MARK), F.right(t, F.lit(half)))).otherwise(t)


def _title(lines: Column) -> Column:
    """The first of the lines that may be a title, without white space and bars; null if there is none."""
    compact = F.transform(lines, lambda x: F.regexp_replace(x, r"(?U)[\s|]+", ""))
    fits = F.filter(compact, lambda x: (F.length(x) >= 3) & ~x.rlike(APPENDIX) & ~x.rlike(NUMBERS_ONLY) & ~((F.length(x) <= 16) & x.rlike(SHORT_LABEL)))
    return F.try_element_at(fits, F.lit(1))


def title_candidate(text: Column) -> Column:
    """The first line that may be a title, without white space and bars, at most 80 characters; empty if there is none.
    The first lines are tried alone, as a title mostly stands there."""
    t = F.coalesce(text, F.lit(""))
    early = _title(F.slice(F.split(t, _LINE_END, TITLE_LINES + 1), 1, TITLE_LINES))
    return F.substring(F.coalesce(early, _title(F.split(t, _LINE_END)), F.lit("")), 1, 80)


def layout_of_text(text: Column) -> Column:
    """Rough shape of a text: five binned counts (characters; lines, long ones, ones of two digits or more; runs of
    spaces, which are gone by then) as a JSON list; empty for an empty text. One pass over the lines."""
    t = strip(F.coalesce(text, F.lit("")))

    def add(sums: Column, line: Column) -> Column:
        length = F.length(strip(F.regexp_replace(line, r"(?U)\s{2,}", " ")))
        full = (length > 0).cast("int")
        digits = F.when(length > 0, (F.regexp_count(line, F.lit(r"(?U)\d")) >= 2).cast("int")).otherwise(0)
        return F.struct((sums["lines"] + full).alias("lines"), (sums["long"] + (length >= 45).cast("int")).alias("long"), (sums["digits"] + digits).alias("digits"))

    def shape(sums: Column) -> Column:
        counts = (F.length(t), sums["lines"], sums["long"], sums["digits"], F.lit(0))
        bins = [F.least(F.bround(c / F.lit(d)).cast("int"), F.lit(most)).cast("string") for c, (d, most) in zip(counts, LAYOUT_BINS, strict=True)]
        return F.when(sums["lines"] == 0, "").otherwise(F.concat(F.lit("["), F.concat_ws(", ", *bins), F.lit("]")))

    return F.aggregate(F.split(t, _LINE_END), F.struct(*[F.lit(0).alias(c) for c in ("lines", "long", "digits")]), add, shape)


def layout_signature(text: Column, layout: Column | None = None) -> Column:
    """The layout's own figures where they are known (a struct w, h, lines, images), else the text's rough shape."""
    if layout is None:
        return layout_of_text(text)
    side = F.when(layout["h"] >= layout["w"], "portrait").otherwise("landscape")
    ratio = F.bround(layout["w"] / F.greatest(F.lit(1.0), layout["h"]), 1).cast("string")
    known = F.concat(F.lit('["'), side, F.lit('", '), F.concat_ws(", ", ratio, F.bround(layout["lines"] / F.lit(40.0)).cast("int"), F.bround(layout["images"].cast("double")).cast("int")), F.lit("]"))
    return F.when(layout.isNotNull(), known).otherwise(layout_of_text(text))


def format_signature(key: Column, layout: Column, prefix: str = "layout:") -> Column:
    """Title and layout where the title has a key of four characters or more, else the layout."""
    return F.when(F.length(key) >= 4, F.concat(F.lit("title:"), key, F.lit("|layout:"), layout)).otherwise(F.concat(F.lit(prefix), layout))


def slug(c: Column) -> Column:
    """A name for files: letters, digits, Chinese characters and ._- only, at most 80 characters."""
    bare = F.btrim(F.regexp_replace(F.coalesce(F.when(c != "", c), F.lit(UNKNOWN)), r"[^0-9A-Za-z一-鿿._-]+", "_"), F.lit(" ._"))
    return F.substring(F.when(bare == "", UNKNOWN).otherwise(bare), 1, 80)


def is_network_failure(detail: Column) -> Column:
    """Whether an error's text tells that a call failed on the way."""
    low = F.lower(F.coalesce(detail, F.lit("")))
    found = F.lit(False)
    for sign in NETWORK_SIGNS:
        found = found | low.contains(sign)
    return found


def fingerprint(text: Column, kind: Column) -> Column:
    """Distinct 4-character pieces at every third place of the text in lower case, digit runs as 0 and without white
    space, and the page kind; at most 1200 pieces, the first in order."""
    t = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\d+", "0"), r"(?U)\s+", " ")
    t = F.substring(t, 1, FINGERPRINT_CHARS)
    compact = F.regexp_replace(t, r"(?U)\s+", "")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(1), F.length(compact) - (GRAM - 1)) - 1, F.lit(GRAM_STEP))
    grams = F.array_distinct(F.transform(starts, lambda i: F.substring(compact, i + 1, F.lit(GRAM))))
    capped = F.when(F.size(grams) > MAX_GRAMS, F.slice(F.array_sort(grams), 1, MAX_GRAMS)).otherwise(grams)
    own = F.array(F.concat(F.lit("kind:"), kind))
    return F.when(t == "", own).otherwise(F.array_union(capped, own))


def jaccard_distance(a: Column, b: Column) -> Column:
    """1 minus shared by all pieces; 0 if there are none."""
    return F.coalesce(1 - F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))

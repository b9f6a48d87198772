"""Coercion and comparison of extracted values, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Full-width forms and their plain ones; signs dropped from numbers; what counts as ticked.
FULL_WIDTH, PLAIN = "０１２３４５６７８９．，－", "0123456789.,-"
DATE_WIDE, DATE_PLAIN = "０１２３４５６７８９．－／", "0123456789.-/"
MONEY_SIGNS = "¥￥$,元"
TICKED = ("true", "是", "yes", "y", "1", "✓", "√")
NO_VALUE = ("", "null", "None")

#: What counts as white space everywhere: the Unicode property, as (?U)\s in a pattern has it.
WHITE_CHARS = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Digits before and behind the point of an amount; amounts are summed as they stand and rounded once.
AMOUNT = "decimal(38,10)"

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_DATE = r"(?U)(\d{4})\s*[年/.-]\s*(\d{1,2})\s*[月/.-]\s*(\d{1,2})"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(c, F.lit(WHITE_CHARS))


def plain_digits(c: Column) -> Column:
    return F.translate(c, FULL_WIDTH, PLAIN)


def number_text(c: Column) -> Column:
    """A number as plain text: without full-width forms, money signs, thousands separators and white space; null if it is
    none. Words for not-a-number and infinity are none."""
    bare = F.translate(plain_digits(c.cast("string")), WHITE_CHARS + MONEY_SIGNS, "")
    return F.when(bare.rlike(_NUMBER), bare)


def to_num(c: Column) -> Column:
    """A number out of text, as a double."""
    return number_text(c).try_cast("double")


def to_amount(c: Column) -> Column:
    """A number out of text, exact under sums: ten decimals; null beyond 28 digits before the point."""
    return number_text(c).try_cast(AMOUNT)


def to_money(c: Column) -> Column:
    """A number out of text at two decimals."""
    return to_amount(c).try_cast("decimal(30,2)")


def safe_int(c: Column) -> Column:
    """A whole number out of text, null if it is none."""
    bare = strip(plain_digits(c.cast("string")))
    return F.when(bare.rlike(r"^[+-]?\d+$"), bare.try_cast("long"))


def clean(c: Column) -> Column:
    """Null for what stands for no value, else the text without outer white space."""
    return F.when(~c.isin(*NO_VALUE), strip(c))


def norm_date(c: Column) -> Column:
    """YYYY-MM-DD of the first date in the text, not checked against the calendar; the text without outer white space
    if there is none."""
    text = strip(F.translate(c, DATE_WIDE, DATE_PLAIN))
    part = lambda i, n: F.lpad(F.regexp_extract(text, _DATE, i), n, "0")
    return F.when(c == "", F.lit(None)).when(text.rlike(_DATE), F.concat_ws("-", part(1, 4), part(2, 2), part(3, 2))).otherwise(text)


def checkbox(c: Column) -> Column:
    return F.when(~c.isin(*NO_VALUE), F.lower(strip(c)).isin(*TICKED))


def given(c: Column) -> Column:
    """Null for what stands for no value."""
    return F.when(~c.isin(*NO_VALUE), c)


def coerce(c: Column, kind: str) -> Column:
    """The value of a field type; null for null and what stands for no value. An unreadable number is null here, and its
    text is what `unread` gives."""
    return {"number": to_num, "date": norm_date, "checkbox": checkbox}.get(kind, strip)(given(c))


def unread(c: Column, kind: str) -> Column:
    """The text of a value that its field type cannot hold (an unreadable number); null for all else."""
    return F.when(number_text(c).isNull(), given(c)) if kind == "number" else F.lit(None).cast("string")


def canonical(c: Column) -> Column:
    """Lower-case ASCII letters, digits and Chinese characters only: the key under which names and numbers compare."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^0-9a-z一-鿿]+", "")


def value_key(c: Column, number: bool = False) -> Column:
    """What makes two candidate values equal."""
    return F.concat(F.lit("n:"), F.round(c.cast("double"), 6).cast("string")) if number else canonical(c.cast("string"))


def conf_rank(c: Column) -> Column:
    """low, medium, high as 0, 1, 2; anything else is null."""
    return F.when(c == "low", 0).when(c == "medium", 1).when(c == "high", 2)


def conf_name(rank: Column) -> Column:
    return F.when(rank == 0, "low").when(rank == 1, "medium").when(rank == 2, "high").otherwise("")


def min_conf(c: Column) -> Column:
    """Aggregate: the lowest known confidence, empty if none is known."""
    return conf_name(F.min(conf_rank(c)))


def one_of(c: Column, allowed: tuple[str, ...], default: str) -> Column:
    return F.when(c.isin(*allowed), c).otherwise(default)

"""Personal data: base patterns, and a semi-Markov conditional random field that adds spans.

The base patterns (email, ip, card, phone) are matched in linear time over the whole text. The field looks at zones of a
text where something like personal data may stand (signs of an address with all parts that dots or words for dots join,
clusters of seven or more digits over any white space, or four short numbers with dots between them, however few their
digits) and no base span does: a zone is cut in tokens, every run of up to LONGEST tokens is a candidate segment scored
for each kind by features of the whole span and its surroundings, and dynamic programming over bounded segments chooses
boundaries and kinds together. Typical finds are obfuscated addresses, phones without a plus sign or in national form,
and a phone and a card side by side that no pattern can tell apart. A place that something happens at ("meet at
example.com") is no address; numbers within an account number (IBAN) are no phones. Base spans stay and added spans never
overlap them.

The field is trained once per driver process by maximum likelihood on zones made by a generator with a fixed seed, the
same at every input size; it reads no input table.

Edge cases: null and empty texts have no spans; rows repeated in every column get equal results; ids are passed through,
null included; very long texts and zones cost time in proportion to their length; other columns are not read. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, ship

KINDS = ("email", "ip", "card", "phone")
#: Tokens of a candidate segment.
LONGEST = 32
SEED = 7

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")  # matches wherever it starts, so a long run of digits is read once
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_NOT_DIGITS = re.compile("[^0-9]+")

Span = tuple[int, int, int]  # start, place of the kind in KINDS, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_SET:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, 0, end
        # a local part never holds an @, so looking on behind it keeps the whole scan linear
        end = max(end, at + 1)
        at = text.find("@", end)


def base_spans(text: str) -> list[Span]:
    """The base patterns' spans, by start and then kind."""
    out = list(_emails(text))
    if _DIGIT.search(text):
        for m in _CHAIN.finditer(text):
            at, parts = m.start(), m.group().split(".")
            for i in range(0, len(parts) - 3, 4):
                four = parts[i : i + 4]
                end = at + sum(map(len, four)) + 3
                # the length test keeps absurd numbers from being parsed
                if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in four):
                    out.append((at, 1, end))
                at = end + 1
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = _NOT_DIGITS.sub("", m.group())
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_NOT_DIGITS.sub("", m.group())) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


# --- zones and tokens ---------------------------------------------------------------------------------------------

_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|\s+|[^A-Za-z0-9\s]")
_CLUSTER = re.compile(r"(?:\+|\()?[0-9](?:[\s().\-/\[\]+]{0,3}[0-9])+")
_FOUR_PARTS = re.compile(r"(?<![0-9])[0-9]{1,3}(?:\s?[\[(]?\.[\])]?\s?[0-9]{1,3}){3}(?![0-9])")
_SIGN = re.compile(r"@|[\[({<]\s?(?:at|AT|At)\s?[\])}>]|\s(?:at|AT)\s(?=[A-Za-z0-9-]{1,40}(?:\s?[\[(]?\s?(?:dot|DOT)\b|\.[A-Za-z]))")
_PART, _DOTS = r"[A-Za-z0-9._%+-]{1,64}", r"(?:\s?[\[({<]\s?(?:dot|DOT|Dot)\s?[\])}>]\s?|\s(?:dot|DOT)\s)"
_BEFORE = re.compile(rf"(?:{_PART}{_DOTS}){{0,4}}{_PART}\s?\Z")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\s?[0-9A-Z]{4}){2,7}(?:\s?[0-9A-Z]{1,3})?(?![A-Za-z0-9])")
_AFTER = re.compile(r"\s?[A-Za-z0-9-]{1,64}(?:(?:\s?[\[({]\s?(?:dot|DOT)\s?[\])}]\s?|\s(?:dot|DOT)\s|\.)[A-Za-z0-9-]{1,63}){0,8}")


def zones(text: str, base: list[Span]) -> list[tuple[int, int]]:
    """Parts of the text that the field looks at: candidates' surroundings without the base spans in them."""
    found = []
    for m in _SIGN.finditer(text):
        left = _BEFORE.search(text, max(0, m.start() - 200), m.start())
        right = _AFTER.match(text, m.end())
        if left and right:
            found.append((left.start(), right.end()))
    if _DIGIT.search(text):
        found += [m.span() for m in _CLUSTER.finditer(text) if m.end() - m.start() >= 7 and sum(map(str.isdigit, m.group())) >= 7]
        if "." in text:
            found += [m.span() for m in _FOUR_PARTS.finditer(text)]
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    if not base:
        return out
    free: list[tuple[int, int]] = []
    spans, at = sorted((a, b) for a, _, b in base), 0
    for a, b in out:
        while at and spans[at - 1][1] > a:
            at -= 1
        while at < len(spans) and spans[at][1] <= a:
            at += 1
        i = at
        while i < len(spans) and spans[i][0] < b:
            if spans[i][0] > a:
                free.append((a, spans[i][0]))
            a = max(a, spans[i][1])
            i += 1
        if a < b:
            free.append((a, b))
    return free


# --- features -----------------------------------------------------------------------------------------------------

_AT = re.compile(r"@|\bat\b", re.I)
_DOT = re.compile(r"\.|\bdot\b", re.I)
_EMAIL_LIKE = re.compile(rf"(?:{_PART}{_DOTS}){{0,4}}" r"[A-Za-z0-9._%+-]+\s?(?:@|[\[({<]\s?at\s?[\])}>]|\sat\s)\s?[A-Za-z0-9-]+(?:(?:\.|\s?[\[({]\s?dot\s?[\])}]\s?|\sdot\s)[A-Za-z0-9-]+)+\Z", re.I)
_FOUR = re.compile(r"[0-9]{1,3}(?:\s?[\[(]?\.[\])]?\s?[0-9]{1,3}){3}\Z")
_GROUPS = re.compile("[0-9]+")
_GOES_ON = re.compile(r"(?:\.|\s?[\[({]\s?dot\s?[\])}]\s?|\sdot\s)[A-Za-z0-9]", re.I)
_GOES_BACK = re.compile(rf"[A-Za-z0-9](?:\.|{_DOTS})\Z", re.I)
#: A bare "at" before a domain as it is written: a place, not an address.
_PLACE = re.compile(r"\sat\s[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+\Z", re.I)
_JOINED_BEFORE = re.compile(r"[0-9](?:[-/.]|\s?[\[(]\.[\])]\s?)\Z")
_JOINED_AFTER = re.compile(r"(?:[-/.]|\s?[\[(]\.[\])]\s?)[0-9]")
#: A dot as sentences and lists have it.
_LIST_DOT = re.compile(r"[0-9]\.\)?\s")
_PHONE_SHAPES = ("3-3-4", "1-3-3-4", "2-2-4-4", "2-4-4", "3-4-4", "2-3-3-4", "2-3-4-4", "2-2-2-2-2-2", "2-3-4-3", "2-1-2-2-2-2", "2-2-3-4", "2-4-6", "2-3-6")
#: Groups of a national number behind its leading zero.
_NATIONAL_SHAPES = ("4-7", "4-8", "4-6", "3-7", "3-8", "3-6", "2-8", "5-6", "5-5", "4-3-4", "4-3-3", "4-4-4", "3-4-4", "3-3-4", "5-3-3", "2-4-4", "4-2-2-3", "2-2-2-2-2", "3-3-2-2", "3-2-2-2")
_CALLED = re.compile(r"\b(?:tel|phone|telephone|call|fax|mobile|mob|cell|handy|telefon|téléphone|teléfono|whatsapp|sms)\b\W{0,3}\Z", re.I)
_COUNTED = re.compile(r"\b(?:iban|order|ref|reference|invoice|isbn|issn|account|acct|nr|id|serial|ean|art|version|konto|facture|pedido|bestellung)\b\W{0,3}\Z", re.I)
_CARD_SHAPES = ("16", "15", "4-4-4-4", "4-6-5", "13", "4-4-4-4-3", "19")


def span_features(text: str, start: int, end: int, account: bool = False) -> list[float]:
    """Features of a whole candidate segment; account: whether it begins within an account number."""
    s, ahead = text[start:end], text[max(0, start - 24) : start]
    groups = _GROUPS.findall(s)
    digits = "".join(groups)
    n = len(digits)
    shape = "-".join(str(len(g)) for g in groups) if len(groups) < 9 else ""
    before, after = text[start - 1 : start], text[end : end + 1]
    glued = before.isalnum() or after.isalnum() or before == "@" or after == "@"
    letters = any(map(str.isalpha, s))
    like = bool(_EMAIL_LIKE.match(s)) if letters else False
    four = bool(_FOUR.match(s)) and all(int(g) <= 255 for g in groups)
    listed = four and bool(_LIST_DOT.search(s))
    balanced = s.count("(") == s.count(")") and s.count("[") == s.count("]")
    national = s[:1] == "0" and s[:2] != "00" and 9 <= n <= 12 and not letters
    return [
        1.0,
        float(glued),
        float(before in "+(" and before != "" or after == ")"),
        float(not balanced),
        float(letters),
        float(like),
        float(letters and not like),
        float(bool(_AT.search(s))),
        float(bool(_DOT.search(s))),
        float(like and len(_AT.findall(s)) == 1),
        float(four),
        float(four and len(groups) == 4),
        float(n < 7),
        float(7 <= n < 9),
        float(9 <= n <= 10),
        float(11 <= n <= 12),
        float(13 <= n <= 15),
        float(16 <= n <= 19),
        float(n > 19),
        float(12 <= n <= 19 and luhn(digits)),
        float(shape in _CARD_SHAPES),
        float(shape in _CARD_SHAPES and luhn(digits)),
        float(shape in _PHONE_SHAPES),
        float(shape in _PHONE_SHAPES and len(groups) > 2),
        float(s.startswith("+")),
        float(s.startswith("+") and 9 <= n <= 15),
        float(s.startswith("+") and shape in _PHONE_SHAPES),
        float(s.startswith("(")),
        float(len(groups) == 1 and not letters),
        float("/" in s or "," in s or ":" in s),
        float(s.count("+") > 1),
        float("." in s and not letters),
        float("  " in s),
        float("\n" in s),
        float("\t" in s),
        float(listed),
        float(listed and n < 7),
        float(len(set(digits)) < 3 and n > 6),
        float(letters and bool(_GOES_ON.match(text, end, end + 16))),
        float(letters and bool(_GOES_BACK.search(ahead))),
        float(like and bool(_PLACE.search(s))),
        float(account),
        float(national),
        float(national and len(groups) > 1),
        float(national and shape in _NATIONAL_SHAPES),
        float(n > 6 and bool(_CALLED.search(ahead))),
        float(n > 6 and bool(_COUNTED.search(ahead))),
        float(bool(re.search(r"[0-9]\s\Z", ahead))),
        float(after.isspace() and text[end + 1 : end + 2].isdigit()),
        float(shape in _PHONE_SHAPES and s[:1] in "0123456789" and s[:1] != "0" and " " in s),
        float(bool(_JOINED_BEFORE.search(text, max(0, start - 6), start) or _JOINED_AFTER.match(text, end, end + 6))),
    ]


WIDTH = len(span_features("x", 0, 1))


def candidates(text: str, start: int, end: int) -> tuple[int, np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Tokens of a zone, and of its candidate segments: (first token, last token + 1), features and character spans."""
    tokens = [m.span() for m in _TOKEN.finditer(text, start, end)]
    bounds, rows, spans = [], [], []
    solid = [not text[a].isspace() for a, _ in tokens]
    useful = [text[a].isalnum() for a, _ in tokens]
    accounts = [m.span() for m in _IBAN.finditer(text, max(0, start - 8), min(len(text), end + 8))]
    within, at = [], 0
    for a, _ in tokens:
        while at < len(accounts) and accounts[at][1] <= a:
            at += 1
        within.append(at < len(accounts) and accounts[at][0] <= a)
    for i in range(len(tokens)):
        if not (useful[i] or text[tokens[i][0]] in "+("):
            continue
        has = 0
        for j in range(i, min(len(tokens), i + LONGEST)):
            has += tokens[j][1] - tokens[j][0] if text[tokens[j][0]].isdigit() else 0
            if solid[j] and useful[j] and (has >= 7 or j - i >= 4):
                bounds.append((i, j + 1))
                spans.append((tokens[i][0], tokens[j][1]))
                rows.append(span_features(text, *spans[-1], within[i]))
    return len(tokens), np.array(bounds, np.int64).reshape(-1, 2), np.array(rows).reshape(-1, WIDTH), spans


# --- the field ----------------------------------------------------------------------------------------------------


def _by_end(n: int, bounds: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(bounds[:, 1], kind="stable") if len(bounds) else np.zeros(0, np.int64)
    cuts = np.searchsorted(bounds[order, 1], np.arange(n + 2)) if len(bounds) else np.zeros(n + 2, np.int64)
    return [order[cuts[j] : cuts[j + 1]] for j in range(n + 1)]


def best_segments(n: int, bounds: np.ndarray, scores: np.ndarray) -> list[tuple[int, int]]:
    """(candidate, kind) of the best segmentation; a token outside of segments scores 0."""
    value, back = [0.0] * (n + 1), [(-1, -1)] * (n + 1)
    for j, own in enumerate(_by_end(n, bounds)):
        if not j:
            continue
        value[j] = value[j - 1]
        for c in own.tolist():
            kind = int(scores[c].argmax())
            total = value[bounds[c, 0]] + scores[c, kind]
            if total > value[j]:
                value[j], back[j] = total, (c, kind)
    out, j = [], n
    while j > 0:
        c, kind = back[j]
        if c < 0:
            j -= 1
        else:
            out.append((c, kind))
            j = int(bounds[c, 0])
    return out[::-1]


def expectations(n: int, bounds: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Marginal probability of every (candidate, kind), by the forward and backward sums over segmentations."""
    whole = np.logaddexp.reduce(scores, axis=1) if len(scores) else np.zeros(0)
    forward, backward = np.zeros(n + 1), np.zeros(n + 1)
    for j, own in enumerate(_by_end(n, bounds)):
        if j:
            forward[j] = np.logaddexp.reduce(np.append(forward[bounds[own, 0]] + whole[own], forward[j - 1]))
    turned = np.stack((n - bounds[:, 1], n - bounds[:, 0]), axis=1) if len(bounds) else bounds
    for j, own in enumerate(_by_end(n, turned)):
        if j:
            backward[j] = np.logaddexp.reduce(np.append(backward[turned[own, 0]] + whole[own], backward[j - 1]))
    if not len(bounds):
        return np.zeros((0, len(KINDS)))
    around = forward[bounds[:, 0]] + backward[n - bounds[:, 1]] - forward[n]
    return np.exp(np.minimum(scores + around[:, None], 0))


class Field:
    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def added(self, text: str, base: list[Span]) -> list[Span]:
        out = []
        for a, b in zones(text, base):
            n, bounds, rows, spans = candidates(text, a, b)
            if len(bounds):
                out += [(spans[c][0], kind, spans[c][1]) for c, kind in best_segments(n, bounds, rows @ self.weights)]
        return out


# --- training -----------------------------------------------------------------------------------------------------


def _example(rnd: random.Random) -> tuple[str, list[Span]]:
    """A zone with known spans: personal data of the four kinds side by side, and numbers that are none."""

    def digits(n: int) -> str:
        return "".join(rnd.choice("0123456789") for _ in range(n))

    def word(low: int = 2, high: int = 9) -> str:
        return "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(low, high)))

    def card(n: int) -> str:
        body = rnd.choice("345") + digits(n - 2)
        return next(body + c for c in "0123456789" if luhn(body + c))

    def email() -> str:
        at, dot = rnd.choice([("@", "."), (" [at] ", " [dot] "), ("[at]", "[dot]"), (" (at) ", " (dot) "), ("(at)", "."), (" at ", " dot "), (" [at] ", "."), ("[at]", "."), ("{at}", "{dot}"), (" (at) ", " dot ")])
        inner = dot if "dot" in dot and rnd.random() < 0.5 else "."
        return word() + rnd.choice(["", inner + word(), inner + word() + inner + word(), digits(2), "_" + word()]) + at + word() + rnd.choice(["", digits(1)]) + dot + rnd.choice(["com", "org", "net", "de", "example" + dot + "com", "co" + dot + "uk"])

    def ip() -> str:
        dots, few = [rnd.choice(["[.]", "(.)", " . ", " [.] ", ".", "[.]", ". "])] * 3, rnd.random() < 0.4
        if few and dots[0] == ". ":  # these are taken for lists
            dots = ["[.]"] * 3
        if "[" in dots[0] and rnd.random() < 0.2:
            dots[:2] = rnd.choice([("[.]", "."), (".", "."), (".", "[.]")])
        parts = [str(rnd.choice([0, 1, 8, 10, 127, rnd.randint(0, 99)]) if few else rnd.randint(0, 255)) for _ in range(4)]
        return "".join(map(str.__add__, parts, [*dots, ""]))

    def spaced(text: str) -> str:
        """Often with other white space between the groups of digits."""
        if " " not in text or rnd.random() < 0.6:
            return text
        if text[0] == "+" and rnd.random() < 0.1:
            return text.replace(" ", "\n", 1)
        return text.replace(" ", rnd.choice(["\u00a0", "\u202f", "\t", "\u2009", "  "]))

    def a_card() -> str:
        n = rnd.choice([16, 16, 16, 15])
        c, gap = card(n), rnd.choice(["", "", " ", "-", "."])
        return spaced(gap.join((c[:4], c[4:8], c[8:12], c[12:])) if n == 16 else gap.join((c[:4], c[4:10], c[10:])))

    def national() -> str:
        return spaced(rnd.choice([f"01{digits(2)} {digits(7)}", f"01{digits(2)}/{digits(7)}", f"01{digits(2)}-{digits(7)}", f"0{rnd.randint(20, 99)} {digits(8)}", f"0{rnd.randint(20, 99)}/{digits(7)}", " ".join(["0" + rnd.choice("1234679"), *(digits(2) for _ in range(4))]), ".".join(["0" + rnd.choice("1234679"), *(digits(2) for _ in range(4))]), f"020 {digits(4)} {digits(4)}", f"0{rnd.randint(7000, 7999)} {digits(6)}", f"0{rnd.randint(100, 199)} {digits(3)} {digits(4)}", f"(0{rnd.randint(20, 999)}) {digits(7)}", f"0{rnd.randint(100, 999)} {digits(6)}"]))

    def phone() -> str:
        if rnd.random() < 0.35:
            return national()
        area, one, two = str(rnd.randint(200, 989)), str(rnd.randint(200, 989)), digits(4)
        return spaced(rnd.choice([f"+1 ({area}) {one}-{two}", f"+1 ({area}) {one}-{two}", f"+1 {area} {one} {two}", f"+1-{area}-{one}-{two}", f"({area}) {one}-{two}", f"{area}-{one}-{two}", f"{area}.{one}.{two}", f"+44 20 {digits(4)} {digits(4)}", f"+49 30 {digits(3)} {digits(4)}", f"+33 {digits(1)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}", f"+{rnd.randint(20, 99)} {digits(3)} {digits(6)}"]))

    def iban() -> str:
        body, gap = digits(rnd.choice([18, 18, 20, 23])), rnd.choice([" ", " ", ""])
        whole = rnd.choice(["DE", "FR", "ES", "GB", "IT"]) + digits(2) + (body if rnd.random() < 0.8 else "ABCD" + body[4:])
        return rnd.choice(["", "", "IBAN "]) + gap.join(whole[i : i + 4] for i in range(0, len(whole), 4))

    def none() -> str:
        bad = card(16)
        bad = bad[:-1] + str((int(bad[-1]) + rnd.randint(1, 9)) % 10)
        gap, dot, first = rnd.choice([" ", "-", "."]), rnd.choice(["[.]", "(.)", " [.] "]), rnd.randint(0, 20)
        return spaced(rnd.choice([
            f"{rnd.randint(1900, 2099)}-{rnd.randint(1, 12):02}-{rnd.randint(1, 28):02}", f"{rnd.randint(1, 28)}/{rnd.randint(1, 12)}/{rnd.randint(1900, 2099)}", f"{rnd.randint(1900, 2099)}{rnd.randint(1, 12):02}{rnd.randint(1, 28):02}", bad, gap.join((bad[:4], bad[4:8], bad[8:12], bad[12:])), digits(10), digits(12), digits(8), digits(7), digits(20), digits(24), f"{digits(3)}-{digits(4)}", f"{rnd.randint(1, 20)}.{rnd.randint(0, 20)}.{digits(5)}", f"{rnd.randint(256, 999)}.{rnd.randint(0, 999)}.{rnd.randint(300, 999)}.{rnd.randint(0, 255)}", f"978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}", word() + digits(9), digits(8) + word(), f"{word()} at {word()} {word()}", f"{word()}@{word()}", f"at {digits(2)}", f"{digits(3)} {digits(3)} {digits(3)} {digits(3)}", f"{rnd.randint(1900, 2099)} {rnd.randint(1900, 2099)} {rnd.randint(1900, 2099)}", f"{digits(1)}.{digits(8)}", f"({rnd.randint(1900, 2099)}) {digits(4)}-{digits(4)}",
            f"{word()} at {word()}.{rnd.choice(['com', 'org', 'net', 'de'])}", f"{word()} at {word().title()}.{rnd.choice(['de', 'fr', 'es'])}", f"{word()} {word()} at www.{word()}.com", iban(), iban(), " ".join(digits(3) for _ in range(3)), " ".join(rnd.choice("123456789") + digits(1) for _ in range(5)), " ".join(str(rnd.randint(1000, 9999)) for _ in range(rnd.randint(2, 3))), f"{rnd.randint(1, 99)} {digits(3)} {digits(3)}", f"{rnd.randint(1900, 2099)}-{rnd.randint(1, 12):02}-{rnd.randint(1, 28):02} {rnd.randint(0, 23):02}:{digits(2)}:{digits(2)}", f"978 {digits(1)} {digits(2)} {digits(6)} {digits(1)}", rnd.choice(["order ", "ref ", "invoice ", "id "]) + rnd.choice([digits(8), digits(10), f"{digits(4)} {digits(6)}", f"{digits(3)}-{digits(3)}-{digits(4)}"]),
            rnd.choice([". ", ".) "]).join(str(first + k) for k in range(4)), ". ".join(digits(1) for _ in range(4)), dot.join(str(rnd.randint(0, 99)) for _ in range(rnd.choice([3, 5, 6]))), dot.join(str(rnd.randint(256, 999)) for _ in range(4)), "\n".join(digits(rnd.randint(1, 4)) for _ in range(4)), "\t".join(digits(rnd.randint(1, 3)) for _ in range(5)),
        ]))

    makers = [email, ip, a_card, phone]
    text, spans = rnd.choice(["", word() + " ", word() + " ", rnd.choice(["Tel. ", "call ", "phone: ", "mobile ", "at ", "No. "])]), []
    for i in range(rnd.randint(1, 3)):
        if i:
            text += rnd.choice([" ", " ", " ", " " + word() + " ", ", ", "\n", "\t", "\u00a0"])
        kind = rnd.randrange(9)
        if kind < 4:
            made = makers[kind]()
            spans.append((len(text), kind, len(text) + len(made)))
        else:
            made = phone() if kind == 4 else a_card() if kind == 5 else none()
            if kind in (4, 5):
                spans.append((len(text), 3 if kind == 4 else 2, len(text) + len(made)))
        text += made
    return text + rnd.choice(["", " " + word(), "."]), spans


def train(examples: int = 1600, rounds: int = 8, seed: int = SEED) -> Field:
    """Maximum likelihood by AdaGrad over made zones."""
    rnd, data = random.Random(seed), []
    for _ in range(examples):
        text, gold = _example(rnd)
        n, bounds, rows, spans = candidates(text, 0, len(text))
        if not len(bounds):
            continue
        target = np.zeros((len(bounds), len(KINDS)))
        at = {s: i for i, s in enumerate(spans)}
        for a, kind, b in gold:
            if (a, b) in at:
                target[at[a, b], kind] = 1
        data.append((n, bounds, rows, target))
    weights, squares = np.zeros((WIDTH, len(KINDS))), np.full((WIDTH, len(KINDS)), 1e-3)
    weights[0] = -2
    for _ in range(rounds):
        rnd.shuffle(data)
        for at in range(0, len(data), 16):
            part = data[at : at + 16]
            gradient = sum(rows.T @ (target - expectations(n, bounds, rows @ weights)) for n, bounds, rows, target in part) - 1e-3 * weights
            squares += gradient**2
            weights += 0.5 * gradient / np.sqrt(squares)
    return Field(weights)


_trained: list[Field] = []


def field() -> Field:
    """The field of this process, trained at its first use; every process trains the same one."""
    if not _trained:
        _trained.append(train())
    return _trained[0]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base counts by kind, base_sha256, spans (base and added), and how many were added, for every row."""
    ship(docs.sparkSession)
    model = field()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("pii")
        for batch in batches:
            columns: list[list] = [[] for _ in range(7)]
            for text in batch.column("text").to_pylist():
                base = base_spans(text) if text else []
                added = model.added(text, base) if text else []
                for k in range(4):
                    columns[k].append(sum(s[1] == k for s in base))
                columns[4].append(hashlib.sha256(joined(base).encode()).hexdigest())
                columns[5].append(joined(sorted(base + added)))
                columns[6].append(len(added))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")

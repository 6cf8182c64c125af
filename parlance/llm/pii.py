"""Personal data: expressions propose spans, checksums confirm them, context words adjust their score."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import released

BASE = ("email", "ip", "card", "phone")
#: Added: account numbers, and card numbers that a date or a code follows, cut to their longest end that the checksum confirms.
KINDS = (*BASE, "iban", "cut_card")
SPANS = T.ArrayType(T.StructType().add("kind", "string").add("start", "integer").add("end", "integer").add("score", "double"))
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL_BACK = re.compile(r"[A-Za-z0-9._%+-]*+")
# possessive, and at the start of a run of digits only: no match is lost, and long runs of digits stay linear
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_NOT_DIGIT = re.compile("[^0-9]+")
_ALNUM = re.compile("[A-Za-z0-9]")
#: How long the account numbers of a country are, after the IBAN registry.
IBAN_LENGTHS = {
    length: codes.split()
    for length, codes in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
        26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
        30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
}
_IBAN_LENGTH = {code: length for length, codes in IBAN_LENGTHS.items() for code in codes}
#: Score without context, and words that raise it when they stand shortly before or after.
SCORES = {"email": 0.8, "ip": 0.5, "card": 0.7, "phone": 0.5, "iban": 0.8, "cut_card": 0.6}
CONTEXT = {
    "email": re.compile(r"\b(?:e-?mail|mailto|contact|write)\b", re.I),
    "ip": re.compile(r"\b(?:ip|host|server|address|addr)\b", re.I),
    "card": re.compile(r"\b(?:card|visa|mastercard|credit|debit|payment)\b", re.I),
    "phone": re.compile(r"\b(?:phone|tel|telephone|mobile|call|fax)\b", re.I),
    "iban": re.compile(r"\b(?:iban|account|bank|konto|cuenta|compte)\b", re.I),
    "cut_card": re.compile(r"\b(?:card|visa|mastercard|credit|debit|payment|cvc|cvv|exp|expires)\b", re.I),
}
CONTEXT_CHARS, CONTEXT_GAIN = 40, 0.2
#: Words right before a span that say it is something else; they lower its score, below what is redacted unless other words raise it.
AGAINST = {
    "email": re.compile(r"\b(?:example|placeholder)[ :=]*$", re.I),
    "ip": re.compile(r"\b(?:version|release|firmware|section|chapter)[ :=#]*$", re.I),
    "card": re.compile(r"\b(?:isbn|issn|ean|serial|tracking)(?: (?:no|number))?[ :=#.]*$", re.I),
    "phone": re.compile(r"\b(?:order|ticket|invoice|serial|part)(?: (?:no|number))?[ :=#.]*$", re.I),
    "iban": re.compile(r"\b(?:example|placeholder)[ :=]*$", re.I),
    "cut_card": re.compile(r"\b(?:isbn|issn|ean|serial|tracking)(?: (?:no|number))?[ :=#.]*$", re.I),
}
AGAINST_LOSS = 0.4
#: Account numbers of unknown countries, whose length can't be checked, are redacted with context only.
UNKNOWN_IBAN = 0.4


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(text: str) -> bool:
    """ISO 7064 check of an account number, its first four characters moved to the end."""
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def _emails(text: str):
    """Leftmost longest addresses: found from their @, then extended to the left as far as the last match allows."""
    last, back, n = 0, None, len(text)
    for m in _DOMAIN.finditer(text):
        at = m.start()
        if back is None:
            back = text[::-1]
        start = max(last, n - _LOCAL_BACK.match(back, n - at, n - last).end())
        if start < at:
            yield start, m.end()
            last = m.end()


def _numbers(text: str, known: bool, at: int, to: int):
    """Account numbers of known countries, cut to their length; or of other ones, at the last end that the checksum confirms."""
    while m := _IBAN.search(text, at, to):
        at = m.start() + 1
        length = _IBAN_LENGTH.get(m[0][:2])
        if known == (length is None):
            continue
        ends = [i + 1 for i in range(m.start(), m.end()) if text[i] != " "]
        for n in (length,) if known else range(len(ends), 14, -1):
            if n <= len(ends) and not _ALNUM.match(text, ends[n - 1]) and mod97(text[m.start() : ends[n - 1]].replace(" ", "")):
                at = ends[n - 1]
                yield m.start(), at
                break


def _ibans(text: str) -> list[tuple[int, int]]:
    """Account numbers; those of unknown countries only beside the others, as their lengths aren't fixed."""
    if not _IBAN.search(text):
        return []
    known = list(_numbers(text, True, 0, len(text)))
    gaps = zip([0, *(b for _, b in known)], [*(a for a, _ in known), len(text)], strict=True)
    return sorted(known + [s for a, b in gaps for s in _numbers(text, False, a, b)])


def _cut_cards(text: str, start: int, end: int):
    """Of numbers that stand together, the longest card number that passes the checksum from their beginning to the end of one of them, and
    then those that follow it in the same way."""
    while True:
        digits, ends = [], []
        for i in range(start, min(end, start + 2 * 19 + 1)):
            if text[i] in "0123456789":
                digits.append(text[i])
            if 16 <= len(digits) <= 19 and (i + 1 == end or text[i + 1] in " -") and text[i] in "0123456789":
                ends.append((i + 1, len(digits)))
        to = next((at for at, n in reversed(ends) if luhn("".join(digits[:n]))), None)
        if to is None:
            return
        yield start, to
        start = to + 1


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all spans by kind, then start; in code points, end exclusive."""
    out, cut = [], []
    if "@" in text:
        out += [("email", a, b) for a, b in _emails(text)]
    if "." in text:
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_octet, m.groups()))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
            else:
                cut += [("cut_card", *s) for s in _cut_cards(text, *m.span())]
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out + [("iban", *s) for s in _ibans(text)] + cut


def score(text: str, kind: str, start: int, end: int) -> float:
    near = text[max(0, start - CONTEXT_CHARS) : start] + " " + text[end : end + CONTEXT_CHARS]
    alone = UNKNOWN_IBAN if kind == "iban" and text[start : start + 2] not in _IBAN_LENGTH else SCORES[kind]
    against = AGAINST[kind].search(text, max(0, start - CONTEXT_CHARS), start)
    return round(alone + CONTEXT_GAIN * bool(CONTEXT[kind].search(near)) - AGAINST_LOSS * bool(against), 2)


@F.arrow_udf(SPANS)
def _spans(texts: pa.Array) -> pa.Array:
    out = []
    for t in texts:
        t = t.as_py() or ""
        out.append([{"kind": k, "start": a, "end": b, "score": score(t, k, a, b)} for k, a, b in find(t)])
    return pa.array(out, _SPANS)


def spans(text: Column) -> Column:
    """Spans of personal data in a text, by kind in the order of KINDS, then start.

    A null or empty text has none; a text of any length is searched whole. Spans of one kind don't overlap; those of two kinds may.
    """
    return _spans(text)


def redacted(text: str, least: float) -> str:
    """A text with spans that score at least `least` replaced by their kind in brackets; of spans that meet, the first is named."""
    kept, at = [], 0
    for k, a, b in sorted(find(text), key=lambda s: (s[1], -s[2])):
        if score(text, k, a, b) >= least:
            if a >= at:
                kept += [text[at:a], f"[{k.upper()}]"]
            at = max(at, b)
    return "".join([*kept, text[at:]])


def _redacted(least: float):
    @F.arrow_udf(T.StringType())
    def udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from released(each)(batches)

    def each(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([None if (t := x.as_py()) is None else redacted(t, least) for x in texts], pa.string())

    return udf


def redact(docs: DataFrame, text: str = "text", least: float = 0.5) -> DataFrame:
    """docs, all columns and rows kept, repeated ones too, with redacted() texts; null stays null, an empty table stays empty."""
    return docs.withColumn(text, _redacted(least)(F.col(text)))


def scores_as_text(found: Column) -> Column:
    """The scores of spans in their order, with two places, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.format_number(s["score"], 2)), ",")


def as_text(found: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

"""Span masking: candidates by priority, overlaps dropped, accepted spans replaced.

Patterns run in order of priority. A pattern may have a group, which is then the
span: at the end of the match (a date after its label) or behind it (a name
after a title, a role or a label, so that a name does not hide the next label).
A date equal to a labelled birth date is hidden too. Spans are found in Python,
a batch of texts at a time: as one expression of built-in functions the patterns
with their walks over words took Spark longer to plan than to run.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import chain

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions.names import DOUBLE_TITLES, LABELS, NO_NAMES, TITLES
from ..functions.personal_words import BIRTH_LABELS, ENGLISH_MONTHS, INSTITUTIONS, MONTHS, PARTICLES, ROLE_STOPS, ROLES
from ..functions.text import MASKING_DIGITS, mask_email, mask_id
from .privacy import mask_name

_FOLD = str.maketrans("".join(MASKING_DIGITS), "0123456789" * len(MASKING_DIGITS))
_NATIVE = "".join(MASKING_DIGITS)
_DIGIT = f"[0-9{_NATIVE}]"
_MONTH = f"(?:{'|'.join(ENGLISH_MONTHS)})[a-z]*"
_OTHER_MONTH = "(?:" + "|".join(sorted(chain(*MONTHS.values()), key=len, reverse=True)) + ")"
_NUMBERS = {name: n for n, names in MONTHS.items() for name in names} | {name: n for n, name in enumerate(ENGLISH_MONTHS, 1)}
DATE = (
    rf"(?:[0-9]{{1,2}}(?:st|nd|rd|th)?(?:\s+of)?[\s,./-]+(?:[0-9]{{1,2}}|{_MONTH})[\s,./-]+[0-9]{{2,4}}|{_MONTH}\.?\s+[0-9]{{1,2}}(?:st|nd|rd|th)?,?\s+[0-9]{{4}}|[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}"
    rf"|{_DIGIT}{{1,2}}[\s./-]+{_OTHER_MONTH}[\s,./-]+{_DIGIT}{{2,4}}|{_DIGIT}{{1,2}}[./-]{_DIGIT}{{1,2}}[./-]{_DIGIT}{{2,4}})"
)
_BEFORE, _AFTER = r"(?<![^\W_])", r"(?![^\W_])"
BIRTH = rf"(?i){_BEFORE}(?:{BIRTH_LABELS}){_AFTER}[^\n.।]{{0,60}}?({DATE})"
_TITLE = rf"(?:{'|'.join(TITLES)})\.?\s+"
_CAPITAL = r"(?:[A-Z][A-Za-z.'’-]*+|[\u0900-\u0D7F]++)"
_ANY = r"(?:[A-Za-z][A-Za-z.'’-]*+|[\u0900-\u0D7F]++)"
_ROLE = "|".join(x.replace(" ", r"\s+") for x in sorted(ROLES, key=len, reverse=True))
_LABEL = "|".join(x.replace(" ", r"\s+") for x in LABELS)

# Spans that are masked, in order of priority, with the group that is the span (0 the match, 1 at its end or
# behind it). Ids go before ten-digit phones, which would cut a card number.
PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]++(@[A-Za-z0-9.-]+\.[A-Za-z]{2,})?", 0),  # a run of address characters is walked once; it counts with an address behind it
    ("phone", r"(?a)(?:\+\d{1,2}[\s-]?)?(?:\(\d{3}\)|\d{3,5})[\s-]\d{3}[\s-]\d{4}", 0),
    ("id", r"(?a)\b[A-Z]{2,5}-\d{4}-\d{4,}\b|\b[A-Z]{5}\d{4}[A-Z]\b|\b\d{16}\b", 0),
    ("mobile", rf"(?a)(?:\+91[\s-]?)?[6-9]\d{{4}}[\s-]?\d{{5}}\b|\b0\d{{2,4}}[\s-]?\d{{3,4}}[\s-]?\d{{4}}\b|\b\d{{5}}\s*\d{{5}}\b|(?<![{_NATIVE}])[{_NATIVE}]{{10}}(?![{_NATIVE}])", 0),
    ("id", r"(?ai)\b[A-Z]{2}\s*\d{1,2}\s*[A-Z]{1,2}\s*\d{4}\b", 0),
    ("case", r"(?ai)\bO\.?S\.?\s*(?:No\.?)?\s*\d+\s*/\s*\d{4}\b", 0),
    ("age", r"(?ai)\b\d{2}\s*(?:Y\s*)?/\s*[MF]\b", 0),
    ("birth", BIRTH, 1),
    ("date", f"(?i){DATE}", 0),
    ("titled", rf"{_BEFORE}(?:{_TITLE})+(?=({_CAPITAL}(?:\s+{_CAPITAL}){{0,2}}))", 1),
    ("role", rf"{_BEFORE}(?i:{_ROLE}){_AFTER}\.?\s*:?\s*(?:{_TITLE})*(?=({_CAPITAL}(?:\s+{_CAPITAL}){{0,2}}))", 1),
    ("honorific", rf"(?<![A-Za-z\u0900-\u0D7F])({_ANY}(?:\s+{_ANY}){{0,2}})(?=\s+(?:அவர்கள்|గారు|ಅವರು))", 1),
    ("spoken", rf"{_BEFORE}(?i:{_LABEL})\s*:?\s*(?:{_TITLE})*(?=({_ANY}(?:\s+{_ANY}){{0,2}}))", 1),
]
HIDDEN = "[hidden]"
_PIECES = ArrayType(StructType([StructField("before", StringType()), StructField("text", StringType()), StructField("kind", StringType())]))
_SPANS = ArrayType(StructType([StructField("start", IntegerType()), StructField("text", StringType()), StructField("kind", StringType())]))
NAMES = ("titled", "role", "honorific", "spoken")
_INDIC, _DIGITS = re.compile(r"[\u0900-\u0D7F]"), re.compile(rf"[0-9]{{4}}|[{_NATIVE}]{{10}}")
# Cheap tests of (text, in lower case, holds other scripts, holds four digits) that a text must pass before a pattern is tried on it.
_MAY = {
    "email": lambda t, low, other, digits: "@" in t,
    "phone": lambda t, low, other, digits: digits,
    "mobile": lambda t, low, other, digits: digits,  # a phone, unless it ends a key
    "id": lambda t, low, other, digits: digits,
    "case": lambda t, low, other, digits: digits and "/" in t,
    "age": lambda t, low, other, digits: "/" in t,
    "birth": lambda t, low, other, digits: other or any(x in low for x in ("birth", "dob", "d.o.b", "born")),
    "date": lambda t, low, other, digits: True,
    "titled": lambda t, low, other, digits: other or any(x in t for x in TITLES if x.isascii()),
    "role": lambda t, low, other, digits: other or any(x.split()[0] in low for x in ROLES if x.isascii()),
    "honorific": lambda t, low, other, digits: other and _HONORIFIC.search(t) is not None,
    "spoken": lambda t, low, other, digits: other or "name" in low,
}
_COMPILED = [(kind, re.compile(pattern), group) for kind, pattern, group in PATTERNS]
_BIRTH, _WORD = re.compile(BIRTH), re.compile(r"\S+")
_HONORIFIC = re.compile("அவர்கள்|గారు|ಅವರು")
_ISO, _PLAIN = re.compile(r"([0-9]{4})-([0-9]{2})-([0-9]{2})"), re.compile(r"([0-9]{1,2})[\s,./-]+([0-9]{1,2})[\s,./-]+([0-9]{2,4})")
_DAY_MONTH = re.compile(r"([0-9]{1,2})(?:st|nd|rd|th)?(?:\s+of)?[\s,./-]+([^0-9]+?)[\s,./-]+([0-9]{2,4})")
_MONTH_DAY = re.compile(r"([a-z]+)\.?\s+([0-9]{1,2})(?:st|nd|rd|th)?,?\s+([0-9]{4})")


def date_key(token: str) -> int | None:
    """A written date as yyyymmdd; None for what is no date."""
    t = token.translate(_FOLD).strip().lower()
    if m := _ISO.fullmatch(t):
        year, month, day = m.groups()
    elif m := _PLAIN.fullmatch(t) or _DAY_MONTH.fullmatch(t):
        day, month, year = m.groups()
    elif m := _MONTH_DAY.fullmatch(t):
        month, day, year = m.groups()
    else:
        return None
    month = int(month) if month.isdigit() else _NUMBERS.get(month) or _NUMBERS.get(month[:3], 0)
    year, day = int(year) + (0 if len(year) != 2 else 1900 if year >= "50" else 2000), int(day)
    return year * 10000 + month * 100 + day if 1900 <= year <= 2100 and 1 <= month <= 12 and 1 <= day <= 31 else None


def birth_keys_in(text: str) -> set[int]:
    """Keys of the labelled birth dates of a text."""
    return {key for m in _BIRTH.finditer(text) if (key := date_key(m[1]))}


def _name(kind: str, text: str, start: int, end: int) -> tuple[int, int]:
    """Where the name lies in what follows a title, a role or a label; an empty place if there is none."""
    words = [m.span() for m in _WORD.finditer(text, start, end)]
    bare = [text[a:b].strip(".").lower() for a, b in words]
    stops, first = {*PARTICLES, *NO_NAMES}, 0
    if kind == "role":
        stops |= {*ROLE_STOPS}
        while first < len(bare) and bare[first] in {*PARTICLES, *DOUBLE_TITLES}:
            first += 1
    elif kind in ("honorific", "spoken"):
        first = next((i for i, (a, _) in enumerate(words) if text[a].isupper() or "\u0900" <= text[a] <= "\u0d7f"), 0)
        while first < len(bare) and bare[first] in PARTICLES:
            first += 1
    last = first
    while last < len(bare) and bare[last] not in stops:
        last += 1
    if first == last:
        return start, start
    a, b = words[first][0], words[last - 1][1]
    return (a, a) if b - a < 2 or any(x in text[a:b].lower() for x in INSTITUTIONS) else (a, b)


def _within_key(text: str, start: int) -> bool:
    """Whether what starts there is the end of a key of letters and digits, or of a number that is too long for a phone."""
    at = start
    while at and text[at - 1].isascii() and (text[at - 1].isalnum() or text[at - 1] == "_"):
        at -= 1
    before = text[at:start]
    return any(c.isdigit() for c in before) and (len(before) > 5 or not before.isdigit())


def spans_in(text: str, births: set[int] | None = None) -> list[tuple[int, str, str]]:
    """Accepted spans (start, text, kind), in order of start. births: keys of birth dates known from other texts."""
    low, other, digits = text.lower(), _INDIC.search(text) is not None, _DIGITS.search(text) is not None
    keys, taken, kinds = (birth_keys_in(text) if _MAY["birth"](text, low, other, digits) else set()) | (births or set()), [], {}
    for kind, pattern, group in _COMPILED:
        if not _MAY[kind](text, low, other, digits) or (kind == "date" and not keys):
            continue
        for m in pattern.finditer(text):
            if kind == "email" and not m[1]:
                continue
            a, b = _name(kind, text, *m.span(group)) if kind in NAMES else m.span(group)
            if a == b or (kind == "date" and date_key(m[0]) not in keys) or (kind == "mobile" and _within_key(text, a)):
                continue
            at = bisect_right(taken, (a, a))
            if (at and taken[at - 1][1] > a) or (at < len(taken) and taken[at][0] < b):
                continue
            taken.insert(at, (a, b))
            kinds[a] = "name" if kind in NAMES else {"date": "birth", "mobile": "phone"}.get(kind, kind)
    return [(a, text[a:b], kinds[a]) for a, b in taken]


@F.pandas_udf(_SPANS)
def _spans(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else [{"start": a, "text": x, "kind": k} for a, x, k in spans_in(t)])


@F.pandas_udf(_SPANS)
def _spans_knowing(texts: pd.Series, births: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else [{"start": a, "text": x, "kind": k} for a, x, k in spans_in(t, set() if b is None else {*map(int, b)})] for t, b in zip(texts, births, strict=True)])


def _cut(text: str | None, births: set[int] | None = None) -> list[dict] | None:
    """A text as pieces: what stands before each span, and the span; the last piece has no span."""
    if text is None:
        return None
    out, at = [], 0
    for a, x, kind in spans_in(text, births):
        out.append({"before": text[at:a], "text": x, "kind": kind})
        at = a + len(x)
    return [*out, {"before": text[at:], "text": None, "kind": None}]


@F.pandas_udf(_PIECES)
def _pieces(texts: pd.Series) -> pd.Series:
    return texts.map(_cut)


@F.pandas_udf(_PIECES)
def _pieces_knowing(texts: pd.Series, births: pd.Series) -> pd.Series:
    return pd.Series([_cut(t, set() if b is None else {*map(int, b)}) for t, b in zip(texts, births, strict=True)])


@F.pandas_udf(ArrayType(IntegerType()))
def birth_keys(texts: pd.Series) -> pd.Series:
    """Keys of all labelled birth dates in an array of texts, each once."""
    return texts.map(lambda all_: sorted(set().union(*(birth_keys_in(t) for t in (all_ if all_ is not None else []) if t))))


def spans(t: Column, births: Column | None = None) -> Column:
    """Accepted spans (start from 0, text, kind), in order of start. births: keys of birth dates known from other texts."""
    return _spans(t) if births is None else _spans_knowing(t, births)


def mask(kind: Column, value: Column) -> Column:
    """The replacement of a span."""
    words = F.array_join(F.transform(F.split(value, r"(?<=\s)(?=\S)|(?<=\S)(?=\s)"), lambda w: F.when(w.rlike(r"\S"), mask_name(w)).otherwise(w)), "")
    other = F.when(kind == "case", "O.S. No. **** / 026").when(kind.isin("age", "birth"), HIDDEN).when(kind == "name", words)
    return F.when(kind == "phone", F.repeat(F.lit("*"), 10)).when(kind == "email", mask_email(value)).when(kind == "id", mask_id(value)).otherwise(other)


@F.pandas_udf(ArrayType(_PIECES))
def _pieces_each(texts: pd.Series, births: pd.Series) -> pd.Series:
    return pd.Series([None if all_ is None else [_cut(t, set() if b is None else {*map(int, b)}) for t in all_] for all_, b in zip(texts, births, strict=True)])


def masked_each(texts: Column, births: Column) -> Column:
    """Every text of an array with all accepted spans replaced."""
    return F.transform(_pieces_each(texts, births), _put_together)


def _put_together(pieces: Column) -> Column:
    return F.array_join(F.transform(pieces, lambda p: F.concat(p["before"], F.coalesce(mask(p["kind"], p["text"]), F.lit("")))), "")


def masked(t: Column, births: Column | None = None) -> Column:
    """The text with all accepted spans replaced; it is cut at the spans once, so the work grows with its length."""
    return _put_together(_pieces(t) if births is None else _pieces_knowing(t, births))
